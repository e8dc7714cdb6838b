"""Archives and heads of skills by hand-made bytes and texts."""

import io
import stat
import tarfile
import zipfile

import pytest

from lakesift.functions.frontmatter import fields, validated
from lakesift.sources import archives


def zipped(*files, link=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
        if link:
            info = zipfile.ZipInfo(link)
            info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, "x")
    return out.getvalue()


def tarred(*files, mode="w", special=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        if special is not None:
            info = tarfile.TarInfo("odd")
            info.type = special
            t.addfile(info)
    return out.getvalue()


LIMITS = archives.Limits(3, 100, 60)
CASES = {
    "flat": ("zip", zipped(("SKILL.md", b"a"), ("dir/", b""), ("dir/b.md", b"bb"))), "nested": ("tar", tarred(("./top/SKILL.md", b"a"), ("top/x", b""))), "gz": ("tar", tarred(("p/SKILL.md", b"a"), ("q/SKILL.md", b"b"), mode="w:gz")),
    "escape": ("zip", zipped(("a/../../x", b""))), "absolute": ("tar", tarred(("/etc/x", b""))), "drive": ("zip", zipped(("C:\\x", b""))), "inside": ("zip", zipped(("a/../b", b"1"))), "link": ("zip", zipped(("a", b""), link="l")),
    "symlink": ("tar", tarred(special=tarfile.SYMTYPE)), "hardlink": ("tar", tarred(special=tarfile.LNKTYPE)), "fifo": ("tar", tarred(special=tarfile.FIFOTYPE)),
    "many": ("zip", zipped(*[(str(k), b"") for k in range(4)])), "large": ("zip", zipped(("a", b"0" * 61))), "total": ("tar", tarred(("a", b"0" * 60), ("b", b"0" * 41))), "exact": ("tar", tarred(("a", b"0" * 60), ("b", b"0" * 40))),
    "broken": ("zip", b"PK nothing"), "cut": ("tar", tarred(("a", b"0" * 50), mode="w:gz")[:40]), "none": ("zip", None), "other": ("rar", b""), "empty": ("zip", zipped()),
}
ERRORS = {
    "escape": "ARCHIVE_PATH_ESCAPE: archive entry escapes destination: a/../../x", "absolute": "ARCHIVE_PATH_ESCAPE: archive entry escapes destination: /etc/x", "drive": "ARCHIVE_PATH_ESCAPE: archive entry escapes destination: C:\\x",
    "link": "SYMLINK_IN_ARCHIVE: archive contains symlink entry: l", "symlink": "SYMLINK_IN_ARCHIVE: archive contains symlink entry: odd", "hardlink": "SYMLINK_IN_ARCHIVE: archive contains hardlink entry: odd",
    "fifo": "archive contains unsupported special entry: odd", "many": "archive exceeds max files limit: 3", "large": "archive file exceeds max file bytes: a", "total": "archive exceeds max total bytes: 100",
    "broken": "failed to open zip archive", "cut": "failed to open tar archive", "none": "failed to open zip archive", "other": "unsupported archive kind: rar",
}
PATHS = {"flat": ["SKILL.md", "dir/b.md"], "nested": ["top/SKILL.md", "top/x"], "gz": ["p/SKILL.md", "q/SKILL.md"], "inside": ["b"], "exact": ["a", "b"]}


@pytest.fixture(scope="module")
def found(spark):
    table = spark.createDataFrame([(a, k, None if c is None else bytearray(c)) for a, (k, c) in CASES.items()], "archive string, kind string, content binary")
    return archives.entries(table, LIMITS).cache()


def test_entries_and_errors(found):
    rows = found.collect()
    assert {r.archive: r.error for r in rows if r.error} == ERRORS
    assert {a: [r.path for r in sorted(rows, key=lambda r: r.nth) if r.archive == a] for a in PATHS} == PATHS
    assert {r.archive for r in rows} == set(ERRORS) | set(PATHS)


def test_roots(found):
    got = {r.archive: (r.root, r.error) for r in archives.roots(found).collect()}
    missing = "archive must contain SKILL.md at root or in a single top-level directory"
    assert got["flat"] == ("", None) and got["nested"] == ("top", None) and got["gz"] == (None, missing) and got["inside"] == (None, missing)
    assert {a: e for a, (_, e) in got.items() if a in ERRORS} == ERRORS


def test_declared_sizes_are_not_trusted():
    content = bytearray(zipped(("a", b"0" * 90)))
    at = content.index(b"PK\x01\x02")
    content[at + 24 : at + 28] = (10).to_bytes(4, "little")  # the directory tells a smaller size
    (row,) = archives.unpacked("zip", bytes(content), LIMITS)
    assert row[3] is not None or len(row[2]) <= 60


def test_archive_files_are_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.ZIP").write_bytes(zipped(("SKILL.md", b"a")))
    (tmp_path / "b.tar.gz").write_bytes(tarred(("x/y", b"abc"), mode="w:gz"))
    (tmp_path / "big.tar").write_bytes(tarred(("x/y", b"0" * 5000)))
    (tmp_path / "note.txt").write_bytes(b"x")
    got = {(r.archive.rpartition("/")[2], r.path, r.error) for r in archives.read(spark, str(tmp_path), max_archive=4000).collect()}
    assert got == {("A.ZIP", "SKILL.md", None), ("b.tar.gz", "x/y", None), ("big.tar", None, "archive exceeds max archive bytes")}
    assert archives.entries(spark.createDataFrame([], "archive string, kind string, content binary")).count() == 0


def head(body):
    return f"---\n{body}\n---\ntext"


GOOD = {
    "name: a-b\ndescription: Sums up pages": "Sums up pages", 'name: "a-b"\ndescription: "x: \\"y\\" # z"': 'x: "y" # z', "name: a-b\ndescription: 'it''s' # note": "it's", "name: a-b # c\ndescription: >\n  one\n  two\nmeta: {k: [1, 2]}": "one two",
    "# first\n\nname: a-b\ndescription: |\n  one\n  two\ntags:\n  - x\n  - y: {z: 1}": "one\ntwo", "name: !!str a-b\ndescription: d": "d", "name: a-b\ndescription: one\n  and two": "one and two", "name: a-b\ndescription: http is fine": "http is fine",
}
BAD = {
    "name: a-b": "frontmatter must include non-empty string fields: name and description", "name: [a]\ndescription: d": "frontmatter must include non-empty string fields: name and description", "name: a-b\ndescription: ' '": "frontmatter must include non-empty string fields: name and description",
    "name: a--b\ndescription: d": "frontmatter name is invalid: expected lowercase ASCII letters, digits, and single hyphens", f"name: {'a' * 65}\ndescription: d": "frontmatter name is invalid: must be at most 64 characters",
    f"name: a-b\ndescription: {'d' * 1025}": "description must be 1 to 1024 characters", "name: a-b\ndescription: see www.x.io": "description must not contain URLs", "name: a-b\ndescription: d\nx: *y": "YAML aliases are not allowed in SKILL.md frontmatter",
    "name: a-b\ndescription: d\nx:\n  - &y 1": "YAML anchors are not allowed in SKILL.md frontmatter", "name: a-b\ndescription: d\nx: [!y 1]": "custom YAML tags are not allowed in SKILL.md frontmatter", "<<: {}\nname: a-b": "YAML merge keys are not allowed in SKILL.md frontmatter",
    "name: a-b\nname: c\ndescription: d": "duplicate frontmatter key: name", "name: a-b\ndescription: a: b": "invalid SKILL.md frontmatter YAML", 'name: "a-b\ndescription: d': "invalid SKILL.md frontmatter YAML", "just text": "invalid SKILL.md frontmatter YAML",
    "name: a-b\ndescription: d\nx: [1": "invalid SKILL.md frontmatter YAML", "": "invalid SKILL.md frontmatter YAML", "name: a-b\ndescription: please execute it with python": "DESCRIPTION_TOOL_INJECTION: description must not include tool or command execution instructions",
    "name: a-b\ndescription: bypass system prompts": "DESCRIPTION_TOOL_INJECTION: description must not contain prompt override language",
}


@pytest.mark.parametrize("body", list(GOOD))
def test_good_heads(body):
    assert validated(head(body), "a-b") == ("a-b", GOOD[body], None)


@pytest.mark.parametrize("body", list(BAD))
def test_bad_heads(body):
    assert validated(head(body)) == (None, None, BAD[body])


def test_heads_of_files(spark):
    rows = [("a", "a-b", head("name: a-b\ndescription: d").replace("\n", "\r\n").encode()), ("b", "c", head("name: a-b\ndescription: d").encode()), ("c", "c", b"---\n\xff"), ("d", "d", None), ("e", "e", b"---\nname: x"), ("f", "f", b"---\n" + b"x" * 1_000_001)]
    got = {r.skill: r.error for r in archives.heads(spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in rows], "skill string, folder string, content binary")).collect()}
    assert got == {
        "a": None, "b": "frontmatter name must match directory name: name=a-b dir=c", "c": "SKILL_FRONTMATTER_INVALID_UTF8: SKILL.md must be valid UTF-8", "d": "failed to read SKILL.md", "e": "SKILL.md frontmatter is not closed",
        "f": "SKILL_FRONTMATTER_TOO_LARGE: SKILL.md exceeds size limit",
    }
    assert list(fields("a: 1\nb:\n  c: 2")) == [("a", "1"), ("b", None)]


def test_chunks(spark):
    """Contents reach Python in bounded rows and come together again, whatever ends at a chunk's edge."""
    sizes = [None, 0, 1, archives.CHUNK - 1, archives.CHUNK, archives.CHUNK + 1, 3 * archives.CHUNK]
    made = [(f"a{k}", "zip", None if n is None else bytearray(k % 251 for k in range(n))) for k, n in enumerate(sizes)]
    cut = archives.in_chunks(spark.createDataFrame(made, "archive string, kind string, content binary").coalesce(1), ("archive", "kind"), "content")
    assert max(len(r.chunk or b"") for r in cut.collect()) == archives.CHUNK
    for most in (1, 2, 100):
        batches = cut.toArrow().to_batches(most)
        assert list(archives.whole(iter(batches))) == [(a, k, None if c is None else bytes(c)) for a, k, c in made]


def test_one_archive_a_batch(spark):
    """Packed archives leave their task one at a time, so a task's memory doesn't grow with its rows."""
    rows = spark.range(40).selectExpr("id AS number", "concat('top/', id) AS path", "CAST('x' AS binary) AS content").coalesce(1)
    batches = archives.in_chunks(rows, ("number", "path"), "content").toArrow().to_batches()
    assert [b.num_rows for b in archives._packed(iter(batches))] == [1] * 40
