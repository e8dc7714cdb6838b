"""The whole scan of bundles: every line in all its spellings against every rule, as one relation of findings.

Lines and joined lines meet the rules that expressions can tell in the JVM. The few lines that may hold more (an
address, a launcher, a bracket, an encoded token, a character with a compatibility form) pass one Arrow stage, which
tells what needs an automaton or a parser and gives back the other spellings of the line: its compatibility form and
what it encodes, down to three levels. Those meet the same expressions. Link references are joined with the first
definition of their name in the file by a window over (file, name). A finding is
(bundle, path, line, rule_id, severity), each once.

Defined results: a null text is an empty file, a null path or bundle stays null and is its own file; a file that is
not UTF-8 or larger than LARGE_BYTES has one finding on line 1; an empty table has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesift.functions import encoded, hosts, paths, runtime_pin, shell
from lakesift.functions.dialect import Dialect
from lakesift.operators import rules
from lakesift.sources import bundles

#: Rules that the Arrow stage tells, or that come from files and paths, with their severities.
MORE_RULES = {
    "NFKC_CHANGES_TEXT": "medium", "NON_UTF8_TEXT": "high", "MIXED_SCRIPT_FILENAME": "medium", "CONFUSABLE_FILENAME": "high",
    "LINK_SPOOFING_URL_MISMATCH": "high", "LARGE_TEXT_FILE": "medium", "UNKNOWN_FILE_TYPE": "medium", "CHMOD_EXEC_CHAIN": "critical",
}
SEVERITY = {rule: severity for rule, severity, _, _ in rules.RULES} | MORE_RULES
#: Rules whose expressions the Arrow stage replaces, as it parses addresses and command lines.
PARSED = ("UNPINNED_RUNTIME_TOOL", "RAW_IP_URL", "URL_SHORTENER", "PASTE_SITE_URL", "REMOTE_IMAGE_URL", "RELEASE_ASSET_URL")
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".ico")
ASSET_HOST, ASSET_FOLDERS = "github-releases.githubusercontent.com", ("/releases/download/", "/releases/latest/download/")
#: Every character that a rule without needles looks for; most odd characters are letters, which none does.
LOOKED_FOR = (
    r"[\x00-\x1F\x7F-\x{10FFFF}&&[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}"
    r"\x{FE00}-\x{FE0F}\x{FEFF}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]]"
)
VISIBLE = r"[^\t-\r \x{85}\p{Z}]"

_PIN = re.compile(runtime_pin.GATE)
_SOURCE = re.compile(shell.GATE, re.IGNORECASE)
_ENCODED = re.compile(encoded.GATE)
_LINE = "bundle string, path string, kind string, line int"
_OUT = f"{_LINE}, what string, text string, raw boolean, ref string, host string"


def lines(files: DataFrame) -> DataFrame:
    """The visible lines of files, with their joined form and the line that follows where a rule may need it."""
    d = Dialect()
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n")
    held = F.transform(
        "parts",
        lambda x, i: F.struct(
            x.alias("t"), F.when(_goes_on(x), F.slice("parts", i + 2, F.lit(rules.LOOK_AHEAD))).alias("nexts"), F.when(F.contains(x, F.lit("]")), F.get("parts", i + 1)).alias("following")
        ),
    )
    rows = files.withColumn("parts", F.split(text, "\n", -1)).select("bundle", "path", "kind", F.posexplode_outer(held).alias("pos", "one"))
    rows = rows.select("bundle", "path", "kind", (F.col("pos") + 1).alias("line"), F.col("one.t").alias("line_text"), F.col("one.nexts").alias("nexts"), F.col("one.following").alias("following"))
    return rows.filter(F.expr(d.hit("line_text", VISIBLE))).withColumn("longer", _joined()).drop("nexts")


def _goes_on(x: Column) -> Column:
    """Whether a line continues on the next: it ends in a backslash, pipe or &&, or opens $( without any closing bracket."""
    return F.rlike(x, F.lit(r"(?:[\\|]|&&)[\s\x0B]*\z")) | (F.contains(x, F.lit("$(")) & ~F.contains(x, F.lit(")")))


def _joined() -> Column:
    """The line with those it continues on, as long as the text so far goes on and no blank line comes."""
    def segment(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s*\\$", "")

    def step(a: Column, x: Column) -> Column:
        both = F.concat(a["text"], F.lit(" "), segment(x))
        return F.when(a["open"] & F.rlike(x, F.lit(r"\S")), F.struct(both.alias("text"), _goes_on(both).alias("open"), F.lit(True).alias("more"))).otherwise(
            F.struct(a["text"].alias("text"), F.lit(False).alias("open"), a["more"].alias("more"))
        )

    start = F.struct(segment(F.col("line_text")).alias("text"), F.lit(True).alias("open"), F.lit(False).alias("more"))
    return F.when(F.col("nexts").isNotNull(), F.aggregate("nexts", start, step, lambda a: F.when(a["more"], a["text"])))


def _may_hold_more() -> Column:
    """Lines that the Arrow stage has to see; cheap tests come first, expressions only behind them."""
    def tests(both: Column) -> Column:
        def has(*needles: str) -> Column:
            return reduce(or_, [F.contains(both, F.lit(n)) for n in needles])

        return (
            has("//", "npx", "uvx", "bunx", "dlx", "exec", "deno") | (has("go") & has("run")) | (has("<(") & has("curl", "wget"))
            | (has("|") & F.rlike(both, F.lit(shell.GATE))) | ((F.col("kind") == "markdown") & has("]"))
            | ((F.length(both) >= encoded.BASE64_LEAST) & F.rlike(both, F.lit(encoded.JVM_GATE)))
            | ((F.octet_length(both) != F.length(both)) & F.rlike(both, F.lit(encoded.JVM_MAY_CHANGE)))
        )

    # The one element of an array names the text, so that it is made once.
    return F.element_at(F.transform(F.array(F.lower(F.concat_ws(" ", "line_text", "longer"))), tests), 1)


def is_release_asset(host: str, path: str) -> bool:
    """Whether an address is a hosted file of a release: by its folder, or by numbers in the interface's paths."""
    low = path.lower()
    if host in ("api.github.com", "uploads.github.com"):
        parts = low.strip("/").split("/")
        if len(parts) != 6 or parts[0] != "repos" or parts[3] != "releases" or not (parts[1] and parts[2]):
            return False
        number, word = (parts[5], parts[4]) if parts[4] == "assets" and host == "api.github.com" else (parts[4], parts[5])
        return word == "assets" and number.isascii() and number.isdigit()
    if host == "github.com":
        return any(f in low for f in ASSET_FOLDERS)
    return host == ASSET_HOST or (host == "objects.githubusercontent.com" and "github-production-release-asset-" in low)


def _within(host: str, domains: tuple[str, ...]) -> bool:
    return any(host == x or host.endswith(f".{x}") for x in domains)


def parsed_rules(text: str, markdown: bool) -> set[str]:
    """The rules of one spelling of a line that need a parser."""
    out = set(shell.sourced(text)) if _SOURCE.search(text) else set()
    if _PIN.search(text) and runtime_pin.unpinned(text):
        out.add("UNPINNED_RUNTIME_TOOL")
    if "//" in text:
        shows_image = markdown and ("![" in text or "<img" in text.lower())
        for host, path in hosts.urls(text):
            tests = {
                "RAW_IP_URL": hosts.is_address(host), "URL_SHORTENER": _within(host, rules.SHORTENERS), "PASTE_SITE_URL": _within(host, rules.PASTE_SITES),
                "RELEASE_ASSET_URL": is_release_asset(host, path), "REMOTE_IMAGE_URL": shows_image and path.lower().endswith(IMAGES),
            }
            out |= {rule for rule, hit in tests.items() if hit}
    if markdown and "](" in text and hosts.spoofed(text):
        out.add("LINK_SPOOFING_URL_MISMATCH")
    return out


def examine(kind: str, text: str, longer: str | None, following: str | None) -> Iterator[tuple]:
    """(what, text, raw, ref, host) of a line: spellings to be scanned, hits, definitions and usages of references."""
    markdown = kind == "markdown"
    own = [text] if longer is None else [text, longer]
    more = [(v, False) for t in own if (v := encoded.compatible(t)) != t]
    hits = {"NFKC_CHANGES_TEXT"} if encoded.compatible(text) != text else set()
    spellings = own + [v for v, _ in more]
    if any(map(_ENCODED.search, spellings)):
        for line, raw in encoded.decoded_lines(spellings):
            more.append((line, raw))
            if raw and encoded.compatible(line) != line:
                hits.add("NFKC_CHANGES_TEXT")
    for v in dict.fromkeys(own + [v for v, _ in more]):
        hits |= parsed_rules(v, markdown)
    yield from (("text", v, raw, None, None) for v, raw in dict.fromkeys(more))
    yield from (("hit", rule, None, None, None) for rule in sorted(hits))
    if markdown and "]" in text:
        if found := hosts.definition(text, following):
            yield ("definition", None, None, *found)
        continued = hosts.continued_reference(text, following)
        for v in dict.fromkeys(spellings + [continued] * (continued is not None)):
            for ref, shown in dict.fromkeys(hosts.references(v)):
                yield ("usage", None, None, ref, shown)


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for bundle, path, kind, line, text, longer, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(bundle, path, kind, line, *found) for found in examine(kind, text, longer, following)]
        yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names=names)


def _rules_of(source: DataFrame) -> DataFrame:
    """source (kind, line_text, longer, raw ...) with the array `ids` of the rules that expressions tell."""
    d = Dialect()
    with_low = source.withColumn("low", F.lower(F.concat_ws(" ", "line_text", "longer"))).withColumn("odd", F.col("raw") & F.expr(d.hit("line_text", rules.ODD)) & F.expr(d.hit("line_text", LOOKED_FOR)))
    return with_low.withColumn("ids", F.expr(rules.found(d, PARSED)))


def _path_findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(b, p, r) for b, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in paths.path_risks(p)]
        yield pa.record_batch([pa.array([f[k] for f in found], pa.string()) for k in range(3)], names=["bundle", "path", "rule_id"])


def scan(files: DataFrame) -> DataFrame:
    """The findings of files (bundle, path, text, kind)."""
    files = files.select("bundle", "path", "text", "kind")
    size, valid = F.octet_length(F.coalesce("text", F.lit(""))), F.expr("is_valid_utf8(coalesce(text, ''))")
    why = (
        F.when(F.col("kind") == "unknown", F.lit("UNKNOWN_FILE_TYPE")).when(size > rules.LARGE_BYTES, F.lit("LARGE_TEXT_FILE")).when(~valid, F.lit("NON_UTF8_TEXT"))
    )
    whole = files.select("bundle", "path", F.lit(1).alias("line"), why.alias("rule_id")).filter("rule_id IS NOT NULL")
    odd_paths = files.select("bundle", "path").filter(F.rlike("path", F.lit(r"[^\x00-\x7F]"))).mapInArrow(_path_findings, "bundle string, path string, rule_id string")
    text_lines = lines(files.filter((F.col("kind") != "unknown") & (size <= rules.LARGE_BYTES) & valid))
    plain = _rules_of(text_lines.withColumn("raw", F.lit(True))).select("bundle", "path", "line", "ids")

    seen = text_lines.filter(_may_hold_more()).select("bundle", "path", "kind", "line", "line_text", "longer", "following").mapInArrow(_examined, _OUT)
    # Rows without a name of a reference keep to their own line.
    name = Window.partitionBy("bundle", "path", F.coalesce("ref", F.concat(F.lit("\n"), F.col("line"))))
    real = F.min_by("host", F.when(F.col("what") == "definition", F.col("line"))).over(name)
    seen = _rules_of(seen.withColumn("real", real).withColumn("line_text", F.when(F.col("what") == "text", F.col("text")).otherwise("")).withColumn("longer", F.lit(None).cast("string")))
    spoofs = (F.col("what") == "usage") & (F.col("real") != F.col("host"))
    ids = F.when(F.col("what") == "text", F.col("ids")).when(F.col("what") == "hit", F.array("text")).when(spoofs, F.array(F.lit("LINK_SPOOFING_URL_MISMATCH")))
    hits = plain.union(seen.select("bundle", "path", "line", ids.alias("ids")))
    # OUTER: else Spark tests the array's size below the explode, with every expression once more.
    hits = hits.select("bundle", "path", "line", F.explode_outer("ids").alias("rule_id")).filter("rule_id IS NOT NULL")
    every = hits.union(whole).union(odd_paths.select("bundle", "path", F.lit(1), "rule_id")).distinct()
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return every.withColumn("severity", severity[F.col("rule_id")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dialect(sf_dir)
    return spark.sql(f"WITH {bundles.files(d)} SELECT bundle, path, text, kind FROM files")


def q_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(files_of(spark, sf_dir))


def report(files: DataFrame, reject: tuple[str, ...] = rules.REJECTED) -> DataFrame:
    """A row a bundle: files, findings by severity, score, and the decision that a policy takes on them."""
    found = scan(files)
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("critical", "high", "medium", "low")]
    by = found.groupBy("bundle").agg(*counts, F.count(F.when(F.col("severity").isin(*reject), 1)).alias("bad"))
    own = files.groupBy("bundle").agg(F.count("*").alias("n_files"))
    joined = own.join(by.withColumnRenamed("bundle", "of"), F.col("bundle").eqNullSafe(F.col("of")), "left").drop("of")
    zero = joined.fillna(0, ["critical", "high", "medium", "low", "bad"])
    return zero.withColumn("decision", F.when(F.col("bad") > 0, F.lit("REJECTED")).otherwise("PASS")).drop("bad")


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(files_of(spark, sf_dir))


QUERIES = {"scan_findings": q_scan, "scan_report": q_report}
