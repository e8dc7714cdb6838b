"""Lock verification: eight checks a skill over its lock, its install report, its source metadata and its files.

Documents are JSON texts, one row a skill. Each check is a list of (fault, detail) in order, of which the first
that holds is the result: a coalesce over conditions, so a skill is verified in one projection. Files meet the
lock's list in a full outer join on (skill, path). Only a skill's own files are ever gathered, for its root hash.

Defined results: a lock that is missing or no JSON of its shape gives one row READ_LOCKFILE or INVALID_LOCKFILE in
place of the checks; fields that are left out count as empty or 0, as do nulls; a skill without files has the hash of no
text; rows of one skill are judged each by itself; an empty table has no checks.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.functions.dialect import java_regex
from lakesift.operators import scan

#: Names of versions, checks and what texts must not hold.
LOCK_VERSION, REPORT_VERSION, SOURCE_VERSION = "lock/v1", "report/v1", "source/v1"
CODES = ("LOCK_SCHEMA", "SKILL_NAME", "LOCK_STRUCTURE", "LOCK_SOURCE", "SOURCE_METADATA", "INSTALL_REPORT", "FILE_DIGESTS", "ROOT_HASH")
CONTROL = r"[\x00-\x1F\x7F-\x{9F}]"
HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{2028}\x{2029}\x{FE00}-\x{FE0F}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
PROFILES = ("strict", "team", "research")
SEVERITIES = ("critical", "high", "medium", "low")
TIME = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
SHA = r"^[0-9a-f]{64}$"
COMMIT = r"^[0-9a-f]{40}$"
GITHUB = r"^github:([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)/([A-Za-z0-9._-]+)((?:/[^@/]+)*)@([^@\s]+)$"
BAD_PATH = rf"^$|^/|^[A-Za-z]:|\\|//|(?:^|/)\.{{1,2}}(?:/|$)|/$|^\s|\s$|{CONTROL}|{HIDDEN}"

_OVERRIDES = "severity_overrides array<struct<rule_id:string,previous_severity:string,effective_severity:string,reason:string>>"
_COUNTS = ", ".join(f"{s} bigint" for s in SEVERITIES)
LOCK = (
    "schema string, name string, installed_at string, source struct<type:string,input:string,kind:string>,"
    " skill struct<root_sha256:string,files:array<struct<path:string,sha256:string,bytes:bigint>>>,"
    f" policy struct<profile:string,decision:string,{_OVERRIDES.replace(' ', ':', 1)}>, findings struct<{_COUNTS.replace(' bigint', ':bigint')}>, bad string"
)
REPORT = (
    "schema_version string, source struct<input:string,kind:string>, policy_profile string, decision string, installed boolean, installed_path string,"
    f" findings array<struct<id:string,severity:string>>, {_OVERRIDES}, bad string"
)
SOURCE = "schema string, source_input string, source_kind string, resolved_ref string, fetched_at string, skill_root_sha256 string, bad string"

Faults = list[tuple[Column, Column | str]]


def _has(x: Column, pattern: str) -> Column:
    return F.rlike(x, F.lit(java_regex(pattern)))


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def text_faults(x: Column, label: str, empty: bool = True, lower: bool = False) -> Faults:
    """What no field may be: with control or hidden characters, empty, spaced at its ends, and on demand not in lower case."""
    out: Faults = [
        (_has(x, CONTROL), f"{label} must not contain C0/C1 control characters"),
        (_has(x, HIDDEN), f"{label} must not contain Unicode bidi, zero-width, tag, or variation-selector characters"),
    ]
    if empty:
        out.append((_bare(x) == "", f"{label} is empty"))
    out.append((_bare(x) != x, f"{label} must not contain leading or trailing whitespace"))
    if lower:
        out.append((F.lower(x) != x, f"{label} must be canonical lowercase"))
    return out


def first(faults: Faults) -> Column:
    """The detail of the first fault that holds, or null."""
    return F.coalesce(*[F.when(test, F.lit(text) if isinstance(text, str) else text) for test, text in faults])


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def source_kind(x: Column) -> Column:
    low = F.lower(x)
    tar = functools.reduce(lambda a, b: a | b, [F.endswith(low, F.lit(e)) for e in (".tar", ".tar.gz", ".tgz")])
    return F.when(F.startswith(x, F.lit("github:")), F.lit("github-source")).when(F.endswith(low, F.lit(".zip")), F.lit("zip")).when(tar, F.lit("tar")).otherwise("local-dir")


def source_type(kind: Column) -> Column:
    return F.when(kind == "github-source", F.lit("github")).when(kind.isin("zip", "tar"), F.lit("archive")).when(kind == "local-dir", F.lit("local")).otherwise("unknown")


def canonical_github(x: Column) -> Column:
    """github:owner/repo[/path]@ref with owner and repo in lower case."""
    part = lambda k: F.regexp_extract(x, GITHUB, k)
    return F.concat(F.lit("github:"), F.lower(part(1)), F.lit("/"), F.lower(part(2)), part(3), F.lit("@"), part(4))


def _override_faults(x: Column, label: str) -> Faults:
    """Overrides lower high to medium, once a rule, with a reason."""
    each = lambda test: F.exists(F.coalesce(x, F.array().cast("array<struct<rule_id:string,previous_severity:string,effective_severity:string,reason:string>>")), test)
    ids = F.transform(x, lambda o: o["rule_id"])
    return [
        (each(lambda o: ~F.coalesce(_has(o["rule_id"], r"^[A-Z][A-Z0-9_]*$"), F.lit(False))), f"{label} severity_overrides is invalid: rule id"),
        (each(lambda o: ~o["previous_severity"].eqNullSafe(F.lit("high")) | ~o["effective_severity"].eqNullSafe(F.lit("medium"))), f"{label} severity_overrides is invalid: severity"),
        (each(lambda o: _bare(_text(o["reason"])) == ""), f"{label} severity_overrides is invalid: reason"),
        (F.size(F.array_distinct(ids)) < F.size(ids), f"{label} severity_overrides is invalid: duplicate"),
    ]


def structure_faults(lock: Column) -> Faults:
    name, at, profile, decision = (_text(x) for x in (lock["name"], lock["installed_at"], lock["policy"]["profile"], lock["policy"]["decision"]))
    files = F.coalesce(lock["skill"]["files"], F.array().cast("array<struct<path:string,sha256:string,bytes:bigint>>"))
    faults = [*text_faults(name, "lock name"), *text_faults(at, "lock installed_at"), (~_has(at, TIME), "lock installed_at must be RFC3339")]
    own = text_faults(profile, "lock policy profile")
    faults += [own[0], own[1], own[2], (F.lower(_bare(profile)) != profile, "lock policy profile must be canonical lowercase without surrounding whitespace")]
    faults += [(~profile.isin(*PROFILES), F.concat(F.lit("lock policy profile is unsupported: "), profile)), *text_faults(decision, "lock policy decision", empty=False)]
    faults.append((decision != "pass", F.concat(F.lit("lock policy decision must be canonical lowercase pass for installed skill, got "), decision)))
    faults += _override_faults(lock["policy"]["severity_overrides"], "lock policy")
    faults += [(F.coalesce(lock["findings"][s], F.lit(0)) < 0, f"lock findings summary is invalid: {s} count must be >= 0") for s in SEVERITIES]
    faults += [(~_has(_text(lock["skill"]["root_sha256"]), SHA), "lock skill root_sha256 must be a canonical lowercase 64-char hex digest"), (F.size(files) == 0, "lock skill files is empty")]
    paths = F.transform(files, lambda f: _text(f["path"]))
    one = F.transform(
        files,
        lambda f, i: first(
            [
                (_bare(_text(f["path"])) == "", "lock file path is empty"),
                (_has(_text(f["path"]), BAD_PATH), F.concat(F.lit("lock file path is invalid: "), _text(f["path"]))),
                (F.array_position(paths, _text(f["path"])) <= i, F.concat(F.lit("duplicate lock file path: "), f["path"])),
                (~_has(_text(f["sha256"]), SHA), F.concat(F.lit("lock file sha256 is invalid: "), f["path"])),
                (f["bytes"] < 0, F.concat(F.lit("lock file bytes is negative: "), f["path"])),
            ]
        ),
    )
    worst = F.get(F.filter(one, lambda x: x.isNotNull()), 0)
    return [*faults, (worst.isNotNull(), worst)]


def source_faults(lock: Column) -> Faults:
    kind, given, type_ = (_text(lock["source"][x]) for x in ("kind", "input", "type"))
    wanted, github = source_type(kind), kind == "github-source"
    return [
        *text_faults(kind, "lock source kind", lower=True), *text_faults(given, "lock source input"),
        (kind != source_kind(given), F.concat(F.lit("lock source kind does not match source input: kind="), kind, F.lit(" detected="), source_kind(given))),
        (~github & _has(given, r"//|(?:^|/)\.(?:/|$)|[^/]/\.\.(?:/|$)|./$"), "lock source input must be a canonical cleaned path for local/archive sources"),
        *text_faults(type_, "lock source type", lower=True),
        (type_ != wanted, F.concat(F.lit("source type mismatch for kind "), kind, F.lit(": expected "), wanted, F.lit(", got "), type_)),
        (github & ~_has(given, GITHUB), "invalid github source input in lock"), (github & (given != canonical_github(given)), "github lock source input must be canonical"),
        (github & ~_has(F.regexp_extract(given, GITHUB, 4), COMMIT), "github lock source must be commit-pinned"),
    ]


def _metadata(lock: Column, meta: Column, root: Column) -> Faults:
    """Only skills from a repository have metadata to verify."""
    schema, given, kind, ref, at, sha = (_text(meta[x]) for x in ("schema", "source_input", "source_kind", "resolved_ref", "fetched_at", "skill_root_sha256"))
    own = lambda name: f"source metadata {name}"
    spec = F.regexp_extract(given, GITHUB, 4)
    faults: Faults = [
        (meta.isNull(), "missing source metadata"), (meta["bad"].isNotNull(), "invalid source metadata JSON"), *text_faults(schema, own("schema"), empty=False),
        (schema != SOURCE_VERSION, F.concat(F.lit("unsupported source metadata schema: "), schema)), *text_faults(given, own("source_input")), *text_faults(kind, own("source_kind"), lower=True),
        (kind != "github-source", F.concat(F.lit("source metadata source_kind is unsupported: "), kind)), (~_has(given, GITHUB), "source metadata has invalid github source input"),
        (given != canonical_github(given), "source metadata source_input must be canonical"), (~_has(spec, COMMIT), "source metadata requires commit-pinned github ref"),
        *text_faults(ref, own("resolved_ref"), lower=True), (~_has(ref, COMMIT), "source metadata resolved_ref must be commit-pinned"), (spec != ref, "source metadata resolved_ref does not match source_input ref"),
        *text_faults(at, own("fetched_at")), (~_has(at, TIME), "source metadata fetched_at must be RFC3339"), *text_faults(sha, own("skill_root_sha256")),
        (~_has(sha, SHA), "source metadata skill_root_sha256 must be a canonical lowercase 64-char hex digest"),
        ((given != _text(lock["source"]["input"])) | (kind != _text(lock["source"]["kind"])), "source metadata mismatch with lock source"), (sha != root, "installed source metadata hash mismatch"),
    ]
    github = lock["source"]["kind"].eqNullSafe(F.lit("github-source"))
    return [(github & test, text) for test, text in faults]


def _report(lock: Column, report: Column, home: Column) -> Faults:
    version, given, kind, profile, decision, at = (_text(x) for x in (report["schema_version"], report["source"]["input"], report["source"]["kind"], report["policy_profile"], report["decision"], report["installed_path"]))
    own = lambda name: f"install report {name}"
    found = F.transform(F.coalesce(report["findings"], F.array().cast("array<struct<id:string,severity:string>>")), lambda f: f["severity"])
    counts = [F.size(found) - F.size(F.array_remove(found, s)) != F.coalesce(lock["findings"][s], F.lit(0)) for s in SEVERITIES]
    ordered = lambda x: F.coalesce(F.array_sort(x), F.array().cast("array<struct<rule_id:string,previous_severity:string,effective_severity:string,reason:string>>"))
    return [
        (report.isNull(), "failed to read install report"), (report["bad"].isNotNull(), "invalid install report JSON"), *text_faults(version, own("schema_version")),
        (version != REPORT_VERSION, F.concat(F.lit("install report schema_version is unsupported: "), version)), *text_faults(given, own("source input")), *text_faults(kind, own("source kind")),
        ((given != _text(lock["source"]["input"])) | (kind != _text(lock["source"]["kind"])), "install report source does not match lock source"), *text_faults(profile, own("policy profile")),
        (F.lower(profile) != profile, "install report policy profile must be canonical lowercase without surrounding whitespace"),
        (profile != _text(lock["policy"]["profile"]), "install report policy profile does not match lock policy"), *text_faults(decision, own("decision")),
        (F.lower(decision) != F.lower(_text(lock["policy"]["decision"])), "install report decision does not match lock policy decision"), *_override_faults(report["severity_overrides"], "install report"),
        (ordered(report["severity_overrides"]) != ordered(lock["policy"]["severity_overrides"]), "install report severity_overrides does not match lock policy severity_overrides"),
        (F.lower(decision) != "pass", "install report decision must be pass for installed skill"), (~F.coalesce(report["installed"], F.lit(False)), "install report installed must be true"),
        *text_faults(at, own("installed path")), (F.regexp_replace(at, "(?<=.)/+$", "") != home, F.concat(F.lit("install report path mismatch: expected "), home, F.lit(", got "), at)),
        (functools.reduce(lambda a, b: a | b, counts), "install report findings summary does not match lock findings"),
    ]


def root_hash(files: Column) -> Column:
    """The digest of (path, sha256 ...) structs in the order of their paths."""
    zero = F.lit("\0")
    return F.sha2(F.array_join(F.transform(F.array_sort(files), lambda f: F.concat(f["path"], zero, f["sha256"], zero)), ""), 256)


def drift(locked: DataFrame, files: DataFrame) -> DataFrame:
    """(skill, missing, changed, unexpected): counts of a full outer join of the lock's list with the files."""
    old = locked.select("skill", F.explode("listed").alias("f")).select("skill", F.col("f.path").alias("path"), F.col("f.sha256").alias("old_sha"), F.coalesce("f.bytes", F.lit(0)).alias("old_bytes"))
    new = files.select("skill", "path", F.col("sha256").alias("new_sha"), F.col("bytes").alias("new_bytes")).join(locked.select("skill").distinct(), "skill", "left_semi")
    both = old.join(new, ["skill", "path"], "full_outer")
    gone, come = F.col("new_sha").isNull(), F.col("old_sha").isNull() & F.col("old_bytes").isNull()
    differs = ~gone & ~come & ((F.coalesce("old_sha", F.lit("")) != F.col("new_sha")) | (F.col("old_bytes") != F.col("new_bytes")))
    return both.groupBy("skill").agg(*[F.count(F.when(test, 1)).alias(name) for name, test in (("missing", gone), ("changed", differs), ("unexpected", come))])


def verify(skills: DataFrame, files: DataFrame) -> DataFrame:
    """(skill, nth, code, ok, detail): skills are (skill, home, lock, report, metadata), files (skill, path, sha256, bytes)."""
    options = {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}
    parsed = skills.select(
        "skill", "home", F.col("lock").alias("raw"), F.from_json("lock", LOCK, options).alias("lock"), F.from_json("report", REPORT, options).alias("report"), F.from_json("metadata", SOURCE, options).alias("meta")
    ).withColumn("listed", F.col("lock.skill.files"))
    root = files.groupBy("skill").agg(root_hash(F.collect_list(F.struct("path", "sha256"))).alias("root"))
    full = parsed.join(root, "skill", "left").join(drift(parsed, files), "skill", "left").withColumn("root", F.coalesce("root", F.sha2(F.lit(""), 256)))
    lock, home, root_ = F.col("lock"), F.regexp_replace("home", "(?<=.)/+$", ""), F.col("root")
    base, name, schema = F.regexp_extract(home, "[^/]*$", 0), _text(lock["name"]), _text(lock["schema"])
    counted = F.concat(*[x for c in ("missing", "changed", "unexpected") for x in (F.lit(f" {c}=" if c != "missing" else "missing="), F.coalesce(F.col(c), F.lit(0)).cast("string"))])
    drifted = functools.reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in ("missing", "changed", "unexpected")]) > 0
    schema_detail = first([*text_faults(schema, "lock schema", empty=False), (F.lit(True), F.concat(F.lit(f"expected {LOCK_VERSION}, got "), schema))])
    sha = _text(lock["skill"]["root_sha256"])
    details = [
        F.when(schema != LOCK_VERSION, schema_detail), F.when(name != base, F.concat(F.lit("expected "), base, F.lit(", got "), name)), first(structure_faults(lock)), first(source_faults(lock)),
        first(_metadata(lock, F.col("meta"), root_)), first(_report(lock, F.col("report"), home)), F.when(drifted, counted), F.when(sha != root_, F.concat(F.lit("expected "), sha, F.lit(", got "), root_)),
    ]
    checks = F.array(*[F.struct(F.lit(k + 1).alias("nth"), F.lit(CODES[k]).alias("code"), d.isNull().alias("ok"), d.alias("detail")) for k, d in enumerate(details)])
    broken = lambda code, why: F.array(F.struct(F.lit(0).alias("nth"), F.lit(code).alias("code"), F.lit(False).alias("ok"), F.lit(why).alias("detail")))
    rows = F.when(F.col("raw").isNull(), broken("READ_LOCKFILE", "failed to read lockfile")).when(lock.isNull() | lock["bad"].isNotNull(), broken("INVALID_LOCKFILE", "invalid lockfile JSON")).otherwise(checks)
    return full.select("skill", F.explode_outer(rows).alias("c")).select("skill", "c.*")


def status(checks: DataFrame) -> DataFrame:
    """(skill, failed, status) of verified skills; ERROR where there is no lock to verify."""
    by = checks.groupBy("skill").agg(F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.min("nth").alias("least"))
    return by.select("skill", "failed", F.when(F.col("least") == 0, F.lit("ERROR")).when(F.col("failed") == 0, F.lit("VERIFIED")).otherwise("DRIFTED").alias("status"))


#: Faults that the installed skills of the documents have, by the rest of their number; 0 and 15 have none.
N_FAULTS = 24
FAULTS = {
    1: [("LOCK_SCHEMA", f"expected {LOCK_VERSION}, got lock/v0")], 2: [("SKILL_NAME", None)],
    3: [("LOCK_STRUCTURE", "lock installed_at must be RFC3339")], 4: [("LOCK_STRUCTURE", "lock policy profile must be canonical lowercase without surrounding whitespace"), ("INSTALL_REPORT", "install report policy profile must be canonical lowercase without surrounding whitespace")],
    5: [("LOCK_STRUCTURE", "lock file path is invalid: ../up.md"), ("FILE_DIGESTS", "missing=1 changed=0 unexpected=0")], 6: [("LOCK_STRUCTURE", "duplicate lock file path: same.md"), ("FILE_DIGESTS", "missing=2 changed=0 unexpected=0")],
    7: [("LOCK_SOURCE", "lock source kind does not match source input: kind=zip detected=github-source"), ("INSTALL_REPORT", "install report source does not match lock source")],
    8: [("LOCK_SOURCE", "github lock source must be commit-pinned"), ("SOURCE_METADATA", "source metadata requires commit-pinned github ref")],
    9: [("SOURCE_METADATA", "missing source metadata")], 10: [("INSTALL_REPORT", "install report decision does not match lock policy decision")],
    11: [("INSTALL_REPORT", "install report findings summary does not match lock findings")], 12: [("FILE_DIGESTS", "missing=0 changed=1 unexpected=0"), ("ROOT_HASH", None), ("SOURCE_METADATA", "installed source metadata hash mismatch")],
    13: [("FILE_DIGESTS", "missing=0 changed=0 unexpected=1"), ("ROOT_HASH", None), ("SOURCE_METADATA", "installed source metadata hash mismatch")], 14: [("ROOT_HASH", None)],
    16: [("LOCK_STRUCTURE", "lock name must not contain Unicode bidi, zero-width, tag, or variation-selector characters"), ("SKILL_NAME", None)],
    17: [("INVALID_LOCKFILE", "invalid lockfile JSON")], 18: [("INSTALL_REPORT", "invalid install report JSON")], 19: [("LOCK_STRUCTURE", "lock policy severity_overrides is invalid: reason"), ("INSTALL_REPORT", "install report severity_overrides does not match lock policy severity_overrides")],
    20: [("INSTALL_REPORT", "install report installed must be true")], 21: [("SOURCE_METADATA", "source metadata resolved_ref does not match source_input ref")],
    22: [("LOCK_STRUCTURE", "lock findings summary is invalid: high count must be >= 0"), ("INSTALL_REPORT", "install report findings summary does not match lock findings")],
}
SKILL_DOCS = 10  # documents of one skill at most


def installed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Skills of SKILL_DOCS documents with their locks, reports and metadata, faults put in by rule; and their files."""
    docs = scan.table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    number = F.floor(F.col("doc_id") / SKILL_DOCS)
    files = docs.select(
        F.concat(F.lit("skill-"), number.cast("string")).alias("skill"), number.alias("number"), F.concat(F.lit("references/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"),
    ).distinct()
    k = F.col("number") % N_FAULTS
    own = files.groupBy("skill", "number").agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "bytes"))).alias("listed"))
    at = lambda n, yes, no: F.when(k == n, yes).otherwise(no)
    root = root_hash(F.col("listed"))
    extra = lambda *paths: F.array(*[F.struct(F.lit(p).alias("path"), F.lit("0" * 64).alias("sha256"), F.lit(0).cast("long").alias("bytes")) for p in paths])
    changed = F.transform("listed", lambda f, i: F.struct(f["path"].alias("path"), F.when(i == 0, F.lit("1" * 64)).otherwise(f["sha256"]).alias("sha256"), f["bytes"].alias("bytes")))
    shown = F.when(k == 5, F.concat("listed", extra("../up.md"))).when(k == 6, F.concat("listed", extra("same.md", "same.md"))).when(k == 12, changed).when(k == 13, F.slice("listed", 2, 2**30)).otherwise(F.col("listed"))
    commit = F.substring(F.sha2("skill", 256), 1, 40)
    given = F.concat(F.lit("github:owner/repo/"), F.col("skill"), F.lit("@"), at(8, F.lit("main"), commit))
    bent = F.when(k.isin(12, 13), root_hash(shown)).otherwise(at(14, F.lit("2" * 64), root))
    why = F.array(F.struct(F.lit("RAW_IP_URL").alias("rule_id"), F.lit("high").alias("previous_severity"), F.lit("medium").alias("effective_severity"), F.lit(" ").alias("reason")))
    lock = F.to_json(
        F.struct(
            at(1, F.lit("lock/v0"), F.lit(LOCK_VERSION)).alias("schema"), F.when(k == 2, F.lit("other")).when(k == 16, F.concat("skill", F.lit("​"))).otherwise(F.col("skill")).alias("name"),
            at(3, F.lit("2026-13-01 10:00"), F.lit("2026-01-02T03:04:05Z")).alias("installed_at"),
            F.struct(F.when(k == 7, F.lit("archive")).otherwise("github").alias("type"), given.alias("input"), at(7, F.lit("zip"), F.lit("github-source")).alias("kind")).alias("source"),
            F.struct(bent.alias("root_sha256"), shown.alias("files")).alias("skill"),
            F.struct(at(4, F.lit("Team"), F.lit("team")).alias("profile"), F.lit("pass").alias("decision"), F.when(k == 19, why).alias("severity_overrides")).alias("policy"),
            F.struct(F.lit(0).alias("critical"), at(22, F.lit(-1), F.lit(1)).alias("high"), F.lit(0).alias("medium"), F.lit(0).alias("low")).alias("findings"),
        )
    )
    found = at(11, F.lit("medium"), F.lit("high"))
    report = F.to_json(
        F.struct(
            F.lit(REPORT_VERSION).alias("schema_version"), F.struct(given.alias("input"), F.lit("github-source").alias("kind")).alias("source"), at(4, F.lit("Team"), F.lit("team")).alias("policy_profile"),
            at(10, F.lit("reject"), F.lit("pass")).alias("decision"), (k != 20).alias("installed"), F.concat(F.lit("/skills/"), F.col("skill")).alias("installed_path"),
            F.array(F.struct(F.lit("RAW_IP_URL").alias("id"), found.alias("severity"))).alias("findings"),
        )
    )
    metadata = F.to_json(
        F.struct(
            F.lit(SOURCE_VERSION).alias("schema"), given.alias("source_input"), F.lit("github-source").alias("source_kind"), F.when(k == 8, F.lit("main")).when(k == 21, F.sha1("skill")).otherwise(commit).alias("resolved_ref"),
            F.lit("2026-01-02T03:04:05Z").alias("fetched_at"), F.when(k.isin(12, 13), root_hash(shown)).otherwise(root).alias("skill_root_sha256"),
        )
    )
    skills = own.select(
        "skill", F.concat(F.lit("/skills/"), F.col("skill")).alias("home"), at(17, F.lit('{"schema": '), lock).alias("lock"), at(18, F.lit("[1]"), report).alias("report"), F.when(k != 9, metadata).alias("metadata"), "number"
    )
    return skills, files


def q_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every skill; details where they don't hold digests or names."""
    skills, files = installed(spark, sf_dir)
    bare = F.col("code").isin("ROOT_HASH", "SKILL_NAME")
    return verify(skills, files).select("skill", F.col("nth").cast("long").alias("nth"), "code", "ok", F.when(~bare, F.col("detail")).alias("detail"))


def q_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status(verify(*installed(spark, sf_dir)))


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


#: What each fault has to show, stated by hand; nothing is parsed or verified here.
_EXPECTED = ", ".join(f"({k}, {_quoted(code)}, {_quoted(None if code in ('ROOT_HASH', 'SKILL_NAME') else text)})" for k, faults in FAULTS.items() for code, text in faults)
_CHECKS = ", ".join(f"({k + 1}, '{c}')" for k, c in enumerate(CODES))
_VERIFIED = f"""
WITH skills AS (SELECT DISTINCT doc_id // {SKILL_DOCS} AS number FROM documents WHERE doc_id IS NOT NULL),
faults(k, code, detail) AS (VALUES {_EXPECTED}), checks(nth, code) AS (VALUES {_CHECKS}),
rows_ AS (
  SELECT number, nth, code FROM skills, checks WHERE number % {N_FAULTS} NOT IN (SELECT k FROM faults WHERE code = 'INVALID_LOCKFILE')
  UNION ALL SELECT number, 0, code FROM skills JOIN faults ON number % {N_FAULTS} = k WHERE code = 'INVALID_LOCKFILE'),
verified AS (
  SELECT 'skill-' || number AS skill, nth::BIGINT AS nth, r.code, f.k IS NULL AS ok, f.detail
  FROM rows_ r LEFT JOIN faults f ON number % {N_FAULTS} = f.k AND r.code = f.code)"""
ORACLE_SQL = {
    "lock_verify": f"{_VERIFIED} SELECT * FROM verified",
    "lock_status": f"""{_VERIFIED} SELECT skill, count(*) FILTER (NOT ok) AS failed,
  CASE WHEN min(nth) = 0 THEN 'ERROR' WHEN bool_and(ok) THEN 'VERIFIED' ELSE 'DRIFTED' END AS status FROM verified GROUP BY skill""",
}
QUERIES = {"lock_verify": q_verify, "lock_status": q_status}
