"""Update evaluation: what a skill's source holds now against what its lock says, one row a skill.

A chain of steps decides each skill: the lock, the source, fresh findings under the lock's policy, and the changes.
The first step that fails is the row's status, code and message; the later ones count nothing then. Findings,
addresses, scripts and files are each compared by aggregation or set difference on (skill, key), so no skill is gathered
anywhere but in the counts of its own row.

Defined results: a lock that can't be read is LOCKFILE_INVALID, a skill without current files SOURCE_PREPARE_FAILED;
a failed skill has the risk that its lock tells and no change; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.functions.dialect import Dialect
from lakesift.operators import lock, rules, scan
from lakesift.sources import bundles

#: Weights of severities, weights and caps of signals, and what profiles reject.
WEIGHTS = {"critical": 100, "high": 25, "medium": 7, "low": 2}
SIGNALS = {"new_urls": (6, 60), "new_execs": (15, 90), "file_delta": (2, 60), "overrides_removed": (-6, 30)}
REJECTS = {"strict": rules.REJECTED, "team": rules.REJECTED, "research": ("critical",)}
DELTAS = [f"delta_{s}" for s in WEIGHTS]
COUNTS = ("added", "removed", "changed", "new_urls", "new_execs", "overrides_removed")


def _new_values(now: DataFrame, then: DataFrame, name: str) -> DataFrame:
    """(skill, name): how many values a skill has now that it did not have."""
    return now.distinct().join(then.distinct(), ["skill", "value"], "left_anti").groupBy("skill").agg(F.count("*").alias(name))


def _addresses(files: DataFrame) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(bundles.URL), F.lit(0))
    return files.select("skill", F.explode_outer(found).alias("value")).filter("value IS NOT NULL")


def _scripts(files: DataFrame) -> DataFrame:
    """Files that can be run: scripts by their suffix, and texts that begin with an interpreter's line."""
    starts = F.rlike(F.substring(F.coalesce("text", F.lit("")), 1, 256), F.lit(r"^\x{FEFF}?[ \t]*#!"))
    return files.filter((F.col("kind") == "script") | starts).select("skill", F.col("path").alias("value"))


def with_kinds(files: DataFrame) -> DataFrame:
    return files.withColumn("kind", F.expr(bundles.kind_of(Dialect(), "path")))


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that what follows has a plan of its own; as it is where no folder is named."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if (folder := spark.conf.get("spark.checkpoint.dir", None)) is None:
            return df
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def _fresh(current: DataFrame, policies: DataFrame) -> DataFrame:
    """(skill, counts by severity, rejected, active): findings now, high ones lowered where the lock's policy lowers them."""
    found = scan.scan(current.select(F.col("skill").alias("bundle"), "path", "text", "kind")).withColumnRenamed("bundle", "skill")
    found = cut(found.select("skill", "rule_id", "severity"))
    lowered = policies.select("skill", F.explode("configured").alias("rule_id")).withColumn("active", F.lit(True))
    judged = found.join(lowered, ["skill", "rule_id"], "left").join(policies.select("skill", "profile"), "skill", "left")
    effective = F.when(F.col("active") & (F.col("severity") == "high"), F.lit("medium")).otherwise(F.col("severity"))
    rejects = F.lit(False)
    for profile, severities in REJECTS.items():
        rejects = rejects | ((F.col("profile") == profile) & effective.isin(*severities))
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(f"now_{s}") for s in WEIGHTS]
    return judged.groupBy("skill").agg(*counts, F.max(rejects).alias("rejects"), F.count_distinct(F.when(F.col("active"), F.col("rule_id"))).alias("active"))


def _failure() -> Column:
    """The first of the steps before the findings that fails, as (status, error_code, message); null if none does."""
    def step(test: Column, status: str, code: str, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(test, F.struct(F.lit(status).alias("status"), F.lit(code).alias("error_code"), text.alias("message")))

    parsed, given = F.col("lock"), F.coalesce("lock.source.input", F.lit(""))
    structure, source = lock.first(lock.structure_faults(parsed)), lock.first(lock.source_faults(parsed))
    github = F.coalesce(F.col("lock.source.kind") == "github-source", F.lit(False))
    pinned = F.rlike(F.regexp_extract(given, lock.GITHUB, 4), F.lit(lock.COMMIT))
    return F.coalesce(
        step(F.col("raw").isNull(), "ERROR", "LOCKFILE_INVALID", "failed to read lockfile"), step(parsed.isNull() | F.col("lock.bad").isNotNull(), "ERROR", "LOCKFILE_INVALID", "invalid lockfile JSON"),
        step(~F.coalesce(F.col("lock.schema") == lock.LOCK_VERSION, F.lit(False)), "ERROR", "LOCKFILE_INVALID", "lock schema is unsupported"), step(structure.isNotNull(), "ERROR", "LOCKFILE_INVALID", structure),
        step(github & ~F.rlike(given, F.lit(lock.GITHUB)), "ERROR", "GITHUB_SOURCE_INVALID", "invalid github source input in lock"), step(github & ~pinned, "REJECTED", "GITHUB_REF_NOT_PINNED", "github source must be commit-pinned"),
        step(source.isNotNull(), "ERROR", "LOCKFILE_INVALID", source), step(F.col("n_current").isNull(), "ERROR", "SOURCE_PREPARE_FAILED", "update source holds no files"),
    )


def evaluate(skills: DataFrame, installed: DataFrame, current: DataFrame) -> DataFrame:
    """skills (skill, lock); installed and current files (skill, path, text)."""
    options = {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}
    skills = cut(skills.select("skill", "lock"))
    parsed = skills.select("skill", F.col("lock").alias("raw"), F.from_json("lock", lock.LOCK, options).alias("lock"))
    current, installed = with_kinds(current), with_kinds(installed)
    ids = F.transform("lock.policy.severity_overrides", lambda o: o["rule_id"])
    policies = parsed.select("skill", F.coalesce("lock.policy.profile", F.lit("")).alias("profile"), F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))).alias("configured"))
    digests = current.select("skill", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    listed = parsed.select("skill", F.col("lock.skill.files").alias("listed"))
    full = parsed
    for part in (
        current.groupBy("skill").agg(F.count("*").alias("n_current")), lock.drift(listed, digests), _new_values(_addresses(current), _addresses(installed), "new_urls"),
        _new_values(_scripts(current), _scripts(installed), "new_execs"), _fresh(current, policies), policies.select("skill", F.size("configured").alias("configured")),
    ):
        full = full.join(cut(part), "skill", "left")
    full = full.withColumn("failure", _failure())
    good = F.col("failure").isNull()
    count = lambda x: F.when(good, F.coalesce(x, F.lit(0))).otherwise(0).cast("long")
    then = {s: F.coalesce(F.col(f"lock.findings.{s}"), F.lit(0)) for s in WEIGHTS}
    out = full.withColumns({
        "added": count(F.col("unexpected")), "removed": count(F.col("missing")), "changed": count(F.col("changed")), "new_urls": count(F.col("new_urls")), "new_execs": count(F.col("new_execs")),
        "overrides_removed": count(F.col("configured") - F.coalesce(F.col("active"), F.lit(0))), **{f"delta_{s}": count(F.coalesce(F.col(f"now_{s}"), F.lit(0)) - then[s]) for s in WEIGHTS},
        "risk_previous": sum((then[s] * w for s, w in WEIGHTS.items()), F.lit(0)).cast("long"),
    })
    out = out.withColumn("file_delta", F.col("added") + F.col("removed") + F.col("changed"))
    signals = sum((F.greatest(F.least(F.col(n) * w, F.lit(cap)), F.lit(-cap)) for n, (w, cap) in SIGNALS.items()), F.lit(0)).cast("long")
    out = out.withColumn("risk_signals", signals).withColumn("risk_delta", F.col("risk_signals") + sum((F.col(f"delta_{s}") * w for s, w in WEIGHTS.items()), F.lit(0)).cast("long"))
    moved = F.lit(False)
    for c in (*COUNTS, *DELTAS):
        moved = moved | (F.col(c) != 0)
    end = lambda status, code, message: F.struct(F.lit(status).alias("status"), F.lit(code).alias("error_code"), F.lit(message).alias("message"))
    last = (
        F.when(F.col("rejects"), end("REJECTED", "POLICY_REJECTED", "fresh policy evaluation rejected update source"))
        .when(moved, end("CHANGED", "SOURCE_CHANGED", "update source differs from installed lock snapshot"))
        .otherwise(end("UP_TO_DATE", "UP_TO_DATE", "no change detected against installed lock snapshot"))
    )
    return out.withColumn("end", F.coalesce("failure", last)).select("skill", "end.*", *COUNTS, *DELTAS, "risk_previous", (F.col("risk_previous") + F.col("risk_delta")).alias("risk_current"), "risk_delta", "risk_signals")


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: skills by status."""
    states = {"up_to_date": "UP_TO_DATE", "changed": "CHANGED", "rejected": "REJECTED", "skipped": "SKIPPED"}
    known = [F.count(F.when(F.col("status") == s, 1)).alias(n) for n, s in states.items()]
    return evaluated.agg(F.count("*").alias("total"), *known, F.count(F.when(~F.col("status").isin(*states.values()), 1)).alias("errors"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Skills of the documents with their locks, the files installed, and those that the source holds now."""
    skills, _ = lock.installed(spark, sf_dir)
    docs = scan.table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    skill = F.concat(F.lit("skill-"), F.floor(F.col("doc_id") / lock.SKILL_DOCS).cast("string"))
    path = F.concat(F.lit("references/"), F.col("doc_id").cast("string"), F.lit(".md"))
    old = docs.select("doc_id", skill.alias("skill"), path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.floor(F.col("doc_id") / lock.SKILL_DOCS)
    line = F.get(F.array(*[F.lit(p) for p in bundles.PAYLOADS]), F.pmod(number, F.lit(len(bundles.PAYLOADS))).cast("int"))
    edited = F.when((F.col("doc_id") % 17 == 3) & (number % 2 == 0), F.concat("text", F.lit("\n"), line)).otherwise(F.col("text"))
    now = old.filter(~((F.col("doc_id") % 29 == 5) | (number % 23 == 22))).withColumn("text", edited)
    more = old.filter("doc_id % 19 = 4").select("doc_id", "skill", F.regexp_replace("path", "references/(.*).md", "scripts/$1.sh").alias("path"), F.lit("echo https://new.example.com/x\n").alias("text"))
    return skills.select("skill", "lock"), old.drop("doc_id"), now.union(more).drop("doc_id")


def q_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(*snapshots(spark, sf_dir))


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(q_update(spark, sf_dir))


QUERIES = {"update_skills": q_update, "update_report": q_summary}
