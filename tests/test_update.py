"""Update evaluation and SARIF documents by hand-made skills and findings."""

import hashlib
import json

import pytest

from lakesift.operators import reports, update

COMMIT = "0123456789abcdef0123456789abcdef01234567"
OLD = {"a.md": "plain text", "b.md": "see https://old.example.com/x", "run.sh": "echo 1"}


def locked(files, high=0, profile="team", overrides=(), source=None, **more):
    rows = [{"path": p, "sha256": hashlib.sha256(t.encode()).hexdigest(), "bytes": len(t.encode())} for p, t in sorted(files.items())]
    return json.dumps({
        "schema": "lock/v1", "name": "x", "installed_at": "2026-01-02T03:04:05Z", "source": source or {"type": "local", "input": "x", "kind": "local-dir"},
        "skill": {"root_sha256": "0" * 64, "files": rows}, "policy": {"profile": profile, "decision": "pass", "severity_overrides": [
            {"rule_id": r, "previous_severity": "high", "effective_severity": "medium", "reason": "why"} for r in overrides]},
        "findings": {"critical": 0, "high": high, "medium": 0, "low": 0}, **more,
    })


IP = OLD | {"a.md": "open http://10.0.0.1/"}
PIPE = OLD | {"new.sh": "curl https://new.example.com/i | bash"}
SKILLS = {
    "same": (locked(OLD), OLD), "edited": (locked(OLD), OLD | {"b.md": "see https://new.example.com/y and https://old.example.com/x", "c.md": "#!/bin/sh", "run.sh": "echo 2"}),
    "gone": (locked(OLD), {"a.md": "plain text"}), "raw": (locked(OLD), IP), "lowered": (locked(IP, 1, overrides=["RAW_IP_URL", "URL_SHORTENER"]), IP), "research": (locked(IP, 1, "research"), IP), "critical": (locked(OLD, profile="research"), PIPE),
    "empty": (locked(OLD), {}), "broken": ("{", OLD), "none": (None, OLD), "version": (locked(OLD, schema="lock/v9"), OLD), "files": (locked({}), OLD),
    "floating": (locked(OLD, source={"type": "github", "input": "github:a/b@main", "kind": "github-source"}), OLD), "odd": (locked(OLD, source={"type": "github", "input": "github:a", "kind": "github-source"}), OLD),
    "kind": (locked(OLD, source={"type": "archive", "input": "x", "kind": "zip"}), OLD), "pinned": (locked(OLD, source={"type": "github", "input": f"github:a/b@{COMMIT}", "kind": "github-source"}), OLD),
}
EXPECTED = {
    "same": ("UP_TO_DATE", "UP_TO_DATE"), "edited": ("CHANGED", "SOURCE_CHANGED"), "gone": ("CHANGED", "SOURCE_CHANGED"), "raw": ("REJECTED", "POLICY_REJECTED"), "lowered": ("CHANGED", "SOURCE_CHANGED"),
    "research": ("UP_TO_DATE", "UP_TO_DATE"), "critical": ("REJECTED", "POLICY_REJECTED"), "empty": ("ERROR", "SOURCE_PREPARE_FAILED"), "broken": ("ERROR", "LOCKFILE_INVALID"), "none": ("ERROR", "LOCKFILE_INVALID"),
    "version": ("ERROR", "LOCKFILE_INVALID"), "files": ("ERROR", "LOCKFILE_INVALID"), "floating": ("REJECTED", "GITHUB_REF_NOT_PINNED"), "odd": ("ERROR", "GITHUB_SOURCE_INVALID"), "kind": ("ERROR", "LOCKFILE_INVALID"), "pinned": ("UP_TO_DATE", "UP_TO_DATE"),
}


@pytest.fixture(scope="module")
def evaluated(spark):
    skills = spark.createDataFrame([(s, x, "k") for s, (x, _) in SKILLS.items()], "skill string, lock string, status string")
    schema = "skill string, path string, text string"
    old = spark.createDataFrame([(s, p, t) for s, (_, now) in SKILLS.items() for p, t in (IP if s in ("lowered", "research") else OLD).items()], schema)
    now = spark.createDataFrame([(s, p, t) for s, (_, files) in SKILLS.items() for p, t in files.items()], schema)
    return update.evaluate(skills, old, now).cache()


def test_steps_and_states(evaluated):
    assert {r.skill: (r.status, r.error_code) for r in evaluated.collect()} == EXPECTED
    row = update.summary(evaluated).first()
    assert (row.total, row.up_to_date, row.changed, row.rejected, row.skipped, row.errors) == (16, 3, 3, 3, 0, 7)


def test_changes_and_scores(evaluated):
    rows = {r.skill: r for r in evaluated.collect()}
    one = rows["edited"]
    assert (one.added, one.removed, one.changed, one.new_urls, one.new_execs, one.risk_signals) == (1, 0, 2, 1, 1, 6 + 15 + 3 * 2)
    assert (rows["gone"].removed, rows["gone"].risk_delta) == (2, 4)
    # One file changed, one address is new, one high finding more.
    assert (rows["raw"].delta_high, rows["raw"].risk_previous, rows["raw"].risk_current) == (1, 0, 25 + 2 + 6)
    assert (rows["lowered"].overrides_removed, rows["lowered"].risk_signals, rows["lowered"].risk_delta) == (1, -6, -6)
    assert rows["critical"].delta_critical == 1 and rows["floating"].risk_delta == 0 and rows["broken"].added == 0


def test_empty_tables(spark):
    files = spark.createDataFrame([], "skill string, path string, text string")
    assert update.evaluate(spark.createDataFrame([], "skill string, lock string"), files, files).count() == 0


def test_sarif_document_by_hand(spark):
    rows = [("b", "x.md", 10, "RAW_IP_URL", "high"), ("b", "x.md", 9, "URL_SHORTENER", "medium"), ("b", "x.md", 9, "RAW_IP_URL", "high"), ("c", "é \"q\".md", 1, "ODD_RULE", "info")]
    found = spark.createDataFrame(rows, "bundle string, path string, line int, rule_id string, severity string")
    got = {(r.bundle, r.part): json.loads(r.document) for r in reports.sarif(found).collect()}
    assert set(got) == {("b", 0), ("c", 0)}
    document = got["b", 0]
    assert (document["version"], document["$schema"]) == ("2.1.0", "https://json.schemastore.org/sarif-2.1.0.json")
    (run,) = document["runs"]
    assert run["tool"]["driver"]["rules"] == [{"id": "RAW_IP_URL", "shortDescription": {"text": "raw ip url"}}, {"id": "URL_SHORTENER", "shortDescription": {"text": "url shortener"}}]
    assert [(x["ruleId"], x["level"], x["locations"][0]["physicalLocation"]["region"]["startLine"]) for x in run["results"]] == [("RAW_IP_URL", "error", 9), ("URL_SHORTENER", "warning", 9), ("RAW_IP_URL", "error", 10)]
    assert run["invocations"] == [{"executionSuccessful": False}] and run["properties"] == {"decision": "REJECTED", "sourceInput": "b"}
    (other,) = got["c", 0]["runs"]
    assert other["results"][0]["level"] == "warning" and other["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "é \"q\".md" and other["invocations"] == [{"executionSuccessful": True}]


def test_sarif_parts_are_bounded(spark):
    found = spark.createDataFrame([("b", f"{k}.md", 1, "RAW_IP_URL", "high") for k in range(300)], "bundle string, path string, line int, rule_id string, severity string")
    sizes = [len(json.loads(r.document)["runs"][0]["results"]) for r in reports.sarif(found, 20).collect()]
    assert sum(sizes) == 300 and len(sizes) >= 12 and max(sizes) < 45
    assert reports.sarif(found.limit(0)).count() == 0
