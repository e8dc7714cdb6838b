"""Lock verification by hand-made documents: one fault a row, and the first of several."""

import copy
import hashlib
import json

import pytest

from lakesift.operators import lock

FILES = [("a.md", hashlib.sha256(b"one").hexdigest(), 3), ("b/c.sh", hashlib.sha256(b"two").hexdigest(), 3)]
ROOT = hashlib.sha256("".join(f"{p}\0{s}\0" for p, s, _ in FILES).encode()).hexdigest()
COMMIT = "0123456789abcdef0123456789abcdef01234567"
GITHUB = f"github:owner/repo/sub@{COMMIT}"
GOOD = {
    "schema": "lock/v1", "name": "tool", "installed_at": "2026-01-02T03:04:05+01:00", "source": {"type": "local", "input": "./tool", "kind": "local-dir"},
    "skill": {"root_sha256": ROOT, "files": [{"path": p, "sha256": s, "bytes": n} for p, s, n in FILES]},
    "policy": {"profile": "team", "decision": "pass", "severity_overrides": []}, "findings": {"critical": 0, "high": 0, "medium": 1, "low": 0},
}
GOOD["source"]["input"] = "tool"
REPORT = {
    "schema_version": "report/v1", "source": {"input": "tool", "kind": "local-dir"}, "policy_profile": "team", "decision": "pass", "installed": True, "installed_path": "/x/tool/",
    "findings": [{"id": "URL_SHORTENER", "severity": "medium"}], "severity_overrides": [],
}
META = {"schema": "source/v1", "source_input": GITHUB, "source_kind": "github-source", "resolved_ref": COMMIT, "fetched_at": "2026-01-02T03:04:05Z", "skill_root_sha256": ROOT}


def changed(document, where, value):
    out = copy.deepcopy(document)
    *path, last = where.split(".")
    at = out
    for step in path:
        at = at[int(step) if step.isdigit() else step]
    at[int(last) if last.isdigit() else last] = value
    return out


def from_github(document, report=False):
    given = {"input": GITHUB, "kind": "github-source"} | ({} if report else {"type": "github"})
    return changed(document, "source", given)


LOCK_CASES = [
    ("schema", "lock/v2", "LOCK_SCHEMA", "expected lock/v1, got lock/v2"), ("schema", " lock/v1", "LOCK_SCHEMA", "lock schema must not contain leading or trailing whitespace"),
    ("schema", "lock/v1‮", "LOCK_SCHEMA", "lock schema must not contain Unicode bidi, zero-width, tag, or variation-selector characters"),
    ("schema", " lock\u0001", "LOCK_SCHEMA", "lock schema must not contain C0/C1 control characters"), ("name", "", "LOCK_STRUCTURE", "lock name is empty"),
    ("name", "tool ", "LOCK_STRUCTURE", "lock name must not contain leading or trailing whitespace"), ("installed_at", "", "LOCK_STRUCTURE", "lock installed_at is empty"),
    ("installed_at", "2026-01-02 03:04:05", "LOCK_STRUCTURE", "lock installed_at must be RFC3339"), ("policy.profile", "loose", "LOCK_STRUCTURE", "lock policy profile is unsupported: loose"),
    ("policy.profile", "Team", "LOCK_STRUCTURE", "lock policy profile must be canonical lowercase without surrounding whitespace"),
    ("policy.decision", "PASS", "LOCK_STRUCTURE", "lock policy decision must be canonical lowercase pass for installed skill, got PASS"),
    ("findings.low", -1, "LOCK_STRUCTURE", "lock findings summary is invalid: low count must be >= 0"), ("skill.files", [], "LOCK_STRUCTURE", "lock skill files is empty"),
    ("skill.root_sha256", ROOT.upper(), "LOCK_STRUCTURE", "lock skill root_sha256 must be a canonical lowercase 64-char hex digest"),
    ("skill.files.0.path", "a/../b", "LOCK_STRUCTURE", "lock file path is invalid: a/../b"), ("skill.files.0.path", " ", "LOCK_STRUCTURE", "lock file path is empty"),
    ("skill.files.0.path", "b/c.sh", "LOCK_STRUCTURE", "duplicate lock file path: b/c.sh"), ("skill.files.1.sha256", "12", "LOCK_STRUCTURE", "lock file sha256 is invalid: b/c.sh"),
    ("skill.files.1.bytes", -1, "LOCK_STRUCTURE", "lock file bytes is negative: b/c.sh"), ("source.kind", "Local-dir", "LOCK_SOURCE", "lock source kind must be canonical lowercase"),
    ("source.input", "x.zip", "LOCK_SOURCE", "lock source kind does not match source input: kind=local-dir detected=zip"), ("source.input", "a//b", "LOCK_SOURCE", "lock source input must be a canonical cleaned path for local/archive sources"),
    ("source.type", "archive", "LOCK_SOURCE", "source type mismatch for kind local-dir: expected local, got archive"), ("source.type", "", "LOCK_SOURCE", "lock source type is empty"),
    ("skill.files.0.bytes", 4, "FILE_DIGESTS", "missing=0 changed=1 unexpected=0"), ("skill.files.0.path", "z.md", "FILE_DIGESTS", "missing=1 changed=0 unexpected=1"),
    ("policy.severity_overrides", [{"rule_id": "A_B", "previous_severity": "critical", "effective_severity": "medium", "reason": "x"}], "LOCK_STRUCTURE", "lock policy severity_overrides is invalid: severity"),
]
REPORT_CASES = [
    ("schema_version", "report/v0", "install report schema_version is unsupported: report/v0"), ("source.input", "other", "install report source does not match lock source"),
    ("policy_profile", "strict", "install report policy profile does not match lock policy"), ("decision", "reject", "install report decision does not match lock policy decision"),
    ("installed", False, "install report installed must be true"), ("installed_path", "/x/other", "install report path mismatch: expected /x/tool, got /x/other"),
    ("findings", [], "install report findings summary does not match lock findings"), ("source.kind", "", "install report source kind is empty"),
    ("severity_overrides", [{"rule_id": "A_B", "previous_severity": "high", "effective_severity": "medium", "reason": "x"}], "install report severity_overrides does not match lock policy severity_overrides"),
]
META_CASES = [
    ("schema", "source/v2", "unsupported source metadata schema: source/v2"), ("source_kind", "zip", "source metadata source_kind is unsupported: zip"), ("resolved_ref", "main", "source metadata resolved_ref must be commit-pinned"),
    ("resolved_ref", COMMIT[::-1].replace("x", "0"), "source metadata resolved_ref does not match source_input ref"), ("fetched_at", "today", "source metadata fetched_at must be RFC3339"),
    ("skill_root_sha256", "0" * 64, "installed source metadata hash mismatch"), ("source_input", GITHUB.replace("owner", "Owner"), "source metadata source_input must be canonical"),
    ("source_input", GITHUB.replace("repo", "other"), "source metadata mismatch with lock source"),
]


@pytest.fixture(scope="module")
def verified(spark):
    rows, wanted = [("good", GOOD, REPORT, None), ("github", from_github(GOOD), from_github(REPORT, True), META)], {}
    for k, (where, value, code, detail) in enumerate(LOCK_CASES):
        rows.append((f"lock{k}", changed(GOOD, where, value), REPORT, None))
        wanted[f"lock{k}"] = (code, detail)
    for k, (where, value, detail) in enumerate(REPORT_CASES):
        rows.append((f"report{k}", GOOD, changed(REPORT, where, value), None))
        wanted[f"report{k}"] = ("INSTALL_REPORT", detail)
    for k, (where, value, detail) in enumerate(META_CASES):
        rows.append((f"meta{k}", from_github(GOOD), from_github(REPORT, True), changed(META, where, value)))
        wanted[f"meta{k}"] = ("SOURCE_METADATA", detail)
    dump = lambda x: None if x is None else json.dumps(x)
    table = [(s, "/x/tool", dump(a), dump(b), dump(c)) for s, a, b, c in rows]
    table += [("none", "/x/tool", None, None, None), ("broken", "/x/tool", '{"schema": ', "{}", None), ("shape", "/x/tool", '{"findings": {"low": "many"}}', "{}", None), ("empty", "/x/tool", "{}", None, None)]
    skills = spark.createDataFrame(table, "skill string, home string, lock string, report string, metadata string")
    files = spark.createDataFrame([(t[0], *f) for t in table for f in FILES], "skill string, path string, sha256 string, bytes long")
    checks = lock.verify(skills, files)
    return wanted, {(r.skill, r.code): (r.ok, r.detail) for r in checks.collect()}, {r.skill: r.status for r in lock.status(checks).collect()}


def test_each_fault_is_told(verified):
    wanted, checks, _ = verified
    for skill, (code, detail) in wanted.items():
        assert checks[skill, code] == (False, detail), skill


def test_good_skills_and_documents_that_cannot_be_read(verified):
    wanted, checks, status = verified
    for skill in ("good", "github"):
        assert all(checks[skill, code] == (True, None) for code in lock.CODES) and status[skill] == "VERIFIED"
    assert checks["none", "READ_LOCKFILE"][0] is False and status["none"] == "ERROR"
    assert checks["broken", "INVALID_LOCKFILE"][0] is False and checks["shape", "INVALID_LOCKFILE"][0] is False
    assert checks["empty", "LOCK_STRUCTURE"] == (False, "lock name is empty") and checks["empty", "INSTALL_REPORT"] == (False, "failed to read install report")
    assert all(status[s] == "DRIFTED" for s in wanted)


def test_empty_tables(spark):
    skills = spark.createDataFrame([], "skill string, home string, lock string, report string, metadata string")
    files = spark.createDataFrame([], "skill string, path string, sha256 string, bytes long")
    assert lock.verify(skills, files).count() == 0
