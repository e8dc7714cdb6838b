"""Digests, drift between snapshots, policy and update decisions.

The previous snapshot holds all files; the current one drops every 11th, edits every 7th and adds copies of every
13th document, so every kind of drift occurs.
"""

from __future__ import annotations

from lakesift.functions.dialect import Dialect
from lakesift.operators.rules import findings, lines
from lakesift.sources.bundles import URL, files, picked, text_of

#: Weights and caps of the update score.
SCORE = {"critical": 100, "high": 25, "medium": 7, "low": 2}
SIGNALS = {"new_urls": (6, 60), "new_execs": (15, 90), "changed_files": (2, 60)}


def snapshots(d: Dialect) -> str:
    """CTEs prev and cur: (bundle, path, text, sha, bytes)."""
    return f"""{files(d)},
prev AS (SELECT bundle, path, text, {d.sha256("text")} AS sha, {d.size("text")} AS bytes FROM files),
cur_files AS (
  SELECT bundle, path, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' edited https://new.example.com/', path) ELSE text END AS text FROM files WHERE doc_id % 11 IS DISTINCT FROM 0
  UNION ALL SELECT bundle, concat('copy/', path) AS path, text FROM files WHERE doc_id % 13 = 0),
cur AS (SELECT bundle, path, text, {d.sha256("text")} AS sha, {d.size("text")} AS bytes FROM cur_files)"""


def drift(d: Dialect) -> str:
    return f"""{snapshots(d)},
drift AS (
  SELECT coalesce(p.bundle, c.bundle) AS bundle, coalesce(p.path, c.path) AS path,
    CASE WHEN c.path IS NULL THEN 'missing' WHEN p.path IS NULL THEN 'unexpected' ELSE 'changed' END AS change
  FROM prev p FULL OUTER JOIN cur c ON p.bundle = c.bundle AND p.path = c.path
  WHERE p.path IS NULL OR c.path IS NULL OR p.sha <> c.sha OR p.bytes <> c.bytes)"""


def q_file_digest(d: Dialect) -> str:
    return f"WITH {files(d)} SELECT bundle, path, {d.sha256('text')} AS sha256, {d.size('text')} AS bytes FROM files"


def q_root_digest(d: Dialect) -> str:
    zero = "chr(0)"
    line = f"concat(path, {zero}, sha, {zero})" if d.name == "spark" else f"path || {zero} || sha || {zero}"
    return f"""WITH {snapshots(d)}
SELECT bundle, {d.sha256(d.joined(line, "path"))} AS root_sha256, count(*) AS n_files FROM prev GROUP BY bundle"""


def q_drift(d: Dialect) -> str:
    return f"WITH {drift(d)} SELECT * FROM drift"


def q_verify_status(d: Dialect) -> str:
    return f"""WITH {drift(d)}
SELECT b.bundle, count(CASE WHEN change = 'missing' THEN 1 END) AS missing, count(CASE WHEN change = 'changed' THEN 1 END) AS changed,
  count(CASE WHEN change = 'unexpected' THEN 1 END) AS unexpected, CASE WHEN count(change) = 0 THEN 'VERIFIED' ELSE 'DRIFTED' END AS status
FROM (SELECT DISTINCT bundle FROM prev) b LEFT JOIN drift x ON b.bundle = x.bundle GROUP BY b.bundle"""


def _urls(d: Dialect, source: str) -> str:
    found = f"(SELECT bundle, {d.find_all('text', URL)} AS urls FROM {source})"
    tail = "" if d.name == "spark" else " u"
    inner = f"u_{source}"
    return f"{inner} AS {found}, urls_{source} AS (SELECT DISTINCT bundle, url FROM {d.rows('urls', 'url', 'nth', inner)}{tail})"


def signals(d: Dialect) -> str:
    return f"""{drift(d)},
{_urls(d, "prev")}, {_urls(d, "cur")},
new_urls AS (SELECT bundle, url FROM urls_cur EXCEPT SELECT bundle, url FROM urls_prev),
new_execs AS (SELECT bundle, path FROM cur WHERE path LIKE '%.sh' EXCEPT SELECT bundle, path FROM prev WHERE path LIKE '%.sh'),
signals AS (
  SELECT b.bundle, coalesce(u.n, 0) AS new_urls, coalesce(e.n, 0) AS new_execs, coalesce(c.n, 0) AS changed_files
  FROM (SELECT DISTINCT bundle FROM prev) b
  LEFT JOIN (SELECT bundle, count(*) AS n FROM new_urls GROUP BY bundle) u ON b.bundle = u.bundle
  LEFT JOIN (SELECT bundle, count(*) AS n FROM new_execs GROUP BY bundle) e ON b.bundle = e.bundle
  LEFT JOIN (SELECT bundle, count(*) AS n FROM drift GROUP BY bundle) c ON b.bundle = c.bundle)"""


def q_new_urls(d: Dialect) -> str:
    return f"WITH {signals(d)} SELECT * FROM new_urls"


def q_new_execs(d: Dialect) -> str:
    return f"WITH {signals(d)} SELECT * FROM new_execs"


def q_risk_score(d: Dialect) -> str:
    parts = " + ".join(f"least({n} * {w}, {cap})" for n, (w, cap) in SIGNALS.items())
    return f"""WITH {signals(d)}
SELECT bundle, new_urls, new_execs, changed_files, CAST({parts} AS BIGINT) AS signal_score,
  CASE WHEN new_urls + new_execs + changed_files > 0 THEN 'CHANGED' ELSE 'UP_TO_DATE' END AS status FROM signals"""


def q_severity_score(d: Dialect) -> str:
    weight = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in SCORE.items()) + " ELSE 0 END"
    return f"WITH {findings(d)} SELECT bundle, CAST(sum({weight}) AS BIGINT) AS severity_score FROM findings GROUP BY bundle"


OVERRIDES = [("UNPINNED_RUNTIME_TOOL", "tool is vendored"), ("RAW_IP_URL", "lab network"), ("CURL_PIPE_SHELL", "never lowered"), ("LINK_SPOOFING_URL_MISMATCH", "matches nothing")]
ALLOWED = ["UNPINNED_RUNTIME_TOOL", "RAW_IP_URL"]


def overridden(d: Dialect) -> str:
    return f"""{findings(d)},
overrides AS {d.values(OVERRIDES, ["rule_id", "why"])},
allowed AS {d.values([(a,) for a in ALLOWED], ["rule_id"])},
effective AS (
  SELECT f.*, CASE WHEN o.rule_id IS NOT NULL AND severity = 'high' THEN 'medium' ELSE severity END AS effective
  FROM findings f LEFT JOIN overrides o ON f.rule_id = o.rule_id)"""


def q_effective(d: Dialect) -> str:
    return f"WITH {overridden(d)} SELECT bundle, rule_id, severity, effective, count(*) AS n FROM effective GROUP BY bundle, rule_id, severity, effective"


def q_unmatched(d: Dialect) -> str:
    return f"WITH {overridden(d)} SELECT rule_id FROM overrides o WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.rule_id = o.rule_id)"


def q_override_policy(d: Dialect) -> str:
    return f"WITH {overridden(d)} SELECT rule_id, 'not allowed' AS reason FROM overrides o WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.rule_id = o.rule_id)"


def q_override_diff(d: Dialect) -> str:
    return f"""WITH {overridden(d)}
SELECT o.rule_id, CASE WHEN f.rule_id IS NULL THEN 'removed' ELSE 'active' END AS state
FROM overrides o LEFT JOIN (SELECT DISTINCT rule_id FROM findings) f ON o.rule_id = f.rule_id"""


def q_install_decision(d: Dialect) -> str:
    profiles = d.values([("strict", "critical"), ("strict", "high"), ("team", "critical"), ("team", "high"), ("research", "critical")], ["profile", "severity"])
    return f"""WITH {overridden(d)}, rejects AS {profiles}
SELECT b.bundle, p.profile, CASE WHEN count(r.severity) > 0 THEN 'REJECTED' ELSE 'PASS' END AS decision
FROM (SELECT DISTINCT bundle FROM files) b CROSS JOIN (SELECT DISTINCT profile FROM rejects) p
LEFT JOIN effective e ON e.bundle = b.bundle LEFT JOIN rejects r ON r.profile = p.profile AND r.severity = e.effective
GROUP BY b.bundle, p.profile"""


def q_reject_set(d: Dialect) -> str:
    rows = picked(d, [("strict", "HIGH"), ("strict", "critical"), ("team", " medium"), ("research", "critical"), ("research", "critical")], ["profile", "severity"], [0, 0, 1, 2, 2])
    return f"""SELECT doc_id, profile, {d.joined_by("lower(trim(severity))", ",")} AS severities,
  max(CASE WHEN lower(trim(severity)) = 'critical' THEN 1 ELSE 0 END) = 1 AS has_critical FROM {rows} r GROUP BY doc_id, profile"""


def q_nearest_policy(d: Dialect) -> str:
    """The policy of the longest folder that holds a path: ancestors joined by equality, deepest first."""
    dirs = f"(SELECT doc_id AS id, concat(dir, '/', {text_of(d, 'doc_id')}) AS dir FROM {picked(d, [('a/b/c',), ('a/x',), ('z',), ('a/b',)], ['dir'])} x)"
    policies = d.values([("", "root"), ("a", "p-a"), ("a/b", "p-ab")], ["folder", "policy"])
    parts = d.pieces("dir", "/")
    if d.name == "spark":
        ups = f"transform(sequence(0, size({parts})), i -> array_join(slice({parts}, 1, i), '/'))"
    else:
        ups = f"list_transform(range(0, len({parts}) + 1), lambda i: CASE WHEN i = 0 THEN '' ELSE array_to_string(({parts})[1:i], '/') END)"
    return f"""WITH dirs AS {dirs}, up AS (SELECT id, dir, {ups} AS folders FROM dirs),
anc AS (SELECT id, dir, folder, depth FROM {d.rows("folders", "folder", "depth", "up")}),
pol AS {policies},
ranked AS (SELECT id, dir, policy, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS nth FROM anc JOIN pol ON anc.folder = pol.folder)
SELECT id, dir, policy FROM ranked WHERE nth = 1"""


def q_override_audit(d: Dialect) -> str:
    rows = picked(
        d, [("A_RULE", "high", "medium", "why", "me"), ("A_RULE", "high", "medium", "again", "me"), ("B", "critical", "medium", "x", "me"), ("C", "high", "low", "x", "me"), ("D", "high", "medium", " ", "me")],
        ["rule_id", "was", "now_", "why", "who"], [0, 0, 0, 1, 1],
    )
    return f"""SELECT doc_id, rule_id, why, CASE WHEN was <> 'high' THEN 'bad previous' WHEN now_ <> 'medium' THEN 'bad effective' WHEN trim(why) = '' THEN 'no reason'
  WHEN count(*) OVER (PARTITION BY doc_id, rule_id) > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM {rows} o"""


def q_infer_rule_id(d: Dialect) -> str:
    rows = picked(d, [("RAW_IP_URL: bad host",), ("read failed: LARGE_TEXT_FILE at 3",), ("read failed: LARGE_TEXT_FILE: at 3",), ("nothing here",), ("ABC: x",), ("",)], ["message"])
    # An id stands at the start, or anywhere if it has an underscore; a colon and white space follow it.
    a, b = d.find("trim(message)", r"^([A-Z][A-Z0-9_]+):\s", 1), d.find("message", r"(?:^|[^A-Z0-9_])([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+):\s", 1)
    return f"SELECT doc_id, CASE WHEN {a} <> '' THEN {a} ELSE {b} END AS rule_id FROM {rows} m"


def q_error_code(d: Dialect) -> str:
    rows = picked(d, [(" BAD_INPUT ", "F"), ("bad", "FALL_BACK"), ("", "also bad"), ("X1", "")], ["code", "fallback"])
    ok = lambda c: d.hit(f"trim({c})", "^[A-Z0-9_]+$")
    return f"SELECT doc_id, CASE WHEN {ok('code')} THEN trim(code) WHEN {ok('fallback')} THEN trim(fallback) ELSE 'UNKNOWN_ERROR' END AS code FROM {rows} e"


def q_lock_path(d: Dialect) -> str:
    paths = ["a/b.md", "/abs", "a//b", "a/../b", "./a", "a\\b", "C:/x", " a", "zero\u200bwidth", "ok.txt", ""]
    rows = f"(SELECT doc_id, CASE WHEN path IN ('', ' a') THEN path ELSE concat(path, '.', {text_of(d, 'doc_id')}) END AS path FROM {picked(d, [(x,) for x in paths], ['path'])} x)"
    bad = r"^$|^/|^[A-Za-z]:|\\|//|(?:^|/)\.{1,2}(?:/|$)|/$|^\s|\s$|[\x00-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{2028}\x{2029}\x{FE00}-\x{FE0F}]"
    return f"SELECT doc_id, NOT {d.hit('path', bad)} AS valid FROM {rows} p"


def q_sarif_level(d: Dialect) -> str:
    rows = picked(d, [(s,) for s in ("critical", "high", "medium", "low", "info", "odd")], ["severity"])
    return f"SELECT doc_id, severity, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' WHEN severity = 'low' THEN 'note' ELSE 'warning' END AS sarif_level FROM {rows} s"


def q_update_summary(d: Dialect) -> str:
    return f"""WITH u AS ({q_risk_score(d)})
SELECT count(*) AS total, count(CASE WHEN status = 'CHANGED' THEN 1 END) AS changed, count(CASE WHEN status = 'UP_TO_DATE' THEN 1 END) AS up_to_date,
  CAST(max(signal_score) AS BIGINT) AS highest FROM u"""


def q_shell_norm(d: Dialect) -> str:
    """Default expansions of the shell in one form."""
    rows = f"""(SELECT l.bundle, l.path, l.line, concat(l.line_text, ' ', x.expansion) AS line_text FROM lines l
  JOIN {d.values(list(enumerate(["${A:-}", "x ${B=}", "${C:=word}", "${D+alt} ${E?}", "plain", "${F:-keep}"])), ["pick", "expansion"])} x ON l.line % 6 = x.pick)"""
    x = d.swap("line_text", r"\$\{([A-Za-z_][A-Za-z0-9_]*|[0-9]+):?[-=?+]\}", "<$1>")
    x = d.swap(x, r"\$\{([A-Za-z_][A-Za-z0-9_]*|[0-9]+):[=+?]", "<$1:-")
    x = d.swap(x, r"\$\{([A-Za-z_][A-Za-z0-9_]*|[0-9]+)[=+?]", "<$1-")
    return f"WITH {lines(d)} SELECT bundle, path, line, {d.sha256(x)} AS normal_sha FROM {rows} s"


def q_enc_candidates(d: Dialect) -> str:
    """Hex and base64 tokens of a line that may hold text, 16 at most."""
    sep = r"[\s\x22\x27\x60,;:()\[\]{}<>|]+"
    toks = d.lambda_("filter", d.pieces(d.swap("line_text", sep, " "), " "), "t", "t <> ''")
    hexed = lambda t: f"({d.hit(t, '^(?:0[xX])?(?:[0-9A-Fa-f]{2})+$')} AND length({t}) >= 64)"
    b64 = lambda t: f"({d.hit(t, '^[A-Za-z0-9+/_-]+=*$')} AND {d.size(t)} >= 40)"
    kept = d.part(d.lambda_("filter", toks, "t", f"{hexed('t')} OR {b64('t')}"), 1, 16)
    return f"""WITH {lines(d)}, c AS (SELECT bundle, path, line, {kept} AS found FROM lines WHERE {d.hit("line_text", "[A-Za-z0-9+/_=-]{40}")})
SELECT bundle, path, line, nth, token, CASE WHEN {hexed("token")} THEN 'hex' ELSE 'base64' END AS kind FROM {d.rows("found", "token", "nth", "c")}"""


def q_ref_links(d: Dialect) -> str:
    """Reference links against the first definition of their name in the file, by host."""
    heads = picked(d, [("see [good.example.com][r1] and [docs][r2]\n[r1]: https://evil.example.net/x\n[R1]: https://good.example.com/\n[r2]: https://docs.example.com\n",), ("[a.example.com](https://a.example.com/) [b.example.com][q]\n[q]: https://b.example.com/z\n",)], ["head"])
    files_ = f"(SELECT {text_of(d, 'h.doc_id')} AS path, concat(h.head, coalesce(t.text, '')) AS text FROM {heads} h JOIN {d.table('documents')} t ON h.doc_id = t.doc_id)"
    defs, uses = r"(?m)^\[[^\]]+\]:\s*https?://\S+", r"\[[^\]]+\]\[[^\]]+\]"
    name_d, host_d = d.find("def_", r"^\[([^\]]+)\]", 1), d.find("def_", r"https?://([^/\s:?#]+)", 1)
    name_u, label = d.find("use_", r"\]\[([^\]]+)\]", 1), d.find("use_", r"^\[([^\]]+)\]", 1)
    return f"""WITH f AS {files_},
da AS (SELECT path, {d.find_all("text", defs)} AS defs FROM f), ua AS (SELECT path, {d.find_all("text", uses)} AS uses FROM f),
d0 AS (SELECT path, lower({name_d}) AS ref, lower({host_d}) AS host, nth FROM {d.rows("defs", "def_", "nth", "da")}),
d1 AS (SELECT path, ref, host FROM (SELECT *, row_number() OVER (PARTITION BY path, ref ORDER BY nth) AS k FROM d0) x WHERE k = 1),
u0 AS (SELECT path, lower({name_u}) AS ref, lower({label}) AS label FROM {d.rows("uses", "use_", "nth", "ua")})
SELECT u.path, u.ref, u.label, d1.host, {d.hit("u.label", "^[a-z0-9-]+([.][a-z0-9-]+)+$")} AND u.label <> d1.host AS spoofed FROM u0 u JOIN d1 ON u.path = d1.path AND u.ref = d1.ref"""


QUERIES = {
    "file_digest": q_file_digest, "root_digest": q_root_digest, "lock_drift": q_drift, "verify_status": q_verify_status, "new_urls": q_new_urls,
    "new_execs": q_new_execs, "risk_score": q_risk_score, "severity_score": q_severity_score, "effective_severity": q_effective,
    "unmatched_override": q_unmatched, "override_policy": q_override_policy, "override_diff": q_override_diff, "install_decision": q_install_decision,
    "reject_set": q_reject_set, "nearest_policy": q_nearest_policy, "override_audit": q_override_audit, "infer_rule_id": q_infer_rule_id,
    "error_code": q_error_code, "lock_path_valid": q_lock_path, "sarif_level": q_sarif_level, "update_summary": q_update_summary,
    "shell_norm": q_shell_norm, "enc_candidates": q_enc_candidates, "ref_link_join": q_ref_links,
}
