"""Detection rules as data, and the findings relation: files to lines to variants to findings, in one pass.

A finding is (bundle, path, line, rule_id, severity). Each line is matched as it is and joined with the lines it
continues on; a rule fires once for a line. Rules marked True are for Markdown files only.
"""

from __future__ import annotations

from lakesift.functions.dialect import Dialect
from lakesift.sources.bundles import files

FETCH = r"(?:curl|wget|fetch|iwr|invoke-webrequest)"
SHELL = r"(?:ba|z|k|da)?sh|python[0-9.]*|node|perl|ruby|pwsh|powershell"
#: Words that follow one another with at most so many characters between.
OVERRIDE = (("ignore", "override", "bypass"), 80, ("previous", "prior", "system", "higher", "earlier"), 40, ("instruction", "instructions", "prompt", "prompts"))
PREREQUISITE = (("required", "required prerequisite", "you must", "before use"), 120, ("download", "install"), 200, ("run", "execute", "bash", "sh", "powershell", "chmod +x"))
PASSWORDS = ("password", "passphrase", "passwd", "encrypted")
ARCHIVES = ("zip", "7z", "rar", "archive", "tar", "tgz", "tar.gz")
ARCHIVE_GAP = 80
BINARIES = ("zip", "exe", "msi", "dmg", "pkg", "tar.gz", "tgz")
#: Markup, hosts and paths that rules look for.
TAGS = ("script", "iframe", "object", "embed", "form", "link", "meta", "img", "svg", "video", "audio")
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rb.gy", "shorturl.at")
PASTE_SITES = ("pastebin.com", "hastebin.com", "ghostbin.com", "dpaste.com", "gist.github.com", "gist.githubusercontent.com")
HOME_PATHS = (
    "~/.bashrc", "~/.zshrc", "~/.profile", "~/.bash_profile", "~/.config/fish/config.fish", "~/.ssh/config", "~/.ssh/authorized_keys",
    "~/library/launchagents/", "/etc/profile", "/etc/bash.bashrc", "/etc/zsh/zshrc", "/etc/cron.d/", "/etc/cron.daily/", "/etc/cron.hourly/",
    "/etc/cron.weekly/", "/etc/cron.monthly/", "/var/spool/cron/",
)
HOME_WRITES = (">>", ">|", "| tee", "tee -a", " cp ", " mv ", " install ")
HOME_COMMANDS = ("cp ", "mv ", "install ")
CRONTAB = ("| crontab", "|crontab", "crontab -e")
SECRETS = (".env", "~/.ssh/", "/.ssh/", "~/.aws/", "/.aws/", "id_rsa", "id_ed25519", "credentials", "api_key", "token", "cookies", "keychain", "wallet")
SENDERS = ("curl", "wget", "invoke-webrequest", "invoke-restmethod", "requests.post", "netcat", "nc")
SENT = ("| curl", "|curl", "| wget", "|wget", "-d ", "--data", "--upload-file", "requests.post", "invoke-restmethod", "invoke-webrequest", "-f ")
LARGE_BYTES = 500_000


def words(group: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(w.replace(".", r"\.").replace("+", r"\+") for w in group) + r")\b"


def in_turn(*steps) -> str:
    """A pattern for groups of words with gaps of at most so many characters between them."""
    return "".join(words(s) if isinstance(s, tuple) else f".{{0,{s}}}" for s in steps)


def in_order(*parts: str) -> str:
    """A pattern for parts that stand in this order, whatever is between them."""
    return ".*".join(f"(?:{p})" for p in parts)


#: What grants the use of tools, the shell's name, and what stands for everything.
ALLOWED, GRANTED, BASH, ALL = r"\ballowed[ _-]?tools?\b", r"\btool[ _-]?permissions?\b", r"\bbash\b", r"[*]|\ball\b"


def grants_bash(d: Dialect, x: str) -> str:
    """Bash allowed without limit: named with a wild card beside a list of tools, or called on one."""
    orders = ((ALLOWED, BASH, ALL), (BASH, ALL, ALLOWED), (GRANTED, BASH, ALL))
    return "(" + " OR ".join([d.hit(f"lower({x})", in_order(*o)) for o in orders] + [d.hit(f"lower({x})", BASH + r"\s*\(\s*[*]\s*\)")]) + ")"


def on_host(hosts: tuple[str, ...]) -> str:
    return r"(?i)\bhttps?://(?:[a-z0-9-]+\.)*(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + r")(?:[:/?#\s]|$)"


def holds(d: Dialect, x: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {d.text(p)})" for p in parts) + ")"


def writes_home(d: Dialect, x: str) -> str:
    """A known start-up or schedule file next to a way to write it, or a crontab taken from a command."""
    low, bare = f"lower({x})", f"ltrim(lower({x}))"
    begins = " OR ".join(f"left({bare}, {len(c)}) = {d.text(c)}" for c in HOME_COMMANDS)
    return f"({holds(d, low, CRONTAB)} OR ({holds(d, low, HOME_PATHS)} AND ({holds(d, low, HOME_WRITES)} OR {begins})))"


def sends_secret(d: Dialect, x: str) -> str:
    """A place of secrets, a command that sends, an address, and a way to hand data over."""
    low = f"lower({x})"
    return f"({holds(d, low, SECRETS)} AND {holds(d, low, ('http://', 'https://'))} AND {holds(d, low, SENT)} AND {d.hit(low, words(SENDERS))})"


#: Rule ids with their severities; the patterns say what each looks for.
RULES: list[tuple] = [
    ("ANSI_OSC_ESCAPE_IN_TEXT", "critical", False, r"\x1b[\[\]]"),
    ("UNICODE_TAG_IN_INSTRUCTIONS", "critical", False, r"[\x{E0000}-\x{E007F}]"),
    ("BIDI_CONTROL_IN_TEXT", "critical", False, r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"),
    ("VARIATION_SELECTOR_IN_TEXT", "critical", False, r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"),
    ("ZERO_WIDTH_CHAR_IN_TEXT", "critical", False, r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}]"),
    ("CONTROL_CHAR_IN_TEXT", "critical", False, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"),
    (
        "CURL_PIPE_SHELL", "critical", False,
        rf"(?i)\b{FETCH}\b[^|]{{0,300}}\|\s*(?:sudo\s+)?(?:{SHELL})\b|\b(?:eval|{SHELL})\b[^|]{{0,80}}(?:\$\(|\x60)\s*{FETCH}\b"
        rf"|\biex\b.{{0,120}}\b(?:iwr|downloadstring|invoke-webrequest)\b|\b(?:iwr|downloadstring|invoke-webrequest)\b.{{0,120}}\biex\b"
        rf"|\b(?:source|\.)\s+<\(\s*{FETCH}\b",
    ),
    (
        "BASE64_PIPE_EXEC", "critical", False,
        rf"(?i)\bbase64\b[^|]{{0,120}}\s(?:-d|--decode)\b[^|]{{0,120}}\|\s*(?:{SHELL})\b|\bfrombase64string\b.{{0,120}}\biex\b|\b(?:exec|eval)\b.{{0,80}}\bb(?:ase)?64_?decode\b",
    ),
    ("HEX_PIPE_EXEC", "critical", False, rf"(?i)\bxxd\s+-r\b[^|]{{0,120}}\|\s*(?:{SHELL})\b|\b(?:exec|eval)\b.{{0,80}}\b(?:unhexlify|fromhex|hexdecode)\b"),
    ("ENCODED_COMMAND_EXEC", "critical", False, r"(?i)(?:^|\s)[^\sa-z0-9]*(?:pwsh|powershell)(?:\.exe)?[^\sa-z0-9]*\s(?:.*\s)?[-/]*enc(?:odedcommand)?(?:[\s:=]|$)"),
    ("WRITES_HOME_CONFIG", "high", False, writes_home),
    ("SECRET_EXFIL", "critical", False, sends_secret),
    ("ALLOWED_TOOLS_BASH_WILDCARD", "high", False, grants_bash),
    ("UNPINNED_RUNTIME_TOOL", "high", False, r"(?i)\b(?:npx|uvx|bunx)\s+(?:-y\s+)?@?[a-z0-9][a-z0-9._/-]*(?:@(?:latest|next|\^|~|>|<|\*)\S*)?(?:\s|$)"),
    ("FAKE_PREREQ_EXECUTION", "critical", True, "(?i)" + in_turn(*PREREQUISITE)),
    ("EXTERNAL_BINARY_DOWNLOAD", "high", True, r"(?i)\bhttps?://\S+[.]" + words(BINARIES).removeprefix(r"\b")),
    ("PROMPT_OVERRIDE_LANGUAGE", "high", True, "(?i)" + in_turn(*OVERRIDE)),
    ("PASSWORD_PROTECTED_ARCHIVE", "high", True, "(?i)(?:" + in_turn(PASSWORDS, ARCHIVE_GAP, ARCHIVES) + "|" + in_turn(ARCHIVES, ARCHIVE_GAP, PASSWORDS) + ")"),
    ("RAW_HTML_MARKUP", "medium", True, r"(?i)<\s*(?:" + "|".join(TAGS) + r")\b"),
    ("RAW_IP_URL", "high", False, r"(?i)\bhttps?://(?:[^/\s@]*@)?(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|0x[0-9a-f]+|[0-9]{8,10}|\[[0-9a-f:.]+\])(?:[:/?#\s]|$)"),
    ("URL_SHORTENER", "medium", False, on_host(SHORTENERS)),
    ("PASTE_SITE_URL", "medium", False, on_host(PASTE_SITES)),
    ("REMOTE_IMAGE_URL", "medium", True, r"(?i)(?:!\[|<img).{0,200}https?://[^\s)\x22]+\.(?:png|jpe?g|gif|svg|webp|bmp|ico)\b"),
    (
        "RELEASE_ASSET_URL", "medium", False,
        r"(?i)\bhttps?://(?:www\.)?(?:github\.com/[^\s?#]*/releases/(?:latest/)?download/"
        r"|(?:api|uploads)\.github\.com/repos/[^/\s]+/[^/\s]+/releases/[0-9]+/assets/?(?:[?#\s\x22')\]]|$)"
        r"|api\.github\.com/repos/[^/\s]+/[^/\s]+/releases/assets/[0-9]+/?(?:[?#\s\x22')\]]|$)"
        r"|github-releases\.githubusercontent\.com(?:[:/?#\s]|$)|objects\.githubusercontent\.com/[^\s?#]*github-production-release-asset-)",
    ),
]
#: A rule is tried on lines that hold one of these, in lower case; rules of odd characters have none.
NEEDLES: dict[str, tuple[str, ...]] = {
    "CURL_PIPE_SHELL": ("curl", "wget", "fetch", "iwr", "iex", "invoke-webrequest"),
    "BASE64_PIPE_EXEC": ("base64", "b64", "frombase"),
    "HEX_PIPE_EXEC": ("xxd", "hex"),
    "ENCODED_COMMAND_EXEC": ("pwsh", "powershell"),
    "WRITES_HOME_CONFIG": ("crontab", *HOME_PATHS),
    "SECRET_EXFIL": SECRETS,
    "ALLOWED_TOOLS_BASH_WILDCARD": ("bash",),
    "UNPINNED_RUNTIME_TOOL": ("npx", "uvx", "bunx"),
    "FAKE_PREREQ_EXECUTION": ("required", "you must", "before use"),
    "EXTERNAL_BINARY_DOWNLOAD": ("http",),
    "PROMPT_OVERRIDE_LANGUAGE": ("instruction", "prompt"),
    "PASSWORD_PROTECTED_ARCHIVE": PASSWORDS,
    "RAW_HTML_MARKUP": ("<",),
    "RAW_IP_URL": ("http",),
    "URL_SHORTENER": ("http",),
    "PASTE_SITE_URL": ("http",),
    "REMOTE_IMAGE_URL": ("http",),
    "RELEASE_ASSET_URL": ("github",),
}
REJECTED = ("critical", "high")
#: Rules whose findings come from relations of their own.
MORE_RULES = [("CHMOD_EXEC_CHAIN", "critical", False), ("LARGE_TEXT_FILE", "medium", False), ("UNKNOWN_FILE_TYPE", "medium", False)]
LOOK_AHEAD = 4  # lines that a continued line may take in
ODD = r"[^ -~\t\r]"  # every character that a rule without needles looks for


def rule_rows(d: Dialect) -> str:
    return d.values([(i, s, md) for i, s, md, _ in RULES] + MORE_RULES, ["rule_id", "severity", "markdown_only"])


def goes_on(d: Dialect, x: str) -> str:
    """Whether a line continues on the next: it ends in a backslash, pipe or &&, or opens $( without any closing bracket."""
    return f"({d.hit(x, r'(?:' + chr(92) * 2 + r'|[|]|&&)' + chr(92) + 's*$')} OR (contains({x}, '$' || '(') AND NOT contains({x}, ')')))"


def lines(d: Dialect) -> str:
    """CTEs up to `lines`: every line with its number from 1; lines without a visible character are left out.

    Only a line that continues carries the lines that come after it, LOOK_AHEAD of them."""
    split = d.pieces(d.swap("text", "\r\n", "\n") if d.name == "spark" else "replace(text, chr(13) || chr(10), chr(10))", "\n")
    if d.name == "spark":
        held = f"transform(parts, (x, i) -> named_struct('t', x, 'n', CASE WHEN {goes_on(d, 'x')} THEN slice(parts, i + 2, {LOOK_AHEAD}) END))"
    else:
        held = f"list_transform(range(1, len(parts) + 1), lambda i: {{'t': parts[i], 'n': CASE WHEN {goes_on(d, 'parts[i]')} THEN parts[i + 1:i + {LOOK_AHEAD}] END}})"
    exploded = d.rows("held", "one", "pos", "held_files")
    return f"""{files(d)},
split_files AS (SELECT bundle, path, kind, {split} AS parts FROM files WHERE kind <> 'unknown' AND {d.size("text")} <= {LARGE_BYTES}),
held_files AS (SELECT bundle, path, kind, {held} AS held FROM split_files),
all_lines AS (SELECT bundle, path, kind, CAST(pos + 1 AS INT) AS line, one.t AS line_text, one.n AS nexts FROM {exploded}),
lines AS (SELECT bundle, path, kind, line, line_text, nexts FROM all_lines WHERE {d.hit("line_text", r"[^\s]")})"""


def variants(d: Dialect) -> str:
    """CTEs up to `continued`: the line, and the line joined with those it continues on, as long as the joined text goes on."""
    def trimmed(x: str) -> str:
        return d.swap(x, r"^\s+|\s+$", "")

    def segment(x: str) -> str:
        return d.swap(trimmed(x), r"\s*\\$", "")

    if d.name == "spark":
        both = f"concat(a.j, ' ', {segment('x')})"
        step = f"CASE WHEN a.c AND {d.hit('x', '[^' + chr(92) + 's]')} THEN named_struct('j', {both}, 'c', {goes_on(d, both)}, 'more', TRUE) ELSE named_struct('j', a.j, 'c', FALSE, 'more', a.more) END"
        longer = f"aggregate(nexts, named_struct('j', {segment('line_text')}, 'c', TRUE, 'more', FALSE), (a, x) -> {step}, a -> CASE WHEN a.more THEN a.j END)"
        return f"""{lines(d)},
continued AS (SELECT bundle, path, kind, line, line_text, {longer} AS longer FROM lines)"""
    # The oracle's way: a step a relation.
    steps = [f"joined0 AS (SELECT *, {segment('line_text')} AS j, nexts IS NOT NULL AS c, FALSE AS more FROM lines)"]
    for k in range(1, LOOK_AHEAD + 1):
        item = d.item("nexts", str(k - 1))
        grows = f"(c AND {d.hit(f'coalesce({item}, {d.text(chr(32))})', '[^' + chr(92) + 's]')})"
        steps.append(
            f"grown{k} AS (SELECT bundle, path, kind, line, line_text, nexts, more OR {grows} AS more, {grows} AS c, CASE WHEN {grows} THEN concat(j, ' ', {segment(item)}) ELSE j END AS j FROM joined{k - 1}),"
            f" joined{k} AS (SELECT bundle, path, kind, line, line_text, nexts, more, c AND {goes_on(d, 'j')} AS c, j FROM grown{k})"
        )
    return f"""{lines(d)},
{", ".join(steps)},
continued AS (SELECT bundle, path, kind, line, line_text, CASE WHEN more THEN j END AS longer FROM joined{LOOK_AHEAD})"""


def found(d: Dialect, skip: tuple[str, ...] = (), odd: str = "odd") -> str:
    """An array of the rules that fire on line_text or, but for rules of odd characters, on the joined line."""
    def fires(rule: str, md: bool, p) -> str:
        test = p if callable(p) else lambda d, x: d.hit(x, p)
        if rule in NEEDLES:
            test = f"({holds(d, 'low', NEEDLES[rule])} AND ({test(d, 'line_text')} OR coalesce({test(d, 'longer')}, FALSE)))"
        else:
            test = f"({odd} AND {test(d, 'line_text')})"
        return f"(kind = 'markdown' AND {test})" if md else test

    hits = [f"CASE WHEN {fires(i, md, p)} THEN '{i}' END" for i, _, md, p in RULES if i not in skip]
    if d.name == "spark":  # in the same projection; the oracle has relations of their own for these
        either = lambda test: f"({test('line_text')} OR (longer IS NOT NULL AND {test('longer')}))"
        hits.append(f"CASE WHEN contains(low, 'chmod') AND {either(runs_made)} THEN 'CHMOD_EXEC_CHAIN' END")
        hits.append(f"CASE WHEN kind = 'markdown' AND {near_gate(d, 'low')} AND {either(says_phrase)} THEN 'PROMPT_OVERRIDE_LANGUAGE' END")
    array = ", ".join(hits)
    return d.lambda_("filter", f"array({array})" if d.name == "spark" else f"[{array}]", "x", "x IS NOT NULL")


def tested(d: Dialect, source: str) -> str:
    return f"SELECT *, lower(concat(line_text, ' ', coalesce(longer, ''))) AS low, {d.hit('line_text', ODD)} AS odd FROM {source}"


def findings(d: Dialect) -> str:
    """CTEs up to `findings`: one projection with all line rules, whose hits alone become rows, and the rules of files.

    A rule of odd characters is tried on the line itself, every other one on the joined line too."""
    more = "" if d.name == "spark" else f"""{chmod_chains(d)},
{fuzzy_hits(d)},
"""
    rows = "" if d.name == "spark" else """
  UNION ALL SELECT bundle, path, line, 'CHMOD_EXEC_CHAIN' AS rule_id FROM chains
  UNION ALL SELECT bundle, path, line, 'PROMPT_OVERRIDE_LANGUAGE' AS rule_id FROM fuzzy"""
    return f"""{variants(d)},
tested AS ({tested(d, "continued")}),
matched AS (SELECT bundle, path, line, {found(d)} AS ids FROM tested),
{more}hit_rows AS (
  SELECT bundle, path, line, rule_id FROM {d.rows("ids", "rule_id", "nth", "matched")}{rows}
  UNION ALL SELECT bundle, path, 1 AS line, 'LARGE_TEXT_FILE' AS rule_id FROM files WHERE kind <> 'unknown' AND {d.size("text")} > {LARGE_BYTES}
  UNION ALL SELECT bundle, path, 1 AS line, 'UNKNOWN_FILE_TYPE' AS rule_id FROM files WHERE kind = 'unknown'),
rules AS {rule_rows(d)},
findings AS (SELECT DISTINCT bundle, path, line, r.rule_id, severity FROM hit_rows h JOIN rules r ON h.rule_id = r.rule_id)"""


def q_lines(d: Dialect) -> str:
    return f"WITH {lines(d)} SELECT bundle, path, line, {d.sha256('line_text')} AS line_sha FROM lines"


def q_continuation(d: Dialect) -> str:
    return f"WITH {variants(d)} SELECT bundle, path, line, longer FROM continued WHERE longer IS NOT NULL"


def q_findings(d: Dialect) -> str:
    return f"WITH {findings(d)} SELECT * FROM findings"


def q_findings_rules(d: Dialect) -> str:
    return f"""WITH {findings(d)}
SELECT r.rule_id, r.severity, count(f.rule_id) AS n_findings, count(DISTINCT f.path) AS n_files
FROM rules r LEFT JOIN findings f ON r.rule_id = f.rule_id GROUP BY r.rule_id, r.severity"""


def _counts() -> str:
    return ", ".join(f"count(CASE WHEN severity = '{s}' THEN 1 END) AS {s}" for s in ("critical", "high", "medium", "low"))


def q_inspect(d: Dialect) -> str:
    reject = ", ".join(f"'{s}'" for s in REJECTED)
    return f"""WITH {findings(d)}
SELECT b.bundle, b.n_files, {_counts()},
  CASE WHEN count(CASE WHEN severity IN ({reject}) THEN 1 END) > 0 THEN 'REJECTED' ELSE 'PASS' END AS decision
FROM (SELECT bundle, count(*) AS n_files FROM files GROUP BY bundle) b LEFT JOIN findings f ON b.bundle = f.bundle
GROUP BY b.bundle, b.n_files"""


def q_severity_summary(d: Dialect) -> str:
    return f"WITH {findings(d)} SELECT bundle, {_counts()} FROM findings GROUP BY bundle"


def q_sarif_rules(d: Dialect) -> str:
    level = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'low' THEN 'note' ELSE 'warning' END"
    cast = "STRING" if d.name == "spark" else "VARCHAR"
    at = f"concat(path, ':', CAST(line AS {cast}))"
    first = f"min_by({at}, struct(path, line))" if d.name == "spark" else f"first({at} ORDER BY path, line)"
    return f"""WITH {findings(d)}
SELECT bundle, rule_id, {level} AS sarif_level, {first} AS first_place, count(*) AS n_results
FROM findings GROUP BY bundle, rule_id, severity"""


def q_compact(d: Dialect) -> str:
    cast = "STRING" if d.name == "spark" else "VARCHAR"
    parts = ", ' ', ".join(f"'{s}=', CAST({s} AS {cast})" for s in ("critical", "high", "medium", "low"))
    return f"SELECT bundle, concat('decision=', decision, ' ', {parts}) AS summary FROM ({q_inspect(d)}) i"


def q_pages_html(d: Dialect) -> str:
    """The raw-markup rule over whole web pages."""
    p = next(p for i, _, _, p in RULES if i == "RAW_HTML_MARKUP")
    return f"SELECT page_id, {d.length(d.find_all('html', p))} AS n_tags FROM {d.table('pages')} WHERE {d.hit('html', p)}"


MADE = r"(?i)^(?:sudo\s+)?chmod\s+\S*\+x\S*\s+(?:\./)?([^\s;]+)"
RAN = r"(?i)^(?:(?:sh|bash|zsh|pwsh|python|node)\s+)?(?:\./)?([^\s;]+)"


def commands(d: Dialect, x: str) -> str:
    """The commands of a line, in order."""
    return d.lambda_("filter", d.lambda_("transform", d.pieces(d.swap(x, r"&&|\|\|", ";"), ";"), "s", "trim(s)"), "s", "s <> ''")


def runs_made(x: str) -> str:
    """Spark: whether a command of the line runs what an earlier one has made executable."""
    d = Dialect()
    later = f"exists(slice(segs, i + 2, size(segs)), s -> {d.find('s', RAN, 1)} = {d.find('segs[i]', MADE, 1)})"
    each = f"exists(sequence(0, size(segs) - 1), i -> {d.find('segs[i]', MADE, 1)} <> '' AND {later})"
    # A one-element transform names the commands, so that they are cut once.
    return f"element_at(transform(array({commands(d, x)}), segs -> size(segs) > 1 AND {each}), 1)"


def texts(d: Dialect, test: str) -> str:
    """Each line that passes a test, and its joined form, as rows of their own."""
    both = d.lambda_("filter", "array(line_text, longer)" if d.name == "spark" else "[line_text, longer]", "x", "x IS NOT NULL")
    return d.rows("spellings", "t", "which", f"(SELECT bundle, path, line, {both} AS spellings FROM continued WHERE {test})")


def chmod_chains(d: Dialect) -> str:
    """CTE `chains`: a target made executable in one command and run in a later one of the same line, an ordered self-join."""
    return f"""cut AS (SELECT bundle, path, line, which, {commands(d, "t")} AS segments FROM {texts(d, d.hit("concat(line_text, ' ', coalesce(longer, ''))", "(?i)chmod"))} x),
segs AS (SELECT bundle, path, line, which, segment, nth FROM {d.rows("segments", "segment", "nth", "cut")}),
named AS (SELECT bundle, path, line, which, nth, {d.find("segment", MADE, 1)} AS made, {d.find("segment", RAN, 1)} AS ran FROM segs),
chains AS (
  SELECT DISTINCT a.bundle, a.path, a.line, a.made AS target FROM named a
  JOIN named b ON a.bundle = b.bundle AND a.path = b.path AND a.line = b.line AND a.which = b.which AND a.made = b.ran AND a.nth < b.nth
  WHERE a.made <> '')"""


def q_chmod_chain(d: Dialect) -> str:
    return f"WITH {variants(d)}, {chmod_chains(d)} SELECT bundle, path, line, target FROM chains"


#: Phrases that are looked for with their misspellings.
PHRASES = [
    "ignore previous instructions", "ignore all previous instructions", "disregard previous instructions", "override system prompt",
    "bypass safety instructions",
]


def near_gate(d: Dialect, x: str) -> str:
    """A test that every accepted spelling of a phrase's last word passes: one edit leaves one half of the word as it
    is, shuffled inner letters leave their set and number."""
    last = sorted({p.split()[-1] for p in PHRASES})
    halves = tuple(h for w in last for h in (w[: len(w) // 2], w[len(w) // 2 :]))
    mixed = "|".join(f"{w[0]}[{''.join(sorted(set(w[1:-1])))}]{{{len(w) - 2}}}{w[-1]}" for w in last)
    return f"({holds(d, x, halves)} OR {d.hit(x, mixed)})"


def says_phrase(x: str) -> str:
    """Spark: whether a run of the line's words is a phrase, each word spelt right or nearly so."""
    def near(w: str, p: str) -> str:
        inner = "array(" + ", ".join(f"'{c}'" for c in sorted(p[1:-1])) + ")"
        edit = f"(length({w}) >= 3 AND abs(length({w}) - {len(p)}) <= 1 AND levenshtein({w}, '{p}', 1) >= 0)" if len(p) >= 3 else "FALSE"
        mixed = f"(length({w}) = {len(p)} AND left({w}, 1) = '{p[0]}' AND right({w}, 1) = '{p[-1]}' AND array_sort(split(substr({w}, 2, {len(p) - 2}), '')) = {inner})" if len(p) >= 4 else "FALSE"
        return f"({w} = '{p}' OR {edit} OR {mixed})"

    d = Dialect()
    toks = d.lambda_("filter", d.pieces(d.swap(f"lower({x})", r"[^\pL]+", " "), " "), "w", "w <> ''")
    runs = []
    for p in PHRASES:
        own = p.split()
        # The last word first, as it is the rarest.
        words_ = " AND ".join(near(f"toks[i + {k}]", own[k]) for k in reversed(range(len(own))))
        runs.append(f"(size(toks) >= {len(own)} AND exists(sequence(0, greatest(size(toks) - {len(own)}, 0)), i -> {words_}))")
    return f"element_at(transform(array({toks}), toks -> {' OR '.join(runs)}), 1)"


def fuzzy_hits(d: Dialect) -> str:
    """CTE `fuzzy`: word windows of Markdown lines within one edit of each word of a phrase, or with a word's inner letters shuffled.

    One edit leaves the first or the last letter as it is and the length within one: that is tested first."""
    rows = [(n, i, w) for n, p in enumerate(PHRASES) for i, w in enumerate(p.split())]
    want = " ".join(f"WHEN {n} THEN {len(p.split())}" for n, p in enumerate(PHRASES))
    toks = d.lambda_("filter", d.pieces(d.swap("lower(t)", r"[^\pL]+", " "), " "), "w", "w <> ''")

    def inner(x: str) -> str:
        chars = f"split(substr({x}, 2, length({x}) - 2), '')" if d.name == "spark" else f"string_split(substr({x}, 2, length({x}) - 2), '')"
        return f"array_join(array_sort({chars}), '')" if d.name == "spark" else f"array_to_string(list_sort({chars}), '')"

    near = f"""abs(length(t.word) - length(p.word)) <= 1 AND (left(t.word, 1) = left(p.word, 1) OR right(t.word, 1) = right(p.word, 1))
      AND (t.word = p.word OR (length(t.word) >= 3 AND length(p.word) >= 3 AND {d.distance('t.word', 'p.word')} <= 1)
      OR (length(t.word) >= 4 AND length(t.word) = length(p.word) AND left(t.word, 1) = left(p.word, 1)
        AND right(t.word, 1) = right(p.word, 1) AND {inner('t.word')} = {inner('p.word')}))"""
    gate = "kind = 'markdown'" if d.name == "duckdb" else f"kind = 'markdown' AND {near_gate(d, 'lower(concat(line_text, chr(32), coalesce(longer, chr(32))))')}"
    return f"""toks AS (SELECT bundle, path, line, which, {toks} AS words FROM {texts(d, gate)} x),
words AS (SELECT bundle, path, line, which, word, nth AS place FROM {d.rows("words", "word", "nth", "toks")}),
phrases AS {d.values(rows, ["phrase", "nth", "word"])},
fuzzy AS (
  SELECT DISTINCT bundle, path, line, phrase FROM (
    SELECT bundle, path, line, which, p.phrase, t.place - p.nth AS begins, count(*) AS n FROM words t JOIN phrases p ON {near}
    GROUP BY bundle, path, line, which, p.phrase, t.place - p.nth) w
  WHERE n = CASE phrase {want} END)"""


def q_fuzzy_phrase(d: Dialect) -> str:
    return f"WITH {variants(d)}, {fuzzy_hits(d)} SELECT bundle, path, line, phrase FROM fuzzy"


QUERIES = {
    "lines": q_lines, "continuation": q_continuation, "findings": q_findings, "findings_rules": q_findings_rules,
    "inspect_bundle": q_inspect, "severity_summary": q_severity_summary, "sarif_rules": q_sarif_rules,
    "inspect_compact": q_compact, "raw_html": q_pages_html, "chmod_chain": q_chmod_chain, "fuzzy_phrase": q_fuzzy_phrase,
}
