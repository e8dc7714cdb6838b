"""Shell lines with every expansion in one form, and downloads that are sourced from standard input."""

from __future__ import annotations

import re

_CLOSERS = {"${": "}", "$(": ")", "$[": "]"}
_SIMPLE = re.compile(r"\$(?:[A-Za-z_][A-Za-z0-9_]*|[0-9]|[$!?#*@-])|\$'[^'\n]*'")
_ONE = "$$"
_FETCH = r"\b(?:curl|wget)\b"
_BASE64 = r"\b(?:base64|openssl\s+base64)\b"
_HEX = r"\b(?:xxd\s+-r(?:\s+-p)?|unhexlify|fromhex|hexdecode)\b"
_READ = r"(?:(?:builtin|command)(?:\s*--|\s*-p(?:\s*--)?)?\s+)*(?:source|\.)\s+"
_PID = r"(?:self|thread-self|[0-9]+|\$\$)"
_STDIN = rf"""(?:\\*['"])?(?:/+dev/+stdin|/+dev/+fd/+0+|/+proc/+{_PID}(?:/+task/+{_PID})?/+fd/+0+|-)(?:\\*['"])?(?=[\s;&|)]|\Z)"""
#: Rule by what comes before the pipe.
SOURCED = {
    rule: re.compile(rf"(?i){head}[^\n|]{{0,300}}\|\s*{_READ}{_STDIN}")
    for rule, head in (("CURL_PIPE_SHELL", _FETCH), ("BASE64_PIPE_EXEC", _BASE64), ("HEX_PIPE_EXEC", _HEX))
}
#: A line without these can't source its standard input; the same test runs in the JVM before any line comes here.
GATE = r"\|\s*(?:(?:builtin|command)\b.*?)?(?:source|\.)\s"


def _closing(line: str, start: int) -> int:
    """The end of the expansion that opens at start, past the brackets that open within it; -1 if it doesn't end."""
    open_ = [_CLOSERS[line[start : start + 2]]]
    k = start + 2
    while k < len(line):
        if line[k : k + 2] in _CLOSERS:
            open_.append(_CLOSERS[line[k : k + 2]])
            k += 1
        elif line[k] == "(" and open_[-1] == ")":
            open_.append(")")
        elif line[k] == open_[-1]:
            open_.pop()
            if not open_:
                return k
        k += 1
    return -1


def flat(line: str) -> str:
    """The line with every expansion, whatever it is nested in, in place of which stands one and the same."""
    out, k = [], 0
    while k < len(line):
        end = -1
        if line[k : k + 2] in _CLOSERS:
            end = _closing(line, k)
        elif line[k] == "`":
            m = re.compile(r"`(?:[^`\\]|\\.)*`").match(line, k)
            end = m.end() - 1 if m else -1
        elif m := _SIMPLE.match(line, k):
            end = m.end() - 1
        if end < 0:
            out.append(line[k])
            k += 1
        else:
            out.append(_ONE)
            k = end + 1
    return "".join(out)


def sourced(line: str) -> list[str]:
    """The rules of what is downloaded or decoded and then sourced from standard input."""
    plain = flat(line)
    return [rule for rule, pattern in SOURCED.items() if pattern.search(line) or pattern.search(plain)]
