"""The head of a skill's main file: a strict reader for the part of YAML that such heads may use, and its rules.

The reader goes line by line with the indentation as its only state. It keeps scalars of the root mapping and tells
anchors, aliases, tags of one's own and merge keys wherever they stand; deeper values are only checked, not kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

MOST_BYTES, NAME_CHARACTERS, DESCRIPTION_CHARACTERS = 1_000_000, 64, 1024
_NAME = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'#\[\]{}>|*&!%@`,?:-][^#:]*?|[?:-](?=\S)[^#:]*?|<<)\s*:(?:\s+(.*)|)""")
_QUOTED = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:#.*)?""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/", "0": "\0", " ": " "}
_BLOCK = re.compile(r"([|>])[+-]?[1-9]?[+-]?\s*(?:#.*)?")
#: Words that turn a description into an instruction, and how far they may stand apart.
RUNS = ("run", "execute", "exec", "invoke", "call", "use")
TOOLS = ("bash", "sh", "zsh", "pwsh", "powershell", "python", "node", "npm", "npx", "uvx", "go", "curl", "wget", "terminal", "command")
OVERRIDES = (("ignore", "override", "bypass"), 40, ("previous", "prior", "system", "higher", "earlier"), 20, ("instruction", "instructions", "prompt", "prompts"))


class Bad(ValueError):
    """A head that breaks a rule; its text is the rule's."""


def split(text: str) -> tuple[str, str]:
    """(head, rest) of a file that starts with a head between two lines of three dashes."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0] != "---":
        raise Bad("SKILL.md must start with YAML frontmatter")
    if "---" not in lines[1:]:
        raise Bad("SKILL.md frontmatter is not closed")
    end = lines.index("---", 1)
    return "\n".join(lines[1:end]), "\n".join(lines[end + 1 :])


def _unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    out, rest = [], iter(text[1:-1])
    for c in rest:
        if c == "\\":
            c = next(rest)
            if c not in _ESCAPES:
                raise Bad("invalid SKILL.md frontmatter YAML")
            c = _ESCAPES[c]
        out.append(c)
    return "".join(out)


def _marks(value: str) -> None:
    """Anchors, aliases and tags at the start of a value or of an element of a flow sequence or mapping."""
    bare = re.sub(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')""", "''", value)
    starts = [bare] if bare[:1] not in "[{" else [p.strip() for p in re.split(r"[\[\]{},]|:\s", bare)]
    for x in filter(None, starts):
        if x[0] == "*" and len(x) > 1:
            raise Bad("YAML aliases are not allowed in SKILL.md frontmatter")
        if x[0] == "&" and len(x) > 1:
            raise Bad("YAML anchors are not allowed in SKILL.md frontmatter")
        if x[0] == "!" and not x.startswith("!!"):
            raise Bad("custom YAML tags are not allowed in SKILL.md frontmatter")
    if bare[:1] in ("[", "{") and (bare.count("[") != bare.count("]") or bare.count("{") != bare.count("}")):
        raise Bad("invalid SKILL.md frontmatter YAML")


def _scalar(value: str) -> str | None:
    """The text of a value on its line; None if it isn't a scalar."""
    if value[0] in "\"'":
        m = _QUOTED.fullmatch(value)
        if m is None:
            raise Bad("invalid SKILL.md frontmatter YAML")
        return _unquoted(m[1])
    if value[0] in "[{":
        return None
    if value[0] in "%@`" or re.search(r":\s|:$", value := re.sub(r"(?:^|\s)#.*$", "", value).rstrip()):
        raise Bad("invalid SKILL.md frontmatter YAML")
    return re.sub(r"^!!\S+\s*", "", value)


def fields(head: str) -> Iterator[tuple[str, str | None]]:
    """(key, scalar or None) of the root mapping, in order."""
    lines = head.split("\n")
    k, any_key = 0, False
    while k < len(lines):
        line = lines[k]
        k += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] in " \t-":
            raise Bad("invalid SKILL.md frontmatter YAML")
        _marks(line)
        m = _KEY.fullmatch(line.rstrip())
        if m is None or line.startswith(("...", "%")):
            raise Bad("invalid SKILL.md frontmatter YAML")
        any_key, key, value = True, _unquoted(m[1]) if m[1][0] in "\"'" else m[1], (m[2] or "").strip()
        deeper: list[str] = []
        while k < len(lines) and (not lines[k].strip() or lines[k][0] in " \t" or (lines[k].startswith("- ") and not value)):
            deeper.append(lines[k])
            k += 1
        if key == "<<":
            raise Bad("YAML merge keys are not allowed in SKILL.md frontmatter")
        if block := _BLOCK.fullmatch(value):
            yield key, (" " if block[1] == ">" else "\n").join(x.strip() for x in deeper).strip()
            continue
        if value:
            _marks(value)
        for x in deeper:
            if "\t" in x[: len(x) - len(x.lstrip())]:
                raise Bad("invalid SKILL.md frontmatter YAML")
            part = re.sub(r"^(?:-\s+)+", "", x.strip())
            if re.match(r"<<\s*:", part):
                raise Bad("YAML merge keys are not allowed in SKILL.md frontmatter")
            _marks(part)
            if (inner := _KEY.fullmatch(part)) and inner[2]:
                _marks(inner[2].strip())
        nested = any(x.strip() for x in deeper)
        if value and nested and _scalar(value) is not None and value[0] not in "\"'":
            yield key, " ".join([_scalar(value), *(x.strip() for x in deeper if x.strip())])
        else:
            yield key, None if nested else _scalar(value) if value and not value.startswith("#") else ""
    if not any_key:
        raise Bad("invalid SKILL.md frontmatter YAML")


def _says(text: str, *steps) -> bool:
    """Whether words of groups follow one another, at most so many characters apart."""
    def word(group):
        return r"\b(?:" + "|".join(group) + r")\b"

    return re.search("".join(word(s) if isinstance(s, tuple) else f".{{0,{s}}}" for s in steps), text, re.IGNORECASE) is not None


def check(text: str | None) -> tuple[str, str]:
    """(name, description) of a main file, or the first rule that it breaks."""
    if text is None:
        raise Bad("failed to read SKILL.md")
    if len(text.encode()) > MOST_BYTES:
        raise Bad("SKILL_FRONTMATTER_TOO_LARGE: SKILL.md exceeds size limit")
    own: dict[str, str | None] = {}
    double = None
    for key, value in fields(split(text)[0]):
        double = double or (key if key in own else None)
        own.setdefault(key, value)
    if double is not None:
        raise Bad(f"duplicate frontmatter key: {double}")
    name, description = own.get("name"), own.get("description")
    if not (name or "").strip() or not (description or "").strip():
        raise Bad("frontmatter must include non-empty string fields: name and description")
    if len(name.encode()) > NAME_CHARACTERS:
        raise Bad("frontmatter name is invalid: must be at most 64 characters")
    if not _NAME.fullmatch(name):
        raise Bad("frontmatter name is invalid: expected lowercase ASCII letters, digits, and single hyphens")
    bare = description.strip()
    if len(bare) > DESCRIPTION_CHARACTERS:
        raise Bad("description must be 1 to 1024 characters")
    if re.search(r"\b(?:(?:https?|ftp)://|www\.)\S", bare, re.IGNORECASE):
        raise Bad("description must not contain URLs")
    if "```" in bare:
        raise Bad("description must not contain code fences")
    if _says(bare, *OVERRIDES):
        raise Bad("DESCRIPTION_TOOL_INJECTION: description must not contain prompt override language")
    if _says(bare, RUNS, 30, TOOLS):
        raise Bad("DESCRIPTION_TOOL_INJECTION: description must not include tool or command execution instructions")
    return name, description


def validated(text: str | None, folder: str | None = None) -> tuple[str | None, str | None, str | None]:
    """(name, description, error); a folder, where given, has to bear the name."""
    try:
        name, description = check(text)
        if folder is not None and name != folder:
            raise Bad(f"frontmatter name must match directory name: name={name} dir={folder}")
    except Bad as e:
        return None, None, str(e)
    return name, description, None
