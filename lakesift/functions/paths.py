"""Risks in the names of files and folders: scripts that mix, and characters that look like ASCII."""

from __future__ import annotations

import re
import unicodedata

from lakesift.functions.encoded import compatible

#: Groups of scripts by the first word of their letters' Unicode names.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARABIC", "HEBREW", "DEVANAGARI")
#: Letters of other scripts that look like ASCII letters, and marks that look like a dot.
LOOKALIKES = frozenset("АВЕКМНОРСТХУԀаеорсхуіјԁҺһӀӏԜԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαβικνορτυχϲ")
DOTS = frozenset("．｡。﹒․")
_FULL_WIDTH = re.compile(r"(?:FULLWIDTH|HALFWIDTH) ")


def script(letter: str) -> str | None:
    name = _FULL_WIDTH.sub("", unicodedata.name(letter, ""))
    first = name.partition(" ")[0].partition("-")[0]
    return {"KANGXI": "CJK", "IDEOGRAPHIC": "CJK", "FEMININE": "LATIN", "MASCULINE": "LATIN", "KELVIN": "LATIN", "ANGSTROM": "LATIN"}.get(first, first if first in SCRIPTS else None)


def mixes_scripts(name: str) -> bool:
    return len({s for c in name if unicodedata.category(c).startswith("L") and (s := script(c))}) > 1


def _ascii_form(text: str, marks: str = "") -> str:
    """The compatibility form of a text, if that is other than the text and ASCII letters, digits and marks only."""
    form = compatible(text)
    return form if form != text and form.isascii() and all(c.isalnum() or c in marks for c in form) else ""


def looks_like_ascii(name: str) -> bool:
    """ASCII letters or digits beside a character that poses as one."""
    odd = any(not c.isascii() and (c in LOOKALIKES or c in DOTS or _ascii_form(c)) for c in name)
    return odd and any(c.isascii() and c.isalnum() for c in name)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def confusable(part: str) -> bool:
    stem, dot, suffix = part.rpartition(".")
    stem, suffix = (stem or part, suffix) if dot else (part, "")
    if looks_like_ascii(stem) or _has_letter(_ascii_form(stem)):
        return True
    if suffix and (looks_like_ascii(suffix) or _has_letter(_ascii_form(suffix))):
        return True
    return not any(c.isascii() for c in part) and _has_letter(_ascii_form(part, ".-_"))


def path_risks(path: str) -> list[str]:
    """The rules that a path breaks."""
    parts = [p for p in path.split("/") if p not in ("", ".", "..")]
    mixed = any(mixes_scripts(p.rpartition(".")[0] or p) for p in parts)
    posing = any(map(confusable, parts))
    return ["MIXED_SCRIPT_FILENAME"] * mixed + ["CONFUSABLE_FILENAME"] * posing
