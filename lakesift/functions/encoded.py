"""Text that a line carries in hex or base64, and text in compatibility form."""

from __future__ import annotations

import base64
import binascii
import re
import string
import unicodedata
from collections.abc import Iterator

from lakesift.functions.runtime_pin import clean

#: What a token must be to be looked at, and how far decoding goes.
HEX_LEAST, BASE64_LEAST, A_LINE, DEPTH, MOST_BYTES, PRINTABLE_PERCENT = 64, 40, 16, 3, 1_000_000, 80
#: Tokens that long may hold text; the same test runs in the JVM before any line comes here.
GATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{40}"
#: Characters that may change in compatibility form: outside the plain letters and marks of western languages.
MAY_CHANGE = r"[^\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-ı‒-‖‘-•€]"
#: The same tests in forms that cost the JVM less: token characters one by one, which it looks up in a table, and one range
#: that tells ASCII before the others are tried.
_TOKEN = f"[{string.ascii_letters}{string.digits}+/=_\\-]"
JVM_GATE = f"(?<!{_TOKEN}){_TOKEN}{{40}}"
JVM_MAY_CHANGE = rf"[\x{{80}}-\x{{10FFFF}}&&{MAY_CHANGE}]"

_PARTS = re.compile(r"[ \t\n\r\"'`,;:()\[\]{}<>|]+")
_HEX = re.compile(r"(?:[0-9a-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+=*")


def compatible(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def candidates(line: str) -> Iterator[bytes | None]:
    """The bytes of the first A_LINE tokens that look encoded; None where one can't be decoded."""
    left = A_LINE
    for raw in _PARTS.split(line):
        token = clean(raw)
        low = token.lower().removeprefix("0x")
        if len(low) >= HEX_LEAST and _HEX.fullmatch(low):
            yield bytes.fromhex(low)
        elif len(token) >= BASE64_LEAST and _BASE64.fullmatch(token):
            yield unpacked(token)
        else:
            continue
        left -= 1
        if not left:
            return


def unpacked(token: str) -> bytes | None:
    """base64 in either alphabet, with padding that fits or without any; the two alphabets don't mix."""
    bare = token.rstrip("=")
    if len(bare) % 4 == 1 or (set(bare) & set("+/") and set(bare) & set("-_")):
        return None
    try:
        return base64.b64decode(bare.translate(str.maketrans("-_", "+/")) + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def readable(data: bytes | None) -> str | None:
    """The text of bytes that are UTF-8, mostly printable, and not too many."""
    if not data or len(data) > MOST_BYTES:
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    shown = sum(c in "\n\r\t" or unicodedata.category(c) != "Cc" for c in text)
    return text if shown * 100 // len(text) >= PRINTABLE_PERCENT else None


def decoded_lines(variants: list[str], depth: int = 0) -> Iterator[tuple[str, bool]]:
    """(text, whether it is a decoded line as it stands) of all that is encoded in variants, down to DEPTH levels."""
    if depth == DEPTH:
        return
    for variant in variants:
        for text in filter(None, map(readable, candidates(variant))):
            for line in text.replace("\r\n", "\n").split("\n"):
                if line.strip():
                    yield line, True
                    own = list(dict.fromkeys([line, compatible(line)]))
                    yield from ((v, False) for v in own[1:])
                    yield from decoded_lines(own, depth + 1)
