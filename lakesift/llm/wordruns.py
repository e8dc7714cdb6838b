"""Words as runs of ASCII letters, digits and characters beyond ASCII, with A-Z as a-z, over raw UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Each byte as its word form; bytes that part words become blanks.
_FORM = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _FORM[_low : _high + 1] = np.arange(_low, _high + 1)
_FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE = _FORM.tobytes()


def plain(raw: np.ndarray) -> np.ndarray:
    """The bytes in word form, as long as before, so that places stay."""
    return _FORM[raw]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()
