"""Numbers of chapters and verses as they are written."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain


def _class(*categories: str) -> str:
    """A regular expression's class of the characters of these Unicode categories beyond ASCII."""
    out, start = [], None
    for c in chain(range(128, 0x34000), range(0xE0000, 0xE1001)):  # no letter or mark stands elsewhere
        inside = unicodedata.category(chr(c))[0] in categories
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


_suffixed: list[re.Pattern] = []


def number_at(text: str) -> str:
    """The number, range or sequence that a text starts with."""
    if not _suffixed:
        letters = f"[A-Za-z{_class('L', 'M')}]*"
        _suffixed.append(re.compile(f"[0-9]+{letters}(?:‏?[-,][0-9]+{letters})*"))
    found = _suffixed[0].match(text)
    return found[0] if found else ""
