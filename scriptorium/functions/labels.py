"""Labels of numbered notes."""

from __future__ import annotations

_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
STYLES = ("numeric", "alpha", "alpha-upper", "roman", "roman-upper", "source")


def ordinal(n: int, style: str = "numeric") -> str:
    """A note's label: 1, 2, 3; a to z, aa; or i, ii, iii; ``source`` counts where the source gives no caller."""
    if style not in STYLES:
        raise ValueError(f"no such style: {style}")
    if style in ("numeric", "source"):
        return str(n)
    out = ""
    if style.startswith("roman"):
        for value, letters in _ROMAN:
            out, n = out + letters * (n // value), n % value
    else:
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
    return out.upper() if style.endswith("upper") else out
