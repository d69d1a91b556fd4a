"""Alignment of the tokens of two versions of a block."""

from __future__ import annotations

from scriptorium.operators.scan import Token

Pair = tuple[str, int | None]  # what became of a token, and its counterpart


def _key(t: Token) -> tuple:
    """What makes two tokens the same: not a marker's spacing, a number's spacing or a line break's form."""
    if t.kind in ("Marker", "EndMarker", "Milestone", "MilestoneEnd"):
        return t.kind, t.marker
    return t.kind, None if t.kind == "Newline" else t.text.strip() if t.kind == "Number" else t.text


def _rows(x: list, y: list) -> list[int]:
    """For each i, as bits, where the longest common subsequence of x[i:] and y[j:] gets longer as j falls: bit len(y) - 1 - j.

    So its length is the number of bits below len(y) - j; a row is len(y) bits
    and not as many numbers.
    """
    at: dict = {}
    for j, key in enumerate(reversed(y)):
        at[key] = at.get(key, 0) | 1 << j
    all_ = (1 << len(y)) - 1
    out, v = [0] * (len(x) + 1), all_
    for i in reversed(range(len(x))):
        u = v & at.get(x[i], 0)
        v = (v + u | v - u) & all_
        out[i] = ~v & all_
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence; equal ends are set aside first."""
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out, i, j = [(k, k) for k in range(head)], 0, 0
    best = _rows(x, y) if x and y else []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((head + i, head + j))
            i, j = i + 1, j + 1
            continue
        rest = len(y) - j
        if (best[i + 1] & (1 << rest) - 1).bit_count() >= (best[i] & (1 << rest - 1) - 1).bit_count():
            i += 1
        else:
            j += 1
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def _shape(t: Token) -> tuple:
    return t.kind, t.marker


def align(original: list[Token], current: list[Token]) -> tuple[list[Pair], list[Pair]]:
    """Unchanged tokens first; between them, tokens of one kind and marker are modified, others deleted or added."""
    left: list[Pair] = [("Deleted", None)] * len(original)
    right: list[Pair] = [("Added", None)] * len(current)
    same = common([_key(t) for t in original], [_key(t) for t in current])
    for i, j in same:
        left[i], right[j] = ("Unchanged", j), ("Unchanged", i)
    edges = [(-1, -1), *same, (len(original), len(current))]
    for (i0, j0), (i1, j1) in zip(edges, edges[1:]):
        if i1 - i0 == 1 or j1 - j0 == 1:
            continue
        for i, j in common([_shape(t) for t in original[i0 + 1 : i1]], [_shape(t) for t in current[j0 + 1 : j1]]):
            left[i0 + 1 + i], right[j0 + 1 + j] = ("Modified", j0 + 1 + j), ("Modified", i0 + 1 + i)
    return left, right
