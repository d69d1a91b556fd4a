import random

from scriptorium.operators.align import align, common
from scriptorium.operators.scan import tokens


def test_common_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        pairs = common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        longest = max(sum(1 for k in range(len(a)) if m >> k & 1) for m in range(1 << len(a)) if (lambda s, it: all(c in it for c in s))([a[k] for k in range(len(a)) if m >> k & 1], iter(b)))
        assert len(pairs) == longest


def test_alignment():
    old, new = tokens("\\v 1 one \\nd two\\nd* three"), tokens("\\v 1 ONE \\nd two\\nd*\n three")
    left, right = align(old, new)
    assert [c for c, _ in left] == ["Unchanged", "Unchanged", "Modified", "Unchanged", "Unchanged", "Unchanged", "Unchanged"]
    assert right[-2][0] == "Added" and all(left[j][1] == k for k, (c, j) in enumerate(right) if c != "Added")
    assert align(old, old)[0] == [("Unchanged", k) for k in range(len(old))] and align([], []) == ([], [])
