import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import near_dup
from scriptorium.llm.textkernel import Words, passes

SCHEMA = "doc_id long, text string, keeper_id string"


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids if find(i) != i}


def sign(texts):
    rows, sig = [], []
    for lo, _, data, offsets in passes(pa.array(texts)):
        r, s = near_dup.signatures(Words(data, offsets))
        rows += (r + lo).tolist()
        sig.append(s)
    return rows, np.concatenate(sig)


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 10)))
    passage = " ".join(word() for _ in range(60))
    texts, planted = [], []
    for k in range(n):
        words = [word() for _ in range(rng.choice([4, 80, 200]))]
        texts.append(" ".join(words) + (" " + passage if k % 9 == 0 and len(words) == 200 else ""))
        for _ in range(rng.choice([0, 0, 0, 1, 6])):
            copy = list(words)
            for p in range(len(copy)):
                if rng.random() < 0.06:
                    copy[p] = word()
            planted.append((texts.index(" ".join(words)) if " ".join(words) in texts else len(texts) - 1, len(texts)))
            texts.append(" ".join(copy))
    return texts, planted


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, (200, near_dup.K), dtype=np.uint16)
    near = base.copy()
    for row in near:
        at = rng.choice(near_dup.K, near_dup.RADIUS, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, len(at), dtype=np.uint16)
    shared = (np.sort(near_dup.chunk_keys(base)) == np.sort(near_dup.chunk_keys(near))).any(axis=1)
    found = [len(np.intersect1d(a, b)) > 0 for a, b in zip(near_dup.chunk_keys(base), near_dup.chunk_keys(near))]
    assert all(found) and len(shared) == 200


def test_link_is_the_components_of_all_pairs():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 4, (60, near_dup.K), dtype=np.uint16)
    ids = rng.permutation(60)
    for radius in (40, 50, 55, 58):
        pairs = [(ids[a], ids[b]) for a in range(60) for b in range(a) if (sig[a] != sig[b]).sum() <= radius]
        got = near_dup.link(ids, sig, radius)
        assert {b: a for a, b in got} == groups(pairs, ids.tolist())


def test_groups_against_brute_force(spark):
    texts, planted = corpus(random.Random(3), 150)
    texts += [texts[0]] * 5 + ["", None, "?!", "the and", "the and", "of it"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA).repartition(6)
    rows, sig = sign(texts)
    pairs = [(rows[a], rows[b]) for a in range(len(rows)) for b in range(a) if (sig[a] != sig[b]).sum() <= near_dup.RADIUS]
    want = groups(pairs, rows)
    got = {r["doc_id"]: r["keeper_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == want
    long = [(a, b) for a, b in planted if len(texts[a].split()) >= 80]
    hit = [a == b or got.get(a, a) == got.get(b, b) for a, b in long]
    assert sum(hit) >= 0.9 * len(hit)
    left = near_dup.drop_near_duplicates(df)
    assert sorted(r["doc_id"] for r in left.collect()) == [k for k in range(len(texts)) if k not in want]
    assert left.columns == df.columns


def test_texts_of_short_words_are_compared_in_whole(spark):
    rng = random.Random(6)
    header = "measured values of pressure by station number"
    table = lambda: [str(rng.randrange(10**5)) for _ in range(2000)]
    prose = lambda: [rng.choice("the cat sat on a mat and saw how an old dog ran to us".split()) + rng.choice("abcdefgh") for _ in range(150)]
    numbers, words, other = table(), prose(), prose()
    texts = [f"{header} {' '.join(numbers)}", f"{header} {' '.join(table())}", f"other heading words entirely {' '.join(numbers)}"]
    texts += [" ".join(words + ["so", "so"]), " ".join(other + ["so", "so"]), " ".join(words[:70] + ["not"] + words[71:])]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["keeper_id"] for r in near_dup.near_duplicates(df).collect()} == {2: 0, 5: 3}


def shingles(text):
    """Words and neighbouring pairs, each as often as it occurs."""
    w = text.split()
    return Counter(w) + Counter(zip(w, w[1:]))


def test_unlike_documents_with_the_same_few_long_words_stay(spark):
    rng = random.Random(11)
    long = [f"considerable{k}" for k in range(12)]
    short = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 5)))
    texts = [" ".join(w for x in long for w in [*(short() for _ in range(42)), x]) for _ in range(5)]
    texts += [" ".join(w if rng.random() > 0.03 else short() for w in t.split()) for t in texts[:2]]
    like = {(a, b): sum((shingles(texts[a]) & shingles(texts[b])).values()) / sum((shingles(texts[a]) | shingles(texts[b])).values()) for a in range(7) for b in range(a + 1, 7)}
    assert all(j > 0.8 if p in ((0, 5), (1, 6)) else j < 0.1 for p, j in like.items())
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["keeper_id"] for r in near_dup.near_duplicates(df).collect()} == {5: 0, 6: 1}


@pytest.mark.parametrize("most", [1, 3, 20])
def test_large_buckets_lose_no_link(spark, most):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(6, 10)))
    change = lambda words, rate: [w if rng.random() > rate else word() for w in words]
    form = [word() for _ in range(120)]
    texts = [change(form, rate) for rate in (0.02, 0.1, 0.2, 0.3) for _ in range(25)]  # some near one another, some only to a few
    texts = [" ".join(t) for t in texts]
    rows, sig = sign(texts)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (sig[a] != sig[b]).sum() <= near_dup.RADIUS]
    want = groups(pairs, rows)
    assert 20 < len(want) < 99 and len(pairs) < 99 * 98 / 2
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA).repartition(6)
    assert {r["doc_id"]: r["keeper_id"] for r in near_dup.near_duplicates(df, most=most).collect()} == want


def test_ids_of_other_types_and_clashing_columns(spark):
    text = " ".join(f"considerable{k}" for k in range(40))
    rows = [("b", text, 1, "k", 2), ("a", text + " more", 1, "k", 2), (None, text, 1, "k", 2), ("c", "other words altogether", 1, "k", 2), ("d", None, 1, "k", 2)]
    df = spark.createDataFrame(rows, "doc_id string, text string, id long, key string, n long")
    assert [tuple(r) for r in near_dup.near_duplicates(df).collect()] == [("b", "a")]
    left = near_dup.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r["doc_id"] or "" for r in left.collect()) == ["", "a", "c", "d"]


@pytest.mark.parametrize("text, count", [("of", 1), ("of it", 3), ("of it is", 2), ("of it is so", 3), ("of it station", 3), ("of of", 1), ("station of it", 3)])
def test_every_word_is_in_a_feature(text, count):
    for rows in ([text], [text, "is a", text], ["", text]):
        for _, _, data, offsets in passes(pa.array(rows)):
            got = near_dup.features(Words(data, offsets))[1]
        assert got[-1] == count


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"considerable{k}" for k in range(40))
    df = spark.createDataFrame([(7, text, None), (7, text, None), (None, text, None), (9, text + " more", None)], SCHEMA)
    assert [tuple(r) for r in near_dup.near_duplicates(df).collect()] == [(9, 7)]
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in near_dup.drop_near_duplicates(df).collect() if r["doc_id"]) == [(False, 7), (False, 7)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(5)
    words = [f"word{rng.randrange(10**6)}" for _ in range(300_000)]
    df = spark.createDataFrame([(1, " ".join(words), None), (2, " ".join(words[:-5]), None), (3, " ".join(reversed(words)), None)], SCHEMA)
    got = {r["doc_id"]: r["keeper_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got.get(2) == 1


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 60)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    ids = sorted({x for e in edges for x in e})
    assert {r["id"]: r["root"] for r in near_dup.components(df).collect()} == groups(edges, ids)
