import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import class_lm, media
from scriptorium.llm.textkernel import Words, passes
import pyarrow as pa


def picture(rng, h, w, color):
    return rng.integers(0, 256, (h, w, media.CHANNELS[color]), dtype=np.uint8)


@pytest.mark.parametrize("color", [0, 2, 4, 6])
def test_png_round_trip(color):
    rng = np.random.default_rng(color)
    for h, w in ((1, 1), (5, 3), (17, 40)):
        pixels = picture(rng, h, w, color)
        head, rows, palette = media.parse(media.encode_png(pixels, color, rng.integers(0, 5, h), 7))
        raw = media.unfilter(np.stack([rows, rows]), head.step)
        assert (raw[1] == pixels.reshape(h, -1)).all()
        assert (head.width, head.height, head.color) == (w, h, color) and len(palette) == 0


def plain_unfilter(rows, step):
    """Byte by byte, as the format says."""
    out = [[0] * len(r[1:]) for r in rows]
    for y, r in enumerate(rows):
        for x, v in enumerate(r[1:]):
            a = out[y][x - step] if x >= step else 0
            b = out[y - 1][x] if y else 0
            c = out[y - 1][x - step] if y and x >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y][x] = (int(v) + (0, a, b, (a + b) // 2, near)[r[0]]) % 256
    return np.array(out, dtype=np.uint8)


@pytest.mark.parametrize("step", [1, 2, 3, 4, 6, 8])
def test_unfilter_against_brute_force(step):
    rng = np.random.default_rng(step)
    for h, w in ((1, step), (7, 5 * step), (12, 3 * step)):
        rows = rng.integers(0, 256, (3, h, w + 1), dtype=np.uint8)
        rows[:, :, 0] = rng.integers(0, 5, (3, h))
        want = np.stack([plain_unfilter(r.tolist(), step) for r in rows])
        assert (media.unfilter(rows, step) == want).all()
        cut = h // 2
        if cut:
            assert (media.unfilter(rows[:, cut:], step, want[:, cut - 1]) == want[:, cut:]).all()


def any_png(samples, depth, color, laced, palette=None, rng=None, spoil=None):
    """A PNG of samples [row, column, channel], unlike the module's own encoder of any depth, and interlaced if asked for."""
    h, w, per = samples.shape
    raw, step = b"", max(1, per * depth // 8)
    for y0, dy, x0, dx in media.ADAM7 if laced else ((0, 1, 0, 1),):
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        bits = "".join("".join(f"{v:0{depth}b}" for v in row.ravel()) + "0" * (-row.size * depth % 8) for row in part)
        flat = np.frombuffer(int(bits, 2).to_bytes(len(bits) // 8, "big"), dtype=np.uint8).reshape(part.shape[0], -1)
        kinds = rng.integers(0, 5, len(flat)) if rng is not None else np.zeros(len(flat), dtype=int)
        for y, row in enumerate(flat.astype(int)):
            up = flat[y - 1].astype(int) if y else row * 0
            left, corner = (np.concatenate([np.zeros(step, int), x[:-step]]) if len(x) > step else x * 0 for x in (row, up))
            p = left + up - corner
            da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
            paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
            guess = (row * 0, left, up, (left + up) // 2, paeth)[kinds[y]]
            raw += bytes([kinds[y]]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    body = zlib.compress(raw)
    body = spoil(body) if spoil else body
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([depth, color, 0, 0, int(laced)])
    return media.SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", body) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize("color, depth", [(c, d) for c, depths in media.DEPTHS.items() for d in depths])
def test_every_kind_of_png(color, depth, laced, monkeypatch):
    rng = np.random.default_rng(color * 100 + depth)
    for h, w in ((37, 41), (1, 3), (3, 1), (8, 8)):
        samples = rng.integers(0, 1 << depth, (h, w, media.CHANNELS[color]))
        palette = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8) if color == 3 else None
        luma = samples / ((1 << depth) - 1) * 255 if depth != 16 else samples / 256
        luma = palette[samples[:, :, 0]] @ [0.299, 0.587, 0.114] if color == 3 else luma[:, :, :3] @ [0.299, 0.587, 0.114] if color in (2, 6) else luma[:, :, 0]
        luma = luma * samples[:, :, -1] / ((1 << depth) - 1) if color in (4, 6) and depth == 8 else luma * (samples[:, :, -1] / 256) / 255 if color in (4, 6) else luma
        png = any_png(samples, depth, color, laced, palette, rng)
        want = ("ok", w, h, media.cosine_hash(luma))
        assert media.decode_all([png, png]) == [want, want]
        monkeypatch.setattr(media, "AT_ONCE", 0)  # as if it were large: by bands
        monkeypatch.setattr(media, "BAND", 100)
        assert media.decode_all([png]) == [want]
        monkeypatch.undo()


def test_the_inflated_datas_checksum_must_be_there_and_right():
    samples = np.arange(64).reshape(8, 8, 1)
    for laced in (False, True):
        kinds = {"truncated data": lambda b: b[:-4], "bad data": lambda b: b[:-1] + bytes([b[-1] ^ 1]), "bad size": lambda b: zlib.compress(zlib.decompress(b) + b"x"), "ok": None}
        for status, spoil in kinds.items():
            assert media.decode_all([any_png(samples, 8, 0, laced, spoil=spoil)])[0][0] == status
    assert media.decode_all([any_png(samples, 8, 3, False)])[0][0] == "no palette"


def test_a_large_picture():
    y, x = np.mgrid[0:3000, 0:4000]
    pixels = ((np.sin(x / 500) + np.cos(y / 300)) * 60 + 128).astype(np.uint8)[:, :, None]
    start = time.perf_counter()
    got = media.decode_all([media.encode_png(pixels, 0, np.arange(3000) % 5, 1 << 16)])
    assert got == [("ok", 4000, 3000, media.cosine_hash(pixels[:, :, 0].astype(float)))] and time.perf_counter() - start < 30


def test_hash_is_the_cosine_transform():
    rng = np.random.default_rng(3)
    pixels = picture(rng, 32, 32, 0)
    low = np.array([[sum(pixels[y, x, 0] * math.cos(math.pi * (y + 0.5) * u / 32) * math.cos(math.pi * (x + 0.5) * v / 32) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)])
    bits = (low.ravel() > np.median(low.ravel()[1:])).astype(int)
    assert media.cosine_hash(pixels[:, :, 0].astype(float)) == np.packbits(bits).tobytes()


def test_small_changes_keep_the_hash_near():
    rng = np.random.default_rng(4)
    a = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8)))
    far = lambda x, y: bin(int.from_bytes(media.cosine_hash(x), "big") ^ int.from_bytes(media.cosine_hash(y), "big")).count("1")
    assert far(a, np.clip(a + rng.normal(0, 4, a.shape), 0, 255)) <= 6
    assert far(a, a[::2, ::2]) <= 6
    assert far(a, np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8)))) > 12


def test_faults_have_a_status(spark):
    good = media.encode_png(np.full((4, 4, 1), 9, dtype=np.uint8), 0, np.zeros(4, dtype=int))
    bad = {1: good, 2: None, 3: b"", 4: good[:-3], 5: good[:20] + b"\1" + good[21:], 6: b"GIF89a" + good, 7: good[:8] + good[33:]}
    df = spark.createDataFrame([(k, v, "x") for k, v in bad.items()] + [(1, good, "y")], "id long, png binary, status string")
    out = {r["id"]: r for r in media.image_hashes(df, "id").collect()}
    assert {k: r["status"] for k, r in out.items()} == {1: "ok", 2: "null", 3: "not a PNG", 4: "truncated", 5: "bad checksum", 6: "not a PNG", 7: "no header"}
    assert (out[1]["width"], out[1]["height"], len(out[1]["phash"])) == (4, 4, 8) and out[2]["phash"] is None
    assert media.image_hashes(df.limit(0), "id").count() == 0


def test_pictures_of_embeddings(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9, 0.3, 0.4]), (2, None), (3, []), (4, [1.0, None]), (5, [0.1, 0.9, 0.3, 0.4])], "vec_id long, embedding array<float>")
    out = {r["vec_id"]: r for r in media.image_hashes(media.pictures(df), "vec_id").collect()}
    assert [out[k]["status"] for k in (1, 2, 3, 4)] == ["ok", "null", "null", "ok"]
    assert out[1]["phash"] == out[5]["phash"]  # colour and filters differ, the picture doesn't


def test_checksum_is_the_formats():
    assert zlib.crc32(b"IEND") == 0xAE426082


# ---- class-based language model


def likelihood(of, a, b, n):
    grid, left, right, total = Counter(), Counter(), Counter(), 0
    for x, y, c in zip(of[a], of[b], n):
        grid[x, y] += c
        left[x] += c
        right[y] += c
    return sum(c * math.log(c / (left[x] * right[y])) for (x, y), c in grid.items())


def test_exchange_raises_the_likelihood_and_finds_classes():
    rng = random.Random(1)
    fixed = class_lm.RARE + 1
    kinds = [[fixed + 3 * k + c for k in range(8)] for c in range(3)]
    pairs = Counter()
    for _ in range(4000):
        c = rng.randrange(3)
        pairs[rng.choice(kinds[c]), rng.choice(kinds[(c + 1) % 3])] += 1
    a, b, n = (np.array(x) for x in zip(*[(x, y, c) for (x, y), c in pairs.items()]))
    size = fixed + 24
    start = class_lm.exchange(a, b, n, size, 3, 0)
    done = class_lm.exchange(a, b, n, size, 3, 5)
    assert likelihood(done, a, b, n) > likelihood(start, a, b, n) or likelihood(start, a, b, n) == pytest.approx(likelihood(done, a, b, n))
    shuffled = class_lm.exchange(a, b, n, size, 3, 10)
    assert len({tuple(sorted({shuffled[w] for w in k})) for k in kinds}) == 3


def test_each_exchange_step_is_the_best_move():
    rng = np.random.default_rng(2)
    fixed, words, classes = class_lm.RARE + 1, 7, 3
    size = fixed + words
    a, b = (x.ravel() for x in np.meshgrid(np.arange(fixed, size), np.arange(fixed, size)))
    n = rng.integers(1, 20, len(a))
    done = class_lm.exchange(a, b, n, size, classes, 50)
    best = likelihood(done, a, b, n)
    for w in range(fixed, size):
        for c in range(fixed, fixed + classes):
            other = done.copy()
            other[w] = c
            assert likelihood(other, a, b, n) <= best + 1e-6


def numbered(model, text):
    return next((model.vocabulary.numbers(Words(data, offsets)).tolist() for _, _, data, offsets in passes(pa.array([text or ""]))), [])


def hashes(words):
    return [int(next(Words(data, offsets) for _, _, data, offsets in passes(pa.array([w]))).hashes.view(np.int64)[0]) for w in words]


@pytest.mark.parametrize("block", [1, 1 << 19])
def test_perplexity_against_brute_force(spark, monkeypatch, block):
    """Vocabulary, counts, classes of the less frequent words, probabilities and sums, all from plain words."""
    monkeypatch.setattr(class_lm, "BLOCK", block)
    rng = random.Random(3)
    words = ["the", "cat", "dog", "sees", "runs", "Über", "a"]
    rare = [f"rare{k}ing" for k in range(60)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.9 else rng.choice(rare) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    texts += [None, "", "...", texts[0]]
    df = spark.createDataFrame([(f"d{k}", t, 1.0, 5) for k, t in enumerate(texts)], "doc_id string, text string, perplexity double, n int")
    share, classes, start = 0.02, 4, class_lm.RARE
    out = {r["doc_id"]: r for r in class_lm.perplexity(df, share, classes).collect()}
    model, _ = class_lm.fit(df, share, classes)
    plain = [[w.lower() for w in (t or "").replace("...", "").split()] for t in texts]
    total = Counter(w for p in plain for w in p)
    kept = {w for w, c in total.items() if c >= share * sum(total.values())}
    shape, number = {}, {}
    for t, p in zip(texts, plain):
        own = numbered(model, t)
        assert len(own) == len(p)
        for w, x in zip(p, own):
            assert (x > start) == (w in kept)
            (number if w in kept else shape)[w] = x
    assert sorted(number.values()) == list(range(start + 1, start + 1 + len(kept)))

    # the frequent words' model, in which the others are of their shape classes
    early = lambda w: int(model.of[number[w]]) if w in kept else shape[w]
    k = start + 1 + classes
    follow, row, size = Counter(), Counter(), Counter()
    for p in plain:
        for x, y in zip([start] + [early(w) for w in p], map(early, p)):
            follow[x, y] += 1
            row[x] += 1
    for w in kept:
        size[early(w)] += total[w] + 1
    step = lambda x, y: math.log((follow[x, y] + 1) / (row[x] + k - 1))
    of = {w: early(w) for w in kept} | {w: shape[w] for w in total if total[w] == 1}
    later = sorted(w for w in total if w not in kept and total[w] > 1)
    assert len(later) > 20 and len(of) > len(kept)
    for w in later:
        score = Counter()
        for c in range(start + 1, k):
            for p in plain:
                for j, x in enumerate(p):
                    if x == w:
                        score[c] += step(early(p[j - 1]) if j else start, c) + (step(c, early(p[j + 1])) if j + 1 < len(p) else 0)
            score[c] += total[w] * (math.log(total[w] + 1) - math.log(size[c] + total[w] + 1))
        of[w] = max(range(start + 1, k), key=lambda c: (round(score[c], 9), -c))
    stored = {r["word"]: (r["of"], r["n"]) for r in model.tail.collect()}
    assert stored == dict(zip(hashes(later), [(of[w], total[w]) for w in later]))

    # the whole model
    follow, row, size, types = Counter(), Counter(), Counter(), Counter()
    for p in plain:
        for x, y in zip([start] + [of[w] for w in p], [of[w] for w in p]):
            follow[x, y] += 1
            row[x] += 1
    for w, n in total.items():
        size[of[w]] += n + 1
        types[of[w]] += 1
    for j, p in enumerate(plain):
        r = out[f"d{j}"]
        assert r["n_words"] == len(p)
        if not p:
            assert r["perplexity"] is None and r["log_prob"] == 0
            continue
        lp = sum(step(x, of[w]) + (-math.log(types[of[w]]) if of[w] < start else math.log((total[w] + 1) / size[of[w]])) for x, w in zip([start] + [of[w] for w in p], p))
        assert r["log_prob"] == pytest.approx(lp) and r["perplexity"] == pytest.approx(math.exp(-lp / len(p)))
    assert class_lm.perplexity(df.limit(0)).count() == 0


def test_a_very_long_text_repeated_rows_and_null_ids(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(700_000))
    df = spark.createDataFrame([(1, long), (2, "w1 w2 w3"), (2, "w1 w2 w3"), (None, "w1 w2 w3")], "doc_id long, text string")
    out = class_lm.perplexity(df).collect()
    assert sorted(r["n_words"] for r in out) == [3, 3, 3, 700_000] and len({r["log_prob"] for r in out}) == 2
    assert 1000 < next(r["perplexity"] for r in out if r["doc_id"] == 1) < 6000


def test_words_below_the_share_keep_counts_and_get_classes(spark):
    rng = random.Random(4)
    animals, verbs = ["cat", "dog", "cow"], ["sees", "runs", "eats"]
    texts = [" ".join(w for _ in range(10) for w in (rng.choice(animals), rng.choice(verbs))) for _ in range(100)]
    texts += ["cat sees lynx runs dog eats"] * 25 + ["cow runs wolx eats cat sees"] * 6 + ["dog naps cow runs"] * 7 + ["cat onlx sees"] * 4
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    model, coded = class_lm.fit(df, 0.05, 2, least=5)
    tail = {r["word"]: (r["of"], r["n"]) for r in model.tail.collect()}
    of = model.of[numbered(model, "cat sees")]
    assert tail == dict(zip(hashes(["lynx", "wolx", "naps"]), [(of[0], 25), (of[0], 6), (of[1], 7)]))
    probe = spark.createDataFrame(list(enumerate(["sees lynx runs", "sees wolx runs", "sees cat runs"])), "doc_id long, text string")
    score = [r["log_prob"] for r in class_lm.scored(class_lm.code(probe, model), model).orderBy("doc_id").collect()]
    assert score[0] - score[1] == pytest.approx(math.log(26 / 7))
    total = Counter(w for t in texts for w in t.split())
    assert score[2] - score[0] == pytest.approx(math.log((total["cat"] + 1) / 26))
    for c in set(of.tolist()):
        p = np.exp(model.emission[class_lm.RARE + 1 :][model.of[class_lm.RARE + 1 :] == c]).sum()
        assert p + sum((n + 1) / model.inside[c] for x, n in tail.values() if x == c) == pytest.approx(1)


def test_the_number_of_frequent_words_is_bounded(spark):
    texts = [" ".join(f"w{k % 40}" for k in range(j, j + 25)) for j in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = class_lm.fit(df, 0.0, 3, frequent=10)
    assert len(model.vocabulary.keys) == 10 and model.tail.count() == 30
