import random

import numpy as np

import corpus_pipeline
from scriptorium.llm import near_dup, token_ids
from tests.llm.test_near_dup import groups, sign
from tests.llm.test_small_operators import brute_mix, toxic_texts


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    clean, toxic = toxic_texts(rng, 120)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(4, 9)))
    item = " ".join(word() for _ in range(20))
    unique = [" ".join(word() for _ in range(90)) for _ in range(60)]
    copies = [" ".join(w if rng.random() > 0.04 else word() for w in unique[k].split()) for k in range(10) for _ in range(2)]
    leaks = [" ".join(word() for _ in range(60)) + f" {item.upper()}. {word()}" for _ in range(5)]
    texts = clean + toxic + unique + copies + leaks + [None, "", "?!", unique[3]]
    n = len(clean)
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, None if t is None else len(t), "extra") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __gone string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k >= n)) for k in range(2 * n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    steps, docs = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        steps.append(docs.collect())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    ids = [sorted(r["doc_id"] for r in s) for s in steps]

    assert ids[0] == [k for k in range(len(texts)) if not n <= k < 2 * n]
    kept = {k: texts[k] for k in ids[0] if texts[k]}
    where, sig = sign(list(kept.values()))
    own = [list(kept)[w] for w in where]
    near = [(own[a], own[b]) for a in range(len(own)) for b in range(a) if (sig[a] != sig[b]).sum() <= near_dup.RADIUS]
    assert near and ids[1] == [k for k in ids[0] if k not in groups(near, own)]
    held = [k for k in ids[1] if texts[k] and item in " ".join(texts[k].lower().replace(".", " ").split())]
    assert held and ids[2] == [k for k in ids[1] if k not in held]
    source = {r[0]: r[3] for r in rows}
    mixed = brute_mix([(k, texts[k], source[k]) for k in ids[2]])
    assert ids[3] == sorted(k for k, _, _, c in mixed for _ in range(c))
    bpe = token_ids.pieces(token_ids.VOCABULARY)
    count = np.zeros(bpe.size, dtype=int)
    for k in ids[3]:
        np.add.at(count, bpe.encoding.encode_ordinary(texts[k] or ""), 1)
    token = np.lexsort((np.arange(bpe.size), -count))
    assert ids[4] == ids[3]
    for r in steps[4]:
        if texts[r["doc_id"]] is not None:
            ranks = token_ids.decode(bytes(r["control"]), bytes(r["data"]), r["n_tokens"])
            assert bpe.encoding.decode(token[ranks].tolist()) == texts[r["doc_id"]]

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, steps[4]))
