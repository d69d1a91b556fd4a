"""What keeps time, memory and shuffled bytes in proportion to the input."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import blocks, convert, documents, formatting, relations
from scriptorium.operators.align import common
from scriptorium.plans import catalog, synth
from tests.test_trees import TEXT

DEEP = "\\p " + "\\nd a " * 3000  # nested beyond what a recursion can follow


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def passes_of(df):
    return plan(df).count("MapInArrow")


@pytest.fixture(scope="module")
def docs(spark):
    texts = [TEXT, "", None, DEEP, *(f"\\id GEN\n\\c 1\n\\p\n\\v 1 one\n{x}" for x in synth.ENDINGS.values())]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, source string").cache()


def test_faults_are_counted_in_one_pass(docs):
    got = documents.faults(docs)
    assert passes_of(got) == 1
    usx = documents.to_usx(docs).drop("error")
    each = [documents.to_usj(docs), documents.to_usx(docs), documents.to_html(docs), documents.formatted(docs), documents.usx_to_usj(usx)]
    want = sum(df.where("error IS NOT NULL").count() for df in each)
    assert tuple(got.first()) == (want, docs.count()) and want == 3
    assert tuple(documents.faults(docs.limit(0)).first()) == (0, 0)


def test_streams_are_shuffled_as_packed_runs(spark, docs):
    stream = relations.tokens(docs.where("source IS NOT NULL"))
    got = documents.lint_stream(stream)
    assert "Aggregate" in plan(got) and passes_of(got) == 3, "no packing before the shuffle"
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got) == key(relations.lint(docs.where("source IS NOT NULL")).where("code <> 'missing-id-marker' OR doc_id <> 1"))
    mixed = stream.orderBy(F.xxhash64("text", "idx")).repartition(5)
    assert key(documents.lint_stream(mixed)) == key(got) and key(documents.blocks_stream(mixed)) == key(documents.blocks_stream(stream))


def test_a_stream_s_documents_are_ordered_and_bounded(spark):
    rows = [(None, 0, "Text", "a"), ("x", 1, "Text", "c"), ("x", 0, "Text", "b"), (None, 1, "Text", "d"), ("x", 1, "Text", None)]
    made = documents.formatted_stream(spark.createDataFrame(rows, "doc_id string, idx int, kind string, text string"), only=[])
    assert {(r["doc_id"], r["text"]) for r in made.collect()} == {(None, "ad"), ("x", "bc")}


def same_rows(a, b):
    rows = lambda df: sorted(map(repr, df.drop("error").collect()))
    return rows(a) == rows(b)


def test_usj_and_back_is_one_pass(spark, docs):
    got = catalog.queries()["usj_to_usfm"](spark, "/root/testdata/sf0.001")
    assert passes_of(got) == 1 and same_rows(documents.through_usj(docs), documents.from_usj(documents.to_usj(docs)))
    assert documents.through_usj(docs).where("error IS NOT NULL").count() == 1


def test_large_texts_are_given_back_in_parts(spark):
    usj = documents.to_usj(spark.createDataFrame([(k, "\\p " + "word " * 100_000) for k in range(6)], "doc_id long, source string")).coalesce(1)
    parts = documents.from_usj(usj).select(F.length("source").alias("n"))
    assert [r["n"] for r in parts.collect()] == [500_004] * 6


def test_a_round_trip_converts_nothing_twice():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 4)
        there, back = ([rng.randrange(n) for _ in range(n)] for _ in range(2))
        called = []
        step = lambda f, x: called.append((id(f), x)) or f[x]
        for x in range(n):
            made = back[there[x]]
            want = back[there[made]] == made and there[back[there[made]]] == there[made]
            called.clear()
            assert documents.stays(x, lambda y: step(there, y), lambda y: step(back, y)) == want
            assert len(called) == len(set(called)) <= 4


def test_reverts_look_at_each_token_once(monkeypatch):
    a = [(f"GEN 1:{k}", f"GEN-{k}", "old ") for k in range(400)]
    b = [(sid, id_, "new ") for sid, id_, _ in a if int(id_[4:]) % 3] + [("GEN 2:1", "GEN-x", "more ")]
    ids = [d.block_id for d in blocks.diff(blocks.of_tokens(a), blocks.of_tokens(b))]
    seen = []
    of_tokens = blocks.of_tokens
    monkeypatch.setattr(blocks, "of_tokens", lambda tokens, *more: seen.append(len(tokens)) or of_tokens(tokens, *more))
    assert blocks.revert(ids, a, b) == a and sum(seen) <= len(a) + len(b)


def test_reverts_are_those_of_blocks_counted_anew():
    rng = random.Random(7)
    for _ in range(2000):
        sids = [f"GEN 1:{k}" for k in range(4)] + [None]
        a, b = ([(rng.choice(sids), f"GEN-{k}", rng.choice("xy")) for k in range(rng.randint(0, 9))] for _ in range(2))
        ids = [x for x, p, q in blocks.matched(blocks.of_tokens(a), blocks.of_tokens(b)) if rng.random() < 0.8] + [f"{rng.choice(sids)}::GEN-{rng.randint(0, 9)}", ""]
        rng.shuffle(ids)
        assert blocks.revert(ids, a, b) == blocks._revert_counted(ids, a, b)


def test_blocks_to_revert_are_chosen_in_the_same_pass(spark):
    got = catalog.queries()["revert_block"](spark, "/root/testdata/sf0.001")
    assert passes_of(got) == 1 and "Join" not in plan(got) and "Window" not in plan(got)


def test_texts_without_special_characters_are_not_copied():
    plain = "no special characters"
    assert convert.xml_escape(plain) is plain and convert.html_escape(plain) is plain
    assert convert.xml_escape("a<b>&\"'") == "a&lt;b&gt;&amp;&quot;&apos;" and convert.html_escape("a<b>&\"'") == "a&lt;b&gt;&amp;&quot;&#39;"
    assert all(convert.xml_escape(c) != c and convert.html_escape(c) != c for c in "&<>\"'")


@pytest.mark.parametrize("name", ["usx_to_usfm", "usx_to_usj"])
def test_usx_and_back_is_one_pass(spark, docs, name):
    assert passes_of(catalog.queries()[name](spark, "/root/testdata/sf0.001")) == 1
    usx = documents.to_usx(docs)
    assert same_rows(documents.through_usx(docs), documents.from_usx(usx)) and same_rows(documents.usj_through_usx(docs), documents.usx_to_usj(usx))


def test_alignment_of_large_blocks_takes_bits_and_not_lists():
    rng = random.Random(9)
    a, b = ([rng.randrange(40) for _ in range(1200)] for _ in range(2))
    tracemalloc.start()
    pairs = common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6 and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len(pairs) > 200


def test_blocks_are_aligned_in_the_pass_that_finds_them(spark):
    pairs = spark.createDataFrame([(k, TEXT, TEXT.replace("One", "ONE").replace("line", "a line")) for k in range(3)], "doc_id long, baseline string, current string")
    got, apart = documents.aligned_pairs(pairs), documents.aligned(relations.block_diff(pairs))
    assert passes_of(got) == passes_of(catalog.queries()["token_alignment"](spark, "/root/testdata/sf0.001")) == 1
    assert sorted(map(repr, got.collect())) == sorted(map(repr, apart.collect())) and got.count() > 0


def test_formatting_keeps_small_pieces_and_the_same_texts():
    assert not hasattr(formatting.Piece("Text", "x"), "__dict__")
    source = "\\p   a \t b\n\\v 1 1 x\n\\v 2\n\\cl l\n\\c 2 \\p\\b\n\\q1\n\\nd n\\nd*word"
    assert formatting.format_usfm(source) == "\\p\n a b \\v 1  x \\v 2\n\\c 2\n\\cl l\n \n\\p\n\\b\n\\q1\n\\nd n\\nd*word"


def test_chapters_of_a_diff_are_not_copied_for_each_chapter(monkeypatch):
    a = [(f"{book} {c}:1", f"{book}-{c}", "old") for book in ("GEN", "EXO") for c in range(1, 40)]
    b = [(sid, id_, "new") for sid, id_, _ in a]
    monkeypatch.setattr(blocks, "replaced", None)
    got = blocks.by_chapter(blocks.of_tokens(a), blocks.of_tokens(b))
    assert list(got) == ["EXO", "GEN"] and list(got["GEN"]) == list(range(1, 40)) and all(d.status == "Modified" for d in blocks.flattened(got))


def test_unchanged_blocks_are_stripped_of_markers_once(monkeypatch):
    one, seen = blocks.of_tokens([("GEN 1:1", "GEN-1", "\\p  a\tb ")]), []
    plain = blocks.plain
    monkeypatch.setattr(blocks, "plain", lambda text: seen.append(text) or plain(text))
    assert blocks.diff(one, one)[0].current_text_only == "a b" and len(seen) == 1
