"""The columnar kernels on small documents, by hand and against the other tokenizer and the SQL plans."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.operators import blocks, columns, documents, issues, relations, rules, verses
from scriptorium.operators.scan import tokens
from scriptorium.plans import lint, synth, vref
from scriptorium.plans import tokens as sql_tokens

SOURCES = [
    "\\id GEN Sample\n\\c 1\n\\p\n\\v 1 In the beginning\n\\v 2-3a And so\n",
    "\\id MAT\n\\c 2\n\\p\n\\v 1 Text\\f + \\ft a \\+nd b\\+nd* c\\f* more\n",
    '\\id MAT\n\\c 1\n\\p \\w grace|lemma="a \\" b" strong="H1"\\w* x|y\n',
    '\\v\n12 lost \\ / // \\Zed a/b |key="open\r\n',
    "  \t", "  \n \\p x", "\\id GÉN x\n\\c 1\n\\v 1 É", "", "\\v 4e\u0301,6-7 marks \\v 0 none \\v 99999999999999999999 big", "\\c 1\\v 2\\v 3 \\v 4", "\\qt-s |sid=\"1\"\\*a\\qt-e\\*", "\\",
]


def made(texts):
    return [columns.Tokens(data, off) for _, _, data, off in columns.passes(pa.array(texts, pa.string()))]


def test_tokens_are_those_of_the_plain_scanner():
    rng = random.Random(2)
    bits = ["\\id GEN ", "\\c 1", "\\v 2", " 3-4", "\n", " ", "\t", "\\p", "\\f + \\ft x\\f*", "|a=\"b\"", "//", "/", "\\", "\\*", "é", "text", "\\w", "\\w*", "\\ts-s", "\r\n", "12a,13", "\\+nd", "\\zx-3"]
    texts = SOURCES + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for t in made(texts):
        for d, text in enumerate(texts):
            assert t.listed(d) == tokens(text), text
            assert "".join(x.text for x in t.listed(d)) == text


def test_numbers_with_combining_marks_and_limits():
    t = made([SOURCES[8]])[0]
    at = np.flatnonzero(t.kind == columns.NUMBER).tolist()
    assert [(t.text(k).strip(), int(t.num_start[k]), int(t.num_end[k]), int(t.num_shape[k])) for k in at] == [("4e\u0301,6-7", 4, 7, 3)]


def docs(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "doc_id long, source string")


def test_rows_with_one_id_or_none_and_nulls_are_documents_of_their_own(spark):
    df = docs(spark, [SOURCES[0], SOURCES[1], None, SOURCES[0], ""], [7, 7, None, None, 8])
    got = [(r["doc_id"], r["source"]) for r in relations.sources(df).collect()]
    assert sorted(got, key=repr) == sorted([(7, SOURCES[0]), (7, SOURCES[1]), (None, SOURCES[0])], key=repr)
    assert sorted(r["first_book"] or "" for r in relations.books(df).collect()) == ["", "", "GEN", "GEN", "MAT"]
    assert relations.tokens(df.limit(0)).count() == 0 and relations.lint(df.limit(0)).count() == 0


def test_last_book_is_the_last_not_the_greatest(spark):
    r = relations.books(docs(spark, ["\\id ZEP x\n\\c 1\n\\id GEN y\n"])).first()
    assert (r["first_book"], r["last_book"]) == ("ZEP", "GEN")


def test_the_sql_plans_give_the_same_on_spark(spark):
    """The same SQL that another engine runs, on Spark, where it needs no Python."""
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).createOrReplaceTempView("some_documents")
    from scriptorium.functions.dialect import SPARK

    df = spark.sql(synth.usfm_docs(SPARK, "some_documents"))
    same = lambda a, b: sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))
    assert same(relations.tokens(df), sql_tokens.tokens(df))
    assert same(relations.lint(df), sql_tokens.over(df, lint.lint))
    assert same(relations.verse_text(df), sql_tokens.over(df, lambda d, q: f"WITH {vref.verses(d, q)} SELECT doc_id, ref, text FROM verses"))


# ---- lint

CASES = [
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 2 b", []),
    ("", []),
    ("\\c 1\n\\p\n\\v 1 a", ["missing-id-marker"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 1 b", ["duplicate-verse-number"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 4 b", ["verse-expected-increase-by-one"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1-3 a\n\\v 2 b", ["duplicate-verse-number"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1-20000 a\n\\v 15000 b", ["duplicate-verse-number"]),
    ("\\id GEN\n\\c 2\n\\p\n\\v 1 a", ["chapter-expected-increase-by-one"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\c 1\n\\p\n\\v 2 b", ["chapter-expected-increase-by-one", "duplicate-chapter-number"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a \\xyz b\\xyz*", ["stray-close-marker", "unknown-close-marker", "unknown-marker"]),
    ("\\id GEN\n\\c 1\n\\p\n\\p\n\\v 1 a", ["empty-paragraph"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v", ["missing-verse-number", "verse-range-expected-after-verse-marker"]),
    ("\\id GEN\n\\c\n\\p\n\\v 1 a", ["missing-chapter-number", "number-range-after-chapter-marker"]),
    ("\\id GEN\n\\c 1\n\\pText \\v 1 a", ["missing-separator-after-marker"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 ", ["verse-text-follows-verse-range"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\id EXO b", ["duplicate-id-marker", "id-marker-not-at-file-start", "marker-not-valid-in-context"]),
    ("\\id GEN\n\\p\n\\v 1 a", ["paragraph-before-first-chapter", "verse-before-first-chapter"]),
    ("\\id GEN\n\\c 1\n\\p \\ca 2\\ca* x \\va 3\\va*\n\\v 1 a", ["chapter-metadata-outside-chapter", "marker-not-valid-in-context", "verse-metadata-outside-verse"]),
    ("\\id GEN\n\\c 1\n\\cl Part 1\n\\p\n\\v 1 a\n\\c 2\n\\cl Part 2\n\\p\n\\v 1 b\n\\c 3\n\\cl Song 3\n\\p\n\\v 1 c", ["inconsistent-chapter-label"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a \\qt-s |sid=\"1\" b", ["missing-milestone-self-close"]),
    ("\\id GEN\n\\c 1\n\\v 1 a", ["verse-outside-explicit-paragraph"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\\f + \\ft b\n\\p\n\\v 2 c", ["unclosed-marker", "unclosed-note"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a \\nd b\n\\p\n\\v 2 c", ["char-not-closed", "unclosed-marker"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a \\nd* b", ["stray-close-marker"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a \\ft b", ["char-not-closed", "marker-not-valid-in-context", "note-submarker-outside-note", "unclosed-marker"]),
]


def test_every_issue_has_its_record(spark):
    found = relations.lint_issues(docs(spark, [s for s, _ in CASES])).collect()
    for k, (source, codes) in enumerate(CASES):
        own = [r for r in found if r["doc_id"] == k]
        assert sorted({r["code"] for r in own}) == codes, source
        for r in own:
            assert r["category"] in issues.CATEGORIES and "{" not in r["message"]
            if r["code"] != "missing-id-marker":
                text = source.encode()[r["span"]["start"] : r["span"]["end"]].decode()
                assert r["marker"] is None or r["marker"] in text or r["code"].startswith(("duplicate", "verse", "chapter", "implicitly"))


def test_a_fix_mends_what_it_is_for(spark):
    source = "\\id GEN\n\\c 1\n\\pText \\v 1 a"
    row = relations.lint_issues(docs(spark, [source])).where("code = 'missing-separator-after-marker'").first()
    edits = spark.createDataFrame([(0, row["fix"]["target_id"], row["fix"]["action"], row["fix"]["new_text"]), (0, "GEN-99", "delete", None)], "doc_id long, id string, action string, new_text string")
    text = "".join(r["text"] for r in relations.apply_fixes(docs(spark, [source]), edits).orderBy("idx").collect())
    assert text == source.replace("\\pText", "\\p Text") and not [c for c, m in rules.found(made([text])[0]) if m.any()]


def test_codes_suppressions_and_summary(spark):
    table = docs(spark, [s for s, _ in CASES])
    only = relations.lint_issues(table, enabled=["empty-paragraph", "unknown-marker"], disabled=["unknown-marker"])
    assert [r["code"] for r in only.collect()] == ["empty-paragraph"]
    with pytest.raises(ValueError):
        relations.lint(table, enabled=["no-such-code"])
    assert not relations.lint_issues(table, implicit_verses=True).where("code = 'verse-outside-explicit-paragraph'").count()
    found = relations.lint_issues(table)
    hide = spark.createDataFrame([("duplicate-verse-number", "GEN 1:2"), ("missing-id-marker", None), ("unknown-marker", "GEN 1:1"), ("unknown-marker", "GEN 1:1")], "code string, sid string")
    kept = relations.suppress(found, hide)
    assert found.count() - kept.count() == 2 and kept.where("code = 'missing-id-marker'").count() == 1
    by = {r["doc_id"]: r for r in relations.summary(found, hide).collect()}
    assert by[9]["total_count"] == 2 and by[9]["suppressed_count"] == 1 and by[9]["by_category"] == {"structure": 2}
    assert by[10]["by_severity"] == {"warning": 1} and by[3]["by_issue_type"] == {"content": 1}


def test_streams_can_hold_what_no_source_gives(spark):
    rows = [(1, 0, "Marker", "\\id", "id", None), (1, 1, "BookCode", " GEN", None, "GEN 0:0"), (1, 2, "Marker", "\\c", "c", "GEN 1:0"), (1, 3, "Number", " 1", None, "GEN 1:0"), (1, 4, "Marker", "\\p", "p", "GEN 1:0")]
    rows += [(1, 5, "Marker", "\\v", "v", "GEN 1:1"), (1, 6, "Number", " one", None, "GEN 1:1"), (1, 7, "Text", " text", None, "GEN 1:1"), (1, 8, "Text", " \\nd,glued", None, "GEN 1:1"), (1, 9, "Number", "7", None, "GEN 1:1")]
    stream = spark.createDataFrame([(*r, f"x{r[1]}") for r in rows], "doc_id long, idx int, kind string, text string, marker string, sid string, id string").repartition(3)
    found = {(r["code"], r["token_id"], r["sid"]) for r in documents.lint_stream_issues(stream).collect()}
    assert {("unknown-token", "x8", "GEN 1:1"), ("invalid-number-range", "x6", "GEN 1:1"), ("number-range-not-preceded-by-marker-expecting-number", "x9", "GEN 1:1")} <= found
    made_ = documents.blocks_stream(stream).orderBy("begin").collect()
    assert [r["block_id"] for r in made_] == ["::x0", "GEN 0:0::x1", "GEN 1:0::x2", "GEN 1:1::x5"]
    text = "".join(r["text"] for r in documents.formatted_stream(stream, only=["recover-malformed-markers"]).orderBy("idx").collect())
    assert text == "".join(r[3] for r in rows)


def test_streams_of_tokens_give_what_their_sources_give(spark):
    table = docs(spark, SOURCES[:4])
    stream = relations.tokens(table)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(documents.lint_stream(stream)) == key(relations.lint(table))
    assert key(documents.vref_stream(stream)) == key(relations.verse_text(table))
    assert key(documents.html_stream(stream, notes="inline")) == key(documents.to_html(table, notes="inline").drop("error"))
    joined = {}
    for r in documents.formatted_stream(stream).orderBy("doc_id", "idx").collect():
        joined[r["doc_id"]] = joined.get(r["doc_id"], "") + r["text"]
    assert joined == {r["doc_id"]: r["formatted"] for r in documents.formatted(table).collect()}


# ---- verses


def test_notes_are_a_stack():
    source = "\\id MAT\n\\c 1\n\\p\n\\v 1 a\\f + \\ft b\\x - \\xt c\\f* d\n\\v 2 e\\x*f\\f g\n\\v 3 h\\f*i\n"
    _, refs, text = verses.verses(made([source])[0])
    assert dict(zip(refs, text)) == {"MAT 1:1": "a d", "MAT 1:2": "ef", "MAT 1:3": "i"}
    assert json.loads(verses.as_json(made([source, ""])[0])[0]) == {"MAT 1:1": "a d", "MAT 1:2": "ef", "MAT 1:3": "i"}


# ---- blocks


def stream(*rows):
    return [(sid, id_, text) for sid, id_, text in rows]


A = stream(("GEN 1:1", "a", "one "), ("GEN 1:2", "b", "two "), ("GEN 1:3", "c", "three "), ("GEN 2:1", "d", "four"))


def test_blocks_and_differences():
    new = stream(("GEN 1:1", "a", "one  "), ("GEN 1:3", "c", "THREE "), ("GEN 1:4", "e", "\\p "), ("GEN 2:1", "x", "four"))
    old, cur = blocks.of_tokens(A), blocks.of_tokens(new)
    got = [(d.block_id, d.status, d.undo_side, d.is_whitespace_change, d.is_usfm_structure_change) for d in blocks.diff(old, cur)]
    assert got == [("GEN 1:1::a", "Modified", "Current", True, False), ("GEN 1:2::b", "Deleted", "Original", False, False), ("GEN 1:3::c", "Modified", "Current", False, False), ("GEN 2:1::d", "Unchanged", "Current", False, False), ("GEN 1:4::e", "Added", "Current", False, True)]
    by = blocks.by_chapter(old, cur)
    assert {b: {c: [d.status for d in x] for c, x in v.items()} for b, v in by.items()} == {"GEN": {1: ["Modified", "Deleted", "Modified", "Added"], 2: ["Unchanged"]}}
    assert [d.block_id for d in blocks.flattened(by)] == ["GEN 1:1::a", "GEN 1:2::b", "GEN 1:3::c", "GEN 1:4::e", "GEN 2:1::d"]
    assert blocks.replaced(by, "GEN", 1, []) == {"GEN": {2: by["GEN"][2]}} and blocks.replaced_many(by, [("GEN", 1, []), ("GEN", 2, [])]) == {}
    assert blocks.of_tokens([(None, None, "x"), ("GEN 1:1", None, "y"), ("", None, "z"), ("GEN 1:1", None, "w")], allow_empty=False)[1].block_id == "GEN 1:1#1"


def test_moved_blocks_are_matched_as_many_as_can_stay_in_order():
    order = lambda ids: blocks.of_tokens([(f"GEN 1:{i}", str(i), f"{i} ") for i in ids])
    got = [(d.semantic_sid, d.status) for d in blocks.diff(order([1, 2, 3, 4, 5]), order([2, 3, 1, 4, 5]))]
    assert got == [("GEN 1:1", "Unchanged"), ("GEN 1:2", "Unchanged"), ("GEN 1:3", "Unchanged"), ("GEN 1:4", "Unchanged"), ("GEN 1:5", "Unchanged")]
    assert blocks.in_order([3, 0, 1, 4, 2]) in ([1, 2, 4], [1, 2, 3]) and blocks.in_order([]) == []


def test_reverts_follow_each_other():
    cur = stream(("GEN 1:1", "a", "ONE "), ("GEN 1:4", "e", "new "), ("GEN 2:1", "d", "four"))
    text = lambda s: "".join(x[2] for x in s)
    assert text(blocks.revert(["GEN 1:1::a"], A, cur)) == "one new four"
    assert text(blocks.revert(["GEN 1:3::c"], A, cur)) == "ONE three new four"
    assert text(blocks.revert(["GEN 1:2::b", "GEN 1:3::c"], A, cur)) == "ONE two three new four"
    assert text(blocks.revert(["GEN 1:4::e", "GEN 1:1::zz", "nothing"], A, cur)) == "one four"
    assert text(blocks.revert([x.block_id for x in blocks.diff(blocks.of_tokens(A), blocks.of_tokens(cur))], A, cur)) == text(A)


def test_reverting_all_gives_the_baseline_where_references_are_unique(spark):
    pairs = spark.createDataFrame([(1, "\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 2 b\n\\v 3 c\n", "\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 3 C\n\\v 4 d\n"), (2, "same", "same"), (3, None, "x")], "doc_id long, baseline string, current string")
    got = {r["doc_id"]: r["source"] for r in relations.revert_blocks(pairs).collect()}
    assert got[1] == pairs.first()["baseline"] and got[2] == "same" and got[3] == ""
    assert relations.block_diff(pairs).where("doc_id = 1 AND status <> 'Unchanged'").count() == 3
    assert relations.block_diff(pairs.limit(0)).count() == 0


def test_every_ending_of_the_made_documents_is_reached(spark):
    from scriptorium.functions.dialect import SPARK

    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").createOrReplaceTempView("all_documents")
    df = spark.sql(synth.usfm_docs(SPARK, "all_documents"))
    found = {r["code"] for r in relations.lint_issues(df).select("code").distinct().collect()}
    assert found == set(issues.CODES) - {"unknown-token", "invalid-number-range", "verse-content-not-empty", "number-range-not-preceded-by-marker-expecting-number"}
    status = {r["status"] for r in relations.block_diff(spark.sql(synth.pairs(SPARK, "all_documents"))).select("status").distinct().collect()}
    assert status == {"Unchanged", "Modified", "Added", "Deleted"}
