import json

import pytest

from scriptorium import api
from scriptorium.functions import register

USFM = "\\id GEN\n\\c 1\n\\p\n\\v 1 In the\\f + \\ft note\\f* beginning\n\\v 2 \\v 3 And\n"


def test_documents_from_files_in_every_format(spark, tmp_path):
    text = api.Text(USFM)
    for name, body in (("a.usfm", USFM), ("b.json", text.usj()), ("c.xml", text.usx())):
        (tmp_path / name).write_text(body)
    verses = None
    for name, format_ in (("a.usfm", "usfm"), ("b.json", "usj"), ("c.xml", "usx")):
        docs = api.Documents.read(spark, str(tmp_path / name), format_)
        got = {r["ref"]: r["text"] for r in docs.vref().collect()}
        verses = verses or got
        assert got == verses == {"GEN 1:1": "In the beginning", "GEN 1:3": "And"}
    with pytest.raises(ValueError):
        api.Documents.of(spark.range(1), "pdf")


def test_the_table_and_the_single_text_agree(spark):
    table = spark.createDataFrame([(1, USFM), (2, None)], "doc_id long, source string")
    docs, text = api.Documents(table), api.Text(USFM)
    one = lambda df, c: df.where("doc_id = 1").first()[c]
    assert one(docs.usj(), "usj") == text.usj() and one(docs.usx(), "usx") == text.usx() and one(docs.convert("html"), "html") == text.html()
    assert json.loads(one(docs.vref(as_json=True), "vref")) == text.vref()
    assert sorted(r["code"] for r in docs.lint().collect()) == sorted(i["code"] for i in text.lint())
    assert one(docs.format().table, "source") == text.format().source
    off = api.LintOptions().disable("verse-text-follows-verse-range", "duplicate-verse-number")
    assert {i["code"] for i in text.lint()} - {i["code"] for i in text.lint(off)} == {"verse-text-follows-verse-range"}
    assert [i["code"] for i in text.lint(api.LintOptions().enable("missing-id-marker"))] == []
    assert one(docs.lint_summary(), "total_count") == len(text.lint())
    assert one(docs.tokens().source().table, "source") == USFM
    assert docs.walk().where("marker = 'ft' AND kind = 'Marker'").first()["ancestors"][0] == 0 or docs.walk().where("marker = 'ft'").count() == 1
    only = api.FormatOptions(only=("bridge-consecutive-verse-markers",))
    assert text.format(only).source == USFM.replace("\\v 2 \\v 3", "\\v 2-3")


def test_differences_and_reverts(spark):
    old, new = api.Text(USFM), api.Text(USFM.replace("beginning", "start") + "\\v 4 more\n")
    changed = [d for d in new.diff(old) if d.status != "Unchanged"]
    assert [(d.semantic_sid, d.status) for d in changed] == [("GEN 1:1", "Modified"), ("GEN 1:4", "Added")]
    assert new.revert(old, [d.block_id for d in changed]).source == USFM
    assert [len(v) for v in new.diff_by_chapter(old)["GEN"].values()][-1] == 5
    table = lambda t: api.Documents(spark.createDataFrame([(1, t.source)], "doc_id long, source string"))
    assert table(new).diff(table(old)).where("status = 'Added'").count() == 1
    assert table(new).revert(table(old)).table.first()["source"] == USFM
    ids = spark.createDataFrame([(1, [changed[0].block_id])], "doc_id long, block_ids array<string>")
    assert table(new).revert(table(old), ids).table.first()["source"] == USFM + "\\v 4 more\n"


def test_labels_of_notes():
    two = USFM.replace("beginning", "beginning\\f a \\ft other\\f*").replace("And", "And\\f - \\ft third\\f*")
    import re

    callers = lambda **o: re.findall(r'<sup class="usfm-caller"><a href="#note-\d+">([^<]*)</a>', api.Text(two).html(**o))
    assert callers() == ["1", "2", "1"]
    assert callers(caller_style="alpha-upper", caller_scope="document") == ["A", "B", "C"]
    assert callers(caller_style="roman") == ["i", "ii", "i"]
    assert callers(caller_style="source") == ["1", "a", "1"]
    assert 'data-usfm-root="true"' in api.Text(two).html(wrap_root=True) and "<ol" not in api.Text(two).html(notes="inline")


def test_functions_for_sql(spark):
    register.register(spark)
    table = spark.createDataFrame([(1, USFM), (2, None)], "doc_id long, source string")
    table.createOrReplaceTempView("some_texts")
    row = spark.sql("SELECT usx_to_usfm(usfm_to_usx(source)) a, usj_to_usfm(usfm_to_usj(source)) b, usfm_to_vref(source) v, usfm_lint_codes(source) c, usfm_format_only(source, array('bridge-consecutive-verse-markers')) f, usfm_revert(source, replace(source, 'And', 'or'), array('GEN 1:3::GEN-19')) r FROM some_texts WHERE doc_id = 1").first()
    assert row["a"] == row["b"] and json.loads(row["v"])["GEN 1:3"] == "And" and "verse-text-follows-verse-range" in row["c"] and "2-3" in row["f"] and row["r"] == USFM
    got = spark.sql("SELECT usfm_marker_kind('q2') k, usfm_marker_allowed('ft', 'Footnote') a, usfm_marker_known('xyz') n, usfm_marker_default_attribute('w') d, usfm_marker_supports_verse('p') s").first()
    assert tuple(got) == ("Paragraph", True, False, "lemma", True)
    assert spark.sql("SELECT count(*) FROM some_texts, LATERAL usfm_tokens(source)").first()[0] == len(api.Text(USFM).tokens())
    assert api.marker("+nd")["category"] == "Character"
