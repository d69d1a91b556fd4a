import pytest

from scriptorium.operators import convert, documents
from scriptorium.operators.scan import tokens
from scriptorium.operators.trees import syntax_parents
from scriptorium.plans.tokens import tokens as relational
from tests.test_tokens import SOURCES

TEXT = "\\id MAT Sample\n\\c 1\n\\p\n\\v 1 One\\f + \\fr 1:1 \\ft note \\+nd x\\+nd*\\f* two \\w grace|lemma=\"g\"\\w*\n\\q1 line\n\\tr \\th1 A \\thr2 B\n\\tr \\tc1 C\n\\p \\qt-s |who=\"P\"\\*said//more\n"


def test_both_scanners_agree(spark):
    sources = SOURCES | {"text": TEXT}
    docs = spark.createDataFrame(list(sources.items()), "doc_id string, source string")
    rows = relational(docs).orderBy("doc_id", "idx").collect()
    for name, source in sources.items():
        want = [(r["kind"], r["text"], r["marker"], r["book"], r["chapter"] or 0, r["verse"] or 0) for r in rows if r["doc_id"] == name]
        assert [(t.kind, t.text, t.marker, t.book, t.chapter if t.book else 0, t.verse if t.book else 0) for t in tokens(source)] == want


def test_syntax_tree():
    toks = tokens(TEXT)
    tree = syntax_parents(toks)
    assert all(p is None or p < k for k, (p, _) in enumerate(tree))
    at = {t.marker: k for k, t in enumerate(toks) if t.kind == "Marker"}
    assert tree[at["ft"]][0] == at["f"] or toks[tree[at["ft"]][0]].marker == "fr"
    assert toks[tree[at["q1"]][0]].marker != "p" if tree[at["q1"]][0] is not None else True
    assert tree[at["th1"]][0] is not None and toks[tree[at["th1"]][0]].marker == "tr"


def test_json():
    usj = convert.usfm_to_usj(TEXT)
    book, chapter, para, *_ = usj["content"]
    assert (usj["type"], usj["version"]) == ("USJ", "3.1")
    assert book == {"type": "book", "marker": "id", "code": "MAT", "content": [" Sample"]}
    assert chapter == {"type": "chapter", "marker": "c", "number": "1", "sid": "MAT 1"}
    assert para["content"][0] == {"type": "verse", "marker": "v", "number": "1", "sid": "MAT 1:1"}
    note = next(x for x in para["content"] if isinstance(x, dict) and x["type"] == "note")
    assert (note["caller"], [x["marker"] for x in note["content"] if isinstance(x, dict)]) == ("+", ["fr", "ft"])
    assert {"type": "char", "marker": "w", "content": [" grace"], "lemma": "g"} in para["content"]
    table = next(x for x in usj["content"] if x["type"] == "table")
    assert [c["align"] for c in table["content"][0]["content"]] == ["start", "end"] and len(table["content"]) == 2
    assert {"type": "ms", "marker": "qt-s", "who": "P"} in usj["content"][-1]["content"]
    assert {"type": "optbreak"} in usj["content"][-1]["content"]


def test_xml_ends_what_it_starts():
    usx = convert.usfm_to_usx(TEXT)
    assert usx.count("sid=") == usx.count("eid=") == 2
    assert usx.startswith('<?xml version="1.0" encoding="utf-8"?><usx version="3.0"><book code="MAT" style="id">')
    assert convert.usfm_to_usx("\\usfm 3.1\n\\p x").count('version="3.1"') == 1


def flat(usj):
    """Elements and texts in order, white space aside."""
    out = []

    def walk(nodes):
        for x in nodes:
            if isinstance(x, str):
                out.extend(x.split())
            else:
                out.append(tuple(sorted((k, v) for k, v in x.items() if k not in ("content", "align", "sid"))))
                walk(x.get("content", []))

    walk(usj["content"])
    return out


def test_round_trips():
    usj = convert.usfm_to_usj(TEXT)
    assert flat(convert.usx_to_usj(convert.usj_to_usx(usj))) == flat(usj)
    assert flat(convert.usfm_to_usj(convert.usj_to_usfm(usj))) == flat(usj)


@pytest.mark.parametrize("bad", ['{"type": "other"}', "[1]", "{", ""])
def test_faults_are_reported(spark, bad):
    docs = spark.createDataFrame([(1, bad), (2, None)], "doc_id long, usj string")
    out = {r["doc_id"]: r for r in documents.from_usj(docs).collect()}
    assert out[1]["source"] is None and out[1]["error"] and out[2]["error"] is None


def test_html():
    html = convert.usfm_to_html("\\id GEN\n\\c 1\n\\p\n\\v 1 a < b & c\\f + \\ft n\\f*", notes="extracted")
    assert "a &lt; b &amp; c" in html and '<ol class="usfm-notes">' in html and "<p " in html
    assert convert.usfm_to_html("", wrap_root=False) == ""
