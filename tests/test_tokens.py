import pytest

from scriptorium.plans import lint, vref
from scriptorium.plans.tokens import over, tokens

SOURCES = {
    "plain": "\\id GEN Sample\n\\c 1\n\\p\n\\v 1 In the beginning\n\\v 2-3a And so\n",
    "notes": "\\id MAT\n\\c 2\n\\p\n\\v 1 Text\\f + \\ft a \\+nd b\\+nd* c\\f* more\n",
    "attributes": '\\id MAT\n\\c 1\n\\p \\w grace|lemma="a \\" b" strong="H1"\\w* x|y\n',
    "faults": "\\v\n12 lost \\ / // \\Zed a/b |key=\"open\r\n",
    "spaces": "  \t",
    "lead": "  \n \\p x",
    "accents": "\\id GÉN x\n\\c 1\n\\v 1 É",
    "empty": "",
}


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.createDataFrame([(k, v) for k, v in SOURCES.items()], "doc_id string, source string")
    rows = tokens(docs).orderBy("doc_id", "idx").collect()
    return {k: [r for r in rows if r["doc_id"] == k] for k in SOURCES}


def test_tokens_are_lossless_and_contiguous(table):
    for name, rows in table.items():
        assert "".join(r["text"] for r in rows) == SOURCES[name]
        assert [r["idx"] for r in rows] == list(range(len(rows)))
        end = 0
        for r in rows:
            assert r["span_start"] == end and r["span_end"] - end == len(r["text"].encode())
            end = r["span_end"]


def test_references_are_carried_forward(table):
    at = [(r["kind"], r["book"], r["chapter"], r["verse"]) for r in table["plain"]]
    assert at[0] == ("Marker", None, None, None)
    assert at[1] == ("BookCode", "GEN", 0, 0)
    assert ("Marker", "GEN", 1, 0) in at and ("Text", "GEN", 1, 2) in at
    number = [r for r in table["plain"] if r["num_kind"] == "Range"][0]
    assert (number["text"].strip(), number["num_start"], number["num_end"]) == ("2-3a", 2, 3)


def test_payload_needs_its_marker_on_the_same_line_for_a_reference(table):
    first, second = [r for r in table["faults"] if r["kind"] in ("Marker", "Number")][:2]
    assert (first["marker"], second["kind"], second["num_start"], second["verse"]) == ("v", "Number", 12, None)


def test_book_code_must_be_plain(table):
    assert all(r["book"] is None and r["kind"] != "BookCode" for r in table["accents"])


def test_white_space_goes_to_its_neighbour(table):
    assert [(r["kind"], r["text"]) for r in table["spaces"]] == [("Text", "  \t")]
    assert [(r["kind"], r["text"]) for r in table["lead"]] == [("Text", "  "), ("Newline", "\n"), ("Marker", " \\p"), ("Text", " x")]


def test_faulty_bytes_join_their_text(table):
    kinds = [r["kind"] for r in table["faults"]]
    assert all(a != "Text" or b != "Text" for a, b in zip(kinds, kinds[1:]))
    assert "OptBreak" in kinds


def test_verse_text(spark):
    source = "\\id MAT\n\\c 2\n\\p\n\\v 1 Text\\f + \\ft note\\f* more\n\\s1 Head\n\\p\n\\v 2 Two \n\\v 2  again\n\\c 3\n\\p stray"
    docs = spark.createDataFrame([(1, source)], "doc_id long, source string")
    got = over(docs, lambda d, q: f"WITH {vref.verses(d, q)} SELECT ref, text FROM verses").collect()
    assert {tuple(r) for r in got} == {("MAT 2:1", "Text more"), ("MAT 2:2", "again")}


LINT = [
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 2 b", []),
    ("\\c 1\n\\p\n\\v 1 a", ["missing-id-marker"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 1 b", ["duplicate-verse-number"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 4 b", ["verse-expected-increase-by-one"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1-3 a\n\\v 2 b", ["duplicate-verse-number"]),
    ("\\id GEN\n\\c 2\n\\p\n\\v 1 a", ["chapter-expected-increase-by-one"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a \\xyz b\\xyz*", ["unknown-close-marker", "unknown-marker"]),
    ("\\id GEN\n\\c 1\n\\p\n\\p\n\\v 1 a", ["empty-paragraph"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v", ["missing-verse-number", "verse-range-expected-after-verse-marker"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 a \\ts-x", ["missing-separator-after-marker", "unknown-marker"]),
    ("\\id GEN\n\\c 1\n\\pText \\v 1 a", ["missing-separator-after-marker"]),
    ("\\id GEN\n\\c 1\n\\p\n\\v 1 ", ["verse-text-follows-verse-range"]),
]


def test_lint(spark):
    docs = spark.createDataFrame([(k, source) for k, (source, _) in enumerate(LINT)], "doc_id long, source string")
    found = over(docs, lint.lint).collect()
    for k, (source, codes) in enumerate(LINT):
        assert sorted(r["code"] for r in found if r["doc_id"] == k) == codes, source


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string")
    assert tokens(docs).count() == 0
    assert over(docs, lint.lint).count() == 0
