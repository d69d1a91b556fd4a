import pytest

from scriptorium.operators import documents
from scriptorium.operators.formatting import DEFAULT, RULES, format_usfm


@pytest.mark.parametrize(
    "rule, source, want",
    [
        ("collapse-whitespace-in-text", "\\p a \t b", "\\p a b"),
        ("collapse-consecutive-linebreaks", "\\p\n\n\n\\p x", "\\p\n\\p x"),
        ("normalize-marker-whitespace-at-line-start", "\\p\n  \\v 1 x", "\\p\n\\v 1 x"),
        ("remove-duplicate-verse-numbers", "\\v 3 3 text", "\\v 3  text"),
        ("bridge-consecutive-verse-markers", "\\v 1 \\v 2 \\v 3 x", "\\v 1-3 x"),
        ("remove-orphan-empty-verse-before-contentful-verse", "\\v 1 \\v 5 x", "\\v 5 x"),
        ("remove-bridge-verse-enumerators", "\\v 1-3 1. one 2. two 9. nine", "\\v 1-3 one two 9. nine"),
        ("move-chapter-label-after-chapter-marker", "\\cl One\n\\c 1\n\\p", "\\c 1\\cl One\n\n\\p"),
        ("insert-default-paragraph-after-chapter-intro", "\\c 1\n\\v 1 a", "\\c 1\n\\p\\v 1 a"),
        ("remove-empty-paragraphs", "\\p\n\\p x", "\\p x"),
        ("insert-structural-linebreaks", "\\c 1 \\p \\v 1 a \\q1 b", "\\c 1\n \n\\p\n \\v 1 a \n\\q1 b"),
        ("ensure-inline-separators", "\\v 1\\p x", "\\v 1 \\p x"),
        ("recover-malformed-markers", "\\p x", "\\p x"),
        ("normalize-spacing-after-paragraph-markers", "\\p    x", "\\p x"),
        ("remove-unwanted-linebreaks", "\\s1\nHead", "\\s1Head"),
    ],
)
def test_one_rule(rule, source, want):
    assert format_usfm(source, frozenset([rule])) == want
    assert format_usfm(source, frozenset()) == source


def test_default_rules():
    assert DEFAULT == set(RULES) - {"remove-empty-paragraphs"}
    assert format_usfm("\\c 1\n\\p\n\\v 1 a  b\n\\v 2 c") == "\\c 1\n\\p\n\\v 1 a b \\v 2 c"
    assert format_usfm("") == ""


def test_tables(spark):
    docs = spark.createDataFrame([(1, "\\p a  b"), (2, None), (3, "")], "doc_id long, source string")
    assert {r["doc_id"]: r["formatted"] for r in documents.formatted(docs, only=["collapse-whitespace-in-text"]).collect()} == {1: "\\p a b", 2: None, 3: ""}
    with pytest.raises(ValueError):
        documents.formatted(docs, only=["other"])
