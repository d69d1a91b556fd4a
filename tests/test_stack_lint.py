import pytest

from scriptorium.operators.scan import tokens
from scriptorium.operators.stack_lint import issues

HEAD = "\\id GEN\n\\c 1\n\\p\n\\v 1 "


@pytest.mark.parametrize(
    "source, codes",
    [
        (HEAD + "a \\nd b\\nd* \\f + \\fr 1:1 \\ft c\\f* d", []),
        (HEAD + "a \\nd b\n\\p c", ["char-not-closed", "unclosed-marker"]),
        (HEAD + "a \\f + \\ft b\n\\p c", ["unclosed-note", "unclosed-marker"]),
        (HEAD + "a \\nd b", ["char-not-closed", "unclosed-marker"]),
        (HEAD + "a\\nd*", ["stray-close-marker"]),
        (HEAD + "a \\*", ["stray-close-marker"]),
        (HEAD + "a \\bd b \\it c\\bd* d\\it*", ["misnested-close-marker", "implicitly-closed-marker", "stray-close-marker"]),
        (HEAD + "a \\ft b\\ft*", ["note-submarker-outside-note", "marker-not-valid-in-context"]),
        ("\\id GEN\n\\p early\n\\c 1\n\\p\n\\v 1 a", ["paragraph-before-first-chapter"]),
        ("\\id GEN\n\\c 1\n\\v 1 a", ["verse-outside-explicit-paragraph"]),
        ("\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\h Late", ["marker-not-valid-in-context"]),
    ],
)
def test_codes(source, codes):
    assert sorted(i.code for i in issues(tokens(source))) == sorted(codes)


def test_nothing_in_nothing():
    assert issues([]) == []
