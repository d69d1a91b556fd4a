from scriptorium.functions import markers as m


def test_names_resolve_to_entries():
    assert len(m.SPECS) == 213
    assert [m.canonical(x) for x in ("q", "q1", "+nd", "th3-4", "vid1-s", "liv5", "liv6", "zaln-s", "ts-s")] == ["q", "q1", "nd", "th", "vid", "liv", None, None, None]


def test_derived_properties():
    assert m.scope_kind("fig") == "Block" and m.scope_kind("qt-s") == "Character" and m.scope_kind("zz") == "Unknown"
    assert m.supports_verse("q2") and m.supports_verse("lit") and not m.supports_verse("s1")
    assert m.default_attribute("w") == "lemma" and m.default_attribute("qt-s") == "who"
    assert m.public_kind("vid-e") == "MilestoneEnd" and m.public_kind("esbe") == "SidebarEnd"
    assert m.allows("nd", "Footnote") and m.allows("p", "PeripheralContent") and not m.allows("p", "Footnote")
    assert len(m.BOOKS) == 109
