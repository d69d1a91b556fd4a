"""Lint rules that look at neighbouring tokens, over the columns of many documents."""

from __future__ import annotations

from collections import Counter

import numpy as np

from scriptorium.functions import markers as mk
from scriptorium.operators.columns import ATTRIBUTES, BREAK, END, MARKER, MILESTONE, MILESTONE_END, NEWLINE, NUMBER, TEXT, Tokens, pick
from scriptorium.plans.lint import BODY, NOTES, OUTSIDE
from scriptorium.plans.tokens import NUMBERED

ENDS = ("Header", "Chapter", "Periph", "Sidebar", "TableRow", "Unknown")


def blank(t: Tokens) -> np.ndarray:
    """Text tokens of white space only."""
    full = np.concatenate([[0], np.cumsum(~np.isin(t.data, np.frombuffer(b" \t\r\n", dtype=np.uint8)))])
    return (t.kind == TEXT) & (full[t.end] == full[t.start])


def scopes(t: Tokens) -> np.ndarray:
    """The structural kind of each marker by its number; none is null."""
    return t.by_name(mk.scope_kind)


def repeats(doc: np.ndarray, chapter: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which ranges overlap an earlier one of their chapter; those that end before they begin never do."""
    out = np.zeros(len(doc), dtype=bool)
    own = np.flatnonzero(low <= high)
    order = own[np.lexsort((own, chapter[own], doc[own]))]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (chapter[order][1:] != chapter[order][:-1])
    top = np.maximum.accumulate(high[order] + np.cumsum(new) * (1 << 40)) - np.cumsum(new) * (1 << 40) if len(order) else high[order]
    # as long as numbers rise above all before them nothing repeats; only chapters where one doesn't are looked at closely
    late = np.zeros(len(order), dtype=bool)
    late[1:] = ~new[1:] & (low[order][1:] <= top[:-1])
    group = np.cumsum(new) - 1
    for g in np.unique(group[late]).tolist():
        seen: list[tuple[int, int]] = []
        for k in order[np.searchsorted(group, g) : np.searchsorted(group, g, side="right")].tolist():
            a, b = int(low[k]), int(high[k])
            out[k] = any(a <= y and x <= b for x, y in seen)
            seen.append((a, b))
    return out


def found(t: Tokens) -> list[tuple[str, np.ndarray]]:
    """Each code and the tokens it holds for."""
    marker, kind, n = t.marker, t.kind, t.n
    is_marker = kind == MARKER
    is_ = lambda *names: is_marker & t.is_name(*names)[marker]
    tag = lambda at: pick(t.tag, at, -1)
    tag_of = lambda kind_, name: kind_ * (len(t.names) + 1) + (t.names.index(name) + 1 if name in t.names else -1 << 40)
    bare_tag = lambda kind_: kind_ * (len(t.names) + 1)
    scope = scopes(t)[marker]
    empty = blank(t)
    on = t.step(1)
    edge = lambda at, first: np.isin(t.data[t.start[at] if first else t.end[at] - 1], np.frombuffer(b" \t", dtype=np.uint8)) if n else np.zeros(0, dtype=bool)

    prev = t.before(kind != NEWLINE)
    next_ = t.after(kind != NEWLINE)
    prev2 = pick(prev, prev, -1)
    c, v = tag_of(MARKER, "c"), tag_of(MARKER, "v")
    full = t.after(~((kind == NEWLINE) | (kind == BREAK) | empty))
    boundary = t.by_name(lambda x: x in BODY or mk.scope_kind(x) in ENDS, False)[marker].astype(bool) & is_marker
    verse_next = t.after(~((kind == NEWLINE) | (kind == ATTRIBUTES) | empty))
    attr_next = t.after(kind != ATTRIBUTES)
    is_id = is_("id")
    content = t.count(~((kind == NEWLINE) | (kind == BREAK) | empty), False)
    chapters, periphs = t.count(is_("c"), False), t.count(is_("periph"), False)
    codes, names = t._books()
    book_now = codes[t.before(codes[:n] >= 0)] if n else codes[:0]
    outside = np.array([x in OUTSIDE for x in names] + [False])[book_now]

    number = kind == NUMBER
    is_chapter, is_verse = number & (tag(prev) == c), number & (tag(prev) == v)
    num_last = np.where(t.num_shape % 2 == 1, t.num_end, t.num_start)
    last_chapter = pick(t.num_start, t.before(is_chapter), 0)
    rows = np.flatnonzero(is_chapter)
    again = np.zeros(n, dtype=bool)
    again[np.delete(rows, np.unique(np.stack([t.doc[rows], t.num_start[rows]]), axis=1, return_index=True)[1])] = True
    in_chapter = np.where(last_chapter == 0, np.where(t.book_at >= 0, t.chapter, 0), last_chapter)
    rows = np.flatnonzero(is_verse)
    repeated = np.zeros(n, dtype=bool)
    repeated[rows] = repeats(t.doc[rows], in_chapter[rows], t.num_start[rows], num_last[rows])
    order = rows[np.lexsort((rows, in_chapter[rows], t.doc[rows]))]
    last_verse = np.zeros(n, dtype=np.int64)
    same = (t.doc[order][1:] == t.doc[order][:-1]) & (in_chapter[order][1:] == in_chapter[order][:-1])
    last_verse[order[1:]] = np.where(same, num_last[order][:-1], 0)

    expects = np.isin(tag(prev), [tag_of(MARKER, x) for x in NUMBERED])
    follows = np.isin(tag(verse_next), [bare_tag(TEXT), *(tag_of(MARKER, x) for x in NOTES)])
    no_number = tag(next_) != bare_tag(NUMBER)
    unknown_z = (scope == "Unknown") & t.by_name(lambda x: x.startswith("z"), False)[marker].astype(bool)
    all_ids = np.add.reduceat(np.append(is_id, False), t.first[:-1]) * (t.counts > 0) if len(t.counts) else np.zeros(0)
    return [
        ("missing-separator-after-marker", is_marker & (pick(kind, on, -1) == TEXT) & (scope != "Milestone") & ~unknown_z & ~edge(t.at, False) & ~edge(on, True)),
        ("empty-paragraph", is_(*(x for x in BODY if x != "b")) & pick(boundary, full, False)),
        ("number-range-after-chapter-marker", is_("c") & no_number),
        ("missing-chapter-number", is_("c") & no_number),
        ("verse-range-expected-after-verse-marker", is_("v") & no_number),
        ("missing-verse-number", is_("v") & no_number),
        ("verse-content-not-empty", empty & (tag(prev) == v)),
        ("duplicate-id-marker", is_id & (t.count(is_id) > 1)),
        ("id-marker-not-at-file-start", is_id & (content > 0)),
        ("verse-before-first-chapter", is_("v") & (chapters == 0) & ~outside & (periphs == 0)),
        ("chapter-metadata-outside-chapter", is_("ca", "cp") & ~((pick(kind, prev, -1) == NUMBER) & (tag(prev2) == c))),
        ("verse-metadata-outside-verse", is_("va", "vp") & ~((pick(kind, prev, -1) == NUMBER) & (tag(prev2) == v))),
        ("unknown-marker", is_marker & (scope == "Unknown")),
        ("unknown-close-marker", (kind == END) & (scope == "Unknown")),
        ("duplicate-chapter-number", is_chapter & again),
        ("chapter-expected-increase-by-one", is_chapter & (t.num_start != last_chapter + 1)),
        ("duplicate-verse-number", repeated),
        ("verse-expected-increase-by-one", is_verse & ~repeated & (t.num_start != last_verse + 1)),
        ("inconsistent-chapter-label", odd_labels(t, is_("cl"), next_)),
        ("number-range-not-preceded-by-marker-expecting-number", number & ~expects),
        ("verse-text-follows-verse-range", is_verse & ~follows),
        ("missing-id-marker", (t.idx == 0) & (all_ids[t.doc] == 0)),
        ("missing-milestone-self-close", (kind == MILESTONE) & (pick(kind, attr_next, -1) != MILESTONE_END)),
    ]


def odd_labels(t: Tokens, is_label: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Chapter labels whose words, up to the first digit, aren't those that most of the document's have; of equally many the greatest counts."""
    out = np.zeros(t.n, dtype=bool)
    words: dict[int, dict[int, str]] = {}
    for k in np.flatnonzero(is_label & (pick(t.kind, next_, -1) == TEXT)).tolist():
        text = t.text(int(next_[k]))
        label = text[: next((j for j, ch in enumerate(text) if "0" <= ch <= "9"), len(text))].strip(" \t\r\n")
        if label:
            words.setdefault(int(t.doc[k]), {})[k] = label
    for own in words.values():
        count = Counter(own.values())
        main = max(count, key=lambda x: (count[x], x))
        for k, label in own.items():
            out[k] = label != main
    return out
