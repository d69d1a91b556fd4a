"""Verse text by reference, over the columns of many documents.

Text counts while a reference is open, no note is open and the last paragraph
may hold verses. A chapter or verse number ends what was open; a repeated
reference takes its last text. Notes are a stack: the end of one closes the
last that has its name, and all within it.
"""

from __future__ import annotations

import json

import numpy as np

from scriptorium.functions import markers as mk
from scriptorium.operators.blocks import WHITE
from scriptorium.operators.columns import END, MARKER, NUMBER, TEXT, Tokens, pick


def in_note(t: Tokens) -> np.ndarray:
    """Which tokens stand in an open note."""
    note = t.by_name(lambda x: mk.scope_kind(x) == "Note", False)[t.marker].astype(bool)
    events = np.flatnonzero(note & ((t.kind == MARKER) | (t.kind == END)))
    change = np.zeros(t.n + 1, dtype=np.int64)
    open_: list[int] = []
    doc, since = -1, 0
    for k, d, opens, name in zip(events.tolist(), t.doc[events].tolist(), (t.kind[events] == MARKER).tolist(), t.marker[events].tolist()):
        if d != doc:
            if open_:
                change[since] += 1
                change[t.first[doc + 1]] -= 1
            open_, doc = [], d
        if opens:
            since = k if not open_ else since
            open_.append(name)
        elif name in open_:
            del open_[len(open_) - 1 - open_[::-1].index(name) :]
            if not open_:
                change[since] += 1
                change[k + 1] -= 1
    if open_:
        change[since] += 1
        change[t.first[doc + 1]] -= 1
    return np.cumsum(change)[: t.n] > 0


def verses(t: Tokens) -> tuple[np.ndarray, list[str], list[str]]:
    """Document, reference and text of each verse, in order of their last numbers."""
    before = t.step(-1)
    numbered = (t.kind == NUMBER) & (pick(t.kind, before, -1) == MARKER)
    name = pick(t.marker, before, -1)
    is_verse = numbered & t.is_name("v")[name]
    ends = is_verse | (numbered & t.is_name("c")[name])
    block = (t.kind == MARKER) & t.by_name(lambda x: mk.scope_kind(x) == "Block", False)[t.marker].astype(bool)
    holds = pick(t.by_name(mk.supports_verse, True)[t.marker].astype(bool), t.last(block), True)
    opened = t.last(ends)
    ok = is_verse & (t.book_at >= 0) & (t.chapter > 0) & (t.num_start > 0)
    at = np.flatnonzero((t.kind == TEXT) & pick(ok, opened, False) & holds & ~in_note(t))
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), dtype=bool), opened[at][1:] != opened[at][:-1]]))
    heads = opened[at[cut]]
    codes, names = t._books()
    found: dict[tuple[int, str], str] = {}
    texts = [t.raw[a:b].decode() for a, b in zip(t.start[at].tolist(), t.end[at].tolist())]
    stops = [*cut[1:].tolist(), len(at)]
    for a, b, doc, book, chapter, verse in zip(cut.tolist(), stops, t.doc[heads].tolist(), codes[t.book_at[heads]].tolist(), t.chapter[heads].tolist(), t.num_start[heads].tolist()):
        text = texts[a]
        for more in texts[a + 1 : b]:
            text += more.lstrip(WHITE) if text[-1:] in WHITE and text else more
        if text := text.strip(WHITE):
            key = doc, f"{names[book]} {chapter}:{verse}"
            found.pop(key, None)
            found[key] = text
    return np.array([d for d, _ in found], dtype=np.int64), [r for _, r in found], list(found.values())


def as_json(t: Tokens) -> list[str]:
    """For each document its verses as a JSON object, sorted by reference."""
    out: list[dict[str, str]] = [{} for _ in t.counts]
    for d, ref, text in zip(*verses(t)):
        out[d][ref] = text
    return [json.dumps(dict(sorted(x.items(), key=lambda kv: kv[0].encode())), ensure_ascii=False, indent=2) for x in out]
