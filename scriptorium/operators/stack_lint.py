"""Lint rules that need a stack: contexts, and the balance of opening and closing markers."""

from __future__ import annotations

from typing import NamedTuple

from scriptorium.functions import markers as mk
from scriptorium.operators.scan import Token
from scriptorium.plans.lint import BODY, NOTES

_SLOTS = ("BookHeaders", "BookTitles", "BookIntroduction", "BookIntroductionEndTitles")
_DIVIDED, _STANDALONE = ("FRT", "INT", "BAK", "OTH"), ("CNC", "GLO", "TDX", "NDX")


CODES = frozenset((
    "paragraph-before-first-chapter", "verse-outside-explicit-paragraph", "note-submarker-outside-note", "marker-not-valid-in-context", "unclosed-note",
    "char-not-closed", "stray-close-marker", "misnested-close-marker", "implicitly-closed-marker", "unclosed-marker",
))


class Issue(NamedTuple):
    code: str
    idx: int
    related_idx: int | None
    marker: str | None


def _scope(t: Token) -> str | None:
    return mk.scope_kind(t.marker) if t.marker is not None else None


class Place:
    """Where in the book the reading is: part of the book, paragraph and notes.

    A note's close doesn't take its context away again: it holds up to the next
    ``id`` or ``periph``. Users rely on what this reports, so it is kept so.
    """

    def __init__(self) -> None:
        self.kind, self.slot, self.chapter = "Scripture", 0, False
        self.block: str | None = None
        self.notes: list[str] = []

    def root(self, slot: int | None = None) -> str:
        slot = self.slot if slot is None else slot
        if slot < 0:
            return "Peripheral"
        return _SLOTS[slot] if slot < 4 else "ChapterContent" if self.kind == "Scripture" else "PeripheralContent"

    def next_slot(self, marker: str) -> int:
        """The first part of the book from here on that allows the marker, else this one."""
        return next((s for s in range(max(self.slot, 0), 5) if mk.allows(marker, self.root(s))), self.slot)

    def context(self, scope: str) -> str:
        return (self.notes[-1] if self.notes else self.block or self.root()) if scope in ("Character", "TableCell", "Meta") else self.root()

    def enter(self, scope: str, marker: str, book: str | None) -> None:
        if scope == "Header" and marker == "id" and book:
            self.kind = "Divided" if book in _DIVIDED else "Standalone" if book in _STANDALONE else "Scripture"
            self.slot, self.block, self.notes = (-1 if self.kind == "Divided" else 0), None, []
        elif scope == "Header":
            self.slot = self.next_slot(marker)
        elif scope == "Chapter":
            self.chapter, self.slot, self.block = True, 4, None
        elif scope == "Block":
            if not self.notes:
                self.slot = self.next_slot(marker)
            self.block = mk.scope_inline_context(marker) or mk.inline_context(marker) or "Para"
        elif scope == "Note":
            self.notes.append(mk.note_family(marker) or "Footnote")
        elif scope == "Periph":
            self.kind, self.slot, self.block, self.notes, self.chapter = "Divided", 0, None, [], False
        elif scope == "Sidebar":
            self.slot, self.block = 4, "Sidebar"
        elif scope in ("TableRow", "TableCell"):
            self.slot, self.block = 4, "Table"


def context_issues(toks: list[Token], implicit_verses: bool = False) -> list[Issue]:
    place, notes, out = Place(), [], []
    for k, t in enumerate(toks):
        if t.kind == "EndMarker" and t.marker in NOTES:
            while notes and notes.pop() != t.marker:
                pass
        if t.kind != "Marker":
            continue
        scope, m = _scope(t), t.marker
        flag = lambda code: out.append(Issue(code, k, None, m))  # noqa: B023, E731
        top = not place.notes and scope in ("Block", "Header", "Sidebar", "TableRow")
        early = not place.chapter and place.kind == "Scripture"
        if early and scope == "Block" and m in BODY and not place.notes and place.root(place.next_slot(m)) == "ChapterContent":
            flag("paragraph-before-first-chapter")
        if m == "v" and not implicit_verses and place.kind == "Scripture" and place.root() == "ChapterContent" and place.block not in ("Para", "List", "Table"):
            flag("verse-outside-explicit-paragraph")
        if mk.note_subkind(m) and not notes:
            flag("note-submarker-outside-note")
        context = "Peripheral" if m == "periph" else place.root(4) if scope == "Chapter" else place.root(place.next_slot(m)) if top else place.context(scope)
        if scope != "Unknown" and not mk.allows(m, context):
            flag("marker-not-valid-in-context")
        if scope == "Note":
            notes.append(m)
        book = next((x.text.strip() if x.kind == "BookCode" else None for x in toks[k + 1 : k + 8] if x.kind != "Newline"), None)
        place.enter(scope, m, book)
    return out


def balance_issues(toks: list[Token]) -> list[Issue]:
    """Two stacks: one is emptied before a block boundary's own marker, the other after it."""
    inline: list[tuple[str, int, str]] = []  # marker, token, scope
    nested: list[tuple[str, int, str]] = []
    out: list[Issue] = []
    sub = lambda f: f[2] == "Character" and mk.note_subkind(f[0])
    for k, t in enumerate(toks):
        scope, m = _scope(t), t.marker
        boundary = t.kind in ("Marker", "Milestone") and scope in ("Block", "Header", "Meta", "Chapter", "Periph", "Unknown")
        if boundary and t.kind == "Marker":
            while inline:
                f = inline.pop()
                if not sub(f) and f[2] in ("Note", "Character"):
                    out.append(Issue("unclosed-note" if f[2] == "Note" else "char-not-closed", f[1], k, f[0]))
        if t.kind == "Marker":
            if scope in ("Character", "Note", "Meta"):
                inline.append((m, k, scope))
            if scope in ("Character", "Note", "Milestone"):
                nested.append((m, k, scope))
        elif t.kind == "EndMarker":
            stray = Issue("stray-close-marker", k, None, m)
            if inline and m in NOTES:
                while inline and sub(inline[-1]):
                    inline.pop()
            if inline and inline[-1][0] == m:
                inline.pop()
            elif any(f[0] == m for f in inline):
                out.append(Issue("misnested-close-marker", k, None, m))
                while (f := inline.pop())[0] != m:
                    out.append(Issue("implicitly-closed-marker", k, None, f[0]))
            else:
                out.append(stray)
            if m in NOTES:
                while nested and sub(nested[-1]):
                    nested.pop()
            at = next((i for i in reversed(range(len(nested))) if nested[i][0] == m and nested[i][2] in ("Note", "Character")), None)
            if at is None:
                out.append(stray)
            else:
                if at + 1 != len(nested):
                    out.append(Issue("misnested-close-marker", k, None, m))
                del nested[at:]
        elif t.kind == "MilestoneEnd":
            # a milestone token opens nothing here, so only what was opened as a marker can match
            at = next((i for i in reversed(range(len(nested))) if nested[i][2] == "Milestone"), None)
            if at is None:
                out.append(Issue("stray-close-marker", k, None, None))
            else:
                del nested[at:]
        if boundary:
            while nested:
                f = nested.pop()
                if f[2] in ("Note", "Character"):
                    out.append(Issue("unclosed-note" if f[2] == "Note" else "unclosed-marker", f[1], k, f[0]))
    end = len(toks) - 1
    for f in reversed(inline):
        out.append(Issue({"Note": "unclosed-note", "Character": "char-not-closed"}.get(f[2], "unclosed-marker"), f[1], end, f[0]))
    for f in nested:
        out.append(Issue("unclosed-note" if f[2] == "Note" else "unclosed-marker", f[1], end, f[0]))
    return out


def issues(toks: list[Token], implicit_verses: bool = False) -> list[Issue]:
    """All of them in order, the first of those with one code, token and related token."""
    first: dict[tuple, Issue] = {}
    for i in context_issues(toks, implicit_verses) + balance_issues(toks):
        first.setdefault((i.code, i.idx, i.related_idx), i)
    return list(first.values())
