"""Trees over the tokens of one document: syntax tree and semantic tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from scriptorium.functions import markers as mk
from scriptorium.operators.scan import Token

_INLINE = ("Note", "Character", "Milestone")
_PARENTS = ("Chapter", "Periph", "Sidebar")


def _opens(toks: list[Token], k: int) -> tuple[str, str] | None:
    """Scope and marker that a token opens; chapter and verse only right before their number."""
    t = toks[k]
    if t.kind not in ("Marker", "Milestone"):
        return None
    scope = mk.scope_kind(t.marker)
    if scope in ("Chapter", "Verse") and not (k + 1 < len(toks) and toks[k + 1].kind == "Number"):
        return None
    return scope, t.marker


def _context(stack: list[tuple[int, str, str]]) -> str | None:
    for _, scope, marker in reversed(stack):
        if scope == "Note":
            return {"Footnote": "Footnote", "CrossReference": "CrossReference"}.get(mk.note_family(marker))
        if scope in ("TableRow", "TableCell"):
            return "Table"
        if scope == "Block":
            return mk.scope_inline_context(marker) or "ChapterContent"
        if scope in ("Periph", "Sidebar", "Header", "Meta"):
            return {"Periph": "PeripheralContent", "Sidebar": "Sidebar"}.get(scope, "Scripture")
    return None


def syntax_parents(toks: list[Token]) -> list[tuple[int | None, int]]:
    """(parent, depth) of each token in the lossless tree; every token is one node."""
    stack: list[tuple[int, str, str]] = []  # node, scope, marker
    out = []

    def drop(*scopes: str) -> None:
        while stack and stack[-1][1] in scopes:
            stack.pop()

    def up_to(*scopes: str) -> None:
        while stack and stack[-1][1] not in scopes:
            stack.pop()

    def cut(found) -> None:
        at = next((k for k in reversed(range(len(stack))) if found(stack[k])), None)
        if at is not None:
            del stack[at:]

    for k, t in enumerate(toks):
        opened = _opens(toks, k)
        scope, marker = opened or (None, None)
        if t.kind == "EndMarker":
            cut(lambda f: f[1] in ("Note", "Character") and f[2] == t.marker)
        elif t.kind == "MilestoneEnd":
            cut(lambda f: f[1] == "Milestone")
        elif scope == "Unknown":
            up_to(*_PARENTS)
        elif scope in _INLINE:
            while (c := _context(stack)) in ("Footnote", "CrossReference") and not mk.allows(marker, c):
                stack.pop()
        elif scope in ("Chapter", "Header", "Meta", "Periph"):
            stack.clear()
        elif scope == "Sidebar":
            up_to("Chapter")
        elif scope is not None:
            drop(*_INLINE, "Verse")
            if scope == "Verse":
                drop("Header", "Meta")
            elif scope == "TableCell":
                drop("TableCell", "Block")
                up_to("TableRow", *_PARENTS)
            elif scope == "TableRow":
                drop("TableCell", "TableRow", "Block")
                up_to(*_PARENTS)
            else:
                drop("Block", "TableCell", "TableRow", "Header", "Meta")
                up_to(*_PARENTS)
        out.append((stack[-1][0] if stack else None, len(stack)))
        if scope not in (None, "Unknown", "Chapter", "Verse"):
            stack.append((k, scope, marker))
    return out


@dataclass
class Node:
    """A node of the semantic tree: a leaf token, a chapter, verse or milestone, or a container."""

    kind: str
    at: int
    number: int | None = None
    attributes: int | None = None
    closed: int | None = None
    children: list[Node] = field(default_factory=list)
    name: str = ""


def _public(marker: str) -> str:
    k = mk.public_kind(marker) if not marker.startswith("z") else "Unknown"
    return "Meta" if marker == "cat" else k


class Builder:
    """Builds the semantic tree in one pass; recovery is by the kinds of what is open."""

    def __init__(self, toks: list[Token]):
        self.toks, self.root = toks, Node("Root", -1)
        self.stack: list[Node] = []
        self.number: Node | None = None  # a chapter or verse that waits for its number
        self.milestone: Node | None = None

    def add(self, node: Node) -> None:
        (self.stack[-1] if self.stack else self.root).children.append(node)

    def open(self, kind: str, at: int, name: str) -> None:
        self.stack.append(Node(kind, at, name=name))

    def close(self) -> None:
        self.add(self.stack.pop())

    def close_while(self, *kinds: str) -> None:
        while self.stack and self.stack[-1].kind in kinds:
            self.close()

    def close_to(self, at: int, end: int | None) -> None:
        while len(self.stack) > at + 1:
            self.close()
        self.stack[-1].closed = end
        self.close()

    def last(self, *kinds: str) -> int | None:
        return next((k for k in reversed(range(len(self.stack))) if self.stack[k].kind in kinds), None)

    def close_notes(self) -> None:
        while (at := self.last("Note")) is not None:
            self.close_to(at, None)

    def close_paragraph(self) -> None:
        self.close_while("Character", "Unknown", "Figure", "TableCell")
        if self.stack and self.stack[-1].kind in ("Paragraph", "Header", "Meta", "TableRow"):
            self.close()

    def block(self, kind: str, k: int, name: str) -> None:
        self.close_notes()
        self.close_paragraph()
        self.open(kind, k, name)

    def starts_block(self) -> bool:
        """Whether an unknown marker is on a line of its own within a paragraph."""
        at = self.last("Paragraph", "Header", "Meta")
        for child in reversed(self.stack[at].children if at is not None else []):
            t = self.toks[child.at]
            if child.kind != "Leaf" or t.kind != "Text" or t.text.strip():
                return child.kind == "Leaf" and t.kind == "Newline"
        return False

    def ends_note_character(self, name: str) -> bool:
        at = self.last("Character")
        if at is None or name == "fv":
            return False
        now = self.stack[at].name
        note = self.last("Note")
        if mk.note_subkind(mk.canonical(name) or "") and mk.note_family(name) and mk.note_family(name) == mk.note_family(self.stack[note].name):
            return True
        sub = mk.note_subkind(mk.canonical(now) or "")
        return sub == "Structural" and name not in ("ref", "jmp")

    def marker(self, k: int) -> None:
        name = self.toks[k].marker
        kind = _public(name)
        if kind == "Chapter":
            self.close_notes()
            self.close_paragraph()
            self.number = Node("Chapter", k)
        elif kind == "Verse":
            self.close_while("Meta")
            self.number = Node("Verse", k)
        elif kind in ("Paragraph", "Header", "SidebarStart", "Periph"):
            self.block(kind, k, name)
        elif kind == "Meta":
            if self.last("Note", "SidebarStart") is not None:
                self.open(kind, k, name)
            else:
                self.block(kind, k, name)
        elif kind == "Character":
            if self.last("Note") is not None and not name.startswith("+") and self.ends_note_character(name):
                self.close_while("Character", "Unknown", "Figure", "TableCell")
            self.open(kind, k, name)
        elif kind == "TableRow":
            self.close_notes()
            self.close_paragraph()
            self.close_while("TableCell")
            if self.stack and self.stack[-1].kind == "TableRow":
                self.close()
            self.open(kind, k, name)
        elif kind == "TableCell":
            self.close_while("TableCell")
            self.open(kind, k, name)
        elif kind == "SidebarEnd":
            at = self.last("SidebarStart")
            if at is not None:
                self.close_to(at, k)
            else:
                self.close_paragraph()
                self.add(Node("Unknown", k))
        elif kind == "Unknown" and self.starts_block():
            self.block("Paragraph", k, name)
        elif not kind.startswith("Milestone"):
            self.open(kind, k, name)

    def end_marker(self, k: int) -> None:
        name = self.toks[k].marker
        note = name in ("f", "fe", "x", "ef", "ex")
        at = next((i for i in reversed(range(len(self.stack))) if self.stack[i].name == name and (not note or self.stack[i].kind == "Note")), None)
        if at is None:
            self.add(Node("Unknown", k))
        else:
            self.close_to(at, k)

    def attribute_list(self, k: int) -> None:
        at = self.last("Character", "Figure", "Periph")
        if self.milestone:
            self.milestone.attributes = k
        elif at is not None:
            self.stack[at].attributes = k
        else:
            self.add(Node("Leaf", k))

    def build(self) -> Node:
        for k, t in enumerate(self.toks):
            if self.milestone and t.kind not in ("AttributeList", "MilestoneEnd"):
                self.add(self.milestone)
                self.milestone = None
            if self.number and t.kind != "Number":
                self.add(self.number)
                self.number = None
            if t.kind == "Marker":
                self.marker(k)
            elif t.kind == "EndMarker":
                self.end_marker(k)
            elif t.kind == "Milestone":
                self.milestone = Node("Milestone", k)
            elif t.kind == "MilestoneEnd":
                if self.milestone:
                    self.milestone.closed = k
                    self.add(self.milestone)
                    self.milestone = None
                else:
                    self.add(Node("Unknown", k))
            elif t.kind == "AttributeList":
                self.attribute_list(k)
            elif t.kind == "Number" and self.number:
                self.number.number = k
                self.add(self.number)
                self.number = None
            else:
                self.add(Node("Leaf", k))
        for waiting in (self.number, self.milestone):
            if waiting:
                self.add(waiting)
        while self.stack:
            self.close()
        return self.root
