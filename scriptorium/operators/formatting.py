"""The formatter: all format rules over one document's tokens, in their fixed order.

The first pass looks back at what it has already written, so it can't be a
window; rules that can are also relational plans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from scriptorium.functions import markers as mk
from scriptorium.operators.scan import Token, tokens
from scriptorium.plans.lint import BODY

RULES = (
    "recover-malformed-markers", "collapse-whitespace-in-text", "ensure-inline-separators", "remove-duplicate-verse-numbers",
    "normalize-spacing-after-paragraph-markers", "remove-unwanted-linebreaks", "bridge-consecutive-verse-markers",
    "remove-orphan-empty-verse-before-contentful-verse", "remove-bridge-verse-enumerators", "move-chapter-label-after-chapter-marker",
    "insert-default-paragraph-after-chapter-intro", "remove-empty-paragraphs", "insert-structural-linebreaks", "collapse-consecutive-linebreaks",
    "normalize-marker-whitespace-at-line-start",
)
DEFAULT = frozenset(RULES) - {"remove-empty-paragraphs"}
_POETRY = frozenset("q q1 q2 q3 q4 q5 qc qa qm qm1 qm2 qm3 qd".split())
_OWN_LINE = frozenset("p m pi pi1 pi2 pi3 pi4 ms ms1 ms2 ms3 li li1 li2 li3 li4 b".split())
_NEW_LINE = frozenset("cl cd d sp r mr sr s s1 s2 s3 s4".split())
_INLINE = ("Character", "Note", "Milestone")
_BOUNDARY = ("Header", "Chapter", "Periph", "SidebarStart", "TableRow", "Unknown")


@dataclass(slots=True)
class Piece:
    """A token that may be rewritten."""

    kind: str
    text: str
    marker: str | None = None
    number: int | None = None

    @property
    def blank(self) -> bool:
        return self.kind == "Text" and not self.text.strip()

    def is_marker(self, *names: str) -> bool:
        return self.kind == "Marker" and (not names or self.marker in names)


def _own_line(m: str) -> bool:
    return m in _OWN_LINE or mk.public_kind(m) == "Unknown"


def _starts_line(m: str) -> bool:
    return _own_line(m) or m in _NEW_LINE or m in _POETRY


def _owner(out: list[Piece], at: int) -> str | None:
    """The marker right before a number, line breaks aside."""
    for k in range(at - 1, -1, -1):
        if out[k].kind != "Newline":
            return out[k].marker if out[k].kind == "Marker" else None
    return None


def _recovered(p: Piece) -> list[Piece] | None:
    m = re.search(r"\\", p.text) if p.kind == "Text" and "\\" in p.text else None
    found = re.match(r"([a-z0-9-]+)[ \t]", p.text[m.end() :]) if m else None
    if not found or mk.public_kind(found[1]) == "Unknown":
        return None
    rest = p.text[m.end() + found.end() :]
    return [x for x in (Piece("Text", p.text[: m.start()]), Piece("Marker", "\\" + found[1], found[1]), Piece("Text", rest)) if x.text]


def recovered(text: str) -> list[tuple[int, Piece]]:
    """The parts, with their places, of a text in which a known marker stands before a space or tab; none if there isn't one."""
    kinds = {"Marker": 1}
    out: list[tuple[int, Piece]] = []
    for p in _recovered(Piece("Text", text)) or []:
        out.append((kinds.get(p.kind, 2 if out and out[-1][0] == 1 else 0), p))
    return out


def _push(out: list[Piece], p: Piece) -> None:
    if p.kind == "Text" and out and out[-1].kind == "Text":
        out[-1].text += p.text
    else:
        out.append(p)


_SEPARATED = frozenset(("Marker", "EndMarker", "Number", "Text"))


def _separated(p: Piece, before: Piece | None) -> None:
    if before is None or before.kind not in _SEPARATED or p.kind not in _SEPARATED:
        return
    if before.text[-1:].isspace() or p.text[:1].isspace():
        return
    if (before.marker and mk.scope_kind(before.marker) in _INLINE) or (p.marker and mk.scope_kind(p.marker) in _INLINE):
        return
    p.text = " " + p.text


def _unwanted(out: list[Piece], later: list[Piece]) -> bool:
    """Whether a line break between what is written and what follows is to go."""
    before, after = out[-1] if out else None, later[0] if later else None
    if before is not None and before.kind == "Marker":
        m = before.marker
        if _own_line(m):
            return False
        if m in _POETRY:
            return not (after is not None and after.kind == "Marker")
        if _starts_line(m):
            return True
    if after is not None and after.is_marker("v"):
        if before is not None and before.kind == "Number" and _owner(out, len(out) - 1) == "c":
            return False
        return len(later) > 1 and later[1].kind == "Number"
    return False


_BLANKS = re.compile("[ \t]+")
_RUN = re.compile("[ \t]{2}|\t")
_LEAD = re.compile("^ +")


def _inline_pass(items: list[Piece], on: frozenset[str]) -> list[Piece]:
    recover, separate, collapse, numbers, spacing, unwanted = (
        rule in on for rule in ("recover-malformed-markers", "ensure-inline-separators", "collapse-whitespace-in-text", "remove-duplicate-verse-numbers", "normalize-spacing-after-paragraph-markers", "remove-unwanted-linebreaks")
    )
    out: list[Piece] = []
    for k, p in enumerate(items):
        if recover and (parts := _recovered(p)):
            for x in parts:
                _push(out, x)
            continue
        before = out[-1] if out else None
        if separate:
            _separated(p, before)
        if p.kind == "Text":
            if collapse and _RUN.search(p.text):
                p.text = _BLANKS.sub(" ", p.text)
            if numbers and before is not None and before.kind == "Number" and _owner(out, len(out) - 1) == "v":
                lead = re.match("[ \t]*", p.text)[0]
                p.text = lead + p.text[len(lead) :].removeprefix(before.text.strip())
            if spacing and p.text[:2] == "  " and before is not None and before.kind == "Marker" and _starts_line(before.marker):
                p.text = _LEAD.sub(" ", p.text)
        if unwanted and p.kind == "Newline" and _unwanted(out, items[k + 1 : k + 3]):
            continue
        _push(out, p)
    return out


def _verse(items: list[Piece], k: int) -> bool:
    return k + 1 < len(items) and items[k].marker == "v" and items[k].kind == "Marker" and items[k + 1].kind == "Number"


def _past_blank(items: list[Piece], k: int) -> int:
    while k < len(items) and items[k].blank:
        k += 1
    return k


def _start(p: Piece) -> int:
    return p.number if p.number is not None else int(re.match(r"\s*([0-9]+)", p.text)[1])


def _strip_enumerators(text: str, low: int, high: int) -> str:
    """Drop ``12. `` and the like for verses of the range, at the start or after white space or a bracket."""
    return re.sub(r"(?:(?<=\s)|(?<=\()|^)([0-9]+)\s*[!-/:-@\[-`{-~]\s*", lambda m: "" if low <= int(m[1]) <= high else m[0], text)


def _verses(items: list[Piece], on: frozenset[str]) -> list[Piece]:
    items, k = list(items), 0

    def clean(at: int) -> None:
        if "remove-bridge-verse-enumerators" in on and _verse(items, at) and at + 2 < len(items) and items[at + 2].kind == "Text":
            if m := re.fullmatch(r"\s*([0-9]+)-([0-9]+)\s*", items[at + 1].text):
                items[at + 2].text = _strip_enumerators(items[at + 2].text, int(m[1]), int(m[2]))

    while k + 1 < len(items):
        if not _verse(items, k):
            k += 1
            continue
        first = last = _start(items[k + 1])
        scan = k + 2
        while "bridge-consecutive-verse-markers" in on:
            at = _past_blank(items, scan)
            if not _verse(items, at) or _start(items[at + 1]) != last + 1:
                break
            last, scan = last + 1, at + 2
        if last > first:
            own = items[k + 1]
            lead, tail = re.match(r"\s*", own.text)[0], re.search(r"\s*$", own.text)[0]
            items[k + 1] = replace(own, text=f"{lead}{first}-{last}{tail}", number=first)
            del items[k + 2 : scan]
            clean(k)
            k += 1
            continue
        at = _past_blank(items, k + 2)
        if "remove-orphan-empty-verse-before-contentful-verse" in on and _verse(items, at) and at + 2 < len(items) and items[at + 2].kind == "Text" and not items[at + 2].blank:
            del items[k:at]
            continue
        clean(k)
        k += 1
    return items


def _labels(items: list[Piece]) -> list[Piece]:
    out, k = [], 0
    while k < len(items):
        if items[k].marker != "cl":
            out.append(items[k])
            k += 1
            continue
        at = k + 1
        while at < len(items) and items[at].kind in ("Newline", "Text"):
            at += 1
        if items[k].is_marker("cl") and at < len(items) and items[at].is_marker("c"):
            end = at + 1 + (at + 1 < len(items) and items[at + 1].kind == "Number")
            out += items[at:end] + items[k:at]
            k = end
        else:
            out.append(items[k])
            k += 1
    return out


def _is_block(p: Piece) -> bool:
    return p.kind == "Marker" and mk.scope_kind(p.marker) in ("Block", "TableRow") and mk.public_kind(p.marker) != "Figure"


def _default_paragraphs(items: list[Piece]) -> list[Piece]:
    """Put a paragraph before a chapter's first verse; done only if the first chapter that has a verse lacks one."""
    out: list[Piece] = []
    state, has, decided = "none", False, None
    for p in items:
        if p.is_marker("c"):
            state, has = "number", False
        elif state == "number":
            state = "intro" if p.kind == "Number" else state
        elif state == "intro":
            has = has or _is_block(p)
            if p.is_marker("v"):
                decided = (not has) if decided is None else decided
                if decided and not has:
                    out.append(Piece("Marker", "\\p", "p"))
                state = "none"
        out.append(p)
    return out


def _no_empty(items: list[Piece]) -> list[Piece]:
    out, k = [], 0
    while k < len(items):
        if items[k].marker not in BODY:
            out.append(items[k])
            k += 1
            continue
        at = k + 1
        while at < len(items) and (items[at].kind in ("Newline", "OptBreak") or items[at].blank):
            at += 1
        if items[k].is_marker(*BODY) and at < len(items) and items[at].kind == "Marker" and (items[at].marker in BODY or mk.public_kind(items[at].marker) in _BOUNDARY):
            k = at
        else:
            out.append(items[k])
            k += 1
    return out


def _linebreaks(items: list[Piece]) -> list[Piece]:
    out: list[Piece] = []
    for k, p in enumerate(items):
        after = items[k + 1] if k + 1 < len(items) else None
        broken = after is not None and after.kind == "Newline"
        if p.kind == "Marker" and _starts_line(p.marker) and out and out[-1].kind != "Newline":
            out.append(Piece("Newline", "\n"))
        out.append(p)
        if p.kind == "Marker":
            wants = (after is not None and after.kind == "Marker") if p.marker in _POETRY else _own_line(p.marker)
        else:
            wants = p.kind == "Number" and _owner(items, k) == "c"
        if wants and not broken:
            out.append(Piece("Newline", "\n"))
    return out


def format_tokens(toks: list[Token], rules: frozenset[str] = DEFAULT) -> list[Piece]:
    """The tokens after these rules, in the rules' fixed order."""
    items = _inline_pass([Piece(t.kind, t.text, t.marker, t.number) for t in toks], rules)
    if rules & {"bridge-consecutive-verse-markers", "remove-orphan-empty-verse-before-contentful-verse", "remove-bridge-verse-enumerators"}:
        items = _verses(items, rules)
    for rule, step in (("move-chapter-label-after-chapter-marker", _labels), ("insert-default-paragraph-after-chapter-intro", _default_paragraphs), ("remove-empty-paragraphs", _no_empty), ("insert-structural-linebreaks", _linebreaks)):
        if rule in rules:
            items = step(items)
    if "collapse-consecutive-linebreaks" in rules:
        items = [p for k, p in enumerate(items) if p.kind != "Newline" or k == 0 or items[k - 1].kind != "Newline"]
    if "normalize-marker-whitespace-at-line-start" in rules:
        for k, p in enumerate(items):
            if p.kind == "Marker" and (k == 0 or items[k - 1].kind == "Newline"):
                p.text = p.text.lstrip()
    return items


def format_usfm(source: str, rules: frozenset[str] = DEFAULT) -> str:
    return "".join(p.text for p in format_tokens(tokens(source), rules))
