"""Tokens of one document, for operators that need a stack.

The relational plans make the same tokens with windows; tests hold the two
against each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from scriptorium.functions.numbers import number_at
from scriptorium.plans.tokens import ENTRY, LEXEME, MOST, NUMBERED

_LEXEME = re.compile(LEXEME)
_ENTRY = re.compile(ENTRY)
_NAME = re.compile(r"\+?[a-z]+[0-9]*(?:-[0-9]+|-[se])?")
_BOOK = re.compile(r"[A-Za-z0-9]{3}[\x00-\x7f]*", re.S)


class Token(NamedTuple):
    kind: str
    text: str
    marker: str | None = None
    book: str | None = None
    chapter: int = 0
    verse: int = 0
    number: int | None = None

    @property
    def entries(self) -> list[tuple[str, str]]:
        """Entries of an attribute list, with their escapes undone."""
        return [(k, re.sub(r"\\(.)", r"\1", v, flags=re.S)) for k, v in _ENTRY.findall(self.text)] if self.kind == "AttributeList" else []

    @property
    def sid(self) -> str | None:
        return None if self.book is None else f"{self.book} {self.chapter}:{self.verse}"


def _kind(lexeme: str) -> tuple[str, str | None]:
    c = lexeme[0]
    if c == "\\" and (name := _NAME.match(lexeme, 1)):
        return ("EndMarker" if lexeme[-1] == "*" else "Milestone" if name[0].endswith(("-s", "-e")) else "Marker"), name[0]
    if lexeme == "\\*":
        return "MilestoneEnd", None
    if c in "\r\n":
        return "Newline", None
    if c in " \t":
        return "Whitespace", None
    return ("AttributeList" if c == "|" else "OptBreak" if lexeme == "//" else "Text"), None


def pieces(source: str) -> Iterator[tuple[str, str, str | None, int | None]]:
    """(kind, text, marker, number) of each lexeme, payloads cut off their text."""
    waits = ""
    for lexeme in _LEXEME.findall(source):
        kind, marker = _kind(lexeme)
        if kind == "Text" and waits == "id" and _BOOK.fullmatch(lexeme):
            yield "BookCode", lexeme[:3], None, None
            lexeme = lexeme[3:]
        elif kind == "Text" and waits in NUMBERED and (n := number_at(lexeme)) and 0 < int(re.match("[0-9]+", lexeme)[0]) <= MOST:
            yield "Number", n, None, int(re.match("[0-9]+", lexeme)[0])
            lexeme = lexeme[len(n) :]
        if lexeme:
            yield kind, lexeme, marker, None
        if kind not in ("Whitespace", "Newline"):
            waits = marker if kind == "Marker" else ""


def attach(source: str) -> list[list]:
    """[kind, text, marker, number] with white space given to its neighbour and texts joined."""
    out: list[list] = []
    space = ""
    for kind, text, marker, number in pieces(source):
        if kind == "Whitespace":
            space = text
            continue
        if space and kind in ("Newline", "AttributeList"):
            if out:
                out[-1][1] += space
            else:
                out.append(["Text", space, None, None])
        else:
            text = space + text
        space = ""
        if kind == "Text" and out and out[-1][0] == "Text":
            out[-1][1] += text
        else:
            out.append([kind, text, marker, number])
    if space:
        if out:
            out[-1][1] += space
        else:
            out.append(["Text", space, None, None])
    return out


def tokens(source: str) -> list[Token]:
    """All tokens; their texts joined are the source."""
    rows = attach(source)
    book, running, chapter, verse = None, 0, 0, 0
    out = []
    for k, (kind, text, marker, number) in enumerate(rows):
        if kind == "BookCode":
            book, chapter, verse = text.strip(), 0, 0
        elif kind == "Marker" and marker in ("c", "v") and k + 1 < len(rows) and rows[k + 1][0] == "Number":
            if marker == "c":
                running = rows[k + 1][3]
            chapter, verse = running, 0 if marker == "c" else rows[k + 1][3]
        out.append(Token(kind, text, marker, book, chapter, verse, number))
    return out
