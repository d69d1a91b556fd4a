"""Lint issues in full: what a rule found, where, how grave it is, and a fix where there is one."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from scriptorium.functions import markers as mk
from scriptorium.operators import rules, stack_lint
from scriptorium.operators.columns import MARKER, NUMBER, TEXT, Tokens, pick

CATEGORIES = ("document", "structure", "context", "numbering")
SEVERITIES = ("error", "warning")
ISSUE_TYPES = ("usfm", "content")
#: What a code's message says; names in braces are its parameters.
MESSAGES = {
    "missing-id-marker": "the document has no \\id marker",
    "missing-separator-after-marker": "no space parts \\{marker} from the text after it",
    "empty-paragraph": "\\{marker} opens a paragraph that has nothing in it",
    "number-range-after-chapter-marker": "\\{marker} isn't followed by a number",
    "verse-range-expected-after-verse-marker": "\\{marker} isn't followed by a number or range",
    "verse-content-not-empty": "only white space stands after \\v",
    "unknown-token": "{found} looks like a marker but isn't one",
    "char-not-closed": "\\{marker} isn't closed before its paragraph ends",
    "unclosed-note": "note \\{marker} isn't closed",
    "paragraph-before-first-chapter": "paragraph \\{marker} stands before the first chapter",
    "verse-before-first-chapter": "a verse stands before the first chapter",
    "note-submarker-outside-note": "\\{marker} belongs in a note but is outside one",
    "duplicate-id-marker": "the document has more than one \\id marker",
    "id-marker-not-at-file-start": "something stands before \\id",
    "chapter-metadata-outside-chapter": "\\{marker} doesn't follow a chapter's number",
    "verse-metadata-outside-verse": "\\{marker} doesn't follow a verse's number",
    "missing-chapter-number": "the chapter has no number",
    "missing-verse-number": "the verse has no number",
    "missing-milestone-self-close": "milestone \\{marker} isn't closed by \\*",
    "implicitly-closed-marker": "\\{marker} is closed by the end of a marker around it",
    "stray-close-marker": "an end marker closes nothing that is open",
    "misnested-close-marker": "\\{marker}* closes a marker that isn't the innermost",
    "unclosed-marker": "\\{marker} isn't closed",
    "duplicate-chapter-number": "chapter {found} occurs again",
    "chapter-expected-increase-by-one": "chapter {found} doesn't follow on the one before",
    "duplicate-verse-number": "verse {found} occurs again",
    "verse-expected-increase-by-one": "verse {found} doesn't follow on the one before",
    "invalid-number-range": "{found} is no verse number or range",
    "number-range-not-preceded-by-marker-expecting-number": "{found} stands after no marker that takes a number",
    "verse-text-follows-verse-range": "verse {found} has no text",
    "unknown-marker": "\\{marker} isn't a known marker",
    "unknown-close-marker": "\\{marker}* closes a marker that isn't known",
    "inconsistent-chapter-label": "the chapter's label isn't worded as the others are",
    "marker-not-valid-in-context": "\\{marker} isn't allowed where it stands",
    "verse-outside-explicit-paragraph": "a verse stands in no paragraph",
}
CODES = tuple(MESSAGES)
_DOCUMENT = {"missing-id-marker", "paragraph-before-first-chapter", "verse-before-first-chapter", "duplicate-id-marker", "id-marker-not-at-file-start"}
_CONTEXT = {"note-submarker-outside-note", "chapter-metadata-outside-chapter", "verse-metadata-outside-verse", "marker-not-valid-in-context", "verse-outside-explicit-paragraph"}
_NUMBERING = set(CODES[CODES.index("duplicate-chapter-number") : CODES.index("unknown-marker")]) | {"inconsistent-chapter-label"}
_CONTENT = _NUMBERING | {"number-range-after-chapter-marker", "verse-range-expected-after-verse-marker", "verse-content-not-empty", "missing-chapter-number", "missing-verse-number"}


def category(code: str) -> str:
    return "document" if code in _DOCUMENT else "context" if code in _CONTEXT else "numbering" if code in _NUMBERING else "structure"


def severity(code: str) -> str:
    return "warning" if code == "empty-paragraph" else "error"


def issue_type(code: str) -> str:
    return "content" if code in _CONTENT else "usfm"


def allowed(enabled: list[str] | None = None, disabled: list[str] | None = None) -> frozenset[str]:
    """The codes to look for: all or those enabled, without those disabled."""
    if unknown := {*(enabled or ()), *(disabled or ())} - set(CODES):
        raise ValueError(f"no such lint codes: {sorted(unknown)}")
    return frozenset(CODES if enabled is None else enabled) - frozenset(disabled or ())


SCHEMA = (
    "code string, category string, severity string, issue_type string, message string, message_params map<string, string>, span struct<start: bigint, end: bigint>, "
    "related_span struct<start: bigint, end: bigint>, token_id string, related_token_id string, sid string, marker string, fix struct<action: string, target_id: string, new_text: string>"
)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FIX = pa.struct([("action", pa.string()), ("target_id", pa.string()), ("new_text", pa.string())])
TYPES = [*[pa.string()] * 5, pa.map_(pa.string(), pa.string()), _SPAN, _SPAN, *[pa.string()] * 4, _FIX]


def _unlikely(t: Tokens) -> list[tuple[str, np.ndarray]]:
    """Rules that only tokens not made from a source can break: markers within text, and numbers that are none."""
    odd = np.zeros(t.n, dtype=bool)
    slash = t.data[t.start] == 92 if t.n else odd
    for k in np.flatnonzero((t.kind == TEXT) & (slash | (t.data[t.start] == 32) | (t.data[t.start] == 9) if t.n else odd)).tolist():
        m = re.match(r"[ \t]*\\([a-z0-9-]+)(\S)", t.text(k))
        odd[k] = bool(m) and mk.public_kind(m[1]) != "Unknown"
    prev = t.before(t.kind != 1)
    verse = (t.kind == NUMBER) & (pick(t.kind, prev, -1) == MARKER) & t.is_name("v")[pick(t.marker, prev, -1)]
    return [("unknown-token", odd), ("invalid-number-range", verse & (t.num_start == 0))]


def records(t: Tokens, on: frozenset[str], implicit_verses: bool = False) -> tuple[np.ndarray, list[tuple]]:
    """Document and record of each issue, in the order of tokens."""
    hits: list[tuple[int, str, int, str | None]] = []  # token, code, related token, marker
    next_, full = t.step(1), None
    for code, mask in rules.found(t) + _unlikely(t):
        if code not in on:
            continue
        if code == "empty-paragraph" and mask.any():
            full = t.after(~((t.kind == 1) | (t.kind == 2) | rules.blank(t)))
        related = next_ if code == "missing-separator-after-marker" else full if code == "empty-paragraph" and full is not None else None
        hits += [(k, code, -1 if related is None else int(related[k]), None) for k in np.flatnonzero(mask).tolist()]
    if on & stack_lint.CODES:
        for d in np.flatnonzero(t.counts).tolist():
            base = int(t.first[d])
            hits += [(base + i.idx, i.code, -1 if i.related_idx is None else base + i.related_idx, i.marker) for i in stack_lint.issues(t.listed(d), implicit_verses) if i.code in on]
    hits.sort(key=lambda h: h[0])
    at = np.array([h[0] for h in hits], dtype=np.int64)
    other = np.array([h[2] for h in hits], dtype=np.int64)
    ids, sids, names = t.ids(at).to_pylist(), t.references(at).to_pylist(), t.marker_names(at).to_pylist()
    other_ids = t.ids(np.maximum(other, 0)).to_pylist() if len(at) else []
    out = []
    for (k, code, r, marker), id_, other_id, sid, name in zip(hits, ids, other_ids, sids, names):
        base = int(t.offsets[t.doc[k]])
        span = lambda i: {"start": int(t.start[i]) - base, "end": int(t.end[i]) - base}  # noqa: B023, E731
        if code == "missing-id-marker":
            out.append((code, category(code), severity(code), issue_type(code), MESSAGES[code], [("marker", "id")], None, None, None, None, None, "id", None))
            continue
        name = marker or name or ("v" if code in ("invalid-number-range", "verse-text-follows-verse-range", "duplicate-verse-number", "verse-expected-increase-by-one") else None)
        params = {"marker": name} if name else {}
        if "{found}" in MESSAGES[code]:
            params["found"] = t.text(k).strip()
        message = re.sub(r"\{(\w+)\}", lambda m: params.get(m[1], ""), MESSAGES[code])
        fix = {"action": "replace", "target_id": other_id, "new_text": " " + t.text(r)} if code == "missing-separator-after-marker" else None
        related = span(r) if r >= 0 else None
        out.append((code, category(code), severity(code), issue_type(code), message, sorted(params.items()), span(k), related, id_, other_id if r >= 0 else None, sid, name, fix))
    return t.doc[at], out
