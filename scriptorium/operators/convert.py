"""Conversions of one document: markup to JSON, XML and HTML, and back."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape as _escape

from scriptorium.functions import markers as mk
from scriptorium.functions.labels import ordinal
from scriptorium.operators.scan import Token, tokens
from scriptorium.operators.trees import Builder, Node

VERSION = "3.1"


class _Json:
    """JSON nodes of a semantic tree."""

    def __init__(self, toks: list[Token]):
        self.toks = toks

    def attributes(self, node: Node, name: str) -> dict[str, str]:
        out: dict[str, str] = {}
        if node.attributes is not None:
            t = self.toks[node.attributes]
            default = mk.default_attribute(name)
            raw = t.text.strip()[1:].strip()
            entries = t.entries or ([(default, raw)] if default and raw else [])
            out.update(("file" if name == "fig" and k == "src" else k, v) for k, v in entries)
        for c in node.children:
            if c.kind == "Leaf":
                out.update(self.toks[c.at].entries)
        return dict(sorted(out.items()))

    def content(self, nodes: list[Node]) -> list:
        out: list = []
        table = None
        for n in nodes:
            if n.kind == "TableRow":
                if table is None:
                    table = {"type": "table", "content": []}
                    out.append(table)
                table["content"] += self.node(n)
                continue
            table = None
            out += self.node(n)
        return out

    def element(self, kind: str, name: str | None, node: Node, content: list | None = None, **more) -> dict:
        out = {"type": kind} | ({"marker": name} if name is not None else {}) | {k: v for k, v in more.items() if v is not None}
        content = self.content(node.children) if content is None else content
        return out | ({"content": content} if content else {}) | {k: v for k, v in self.attributes(node, name or "").items() if k not in more}

    def node(self, n: Node) -> list:
        t = self.toks[n.at]
        if n.kind == "Leaf":
            return [t.text] if t.kind == "Text" else [{"type": "optbreak"}] if t.kind == "OptBreak" else []
        if n.kind in ("Chapter", "Verse"):
            number = self.toks[n.number].text.strip() if n.number is not None else ""
            sid = t.sid if n.kind == "Verse" or t.sid is None else f"{t.book} {t.chapter}"
            return [{"type": n.kind.lower(), "marker": t.marker, "number": number} | ({"sid": sid} if sid else {})]
        if t.marker is None:
            return []
        name = mk.bare(t.marker)
        if n.kind == "Milestone":
            return [{"type": "ms", "marker": name} | self.attributes(n, name)]
        if name == "usfm":
            return []
        kind = mk.kind(name) if t.kind == "Marker" else None
        if name == "id" and kind == "Header":
            return [self.book(n)]
        if kind == "Note":
            return [self.note(n, name)]
        if kind == "Character":
            return self.character(n, name)
        if kind == "Figure":
            return [self.inline(n, name, "figure") if n.closed is not None else {"type": "char", "marker": name} | self.merged(n)]
        if kind == "Periph":
            return [self.periph(n)]
        if kind == "Sidebar":
            category, children = self.category(n)
            return [self.element("sidebar", name, n, self.content(children), category=category)]
        if kind == "TableRow":
            return [self.element("table:row", name, n)]
        if kind == "TableCell":
            return [self.element("table:cell", name, n, align="end" if name.startswith(("thr", "tcr")) else "start")]
        if kind in ("Paragraph", "Header", "Meta") or (kind is None and n.kind in ("Paragraph", "Header", "Meta")):
            return [self.element("para", name, n)]
        return [self.element("unknown", name, n)]

    def book(self, n: Node) -> dict:
        code, rest = "", []
        for c in n.children:
            t = self.toks[c.at]
            if c.kind == "Leaf" and t.kind == "BookCode" and not code:
                code = t.text.strip()
            elif c.kind == "Leaf" and t.kind == "Text" and not code:
                m = re.match(r"(\s*)([A-Za-z0-9]{3})", t.text)
                code = m[2] if m else ""
                tail = " " * len(m[1]) + t.text[m.end() :] if m and t.text[m.end() :] else None if m else t.text
                rest += [tail] if tail else []
            else:
                rest += self.node(c)
        pairs = zip(self.toks, self.toks[1:])
        if code == "MAT" and any(a.marker == "mt1" and a.kind == "Marker" and b.kind == "Text" and b.text.strip() == "Alternate Texts" for a, b in pairs):
            code = "XXA"
        return self.element("book", "id", n, rest, code=code)

    def category(self, n: Node) -> tuple[str | None, list[Node]]:
        category, rest = None, []
        for c in n.children:
            if c.kind not in ("Leaf", "Chapter", "Verse", "Milestone") and self.toks[c.at].marker == "cat":
                category = "".join(x for x in self.content(c.children) if isinstance(x, str)).strip() or None
            else:
                rest.append(c)
        return category, rest

    def note(self, n: Node, name: str) -> dict:
        category, children = self.category(n)
        caller, content, started = "+", [], any(c not in children for c in n.children[:1])
        for c in children:
            t = self.toks[c.at]
            if c.kind == "Leaf" and t.kind == "Text" and not started:
                text = t.text.lstrip()
                caller = re.match(r"\S*", text)[0] or "+"
                content += [text[len(caller) :]] if text and text[len(caller) :] else []
                started = True
            else:
                made = self.content([c])
                content += made
                started = started or bool(made)
        return self.element("note", name, n, content, caller=caller, category=category)

    def merged(self, n: Node) -> dict:
        """Content of an unclosed figure or of characters with a list that has no entries and no default: its text stays text."""
        parts = [(c.at, self.content([c])) for c in n.children]
        if n.attributes is not None:
            text = self.toks[n.attributes].text.strip()
            parts.append((n.attributes, [text + (" " if self.toks[n.at].marker == "fig" else "")]))
        content: list = []
        for _, made in sorted(parts, key=lambda x: x[0]):
            for x in made:
                if isinstance(x, str) and content and isinstance(content[-1], str) and self.toks[n.at].marker == "fig":
                    content[-1] += x
                else:
                    content.append(x)
        return {"content": content} if content else {}

    def inline(self, n: Node, name: str, kind: str) -> dict:
        head = {"type": kind} | ({"marker": name} if kind != "ref" else {})
        bare = n.attributes is not None and not self.toks[n.attributes].entries
        default = mk.default_attribute(name)
        if bare and default is None:
            return head | self.merged(n)
        attributes, children = self.attributes(n, name), n.children
        if bare and default:
            at = next((k for k in reversed(range(len(children))) if children[k].kind == "Leaf" and self.toks[children[k].at].kind == "Text" and self.toks[children[k].at].text.strip()), None)
            if at is not None:
                value = self.toks[children[at].at].text.strip()
                children = children[:at] + children[at + 1 :]
                attributes.setdefault("file" if name == "fig" and default == "src" else default, value)
        content = self.content(children)
        return head | ({"content": content} if content else {}) | dict(sorted(attributes.items()))

    def character(self, n: Node, name: str) -> list:
        kind = "ref" if name == "ref" else "char"
        if mk.note_subkind(name) == "Structural":
            at = next((k for k, c in enumerate(n.children) if c.kind not in ("Leaf", "Chapter", "Verse", "Milestone") and self.toks[c.at].kind == "Marker" and mk.note_subkind(self.toks[c.at].marker)), None)
            if at is not None:
                head = Node(n.kind, n.at, attributes=n.attributes, closed=n.closed, children=n.children[:at], name=n.name)
                return [self.inline(head, name, kind), *self.content(n.children[at:])]
        return [self.inline(n, name, kind)]

    def periph(self, n: Node) -> dict:
        alt, content = None, []
        for c in n.children:
            t = self.toks[c.at]
            if c.kind == "Leaf" and t.kind == "Text" and alt is None:
                alt = t.text.strip() or None
            else:
                content += self.content([c])
        return self.element("periph", None, n, content, alt=alt)


def usfm_to_usj(source: str) -> dict:
    return tokens_to_usj(tokens(source))


def tokens_to_usj(toks: list[Token]) -> dict:
    return {"type": "USJ", "version": VERSION, "content": _Json(toks).content(Builder(toks).build().children)}


# ---- XML

_TAGS = {"table:row": "row", "table:cell": "cell", "unknown": "para"}
_OWN = ("type", "marker", "content")


def _xml(tag: str, attributes: dict, inside: str | None = None) -> str:
    text = "".join(f' {k}="{xml_escape(str(v))}"' for k, v in attributes.items())
    return f"<{tag}{text}/>" if not inside else f"<{tag}{text}>{inside}</{tag}>"


_SPECIAL = re.compile("[&<>\"']")


def xml_escape(text: str) -> str:
    return text if _SPECIAL.search(text) is None else _escape(text, {'"': "&quot;", "'": "&apos;"})


class _Xml:
    """XML of JSON content; ends of verses and chapters are written as elements with eid."""

    def __init__(self) -> None:
        self.chapter: str | None = None
        self.verse: str | None = None

    def end(self, what: str) -> str:
        sid = getattr(self, what)
        setattr(self, what, None)
        return _xml(what, {"eid": sid}) if sid else ""

    def nodes(self, content: list) -> str:
        return "".join(xml_escape(x) if isinstance(x, str) else self.element(x) for x in content)

    def element(self, x: dict) -> str:
        kind, more = x["type"], {k: v for k, v in x.items() if k not in _OWN}
        style = {"style": x["marker"]} if "marker" in x else {}
        if kind == "optbreak":
            return "<optbreak/>"
        if kind in ("chapter", "verse"):
            before = self.end("verse") + (self.end("chapter") if kind == "chapter" else "")
            if more.get("sid"):
                setattr(self, kind, more["sid"])
            return before + _xml(kind, {"number": more.pop("number", "")} | style | more)
        if kind == "ms":
            return _xml("ms", style | more)
        if kind == "unmatched":
            return _xml("unmatched", {"marker": x["marker"]} | more)
        if kind == "book":
            more = {"code": more.pop("code", "")} | style | more
        elif kind == "unknown":
            more = style | {"status": "unknown"} | more
        else:
            more = style | more
        saved = self.verse
        out = _xml(_TAGS.get(kind, kind), more, self.nodes(x.get("content", [])))
        if kind == "sidebar":
            self.verse = saved
        return out + (self.end("verse") if kind in ("para", "table") else "")


def usj_to_usx(usj: dict, version: str | None = None) -> str:
    w = _Xml()
    inside = w.nodes(usj.get("content", [])) + w.end("verse") + w.end("chapter")
    return f'<?xml version="1.0" encoding="utf-8"?><usx version="{xml_escape(version or usj.get("version", VERSION))}">{inside}</usx>'


def usx_version(source: str) -> str:
    """The version that a ``usfm`` line names, 3.0 without one."""
    m = re.search(r"^\s*\\usfm (3\.1|2\.)?", source, re.M)
    return {"3.1": "3.1", "2.": "2.0"}.get(m[1] if m else None, "3.0")


def usfm_to_usx(source: str) -> str:
    return tokens_to_usx(tokens(source), usx_version(source))


def tokens_to_usx(toks: list[Token], version: str = VERSION) -> str:
    return usj_to_usx(tokens_to_usj(toks), version)


def _kept(text: str | None) -> list[str]:
    """Text, unless it is white space that only lays the file out."""
    return [text] if text and (text.strip() or not re.search(r"[\n\r\t]", text)) else []


_KINDS = {"row": "table:row", "cell": "table:cell"}


def _from_xml(e: ET.Element) -> list:
    attributes = dict(e.attrib)
    if "eid" in attributes:
        return []
    attributes.pop("vid", None)
    kind = "unknown" if e.tag == "para" and attributes.get("status") == "unknown" else _KINDS.get(e.tag, e.tag)
    if kind == "unknown":
        attributes.pop("status")
    marker = attributes.pop("style", None) if kind != "unmatched" else attributes.pop("marker", None)
    content = _kept(e.text)
    for child in e:
        content += _from_xml(child) + _kept(child.tail)
    return [{"type": kind} | ({"marker": marker} if marker is not None else {}) | attributes | ({"content": content} if content else {})]


def usx_to_usj(usx: str) -> dict:
    root = ET.fromstring(usx.encode())
    if root.tag != "usx":
        raise ValueError(f"the root is {root.tag}, not usx")
    content = _kept(root.text)
    for child in root:
        content += _from_xml(child) + _kept(child.tail)
    return {"type": "USJ", "version": root.get("version", VERSION), "content": content}


# ---- markup again


def _list(x: dict, *own: str) -> str:
    """Attributes as an attribute list."""
    rest = {k: v for k, v in x.items() if k not in (*_OWN, *own)}
    if x.get("marker") == "fig" and "file" in rest:
        rest["src"] = rest.pop("file")
    value = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"')
    return "|" + " ".join(f'{k}="{value(v)}"' for k, v in rest.items()) if rest else ""


def _markup(content: list, nested: bool = False) -> str:
    return "".join(x if isinstance(x, str) else _element(x, nested) for x in content)


def _opening(name: str, inside: str) -> str:
    return f"\\{name}" + ("" if inside.startswith((" ", "\n")) or not inside else " ")


def _element(x: dict, nested: bool) -> str:
    kind, name = x["type"], x.get("marker", "")
    inside = _markup(x.get("content", []), kind in ("char", "ref"))
    if kind == "book":
        return f"\\id {x.get('code', '')}{inside}\n" if inside.startswith(" ") or not inside else f"\\id {x.get('code', '')} {inside}\n"
    if kind == "chapter":
        return f"\\c {x.get('number', '')}".rstrip(" ") + "\n"
    if kind == "verse":
        return f"\\v {x.get('number', '')}".rstrip(" ")
    if kind == "para":
        return f"{_opening(name, inside)}{inside.rstrip(chr(10))}\n"
    if kind in ("char", "ref", "figure"):
        name = ("+" if nested and kind == "char" else "") + (name or "ref")
        return f"{_opening(name, inside)}{inside}{_list(x)}\\{name}*"
    if kind == "note":
        category = f" \\cat {x['category']}\\cat*" if x.get("category") else ""
        return f"\\{name} {x.get('caller', '+')}{category}{inside if inside.startswith((' ', chr(92))) or not inside else ' ' + inside}\\{name}*"
    if kind == "ms":
        attributes = _list(x)
        return f"\\{name}{' ' + attributes if attributes else ''}\\*"
    if kind == "table":
        return inside
    if kind == "table:row":
        return f"\\{name} {inside}\n"
    if kind == "table:cell":
        return f"{_opening(name, inside)}{inside}"
    if kind == "sidebar":
        category = f" \\cat {x['category']}\\cat*" if x.get("category") else ""
        return f"\\{name}{category}\n{inside}\\esbe\n"
    if kind == "periph":
        return f"\\periph {x.get('alt', '')}{_list(x, 'alt')}\n{inside}"
    if kind == "optbreak":
        return "//"
    if kind == "unmatched":
        return f"\\{name}*"
    return f"{_opening(name, inside)}{inside}"


def usj_to_usfm(usj: dict) -> str:
    if usj.get("type") != "USJ":
        raise ValueError(f"the root's type is {usj.get('type')!r}, not USJ")
    return _markup(usj.get("content", []))


def usx_to_usfm(usx: str) -> str:
    return usj_to_usfm(usx_to_usj(usx))


# ---- HTML

_NATIVE = {"para": "p", "char": "span", "ref": "a", "table": "table", "table:row": "tr", "table:cell": "td", "sidebar": "aside", "figure": "figure", "note": "span", "periph": "section"}


def html_escape(text: str) -> str:
    return text if _SPECIAL.search(text) is None else text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


class _Html:
    def __init__(self, native: bool, notes: str, style: str, scope: str):
        if notes not in ("extracted", "inline") or scope not in ("verse", "document"):
            raise ValueError(f"no such option: {notes}, {scope}")
        self.native, self.notes, self.style, self.scope = native, notes, style, scope
        self.collected: list[str] = []
        self.count = 0

    def caller(self, x: dict) -> str:
        """The label of a note: the source's own caller, or its number in the verse or document."""
        own = x.get("caller", "+")
        if self.style == "source" and own not in ("", "+", "-"):
            return own
        self.count += 1
        return ordinal(self.count, self.style)

    def tag(self, x: dict) -> str:
        tag = _NATIVE.get(x["type"], "span") if self.native else "div" if x["type"] in ("para", "table", "table:row", "sidebar", "periph") else "span"
        return "th" if tag == "td" and str(x.get("marker", "")).startswith("th") else tag

    def nodes(self, content: list) -> str:
        return "".join(html_escape(x) if isinstance(x, str) else self.element(x) for x in content)

    def element(self, x: dict) -> str:
        kind = x["type"]
        if kind == "optbreak":
            return "<wbr>"
        tag = self.tag(x)
        data = {"type": kind.replace(":", "-")} | {k: v for k, v in x.items() if k not in ("type", "content")}
        attributes = "".join(f' data-usfm-{k if k.islower() else re.sub("(?<=.)([A-Z])", r"-\1", k).lower()}="{html_escape(str(v))}"' for k, v in data.items())
        if kind in ("chapter", "verse") and self.scope == "verse":
            self.count = 0
        caller = html_escape(self.caller(x)) if kind == "note" else ""
        inside = html_escape(x.get("number", "")) if kind in ("chapter", "verse") else self.nodes(x.get("content", []))
        if kind == "note" and self.notes == "extracted":
            n = len(self.collected) + 1
            self.collected.append(f'<li id="note-{n}"{attributes}><span class="usfm-caller">{caller}</span>{inside}</li>')
            return f'<sup class="usfm-caller"><a href="#note-{n}">{caller}</a></sup>'
        if kind == "note":
            inside = f'<sup class="usfm-caller">{caller}</sup>{inside}'
        return f'<{tag} class="usfm-{html_escape(x.get("marker", kind))}"{attributes}>{inside}</{tag}>'


def usfm_to_html(source: str, wrap_root: bool = False, native: bool = True, notes: str = "extracted", caller_style: str = "numeric", caller_scope: str = "verse") -> str:
    return tokens_to_html(tokens(source), wrap_root, native, notes, caller_style, caller_scope)


def tokens_to_html(toks: list[Token], wrap_root: bool = False, native: bool = True, notes: str = "extracted", caller_style: str = "numeric", caller_scope: str = "verse") -> str:
    return usj_to_html(tokens_to_usj(toks), wrap_root, native, notes, caller_style, caller_scope)


def usj_to_html(usj: dict, wrap_root: bool = False, native: bool = True, notes: str = "extracted", caller_style: str = "numeric", caller_scope: str = "verse") -> str:
    """HTML of the semantic tree.

    Notes follow in a list (``extracted``) or stay in place (``inline``); their labels
    are numbers, letters, roman numerals or the source's callers, counted in each
    ``verse`` or the ``document``.
    """
    w = _Html(native, notes, caller_style, caller_scope)
    body = w.nodes(usj["content"])
    if w.collected:
        body += f'<ol class="usfm-notes">{"".join(w.collected)}</ol>'
    return f'<div data-usfm-root="true">{body}</div>' if wrap_root else body


def to_json(usj: dict) -> str:
    return json.dumps(usj, ensure_ascii=False, separators=(",", ":"))
