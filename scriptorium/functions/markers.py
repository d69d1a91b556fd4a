"""The marker catalog: what every marker name means.

The catalog is written as groups of markers that share kind and contexts. All
other properties are derived from a name and its entry; ``catalog()`` gives them
as a small table, to be joined by the key that ``key_sql`` computes.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_TITLES = "BookTitles BookIntroduction BookIntroductionEndTitles"
_FLOW = f"{_TITLES} Section Para List Table"
_GROUPS: list[tuple[str, str, str]] = [
    ("Character", f"{_FLOW} Footnote", "// bd bdit em it no sc sup"),
    ("Character", _FLOW, "add addpn bk dc fm jmp k nd ord pn png pro qt qt-e qt-s rb rq sig sls ta tl w wa wg wh wj wl"),
    (
        "Paragraph",
        "ChapterContent",
        "b cd cl cls d lf lh li li1 li2 li3 li4 lim lim1 lim2 lim3 m mi mi1 mi2 mi3 mr ms ms1 ms2 ms3 mte mte1 mte2 nb p pb pc ph "
        "pi pi1 pi2 pi3 pm pmc pmo pmr po pr q q1 q2 q3 q4 qa qc qd qm qm1 qm2 qm3 qr r s s1 s2 s3 s4 sd sd1 sd2 sd3 sp sr",
    ),
    ("Chapter", "Scripture ChapterContent", "c"),
    ("Character", "Chapter", "ca cp"),
    ("Meta", "Sidebar Footnote CrossReference", "cat"),
    ("Note", f"{_TITLES} ChapterContent PeripheralContent", "ef ex f fe x"),
    ("Sidebar", "ChapterContent PeripheralContent", "esb esbe"),
    ("Character", "Footnote", "fdc fk fl fp fq fqa fr ft fv fw"),
    ("Figure", f"{_TITLES} ChapterContent PeripheralContent", "fig"),
    ("Paragraph", "BookHeaders", "h ide rem sts toc toc1 toc2 toc3 toca toca1 toca2 toca3"),
    (
        "Paragraph",
        "BookIntroduction",
        "ib ie iex ili ili1 ili2 im imi imq imte imte1 imte2 io io1 io2 io3 io4 iot ipc ipi ipq ipr iq iq1 iq2 iq3 is is1 is2",
    ),
    ("Header", "BookHeaders", "id usfm"),
    ("Paragraph", _TITLES, "imt imt1 imt2 imt3 imt4"),
    ("Character", "BookIntroduction", "ior iqt"),
    ("Paragraph", "BookIntroduction ChapterContent", "ip lit"),
    ("Character", "List", "lik litl liv"),
    ("Paragraph", "BookTitles BookIntroductionEndTitles", "mt mt1 mt2 mt3 mt4"),
    ("Periph", "Peripheral", "periph"),
    ("Character", "Para", "qac qs"),
    ("Character", f"{_FLOW} Footnote CrossReference", "ref xt"),
    ("TableCell", "Table", "tc tcc tcr th thc thr"),
    ("TableRow", "ChapterContent", "tr"),
    ("Milestone", "ChapterContent", "vid vid-e vid-s"),
    ("Verse", "Scripture ChapterContent Para List Table", "v"),
    ("Character", "Verse", "va vp"),
    ("Character", "CrossReference", "xdc xk xnt xo xop xot xq xta"),
]
DEPRECATED = frozenset("addpn fdc ph pro xdc".split())
SPECS: dict[str, tuple[str, tuple[str, ...]]] = {m: (kind, tuple(ctx.split())) for kind, ctx, names in _GROUPS for m in names.split()}
SPECS["ts-s / ts-e"] = ("Milestone", ("ChapterContent",))  # one entry that names both; its halves are unknown by themselves
_HIGHEST = dict.fromkeys("h toc toca iq mi ph pi qm ms lim sd".split(), 3) | dict.fromkeys("is ili imte mte".split(), 2)
_HIGHEST |= dict.fromkeys("imt mt q s io li".split(), 4) | {"liv": 5}
_CELL = re.compile(r"(thr|thc|th|tcr|tcc|tc)[0-9-]+")
BOOKS = frozenset(
    "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB "
    "ZEP HAG ZEC MAL MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV TOB JDT ESG WIS "
    "SIR BAR LJE S3Y SUS BEL 1MA 2MA 3MA 4MA 1ES 2ES MAN PS2 ODA PSS EZA 5EZ 6EZ DAG PS3 2BA LBA JUB ENO 1MQ 2MQ 3MQ REP 4BA LAO "
    "FRT BAK OTH INT CNC GLO TDX NDX".split()
)


@lru_cache(maxsize=4096)
def bare(marker: str) -> str:
    return marker.removeprefix("+")


@lru_cache(maxsize=4096)
def canonical(marker: str) -> str | None:
    """The catalog entry that a marker name stands for."""
    m = bare(marker)
    if m in SPECS:
        return m
    if m.endswith(("-s", "-e")):
        base = m[:-2].rstrip("0123456789")
        if SPECS.get(base, ("",))[0] == "Milestone":
            return base
    if cell := _CELL.fullmatch(m):
        return cell[1]
    if number := re.fullmatch(r"([^0-9]*)([0-9]+)", m):
        if int(number[2]) <= _HIGHEST.get(number[1], -1) and number[1] in SPECS:
            return number[1]
    return None


@lru_cache(maxsize=4096)
def kind(marker: str) -> str | None:
    c = canonical(marker)
    return SPECS[c][0] if c else None


def contexts(marker: str) -> tuple[str, ...]:
    c = canonical(marker)
    return SPECS[c][1] if c else ()


def is_list(m: str) -> bool:
    return m in ("lf", "lh") or m.startswith("li")


def is_section(m: str) -> bool:
    return m in ("cd", "cl", "d", "mr", "r") or m.startswith("ms") or (m.startswith("s") and m != "sts")


@lru_cache(maxsize=4096)
def note_family(marker: str) -> str | None:
    m = bare(marker)
    if m == "ef" or m.startswith("f"):
        return "Footnote"
    return "CrossReference" if m == "ex" or m.startswith("x") else None


@lru_cache(maxsize=4096)
def note_subkind(marker: str) -> str | None:
    m = bare(marker)
    if m in "fr fq fqa fl fw fp fv fdc fm xo xop xk xt xta xot xnt xdc".split():
        return "Structural"
    return "StructuralKeepsNestedCharsOpen" if m in ("ft", "fk", "xq") else None


def inline_context(marker: str) -> str | None:
    m = bare(marker)
    if m == "tr" or _CELL.fullmatch(m):
        return "Table"
    if is_list(m):
        return "List"
    if is_section(m):
        return "Section"
    return "Para" if kind(m) == "Paragraph" and {"ChapterContent", "PeripheralContent"} & set(contexts(m)) else None


def family(marker: str) -> str | None:
    c = canonical(marker)
    if c is None or c in ("s", "s1", "s2", "s3", "s4", "r"):
        return None
    if note_family(c):
        return note_family(c)
    if SPECS[c][0] in ("Milestone", "Sidebar", "TableCell"):
        return SPECS[c][0]
    return "ListParagraph" if is_list(c) else "SectionParagraph" if is_section(c) else None


def family_role(marker: str) -> str | None:
    m, c = bare(marker), canonical(marker)
    if c is None:
        return None
    if m == "esbe":
        return "Alias"
    return "MilestoneEnd" if m.endswith("-e") else "MilestoneStart" if m.endswith("-s") else "Canonical" if m == c else "NumberedVariant"


@lru_cache(maxsize=4096)
def default_attribute(marker: str) -> str | None:
    c = canonical(marker) or ""
    if c in ("qt-s", "qt-e"):
        return "who"
    return {"w": "lemma", "rb": "gloss", "jmp": "link-href", "xt": "link-href", "ref": "loc", "fig": "src"}.get(c)


_SCOPES = {"Paragraph": "Block", "Figure": "Block"}
_NO_INLINE = frozenset("h toc toca imt imte is ip ipi im imi imq ipq ipr ib ili iot io iex mt mte".split())


@lru_cache(maxsize=4096)
def scope_kind(marker: str) -> str:
    k = kind(marker)
    return "Unknown" if k is None else _SCOPES.get(k, k)


@lru_cache(maxsize=4096)
def scope_inline_context(marker: str) -> str | None:
    k, m = kind(marker), bare(marker)
    if k in ("TableRow", "TableCell"):
        return "Table"
    if k != "Paragraph":
        return None
    if is_list(m):
        return "List"
    if is_section(m):
        return "Section"
    if m in "p m po pr cls pmo pm pmc pmr nb pc b lit".split() or m.startswith(("q", "pi", "ph", "mi")):
        return "Para"
    if m in _NO_INLINE or m.startswith(("mt", "is", "ili", "io")):
        return None
    return inline_context(canonical(m))


def supports_verse(marker: str) -> bool:
    """Whether a paragraph may hold verse text."""
    if bare(marker) == "lit":
        return True
    c = canonical(marker)
    return bool(c) and SPECS[c][0] == "Paragraph" and inline_context(c) in ("Para", "List") and "ChapterContent" in SPECS[c][1]


def closing(marker: str) -> str | None:
    k = kind(marker)
    if k == "Character":
        return "OptionalExplicitUntilNoteEnd" if note_subkind(canonical(marker)) else "RequiredExplicit"
    return {None: None, "Note": "RequiredExplicit", "Milestone": "SelfClosingMilestone"}.get(k, "None")


def block_behavior(marker: str) -> str | None:
    k, c = kind(marker), canonical(marker)
    if k == "Paragraph":
        return f"Paragraph{inline_context(c)}" if inline_context(c) else "None"
    if k == "Sidebar":
        return "SidebarEnd" if c == "esbe" else "SidebarStart"
    return k if k in ("TableRow", "TableCell") else None if k is None else "None"


def is_note_sub(marker: str) -> bool:
    return kind(marker) == "Character" and bool({"Footnote", "CrossReference"} & set(contexts(marker)))


@lru_cache(maxsize=4096)
def public_kind(marker: str) -> str:
    """The kind as the catalog's users see it: milestones and sidebars by their end, ``z`` names unknown."""
    k, m = kind(marker), bare(marker)
    if k is None or m.startswith("z"):
        return "Unknown"
    if k == "Milestone":
        return "MilestoneEnd" if m.endswith("-e") else "MilestoneStart"
    if k == "Sidebar":
        return "SidebarEnd" if m == "esbe" else "SidebarStart"
    return k


def category(marker: str) -> str:
    if bare(marker) in ("id", "usfm"):
        return "Document"
    if is_note_sub(marker):
        return "NoteSubmarker"
    k = public_kind(marker)
    return "NoteContainer" if k == "Note" else k


@lru_cache(maxsize=4096)
def allows(marker: str, context: str) -> bool:
    """Whether a marker is allowed in a context, plain characters in notes and chapter content in peripherals included."""
    own = set(contexts(marker))
    if context in own or (context == "PeripheralContent" and "ChapterContent" in own):
        return True
    return context in ("Footnote", "CrossReference") and kind(marker) == "Character" and bool({"Section", "Para", "List", "Table"} & own)


ALL_CONTEXTS = tuple(dict.fromkeys(c for _, ctx in SPECS.values() for c in ctx))
SCHEMA = (
    "key string, canonical string, spec_kind string, category string, family string, family_role string, note_family string, note_subkind string, "
    "inline_context string, scope_kind string, scope_inline string, supports_verse boolean, note_sub boolean, default_attribute string, closing string, "
    "block_behavior string, deprecated boolean, contexts array<string>"
)


def row(key: str) -> tuple:
    c = canonical(key)
    note = None if c is None else note_family(c)
    return (
        key, c, kind(key), category(key), family(key), family_role(key), note, None if c is None else note_subkind(c), None if c is None else inline_context(c),
        scope_kind(key), scope_inline_context(key), supports_verse(key), is_note_sub(key), default_attribute(key), closing(key), block_behavior(key), c in DEPRECATED,
        [x for x in ALL_CONTEXTS if allows(key, x)],
    )


@lru_cache(maxsize=1)
def rows() -> list[tuple]:
    """A row for every key that a known marker can have."""
    keys = [m for m in SPECS if " " not in m] + [f"{b}{n}" for b, top in _HIGHEST.items() for n in range(top + 1)]
    return [row(k) for k in dict.fromkeys(keys)]


def catalog(spark: SparkSession) -> DataFrame:
    """The catalog as a table; its size doesn't depend on any data."""
    return spark.createDataFrame(rows(), SCHEMA)


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)
