"""Operators over a table of documents that need a stack for each document.

Each is one pass of Arrow batches without a shuffle: a document is a row. A
document that can't be read has a null result and its fault in ``error``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StructField, StructType

from scriptorium.functions import markers as mk
from scriptorium.functions.spread import spread
from scriptorium.operators import blocks, convert, formatting, issues, relations, trees
from scriptorium.operators import stack_lint as stack_rules
from scriptorium.operators.align import align
from scriptorium.operators.columns import Tokens, passes, utf8
from scriptorium.operators.scan import Token, tokens
from scriptorium.plans.nodes import WITHOUT


def _each(docs: DataFrame, name: str, make: Callable[[str], str], column: str = "source") -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in passes(batch.column(1)):
                out, errors = [], []
                for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                    try:
                        out.append(None if text is None else make(text))
                        errors.append(None)
                    except Exception as e:  # a faulty document must not end the job
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["doc_id", name, "error"])

    return spread(docs.select("doc_id", F.col(column).cast("string"))).mapInArrow(run, f"doc_id {id_type}, {name} string, error string")


def _from_tokens(docs: DataFrame, name: str, make: Callable[[list[Token], str], str]) -> DataFrame:
    """As _each(), from the tokens of sources, which are made for a batch at a time; make also gets the source."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                t, out, errors = Tokens(data, offsets), [], []
                for d, null in enumerate(batch.column(1).slice(lo, hi - lo).is_null().to_pylist()):
                    try:
                        out.append(None if null else make(t.listed(d), t.raw[offsets[d] : offsets[d + 1]].decode()))
                        errors.append(None)
                    except Exception as e:  # a faulty document must not end the job
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["doc_id", name, "error"])

    return spread(docs.select("doc_id", F.col("source").cast("string"))).mapInArrow(run, f"doc_id {id_type}, {name} string, error string")


def to_usj(docs: DataFrame) -> DataFrame:
    return _from_tokens(docs, "usj", lambda toks, _: convert.to_json(convert.tokens_to_usj(toks)))


def to_usx(docs: DataFrame) -> DataFrame:
    return _from_tokens(docs, "usx", lambda toks, s: convert.tokens_to_usx(toks, convert.usx_version(s)))


def to_html(docs: DataFrame, **options) -> DataFrame:
    """Options are those of convert.tokens_to_html()."""
    return _from_tokens(docs, "html", lambda toks, _: convert.tokens_to_html(toks, **options))


def from_usj(docs: DataFrame, column: str = "usj") -> DataFrame:
    return _each(docs, "source", lambda s: convert.usj_to_usfm(json.loads(s)), column)


def from_usx(docs: DataFrame, column: str = "usx") -> DataFrame:
    return _each(docs, "source", convert.usx_to_usfm, column)


def usx_to_usj(docs: DataFrame, column: str = "usx") -> DataFrame:
    return _each(docs, "usj", lambda s: convert.to_json(convert.usx_to_usj(s)), column)


def through_usj(docs: DataFrame) -> DataFrame:
    """from_usj() of to_usj() in one pass: no JSON is handed from one worker to another."""
    return _from_tokens(docs, "source", lambda toks, _: convert.usj_to_usfm(json.loads(convert.to_json(convert.tokens_to_usj(toks)))))


def through_usx(docs: DataFrame) -> DataFrame:
    """from_usx() of to_usx() in one pass."""
    return _from_tokens(docs, "source", lambda toks, s: convert.usx_to_usfm(convert.tokens_to_usx(toks, convert.usx_version(s))))


def usj_through_usx(docs: DataFrame) -> DataFrame:
    """usx_to_usj() of to_usx() in one pass."""
    return _from_tokens(docs, "usj", lambda toks, s: convert.to_json(convert.usx_to_usj(convert.tokens_to_usx(toks, convert.usx_version(s)))))


def syntax_tree(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, marker, parent_idx, depth): the lossless tree, a row for each token."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                t = Tokens(data, offsets)
                tree = [x for d in range(hi - lo) for x in trees.syntax_parents(t.listed(d))]
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(t.doc)), pa.array(t.idx, pa.int32()), t.kinds(), t.marker_names(), pa.array([p for p, _ in tree], pa.int32()), pa.array([x for _, x in tree], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "idx", "kind", "marker", "parent_idx", "depth"])

    return spread(docs.select("doc_id", F.col("source").cast("string"))).mapInArrow(run, f"doc_id {id_type}, idx int, kind string, marker string, parent_idx int, depth int")


def walk(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, marker, depth, ancestors): the tree depth first, with the tokens above each from the root down."""
    out = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL("idx int, kind string, marker string, depth int, ancestors array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                t = Tokens(data, offsets)
                depth, above = [], []
                for d in range(hi - lo):
                    own: list[list[int]] = []
                    for parent, level in trees.syntax_parents(t.listed(d)):
                        own.append([] if parent is None else [*own[parent], parent])
                        depth.append(level)
                    above += own
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(t.doc)), pa.array(t.idx, pa.int32()), t.kinds(), t.marker_names(), pa.array(depth, pa.int32()), pa.array(above, pa.list_(pa.int32()))], out.names)

    return spread(docs.select("doc_id", F.col("source").cast("string"))).mapInArrow(run, out)


def stack_lint(docs: DataFrame) -> DataFrame:
    """(doc_id, code, idx, related_idx, marker, sid): issues of the rules that need a stack."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                t, rows, codes, at, related, markers, sids = Tokens(data, offsets), [], [], [], [], [], []
                for d in range(hi - lo):
                    toks = t.listed(d)
                    for i in stack_rules.issues(toks):
                        rows.append(lo + d)
                        codes.append(i.code)
                        at.append(i.idx)
                        related.append(i.related_idx)
                        markers.append(i.marker)
                        own = toks[i.idx]
                        sids.append(None if own.book is None else f"{own.book} {own.chapter}" if own.verse == 0 else own.sid)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(codes, pa.string()), pa.array(at, pa.int32()), pa.array(related, pa.int32()), pa.array(markers, pa.string()), pa.array(sids, pa.string())],
                    ["doc_id", "code", "idx", "related_idx", "marker", "sid"],
                )

    return spread(docs.select("doc_id", F.col("source").cast("string"))).mapInArrow(run, f"doc_id {id_type}, code string, idx int, related_idx int, marker string, sid string")


def formatted(docs: DataFrame, only: list[str] | None = None, excluding: list[str] | None = None) -> DataFrame:
    """(doc_id, formatted, error): documents after the format rules; the default ones, ``only`` some, or without some."""
    rules = _rules(only, excluding)
    return _from_tokens(docs, "formatted", lambda toks, _: "".join(p.text for p in formatting.format_tokens(toks, rules)))


def _rules(only: list[str] | None, excluding: list[str] | None) -> frozenset[str]:
    rules = frozenset(only) if only is not None else formatting.DEFAULT - frozenset(excluding or [])
    if unknown := rules - frozenset(formatting.RULES):
        raise ValueError(f"no such format rules: {sorted(unknown)}")
    return rules


_ALIGNED = "side string, idx int, text string, change string, counterpart int"


def _alignments(modified: Iterable[tuple[int, str, str, str]]) -> Iterator[tuple[list[int], list[pa.Array]]]:
    """Document's row, and the other columns of aligned(), of modified blocks (row, id, original text, current text), in bounded parts."""
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
    rows: list[tuple] = []
    part = lambda: ([r[0] for r in rows], [pa.array([r[c] for r in rows], t) for c, t in enumerate(types, 1)])
    for k, block_id, old, new in modified:
        both = tokens(old), tokens(new)
        for side, toks, pairs in zip(("original", "current"), both, align(*both)):
            rows += [(k, block_id, side, i, t.text, *pair) for i, (t, pair) in enumerate(zip(toks, pairs))]
        if len(rows) >= STREAM_TOKENS:
            yield part()
            rows.clear()
    yield part()


def aligned(diffs: DataFrame) -> DataFrame:
    """(doc_id, block_id, side, idx, text, change, counterpart) of the tokens of modified blocks of a block diff."""
    id_type = diffs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "block_id", "side", "idx", "text", "change", "counterpart"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x for lo, hi, _, _ in passes(batch.column(2)) for x in zip(range(lo, hi), *(batch.column(c).slice(lo, hi - lo).to_pylist() for c in (1, 2, 3))))
            for at, columns in _alignments(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    changed = diffs.where("status = 'Modified'").select("doc_id", "block_id", "original_text", "current_text")
    return changed.mapInArrow(run, f"doc_id {id_type}, block_id string, {_ALIGNED}")


def aligned_pairs(pairs: DataFrame) -> DataFrame:
    """aligned() of the block diff of a table (doc_id, baseline, current), in one pass; blocks that aren't modified are not handed on."""
    out = StructType([StructField("doc_id", pairs.schema["doc_id"].dataType), *StructType.fromDDL(f"block_id string, {_ALIGNED}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                both = zip(blocks.of_documents(Tokens(data, offsets)), blocks.of_documents(Tokens(*utf8(batch.column(2).slice(lo, hi - lo)))))
                changed = ((lo + k, block_id, a.text, b.text) for k, own in enumerate(both) for block_id, a, b in blocks.matched(*own) if blocks.status(a, b) == "Modified")
                for at, columns in _alignments(changed):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], out.names)

    return spread(pairs.select("doc_id", F.col("baseline").cast("string"), F.col("current").cast("string"))).mapInArrow(run, out)


#: Tokens of a stream that are taken up as Python objects at once; a longer document is taken by itself.
STREAM_TOKENS = 1 << 16


def _packed(rows: tuple) -> tuple[int | None, int, bytes]:
    """First place, size and compressed text of a run of tokens, given as a column for each field."""
    data = json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode()
    return rows[0][0], len(data), pa.compress(data, "zstd", asbytes=True)


def _unpacked(runs: list[dict]) -> list[tuple]:
    """A document's tokens in order from its runs; those with one place are ordered by their other fields, none first."""
    rows: list[tuple] = []
    for r in sorted(runs, key=lambda r: (r["first"] is not None, r["first"])):
        rows += zip(*json.loads(pa.decompress(r["data"], r["size"], "zstd", asbytes=True)))
    if any(x[0] is None or y[0] is None or x[0] >= y[0] for x, y in zip(rows, rows[1:])):
        rows.sort(key=lambda row: [(x is not None, x) for x in row])
    return rows


def streamed(stream: DataFrame, schema: str, make: Callable[[Tokens], relations.Made], ids: bool = False) -> DataFrame:
    """As relations.over(), of a token stream (doc_id, idx, kind, text and, if it has them, marker, sid, id) instead of sources.

    A document's tokens are gathered in one row, as its source would be. Those that
    are near each other already are packed before the shuffle, so it moves
    compressed texts and not a row for each token. Without a column ``sid`` one is
    made of book, chapter and verse, if it has these; ``ids`` are gathered if make
    asks for them.
    """
    has = set(stream.columns)
    text = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    sid = text("sid") if "sid" in has or not {"book", "chapter", "verse"} <= has else F.concat("book", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string"))
    own_sid, own_id = "sid" in has or {"book", "chapter", "verse"} <= has, ids and "id" in has
    id_field = StructField("doc_id", stream.schema["doc_id"].dataType)
    out = StructType([id_field, *StructType.fromDDL(schema)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            order = np.argsort(of, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0]))
            columns = [c.take(pa.array(order)).to_pylist() for c in batch.columns[1:]]
            runs = [_packed(tuple(c[a:b] for c in columns)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(of)])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order[first])), *(pa.array([r[k] for r in runs], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "first", "size", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                counts: list[int] = []
                rows: list[tuple] = []
                while lo + len(counts) < batch.num_rows and len(rows) < STREAM_TOKENS:
                    own = _unpacked(batch.column(1)[lo + len(counts)].as_py())
                    counts.append(len(own))
                    rows += own
                _, kind, text_, marker, sids, given = zip(*rows)
                t = Tokens.given(counts, kind, [x or "" for x in text_], marker, sids if own_sid else None, given if own_id else None)
                doc, columns = make(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(counts)).take(pa.array(doc, pa.int64())), *columns], out.names)
                lo += len(counts)

    one = stream.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("kind").cast("string").alias("kind"), text("text").alias("text"), text("marker").alias("marker"), sid.alias("sid"), (text("id") if own_id else F.lit(None).cast("string")).alias("id"))
    runs = one.mapInArrow(pack, StructType([id_field, *StructType.fromDDL("first bigint, size bigint, data binary")]))
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("first", "size", "data")).alias("runs")).mapInArrow(run, out)


def lint_stream(stream: DataFrame, enabled: list[str] | None = None, disabled: list[str] | None = None) -> DataFrame:
    """relations.lint() of a token stream."""
    return streamed(stream, relations.LINT_SCHEMA, relations.lint_rows(issues.allowed(enabled, disabled)))


def lint_stream_issues(stream: DataFrame, enabled: list[str] | None = None, disabled: list[str] | None = None, implicit_verses: bool = False) -> DataFrame:
    """relations.lint_issues() of a token stream; here texts can hold markers and numbers can be none."""
    return streamed(stream, issues.SCHEMA, relations.issue_rows(issues.allowed(enabled, disabled), implicit_verses), ids=True)


def _pieces(t: Tokens, rules: frozenset[str]) -> relations.Made:
    doc, rows = [], []
    for d in range(len(t.counts)):
        own = formatting.format_tokens(t.listed(d), rules)
        doc += [d] * len(own)
        rows += [(k, p.kind, p.text, p.marker) for k, p in enumerate(own)]
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
    return np.array(doc, dtype=np.int64), [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]


def formatted_stream(stream: DataFrame, only: list[str] | None = None, excluding: list[str] | None = None) -> DataFrame:
    """(doc_id, idx, kind, text, marker): a token stream after the format rules."""
    rules = _rules(only, excluding)
    return streamed(stream, "idx int, kind string, text string, marker string", lambda t: _pieces(t, rules))


def html_stream(stream: DataFrame, **options) -> DataFrame:
    """(doc_id, html) of a token stream."""
    return streamed(stream, "html string", lambda t: (np.arange(len(t.counts)), [pa.array([convert.tokens_to_html(t.listed(d), **options) for d in range(len(t.counts))], pa.string())]))


def vref_stream(stream: DataFrame) -> DataFrame:
    """(doc_id, ref, text) of a token stream."""
    return streamed(stream, "ref string, text string", relations.verse_rows)


def blocks_stream(stream: DataFrame) -> DataFrame:
    """relations.blocks() of a token stream."""
    return streamed(stream, relations.BLOCK_SCHEMA, relations.block_rows, ids=True)


def recovered(stream: DataFrame) -> DataFrame:
    """(doc_id, idx, piece, kind, text): texts of a token stream (doc_id, idx, kind, text) in which a known marker stands, cut in their parts."""
    out = StructType([StructField("doc_id", stream.schema["doc_id"].dataType), *StructType.fromDDL("idx int, piece int, kind string, text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (idx, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                rows += [(k, idx, n, p.kind, p.text) for n, p in formatting.recovered(text)]
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds, 1))], out.names)

    return stream.where("kind = 'Text'").select("doc_id", F.col("idx").cast("int"), "text").mapInArrow(run, out)


def usj_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, type, marker): the nodes of each document's JSON that have a marker, depth first, but for end markers that close nothing."""
    out = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL("nth bigint, type string, marker string")])

    def walk(node: object) -> Iterator[tuple[str, str]]:
        for x in node.get("content", []) if isinstance(node, dict) else []:
            if isinstance(x, dict):
                stray = x["type"] == "unknown" and mk.kind(x.get("marker", "")) is not None
                if x.get("marker") is not None and x["marker"] not in WITHOUT and not stray:
                    yield x["type"], x["marker"]
                yield from walk(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                t = Tokens(data, offsets)
                rows = [(lo + k, n, *x) for k in range(hi - lo) for n, x in enumerate(walk(convert.tokens_to_usj(t.listed(k))), 1)]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([r[c] for r in rows], kind) for c, kind in ((1, pa.int64()), (2, pa.string()), (3, pa.string())))], out.names)

    return spread(docs.select("doc_id", F.col("source").cast("string"))).mapInArrow(run, out)


def stays(text: str, there: Callable[[str], str], back: Callable[[str], str]) -> bool:
    """Whether the markup that a conversion gives when converted back stays what it is, converted there and back again.

    A source may be spaced otherwise than the markup that is made from a
    conversion; so the first way back may change it, but no later one. Conversions
    give the same for the same, so what was converted once isn't again.
    """
    first = there(text)
    made = back(first)
    if made == text:
        return True
    again = there(made)
    return again == first or back(again) == made


def _trip(docs: DataFrame, there: Callable[[str], str], back: Callable[[str], str]) -> DataFrame:
    """(doc_id, same): stays() of each document."""
    return _each(docs, "same", lambda s: str(stays(s, there, back)).lower()).select("doc_id", F.coalesce(F.col("same").cast("boolean"), F.lit(False)).alias("same"))


def usj_round_trip(docs: DataFrame) -> DataFrame:
    return _trip(docs, lambda s: convert.to_json(convert.usfm_to_usj(s)), lambda s: convert.usj_to_usfm(json.loads(s)))


def usx_round_trip(docs: DataFrame) -> DataFrame:
    return _trip(docs, convert.usfm_to_usx, convert.usx_to_usfm)


def faults(docs: DataFrame) -> DataFrame:
    """(faults, documents): conversions (to JSON, XML, HTML, and JSON from XML) and formattings of a document that failed, and the documents.

    One pass: tokens and the tree are made once for each document, and all that is
    converted is made from them and counted there.
    """

    def failed(t: Tokens, d: int, source: str) -> int:
        made: dict = {}

        def fails(name: str, make: Callable[[], object]) -> int:
            try:
                made[name] = make()
                return 0
            except Exception:  # a faulty document must not end the job
                return 1

        if fails("tokens", lambda: t.listed(d)):
            return 4
        n = fails("formatted", lambda: "".join(p.text for p in formatting.format_tokens(made["tokens"])))
        if fails("tree", lambda: convert.tokens_to_usj(made["tokens"])):
            return n + 3
        n += fails("usj", lambda: convert.to_json(made["tree"])) + fails("html", lambda: convert.usj_to_html(made["tree"]))
        if fails("usx", lambda: convert.usj_to_usx(made["tree"], convert.usx_version(source))):
            return n + 1
        return n + fails("back", lambda: convert.to_json(convert.usx_to_usj(made["usx"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = documents = 0
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(0)):
                t = Tokens(data, offsets)
                nulls = batch.column(0).slice(lo, hi - lo).is_null().to_pylist()
                n += sum(failed(t, d, t.raw[offsets[d] : offsets[d + 1]].decode()) for d, null in enumerate(nulls) if not null)
            documents += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([documents], pa.int64())], ["faults", "documents"])

    counts = spread(docs.select(F.col("source").cast("string"))).mapInArrow(run, "faults bigint, documents bigint")
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("faults", "documents")))
