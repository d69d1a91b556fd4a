"""One way in for users: tables of documents, streams of tokens, and single texts.

``Documents`` and ``TokenStream`` hold a DataFrame and give DataFrames; nothing
runs before their results are used. ``Text`` works on one source without Spark.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import markers as mk
from scriptorium.operators import blocks, columns, convert, documents, formatting, issues, relations, scan, verses
from scriptorium.sources import files

FORMATS = ("usfm", "usj", "usx")


@dataclass(frozen=True)
class LintOptions:
    """Which codes to look for, which issues (code, sid) to leave out, and whether verses may stand in no paragraph."""

    enabled: tuple[str, ...] | None = None
    disabled: tuple[str, ...] = ()
    suppressions: DataFrame | None = None
    implicit_verses: bool = False

    def enable(self, *codes: str) -> LintOptions:
        return replace(self, enabled=(*(self.enabled or ()), *codes))

    def disable(self, *codes: str) -> LintOptions:
        return replace(self, disabled=(*self.disabled, *codes))

    def suppress(self, table: DataFrame) -> LintOptions:
        return replace(self, suppressions=table)

    def codes(self) -> tuple[list[str] | None, list[str]]:
        return None if self.enabled is None else list(self.enabled), list(self.disabled)


@dataclass(frozen=True)
class FormatOptions:
    """Which format rules to follow: the default ones, only some, or without some."""

    only: tuple[str, ...] | None = None
    excluding: tuple[str, ...] = ()

    def rules(self) -> tuple[list[str] | None, list[str]]:
        return None if self.only is None else list(self.only), list(self.excluding)


class Documents:
    """A table of documents (doc_id, source) in markup."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def read(cls, spark: SparkSession, paths: str | list[str], format: str = "usfm") -> Documents:
        """Files, one document each, whatever of the three formats they are in."""
        return cls.of(files.read_documents(spark, paths, format), format)

    @classmethod
    def of(cls, table: DataFrame, format: str = "usfm") -> Documents:
        """A table (doc_id, usfm | usj | usx), or (doc_id, source) for usfm; what can't be read has a null source."""
        if format not in FORMATS:
            raise ValueError(f"no such format: {format}")
        if format == "usfm":
            return cls(table if "source" in table.columns else table.withColumnRenamed("usfm", "source"))
        return cls((documents.from_usj if format == "usj" else documents.from_usx)(table, format).drop("error"))

    def tokens(self) -> TokenStream:
        return TokenStream(relations.tokens(self.table))

    def books(self) -> DataFrame:
        return relations.books(self.table)

    def tree(self) -> DataFrame:
        return documents.syntax_tree(self.table)

    def walk(self) -> DataFrame:
        return documents.walk(self.table)

    def usj(self) -> DataFrame:
        return documents.to_usj(self.table)

    def usx(self) -> DataFrame:
        return documents.to_usx(self.table)

    def html(self, **options) -> DataFrame:
        return documents.to_html(self.table, **options)

    def vref(self, as_json: bool = False) -> DataFrame:
        return relations.verse_json(self.table) if as_json else relations.verse_text(self.table)

    def convert(self, to: str, **options) -> DataFrame:
        """(doc_id, result, error) in another form: usfm, usj, usx, html or vref."""
        made = {"usfm": lambda: relations.sources(self.table), "usj": self.usj, "usx": self.usx, "html": lambda: self.html(**options), "vref": lambda: self.vref(True)}
        if to not in made:
            raise ValueError(f"no such format: {to}")
        return made[to]()

    def lint(self, options: LintOptions = LintOptions()) -> DataFrame:
        found = relations.lint_issues(self.table, *options.codes(), options.implicit_verses)
        return found if options.suppressions is None else relations.suppress(found, options.suppressions)

    def lint_summary(self, options: LintOptions = LintOptions()) -> DataFrame:
        return relations.summary(relations.lint_issues(self.table, *options.codes(), options.implicit_verses), options.suppressions)

    def format(self, options: FormatOptions = FormatOptions()) -> Documents:
        out = documents.formatted(self.table, *options.rules())
        return Documents(out.select("doc_id", F.col("formatted").alias("source")))

    def apply(self, edits: DataFrame) -> Documents:
        """After edits (doc_id, id, action, new_text) of tokens."""
        out = relations.apply_fixes(self.table, edits).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"))
        return Documents(out.select("doc_id", F.array_join("t.text", "").alias("source")))

    def blocks(self) -> DataFrame:
        return relations.blocks(self.table)

    def pairs(self, baseline: Documents) -> DataFrame:
        """(doc_id, baseline, current) of the documents that either has."""
        old = baseline.table.select("doc_id", F.col("source").alias("baseline"))
        return old.join(self.table.select("doc_id", F.col("source").alias("current")), "doc_id", "full")

    def diff(self, baseline: Documents, by_chapter: bool = False) -> DataFrame:
        return (relations.chapter_diff if by_chapter else relations.block_diff)(self.pairs(baseline))

    def revert(self, baseline: Documents, block_ids: DataFrame | None = None) -> Documents:
        """With blocks as baseline has them: those of a table (doc_id, block_ids), or all."""
        return Documents(relations.revert_blocks(self.pairs(baseline), block_ids))


class TokenStream:
    """A table of tokens (doc_id, idx, kind, text and, if it has them, marker, sid or book, chapter and verse, id), from a source or not."""

    def __init__(self, table: DataFrame):
        self.table = table

    def source(self) -> Documents:
        out = self.table.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"))
        return Documents(out.select("doc_id", F.array_join("t.text", "").alias("source")))

    def lint(self, options: LintOptions = LintOptions()) -> DataFrame:
        found = documents.lint_stream_issues(self.table, *options.codes(), options.implicit_verses)
        return found if options.suppressions is None else relations.suppress(found, options.suppressions)

    def format(self, options: FormatOptions = FormatOptions()) -> TokenStream:
        return TokenStream(documents.formatted_stream(self.table, *options.rules()))

    def html(self, **options) -> DataFrame:
        return documents.html_stream(self.table, **options)

    def vref(self) -> DataFrame:
        return documents.vref_stream(self.table)

    def blocks(self) -> DataFrame:
        return documents.blocks_stream(self.table)


class Text:
    """One document's markup."""

    def __init__(self, source: str):
        self.source = source

    @classmethod
    def of(cls, text: str, format: str = "usfm") -> Text:
        if format not in FORMATS:
            raise ValueError(f"no such format: {format}")
        return cls(text if format == "usfm" else convert.usj_to_usfm(json.loads(text)) if format == "usj" else convert.usx_to_usfm(text))

    def _columns(self) -> columns.Tokens:
        return columns.Tokens(*columns.utf8(pa.array([self.source], pa.string())))

    def tokens(self) -> list[scan.Token]:
        return scan.tokens(self.source)

    def usj(self) -> str:
        return convert.to_json(convert.usfm_to_usj(self.source))

    def usx(self) -> str:
        return convert.usfm_to_usx(self.source)

    def html(self, **options) -> str:
        return convert.usfm_to_html(self.source, **options)

    def vref(self) -> dict[str, str]:
        return json.loads(verses.as_json(self._columns())[0])

    def lint(self, options: LintOptions = LintOptions()) -> list[dict]:
        names = [x.split()[0] for x in ("code", "category", "severity", "issue_type", "message", "message_params", "span", "related_span", "token_id", "related_token_id", "sid", "marker", "fix")]
        return [dict(zip(names, r)) | {"message_params": dict(r[5])} for r in issues.records(self._columns(), issues.allowed(*options.codes()), options.implicit_verses)[1]]

    def format(self, options: FormatOptions = FormatOptions()) -> Text:
        only, excluding = options.rules()
        return Text(formatting.format_usfm(self.source, frozenset(only) if only is not None else formatting.DEFAULT - frozenset(excluding)))

    def _blocks(self) -> list[blocks.Block]:
        return blocks.of_documents(self._columns())[0]

    def diff(self, baseline: Text) -> list[blocks.Difference]:
        return blocks.diff(baseline._blocks(), self._blocks())

    def diff_by_chapter(self, baseline: Text) -> dict[str, dict[int, list[blocks.Difference]]]:
        return blocks.by_chapter(baseline._blocks(), self._blocks())

    def revert(self, baseline: Text, block_ids: list[str]) -> Text:
        old, new = (relations._stream(t._columns(), 0) for t in (baseline, self))
        return Text("".join(x[2] for x in blocks.revert(block_ids, old, new)))


def marker(name: str) -> dict[str, object]:
    """What is known of a marker."""
    return dict(zip((x.split()[0] for x in mk.SCHEMA.split(", ")), mk.row(mk.bare(name))))
