"""Functions for SQL users."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, BooleanType, StringType

from scriptorium import api
from scriptorium.functions import markers as mk
from scriptorium.operators import convert
from scriptorium.operators.scan import tokens


@udtf(returnType="idx int, kind string, text string, marker string, book string, chapter int, verse bigint")
class UsfmTokens:
    """A row for each token of a source text."""

    def eval(self, source: str) -> Iterator[tuple]:
        for k, t in enumerate(tokens(source or "")):
            yield k, t.kind, t.text, t.marker, t.book, t.chapter if t.book else None, t.verse if t.book else None


def _text(make: Callable[[str], str]) -> Callable:
    @pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else make(s), na_action="ignore")

    return run


def _marker(f: Callable[[str], object], kind: str) -> Callable:
    @pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(f, na_action="ignore")

    return run


@pandas_udf(ArrayType(StringType()))
def _codes(column: pd.Series) -> pd.Series:
    return column.map(lambda s: None if s is None else [i["code"] for i in api.Text(s).lint()], na_action="ignore")


@pandas_udf(BooleanType())
def _allows(markers: pd.Series, contexts: pd.Series) -> pd.Series:
    return pd.Series([None if m is None or c is None else mk.allows(m, c) for m, c in zip(markers, contexts)], dtype=object)


@pandas_udf(StringType())
def _format_only(sources: pd.Series, rules: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else api.Text(s).format(api.FormatOptions(only=tuple(r if r is not None else ()))).source for s, r in zip(sources, rules)])


@pandas_udf(StringType())
def _diff(baselines: pd.Series, currents: pd.Series) -> pd.Series:
    def one(a: str | None, b: str | None) -> str:
        return json.dumps([{"block_id": d.block_id, "status": d.status, "original_text": d.original_text, "current_text": d.current_text} for d in api.Text(b or "").diff(api.Text(a or ""))], ensure_ascii=False)

    return pd.Series([one(a, b) for a, b in zip(baselines, currents)])


@pandas_udf(StringType())
def _revert(baselines: pd.Series, currents: pd.Series, ids: pd.Series) -> pd.Series:
    return pd.Series([api.Text(b or "").revert(api.Text(a or ""), list(i) if i is not None else []).source for a, b, i in zip(baselines, currents, ids)])


CONVERSIONS: dict[str, Callable[[str], str]] = {
    "usfm_to_usj": lambda s: api.Text(s).usj(),
    "usfm_to_usx": lambda s: api.Text(s).usx(),
    "usfm_to_html": lambda s: api.Text(s).html(),
    "usfm_to_vref": lambda s: json.dumps(api.Text(s).vref(), ensure_ascii=False),
    "usj_to_usfm": lambda s: api.Text.of(s, "usj").source,
    "usj_to_usx": lambda s: convert.usj_to_usx(json.loads(s)),
    "usx_to_usfm": lambda s: api.Text.of(s, "usx").source,
    "usx_to_usj": lambda s: convert.to_json(convert.usx_to_usj(s)),
    "usfm_format": lambda s: api.Text(s).format().source,
}
MARKERS: dict[str, tuple[Callable[[str], object], str]] = {
    "usfm_marker_category": (mk.category, "string"),
    "usfm_marker_canonical": (mk.canonical, "string"),
    "usfm_marker_kind": (mk.public_kind, "string"),
    "usfm_marker_scope": (mk.scope_kind, "string"),
    "usfm_marker_family": (mk.family, "string"),
    "usfm_marker_family_role": (mk.family_role, "string"),
    "usfm_marker_closing": (mk.closing, "string"),
    "usfm_marker_block_behavior": (mk.block_behavior, "string"),
    "usfm_marker_inline_context": (mk.inline_context, "string"),
    "usfm_marker_note_family": (mk.note_family, "string"),
    "usfm_marker_note_subkind": (mk.note_subkind, "string"),
    "usfm_marker_default_attribute": (mk.default_attribute, "string"),
    "usfm_marker_supports_verse": (mk.supports_verse, "boolean"),
    "usfm_marker_known": (lambda m: mk.canonical(m) is not None, "boolean"),
}


def register(spark: SparkSession) -> None:
    """Make usfm_tokens (a table function), conversions, lint, format, diff, revert and marker functions known to SQL."""
    spark.udtf.register("usfm_tokens", UsfmTokens)
    for name, make in CONVERSIONS.items():
        spark.udf.register(name, _text(make))
    for name, (f, kind) in MARKERS.items():
        spark.udf.register(name, _marker(f, kind))
    for name, f in {"usfm_lint_codes": _codes, "usfm_marker_allowed": _allows, "usfm_format_only": _format_only, "usfm_diff": _diff, "usfm_revert": _revert}.items():
        spark.udf.register(name, f)
