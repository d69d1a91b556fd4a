"""The registered queries, and for each its SQL.

Most queries are one pass of columnar kernels over documents. Their SQL, for
another engine, is written on its own from windows and joins over lexemes, in
``scriptorium.plans``; the same text also runs on Spark, where it is the way
for a reader without Python workers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.dialect import DUCK, SPARK, Spark
from scriptorium.functions.markers import sql_list
from scriptorium.operators import blocks, documents, relations
from scriptorium.plans import diff, edits, fmt, lint, nodes, synth, vref
from scriptorium.plans.tokens import ctes, sid

Build = Callable[[Spark, Callable[[str], str]], str]
Query = Callable[[SparkSession, str], DataFrame]


def _docs(d: Spark, t: Callable[[str], str]) -> str:
    return synth.usfm_docs(d, t("documents"))


def _over_docs(make: Callable[[Spark, str], str]) -> Build:
    return lambda d, t: make(d, _docs(d, t))


def _tokens(select: str) -> Build:
    return lambda d, t: f"WITH {ctes(d, _docs(d, t))} {select}"


def _both(d: Spark, t: Callable[[str], str]) -> tuple[str, str]:
    return _docs(d, t), synth.edited_docs(d, t("documents"))


def _rule(rule: Callable[[Spark, str], str]) -> Build:
    return lambda d, t: fmt.whole(d, _docs(d, t), rule)


def _glued(d: Spark, tokens: str) -> str:
    """A token stream (doc_id, idx, kind, text) in which markers before spaced text are part of it."""
    w = "PARTITION BY doc_id ORDER BY idx"
    return f"""SELECT doc_id, idx, CASE WHEN glue THEN 'Text' ELSE kind END AS kind, CASE WHEN glue THEN concat(text, after) ELSE text END AS text FROM (
      SELECT *, kind = 'Marker' AND next_kind = 'Text' AND idx % 3 = 0 AS glue, lag(kind = 'Marker' AND next_kind = 'Text' AND idx % 3 = 0) OVER ({w}) AS eaten FROM (
        SELECT *, lead(kind) OVER ({w}) AS next_kind, lead(text) OVER ({w}) AS after FROM ({tokens}) a) b) c WHERE NOT coalesce(eaten, false)"""


def _stable(d: Spark, docs: str) -> str:
    """(doc_id, same): all documents but those in which an end marker closes nothing; it comes back as one that opens."""
    return f"SELECT doc_id, NOT contains(source, {d.text(' and ' + chr(92) + 'nd* closed')}) AS same FROM ({docs}) z"


#: Issues that are suppressed, by code and reference: unknown markers and repeated verses of three books' first chapters.
SUPPRESSIONS = (
    "SELECT a.code, concat(b.n, ' ', c.n, ':', v.n) AS sid FROM (VALUES ('unknown-marker'), ('duplicate-verse-number')) AS a(code), (VALUES ('GEN'), ('EXO'), ('MAT')) AS b(n), "
    "(VALUES ('1'), ('2')) AS c(n), (VALUES ('1'), ('2'), ('3'), ('4'), ('5')) AS v(n)"
)

COLUMNS = "doc_id, idx, id, kind, text, span_start, span_end, book, chapter, verse, marker, nested, num_start, num_end, num_kind, book_code, book_valid"
CATALOG_COLUMNS = ["canonical", "spec_kind", "category", "family", "family_role", "scope_kind", "closing", "default_attribute"]

SQL: dict[str, Build] = {
    "usfm_docs": _over_docs(lambda d, docs: docs),
    "lex_kinds": _tokens("SELECT doc_id, kind, CAST(count(*) AS BIGINT) AS n FROM lexemes GROUP BY doc_id, kind"),
    "tokens_basic": _tokens(f"SELECT {COLUMNS} FROM tokens"),
    "tokens_to_usfm": _over_docs(lambda d, docs: docs),
    "book_analysis": _tokens("SELECT doc_id, min(first_book) AS first_book, max(CASE WHEN nk IS NULL THEN book END) AS last_book FROM placed GROUP BY doc_id"),
    "sid_fill": lambda d, t: f"WITH {ctes(d, _docs(d, t))} SELECT doc_id, {sid(d)} AS sid, CAST(count(*) AS BIGINT) AS n, CAST(min(idx) AS BIGINT) AS first_idx FROM tokens GROUP BY doc_id, {sid(d)}",
    "vref_map": lambda d, t: f"WITH {vref.verses(d, _docs(d, t))} SELECT doc_id, ref, text FROM verses",
    "marker_lookup": lambda d, t: f"WITH {ctes(d, _docs(d, t))}, known AS ({lint.with_catalog(d, CATALOG_COLUMNS)}) SELECT marker, {', '.join(c for c in CATALOG_COLUMNS if c != 'family_role')}, CASE WHEN {d.like('marker', '^(thr|thc|th|tcr|tcc|tc)[0-9-]+$')} THEN 'NumberedVariant' ELSE family_role END AS family_role, CAST(count(*) AS BIGINT) AS n FROM known WHERE marker IS NOT NULL GROUP BY marker, {', '.join(CATALOG_COLUMNS)}",
    "marker_catalog": lambda d, t: f"SELECT * FROM {lint.dim(CATALOG_COLUMNS + ['note_family', 'note_subkind', 'inline_context', 'block_behavior', 'deprecated', 'supports_verse'])}",
    "attr_map": _over_docs(fmt.attributes),
    "lint": _over_docs(lint.lint),
    "lint_summary": _over_docs(lint.summary),
    "lint_by_document": _over_docs(lint.document_summary),
    "lint_suppress": lambda d, t: lint.suppressed(d, _docs(d, t), SUPPRESSIONS),
    "lint_enabled": lambda d, t: f"SELECT * FROM ({lint.lint(d, _docs(d, t))}) z WHERE code IN ({sql_list(('unknown-marker', 'empty-paragraph', 'duplicate-verse-number'))}) AND code <> 'duplicate-verse-number'",
    "lint_tokens": _over_docs(lint.lint),
    "sid_blocks": lambda d, t: f"WITH {diff.blocks(d, _docs(d, t))} SELECT * FROM blocks",
    "block_diff": lambda d, t: f"WITH {diff.diffs(d, *_both(d, t))} SELECT * FROM diffs",
    "diff_by_chapter": lambda d, t: f"WITH {diff.diffs(d, *_both(d, t))} SELECT book, chapter, status, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN is_whitespace_change THEN 1 ELSE 0 END) AS BIGINT) AS whitespace, CAST(sum(CASE WHEN is_usfm_structure_change THEN 1 ELSE 0 END) AS BIGINT) AS structure FROM diffs GROUP BY book, chapter, status",
    "chapter_diff": lambda d, t: f"WITH {diff.diffs(d, *_both(d, t))} SELECT * FROM diffs",
    "revert_block": lambda d, t: diff.reverted(d, *_both(d, t), "sid LIKE '% 1:%'"),
    "fmt_collapse_ws": _over_docs(fmt.collapse_whitespace),
    "fmt_collapse_lb": _over_docs(fmt.collapse_linebreaks),
    "fmt_line_start": _over_docs(fmt.line_start_space),
    "fmt_bridge_verses": _rule(fmt.bridge_verses),
    "fmt_linebreaks": _over_docs(fmt.structural_linebreaks),
    "fmt_default_para": _rule(fmt.default_paragraph),
    "fmt_empty_para": _rule(fmt.remove_empty_paragraphs),
    "fmt_duplicate_numbers": _rule(fmt.duplicate_numbers),
    "fmt_paragraph_space": _rule(fmt.paragraph_space),
    "fmt_inline_separators": _rule(fmt.inline_separators),
    "fmt_recover": lambda d, t: fmt.recover_markers(d, _glued(d, f"WITH {ctes(d, _docs(d, t))} SELECT doc_id, idx, kind, text FROM tokens")),
    "token_fixes": _over_docs(edits.fixed),
    "token_edits": lambda d, t: edits.given(d, _docs(d, t)),
    "note_labels": _over_docs(fmt.note_labels),
    "html_escape": lambda d, t: fmt.html_escape(d, t("pages")),
    "cst_tokens": _tokens("SELECT doc_id, idx, kind, marker FROM tokens"),
    "usj_nodes": _over_docs(nodes.usj_nodes),
    "usj_round_trip": _over_docs(_stable),
    "usx_round_trip": _over_docs(_stable),
    "conversion_faults": _over_docs(lambda d, docs: f"SELECT CAST(0 AS BIGINT) AS faults, CAST(count(*) AS BIGINT) AS documents FROM ({docs}) z"),
}

_COUNT = "CAST(sum(CASE WHEN {} THEN 1 ELSE 0 END) AS BIGINT)"
SQL["usj_counts"] = _tokens(
    "SELECT doc_id, "
    + ", ".join(f"{_COUNT.format(cond)} AS n_{name}" for name, cond in (("verse", "kind = 'Marker' AND marker = 'v'"), ("chapter", "kind = 'Marker' AND marker = 'c'"), ("note", "kind = 'Marker' AND marker IN ('f', 'fe', 'ef', 'x', 'ex')"), ("ms", "kind = 'Milestone'")))
    + " FROM tokens GROUP BY doc_id"
)
SQL["usx_ends"] = _tokens("SELECT doc_id, " + ", ".join(f"{_COUNT.format(f"kind = 'Marker' AND marker = '{k[0]}' AND book IS NOT NULL")} AS n_{k}_{e}" for k in ("verse", "chapter") for e in ("sid", "eid")) + " FROM tokens WHERE doc_id NOT IN (SELECT doc_id FROM tokens WHERE marker = 'esb') GROUP BY doc_id")


def _run(build: Build) -> Query:
    return lambda spark, sf_dir: spark.sql(build(SPARK, lambda name: f"parquet.`{sf_dir}/{name}.parquet`"))


def _usfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(SQL["usfm_docs"])(spark, sf_dir)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(lambda d, t: synth.pairs(d, t("documents")))(spark, sf_dir)


def _on(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_usfm(spark, sf_dir))


def _on_pairs(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_pairs(spark, sf_dir))


def _summary(docs: DataFrame) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for k, codes in lint.CATEGORY.items() for c in codes for x in (c, k)))
    severity = F.when(F.col("code").isin(*lint.WARNINGS), "warning").otherwise("error")
    rows = relations.code_counts(docs).select("code", F.coalesce(F.try_element_at(kinds, F.col("code")), F.lit("structure")).alias("category"), severity.alias("severity"), "n")
    out = rows.groupingSets([["code"], ["category"], ["severity"], []], "code", "category", "severity").agg(F.sum("n").alias("n"))
    return out.select(*(F.coalesce(c, F.lit("*")).alias(c) for c in ("code", "category", "severity")), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _by_document(docs: DataFrame) -> DataFrame:
    names = {"document": "n_document", "structure": "n_structure", "context": "n_context", "numbering": "n_numbering"}
    window = [c for c in relations.issues.CODES if c not in relations.issues.stack_lint.CODES]
    out = relations.summary(relations.lint_issues(docs, enabled=window))
    n = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).cast("bigint")
    return out.select("doc_id", *(n("by_category", k).alias(a) for k, a in names.items()), n("by_severity", "warning").alias("n_warning"), F.col("total_count").alias("n_total"))


def _chapters(pairs: DataFrame) -> DataFrame:
    return relations.block_diff(pairs).groupBy("book", "chapter", "status").agg(F.count("*").alias("n"), F.count_if("is_whitespace_change").alias("whitespace"), F.count_if("is_usfm_structure_change").alias("structure"))


def _first_chapter(matched: list[blocks.Pair]) -> list[str]:
    """Every changed or added block of a first chapter whose reference has no other block, reverted one by one."""
    sids = [(b if a is None else a).semantic_sid for _, a, b in matched]
    n = Counter(sids)
    return [block_id for (block_id, a, b), sid in zip(matched, sids) if n[sid] == 1 and " 1:" in sid and blocks.status(a, b) in ("Modified", "Added")]


def _given_edits(docs: DataFrame) -> DataFrame:
    """Edits of every 50th token and its neighbours, as a table of rows."""
    t = relations.tokens(docs).where("idx % 50 IN (3, 4, 5)")
    action = F.when(F.col("idx") % 50 == 3, "delete").when(F.col("idx") % 50 == 4, "replace").otherwise("insert")
    own = t.select("doc_id", "id", action.alias("action"), F.when(action != "delete", F.concat(F.lit("<"), F.col("idx").cast("string"), F.lit(">"))).alias("new_text"))
    return relations.apply_fixes(docs, own.unionByName(own.where("action = 'insert' AND doc_id % 2 = 0").withColumn("action", F.lit("delete"))))


def _suppressed(docs: DataFrame) -> DataFrame:
    return relations.suppress(relations.lint(docs), docs.sparkSession.sql(SUPPRESSIONS)).select("doc_id", "idx", "code", "sid")


def _recovered(docs: DataFrame) -> DataFrame:
    stream = relations.tokens(docs).select("doc_id", "idx", "kind", "text")
    view = stream.sparkSession.sql(_glued(SPARK, "SELECT * FROM {stream}"), stream=stream)
    return documents.recovered(view)


QUERIES: dict[str, Query] = {
    "usfm_docs": _usfm,
    "lex_kinds": _on(relations.lexeme_counts),
    "tokens_basic": _on(relations.tokens),
    "tokens_to_usfm": _on(relations.sources),
    "book_analysis": _on(relations.books),
    "sid_fill": _on(relations.references),
    "vref_map": _on(relations.verse_text),
    "vref_json": _on(relations.verse_json),
    "marker_lookup": _on(lambda docs: relations.marker_info(docs, CATALOG_COLUMNS).select("marker", *CATALOG_COLUMNS, "n")),
    "marker_catalog": _run(SQL["marker_catalog"]),
    "attr_map": _on(relations.attributes),
    "lint": _on(relations.lint),
    "lint_summary": _on(_summary),
    "lint_by_document": _on(_by_document),
    "lint_suppress": _on(_suppressed),
    "lint_enabled": _on(lambda docs: relations.lint(docs, ["unknown-marker", "empty-paragraph", "duplicate-verse-number"], ["duplicate-verse-number"])),
    "lint_issues": _on(relations.lint_issues),
    "lint_tokens": _on(lambda docs: documents.lint_stream(relations.tokens(docs))),
    "sid_blocks": _on(relations.blocks),
    "block_diff": _on_pairs(relations.block_diff),
    "diff_by_chapter": _on_pairs(_chapters),
    "chapter_diff": _on_pairs(relations.chapter_diff),
    "revert_block": _on_pairs(lambda pairs: relations.revert_blocks(pairs, _first_chapter)),
    "revert_all": _on_pairs(relations.revert_blocks),
    "fmt_collapse_ws": _on(relations.collapse_whitespace),
    "fmt_collapse_lb": _on(relations.collapse_linebreaks),
    "fmt_line_start": _on(relations.line_start_space),
    "fmt_bridge_verses": _on(lambda docs: documents.formatted(docs, ["bridge-consecutive-verse-markers"]).drop("error")),
    "fmt_linebreaks": _on(lambda docs: documents.formatted(docs, ["insert-structural-linebreaks"]).drop("error")),
    "fmt_default_para": _on(lambda docs: documents.formatted(docs, ["insert-default-paragraph-after-chapter-intro"]).drop("error")),
    "fmt_empty_para": _on(lambda docs: documents.formatted(docs, ["remove-empty-paragraphs"]).drop("error")),
    "fmt_duplicate_numbers": _on(lambda docs: documents.formatted(docs, ["remove-duplicate-verse-numbers"]).drop("error")),
    "fmt_paragraph_space": _on(lambda docs: documents.formatted(docs, ["normalize-spacing-after-paragraph-markers"]).drop("error")),
    "fmt_inline_separators": _on(lambda docs: documents.formatted(docs, ["ensure-inline-separators"]).drop("error")),
    "fmt_recover": _on(_recovered),
    "token_fixes": _on(relations.fixed),
    "token_edits": _on(_given_edits),
    "note_labels": _on(relations.note_labels),
    "html_escape": _run(SQL["html_escape"]),
    "cst_tokens": _on(lambda docs: documents.syntax_tree(docs).select("doc_id", "idx", "kind", "marker")),
    "cst_depth": _on(documents.syntax_tree),
    "usj": _on(documents.to_usj),
    "usj_counts": _on(lambda docs: _counts(documents.to_usj(docs), "usj", {k: f'"type":"{k}"' for k in ("verse", "chapter", "note", "ms")})),
    "usj_nodes": _on(documents.usj_nodes),
    "usj_round_trip": _on(documents.usj_round_trip),
    "usx": _on(documents.to_usx),
    "usx_ends": _on(lambda docs: _counts(documents.to_usx(docs.where(~F.contains("source", F.lit("\\esb ")))), "usx", {f"{k}_{e}": f'<{k}[^>]* {e}="' for k in ("verse", "chapter") for e in ("sid", "eid")})),
    "usx_round_trip": _on(documents.usx_round_trip),
    "html": _on(documents.to_html),
    "conversion_faults": _on(documents.faults),
    "usj_to_usfm": _on(documents.through_usj),
    "usx_to_usfm": _on(documents.through_usx),
    "usx_to_usj": _on(documents.usj_through_usx),
    "format": _on(documents.formatted),
    "token_alignment": _on_pairs(documents.aligned_pairs),
    "lint_stack": _on(documents.stack_lint),
}


def _counts(made: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    return made.select("doc_id", *(F.regexp_count(column, F.lit(p)).cast("bigint").alias(f"n_{name}") for name, p in patterns.items()))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: build(DUCK, lambda t: t) for name, build in SQL.items()}
