"""What a conversion's nodes must be, told from the tokens alone."""

from __future__ import annotations

from scriptorium.functions.dialect import Spark
from scriptorium.plans.lint import with_catalog
from scriptorium.plans.tokens import ctes

#: Markers whose node has no marker of its own, is an attribute of another, or depends on how it is closed.
WITHOUT = ("usfm", "cat", "periph", "esbe", "fig", "ref")


def usj_nodes(d: Spark, docs: str) -> str:
    """(doc_id, nth, type, marker): a node for each opening marker and milestone, in their order."""
    name = d.replace("marker", "^[+]", "")
    left = ", ".join(f"'{x}'" for x in WITHOUT)
    return f"""WITH {ctes(d, docs)}, known AS ({with_catalog(d, ["spec_kind"])}),
      own AS (SELECT doc_id, idx, {name} AS marker, CASE WHEN kind = 'Milestone' THEN 'ms' WHEN {name} = 'id' THEN 'book' WHEN {name} = 'c' THEN 'chapter' WHEN {name} = 'v' THEN 'verse'
        WHEN spec_kind = 'Note' THEN 'note' WHEN spec_kind = 'Character' THEN 'char' WHEN spec_kind = 'TableRow' THEN 'table:row' WHEN spec_kind = 'TableCell' THEN 'table:cell'
        WHEN spec_kind = 'Sidebar' THEN 'sidebar' WHEN spec_kind IN ('Paragraph', 'Header', 'Meta') THEN 'para' ELSE 'unknown' END AS type
      FROM known WHERE kind IN ('Marker', 'Milestone') AND {name} NOT IN ({left}))
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS nth, type, marker FROM own"""
