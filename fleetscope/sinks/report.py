"""Report bodies: one table per server and page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.semantics import escape_markup, scrub_control
from fleetscope.operators.ranking import number_rows

# Row banding and the mark of a missing value.
BAND_COLOURS = ("#EEEDED", "#FFFFFF")
MISSING_STYLE = "color:#FF00FF;"
PRESENT_STYLE = "color:black"


def report_rows(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], order: Sequence[Column], page_rows: int = 500) -> DataFrame:
    """Table rows as markup with their number, banding parity and page."""
    numbered = number_rows(df, list(keys), list(order), "row_number")
    parity = F.col("row_number") % 2

    def cell(name: str) -> Column:
        text = F.col(name).cast("string")
        style = F.when(text.isNull(), MISSING_STYLE).otherwise(PRESENT_STYLE)
        value = escape_markup(scrub_control(F.coalesce(text, F.lit("NULL"))))
        return F.concat(F.lit('<td align="left" style="'), style, F.lit('">'), value, F.lit("</td>"))

    colour = F.when(parity == 1, BAND_COLOURS[1]).otherwise(BAND_COLOURS[0])
    row = F.concat(F.lit('<tr bgcolor="'), colour, F.lit('">'), *[cell(c) for c in columns], F.lit("</tr>"))
    page = F.floor((F.col("row_number") - 1) / page_rows).cast("bigint")
    return numbered.select(*keys, "row_number", parity.alias("row_parity"), page.alias("page_no"), row.alias("row_markup"))


def report_document(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], order: Sequence[Column], heading: Column | None = None, page_rows: int = 500) -> DataFrame:
    """One HTML body per key and page of at most ``page_rows`` rows; no row is left out.

    ``columns`` maps column names to titles. Row banding runs on over the pages of a key.
    """
    rows = report_rows(df, keys, columns, order, page_rows)
    titles = "".join(f"<th>{title}</th>" for title in columns.values())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_number", "row_markup"))), lambda r: r["row_markup"])
    pages = rows.groupBy(*keys, "page_no").agg(F.array_join(lines, "").alias("_rows"))
    lead = F.lit("") if heading is None else heading
    body = F.concat(
        F.lit("<html><body>"), lead, F.lit(f'<table border="1"><tr bgcolor="{BAND_COLOURS[0]}">{titles}</tr>'),
        F.col("_rows"), F.lit("</table></body></html>"),
    )
    return pages.select(*keys, "page_no", body.alias("body"))
