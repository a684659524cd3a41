"""Lines of documents with running states: fence parity, owning heading, paragraph.

The row-local functions of ``quire.functions.markdown`` need no lines; this view is for analyses that want
a row a line. Its windows are keyed by document, so one shuffle serves all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import js_trim


def lines(files: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, fence, before (fence lines before it), heading, owner (headings so far), paragraph."""
    rows = files.select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line")).withColumn("t", js_trim(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fence", F.startswith("t", F.lit("```")))
    rows = rows.withColumn("before", F.coalesce(F.sum(F.col("fence").cast("int")).over(earlier), F.lit(0)))
    open_ = F.col("before") % 2 == 0
    rows = rows.withColumns({"heading": ~F.col("fence") & open_ & F.col("t").rlike("^#{1,6}\\s+\\S"), "blank": (F.col("t") == "") & open_})
    return rows.withColumns({"owner": F.sum(F.col("heading").cast("int")).over(so_far), "paragraph": F.sum(F.col("blank").cast("int")).over(so_far)})
