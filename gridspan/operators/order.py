"""Orders of catalog paths as data: a place for each path, without a global sort on one task's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consolidated_places(df: DataFrame, path: str = "path") -> DataFrame:
    """Paths with their place by depth, then case-folded, then by code points.

    The rows of a depth and first letter are ranked among themselves and then shifted by the rows of the groups before, so
    that the only single task sees one row a group. Ranges follow code points of the case-folded path.
    """
    depth = F.when(F.col(path) == "", 0).otherwise(F.size(F.split(F.col(path), "/")))
    rows = df.select(path, depth.alias("depth"), F.lower(path).alias("folded")).withColumn("head", F.substring("folded", 1, 1))
    sizes = rows.groupBy("depth", "head").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("depth", "head", (F.sum("n").over(Window.orderBy("depth", "head")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("depth", "head").orderBy("folded", path)))
    return ranked.join(before, ["depth", "head"]).select(path, (F.col("rank") + F.col("before")).cast("int").alias("place"))
