"""File sources and sinks beyond plain tables: labelled lines, folders of extra rows, nested documents, reports and series (SR4-SR11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled_lines(spark: SparkSession, path: str, positive: str = "spam", origin: str = "lines") -> DataFrame:
    """SR4: (text, label, origin, group) of a tab-separated file of label and text without quoting; every row is a group of its own."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("label string, text string").csv(path)
    own = F.concat(F.lit(f"{origin}:"), F.sha2(F.coalesce("text", F.lit("")), 256))
    return rows.select("text", (F.col("label") == positive).cast("int").alias("label"), F.lit(origin).alias("origin"), own.alias("group"))


def extra_rows(spark: SparkSession, folder: str, required: Sequence[str] = ("text", "label", "origin", "group")) -> DataFrame:
    """SR5: the required columns of every CSV file of a folder, by name. A file without one of them is an error. Files are looked
    up by a header read each, so a folder holds a modest number of them."""
    paths = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").orderBy("path").collect()]
    out = None
    for path in paths:
        part = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        missing = [c for c in required if c not in part.columns]
        if missing:
            raise ValueError(f"{path} has no {', '.join(missing)}")
        part = part.select(*required)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in required))


def corridor_nodes(spark: SparkSession, path: str) -> DataFrame:
    """SR7: (corridor, mode, idx, name, lat, lon, hub) of multi-line JSON documents of corridors with their node_path."""
    node = "array<struct<name:string,lat:double,lon:double,is_major_hub:boolean>>"
    docs = spark.read.option("multiLine", True).schema(f"id string, mode string, node_path {node}").json(path)
    each = docs.select(F.col("id").alias("corridor"), "mode", F.posexplode("node_path").alias("idx", "n"))
    return each.select("corridor", "mode", "idx", "n.name", "n.lat", "n.lon", F.col("n.is_major_hub").alias("hub"))


def largest_communities(measured: DataFrame, path: str, most: int = 20) -> None:
    """SR9: write the ``most`` largest communities as JSON, one a line; a top-k report."""
    measured.orderBy(F.desc("size"), "community").limit(most).write.json(path)


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """SR10: metric reports, one JSON document a model, as one table; false_alarm is 1 - precision. Metrics that a report lacks are null."""
    rows = spark.read.option("multiLine", True).schema("model string, precision double, recall double, roc_auc double").json(folder)
    return rows.withColumn("false_alarm", F.round(1 - F.col("precision"), 4))


def series(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """SR11: one array a column for every key, in order; a series has as many points as generations."""
    points = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return rows.groupBy(key).agg(points.alias("_p")).select(key, *[F.col(f"_p.{c}").alias(c) for c in (order, *columns)])
