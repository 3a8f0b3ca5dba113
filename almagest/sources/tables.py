"""Reading the named tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of a dataset folder; columns and filters that
    are applied to it later reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of papers with the fields of `meta` as flat columns. Nulls get
    the defaults of the data model: zone body, doc_status canonical, "" for
    other missing strings, page 0."""
    t = table(spark, folder, "terms")
    m = F.col("meta")
    return t.select(
        "chunk_id",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(m["source"], F.lit("")).alias("source"),
        F.coalesce(m["chunk_index"], F.lit(0)).alias("chunk_index"),
        F.coalesce(m["heading"], F.lit("")).alias("heading"),
        F.coalesce(m["section_path"], F.lit("")).alias("section_path"),
        F.coalesce(m["page_no"], F.lit(0)).alias("page_no"),
        F.coalesce(m["doc_source"], F.lit("")).alias("doc_source"),
        F.coalesce(m["zone"], F.lit("body")).alias("zone"),
        F.coalesce(m["doc_status"], F.lit("canonical")).alias("doc_status"),
        "ingested_at",
    )


def latest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each (source, chunk_index): later ingests replace
    earlier ones, ties fall to the larger chunk_id."""
    c = chunks(spark, folder)
    cols = [x for x in c.columns if x not in ("source", "chunk_index")]
    best = c.groupBy("source", "chunk_index").agg(
        F.max(F.struct("ingested_at", "chunk_id", *[x for x in cols if x not in ("ingested_at", "chunk_id")])).alias("r")
    )
    return best.select("source", "chunk_index", *[F.col("r")[x].alias(x) for x in cols])
