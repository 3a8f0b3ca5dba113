"""Text files as documents, and documents as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".txt", ".md")


def documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(source, text, modified) of the files below a folder that end in one of
    the suffixes, in any case. Bytes that are no UTF-8 become the replacement
    character; empty files are passed over. Other files are not opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = F.lower("path").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return listed.where(wanted).select(F.regexp_replace("path", r"^[a-z]+:/*", "/").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("modified"))


def new_documents(found: DataFrame, known: DataFrame, excluded: Column | None = None) -> DataFrame:
    """The documents whose source `known` (source) does not hold yet, without
    those that the condition `excluded` fits."""
    out = found.join(known.select("source").distinct(), "source", "left_anti")
    return out if excluded is None else out.where(~excluded)


def chunked(docs: DataFrame, most_chars: int = 2000) -> DataFrame:
    """(source, chunk_index, text): paragraphs in order, as many to a chunk as
    stay within `most_chars`; a longer paragraph is a chunk of its own. A null
    or blank text has none. All in the JVM, a document at a time."""
    paragraphs = F.filter(F.transform(F.split("text", r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    empty = F.array().cast("array<string>")

    def add(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (F.size(out) > 0) & (F.length(F.coalesce(last, F.lit(""))) + 2 + F.length(p) <= most_chars)
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat_ws("\n\n", last, p)))
        return F.when((F.size(out) > 0) & fits, joined).otherwise(F.concat(out, F.array(p)))

    safe = lambda out, p: F.when(F.size(out) == 0, F.array(p)).otherwise(add(out, p))
    return docs.where("text is not null").select("source", F.posexplode(F.aggregate(paragraphs, empty, safe)).alias("chunk_index", "text"))
