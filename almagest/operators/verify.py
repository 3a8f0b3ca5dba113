"""Claims against the corpus: quotes, numbers, citations, and the threshold at
which a score counts as support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.operators.catalogue import squash


def numbers(text: Column) -> Column:
    """The distinct numbers of a text in order, as written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), 0))


def numbers_held(text: Column) -> Column:
    """The numbers that a text holds: where no digit or point stands before one
    and no digit after it. Of "3.5" these are 3.5 and 3."""
    at = lambda g: F.regexp_extract_all(text, F.lit(r"(?<![\d.])(\d+)(?:\.\d+)?"), g)
    return F.array_union(at(0), at(1))


def number_claims(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, source, n_chunks): sources with chunks that hold every number
    of a claim (claim_id, text). Claims without numbers are left out. Chunks are
    looked up by the rarest number of a claim and only then checked for the
    others, for which the numbers of claim and chunk move once per pair."""
    c = claims.select("claim_id", numbers(F.col("text")).alias("ns")).where(F.size("ns") > 0)
    k = chunks.select("source", "chunk_id", numbers_held(F.col("text")).alias("has"))
    posts = k.select("chunk_id", F.explode("has").alias("number"))
    often = posts.groupBy("number").agg(F.count("*").alias("df"))
    each = c.select("claim_id", F.explode("ns").alias("number")).join(often, "number", "left")
    # a number that no chunk holds settles its claim
    rare = each.groupBy("claim_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "number")).alias("r")).where("r.df > 0").select("claim_id", F.col("r.number").alias("number"))
    met = rare.join(posts, "number").select("claim_id", "chunk_id").join(c, "claim_id").join(k, "chunk_id")
    return met.where(F.size(F.array_except("ns", "has")) == 0).groupBy("claim_id", "source").agg(F.count("*").alias("n_chunks"))


def verdicts(claims: DataFrame, support: DataFrame) -> DataFrame:
    """(claim_id, verdict) of claims (claim_id, paper) by the sources that
    support them: by the claimed paper, only by another, or by none; without a
    claimed paper, found or not."""
    s = claims.select("claim_id", "paper").join(support.select("claim_id", "source"), "claim_id", "left")
    g = s.groupBy("claim_id", "paper").agg(F.coalesce(F.bool_or(F.col("source") == F.col("paper")), F.lit(False)).alias("own"), F.count("source").alias("n"))
    by_paper = F.when(F.col("own"), "supported_by_claimed_paper").when(F.col("n") > 0, "found_in_other_paper").otherwise("not_found")
    return g.select("claim_id", F.when(F.col("paper").isNull(), F.when(F.col("n") > 0, "found").otherwise("not_found")).otherwise(by_paper).alias("verdict"))


def quotes_in_source(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(quote_id, chunk_index): of quotes (quote_id, source, text) the first
    chunk of their source that holds them, blanks and case apart; null where
    none does. Null and blank quotes are in none."""
    c = chunks.select("source", F.col("chunk_index").alias("at"), squash(F.col("text")).alias("t"))
    q = quotes.select("quote_id", "source", squash(F.col("text")).alias("q"))
    hit = q.where("q <> ''").join(c, "source").where(F.contains("t", "q")).groupBy("quote_id").agg(F.min("at").alias("chunk_index"))
    return q.select("quote_id").join(hit, "quote_id", "left")


def citations_of(claimed: DataFrame, refs: DataFrame) -> DataFrame:
    """(claim_id, found, other_years, n_refs) of citations (claim_id, source,
    first_author, year) against the references of their source."""
    n = refs.groupBy("source").agg(F.count("*").alias("n_refs"))
    r = refs.select("source", "first_author", F.col("year").alias("ref_year"))
    j = claimed.join(r, ["source", "first_author"], "left").groupBy("claim_id", "source").agg(
        F.coalesce(F.bool_or(F.col("ref_year") == F.col("year")), F.lit(False)).alias("found"), F.array_sort(F.collect_set(F.when(F.col("ref_year") != F.col("year"), F.col("ref_year")))).alias("other_years")
    )
    return j.join(n, "source", "left").select("claim_id", "found", "other_years", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall, f1) of the cut-off with the best F1 over
    (score, truth), the highest among equals. Counts are taken per score before
    they are summed up in order."""
    per = scored.where("score is not null and truth is not null").groupBy("score").agg(F.count_if("truth").alias("tp"), F.count("*").alias("n"))
    w = Window.orderBy(F.col("score").desc())  # one row per distinct score; scores are rounded by the caller
    run = per.select("score", F.sum("tp").over(w).alias("tp"), F.sum("n").over(w).alias("n"), F.sum("tp").over(Window.partitionBy()).alias("all"))
    m = run.where("all > 0").select(F.col("score").alias("threshold"), (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("all")).alias("recall"), (2 * F.col("tp") / (F.col("n") + F.col("all"))).alias("f1"))
    return m.orderBy(F.col("f1").desc(), F.col("threshold").desc()).limit(1)
