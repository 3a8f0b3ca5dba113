"""Mixing sources to target weights.

Sizes are tokens. The shares of the sources are known after one aggregation to
a row per source; everything about weights is worked out on those few rows.
Temperature mixing bends the natural shares towards the target weights: at
exponent a a source has natural ** (1 - a) * target ** a, so 0 keeps its natural
share and 1 gives it the target. The exponent is bisected for the largest that
the source's repetition limit allows; below 1 the source cannot reach its
target. The tempered weights are normalised to the size of the whole by a common
factor, found by bisection too, that sources at their limit do not follow: the
others keep the proportion of their targets.

The mixture is realised by block permutations: each pass over a source goes
through its blocks in an order of its own, and through the documents of a block
in an order of its own, both by a hash. The last pass ends where the budget
does. No source is ever sorted as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.llm.bpe import count_tokens
from almagest.session import cut

#: Blocks of the hash order of a source; a block holds about this share of it.
BLOCKS = 4096


def tempered(natural: float, target: float, exponent: float) -> float:
    """The share on the way from the natural one (exponent 0) to the target (1)."""
    if exponent >= 1 or target <= 0 or natural <= 0:
        return target if exponent >= 1 or target <= 0 else 0.0
    return natural ** (1 - exponent) * target**exponent


def temperature_exponent(natural: float, target: float, budget: float, most: float) -> float:
    """The largest exponent in [0, 1] at which the source, with its tempered
    share of the budget, stays within `most`, its size times its repetitions.
    1: the target is reached. A source without tokens keeps 0, if it has a
    target."""
    if tempered(natural, target, 1.0) * budget <= most:
        return 1.0
    if natural <= 0:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tempered(natural, target, mid) * budget <= most else (lo, mid)
    return lo


def normalised(weight: np.ndarray, most: np.ndarray, budget: float) -> np.ndarray:
    """Tokens per source that add up to the budget, as far as the limits allow:
    the weights times a common factor of at least 1, bisected, none above its
    limit `most`."""
    full = float(np.minimum(most, np.where(weight > 0, np.inf, 0.0)).sum())
    if full <= budget or not (weight > 0).any():
        return np.where(weight > 0, most, 0.0)
    give = lambda f: np.minimum(f * weight * budget, most)
    lo, hi = 0.0, 1.0
    while give(hi).sum() < budget:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if give(mid).sum() < budget else (lo, mid)
    return give(hi)


def source_sizes(sizes: DataFrame) -> DataFrame:
    """A row per source: number of documents and of tokens. Pre-aggregated
    before the shuffle, so that a hot source costs no more than others."""
    return sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


PLAN_SCHEMA = "source string, weight double, max_repeats int, n_docs bigint, n_tokens bigint, natural_share double, exponent double, tempered_share double, target_tokens double, most_tokens bigint, reachable boolean, budget_tokens double, total_tokens bigint"


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("source", na_position="last").reset_index(drop=True)
    total = int(pdf["n_tokens"].sum())
    t = pdf[pdf["weight"].notna()].reset_index(drop=True).copy()
    w, r, n = t["weight"].to_numpy(float), t["max_repeats"].fillna(1).to_numpy(float), t["n_tokens"].to_numpy(float)
    most = r * n
    natural = n / total if total else n
    a = np.array([temperature_exponent(s, x, total, m) for s, x, m in zip(natural, w, most)])
    temper = np.array([tempered(s, x, e) for s, x, e in zip(natural, w, a)])
    t["natural_share"], t["exponent"], t["tempered_share"] = natural, a, temper
    t["target_tokens"], t["most_tokens"] = w * total, most.astype(np.int64)
    t["reachable"] = a >= 1
    # a source at its limit is held there; the others share what it leaves in the proportion of their weights
    t["budget_tokens"] = normalised(temper, most, total * float(w.sum()))
    t["total_tokens"] = total
    t["max_repeats"] = r.astype(np.int32)
    return t[[c.split()[0] for c in PLAN_SCHEMA.split(", ")]]


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per source of `targets` (source, weight, max_repeats): its size,
    natural share of T (the tokens of all documents), exponent and tempered
    share, whether it can reach weight x T within max_repeats, and its token
    budget in a mixture of T tokens times the sum of the weights. A source without documents is there with size 0; sources
    without a target count for T only; documents of a null source too. The
    group has as many rows as there are sources."""
    known = targets.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    rows = source_sizes(sizes).join(known, "source", "full_outer")
    rows = rows.select("source", F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("max_repeats"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    # Sources without a target only add to T: one row for them all.
    rows = rows.withColumn("key", F.when(F.col("weight").isNotNull(), F.col("source"))).groupBy("key").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).withColumnRenamed("key", "source")
    return rows.groupBy(F.lit(1).alias("all")).applyInPandas(lambda p: _plan(p), PLAN_SCHEMA)


def token_sizes(documents: DataFrame, vocabulary=None) -> DataFrame:
    """(doc_id, source, n_tokens) of each row of documents."""
    return count_tokens(documents, keep=("doc_id", "source"), vocabulary=vocabulary)


def mixture(sizes: DataFrame, plan_df: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, pass, position, at): a row for each time that
    the mixture holds a document: in which pass over its source, at which place
    of that pass from 1, and how far through the source's budget it ends, in
    (0, 1], so that the order of `at` interleaves the sources evenly.

    A budget is passed whole as often as it fits, and in one more pass as far
    as it goes: whole blocks, then documents of the block in which it ends
    while they fit. No row of documents occurs more than max_repeats times.
    Sources without tokens or budget have no rows."""
    p = plan_df.where("n_tokens > 0 and budget_tokens > 0").select(
        "source", "max_repeats", F.least(F.floor(F.col("budget_tokens") / F.col("n_tokens") + 1e-9), F.col("max_repeats")).cast("int").alias("whole"), "budget_tokens", F.col("n_tokens").alias("size")
    )
    rest = F.when(F.col("whole") < F.col("max_repeats"), F.greatest(F.lit(0.0), F.col("budget_tokens") - F.col("whole") * F.col("size"))).otherwise(0.0)
    p = p.withColumn("rest", rest)
    passes = p.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("whole") + (F.col("rest") > 0).cast("int")))).where("pass > 0")
    d = sizes.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)))
    # at most BLOCKS rows a source, and as many again for each pass
    blocks = d.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).join(passes, "source")
    before = Window.partitionBy("source", "pass").orderBy(F.xxhash64("block", "pass"), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"tokens_before": F.coalesce(F.sum("t").over(before), F.lit(0)), "rows_before": F.coalesce(F.sum("n").over(before), F.lit(0))})
    limit = F.when(F.col("pass") <= F.col("whole"), F.col("size").cast("double")).otherwise(F.col("rest"))
    blocks = blocks.withColumn("limit", limit).where((F.col("tokens_before") < F.col("limit")) | (F.col("pass") <= F.col("whole")))
    blocks = blocks.withColumn("edge", F.col("tokens_before") + F.col("t") > F.col("limit")).select("source", "block", "pass", "tokens_before", "rows_before", "limit", "edge", "size", "budget_tokens")
    d = d.join(blocks, ["source", "block"])
    inside = Window.partitionBy("source", "pass", "block").orderBy(F.xxhash64("doc_id", "pass"), "doc_id", "n_tokens")
    d = d.withColumns({"upto": F.col("tokens_before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "position": F.col("rows_before") + F.row_number().over(inside)})
    # only where the budget ends the order decides what is taken
    cols = ["doc_id", "source", "n_tokens", "pass", "position", (((F.col("pass") - 1) * F.col("size") + F.col("upto")) / F.col("budget_tokens")).alias("at")]
    return d.where("not edge").select(*cols).unionByName(d.where("edge and upto <= limit").select(*cols))


def shares(documents: DataFrame, targets: DataFrame, vocabulary=None) -> DataFrame:
    """The plan with what the mixture actually reaches: tokens and share per
    source, and the most copies of a document. Token counts are written to the
    shared checkpoint folder once, as the texts are encoded once."""
    sizes = cut(token_sizes(documents, vocabulary))
    p = cut(plan(sizes, targets))
    got = mixture(sizes, p).groupBy("source").agg(F.sum("n_tokens").alias("actual_tokens"), F.max("pass").alias("most_copies"))
    out = p.join(got, "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    whole = out.agg(F.sum("actual_tokens").alias("all_tokens"))
    return out.crossJoin(F.broadcast(whole)).select(  # one row
        *p.columns, "actual_tokens", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.when(F.col("all_tokens") > 0, F.col("actual_tokens") / F.col("all_tokens")).alias("actual_share")
    )


def found(documents: DataFrame, targets: DataFrame, vocabulary=None) -> DataFrame:
    """(source) of each target that its repetitions cannot fill."""
    return plan(token_sizes(documents, vocabulary), targets).where("not reachable").select("source")


def kept(shares_df: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, within_limit, near_budget): whether no
    document of a source occurs too often and its tokens are as many as its
    budget, but for one document or a thousandth."""
    near = F.abs(F.col("actual_tokens") - F.col("budget_tokens")) <= F.greatest(F.lit(20000.0), F.col("budget_tokens") / 1000)
    return shares_df.select("source", "weight", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("within_limit"), near.alias("near_budget"))
