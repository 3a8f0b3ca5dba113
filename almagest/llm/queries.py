"""The named queries of this subpackage, and their SQL."""

from __future__ import annotations

from almagest.llm import bpe, confusables, mixing, namematch, neardup, segment, toxicity
from almagest.llm.sql import SQL  # noqa: F401
from almagest.sources.tables import table

QUERIES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def p7_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"))


@_query
def p7_counts(spark, d):
    return bpe.count_tokens(table(spark, d, "documents"))


@_query
def p7_lengths(spark, d):
    """How many bytes the tokens of each document stand for: those of its text."""
    return bpe.decoded_lengths(table(spark, d, "documents"))


@_query
def p8_found(spark, d):
    return mixing.found(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@_query
def p8_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@_query
def p8_mixture(spark, d):
    from almagest.session import cut

    sizes = cut(mixing.token_sizes(table(spark, d, "documents")))
    return mixing.mixture(sizes, mixing.plan(sizes, table(spark, d, "mix_targets")))


def _three(spark, d):
    return [table(spark, d, n) for n in ("terms", "names", "requests")]


@_query
def p6_found(spark, d):
    return confusables.found(*_three(spark, d))


@_query
def p6_canonical(spark, d):
    return confusables.canonical(confusables.values(*_three(spark, d))).select("table_name", "row_key", "canonical")


@_query
def p1_found(spark, d):
    return segment.found(table(spark, d, "terms"), table(spark, d, "chunk_limits"))


@_query
def p1_pieces(spark, d):
    return segment.split(table(spark, d, "terms"), table(spark, d, "chunk_limits"))


@_query
def p1_cover(spark, d):
    """Whether the pieces of each chunk cover it, in order, within the limit and with the overlap."""
    return segment.cover(segment.split(table(spark, d, "terms"), table(spark, d, "chunk_limits")))


@_query
def p1_cuts(spark, d):
    return segment.cut_report(table(spark, d, "terms"), table(spark, d, "chunk_limits"))


@_query
def p2_found(spark, d):
    return neardup.found(table(spark, d, "terms"))


@_query
def p2_groups(spark, d):
    return neardup.groups(table(spark, d, "terms"))


@_query
def p2_pairs(spark, d):
    return neardup.representative_pairs(table(spark, d, "terms"))


@_query
def p2_members(spark, d):
    return neardup.membership(table(spark, d, "terms"))


@_query
def p5_found(spark, d):
    return namematch.found(*[table(spark, d, n) for n in ("names", "sources", "catalog_aliases")])


@_query
def p5_matches(spark, d):
    return namematch.matches(*[table(spark, d, n) for n in ("names", "sources", "catalog_aliases")])


@_query
def p8_weights(spark, d):
    """The mixture's sources with what must hold of their shares."""
    return mixing.kept(mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets")))


@_query
def p9_found(spark, d):
    return toxicity.found(table(spark, d, "documents"), table(spark, d, "review_labels"))


@_query
def p9_scores(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, d, "review_labels")))


@_query
def p9_rates(spark, d):
    return toxicity.rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


@_query
def p9_rate_totals(spark, d):
    """Every document counts for its source's rate once."""
    r = toxicity.rates(table(spark, d, "documents"), table(spark, d, "review_labels"))
    return r.selectExpr("source", "n_docs", "n_flagged between 0 and n_docs and abs(rate * n_docs - n_flagged) < 1e-6 as counts_agree")
