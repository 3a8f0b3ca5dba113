"""The queries of this subpackage: those with SQL against it, of the others
what must hold of their rows."""

import pytest

from almagest.llm import queries
from almagest.sources.tables import table
from tests.oracle import both, connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, data, name):
    got, want = both(spark, connection(data), data, queries.QUERIES[name], queries.SQL[name])
    assert got == want


def rows(spark, data, name):
    return queries.QUERIES[name](spark, data).collect()


def n(spark, data, name):
    return table(spark, data, name).count()


def p1_pieces(spark, data, got):
    assert {r.chunk_id for r in got} == {r.chunk_id for r in table(spark, data, "terms").where("text is not null").collect()} and all(len(r.text) == r.end - r.start for r in got)


def p1_cuts(spark, data, got):
    pieces = rows(spark, data, "p1_pieces")
    assert sum(r.n_cuts for r in got) == len(pieces) - len({r.chunk_id for r in pieces}) and all(r.n_valleys <= r.n_cuts for r in got)


def p2_found(spark, data, got):
    assert all(r.chunk_id_a < r.chunk_id_b for r in got) and len(set(got)) == len(got)
    group = {r.chunk_id: r.class_id for r in rows(spark, data, "p2_groups")}
    assert all(group[r.chunk_id_a] == group[r.chunk_id_b] for r in got)


def p2_groups(spark, data, got):
    size = {}
    for r in got:
        size[r.class_id] = size.get(r.class_id, 0) + 1
    assert len(got) == n(spark, data, "terms") and all(r.class_size == size[r.class_id] and r.class_id <= r.chunk_id for r in got)


def p2_pairs(spark, data, got):
    """With the members, the pairs of different texts are those of p2_found."""
    rep = {r.chunk_id: r.rep for r in rows(spark, data, "p2_members")}
    pairs = {(r.rep_a, r.rep_b) for r in got}
    found = {tuple(sorted((rep[r.chunk_id_a], rep[r.chunk_id_b]))) for r in rows(spark, data, "p2_found")}
    assert {p for p in found if p[0] != p[1]} <= pairs and all(r.jaccard >= 0.6 for r in got)


def p2_members(spark, data, got):
    rep = {r.chunk_id: r.rep for r in got}
    assert len(rep) == len(got) and all(rep[r] == r and r <= k for k, r in rep.items())


def p5_found(spark, data, got):
    m = {r.name_key: r.entry_id for r in rows(spark, data, "p5_matches")}
    assert got and len({r.name_key for r in got}) == len(got) and sum(m[r.name_key] == r.source_id for r in got) >= 0.98 * len(got)


def p5_matches(spark, data, got):
    assert len(got) == table(spark, data, "names").select("name_key").distinct().count() and all((r.entry_id is None) == (r.status == "unmatched") for r in got)


def p6_canonical(spark, data, got):
    odd = {(r.table_name, r.row_key) for r in rows(spark, data, "p6_found")}
    texts = {("names", r.name_key): r.raw_name for r in table(spark, data, "names").collect()}
    once = {(r.table_name, r.row_key): r.canonical for r in got}
    assert all(((k in odd) == (once[k] != t)) for k, t in texts.items() if t is not None)


def p7_ids(spark, data, got):
    counts = {r.doc_id: r.n_tokens for r in rows(spark, data, "p7_counts")}
    assert len(got) == n(spark, data, "documents") and all(len(r.ids) == counts[r.doc_id] for r in got)


def p7_counts(spark, data, got):
    empty = {r.doc_id for r in table(spark, data, "documents").where("coalesce(text, '') = ''").collect()}
    assert {r.doc_id for r in got if r.n_tokens == 0} == empty


def p8_found(spark, data, got):
    assert {r.source for r in got} == {r.source for r in rows(spark, data, "p8_shares") if r.most_tokens < r.target_tokens}


def p8_shares(spark, data, got):
    assert sum(r.actual_share for r in got) == pytest.approx(1) and all(r.most_copies <= r.max_repeats for r in got)
    free = [r.budget_tokens / r.weight for r in got if r.budget_tokens < r.most_tokens]
    assert max(free) == pytest.approx(min(free), rel=1e-6) and all(r.budget_tokens == pytest.approx(r.most_tokens) for r in got if not r.reachable)


def p8_mixture(spark, data, got):
    most = {r.source: r.max_repeats for r in table(spark, data, "mix_targets").collect()}
    assert len({(r.source, r["pass"], r.position) for r in got}) == len(got) == len({(r.doc_id, r["pass"]) for r in got}) and all(r["pass"] <= most[r.source] for r in got)


def p9_found(spark, data, got):
    assert {r.doc_id for r in got} == {r.doc_id for r in rows(spark, data, "p9_scores") if r.flagged}


def p9_scores(spark, data, got):
    assert len(got) == n(spark, data, "documents") and all(0 <= r.score <= 1 and r.flagged == (r.score > 0.5) for r in got)


def p9_rates(spark, data, got):
    assert sum(r.n_docs for r in got) == n(spark, data, "documents") and all(0 <= r.rate <= 1 for r in got)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_invariants(spark, data, name):
    globals()[name](spark, data, rows(spark, data, name))
