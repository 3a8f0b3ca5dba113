"""Every core query against its SQL on the small tables; of those without SQL
what must hold of their rows."""

import math

import pytest
from pyspark.sql import functions as F

from almagest.operators import catalogue, coverage, documents
from almagest.plans import registry
from almagest.sources.tables import latest_chunks, table
from tests.oracle import both, connection

QUERIES, SQL = registry.load()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, data, name):
    got, want = both(spark, con, data, QUERIES[name], SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def rows(spark, data, name):
    return QUERIES[name](spark, data).collect()


def unique(got, *keys):
    return len({tuple(r[k] for k in keys) for r in got}) == len(got)


def p4_found(spark, data, got):
    u = {r.id: r for r in rows(spark, data, "p4_common_units")}
    ok = lambda x: x is not None and not math.isnan(x)
    want = {(i, n) for i, r in u.items() for n in ("freq_mhz", "hours") if ok(r[f"{n}_stated"]) and not (ok(r[f"{n}_raw"]) and abs(r[f"{n}_raw"] - r[f"{n}_stated"]) <= 0.02 * r[f"{n}_stated"])}
    assert got and {(r.request_id, r.quantity) for r in got} == want


def p4_common_units(spark, data, got):
    assert unique(got, "id") and len(got) == table(spark, data, "requests").count()
    assert {r.freq_mhz_unit for r in got} >= {"MHz", "GHz"} and all(r.hours is None or math.isnan(r.hours) or r.hours > 0 for r in got)


def a4_contexts(spark, data, got):
    per = {r.source for r in QUERIES["a2_mention_counts"](spark, data).where("term = 'pulsar survey|magnetar'").collect()}
    assert {r.source for r in got} == per and all("magnetar" in r.snippet.lower() or "survey" in r.snippet.lower() for r in got) and unique(got, "source", "chunk_index")


def x6_guarded_mentions(spark, data, got):
    c = coverage.select_chunks(latest_chunks(spark, data))
    free = {r.source: r.mentions for r in coverage.mentions(c, ["magnetar|pulsar"]).collect()}
    assert got and all(0 < r.mentions <= free[r.source] for r in got) and sum(r.mentions for r in got) < sum(free.values())


def e6_duplicates(spark, data, got):
    status = {r.source: r.status for r in got}
    assert len(status) == len(got) == latest_chunks(spark, data).select("source").distinct().count()
    assert all((r.duplicate_of == "") == (r.status == "canonical") for r in got) and all(status[r.duplicate_of] == "canonical" for r in got if r.duplicate_of)


def x28_zones(spark, data, got):
    assert len(got) == latest_chunks(spark, data).count() and unique(got, "chunk_id") and {r.zone for r in got} <= set(coverage.ZONES) and len({r.zone for r in got}) > 2


def s25_retag(spark, data, got):
    zones = {r.chunk_id: r.zone for r in rows(spark, data, "x28_zones")}
    assert {r.chunk_id: r.zone for r in got} == zones and {r.doc_status for r in got} <= {"canonical", "duplicate"}


def a16_acronyms(spark, data, got):
    assert unique(got, "sense") and all(r.n >= r.n_sources >= 1 for r in got)


def r1_retrieve(spark, data, got):
    queries = latest_chunks(spark, data).where("chunk_id % 50 = 0").count()
    assert len(got) == 5 * queries and unique(got, "query_id", "rank") and unique(got, "query_id", "id")
    assert all(0 <= r.confidence <= 1 for r in got) and all(r.id == r.query_id for r in got if r["rank"] == 1 and r.confidence > 0.9)


def x15_references(spark, data, got):
    assert unique(got, "source", "position") and all(r.ref_key and (r.bibcode is None or len(r.bibcode) == 19) and (r.year is None or 1900 <= r.year < 2100) for r in got)


def a7_top_cited(spark, data, got):
    n = [r.n_papers for r in got]
    assert n == sorted(n, reverse=True) and all(k >= 2 for k in n)


def a8_citing_papers(spark, data, got):
    assert all("et al" in r.raw.lower() for r in got) and len(got) <= 20


def a9_citation_stats(spark, data, got):
    refs = rows(spark, data, "x15_references")
    (r,) = got
    assert (r.n_refs, r.n_cites, r.n_papers) == (len({x.ref_key for x in refs}), len(refs), len({x.source for x in refs})) and r.with_bibcode == len({x.ref_key for x in refs if x.bibcode})


def a21_year_histogram(spark, data, got):
    refs = {(x.ref_key, x.year) for x in rows(spark, data, "x15_references")}
    assert sum(r.n_works for r in got) == len(refs) and unique(got, "year")


def e7_merged_works(spark, data, got):
    refs = rows(spark, data, "x15_references")
    assert {r.ref_key for r in got} == {x.ref_key for x in refs} and unique(got, "ref_key") and all(w.work_key in {r.ref_key for r in got} for w in got)
    work = {r.ref_key: r.work_key for r in got}
    by_doi = {}
    for x in refs:
        if x.doi:
            by_doi.setdefault(x.doi, set()).add(work[x.ref_key])
    assert all(len(w) == 1 for w in by_doi.values())


def _hours(spark, data):
    r = catalogue.effective_requests(table(spark, data, "requests")).where("hours > 0 and not isnan(hours) and telescope in ('low', 'mid')")
    return {x.telescope: x.h for x in r.groupBy("telescope").agg(F.sum("hours").alias("h")).collect()}


def t4_placement_states(spark, data, got):
    assert {r.state for r in got} <= {"placed", "relaxed", "never", "unplaced"} and sum(r.hours for r in got) == pytest.approx(sum(_hours(spark, data).values()))


def t4_demand_totals(spark, data, got):
    asked = _hours(spark, data)
    for r in got:
        assert r.all_h == pytest.approx(r.placed_h + r.never_h + r.unplaced_h, abs=0.3) and r.all_h <= asked.get(r.telescope, 0) + 0.3 and r.supply_h == pytest.approx(8760 * 0.85 * 5, rel=1e-3)


def t4_lst_pressure(spark, data, got):
    total = {r.telescope: r for r in rows(spark, data, "t4_demand_totals")}
    assert len(got) == 48
    for t in total:
        assert sum(r.demand_h for r in got if r.telescope == t) == pytest.approx(total[t].placed_h, abs=2)


def a23_lst_by_group(spark, data, got):
    per = {}
    for r in got:
        per[r.telescope, r.lst_bin] = per.get((r.telescope, r.lst_bin), 0) + r.demand_h
    for r in rows(spark, data, "t4_lst_pressure"):
        assert per.get((r.telescope, r.lst_bin), 0) == pytest.approx(r.demand_h, abs=0.2)


def w9_pressed_bins(spark, data, got):
    p = rows(spark, data, "t4_lst_pressure")
    for t in ("low", "mid"):
        assert [r.pressure for r in sorted(got, key=lambda r: r["rank"]) if r.telescope == t] == sorted((x.pressure for x in p if x.telescope == t), reverse=True)[:5]
    assert all(r.lst[2] == "h" and r.lst[3:] == "30m" for r in got)


def t3_visibility(spark, data, got):
    per = {}
    for r in got:
        per.setdefault(r.name, []).append(r)
    for rs in per.values():
        assert len(rs) == 12 and sum(r.hours for r in rs) == pytest.approx(365 * rs[0].hours_per_day, rel=0.01, abs=1)


def u1_quantities(spark, data, got):
    assert got and all(r.value >= 0 and r.start >= 0 and r.unit for r in got)


def u3_requirement_drafts(spark, data, got):
    assert unique(got, "id", "field") and {r.field for r in got} >= {"frequency", "hours"} and all((r.number is None) != (r.word is None) for r in got)


def u4_requirement_checks(spark, data, got):
    assert unique(got, "id", "field") and len(got) == 2 * table(spark, data, "requests").count() and all((r.verdict is None) == (r.value is None) for r in got) and {r.verdict for r in got} >= {"stated", "inferred"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_invariants(spark, data, name):
    globals()[name](spark, data, rows(spark, data, name))


def test_documents_share_every_text_when_asked(spark):
    """With no guard texts of many documents make pairs, too."""
    c = spark.createDataFrame([(i * 10 + k, f"d{i}", k, t) for i in range(25) for k, t in enumerate(["boilerplate", f"own {i % 24}"])], "chunk_id int, source string, chunk_index int, text string")
    assert {(r.a, r.b) for r in documents.similar_documents(c, 0.3).collect()} == {("d0", "d24")}
    every = {(r.a, r.b): round(r.jaccard, 3) for r in documents.similar_documents(c, 0.3, most_shared=None).collect()}
    assert len(every) == 25 * 24 // 2 and every["d0", "d24"] == 1.0 and every["d0", "d1"] == 0.333
