import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almagest.functions.inflect import inflected, singular
from almagest.functions.textfold import fold_visual, with_fold
from almagest.operators import catalogue, citations, coverage, documents, graph, retrieval, schedule

CHUNK = "chunk_id bigint, text string, source string, chunk_index int, heading string, section_path string, page_no int, doc_source string, zone string, doc_status string"


def chunk(i, text, source="a/b/S/P01.pdf", index=0, heading="1 Introduction", zone="body", status="canonical"):
    return (i, text, source, index, heading, heading, 1, "x", zone, status)


def test_fold(spark):
    cases = {"KIТТEB": "KITTEB", "ｇｈｔ": "ght", "a​b": "ab", "Brücke": "Brücke", "ﬁeld µJy": "field μJy", "σκοτεινή": "σκοτεινή", "ΛCDM": "ΛCDM", "x y": "x y", "a\tb\r\n−–“”": "a\tb\r\n−–“”", "": "", "x̂̂": "x̂̂"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    for r in with_fold(df, "t", "a").withColumn("b", fold_visual(F.col("t"))).collect():
        assert r.a == r.b == cases.get(r.t), ascii(r.t)


def test_inflection():
    assert [singular(w) for w in ("surveys", "frequencies", "analysis", "radius", "boxes", "FRBS", "mass")] == ["survey", "frequency", "analysis", "radius", "box", "FRBS", "mass"]
    for w, hits in (("survey", ["survey", "surveys"]), ("luminosity", ["luminosity", "luminosities"]), ("FRB", ["FRB", "FRBs"]), ("mode", ["mode", "modes"])):
        assert all(re.fullmatch(inflected(w), h) for h in hits)


def test_coverage_counts_alternatives_one_by_one(spark):
    c = spark.createDataFrame([chunk(1, "Zoom mode and zoom-modes. RM is high; hi."), chunk(2, "HI line, zoom mode", "a/b/S/P02.pdf"), chunk(3, "", "a/b/S/P03.pdf")], CHUNK)
    m = {(r.term, r.source[-7:-4]): r.mentions for r in coverage.mentions(c, ["zoom mode|zoom-mode", "HI"]).collect()}
    assert m == {("zoom mode|zoom-mode", "P01"): 4, ("zoom mode|zoom-mode", "P02"): 2, ("HI", "P02"): 1}
    strict = {r.source[-7:-4]: r.mentions for r in coverage.mentions(c, ["zoom mode"], strict=True).collect()}
    assert strict == {"P01": 1, "P02": 1}
    r = coverage.coverage(coverage.mentions(c, ["zoom mode|zoom-mode"]), min_hits=3).first()
    assert (r.total_mentions, r.n_papers, r.n_sections) == (6, 1, 1)
    with pytest.raises(ValueError, match="Unknown zones"):
        coverage.select_chunks(c, zones=["nowhere"])


def test_guard_removes_overlapping_matches(spark):
    c = spark.createDataFrame([chunk(1, "Planck data; Max Planck Institute; Planck's constant; Planck maps")], CHUNK)
    assert coverage.mentions_guarded(c, "Planck", [r"Max[- ]Planck\w*", r"Planck(?:'s)?\s+constants?"]).first().mentions == 2


def test_zones_in_any_order(spark):
    heads = ["1 Introduction", "References", "0004-6361/202348444.", "Appendix A: Beam model"]
    refs = "Smith, A. 2019, ApJ , 115, doi: 10.1/x. Condon arXiv: 1405.1452 and MNRAS, 12"
    rows = [chunk(i, refs if i in (1, 2) else "Some prose about beams.", index=i, heading=h) for i, h in enumerate(heads)]
    for order in (rows, rows[::-1]):
        z = documents.assign_zones(spark.createDataFrame(order, CHUNK)).orderBy("chunk_index").collect()
        assert [r.zone for r in z] == ["body", "references", "references", "appendix"]
    assert documents.assign_zones(spark.createDataFrame([], CHUNK)).count() == 0


def test_fingerprint_is_of_content(spark):
    rows = [chunk(i, f"text {i}", f"a/b/S/P{i % 3}.pdf", i) for i in range(9)]
    f = lambda x: documents.fingerprint(spark.createDataFrame(x, CHUNK)).first().fingerprint
    assert f(rows) == f(rows[::-1]) != f([chunk(0, "other", "a/b/S/P0.pdf", 0), *rows[1:]])


def test_duplicates_keep_the_best(spark):
    rows = [chunk(i, f"text {i % 4}", f"a/b/S/P{i // 4}.pdf", i % 4) for i in range(12)] + [chunk(50, "alone", "a/b/S/Q.pdf")]
    d = {r.source: (r.status, r.duplicate_of) for r in documents.duplicates(spark.createDataFrame(rows, CHUNK), F.length("source")).collect()}
    assert d == {"a/b/S/P0.pdf": ("canonical", ""), "a/b/S/P1.pdf": ("duplicate", "a/b/S/P0.pdf"), "a/b/S/P2.pdf": ("duplicate", "a/b/S/P0.pdf"), "a/b/S/Q.pdf": ("canonical", "")}


def test_components_of_a_path_and_a_loop(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (102, 102)], "a int, b int")
    n = spark.createDataFrame([(i,) for i in [*range(31), 100, 101, 102, 103]], "node int")
    got = {r.node: r.component for r in graph.components(e, n).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 102, 103: 103}


REFS = {
    "Condon, J. J., et al. 1998, AJ, 115, 1693": "bib:1998AJ....115.1693C",
    "J. J. Condon et al. AJ , 115(5):1693-1716, May 1998. doi: 10.1086/ 300337.": "bib:1998AJ....115.1693C",
    "Someone, A. et al. arXiv:1405.1452, 2014. doi: 10.48550/arXiv. 1405.1452.": "arxiv:1405.1452",
    "Author, B. 2015, PoS(BOOK14)032": "book14:32",
}


@pytest.mark.parametrize("entry", REFS)
def test_reference_keys(entry):
    assert citations.parse_ref(entry)["ref_key"] == REFS[entry]


def test_reference_fields():
    assert citations.parse_ref("de Blok, W. J. G., 2008, AJ, 136, 2648")["first_author"] == "blok"
    assert citations.parse_ref("J. J. Condon et al. AJ , 115(5):1693-1716, May 1998. doi: 10.1086/ 300337.")["doi"] == "10.1086/300337"
    assert citations.bibcode(2016, "A&A", "594", "A13", "P") == "2016A&A...594A..13P"
    assert citations.parse_ref("") is None
    assert len(citations.split_entries("Kaiser, N. 1987, MNRAS, 227, 1\nLong title\nwithout a year 1999, ApJ, 1, 2 Smith, A. 2001, AJ, 3, 4")) == 3


def test_shared_ids_merge(spark):
    rows = [("bib:2000ApJ...1.....1A", "10.1/x", None), ("doi:10.1/x", "10.1/x", None), ("arxiv:1", None, "1"), ("doi:10.2/y", "10.2/y", "1")]
    df = spark.createDataFrame([(k, d, None, a, None, None, None, None) for k, d, a in rows], "ref_key string, doi string, bibcode string, arxiv string, first_author string, year int, volume string, page string")
    assert {r.ref_key: r.work_key for r in citations.merge_works(df).collect()} == {"bib:2000ApJ...1.....1A": "bib:2000ApJ...1.....1A", "doi:10.1/x": "bib:2000ApJ...1.....1A", "arxiv:1": "arxiv:1", "doi:10.2/y": "arxiv:1"}


def test_visibility_hours():
    arc = schedule.half_arc(np.array([-26.82, 0.0, 30.0, -85.0]), -26.82, 45.0)
    assert 2 * arc[0] == pytest.approx(6.77, abs=0.01) and 2 * arc[1] == pytest.approx(5.01, abs=0.02) and arc[2] == -1
    c = schedule.cells(np.array([33.0]), np.array([-40.0]), "mid", 2042, 45.0)
    s = schedule.cells_by_step(np.array([33.0]), np.array([-40.0]), "mid", 2042, 45.0, "any")
    assert abs(c - s).max() < 0.6 and c.sum() == pytest.approx(s.sum(), rel=0.01)


def test_demand_is_conserved(spark):
    rows = [(1, 100.0, "low", "g", None, 10.0, -30.0, None, None), (2, 300.0, "low", "g", None, 10.0, -30.0, None, None), (3, 50.0, "low", None, None, 10.0, 60.0, None, None), (4, 20.0, "low", None, None, None, None, None, None), (5, 70.0, "low", None, 80.0, 10.0, -40.0, None, None), (6, 10.0, None, None, None, 1.0, 1.0, None, None), (7, 40.0, "low", None, None, None, None, -50.0, -10.0)]
    d = schedule.demand(spark.createDataFrame(rows, "id bigint, hours double, telescope string, commensal_group string, min_elevation double, ra_deg double, dec_deg double, dec_min double, dec_max double"), 2042)
    t = schedule.totals(d, schedule.supply(spark, 2042)).where("telescope = 'low'").first()
    assert t.placed_h == pytest.approx(300 + 70 + 40, abs=0.2) and t.never_h == 50 and t.unplaced_h == 20
    assert {r.id: r.state for r in d.select("id", "state").distinct().collect()} == {1: "placed", 2: "placed", 3: "never", 4: "unplaced", 5: "relaxed", 7: "placed"}
    assert t.supply_h == pytest.approx(8760 * 0.85 * 5, rel=1e-3)


def test_rank_fusion_and_bm25(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, id int, rank int")
    s = {r.id: round(r.score, 6) for r in retrieval.rrf(a, b).collect()}
    assert s == {10: round(1 / 61, 6), 11: round(1 / 62 + 0.5 / 61, 6), 12: round(0.5 / 62, 6)}
    docs = spark.createDataFrame([(1, "pulsar timing array"), (2, "pulsar pulsar"), (3, None), (4, "galaxy")], "id bigint, text string")
    top = retrieval.bm25_top(docs, spark.createDataFrame([(9, "timing")], "query_id bigint, text string"), 3).collect()
    assert [(r.id, r.score > 0) for r in sorted(top, key=lambda r: r["rank"])] == [(1, True), (2, False), (3, False)]


def test_rerank(spark):
    c = spark.createDataFrame([(1, 1, "a b", "a b c"), (1, 2, "a b", "x"), (1, 3, "a b", "a")], "query_id bigint, id bigint, query string, text string")
    assert [r.id for r in retrieval.rerank(c, retrieval.overlap_scorer, 2).orderBy("rank").collect()] == [1, 3]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=20))
def test_catalogue_keys_are_idempotent(pairs):
    assert citations.fold(citations.fold("Martínez-Henares")) == "martinezhenares"


def test_geometry_and_names(spark):
    df = spark.createDataFrame([("ngc 5128",), ("NGC 5128",), (None,)], "raw string")
    assert [r.k for r in df.select(catalogue.name_key(F.col("raw")).alias("k")).collect()] == ["NGC5128", "NGC5128", None]
