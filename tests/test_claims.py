import json

import pytest
from pyspark.sql import functions as F

from almagest.operators import acronyms, setups, verify

CH = "source string, chunk_id bigint, chunk_index int, text string"


def chunks(spark, rows):
    return spark.createDataFrame([(s, i, i, t) for i, (s, t) in enumerate(rows)], CH)


def test_acronyms(spark):
    c = chunks(spark, [("a", "the Gamma-Ray Burst (GRB) and Dispersion Measure (DM)"), ("b", "gamma ray bursts (GRBs) near dark matter (DM). GRB GRBs"), ("c", "Cerenkov Telescope Array (CTA)"), ("d", "Cherenkov Telescope Array (CTA), nothing (here) or (X)"), ("e", "")])
    m = {r.sense: (r.n, r.n_sources) for r in acronyms.mine(c).collect()}
    assert m == {"GRB": (2, 2), "DM (Dispersion Measure)": (1, 1), "DM (dark matter)": (1, 1), "CTA": (2, 2)}
    n = {r.acronym: (r.n, r.n_sources) for r in acronyms.bare_mentions(c, acronyms.mine(c)).collect()}
    assert n["GRB"] == (4, 2) and n["DM"] == (2, 2)
    assert acronyms.lookup(acronyms.mine(c), "dm").count() == 2
    assert acronyms.mine(c.limit(0)).count() == 0
    q = spark.createDataFrame([("GRB rates and GRB",), ("none",)], "q string").select(acronyms.expanded(F.col("q"), {"GRB": "gamma ray burst"}).alias("x")).collect()
    assert [r.x for r in q] == ["GRB rates and GRB GRB gamma ray burst", "none"]


def test_numbers_and_verdicts(spark):
    c = chunks(spark, [("Smith", "12.6 uJy/beam in 50 hours"), ("Jones", "2.6 of 150"), ("Lee", "50 and 12.6 and 7")])
    claims = spark.createDataFrame([(1, "12.6 uJy/beam in 50 hours", "Smith"), (2, "7 times 12.6", "Smith"), (3, "999", "Smith"), (4, "50", None), (5, "words only", "Lee")], "claim_id int, text string, paper string")
    s = verify.number_claims(claims, c)
    v = {r.claim_id: r.verdict for r in verify.verdicts(claims, s).collect()}
    assert v == {1: "supported_by_claimed_paper", 2: "found_in_other_paper", 3: "not_found", 4: "found", 5: "not_found"}


def test_quotes(spark):
    c = chunks(spark, [("a", "The  Beam\nis wide."), ("a", "the beam is wide. again"), ("b", None)])
    q = spark.createDataFrame([(1, "a", "beam IS\twide"), (2, "b", "beam"), (3, "a", ""), (4, "zz", "x")], "quote_id int, source string, text string")
    assert {r.quote_id: r.chunk_index for r in verify.quotes_in_source(q, c).collect()} == {1: 0, 2: None, 3: None, 4: None}


def test_citations(spark):
    refs = spark.createDataFrame([("p", "condon", 1998), ("p", "condon", 2002), ("q", "blok", 2008)], "source string, first_author string, year int")
    cl = spark.createDataFrame([(1, "p", "condon", 1998), (2, "p", "condon", 1999), (3, "z", "condon", 1998)], "claim_id int, source string, first_author string, year int")
    got = {r.claim_id: (r.found, r.other_years, r.n_refs) for r in verify.citations_of(cl, refs).collect()}
    assert got == {1: (True, [2002], 2), 2: (False, [1998, 2002], 2), 3: (False, [], 0)}


def test_threshold(spark):
    s = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.1, False), (None, True)], "score double, truth boolean")
    r = verify.best_threshold(s).first()
    assert (r.threshold, r.precision, r.recall) == (0.6, 0.75, 1.0) and r.f1 == pytest.approx(6 / 7)
    assert verify.best_threshold(s.limit(0)).count() == 0


def test_setups(spark):
    doc = json.dumps({"subarrays": {"1": {"odpList": [{"type": "image", "settings": {"bw": "700e6", "n": "3", "mode": "x"}}]}}})
    p = setups.parameters(spark.createDataFrame([(1, doc), (2, "{bad"), (3, None)], "setup_id int, doc string"))
    assert p.count() == 3
    rules = spark.createDataFrame([("bw", "minmax", None, 0.0, 5e8, None), ("n", "minmax", None, 1.0, 9.0, 2.0), ("mode", "oneof", ["a", "b"], None, None, None)], "name string, kind string, allowed array<string>, lo double, hi double, step double")
    j = setups.judged(p, rules)
    assert {r.name: r.verdict for r in j.collect()} == {"bw": "above", "n": "ok", "mode": "not_allowed"}
    assert setups.rolled_up(j, ["setup_id"]).first().failing == ["bw", "mode"]
    req = spark.createDataFrame([("image", "bw"), ("image", "t_int")], "product string, name string")
    assert setups.missing_parameters(p, req).first().missing == ["t_int"]
    cl = spark.createDataFrame([(1, 10.0, "k"), (2, 0.0, "k"), (3, 1.0, "none")], "claim_id int, claimed double, key string")
    va = spark.createDataFrame([("k", "strict", 20.0), ("k", "robust", 10.5)], "key string, variant string, computed double")
    got = {r.claim_id: (r.variant, r.pct_diff, r.within_10pct) for r in setups.closest_variant(cl, va).collect()}
    assert got == {1: ("robust", 5.0, True), 2: (None, None, None), 3: (None, None, None)}
