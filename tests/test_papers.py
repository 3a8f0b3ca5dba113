"""Operators over papers, requests and quotes on small tables of their own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almagest.operators import beams, catalogue, coverage, papers, requirements, schedule, setups, sky
from almagest.operators.quantiles import quantiles

CHUNK = "source string, chunk_index int, chunk_id bigint, heading string, text string, doc_source string, section_path string"


def chunks(spark, rows):
    return spark.createDataFrame([(s, k, i, h, t, b, p) for i, (s, k, h, t, b, p) in enumerate(rows)], CHUNK)


def test_names_resolve_to_stems_then_titles(spark):
    t = spark.createDataFrame([("x/b/S/Ark01.pdf", "Deep fields of the sky"), ("x/c/S/Ark01.pdf", "Other"), ("x/b/S/Bel02.pdf", "The HI sky"), ("x/b/S/Cyg.pdf", None)], "source string, title string")
    names = spark.createDataFrame([("ark01",), ("ark01.pdf",), ("fields of",), ("HI",), ("sky",), ("no such",), ("",), (None,), ("sky",)], "name string")
    got = {(r.name, r.source[2:-4]) for r in papers.resolved(names, t).collect()}
    assert got == {(n, s) for n in ("ark01", "ark01.pdf") for s in ("b/S/Ark01", "c/S/Ark01")} | {("fields of", "b/S/Ark01"), ("HI", "b/S/Bel02"), ("sky", "b/S/Ark01"), ("sky", "b/S/Bel02")}
    assert papers.resolved(names.limit(0), t).count() == 0 and papers.resolved(names, t.limit(0)).count() == 0


def test_filters_and_their_errors(spark):
    c = chunks(spark, [("x/b/Magnetism/P.pdf", 0, "", "", "b", ""), ("x/b/Other/Q.pdf", 0, "", "", "b", ""), ("x/c/Magnetism/R.pdf", 0, "", "", "c", "")])
    assert [r.source for r in papers.selected(c, "b", "magnetism").collect()] == ["x/b/Magnetism/P.pdf"]
    assert papers.selected(c, sources=c.where("doc_source = 'c'").select("source")).count() == 1 and papers.selected(c).count() == 3
    with pytest.raises(ValueError, match="No indexed chunks"):
        papers.selected(c, "b", "Magnetisn")
    assert papers.selected(c, "b", "Magnetisn", strict=False).count() == 0


def test_sections_and_glossary(spark):
    c = chunks(spark, [("p", 0, "h", "FRB: fast radio burst\nnoise\nFRB - something else\n A lower case line", "b", "1 Intro"), ("p", 1, "h", None, "b", ""), ("p", 2, "h", "VLBI very long baselines", "b", None), ("p", 3, "h", "", "b", "2 Data"), ("q", 0, "h", "FRB: later one", "b", None)])
    assert {r.chunk_id: r.value for r in papers.carried_forward(c, "section_path").collect()} == {0: "1 Intro", 1: "1 Intro", 2: "1 Intro", 3: "2 Data", 4: None}
    g = papers.glossary(c)
    assert {r.acronym: r.expansion for r in g.collect()} == {"FRB": "fast radio burst", "VLBI": "very long baselines"}
    known = {r.acronym: r.expansion for r in papers.known_acronyms(g, {"FRB": "seed", "SKY": "seed sky"}, {"VLBI": "curated"}).collect()}
    assert known == {"FRB": "fast radio burst", "SKY": "seed sky", "VLBI": "curated"}
    d = spark.createDataFrame([("Very Large Arrays",), ("Field-Programmable Gate Array",), ("dark matter",), (None,)], "e string")
    assert [r.c for r in d.select(papers.category(F.col("e")).alias("c")).collect()] == ["Telescopes & Instruments", "Telescopes & Instruments", papers.OTHER_CATEGORY, papers.OTHER_CATEGORY]


def test_facility_network(spark):
    m = spark.createDataFrame([("A", "p", 2), ("B", "p", 1), ("A", "q", 5)], "term string, source string, mentions bigint")
    got = {(r.kind, r.a, r.b): (r.n_papers, r.mentions) for r in papers.facility_network(m, ["A", "B", "C"]).collect()}
    assert got == {("node", "A", None): (2, 7), ("node", "B", None): (1, 1), ("node", "C", None): (0, 0), ("edge", "A", "B"): (1, 1)}
    assert coverage.guards_of(["planck", "x"], {"Planck": ["a"]}, ["b"]) == ["a", "b"] and coverage.guards_of(["Planck"], {"Planck": ["a"]}, use_curated=False) == []


def test_requirement_drafts():
    got = {r["field"]: (r["number"], r["unit"], r["word"]) for r in requirements.draft("Samples every 13.4 kHz at 1.4 GHz in Band 2 with a bandwidth of 300 MHz, and 1.1 μJy/beam at 5 sigma in 50 hours, over 20 deg2 with a field of view of 1 deg2, robust = -0.5, beam of 1.5 arcsec")}
    assert got["frequency"] == (1.4, "GHz", None) and got["bandwidth"] == (300, "MHz", None) and got["channel_width"] == (13.4, "kHz", None) and got["sensitivity"] == (1.1, "uJy/beam", None)
    assert got["hours"] == (50, "h", None) and got["area"] == (20, "deg2", None) and got["fov"] == (1, "deg2", None) and got["angular_resolution"] == (1.5, "arcsec", None) and got["sigma_level"] == (5, "sigma", None)
    assert got["band"] == (None, None, "Band 2") and got["weighting"] == (None, None, "robust -0.5")
    assert requirements.draft(None) == [] and requirements.draft("") == [] and requirements.draft("x" * 50000) == []
    assert requirements.states("at 1400 MHz", 1.4, "GHz") and not requirements.states("at 1300 MHz", 1.4, "GHz") and not requirements.states(None, 1.4, "GHz") and not requirements.states("1 h", None, "h")


def test_checked_and_converted(spark):
    r = spark.createDataFrame([(1, "in 5 hours", 5.0, None), (2, None, 7.0, float("nan")), (3, "at 1.2 GHz", None, 1200.0)], "id int, quote string, hours double, freq_mhz double")
    got = {(x.id, x.field): x.verdict for x in requirements.checked(r, {"hours": "h", "freq_mhz": "MHz"}).collect()}
    assert got == {(1, "hours"): "stated", (2, "hours"): "inferred", (3, "hours"): None, (1, "freq_mhz"): None, (2, "freq_mhz"): None, (3, "freq_mhz"): "stated"}
    d = spark.createDataFrame([(1.4, "GHz"), (2.0, "uJy/beam"), (None, "MHz")], "v double, u string").select(requirements.converted(F.col("v"), F.col("u"), "MHz").alias("x"))
    assert [x.x for x in d.collect()] == [1400.0, None, None]


def test_exact_quantiles(spark):
    rnd = random.Random(2)
    rows = [("hot", round(rnd.gauss(50, 20), 2)) for _ in range(2000)] + [("one", 7.0), ("two", 1.0), ("two", 4.0), ("none", None), ("none", float("nan"))] + [("same", 3.0)] * 50
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"a": 0.1, "m": 0.5, "z": 1.0}, 10.0).collect()}
    for g in ("hot", "one", "two", "same"):
        v = [x for k, x in rows if k == g]
        assert [got[g].a, got[g].m, got[g].z] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 1.0])))
    assert set(got) == {"hot", "one", "two", "same"}
    assert quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", {"m": 0.5}, 1.0).count() == 0


def test_intervals_positions_and_names(spark):
    i = spark.createDataFrame([("k", 0, 5), ("k", 3, 4), ("k", 5, 7), ("k", 9, 9), ("l", 1, 2), ("k", 0, 2)], "k string, lo int, hi int")
    assert {tuple(r) for r in catalogue.interval_union(i, "k").select("k", "lo", "hi").collect()} == {("k", 0, 7), ("k", 9, 9), ("l", 1, 2)}
    req = spark.createDataFrame([(1, 10.0, 1.0, None, None), (2, None, None, 5, "My field"), (3, None, 2.0, 5, "nope"), (4, None, None, None, None)], "id int, ra_deg double, dec_deg double, source_id bigint, field string")
    fields = spark.createDataFrame([("MYFIELD", "my-field", 20.0, 2.0, "t", "p"), ("Z", None, 1.0, 1.0, "t", "p")], "field_key string, name string, ra_deg double, dec_deg double, created_at string, paper string")
    src = spark.createDataFrame([(5, 30.0, 3.0)], "id bigint, ra_deg double, dec_deg double")
    assert {r.id: (r.origin, r.ra) for r in catalogue.request_positions(req, fields, src).collect()} == {1: ("own", 10.0), 2: ("field", 20.0), 3: ("source", 30.0), 4: (None, None)}
    d = spark.createDataFrame([("HLX J101114.1-261133",), ("KRV 12",), (None,)], "n string")
    ra, dec = sky.coordinates_in_name(F.col("n"))
    x = d.select(ra.alias("ra"), dec.alias("dec")).collect()
    assert (x[0].ra, x[0].dec) == (pytest.approx(15 * (10 + 11 / 60 + 14.1 / 3600)), pytest.approx(-(26 + 11 / 60 + 33 / 3600))) and x[1].ra is None and x[2].dec is None


def test_sweeps_interpolation_and_beams(spark):
    g = setups.sweep(spark, {"a": [1, 2], "b": [3.0, 4.0, 5.0]})
    assert g.count() == 6 and g.distinct().count() == 6
    d = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 9.0)], "x double").select(setups.interpolated(F.col("x"), [(1.0, 10.0), (2.0, 20.0), (4.0, 0.0)]).alias("y"))
    assert [r.y for r in d.collect()] == [10.0, 10.0, 15.0, 0.0]
    a, b = beams.phase_loss(spark, 400, 32, 0.2).first(), beams.phase_loss(spark, 400, 32, 0.2).first()
    assert a == b and a.p10 < a.p50 < a.p90 and a.p50 == pytest.approx(1 - np.exp(-0.04), abs=0.01)
    assert [r.t for r in spark.createDataFrame([(5.5,), (23.999,), (0.0,)], "h double").select(schedule.format_lst(F.col("h")).alias("t")).collect()] == ["05h30m", "00h00m", "00h00m"]
    c = spark.createDataFrame([(1, 38.0), (2, 0.0), (3, None)], "claim_id int, claimed double")
    assert [(r.claim_id, r.variant, r.within_10pct) for r in setups.closest_of(c, [("x", 40.0), ("y", 90.0)]).collect()] == [(1, "x", True)]
