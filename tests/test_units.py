import numpy as np
import pytest
from pyspark.sql import functions as F

from almagest.functions.quantities import freq_intervals, quantities
from almagest.functions.quotes import stated_freq_mhz, stated_hours
from almagest.operators import unit_hmm

CASES = [
    ("We ask for 1,380 minutes on X at 1,649 MHz, with 10 MHz of bandwidth.", 1649, 23),
    ("Für X werden 2 Läufe zu je 3 Stunden Beobachtungszeit bei 203.1MHz benötigt (Bandbreite 0.3 GHz).", 203.1, 6),
    ("Il faut 1382.4 ks d'observation à une longueur d'onde de 4.23 m, avec des scans d'étalonnage de 20 min.", 70.872, 384),
    ("The 0.1 GHz wide band around 5.127 x 10^9 Hz gives 2.6 μJy/beam in 13 full days.", 5127, 312),
    ("four hours on X are requested, with 15 min scans of a calibrator and 75 MHz of bandwidth.", None, 4),
    ("Sensitivity of 0.5 K over 48 MHz requires 1 week; calibrator scans of 15 min are included, and λ = 21.2 mm is the central frequency.", 14141.2, 168),
    ("X will be followed for 21 days in all, revisited every 2 weeks, at an observing frequency of 9208 MHz in 97.6 kHz channels.", 9208, 504),
    ("We plan to observe X at 1 . 39 GHz; the time is set by the panel.", 1390, None),
    ("Imaging at 1.193e9 Hz and 18.2 arcsec resolution gives 0.57 K.", 1193, None),
    ("A total of two hundred hours (plus 5 min of overhead) is needed; the band centre is 14010MHz and the bandwidth 300 MHz.", 14010, 200),
    ("", None, None),
    (None, None, None),
]


def test_stated_values(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(CASES)], "i int, q string")
    for r in df.select("i", stated_freq_mhz(F.col("q")).alias("f"), stated_hours(F.col("q")).alias("h")).collect():
        for got, want in ((r.f, CASES[r.i][1]), (r.h, CASES[r.i][2])):
            assert got is None if want is None else got == pytest.approx(want, rel=1e-3), CASES[r.i]


def test_viterbi_follows_switches():
    truth = np.array([600.0, 700, 650, 620, 690, 640, 610, 655])
    raw = truth.copy()
    raw[2:4] /= 1e3
    raw[5] *= 1e3
    path, value = unit_hmm.decode(raw, np.full(8, np.nan), np.full(8, np.log10(650)), np.full(8, 0.15), unit_hmm.FREQ_STATES)
    assert value == pytest.approx(truth)
    assert [unit_hmm.FREQ_STATES[p][0] for p in path] == ["MHz", "MHz", "GHz", "GHz", "MHz", "kHz", "MHz", "MHz"]


def test_the_level_moves_along_the_rows():
    """A level that drifts by three decades, without quotes and with a prior
    far off: only its neighbours tell in which unit a value is."""
    rng = np.random.default_rng(3)
    truth = 10 ** (np.linspace(1.5, 4.5, 900) + rng.normal(0, 0.05, 900))
    in_ghz = rng.random(900) < 0.1
    raw = np.where(in_ghz, truth / 1e3, truth)
    stated = np.where(np.arange(900) % 20 == 0, truth, np.nan)
    path, value = unit_hmm.decode(raw, stated, np.full(900, 3.0), np.full(900, 0.9), unit_hmm.FREQ_STATES)
    assert (np.abs(value / truth - 1) < 1e-9).mean() > 0.98
    flat, _ = unit_hmm.smooth(np.full(900, np.nan), np.full(900, 3.0), np.full(900, 0.9))
    still = unit_hmm.viterbi(raw, flat, np.full(900, 0.9), np.full(900, np.nan), unit_hmm.FREQ_STATES)
    assert ((still == 1) == in_ghz).mean() < ((path == 1) == in_ghz).mean()


def test_a_value_that_no_unit_explains():
    raw, stated = np.array([700.0, 716.0, 710.0, 0.7]), np.array([700.0, 700.0, 700.0, 700.0])
    path, value = unit_hmm.decode(raw, stated, np.full(4, 2.8), np.full(4, 0.2), unit_hmm.FREQ_STATES)
    assert list(path) == [0, len(unit_hmm.FREQ_STATES), 0, 1] and value[1] == 716.0


def test_units_are_decoded_where_the_quote_is_hidden(spark):
    """Of the rows that state a value every fourth quote is hidden; the decoded
    value is compared with the stated one. Hours spread over more than the step
    from hours to minutes, so only their base unit is told apart."""
    r = spark.read.parquet("/root/testdata/sf0.1/requests.parquet")
    told = unit_hmm.common_units(r).toPandas()
    hidden = unit_hmm.common_units(r.withColumn("quote", F.when(F.expr("id % 4 = 1"), None).otherwise(F.col("quote")))).toPandas()
    m = told.merge(hidden[hidden["id"] % 4 == 1], on="id", suffixes=("", "_h"))
    for name, base, least in (("freq_mhz", "MHz", 0.75), ("hours", "h", 0.0)):
        x = m[m[f"{name}_stated"].notna() & (m[f"{name}_raw"] > 0)]
        right = (x[f"{name}_h"] - x[f"{name}_stated"]).abs() <= 0.02 * x[f"{name}_stated"]
        in_base = x[f"{name}_unit"] == base
        assert right[in_base].mean() >= 0.97 and right[~in_base].mean() >= least


REQ = "id bigint, telescope string, band string, freq_mhz double, hours double, quote string, level_hours double, q string"


def test_every_row_comes_out(spark):
    rows = [(1, "mid", "Band 1", 0.7, 480.0, "We ask for 8 h on X at 700 MHz, with 1 MHz of bandwidth.", 1.0, "x"), (2, None, None, None, float("nan"), None, None, None), (3, "mid", "Band 1", 700.0, 8.0, "We ask for 8 h on X at 700 MHz.", None, None), (3, "mid", "Band 1", 700.0, 8.0, "We ask for 8 h on X at 700 MHz.", None, None), (4, "mid", "Band 1", -5.0, 0.0, "", None, None), (None, "mid", "Band 1", 1.0, 1.0, "x" * 100000, None, None)]
    df = spark.createDataFrame(rows, REQ)
    u = unit_hmm.common_units(df)
    assert u.count() == len(rows)
    one = u.where("id = 1").first()
    assert (one.freq_mhz, one.hours, one.freq_mhz_unit, one.hours_unit) == (700.0, 8.0, "GHz", "min")
    assert sorted(map(tuple, unit_hmm.found(df).collect())) == [(1, "freq_mhz"), (1, "hours")]
    assert unit_hmm.found(spark.createDataFrame([], REQ)).count() == 0


@pytest.mark.parametrize("text,want", [("50 MHz to 15.4 GHz", [[0.05, 15.4]]), ("Bands 1 and 5a", [[0.35, 1.05], [4.6, 8.5]]), ("10 MHz bandwidth", None), ("350-1050 MHz", [[0.35, 1.05]]), ("21 cm", [[1.4286, 1.4286]]), (None, None)])
def test_freq_intervals(text, want):
    assert freq_intervals(text) == want


def test_quantities():
    got = [(x["value"], x["unit"]) for x in quantities("12.6 μJy/beam in 50 hours over 200 MHz, 1 . 3 arcsec, 2 x 10^3 deg2")]
    assert got == [(12.6, "uJy"), (50.0, "h"), (200.0, "MHz"), (1.3, "arcsec"), (2000.0, "deg2")]
    assert quantities(None) == [] and quantities("") == []
