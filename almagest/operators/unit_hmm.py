"""Quantities recorded in different units, brought to common ones.

The column of a quantity is read as the output of a hidden Markov model. Along
the rows of a device (telescope and band) a level moves smoothly; the hidden
state of a row is the unit in which its value was recorded, or "?" where no unit
explains it; the logarithm of the recorded value is the level of its row shifted
by the unit. Viterbi decodes the units from the jumps, the level is smoothed
again over the values so decoded, and both are repeated.

Where the request's quote states the quantity, that is evidence: the level of
its row is the stated value, and the recorded one may be off by no more than the
tolerance. Neighbouring rows learn their level from it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.functions.quotes import LIGHT_M_MHZ, stated_freq_mhz, stated_hours
from almagest.functions.textfold import with_fold
from almagest.operators.sky import finite
from almagest.session import cut

# Unit of a state, its scale, and whether the value is a wavelength.
FREQ_STATES = [("MHz", 1.0, False), ("GHz", 1e3, False), ("kHz", 1e-3, False), ("Hz", 1e-6, False), ("m", LIGHT_M_MHZ, True), ("cm", LIGHT_M_MHZ * 1e2, True), ("mm", LIGHT_M_MHZ * 1e3, True)]
HOUR_STATES = [("h", 1.0, False), ("min", 1 / 60, False), ("s", 1 / 3600, False), ("d", 24.0, False), ("ks", 1 / 3.6, False), ("week", 168.0, False)]
#: The state of a value that no unit explains; it is taken as it stands.
UNKNOWN = "?"
#: Ids to a block. A device's rows are decoded in blocks of ids, so no task holds a device whole.
BLOCK_IDS = 8192
#: Probability of the unit of the column (the first state), of no unit, and that the unit stays from row to row.
BASE, NONE, STAY = 0.85, 0.02, 0.3
#: A recorded value may be off by this share of the stated one.
TOLERANCE = 0.02
#: Rows on either side that the level is smoothed over, the weight of the device's level among them, the least spread, in
#: decades, of values about the level, and the decades that values of no unit are spread over.
SMOOTH, PRIOR, SD_LEAST, DECADES = 32, 1.0, 0.15, 12.0
ROUNDS = 3


def to_base(value: np.ndarray, scale: float, wave: bool) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return scale / value if wave else value * scale


def viterbi(raw: np.ndarray, level: np.ndarray, sd: np.ndarray, stated: np.ndarray, states: list) -> np.ndarray:
    """The most probable states of a sequence; the last state, beyond the
    units, is that of no unit. Rows without a positive value say nothing.
    `level` is log10 of the quantity in base units, `sd` its spread; where
    `stated` is a number, values within TOLERANCE of it are equally probable
    and others not at all."""
    n, k = len(raw), len(states) + 1
    start = np.log(np.array([BASE] + [(1 - BASE - NONE) / (k - 2)] * (k - 2) + [NONE]))
    move = np.log(STAY * np.eye(k) + (1 - STAY) * np.exp(start)[None, :])
    e = np.zeros((n, k))
    ok, known = np.isfinite(raw) & (raw > 0), np.isfinite(stated)
    for j, (_, scale, wave) in enumerate(states):
        base = to_base(np.where(ok, raw, 1.0), scale, wave)
        z = (np.log10(base) - level) / sd
        near = np.abs(base - np.where(known, stated, 1.0)) <= TOLERANCE * np.where(known, stated, 1.0)
        by_quote = np.where(near, -np.log(2 * np.log10(1 + TOLERANCE)), -40.0)
        e[:, j] = np.where(ok, np.where(known, by_quote, -0.5 * z * z - np.log(sd * np.sqrt(2 * np.pi))), 0.0)
    e[:, -1] = np.where(ok, -np.log(DECADES), 0.0)
    best, back = start + e[0], np.zeros((n, k), dtype=np.int16)
    for i in range(1, n):
        m = best[:, None] + move
        back[i] = m.argmax(0)
        best = m[back[i], np.arange(k)] + e[i]
    path = np.empty(n, dtype=np.int16)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def smooth(z: np.ndarray, prior: np.ndarray, prior_sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, spread) along the rows: the mean of the values about each row,
    the nearer the heavier, with the device's level (prior) among them; rows of
    no value (NaN) are passed over."""
    kernel = np.hanning(2 * SMOOTH + 3)[1:-1]
    around = lambda x: np.convolve(x, kernel)[SMOOTH : SMOOTH + len(x)]
    has = np.isfinite(z)
    w = around(has.astype(float)) + PRIOR
    level = (around(np.where(has, z, 0.0)) + PRIOR * prior) / w
    square = (around(np.where(has, z * z, 0.0)) + PRIOR * (prior * prior + prior_sd * prior_sd)) / w
    return level, np.sqrt(np.maximum(square - level * level, SD_LEAST**2))


def decode(raw: np.ndarray, stated: np.ndarray, prior: np.ndarray, prior_sd: np.ndarray, states: list) -> tuple[np.ndarray, np.ndarray]:
    """(path, value in the base unit) of a sequence of recorded values; a value
    of no unit stays as it is, a missing one is NaN."""
    known, ok = np.isfinite(stated), np.isfinite(raw) & (raw > 0)
    z = np.where(known, np.log10(np.where(known, stated, 1.0)), np.nan)
    for _ in range(ROUNDS):
        level, sd = smooth(z, prior, prior_sd)
        path = viterbi(raw, level, sd, stated, states)
        value = np.where(ok & (path == len(states)), raw, np.nan)
        for j, (_, scale, wave) in enumerate(states):
            at = ok & (path == j)
            value[at] = to_base(raw[at], scale, wave)
        unit = ok & (path < len(states))
        z = np.where(known, np.log10(np.where(known, stated, 1.0)), np.where(unit, np.log10(np.where(unit, value, 1.0)), np.nan))
    return path, value


def _decode(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "freq_mhz", "hours"], kind="stable")
    out = {"id": pdf["id"]}
    for name, states in (("freq_mhz", FREQ_STATES), ("hours", HOUR_STATES)):
        raw, stated = pdf[name].to_numpy(float), pdf[f"stated_{name}"].to_numpy(float)
        stated = np.where(np.isfinite(stated) & (stated > 0), stated, np.nan)
        prior = np.nan_to_num(pdf[f"level_{name}"].to_numpy(float))
        spread = np.maximum(SD_LEAST, np.nan_to_num(pdf[f"spread_{name}"].to_numpy(float), nan=1.0))
        path, value = decode(raw, stated, prior, spread, states)
        names = [u for u, _, _ in states] + [UNKNOWN]
        out[f"{name}_raw"], out[f"{name}_stated"] = raw, stated
        out[f"{name}_unit"] = [names[p] if o else None for p, o in zip(path, np.isfinite(raw) & (raw > 0))]
        out[name] = np.where(np.isfinite(stated), stated, value)
    return pd.DataFrame(out)


SCHEMA = "id bigint, freq_mhz_raw double, freq_mhz_stated double, freq_mhz_unit string, freq_mhz double, hours_raw double, hours_stated double, hours_unit string, hours double"


def common_units(requests: DataFrame) -> DataFrame:
    """Each request with its frequency in MHz and its time in hours.

    Columns: id; for freq_mhz and hours the recorded value (_raw), what the
    quote states (_stated), the decoded unit of the recorded value (_unit, "?"
    where no unit explains it) and the value in the common unit: as stated,
    else as decoded, else null. NaN, infinite, zero and negative recorded values
    count as missing for decoding; a null quote states nothing. Repeated ids
    come out once per row.
    """
    r = requests.select("id", F.concat_ws("|", F.coalesce("telescope", F.lit("")), F.coalesce("band", F.lit(""))).alias("device"), finite(F.col("freq_mhz")).alias("freq_mhz"), finite(F.col("hours")).alias("hours"), "quote")
    r = with_fold(r, "quote", "q").drop("quote")
    # read from the shared folder by the levels and by the decoding: quotes are searched once
    r = cut(r.withColumns({"stated_freq_mhz": stated_freq_mhz(F.col("q")), "stated_hours": stated_hours(F.col("q"))}).drop("q"))
    logs = {n: F.when(F.col(f"stated_{n}") > 0, F.log10(F.col(f"stated_{n}"))) for n in ("freq_mhz", "hours")}
    levels = r.groupBy("device").agg(*[x for n, c in logs.items() for x in (F.percentile_approx(c, 0.5, 1000).alias(f"dev_level_{n}"), F.stddev(c).alias(f"dev_spread_{n}"))])
    whole = r.agg(*[x for n, c in logs.items() for x in (F.percentile_approx(c, 0.5, 1000).alias(f"all_level_{n}"), F.stddev(c).alias(f"all_spread_{n}"))])
    lv = levels.crossJoin(F.broadcast(whole)).select(  # one row
        "device",
        *[F.coalesce(f"dev_{x}_{n}", f"all_{x}_{n}").alias(f"{x}_{n}") for n in ("freq_mhz", "hours") for x in ("level", "spread")],
    )
    r = r.join(lv, "device").withColumn("block", F.floor(F.coalesce("id", F.lit(0)) / BLOCK_IDS))
    return r.groupBy("device", "block").applyInPandas(_decode, SCHEMA)


def found(requests: DataFrame) -> DataFrame:
    """(request_id, quantity) where the quote states a value that the column
    lacks or misses by more than TOLERANCE of it: rows whose recorded value was
    not decoded as one in the column's own unit, checked against the quote."""
    u = common_units(requests)
    parts = []
    for n, states in (("freq_mhz", FREQ_STATES), ("hours", HOUR_STATES)):
        odd = u.where(F.col(f"{n}_unit").isNull() | (F.col(f"{n}_unit") != states[0][0]))
        stated, raw = (F.nanvl(f"{n}_{c}", F.lit(None).cast("double")) for c in ("stated", "raw"))
        parts.append(odd.where(stated.isNotNull() & (raw.isNull() | (F.abs(raw - stated) > TOLERANCE * stated))).select(F.col("id").alias("request_id"), F.lit(n).alias("quantity")))
    return parts[0].unionByName(parts[1])
