"""Observing time over a year: when targets are up, and how requested hours
press on sidereal time.

A site's year is a grid of 10-minute steps with sidereal time and the Sun's
place from the usual low-precision formulas. Where a target is above a limit is
an interval of sidereal time, so its hours per month and sidereal hour come
from cumulative counts of the grid, without looking at each step. Only
constraints on the Sun need the steps themselves.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.session import spread_of

# Latitude and longitude of the two sites in degrees, their lowest elevations, and planning assumptions.
SITES = {"low": (-26.82, 116.76), "mid": (-30.72, 21.44)}
LOWEST = {"low": 20.0, "mid": 15.0}
STEP_H, ELEVATION, MAINTENANCE, YEARS = 1 / 6, 45.0, 0.15, 5.0
#: Places of the cumulative counts on a sidereal day.
FINE = 1440


@functools.lru_cache(maxsize=8)
def grid(telescope: str, year: int) -> dict[str, np.ndarray]:
    """365 days in steps: sidereal time in hours, month from 0, and the Sun's
    right ascension, declination and altitude in degrees."""
    lat, lon = SITES[telescope]
    start = np.datetime64(f"{year}-01-01T00:00:00")
    t = start + np.arange(0, 365 * 24 * 60, 10).astype("timedelta64[m]")
    d = (t - np.datetime64("2000-01-01T12:00:00")) / np.timedelta64(1, "D")
    lst = ((280.46061837 + 360.98564736629 * d + lon) % 360) / 15
    g, q = np.radians((357.529 + 0.98560028 * d) % 360), (280.459 + 0.98564736 * d) % 360
    along = np.radians(q + 1.915 * np.sin(g) + 0.020 * np.sin(2 * g))
    tilt = np.radians(23.439 - 0.00000036 * d)
    ra, dec = np.arctan2(np.cos(tilt) * np.sin(along), np.cos(along)), np.arcsin(np.sin(tilt) * np.sin(along))
    ha = np.radians(lst * 15) - ra
    alt = np.arcsin(np.sin(np.radians(lat)) * np.sin(dec) + np.cos(np.radians(lat)) * np.cos(dec) * np.cos(ha))
    month = t.astype("datetime64[M]").astype(int) % 12
    return {"lst": lst, "month": month, "sun_ra": np.degrees(ra) % 360, "sun_dec": np.degrees(dec), "sun_alt": np.degrees(alt)}


@functools.lru_cache(maxsize=8)
def _density(telescope: str, year: int) -> np.ndarray:
    """Hours of each month at each of FINE places of the sidereal day, by hour."""
    g = grid(telescope, year)
    n = np.zeros((12, FINE))
    np.add.at(n, (g["month"], np.minimum((g["lst"] / 24 * FINE).astype(int), FINE - 1)), STEP_H)
    return n.reshape(12, 24, FINE // 24)


def half_arc(dec: np.ndarray, lat: float, elevation: float) -> np.ndarray:
    """Hours before and after transit that a declination is above an
    elevation: 12 for always, -1 for never."""
    d, p, e = np.radians(dec), np.radians(lat), np.radians(elevation)
    den = np.cos(p) * np.cos(d)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(np.abs(den) < 1e-12, np.where(np.sin(p) * np.sin(d) >= np.sin(e), -2.0, 2.0), (np.sin(e) - np.sin(p) * np.sin(d)) / den)
    return np.where(c <= -1, 12.0, np.where(c > 1, -1.0, np.degrees(np.arccos(np.clip(c, -1, 1))) / 15))


def coverage(owner: np.ndarray, n: int, ra: np.ndarray, arc: np.ndarray) -> np.ndarray:
    """How many arcs, of half the given hours about their right ascension,
    cover each of FINE places of the sidereal day, for each of n owners: ends
    are added where they fall, in parts, and summed up along the day."""
    steps = np.zeros((n, FINE + 2))
    some = arc >= 0
    owner, ra, arc = owner[some], ra[some] / 15, arc[some]
    first = np.where(arc >= 12, 0.0, (ra - arc) % 24)
    last = np.where(arc >= 12, 24.0, first + 2 * arc)

    def end(at: np.ndarray, of: np.ndarray, sign: float) -> None:
        x = np.clip(at, 0, 24) / 24 * FINE
        k = np.floor(x).astype(int)
        np.add.at(steps, (of, k), sign * (1 - (x - k)))
        np.add.at(steps, (of, k + 1), sign * (x - k))

    end(first, owner, 1.0)
    end(last, owner, -1.0)
    over = last > 24  # an arc across the day's end goes on at its start
    end(np.zeros(over.sum()), owner[over], 1.0)
    end(last[over] - 24, owner[over], -1.0)
    return np.cumsum(steps, axis=1)[:, :FINE]


def cells_of(owner: np.ndarray, n: int, ra: np.ndarray, dec: np.ndarray, telescope: str, year: int, elevation: np.ndarray) -> np.ndarray:
    """Hours above the elevation per owner, month and sidereal hour, the mean
    over the owner's positions, those never up included."""
    cover = coverage(owner, n, ra, half_arc(dec, SITES[telescope][0], elevation)).reshape(n, 24, FINE // 24)
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.einsum("mbk,nbk->nmb", _density(telescope, year), cover, optimize=True) / count[:, None, None]


def cells(ra: np.ndarray, dec: np.ndarray, telescope: str, year: int, elevation: float) -> np.ndarray:
    """cells_of() one owner."""
    return cells_of(np.zeros(len(ra), int), 1, ra, dec, telescope, year, np.full(len(ra), elevation))[0]


def cells_by_step(ra: np.ndarray, dec: np.ndarray, telescope: str, year: int, elevation: float, sun: str) -> np.ndarray:
    """The same over the steps themselves, when the Sun must be down ("night")
    or far below ("avoid_twilight")."""
    g, lat = grid(telescope, year), np.radians(SITES[telescope][0])
    dark = {"night": g["sun_alt"] < 0, "avoid_twilight": g["sun_alt"] < -12}.get(sun, np.ones(len(g["lst"]), bool))
    out = np.zeros((12, 24))
    for r, d in zip(np.radians(ra), np.radians(dec)):
        alt = np.sin(lat) * np.sin(d) + np.cos(lat) * np.cos(d) * np.cos(np.radians(g["lst"] * 15) - r)
        ok = dark & (alt >= np.sin(np.radians(elevation)))
        np.add.at(out, (g["month"][ok], np.floor(g["lst"][ok]).astype(int) % 24), STEP_H)
    return out / max(len(ra), 1)


def galactic_to_icrs(l: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right ascension and declination of galactic coordinates, in degrees."""
    # The rotation from galactic to equatorial axes (J2000).
    m = np.array([[-0.0548755604, 0.4941094279, -0.8676661490], [-0.8734370902, -0.4448296300, -0.1980763734], [-0.4838350155, 0.7469822445, 0.4559837762]])
    l, b = np.radians(l), np.radians(b)
    x = m @ np.stack([np.cos(b) * np.cos(l), np.cos(b) * np.sin(l), np.sin(b)])
    return np.degrees(np.arctan2(x[1], x[0])) % 360, np.degrees(np.arcsin(np.clip(x[2], -1, 1)))


def assumed_band(area: float, lat: float) -> tuple[float, float]:
    """The declination band around the zenith that has an area in square degrees."""
    want = min(area, 41252.96) * np.radians(1) ** 2 / (2 * np.pi)
    lo, hi = 0.0, 180.0
    span = lambda h: (max(-90.0, lat - h), min(90.0, lat + h))
    for _ in range(60):
        mid = (lo + hi) / 2
        a, b = np.radians(span(mid))
        lo, hi = (mid, hi) if np.sin(b) - np.sin(a) < want else (lo, mid)
    return span(hi)


def positions(row, lat: float) -> tuple[np.ndarray, np.ndarray]:
    """Right ascensions and declinations that stand for a request: a grid over
    its box, band, galactic box or assumed band, else its point; none without."""
    has = lambda *cs: all(pd.notna(getattr(row, c)) for c in cs)
    if has("gal_b_min", "gal_b_max"):
        l0, l1 = (row.gal_l_min, row.gal_l_max) if has("gal_l_min", "gal_l_max") else (0.0, 360.0)
        span = (l1 - l0) % 360 or 360.0
        l = (l0 + span * (np.arange(36) + 0.5) / 36) % 360
        return galactic_to_icrs(np.repeat(l, 5), np.tile(np.linspace(row.gal_b_min, row.gal_b_max, 5), 36))
    band = (row.dec_min, row.dec_max) if has("dec_min", "dec_max") else assumed_band(row.area_deg2, lat) if has("area_deg2") else None
    if band:
        r0, r1 = (row.ra_min, row.ra_max) if has("ra_min", "ra_max") else (0.0, 360.0)
        span = (r1 - r0) % 360 or 360.0
        ra = (r0 + span * (np.arange(24) + 0.5) / 24) % 360
        return np.repeat(ra, 5), np.tile(np.clip(np.linspace(*band, 5), -90, 90), 24)
    if has("ra_deg", "dec_deg"):
        return np.array([row.ra_deg % 360]), np.array([float(row.dec_deg)])
    return np.zeros(0), np.zeros(0)


_INPUT = ["id", "hours", "telescope", "commensal_group", "min_elevation", "sun", "ra_deg", "dec_deg", "ra_min", "ra_max", "dec_min", "dec_max", "gal_l_min", "gal_l_max", "gal_b_min", "gal_b_max", "area_deg2"]


def demand(requests: DataFrame, year: int, elevation: float = ELEVATION, with_sun: bool = False) -> DataFrame:
    """(id, telescope, grp, month, lst_bin, hours, state): each request's
    hours spread over the cells in which it is up, in proportion to how long.

    A request that never reaches its limit but clears the site's lowest
    elevation is placed there (state relaxed); one that does not is "never",
    one without a position "unplaced", each with all its hours in one row of
    null month and bin. Requests of no known telescope, or without positive
    hours, are left out. grp is the commensal group, or the request itself.
    """
    cols = [F.col(c) if c in requests.columns else F.lit(None).cast("double").alias(c) for c in _INPUT]
    r = requests.select(*cols).where(F.col("telescope").isin(*SITES) & (F.col("hours") > 0) & ~F.isnan("hours"))

    if n := spread_of(requests.sparkSession):
        r = r.repartition(n)

    def place(pdf: pd.DataFrame, telescope: str) -> pd.DataFrame:
        """The rows of one telescope of a batch."""
        lat, low, n = SITES[telescope][0], LOWEST[telescope], len(pdf)
        where = [positions(row, lat) for row in pdf.itertuples(index=False)]
        owner = np.repeat(np.arange(n), [len(x) for x, _ in where])
        ra, dec = (np.concatenate([x[k] for x in where]) for k in (0, 1))
        limit = pdf["min_elevation"].fillna(elevation).to_numpy(float)
        sun = [x if with_sun and isinstance(x, str) else "any" for x in pdf["sun"]]

        def avail(which: np.ndarray, least: np.ndarray) -> np.ndarray:
            """Cells of the requests `which`, by their Sun constraint."""
            plain = which & np.array([x == "any" for x in sun], dtype=bool)
            keep = plain[owner]
            out = cells_of(owner[keep], n, ra[keep], dec[keep], telescope, year, least[owner[keep]])
            for k in np.flatnonzero(which & ~plain):
                out[k] = cells_by_step(ra[owner == k], dec[owner == k], telescope, year, least[k], sun[k])
            return out

        has = np.bincount(owner, minlength=n) > 0
        a = avail(has, limit)
        state = np.where(has, "placed", "unplaced").astype(object)
        none = has & (a.sum((1, 2)) == 0)
        if none.any():
            again = avail(none & (limit > low), np.full(n, low))
            a[none] = again[none]
            state[none] = np.where(a[none].sum((1, 2)) > 0, "relaxed", "never")
        total, hours = a.sum((1, 2)), pdf["hours"].to_numpy(float)
        k, m, b = np.nonzero(a)
        rest = np.flatnonzero(total == 0)
        at = np.concatenate([k, rest])
        grp = [g if isinstance(g, str) and g else f"#{i}" for g, i in zip(pdf["commensal_group"], pdf["id"])]
        return pd.DataFrame(
            {
                "id": pdf["id"].to_numpy()[at], "telescope": telescope, "grp": np.array(grp, dtype=object)[at],
                "month": pd.array([*(m + 1), *[None] * len(rest)], dtype="Int32"), "lst_bin": pd.array([*b, *[None] * len(rest)], dtype="Int32"),
                "hours": np.concatenate([hours[k] * a[k, m, b] / np.where(total > 0, total, 1)[k], hours[rest]]), "state": state[at],
            }
        )

    def spread(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                for telescope, part in pdf.iloc[i : i + 256].groupby("telescope"):
                    yield place(part.reset_index(drop=True), telescope)

    return r.mapInPandas(spread, "id bigint, telescope string, grp string, month int, lst_bin int, hours double, state string")


def supply(spark, year: int, years: float = YEARS) -> DataFrame:
    """(telescope, month, lst_bin, supply): clock hours less maintenance; 576 rows."""
    rows = [(t, m + 1, b, float(c[m, b]) * (1 - MAINTENANCE) * years) for t in SITES for c in [_density(t, year).sum(axis=2)] for m in range(12) for b in range(24)]
    return spark.createDataFrame(rows, "telescope string, month int, lst_bin int, supply double")


def pressure(d: DataFrame, s: DataFrame) -> DataFrame:
    """(telescope, lst_bin, demand_h, supply_h, pressure). Commensal requests
    share time: of a group each cell counts its largest member only."""
    per = d.where("month is not null").groupBy("telescope", "grp", "month", "lst_bin").agg(F.max("hours").alias("h"))
    per = per.groupBy("telescope", "lst_bin").agg(F.sum("h").alias("demand_h"))
    total = s.groupBy("telescope", "lst_bin").agg(F.sum("supply").alias("supply_h"))
    return total.join(per, ["telescope", "lst_bin"], "left").select("telescope", "lst_bin", F.round(F.coalesce("demand_h", F.lit(0.0)), 1).alias("demand_h"), F.round("supply_h", 1).alias("supply_h"), F.round(F.coalesce("demand_h", F.lit(0.0)) / F.col("supply_h"), 3).alias("pressure"))


def totals(d: DataFrame, s: DataFrame) -> DataFrame:
    """(telescope, placed_h, all_h, never_h, unplaced_h, supply_h, ratio,
    total_ratio) of each telescope with requests."""
    cell = d.where("month is not null").groupBy("telescope", "grp", "month", "lst_bin").agg(F.max("hours").alias("h")).groupBy("telescope").agg(F.sum("h").alias("placed_h"))
    never = d.where("state = 'never'").groupBy("telescope").agg(F.sum("hours").alias("never_h"))
    un = d.where("state = 'unplaced'").groupBy("telescope", "grp").agg(F.max("hours").alias("h")).groupBy("telescope").agg(F.sum("h").alias("unplaced_h"))
    out = s.groupBy("telescope").agg(F.sum("supply").alias("supply_h"))
    for x in (cell, never, un):
        out = out.join(x, "telescope", "left")
    out = out.fillna(0.0).withColumn("all_h", F.col("placed_h") + F.col("never_h") + F.col("unplaced_h"))
    r = lambda c, k=1: F.round(c, k).alias(c)
    return out.select("telescope", r("placed_h"), r("all_h"), r("never_h"), r("unplaced_h"), r("supply_h"), F.round(F.col("placed_h") / F.col("supply_h"), 3).alias("ratio"), F.round(F.col("all_h") / F.col("supply_h"), 3).alias("total_ratio"))


def visibility(spark, targets: list[tuple[str, float, float]], telescope: str, year: int, elevation: float = ELEVATION) -> DataFrame:
    """(name, max_elevation, hours_per_day, month, hours) of the given targets."""
    rows = []
    for name, ra, dec in targets:
        c = cells(np.array([ra % 360.0]), np.array([dec]), telescope, year, elevation)
        lat = SITES[telescope][0]
        rows += [(name, 90 - abs(dec - lat), float(max(0.0, 2 * half_arc(np.array([dec]), lat, elevation)[0])), m + 1, float(c[m].sum())) for m in range(12)]
    return spark.createDataFrame(rows, "name string, max_elevation double, hours_per_day double, month int, hours double")


def by_group(d: DataFrame) -> DataFrame:
    """(telescope, grp, lst_bin, demand_h): the hours that each commensal group,
    or lone request, asks of a sidereal hour; of a group each cell counts its
    largest member only, so the groups add up to pressure()."""
    per = d.where("month is not null").groupBy("telescope", "grp", "month", "lst_bin").agg(F.max("hours").alias("h"))
    return per.groupBy("telescope", "grp", "lst_bin").agg(F.round(F.sum("h"), 3).alias("demand_h"))


def most_pressed(p: DataFrame, n: int) -> DataFrame:
    """(telescope, rank, lst, pressure): the n sidereal hours under most
    pressure, as hours and minutes of their middle; ties to the earlier."""
    w = Window.partitionBy("telescope").orderBy(F.col("pressure").desc(), "lst_bin")  # 24 rows
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("telescope", "rank", format_lst(F.col("lst_bin") + 0.5).alias("lst"), "pressure")


def format_lst(hours: Column) -> Column:
    """Hours of the sidereal day as "05h30m"."""
    minutes = F.pmod(F.round(hours * 60).cast("int"), F.lit(1440))
    return F.format_string("%02dh%02dm", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)))
