"""Points near other points or inside regions of the sky.

Positions get codes along space-filling curves: a Morton code of the cell of a
unit-sphere cube for discs, and one of the (RA, Dec) plane for boxes. A disc or
a box is covered by ranges of codes, cut at aligned blocks of the curve, so
that the range join on the sorted codes is an equi-join on block ids that
Spark can hash, sort or split for skew. Every candidate is then checked
exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per axis of the (RA, Dec) curve, and the levels at which boxes are covered.
BOX_BITS, BOX_LEVELS = 12, (3, 6, 9, 12)
#: A box is covered at the finest level at which it spans no more cells than this on an axis.
BOX_SPAN = 16
#: Edge of a cube cell in units of the disc's radius.
CELL_RADII = 4.0


def finite(c: Column) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def wrap360(ra: Column) -> Column:
    """A right ascension in [0, 360)."""
    m = F.pmod(ra, F.lit(360.0))
    return F.when(m >= 360.0, F.lit(0.0)).otherwise(m)


def positions(df: DataFrame, id_col: str, ra: str = "ra_deg", dec: str = "dec_deg") -> DataFrame:
    """(id, ra, dec) of the rows with both coordinates as numbers and the
    declination in [-90, 90]; right ascension modulo 360. Other rows have no
    place on the sky and are left out."""
    return (
        df.select(F.col(id_col).alias("id"), finite(F.col(ra)).alias("ra0"), finite(F.col(dec)).alias("dec"))
        .where("ra0 is not null and dec between -90 and 90")
        # never null from here: else a test for null would be pushed down through every step of the codes
        .select("id", F.coalesce(wrap360(F.col("ra0")), F.lit(0.0)).alias("ra"), F.coalesce("dec", F.lit(0.0)).alias("dec"))
    )


# Shifts and masks that set the bits of a number two or three places apart.
_SPREAD = {
    2: ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)),
    3: ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)),
}


def with_spread(df: DataFrame, step: int, axes: dict[str, Column]) -> DataFrame:
    """`df` with columns of small non-negative integers whose bits are set
    `step` places apart. Each round is its own projection: as one expression
    it would double at each round."""
    df = df.withColumns({n: a.cast("bigint") for n, a in axes.items()})
    for shift, mask in _SPREAD[step]:
        df = df.withColumns({n: F.col(n).bitwiseOR(F.shiftleft(F.col(n), shift)).bitwiseAND(F.lit(mask)) for n in axes})
    return df


def joined(*axes: Column) -> Column:
    """The Morton code of columns of with_spread()."""
    code = axes[0]
    for k, a in enumerate(axes[1:], 1):
        code = code.bitwiseOR(F.shiftleft(a, k))
    return code


def with_morton(df: DataFrame, out: str, *axes: Column) -> DataFrame:
    """`df` with the Morton code of two or three small non-negative integers."""
    names = [f"__m{k}" for k in range(len(axes))]
    df = with_spread(df, len(axes), dict(zip(names, axes)))
    return df.withColumn(out, joined(*map(F.col, names))).drop(*names)


def _xyz(df: DataFrame) -> DataFrame:
    r, d = F.radians("ra"), F.radians("dec")
    return df.withColumns({"x": F.cos(d) * F.cos(r), "y": F.cos(d) * F.sin(r), "z": F.sin(d)})


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle on the sphere by the haversine formula, good for small angles."""
    a = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))) * 3600.0


def near_pairs(points: DataFrame, radius_arcsec: float) -> DataFrame:
    """(id_a, id_b, sep_arcsec) of all pairs of rows of positions() at most
    `radius_arcsec` apart, id_a < id_b, each pair once. Pairs of equal position
    count; an id that occurs twice pairs by each of its rows.

    Each point is posted once under its own cell and asks in the cells that its
    disc touches (about 3.4 of them). Crowded cells are split by Spark's skew
    join, both sides being plain rows.
    """
    chord = 2 * math.sin(math.radians(radius_arcsec / 3600.0) / 2)
    reach = chord * (1 + 1e-9) + 1e-15
    edge = max(CELL_RADII * chord, 2.0**-19)
    p = _xyz(points)
    cell = lambda c: F.greatest(F.floor((c + 1.0) / edge), F.lit(0))
    home = with_morton(p, "code", *[cell(F.col(a)) for a in "xyz"]).select(F.col("id").alias("id_b"), F.col("ra").alias("ra_b"), F.col("dec").alias("dec_b"), "code")
    ends = {f"{a}{k}": cell(F.col(a) + d) for a in "xyz" for k, d in ((0, -reach), (1, reach))}
    touched = [joined(F.col(f"x{i}"), F.col(f"y{j}"), F.col(f"z{k}")) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    asks = with_spread(p.select("id", "ra", "dec", *[c.alias(f"f_{n}") for n, c in ends.items()]), 3, {n: F.col(f"f_{n}") for n in ends})
    asks = asks.select(F.col("id").alias("id_a"), F.col("ra").alias("ra_a"), F.col("dec").alias("dec_a"), F.explode(F.array_distinct(F.array(*touched))).alias("code"))
    sep = separation_arcsec(F.col("ra_a"), F.col("dec_a"), F.col("ra_b"), F.col("dec_b"))
    return (
        asks.join(home, "code")
        .where(F.col("id_a") < F.col("id_b"))
        .withColumn("sep_arcsec", sep)
        .where(F.col("sep_arcsec") <= radius_arcsec)
        .select("id_a", "id_b", "sep_arcsec")
    )


def boxes(df: DataFrame, id_col: str) -> DataFrame:
    """(box_id, ra_min, ra_max, dec_min, dec_max) of the rows with all four
    bounds as numbers. Right ascensions are taken modulo 360; a box whose
    ra_min is then above its ra_max crosses 0 h."""
    cols = ("ra_min", "ra_max", "dec_min", "dec_max")
    b = df.select(F.col(id_col).alias("box_id"), *[finite(F.col(c)).alias(c) for c in cols])
    b = b.where(" and ".join(f"{c} is not null" for c in cols))
    b = b.select("box_id", wrap360(F.col("ra_min")).alias("ra_min"), wrap360(F.col("ra_max")).alias("ra_max"), "dec_min", "dec_max")
    return b.select("box_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])


def _cover(b: DataFrame) -> DataFrame:
    """Boxes with the blocks that cover them: (level, block)."""
    width = F.when(F.col("ra_min") <= F.col("ra_max"), F.col("ra_max") - F.col("ra_min")).otherwise(360.0 - F.col("ra_min") + F.col("ra_max"))
    b = b.where("dec_min <= dec_max").withColumn("w", width)
    level = F.lit(BOX_LEVELS[0])
    for lv in BOX_LEVELS[1:]:
        fits = (F.col("w") / 360.0 * 2.0**lv <= BOX_SPAN) & ((F.col("dec_max") - F.col("dec_min")) / 180.0 * 2.0**lv <= BOX_SPAN)
        level = F.when(fits, F.lit(lv)).otherwise(level)
    b = b.withColumn("level", level).withColumn("n", F.pow(F.lit(2.0), F.col("level")))
    col = lambda ra: F.least(F.floor(ra / 360.0 * F.col("n")), (F.col("n") - 1).cast("bigint"))
    row = lambda d: F.greatest(F.lit(0), F.least(F.floor((d + 90.0) / 180.0 * F.col("n")), (F.col("n") - 1).cast("bigint")))
    cols = F.when(F.col("ra_min") <= F.col("ra_max"), F.sequence(col(F.col("ra_min")), col(F.col("ra_max")))).otherwise(
        F.array_union(F.sequence(col(F.col("ra_min")), (F.col("n") - 1).cast("bigint")), F.sequence(F.lit(0).cast("bigint"), col(F.col("ra_max"))))
    )
    b = b.withColumn("i", F.explode(cols)).withColumn("j", F.explode(F.sequence(row(F.col("dec_min")), row(F.col("dec_max")))))
    return with_morton(b, "block", F.col("i"), F.col("j")).drop("w", "n", "i", "j")


def inside_boxes(points: DataFrame, b: DataFrame) -> DataFrame:
    """(id, box_id) of all rows of positions() within rows of boxes(), bounds
    included. A box with dec_min above dec_max holds nothing; repeated boxes
    and points count each."""
    n = 2**BOX_BITS
    ix = F.least(F.floor(F.col("ra") / 360.0 * n), F.lit(n - 1))
    iy = F.greatest(F.lit(0), F.least(F.floor((F.col("dec") + 90.0) / 180.0 * n), F.lit(n - 1)))
    at = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.shiftright(F.col("code"), 2 * (BOX_BITS - lv)).alias("block")) for lv in BOX_LEVELS]))
    p = with_morton(points, "code", ix, iy).withColumn("at", at).select("id", "ra", "dec", "at.level", "at.block")
    in_ra = F.when(F.col("ra_min") <= F.col("ra_max"), F.col("ra").between(F.col("ra_min"), F.col("ra_max"))).otherwise((F.col("ra") >= F.col("ra_min")) | (F.col("ra") <= F.col("ra_max")))
    return p.join(_cover(b), ["level", "block"]).where(in_ra & F.col("dec").between(F.col("dec_min"), F.col("dec_max"))).select("id", "box_id")


def found(sources: DataFrame, requests: DataFrame, radius_arcsec: float = 30.0) -> DataFrame:
    """(relation, source_id, other_id): `near` for pairs of sources, `inside`
    for sources in the box of a request."""
    p = positions(sources, "id")
    near = near_pairs(p, radius_arcsec).select(F.lit("near").alias("relation"), F.col("id_a").alias("source_id"), F.col("id_b").alias("other_id"))
    ins = inside_boxes(p, boxes(requests, "id")).select(F.lit("inside").alias("relation"), F.col("id").alias("source_id"), F.col("box_id").alias("other_id"))
    return near.unionByName(ins)


def cone(points: DataFrame, ra: float, dec: float, radius_arcsec: float) -> DataFrame:
    """Rows of positions() within a cone, with their separation; a band on
    declination is filtered before the exact test."""
    r = radius_arcsec / 3600.0
    sep = separation_arcsec(F.lit(float(ra)), F.lit(float(dec)), F.col("ra"), F.col("dec"))
    return points.where(F.col("dec").between(dec - r - 1e-9, dec + r + 1e-9)).withColumn("sep_arcsec", sep).where(F.col("sep_arcsec") <= radius_arcsec)


def separation_deg(ra_a: Column, dec_a: Column, ra_b: Column, dec_b: Column) -> Column:
    """Degrees between two places on the sphere."""
    h = F.pow(F.sin(F.radians(dec_a - dec_b) / 2), 2) + F.cos(F.radians(dec_a)) * F.cos(F.radians(dec_b)) * F.pow(F.sin(F.radians(ra_a - ra_b) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def coordinates_in_name(name: Column) -> tuple[Column, Column]:
    """(right ascension, declination) in degrees of a name that ends in
    "JHHMMSS.s+DDMMSS"; null for other names."""
    at = lambda k: F.nullif(F.regexp_extract(name, r"J([0-9]{2})([0-9]{2})([0-9]{2}(?:\.[0-9]+)?)([+-])([0-9]{2})([0-9]{2})([0-9]{2}(?:\.[0-9]+)?)$", k), F.lit(""))
    sexagesimal = lambda k: at(k).cast("double") + at(k + 1).cast("double") / 60 + at(k + 2).cast("double") / 3600
    return 15 * sexagesimal(1), F.when(at(4) == "-", -1.0).otherwise(1.0) * sexagesimal(5)


def altitude_deg(ra: Column, dec: Column, lst_hours: Column, latitude: float) -> Column:
    """Altitude of a place on the sky at a sidereal time, in degrees."""
    a, b, p = F.radians(lst_hours * 15 - ra), F.radians(dec), F.radians(F.lit(latitude))
    s = F.sin(p) * F.sin(b) + F.cos(p) * F.cos(b) * F.cos(a)
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s))))


# The galactic pole and the longitude of the celestial pole (J2000), in degrees.
POLE_RA, POLE_DEC, POLE_L = 192.859481, 27.12825, 122.931918


def galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in galactic coordinates, in degrees."""
    a, b, p = F.radians(ra - POLE_RA), F.radians(dec), F.radians(F.lit(POLE_DEC))
    s = F.sin(b) * F.sin(p) + F.cos(b) * F.cos(p) * F.cos(a)
    y, x = F.cos(b) * F.sin(a), F.sin(b) * F.cos(p) - F.cos(b) * F.sin(p) * F.cos(a)
    return F.pmod(POLE_L - F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s))))
