"""What a quote requires, field by field, and whether a record says more.

A quote's quantities become fields by their dimension and by the words just
before them; a few fields are words. A record's value is stated where the quote
holds it, in any unit of its dimension, and inferred otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions.quantities import DIMENSION, SCALES, plain, quantities

#: Characters before a quantity in which words tell what it is, and behind it in which "beam" does.
BEFORE, BEHIND = 40, 8
# Words before a quantity of a dimension and the field they make of it, in the order asked for; without any, the last.
FIELDS = {
    "freq": [("bandwidth", ["bandwidth", "band width", "wide "]), ("channel_width", ["channel", "resolution", "smooth", "spectral"]), ("frequency", [])],
    "area": [("fov", ["field of view", "fov", "primary beam"]), ("area", [])],
    "velocity": [("channel_width", [])], "flux": [("sensitivity", [])], "temp": [("sensitivity", [])], "time_h": [("hours", [])],
    "angle": [("angular_resolution", [])], "time_s": [("time_resolution", [])], "sigma": [("sigma_level", [])],
}
WIDTH_UNITS = ("Hz", "kHz")
WEIGHTINGS, MODES = ("natural", "uniform"), ("continuum", "zoom", "pss", "pst", "vlbi", "transient_buffer", "solar")
BANDS = ("1", "2", "3", "4", "5a", "5b", "5")


def _words(quote: str) -> list[tuple[str, str]]:
    """(field, value) of what is said in words: band and weighting."""
    tokens, out = quote.lower().replace("=", " ").replace(",", " ").replace(";", " ").split(), []
    for k, w in enumerate(tokens):
        after = [x.rstrip(".") for x in tokens[k + 1 : k + 5]]
        if w == "band" and after and after[0] in BANDS:
            out.append(("band", f"Band {after[0]}"))
        if w in ("robust", "robustness"):
            number = next((x for x in after if x.lstrip("-").replace(".", "", 1).isdecimal()), None)
            skipped = after[: after.index(number)] if number else []
            if number and all(x in ("imaging", "weighting", "parameter", "value", "of") for x in skipped):
                out.append(("weighting", f"robust {number}"))
        if w in WEIGHTINGS and after and after[0].startswith("weight"):
            out.append(("weighting", w))
    return out


def draft(quote: str | None) -> list[dict]:
    """The first value of each field that a quote states: field, number, unit,
    word, source_text. Null and empty quotes state nothing."""
    t, out = plain(quote or ""), {}
    for q in quantities(quote):
        before, dimension = t[max(0, q["start"] - BEFORE) : q["start"]].lower(), DIMENSION[q["unit"]]
        field = next(f for f, words in FIELDS[dimension] if not words or any(w in before for w in words) or f == "channel_width" and q["unit"] in WIDTH_UNITS)
        behind = t[q["start"] : q["start"] + len(q["text"]) + BEHIND].lower()
        unit = q["unit"] + ("/beam" if dimension == "flux" and "beam" in behind else "")
        out.setdefault(field, {"field": field, "number": q["value"], "unit": unit, "word": None, "source_text": q["text"]})
    for field, value in _words(t):
        out.setdefault(field, {"field": field, "number": None, "unit": None, "word": value, "source_text": value})
    return list(out.values())


def drafts(quotes: DataFrame) -> DataFrame:
    """(id, field, number, unit, word, source_text) of quotes (id, quote)."""
    kind = "array<struct<field: string, number: double, unit: string, word: string, source_text: string>>"
    of = F.pandas_udf(lambda s: s.map(draft), kind)
    return quotes.select("id", F.inline(of(F.col("quote"))))


def states(quote: str | None, value: float | None, unit: str) -> bool:
    """Whether a quote holds a value in some unit of its dimension, within one per cent."""
    if value is None or pd.isna(value):
        return False
    base = value * SCALES[unit]
    near = [q for q in quantities(quote) if DIMENSION[q["unit"]] == DIMENSION[unit]]
    return any(abs(q["base"] - base) <= 0.01 * max(abs(q["base"]), abs(base), 1e-30) for q in near)


def checked(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(id, field, value, verdict) of records (id, quote and the columns that
    `fields` names with their units): stated, inferred, or null without a value."""
    out = []
    for column, unit in fields.items():
        told = F.pandas_udf(lambda q, v, u=unit: pd.Series([states(a, b, u) for a, b in zip(q, v)], dtype=bool), "boolean")
        v = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
        out.append(records.select("id", F.lit(column).alias("field"), v.alias("value"), F.when(v.isNotNull(), F.when(told("quote", v), "stated").otherwise("inferred")).alias("verdict")))
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


def converted(value: Column, unit: Column, to: str) -> Column:
    """A value in another unit of its dimension; null for a unit of another one."""
    size = F.create_map(*[F.lit(x) for u, s in SCALES.items() if DIMENSION[u] == DIMENSION[to] for x in (u, float(s))])
    return value * F.try_element_at(size, F.replace(unit, F.lit("/beam"), F.lit(""))) / float(SCALES[to])
