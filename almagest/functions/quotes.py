"""Frequencies and observing times as they are stated in running text.

All expressions stay in the JVM: patterns take the value with its unit from the
places where a sentence states the observing frequency or the total time, so
bandwidths, channel widths, overheads, scans and revisit intervals are not
touched. The text should be folded (functions.textfold) before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Light's speed in m MHz.
LIGHT_M_MHZ = 299.792458

# Units by lower-cased name, and their size in MHz or hours.
FREQ_UNITS = {"hz": 1e-6, "khz": 1e-3, "mhz": 1.0, "ghz": 1e3}
WAVE_UNITS_M = {"m": 1.0, "cm": 1e-2, "mm": 1e-3}
TIME_UNITS = {
    "h": 1.0, "hr": 1.0, "hrs": 1.0, "hour": 1.0, "hours": 1.0, "heure": 1.0, "heures": 1.0, "stunde": 1.0, "stunden": 1.0,
    "min": 1 / 60, "mins": 1 / 60, "minute": 1 / 60, "minutes": 1 / 60, "minuten": 1 / 60,
    "s": 1 / 3600, "sec": 1 / 3600, "secs": 1 / 3600, "second": 1 / 3600, "seconds": 1 / 3600, "secondes": 1 / 3600, "sekunden": 1 / 3600,
    "ks": 1 / 3.6, "d": 24.0, "day": 24.0, "days": 24.0, "jour": 24.0, "jours": 24.0, "tag": 24.0, "tage": 24.0, "tagen": 24.0,
    "week": 168.0, "weeks": 168.0, "semaine": 168.0, "semaines": 168.0, "woche": 168.0, "wochen": 168.0,
}
_ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words() -> dict[str, int]:
    """English number words up to 999 hundreds without a rest, by rule."""
    out = {w: k for k, w in enumerate(_ONES, 1)}
    for k, t in enumerate(_TENS, 2):
        out[t] = 10 * k
        out |= {f"{t}-{w}": 10 * k + j for j, w in enumerate(_ONES[:9], 1)}
    out |= {f"{w} hundred": 100 * k for k, w in enumerate(_ONES[:9], 1)}
    return out | {"a hundred": 100, "hundred": 100}


NUM = r"\d+(?: ?[.,] ?\d+)*(?: ?[x×*] ?10 ?\^ ?[+-]?\d+|[eE][+-]?\d+)?"
_AT = r"(?:\b(?:at|around|on|is|of|à|bei|near)\s+)"
_WAVE = r"(?:(?:a |the )?wavelength of |λ ?= ?|une longueur d'onde de |einer Wellenlänge von )"
_FUNIT = r"([GMk]?[Hh][Zz]|[cm]?m)\b"
_NOT_BAND = r"(?!\s*(?:of bandwidth|wide|channel|bandwidth))"
FREQ = [
    rf"(?i:{_AT}|^at\s+){_WAVE}?({NUM})\s*{_FUNIT}{_NOT_BAND}",
    rf"({NUM})\s*{_FUNIT}\s+is the cent",
    rf"{_WAVE}({NUM})\s*{_FUNIT}{_NOT_BAND}",
]
_TUNIT = "(" + "|".join(sorted(TIME_UNITS, key=lambda u: (-len(u), u))) + r")\b"
_SMALL = r"(?<![\w.,+\-])(?<!scans of )(?<!scan of )(?<!plus )(?<!every )(?<!talonnage de )(?<!toutes les )(?<!alle )"
TIMES = [
    rf"(?i){_SMALL}({NUM})\s*(?:[x×]|runs of|sessions of|s.ances de|L.ufe zu je)\s*({NUM})\s*{_TUNIT}",
    rf"(?i){_SMALL}({NUM})\s*(?:full )?{_TUNIT}(?!\s*(?:scans?\b|of overhead|de scans))",
]
_WORDS = "|".join(sorted(number_words(), key=lambda w: -len(w)))
TIME_WORDS = rf"(?i){_SMALL}\b({_WORDS})\s+(?:full )?{_TUNIT}"


def _lookup(d: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)


def number(c: Column) -> Column:
    """The value of a number as written: thousands commas, a decimal comma, a
    power of ten or an exponent; null where there is none."""
    t = F.regexp_replace(F.nullif(c, F.lit("")), r"\s+", "")
    mant = F.regexp_extract(t, r"^([\d.,]+)", 1)
    expo = F.regexp_extract(t, r"(?:\^|[eE])([+-]?\d+)$", 1)
    grouped = mant.rlike(r"^\d{1,3}(?:,\d{3})+(?:\.\d+)?$")
    plain = F.when(grouped, F.replace(mant, F.lit(","), F.lit(""))).otherwise(F.replace(mant, F.lit(","), F.lit(".")))
    return plain.try_cast("double") * F.pow(F.lit(10.0), F.coalesce(expo.try_cast("double"), F.lit(0.0)))


def _freq(q: Column, pattern: str) -> Column:
    value, unit = number(F.regexp_extract(q, pattern, 1)), F.lower(F.regexp_extract(q, pattern, 2))
    # A comma before three digits groups thousands, unless the value would be no radio frequency.
    mhz = value * _lookup(FREQ_UNITS, unit)
    raw = F.regexp_extract(q, pattern, 1)
    comma = raw.rlike(r"^\d{1,3},\d{3}$") & (mhz > 1e6)
    mhz = F.when(comma, mhz / 1000).otherwise(mhz)
    metres = value * _lookup(WAVE_UNITS_M, unit)
    return F.coalesce(mhz, F.when(metres > 0, F.lit(LIGHT_M_MHZ) / metres))


def stated_freq_mhz(q: Column) -> Column:
    """The observing or central frequency of a text in MHz, or null."""
    return F.coalesce(*[_freq(q, p) for p in FREQ])


def stated_hours(q: Column) -> Column:
    """The total observing time of a text in hours, or null: a product such
    as "9 runs of 5 hours", else a number with a unit, else number words."""
    unit = lambda p, k: _lookup(TIME_UNITS, F.lower(F.regexp_extract(q, p, k)))
    product = number(F.regexp_extract(q, TIMES[0], 1)) * number(F.regexp_extract(q, TIMES[0], 2)) * unit(TIMES[0], 3)
    single = number(F.regexp_extract(q, TIMES[1], 1)) * unit(TIMES[1], 2)
    words = _lookup(number_words(), F.lower(F.regexp_extract(q, TIME_WORDS, 1))) * unit(TIME_WORDS, 2)
    return F.coalesce(product, single, words)
