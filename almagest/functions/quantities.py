"""Values with units in text: all of them, or as frequency intervals.

A quote is read as numbers and what stands behind them. Units are one table of
spellings; intervals follow a small grammar of spans, lists, bands and widths.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit, its size in the base unit of its dimension, the dimension, and its spellings in lower case. A blank
# in a spelling stands for any blanks or none, _ for some; a spelling that ends in a letter ends a word, one in * goes on with any letters.
UNITS = [
    ("Hz", 1, "freq", ["hz"]), ("kHz", 1e3, "freq", ["khz"]), ("MHz", 1e6, "freq", ["mhz"]), ("GHz", 1e9, "freq", ["ghz"]),
    ("nJy", 1e-9, "flux", ["n jy*"]), ("uJy", 1e-6, "flux", ["u jy*"]), ("mJy", 1e-3, "flux", ["m jy*"]), ("Jy", 1, "flux", ["jy*"]),
    ("uK", 1e-6, "temp", ["uk"]), ("mK", 1e-3, "temp", ["mk"]), ("K", 1, "temp", ["k"]),
    ("h", 1, "time_h", ["hours", "hour", "hrs", "hr", "h"]),
    ("deg2", 1, "area", ["degrees squared", "degree squared", "deg squared", "degrees 2", "degree 2", "deg 2", "sq. deg*", "sq deg*", "square_degrees", "square_degree"]),
    ("mas", 1e-3, "angle", ["mas"]), ("arcsec", 1, "angle", ["arcsec", "′′", "''"]), ("arcmin", 60, "angle", ["arcmin", "′"]), ("deg", 3600, "angle", ["°"]),
    ("ns", 1e-9, "time_s", ["ns"]), ("us", 1e-6, "time_s", ["us"]), ("ms", 1e-3, "time_s", ["ms"]), ("s", 1, "time_s", ["s"]),
    ("sigma", 1, "sigma", ["σ", "sigma", "-sigma"]), ("km/s", 1, "velocity", ["km / s", "km s -1"]),
]
# Receiver bands by name, in GHz.
BANDS_GHZ = {"Low": (0.05, 0.35), "1": (0.35, 1.05), "2": (0.95, 1.76), "3": (1.65, 3.05), "4": (2.8, 5.18), "5a": (4.6, 8.5), "5b": (8.3, 15.4), "5": (4.6, 15.4), "6": (15.4, 24.0)}
SCALES = {unit: size for unit, size, _, _ in UNITS}
DIMENSION = {unit: dimension for unit, _, dimension, _ in UNITS}


def _spelled(spelling: str) -> str:
    body = "".join({" ": r"\s*", "_": r"\s+", "*": ""}.get(c, re.escape(c)) for c in spelling)
    return body + (r"\b" if spelling[-1].isalpha() else "")


# Longer spellings are tried before those that they begin with.
_BEHIND = [(re.compile(_spelled(w), re.I), unit) for w, unit in sorted(((w, unit) for unit, _, _, ws in UNITS for w in ws), key=lambda x: -len(x[0]))]
_DIGITS, _TIMES, _BEAM = re.compile(r"\d+(?:\.\d+)?"), re.compile(r"\s*[x×]\s*10\^?\s*(-?\d+)"), re.compile(r"\s*/\s*beam|\s+beam\s*-?1", re.I)


def plain(text: str) -> str:
    """A quote as PDF extraction leaves it, made comparable: compatibility
    forms, numbers torn at their point, marks for "about", micro and minus."""
    one = unicodedata.normalize("NFKC", text).translate({0x3BC: "u", 0x2212: "-", 0x223C: " ", ord("~"): " ", 0x2248: " ", 0x2243: " "})
    joined = re.sub(r"(?<=\d)\s*\.\s*(?=\d)", ".", one)
    return " ".join(joined.split())


def unit_at(text: str, at: int) -> tuple[str, int] | None:
    """The unit that stands at a place of a text, blanks before it, and its end."""
    while at < len(text) and text[at].isspace():
        at += 1
    for spelling, unit in _BEHIND:
        if m := spelling.match(text, at):
            beam = _BEAM.match(text, m.end()) if DIMENSION[unit] == "flux" else None
            return unit, (beam or m).end()
    return None


def quantities(text: str | None) -> list[dict]:
    """Every value with a unit: value, unit, base (in the base unit of its
    dimension), text, start (in the plain text). Null and empty texts have none."""
    t, out, at = plain(text or ""), [], 0
    while number := _DIGITS.search(t, at):
        power = _TIMES.match(t, number.end())
        at = number.end()
        for end, exponent in ([(power.end(), int(power[1]))] if power else []) + [(number.end(), 0)]:
            if behind := unit_at(t, end):
                unit, at = behind
                value = float(number[0]) * 10.0**exponent
                out.append({"value": value, "unit": unit, "base": value * SCALES[unit], "text": t[number.start() : at], "start": number.start()})
                break
    return out


def quantities_of(text: Column) -> Column:
    """quantities() of a column, as an array of structs."""
    kind = "array<struct<value: double, unit: string, base: double, text: string, start: int>>"
    return F.pandas_udf(lambda texts: texts.map(quantities), kind)(text)


class _Reader:
    """A text about frequencies as tokens: numbers, names of bands, words and
    single marks; marks for "about" are passed over."""

    TOKEN = re.compile(r"\d[ab](?![\w.])|\d+(?:\.\d+)?|[A-Za-z]+(?:-[A-Za-z]+)*|\S")

    def __init__(self, text: str):
        self.tokens = [x for x in self.TOKEN.findall(text) if x not in "~≈<>="]
        self.at = 0

    def get(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def number(self, ahead: int = 0) -> float | None:
        x = self.get(ahead)
        return float(x) if x[:1].isdecimal() and x[-1].isdecimal() else None

    def bands(self) -> list[tuple[float, float]] | None:
        """ "Bands 1, 2 and 5a"."""
        if self.get() not in ("Band", "Bands"):
            return None
        k, named = 1, []
        while (x := self.get(k)) in BANDS_GHZ or x in ("and", "or", "to", "Band", ",", "+") or len(x) == 1 and x.isdecimal():
            named += [x] if x in BANDS_GHZ and x != "Low" else []
            k += 1
        if not named:
            return None
        self.at += k
        return [BANDS_GHZ[x] for x in named]

    def width(self) -> bool:
        """ "10 MHz contiguous bandwidth", "(5 MHz contiguous)"."""
        if self.number() is None or self.get(1) not in ("MHz", "kHz", "GHz"):
            return False
        wide = ("bandwidth", "subband", "subbands", "sub-band", "sub-bands")
        k = 3 if self.get(2) == "contiguous" else 2
        if self.get(k) in wide:
            self.at += k + 1
        elif k == 3 and self.get(3) == ")" and self.at and self.get(-1) == "(":
            self.at += 4
        else:
            return False
        return True

    def span(self) -> list[tuple[float, float]] | None:
        """ "350-1050 MHz", "50 MHz to 15.4 GHz"."""
        k = 2 if self.get(1) in _GHZ else 1
        if self.number() is None or self.get(k) not in ("-", "–", "to") or self.number(k + 1) is None or self.get(k + 2) not in _GHZ:
            return None
        low, high, upper = self.number(), self.number(k + 1), _GHZ[self.get(k + 2)]
        lower = _GHZ[self.get(1)] if k == 2 else upper
        self.at += k + 3
        return [(low * lower, high * upper)]

    def points(self) -> list[tuple[float, float]] | None:
        """ "1.4 GHz", "0.9, 1.2 and 1.4 GHz", "21 cm"."""
        values, k = [self.number()], 1
        while values[-1] is not None and self.get(k) in (",", "and", "or") and self.number(k + 1) is not None:
            values.append(self.number(k + 1))
            k += 2
        unit = self.get(k)
        if values[0] is None or unit not in _GHZ and unit != "cm":
            return None
        self.at += k + 1
        return [(f, f) for v in values if v for f in [30 / v if unit == "cm" else v * _GHZ[unit]]]


_GHZ = {"MHz": 1e-3, "GHz": 1.0}


def freq_intervals(text: str | None) -> list[list[float]] | None:
    """Intervals in GHz that a text names: ranges, single frequencies and
    wavelengths (both ends equal), bands by name. Bandwidths are none."""
    r, out, low, in_mhz = _Reader(text or ""), [], False, False
    while r.at < len(r.tokens):
        if r.width():
            continue
        in_mhz |= r.number() is not None and r.get(1) == "MHz"
        low |= r.get().split("-")[-1] == "Low"
        got = r.bands() or r.span() or r.points()
        if got:
            in_mhz |= r.get(-1) == "MHz"
            out += got
        else:
            r.at += 1
    if low and not in_mhz:
        out.append(BANDS_GHZ["Low"])
    return sorted([round(min(i), 4), round(max(i), 4)] for i in out) or None
