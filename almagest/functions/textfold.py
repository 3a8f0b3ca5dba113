"""One consistent form for text that looks the same.

Everything here is a Column expression, so it stays in the JVM. The tables are
derived from the Unicode data that ships with Python; only the look-alike
letters are listed by hand.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata as ud

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of Greek and Cyrillic that look like a Latin letter,
# each above its look-alike.
GREEK_LIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ"
GREEK_AS = "ABEZHIKMNOPTYXoj"
CYRILLIC_LIKE = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухѕіјһԁԛԝӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYGQWaeopcyxsijhdqwl"
LIKE, LIKE_AS = GREEK_LIKE + CYRILLIC_LIKE, GREEK_AS + CYRILLIC_AS

#: Latin ligatures of more than one letter.
LIGATURES = {chr(c): ud.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}
_NOT_VARIANTS = {"<super>", "<sub>", "<fraction>", "<noBreak>", "<square>", "<vertical>", "<small>"}


@functools.cache
def variant_letters() -> dict[str, str]:
    """Letters and digits that Unicode calls a compatibility form (full-width,
    mathematical, circled, presentation form) or a canonical double of one
    other letter or digit. Superscripts and subscripts carry meaning and stay."""
    out = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        d = ud.decomposition(ch)
        if not d or d.split()[0] in _NOT_VARIANTS:
            continue
        to = ud.normalize("NFKC", ch)
        if len(to) == 1 and to != ch and ud.category(to)[0] in "LN":
            out[ch] = to
    return out


@functools.cache
def spaces() -> str:
    return "".join(chr(c) for c in range(0x80, 0x3001) if ud.category(chr(c)) in ("Zs", "Zl", "Zp"))


@functools.cache
def invisibles() -> str:
    """Format characters, variation selectors, fillers and control characters
    other than tab and line ends."""
    cf = [chr(c) for c in range(0x80, 0x10000) if ud.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x6DD]
    cc = [chr(c) for c in [*range(0, 9), *range(14, 32), *range(127, 160)] if c != 0x85]
    more = [chr(c) for c in [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180E), *range(0xFE00, 0xFE10)]]
    return "".join(dict.fromkeys(cf + cc + more))


@functools.cache
def composed() -> dict[str, str]:
    """Letter and following accent, where Unicode has one character for both."""
    out = {}
    for cp in range(0xC0, 0x2000):
        d = ud.decomposition(chr(cp)).split()
        if len(d) == 2 and d[0][0] != "<":
            pair = "".join(chr(int(x, 16)) for x in d)
            if ud.normalize("NFC", pair) == chr(cp) and ud.combining(pair[1]):
                out[pair] = chr(cp)
    return out


#: Blocks of ordinary letters, ideographs and punctuation, which texts are full of.
_PLAIN = [(0x00, 0x7F), (0xC0, 0x24F), (0x370, 0x52F), (0x2010, 0x2027), (0x2200, 0x22FF), (0x3001, 0x303F), (0x3041, 0x30FE), (0x3400, 0x9FFF), (0x1F300, 0x1FAFF), (0x20000, 0x2F7FF)]


def _class(chars, coarse: bool = False) -> str:
    """A Java character class of the given characters, as ranges. A coarse one
    also holds what lies between them outside the plain blocks, which leaves
    few ranges to test: it serves to pass over texts quickly."""
    cps, parts = sorted(map(ord, chars)), []
    apart = lambda a, b: any(lo < b and hi > a for lo, hi in _PLAIN)
    for c in cps:
        if parts and (c == parts[-1][1] + 1 or coarse and not apart(parts[-1][1], c)):
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in parts) + "]"


LATIN = r"\p{IsLatin}"
WORD, NOT_WORD = r"[\p{L}\p{M}\p{N}]", r"[^\p{L}\p{M}\p{N}]"


# Greek without the letter mu, which units are full of, and Cyrillic.
_LIKE_BLOCKS = r"[\x{391}-\x{3bb}\x{3bd}-\x{3f3}\x{405}-\x{52f}]"


@functools.cache
def _patterns() -> dict[str, str]:
    control = _class([c for c in invisibles() if ord(c) < 128])
    # ASCII is ruled out first, as it is most of any text; control characters have a pattern of their own
    wide = _class([*variant_letters(), *spaces(), *(c for c in invisibles() if ord(c) >= 128), *LIGATURES], coarse=True)
    return {"control": control, "suspect": rf"[\x{{80}}-\x{{10ffff}}&&{wide}]", "like": rf"[\x{{80}}-\x{{10ffff}}&&{_LIKE_BLOCKS}]"}


def beyond_plain() -> str:
    """A pattern for what is outside the plain blocks. Texts without it are
    composed after fold_visual, and no two of them are equal under a Unicode
    collation that tells case and accents apart."""
    return "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _PLAIN) + "]"


def may_differ(c: Column) -> Column:
    """Whether a text holds any character that some step of the fold looks at:
    one scan of the text. Texts without one are their own consistent form."""
    p = _patterns()
    return c.rlike(p["control"]) | (~is_ascii(c) & (c.rlike(p["suspect"]) | c.rlike(p["like"]) | c.rlike(beyond_plain())))


def _map_literal(d: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(d)), "map<string,string>")


def is_ascii(c: Column) -> Column:
    """No character beyond U+007F."""
    return F.octet_length(c) == F.length(c)


def _by_word(c: Column) -> Column:
    """Look-alike letters of words that have Latin letters, as Latin ones."""
    parts = F.regexp_extract_all(c, F.lit(f"{WORD}+|{NOT_WORD}+"), 0)
    p = _patterns()
    swap = lambda w: F.when(w.rlike(LATIN) & w.rlike(p["like"]), F.translate(w, LIKE, LIKE_AS)).otherwise(w)
    return F.array_join(F.transform(parts, swap), "")


def _compose(c: Column) -> Column:
    """Letters and separate accents as one character, one accent a pass."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\P{M}\p{M}|\P{M}+(?!\p{M})|.)"), 1)
    pairs = _map_literal(composed())
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(pairs, w), w)), "")


def held(c: Column) -> Column:
    """The same value, behind a term that Spark takes for random: filters are
    then applied after the column is made. Pushed through a chain of columns
    they would repeat each one's expression wherever the next one names it."""
    return F.when(F.rand(17) >= 0.0, c)


def _steps(c: Column) -> list:
    """The steps of the fold, each from the column before it."""
    p, v = _patterns(), variant_letters()
    frm = "".join(v) + spaces() + invisibles()
    to = "".join(v.values()) + " " * len(spaces())

    def single(x: Column) -> Column:
        one = x
        for lig, letters in LIGATURES.items():
            one = F.replace(one, F.lit(lig), F.lit(letters))
        # texts of ASCII are only searched for control characters
        suspect = x.rlike(p["control"]) | (~is_ascii(x) & x.rlike(p["suspect"]))
        return F.when(suspect, F.translate(one, frm, to)).otherwise(x)

    def words(x: Column) -> Column:
        return F.when(~is_ascii(x) & x.rlike(p["like"]), _by_word(x)).otherwise(x)

    def accents(x: Column) -> Column:
        return F.when(~is_ascii(x) & x.rlike(r"\p{M}"), _compose(_compose(x))).otherwise(x)

    return [single, words, accents]


@functools.cache
def mark_classes() -> dict[str, str]:
    """The combining class of each accent that has one."""
    return {chr(c): f"{ud.combining(chr(c)):03d}" for c in range(0x300, 0x2100) if ud.combining(chr(c))}


def _in_order(c: Column) -> Column:
    """Runs of accents in the order of their classes, as Unicode has it; a run
    with a mark of no class stays."""
    parts, classes = F.regexp_extract_all(c, F.lit(r"(?s)\p{M}{2,}|\P{M}+|\p{M}"), 0), _map_literal(mark_classes())
    marks = lambda p: F.transform(F.filter(F.split(p, ""), lambda m: m != ""), lambda m, i: F.struct(F.try_element_at(classes, m).alias("k"), i.alias("i"), m.alias("m")))
    order = lambda p: F.array_join(F.transform(F.array_sort(marks(p)), lambda x: x["m"]), "")
    run = lambda p: p.rlike(r"^\p{M}{2}") & ~F.exists(marks(p), lambda x: x["k"].isNull())
    return F.array_join(F.transform(parts, lambda p: F.when(run(p), order(p)).otherwise(p)), "")


def compose(c: Column) -> Column:
    """Accents in order, and letters with separate accents as one character
    where Unicode has one."""
    ordered = F.when(c.rlike(r"\p{M}{2}"), _in_order(c)).otherwise(c)
    return F.when(is_ascii(c), c).otherwise(_compose(_compose(ordered)))


def map_lookalikes(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the fold of `text` before accents are joined, as column `out`."""
    df = df.withColumn(out, F.col(text))
    for step in _steps(F.col(out))[:-1]:
        df = df.withColumn(out, held(step(F.col(out))))
    return df


def fold_visual(c: Column) -> Column:
    """The consistent form of a text: variant letters and digits as the usual
    ones, invisible characters gone, every space U+0020, accents joined to
    their letters, look-alike letters inside Latin words as Latin letters.
    Dashes, minus signs, quotation marks and words wholly of another script
    stay. Null stays null; a text of ASCII without control characters comes
    out as it is."""
    for step in _steps(c):
        c = step(c)
    return c


def with_fold(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with fold_visual(text) as column `out`. The steps are columns one
    after the other, so none is worked out twice for long texts."""
    df = df.withColumn(out, F.col(text))
    for step in _steps(F.col(out)):
        df = df.withColumn(out, held(step(F.col(out))))
    return df
