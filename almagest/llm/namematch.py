"""Freely typed names mapped to the entries of a catalogue.

Names and entries become sets of tokens: three-letter runs of the words of the
label, bound to the number or position where there is one (so numbers must agree
in value). The sets are joined by prefix filtering: tokens are ordered by their
rarity in the catalogue, only the rare prefixes are posted and joined, lengths
and positions filter the candidates, Jaccard similarity is verified exactly, and
the best entry is kept. Names of words alone must also be within a few edits of
the entry's, which tells misspellings from other names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions.textfold import held, with_fold
from almagest.session import cut

#: Least Jaccard similarity of the token sets, and most edits between the words of proper names.
THRESHOLD, EDITS = 0.35, 4

# What stands before a name without being part of it.
LEAD = r"^(?:(?:the|object|objet|objekt|target|ziel|source|la source|quelle|fuente|field of|obs\.? of|observation of|name)\s+)+"
# What stands after it.
TAIL = r"(?:\s*(?:\(\?\)|\(core\)|\[radio\]|\*|, main component|-\s*see notes|\bregion|\barea))+\s*$"
# Kinds of objects, each with the words that say it in names.
KINDS = {
    "cloud": "cloud cld wolke nuage nube",
    "nebula": "nebula neb nebel nébuleuse nebulosa",
    "cluster": "cluster cl clus haufen amas cúmulo",
    "bridge": "bridge br brücke pont puente",
    "shell": "shell sh schale coquille concha cáscara",
    "galaxy": "galaxy gal galaxie galaxia",
    "deep field": "df field feld deep champ campo tiefes profond profundo",
    "stream": "stream str strom courant corriente",
    "void": "void leerraum vide vacío",
}
_KIND_WORDS = [w for ws in KINDS.values() for w in ws.split()]
_NUMBERING = r"(?:\s|[-_#.,:]|\bn[or]\.?|\bno\b)*$"
_POSITION = r"(\d{2})\s*[h: ]?\s*(\d{2})\s*[m: ]?\s*(\d{2}(?:\.\d+)?)s?\s*([+\-−–])\s*(\d{2})\s*[d: ]?\s*(\d{2})\s*[m: ]?\s*(\d{2}(?:\.\d+)?)s?"
_NUMBER = r"(\d{1,3}(?:,\d{3})+|\d+)"


def parsed(df: DataFrame, raw: str) -> DataFrame:
    """`df` with the parts of a name: `number` (canonical position or the
    number without commas and leading zeros, "" for none), `label` (the words
    before it; of a proper name its own words, in alphabetical order) and
    `kind` (of a proper name, where a word says it)."""
    t = with_fold(df, raw, "__t")
    t = t.withColumn("__t", held(F.regexp_replace(F.trim(F.lower("__t")), r"\s+", " ")))
    t = t.withColumn("__t", held(F.regexp_replace(F.regexp_replace(F.col("__t"), LEAD, ""), TAIL, "")))
    x = F.col("__t")
    at = lambda k: F.regexp_extract(x, _POSITION, k)
    sign = F.when(at(4) == "+", "+").otherwise("-")
    position = F.when(x.rlike(r"\d.*\d.*\d.*[+\-−–]") & x.rlike(_POSITION), F.concat(F.lit("j"), at(1), at(2), at(3), sign, at(5), at(6), at(7))).otherwise("")
    t = t.withColumn("__p", held(position))
    digits = F.regexp_replace(F.replace(F.regexp_extract(x, _NUMBER, 1), F.lit(","), F.lit("")), r"^0+(?=\d)", "")
    t = t.withColumn("number", held(F.when(F.col("__p") != "", F.col("__p")).otherwise(digits)))
    head = F.regexp_replace(F.regexp_extract(x, r"^(.*?)\d", 1), _NUMBERING, "")
    head = F.when(F.col("__p") != "", F.regexp_replace(head, r"[\s\-_]*j?$", "")).otherwise(head)
    words = F.regexp_extract_all(x, F.lit(r"\p{L}+"), 0)
    own = F.array_sort(F.filter(words, lambda w: ~w.isin(_KIND_WORDS)))
    kind = None
    for k, ws in KINDS.items():
        hit = F.arrays_overlap(words, F.array(*map(F.lit, ws.split())))
        kind = F.when(hit, F.lit(k)) if kind is None else kind.when(hit, F.lit(k))
    t = t.withColumn("label", held(F.when(F.col("number") != "", F.array_join(F.regexp_extract_all(head, F.lit(r"\p{L}+"), 0), " ")).otherwise(F.array_join(own, " "))))
    return t.withColumn("kind", held(F.when(F.col("number") == "", kind))).drop("__t", "__p")


def entries(sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entry_id, label, number, kind): each entry under its own designation
    and, where its catalogue has other names, under each of those."""
    s = cut(parsed(sources.where("main_id is not null").select(F.col("id").alias("entry_id"), "main_id"), "main_id").drop("main_id"))
    a = with_fold(with_fold(aliases.where("prefix is not null and alias is not null").select("prefix", "alias"), "prefix", "p"), "alias", "a")
    words = F.array_join(F.regexp_extract_all(F.lower("a"), F.lit(r"\p{L}+"), 0), " ")
    a = cut(a.select(F.lower("p").alias("label"), held(words).alias("other")).distinct())
    more = s.where("number <> ''").join(a, "label").select("entry_id", F.col("other").alias("label"), "number", "kind")
    return s.select("entry_id", "label", "number", "kind").unionByName(more)


def tokens(label: Column, number: Column) -> Column:
    """Hashes of the three-letter runs of the label's words (with their ends),
    bound to the number."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(3)))
    words = F.filter(F.split(label, " "), lambda w: w != "")
    return F.array_distinct(F.transform(F.flatten(F.transform(words, grams)), lambda g: F.xxhash64(g, number)))


def _prefixes(sets: DataFrame, rarity: DataFrame, key: str, threshold: float) -> DataFrame:
    """The rare prefix of each set: (key, token, pos, size)."""
    t = sets.select(key, F.explode("tokens").alias("token"), F.size("tokens").alias("size")).join(rarity, "token", "left")
    order = Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "token")  # a set holds the letters of one name
    t = t.withColumn("pos", F.row_number().over(order))
    keep = F.col("size") - F.ceil(F.col("size") * threshold) + 1
    return t.where((F.col("pos") <= keep) & F.col("df").isNotNull()).select(key, "token", "pos", "size")


def set_join(queries: DataFrame, refs: DataFrame, threshold: float) -> DataFrame:
    """(q, r, jaccard) of all pairs of queries (q, tokens) and refs (r, tokens)
    with a Jaccard similarity of at least `threshold`, each once."""
    rarity = refs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    qp = _prefixes(queries, rarity, "q", threshold)
    rp = _prefixes(refs, rarity, "r", threshold).withColumnsRenamed({"pos": "rpos", "size": "rsize"})
    c = qp.join(rp, "token")
    least = F.col("size") + F.col("rsize")
    most_shared = 1 + F.least(F.col("size") - F.col("pos"), F.col("rsize") - F.col("rpos"))
    # by length, and for the first token in common by position
    c = c.where((F.col("size") >= threshold * F.col("rsize")) & (F.col("rsize") >= threshold * F.col("size")))
    c = c.groupBy("q", "r").agg(F.max(most_shared).alias("most"), F.first(least).alias("both")).where(F.col("most") >= F.col("both") * (threshold / (1 + threshold)) - 1e-9)
    c = c.join(queries.select("q", F.col("tokens").alias("tq")), "q").join(refs.select("r", F.col("tokens").alias("tr")), "r")
    shared = F.size(F.array_intersect("tq", "tr"))
    c = c.withColumn("shared", shared).withColumn("jaccard", F.col("shared") / (F.size("tq") + F.size("tr") - F.col("shared")))
    return c.where(F.col("jaccard") >= threshold).select("q", "r", "jaccard")


def best_entries(n: DataFrame, sources: DataFrame, aliases: DataFrame, threshold: float = THRESHOLD, edits: int = EDITS) -> DataFrame:
    """(name_key, entry_id, similarity) of the parsed names n (name_key, label,
    number, kind) that denote an entry."""
    e = entries(sources, aliases)
    wanted = n.where("number <> ''").select("number").distinct()
    e = e.where("number <> ''").join(wanted, "number", "left_semi").unionByName(e.where("number = ''").select("number", "entry_id", "label", "kind"))
    # each distinct label and number is one set, however many rows have it
    q = n.where("label <> ''").select("label", "number").distinct().select(F.struct("label", "number").alias("q"), tokens(F.col("label"), F.col("number")).alias("tokens"))
    e = e.where("label <> ''")
    r = e.select("label", "number").distinct().select(F.struct("label", "number").alias("r"), tokens(F.col("label"), F.col("number")).alias("tokens"))
    c = set_join(q, r, threshold)
    # words are in alphabetical order, which a misspelt first letter can change
    back = F.array_join(F.reverse(F.split("q.label", " ")), " ")
    c = c.withColumn("edits", F.least(F.levenshtein("q.label", "r.label"), F.levenshtein(back, F.col("r.label")))).where((F.col("q.number") != "") | (F.col("edits") <= edits))
    c = c.select(F.col("q.label").alias("label"), F.col("q.number").alias("number"), F.col("r.label").alias("rl"), "jaccard", "edits")
    hit = n.select("name_key", "label", "number", F.col("kind").alias("said")).join(c, ["label", "number"])
    hit = hit.join(e.select("entry_id", F.col("label").alias("rl"), "number", "kind"), ["rl", "number"])
    other_kind = F.coalesce(F.col("said") != F.col("kind"), F.lit(False)).cast("int")
    best = hit.groupBy("name_key").agg(F.min(F.struct(-F.col("jaccard"), other_kind, "edits", "entry_id")).alias("best"))
    return best.select("name_key", F.col("best.entry_id").alias("entry_id"), (-F.col("best.col1")).alias("similarity"))


def matches(names: DataFrame, sources: DataFrame, aliases: DataFrame, threshold: float = THRESHOLD, edits: int = EDITS) -> DataFrame:
    """(name_key, entry_id, main_id, similarity, status): each name_key once, with the
    entry that it denotes (status matched), or nulls (unmatched). Of several
    entries the most similar is kept, then one of the kind that the name says,
    then the one of fewest edits, then the smallest id. A null raw_name, or one
    without letters, is unmatched."""
    n = names.select("name_key", "raw_name").groupBy("name_key").agg(F.min("raw_name").alias("raw_name"))
    n = cut(parsed(n, "raw_name").drop("raw_name"))
    out = n.select("name_key").join(best_entries(n, sources, aliases, threshold, edits), "name_key", "left").join(sources.select(F.col("id").alias("entry_id"), "main_id"), "entry_id", "left")
    return out.select("name_key", "entry_id", "main_id", "similarity", F.when(F.col("entry_id").isNull(), "unmatched").otherwise("matched").alias("status"))


def found(names: DataFrame, sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name_key, source_id) of the names without a source that denote an entry."""
    open_ = names.groupBy("name_key").agg(F.max("source_id").alias("has"), F.min("raw_name").alias("raw_name")).where("has is null").drop("has")
    return best_entries(cut(parsed(open_, "raw_name").drop("raw_name")), sources, aliases).select("name_key", F.col("entry_id").alias("source_id"))
