"""Near-duplicate texts by a signature-coordinate inverted join.

Texts of equal words collapse to one representative first. Each representative
gets a MinHash of its word shingles, of which fixed pairs make the coordinates
of its signature: two texts agree in a coordinate with the square of their
similarity, so texts that merely share a vocabulary hardly ever do. It is posted
under its coordinate-value pairs. A pair that occurs in one text only cannot collide and
is dropped; of the others each text posts only a prefix, in order of rarity:
two texts that agree in `min_match` coordinates must meet in the prefixes,
because each prefix leaves out fewer than `min_match` of the coordinates that
can collide. What it leaves out are the hottest, so texts that share no more
than a boilerplate passage do not meet. Collisions of a pair are counted; those that its prefixes cannot
have shown are merged in from the packed minima, and pairs above a match
threshold are checked exactly on their shingles.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions.textfold import with_fold
from almagest.llm.bpe import over_all_cores
from almagest.operators.graph import components
from almagest.session import cut

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_MEMO = 300_000


class Shingler:
    """Hashes of the distinct runs of `k` words of a text, and their MinHash."""

    def __init__(self, k: int, minima: int, coordinates: int = 1, size: int = 2):
        self.k, self.words = k, {}
        rng = np.random.default_rng(20240229)
        self.mul = rng.integers(1, 2**63, minima, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 2**63, minima, dtype=np.uint64)
        # each round of sets shares no minimum, so that coordinates fail as independently as they can
        rounds = -(-coordinates // (minima // size))
        self.sets = np.concatenate([rng.permutation(minima)[: minima // size * size].reshape(-1, size) for _ in range(rounds)])[:coordinates]

    def coordinates(self, minima: np.ndarray) -> np.ndarray:
        """A value for each set of minima, the number of the set mixed in."""
        m, out = minima[self.sets], np.arange(len(self.sets), dtype=np.uint64) * _P
        for j in range(m.shape[1]):
            out = (out ^ (out >> np.uint64(29))) * _P + m[:, j]
        out = (out ^ (out >> np.uint64(32))) * _P
        return out ^ (out >> np.uint64(29))

    @staticmethod
    def packed(minima: np.ndarray) -> np.ndarray:
        """Four bits of each minimum, sixteen minima to a number."""
        nibbles = (minima & np.uint64(15)).reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)
        return np.bitwise_or.reduce(nibbles, axis=1)

    def hashes(self, text: str) -> tuple[np.ndarray, int]:
        """(sorted distinct shingle hashes, number of words)."""
        if len(self.words) > _MEMO:
            self.words = {}
        w, h = _WORD.findall(text.lower()), self.words
        for x in w:
            if x not in h:
                h[x] = xxhash.xxh64_intdigest(x)
        n = len(w)
        if n < self.k:
            return np.zeros(0, dtype=np.uint64), n
        a = np.fromiter(map(h.__getitem__, w), dtype=np.uint64, count=n)
        m = n - self.k + 1
        out = np.zeros(m, dtype=np.uint64)
        for j in range(self.k):
            out = (out ^ (out >> np.uint64(29))) * _P + a[j : j + m]
        out = (out ^ (out >> np.uint64(32))) * _P
        return np.unique(out ^ (out >> np.uint64(29))), n

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The least value of the hashes under each of the linear functions;
        the hashes are mixed already, so these need no more mixing."""
        best = np.full(len(self.mul), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(hashes), 512):
            x = np.multiply.outer(self.mul, hashes[i : i + 512])
            x += self.add[:, None]
            np.minimum(best, x.min(1), out=best)
        return best


def signatures(df: DataFrame, key: str, text: str, shingle: int, minima: int, coordinates: int, min_words: int, size: int = 2) -> DataFrame:
    """(key, hashes, minima, coords) of the texts of at least `min_words`
    words: the sorted distinct shingles, by which equal texts are told, the
    packed minima, and the coordinates of the signature."""
    cols = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        s = Shingler(shingle, minima, coordinates, size)
        for b in batches:
            keys, parts = [], ([], [], [])
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    continue
                h, n = s.hashes(t)
                if n >= min_words and len(h):
                    m = s.minima(h)
                    keys.append(k)
                    for x, y in zip(parts, (h.view(np.int64), s.packed(m).view(np.int64), s.coordinates(m).view(np.int64))):
                        x.append(y)
            ends = lambda a: pa.array(np.concatenate([[0], np.cumsum([len(x) for x in a])]).astype(np.int32))
            flat = lambda a, t: pa.array(np.concatenate(a) if a else np.zeros(0, t))
            lists = [pa.ListArray.from_arrays(ends(a), flat(a, np.int64)) for a in parts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *lists], names=["key", "hashes", "minima", "coords"])

    kind = cols.schema["key"].dataType.simpleString()
    return cols.mapInArrow(run, f"key {kind}, hashes array<bigint>, minima array<bigint>, coords array<bigint>")


def match_threshold(threshold: float, coordinates: int, size: int, deviations: float = 3.6) -> int:
    """The coordinates that texts right at the threshold agree in, but for so
    many standard deviations; one at least."""
    p = threshold**size
    return max(1, int(coordinates * p - deviations * (coordinates * p * (1 - p)) ** 0.5))


def prefix_hits(reps: DataFrame, min_match: int) -> DataFrame:
    """(a, b, met), a < b: the pairs of reps (rep, coords) that meet in their
    prefixes and how often, each once: among them every pair that agrees in
    `min_match` coordinates."""
    posts = reps.select("rep", F.explode("coords").alias("value"))
    # counted where they are before the shuffle; values of one text drop out
    often = posts.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    posts = posts.join(often, "value")
    by_text = Window.partitionBy("rep")  # at most one row a coordinate
    posts = posts.withColumn("n", F.count("*").over(by_text)).withColumn("r", F.row_number().over(by_text.orderBy("df", "value")))
    prefix = posts.where((F.col("n") >= min_match) & (F.col("r") <= F.col("n") - min_match + 1)).select("rep", "value")
    a, b = prefix.withColumnRenamed("rep", "a"), prefix.withColumnRenamed("rep", "b")
    return a.join(b, "value").where("a < b").groupBy("a", "b").agg(F.count("*").alias("met"))


def agreeing(hits: DataFrame, reps: DataFrame, least: int, minima: int) -> DataFrame:
    """The hits whose MinHashes can agree in `least` of their `minima` places,
    what the prefixes skipped merged in: four bits of each tell, and never too
    few. Whole numbers are compared at a time."""
    words = minima // 16
    side = lambda x: reps.select(F.col("rep").alias(x), *[F.col("minima")[k].alias(f"{x}{k}") for k in range(words)])
    both = hits.join(side("a"), "a").join(side("b"), "b")

    def differing(k: int) -> Column:
        x = F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))

    other = functools.reduce(operator.add, [differing(k) for k in range(words)])
    return both.where(other <= minima - least).select("a", "b")


def verified(hits: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the hits that have the similarity, exactly. Only
    texts that some hit names are shuffled."""
    named = hits.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    r = cut(reps.join(named, "rep", "left_semi").select("rep", "hashes"))
    side = lambda x: r.select(F.col("rep").alias(x), F.col("hashes").alias(f"h{x}"))
    both = hits.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("ha", "hb")))
    jaccard = F.col("shared") / (F.size("ha") + F.size("hb") - F.col("shared"))
    return both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def similar(df: DataFrame, key: str, text: str, threshold: float, shingle: int = 5, min_words: int = 0, minima: int = 128, coordinates: int = 64, min_match: int | None = None, size: int = 2, sigmas: float | None = 4.2) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, jaccard) of representatives with a
    Jaccard similarity of at least `threshold` between their sets of runs of
    `shingle` words, and members (rep, key) of every text that takes part.
    Keys must be unique. Texts of equal shingle sets share a representative
    (their smallest key), however many they are; null texts and those of fewer
    than `min_words` words, or without a run, take no part.

    Texts are compared that agree in `min_match` of the coordinates (None: as
    match_threshold() has it) and, in four bits of their minima, in no fewer
    than `sigmas` standard deviations below the number expected at the
    threshold (None: whatever the number). Of pairs right at a threshold of 0.6
    about one in 30,000 is missed (simulated).
    """
    min_match = min_match or match_threshold(threshold, coordinates, size)
    s = signatures(over_all_cores(df), key, text, shingle, minima, coordinates, min_words, size)
    s = cut(s.withColumn("same", F.struct(F.xxhash64("hashes"), F.xxhash64(F.lit("again"), "hashes"), F.size("hashes"))))
    first = s.groupBy("same").agg(F.min("key").alias("rep"))
    members = s.select("key", "same").join(first, "same").select("rep", "key")
    # the long columns move once, and then only those of texts that have a hit
    only = first.select(F.col("rep").alias("key"))
    reps = lambda c: s.select("key", c).join(only, "key", "left_semi").withColumnRenamed("key", "rep")
    hits = prefix_hits(reps("coords"), min_match)
    if sigmas is not None:
        same = threshold + (1 - threshold) / 16
        hits = agreeing(hits, reps("minima"), max(1, int(minima * same - sigmas * (minima * same * (1 - same)) ** 0.5)), minima)
    return verified(cut(hits.select("a", "b")), s.select(F.col("key").alias("rep"), "hashes"), threshold), members


def found(terms: DataFrame, threshold: float = 0.6, shingle: int = 3, min_words: int = 20) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: each pair of rows of terms of different
    meta.source whose texts, folded, overlap by `threshold` or more. Rows of a
    null source differ from rows of any source but not from each other. Pairs
    of copies are listed too, as the definition asks for each pair of rows."""
    t = with_fold(terms.select("chunk_id", "text"), "text", "folded")
    pairs, members = similar(t, "chunk_id", "folded", threshold, shingle, min_words)
    m = cut(members.join(terms.select(F.col("chunk_id").alias("key"), F.coalesce(F.col("meta.source"), F.lit("")).alias("source")), "key"))
    ma = m.select(F.col("rep").alias("a"), F.col("key").alias("ka"), F.col("source").alias("sa"))
    mb = m.select(F.col("rep").alias("b"), F.col("key").alias("kb"), F.col("source").alias("sb"))
    across = pairs.join(ma, "a").join(mb, "b").where("sa <> sb").select("ka", "kb")
    within = ma.join(mb.withColumnRenamed("b", "a"), "a").where("ka < kb and sa <> sb").select("ka", "kb")
    return across.unionByName(within).select(F.least("ka", "kb").alias("chunk_id_a"), F.greatest("ka", "kb").alias("chunk_id_b"))


def groups(terms: DataFrame, threshold: float = 0.6, shingle: int = 3, min_words: int = 20) -> DataFrame:
    """A row per chunk with the class of near-copies it belongs to: chunk_id,
    class_id (the smallest chunk_id of the class), class_size, and n_links, the
    number of different texts it is linked with. Texts are as similar as
    found() says, of whatever source. Chunks that take no part are classes of
    their own."""
    t = with_fold(terms.select("chunk_id", "text"), "text", "folded")
    pairs, members = similar(t, "chunk_id", "folded", threshold, shingle, min_words)
    pairs, members = cut(pairs), cut(members)
    comp = components(pairs, members.select(F.col("rep").alias("node")).distinct())
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    m = members.join(comp.withColumnRenamed("node", "rep"), "rep").join(links, "rep", "left")
    size = m.groupBy("component").agg(F.count("*").alias("class_size"))
    m = m.join(size, "component").select(F.col("key").alias("chunk_id"), F.col("component").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rest = terms.select("chunk_id").join(m.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.col("chunk_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_links"))
    return m.unionByName(rest)


def representative_pairs(terms: DataFrame, threshold: float = 0.6, shingle: int = 3, min_words: int = 20) -> DataFrame:
    """(rep_a, rep_b, jaccard), rep_a < rep_b: the pairs of different texts that
    are as similar as found() says, each text named by its smallest chunk_id.
    With membership() it holds every link; copies are not expanded into pairs."""
    t = with_fold(terms.select("chunk_id", "text"), "text", "folded")
    return similar(t, "chunk_id", "folded", threshold, shingle, min_words)[0].select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "jaccard")


def membership(terms: DataFrame, shingle: int = 3, min_words: int = 20) -> DataFrame:
    """(chunk_id, rep): the text that each chunk of min_words words or more is a
    copy of, by its set of shingles; its own where there is no other."""
    t = with_fold(terms.select("chunk_id", "text"), "text", "folded")
    s = signatures(over_all_cores(t), "chunk_id", "folded", shingle, 16, 1, min_words)
    s = cut(s.select("key", F.struct(F.xxhash64("hashes"), F.xxhash64(F.lit("again"), "hashes"), F.size("hashes")).alias("same")))
    return s.join(s.groupBy("same").agg(F.min("key").alias("rep")), "same").select(F.col("key").alias("chunk_id"), "rep")
