"""Splitting oversized texts at natural boundaries.

Lexical cohesion decides where to cut: the words before and after each gap are
compared as sliding blocks, which gives a curve of similarity over the whole
text, and its valleys mark changes of topic. Within the window in which the next
cut must fall, each end of a paragraph, line, sentence or word counts with the
depth of the valley it lies in and a bonus for its kind; the best is taken, of
equals the last. Where the window has no such end, the last one of the best kind
before it is taken, and any character if there is none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in the block on each side of a gap, and the least part of the limit that a piece fills where a boundary allows it.
BLOCK_WORDS, LEAST_FILL = 40, 0.5
#: Kinds of boundaries and what each adds to the depth of its valley, which is at most 2.
KINDS, BONUS = ("paragraph", "line", "sentence", "word"), (0.8, 0.5, 0.3, 0.0)

_WORDS = re.compile(r"\w+")
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:(?:\r\n|\n|\r)[^\S\r\n]*)+")
_LINE = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+")
_SPACE = re.compile(r"\s+")


def boundaries(text: str) -> list[list[int]]:
    """Ends of paragraphs, lines, sentences and words: positions at which the
    next piece may begin, each kind with the better ones in it."""
    out: list[list[int]] = []
    seen: set[int] = set()
    for kind in (_PARAGRAPH, _LINE, _SENTENCE, _SPACE):
        seen |= {m.end() for m in kind.finditer(text)}
        out.append(sorted(seen))
    return out


def cohesion(ids: np.ndarray, block: int = BLOCK_WORDS) -> np.ndarray:
    """The cosine of the word counts of the `block` words before and after each
    gap k, which lies before word k; 0 at both ends. Each pair of equal words is
    added to the ranges of gaps that have it within or across their blocks."""
    n = len(ids)
    dot, left, right = (np.zeros(n + 2, dtype=np.int64) for _ in range(3))

    def add(to: np.ndarray, first: np.ndarray, last: np.ndarray, amount: int) -> None:
        first, last = np.maximum(first, 0), np.minimum(last, n)
        ok = first <= last
        np.add.at(to, first[ok], amount)
        np.add.at(to, last[ok] + 1, -amount)

    at = np.arange(n)
    add(left, at + 1, at + block, 1)
    add(right, at - block + 1, at, 1)
    order = np.argsort(ids, kind="stable")
    for lag in range(1, n):
        i, j = order[:-lag], order[lag:]
        near = (ids[i] == ids[j]) & (j - i < 2 * block)
        if not near.any():
            break
        i, j = i[near], j[near]
        add(dot, np.maximum(i + 1, j - block + 1), np.minimum(j, i + block), 1)
        within = j - i < block
        i, j = i[within], j[within]
        add(left, j + 1, i + block, 2)
        add(right, j - block + 1, i, 2)
    d, a, b = (np.cumsum(x)[: n + 1] for x in (dot, left, right))
    return np.where((a > 0) & (b > 0), d / np.sqrt(np.maximum(a, 1) * np.maximum(b, 1)), 0.0)


def depths(curve: np.ndarray, reach: int = BLOCK_WORDS) -> np.ndarray:
    """How deep each gap lies below the highest similarity within `reach` gaps
    on either side, both added up."""
    if not len(curve):
        return curve
    padded = np.concatenate([np.zeros(reach), curve, np.zeros(reach)])
    highest = np.lib.stride_tricks.sliding_window_view(padded, reach + 1).max(axis=1)
    return np.maximum(highest[: len(curve)] - curve, 0) + np.maximum(highest[reach : reach + len(curve)] - curve, 0)


class Valleys:
    """The depth of the valley at positions of a text."""

    def __init__(self, text: str):
        found = [(m.start(), m.group().lower()) for m in _WORDS.finditer(text)]
        index: dict[str, int] = {}
        self.starts = [s for s, _ in found]
        self.depth = depths(cohesion(np.array([index.setdefault(w, len(index)) for _, w in found], dtype=np.int64)))

    def at(self, position: int) -> float:
        return round(float(self.depth[bisect_left(self.starts, position)]), 9)


def _safe(text: str, cut: int) -> int:
    """A cut between two characters that belong together moves before them:
    a carriage return and its line feed, a letter and its accents."""
    k = cut
    while k > 0 and k < len(text) and (text[k - 1 : k + 1] == "\r\n" or "̀" <= text[k] <= "ͯ" or text[k] in "‍️" or text[k - 1] == "‍"):
        k -= 1
    return k


def cuts(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int, str | None, float | None]]:
    """(start, end, kind, valley) of the pieces of a text in code points, in
    order: by which kind of boundary a piece ends (None: by none, or with the
    text) and how deep the valley is there. Every piece has at most `max_chars`;
    consecutive ones share exactly `overlap_chars` (less where a smaller limit
    makes that impossible); together they cover the text. A text within the
    limit is one piece.
    """
    n = len(text)
    max_chars = max(1, max_chars)
    overlap = max(0, min(overlap_chars, max_chars - 1, max_chars // 2))
    if n <= max_chars:
        return [(0, n, None, None)]
    kinds, valleys = boundaries(text), Valleys(text)
    best_kind = {p: k for k in range(len(kinds) - 1, -1, -1) for p in kinds[k]}
    out, start = [], 0
    while n - start > max_chars:
        hi = start + max_chars
        lo = start + max(overlap + 1, int(max_chars * LEAST_FILL))
        window = kinds[-1][bisect_left(kinds[-1], lo) : bisect_right(kinds[-1], hi)]
        # of equals the last, which leaves fewer pieces
        cut = max(window, key=lambda p: (valleys.at(p) + BONUS[best_kind[p]], p), default=0)
        if not cut:
            # a run without a boundary fills the window: end before it, at the last of the best kind
            for ends in kinds:
                k = bisect_left(ends, lo)
                if k and ends[k - 1] > start + overlap:
                    cut = ends[k - 1]
                    break
        kind, valley = (KINDS[best_kind[cut]], valleys.at(cut)) if cut else (None, None)
        if not cut:
            cut = _safe(text, hi)
            if cut <= start + overlap:
                cut = hi
        out.append((start, cut, kind, valley))
        start = cut - overlap
    out.append((start, n, None, None))
    return out


def pieces(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text."""
    return [(a, z) for a, z, _, _ in cuts(text, max_chars, overlap_chars)]


def split(terms: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of each row of terms: chunk_id, piece (0 on), n_pieces,
    start, end (code points of the text as stored), text, section_path,
    chunk_index, source, max_chars, overlap_chars, and of a piece that ends
    before its text does cut_kind and valley (see cuts()).

    The limit is that of meta.doc_source, the row `default` serving null and
    unlisted ones. Texts within the limit pass through in the JVM as one piece;
    only longer ones go to Python, which reads them whole. A null text gives
    no piece, an empty one a single empty piece; repeated rows come out each.
    Limits are a handful of rows.
    """
    t = terms.select("chunk_id", "text", F.col("meta.section_path").alias("section_path"), F.col("meta.chunk_index").alias("chunk_index"), F.col("meta.source").alias("source"), F.coalesce("meta.doc_source", F.lit("default")).alias("doc_source"))
    lim = limits.groupBy("doc_source").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("own"))
    default = lim.where("doc_source = 'default'").agg(F.first("own").alias("default"))
    t = t.join(lim, "doc_source", "left").crossJoin(F.broadcast(default))  # one row
    t = t.withColumn("own", F.coalesce("own", "default")).select("chunk_id", "text", "section_path", "chunk_index", "source", F.col("own.max_chars").alias("max_chars"), F.col("own.overlap_chars").alias("overlap_chars"))
    t = t.where("text is not null")
    long = F.length("text") > F.col("max_chars")
    fits = t.where(~F.coalesce(long, F.lit(False))).select(
        "chunk_id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.length("text").alias("end"), "text", "section_path", "chunk_index", "source", "max_chars", "overlap_chars",
        F.lit(None).cast("string").alias("cut_kind"), F.lit(None).cast("double").alias("valley"),
    )

    names, schema = fits.columns, fits.schema

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
                rows, new = [], {c: [] for c in ("piece", "n_pieces", "start", "end", "text", "cut_kind", "valley")}
                for row, (text, most, over) in enumerate(zip(get("text"), get("max_chars"), get("overlap_chars"))):
                    spans = cuts(text, most, over)
                    rows += [row] * len(spans)
                    for k, (a, z, kind, valley) in enumerate(spans):
                        for c, v in zip(new, (k, len(spans), a, z, text[a:z], kind, valley)):
                            new[c].append(v)
                kept = b.take(pa.array(rows, pa.int64()))
                types = {"text": pa.string(), "cut_kind": pa.string(), "valley": pa.float64()}
                yield pa.RecordBatch.from_arrays([pa.array(new[c], types.get(c, pa.int32())) if c in new else kept.column(kept.schema.get_field_index(c)) for c in names], names=names)

    return fits.unionByName(t.where(long).mapInArrow(run, schema))


def found(terms: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id) of the rows that come out in more than one piece."""
    return split(terms, limits).where("n_pieces > 1 and piece = 0").select("chunk_id")


def cut_report(terms: DataFrame, limits: DataFrame) -> DataFrame:
    """(cut_kind, n_cuts, n_valleys, mean_valley): by which boundaries texts were
    cut, and how many of these lie in a valley of the similarity curve."""
    p = split(terms, limits).where("piece < n_pieces - 1")
    return p.groupBy(F.coalesce("cut_kind", F.lit("none")).alias("cut_kind")).agg(F.count("*").alias("n_cuts"), F.count_if(F.col("valley") > 0.1).alias("n_valleys"), F.avg("valley").alias("mean_valley"))


def cover(split_rows: DataFrame) -> DataFrame:
    """(chunk_id, n_chars, fits): of each chunk of split() how many characters
    its pieces hold, overlaps counted once, and whether all keep the limit. Each
    piece tells its own share, so nothing is put in order."""
    first = F.col("piece") == 0
    own = F.col("end") - F.col("start") - F.when(first, 0).otherwise(F.least(F.col("overlap_chars"), F.col("max_chars") - 1, F.floor(F.col("max_chars") / 2).cast("int")))
    p = split_rows.select("chunk_id", own.alias("own"), ((F.length("text") == F.col("end") - F.col("start")) & ((F.col("end") - F.col("start") <= F.col("max_chars")))).alias("ok"))
    return p.groupBy("chunk_id").agg(F.sum("own").cast("bigint").alias("n_chars"), F.bool_and("ok").alias("fits"))
