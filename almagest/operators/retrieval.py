"""Ranked retrieval: BM25, nearest vectors, fusion of rankings, reranking.

Queries are a set of rows; all of them are answered in one plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.session import cut

# BM25 saturation, length weight and floor of the inverse document frequency; the constant and weights of rank fusion.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, W_FIRST, W_SECOND = 60, 1.0, 0.5
#: Queries of a block that documents or vectors meet at once.
QUERY_BLOCK = 8192
#: Scores of a tile of queries and documents, its most documents, and the share of its cells from which a token is worth a column.
CELLS, MOST_TILE, DENSE = 1 << 22, 2048, 0.005
#: Best score below which an answer is weak, and the places of a hashed vector.
WEAK, PLACES = 0.3, 64


def tokens(text: Column) -> Column:
    """What stands between blanks, in lower case letter by letter: a sigma does not depend on its place."""
    return F.filter(F.split(F.lower(F.translate(text, "Σ", "σ")), r"(?U)\s+"), lambda w: w != "")


def top_per_query(scored: DataFrame, score: str, n: int) -> DataFrame:
    """The n rows of highest score of each query_id, ties to the smaller id,
    with their rank from 1. Spark limits the groups before it shuffles them."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def frequencies(docs: DataFrame) -> DataFrame:
    """(token, df, dl) of docs (id, text), written once: the number of documents
    with each token; the row of the null token has the number of documents and
    the sum of their lengths. Tokens are counted where their text lies."""
    w = docs.select(tokens(F.coalesce("text", F.lit(""))).alias("w"))
    t = w.select(F.size("w").cast("bigint").alias("dl"), F.explode(F.array_append(F.array_distinct("w"), F.lit(None).cast("string"))).alias("token"))
    return cut(t.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.when(F.col("token").isNull(), F.col("dl"))).alias("dl")))


def _weighed(bags: DataFrame, seen: DataFrame) -> tuple[DataFrame, float]:
    """(b, words, weights) of bags (b, bag), words joined by blanks, and the mean
    length of the documents that `seen` counts. A token repeated in a bag counts
    as often; a negative inverse document frequency is replaced by EPSILON times
    the mean one; tokens of no document are dropped, bags are not."""
    whole = seen.where("token is null").first()  # one row
    n, length = (whole.df, whole.dl) if whole else (0, 0)
    idf = seen.where("token is not null").select("token", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf")).first()[0] or 0.0  # one row
    q = bags.select("b", F.explode_outer("bag").alias("token")).groupBy("b", "token").agg(F.count("*").alias("qtf"))
    weight = F.col("qtf") * F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf"))
    one = F.when(F.col("idf").isNotNull(), F.struct("token", weight.alias("w")))
    packed = q.join(idf, "token", "left").groupBy("b").agg(F.collect_list(one).alias("x"))  # a query
    return packed.select("b", F.array_join(F.col("x.token"), " ").alias("words"), F.col("x.w").alias("weights")), length / n if length else 1.0


class _Best:
    """The n best documents that each query of a block has met so far."""

    def __init__(self, ids: list, n: int):
        self.ids, self.n = pa.concat_arrays(ids).to_numpy(), n
        self.tile = min(MOST_TILE, max(64, CELLS // len(self.ids)))
        self.q, self.id, self.score, self.key = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.least = np.full(len(self.ids), -np.inf)

    def take(self, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores by query and document; the documents are in order of their
        ids and follow those met before. What is not finite takes no part."""
        size, key = len(ids), np.round(score, 6)
        key[~np.isfinite(key)] = -np.inf
        # a later document of the same score has the larger id
        better = key > self.least[:, None]
        if not len(self.q) and size > self.n:
            better &= key >= np.partition(key, size - self.n, axis=1)[:, size - self.n, None]
        q, d = np.nonzero(better)
        if not len(q):
            return
        q, i, s, k = (np.concatenate(x) for x in ((self.q, q), (self.id, ids[d]), (self.score, score[q, d]), (self.key, key[q, d])))
        order = np.lexsort((i, -k, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, rank = order[rank < self.n], q[rank < self.n], rank[rank < self.n]
        self.q, self.id, self.score, self.key = q, i[order], s[order], k[order]
        full = rank == self.n - 1
        self.least[q[full]] = self.key[full]

    def best(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.q]), pa.array(self.id), pa.array(self.score)], names=["query_id", "id", "score"])


def _meetings(queries: DataFrame, docs: DataFrame, make: Callable[..., _Best]) -> DataFrame:
    """(query_id, id, score): the best of each part of docs (id, ...) for
    queries (query_id, ...) with the same further columns. Documents are dealt
    out to parts; in each, blocks of QUERY_BLOCK queries, of which `make` gets
    the columns in pieces, meet all of its documents tile by tile. Queries are a
    stated set, written once."""
    asked = cut(queries)
    parts, blocks = 2 * docs.sparkSession.sparkContext.defaultParallelism, max(1, -(-asked.count() // QUERY_BLOCK))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    more = [x for x in docs.columns if x != "id"]
    q = asked.select(every(parts).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("query_id").cast("bigint").alias("id"), *more)
    d = docs.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"), F.lit(1).alias("kind"), F.col("id").cast("bigint").alias("id"), *more)
    rows = q.unionByName(d).repartitionById(parts, "part").sortWithinPartitions("block", "kind", "id").select("block", "kind", "id", *more)

    def run(batches):
        block, heard, now = None, [], None
        for batch in batches:
            at = np.column_stack([batch.column(k).to_numpy() for k in (0, 1)])
            ends = [*(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)] if len(at) else []
            for lo, hi in zip([0, *ends], ends):
                if at[lo, 0] != block:
                    if now is not None:
                        yield now.best()
                    block, heard, now = at[lo, 0], [], None
                ids, *rest = (x.slice(lo, hi - lo) for x in batch.columns[2:])
                if at[lo, 1] == 0:
                    heard.append((ids, *rest))
                    continue
                if now is None and heard:
                    now, heard = make(*zip(*heard)), []
                for k in range(0, hi - lo, now.tile) if now is not None else ():
                    now.meet(ids.slice(k, now.tile).to_numpy(), *(x.slice(k, now.tile) for x in rest))
        if now is not None:
            yield now.best()

    return rows.mapInArrow(run, "query_id bigint, id bigint, score double")


class _Asked(_Best):
    """Queries as weighed words, by BM25."""

    def __init__(self, ids: list, words: list, weights: list, n: int, mean_length: float):
        super().__init__(ids, n)
        self.mean_length, self.place = mean_length, None
        flat, row = _split(pa.concat_arrays(words))
        coded = flat.dictionary_encode()
        self.vocabulary, token = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(token, kind="stable")
        self.row, self.weight = row[order], pa.concat_arrays(weights).flatten().to_numpy(zero_copy_only=False)[order]
        self.count = np.bincount(token, minlength=len(self.vocabulary))
        self.start = np.cumsum(self.count) - self.count

    def _columns(self, token: np.ndarray, size: int) -> None:
        """Tokens that many queries and many documents of the first tile hold
        become columns of a matrix; the others are added posting by posting."""
        cells = self.count * np.bincount(token, minlength=len(self.count))
        most = np.argsort(-cells, kind="stable")[: max(1, 2 * CELLS // len(self.ids))]
        most = most[cells[most] > DENSE * len(self.ids) * size]
        self.place = np.full(len(self.count), -1)
        self.place[most] = np.arange(len(most))
        self.matrix = np.zeros((len(self.ids), len(most)))
        for k, t in enumerate(most):
            at = slice(self.start[t], self.start[t] + self.count[t])
            self.matrix[self.row[at], k] = self.weight[at]

    def meet(self, ids: np.ndarray, words: pa.Array, _: pa.Array | None = None) -> None:
        size = len(ids)
        flat, doc = _split(words)
        length = np.bincount(doc, minlength=size)
        token = pc.index_in(flat, value_set=self.vocabulary)
        known = token.is_valid().to_numpy(zero_copy_only=False)
        pair, tf = np.unique(token.drop_null().to_numpy().astype(np.int64) * size + doc[known], return_counts=True)
        token, doc = pair // size, pair % size
        value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / self.mean_length))
        if self.place is None:
            self._columns(token, size)
        place = self.place[token]
        inside = place >= 0
        columns = np.zeros((self.matrix.shape[1], size))
        columns[place[inside], doc[inside]] = value[inside]
        score = self.matrix @ columns
        token, doc, value = token[~inside], doc[~inside], value[~inside]
        ends = np.cumsum(self.count[token])
        at = 0
        while at < len(token):  # postings in steps of about CELLS / 4
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS // 4, "right")))
            count = self.count[token[at:to]]
            of = np.repeat(np.arange(at, to), count)
            posting = self.start[token[of]] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            np.add.at(score.reshape(-1), self.row[posting] * size + doc[of], self.weight[posting] * value[of])
            at = to
        self.take(ids, score)


def _split(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts joined by single blanks, and the place of the text of each."""
    lists = pc.split_pattern(words, " ")
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.not_equal(flat, "")
    return flat.filter(some), row[some.to_numpy(zero_copy_only=False)]


def bm25_top(docs: DataFrame, queries: DataFrame, n: int, allowed: DataFrame | Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): the n best docs (id, text) of each query
    (query_id, text), of those that `allowed` (rows of ids, or a condition on
    docs) names, scores compared to six places. Frequencies are of all
    documents, whatever is allowed. Documents that share no token with a query
    score 0 and are ranked with the others, ties to the smaller id. Null texts
    are empty.

    Queries of the same words are answered once."""
    bags = queries.select("query_id", F.array_sort(tokens(F.coalesce("text", F.lit("")))).alias("bag"))
    first = bags.groupBy("bag").agg(F.min("query_id").alias("b"))
    weighed, mean_length = _weighed(first, frequencies(docs))
    d = docs if allowed is None else docs.where(allowed) if isinstance(allowed, Column) else docs.join(allowed, "id", "left_semi")
    d = d.select("id", F.array_join(tokens(F.coalesce("text", F.lit(""))), " ").alias("words"), F.lit(None).cast("array<double>").alias("weights"))
    best = _meetings(weighed.withColumnRenamed("b", "query_id"), d, lambda ids, words, weights: _Asked(ids, words, weights, n, mean_length))
    best = top_per_query(best.withColumn("r", F.round("score", 6)), "r", n).select(F.col("query_id").alias("b"), "id", "score", "rank")
    return bags.join(first, "bag").select("query_id", "b").join(best, "b").select("query_id", "id", "score", "rank")


def hashed_vectors(df: DataFrame, key: str, text: str, places: int = PLACES) -> DataFrame:
    """(key, embedding): the words of a text hashed to signed places, of length
    1; a stand-in for an encoder. A text without words gives null."""
    kind = df.schema[key].dataType.simpleString()
    hashes = df.select(key, F.transform(tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)).alias("h"))

    def run(batches):
        for batch in batches:
            h, n = batch.column(1), batch.num_rows
            row, h = np.repeat(np.arange(n), pc.list_value_length(h).to_numpy(zero_copy_only=False)), h.flatten().to_numpy(zero_copy_only=False)
            sums = np.bincount(row * places + h % places, np.where(h & (1 << 40) == 0, 1.0, -1.0), n * places).reshape(n, places)
            norm = np.sqrt((sums * sums).sum(axis=1))
            some = norm > 0
            vectors = (sums[some] / norm[some, None]).ravel()
            ends = np.concatenate([[0], np.cumsum(some * places)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(vectors), mask=pa.array(~some))], names=[key, "embedding"])

    return hashes.mapInArrow(run, f"{key} {kind}, embedding array<double>")


def similarity_score(distance: Column) -> Column:
    """A cosine distance in [0, 2] as a score in [0, 1], to four places."""
    return F.round(F.greatest(F.lit(0.0), 1 - distance / 2), 4)


def priority_of(doc_source: Column, weights: dict[str, float]) -> Column:
    """The factor of a collection, 1 where none is named."""
    return F.coalesce(*[F.when(doc_source == k, F.lit(float(v))) for k, v in weights.items()], F.lit(1.0))


class _Near(_Best):
    """Queries as vectors, by cosine."""

    def __init__(self, ids: list, vectors: list, n: int):
        super().__init__(ids, n)
        self.matrix = self._unit(pa.concat_arrays(vectors))

    @staticmethod
    def _unit(vectors: pa.Array) -> np.ndarray:
        m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return m / np.linalg.norm(m, axis=1)[:, None]

    def meet(self, ids: np.ndarray, vectors: pa.Array) -> None:
        with np.errstate(invalid="ignore"):
            self.take(ids, np.round(self.matrix @ self._unit(vectors).T, 6))


def knn(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, rank, cos): the n vectors (id, embedding) of greatest
    cosine to each query (query_id, embedding), exactly, to six places, ties to
    the smaller id. A null or zero vector takes no part."""
    q, v = (x.select(k, F.col("embedding").cast("array<double>").alias("e")).where("e is not null") for x, k in ((queries, "query_id"), (vectors, "id")))
    best = _meetings(q, v, lambda ids, e: _Near(ids, e, n)).withColumnRenamed("score", "cos")
    return top_per_query(best, "cos", n).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), "cos")


def rrf(first: DataFrame, second: DataFrame, w_first: float = W_FIRST, w_second: float = W_SECOND) -> DataFrame:
    """(query_id, id, score, in_first) of two rankings (query_id, id, rank):
    the sum of weight / (RRF_K + rank) over the rankings that hold the row."""
    a = first.select("query_id", "id", F.col("rank").alias("ra"))
    b = second.select("query_id", "id", F.col("rank").alias("rb"))
    part = lambda r, w: F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))
    return a.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", (part("ra", w_first) + part("rb", w_second)).alias("score"), F.col("ra").isNotNull().alias("in_first"))


def rerank(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], n: int, priority: Column | None = None) -> DataFrame:
    """The n best of candidates (query_id, id, query, text) by the scorer, a
    function over batches of queries and texts, squashed to (0, 1) and times a
    priority. Candidates should be cut to a few per query before."""
    udf = F.pandas_udf(scorer, "double")
    conf = 1 / (1 + F.exp(-udf("query", "text"))) * (F.lit(1.0) if priority is None else priority)
    return top_per_query(candidates.withColumn("confidence", F.round(conf, 4)), "confidence", n)


def overlap_scorer(query: pd.Series, text: pd.Series) -> pd.Series:
    """A stand-in for a learned scorer: the share of the query's words in the text, as a logit."""
    out = []
    for q, t in zip(query, text):
        a, b = set(q.lower().split()), set(t.lower().split())
        out.append(8 * len(a & b) / max(1, len(a)) - 4)
    return pd.Series(out, dtype=float)


def retrieve(chunks: DataFrame, queries: DataFrame, scorer: Callable = overlap_scorer, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, n: int = 5, pool: int = 20, window: int = 0, priority: Column | None = None, allowed: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, source, chunk_index, confidence, passage, weak) of
    queries (query_id, text) over chunks (chunk_id, source, chunk_index, text,
    doc_source): the best `pool` by BM25 and, where vectors are given, by
    cosine, fused by rank, cut to `pool`, reranked by the scorer times the
    priority, the best n widened by `window` neighbours. Frequencies are of all
    chunks; `allowed` (id) filters after scoring. `weak` marks queries whose
    best confidence is below WEAK. `more` (query_id, more), where given, are
    appended to what BM25 is asked."""
    from almagest.operators.documents import with_neighbours

    docs = chunks.select(F.col("chunk_id").alias("id"), "text")
    asked = queries if more is None else queries.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))
    words = bm25_top(docs, asked, pool, allowed).select("query_id", "id", "rank")
    within = vectors if vectors is None or allowed is None else vectors.join(allowed, "id", "left_semi")
    sense = knn(within, query_vectors, pool).select("query_id", "id", "rank") if within is not None else words.limit(0)
    fused = rrf(sense, words).withColumn("s", F.round("score", 6) + F.col("in_first").cast("int") * 1e-9)
    few = cut(top_per_query(fused, "s", pool).select("query_id", "id"))  # pool rows a query
    c = few.join(chunks.select(F.col("chunk_id").alias("id"), "source", "chunk_index", "text", "doc_source"), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    best = rerank(c, scorer, n, priority).select("query_id", "rank", "id", "source", "chunk_index", "confidence")
    best = cut(best).withColumn("weak", F.max("confidence").over(Window.partitionBy("query_id")) < WEAK)  # n rows a query
    return best.join(with_neighbours(best, chunks, window), ["source", "chunk_index"]).select("query_id", "rank", "id", "source", "chunk_index", "confidence", "passage", "weak")
