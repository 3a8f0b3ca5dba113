"""BM25 by blocks of queries and tiles of documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from almagest.operators import retrieval


def brute(docs, text, n):
    """The n best (id, score) of docs {id: text}, those of no score by id."""
    words = {i: t.lower().split() for i, t in docs.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(len(docs) - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean, length = sum(idf.values()) / len(idf), sum(map(len, words.values())) / len(docs)
    score = {}
    for i, ws in words.items():
        tf = Counter(ws)
        score[i] = round(sum((0.25 * mean if idf[w] < 0 else idf[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / length)) for w in text.lower().split() if w in tf), 6)
    return sorted(((i, s) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:n]


def made(k, n_words, seed):
    r = random.Random(seed)
    return {7 * i % 1009: " ".join(f"w{min(int(r.expovariate(0.08)), 60)}" for _ in range(r.randint(0, n_words))) for i in range(k)}


def test_all_ranks_are_those_of_single_queries(spark):
    docs, asked = made(300, 12, 1), {1: "W1 w40 w40", 2: "w3 w2 w1", 3: "w1 w2 w3", 4: "", 5: "unknown", 6: "w60 unknown w0"}
    top = retrieval.bm25_top(spark.createDataFrame(list(docs.items()), "id bigint, text string"), spark.createDataFrame(list(asked.items()), "query_id bigint, text string"), 7)
    got = sorted(top.collect(), key=lambda r: (r.query_id, r["rank"]))
    for q, text in asked.items():
        assert [(r.id, round(r.score, 6)) for r in got if r.query_id == q] == brute(docs, text, 7)
    few = retrieval.bm25_top(spark.createDataFrame(list(docs.items()), "id bigint, text string"), spark.createDataFrame(list(asked.items()), "query_id bigint, text string"), 7, allowed=retrieval.F.col("id") < 20).collect()
    by_rows = retrieval.bm25_top(spark.createDataFrame(list(docs.items()), "id bigint, text string"), spark.createDataFrame(list(asked.items()), "query_id bigint, text string"), 7, allowed=spark.createDataFrame([(i,) for i in docs if i < 20], "id bigint")).collect()
    key = lambda rows: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in rows)
    assert key(few) == key(by_rows) and max(r.id for r in few) < 20


def test_the_plan_joins_no_postings(spark):
    """Pairs of queries and documents are neither joined nor shuffled, so the driver holds a plan of few steps."""
    docs = spark.createDataFrame(list(made(50, 9, 2).items()), "id bigint, text string")
    plan = retrieval.bm25_top(docs, docs.withColumnRenamed("id", "query_id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) <= 8 and "BroadcastNestedLoopJoin" not in plan


def test_tiles_give_what_one_matrix_gives():
    docs, texts = made(400, 15, 3), [t for t in made(30, 20, 4).values() if t]
    ids = sorted(docs)
    whole = None
    for tile, dense in ((1000, 0.0), (1000, 2.0), (64, 0.005), (5, 0.3)):
        words = pa.array([docs[i] for i in ids])
        bags = [Counter(t.split()) for t in texts]
        old, retrieval.DENSE = retrieval.DENSE, dense
        try:
            x = retrieval._Asked([pa.array(range(len(texts)))], [pa.array([" ".join(b) for b in bags])], [pa.array([[float(v) for v in b.values()] for b in bags])], 6, 7.0)
            for k in range(0, len(ids), tile):
                x.meet(np.array(ids[k : k + tile]), words.slice(k, tile))
        finally:
            retrieval.DENSE = old
        got = [(r["query_id"], r["id"], round(r["score"], 6)) for r in x.best().to_pylist()]
        whole = whole or got
        assert len(got) == 6 * len(texts) and got == whole


def test_the_filter_joins_nothing(spark, data):
    """r5_bm25_filtered passes its filter as a condition; neither pairs nor texts are joined for it."""
    from almagest.plans import corpus

    plan = corpus.r5_bm25_filtered(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") <= 2 and len(re.findall(r"\bExchange ", plan)) <= 12


def test_lower_case_goes_letter_by_letter(spark):
    """As in the SQL: otherwise one word more or less moves the mean frequency and with it the scores."""
    got = spark.createDataFrame([("ΣΤΑΘΜΌΣ σταθμός İX",)], "text string").select(retrieval.tokens(retrieval.F.col("text"))).first()[0]
    assert got[:2] == ["σταθμόσ", "σταθμός"]


def test_retrieval_keeps_its_plan_small(spark, data):
    """The driver held a plan of over a hundred shuffles; steps that others read are written once."""
    from almagest.plans import corpus

    plan = corpus.r1_retrieve(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) <= 12


def test_nearest_vectors_without_unusable_ones(spark):
    r = random.Random(5)
    v = {i: [float(r.randint(-2, 2)) for _ in range(3)] for i in range(1, 200)} | {200: None, 201: [0.0, 0.0, 0.0]}
    rows = spark.createDataFrame(list(v.items()), "id bigint, embedding array<double>")
    got = retrieval.knn(rows, rows.where("id in (3, 9, 200, 201)").withColumnRenamed("id", "query_id"), 8).collect()
    norm = lambda x: math.sqrt(sum(y * y for y in x))
    usable = {i: x for i, x in v.items() if x and norm(x)}
    for q in (3, 9, 200, 201):
        want = sorted(((-round(sum(a * b for a, b in zip(v[q], x)) / norm(x) / norm(v[q]), 6), i) for i, x in usable.items()), key=lambda t: t)[:8] if q in usable else []
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in want]


def test_hashed_vectors_in_the_row(spark):
    rows = spark.createDataFrame([(1, "a b A"), (2, ""), (3, None), (4, "b")], "id bigint, text string")
    got = {r.id: r.embedding for r in retrieval.hashed_vectors(rows, "id", "text").collect()}
    assert got[2] is None and got[3] is None and len(got[1]) == retrieval.PLACES and abs(sum(x * x for x in got[1]) - 1) < 1e-12
    assert sorted(map(abs, got[4]))[-2:] == [0.0, 1.0]
