import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almagest.llm import mixing, toxicity

SIZES = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "source string, weight double, max_repeats int, n_tokens string"


def test_mixture_keeps_budget_and_limits(spark):
    rnd = random.Random(4)
    rows = [(i, "big" if i % 3 else "mid", rnd.randrange(1, 50)) for i in range(3000)] + [(5000 + i, "tiny", 10) for i in range(5)] + [(9000, None, 77), (9001, "other", 500), (9002, "big", 0), (9002, "big", 0)]
    t = spark.createDataFrame([("big", 0.5, 2, "x"), ("mid", 0.3, 3, "x"), ("tiny", 0.15, 4, "x"), ("absent", 0.05, 9, "x")], TARGETS)
    s = spark.createDataFrame(rows, SIZES)
    p = {r.source: r for r in mixing.plan(s, t).collect()}
    total = sum(r[2] for r in rows)
    assert p["big"].total_tokens == total
    assert {k for k, r in p.items() if not r.reachable} == {"tiny", "absent"}
    m = mixing.mixture(s, mixing.plan(s, t)).cache()
    for r in m.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("pass").alias("c"), F.max("at").alias("at")).collect():
        assert p[r.source].budget_tokens - 50 <= r.t <= p[r.source].budget_tokens + 1e-6 and r.c <= p[r.source].max_repeats and r.at <= 1 + 1e-9
    assert m.where("source = 'tiny'").count() == 20 and m.where("source = 'tiny'").select("doc_id").distinct().count() == 5
    # sources below their limit keep the proportion of their weights
    free = [k for k, r in p.items() if r.budget_tokens < r.most_tokens]
    assert len({round(p[k].budget_tokens / p[k].weight, 3) for k in free}) == 1
    # each pass is a permutation: places from 1 on without gaps, of other orders in other passes
    for r in m.groupBy("source", "pass").agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count("*").alias("n"), F.count_distinct("position").alias("d")).collect():
        assert r.lo == 1 and r.n == r.d and (r.hi == r.n or r["pass"] > p[r.source].budget_tokens // p[r.source].n_tokens)
    order = {k: [x.doc_id for x in m.where(F.col("source") == "tiny").where(F.col("pass") == k).orderBy("position").collect()] for k in (1, 2, 3, 4)}
    assert len({tuple(x) for x in order.values()}) > 1 and len({frozenset(x) for x in order.values()}) == 1
    assert mixing.plan(s.limit(0), t).where("reachable and total_tokens = 0").count() == 4 and mixing.plan(s, t.limit(0)).count() == 0


def test_temperature():
    assert mixing.temperature_exponent(0.1, 0.3, 1000, 500) == 1.0 and mixing.temperature_exponent(0.0, 0.3, 1000, 0) == 0.0
    a = mixing.temperature_exponent(0.1, 0.3, 1000, 200)
    assert 0 < a < 1 and mixing.tempered(0.1, 0.3, a) * 1000 == pytest.approx(200)
    assert mixing.temperature_exponent(0.0, 0.0, 1000, 0) == 1.0 and mixing.tempered(0.5, 0.0, 0.3) == 0.0
    w, most = np.array([0.5, 0.3, 0.2]), np.array([900.0, 900.0, 100.0])
    assert mixing.normalised(w, most, 1000) == pytest.approx([562.5, 337.5, 100])
    assert mixing.normalised(w, most / 10, 1000) == pytest.approx(most / 10) and mixing.normalised(w * 0, most, 1000).sum() == 0


def test_words_in_disguise():
    for w, p in (("C0NN4RD", "connard"), ("c.o.n.n.a.r.d", "connard"), ("Аrѕch", "arsch"), ("idi​ot!!!", "idiot"), ("12.5", "0"), ("J1130+1407", "0"), ("étrangers,", "etrangers"), ("—", ""), ("soooooo", "so")):
        assert toxicity.plain_word(w) == p, w


def test_held_out_documents(spark):
    """Trained on one table's reviews, tested on another's. Some reviews are
    wrong and a few hundred show only part of the kinds of abuse, so recall is
    not asked for beyond a half."""

    def labelled(d):
        docs, labels = (spark.read.parquet(f"/root/testdata/{d}/{t}.parquet") for t in ("documents", "review_labels"))
        return toxicity.sample(docs, labels, 4000)

    texts, bad, sure, weight = labelled("sf0.1")
    m, cut_off = toxicity.learn(texts, bad, sure, weight)
    texts, bad, sure, _ = labelled("sf0.01")
    got = toxicity.document_scores(toxicity.Bags(texts), m, len(texts)) > cut_off
    assert got[~bad].mean() <= 0.02 and not got[~bad & sure].any() and (got & bad).sum() >= 0.5 * bad.sum()


def test_wrong_labels_are_left_out():
    """Clean texts that are called bad have no backing; planted abuse has."""
    rnd = random.Random(8)
    words = [f"{a}{b}on" for a in "bdfglmnprst" for b in ("ra", "le", "mi", "so", "tu", "ke")]
    clean = lambda: " ".join(rnd.choices(words, k=14)).capitalize() + "."
    abuse = ["You are a rotten idiot and nobody wants you here.", "Crawl back into your hole, you filthy worm of a man."]
    texts = [clean() + " " + clean() for _ in range(500)] + [clean() + " " + rnd.choice(abuse) + " " + clean() for _ in range(40)]
    truth = np.arange(len(texts)) >= 500
    bad = truth | (np.arange(len(texts)) < 20)
    bags = toxicity.Bags(texts)
    backed = toxicity.backing(bags, bad, np.arange(len(texts))) >= toxicity.BACKED
    assert backed[truth].all() and not backed[:20].any()
    m, cut_off = toxicity.learn(texts, bad, np.zeros(len(texts), bool), np.ones(len(texts)))
    assert ((toxicity.document_scores(bags, m, len(texts)) > cut_off) == truth).mean() > 0.995
    assert toxicity.best_cut(np.zeros(0), np.zeros(0, bool), np.zeros(0)) == 0.0


def test_bounds_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "abusive" if i < 30 else "clean") for i in range(40)] + [(0, "clean"), (1, "abusive")], "doc_id bigint, label string")
    texts, bad, sure, weight = toxicity.sample(docs, labels, most=20)
    assert len(texts) == 20 and bad.sum() == 10 and weight[bad][0] == 2.9 and sure.sum() <= 1
    assert len(toxicity.sample(docs, labels, most=20, most_bytes=550)[0]) == 5


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you are a rotten idiot. The galaxy is bright.", "s", "e"), (2, "The galaxy is bright.\nThe dish is large.", "s", "e"), (3, None, None, "e"), (4, "", "s", "e"), (5, "you are a rotten idiot", "t", "e"), (6, "12 34 --", "t", "e"), (2, "The galaxy is bright.\nThe dish is large.", "s", "e"), (7, "The dish is large. " * 20000, "t", "e")], "doc_id bigint, text string, source string, score string")
    labels = spark.createDataFrame([(1, "abusive", "r"), (2, "clean", "r"), (5, "hateful", "r"), (5, "hateful", "q"), (7, "clean", "r"), (99, "clean", "r"), (None, "clean", "r"), (6, None, "r")], "doc_id bigint, label string, reviewer string")
    m = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in toxicity.scores(docs, m).collect()}
    assert toxicity.scores(docs, m).count() == 8 and out[3].score == out[4].score == 0.0 and not out[6].flagged
    assert out[5].score > out[2].score
    r = {x.source: x.n_docs for x in toxicity.rates(docs, labels).collect()}
    assert r == {"s": 4, "t": 3, None: 1}
    assert toxicity.found(docs, labels.limit(0)).count() == 0 and toxicity.scores(docs.limit(0), m).count() == 0
