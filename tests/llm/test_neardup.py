import random

import pytest
import regex
from pyspark.sql import functions as F

from almagest.functions.textfold import with_fold
from almagest.llm import neardup

WORD = regex.compile(r"[\p{L}\p{N}]+")
TERMS = "chunk_id bigint, text string, meta struct<source: string>, folded string"


def shingles(text, k):
    w = WORD.findall(text.lower()) if text else []
    return frozenset(zip(*[w[i:] for i in range(k)])), len(w)


def brute(rows, k, threshold, least):
    s = {i: shingles(t, k)[0] for i, t, _ in rows if shingles(t, k)[1] >= least and shingles(t, k)[0]}
    src = {i: m for i, _, m in rows}
    return sorted((a, b) for a in s for b in s if a < b and src[a] != src[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold)


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        k = rnd.randrange(len(w))
        rnd.choice([lambda: w.insert(k, "new"), lambda: w.pop(k), lambda: w.__setitem__(k, "other")])()
    return " ".join(w)


def test_found_against_all_pairs(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    boiler = " ".join(rnd.choices(vocab, k=30))
    rows = []
    for g in range(25):
        base = rnd.choices(vocab, k=rnd.randrange(20, 120))
        rows += [(len(rows), edited(rnd, base, n), f"s{rnd.randrange(4)}") for n in (0, 0, 1, 3, 6, 9)]
    rows += [(len(rows) + i, boiler + " " + " ".join(rnd.choices(vocab, k=25)), f"s{i % 3}") for i in range(40)]
    rows += [(900, None, "s1"), (901, "", "s1"), (902, "too short", "s2"), (903, "same " * 40, "s1"), (904, "SAME, " * 40, "s2"), (905, "same " * 40, None)]
    df = spark.createDataFrame([(i, t, (m,), "x") for i, t, m in rows], TERMS)
    got = sorted(map(tuple, neardup.found(df).collect()))
    assert got == brute([(i, t, m or "") for i, t, m in rows], 3, 0.6, 20)


def test_found_on_the_test_table(spark, data):
    t = spark.read.parquet(f"{data}/terms.parquet")
    rows = [(r.chunk_id, r.folded, r.source) for r in with_fold(t.select("chunk_id", "text", F.col("meta.source").alias("source")), "text", "folded").collect()]
    assert sorted(map(tuple, neardup.found(t).collect())) == brute(rows, 3, 0.6, 20)


def test_groups_are_the_components_of_all_pairs(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = rnd.choices(vocab, k=rnd.randrange(40, 90))
        rows += [(len(rows) + i, edited(rnd, base, n), f"s{i}") for i, n in enumerate((0, 0, 3, 5))]
    rows += [(900, "too short", "s1"), (901, "too short", "s2"), (902, None, "s3")]
    pairs, root = brute(rows, 3, 0.6, 20), {i: i for i, _, _ in rows}
    s = {i: shingles(t, 5)[0] for i, t, _ in rows}
    assert any(len(s[a] & s[b]) / len(s[a] | s[b]) < 0.8 for a, b in pairs)
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([(i, t, (m,), "x") for i, t, m in rows], TERMS)
    assert {r.chunk_id: r.class_id for r in neardup.groups(df).collect()} == root


def test_hot_group_of_copies_makes_few_pairs(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(i, text, (f"s{i}",), "x") for i in range(300)] + [(300 + i, " ".join(f"b{i}x{j}" for j in range(40)), ("s",), "x") for i in range(20)] + [(999, text + " end", ("t",), "x")]
    df = spark.createDataFrame(rows, TERMS)
    pairs, members = neardup.similar(df, "chunk_id", "text", 0.8)
    assert pairs.count() == 1 and members.count() == 321
    g = {r.chunk_id: (r.class_id, r.class_size, r.n_links) for r in neardup.groups(df).collect()}
    assert len(g) == 321 and g[0] == (0, 301, 1) and g[999] == (0, 301, 1) and g[305] == (305, 1, 0)


def test_empty(spark):
    e = spark.createDataFrame([], TERMS)
    assert neardup.found(e).count() == 0 and neardup.groups(e).count() == 0


@pytest.mark.parametrize("text", ["", "a b", "a b c", "a b c " * 20000])
def test_shingles_of_any_length(text):
    s = neardup.Shingler(3, 16)
    h, n = s.hashes(text)
    assert len(h) == len(shingles(text, 3)[0]) and n == len(text.split()) and len(s.minima(h)) == 16


def test_shared_boilerplate_makes_few_candidates(spark):
    """A passage that all texts share is in the coordinates that prefixes leave out."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(20000)]
    boiler = " ".join(rnd.choices(vocab, k=20))
    df = spark.createDataFrame([(i, boiler + " " + " ".join(rnd.choices(vocab, k=60))) for i in range(600)], "k int, t string")
    s = neardup.signatures(df, "k", "t", 3, 128, 64, 20).select(F.col("key").alias("rep"), "coords")
    n = neardup.match_threshold(0.6, 64, 2)
    assert n > 5 and neardup.prefix_hits(s, n).count() < 0.001 * 600 * 599 / 2 < neardup.prefix_hits(s, 1).count()
    assert neardup.match_threshold(0.1, 8, 2) == 1


def test_without_the_comparison_of_minima(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(10):
        base = rnd.choices(vocab, k=60)
        rows += [(3 * g + j, edited(rnd, base, k)) for j, k in enumerate((0, 2, 5))]
    df = spark.createDataFrame(rows, "k int, t string")
    a, b = (sorted(map(tuple, neardup.similar(df, "k", "t", 0.6, 3, 20, sigmas=x)[0].collect())) for x in (4.2, None))
    assert a == b and len(a) >= 10
