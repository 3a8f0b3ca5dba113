from hypothesis import given, settings
from hypothesis import strategies as st

from almagest.llm import queries, segment
from tests.oracle import both, connection


def check(text, most, over):
    p = segment.pieces(text, most, over)
    o = max(0, min(over, most - 1, most // 2))
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(b - a <= most for a, b in p)
    assert all(z - a == o for (_, z), (a, _) in zip(p, p[1:]))
    assert all(a < b for a, b in p) or not text
    return p


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n\r\té́星‍", max_size=400), st.integers(1, 60), st.integers(0, 70))
def test_pieces_keep_limit_and_overlap(text, most, over):
    check(text, most, over)


def test_best_kind_of_boundary_first():
    text = "aaa bbb. ccc\nddd eee. fff ggg\n\nhhh iii jjj kkk lll"
    assert check(text, 36, 0)[0] == (0, text.index("hhh"))
    assert check("word " * 50, 33, 5)[0][1] % 5 == 0
    assert check("x" * 100, 30, 10)[0] == (0, 30)
    assert "\r\n" not in {("a\r\n" * 40)[a - 1 : a + 1] for a, _ in check("a\r\n" * 40, 10, 0)}


def test_long_runs_begin_a_piece_where_words_end_before_them():
    text = "see the table " + "x" * 25 + " end"
    assert check(text, 30, 0) == [(0, 14), (14, 43)]
    assert check("one. two " + "y" * 60, 30, 2)[0] == (0, 5)  # the sentence, not the word
    assert check("a b " + "z" * 40, 30, 4)[0] == (0, 30)  # no gap behind the overlap


def test_cut_falls_where_the_topic_changes():
    a, b = "pulsar timing glitch spin noise. ", "galaxy cluster halo redshift mass. "
    text = a * 18 + b * 18
    assert check(text, len(a) * 24, 0)[0][1] == len(a) * 18


def test_a_deep_valley_outweighs_a_better_kind_of_boundary():
    a, b = "pulsar timing glitch spin noise ", "galaxy cluster halo redshift mass "
    text = (a * 9)[:-1] + ".\n" + a * 9 + b * 8
    got = segment.cuts(text, len(a) * 24, 0)[0]
    assert got[1:3] == (len(a) * 18 + 1, "word") and got[3] > 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 9))
def test_cohesion_is_the_cosine_of_both_blocks(ids, block):
    from collections import Counter

    import numpy as np

    def cosine(k):
        x, y = Counter(ids[max(0, k - block) : k]), Counter(ids[k : k + block])
        return sum(v * y[w] for w, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5 if x and y else 0.0

    got = segment.cohesion(np.array(ids, dtype=np.int64), block)
    assert np.allclose(got, [cosine(k) for k in range(len(ids) + 1)])


def test_found_equals_sql(spark, data):
    got, want = both(spark, connection(data), data, queries.QUERIES["p1_found"], queries.SQL["p1_found"])
    assert got == want


META = "struct<source: string, chunk_index: int, section_path: string, doc_source: string>"


def test_rows(spark):
    t = spark.createDataFrame([(1, "a b " * 20, ("s", 3, "1 X", "k"), "e"), (2, "short", ("s", 4, None, None), "e"), (3, None, ("s", 5, "2", "k"), "e"), (4, "", None, "e"), (5, "星" * 31, (None, None, None, "other"), None), (1, "a b " * 20, ("s", 3, "1 X", "k"), "e")], f"chunk_id bigint, text string, meta {META}, piece string")
    lim = spark.createDataFrame([("k", 30, 10, 1), ("default", 30, 5, 2), ("default", 30, 5, 2)], "doc_source string, max_chars int, overlap_chars int, own int")
    out = segment.split(t, lim)
    assert sorted(r.chunk_id for r in segment.found(t, lim).collect()) == [1, 1, 5]
    one = out.where("chunk_id = 1").select("piece", "start", "end", "text", "section_path", "chunk_index").distinct().orderBy("piece").collect()
    assert all(r.section_path == "1 X" and r.chunk_index == 3 and len(r.text) <= 30 for r in one)
    assert one[0].end - one[1].start == 10 and one[-1].end == 80
    assert out.where("chunk_id = 3").count() == 0 and out.where("chunk_id = 4").first().n_pieces == 1
    assert segment.split(t.limit(0), lim).count() == 0
