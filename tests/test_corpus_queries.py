"""Queries over chunks on small tables of their own."""

import re

from almagest.plans import corpus

META = "struct<source: string, chunk_index: int, heading: string, section_path: string, page_no: int, doc_source: string, zone: string, doc_status: string>"


def folder(spark, tmp_path, rows):
    """A dataset folder whose terms are rows of (chunk_id, source, text)."""
    data = [(i, t, (s, i, "", "", 1, "x", "body", "canonical"), None) for i, s, t in rows]
    spark.createDataFrame(data, f"chunk_id bigint, text string, meta {META}, ingested_at timestamp").write.parquet(f"{tmp_path}/terms.parquet")
    return str(tmp_path)


def test_claims_need_the_numbers_behind_any_prefix(spark, tmp_path):
    pad = "words about the beam and its shape " * 10
    rows = [(50, "a", f"at 1.4 GHz, {pad} in 50 hours"), (1, "b", "1.4 and 7"), (2, "c", "50 with 1.4"), (3, "c", f"{pad} 1.4, 50."), (100, "e", f"{pad} 7"), (150, "f", pad), (5, "g", None)]
    want = {}
    for i, _, claim in rows:
        need = set(re.findall(r"\d+(?:\.\d+)?", claim or "")) if i % 50 == 0 else set()
        for _, source, text in rows:
            if need and all(re.search(rf"(?<![\d.]){re.escape(n)}(?!\d)", text or "") for n in need):
                want[i, source] = want.get((i, source), 0) + 1
    got = {(r.claim_id, r.source): r.n_chunks for r in corpus.x8_number_support(spark, folder(spark, tmp_path, rows)).collect()}
    assert got == want == {(50, "a"): 1, (50, "c"): 2, (100, "b"): 1, (100, "e"): 1}


def test_duplicates_by_half_their_texts_then_by_stem(spark, tmp_path):
    def paper(i, source, texts):
        return [(i + k, source, t) for k, t in enumerate(texts)]

    rows = paper(0, "x/b/A/Curiel01.pdf", ["p", "q", "r"]) + paper(10, "x/b/A/Curiel01c.pdf", ["p", "q", "s"])  # 2 of 4
    rows += paper(20, "x/b/A/Bianchi01.pdf", ["t1", "t2"]) + paper(30, "x/b/B/Bianchi01.pdf", ["u1", "u2"])  # one stem, other texts
    rows += paper(40, "x/b/A/Hota.pdf", ["v1", "v2", "v3", "v4", "v5"]) + paper(50, "x/b/A/Other.pdf", ["v1", "w2", "w3", "w4", "w5"])  # 1 of 9
    rows += paper(60, "x/b/B/Curiel01c.pdf", ["z"])  # the other Curiel01c is no survivor
    got = {r.source: (r.status, r.duplicate_of) for r in corpus.e6_duplicates(spark, folder(spark, tmp_path, rows)).collect()}
    assert {s: of for s, (status, of) in got.items() if status == "duplicate"} == {"x/b/A/Curiel01c.pdf": "x/b/A/Curiel01.pdf", "x/b/B/Bianchi01.pdf": "x/b/A/Bianchi01.pdf"}
    assert len(got) == 7 and all(of == "" for status, of in got.values() if status == "canonical")


def test_acronyms_count_what_other_papers_mention(spark, tmp_path):
    rows = [(1, "a", "the Square Kilometre Array (SKA) and Dispersion Measure (DM)"), (2, "b", "SKA, SKA-Low and pre-SKA; (SKAs) not SKAX"), (3, "c", "dark matter (DM)"), (4, "d", "DM and SKA"), (5, "e", "Epoch of Reionisation (EoR)"), (6, "f", None), (7, "g", "Very Long Baseline Interferometry (VLBI)")]
    got = {r.sense: (r.n, r.n_sources) for r in corpus.a16_acronyms(spark, folder(spark, tmp_path, rows)).collect()}
    assert got == {"SKA": (6, 3), "DM (Dispersion Measure)": (1, 1), "DM (dark matter)": (1, 1), "EOR": (1, 1), "VLBI": (1, 1)}


def test_retrieval_asks_for_the_whole_text(spark, tmp_path):
    pad = "words about the beam and its shape " * 5
    rows = [(50, "a", f"{pad} magnetar glitch"), (1, "b", "magnetar glitch"), *[(2 + i, "c", f"galaxy{i}") for i in range(9)]]
    got = [r.id for r in corpus.r1_retrieve(spark, folder(spark, tmp_path, rows)).orderBy("rank").collect()]
    assert got[:2] == [50, 1]
