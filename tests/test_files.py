"""Files as documents, documents as chunks."""

from pyspark.sql import functions as F

from almagest.operators import papers
from almagest.sources import files


def test_files_become_chunks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("first paragraph\n\nsecond\r\n \r\nthird " + "x" * 30 + "\n\n\n", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_bytes(b"caf\xe9 one")
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "d.txt").write_text(" ")
    (tmp_path / "e.txt").write_text("")
    d = files.documents(spark, str(tmp_path))
    assert {r.source.rsplit("/", 1)[1] for r in d.collect()} == {"a.TXT", "b.md", "d.txt"}
    got = {(r.source.rsplit("/", 1)[1], r.chunk_index): r.text for r in files.chunked(d, 30).collect()}
    assert got == {("a.TXT", 0): "first paragraph\n\nsecond", ("a.TXT", 1): "third " + "x" * 30, ("b.md", 0): "caf� one"}
    known = d.where(F.col("source").endswith("a.TXT"))
    assert {r.source.rsplit("/", 1)[1] for r in files.new_documents(d, known, F.col("source").contains("/sub/")).collect()} == {"d.txt"}


def test_chunks_keep_order_and_text(spark):
    paragraphs = [f"p{i} " + "w" * (i % 17) for i in range(60)]
    d = spark.createDataFrame([("s", "\n\n".join(paragraphs)), ("n", None), ("b", " \n ")], "source string, text string")
    got = files.chunked(d, 50).orderBy("chunk_index").collect()
    assert "\n\n".join(r.text for r in got).split("\n\n") == [p.strip() for p in paragraphs] and {r.source for r in got} == {"s"} and all(len(r.text) <= 50 for r in got)


def test_pages_and_filters(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(10)], "i int, k string, m int")
    assert [r.i for r in papers.page(d, [F.col("i").desc()], 4, 2).collect()] == [5, 4, 3, 2] and papers.page(d, [F.col("i")], 4, 9).count() == 0
    assert {r.i for r in d.where(papers.fits({"k": "a", "m": [0, 1]})).collect()} == {0, 4, 6} and d.where(papers.fits({})).count() == 10
