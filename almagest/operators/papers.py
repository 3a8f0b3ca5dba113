"""Papers of the corpus: keys, sections, resolution of names, filters, what is
indexed and what is listed, sections carried forward, glossary lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.operators.coverage import section_of, stem_of

# Categories of acronyms, in the order in which they are asked for, and words of their expansions.
CATEGORIES = {
    "Methods & Software": [
        "algorithm", "neural network", "machine learning", "deep learning", "learning", "regression", "estimator", "analysis", "technique", "transform", "simulation", "processing", "pipeline",
        "software", "code", "criterion", "classifier", "clustering",
    ],
    "Organizations & Programs": [
        "university", "institute", "council", "foundation", "agency", "school", "research center", "research centre", "data center", "data centre", "science center", "science centre",
        "regional center", "regional centre", "consortium", "programme", "program",
    ],
    "Telescopes & Instruments": [
        "telescope", "array", "observatory", "interferometer", "interferometry", "network", "dish", "processor", "converter", "receiver", "amplifier", "detector", "camera", "instrument", "polarimeter",
        "spectrometer", "correlator", "antenna", "feed", "field-programmable", "gate array",
    ],
}
OTHER_CATEGORY = "Science & Astrophysics"
#: Characters of a name by which titles are looked up.
GRAM = 6


def book_of(source: Column) -> Column:
    """The folder of the book in a path like "pdfs/book/section/stem.pdf"."""
    return F.regexp_extract(source, r"^[^/]+/([^/]+)/", 1)


def bib_key(source: Column) -> Column:
    """The key of a file in a bibliography: its stem under its book, since
    stems occur in several books."""
    return F.concat_ws("/", book_of(source), stem_of(source))


def titles(chunks: DataFrame) -> DataFrame:
    """(source, title): the heading of each document's first chunk."""
    first = F.min(F.struct("chunk_index", "chunk_id", "heading"))
    return chunks.groupBy("source").agg(first.alias("f")).select("source", F.col("f.heading").alias("title"))


def resolved(names: DataFrame, titled: DataFrame) -> DataFrame:
    """(name, source): for each name the documents whose stem it is, in any
    case and with or without an ending, or else those whose title contains it.
    Blank and null names resolve to nothing. Stems meet by an equi-join; only
    names that none has are looked for in titles, by how they begin."""
    wanted = names.where(F.trim("name") != "").select("name").distinct().withColumn("stem", F.lower(stem_of(F.col("name"))))
    t = titled.select("source", F.lower("title").alias("title"), F.lower(stem_of(F.col("source"))).alias("stem"))
    exact = wanted.join(t, "stem").select("name", "source")
    rest = wanted.join(exact, "name", "left_anti").withColumn("gram", F.left(F.lower("name"), F.lit(GRAM)))
    # every run of GRAM characters of a title, and its shorter end, meets names that begin with it
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("title"), F.lit(1))), lambda k: F.substr("title", k, F.lit(GRAM)))
    posted = t.select("source", "title", F.explode(F.array_distinct(grams)).alias("gram"))
    short = rest.where(F.length("name") < GRAM).select("name", "gram")
    heads = posted.where(F.length("title") > 0).select("source", F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.left("gram", k))).alias("gram")).distinct()
    loose = rest.where(F.length("name") >= GRAM).join(posted, "gram").where(F.contains("title", F.lower("name"))).select("name", "source")
    return exact.unionByName(loose).unionByName(short.join(heads, "gram").select("name", "source")).distinct()


def selected(chunks: DataFrame, book: str | None = None, section: str | None = None, sources: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """The chunks of a book (doc_source), of a section (in any case) and of the
    documents `sources` (source) names. With `strict` a filter that nothing
    fits is an error, so that a typing error does not pass for an empty corpus."""
    out = chunks if book is None else chunks.where(F.col("doc_source") == book)
    out = out if section is None else out.where(F.lower(section_of(F.col("source"))) == section.lower())
    out = out if sources is None else out.join(sources.select("source").distinct(), "source", "left_semi")
    if strict and out.isEmpty():
        raise ValueError(f"No indexed chunks for book={book!r}, section={section!r}, given papers: {sources is not None}")
    return out


def bibliography(mentions: DataFrame) -> DataFrame:
    """(bib_key, paper, book, section) of the papers that mentions come from;
    of differing values the least."""
    return mentions.where("source_path is not null").groupBy(bib_key(F.col("source_path")).alias("bib_key")).agg(F.min("paper").alias("paper"), F.min("book").alias("book"), F.min("section").alias("section"))


def paper_info(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """The entries with how many chunks and files of them are indexed."""
    n = chunks.groupBy("source").agg(F.count("*").alias("n")).groupBy(bib_key(F.col("source")).alias("bib_key")).agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_files"))
    return entries.join(n, "bib_key", "left").fillna(0, ["n_chunks", "n_files"])


def missing(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, paper): papers (paper) that are listed but not indexed, and stems
    of documents that are indexed but not listed."""
    have = chunks.select(stem_of(F.col("source")).alias("paper")).distinct()
    want = listed.where("paper is not null").select("paper").distinct()
    return want.join(have, "paper", "left_anti").select(F.lit("not_indexed").alias("kind"), "paper").unionByName(have.join(want, "paper", "left_anti").select(F.lit("no_entry").alias("kind"), "paper"))


def carried_forward(chunks: DataFrame, column: str) -> DataFrame:
    """(chunk_id, value): the last value of a column that is neither null nor
    empty, up to the chunk in its document's reading order."""
    w = Window.partitionBy("source").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)  # a paper
    return chunks.select("chunk_id", F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(w).alias("value"))


def glossary(chunks: DataFrame) -> DataFrame:
    """(acronym, expansion) of lines such as "ABC: what it stands for"; the
    first in order of source, chunk and line counts. The acronym is a capital
    and up to fifteen capitals, digits, full stops and hyphens; the expansion
    begins with a letter and has five to 81 characters."""
    lines = chunks.select("source", "chunk_index", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "t")).withColumn("t", F.trim("t"))
    head = F.regexp_replace(F.substring_index("t", " ", 1), r"[:–\-]$", "")
    rest = F.regexp_replace(F.trim(F.substr("t", F.length(F.substring_index("t", " ", 1)) + 1)), r"^[:–\-]\s+", "")
    g = lines.select("source", "chunk_index", "line", head.alias("acronym"), rest.alias("expansion"))
    g = g.where(F.col("acronym").rlike(r"^[A-Z][A-Z0-9.\-]{1,15}$") & F.col("expansion").rlike("^[A-Za-z]") & F.length("expansion").between(5, 81))
    return g.groupBy("acronym").agg(F.min(F.struct("source", "chunk_index", "line", "expansion")).alias("f")).select("acronym", F.col("f.expansion").alias("expansion"))


def known_acronyms(found: DataFrame, seed: dict[str, str], curated: dict[str, str] | None = None) -> DataFrame:
    """(acronym, expansion): curated ones before found ones before the seed."""
    spark = found.sparkSession
    rows = lambda d, rank: spark.createDataFrame([(rank, k, v) for k, v in d.items()], "rank int, acronym string, expansion string")
    every = found.select(F.lit(1).alias("rank"), "acronym", "expansion").unionByName(rows(seed, 2)).unionByName(rows(curated or {}, 0))
    return every.groupBy("acronym").agg(F.min(F.struct("rank", "expansion")).alias("b")).select("acronym", F.col("b.expansion").alias("expansion"))


def category(expansion: Column) -> Column:
    """The category of an acronym by whole words of its expansion, in either number."""
    text, out = F.lower(expansion), None
    for name, words in CATEGORIES.items():
        hit = text.rlike(r"\b(?:" + "|".join(words) + r")s?\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER_CATEGORY)


def slug(text: Column) -> Column:
    """Lower case, with a hyphen for each run of other characters than letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def facility_network(per_paper: DataFrame, names: list[str]) -> DataFrame:
    """(kind, a, b, n_papers, mentions): a node for each name, also one that no
    paper has, and an edge for each pair that papers name together. A paper
    holds at most the given names, so its pairs are few."""
    spark = per_paper.sparkSession
    nodes = spark.createDataFrame([(n,) for n in names], "term string").join(per_paper, "term", "left").groupBy("term").agg(F.count("source").alias("n_papers"), F.coalesce(F.sum("mentions"), F.lit(0)).alias("mentions"))
    a, b = (per_paper.select("source", F.col("term").alias(x), F.col("mentions").alias(f"m{x}")) for x in "ab")
    edges = a.join(b, "source").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_papers"), F.sum(F.least("ma", "mb")).alias("mentions"))
    return nodes.select(F.lit("node").alias("kind"), F.col("term").alias("a"), F.lit(None).cast("string").alias("b"), "n_papers", "mentions").unionByName(edges.select(F.lit("edge").alias("kind"), "a", "b", "n_papers", "mentions"))


def fits(where: dict) -> Column:
    """A flat filter as a condition: each key has the value, or one of the list."""
    out = F.lit(True)
    for key, value in where.items():
        out = out & (F.col(key).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(key) == value)
    return out


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """The rows of a page, from 1, of a table in an order."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def passage() -> Column:
    """A chunk as it is shown: paper, section and page, and its text with blanks collapsed."""
    section = section_of(F.col("source"))
    where = F.concat(stem_of(F.col("source")), F.lit(", "), F.when(section == "", "no section").otherwise(section), F.when(F.col("page_no") > 0, F.concat(F.lit(", p. "), F.col("page_no").cast("string"))).otherwise(""))
    return F.concat(F.lit("["), where, F.lit("] "), collapsed(F.col("text")))


def identifier(text: Column) -> Column:
    """A name in lower case with an underscore for each run of other characters."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_")


def across_vocabularies(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(written, canonical, n): each distinct word (written), normalised, with
    the first canonical name whose name (name, canonical) normalises to the
    same, and how many do."""
    v = vocabulary.select(identifier(F.col("name")).alias("written"), "canonical").distinct()
    return words.select(identifier(F.col("written")).alias("written")).distinct().join(v, "written", "left").groupBy("written").agg(F.min("canonical").alias("canonical"), F.count("canonical").alias("n"))


def sentences(text: Column) -> Column:
    """The sentences of a text: what full stops, question and exclamation marks before blanks part."""
    return F.filter(F.split(text, r"[.!?]+[ \t\r\n]+"), lambda s: F.trim(F.translate(s, "\t\r\n", "   ")) != "")
