"""Queries over the chunks of papers: coverage, zones, copies, health, reading
order, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almagest.operators import coverage, documents, retrieval
from almagest.plans.registry import query
from almagest.session import cut
from almagest.sources.tables import chunks, latest_chunks, table

TERMS = ["redshift|luminosity", "pulsar survey|magnetar", "star-forming", "bandpass|flux density", "RQN|HLX"]

_CHUNKS = """c0 as (
  select chunk_id, coalesce(text, '') as text, coalesce(meta.source, '') as source, coalesce(meta.chunk_index, 0) as chunk_index,
         coalesce(meta.heading, '') as heading, coalesce(meta.section_path, '') as section_path, coalesce(meta.page_no, 0) as page_no,
         coalesce(meta.doc_source, '') as doc_source, coalesce(meta.zone, 'body') as zone, coalesce(meta.doc_status, 'canonical') as doc_status, ingested_at
  from terms),
c as (select * exclude (rn) from (select *, row_number() over (partition by source, chunk_index order by ingested_at desc nulls last, chunk_id desc) as rn from c0) where rn = 1)"""
_SECTION = r"regexp_extract(source, '^[^/]+/[^/]+/(.+)/[^/]+$', 1)"
_STEM = r"regexp_extract(source, '([^/]+?)(\.[^./]*)?$', 1)"
_PATTERNS = [
    ("redshift|luminosity", [r"(?i)\bredshift(?:s|es)?\b", r"(?i)\bluminosit(?:y|ies)\b"]),
    ("pulsar survey|magnetar", [r"(?i)\bpulsar(?:s|es)?[\s\-]+survey(?:s|es)?\b", r"(?i)\bmagnetar(?:s|es)?\b"]),
    ("star-forming", [r"(?i)\bstar(?:s|es)?[\s\-]+forming(?:s|es)?\b"]),
    ("bandpass|flux density", [r"(?i)\bbandpass(?:es)?\b", r"(?i)\bflux(?:es)?[\s\-]+densit(?:y|ies)\b"]),
    ("RQN|HLX", [r"\bRQNs?\b", r"\bHLXs?\b"]),
]
_MENTIONS = f"""m as (
  select term, source, sum(n)::bigint as mentions from (
    {" union all ".join(f"select '{t}' as term, source, {' + '.join(f'len(regexp_extract_all(text, $${p}$$))' for p in ps)} as n from c where zone in ('abstract', 'body') and doc_status = 'canonical'" for t, ps in _PATTERNS)}
  ) group by term, source having sum(n) > 0)"""


def _content(spark, d):
    return coverage.select_chunks(latest_chunks(spark, d))


@query("s5_latest_chunks", f"with {_CHUNKS} select chunk_id, source, chunk_index, length(text)::bigint as n from c")
def s5_latest_chunks(spark, d):
    return latest_chunks(spark, d).select("chunk_id", "source", "chunk_index", F.length("text").cast("bigint").alias("n"))


@query("a1_keyword_coverage", f"with {_CHUNKS}, {_MENTIONS} select term, sum(mentions)::bigint as total_mentions, count(*) filter (mentions >= 2) as n_papers, count(distinct case when mentions >= 2 then {_SECTION} end) as n_sections from m group by term")
def a1_keyword_coverage(spark, d):
    return coverage.coverage(coverage.mentions(_content(spark, d), TERMS), min_hits=2)


@query("a2_mention_counts", f"with {_CHUNKS}, {_MENTIONS} select * from m")
def a2_mention_counts(spark, d):
    return coverage.mentions(_content(spark, d), TERMS)


@query(
    "a25_coverage_by_section",
    f"""with {_CHUNKS}, {_MENTIONS}, p as (select *, case when {_SECTION} = '' then '(unknown)' else {_SECTION} end as section, {_STEM} as paper from m)
    select term, section, row_number() over (partition by term, section order by paper, source) as place, paper from p""",
)
def a25_coverage_by_section(spark, d):
    return coverage.coverage_by_section(coverage.mentions(_content(spark, d), TERMS))


@query(
    "a3_usage",
    f"""with {_CHUNKS}, u as (select *, len(regexp_extract_all(text, $$(?i)\\bmagnetar(?:s|es)?\\b$$)) as n,
      len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as words from c where doc_status = 'canonical'),
    g as (select source, sum(n) as alln, sum(case when zone = 'body' then words else 0 end)::bigint as body_words, sum(case when zone = 'body' then n else 0 end)::bigint as body_mentions,
      bool_or(regexp_matches(heading, $$(?i)\\bmagnetar(?:s|es)?\\b$$)) as in_heading, bool_or(zone = 'abstract' and n > 0) as in_abstract from u group by source)
    select source, body_words, body_mentions, case when body_words > 0 then round(body_mentions * 1000 / body_words, 2) end as per_1000, in_heading, in_abstract from g where alln > 0""",
)
def a3_usage(spark, d):
    return coverage.usage(coverage.select_chunks(latest_chunks(spark, d), zones=None), "magnetar")


@query("a4_contexts")
def a4_contexts(spark, d):
    return coverage.contexts(_content(spark, d), "pulsar survey|magnetar")


@query(
    "a5_co_mentions",
    f"with {_CHUNKS}, {_MENTIONS} select x.term as a, y.term as b, count(*) as shared_papers from m x join m y on x.source = y.source and x.term < y.term group by all",
)
def a5_co_mentions(spark, d):
    return coverage.co_mentions(coverage.mentions(_content(spark, d), TERMS))


@query("x6_guarded_mentions")
def x6_guarded_mentions(spark, d):
    return coverage.mentions_guarded(_content(spark, d), "magnetar|pulsar", [r"pulsar\s+in\b", r"magnetar\s+\w+s\b"])


@query(
    "a25_rollup_coverage",
    f"with {_CHUNKS}, {_MENTIONS} select term, {_SECTION} as section, sum(mentions)::bigint as total, count(*) as n_papers from m group by rollup (term, section)",
)
def a25_rollup_coverage(spark, d):
    m = coverage.mentions(_content(spark, d), TERMS).withColumn("section", coverage.section_of(F.col("source")))
    return m.rollup("term", "section").agg(F.sum("mentions").alias("total"), F.count("*").alias("n_papers"))


@query(
    "a6_index_health",
    f"""with {_CHUNKS.split(", c as")[0].rstrip(",").rsplit("),", 1)[0] + ")"} select source, count(*) as n_chunks,
    {", ".join(f"count(*) filter (zone = '{z}') as n_{z}" for z in coverage.ZONES)},
    count(*) - count(distinct chunk_index) as repeated_ids, count(*) filter (zone = 'references') = 0 as no_references from c0 group by source""",
)
def a6_index_health(spark, d):
    return documents.health(chunks(spark, d))


@query(
    "c1_fingerprint",
    f"""with {_CHUNKS}, l as (select source, concat_ws(chr(9), source, chunk_index::varchar, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))) as line from c),
    p as (select source, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as digest from l group by source),
    b as (select left(sha1(source), 3) as part, count(*) as k, sum(n) as n, sha256(string_agg(concat_ws(chr(9), source, digest), chr(10) order by concat_ws(chr(9), source, digest))) as digest from p group by 1)
    select sum(k)::bigint as n_docs, sum(n)::bigint as n_chunks, sha256(string_agg(concat_ws(chr(9), part, digest), chr(10) order by part)) as fingerprint from b""",
)
def c1_fingerprint(spark, d):
    return documents.fingerprint(latest_chunks(spark, d))


_DOC_PAIRS = """h as (select distinct source, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as h from c),
    n as (select source, count(*) as n from h group by source),
    r as (select h from h group by h having count(*) between 2 and 19),
    s as (select x.source as a, y.source as b, count(*) as shared from h x join h y on x.h = y.h and x.source < y.source where x.h in (select h from r) group by all)"""


@query(
    "e5_similar_documents",
    f"with {_CHUNKS}, {_DOC_PAIRS} select a, b, shared / (p.n + q.n - shared) as jaccard from s join n p on p.source = a join n q on q.source = b where shared / (p.n + q.n - shared) >= 0.02",
)
def e5_similar_documents(spark, d):
    return documents.similar_documents(latest_chunks(spark, d), 0.02)


@query("e6_duplicates")
def e6_duplicates(spark, d):
    return documents.duplicates(latest_chunks(spark, d), F.length(coverage.stem_of(F.col("source"))))


@query("x28_zones")
def x28_zones(spark, d):
    return documents.assign_zones(latest_chunks(spark, d))


@query(
    "x26_reads_as_references",
    f"with {_CHUNKS} select chunk_id, len(regexp_extract_all(text, $${documents.REF_ENTRY.replace("*+", "*")}$$)) >= greatest(3.0, length(text) / 250) as refs from c",
)
def x26_reads_as_references(spark, d):
    return latest_chunks(spark, d).select("chunk_id", documents.reads_as_references(F.col("text")).alias("refs"))


@query(
    "j4_neighbours",
    f"""with {_CHUNKS}, h as (select source, chunk_index from c where chunk_id % 50 = 0)
    select h.source, h.chunk_index, string_agg(c.text, chr(10) || chr(10) order by c.chunk_index) as passage from h join c on c.source = h.source and c.chunk_index between h.chunk_index - 1 and h.chunk_index + 1 group by all""",
)
def j4_neighbours(spark, d):
    c = latest_chunks(spark, d)
    return documents.with_neighbours(c.where("chunk_id % 50 = 0"), c, 1)


@query(
    "s10_documents",
    f"""with {_CHUNKS} select source, {_STEM} as stem, {_SECTION} as section, count(*) as n_chunks, max(page_no) as last_page, bool_or(doc_source <> '') as has_source,
    (row_number() over (partition by {_SECTION} order by lower({_STEM}), source))::bigint as position from c group by source""",
)
def s10_documents(spark, d):
    g = latest_chunks(spark, d).groupBy("source").agg(F.count("*").alias("n_chunks"), F.max("page_no").alias("last_page"), F.bool_or(F.col("doc_source") != "").alias("has_source"))
    g = g.withColumns({"stem": coverage.stem_of(F.col("source")), "section": coverage.section_of(F.col("source"))})
    return g.withColumn("position", F.row_number().over(Window.partitionBy("section").orderBy(F.lower("stem"), "source")).cast("bigint"))


_BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORDS = f"list_filter(string_split_regex(lower(%s), '{_BLANK}'), lambda w: w <> '')"
_TOK = rf"""tok as (select chunk_id, unnest({_WORDS % "text"}) as token from c),
  tf as (select chunk_id, token, count(*) as tf from tok group by all), len as (select chunk_id, count(*) as dl from tok group by chunk_id),
  df as (select token, count(*) as df from tf group by token), st as (select count(*) as n, avg(coalesce(dl, 0)) as avgdl from c left join len using (chunk_id)),
  idf as (select token, ln(n - df + 0.5) - ln(df + 0.5) as idf from df, st), mi as (select avg(idf) as m from idf),
  w as (select token, case when idf < 0 then 0.25 * m else idf end as idf from idf, mi),
  qs as (select chunk_id as query_id, heading from c where chunk_id % 50 = 0),
  q as (select query_id, token, count(*) as qtf from (select query_id, unnest({_WORDS % "heading"}) as token from qs) group by all),
  hit as (select query_id, tf.chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from q join w using (token) join tf using (token) join len on len.chunk_id = tf.chunk_id, st group by all),
  few as (select chunk_id from c order by chunk_id limit 20),
  sc as (select query_id, chunk_id, max(score) as score from (select * from hit union all select query_id, chunk_id, 0 from qs, few) group by all)"""


@query(
    "r5_bm25",
    f"with {_CHUNKS}, {_TOK} select query_id, chunk_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank from sc) where rank <= 10",
)
def r5_bm25(spark, d):
    """The ten best of all chunks, those of no score after the others by id."""
    c = latest_chunks(spark, d)
    q = c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("heading").alias("text"))
    return retrieval.bm25_top(c.select(F.col("chunk_id").alias("id"), "text"), q, 10).withColumnRenamed("id", "chunk_id").withColumn("score", F.round("score", 6)).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query(
    "r5_bm25_filtered",
    f"""with {_CHUNKS}, {_TOK} select query_id, chunk_id, rank, round(score, 6) as score from (select sc.*, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank
    from (select * from hit union all select query_id, chunk_id, 0 from qs, (select chunk_id from c where zone = 'body' order by chunk_id limit 20) f where (query_id, chunk_id) not in (select query_id, chunk_id from hit)) sc
    join c using (chunk_id) where zone = 'body') where rank <= 10""",
)
def r5_bm25_filtered(spark, d):
    """r5_bm25 among the chunks of the body: frequencies are of all chunks, the filter applies after scoring."""
    c = latest_chunks(spark, d)
    q = c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("heading").alias("text"))
    top = retrieval.bm25_top(c.select(F.col("chunk_id").alias("id"), "text", "zone"), q, 10, allowed=F.col("zone") == "body")
    return top.withColumnRenamed("id", "chunk_id").withColumn("score", F.round("score", 6)).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score")


_KNN = """k as (select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as cos from embeddings q join embeddings v on q.vec_id % 50 = 0),
  kr as (select *, row_number() over (partition by query_id order by cos desc, id) as rank from k)"""


@query("r4_knn", f"with {_KNN} select query_id, id, rank, cos from kr where rank <= 10")
def r4_knn(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.knn(v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10)


@query(
    "r6_rrf",
    f"""with {_KNN}, a as (select query_id, id, rank from kr where rank <= 20),
    k2 as (select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(q.embedding[1:16]::double[], v.embedding[1:16]::double[]), 6) as cos from embeddings q join embeddings v on q.vec_id % 50 = 0),
    b as (select query_id, id, rank from (select *, row_number() over (partition by query_id order by cos desc, id) as rank from k2) where rank <= 20)
    select query_id, id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 6)::double as score from a full join b using (query_id, id)""",
)
def r6_rrf(spark, d):
    """The ranking by whole vectors fused with that by their first sixteen places."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    part = v.withColumn("embedding", F.slice("embedding", 1, 16))
    a, b = (retrieval.knn(x, x.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 20) for x in (v, part))
    return retrieval.rrf(a, b).select("query_id", "id", F.round("score", 6).alias("score"))


@query("a16_acronyms")
def a16_acronyms(spark, d):
    from almagest.operators import acronyms

    return acronyms.mine_all(latest_chunks(spark, d))


_NUMBERS = r"""q as (select chunk_id as claim_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'))) as number from c where chunk_id % 50 = 0),
    k as (select claim_id, count(*) as need from q group by 1),
    f as (select source, chunk_id, unnest(regexp_extract_all(text, '(?:^|[^0-9.])([0-9]+(?:\.[0-9]+)?)', 1)) as number from c),
    h as (select source, chunk_id, number from f union select source, chunk_id, regexp_extract(number, '^[0-9]+') from f)"""


@query(
    "x8_number_support",
    f"with {_CHUNKS}, {_NUMBERS} select claim_id, source, count(*) as n_chunks from (select claim_id, source, chunk_id, need from q join k using (claim_id) join h using (number) group by all having count(*) = any_value(need)) group by all",
)
def x8_number_support(spark, d):
    from almagest.operators import verify

    c = latest_chunks(spark, d)
    return verify.number_claims(c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("claim_id"), "text"), c)


#: Collections whose passages must match better than others to be ranked before them.
PRIORITY = {"white_papers": 0.85}


@query("r1_retrieve")
def r1_retrieve(spark, d):
    """Both legs over all chunks: words by BM25, meaning by hashed vectors. The
    newest chunks and the queries are written once, since every step reads them."""
    c = cut(latest_chunks(spark, d).select("chunk_id", "source", "chunk_index", "heading", "text", "doc_source"))
    q = cut(c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.concat_ws(" ", "heading", "text").alias("text")))
    vectors = retrieval.hashed_vectors(c.select(F.col("chunk_id").alias("id"), "text"), "id", "text")
    asked = retrieval.hashed_vectors(q, "query_id", "text")
    return retrieval.retrieve(c, q, vectors=vectors, query_vectors=asked, window=1, priority=retrieval.priority_of(F.col("doc_source"), PRIORITY))


@query("x25_text_hash", f"with {_CHUNKS} select chunk_id, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as hash from c")
def x25_text_hash(spark, d):
    return latest_chunks(spark, d).select("chunk_id", documents.text_hash(F.col("text")).alias("hash"))


@query("a15_chunk_counts", f"with {_CHUNKS} select doc_source, zone, doc_status, count(*) as n, count(distinct source) as n_docs from c group by all")
def a15_chunk_counts(spark, d):
    return latest_chunks(spark, d).groupBy("doc_source", "zone", "doc_status").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_docs"))


@query("e4_not_named", f"with {_CHUNKS}, {_MENTIONS} select distinct source from c where source not in (select source from m)")
def e4_not_named(spark, d):
    c = latest_chunks(spark, d)
    m = coverage.mentions(coverage.select_chunks(c), TERMS)
    return c.select("source").distinct().join(m.select("source"), "source", "left_anti")


@query("x9_numbers", f"with {_CHUNKS} select chunk_id, len(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')))::bigint as n from c")
def x9_numbers(spark, d):
    from almagest.operators import verify

    return latest_chunks(spark, d).select("chunk_id", F.size(verify.numbers(F.col("text"))).cast("bigint").alias("n"))


@query(
    "t10_cone_search",
    """select id, round(degrees(2 * asin(sqrt(least(1.0, power(sin(radians(d + 30) / 2), 2) + cos(radians(-30)) * cos(radians(d)) * power(sin(radians(ra - 60) / 2), 2))))) * 3600.0, 3) as sep
    from (select id, ((ra_deg % 360) + 360) % 360 as ra, dec_deg as d from sources where isfinite(ra_deg) and dec_deg between -90 and 90)
    where degrees(2 * asin(sqrt(least(1.0, power(sin(radians(d + 30) / 2), 2) + cos(radians(-30)) * cos(radians(d)) * power(sin(radians(ra - 60) / 2), 2))))) * 3600.0 <= 72000""",
)
def t10_cone_search(spark, d):
    from almagest.operators import sky

    return sky.cone(sky.positions(table(spark, d, "sources"), "id"), 60.0, -30.0, 72000.0).select("id", F.round("sep_arcsec", 3).alias("sep"))
