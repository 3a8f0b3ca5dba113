"""Queries over papers: filters, names, bibliography, claims, facilities,
sections carried forward, glossary."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.operators import coverage, documents, papers, verify
from almagest.plans.corpus import _BLANK, _CHUNKS, _NUMBERS, _SECTION, _STEM
from almagest.plans.registry import query
from almagest.sources.tables import latest_chunks, table

#: Catalogue prefixes that stand for facilities, and what is not a mention of one.
FACILITIES = ["KRV", "QTS", "ZBN", "HLX", "RQN", "SVR", "TSY", "VMO", "WND", "GHT", "MCK", "PLQ"]
CURATED = {"VMO": [r"VMO\s+\d+\s+and"], "WND": [r"WND\s+\d+\s+(?:and|was)"]}

_BOOK = "regexp_extract(%s, '^[^/]+/([^/]+)/', 1)"
_KEY = f"concat_ws('/', {_BOOK % 'source'}, {_STEM})"
_BIB = f"""bib as (select concat_ws('/', {_BOOK % "source_path"}, {_STEM.replace("source", "source_path")}) as bib_key, min(paper) as paper, min(book) as book, min(section) as section
    from mentions where source_path is not null group by 1)"""
_PER = f"""pr as (select term, source, sum(n)::bigint as mentions from ({" union all ".join(f"select '{f}' as term, source, len(regexp_extract_all(text, $$\\b{f}s?\\b$$)) as n from c where zone in ('abstract', 'body') and doc_status = 'canonical'" for f in FACILITIES)}) group by all having sum(n) > 0)"""


def _wide(pattern: str) -> str:
    return pattern.replace(r"\s+", _BLANK).replace(r"\d", r"\p{Nd}")  # blanks and digits beyond ASCII, too


def _titles_sql() -> str:
    return "t as (select source, arg_min(heading, (chunk_index, chunk_id)) as title from c group by source)"


@query("f1_filtered", f"with {_CHUNKS} select source, count(*) as n from c where doc_source = 'skybook2' and lower({_SECTION}) = 'magnetism' group by source")
def f1_filtered(spark, d):
    return papers.selected(latest_chunks(spark, d), "skybook2", "Magnetism", strict=False).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "f4_resolved",
    f"""with {_CHUNKS}, {_titles_sql()}, w as (select distinct paper as name from mentions where trim(paper) <> '' union select distinct split_part(name, ' ', 2) from requests where split_part(name, ' ', 2) <> ''),
    e as (select name, source from w join t on lower(regexp_extract(name, '([^/]+?)(\\.[^./]*)?$', 1)) = lower({_STEM}))
    select name, source from e union select name, source from w join t on contains(lower(title), lower(name)) where name not in (select name from e)""",
)
def f4_resolved(spark, d):
    """Papers of mentions, and a word of each request's name, among stems, then titles."""
    m = table(spark, d, "mentions").select(F.col("paper").alias("name"))
    r = table(spark, d, "requests").select(F.split_part("name", F.lit(" "), F.lit(2)).alias("name"))
    return papers.resolved(m.unionByName(r), papers.titles(latest_chunks(spark, d)))


@query(
    "f7_paper_info",
    f"""with {_CHUNKS}, {_BIB}, n as (select {_KEY} as bib_key, count(*) as n_chunks, count(distinct source) as n_files from c group by 1)
    select bib.*, coalesce(n_chunks, 0) as n_chunks, coalesce(n_files, 0) as n_files from bib left join n using (bib_key)""",
)
def f7_paper_info(spark, d):
    return papers.paper_info(papers.bibliography(table(spark, d, "mentions")), latest_chunks(spark, d))


@query("j3_chunk_bibliography", f"with {_CHUNKS}, {_BIB} select chunk_id, bib.paper, bib.section from c left join bib on bib_key = {_KEY}")
def j3_chunk_bibliography(spark, d):
    c = latest_chunks(spark, d).select("chunk_id", papers.bib_key(F.col("source")).alias("bib_key"))
    return c.join(papers.bibliography(table(spark, d, "mentions")), "bib_key", "left").select("chunk_id", "paper", "section")


@query(
    "c5_missing_papers",
    f"""with {_CHUNKS}, w as (select distinct paper from requests where paper is not null), h as (select distinct {_STEM} as paper from c)
    select 'not_indexed' as kind, paper from w where paper not in (select paper from h) union all select 'no_entry', paper from h where paper not in (select paper from w)""",
)
def c5_missing_papers(spark, d):
    return papers.missing(table(spark, d, "requests"), latest_chunks(spark, d))


@query("j13_papers_without_refs", f"with {_CHUNKS} select source, count(*) as n_chunks from c group by source having count(*) filter (zone = 'references') = 0")
def j13_papers_without_refs(spark, d):
    c = latest_chunks(spark, d)
    return c.join(c.where("zone = 'references'").select("source").distinct(), "source", "left_anti").groupBy("source").agg(F.count("*").alias("n_chunks"))


@query("j14_only_chapters", f"with {_CHUNKS}, {_PER} select term, source, mentions from pr where {_STEM} in (select paper from requests)")
def j14_only_chapters(spark, d):
    """Mentions in the chapters that some request comes from."""
    only = table(spark, d, "requests").select(F.col("paper").alias("stem")).distinct()
    m = coverage.mentions(coverage.select_chunks(latest_chunks(spark, d)), FACILITIES)
    return m.withColumn("stem", coverage.stem_of(F.col("source"))).join(only, "stem", "left_semi").drop("stem")


@query(
    "x45_claim_verdicts",
    f"""with {_CHUNKS}, {_NUMBERS}, s as (select claim_id, source from (select claim_id, source, chunk_id, need from q join k using (claim_id) join h using (number) group by all having count(*) = any_value(need)) group by all),
    cl as (select k.claim_id, n.source as paper from k left join c n on n.chunk_id = k.claim_id + 1)
    select claim_id, case when paper is null then case when count(s.source) > 0 then 'found' else 'not_found' end
      when bool_or(s.source = paper) then 'supported_by_claimed_paper' when count(s.source) > 0 then 'found_in_other_paper' else 'not_found' end as verdict
    from cl left join s using (claim_id) group by claim_id, paper""",
)
def x45_claim_verdicts(spark, d):
    """Every fiftieth chunk as a claim, ascribed to the paper of the next chunk; claims with numbers only."""
    c = latest_chunks(spark, d)
    claims = c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("claim_id"), "text").where(F.size(verify.numbers(F.col("text"))) > 0)
    claims = claims.join(c.select((F.col("chunk_id") - 1).alias("claim_id"), F.col("source").alias("paper")), "claim_id", "left")
    return verify.verdicts(claims, verify.number_claims(claims, c))


@query(
    "a5_facility_network",
    f"""with {_CHUNKS}, {_PER}, f(term) as (values {", ".join(f"('{x}')" for x in FACILITIES)})
    select 'node' as kind, term as a, null::varchar as b, count(source) as n_papers, coalesce(sum(mentions), 0)::bigint as mentions from f left join pr using (term) group by term
    union all select 'edge', x.term, y.term, count(*), sum(least(x.mentions, y.mentions))::bigint from pr x join pr y on x.source = y.source and x.term < y.term group by x.term, y.term""",
)
def a5_facility_network(spark, d):
    return papers.facility_network(coverage.mentions(coverage.select_chunks(latest_chunks(spark, d)), FACILITIES), FACILITIES)


@query(
    "x5_guarded_facilities",
    f"""with {_CHUNKS} select * from ({" union all ".join(f"select '{t}' as term, source, sum(len(regexp_extract_all(text, $$\\b{t}s?\\b$$)) - len(regexp_extract_all(text, $$(?i){_wide(g[0])}$$)))::bigint as mentions from c where zone in ('abstract', 'body') and doc_status = 'canonical' group by source" for t, g in CURATED.items())}) where mentions > 0""",
)
def x5_guarded_facilities(spark, d):
    """Mentions outside the curated guards; a match of these guards holds one mention each."""
    c = coverage.select_chunks(latest_chunks(spark, d))
    a, b = (coverage.mentions_guarded(c, t, coverage.guards_of([t], CURATED)) for t in CURATED)
    return a.unionByName(b)


@query("w8_sections_carried", f"with {_CHUNKS} select chunk_id, last_value(nullif(section_path, '') ignore nulls) over (partition by source order by chunk_index, chunk_id rows unbounded preceding) as value from c")
def w8_sections_carried(spark, d):
    return papers.carried_forward(latest_chunks(spark, d), "section_path")


@query(
    "x11_glossary",
    rf"""with {_CHUNKS}, l as (select source, chunk_index, unnest(string_split_regex(text, '\r\n|\r|\n')) as t, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) as line from c),
    p as (select source, chunk_index, line, trim(t, ' ') as t from l),
    g as (select source, chunk_index, line, regexp_replace(split_part(t, ' ', 1), '[:–\-]$', '') as acronym, regexp_replace(trim(substr(t, length(split_part(t, ' ', 1)) + 1), ' '), '^[:–\-]\s+', '') as expansion from p)
    select acronym, arg_min(expansion, (source, chunk_index, line)) as expansion from g
    where regexp_matches(acronym, '^[A-Z][A-Z0-9.\-]{{1,15}}$') and regexp_matches(expansion, '^[A-Za-z]') and length(expansion) between 5 and 81 group by acronym""",
)
def x11_glossary(spark, d):
    return papers.glossary(latest_chunks(spark, d))


@query(
    "x31_categories",
    "select alias, case "
    + " ".join(f"when regexp_matches(lower(alias), $$\\b(?:{'|'.join(w)})s?\\b$$) then '{n}'" for n, w in papers.CATEGORIES.items())
    + f" else '{papers.OTHER_CATEGORY}' end as category from catalog_aliases",
)
def x31_categories(spark, d):
    return table(spark, d, "catalog_aliases").select("alias", papers.category(F.col("alias")).alias("category"))


@query(
    "x42_slugs",
    rf"with {_CHUNKS} select chunk_id, regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug, length(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))::bigint as n from c",
)
def x42_slugs(spark, d):
    return latest_chunks(spark, d).select("chunk_id", papers.slug(F.col("heading")).alias("slug"), F.length(papers.collapsed(F.col("text"))).cast("bigint").alias("n"))


@query(
    "a30_heat_matrix",
    f"""with {_CHUNKS}, {_PER}, s as (select {_SECTION} as section, count(distinct source) as n from c group by 1)
    select term, section, count(*) as n_papers, round(count(*) / any_value(s.n), 4) as share from (select *, {_SECTION} as section from pr) join s using (section) group by term, section""",
)
def a30_heat_matrix(spark, d):
    """The share of each section's papers that mention a facility."""
    c = latest_chunks(spark, d)
    section = coverage.section_of(F.col("source")).alias("section")
    n = c.select("source").distinct().groupBy(section).agg(F.count("*").alias("n"))
    m = coverage.mentions(coverage.select_chunks(c), FACILITIES).groupBy("term", section).agg(F.count("*").alias("n_papers"))
    return m.join(n, "section").select("term", "section", "n_papers", F.round(F.col("n_papers") / F.col("n"), 4).alias("share"))


@query("c2_manifest", f"with {_CHUNKS} select doc_source, count(distinct source) as n_docs, count(*) as n_chunks, count(*) filter (doc_status = 'canonical') as n_canonical, max(ingested_at) as newest from c group by doc_source")
def c2_manifest(spark, d):
    return latest_chunks(spark, d).groupBy("doc_source").agg(F.count_distinct("source").alias("n_docs"), F.count("*").alias("n_chunks"), F.count_if(F.col("doc_status") == "canonical").alias("n_canonical"), F.max("ingested_at").alias("newest"))


@query("s25_retag")
def s25_retag(spark, d):
    """Zone and status of every chunk, worked out anew."""
    c = latest_chunks(spark, d)
    copies = documents.duplicates(c, F.length(coverage.stem_of(F.col("source"))))
    return documents.assign_zones(c).join(copies.select("source", "status"), "source").select("chunk_id", "zone", F.col("status").alias("doc_status"))


@query(
    "s9_document_chunks",
    f"""with {_CHUNKS} select source, chunk_index, chunk_id, n_all from (select *, row_number() over (partition by source order by chunk_index, chunk_id) as rn, count(*) over (partition by source) as n_all from c
    where {_STEM} in (select paper from requests where id % 50 = 0)) where rn <= 3""",
)
def s9_document_chunks(spark, d):
    """The first three chunks of the papers of every fiftieth request, and how many each has."""
    wanted = table(spark, d, "requests").where("id % 50 = 0").select(F.col("paper").alias("stem")).distinct()
    return documents.first_chunks(latest_chunks(spark, d), wanted, 3)
