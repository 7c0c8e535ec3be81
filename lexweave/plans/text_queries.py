"""Queries of scans, projections and predicates on text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import scans
from lexweave.plans.base import STRIP, any_of, query, table
from lexweave.sources import jsonl

_CIVIL = any_of("lower(case_type)", T.CIVIL_WORDS)
_MAP = f"case when {_CIVIL} then 'civil' when contains(lower(case_type), 'criminal') then 'criminal' when contains(lower(case_type), 'constitution') then 'constitutional' else 'other' end"
_HALF4 = "floor(({}) * 10000.0::double + 0.5) / 10000.0::double"


@query("select row_number() over (order by doc_id) - 1 as case_id, source as title, lang as court, n_chars as size from documents")
def scan_project_id(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("court"), F.col("n_chars").alias("size"))
    return scans.dense_ids(d, ["doc_id"], "case_id").select("case_id", "title", "court", "size")


@query("""select case when record is null or trim(record) = '' then 'blank' when json_valid(record) then 'read' else 'corrupt' end as status, count(*) as lines
from role_labelled_raw group by 1""")
def jsonl_scan_corrupt(spark, folder):
    parsed = jsonl.parse_lines(table(spark, folder, "role_labelled_raw"), "record", "case_id string, version int")
    return parsed.groupBy("status").agg(F.count("*").alias("lines"))


@query("select statute_id, law, section, title, text from statutes")
def jsonl_roundtrip(spark, folder):
    s = table(spark, folder, "statutes").select("statute_id", "law", "section", "title", "text")
    return jsonl.roundtrip(s)


@query("""select event_id, unnest(json_keys(props)) as key, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events""")
def json_map_explode(spark, folder):
    return jsonl.explode_map(table(spark, folder, "events"), ["event_id"], "props")


@query(f"select case_id, {_MAP} as mapped_type, count(*) as n from summarization_dataset group by all")
def map_case_type(spark, folder):
    return table(spark, folder, "summarization_dataset").groupBy("case_id", T.map_case_type(F.col("case_type")).alias("mapped_type")).agg(F.count("*").alias("n"))


@query("""select case_id, case when contains(t, 'civil') then 'civil' when contains(t, 'criminal') then 'criminal' when contains(t, 'constitution') then 'constitutional' else 'other' end as case_type
from (select case_id, lower(coalesce(case_type, 'none')) t from summarization_dataset)""")
def normalize_case_type(spark, folder):
    return table(spark, folder, "summarization_dataset").select("case_id", T.normalize_case_type(F.col("case_type")).alias("case_type"))


@query(f"select * from (select case_id, {_MAP} as case_type from summarization_dataset) where case_type in ('civil', 'criminal', 'constitutional')")
def classify_keep(spark, folder):
    d = table(spark, folder, "summarization_dataset").select("case_id", T.map_case_type(F.col("case_type")).alias("case_type"))
    return d.where(F.col("case_type").isin("civil", "criminal", "constitutional"))


@query(f"select count(*) as total, count(*) filter (where t <> 'other') as kept from (select {_MAP} as t from summarization_dataset)")
def classify_counts(spark, folder):
    d = table(spark, folder, "summarization_dataset").select(T.map_case_type(F.col("case_type")).alias("t"))
    return d.agg(F.count("*").alias("total"), F.count_if(F.col("t") != "other").alias("kept"))


@query(f"""select case_id, {STRIP("coalesce(nullif(structured_summary.decision, ''), nullif(structured_summary.reasoning, ''), nullif(input_text, ''), '')")} as text from summarization_dataset""")
def first_nonempty(spark, folder):
    s = table(spark, folder, "summarization_dataset")
    return s.select("case_id", T.first_nonempty(F.col("structured_summary.decision"), F.col("structured_summary.reasoning"), F.col("input_text")).alias("text"))


@query("select doc_id, coalesce(case_id, doc_id) as case_id from documents")
def default_id(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.coalesce("case_id", "doc_id").alias("case_id"))


_COLLAPSED = STRIP(r"regexp_replace(regexp_replace(text, '\n{4,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")


@query(f"select doc_id, {_HALF4.format(f'1.0::double - length({_COLLAPSED})::double / nullif(length(text), 0)')} as removal_ratio from documents")
def removal_ratio(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.half_up(T.removal_ratio(F.col("text"), T.collapse_space(F.col("text"))), 4).alias("removal_ratio"))


@query("select doc_id, nfc_normalize(text) as text from documents")
def nfkc(spark, folder):
    """The SQL engine has no compatibility forms; no document of the tables has any, and tests compare those."""
    return table(spark, folder, "documents").select("doc_id", T.nfkc(F.col("text")).alias("text"))


_FOOT = "text"
for _p in T.FOOTERS:
    _FOOT = f"regexp_replace({_FOOT}, '(?im){_p}', '', 'g')"


@query(f"select pdf_id, page_number, {_FOOT} as text from pdf_pages")
def footer_strip(spark, folder):
    return table(spark, folder, "pdf_pages").select("pdf_id", "page_number", T.strip_footers(F.col("text")).alias("text"))


@query(r"select pdf_id, page_number, regexp_replace(text, '[_=\-★☆♦—━]{4,}', chr(10), 'g') as text from pdf_pages")
def separator_runs(spark, folder):
    return table(spark, folder, "pdf_pages").select("pdf_id", "page_number", T.split_separators(F.col("text")).alias("text"))


@query(f"select doc_id, {_COLLAPSED} as text from documents")
def collapse_ws(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.collapse_space(F.col("text")).alias("text"))


@query(f"""select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda el: case when regexp_matches(lower(el), '{T.BENCH_WORDS.replace("'", "''")}') then '' else el end), chr(10)) as text
from documents where text is not null""")
def judge_line_blank(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.blank_bench_lines(F.col("text")).alias("text"))


@query(rf"select pdf_id, page_number, regexp_replace({STRIP('text')}, '\s+', ' ', 'g') as text from pdf_pages")
def match_normalize(spark, folder):
    return table(spark, folder, "pdf_pages").select("pdf_id", "page_number", T.match_form(F.col("text")).alias("text"))


@query(r"select case_id, para_id, nullif(regexp_extract(text, '^(\(?\d+\)?\.|[a-zA-Z]\)|[A-Z][a-z]+:)', 1), '') as marker from judgments_paragraphs")
def para_marker(spark, folder):
    return table(spark, folder, "judgments_paragraphs").select("case_id", "para_id", T.paragraph_marker(F.col("text")).alias("marker"))


@query(rf"""select case_id, para_id, regexp_matches(text, '(?i)^({"|".join(T.REASONING_OPENERS)})') as cue,
regexp_matches(text, '\bAIR\b|\bSCC\b|\bvs\.\b') as citation, regexp_matches(text, '(?i)\bSection\s+\d+|\bArticle\s+\d+') as statute from judgments_paragraphs""")
def para_flags(spark, folder):
    t = F.col("text")
    return table(spark, folder, "judgments_paragraphs").select("case_id", "para_id", T.reasoning_cue(t).alias("cue"), T.has_citation(t).alias("citation"), T.has_statute(t).alias("statute"))


@query(r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda el: el <> '')) as words from documents")
def word_count(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"))


_STOP = "['" + "','".join(T.STOPWORDS) + "']"
_KEYS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\pL\pN\pM_]+'), lambda el: regexp_full_match(el, '[a-z0-9]+') and length(el) > 2 and not list_contains({1}, el))))"


@query(f"select item_id, {_KEYS.format('text', _STOP)} as keywords from eval_items")
def keyword_set(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", T.keywords(F.col("text")).alias("keywords"))


# the SQL engine has no look-around and its \\b knows ASCII only: the bounds are written out
_REFS = r"(?i)(?:^|[^\pL\pN\pM_])(IPC\s*\p{Nd}+|BNS\s*\p{Nd}+|CrPC\s*\p{Nd}+|Section\s*\p{Nd}+\s+of\s+[A-Za-z\s]+Act|Art(?:icle)?s?\.?\s*\p{Nd}+)(?:[^\pL\pN\pM_]|$)"


@query(f"select pdf_id, chunk_id, list_sort(list_distinct(regexp_extract_all(text, '{_REFS}', 1))) as refs from pdf_chunks")
def statute_extract(spark, folder):
    return table(spark, folder, "pdf_chunks").select("pdf_id", "chunk_id", T.statute_references(F.col("text")).alias("refs"))


@query(f"""select doc_id, case when length(t) <= 1220 then t else substr(t, 1, 800) || chr(10) || '…' || chr(10) || right(t, 400) end as text
from (select doc_id, {STRIP('text')} as t from documents)""")
def truncate_head_tail(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.head_tail(F.col("text")).alias("text"))


@query(r"""select line_no, case when strpos(record, '{') > 0 and contains(record, '}') then
substr(record, strpos(record, '{'), greatest(0, length(record) - strpos(reverse(record), '}') + 1 - strpos(record, '{') + 1)) else record end as part
from role_labelled_raw""")
def extract_json(spark, folder):
    return table(spark, folder, "role_labelled_raw").select("line_no", T.json_part(F.col("record")).alias("part"))


@query(r"""select doc_id, case when len(w) > 100 then array_to_string(w[1:100], ' ') || '...' else text end as text
from (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda el: el <> '') as w from documents)""")
def word_limit(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.limit_words(F.col("text"), 100).alias("text"))


@query(f"""select doc_id, case when length(coalesce(r, '')) < 10 then source else r end as question
from (select doc_id, source, regexp_replace({STRIP("coalesce(lang, '') || ' ' || coalesce(url, '')")}, '^["'']+|["'']+$', '', 'g') as r from documents)""")
def rewrite_cleanup(spark, folder):
    answer = F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")))
    return table(spark, folder, "documents").select("doc_id", T.clean_rewrite(answer, F.col("source")).alias("question"))


@query("""select pdf_id, chunk_id, case when contains(r, 'FACTS') then 'FACTS' when contains(r, 'ISSUES') then 'ISSUES' when contains(r, 'ARGUMENTS') then 'ARGUMENTS'
when contains(r, 'REASONING') then 'REASONING' when contains(r, 'JUDGMENT') then 'JUDGMENT' else 'UNKNOWN' end as section
from (select pdf_id, chunk_id, upper(coalesce(metadata.section, '') || ' ' || text) as r from pdf_chunks)""")
def section_category(spark, folder):
    r = (F.concat(F.coalesce("metadata.section", F.lit("")), F.lit(" "), F.col("text")))
    return table(spark, folder, "pdf_chunks").select("pdf_id", "chunk_id", T.section_named(r).alias("section"))


@query(rf"""with b as (select pdf_id, page_number, k as line_no, trim(regexp_replace(lines[k], '\s+', ' ', 'g')) as text, coalesce(page_height, 842.0) as h, (k * 40 % 800)::double as y0, (k * 40 % 800)::double + 12.0 as y1
from (select pdf_id, page_number, page_height, string_split(text, chr(10)) as lines, unnest(generate_series(1, len(string_split(text, chr(10))))) as k from (select distinct * exclude (ingested_at) from pdf_pages)))
select pdf_id, page_number, line_no, text from b where line_no % 7 <> 0 and length(text) >= 10 and ((y0 >= 50.0 and y1 <= h - 50.0) or len(list_filter(string_split(text, ' '), lambda el: el <> '')) >= 15)""")
def pdf_block_filter(spark, folder):
    p = table(spark, folder, "pdf_pages").drop("ingested_at").dropDuplicates(["pdf_id", "page_number"])
    b = p.select("pdf_id", "page_number", F.coalesce("page_height", F.lit(842.0)).alias("page_height"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    b = b.withColumn("line_no", F.col("at") + 1).withColumn("y0", (F.col("line_no") * 40 % 800).cast("double")).withColumn("y1", F.col("y0") + 12)
    return scans.text_blocks(b.withColumn("block_type", (F.col("line_no") % 7 == 0).cast("int"))).select("pdf_id", "page_number", F.col("line_no").cast("bigint").alias("line_no"), "text")


@query(f"select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda el: {STRIP('el')}), lambda el: el <> ''), chr(10)) as text from documents")
def html_to_text(spark, folder):
    page = F.concat(F.lit("<html><body><p>"), F.regexp_replace("text", "\n", "</p><p>"), F.lit("</p><script>x()</script></body></html>"))
    return table(spark, folder, "documents").select("doc_id", T.html_to_text(page).alias("text"))
