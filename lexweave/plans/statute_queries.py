"""Queries of the statute knowledge base. The codes' mapping pairs IPC and BNS entries by their rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import statutes as S
from lexweave.operators import statutes as op
from lexweave.plans.base import STRIP, query, table

# ------------------------------------------------------------------ SQL parts

_ART = r"(?i)^(?:Art(?:icle)?s?\.?\s*)([0-9]+[A-Za-z]*)"
_SEC = STRIP("coalesce(section, '')")
_BARE = STRIP(rf"regexp_replace({_SEC}, '(?i)^(IPC|BNS|CrPC|BNSS)[_\s]*', '')")
_KEY = rf"""case when regexp_extract({_SEC}, '{_ART}', 1) <> '' then 'ARTICLE_' || upper(regexp_extract({_SEC}, '{_ART}', 1))
when upper({STRIP('law')}) = 'CONSTITUTION' then 'ARTICLE_' || upper(regexp_replace(replace({_SEC}, 'Article', ''), '[^0-9A-Za-z]', '', 'g'))
else upper(upper({STRIP('law')}) || '_' || case when {_BARE} = '' then {_SEC} else {_BARE} end) end"""
_KB = f"(select * from (select *, {_KEY} as key from statutes) qualify row_number() over (partition by key order by statute_id) = 1)"


def ref_key(c: str) -> str:
    """SQL of the key that a typed reference means."""
    # the digits of any script count; the SQL engine's own classes are ASCII
    c = STRIP(c)
    art = _ART.replace("[0-9]", r"\p{Nd}")
    sec = r"(?i)^Section\s+(\p{Nd}+[A-Za-z]*)\s+(?:of\s+)?(?:the\s+)?(IPC|BNS|CrPC|Indian Penal Code|Bharatiya Nyaya Sanhita)"
    direct = r"(?i)^(IPC|BNS|CrPC|BNSS)[_\s]+(\p{Nd}+[A-Za-z]*)"
    law = f"case when contains(upper(regexp_extract({c}, '{sec}', 2)), 'NYAYA') then 'BNS' when contains(upper(regexp_extract({c}, '{sec}', 2)), 'PENAL') then 'IPC' else upper(regexp_extract({c}, '{sec}', 2)) end"
    return rf"""case when regexp_extract({c}, '{art}', 1) <> '' then 'ARTICLE_' || upper(regexp_extract({c}, '{art}', 1))
when regexp_extract({c}, '{sec}', 1) <> '' then {law} || '_' || upper(regexp_extract({c}, '{sec}', 1))
when regexp_extract({c}, '{direct}', 1) <> '' then upper(regexp_extract({c}, '{direct}', 1)) || '_' || upper(regexp_extract({c}, '{direct}', 2))
else regexp_replace(upper({c}), '\s+', '_', 'g') end"""


_CHUNKS = "(select distinct * exclude (ingested_at) from pdf_chunks)"
_REFS = f"(select pdf_id, chunk_id, i as nth, metadata.statutes_mentioned[i] as ref, metadata.page_number as page from (select pdf_id, chunk_id, metadata, unnest(generate_series(1, len(metadata.statutes_mentioned))) as i from {_CHUNKS}) where metadata.statutes_mentioned[i] is not null)"
_MAP = f"""(with r as (select key, law, row_number() over (partition by upper(trim(law)) order by statute_id) as n from {_KB} where upper(trim(law)) in ('IPC', 'BNS'))
select a.key as ipc, b.key as bns, a.n as ord from r a join r b on upper(trim(a.law)) = 'IPC' and upper(trim(b.law)) = 'BNS' and b.n = (a.n + 1) // 2)"""


def _punish(c: str) -> str:
    forms = [r"shall be punished with (.+?)(?:\.|$)", r"punishable with (.+?)(?:\.|$)", r"punishment[:\s]+(.+?)(?:\.|$)"]
    return STRIP("coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '(?i){f}', 1), '')" for f in forms) + ")")


# ------------------------------------------------------------------ tables


def _kb(spark, folder):
    return op.first_entries(table(spark, folder, "statutes"), "statute_id")


def _chunks(spark, folder):
    return table(spark, folder, "pdf_chunks").drop("ingested_at").dropDuplicates(["pdf_id", "chunk_id"])


def _refs(spark, folder):
    return _chunks(spark, folder).select("pdf_id", "chunk_id", F.explode("metadata.statutes_mentioned").alias("ref")).where("ref is not null")


def _listed(spark, folder):
    return _chunks(spark, folder).select("pdf_id", F.col("chunk_id").alias("ord"), F.col("metadata.page_number").alias("page_number"), F.col("metadata.statutes_mentioned").alias("statutes"))


def _mapping(spark, folder):
    """(ipc, bns, ord): every BNS entry stands for two IPC entries."""
    from pyspark.sql import Window

    e = _kb(spark, folder).withColumn("code", F.upper(F.trim("law"))).where("code in ('IPC', 'BNS')")
    n = e.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("statute_id")))  # a code of some hundred entries
    ipc = n.where("code = 'IPC'").select(F.col("key").alias("ipc"), F.col("n").alias("ord"), ((F.col("n") + 1) / 2).cast("int").alias("m"))
    bns = n.where("code = 'BNS'").select(F.col("key").alias("bns"), F.col("n").alias("m"))
    return ipc.join(bns, "m").select("ipc", "bns", "ord")


# ------------------------------------------------------------------ queries


@query(f"""select law, section, title, text from (select {STRIP('law')} as law, {STRIP('section')} as section, {STRIP('title')} as title, {STRIP('text')} as text from statutes where law = 'IPC'
union all select {STRIP('law')}, {STRIP('section')}, {STRIP('title')}, {STRIP('text')} from statutes where law = 'BNS') where section <> '' and text <> ''""")
def statutes_union(spark, folder):
    s = table(spark, folder, "statutes")
    return op.union_codes(s.where("law = 'IPC'"), s.where("law = 'BNS'"))


@query(f"select statute_id, {_KEY} as key from statutes")
def normalize_key(spark, folder):
    return table(spark, folder, "statutes").select("statute_id", S.statute_key(F.col("law"), F.col("section")).alias("key"))


@query(f"select key, statute_id, title from {_KB}")
def kb_first_wins(spark, folder):
    return _kb(spark, folder).select("key", "statute_id", "title")


@query(f"select ref, {ref_key('ref')} as key, count(*) as n from {_REFS} group by all")
def parse_ref(spark, folder):
    return _refs(spark, folder).groupBy("ref", S.reference_key(F.col("ref")).alias("key")).agg(F.count("*").alias("n"))


@query(f"select statute_id, case when length(p) > 300 then substr(p, 1, 300) || '...' else p end as punishment from (select statute_id, {_punish('x')} as p from (select statute_id, title || ' shall be punished with ' || text as x from statutes))")
def punishment(spark, folder):
    x = F.concat("title", F.lit(" shall be punished with "), "text")
    return table(spark, folder, "statutes").select("statute_id", S.punishment(x).alias("punishment"))


_SIMPLE = r"nullif(regexp_extract(x, '(?is)in Simple Words\s*\n(.+)', 1), '')"


@query(rf"select statute_id, {STRIP(_SIMPLE)} as words from (select statute_id, title || case when statute_id % 2 = 0 then ' In Simple Words' || chr(10) else ' ' end || text as x from statutes)")
def simple_explanation(spark, folder):
    x = F.concat("title", F.when(F.col("statute_id") % 2 == 0, F.lit(" In Simple Words\n")).otherwise(" "), "text")
    return table(spark, folder, "statutes").select("statute_id", S.simple_words(x).alias("words"))


@query(f"select r.pdf_id, r.chunk_id, r.ref, k.key as found, k.title from {_REFS} r left join {_KB} k on k.key = {ref_key('r.ref')}")
def statute_lookup(spark, folder):
    kb = _kb(spark, folder)
    j = op.lookup(_refs(spark, folder), F.col("ref"), kb)
    return j.select("pdf_id", "chunk_id", "ref", F.when(F.col("law").isNotNull(), F.col("key")).alias("found"), "title")


@query(f"""select r.pdf_id, r.chunk_id, r.ref, m.bns as other_key, k.title as other_title from {_REFS} r left join {_MAP} m on m.ipc = {ref_key('r.ref')} left join {_KB} k on k.key = m.bns""")
def cross_code_map(spark, folder):
    j = op.across_codes(_refs(spark, folder), F.col("ref"), _mapping(spark, folder), _kb(spark, folder), "ipc", "bns")
    return j.select("pdf_id", "chunk_id", "ref", "other_key", "other_title")


@query(f"select bns, arg_max(ipc, ord) as ipc from {_MAP} group by bns")
def reverse_last_wins(spark, folder):
    return op.last_wins(_mapping(spark, folder), "bns", "ipc", "ord")


@query("""select * from (values (14, 'Equality before the law'), (19, 'Freedoms of speech and movement'), (21, 'Life and liberty'), (32, 'Remedies'), (226, 'Writs of High Courts')) v(article, title)""")
def values_relation(spark, folder):
    rows = [(14, "Equality before the law"), (19, "Freedoms of speech and movement"), (21, "Life and liberty"), (32, "Remedies"), (226, "Writs of High Courts")]
    return spark.createDataFrame(rows, "article int, title string")


@query(f"""select 'CONSTITUTION' as law, 'Article_' || v.article as section, v.title from (values (14, 'Equality before the law'), (19, 'Freedoms of speech and movement'), (21, 'Life and liberty'), (32, 'Remedies'), (226, 'Writs of High Courts')) v(article, title)
where 'ARTICLE_' || v.article not in (select key from {_KB})""")
def append_missing(spark, folder):
    new = values_relation(spark, folder).select(F.lit("CONSTITUTION").alias("law"), F.concat(F.lit("Article_"), "article").alias("section"), "title")
    keyed = new.withColumn("key", S.statute_key(F.col("law"), F.col("section")))
    return keyed.join(_kb(spark, folder).select("key"), "key", "left_anti").select("law", "section", "title")


@query(f"""with r as (select *, {ref_key('ref')} as key from {_REFS}), f as (select pdf_id, key, arg_min(ref, chunk_id * 1000 + nth) as ref from r group by all),
p as (select pdf_id, key, list(page order by o) as pages from (select pdf_id, key, page, min(chunk_id * 1000 + nth) as o from r where page is not null group by all) group by all)
select f.pdf_id, f.key, f.ref, coalesce(k.law, 'UNKNOWN') as law, coalesce(k.title, '') as title, coalesce(p.pages, []) as pages
from f left join p on p.pdf_id = f.pdf_id and p.key = f.key left join {_KB} k on k.key = f.key""")
def statute_analysis(spark, folder):
    return op.statute_analysis(_listed(spark, folder), _kb(spark, folder), "pdf_id").select("pdf_id", "key", "ref", "law", "title", "pages")


@query(f"""with r as (select pdf_id, {ref_key('ref')} as key, min(chunk_id * 1000 + nth) as o from {_REFS} group by all)
select pdf_id, 'STATUTE REFERENCE TABLE:' || chr(10) || string_agg('- ' || law || ' ' || section || case when {STRIP("coalesce(title, '')")} <> '' then ': ' || {STRIP('title')} else '' end
|| case when p is not null then ' — Punishment: ' || p else '' end, chr(10) order by o) as context
from (select r.pdf_id, r.o, k.law, k.section, k.title, {_punish('k.text')} as p from r join {_KB} k on k.key = r.key) group by pdf_id""")
def enrich_context(spark, folder):
    return op.reference_lines(_listed(spark, folder), _kb(spark, folder), "pdf_id")


@query(f"select pdf_id, list_sort(list(distinct ref)) as statutes from {_REFS} group by pdf_id")
def statutes_cited(spark, folder):
    return _refs(spark, folder).groupBy("pdf_id").agg(F.array_sort(F.collect_set("ref")).alias("statutes"))


@query("""select pdf_id, chunk_id, ref, case when upper(ref) like '%ART%' then 'ART' when upper(ref) like '%IPC%' then 'IPC' else 'BNS' end as badge
from (select pdf_id, chunk_id, unnest(metadata.statutes_mentioned) as ref from (select distinct * exclude (ingested_at) from pdf_chunks)) where ref is not null""")
def statute_badge(spark, folder):
    return _refs(spark, folder).select("pdf_id", "chunk_id", "ref", S.cited_badge(F.col("ref")).alias("badge"))


@query("select statute_id, case when law = 'IPC' then 'IPC' when law = 'BNS' then 'BNS' when law = 'CONSTITUTION' then 'ART' else 'UNKNOWN' end as badge from statutes")
def law_badge(spark, folder):
    return table(spark, folder, "statutes").select("statute_id", S.law_badge(F.col("law")).alias("badge"))


_COLS = ", ".join(f"{STRIP(c)} as {c}" for c in ("law", "section", "title", "text"))


@query(f"select * from (select {_COLS} from statutes) where section <> '' and text <> ''")
def statutes_csv(spark, folder):
    """The statutes written as CSV, read back by their names, with a second file that is not there."""
    from lexweave.sources import jsonl, tables

    path = f"{jsonl.shared_folder(spark)}/csv-{spark.sparkContext.applicationId}-{folder.strip('/').replace('/', '-')}"
    table(spark, folder, "statutes").select("law", "section", "title", "text").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    codes = [tables.read_csv_optional(spark, p, "law string, section string, title string, text string") for p in (path, path + "-missing")]
    return op.union_codes(*[c for c in codes if c is not None])
