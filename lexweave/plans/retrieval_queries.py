"""Queries of vector search, retrieval, responses and summaries.

Evaluation items are the questions, all chunks of PDFs the texts that are searched; both are embedded
by their words. Plain vector search is over the embeddings table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import models, retrieval, vectors
from lexweave.plans.base import ORACLES, query, table
from lexweave.plans.statute_queries import _KB, ref_key
from lexweave.plans.text_queries import _KEYS, _STOP
from lexweave.sources import jsonl, tables

_D = "list_transform(embedding, lambda el: el::double)"
# the same sums in the same order: a left fold, as the engines' own sums may reorder
_FOLD = "list_reduce(list_transform(generate_series(1, len({0})), lambda j: ({0}[j] - {1}[j]) * ({0}[j] - {1}[j])), lambda acc, nx: acc + nx, 0.0::double)"
_DOT = "list_reduce(list_transform(generate_series(1, len({0})), lambda j: {0}[j] * {1}[j]), lambda acc, nx: acc + nx, 0.0::double)"
_V = f"(select vec_id, {_D} as v, label from embeddings)"
_R = lambda x, k: f"floor(({x}) * {float(10**k)}::double + 0.5) / {float(10**k)}::double"
_NEAR = f"""(select query_id, vec_id, score, row_number() over (partition by query_id order by score, vec_id) as rank from (select q.vec_id as query_id, x.vec_id, {_FOLD.format('x.v', 'q.v')} as score from {_V} q, {_V} x where q.vec_id % 20 = 0)
qualify row_number() over (partition by query_id order by score, vec_id) <= 5)"""


def _vectors(spark, folder):
    return table(spark, folder, "embeddings")


def _first(spark, folder):
    return list(_vectors(spark, folder).where("vec_id = 0").first()["embedding"])


def _queries(spark, folder):
    return _vectors(spark, folder).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"select x.vec_id, {_R(_FOLD.format('x.v', 'q.v'), 6)} as score, {_R('greatest(0.0, 100.0 / (' + _FOLD.format('x.v', 'q.v') + ' + 1))', 4)} as similarity_pct from {_V} q, {_V} x where q.vec_id = 0 order by {_FOLD.format('x.v', 'q.v')}, x.vec_id limit 5")
def knn_l2(spark, folder):
    n = vectors.nearest(_vectors(spark, folder), _first(spark, folder), 5)
    return n.select("vec_id", T.half_up(F.col("score"), 6).alias("score"), T.half_up(F.col("similarity_pct"), 4).alias("similarity_pct"))


_U = f"(select vec_id, list_transform(v, lambda el: el / sqrt({_DOT.format('v', 'v')})) as v from {_V})"


@query(f"select x.vec_id, {_R(_DOT.format('x.v', 'q.v'), 6)} as score, {_R('100.0 * ' + _DOT.format('x.v', 'q.v'), 4)} as similarity_pct from {_U} q, {_U} x where q.vec_id = 0 order by {_DOT.format('x.v', 'q.v')} desc, x.vec_id limit 5")
def knn_cosine(spark, folder):
    n = vectors.nearest(_vectors(spark, folder), _first(spark, folder), 5, "cosine")
    return n.select("vec_id", T.half_up(F.col("score"), 6).alias("score"), T.half_up(F.col("similarity_pct"), 4).alias("similarity_pct"))


@query(f"select vec_id, {_R('sqrt(' + _DOT.format('v', 'v') + ')', 6)} as norm, {_R('v[1]', 6)} as first from {_U}")
def l2_normalize(spark, folder):
    v = _vectors(spark, folder).select("vec_id", vectors.unit(vectors.doubles(F.col("embedding"))).alias("v"))
    return v.select("vec_id", T.half_up(vectors.norm(F.col("v")), 6).alias("norm"), T.half_up(F.get("v", 0), 6).alias("first"))


@query(f"select a.vec_id, {_R(_DOT.format('a.v', 'b.v'), 6)} as cosine from {_U} a join {_U} b on b.vec_id = a.vec_id + 1")
def pairwise_cosine(spark, folder):
    u = _vectors(spark, folder).select("vec_id", vectors.unit(vectors.doubles(F.col("embedding"))).alias("v"))
    b = u.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return u.join(b, "vec_id").select("vec_id", T.half_up(vectors.dot(F.col("v"), F.col("w")), 6).alias("cosine"))


@query(f"select query_id, vec_id, rank, {_R('score', 6)} as score, {_R('greatest(0.0, 100.0 / (score + 1))', 2)} as similarity_pct from {_NEAR}")
def knn_batch(spark, folder):
    n = vectors.nearest_each(_vectors(spark, folder), _queries(spark, folder), 5)
    return n.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), T.half_up(F.col("score"), 6).alias("score"), retrieval.similarity_pct(F.col("score")).alias("similarity_pct"))


@query(f"select query_id, vec_id, pct, case when pct >= 70 then 'green' when pct >= 50 then 'amber' else 'red' end as band, least(pct, 100.0::double) as bar from (select query_id, vec_id, {_R('greatest(0.0, 100.0 / (score + 1))', 2)} as pct from {_NEAR})")
def similarity_band(spark, folder):
    n = vectors.nearest_each(_vectors(spark, folder), _queries(spark, folder), 5).select("query_id", "vec_id", retrieval.similarity_pct(F.col("score")).alias("pct"))
    return n.select("query_id", "vec_id", "pct", retrieval.band(F.col("pct")).alias("band"), F.least("pct", F.lit(100.0)).alias("bar"))


@query("select max(len(embedding))::int as dimension, min(len(embedding))::int as least, count(*) as total_vectors from embeddings")
def embedding_dim_check(spark, folder):
    return vectors.check_dimension(_vectors(spark, folder))


@query("select vec_id, label, len(embedding)::int as dimension from embeddings")
def index_roundtrip(spark, folder):
    path = f"{jsonl.shared_folder(spark)}/index-{spark.sparkContext.applicationId}-{folder.strip('/').replace('/', '-')}"
    tables.save_index(_vectors(spark, folder), path)
    v, manifest = tables.load_index(spark, path)
    return v.select("vec_id", "label", F.lit(manifest["dimension"]).alias("dimension"))


_TEXTS = "(select row_number() over (order by pdf_id, chunk_id) - 1 as vec_id, pdf_id, chunk_id, text from (select distinct * exclude (ingested_at) from pdf_chunks))"


def _chunks(spark, folder):
    """pdf_chunks with dense numbers, to which the vectors of those numbers belong."""
    from lexweave.operators.scans import dense_ids

    c = table(spark, folder, "pdf_chunks").drop("ingested_at").dropDuplicates(["pdf_id", "chunk_id"])
    return dense_ids(c.select("pdf_id", "chunk_id", "text"), ["pdf_id", "chunk_id"], "vec_id")


@query(f"select t.vec_id, t.pdf_id, t.chunk_id, e.label from {_TEXTS} t left join embeddings e on e.vec_id = t.vec_id")
def vector_attach(spark, folder):
    """Every chunk with the label of the vector of its number; null where there is none."""
    return _chunks(spark, folder).join(_vectors(spark, folder), "vec_id", "left").select("vec_id", "pdf_id", "chunk_id", "label")


def _questions(spark, folder):
    return table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _hits(spark, folder):
    return retrieval.retrieve(_questions(spark, folder), _chunks(spark, folder))


def _embedded(source: str, number: str) -> str:
    """SQL: (id, v) of the texts of a table, by models.hashing_embedder."""
    return f"""(with e_w as (select {number} as id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) as w from {source} where text is not null),
e_c as (select id, ('0x' || substr(md5(w), 1, 4))::int % 64 as d, sum(case when substr(md5(w), 5, 2) < '80' then 1 else -1 end) as c from e_w group by all), e_n as (select id, sqrt(sum(c * c)::double) as n from e_c group by id)
select t.id, list(case when n > 0 then coalesce(c, 0)::double / n else 0.0 end::float::double order by x.d) as v from (select {number} as id from {source} where text is not null) t cross join (select unnest(range(64)) as d) x
left join e_c on e_c.id = t.id and e_c.d = x.d left join e_n on e_n.id = t.id group by t.id)"""


@query(f"select id as item_id, list_transform(v, lambda el: {_R('el', 5)}) as embedding from {_embedded('eval_items', 'item_id')}")
def embed_texts(spark, folder):
    e = models.embedded(table(spark, folder, "eval_items"), "text", models.hashing_embedder())
    return e.select("item_id", F.transform("embedding", lambda x: T.half_up(x.cast("double"), 5)).alias("embedding"))


_HITS = f"""(select *, list_sort(list_filter(qk, lambda el: list_contains(ck, el))) as common from (select query_id, vec_id, score, rank, question, text, {_KEYS.format('question', _STOP)} as qk, {_KEYS.format('text', _STOP)} as ck from
(select s.query_id, i.text as question, s.vec_id, t.text, s.score, s.rank from (select q.id as query_id, x.id as vec_id, {_FOLD.format('x.v', 'q.v')} as score, row_number() over (partition by q.id order by {_FOLD.format('x.v', 'q.v')}, x.id) as rank
from {_embedded('eval_items', 'item_id')} q, {_embedded(_TEXTS, 'vec_id')} x) s join eval_items i on i.item_id = s.query_id join {_TEXTS} t on t.vec_id = s.vec_id where s.rank <= 5)))"""


@query(f"select query_id, rank, vec_id, common as matching, len(common)::int as overlap_count, {_R('len(common)::double / greatest(len(qk), 1)', 2)} as overlap_ratio from {_HITS}")
def keyword_overlap(spark, folder):
    o = F.col("keyword_overlap")
    return _hits(spark, folder).select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", o["matching_keywords"].alias("matching"), o["overlap_count"].alias("overlap_count"), o["overlap_ratio"].alias("overlap_ratio"))


@query(f"select query_id, rank, {_R('least(1.0, len(common)::double / greatest(len(qk), 1))', 2)} as coverage from {_HITS}")
def keyword_coverage(spark, folder):
    return _hits(spark, folder).select("query_id", F.col("rank").cast("bigint").alias("rank"), F.least(F.col("keyword_overlap.overlap_ratio"), F.lit(1.0)).alias("coverage"))


@query(f"select distinct word from (select unnest({_KEYS.format('text', _STOP)}) as word from eval_items) where word in (select unnest({_KEYS.format('text', _STOP)}) from pdf_chunks)")
def keyword_semi(spark, folder):
    words = lambda n: table(spark, folder, n).select(F.explode(T.keywords(F.col("text"))).alias("word")).distinct()
    return words("eval_items").join(words("pdf_chunks"), "word", "left_semi")


@query(f"select query_id, string_agg('[Source ' || rank || ']' || chr(10) || text, chr(10) || '---' || chr(10) order by rank) as context from {_HITS} group by query_id")
def context_assembly(spark, folder):
    return retrieval.context(_hits(spark, folder))


def _indexed(spark, folder):
    """The chunks as an index holds them: with their page, section and references."""
    from lexweave.operators.scans import dense_ids

    c = table(spark, folder, "pdf_chunks").drop("ingested_at").dropDuplicates(["pdf_id", "chunk_id"])
    c = c.select("pdf_id", "chunk_id", "text", F.col("metadata.page_number").alias("page_number"), F.col("metadata.section").alias("section"), F.col("metadata.statutes_mentioned").alias("statutes"))
    return dense_ids(c, ["pdf_id", "chunk_id"], "vec_id")


def _responses(spark, folder):
    from lexweave.operators.statutes import first_entries

    return retrieval.responses(_questions(spark, folder), _indexed(spark, folder), first_entries(table(spark, folder, "statutes"), "statute_id"))


_META = "(select row_number() over (order by pdf_id, chunk_id) - 1 as vec_id, metadata.page_number as page, metadata.section as section, coalesce(metadata.statutes_mentioned, []) as statutes from (select distinct * exclude (ingested_at) from pdf_chunks))"
_CITED = f"(select query_id, rank, page, unnest(statutes) as ref, generate_subscripts(statutes, 1) as nth from {_HITS} join {_META} using (vec_id))"
_CITED = f"(select *, {ref_key('ref')} as key from {_CITED} where ref is not null)"


@query(f"select query_id, rank, vec_id, page, section, statutes, {_R('greatest(0.0, 100.0 / (score + 1))', 2)} as similarity_pct, common as matching, substr(text, 1, 200) || '...' as preview from {_HITS} join {_META} using (vec_id)")
def source_attribution(spark, folder):
    s = _responses(spark, folder).select("query_id", F.explode("sources").alias("s"))
    return s.select("query_id", F.col("s.rank").cast("bigint").alias("rank"), "s.vec_id", "s.page", "s.section", "s.statutes", "s.similarity_pct", "s.matching", "s.preview")


@query(f"select query_id, any_value(question) as question, list(vec_id order by rank) as sources, 4 as steps from {_HITS} group by query_id")
def rag_response(spark, folder):
    r = _responses(spark, folder)
    return r.select("query_id", "question", F.transform("sources", lambda s: s["vec_id"]).alias("sources"), F.size("trace").alias("steps"))


@query(f"""select query_id, key, coalesce(law, 'UNKNOWN') as law, coalesce(title, '') as title, pages from (select query_id, key, coalesce(list_sort(list(distinct page) filter (page is not null)), []) as pages from {_CITED} group by all) left join {_KB} using (key)""")
def rag_statutes(spark, folder):
    """The statutes that a question's hits cite, with their entries and pages."""
    s = _responses(spark, folder).select("query_id", F.explode("statutes").alias("s"))
    return s.select("query_id", "s.key", "s.law", "s.title", F.array_sort("s.pages").alias("pages"))


@query(f"""with t as (select query_id, any_value(question) as question, count(*) as hits from {_HITS} group by query_id), s as (select query_id, count(distinct key) as n from {_CITED} group by query_id),
j as (select query_id, question, hits || ' chunks' as c, coalesce(n, 0) || ' statutes' as n from t left join s using (query_id))
select query_id, 1 as step, 'rewrite' as action, question as input, question as output from j union all select query_id, 2, 'search', question, c from j union all select query_id, 3, 'statutes', c, n from j union all select query_id, 4, 'answer', c || ', ' || n, 'answered' from j""")
def rag_trace(spark, folder):
    """What each step was given and gave."""
    return _responses(spark, folder).select("query_id", F.explode("trace").alias("t")).select("query_id", "t.*")


@query(f"select query_id, substr(split_part(trim('[Source 1]' || chr(10) || arg_min(text, rank) || chr(10) || '---', ' ' || chr(10)), '. ', 1), 1, 300) as answer from {_HITS} group by query_id")
def rag_answers(spark, folder):
    return _responses(spark, folder).select("query_id", "answer")


_SECT = "(select pdf_id, metadata.section as section, string_agg(text, ' ' order by chunk_id) as text from (select distinct * exclude (ingested_at) from pdf_chunks) where metadata.section is not null group by all)"


def _sections(spark, folder):
    c = table(spark, folder, "pdf_chunks").drop("ingested_at").dropDuplicates(["pdf_id", "chunk_id"])
    return c.select("pdf_id", "chunk_id", "text", F.col("metadata.section").alias("section"))


@query(f"select pdf_id, section, text from {_SECT}")
def section_concat(spark, folder):
    return retrieval.section_texts(_sections(spark, folder), "pdf_id")


@query("select pdf_id, arg_min(text, chunk_id) as title from pdf_chunks group by pdf_id")
def case_title(spark, folder):
    return table(spark, folder, "pdf_chunks").groupBy("pdf_id").agg(F.min_by("text", "chunk_id").alias("title"))


@query(f"""select d.pdf_id, d.section, t.text is null as empty from (select pdf_id, unnest(['FACTS', 'ISSUES', 'ARGUMENTS', 'REASONING', 'JUDGMENT']) as section from (select distinct pdf_id from pdf_chunks)) d left join {_SECT} t on t.pdf_id = d.pdf_id and t.section = d.section""")
def doc_summary(spark, folder):
    s = retrieval.document_summaries(_sections(spark, folder), "pdf_id")
    return s.select("pdf_id", "section", (F.col("summary") == retrieval.EMPTY).alias("empty"))


@query("select user_id, event_id, rank from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) where rank <= 5")
def recent_queries(spark, folder):
    return retrieval.recent(table(spark, folder, "events")).select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


def _store(spark, folder, name):
    return f"{jsonl.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select pdf_id, chunk_id, text from (select distinct * exclude (ingested_at) from pdf_chunks) qualify pdf_id % 2 = 1 or chunk_id = min(chunk_id) over (partition by pdf_id)")
def ingest_replace(spark, folder):
    """All documents stored, and those of even number ingested again with their first chunk alone: nothing of the first delivery is left of them."""
    c = table(spark, folder, "pdf_chunks").drop("ingested_at").dropDuplicates(["pdf_id", "chunk_id"]).select("pdf_id", "chunk_id", "text")
    path = _store(spark, folder, "chunks")
    tables.replace_documents(c, path, "pdf_id")
    tables.replace_documents(c.where("pdf_id % 2 = 0").groupBy("pdf_id").agg(F.min(F.struct("chunk_id", "text")).alias("x")).select("pdf_id", "x.*"), path, "pdf_id")
    return tables.stored_documents(spark, path)


@query(ORACLES["doc_summary"])
def summary_reload(spark, folder):
    """Summaries stored beside their index and reloaded."""
    path = _store(spark, folder, "summaries")
    tables.replace_documents(doc_summary(spark, folder), path, "pdf_id")
    return tables.stored_documents(spark, path)
