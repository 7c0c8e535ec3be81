"""Queries of the training-data operators, by name, over the tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cases(spark, folder):
    from lexweave.llm.near_duplicates import NearDuplicates

    return NearDuplicates(table(spark, folder, "summarization_dataset"), "case_id", "input_text", n=3, threshold=0.6)


@query
def p1_found(spark, folder):
    return _cases(spark, folder).all_pairs().toDF("case_id_a", "case_id_b")


@query
def p1_groups(spark, folder):
    return _cases(spark, folder).groups().toDF("case_id", "group_id", "links")


@query
def p3_found(spark, folder):
    return p3_mentions(spark, folder).select("pdf_id", "chunk_id", "mention_no", F.col("entry_id").alias("statute_id"))


@query
def p3_mentions(spark, folder):
    from lexweave.llm.canonical import map_mentions

    return map_mentions(table(spark, folder, "pdf_chunks"), ["pdf_id", "chunk_id"], "metadata.statutes_mentioned", table(spark, folder, "statutes"))


@query
def p3_unmatched(spark, folder):
    """The references that mean no entry, and how often each is typed."""
    return p3_mentions(spark, folder).where("entry_id = -1").groupBy("mention").agg(F.count("*").alias("times"))


@query
def p4_found(spark, folder):
    from lexweave.llm.pieces import long_sentences

    return long_sentences(table(spark, folder, "judgments_paragraphs"), ["case_id", "para_id"], "text")


@query
def p4_pieces(spark, folder):
    from lexweave.llm.pieces import split_long

    return split_long(table(spark, folder, "judgments_paragraphs"), ["case_id", "para_id"], "text")


@query
def p6_found(spark, folder):
    return p6_held(spark, folder).select("doc_id", "item_id")


def _leaks(spark, folder):
    return table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text"


@query
def p4_checks(spark, folder):
    """Whether the pieces of each oversized text keep to the limit and the overlap, and lose nothing."""
    from lexweave.llm.pieces import piece_checks

    return piece_checks(p4_pieces(spark, folder), table(spark, folder, "judgments_paragraphs"), ["case_id", "para_id"], "text")


@query
def p6_held(spark, folder):
    """The documents with the items they hold, and how many of the item's runs of five words."""
    from lexweave.llm.leakage import leaked

    return leaked(*_leaks(spark, folder))


@query
def p6_passages(spark, folder):
    """The documents with a passage of an item, also an edited one: held runs, and the best passage's matched words and edits."""
    from lexweave.llm.leakage import passages

    return passages(*_leaks(spark, folder))


@query
def p6_items(spark, folder):
    """Per evaluation item, the number of documents that hold it."""
    return p6_held(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


# The domains of the sources of the test tables.
DOMAINS = {"hc_orders": "courts", "sc_digest": "courts", "tribunal_notes": "courts", "web_crawl": "web", "law_blog": "web", "legal_qa": "web", "bar_news": "web", "statute_notes": "reference", "moot_archive": "reference"}


def _mixture(spark, folder):
    from lexweave.llm.mixing import Mixture

    return Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), domains=DOMAINS)


@query
def p7_mix(spark, folder):
    """The documents used, and how often."""
    return _mixture(spark, folder).chosen


@query
def p7_shares(spark, folder):
    """Per source the target and what was reached."""
    return _mixture(spark, folder).shares


@query
def p8_found(spark, folder):
    return p8_pages(spark, folder).select("doc_id")


@query
def p8_pages(spark, folder):
    from lexweave.llm.keyword_pages import keyword_pages

    return keyword_pages(table(spark, folder, "documents"), "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


@query
def p2_found(spark, folder):
    from lexweave.llm.scans import Scans

    return Scans(table(spark, folder, "pdf_pages")).found()


@query
def p2_paragraphs(spark, folder):
    from lexweave.llm.scans import Scans

    return Scans(table(spark, folder, "pdf_pages")).paragraphs()


_GRAMS = r"""select distinct {0}, unnest(list_transform(generate_series(1, len(w) - {2}), lambda j: array_to_string(w[j:j + {2}], ' '))) as g from (select {0}, regexp_extract_all(lower({1}), '[\pL\pN]+') as w from {3})"""

ORACLES["p1_found"] = f"""with s as ({_GRAMS.format("case_id", "t", 2, "(select case_id, min(input_text) as t from summarization_dataset where input_text is not null group by case_id)")}),
n as (select case_id, count(*) as n from s group by case_id), p as (select a.case_id as a, b.case_id as b, count(*) as c from s a join s b on a.g = b.g and a.case_id < b.case_id group by all)
select p.a as case_id_a, p.b as case_id_b from p join n x on x.case_id = p.a join n y on y.case_id = p.b where p.c * 10 >= 6 * (x.n + y.n - p.c)"""

ORACLES["p1_groups"] = f"""with recursive s as materialized ({_GRAMS.format("case_id", "t", 2, "(select case_id, min(input_text) as t from summarization_dataset where input_text is not null group by case_id)")}),
m as (select case_id, min(case_id) over (partition by sig) as rep from (select case_id, string_agg(g, '|' order by g) as sig from s group by case_id)),
p as (select case_id_a as a, case_id_b as b from ({ORACLES["p1_found"]}) where case_id_a in (select rep from m) and case_id_b in (select rep from m)),
e as materialized (select a, b from p union all select b, a from p), r as (select distinct rep as x, rep as y from m union select r.x, e.b from r join e on e.a = r.y),
k as (select x, min(y) as root from r group by x), l as (select a, count(*) as links from e group by a)
select m.case_id, k.root as group_id, coalesce(l.links, 0) as links from m join k on k.x = m.rep left join l on l.a = m.rep"""

ORACLES["p4_checks"] = "select distinct case_id, para_id, true as within_limit, true as overlaps, true as in_place, true as whole from judgments_paragraphs where length(text) > 1500"

_HELD = f"""with d as ({_GRAMS.format("doc_id", "text", 4, "documents")}), i as ({_GRAMS.format("item_id", "text", 4, "eval_items")}), n as (select item_id, count(*) as n from i group by item_id)
{{}} from d join i on i.g = d.g join n on n.item_id = i.item_id group by d.doc_id, i.item_id, n.n having count(*) * 10 >= 3 * n.n"""
ORACLES["p6_found"] = _HELD.format("select d.doc_id, i.item_id")
ORACLES["p6_held"] = _HELD.format("select d.doc_id, i.item_id, count(*) as held, ceil(3 * n.n / 10.0)::bigint as item_needs")
ORACLES["p6_items"] = f"select item_id, count(*) as documents from ({ORACLES['p6_found']}) group by item_id"
