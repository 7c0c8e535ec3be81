"""Batch retrieval with explanations, responses and document summaries.

A batch of questions goes through rewriting, search, statute analysis and answering as one plan;
what belongs to one question is at most its MOST_HITS hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import clean_rewrite, half_up, keywords, limit_words
from lexweave.operators.models import Embed, Generate, embedded, generated, hashing_embedder, offline_generate, offline_rewrite
from lexweave.operators.statutes import reference_lines, sized, statute_analysis
from lexweave.operators.vectors import nearest_each
from lexweave.session import durable


#: The most hits that may be asked for.
MOST_HITS = 10


def overlap(query: Column, text: Column) -> Column:
    """struct<query_keywords, matching_keywords, overlap_count, overlap_ratio> of arrays of keywords."""
    both = F.array_sort(F.array_intersect(query, text))
    n = F.greatest(F.size(query), F.lit(1))
    return F.struct(query.alias("query_keywords"), both.alias("matching_keywords"), F.size(both).alias("overlap_count"), half_up(F.size(both).cast("double") / n, 2).alias("overlap_ratio"))


def similarity_pct(score: Column) -> Column:
    """Of a squared distance."""
    return half_up(F.greatest(F.lit(0.0), F.lit(100.0) / (score + 1)), 2)


def band(pct: Column) -> Column:
    return F.when(pct >= 70, "green").when(pct >= 50, "amber").otherwise("red")


def rewritten(questions: DataFrame, client: Generate = offline_rewrite) -> DataFrame:
    """questions (query_id, question) with `rewritten` and `search`: the model's wording, or the question where that is too short or the call failed."""
    rules = "Rewrite the question as one paragraph for a search in court judgments: write abbreviations out, add related legal terms, do not answer it.\n"
    q = questions.where("query_id is not null and question is not null").withColumn("rewritten", clean_rewrite(generated(F.concat(F.lit(rules), F.regexp_replace("question", r"[\r\n]+", " ")), client), F.col("question")))
    return q.withColumn("search", F.col("rewritten"))


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 5, client: Embed | None = None) -> DataFrame:
    """A row per question and hit: query_id, rank, vec_id, score, similarity_pct, keyword_overlap, question, text and the chunk's other columns.

    questions: query_id, question and `search`, the text searched for (by default the question);
    chunks: vec_id, text. Both are embedded by the client, all of them are compared, and only the
    hits' texts are shuffled. Null texts are not found. k is 1 to MOST_HITS.
    """
    if not 1 <= k <= MOST_HITS:
        raise ValueError(f"k is 1 to {MOST_HITS}")
    client = client or hashing_embedder()
    search = F.col("search" if "search" in questions.columns else "question")
    asked = embedded(questions.select("query_id", search.alias("t")).where("t is not null"), "t", client).select("query_id", "embedding")
    held = embedded(chunks.select("vec_id", "text").where("text is not null"), "text", client).select("vec_id", "embedding")
    hits = nearest_each(held, asked, k)
    j = hits.join(sized(questions.select("query_id", "question"), 100_000), "query_id").join(chunks, "vec_id")
    o = overlap(keywords(F.col("question")), keywords(F.col("text")))
    return j.withColumn("similarity_pct", similarity_pct(F.col("score"))).withColumn("keyword_overlap", o)


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): a question's hits in order, with a marker before each and a rule between them."""
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]\n"), F.col("text"))
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("x"))
    return g.select("query_id", F.array_join(F.transform("x", lambda v: v["part"]), "\n---\n").alias("context"))


RULES = "\n\nAnswer only from the sources, name them as [Source n], cite statutes as the table gives them, and say so if the sources do not tell."


def responses(questions: DataFrame, chunks: DataFrame, kb: DataFrame, k: int = 5, rewriter: Generate = offline_rewrite, embedder: Embed | None = None, client: Generate = offline_generate) -> DataFrame:
    """One row per question: query_id, question, rewritten, search, answer, sources, statutes and trace.

    questions: query_id, question; chunks: vec_id, text, page_number, section, statutes (array of
    references, null as none); kb: statutes with keys. sources: the hits by rank with page, section,
    similarity, statutes, matching keywords and a preview. statutes: each one that a hit cites, with its
    entry and pages. trace: what each of the four steps was given and gave. A question without a
    hit (no chunk has a text) has no sources, and null as answer. An empty table of chunks raises a ValueError.
    """
    if chunks.where("text is not null").isEmpty():
        raise ValueError("no index: there are no chunks to search")
    asked = rewritten(questions, rewriter)
    # the hits are used several times: they are searched once
    hits = durable(retrieve(asked, chunks, k, embedder))
    cited = hits.select("query_id", F.col("rank").cast("bigint").alias("ord"), "page_number", "statutes")
    entry = F.struct("key", "ref", "law", "title", "punishment", "simple_explanation", "pages")
    analysis = statute_analysis(cited, kb, "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("statutes"))
    table = reference_lines(cited, kb, "query_id").withColumnRenamed("context", "statute_table")
    source = F.struct(
        "rank", "vec_id", F.col("page_number").alias("page"), "section", "similarity_pct", F.coalesce("statutes", F.array().cast("array<string>")).alias("statutes"),
        F.col("keyword_overlap.matching_keywords").alias("matching"), F.concat(F.substring("text", 1, 200), F.lit("...")).alias("preview"),
    )
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    j = asked.join(g, "query_id", "left").join(context(hits), "query_id", "left").join(analysis, "query_id", "left").join(table, "query_id", "left")
    prompt = F.concat(F.col("context"), F.coalesce(F.concat(F.lit("\n\n"), F.col("statute_table")), F.lit("")), F.lit(RULES), F.lit("\n\nQuestion: "), F.col("question"))
    j = j.withColumn("prompt", prompt).withColumn("answer", generated(F.col("prompt"), client))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    step = lambda n, action, given, gave: F.struct(F.lit(n).alias("step"), F.lit(action).alias("action"), given.alias("input"), gave.alias("output"))
    trace = F.array(
        step(1, "rewrite", F.col("question"), F.col("rewritten")),
        step(2, "search", F.col("search"), F.concat(count("sources"), F.lit(" chunks"))),
        step(3, "statutes", F.concat(count("sources"), F.lit(" chunks")), F.concat(count("statutes"), F.lit(" statutes"))),
        step(4, "answer", F.concat(count("sources"), F.lit(" chunks, "), count("statutes"), F.lit(" statutes")), F.when(F.col("answer").isNull(), "none").otherwise("answered")),
    )
    return j.select("query_id", "question", "rewritten", "search", "answer", "sources", "statutes", trace.alias("trace"), "prompt")


def section_texts(chunks: DataFrame, group: str) -> DataFrame:
    """(group, section, text): the chunks of each section joined by blanks, in order."""
    g = chunks.where("section is not null").groupBy(group, "section").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("x"))
    return g.select(group, "section", F.array_join(F.transform("x", lambda v: v["text"]), " ").alias("text"))


SECTIONS = ["FACTS", "ISSUES", "ARGUMENTS", "REASONING", "JUDGMENT"]
EMPTY = "No content found for this section."


def document_summaries(chunks: DataFrame, group: str, client: Generate = offline_generate, most_words: int = 2500) -> DataFrame:
    """(group, section, summary) for each of five sections; one without text says so."""
    texts = section_texts(chunks, group)
    all_ = chunks.select(group).distinct().select(group, F.explode(F.array(*[F.lit(s) for s in SECTIONS])).alias("section"))
    j = all_.join(texts, [group, "section"], "left")
    return j.select(group, "section", F.coalesce(generated(limit_words(F.col("text"), most_words), client), F.lit(EMPTY)).alias("summary"))


def recent(asked: DataFrame, k: int = 5) -> DataFrame:
    """The last k questions of each user, newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return asked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
