"""The statute knowledge base as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.statutes import punishment, reference_key, simple_words, statute_key
from lexweave.functions.text import strip

#: Entries that may be broadcast; beyond, joins are shuffled.
BROADCAST_ENTRIES = 200_000


def sized(small: DataFrame, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """small, marked for broadcast if it was counted to have at most `most` rows."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def union_codes(*codes: DataFrame) -> DataFrame:
    """Code tables of law, section, title, text under each other, stripped; rows without section or text are dropped."""
    out = None
    for c in codes:
        c = c.select(*[strip(F.col(x)).alias(x) for x in ("law", "section", "title", "text")])
        out = c if out is None else out.unionByName(c)
    return out.where("section <> '' and text <> ''")


def first_entries(statutes: DataFrame, order: str) -> DataFrame:
    """statutes with `key`; of entries of one key the first by `order` stays."""
    keyed = statutes.withColumn("key", statute_key(F.col("law"), F.col("section")))
    w = Window.partitionBy("key").orderBy(order)
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_wins(pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key: the value that comes last by `order`."""
    return pairs.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value))


def lookup(refs: DataFrame, ref: Column, kb: DataFrame) -> DataFrame:
    """refs with `key` and the entry meant (law, section, title, text: null if there is none)."""
    keyed = refs.withColumn("key", reference_key(ref))
    entry = kb.select("key", "law", "section", "title", "text")
    return keyed.join(sized(entry), "key", "left")


def across_codes(refs: DataFrame, ref: Column, mapping: DataFrame, kb: DataFrame, source: str, target: str) -> DataFrame:
    """refs with `key`, `other_key` and `other_title`: the entry of the other code that the mapping names."""
    keyed = refs.withColumn("key", reference_key(ref))
    m = mapping.select(F.col(source).alias("key"), F.col(target).alias("other_key"))
    e = kb.select(F.col("key").alias("other_key"), F.col("title").alias("other_title"))
    return keyed.join(sized(m), "key", "left").join(sized(e), "other_key", "left")


def statute_analysis(chunks: DataFrame, kb: DataFrame, group: str) -> DataFrame:
    """Per group and key: the first spelling, the entry (law UNKNOWN if there is none) and the distinct pages in order.

    chunks: group, ord, page_number, statutes (array). Null references are left out.
    """
    r = chunks.select(group, "ord", "page_number", F.posexplode("statutes").alias("at", "ref")).where("ref is not null")
    r = r.withColumn("key", reference_key(F.col("ref"))).withColumn("first", F.struct("ord", "at"))
    pages = r.where("page_number is not null").groupBy(group, "key", "page_number").agg(F.min("first").alias("first"))
    pages = pages.groupBy(group, "key").agg(F.array_sort(F.collect_list(F.struct("first", "page_number"))).alias("p")).select(group, "key", F.transform("p", lambda x: x["page_number"]).alias("pages"))
    firsts = r.groupBy(group, "key").agg(F.min_by("ref", F.struct("first", "ref")).alias("ref"))
    e = kb.select("key", "law", "title", punishment(F.col("text")).alias("punishment"), simple_words(F.col("text")).alias("simple_explanation"))
    j = firsts.join(pages, [group, "key"], "left").join(sized(e), "key", "left")
    return j.select(group, "key", "ref", F.coalesce("law", F.lit("UNKNOWN")).alias("law"), F.coalesce("title", F.lit("")).alias("title"), "punishment", "simple_explanation", F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))


def reference_lines(chunks: DataFrame, kb: DataFrame, group: str) -> DataFrame:
    """(group, context): a line for each known statute of a group, in the order of first mention."""
    r = chunks.select(group, "ord", F.posexplode("statutes").alias("at", "ref")).where("ref is not null")
    r = r.withColumn("key", reference_key(F.col("ref"))).groupBy(group, "key").agg(F.min(F.struct("ord", "at")).alias("first"))
    p, s = punishment(F.col("text")), simple_words(F.col("text"))
    line = F.concat(F.lit("- "), F.col("law"), F.lit(" "), F.col("section"), F.when(strip(F.coalesce("title", F.lit(""))) != "", F.concat(F.lit(": "), strip(F.col("title")))).otherwise(""))
    line = F.concat(line, F.when(p.isNotNull(), F.concat(F.lit(" — Punishment: "), p)).when(s.isNotNull(), F.concat(F.lit(" — "), F.substring(s, 1, 200))).otherwise(""))
    j = r.join(sized(kb), "key").select(group, "first", line.alias("line"))
    g = j.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("first", "line"))).alias("x"))
    return g.select(group, F.concat(F.lit("STATUTE REFERENCE TABLE:\n"), F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("context"))
