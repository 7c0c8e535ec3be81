"""Segmentation: paragraphs, fragments, long paragraphs, alignment, sentences and chunks.

Sequential steps go over one text's array inside the row, in time linear in its length: nothing
is shuffled. Chunks, which go across the rows of a document, are packed on narrow rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import strip
from lexweave.operators.scans import numbered
from lexweave.operators.statutes import sized
from lexweave.session import durable, shuffle_partitions

# Where paragraphs begin, and where a long one may be cut.
PARAGRAPH_BREAK = r"\n\s*\n|\n(?=\d+\.\s)|\n(?=\[\d+\]\s)|\n(?=\([ivx]+\)\s)|\n(?=[A-Z][a-z]+:\s)|\n(?=[•\-]+\s)"
LEGAL_BREAK = r"(?<=\.)\s+(?=\d+\.)|(?<=\.)\s+(?=[A-Z])|(?<=\.)\s+(?=\([a-z]\)\s)|(?<=;)\s+(?=\d+\.)"
SENTENCE_BREAK = r"(?<=[.!?])\s+"


def split_paragraphs(text: Column) -> Column:
    """The stripped parts between paragraph breaks, blank ones dropped; null for null."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n{3,}", "\n\n")
    parts = F.split(t, "(?U)" + PARAGRAPH_BREAK)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


# White space as the engine's regular expressions have it.
_SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _kernel(one, kind: str):
    """A pandas UDF of a function of a row's values; null where the first is."""
    single = one.__code__.co_argcount == 1

    def run(batches):
        for columns in batches:
            rows = ((v,) for v in columns) if single else zip(*columns)
            yield pd.Series([None if row[0] is None else one(*row) for row in rows], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series] if single else Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def merge_fragments(parts: Column, least: int = 50) -> Column:
    """Parts under `least` characters joined by a blank to the part before; a short first one stays and may grow."""

    def one(values):
        groups: list[list[str]] = []
        for p in values:
            if groups and len(p) < least:
                groups[-1].append(p)
            else:
                groups.append([p])
        return [" ".join(g) for g in groups]

    return _kernel(one, "array<string>")(parts)


def _packed(parts, limit: int) -> list[str]:
    done, now, size = [], [], 0
    for p in parts:
        if size and size + len(p) + 1 <= limit:
            now.append(p)
            size += len(p) + 1
        else:
            if size:
                done.append(" ".join(now).strip(_SPACE))
            now, size = [p], len(p)
    return done + ([" ".join(now).strip(_SPACE)] if size else [])


def _splitter(limit: int):
    legal, sentence = (re.compile(p.replace(r"\s", f"[{_SPACE}]")) for p in (LEGAL_BREAK, SENTENCE_BREAK))

    def split(text: str) -> list[str]:
        if len(text) <= limit:
            return [text]
        parts = legal.split(text)
        packed = _packed(parts, limit)
        if len(parts) > 1 and not all(len(c) > limit for c in packed):
            return packed
        return [c[k : k + limit] for c in _packed(sentence.split(text), limit) for k in range(0, max(1, len(c)), limit)]

    return split


def pack(parts: Column, limit: int) -> Column:
    """Parts joined by blanks as long as they stay within the limit; a part over it stands alone."""
    return _kernel(lambda values: _packed(values, limit), "array<string>")(parts)


def split_long(text: Column, limit: int = 1500) -> Column:
    """A text over the limit in packed parts: at legal breaks unless all parts stay over the limit, else at
    sentences, and what is over it still at every `limit` characters."""
    split = _splitter(limit)
    return _kernel(lambda t: split(t), "array<string>")(text)


def segment(text: Column, limit: int = 1500, least: int = 50, most: int = 800) -> Column:
    """A text's paragraphs: split, fragments merged, long ones cut, the first `most` of them."""
    split = _splitter(limit)
    return _kernel(lambda values: [c for p in values for c in split(p)][:most], "array<string>")(merge_fragments(split_paragraphs(text), least))


def align(text: Column, parts: Column) -> Column:
    """array<struct<start, end, mode>>: where each part stands in the text, searching on from the one before.

    mode is exact, spaced (found with white space unified; the offsets are then approximate)
    or failed (null offsets; the search goes on as many characters further). A null text
    gives null. White space is unified once, and the places of its words kept.
    """
    word = re.compile(f"[^{re.escape(_SPACE)}]+")

    def one(text, values):
        if values is None:
            return None
        unified = starts = None
        at, out = 0, []
        for p in values:
            found, mode = text.find(p, at), "exact"
            if found < 0:
                if unified is None:
                    words = list(word.finditer(text))
                    unified, starts = " ".join(m.group() for m in words), [m.start() for m in words]
                    ends = [m.end() for m in words]
                    places = np.cumsum([0, *(len(m.group()) + 1 for m in words)])
                # where what is left of the text begins in the unified one: within a word, or at the next
                k = bisect_left(ends, at + 1)
                base = int(places[k]) + max(0, at - starts[k]) if k < len(starts) else len(unified)
                spaced = unified.find(" ".join(word.findall(p)), base)
                found, mode = (at + spaced - base, "spaced") if spaced >= 0 and base <= len(unified) else (None, "failed")
            end = None if found is None else found + len(p)
            out.append({"start": found, "end": end, "mode": mode})
            at = at + len(p) if end is None else end
        return out

    return _kernel(one, "array<struct<start:int,end:int,mode:string>>")(text, parts)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "(?U)" + SENTENCE_BREAK), strip), lambda s: s != "")


def chunk_blocks(blocks: DataFrame, group: str, order: list[str], most_words: int = 400) -> DataFrame:
    """(group, chunk_id, text, page_number, word_count): whole sentences packed across a group's blocks up to most_words.

    blocks: group, order columns (unique in a group), page_number, text. The page is the least one
    in the chunk. Sentences are packed by their numbers of words alone, 30 bytes a sentence; texts meet again in
    their chunks, so that a document of any length is spread over tasks. Null and blank texts have no
    sentence; rows with a null group or order belong to no document and are left out.
    """
    from lexweave.functions.text import word_count

    s = blocks.select(group, *order, "page_number", F.posexplode(sentences(F.col("text"))).alias("__at", "__text")).withColumn("__n", word_count(F.col("__text")))
    s = durable(s)
    keys = [group, *order, "__at"]
    kinds = {f.name: f.dataType.simpleString() for f in s.schema.fields}

    def cut(batches):
        now, used, no = object(), 0, 0
        for batch in batches:
            chunk = []
            for g, n in zip(batch.column(group).to_pylist(), batch.column("__n").to_pylist()):
                if g != now:
                    now, used, no = g, n, 1
                elif used + n > most_words and used > 0:
                    used, no = n, no + 1
                else:
                    used += n
                chunk.append(no)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(chunk, pa.int32())], names=[*keys, "chunk_id"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", chunk_id int"
    narrow = s.select(*keys, "__n").repartition(shuffle_partitions(s.sparkSession), group).sortWithinPartitions(*keys)
    chunks = narrow.mapInArrow(cut, schema)
    j = s.join(chunks, keys)
    g = j.groupBy(group, "chunk_id").agg(F.array_sort(F.collect_list(F.struct(*order, "__at", "__text"))).alias("x"), F.min("page_number").cast("int").alias("page_number"), F.sum("__n").cast("int").alias("word_count"))
    return g.select(group, "chunk_id", F.array_join(F.transform("x", lambda v: v["__text"]), " ").alias("text"), "page_number", "word_count")


def positions(df: DataFrame, group: str, order: str) -> DataFrame:
    """df, which should be narrow, with `position`: start for the first fifth of a group, end after its fourth, else middle."""
    d = numbered(df, [group], [order], "__i")
    n = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    j = d.join(sized(n), d[group].eqNullSafe(F.col("__g")))
    return j.withColumn("position", F.when(F.col("__i") * 5 < F.col("__n"), "start").when(F.col("__i") * 5 > F.col("__n") * 4, "end").otherwise("middle")).select(*df.columns, "position")
