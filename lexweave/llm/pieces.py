"""Problem 4: items over a size limit cut into pieces at natural boundaries.

The hierarchy of separators is section (blank line), line, sentence, clause, word, character:
a unit that fits beside the repeated part is kept whole, one that does not is split at the next
level. Units are packed up to the limit, a piece ends at the highest level that leaves it half
full, and each piece repeats the end of the one before.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 200
# levels of the hierarchy, the highest first; clauses, words and characters count as one
SECTION, LINE, SENTENCE, WORD = range(4)

# Abbreviations, in lower case, whose point ends no sentence.
ABBREVIATIONS = set(
    """rs dr mr mrs ms smt shri sri km kum prof adv hon hon'ble justice m/s sec secs s ss u/s r rr ex exh ext no nos p pp
    para paras pg art arts cl cls ch vol v vs viz i.e e.g cf ibid op cit etc annex ann annx sch schd govt dept dist
    crl cri civ cr app appl pet misc w.p o.s c.s c.a s.l.p w.a r.p m.p c.p c.r.p l.p.a o.a t.a i.a r.f.a s.a c.c n.o.c
    j jj c.j cj ld addl asst jt dy gen col capt maj lt sgt st jan feb mar apr jun jul aug sep sept oct nov dec ed edn
    reg regd approx fig tel ref re wrt""".split()
)
# Abbreviations that do end a sentence if a word that starts sentences follows.
MAY_END = {"etc", "no", "nos", "ltd", "co", "anr", "ors", "pvt"}
STARTERS = set("The A An In It If On We Such Nor Once Hence That This These Those There When Whether What Who Therefore However Moreover He She They His Her But And So As At By For From Counsel Learned Per".split())

_END = re.compile(r"[.?!]+[\"'”’)\]]*(?=\s|$)")
_OPEN = "([\"'“‘"


def sentence_starts(text: str) -> list[int]:
    """Offsets at which sentences start, ascending; the first is 0, even before leading white space.

    Each line that is not blank starts one. Within a line a sentence ends with its mark and
    the quotation mark or bracket closing it; points of abbreviations, initials and of the
    number that opens a line end none. An empty text has none.
    """
    if not text:
        return []
    starts, at = [0], 0
    for line in text.split("\n"):
        body = len(line) - len(line.lstrip())
        if line.strip():
            if at + body > 0 and (at > 0 or body == 0):
                starts.append(at + body)
            for m in _END.finditer(line):
                nxt = m.end()
                while nxt < len(line) and line[nxt].isspace():
                    nxt += 1
                if nxt < len(line) and _ends(line, m, nxt, body):
                    starts.append(at + nxt)
        at += len(line) + 1
    # a text that begins with blank lines has its first sentence at 0 only
    lead = len(text) - len(text.lstrip())
    return sorted({0, *(s for s in starts if s > lead)})


def _ends(line: str, m: re.Match, nxt: int, body: int) -> bool:
    mark, follow = m.group(), line[nxt]
    if not mark.startswith("."):
        return not (len(mark) > 1 and follow.islower() and mark[-1] in "\"'”’")
    end = m.start()
    back = 60
    tail = line[max(body, end - back) : end]
    while end - back > body and not any(map(str.isspace, tail)):
        back *= 2  # the word may be longer
        tail = line[max(body, end - back) : end]
    word = (tail.rsplit(None, 1) or [""])[-1].lstrip(_OPEN)
    if len(mark) == 1 and len(word) > 4 and word.isalpha():
        return word.lower() not in ABBREVIATIONS  # most sentences end in a word
    head = tail.strip() if end - body < 12 else "too long for a number"
    if re.fullmatch(r"\(?(?:\d{1,4}|[ivxlc]{1,6}|[A-Za-z])\)?", head) or re.fullmatch(r"\(\w{1,5}\)", head):
        return False  # a paragraph number belongs to what follows
    if len(mark) > 1 and mark[1] in ")]\"'”’":
        # closed by a bracket or quotation mark: the point was the sentence's own
        return not (follow.islower() and mark[-1] in "\"'”’")
    bare = word.strip("().,;:").lower()
    if re.fullmatch(r"[A-Za-z]", word.strip("(")):
        # an initial; the pronoun ends a sentence only before a word that starts one
        first = re.match(r"[A-Za-z]+", line[nxt:]) if word == "I" else None
        return bool(first and len(first.group()) > 1 and first.group() in STARTERS)
    if bare in ABBREVIATIONS or re.fullmatch(r"(?:[a-z]{1,3}\.)+[a-z]{1,3}", bare):
        first = re.match(r"[A-Za-z]+", line[nxt:])
        several = "." in bare and bare not in ("i.e", "e.g", "o.s", "w.p", "c.s", "c.a")
        return bool((several or (bare in MAY_END and word != "No")) and first and first.group() in STARTERS)
    return True


def _cut(text: str, a: int, b: int, limit: int) -> list[int]:
    """Starts of the parts of text[a:b], each at most limit long, cut at clauses, else words, else characters."""
    starts = [a]
    while b - starts[-1] > limit:
        s = starts[-1]
        window = text[s : s + limit]
        at = max(window.rfind("; "), window.rfind(": "))
        at = at + 2 if at >= limit // 2 else 0
        if not at:
            at = max(window.rfind(" "), window.rfind("\t")) + 1
        if not window[:at].strip():
            at = 0  # white space is no part of its own
        starts.append(s + (at if at > 0 else limit))
    return starts


def boundaries(text: str) -> list[tuple[int, int]]:
    """The starts of sentences, each with the highest level that starts there."""
    out = []
    for s in sentence_starts(text):
        a = s
        while a > 0 and text[a - 1].isspace():
            a -= 1
        lines = text.count("\n", a, s) if a else 2
        out.append((s, SECTION if lines > 1 else LINE if lines else SENTENCE))
    return out


def split_units(marks: list[tuple[int, int]], text: str, room: int, lowest: int = WORD) -> list[tuple[int, int]]:
    """(start, level) of the largest units that have at most room characters; marks are the text's boundaries.

    A unit over the room is split at the next level, down to `lowest`; the parts that are left
    over the room there stay as they are.
    """
    ends = [*(s for s, _ in marks[1:]), len(text)]
    out = []

    def split(a, b, level):
        start, end = marks[a][0], ends[b - 1]
        if level > lowest or len(text[start:end].rstrip()) <= room:
            out.append(marks[a])
        elif level == WORD:
            out.append(marks[a])
            out.extend((s, WORD) for s in _cut(text, start, end, room)[1:])
        else:
            at = [a, *(k for k in range(a + 1, b) if marks[k][1] <= level), b]
            for x, y in zip(at, at[1:]):
                split(x, y, level + 1)

    if marks:
        split(0, len(marks), SECTION)
    return out


def _end(units: list[tuple[int, int]], k: int, j: int, half: int) -> int:
    """Which of the units k+1 to j the piece ends before, all of which fit; half is the middle of its room."""
    natural = [e for e in range(k + 1, j + 1) if units[e][1] < WORD]
    late = [e for e in natural if units[e][0] > half]
    if late:
        return min(late, key=lambda e: (units[e][1], -e))
    return natural[-1] if natural else j


def cut_item(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(start, end, repeated) of the pieces, and the starts of the sentences they are made of; text[start:end] has at most limit characters.

    A piece starts and ends where sentences do unless one alone is over the limit. A section or
    line of at most limit - overlap characters is in one piece as a whole. A piece repeats
    the last whole sentences of the piece before, as many as `overlap` holds; if the last one
    is longer, its last whole words; if no word fits, its last characters.
    """
    assert 0 <= overlap < limit
    marks = boundaries(text)
    sentences = [s for s, _ in marks]
    if len(text) <= limit:
        return [(0, len(text), 0)], sentences
    units = [*split_units(marks, text, limit - overlap), (len(text), SECTION)]
    out, k, start, repeated = [], 0, 0, 0
    while k < len(units) - 1:
        j = k + 1
        while j < len(units) - 1 and len(text[start : units[j + 1][0]].rstrip()) <= limit:
            j += 1
        if j < len(units) - 1:
            j = _end(units, k, j, start + limit // 2)
        end = start + len(text[start : units[j][0]].rstrip())
        out.append((start, end, repeated))
        if j >= len(units) - 1:
            break
        k, nxt = j, units[j][0]
        # the next piece's start: the earliest sentence within the overlap, else the earliest word, else a character
        low = max(nxt - overlap, start + 1)
        inside = [u for u in sentences if low <= u < nxt]
        if inside:
            begin = inside[0]
        else:
            m = re.compile(r"(?<=\s)\S").search(text, low, end)
            begin = m.start() if m else low if low < end else nxt  # after white space only there is nothing to repeat
        start, repeated = begin, max(0, end - begin)
    return out, sentences


def split_item(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """The pieces of cut_item alone."""
    return cut_item(text, limit, overlap)[0]


def _map(df: DataFrame, keys: list[str], text_col: str, limit: int, f, schema: str) -> DataFrame:
    big = df.where(F.length(text_col) > limit).select(*keys, F.col(text_col).alias("__text"))

    def run(batches):
        for pdf in batches:
            rows, of = [], []
            for r, text in enumerate(pdf["__text"]):
                new = f(text)
                rows += new
                of += [r] * len(new)
            names = schema_names
            out = pdf[keys].iloc[np.array(of, dtype=np.int64)].reset_index(drop=True)
            for c, n in enumerate(names):
                out[n] = [x[c] for x in rows]
            yield out

    schema_names = [x.split()[0] for x in schema.split(", ")]
    kinds = ", ".join(f"`{k}` {big.schema[k].dataType.simpleString()}" for k in keys)
    return big.mapInPandas(run, f"{kinds}, {schema}").distinct()


def long_sentences(df: DataFrame, keys: list[str], text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, sent_start): a row for each sentence of the pieces of each text over the limit, whatever a stored length says.

    Null and shorter texts give no row; rows sent again with the same keys and text count once.
    """
    cut = lambda t: [(s,) for s in cut_item(t, limit, overlap)[1]]
    return _map(df, keys, text_col, limit, cut, "sent_start int")


def split_long(df: DataFrame, keys: list[str], text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, piece_no, start, end, repeated, piece) of each text over the limit; pieces count from 1."""
    cut = lambda t: [(i, a, b, r, t[a:b]) for i, (a, b, r) in enumerate(split_item(t, limit, overlap), 1)]
    return _map(df, keys, text_col, limit, cut, "piece_no int, start int, end int, repeated int, piece string")


def piece_checks(pieces: DataFrame, df: DataFrame, keys: list[str], text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys and whether a text's pieces are within the limit, repeat no more than the overlap, equal the text at their places and leave out nothing but white space."""
    texts = df.where(F.length(text_col) > limit).select(*keys, F.col(text_col).alias("__text")).distinct()
    w = Window.partitionBy(*keys).orderBy("piece_no")
    j = pieces.join(texts, keys).withColumn("__before", F.coalesce(F.lag("end").over(w), F.lit(0))).withColumn("__last", F.lead("start").over(w).isNull())
    gap = F.expr("substring(__text, __before + 1, greatest(0, start - __before))")
    rest = F.when(F.col("__last"), F.expr("substring(__text, `end` + 1)")).otherwise("")
    return j.groupBy(*keys).agg(
        F.bool_and(F.length("piece") <= limit).alias("within_limit"),
        F.bool_and((F.col("repeated") == F.greatest(F.lit(0), F.col("__before") - F.col("start"))) & (F.col("repeated") <= overlap)).alias("overlaps"),
        F.bool_and(F.col("piece") == F.expr("substring(__text, start + 1, `end` - start)")).alias("in_place"),
        F.bool_and(~gap.rlike(r"\S") & ~rest.rlike(r"\S")).alias("whole"),
    )
