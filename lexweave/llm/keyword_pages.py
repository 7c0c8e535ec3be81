"""Problem 8: pages of keywords, links and product tags instead of sentences.

What sentences look like is learnt from the corpus, for each language. Pages are grouped by
their language label and script; groups that use the same words are one language. A language's
function words are those that most of its pages use and that its sentences use more often
than its other lines do.

A page is measured in chunks of some twenty words that do not cross lines: the share of function
words, separators a word, the share of words that stand in a word pair that the page repeats, the
share of the page's most frequent other word, whether its line is repeated, and link text.
Histograms over all chunks of a language give the bounds beyond which its sentences hardly
go. A chunk is keyword text if it is link text or a repeated line, if it lacks function
words, or if two of separators, word pairs and top word are over their bounds; a line of which a
third or more are numbers is a table or a list of references and judged by links and repetition only. A
page is found if most of it is keyword text. A page in a language that the corpus does not
know is not judged by function words.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import durable

BINS = 50
CHUNK = 20
LEAST_WORDS = 12
#: Share of a page that counts as most of it, and the room for the measure's error: where keyword text ends is known to half
#: a chunk, which is much of a short page (at most MOST_ROOM) and little of a long one.
MOST, ROOM, MOST_ROOM = 0.5, 0.5 * CHUNK, 0.25
#: Pages that a group of label and script needs to tell about a language.
LEAST_PAGES = 20
#: Share of a language's pages that use one of its function words, and of those that use a word it is known by.
USUAL, KNOWN = 0.15, 0.005
#: Share of known words in a page of a known language; groups whose words agree so far (cosine) are one language.
OWN_WORDS, SAME = 0.3, 0.6
#: Share of a text's words that no language's most frequent word goes beyond in sentences; holds where function words are not known.
TOP = 0.15
#: Bounds are not put higher than this, however sentences are copied within their pages.
HIGHEST = {"separators": 0.5, "pairs": 0.5, "top_word": 0.3}
#: A line is repeated if the page has it so often, a word pair likewise.
REPEATED = 3
MEASURES = ["function_words", "separators", "pairs", "top_word"]

_TOKEN = re.compile(r"[\ẁ-ͯऀ-ॣ०-෿]+")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+|(?<!\w)#\w+", re.I)
_ALONE = re.compile(r"(?<=\s)[-*>](?=\s)")
_NUMBER = re.compile(r"\d[\d.,]*")
_SENTENCE = tuple(".?!।…\"”’)")


def words_of(line: str) -> list[str]:
    return [w for w in _TOKEN.findall(line.lower()) if not w.isdigit()]


def separators_in(line: str) -> int:
    """The marks | / • · » ; , : and each - * > that stands alone."""
    n = sum(map(line.count, "|/;,:" if line.isascii() else "|/;,:•·»"))
    return n + len(_ALONE.findall(line)) if "-" in line or "*" in line or ">" in line else n


def script_of(text: str) -> str:
    """The block of 128 code points, Latin ones together, that most of a page's letters belong to."""
    if text.isascii():
        return "0"
    at = np.frombuffer(text[:].encode("utf-32-le", "surrogatepass"), np.uint32)
    at = at[at > 64]
    block = np.where(at < 0x250, 0, at >> 7)
    return str(int(np.bincount(block.astype(np.int64)).argmax())) if len(block) else "0"


def group_of(label, script: str) -> str:
    return f"{(label or '').strip().lower()[:20]}/{script}"


class Languages:
    """Languages by name: words known (word: language bits) and function words; made of few counts."""

    def __init__(self, counts: dict[str, dict[str, tuple[int, int, int]]], pages: dict[str, int]):
        """counts: group: word: (pages, times in sentences, times in other lines)."""
        groups = [g for g in sorted(pages, key=lambda g: (-pages[g], g)) if pages[g] >= LEAST_PAGES]
        self.members: list[list[str]] = []
        vectors: list[dict[str, float]] = []
        for g in groups:
            mine = {w: c[0] / pages[g] for w, c in counts.get(g, {}).items()}
            for k, other in enumerate(vectors):
                dot = sum(x * other.get(w, 0.0) for w, x in mine.items())
                size = (sum(x * x for x in mine.values()) * sum(x * x for x in other.values())) ** 0.5
                if size and dot / size >= SAME:
                    self.members[k].append(g)
                    break
            else:
                self.members.append([g])
                vectors.append(mine)
        self.names = [m[0] for m in self.members]
        self.known: list[frozenset] = []
        self.function: list[frozenset] = []
        for m in self.members:
            n = sum(pages[g] for g in m)
            total: dict[str, list[int]] = {}
            for g in m:
                for w, c in counts.get(g, {}).items():
                    t = total.setdefault(w, [0, 0, 0])
                    for k in range(3):
                        t[k] += c[k]
            self.known.append(frozenset(w for w, c in total.items() if c[0] >= max(2, KNOWN * n)))
            sentences = max(1, sum(c[1] for c in total.values()))
            others = max(1, sum(c[2] for c in total.values()))
            self.function.append(frozenset(w for w, c in total.items() if c[0] >= USUAL * n and c[2] / others <= c[1] / sentences))

    def of(self, words: list[str]) -> int:
        """The language with the largest share of known words, -1 if none has enough."""
        if not words or not self.known:
            return -1
        shares = [sum(map(k.__contains__, words)) for k in self.known]
        best = int(np.argmax(shares))
        return best if shares[best] >= OWN_WORDS * len(words) else -1


def word_counts(texts: DataFrame) -> DataFrame:
    """(grp, word, pages, sentences, others): in how many pages of a group a word stands, and how often in sentences and other lines.

    The word '' counts the pages. All pages count; each task adds up its own first.
    """

    def run(batches):
        def rows():
            return pd.DataFrame([(g, w, n, sent[w], other[w]) for g, (pages, sent, other) in c.items() for w, n in pages.items()], columns=["grp", "word", "pages", "sentences", "others"])

        c: dict[str, tuple[Counter, Counter, Counter]] = {}
        for pdf in batches:
            for label, text in zip(pdf["lang"], pdf["text"]):
                sent, other = [], []
                for line in text.split("\n"):
                    if line and not line.isspace():
                        line = line.strip()
                        w = words_of(_LINK.sub(" ", line) if "http" in line or "www." in line or "#" in line or "@" in line else line)
                        (sent if len(w) >= 8 and line.endswith(_SENTENCE) else other).extend(w)
                g = group_of(label, script_of(text))
                if g not in c:
                    c[g] = Counter(), Counter(), Counter()
                pages, in_sent, in_other = c[g]
                pages.update({"", *sent, *other})
                in_sent.update(sent)
                in_other.update(other)
            if sum(len(pages) for pages, _, _ in c.values()) > 500_000:
                yield rows()
                c = {}
        yield rows()

    parts = texts.mapInPandas(run, "grp string, word string, pages long, sentences long, others long")
    return parts.groupBy("grp", "word").agg(F.sum("pages").alias("pages"), F.sum("sentences").alias("sentences"), F.sum("others").alias("others"))


def languages(texts: DataFrame) -> Languages:
    """A group keeps words of at least half the share KNOWN of its pages: at most some 400 times the words of an average page."""
    c = durable(word_counts(texts))
    pages = {r["grp"]: r["pages"] for r in c.where((F.col("word") == "") & (F.col("pages") >= LEAST_PAGES)).collect()}  # a row per label and script
    n = c.where("word = ''").select("grp", F.col("pages").alias("n"))
    few = c.where("word <> ''").join(n, "grp").where(f"n >= {LEAST_PAGES} and pages >= greatest(2, {KNOWN / 2} * n)")
    counts: dict[str, dict] = {}
    for r in few.toLocalIterator():
        counts.setdefault(r["grp"], {})[r["word"]] = (r["pages"], r["sentences"], r["others"])
    return Languages(counts, pages)


CHUNK_KIND = np.dtype([("size", "<u2"), ("function_words", "u1"), ("separators", "u1"), ("pairs", "u1"), ("top_word", "u1"), ("link", "u1"), ("repeated", "u1"), ("figures", "u1")])


def measure(text: str, known: Languages):
    """(language's index, words, link characters outside of chunks, top word's, top pair's and repeated lines' share, separators a word, chunks) of one page, or None if it has fewer than LEAST_WORDS words."""
    link_chars, n_words, marks = 0, 0, 0
    lines: list[tuple[str, list[str], bool, bool]] = []
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        line = line.strip()
        rest, links = line, ()
        if "http" in line or "#" in line or "@" in line or "www." in line.lower():
            links = _LINK.findall(line)
        size = sum(map(len, links))
        if links:
            rest = _LINK.sub(" ", line)
            link_chars += size
            n_words += len(links)
        # what stands beside links in a line of links is their text
        tokens = _TOKEN.findall(rest.lower())
        ws = [w for w in tokens if not w.isdigit()]
        figures = len(ws) * 3 <= len(tokens) * 2
        # lines that differ in a number only, as those of products do, are repeated too
        lines.append((rest if figures else _NUMBER.sub("#", rest), ws, size * 2 > len(line), figures))
        n_words += len(ws)
    if n_words < LEAST_WORDS:
        return None
    words = [w for _, ws, _, _ in lines for w in ws]
    language = known.of(words)
    function = known.function[language] if language >= 0 else frozenset()
    counts, pairs, copies = Counter(words), Counter(), Counter(rest for rest, *_ in lines)
    # a pair that comes twice is of two words that do
    twice = {w for w, c in counts.items() if c > 1}
    for _, ws, _, _ in lines:
        pairs.update([p for p in zip(ws, ws[1:]) if p[0] in twice and p[1] in twice])
    top_pair = max(pairs.values(), default=int(any(len(ws) > 1 for _, ws, _, _ in lines)))
    again = {p for p, c in pairs.items() if c >= REPEATED}
    top_n, top = max(((c, w) for w, c in counts.items() if w not in function), default=(0, ""))
    if top_n < REPEATED:
        top = ""
    rows = []
    for rest, ws, link_line, figures in lines:
        separators = separators_in(rest)
        marks += separators
        n = len(ws)
        if not n:
            continue
        parts = max(1, round(n / CHUNK))
        scale = (BINS - 1) / 0.98
        sep = min(BINS - 1, int(separators / n * scale))
        for k in range(parts):
            a, b = n * k // parts, n * (k + 1) // parts
            c = ws[a:b] if parts > 1 else ws
            m = b - a
            f = sum(map(function.__contains__, c)) if function else 0
            p = sum(map(again.__contains__, zip(c, c[1:]))) if again else 0
            rows.append((min(65535, len("".join(c)) + m), min(BINS - 1, int(f / m * BINS)), sep, min(BINS - 1, int(p / max(1, m - 1) * BINS)), min(BINS - 1, int(c.count(top) / m * BINS)) if top else 0, link_line, copies[rest] >= REPEATED, figures))
    n = max(1, len(words))
    return (
        language,
        n_words,
        link_chars,
        top_n / n,
        top_pair / n,
        sum(c for c in copies.values() if c > 1) / len(lines),
        marks / n,
        np.array(rows, CHUNK_KIND).tobytes(),
    )


SCHEMA = "id long, language int, words int, link_chars long, top_word double, top_pair double, repeated_lines double, separators double, chunks binary"


def page_measures(texts: DataFrame, known) -> DataFrame:
    """SCHEMA of the pages of at least LEAST_WORDS words; known: a broadcast Languages."""

    def run(batches):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                m = measure(text, known.value)
                if m:
                    rows.append((i, *m))
            yield pd.DataFrame(rows, columns=names)

    return texts.select("id", "text").mapInPandas(run, SCHEMA)


def _spread(weights) -> tuple[float, float]:
    """Median of a histogram over [0, 1] and its robust deviation (at least half a bin)."""
    w = np.asarray(weights, float)
    x = (np.arange(len(w)) + 0.5) / len(w)
    median = x[np.searchsorted(np.cumsum(w), w.sum() / 2)]
    off = np.abs(x - median)
    order = np.argsort(off, kind="stable")
    return float(median), 1.4826 * max(0.5 / len(w), float(off[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]))


def function_bounds(h: np.ndarray) -> dict[str, int]:
    """The bin of function words from which on sentences begin, and the usual one."""
    if not h.sum():
        return {"function_words": 0, "usual": 0}
    median, spread = _spread(h)
    # not below a third of what is usual, nor above half of it
    return {"function_words": round(min(0.5 * median, max(median / 3, median - 2.5 * spread)) * BINS), "usual": int(median * BINS)}


def upper_bound(h: np.ndarray, share: float = 0.95) -> int:
    """The last bin that this share of sentences does not go beyond."""
    return int(np.searchsorted(np.cumsum(h), share * h.sum())) if h.sum() else BINS


def _histograms(m: DataFrame, least: dict[int, int]) -> dict[int, np.ndarray]:
    """By language the histograms of MEASURES over chunks that are no link text and have at least so many function words; -1 sums all."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for language, raw in zip(pdf["language"], pdf["chunks"]):
                c = np.frombuffer(raw, CHUNK_KIND)
                c = c[(c["link"] == 0) & (c["function_words"] >= least.get(language, 0))]
                s = sums.setdefault(language, np.zeros((len(MEASURES), BINS), np.int64))
                for k, name in enumerate(MEASURES):
                    s[k] += np.bincount(c[name], c["size"], BINS).astype(np.int64)
        rows = [(language, k * BINS + b, int(n)) for language, s in sums.items() for k in range(len(MEASURES)) for b, n in enumerate(s[k]) if n]
        yield pd.DataFrame(rows, columns=["language", "bin", "n"])

    got = m.select("language", "chunks").mapInPandas(run, "language int, bin int, n long").groupBy("language", "bin").agg(F.sum("n").alias("n")).collect()  # bins of few languages
    tables: dict[int, np.ndarray] = {-1: np.zeros((len(MEASURES), BINS), np.int64)}
    for r in got:
        for language in {r["language"], -1}:
            tables.setdefault(language, np.zeros((len(MEASURES), BINS), np.int64))[r["bin"] // BINS, r["bin"] % BINS] += r["n"]
    return tables


def calibrate(m: DataFrame) -> dict[int, dict[str, int]]:
    """Bounds of each language: of function words by all its chunks, of the other measures by its sentences; -1 has those of all languages."""
    out = {language: function_bounds(t[0]) for language, t in _histograms(m, {}).items()}
    of_sentences = _histograms(m, {language: b["function_words"] for language, b in out.items() if language >= 0})
    none = np.zeros((len(MEASURES), BINS), np.int64)
    for language, b in out.items():
        t = of_sentences.get(language, none)
        b.update({name: min(int(HIGHEST[name] * BINS), upper_bound(t[k])) for k, name in enumerate(MEASURES) if k})
    return out


def keyword_chunks(c: np.ndarray, b: dict[str, int], known: bool) -> np.ndarray:
    """Which chunks are keyword text by the bounds b of their language."""
    bound = b if known else {**b, "top_word": max(b["top_word"], int(TOP * BINS))}
    over = sum((c[name] > bound[name]).astype(np.int64) for name in ("separators", "pairs", "top_word"))
    out = (c["link"] > 0) | (c["repeated"] > 0)
    if not known:
        return out | ((over >= 2) & (c["figures"] == 0))
    bare = (c["function_words"] < b["function_words"]) | ((over == 2) & (c["function_words"] < b["usual"])) | (over == 3)
    return out | (bare & (c["figures"] == 0))


def keyword_pages(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """(id, language, keyword_share, and the other shares) of the pages that are no sentences for the most part.

    lang_col may be null or wrong in some rows; without it the script alone groups the pages.
    language is that of the largest group of label and script that it comes from, '' if the corpus does
    not know it. Null, empty and very short texts (under LEAST_WORDS words) are never found. An
    id given twice with equal text gives equal rows, returned once.
    """
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col).cast("string")
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), lang.alias("lang")).where("id is not null and text is not null")
    known = languages(texts)
    names = known.names
    m = durable(page_measures(texts, df.sparkSession.sparkContext.broadcast(known)))
    cuts = calibrate(m)
    columns = ["top_word", "top_pair", "repeated_lines", "separators"]

    def judge(batches):
        for pdf in batches:
            share, links, bare = np.zeros(len(pdf)), np.zeros(len(pdf)), np.zeros(len(pdf))
            for r, (language, link_chars, raw) in enumerate(zip(pdf["language"], pdf["link_chars"], pdf["chunks"])):
                c = np.frombuffer(raw, CHUNK_KIND)
                b = cuts[language]
                size = c["size"].astype(np.int64)
                total = max(1, int(size.sum()) + link_chars)
                share[r] = (size[keyword_chunks(c, b, language >= 0)].sum() + link_chars) / total
                links[r] = (size[c["link"] > 0].sum() + link_chars) / total
                bare[r] = size[c["function_words"] < b["function_words"]].sum() / total if language >= 0 else 0.0
            out = pd.DataFrame({"id": pdf["id"], "language": [names[k] if k >= 0 else "" for k in pdf["language"]], "keyword_share": share, "link_share": links, "bare_share": bare})
            least = MOST + np.minimum(MOST_ROOM, ROOM / pdf["words"].to_numpy())
            yield pd.concat([out, pdf[columns]], axis=1)[share > least]

    kind = "id long, language string, keyword_share double, link_share double, bare_share double, " + ", ".join(f"{c} double" for c in columns)
    return m.mapInPandas(judge, kind).distinct()
