"""Problem 2: text of scanned pages made into continuous paragraphs.

Lines are labelled by hidden Markov models with the states furniture (running headers, footers,
notices, page numbers), body, and break (a line of the body before which a paragraph ends). The
first tells furniture from the rest, by layout features of a line and classes of its words; the
second goes over the lines of the body and tells breaks, by blank lines, how the line before ends
and how wide it is, and how the line begins. Both are trained by Viterbi re-estimation on a bounded
sample of pages, from seeds that layout alone makes sure of. Whether a page goes on with the
paragraph of the page before is asked of the second, without what a page's edge hides. How
often a line recurs at the edges of its PDF's pages is counted over all pages.

Words are judged by counts over all pages: a word is misread if undoing usual confusions of
characters gives a word that is far more frequent, or, for names too rare to be counted, one
whose letters follow each other as words' letters do and the misread one's do not. A word
divided at a line's end is one if its parts are not usually written with a hyphen.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.shingles import mix
from lexweave.session import durable

#: Pages that the line model is trained on (by hash of the key, the same for any order).
SAMPLE_PAGES = 1_500
EDGE = 4
BODY, FURNITURE, BREAK = 0, 1, 2
BLOOM_BITS = 23
#: What has more characters is no word.
LONGEST = 64

# What characters are misread for, (what stands there, what was meant).
CONFUSIONS = [
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("c", "e"), ("f", "t"), ("b", "h"), ("v", "y"), ("l", "i"), ("i", "l"), ("h", "b"),
    ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("0", "o"), ("5", "s"), ("@", "a"), ("(", "c"), ("#", "l"), ("$", "s"), ("8", "b"), ("6", "b"), ("3", "e"), ("4", "a"), ("9", "g"), ("€", "e"), ("£", "e"), ("ß", "b"), ("¢", "c"), ("u", "n"), ("m", "rn"), ("d", "cl"), ("n", "ri"),
]
LETTERS = {a for a, _ in CONFUSIONS if a.isalpha()}
SIGNS = "".join(sorted({a for a, _ in CONFUSIONS if not a.isalpha()}))

_NOISE = re.compile(rf"(?:(?<=[A-Za-z])[{re.escape(SIGNS)}]+(?=[A-Za-z])|^[|@015$](?=[a-z]{{2}})|(?<=[a-z]{{2}})[|@015$]$|(?<=[a-z])[!](?=[a-z]))")
_EDGE_MARKS = "\"'“”‘’.,;:?!()[]{}"
_DIVIDED = re.compile(r"([^\W\d_][\w'@|!(#$-]*?)([-­¬‐])$")
_MARKS = "-­¬‐"
_PAGE_NUMBER = re.compile(r"[\W_]*(?:page|pg?\.?|p a g e)?[\W_]*(?:[0-9lIoOS|!]{1,4}|[ivxl]{1,6})(?:[\W_]*(?:of|/|\|)?[\W_]*(?:[0-9lIoOS|!]{1,4}|p ?a ?g ?e))?[\W_]*", re.I)


def divided(line: str):
    """The match of a word divided at the end of a line without white space at its end, or None."""
    return _DIVIDED.search(line) if line and line[-1] in _MARKS else None


def core(token: str) -> str:
    """A token without the marks around it; closing brackets and signs inside stay."""
    t = token.strip(_EDGE_MARKS)
    return t[1:] if t[:1] in "₹" else t


def signed(token: str) -> str | None:
    """A token with the sign at its edge that may be a misread letter: an opening bracket or an exclamation mark."""
    t = token.rstrip(_EDGE_MARKS.replace("!", "")).lstrip(_EDGE_MARKS.replace("!", "").replace("(", ""))
    if len(t) > 3 and (t[0] in "(!" or t[-1] == "!") and ")" not in t and t.strip("(!").isalpha():
        return t
    return None


def is_word(t: str) -> bool:
    """Letters for the most part, perhaps with misread signs or hyphens; no numbers, references or abbreviations."""
    letters = sum(c.isalpha() for c in t)
    if letters < 2 or len(t) > LONGEST or letters * 2 < len(t) or any(c in "./,&" for c in t):
        return False
    return not re.fullmatch(r"[A-Z]{1,3}-?\d+[A-Z]?|\d+[A-Za-z]{1,2}|\d+x\d+", t)


def noisy(t: str) -> bool:
    """Signs or digits stand among the word's letters."""
    return bool(_NOISE.search(t)) and sum(c.isalpha() for c in t) >= 2


def variants(word: str, most: int = 2) -> list[tuple[str, int]]:
    """The words that one or two undone confusions make of a word, with where the first is.

    Two confusions are undone of the same kind only, as one scanner makes them.
    """
    out: dict[str, int] = {}
    for a, b in CONFUSIONS:
        at = [m.start() for m in re.finditer(f"(?={re.escape(a)})", word)]
        for k, i in enumerate(at):
            v = word[:i] + b + word[i + len(a) :]
            out.setdefault(v, i)
            for j in at[k + 1 :] if most > 1 else []:
                if j >= i + len(a):
                    out.setdefault(word[:i] + b + word[i + len(a) : j] + b + word[j + len(a) :], i)
        if len(at) > 2:
            out.setdefault(word.replace(a, b), at[0])
    if noisy(word):  # a sign may have two meanings, and other confusions may come with it
        for v, i in list(out.items()):
            if noisy(v):
                for a, b in CONFUSIONS:
                    j = v.find(a) if not a.isalpha() else -1
                    if j >= 0:
                        out.setdefault(v[:j] + b + v[j + len(a) :], min(i, j))
    out.pop(word, None)
    return list(out.items())


def template(line: str) -> str:
    """A line with its numbers and spacing unified, as it recurs on other pages."""
    t = re.sub(r"\b(?:[ivxl]+|[0-9lIO|]*[0-9][0-9lIO|]*)\b", "#", line.strip().lower())
    return re.sub(r"[\W_]+", " ", re.sub(r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b", "#", t)).strip()


def _hash(values) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) for v in values], np.uint64).view(np.int64)


def lines_of(text: str) -> list[str]:
    return (text or "").split("\n")


def edge_lines(lines: list[str]) -> list[int]:
    """Indexes of the first and last EDGE lines that are not blank."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({*full[:EDGE], *full[-EDGE:]})


# ---------------------------------------------------------------- the line model


def _word_feature(token: str) -> str:
    w = core(token)
    return "w=#" if re.fullmatch(r"[IVXLivxl]*", w) else "w=" + re.sub(r"\d+", "#", w.lower())


class WordFeatures(dict):
    """The features of tokens, remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        x = self[token] = _word_feature(token)
        return x


def observe(lines: list[str], repeated: set[int], seen: WordFeatures) -> list[list[str] | None]:
    """The features of each line, None for a blank one. repeated: hashes of templates that recur in the PDF; seen: remembers words' features."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    width = float(np.median([len(lines[i].strip()) for i in full])) if full else 1.0
    widest = max((len(lines[i].rstrip()) for i in full), default=1)
    out: list[list[str] | None] = [None] * len(lines)
    edge = set(edge_lines(lines))
    keys = dict(zip(edge, _hash([template(lines[i]) for i in edge]))) if edge else {}
    for k, i in enumerate(full):
        x = lines[i].strip()
        top, bottom = k, len(full) - 1 - k
        place = f"top{top}" if top <= bottom and top < EDGE else f"bottom{bottom}" if bottom < EDGE else "middle"
        before = lines[full[k - 1]].rstrip() if k else ""
        words = x.split()
        f = [
            f"place={place}",
            f"repeated={int(i in keys and int(keys[i]) in repeated)}",
            f"number={int(len(x) < 48 and x[-1] != '.' and bool(_PAGE_NUMBER.fullmatch(x)))}",
            f"width={0 if len(x) < 0.4 * width else 1 if len(x) < 0.8 * width else 2}",
            f"indent={int(len(lines[i]) - len(lines[i].lstrip()) >= 4)}",
            f"gap={int('   ' in x)}",
            f"end={'stop' if x[-1] in '.?!' else 'pause' if x[-1] in ',;:-¬' + chr(173) else 'open'}",
            f"start={'lower' if x[0].islower() and x[1:2].islower() and not (len(x) < 9 and re.fullmatch(r"[ivxl]+", x)) else 'caps' if x.isupper() and len(x) > 3 else 'other'}",
            f"run={'on' if k and before[-1:] not in '.?!:' and len(before) > 0.8 * widest else 'new'}",
        ]
        f += dict.fromkeys(map(seen.__getitem__, words))
        out[i] = f
    return out


_ZEROS = (0.0,) * 9


class LineModel:
    """Emission weights (log of a feature's share among furniture over that among body) and transitions."""

    def __init__(self, pages: list[tuple[list[str], set[int]]], rounds: int = 4):
        words = WordFeatures()
        seen = [observe(lines, rep, words) for lines, rep in pages]
        labels = [[None if f is None else self.seed(f) for f in page] for page in seen]
        self.rare: set[str] = set()
        count = Counter(x for page in seen for f in page if f for x in f)
        self.known = {x for x, n in count.items() if n >= 3}
        for _ in range(rounds):
            self.fit(seen, labels)
            labels = [self.viterbi(page) for page in seen]

    @staticmethod
    def seed(f: list[str]) -> int | None:
        """What layout alone makes sure of: body in the middle, furniture that is a number or recurs at an edge."""
        if f[0] == "place=middle" or f[7] == "start=lower":
            return BODY
        if f[2] == "number=1" or (f[1] == "repeated=1" and f[6] != "end=stop" and f[3] != "width=2"):
            return FURNITURE
        return BODY if f[6] == "end=stop" and f[3] == "width=2" else None

    def fit(self, seen, labels):
        n, total = {BODY: Counter(), FURNITURE: Counter()}, Counter()
        step = np.ones((2, 2))
        for page, lab in zip(seen, labels):
            last = None
            for f, y in zip(page, lab):
                if f is None or y not in (BODY, FURNITURE):
                    continue
                total[y] += 1
                n[y].update({x if x in self.known else "w=?" for x in f})
                if last is not None:
                    step[last, y] += 1
                last = y
        self.weight = {x: float(np.clip(np.log((n[FURNITURE][x] + 0.5) / (total[FURNITURE] + 1) / ((n[BODY][x] + 0.5) / (total[BODY] + 1))), -4, 4)) for x in {*n[BODY], *n[FURNITURE]}}
        self.step = np.log(step / step.sum(axis=1, keepdims=True)).tolist()
        self.prior = float(np.clip(np.log((total[FURNITURE] + 1) / (total[BODY] + 1)), -4, 4))

    def score(self, f: list[str]) -> float:
        get, other = self.weight.get, self.weight.get("w=?", 0.0)
        layout = sum(map(get, f[:9], _ZEROS))
        words = [get(x, other) for x in f[9:]]
        # words depend on each other: a few of them tell as much as all
        return self.prior + layout + (sum(words) / len(words) * min(3, len(words)) if words else 0.0)

    def viterbi(self, page) -> list[int]:
        at = [i for i, f in enumerate(page) if f is not None]
        out = [BREAK] * len(page)
        if not at:
            return out
        s = [self.score(page[i]) for i in at]
        (bb, bf), (fb, ff) = self.step
        b, h, back = 0.0, s[0], []
        for x in s[1:]:
            nb, nh = max((b + bb, 0), (h + fb, 1)), max((b + bf, 0), (h + ff, 1))
            back.append((nb[1], nh[1]))
            b, h = nb[0], nh[0] + x
        y = int(h > b)
        for k in range(len(at) - 1, -1, -1):
            out[at[k]] = FURNITURE if y else BODY
            if k:
                y = back[k - 1][y]
        return out


def shape_of(line: str, full: int) -> tuple[str, str, str]:
    """How a line of the body begins, how it ends, and whether it is as wide as the page's lines are (full characters)."""
    x = line.strip()
    if re.match(r"\(?(?:\d{1,3}|[ivxl]{1,5}|[a-z])[.)]+\s", x):
        start = "number"
    else:
        start = "lower" if x[:1].islower() else "capitals" if x.isupper() and len(x) > 3 else "other"
    bare = x.rstrip("\"'”’)]")
    end = "divided" if divided(x) else "stop" if bare[-1:] in (*".?!:",) else "pause" if bare[-1:] in (*",;",) else "open"
    return start, end, "short" if len(line.rstrip()) < 0.85 * full else "full"


class BreakModel:
    """Which lines of the body begin a paragraph: weights of the features and of two states' transitions."""

    def __init__(self, pages: list[tuple[list[str], list[int]]], rounds: int = 4):
        """pages: the lines and their labels by the line model."""
        seen = [self.observe(lines, labels)[1] for lines, labels in pages]
        labels = [[self.seed(f) for f in page] for page in seen]
        for _ in range(rounds):
            self.fit(seen, labels)
            labels = [self.viterbi(page) for page in seen]

    @staticmethod
    def observe(lines: list[str], labels: list[int]):
        """The indexes of the lines of the body, and the features of all but the first."""
        at = [i for i, y in enumerate(labels) if y == BODY]
        full = max((len(lines[i].rstrip()) for i in at), default=0)
        shapes = [shape_of(lines[i], full) for i in at]
        out = []
        for k in range(1, len(at)):
            blank = any(not lines[i].strip() for i in range(at[k - 1] + 1, at[k]))
            indent = len(lines[at[k]]) - len(lines[at[k]].lstrip()) >= 2
            out.append((f"gap={'blank' if blank else 'none'}", f"indent={int(indent)}", *BreakModel.junction(shapes[k - 1], shapes[k])))
        return at, out

    @staticmethod
    def junction(before, after) -> tuple[str, str]:
        """What the ends of two lines of the body tell, also across pages."""
        return f"before={before[1]}/{before[2]}", f"start={after[0]}"

    @staticmethod
    def seed(f) -> int | None:
        """What layout makes sure of: a blank line after a full stop, or a sentence that runs on."""
        stop = f[2].startswith("before=stop")
        if f[0] == "gap=blank" and stop:
            return BREAK
        return BODY if f[0] == "gap=none" and (not stop or (f[2].endswith("full") and f[3] in ("start=lower", "start=other"))) else None

    def fit(self, seen, labels):
        n, total, step = {BODY: Counter(), BREAK: Counter()}, Counter(), np.ones((2, 2))
        for page, lab in zip(seen, labels):
            last = None
            for f, y in zip(page, lab):
                if y is not None:
                    total[y] += 1
                    n[y].update(f)
                    if last is not None:
                        step[int(last == BREAK), int(y == BREAK)] += 1
                last = y
        names = {*n[BODY], *n[BREAK]}
        self.weight = {x: float(np.clip(np.log((n[BREAK][x] + 0.5) / (total[BREAK] + 1) / ((n[BODY][x] + 0.5) / (total[BODY] + 1))), -6, 6)) for x in names}
        self.step = np.log(step / step.sum(axis=1, keepdims=True)).tolist()
        self.prior = float(np.log((total[BREAK] + 1) / (total[BODY] + 1)))

    def score(self, f) -> float:
        return sum(self.weight.get(x, 0.0) for x in f)

    def viterbi(self, page) -> list[int]:
        if not page:
            return []
        (bb, bn), (nb, nn) = self.step
        s = [self.score(f) for f in page]
        b, h, back = 0.0, self.prior + s[0], []
        for x in s[1:]:
            to_b, to_n = max((b + bb, 0), (h + nb, 1)), max((b + bn, 0), (h + nn, 1))
            back.append((to_b[1], to_n[1]))
            b, h = to_b[0], to_n[0] + x
        y, out = int(h > b), []
        for k in range(len(page) - 1, -1, -1):
            out.append(BREAK if y else BODY)
            if k:
                y = back[k - 1][y]
        return out[::-1]

    def begins(self, before, after) -> bool:
        """Whether the first line of a page begins a paragraph, given its shape and that of the last line before it."""
        return self.prior + self.score(self.junction(before, after)) > 0


# ---------------------------------------------------------------- words


def page_tokens(lines: list[str]):
    """The tokens of a page, line by line, without the parts of words divided at line ends."""
    skip = False
    for x in lines:
        tokens = x.split()
        if not tokens:
            continue
        cut = bool(divided(x.rstrip()))
        yield tokens[1 if skip else 0 : -1 if cut else None]
        skip = cut


def forms(token: str) -> list[str]:
    """The words that a token may stand for, in lower case: the word in it, and that with a sign at its edge."""
    t, s = core(token), signed(token)
    return ([t.lower()] if t and is_word(t) else []) + ([s.lower()] if s else [])


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, n): the words of all pages and how often they stand there; each task adds up its own first."""

    def count(batches):
        def words(tokens: Counter) -> pd.DataFrame:
            c: Counter = Counter()
            for t, n in tokens.items():
                for w in forms(t):
                    c[w] += n
            return pd.DataFrame({"word": list(c), "n": list(c.values())})

        c: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                for tokens in page_tokens(lines_of(text)):
                    c.update(tokens)
            if len(c) > 500_000:
                yield words(c)
                c = Counter()
        if c:
            yield words(c)

    return pages.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: A word is misread if what was meant is so many times as frequent.
RATIO = 12
#: Words as frequent as this share of the most frequent one (at least 8 times) teach how letters follow.
OFTEN = 1e-4
_PAD = "^"


def letter_runs(words: DataFrame):
    """Broadcast dict: in how many of the frequent words three letters follow each other; at most some 10**5 keys."""
    spark = words.sparkSession
    top = words.agg(F.max("n")).first()[0] or 0
    often = words.where((F.col("n") >= max(8, OFTEN * top)) & F.col("word").rlike(r"^\p{L}+$"))
    runs = often.select(F.explode(F.expr("transform(sequence(1, length(word)), i -> substring(concat('^', word, '^'), i, 3))")).alias("run"))
    return spark.sparkContext.broadcast({r["run"]: r["n"] for r in runs.groupBy("run").agg(F.count("*").alias("n")).collect()})


def misread_words(words: DataFrame) -> DataFrame:
    """(word, meant): the words that are misread, and what they should be."""
    runs = letter_runs(words)

    def rate(v: str, table: dict) -> int:
        p = _PAD + v + _PAD
        return min((table.get(p[i : i + 3], 0) for i in range(len(p) - 2)), default=0)

    def propose(batches):
        table = runs.value
        for pdf in batches:
            rows = []
            for w, n in zip(pdf["word"], pdf["n"]):
                own = rate(w, table)
                for v, _ in variants(w):
                    r = rate(v, table)
                    rows.append((w, n, v, own, r))
            if rows:
                yield pd.DataFrame(rows, columns=["word", "n", "meant", "own", "new"])

    # a word that stands among the most frequent cannot be outnumbered and needs no proposals
    top = words.agg(F.max("n")).first()[0] or 0
    rare = words.where(F.col("n") * RATIO <= top)
    proposed = rare.mapInPandas(propose, "word string, n long, meant string, own int, new int")
    known = words.select(F.col("word").alias("meant"), F.col("n").alias("as_meant"))
    j = proposed.join(known, "meant", "left").withColumn("as_meant", F.coalesce("as_meant", F.lit(0)))
    # an edge sign may be no letter at all: the word without it must be as rare as a misread one
    bare = F.regexp_replace("word", "^[(!]|!$", "")
    edged = j.where(bare != F.col("word")).withColumn("bare", bare).join(words.select(F.col("word").alias("bare"), F.col("n").alias("n_bare")), "bare", "left").where(F.coalesce("n_bare", F.lit(0)) * RATIO <= F.col("as_meant")).drop("bare", "n_bare")
    j = j.where(bare == F.col("word")).unionByName(edged)
    counted = (F.col("as_meant") >= F.greatest(F.lit(4), F.col("n") * RATIO)) | ((F.col("n") <= 2) & (F.col("as_meant") >= 6 * F.col("n")) & (F.col("own") * 4 < F.col("new")))
    spelt = (F.col("n") <= 3) & (F.col("own") <= 1) & (F.col("new") >= 5) & (bare == F.col("word"))
    return j.where(counted | spelt).groupBy("word").agg(F.max_by("meant", F.struct("as_meant", "new", "meant")).alias("meant"))


def bloom(words: DataFrame):
    """Broadcast bit array of the words, of a fixed size; the words themselves are joined afterwards."""
    size = 1 << BLOOM_BITS

    def bits(batches):
        from pyspark import TaskContext

        table = np.zeros(size, bool)
        for pdf in batches:
            if len(pdf):
                table[_places(pdf["word"])] = True
        yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "bits": [zlib.compress(np.packbits(table).tobytes(), 1)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(size // 8, np.uint8)
        for b in pdf["bits"]:
            table |= np.frombuffer(zlib.decompress(b), np.uint8)
        return pd.DataFrame({"task": [pdf["task"].iloc[0] // 64], "bits": [zlib.compress(table.tobytes(), 1)]})

    kind = "task int, bits binary"
    parts = words.select("word").mapInPandas(bits, kind).groupBy(F.expr("task div 64")).applyInPandas(add, kind)
    table = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():
        table |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return words.sparkSession.sparkContext.broadcast(np.unpackbits(table).astype(bool))


def _places(words) -> np.ndarray:
    return (mix(_hash(words).view(np.uint64)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


# ---------------------------------------------------------------- pages


class Scans:
    """The repaired pages: `found` (defects by line) and `paragraphs`.

    pages: pdf_id, page_number, text; other columns are ignored. Rows with a null key are left
    out; a page sent again counts once; a null or empty text has no defects and no paragraph.
    """

    def __init__(self, pages: DataFrame):
        p = pages.select(F.col("pdf_id").cast("bigint"), F.col("page_number").cast("int"), "text").where("pdf_id is not null and page_number is not null and text is not null")
        self.pages = p
        self.words = durable(vocabulary(p))
        self.misread = durable(misread_words(self.words))
        repeated = durable(self._repeated(p))
        self.input = p.dropDuplicates(["pdf_id", "page_number"]).join(repeated, ["pdf_id", "page_number"], "left")
        # the sample's keys first: pages are then picked, not sorted
        keys = p.select("pdf_id", "page_number").distinct().orderBy(F.xxhash64("pdf_id", "page_number"), "pdf_id", "page_number").limit(SAMPLE_PAGES)
        some = p.join(F.broadcast(keys), ["pdf_id", "page_number"], "left_semi").dropDuplicates(["pdf_id", "page_number"])
        again = repeated.join(F.broadcast(keys), ["pdf_id", "page_number"], "left_semi")
        sample = some.join(again, ["pdf_id", "page_number"], "left").orderBy("pdf_id", "page_number").select("text", "repeated").collect()
        spark = p.sparkSession
        pages = [(lines_of(r["text"]), set(r["repeated"] or [])) for r in sample]
        lines = LineModel(pages)
        breaks = BreakModel([(x, lines.viterbi(observe(x, rep, WordFeatures()))) for x, rep in pages])
        self.model, self.breaks = spark.sparkContext.broadcast(lines), spark.sparkContext.broadcast(breaks)
        self.bloom = bloom(self.misread)

    @staticmethod
    def _repeated(p: DataFrame) -> DataFrame:
        """(pdf_id, page_number, repeated): the page's edge templates that stand on two or more pages of the PDF."""

        def edges(batches):
            for pdf in batches:
                a, b, c = [], [], []
                for i, n, text in zip(pdf["pdf_id"], pdf["page_number"], pdf["text"]):
                    lines = lines_of(text)
                    t = {template(lines[k]) for k in edge_lines(lines)}
                    t = [x for x in t if len(x) > 2]
                    a += [i] * len(t)
                    b += [n] * len(t)
                    c += t
                if c:
                    yield pd.DataFrame({"pdf_id": a, "page_number": np.array(b, np.int32), "t": _hash(c)})

        e = p.mapInPandas(edges, "pdf_id long, page_number int, t long").distinct()
        often = e.groupBy("pdf_id", "t").agg(F.count("*").alias("n")).where("n > 1").select("pdf_id", "t")
        return e.join(often, ["pdf_id", "t"]).groupBy("pdf_id", "page_number").agg(F.collect_list("t").alias("repeated"))

    def labelled(self) -> DataFrame:
        """Rows of six kinds, by line: labels (word: those of the page's lines, a digit each; line 0); furniture; divided (word: the first part, other: the rest or null);
        maybe (word that may be misread); noisy (word with signs in it); first (word that opens the page's text)."""
        model, table = self.model, self.bloom

        def label(batches):
            m, maybe = model.value, table.value
            known: dict[str, list[tuple[str, str]]] = {}
            clean: set[str] = set()  # tokens that are under no suspicion
            seen = WordFeatures()

            def judge(token: str) -> list[tuple[str, str]]:
                """What a token is under suspicion of, remembered."""
                v = known.get(token)
                if v is None:
                    if len(known) > 500_000:
                        known.clear()
                    t = core(token)
                    if t and is_word(t) and noisy(t):
                        v = [("noisy", t)]
                    else:
                        w = forms(token)
                        v = [("maybe", x) for x, hit in zip(w, maybe[_places(w)]) if hit] if w else []
                    known[token] = v
                    if not v:
                        if len(clean) > 500_000:
                            clean.clear()
                        clean.add(token)
                return v

            for pdf in batches:
                rows = []
                for i, n, text, rep in zip(pdf["pdf_id"], pdf["page_number"], pdf["text"], pdf["repeated"]):
                    for r in _page_rows(lines_of(text), set() if rep is None else set(map(int, rep)), m, judge, clean, seen):
                        rows.append((i, n, *r))
                if rows:
                    yield pd.DataFrame(rows, columns=["pdf_id", "page_number", "line_no", "kind", "word", "other"])

        return self.input.mapInPandas(label, "pdf_id long, page_number int, line_no int, kind string, word string, other string")

    @functools.cached_property
    def rows(self) -> DataFrame:
        return durable(self.labelled())

    def _divided(self) -> DataFrame:
        """The lines whose last word is divided: the forms it may have, and `own`, whether the mark is part of its spelling."""
        key = ["pdf_id", "page_number", "line_no"]
        first = self.rows.where("kind = 'first'").select("pdf_id", (F.col("page_number") - 1).alias("page_number"), F.col("word").alias("next"))
        cut = self.rows.where("kind = 'divided'").join(first, ["pdf_id", "page_number"], "left").withColumn("other", F.coalesce("other", "next"))
        mark = F.substring("word", -1, 1)
        stem = F.expr("substring(word, 1, length(word) - 1)")
        cut = cut.select(*key, mark.alias("mark"), F.lower(F.concat(stem, F.coalesce("other", F.lit("")))).alias("joined"), F.lower(F.concat(stem, F.lit("-"), F.coalesce("other", F.lit("")))).alias("hyphened"), "other")
        n1 = self.words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
        n2 = self.words.select(F.col("word").alias("hyphened"), F.col("n").alias("n_hyphened"))
        cut = cut.join(n1, "joined", "left").join(n2, "hyphened", "left")
        own = (F.col("mark") == "-") & (F.coalesce("n_hyphened", F.lit(0)) > F.coalesce("n_joined", F.lit(0)))
        return cut.select(*key, "joined", "hyphened", own.alias("own"))

    def found(self) -> DataFrame:
        """(pdf_id, page_number, line_no, kind) of the lines with a defect."""
        rows = self.rows
        key = ["pdf_id", "page_number", "line_no"]
        furniture = rows.where("kind = 'furniture'").select(*key, F.lit("furniture").alias("kind"))
        noise = rows.where("kind = 'noisy'").select(*key, F.lit("misread").alias("kind"))
        broken = self._divided().where("not own").select(*key, F.lit("broken_word").alias("kind"))
        maybe = rows.where("kind = 'maybe'").select(*key, "word")
        wrong = maybe.join(self.misread.select("word"), "word", "left_semi").select(*key, F.lit("misread").alias("kind"))
        return furniture.union(noise).union(broken).union(wrong).distinct()

    def repairs(self) -> DataFrame:
        """(pdf_id, page_number, labels, repairs): for each page its lines' labels, its misread words with what was meant, and its words with a hyphen of their own (meant is null)."""
        key = ["pdf_id", "page_number"]
        labels = self.rows.where("kind = 'labels'").select(*key, F.col("word").alias("labels"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("meant"))
        wrong = self.rows.where("kind in ('maybe', 'noisy')").select(*key, F.lower("word").alias("word")).join(self.misread, "word").select(*key, F.lit(None).cast("string").alias("labels"), "word", "meant")
        own = self._divided().where("own").select(*key, F.lit(None).cast("string").alias("labels"), F.col("hyphened").alias("word"), F.lit(None).cast("string").alias("meant"))
        word = F.when(F.col("word").isNotNull(), F.struct("word", "meant"))
        return labels.union(wrong).union(own).groupBy(*key).agg(F.max("labels").alias("labels"), F.collect_set(word).alias("repairs"))

    def paragraphs(self) -> DataFrame:
        """(pdf_id, para_no, page_number, text): continuous paragraphs, with the page where they begin.

        Furniture is dropped, divided words are joined, misread words replaced by what was meant.
        """
        breaks = self.breaks

        def assemble(batches):
            for pdf in batches:
                rows = []
                for i, n, text, labels, fix in zip(pdf["pdf_id"], pdf["page_number"], pdf["text"], pdf["labels"], pdf["repairs"]):
                    fix = [] if fix is None else list(fix)
                    meant = {r["word"]: r["meant"] for r in fix if r["meant"] is not None}
                    usual = {r["word"] for r in fix if r["meant"] is None}
                    for k, part in enumerate(_page_paragraphs(lines_of(text), list(map(int, labels)), breaks.value, meant, usual), 1):
                        rows.append((i, n, k, *part))
                if rows:
                    yield pd.DataFrame(rows, columns=["pdf_id", "page_number", "part", "text", "glue", "head", "tail"])

        # input and repairs are both dealt by page: the texts are shuffled once
        pages = self.input.drop("repeated").join(self.repairs(), ["pdf_id", "page_number"])
        parts = durable(pages.mapInPandas(assemble, "pdf_id long, page_number int, part int, text string, glue string, head array<string>, tail array<string>"))
        order = Window.partitionBy("pdf_id").orderBy("page_number", "part")

        def decide(batches):
            for pdf in batches:
                # a later part of a page begins a paragraph, and so does a PDF's first
                new = [k > 1 or b is None or breaks.value.begins(tuple(b), tuple(h)) for k, h, b in zip(pdf["part"], pdf["head"], pdf["before"])]
                yield pd.DataFrame({"pdf_id": pdf["pdf_id"], "page_number": pdf["page_number"], "part": pdf["part"], "new": np.array(new, np.int32)})

        # which paragraph a page's part belongs to is worked out on narrow rows, without the texts
        ends = parts.select("pdf_id", "page_number", "part", "head", F.lag("tail").over(order).alias("before"))
        new = ends.mapInPandas(decide, "pdf_id long, page_number int, part int, new int")
        narrow = new.select("pdf_id", "page_number", "part", F.sum("new").over(order).cast("int").alias("para_no"))
        j = parts.select("pdf_id", "page_number", "part", "text", "glue").join(narrow, ["pdf_id", "page_number", "part"])
        whole = j.groupBy("pdf_id", "para_no").agg(F.min("page_number").alias("page_number"), F.array_sort(F.collect_list(F.struct("page_number", "part", "text", "glue"))).alias("x"))
        last = F.element_at("x", -1)["text"]
        before = F.array_join(F.transform(F.slice("x", 1, F.size("x") - 1), lambda v: F.concat(v["text"], v["glue"])), "")
        return whole.select("pdf_id", "page_number", "para_no", F.concat(before, last).alias("text"))


def _page_rows(lines, repeated, model, judge, clean, seen):
    labels = model.viterbi(observe(lines, repeated, seen))
    yield 0, "labels", "".join(map(str, labels)), None
    body = [i for i, y in enumerate(labels) if y == BODY]
    for i, y in enumerate(labels):
        if y == FURNITURE:
            yield i + 1, "furniture", None, None
    rest = False
    for k, i in enumerate(body):
        x = lines[i].rstrip()
        tokens = x.split()
        if k == 0 and tokens:
            yield i + 1, "first", core(tokens[0]), None
        m = divided(x)
        after = lines[body[k + 1]].split() if k + 1 < len(body) else None
        if m and after and not re.match(r"[\"'“(]?[^\W\d_]", after[0]):
            m = None  # what follows is no word
        if m:
            stem = core(tokens[-1])
            other = core(after[0]) if after else None
            yield i + 1, "divided", stem if stem[-1:] == m.group(2) else stem + m.group(2), other
            if other:
                whole = (stem[:-1] if stem[-1:] == m.group(2) else stem) + other
                in_first, in_rest = noisy(stem[:-1]), noisy(other)
                if in_first or in_rest:
                    yield (i if in_first else body[k + 1]) + 1, "noisy", whole, None
                elif is_word(whole):
                    best = next((at for v, at in variants(whole.lower())), 0) if judge(whole) else 0
                    for kind, w in judge(whole):
                        yield (i if best < len(stem) - 1 else body[k + 1]) + 1, kind, w, None
        for t in {*tokens[1 if rest else 0 : -1 if m else None]} - clean:
            for kind, w in judge(t):
                yield i + 1, kind, w, None
        rest = bool(m)


def _repair(token: str, meant: dict) -> str:
    t = core(token)
    v = meant.get(t.lower())
    if not t or v is None:
        return token
    v = v.upper() if t.isupper() else v[:1].upper() + v[1:] if t[:1].isupper() else v
    return token.replace(t, v, 1)


def _page_paragraphs(lines, labels, breaks, meant, usual):
    """(text, what joins it to a part that goes on with it, shape of its first line, shape of its last) of the page's paragraphs.

    A hyphen or another mark of division at the page's end is left out of the text; it is in
    the joint if it is part of the word's own spelling.
    """
    at, features = breaks.observe(lines, labels)
    full = max((len(lines[i].rstrip()) for i in at), default=0)
    out, now = [], []
    for i, y in zip(at, [BODY, *breaks.viterbi(features)]):
        x = lines[i].strip()
        if y == BREAK and now:
            out.append(now)
            now = []
        shape = shape_of(lines[i], full)
        m = divided(now[-1][0]) if now else None
        if m:
            stem, (head, _, tail) = now[-1][0][: m.start(2)], x.partition(" ")
            own = m.group(2) == "-" and (core(stem.split()[-1]) + "-" + core(head)).lower() in usual
            now[-1] = (stem + ("-" if own else "") + head, now[-1][1])
            x = tail
        if x:
            now.append((x, shape))
        elif now:
            now[-1] = (now[-1][0], shape)
    if now:
        out.append(now)
    for para in out:
        text, glue = " ".join(x for x, _ in para), " "
        m = divided(text)
        if m:
            stem = core(text[: m.start(2)].split()[-1]).lower() + "-"
            glue = "-" if m.group(2) == "-" and any(u.startswith(stem) for u in usual) else ""
            text = text[: m.start(2)]
        yield " ".join(_repair(t, meant) for t in text.split()), glue, list(para[0][1]), list(para[-1][1])
