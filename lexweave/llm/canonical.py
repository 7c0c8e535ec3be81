"""Problem 3: values typed freely, mapped to the entries of a canonical list.

An Aho-Corasick automaton holds the entries' names in all their spellings and the aliases of
the laws. Of the matches found in a value the longest that do not overlap win. A value that
no entry's name settles goes to token-set similarity: its tokens stand for the list's nearest
words, and the share of tokens in both sets among those in either must reach SIMILARITY; or
it names a law, and with it a number in which misread digits are repaired.

A list is worked off in parts of PART entries. What a part tells is a list of matches, the
nearest word of each token and the most similar titles, all with their measure; they are
put together before anything is decided, so that the parts' size changes no answer.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import durable

#: Entries that one automaton holds; a longer list is worked off in parts of this size.
PART = 50_000
#: Values remembered per task.
REMEMBERED = 200_000
#: Least share of tokens in both sets among those in either for a title to be meant.
SIMILARITY = 0.85
#: Resolved values that are broadcast; above, they are joined by a shuffle.
BROADCAST_VALUES = 500_000

# Parameter of map_mentions. How each law is cited, in lower case without points.
ALIASES = {
    "IPC": ["ipc", "i p c", "indian penal code", "ind penal code", "penal code", "ipc 1860"],
    "BNS": ["bns", "b n s", "bharatiya nyaya sanhita", "nyaya sanhita", "bns 2023", "bharatiya nyaya sanhita 2023"],
    "CRPC": ["crpc", "cr p c", "cr pc", "c r p c", "cr p code", "code of criminal procedure", "criminal procedure code", "criminal proc code"],
    "CONSTITUTION": ["constitution of india", "indian constitution", "constitution", "const"],
}
# Words that mark a section or an article, and words without weight.
SECTION_WORDS = {"section", "sections", "sec", "secs", "s", "ss", "u s", "under", "of", "the", "r w", "read", "with", "and", "no"}
ARTICLE_WORDS = {"article", "articles", "art", "arts"}
LIGHT = set("a an and at by during for from in of on or the to under upon with within without after".split())


def plain(value: str) -> str:
    """Lower case, compatibility forms unfolded, digits of any script as 0-9, points and joints as blanks; brackets stay."""
    v = unicodedata.normalize("NFKC", value)
    v = "".join(str(unicodedata.digit(c)) if c.isdigit() and unicodedata.digit(c, None) is not None else c for c in v)
    v = re.sub(r"\bu\s*/\s*s\b", " ", v, flags=re.I)
    v = re.sub(r"[^\w()]+|_", " ", v)
    return re.sub(r"\s+", " ", v).strip()


def edits(a: str, b: str, most: int) -> int:
    """Edits between a and b, a swap of neighbours counting one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def allowed(word: str) -> int:
    return 0 if len(word) < 3 else 1 if len(word) < 5 else 2 if len(word) < 7 else 3


def _letters(words) -> np.ndarray:
    """How often each of 40 classes of letters stands in each word; an edit changes two of the counts at most."""
    out = np.zeros((len(words), 40), np.int16)
    for r, w in enumerate(words):
        for c in w:
            out[r, ord(c) % 40] += 1
    return out


class Vocabulary:
    """The nearest known word within the allowed edits, of equally near ones the first by name.

    Only words whose letters differ by no more than the edits explain are compared.
    """

    def __init__(self, words, cap: int = 3):
        self.cap = cap
        self.words = sorted(words)
        self.known = set(words)
        self.counts = _letters(self.words)
        self.allowed = np.array([min(cap, allowed(w)) for w in self.words], np.int64)
        self.seen: dict[str, tuple[int, str] | None] = {}

    def nearest(self, token: str) -> tuple[int, str] | None:
        """(edits, word), None if no word is near."""
        if token in self.known:
            return 0, token
        if token not in self.seen:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            most = np.minimum(self.allowed, min(self.cap, allowed(token + "??")))
            best = None
            if len(self.words):
                off = np.abs(self.counts - _letters([token])[0]).sum(axis=1)
                for k in np.flatnonzero(off <= 2 * self.allowed):
                    w = self.words[k]
                    d = edits(token, w, int(self.allowed[k]))
                    if d <= self.allowed[k] and abs(len(w) - len(token)) <= most[k] and (best is None or (d, w) < best):
                        best = (d, w)
            self.seen[token] = best
        return self.seen[token]


def section_number(text: str) -> str | None:
    """The number a reference names, as '92A': blanks and dashes dropped, misread digits repaired, sub-clauses cut.

    None if the text is no number. A letter standing directly after the number, or after a
    blank or dash, belongs to it; what follows in brackets or as an explanation does not.
    """
    t = re.split(r"\(|\b(?:expl|explanation|clause|cl|proviso|sub|subsection)\b", text, maxsplit=1, flags=re.I)[0]
    t = re.sub(r"\s+", "", t)
    m = re.fullmatch(r"([0-9oOiIlSs|]+)([A-HJ-KM-NP-RT-Za-hj-km-np-rt-z]?)", t)
    if not m or len(t) > 6:
        return None
    digits, letter = m.groups()
    digits = digits.translate(str.maketrans("oOiIlSs|", "00111551"))
    return digits.lstrip("0") + letter.upper() if digits.lstrip("0") else None


def entry_law(law: str | None) -> str:
    return re.sub(r"[^A-Z]", "", (law or "").upper())


def entry_number(section: str | None) -> str | None:
    s = plain(section or "")
    s = re.sub(r"^(?:ipc|bns|crpc|constitution|article|art|section|sec)\s*", "", s, flags=re.I)
    m = re.match(r"([0-9]+)\s*([A-Za-z]?)$", s.strip())
    return m[1] + m[2].upper() if m else None


def title_tokens(title: str | None) -> frozenset:
    return frozenset(t for t in plain(title or "").lower().split() if t not in LIGHT)


def _key(tokens) -> str:
    return " ".join(sorted(tokens))


class Part:
    """Some of the list's entries: their names in an automaton, their titles' words and token sets. entries: (law, section, title)."""

    def __init__(self, entries, aliases: dict):
        import ahocorasick

        patterns: dict[str, list] = {}
        self.by_word: dict[str, set[frozenset]] = defaultdict(set)
        for law, section, title in entries:
            law, number, tokens = entry_law(law), entry_number(section), title_tokens(title)
            if number:
                for name in aliases.get(law, [law.lower()]):
                    n = number.lower()
                    for form in (f"{name} {n}", f"{n} {name}", f"{n} of {name}", f"{n} of the {name}"):
                        patterns[form] = ["entry", law, number]
            if tokens:
                patterns.setdefault(plain(title).lower(), ["title", "", _key(tokens)])
                for t in tokens:
                    self.by_word[t].add(tokens)
        self.automaton = _automaton(patterns, ahocorasick)
        self.words = Vocabulary(self.by_word)

    def similar(self, tokens: frozenset) -> tuple[float, list[str]]:
        """The largest share of common tokens that a title reaches, and those titles."""
        best, keys = 0.0, []
        for other in set().union(*[self.by_word.get(t, set()) for t in tokens]) if tokens else ():
            share = len(tokens & other) / len(tokens | other)
            if share > best:
                best, keys = share, []
            if share == best:
                keys.append(_key(other))
        return best, sorted(keys)


def _automaton(patterns: dict, ahocorasick):
    a = ahocorasick.Automaton()
    for p, meaning in patterns.items():
        a.add_word(p, (len(p), meaning))
    a.make_automaton()
    return a


def on_words(automaton, text: str) -> list[list]:
    """All matches that begin and end with words: [start, end, kind, law, what]."""
    out = []
    for last, (n, meaning) in automaton.iter(text) if len(automaton) else ():
        a, b = last + 1 - n, last + 1
        if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()):
            out.append([a, b, *meaning])
    return out


def longest(found: list) -> list:
    """The longest matches that do not overlap, in order; of equally long ones the first, of equal places an entry before a law before a title."""
    taken = []
    for m in sorted(found, key=lambda m: (m[0] - m[1], m[0], m[2], m[3], m[4])):
        if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
            taken.append(m)
    return sorted(taken)


class Reader:
    """What a value says, told by the matches in it and the list's words nearest to its tokens."""

    def __init__(self, aliases: dict):
        import ahocorasick

        self.aliases = aliases
        self.laws = _automaton({name: ["law", law, ""] for law, names in aliases.items() for name in names}, ahocorasick)
        self.law_words = Vocabulary({t for names in aliases.values() for n in names for t in n.split() if len(t) > 3})
        # a name cut short is too short to be misspelt
        one = {n: law for law, names in aliases.items() for n in names if " " not in n}
        self.short_names = {n: law for n, law in one.items() if not any(m != n and m.startswith(n) for m in one)}
        self.markers = Vocabulary({w for w in SECTION_WORDS | ARTICLE_WORDS if len(w) > 3 and " " not in w}, 1)
        self.long_aliases = sorted(((frozenset(n.split()), law) for law, names in aliases.items() for n in names if " " in n and len(n) > 8), key=lambda x: (-len(x[0]), sorted(x[0])))

    def resolve(self, value: str, found: list, nearest) -> tuple[str, str | None, str, list[frozenset]]:
        """(kind, law, key, sets): kind number (key is the number), title (key is its tokens), sets (a title similar to one of them), or none.

        nearest: a function of a token, (edits, word) or None.
        """
        cased = plain(value)
        text = cased.lower()
        none = ("none", None, "", [])
        laws, titles, rest = [], [], list(cased if len(cased) == len(text) else text)
        for a, b, kind, named, what in longest(found + on_words(self.laws, text)):
            before, after = text[:a].split(), text[b:].split()
            if kind == "entry":
                # a single letter after the number belongs to it; digits beside it make another number
                loose = [t for t in before[-1:] + after[:1] if section_number(t) or re.fullmatch("[a-z]", t) and t != "s"]
                if not loose and not self.other_act(text[:a] + " " + text[b:]):
                    return "number", named, what, []
                for n in sorted(self.aliases.get(named, [named.lower()]), key=len, reverse=True):
                    k = re.search(rf"\b{re.escape(n)}\b", text[a:b])
                    if k:
                        laws.append(named)
                        rest[a + k.start() : a + k.end()] = " " * (k.end() - k.start())
                        break
            elif kind == "law":
                laws.append(named)
                rest[a:b] = " " * (b - a)
            else:
                titles.append(what)
        left = "".join(rest).split()
        law = laws[0] if laws else None
        if len(set(titles)) == 1:
            return "title", law, titles[0], []
        if law is None:
            law, left = self.fuzzy_law(left)

        def a_word(t):  # near to a word of the list
            near = nearest(t)
            return near is not None and near[0] <= 1

        words, article = [], False
        for t in left:
            low = t.lower()
            marker = low if low in SECTION_WORDS | ARTICLE_WORDS else None
            if marker is None and t.isalpha() and len(t) > 4 and not a_word(low):
                marker = (self.markers.nearest(low) or (0, None))[1]
            if marker in ARTICLE_WORDS:
                article = True
            elif marker is None or marker not in SECTION_WORDS:
                words.append(t)
        if not words and left[-1:] == ["S"] and (law or len(left) > 1):
            words = ["S"]  # a misread 5 after the word for section
        if law is None and words and re.match(r"(?i)a\b", words[0]) and len(words) > 1 and section_number(words[1]):
            article, words = True, words[1:]
        if law == "CONSTITUTION" and words[:1] and words[0].lower() == "a" and section_number(" ".join(words[1:])):
            words = words[1:]
        number = section_number(" ".join(words)) if words else None
        if number:
            law = law or ("CONSTITUTION" if article else None)
            return ("number", law, number, []) if law else none
        sets = self.token_sets(" ".join(words), nearest)
        return ("sets", law, "", sets) if sets else none

    @staticmethod
    def other_act(text: str) -> bool:
        return bool(re.search(r"\bact\b", text))

    def fuzzy_law(self, tokens: list[str]):
        """A law whose long name the tokens hold within an edit a word, and the tokens without it."""
        near = [(self.law_words.nearest(t.lower()) or (0, None))[1] if len(t) > 3 else t.lower() for t in tokens]
        for names, law in self.long_aliases:
            if names <= {n for n in near if n}:
                return law, [t for t, n in zip(tokens, near) if n not in names]
        one = {self.short_names[n] for n in near if n in self.short_names}
        if len(one) == 1:
            law = one.pop()
            return law, [t for t, n in zip(tokens, near) if n not in self.aliases[law]]
        return None, tokens

    @staticmethod
    def token_sets(text: str, nearest) -> list[frozenset]:
        """The sets of the list's words that the tokens stand for; none if a token is no word of the list."""
        tokens = [t for t in re.sub(r"[()]", " ", text).lower().split() if t not in LIGHT]
        near = [(nearest(t) or (0, None))[1] for t in tokens]
        # a misspelt light word may resemble a title's word, or nothing: it may be left out
        light = [any(edits(t, w, 2) <= (2 if len(w) > 4 else 1) for w in LIGHT if len(w) > 2) for t in tokens]
        if any(n is None and not free for n, free in zip(near, light)):
            return []
        both = frozenset(n for n in near if n), frozenset(n for n, free in zip(near, light) if n and not free)
        return [s for k, s in enumerate(both) if s and s not in both[:k]]


def value_tokens(value: str) -> set[str]:
    t = plain(value).lower()
    return {*t.split(), *re.sub(r"[()]", " ", t).split()}


def _step(state: dict, value: str, part: Part) -> None:
    """Adds to the state what a part tells of a value."""
    state.setdefault("found", []).extend(on_words(part.automaton, plain(value).lower()))
    near = state.setdefault("near", {})
    for t in value_tokens(value):
        n = part.words.nearest(t)
        if n is not None and (t not in near or list(n) < list(near[t])):
            near[t] = list(n)


def _titles(sets: list, best: list, part: Part, least: float) -> list:
    """[share, titles] of the most similar titles so far; the first set that has a title counts."""
    for k, s in enumerate(sets):
        share, keys = part.similar(frozenset(s))
        if share >= least:
            if not keys or (best[0], -best[1]) > (share, -k):
                continue
            best = [share, k, sorted({*best[2], *keys} if (best[0], best[1]) == (share, k) else keys)]
    return best


def _by_value(values: DataFrame, f, schema: str) -> DataFrame:
    """f is called in each task without arguments and gives a function of a row's values that returns the new row's."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        g = f()
        for pdf in batches:
            yield pd.DataFrame([g(*r) for r in zip(*[pdf[c] for c in pdf.columns])], columns=names)

    return values.mapInPandas(run, schema)


def map_mentions(df: DataFrame, keys: list[str], mentions: str, canon: DataFrame, id_col="statute_id", law_col="law", section_col="section", title_col="title", aliases: dict | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """keys, mention_no (from 1, all elements counted), mention, entry_id (-1: reported as meaning no entry).

    Null and blank elements give no row, nor do null or empty arrays; a row sent again with the
    same content gives its rows once. `mentions` is a column or field path of array<string>.
    Entries of one law and number, or of one title, are one provision: its smallest id is given.
    Distinct values are resolved once. The list is read in parts of PART entries, each
    broadcast to the tasks; numbers and titles are then looked up by joins.
    """
    aliases = ALIASES if aliases is None else aliases
    spark = df.sparkSession
    cols = canon.select(F.col(id_col).cast("bigint").alias("id"), F.col(law_col).alias("law"), F.col(section_col).alias("section"), F.col(title_col).alias("title")).where("id is not null")
    parts = max(1, -(-cols.count() // PART))
    base = df.select(*keys, F.posexplode(F.col(mentions)).alias("at", "mention")).where("mention is not null and trim(mention) <> ''")
    base = base.select(*keys, (F.col("at") + 1).alias("mention_no"), "mention").distinct()
    values = base.select("mention").distinct().withColumn("state", F.lit("{}"))
    entries = []
    for k in range(parts):
        some = cols if parts == 1 else cols.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        entries.append(spark.sparkContext.broadcast([tuple(r) for r in some.select("law", "section", "title").distinct().collect()]))  # at most about PART rows

    for e in entries:

        def tell(e=e):
            part = Part(e.value, aliases)

            def one(value, state):
                state = json.loads(state)
                _step(state, value, part)
                return value, json.dumps(state)

            return one

        values = _by_value(values, tell, "mention string, state string")

    def decide():
        reader = Reader(aliases)

        def one(value, state):
            state = json.loads(state)
            near = state.get("near", {})
            kind, law, key, sets = reader.resolve(value, state.get("found", []), lambda t: near.get(t))
            return value, kind, law, key, json.dumps({"sets": [sorted(s) for s in sets], "best": [0.0, 0, []]})

        return one

    values = _by_value(values, decide, "mention string, kind string, law string, key string, state string")
    for e in entries:

        def compare(e=e):
            part = Part(e.value, aliases)

            def one(value, kind, law, key, state):
                if kind != "sets":
                    return value, kind, law, key, state
                state = json.loads(state)
                state["best"] = _titles(state["sets"], state["best"], part, similarity)
                return value, kind, law, key, json.dumps(state)

            return one

        values = _by_value(values, compare, "mention string, kind string, law string, key string, state string")
    titles = F.expr("from_json(get_json_object(state, '$.best[2]'), 'array<string>')")
    read = durable(values.select("mention", F.when(F.col("kind") == "sets", "title").otherwise(F.col("kind")).alias("kind"), "law", F.when(F.col("kind") == "sets", titles).otherwise(F.array("key")).alias("keys")))
    read = read.select("mention", "kind", "law", F.explode("keys").alias("key"))

    def normal():
        def one(i, law, section, title):
            number, tokens = entry_number(section), title_tokens(title)
            return i, entry_law(law), number, _key(tokens) if tokens else None

        return one

    n = durable(_by_value(cols.select("id", "law", "section", "title"), normal, "id long, law string, number string, title string"))
    numbers = n.where("number is not null").groupBy("law", "number").agg(F.min("id").alias("own"))
    titled = n.where("title is not null").join(numbers, ["law", "number"], "left").select("law", "title", F.coalesce("own", "id").alias("own"))
    by_number = read.where("kind = 'number'").join(numbers.withColumnRenamed("number", "key"), ["law", "key"]).select("mention", "own")
    by_law = titled.groupBy("law", F.col("title").alias("key")).agg(F.min("own").alias("own"))
    by_title = read.where("kind = 'title' and law is not null").join(by_law, ["law", "key"]).select("mention", "own")
    of_all = titled.groupBy(F.col("title").alias("key")).agg(F.min("own").alias("own"))
    lawless = read.where("kind = 'title' and law is null").join(of_all, "key").select("mention", "own")
    meant = durable(by_number.union(by_title).union(lawless).groupBy("mention").agg(F.min("own").alias("own")))
    small = meant.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    j = base.join(F.broadcast(meant) if small else meant, "mention", "left")
    return j.select(*keys, "mention_no", "mention", F.coalesce("own", F.lit(-1).cast("bigint")).alias("entry_id"))
