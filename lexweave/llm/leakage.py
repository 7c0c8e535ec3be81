"""Problem 6: passages of evaluation items inside a corpus, by q-gram filtering in diagonal bands.

Items are few and held by every task (their size is checked; more are worked off in parts).
The q-grams of characters that start at word starts are indexed. A document's q-grams are
looked up; each hit lies on the diagonal given by the two word positions, and hits are counted
in overlapping bands of diagonals.

By the q-gram lemma a passage that is as long as the share asked for demands, and has up to
EDITS of its words changed, added or left out, keeps a number of its q-grams in one band: what
its windows hold, less what each edit can destroy. An unchanged passage, however it is cut up,
keeps at least the runs that are no shorter than a q-gram. Bands that meet neither bound are
dropped. The regions that remain are verified by a banded alignment of words, which gives the
best passage's matched words and edits; the runs held are then counted exactly, over all
runs of the text, since one shorter than a q-gram need not be a hit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.shingles import WORD, WordHashes, mix, ngram_hashes

#: Items that one broadcast index holds.
PART = 20_000
#: Half the width of a band of diagonals, and how far an alignment may leave it on each side.
BAND, DRIFT = 8, 4
#: Share of a passage's words that the filter lets be edited without losing it.
EDITS = 0.1
#: What an edit costs in an alignment, a matched word counting 1: a passage has at most a quarter of its words edited.
EDIT_COST = 3


def _starts_and_bytes(text: str):
    """The text as its words joined by blanks, in bytes, and the byte offset of each word."""
    words = [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text.lower())]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    return words, b" ".join(words), np.cumsum(lens + 1) - lens - 1


def _qgrams(data: bytes, starts: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes at each start; q is 8 or 16. Beyond the end there are zero bytes."""
    buf = data + b"\0" * 24
    view = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    h = mix(view[starts].astype(np.uint64))
    if q == 16:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + view[starts + 8])
    return h


class Index:
    """Items as arrays: the sorted q-grams of word starts, and for each its places (item, word)."""

    def __init__(self, items, words: int = 5, share: float = 0.3):
        self.words, self.share = words, share
        known = WordHashes()
        texts = []
        self.hashes: list[np.ndarray] = []
        for i, text in items:
            w, data, starts = _starts_and_bytes(text or "")
            h = np.fromiter((known[x.decode("utf-8", "surrogatepass")] for x in w), np.uint64, len(w))
            runs = ngram_hashes(h, words)
            if len(runs):
                ends = np.r_[starts[1:] - 1, len(data)]
                texts.append((i, data, starts, runs, ends[words - 1 :] - starts[: len(runs)]))
                self.hashes.append(h)
        self.ids = np.array([t[0] for t in texts], np.int64)
        need, short = [], {8: [], 16: []}
        for _, _, _, runs, lens in texts:
            distinct = len(np.unique(runs))
            need.append(int(np.ceil(share * distinct - 1e-9)))
            for q in short:
                short[q].append(len(np.unique(runs[lens < q])))
        self.need = np.maximum(1, np.array(need, np.int64))
        # the longer q-grams are taken if runs shorter than one could not make up an item's share
        self.q = 16 if texts and all(s < n for s, n in zip(short[16], self.need)) else 8
        self.least = np.maximum(1, self.need - np.array(short[self.q], np.int64)) if texts else self.need
        self.own = [np.unique(runs) for _, _, _, runs, _ in texts]
        grams, item, word, fits, edited = [], [], [], [], []
        for k, (_, data, starts, runs, lens) in enumerate(texts):
            n, m = len(runs), len(starts)
            grams.append(_qgrams(data, starts, self.q))
            item.append(np.full(m, k))
            word.append(np.arange(m))
            # how many q-grams starting in a run of words end in it
            inside = np.array([sum(starts[p] + self.q <= starts[r] + lens[r] for p in range(r, r + words)) for r in range(n)])
            fits.append(int(inside[inside > 0].min(initial=words)))
            edited.append(self._after_edits(starts, len(data), int(self.need[k]) + words - 1))
        self.needs, self.edited = np.array(fits, np.int64), np.array(edited, np.int64)
        self.sizes = np.array([len(h) for h in self.hashes], np.int64)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        g, self.item, self.word = cat(grams, np.uint64), cat(item, np.int64), cat(word, np.int64)
        order = np.argsort(g, kind="stable")
        g, self.item, self.word = g[order], self.item[order], self.word[order]
        self.grams, self.first = np.unique(g, return_index=True)
        self.count = np.diff(np.r_[self.first, len(g)])
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.grams >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def _after_edits(self, starts, size: int, span: int) -> int:
        """The least number of q-grams that a passage of `span` words of an item keeps after EDITS of them were edited, at least 2."""
        m, e = len(starts), int(EDITS * span)
        # the word in which the q-gram of each word ends; beyond the last for one that the item does not hold whole
        last = np.where(starts + self.q <= size, np.searchsorted(starts, starts + self.q - 1, side="right") - 1, m)
        within = [int((last[a : a + span] < a + span).sum()) for a in range(max(1, m - span + 1))]
        covers = np.bincount(np.concatenate([np.arange(w, min(x, m - 1) + 1) for w, x in enumerate(last)]), minlength=m)
        return max(2, min(within) - e * int(covers.max()))

    def search(self, texts: list[str], known: WordHashes):
        """(text's position, item's position, held runs, matched words, edits) of the texts with a passage of an item.

        That is one that makes up the share asked for by its held runs, or by its matched words.
        """
        joined, starts, base, owner, hashes = [], [], 0, [], []
        for t, text in enumerate(texts):
            w = WORD.findall(text.lower()) if text else []
            if len(w) < self.words:
                continue
            data = " ".join(w).encode("utf-8", "surrogatepass")
            raw = np.frombuffer(data, np.uint8)
            at = np.r_[0, np.flatnonzero(raw == 32) + 1]
            joined.append(data)
            joined.append(b"\0" * 16)
            starts.append(at + base)
            base += len(data) + 16
            owner.append(np.full(len(at), t))
            hashes.append(w)
        none = np.empty(0, np.int64)
        if not joined or not len(self.grams):
            return none, none, none, none, none
        starts, owner = np.concatenate(starts), np.concatenate(owner)
        h = _qgrams(b"".join(joined), starts, self.q)
        hit = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, h[hit]), len(self.grams) - 1)
        same = self.grams[at] == h[hit]
        hit, at = hit[same], at[same]
        out = []
        # texts of one batch in slices of bounded numbers of places
        places = np.cumsum(self.count[at])
        cuts = [0]
        while cuts[-1] < len(hit):
            goal = (places[cuts[-1] - 1] if cuts[-1] else 0) + 4_000_000
            nxt = max(cuts[-1] + 1, int(np.searchsorted(places, goal, side="right")))
            nxt = int(np.searchsorted(owner[hit], owner[hit[min(nxt, len(hit)) - 1]], side="right"))  # whole texts
            cuts.append(nxt)
        for a, b in zip(cuts, cuts[1:]):
            out.append(self._verify(hit[a:b], at[a:b], owner, hashes, known))
        return tuple(np.concatenate([o[k] for o in out]) if out else none for k in range(5))

    def _verify(self, hit, at, owner, hashes, known):
        n = self.count[at]
        which = np.repeat(np.arange(len(hit)), n)
        place = self.first[at][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        pos, text, item = hit[which], owner[hit][which], self.item[place]
        # items with too few hits in the text at all cannot be reached by any band
        items, none = len(self.ids), np.empty(0, np.int64)
        key = text * items + item
        u, inv, c = np.unique(key, return_inverse=True, return_counts=True)
        enough = (c >= self.least[u % items])[inv]
        ok = enough | (c >= self.edited[u % items])[inv]
        pos, text, item, place, key, enough = pos[ok], text[ok], item[ok], place[ok], key[ok], enough[ok]
        if not len(pos):
            return (none,) * 5
        # diagonal bands of width 2 * BAND that overlap by half: a hit lies in two
        diagonal = pos - self.word[place]
        band = diagonal // BAND
        low = int(band.min())
        span = int(band.max()) - low + 2
        own, next_ = key * span + band - low, key * span + band - low + 1
        _, inv1, c1 = np.unique(np.r_[own, next_], return_inverse=True, return_counts=True)
        first, second = c1[inv1[: len(key)]], c1[inv1[len(key) :]]
        most = np.maximum(first, second)
        ok = (enough & (most >= self.needs[item])) | (most >= self.edited[item])
        if not ok.any():
            return (none,) * 5
        # each hit that is left in the fuller of its bands: the regions
        region = np.unique(np.where(first >= second, own, next_)[ok])
        row = {t: r for r, t in enumerate(np.unique(owner))}
        docs = {int(t): np.fromiter(map(known.__getitem__, hashes[row[t]]), np.uint64, len(hashes[row[t]])) for t in np.unique(region // span // items)}
        begin = np.searchsorted(owner, sorted(docs))
        offset = dict(zip(sorted(docs), begin.tolist()))
        which, at = region // span, (region % span + low - 1) * BAND
        matched, edits = self._align(which, at - np.array([offset[int(t)] for t in which // items]), docs)
        # the best passage of each pair of text and item
        order = np.lexsort((edits, -matched, which))
        u, head = np.unique(which[order], return_index=True)
        matched, edits = matched[order][head], edits[order][head]
        # the item's runs among all of the text's, also those that are no hit
        held, last, runs = np.zeros(len(u), np.int64), None, None
        for r, (t, i) in enumerate(zip(u // items, u % items)):
            if t != last:
                last, runs = t, ngram_hashes(docs[int(t)], self.words)
            held[r] = np.isin(self.own[i], runs).sum()
        ok = (matched >= self.words) & ((held >= self.need[u % items]) | (matched >= np.ceil(self.share * self.sizes[u % items] - 1e-9)))
        return u[ok] // items, u[ok] % items, held[ok], matched[ok], edits[ok]

    def _align(self, which, diagonal, docs, step: int = 512):
        """The best local alignment of words in each region: matched words and edits.

        which: text * items + item; diagonal: the first of the band's 2 * BAND diagonals. A row of the
        table is a word of the item; all regions of a step go through it together.
        """
        items, wide = len(self.ids), 2 * BAND + 2 * DRIFT
        matched, edits = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        order = np.argsort(self.sizes[which % items], kind="stable")
        shift = 1 << 20  # a cell holds its score and, below, the words matched
        toll = EDIT_COST * shift
        slope = np.arange(wide, dtype=np.int64) * toll
        for s in range(0, len(order), step):
            some = order[s : s + step]
            rows = int(self.sizes[which[some] % items].max())
            mine = np.zeros((len(some), rows), np.uint64)
            theirs = np.zeros((len(some), rows + wide), np.uint64)
            real = np.zeros((len(some), rows), bool)
            there = np.zeros((len(some), rows + wide), bool)
            for r, k in enumerate(some):
                h, d, a = self.hashes[which[k] % items], docs[int(which[k] // items)], int(diagonal[k]) - DRIFT
                mine[r, : len(h)], real[r, : len(h)] = h, True
                x, y = max(0, a), min(len(d), a + rows + wide)
                if x < y:
                    theirs[r, x - a : y - a], there[r, x - a : y - a] = d[x:y], True
            cell = np.zeros((len(some), wide), np.int64)
            best = np.zeros(len(some), np.int64)
            for i in range(rows):
                same = (theirs[:, i : i + wide] == mine[:, i : i + 1]) & real[:, i : i + 1] & there[:, i : i + wide]
                skipped = np.zeros_like(cell)
                skipped[:, :-1] = cell[:, 1:] - toll
                cell = np.maximum(np.maximum(cell + np.where(same, shift + 1, -toll), skipped), 0)
                cell = np.maximum.accumulate(cell + slope, axis=1) - slope  # words of the text put in between
                np.maximum(best, cell.max(axis=1), out=best)
            score, words = best // shift, best % shift
            matched[some], edits[some] = words, (words - score) // EDIT_COST
        return matched, edits


def passages(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, words: int = 5, share: float = 0.3) -> DataFrame:
    """(doc_id, item_id, held, item_needs, matched, edits): documents with a passage of an item, whole, in part or edited.

    held counts the item's distinct runs of `words` words that the document holds as they are,
    item_needs is the least number that makes up `share` of them; matched and edits are those
    of the best passage by alignment. A pair is given if held reaches item_needs or matched `share`
    of the item's words. Nulls in a document's or an item's text count as empty; items of fewer than
    `words` words have no run and are never found. Repeated rows give one row. The corpus is not shuffled.
    """
    spark = df.sparkSession
    few = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null").distinct()
    parts = max(1, -(-few.count() // PART))
    texts = df.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).alias("t")).where("d is not null and t is not null")
    found = None
    for k in range(parts):
        some = few if parts == 1 else few.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in some.collect()], words, share))  # at most about PART rows

        def search(batches, index=index):
            ix, known = index.value, WordHashes()
            for pdf in batches:
                t, i, held, matched, edits = ix.search(list(pdf["t"]), known)
                yield pd.DataFrame({"doc_id": pdf["d"].to_numpy()[t], "item_id": ix.ids[i], "held": held, "item_needs": ix.need[i], "matched": matched, "edits": edits})

        part = texts.mapInPandas(search, "doc_id long, item_id long, held long, item_needs long, matched long, edits long")
        found = part if found is None else found.union(part)
    return found.distinct()


def leaked(*args, **more) -> DataFrame:
    """(doc_id, item_id, held, item_needs) of the passages whose unchanged runs make up the share."""
    return passages(*args, **more).where("held >= item_needs").select("doc_id", "item_id", "held", "item_needs").distinct()
