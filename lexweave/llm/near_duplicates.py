"""Problem 1: near-duplicate records, by a prefix-tree join.

Each text is the set of its hashed word n-grams. The n-grams are dealt to slices by hash, and so is
each set. If two sets have a similarity of at least t, they have it in one slice at least: all slices'
overlaps over all slices' unions cannot be more than the largest of their shares. Slices are
sent once, whatever partners they have, and decide on their own; nothing is summed over them. As
slices should have some 14 to 56 n-grams, their number goes by classes of sizes, and a set
is sent to a class above as well if its partners may be there.

One order holds for all slices: ascending corpus frequency, ties by hash, so that rare n-grams come first.
If two slices x, y overlap in at least A = ceil(t / (1 + t) * (|x| + |y|)) n-grams, the first
|x| - A + 2 of x and the first |y| - A + 2 of y share at least two of them. A shard holds the first two
levels of a prefix tree whose paths are such pairs of n-grams: slices that end at one node share two
and are compared, by sizes, by 64 bits of each and by their n-grams. The pairs found in any slice are
verified on whole texts. The filter loses no pair.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.components import connected_components
from lexweave.llm.shingles import WordHashes, distinct_ngrams, mix
from lexweave.session import durable

#: Ids that may be broadcast (8 bytes each); above, a shuffled join does the same.
BROADCAST_IDS = 500_000
#: Texts that one shard compares, by a slice each; above, they are dealt into blocks and a shard has a pair of blocks.
HOT = 3_000_000
PIECES = 64
#: log2 of the cells of the frequency table at most; a corpus gets CELLS a text up to that. Beyond it several n-grams share a
#: cell, which only worsens the order.
TABLE_BITS, CELLS = 24, 64
#: Slices of a class at most.
MOST_SLICES = 4096


def _cells(n_texts: int) -> int:
    """log2 of the frequency table's cells: as many as its pieces at least."""
    return int(max(np.log2(PIECES), min(TABLE_BITS, max(18, np.ceil(np.log2(max(1, n_texts) * CELLS))))))


def _scale(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte, monotone: exact to 100, then logarithmic, to 10**8."""
    c = counts.astype(np.float64)
    return np.where(c <= 100, c, np.minimum(255, 101 + 7.7 * np.log2(np.maximum(c, 1) / 100))).astype(np.uint8)


def _unscale(b: np.ndarray) -> np.ndarray:
    """The largest count of a byte, so that an n-gram never has fewer blocks than it needs."""
    b = b.astype(np.float64)
    return np.where(b <= 100, b, 100 * 2 ** ((b - 100) / 7.7))


def _bound(nx, ny, t: float):
    """Least overlap of sets of nx and ny n-grams whose similarity is at least t."""
    return np.ceil(t / (1 + t) * (nx + ny) - 1e-9).astype(np.int64)


def read_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")


def first_pass(texts: DataFrame, n: int, bits: int) -> DataFrame:
    """Two kinds of rows in one reading of the texts.

    (id, print, size): a 128-bit print of each text's n-gram set; texts without an n-gram are left
    out. (piece, task, counts): in how many of a task's texts an n-gram of each of the 2**bits cells
    occurs, in PIECES compressed pieces.
    """

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        known = WordHashes()
        table = np.zeros(1 << bits, np.uint32)
        empty = {"piece": None, "task": None, "counts": None}
        for pdf in batches:
            ids, out, sizes = [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                s = distinct_ngrams(text, n, known)
                if len(s):
                    ids.append(i)
                    out.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    cells = (s >> np.uint64(64 - bits)).astype(np.int64)  # ascending, as s is
                    table[cells[np.r_[True, cells[1:] != cells[:-1]]]] += np.uint32(1)
            yield pd.DataFrame({"id": np.array(ids, np.int64), "print": out, "size": np.array(sizes, np.int32), **empty})
        parts = [zlib.compress(p.tobytes(), 1) for p in table.reshape(PIECES, -1)]
        yield pd.DataFrame({"id": None, "print": None, "size": None, "piece": np.arange(PIECES), "task": TaskContext.get().partitionId(), "counts": parts})

    return texts.mapInPandas(run, "id long, print binary, size int, piece int, task int, counts binary")


def frequency_table(parts: DataFrame, bits: int):
    """Broadcast uint8 array of 2**bits cells: in how many texts an n-gram of the cell occurs, all texts counted, added up in two steps."""
    spark = parts.sparkSession
    cell = (1 << bits) // PIECES

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(cell, np.uint32)
        for b in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(b), np.uint32)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "task": [pdf["task"].iloc[0] // 64], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "piece int, task int, counts binary"
    some = parts.select("piece", "task", "counts").groupBy("piece", F.expr("task div 64")).applyInPandas(add, kind)
    whole = some.groupBy("piece").applyInPandas(add, kind)
    table = np.zeros(1 << bits, np.uint8)
    for r in whole.select("piece", "counts").toLocalIterator():  # PIECES rows, 2**bits cells in all
        table[r["piece"] * cell : (r["piece"] + 1) * cell] = _scale(np.frombuffer(zlib.decompress(r["counts"]), np.uint32))
    return spark.sparkContext.broadcast(table)


def from_table(texts: DataFrame, n: int, bits: int, table):
    """The texts, and what makes (ids, n-gram sets, frequencies as bytes) of a batch, by the table: two n-grams in a cell only worsen the order."""

    def run(batches):
        known, freq_of = WordHashes(), table.value
        for pdf in batches:
            sets = [distinct_ngrams(text, n, known) for text in pdf["text"]]
            keep = [k for k, s in enumerate(sets) if len(s)]
            sets = [sets[k] for k in keep]
            counts = [freq_of[(s >> np.uint64(64 - bits)).astype(np.int64)] for s in sets]
            yield pdf["id"].to_numpy()[keep], sets, counts

    return texts, run


def _slices(c: int) -> int:
    """Slices of the sets of class c, so that one has some 14 to 56 n-grams of a set."""
    return min(MOST_SLICES, max(1, _lower(c) // 14))


def _lower(c: int) -> int:
    """The least size of a set of class c; class 0 has all sets below 64."""
    return 16 * 4**c if c else 0


def _prefix(sizes: np.ndarray, t: float) -> np.ndarray:
    """How many of the first n-grams of slices of these sizes a partner must share two of; all of them if one may be enough."""
    few = sizes + 1 <= (1 + t) / t + 1e-9
    return np.where(few, sizes, np.minimum(sizes, sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 2))


def postings(source, t: float, blocks: int) -> DataFrame:
    """The slices of all sets in the global order; a row packs what some texts give one shard.

    source: a DataFrame and what makes (ids, sets, frequency bytes) of its batches. Frequencies are
    ordered as bytes, n-grams told apart by 16 bits within a slice: both only add candidates. An n-gram
    in one text only has no partner and is not sent; it keeps its position. A slice whose prefix has
    too few others gives no candidate and is not sent. A set goes to its size's class and to
    those above that a partner can be of. Of more than one block, a shard has a pair of blocks.
    """
    rows_of, sets_of = source

    def deal(batches):
        for ids, sets, counts in sets_of(batches):
            own = (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            for block in np.unique(own):
                mine = np.flatnonzero(own == block)
                for at in range(0, len(mine), 2048):
                    part = mine[at : at + 2048]
                    rows = list(pack(ids[part], [sets[k] for k in part], [counts[k] for k in part]))
                    cells = [min(block, k) * blocks + max(block, k) for k in range(blocks)]
                    yield pd.DataFrame([(*r[:2], int(c), *r[2:]) for r in rows for c in cells], columns=["class", "slice", "cell", "ids", "totals", "sizes", "lens", "grams"])

    def pack(ids, sets, counts):
        n = np.array([len(s) for s in sets], np.int64)
        home = np.maximum(0, (np.log2(n).astype(np.int64) - 4) // 2)
        doc, cls = [np.arange(len(n))], [home]
        while len(own := doc[-1][n[doc[-1]] >= t * np.array([_lower(c + 1) for c in cls[-1]]) - 1e-9]):
            doc, cls = [*doc, own], [*cls, home[own] + len(doc)]
        doc, cls = np.concatenate(doc), np.concatenate(cls)
        parts = np.array([_slices(c) for c in range(cls.max() + 1)], np.int64)
        base = np.r_[0, np.cumsum(parts)]
        g, f = np.concatenate([sets[k] for k in doc]), np.concatenate([counts[k] for k in doc])
        each = np.repeat(np.arange(len(doc)), n[doc])
        shard = base[cls][each] + ((g & np.uint64(0xFFFFFFFF)).astype(np.int64) % parts[cls][each])
        # one word an n-gram: shard, text, frequency, 16 bits of its hash
        word = np.sort((shard.astype(np.uint64) << np.uint64(36)) | (doc[each].astype(np.uint64) << np.uint64(24)) | (f.astype(np.uint64) << np.uint64(16)) | ((g >> np.uint64(32)) & np.uint64(0xFFFF)))
        head = word >> np.uint64(24)
        first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
        sizes = np.diff(np.r_[first, len(word)])
        shared = (word >> np.uint64(16)).astype(np.uint8) > 1
        lens = np.add.reduceat(shared, first, dtype=np.int64)
        least = np.where(sizes + 1 <= (1 + t) / t + 1e-9, 1, 2)
        keep = _prefix(sizes, t) - (sizes - lens) >= least
        grams = word[np.repeat(keep, sizes) & shared].astype(np.uint16)
        head, sizes, lens = head[first][keep], sizes[keep], lens[keep]
        shard, doc = (head >> np.uint64(12)).astype(np.int64), (head & np.uint64(0xFFF)).astype(np.int64)
        end = np.cumsum(lens)
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
        for a, b in zip(cuts, np.r_[cuts[1:], len(shard)].astype(np.int64)):
            c = int(np.searchsorted(base, shard[a], side="right")) - 1
            yield c, int(shard[a] - base[c]), ids[doc[a:b]].tobytes(), n[doc[a:b]].astype(np.int32).tobytes(), sizes[a:b].astype(np.int32).tobytes(), lens[a:b].astype(np.int32).tobytes(), grams[end[a] - lens[a] : end[b - 1]].tobytes()

    return rows_of.mapInPandas(deal, "class int, slice int, cell int, ids binary, totals binary, sizes binary, lens binary, grams binary")


def _spans(counts: np.ndarray, most: int = 1_000_000):
    """Ranges of positions whose counts sum to at most `most`, or that have one position."""
    total, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _inner(counts: np.ndarray):
    """For each position as often as its count: the position, and a number from 0."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def slice_join(totals, sizes, lens, grams, side, lower: int, t: float):
    """Pairs of rows (a, b) whose slices have a similarity of at least t: arrays of positions, each pair once.

    totals: sizes of whole sets, one of which is at least lower; sizes: of slices; lens, grams: their
    n-grams with a partner, in order; side: rows of equal side are not paired, unless it is negative.
    """
    start = np.cumsum(lens, dtype=np.int64) - lens
    depth = np.minimum(lens, _prefix(sizes, t) - (sizes - lens))
    bits = np.bitwise_or.reduceat(np.uint64(1) << (grams & 63).astype(np.uint64), start)
    found: list[np.ndarray] = []

    def judge(i, j):
        """Keep the pairs that are similar: by sizes, by 64 bits of a slice, then by its n-grams."""
        need = _bound(sizes[i], sizes[j], t)
        keep = (np.maximum(totals[i], totals[j]) >= lower) & ((side[i] != side[j]) | (side[i] < 0))
        keep &= np.minimum(totals[i], totals[j]) >= _bound(totals[i], totals[j], t)
        keep &= lens[i] - np.bitwise_count(bits[i] & ~bits[j]).astype(np.int64) >= need
        keep &= lens[j] - np.bitwise_count(bits[j] & ~bits[i]).astype(np.int64) >= need
        key = _distinct(np.minimum(i[keep], j[keep]) * len(sizes) + np.maximum(i[keep], j[keep]))
        i, j = key // len(sizes), key % len(sizes)
        for a, b in _spans(lens[i].astype(np.int64) * lens[j], 4_000_000):
            p, k = _inner(lens[i[a:b]].astype(np.int64) * lens[j[a:b]])
            u, v = i[a:b][p], j[a:b][p]
            same = grams[start[u] + k // lens[v]] == grams[start[v] + k % lens[v]]
            # n-grams of the one that the other has: never fewer than they share
            at = _distinct((p * 65536 + k // lens[v])[same]) // 65536
            enough = np.bincount(at, minlength=b - a) >= _bound(sizes[i[a:b]], sizes[j[a:b]], t)
            found.append(key[a:b][enough])

    def meet(words):
        """Judge the pairs of rows of one key; a word is a key and, in its lower half, a row."""
        words = np.sort(words)
        key, at = words >> np.uint64(32), (words & np.uint64(0xFFFFFFFF)).astype(np.int64)
        more = np.searchsorted(key, key, side="right") - np.arange(len(words)) - 1
        for a, b in _spans(more):
            p, k = _inner(more[a:b])
            i, j = at[a + p], at[a + p + 1 + k]
            judge(i[i < j], j[i < j])

    # the first n-gram shared and the second one are a key; keys are taken in turns of bounded size
    kinds, times = np.unique(depth, return_counts=True)
    turns = 1 + int((kinds * (kinds - 1) // 2 * times).sum()) // 6_000_000
    for turn in range(turns):
        words = [np.empty(0, np.uint64)]
        for d in kinds[kinds > 1]:
            rows = np.flatnonzero(depth == d)
            for cut in range(0, len(rows), 100_000):
                x = rows[cut : cut + 100_000]
                g = grams[start[x, None] + np.arange(d)].astype(np.uint64)
                for b in range(1, d):
                    for a in range(b):
                        key = (g[:, a] << np.uint64(16)) | g[:, b]
                        w = (key << np.uint64(32)) | x.astype(np.uint64)
                        words.append(w if turns == 1 else w[(key * np.uint64(40503) >> np.uint64(12)) % np.uint64(turns) == turn])
        meet(np.concatenate(words))
    # slices so small that one n-gram may be enough
    few = np.flatnonzero(sizes + 1 <= (1 + t) / t + 1e-9)
    k, inner = _inner(lens[few])
    meet((grams[start[few][k] + inner].astype(np.uint64) << np.uint64(32)) | few[k].astype(np.uint64))
    key = _distinct(np.concatenate([np.empty(0, np.int64), *found]))
    return key // len(sizes), key % len(sizes)


def candidate_pairs(dealt: DataFrame, t: float, blocks: int) -> DataFrame:
    """(a, b), a < b: all pairs that have a similarity of t in one slice, among them all that have it as a whole."""

    def join(rows: pa.Table) -> pa.Table:
        c, cell = rows["class"][0].as_py(), rows["cell"][0].as_py()

        def get(name, kind):
            # the values of a binary column lie end to end
            x = rows[name].combine_chunks()
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
            return np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind)

        ids, totals, sizes, lens, grams = get("ids", np.int64), get("totals", np.int32), get("sizes", np.int32), get("lens", np.int32), get("grams", np.uint16)
        # a text that was sent again came twice: keep one of each id
        _, one = np.unique(ids, return_index=True)
        if len(one) < len(ids):
            keep = np.zeros(len(ids), bool)
            keep[one] = True
            ids, totals, sizes, grams, lens = ids[keep], totals[keep], sizes[keep], grams[np.repeat(keep, lens)], lens[keep]
        side = np.full(len(ids), -1) if cell // blocks == cell % blocks else (mix(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        a, b = slice_join(totals, sizes, lens, grams, side, _lower(c), t)
        return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})

    return dealt.groupBy("class", "slice", "cell").applyInArrow(join, "a long, b long").distinct()


def _semi(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on id; ids is broadcast only if it was counted to be small."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, "id", how)


def verify(pairs: DataFrame, texts: DataFrame, n: int, t: float) -> DataFrame:
    """(a, b, overlap) of the pairs whose whole n-gram sets reach t."""
    ids = durable(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    own = _semi(texts, ids, "left_semi").dropDuplicates(["id"])
    left = own.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = own.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")

    def measure(batches):
        known = WordHashes()
        seen: dict[int, np.ndarray] = {}

        def grams(i, text):
            if i not in seen:
                if len(seen) >= 512:
                    seen.clear()
                seen[i] = distinct_ngrams(text, n, known)
            return seen[i]

        for pdf in batches:
            over = np.zeros(len(pdf))
            for r, (a, b, x, y) in enumerate(zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"])):
                x, y = grams(a, x), grams(b, y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                over[r] = both / max(1, len(x) + len(y) - both)
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "overlap": over})
            yield out[out["overlap"] >= t]

    return both.mapInPandas(measure, "a long, b long, overlap double")


class NearDuplicates:
    """The join's results: `members` (id, rep), one row per id; `pairs` (a, b, overlap) between representatives.

    Representatives stand for ids whose n-gram sets are equal; the smallest id of them is taken.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8):
        """Rows with a null id or text, and texts with fewer than n words, have no partner and are left out.

        Rows that repeat an id with the same text count once. Other columns are ignored.
        """
        self.texts = texts = read_texts(df, id_col, text_col)
        bits = _cells(texts.count())
        first = durable(first_pass(texts, n, bits))
        prints = first.where("id is not null").select("id", "print").distinct()
        reps = prints.groupBy("print").agg(F.min("id").alias("rep"))
        self.members = durable(prints.join(reps, "print").groupBy("id").agg(F.min("rep").alias("rep")))
        own = self.members.where("id = rep").select("id")
        copies = self.members.where("id <> rep").select("id")
        total = own.count()
        # the shorter list of the two, so that texts are shuffled only if both are long
        whole = _semi(texts, own, "left_semi") if total < copies.count() else _semi(texts, copies, "left_anti")
        blocks = 1 if total <= HOT else -(-2 * total // HOT)
        dealt = postings(from_table(whole, n, bits, frequency_table(first.where("piece is not null"), bits)), threshold, blocks)
        candidates = durable(candidate_pairs(dealt, threshold, blocks))
        self.pairs = verify(candidates, whole, n, threshold)

    def all_pairs(self) -> DataFrame:
        """(a, b), a < b: the links of all ids, copies written out."""
        m = self.members
        same = m.alias("x").join(m.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        left = m.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
        right = m.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
        other = self.pairs.join(left, "a").join(right, "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
        return same.union(other)

    def groups(self) -> DataFrame:
        """(id, group, links): one row per id; group is its class's smallest id, links counts the other texts it is linked to."""
        pairs = durable(self.pairs.select("a", "b"))
        roots = connected_components(pairs).toDF("rep", "root")
        links = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
        out = self.members.join(roots, "rep", "left").join(links, "rep", "left")
        return out.select("id", F.coalesce("root", "rep").alias("group"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
