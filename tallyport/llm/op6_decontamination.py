"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1.  Windows of ``SEED`` words of the test items are counted over all documents; only windows that some item has leave a
    task, as partial counts.  An item's seeds are those of its windows that the corpus has most rarely.
2.  Where a document has a seed of an item, the passage that the item could cover there, with as many insertions as the
    score allows, is aligned with it by Smith-Waterman over words; passages that touch are aligned as one.
3.  A document leaks an item if the best score is at least ``LEAST_SCORE`` of what the item itself would score.

Test items are a stated query set: they are taken in blocks of at most ``BLOCK_WINDOWS`` windows, and each block goes to the
tasks whole, so that documents are neither shuffled nor joined, however common a window may be.  A task holds one batch of
documents and the block.

Words are runs of letters, in lower case; marks and digits are dropped.  Items of fewer than ``LEAST_WORDS`` words are
searched for exactly: all their tokens in a row, which are words and numbers, and single characters of scripts without
spaces (:class:`Exact`).  Edge cases: null and empty texts have no windows; items of fewer than ``LEAST_TOKENS`` tokens are
not searched for; an item without an id is searched for like others and is reported without one; without items, nothing leaks; repeated documents and repeated items are reported as often as they occur; other columns pass through
:func:`decontaminate` in a struct.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyport.llm import _session, _text

NAME = "op6_decontamination"
ORACLE_SQL = None

#: Words of a seed; seeds of an item: this many at least, and this share of its windows; words of an item at least.
SEED, LEAST_SEEDS, SEED_SHARE, LEAST_WORDS = 3, 24, 0.6, 8
#: Tokens of an item that is searched for exactly, at least; as many as a window has.
LEAST_TOKENS = SEED
#: First and last characters of scripts without spaces between words.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1980, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3000, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9DF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
#: The share of an item's own score that a leak reaches, and the scores of an alignment.
LEAST_SCORE, MATCH, MISMATCH, GAP = 0.6, 2, -1, -1
#: Words of a passage beyond what the item covers, on either side, at least (see :func:`slack`), and windows of a block of items.
SLACK, BLOCK_WINDOWS = 10, 1 << 20
#: Pairs of a seed's place in a text and in an item that are looked at together, about.
MOST_ENTRIES = 1 << 21

LEAKS = "doc_id long, item_id long, score double, start long, stop long"


def slack(n: int) -> int:
    """How far a leak of an item of ``n`` words may stray from the diagonal of any of its seeds: all that its score can lose, as gaps."""
    return max(SLACK, 1 + int((1 - LEAST_SCORE) * MATCH * n / -GAP))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local score of two word sequences, and the place in the passage behind its last word."""
    steps = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, stop = 0, 0
    for word in item:
        fresh = np.maximum(row + GAP, 0)
        np.maximum(fresh[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH), out=fresh[1:])
        row = np.maximum.accumulate(fresh + steps) - steps  # a gap in the item costs its length
        top = int(row.argmax())
        if row[top] > best:
            best, stop = int(row[top]), top
    return best, stop


def located(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best score, first place and the place behind the last one; the first is found by aligning backwards."""
    best, stop = align(item, passage)
    back = align(item[::-1], passage[:stop][::-1])[1]
    return best, stop - back, stop


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, and where each text's words start and end."""
    data, bounds = _text.raw(_lower(texts))
    _, _, hashes, at = _text.words(data, bounds, lower=False, letters_only=True)
    return hashes, at


def windows(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``SEED`` words, and the place of each in the whole list of words."""
    n = np.maximum(0, np.diff(at) - SEED + 1)
    place = np.repeat(at[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    value = np.zeros(len(place), dtype=np.uint64)
    for k in range(SEED):
        value = value * np.uint64(_text._BASE) + hashes[place + k]
    return _text.mix(value), place


class Lookup:
    """Whether 64-bit hashes are in a set: a table of their top bits first, then the sorted set."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[self.values >> np.uint64(44)] = True

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these are in the set, and their places in it."""
        likely = np.flatnonzero(self.table[found >> np.uint64(44)])
        at = np.searchsorted(self.values, found[likely])
        sure = self.values[np.minimum(at, len(self.values) - 1)] == found[likely] if len(self.values) else np.zeros(len(likely), dtype=bool)
        return likely[sure], at[sure]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By character: 0 ends a token, 1 is part of one, 2 is one by itself."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    kinds[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LMN"]] = 1
    for first, last in UNSPACED:
        kinds[first : last + 1] *= 2
    return kinds


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First character, the one behind the last, and hash of each token of lower-case texts, and where each text's tokens start and end."""
    texts = pc.fill_null(texts, "")
    bounds = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
    letters = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    kinds = _kinds()[letters]
    part = kinds == 1
    edge = np.zeros(len(letters) + 1, dtype=bool)  # a text begins
    edge[bounds] = True
    before, after = np.concatenate(([False], part[:-1])), np.concatenate((part[1:], [False]))
    starts = np.flatnonzero((kinds == 2) | part & (~before | edge[:-1]))
    ends = np.flatnonzero((kinds == 2) | part & (~after | edge[1:])) + 1
    up, down = _text._powers(len(letters) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_text.mix(letters.astype(np.uint64) + np.uint64(1)) * up[: len(letters)], dtype=np.uint64)))
    return starts, ends, _text.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def _runs(hashes: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs of tokens."""
    up, down = _text._powers(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    return _text.mix((sums[place + length] - sums[place]) * down[place] + length.astype(np.uint64))


class Exact:
    """Short items: texts that hold all tokens of one in a row.

    The first window of an item is looked up; where a text has it, runs of the lengths of the items that begin so are compared.
    """

    def __init__(self, texts: list[str]) -> None:
        _, _, hashes, at = tokens_of(_lower(pa.array(texts, type=pa.string())))
        length = np.diff(at)
        kept = np.flatnonzero(length >= LEAST_TOKENS)
        at, length = at[:-1][kept], length[kept]
        whole = _runs(hashes, at, length)
        self.items: dict[int, list[int]] = {}
        for k, h in zip(kept.tolist(), whole.tolist(), strict=True):
            self.items.setdefault(h, []).append(k)
        first = _runs(hashes, at, np.full(len(at), LEAST_TOKENS))
        self.first, self.whole = Lookup(first), Lookup(whole)
        pairs = np.unique(np.stack((np.searchsorted(self.first.values, first), length), axis=1), axis=0)
        self.length = pairs[:, 1]
        self.starts, self.stops = (np.searchsorted(pairs[:, 0], np.arange(len(self.first.values)), side=s) for s in ("left", "right"))

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """Text, item, score (1), first and last place in words, for the first copy of an item in each text."""
        if not self.items:
            return
        lower = _lower(texts)
        starts, ends, hashes, at = tokens_of(lower)
        place = np.arange(max(0, len(hashes) - LEAST_TOKENS + 1))
        hit, which = self.first.hits(_runs(hashes, place, np.full(len(place), LEAST_TOKENS)))
        many = self.stops[which] - self.starts[which]
        length = self.length[np.repeat(self.starts[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        place = np.repeat(place[hit], many)
        text = np.searchsorted(at, place, side="right") - 1
        inside = place + length <= at[text + 1]
        place, length, text = place[inside], length[inside], text[inside]
        value = _runs(hashes, place, length)
        sure, _ = self.whole.hits(value)
        begins = np.concatenate(([0], np.cumsum(pc.utf8_length(pc.fill_null(lower, "")).to_numpy(zero_copy_only=False), dtype=np.int64)))
        seen = set()
        for k in sure.tolist():
            t, h = int(text[k]), int(value[k])
            if (t, h) in seen:
                continue
            seen.add((t, h))
            body = lower[t].as_py()
            first, stop = (int(x - begins[t]) for x in (starts[place[k]], ends[place[k] + length[k] - 1]))
            _, words = words_of(pa.array([body[:first], body[first:stop]], type=pa.string()))
            for item in self.items[h]:
                yield t, item, 1.0, int(words[1]), int(words[2])


class Seeds:
    """A block of items with their seeds, and of short items: leaks of a batch of documents."""

    def __init__(self, items: list[tuple[int, np.ndarray]], counts: dict[int, int], short: list[tuple[int, str]] | None = None) -> None:
        self.items, short = items, short or []
        self.ids = [i for i, _ in items] + [i for i, _ in short]
        self.exact = Exact([t for _, t in short])
        seed, item, place = [], [], []
        for k, (_, hashes) in enumerate(items):
            own, at = windows(hashes, np.array([0, len(hashes)]))
            known = sorted((counts[h], p, h) for h, p in zip(own.tolist(), at.tolist(), strict=True) if h in counts)
            for _, p, h in known[: max(LEAST_SEEDS, int(len(own) * SEED_SHARE))]:
                seed.append(h)
                item.append(k)
                place.append(p)
        values = np.array(seed, dtype=np.uint64)
        order = np.argsort(values, kind="stable")
        self.lookup = Lookup(values)
        self.item, self.place = np.array(item, dtype=np.int64)[order], np.array(place, dtype=np.int64)[order]
        self.starts = np.searchsorted(values[order], self.lookup.values)
        self.stops = np.searchsorted(values[order], self.lookup.values, side="right")

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """Text, item (a place in ``ids``), score as a share, first and last place, for each leak."""
        for t, k, *rest in self.exact.leaks(texts):
            yield t, len(self.items) + k, *rest
        hashes, at = words_of(texts)
        value, place = windows(hashes, at)
        hit, which = self.lookup.hits(value)
        if not len(hit):
            return
        text = np.searchsorted(at, place[hit], side="right") - 1
        many = self.stops[which] - self.starts[which]
        edges = np.concatenate(([0], np.cumsum(many)))
        first = 0
        while first < len(hit):  # texts together, up to MOST_ENTRIES; of one text with more, ranges of items after each other
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + MOST_ENTRIES, side="right")) - 1)
            last = int(np.searchsorted(text, text[last], side="left")) if last < len(hit) else last
            last = last if last > first else int(np.searchsorted(text, text[first], side="right"))
            for low, high in self._ranges(which[first:last]):
                yield from self._aligned(hashes, at, text[first:last], place[hit[first:last]], which[first:last], low, high)
            first = last

    def _ranges(self, which: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of items so that each has about ``MOST_ENTRIES`` entries below these seeds."""
        total = int((self.stops[which] - self.starts[which]).sum())
        if total <= MOST_ENTRIES:
            return [(0, len(self.items))]
        times = np.zeros(len(self.items), dtype=np.int64)
        for seed, n in zip(*np.unique(which, return_counts=True), strict=True):
            times += n * np.bincount(self.item[self.starts[seed] : self.stops[seed]], minlength=len(times))
        cuts = np.searchsorted(np.cumsum(times), np.arange(MOST_ENTRIES, total + MOST_ENTRIES, MOST_ENTRIES), side="right") + 1
        cuts = np.unique(np.concatenate(([0], np.minimum(cuts, len(times)), [len(times)])))
        return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def _aligned(self, hashes: np.ndarray, at: np.ndarray, text: np.ndarray, place: np.ndarray, which: np.ndarray, low_item: int, high_item: int) -> Iterator[tuple[int, int, float, int, int]]:
        """The leaks of these texts among a range of items."""
        starts, stops = self.starts[which], self.stops[which]
        if high_item - low_item < len(self.items):  # the entries of a seed are in the order of items
            ends = [self.starts[k] + np.searchsorted(self.item[self.starts[k] : self.stops[k]], (low_item, high_item)) for k in which.tolist()]
            starts, stops = np.array(ends, dtype=np.int64).reshape(-1, 2).T
        many = stops - starts
        entry = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        if not len(entry):
            return
        text = np.repeat(text, many)
        item, begin = self.item[entry], np.repeat(place, many) - self.place[entry]
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        new = np.concatenate(([True], (np.diff(text) != 0) | (np.diff(item) != 0)))
        groups = np.append(np.flatnonzero(new), len(text))
        for a, b in zip(groups[:-1], groups[1:], strict=True):
            words, t = self.items[item[a]][1], text[a]
            least, wide = LEAST_SCORE * MATCH * len(words), slack(len(words))
            best = None
            at_once = a
            for k in range(a + 1, b + 1):
                if k < b and begin[k] - begin[k - 1] <= wide:
                    continue
                low, high = max(int(at[t]), int(begin[at_once]) - wide), min(int(at[t + 1]), int(begin[k - 1]) + len(words) + wide)
                at_once = k
                passage = hashes[low:high]
                if MATCH * np.isin(words, passage).sum() < least:
                    continue
                score, stop = align(words, passage)
                if score >= least and (best is None or score > best[0]):
                    best = (score, low, passage)
            if best:
                score, start, stop = located(words, best[2])
                yield int(t), int(item[a]), score / (MATCH * len(words)), best[1] + start - int(at[t]), best[1] + stop - int(at[t])


def blocks(docs: DataFrame, items: DataFrame, text: str) -> Iterator[Seeds]:
    """The items in blocks of bounded size, each with its seeds."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).collect()[0]["n"] // 4
    n = 1 + size // BLOCK_WINDOWS
    for k in range(n):
        found = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        taken = sorted(((r["item_id"], r["text"]) for r in found), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        hashes, at = words_of(pa.array([t for _, t in taken], type=pa.string()))
        kept = [(i, hashes[a:b].copy()) for (i, _), a, b in zip(taken, at[:-1], at[1:], strict=True) if b - a >= LEAST_WORDS]
        short = [x for x, n in zip(taken, np.diff(at), strict=True) if n < LEAST_WORDS]
        if not kept:
            if short:
                yield Seeds([], {}, short)
            continue
        lookup = Lookup(np.concatenate([windows(h, np.array([0, len(h)]))[0] for _, h in kept]))

        def count(batches: Iterator[pa.RecordBatch], lookup: Lookup = lookup) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(lookup.values), dtype=np.int64)
            for chunk in _text.chunks(batches, "text"):
                sums += np.bincount(lookup.hits(windows(*words_of(chunk.column("text")))[0])[1], minlength=len(sums))
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(lookup.values[some].view(np.int64)), pa.array(sums[some])], names=["seed", "n"])

        partial = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "seed long, n long")
        counts = {r["seed"] % (1 << 64): r["n"] for r in partial.groupBy("seed").agg(F.sum("n").alias("n")).collect()}
        yield Seeds(kept, counts, short)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and item that it leaks: the best score, and the passage's first word and the one behind it."""
    out = docs.sparkSession.createDataFrame([], LEAKS)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    for block in blocks(docs, items, text):

        def run(batches: Iterator[pa.RecordBatch], block: Seeds = block) -> Iterator[pa.RecordBatch]:
            for chunk in _text.chunks(batches, "text"):
                ids = chunk.column("doc_id").to_pylist()
                found = [(ids[t], block.ids[i], s, a, b) for t, i, s, a, b in block.leaks(chunk.column("text"))]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=[x.split()[0] for x in LEAKS.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, LEAKS))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns as they came."""
    for block in blocks(docs, items, text):
        rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))

        def run(batches: Iterator[pa.RecordBatch], block: Seeds = block) -> Iterator[pa.RecordBatch]:
            for chunk in _text.chunks(batches, "text"):
                clean = np.ones(chunk.num_rows, dtype=bool)
                clean[[x[0] for x in block.leaks(chunk.column("text"))]] = False
                yield pa.RecordBatch.from_arrays([chunk.column("row")], names=["row"]).filter(pa.array(clean))

        docs = rows.mapInArrow(run, T.StructType([rows.schema["row"]])).select("row.*")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all test items."""
    return leaks(_session.table(spark, sf_dir, "documents"), _session.table(spark, sf_dir, "benchmark"))
