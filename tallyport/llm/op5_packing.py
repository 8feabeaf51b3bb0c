"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document's tokens, with the end token, are first cut into full windows; what is left of it goes, longest first, into
the open window with the least room that still holds it.  A segment tree indexed by remaining capacity finds that window.

Partitions pack on their own, so nothing is shuffled.  A task holds the tokens of at most ``GROUP_TOKENS`` at a time:
when a group is full it is packed and emitted, and the next one begins.  Only the last, part-filled window of each group
adds padding.  Sequence ids are the partition's number in the high bits and a counter in the low ones; a task that runs
again on the same partition gives the same ids.

Edge cases: a null or empty text is the end token alone, one piece; repeated rows are packed as often as they occur; ties
go to the smaller place in the partition; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.llm import _session, _text

NAME = "op5_packing"
ORACLE_SQL = None

WINDOW, END_TOKEN = 4096, 2
#: Tokens that a task holds before it packs them; cached words before the cache starts anew.
GROUP_TOKENS, CACHED_WORDS = 1 << 21, 250_000
#: New words that are encoded together.
TOGETHER = 512
VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class RoomTree:
    """Open windows by remaining capacity: a segment tree of counts finds the least capacity that is large enough."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)
        self.windows: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        heapq.heappush(self.windows.setdefault(room, []), window)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with at least that much room, taken out, and its room."""
        node = least + self.size
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return heapq.heappop(self.windows[room]), room

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.counts[node] += by
            node >>= 1


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths, and the number of sequences."""
    pieces, rests, used = [], [], 0
    for doc, n in enumerate(lengths):
        full = n // window
        for k in range(full):
            pieces.append((doc, k * window, window, used, 0))
            used += 1
        if n - full * window:
            rests.append((full * window - n, doc, full * window))
    rests.sort()
    tree = RoomTree(window)
    for minus, doc, start in rests:
        need = -minus
        found = tree.take(need)
        if found is None:
            found = (used, window)
            used += 1
        sequence, room = found
        pieces.append((doc, start, need, sequence, window - room))
        if room > need:
            tree.add(room - need, sequence)
    return pieces, used


class WordTokens:
    """Token ids by a tokenizer that lower-cases, drops white space and never joins a letter to a mark that follows it.

    So a text's ids are those of its lower-case words and of the marks behind them, in order; each is encoded once and
    looked up afterwards.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # sorted hashes, and which word
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.tokens, self.n_tokens = np.zeros(8192, dtype=np.uint32), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words; ``hashes`` are in order and new."""
        sizes, first = [], self.n_tokens
        for k in range(0, len(words), TOGETHER):  # one text of many words costs less than a call for each; offsets say whose a token is
            part = words[k : k + TOGETHER]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            flat = np.array(found.ids, dtype=np.uint32)
            begins = np.fromiter((x[0] for x in found.offsets), dtype=np.int64, count=len(flat))
            sizes.append(np.diff(np.searchsorted(begins, np.cumsum([0, *(len(w) + 1 for w in part)]))))
            if len(self.tokens) < self.n_tokens + len(flat):
                self.tokens = np.concatenate((self.tokens, np.zeros(max(len(self.tokens) >> 1, len(flat)), dtype=np.uint32)))
            self.tokens[self.n_tokens : self.n_tokens + len(flat)] = flat
            self.n_tokens += len(flat)
        lengths = np.concatenate(sizes)
        at = np.searchsorted(self.keys, hashes)
        self.place = np.insert(self.place, at, len(self.starts) + np.arange(len(hashes)))
        self.keys = np.insert(self.keys, at, hashes)
        self.starts = np.concatenate((self.starts, first + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without special tokens being added."""
        data, bounds = _text.raw(texts)
        whole = data.tobytes()
        if any(s in whole for s in self.special):  # such strings are tokens of their own, wherever they stand
            return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        starts, ends, hashes, at = _text.words(data, bounds, lower=True, marks_apart=True)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(unique, self.keys, assume_unique=True)
        if len(self.keys) + int(new.sum()) > CACHED_WORDS:
            self._clear()
            new[:] = True
        if new.any():
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._learn(unique[new], [whole[a:b].lower().decode() for a, b in spans])
        place = self.place[np.searchsorted(self.keys, unique)][inverse]
        sizes, begins = self.lengths[place], self.starts[place]
        ends_at = np.cumsum(sizes)
        flat = self.tokens[np.repeat(begins - (ends_at - sizes), sizes) + np.arange(int(ends_at[-1]) if len(ends_at) else 0)]
        cuts = np.concatenate(([0], ends_at))[at]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _emit(ids: list[int], tokens: list[np.ndarray], first: int, window: int) -> tuple[pa.RecordBatch, int]:
    pieces, used = best_fit([len(t) for t in tokens], window)
    column = lambda values: pa.array(values, type=pa.int64())
    arrays = [
        column([ids[p[0]] for p in pieces]), column([p[1] for p in pieces]), column([p[2] for p in pieces]), column([len(tokens[p[0]]) for p in pieces]),
        column([first + p[3] for p in pieces]), column([p[4] for p in pieces]), pa.array([tokens[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in pieces], type=pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")]), used


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, window: int = WINDOW, end_token: int = END_TOKEN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The pieces of all documents, each with its token ids (little-endian, 4 bytes each) and its place in a sequence.

    ``vocabulary`` is the path of a tokenizer file, the same on all executors; unset, each executor asks its own package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokens(vocabulary or vocabulary_path())
        end = np.array([end_token], dtype=np.uint32)
        sequence = TaskContext.get().partitionId() << 33
        ids, tokens, held = [], [], 0
        for chunk in _text.chunks(batches, "text"):
            for doc, found in zip(chunk.column("doc_id").to_pylist(), encoder.encode(chunk.column("text")), strict=True):
                whole = np.concatenate((found, end))
                if ids and held + len(whole) > group_tokens:
                    out, used = _emit(ids, tokens, sequence, window)
                    yield from _parts(out)
                    sequence, ids, tokens, held = sequence + used, [], [], 0
                ids.append(doc)
                tokens.append(whole)
                held += len(whole)
        if ids:
            yield from _parts(_emit(ids, tokens, sequence, window)[0])

    def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, batch.num_rows, 1024):
            yield batch.slice(k, 1024)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the contract of op5."""
    pieces = pack(_session.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
