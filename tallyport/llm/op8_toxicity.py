"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one from what toxic documents say significantly more often than others,
one from ordinary text.  Their content is given, not chosen by zstandard's own trainer, which fills a dictionary with what is
frequent in either text and so tells them apart less well (figures in README).  A window is a word in lower case (marks and digits end it); a run of more than ``LONGEST`` bytes, as in scripts
without spaces, is cut into windows that cover all of it.  A window is compressed with either dictionary, and
the ratio of the two lengths says whose language it is.  A document's windows below each of several ratios are counted,
and a logistic calibration on labelled rows, counted by dictionaries that have not seen them, turns the counts into a probability.

zstandard spends some bytes on any frame, which would drown words of five letters; so each letter is stretched to four
bytes that also depend on its place in the word, by which a match means the same letters at the same place.

Equal windows have equal lengths, so each is compressed once per task; the whole text counts, whatever its length.  The
fit uses at most ``2 * _labels.PER_CLASS`` labelled rows, one for each id (the smallest text, if an id has many), in ``PARTS`` parts; each part is counted by dictionaries
of the others, so that all rows serve both the dictionaries and the calibration, and few labels suffice.  What reaches the driver is bounded by
``TOXIC_WORDS`` and ``ORDINARY_WORDS`` a dictionary and one row of counts per sampled document.  Scoring has no shuffle.

Edge cases: with few labels, words that few toxic documents hold may count (:data:`CHOICES`), and a language of two or three toxic
documents is hardly learned; null and empty texts have no windows and get the calibration's base probability; without labelled rows of
both classes every score is the share of toxic labels (0 if there are none); repeated rows get equal scores; an empty
table gives an empty result; other columns pass through :func:`score` in a struct and cannot clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyport.llm import _labels, _session, _text

NAME = "op8_toxicity"
ORACLE_SQL = None

PREDICT_AT = 0.3
#: Words of either dictionary at most, and how much more often toxic documents hold a word of the toxic one at least.
TOXIC_WORDS, ORDINARY_WORDS, LEAST_RATIO = 1500, 48_000, 5.0
#: Toxic documents that hold such a word, and the log-likelihood ratio of that, at least, since of many rare words some are in toxic
#: documents alone by chance; :func:`fit` takes the pair that suits the labels.
CHOICES = ((1, 3.0), (2, 6.0), (2, 9.0), (3, 12.0))
#: Parts of the sample, each of which is counted by dictionaries of the others; weight of the calibration's penalty.
PARTS, RIDGE = 4, 1.0
#: Ratios of lengths below which windows are counted.
CUTS = (0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6)
STRETCH, LONGEST, KNOWN = 4, 64, 400_000


def stretched(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The windows of lower-case words, each letter as four bytes keyed by its place, end to end; their offsets and sizes.

    Words end with a space and have at most ``LONGEST`` bytes, since longer ones come in pieces.
    """
    sizes = ends - starts + 1
    stops = np.cumsum(sizes)
    at = np.arange(int(stops[-1])) - np.repeat(stops - sizes, sizes)
    letters = np.concatenate((data, [32]))[np.minimum(np.repeat(starts, sizes) + at, len(data))].astype(np.int64)
    letters[stops - 1] = 32
    out = np.stack([(letters * a + at * b + c) & 255 for a, b, c in ((1, 37, 0), (5, 91, 17), (11, 53, 99), (7, 29, 151))], axis=1).astype(np.uint8)
    return out.tobytes(), (stops - sizes) * STRETCH, sizes * STRETCH


def dictionary(words: list[str]) -> bytes:
    """The content of a dictionary; what comes last is the cheapest to refer to."""
    raw = [w.encode() for w in words]
    if not raw:
        return b""
    sizes = np.array([len(w) for w in raw])
    return stretched(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes))[0]


class Distance:
    """Ratios of compressed lengths, by hash of window."""

    def __init__(self, model: dict, ordinary: zstandard.ZstdCompressor | None = None) -> None:
        self.compressors = [self._compressor(model["toxic"]), ordinary or self._compressor(model["ordinary"])]
        self.known = _text.Known(np.float32, KNOWN)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        # The search goes deep enough to find the longest match among words that begin alike.
        parameters = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_LAZY2, min_match=6, search_log=9, chain_log=21, hash_log=20, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        if len(content) < 8:
            return zstandard.ZstdCompressor(compression_params=parameters)
        trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=trained, compression_params=parameters)

    def ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Length with the toxic dictionary over length with the ordinary one, of each window."""
        out = []
        for k in range(0, len(starts), 8192):
            buffer, offsets, sizes = stretched(data, starts[k : k + 8192], ends[k : k + 8192])
            windows = zstandard.BufferWithSegments(buffer, np.stack((offsets, sizes), axis=1).astype("<u8").tobytes())
            toxic, ordinary = (np.fromiter((len(x) for x in c.multi_compress_to_buffer(windows, threads=1)), dtype=np.float32, count=len(sizes)) for c in self.compressors)
            out.append(toxic / ordinary)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.float32)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Per text: windows below each ratio of ``CUTS``, and all windows."""
        data, bounds = _text.raw(texts)
        data = _text._LOWER[data]
        starts, ends, hashes, at = _text.words(data, bounds, lower=False, letters_only=True, longest=LONGEST)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = self.known.missing(unique)
        if new.any():
            self.known.add(unique[new], self.ratios(data, starts[first[new]], ends[first[new]]))
        ratio = self.known.get(unique)[inverse] if len(unique) else np.zeros(0, dtype=np.float32)
        sums = [np.concatenate(([0], np.cumsum(ratio <= cut)))[at] for cut in CUTS]
        return np.stack([*(np.diff(s) for s in sums), np.diff(at)], axis=1).astype(np.float64)


def features(counts: np.ndarray) -> np.ndarray:
    """What the calibration sees of the counts: how many windows, what share, and whether any, are below each ratio."""
    total = counts[:, -1:]
    return np.hstack((np.log1p(counts[:, :-1]), np.minimum(1, counts[:, :-1] / np.maximum(total, 10)) * 10, np.log1p(total), counts[:, :-1] > 0))


def _word_documents(docs: DataFrame) -> DataFrame:
    """A row for each document and different word of it: word, label, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text.chunks(batches, "text"):
            data, bounds = _text.raw(chunk.column("text"))
            data = _text._LOWER[data]
            starts, ends, hashes, at = _text.words(data, bounds, lower=False, letters_only=True, longest=LONGEST)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            order = np.lexsort((hashes, doc))
            if not len(order):
                continue
            keep = order[np.concatenate(([True], (np.diff(doc[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])))]
            keep = keep[ends[keep] - starts[keep] >= 3]
            whole = data.tobytes()
            words = pa.array([whole[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)], type=pa.binary()).cast(pa.string())
            of = [pa.array(chunk.column(n).to_numpy(zero_copy_only=False)[doc[keep]], type=pa.int32()) for n in ("label", "part")]
            yield pa.RecordBatch.from_arrays([words, *of], names=["word", "label", "part"])

    return docs.select("text", "label", "part").mapInArrow(run, "word string, label int, part int")


def _dictionaries(known: DataFrame) -> dict[int, dict]:
    """For each part, dictionaries of the rows of the other parts (``toxic`` has one for each of ``CHOICES``); for ``PARTS``, of all rows.

    At most ``(PARTS + 1) * (len(CHOICES) * TOXIC_WORDS + ORDINARY_WORDS)`` words reach the driver.
    """
    sizes = {(r[0], r[1]): r[2] for r in known.groupBy("label", "part").count().collect()}
    one = lambda label, part: F.count_if((F.col("label") == label) & (F.col("part") == part))
    counted = _word_documents(known).groupBy("word").agg(*[one(c, p).alias(f"{n}{p}") for c, n in ((1, "t"), (0, "o")) for p in range(PARTS)])
    counted = _session.materialize(counted, "op8-words")
    folds = []
    for left_out in range(PARTS + 1):
        parts = [p for p in range(PARTS) if p != left_out]
        toxic_docs, other_docs = (sum(sizes.get((c, p), 0) for p in parts) for c in (1, 0))
        t, o = (sum((F.col(f"{n}{p}") for p in parts), F.lit(0)) for n in "to")
        ratio = ((t + 0.5) / (toxic_docs + 1)) / ((o + 0.5) / (other_docs + 1))
        both = (t + o) / F.lit(max(1, toxic_docs + other_docs))
        share = lambda n, docs, both=both: F.when(n > 0, n * F.log(n / (docs * both))).otherwise(0.0)
        folds.append(F.struct(F.lit(left_out).alias("fold"), t.alias("t"), o.alias("o"), ratio.alias("ratio"), (2 * (share(t, toxic_docs) + share(o, other_docs))).alias("likelihood")))
    words = counted.select("word", F.explode(F.array(*folds)).alias("of")).select("word", "of.*")
    strength = F.col("t") * F.log("ratio")
    toxic = words.filter(F.col("ratio") >= LEAST_RATIO).withColumn("choice", F.explode(F.array(*[F.lit(k) for k in range(len(CHOICES))])))
    allowed = [(F.col("choice") == k) & (F.col("t") >= docs) & (F.col("likelihood") >= likelihood) for k, (docs, likelihood) in enumerate(CHOICES)]
    toxic = toxic.filter(functools.reduce(lambda a, b: a | b, allowed)).withColumn("place", F.row_number().over(Window.partitionBy("fold", "choice").orderBy(strength.desc(), "word")))
    ordinary = words.filter((F.col("o") > 0) & (F.col("ratio") < LEAST_RATIO)).withColumn("place", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("o"), "word")))
    lists: dict[tuple[int, int], list[str]] = {}
    for r in toxic.filter(F.col("place") <= TOXIC_WORDS).orderBy("fold", "choice", F.desc("place")).select("fold", "choice", "word").collect():
        lists.setdefault((r["fold"], r["choice"]), []).append(r["word"])
    for r in ordinary.filter(F.col("place") <= ORDINARY_WORDS).orderBy("fold", F.desc("place")).select("fold", "word").collect():
        lists.setdefault((r["fold"], -1), []).append(r["word"])
    _session.discard(counted)
    made = {key: dictionary(words) for key, words in lists.items()}
    return {f: {"toxic": [made.get((f, k), b"") for k in range(len(CHOICES))], "ordinary": made.get((f, -1), b"")} for f in range(PARTS + 1)}


def _fold_counts(known: DataFrame, models: dict[int, dict]) -> DataFrame:
    """``doc_id, label, part`` and the counts of each document, for each choice, by the dictionaries that have not seen it."""
    sent = known.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[Distance]] = {}
        for chunk in _text.chunks(batches, "text"):
            parts = chunk.column("part").to_numpy(zero_copy_only=False)
            for part in np.unique(parts).tolist():
                rows = chunk.filter(pa.array(parts == part))
                if part not in of:  # rows come part by part: the compressors of one are held at a time
                    of.clear()
                    ordinary = Distance._compressor(sent.value[part]["ordinary"])
                    of[part] = [Distance({"toxic": content}, ordinary) for content in sent.value[part]["toxic"]]
                wide = np.hstack([distance.counts(rows.column("text")) for distance in of[part]])
                lists = pa.ListArray.from_arrays(np.arange(len(wide) + 1, dtype=np.int32) * wide.shape[1], pa.array(wide.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), rows.column("part"), lists], names=["doc_id", "label", "part", "counts"])

    return known.select("doc_id", "label", "part", "text").sortWithinPartitions("part").mapInArrow(run, "doc_id long, label int, part int, counts array<double>")


def _loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray, part: np.ndarray) -> float:
    """Weighted logarithmic loss of calibrations on each part that were fitted on the others."""
    p = np.full(len(y), np.average(y, weights=weight))
    for k in np.unique(part):
        rest, own = part != k, part == k
        if len(np.unique(y[rest])) == 2:
            middle, scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-6
            beta = _labels.logistic((x[rest] - middle) / scale, y[rest], weight[rest], RIDGE)
            p[own] = _labels.sigmoid((x[own] - middle) / scale @ beta[:-1] + beta[-1])
    return float(-np.average(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1)), weights=weight))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text") -> dict:
    """Dictionaries of all sampled rows, and a calibration on counts that each row has by dictionaries of the other parts alone.

    How sure a word must be to count as toxic depends on how many labels there are; of ``CHOICES`` that is taken whose
    calibrations lose the least on the parts that they have not seen.  Only rows of the sample take part in the choice.
    """
    taken, totals = _labels.sample(labels.select("doc_id", F.col(label).alias("y")), "y")
    share = totals[1] / max(1, sum(totals.values()))
    if not totals[0] or not totals[1]:
        return {"toxic": b"", "ordinary": b"", "beta": None, "share": share}
    known = docs.select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    known = known.groupBy("doc_id", "label", "part").agg(F.min("text").alias("text"))  # an id may have many rows
    known = _session.materialize(known, "op8")
    models = _dictionaries(known)
    rows = _fold_counts(known, models).orderBy("doc_id").collect()
    _session.discard(known)
    y, part = (np.array([r[n] for r in rows], dtype=np.float64) for n in ("label", "part"))
    whole = models[PARTS]
    if len(set(y)) < 2:
        return {"toxic": whole["toxic"][0], "ordinary": whole["ordinary"], "share": share, "beta": None}
    taken_of = [min(totals[c], _labels.PER_CLASS) for c in (0, 1)]
    weight = np.where(y == 1, totals[1] / taken_of[1], totals[0] / taken_of[0])
    weight /= weight.mean()
    seen = np.array([r["counts"] for r in rows]).reshape(len(rows), len(CHOICES), -1)
    xs = [features(seen[:, k]) for k in range(len(CHOICES))]
    losses = [_loss(x, y, weight, part) for x in xs]
    best = int(np.argmin(losses))
    x = xs[best]
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    beta = _labels.logistic((x - middle) / scale, y, weight, RIDGE)
    return {"toxic": whole["toxic"][best], "ordinary": whole["ordinary"], "share": share, "choice": best, "losses": losses, "beta": beta, "middle": middle, "scale": scale}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``row`` (each input row as a struct) and its ``score``."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model)
        for chunk in _text.chunks(batches, "text"):
            if model["beta"] is None:
                p = np.full(chunk.num_rows, model["share"])
            else:
                x = (features(distance.counts(chunk.column("text"))) - model["middle"]) / model["scale"]
                p = _labels.sigmoid(x @ model["beta"][:-1] + model["beta"][-1])
            yield pa.RecordBatch.from_arrays([chunk.column("row"), pa.array(p)], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = PREDICT_AT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with their columns as they came."""
    return score(docs, fit(docs, labels, text=text), text).filter(F.col("score") < threshold).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the contract of op8."""
    docs = _session.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, _session.table(spark, sf_dir, "labels")))
    return scored.select(F.col("row.doc_id").alias("doc_id"), _labels.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
