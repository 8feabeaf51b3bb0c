"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's inputs are the buckets of its words (``BUCKETS`` of them, with damped counts, scaled to unit length), numbers
about its structure (symbols, capitals, line ends, repetition, length) and the declared number of characters.  The score is

    w0 + sum(w_i x_i) + 1/2 sum_f [ (sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2 ]

so pairwise interactions cost as much time as the inputs are many.  Buckets and sums are numpy over whole batches; scoring
has no shuffle and keeps one batch.

The machine is fitted by AdaGrad on at most ``2 * _labels.PER_CLASS`` labelled rows, one for each id (the smallest text, if an id
has many), in the order of ids, which reach the driver as at most ``BUCKETS`` numbers each; the classes are weighted as they
occur among all labelled rows.

Edge cases: null and empty texts have no buckets and are scored by their statistics (zeros); a null number of characters
is taken from the text; without labelled rows of both classes every score is the share of good labels (0 if there are
none); repeated rows get equal scores; an empty table gives an empty result; other columns travel in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyport.llm import _labels, _session, _text

NAME = "op2_quality"
ORACLE_SQL = None

PREDICT_AT = 0.7
BUCKETS, FACTORS = 1 << 13, 6
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.1, 1e-5
#: Rows that training sees at least, counting each again in every epoch.
LEAST_SEEN, MOST_EPOCHS = 40_000, 60

#: Bytes whose share is a statistic: symbols, capitals, digits, marks that end a sentence, other marks, not ASCII.
_KINDS = [b"#*$%&|<>~^@", bytes(range(65, 91)), b"0123456789", b".!?", b",;:'\"()-", bytes(range(128, 256))]
_SHARE = np.zeros((len(_KINDS), 256), dtype=np.int32)
for _k, _members in enumerate(_KINDS):
    _SHARE[_k, list(_members)] = 1


def inputs(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its buckets (text, bucket and value of each, in order of text) and its row of statistics."""
    data, bounds = _text.raw(texts)
    starts, ends, hashes, at = _text.words(data, bounds, lower=True)
    n, n_words, n_bytes = len(bounds) - 1, np.diff(at), np.diff(bounds)
    doc = np.repeat(np.arange(n), n_words)
    pairs, counts = np.unique(doc * BUCKETS + (hashes >> np.uint64(64 - 13)).astype(np.int64), return_counts=True)
    of, bucket, value = pairs // BUCKETS, pairs % BUCKETS, 1 + np.log(counts)
    value = value / np.sqrt(np.bincount(of, value**2, minlength=n))[of]
    some = np.maximum(1, n_bytes)
    shares = [np.diff(np.concatenate(([0], np.cumsum(_SHARE[k][data])))[bounds]) / some for k in range(len(_KINDS))]
    lines = np.diff(np.concatenate(([0], np.cumsum(data == 10)))[bounds])
    distinct = np.bincount(of, minlength=n)
    sizes = (ends - starts).astype(np.float64)
    follows = np.concatenate(([False], hashes[1:] == hashes[:-1])) & np.concatenate(([False], doc[1:] == doc[:-1])) if len(hashes) else np.zeros(0, dtype=bool)
    marked = _SHARE[0][data[ends - 1]] if len(ends) else np.zeros(0, dtype=np.int32)
    words = np.maximum(1, n_words)
    declared = np.array(pc.fill_null(n_chars.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
    declared = np.where(np.isnan(declared), pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), declared)
    statistics = [
        np.log1p(n_words), np.log1p(np.maximum(0, declared)), np.log1p(lines), *(np.sqrt(s) for s in shares),
        np.bincount(doc, sizes, minlength=n) / words, distinct / words, np.sqrt(np.bincount(doc, follows, minlength=n) / words),
        np.sqrt(np.bincount(doc, marked, minlength=n) / words), (n_words < 50).astype(np.float64), (n_words == 0).astype(np.float64),
    ]
    return of, bucket, value, np.stack(statistics, axis=1)


def joined(of: np.ndarray, bucket: np.ndarray, value: np.ndarray, statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and scaled statistics as one sparse list of (text, input, value)."""
    n, k = statistics.shape
    return np.concatenate((of, np.repeat(np.arange(n), k))), np.concatenate((bucket, np.tile(BUCKETS + np.arange(k), n))), np.concatenate((value, statistics.ravel()))


def machine(of: np.ndarray, at: np.ndarray, x: np.ndarray, n: int, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output for each text, by the identity above, and its sums over inputs for each factor."""
    sums = np.stack([np.bincount(of, v[at, f] * x, minlength=n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(of, (v * v).sum(axis=1)[at] * x * x, minlength=n)
    return w0 + np.bincount(of, w[at] * x, minlength=n) + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def train(rows: list[tuple[np.ndarray, np.ndarray]], statistics: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """AdaGrad on the weighted logistic loss; rows are (buckets, values) of each text."""
    middle, scale = statistics.mean(axis=0), statistics.std(axis=0) + 1e-3
    scaled = np.clip((statistics - middle) / scale, -4, 4) / 4
    random = np.random.Generator(np.random.PCG64(11))
    size = BUCKETS + statistics.shape[1]
    w, v, w0 = np.zeros(size), random.normal(0, 0.02, (size, FACTORS)), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    seen_w, seen_v, seen_0 = np.full(size, 0.1), np.full((size, FACTORS), 0.1), 1.0
    lists = [(np.concatenate((b, BUCKETS + np.arange(statistics.shape[1]))), np.concatenate((x, s))) for (b, x), s in zip(rows, scaled, strict=True)]
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, LEAST_SEEN // len(y)))):
        order = random.permutation(len(y))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            at, x = (np.concatenate([lists[i][j] for i in batch]) for j in (0, 1))
            of = np.repeat(np.arange(len(batch)), [len(lists[i][0]) for i in batch])
            out, sums = machine(of, at, x, len(batch), w0, w, v)
            slope = weight[batch] * (_labels.sigmoid(out) - y[batch]) / len(batch)
            used, place = np.unique(at, return_inverse=True)
            gw = np.bincount(place, slope[of] * x, minlength=len(used)) + DECAY * w[used]
            both = slope[of][:, None] * (x[:, None] * sums[of] - v[at] * (x * x)[:, None])
            gv = np.stack([np.bincount(place, both[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) + DECAY * v[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_0 += slope.sum() ** 2
            w[used] -= RATE * gw / np.sqrt(seen_w[used])
            v[used] -= RATE * gv / np.sqrt(seen_v[used])
            w0 -= RATE * slope.sum() / np.sqrt(seen_0)
    return {"w0": w0, "w": w, "v": v, "middle": middle, "scale": scale}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", n_chars: str = "n_chars") -> dict:
    """The machine from a bounded sample of labelled documents."""
    taken, totals = _labels.sample(labels.select("doc_id", F.col(label).alias("y")), "y")
    share = totals[1] / max(1, sum(totals.values()))
    known = docs.select("doc_id", F.col(text).cast("string").alias("text"), F.col(n_chars).cast("double").alias("n_chars")).join(F.broadcast(taken), "doc_id")
    known = known.groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("least")).select("doc_id", "label", "least.*")  # an id may have many rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text.chunks(batches, "text"):
            of, bucket, value, statistics = inputs(chunk.column("text"), chunk.column("n_chars"))
            edges = np.searchsorted(of, np.arange(chunk.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
            wide = pa.ListArray.from_arrays(np.arange(chunk.num_rows + 1, dtype=np.int32) * statistics.shape[1], pa.array(statistics.ravel()))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("label"), *lists, wide], names=["doc_id", "label", "buckets", "values", "statistics"])

    schema = "doc_id long, label int, buckets array<int>, values array<float>, statistics array<double>"
    found = known.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text", "n_chars").mapInArrow(run, schema).toArrow().sort_by("doc_id")
    y = found.column("label").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return {"w0": None, "share": share}
    columns = [[np.asarray(x.values) for x in found.column(c)] for c in ("buckets", "values", "statistics")]
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    rows = [(b.astype(np.int64), v.astype(np.float64)) for b, v in zip(columns[0], columns[1], strict=True)]
    return train(rows, np.array(columns[2]), y, weight / weight.mean()) | {"share": share}


def score(docs: DataFrame, model: dict, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``row`` (each input row as a struct) and its ``score``."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"), F.col(n_chars).cast("double").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text.chunks(batches, "text"):
            if model["w0"] is None:
                p = np.full(chunk.num_rows, float(model["share"]))
            else:
                of, bucket, value, statistics = inputs(chunk.column("text"), chunk.column("n_chars"))
                scaled = np.clip((statistics - model["middle"]) / model["scale"], -4, 4) / 4
                p = _labels.sigmoid(machine(*joined(of, bucket, value, scaled), chunk.num_rows, model["w0"], model["w"], model["v"])[0])
            yield pa.RecordBatch.from_arrays([chunk.column("row"), pa.array(p)], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the contract of op2."""
    docs = _session.table(spark, sf_dir, "documents")
    model = fit(docs, _session.table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select(F.col("row.doc_id").alias("doc_id"), _labels.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
