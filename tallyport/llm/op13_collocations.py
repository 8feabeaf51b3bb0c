"""Phrase collocation mining with position bitmaps, after SPAM.

A shard is a slice of a task's texts.  Its words stand at numbered places, with an empty place after each piece of a text (and
each text), and every word has a bitmap of its places: bytes of eight places, of which only those that are not zero are kept.  A phrase's
bitmap marks the places of its last word; it is extended by shifting it one place and AND-ing it with the bitmaps of the words
that stand in the same bytes, and the bits of the result are counted.  Phrases are extended depth first: a batch of first words is
followed to the full length before the next.  What shards count is summed by Spark.

A phrase cannot occur more often than its parts, so a shard extends only phrases whose parts occur often enough in the whole corpus: a
pass counts words, one pairs, one triples, and each is told of the frequent ones before it by a filter of 2 to the power
``FILTER_BITS`` bits, which has that size at any size of the corpus (8 MiB).  A filter that is too full lets rare phrases through, which their
counts then drop: more is shuffled, and the result is the same.  Scores are exact: integers of 38 digits.

Words are told apart within a shard by 64-bit hashes; across shards by their text.

Edge cases: null and empty texts have no words; rows without ``lang`` belong to ``und``; repeated rows count as often as they occur; ties of score and
count go to the smaller phrase; very long texts make a larger shard; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyport.llm import _session, _text

NAME = "op13_collocations"

#: Occurrences of a candidate at least; per cent of a candidate's count from which a longer one takes its place; phrases of each language.
LEAST_COUNT, COVERED_PERCENT, TOP = 10, 50, 2000
#: Bytes of text of a shard, bits of a filter (as a power of two), bitmap bytes that are extended at once.
SHARD, FILTER_BITS, BATCH = 3 << 19, 26, 60_000
_BUCKET = 8 * 4096  # bits of one row of Spark's bitmap functions

_PIECE = np.zeros(256, dtype=bool)
_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
_CLEAN = np.where(_PIECE, 32, _text._LOWER).astype(np.uint8)
_POPCOUNT = np.array([bin(k).count("1") for k in range(256)], dtype=np.int64)


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Start, end, hash, text and place of each word, and the texts' bytes in lower case; places skip one between pieces."""
    data, bounds = _text.raw(texts)
    clean = _CLEAN[data]
    starts, ends, hashes, at = _text.words(clean, bounds, lower=False)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    marks = np.concatenate(([0], np.cumsum(_PIECE[data])))
    apart = (marks[starts[1:]] > marks[ends[:-1]]) | (doc[1:] != doc[:-1])
    return starts, ends, hashes, doc, clean.tobytes(), np.arange(len(starts)) + np.concatenate(([0], np.cumsum(apart)))[: len(starts)]


def _salt(langs: pa.Array) -> np.ndarray:
    """A 64-bit value of each text's language, so that equal words of two languages are different ones."""
    coded = pc.dictionary_encode(langs)
    values = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
    return values[coded.indices.to_numpy(zero_copy_only=False)]


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _text.mix(first * np.uint64(_text._BASE) + second)


def _bit(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """The bit of each key among ``n_bits``, a power of two."""
    return keys >> np.uint64(65 - n_bits.bit_length())


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    at = _bit(keys, 8 * len(bits))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Shard:
    """The words of some texts: their different ones, and which of them stands where."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        starts, ends, hashes, doc, raw, self.places = places(texts)
        self.keys, first, self.ids = np.unique(_text.mix(hashes + _salt(langs)[doc]), return_index=True, return_inverse=True)
        self.words = pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], type=pa.binary()).cast(pa.string())
        self.langs = langs.take(pa.array(doc[first]))

    def counts(self) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, word and count of each word; a null word has the count of all."""
        n = np.bincount(self.ids, minlength=len(self.keys))
        coded = pc.dictionary_encode(self.langs)
        total = np.bincount(coded.indices.to_numpy(zero_copy_only=False), weights=n, minlength=len(coded.dictionary)).astype(np.int64)
        return pa.concat_arrays([self.langs, coded.dictionary]), pa.concat_arrays([self.words, pa.nulls(len(total), pa.string())]), np.concatenate((n, total))

    def phrases(self, size: int, word_bits: np.ndarray, pair_bits: np.ndarray | None, batch: int = BATCH) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """Language, phrase and count of the phrases of ``size`` (2 or 3) words whose parts pass the filters."""
        kept = passes(word_bits, self.keys)[self.ids]
        maps, n_words = Bitmaps(self.ids[kept], self.places[kept]), len(self.keys)
        for at in range(0, len(maps.of), batch):  # a batch of first words, extended to the end
            of, block, mask = (x[at : at + batch] for x in (maps.of, maps.block, maps.mask))
            source, word, block, mask = maps.extended(block, mask)
            pairs, pair, count = _counted(of[source].astype(np.int64) * n_words + word, mask)
            if size == 3:
                good = passes(pair_bits, pair_keys(self.keys[pairs // n_words], self.keys[pairs % n_words]))
                keep = good[pair]
                pair, block, mask = pair[keep], block[keep], mask[keep]
                for part in range(0, len(pair), batch):
                    source, word, _, found = maps.extended(block[part : part + batch], mask[part : part + batch])
                    triples, _, count = _counted(pair[part : part + batch][source] * n_words + word, found)
                    two, last = pairs[triples // n_words], triples % n_words
                    keep = passes(pair_bits, pair_keys(self.keys[two % n_words], self.keys[last]))
                    yield self._named([two[keep] // n_words, two[keep] % n_words, last[keep]], count[keep])
            else:
                yield self._named([pairs // n_words, pairs % n_words], count)

    def _named(self, words: list[np.ndarray], count: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        return self.langs.take(pa.array(words[0])), pc.binary_join_element_wise(*(self.words.take(pa.array(w)) for w in words), " "), count


def _counted(keys: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, the number of each row's key, and the bits that are set in the masks of each key."""
    unique, of = np.unique(keys, return_inverse=True)
    return unique, of, np.bincount(of, weights=_POPCOUNT[masks], minlength=len(unique)).astype(np.int64)


class Bitmaps:
    """The bytes that are not zero of each word's bitmap, ordered by word, and the same ordered by place."""

    def __init__(self, ids: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, at = ids[order], at[order]
        block = at >> 3
        new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (block[1:] != block[:-1])))) if len(ids) else order
        self.of, self.block = ids[new], block[new]
        self.mask = np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), new) if len(new) else np.zeros(0, dtype=np.uint8)
        across = np.argsort(self.block, kind="stable")
        self.across_of, self.across_mask = self.of[across], self.mask[across]
        self.first = np.searchsorted(self.block[across], np.arange(int(self.block.max(initial=0)) + 4))

    def extended(self, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """These bytes shifted by a place and AND-ed with the words' there: source row, word, block and mask of what is left."""
        wide = mask.astype(np.uint16) << 1
        low, high = np.flatnonzero(wide & 255), np.flatnonzero(wide >> 8)
        source, where = np.concatenate((low, high)), np.concatenate((block[low], block[high] + 1))
        bits = np.concatenate(((wide[low] & 255).astype(np.uint8), np.ones(len(high), dtype=np.uint8)))
        start = self.first[where]
        many = self.first[where + 1] - start
        row = np.repeat(np.arange(len(source)), many)
        other = np.arange(len(row)) + np.repeat(start - (np.cumsum(many) - many), many)
        both = bits[row] & self.across_mask[other]
        hit = np.flatnonzero(both)
        row, other = row[hit], other[hit]
        return source[row], self.across_of[other], where[row], both[hit]


def _pass(docs: DataFrame, size: int, word_bits=None, pair_bits=None, shard: int = SHARD) -> DataFrame:
    """``lang, phrase, f`` of the phrases of ``size`` words of ``docs (text, lang)`` whose parts pass the filters (broadcasts of bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text.chunks(batches, "text", shard):
            words = Shard(chunk.column("text"), chunk.column("lang"))
            found = [words.counts()] if size == 1 else words.phrases(size, word_bits.value, pair_bits.value if pair_bits else None)
            for langs, phrases, count in found:
                yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(count, type=pa.int64())], names=["lang", "phrase", "n"])
            _text.release()

    counted = docs.mapInArrow(run, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _filter(frequent: DataFrame, n_bits: int) -> np.ndarray:
    """The bits at the keys of ``frequent (lang, phrase)``, words or pairs; ``n_bits`` of them, whatever the number of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, _, hashes, doc, _, _ = places(batch.column("phrase"))
                keys = _text.mix(hashes + _salt(batch.column("lang"))[doc])
                first = np.searchsorted(doc, np.arange(batch.num_rows))
                last = np.searchsorted(doc, np.arange(batch.num_rows), side="right") - 1
                keys = np.where(first == last, keys[first], pair_keys(keys[first], keys[last]))
                yield pa.RecordBatch.from_arrays([pa.array(_bit(keys, n_bits).astype(np.int64))], names=["bit"])

    bits = frequent.select("lang", "phrase").mapInArrow(run, "bit long")
    made = bits.groupBy(F.floor(F.col("bit") / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % _BUCKET).alias("bits"))
    out = np.zeros(n_bits // 8, dtype=np.uint8)
    for r in made.collect():  # at most n_bits / _BUCKET rows of 4 KiB
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def counts(docs: DataFrame, least: int = LEAST_COUNT, text: str = "text", n_bits: int = 1 << FILTER_BITS, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables ``lang, phrase, f`` of the words (a null phrase has the count of all words), pairs and triples that occur ``least`` times or more."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words = _session.materialize(_pass(rows, 1, shard=shard).filter(f"phrase is null or f >= {least}"), "op13-words")
    word_bits = spark.sparkContext.broadcast(_filter(words.filter("phrase is not null"), n_bits))
    pairs = _session.materialize(_pass(rows, 2, word_bits, shard=shard).filter(f"f >= {least}"), "op13-pairs")
    pair_bits = spark.sparkContext.broadcast(_filter(pairs, n_bits))
    triples = _session.materialize(_pass(rows, 3, word_bits, pair_bits, shard).filter(f"f >= {least}"), "op13-triples")
    word_bits.unpersist()
    pair_bits.unpersist()
    return words, pairs, triples


def _score(a: str, left: str, right: str) -> Column:
    whole = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  1e6 * a * a has 36 digits at most
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame, covered: int = COVERED_PERCENT) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates that no longer one covers."""
    last, head = F.substring_index("phrase", " ", -1), F.substring_index("phrase", " ", 1)
    but_last, but_head = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    cuts = pairs.select("lang", "phrase", F.col("f").alias("a"), F.lit(1).alias("k"), head.alias("first"), last.alias("rest"))
    both = F.explode(F.array(F.struct(F.lit(1).alias("k"), head.alias("first"), but_head.alias("rest")), F.struct(F.lit(2).alias("k"), but_last.alias("first"), last.alias("rest"))))
    cuts = cuts.unionByName(triples.select("lang", "phrase", F.col("f").alias("a"), both.alias("cut")).select("lang", "phrase", "a", "cut.*"))
    parts = words.filter("phrase is not null").unionByName(pairs)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    best = cuts.select("lang", "phrase", "a", F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inside = triples.select("lang", F.explode(F.array(but_last, but_head)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    best = best.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST_COUNT, covered: int = COVERED_PERCENT, text: str = "text", n_bits: int = 1 << FILTER_BITS, shard: int = SHARD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` best phrases of each language."""
    words, pairs, triples = counts(docs, least, text, n_bits, shard)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first in parts of a language, so that no task has all of one
    found = scored(words, pairs, triples, covered).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return found.join(words.filter("phrase is null").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the contract of op13."""
    return collocations(_session.table(spark, sf_dir, "documents").select("text", "lang"))


#: Words numbered within pieces, phrases from the words that follow: another way to the same rows.
ORACLE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
split AS (SELECT doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS pieces FROM docs),
pieces AS (SELECT doc, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM split),
lists AS (SELECT doc, p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT doc, p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
runs AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc, p ORDER BY i)),
one AS (SELECT lang, w, count(*) AS f FROM runs GROUP BY ALL),
two AS (SELECT lang, w, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.w || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r FROM two t
  JOIN one x ON x.lang = t.lang AND x.w = t.w JOIN one y ON y.lang = t.lang AND y.w = t.w2 WHERE t.f >= 10
  UNION ALL
  SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f FROM three t
  JOIN one x ON x.lang = t.lang AND x.w = t.w JOIN two y ON y.lang = t.lang AND y.w = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f FROM three t
  JOIN two x ON x.lang = t.lang AND x.w = t.w AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w = t.w3
),
scores AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS m FROM (SELECT lang, w || ' ' || w2 AS phrase, f FROM three UNION ALL SELECT lang, w2 || ' ' || w3, f FROM three) GROUP BY ALL
),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g ON b.lang = g.lang AND b.phrase = g.phrase WHERE m IS NULL OR 100 * m < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
