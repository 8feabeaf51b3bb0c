"""Spelling variants (11), top-k search (12) and collocations (13): oracles, plain versions, and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyport.llm import op11_spelling, op12_topk, op13_collocations
from tests.oracle import same

MODULES = [op11_spelling, op12_topk, op13_collocations]


@pytest.mark.parametrize("module", MODULES)
def test_oracle(spark, data, module):
    same(spark, data, module.query, module.ORACLE_SQL)


def edits(word, letters):
    yield from (word[:i] + word[i + 1 :] for i in range(len(word)))
    yield from (word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters)
    yield from (word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters)


def plain_variants(counts):
    letters = sorted({c for w in counts for c in w})
    near = {w: {x for x in edits(w, letters) if x != w and x in counts} for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b and counts[b] >= 10 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def words_of(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_all_edits(spark):
    """Words that are near in every way, accents, anagrams of one another, and long chains of forms."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abÉé") for _ in range(rng.randrange(7, 10))) for _ in range(500)}
    counts = {w: rng.choice([2, 3, 30, 400, 5000, 70000, 10**6, 10**12]) for w in words}
    counts |= {"hahahaha" * 40 + tail: 2 for tail in ("", "h", "ha", "ah", "b")} | {"z" * 7 + "qrstuv"[:k]: 10**k * 2 for k in range(6)}
    got = found(op11_spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)))
    assert got == plain_variants(counts)
    assert got["zzzzzzz"][:2] == ("zzzzzzzq", "zzzzzzzqrstu") and any(form and root != form for form, root, *_ in got.values())


def test_variants_of_texts(spark, odd, empty):
    docs = [(k, f"Straße STRASSE information informaton informatiom, naïveté_naivete×naïvetés {'information ' * 9}") for k in range(80)]
    docs += [(None, "information nullnull nullnull"), (-5, None), (6, ""), (7, "Übungen übungen x" + "y" * 3000)] * 2
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, n int, word string")
    assert found(op11_spelling.spelling_variants(df)) == plain_variants(words_of(docs))
    got = found(op11_spelling.spelling_variants(odd))
    assert set(got) == set(words_of([(r.doc_id, r.text) for r in odd.collect()]))
    assert op11_spelling.spelling_variants(empty).count() == 0


def plain_top(vectors, queries, k):
    out = []
    for i, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "few", "ties", "large", "huge"])
def test_threshold_search_equals_all_scores(kind):
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, (3000, 6))
    if kind == "few":
        x[:, 2:] = 0
    if kind == "ties":
        x = rng.integers(-1, 2, (3000, 6))
    if kind == "large":
        x *= 10**6
    if kind == "huge":
        x = x[:200] * (1 << 53)
    ids = rng.permutation(len(x)) - 50
    q_rows = rng.choice(len(x), 40, replace=False)
    got = op12_topk.threshold_search(x, ids, x[q_rows], ids[q_rows], 5)
    want = plain_top([(int(i), list(map(int, v))) for i, v in zip(ids, x)], [(int(ids[r]), list(map(int, x[r]))) for r in q_rows], 5)
    assert sorted((int(ids[r]), k + 1, int(j), int(s)) for r, (best, _) in zip(q_rows, got) for k, (s, j) in enumerate(zip(best.scores, best.ids))) == want
    if kind == "few":
        assert np.mean([n for _, n in got]) < len(x) / 2  # most of the lists are left alone


def test_threshold_search_with_nothing():
    none = np.zeros((0, 4), dtype=np.int64)
    best, n = op12_topk.threshold_search(none, none[:, 0], np.ones((1, 4), dtype=np.int64), np.array([3]))[0]
    assert len(best.ids) == 0 and n == 0
    zero = op12_topk.threshold_search(np.zeros((4, 0), dtype=np.int64), np.arange(4), np.zeros((1, 0), dtype=np.int64), np.array([0]))[0][0]
    assert list(zero.ids) == [1, 2, 3] and set(zero.scores) == {0}


def test_search_in_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op12_topk, "QUERIES", 7)
    monkeypatch.setattr(op12_topk, "BLOCK", 90)
    rng = np.random.default_rng(11)
    rows = [(int(i), [int(v) for v in rng.integers(-4, 5, 3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, ints array<long>").repartition(5)
    got = op12_topk.search(df, df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 4)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == plain_top(rows, [r for r in rows if r[0] % 20 == 0], 4)


def test_odd_vectors(spark, folder):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (50, [0.001, -0.001]), (50, [9.0, 9.0]), (1, [1.0, nan]), (2, [1.0, None]), (3, None), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [2.0, 2.0]), (5, [2.0, 2.0]), (6, [-1.0, 0.25]),
            (100, [1.0]), (7, [3.0]), (150, []), (-50, [0.0, 0.0]), (200, None), (8, [1e30, 0.0])]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = {}
    for r in op12_topk.query(spark, folder(embeddings=df)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    largest = (1 << 63) - 1
    assert sorted(got[0]) == [(1, 8, largest), (2, 50, 256 * 2304 - 128 * 2304), (3, 5, 512 * 128), (4, 5, 512 * 128), (5, 50, 128)]
    assert sorted(got[100]) == [(1, 7, 768 * 256)] and 150 not in got and 200 not in got
    assert [v for _, v, _ in sorted(got[-50])] == [0, 5, 5, 6, 8] and {s for *_, s in got[-50]} == {0}
    assert all(v != 50 for _, v, _ in got[50]) and sorted(got[50])[0][1] == 0  # its smallest vector asks: (0, -1)
    (empty := df.filter("false")).count()
    assert op12_topk.search(*(empty.select(F.col("vec_id").alias(n), op12_topk.integers(F.col("embedding")).alias("ints")) for n in ("vec_id", "query_id"))).count() == 0


def plain_phrases(docs, least=10, covered=50, top=2000):
    f = defaultdict(Counter)
    for text, lang in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                f[lang if lang is not None else "und"].update(tuple(ws[k : k + size]) for k in range(len(ws) - size + 1))
    out = []
    for lang, c in f.items():
        rows, n = [], sum(v for p, v in c.items() if len(p) == 1)
        for p, a in c.items():
            if len(p) > 1 and a >= least and not any(v >= least and 100 * v >= covered * a for x, v in c.items() if len(x) > len(p) and p in (x[:2], x[1:])):
                score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def phrases_found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("bits", [26, 16])
def test_collocations_equal_plain_counts(spark, bits):
    """Small shards; a filter of few bits lets rare phrases through, and the rows are the same."""
    rng = random.Random(2)
    vocabulary = ["New", "york", "YORK", "city", "é", "Éa", "a", "the", "x\x00y", "#", "ha", " ", "😀"]
    docs = [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "", ","]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    docs += [("ha ha ha ha ha ha ha ha", "en")] * 9 + [("at the end of the day. ", "en")] * 31 + [("at the end", "en")] * 40 + [("at the end", "de")] * 9 + [(None, None), ("", "en"), (" \t.", "fr")]
    df = spark.createDataFrame([(*d, "p", 2) for d in docs], "text string, lang string, phrase string, n int").repartition(4)
    want = plain_phrases(docs)
    assert phrases_found(op13_collocations.collocations(df, n_bits=1 << bits, shard=300)) == want and {"und", "en", ""} <= {w[0] for w in want}
    assert phrases_found(op13_collocations.collocations(df, top=3, least=4, covered=80)) == plain_phrases(docs, 4, 80, 3)


def test_collocations_of_odd_rows(spark, odd, empty):
    rows = odd.withColumn("lang", F.lit(None).cast("string"))
    assert phrases_found(op13_collocations.collocations(rows)) == plain_phrases([(r.text, None) for r in rows.collect()])
    assert op13_collocations.collocations(empty.withColumn("lang", F.lit("en"))).count() == 0


def test_batches_of_first_words_make_no_difference():
    import pyarrow as pa

    rng = random.Random(4)
    text = pa.array(["".join(rng.choice("abcd") + rng.choice("   .") for _ in range(400)), None, "a b c"])
    shard, all_bits = op13_collocations.Shard(text, pa.array(["en", "de", "en"])), np.full(1 << 12, 255, dtype=np.uint8)
    for size in (2, 3):
        sums = []
        for batch in (10**6, 7):
            total = Counter()
            for langs, phrases, n in shard.phrases(size, all_bits, all_bits, batch):
                for key, count in zip(zip(langs.to_pylist(), phrases.to_pylist()), n.tolist()):
                    total[key] += count
            sums.append(total)
        want = Counter()
        for lang, t in zip(["en", "de", "en"], text.to_pylist()):
            for piece in (t or "").split("."):
                ws = piece.split()
                want.update((lang, " ".join(ws[k : k + size])) for k in range(len(ws) - size + 1))
        assert sums[0] == sums[1] == want


def test_filter_bits_let_all_frequent_phrases_through(spark):
    rows = [("en", w) for w in ("the", "house", "the house", "x y")] + [("fr", "le")]
    bits = op13_collocations._filter(spark.createDataFrame(rows, "lang string, phrase string"), 1 << 20)
    assert int(np.unpackbits(bits).sum()) == len(rows)
