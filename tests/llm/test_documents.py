"""Packing (5), decontamination (6) and near-duplicates (7) against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyport.llm import _text, op5_packing, op6_decontamination, op7_near_dedup
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_match_a_regular_expression():
    import pyarrow as pa

    texts = [t for _, t in ODD]
    data, bounds = _text.raw(pa.array(texts))
    starts, ends, hashes, at = _text.words(data, bounds, lower=False)
    for k, t in enumerate(texts):
        assert [bytes(data[a:b]).decode() for a, b in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]])] == WORD.findall(t or "")
    alone = _text.words(*_text.raw(pa.array([texts[4]])), lower=False)[2]
    assert (alone == hashes[at[4] : at[5]]).all()


@pytest.mark.parametrize("window", [4, 16, 63])
def test_best_fit_is_the_tightest(window):
    rng = random.Random(window)
    for _ in range(60):
        lengths = [rng.randint(1, 3 * window) for _ in range(rng.randint(0, 50))]
        pieces, used = op5_packing.best_fit(lengths, window)
        rooms = []
        for need in sorted((n % window for n in lengths if n % window), reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= need]
            k = min(fits, key=lambda k: (rooms[k], k), default=None)
            if k is None:
                rooms.append(window - need)
            else:
                rooms[k] -= need
        assert used == len(rooms) + sum(n // window for n in lengths)
        spans = {}
        for doc, start, length, sequence, offset in pieces:
            spans.setdefault(sequence, []).append((offset, length))
        for parts in spans.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= window


def packed(spark, df, **options):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(op5_packing.vocabulary_path())
    pieces = op5_packing.pack(df, **options).collect()
    got = {}
    for p in pieces:
        got.setdefault((p.doc_id, p.doc_tokens, p.sequence_id if p.start else None), []).append(p)
    whole = {}
    for p in sorted(pieces, key=lambda p: p.start):
        whole.setdefault(p.doc_id, []).append(np.frombuffer(p.ids, dtype="<u4").tolist())
    for i, t in {r.doc_id: r.text for r in df.collect()}.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        flat = [x for part in whole[i] for x in part]
        assert flat == ids * (len(flat) // len(ids))
    return pieces


def test_packing_of_odd_rows(spark, odd, empty):
    special = spark.createDataFrame([(50, "a <|endoftext|> b, don't I'LL x's"), (51, "Ünï_code ab́c. '' (x) İI ſ")], "doc_id long, text string")
    pieces = packed(spark, odd.select("doc_id", "text").unionByName(special), group_tokens=5000)
    assert sum(p.doc_id == 7 for p in pieces) == 2
    assert op5_packing.pack(empty).count() == 0


def test_packing_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    packed(spark, docs)
    rows = op5_packing.query(spark, data).collect()
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 4096 and sum(filled.values()) >= 0.97 * 4096 * len(filled)
    first = next(p for p in op5_packing.pack(docs).collect() if p.doc_id == rows[0].doc_id and p.start == rows[0].start)
    assert rows[0].ids_crc32 == zlib.crc32(first.ids)


def plain_score(a, b):
    best, table = 0, np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
            best = max(best, table[i, j])
    return best


def test_alignment():
    rng = random.Random(8)
    for _ in range(100):
        a, b = (np.array([rng.randint(0, 4) for _ in range(rng.randint(1, n))], dtype=np.uint64) for n in (9, 15))
        score, start, stop = op6_decontamination.located(a, b)
        assert score == plain_score(a, b) == plain_score(a, b[start:stop])


def test_leaks(spark, data, odd, empty):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in op6_decontamination.leaks(docs, items).collect()}
    texts, tests = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in tests.items() if x in t}
    assert whole <= found and len(found - whole) <= 2
    rng, edited = random.Random(4), []
    for k, text in tests.items():
        words = text.split()
        for at in rng.sample(range(len(words)), max(1, len(words) // 7)):
            words[at] = rng.choice(["", "other", words[at] + " added"])
        edited.append((k, "before " * 300 + " ".join(words).upper() + " after" * 300))
    got = {(r.doc_id, r.item_id) for r in op6_decontamination.leaks(spark.createDataFrame(edited, "doc_id long, text string"), items).collect()}
    assert {(k, k) for k in tests} <= got
    left = op6_decontamination.decontaminate(docs.withColumn("row", F.lit(1)), items)
    assert left.columns == [*docs.columns, "row"] and {r.doc_id for r in left.collect()} == set(texts) - {d for d, _ in found}
    assert op6_decontamination.leaks(odd, items).count() == 0 and op6_decontamination.leaks(empty, items).count() == 0
    assert op6_decontamination.decontaminate(odd, items.filter("false")).count() == odd.count()
    short = spark.createDataFrame([(1, None), (2, "one two"), (3, "")], "item_id long, text string")
    assert op6_decontamination.leaks(odd, short).count() == 0


def test_items_without_ids_and_shared_seeds(spark, monkeypatch):
    """Items that share all their words but a few, one without an id, in texts that hold them; in few entries at a time, too."""
    shared = "it is said by all that know the matter well and have seen the place with their own eyes".split()
    items = [(None if k == 3 else k, " ".join([f"name{chr(97 + k)}", *shared, f"town{chr(97 + k)}"])) for k in range(12)]
    texts = [(100 + k, " ".join([f"before{chr(97 + j)}" for j in range(20)] + [t] * (1 + k % 3))) for k, (_, t) in enumerate(items)] + [(200, "nothing of that"), (None, items[0][1])]
    docs, test = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    found = sorted(map(str, op6_decontamination.leaks(docs, test).collect()))
    words = [t.split() for _, t in texts]
    want = {(d, i) for (d, _), w in zip(texts, words) for i, t in items if plain_score(t.split(), w) >= 0.6 * 2 * len(t.split())}
    assert {(r.doc_id, r.item_id) for r in op6_decontamination.leaks(docs, test).collect()} == want and (103, None) in want
    import pyarrow as pa

    block = next(op6_decontamination.blocks(docs, test, "text"))
    whole = pa.array([t for _, t in texts])
    once = sorted(map(str, block.leaks(whole)))
    for most in (1, 7, 100):
        monkeypatch.setattr(op6_decontamination, "MOST_ENTRIES", most)
        assert sorted(map(str, block.leaks(whole))) == once
    assert len(once) == len(found)


def test_leaks_are_those_of_all_alignments(spark, data):
    """The query's leaks against Smith-Waterman of every item over whole texts."""
    docs, items = spark.read.parquet(f"{data}/documents.parquet").limit(60), spark.read.parquet(f"{data}/benchmark.parquet")
    cut = lambda t: [w for w in re.split(r"[^a-z\x80-\U0010ffff]+", t.lower()) if w]
    texts, tests = {r.doc_id: cut(r.text) for r in docs.collect()}, {r.item_id: cut(r.text) for r in items.collect()}
    got = {(r.doc_id, r.item_id): r.score for r in op6_decontamination.leaks(docs, items).collect()}
    numbers = {}
    coded = {k: np.array([numbers.setdefault(w, len(numbers)) for w in t], dtype=np.uint64) for k, t in [*texts.items(), *((("item", k), t) for k, t in tests.items())]}
    want = {}
    for d in texts:
        for i, t in tests.items():
            score = op6_decontamination.align(coded["item", i], coded[d])[0] / (2 * len(t))
            if score >= op6_decontamination.LEAST_SCORE:
                want[d, i] = score
    assert got == pytest.approx(want)


def test_leaks_with_long_insertions(spark):
    item = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    foreign = lambda n: [f"x{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
    around = lambda words: " ".join(foreign(200) + words + foreign(200))
    texts = {
        1: around(item[:30] + foreign(30) + item[30:]), 2: around(item[:20] + foreign(24) + item[20:40] + foreign(24) + item[40:]), 3: around(item[:30] + foreign(49) + item[30:]),
        4: around(item[:20] + item[36:]), 5: around(item[:30] + foreign(48) + item[30:]), 6: around(item[:30]),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in op6_decontamination.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert {k: round(r.score * 120) for k, r in got.items()} == {1: 90, 2: 72, 4: 72, 5: 72}
    assert (got[1].start, got[1].stop) == (200, 290)


def test_short_items_are_found_exactly(spark):
    items = {1: "Who wrote Faust?", 2: "12 + 7 * 45 = 327, 8", 3: "水の沸点は何度ですか。", 4: "น้ำเดือดที่กี่องศา", 5: "Wie heißt Größe?", 6: "who wrote", 7: "Who wrote Faust, part two?", 8: "who  WROTE faust"}
    texts = {
        10: "x. who wrote FAUST? y", 11: "so 12 + 7 * 45 = 327, 8.", 12: "質問:水の沸点は何度ですか。答え", 13: "ถามน้ำเดือดที่กี่องศาตอบ", 14: "a wie HEIẞT größe b", 15: "who wrote fausty", 16: "12 + 7 * 45 = 327, 9", 17: "水の沸点は何",
        18: "xwho wrote faust", 19: "Who wrote", 20: "faust", 21: None, 22: "", 23: "WIE HEISST GRÖSSE", 24: "Who wrote Faust, part two? Who wrote Faust?", 25: "wie heißt größe",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    test = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = op6_decontamination.leaks(docs, test).collect()
    want = {(10, 1), (10, 8), (11, 2), (12, 3), (13, 4), (14, 5), (24, 1), (24, 7), (24, 8), (25, 5)}
    assert len(rows) == len(want) and {(r.doc_id, r.item_id) for r in rows} == want and {r.score for r in rows} == {1.0}
    assert [(r.start, r.stop) for r in rows if (r.doc_id, r.item_id) == (10, 1)] == [(1, 4)]
    both = test.unionByName(spark.createDataFrame([(9, "one two three four five six seven eight nine ten eleven")], test.schema))
    assert len(op6_decontamination.leaks(docs, both).collect()) == len(want)
    assert {r.doc_id for r in op6_decontamination.decontaminate(docs, both).collect()} == set(texts) - {d for d, _ in want}


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows, percent=85):
    """Smallest id reachable from each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def family(rng, n, first, edits):
    words = [rng.choice("abcdefgh") + rng.choice("ijklm") + str(rng.randint(0, 40)) for _ in range(150)]
    out = []
    for k in range(n):
        copy = list(words)
        for at in rng.sample(range(len(copy)), rng.randint(0, edits)):
            copy[at] = f"w{rng.randint(0, 5)}"
        out.append((first + k, " ".join(copy)))
    return out


def near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op7_near_dedup.near_duplicates(df).collect())


def test_near_duplicates(spark):
    rng = random.Random(6)
    rows = family(rng, 60, 100, 8) + family(rng, 25, 10, 3) + family(rng, 5, 400, 30) + [(i, t) for i, t in ODD] + [(900 + k, "same text as all the others here") for k in range(40)]
    assert near(spark, rows) == plain_components(rows)


def test_near_duplicates_without_ids(spark):
    word = lambda k, n: [f"w{k}x{j}" for j in range(n)]
    chain = [" ".join(["edited"] * k + word(1, 150)[k:]) for k in (0, 9, 18)]  # neighbours are near, the ends are not
    alone = [" ".join(["edited"] * k + word(2, 150)[k:]) for k in (0, 3, 6)]
    rows = [(1, chain[0]), (None, chain[1]), (2, chain[2]), *((None, t) for t in alone), (None, alone[0]), (None, " ".join(word(3, 50)))]
    assert near(spark, rows) == plain_components(rows)
    assert {r[2] for r in near(spark, rows) if r[0] == "2"} == {"1"}
    left = op7_near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(left) == 3 and sum(r.text in alone for r in left) == 1


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(op7_near_dedup, "BLOCK", 7)
    monkeypatch.setattr(op7_near_dedup, "BLOCK_BYTES", 9000)
    rows = family(random.Random(16), 90, 0, 7)
    assert near(spark, rows) == plain_components(rows)


def test_deduplicate(spark, odd, empty):
    left = op7_near_dedup.deduplicate(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "3", "4", "5", "6", "None", "8", "9", "10", "11", "12"])
    assert op7_near_dedup.deduplicate(empty).count() == 0 and op7_near_dedup.near_duplicates(empty).count() == 0


def test_deduplicate_at_80_per_cent(spark):
    rng, rows = random.Random(80), []
    for k in range(40):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(150)]
        rows.append((2 * k, " ".join(words)))
        for at in range(20, 140, 120 // (1 + k % 5)):
            words[at] = "edited"
        rows.append((2 * k + 1, " ".join(words)))
    want = {p: sorted(int(i) for i, _, least in plain_components(rows, p) if i == least) for p in (80, 85)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert want[80] != want[85]
    for percent, kept in want.items():
        assert sorted(r.doc_id for r in op7_near_dedup.deduplicate(df, percent=percent).collect()) == kept
    assert op7_near_dedup.margin(85) == op7_near_dedup.MARGIN and 0.158 < op7_near_dedup.margin(80) < 0.16


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.5, 0.85, 0.95):
        for _ in range(40):
            n = 400
            common = int(round(2 * n * share / (1 + share)))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n : 2 * n - common])))
            low = op7_near_dedup.packed(op7_near_dedup.minima(np.concatenate((a, b)), np.array([0, n, 2 * n])))
            errors.append(op7_near_dedup.estimate((low[0] == low[1]).mean()) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < op7_near_dedup.MARGIN


@pytest.mark.parametrize("edits", [1, 7, 40])
def test_large_groups_are_compared_with_one_member_first(spark, monkeypatch, edits):
    """Members near the least node, and some that are only near others."""
    monkeypatch.setattr(op7_near_dedup, "BLOCK", 5)
    monkeypatch.setattr(op7_near_dedup, "BLOCK_BYTES", 4000)
    rng = random.Random(edits)
    rows = family(rng, 60, 0, edits) + family(rng, 30, 500, 4)
    words = rows[0][1].split()
    for k in range(12):  # a chain away from the first text
        words[9 * k : 9 * k + 9] = [f"step{k}x{j}" for j in range(9)]
        rows.append((900 + k, " ".join(words)))
    assert near(spark, rows) == plain_components(rows)


@pytest.mark.parametrize("hubs", [0, 2, 12])
def test_hubs_of_a_large_group_lose_no_link(spark, monkeypatch, hubs):
    """Ties of one large group of sets, in clusters that lie near and far and are linked by single members, against all pairs."""
    monkeypatch.setattr(op7_near_dedup, "HUBS", hubs)
    rng = np.random.default_rng(12)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        step = int(rng.integers(3, 12))
        for k in range(16):  # chains: each is near the one before, and soon not near the first
            base = base.copy()
            base[rng.integers(0, 100, step)] = rng.integers(0, 1 << 63, step, dtype=np.uint64)
            sets.append(np.sort(base))
    alike = op7_near_dedup.like_sets(85)
    rows = [("g", bytes([k // 256, k % 256]), bytearray(s.tobytes()), 800 * len(sets)) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "family string, node binary, shingles binary, bytes long").repartition(4)
    ties = op7_near_dedup._grouped(df, "family", "shingles", "bytes", 9600, F.octet_length("value"), alike, True).collect()

    def roots(pairs):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return [find(x) for x in root]

    number = lambda node: node[0] * 256 + node[1]
    every = [(a, b) for a in range(len(sets)) for b in range(a) if alike.pair(sets[a].tobytes(), sets[b].tobytes())[0]]
    assert 8 < len(set(roots(every))) < 100
    assert roots((number(r.a), number(r.b)) for r in ties) == roots(every)


@pytest.mark.parametrize("percent", [80, 85])
def test_what_a_hub_and_a_third_are_tied_to_is_close(percent):
    """The triangle inequality on which hubs rest, for sets and signatures."""
    rng = np.random.default_rng(percent)
    for alike, make in ((op7_near_dedup.like_sets(percent), lambda x: np.sort(x).tobytes()), (op7_near_dedup.like_signatures(0.7), lambda x: (x % 256).astype(np.uint8).tobytes())):
        seen = 0
        for _ in range(3000):
            hub = rng.integers(0, 1 << 62, 160, dtype=np.uint64)
            middle, other = hub.copy(), None
            a, b = rng.integers(0, 40, 2)
            middle[rng.permutation(160)[:a]] = rng.integers(0, 1 << 62, a, dtype=np.uint64)
            other = middle.copy()
            other[rng.permutation(160)[:b]] = rng.integers(0, 1 << 62, b, dtype=np.uint64)
            h, m, o = make(hub), make(middle), make(other)
            if alike.pair(h, m)[0] and alike.pair(m, o)[0]:
                assert alike.pair(h, o)[1]
                seen += not alike.pair(h, o)[0]
        assert seen > 50
