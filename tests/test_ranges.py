"""Ranges: of files, and of chunk indexes."""

import hashlib
import os
import random
import time

import pytest

from tallyport.operators import images, intervals
from tallyport.plans import load, registry  # noqa: F401
from tallyport.sources import ranges
from tallyport.sources.files import scan_files


def test_listing_has_empty_files_and_odd_names(spark, tmp_path):
    names = {"a b.bin": b"x" * 10, "sub/100%25 é.bin": b"y" * 5000, "empty": b"", "sub/deep/none.bin": b""}
    for name, data in names.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.split(f"{tmp_path}/")[1]: (r.size_bytes, r.modified_at is None) for r in ranges.list_files(spark, str(tmp_path)).collect()}
    assert got == {n: (len(d), not d) for n, d in names.items()}
    digests = {r.path.split(f"{tmp_path}/")[1]: r.sha256 for r in scan_files(spark, f"file://{tmp_path}").collect()}
    assert digests == {n: hashlib.sha256(d).hexdigest() for n, d in names.items()}
    files = ranges.list_files(spark, str(tmp_path), "*.bin")
    parts = sorted((os.path.basename(r.path), r.chunk_index, r.start_byte, bytes(r.body)) for r in ranges.file_ranges(files, 1800).collect())
    assert parts == [("100%25 é.bin", 0, 0, b"y" * 1800), ("100%25 é.bin", 1, 1800, b"y" * 1800), ("100%25 é.bin", 2, 3600, b"y" * 1400), ("a b.bin", 0, 0, b"x" * 10), ("none.bin", 0, 0, b"")]


def test_names_of_file_systems():
    assert all(ranges.openable(p) for p in ("/a/b", "file:/a/b", "file:///a", "hdfs://n:1/a", "s3a://b/a")) and not ranges.openable("viewfs://x/a")


def test_blocks_are_fetched_once(tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(256)) * 100)
    with ranges.opened(str(tmp_path / "f")) as file:
        part = ranges.Ranges(file, 1000, 3)
        assert part(10, 5) == bytes(range(10, 15)) and part(998, 4) == (bytes(range(256)) * 100)[998:1002] and part(25_590, 100) == bytes(range(246, 256)) and part(30_000, 5) == b"" == part(5, 0)
        assert part.fetched == 1000 + 1000 + 600
        part(0, 1)
        assert part.fetched == 2600


def written(path, data, at=0, size=None):
    with open(path, "wb") as f:
        f.write(data[:16])
        f.seek(16 + at)
        f.write(data[16:])
        if size:
            f.truncate(size)


def test_tiffs_of_any_size_are_probed_by_ranges(spark, tmp_path):
    """Directories beyond 4 GiB of a sparse file; pixels are never read."""
    written(tmp_path / "small.tif", images.made(640, 480, [8, 8, 8], copies=2, tiled=True))
    written(tmp_path / "wide.tif", images.made(70_000, 9, [16], ">", copies=1), size=3 << 30)
    far = 5 << 30
    moved = bytearray(images.made(50_000, 40_000, [16] * 5, "<", True))
    moved[8:16] = (16 + far).to_bytes(8, "little")
    place = moved.index((258).to_bytes(2, "little"), 16)
    old = int.from_bytes(moved[place + 12 : place + 20], "little")
    moved[place + 12 : place + 20] = (old + far).to_bytes(8, "little")
    written(tmp_path / "far.tif", bytes(moved), at=far)
    (tmp_path / "none.tif").write_bytes(b"")
    (tmp_path / "text.tif").write_bytes(b"no image at all, but some text")
    many = bytearray(images.made(1, 1, [8], "<", True))
    many[16:24] = (1 << 40).to_bytes(8, "little")
    (tmp_path / "many.tif").write_bytes(bytes(many))
    rows = images.probe_files(ranges.list_files(spark, str(tmp_path), "*.tif")).collect()
    got = sorted((os.path.basename(r.path), r.directory, r.width, r.height, r.bits, r.tiled, r.error) for r in rows)
    assert got == [
        ("far.tif", 0, 50_000, 40_000, 16, False, None), ("many.tif", 0, None, None, None, None, "entries"), ("none.tif", 0, None, None, None, None, "header"), ("small.tif", 0, 640, 480, 8, True, None),
        ("small.tif", 1, 640, 480, 8, True, None), ("text.tif", 0, None, None, None, None, "header"), ("wide.tif", 0, 70_000, 9, 16, False, None),
    ]
    assert all(r.fetched < 64 << 10 for r in rows)


def plain_union(rows):
    out = {}
    for key in {k for k, _, _ in rows}:
        for a, b in sorted((a, b) for k, a, b in rows if k == key and a is not None and b is not None and a <= b):
            ends = out.setdefault(key, [])
            if ends and a <= ends[-1][1] + 1:
                ends[-1][1] = max(ends[-1][1], b)
            else:
                ends.append([a, b])
    return sorted((k, *e) for k, es in out.items() for e in es)


@pytest.mark.parametrize("rows_at_once", [50, 200_000])
def test_premerged_ranges_have_the_same_union(spark, rows_at_once, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice("abé"), a, a + rng.randrange(-2, 9)) for a in (rng.randrange(-50, 3000) for _ in range(4000))] + [("hot", k // 3, k // 3 + 1) for k in range(6000)] + [("none", 5, 4), ("null", None, 3), ("null", 3, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "record_id string, start_index long, end_index long").repartition(3)
    assert sorted(tuple(r) for r in intervals.merge_ranges(df).select("record_id", "start_index", "end_index").collect()) == plain_union(rows)
    assert intervals.premerged(df).count() < df.count() / 3 and intervals.premerged(df.filter("false")).count() == 0
    import pyarrow as pa

    keys, first, last = intervals._united(pa.array([r[0] for r in rows if None not in r and r[1] <= r[2]]), *(__import__("numpy").array([r[k] for r in rows if None not in r and r[1] <= r[2]]) for k in (1, 2)))
    assert sorted(zip(keys.to_pylist(), first.tolist(), last.tolist())) == plain_union(rows)


def test_membership_of_a_record_with_many_ranges(spark):
    ranges_ = spark.range(100_000).selectExpr("'r' AS record_id", "id * 10 AS start_index", "id * 10 + 3 AS end_index").union(spark.sql("SELECT 'r', 500000L, 500005L UNION ALL SELECT 's', 9L, 2L UNION ALL SELECT 's', 20L, 30L UNION ALL SELECT 's', 21L, 22L"))
    asked = spark.range(0, 1_000_000, 7).selectExpr("'r' AS record_id", "id AS chunk_index").union(spark.sql("SELECT 's', explode(sequence(0L, 40L)) UNION ALL SELECT 'none', 1L"))
    began = time.time()
    got = registry.run("range_membership", spark, ranges=ranges_, asked=asked)
    rows = {(r.record_id, r.chunk_index): r.completed for r in got.collect()}
    assert time.time() - began < 60
    assert all(done == (k % 10 <= 3 or 500_000 <= k <= 500_005) for (r, k), done in rows.items() if r == "r") and len(rows) == 142_858 + 42
    assert {k for (r, k), done in rows.items() if r == "s" and done} == set(range(20, 31)) and rows["none", 1] is False


def test_plan_limits_equal_a_walk_over_the_chunks(spark):
    rng = random.Random(6)
    plans = [(k, t := rng.choice([0, 1, 99, 100, 101, 250, 999]), c := rng.choice([10, 100, 400]), -(-t // c)) for k in range(60)]
    limits = [("a", 3, 20, None, 300), ("b", 100, 50, 60, 90), ("c", 100, None, None, None)]
    want = []
    for k, total, size, n in plans:
        for name, most, least, final, top in limits:
            sizes = [min(size, total - i * size) for i in range(n)]
            bad = [(-1, "count")] if n > most else []
            for i, x in enumerate(sizes):
                low = final if i == n - 1 and final is not None else least
                bad += [(i, "small")] if low is not None and x < low else [(i, "large")] if top is not None and x > top else []
            want += [(k, name, bad[0][1], bad[0][0])] if bad else []
    manifests = spark.createDataFrame(plans, "manifest_id long, total_bytes long, chunk_size long, total_chunks long")
    capabilities = spark.createDataFrame(limits, "name string, max_chunks long, min_chunk long, min_final long, max_chunk long")
    assert sorted(tuple(r) for r in registry.run("plan_limits", spark, manifests=manifests, capabilities=capabilities).collect()) == sorted(want)
