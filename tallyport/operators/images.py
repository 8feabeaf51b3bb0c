"""TIFF files: the header by expressions, directories by a small reader over Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.plans.registry import _ORACLES, QUERIES, frame, operator, oracle
from tallyport.sources.ranges import Ranges, opened

MAX_DIRECTORIES, SAFE = 256, (1 << 53) - 1
#: Entries of a directory at most, as many as a classic file can have.
MAX_ENTRIES = 65535
PROBE = "image_id long, directory long, width long, height long, bits long, tiled boolean, error string"
PROBE_FILES = PROBE.replace("image_id long", "path string") + ", fetched long"
#: Sizes of the field types that hold whole numbers: byte, short, long, long8.
_NUMBERS = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
_WIDTH, _HEIGHT, _BITS, _TILE = 256, 257, 258, 322


@operator("tiff_header", bind={"images": "tiff_headers"})
def tiff_header(d):
    """Byte order, kind and place of the first directory; null where the header is none."""
    number = (lambda x: f"CAST(conv({x}, 16, 10) AS BIGINT)") if d.name == "spark" else (lambda x: f"CAST(concat('0x', {x}) AS BIGINT)")
    swap = lambda at, n: "concat(" + ", ".join(f"substring(head, {at + 2 * k}, 2)" for k in reversed(range(n))) + ")"
    plain = lambda at, n: f"substring(head, {at}, {2 * n})"
    of = lambda at, n: number(f"CASE WHEN substring(head, 1, 4) = '4949' THEN {swap(at, n)} ELSE {plain(at, n)} END")
    return f"""SELECT image_id, CASE WHEN known THEN CASE WHEN substring(head, 1, 4) = '4949' THEN 'II' ELSE 'MM' END END AS byte_order, CASE WHEN known THEN CASE magic WHEN 42 THEN 'tiff' WHEN 43 THEN 'bigtiff' END END AS kind,
    CASE WHEN known THEN CASE WHEN magic = 42 THEN first32 ELSE first64 END END AS first_directory FROM (SELECT *, substring(head, 1, 4) IN ('4949', '4d4d') AND (magic = 42 OR magic = 43 AND offset_bytes = 8) AS known FROM (SELECT image_id, head, {of(5, 2)} AS magic, {of(9, 2)} AS offset_bytes, {of(9, 4)} AS first32, {of(17, 8).replace('BIGINT', 'BIGINT')} AS first64
    FROM (SELECT image_id, CASE WHEN substring(head, 17, 2) = 'ff' THEN concat(substring(head, 1, 16), '0000000000000000') WHEN substring(head, 1, 4) NOT IN ('4949', '4d4d') THEN concat(substring(head, 1, 4), '0000000000000000000000000000') ELSE head END AS head FROM {{images}}) h) t) u"""


def directories(data: bytes | Callable[[int, int], bytes]) -> Iterator[dict]:
    """Directories of one TIFF, given whole or as a function of place and size; raises ``ValueError`` where the file is not one.

    Only the header, the directories and the values that they point to are read.
    """
    read = data if callable(data) else lambda at, n: data[at : at + n]
    first = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(first[:2])
    if order is None or len(first) < 8:
        raise ValueError("header")

    def get(form: str, at: int) -> tuple:
        return struct.unpack(order + form, read(at, struct.calcsize(order + form)))

    magic = struct.unpack_from(order + "H", first, 2)[0]
    if magic == 42:
        count_form, entry, field, at = "H", 12, "I", struct.unpack_from(order + "I", first, 4)[0]
    elif magic == 43 and len(first) >= 16 and struct.unpack_from(order + "HH", first, 4) == (8, 0):
        count_form, entry, field, at = "Q", 20, "Q", struct.unpack_from(order + "Q", first, 8)[0]
    else:
        raise ValueError("header")
    inline = struct.calcsize(field)
    for _ in range(MAX_DIRECTORIES):
        if not at:
            return
        if at > SAFE:
            raise ValueError("offset")
        try:
            n = get(count_form, at)[0]
            if n > MAX_ENTRIES:
                raise ValueError("entries")
            at += struct.calcsize(count_form)
            found: dict[int, list[int]] = {}
            for k in range(n):
                place = at + k * entry
                tag, kind, values = get("HH" + field, place)
                if kind in _NUMBERS and values and tag in (_WIDTH, _HEIGHT, _BITS, _TILE):
                    form, size = _NUMBERS[kind]
                    start = place + 4 + inline
                    if size * values > inline:
                        start = get(field, start)[0]
                    if start > SAFE:
                        raise ValueError("offset")
                    found[tag] = list(get(f"{min(values, 64)}{form}", start))
            at = get(field, at + n * entry)[0]
        except struct.error:
            raise ValueError("truncated") from None
        if _WIDTH not in found or _HEIGHT not in found or not found[_WIDTH][0] or not found[_HEIGHT][0]:
            raise ValueError("dimensions")
        yield {"width": found[_WIDTH][0], "height": found[_HEIGHT][0], "bits": max(found.get(_BITS, [1])), "tiled": _TILE in found}
    raise ValueError("directories")


def _rows(image: object, data: bytes | Callable[[int, int], bytes]) -> list[tuple]:
    """A row for each directory, and one with the error that ended them, if one did."""
    rows = []
    try:
        for x in directories(data):
            rows.append((image, len(rows), x["width"], x["height"], x["bits"], x["tiled"], None))
    except ValueError as error:
        rows.append((image, len(rows), None, None, None, None, str(error)))
    return rows


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def probe(images: DataFrame) -> DataFrame:
    """A row for each directory of each image (``image_id, content``), or one with the error that ended it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for image, content in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in _rows(image, content or b"")]
            if rows:
                yield _batch(rows, PROBE)

    return images.select("image_id", "content").mapInArrow(run, PROBE)


def probe_files(files: DataFrame) -> DataFrame:
    """The same of files by ``path``, of any size: a task fetches blocks of 4 KiB around the header, the directories and what they point to; ``fetched`` is how many bytes that were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path) as file:
                    ranges = Ranges(file)
                    rows = _rows(path, ranges)
                if rows:
                    yield _batch([(*r, ranges.fetched) for r in rows], PROBE_FILES)

    return files.select("path").mapInArrow(run, PROBE_FILES)


def made(width: int, height: int, bits: list[int], order: str = "<", big: bool = False, copies: int = 1, tiled: bool = False) -> bytes:
    """A TIFF without pixels, for tests and for the query."""
    field, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    out = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    for k in range(copies):
        tags = [(_WIDTH, 4, [width]), (_HEIGHT, 4, [height]), (_BITS, 3, bits)] + ([(_TILE, 3, [256])] if tiled else [])
        start = len(out)
        extra = start + struct.calcsize(count) + len(tags) * entry + struct.calcsize(field)
        body, tail = struct.pack(order + count, len(tags)), b""
        for tag, kind, values in tags:
            form, _ = _NUMBERS[kind]
            packed = struct.pack(f"{order}{len(values)}{form}", *values)
            if len(packed) > struct.calcsize(field):
                body += struct.pack(order + "HH" + field * 2, tag, kind, len(values), extra + len(tail))
                tail += packed
            else:
                body += struct.pack(order + "HH" + field, tag, kind, len(values)) + packed.ljust(struct.calcsize(field), b"\0")
        out += body + struct.pack(order + field, extra + len(tail) if k + 1 < copies else 0) + tail
    return out


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images made from the parts: their sizes, in both byte orders and kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bits = batch.column("image_id").to_pylist(), batch.column("bits").to_pylist()
            files = [made(100 + i, 50 + i, [b] * 3, "<>"[i % 2], i % 3 == 0, 1 + i % 3, i % 5 == 0)[: 10 if i % 11 == 0 else None] for i, b in zip(ids, bits, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(files, type=pa.binary())], names=["image_id", "content"])

    made_from = frame(spark, sf_dir, "samples").select(F.col("image_id").cast("long"), F.col("bits").cast("long"))
    return probe(made_from.mapInArrow(run, "image_id long, content binary"))


QUERIES["tiff_probe"] = _query
#: What the images were made with: every eleventh is cut off within its header or first directory.
_ORACLES["tiff_probe"] = lambda: oracle(
    """SELECT image_id, k AS directory, 100 + image_id AS width, 50 + image_id AS height, CAST(bits AS BIGINT) AS bits, image_id % 5 = 0 AS tiled, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT image_id, bits, unnest(range(1 + image_id % 3)) AS k FROM {samples} WHERE image_id % 11 <> 0) t UNION ALL
    SELECT image_id, 0, NULL, NULL, NULL, NULL, CASE WHEN image_id % 3 = 0 THEN 'header' ELSE 'truncated' END FROM {samples} WHERE image_id % 11 = 0""", {}
)
