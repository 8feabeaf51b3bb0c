"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1.  A document's set is its distinct 5-word shingles.  One pass gives each set's 128-bit digest, its minima under
    ``BANDS * ROWS`` permutations, of which the low 8 bits (after mixing) are packed into a signature, and a key per band.
2.  Equal sets become one node, whatever their number.  Nodes that share a band key are candidates.  Similarity is estimated
    from equal bytes of the signatures, corrected for the chance that bytes collide; candidates at ``ESTIMATE`` or more
    are tied into families.  A family contains whole components: the margin below the threshold is five standard errors.
3.  In each family, links are confirmed on the full sets, made anew from the texts of one document per node.

Neither stage lists pairs.  A bucket or family is walked breadth first: a member is compared, in numpy, with those not yet
reached, and only the tie between a member and its root is emitted.  Of buckets and families beyond a block, all members are
compared with one of them, their hub, in as many tasks as there are blocks.  Both distances (unequal bytes, and one less the
similarity of sets) obey the triangle inequality: what is further from the hub than twice the reach of a tie cannot be tied to
what the hub is tied to.  So only members within that meet the hub's own, block by block, and all that are not tied to it go on to
another hub of theirs; what is left after ``HUBS`` hubs is compared block by block.  No link is lost, no group is
unbounded, and copies of one text cost as much as they are many.  The ties are then contracted (:mod:`._components`).  A
pair at the threshold of 85 % shares no band with a probability of 7e-9, one at 80 % with 3e-6.

Edge cases: a text without words, or null, has an empty set, is linked with nothing and is kept; fewer than five words
are one shingle; rows that repeat an id are nodes by their sets, and have one component each; ties go to the smallest
document id; rows without an id are linked like others, and a component of such rows alone has no id; an empty table gives an empty result; other columns pass through :func:`deduplicate` in a struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyport.llm import _components, _session, _text

NAME = "op7_near_dedup"
ORACLE_SQL = None

#: Similarity in per cent at which documents are linked by the contract; bands, and rows of each.
PERCENT, BANDS, ROWS = 85, 32, 5
#: How far below the contract's threshold an estimate may be for a pair to be looked at: five standard errors of the estimate.
MARGIN = 0.145
#: Members of a bucket, and bytes of the sets of a family, that one group of a task holds of either block.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Hubs that a group beyond a block meets one after the other before the rest is compared block by block.
HUBS = 8

_random = np.random.Generator(np.random.PCG64(77))
_TIMES = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BAND = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)

Tie = Callable[[list[bytes]], list[tuple[int, int]]]


class Likeness(NamedTuple):
    """Ties within a list of values; and of two values, whether they are tied, and whether a third may be tied to both."""

    walk: Tie
    pair: Callable[[bytes, bytes], tuple[bool, bool]]


SIGNATURES = "doc_id long, n_shingles long, node binary, signature binary, bands array<long>"
TIES = "a binary, b binary"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, in order, and the n + 1 places where they start and end."""
    data, bounds = _text.raw(texts)
    _, _, hashes, at = _text.words(data, bounds, lower=True)
    values, doc = _text.shingles(hashes, at)
    return _text.distinct(values, doc, len(bounds) - 1)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))[at])


def digests(values: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits of each set, None if it is empty."""
    sizes = np.diff(at).astype(np.uint64)
    pair = np.stack([_text.mix(_sums(_text.mix(values ^ np.uint64(salt)), at) + sizes) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1).astype(">u8")
    return [pair[k].tobytes() if n else None for k, n in enumerate(sizes.tolist())]


def minima(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minimum of each non-empty set under each permutation: sets by permutations."""
    starts = at[:-1][np.diff(at) > 0]
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), BANDS * ROWS), dtype=np.uint32)
    if len(starts):
        for k in range(BANDS * ROWS):
            out[:, k] = np.minimum.reduceat(short * _TIMES[k] + _PLUS[k], starts)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low 8 bits of each mixed minimum."""
    h = least ^ (least >> np.uint32(16))
    h = h * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h = h * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.uint8)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each set."""
    parts = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_BAND, (len(least), BANDS)).copy()
    for k in range(ROWS):
        key = _text.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def estimate(equal_share: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal bytes: what chance alone would give is taken off."""
    chance = 1 / 256
    return (equal_share - chance) / (1 - chance)


def margin(percent: int) -> float:
    """Five standard errors of an estimate at the threshold, at least ``MARGIN``."""
    equal = percent / 100 + (1 - percent / 100) / 256
    return max(MARGIN, 5 * (equal * (1 - equal) / (BANDS * ROWS)) ** 0.5 / (1 - 1 / 256))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document; node, signature and bands are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text.chunks(batches, "text"):
            values, at = shingle_sets(chunk.column("text"))
            least = minima(values, at)
            sizes = np.diff(at)
            has = sizes > 0
            place = np.cumsum(has) - 1
            low, keys = packed(least), band_keys(least)
            rows = [low[place[k]].tobytes() if has[k] else None for k in range(len(sizes))]
            edges = np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(edges, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(digests(values, at), type=pa.binary()), pa.array(rows, type=pa.binary()), bands], names=["doc_id", "n_shingles", "node", "signature", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SIGNATURES)


def _walk(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Ties (member, root) of the graph on ``n`` members in which ``near(x, others)`` says which others are next to x."""
    ties, left = [], np.ones(n, dtype=bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            x = queue.pop()
            others = np.flatnonzero(left)
            found = others[near(x, others)]
            left[found] = False
            queue.extend(found.tolist())
            ties.extend((int(y), root) for y in found)
    return ties


def tied_by_signature(signature: list[bytes], least: float) -> list[tuple[int, int]]:
    """Ties between signatures whose estimate reaches ``least``."""
    rows = np.frombuffer(b"".join(signature), dtype=np.uint8).reshape(len(signature), -1)
    return _walk(len(rows), lambda x, others: estimate((rows[others] == rows[x]).mean(axis=1)) >= least)


def like_signatures(least: float) -> Likeness:
    """Values are signatures; their distance is the share of unequal bytes."""
    reach = 1 - (least * 255 + 1) / 256

    def pair(a: bytes, b: bytes) -> tuple[bool, bool]:
        equal = (np.frombuffer(a, dtype=np.uint8) == np.frombuffer(b, dtype=np.uint8)).mean()
        return bool(estimate(equal) >= least), bool(1 - equal <= 2 * reach + 1e-9)

    return Likeness(lambda values: tied_by_signature(values, least), pair)


def like_sets(percent: int) -> Likeness:
    """Values are sets of 64-bit hashes; their distance is one less the similarity."""

    def pair(a: bytes, b: bytes) -> tuple[bool, bool]:
        x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        union = len(x) + len(y) - common
        return 100 * common >= percent * union, 100 * (union - common) <= 2 * (100 - percent) * union

    return Likeness(lambda values: tied_by_set([np.frombuffer(v, dtype=np.uint64) for v in values], percent), pair)


def tied_by_set(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Ties between sets whose similarity is at least ``percent``, exactly."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(1, 0)] if 100 * common >= percent * (int(sizes.sum()) - common) else []
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    lists, starts = member[order], np.searchsorted(ids[order], np.arange(int(ids.max()) + 2))  # members that hold each value
    cuts = np.concatenate(([0], np.cumsum(sizes)))

    def near(x: int, others: np.ndarray) -> np.ndarray:
        mine = ids[cuts[x] : cuts[x + 1]]
        a, b = starts[mine], starts[mine + 1]
        long = b - a
        at = np.repeat(a - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        common = np.bincount(lists[at], minlength=len(sets))[others]
        return 100 * common >= percent * (sizes[x] + sizes[others] - common)

    return _walk(len(sets), near)


def _batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)


def _walked(dealt: DataFrame, tie: Tie) -> DataFrame:
    """Ties within each group ``key, p, q`` of rows ``node, value``; a group fits a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        nodes: list[bytes] = []
        values: list[bytes] = []
        out: list[tuple[bytes, bytes]] = []

        def close() -> None:
            if len(nodes) > 1:
                out.extend((nodes[a], nodes[b]) for a, b in tie(values))
            nodes.clear()
            values.clear()

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "p", "q", "node", "value")], strict=True):
                if row[:3] != held:
                    close()
                    held = row[:3]
                if nodes and nodes[-1] == row[3]:
                    continue  # the same member by another band of the same key, or on both sides
                nodes.append(row[3])
                values.append(row[4])
            if len(out) > 5000:
                yield _batches(out, ["a", "b"], [pa.binary()] * 2)
                out.clear()
        close()
        if out:
            yield _batches(out, ["a", "b"], [pa.binary()] * 2)

    rows = dealt.select(F.xxhash64("key", "p", "q").alias("task"), "key", "p", "q", "node", "value")
    return rows.repartition("task").drop("task").sortWithinPartitions("key", "p", "q", "node").mapInArrow(run, TIES)


def _beside_hub(large: DataFrame, alike: Likeness) -> DataFrame:
    """``key, node, value, tied, close, hub`` of each member of a large group beside the group's least node: whether it is tied to that hub, and whether it may be tied to what the hub is tied to.

    The hub goes to every block of its group, and a block is streamed past it.
    """
    hubs = large.groupBy("key").agg(F.min(F.struct("node", "value")).alias("hub"), F.max("blocks").alias("blocks"))
    hubs = hubs.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("place"), F.col("hub.node").alias("node"), F.col("hub.value").alias("value"))
    rows = large.select("key", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("place"), "node", "value").unionByName(hubs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple = (None, None)
        for batch in batches:
            nodes, values = batch.column("node").to_pylist(), batch.column("value").to_pylist()
            at, tied, close, of = [], [], [], []
            for k, place in enumerate(batch.column("place").to_pylist()):
                if not place:
                    hub = (nodes[k], values[k])
                    continue
                both = (True, True) if nodes[k] == hub[0] else alike.pair(hub[1], values[k])
                at.append(k)
                tied.append(both[0])
                close.append(both[1])
                of.append(hub[0])
            if at:
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("node"), kept.column("value"), pa.array(tied), pa.array(close), pa.array(of, type=pa.binary())], names=["key", "node", "value", "tied", "close", "hub"])

    schema = T.StructType([large.schema["key"], large.schema["node"], large.schema["value"], *(T.StructField(n, T.BooleanType()) for n in ("tied", "close")), T.StructField("hub", T.BinaryType())])
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "place").mapInArrow(run, schema)


def _blocks(side: DataFrame, unit: Column, most: float) -> DataFrame:
    return side.groupBy("key").agg(F.ceil(F.sum(unit) / most).cast("int").alias("blocks"))


def _dealt(side: DataFrame, blocks: DataFrame, names: dict[str, str]) -> DataFrame:
    """Members with the ``block`` each is in and, one row each, the ``other`` blocks that it meets; ``names`` says which counts of ``blocks`` these are of."""
    block = F.pmod(F.xxhash64("node"), F.col(names["block"])).cast("int")
    return _session.salted_join(side, blocks, "key", "inner").select("key", "node", "value", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col(names["other"]) - 1)).alias("other"))


def _between(left: DataFrame, right: DataFrame, alike: Likeness, unit: Column, most: float) -> DataFrame:
    """Ties between members ``key, node, value`` of the two sides of each group, each pair of blocks by its own task."""
    blocks = _blocks(left, unit, most).withColumnRenamed("blocks", "lefts").join(_blocks(right, unit, most).withColumnRenamed("blocks", "rights"), "key")
    a = _dealt(left, blocks, {"block": "lefts", "other": "rights"}).select("key", F.col("block").alias("p"), F.col("other").alias("q"), "node", "value")
    b = _dealt(right, blocks, {"block": "rights", "other": "lefts"}).select("key", F.col("other").alias("p"), F.col("block").alias("q"), "node", "value")
    return _walked(a.unionByName(b), alike.walk)


def _within(members: DataFrame, alike: Likeness, unit: Column, most: float) -> DataFrame:
    """Ties between all members ``key, node, value`` of each group, each pair of blocks once and by its own task."""
    dealt = _dealt(members, _blocks(members, unit, most), {"block": "blocks", "other": "blocks"})
    return _walked(dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "value"), alike.walk)


def _grouped(rows: DataFrame, key: str, value: str, size: str, most: float, unit: Column, alike: Likeness, large: bool) -> DataFrame:
    """Ties within each group of ``rows (key, node, value, size)``; ``size`` is the sum of ``unit`` over the whole group.

    A group of up to ``most`` is walked by one task.  A larger one (``large`` says whether there may be any) meets one hub after
    the other: those tied to it need not be compared with each other, and of the others only the close ones with these.
    """
    rows = rows.select(F.col(key).alias("key"), "node", F.col(value).alias("value"), F.col(size).alias("size"))
    one = F.lit(0)
    alone = lambda df: _walked(df.select("key", one.alias("p"), one.alias("q"), "node", "value"), alike.walk)
    if not large:
        return alone(rows)
    rows = _session.materialize(rows, "groups")
    ties = alone(rows.filter(F.col("size") <= most))
    # A node stands in a bucket once for each of its bands with that key.
    rest = rows.filter(F.col("size") > most).dropDuplicates(["key", "node"])
    for _ in range(HUBS):
        beside = _session.materialize(_beside_hub(rest.select("key", "node", "value", F.ceil(F.col("size") / most).cast("int").alias("blocks")), alike), "beside")
        near, far = beside.filter("tied"), beside.filter("not tied")
        ties = ties.unionByName(near.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        if not far.filter("close").isEmpty():
            ties = ties.unionByName(_between(far.filter("close").select("key", "node", "value"), near.select("key", "node", "value"), alike, unit, most))
        left = _session.materialize(far.groupBy("key").agg(F.sum(unit).alias("size")), "left")
        rest = _session.salted_join(far.select("key", "node", "value"), left, "key", "inner")
        if not left.filter(F.col("size") <= most).isEmpty():
            ties = ties.unionByName(alone(rest.filter(F.col("size") <= most)))
        rest = rest.filter(F.col("size") > most)
        if left.filter(F.col("size") > most).isEmpty():
            return ties
    return ties.unionByName(_within(rest.select("key", "node", "value"), alike, unit, most))


def families(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, label``: nodes tied by estimates, in groups that contain whole components."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = _session.materialize(keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("members")).filter("a <> b"), "buckets")
    pairs = buckets.filter("members = 2").select("a", "b").distinct().select(F.xxhash64("a", "b").alias("key"), F.lit(2).cast("long").alias("members"), F.explode(F.array("a", "b")).alias("node"))
    many = _session.salted_join(keys, buckets.filter("members > 2").select("key", "members"), "key", "inner").select("key", "members", "node")
    members = pairs.unionByName(many).join(nodes.select("node", "signature"), "node")
    least = percent / 100 - margin(percent)
    large = not buckets.filter(F.col("members") > BLOCK).isEmpty()
    return _session.settled(lambda: _components.components(_grouped(members, "key", "signature", "members", BLOCK, F.lit(1), like_signatures(least), large)), "families", buckets)


def _confirmed(docs: DataFrame, nodes: DataFrame, family: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """Ties between nodes of a family whose full sets are similar enough."""
    sizes = family.join(nodes, "node").select("node", F.col("label").alias("family"), "first", "n_shingles")
    whole = sizes.groupBy("family").agg(F.sum(8 * F.col("n_shingles")).alias("bytes"))
    chosen = _session.salted_join(sizes, whole, "family", "inner").select(F.col("first").alias("doc_id"), "node", "family", "bytes")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text.chunks(batches, "text"):
            values, at = shingle_sets(chunk.column("text"))
            same = [a == b for a, b in zip(digests(values, at), chunk.column("node").to_pylist(), strict=True)]  # an id may have other texts too
            rows = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("family"), chunk.column("node"), pa.array(rows, type=pa.binary()), chunk.column("bytes")], names=["family", "node", "shingles", "bytes"]).filter(pa.array(same))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(digests(*shingle_sets(chunk.column("text"))), type=pa.binary()), chunk.column("text")], names=["node", "text"])

    found = texts.join(chosen, "doc_id").select("family", "node", "text", "bytes")
    if not nodes.filter("first is null").isEmpty():  # nodes without an id are found by their digest
        unnamed = texts.filter("doc_id is null").select("text").mapInArrow(signed, "node binary, text string").groupBy("node").agg(F.first("text").alias("text"))
        found = found.unionByName(unnamed.join(chosen.filter("doc_id is null").drop("doc_id"), "node").select("family", "node", "text", "bytes"))
    sets = found.mapInArrow(run, "family binary, node binary, shingles binary, bytes long")
    large = not whole.filter(F.col("bytes") > BLOCK_BYTES).isEmpty()
    return _grouped(sets, "family", "shingles", "bytes", BLOCK_BYTES, F.octet_length("value"), like_sets(percent), large)


def _membership(docs: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, node, label, component_id`` of each row; ``label`` names its component, null for empty sets."""
    signed = _session.materialize(signatures(docs, doc_id, text), "signatures")
    nodes = _session.materialize(
        signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), F.first("bands").alias("bands")), "nodes"
    )
    family = families(nodes, percent)
    linked = _session.settled(lambda: _components.components(_confirmed(docs, nodes, family, percent, doc_id, text)), "linked")
    least = linked.join(nodes.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = nodes.select("node", "first").join(linked, "node", "left").join(least, "label", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("component_id", "first").alias("component_id"))
    of_node = _session.materialize(of_node, "components")
    out = _session.salted_join(signed.select("doc_id", "n_shingles", "node"), of_node, "node").select("doc_id", "n_shingles", "node", "label", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = _session.materialize(out, "near")
    _session.discard(signed, nodes, family, linked, of_node)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``."""
    out = _membership(docs, percent, doc_id, text)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component (the one with the smallest id), and all rows with empty sets; their columns as they came."""
    near = _membership(docs, percent, doc_id, text)
    members = near.filter("node is not null").withColumn("rank", F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "node"))
    each = members.groupBy("label", "rank").agg(F.count(F.lit(1)).alias("rows"))
    each = _session.materialize(_session.salted_join(each, each.groupBy("label").agg(F.min("rank").alias("best")), "label").select("rank.doc_id", "rank.node", "rows", F.expr("rank = best").alias("stays")), "verdicts")
    _session.discard(near)
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([chunk.column("row"), chunk.column("doc_id"), pa.array(digests(*shingle_sets(chunk.column("text"))), type=pa.binary())], names=["row", "doc_id", "node"])

    named = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("doc_id", T.LongType()), T.StructField("node", T.BinaryType())]))
    gone, again = each.filter("not stays").select("doc_id", "node"), each.filter("stays and rows > 1").select("doc_id", "node")
    match = lambda other: named["doc_id"].eqNullSafe(other["doc_id"]) & (named["node"] == other["node"])
    left = named.join(gone, match(gone), "left_anti")
    if not again.isEmpty():  # rows that repeat both id and text
        left = left.join(again, match(again), "left_anti").unionByName(left.join(again, match(again), "left_semi").dropDuplicates(["doc_id", "node"]))
    return left.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the contract of op7."""
    return near_duplicates(_session.table(spark, sf_dir, "documents"))
