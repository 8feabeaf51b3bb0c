"""Receipts and plans: what is there, twice there, or missing; and ranges of chunks."""

from __future__ import annotations

from tallyport.plans.registry import operator

FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, chunk_index ORDER BY position) AS place FROM {receipts}) q WHERE place = 1)"


@operator("missing_chunks")
def missing_chunks(d):
    """Planned chunks without a receipt."""
    return "SELECT p.manifest_id, p.chunk_index FROM {plan} p LEFT ANTI JOIN {receipts} r ON r.manifest_id = p.manifest_id AND r.chunk_index = p.chunk_index".replace("LEFT ANTI", d.anti)


@operator("missing_top10")
def missing_top10(d):
    """How many chunks are missing, and the first ten of them."""
    anti = d.anti
    return f"""SELECT manifest_id, count(*) AS missing, {d.listed("CASE WHEN place <= 10 THEN chunk_index END", "chunk_index")} AS first_missing FROM (SELECT p.manifest_id, p.chunk_index, row_number() OVER (PARTITION BY p.manifest_id ORDER BY p.chunk_index) AS place
    FROM {{plan}} p {anti} JOIN {{receipts}} r ON r.manifest_id = p.manifest_id AND r.chunk_index = p.chunk_index) t GROUP BY manifest_id"""


@operator("remaining_chunks")
def remaining_chunks(d):
    """What is left to send when an upload that is not finished (status F) is resumed, with its bytes."""
    anti = d.anti
    return f"SELECT p.manifest_id, p.chunk_index, p.start_byte, p.end_byte FROM (SELECT p.* FROM {{plan}} p JOIN {{manifests}} m ON m.manifest_id = p.manifest_id WHERE m.status <> 'F') p {anti} JOIN {{receipts}} r ON r.manifest_id = p.manifest_id AND r.chunk_index = p.chunk_index"


@operator("duplicate_receipts")
def duplicate_receipts(d):
    """Receipts of chunks that have an earlier one."""
    return "SELECT manifest_id, chunk_index, position FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, chunk_index ORDER BY position) AS place FROM {receipts}) t WHERE place > 1"


@operator("uploaded_bytes")
def uploaded_bytes(d):
    """Bytes of the receipts that count."""
    return f"SELECT r.manifest_id, CAST(sum(r.size_bytes) AS BIGINT) AS uploaded_bytes FROM {FIRST} r JOIN {{manifests}} m ON m.manifest_id = r.manifest_id WHERE r.chunk_index < m.total_chunks GROUP BY r.manifest_id"


@operator("cumulative_bytes")
def cumulative_bytes(d):
    """Bytes acknowledged after each chunk, in the order of chunks."""
    return f"SELECT manifest_id, chunk_index, CAST(sum(size_bytes) OVER (PARTITION BY manifest_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS uploaded_bytes FROM {FIRST} r"


@operator("chunk_ranges")
def chunk_ranges(d):
    """Runs of consecutive chunks that have receipts."""
    return """SELECT manifest_id, min(chunk_index) AS start_index, max(chunk_index) AS end_index FROM (SELECT manifest_id, chunk_index, chunk_index - row_number() OVER (PARTITION BY manifest_id ORDER BY chunk_index) AS island
    FROM (SELECT DISTINCT manifest_id, chunk_index FROM {receipts}) u) v GROUP BY manifest_id, island"""


def merged() -> str:
    """Ranges without those that end before they start, overlapping and adjacent ones joined."""
    return """SELECT record_id, min(start_index) AS start_index, max(end_index) AS end_index FROM (SELECT record_id, start_index, end_index, sum(fresh) OVER (PARTITION BY record_id ORDER BY start_index, end_index ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT record_id, start_index, end_index, CASE WHEN start_index <= max(end_index) OVER (PARTITION BY record_id ORDER BY start_index, end_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh
    FROM (SELECT DISTINCT record_id, start_index, end_index FROM {ranges} WHERE start_index <= end_index) u) v) w GROUP BY record_id, island"""


@operator("merge_ranges")
def merge_ranges(d):
    """The union of completed ranges of each record."""
    return merged()


@operator("range_membership", bind={"asked": "asked_chunks"})
def range_membership(d):
    """Whether each chunk index that is asked for is in one of the record's ranges: by the farthest end of the ranges that begin at or before it, in one pass over both in order."""
    return """SELECT record_id, chunk_index, coalesce(reach >= chunk_index, false) AS completed FROM (
    SELECT record_id, chunk_index, asked, max(end_index) OVER (PARTITION BY record_id ORDER BY chunk_index, asked ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM (
    SELECT record_id, start_index AS chunk_index, end_index, 0 AS asked FROM {ranges} UNION ALL SELECT DISTINCT record_id, chunk_index, CAST(NULL AS BIGINT), 1 FROM {asked}) u) v WHERE asked = 1"""


@operator("ranges_equal")
def ranges_equal(d):
    """Whether the ranges as stored are already the normalised ones."""
    of = lambda rel: f"SELECT record_id, {d.listed('concat(start_index, ' + repr('-') + ', end_index)', 'start_index, end_index')} AS shown FROM ({rel}) x GROUP BY record_id"
    return f"SELECT a.record_id, a.shown IS NOT DISTINCT FROM b.shown AS equal FROM ({of('SELECT record_id, start_index, end_index FROM {ranges}')}) a LEFT JOIN ({of(merged())}) b ON b.record_id = a.record_id"


@operator("range_bytes", bind={"ranges": "record_ranges"})
def range_bytes(d):
    """Bytes of the completed ranges, in closed form; the last chunk may be short."""
    return """SELECT r.manifest_id, CAST(sum((r.end_index - r.start_index + 1) * m.chunk_size - CASE WHEN r.end_index = m.total_chunks - 1 THEN m.chunk_size - (m.total_bytes - r.end_index * m.chunk_size) ELSE 0 END) AS BIGINT) AS bytes
    FROM {ranges} r JOIN {manifests} m ON m.manifest_id = r.manifest_id GROUP BY r.manifest_id"""


@operator("next_incomplete")
def next_incomplete(d):
    """The first chunk of each manifest without a receipt; the number of chunks if there is none."""
    return """SELECT m.manifest_id, least(m.total_chunks, count(CASE WHEN r.chunk_index = r.place - 1 THEN 1 END)) AS next_index FROM {manifests} m LEFT JOIN (SELECT manifest_id, chunk_index, row_number() OVER (PARTITION BY manifest_id ORDER BY chunk_index) AS place
    FROM (SELECT DISTINCT manifest_id, chunk_index FROM {receipts}) u) r ON r.manifest_id = m.manifest_id GROUP BY m.manifest_id, m.total_chunks"""


@operator("hydrate_snapshot")
def hydrate_snapshot(d):
    """Receipts of a snapshot put on the plan; those of unknown chunks are conflicts."""
    return "SELECT r.manifest_id, r.position, r.chunk_index, p.start_byte, p.end_byte, p.chunk_index IS NULL AS conflict FROM {receipts} r LEFT JOIN {plan} p ON p.manifest_id = r.manifest_id AND p.chunk_index = r.chunk_index"


@operator("hydrate_legacy", bind={"ranges": "record_ranges"})
def hydrate_legacy(d):
    """Receipts made up for the ranges of records that were stored without any."""
    return f"SELECT x.manifest_id, x.chunk_index, p.end_byte - p.start_byte AS size_bytes FROM (SELECT r.manifest_id, chunk_index FROM (SELECT g.* FROM {{ranges}} g JOIN {{resume_records}} s ON s.manifest_id = g.manifest_id WHERE s.schema_version = 'v0.1') r {d.between('r.start_index', 'r.end_index', 'chunk_index')}) x JOIN {{plan}} p ON p.manifest_id = x.manifest_id AND p.chunk_index = x.chunk_index"


@operator("resume_checkpoint")
def resume_checkpoint(d):
    """State of a record after each acknowledged chunk: planned bytes of the completed ranges, how many ranges, and the first chunk that is missing.

    A chunk opens a range, closes the gap between two, or neither, by which of its neighbours came before it.  The first missing
    chunk moves when the latest of a run of chunks from the start comes.
    """
    first = f"(SELECT r.manifest_id, r.chunk_index, r.position, least(m.chunk_size, m.total_bytes - r.chunk_index * m.chunk_size) AS planned FROM {FIRST} r JOIN {{manifests}} m ON m.manifest_id = r.manifest_id WHERE r.chunk_index BETWEEN 0 AND m.total_chunks - 1)"
    order = "OVER (PARTITION BY manifest_id ORDER BY chunk_index)"
    near = f"""(SELECT *, CASE WHEN lag(chunk_index) {order} = chunk_index - 1 AND lag(position) {order} < position THEN 1 ELSE 0 END AS below, CASE WHEN lead(chunk_index) {order} = chunk_index + 1 AND lead(position) {order} < position THEN 1 ELSE 0 END AS above,
    row_number() {order} - 1 AS nth, max(position) OVER (PARTITION BY manifest_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS latest FROM {first} f)"""
    # Each chunk tells of itself when it comes, and of the run from the start that it ends when the last of that run has come.
    told = f"""(SELECT manifest_id, kind, chunk_index, CASE WHEN kind = 0 THEN position ELSE latest END AS at_position, CASE WHEN kind = 0 THEN planned ELSE 0 END AS planned, CASE WHEN kind = 0 THEN 1 - below - above ELSE 0 END AS opened, CASE WHEN kind = 1 THEN chunk_index + 1 END AS upto
    FROM {near} n CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1) k WHERE kind = 0 OR chunk_index = nth)"""
    return f"""SELECT manifest_id, position, chunk_index, uploaded_bytes, ranges, next_index FROM (SELECT manifest_id, kind, at_position AS position, chunk_index, CAST(sum(planned) OVER w AS BIGINT) AS uploaded_bytes, CAST(sum(opened) OVER w AS BIGINT) AS ranges, coalesce(max(upto) OVER w, 0) AS next_index
    FROM {told} t WINDOW w AS (PARTITION BY manifest_id ORDER BY at_position RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) u WHERE kind = 0"""


@operator("retransmission")
def retransmission(d):
    """Bytes that reached the server, those sent again, and those covered."""
    return """SELECT manifest_id, CAST(sum(size_bytes) AS BIGINT) AS received, CAST(coalesce(sum(CASE WHEN place > 1 THEN size_bytes END), 0) AS BIGINT) AS duplicate, CAST(sum(CASE WHEN place = 1 THEN size_bytes ELSE 0 END) AS BIGINT) AS covered
    FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, chunk_index ORDER BY position) AS place FROM {receipts}) t GROUP BY manifest_id"""
