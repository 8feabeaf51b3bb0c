"""Chunk plans: ranges of fixed size, their limits, and part numbers."""

from __future__ import annotations

from tallyport.plans.registry import operator

#: Bytes: the default and the least chunk size; the largest part number.
DEFAULT_CHUNK, LEAST_CHUNK, MAX_PARTS = 8 << 20, 256 << 10, 10_000
SAFE = 9007199254740991


@operator("plan_chunks")
def plan_chunks(d):
    """Every chunk of every manifest: half-open byte ranges; an empty file has none, unsafe numbers and too small chunks neither."""
    return f"""SELECT manifest_id, chunk_index, chunk_index * chunk_size AS start_byte, least((chunk_index + 1) * chunk_size, total_bytes) AS end_byte, least(chunk_size, total_bytes - chunk_index * chunk_size) AS size_bytes
    FROM (SELECT * FROM {{manifests}} WHERE total_bytes BETWEEN 0 AND {SAFE} AND chunk_size BETWEEN {LEAST_CHUNK} AND {SAFE}) m {d.rows(d.div("total_bytes + chunk_size - 1", "chunk_size") + " - 1", "chunk_index")}"""


@operator("chunk_identity")
def chunk_identity(d):
    """The summary of a plan, without its chunks."""
    return f"SELECT manifest_id, 'fixed-size' AS strategy, chunk_size, total_bytes, {d.div('total_bytes + chunk_size - 1', 'chunk_size')} AS total_chunks FROM {{manifests}} WHERE chunk_size >= {LEAST_CHUNK}"


@operator("plan_limits")
def plan_limits(d):
    """The first breach of each transport's limits by each plan: too many chunks, then by chunk too small or too large.

    Of chunks of a fixed size only the first and the last can differ, so no plan is spread out.
    """
    first, last = "least(m.chunk_size, m.total_bytes)", "least(m.total_chunks * m.chunk_size, m.total_bytes) - (m.total_chunks - 1) * m.chunk_size"
    breaches = [
        ("m.total_chunks > c.max_chunks", "count", "-1"),
        (f"m.total_chunks > 1 AND {first} < c.min_chunk", "small", "0"),
        (f"m.total_chunks > 1 AND {first} > c.max_chunk", "large", "0"),
        (f"m.total_chunks > 0 AND {last} < coalesce(c.min_final, c.min_chunk)", "small", "m.total_chunks - 1"),
        (f"m.total_chunks > 0 AND {last} > c.max_chunk", "large", "m.total_chunks - 1"),
    ]
    reason, place = (" ".join(f"WHEN {b[0]} THEN {x}" for b in breaches for x in [f"'{b[1]}'" if k else b[2]]) for k in (1, 0))
    return f"""SELECT manifest_id, transport, reason, chunk_index FROM (SELECT m.manifest_id, c.name AS transport, CASE {reason} END AS reason, CAST(CASE {place} END AS BIGINT) AS chunk_index
    FROM {{manifests}} m CROSS JOIN {{capabilities}} c) t WHERE reason IS NOT NULL"""


@operator("plan_diff")
def plan_diff(d):
    """Chunks on which the stored plan and the plan for the offered file disagree; either side may lack one."""
    return f"""SELECT coalesce(a.manifest_id, b.manifest_id) AS manifest_id, coalesce(a.chunk_index, b.chunk_index) AS chunk_index, a.end_byte AS stored_end, b.end_byte AS offered_end FROM {{plan}} a FULL OUTER JOIN
    (SELECT manifest_id, chunk_index, chunk_index * chunk_size AS start_byte, least((chunk_index + 1) * chunk_size, size_bytes) AS end_byte FROM {{candidates}} {d.rows(d.div("size_bytes + chunk_size - 1", "chunk_size") + " - 1", "chunk_index")}) b
    ON a.manifest_id = b.manifest_id AND a.chunk_index = b.chunk_index WHERE a.start_byte IS DISTINCT FROM b.start_byte OR a.end_byte IS DISTINCT FROM b.end_byte"""


@operator("throughput")
def throughput(d):
    """MiB per second of each session, zero where no time has passed."""
    ms = "(unix_millis(cast(max(event_time) as timestamp)) - unix_millis(cast(min(event_time) as timestamp)))" if d.name == "spark" else "(epoch_us(max(event_time)) // 1000 - epoch_us(min(event_time)) // 1000)"
    return f"SELECT session_id, bytes, ms, CASE WHEN ms <= 0 THEN 0.0 ELSE round(bytes / 1048576.0 / (ms / 1000.0), 9) END AS mib_per_s FROM (SELECT session_id, CAST(sum(uploaded_bytes) AS DOUBLE) AS bytes, CAST({ms} AS DOUBLE) AS ms FROM {{ingest_events}} GROUP BY session_id) t"


def sliced(d, size: int) -> str:
    """To follow FROM: each chunk of ``size`` bytes of every file, on the file's own row; an empty file has none."""
    return f"(SELECT *, {d.octets('content')} AS n_bytes FROM {{files}} WHERE content <> '') f {d.rows(d.div(f'n_bytes + {size - 1}', str(size)) + ' - 1', 'chunk_index')}"


@operator("chunk_slice", given={"size": 1000})
def chunk_slice(d, size):
    """The bytes of each chunk of a file, in hexadecimal digits."""
    return f"SELECT file_id, chunk_index, {d.hex_bytes(d.bytes_part('content', f'chunk_index * {size}', str(size)))} AS body_hex FROM {sliced(d, size)}"


def _parts(extra: str = "") -> str:
    """The receipts of each upload in the order of chunks, numbered."""
    return f"(SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY chunk_index, position) AS place{extra} FROM {{receipts}})"


def _completion() -> str:
    return f"""CASE WHEN count(r.manifest_id) = 0 THEN 'transport.receipt_missing' WHEN max(CASE WHEN r.chunk_index + 1 > {MAX_PARTS} THEN 1 ELSE 0 END) = 1 THEN 'transport.part_rejected'
    WHEN max(CASE WHEN r.manifest_id IS NOT NULL AND (coalesce(r.part_number, 0) = 0 OR coalesce(r.etag, '') = '') THEN 1 ELSE 0 END) = 1 OR max(CASE WHEN r.part_number <> r.place THEN 1 ELSE 0 END) = 1 THEN 'transport.receipt_invalid' ELSE 'ok' END"""


@operator("s3_parts")
def s3_parts(d):
    """What completion of each multipart upload would do: the number of parts, or the first reason against it."""
    return f"SELECT m.manifest_id, count(r.part_number) AS n_parts, {_completion()} AS verdict FROM {{manifests}} m LEFT JOIN {_parts()} r ON r.manifest_id = m.manifest_id GROUP BY m.manifest_id"


@operator("s3_completed_parts")
def s3_completed_parts(d):
    """The list of parts that completes each multipart upload whose receipts allow it."""
    return f"""SELECT p.manifest_id, p.part_number, p.etag FROM {_parts()} p JOIN (SELECT manifest_id FROM (SELECT r.manifest_id, {_completion()} AS verdict FROM {_parts()} r GROUP BY r.manifest_id) v WHERE verdict = 'ok') w ON w.manifest_id = p.manifest_id"""


@operator("s3_handles", bind={"handles": "s3_handles"})
def s3_handles(d):
    """Why a multipart upload's handle, persisted state or part target cannot be used; the first reason counts."""
    return """SELECT handle_id, CASE WHEN coalesce(upload_id, '') = '' OR coalesce(object_key, '') = '' THEN CASE WHEN persisted THEN 'transport.resume_failed' ELSE 'transport.failed' END
    WHEN NOT persisted AND (coalesce(url, '') = '' OR coalesce(nullif(method, ''), 'PUT') <> 'PUT') THEN 'transport.failed' ELSE 'ok' END AS verdict FROM {handles}"""
