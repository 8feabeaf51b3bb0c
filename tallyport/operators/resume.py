"""Resume records: validity, expiry, what can be resumed, and state that is merged or replaced."""

from __future__ import annotations

from tallyport.operators.receipts import FIRST
from tallyport.operators.chunks import SAFE
from tallyport.operators.records import is_iso
from tallyport.plans.registry import operator
from tallyport.plans.views import NOW, NOW_ISO

RECOVERABLE = "status IN ('active', 'paused', 'failed')"
STATUSES = "('active', 'paused', 'failed', 'completed', 'canceled', 'expired')"
_AT = {"now": NOW}


def expired(d, now: str) -> str:
    """Expired by status, or at or before ``now``; a time that is none never expires."""
    return f"(status = 'expired' OR coalesce({d.stamp('expires_at')} <= {now}, false))"


def mismatched(kind: str, d) -> str:
    """SQL: a record against the file that is offered for it (``offered_...``), or against the plan for that."""
    if kind == "file":
        same = " AND ".join(f"coalesce(file_{x} = offered_{x}, false)" for x in ("name", "bytes", "media_type", "fingerprint"))
        return f"NOT ({same} AND coalesce(file_last_modified = offered_last_modified, true))"
    return f"(chunk_size <> offered_chunk OR total_bytes <> offered_bytes OR total_chunks <> {d.div('offered_bytes + offered_chunk - 1', 'offered_chunk')})"


def _offered(extra: str = "", joined: str = "") -> str:
    return f"""(SELECT r.*, c.name AS offered_name, c.size_bytes AS offered_bytes, c.media_type AS offered_media_type, c.fingerprint AS offered_fingerprint, c.last_modified AS offered_last_modified, c.chunk_size AS offered_chunk{extra}
    FROM {{resume_records}} r JOIN {{candidates}} c ON c.manifest_id = r.manifest_id{joined}) t"""


@operator("recoverable", given=_AT)
def recoverable(d, now):
    """Records that can still be resumed."""
    return f"SELECT record_id, status, expires_at FROM {{resume_records}} WHERE {RECOVERABLE} AND NOT {expired(d, now)}"


@operator("resume_classify", given=_AT)
def resume_classify(d, now):
    """What stands between a record and the file that is offered for it (name, size, media type, fingerprint, and time of change if both have one); the first reason counts."""
    return f"""SELECT record_id, CASE WHEN {expired(d, now)} THEN 'expired' WHEN NOT {RECOVERABLE} THEN 'not_recoverable' WHEN {mismatched('file', d)} THEN 'file_mismatch'
    WHEN {mismatched('chunking', d)} THEN 'chunking_mismatch' ELSE 'compatible' END AS verdict FROM {_offered()}"""


@operator("resume_gate", given=_AT)
def resume_gate(d, now):
    """The six conflicts that stop a session from resuming, for each transport it may run on, in their own order."""
    return f"""SELECT record_id, active, CASE WHEN {expired(d, now)} THEN 'resume.expired' WHEN {mismatched('file', d)} THEN 'resume.file_mismatch' WHEN {mismatched('chunking', d)} THEN 'resume.chunking_mismatch'
    WHEN persistent IS NOT DISTINCT FROM false THEN 'resume.transport_unsupported' WHEN active <> transport_name THEN 'resume.transport_mismatch' WHEN status IN ('completed', 'canceled') THEN 'resume.record_not_found' ELSE 'ok' END AS verdict
    FROM {_offered(', t.name AS active, t.persistent', ' CROSS JOIN {capabilities} t')}"""


@operator("capability_gate")
def capability_gate(d):
    """Whether each transport may keep a resume record; one that does not say so may."""
    return "SELECT name, persistent IS DISTINCT FROM false AS allowed FROM {capabilities}"


def _whole(x: str, least: int = 0) -> str:
    return f"coalesce({x} BETWEEN {least} AND {SAFE}, false)"


def _problems(d) -> str:
    """The first thing that is wrong with each stored record, or null: ``record_id, code, path``.

    Stored ranges and receipts are each reduced to a row per record before they meet it; receipts are read once, for their numbers and their runs.
    """
    chunks = d.div("total_bytes + chunk_size - 1", "chunk_size")
    record = [
        ("coalesce(record_id, '') = ''", "id"),
        (f"NOT {is_iso(d, 'created_at')} OR NOT {is_iso(d, 'updated_at')}", "createdAt"),
        (f"manifest_id IS NULL OR coalesce(manifest_version, '') <> 'v1' OR NOT {_whole('manifest_bytes')} OR NOT {_whole('manifest_chunk_size', 1)} OR NOT {_whole('manifest_chunks')}", "manifest"),
        (f"coalesce(file_name, '') = '' OR NOT {_whole('file_bytes')} OR coalesce(file_media_type, '') = '' OR coalesce(file_fingerprint, '') = ''", "file"),
        (f"file_last_modified IS NOT NULL AND NOT {_whole('file_last_modified')}", "file.lastModified"),
        (f"coalesce(strategy, '') <> 'fixed-size' OR NOT {_whole('chunk_size', 1)} OR NOT {_whole('total_bytes')} OR NOT {_whole('total_chunks')}", "chunking"),
        (f"total_chunks <> {chunks}", "chunking.totalChunks"),
        ("file_bytes <> total_bytes OR manifest_bytes <> total_bytes OR manifest_chunk_size <> chunk_size OR manifest_chunks <> total_chunks", "chunking"),
        ("coalesce(upload_id, '') = ''", "transport.uploadId"),
        (f"expires_at IS NOT NULL AND NOT {is_iso(d, 'expires_at')}", "transport.expiresAt"),
        (f"NOT coalesce(status IN {STATUSES}, false) OR NOT {_whole('uploaded_bytes')} OR NOT {_whole('next_index')}", "progress"),
        ("uploaded_bytes > total_bytes OR next_index > total_chunks", "progress"),
        ("coalesce(n_ranges, 0) > total_chunks", "progress.completedChunkRanges"),
    ]
    steps = "".join(f" WHEN {c} THEN '{p}'" for c, p in record)
    receipt = [
        f"NOT ({_whole('r.chunk_index')} AND r.chunk_index < r.total_chunks AND {_whole('r.size_bytes')} AND {is_iso(d, 'r.completed_at')} AND coalesce(r.transport, '') <> '')",
        "r.size_bytes <> least(r.chunk_size, r.total_bytes - r.chunk_index * r.chunk_size)",
        "r.transport_name <> '' AND r.transport <> r.transport_name",
        f"r.part_number IS NOT NULL AND NOT {_whole('r.part_number')}",
        "r.nth > 1",
    ]
    fault = "CASE" + "".join(f" WHEN coalesce({c}, false) THEN {k}" for k, c in enumerate(receipt)) + " END"
    # The first bad receipt, and of it the first rule, as one number.
    first = f"min(r.position * 8 + {fault})"
    suffix = "CASE fault % 8 WHEN 1 THEN '.sizeBytes' WHEN 2 THEN '.transport.name' WHEN 3 THEN '.transport.partNumber' WHEN 4 THEN '.chunkIndex' ELSE '' END"
    ranges = f"""(SELECT record_id, count(*) AS n_ranges, min(CASE WHEN bad THEN place END) AS bad_range, CAST(sum((end_index - start_index + 1) * chunk_size - CASE WHEN end_index = total_chunks - 1 THEN chunk_size - (total_bytes - end_index * chunk_size) ELSE 0 END) AS BIGINT) AS range_bytes,
      least(max(total_chunks), coalesce(max(CASE WHEN place = 0 AND start_index = 0 THEN end_index + 1 END), 0)) AS range_next, {d.listed('concat(start_index, ' + repr('-') + ', end_index)', 'place')} AS shown
      FROM (SELECT g.record_id, g.place, g.start_index, g.end_index, x.total_chunks, x.chunk_size, x.total_bytes, NOT ({_whole('g.start_index')} AND {_whole('g.end_index')} AND g.start_index <= g.end_index AND g.end_index < x.total_chunks AND g.start_index > coalesce(lag(g.end_index) OVER (PARTITION BY g.record_id ORDER BY g.place), -2) + 1) AS bad
        FROM {{stored_ranges}} g JOIN {{resume_records}} x ON x.record_id = g.record_id) h GROUP BY record_id)"""
    receipts = f"""(SELECT record_id, CAST(sum(rows_) AS BIGINT) AS n_receipts, CAST(sum(bytes_) AS BIGINT) AS receipt_bytes, min(fault) AS fault, {d.listed('concat(first_index, ' + repr('-') + ', last_index)', 'first_index')} AS shown
      FROM (SELECT r.record_id, count(*) AS rows_, sum(r.size_bytes) AS bytes_, {first} AS fault, min(r.chunk_index) AS first_index, max(r.chunk_index) AS last_index
        FROM (SELECT g.*, x.record_id, row_number() OVER (PARTITION BY x.manifest_id, x.record_id, g.chunk_index ORDER BY g.position) AS nth, g.chunk_index - dense_rank() OVER (PARTITION BY x.manifest_id, x.record_id ORDER BY g.chunk_index) AS island, x.total_chunks, x.chunk_size, x.total_bytes, x.transport_name
          FROM {{receipts}} g JOIN {{resume_records}} x ON x.manifest_id = g.manifest_id) r GROUP BY r.manifest_id, r.record_id, r.island) j GROUP BY record_id)"""
    old, new = "schema_version = 'v0.1'", "schema_version = 'v0.2'"
    return f"""SELECT record_id, CASE WHEN path = 'schemaVersion' THEN 'resume.schema_unsupported' WHEN path IS NULL THEN NULL WHEN of_receipts THEN 'resume.receipt_invalid' ELSE 'resume.record_invalid' END AS code, path FROM (SELECT record_id, CASE WHEN path IS NOT NULL THEN path
    WHEN {new} AND coalesce(n_receipts, 0) > total_chunks THEN 'receipts' WHEN {new} AND fault IS NOT NULL THEN concat('receipts[', {d.div('fault', '8')}, ']', {suffix}) WHEN {new} AND coalesce(range_text, '') <> coalesce(island_text, '') THEN 'progress.completedChunkRanges'
    WHEN {new} AND uploaded_bytes <> coalesce(receipt_bytes, 0) THEN 'progress.uploadedBytes' END AS path, path IS NULL AS of_receipts FROM (SELECT *, CASE WHEN NOT coalesce(schema_version IN ('v0.1', 'v0.2'), false) THEN 'schemaVersion'{steps}
    WHEN bad_range IS NOT NULL THEN concat('progress.completedChunkRanges[', bad_range, ']') WHEN next_index <> coalesce(range_next, 0) THEN 'progress.nextChunkIndex' WHEN {old} AND uploaded_bytes <> coalesce(range_bytes, 0) THEN 'progress.uploadedBytes' END AS path
    FROM (SELECT x.*, g.n_ranges, g.bad_range, g.range_bytes, g.range_next, g.shown AS range_text, q.n_receipts, q.receipt_bytes, q.fault, q.shown AS island_text FROM {{resume_records}} x LEFT JOIN {ranges} g ON g.record_id = x.record_id
    LEFT JOIN {receipts} q ON q.record_id = x.record_id) t) u) v"""


@operator("resume_validate")
def resume_validate(d):
    """The first thing that is wrong with each stored record; no row if nothing is."""
    return f"SELECT record_id, code, path FROM ({_problems(d)}) p WHERE code IS NOT NULL"


@operator("resume_parse")
def resume_parse(d):
    """Every stored record with the issue that refuses it, or none: what a caller goes on with, and what it must raise."""
    return f"SELECT record_id, code IS NULL AS accepted, code, path FROM ({_problems(d)}) p"


@operator("resume_record", given={"now": NOW_ISO})
def resume_record(d, now):
    """A new record for each open upload."""
    return f"""SELECT concat('resume_', manifest_id) AS record_id, manifest_id, 'v0.2' AS schema_version, concat('up-', manifest_id) AS upload_id, 'active' AS status, CAST(0 AS BIGINT) AS uploaded_bytes, CAST(0 AS BIGINT) AS next_index, total_bytes, chunk_size, total_chunks, {now} AS created_at, {now} AS updated_at FROM {{manifests}} WHERE status = 'O'"""


@operator("snapshot_record")
def snapshot_record(d):
    """A record made from a snapshot's receipts: progress, ranges and the next chunk."""
    return f"""SELECT concat('snapshot_', m.manifest_id) AS record_id, CAST(coalesce(sum(r.size_bytes), 0) AS BIGINT) AS uploaded_bytes, count(r.chunk_index) AS chunks, count(CASE WHEN r.chunk_index = r.nth THEN 1 END) AS next_index, {d.listed('r.chunk_index', 'r.chunk_index')} AS completed
    FROM {{manifests}} m LEFT JOIN (SELECT manifest_id, chunk_index, size_bytes, row_number() OVER (PARTITION BY manifest_id ORDER BY chunk_index) - 1 AS nth FROM {FIRST} q) r ON r.manifest_id = m.manifest_id AND r.chunk_index < m.total_chunks GROUP BY m.manifest_id"""


@operator("resume_get", given={"key": "resume_7"})
def resume_get(d, key):
    """One record by its key."""
    return f"SELECT record_id, status, total_bytes, uploaded_bytes FROM {{resume_records}} WHERE record_id = {d.text(key)}"


@operator("resume_list", bind={"store": "stored_entries"}, given={"prefix": "resume:"})
def resume_list(d, prefix):
    """The stored values under a prefix: a JSON object with an id and a status, or marked as no record."""
    return f"""SELECT entry, id, status, CASE WHEN id IS NULL OR NOT coalesce(status IN {STATUSES}, false) THEN 'resume.record_invalid' ELSE 'ok' END AS verdict
    FROM (SELECT entry, {d.json('stored', 'id')} AS id, {d.json('stored', 'status')} AS status FROM {{store}} WHERE substring(entry, 1, {len(prefix)}) = {d.text(prefix)}) t"""


@operator("resume_upsert", bind={"changes": "resume_changes"})
def resume_upsert(d):
    """The store after a batch of puts and deletes: the last change of a key wins, other records stay."""
    last = "(SELECT record_id, status FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY position DESC) AS place FROM {changes} c) q WHERE place = 1)"
    anti = d.anti
    return f"SELECT r.record_id, r.status FROM {{resume_records}} r {anti} JOIN {last} l ON l.record_id = r.record_id UNION ALL SELECT record_id, status FROM {last} l WHERE status IS NOT NULL"


@operator("transport_merge", bind={"current": "transport_states", "log": "transport_results"})
def transport_merge(d):
    """Transport state of each record after a log of results: of token, expiry and data the newest that is given, of the upload id the newest of results that open a session; the name never changes."""
    last = lambda x: f"max_by({x}, CASE WHEN {x} IS NOT NULL THEN position END)" if d.name == "spark" else f"arg_max({x}, position) FILTER ({x} IS NOT NULL)"
    fields = ("upload_id", "resume_token", "expires_at", "data")
    newest = ", ".join(f"{last(x)} AS {x}" for x in fields)
    return f"SELECT c.manifest_id, c.name, {', '.join(f'coalesce(n.{x}, c.{x}) AS {x}' for x in fields)} FROM {{current}} c LEFT JOIN (SELECT manifest_id, {newest} FROM {{log}} GROUP BY manifest_id) n ON n.manifest_id = c.manifest_id"


@operator("legacy_s3")
def legacy_s3(d):
    """Records without receipts that a multipart upload cannot resume, since part tags are lost."""
    return "SELECT record_id, uploaded_bytes FROM {resume_records} WHERE schema_version = 'v0.1' AND transport_name = 's3' AND uploaded_bytes > 0"


@operator("redact_resume", bind={"ranges": "record_ranges"})
def redact_resume(d):
    """A record that is safe to show: without manifest, receipts, and the transport's id, token and data; and the names of what was taken out.  Completed ranges stay."""
    return f"""SELECT record_id, r.manifest_id, schema_version, file_name, file_bytes, file_media_type, file_fingerprint, file_last_modified, strategy, chunk_size, total_bytes, total_chunks, transport_name, status, uploaded_bytes, next_index, coalesce(c.ranges, '') AS completed_ranges, created_at, updated_at,
    concat_ws(',', 'resume.manifest', CASE WHEN upload_id IS NOT NULL THEN 'resume.transport.uploadId' END, CASE WHEN resume_token IS NOT NULL THEN 'resume.transport.resumeToken' END, CASE WHEN transport_data IS NOT NULL THEN 'resume.transport.data' END, CASE WHEN schema_version = 'v0.2' AND q.manifest_id IS NOT NULL THEN 'resume.receipts' END) AS redactions
    FROM {{resume_records}} r LEFT JOIN (SELECT DISTINCT manifest_id FROM {{receipts}}) q ON q.manifest_id = r.manifest_id
    LEFT JOIN (SELECT manifest_id, {d.listed("concat(start_index, '-', end_index)", 'start_index')} AS ranges FROM {{ranges}} GROUP BY manifest_id) c ON c.manifest_id = r.manifest_id"""


@operator("tus_reconcile", bind={"remote": "remote_states"})
def tus_reconcile(d):
    """What to do with a chunk of ``start_byte`` to ``end_byte``, given what the server holds: gone, unreadable, skip, send, or a conflict."""
    return f"""SELECT manifest_id, chunk_index, offset_text, CASE WHEN http_status IN (403, 404, 410) THEN 'resume.expired' WHEN held IS NULL OR held < 0 OR held > {SAFE} THEN 'transport.receipt_invalid' WHEN held = end_byte THEN 'skip' WHEN held = start_byte THEN 'send' ELSE 'transport.offset_mismatch' END AS verdict
    FROM (SELECT *, {d.try_long("offset_text")} AS held FROM {{remote}}) t"""


@operator("tus_resume", bind={"remote": "remote_offsets"})
def tus_resume(d):
    """Whether a record can be resumed where the server stands: it needs a token, and the remote offset must be what the record says was sent."""
    return f"""SELECT r.record_id, held AS remote_offset, r.uploaded_bytes, CASE WHEN coalesce(r.resume_token, '') = '' THEN 'transport.resume_failed' WHEN o.http_status IN (403, 404, 410) THEN 'resume.expired' WHEN held IS NULL OR held < 0 OR held > {SAFE} THEN 'transport.receipt_invalid'
    WHEN held <> r.uploaded_bytes THEN 'transport.offset_mismatch' ELSE 'ok' END AS verdict FROM {{resume_records}} r LEFT JOIN (SELECT record_id, http_status, {d.try_long("offset_text")} AS held FROM {{remote}}) o ON o.record_id = r.record_id"""


@operator("missing_extensions", bind={"offers": "extension_offers"}, given={"needed": ("creation", "expiration", "termination")})
def missing_extensions(d, needed):
    """Protocol extensions that are needed and not offered."""
    return f"SELECT offer_id, {d.join(d.except_(list(needed), 'offered'))} AS missing FROM {{offers}}"
