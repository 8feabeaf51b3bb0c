"""Record builders: manifests, identities, headers and scalars."""

from __future__ import annotations

from tallyport.operators.chunks import DEFAULT_CHUNK, SAFE
from tallyport.operators.hashing import _identity
from tallyport.operators.rules import RULES, extension_of, file_checks
from tallyport.plans.registry import operator
from tallyport.plans.views import NOW_ISO


@operator("extension")
def extension(d):
    """What follows the last dot, in lower case; nothing if there is no dot or nothing behind it."""
    return f"SELECT file_id, name, {extension_of(d)} AS extension FROM {{files}}"


@operator("file_identity")
def file_identity(d):
    """What a file is recognised by."""
    return f"SELECT file_id, name, size_bytes, coalesce(nullif(media_type, ''), 'application/octet-stream') AS media_type, 'metadata-sha256' AS algorithm, {d.sha(_identity())} AS fingerprint, last_modified FROM {{files}}"


@operator("manifest", given={"rules": RULES})
def manifest(d, rules):
    """A manifest of each file: original, image, chunking, and whether the file keeps the rules."""
    broken = " OR ".join(f"({c})" for c, _, _ in file_checks(d, rules))
    return f"""SELECT concat('m-', file_id) AS manifest_id, name, {extension_of(d)} AS extension, size_bytes, coalesce(nullif(media_type, ''), 'application/octet-stream') AS media_type, {d.sha(_identity())} AS fingerprint, {d.sha("content")} AS sha256,
    CASE WHEN last_modified IS NOT NULL THEN {d.iso(d.from_ms("last_modified"))} END AS last_modified_at, CASE WHEN width IS NULL THEN 'not_inspected' ELSE 'provided' END AS image_source, width, CASE WHEN width IS NOT NULL THEN height END AS height,
    CAST({DEFAULT_CHUNK} AS BIGINT) AS chunk_size, {d.div(f"size_bytes + {DEFAULT_CHUNK - 1}", str(DEFAULT_CHUNK))} AS total_chunks, NOT ({broken}) AS ok FROM {{files}}"""


@operator("tus_metadata", bind={"entries": "upload_metadata"})
def tus_metadata(d):
    """The upload-metadata header: keys and base64 values, without nulls; null if nothing is left, and an error if a key is no ASCII token."""
    bad = f"max(CASE WHEN value IS NOT NULL AND NOT {d.rlike('entry', '^[A-Za-z0-9_.-]+$')} THEN 1 ELSE 0 END) = 1"
    each = d.listed(f"CASE WHEN value IS NOT NULL THEN concat(entry, ' ', {d.base64('value')}) END", "position")
    return f"SELECT file_id, CASE WHEN NOT {bad} THEN nullif({each}, '') END AS header, CASE WHEN {bad} THEN 'transport.failed' END AS error FROM {{entries}} GROUP BY file_id"


@operator("tus_metadata_map", bind={"uploads": "upload_maps"})
def tus_metadata_map(d):
    """The same header from a map on each row, in the order of its entries; no map, or one with nothing but nulls, gives no header.  A map has each key once."""
    kept = d.map_kept("metadata")
    bad = d.some(kept, "e", f"NOT {d.rlike('e.key', '^[A-Za-z0-9_.-]+$')}")
    shown = d.each(kept, "e", f"concat(e.key, ' ', {d.base64('e.value')})")
    return f"SELECT file_id, CASE WHEN NOT {bad} THEN nullif({d.join(shown)}, '') END AS header, CASE WHEN {bad} THEN 'transport.failed' END AS error FROM {{uploads}}"


@operator("header_list", bind={"headers": "extension_headers"})
def header_list(d):
    """The trimmed, non-empty entries of a comma-separated header."""
    return f"SELECT header_id, {d.tokens('header')} AS entries FROM {{headers}}"


@operator("progress")
def progress(d):
    """Share of bytes, from 0 to 1; an empty file is done only when it is completed."""
    return "SELECT record_id, CASE WHEN total_bytes = 0 THEN CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, CAST(uploaded_bytes AS DOUBLE) / total_bytes)) END AS share FROM {resume_records}"


@operator("control_flags")
def control_flags(d):
    """Which controls each session status allows."""
    return """SELECT status, status IN ('idle', 'failed', 'completed', 'canceled') AS can_start, status IN ('uploading', 'resuming') AS can_pause, status IN ('starting', 'uploading', 'resuming', 'completing', 'paused') AS can_cancel
    FROM (SELECT DISTINCT status FROM {resume_records} UNION SELECT 'idle' UNION SELECT 'starting' UNION SELECT 'uploading' UNION SELECT 'resuming' UNION SELECT 'completing') s"""


@operator("tiff_color_depth")
def tiff_color_depth(d):
    """Colour depth of an image: the largest number of bits of a sample."""
    return "SELECT image_id, CAST(max(bits) AS BIGINT) AS color_depth, count(*) AS samples FROM {samples} GROUP BY image_id"


@operator("retry_delay", bind={"retries": "retries"})
def retry_delay(d):
    """Delay before each retry by the policy on its row: grows by a factor, is capped, and with full jitter is a share (``draw``) of that."""
    capped = f"least(coalesce(delay_ms, 0) * power(coalesce(backoff_factor, 1.0), greatest(0, attempt - 1)), coalesce(max_delay_ms, {SAFE}))"
    return f"SELECT event_id, attempt, CAST(CASE WHEN jitter = 'full' THEN floor(draw * {capped}) ELSE {capped} END AS DOUBLE) AS delay_ms FROM {{retries}}"


@operator("retry_policy", bind={"policies": "retry_policies"})
def retry_policy(d):
    """Retry policies with their defaults, and the first field that is out of range."""
    number = lambda x: f"NOT coalesce({x} >= 0 AND {x} < CAST('Infinity' AS DOUBLE), false)"
    return f"""SELECT policy_id, max_attempts, delay_ms, backoff_factor, max_delay_ms, jitter, CASE WHEN NOT coalesce(max_attempts >= 1 AND max_attempts <= {SAFE} AND max_attempts = floor(max_attempts), false) THEN 'retryPolicy.maxAttempts' WHEN {number('delay_ms')} THEN 'retryPolicy.delayMs'
    WHEN {number('backoff_factor')} OR backoff_factor < 1 THEN 'retryPolicy.backoffFactor' WHEN {number('max_delay_ms')} THEN 'retryPolicy.maxDelayMs' END AS invalid
    FROM (SELECT policy_id, coalesce(max_attempts, coalesce(legacy_retries, 2) + 1) AS max_attempts, coalesce(delay_ms, 0.0) AS delay_ms, coalesce(backoff_factor, 1.0) AS backoff_factor, coalesce(max_delay_ms, CAST({SAFE} AS DOUBLE)) AS max_delay_ms, coalesce(jitter, 'none') AS jitter FROM {{policies}}) p"""


@operator("retryable")
def retryable(d):
    """Whether a status is worth a retry."""
    return "SELECT manifest_id, chunk_index, http_status, http_status IN (408, 425, 429) OR http_status >= 500 AS retryable FROM {remote_states}"


@operator("iso_valid", bind={"stamps": "shown_stamps"})
def iso_valid(d):
    """Whether a text is a timestamp in the one strict form, to the millisecond."""
    return f"SELECT record_id, shown, {is_iso(d, 'shown')} AS valid FROM {{stamps}}"


def is_iso(d, x: str) -> str:
    """SQL for that; false for null."""
    pattern = r"^\d\d\d\d-\d\d-\d\dT\d\d:\d\d:\d\d\.\d\d\dZ$"
    return f"CASE WHEN {d.rlike(x, pattern)} THEN coalesce({d.iso(d.stamp(x))} = {x}, false) ELSE false END"


@operator("staged_name", bind={"staged": "staged"})
def staged_name(d):
    """The name under which a chunk of a session is staged: its index in eight digits, and its generation."""
    return f"SELECT session_id, chunk_index, generation, concat(lpad(CAST(chunk_index AS {d.string}), CAST(greatest(8, length(CAST(chunk_index AS {d.string}))) AS INT), '0'), '-', generation, '.part') AS name FROM {{staged}}"


@operator("snapshot_error", bind={"errors": "event_errors"})
def snapshot_error(d):
    """What a snapshot says of an error: a coded one as it is, any other as a failed transfer that is not retried."""
    coded = "code IS NOT NULL AND retryable IS NOT NULL"
    return f"SELECT event_id, CASE WHEN {coded} THEN code ELSE 'transport.failed' END AS code, CASE WHEN {coded} THEN message ELSE coalesce(message, 'Upload failed.') END AS message, coalesce({coded} AND retryable, false) AS retryable FROM {{errors}}"


@operator("normalize_session", bind={"raw": "raw_sessions"}, given={"now": NOW_ISO})
def normalize_session(d, now):
    """A transport's session in one shape: its own name or the transport's, creation now if it says none, and expiry and token from the fallback where it has none."""
    return f"""SELECT upload_id, coalesce(session_transport, transport_name) AS transport_name, coalesce(created_at, {now}) AS created_at, coalesce(expires_at, fallback_expires_at) AS expires_at,
    coalesce(resume_token, fallback_resume_token) AS resume_token, secrets_ref, coalesce(remote, data) AS remote FROM {{raw}}"""


@operator("normalize_receipts", bind={"results": "chunk_results"}, given={"now": NOW_ISO})
def normalize_receipts(d, now):
    """A receipt for each chunk that was sent: the transport's own, or one made of the chunk where it gave none."""
    given = "receipt_chunk_index IS NOT NULL AND receipt_size_bytes IS NOT NULL AND receipt_transport IS NOT NULL"
    return f"""SELECT manifest_id, chunk_index, CASE WHEN {given} THEN receipt_size_bytes ELSE size_bytes END AS size_bytes, CASE WHEN {given} THEN receipt_transport ELSE transport_name END AS transport,
    CASE WHEN {given} THEN receipt_completed_at ELSE {now} END AS completed_at, CASE WHEN {given} AND (receipt_chunk_index <> chunk_index OR receipt_size_bytes <> size_bytes) THEN 'transport.receipt_invalid' ELSE 'ok' END AS verdict FROM {{results}}"""
