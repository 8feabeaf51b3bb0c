"""Session events and gateway sessions: status, redaction, expiry, staged chunks and locks."""

from __future__ import annotations

from tallyport.operators.chunks import SAFE
from tallyport.operators.rules import contained
from tallyport.plans.registry import operator
from tallyport.plans.views import NOW

REDACTED = "Error details redacted."
# Fixed patterns: messages that may give away a secret; names of chunk files that the gateway itself writes, and of candidates for a
# session document; session ids.
SECRETS = r"(?i)https?://|credential|authorization|presigned|resume token"
MANAGED = r"^\d\d\d\d\d\d\d\d(-[A-Za-z0-9-]+)?\.part(\.[A-Za-z0-9-]+\.tmp|\.tmp)?$"
CANDIDATE = r"^metadata\.json\.candidate-.*\.tmp$"
SESSION_ID = "^[A-Za-z0-9_-]+$"
TERMINAL = "('completed', 'upload:canceled')"


def sanitized(d, x: str) -> str:
    return f"CASE WHEN {d.rlike(x, SECRETS)} THEN '{REDACTED}' ELSE {x} END"


@operator("sanitize")
def sanitize(d):
    """Messages, with those that may give away a secret replaced."""
    return f"SELECT event_id, {sanitized(d, 'message')} AS message FROM {{ingest_events}} WHERE message IS NOT NULL"


@operator("safe_events")
def safe_events(d):
    """The part of each event that is safe to show, by its type."""
    error = "type IN ('retry', 'resume:conflict', 'resume:cleanup-failed', 'failed')"
    fallback = "coalesce(code, CASE WHEN type IN ('resume:conflict', 'resume:cleanup-failed') THEN 'resume' ELSE 'unknown' END)"
    return f"""SELECT event_id, type, CASE WHEN type IN ('chunk:started', 'chunk:completed', 'retry') THEN chunk_index END AS chunk_index, CASE WHEN type = 'retry' THEN attempt END AS attempt, CASE WHEN type IN ('chunk:completed', 'snapshot') THEN uploaded_bytes END AS uploaded_bytes,
    CASE type WHEN 'upload:paused' THEN 'paused' WHEN 'upload:canceled' THEN 'canceled' END AS status, CASE WHEN {error} THEN {fallback} END AS error_code, CASE WHEN {error} THEN {sanitized(d, "coalesce(message, 'Operation failed.')")} END AS error_message,
    CASE WHEN type IN ('validated', 'started', 'completed') THEN 'manifest' END AS redactions FROM {{ingest_events}}"""


def _redacted(prefix: str) -> str:
    """SQL: which secrets a session has, by the names that a caller shows."""
    return f"concat_ws(',', CASE WHEN s.resume_token IS NOT NULL THEN '{prefix}resumeToken' END, CASE WHEN s.secrets_ref IS NOT NULL THEN '{prefix}secretsRef' END, CASE WHEN s.remote IS NOT NULL THEN '{prefix}remote' END)"


_RECEIPT_SECRETS = ("etag", "location", "opaque")


@operator("redact_snapshot", bind={"state": "snapshots"})
def redact_snapshot(d):
    """Snapshots without the session's token, secret reference and remote state, and the names of what was taken out of session and receipts."""
    tagged = ", ".join(f"max(CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END) AS has_{x}" for x in _RECEIPT_SECRETS)
    fields = ", ".join(f"CASE WHEN h.has_{x} = 1 THEN 'snapshot.completedChunks.transport.{x}' END" for x in _RECEIPT_SECRETS)
    return f"""SELECT s.manifest_id, s.status, s.uploaded_bytes, s.upload_id, s.transport_name, s.expires_at, {_redacted('snapshot.transportSession.')} AS session_fields, concat_ws(',', {fields}) AS receipt_fields
    FROM {{state}} s LEFT JOIN (SELECT manifest_id, {tagged} FROM {{receipts}} GROUP BY manifest_id) h ON h.manifest_id = s.manifest_id"""


@operator("redact_receipts")
def redact_receipts(d):
    """Receipts without what their transport keeps to itself, and the names of what was taken out."""
    fields = ", ".join(f"CASE WHEN {x} IS NOT NULL THEN 'transport.{x}' END" for x in _RECEIPT_SECRETS)
    return f"SELECT manifest_id, chunk_index, position, size_bytes, transport, part_number, concat_ws(',', {fields}) AS redactions FROM {{receipts}}"


@operator("redact_session", bind={"state": "snapshots"})
def redact_session(d):
    """Transport sessions without secrets, and the names of what was taken out, as a session names them."""
    return f"SELECT s.manifest_id, s.upload_id, s.transport_name, s.expires_at, {_redacted('')} AS redactions FROM {{state}} s"


@operator("session_status")
def session_status(d):
    """Status of each session from its events: the first terminal one stays, otherwise the latest counts."""
    status = "CASE type WHEN 'upload:paused' THEN 'paused' WHEN 'resume:started' THEN 'resuming' WHEN 'completed' THEN 'completed' WHEN 'upload:canceled' THEN 'canceled' WHEN 'failed' THEN 'failed' ELSE 'uploading' END"
    return f"""SELECT session_id, status FROM (SELECT session_id, {status} AS status, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN type IN {TERMINAL} THEN 0 ELSE 1 END, CASE WHEN type IN {TERMINAL} THEN event_id ELSE -event_id END) AS place
    FROM {{ingest_events}} WHERE type NOT IN ('resume:cleanup-failed', 'validated', 'resume:conflict')) t WHERE place = 1"""


@operator("retry_stats", given={"max_attempts": 3})
def retry_stats(d, max_attempts=3):
    """Retries of each session, and how many went beyond the number of attempts."""
    return f"SELECT session_id, count(*) AS retries, max(attempt) AS most, count(CASE WHEN attempt >= {max_attempts} THEN 1 END) AS exhausted FROM {{ingest_events}} WHERE type = 'retry' GROUP BY session_id"


@operator("retry_outcome", given={"max_attempts": 3})
def retry_outcome(d, max_attempts=3):
    """How the attempts at each chunk end, in the order they were made, and how many retries that took.

    The first that succeeds ends them, or that fails when the upload was canceled, paused or aborted, with an error that forbids a retry (by itself
    or by the policy's own test), or as the last that is allowed; with none of these a chunk waits for its next attempt.
    """
    ending = f"""CASE WHEN error_code IS NULL THEN 'completed' WHEN lifecycle = 'cancel' THEN 'canceled' WHEN lifecycle = 'pause' THEN 'paused' WHEN lifecycle = 'abort' THEN 'aborted'
    WHEN NOT coalesce(retryable, true) THEN 'refused' WHEN NOT coalesce(policy_allows, true) THEN 'declined' WHEN attempt >= {max_attempts} THEN 'exhausted' END"""
    return f"""SELECT manifest_id, chunk_index, outcome, CASE WHEN outcome = 'waiting' THEN attempt ELSE attempt - 1 END AS retries, CASE WHEN outcome <> 'completed' THEN error_code END AS error_code
    FROM (SELECT *, coalesce(ending, 'waiting') AS outcome, row_number() OVER (PARTITION BY manifest_id, chunk_index ORDER BY CASE WHEN ending IS NULL THEN 1 ELSE 0 END, CASE WHEN ending IS NULL THEN -attempt ELSE attempt END) AS place
    FROM (SELECT *, {ending} AS ending FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, chunk_index ORDER BY position) AS attempt FROM {{attempts}}) n) e) o WHERE place = 1"""


@operator("cleanup_failures")
def cleanup_failures(d):
    """Completed sessions whose record could not be cleaned up; they stay completed."""
    return "SELECT session_id, count(CASE WHEN type = 'resume:cleanup-failed' THEN 1 END) AS failures FROM {ingest_events} GROUP BY session_id HAVING count(CASE WHEN type = 'completed' THEN 1 END) > 0 AND count(CASE WHEN type = 'resume:cleanup-failed' THEN 1 END) > 0"


@operator("latest_chunk")
def latest_chunk(d):
    """The staged record of each chunk: the last one written."""
    return "SELECT session_id, chunk_index, generation, path, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY session_id, chunk_index ORDER BY generation DESC) AS place FROM {staged}) t WHERE place = 1"


@operator("nas_sessions", bind={"raw": "nas_sessions_raw"})
def nas_sessions(d):
    """Session documents in the supported version; others count as absent."""
    return f"SELECT session_id, folder, status, expected_chunks, total_bytes, CASE WHEN expires_at IS NOT NULL THEN {d.iso('expires_at')} END AS expires_at FROM {{raw}} WHERE schema_version = 'nas.v0.1'"


@operator("nas_list", bind={"raw": "nas_sessions_raw"})
def nas_list(d):
    """Folders whose names can be session ids."""
    return f"SELECT folder FROM {{raw}} WHERE {d.rlike('folder', SESSION_ID)}"


def _expiry(d, given: str, start: str, lives_ms: int | None) -> str:
    """SQL: when a session expires, as it says or ``lives_ms`` after its start; without either it never does."""
    said = f"CAST({given} AS TIMESTAMP)"
    return d.iso(said if lives_ms is None else f"coalesce({said}, {d.plus_ms(start, str(lives_ms))})")


@operator("nas_expiry", bind={"raw": "nas_sessions_raw"}, given={"lives_ms": 86400000})
def nas_expiry(d, lives_ms=None):
    """When a session expires: as said, or else ``lives_ms`` after it was made, if there is such a default."""
    return f"SELECT session_id, {_expiry(d, 'expires_at', 'created_at', lives_ms)} AS expires_at FROM {{raw}}"


@operator("nas_gate", bind={"raw": "nas_sessions_raw"}, given={"now": NOW})
def nas_gate(d, now):
    """Why a session takes no chunk: shape, id, closed, or expired; the first reason counts."""
    return f"SELECT session_id, CASE WHEN expected_chunks <= 0 OR total_bytes NOT BETWEEN 0 AND {SAFE} THEN 'nas.invalid_session' WHEN NOT {d.rlike('folder', SESSION_ID)} THEN 'nas.invalid_session' WHEN status <> 'staging' THEN 'nas.session_closed' WHEN coalesce(expires_at <= {now}, false) THEN 'nas.session_expired' ELSE 'ok' END AS verdict FROM {{raw}}"


@operator("nas_sweep", bind={"raw": "nas_sessions_raw"}, given={"now": NOW})
def nas_sweep(d, now):
    """Sessions to remove: canceled or expired, finalized ones too."""
    return f"SELECT session_id, folder, status FROM {{raw}} WHERE schema_version = 'nas.v0.1' AND {d.rlike('folder', SESSION_ID)} AND (status = 'canceled' OR coalesce(expires_at <= {now}, false))"


@operator("nas_create", bind={"requests": "nas_requests", "raw": "nas_sessions_raw"}, given={"now": NOW, "lives_ms": 86400000})
def nas_create(d, now, lives_ms=None):
    """New session documents, or why a request for one is refused: shape, id, target, or an id that is taken."""
    safe = contained(d, "target")
    return f"""SELECT q.folder, CASE WHEN verdict = 'ok' THEN 'staging' END AS status, CASE WHEN verdict = 'ok' THEN {d.iso(now)} END AS created_at, CASE WHEN verdict = 'ok' THEN {_expiry(d, 'expires_at', now, lives_ms)} END AS expires_at, verdict
    FROM (SELECT r.*, CASE WHEN NOT coalesce(expected_chunks BETWEEN 1 AND {SAFE} AND total_bytes BETWEEN 0 AND {SAFE}, false) THEN 'nas.invalid_session' WHEN NOT {d.rlike('r.folder', SESSION_ID)} THEN 'nas.invalid_session' WHEN NOT ({safe}) THEN 'nas.unsafe_path' WHEN k.folder IS NOT NULL THEN 'nas.invalid_session' ELSE 'ok' END AS verdict
    FROM {{requests}} r LEFT JOIN (SELECT DISTINCT folder FROM {{raw}}) k ON k.folder = r.folder) q"""


@operator("nas_cancel", bind={"raw": "nas_sessions_raw"}, given={"now": NOW})
def nas_cancel(d, now):
    """Session documents after they are asked to be canceled: an open one is canceled now, expired or not; any other stays and says why."""
    return f"""SELECT session_id, CASE WHEN verdict = 'ok' THEN 'canceled' ELSE status END AS status, CASE WHEN verdict = 'ok' THEN {d.iso(now)} END AS canceled_at, verdict
    FROM (SELECT *, CASE WHEN status <> 'staging' THEN 'nas.session_closed' ELSE 'ok' END AS verdict FROM {{raw}} WHERE schema_version = 'nas.v0.1') t"""


@operator("nas_finalize_check", bind={"raw": "nas_sessions_raw"})
def nas_finalize_check(d):
    """Whether the staged chunks of each session are all there, are still what was recorded (by size, and by digest where one is), and add up.

    The number of chunks counts first, then the first chunk with a fault, then the sum; a session with nothing staged lacks its chunks.
    """
    last = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, chunk_index ORDER BY generation DESC) AS latest FROM {staged}) q WHERE latest = 1)"
    placed = f"(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY chunk_index) - 1 AS place FROM {last} l)"
    fault = f"CASE WHEN chunk_index <> place THEN 0 WHEN size_bytes <> {d.octets('body')} THEN 1 WHEN sha256 <> {d.sha('body')} THEN 2 END"
    return f"""SELECT r.session_id, coalesce(s.chunks, 0) AS chunks, coalesce(s.bytes, 0) AS bytes, CASE WHEN coalesce(s.chunks, 0) <> r.expected_chunks OR s.fault % 3 = 0 THEN 'nas.chunk_missing' WHEN s.fault % 3 = 1 THEN 'nas.invalid_chunk' WHEN s.fault % 3 = 2 THEN 'nas.checksum_mismatch' WHEN coalesce(s.bytes, 0) <> r.total_bytes THEN 'nas.invalid_chunk' ELSE 'ok' END AS verdict
    FROM {{raw}} r LEFT JOIN (SELECT session_id, count(*) AS chunks, CAST(sum(size_bytes) AS BIGINT) AS bytes, min(3 * place + {fault}) AS fault FROM {placed} p GROUP BY session_id) s ON s.session_id = r.session_id"""


@operator("nas_metadata", bind={"raw": "nas_sessions_raw"}, given={"now": NOW})
def nas_metadata(d, now):
    """The document of each session, as it is written: its fields and the latest record of each chunk, absent ones left out, two spaces a level."""
    string = lambda key, x: f"concat('  \"{key}\": ', {d.json_string(x)})"
    number = lambda key, x: f"concat('  \"{key}\": ', CAST({x} AS {d.string}))"
    last = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, chunk_index ORDER BY generation DESC) AS latest FROM {staged}) q WHERE latest = 1)"
    checksum = f"CASE WHEN sha256 IS NOT NULL THEN concat(chr(10), '      \"checksum\": {{{{', chr(10), '        \"algorithm\": \"sha256\",', chr(10), '        \"value\": ', {d.json_string('sha256')}, chr(10), '      }}}}') END"
    record = f"concat(chr(10), '    {{{{', concat_ws(',', concat(chr(10), '      \"index\": ', CAST(chunk_index AS {d.string})), concat(chr(10), '      \"path\": ', {d.json_string('path')}), concat(chr(10), '      \"sizeBytes\": ', CAST(size_bytes AS {d.string})), {checksum}), chr(10), '    }}}}')".replace("{{", "{").replace("}}", "}")
    chunks = f"(SELECT session_id, {d.listed(record, 'chunk_index')} AS records FROM {last} l GROUP BY session_id)"
    fields = [
        string("schemaVersion", "schema_version"), string("sessionId", "folder"), string("status", "status"), string("createdAt", d.iso("created_at")), string("updatedAt", d.iso(now)), f"CASE WHEN expires_at IS NOT NULL THEN {string('expiresAt', d.iso('expires_at'))} END",
        string("targetRelativePath", "target"), number("totalBytes", "total_bytes"), number("expectedChunks", "expected_chunks"), "CASE WHEN c.records IS NULL THEN '  \"chunks\": []' ELSE concat('  \"chunks\": [', c.records, chr(10), '  ]') END",
    ]
    return f"""SELECT r.session_id, folder, concat('{{', chr(10), concat_ws(concat(',', chr(10)), {', '.join(fields)}), chr(10), '}}', chr(10)) AS document FROM {{raw}} r LEFT JOIN {chunks} c ON c.session_id = r.session_id WHERE schema_version = 'nas.v0.1'"""


@operator("orphan_chunks", bind={"listing": "staged_listing", "recorded": "staged_recorded"})
def orphan_chunks(d):
    """Files that the gateway wrote, by their names, and that no record refers to: chunks, and candidates for the session's document, which none ever does."""
    return f"SELECT f.session_id, f.path FROM {{listing}} f {d.anti} JOIN {{recorded}} k ON k.session_id = f.session_id AND k.path = f.path WHERE {d.rlike('f.path', MANAGED)} OR {d.rlike('f.path', CANDIDATE)}"


@operator("lock_stale", bind={"locks": "locks"}, given={"now": NOW, "stale_ms": 864000000})
def lock_stale(d, now, stale_ms):
    """Locks that are at least as old as ``stale_ms``."""
    return f"SELECT lock_id, {d.millis(now)} - {d.millis('acquired_at')} >= {stale_ms} AS stale FROM {{locks}}"


@operator("lock_release", bind={"locks": "locks", "releases": "lock_releases"})
def lock_release(d):
    """What becomes of each lock that is asked to be released: its owner frees it, another (whose lock was taken over when stale) leaves it held."""
    return "SELECT r.lock_id, r.owner_id, CASE WHEN k.lock_id IS NULL THEN 'absent' WHEN k.owner_id = r.owner_id THEN 'released' ELSE 'held' END AS outcome FROM {releases} r LEFT JOIN {locks} k ON k.lock_id = r.lock_id"
