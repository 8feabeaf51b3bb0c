"""Rules on files, manifests, identities, receipts and paths; an issue is a row, and the order of issues is a column."""

from __future__ import annotations

from tallyport.operators.chunks import LEAST_CHUNK, SAFE
from tallyport.operators.hashing import checksum_verdict
from tallyport.operators.rules import RULES, contained, dimension_checks, file_checks
from tallyport.plans.registry import operator


@operator("validate_files", given={"rules": RULES})
def validate_files(d, rules):
    """Every issue of every file, in rule order."""
    return d.issues("{files}", ["file_id"], file_checks(d, rules))


@operator("validate_dimensions", given={"rules": RULES})
def validate_dimensions(d, rules):
    """The rules on image size alone; where the size is unknown, the other four do not apply."""
    return d.issues("{files}", ["file_id"], dimension_checks(rules))


@operator("result_ok", given={"rules": RULES})
def result_ok(d, rules):
    """A file is valid if it has no issue; and how many it has."""
    return f"SELECT f.file_id, count(i.ordinal) AS issues, count(i.ordinal) = 0 AS ok FROM {{files}} f LEFT JOIN ({d.issues('{files}', ['file_id'], file_checks(d, rules))}) i ON i.file_id = f.file_id GROUP BY f.file_id"


def manifest_checks(d) -> list[tuple[str, str, str]]:
    """Structure of a manifest; without an original, or without chunking, what would follow is not looked at."""
    bad = "verification.manifest_invalid"
    there, both = "kind IS NOT NULL", "kind IS NOT NULL AND strategy IS NOT NULL"
    plannable = f"{both} AND size_bytes BETWEEN 0 AND {SAFE} AND chunk_size BETWEEN 1 AND {SAFE}"
    found = [
        ("version IS DISTINCT FROM 'v1'", "verification.manifest_schema_unsupported", "'schemaVersion'"),
        ("kind IS NULL", bad, "'original'"),
        (f"{there} AND kind <> 'original'", bad, "'original.kind'"),
        (f"{there} AND coalesce(name, '') = ''", bad, "'original.name'"),
        (f"{there} AND NOT coalesce(size_bytes BETWEEN 0 AND {SAFE}, false)", bad, "'original.sizeBytes'"),
        (f"{there} AND coalesce(media_type, '') = ''", bad, "'original.mediaType'"),
        (f"{there} AND NOT preserved", bad, "'original.preservation'"),
        (f"{there} AND coalesce(scope, 'whole-file') <> 'whole-file'", bad, "'original.checksum'"),
        (f"{there} AND strategy IS NULL", bad, "'chunking'"),
        (f"{both} AND strategy <> 'fixed-size'", bad, "'chunking.strategy'"),
        (f"{both} AND inlined", bad, "'chunking.chunkRangesIncluded'"),
        (f"{both} AND chunk_total IS DISTINCT FROM size_bytes", bad, "'chunking.totalBytes'"),
        (f"{plannable} AND chunk_size >= {LEAST_CHUNK} AND total_chunks <> {d.div('size_bytes + chunk_size - 1', 'chunk_size')}", bad, "'chunking.totalChunks'"),
        (f"{plannable} AND chunk_size < {LEAST_CHUNK}", bad, "'chunking'"),
        (f"{both} AND NOT valid", bad, "'validation.ok'"),
    ]
    return [(f"coalesce({c}, false)", code, path) for c, code, path in found]


def identity_checks(when: str = "true") -> list[tuple[str, str, str]]:
    """Where a file (``actual_...``) differs from what its manifest says."""
    code = "verification.original_mismatch"
    found = [
        ("coalesce(name <> actual_name, true)", code, "'original.name'"),
        ("coalesce(size_bytes <> actual_bytes, true)", code, "'original.sizeBytes'"),
        ("CASE media_type WHEN '' THEN 'application/octet-stream' ELSE media_type END IS DISTINCT FROM coalesce(nullif(actual_type, ''), 'application/octet-stream')", code, "'original.mediaType'"),
        ("coalesce(modified <> actual_modified, false)", code, "'original.lastModifiedAt'"),
    ]
    return [(f"{when} AND {c}", code, path) for c, code, path in found]


def checksum_checks(policy: str, when: str, found: str) -> list[tuple[str, str, str]]:
    """The checksum policy as issues."""
    verdict = checksum_verdict(policy, found)
    paths = [("verification.checksum_missing", "original.checksum"), ("verification.checksum_unsupported", "original.checksum.algorithm"), ("verification.checksum_mismatch", "original.checksum.value")]
    return [(f"{when} AND {verdict} = '{code}'", code, f"'{path}'") for code, path in paths]


@operator("verify_manifest", bind={"stored": "stored_manifests"})
def verify_manifest(d):
    """Every structural issue of every stored manifest."""
    return d.issues("{stored}", ["manifest_id"], manifest_checks(d))


@operator("verify_identity", bind={"pairs": "file_pairs"})
def verify_identity(d):
    """Where a file differs from its manifest: name, size, media type (unknown is octet-stream) and time of change."""
    return d.issues("{pairs}", ["file_id"], identity_checks())


@operator("verify_manifest_file", bind={"stored": "stored_manifests"}, given={"policy": "required"})
def verify_manifest_file(d, policy="when-present"):
    """A stored manifest and its file, if there is one: structure, then identity, then the checksum policy."""
    return d.issues("{stored}", ["manifest_id"], _manifest_stages(d, policy))


def _manifest_stages(d, policy: str) -> list[tuple[str, str, str]]:
    there, usable = "kind IS NOT NULL", "has_file"
    return [*manifest_checks(d), *identity_checks(f"{there} AND {usable}"), *checksum_checks(policy, f"{there} AND coalesce(scope, 'whole-file') = 'whole-file'", usable)]


@operator("verify_stored", bind={"pairs": "file_pairs"}, given={"regular": "regular"})
def verify_stored(d, regular="true"):
    """A stored file against its manifest: not found, no regular file (by the column ``regular``, if it is given), then size, and only for equal sizes the checksum."""
    return f"""SELECT file_id, CASE WHEN NOT found THEN 'verification.file_not_found' WHEN NOT coalesce({regular}, false) THEN 'verification.file_unreadable' WHEN size_bytes <> actual_bytes THEN 'verification.original_mismatch' WHEN lower(expected) <> {d.sha("content")} THEN 'verification.checksum_mismatch' ELSE 'ok' END AS verdict FROM {{pairs}}"""


#: A receipt whose numbers can be used, of a chunk of the plan.
_INDEX, _SIZE = f"coalesce(r.chunk_index BETWEEN 0 AND {SAFE}, false)", f"coalesce(r.size_bytes BETWEEN 0 AND {SAFE}, false)"


def _numbered(of: str, wanted: str) -> str:
    """Manifests (``of_manifest``) beside their receipts, one row without if there is none; ``counted`` marks, of each chunk, the first in position with a size that can be used."""
    fine = f"{_INDEX} AND r.chunk_index < m.total_chunks"
    return f"""(SELECT *, manifest_id IS NOT NULL AS there, coalesce(inside AND whole AND position = first_whole, false) AS counted, coalesce(inside AND position > first_whole, false) AS again FROM (SELECT r.*, m.manifest_id AS of_manifest, m.total_chunks, {wanted} AS wanted, m.total_bytes, {fine} AS inside, {_SIZE} AS whole,
    least(m.chunk_size, m.total_bytes - r.chunk_index * m.chunk_size) AS expected, min(CASE WHEN {_SIZE} THEN r.position END) OVER (PARTITION BY m.manifest_id, r.chunk_index) AS first_whole FROM {of} m LEFT JOIN {{receipts}} r ON r.manifest_id = m.manifest_id) n)"""


@operator("verify_receipts")
def verify_receipts(d, require_chunk_checksums=False, allow_partial=False):
    """Receipts against plans: one row per manifest with what is wrong, and whether anything is.

    Of several receipts for a chunk the first in position counts.  Receipts outside the plan and duplicates do not add to the
    bytes; receipts of the wrong size do.
    """
    unproven = "count(CASE WHEN r.counted AND r.checksum IS NULL THEN 1 END)" if require_chunk_checksums else "CAST(0 AS BIGINT)"
    good = "count(CASE WHEN r.counted AND r.size_bytes = r.expected AND coalesce(r.transport, '') <> '' AND coalesce(r.transport = r.wanted, true) THEN 1 END)"
    whole = "count(r.position)" if allow_partial else "r.total_chunks"
    bytes_ = "coalesce(sum(CASE WHEN r.counted THEN r.size_bytes END), 0)"
    return f"""SELECT r.of_manifest AS manifest_id, count(r.position) AS receipts, count(CASE WHEN r.there AND NOT r.inside THEN 1 END) AS outside, count(CASE WHEN r.again THEN 1 END) AS duplicates,
    count(CASE WHEN r.inside AND NOT r.again AND (NOT r.whole OR r.size_bytes <> r.expected) THEN 1 END) AS wrong_size, count(CASE WHEN r.counted AND coalesce(r.transport, '') = '' THEN 1 END) AS no_transport, count(CASE WHEN r.counted AND r.transport <> '' AND r.transport <> r.wanted THEN 1 END) AS other_transport,
    {unproven} AS no_checksum, r.total_chunks - count(CASE WHEN r.counted THEN 1 END) AS missing, CAST({bytes_} AS BIGINT) AS uploaded_bytes, r.total_bytes, count(r.position) = {whole} AND {good} = {whole} AND {unproven} = 0{'' if allow_partial else f' AND {bytes_} = r.total_bytes'} AS ok
    FROM {_numbered('{manifests}', 'm.transport')} r GROUP BY r.of_manifest, r.total_chunks, r.total_bytes"""


#: Without either there is no plan; and whether what there is can be planned with.
_BARE = "kind IS NULL OR strategy IS NULL"
_PLANNED = f"coalesce(total_bytes BETWEEN 0 AND {SAFE} AND chunk_size BETWEEN 1 AND {SAFE} AND total_chunks BETWEEN 0 AND {SAFE}, false)"


def _receipt_issues(d, require_chunk_checksums: bool, allow_partial: bool) -> str:
    """Issues of receipts by position, then, from the first row of each manifest, those of the whole set; manifests that cannot be planned with have none."""
    code = "verification.receipt_invalid"
    at = lambda what: f"concat('receipts[', position, '].{what}')"
    rows = _numbered(f"(SELECT * FROM {{stored}} WHERE NOT ({_BARE}) AND {_PLANNED})", "m.transport")
    each = [
        ("there AND NOT inside", code, at("chunkIndex")),
        ("again", "verification.receipt_duplicate", at("chunkIndex")),
        ("inside AND NOT again AND NOT whole", code, at("sizeBytes")),
        ("counted AND size_bytes <> expected", code, at("sizeBytes")),
        ("counted AND coalesce(transport, '') = ''", code, at("transport.name")),
        ("coalesce(counted AND transport <> '' AND transport <> wanted, false)", "verification.transport_mismatch", at("transport.name")),
        *([("counted AND checksum IS NULL", "verification.checksum_missing", at("checksum"))] if require_chunk_checksums else []),
    ]
    total = []
    if not allow_partial:
        over = "OVER (PARTITION BY of_manifest)"
        rows = f"(SELECT *, count(CASE WHEN counted THEN 1 END) {over} AS seen, coalesce(sum(CASE WHEN counted THEN size_bytes END) {over}, 0) AS bytes, row_number() OVER (PARTITION BY of_manifest ORDER BY position) AS nth FROM {rows} o)"
        total = [("nth = 1 AND seen < total_chunks", "verification.receipt_missing", "'receipts'"), ("nth = 1 AND bytes <> total_bytes", "verification.receipt_incomplete", "'receipts'")]
    found = d.issues(f"{rows} t", ["of_manifest", "position"], each + total)
    return f"SELECT of_manifest AS manifest_id, CASE WHEN ordinal > {len(each)} THEN CAST({SAFE} AS BIGINT) ELSE position END AS position, ordinal, code, path FROM ({found}) f"


def _integrity(d, policy: str, require_chunk_checksums: bool, allow_partial: bool) -> str:
    """A manifest that cannot be planned with has one issue in place of those of its receipts."""
    bad = "verification.manifest_invalid"
    structure = d.issues("{stored}", ["manifest_id"], [*_manifest_stages(d, policy), (_BARE, bad, "'manifest'"), (f"NOT ({_BARE}) AND NOT {_PLANNED}", bad, "'chunking'")])
    return f"""SELECT manifest_id, CAST(row_number() OVER (PARTITION BY manifest_id ORDER BY stage, position, ordinal) AS BIGINT) AS place, code, path FROM (SELECT manifest_id, 1 AS stage, CAST(0 AS BIGINT) AS position, ordinal, code, path FROM ({structure}) s
    UNION ALL SELECT manifest_id, 2, position, ordinal, code, path FROM ({_receipt_issues(d, require_chunk_checksums, allow_partial)}) r) u"""


_FULL = {"policy": "required", "require_chunk_checksums": True, "allow_partial": False}


@operator("verify_integrity", bind={"stored": "stored_manifests"}, given=_FULL)
def verify_integrity(d, policy="when-present", require_chunk_checksums=False, allow_partial=False):
    """All issues of an upload as one list: structure of the manifest, identity of its file, checksum, then its receipts, in order."""
    return _integrity(d, policy, require_chunk_checksums, allow_partial)


@operator("safe_verification", bind={"stored": "stored_manifests"}, given=_FULL)
def safe_verification(d, policy="when-present", require_chunk_checksums=False, allow_partial=False):
    """The part of a verification that is safe to show: of every issue, in order, its code, path and severity."""
    return f"SELECT manifest_id, place, code, path, 'error' AS severity FROM ({_integrity(d, policy, require_chunk_checksums, allow_partial)}) i"


@operator("safe_path", bind={"sessions": "nas_sessions_raw"})
def safe_path(d):
    """Whether a target stays below its root: relative, not empty, without a NUL character, and never above where it starts; no target does not."""
    return f"SELECT session_id, target, {contained(d, 'target')} AS safe FROM {{sessions}}"
