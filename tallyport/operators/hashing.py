"""Digests and fingerprints."""

from __future__ import annotations

from tallyport.operators.chunks import sliced
from tallyport.plans.registry import operator


@operator("file_sha256")
def file_sha256(d):
    """The digest of each whole file, and its size."""
    return f"SELECT file_id, size_bytes, {d.sha('content')} AS sha256 FROM {{files}}"


@operator("chunk_sha256", given={"size": 1000})
def chunk_sha256(d, size):
    """The digest of each chunk of ``size`` bytes."""
    return f"SELECT file_id, chunk_index, {d.sha(d.bytes_part('content', f'chunk_index * {size}', str(size)))} AS sha256 FROM {sliced(d, size)}"


@operator("fingerprint")
def fingerprint(d):
    """The metadata fingerprint: digest of name, size, raw media type and time of change, which may be unknown."""
    return f"SELECT file_id, {d.sha(_identity())} AS fingerprint FROM {{files}}"


def _identity() -> str:
    return "concat(name, ':', size_bytes, ':', coalesce(media_type, ''), ':', CASE WHEN last_modified IS NULL THEN 'unknown' ELSE concat('', last_modified) END)"


@operator("fallback_hash")
def fallback_hash(d):
    """The 33-xor fingerprint of identities, where no digest is available."""
    return f"SELECT file_id, concat('fast-', {d.hex8(d.hash33(_identity()))}) AS fingerprint FROM {{files}}"


def checksum_verdict(policy: str, found: str = "true") -> str:
    """SQL: the checksum rule of a policy (``required``, ``when-present`` or ``off``) on ``algorithm, expected, actual``; ``found`` says whether there is a file."""
    if policy == "off":
        return "'ok'"
    absent = "verification.checksum_missing" if policy == "required" else "ok"
    return f"""CASE WHEN algorithm IS NULL OR expected IS NULL THEN '{absent}' WHEN algorithm <> 'sha256' THEN 'verification.checksum_unsupported' WHEN NOT ({found}) THEN 'ok' WHEN lower(expected) <> lower(actual) THEN 'verification.checksum_mismatch' ELSE 'ok' END"""


@operator("verify_checksum", bind={"files": "checked_files"}, given={"policy": "required"})
def verify_checksum(d, policy="when-present"):
    """Checksum policy on each file: missing, unsupported, or differing (letters' case aside) from the content, which is null if there is no file."""
    return f"SELECT file_id, {checksum_verdict(policy, 'content IS NOT NULL')} AS verdict FROM (SELECT file_id, algorithm, expected, content, {d.sha('content')} AS actual FROM {{files}}) t"


@operator("s3_checksum_pick", bind={"headers": "part_headers"})
def s3_checksum_pick(d):
    """The first checksum header that a response carries, in the order of preference."""
    return """SELECT response_id, CASE WHEN sha256 <> '' THEN 'sha256' WHEN crc64nvme <> '' THEN 'crc64nvme' WHEN crc32c <> '' THEN 'crc32c' WHEN crc32 <> '' THEN 'crc32' END AS algorithm,
    coalesce(nullif(sha256, ''), nullif(crc64nvme, ''), nullif(crc32c, ''), nullif(crc32, '')) AS value FROM {headers}"""


@operator("checksum_progress", given={"size": 1000})
def checksum_progress(d, size):
    """Bytes read after each chunk, with the chunk's number and how many there are."""
    return f"SELECT file_id, chunk_index, {d.div(f'n_bytes + {size - 1}', str(size))} AS chunks, least((chunk_index + 1) * {size}, n_bytes) AS loaded FROM {sliced(d, size)}"
