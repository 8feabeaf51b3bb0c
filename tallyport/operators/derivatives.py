"""Derivatives: references to what was made from an original."""

from __future__ import annotations

from tallyport.plans.registry import operator

# Fixed patterns: text that looks like a secret or leaves its folder; keys that hold a payload.
UNSAFE = r"(?i)x-amz-|awsaccesskeyid|signature=|sig=|token=|access_token=|secret|credential=|password=|authorization|\.\.[\\/]|^[a-z]:\\"
PAYLOAD_KEYS = ["base64", "blob", "body", "buffer", "bytes", "data", "file", "payload"]
KINDS = "'preview', 'thumbnail', 'tile', 'metadata', 'custom'"
BLOCKING = "'derivative.payload.embedded', 'derivative.storage.unsafe', 'derivative.failure.unsafe', 'derivative.tile.invalid'"


def unsafe(d, x: str) -> str:
    return d.rlike(x, UNSAFE)


def unsafe_tree(d, x: str) -> str:
    """SQL: whether any key or string of a JSON text looks like that, at any depth; other text counts as one string."""
    return d.json_any(x, UNSAFE)


def embedded(d, x: str) -> str:
    """SQL: whether a JSON text has a key that holds a payload, at any depth."""
    return d.json_has_key(x, PAYLOAD_KEYS)


_POSITIVE = "BETWEEN 1 AND 9007199254740991"


def tile_bad() -> str:
    """SQL: a tile pyramid (``has_tiles``) with sizes or levels that make no sense; ``bad_levels`` counts levels that do not."""
    return f"has_tiles AND (tile_width IS NOT NULL AND NOT tile_width {_POSITIVE} OR tile_height IS NOT NULL AND NOT tile_height {_POSITIVE} OR status = 'created' AND levels = 0 OR bad_levels > 0)"


_LEVEL_OK = f"coalesce(level >= 0, false) AND coalesce(width {_POSITIVE}, false) AND coalesce(height {_POSITIVE}, false) AND coalesce(columns {_POSITIVE}, false) AND coalesce(tile_rows {_POSITIVE}, false) AND coalesce(scale > 0, true)"


def mismatched_source() -> str:
    """SQL: a source identity that is given and is not the manifest's; fields that are not given do not count."""
    return """source_manifest_id IS NOT NULL AND (source_manifest_id <> manifest_id OR coalesce(source_version, '') <> manifest_version OR coalesce(source_bytes <> manifest_bytes, false) OR coalesce(source_media_type <> manifest_media_type, false)
    OR coalesce(source_fingerprint <> manifest_fingerprint, false) OR coalesce(source_checksum <> manifest_checksum, false))"""


def _storage(d) -> str:
    return " OR ".join([unsafe(d, "location_hint"), unsafe(d, "label"), unsafe_tree(d, "storage_metadata")])


def checks(d, strict_source: bool = False, allow_unsafe_hints: bool = False) -> list[tuple[str, str, str]]:
    """The rules on one derivative, in their order."""
    found = [
        ("coalesce(derivative_id, '') = ''", "derivative.id.missing", "'id'"),
        (f"NOT coalesce(kind IN ({KINDS}), false)", "derivative.kind.unsupported", "'kind'"),
        ("NOT coalesce(status IN ('planned', 'created', 'failed'), false)", "derivative.status.invalid", "'status'"),
        ("source IS DISTINCT FROM 'original'", "derivative.source.missing", "'source'"),
    ]
    if strict_source:
        found.append(("source_manifest_id IS NULL", "derivative.source.missing", "'sourceIdentity'"))
    found.append((mismatched_source(), "derivative.source.mismatch", "'sourceIdentity'"))
    if not allow_unsafe_hints:
        found.append((_storage(d), "derivative.storage.unsafe", "'storage'"))
    found += [
        (f"{embedded(d, 'storage_metadata')} OR {embedded(d, 'metadata')}", "derivative.payload.embedded", "'storage.metadata'"),
        (f"{unsafe(d, 'failure_code')} OR {unsafe(d, 'failure_message')}", "derivative.failure.unsafe", "'failure'"),
        (tile_bad(), "derivative.tile.invalid", "'tilePyramid'"),
    ]
    return [(f"coalesce({c}, false)", code, path) for c, code, path in found]


@operator("derivative_validate", given={"strict_source": True})
def derivative_validate(d, strict_source=False, allow_unsafe_hints=False):
    """Every issue of every derivative, and whether it forbids to show it."""
    return f"SELECT manifest_id, ordinal, code, path, code IN ({BLOCKING}) AS blocking FROM ({d.issues('{derivatives}', ['manifest_id'], checks(d, strict_source, allow_unsafe_hints))}) t"


@operator("manifest_derivatives", given={"required": ("d0",)})
def manifest_derivatives(d, required=(), strict_source=False, allow_unsafe_hints=False):
    """All issues of a group of derivatives: a repeated id is an issue and hides the others of its derivative; then required ids that are missing."""
    first = "(SELECT *, CASE WHEN coalesce(derivative_id, '') = '' THEN 1 ELSE row_number() OVER (PARTITION BY group_id, derivative_id ORDER BY position) END AS place FROM {derivatives}) q"
    each = d.issues(f"(SELECT * FROM {first} WHERE place = 1) f", ["group_id", "position"], [(c, code, f"concat('derivatives.', position, '.', {path})") for c, code, path in checks(d, strict_source, allow_unsafe_hints)])
    missing = "".join(
        f" UNION ALL SELECT g.group_id, CAST({k - len(required)} AS BIGINT), CAST(0 AS BIGINT), 'derivative.required.missing', 'derivatives' FROM (SELECT group_id, max(CASE WHEN derivative_id = {d.text(name)} THEN 1 ELSE 0 END) AS has FROM {{derivatives}} GROUP BY group_id) g WHERE has = 0"
        for k, name in enumerate(required)
    )
    return f"SELECT group_id, position, ordinal, code, path FROM ({each}) e UNION ALL SELECT group_id, position, CAST(0 AS BIGINT), 'derivative.id.duplicate', concat('derivatives.', position, '.id') FROM {first} WHERE place > 1{missing}"


@operator("derivative_dups")
def derivative_dups(d):
    """Derivatives whose id an earlier one of the group has."""
    return "SELECT group_id, derivative_id, position FROM (SELECT *, row_number() OVER (PARTITION BY group_id, derivative_id ORDER BY position) AS place FROM {derivatives}) q WHERE place > 1"


@operator("required_derivatives", given={"kinds": ("preview", "tile")})
def required_derivatives(d, kinds):
    """Files without a derivative of a required kind, and the kind."""
    wanted = " UNION ALL ".join(f"SELECT file_id, {d.text(k)} AS kind FROM {{files}}" for k in kinds)
    return f"SELECT f.file_id, f.kind FROM ({wanted}) f {d.anti} JOIN {{derivatives}} x ON x.manifest_id = f.file_id AND x.kind = f.kind"


#: The identity of an original that every derivative carries; ``checksum`` is absent where none is known.
_SOURCE = """'original' AS source, f.file_id AS manifest_id, f.manifest_version, f.size_bytes, coalesce(nullif(f.media_type, ''), 'application/octet-stream') AS media_type, f.fingerprint, f.checksum"""


def _refusal(d, *tiles: tuple[str, str]) -> str:
    """SQL: the first rule that forbids to show a derivative: storage, payload, failure, then tiles; 'ok' if none does."""
    rules = [
        (_storage(d), "derivative.storage.unsafe"),
        (f"{embedded(d, 'storage_metadata')} OR {embedded(d, 'metadata')}", "derivative.payload.embedded"),
        (f"{unsafe(d, 'failure_code')} OR {unsafe(d, 'failure_message')}", "derivative.failure.unsafe"),
    ]
    return "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN '{code}'" for c, code in (*tiles[:1], *rules, *tiles[1:])) + " ELSE 'ok' END"


@operator("derivative_build", bind={"inspected": "inspected_files"})
def derivative_build(d):
    """Previews as references to originals, with the whole identity of the source; refused if anything that they show looks unsafe or holds a payload."""
    return f"SELECT concat('preview-', f.file_id) AS derivative_id, 'preview' AS kind, f.status, {_SOURCE}, {_refusal(d)} AS verdict FROM {{inspected}} f"


@operator("metadata_derivative", bind={"inspected": "inspected_files"})
def metadata_derivative(d):
    """Derivatives that hold what was inspected of a file: format, size, depth and channels; refused if the tile pyramid among it makes no sense, or as previews are."""
    return f"SELECT concat('metadata-', f.file_id) AS derivative_id, 'metadata' AS kind, f.status, {_SOURCE}, format, width, height, color_depth, channels, {_refusal(d, (tile_bad(), 'derivative.tile.invalid'))} AS verdict FROM {{inspected}} f"


@operator("tile_derivative", bind={"inspected": "inspected_files"})
def tile_derivative(d):
    """Derivatives that point to a tile pyramid; refused if its numbers make no sense, or as previews are."""
    return f"SELECT concat('tile-', f.file_id) AS derivative_id, 'tile' AS kind, f.status, {_SOURCE}, tile_width, tile_height, levels, {_refusal(d, (tile_bad(), 'derivative.tile.invalid'))} AS verdict FROM {{inspected}} f WHERE has_tiles"


def derivative_upsert(d, replace_existing=False):
    """Derivatives of each group after new ones came, in the order of their positions: ids that are new are added behind the last; ids that the group has are replaced in place,
    by the last that came, if that is allowed, and an error otherwise, which leaves them as they were.  An id that comes more than once is one that the group has."""
    new = "(SELECT group_id, derivative_id, min(position) AS position, count(*) AS times FROM {new} GROUP BY group_id, derivative_id)"
    old = "(SELECT group_id, derivative_id, min(position) AS position FROM {derivatives} GROUP BY group_id, derivative_id)"
    behind = "(SELECT group_id, max(position) AS last FROM {derivatives} GROUP BY group_id)"
    error = "CAST(NULL AS VARCHAR(30))" if replace_existing else "CASE WHEN n.times > 1 OR o.derivative_id IS NOT NULL AND n.derivative_id IS NOT NULL THEN 'derivative.id.duplicate' END"
    changed = "n.derivative_id IS NOT NULL" if replace_existing else "n.derivative_id IS NOT NULL AND o.derivative_id IS NULL"
    return f"""SELECT t.group_id, t.derivative_id, CASE WHEN added THEN coalesce(l.last, -1) + row_number() OVER (PARTITION BY t.group_id, added ORDER BY t.position, t.derivative_id) ELSE t.position END AS position, t.changed, t.error
    FROM (SELECT coalesce(o.group_id, n.group_id) AS group_id, coalesce(o.derivative_id, n.derivative_id) AS derivative_id, coalesce(o.position, n.position) AS position, o.derivative_id IS NULL AS added, {changed} AS changed, {error} AS error
    FROM {old} o FULL OUTER JOIN {new} n ON o.group_id = n.group_id AND o.derivative_id = n.derivative_id) t LEFT JOIN {behind} l ON l.group_id = t.group_id"""


operator("derivative_upsert", bind={"new": "new_derivatives"}, given={"replace_existing": True})(derivative_upsert)
operator("derivative_attach", bind={"new": "new_derivatives"})(derivative_upsert)


@operator("tile_valid")
def tile_valid(d):
    """Whether a tile pyramid's numbers make sense; what was created has a level at least."""
    return f"SELECT manifest_id, status, tile_width, levels, NOT coalesce({tile_bad()}, false) AS valid FROM {{derivatives}} WHERE has_tiles"


@operator("tile_levels", bind={"pyramid": "tile_levels"})
def tile_levels(d):
    """Of each pyramid, how many levels it has and how many make no sense: number, size, columns and rows are whole and positive, a scale is positive."""
    return f"SELECT manifest_id, count(*) AS levels, count(CASE WHEN NOT ({_LEVEL_OK}) THEN 1 END) AS bad_levels FROM {{pyramid}} GROUP BY manifest_id"


@operator("unsafe_value", bind={"fields": "shown_fields"})
def unsafe_value(d):
    """Whether any field of an object, or its name, looks as if it gave away a secret or left its folder; fields that are JSON are looked through at any depth."""
    return f"SELECT object_id, max(CASE WHEN {unsafe(d, 'field')} OR {unsafe_tree(d, 'value')} THEN 1 ELSE 0 END) = 1 AS unsafe FROM {{fields}} GROUP BY object_id"


@operator("unsafe_hint")
def unsafe_hint(d):
    """Whether a location looks as if it gave away a secret or left its folder."""
    return f"SELECT manifest_id, location_hint, {unsafe(d, 'location_hint')} AS unsafe FROM {{derivatives}}"


@operator("embedded_payload")
def embedded_payload(d):
    """Whether metadata has a key, at any depth, under which payloads are kept."""
    return f"SELECT manifest_id, metadata, {embedded(d, 'metadata')} AS embedded FROM {{derivatives}}"
