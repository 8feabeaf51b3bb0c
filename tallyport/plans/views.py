"""Views that bind the operators' relations to the tables at hand."""

from __future__ import annotations

from tallyport.plans.registry import view

CHUNK = 262144
NOW = "TIMESTAMP '1998-06-01 00:00:00'"
NOW_ISO = "'1998-06-01T00:00:00.000Z'"


@view("files")
def files(d):
    return f"""SELECT doc_id AS file_id, concat('doc-', doc_id, '.', CASE doc_id % 5 WHEN 0 THEN 'TIF' WHEN 1 THEN 'tiff' WHEN 2 THEN lang WHEN 3 THEN 'png' ELSE '' END) AS name,
    {d.octets("text")} AS size_bytes, CASE lang WHEN 'en' THEN 'image/tiff' WHEN 'de' THEN 'image/png' WHEN 'es' THEN 'IMAGE/TIFF' ELSE '' END AS media_type,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1767225600000 + doc_id * 1000 END AS last_modified, text AS content,
    CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source END AS lot_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars % 5000 END AS width, n_chars % 3000 AS height FROM {{documents}}"""


@view("manifests")
def manifests(d):
    return f"""SELECT o_orderkey AS manifest_id, CAST(floor(o_totalprice * 4) AS BIGINT) AS total_bytes, CAST({CHUNK} AS BIGINT) AS chunk_size,
    {d.div(f"CAST(floor(o_totalprice * 4) AS BIGINT) + {CHUNK - 1}", str(CHUNK))} AS total_chunks, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS created_at, 'A' AS transport FROM {{orders}}"""


@view("receipts")
def receipts(d):
    return f"""SELECT r.manifest_id, r.chunk_index, r.position, r.checksum, r.location, r.opaque, {d.iso("m.created_at")} AS completed_at, greatest(least(m.chunk_size, m.total_bytes - r.chunk_index * m.chunk_size), 0) - CASE WHEN r.l_linestatus = 'F' THEN 0 ELSE r.chunk_index % 2 END AS size_bytes,
    r.transport, r.part_number, r.etag FROM (SELECT l_orderkey AS manifest_id, CAST(l_linenumber - 1 AS BIGINT) AS chunk_index,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) - 1 AS BIGINT) AS position, l_linestatus, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS transport,
    CAST(l_linenumber AS BIGINT) AS part_number, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('e', l_partkey) END AS etag,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat('c', l_partkey) END AS checksum, CASE WHEN l_partkey % 21 = 0 THEN concat('https://h/', l_partkey) END AS location, CASE WHEN l_partkey % 25 = 0 THEN '{{}}' END AS opaque FROM {{lineitem}}) r JOIN {{manifests}} m ON r.manifest_id = m.manifest_id"""


@view("plan")
def plan(d):
    return f"SELECT manifest_id, chunk_index, chunk_index * chunk_size AS start_byte, least((chunk_index + 1) * chunk_size, total_bytes) AS end_byte, total_chunks FROM {{manifests}} {d.rows('total_chunks - 1', 'chunk_index')}"


@view("ranges")
def ranges(d):
    return "SELECT l_orderkey AS record_id, CAST(l_linenumber AS BIGINT) AS start_index, CAST(l_linenumber + l_quantity % 3 - CASE WHEN l_partkey % 10 = 0 THEN 2 ELSE 0 END AS BIGINT) AS end_index FROM {lineitem}"


@view("record_ranges")
def record_ranges(d):
    """Normalised ranges of each record, from its receipts, with the sizes they are counted by."""
    return """SELECT manifest_id, min(chunk_index) AS start_index, max(chunk_index) AS end_index, chunk_size, total_bytes FROM (SELECT *, chunk_index - row_number() OVER (PARTITION BY manifest_id ORDER BY chunk_index) AS island
    FROM (SELECT DISTINCT r.manifest_id, r.chunk_index, m.chunk_size, m.total_bytes FROM {receipts} r JOIN {manifests} m ON r.manifest_id = m.manifest_id WHERE r.chunk_index < m.total_chunks) u) v GROUP BY manifest_id, island, chunk_size, total_bytes"""


@view("resume_records")
def resume_records(d):
    return f"""SELECT concat('resume_', m.manifest_id) AS record_id, m.manifest_id, CASE WHEN m.manifest_id % 97 = 0 THEN 'v9' WHEN m.manifest_id % 4 = 0 THEN 'v0.1' ELSE 'v0.2' END AS schema_version,
    CASE m.priority WHEN '1-URGENT' THEN 'active' WHEN '2-HIGH' THEN 'paused' WHEN '3-MEDIUM' THEN 'failed' WHEN '4-NOT SPECIFIED' THEN CASE WHEN m.manifest_id % 2 = 0 THEN 'completed' ELSE 'expired' END ELSE 'canceled' END AS status,
    CASE WHEN m.manifest_id % 3 = 0 THEN NULL WHEN m.manifest_id % 101 = 0 THEN 'soon' ELSE {d.iso("m.created_at")} END AS expires_at, CASE WHEN m.manifest_id % 11 = 0 THEN '' ELSE concat('up-', m.manifest_id) END AS upload_id,
    CASE m.manifest_id % 3 WHEN 0 THEN 's3' WHEN 1 THEN 'tus' END AS transport_name, {d.iso("m.created_at")} AS created_at, m.total_bytes, m.chunk_size,
    m.total_chunks + CASE WHEN m.manifest_id % 89 = 0 THEN 1 ELSE 0 END AS total_chunks, coalesce(p.bytes, 0) + CASE WHEN m.manifest_id % 13 = 0 THEN 1 ELSE 0 END AS uploaded_bytes,
    coalesce(p.next_index, 0) AS next_index, CASE WHEN m.manifest_id % 5 = 0 THEN concat('tok', m.manifest_id) END AS resume_token, CASE WHEN m.manifest_id % 7 = 0 THEN '{{"key": 1}}' END AS transport_data, CASE WHEN m.manifest_id % 103 = 0 THEN '1998' ELSE {d.iso("m.created_at")} END AS updated_at,
    concat('file-', m.manifest_id, '.tif') AS file_name, m.total_bytes + CASE WHEN m.manifest_id % 107 = 0 THEN 1 ELSE 0 END AS file_bytes, CASE WHEN m.manifest_id % 109 = 0 THEN '' ELSE 'image/tiff' END AS file_media_type, concat('fp', m.manifest_id) AS file_fingerprint, CASE WHEN m.manifest_id % 2 = 0 THEN m.manifest_id * 1000 END AS file_last_modified,
    CASE WHEN m.manifest_id % 113 = 0 THEN 'sliding' ELSE 'fixed-size' END AS strategy, CASE WHEN m.manifest_id % 127 = 0 THEN 'v2' ELSE 'v1' END AS manifest_version, m.total_bytes AS manifest_bytes, m.chunk_size AS manifest_chunk_size, m.total_chunks AS manifest_chunks FROM {{manifests}} m
    LEFT JOIN (SELECT r.manifest_id, CAST(sum(least((r.end_index + 1) * r.chunk_size, r.total_bytes) - r.start_index * r.chunk_size) AS BIGINT) AS bytes, coalesce(max(CASE WHEN r.start_index = 0 THEN r.end_index + 1 END), 0) AS next_index FROM {{record_ranges}} r GROUP BY r.manifest_id) p ON p.manifest_id = m.manifest_id"""


@view("resume_changes")
def resume_changes(d):
    """Puts (with a status) and deletes (without one) of records, in the order of each record's positions."""
    return """SELECT concat('resume_', l_orderkey) AS record_id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'paused' END AS status,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS BIGINT) AS position FROM {lineitem}"""


@view("stored_ranges")
def stored_ranges(d):
    """Ranges as records hold them: mostly those of the receipts, sometimes cut short."""
    return """SELECT concat('resume_', manifest_id) AS record_id, CAST(row_number() OVER (PARTITION BY manifest_id ORDER BY start_index) - 1 AS BIGINT) AS place, start_index, end_index - CASE WHEN manifest_id % 83 = 0 THEN 1 ELSE 0 END AS end_index FROM {record_ranges}"""


@view("candidates")
def candidates(d):
    """The file that is offered for each record: sometimes another one, or planned with other chunks."""
    return """SELECT manifest_id, CASE WHEN manifest_id % 17 = 0 THEN 'other.tif' ELSE concat('file-', manifest_id, '.tif') END AS name, total_bytes + CASE WHEN manifest_id % 19 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN manifest_id % 23 = 0 THEN CAST(524288 AS BIGINT) ELSE chunk_size END AS chunk_size,
    CASE WHEN manifest_id % 29 = 0 THEN 'image/png' ELSE 'image/tiff' END AS media_type, concat(CASE WHEN manifest_id % 31 = 0 THEN 'xx' ELSE 'fp' END, manifest_id) AS fingerprint, CASE WHEN manifest_id % 3 = 0 THEN NULL ELSE manifest_id * 1000 + CASE WHEN manifest_id % 37 = 0 THEN 1 ELSE 0 END END AS last_modified FROM {manifests}"""


@view("capabilities")
def capabilities(d):
    return """SELECT 's3' AS name, CAST(5 AS BIGINT) AS max_chunks, CAST(200000 AS BIGINT) AS min_chunk, CAST(1 AS BIGINT) AS min_final, CAST(NULL AS BIGINT) AS max_chunk, true AS persistent
    UNION ALL SELECT 'tus', NULL, NULL, NULL, CAST(262143 AS BIGINT), NULL UNION ALL SELECT 'nas', NULL, CAST(100000 AS BIGINT), NULL, NULL, false"""


@view("ingest_events")
def ingest_events(d):
    return f"""SELECT event_id, user_id AS session_id, ts AS event_time, CASE event_type WHEN 'signup' THEN 'started' WHEN 'click' THEN 'chunk:completed' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'upload:paused' WHEN event_id % 3 = 1 THEN 'resume:started' ELSE 'snapshot' END
    WHEN 'error' THEN CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'resume:conflict' WHEN 2 THEN 'resume:cleanup-failed' ELSE 'retry' END ELSE CASE WHEN event_id % 9 = 0 THEN 'completed' WHEN event_id % 9 = 1 THEN 'upload:canceled' WHEN event_id % 9 = 2 THEN 'validated' ELSE 'chunk:started' END END AS type,
    CAST({d.json("props", "k")} AS BIGINT) AS chunk_index, CAST(floor(value * 100) AS BIGINT) AS uploaded_bytes, CAST(event_id % 4 AS BIGINT) AS attempt, CASE event_id % 6 WHEN 0 THEN 'PUT https://host/x failed' WHEN 1 THEN 'Resume Token rejected' WHEN 2 THEN NULL WHEN 3 THEN 'bad Credential' ELSE concat('code ', event_id) END AS message,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'E1' END AS code FROM {{events}}"""


@view("staged")
def staged(d):
    return f"SELECT conv_id AS session_id, turn AS chunk_index, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS BIGINT) AS generation, text AS body, {d.octets('text')} + CASE WHEN conv_id % 11 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN conv_id % 13 = 0 THEN 'ff' ELSE {d.sha('text')} END AS sha256, concat(lpad(CAST(turn AS {'string' if d.name == 'spark' else 'VARCHAR'}), 8, '0'), '-', role, '.part') AS path FROM {{conversations}}"


@view("nas_sessions_raw")
def nas_sessions_raw(d):
    return f"""SELECT c_custkey AS session_id, CASE WHEN c_custkey % 10 = 3 THEN concat('s/', c_custkey) ELSE concat('s_', c_custkey) END AS folder, CASE WHEN c_custkey % 12 = 0 THEN 'nas.v9' ELSE 'nas.v0.1' END AS schema_version,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'staging' WHEN 'MACHINERY' THEN 'finalized' WHEN 'HOUSEHOLD' THEN 'canceled' ELSE 'staging' END AS status, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {d.plus_ms("TIMESTAMP '1998-05-01 00:00:00'", "c_custkey * 7200000")} END AS expires_at,
    {d.plus_ms("TIMESTAMP '1998-01-01 00:00:00'", "c_custkey * 1000")} AS created_at, CAST(1 + c_custkey % 6 AS BIGINT) AS expected_chunks, CAST(floor(abs(c_acctbal)) AS BIGINT) AS total_bytes,
    CASE c_custkey % 6 WHEN 0 THEN concat('a/', c_custkey, '.tif') WHEN 1 THEN '../x' WHEN 2 THEN 'a/../../x' WHEN 3 THEN 'a/../b' WHEN 4 THEN '/abs' ELSE '.' END AS target FROM {{customer}}"""


@view("derivatives")
def derivatives(d):
    slash = "\\\\" if d.name == "spark" else "\\"
    return f"""SELECT l.doc_id AS manifest_id, CASE WHEN l.doc_id % 61 = 0 THEN '' ELSE concat('d', CAST(floor(l.doc_id / 100) AS BIGINT) % 3) END AS derivative_id, CAST(row_number() OVER (PARTITION BY l.doc_id % 100 ORDER BY l.doc_id) - 1 AS BIGINT) AS position, l.doc_id % 100 AS group_id,
    CASE WHEN l.doc_id % 31 = 0 THEN 'movie' WHEN l.doc_id % 3 = 0 THEN 'tile' ELSE 'preview' END AS kind, CASE WHEN l.doc_id % 29 = 0 THEN 'done' WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'created' ELSE 'planned' END AS status,
    CASE WHEN l.doc_id % 37 = 0 THEN NULL ELSE 'original' END AS source, CASE WHEN l.doc_id % 47 = 0 THEN NULL ELSE l.doc_id - CASE WHEN l.doc_id % 41 = 0 THEN 1 ELSE 0 END END AS source_manifest_id, CASE WHEN l.doc_id % 43 = 0 THEN 1 WHEN l.doc_id % 2 = 0 THEN d.n_chars END AS source_bytes, d.n_chars AS manifest_bytes,
    CASE WHEN l.doc_id % 53 = 0 THEN 'v0' ELSE 'v1' END AS source_version, 'v1' AS manifest_version, CASE WHEN l.doc_id % 5 = 0 THEN d.lang END AS source_media_type, CASE WHEN l.doc_id % 35 = 0 THEN 'xx' ELSE d.lang END AS manifest_media_type, CASE WHEN l.doc_id % 4 = 0 THEN concat('fp', l.doc_id) END AS source_fingerprint, concat('fp', l.doc_id) AS manifest_fingerprint,
    CASE WHEN l.doc_id % 6 = 0 THEN concat('c', l.doc_id) END AS source_checksum, CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE concat('c', l.doc_id) END AS manifest_checksum, CASE WHEN l.doc_id % 59 = 0 THEN 'my secret' END AS label, CASE WHEN l.doc_id % 67 = 0 THEN '{{"sig=": "x"}}' WHEN l.doc_id % 71 = 0 THEN '{{"a": {{"Blob": 1}}}}' WHEN l.doc_id % 23 = 0 THEN '{{"a": [{{"l": ["x", "pass{slash}u0077ord=1"]}}]}}' END AS storage_metadata,
    CASE l.doc_id % 8 WHEN 0 THEN concat('s3://b/', l.doc_id, '?X-Amz-Date=1') WHEN 1 THEN concat('c:{slash}dir', l.doc_id) WHEN 2 THEN '../up' WHEN 3 THEN concat('design=', l.doc_id) ELSE concat('nas/', l.doc_id) END AS location_hint,
    CASE WHEN l.doc_id % 6 = 0 THEN '{{"Bytes": 1}}' WHEN l.doc_id % 6 = 1 THEN '{{"note": "bytes"}}' WHEN l.doc_id % 6 = 2 THEN '{{"a": [1, {{"{slash}u0064ata": null}}]}}' WHEN l.doc_id % 6 = 3 THEN '{{"note": "{slash}"data{slash}": 1"}}' ELSE '{{}}' END AS metadata, CASE WHEN l.toxic = 1 THEN 'Authorization failed' END AS failure_message, CASE WHEN l.toxic = 1 THEN 'E1' END AS failure_code,
    l.doc_id % 3 = 0 AS has_tiles, CASE WHEN l.doc_id % 3 = 0 THEN CAST(256 - 256 * (l.doc_id % 2) AS BIGINT) END AS tile_width, CASE WHEN l.doc_id % 12 = 0 THEN CAST(256 AS BIGINT) WHEN l.doc_id % 15 = 0 THEN CAST(-1 AS BIGINT) END AS tile_height, l.doc_id % 4 AS levels, CASE WHEN l.doc_id % 39 = 0 THEN 1 ELSE 0 END AS bad_levels FROM {{labels}} l JOIN {{documents}} d ON d.doc_id = l.doc_id"""


@view("new_derivatives")
def new_derivatives(d):
    """What each derivative is offered as next: some ids its group has, others are new to it."""
    return "SELECT group_id, concat('d', (manifest_id + 1) % 5) AS derivative_id, position FROM {derivatives}"


@view("samples")
def samples(d):
    return "SELECT ps.p_partkey % 97 AS image_id, ps.p_size AS bits, ps.p_name AS software FROM {part} ps"


@view("remote_states")
def remote_states(d):
    return f"SELECT l_orderkey AS manifest_id, CAST(l_linenumber - 1 AS BIGINT) AS chunk_index, CAST(l_linenumber - 1 AS BIGINT) * {CHUNK} AS start_byte, CAST(l_linenumber AS BIGINT) * {CHUNK} AS end_byte, CASE WHEN l_partkey % 53 = 0 THEN 'x' ELSE CAST((l_linenumber - l_partkey % 3) * {CHUNK} AS {d.string}) END AS offset_text, CASE l_suppkey % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 410 ELSE 200 END AS http_status FROM {{lineitem}}"


@view("remote_offsets")
def remote_offsets(d):
    return f"SELECT record_id, CASE WHEN manifest_id % 33 = 0 THEN 'x' ELSE CAST(uploaded_bytes - CASE WHEN manifest_id % 15 = 0 THEN 1 ELSE 0 END AS {d.string}) END AS offset_text, CASE WHEN manifest_id % 25 = 0 THEN 410 ELSE 200 END AS http_status FROM {{resume_records}} WHERE manifest_id % 45 <> 0"


@view("stored_manifests")
def stored_manifests(d):
    """Manifests as they may have been stored, some of them damaged, beside the file that is checked against them, if there is one."""
    stamp = d.iso("created_at")
    return f"""SELECT manifest_id, CASE WHEN manifest_id % 50 = 1 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN manifest_id % 60 = 2 THEN NULL WHEN manifest_id % 60 = 3 THEN 'copy' ELSE 'original' END AS kind,
    CASE WHEN manifest_id % 70 = 4 THEN '' ELSE concat('file-', manifest_id, '.tif') END AS name, CASE WHEN manifest_id % 80 = 5 THEN -1 ELSE total_bytes END AS size_bytes, CASE WHEN manifest_id % 90 = 6 THEN NULL ELSE 'image/tiff' END AS media_type,
    manifest_id % 100 <> 7 AS preserved, CASE WHEN manifest_id % 110 = 8 THEN 'partial' WHEN manifest_id % 3 = 0 THEN NULL ELSE 'whole-file' END AS scope, CASE WHEN manifest_id % 120 = 9 THEN NULL WHEN manifest_id % 120 = 10 THEN 'varied' ELSE 'fixed-size' END AS strategy,
    manifest_id % 130 = 11 AS inlined, total_bytes + CASE WHEN manifest_id % 140 = 12 THEN 1 ELSE 0 END AS chunk_total, CASE WHEN manifest_id % 150 = 13 THEN 1024 WHEN manifest_id % 155 = 17 THEN 0 ELSE chunk_size END AS chunk_size, total_chunks + CASE WHEN manifest_id % 160 = 14 THEN 1 ELSE 0 END AS total_chunks,
    manifest_id % 170 <> 15 AS valid, total_bytes, transport, manifest_id % 5 <> 0 AS has_file, concat('file-', manifest_id, CASE WHEN manifest_id % 51 = 0 THEN '.png' ELSE '.tif' END) AS actual_name, total_bytes + CASE WHEN manifest_id % 52 = 0 THEN 1 ELSE 0 END AS actual_bytes, CASE WHEN manifest_id % 54 = 0 THEN '' ELSE 'image/tiff' END AS actual_type,
    {stamp} AS modified, CASE WHEN manifest_id % 56 = 0 THEN '1998-01-01T00:00:00.000Z' WHEN manifest_id % 57 = 0 THEN NULL ELSE {stamp} END AS actual_modified, CASE WHEN manifest_id % 3 = 0 THEN NULL WHEN manifest_id % 58 = 0 THEN 'md5' ELSE 'sha256' END AS algorithm, CASE WHEN manifest_id % 3 = 0 THEN NULL ELSE concat('AB', manifest_id) END AS expected,
    concat(CASE WHEN manifest_id % 59 = 0 THEN 'cd' ELSE 'ab' END, manifest_id) AS actual FROM {{manifests}}"""


@view("file_pairs")
def file_pairs(d):
    """Each file beside what its manifest says of it; some have changed since, or are gone."""
    return f"""SELECT file_id, name, size_bytes, media_type, CASE WHEN last_modified IS NOT NULL THEN {d.iso(d.from_ms('last_modified'))} END AS modified, CASE WHEN file_id % 13 = 0 THEN 'x' ELSE name END AS actual_name, size_bytes + CASE WHEN file_id % 17 = 0 THEN 1 ELSE 0 END AS actual_bytes,
    CASE WHEN file_id % 19 = 0 THEN 'text/plain' ELSE media_type END AS actual_type, CASE WHEN file_id % 23 = 0 THEN NULL ELSE {d.iso(d.from_ms('coalesce(last_modified, 0) + CASE WHEN file_id % 29 = 0 THEN 1 ELSE 0 END'))} END AS actual_modified,
    content, CASE WHEN file_id % 37 = 0 THEN 'ff' ELSE {d.sha("content")} END AS expected, file_id % 47 <> 0 AS found, file_id % 53 <> 0 AS regular FROM {{files}}"""


@view("checked_files")
def checked_files(d):
    return f"SELECT file_id, CASE WHEN file_id % 21 = 0 THEN NULL ELSE content END AS content, CASE file_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'md5' ELSE 'sha256' END AS algorithm, CASE WHEN file_id % 4 = 0 THEN upper({d.sha('content')}) WHEN file_id % 7 = 0 THEN 'ff' ELSE {d.sha('content')} END AS expected FROM {{files}}"


@view("part_headers")
def part_headers(d):
    return "SELECT manifest_id * 10 + position AS response_id, CASE WHEN position % 5 = 0 THEN etag END AS sha256, CASE WHEN position % 3 = 0 THEN '' END AS crc64nvme, CASE WHEN chunk_index % 2 = 0 THEN etag END AS crc32c, CASE WHEN chunk_index % 3 = 0 THEN 'c' END AS crc32 FROM {receipts}"


@view("upload_metadata")
def upload_metadata(d):
    """What is sent along with each upload: some values are unknown, some keys are none."""
    return """SELECT file_id, CAST(0 AS BIGINT) AS position, 'filename' AS entry, name AS value FROM {files} UNION ALL SELECT file_id, CAST(1 AS BIGINT), CASE WHEN file_id % 11 = 0 THEN 'lot no' ELSE 'lot' END, lot_id FROM {files} UNION ALL SELECT file_id, CAST(2 AS BIGINT), 'scanner', CASE WHEN file_id % 2 = 0 THEN 'Größe 5' END FROM {files}"""


@view("upload_maps")
def upload_maps(d):
    """The same as a map on the row of each file; some files have none."""
    entries = [("'filename'", "name"), ("CASE WHEN file_id % 11 = 0 THEN 'lot no' ELSE 'lot' END", "lot_id"), ("'scanner'", "CASE WHEN file_id % 2 = 0 THEN 'Größe 5' END")]
    return f"SELECT file_id, CASE WHEN file_id % 13 <> 0 THEN {d.map_of(entries)} END AS metadata FROM {{files}}"


@view("extension_headers")
def extension_headers(d):
    return "SELECT page_id AS header_id, concat(' creation, ,', url, ' ,termination,') AS header FROM {pages}"


@view("extension_offers")
def extension_offers(d):
    return "SELECT page_id AS offer_id, CASE page_id % 3 WHEN 0 THEN 'creation, expiration' WHEN 1 THEN ' termination ,creation,expiration' ELSE '' END AS offered FROM {pages}"


@view("retries")
def retries(d):
    return "SELECT event_id, attempt, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 250.0 END AS delay_ms, CASE WHEN event_id % 2 = 0 THEN 2.0 ELSE 1.5 END AS backoff_factor, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 900.0 END AS max_delay_ms, CASE WHEN event_id % 7 = 0 THEN 'full' ELSE 'none' END AS jitter, (event_id % 8) / 8.0 AS draw FROM {ingest_events} WHERE type = 'retry'"


@view("retry_policies")
def retry_policies(d):
    return """SELECT p_partkey AS policy_id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN CAST(0 AS DOUBLE) WHEN p_partkey % 17 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS max_attempts, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 4 AS DOUBLE) END AS legacy_retries,
    CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(p_retailprice AS DOUBLE) END AS delay_ms, CASE WHEN p_partkey % 7 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS backoff_factor, CASE WHEN p_partkey % 11 = 0 THEN CAST('Infinity' AS DOUBLE) END AS max_delay_ms, CASE WHEN p_partkey % 2 = 0 THEN 'full' END AS jitter FROM {part}"""


@view("shown_stamps")
def shown_stamps(d):
    return "SELECT record_id, CASE WHEN manifest_id % 7 = 0 THEN '1998-02-30T00:00:00.000Z' WHEN manifest_id % 7 = 1 THEN '1998-02-03' ELSE expires_at END AS shown FROM {resume_records}"


@view("event_errors")
def event_errors(d):
    return "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE code END AS code, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS retryable, message FROM {ingest_events} WHERE type IN ('failed', 'retry')"


@view("raw_sessions")
def raw_sessions(d):
    return """SELECT upload_id, CASE WHEN manifest_id % 2 = 0 THEN transport_name END AS session_transport, 'generic' AS transport_name, CASE WHEN manifest_id % 4 = 0 THEN NULL ELSE created_at END AS created_at, CASE WHEN manifest_id % 5 = 0 THEN expires_at END AS expires_at, expires_at AS fallback_expires_at,
    CASE WHEN manifest_id % 3 = 0 THEN resume_token END AS resume_token, resume_token AS fallback_resume_token, CASE WHEN manifest_id % 9 = 0 THEN concat('vault:', manifest_id) END AS secrets_ref, CASE WHEN manifest_id % 8 = 0 THEN 'r' END AS remote, transport_data AS data FROM {resume_records}"""


@view("chunk_results")
def chunk_results(d):
    """What a transport gave back for each chunk that was sent: a receipt, or nothing."""
    return """SELECT r.manifest_id, r.chunk_index, p.end_byte - p.start_byte AS size_bytes, 'A' AS transport_name, CASE WHEN r.position % 3 = 0 THEN NULL ELSE r.chunk_index + CASE WHEN r.position % 5 = 4 THEN 1 ELSE 0 END END AS receipt_chunk_index, r.size_bytes AS receipt_size_bytes, r.transport AS receipt_transport, r.completed_at AS receipt_completed_at
    FROM {receipts} r JOIN {plan} p ON p.manifest_id = r.manifest_id AND p.chunk_index = r.chunk_index"""


@view("asked_chunks")
def asked_chunks(d):
    return "SELECT DISTINCT l_orderkey AS record_id, CAST(l_partkey % 8 AS BIGINT) AS chunk_index FROM {lineitem}"


@view("stored_entries")
def stored_entries(d):
    """A key-value store: records as JSON under their prefix, other things, and values that are no records."""
    return """SELECT CASE WHEN manifest_id % 4 = 0 THEN concat('other:', manifest_id) ELSE concat('resume:', manifest_id) END AS entry, CASE WHEN manifest_id % 10 = 1 THEN NULL WHEN manifest_id % 10 = 2 THEN '{{"id": 5' ELSE concat('{{"id": "', record_id, '", "status": "', CASE WHEN manifest_id % 10 = 3 THEN 'odd' ELSE status END, '"}}') END AS stored FROM {resume_records}""".replace("{{", "{").replace("}}", "}")


@view("transport_states")
def transport_states(d):
    return "SELECT manifest_id, transport_name AS name, upload_id, resume_token, expires_at, transport_data AS data FROM {resume_records}"


@view("transport_results")
def transport_results(d):
    """What transports gave back for chunks and for sessions, in the order of each record's positions."""
    return "SELECT manifest_id, position, CASE WHEN position = 3 THEN concat('again-', manifest_id) END AS upload_id, etag AS resume_token, CASE WHEN chunk_index = 2 THEN completed_at END AS expires_at, opaque AS data FROM {receipts}"


@view("snapshots")
def snapshots(d):
    return "SELECT manifest_id, status, uploaded_bytes, upload_id, transport_name, expires_at, resume_token, CASE WHEN manifest_id % 9 = 0 THEN concat('vault:', manifest_id) END AS secrets_ref, CASE WHEN transport_name = 's3' THEN transport_data END AS remote FROM {resume_records}"


@view("s3_handles")
def s3_handles(d):
    return """SELECT p_partkey AS handle_id, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('up', p_partkey) END AS upload_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat('key/', p_partkey) END AS object_key, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat('https://b/', p_partkey) END AS url,
    CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'POST' WHEN 2 THEN '' ELSE 'PUT' END AS method, p_partkey % 3 = 0 AS persisted FROM {part}"""


@view("nas_requests")
def nas_requests(d):
    return "SELECT CASE WHEN s.s_suppkey % 3 = 0 THEN concat('s_', s.s_suppkey) ELSE r.folder END AS folder, r.target, r.expires_at, r.expected_chunks - CASE WHEN s.s_suppkey % 4 = 0 THEN 9 ELSE 0 END AS expected_chunks, r.total_bytes FROM {supplier} s JOIN (SELECT session_id, concat('n_', session_id, CASE WHEN session_id % 10 = 3 THEN '/x' ELSE '' END) AS folder, target, expires_at, expected_chunks, total_bytes FROM {nas_sessions_raw}) r ON r.session_id = s.s_suppkey"


@view("staged_listing")
def staged_listing(d):
    return "SELECT session_id, CASE WHEN generation % 2 = 1 AND chunk_index % 5 = 1 THEN concat(path, '.ab-1.tmp') WHEN chunk_index % 5 = 2 THEN 'notes.txt' WHEN chunk_index % 5 = 4 THEN concat('metadata.json.candidate-', generation, '.tmp') ELSE path END AS path FROM {staged}"


@view("staged_recorded")
def staged_recorded(d):
    return "SELECT session_id, path FROM {staged} WHERE chunk_index % 3 <> 0"


@view("locks")
def locks(d):
    return f"SELECT session_id AS lock_id, {d.plus_ms('created_at', 'session_id * 80000000')} AS acquired_at, concat('o', session_id % 7) AS owner_id FROM {{nas_sessions_raw}}"


@view("lock_releases")
def lock_releases(d):
    """Releases by those who once had a lock; some have lost it, some locks are gone."""
    return "SELECT session_id + CASE WHEN session_id % 11 = 0 THEN 1000000 ELSE 0 END AS lock_id, concat('o', session_id % 5) AS owner_id FROM {nas_sessions_raw}"


@view("tile_levels")
def tile_levels(d):
    """Levels of the derivatives' pyramids, some with numbers that make no sense."""
    return f"""SELECT manifest_id, level, CASE WHEN manifest_id % 33 = 0 AND level = 1 THEN CAST(0 AS BIGINT) ELSE 4096 // (1 + level) END AS width, CAST(4096 AS BIGINT) AS height, CASE WHEN manifest_id % 57 = 0 THEN NULL ELSE CAST(16 AS BIGINT) END AS columns, CAST(16 AS BIGINT) AS tile_rows, CASE WHEN manifest_id % 69 = 0 THEN CAST(-1 AS DOUBLE) END AS scale
    FROM {{derivatives}} {d.rows('levels - 1', 'level')} WHERE has_tiles""".replace("4096 // (1 + level)", d.div("4096", "1 + level"))


@view("inspected_files")
def inspected_files(d):
    return """SELECT f.file_id, f.size_bytes, f.media_type, x.status, CASE f.file_id % 4 WHEN 0 THEN 'tiff' WHEN 1 THEN 'token=x' ELSE NULL END AS format, f.width, f.height, CASE WHEN f.file_id % 2 = 0 THEN 8 ELSE 16 END AS color_depth, CAST(3 AS BIGINT) AS channels, x.has_tiles, x.tile_width, x.tile_height, x.levels, x.bad_levels, x.location_hint, x.label, x.storage_metadata, x.metadata, x.failure_code, x.failure_message, x.manifest_version, x.manifest_fingerprint AS fingerprint, x.manifest_checksum AS checksum FROM {files} f JOIN {derivatives} x ON x.manifest_id = f.file_id"""


@view("shown_fields")
def shown_fields(d):
    """Names and values of what derivatives would show."""
    return "SELECT manifest_id AS object_id, 'locationHint' AS field, location_hint AS value FROM {derivatives} UNION ALL SELECT manifest_id, 'label', label FROM {derivatives} UNION ALL SELECT manifest_id, CASE WHEN manifest_id % 73 = 0 THEN 'password=' ELSE 'note' END, failure_message FROM {derivatives}"


@view("tiff_headers")
def tiff_headers(d):
    """First 16 bytes of image files, as hexadecimal digits: both byte orders, classic and big, and damaged ones."""
    return """SELECT p_partkey AS image_id, CASE p_partkey % 7 WHEN 0 THEN '49492a0008000000ffffffffffffffff' WHEN 1 THEN '4d4d002a00000010ffffffffffffffff' WHEN 2 THEN '49492b00080000001000000000000000' WHEN 3 THEN '4d4d002b000800000000000000000100'
    WHEN 4 THEN '49492b00040000001000000000000000' WHEN 5 THEN '4d4d2a0000000010ffffffffffffffff' ELSE '89504e470d0a1a0a0000000d49484452' END AS head FROM {part}"""


@view("attempts")
def attempts(d):
    """Attempts at chunks: most fail, some while the upload is being stopped, some with errors that forbid a retry."""
    return """SELECT l_orderkey AS manifest_id, CAST(l_linenumber % 2 AS BIGINT) AS chunk_index, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS BIGINT) AS position,
    CASE WHEN l_returnflag <> 'R' OR l_partkey % 3 <> 0 THEN CASE WHEN l_linestatus = 'F' THEN 'transport.failed' ELSE 'transport.timeout' END END AS error_code,
    CASE l_suppkey % 9 WHEN 0 THEN 'cancel' WHEN 1 THEN 'pause' WHEN 2 THEN 'abort' END AS lifecycle, CASE WHEN l_partkey % 7 = 0 THEN false WHEN l_partkey % 7 = 1 THEN true END AS retryable, CASE WHEN l_partkey % 11 = 0 THEN false END AS policy_allows FROM {lineitem}"""
