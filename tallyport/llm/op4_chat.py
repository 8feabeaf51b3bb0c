"""Chat formatting by columnar byte assembly.

A turn becomes ``### <Role>: <text></turn>\\n``.  Inside texts (and inside unknown roles) a backslash is put before each
backslash, ``###`` and ``</turn>``, so no text can open or close a turn and the escape can be undone exactly.

Rows are dealt by conversation and sorted by turn; then batches are assembled whole: segment lengths, cumulative offsets
and scatter indices are computed in numpy, and headers, contents and ends are copied into one preallocated buffer that
becomes the Arrow string column.  A conversation that is longer than a batch comes out in several parts, in order, so a
task holds a batch at a time however long a conversation is; the reader consumes parts in the same task, as a stream.

Edge cases: a table that has conversation -7 itself keeps it, with the probe's two turns among its own; a null text is empty, a null role an empty role; null conversation ids are one conversation; ties of turn are
ordered by role and text, null turns come first; an empty table leaves only what is added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.llm import _session, _text

NAME = "op4_chat"

#: Fixed names of the roles that have one; any other role stands escaped, after an equals sign.
ROLE_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
END = "</turn>\n"
LOSS_ROLE = "assistant"
#: The conversation that is always formatted too.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"

PARTS = "conv_id long, part long, formatted string, n_turns long, loss_spans array<struct<start: long, stop: long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESCAPE = r"(\\|###|</turn>)"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### (=(?:[^\\:]|\\\\|\\:|\\###|\\</turn>)*|[A-Z][a-z]+): ((?:[^\\#<]++|\\(?:\\|###|</turn>)|#(?!##)|<(?!/turn>))*)</turn>\n")


def unescape(text: str) -> str:
    """Undo the escape."""
    return _ESCAPED.sub(lambda m: m[1], text)


def header(role: str) -> str:
    """What opens a turn of this role."""
    name = ROLE_NAMES.get(role) or "=" + re.sub(r"(\\|###|</turn>|:)", lambda m: "\\" + m[1], role)
    return f"### {name}: "


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the place of the escaped text, of each turn of a formatted part."""
    known, at = {v: k for k, v in ROLE_NAMES.items()}, 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield known[m[1]] if m[1][0] != "=" else unescape(m[1][1:]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def assemble(roles: pa.Array, texts: pa.Array, firsts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted strings of runs of turns, and where each turn's escaped text starts and stops in its run, in code points.

    ``firsts`` are the rows at which a run begins.
    """
    content, bounds = _text.raw(pc.replace_substring_regex(pc.fill_null(texts, ""), _ESCAPE, r"\\\1"))
    coded = pc.fill_null(roles, "").dictionary_encode()
    heads = [np.frombuffer(header(r).encode(), dtype=np.uint8) for r in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    end = np.frombuffer(END.encode(), dtype=np.uint8)
    head_sizes = np.array([len(h) for h in heads], dtype=np.int64)[code]
    sizes = np.diff(bounds)
    turns = head_sizes + sizes + len(end)
    stops = np.cumsum(turns)
    starts = stops - turns
    out = np.empty(int(stops[-1]) if len(stops) else 0, dtype=np.uint8)
    for k, head in enumerate(heads):
        out[starts[code == k][:, None] + np.arange(len(head))] = head
    body = starts + head_sizes
    out[np.repeat(body - bounds[:-1], sizes) + np.arange(len(content))] = content
    out[(stops - len(end))[:, None] + np.arange(len(end))] = end
    offsets = np.concatenate((starts[firsts], [len(out)])).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    run_start = np.repeat(chars[starts[firsts]], np.diff(np.concatenate((firsts, [len(code)]))))
    return formatted, chars[body] - run_start, chars[body + sizes] - run_start


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Parts of formatted conversations with the spans of the loss mask, each conversation in one partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, 0
        for batch in _text.chunks(batches, "text"):
            ids = batch.column("conv_id").to_pylist()
            firsts = np.array([k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]], dtype=np.int64)
            formatted, begin, stop = assemble(batch.column("role"), batch.column("text"), firsts)
            edges = [*firsts.tolist(), len(ids)]
            asked = pc.fill_null(pc.equal(batch.column("role"), LOSS_ROLE), False).to_pylist()
            spans = [[{"start": int(begin[k]), "stop": int(stop[k])} for k in range(a, b) if asked[k]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            parts = []
            for a in firsts.tolist():
                part = part + 1 if last is not None and last == (ids[a],) else 0
                last = (ids[a],)
                parts.append(part)
            columns = [pa.array([ids[a] for a in firsts], type=pa.int64()), pa.array(parts, type=pa.int64()), formatted.cast(pa.string()), pa.array(np.diff(edges), type=pa.int64())]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, type=kind)], names=["conv_id", "part", "formatted", "n_turns", "loss_spans"])

    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted parts alone, as :func:`format_conversations` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        done: list[tuple] = []
        state: list | None = None  # id, turns, hash of turns, loss characters, hash of loss, characters
        for batch in batches:
            for row in batch.select(["conv_id", "part", "formatted", "loss_spans"]).to_pylist():
                if row["part"] == 0:
                    if state:
                        done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                whole = row["formatted"]
                for role, text, _, _ in parse(whole):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss_spans"]:
                    text = unescape(whole[span["start"] : span["stop"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(whole)
            if len(done) >= 1000:
                yield pack(done)
                done = []
        if state:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
        if done:
            yield pack(done)

    return parts.mapInArrow(run, DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, by the contract of op4."""
    columns = ["conv_id", "turn", "role", "text"]
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(_session.table(spark, sf_dir, "conversations").select(*columns).unionByName(probe)))


_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLE_NAMES.items())
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')),
e AS (SELECT *, replace(replace(replace(text, chr(92), chr(92) || chr(92)), '###', chr(92) || '###'), '</turn>', chr(92) || '</turn>') AS escaped,
      CASE role {_NAMES} ELSE '=' || role END AS shown FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(length('### ' || shown || ': ' || escaped || '</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
