"""SQL fragments that Spark and DuckDB spell differently.

Operators are written once as declarative SQL over named relations.  Spark runs them; the DuckDB spelling is the oracle.
"""

from __future__ import annotations


#: A string of a canonical JSON text, with its colon if it is a key.
_JSON_STRING = r'"(?:[^"\\]|\\.)*+":?'


class Spark:
    """Spark SQL."""

    name = "spark"

    def text(self, pattern: str) -> str:
        """A string literal without escapes."""
        return "r'" + pattern.replace("'", "''") + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rlike(self, x: str, pattern: str) -> str:
        return f"coalesce({x} rlike {self.text(pattern)}, false)"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def octets(self, x: str) -> str:
        return f"cast(octet_length({x}) as bigint)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div nullif({b}, 0))"

    def rows(self, last: str, name: str) -> str:
        """To follow FROM: a row for each of 0 .. ``last``; none if it is negative."""
        return f"LATERAL VIEW explode(CASE WHEN {last} >= 0 THEN sequence(0L, {last}) END) s_{name} AS {name}"

    def between(self, first: str, last: str, name: str) -> str:
        return f"LATERAL VIEW explode(CASE WHEN {last} >= {first} THEN sequence({first}, {last}) END) s_{name} AS {name}"

    def iso(self, ts: str) -> str:
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"

    def stamp(self, text: str) -> str:
        """A timestamp from strict ISO text, null if it is none."""
        return f"try_to_timestamp({text}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"

    def plus_ms(self, ts: str, ms: str) -> str:
        return f"timestampadd(MILLISECOND, {ms}, cast({ts} as timestamp))"

    def from_ms(self, ms: str) -> str:
        return f"timestamp_millis({ms})"

    def listed(self, x: str, order: str) -> str:
        return f"coalesce(listagg(cast({x} as string), ',') WITHIN GROUP (ORDER BY {order}), '')"

    def bytes_part(self, x: str, first: str, size: str) -> str:
        """Bytes of a text, from place ``first`` (from 0)."""
        return f"substring(cast({x} as binary), cast({first} + 1 as int), cast({size} as int))"

    def hex_bytes(self, x: str) -> str:
        return f"lower(hex({x}))"

    def millis(self, ts: str) -> str:
        return f"unix_millis(cast({ts} as timestamp))"

    @property
    def anti(self) -> str:
        return "LEFT ANTI"

    @property
    def string(self) -> str:
        return "string"

    def issues(self, rel: str, keys: list[str], checks: list[tuple[str, str, str]]) -> str:
        """One row per check that holds: keys, ordinal (from 1), code and path; a path is SQL."""
        each = ", ".join(f"struct({k}L as ordinal, '{code}' as code, {path} as path, {cond} as hit)" for k, (cond, code, path) in enumerate(checks, 1))
        return f"SELECT {', '.join(keys)}, i.ordinal, i.code, i.path FROM {rel} LATERAL VIEW inline(filter(array({each}), s -> s.hit)) i AS ordinal, code, path, hit"

    def base64(self, x: str) -> str:
        return f"translate(base64(encode({x}, 'UTF-8')), '\\r\\n', '')"

    def xor(self, a: str, b: str) -> str:
        return f"({a}) ^ ({b})"

    def try_long(self, x: str) -> str:
        return f"try_cast({x} as bigint)"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def json_string(self, x: str) -> str:
        """A text as a JSON string."""
        return f"to_json(cast({x} as variant))"

    def map_of(self, entries: list[tuple[str, str]]) -> str:
        """A map of SQL keys and values."""
        return f"map({', '.join(f'{k}, {v}' for k, v in entries)})"

    def map_kept(self, m: str) -> str:
        """The entries of a map whose value is not null, in order, each with ``key`` and ``value``."""
        return f"map_entries(map_filter({m}, (k, v) -> v IS NOT NULL))"

    def each(self, xs: str, name: str, of: str) -> str:
        return f"transform({xs}, {name} -> {of})"

    def some(self, xs: str, name: str, which: str) -> str:
        return f"exists({xs}, {name} -> {which})"

    def _json_tokens(self, x: str) -> str:
        """The strings of a JSON text, in its one canonical spelling: keys with their colon, and values, at any depth; null if it is none."""
        canonical = f"coalesce(to_json(try_parse_json({x})), CASE WHEN left(ltrim({x}), 1) IN ('{{', '[') THEN get_json_object({x}, '$') END)"
        return f"regexp_extract_all({canonical}, {self.text(_JSON_STRING)}, 0)"

    def json_has_key(self, x: str, names: list[str]) -> str:
        """Whether a JSON text has one of these keys (lower case) at any depth; escapes are decoded."""
        keys = f"filter({self._json_tokens(x)}, t -> t LIKE '%\":')"
        return f"coalesce(exists({keys}, t -> lower(cast(try_parse_json(rtrim(':', t)) as string)) IN ({', '.join(repr(n) for n in names)})), false)"

    def json_any(self, x: str, pattern: str) -> str:
        """Whether any key or string of a JSON text, at any depth, matches; a text that is not JSON is one string."""
        strings = f"coalesce(transform({self._json_tokens(x)}, t -> cast(try_parse_json(rtrim(':', t)) as string)), array({x}))"
        return f"coalesce(exists({strings}, t -> t rlike {self.text(pattern)}), false)"

    def hash33(self, x: str) -> str:
        """The 33-xor hash of a text's UTF-16 units, as an unsigned 32-bit number."""
        step = lambda h, unit: f"((({h}) * 33) ^ cast({unit} as bigint)) & 4294967295L"
        high, low = "55296 + ((ascii(c) - 65536) div 1024)", "56320 + (ascii(c) - 65536) % 1024"
        return f"aggregate(filter(split({x}, ''), c -> c <> ''), 5381L, (h, c) -> CASE WHEN ascii(c) > 65535 THEN {step(step('h', high), low)} ELSE {step('h', 'ascii(c)')} END)"

    def hex8(self, x: str) -> str:
        return f"lower(lpad(hex({x}), 8, '0'))"

    def except_(self, a: list[str], b: str) -> str:
        """How many of the strings ``a`` are not in the comma-separated ``b``, and those, sorted."""
        return f"array_sort(array_except(array({', '.join(repr(x) for x in a)}), filter(transform(split({b}, ','), x -> trim(x)), x -> x <> '')))"

    def join(self, xs: str) -> str:
        return f"array_join({xs}, ',')"

    def tokens(self, x: str) -> str:
        """The trimmed, non-empty parts of a comma-separated list, joined by a bar."""
        return f"array_join(filter(transform(split({x}, ','), x -> trim(x)), x -> x <> ''), '|')"

    def size(self, xs: str) -> str:
        return f"cast(size({xs}) as bigint)"

    def part(self, x: str, first: str, size: str) -> str:
        return f"substring({x}, cast({first} as int), cast({size} as int))"

    def depth_ok(self, x: str) -> str:
        """Whether a path never climbs above where it starts, and ends below it."""
        steps = f"filter(split({x}, '/'), p -> p <> '' and p <> '.')"
        walk = f"aggregate({steps}, struct(0 as depth, 0 as low), (a, p) -> named_struct('depth', a.depth + CASE WHEN p = '..' THEN -1 ELSE 1 END, 'low', least(a.low, a.depth + CASE WHEN p = '..' THEN -1 ELSE 1 END)))"
        return f"({walk}.low >= 0 and {walk}.depth > 0)"


class Duck(Spark):
    """DuckDB."""

    name = "duck"

    def text(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def rlike(self, x: str, pattern: str) -> str:
        return f"coalesce(regexp_matches({x}, {self.text(pattern)}), false)"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def octets(self, x: str) -> str:
        return f"strlen({x})::BIGINT"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // nullif({b}, 0))"

    def rows(self, last: str, name: str) -> str:
        return f"CROSS JOIN LATERAL (SELECT unnest(generate_series(0, {last})) AS {name}) AS s_{name}"

    def between(self, first: str, last: str, name: str) -> str:
        return f"CROSS JOIN LATERAL (SELECT unnest(generate_series({first}, {last})) AS {name}) AS s_{name}"

    def iso(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"

    def stamp(self, text: str) -> str:
        return f"try_strptime({text}, '%Y-%m-%dT%H:%M:%S.%gZ')"

    def plus_ms(self, ts: str, ms: str) -> str:
        return f"({ts} + to_milliseconds({ms}))"

    def from_ms(self, ms: str) -> str:
        return f"make_timestamp(({ms}) * 1000)"

    def listed(self, x: str, order: str) -> str:
        return f"coalesce(string_agg(CAST({x} AS VARCHAR), ',' ORDER BY {order}), '')"

    def bytes_part(self, x: str, first: str, size: str) -> str:
        return f"(encode({x})[{first} + 1 : {first} + {size}])"

    def millis(self, ts: str) -> str:
        return f"(epoch_us({ts}) // 1000)"

    @property
    def anti(self) -> str:
        return "ANTI"

    @property
    def string(self) -> str:
        return "VARCHAR"

    def issues(self, rel: str, keys: list[str], checks: list[tuple[str, str, str]]) -> str:
        each = ", ".join(f"{{'ordinal': {k}::BIGINT, 'code': '{code}', 'path': {path}, 'hit': {cond}}}" for k, (cond, code, path) in enumerate(checks, 1))
        return f"SELECT {', '.join(keys)}, i.ordinal AS ordinal, i.code AS code, i.path AS path FROM (SELECT *, unnest([{each}]) AS i FROM {rel}) WHERE i.hit"

    def base64(self, x: str) -> str:
        return f"base64(encode({x}))"

    def xor(self, a: str, b: str) -> str:
        return f"xor({a}, {b})"

    def try_long(self, x: str) -> str:
        return f"TRY_CAST({x} AS BIGINT)"

    def json(self, x: str, key: str) -> str:
        return f"CASE WHEN json_valid({x}) THEN json_extract_string({x}, '$.{key}') END"

    def json_string(self, x: str) -> str:
        return f"CAST(to_json({x}) AS VARCHAR)"

    def map_of(self, entries: list[tuple[str, str]]) -> str:
        return f"MAP([{', '.join(k for k, _ in entries)}], [{', '.join(v for _, v in entries)}])"

    def map_kept(self, m: str) -> str:
        return f"list_filter(map_entries({m}), lambda e: e.value IS NOT NULL)"

    def each(self, xs: str, name: str, of: str) -> str:
        return f"list_transform({xs}, lambda {name}: {of})"

    def some(self, xs: str, name: str, which: str) -> str:
        return f"(len(list_filter({xs}, lambda {name}: {which})) > 0)"

    def json_has_key(self, x: str, names: list[str]) -> str:
        tree = f"json_tree(CASE WHEN json_valid({x}) THEN {x} END)"
        return f"coalesce((SELECT bool_or(lower(t.key) IN ({', '.join(repr(n) for n in names)})) FROM {tree} t), false)"

    def json_any(self, x: str, pattern: str) -> str:
        like = lambda y: f"regexp_matches({y}, {self.text(pattern)})"
        tree, atom = f"json_tree(CASE WHEN json_valid({x}) THEN {x} END)", "t.atom->>'$'"
        inside = f"(SELECT bool_or(coalesce({like('t.key')}, false) OR t.type = 'VARCHAR' AND coalesce({like(atom)}, false)) FROM {tree} t)"
        return f"coalesce(CASE WHEN json_valid({x}) THEN {inside} ELSE {like(x)} END, false)"

    def hash33(self, x: str) -> str:
        units = f"flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN c = '' THEN [] WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024]::BIGINT[] ELSE [unicode(c)]::BIGINT[] END))"
        return f"list_reduce(list_prepend(5381::BIGINT, {units}), lambda h, c: xor(h * 33, c) & 4294967295)"

    def hex8(self, x: str) -> str:
        return f"lower(lpad(to_hex({x}), 8, '0'))"

    def except_(self, a: list[str], b: str) -> str:
        return f"list_sort(list_filter([{', '.join(repr(x) for x in a)}], lambda x: NOT list_contains(list_transform(string_split({b}, ','), lambda y: trim(y)), x)))"

    def join(self, xs: str) -> str:
        return f"array_to_string({xs}, ',')"

    def tokens(self, x: str) -> str:
        return f"array_to_string(list_filter(list_transform(string_split({x}, ','), lambda x: trim(x)), lambda x: x <> ''), '|')"

    def size(self, xs: str) -> str:
        return f"len({xs})::BIGINT"

    def part(self, x: str, first: str, size: str) -> str:
        return f"substring({x}, {first}, {size})"

    def depth_ok(self, x: str) -> str:
        steps = f"list_transform(list_filter(string_split({x}, '/'), lambda p: p <> '' AND p <> '.'), lambda p: CASE WHEN p = '..' THEN -1 ELSE 1 END)"
        sums = f"list_transform(range(1, len({steps}) + 1), lambda k: list_sum({steps}[:k]))"
        return f"(coalesce(list_min({sums}), 0) >= 0 AND coalesce(list_sum({steps}), 0) > 0)"


SPARK, DUCK = Spark(), Duck()
