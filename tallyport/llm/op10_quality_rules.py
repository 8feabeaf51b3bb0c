"""Quality rules by weak supervision, with DataFrame functions only.

Each rule looks at counts of a text and votes *good* (1), *bad* (0) or abstains (-1).  Expectation-maximisation over
the distinct vote patterns estimates how often each rule votes for either class and the share of good documents; a
document is kept when the posterior probability of *good* reaches ``KEEP_AT`` and it does not fail the base limits.
No label is used.

Edge cases: a null text has no words (all counts 0, ``base_failed`` true, not kept); an empty table gives an empty
result; repeated rows are judged row by row; other columns of the input pass through :func:`filter_documents` and
cannot clash, because the input row travels as one struct.

Cost: every count is an expression over one row, so there is no shuffle of texts.  The only aggregation groups vote
patterns, of which there are at most 3 to the number of rules, whatever the input's size; these sufficient statistics
are what the driver's arithmetic gets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.llm import _session

NAME = "op10_quality_rules"

#: A document fails below so many words, or with more than half of its words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_AT = 0.5
#: Rounds of expectation-maximisation; where the tables start: P(vote) of either class, for abstain, bad and good, which
#: weighs as much as START_WEIGHT of the documents and START_COUNT more.
ROUNDS, START_WEIGHT, START_COUNT = 25, 0.02, 10.0
START = ((0.2, 0.5, 0.3), (0.37, 0.03, 0.6))
START_SHARE = 0.8

_SPACE = r"[\x20\x09-\x0D]"
_TRIM = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Each rule: its name, when it votes bad, when it votes good; otherwise it abstains.  SQL that Spark and DuckDB share.
RULES: list[tuple[str, str, str]] = [
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("symbol_share", "50 * n_symbols > word_chars", "250 * n_symbols <= word_chars"),
    ("symbol_runs", "12 * n_runs > n_words", "100 * n_runs <= n_words"),
    ("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("lines", "3 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines > 2"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars >= 3 * n_words and word_chars <= 9 * n_words"),
    ("capitals", "5 * n_upper > word_chars", "20 * n_upper <= word_chars"),
    ("shouting", "20 * n_shouts > n_words", "n_shouts = 0 and n_ends > 0"),
    ("variety", "5 * n_distinct_words < n_words and n_words < 500 or 20 * n_distinct_words < n_words", "2 * n_distinct_words >= n_words"),
    ("ending", "60 * n_ends < n_words", "25 * n_ends >= n_words"),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _counts(text: Column) -> list[tuple[str, list[tuple[str, Column]]]]:
    """The counts of one text in layers: a layer reads what the layers before it named, so nothing is computed twice."""
    body = F.col("__body")
    words, hashes, packed, tri = F.col("__words"), F.col("__hashes"), F.col("__packed"), F.col("__tri")
    low, lines = F.col("__low"), F.col("__lines")

    def window(h: Column, i: Column) -> Column:
        return F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))

    def same(x: Column, other: Column) -> Column:
        """Equal in the kept high bits, and then in the whole hash of the window."""
        at, near = x.bitwiseAND(low), other.bitwiseAND(low)
        return F.coalesce((x.bitwiseXOR(other) <= low) & (x.bitwiseXOR(other) >= 0), F.lit(False)) & F.coalesce(F.get(tri, at.cast("int")) == F.get(tri, near.cast("int")), F.lit(False))

    repeated = F.filter(packed, lambda x, j: same(x, F.get(packed, j - 1)) | same(x, F.get(packed, j + 1)))
    places = F.col("__places")
    n = F.size(words)
    return [
        ("body", [("__body", F.coalesce(text, F.lit(""))), ("__trimmed", F.expr(f"trim(BOTH '{_TRIM}' FROM coalesce(__text, ''))"))]),
        ("words", [("__words", F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split(F.col("__trimmed"), _SPACE + "+"))), ("__lines", F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))]),
        ("hashes", [("__hashes", F.transform(words, lambda w: F.xxhash64(w))), ("__low", F.expr("shiftleft(1L, length(bin(size(__words)))) - 1"))]),
        ("windows", [("__tri", F.transform(F.slice(hashes, F.lit(1), F.greatest(n - 2, F.lit(0))), window))]),
        ("packed", [("__packed", F.sort_array(F.transform(tri, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))))]),
        ("places", [("__places", F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(low))))]),
        (
            "counts",
            [
                ("n_words", n.cast("long")),
                ("word_chars", F.length(F.translate(body, _TRIM, "")).cast("long")),
                ("n_symbols", (F.length(body) - F.length(F.translate(body, _SYMBOLS, ""))).cast("long")),
                ("n_lines", F.size(lines).cast("long")),
                ("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")),
                ("n_repeat_words", F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, k + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)),
                ("n_upper", F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long")),
                ("n_runs", F.regexp_count(body, F.lit(f"[{_SYMBOLS}]+")).cast("long")),
                ("n_shouts", F.regexp_count(body, F.lit(r"!!")).cast("long")),
                ("n_ends", F.regexp_count(body, F.lit(r"[.!?][\x20\x09-\x0D]|[.!?]$")).cast("long")),
                ("n_distinct_words", F.size(F.array_distinct(hashes)).cast("long")),
            ],
        ),
    ]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the input row as a struct) with the counts and one vote column per rule."""
    out = docs.select(F.struct("*").alias("__row"), F.col(text).cast("string").alias("__text"))
    layers = _counts(F.col("__text"))
    needed = {"__text", "__body", "__words", "__lines", "__hashes", "__places"}
    for name, columns in layers[:-1]:
        out = out.select("*", *[c.alias(n) for n, c in columns])
        if name == "places":
            out = out.drop("__packed", "__tri", "__low", "__trimmed")
    assert needed <= set(out.columns)
    out = out.select("__row", *[c.alias(n) for n, c in layers[-1][1]])
    votes = [F.expr(f"case when {bad} then 0 when {good} then 1 else -1 end").alias(f"vote_{name}") for name, bad, good in RULES]
    return out.select("*", *votes)


def fit(measured: DataFrame) -> dict:
    """Class share and vote tables by expectation-maximisation over vote patterns (at most 3**len(RULES) rows)."""
    names = [f"vote_{name}" for name, _, _ in RULES]
    patterns = [(tuple(r[:-1]), r[-1]) for r in measured.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    return em(sorted(patterns))


def em(patterns: list[tuple[tuple[int, ...], int]]) -> dict:
    """The model from (votes, count) pairs: the share of good, and P(vote | class) of each rule, for -1, 0 and 1."""
    share, tables = START_SHARE, [START] * len(RULES)
    total = sum(n for _, n in patterns)
    weight = START_WEIGHT * total + START_COUNT
    for _ in range(ROUNDS):
        good = 0.0
        seen = [[[w * weight for w in start] for start in START] for _ in RULES]
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-logit(share, tables, votes)))
            good += n * p
            for k, v in enumerate(votes):
                seen[k][1][v + 1] += n * p
                seen[k][0][v + 1] += n * (1 - p)
        share = (good + START_COUNT * START_SHARE) / (total + START_COUNT)
        tables = [[[x / sum(row) for x in row] for row in rule] for rule in seen]
    return {"share": share, "tables": tables}


def logit(share: float, tables: list, votes: tuple[int, ...]) -> float:
    """Log odds of good given the votes."""
    return math.log(share / (1 - share)) + sum(math.log(good[v + 1] / bad[v + 1]) for (bad, good), v in zip(tables, votes, strict=True))


def judged(measured: DataFrame, model: dict) -> DataFrame:
    """Adds ``base_failed``, ``posterior`` and ``kept``."""
    odds = F.lit(math.log(model["share"] / (1 - model["share"])))
    for (name, _, _), (bad, good) in zip(RULES, model["tables"], strict=True):
        low, no, yes = (math.log(g / b) for b, g in zip(bad, good, strict=True))
        odds = odds + F.when(F.col(f"vote_{name}") == 1, yes).when(F.col(f"vote_{name}") == 0, no).otherwise(low)
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    return measured.select("*", failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior")).select("*", (~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)).alias("kept"))


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts, votes, posterior and verdict of each row, beside ``__row.doc_id``; the counts are kept as a small table."""
    narrow = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    measured = _session.materialize(measure(narrow).withColumn("__row", F.struct(F.col("__row.doc_id").alias("doc_id"))), "op10")
    return judged(measured, fit(measured))


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they came."""
    measured = _session.materialize(measure(docs, text).drop(*COUNTS[1:4]), "op10")
    return judged(measured, fit(measured)).filter("kept").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the contract of op10."""
    docs = _session.table(spark, sf_dir, "documents")
    return score(docs).select(F.col("__row.doc_id").alias("doc_id"), *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    """The same counts and the same expectation-maximisation, unrolled into common table expressions."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    names = [name for name, _, _ in RULES]
    parts = [
        f"""t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rid, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '{word}+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents)""",
        "w3 AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM t))",
        "again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM w3) WHERE n > 1)",
        "reps AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid)",
        f"""m AS (SELECT t.rid, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(body, '{space}', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(reps.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(body, '\\p{{Lu}}'))::BIGINT AS n_upper, len(regexp_extract_all(body, '!!'))::BIGINT AS n_shouts, len(regexp_extract_all(body, '[#*$%&|<>]+'))::BIGINT AS n_runs,
        len(regexp_extract_all(body, '[.!?][\\x20\\x09-\\x0D]|[.!?]$'))::BIGINT AS n_ends, len(list_distinct(words))::BIGINT AS n_distinct_words FROM t LEFT JOIN reps USING (rid))""",
        "v AS (SELECT *, " + ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END AS v_{name}" for name, bad, good in RULES) + " FROM m)",
        "p AS (SELECT " + ", ".join(f"v_{n}" for n in names) + ", count(*)::DOUBLE AS n FROM v GROUP BY ALL)",
    ]
    cells = [(n, c, v) for n in names for c in (0, 1) for v in (-1, 0, 1)]
    cell = lambda n, c, v: f"c_{n}_{c}_{v + 1}"
    parts.append(f"e0 AS (SELECT {START_SHARE}::DOUBLE AS share, " + ", ".join(f"{START[c][v + 1]}::DOUBLE AS {cell(n, c, v)}" for n, c, v in cells) + ")")
    parts.append(f"size AS (SELECT coalesce(sum(n), 0) AS total, {START_WEIGHT} * coalesce(sum(n), 0) + {START_COUNT} AS weight FROM p)")

    def odds(e: str) -> str:
        return f"ln({e}.share / (1 - {e}.share)) + " + " + ".join(f"CASE v_{n} " + " ".join(f"WHEN {v} THEN ln({e}.{cell(n, 1, v)} / {e}.{cell(n, 0, v)})" for v in (-1, 0, 1)) + " END" for n in names)

    for k in range(ROUNDS):
        parts.append(f"q{k} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-({odds(f'e{k}')}))) AS q FROM p, e{k})")
        sums = [f"({START[c][v + 1]} * any_value(weight) + coalesce(sum(n * {'q' if c else '(1 - q)'}) FILTER (v_{n} = {v}), 0)) / (any_value(weight) + coalesce(sum(n * {'q' if c else '(1 - q)'}), 0)) AS {cell(n, c, v)}" for n, c, v in cells]
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT (coalesce(sum(n * q), 0) + {START_COUNT * START_SHARE}) / (any_value(total) + {START_COUNT}) AS share, {', '.join(sums)} FROM size LEFT JOIN q{k} ON true)")
    last = f"e{ROUNDS}"
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {', '.join(COUNTS)}, {failed} AS base_failed, NOT {failed} AND 1 / (1 + exp(-({odds(last)}))) >= {KEEP_AT} AS kept FROM v, {last}"


ORACLE_SQL = _oracle()
