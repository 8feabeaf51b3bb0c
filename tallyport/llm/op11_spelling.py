"""Spelling variants by anagram hashing.

A word's anagram key is the sum of its letters' fifth powers, so the keys of two words that differ by one letter differ by
that letter's power, and after an exchange by the difference of two.  Instead of probing every possible difference, a word is
listed under its key and under its key less each different letter of it: a word and one that has a letter more meet where the
shorter's key equals the longer's reduced key, words with an exchanged letter where both reduced keys are equal.  Anagrams of
one another would make large groups, so the join also asks for an equal half: one edit leaves the first or the second half of
a word as it was.  What meets is then compared letter by letter.

Keys are sums modulo ``MODULUS``, which keeps differences; equal keys of different letters only cost a comparison.  Everything
is DataFrame functions: the texts are scanned once, occurrences are counted before they are shuffled, and all that follows is
over different words.  A chain of forms multiplies the count by ten with each step, so the roots are found in few rounds.

Edge cases: null and empty texts have no runs; a row without id loses no letter; repeated rows count as often as they occur; runs
of any length are words; ties of counts go to the smaller word; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.llm import _session

NAME = "op11_spelling"

#: Code points of a word at least, occurrences of it at least, and times as many occurrences as a word that its form has at least.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: One occurrence in so many loses a letter.
LOSES = 31
MODULUS = (1 << 61) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, least: int = LEAST_LENGTH, text: str = "text") -> DataFrame:
    """``word`` for each run of at least ``least`` letters; a run whose hash with its document's id is divisible by ``LOSES`` loses a letter."""
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))).alias("h"), F.length("run").alias("len"))
    at = (F.col("h") % F.col("len")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h") % LOSES == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)


def _power(letter: Column) -> Column:
    x = F.ascii(letter).cast("long")
    return x * x * x * x * x


def _listed(words: DataFrame) -> DataFrame:
    """Where each word is listed: under its ``key`` (``less`` 0) and under that less each different ``letter`` (``less`` 1).

    ``half`` is a hash of what is left of the word before (``side`` 0) or from (1) its middle, without the letter in the middle for
    ``less`` 1, and of the number of its letters; words that are one edit apart share a key and one half at least.
    """
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    total = F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: F.pmod(s + _power(c), F.lit(MODULUS)))
    keyed = words.select("word", "n", total.alias("total"), F.length("word").alias("size"), F.array_distinct(letters).alias("letters"))
    kinds = F.concat(
        F.array(F.struct(F.lit(0).alias("less"), F.col("total").alias("key"), F.lit("").alias("letter"))),
        F.transform("letters", lambda c: F.struct(F.lit(1).alias("less"), F.pmod(F.col("total") - _power(c), F.lit(MODULUS)).alias("key"), c.alias("letter"))),
    )
    rows = keyed.select("word", "n", "size", F.explode(kinds).alias("as")).select("word", "n", "as.*", (F.col("size") - F.col("as.less")).alias("len"))
    middle = _middle(F.col("len"))
    sides = [F.struct(F.lit(k).alias("side"), F.xxhash64("len", F.lit(k), part).alias("half")) for k, part in enumerate((F.substr("word", F.lit(1), middle), F.substr("word", middle + F.col("less") + 1)))]
    return rows.select("word", "n", "less", "key", "letter", "len", F.explode(F.array(*sides)).alias("of")).select("word", "n", "less", "key", "letter", "len", "of.*")


def _middle(size: Column) -> Column:
    return F.floor(size / 2).cast("int")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for each ordered pair of ``words (word, n)`` that differ by one inserted, deleted or replaced letter."""
    listed = _listed(words)
    left, right = listed.alias("a"), listed.alias("b")
    a, b = (lambda c, side=side: F.col(f"{side}.{c}") for side in "ab")
    # A word meets one that has a letter more, or (the smaller first) one with another letter; both sides are one shuffle.
    wanted = (a("less") < b("less")) | (a("less") + b("less") == 2) & (a("letter") != b("letter")) & (a("word") < b("word"))
    once = (a("side") + b("side") == 0) | (F.substr(a("word"), F.lit(1), _middle(a("len"))) != F.substr(b("word"), F.lit(1), _middle(b("len"))))
    met = left.join(right, (a("key") == b("key")) & (a("half") == b("half")) & wanted & once)
    pairs = met.filter(F.levenshtein(a("word"), b("word"), 1) == 1)
    ways = [F.struct(x("word").alias("word"), x("n").alias("n"), y("word").alias("near"), y("n").alias("near_n")) for x, y in ((a, b), (b, a))]
    return pairs.select(F.explode(F.array(*ways)).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms (word, form)``: the last of the chain that begins at the word; each round doubles the steps taken."""
    links = _session.materialize(forms.select("word", F.col("form").alias("root")), "op11-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = _session.materialize(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "op11-roots")
        _session.discard(links)
        if moved.filter("more").isEmpty():
            return moved.drop("more")
        links = moved.drop("more")
        links._tallyport_path = moved._tallyport_path


def variants(words: DataFrame) -> DataFrame:
    """``words (word, n)`` with ``n_near``, the ``form`` (the most frequent near word, if frequent enough), its ``form_n`` and the ``root``."""
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    found = words.join(near, "word", "left")
    enough = -F.col("best.less") >= FORM_TIMES * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    found = _session.materialize(found, "op11-forms")
    last = roots(found.filter("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """Every word of at least ``least`` letters and ``count`` occurrences, with its variants' group."""
    counted = occurrences(docs, least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)
    return variants(_session.materialize(counted, "op11-words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the contract of op11."""
    return spelling_variants(_session.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: CRC-32 bit by bit over table rows, near words by equal remains of a deletion: another way to the same rows.
ORACLE_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS raw FROM documents WHERE text IS NOT NULL),
lowered AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(raw) >= 7),
counted AS (SELECT doc_id, run, count(*) AS times FROM lowered GROUP BY ALL),
pieces AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS hx FROM counted),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hx)::BIGINT, 2), lambda j: ('0x' || substr(hx, j, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM pieces, crc
),
changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
),
words AS (SELECT word, sum(times)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain(word, here, steps) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON c.here = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(here, steps) AS root FROM chain GROUP BY word) c USING (word)
"""
