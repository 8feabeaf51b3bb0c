"""The pipeline: each stage on its own input, against a plain version of its decision."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallyport.llm import _labels, _session, op8_toxicity, op10_quality_rules
from tests.llm.test_documents import plain_components


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("row", F.lit("extra"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["quality_rules"]
    assert ids(after) == sorted(r["__row"].doc_id for r in op10_quality_rules.score(before).filter("kept").collect())
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scores = op8_toxicity.score(before, op8_toxicity.fit(before, labels))
    assert ids(after) == sorted(r.row.doc_id for r in scores.collect() if r.score < op8_toxicity.PREDICT_AT)
    assert before.filter(~_labels.held_out(F.col("doc_id"))).count() > 0
    before, after = seen["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert ids(after) == sorted(int(i) for i, n, least in plain_components(rows, percent=80) if i == least or not n)
    before, after = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in before.collect() if any(x in r.text for x in items)}
    assert set(ids(before)) - set(ids(after)) >= holds and len(set(ids(before)) - set(ids(after)) - holds) <= 1
    before, after = seen["packing"]
    assert set(ids(after)) == set(ids(before))


def test_run(spark, data):
    assert {"doc_id", "sequence_id", "ids"} <= set(corpus_pipeline.run(spark, data).columns)


def test_run_on_odd_rows(spark, odd, data, folder):
    """Null, empty, long, repeated and nameless rows, and clashing columns, through all stages; only the last table stays."""
    import os

    tables = {t: spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark")}
    good = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id between 50 and 90")
    extra = {c: odd.schema[c].dataType for c in odd.columns if c not in good.columns}
    rows = odd.withColumn("n_chars", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    rows = rows.unionByName(good.select("*", *[F.lit(None).cast(t).alias(c) for c, t in extra.items()])).unionByName(rows.filter("doc_id = 7"))
    shared = _session.shared_dir(spark).removeprefix("file://") + "/tallyport"
    known = set(os.listdir(shared)) if os.path.exists(shared) else set()
    out = corpus_pipeline.run(spark, folder(documents=rows, **tables))
    got = out.select("doc_id", "sequence_id", "length", "doc_tokens").collect()
    left = set(os.listdir(shared)) - known
    assert {r.doc_id for r in got} & {r.doc_id for r in good.collect()} and not {r.doc_id for r in got} & {1, 2, 3, 4, 5, 6, 7, None}
    assert len({r.doc_id for r in got}) == len({(r.doc_id, r.doc_tokens) for r in got})
    assert [x.split("-")[:2] for x in left] == [["pipeline", "decontamination"]]


def test_run_on_empty_tables(spark, data, folder):
    tables = {t: spark.read.parquet(f"{data}/{t}.parquet").filter("false") for t in ("documents", "labels", "benchmark")}
    assert corpus_pipeline.run(spark, folder(**tables)).count() == 0


def test_first_stages_equal_other_ways(spark, data, folder):
    """Quality rules by DuckDB's SQL; toxicity by windows that are cut, stretched and compressed one by one."""
    import math

    import duckdb
    import numpy as np

    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{data}/documents.parquet'")
    want = sorted(r[0] for r in con.sql(f"SELECT doc_id FROM ({op10_quality_rules.ORACLE_SQL}) WHERE kept").fetchall())
    kept = corpus_pipeline.quality_rules(spark, docs, data)
    assert sorted(r.doc_id for r in kept.collect()) == want and 0 < len(want) < docs.count()
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, kept, data).select("doc_id").collect()}
    model = op8_toxicity.fit(kept, labels)
    compressors, known, some = op8_toxicity.Distance(model).compressors, {}, 0
    for r in kept.select("doc_id", "text").collect():
        found, word = [], b""
        for byte in (r.text or "").encode() + b" ":
            byte = byte + 32 if 65 <= byte <= 90 else byte
            if byte >= 128 or 97 <= byte <= 122:
                word += bytes([byte])
            elif word:
                found, word = [*found, word + b" "], b""
        if any(len(w) > op8_toxicity.LONGEST for w in found) or len(found) > 1500:
            continue
        for w in set(found) - set(known):
            stretched = bytes((b * a + k * p + q) & 255 for k, b in enumerate(w) for a, p, q in ((1, 37, 0), (5, 91, 17), (11, 53, 99), (7, 29, 151)))
            toxic, ordinary = (len(c.compress(stretched)) for c in compressors)
            known[w] = np.float32(toxic) / np.float32(ordinary)
        below = [sum(known[w] <= cut for w in found) for cut in op8_toxicity.CUTS]
        seen = [*(math.log1p(n) for n in below), *(10 * min(1, n / max(len(found), 10)) for n in below), math.log1p(len(found)), *(float(n > 0) for n in below)]
        score = 1 / (1 + math.exp(-((np.array(seen) - model["middle"]) / model["scale"] @ model["beta"][:-1] + model["beta"][-1])))
        if abs(score - op8_toxicity.PREDICT_AT) > 1e-5:
            assert (r.doc_id in left) == (score < op8_toxicity.PREDICT_AT)
            some += 1
    assert some > 100 and len(left) < len(want)
