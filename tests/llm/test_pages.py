"""HTML (3), chat (4) and WARC (9)."""

import hashlib
import random

import duckdb
import pytest

from tallyport.llm import op3_html, op4_chat, op9_warc
from tests.oracle import rows, same

PAGE = """<!doctype html><html><head><title>T</title><script>var a = "</p><p>no</p>";</script><style>p{}</style></head><body class=home><header class=site><div>Brand</div><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies. Accept them, please.</p></div><aside class=sidebar><h3>Popular</h3><ul><li><a href=1>One thing</a></li><li><a href=2>Two things</a></li></ul></aside>
<main><article><h1>The &lt;main&gt; story&hellip;</h1><p>First   paragraph, with <b>bold</b> text &amp; a <a href=x>link</a>.<p>Second one&nbsp;here.<br>Still the second, longer than the first one.</p><div class=ad>Buy this now! Cheap.</div><p>Third paragraph ends the story, at last.</p></article></main>
<section id=comments><h3>Comments</h3><div class=comment><p>I liked this story very much, thanks to all.</p></div></section><form class=newsletter><label>Mail</label><input name=q></form><footer><p>&copy; 2024 Brand. All rights.</p></footer></body></html>"""
TEXT = "The <main> story…\nFirst paragraph, with bold text & a link.\nSecond one here. Still the second, longer than the first one.\nThird paragraph ends the story, at last."


def plain_cut(gain, edges):
    """Least cost over all labellings."""
    n = len(gain)
    return min(sum(abs(g) for k, g in enumerate(gain) if (g > 0) != bool(m >> k & 1) and g) + sum(w for a, b, w in edges if (m >> a & 1) != (m >> b & 1)) for m in range(1 << n))


def test_min_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(*rng.sample(range(n), 2), rng.uniform(0, 2)) for _ in range(rng.randint(0, 10))] if n > 1 else []
        kept = op3_html.min_cut(gain, edges)
        cost = sum(abs(g) for g, k in zip(gain, kept) if (g > 0) != k) + sum(w for a, b, w in edges if kept[a] != kept[b])
        assert cost == pytest.approx(plain_cut(gain, edges))


def test_article():
    assert op3_html.main_text(PAGE, op3_html.classifier()) == TEXT


def test_generated_pages():
    rng, wrong, total = random.Random(77), 0, 0
    weights = op3_html.classifier()
    for _ in range(150):
        page, truth = op3_html.generated(rng)
        read = op3_html.read(page)
        found = read.blocks
        assert len(found) == len(truth)
        kept = op3_html.min_cut((op3_html.features(found) @ weights[:-1] + weights[-1]).tolist(), op3_html.smoothness(read))
        wrong, total = wrong + sum(a != b for a, b in zip(kept, truth)), total + len(truth)
    assert wrong <= 0.01 * total


def test_deep_and_broken_pages_take_linear_time():
    import time
    import tracemalloc

    weights = op3_html.classifier()
    n = 150_000
    for page in ("<div>x " * n, "<b>" * n + "</i>" * n + "x", "<p><b>" * (n // 2) + "x" + "</div>" * n, "<ul>" * n + "<li>x" * 1000, "<div>x</div>" * 20_000):
        began = time.process_time()
        tracemalloc.start()
        op3_html.main_text(page, weights)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.process_time() - began < 60 and peak < 800e6, page[:20]


def test_tree_distance_weakens_smoothness():
    page = op3_html.read("<div><div><p>a</p><p>b</p></div><ul><li>c</li></ul></div>d")
    assert [b.text for b in page.blocks] == ["a", "b", "c", "d"]
    assert op3_html.smoothness(page) == [(0, 1, 1.0), (1, 2, 0.25), (2, 3, 0.5)]


def test_head_without_end_tag():
    text = "The article of this page is long enough to be read as one."
    heads = ["<head><title>T</title>", "<head><title>T</title><meta charset=utf-8><script>var x = 1</script>", "<head>", "<head><style>p{}</style></head>", "<head class=ad><title>T</title>\n"]
    for head in heads:
        for body in (f"<p>{text}", f"<div>{text}</div></head>", text, f"<body><p>{text}</p></body>"):
            found = op3_html.blocks(f"<!doctype html><html>{head}{body}")
            assert [b.text for b in found] == [text] and found[0].flags == 0, (head, body)
    page = f"<html><head><title>T</title><div class=nav>{text}<p>b</head><p>c</div>"
    assert [(b.text, b.flags) for b in op3_html.blocks(page)][2] == ("c", op3_html.blocks(page)[0].flags)


def test_formulas_stay():
    found = op3_html.blocks("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math>, as we know.</p>")
    assert [b.text for b in found] == ["Energy is E=mc2, as we know."]


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (4, "u", "<script>never closed"), (5, "u", "<!-- never closed"), (6, "u", "just text, which is long enough to be kept as a text."), (7, "u", "<div" * 2000), (8, "u", "<p>" * 5000 + "deep text, and it goes on." + "</div>" * 9), (9, "u", "a &am b &amp c &#x41; &bogus;")] * 2
    got = op3_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == text[3] == text[4] == text[5] == "" and text[6].startswith("just text") and text[8].startswith("deep text")
    assert op3_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_table(spark, data):
    """The generated tables' articles are between article tags; what else is in a page is not."""
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in op3_html.query(spark, data).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


TURNS = [
    (1, 0, "user", "a\\### b </turn> c"), (1, 1, "we:ird ### \\ </turn>", "x\\\\###\\\\</turn>####é😀"), (1, 1, "assistant", None), (None, 0, None, "q"), (None, None, "assistant", "😀é\n"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"),
    (2, 1, "assistant", "#</turn"), (3, 0, "system", "### Assistant: x</turn>\n### User: y"), *[(4, k, "user" if k % 2 == 0 else "assistant", "long ### text \\ " * 2000) for k in range(40)],
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_chat_with_the_probe_in_the_table(spark, folder):
    """Conversation -7 of a table is not lost: its turns and the probe's are one conversation, as in the SQL."""
    path = folder(conversations=spark.createDataFrame([(-7, 0, "user", "own ### text"), (-7, 5, "assistant", "own answer"), (1, 0, "user", "q")], SCHEMA))
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{path}/conversations.parquet'")
    got = op4_chat.query(spark, path)
    assert rows(got.toPandas()) == rows(con.sql(op4_chat.ORACLE_SQL).df())
    assert {r.conv_id: r.n_turns for r in got.collect()} == {-7: 4, 1: 1}


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, SCHEMA)
    parts = op4_chat.format_conversations(df.withColumnRenamed("turn", "part"), turn="part").collect()
    got = {}
    for p in sorted(parts, key=lambda p: p.part):
        turns = list(op4_chat.parse(p.formatted))
        got.setdefault(p.conv_id, []).extend((role, text) for role, text, _, _ in turns)
        assert [(s.start, s.stop) for s in p.loss_spans] == [(a, b) for role, _, a, b in turns if role == "assistant"]
    assert len([p for p in parts if p.conv_id == 4]) > 1
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert got[conv] == [(t[2] or "", t[3] or "") for t in own]
    for r in op4_chat.read_back(op4_chat.format_conversations(df)).collect():
        want = "".join(f"{role}\n{text}\n" for role, text in got[r.conv_id])
        loss = "".join(text for role, text in got[r.conv_id] if role == "assistant")
        assert (r.turns_sha256, r.loss_sha256, r.loss_chars, r.n_turns) == (hashlib.sha256(want.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), len(loss), len(got[r.conv_id]))
    assert op4_chat.read_back(op4_chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("module", [op4_chat, op9_warc])
def test_oracle(spark, data, module):
    same(spark, data, module.query, module.ORACLE_SQL)


CAPTURES = [
    (1, "u", "x" * 200), (2, None, "x" * 200), (3, "a\r\nb", "x" * 200), (4, "q", None), (5, "q", ""), (6, "s", "é" * 60), (7, "t", "é" * 60), (8, "sm", "ab"), (9, "sm", "ab"), (10, "w", "WARC/1.1\r\n\r\nContent-Length: 4\r\n\r\n" * 9), (11, "z", "\r\n\r\n" * 50),
]


def test_warc(spark, folder, tmp_path):
    pages = spark.createDataFrame([(*c, "digest", 5) for c in CAPTURES], "page_id long, url string, html string, digest string, salt int").repartition(3)
    path = folder(pages=pages)
    con = duckdb.connect()
    con.sql(f"create view pages as from '{path}/pages.parquet'")
    assert rows(op9_warc.query(spark, path).toPandas()) == rows(con.sql(op9_warc.ORACLE_SQL).df())
    op9_warc.write(pages, str(tmp_path / "warc"), archive_bytes=300)
    assert len(list((tmp_path / "warc").glob("*.gz"))) > 2
    records = op9_warc.read(spark, str(tmp_path / "warc"))
    assert records.count() == 3 * len(CAPTURES)
    by_page = {r.metadata.page_id: r for r in op9_warc.transactions(records).collect()}
    for page, _, html in CAPTURES:
        r = by_page[page]
        assert r.request.record_id and (r.response.payload is None) == (r.response.kind == "revisit")
        if r.response.kind == "response":
            assert bytes(r.response.payload).decode() == (html or "")
    assert by_page[3].response.target == "a%0D%0Ab" and by_page[3].response.refers_to == by_page[1].response.record_id
    twice = spark.createDataFrame([(2, "u", "x" * 200)] * 2 + [(None, "v", "x" * 200)], "page_id long, url string, html string")
    op9_warc.write(twice, str(tmp_path / "twice"))
    kinds = sorted((str(r.metadata.page_id), r.response.kind) for r in op9_warc.transactions(op9_warc.read(spark, str(tmp_path / "twice"))).collect())
    assert kinds == [("2", "response"), ("2", "revisit"), ("None", "revisit")]
    op9_warc.write(twice.filter("false"), str(tmp_path / "none"))
    assert op9_warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_ids_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    pages = spark.createDataFrame([(k % 7, f"u{k % 3}", "x" * 200 if k % 2 else f"{k % 5}") for k in range(90)], "page_id long, url string, html string")
    seen = []
    for k, df in enumerate((pages.repartition(2), pages.repartition(5, "url").orderBy("html"))):
        op9_warc.write(df, str(tmp_path / str(k)), archive_bytes=1000)
        seen.append(sorted((r.record_id, r.kind, r.refers_to, r.payload_digest) for r in op9_warc.read(spark, str(tmp_path / str(k))).collect() if r.kind != "metadata"))
    assert seen[0] == seen[1] and len({r[0] for r in seen[0]}) == 180


def test_warc_streams_members_and_plain_files():
    import gzip
    import io

    records = [f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {n}\r\n\r\n{'y' * n}\r\n\r\n".encode() for n in (0, 5, 3_000_000, 7)]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [len(b) for _, b in op9_warc.parse(io.BufferedReader(op9_warc.Inflated(memoryview(data))))] == [0, 5, 3_000_000, 7]
    with pytest.raises(ValueError, match="cut off"):
        list(op9_warc.parse(io.BytesIO(records[1][:-6])))
