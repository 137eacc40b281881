"""Top-k search, WARC archives, HTML extraction, registered queries and the pipeline."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.llm import html_extract, queries, voronoi, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir, same):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


def brute_top(rows, k, every):
    out = []
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v)))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("copies", [0, 90])
def test_top_k_equals_brute_force(spark, copies):
    """Many bundles, chunks and rounds; vectors of several lengths and repeated ids."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(240, 6))
    vectors[:copies] = vectors[0]  # one very common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(40, [0.5] * 6), (40, [0.5] * 6), (7, [1.0, 2.0]), (20, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = voronoi.top_inner_products(df, k=5, every=20, block=40, chunk=6, step=2).collect()
    assert sorted(map(tuple, got)) == brute_top([(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows], 5, 20)


def test_bundles_hold_every_cell_once():
    counts = [3, 50, 2, 2, 0, 9, 41]
    first, number, free = voronoi.bundles([2, 0, 3, 1, 5, 4, 6], counts, 10, 4)
    assert first[2] == first[0] == first[3] == 4 and number[1] == 5 and first[5] == first[4] == 10 and number[6] == 5
    assert free == 16 and sorted({b for c in first for b in range(first[c], first[c] + number[c])}) == list(range(4, 16))


def test_bounds_are_upper_bounds(spark):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(300, 5)) * 64)
    p = x[:7]
    cell = ((x[:, None] - p[None]) ** 2).sum(2).argmin(1)
    radius = np.array([np.sqrt(((x[cell == c] - p[c]) ** 2).sum(1)).max() for c in range(7)])
    norm = np.array([np.sqrt((x[cell == c] ** 2).sum(1)).max() for c in range(7)])
    space = voronoi.Space(p, radius, norm, np.array([0, 2, 5]), np.array([0, 1, 1, 2]), 0)
    bounds = space.bounds(x)
    for c in range(7):
        bundle = 0 if c < 2 else 1 if c < 5 else 3
        assert ((x @ x[cell == c].T).max(1) <= bounds[:, bundle]).all()


def test_large_components_stay_exact():
    q = np.array([[2**40, -3]]), np.array([[2**20, 5], [1, 1]])
    assert voronoi.inner_products(*q).tolist() == [[2**60 - 15, 2**40 - 3]]


PAGES = [(1, "http://a/ä b", "x" * 1500), (2, "http://b", "x" * 1500), (3, None, "x" * 1500), (4, "http://c\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "x" * 1500), (8, "u", "é" * 600), (8, "u", "é" * 600)]


def written(spark, tmp_path, rows=PAGES):
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, size int, digest string")
    warc.write_archives(pages, str(tmp_path / "w"))
    return [p for p in (tmp_path / "w").iterdir() if p.suffix == ".txt"]


def test_warc_round_trip(spark, tmp_path):
    files = written(spark, tmp_path)
    rows = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert len(rows) == len(PAGES) and not [r for r in rows if r["kind"] == "gap"]
    by_id = {r["page_id"]: r for r in rows}
    for i in (1, 2, None):
        assert (by_id[i]["kind"], by_id[i]["refers_to"], by_id[i]["payload_bytes"]) == ("revisit", 3, 1500)
    assert by_id[3]["kind"] == "response" and bytes(by_id[3]["payload"]) == b"x" * 1500
    assert {by_id[i]["kind"] for i in (4, 5, 6, 7, 8)} == {"response"}
    for i, _, html in PAGES:
        data = (html or "").encode()
        assert by_id[i]["payload_digest"] == hashlib.sha1(data).hexdigest() and by_id[i]["payload_bytes"] == len(data)
    import gzip

    assert all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n") for p in files if p.stat().st_size)


def test_warc_empty_table(spark, tmp_path):
    written(spark, tmp_path, [])
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def archive(compressed, n=6):
    rnd = random.Random(8)
    out = []
    for k in range(n):
        payload = bytes(rnd.randrange(256) for _ in range(400))
        data = warc.record(k, f"http://x/{k}", payload, hashlib.sha1(payload).digest(), len(payload), None, False, "2024-01-01T00:00:00Z")
        out.append(warc.gzip_member(data) if compressed else data)
    return out


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_after_damage(compressed):
    parts = archive(compressed)
    starts = np.cumsum([0, *map(len, parts)])
    whole = b"".join(parts)
    intact = list(warc.walk(whole))
    assert [x[0] for x in intact] == ["record"] * 6 and sum(x[2] for x in intact) == len(whole)
    for damage in ("flip", "cut", "junk", "header"):
        data = bytearray(whole)
        if damage == "flip":
            data[starts[2] + len(parts[2]) // 2] ^= 0xFF
        elif damage == "cut":
            del data[starts[2] + 50 : starts[3]]
        elif damage == "junk":
            data[starts[2] : starts[2]] = b"junk \x1f\x8b\x08 and WARC/ more"
        else:
            data[starts[2] : starts[2] + 4] = b"????"
        found = list(warc.walk(bytes(data)))
        ids = [warc._page(x[3]["head"]["warc-record-id"]) for x in found if x[0] == "record"]
        gaps = [x for x in found if x[0] == "gap"]
        assert ids == ([0, 1, 2, 3, 4, 5] if damage == "junk" else [0, 1, 3, 4, 5]), damage
        assert gaps and gaps[0][1] == starts[2]
        assert sum(x[2] for x in found) == len(data)


def test_cut_archive_keeps_its_start():
    data = b"".join(archive(True))
    found = list(warc.walk(data[: len(data) - 30]))
    assert [x[0] for x in found] == ["record"] * 5 + ["gap"]


def test_digest_header_is_base32():
    payload = b"abc"
    data = warc.record(1, "u", payload, hashlib.sha1(payload).digest(), 3, None, False, "2024-01-01T00:00:00Z")
    assert b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()) in data


HTML = """<html><head><title>T &amp; t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, as every page does these days.</div>
<aside id="sidebar"><p>Other stories that you may like to read as well.</p></aside>
%s
<form><label>Mail</label><input><button>Go</button></form>
<div class="ad">Buy now and save a lot of money on all of our goods.</div>
<section id="comments"><p>First! I liked this very long story, thanks for writing it down.</p></section>
<footer>&copy; 2024 &middot; Imprint</footer></body></html>"""
BODY = "<h1>A  heading</h1><p>The <b>first</b> paragraph &lt;of&gt; text,\n with&nbsp;space.</p><p>Short.</p><ul><li>An item</li><li>Another</li></ul><p>Last paragraph with some more words in it, so that it counts.<br>Next line.</p>"
LINES = "A heading\nThe first paragraph <of> text, with space.\nShort.\nAn item\nAnother\nLast paragraph with some more words in it, so that it counts. Next line."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='post-body'>%s</div>"])
def test_main_text(wrap):
    assert html_extract.main_text(HTML % (wrap % BODY)) == LINES


def test_broken_pages():
    assert html_extract.main_text("") == "" and html_extract.main_text("plain words") == "plain words"
    assert html_extract.main_text("<article><p><b>One.<br><p>Two &amp; three<p>cut he") == "One.\nTwo & three\ncut he"
    assert html_extract.main_text("<nav>a</nav><script>x") == ""


def test_extract_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" + "long text " * 50_000), (3, "u", "<p>x"), (None, "u", "<p>x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    got = html_extract.extract(df).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 1, 499_999]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    """Each stage against what it promises, on the whole table."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == columns
            docs = docs.cache()
        results.append(docs)
    clean, single, hidden, mixed, packed = results
    assert clean.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    ids = [r[0] for r in single.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) < clean.count()
    assert hidden.count() == single.count() and hidden.where("n_chars <> length(text)").count() == 0
    assert mixed.select("doc_id").distinct().exceptAll(hidden.select("doc_id")).count() == 0
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(mixed) / words(hidden) - 1.5) < 0.1
    assert packed.agg(F.sum("length")).first()[0] > words(mixed)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near duplicates", "personal data", "mixing", "packing"]


def test_pipeline_bears_an_empty_table(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_broad_names_drop_boilerplate_only():
    lines = [f"Paragraph {k} of the story goes on with enough words to be read as running text, as articles have it." for k in range(6)]
    ps = [f"<p>{x}</p>" for x in lines]
    links = "<ul>" + "".join(f'<li><a href="/{k}"><span>Link {k}</span></a></li>' for k in range(5)) + "</ul>"
    for tag in ("article", "main", "div"):
        body = "".join(f'<div class="elementor-widget"><div class="elementor-widget-container">{p}</div></div>' for p in ps)
        assert html_extract.main_text(f"<body><{tag}>{body}</{tag}></body>") == "\n".join(lines)
        assert html_extract.main_text(f'<body><div class="widget">{"".join(ps)}</div></body>') == "\n".join(lines)
    for name in ("notice", "related", "dialog", "share", "social", "login"):
        page = f'<article>{"".join(ps[:3])}<section class="{name}">{"".join(ps[3:])}</section></article>'
        assert html_extract.main_text(page) == "\n".join(lines), name
        page = f'<article>{"".join(ps[:3])}<div class="{name}">{links}</div>{"".join(ps[3:])}<div class="{name}">Share</div></article>'
        assert html_extract.main_text(page) == "\n".join(lines), name
    assert html_extract.main_text(f'<article><div class="entry-header"><h1>Headline</h1></div>{"".join(ps)}</article>') == "\n".join(["Headline", *lines])
    assert html_extract.main_text(f'<article>{"".join(ps)}<div class="comments">{"".join(ps)}</div></article>') == "\n".join(lines)
