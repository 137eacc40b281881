"""Operators that SQL cannot express as a whole, against plain versions of their own
over whole tables, and SQL for the columns that it can give."""

import collections
import datetime
import hashlib
import html as html_lib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from vicinage.llm import html_extract, mixing, packing, pii, queries, syncmers, toxicity, warc
from vicinage.llm.queries import vocabulary_path

WORD = r"[^\x20\x09-\x0D]+"


def rows_of(spark, sf_dir, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).collect()]


def sql(sf_dir, name, text):
    return duckdb.connect().sql(f"WITH {name} AS (SELECT * FROM '{sf_dir}/{name}.parquet') {text}").fetchall()


# ------------------------------------------------------------------- packing
def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    texts = ["see <|endoftext|> here", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "a<|endoftext|>b", "<|endof<|endoftext|>", "x  <|endoftext|>  y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs.coalesce(1), vocabulary_path()).collect() if r["length"] == r["doc_tokens"]}
    for i, crc in got.items():
        assert crc == zlib.crc32(np.array(t.encode(texts[i], add_special_tokens=False).ids + [1], "<u4").tobytes()), texts[i]
    assert len(got) >= 3 and packing.piece_ids(vocabulary_path()).text(texts[0]) == np.array([3826, 220, 50256, 994], "<u4").tobytes()


def test_the_cache_of_pieces_is_bounded(monkeypatch):
    known = packing.piece_ids(vocabulary_path())
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    known.clear()
    text = " ".join(f"word{i}" for i in range(3000))
    whole = known.text(text)
    assert known._held <= 10_000 and len(known) < 50 and len(known._before) < 50
    assert whole == known.direct(text)


# -------------------------------------------------------------------- mixing
def plain_targets(sizes):
    """Targets of sources in order, by the contract: shares by weight, twice the size at
    most, the excess shared again."""
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    targets, fixed = [0.0] * len(sizes), set(k for k, s in enumerate(sizes) if not s)
    while True:
        left = 1.5 * sum(sizes) - sum(targets[k] for k in fixed)
        free = [k for k in range(len(sizes)) if k not in fixed]
        if not free:
            return targets
        for k in free:
            targets[k] = left * weights[k] / sum(weights[j] for j in free)
        over = [k for k in free if targets[k] > 2 * sizes[k]]
        if not over:
            return targets
        for k in over:
            targets[k] = 2.0 * sizes[k]
            fixed.add(k)


def check_mix(rows, texts):
    """``rows`` of the query against the contract, for documents ``id -> (text, source)``."""
    size = {i: len(re.findall(WORD, t or "")) for i, (t, _) in texts.items()}
    by_source = collections.Counter()
    for i, (_, s) in texts.items():
        by_source[s] += size[i]
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(names, plain_targets([by_source[s] for s in names]), strict=True))
    taken = collections.Counter()
    for i, n, source_size, target, words in rows:
        s = texts[i][1]
        assert n == size[i] and source_size == by_source[s] and target == pytest.approx(targets[s])
        assert 0 <= words <= 2 * n
        taken[s] += words
    for s in names:
        assert abs(taken[s] - targets[s]) <= 1 + 0.005 * targets[s], (s, taken[s], targets[s])


def test_mixing_equals_the_contract(spark, sf_dir):
    texts = {i: (t, s) for i, t, s in rows_of(spark, sf_dir, "documents", "doc_id", "text", "source")}
    rows = [tuple(r) for r in queries.op2_mixing(spark, sf_dir).collect()]
    assert len(rows) == len(texts)
    check_mix(rows, texts)
    assert sorted(rows) == sorted(map(tuple, queries.op2_mixing(spark, sf_dir).collect()))
    given = sql(sf_dir, "documents", f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')), sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) OVER (PARTITION BY source) FROM documents")
    assert sorted(r[:3] for r in rows) == sorted((a, b, int(c)) for a, b, c in given)


def test_many_small_sources_meet_their_targets(spark):
    texts = {i: (" ".join(["w"] * 20), f"s{i:02}") for i in range(40)} | {100 + i: (" ".join(["w"] * n), "tiny") for i, n in enumerate((1, 2, 0))} | {200: (None, None)}
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in texts.items()], "doc_id long, text string, source string")
    check_mix([(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()], texts)


def test_one_id_does_not_make_one_shard(spark, monkeypatch):
    """Rows of one id with different texts, and ties in id and size: reruns agree."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 50)
    monkeypatch.setattr(mixing, "SHARD_ROOTS", 0)
    rnd = random.Random(1)
    rows = [(None if i % 3 else 7, " ".join(rnd.choice("abcdefgh") for _ in range(10)), "x" if i % 2 else "y") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    draw = lambda d: sorted((r["row"]["text"], r["taken"], r["extra_from"]) for r in mixing.mix(d, keep=True).collect())
    first = draw(docs)
    assert first == draw(docs.repartition(5)) and sum(t for _, t, _ in first) == pytest.approx(4500, abs=40)


# -------------------------------------------------------------- fingerprints
def plain_fingerprint(text, k=11, s=4):
    """Closed syncmers by their definition, with Python's integers."""
    mask = 2**64 - 1

    def finish(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & mask
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & mask
        return x ^ (x >> 33)

    def gram(codes):
        x = 0
        for c in codes:
            x = (x * 0x9E3779B97F4A7C15 + c) & mask
        return finish(x)

    codes, out = [ord(c) for c in text], []
    for at in range(len(codes) - k + 1):
        small = [gram(codes[at + j : at + j + s]) for j in range(k - s + 1)]
        if min(small) in (small[0], small[-1]):
            anchor = f"{gram(codes[at : at + k]) >> 32:08x}"
            if anchor not in out:
                out.append(anchor)
    return "".join(out) if out or not text else hashlib.blake2b(text.encode(), digest_size=4).hexdigest()


def plain_likeness(a, b):
    x, y = ([f[i : i + 8] for i in range(0, len(f), 8)] for f in (a, b))
    if x == y:
        return 1.0
    place = {h: k for k, h in enumerate(y)}
    common = [place[h] for h in x if h in place]
    longest = [1] * len(common)
    for i in range(len(common)):
        longest[i] = 1 + max((longest[j] for j in range(i) if common[j] < common[i]), default=0)
    return max(longest, default=0) / (len(set(x) | set(y)) or 1)


def test_fingerprints_equal_their_definition():
    rnd = random.Random(3)
    texts = ["", "hello world", "good morning", "é😀 " * 20] + ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 150))) for _ in range(25)]
    for t in texts:
        assert syncmers.fingerprint(t) == plain_fingerprint(t)
    for a in texts[:12]:
        for b in texts[:12]:
            b = a[: len(a) // 2] + b
            assert syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) == pytest.approx(plain_likeness(plain_fingerprint(a), plain_fingerprint(b)))


def test_edited_texts_equal_sql(spark, sf_dir):
    want = sql(sf_dir, "documents", "SELECT doc_id, length(t) AS n, sha256(left(t, n - n // 2) || left(coalesce(lead(t) OVER w, first_value(t) OVER w), n // 2)) FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (ORDER BY doc_id)")
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in queries.op5_syncmers(spark, sf_dir).collect()]
    assert sorted(got) == sorted(map(tuple, want))


@pytest.mark.parametrize("ranges", [1, 2, 7, 40, 300])
def test_ranges_follow_the_ids(spark, ranges):
    from pyspark.sql import functions as F

    df = spark.range(500).select((F.col("id") * F.col("id")).alias("doc_id"))
    number, most = syncmers._range_number(df, ranges)
    rows = sorted((r["doc_id"], r["n"]) for r in df.select("doc_id", number.alias("n")).collect())
    assert [n for _, n in rows] == sorted(n for _, n in rows) and rows[-1][1] < most
    assert max(collections.Counter(n for _, n in rows).values()) <= 4 * 500 / ranges + 2


# ------------------------------------------------------------------ toxicity
def test_gradient_equals_a_dense_one():
    rnd = random.Random(2)
    words = ["idiot", "trash", "transit", "women", "men", "transgender", "fine", "day", "gay", "loser"]
    texts = [". ".join(" ".join(rnd.choice(words) for _ in range(3)) for _ in range(3)) for _ in range(30)]
    y = np.array([rnd.random() < 0.4 for _ in texts])
    features = sorted({f for w in words[:7] for f in toxicity.word_features(w)})
    has = lambda bag: np.array([float(any(f in toxicity.word_features(w) for w in bag)) for f in features])
    x = np.array([has(set(re.findall(r"\w+", t))) for t in texts])
    changes = []
    for t in texts:
        for sentence in t.split("."):
            bag = set(sentence.split())
            if not bag:
                continue
            for name in bag & toxicity.SWAPS.keys():
                changes += [has(bag) - has(bag - {name} | {other}) for other in toxicity.SWAPS[name]]
            changes += [has(bag) - has(bag | {name}) for name in toxicity.SWAPS if name not in bag]
    changes = np.array([c for c in changes if c.any()])

    def loss(v):
        w, b = v[:-1], v[-1]
        weight = np.where(y, toxicity.TOXIC_WEIGHT, 1.0)
        margin = (x @ w + b) * np.where(y, 1, -1)
        return (weight / weight.sum() * np.log1p(np.exp(-margin))).sum() + 0.01 / 2 * w @ w + 3.0 * ((changes @ w) ** 2).mean()

    it = toxicity.problem([toxicity.example(t) for t in texts], y, features)
    v = np.random.default_rng(0).normal(size=len(features) + 1)
    step = 1e-6
    dense = np.array([(loss(v + step * e) - loss(v - step * e)) / (2 * step) for e in np.eye(len(v))])
    np.testing.assert_allclose(it.gradient(v[:-1], v[-1], 0.01, 3.0), dense, atol=1e-5)


def test_names_change_scores_of_table_rows(spark, sf_dir):
    """The counterfactual term acts on the table: without it a beginning that a name
    shares with an insult counts, with it it does not, and rows' scores change."""
    folder = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.join(labels.select("doc_id"), "doc_id", "left_semi").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    learnt = [i for i in sorted(rows) if zlib.crc32(str(i).encode()) % 3 != 1 and toxic[i] is not None]
    examples = [toxicity.example(rows[i]) for i in learnt]
    plain, fair = (toxicity.fit_examples(examples, [toxic[i] for i in learnt], counterfactual=c) for c in (0.0, toxicity.COUNTERFACTUAL))
    raised = lambda m: max(abs(m.margin(f"they met {name} today") - m.margin("they met today")) for name in toxicity.SWAPS)
    assert raised(plain) > 0.5 and raised(fair) < 0.2 * raised(plain)
    assert sum(plain.score(t) != fair.score(t) for t in list(rows.values())[:500]) > 50


def test_held_out_rows_equal_sql(spark, sf_dir):
    got = {r["doc_id"]: r["held_out"] for r in queries.op7_toxicity(spark, sf_dir).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for (i,) in rows_of(spark, sf_dir, "documents", "doc_id")}


def test_long_labelled_texts_are_learnt_from(spark):
    long = "fine words here " * 10_000
    docs = spark.createDataFrame([(i, (long if i % 2 else "") + ("vilest insult" if i % 2 else "good day")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.score("vilest insult") > 0.7 > model.score("good day")


# ----------------------------------------------------------------------- html
def plain_article(page):
    """The article element of the given pages, line by line, without any parser."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page or "")
    if not inner:
        return ""
    parts = re.split(r"</?(?:p|h1|ul|li|div)[^>]*>", inner[1].replace("<br>", " "))
    lines = (" ".join(html_lib.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts)
    return "\n".join(x for x in lines if x)


def test_extraction_equals_a_line_by_line_version(spark, sf_dir):
    pages = rows_of(spark, sf_dir.replace("0.001", "0.01"), "pages", "page_id", "html")
    got = {r["page_id"]: r["text"] for r in queries.op9_html(spark, sf_dir.replace("0.001", "0.01")).collect()}
    assert got == {i: plain_article(page) for i, page in pages}


def test_content_lines_decide(spark, sf_dir, monkeypatch):
    """Without the ratios every page's text is another one; without markup's names and
    tags hardly any is; and without article elements none is."""
    pages = [h for (h,) in rows_of(spark, sf_dir.replace("0.001", "0.01"), "pages", "html") if h]
    want = [html_extract.main_text(h) for h in pages]
    same = lambda other: sum(a == html_extract.main_text(b) for a, b in zip(want, other, strict=True)) / len(pages)
    assert same([h.replace("<article>", "<div>").replace("</article>", "</div>") for h in pages]) == 1
    for flags in (True, False):
        with monkeypatch.context() as m:
            m.setattr(html_extract, "content_lines", lambda ratios, f=flags: [f] * len(ratios))
            assert same(pages) == 0
    monkeypatch.setattr(html_extract, "BOILERPLATE_NAMES", frozenset())
    monkeypatch.setattr(html_extract, "BOILERPLATE_TAGS", frozenset())
    assert same(pages) > 0.95
    assert same([h.replace("<article>", "<div>").replace("</article>", "</div>") for h in pages]) > 0.75


def test_deep_pages_take_linear_time():
    def seconds(page):
        began = time.perf_counter()
        html_extract.main_text(page)
        return time.perf_counter() - began

    for make in (lambda n: "<div>x " * n, lambda n: "<p>" + "<i>" * n + "<p></p>" * n, lambda n: "<b>" + "<div></b>" * n, lambda n: "<dl><dd><div>" + "<i>" * n + "<dd></dd>" * n, lambda n: "<li>x" * n + "</ul>" * n):
        seconds(make(1000))
        assert seconds(make(32_000)) < 40 * max(seconds(make(4000)), 0.01)


def test_smoothing_and_threshold():
    assert html_extract.content_lines([]) == [] and html_extract.content_lines([5.0]) == [True]
    ratios = [1.0, 2.0, 1.0, 80.0, 3.0, 90.0, 70.0, 1.0, 2.0]
    assert html_extract.content_lines(ratios) == [False, False, False, True, True, True, True, False, False]
    assert html_extract.content_lines([0.0, 50.0, 0.0]) == [False, True, False] and not any(html_extract.content_lines([0.0, 0.0]))


# ------------------------------------------------------------------------ pii
class Inverse(pii.Feistel):
    """The permutations backwards."""

    def _once(self, x, half, tweak):
        mask, width = (1 << half) - 1, (half + 7) // 8
        a, b = x >> half, x & mask
        for r in reversed(range(pii.ROUNDS)):
            digest = hashlib.blake2b(tweak + bytes([r]) + a.to_bytes(width, "big"), key=self.key, digest_size=max(16, width)).digest()
            a, b = b ^ (int.from_bytes(digest, "big") & mask), a
        return (a << half) | b


def test_pseudonyms_lead_back_to_the_texts(spark, sf_dir):
    """An exact round trip over the whole table: the values found in the result, permuted
    backwards, give the texts again."""
    texts = dict(rows_of(spark, sf_dir.replace("0.001", "0.01"), "documents", "doc_id", "text"))
    back, changed, differ = Inverse(queries.DEMO_KEY), 0, []
    for r in queries.op10_pii(spark, sf_dir.replace("0.001", "0.01")).collect():
        t = texts[r["doc_id"]]
        changed += t != r["text"]
        assert (t != r["text"]) == (r["n_found"] > 0)
        if t is not None and pii.pseudonymise(r["text"], back)[0] != t:
            differ.append(r["doc_id"])
    assert changed > 20 and not differ


def test_address_pseudonyms_are_valid():
    f, rnd, seen = pii.Feistel(b"key"), random.Random(4), {}
    for _ in range(3000):
        a = ".".join(str(rnd.randrange(256)) for _ in range(4))
        if (b := pii.ip(f, a)) is not None:
            assert pii.ip(f, b) is not None and seen.setdefault(b, a) == a and pii.ip(Inverse(b"key"), b) == a
    assert len(seen) > 2900


def test_hostile_texts_take_linear_time():
    f = pii.Feistel(b"key")

    def seconds(text):
        began = time.perf_counter()
        pii.pseudonymise(text, f)
        return time.perf_counter() - began

    for part in ("%20", "a@a.", "a.", "12-", "A1 ", "+1 ", "a@a-"):
        assert seconds(part * 32_000) < 40 * max(seconds(part * 4000), 0.01), part


def test_dates_stay_dates():
    f = pii.Feistel(b"key")
    days = {f.permute(d, pii.DAYS, "date") for d in range(pii.DAYS)}
    assert len(days) == pii.DAYS
    new = pii.date(f, "2021-03-05")
    datetime.date.fromisoformat(new)


# ----------------------------------------------------------------------- warc
def whole_record(k, payload):
    return warc.record(k, f"http://x/{k}", payload, hashlib.sha1(payload).digest(), len(payload), None, False, "2024-01-01T00:00:00Z")


def test_members_of_several_records():
    rnd = random.Random(5)
    records = [whole_record(k, bytes(rnd.randrange(256) for _ in range(3000))) for k in range(8)]
    member = warc.gzip_member(b"".join(records))
    found = list(warc.walk(member))
    assert [x[0] for x in found] == ["record"] * 8 and sum(x[2] for x in found) == len(member)
    damaged = bytearray(member)
    damaged[len(member) * 3 // 4] ^= 0xFF
    found = list(warc.walk(bytes(damaged) + warc.gzip_member(whole_record(9, b"after"))))
    ids = [warc._page(x[3]["head"]["warc-record-id"]) for x in found if x[0] == "record"]
    assert ids[:5] == [0, 1, 2, 3, 4] and ids[-1] == 9 and [x[0] for x in found].count("gap") == 1


def test_damage_everywhere_takes_linear_time():
    def seconds(n):
        data = (b"\x1f\x8b\x08" + b"damaged member ") * n
        began = time.perf_counter()
        assert sum(x[2] for x in warc.walk(data)) == len(data)
        return time.perf_counter() - began

    assert seconds(16_000) < 40 * max(seconds(2000), 0.01)


def test_very_large_payloads_and_bounded_files(spark, tmp_path, monkeypatch):
    rnd = random.Random(6)
    noise = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    rows = [(0, "u", noise(3_000_000)), (1, "u", "x" * 30_000_000)] + [(i, "u", noise(2000)) for i in range(2, 200)]
    monkeypatch.setattr(warc, "ROW_BYTES", 20_000)
    monkeypatch.setattr(warc, "FILE_ROWS", 2)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    files = [p.stat().st_size for p in (tmp_path / "w").iterdir() if p.suffix == ".txt"]
    assert len(files) > 5 and sorted(files)[-2] < 100_000
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows}


# -------------------------------------------------------------------- license
def test_method_adds_labels_on_the_table(spark, sf_dir):
    rows = queries.op3_licenses(spark, sf_dir.replace("0.001", "0.01")).collect()
    texts = dict(rows_of(spark, sf_dir.replace("0.001", "0.01"), "documents", "doc_id", "text"))
    added = {r["doc_id"] for r in rows if "cc-by-nc" in r["labels"].split(",")}
    assert added and added == {i for i, t in texts.items() if "Licensed under CC BY-NC 4.0" in (t or "")}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in rows)


# ------------------------------------------------------------------- pipeline
def test_stages_bear_odd_rows(spark, sf_dir, monkeypatch):
    """Null ids, texts and sources, empty and very long texts, repeated rows."""
    import corpus_pipeline as pipeline

    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = [(1, "a b c d e f g", "en", "x"), (1, "a b c d e f g", "en", "x"), (2, None, "en", "x"), (3, "", None, None), (None, "lost words here", "en", "y"), (None, None, None, None), (5, "lorem ipsum dolor sit amet " * 20_000, "en", "y"), (6, "mail a.b@c.org or 4111 1111 1111 1111", "en", "z")]
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in odd], schema)
    sizes = []
    for _, stage in pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, sf_dir)
        docs = docs.cache()
        sizes.append(docs.count())
        if len(sizes) < 5:
            assert docs.columns == before
    assert sizes[:3] == [8, 7, 7]
    hidden = [r["text"] for r in pipeline.hide_personal_data(spark, spark.createDataFrame([(6, odd[-1][1], "en", "z", 1)], schema), sf_dir).collect()]
    assert "4111" not in hidden[0] and hidden[0].startswith("mail ") and hidden[0].count("@") == 1
