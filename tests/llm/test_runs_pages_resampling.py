"""Importance resampling, page differencing and periodic runs against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as fx
from voxelith.llm import basic_factor_runs, dictionary_resampling, page_differencing
from voxelith.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


# 11


def features(text, order=2):
    w = fx.item_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


@pytest.mark.parametrize("order", [1, 2, 3])
def test_payloads_compose(order):
    texts = ["Hello, World é日本 x1", "", "  ", "a" * 300 + " b " + "c日" * 700 + " d", "one", "  nbsp joined"]
    found = list(dictionary_resampling.features(pa.array(texts, pa.large_string()), order, 1 << 32))
    for k, text in enumerate(texts):
        w = fx.item_words(text)
        for n, (buckets, offsets) in enumerate(found, 1):
            want = [zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)]
            assert buckets[offsets[k] : offsets[k + 1]].tolist() == want


def resampled(rows, target, percent, least, seed, buckets=dictionary_resampling.BUCKETS):
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for r in rows:
        for f in features(r["text"]):
            s[bucket(f, buckets)] += 1
    for text in target:
        for f in features(text):
            t[bucket(f, buckets)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for r in rows:
        f = features(r["text"])
        weight = sum(gain[bucket(x, buckets)] for x in f) // len(f) if f else 0
        name = "" if r["doc_id"] is None else r["doc_id"]
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        out.append([r["doc_id"], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(fx.item_words(r["text"]))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling(spark, docs, rows):
    target = ["shared words here", fx.story(1, 30), None, ""]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id bigint, text string")
    more = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit(fx.story(9, 50))))
    want = resampled([r.asDict() for r in more.collect()], target, 50, 20, 7)
    got = dictionary_resampling.resample(more, items, 50, 20, 7).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) >= 5


def test_draws_follow_ties_and_all_can_be_drawn(spark):
    docs = spark.createDataFrame([(k % 50, "same words " * 20) for k in range(100)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "other")], "item_id bigint, text string")
    for percent in (0, 33, 100):
        got = dictionary_resampling.resample(docs, items, percent, 20, 7).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted((tuple(r) for r in got), key=str) == resampled([r.asDict() for r in docs.collect()], ["other"], percent, 20, 7)
        assert sorted(r.rank for r in got if r.rank is not None) == list(range(1, percent + 1))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dictionary_resampling.resample(fx.empty(spark), none, 25, 20, 7).collect() == []
    got = dictionary_resampling.resample(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), none, 100, 1, 7).collect()
    assert [(r.n_features, r.rank) for r in got] == [(3, 1)]


# 12


def test_alignment_is_longest():
    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice(s) for _ in range(rng.randint(0, 14))] for s in ("abcde", "abcdf"))
        for bits in (1 << 24, 4):
            found = page_differencing.common_lines(a, b, bits)
            rest = iter(b)
            assert found == sorted(set(found)) and len(found) == length(a, b)
            assert all(any(a[k] == y for y in rest) for k in found)


def numbered(k):
    return page_differencing.Page(k, None, k, "h", f"/{k:03}", True, np.array([k, 100, 200 + k // 2]).tobytes(), bytes(3))


def test_ranges_do_not_change_decisions():
    rng = random.Random(3)
    for n in range(10):
        whole = {r[0]: r[8] for r in page_differencing.stream(map(numbered, range(n)), True)}
        for _ in range(20):
            pages, got, parts = [numbered(k) for k in range(n)], {}, 2
            while parts > 1:
                parts = rng.randint(1, 4)
                cuts = sorted(rng.randint(0, len(pages)) for _ in range(parts - 1))
                ends = []
                for low, high in zip([0, *cuts], [*cuts, len(pages)]):
                    for r in page_differencing.stream(pages[low:high], parts == 1):
                        if r[8] is None:
                            ends.append(page_differencing.Page(*r[:8]))
                        else:
                            assert r[0] not in got
                            got[r[0]] = r[8]
                pages = ends
            assert got == whole


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain &lt;text&gt; &amp it", "plain <text> & it"),
    ("<title>t</title><script>var t='</p>';</script><style>p{}</style><p>a<!-- c --> b\n\t c&nbsp;d", "a b c d"),
    ("<nav><ul><li>x</ul></nav><article><h1>H</h1><p>one<p>t<b>w</b>o<br>three<ul><li>i<li>j</ul><footer>f</footer></article>out", "H one two three i j"),
    ('<div id="cookie-banner">c</div><main class="has-sidebar">m <span class="ad">X</span>n<div class="share-bar">s</div><article class="comment">r</article></main>', "m n"),
    ('<article><p title="a>b">kept</p><p hidden>no</p><div role="navigation">no</div><form>no</form></article><footer>no', "kept"),
    ("<header>no</header><p>yes <em>so</em>me</p><aside>no</aside> 1 < 2 <p", "yes some 1 < 2"),
    ("<article>cut <!-- off", "cut"), ("<article>cut <a href='x", "cut"), ("</p></div>loose <b>bold", "loose bold"),
])
def test_page_text(html, text):
    assert page_differencing.main_text(page_differencing.page_lines(html or ""), []) == text


def test_pages_lose_what_their_neighbours_share(spark):
    body = "<div>Menu one</div><div>{0}</div><div>{0} more</div><div>Imprint</div>"
    data = [
        (1, "http://a.b/x/1", body.format("first")), (2, "http://a.b/x/2", body.format("second")), (3, "http://A.B/y/1", "<div>Menu one</div>third"),
        (4, "http://c.d/x/1", body.format("alone")), (5, None, body.format("no host")), (6, None, body.format("nor here")), (7, "http://a.b/x/1", None),
        (8, "http://e.f/1", body.format("copy")), (9, "http://e.f/1", body.format("copy")), (9, "http://e.f/1", body.format("copy")),
    ]
    pages = spark.createDataFrame([(*r, "x", 1) for r in data], "page_id bigint, url string, html string, id string, host int")
    whole = "Menu one {0} {0} more Imprint"
    want = sorted([
        (1, "first first more"), (2, "second second more"), (3, "third"), (4, whole.format("alone")), (5, whole.format("no host")),
        (6, whole.format("nor here")), (7, ""), (8, whole.format("copy")), (9, whole.format("copy")), (9, whole.format("copy")),
    ])
    for size in (1 << 20, 200, 1):  # one range, some, one a page
        got = page_differencing.extract(pages, partition_bytes=size)
        assert got.columns == ["page_id", "url", "text"]
        assert sorted((r.page_id, r.text) for r in got.collect()) == want
    assert page_differencing.extract(pages.limit(0)).collect() == []


# 13


def runs(w, least=6, exponent=4):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, exponent * q) and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.add((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(500):
        texts = []
        for _ in range(rng.randint(0, 4)):
            w = []
            while len(w) < rng.randint(0, 60):
                w += [rng.randint(0, 2) for _ in range(rng.randint(1, 7))] * rng.randint(1, 6)
            texts.append(w)
        offsets = np.cumsum([0, *map(len, texts)])
        got = basic_factor_runs.repetitions(np.array([x for w in texts for x in w], np.int64), offsets)
        assert [tuple(r) for r in got.tolist()] == [(s + at, s + at + n, q) for w, at in zip(texts, offsets.tolist()) for s, n, q in runs(w)]


def collapsed(w):
    gone = {k for s, n, q in runs(w) for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_of_documents(spark, docs, rows):
    got = sorted((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in basic_factor_runs.find_runs(docs).collect())
    short = [r for r in rows if r["doc_id"] != 12]
    assert [g for g in got if g[0] != 12] == sorted((r["doc_id"], tuple(runs(fx.words(r["text"]))), collapsed(fx.words(r["text"]))) for r in short)
    assert [g[1] for g in got if g[0] == 12] == [()] and any(g[1] for g in got)
    assert basic_factor_runs.find_runs(fx.empty(spark)).collect() == []


def test_longest_run_ties(spark):
    data = [(1, [(5, 8, 2), (0, 8, 2), (0, 8, 1), (9, 7, 1)]), (2, [])]
    df = spark.createDataFrame(data, "doc_id int, runs array<struct<start: bigint, length: bigint, period: bigint>>")
    got = {r.doc_id: r.best for r in df.select("doc_id", basic_factor_runs.longest(F.col("runs")).alias("best")).collect()}
    assert tuple(got[1]) == (0, 8, 1) and got[2] is None


def test_runs_query_against_brute_force(spark, tmp_path):
    data = [(k, fx.story(k, 3 + 7 * k % 90)) for k in range(120)] + [(500, None), (501, ""), (502, " \n"), (None, "a " * 9), (503, "x y " * 30 + "z"), (503, "x y " * 30 + "z")]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, text in data:
        w, h = fx.words(text), fx.crc(k) if k is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs(w)
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want.append((k, len(found), s, n, q, n and 1000 * n // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w).encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["op13_basic_factor_runs"](spark, str(tmp_path)).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert sum(fx.crc(k) % 10 == 0 for k, _ in data[:120]) >= 5


def test_resampling_searches_a_text_once(spark, docs, tmp_path, monkeypatch):
    """Features of the corpus are found in one pass and stored; counting and scoring read them."""
    asked = []
    whole = dictionary_resampling.found_features
    monkeypatch.setattr(dictionary_resampling, "found_features", lambda df, *a: asked.append(df) or whole(df, *a))
    items = spark.createDataFrame([("a b c",)], "text string")
    dictionary_resampling.resample(docs, items, 50, 20, 7).collect()
    assert asked == [docs, items]


@pytest.mark.parametrize("buckets", [7, 1 << 16, 70_000])
def test_stored_features(spark, buckets):
    texts = ["a b a", None, "", "Word " * 300, "é ü x", " , "]
    found = dictionary_resampling.found_features(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k", "text", 2, buckets)
    for row in found.collect():
        words = "".join(c if c.isalnum() else " " for c in (texts[row.doc_id] or "").replace("W", "w")).split()
        runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        assert row.n_words == len(words)
        assert sorted(np.frombuffer(row.found, dictionary_resampling.stored_kind(buckets))) == sorted(zlib.crc32(r.encode()) % buckets for r in runs)
