import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import html, jaccard, pii, quality, topk


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = 7
        source, sink = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html.minimum_cut(n, source, sink, edges)) - best) < 1e-9


def test_page():
    page = """<html><head><title>T</title><script>var x="</p>";</script></head><body><nav><a href=1>Home</a></nav><div class="ad">Buy this now, please.</div>
    <article><h1>Head &amp; line</h1><p><b>First   words.<br><p>Second&nbsp;one, here.</p></article><section id="comments"><p>Reader says this was a great text.</p></section><footer>&copy; x</footer></body></html>"""
    assert html.main_text(page) == "Head & line\n\nFirst words.\n\nSecond one, here."
    for odd in (None, "", "<", "<p", "<!-- x", "<div>" * 3000, "</p></p>", "<p>" + "word " * 20000):
        html.main_text(odd)


def test_pages_of_the_table(spark, sf):
    """The generated pages hold their main text in one article element."""
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html.op4_html_mincut(spark, sf).collect():
        inside = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:h1|p)>", inside)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_base_spans_against_the_patterns(spark, sf):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("0123 -.+()@a.%1"), rng.integers(0, 60))) for _ in range(4000)] + [None, "", "1" * 3000, "a" * 3000 + "@", "1.1.1.1.1.1.1.1", "+1 +2 (3) 456-7890"]
    for t in texts:
        assert pii.base_spans(t or "") == pii.brute_force(t)[0]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op1_pii_semicrf(spark, sf).collect():
        assert r["base_sha256"] == pii.brute_force(docs[r["doc_id"]])[1]
        assert set(f"{k}:{a}:{b}" for k, a, b in pii.brute_force(docs[r["doc_id"]])[0]) <= set(r["spans"].split(","))


def test_model_on_held_out_sentences():
    weights, right = pii.fitted(), 0
    data = pii.generated(99, 200)
    for text, spans in data:
        base, every = pii.all_spans(text, weights)
        right += {(a, b, k) for k, a, b in every if (k, a, b) not in base} == set(spans)
    assert right >= 0.93 * len(data)


def test_likelihood_sums_to_one():
    text = 'token = "0123456789abcdef0123" or 555-123-4567'
    tokens = [m.span() for m in pii.TOKEN.finditer(text)]
    segments = pii.candidates(text, tokens, [])
    _, p = pii.expected(len(tokens), segments, pii.fitted())
    assert segments and all(0 <= sum(x) <= 1 + 1e-9 for x in p)


def test_redaction(spark):
    rows = [(1, "mail a.b@c.org now", "en", "s", 18), (2, None, "en", "s", None), (3, "clean text", "en", "s", 10), (4, "", "en", "s", 0)]
    out = {r["doc_id"]: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert out[1]["text"] == "mail <EMAIL> now" and out[1]["n_chars"] == 16
    assert out[2]["text"] is None and out[3]["text"] == "clean text" and out[4]["text"] == ""
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    words, texts = [f"w{i}" for i in range(60)], {}
    for i in range(160):
        if i > 5 and rng.random() < 0.65:
            w = (texts[int(rng.integers(i))] or "a b").split(" ")
            for _ in range(int(rng.integers(0, 4))):
                w.insert(int(rng.integers(len(w) + 1)), str(rng.choice(words)))
            texts[i] = " ".join(w)
        elif rng.random() < 0.2:
            texts[i] = [None, "", " \n", "one", "one two", "ONE two"][int(rng.integers(6))]
        else:
            texts[i] = " ".join(rng.choice(words, int(rng.choice([3, 6, 20, 80]))))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_components(df).collect()}
    assert got == jaccard.brute_force(texts)


def test_no_rows_and_chains(spark):
    assert jaccard.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["key"]: r["comp"] for r in jaccard.components(edges).collect()}
    assert set(got.values()) == {0, 100} and got[60] == 0 and len(got) == 63


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8))
    v[50:150] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [1.0] * 7 + [float("nan")]), (1100, [1.0] * 7 + [None]), (1150, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    out = topk.search(topk.integer_vectors(df, "vec_id", "embedding"), F.col("id") % 50 == 0, pivots=8, annuli=4, block=32).collect()
    w = np.floor(256 * v).astype(np.int64)
    for q in range(0, 400, 50):
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-int(w[q] @ w[i]), i))[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert got == [(k + 1, i, int(w[q] @ w[i])) for k, i in enumerate(order)]
    assert len(out) == 40
    assert topk.search(topk.integer_vectors(df.limit(0), "vec_id", "embedding"), F.col("id") % 50 == 0).count() == 0
    few = topk.search(topk.integer_vectors(df.where("vec_id IN (0, 1, 2)"), "vec_id", "embedding"), F.col("id") % 50 == 0).collect()
    assert len(few) == 2


def test_search_with_a_hot_vector_and_several_lengths(spark):
    """A third of the rows are one vector; one vector is longer than all others; ids repeat."""
    rng = np.random.default_rng(4)
    v = [rng.normal(size=6) for _ in range(300)]
    for i in range(100, 200):
        v[i] = v[100]
    v[7] = rng.normal(size=9) * 3
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(50, v[100].tolist())] * 3 + [(120, v[100].tolist())] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.search(topk.integer_vectors(df, "vec_id", "embedding"), F.col("id") % 50 == 0, pivots=6, annuli=4, block=16, first_cells=1).collect()
    w = [(i, np.floor(256 * np.pad(np.asarray(x), (0, 9 - len(x)))).astype(np.int64)) for i, x in rows]
    for q in range(0, 300, 50):
        own = [x for i, x in w if i == q]
        pairs = {(tuple(x), i, k): int(x @ y) for x in own for k, (i, y) in enumerate(w) if i != q}
        distinct = {}
        for (x, i, k), s in pairs.items():
            distinct.setdefault(x, []).append((-s, i))
        want = sorted(((-s, i) for x in {tuple(o) for o in own} for s, i in ((a, b) for a, b in distinct[x])), key=lambda p: (-p[0], p[1]))[:5]
        got = [(r["score"], r["vec_id"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == want


def test_near_duplicates_of_the_table_against_all_pairs(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op5_jaccard_join(spark, sf).collect()}
    assert got == jaccard.brute_force(docs)


def test_clashing_keys_and_odd_ids(spark):
    """Keys of 3 bits make nearly all classes clash; ids are null or repeated."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[i % 20 : i % 20 + 16]) for i in range(60)] + ["", None, "one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_components(df, key_bits=3).collect()}
    assert got == jaccard.brute_force(dict(enumerate(texts)))
    odd = spark.createDataFrame([(None, texts[0]), (None, texts[0]), (7, texts[0]), (7, texts[0]), (7, texts[5]), (None, None)], df.schema)
    out = jaccard.near_components(odd).collect()
    assert len(out) == 6 and {r["component_id"] for r in out if r["n_shingles"]} == {7}


def test_long_words_that_a_polynomial_confuses_are_told_apart(spark):
    """The Thue-Morse word and its complement are equal to any polynomial hash modulo 2^64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    sets = jaccard.shingle_sets([one.encode(), other.encode(), one.upper().encode(), (one[:40] + "B").encode(), (one[:40] + "b").encode()])
    assert sets[0] != sets[1] and sets[0] == sets[2] and sets[3] == sets[4]
    df = spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_components(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_clusters_of_one_component_send_nothing(spark):
    known = spark.range(5000).select(F.col("id").alias("key"), F.lit(1).alias("cluster"), F.lit(0).cast("long").alias("comp"))
    classes = known.select("key", F.lit(3).alias("n"), F.lit(b"01234567").alias("sign"))
    assert jaccard.cluster_pairs(known, classes, 80).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000, 40_000])
def test_filters_hold_every_key(spark, n):
    from loomline.llm.common import bloom_of, bloom_test

    keys = spark.range(n).select(F.xxhash64("id").alias("k"))
    words = bloom_of(keys, "k")
    mine = keys.toPandas()["k"].to_numpy().view(np.uint64) if n else np.zeros(0, np.uint64)
    assert bloom_test(words, mine).all()
    others = spark.range(1 << 40, (1 << 40) + 2000).select(F.xxhash64("id").alias("k")).toPandas()["k"].to_numpy().view(np.uint64)
    assert bloom_test(words, others).mean() < 0.1


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 63, int(rng.integers(0, 100)), dtype=np.uint64)]))
        if len(b):
            assert jaccard.least_difference(jaccard.signature(a), jaccard.signature(b)) <= len(np.setxor1d(a, b))


def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in out]) > 0.95
    assert np.mean([r["keep"] for r in out if r["quality"] == 1]) > 0.98


def test_quality_edges(spark):
    rows = [(1, None, "a", None), (2, "", None, "en"), (3, "Some words stand here.", "a", "en"), (3, "Some words stand here.", "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"host": F.lit(1), "score": F.lit(2)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.classify(docs, none).collect()
    assert len(out) == 4 and all(r["keep"] for r in out)
    assert quality.classify(docs.limit(0), none).count() == 0


def brute_posteriors(rows, site_weight, most_shift):
    """id -> (host posterior, path posterior, score), from the definitions, one row at a time."""
    import math

    def worth(groups, centres):
        n, k = sum(map(len, groups)), len(groups)
        within = sum(sum((x - np.mean(g)) ** 2 for x in g) for g in groups) / max(n - k, 1)
        apart = sum(len(g) * (np.mean(g) - c) ** 2 for g, c in zip(groups, centres, strict=True))
        between = (apart - max(k - 1, 0) * within) / max(n - sum(len(g) ** 2 for g in groups) / n, 1)
        return min(max(within / between if between > 0 else n, 1.0), n)

    hosts, paths = {}, {}
    for _, h, q, p, _ in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    prior = (sum(r[3] for r in rows) + 0.5) / (len(rows) + 1)
    a = worth(list(hosts.values()), [prior] * len(hosts))
    b = worth(list(paths.values()), [np.mean(hosts[h]) for h, _ in paths])
    out = {}
    for i, h, q, p, e in rows:
        host = (sum(hosts[h]) - p + a * prior) / (len(hosts[h]) - 1 + a)
        path = (sum(paths[h, q]) - p + b * host) / (len(paths[h, q]) - 1 + b)
        shift = site_weight * (math.log(path / (1 - path)) - math.log(prior / (1 - prior)))
        out[i] = (host, path, 1 / (1 + math.exp(-(e + min(max(shift, -most_shift), most_shift)))))
    return out


def test_posteriors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"h{int(rng.integers(9)) ** 2 // 8}", [None, "a", "b"][int(rng.integers(3))], float(rng.beta(3, 1 + i % 4)), float(rng.normal())) for i in range(400)] + [(400, None, None, 0.9, 0.0), (401, "alone", "x", 0.2, 0.0)]
    got = quality.site_posteriors(spark.createDataFrame(rows, "id long, host string, path string, p double, evidence double"), "host", "path", 0.5, 1.0).collect()
    want = brute_posteriors(rows, 0.5, 1.0)
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose((r["host_posterior"], r["path_posterior"], r["score"]), want[r["id"]], atol=1e-9)


def test_sites_shrink_to_the_prior(spark):
    rows = [(i, "big", "p", 1.0 if i % 10 else 0.0) for i in range(2000)] + [(9001, "small", "p", 0.0)]
    df = spark.createDataFrame(rows, "id long, host string, path string, p double").withColumn("evidence", F.lit(0.0))
    out = {r["id"]: r for r in quality.site_posteriors(df, "host", "path", 0.5, 1.0).collect()}
    assert 0.5 < out[9001]["path_posterior"] < out[1]["path_posterior"]
