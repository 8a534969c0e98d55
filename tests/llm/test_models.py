"""Fingerprints, language ID, URL verdicts and graph search."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, frame
from pyspark.sql import functions as F

from pulsegrid.llm.fingerprints import as_text, compare_with_next, fingerprint_documents, likeness, phrases, signatures
from pulsegrid.llm.graph_search import GraphSettings, nearest
from pulsegrid.llm.language_id import UNKNOWN, grams, identify, judge, learn_filters
from pulsegrid.llm.queries import LLM_QUERIES, URL_RULES
from pulsegrid.llm.url_filter import ALLOW, BLOCK, judge_urls

SF = "/root/testdata/sf0.001"


def test_equal_substrings_share_interior_names():
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefg hijk") for _ in range(3000))
    for level, edge in ((1, 12), (2, 30), (3, 80)):
        alone = phrases([passage], level)[0].tolist()
        inside = phrases(["shifted by some text " + passage + " and more"], level)[0].tolist()
        start = next(n for n in range(len(inside)) if inside[n : n + 3] == alone[edge : edge + 3])
        middle = alone[edge:-edge]
        assert inside[start : start + len(middle)] == middle


def test_texts_of_a_batch_do_not_touch():
    texts = [t or "" for _, t in documents()]
    together = as_text(signatures(texts))
    assert together == [as_text(signatures([t]))[0] for t in texts]
    assert as_text(signatures([""]))[0] == "ffff" * 64 and len(set(together[-6:-3])) > 1
    assert likeness(signatures(["", "", "a"]), signatures(["", "a", "a"])).tolist() == [1.0, 0.0, 1.0]
    assert len(phrases(["x" * 100_000], 3)[0]) == 1


def test_long_strangers_do_not_look_alike():
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 4_000_000).tolist())) for _ in range(2)]
    prints = signatures(texts)
    assert likeness(prints[:1], prints[1:])[0] <= 1 / 64 and (prints != 0xFFFF).all()


def test_compare_with_next(spark):
    rows = [(n, t) for n, t in documents() if n is not None]
    rows = list(dict(rows).items()) + [(None, "no id")]
    expected = {}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc_id, text), (_, other) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, other = text or "", other or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + other[:quarter]
        a, b, c = signatures([text, edited, other])
        expected[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *as_text(np.stack([a, b])), float(likeness(a[None], b[None])[0]), float(likeness(a[None], c[None])[0]))
    out = {r.doc_id: tuple(r)[1:] for r in compare_with_next(frame(spark, rows)).collect()}
    assert out == expected
    prints = {r.doc_id: r.fingerprint for r in fingerprint_documents(frame(spark, rows)).collect()}
    assert prints == {k: v[2] for k, v in expected.items()}


@pytest.mark.parametrize("rows", [[], [(7, "a single document follows itself")], [(7, None)], [(None, "x" * 50), (None, "y" * 50)], [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "other text")]])
def test_compare_with_next_few_rows(spark, rows):
    assert compare_with_next(frame(spark, rows)).count() == len(rows)


def test_likeness_tells_edits_from_strangers(spark):
    out = LLM_QUERIES["op5_fingerprints"](spark, SF).where("n_chars > 200").collect()
    assert np.mean([r.near_edited for r in out]) > 0.5 and np.mean([r.near_next for r in out]) < 0.1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_language_on_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = LLM_QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(langs) and len(held) > 250 and all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.99


def test_language_awkward(spark):
    train = spark.createDataFrame([("hello there my friend", "en"), ("hallo mein freund", "de"), (None, "en"), ("x", None), ("", "fr")], "text string, lang string")
    filters = learn_filters(train)
    assert filters.languages == ["en", "de"]
    texts = ["hello friend", "mein freund", "", "123 !!!", "ж", "My FRIEND"]
    names, score, known = judge(filters, texts)
    assert names == ["en", "de", UNKNOWN, UNKNOWN, "en", "en"] and score[2] == score[3] == score[4] == 0 and known[0] > 0.9
    out = identify(frame(spark), filters)
    assert out.count() == len(documents()) and {r.lang_pred for r in out.where("text is null").collect()} == {UNKNOWN}
    nothing = learn_filters(train.limit(0))
    assert nothing.languages == [] and {r.lang_pred for r in identify(frame(spark), nothing).collect()} == {UNKNOWN}
    assert identify(frame(spark, []), filters).collect() == []


def test_rare_labels_take_no_grams(spark):
    """Twenty labels of a few English texts each, as wrong or rare labels are, leave English right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows = [(r.text, r.lang) for r in docs.where("doc_id % 3 != 1").orderBy("doc_id").collect()]
    held = [(r.text, r.lang) for r in docs.where("doc_id % 3 = 1").collect()]
    english = [text for text, lang in rows if lang == "en"]
    rare = [(text[:340], f"r{n % 20:02d}") for n, text in enumerate(english[:100])]
    filters = learn_filters(spark.createDataFrame(rows + rare, "text string, lang string"))
    names, _, _ = judge(filters, [text for text, _ in held])
    assert len(filters.languages) == 24 and np.mean([name == lang for name, (_, lang) in zip(names, held, strict=True)]) >= 0.99


def test_filters_hold_every_language_with_a_gram(spark):
    """Two languages that share a word, one using it five times as often: both filters have its grams."""
    rows = [("shared " + "alpha beta gamma " * 5, "a")] * 20 + [("shared " * 5 + "uno due tre " * 3, "b")] * 20
    filters = learn_filters(spark.createDataFrame(rows, "text string, lang string"))
    found, _, _ = grams(["shared"])
    assert (filters.masks(found)[:, 0] == 3).all()


def test_language_bits_over_one_byte(spark):
    rows = [(f"{chr(97 + n) * 3} {chr(97 + n) * 5}", f"l{n:02d}") for n in range(20)]
    filters = learn_filters(spark.createDataFrame(rows, "text string, lang string"))
    names, _, _ = judge(filters, [t for t, _ in rows])
    assert names == [lang for _, lang in rows] and filters.slots.shape[1] == 3


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:end]


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.NET/EN/x", "https://a.example.net/en/x?u=/de/", "http://net/x", "http://xnet/", "http://b.net", "http://b.net?x/", "ftp://q.example.com/de/#f", "http://É.org/fr/1", "a://b://c.net/x", "http://example.com/de", "http://line\nbreak.net/x\ny"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    rows = [(r.page_id, r.url) for r in pages.collect()] + [(10_000 + n, u) for n, u in enumerate(urls)] + [(None, "http://x.net/"), (3, "http://x.org/fr/")]
    table = spark.createDataFrame([(i, u, "h", "r", 1.0) for i, u in rows], "page_id long, url string, host string, rule string, label double")
    out = Counter((r.page_id, r.host, r.path, r.rule) for r in judge_urls(table, URL_RULES).collect())
    expected = Counter()
    for i, u in rows:
        host, path = parts(u)
        rule = ruled(host, path)
        expected[(i, host, path, rule.host + rule.path if rule else None)] += 1
    assert out == expected
    for r in judge_urls(table, URL_RULES).collect():
        rule = ruled(r.host, r.path)
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in (ALLOW, BLOCK)


def test_url_trees_on_held_out_labels(spark):
    """With a third of the labelled URLs hidden from the rules, the trees give the rules' verdicts."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    from pulsegrid.llm import url_filter as module

    host, path = module.host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    verdict = module.matching_rule(F.col("host"), F.col("path"), URL_RULES, lambda r: r.verdict)
    urls = urls.withColumn("truth", verdict).where("truth is not null").withColumn("hidden", F.crc32(F.col("url").cast("binary")) % 3 == 0)
    rows = urls.withColumn("label", F.when(~F.col("hidden"), (F.col("truth") == BLOCK).cast("double")))
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=[*module.LEXICAL, *module.STATISTICS], outputCol="features").transform(module.with_statistics(module.with_features(rows)))
    model = module.fit_trees(made)
    judged = model.transform(made.where("hidden")).select("truth", "prediction").collect()
    right = np.mean([(r.prediction == 1.0) == (r.truth == BLOCK) for r in judged])
    assert len(judged) > 300 and right >= 0.97


def test_own_labels_are_not_in_the_rates(spark):
    """Rows of one URL have one rate, whatever their own labels; unlabelled rows have the rate of all labels."""
    from pulsegrid.llm import url_filter as module

    rows = [(f"http://h{n % 40}.example.net/a{n % 7}/", 1.0 if n % 4 == 0 else 0.0 if n % 4 < 3 else None) for n in range(400)]
    table = spark.createDataFrame([(u, *parts(u), label) for u, label in rows], "url string, host string, path string, label double")
    made = module.with_statistics(module.with_features(table)).select("url", "label", F.pmod(F.xxhash64("url"), F.lit(module.FOLDS)).alias("fold"), "suffix2").collect()
    labels = [(r.fold, r.label) for r in made if r.label is not None]
    for r in made:
        used = [label for fold, label in labels if r.label is None or fold != r.fold]
        assert abs(r.suffix2 - (sum(used) + module.SMOOTHING * module.PRIOR) / (len(used) + module.SMOOTHING)) < 1e-12
    assert len({r.fold for r in made}) == module.FOLDS


def test_few_urls_with_many_copies(spark):
    rows = [(n, ("http://a.net/x", "http://a.example.net/en/x", "http://free.com/")[n % 3]) for n in range(3000)]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES, max_rows=100).groupBy("host", "verdict").count().collect()
    assert len(out) == 3 and {r["count"] for r in out} == {1000}


def test_scores_of_extreme_vectors(spark):
    vectors = {0: [1e200, 2e200], 1: [1e-200, 1e-200], 2: [2.0, 4.0], 3: [-3e-300, 1e-300], 4: [5e307, 1.7e308], 5: [1e200, -1e200]}
    out = nearest(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    unit = {i: np.array(v) / np.abs(v).max() for i, v in vectors.items()}
    truth = sorted(((-(unit[0] @ v) / np.sqrt((unit[0] @ unit[0]) * (v @ v)), i) for i, v in unit.items() if i))
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"])] == [i for _, i in truth]
    assert all(abs(r.score + s) < 1e-12 for r, (s, _) in zip(sorted(out, key=lambda r: r["rank"]), truth, strict=True))


@pytest.mark.parametrize("urls", [[], ["http://a.net/x"], ["http://b.com/x", None], ["http://a.net/x", "http://b.org/fr/", "http://c.com/"]])
def test_urls_with_little_to_learn(spark, urls):
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert judge_urls(table, URL_RULES).count() == len(urls)


def exact(vectors, queries, k):
    out = {}
    for q in queries:
        a = vectors[q]
        scored = sorted(((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i) for i, b in vectors.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in table.collect()}
    out = {}
    for r in nearest(table, F.col("vec_id") % 50 == 0).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    truth = exact(vectors, out, 5)
    hits = sum(len({v for _, v, _ in out[q]} & {v for v, _ in truth[q]}) for q in out)
    assert len(out) == 10 and hits >= 0.95 * 50
    for q, rows in out.items():
        assert [n for n, _, _ in sorted(rows)] == [1, 2, 3, 4, 5]
        known = dict(exact({q: vectors[q], **{v: vectors[v] for _, v, _ in rows}}, [q], 5)[q])
        assert all(abs(known[v] - s) < 1e-12 for _, v, s in rows)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(n, [float(x) for x in rng.standard_normal(6)]) for n in range(60)]
    same = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    rows += [(100 + n, same) for n in range(40)]  # one common vector
    bad = [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, [1.0, 2.0]), (None, same)]
    again = [(5, rows[5][1]), (100, same)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad + again], "vec_id long, embedding array<float>, node int, v int")
    out = {}
    for r in nearest(table, F.col("vec_id") % 50 == 0, settings=GraphSettings(rounds=4)).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    truth = exact(vectors, [0, 50, 100], 5)
    assert {q: [v for v, _ in t] for q, t in truth.items()} == out and out[100] == [101, 102, 103, 104, 105]


@pytest.mark.parametrize("count", [0, 1, 3])
def test_few_vectors(spark, count):
    table = spark.createDataFrame([(50 * n, [1.0, float(n)]) for n in range(count)], "vec_id long, embedding array<float>")
    out = nearest(table, F.col("vec_id") % 50 == 0).collect()
    assert len(out) == count * (count - 1)
