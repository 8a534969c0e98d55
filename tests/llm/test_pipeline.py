"""Each stage of the pipeline against a brute-force version on its own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
from cases import documents, frame
from test_line_dedup import by_hand as lines_by_hand
from test_ngram_join import by_hand as groups_by_hand
from test_ngram_join import grams

from pulsegrid.llm.common import stage
from pulsegrid.llm.language_id import judge, learn_filters

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark):
    docs = stage(frame(spark), "documents")
    filters = learn_filters(docs)
    first = stage(corpus_pipeline.language_id(spark, docs, ""), "one")
    assert first.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    names, _, known = judge(filters, [t or "" for _, t in rows])
    assert pairs(first) == Counter(r for r, n, k in zip(rows, names, known, strict=True) if n != "und" and k >= 0.2)

    second = stage(corpus_pipeline.line_dedup(spark, first, ""), "two")
    assert second.columns == docs.columns
    cleaned = lines_by_hand([(r.doc_id, r.text) for r in first.collect()])
    assert pairs(second) == Counter((i, t) for i, t in cleaned if t != "")

    third = stage(corpus_pipeline.near_duplicates(spark, second, ""), "three")
    assert third.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in second.collect()]
    groups = {c for _, n, c in groups_by_hand(rows, corpus_pipeline.NEAR) if n}
    assert set(pairs(third)) <= set(rows) and third.count() == len(groups) + sum(not grams(t, 5) for _, t in rows)
    kept = {i for i, t in pairs(third) if grams(t, 5)}
    assert kept == groups  # of each group the row with its least id

    last = corpus_pipeline.packing(spark, third, "").collect()
    assert {r.doc_id for r in last} == {i for i, _ in pairs(third)}


def test_run_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "packing"]
    assert corpus_pipeline.language_id(spark, docs, sf).count() == docs.count()
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.select("doc_id").distinct().count() > 0.8 * docs.count()


def test_runs_stand_side_by_side(spark):
    """Each run owns its result, and the session's settings stay as they were."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    two = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces(one) == pieces(two) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def pieces(df):
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())


def test_packing_binds_documents(spark):
    docs = stage(spark.createDataFrame([(n, "tiny", "en", "s", 4) for n in range(300)], "doc_id long, text string, lang string, source string, n_chars long"), "tiny")
    out = corpus_pipeline.packing(spark, docs, "").collect()
    assert len(out) == 300 and max(Counter(r.sequence_id for r in out).values()) == 64


def test_large_alphabet_stays(spark):
    """A language with thousands of letters and over 100,000 grams is kept as one with few; noise goes."""
    rng = np.random.default_rng(4)
    share = 1 / np.arange(1, 5001)
    letters = rng.choice(5000, size=(400, 600), p=share / share.sum()) + 0x4E00
    rows = [(n, "".join(map(chr, row)), "zh") for n, row in enumerate(letters)]
    rows += [(1000 + n, "the quick brown fox jumps over the lazy dog " * 3, "en") for n in range(20)]
    rows += [(2000, "".join(map(chr, range(0xAC00, 0xAC00 + 600))), None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    filters = learn_filters(docs)
    assert filters.usual.min() > 0.9
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {i for i, _, _ in rows} - {2000}
    names, _, known = judge(filters, [rows[0][1], "the lazy fox"])
    assert names == ["zh", "en"] and known[0] > 0.9


def test_rare_grams_are_judged_by_their_language(spark):
    """Where most 3-grams of a language's own texts are too rare to be known, its clean texts stay."""
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in range(0x1200, 0x1340) if chr(c).isalpha()]  # some hundred letters, not a large script
    share = 1 / np.arange(1, len(letters) + 1) ** 0.8
    rows = [(n, "".join(rng.choice(letters, size=800, p=share / share.sum())), "am") for n in range(400)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert learn_filters(docs).usual[0] < 0.2 and corpus_pipeline.language_id(spark, docs, "").count() == len(rows)


def test_empty(spark):
    docs = stage(frame(spark, []), "empty")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, "").collect() == []


def test_no_languages(spark):
    docs = spark.createDataFrame([(n, t, None, None, None) for n, t in documents()], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_id(spark, docs, "").count() == sum(t is not None for _, t in documents())
