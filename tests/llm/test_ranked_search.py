"""Ranked search against scores computed document by document in plain Python."""

import math
import random
import re
from collections import Counter

from cases import SF, documents, frame

from pulsegrid.llm import ranked_search as R
from pulsegrid.llm.queries import LLM_QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, doc_id long, uid long, q long, score long"


def terms(text):
    return WORD.findall((text or "").translate(FOLD))


def plain(docs, items, k):
    """item, rank, score and the id of every answer."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, length = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            score = 0
            for word in terms(text):
                if c[word]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[word] + 1)))
                    m = 100 - 75 + (75 * c.total() * n_docs) // length
                    score += w * ((1_000_000_000 * c[word]) // (1000 * c[word] + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        scores.sort(key=lambda s: s[:3])
        out += [(str(item), rank, str(s[3]), -s[0]) for rank, s in enumerate(scores[:k], 1)]
    return sorted(out)


def answers(found):
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in found.collect())


def corpus():
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(60)] + ["É", "é", "x_y", "a-b", "Ⅷ", "中文"]
    docs = documents() + [(100 + i, " ".join(rng.choices(pool, weights=[1 / (j + 1) for j in range(len(pool))], k=rng.randint(1, 60)))) for i in range(150)]
    docs += [(400 + i, "w1 w2 w3 copies of one text") for i in range(40)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 25)))) for i in range(20)]
    items += [(50, None), (51, ""), (52, " ... "), (53, "nowhereword"), (54, "w1 w2 w3 W1 w1"), (55, "copies of one text"), (56, docs[0][1]), (None, "w5 w6"), (57, "w0")]
    return docs, items


def items_frame(spark, items):
    return spark.createDataFrame([(*row, 1, 2, 3, 4) for row in items], ITEMS).repartition(3)


def test_scores(spark, monkeypatch):
    docs, items = corpus()
    want = plain(docs, items, 10)
    assert answers(R.search(frame(spark, docs), items_frame(spark, items))) == want
    monkeypatch.setattr(R, "QUERY_BYTES", 1500)  # several blocks
    monkeypatch.setattr(R, "READ_SHARES", (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8))
    assert answers(R.search(frame(spark, docs), items_frame(spark, items), 3)) == plain(docs, items, 3)


def test_reading_stops_early(spark, monkeypatch):
    """Queries whose answers hold all their words are settled before the last bands, which are not read for them."""
    docs = [(i, f"rare{i % 4} filler{i} other") for i in range(60)] + [(100 + i, "alpha beta") for i in range(12)]
    read = []
    staged = R.stage
    monkeypatch.setattr(R, "stage", lambda df, name: read.append(name) or staged(df, name))
    assert answers(R.search(frame(spark, docs), items_frame(spark, [(1, "alpha beta")]), 3)) == plain(docs, [(1, "alpha beta")], 3)
    assert read.count("intervals") < len(R.READ_SHARES) + 1


def test_repeated_rows_and_no_rows(spark):
    docs = [(7, "one two"), (7, "one two"), (7, "two"), (None, "one"), (8, None)]
    items = [(1, "one two"), (1, "two"), (2, "one")]
    found = answers(R.search(frame(spark, docs), items_frame(spark, items)))
    assert found == plain(docs, items, 10)
    none = frame(spark, docs).where("doc_id = 9")
    assert R.search(none, items_frame(spark, items)).collect() == []
    assert R.search(frame(spark, docs), items_frame(spark, items).where("item_id = 9")).collect() == []


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert answers(LLM_QUERIES["op11_ranked_search"](spark, SF)) == plain(docs, items, 10)
