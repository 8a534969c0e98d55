import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, frame
from compare import compare, open_tables

from pulsegrid.llm import common
from pulsegrid.llm import ngram_join as module
from pulsegrid.llm.ngram_join import Measure, keep_one, ngram_join
from pulsegrid.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"


def grams(text, n):
    split = (text or "").encode().lower().split()
    return {tuple(split[i : i + n]) for i in range(len(split) - n + 1)} if len(split) >= n else ({tuple(split)} if split else set())


def by_hand(rows, measure):
    sets = [grams(t, measure.words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= measure.percent * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    out = []
    for n, (doc_id, _) in enumerate(rows):
        if not sets[n]:
            out.append((doc_id, 0, doc_id))
            continue
        ids = [rows[m][0] for m in range(len(rows)) if sets[m] and root(m) == root(n) and rows[m][0] is not None]
        out.append((doc_id, len(sets[n]), min(ids, default=None)))
    return out


def found(spark, rows, measure):
    return Counter(map(tuple, ngram_join(frame(spark, rows), measure).select("doc_id", "n_shingles", "component_id").collect()))


def test_query_equals_sql(spark):
    assert compare(spark, open_tables(SF), SF, LLM_QUERIES["op3_ngram_join"], LLM_ORACLES["op3_ngram_join"]) == ""


@pytest.mark.parametrize("measure", [Measure(), Measure(4, 85), Measure(2, 60)])
def test_against_brute_force(spark, measure):
    rng = random.Random(8)
    pool = [f"w{n}" for n in range(300)]
    rows = documents()
    for group in range(6):  # copies of growing distance, so chains and near misses arise
        base = [rng.choice(pool) for _ in range(rng.choice([12, 40, 90, 150]))]
        for copy in range(12):
            edited = [rng.choice(pool) if rng.random() < 0.004 * copy else w for w in base]
            rows.append((1000 + group * 100 + copy, " ".join(edited)))
    assert found(spark, rows, measure) == Counter(by_hand(rows, measure))


def test_second_round_with_small_pieces(spark, monkeypatch):
    """Copies of one base that mostly miss each other, so blocks hold several components, cut into small pieces."""
    rng = random.Random(3)
    pool = [f"w{n}" for n in range(500)]
    base = [rng.choice(pool) for _ in range(120)]
    rows = [(n, " ".join(rng.choice(pool) if rng.random() < 0.025 else w for w in base)) for n in range(60)]
    monkeypatch.setattr(module, "PIECE", 8)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)  # beyond this the shuffled way is taken
    assert found(spark, rows, Measure(4, 85)) == Counter(by_hand(rows, Measure(4, 85)))


def test_second_round_rows_follow_the_members():
    """Copies that may all link with each other: one row for each member, and links as many as join the components."""
    rng, n = random.Random(4), 200
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(rng.choice(base) if rng.random() < 0.01 else w for w in base) for _ in range(n)]
    measure = Measure()
    found, rows = module.ngrams(texts, measure.words)
    sizes = np.bincount(rows, minlength=n)
    ends = np.cumsum(sizes).tolist()
    grams = [found[s:e] for s, e in zip([0, *ends], ends, strict=False)]
    full = module.sketches(found, rows, sizes)
    brief = [module.fold(np.frombuffer(x, dtype=np.uint64), max(1, len(x) // 8 // module.BRIEF)).tobytes() for x in full]
    place = {"key": [7] * n, "head": [-1] * n, "lo": [0] * n, "hi": [0] * n, "node": range(n), "component": range(n)}
    batch = pa.RecordBatch.from_pydict({**place, "n": sizes, "brief": brief, "grams": [g.tobytes() for g in grams]})
    kept = [row for out in module._compare(measure)(iter([batch])) for row in out.to_pylist()]
    assert len(kept) == len({r["node"] for r in kept}) <= n
    links = [(r["a"], r["b"]) for out in module._forest(measure)(iter([batch])) for r in out.to_pylist()]
    groups = {c for _, _, c in by_hand(list(enumerate(texts)), measure)}
    assert len(links) == n - len(groups) > 100
    linked = {frozenset(link) for link in links}
    for a, b in map(tuple, linked):
        common = len(np.intersect1d(grams[a], grams[b]))
        assert 100 * common >= 80 * (sizes[a] + sizes[b] - common)


def test_keep_one(spark):
    rows = documents()
    kept = Counter((r.doc_id, r.text) for r in keep_one(frame(spark)).select("doc_id", "text").collect())
    empty = [(i, t) for i, t in rows if not grams(t, 5)]
    groups = {c for _, n, c in by_hand(rows, Measure()) if n}
    assert sum(kept.values()) == len(empty) + len(groups)
    assert {i for i, _ in kept} >= {g for g in groups}
    assert keep_one(frame(spark)).columns == frame(spark).columns


def test_empty(spark):
    assert ngram_join(frame(spark, [])).collect() == [] and keep_one(frame(spark, [])).collect() == []
