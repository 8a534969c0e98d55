import zlib
from collections import Counter

from cases import documents, frame
from compare import compare, open_tables

from pulsegrid.llm.queries import LLM_ORACLES, LLM_QUERIES
from pulsegrid.llm.sharding import assign_shards, write_shards

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert compare(spark, open_tables(SF), SF, LLM_QUERIES["op1_shards"], LLM_ORACLES["op1_shards"]) == ""


def test_law_and_awkward_rows(spark):
    rows = documents()
    out = assign_shards(frame(spark), 7).collect()
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == expected
    ordered = sorted(out, key=lambda r: r.byte_start)
    total, at = sum(r.size for r in out), 0
    for r in ordered:
        assert r.byte_start == at and r.shard == (2 * at + r.size) * 7 // (2 * total)
        at += r.size
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    # An even number of equal rows is dealt evenly although one key holds them all.
    same = assign_shards(frame(spark, [(1, "x" * 84)] * 400), 4)
    assert Counter(r.shard for r in same.collect()) == {n: 100 for n in range(4)}


def test_empty(spark):
    assert assign_shards(frame(spark, []), 4).collect() == []


def test_written_shards(spark, tmp_path):
    rows = [(n, "y" * (n % 50)) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assigned = {r.doc_id: r.shard for r in write_shards(docs, str(tmp_path / "out"), 5).collect()}
    written = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id: r.shard for r in written} == assigned and len(written) == 300
