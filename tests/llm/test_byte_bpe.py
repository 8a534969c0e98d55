"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import SF, documents, frame

from pulsegrid.llm import byte_bpe as B
from pulsegrid.llm.queries import BYTE_RANKS, LLM_QUERIES, vocabulary

ODD = [
    "", " ", "  ", "a", "'s", "'sabc", "a's", "''s", " 's", "\n's", "don't we'll've", "'r", "'re", "'ve've", "'l", "!!'s", "x  y", "x \n y", "x\n\ny", " \t", "12 34  56", "'s's's", " '", "'",
    "é'été 漢字 \U0001f600'm", "\x00\x01\x1c\x85", "<|endoftext|>", "'", "l", "'", "re", " ", "́a ٣ b", "՘\U000107bb",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    assert B.PATTERN == public_tokenizers.PATTERN
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=B.load_ranks(vocabulary(BYTE_RANKS)).rank, special_tokens={})


def check(library, texts):
    path = vocabulary(BYTE_RANKS)
    ids, starts = B.encode_texts(path, pa.array(texts, pa.string()))
    for n, text in enumerate(texts):
        own = ids[starts[n] : starts[n + 1]]
        assert own.tolist() == library.encode_ordinary(text), text[:99]
        assert B.load_ranks(path).decode(own)[0].tobytes() == text.encode()


def test_odd_texts(library):
    check(library, ODD)
    check(library, [t or "" for _, t in documents()])
    rng = random.Random(1)
    letters = [*"  '\n\tstmdrevl.!,1٣é漢́AB", "\U0001f600", "\x1c", "\x85"]
    for _ in range(100):
        check(library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(30)])


def test_long_matches(library):
    rng = random.Random(2)
    check(library, ["a" * 30_000, "ab" * 20_000, " " * 3000 + "x", "".join(rng.choice("abcdeth") for _ in range(50_000)), "!" * 999 + "'s", "éa" * 500])


def test_ties_and_sizes():
    """Every short word over two letters, merged side by side and alone, against merging by plain search."""
    ranks = B.load_ranks(vocabulary(BYTE_RANKS))

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = [(ranks.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks.rank]
            if not found:
                return [ranks.rank[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(5)
    words = ["".join(rng.choice("aels ") for _ in range(rng.randint(2, 64))).encode() for _ in range(400)]
    for depth in range(1, 7):
        own = [w for w in words if (len(w) - 1).bit_length() == depth]
        assert B.merge_together(ranks, own, depth) == [plain(w) for w in own]
        assert [B.merge_alone(ranks, w) for w in own] == [plain(w) for w in own]


def test_documents(spark, library):
    rows = documents()
    got = B.encode_documents(frame(spark), vocabulary(BYTE_RANKS), prefix="bpe_")
    assert {"text", "shard", "piece"} <= set(got.columns)
    found = sorted((str(r.doc_id), r.text or "", r.bpe_ids, r.bpe_n_tokens, r.bpe_ids_sha256, r.bpe_decoded_sha256) for r in got.collect())
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((str(doc_id), text or "", ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want)
    assert {bytes(r.decoded).decode() for r in B.decode_ids(got.select(got.bpe_ids.alias("ids")), vocabulary(BYTE_RANKS)).collect()} == {t or "" for _, t in rows}
    assert B.encode_documents(frame(spark).where("doc_id < -1"), vocabulary(BYTE_RANKS)).collect() == []


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in LLM_QUERIES["op12_byte_bpe"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode_ordinary(text)
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
