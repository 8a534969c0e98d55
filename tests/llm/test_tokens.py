"""Token files, packing and piece spans against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, frame

from pulsegrid.llm import word_cache
from pulsegrid.llm.packing import Limits, best_fit, pack_documents, pack_pieces, tokenize_pieces
from pulsegrid.llm.queries import LLM_QUERIES, PIECE_MODEL, WORD_TOKENIZER, vocabulary
from pulsegrid.llm.sentencepiece_spans import CharacterMap, Normalizer, SpanEncoder, encode_digests, encode_documents
from pulsegrid.llm.token_files import TokenFile, frame as record, parse, read_token_files, token_positions, write_token_files

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n\nb", "\ta", "don't can't we'll", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "naïve e\u0301 \u0301x", "İstanbul ΣΑΣ",
    "1234,567.89", "漢字 かな", "\U0001f600\U0001f601", "a\u00a0b\u2003c\x1cd\x85e", "▁ ▁x y▁", "!!! ...,,", "\x00\x01", "q" * 5000, "a " * 3000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(WORD_TOKENIZER))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_cache_is_exact(tokenizer):
    texts = ODD + [t for _, t in documents()]
    for limit in (0, 3, 500_000):
        encoder = word_cache.WordEncoder(lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)], limit)
        for _ in range(2):
            ids, starts = encoder.encode(word_cache.split_at_spaces(pa.array([t or "" for t in texts])))
            assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [ids_of(tokenizer, t) for t in texts]


def test_folded_cuts_are_exact(tokenizer):
    """Lower-casing and cutting before stop marks give the whole text's ids; odd letters and marks take the other way."""
    odd = ["Hello, World!! It's THE end...", "J\u030cx X\u0308.", "naïve.É,é;ß:Ÿ!ÀÖ?", "<|ENDOFTEXT|>.A,", "a.b.c'S,'s.'T", "1,2.3;x", "A\u00a0B.\u0085C", "ÿ.×,÷;Ā!", "x.\u0338y"]
    texts = ODD + odd + [f"{t} {t.upper()}" for t in odd]
    path = vocabulary(WORD_TOKENIZER)
    assert word_cache.folds_words(path)
    ids, starts = word_cache.encode_texts(path, pa.array([*texts, None], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [ids_of(tokenizer, t) for t in [*texts, None]]


def test_memory_of_words_is_bounded():
    """Long words are never kept, others up to the limits, and what is kept does not change the ids."""
    encoder = word_cache.WordEncoder(lambda words: [[len(w), ord(w[-1])] for w in words], limit=1000)
    for n in range(20):
        long = [f"{'x' * 70}{n}-{i}" for i in range(10_000)]
        short = [f"w{n}-{i}" for i in range(500)]
        ids, ends = encoder.encode_flat(pa.array(long + short))
        assert ids.reshape(-1, 2).tolist() == [[len(w), ord(w[-1])] for w in long + short] and ends[-1] == 2 * len(long + short)
        assert len(encoder.known) <= 1000 and encoder.used <= 2000 and len(encoder.flat) <= 8192 and not any(len(w) > 32 for w in encoder.known)


def test_records():
    for doc_id, ids in [(5, [1, 2, 70000]), (None, []), (-1, [65535])]:
        data = record(doc_id, np.array(ids, dtype=np.int64))
        back, tokens = parse(data)
        assert back == doc_id and tokens.tolist() == ids
        for place in (0, 9, 13, len(data) - 1):
            bad = bytearray(data)
            bad[place] ^= 1
            with pytest.raises(ValueError):
                parse(bytes(bad))


def test_token_files(spark, tokenizer, tmp_path):
    rows = documents()
    manifest = write_token_files(frame(spark), vocabulary(WORD_TOKENIZER), 2, str(tmp_path / "files"), file_bytes=3000)
    out = sorted(token_positions(manifest).collect(), key=lambda r: r.start)
    expected = [(i, [*ids_of(tokenizer, t), 2]) for i, t in rows]
    assert [r.doc_id for r in out if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(t), zlib.crc32(np.array(t, dtype="<u4").tobytes())) for i, t in expected)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, tuple(r.ids)) for r in read_token_files(manifest).collect()) == Counter((i, tuple(t)) for i, t in expected)
    # Shuffled reads through the index alone.
    first = manifest.orderBy("part", "number").first()
    file, order = TokenFile(first["path"]), list(range(first["records"]))
    random.Random(1).shuffle(order)
    in_order = [file.record(n)[1].tolist() for n in range(len(file))]
    assert [file.record(n)[1].tolist() for n in order] == [in_order[n] for n in order] and manifest.count() > 3


def test_packing(spark, tokenizer):
    rows = documents()
    out = pack_documents(frame(spark), vocabulary(WORD_TOKENIZER), 0, with_ids=True).collect()
    pieces = Counter()
    for i, t in rows:
        ids = [*ids_of(tokenizer, t), 0]
        for k in range(0, len(ids), 2048):
            pieces[(i, k // 2048, k, tuple(ids[k : k + 2048]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in out) == pieces
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(by) <= -(-total // 2048) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_limit_holds(spark, rule):
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 300, 500))[::-1]
    limits = Limits(tokens=512, documents=5, cost=120_000, weights=(1, 1, 1), rule=rule)
    bins, offsets = best_fit(lengths, limits)
    for n in set(bins):
        own = lengths[bins == n]
        assert own.sum() <= 512 and len(own) <= 5 and (own**2).sum() <= 120_000
        assert sorted(offsets[bins == n]) == [0, *np.cumsum(own)[:-1]]
    table = spark.createDataFrame([(int(x),) for x in lengths], "length long")
    assert pack_pieces(table, limits, group_pieces=64).count() == 500


def test_best_fit_is_near_the_bound():
    lengths = np.sort(np.random.default_rng(2).integers(1, 2048, 5000))[::-1]
    bins, _ = best_fit(lengths, Limits())
    big = (lengths > 1024).sum()
    assert len(set(bins)) <= 1.01 * max(big, lengths.sum() / 2048) + 1


def test_pieces_of_empty_table(spark):
    assert pack_documents(frame(spark, []), vocabulary(WORD_TOKENIZER), 0).collect() == []
    assert token_positions(write_token_files(frame(spark, []), vocabulary(WORD_TOKENIZER), 2)).collect() == []
    assert encode_documents(frame(spark, []), vocabulary(PIECE_MODEL)).collect() == []


def test_small_cost_cuts_pieces(spark):
    out = tokenize_pieces(frame(spark), vocabulary(WORD_TOKENIZER), 0, Limits(tokens=64, cost=100)).collect()
    assert max(r.length for r in out) == 10


def test_spans_and_ids(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL))
    rows = documents() + [(500 + n, t) for n, t in enumerate(ODD) if "\x00" not in t]
    out = {(r.doc_id, tuple(r.ids)): r for r in encode_documents(frame(spark, rows), vocabulary(PIECE_MODEL)).collect()}
    for doc_id, text in rows:
        text = text or ""
        proto = library.encode(text, return_type="proto")
        row = out[(doc_id, tuple(p.id for p in proto.pieces))]
        data = text.encode()
        assert [data[b:e] for b, e in zip(row.begins, row.ends, strict=True)] == [_surface(p, data) for p in _with_bytes(proto)]
    digests = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(frame(spark, rows), vocabulary(PIECE_MODEL)).collect())
    expected = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "")
        expected[(doc_id, len(ids), _sha(",".join(map(str, ids))), _sha(library.decode(ids)))] += 1
    assert digests == expected


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _with_bytes(proto):
    """Pieces with the byte range each stands for: byte pieces take one byte of their character each."""
    out, at = [], 0
    for p in proto.pieces:
        size = 1 if p.piece.startswith("<0x") and len(p.piece) == 6 else len(p.surface.encode())
        out.append((at, at + size))
        at += size
    return out


def _surface(span, data):
    return data[span[0] : span[1]]


def test_character_map_against_the_library():
    """A normaliser of the library with a compiled map: same text, same sources."""
    import sentencepiece

    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        model = library.serialized_model_proto()
    except (AttributeError, RuntimeError, TypeError, ValueError) as error:
        pytest.skip(f"no compiled map here: {error}")
    from pulsegrid.llm.sentencepiece_spans import _fields

    own = Normalizer(next(v for k, v in _fields(model) if k == 3))
    assert isinstance(own.map, CharacterMap) and own.map.units
    for text in [t for t in ODD if "\x00" not in t] + ["ｶﾞ ① ﬁ ㍿", "  Ａ  Ｂ  ", "e\u0301 가"]:
        data = text.encode()
        normal, places = own.align(data)
        theirs, offsets = library.normalize(text, with_offsets=True)
        assert normal.decode() == theirs, text
        chars = [len(c.encode()) for c in theirs]
        starts = np.concatenate([[0], np.cumsum(chars)]).astype(int)
        sources = [len(data[: places[s]].decode(errors="ignore")) for s in starts]
        assert sources[:-1] == list(offsets)[: len(theirs)], text


def test_unknown_pieces_have_widths():
    encoder = SpanEncoder(vocabulary(PIECE_MODEL))
    begins, ends = encoder.spans(b"ab cd", np.array(encoder.processor.encode("ab cd")))
    assert begins[0] == 0 and ends[-1] == 5 and (begins[1:] == ends[:-1]).all()


@pytest.mark.parametrize("name", ["op4_token_files", "op8_packing", "op9_sentencepiece"])
def test_query_covers_all(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert LLM_QUERIES[name](spark, SF).select("doc_id").distinct().count() == docs.count()
