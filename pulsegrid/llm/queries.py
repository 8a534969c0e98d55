"""Registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import byte_bpe
from pulsegrid.llm.common import read_table
from pulsegrid.llm.conversation_repair import damage_and_repair
from pulsegrid.llm.fingerprints import compare_with_next
from pulsegrid.llm.graph_search import nearest
from pulsegrid.llm.language_id import identify, learn_filters
from pulsegrid.llm.line_dedup import dedup_lines
from pulsegrid.llm.ngram_join import Measure, ngram_join
from pulsegrid.llm.packing import pack_documents
from pulsegrid.llm.ranked_search import search
from pulsegrid.llm.sentencepiece_spans import encode_digests
from pulsegrid.llm.sharding import assign_shards
from pulsegrid.llm.sql import LINE_DEDUP_SQL, NGRAM_JOIN_SQL, RANKED_SEARCH_SQL, REPAIR_SQL, SHARDS_SQL
from pulsegrid.llm.token_files import token_positions, write_token_files
from pulsegrid.llm.url_filter import ALLOW, BLOCK, Rule, judge_urls

SHARDS = 40
WORD_TOKENIZER, PIECE_MODEL, BYTE_RANKS = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
RECORD_END, PACK_END = 2, 0

URL_RULES = [
    Rule("net", "/", BLOCK),
    Rule("example.net", "/en/", ALLOW),
    Rule("example.com", "/de/", BLOCK),
    Rule("org", "/fr/", ALLOW),
]


def vocabulary(name: str) -> str:
    """Where this machine keeps a public tokenizer's file; the same place on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of near equal bytes."""
    placed = assign_shards(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of lines that an earlier one has."""
    cleaned = dedup_lines(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_chunks", "removed_lines", "removed_chunks")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join(read_table(spark, sf_dir, "documents"), Measure(4, 85)).select("doc_id", "n_shingles", "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token records in files, and what the files hold."""
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER), RECORD_END)
    return token_positions(manifest)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return compare_with_next(read_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages."""
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from two thirds of them."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    filters = learn_filters(docs.where(~held_out & F.col("lang").isNotNull()).select("text", "lang"))
    judged = identify(docs.select("doc_id", "text"), filters)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER), PACK_END)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to pieces with spans, and decoded again."""
    return encode_digests(read_table(spark, sf_dir, "documents"), vocabulary(PIECE_MODEL))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose vec_id is divisible by 50, found through the graph over all rows."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for every benchmark item, among all documents."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 10)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by byte ranks, and decoded again."""
    return byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS), with_ids=False, keep=["doc_id"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by rule, and the cheapest repair of each."""
    return damage_and_repair(read_table(spark, sf_dir, "conversations"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shards": op1_shards,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_files": op4_token_files,
    "op5_fingerprints": op5_fingerprints,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_nearest": op10_nearest,
    "op11_ranked_search": op11_ranked_search,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}

LLM_ORACLES: dict[str, str] = {
    "op1_shards": SHARDS_SQL,
    "op2_line_dedup": LINE_DEDUP_SQL,
    "op3_ngram_join": NGRAM_JOIN_SQL,
    "op11_ranked_search": RANKED_SEARCH_SQL,
    "op13_conversation_repair": REPAIR_SQL,
}
