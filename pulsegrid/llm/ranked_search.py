"""Ranked lexical search without random access: impact-sorted postings are read in order, and scores lie in intervals.

One pass over the texts leaves, for each document, its length and how often it has each word of the queries. From them
come the collection's statistics and the posting lists of the queries' words: (word, document, impact), the impact
being what one occurrence of the word in a query adds to the score. The lists are stored in bands of falling impact and
read band by band. After each band, with every impact still unread at most f, and q the number of times a query has a
word, a document's score lies between what was read of it and that plus the sum of q * min(f, largest impact of the word)
over the words not yet seen in it. A word that was seen in a document has a largest impact above f, so the sum needs no
list of seen words: it is the query's whole sum less f times the occurrences seen.

A document leaves when its upper bound falls below the k-th lower bound of its query; new documents stop entering when
the bound of an unseen one does. A query ends when only documents with closed intervals are left, so members, ties and
scores are final; until then its lists are read on. Documents that are still open pass from band to band as a stored
table, joined by query and document; nothing is collected for a query, and all copies of a text are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import new_shared_path, slices, small_or_not, stage

# Words are what lies between these ASCII characters; of letters, only A to Z are folded.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Shares of the postings that have been read after each band but the last.
READ_SHARES = (0.05, 0.25, 0.6, 0.85)
QUERY_BYTES = 32 * 1024 * 1024  # texts of queries that are answered in one pass over the documents

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Weights:
    """Scores in whole numbers: word weight ``floor(scale * ln((2N + 2) / (2df + 1)))`` times a saturated frequency.

    The frequency part is ``(unit * tf) div (1000 * tf + saturation * m)`` with ``m = 100 - slope + (slope * n * N) div L``.
    """

    scale: int = 1000
    unit: int = 1_000_000_000
    saturation: int = 8
    slope: int = 75

    def word(self, documents: int, holding: Column) -> Column:
        return F.floor(self.scale * F.log((2 * F.lit(documents) + 2) / (2 * holding + 1)))

    def impact(self, documents: int, length: int) -> Column:
        """What one occurrence in a query of a word of weight ``w`` adds to a document of ``n`` words that has it ``tf`` times."""
        m = f"({100 - self.slope} + ({self.slope} * n * {documents}L) div {length}L)"
        return F.expr(f"w * ((({self.unit}L * tf) div (1000 * tf + {self.saturation} * {m})))")


def words_of(texts: pa.Array) -> pa.ListArray:
    """Folded words of each text (null: none); empty strings stand between neighbouring breaks."""
    plain = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    folded = pa.Array.from_buffers(pa.large_string(), len(plain), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_FOLD[data])])
    return pc.split_pattern(folded, " ")


def word_counts(docs: DataFrame, words: list[str], id_col: str, text_col: str) -> DataFrame:
    """Stored rows uid, doc_id, n, word, tf: the words of each text, and how often it has each of ``words`` (by place).

    Whole texts are counted where they lie; only counts leave the task.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(words, pa.large_string())
        for batch in slices(batches, "text"):
            lists = words_of(batch.column("text"))
            flat, bounds = lists.flatten(), lists.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            coded = flat.dictionary_encode()
            codes = coded.indices.to_numpy()
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=wanted), -1).to_numpy().astype(np.int64)[codes]
            filled = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes]
            n = np.bincount(row[filled], minlength=batch.num_rows)
            hit = place >= 0
            pairs, tf = np.unique(row[hit] * len(words) + place[hit], return_counts=True)
            at, word = (pairs // len(words), pairs % len(words)) if len(words) else (pairs, pairs)
            ends = np.searchsorted(at, np.arange(batch.num_rows + 1))
            lists_of = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((word, pa.int32()), (tf, pa.int64()))]
            columns = [batch.column("uid"), batch.column("doc_id"), pa.array(n, pa.int64()), *lists_of]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n", "word", "tf"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(count, f"uid long, doc_id {kind}, n long, word array<int>, tf array<long>"), "counts")


def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _query_words(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """qid (one for each row), item_id, text, q: the words of the queries and how often each has them."""
    rows = queries.select(F.monotonically_increasing_id().alias("qid"), F.col(id_col).alias("item_id"), _folded(F.coalesce(text_col, F.lit(""))).alias("text"))
    split = rows.select("qid", "item_id", F.explode(F.split("text", BREAKS)).alias("text")).where("text != ''")
    return stage(split.groupBy("qid", "item_id", "text").agg(F.count("*").alias("q")), "queries")


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    weights: Weights = Weights(),
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    query_text: str = "text",
) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each query: item_id, rank, doc_id, score.

    Every row is a document or a query of its own, also where ids repeat or are null. Equal scores are ordered by ascending
    id (nulls first), rows of one id and score in any order. Null, empty and wordless texts match nothing but count as
    the statistics say: N has only documents with a word. A query without words, or an empty table on either side,
    gives no rows. Other columns are not read. Queries are answered in blocks of about ``QUERY_BYTES`` of text.
    """
    words = _query_words(queries, item_id, query_text)
    size = words.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    found = [_search_block(docs, words.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b), k, weights, doc_id, text) for b in range(blocks)]
    if not found:
        return words.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast(docs.schema[doc_id].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    answer = found[0]
    for more in found[1:]:
        answer = answer.unionByName(more)
    return answer


def _search_block(docs: DataFrame, asked: DataFrame, k: int, weights: Weights, doc_id: str, text: str) -> DataFrame:
    vocabulary = sorted(r[0] for r in asked.select("text").distinct().collect())  # at most QUERY_BYTES of words
    places = pa.table({"text": pa.array(vocabulary, pa.string()), "word": pa.array(range(len(vocabulary)), pa.int32())})
    asked = asked.join(F.broadcast(docs.sparkSession.createDataFrame(places)), "text").select("qid", "item_id", "word", "q")
    counts = word_counts(docs, vocabulary, doc_id, text)
    total = counts.where("n > 0").agg(F.count("*"), F.sum("n")).head()
    single = counts.select("uid", "n", F.explode(F.arrays_zip("word", "tf")).alias("c")).select("uid", "n", "c.word", "c.tf")
    holding = single.groupBy("word").agg(F.count("*").alias("df"))
    weighed = F.broadcast(stage(holding.select("word", weights.word(total[0] or 0, F.col("df")).alias("w")), "weights"))
    postings = single.join(weighed, "word").select("word", "uid", weights.impact(total[0] or 0, total[1] or 1).alias("impact")).where("impact > 0")
    edges = postings.agg(F.percentile_approx("impact", [1 - share for share in READ_SHARES], 1000)).head()[0] or []
    edges = sorted({int(edge) for edge in edges}, reverse=True)
    band = sum((F.when(F.col("impact") <= edge, 1).otherwise(0) for edge in edges), F.lit(0))
    path = new_shared_path(docs.sparkSession, "postings")
    sorted_lists = postings.withColumn("band", band.cast("int")).sortWithinPartitions("band", F.desc("impact"))
    sorted_lists.write.partitionBy("band").parquet(path)
    lists = docs.sparkSession.read.schema("word int, uid long, impact long, band int").parquet(path)
    tops = lists.groupBy("word").agg(F.max("impact").alias("top"))
    asked = stage(asked.join(tops, "word"), "asked")  # words that no document has can add nothing
    return _read_bands(lists, [*edges, 0], asked, counts.select("uid", "doc_id"), k)


def _read_bands(lists: DataFrame, edges: list[int], asked: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The answers of one block; ``edges[b]`` is the largest impact that may be unread after band b.

    What is kept by word or query is as bounded as the block (``QUERY_BYTES``) and broadcast; documents are not.
    """
    state = status = None
    finals = []
    for number, edge in enumerate(edges):
        band = lists.where(F.col("band") == number).select("word", "uid", "impact")
        part = ["qid", "uid", (F.col("q") * F.col("impact")).alias("low"), F.col("q").alias("seen")]
        if state is None:
            fresh = band.join(F.broadcast(asked.select("qid", "word", "q")), "word").select(*part)
            merged = fresh
        else:
            entering = asked.join(F.broadcast(status.where("entering").select("qid")), "qid", "left_semi").select("qid", "word", "q")
            settled = status.where("NOT entering AND unread").select("qid")
            fresh = band.join(F.broadcast(entering), "word").select(*part)
            held = small_or_not(state.join(F.broadcast(settled), "qid", "left_semi").select("qid", "uid"))
            more = band.join(held, "uid").join(F.broadcast(asked.select("qid", "word", "q")), ["qid", "word"]).select(*part)
            merged = state.unionByName(fresh).unionByName(more)
        state = stage(merged.groupBy("qid", "uid").agg(F.sum("low").alias("low"), F.sum("seen").alias("seen")), "intervals")
        best = Window.partitionBy("qid").orderBy(F.desc("low"))
        least = state.select("qid", "low", F.row_number().over(best).alias("place")).where(F.col("place") <= k)
        least = least.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("low")).otherwise(0).alias("least"))
        room = asked.groupBy("qid").agg(F.sum(F.col("q") * F.least(F.col("top"), F.lit(edge))).cast("long").alias("room"))
        bounds = F.broadcast(stage(room.join(least, "qid", "left").select("qid", "room", F.coalesce("least", F.lit(0)).alias("least")), "bounds"))
        open_by = F.col("room") - edge * F.col("seen")
        state = state.join(bounds, "qid").where(F.col("low") + open_by >= F.col("least")).withColumn("gap", open_by)
        gaps = state.groupBy("qid").agg(F.max("gap").alias("gap"))
        entering = (F.col("room") >= F.col("least")) & (F.col("room") > 0)
        status = stage(bounds.join(gaps, "qid", "left").select("qid", entering.alias("entering"), (F.coalesce("gap", F.lit(0)) > 0).alias("unread")), "status")
        done = F.broadcast(status.where("NOT entering AND NOT unread").select("qid"))
        state = state.select("qid", "uid", "low", "seen")
        finals.append(state.join(done, "qid", "left_semi"))
        left = status.where("entering OR unread")
        if left.isEmpty():
            break
        state = state.join(F.broadcast(left.select("qid")), "qid", "left_semi")
    return _ranked(finals, asked, ids, k)


def _ranked(finals: list[DataFrame], asked: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    scored = finals[0]
    for more in finals[1:]:
        scored = scored.unionByName(more)
    scored = small_or_not(stage(scored.select("qid", "uid", F.col("low").alias("score")), "scores"))
    place = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("uid"))
    ranked = scored.join(ids, "uid").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    items = F.broadcast(asked.select("qid", "item_id").distinct())
    return ranked.join(items, "qid").select("item_id", "rank", "doc_id", "score")
