"""Exact Jaccard join of word n-gram sets by parity sketches.

Every n-gram toggles one bit of a sketch, so the Hamming distance of two sketches never exceeds the number of n-grams
that only one of the two sets has. Sets of similar sizes (a band) may differ in at most d n-grams; of more than d blocks
of a wide sketch some must then be equal, so documents that could link meet in a block (kept as the XOR of the
hashes of its set bits). Candidates are pruned by the Hamming distance of a compact sketch and verified by the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop_staged, mix64, slices, small_or_not, stage, staged_into
from pulsegrid.llm.components import components

GROWTH = 1.3  # sizes of a band's own documents span this factor
BLOCKS = 1.16  # blocks for each n-gram that may differ, so that most blocks that hold one n-gram or none can be left out
BITS = 4  # bits of the compact sketch for each n-gram, at least
BRIEF = 4  # how many times smaller the sketch is that members of a block carry
PIECE = 1024  # members of a block that are compared in one go
PIECE_GRAMS = 1 << 20  # n-grams of the members whose sets are compared in one go
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass(frozen=True)
class Measure:
    """Sets of ``words``-word n-grams are linked from a Jaccard similarity of ``percent`` / 100 on."""

    words: int = 5
    percent: int = 80

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def may_differ(self, a, b):
        """Most n-grams that only one of two linked sets of these sizes has."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)


@lru_cache(maxsize=8)
def bands(measure: Measure, up_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower size, upper size of partners, blocks and difference of each band, up to the band of a size."""
    low, rows = 1, []
    while low <= up_to:
        following = max(low + 1, int(low * GROWTH))
        top = measure.largest_partner(following - 1)
        differ = measure.may_differ(following - 1, top)
        rows.append((low, top, int(BLOCKS * (differ + 1)) + 1 if differ else 0, differ))
        low = following
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def ngrams(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, ascending within a text, and the row of each.

    Words are runs of bytes other than ASCII white space, with A-Z lowered. A text with fewer words is one n-gram.
    """
    split = [t.encode().lower().split() if t else [] for t in texts]
    counts = np.array([len(s) for s in split], dtype=np.int64)
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), dtype=np.uint64, count=int(counts.sum()))
    rows = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        if len(flat) >= words:
            inside = rows[: len(rows) - words + 1] == rows[words - 1 :]
            total = np.zeros(len(inside), dtype=np.uint64)
            for k in range(words):
                total = mix64(total + flat[k : len(flat) - words + 1 + k] * _ODD[k % len(_ODD)])
            grams, owners = total[inside], rows[: len(inside)][inside]
        else:
            grams, owners = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        short = np.flatnonzero((counts > 0) & (counts < words))
        if len(short):
            starts = np.cumsum(counts) - counts
            whole = []
            for n in short:
                value = np.uint64(counts[n])
                for w in flat[starts[n] : starts[n] + counts[n]]:
                    value = mix64(np.array([value * _ODD[4] + w]))[0]
                whole.append(value)
            grams, owners = np.append(grams, np.array(whole, dtype=np.uint64)), np.append(owners, short)
            order = np.argsort(owners, kind="stable")
            grams, owners = grams[order], owners[order]
    ends = np.cumsum(np.bincount(owners, minlength=len(texts))).tolist()
    for start, end in zip([0, *ends], ends, strict=False):
        grams[start:end].sort()
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[fresh], owners[fresh]


def _per_row(grams: np.ndarray, rows: np.ndarray, n_rows: int, ufunc) -> np.ndarray:
    out = np.zeros(n_rows, dtype=np.uint64)
    ufunc.at(out, rows, grams)
    return out


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of the compact sketch: a power of two of at least 64 and BITS a gram."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, BITS * sizes))).astype(np.int64))


def sketches(grams: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    bits = sketch_bits(sizes)
    base = np.cumsum(bits) - bits
    place = base[rows] + (mix64(grams ^ _ODD[1]) & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    packed = np.packbits(parity, bitorder="little").tobytes()
    ends = np.cumsum(bits) // 8
    return [packed[e - b // 8 : e] for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch (64-bit words in the last axis) as it would be with fewer bits."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def block_keys(grams: np.ndarray, rows: np.ndarray, sizes: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which each set looks for partners, and the row of each.

    A document uses the blocks of its own band and, if its size is among those of partners, of lower bands. Blocks with
    one gram or none are left out where more than d others remain: a linked pair then shares one of those, and its
    partner, whose equal block holds as many grams, has not left it out either. Other documents use all their blocks.
    """
    low, top, blocks, differ = bands(measure, int(sizes.max()) if len(sizes) else 0)
    keys, owners = [], []
    block_hash, bit_hash = mix64(grams ^ _ODD[2]) >> np.uint64(33), mix64(grams ^ _ODD[3])
    own = np.searchsorted(low, sizes, side="right") - 1
    back = 0
    while len(sizes):
        band = own - back
        member = (sizes > 0) & (band >= 0) & (sizes <= top[np.maximum(band, 0)])
        if not member.any():
            break
        count = np.where(member, blocks[np.maximum(band, 0)], 0)
        base = np.cumsum(count) - count
        uses = count[rows] > 0
        cell = base[rows[uses]] + (block_hash[uses] % count[rows[uses]].astype(np.uint64)).astype(np.int64)
        content = np.zeros(int(count.sum()), dtype=np.uint64)
        np.bitwise_xor.at(content, cell, bit_hash[uses])
        held = np.bincount(cell, minlength=len(content))
        owner = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(len(content)) - base[owner]
        rich = held >= 2
        enough = np.bincount(owner[rich], minlength=len(sizes)) > differ[np.maximum(band, 0)]
        emit = rich | ~enough[owner]
        tag = mix64((band[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(1))
        keys.append(mix64(content ^ tag)[emit])
        owners.append(owner[emit])
        back += 1
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], owners[order]


FEATURES = "uid long, id {id}, th long, n long, d1 long, d2 long, keys array<long>, sketch binary, brief binary"


def _features(measure: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            size = batch.num_rows
            grams, rows = ngrams(batch.column("text").to_pylist(), measure.words)
            sizes = np.bincount(rows, minlength=size)
            keys, owners = block_keys(grams, rows, sizes, measure)
            starts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=size))])
            digests = [_per_row(mix64(grams ^ _ODD[0]), rows, size, np.bitwise_xor), _per_row(mix64(grams ^ _ODD[4]), rows, size, np.add)]
            full = sketches(grams, rows, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("uid", "id", "th")),
                    pa.array(sizes.astype(np.int64)),
                    *(pa.array(d.view(np.int64)) for d in digests),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keys.view(np.int64))),
                    pa.array(full, pa.binary()),
                    pa.array([fold(np.frombuffer(x, dtype=np.uint64), max(1, len(x) // 8 // BRIEF)).tobytes() for x in full], pa.binary()),
                ],
                names=["uid", "id", "th", "n", "d1", "d2", "keys", "sketch", "brief"],
            )

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node, those whose key another row has, with the first node of the key."""
    held = None  # the last row waits for its successor: key, node, head, whether its predecessor had its key

    def out(key, head, node) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, head, node)], names=["key", "head", "node"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if held:
            key, node = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], node])
        same = key[1:] == key[:-1]
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(key)), 0))
        head = node[first]
        if held:
            head[first == 0] = held[2]
        before = np.concatenate([[bool(held and held[3])], same])
        emit = np.flatnonzero(before[:-1] | same)
        held = key[-1], node[-1], head[-1], bool(before[-1])
        if len(emit):
            yield out(key[emit], head[emit], node[emit])
    if held and held[3]:
        yield out([held[0]], [held[2]], [held[1]])


def _differing(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    words = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum())


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _near(measure: Measure):
    """Pairs whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, n_a, n_b, s_a, s_b in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")), strict=True):
                if max(n_a, n_b) <= measure.largest_partner(min(n_a, n_b)) and _differing(s_a, s_b) <= measure.may_differ(n_a, n_b):
                    out.append((a, b))
            yield _pairs(out)

    return run


def _linked(measure: Measure):
    """Pairs whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, g_a, g_b in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "grams_a", "grams_b")), strict=True):
                x, y = np.frombuffer(g_a, dtype=np.uint64), np.frombuffer(g_b, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= measure.percent * (len(x) + len(y) - common):
                    out.append((a, b))
            yield _pairs(out)

    return run


def _runs(batches: Iterator[pa.RecordBatch], place: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Sorted rows as lists of those that share their ``place``."""
    at, held = None, []
    for batch in batches:
        for *here, row in zip(*(batch.column(c).to_pylist() for c in place), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if here != at:
                if held:
                    yield held
                at, held = here, []
            held.append(row)
    if held:
        yield held


def _compare(measure: Measure):
    """Of each (key, lo, hi) run of sorted rows the members that sizes and brief sketches allow a link to another component.

    A member comes out once, however many others it may link with, so the rows never outgrow those read.
    """

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        nodes, comps, sizes = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1, 2))
        words = min(len(r[3]) for r in rows) // 8
        bits = np.stack([fold(np.frombuffer(r[3], dtype=np.uint64), words) for r in rows])
        kept = np.zeros(len(rows), dtype=bool)
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            fits = comps[rest] != comps[i]
            if kept[i]:
                fits &= ~kept[rest]  # what both are known to be needs no further test
            fits = np.flatnonzero(fits) + i + 1
            low, high = np.minimum(sizes[fits], sizes[i]), np.maximum(sizes[fits], sizes[i])
            fits = fits[high <= measure.largest_partner(low)]
            differ = np.bitwise_count(bits[fits] ^ bits[i]).sum(axis=1)
            near = fits[differ <= measure.may_differ(sizes[fits], sizes[i])]
            if len(near):
                kept[near] = kept[i] = True
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(kept.sum()), rows[0][4], dtype=np.int64)), pa.array(nodes[kept])], names=["head", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(judge, _runs(batches, ("key", "lo", "hi"), ("node", "component", "n", "brief", "head")))

    return run


def _forest(measure: Measure):
    """Within each (head, lo, hi) run of sorted rows: links between components, as many as join those that hang together.

    The sets themselves are compared, so pairs that miss the similarity leave no row, and links inside a component that
    hangs together by then are not looked for.
    """

    def judge(rows: list[tuple]) -> list[tuple[int, int]]:
        nodes, comps = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
        sets = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        full = sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes)
        words = min(len(x) for x in full) // 8
        bits = np.stack([fold(np.frombuffer(x, dtype=np.uint64), words) for x in full])
        out = []
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            fits = np.flatnonzero(comps[rest] != comps[i]) + i + 1
            low, high = np.minimum(sizes[fits], sizes[i]), np.maximum(sizes[fits], sizes[i])
            fits = fits[high <= measure.largest_partner(low)]
            differ = np.bitwise_count(bits[fits] ^ bits[i]).sum(axis=1)
            for j in fits[differ <= measure.may_differ(sizes[fits], sizes[i])]:
                if comps[j] == comps[i]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= measure.percent * (sizes[i] + sizes[j] - common):
                    out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                    comps[comps == comps[j]] = comps[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_pairs, map(judge, _runs(batches, ("head", "lo", "hi"), ("node", "component", "grams"))))

    return run


def _cells(members: DataFrame, group: str) -> DataFrame:
    """Members in each cell (lo, hi) of their group: any two members meet in one cell, which holds two pieces at most."""
    members = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("pieces")).cast("int"))
    rest = [c for c in members.columns if c not in (group, "own", "pieces")]
    spread = members.select(group, *rest, "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    return spread.select(group, *rest, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


class NgramJoin:
    """The join over one table; each step is a stored table in the shared folder."""

    def __init__(self, docs: DataFrame, measure: Measure, id_col: str, text_col: str):
        self.measure = measure
        text = F.col(text_col)
        self.docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
        id_type = docs.schema[id_col].dataType.simpleString()
        numbered = self.docs.withColumn("uid", F.monotonically_increasing_id())
        self.features = stage(numbered.mapInArrow(_features(measure), FEATURES.format(id=id_type)), "features")
        # Equal sets become one node, named by its first row.
        sets = self.features.where(F.col("n") > 0).groupBy("d1", "d2", "n").agg(F.min("uid").alias("node"), F.min("id").alias("low"))
        narrow = self.features.select("uid", "id", "th", "n", "d1", "d2")
        self.rows = stage(narrow.join(sets, ["d1", "d2", "n"], "left").select("uid", "id", "th", "n", "node", "low"), "rows")
        copies = self.rows.where(F.col("uid") != F.col("node")).select("uid")
        nodes = self.features.where(F.col("n") > 0).join(small_or_not(copies), "uid", "left_anti")
        self.nodes = nodes.withColumnRenamed("uid", "node")

    def near(self, pairs: DataFrame) -> DataFrame:
        side = self.nodes.select("node", "n", "sketch")
        for name in ("a", "b"):
            pairs = pairs.join(side.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}")), name)
        return stage(pairs.mapInArrow(_near(self.measure), "a long, b long").distinct(), "near")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node, grams of the nodes in ``wanted``, built again from the texts."""
        wanted = stage(self.rows.where(F.col("uid") == F.col("node")).select("node", F.col("id").alias("own"), F.col("th").alias("own_th")).join(wanted, "node", "left_semi"), "wanted")
        texts = self.docs.join(small_or_not(wanted), F.col("id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th"))).select("node", "text")
        words = self.measure.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                grams, rows = ngrams(batch.column("text").to_pylist(), words)
                ends = np.cumsum(np.bincount(rows, minlength=batch.num_rows)).tolist()
                sets = [grams[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "grams"])

        # A row that repeats with its id gives its node's set more than once.
        return stage(texts.mapInArrow(run, "node long, grams binary").dropDuplicates(["node"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sets reach the similarity."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        for name in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(name), F.col("grams").alias(f"grams_{name}")), name)
        return stage(pairs.mapInArrow(_linked(self.measure), "a long, b long"), "links")

    def forest(self, kept: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between components among the members that share a head (head, node), compared by their sets.

        Copies meet in many blocks but under few heads, so members are gathered by head. A piece has a bounded number
        of members and of grams.
        """
        sized = kept.join(self.nodes.select("node", "n"), "node")
        pieces = sized.groupBy("head").agg(F.ceil(F.greatest(F.count("*") / PIECE, F.sum("n") / PIECE_GRAMS)).cast("int").alias("pieces"))
        members = kept.join(pieces, "head").join(labels, "node", "left").select("head", "node", F.coalesce("component", "node").alias("component"), "pieces")
        cells = _cells(members, "head").join(self.sets(kept.select("node").distinct()), "node")
        return stage(cells.repartition("head", "lo", "hi").sortWithinPartitions("head", "lo", "hi", "node").mapInArrow(_forest(self.measure), "a long, b long"), "forest")

    def components(self) -> DataFrame:
        """node, component of the nodes that have a link."""
        keyed = self.nodes.select("node", F.explode("keys").alias("key"))
        met = keyed.repartition("key").sortWithinPartitions("key", "node").select("key", "node").mapInArrow(_meet, "key long, head long, node long")
        met = stage(met, "met")
        # First everyone with the first node of its block; most groups hang together after that.
        others = met.where(F.col("head") != F.col("node"))
        first = self.links(self.near(others.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()))
        labels = components(first)
        # Then, where a block still holds several components, the members besides its first node among themselves.
        placed = others.join(labels, "node", "left").select("key", "head", "node", F.coalesce("component", "node").alias("component"))
        open_keys = placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(2**31))).alias("y")
        )
        open_keys = open_keys.where(F.col("low") != F.col("high")).groupBy("size", "x", "y").agg(F.min("key").alias("key"))  # equal member lists once
        pieces = open_keys.select("key", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces"))
        spread = _cells(placed.join(pieces, "key"), "key").join(self.nodes.select("node", "n", "brief"), "node")
        compared = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(_compare(self.measure), "head long, node long")
        kept = stage(compared.distinct(), "kept")
        if kept.isEmpty():
            return labels
        return components(first.unionByName(self.forest(kept, labels)))


def ngram_join(docs: DataFrame, measure: Measure = Measure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, and text_hash (xxhash64 of the text).

    ``n_shingles`` is the size of the set of distinct n-grams; ``component_id`` the least id reachable over links of at
    least the similarity, the row itself included. A null or empty text, or one without words, has an empty set and is
    linked with nothing. Rows with equal sets are always together; a null id counts only where all ids are null. Empty
    tables give no rows; other columns are ignored. Sets are compared as 64-bit hashes of their n-grams.
    Links inside a component that is already known to hang together are not tested one by one.
    """
    join = NgramJoin(docs, measure, id_col, text_col)
    labels = join.components()
    groups = join.rows.where(F.col("uid") == F.col("node")).select("node", "low").join(labels, "node", "left")
    groups = groups.select("node", "low", F.coalesce("component", "node").alias("component"))
    lowest = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    placed = groups.join(lowest, "component").select("node", "component_id")
    rows = join.rows.select("id", "th", "n", "node").join(placed, "node", "left")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("th").alias("text_hash"),
    )


def keep_one(docs: DataFrame, measure: Measure = Measure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each component left: the one with the least id, all columns as they are.

    Rows without words, null texts among them, all stay. Of rows alike in id and text one stays. An empty table stays
    empty. No column is added, and those of ``docs`` may have any name but ``__id``, ``__hash``, ``__kept`` and ``__component``.
    """
    own: list[str] = []
    with staged_into(own):
        joined = ngram_join(docs, measure, id_col, text_col)
    joined = stage(joined.select(F.col(id_col).alias("__id"), "n_shingles", "component_id", F.col("text_hash").alias("__hash")), "components")
    drop_staged(docs.sparkSession, own)  # the tables of the join have given their rows
    worded = joined.where(F.col("n_shingles") > 0)
    # A component whose least id has several texts keeps one of them.
    least = F.col("__id").eqNullSafe(F.col("component_id"))
    kept = worded.where(least).groupBy("component_id").agg(F.min("__hash").alias("__kept"))
    kept = worded.join(kept.withColumnRenamed("component_id", "__component"), F.col("component_id").eqNullSafe(F.col("__component")))
    dropped = stage(kept.where(~(least & (F.col("__hash") == F.col("__kept")))).select("__id", "__hash").distinct(), "dropped")
    # Rows that repeat with their id, rare in a corpus with sound ids, are the only texts that must meet.
    repeated = stage(worded.groupBy("__id", "__hash").count().where("count > 1").drop("count"), "repeated")
    matches = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))
    left = docs.join(small_or_not(dropped), matches, "left_anti")
    if repeated.isEmpty():
        return left
    once = left.join(small_or_not(repeated), matches, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(small_or_not(repeated), matches, "left_anti").unionByName(once)
