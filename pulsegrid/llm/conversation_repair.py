"""Repair of conversations: the cheapest edits that make the roles read ``(s?(ua)+)?``, found by weighted CYK parsing.

The grammar is in Chomsky normal form. Its nonterminals N[p, q] derive what takes the pattern from state p to state q
(START, after s, after u, after a); N[p, q] -> N[p, r] N[r, q] joins neighbouring spans, and N[p, q] -> row by one of
the edits of a row: keep (0), new role user or assistant (1), delete (2). A row kept or given a new role although it is
cut off costs 5 more; blank and repeated rows can only be deleted. Inserts (5) belong to no row, so they are closed over
once (N[p, q] -> N[p, r] I, to the fixed point) and joined before each row and after the last.

A cell holds the least (cost, audit) of its span, the audit being the initials of the edits (K, R, D, I). Two audits of
one span and one cost are never prefixes of each other (more inserts cost more), so the order of joined audits is that of
their parts, and a cell is exact from its parts' cells. As every derivation of N[p, q] can be cut behind any row, all
splits of a span give one and the same minimum; hence one split a span is joined. Spans are joined bottom up by length:
1, 2, 4, ... rows within a block of the order, then blocks of spans, so a conversation of any length is parsed by many
tasks, each of which holds a bounded number of cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices, stage

BLANKS = " \t\n\x0b\x0c\r"  # x20, x09 to x0D
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
USER, ASSISTANT = "user", "assistant"

# States of the pattern and where a role's initial leads; a conversation may end at the start or after an assistant.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
LEGAL_PAIRS = ("su", "ua", "au")
ENDINGS = (START, AFTER_A)

BLOCK_BITS = 10  # rows of the order parsed together: 1024
JOIN_SPANS = 64  # spans of one conversation joined together

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


def joined(left: Cells, right: Cells) -> Cells:
    """N[p, q] -> N[p, r] N[r, q]: the cells of two neighbouring spans as one."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is None:
                continue
            total, held = cost + other[0], out.get((p, q))
            if held is None or total < held[0] or (total == held[0] and audit + other[1] < held[1]):
                out[p, q] = (total, audit + other[1])
    return out


@lru_cache(maxsize=1)
def inserts() -> Cells:
    """Closure of inserted user and assistant rows, none included."""
    single = {(p, q): (INSERT, "I") for role in "ua" for p, q in STEPS[role].items()}
    closed: Cells = {(p, p): (0, "") for p in range(4)}
    while True:
        longer = joined(closed, single)
        merged = {key: min(found) for key in closed | longer if (found := [c[key] for c in (closed, longer) if key in c])}
        if merged == closed:
            return closed
        closed = merged


@lru_cache(maxsize=64)
def row_cells(initial: str, gone: bool, cut_off: bool) -> Cells:
    """Inserts before a row, then one edit of it."""
    edits: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if not gone:
        more = CUT_OFF if cut_off else 0
        found = [(p, q, KEEP + more, "K") for p, q in STEPS.get(initial, {}).items()]
        found += [(p, q, REROLE + more, "R") for role in "ua" for p, q in STEPS[role].items()]
        for p, q, cost, letter in found:
            edits[p, q] = min(edits.get((p, q), (cost, letter)), (cost, letter))
    return joined(inserts(), edits)


@dataclass
class Span:
    """What is known of neighbouring rows of one conversation: its cells and counts."""

    cells: Cells
    first: str  # initials of the outer rows
    last: str
    low: int | None  # turns; null turns are left out
    high: int | None
    turns: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int

    def __add__(self, other: Span) -> Span:
        shared = self.high is not None and self.high == other.low
        return Span(
            joined(self.cells, other.cells),
            self.first,
            other.last,
            other.low if self.low is None else self.low,
            self.high if other.high is None else other.high,
            self.turns + other.turns - shared,
            self.blank + other.blank,
            self.duplicate + other.duplicate,
            self.truncated + other.truncated,
            self.illegal + other.illegal + (self.last + other.first not in LEGAL_PAIRS),
        )


def row_span(turn: int | None, initial: str, blank: bool, again: bool, cut_off: bool) -> Span:
    again, cut_off = again and not blank, cut_off and not blank and not again
    return Span(row_cells(initial, blank or again, cut_off), initial, initial, turn, turn, int(turn is not None), int(blank), int(again), int(cut_off), 0)


def parsed(spans: list[Span]) -> Span:
    """Joins neighbouring spans, doubling their length step by step."""
    while len(spans) > 1:
        spans = [spans[i] + spans[i + 1] if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def best(cells: Cells) -> Cell:
    """The least cost and audit of a whole conversation."""
    whole = joined(cells, inserts())
    return min(whole[START, q] for q in ENDINGS if (START, q) in whole)


def _turn(value) -> int | None:
    return None if pd.isna(value) else int(value)


COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal"]
SPAN = "p array<int>, q array<int>, cost array<long>, audit array<string>, first string, last string, low long, high long, " + ", ".join(f"{c} long" for c in COUNTS)


def _to_row(span: Span) -> dict:
    keys = sorted(span.cells)
    row = {"p": [p for p, _ in keys], "q": [q for _, q in keys], "cost": [span.cells[k][0] for k in keys], "audit": [span.cells[k][1] for k in keys]}
    return row | {"first": span.first, "last": span.last, "low": span.low, "high": span.high} | {c: getattr(span, c) for c in COUNTS}


def _from_row(row) -> Span:
    cells = {(int(p), int(q)): (int(c), a) for p, q, c, a in zip(row.p, row.q, row.cost, row.audit, strict=True)}
    return Span(cells, row.first, row.last, _turn(row.low), _turn(row.high), *(int(getattr(row, c)) for c in COUNTS))


def _frame(rows: list[dict], extra: list[str]) -> pd.DataFrame:
    names = extra + ["p", "q", "cost", "audit", "first", "last", "low", "high", *COUNTS]
    found = pd.DataFrame(rows, columns=names)
    return found.astype({"low": "Int64", "high": "Int64"})


def ordered_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Stored rows conv, turn, role, text and their place ``n`` in the order of all rows: by conversation, then turn.

    Null turns come first; rows of one turn follow each other by role, then by the SHA-256 of their text; equal rows in
    any order. Null roles and texts become one space. The range sort spreads a long conversation over many tasks.
    """
    plain = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    keyed = plain.withColumn("code", F.sha2("text", 256)).withColumn("tie", F.monotonically_increasing_id())
    keys = ["conv", "turn", "role", "code", "tie"]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(ordered.drop("tie").withColumn("n", F.monotonically_increasing_id()), "ordered")


def _faults(ordered: DataFrame) -> DataFrame:
    """n, conv, turn, initial, blank, again, cut_off. The first row of each role and text is found by its place."""
    firsts = ordered.groupBy("conv", "role", "code").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("new"))
    inner = F.rtrim("text", F.lit(BLANKS))
    judged = ordered.select(
        "n", "conv", "turn", F.substring("role", 1, 1).alias("initial"), (inner == "").alias("blank"), (~F.substring(inner, -1, 1).isin(*ENDS)).alias("cut_off")
    )
    return judged.join(firsts, "n", "left").withColumn("again", F.col("new").isNull()).drop("new")


def parse_conversations(ordered: DataFrame) -> DataFrame:
    """One span a conversation of ``ordered_rows``: conv, cells (p, q, cost, audit), outer initials and turns, counts."""
    conv = f"conv {ordered.schema['conv'].dataType.simpleString()}"

    def parse(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("n")
        out: list[dict] = []
        spans: list[Span] = []
        names = block["conv"].tolist()
        for k, row in enumerate(block.itertuples(index=False)):
            spans.append(row_span(_turn(row.turn), row.initial, row.blank, row.again, row.cut_off))
            if k + 1 == len(names) or not _same(names[k], names[k + 1]):
                out.append({"conv": names[k], "place": int(row.n)} | _to_row(parsed(spans)))
                spans = []
        return _frame(out, ["conv", "place"])

    def join_spans(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        whole = parsed([_from_row(row) for row in group.itertuples(index=False)])
        return _frame([{"conv": group["conv"].iloc[0], "place": int(group["place"].iloc[0])} | _to_row(whole)], ["conv", "place"])

    schema = f"{conv}, place long, {SPAN}"
    faults = _faults(ordered).withColumn("block", F.shiftright("n", BLOCK_BITS))
    spans = stage(faults.groupBy("block").applyInPandas(parse, schema), "spans")
    done = []
    while True:  # each round leaves a 64th of a conversation's spans
        mine = Window.partitionBy("conv").orderBy("place")
        numbered = spans.select("conv", "place", (F.row_number().over(mine) - 1).alias("k"))
        several = numbered.groupBy("conv").agg(F.max("k").alias("most")).where("most > 0").select(F.col("conv").alias("c"))
        several = stage(numbered.join(several, F.col("conv").eqNullSafe(F.col("c")), "left_semi").select("place", "k"), "numbers")
        if several.isEmpty():
            return _union([*done, spans])
        done.append(spans.join(several, "place", "left_anti"))
        again = spans.join(several, "place").withColumn("group", F.expr(f"k div {JOIN_SPANS}"))
        spans = stage(again.groupBy("conv", "group").applyInPandas(join_spans, schema), "spans")


def _same(a, b) -> bool:
    return (pd.isna(a) and pd.isna(b)) or a == b


def _union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def reports(spans: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation."""
    conv = spans.schema["conv"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv {conv}, {', '.join(f'{n} long' for n in names)}, audit string"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                span = _from_row(row)
                gaps = 0 if span.low is None else span.high - span.low + 1 - span.turns
                out.append((row.conv, gaps, span.blank, span.duplicate, span.truncated, span.illegal, *best(span.cells)))
            yield pd.DataFrame(out, columns=["conv", *names, "audit"])

    return spans.drop("place").mapInPandas(judge, schema)


class _Walk:
    """Applies an audit to the rows of one conversation as they come by."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.position, self.led = conv, audit, 0, 0, 0

    def _put(self, edit: str, role: str | None, text: str) -> tuple:
        """An edited row; without a role it takes the one whose turn it is."""
        role = role if role is not None else (USER, ASSISTANT)[(self.position - self.led) % 2]
        self.position += 1
        return self.conv, self.position - 1, edit, role, text

    def added(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put("I", None, "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.added()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K" and self.position == 0 and role[:1] == "s":
            self.led = 1
        if edit != "D":
            yield self._put(edit, role if edit == "K" else None, text)


def repaired_rows(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv, position (from 0), edit (K, R or I), role, text.

    ``found`` has the ``audit`` of each conversation. All rows of a conversation pass through one task in order, led by
    the audit, a slice of rows at a time; none are gathered. The rows of one conversation lie together in the result.
    """
    kind = ordered.schema["conv"].dataType.simpleString()
    audits = found.select("conv", F.lit(-1).cast("long").alias("n"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = ordered.select("conv", "n", "role", "text").unionByName(audits)
    schema = ["conv", "position", "edit", "role", "text"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, types = None, None
        for batch in slices(batches, "text"):
            types = types or pa.schema(list(zip(schema, [batch.schema.field("conv").type, pa.int64(), *[pa.string()] * 3], strict=True)))
            out: list[tuple] = []
            for conv, n, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "n", "role", "text")), strict=True):
                if n < 0:
                    out.extend(walk.added() if walk else ())
                    walk = _Walk(conv, text)
                else:
                    out.extend(walk.row(role, text))
            yield _batch(out, types)
        if walk:
            yield _batch(list(walk.added()), types)

    together = rows.repartition("conv").sortWithinPartitions("conv", "n")
    return together.mapInArrow(apply, f"conv {kind}, position long, edit string, role string, text string")


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of ``role:text`` of all rows joined by line feeds, from ``repaired_rows`` as they lie.

    The digest is carried from row to row, so a task holds one slice of rows. Conversations without rows are missing.
    """
    kind = repaired.schema["conv"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, kind_of = None, None, None
        for batch in slices(batches, "text"):
            kind_of = batch.schema.field("conv").type
            out = []
            for own, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "position", "role", "text")), strict=True):
                if position == 0:
                    out += [(conv, sha.hexdigest())] if sha else []
                    conv, sha = own, hashlib.sha256()
                sha.update(f"{role}:{text}".encode() if position == 0 else f"\n{role}:{text}".encode())
            yield _batch(out, pa.schema([("conv", kind_of), ("repaired_sha256", pa.string())]))
        if sha:
            yield _batch([(conv, sha.hexdigest())], pa.schema([("conv", kind_of), ("repaired_sha256", pa.string())]))

    return repaired.select("conv", "position", "role", "text").mapInArrow(digest, f"conv {kind}, repaired_sha256 string")


@dataclass
class Repair:
    """``report``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit; ``rows``: see ``repaired_rows``."""

    report: DataFrame
    rows: DataFrame


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """The cheapest repair of every conversation, its faults and its repaired rows.

    A null id is a conversation like any other; null turns stand first, null roles and texts are one space (a blank row);
    rows of one turn follow each other by role, then by the SHA-256 of their text. Of equal rows all but the first are
    duplicates. ``gaps`` leaves null turns out. An empty table gives empty frames. Other columns are not read, whatever
    their names. A role counts by its first character, an empty one is illegal. Texts of any length are only looked at
    in their own row. Equal costs are decided by the least audit in ASCII order, which names exactly one repair.
    """
    ordered = ordered_rows(rows, conv_col, turn_col, role_col, text_col)
    report = stage(reports(parse_conversations(ordered)), "report")
    return Repair(report, repaired_rows(ordered, report))


def damaged(rows: DataFrame, period: int = 20) -> DataFrame:
    """conv_id, turn, role, text with faults planted by ``crc32(conv_id:turn) % period``; nulls of the last two are a space.

    0 drops the row, 1 empties its text, 2 takes its stop marks out, 3 repeats it, 4 gives it the role user. A null id
    or turn counts as one space in the key and stays null. Repeated rows are damaged alike; other columns are dropped.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % period
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    planted = rows.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit(USER)).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy"),
    )
    return planted.drop("__copy")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The report of every conv_id of the table after ``damaged``, with the digest of its repaired rows.

    A conversation of which every row was dropped has zeros, an empty audit and the digest of an empty text.
    """
    repair = repair_conversations(damaged(conversations))
    digests = conversation_digests(repair.rows).withColumnRenamed("conv", "__of")
    originals = conversations.select("conv_id").distinct()
    found = originals.join(repair.report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    found = found.join(digests, F.col("conv_id").eqNullSafe(F.col("__of")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    zero: list[Column] = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
