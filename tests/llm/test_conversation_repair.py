"""Conversation repair against a full chart parse over all spans and splits, and against exhaustive edits."""

import hashlib
import itertools
import random
import re
import zlib

from cases import SF

from pulsegrid.llm import conversation_repair as C
from pulsegrid.llm.queries import LLM_QUERIES

PATTERN = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, place long, n long, audit string, conv string"


def exhaustive(rows):
    """Least (cost, audit) and its roles over every choice of edits with up to two inserts in each gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = [[("D", "", 2)] if gone else [("K", i, 5 * cut), ("R", "u", 1 + 5 * cut), ("R", "a", 1 + 5 * cut), ("D", "", 2)] for i, gone, cut in rows]
    for edits in itertools.product(*choices):
        for adds in itertools.product(gaps, repeat=len(rows) + 1):
            roles = adds[0] + "".join(e[1] + a for e, a in zip(edits, adds[1:], strict=True))
            if PATTERN.fullmatch(roles):
                cost = sum(e[2] for e in edits) + 5 * sum(map(len, adds))
                audit = "I" * len(adds[0]) + "".join(e[0] + "I" * len(a) for e, a in zip(edits, adds[1:], strict=True))
                best = min(best or (cost, audit, roles), (cost, audit, roles))
    return best


def chart(rows):
    """Chart parsing proper: every span, every split, from the cells of single rows."""
    cells = {(i, i + 1): C.row_cells(*row) for i, row in enumerate(rows)}
    for length in range(2, len(rows) + 1):
        for i in range(len(rows) - length + 1):
            found = {}
            for k in range(i + 1, i + length):
                for key, cell in C.joined(cells[i, k], cells[k, i + length]).items():
                    found[key] = min(found.get(key, cell), cell)
            cells[i, i + length] = found
    return cells[0, len(rows)]


def test_cells_against_every_edit():
    rng = random.Random(3)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            rows = [(rng.choice("sua t"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            whole = C.best(C.parsed([C.row_span(1, i, gone, False, cut) for i, gone, cut in rows]).cells) if rows else (0, "")
            assert whole == exhaustive([(i, g, c and not g) for i, g, c in rows])[:2], rows


def test_one_split_is_as_good_as_all():
    rng = random.Random(4)
    for _ in range(40):
        rows = [(rng.choice("ssuuuaaat"), rng.random() < 0.1, rng.random() < 0.3) for _ in range(rng.randint(1, 14))]
        own = C.parsed([C.row_span(None, i, gone, False, cut and not gone) for i, gone, cut in rows]).cells
        assert own == chart([(i, g, c and not g) for i, g, c in rows])


def plain(rows, damage=False):
    """The report of each conversation, row by row in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        seen, marks = set(), []
        for _, role, text in own:
            inner = text.strip(" \t\n\x0b\x0c\r")
            marks.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cells = [(role[:1], mark in ("blank", "duplicate"), mark == "truncated") for (_, role, _), mark in zip(own, marks, strict=True)]
        cost, audit = C.best(chart(cells)) if own else (0, "")
        repaired, rest = [], iter(own)
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(rest)
            if edit != "D":
                led = bool(repaired) and repaired[0].startswith("s")
                turn = (len(repaired) - led) % 2
                repaired.append(f"{role if edit == 'K' else ('user', 'assistant')[turn]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def conversations():
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        roles = ["system"] * (conv % 3 == 0) + ["user", "assistant"] * rng.randint(0, 6)
        for turn, role in enumerate(roles):
            role = rng.choice(["user", "assistant", "tool", "", "system", None]) if rng.random() < 0.1 else role
            text = rng.choice(["Yes.", "No!", "A cut off", "", " \t", None, "Same.", f"Text {turn}?", "é中.  "])
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), role, text))
    rows += [(50, None, "user", "a."), (50, None, None, None), (51, 3, "user", "x" * 300_000), (52, -5, "user", "a."), (52, 7, "assistant", "b.")]
    rows += [(60, t // 2, ("user", "assistant")[t % 2], f"turn {t % 17}.") for t in range(150)]
    rows += [(61, 1, "user", "again.")] * 70
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "KKK", "c") for r in rows], SCHEMA).repartition(4)


def test_report_and_digest(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BITS", 2)
    monkeypatch.setattr(C, "JOIN_SPANS", 3)
    rows = conversations()
    for damage in (False, True):
        want = plain(rows, damage)
        if damage:
            got = {r[0]: tuple(r)[1:] for r in C.damage_and_repair(frame(spark, rows)).collect()}
        else:
            repair = C.repair_conversations(frame(spark, rows))
            digests = {r[0]: r[1] for r in C.conversation_digests(repair.rows).collect()}
            empty = hashlib.sha256(b"").hexdigest()
            got = {r.conv: (*tuple(r)[1:], digests.get(r.conv, empty)) for r in repair.report.collect()}
            found = {}
            for r in sorted(repair.rows.collect(), key=lambda r: (str(r.conv), r.position)):
                found.setdefault(r.conv, []).append(r)
            for own in found.values():
                assert [r.position for r in own] == list(range(len(own))) and PATTERN.fullmatch("".join(r.role[:1] for r in own))
        assert got == want


def test_no_rows(spark):
    empty = frame(spark, [(1, 1, "user", "a.")]).where("conv_id > 5")
    assert C.damage_and_repair(empty).collect() == []
    repair = C.repair_conversations(empty)
    assert repair.report.collect() == [] and repair.rows.collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in LLM_QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert got == plain(rows, True)
