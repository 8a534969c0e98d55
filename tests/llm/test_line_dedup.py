from collections import Counter

from cases import documents, frame
from compare import compare, open_tables

from pulsegrid.llm.line_dedup import chunk_rows, dedup_lines
from pulsegrid.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"


def movable(n_lines, n_words):
    return n_words >= 50 or (n_lines > 1 and n_words > 0)


def by_hand(rows):
    """Texts with repeated chunks removed; rows in order of id (nulls first)."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for n_lines, n_words, part in chunk_rows(text) if text is not None else []:
            if not movable(n_lines, n_words) or part not in seen:
                kept.append(part)
            if movable(n_lines, n_words):
                seen.add(part)
        out.append((doc_id, None if text is None else "\n".join(kept)))
    return out


def test_query_equals_sql(spark):
    assert compare(spark, open_tables(SF), SF, LLM_QUERIES["op2_line_dedup"], LLM_ORACLES["op2_line_dedup"]) == ""


def test_against_brute_force(spark):
    rows = documents()
    out = dedup_lines(frame(spark)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(by_hand(rows))
    assert {r.rest for r in out} == {"r"} and {r.uid for r in out} == {9}


def test_chunks_resist_shifts():
    passage = "\n".join(f"line number {n} of a passage" for n in range(40))
    a = {part for _, _, part in chunk_rows(passage)}
    b = {part for _, _, part in chunk_rows("something else\nbefore\n" + passage + "\nafter")}
    assert len(a & b) >= len(a) - 2 and "\n".join(p for _, _, p in chunk_rows(passage)) == passage


def test_long_repeated_line_goes_and_clean_rows_stay(spark):
    line = " ".join(f"word{n}" for n in range(60))
    rows = [(n, f"own start {n}\n{line}\nown end {n}") for n in range(30)] + [(99, "all\nclean\nhere")]
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert line in out[0].text and out[99].text == "all\nclean\nhere"
    assert all(out[n].text == f"own start {n}\nown end {n}" and out[n].removed_lines == 1 for n in range(1, 30))


def test_empty(spark):
    assert dedup_lines(frame(spark, [])).collect() == []
