"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# The reflected CRC-32 polynomial; a table of its remainders for one half byte follows from it.
CRC_POLYNOMIAL = 0xEDB88320


def _half_byte(n: int) -> int:
    for _ in range(4):
        n = (n >> 1) ^ (CRC_POLYNOMIAL if n & 1 else 0)
    return n


CRC_TABLE = f"[{','.join(str(_half_byte(n)) for n in range(16))}]"

SHARDS_SQL = f"""
WITH halves AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '.'), lambda h: ('0x' || h)::BIGINT) AS h
    FROM documents),
checked AS (
    SELECT doc_id, size::BIGINT AS size,
           xor(list_reduce(list_transform(range(len(h)), lambda i: h[i + 2 - 2 * (i % 2)]),
                           lambda a, x: xor(a >> 4, {CRC_TABLE}[(xor(a, x) & 15) + 1]), 4294967295), 4294967295) AS text_crc32
    FROM halves),
summed AS (
    SELECT *, (sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before,
           (sum(size) OVER ())::BIGINT AS total, row_number() OVER (ORDER BY doc_id, size, text_crc32) AS n
    FROM checked),
cut AS (SELECT *, ((2 * before + size) * 40 // (2 * total))::INTEGER AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

LINE_DEDUP_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
    FROM documents WHERE text IS NOT NULL),
hashed AS (
    SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines),
cut AS (
    SELECT *, ((h + 257 * lag(h, 1, 0) OVER o) % 2147483647) % 4 = 0 OR words >= 50 OR lead(words, 1, 0) OVER o >= 50 AS ends
    FROM hashed WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
numbered AS (
    SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
    FROM cut),
chunks AS (
    SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY no) AS part, count(*) AS n,
           sum(words) >= 50 OR (count(*) > 1 AND sum(words) > 0) AS movable
    FROM numbered GROUP BY doc_id, chunk),
judged AS (
    SELECT *, NOT movable OR row_number() OVER (PARTITION BY movable, part ORDER BY doc_id, chunk) = 1 AS kept FROM chunks),
rebuilt AS (
    SELECT doc_id, coalesce(string_agg(part, chr(10) ORDER BY chunk) FILTER (kept), '') AS text, sum(n)::BIGINT AS n_lines,
           count(*) AS n_chunks, coalesce(sum(n) FILTER (NOT kept), 0)::BIGINT AS removed_lines, count(*) FILTER (NOT kept) AS removed_chunks
    FROM judged GROUP BY doc_id)
SELECT * FROM rebuilt
UNION ALL SELECT doc_id, NULL, 0, 0, 0, 0 FROM documents WHERE text IS NULL
"""

NGRAM_JOIN_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM linked UNION SELECT r.doc_id, b.b FROM reach r JOIN linked b ON b.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, coalesce(min(r.other), s.doc_id) AS component_id
FROM sizes s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""


def _more(state: str, cost: int | str, letter: str) -> str:
    """A state's text, cost in twelve digits and then the audit, after one more edit; the least text is the best."""
    return f"lpad((left({state}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || '{letter}'"


def _least(*choices: str) -> str:
    return f"least({', '.join(choices)})"


def _when(condition: str, choice: str) -> str:
    return f"CASE WHEN {condition} THEN {choice} END"


# State 0: at the start, 1: after s, 2: after u, 3: after a. Inserts before a row, then its edit.
_INSERTED = (
    "SELECT conv_id, k, c0, c1, c2, least(c3, " + _more("c2", 5, "I") + ") AS c3 FROM ("
    "SELECT conv_id, k, v0 AS c0, v1 AS c1, " + _least("v2", *(_more(f"v{p}", 5, "I") for p in (0, 1, 3))) + " AS c2, v3 AS c3 FROM {table})"
)
_EXTRA = "CASE WHEN r.truncated THEN 5 ELSE 0 END"
_STAYS = "NOT r.gone"
_NEXT = ", ".join(
    [
        _more("c0", 2, "D") + " AS v0",
        _least(_more("c1", 2, "D"), _when(f"{_STAYS} AND r.initial = 's'", _more("c0", _EXTRA, "K"))) + " AS v1",
        _least(
            _more("c2", 2, "D"),
            *(_when(f"{_STAYS} AND r.initial = 'u'", _more(f"c{p}", _EXTRA, "K")) for p in (0, 1, 3)),
            *(_when(_STAYS, _more(f"c{p}", f"1 + {_EXTRA}", "R")) for p in (0, 1, 3)),
        )
        + " AS v2",
        _least(_more("c3", 2, "D"), _when(f"{_STAYS} AND r.initial = 'a'", _more("c2", _EXTRA, "K")), _when(_STAYS, _more("c2", f"1 + {_EXTRA}", "R"))) + " AS v3",
    ]
)

REPAIR_SQL = rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '.'),
                          lambda h: ('0x' || h)::BIGINT) AS h
    FROM conversations),
coded AS (
    SELECT *, xor(list_reduce(list_transform(range(len(h)), lambda i: h[i + 2 - 2 * (i % 2)]),
                              lambda a, x: xor(a >> 4, {CRC_TABLE}[(xor(a, x) & 15) + 1]), 4294967295), 4294967295) % 20 AS kind
    FROM keyed),
planted AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, left(role, 1) AS initial FROM planted),
marked AS (
    SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
           NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut_off,
           k > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial NOT IN ('su', 'ua', 'au') AS illegal
    FROM placed),
r AS (SELECT *, again AND NOT blank AS duplicate, blank OR again AS gone, cut_off AND NOT blank AND NOT again AS truncated FROM marked),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
           count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(k) AS n
    FROM r GROUP BY conv_id),
states AS (
    SELECT conv_id, 0::BIGINT AS k, '000000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM counts
    UNION ALL
    SELECT r.conv_id, r.k, {_NEXT} FROM ({_INSERTED.format(table='states')}) c JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.k = c.k + 1),
closed AS ({_INSERTED.format(table='states')}),
ends AS (
    SELECT c.conv_id, least(c0, c3) AS found FROM closed c JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND n.n = c.k),
letters AS (
    SELECT conv_id, generate_subscripts(string_split(substr(found, 13), ''), 1) AS j, unnest(string_split(substr(found, 13), '')) AS edit
    FROM ends WHERE len(found) > 12),
edits AS (
    SELECT *, sum((edit <> 'I')::INTEGER) OVER o AS k, sum((edit <> 'D')::INTEGER) OVER o AS place
    FROM letters WINDOW o AS (PARTITION BY conv_id ORDER BY j)),
kept AS (
    SELECT e.conv_id, e.j, e.edit, e.place, r.role, CASE WHEN e.edit = 'I' THEN '' ELSE r.text END AS text,
           max((e.place = 1 AND e.edit = 'K' AND r.initial = 's')::INTEGER) OVER (PARTITION BY e.conv_id) AS led
    FROM edits e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.k = e.k WHERE e.edit <> 'D'),
rebuilt AS (
    SELECT conv_id, sha256(string_agg(
               CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS digest
    FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(left(e.found, 12)::BIGINT, 0) AS cost,
       coalesce(substr(e.found, 13), '') AS audit, coalesce(b.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN rebuilt b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _terms(table: str, row: str) -> str:
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {row}, unnest(regexp_extract_all({folded}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}"


RANKED_SEARCH_SQL = f"""
WITH terms AS ({_terms('documents', 'doc_id')}),
counted AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM counted GROUP BY ALL), whole),
asked AS (SELECT item_id, term, count(*) AS q FROM ({_terms('benchmark', 'item_id')}) GROUP BY ALL),
scores AS (
    SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // len))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
