"""The same results in DuckDB's SQL, for those training-data queries that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_MINHASH = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k : k + 3], ' ')) END) AS shingle
  FROM worded WHERE w IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

OP13_SEARCH = f"""
WITH worded AS (SELECT doc_id, row_number() OVER () AS r, {TERMS.format("text")} AS words FROM documents),
docs AS (SELECT r, doc_id, len(words) AS n FROM worded WHERE len(words) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM worded) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
wanted AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
weighed AS (SELECT item_id, term, qf * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM wanted JOIN dfs USING (term), total),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM weighed JOIN tfs USING (term) JOIN docs USING (r), total GROUP BY ALL),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 20
"""


def _edit(key: str, cost: str | int, letter: str) -> str:
    """SQL of a key (ten digits of cost, then edits) with an edit put before it."""
    return f"lpad((left({key}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || '{letter}' || substr({key}, 11)"


def _before(x: int) -> str:
    """SQL of the best key in state x before a row, from the keys k0 to k3 after it; states: nothing, s, u, a last."""

    def consumed(s: int) -> str:
        nxt = 3 if s == 2 else 2
        kept = [f"CASE WHEN ini = 's' AND NOT gone THEN {_edit('k1', 'extra', 'K')} END"] if s == 0 else []
        kept.append(f"CASE WHEN ini = '{'a' if s == 2 else 'u'}' AND NOT gone THEN {_edit(f'k{nxt}', 'extra', 'K')} END")
        return f"least({_edit(f'k{s}', 2, 'D')}, CASE WHEN NOT gone THEN {_edit(f'k{nxt}', '1 + extra', 'R')} END, {', '.join(kept)})"

    inserted = [_edit(f"({consumed(3 if x == 2 else 2)})", 5, "I")] + [_edit(f"({consumed(3)})", 10, "II")] * (x < 2)
    return f"least({consumed(x)}, {', '.join(inserted)}) AS k{x}"


BLANK = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 of an ASCII string: bit by bit, from its reflected polynomial 0xEDB88320.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(split(key, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""

OP11_REPAIR = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
faulty AS (SELECT *, {CRC} % 20 AS fault FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    left(role, 1) AS ini, right(rtrim(text, {BLANK}), 1) AS ending, lag(left(role, 1)) OVER w AS ini_before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faults AS (
  SELECT *, ending = '' AS blank, ending <> '' AND again AS dup, ending NOT IN ('', '.', '!', '?') AND NOT again AS trunc FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank,
    count_if(dup)::BIGINT AS duplicate, count_if(trunc)::BIGINT AS truncated, count_if(ini_before || ini NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(pos) AS n
  FROM faults GROUP BY conv_id),
codes AS (SELECT conv_id, pos, ini, blank OR dup AS gone, CASE WHEN trunc THEN 5 ELSE 0 END AS extra FROM faults),
best AS (
  SELECT conv_id, n + 1 AS pos, '0000000000' AS k0, '0000000010II' AS k1, '0000000005I' AS k2, '0000000000' AS k3 FROM counted
  UNION ALL
  SELECT b.conv_id, c.pos, {", ".join(_before(x) for x in range(4))}
  FROM best b JOIN codes c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.pos = b.pos - 1),
audits AS (SELECT conv_id, left(k0, 10)::BIGINT AS cost, substr(k0, 11) AS audit FROM best WHERE pos = 1),
letters AS (SELECT conv_id, unnest(split(audit, '')) AS edit, unnest(range(length(audit))) AS place FROM audits WHERE audit <> ''),
steps AS (
  SELECT *, sum((edit <> 'I')::INT) OVER w AS pos, sum((edit <> 'D')::INT) OVER w AS line
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
lined AS (
  SELECT s.conv_id, line, edit, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text,
    max((line = 1 AND edit = 'K' AND ini = 's')::INT) OVER (PARTITION BY s.conv_id) AS shift
  FROM steps s LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos AND s.edit <> 'I' WHERE edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (line - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY line) AS whole
  FROM lined GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""
