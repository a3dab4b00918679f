"""DuckDB twins of operators 11 to 13."""

#: The rows that take part, with their components as whole numbers ``v``.
_WHOLE = """
fine AS (
    SELECT vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) > 65536)) = 0
), sized AS (
    SELECT len(embedding) AS n FROM fine WHERE len(embedding) % {multiple} = 0
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), whole AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM fine, sized WHERE len(embedding) = n
)"""

OP13_SQL = f"""
WITH {_WHOLE.format(multiple=1)}, scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _round(k: int) -> str:
    """Assignments to the entries of round k, and the entries of round k + 1."""
    return f"""
found{k} AS (
    SELECT num, part, arg_min(entry, off * 64 + entry) AS entry, min(off) AS far, any_value(x) AS x
    FROM (SELECT *, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS HUGEINT) AS off
          FROM parts JOIN books{k} USING (part))
    GROUP BY num, part
), means{k} AS (
    SELECT part, entry, list(total ORDER BY place) AS y FROM (
        SELECT part, entry, place, CAST(floor(CAST(sum(x[place]) AS DOUBLE) / count(*)) AS BIGINT) AS total
        FROM found{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS place) GROUP BY 1, 2, 3
    ) GROUP BY 1, 2
), books{k + 1} AS (
    SELECT part, entry, coalesce(m.y, b.y) AS y FROM books{k} b LEFT JOIN means{k} m USING (part, entry)
)"""


OP12_SQL = f"""
WITH {_WHOLE.format(multiple=16)}, numbered AS (
    SELECT row_number() OVER () AS num, vec_id, label, v, CAST(len(v) / 16 AS INTEGER) AS w FROM whole
), parts AS (
    SELECT num, part, v[part * w + 1 : part * w + w] AS x FROM numbered, (SELECT unnest(range(16)) AS part)
), books0 AS (
    SELECT part, entry, x AS y FROM parts
    JOIN (SELECT num, row_number() OVER (ORDER BY n.vec_id) - 1 AS entry FROM numbered n WHERE vec_id IS NOT NULL) USING (num)
    WHERE entry < 64
), {_round(0)}, {_round(1)}, {_round(2)}, coded AS (
    SELECT num, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM found2 GROUP BY num
), digest AS (
    SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN numbered USING (num), digest
"""

OP11_SQL = r"""
WITH RECURSIVE bits(n, c, k) AS (
    SELECT n, n, 0 FROM (SELECT unnest(range(256)) AS n)
    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
    FROM conversations
), kinds AS (
    SELECT * EXCLUDE (key), xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
    FROM keyed, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
    FROM damaged
), faults AS (
    SELECT *, left(role, 1) AS initial, CASE
        WHEN said = '' THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS broken
    FROM placed
), figures AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (broken) AS illegal, count(*) AS n
    FROM faults GROUP BY conv_id
), inserts AS (
    SELECT * FROM (VALUES ('E', 0, 'E', '', 0), ('S', 0, 'S', '', 0), ('U', 0, 'U', '', 0), ('A', 0, 'A', '', 0),
        ('E', 1, 'U', 'user:', 5), ('S', 1, 'U', 'user:', 5), ('A', 1, 'U', 'user:', 5), ('U', 1, 'A', 'assistant:', 5),
        ('E', 2, 'A', 'user:' || chr(10) || 'assistant:', 10), ('S', 2, 'A', 'user:' || chr(10) || 'assistant:', 10),
        ('A', 2, 'A', 'user:' || chr(10) || 'assistant:', 10), ('U', 2, 'U', 'assistant:' || chr(10) || 'user:', 10)) AS v(before, many, middle, lines, price)
), steps AS (
    SELECT * FROM (VALUES ('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('A', 'u', 'U'), ('U', 'a', 'A')) AS v(middle, letter, after)
), edits AS (
    SELECT conv_id, i, middle, 'D' AS edit, middle AS after, 2 AS price, NULL AS line FROM faults, (SELECT unnest(['E', 'S', 'U', 'A']) AS middle)
    UNION ALL SELECT conv_id, i, middle, 'K', after, 5 * CAST(fault = 'truncated' AS INTEGER), role || ':' || text
        FROM faults JOIN steps ON letter = initial WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT conv_id, i, middle, 'R', after, 1 + 5 * CAST(fault = 'truncated' AS INTEGER), CASE letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
        FROM faults, steps WHERE letter IN ('u', 'a') AND fault NOT IN ('blank', 'duplicate')
), macros AS (
    SELECT e.conv_id, e.i, n.before, e.after, n.price + e.price AS price, repeat('I', n.many) || e.edit AS code,
        concat_ws(chr(10), nullif(n.lines, ''), e.line) AS lines
    FROM edits e JOIN inserts n USING (middle)
), best(conv_id, i, state, cost, audit, lines) AS (
    SELECT conv_id, CAST(0 AS BIGINT), 'E', CAST(0 AS BIGINT), '', '' FROM figures
    UNION ALL
    SELECT conv_id, i, state, cost, audit, lines FROM (
        SELECT b.conv_id, m.i, m.after AS state, b.cost + m.price AS cost, b.audit || m.code AS audit,
            concat_ws(chr(10), nullif(b.lines, ''), nullif(m.lines, '')) AS lines,
            row_number() OVER (PARTITION BY b.conv_id, m.after ORDER BY b.cost + m.price, b.audit || m.code) AS place
        FROM best b JOIN macros m ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = b.i + 1 AND m.before = b.state
    ) WHERE place = 1
), ended AS (
    SELECT f.conv_id, b.cost + 5 * length(tail) AS cost, b.audit || tail AS audit, concat_ws(chr(10), nullif(b.lines, ''), nullif(more, '')) AS lines
    FROM best b JOIN figures f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.n
    JOIN (VALUES ('E', '', ''), ('A', '', ''), ('U', 'I', 'assistant:'), ('S', 'II', 'user:' || chr(10) || 'assistant:')) AS t(state, tail, more) USING (state)
    QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY b.cost + 5 * length(tail), b.audit || tail) = 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON c.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
