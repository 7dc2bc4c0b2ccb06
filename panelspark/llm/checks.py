"""DuckDB SQL for the operators that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Words, windows and lines are numbered and compared as rows; lines are counted as in the operator.
OP2 = rf"""
WITH docs AS (
    SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls
    FROM documents
), windows AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs WHERE len(ws) >= 3)
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), inside AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS r(k) GROUP BY doc_id
), full_lines AS (
    SELECT doc_id, source, l,
        trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS tidy
    FROM (SELECT doc_id, source, unnest(ls) AS l FROM docs)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
    SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM full_lines GROUP BY doc_id
), hosts AS (
    SELECT source, count(DISTINCT doc_id) AS n FROM full_lines GROUP BY source
), common AS (
    SELECT f.source, f.tidy, min(f.doc_id) AS first_doc
    FROM full_lines f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
    GROUP BY f.source, f.tidy, h.n
    HAVING count(DISTINCT f.doc_id) >= 5 AND (100 * count(DISTINCT f.doc_id) > 1 * h.n OR count(DISTINCT f.doc_id) > 1000)
), depleted AS (
    SELECT f.doc_id
    FROM full_lines f LEFT JOIN common c ON f.source IS NOT DISTINCT FROM c.source AND f.tidy = c.tidy
    GROUP BY f.doc_id
    HAVING 100 * sum(CASE WHEN c.first_doc IS NULL OR c.first_doc = f.doc_id THEN len(string_split(f.tidy, ' ')) ELSE 0 END)
        < 75 * sum(len(string_split(f.tidy, ' ')))
), based AS (
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words
    FROM docs d LEFT JOIN dup USING (doc_id) LEFT JOIN inside USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM based
)
SELECT *, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM depleted) AS kept FROM judged
"""


def _mixing(rounds: int = 4) -> str:
    """Water level from sorted caps, then the seeded order filled ``rounds`` times."""
    fills = ""
    for r in range(rounds):
        fills += f""", gap{r} AS (
    SELECT g.source, g.rest - sum(p.size * p.extra) AS gap
    FROM goals g JOIN part{r} p ON g.source IS NOT DISTINCT FROM p.source GROUP BY g.source, g.rest
), run{r} AS (
    SELECT p.doc_id, g.gap, sum(p.size) OVER (PARTITION BY p.source ORDER BY p.turn ROWS UNBOUNDED PRECEDING) AS upto
    FROM part{r} p JOIN gap{r} g ON g.source IS NOT DISTINCT FROM p.source
    WHERE p.extra = 0 AND p.size > 0 AND p.size <= g.gap
), part{r + 1} AS (
    SELECT p.doc_id, p.source, p.size, p.turn, CASE WHEN r.upto <= r.gap THEN 1 ELSE p.extra END AS extra
    FROM part{r} p LEFT JOIN run{r} r ON p.doc_id = r.doc_id
)"""
    return f"""
WITH sized AS (
    SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM sized GROUP BY source
), tried AS (
    SELECT a.source, a.source_size * 2 / a.weight AS ratio,
        ((SELECT sum(source_size) FROM sources) * 150 / 100 - coalesce(sum(b.source_size) FILTER (b.low), 0) * 2)
        / ((SELECT sum(weight) FROM sources) - coalesce(sum(b.weight) FILTER (b.low), 0)) AS level
    FROM sources a, LATERAL (
        SELECT source_size, weight, source_size * 2 / weight < a.source_size * 2 / a.weight AS low FROM sources
    ) b
    GROUP BY a.source, a.source_size, a.weight
), water AS (
    SELECT level FROM tried WHERE level <= ratio ORDER BY ratio LIMIT 1
), targets AS (
    SELECT *, least(CAST(source_size * 2 AS DOUBLE), coalesce((SELECT level FROM water), 1e300) * weight) AS target FROM sources
), goals AS (
    SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
        CAST(floor(target - CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END * source_size) AS BIGINT) AS rest
    FROM targets
), part0 AS (
    SELECT doc_id, source, size, md5('7:' || CAST(doc_id AS VARCHAR)) AS turn, 0 AS extra FROM sized
){fills}
SELECT p.doc_id, p.size, g.source_size, g.target, CAST(p.size * (g.whole + p.extra) AS BIGINT) AS taken
FROM part{rounds} p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source
"""


#: Keys of lines counted as rows; kept lines joined in their order.
OP7 = r"""
WITH split AS (
    SELECT doc_id, i, ls[i] AS l, len(ls) AS n
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split
), falls AS (
    SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT s.*, f.k IS NOT NULL AND f.stays <> s.doc_id AS lost FROM keyed s LEFT JOIN falls f USING (k)
)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: The template written out; digests over the turns in their order.
OP1 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), formatted AS (
    SELECT *, length('<|im_start|>' || regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10)) AS n FROM turns
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every matching document of every item is scored; the best ten are kept.
OP11 = f"""
WITH held AS (
    SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS t FROM documents) GROUP BY doc_id, t
), sizes AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id
), whole AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), weights AS (
    SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM held, whole GROUP BY t
), asked AS (
    SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t
), scored AS (
    SELECT item_id, h.doc_id,
        CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN held h USING (t) JOIN weights USING (t) JOIN sizes s ON s.doc_id = h.doc_id, whole
    GROUP BY item_id, h.doc_id
)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
WHERE place <= 10
"""

#: The failed letters of each document as a string; every step of every order looked up in it.
OP13 = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS least FROM docs GROUP BY text
), marks AS (
    SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 10 * length(d.text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
    FROM docs d JOIN firsts f ON d.text = f.text LEFT JOIN marks USING (doc_id)
), classes AS (
    SELECT part, good, toxic, fails, count(*) AS n FROM failed GROUP BY ALL
), letters(x) AS (
    VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, CAST(s AS INT) AS step, substring(filter_order, s, 1) AS letter, substring(filter_order, 1, s - 1) AS before
    FROM orders, range(1, 6) AS r(s)
), met AS (
    SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS now,
        length(translate(fails, before, '')) < length(fails) AS earlier, fails = letter AS alone
    FROM steps, classes
), summed AS (
    SELECT part, filter_order, step, letter,
        CAST(coalesce(sum(n) FILTER (NOT now AND NOT earlier), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (now AND NOT earlier), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (now AND earlier), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(n) FILTER (now AND NOT earlier AND good), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(n) FILTER (now AND NOT earlier AND toxic), 0) AS BIGINT) AS toxic_lost
    FROM met GROUP BY part, filter_order, step, letter
)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM summed
"""

SQL: dict[str, str] = {
    "op1_chat_format": OP1,
    "op2_quality_rules": OP2,
    "op3_mixing": _mixing(),
    "op7_line_dedup": OP7,
    "op11_lexical_search": OP11,
    "op13_filter_audit": OP13,
}
