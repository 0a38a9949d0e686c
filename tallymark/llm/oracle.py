"""DuckDB SQL twins of the queries that SQL can express.

No twin: op4 and op5 (spans of structure and of learned patterns), op6 (CRC-32 is no DuckDB function), op7 and op9 (byte
pair merging), op10 (XXH64). Tests hold these against brute force.
"""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source, {_WORDS} AS w FROM documents),
n AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM d),
l AS MATERIALIZED (SELECT r, doc_id, text, source, i, s[i] AS line FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS s FROM d)) WHERE trim(s[i], {_BLANKS}) <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win), (SELECT unnest(range(0, 8)) AS k) WHERE c > 1 GROUP BY r),
k AS MATERIALIZED (SELECT r, coalesce(source, '') AS host, text, i, md5(coalesce(source, '') || chr(31) || lower(trim(line, {_BLANKS}))) AS h, len(string_split_regex(trim(line, {_BLANKS}), '[\\x20\\x09-\\x0D]+')) AS lw FROM l),
held AS MATERIALIZED (SELECT DISTINCT h, md5(host || chr(31) || md5(text)) AS page, lw FROM k),
hit AS MATERIALIZED (SELECT * FROM held WHERE h IN (SELECT h FROM held GROUP BY h HAVING count(*) > 20)),
pg AS (SELECT page, least, CASE WHEN total - shared <= 0.1111111111111111::double * total THEN 'copy ' || least ELSE 'page ' || page END AS grp FROM (SELECT page, sum(lw) AS total FROM held GROUP BY page) JOIN (SELECT page, min(h) AS least, sum(lw) AS shared FROM hit GROUP BY page) USING (page)),
freq AS (SELECT h FROM hit JOIN pg USING (page) GROUP BY h HAVING count(DISTINCT grp) > 20),
gone AS (SELECT r, count(*) AS n_removed_lines, sum(lw) AS lost FROM k WHERE h IN (SELECT h FROM freq) GROUP BY r),
j AS (SELECT n.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_lines, 0) AS n_removed_lines, n_words - coalesce(lost, 0) AS left_words FROM n LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols, cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_removed_lines > 0 AND (left_words < 20 OR left_words < 0.3 * n_words)) AS kept, cast(n_removed_lines AS bigint) AS n_removed_lines, cast(left_words AS bigint) AS left_words FROM b"""

_DIGEST = "cast('0x' || substr(md5({0}), 1, 15) AS bigint)"
_PIECES = "regexp_extract_all({0}, '[^\\n]{{1,200}}')"


def _digests(kind: str, column: str) -> str:
    """The digests of column's paragraphs with their numbers mixed in."""
    return f"""{kind}h AS MATERIALIZED (SELECT r, h, count(*) AS c FROM (SELECT r, {_DIGEST.format('p')} AS h FROM (SELECT r, unnest({_PIECES.format(column)}) AS p FROM e)) GROUP BY r, h),
{kind}d AS MATERIALIZED (SELECT r, (h + (c - 1) * 1000000007) & 1152921504606846975 AS k FROM {kind}h)"""


def _sketch(kind: str, column: str) -> str:
    """Fingerprint text of column: 24 cells of count, digest and check sum."""
    return f"""{_digests(kind, column)},
{kind}c AS MATERIALIZED (SELECT r, t * 8 + ((k >> (20 * t)) & 7) AS cell, count(*) AS n, bit_xor(k) AS k, bit_xor(k % 4294967291) AS x FROM {kind}d, (SELECT unnest([0, 1, 2]) AS t) GROUP BY r, cell),
{kind}f AS MATERIALIZED (SELECT e.r, string_agg(CASE WHEN n IS NULL THEN repeat('0', 27) ELSE printf('%04x', n) || printf('%015x', k) || printf('%08x', x) END, '' ORDER BY g.cell) AS f FROM e CROSS JOIN (SELECT unnest(range(0, 24)) AS cell) g LEFT JOIN {kind}c ON {kind}c.r = e.r AND {kind}c.cell = g.cell GROUP BY e.r)"""


def _near(kind: str) -> str:
    """Share of digests in common between a text and the other version."""
    return f"""{kind}n AS MATERIALIZED (SELECT e.r, CASE WHEN count(u.k) = 0 THEN 1.0 ELSE cast(count(u.k) FILTER (u.m = 2) AS double) / count(u.k) END AS near FROM e LEFT JOIN
(SELECT r, k, count(*) AS m FROM (SELECT r, k FROM ad UNION ALL SELECT r, k FROM {kind}d) GROUP BY r, k) u ON u.r = e.r GROUP BY e.r)"""


OP2 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(text)) AS r, doc_id, text, times FROM (SELECT doc_id, coalesce(text, '') AS text, count(*) AS times FROM documents GROUP BY 1, 2)),
e AS MATERIALIZED (SELECT a.r, a.doc_id, a.times, a.text, b.text AS nxt, substr(a.text, 1, cast(length(a.text) - length(a.text) // 3 AS bigint)) || substr(b.text, 1, cast(length(a.text) // 3 AS bigint)) AS edited FROM d a JOIN d b ON b.r = CASE WHEN a.r = (SELECT max(r) FROM d) THEN 1 ELSE a.r + 1 END),
{_sketch('a', 'text')},
{_sketch('b', 'edited')},
{_digests('c', 'nxt')},
{_near('b')},
{_near('c')}
SELECT doc_id, cast(length(text) AS bigint) AS n_chars, sha256(edited) AS edited_sha256, af.f AS fingerprint, bf.f AS edited_fingerprint, bn.near AS near_edited, cn.near AS near_next
FROM (SELECT *, unnest(range(times)) AS copy FROM e) e JOIN af USING (r) JOIN bf USING (r) JOIN bn USING (r) JOIN cn USING (r)"""

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, i, s[i] AS line, translate(trim(s[i], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS s FROM d))),
f AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, f.k IS NOT NULL AND doc_id <> top AS lost FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256 FROM j GROUP BY r, doc_id"""

OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY 1, 2, 3),
t AS (SELECT lang, cast(sum(c) AS bigint) AS n FROM f WHERE k = 1 GROUP BY 1),
q AS MATERIALIZED (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS s FROM f WHERE k >= 2 AND c >= 10),
u AS (SELECT lang, k, phrase, a, cut, array_to_string(list_slice(s, 1, cut), ' ') AS lp, array_to_string(list_slice(s, cut + 1, k), ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM q)),
v AS (SELECT u.lang, u.k, u.phrase, a, cut, x.c AS l, y.c AS r, cast(1000000::hugeint * a * a // (x.c::hugeint * y.c) AS bigint) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = lp AND x.k = cut JOIN f y ON y.lang = u.lang AND y.phrase = rp AND y.k = u.k - cut),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM v) WHERE o = 1),
e AS (SELECT lang, part, max(a) AS m FROM (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS part FROM q WHERE k = 3) GROUP BY 1, 2)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN t USING (lang)
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = b.lang AND e.part = b.phrase AND 100 * m >= 50 * a)) WHERE rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1, "op2_fingerprints": OP2, "op3_line_dedup": OP3, "op11_collocations": OP11}
