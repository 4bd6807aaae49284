"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP1_SUBSTRING_DEDUP = r"""
WITH cut AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT row_id, doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT row_id, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM cut WHERE doc_id IS NOT NULL)
), firsts AS (
  SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win
), covered AS (
  SELECT DISTINCT row_id, i + j AS k
  FROM (SELECT row_id, i, unnest(range(0, 13)) AS j FROM windows JOIN firsts USING (win) WHERE first_doc < doc_id)
), each AS (
  SELECT row_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM cut
), kept AS (
  SELECT e.row_id, count(c.k) AS n_removed, string_agg(e.word, ' ' ORDER BY e.k) FILTER (WHERE c.k IS NULL) AS kept
  FROM each e LEFT JOIN covered c ON e.row_id = c.row_id AND e.k = c.k GROUP BY e.row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (row_id)
"""

OP3_QUOTE_LINKING = r"""
WITH RECURSIVE messages AS (
  SELECT row_number() OVER () AS m, conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS raw FROM conversations
), cut AS (
  SELECT m, unnest(raw) AS line, generate_subscripts(raw, 1) AS i FROM messages
), leveled AS (
  SELECT m, i, length(regexp_replace(regexp_extract(line, '^((?:[ \t]{0,3}>)*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^((?:[ \t]{0,3}>)*)[ \t]?', '') AS body FROM cut
), looked AS (
  SELECT *, coalesce(lead(level) OVER (PARTITION BY m ORDER BY i), 0) AS next_level FROM leveled
), kept AS (
  SELECT m, i, level, body FROM looked
  WHERE NOT (level = 0 AND next_level > 0 AND regexp_matches(body, '(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s?:\s*$'))
), marked AS (
  SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY m ORDER BY i) THEN 0 ELSE 1 END AS starts FROM kept
), numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY m ORDER BY i) AS passage, trim(regexp_replace(lower(body), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS plain FROM marked
), passages AS (
  SELECT m, passage, level, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS whole FROM numbered GROUP BY m, passage, level
), own AS (
  SELECT m, string_agg(body, chr(10) ORDER BY i) AS text FROM numbered WHERE level = 0 GROUP BY m
), said AS (
  SELECT m, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS said FROM own
  UNION ALL SELECT m, whole FROM passages WHERE level = 0
  UNION ALL SELECT m, plain FROM numbered WHERE level = 0
), originals AS (
  SELECT conv_id, said, min(turn) AS origin FROM said JOIN messages USING (m) WHERE said <> '' GROUP BY conv_id, said
), quoted AS (
  SELECT *, row_number() OVER (PARTITION BY m ORDER BY passage) AS place FROM passages WHERE level > 0 AND whole <> ''
), tried AS (
  SELECT m, place, level, whole, 0 AS line, whole AS said FROM quoted
  UNION ALL
  SELECT n.m, p.place, n.level, p.whole, 1, n.plain FROM numbered n JOIN quoted p ON p.m = n.m AND p.passage = n.passage WHERE n.plain <> ''
), met AS (
  SELECT t.place, t.level, t.whole, t.line, q.conv_id, q.turn, CASE WHEN o.origin < q.turn THEN o.origin END AS origin
  FROM tried t JOIN messages q ON q.m = t.m LEFT JOIN originals o ON o.conv_id = q.conv_id AND o.said = t.said
), linked AS (
  SELECT conv_id, turn, place, level, whole, coalesce(max(origin) FILTER (WHERE line = 0), max(origin) FILTER (WHERE line = 1)) AS origin FROM met GROUP BY conv_id, turn, place, level, whole
), links AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked, -(min(CASE WHEN origin IS NOT NULL THEN {'level': level, 'minus': -origin} END)).minus AS parent_turn FROM linked GROUP BY conv_id, turn
), up AS (
  SELECT conv_id, turn, parent_turn AS root_turn, CAST(1 AS BIGINT) AS depth FROM links WHERE parent_turn IS NOT NULL
  UNION ALL
  SELECT up.conv_id, up.turn, l.parent_turn, up.depth + 1 FROM up JOIN links l ON l.conv_id = up.conv_id AND l.turn = up.root_turn WHERE l.parent_turn IS NOT NULL
), roots AS (
  SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM up GROUP BY conv_id, turn
)
SELECT q.conv_id, coalesce(r.root_turn, q.turn) AS root_turn, coalesce(r.depth, 0) AS depth, q.turn, l.parent_turn, q.role, trim(coalesce(own.text, ''), E' \t\n\r\x0b\x0c') AS text,
  coalesce(l.n_quotes, 0) AS n_quotes, coalesce(l.n_linked, 0) AS n_linked
FROM messages q LEFT JOIN own ON own.m = q.m
LEFT JOIN links l ON l.conv_id IS NOT DISTINCT FROM q.conv_id AND l.turn IS NOT DISTINCT FROM q.turn
LEFT JOIN roots r ON r.conv_id = q.conv_id AND r.turn = q.turn
"""

OP9_NGRAM_JOIN = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM cut WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM cut
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), component AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
), degree AS (
  SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM cut LEFT JOIN sizes USING (doc_id) JOIN component USING (doc_id) LEFT JOIN degree USING (doc_id)
"""

OP10_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM sources
), summed AS (
  SELECT *, row_number() OVER w AS place,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS room,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM ranked WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
), first AS (
  SELECT place, room, open_weight FROM summed WHERE weight * room / open_weight <= cap ORDER BY place LIMIT 1
), targets AS (
  SELECT s.source, s.source_size, CASE WHEN s.place >= f.place THEN s.weight * f.room / f.open_weight ELSE s.cap END AS target
  FROM summed s LEFT JOIN first f ON true
), goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS missing,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN goals t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * start + size <= 2 * missing THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""

OP11_PREFIX_TRIE = r"""
WITH ids AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
), said AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(CAST(strlen(r) AS VARCHAR) || ':' || r || t)) - 1 AS pos, r, t FROM said
), rebuilt AS (
  SELECT i.c, 0 AS own, pos, r, t FROM ids i JOIN turns ON turns.c = i.base WHERE pos < h
  UNION ALL SELECT i.c, 1, pos, r, t FROM ids i JOIN turns ON turns.c = i.c WHERE pos >= h
), prefixes AS (
  SELECT c, row_number() OVER w AS d, list({'r': r, 't': t}) OVER w AS key, strlen(t) AS bytes FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, pos)
), lengths AS (
  SELECT c, count(d) AS len FROM ids LEFT JOIN prefixes USING (c) GROUP BY c
), members AS (
  SELECT c, d, key, bytes FROM prefixes UNION ALL SELECT c, 0, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]), 0 FROM ids
), nodes AS (
  SELECT d, key, min(c) AS rep, count(*) AS n, max(bytes) AS bytes, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = len) AS ends FROM members JOIN lengths USING (c) GROUP BY d, key
), places AS (
  SELECT c, m.d, rep FROM members m JOIN nodes n ON m.d = n.d AND m.key = n.key
), parents AS (
  SELECT n.rep, n.d, p.rep AS parent FROM nodes n LEFT JOIN places p ON p.c = n.rep AND p.d = n.d - 1
), children AS (
  SELECT parent AS rep, d - 1 AS d, count(*) AS n_children FROM parents WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT p.rep, p.d, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (WHERE c.rep IS NULL) AS leaves
  FROM nodes n JOIN places p ON p.c = n.rep AND p.d <= n.d LEFT JOIN children c ON c.rep = n.rep AND c.d = n.d GROUP BY p.rep, p.d
)
SELECT rep AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes JOIN parents USING (rep, d) JOIN below USING (rep, d) LEFT JOIN children USING (rep, d)
"""

OP12_SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS m, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), counted AS (
  SELECT m, lang, source, term, count(*) AS n FROM (SELECT m, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM counted GROUP BY lang, term HAVING count(*) >= 30
), grouped AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(sum(n), 0) AS c FROM grouped g JOIN kept k ON k.lang = g.lang LEFT JOIN counted d ON d.lang = g.lang AND d.source = g.source AND d.term = k.term GROUP BY ALL
), own AS (
  SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS q FROM (SELECT lang, term, sum(c) AS c FROM dense GROUP BY ALL) WINDOW w AS (PARTITION BY lang)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN own x ON x.lang = a.lang AND x.source = a.source LEFT JOIN own y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, p - q FROM own JOIN whole USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM found
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""

OP13_WARC = r"""
WITH numbered AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url FROM pages
), ranked AS (
  SELECT *, row_number() OVER w AS place, first(page_id) OVER w AS first_id FROM numbered WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SUBSTRING_DEDUP, "op3_quote_linking": OP3_QUOTE_LINKING, "op9_ngram_join": OP9_NGRAM_JOIN, "op10_mixing": OP10_MIXING, "op11_prefix_trie": OP11_PREFIX_TRIE,
        "op12_source_divergence": OP12_SOURCE_DIVERGENCE, "op13_warc": OP13_WARC,
    }
