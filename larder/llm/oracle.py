"""The results of the text operators in DuckDB's SQL, where SQL can state them."""

from __future__ import annotations

OP1 = r"""
WITH measured AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT
      + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM measured GROUP BY source
), weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    (sum(source_size) OVER ())::DOUBLE AS total
  FROM totals
), level AS (
  -- Sources fill up in the order of cap / w. The level lies at or below that of the first source
  -- which, with all before it full and the others level with it, holds the total.
  SELECT arg_min((total - full_cap) / open_w, own) AS level FROM (
    SELECT a.source, a.total, a.cap / a.w AS own,
      coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0) AS full_cap,
      sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS open_w
    FROM weighed a, weighed b GROUP BY ALL
  ) WHERE full_cap + own * open_w >= total
), targets AS (
  SELECT source, source_size,
    least(cap, coalesce((SELECT level FROM level) * w, cap)) AS target
  FROM weighed
), whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM targets
), ranked AS (
  SELECT m.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS missing,
    u / (1 - u) / nullif(size, 0) AS rank,
    CASE WHEN size > 0 THEN sum(size) OVER (
      PARTITION BY m.source, size > 0 ORDER BY u / (1 - u) / nullif(size, 0)) END AS upto
  FROM measured m JOIN whole t ON m.source IS NOT DISTINCT FROM t.source
), rest AS (
  SELECT *, missing - coalesce(
    max(upto) FILTER (upto <= missing) OVER (PARTITION BY source), 0) AS left_over
  FROM ranked
), fitted AS (
  SELECT *, size > 0 AND upto > missing AND abs(size - left_over) < left_over AS fits FROM rest
), best AS (
  SELECT *, min(abs(size - left_over)) FILTER (fits) OVER (PARTITION BY source) AS nearest FROM fitted
), last AS (
  SELECT *, min(rank) FILTER (fits AND abs(size - left_over) = nearest)
    OVER (PARTITION BY source) AS chosen FROM best
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN size * (whole + CASE
    WHEN upto <= missing OR coalesce(rank = chosen, false) THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS taken
FROM last
"""

OP3 = r"""
WITH folded AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), sought AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n,
    array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS phrase
  FROM items, LATERAL (SELECT unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i)
  WHERE len(words) > 0
), lengths AS (SELECT DISTINCT n FROM sought),
windows AS (
  SELECT row, n, i, array_to_string(words[i : i + n - 1], ' ') AS phrase
  FROM folded, lengths, LATERAL (SELECT unnest(generate_series(1, len(words) - n + 1)) AS i)
), found AS (
  SELECT row, i, w.n, item_id FROM windows w JOIN sought s ON w.phrase = s.phrase AND w.n = s.n
), hit AS (
  SELECT row, count(DISTINCT j)::BIGINT AS n_hit
  FROM (SELECT row, unnest(generate_series(i, i + n - 1)) AS j FROM found) GROUP BY row
), named AS (
  SELECT row, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row, item_id FROM found) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

OP9 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents
), raw AS (
  SELECT row, doc_id, unnest(parts) AS line, unnest(generate_series(0, len(parts) - 1)) AS n FROM docs
), solid AS (
  SELECT row, doc_id, n, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY n) AS pos,
    (sum(w) OVER (PARTITION BY row ORDER BY n))::BIGINT AS upto
  FROM solid
), whole AS (
  SELECT row, list(line ORDER BY pos) AS lines, list(upto ORDER BY pos) AS ends FROM placed GROUP BY row
), windows AS (
  -- The fewest lines from here on, and up to here, with 50 words.
  SELECT row, doc_id, pos AS low, len(list_filter(ends, lambda x: x < upto - w + 50)) + 1 AS high, lines
  FROM placed p JOIN whole USING (row)
  UNION
  SELECT row, doc_id, len(list_filter(list_prepend(0::BIGINT, ends), lambda x: x <= upto - 50)), pos, lines
  FROM placed p JOIN whole USING (row) WHERE upto >= 50
), fitting AS (
  SELECT row, low, high, lines[low : high] AS content,
    {'no': doc_id IS NULL, 'd': doc_id, 'r': row, 'p': low} AS place
  FROM windows WHERE high <= len(lines)
), first AS (
  SELECT content, min(place) AS place FROM fitting GROUP BY content HAVING count(*) > 1
), spans AS (
  SELECT row, low, high FROM fitting w JOIN first f USING (content) WHERE w.place <> f.place
), gone AS (
  SELECT DISTINCT row, unnest(generate_series(low, high)) AS pos FROM spans
), runs AS (
  SELECT row, pos - row_number() OVER (PARTITION BY row ORDER BY pos) AS run, n, w
  FROM gone JOIN placed USING (row, pos)
), merged AS (
  SELECT row, min(n) AS a, max(n) AS b, sum(w) AS w FROM runs GROUP BY row, run
), cut AS (
  SELECT row, string_agg(a || '-' || b, ',' ORDER BY a) AS lines_removed, sum(w)::BIGINT AS words_removed
  FROM merged GROUP BY row
)
SELECT doc_id, len(parts)::BIGINT AS n_lines, coalesce(lines_removed, '') AS lines_removed,
  coalesce(words_removed, 0)::BIGINT AS words_removed
FROM docs LEFT JOIN cut USING (row)
"""


def _add(string: str, cost: str, edits: str) -> str:
    """A string of a cost in nine digits and edits, with more of both."""
    digits = f"lpad(((left({string}, 9))::BIGINT + {cost})::VARCHAR, 9, '0')"
    return f"({digits} || substr({string}, 10) || {edits})"


OP11 = rf"""
WITH RECURSIVE polynomial AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc
  FROM (SELECT unnest(generate_series(0::BIGINT, 255)) AS n)
), rows AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ascii(x)::BIGINT)),
      lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, polynomial
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END
      AS text,
    unnest(generate_series(1, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM rows WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
    substr(role, 1, 1) AS initial
  FROM damaged
), faults AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'),
      FALSE) AS illegal
  FROM placed
), dp AS (
  -- The least of cost and edits up to a row, as one string that orders like them, by what the
  -- repaired rows so far end in: nothing, system, user, assistant.
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a
  FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, i,
    {_add("n", "3", "'D'")},
    least({_add("s", "3", "'D'")}, CASE WHEN stays AND initial = 's' THEN {_add("n", "more", "'K'")} END),
    least({_add("u", "3", "'D'")},
      CASE WHEN NOT stays THEN NULL WHEN initial = 'u' THEN {_add("least(n, s, a)", "more", "'K'")}
        ELSE {_add("least(n, s, a)", "2 + more", "'R'")} END),
    least({_add("a", "3", "'D'")},
      CASE WHEN NOT stays THEN NULL WHEN initial = 'a' THEN {_add("u", "more", "'K'")}
        ELSE {_add("u", "2 + more", "'R'")} END)
  FROM (
    SELECT conv_id, i, n, s, u, least(a, {_add("u", "2", "'I'")}) AS a, initial, stays, more FROM (
      SELECT dp.conv_id, f.i, n, s, least(u, {_add("least(n, s, a)", "2", "'I'")}) AS u, a, initial,
        fault IN ('', 'truncated') AS stays, (fault = 'truncated')::INT AS more
      FROM dp JOIN faults f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i + 1))
), last AS (
  SELECT conv_id, max(i) AS i FROM faults GROUP BY conv_id
), audits AS (
  SELECT conv_id, least(n, a, {_add("u", "2", "'I'")}, {_add("s", "4", "'II'")}) AS best
  FROM dp WHERE (conv_id, i) IN (SELECT (conv_id, i) FROM last)
    OR conv_id IS NULL AND i = (SELECT i FROM last WHERE conv_id IS NULL)
), edits AS (
  SELECT conv_id, substr(best, 10) AS audit, unnest(generate_series(1, len(best) - 9)) AS spot FROM audits
), steps AS (
  SELECT e.conv_id, spot, substr(audit, spot, 1) AS edit,
    (len(replace(substr(audit, 1, spot), 'I', '')))::BIGINT AS i,
    len(replace(substr(audit, 1, spot), 'D', '')) AS made
  FROM edits e
), outcome AS (
  SELECT t.conv_id, spot, edit, made, role, text,
    bool_or(edit = 'K' AND made = 1 AND initial = 's') OVER (PARTITION BY t.conv_id) AS system
  FROM steps t LEFT JOIN faults f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i
    AND edit <> 'I'
  WHERE edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role
      WHEN (made - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS text
  FROM outcome GROUP BY conv_id
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0)::BIGINT AS cost,
  coalesce(substr(best, 10), '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN audits a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""

OP13 = r"""
WITH RECURSIVE folded AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT row, doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
    generate_series(1, greatest(len(words) - 2, 1)), lambda i: array_to_string(words[i : i + 2], ' ')))) END
    AS shingles
  FROM folded
), nodes AS (  -- equal sets are one node
  SELECT row_number() OVER () AS node, shingles, min(doc_id) AS least
  FROM sets WHERE len(shingles) > 0 GROUP BY shingles
), parts AS (
  SELECT node, len(shingles) AS n, unnest(shingles) AS shingle FROM nodes
), common AS (
  SELECT a.node AS a, b.node AS b, any_value(a.n + b.n) AS total, count(*) AS shared
  FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.node < b.node
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * shared >= 85 * (total - shared)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a
), components AS (
  SELECT a AS node, min(least) AS component_id FROM reached JOIN nodes ON b = node GROUP BY a
)
SELECT doc_id, len(s.shingles)::BIGINT AS n_shingles,
  CASE WHEN len(s.shingles) = 0 THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN len(s.shingles) = 0 THEN doc_id ELSE component_id END AS kept
FROM sets s LEFT JOIN nodes n ON s.shingles = n.shingles LEFT JOIN components c ON n.node = c.node
"""

STATEMENTS = {
    "op1_pareto_mix": OP1,
    "op3_decontaminate": OP3,
    "op9_repeated_lines": OP9,
    "op11_repaired_conversations": OP11,
    "op13_shingle_components": OP13,
}
