"""The operators' queries as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from mailscreen.llm import license_scan, license_templates

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = r"[^\x20\x09-\x0D]+"
# maximal runs of digits, a to z and characters beyond ASCII
SPAN_WORDS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

# runs of lines with a word, at every line the shortest that end and start there
OP1 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents),
raw_lines AS (
  SELECT r, doc_id, p, l, len(regexp_extract_all(l, '{BLANK}')) AS w
  FROM (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM docs),
       unnest(range(1, len(ls) + 1)) AS t(p), unnest([ls[p]]) AS u(l)),
lines AS (
  SELECT *, row_number() OVER d - 1 AS i, sum(w) OVER d AS upto
  FROM raw_lines WHERE w > 0 WINDOW d AS (PARTITION BY r ORDER BY p)),
bounds AS (
  SELECT max(a.i) AS first, b.i AS last, b.r FROM lines a JOIN lines b
    ON a.r = b.r AND a.i <= b.i AND b.upto - a.upto + a.w >= 50 GROUP BY b.r, b.i
  UNION
  SELECT a.i, min(b.i), a.r FROM lines a JOIN lines b
    ON a.r = b.r AND a.i <= b.i AND b.upto - a.upto + a.w >= 50 GROUP BY a.r, a.i),
windows AS (
  SELECT b.r, l.doc_id, first, last - first + 1 AS n,
         string_agg(l.l, chr(10) ORDER BY l.i) AS body
  FROM bounds b JOIN lines l ON l.r = b.r AND l.i BETWEEN first AND last
  GROUP BY b.r, l.doc_id, first, last),
origins AS (
  SELECT body, min((doc_id, first)) AS origin FROM windows GROUP BY body),
cut AS (
  SELECT DISTINCT r, first, n FROM windows JOIN origins USING (body)
  WHERE doc_id <> origin[1] OR first >= origin[2] + n),
cut_lines AS (
  SELECT DISTINCT r, i FROM cut, unnest(range(first, first + n)) AS t(i)),
cut_places AS (
  SELECT DISTINCT c.r, q AS p FROM cut c
  JOIN lines a ON a.r = c.r AND a.i = first JOIN lines b ON b.r = c.r AND b.i = first + n - 1,
  unnest(range(a.p, b.p + 1)) AS t(q)),
kept AS (
  SELECT r, string_agg(l, chr(10) ORDER BY p) AS body
  FROM raw_lines ANTI JOIN cut_places USING (r, p) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM cut_lines GROUP BY r)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(body, '') END AS text,
       coalesce(n, 0)::BIGINT AS n_deleted,
       CASE WHEN text IS NULL THEN NULL ELSE length(coalesce(body, '')) END AS n_chars
FROM docs LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""

OP3 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         {SPAN_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         {SPAN_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM item_windows),
hits AS (
  SELECT DISTINCT r, i, n, win FROM (
    SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM docs, lengths, unnest(range(1, len(w) - n + 2)) AS t(i))
  WHERE win IN (SELECT win FROM item_windows)),
hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hits JOIN item_windows USING (win)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

# The level at which no target exceeds its cap: sources sorted by cap / weight, the first k
# held at their caps, for the smallest k at which the rest stay below theirs.
OP9 = rf"""
WITH docs AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '{BLANK}'))::BIGINT AS size
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, 3 * source_size AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sources),
sorted AS (
  SELECT *, row_number() OVER o AS k,
         sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / weight, source)),
found AS (
  SELECT coalesce(min_by((total - held)::DOUBLE / free::DOUBLE, k), 0) AS level
  FROM sorted WHERE cap >= (total - held)::DOUBLE / free::DOUBLE * weight),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target
  FROM weighted, found),
rated AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(sha256('mix ' || coalesce(doc_id::VARCHAR,
            'text ' || sha256(coalesce(text, '')))), 1, 13))::BIGINT / 16.0 ** 13 AS draw
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM rated)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM copied
"""


def template_regex(nodes: tuple) -> str:
    """A template as a regular expression over words that each have a blank behind them."""
    out = ""
    for node in nodes:
        if isinstance(node, license_scan.Word):
            out += f"{node.word.decode()} "
        elif isinstance(node, license_scan.Optional):
            out += f"(?:{template_regex(node.inner)})?"
        elif isinstance(node, license_scan.OneOf):
            out += f"(?:{'|'.join(map(template_regex, node.wordings))})"
        else:
            out += f"(?:[^ ]+ ){{{node.least},{node.most}}}"
    return out


def _op11() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT '{label}' AS label, {p.split()} AS phrase" for label, p in license_templates.PHRASES
    )
    trees = [
        (label, license_scan.parse(t)) for label, ts in license_templates.TEMPLATES for t in ts
    ]
    templates = ", ".join(
        f"('{label}', ' {template_regex(tree)}', {license_scan.mandatory(tree)})"
        for label, tree in trees
    )
    # both sides of a comparison use one spelling, but for phrases
    spelt = "w"
    for other, word in license_templates.SPELLINGS.items():
        spelt = f"list_transform({spelt}, lambda x: CASE x WHEN '{other}' THEN '{word}' ELSE x END)"
        templates = templates.replace(f" {other} ", f" {word} ")
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         {SPAN_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w
  FROM documents),
spelt AS (SELECT r, ' ' || array_to_string({spelt}, ' ') || ' ' AS line FROM docs),
phrases AS ({phrases}),
templates AS (SELECT * FROM (VALUES {templates}) AS t(label, pattern, words)),
places AS (
  SELECT r, label, len(phrase) AS words, i - 1 AS place
  FROM docs, phrases, unnest(range(1, len(w) - len(phrase) + 2)) AS t(i)
  WHERE w[i:i + len(phrase) - 1] = phrase),
found AS (
  SELECT r, label, words FROM places UNION ALL
  SELECT r, label, words FROM spelt, templates WHERE regexp_matches(line, pattern)),
base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(words)::DOUBLE AS most FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(most / (most + 4), 0) AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN every USING (r)
"""


OP11 = _op11()

# CRC-32 of ASCII text, bit by bit
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(
      list_prepend(xor(c, b), range(8)::BIGINT[]),
      lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"""

# The cheapest way to every state, row by row: 0 nothing written, 1 after s, 2 after u, 3 after a.
OP12 = rf"""
WITH RECURSIVE
given AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn,
         coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT c, conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(i)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, encode(role), sha256(text)) AS pos,
         left(role, 1) AS initial
  FROM damaged),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         lag(initial) OVER (PARTITION BY c ORDER BY pos) || initial AS pair
  FROM placed),
faulty AS (
  SELECT *, NOT blank AND again AS duplicate, blank OR again AS must_go,
         NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM seen),
inserts AS (SELECT * FROM (VALUES
  (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3),
  (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)) AS t(p, n, mid)),
moves AS (SELECT * FROM (VALUES
  (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a'),
  (0, 0, 'd'), (1, 1, 'd'), (2, 2, 'd'), (3, 3, 'd')) AS t(mid, q, goal)),
ways AS (
  SELECT c, 0::BIGINT AS pos, 0 AS state, {{'cost': 0, 'audit': ''}} AS best
  FROM (SELECT DISTINCT c FROM given)
  UNION ALL
  SELECT w.c, w.pos + 1, m.q, min({{
    'cost': w.best.cost + 2 * i.n + CASE WHEN goal = 'd' THEN 3 ELSE cut::INT + CASE WHEN goal = initial THEN 0 ELSE 2 END END,
    'audit': w.best.audit || repeat('I', i.n) || CASE WHEN goal = 'd' THEN 'D' WHEN goal = initial THEN 'K' ELSE 'R' END}})
  FROM ways w JOIN faulty r ON r.c = w.c AND r.pos = w.pos + 1
  JOIN inserts i ON i.p = w.state JOIN moves m ON m.mid = i.mid
  WHERE goal = 'd' OR (NOT must_go AND (goal = initial OR goal <> 's'))
  GROUP BY w.c, w.pos + 1, m.q),
lengths AS (SELECT c, max(pos) AS n FROM faulty GROUP BY c),
ends AS (
  SELECT w.c, min({{'cost': best.cost + 2 * e.n, 'audit': best.audit || repeat('I', e.n)}}) AS best
  FROM ways w LEFT JOIN lengths l ON l.c = w.c
  JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) AS e(state, n) ON e.state = w.state
  WHERE w.pos = coalesce(l.n, 0) GROUP BY w.c),
edits AS (
  SELECT c, k, best.audit[k] AS edit FROM ends, unnest(range(1, length(best.audit) + 1)) AS t(k)),
aligned AS (
  SELECT c, k, edit,
         sum((edit <> 'I')::INT) OVER (PARTITION BY c ORDER BY k) AS pos,
         sum((edit <> 'D')::INT) OVER (PARTITION BY c ORDER BY k) AS line
  FROM edits),
lines AS (
  SELECT a.c, a.k, edit, line, initial, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text
  FROM aligned a LEFT JOIN faulty f ON f.c = a.c AND f.pos = a.pos WHERE edit <> 'D'),
opened AS (
  SELECT c, max((line = 1 AND edit = 'K' AND initial = 's')::INT) AS shift FROM lines GROUP BY c),
repaired AS (
  SELECT c, sha256(string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (line - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || text, chr(10) ORDER BY k)) AS digest
  FROM lines JOIN opened USING (c) GROUP BY c),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (cut) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM given) LEFT JOIN ends USING (c)
LEFT JOIN counts USING (c) LEFT JOIN repaired USING (c)
"""

# nodes are prefixes of the rebuilt lists; a subtree is every prefix that goes on from its top
OP13 = rf"""
WITH lists AS (
  SELECT conv_id,
         list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
              ORDER BY turn NULLS FIRST, encode(coalesce(role, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
lengths AS (
  SELECT *, ({CRC32.format("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM lists),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM lengths a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 100),
members AS (
  SELECT conv_id, len(turns) AS n, d, sha256(turns[1:d]::VARCHAR) AS node,
         CASE WHEN d > 0 THEN sha256(turns[1:d - 1]::VARCHAR) END AS above,
         CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS size,
         list_transform(range(d + 1), lambda k: sha256(turns[1:k]::VARCHAR)) AS tops
  FROM rebuilt, unnest(range(len(turns) + 1)) AS t(d)),
nodes AS (
  SELECT node, d, any_value(above) AS above, any_value(size) AS size, any_value(tops) AS tops,
         min(conv_id) AS first, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
  FROM members GROUP BY node, d),
families AS (
  SELECT above AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
sized AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN families USING (node, d)),
sums AS (
  SELECT top AS node, k AS d, count(*) FILTER (n_children = 0) AS n_leaves,
         sum((n_convs - 1) * size) AS saved
  FROM (SELECT n_children, n_convs, size, unnest(tops) AS top, unnest(range(len(tops))) AS k FROM sized)
  GROUP BY top, k)
SELECT s.first AS conv_id, s.d AS depth, p.first AS parent_conv_id, s.n_convs,
       s.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(s.ends) AS ends_sha256
FROM sized s JOIN sums USING (node, d) LEFT JOIN nodes p ON p.node = s.above AND p.d = s.d - 1
"""

SQL = {
    "op1_line_dedup": OP1,
    "op3_decontaminate": OP3,
    "op9_mix": OP9,
    "op11_licenses": OP11,
    "op12_turn_repair": OP12,
    "op13_prefix_trie": OP13,
}
