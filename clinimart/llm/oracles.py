"""The same results in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS queue
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (sum(sum(size)) OVER ())::BIGINT AS total,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS most,
         (total - coalesce(sum(3 * source_size) OVER w1, 0)) / (sum(weight) OVER w2) AS level
  FROM sources
  WINDOW w1 AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w2 AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size, total,
         CASE WHEN level * weight >= most THEN most::DOUBLE
              ELSE (max(CASE WHEN level * weight < most THEN level END) OVER ()) * weight END AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.source, s.size, s.queue, t.source_size, t.total, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.queue, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         row_number() OVER () AS id
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (copy * source_size + before + size)::BIGINT / target AS finish
  FROM placed, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0),
run AS (
  SELECT id, size, total, sum(size) OVER (ORDER BY finish, source NULLS FIRST, queue, doc_id NULLS FIRST, copy
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM copies),
taken AS (
  SELECT id, sum(greatest(0, least(size, total - through + size)))::BIGINT AS taken FROM run GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed LEFT JOIN taken USING (id)
"""

LINE_DEDUP = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT id, doc_id, pos, lines[pos] AS line,
         {LOWERED.format(r"trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM docs, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS pos)),
owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key),
kept AS (
  SELECT id, pos, line, coalesce(l.doc_id > o.owner OR (l.doc_id IS NULL AND o.owner IS NOT NULL), false) AS dropped
  FROM lines l LEFT JOIN owners o ON l.key = o.key)
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM kept JOIN docs d USING (id) GROUP BY d.id, d.doc_id
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id,
         {_WORDS.format(LOWERED.format("coalesce(text, '')"))} AS words FROM documents),
items AS (
  SELECT item_id, {_WORDS.format(LOWERED.format("coalesce(text, '')"))} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS k, array_to_string(words[pos:pos + least(13, len(words)) - 1], ' ') AS win
  FROM items, LATERAL (SELECT unnest(range(1, len(words) - least(13, len(words)) + 2)) AS pos) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT id, pos, k, array_to_string(words[pos:pos + k - 1], ' ') AS win
  FROM docs, sizes, LATERAL (SELECT unnest(range(1, len(words) - k + 2)) AS pos)),
found AS (SELECT p.id, p.pos, p.k, w.item_id FROM places p JOIN windows w ON p.k = w.k AND p.win = w.win),
hits AS (
  SELECT id, count(DISTINCT pos + i)::BIGINT AS n_hit FROM found, LATERAL (SELECT unnest(range(0, k)) AS i) GROUP BY id),
owners AS (
  SELECT id, count(DISTINCT item_id)::BIGINT AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hits USING (id) LEFT JOIN owners USING (id)
"""

FILTER_AUDIT = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failed AS (
  SELECT d.doc_id, part,
         (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN min(d.doc_id) OVER (PARTITION BY text) < d.doc_id THEN 16 ELSE 0 END) AS mask,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM docs d LEFT JOIN (
    SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l
  ON d.doc_id = l.doc_id),
combos AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum(list_transform(string_split(filter_order[:step - 1], ''),
                  lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step::INT AS step, bit,
         sum(CASE WHEN mask & bit = 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM (SELECT part, mask, n, good, toxic, filter_order, step, bit, before::BIGINT AS before FROM combos, steps)
  GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), CONTROLS, 'x\0', 'g')) AS body,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
              ELSE 19 + length(regexp_replace(replace(role, '\', '\\'), CONTROLS, 'x\0', 'g')) END AS marks
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + marks)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""".replace("CONTROLS", r"'<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\]'")

# crc32 of a number's decimal text, byte by byte and bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                           lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(map(_FIELD.format, ("doc_id", "source", "lang", "n_chars", "{0}"))) + ")"


def _levels(name: str, levels: int) -> str:
    """``levels`` levels of trees above ``{name}0`` (tree, place, node, size): siblings
    and digests of every node, level by level; a tree with one node left stays."""
    parts = []
    for h in range(levels):
        parts.append(f"""
{name}{h + 1}r AS (
  SELECT tree, place // 16 AS place, any_value(size) AS old, list(node ORDER BY place) AS run,
         (any_value(size) + 15) // 16 AS size FROM {name}{h} GROUP BY tree, place // 16),
{name}{h + 1} AS (
  SELECT tree, place, size, run, old,
         CASE WHEN old > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node FROM {name}{h + 1}r)""")
    return ",".join(parts)


def _paths(name: str, levels: int, tree: str, place: str) -> tuple[str, str]:
    """Joins of a row with its runs on each level, and the list of (left, right)."""
    joins, parts = [], []
    for h in range(levels):
        a, up = f"{name}_{h}", f"({place} // {16 ** (h + 1)})"
        joins.append(f"JOIN {name}{h + 1} {a} ON {a}.tree = {tree} AND {a}.place = {up}")
        at = f"(({place} // {16**h}) % 16)"
        parts.append(
            f"CASE WHEN {a}.old > 1 THEN [{{'l': array_to_string({a}.run[1:{at}], ''),"
            f" 'r': array_to_string({a}.run[{at} + 2:], '')}}] ELSE [] END"
        )
    return "\n  ".join(joins), "list_concat(" + ", ".join(parts) + ")"


# Enough levels for 16^5 documents of a source and 16^3 sources.
_DOC_LEVELS, _TOP_LEVELS = 5, 3
_DOC_JOINS, _DOC_PATH = _paths("t", _DOC_LEVELS, "d.tree", "d.place")
_TOP_JOINS, _TOP_PATH = _paths("s", _TOP_LEVELS, "0", "d.tree")
MANIFEST = f"""
WITH leaves AS (
  SELECT doc_id, {_LEAF.format("text")} AS leaf, source,
         CASE WHEN {_CRC32.format("doc_id")} % 5 = 0 THEN {_LEAF.format(LOWERED.format("text"))} END AS altered
  FROM documents),
d AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS size FROM leaves),
t0 AS (SELECT tree, place, leaf AS node, size FROM d),{_levels("t", _DOC_LEVELS)},
s0 AS (
  SELECT 0 AS tree, tree AS place, node, (count(*) OVER ()) AS size FROM t{_DOC_LEVELS}),{_levels("s", _TOP_LEVELS)},
paths AS (
  SELECT d.doc_id, d.leaf, d.altered, s0.node AS subroot, s_{_TOP_LEVELS - 1}.node AS root,
         list_concat({_DOC_PATH}, {_TOP_PATH}) AS path
  FROM d JOIN s0 ON s0.place = d.tree
  {_DOC_JOINS}
  {_TOP_JOINS}),
folded AS (
  SELECT *, list_reduce(
    list_concat([{{'l': '', 'r': coalesce(altered, leaf)}}], path),
    lambda a, b: {{'l': '', 'r': sha256(b.l || a.r || b.r)}}).r AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

STATEMENTS = {
    "op4_source_mixing": MIXING,
    "op8_line_dedup": LINE_DEDUP,
    "op9_decontamination": DECONTAMINATION,
    "op11_manifest": MANIFEST,
    "op12_chat_format": CHAT_FORMAT,
    "op13_filter_audit": FILTER_AUDIT,
}
