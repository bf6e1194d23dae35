"""The registered query of the conversation trie."""

from __future__ import annotations

from .common import Scratch, read_table
from .conversation_trie import branches, placed_turns, prefix_trie
from .registry import query

# Prefixes are compared as whole texts; crc32 is the usual bitwise division (polynomial 0xEDB88320).
OP11_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS size FROM t GROUP BY conv_id
), crc AS (
  SELECT conv_id, size, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::UBIGINT),
      lambda c, x: list_reduce(range(8), lambda v, k:
        CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, xor(c, x)),
      4294967295::UBIGINT), 4294967295::UBIGINT) % 9 AS h
  FROM sizes
), ids AS (
  SELECT c.conv_id, c.base, c.h::BIGINT AS h, least(c.h, coalesce(b.size, 0))::BIGINT AS lent
  FROM crc c LEFT JOIN sizes b ON b.conv_id = c.base
), built AS (
  SELECT i.conv_id, t.place, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.base AND t.place <= i.h
  UNION ALL
  SELECT i.conv_id, t.place - i.h + i.lent, t.role, t.text
  FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.place > i.h
), paths AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS bytes FROM ids
  UNION ALL
  SELECT conv_id, place, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
    OVER (PARTITION BY conv_id ORDER BY place), strlen(text)
  FROM built
), ended AS (
  SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), nodes AS (
  SELECT depth, prefix, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)
      FILTER (WHERE e.conv_id IS NOT NULL), '')) AS ends_sha256
  FROM paths p LEFT JOIN ended e USING (conv_id, depth) GROUP BY depth, prefix
), edges AS (
  SELECT c.depth, c.prefix, up.prefix AS parent, q.conv_id AS parent_conv_id
  FROM nodes c JOIN paths up ON up.conv_id = c.conv_id AND up.depth = c.depth - 1
  JOIN nodes q ON q.depth = up.depth AND q.prefix = up.prefix
), counted AS (
  SELECT n.*, e.parent_conv_id, (SELECT count(*) FROM edges x
    WHERE x.depth = n.depth + 1 AND x.parent = n.prefix) AS n_children
  FROM nodes n LEFT JOIN edges e USING (depth, prefix)
), sums AS (
  SELECT p.depth, p.prefix, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum((c.n_convs - 1) * c.bytes) AS saved_tokens
  FROM counted c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.depth, p.prefix
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs,
  n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  ends_sha256
FROM counted JOIN sums USING (depth, prefix)
"""


@query("op11_conversation_trie", OP11_SQL)
def op11_conversation_trie(spark, sf_dir):
    """Every node of the trie of the rebuilt conversations."""
    scratch = Scratch(spark)
    placed = scratch.write(placed_turns(read_table(spark, sf_dir, "conversations"), scratch), "placed")
    turns, ids = branches(placed)
    return prefix_trie(turns, ids, scratch=scratch)
