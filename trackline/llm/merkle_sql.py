"""The Merkle manifest in SQL, for the tables small enough for it: one recursive query per tree."""

# CRC-32 of a number's decimal digits, bit by bit; a tree level is one step of a recursion.
SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, text,
    list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda crc, x: CASE WHEN x >= 256 THEN xor(crc, x - 256) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END) & 1 AS odd,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
leaves AS (
  SELECT grp, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS claim
  FROM (SELECT *, CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS seen FROM docs)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
tree AS (
  SELECT grp, 0 AS level, pos, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT grp, any_value(level) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, pos // 3),
subroots AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 3),
proof AS (
  SELECT grp, doc_id, leaf, 0 AS level, pos, claim AS folded, '' AS siblings, n FROM ranked
  UNION ALL
  SELECT p.grp, p.doc_id, p.leaf, p.level + 1, p.pos // 3,
    sha256(coalesce(lo, '') || p.folded || coalesce(hi, '')), p.siblings || coalesce(lo, '') || coalesce(hi, ''), (p.n + 2) // 3
  FROM (SELECT p.*,
      (SELECT string_agg(digest, '' ORDER BY t.pos) FROM tree t WHERE t.grp = p.grp AND t.level = p.level AND t.pos // 3 = p.pos // 3 AND t.pos < p.pos) AS lo,
      (SELECT string_agg(digest, '' ORDER BY t.pos) FROM tree t WHERE t.grp = p.grp AND t.level = p.level AND t.pos // 3 = p.pos // 3 AND t.pos > p.pos) AS hi
    FROM proof p WHERE p.n > 1) p),
inside AS (SELECT p.*, s.digest AS subroot, s.pos AS place, s.n AS tops FROM proof p JOIN subroots s USING (grp) WHERE p.n = 1),
outside AS (
  SELECT grp, doc_id, leaf, subroot, 0 AS level, place AS pos, tops AS n, folded, siblings FROM inside
  UNION ALL
  SELECT grp, doc_id, leaf, subroot, level + 1, pos // 3, (n + 2) // 3,
    sha256(coalesce(lo, '') || folded || coalesce(hi, '')), siblings || coalesce(lo, '') || coalesce(hi, '')
  FROM (SELECT o.*,
      (SELECT string_agg(digest, '' ORDER BY t.pos) FROM top t WHERE t.level = o.level AND t.pos // 3 = o.pos // 3 AND t.pos < o.pos) AS lo,
      (SELECT string_agg(digest, '' ORDER BY t.pos) FROM top t WHERE t.level = o.level AND t.pos // 3 = o.pos // 3 AND t.pos > o.pos) AS hi
    FROM outside o WHERE o.n > 1) o)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM outside, (SELECT digest AS root FROM top WHERE n = 1) WHERE n = 1
"""
