"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

#: CRC-32 of the UTF-8 bytes of a string, by a table made from the polynomial.
CRC = """
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(
    list_concat([i], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
codes AS (SELECT s, xor(list_reduce(
    list_concat([4294967295], list_transform(range(0, octet_length(encode(s))), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))),
    lambda x, b: xor(t[CAST(xor(x, b) % 256 AS BIGINT) + 1], x // 256)), 4294967295) AS h FROM hashed, bits)
"""

ORACLE["op13_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
    translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS MATERIALIZED (SELECT d || ':' || run AS s, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT s FROM counted),
{CRC},
spelled AS (SELECT c, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
  FROM counted JOIN codes USING (s)),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
shorter AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS less FROM places),
holed AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM places),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM shorter a JOIN words b ON a.less = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.less = b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holed a JOIN holed b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
named AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.m >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form,
    CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS at FROM named
  UNION ALL SELECT walk.word, f.form FROM walk JOIN named f ON walk.at = f.word WHERE f.form IS NOT NULL)
SELECT n.word, n.n, n.n_near, n.form, n.form_n, w.at AS root
FROM named n JOIN walk w USING (word) JOIN named e ON e.word = w.at WHERE e.form IS NULL
"""

ORACLE["op11_ranked_search"] = r"""
WITH said AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
parts AS (
  SELECT doc_id, term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))) AS part
  FROM tfs JOIN dfs USING (term) JOIN sizes USING (doc_id), whole),
scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLE["op12_substring_dedup"] = r"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM windows JOIN least USING (k) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT s.doc_id, len(s.w) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
