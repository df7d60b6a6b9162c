"""DuckDB SQL for those corpus queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"

#: Words, 3-word windows that repeat, and line rules are spelled out independently of the operator.
LINE_RULES = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
win AS (
  SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3) q),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) q WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY rid),
lines AS (SELECT rid, k, x, regexp_replace(x, '{_SPACE}+', '', 'g') AS dense, len(regexp_extract_all(x, '{_WORD}')) AS n
          FROM (SELECT rid, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS x FROM base) q),
judged AS (
  SELECT rid, x, dense, regexp_matches(x, '[^\x20\x09-\x0D]') AS has_word,
         ((n < 4 AND NOT regexp_matches(right(regexp_replace(x, '{_SPACE}+$', ''), 12), '[.!?…。！？:;]["''”’»)\]]*$'))
          OR length(dense) - length(regexp_replace(dense, '[#*$%&|<>]', '', 'g')) > 0.1::DOUBLE * length(dense)
          OR (length(dense) >= 20 AND length(regexp_replace(dense, '\P{{Lu}}+', '', 'g')) > 0.6::DOUBLE * length(dense))
          OR len(regexp_extract_all(dense, '!!+')) * 3 > n
          OR (regexp_matches(dense, '[|»>•·]') AND len(list_filter(string_split_regex(x, '[ \t\n\x0b\f\r]'), lambda p: p IN ('|', '»', '>', '•', '·'))) * 4 > n)
          OR (n <= 12 AND regexp_matches(x, '(?i)\b(cookies?|copyright|log ?in|newsletter|javascript|lorem ipsum|privacy policy|terms of (use|service)|all rights reserved|sign ?(in|up)|subscribe|click here|read more|share (this|on)|follow us|back to top|skip to content|powered by|impressum|datenschutz(erklärung)?|alle rechte vorbehalten|nutzungsbedingungen|jetzt anmelden|hier klicken|mehr lesen|weiterlesen|nach oben|mentions légales|tous droits réservés|politique de confidentialité|conditions d''utilisation|cliquez ici|lire la suite|abonnez-vous|haut de page|aviso legal|todos los derechos reservados|política de privacidad|condiciones de uso|haga clic aquí|leer más|suscríbete|volver arriba)\b'))) AS fails
  FROM lines),
per AS (
  SELECT rid, count(*) FILTER (WHERE has_word) - count(DISTINCT x) FILTER (WHERE has_word) AS n_dup_lines,
         coalesce(sum(length(dense)) FILTER (WHERE NOT fails), 0) AS kept_chars, coalesce(sum(len(regexp_extract_all(x, '{_WORD}'))) FILTER (WHERE NOT fails), 0) AS kept_words
  FROM judged GROUP BY rid),
facts AS (
  SELECT b.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, kept_chars, kept_words
  FROM base b JOIN per p ON p.rid = b.rid LEFT JOIN covered c ON c.rid = b.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 70 * word_chars AND 2 * kept_words >= 50 AS kept
FROM facts
"""

#: The cap level is found from the sources sorted by cap per weight; what is taken follows from the
#: running sums in md5 order.
MIXING = rf"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source) q),
steps AS (
  SELECT *, row_number() OVER o AS k, coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM src WINDOW o AS (ORDER BY 2 * source_size / w, w, source NULLS LAST)),
lvl AS (SELECT arg_min((total - capped) / open_w, k) AS v FROM steps WHERE (total - capped) / open_w * w <= 2 * source_size),
tgt AS (SELECT source, source_size, least(w * coalesce((SELECT v FROM lvl), 0), 2.0::DOUBLE * source_size) AS target FROM src),
run AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS want,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE want // source_size * size + greatest(0, least(size, want % source_size - start)) END AS taken, source, start FROM run
"""

LINE_DEDUP = rf"""
WITH lines AS (
  SELECT rid, doc_id, k, x, translate(regexp_replace(regexp_replace(x, '^{_SPACE}+', ''), '{_SPACE}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS x
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) b) q),
shared AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, s.keeper IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM lines l LEFT JOIN shared s ON s.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, {_AZ}), '{_ITEM_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0) q),
doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ITEM_WORD}') AS w FROM documents),
own AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) k) q),
hit AS (SELECT rid, i, o.n, item FROM own o JOIN win USING (n, g)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) q GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) q GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""


def _centroids(rounds: int = 10) -> str:
    """Plain rounds of nearest centroid and floor of the mean, one row for each component."""
    text = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range(64)) AS j FROM e),
start AS (SELECT rid, row_number() OVER (ORDER BY h, v) - 1 AS num FROM (SELECT rid, v, sha256('3:' || vec_id) AS h FROM e) q ORDER BY h, v LIMIT 8),
c0 AS MATERIALIZED (SELECT num, j, x AS y FROM start JOIN x USING (rid)),"""
    for i in range(rounds + 1):
        text += f"""
a{i} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, c := num)) AS m
  FROM (SELECT rid, num, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{i} USING (j) GROUP BY rid, num) q GROUP BY rid),"""
        if i < rounds:
            text += f"""
c{i + 1} AS MATERIALIZED (
  SELECT num, j, CASE WHEN k IS NULL THEN y ELSE CAST((s - ((s % k) + k) % k) // k AS BIGINT) END AS y
  FROM c{i} LEFT JOIN (SELECT m.c AS num, j, sum(x) AS s, count(*) AS k FROM a{i} JOIN x USING (rid) GROUP BY m.c, j) t USING (num, j)),"""
    return text + f"""
digest AS (SELECT num, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS sha FROM c{rounds} GROUP BY num)
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM e JOIN a{rounds} USING (rid) JOIN digest ON num = m.c
"""


#: CRC-32 bit by bit; nodes are grouped by whole lists of turns, and each node adds to all nodes above it.
PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(r := r, t := t) ORDER BY turn NULLS FIRST, r, t) AS s
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) q GROUP BY conv_id),
cut AS (
  SELECT c, s, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) END), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM own),
built AS MATERIALIZED (
  SELECT k.c, CASE WHEN b.s IS NULL THEN k.s[h + 1:] ELSE list_concat(b.s[1:h], k.s[h + 1:]) END AS s FROM cut k LEFT JOIN own b ON b.c = k.c - k.c % 5),
steps AS MATERIALIZED (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM built),
pre AS MATERIALIZED (SELECT c, n, d, s[1:d] AS p FROM steps),
node AS MATERIALIZED (
  SELECT d, p, min(c) AS own, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends,
         CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(p[d].t)) END AS bytes FROM pre GROUP BY d, p),
path AS MATERIALIZED (SELECT c, d, own FROM pre JOIN node USING (d, p)),
tree AS MATERIALIZED (SELECT k.own, k.d, k.n, k.ends, k.bytes, up.own AS parent FROM node k LEFT JOIN path up ON up.c = k.own AND up.d = k.d - 1),
kids AS (SELECT parent AS own, d - 1 AS d, count(*) AS m FROM tree WHERE d > 0 GROUP BY parent, d),
full_tree AS MATERIALIZED (SELECT t.*, coalesce(m, 0) AS m FROM tree t LEFT JOIN kids USING (own, d)),
sums AS (
  SELECT up.own, up.d, count(*) FILTER (WHERE t.m = 0) AS n_leaves, CAST(sum((t.n - 1) * t.bytes) AS BIGINT) AS saved
  FROM full_tree t JOIN path up ON up.c = t.own AND up.d <= t.d GROUP BY up.own, up.d)
SELECT own AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, m AS n_children, n_leaves, saved AS saved_tokens, ends AS ends_sha256
FROM full_tree JOIN sums USING (own, d)
"""

SQL: dict[str, str] = {
    "op4_line_rules": LINE_RULES, "op5_mixing": MIXING, "op6_line_dedup": LINE_DEDUP,
    "op11_decontamination": DECONTAMINATION, "op12_centroids": _centroids(), "op13_prefix_trie": PREFIX_TRIE,
}
