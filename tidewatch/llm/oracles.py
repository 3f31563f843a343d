"""SQL for the numbered queries that plain SQL can state, for whole tables of moderate size. Ids are taken to be unique."""

from __future__ import annotations

_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
again AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM (SELECT doc_id, i FROM s SEMI JOIN again USING (k)), range(35) r(o)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

TOPK_SEARCH = """WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 5"""

DECONTAMINATION = rf"""WITH folded AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS size, md5(array_to_string(w[i:i + least(13, len(w)) - 1], ' ')) AS k FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
s AS (SELECT doc_id, size, i, md5(array_to_string(w[i:i + size - 1], ' ')) AS k FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM folded, sizes)),
found AS (SELECT doc_id, item, i, size FROM s JOIN windows USING (size, k)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + o AS j FROM (SELECT DISTINCT doc_id, i, size FROM found), range(13) r(o) WHERE o < size) GROUP BY doc_id),
owners AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * n >= len(w) AS contaminated
FROM folded LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)"""

JACCARD_JOIN = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text expression's UTF-8, by the reversed polynomial 0xEDB88320; needs a join with `crc_table`."""
    octets = f"list_transform(range(CAST(length(hex(encode({text}))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


_SHIFTED = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
CRC_TABLE = f"crc_table AS MATERIALIZED (SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], {_SHIFTED}, CAST(b AS BIGINT)) ORDER BY b) AS crc_t FROM range(256) r(b))"

SPELLING_VARIANTS = rf"""WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {crc32_sql("doc_id || ':' || run")} AS h FROM r, crc_table WHERE length(run) >= 5),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS w, b.n AS m FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.less = v.word),
b AS (SELECT word, count(*) AS n_near, first(w ORDER BY m DESC, w) AS w, max(m) AS m FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, CASE WHEN m >= 2 * n THEN w END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
s AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT s.word, root FROM s JOIN f ON s.root = f.word WHERE f.form IS NULL) USING (word)"""


def _repair_step() -> str:
    """One turn's step over four strings, each the cost in nine digits and the letters so far, so that the least string is the cheapest and then the ASCII-least way; null: no way."""
    add = lambda way, cost, letter: f"CASE WHEN {way} IS NOT NULL THEN lpad(CAST(CAST(left({way}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letter}' END"
    late = "CASE WHEN ascii(c) < 97 THEN 5 ELSE 0 END"
    keep = lambda way, role: f"CASE WHEN lower(c) = '{role}' THEN {add(way, late, 'K')} END"
    again = lambda way: f"CASE WHEN c <> '-' THEN {add(way, f'({late}) + 1', 'R')} END"
    went = [add(f"s[{i}]", 2, "D") for i in (1, 2, 3, 4)]
    went[1] = f"least({went[1]}, {keep('s[1]', 's')})"
    went[2] = f"least({went[2]}, {', '.join(f'{keep(w, "u")}, {again(w)}' for w in ('s[1]', 's[2]', 's[4]'))})"
    went[3] = f"least({went[3]}, {keep('s[3]', 'a')}, {again('s[3]')})"
    put = lambda w: add(w, 5, "I")
    users = f"[x[1], x[2], least(x[3], {put('x[1]')}, {put('x[2]')}, {put('x[4]')}), x[4]]"
    both = f"[x[1], x[2], x[3], least(x[4], {put('x[3]')})]"
    return f"list_transform(list_transform([[{', '.join(went)}]], lambda x: {users}), lambda x: {both})[1]"


CONVERSATION_REPAIR = rf"""WITH {CRC_TABLE},
h AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations, crc_table),
g AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) FROM h)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again, right(regexp_replace(text, '[ 	-
]+$', ''), 1) AS last FROM p),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
c AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(k) ELSE k END AS code FROM (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS k FROM f)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list_reduce(list(code ORDER BY i), lambda s, c: {_repair_step()}, ['000000000', NULL, '000000005I', '000000010II']) AS ways FROM c GROUP BY conv_id),
w AS (SELECT *, CAST(left(way, 9) AS BIGINT) AS cost, substr(way, 10) AS audit FROM (SELECT *, least(ways[1], ways[4]) AS way FROM n)),
l AS (SELECT conv_id, audit, j, substr(audit, j, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM w)),
v AS (SELECT *, count(*) FILTER (e <> 'I') OVER q AS i, count(*) FILTER (e <> 'D') OVER q AS k, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) AS m FROM l WINDOW q AS (PARTITION BY conv_id ORDER BY j)),
t AS (SELECT v.conv_id, j, CASE WHEN e = 'K' THEN role WHEN (v.k - m) % 2 <> 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM v LEFT JOIN c ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = c.i WHERE e <> 'D'),
r AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY j)) AS hash FROM t GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN w ON a.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id"""
