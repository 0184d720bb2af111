"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

#: Segments of 64 turn numbers; a segment of more than 1,024 messages is cut further (see chat.rotate).
PERSPECTIVES = r"""
WITH m AS (
  SELECT DISTINCT conv_id, turn,
         replace(CASE WHEN r = '' THEN 'unknown' ELSE r END, '<|', '< |') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM (SELECT *, trim(regexp_replace(coalesce(role, ''), '[\x00-\x20]+', ' ', 'g')) AS r FROM conversations)),
b AS (SELECT *, floor(turn / 64)::BIGINT * 64 AS block FROM m),
t AS (SELECT conv_id, turn, block, count(*) AS n, sum(count(*)) OVER (PARTITION BY conv_id, block) AS total
      FROM b GROUP BY conv_id, turn, block),
s AS (
  SELECT b.*, CASE WHEN total > 1024 THEN b.turn ELSE b.block END AS segment, 0 AS part
  FROM b JOIN t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.turn IS NOT DISTINCT FROM t.turn),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
v AS (
  SELECT s.*, perspective, speaker = perspective AS train,
         '<|start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                             ELSE 'user name=' || speaker END || chr(10) AS head,
         content || '<|end|>' || chr(10) AS body
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER w, 0) + length(head) AS pos
  FROM v WINDOW w AS (PARTITION BY conv_id, perspective, segment, part ORDER BY turn NULLS FIRST, speaker, content
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, perspective, segment, part, count(*)::INT AS n_messages, (count(*) FILTER (train))::INT AS n_trained,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, speaker, content) AS rendered,
       coalesce(string_agg(CAST(pos AS BIGINT) || '-' || CAST(pos + length(body) AS BIGINT), ',' ORDER BY pos) FILTER (train), '') AS mask
FROM o GROUP BY conv_id, perspective, segment, part
"""

#: Words of runs of 50 that also start in a document with a smaller doc_id.
WORD_RUNS = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
win AS (SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM win),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
hit AS (SELECT r, i FROM h JOIN m USING (h) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM hit),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Bytes of strings of 50 that also start in a document with a smaller doc_id; texts are taken as hexadecimal digits.
BYTE_RUNS = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT *, length(x) // 2 AS n FROM d),
win AS (SELECT r, doc_id, unnest(range(0, n - 49)) AS i, x FROM s WHERE n >= 50),
h AS (SELECT r, doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS h FROM win),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
hit AS (SELECT r, i FROM h JOIN m USING (h) WHERE least < doc_id),
edge AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit),
span AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END)
           OVER (PARTITION BY r ORDER BY i) AS k FROM edge),
gone AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM span GROUP BY r, k),
parts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS start FROM gone),
sums AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
           string_agg(substr(x, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) AS t
         FROM parts JOIN s USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE t || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM s LEFT JOIN sums USING (r)
"""

#: Four-word shingles, Jaccard of 85 % and more, smallest doc_id reachable.
JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y USING (h)
                    WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) USING (doc_id)
"""


def turn(source: str) -> str:
    """SQL for one pass of the Feistel network over the column y of ``source``."""
    sql = f"SELECT *, y // b AS l, y % b AS r FROM ({source})"
    for k in range(6):
        own, other, size = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        noise = f"('0x' || substr(md5('keytempo:{k}:' || {other}), 1, 12))::BIGINT"
        sql = f"SELECT * REPLACE (({own} + {noise}) % {size} AS {own}) FROM ({sql})"
    return f"SELECT * EXCLUDE (l, r) REPLACE (l * b + r AS y) FROM ({sql})"


#: Checksum byte by byte, row numbers, Feistel network with cycle walking.
SHARDS = f"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size,
    CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(octet_length(encode(text))),
        lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
      lambda c, byte: xor(c // 256, t[xor(c % 256, byte) + 1]))) END AS text_crc32
  FROM (SELECT *, hex(encode(text)) AS x FROM documents), crc),
k AS (SELECT *, substr(md5(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), chr(0)),
    coalesce(CAST(text_crc32 AS VARCHAR), chr(0)), CAST(size AS VARCHAR))), 1, 3) AS bucket FROM d),
n AS (SELECT count(*) AS n, greatest(1, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1) AS a FROM documents),
g AS (SELECT n, a, (n + a - 1) // a AS b FROM n),
f AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, text_crc32 NULLS FIRST, size)
        - 1 AS row_number FROM k),
walk AS ({turn("SELECT row_number AS x, row_number AS y, n, a, b FROM f, g")}
  UNION ALL {turn("SELECT * FROM walk WHERE y >= n")})
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(y % 40 AS INTEGER) AS shard, y // 40 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, row_number, y AS place
FROM f JOIN walk ON x = row_number WHERE y < n
"""


#: The table of CRC-32 and a checksum, byte by byte.
CRC_TABLE = """
bits AS (
  SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits)"""


def crc32(text: str) -> str:
    return f"""xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(octet_length(encode({text}))),
        lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)),
      lambda c, byte: xor(c // 256, t[xor(c % 256, byte) + 1])))"""


UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def leaf_sql(text: str) -> str:
    parts = (f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
             for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


def tree_sql(name: str, levels: int) -> str:
    """Levels above the table {name}0 (s, i, h) and, per level, what stands left and right of a node in its run."""
    out = []
    for k in range(levels):
        out.append(f"""
{name}{k}n AS (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM {name}{k}),
{name}{k}p AS (SELECT s, i, n > 1 AS on_path,
    coalesce(string_agg(h, '') OVER (PARTITION BY s, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY s, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k}n),
{name}{k + 1} AS (SELECT s, i // 16 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {name}{k}n GROUP BY s, i // 16)""")
    return ",".join(out)


def fold_sql(name: str, levels: int, source: str, s: str, i: str) -> str:
    """One step per level from ``source`` (f, q and the tree and place of the lowest node) towards the root."""
    for k in range(levels):
        source = f"""(SELECT x.* REPLACE (CASE WHEN on_path THEN sha256(p.l || f || p.r) ELSE f END AS f,
          CASE WHEN on_path THEN q || p.l || p.r ELSE q END AS q)
        FROM {source} x JOIN {name}{k}p p ON p.s = x.{s} AND p.i = x.{i} // {16 ** k})"""
    return source


#: Trees of up to 16**6 leaves a source and 16**4 sources.
MANIFEST = f"""
WITH {CRC_TABLE.strip()},
d AS (SELECT doc_id, source, row_number() OVER () AS row, {leaf_sql('text')} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0
             THEN {leaf_sql(f"translate(text, {UPPER}, {LOWER})")} END AS changed FROM documents, crc),
o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i FROM d),
a0 AS (SELECT s, i, leaf AS h FROM o), {tree_sql("a", 6)},
b0 AS (SELECT 0 AS s, s AS i, h FROM a6), {tree_sql("b", 4)},
start AS (SELECT *, coalesce(changed, leaf) AS f, '' AS q, 0 AS top FROM o),
done AS {fold_sql("b", 4, fold_sql("a", 6, "start", "s", "i"), "top", "s")}
SELECT doc_id, leaf, a6.h AS subroot, b4.h AS root, sha256(q) AS proof_sha256, f AS folded_root, f = b4.h AS verified
FROM done JOIN a6 ON a6.s = done.s JOIN b4 ON b4.s = done.top
"""


def features_sql(table_name: str) -> str:
    return f"""SELECT k, array_to_string(w[i:i + n - 1], ' ') AS f FROM (
      SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {table_name}, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)"""


def words_sql(table_name: str, columns: str) -> str:
    return f"""SELECT {columns}, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table_name}"""


#: Checksums of the different phrases, counts per bucket, gains, noise and the highest scores.
RESAMPLED = f"""
WITH {CRC_TABLE.strip()},
d AS ({words_sql("documents", "doc_id, row_number() OVER () AS k")}),
g AS ({words_sql("benchmark", "0 AS k")}),
df AS (SELECT k, f, count(*) AS c FROM ({features_sql("d")}) GROUP BY k, f),
gf AS (SELECT f, count(*) AS c FROM ({features_sql("g")}) GROUP BY f),
b AS (SELECT f, {crc32("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM gf), crc),
s AS (SELECT bucket, sum(c) AS n FROM df JOIN b USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS n FROM gf JOIN b USING (f) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM s) + 10000 AS DOUBLE))
    / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS v
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT k, sum(c) AS n, sum(c * v) AS weight FROM df JOIN b USING (f) JOIN gain USING (bucket) GROUP BY k),
r AS (SELECT doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
          + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN w USING (k)),
p AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
        count(*) FILTER (words >= 20) OVER () AS eligible FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * eligible // 100 THEN place END AS rank FROM p
"""
