"""DuckDB SQL for the operators whose method's result SQL can express."""

from __future__ import annotations

from . import centroids, replies, spelling


def _escaped(col: str) -> str:
    """A text with one more backslash after the first character of every control string."""
    def tails(first):
        rest = [c[1:].replace("|", "\\|").replace("[", "\\[").replace("]", "\\]") for c in replies.CONTROL if c[0] == first]
        return "|".join(rest)
    once = f"regexp_replace({col}, '<(\\\\*)({tails('<')})', '<\\\\\\1\\2', 'g')"
    return f"regexp_replace({once}, '\\[(\\\\*)({tails('[')})', '[\\\\\\1\\2', 'g')"


_ROLE = "replace(replace(role, '\\', '\\\\'), chr(10), '\\n')"
REPLIES = f"""WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) p)
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM({len(replies.START) + len(replies.STOP) + 2} + length({_escaped(_ROLE)}) + length({_escaped('text')})) AS BIGINT)
    AS formatted_chars
FROM c GROUP BY conv_id"""


def _round(r: int) -> str:
    """Assignment to the centroids of round ``r`` and the centroids after it."""
    return f"""a{r} AS MATERIALIZED (
  SELECT r, MIN(d * 64 + c) AS m FROM (SELECT v.r, c.c, CAST(list_sum(list_transform(v.v, lambda x, i: (x - c.v[i]) * (x - c.v[i])))
    AS BIGINT) AS d FROM v CROSS JOIN c{r} c) GROUP BY r),
s{r} AS MATERIALIZED (
  SELECT c, i, CAST(SUM(x) AS BIGINT) AS s, COUNT(*) AS n FROM (
    SELECT m % 64 AS c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM a{r} JOIN v ON a{r}.r = v.r) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c
  UNION ALL SELECT c, v FROM c{r} WHERE c NOT IN (SELECT c FROM s{r}))"""


CENTROIDS = f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {centroids.DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
    SELECT sha256('{centroids.SEED}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v ORDER BY h, v LIMIT {centroids.CENTROIDS})),
{', '.join(_round(r) for r in range(centroids.ROUNDS + 1))},
done AS (SELECT vec_id, CAST(m % 64 AS INTEGER) AS cluster, m // 64 AS distance FROM a{centroids.ROUNDS} a JOIN v ON a.r = v.r)
SELECT vec_id, cluster, distance, CAST(SUM(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(SUM(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM done JOIN c{centroids.ROUNDS} c ON c.c = done.cluster"""

# Plain form: words that agree after one character is cut out of either or both; crc32 from its byte table.
SPELLING = f"""WITH RECURSIVE
bits AS (
  SELECT b AS byte, b AS v, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT byte, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY byte) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-zÀ-ÿ]{{{spelling.LEAST_LENGTH},}}')) AS run FROM documents),
coded AS (SELECT run, hex(encode(id || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) // 2 AS BIGINT)),
      lambda i: CAST((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT))),
    lambda h, b: xor(h // 256, crc.t[xor(h % 256, b) + 1])), 4294967295) AS h FROM coded CROSS JOIN crc),
cut AS (SELECT CASE WHEN h % {spelling.DAMAGE} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, COUNT(*) AS n FROM cut WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING COUNT(*) >= {spelling.LEAST_COUNT}),
gaps AS MATERIALIZED (
  SELECT word, n, length(word) AS len, i, word[1:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, COUNT(*) AS n_near, MAX(m) AS top, FIRST(other ORDER BY m DESC, encode(other)) AS other FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, COALESCE(b.n_near, 0) AS n_near, CASE WHEN b.top >= {spelling.RATIO} * w.n THEN b.other END AS form,
    CASE WHEN b.top >= {spelling.RATIO} * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS via, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON c.via = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(via, step) AS root FROM chain GROUP BY word) r ON f.word = r.word"""
