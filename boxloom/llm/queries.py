"""One query per operator, over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxloom.llm import chat, clustering, decontam, exact, html, minhash, mixing, quality, secrets, spelling, substring, tokens, toxicity
from boxloom.llm.common import read

#: Target weights of the sources; the others share the default. One heavy source is damped, two small ones are raised.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 1.5, "src3": 0.5}
DEFAULT_WEIGHT = 1.0


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_digests(rows.unionByName(extra))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokens.read_vocabulary(tokens.VOCABULARY))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"), WEIGHTS, DEFAULT_WEIGHT)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict:
    ops = (
        op1_secret_scan, op2_html_extraction, op3_exact_dedup, op4_chat_formatting, op5_minhash_near_dedup, op6_substring_dedup,
        op7_token_counts, op8_benchmark_decontamination, op9_source_mixing, op10_quality_classifier, op11_spelling_variants, op12_centroid_clustering, op13_toxicity,
    )
    return {f.__name__: f for f in ops}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP4_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (SELECT *, role || chr(10) || text AS both_texts FROM r),
e AS (
  SELECT *, length(role) + length(text) + 16
    + sum_specials(role) + sum_specials(text) AS formatted FROM x)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(both_texts || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _specials(column: str) -> str:
    """SQL for the number of backslashes that escaping adds to a column."""
    times = lambda s: f"(length({column}) - length(replace({column}, {s}, ''))) // length({s})"
    return "(" + " + ".join(times(s) for s in ("chr(92)", "'<turn'", "'</turn>'", "'### '", "('>' || chr(10))")) + ")"


OP4_SQL = OP4_SQL.replace("sum_specials(role)", _specials("role")).replace("sum_specials(text)", _specials("text"))

OP9_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 1.5::DOUBLE WHEN 'src2' THEN 1.5::DOUBLE WHEN 'src3' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM n),
r AS (SELECT source, (sum(n) OVER ())::DOUBLE * w / (sum(w) OVER () * n) AS rate FROM w),
p AS (SELECT source, rate, greatest(1, ceil(rate / 16.0::DOUBLE))::BIGINT AS pieces FROM r),
cdf AS (
  SELECT source, pieces, rate / pieces AS lam, 0 AS k, exp(-(rate / pieces)) AS pk, exp(-(rate / pieces)) AS c FROM p
  UNION ALL SELECT source, pieces, lam, k + 1, pk * lam / (k + 1), c + pk * lam / (k + 1) FROM cdf WHERE k < 80),
u AS (
  SELECT d.doc_id, d.source, i, ('0x' || substr(md5(concat('17:', d.doc_id, ':', i)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.pieces + 1)) AS i) t),
k AS (SELECT doc_id, u.source, count(c) FILTER (WHERE c <= u) AS n_copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id, u.source)
SELECT d.*, copy, n_copies, md5(concat('17:order:', doc_id, ':', copy)) AS shuffle_key
FROM k JOIN documents d USING (doc_id), LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy) t
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON r.doc_id = l.a WHERE r.m < l.b),
g AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) t),
f AS (SELECT g, min(doc_id) AS first_doc FROM g GROUP BY g),
bad AS (SELECT DISTINCT doc_id, i + k AS pos FROM g JOIN f USING (g), LATERAL (SELECT unnest(range(0, 13)) AS k) t WHERE first_doc < doc_id),
kept AS (
  SELECT w.doc_id, p, w.w[p] AS word, bad.pos IS NOT NULL AS gone
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w) w LEFT JOIN bad ON bad.doc_id = w.doc_id AND bad.pos = p),
o AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(0, 256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
runs AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w
    FROM documents) GROUP BY doc_id, w),
b AS MATERIALIZED (SELECT doc_id, w, k, hex(concat(doc_id, ':', w)) AS b FROM runs),
table256 AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM t WHERE k = 8),
crc AS (
  SELECT doc_id, w, k, b, 0 AS pos, 4294967295::BIGINT AS c FROM b
  UNION ALL
  SELECT doc_id, w, k, b, pos + 1, xor(c >> 8, t[(xor(c, CAST('0x' || substr(b, 2 * pos + 1, 2) AS BIGINT)) & 255) + 1]) FROM crc, table256 WHERE 2 * pos < length(b)),
h AS (SELECT w, k, xor(c, 4294967295::BIGINT) AS h FROM crc WHERE 2 * pos = length(b)),
x AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, k FROM h),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM x GROUP BY word HAVING length(word) >= 5 AND sum(k) >= 3),
less AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i) l),
longer AS (SELECT DISTINCT less.word AS a, less.n AS an, words.word AS b, words.n AS bn FROM less JOIN words ON less.d = words.word),
near AS (
  SELECT p.word, q.word AS other, q.n AS other_n FROM less p JOIN less q ON p.d = q.d AND p.i = q.i AND p.word <> q.word
  UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer),
best AS MATERIALIZED (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
forms AS MATERIALIZED (SELECT words.word, other AS form, other_n AS form_n FROM words JOIN best USING (word) WHERE other_n >= 2 * n),
chain AS (SELECT word, word AS root, 0 AS depth FROM words UNION ALL SELECT chain.word, form, depth + 1 FROM chain JOIN forms ON chain.root = forms.word),
ends AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT words.word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM words JOIN ends USING (word) LEFT JOIN best USING (word) LEFT JOIN forms USING (word)
"""


def _op12_sql() -> str:
    """The rounds one after the other, in rows (vector, component)."""
    near = """a{k} AS MATERIALIZED (
  SELECT rid, c, d FROM (SELECT rid, c, sum((v.v - c.v) * (v.v - c.v))::BIGINT AS d FROM v JOIN c{k} c USING (i) GROUP BY rid, c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),
"""
    move = """c{n} AS MATERIALIZED (
  SELECT c.c, c.i, coalesce(m.m, c.v) AS v FROM c{k} c
  LEFT JOIN (SELECT c, i, floor(sum(v.v)::DOUBLE / count(*))::BIGINT AS m FROM a{k} JOIN v USING (rid) GROUP BY c, i) m USING (c, i)),
"""
    rounds = "".join(near.format(k=k) + (move.format(k=k, n=k + 1) if k < 5 else "") for k in range(6))
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
x AS MATERIALIZED (SELECT rid, vec_id, i, embedding[i]::DOUBLE AS x FROM e, LATERAL (SELECT unnest(range(1, 65)) AS i) t),
bad AS (SELECT DISTINCT rid FROM x WHERE x IS NULL OR isnan(x) OR isinf(x)),
v AS MATERIALIZED (SELECT rid, vec_id, i, floor(256 * x)::BIGINT AS v FROM x WHERE rid NOT IN (SELECT rid FROM bad)),
first40 AS (
  SELECT rid, row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), rid) - 1 AS c FROM (SELECT DISTINCT rid, vec_id FROM v)
  QUALIFY row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), rid) <= 40),
c0 AS MATERIALIZED (SELECT c, i, v FROM v JOIN first40 USING (rid)),
{rounds}sums AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a5 GROUP BY c),
hashes AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY c)
SELECT e.vec_id, c::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a5) AS inertia, centroid_sha256
FROM a5 JOIN e USING (rid) JOIN sums USING (c) JOIN hashes USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op5_minhash_near_dedup": OP5_SQL,
        "op6_substring_dedup": OP6_SQL, "op9_source_mixing": OP9_SQL,
        "op11_spelling_variants": OP11_SQL, "op12_centroid_clustering": _op12_sql(),
    }
