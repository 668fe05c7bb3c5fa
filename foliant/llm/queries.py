"""The contract queries over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import counts, exact_dedup, language, line_dedup, near_dedup, packing, pieces, secret_scan, store, token_output, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return store.with_small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, the source as host: line counts and the digest of each cleaned text."""
    clean = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return clean.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "token-files")
    token_output.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_output.read_documents(spark, path)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), percent=85)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_exact_dedup, op3_token_output, op4_top_k, op5_near_dedup, op6_secret_scan, op7_language, op8_sentencepiece, op9_token_counts, op10_packing)
}

# Letters of the key words in either case, without case folding beyond ASCII.
_KEY_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_PATTERNS = (("assign", f"""({_KEY_WORDS})["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)""", 2), ("access", "AKIA[A-Z0-9]{12,}", 0), ("hex", "[0-9a-f]{32,}", 0), ("generic", "[A-Za-z0-9+/_-]{24,}", 0))
_MATCHES = " UNION ALL ".join(f"SELECT doc_id, source, {k} AS kind, '{name}' AS name, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals FROM d" for k, (name, pattern, group) in enumerate(_PATTERNS))

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT doc_id, source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line FROM d),
     t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
     b AS (SELECT l.source, line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
           GROUP BY l.source, line, total HAVING count(*) >= 2 AND count(*) / total > 0.08),
     h AS (SELECT l.doc_id, l.source, list(l.line) AS gone FROM l JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.doc_id, l.source),
     k AS (SELECT d.doc_id, d.text, d.lines, list_filter(d.lines, lambda x: NOT list_contains(coalesce(h.gone, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
           FROM d LEFT JOIN h ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS clean_sha256 FROM k
""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM p JOIN n nu ON u = nu.doc_id JOIN n nv ON v = nv.doc_id WHERE 100 * c >= 85 * (nu.n + nv.n - c)),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.reached = l.u),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id
""",
    "op6_secret_scan": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), m AS ({_MATCHES}),
x AS (SELECT doc_id, source, kind, name, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT doc_id, source, kind, name, hits[i] AS hit, vals[i] AS val,
        list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0)::BIGINT AS start FROM x),
v AS (SELECT *, start + length(hit) AS stop, regexp_matches(val, '[0-9]') AND len(list_distinct(string_split(val, ''))) >= 6 AS varied FROM s),
base AS (SELECT * FROM v WHERE kind < 3 AND length(val) >= 8),
extra AS (SELECT * FROM v WHERE kind = 3 AND varied AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = v.doc_id AND b.start < v.stop AND v.start < b.stop)),
al AS (SELECT * FROM base UNION ALL SELECT * FROM extra), o AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) <= 2 AND count(DISTINCT {{'d': doc_id, 's': source}}) <= 20 AS few FROM al GROUP BY val),
j AS (SELECT al.*, few AND varied AS live FROM al JOIN o ON al.val = o.val WHERE kind < 3 OR (few AND varied)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, count(*) FILTER (live) AS n_live,
        string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS b, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
""",
    "op4_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, x.vec_id, max(list_inner_product(q.e, x.e)::BIGINT) AS score
           FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.e) = len(x.e) WHERE q.vec_id % 50 = 0 GROUP BY ALL),
     r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""",
}
