"""Registered queries of the text operators, and SQL with the same rows where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.llm import (
    bbit_minhash,
    crf_language,
    fertility,
    maxscore,
    multi_index,
    packing,
    periodic_runs,
    pfair,
    pu_quality,
    suffix_dedup,
    token_alignment,
    token_rollup,
    warc_chunks,
)
from tonewell.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_genetic_packing")
def genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), capacity=1024)


@query("op2_tokenizer_fertility")
def tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rules(documents(spark, sf_dir))


@query("op3_pu_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = documents(spark, sf_dir, "labels")
    scored = pu_quality.classify(documents(spark, sf_dir), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op4_token_rollups")
def token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.corpus_rollup(spark, documents(spark, sf_dir))


@query(
    "op5_maxscore_search",
    """
    WITH whole AS (
        SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE)))) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        GROUP BY vec_id),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM whole q, whole c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored QUALIFY rank <= 20
    """,
)
def maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = maxscore.quantised(documents(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return maxscore.top_k(terms.filter(F.col("vec_id") % 20 == 0), terms, k=20)


@query(
    "op6_warc_chunks",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)
    """,
)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.round_trip(spark, documents(spark, sf_dir, "pages"))


@query(
    "op7_bbit_minhash",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents),
    sh AS (
        SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
               ELSE array_to_string(words[i:i + 4], ' ') END AS s
        FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    rare AS (
        SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
        FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    link AS (
        SELECT u, v FROM rare JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
        WHERE 100 * common >= 85 * (x.n + y.n - common)),
    edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
    reach(doc_id, r) AS (
        SELECT doc_id, doc_id FROM documents
        UNION SELECT edge.v, reach.r FROM reach JOIN edge ON edge.u = reach.doc_id AND reach.r < edge.v)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id)
    JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
    """,
)
def minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(documents(spark, sf_dir))


@query("op8_crf_language")
def language_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.identify(documents(spark, sf_dir))


@query("op9_pfair_mixing")
def pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pfair.mix(spark, documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "block", "slot")


@query(
    "op10_suffix_dedup",
    """
    WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
          FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS i FROM t)),
    least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
    hit AS (SELECT doc_id, i FROM w JOIN least USING (s) WHERE m < doc_id),
    step AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS s FROM hit),
    run AS (SELECT doc_id, i, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM step),
    span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
    gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
    spans AS (
        SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, any_value(h) AS h, max(b) AS z,
               string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k
        FROM gap JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT t.doc_id, length(t.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(CASE WHEN spans.doc_id IS NULL THEN t.h ELSE k || substr(t.h, 2 * z + 1) END)) AS kept_sha256
    FROM t LEFT JOIN spans USING (doc_id)
    """,
)
def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(documents(spark, sf_dir))


@query("op11_token_alignment")
def aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(documents(spark, sf_dir))


def planted_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of every tenth document (by the checksum of its id) repeat a stretch from some word on; a null id leaves them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    a = (h // 10) % len(words)
    p = 1 + (len(words) - a) // (3 + (h // 10) % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((len(words) - a) // len(tail) + 1))[: len(words) - a]


@query(
    "op12_periodic_runs",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               -- crc32 of the decimal id: eight steps of the reflected polynomial after each character
               xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
                       string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))),
                   lambda crc, x: CASE WHEN x > 0 THEN xor(crc, x - 256)
                                       WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END),
                   4294967295) AS h
        FROM documents),
    p AS (
        SELECT doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts
        FROM d),
    t AS (
        SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
               THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END)
               ELSE w END AS w
        FROM p),
    -- a run shares five words at least with itself one period on
    g AS (
        SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS s
        FROM (SELECT doc_id, n, w, unnest(range(0, greatest(0, n - 4))) AS i FROM t)),
    m AS (
        SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.s = y.s
        WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m),
    stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q + 4 AS length FROM isle GROUP BY doc_id, q, k),
    run AS (
        SELECT doc_id, start, length, min(q) AS period FROM stretch
        WHERE length >= 6 AND length >= 4 * q GROUP BY doc_id, start, length),
    best AS (
        SELECT doc_id, count(*) AS n_runs,
               string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
        FROM run GROUP BY doc_id),
    longest AS (
        -- lengths and periods are small enough for doubles to tell different ratios apart
        SELECT doc_id, start, length, period FROM run
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
    dropped AS (
        SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
    word AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, n)) AS i FROM t WHERE n > 0),
    kept AS (
        SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
           CAST(1000 * length // period AS BIGINT) AS exponent_milli,
           sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def runs_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.runs(documents(spark, sf_dir), planted_tail))


@query(
    "op13_multi_index",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    link AS (
        SELECT a.vec_id AS u, b.vec_id AS v FROM v a, v b
        WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
    reach(vec_id, r) AS (
        SELECT vec_id, vec_id FROM embeddings
        UNION SELECT link.v, reach.r FROM reach JOIN link ON link.u = reach.vec_id AND reach.r < link.v)
    SELECT e.vec_id, coalesce(n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM link GROUP BY u) k ON k.u = e.vec_id
    JOIN (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = e.vec_id
    """,
)
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(documents(spark, sf_dir, "embeddings"))
