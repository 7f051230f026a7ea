"""Registered queries: quantisation, covariance and feature statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.operators import covariance, quantise
from tonewell.plans.catalog_metrics import V_SQL, vectors
from tonewell.plans.registry import query, sql_u, table

K = 8
# Start codes: the first K vectors of a seeded shuffle.
START_SQL = f"""
{V_SQL},
book0 AS (SELECT row_number() OVER (ORDER BY {sql_u('km', 'vec_id')}, vec_id) - 1 AS code, x FROM v
  QUALIFY code < {K})
"""


def assign_sql(source: str, book: str) -> str:
    """Nearest code per vector of ``source`` (vec_id, x)."""
    return f"""(SELECT vec_id, arg_min(code, {{'d': round(d, 9), 'c': code}}) AS code FROM (
   SELECT s.vec_id, b.code, list_dot_product(b.x, b.x) - 2.0 * list_dot_product(s.x, b.x) AS d
   FROM {source} s, {book} b) GROUP BY vec_id)"""


def means_sql(assigned: str, book: str) -> str:
    """Next codebook: mean of the members, the old code when there is none."""
    return f"""(SELECT b.code, CASE WHEN m.x IS NULL THEN b.x ELSE m.x END AS x FROM {book} b LEFT JOIN (
   SELECT code, list(e ORDER BY i) AS x FROM (SELECT a.code, c.i, avg(c.e) AS e FROM {assigned} a
     JOIN cells c ON c.vec_id = a.vec_id GROUP BY a.code, c.i) GROUP BY code) m ON m.code = b.code)"""


def _lloyd_sql(iterations: int) -> str:
    parts = [START_SQL]
    for k in range(iterations):
        parts.append(f"assigned{k} AS {assign_sql('v', f'book{k}')}")
        parts.append(f"book{k + 1} AS {means_sql(f'assigned{k}', f'book{k}')}")
    return ",\n".join(parts)


def start_codes(spark, sf) -> np.ndarray:
    return quantise.init_centroids(vectors(spark, sf), "x", "vec_id", K, "km")


@query("vq_assign", f"WITH {START_SQL} SELECT vec_id, CAST(code AS INTEGER) AS code FROM {assign_sql('v', 'book0')}")
def vq_assign(spark, sf):
    return quantise.quantise(vectors(spark, sf), "x", start_codes(spark, sf)).select("vec_id", "code")


@query(
    "lloyd_step",
    f"""WITH {_lloyd_sql(1)} SELECT CAST(code AS INTEGER) AS code, CAST(i - 1 AS INTEGER) AS dim, round(e, 6) AS value
FROM (SELECT code, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM book1)""",
)
def lloyd_step(spark, sf):
    means, _ = quantise.kmeans(vectors(spark, sf), "x", start_codes(spark, sf), 1)
    rows = quantise.book_table(spark, means)
    return rows.select("code", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    "kmeans_multi",
    f"""WITH {_lloyd_sql(4)} SELECT CAST(code AS INTEGER) AS code, n, CAST(i - 1 AS INTEGER) AS dim, round(e, 6) AS value
FROM (SELECT b.code, coalesce(n, 0) AS n, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM book4 b LEFT JOIN (SELECT code, count(*) AS n FROM assigned3 GROUP BY code) c ON c.code = b.code)""",
)
def kmeans_multi(spark, sf):
    means, counts = quantise.kmeans(vectors(spark, sf), "x", start_codes(spark, sf), 4)
    rows = [(i, int(n), [float(v) for v in m]) for i, (n, m) in enumerate(zip(counts, means))]
    out = spark.createDataFrame(rows, "code int, n bigint, vector array<double>")
    return out.select("code", "n", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))


def residual_books(spark, sf):
    """Three stage codebooks from the start codes, each half as large as the one before."""
    start = start_codes(spark, sf)
    return [start, start * 0.5, start * 0.25]


def _rvq_sql() -> str:
    parts = [START_SQL, "r0 AS (SELECT vec_id, x FROM v)"]
    for q, factor in enumerate((1.0, 0.5, 0.25)):
        parts.append(f"b{q} AS (SELECT code, list_transform(x, lambda e: e * {factor}) AS x FROM book0)")
        parts.append(f"a{q} AS {assign_sql(f'r{q}', f'b{q}')}")
        parts.append(
            f"""r{q + 1} AS (SELECT r.vec_id, list_transform(list_zip(r.x, b.x), lambda z: z[1] - z[2]) AS x
   FROM r{q} r JOIN a{q} a ON a.vec_id = r.vec_id JOIN b{q} b ON b.code = a.code)"""
        )
    return ",\n".join(parts)


@query(
    "rvq_codes",
    f"""WITH {_rvq_sql()} SELECT vec_id, CAST(a0.code AS INTEGER) AS c0, CAST(a1.code AS INTEGER) AS c1, CAST(a2.code AS INTEGER) AS c2
FROM a0 JOIN a1 USING (vec_id) JOIN a2 USING (vec_id)""",
)
def rvq_codes(spark, sf):
    out = quantise.rvq_encode(vectors(spark, sf), "x", residual_books(spark, sf))
    return out.select("vec_id", *[F.get("codes", F.lit(q)).alias(f"c{q}") for q in range(3)])


@query(
    "rvq_decoded",
    f"""WITH {_rvq_sql()}, s AS (SELECT v.vec_id, unnest(list_transform(list_zip(v.x, r3.x), lambda z: z[1] - z[2])) AS e, unnest(range(64)) AS dim
  FROM v JOIN r3 ON r3.vec_id = v.vec_id)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(e, 6) AS value FROM s""",
)
def rvq_decoded(spark, sf):
    books = residual_books(spark, sf)
    encoded = quantise.rvq_encode(vectors(spark, sf), "x", books)
    codes = encoded.select("vec_id", F.posexplode("codes").alias("q", "code"))
    decoded = quantise.rvq_decode(codes, quantise.long_books(spark, books), "vec_id")
    return decoded.withColumn("value", F.round("value", 6))


@query(
    "commitment_error",
    f"""WITH {_rvq_sql()} """
    + " UNION ALL ".join(
        f"SELECT {q} AS q, round(avg(list_sum(list_transform(x, lambda e: e * e)) / 64), 9) AS error FROM r{q + 1}" for q in range(3)
    ),
)
def commitment_error(spark, sf):
    out = quantise.commitment_error(quantise.rvq_encode(vectors(spark, sf), "x", residual_books(spark, sf)))
    return out.withColumn("error", F.round("error", 9))


@query(
    "dequantised",
    f"""WITH {START_SQL}, a AS {assign_sql('v', 'book0')}
SELECT a.vec_id, CAST(a.code AS INTEGER) AS code, round(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance
FROM a JOIN v ON v.vec_id = a.vec_id JOIN book0 b ON b.code = a.code""",
)
def dequantised(spark, sf):
    book = start_codes(spark, sf)
    codes = quantise.quantise(vectors(spark, sf), "x", book)
    out = quantise.dequantise(codes, quantise.book_table(spark, book))
    return out.select("vec_id", "code", F.round(A.squared_distance(F.col("x"), F.col("vector")), 6).alias("distance"))


@query(
    "codebook_usage",
    """WITH c AS (SELECT l_linenumber AS q, CAST(l_quantity AS INTEGER) AS code, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT q, CAST(unnest(range((SELECT max(code) + 1 FROM c))) AS INTEGER) AS code FROM (SELECT DISTINCT q FROM c))
SELECT e.q, e.code, coalesce(n, 0) AS n FROM e LEFT JOIN c ON c.q = e.q AND c.code = e.code""",
)
def codebook_usage(spark, sf):
    codes = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("q"), F.col("l_quantity").cast("int").alias("code")
    )
    bins = (codes.agg(F.max("code")).first()[0] or 0) + 1
    return quantise.codebook_usage(codes, bins)


EMA_SQL = f"""
WITH {START_SQL}, a AS {assign_sql('v', 'book0')},
n AS (SELECT code, count(*) AS n FROM a GROUP BY code),
s AS (SELECT a.code, c.i AS dim, sum(c.e) AS s FROM a JOIN cells c ON c.vec_id = a.vec_id GROUP BY 1, 2),
st AS (SELECT b.code, CAST(generate_subscripts(b.x, 1) - 1 AS INTEGER) AS dim, unnest(b.x) AS e FROM book0 b),
m AS (SELECT st.code, st.dim, 0.9 * 10.0 + 0.1 * coalesce(n.n, 0) AS cluster_size, 0.9 * st.e * 10.0 + 0.1 * coalesce(s.s, 0) AS embed_avg
  FROM st LEFT JOIN n ON n.code = st.code LEFT JOIN s ON s.code = st.code AND s.dim = st.dim),
t AS (SELECT sum(cluster_size) AS t FROM m WHERE dim = 0)
SELECT CAST(code AS INTEGER) AS code, dim, round(cluster_size, 6)::DOUBLE AS cluster_size, round(embed_avg, 6) AS embed_avg,
  round(embed_avg / ((cluster_size + 1e-5) / (t + {K} * 1e-5) * t), 6) AS embed FROM m, t
"""


@query("codebook_ema", EMA_SQL)
def codebook_ema(spark, sf):
    book = start_codes(spark, sf)
    state = quantise.book_table(spark, book).select(
        "code", F.posexplode("vector").alias("dim", "e")
    ).select("code", "dim", F.lit(10.0).alias("cluster_size"), (F.col("e") * 10.0).alias("embed_avg"))
    out = quantise.codebook_ema(state, quantise.assignment_stats(vectors(spark, sf), "x", book), 0.9, K)
    return out.withColumns({c: F.round(c, 6) for c in ("cluster_size", "embed_avg", "embed")})


@query(
    "expired_codes",
    f"""WITH {START_SQL}, a AS {assign_sql('v', 'book0')}, n AS (SELECT code, count(*) AS n FROM a GROUP BY code),
f AS (SELECT row_number() OVER (ORDER BY {sql_u('fresh', 'vec_id')}, vec_id) - 1 AS code, x FROM v QUALIFY code < {K})
SELECT CAST(b.code AS INTEGER) AS code, coalesce(n, 0) AS n, round((CASE WHEN coalesce(n, 0) < 60 THEN f.x ELSE b.x END)[1], 6) AS first
FROM book0 b LEFT JOIN n ON n.code = b.code JOIN f ON f.code = b.code""",
)
def expired_codes(spark, sf):
    rows, book = vectors(spark, sf), start_codes(spark, sf)
    counts = quantise.quantise(rows, "x", book).groupBy("code").agg(F.count(F.lit(1)).alias("cluster_size"))
    state = quantise.book_table(spark, book).join(counts, "code", "left").fillna(0, ["cluster_size"])
    out = quantise.expire_codes(state, rows, "x", "vec_id", K, 60, "fresh")
    return out.select("code", F.col("cluster_size").alias("n"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@query(
    "bandwidths",
    "SELECT p_partkey, round(p_size * log2(1024) * 75 / 1000.0, 9)::DOUBLE AS kbps FROM part",
)
def bandwidths(spark, sf):
    rate = quantise.bandwidth(F.col("p_size"), F.lit(1024), F.lit(75))
    return table(spark, sf, "part").select("p_partkey", F.round(rate, 9).alias("kbps"))


@query(
    "orthogonality",
    f"""WITH {V_SQL}, u AS (SELECT vec_id, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x FROM v)
SELECT round(sum(power(list_dot_product(a.x, b.x) - CAST(a.vec_id = b.vec_id AS INTEGER), 2)) / power(count(DISTINCT a.vec_id), 2), 9) AS loss,
  count(DISTINCT a.vec_id) AS codes FROM u a, u b""",
)
def orthogonality(spark, sf):
    book = vectors(spark, sf).withColumnRenamed("vec_id", "code")
    return covariance.orthogonality(book, "x").withColumn("loss", F.round("loss", 9))


@query(
    "embedding_cov",
    f"""WITH {V_SQL} SELECT a.label, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, count(*) AS n, round(avg(a.e), 6) AS mean_i,
  round(avg(b.e), 6) AS mean_j, round(covar_samp(a.e, b.e), 6) AS cov
FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.label, a.i, b.i""",
)
def embedding_cov(spark, sf):
    out = covariance.embedding_mean_cov(vectors(spark, sf), "x", "label")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_i", "mean_j", "cov")})


@query(
    "frechet_diag",
    f"""WITH {V_SQL}, m AS (SELECT label, i, avg(e) AS m1, var_samp(e) AS v1, avg(e * e) AS m2, var_samp(e * e) AS v2 FROM cells GROUP BY label, i)
SELECT label, round(sum((m1 - m2) * (m1 - m2) + v1 + v2 - 2 * sqrt(v1 * v2)), 6) AS distance FROM m GROUP BY label""",
)
def frechet_diag(spark, sf):
    rows = vectors(spark, sf)
    other = rows.withColumn("x", F.transform("x", lambda e: e * e))
    out = covariance.frechet_distance_diagonal(rows, other, "x", "label")
    return out.withColumn("distance", F.round("distance", 6))


# For an affine copy y = x / 2 + 0.1 the root of the covariance product is half the
# covariance, which gives the full distance in closed form.
@query(
    "frechet_full",
    f"""WITH {V_SQL}, m AS (SELECT label, i, avg(e) AS m, var_samp(e) AS v FROM cells GROUP BY label, i)
SELECT label, round(sum((m * 0.5 - 0.1) * (m * 0.5 - 0.1) + 0.25 * v), 5) AS distance FROM m GROUP BY label""",
)
def frechet_full(spark, sf):
    rows = vectors(spark, sf)
    other = rows.withColumn("x", F.transform("x", lambda e: e * 0.5 + 0.1))
    out = covariance.frechet_distance(rows, other, "x", "label")
    return out.withColumn("distance", F.round("distance", 5))


@query(
    "frechet_blocks",
    f"""WITH {V_SQL}, m AS (SELECT label, i, avg(e) AS m, var_samp(e) AS v FROM cells GROUP BY label, i)
SELECT label, round(sum((m * 0.5 - 0.1) * (m * 0.5 - 0.1) + 0.25 * v), 5) AS distance FROM m GROUP BY label""",
)
def frechet_blocks(spark, sf):
    """The same with matrices in blocks of 40 rows, as for embeddings of any width."""
    rows = vectors(spark, sf)
    other = rows.withColumn("x", F.transform("x", lambda e: e * 0.5 + 0.1))
    out = covariance.frechet_distance(rows, other, "x", "label", dense_width=0, side=40)
    return out.withColumn("distance", F.round("distance", 5))


@query(
    "feature_stats",
    f"""WITH {V_SQL} SELECT CAST(i AS INTEGER) AS dim, count(*) AS n, round(avg(e), 9) AS mean, round(sqrt(greatest(avg(e * e) - avg(e) * avg(e), 0)), 9) AS std
FROM cells GROUP BY i""",
)
def feature_stats(spark, sf):
    out = covariance.feature_stats(vectors(spark, sf), "x")
    return out.select("dim", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(
    "standardised",
    f"""WITH {V_SQL}, s AS (SELECT i, avg(e) AS m, sqrt(greatest(avg(e * e) - avg(e) * avg(e), 0)) AS sd FROM cells GROUP BY i)
SELECT vec_id, CAST(c.i AS INTEGER) AS dim, round((e - m) / sd, 6) AS z, round((e - m) * power(0.5 / sd, 0.7), 6) AS scaled, round(e, 6) AS back
FROM cells c JOIN s ON s.i = c.i""",
)
def standardised(spark, sf):
    rows = vectors(spark, sf).withColumn("y", F.col("x"))
    stats = covariance.feature_stats(rows, "x")
    out = covariance.standardise(rows, stats, "x").withColumn("b", F.col("x"))
    out = covariance.rescale(out, stats, "y", 0.5, 0.7)
    out = covariance.unstandardise(out, stats, "b")
    zipped = out.select("vec_id", F.posexplode(F.arrays_zip("x", "y", "b")).alias("dim", "z"))
    return zipped.select(
        "vec_id", "dim", F.round("z.x", 6).alias("z"), F.round("z.y", 6).alias("scaled"), F.round("z.b", 6).alias("back")
    )
