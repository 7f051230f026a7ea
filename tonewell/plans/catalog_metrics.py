"""Registered queries: metrics, detection reports, histories, token choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.operators import decoding, detection, history, metrics, ratings
from tonewell.plans.registry import query, sql_u, table


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("x"), "label")


V_SQL = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings),
cells AS (SELECT vec_id, label, unnest(x) AS e, generate_subscripts(x, 1) - 1 AS i FROM v)
"""
SOFT_SQL = """
soft AS (SELECT vec_id, label, i, exp(e - max(e) OVER w) / sum(exp(e - m)) OVER w AS p
  FROM (SELECT *, max(e) OVER (PARTITION BY vec_id) AS m FROM cells) WINDOW w AS (PARTITION BY vec_id))
"""


@query(
    "kl_divergence",
    f"""WITH {V_SQL}, {SOFT_SQL},
sharp AS (SELECT vec_id, i, exp(2 * e) / sum(exp(2 * e)) OVER (PARTITION BY vec_id) AS t FROM cells),
s AS (SELECT a.label, a.vec_id, sum(t * (ln(t) - ln(p + 1e-6))) AS pq, sum(p * (ln(p) - ln(t + 1e-6))) AS qp
  FROM soft a JOIN sharp b USING (vec_id, i) GROUP BY a.label, a.vec_id)
SELECT label, round(avg(pq), 9) AS kld_pq, round(avg(qp), 9) AS kld_qp, round(avg(pq) + avg(qp), 9) AS kld_both,
  round(avg(pq), 9) AS kld FROM s GROUP BY label""",
)
def kl_divergence(spark, sf):
    pairs = vectors(spark, sf).select(
        "label", A.softmax(F.col("x")).alias("pred"), A.softmax(F.col("x"), 0.5).alias("target")
    )
    out = metrics.kl_divergence(pairs, ["label"])
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("kld_pq", "kld_qp", "kld_both", "kld")])


@query(
    "text_consistency",
    f"""WITH {V_SQL}, d AS (SELECT vec_id, label, list_dot_product(x, y) / (greatest(sqrt(list_dot_product(x, x)), 1e-8)
     * greatest(sqrt(list_dot_product(y, y)), 1e-8)) AS c
  FROM (SELECT vec_id, label, x, list_transform(x, lambda e: e * e + 0.1) AS y FROM v))
SELECT label, count(*) AS pairs, round(avg(c), 9) AS consistency FROM d GROUP BY label""",
)
def text_consistency(spark, sf):
    pairs = vectors(spark, sf).withColumn("y", F.transform("x", lambda e: e * e + 0.1))
    out = metrics.text_consistency(pairs, "x", "y", ["label"])
    return out.select("label", "pairs", F.round("consistency", 9).alias("consistency"))


# Frames: a vector is one frame of its label; a label is one item.
@query(
    "frame_cosine",
    f"""WITH {V_SQL},
f AS (SELECT vec_id, label, x, list_transform(x, lambda e: abs(e)) AS y,
   row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(label * 700 + 350 AS BIGINT) AS size FROM v),
s AS (SELECT label, CASE WHEN frame < ceil(size / 128) THEN list_dot_product(x, y)
    / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END AS c, ceil(size / 128) AS w FROM f),
p AS (SELECT label, sum(c) AS c, max(w) AS w FROM s GROUP BY label)
SELECT round(sum(c) / sum(w), 9) AS cosine, CAST(sum(w) AS BIGINT) AS frames FROM p""",
)
def frame_cosine(spark, sf):
    from tonewell.plans.catalog_joins import track_frames

    rows = track_frames(spark, sf).select(
        F.col("track").alias("item"),
        "frame",
        (F.col("track") * 700 + 350).alias("size"),
        A.doubles(F.col("embedding")).alias("pred"),
    )
    pairs = rows.withColumn("target", F.transform("pred", F.abs))
    return metrics.frame_cosine(pairs, 128).withColumn("cosine", F.round("cosine", 9))


LABELLED = "documents d JOIN labels l ON d.doc_id = l.doc_id"


@query(
    "miou",
    f"""WITH i AS (SELECT lang, source, sum(CAST(toxic > 0.5 AND quality <> 0 AS BIGINT)) AS i,
    sum(CAST(toxic > 0.5 OR quality <> 0 AS BIGINT)) AS u FROM {LABELLED} GROUP BY lang, source)
SELECT lang, round(avg(CASE WHEN u > 0 THEN i / u ELSE 'nan'::DOUBLE END), 9) AS miou FROM i GROUP BY lang""",
)
def miou(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    frames = docs.join(table(spark, sf, "labels"), "doc_id").select(
        "lang", "source", F.col("toxic").cast("double").alias("pred"), F.col("quality").alias("truth")
    )
    return metrics.miou(frames, "source", ["lang"]).withColumn("miou", F.round("miou", 9))


@query(
    "localisation",
    f"""WITH f AS (SELECT lang, source, toxic, quality FROM {LABELLED}),
i AS (SELECT lang, source, sum(CAST(toxic > 0.5 AND quality <> 0 AS BIGINT)) AS i,
    sum(CAST(toxic > 0.5 OR quality <> 0 AS BIGINT)) AS u FROM f GROUP BY lang, source)
SELECT a.lang AS scenario, a.accuracy, m.miou FROM (
  SELECT lang, round(avg(CAST(CAST(toxic > 0.5 AS INTEGER) = quality AS INTEGER)), 9) AS accuracy FROM f GROUP BY lang) a
JOIN (SELECT lang, round(avg(i / u), 9) AS miou FROM i WHERE u > 0 GROUP BY lang) m ON a.lang = m.lang""",
)
def localisation(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("scenario"), "source")
    frames = docs.join(table(spark, sf, "labels"), "doc_id").select(
        "scenario", "source", F.col("toxic").cast("double").alias("pred"), F.col("quality").alias("truth")
    )
    accuracy = detection.localisation_accuracy(frames)
    overlap = metrics.miou(frames, "source", ["scenario"], skip_empty=True)
    return accuracy.join(overlap, "scenario").select(
        "scenario", F.round("accuracy", 9).alias("accuracy"), F.round("miou", 9).alias("miou")
    )


# Detector outputs: a vector is an item with 64 time steps, its label the augmentation.


def detector(spark, sf, sign: float):
    cells = vectors(spark, sf).select(
        F.col("vec_id").alias("item"), F.col("label").alias("aug"), F.posexplode("x").alias("t", "e")
    )
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-8.0 * sign) * (F.col("e") + F.lit(0.01))))
    return cells.select(
        "item",
        "aug",
        "t",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("channel"), (1.0 - p1).alias("value")),
                F.struct(F.lit(1).alias("channel"), p1.alias("value")),
            )
        ).alias("c"),
    ).select("item", "aug", "t", "c.channel", "c.value")


def sql_p1(sign: float) -> str:
    return f"(1.0 / (1.0 + exp({-8.0 * sign} * (e + 0.01))))"


ITEMS_SQL = f"""
pos AS (SELECT vec_id, label, avg(1.0 - {sql_p1(1.0)}) AS c0, avg({sql_p1(1.0)}) AS c1 FROM cells GROUP BY 1, 2),
neg AS (SELECT vec_id, label, avg(1.0 - {sql_p1(-1.0)}) AS c0, avg({sql_p1(-1.0)}) AS c1 FROM cells GROUP BY 1, 2),
items AS (SELECT *, true AS positive FROM pos UNION ALL SELECT *, false FROM neg)
"""
REPORT_SQL = """
round(sum(CASE WHEN positive THEN CAST(c1 > 0.5 AS INTEGER) ELSE CAST(c0 > 0.5 AS INTEGER) END)
   / (2.0 * sum(CAST(positive AS INTEGER))), 9) AS acc,
 round(avg(CASE WHEN NOT positive THEN CAST(c1 > 0.5 AS INTEGER) END), 9) AS fpr,
 round(avg(CASE WHEN positive THEN CAST(c0 > 0.5 AS INTEGER) END), 9) AS fnr
"""


@query(
    "detection_report",
    f"""WITH {V_SQL}, {ITEMS_SQL}
SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE CAST(label AS VARCHAR) END AS aug, {REPORT_SQL}
FROM items GROUP BY GROUPING SETS ((label), ())""",
)
def detection_report(spark, sf):
    report = detection.augmentation_report(detector(spark, sf, 1.0), detector(spark, sf, -1.0))
    return report.select("aug", *[F.round(c, 9).alias(c) for c in ("acc", "fpr", "fnr")])


@query(
    "detection_rates",
    f"""WITH {V_SQL}, {ITEMS_SQL} SELECT label AS aug, {REPORT_SQL} FROM items GROUP BY label""",
)
def detection_rates(spark, sf):
    pos, neg = detector(spark, sf, 1.0), detector(spark, sf, -1.0)
    out = detection.detection_accuracy(pos, neg, ["aug"])
    out = out.join(detection.false_positive_rate(neg, ["aug"]), "aug")
    out = out.join(detection.false_negative_rate(pos, ["aug"]), "aug")
    return out.select("aug", *[F.round(c, 9).alias(c) for c in ("acc", "fpr", "fnr")])


@query(
    "reweighted_augmentations",
    f"""WITH {V_SQL}, {ITEMS_SQL}, r AS (SELECT label, {REPORT_SQL} FROM items GROUP BY label)
SELECT label AS aug, CASE WHEN label = 3 THEN -1.0 ELSE round(greatest(1.0 - acc, 0.05), 9) END::DOUBLE AS weight FROM r""",
)
def reweighted_augmentations(spark, sf):
    report = detection.detection_accuracy(detector(spark, sf, 1.0), detector(spark, sf, -1.0), ["aug"])
    weights = vectors(spark, sf).select(
        F.col("label").alias("aug"), F.when(F.col("label") == 3, -1.0).otherwise(1.0).alias("weight")
    ).distinct()
    out = detection.reweight_augmentations(weights, report)
    return out.select("aug", F.round("weight", 9).alias("weight"))


# Message bits: bit = position div 16, time = position mod 16; bit b of the label is expected.


def bits(spark, sf):
    cells = vectors(spark, sf).select(
        F.col("vec_id").alias("item"), F.col("label").alias("aug"), F.posexplode("x").alias("i", "value")
    )
    decoded = cells.select(
        "item", "aug", F.floor(F.col("i") / 16).cast("int").alias("bit"), (F.col("i") % 16).alias("t"), "value"
    )
    message = vectors(spark, sf).select(
        F.col("vec_id").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bit"), "label"
    ).select("item", "bit", F.expr("int(label / power(2, bit)) % 2").alias("expected"))
    mask = vectors(spark, sf).select(
        F.col("vec_id").alias("item"), F.posexplode("x").alias("t", "e")
    ).filter(F.col("t") < 16).select("item", "t", (F.col("e") < 0.1).cast("int").alias("keep"))
    return decoded, message, mask


BITS_SQL = """
decoded AS (SELECT vec_id, label, CAST(floor(i / 16) AS INTEGER) AS bit, i % 16 AS t, e FROM cells),
message AS (SELECT vec_id, bit, CAST(floor(label / power(2, bit)) AS INTEGER) % 2 AS expected
  FROM v, (SELECT unnest(range(4)) AS bit)),
mask AS (SELECT vec_id, i AS t, e < 0.1 AS keep FROM cells WHERE i < 16)
"""


@query(
    "bit_accuracy",
    f"""WITH {V_SQL}, {BITS_SQL},
votes AS (SELECT d.label, d.vec_id, d.bit, CAST(avg(e) > 0 AS INTEGER) AS said FROM decoded d
   JOIN mask m ON d.vec_id = m.vec_id AND d.t = m.t AND m.keep GROUP BY 1, 2, 3)
SELECT label AS aug, round(avg(CAST(said = expected AS INTEGER)), 9) AS bit_acc
FROM votes JOIN message USING (vec_id, bit) GROUP BY label""",
)
def bit_accuracy(spark, sf):
    decoded, message, mask = bits(spark, sf)
    return detection.bit_accuracy(decoded, message, mask, ["aug"]).withColumn("bit_acc", F.round("bit_acc", 9))


@query(
    "message_losses",
    f"""WITH {V_SQL}, {BITS_SQL},
j AS (SELECT e / 0.3 AS x, expected AS y FROM decoded d JOIN mask m ON d.vec_id = m.vec_id AND d.t = m.t AND m.keep
   JOIN message g ON g.vec_id = d.vec_id AND g.bit = d.bit)
SELECT round(avg(greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x)))), 6) AS bce, round(avg((x - y) * (x - y)), 6) AS mse FROM j""",
)
def message_losses(spark, sf):
    decoded, message, mask = bits(spark, sf)
    rows = decoded.join(mask.withColumnRenamed("keep", "mask"), ["item", "t"])
    bce = detection.message_loss(rows, message, 0.3, "bce").select(F.round("loss", 6).alias("bce"), F.lit(1).alias("k"))
    mse = detection.message_loss(rows, message, 0.3, "mse").select(F.round("loss", 6).alias("mse"), F.lit(1).alias("k"))
    return bce.join(mse, "k").drop("k")


@query(
    "detection_losses",
    f"""WITH {V_SQL},
p AS (SELECT {sql_p1(1.0)} AS p1, e < 0.2 AS keep, {sql_p1(-1.0)} AS n1 FROM cells)
SELECT round((SELECT avg(-ln(CASE WHEN keep THEN p1 ELSE 1.0 - p1 END)) FROM p), 6) AS masked,
  round((SELECT 2.0 * avg(-ln(p1)) + 0.5 * avg(-ln(1.0 - n1)) FROM p), 6) AS complete""",
)
def detection_losses(spark, sf):
    cells = vectors(spark, sf).select(F.posexplode("x").alias("t", "e"))

    def side(sign, mask):
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-8.0 * sign) * (F.col("e") + F.lit(0.01))))
        return cells.select((1.0 - p1).alias("p0"), p1.alias("p1"), mask.cast("int").alias("mask"))

    masked = detection.detection_nll(side(1.0, F.col("e") < 0.2), side(-1.0, F.lit(True)))
    complete = detection.detection_nll(side(1.0, F.lit(True)), side(-1.0, F.lit(True)), 2.0, 0.5)
    one = F.lit(1).alias("k")
    return (
        masked.select(F.round("loss", 6).alias("masked"), one)
        .join(complete.select(F.round("loss", 6).alias("complete"), one), "k")
        .drop("k")
    )


# Cross entropy: a vector holds the logits of one position, its label is the codebook.
CE_SQL = f"""
WITH {V_SQL}, ce AS (SELECT label, x[1] AS first, ln(list_sum(list_transform(x, lambda e: exp(e))))
   - x[CAST(vec_id % 64 AS INTEGER) + 1] AS ce FROM v)
"""


def logits(spark, sf):
    return vectors(spark, sf).select(
        F.col("label").alias("q"), "x", (F.col("vec_id") % 64).cast("int").alias("target")
    )


@query(
    "cross_entropy",
    f"""{CE_SQL}, m AS (SELECT CAST(label AS VARCHAR) AS scope, avg(ce) AS ce FROM ce WHERE first > -0.1 GROUP BY label),
o AS (SELECT scope, ce FROM m UNION ALL SELECT 'all', avg(ce) FROM m)
SELECT scope, round(ce, 9) AS ce, round(exp(ce), 6) AS ppl FROM o""",
)
def cross_entropy(spark, sf):
    out = metrics.cross_entropy(logits(spark, sf), "x", "target", F.get("x", F.lit(0)) > -0.1)
    return out.select("scope", F.round("ce", 9).alias("ce"), F.round("ppl", 6).alias("ppl"))


@query("stage_cross_entropy", f"{CE_SQL} SELECT round(avg(ce), 9) AS ce FROM ce WHERE label = 4 AND first > -0.1")
def stage_cross_entropy(spark, sf):
    out = metrics.stage_cross_entropy(logits(spark, sf), "x", "target", F.get("x", F.lit(0)) > -0.1, 4)
    return out.select(F.round("ce", 9).alias("ce"))


@query(
    "stage_means",
    f"""SELECT event_type || '_' || CAST(CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 * 4) AS INTEGER) AS VARCHAR) AS name,
  round(avg(value), 6) AS value FROM events
WHERE floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 * 4) BETWEEN 0 AND 3 GROUP BY 1""",
)
def stage_means(spark, sf):
    losses = table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("int").alias("step"), "value"
    )
    return metrics.per_stage_mean(losses, 100, 4).withColumn("value", F.round("value", 6))


@query(
    "weighted_worker_means",
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS value
FROM lineitem GROUP BY 1, 2""",
)
def weighted_worker_means(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    out = metrics.average_metrics(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")
    return out.withColumn("value", F.round("value", 4))


@query(
    "loss_ratios",
    """WITH n AS (SELECT user_id, event_type AS name, avg(value) AS norm, max(length(event_type)) AS weight
   FROM events GROUP BY 1, 2)
SELECT user_id, name, round(norm / sum(norm) OVER w, 9) AS ratio, round(weight / sum(weight) OVER w, 9) AS desired
FROM n WINDOW w AS (PARTITION BY user_id)""",
)
def loss_ratios(spark, sf):
    norms = table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("name"), F.col("value").alias("norm"), F.length("event_type").alias("weight")
    )
    out = metrics.loss_ratios(norms, "user_id")
    return out.select("user_id", "name", F.round("ratio", 9).alias("ratio"), F.round("desired", 9).alias("desired"))


@query(
    "score_means",
    """SELECT event_type, round(coalesce(avg(CASE WHEN value > 400 THEN value END), 0.0), 6) AS score FROM events GROUP BY 1""",
)
def score_means(spark, sf):
    scores = table(spark, sf, "events").select("event_type", F.when(F.col("value") > 400, F.col("value")).alias("score"))
    return metrics.score_table_mean(scores, "score", ["event_type"]).withColumn("score", F.round("score", 6))


@query(
    "mos",
    """WITH r AS (SELECT o_orderpriority AS model, CAST(ceil(l_quantity / 10.0) AS INTEGER) AS rating
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT model, count(*) AS samples, round(avg(rating), 9) AS mean_rating,
  round(1.96 * stddev_pop(rating) / sqrt(count(*)), 9) AS interval,
  printf('%.2f', avg(rating)) AS mean_text, printf('%.2f', 1.96 * stddev_pop(rating) / sqrt(count(*))) AS interval_text
FROM r WHERE rating BETWEEN 1 AND 5 GROUP BY model""",
)
def mos(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model"))
    rated = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "model", F.ceil(F.col("l_quantity") / 10.0).cast("int").alias("rating")
    )
    out = ratings.mos(rated)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_rating", "interval")})


# Histories: a user is a run, a day an epoch, an event type a metric.
HISTORY_SQL = f"""
h AS (SELECT CAST(user_id AS VARCHAR) AS run, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS epoch, CASE WHEN event_type = 'click' THEN 'valid' ELSE 'train' END AS stage,
  CASE WHEN event_type = 'view' THEN 'duration' ELSE event_type END AS metric, max(value) AS value FROM events GROUP BY ALL)
"""


def run_history(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy(
        F.col("user_id").cast("string").alias("run"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("epoch"),
        F.when(F.col("event_type") == "click", "valid").otherwise("train").alias("stage"),
        F.when(F.col("event_type") == "view", "duration").otherwise(F.col("event_type")).alias("metric"),
    ).agg(F.max("value").alias("value"))


@query(
    "best_so_far",
    f"""WITH {HISTORY_SQL} SELECT run, metric, CAST(epoch AS INTEGER) AS epoch, value, min(value) OVER w AS best, value = min(value) OVER w AS is_new_best
FROM h WINDOW w AS (PARTITION BY run, stage, metric ORDER BY epoch ROWS UNBOUNDED PRECEDING)""",
)
def best_so_far(spark, sf):
    out = history.best_so_far(run_history(spark, sf), ["run", "stage", "metric"], block=7)
    return out.select("run", "metric", "epoch", "value", "best", "is_new_best")


@query(
    "latest_stage",
    f"""WITH {HISTORY_SQL} SELECT run, stage, metric, round(max_by(CASE WHEN metric = 'duration' THEN value / 60 ELSE value END, epoch), 9) AS value
FROM h GROUP BY 1, 2, 3 UNION ALL SELECT run, 'train', 'epoch', CAST(max(epoch) AS DOUBLE) FROM h GROUP BY run""",
)
def latest_stage(spark, sf):
    return history.merge_latest_stage(run_history(spark, sf)).withColumn("value", F.round("value", 9))


@query(
    "best_metric",
    f"""WITH {HISTORY_SQL} SELECT run, 'best_' || metric AS metric, CASE WHEN metric = 'click' THEN min(value) ELSE max(value) END AS value
FROM h WHERE stage = 'valid' GROUP BY run, metric""",
)
def best_metric(spark, sf):
    return history.best_metric(run_history(spark, sf), {"click": "lower", "error": "higher"})


# Token choice: a vector holds the logits of one decoding step.
STEP_SQL = f"""WITH {V_SQL},
probs AS (SELECT vec_id, i AS token, exp((e - m) / 0.25) / sum(exp((e - m) / 0.25)) OVER (PARTITION BY vec_id) AS p
   FROM (SELECT *, max(e) OVER (PARTITION BY vec_id) AS m FROM cells))"""
TOPK_SQL = """topk AS (SELECT vec_id, token, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM (
   SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY p DESC) AS r FROM probs) WHERE r <= 8)"""
TOPP_SQL = """topp AS (SELECT vec_id, token, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM (
   SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) - p AS b FROM probs)
   WHERE round(b, 12) <= 0.6)"""


def step_tokens(spark, sf, choose):
    """(vec_id, token, p) of the tokens that ``choose`` keeps."""
    probs = decoding.token_probabilities(F.col("x"), 0.25)
    rows = vectors(spark, sf).select("vec_id", F.inline(choose(probs)))
    return rows.withColumn("p", F.round("p", 9))


@query("top_k_filter", f"{STEP_SQL}, {TOPK_SQL} SELECT vec_id, CAST(token AS INTEGER) AS token, round(p, 9) AS p FROM topk")
def top_k_filter(spark, sf):
    return step_tokens(spark, sf, lambda probs: decoding.top_k_filter(probs, 8))


@query("nucleus_filter", f"{STEP_SQL}, {TOPP_SQL} SELECT vec_id, CAST(token AS INTEGER) AS token, round(p, 9) AS p FROM topp")
def nucleus_filter(spark, sf):
    return step_tokens(spark, sf, lambda probs: decoding.nucleus_filter(probs, 0.6))


@query(
    "categorical_draw",
    f"""{STEP_SQL}, {TOPP_SQL}, {TOPK_SQL},
hit_p AS (SELECT vec_id, min(token) AS token FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY token ROWS UNBOUNDED PRECEDING) AS c FROM topp)
   WHERE c > {sql_u('tok', 'vec_id')} GROUP BY vec_id),
hit_k AS (SELECT vec_id, min(token) AS token FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY token ROWS UNBOUNDED PRECEDING) AS c FROM topk)
   WHERE c > {sql_u('tok', 'vec_id')} GROUP BY vec_id),
hit AS (SELECT vec_id, min(token) AS token FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY token ROWS UNBOUNDED PRECEDING) AS c FROM probs)
   WHERE c > {sql_u('tok', 'vec_id')} GROUP BY vec_id)
SELECT v.vec_id, CAST(hit_p.token AS INTEGER) AS nucleus, CAST(hit_k.token AS INTEGER) AS top_k, CAST(hit.token AS INTEGER) AS plain,
  CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS greedy
FROM v JOIN hit_p USING (vec_id) JOIN hit_k USING (vec_id) JOIN hit USING (vec_id)""",
)
def categorical_draw(spark, sf):
    rows = vectors(spark, sf)

    choices = {
        "nucleus": {"temperature": 0.25, "top_p": 0.6, "top_k": 3},
        "top_k": {"temperature": 0.25, "top_k": 8},
        "plain": {"temperature": 0.25},
        "greedy": {"temperature": 0.0},
    }
    for name, how in choices.items():
        rows = decoding.categorical_draw(rows, "vec_id", "x", "tok", out=name, **how)
    return rows.select("vec_id", *choices)


@query(
    "guided_scores",
    f"""WITH {V_SQL},
s AS (SELECT vec_id, i, e AS c, e * e AS w, abs(e) AS u FROM cells)
SELECT vec_id, CAST(i AS INTEGER) AS token, round(u + 3.0 * (c - u), 9) AS single, round(u + 3.0 * (w + 2.0 * (c - w) - u), 9) AS double,
  round(0.5 * c + 0.3 * w + 0.2 * u, 9) AS weighted FROM s""",
)
def guided_scores(spark, sf):
    rows = vectors(spark, sf).select(
        "vec_id", F.col("x").alias("c"), F.transform("x", lambda e: e * e).alias("w"), F.transform("x", F.abs).alias("u")
    )
    scored = rows.select(
        "vec_id",
        F.arrays_zip(
            A.guided_scores(F.col("c"), F.col("u"), 3.0).alias("single"),
            A.double_guided_scores(F.col("c"), F.col("w"), F.col("u"), 3.0, 2.0).alias("double"),
            A.weighted_scores([(0.5, F.col("c")), (0.3, F.col("w")), (0.2, F.col("u"))]).alias("weighted"),
        ).alias("z"),
    )
    return scored.select("vec_id", F.posexplode("z").alias("token", "s")).select(
        "vec_id", "token", *[F.round(F.col("s")[n], 9).alias(n) for n in ("single", "double", "weighted")]
    )
