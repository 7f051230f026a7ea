"""Registered queries: token layouts, masks, batch shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.operators import batches, layouts, masks
from tonewell.plans.catalog_metrics import V_SQL, vectors
from tonewell.plans.registry import heavy_table, joined, query, sql_joined, sql_u, table
from tonewell.session import spread


def codes(spark, sf):
    """A vector as 4 codebooks of 16 tokens with 1024 values."""
    cells = vectors(spark, sf).select(F.col("vec_id").alias("item"), F.posexplode("x").alias("i", "e"))
    return cells.select(
        "item",
        F.floor(F.col("i") / 16).cast("int").alias("q"),
        (F.col("i") % 16).cast("int").alias("t"),
        F.floor((F.col("e") + 1.0) * 511.0).cast("int").alias("code"),
    )


CODES_SQL = f"""
{V_SQL},
codes AS (SELECT vec_id AS item, CAST(floor(i / 16) AS INTEGER) AS q, CAST(i % 16 AS INTEGER) AS t,
  CAST(floor((e + 1.0) * 511.0) AS INTEGER) AS code FROM cells),
items AS (SELECT DISTINCT item FROM codes)
"""


def _interleave_sql(step: str, steps: int) -> str:
    return f"""WITH {CODES_SQL},
skeleton AS (SELECT item, q, s FROM items, (SELECT CAST(unnest(range(4)) AS INTEGER) AS q),
   (SELECT CAST(unnest(range({steps})) AS INTEGER) AS s)),
placed AS (SELECT item, q, {step} AS s, code FROM codes)
SELECT k.item, k.q, k.s, coalesce(p.code, 1024) AS code, p.code IS NOT NULL AS mask
FROM skeleton k LEFT JOIN placed p ON k.item = p.item AND k.q = p.q AND k.s = p.s"""


@query("interleave_delayed", _interleave_sql("1 + t + q", 20))
def interleave_delayed(spark, sf):
    return layouts.interleave(codes(spark, sf), layouts.delayed(4, 16), 1024)


@query("interleave_valid", _interleave_sql("1 + t + q", 17))
def interleave_valid(spark, sf):
    return layouts.interleave(codes(spark, sf), layouts.delayed(4, 16), 1024, valid_only=True)


@query("interleave_parallel", _interleave_sql("3 + t", 19))
def interleave_parallel(spark, sf):
    return layouts.interleave(codes(spark, sf), layouts.parallel(4, 16, empty_initial=2), 1024)


@query("interleave_flat_start", _interleave_sql("CASE WHEN t < 3 THEN 1 + t * 4 + q ELSE 10 + t + q * 2 END", 32))
def interleave_flat_start(spark, sf):
    return layouts.interleave(codes(spark, sf), layouts.delayed(4, 16, [0, 2, 4, 6], flatten_first=3), 1024)


@query("interleave_unrolled", _interleave_sql("1 + t * 4 + q", 65))
def interleave_unrolled(spark, sf):
    return layouts.interleave(codes(spark, sf), layouts.unrolled(4, 16), 1024)


@query("interleave_coarse", _interleave_sql("CASE WHEN q = 0 THEN 1 + t ELSE 16 + t + q END", 35))
def interleave_coarse(spark, sf):
    return layouts.interleave(codes(spark, sf), layouts.coarse_first(4, 16, [0, 1, 2]), 1024)


@query("interleave_grouped", _interleave_sql("CAST(1 + floor(q / 2) * 32 + t * 2 + q % 2 AS INTEGER)", 65))
def interleave_grouped(spark, sf):
    return layouts.interleave(codes(spark, sf), layouts.grouped(4, 16, 2), 1024)


@query(
    "deinterleave_delayed",
    f"""WITH {CODES_SQL} SELECT item, q, t, CASE WHEN 1 + t + q < 15 THEN code ELSE 1024 END AS code, 1 + t + q < 15 AS mask FROM codes""",
)
def deinterleave_delayed(spark, sf):
    layout = layouts.delayed(4, 16)
    sequence = layouts.interleave(codes(spark, sf), layout, 1024).filter(F.col("s") < 15).drop("mask")
    return layouts.deinterleave(sequence, layout, 1024, steps=15)


@query(
    "deinterleave_scores",
    f"""WITH {CODES_SQL} SELECT item, q, t, CASE WHEN t + q < 19 THEN (t + q + 100 * q) / 10.0 ELSE -1.0 END::DOUBLE AS score,
  t + q < 19 AS mask FROM codes""",
)
def deinterleave_scores(spark, sf):
    layout = layouts.delayed(4, 16)
    sequence = layouts.interleave(codes(spark, sf), layout, 1024)
    scores = sequence.select("item", "q", "s", ((F.col("s") + 100 * F.col("q")) / 10.0).alias("score"))
    return layouts.deinterleave(scores, layout, -1.0, model_output=True, value="score")


@query(
    "layout_lookup",
    """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, CAST(1 + l_quantity + 2 * (l_linenumber - 1) AS INTEGER) AS s FROM lineitem""",
)
def layout_lookup(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    top = lines.agg(F.max("l_linenumber").alias("q"), F.max("l_quantity").alias("t")).first()
    layout = layouts.delayed(top["q"] or 1, int(top["t"] or 0) + 1, [2 * q for q in range(top["q"] or 1)])
    return lines.select(
        "l_orderkey", "l_linenumber", layout.step(F.col("l_quantity").cast("int"), F.col("l_linenumber") - 1).alias("s")
    )


@query(
    "layout_checks",
    """SELECT s, CAST(q AS INTEGER) AS q, problem FROM (
  SELECT s, q, 'several times in one step' AS problem FROM (SELECT turn // 2 AS s, conv_id AS q FROM conversations) GROUP BY s, q HAVING count(*) > 1
  UNION ALL SELECT s, q, 'time goes back' FROM (
    SELECT length(text) AS s, conv_id AS q, turn AS t, lag(turn) OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS b FROM conversations) WHERE t < b)""",
)
def layout_checks(spark, sf):
    """Conversations as layouts: pairs of turns share a step, and steps by length don't follow the turns."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("int").alias("q"), F.col("turn").alias("t"), F.length("text").alias("n"))
    paired = layouts.check_layout(turns.select(F.expr("t div 2").cast("int").alias("s"), "t", "q"))
    sized = layouts.check_layout(turns.select(F.col("n").alias("s"), "t", "q"))
    return paired.filter("problem LIKE 'several%'").unionByName(sized.filter("problem LIKE 'time%'"))


@query(
    "layout_steps",
    """SELECT vec_id, label + 2 * q AS s, label AS t, q FROM embeddings, (SELECT CAST(unnest(range(4)) AS INTEGER) AS q)""",
)
def layout_steps(spark, sf):
    """The steps that hold a time of a delayed layout, as long as the labels need."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    top = rows.agg(F.max("label")).first()[0] or 0
    cells = layouts.layout_table(spark, layouts.delayed(4, top + 1, [0, 2, 4, 6]))
    return rows.join(cells, F.col("label") == F.col("t")).select("vec_id", (F.col("s") - 1).alias("s"), "t", "q")


@query(
    "invalid_tokens",
    f"""WITH {CODES_SQL} SELECT item, q, t, CASE WHEN t < n THEN code ELSE 1024 END AS code, CAST(t < n AS INTEGER) AS mask
FROM (SELECT c.*, floor((label + 1) * 4000 / 16000.0 * 5.5) AS n FROM codes c JOIN v ON v.vec_id = c.item)""",
)
def invalid_tokens(spark, sf):
    sizes = vectors(spark, sf).select(
        F.col("vec_id").alias("item"), ((F.col("label") + 1) * 4000).alias("n_frames"), F.lit(16000).alias("sample_rate")
    )
    rows = codes(spark, sf).join(sizes, "item")
    return layouts.pad_invalid_tokens(rows, 5.5, 1024).drop("n_frames", "sample_rate")


@query(
    "stereo_codes",
    f"""WITH {CODES_SQL}, s AS (SELECT item, q * 2 AS q, t, code FROM codes UNION ALL SELECT item, q * 2 + 1, t, 1023 - code FROM codes)
SELECT item, q, t, code, CAST(floor(q / 2) AS INTEGER) AS back_q, q % 2 AS back_c FROM s""",
)
def stereo_codes(spark, sf):
    left = codes(spark, sf)
    both = layouts.interleave_stereo(left, left.withColumn("code", 1023 - F.col("code")))
    back = layouts.split_stereo(both.withColumn("old", F.col("q")))
    return back.select(
        "item", F.col("old").alias("q"), "t", "code", F.col("q").alias("back_q"), F.col("c").alias("back_c")
    )


# Masks: a vector is an item with 64 positions.
RANK_SQL = f"""ranked AS (SELECT vec_id, label, i, row_number() OVER (PARTITION BY vec_id ORDER BY {sql_u('mask', 'vec_id', 'i')}, i) AS r FROM cells)"""


def long_mask(df, key="vec_id", mask="mask"):
    return df.select(key, F.posexplode(mask).alias("t", "m")).select(key, "t", F.col("m").cast("int").alias("m"))


@query(
    "random_mask",
    f"""WITH {V_SQL}, {RANK_SQL} SELECT vec_id, CAST(i AS INTEGER) AS t,
  CAST(r <= greatest(round_even(64 * label / 10.0, 0), 1) AS INTEGER) AS m FROM ranked""",
)
def random_mask(spark, sf):
    rows = vectors(spark, sf)
    mask = masks.random_mask(64, F.col("label") / 10.0, "mask", F.col("vec_id"))
    return long_mask(rows.select("vec_id", mask.alias("mask")))


def _span_counts_sql() -> str:
    return "[" + ", ".join(str(c) for c in masks.span_counts(64, 3)) + "]"


@query(
    "random_span_mask",
    f"""WITH {V_SQL}, {RANK_SQL},
starts AS (SELECT vec_id, i, r <= greatest({_span_counts_sql()}[CAST(label * 10 AS INTEGER) + 1], 1) AS s FROM ranked)
SELECT vec_id, CAST(i AS INTEGER) AS t, max(CAST(s AS INTEGER)) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m
FROM starts""",
)
def random_span_mask(spark, sf):
    rows = vectors(spark, sf)
    mask = masks.random_span_mask(64, F.col("label") / 10.0, 3, "mask", F.col("vec_id"))
    return long_mask(rows.select("vec_id", mask.alias("mask")))


@query(
    "span_scores",
    f"""WITH {V_SQL}, w AS (SELECT vec_id, i, round(sum(e) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 9) AS s FROM cells)
SELECT vec_id, CAST(i AS INTEGER) AS start, s AS score,
  CAST(row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) - 1 AS INTEGER) AS place FROM w WHERE i <= 61""",
)
def span_scores(spark, sf):
    rows = vectors(spark, sf).withColumn("sums", masks.span_scores(F.col("x"), 3))
    ordered = rows.select("vec_id", "sums", F.posexplode(masks.span_order(F.col("sums"))).alias("place", "start"))
    return ordered.select("vec_id", "start", F.round(F.get("sums", F.col("start")), 9).alias("score"), "place")


@query(
    "lowest_probability_spans",
    f"""WITH RECURSIVE {V_SQL},
w AS (SELECT vec_id, i, round(sum(e) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 9) AS s FROM cells),
o AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) - 1 AS r FROM w WHERE i <= 61),
c AS (SELECT cells.vec_id, label, cells.i, min(o.r) AS cover FROM cells JOIN o ON o.vec_id = cells.vec_id AND o.i BETWEEN cells.i - 2 AND cells.i GROUP BY ALL),
n AS (SELECT vec_id, label, u, count(*) FILTER (cover < u) AS masked FROM c, (SELECT unnest(range(63)) AS u) GROUP BY ALL),
b AS (SELECT vec_id, greatest(label * 6, 3) AS goal, greatest(label * 6, 3) // 3 AS lo, greatest(label * 6, 3) - 2 AS hi,
   CAST(round_even(0.5 * (greatest(label * 6, 3) // 3 + greatest(label * 6, 3) - 2), 0) AS BIGINT) AS chosen, 0 AS k FROM v
  UNION ALL
  SELECT b.vec_id, goal, CASE WHEN masked > goal THEN lo ELSE u END, CASE WHEN masked > goal THEN u ELSE hi END, u, k + 1
  FROM b JOIN n ON n.vec_id = b.vec_id AND n.u = CAST(round_even(0.5 * (lo + hi), 0) AS BIGINT) WHERE u > lo AND u < hi),
pick AS (SELECT vec_id, max_by(chosen, k) AS chosen FROM b GROUP BY vec_id)
SELECT c.vec_id, CAST(c.i AS INTEGER) AS t, CAST(cover < chosen AS INTEGER) AS m FROM c JOIN pick USING (vec_id)""",
)
def lowest_probability_spans(spark, sf):
    out = masks.lowest_probability_spans(spread(vectors(spark, sf)), "x", F.col("label") * 6, 3)
    return long_mask(out)


@query(
    "pad_truth_mask",
    f"""WITH {V_SQL}, d AS (SELECT vec_id, i, floor({sql_u('pad:start', 'vec_id')} * 21) AS s,
   floor({sql_u('pad:end', 'vec_id')} * 22) + 42 AS f FROM cells)
SELECT vec_id, CAST(i AS INTEGER) AS t, CAST(NOT (i >= s AND i < f) AS INTEGER) AS m FROM d""",
)
def pad_truth_mask(spark, sf):
    mask = masks.truth_mask_pad(64, "pad", F.col("vec_id"), central=True)
    return long_mask(vectors(spark, sf).select("vec_id", mask.alias("mask")))


WINDOW_SQL = f"""
d AS (SELECT vec_id, {sql_u('win:mode', 'vec_id')} AS m, floor({sql_u('win:start', 'vec_id')} * 0.33 * 64) AS st,
   floor((0.66 + {sql_u('win:finish', 'vec_id')} * 0.33) * 64) AS fi, floor({sql_u('win:windows', 'vec_id')} * 4) + 1 AS nw,
   {sql_u('win:invert', 'vec_id')} > 0.5 AS inv FROM v),
wd AS (SELECT *, floor(32 / nw) AS width,
   CASE WHEN m < 0.2 THEN 'pad' WHEN m < 0.5 THEN 'shuffle' WHEN m < 0.9 THEN 'crop' ELSE 'keep' END AS mode FROM d),
begins AS (SELECT vec_id, width, floor({sql_u('win:begin', 'vec_id', 'k')} * (64 - width)) AS b
   FROM wd, (SELECT unnest(range(1, 5)) AS k) WHERE k <= nw),
hit AS (SELECT DISTINCT vec_id, unnest(range(CAST(b AS BIGINT), CAST(b + width AS BIGINT))) AS i FROM begins),
masked AS (SELECT c.vec_id, c.label, c.i, c.e, wd.mode, CASE WHEN mode = 'keep' THEN 1 WHEN mode = 'pad' THEN CAST((c.i >= st AND c.i < fi) <> inv AS INTEGER)
   ELSE CAST((h.i IS NULL) <> inv AS INTEGER) END AS m
 FROM cells c JOIN wd ON wd.vec_id = c.vec_id LEFT JOIN hit h ON h.vec_id = c.vec_id AND h.i = c.i)
"""


def window_masked(spark, sf):
    return masks.random_window_mask(
        vectors(spark, sf), 64, "win", [F.col("vec_id")], 0.2, 0.4, 0.3, 0.5, 4
    )


@query(
    "random_window_mask",
    f"WITH {V_SQL}, {WINDOW_SQL} SELECT vec_id, mode, CAST(i AS INTEGER) AS t, m FROM masked",
)
def random_window_mask(spark, sf):
    rows = window_masked(spark, sf)
    return rows.select("vec_id", "mode", F.posexplode("mask").alias("t", "m"))


PLACED_SQL = """
placed AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
   count(*) OVER (PARTITION BY label) AS n FROM embeddings)
"""


def placed_vectors(spark, sf):
    """Position of each vector inside its batch, a label being a batch."""
    from tonewell.operators.scans import row_positions, span_bucket

    rows = vectors(spark, sf)
    placed = row_positions(rows.select("vec_id", "label"), ["label"], span_bucket(F.col("vec_id"), 100), [F.col("vec_id")])
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, "label").select("vec_id", "pos", "n")


@query(
    "window_masked_signal",
    f"""WITH {V_SQL}, {WINDOW_SQL}, {PLACED_SQL},
mate AS (SELECT p.vec_id, o.vec_id AS other FROM placed p JOIN placed o ON o.label = p.label
   AND o.pos = CAST(floor({sql_u('win:partner', 'p.label', 'p.pos')} * p.n) AS BIGINT))
SELECT a.vec_id, CAST(a.i AS INTEGER) AS t, CASE a.mode WHEN 'pad' THEN a.e * a.m WHEN 'shuffle' THEN a.e * a.m + o.e * (1 - a.m) ELSE a.e END AS x
FROM masked a JOIN mate USING (vec_id) JOIN cells o ON o.vec_id = mate.other AND o.i = a.i""",
)
def window_masked_signal(spark, sf):
    rows = window_masked(spark, sf).join(placed_vectors(spark, sf), "vec_id")
    out = masks.apply_window_mask(rows, "label", "pos", "n", "x", "win")
    return out.select("vec_id", F.posexplode("x").alias("t", "x"))


@query(
    "swapped_window",
    f"""WITH {V_SQL}, {PLACED_SQL},
mate AS (SELECT p.vec_id, o.vec_id AS other, CAST(floor({sql_u('swap:start', 'p.label')} * 45) AS INTEGER) AS st
  FROM placed p JOIN placed o ON o.label = p.label AND o.pos = CAST(floor({sql_u('swap:partner', 'p.label', 'p.pos')} * p.n) AS BIGINT))
SELECT c.vec_id, CAST(c.i AS INTEGER) AS t, CASE WHEN c.i >= st AND c.i < st + 20 THEN o.e ELSE c.e * 2 END AS x,
  CAST(NOT (c.i >= st AND c.i < st + 20) AS INTEGER) AS truth
FROM cells c JOIN mate USING (vec_id) JOIN cells o ON o.vec_id = mate.other AND o.i = c.i""",
)
def swapped_window(spark, sf):
    rows = vectors(spark, sf).withColumn("marked", A.scale(F.col("x"), 2.0)).join(placed_vectors(spark, sf), "vec_id")
    out = masks.swap_window(rows, "label", "pos", "n", "marked", "x", 64, 0.3125, "swap", shuffle=True)
    return out.select("vec_id", F.posexplode(F.arrays_zip("mixed", "truth")).alias("t", "z")).select(
        "vec_id", "t", F.col("z.mixed").alias("x"), F.col("z.truth").alias("truth")
    )


@query(
    "excerpt_and_length_masks",
    """SELECT p_partkey, list_sum(list_transform(range(60), lambda i: CASE WHEN i >= p_size AND i < p_size + 10 THEN 0 ELSE 1 END))::BIGINT AS outside,
  CAST(least(p_size, 40) AS INTEGER) AS valid FROM part""",
)
def excerpt_and_length_masks(spark, sf):
    def total(c):
        return F.aggregate(c, F.lit(0), lambda a, x: a + x)

    return table(spark, sf, "part").select(
        "p_partkey",
        total(A.excerpt_mask(60, F.col("p_size"), 10)).cast("bigint").alias("outside"),
        total(A.length_to_mask(F.col("p_size"), F.lit(40))).alias("valid"),
    )


# Batch shapes: the characters of a turn stand for frames.
def turn_frames(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("double")).alias("x"))


TURN_SQL = "SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS DOUBLE)) AS x FROM conversations"


@query(
    "collated_batches",
    f"""SELECT conv_id, turn, CAST(len(x) AS INTEGER) AS length, CAST(max(len(x)) OVER (PARTITION BY conv_id) AS INTEGER) AS total_frames,
  CAST(max(len(x)) OVER (PARTITION BY conv_id) AS INTEGER) AS made, list_sum(x) AS mass FROM ({TURN_SQL})""",
)
def collated_batches(spark, sf):
    out = batches.collate(turn_frames(spark, sf), "conv_id", "x")
    return out.select("conv_id", "turn", "length", "total_frames", F.size("x").alias("made"), A.total(F.col("x")).alias("mass"))


@query(
    "split_pieces",
    """SELECT doc_id, CAST(s / 500 AS INTEGER) AS piece, s AS start, CAST(least(n_chars - s, 500) AS INTEGER) AS size
FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 500)) AS s FROM documents) WHERE least(n_chars - s, 500) > 120""",
)
def split_pieces(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return batches.split_long(docs, F.col("n_chars"), 500, 120).drop("n_chars")


@query(
    "sliding_windows",
    f"""SELECT conv_id, turn, CAST(s / 7 AS INTEGER) AS chunk, s AS start, list_sum(x[s + 1 : s + 20]) AS mass
FROM (SELECT *, unnest(range(0, greatest(len(x) - 20, 0) + 1, 7)) AS s FROM ({TURN_SQL}))""",
)
def sliding_windows(spark, sf):
    out = batches.sliding_chunks(turn_frames(spark, sf), "x", 20, 7)
    return out.select("conv_id", "turn", "chunk", "start", A.total(F.col("x")).alias("mass"))


@query(
    "framed_arrays",
    f"""SELECT conv_id, turn, CAST(s / 8 AS INTEGER) AS frame, coalesce(list_sum(x[s + 1 : s + 16]), 0.0) AS mass
FROM (SELECT *, unnest(range(0, len(x), 8)) AS s FROM ({TURN_SQL}))""",
)
def framed_arrays(spark, sf):
    rows = turn_frames(spark, sf)
    framed = rows.select("conv_id", "turn", F.posexplode(batches.frame_array(F.col("x"), 16, 8)).alias("frame", "f"))
    return framed.select("conv_id", "turn", "frame", A.total(F.col("f")).alias("mass"))


@query(
    "fitted_arrays",
    f"""SELECT conv_id, turn, {sql_joined("list_transform(range(50), lambda i: x[CAST(i % len(x) AS BIGINT) + 1])")} AS x FROM ({TURN_SQL})""",
)
def fitted_arrays(spark, sf):
    return turn_frames(spark, sf).select("conv_id", "turn", joined(A.fit_length(F.col("x"), 50)).alias("x"))


@query(
    "one_hot_frames",
    f"""SELECT conv_id, turn, {sql_joined("list_transform(range(len(x)), lambda i: CASE WHEN i + 1 = list_position(x, list_max(x)) AND list_max(x) <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE)")} AS x
FROM ({TURN_SQL})""",
)
def one_hot_frames(spark, sf):
    return turn_frames(spark, sf).select("conv_id", "turn", joined(A.argmax_one_hot(F.col("x"))).alias("x"))


@query(
    "resized_frames",
    f"""WITH {V_SQL}, k AS (SELECT vec_id, x, CAST(unnest(range(40)) AS INTEGER) AS i FROM v),
p AS (SELECT *, greatest((i + 0.5) / 0.5 - 0.5, 0.0) AS pos FROM k),
f AS (SELECT *, least(CAST(floor(pos) AS INTEGER), 63) AS lo FROM p)
SELECT vec_id, i, CASE WHEN i < 32 THEN x[lo + 1] * (1.0 - (pos - lo)) + x[least(lo + 1, 63) + 1] * (pos - lo) ELSE 0.0 END AS x FROM f""",
)
def resized_frames(spark, sf):
    out = A.resample_linear(F.col("x"), 100.0, 50.0, 40)
    return vectors(spark, sf).select("vec_id", F.posexplode(out).alias("i", "x"))


@query(
    "melody_frames",
    f"""WITH {V_SQL}, k AS (SELECT vec_id, x[13:62] AS x, CAST(unnest(range(30)) AS INTEGER) AS i FROM v),
p AS (SELECT *, greatest((i + 0.5) / 0.5 - 0.5, 0.0) AS pos FROM k),
f AS (SELECT *, least(CAST(floor(pos) AS INTEGER), 49) AS lo FROM p),
s AS (SELECT vec_id // 12 AS track, vec_id % 12 AS bin, i AS frame,
   CASE WHEN i < 25 THEN x[lo + 1] * (1.0 - (pos - lo)) + x[least(lo + 1, 49) + 1] * (pos - lo) ELSE 0.0 END AS value FROM f)
SELECT track, frame, arg_max(bin, (value, -bin)) AS bin, CAST(max(value) <> 0 AS INTEGER) AS hot FROM s GROUP BY track, frame""",
)
def melody_frames(spark, sf):
    """Melody of a track from the salience of its twelve bins: segment, resize, one-hot."""
    from tonewell.operators import symbolic

    bins = vectors(spark, sf).select(
        F.expr("vec_id div 12").alias("track"), (F.col("vec_id") % 12).alias("bin"),
        symbolic.segment_salience(F.col("x"), F.lit(0.125), 100.0, 50.0, 0.5, 30).alias("values"),
    )
    long = bins.select("track", "bin", F.posexplode("values").alias("frame", "value"))
    return symbolic.melody_one_hot(long, ["track"])


@query(
    "blurred_frames",
    f"""WITH {V_SQL}, ext AS (SELECT vec_id, i, e FROM cells UNION ALL SELECT vec_id, 126 - i, e FROM cells WHERE i >= 57 AND i <= 62),
m AS (SELECT vec_id, CAST(floor(i / 10) AS INTEGER) AS b, round(sum(e) / 10, 9) AS x FROM ext GROUP BY 1, 2)
SELECT c.vec_id, CAST(c.i AS INTEGER) AS t, m.x FROM cells c JOIN m ON m.vec_id = c.vec_id AND m.b = floor(c.i / 10)""",
)
def blurred_frames(spark, sf):
    out = vectors(spark, sf).select("vec_id", F.posexplode(A.blur_blocks(F.col("x"), 10)).alias("t", "x"))
    return out.withColumn("x", F.round("x", 9))


@query(
    "window_plan",
    """SELECT doc_id, CAST(w AS INTEGER) AS "window", CAST(w * 120 AS INTEGER) AS "offset", CAST(least(n_chars - w * 120, 400) AS INTEGER) AS gen_len,
  CASE WHEN w = 0 THEN 25 ELSE 280 END AS prompt_len
FROM (SELECT doc_id, n_chars, unnest(range(CAST(ceil(greatest(n_chars - 400, 0) / 120.0) AS BIGINT) + 1)) AS w FROM documents WHERE n_chars > 25)""",
)
def window_plan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return batches.window_plan(docs, F.col("n_chars"), 400, 120, F.lit(25)).drop("n_chars")


# The words of a document are its tokens.
@query(
    "stitched_windows",
    """SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, CAST(len(w) AS BIGINT) * (len(w) - 1) // 2 AS place_sum,
  CAST(list_sum(list_transform(range(len(w)), lambda i: (i + 1) * length(w[i + 1]))) AS BIGINT) AS code_sum
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE len(w) > 25""",
)
def stitched_windows(spark, sf):
    docs = heavy_table(spark, sf, "documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    plan = batches.window_plan(docs, F.size("w"), 400, 300, F.lit(25))
    generated = plan.select(
        "doc_id", "window", F.posexplode(F.slice("w", F.col("offset") + 1, F.col("gen_len"))).alias("pos", "word")
    ).withColumn("code", F.length("word"))
    stitched = batches.stitch_windows(generated, plan.drop("w"), "doc_id")
    return stitched.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.sum("t").cast("bigint").alias("place_sum"),
        F.sum((F.col("t") + 1) * F.col("code")).cast("bigint").alias("code_sum"),
    )
