"""Probability vectors, blending, metrics and frequency models.

Three score vectors per event come from integer arithmetic; each sums to one.
The SQL checks treat them as rows (event, member, class), not as arrays.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog.registry import query, r6, tidy
from pitlog.catalog.standin import KEY, KEY_SQL, pitches, pitches_sql
from pitlog.functions import labels as L
from pitlog.functions import vectors as V
from pitlog.models import transitions as T
from pitlog.operators import joins as J
from pitlog.plans import blending as B
from pitlog.plans import features as FE
from pitlog.plans import metrics as M
from pitlog.plans.audits import plausibility

N = len(S.PITCH_TYPES)
_TYPE_INDEX = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(S.PITCH_TYPES))


def scored(spark, sf_dir, members: int = 3):
    """Key, y, p0, p1, ...: the pitch's type position and score vectors of the members."""
    log = pitches(spark, sf_dir)
    e = F.col("at_bat_number") * 4 + F.col("pitch_number") - 1
    y = L.lookup(F.col("pitch_type_can"), {t: i for i, t in enumerate(S.PITCH_TYPES)}, -1)
    base = log.select(*KEY, "pitcher", "pitch_type_can", e.alias("e"), F.col("batter").alias("k"), y.alias("y"))

    def raw(m: int, c: int):
        one = (F.col("e") * (c + 3) + F.col("k") * ((c + 1) * (m + 1))) % 97 + 1
        return (one + F.when(F.col("y") == c, 40 * (m + 1)).otherwise(0)).cast("double")

    # Plain columns run compiled, lambdas do not.
    names = {m: [f"_r{m}_{c}" for c in range(N)] for m in range(members)}
    out = base.withColumns({names[m][c]: raw(m, c) for m in range(members) for c in range(N)})
    out = out.withColumns({f"_t{m}": sum((F.col(n) for n in names[m]), F.lit(0.0)) for m in range(members)})
    vectors = [F.array(*[F.col(n) / F.col(f"_t{m}") for n in names[m]]).alias(f"p{m}") for m in range(members)]
    return out.select(*base.columns, *vectors)


SCORES = f"""{pitches_sql()},
base AS (SELECT *, at_bat_number * 4 + pitch_number - 1 AS e, batter AS k,
  CASE pitch_type_can {_TYPE_INDEX} ELSE -1 END AS y FROM pitches),
raw_scores AS (SELECT game_pk, at_bat_number, pitch_number, pitcher, pitch_type_can, y, m, c,
  ((e * (c + 3) + k * ((c + 1) * (m + 1))) % 97 + 1
    + CASE WHEN c = y THEN 40 * (m + 1) ELSE 0 END)::DOUBLE AS s
  FROM base, (SELECT unnest(range({N})) AS c), (SELECT unnest(range(3)) AS m)),
probs AS (SELECT *, s / SUM(s) OVER (PARTITION BY game_pk, at_bat_number, pitch_number, m) AS p
  FROM raw_scores)"""
ROW = "game_pk, at_bat_number, pitch_number"


@query(
    "softmax_vector",
    f"""WITH {SCORES}, x AS (SELECT *, exp(p * 5) AS ex FROM probs WHERE m = 0),
z AS (SELECT *, ex / SUM(ex) OVER (PARTITION BY {ROW}) AS q FROM x)
SELECT {KEY_SQL}, {r6("MAX(CASE WHEN c = 0 THEN q END)")} AS first_p,
  {r6("MAX(q)")} AS max_p, {r6("SUM(q * (c + 1))")} AS weighted FROM z GROUP BY ALL""",
)
def softmax_vector(spark, sf_dir):
    v = V.softmax(F.transform(F.col("p0"), lambda x: x * 5))
    out = scored(spark, sf_dir, 1).withColumn("q", v)
    places = F.array(*[F.lit(float(i + 1)) for i in range(N)])
    return tidy(
        out.select(
            *KEY,
            F.col("q")[0].alias("first_p"),
            F.array_max("q").alias("max_p"),
            V.dot(F.col("q"), places).alias("weighted"),
        )
    )


@query(
    "argmax_class",
    f"""WITH {SCORES}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {ROW} ORDER BY p DESC, c) AS rn
  FROM probs WHERE m = 0)
SELECT {KEY_SQL}, CAST(y AS BIGINT) AS y, CAST(c AS BIGINT) AS pred FROM r WHERE rn = 1""",
)
def argmax_class(spark, sf_dir):
    return tidy(scored(spark, sf_dir, 1).select(*KEY, "y", V.argmax(F.col("p0")).alias("pred")))


@query(
    "top3_hit",
    f"""WITH {SCORES}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {ROW} ORDER BY p DESC, c DESC) AS rn
  FROM probs WHERE m = 0)
SELECT {KEY_SQL}, CAST(MAX(CASE WHEN rn = 1 THEN c END) AS BIGINT) AS c1,
  CAST(MAX(CASE WHEN rn = 2 THEN c END) AS BIGINT) AS c2,
  CAST(MAX(CASE WHEN rn = 3 THEN c END) AS BIGINT) AS c3,
  CAST(MAX(CASE WHEN rn <= 3 AND c = y THEN 1 ELSE 0 END) AS BIGINT) AS hit FROM r GROUP BY {ROW}""",
)
def top3_hit(spark, sf_dir):
    out = scored(spark, sf_dir, 1).withColumn("top", V.top_k(F.col("p0"), 3))
    return tidy(
        out.select(
            *KEY,
            *[F.col("top")[i].alias(f"c{i + 1}") for i in range(3)],
            F.array_contains("top", F.col("y")).alias("hit"),
        )
    )


def _group_sum(types) -> str:
    places = ", ".join(str(S.PITCH_TYPES.index(t)) for t in types)
    return f"SUM(CASE WHEN c IN ({places}) THEN p ELSE 0 END)"


@query(
    "class_entropy",
    f"""WITH {SCORES} SELECT {KEY_SQL},
  {r6(_group_sum(("FF", "SI", "FC")))} AS "PT_PROB_FASTBALL_GROUP",
  {r6(_group_sum(("SL", "CU", "KC")))} AS "PT_PROB_BREAKING_GROUP",
  {r6(_group_sum(("CH", "FS")))} AS "PT_PROB_OFFSPEED_GROUP",
  {r6("MAX(p)")} AS "PT_PROB_MAX", {r6("-SUM(p * ln(p + 1e-10))")} AS "PT_PROB_ENTROPY"
FROM probs WHERE m = 0 GROUP BY {ROW}""",
)
def class_entropy(spark, sf_dir):
    columns = V.group_features(F.col("p0"), S.PITCH_TYPES)
    return tidy(scored(spark, sf_dir, 1).select(*KEY, *[c.alias(n) for n, c in columns.items()]))


@query(
    "equal_blend",
    f"""WITH {SCORES}, b AS (SELECT {ROW}, c, SUM(p) / 2 AS p FROM probs WHERE m < 2 GROUP BY ALL)
SELECT {KEY_SQL}, {r6("MAX(p)")} AS max_p, {r6("SUM(p * (c + 1))")} AS weighted FROM b GROUP BY {ROW}""",
)
def equal_blend(spark, sf_dir):
    out = B.equal_blend(scored(spark, sf_dir, 2), "p0", "p1")
    places = F.array(*[F.lit(float(i + 1)) for i in range(N)])
    return tidy(
        out.select(
            *KEY, F.array_max("probs").alias("max_p"), V.dot(F.col("probs"), places).alias("weighted")
        )
    )


_GRID = B.tenths_grid(3)
CLIPPED = "-ln(LEAST(GREATEST({p}, 1e-15), 1 - 1e-15))"


@query(
    "blend_grid",
    f"""WITH {SCORES},
t AS (SELECT {ROW}, MAX(CASE WHEN m = 0 THEN p END) AS a, MAX(CASE WHEN m = 1 THEN p END) AS b,
  MAX(CASE WHEN m = 2 THEN p END) AS d FROM probs WHERE c = y GROUP BY ALL),
g AS (SELECT i, j, 10 - i - j AS k FROM (SELECT unnest(range(1, 10)) AS i), (SELECT unnest(range(1, 10)) AS j)
  WHERE i + j <= 9),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS combo FROM g)
SELECT combo, {r6("i / 10.0")} AS w0, {r6("j / 10.0")} AS w1, {r6("k / 10.0")} AS w2,
  {r6("AVG(" + CLIPPED.format(p="a * i / 10.0 + b * j / 10.0 + d * k / 10.0") + ")")} AS log_loss
FROM o, t GROUP BY combo, i, j, k""",
)
def blend_grid(spark, sf_dir):
    return tidy(B.score_weights(scored(spark, sf_dir), ["p0", "p1", "p2"], "y", _GRID))


@query(
    "blend_best",
    f"""WITH {SCORES},
t AS (SELECT {ROW}, MAX(CASE WHEN m = 0 THEN p END) AS a, MAX(CASE WHEN m = 2 AND c < 9 THEN p END) AS b
  FROM probs WHERE c = y GROUP BY ALL),
g(combo, w0, w1) AS (VALUES (0, 0.7, 0.3), (1, 0.8, 0.2), (2, 0.6, 0.4)),
l AS (SELECT combo, w0, w1, AVG({CLIPPED.format(p="a * w0 + COALESCE(b, 0) * w1")}) AS log_loss
  FROM g, t GROUP BY ALL)
SELECT CAST(combo AS BIGINT) AS combo, {r6("w0")} AS w0, {r6("w1")} AS w1, {r6("log_loss")} AS log_loss
FROM l ORDER BY log_loss, combo LIMIT 1""",
)
def blend_best(spark, sf_dir):
    """A ten-class member with a nine-class one, joined by key and zero-padded."""
    rows = scored(spark, sf_dir)
    tree = rows.select(*KEY, F.col("p0").alias("probs"))
    sequence = rows.select(*KEY, F.slice("p2", 1, 9).alias("probs"))
    both = B.join_members([tree, sequence], KEY, N)
    both = J.attach_features(both, rows.select(*KEY, "y"), KEY)
    scores = B.score_weights(both, ["p0", "p1"], "y", B.SEQUENCE_WEIGHTS)
    return tidy(B.best_weights(scores))


# --- two-stage outcome: the first three and the first seven scores, normalised -----

_STAGED = f"""WITH {SCORES},
s1 AS (SELECT {ROW}, c, s / SUM(s) OVER (PARTITION BY {ROW}) AS p FROM raw_scores WHERE m = 0 AND c < 3),
ip AS (SELECT {ROW}, c, s / SUM(s) OVER (PARTITION BY {ROW}) AS p FROM raw_scores WHERE m = 1 AND c < 7),
h AS (SELECT {ROW}, MAX(CASE WHEN c = 0 THEN p END) AS p_in, MAX(CASE WHEN c = 1 THEN p END) AS p_ball,
  MAX(CASE WHEN c = 2 THEN p END) AS p_strike FROM s1 GROUP BY ALL),
o AS (SELECT {ROW}, c, CASE WHEN p_in >= p_ball AND p_in >= p_strike THEN p * p_in ELSE 0 END AS p
    FROM ip JOIN h USING ({ROW})
  UNION ALL SELECT {ROW}, 7, p_ball FROM h UNION ALL SELECT {ROW}, 8, p_strike FROM h)"""
_RUN_VALUES = " ".join(f"WHEN {i} THEN {S.RUN_VALUE[c]}" for i, c in enumerate(S.OUTCOME_CLASSES))


def _staged(spark, sf_dir):
    rows = scored(spark, sf_dir, 2)
    stage1 = V.normalise(F.slice("p0", 1, 3))
    in_play = V.normalise(F.slice("p1", 1, 7))
    return rows.select(*KEY, V.combine_stages(stage1, in_play).alias("outcome_probs"))


@query(
    "stage_combine",
    f"""{_STAGED} SELECT {KEY_SQL}, {", ".join(
        r6(f"SUM(CASE WHEN c = {i} THEN p END)") + f' AS "P_{c}"' for i, c in enumerate(S.OUTCOME_CLASSES))}
FROM o GROUP BY {ROW}""",
)
def stage_combine(spark, sf_dir):
    columns = V.class_columns(F.col("outcome_probs"), S.OUTCOME_CLASSES, "P_")
    return tidy(_staged(spark, sf_dir).select(*KEY, *[c.alias(n) for n, c in columns.items()]))


@query(
    "expected_run_value",
    f"""{_STAGED} SELECT {KEY_SQL}, {r6(f"SUM(p * CASE c {_RUN_VALUES} END)")} AS run_value
FROM o GROUP BY {ROW}""",
)
def expected_run_value(spark, sf_dir):
    value = V.expected_run_value(F.col("outcome_probs"))
    return tidy(_staged(spark, sf_dir).select(*KEY, value.alias("run_value")))


@query(
    "mean_run_value",
    f"""{_STAGED} SELECT {r6(f"SUM(p * CASE c {_RUN_VALUES} END) / COUNT(DISTINCT ({ROW}))")} AS mean_run_value
FROM o""",
)
def mean_run_value(spark, sf_dir):
    value = V.expected_run_value(F.col("outcome_probs"))
    return tidy(M.mean_of(_staged(spark, sf_dir), value, "mean_run_value"))


# --- metrics -------------------------------------------------------------------------

_PRED = f"""pred AS (SELECT {ROW}, y, c AS pred FROM (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY {ROW} ORDER BY p DESC, c) AS rn FROM probs WHERE m = 0) WHERE rn = 1)"""


@query(
    "conf_matrix",
    f"""WITH {SCORES}, {_PRED} SELECT CAST(y AS BIGINT) AS y, CAST(pred AS BIGINT) AS pred, COUNT(*) AS n
FROM pred GROUP BY ALL""",
)
def conf_matrix(spark, sf_dir):
    return tidy(M.confusion_matrix(scored(spark, sf_dir, 1), "y", "p0"))


_ACCURACY = f"""WITH {SCORES}, {_PRED},
t3 AS (SELECT {ROW}, MAX(CASE WHEN rn <= 3 AND c = y THEN 1 ELSE 0 END) AS hit FROM (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY {ROW} ORDER BY p DESC, c DESC) AS rn FROM probs WHERE m = 0) GROUP BY ALL),
v AS (SELECT 'accuracy' AS metric, AVG(CASE WHEN y = pred THEN 1 ELSE 0 END) AS value FROM pred
  UNION ALL SELECT 'top3_accuracy', AVG(hit) FROM t3
  UNION ALL SELECT 'log_loss', AVG({CLIPPED.format(p="p")}) FROM probs WHERE m = 0 AND c = y)"""


@query("accuracy_topk_logloss", f"{_ACCURACY} SELECT metric, {r6('value')} AS value FROM v")
def accuracy_topk_logloss(spark, sf_dir):
    return tidy(M.classification_metrics(scored(spark, sf_dir, 1), "y", "p0"))


@query(
    "metric_gates",
    f"""{_ACCURACY} SELECT 'plausibility' AS "check", 'type_accuracy' AS item, {r6("value")} AS value,
  CAST(value BETWEEN 0.45 AND 0.75 AS BIGINT) AS passed FROM v WHERE metric = 'accuracy'""",
)
def metric_gates(spark, sf_dir):
    found = M.classification_metrics(scored(spark, sf_dir, 1), "y", "p0").where("metric = 'accuracy'")
    return tidy(plausibility(found.withColumn("metric", F.lit("type_accuracy"))))


@query(
    "per_class_metrics",
    f"""WITH {SCORES}, {_PRED},
a AS (SELECT y AS c, COUNT(*) AS support, COUNT(*) FILTER (y = pred) AS hits FROM pred GROUP BY 1),
b AS (SELECT pred AS c, COUNT(*) AS predicted FROM pred GROUP BY 1),
q AS (SELECT c, COALESCE(support, 0) AS support, hits::DOUBLE / support AS recall,
  COALESCE(hits, 0)::DOUBLE / predicted AS precision FROM a FULL JOIN b USING (c))
SELECT ([{", ".join(repr(t) for t in S.PITCH_TYPES)}])[c + 1] AS class, support, {r6("recall")} AS recall,
  {r6("precision")} AS precision,
  {r6("2 * precision * recall / NULLIF(precision + recall, 0)")} AS f1 FROM q""",
)
def per_class_metrics(spark, sf_dir):
    matrix = M.confusion_matrix(scored(spark, sf_dir, 1), "y", "p0")
    return tidy(M.per_class(matrix, S.PITCH_TYPES))


@query(
    "one_vs_rest_auc",
    f"""WITH {SCORES}, r AS (SELECT c, (y = c) AS pos,
  RANK() OVER (PARTITION BY c ORDER BY p) + (COUNT(*) OVER (PARTITION BY c, p) - 1) / 2.0 AS rk
  FROM probs WHERE m = 0),
s AS (SELECT c, SUM(CASE WHEN pos THEN rk END) AS rs, COUNT(*) FILTER (pos) AS np,
  COUNT(*) FILTER (NOT pos) AS nn FROM r GROUP BY 1)
SELECT CAST(c AS BIGINT) AS class_id, {r6("(rs - np * (np + 1) / 2.0) / (np::DOUBLE * nn)")} AS auc FROM s""",
)
def one_vs_rest_auc(spark, sf_dir):
    return tidy(M.one_vs_rest_auc(scored(spark, sf_dir, 1), N, "y", "p0"))


@query(
    "rmse_mae_r2",
    f"""WITH {pitches_sql()}, p AS (SELECT estimated_woba_using_speedangle AS a,
  0.02 + 0.001 * release_speed AS f FROM pitches
  WHERE estimated_woba_using_speedangle IS NOT NULL AND release_speed IS NOT NULL),
m AS (SELECT AVG(a) AS mean FROM p),
v AS (SELECT 'rmse' AS metric, sqrt(AVG((a - f) * (a - f))) AS value FROM p
  UNION ALL SELECT 'mae', AVG(abs(a - f)) FROM p
  UNION ALL SELECT 'r2', 1 - SUM((a - f) * (a - f)) / SUM((a - mean) * (a - mean)) FROM p, m
  UNION ALL SELECT 'mean_actual', AVG(a) FROM p UNION ALL SELECT 'mean_pred', AVG(f) FROM p)
SELECT metric, {r6("value")} AS value FROM v""",
)
def rmse_mae_r2(spark, sf_dir):
    predicted = F.lit(0.02) + F.col("release_speed") * 0.001
    log = pitches(spark, sf_dir).withColumn("predicted", predicted)
    return tidy(M.regression_metrics(log, "estimated_woba_using_speedangle", "predicted"))


@query(
    "baselines",
    f"""WITH {pitches_sql()}, c AS (SELECT COUNT(*) AS n FROM pitches GROUP BY pitch_type_can)
SELECT 'random_guess' AS metric, {r6("1.0 / COUNT(*)")} AS value FROM c
UNION ALL SELECT 'largest_class', {r6("MAX(n)::DOUBLE / SUM(n)")} FROM c""",
)
def baselines(spark, sf_dir):
    return tidy(M.baselines(pitches(spark, sf_dir), "pitch_type_can"))


# --- frequency models ------------------------------------------------------------------

_CONTEXTS = [[], ["prev_pitch_1"], ["prev_pitch_1", "count_state"]]
_CONTEXT_CTE = f"""{pitches_sql()}, ctx AS (SELECT *,
  COALESCE(LAG(pitch_type_can) OVER (PARTITION BY pitcher, game_pk ORDER BY at_bat_number, pitch_number),
    'NONE') AS prev_pitch_1,
  CAST(LEAST(GREATEST(COALESCE(balls, 0), 0), 3) AS VARCHAR) || '_'
    || CAST(LEAST(GREATEST(COALESCE(strikes, 0), 0), 2) AS VARCHAR) AS count_state FROM pitches)"""


def _with_context(spark, sf_dir):
    log = FE.lag_block(pitches(spark, sf_dir), depth=1)
    return log.withColumns(
        {
            "prev_pitch_1": F.coalesce("prev_pitch_1", F.lit("NONE")),
            "count_state": L.count_label12(F.col("balls"), F.col("strikes")),
        }
    )


@query(
    "transition_probs",
    f"""WITH {_CONTEXT_CTE},
cls AS (SELECT unnest([{", ".join(repr(t) for t in S.PITCH_TYPES)}]) AS cl),
n0 AS (SELECT cl, COUNT(*) FILTER (pitch_type_can = cl) AS n, COUNT(*) AS t FROM ctx, cls GROUP BY 1),
q0 AS (SELECT cl, (n + 1.0 / {N}) / (t + 1.0) AS p FROM n0),
n1 AS (SELECT prev_pitch_1, cl, COUNT(*) FILTER (pitch_type_can = cl) AS n, COUNT(*) AS t
  FROM ctx, cls GROUP BY 1, 2),
q1 AS (SELECT prev_pitch_1, cl, (n + q0.p) / (t + 1.0) AS p FROM n1 JOIN q0 USING (cl)),
n2 AS (SELECT prev_pitch_1, count_state, cl, COUNT(*) FILTER (pitch_type_can = cl) AS n, COUNT(*) AS t
  FROM ctx, cls GROUP BY 1, 2, 3),
q2 AS (SELECT prev_pitch_1, count_state, cl, (n + q1.p) / (t + 1.0) AS p
  FROM n2 JOIN q1 USING (prev_pitch_1, cl))
SELECT {KEY_SQL}, {r6("MAX(p)")} AS max_p, {r6("MAX(CASE WHEN cl = pitch_type_can THEN p END)")} AS true_p
FROM ctx JOIN q2 USING (prev_pitch_1, count_state) GROUP BY {ROW}""",
)
def transition_probs(spark, sf_dir):
    log = _with_context(spark, sf_dir)
    tables = T.transition_tables(log, _CONTEXTS)
    out = T.transition_probabilities(log, tables, _CONTEXTS, N)
    y = L.lookup(F.col("pitch_type_can"), {t: i for i, t in enumerate(S.PITCH_TYPES)}, -1)
    p = F.col("probs")
    return tidy(out.select(*KEY, F.array_max(p).alias("max_p"), V.at(p, y).alias("true_p")))


@query(
    "residual_mix",
    f"""WITH {SCORES}, {_CONTEXT_CTE.replace(pitches_sql() + ", ", "")},
el AS (SELECT pitcher FROM ctx GROUP BY 1 HAVING COUNT(pitch_type_can) >= 68),
own AS (SELECT pitcher, count_state, prev_pitch_1, pitch_type_can, COUNT(*) AS n FROM ctx
  JOIN el USING (pitcher) GROUP BY ALL),
tot AS (SELECT pitcher, count_state, prev_pitch_1, SUM(n) AS t FROM own GROUP BY ALL),
x AS (SELECT p.{ROW.replace(", ", ", p.")}, p.c, p.y, CASE WHEN tot.t IS NULL THEN p.p ELSE
    0.85 * p.p + 0.15 * (COALESCE(own.n, 0) + p.p) / (tot.t + 1.0) END AS q
  FROM probs p JOIN ctx USING ({ROW})
  LEFT JOIN tot ON tot.pitcher = ctx.pitcher AND tot.count_state = ctx.count_state
    AND tot.prev_pitch_1 = ctx.prev_pitch_1
  LEFT JOIN own ON own.pitcher = ctx.pitcher AND own.count_state = ctx.count_state
    AND own.prev_pitch_1 = ctx.prev_pitch_1
    AND own.pitch_type_can = ([{", ".join(repr(t) for t in S.PITCH_TYPES)}])[p.c + 1]
  WHERE p.m = 0)
SELECT {KEY_SQL}, {r6("MAX(q)")} AS max_p, {r6("MAX(CASE WHEN c = y THEN q END)")} AS true_p
FROM x GROUP BY {ROW}""",
)
def residual_mix(spark, sf_dir):
    log = _with_context(spark, sf_dir)
    rows = J.attach_features(
        log.select(*KEY, "pitcher", "count_state", "prev_pitch_1"),
        scored(spark, sf_dir, 1).select(*KEY, "y", "p0"),
        KEY,
    )
    out = T.residual_mix(rows, log, "p0", minimum=68)
    p = F.col("mixed")
    return tidy(out.select(*KEY, F.array_max(p).alias("max_p"), V.at(p, F.col("y")).alias("true_p")))
