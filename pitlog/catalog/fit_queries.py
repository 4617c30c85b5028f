"""Cross-fitting, multiclass boosting, per-entity fits and the context tree over the stand-in log.

What is sums, counts or linear algebra has its check in SQL; fitted trees are checked for rows here
and by tests for what must hold of them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog import feature_sql as Q
from pitlog.catalog.probability_queries import N, SCORES, scored
from pitlog.catalog.registry import query, r6, tidy
from pitlog.catalog.standin import KEY, KEY_SQL, pitches, pitches_sql
from pitlog.functions import labels as L
from pitlog.functions import vectors as V
from pitlog.models import context_tree as C
from pitlog.models import entity_fits as E
from pitlog.operators import joins as J
from pitlog.operators.splits import day_blocks
from pitlog.plans import features as FE
from pitlog.plans import metrics as M
from pitlog.plans import time_travel as TT
from pitlog.plans import training as T

_DAYS = """days AS (SELECT game_date, COUNT(*) AS n FROM pitches GROUP BY 1),
blocks AS (SELECT game_date, CAST(5 * (SUM(n) OVER (ORDER BY game_date) - n) // (SELECT COUNT(*) FROM pitches) AS INT)
  AS block FROM days)"""


@query(
    "crossfit_blocks",
    f"""WITH {pitches_sql()}, {_DAYS}
SELECT CAST(block AS BIGINT) AS block, COUNT(*) AS n_rows, CAST(MIN(game_date) AS VARCHAR) AS first_day,
  CAST(MAX(game_date) AS VARCHAR) AS last_day FROM pitches JOIN blocks USING (game_date) GROUP BY 1""",
)
def crossfit_blocks(spark, sf_dir):
    log = pitches(spark, sf_dir)
    at = log.select("game_date", day_blocks(log, 5).alias("block"))
    return tidy(
        at.groupBy("block").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("game_date").alias("first_day"),
            F.max("game_date").alias("last_day"),
        )
    )


def _features(spark, sf_dir):
    return FE.historical_table(pitches(spark, sf_dir))


@query("outcome_stacking")
def outcome_stacking(spark, sf_dir):
    return tidy(T.outcome_report(_features(spark, sf_dir)))


@query("multiclass_boosting")
def multiclass_boosting(spark, sf_dir):
    return tidy(T.boosting_report(_features(spark, sf_dir), rounds=8, depth=4, rate=0.3, patience=3))


# --- context tree ----------------------------------------------------------------------

CONTEXTS = ("prev_pitch_1", "count_state", "prev_pitch_2")
_CLASSES = ", ".join(repr(t) for t in S.PITCH_TYPES)
_CTX = f"""{pitches_sql()}, {_DAYS}, ctx AS (SELECT *, block = 4 AS held,
  COALESCE(LAG(pitch_type_can) OVER game, 'NONE') AS c1,
  CAST(LEAST(GREATEST(COALESCE(balls, 0), 0), 3) AS VARCHAR) || '_'
    || CAST(LEAST(GREATEST(COALESCE(strikes, 0), 0), 2) AS VARCHAR) AS c2,
  COALESCE(LAG(pitch_type_can, 2) OVER game, 'NONE') AS c3
  FROM pitches JOIN blocks USING (game_date)
  WINDOW game AS (PARTITION BY pitcher, game_pk ORDER BY at_bat_number, pitch_number)),
cls AS (SELECT unnest([{_CLASSES}]) AS cl)"""


def _tree_sql() -> str:
    """Levels 0 to 3 in long form (context, class): counts, probabilities, gains and what is kept."""
    parts = []
    for d in range(4):
        cols = [f"c{i}" for i in range(1, d + 1)]
        keys, up = ", ".join(cols), ", ".join(cols[:-1])
        lead = f"{keys}, " if keys else ""
        parts.append(f"""
n{d} AS (SELECT {lead}cl, COUNT(*) FILTER (pitch_type_can = cl AND NOT held) AS n,
  COUNT(*) FILTER (pitch_type_can = cl AND held) AS m FROM ctx, cls GROUP BY {lead}cl),
t{d} AS (SELECT *, SUM(n) OVER w AS t, COUNT(*) FILTER (n > 0) OVER w AS u, SUM(m) OVER w AS tm
  FROM n{d} WINDOW w AS ({"PARTITION BY " + keys if keys else ""}))""")
        parent = f"1.0::DOUBLE / {N}" if d == 0 else "up.p"
        join = "" if d == 0 else f" JOIN p{d - 1} up USING ({up + ', ' if up else ''}cl)"
        parts.append(f"""
p{d} AS (SELECT t{d}.*, {parent} AS q,
  CASE WHEN t{d}.t = 0 THEN {parent} ELSE (t{d}.n + t{d}.u * {parent}) / (t{d}.t + t{d}.u) END AS p FROM t{d}{join})""")
    for d in (3, 2, 1, 0):
        cols = [f"c{i}" for i in range(1, d + 1)]
        keys = ", ".join(cols)
        lead = f"{keys}, " if keys else ""
        group = f"GROUP BY {keys}" if keys else ""
        own = f"""SELECT {lead}ANY_VALUE(t) AS t, ANY_VALUE(u) AS u, ANY_VALUE(tm) AS tm, MAX(p) AS max_p,
    SUM(CASE WHEN m > 0 THEN m * (ln(p) - ln(q)) ELSE 0 END) AS own FROM p{d} {group}"""
        if d == 3:
            parts.append(f"\ng3 AS (SELECT *, own AS gain FROM ({own}))")
        elif d:
            parts.append(f"""
g{d} AS (SELECT o.*, own + COALESCE(b.below, 0) AS gain FROM ({own}) o LEFT JOIN
  (SELECT {keys}, SUM(GREATEST(gain, 0)) AS below FROM g{d + 1} GROUP BY {keys}) b USING ({keys}))""")
        else:
            parts.append(f"""
g0 AS (SELECT o.*, own + (SELECT SUM(GREATEST(gain, 0)) FROM g1) AS gain FROM ({own}) o)""")
    parts.append("\nk0 AS (SELECT *, TRUE AS kept FROM g0)")
    for d in (1, 2, 3):
        up = ", ".join(f"c{i}" for i in range(1, d))
        kept = "up.kept AND " if d > 1 else ""
        join = f" JOIN k{d - 1} up USING ({up})" if d > 1 else ""
        parts.append(f"\nk{d} AS (SELECT g{d}.*, {kept}g{d}.gain > 0 AND g{d}.t > 0 AS kept FROM g{d}{join})")
    return f"WITH {_CTX}, {','.join(parts)}"


def _tree_rows_sql() -> str:
    rows = []
    for d in range(4):
        context = " || '|' || ".join(f"c{i}" for i in range(1, d + 1)) or "''"
        rows.append(
            f"SELECT CAST({d} AS BIGINT) AS depth, {context} AS context, CAST(t AS BIGINT) AS n_rows, "
            f"CAST(tm AS BIGINT) AS n_held, {r6('CASE WHEN t = 0 THEN 1 ELSE u / (t + u)::DOUBLE END')} AS escape, "
            f"{r6('gain')} AS gain, CAST(kept AS BIGINT) AS kept, {r6('max_p')} AS max_p FROM k{d}"
        )
    return f"{_tree_sql()} {' UNION ALL '.join(rows)}"


def _tree_probs_sql() -> str:
    joins = " ".join(
        f"LEFT JOIN (SELECT p{d}.*, TRUE AS used FROM p{d} JOIN k{d} USING ({keys}) WHERE kept) x{d} "
        f"ON x{d}.cl = cls.cl AND " + " AND ".join(f"x{d}.c{i} = ctx.c{i}" for i in range(1, d + 1))
        for d, keys in ((1, "c1"), (2, "c1, c2"), (3, "c1, c2, c3"))
    )
    return f"""{_tree_sql()}, q AS (SELECT ctx.*, cls.cl, COALESCE(x3.p, x2.p, x1.p, p0.p) AS p,
  CASE WHEN x3.used THEN 3 WHEN x2.used THEN 2 WHEN x1.used THEN 1 ELSE 0 END AS depth
  FROM ctx CROSS JOIN cls {joins} JOIN p0 ON p0.cl = cls.cl)
SELECT {KEY_SQL}, {r6("MAX(p)")} AS max_p, {r6("MAX(CASE WHEN cl = pitch_type_can THEN p END)")} AS true_p
FROM q GROUP BY {", ".join(KEY)}"""


def _with_contexts(spark, sf_dir):
    """The log with its contexts and block, and the class position ``y``."""
    log = pitches(spark, sf_dir)
    at = FE.lag_block(log.withColumn("block", day_blocks(log, 5)), depth=2)
    return at.withColumns(
        {
            "prev_pitch_1": F.coalesce("prev_pitch_1", F.lit("NONE")),
            "prev_pitch_2": F.coalesce("prev_pitch_2", F.lit("NONE")),
            "count_state": L.count_label12(F.col("balls"), F.col("strikes")),
            "y": L.lookup(F.col("pitch_type_can"), {t: i for i, t in enumerate(S.PITCH_TYPES)}, -1),
        }
    )


def _held_tree(log):
    return C.fit(log, CONTEXTS, held=F.col("block") == 4)


@query("context_tree", _tree_rows_sql())
def context_tree(spark, sf_dir):
    tree = _held_tree(_with_contexts(spark, sf_dir)).table
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return tidy(
        tree.select(
            "depth",
            F.concat_ws("|", *CONTEXTS).alias("context"),
            total(F.col("counts")).alias("n_rows"),
            total(F.col("held")).alias("n_held"),
            "escape",
            "gain",
            "kept",
            F.array_max("probs").alias("max_p"),
        )
    )


@query("context_tree_probs", _tree_probs_sql())
def context_tree_probs(spark, sf_dir):
    log = _with_contexts(spark, sf_dir)
    out = _held_tree(log).predict(log)
    p = F.col("probs")
    return tidy(out.select(*KEY, F.array_max(p).alias("max_p"), V.at(p, F.col("y")).alias("true_p")))


@query("sequence_blend")
def sequence_blend(spark, sf_dir):
    """A tree member and the context tree, fitted before the last block and blended on half of its days."""
    return tidy(T.sequence_blend_report(_features(spark, sf_dir)))


# --- time travel -----------------------------------------------------------------------

_PICK = "CAST('0x' || substr(md5(CAST(pitcher AS VARCHAR) || ':' || CAST(game_date AS VARCHAR)), 1, 4) AS INT) < 16384"
_LEAKS = {"velocity_7d": "AVG(v) OVER w", "whiff_rate_7d": "AVG(wh) OVER w"}


def _time_travel_sql() -> str:
    """Clean columns differ nowhere; the planted ones where the day itself changes the mean."""
    families = ["form", "platoon", "count_state"]
    leaky = Q.rolled("leaky", "form_d", "pitcher", False, {c: (e, Q.W7_TODAY) for c, e in _LEAKS.items()})
    rows = []
    for f in families:
        for c in Q.FAMILIES[f][2]:
            count = "0"
            if c in _LEAKS:
                count = f"""(SELECT COUNT(*) FROM form f JOIN leaky l USING (pitcher, game_date) WHERE {_PICK}
  AND CASE WHEN f.{c} IS NULL OR l.{c} IS NULL THEN (f.{c} IS NULL) <> (l.{c} IS NULL)
    ELSE abs(f.{c} - l.{c}) > 1e-6 END)"""
            rows.append(f"SELECT 'time_travel' AS \"check\", '{c}' AS item, CAST({count} AS DOUBLE) AS value")
    return f"""WITH {pitches_sql()}, {Q.family_ctes(families)}, {leaky}, r AS ({" UNION ALL ".join(rows)})
SELECT "check", item, value, CAST(value = 0 AS BIGINT) AS passed FROM r"""


@query("audit_time_travel", _time_travel_sql())
def audit_time_travel(spark, sf_dir):
    """A quarter of all pitcher days, with two planted columns that include the day itself."""
    log = pitches(spark, sf_dir)
    families = [FE.form_family(), FE.platoon_family(), FE.count_state_family()]
    table = FE.rolling_features(log, "pitcher", "game_date", families)
    leaky = FE.rolling_features(log, "pitcher", "game_date", [replace(families[0], frame=FE.WITH_7)])
    table = J.attach_features(
        table.drop(*_LEAKS), leaky.select("pitcher", "game_date", *_LEAKS), ["pitcher", "game_date"]
    )
    return tidy(TT.time_travel(table, log, "pitcher", families, share=0.25))


# --- per-entity fits --------------------------------------------------------------------


def _inputs():
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.lit(1.0),
        number("balls"),
        number("strikes"),
        flag(F.coalesce(F.col("stand"), F.lit("")) == "L"),
        number("outs_when_up"),
    ]


def _targets():
    family = L.pitch_family(F.col("pitch_type_can"))
    return [F.when(family == f, 1.0).otherwise(0.0) for f in S.FAMILIES]


_FAMILY = "CASE " + " ".join(
    f"WHEN pitch_type_can IN ({', '.join(repr(t) for t in types)}) THEN '{f}'"
    for f, types in {f: [t for t, g in S.PITCH_FAMILY.items() if g == f] for f in S.FAMILIES}.items()
) + f" ELSE '{S.DEFAULT_FAMILY}' END"
_D, _T = 5, len(S.FAMILIES)
_DESIGN = f"""design AS (SELECT pitcher, [1.0::DOUBLE, COALESCE(balls, 0), COALESCE(strikes, 0),
    CASE WHEN stand = 'L' THEN 1 ELSE 0 END, COALESCE(outs_when_up, 0)]::DOUBLE[] AS x,
  [{", ".join(f"CASE WHEN {_FAMILY} = '{f}' THEN 1 ELSE 0 END" for f in S.FAMILIES)}]::DOUBLE[] AS t FROM pitches)"""


def _gram_sql(name: str) -> str:
    cells = [f"SUM(x[{i}] * x[{j}])" for i in range(1, _D + 1) for j in range(1, _D + 1)]
    rows = ", ".join(f"[{', '.join(cells[_D * i : _D * i + _D])}]" for i in range(_D))
    sides = ", ".join(f"[{', '.join(f'SUM(x[{i}] * t[{k}])' for k in range(1, _T + 1))}]" for i in range(1, _D + 1))
    return f"""{name} AS (SELECT pitcher, COUNT(*) AS n, [{rows}]::DOUBLE[][] AS g, [{sides}]::DOUBLE[][] AS m
  FROM design GROUP BY pitcher)"""


@query(
    "entity_gram",
    f"""WITH {pitches_sql()}, {_DESIGN}, {_gram_sql("sums")}
SELECT CAST(pitcher AS BIGINT) AS pitcher, n, {", ".join(r6(f"g[{i + 1}][{j + 1}]") + f" AS g{i}{j}"
    for i in range(_D) for j in range(i, _D))},
  {", ".join(r6(f"m[{i + 1}][{k + 1}]") + f" AS m{i}{k}" for i in range(_D) for k in range(_T))} FROM sums""",
)
def entity_gram(spark, sf_dir):
    sums = E.gram(pitches(spark, sf_dir), "pitcher", _inputs(), _targets())
    cells = [F.col("gram")[i][j].alias(f"g{i}{j}") for i in range(_D) for j in range(i, _D)]
    sides = [F.col("moments")[i][k].alias(f"m{i}{k}") for i in range(_D) for k in range(_T)]
    return tidy(sums.select("pitcher", "n", *cells, *sides))


def _ridge_sql() -> str:
    """Normal equations by elimination, one step per pivot."""
    steps = [
        f"""e0 AS (SELECT pitcher, n, list_transform(range(1, {_D + 1}), lambda i: list_concat(
    list_transform(g[i], lambda v, j: v + CASE WHEN i = j THEN 1 ELSE 0 END), m[i])) AS a FROM sums)"""
    ]
    for p in range(1, _D + 1):
        steps.append(
            f"""r{p} AS (SELECT pitcher, n, a, list_transform(a[{p}], lambda v: v / a[{p}][{p}]) AS r FROM e{p - 1}),
e{p} AS (SELECT pitcher, n, list_transform(a, lambda x, i: CASE WHEN i = {p} THEN r
    ELSE list_transform(x, lambda v, j: v - x[{p}] * r[j]) END) AS a FROM r{p})"""
        )
    out = ", ".join(
        r6(f"a[{i + 1}][{_D + k + 1}]") + f" AS b{i}{k}" for i in range(_D) for k in range(_T)
    )
    return f"""WITH {pitches_sql()}, {_DESIGN}, {_gram_sql("sums")}, {", ".join(steps)}
SELECT CAST(pitcher AS BIGINT) AS pitcher, n, {out} FROM e{_D}"""


@query("entity_ridge", _ridge_sql())
def entity_ridge(spark, sf_dir):
    fitted = E.ridge(pitches(spark, sf_dir), "pitcher", _inputs(), _targets())
    cells = [F.col("beta")[i][k].alias(f"b{i}{k}") for i in range(_D) for k in range(_T)]
    return tidy(fitted.select("pitcher", "n", *cells))


def _logit_sql(steps: int) -> str:
    """Bounded Newton steps in long form: sums of gaps per pitcher, class and input."""
    parts = [
        f"""rws AS (SELECT pitcher, [1.0::DOUBLE, COALESCE(balls, 0), COALESCE(strikes, 0)]::DOUBLE[] AS x, base, y,
    row_number() OVER () AS rid
  FROM pitches JOIN (SELECT {", ".join(KEY)}, y, list(p ORDER BY c) AS base FROM probs WHERE m = 0
    GROUP BY ALL) USING ({", ".join(KEY)}) WHERE y BETWEEN 0 AND {N - 1}),
counted AS (SELECT pitcher, COUNT(*) AS n FROM rws GROUP BY 1 HAVING COUNT(*) >= {MINIMUM}),
s0 AS (SELECT pitcher, n, {_inverse_columns()} FROM (SELECT pitcher, COUNT(*) AS n,
  {", ".join(f"SUM(x[{i}] * x[{j}]) / 2 + {1.0 if i == j else 0.0}::DOUBLE AS h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))}
  FROM rws JOIN counted USING (pitcher) GROUP BY pitcher)),
b0 AS (SELECT pitcher, list_transform(range({N}), lambda k: [0.0::DOUBLE, 0, 0]) AS b FROM s0)"""
    ]
    for s in range(1, steps + 1):
        parts.append(
            f"""
z{s} AS (SELECT pitcher, rid, x, y, k, exp(ln(base[k]) + b[k][1] * x[1] + b[k][2] * x[2] + b[k][3] * x[3]) AS e
  FROM (SELECT rws.*, b, unnest(range(1, {N + 1})) AS k FROM rws JOIN b{s - 1} USING (pitcher))),
g{s} AS (SELECT pitcher, k, SUM(d * x[1]) AS g1, SUM(d * x[2]) AS g2, SUM(d * x[3]) AS g3 FROM (
    SELECT pitcher, k, x, CASE WHEN k = y + 1 THEN 1 ELSE 0 END - e / SUM(e) OVER (PARTITION BY rid) AS d FROM z{s})
  GROUP BY 1, 2),
b{s} AS (SELECT pitcher, list([b[k][1] + i11 * v1 + i12 * v2 + i13 * v3, b[k][2] + i12 * v1 + i22 * v2 + i23 * v3,
    b[k][3] + i13 * v1 + i23 * v2 + i33 * v3] ORDER BY k) AS b FROM (
  SELECT pitcher, k, b, s0.* EXCLUDE (pitcher), g1 - b[k][1] AS v1, g2 - b[k][2] AS v2, g3 - b[k][3] AS v3
  FROM g{s} JOIN b{s - 1} USING (pitcher) JOIN s0 USING (pitcher)) GROUP BY pitcher)"""
        )
    cells = ", ".join(r6(f"b[{k + 1}][{i + 1}]") + f" AS b{k}{i}" for k in range(N) for i in range(3))
    return f"""WITH {SCORES}, {", ".join(parts)}
SELECT CAST(pitcher AS BIGINT) AS pitcher, n, {cells} FROM b{steps} JOIN s0 USING (pitcher)"""


def _inverse_columns() -> str:
    """The inverse of a symmetric 3 x 3 matrix by cofactors."""
    det = "(h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13))"
    cofactors = {
        "i11": "h22 * h33 - h23 * h23",
        "i12": "h13 * h23 - h12 * h33",
        "i13": "h12 * h23 - h13 * h22",
        "i22": "h11 * h33 - h13 * h13",
        "i23": "h13 * h12 - h11 * h23",
        "i33": "h11 * h22 - h12 * h12",
    }
    return ", ".join(f"({c}) / {det} AS {n}" for n, c in cofactors.items())


MINIMUM = 60
_LOGIT_STEPS = 3


def _logit_inputs():
    return _inputs()[:3]


@query("entity_logits", _logit_sql(_LOGIT_STEPS))
def entity_logits(spark, sf_dir):
    log = pitches(spark, sf_dir)
    rows = J.attach_features(log, scored(spark, sf_dir, 1).select(*KEY, "y", "p0"), KEY)
    fitted = E.residual_logits(
        rows, "pitcher", _logit_inputs(), "y", "p0", N, steps=_LOGIT_STEPS, minimum=MINIMUM
    )
    cells = [F.col("beta")[k][i].alias(f"b{k}{i}") for k in range(N) for i in range(3)]
    return tidy(fitted.select("pitcher", "n", *cells))


@query("entity_residual_report")
def entity_residual_report(spark, sf_dir):
    """Log-loss on later days of a context tree and of its mixture with each pitcher's own fit."""
    log = _with_contexts(spark, sf_dir)
    early = log.where("block < 2")
    tree = C.fit(early, CONTEXTS, held=F.col("block") == 1, refit=True)
    rows = tree.predict(log.where("block >= 2 AND y >= 0"), "base")
    fitted = E.residual_logits(
        rows.where("block < 4"), "pitcher", _inputs(), "y", "base", N, minimum=MINIMUM
    )
    later = E.residual_mixture(rows.where("block = 4"), fitted, "pitcher", _inputs(), "base")
    reports = [
        M.classification_metrics(later, "y", p).select(F.lit(m).alias("model"), "metric", "value")
        for m, p in (("base", "base"), ("mixed", "mixed"))
    ]
    return tidy(reports[0].unionByName(reports[1]))
