"""Plain SQL for the feature families, written long-form: daily rows, window, pivot.

The library computes the same families wide in one pass; agreeing with this text
is the check of that rewrite.
"""

from __future__ import annotations

from pitlog import schema as S
from pitlog.catalog.registry import r6
from pitlog.catalog.standin import KEY_SQL, pitches_sql

W30 = "RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"
W7 = "RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"
W30_TODAY = "RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW"
W7_TODAY = "RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW"
TO_DATE = "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

WHIFF = "SUM(CASE WHEN description = 'swinging_strike' THEN 1 ELSE 0 END)::DOUBLE / COUNT(*)"
HITS = "('single','double','triple','home_run')"
HIT = f"SUM(CASE WHEN events IN {HITS} THEN 1 ELSE 0 END)::DOUBLE / COUNT(*)"
WHIFF_BOOL = "SUM((description = 'swinging_strike')::INT)::DOUBLE / COUNT(*)"
HIT_BOOL = f"SUM((events IN {HITS})::INT)::DOUBLE / COUNT(*)"
XWOBA = "AVG(estimated_woba_using_speedangle)"
STATE = (
    "CASE WHEN balls <= 1 AND strikes <= 1 THEN 'EVEN' WHEN balls > strikes THEN 'BEHIND' "
    "ELSE 'AHEAD' END"
)
TYPES, STATES, SIDES = S.PITCH_TYPES, S.COUNT_STATES, S.SIDES


def daily(name: str, entity: str, category: str | None, measures: dict[str, str], where: str = "") -> str:
    cat = f", {category} AS cat" if category else ""
    group = f"{entity}, game_date" + (f", {category}" if category else "")
    cols = "".join(f", {e} AS {n}" for n, e in measures.items())
    cond = f"WHERE {where}" if where else ""
    return f"{name} AS (SELECT {entity}, game_date{cat}{cols} FROM pitches {cond} GROUP BY {group})"


def rolled(name: str, source: str, entity: str, category: bool, cols: dict[str, tuple[str, str]]) -> str:
    part = f"{entity}, cat" if category else entity
    keep = f"{entity}, game_date" + (", cat" if category else "")
    parts = "".join(
        f", {expr} AS {n}".replace("OVER w", f"OVER (PARTITION BY {part} ORDER BY game_date {frame})")
        for n, (expr, frame) in cols.items()
    )
    return f"{name} AS (SELECT {keep}{parts} FROM {source})"


def wide(
    name: str, source: str, entity: str, values, metrics, pattern: str = "{m}_{v}"
) -> str:
    cells = "".join(
        f""", MAX(CASE WHEN cat = '{v}' THEN {m} END) AS "{pattern.format(m=m, v=v)}\""""
        for m in metrics
        for v in values
    )
    vals = ", ".join(f"'{v}'" for v in values)
    return (
        f"{name} AS (SELECT {entity}, game_date{cells} FROM {source} WHERE cat IN ({vals}) "
        f"GROUP BY {entity}, game_date)"
    )


def names(metrics, values, pattern: str = "{m}_{v}") -> list[str]:
    return [pattern.format(m=m, v=v) for m in metrics for v in values]


SPEED_SPIN = "release_speed IS NOT NULL AND release_spin_rate IS NOT NULL"
VS, VS_UP = "{m}_vs_{v}", "{m}_VS_{v}"

# family -> (CTE texts, entity, output columns); the last CTE has the family's name
FAMILIES: dict[str, tuple[list[str], str, list[str]]] = {}

FAMILIES["arsenal"] = (
    [
        daily("arsenal_d", "pitcher", "pitch_type_can",
              {"n": "COUNT(*)", "v": "AVG(release_speed)", "s": "AVG(release_spin_rate)", "wh": WHIFF},
              SPEED_SPIN),
        rolled("arsenal_w", "arsenal_d", "pitcher", True,
               {"velocity_30d": ("AVG(v) OVER w", W30), "spin_rate_30d": ("AVG(s) OVER w", W30),
                "whiff_rate_30d": ("AVG(wh) OVER w", W30)}),
        wide("arsenal", "arsenal_w", "pitcher", TYPES, ["velocity_30d", "spin_rate_30d", "whiff_rate_30d"]),
    ],
    "pitcher",
    names(["velocity_30d", "spin_rate_30d", "whiff_rate_30d"], TYPES),
)
FAMILIES["usage"] = (
    [
        daily("usage_d", "pitcher", "pitch_type_can", {"n": "COUNT(*)"}, SPEED_SPIN),
        rolled("usage_w", "usage_d", "pitcher", True, {"total": ("SUM(n) OVER w", W30)}),
        """usage_s AS (SELECT pitcher, game_date, cat, total::DOUBLE
  / NULLIF(SUM(total) OVER (PARTITION BY pitcher, game_date), 0) AS usage_30d FROM usage_w)""",
        wide("usage", "usage_s", "pitcher", TYPES, ["usage_30d"]),
    ],
    "pitcher",
    names(["usage_30d"], TYPES),
)
FAMILIES["count_state"] = (
    [
        daily("count_d", "pitcher", STATE, {"wh": WHIFF, "hr": HIT}),
        rolled("count_w", "count_d", "pitcher", True,
               {"whiff_rate_30d": ("AVG(wh) OVER w", W30), "contact_rate_30d": ("AVG(hr) OVER w", W30)}),
        wide("count_state", "count_w", "pitcher", STATES, ["whiff_rate_30d", "contact_rate_30d"]),
    ],
    "pitcher",
    names(["whiff_rate_30d", "contact_rate_30d"], STATES),
)
FAMILIES["form"] = (
    [
        daily("form_d", "pitcher", None, {"v": "AVG(release_speed)", "wh": WHIFF, "hr": HIT},
              "release_speed IS NOT NULL"),
        rolled("form", "form_d", "pitcher", False,
               {"velocity_7d": ("AVG(v) OVER w", W7), "whiff_rate_7d": ("AVG(wh) OVER w", W7),
                "hit_rate_7d": ("AVG(hr) OVER w", W7)}),
    ],
    "pitcher",
    ["velocity_7d", "whiff_rate_7d", "hit_rate_7d"],
)
FAMILIES["platoon"] = (
    [
        daily("platoon_d", "pitcher", "stand", {"wh": WHIFF, "hr": HIT, "xw": XWOBA}, "stand IS NOT NULL"),
        rolled("platoon_w", "platoon_d", "pitcher", True,
               {"whiff_rate_30d": ("AVG(wh) OVER w", W30), "hit_rate_30d": ("AVG(hr) OVER w", W30),
                "xwoba_30d": ("AVG(xw) OVER w", W30)}),
        wide("platoon", "platoon_w", "pitcher", SIDES, ["whiff_rate_30d", "hit_rate_30d", "xwoba_30d"], VS),
    ],
    "pitcher",
    names(["whiff_rate_30d", "hit_rate_30d", "xwoba_30d"], SIDES, VS),
)
FAMILIES["batter_xwoba"] = (
    [
        daily("bx_d", "batter", "pitch_type_can", {"xw": XWOBA},
              "estimated_woba_using_speedangle IS NOT NULL"),
        rolled("bx_w", "bx_d", "batter", True, {"batter_xwoba_30d": ("AVG(xw) OVER w", W30)}),
        wide("batter_xwoba", "bx_w", "batter", TYPES, ["batter_xwoba_30d"]),
    ],
    "batter",
    names(["batter_xwoba_30d"], TYPES),
)
FAMILIES["k_rate"] = (
    [
        daily("k_d", "batter", None,
              {"pa": "COUNT(*)", "so": "SUM(CASE WHEN description = 'swinging_strike' THEN 1 ELSE 0 END)"}),
        rolled("k_rate", "k_d", "batter", False,
               {"k_rate_30d": (f"(SUM(so) OVER w)::DOUBLE / (SUM(pa) OVER w)", W30)}),
    ],
    "batter",
    ["k_rate_30d"],
)
FAMILIES["k_pct"] = (
    [
        daily("kp_d", "batter", None,
              {"pa": "COUNT(*)", "so": "SUM((description = 'swinging_strike')::INT)"}),
        rolled("k_pct", "kp_d", "batter", False,
               {"K_PCT_TD": ("(SUM(so) OVER w)::DOUBLE / NULLIF(SUM(pa) OVER w, 0)", TO_DATE),
                "K_PCT_30D": ("(SUM(so) OVER w)::DOUBLE / NULLIF(SUM(pa) OVER w, 0)", W30_TODAY)}),
    ],
    "batter",
    ["K_PCT_TD", "K_PCT_30D"],
)
FAMILIES["arsenal_td"] = (
    [
        daily("at_d", "pitcher", "pitch_type_can",
              {"n": "COUNT(*)", "v": "AVG(release_speed)", "s": "AVG(release_spin_rate)", "wh": WHIFF_BOOL}),
        rolled("at_w", "at_d", "pitcher", True,
               {"ntd": ("SUM(n) OVER w", TO_DATE), "n30": ("SUM(n) OVER w", W30_TODAY),
                "V_TD": ("AVG(v) OVER w", TO_DATE), "SPIN_TD": ("AVG(s) OVER w", TO_DATE),
                "WHIFF_30": ("AVG(wh) OVER w", W30_TODAY)}),
        """at_s AS (SELECT *,
  ntd::DOUBLE / SUM(ntd) OVER (PARTITION BY pitcher, game_date) AS USAGE_TD,
  n30::DOUBLE / SUM(n30) OVER (PARTITION BY pitcher, game_date) AS USAGE_30 FROM at_w)""",
        wide("arsenal_td", "at_s", "pitcher", TYPES, ["V_TD", "SPIN_TD", "WHIFF_30", "USAGE_TD", "USAGE_30"]),
    ],
    "pitcher",
    names(["V_TD", "SPIN_TD", "WHIFF_30", "USAGE_TD", "USAGE_30"], TYPES),
)
FAMILIES["count_state_today"] = (
    [
        daily("ct_d", "pitcher", STATE, {"wh": WHIFF_BOOL, "hr": HIT_BOOL}),
        rolled("ct_w", "ct_d", "pitcher", True,
               {"WHIFF_30": ("AVG(wh) OVER w", W30_TODAY), "CONTACT_30": ("AVG(hr) OVER w", W30_TODAY)}),
        wide("count_state_today", "ct_w", "pitcher", STATES, ["WHIFF_30", "CONTACT_30"]),
    ],
    "pitcher",
    names(["WHIFF_30", "CONTACT_30"], STATES),
)
FAMILIES["form_today"] = (
    [
        daily("ft_d", "pitcher", None, {"wh": WHIFF_BOOL, "v": "AVG(release_speed)", "hr": HIT_BOOL}),
        rolled("form_today", "ft_d", "pitcher", False,
               {"WHIFF_7D": ("AVG(wh) OVER w", W7_TODAY), "VELO_7D": ("AVG(v) OVER w", W7_TODAY),
                "HIT_7D": ("AVG(hr) OVER w", W7_TODAY)}),
    ],
    "pitcher",
    ["WHIFF_7D", "VELO_7D", "HIT_7D"],
)
FAMILIES["batter_xwoba_td"] = (
    [
        daily("xt_d", "batter", "pitch_type_can", {"xw": XWOBA}),
        rolled("xt_w", "xt_d", "batter", True,
               {"XWOBA_TD": ("AVG(xw) OVER w", TO_DATE), "XWOBA_30": ("AVG(xw) OVER w", W30_TODAY)}),
        wide("batter_xwoba_td", "xt_w", "batter", TYPES, ["XWOBA_TD", "XWOBA_30"]),
    ],
    "batter",
    names(["XWOBA_TD", "XWOBA_30"], TYPES),
)
FAMILIES["platoon_today"] = (
    [
        daily("pt_d", "pitcher", "stand", {"wh": WHIFF_BOOL, "hr": HIT_BOOL, "xw": XWOBA}),
        rolled("pt_w", "pt_d", "pitcher", True,
               {"WHIFF_30": ("AVG(wh) OVER w", W30_TODAY), "HIT_30": ("AVG(hr) OVER w", W30_TODAY),
                "XWOBA_30": ("AVG(xw) OVER w", W30_TODAY)}),
        wide("platoon_today", "pt_w", "pitcher", SIDES, ["WHIFF_30", "HIT_30", "XWOBA_30"], VS_UP),
    ],
    "pitcher",
    names(["WHIFF_30", "HIT_30", "XWOBA_30"], SIDES, VS_UP),
)


def reals(columns) -> str:
    return "".join(f', {r6(chr(34) + c + chr(34))} AS "{c}"' for c in columns)


def family_sql(name: str) -> str:
    ctes, entity, columns = FAMILIES[name]
    body = ",\n".join(ctes)
    return (
        f"WITH {pitches_sql()},\n{body}\nSELECT CAST({entity} AS BIGINT) AS {entity}, "
        f"CAST(game_date AS VARCHAR) AS game_date{reals(columns)} FROM {name}"
    )


SEQ = "PARTITION BY pitcher, game_pk ORDER BY at_bat_number, pitch_number"
BEFORE = f"OVER ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LAG = f"OVER ({SEQ})"


def running_columns(speed: str) -> tuple[list[str], list[str]]:
    """(select items, real column names) of the running counts and means."""
    items = [f"COUNT(*) {BEFORE} AS cum_game_pitches"]
    real = []
    for t in ("FF", "SL", "CH"):
        low = t.lower()
        items.append(
            f"CAST(SUM(CASE WHEN pitch_type_can = '{t}' THEN 1 ELSE 0 END) {BEFORE} AS BIGINT) AS cum_{low}_count"
        )
        for column, source in ((f"cum_{low}_{speed}", "release_speed"), (f"cum_{low}_spin", "release_spin_rate")):
            items.append(f"AVG(CASE WHEN pitch_type_can = '{t}' THEN {source} END) {BEFORE} AS {column}")
            real.append(column)
    return items, real


def type_lags(prefix: str, depth: int) -> list[str]:
    return [f"LAG(pitch_type_can, {k}) {LAG} AS {prefix}{k}" for k in range(1, depth + 1)]


def running_cte(name: str = "running") -> str:
    items, _ = running_columns("velocity")
    items += type_lags("prev_pitch_", 4)
    items.append(f"LAG(release_speed, 1) {LAG} - LAG(release_speed, 2) {LAG} AS dvelo1")
    return f"{name} AS (SELECT *, {', '.join(items)} FROM pitches)"


COUNTS = ["cum_ff_count", "cum_sl_count", "cum_ch_count"]
LAGS4 = [f"prev_pitch_{k}" for k in range(1, 5)]


def whole(columns) -> str:
    return "".join(f", CAST({c} AS BIGINT) AS {c}" for c in columns)


def maybe(columns) -> str:
    """Integers with NULLs, as doubles."""
    return "".join(f", CAST({c} AS DOUBLE) AS {c}" for c in columns)


def texts(columns) -> str:
    return "".join(f", {c}" for c in columns)


def joined_cte(name: str, fact: str, families) -> str:
    joins, cols = [], [f"{fact}.*"]
    for f in families:
        _, entity, columns = FAMILIES[f]
        joins.append(f"LEFT JOIN {f} USING ({entity}, game_date)")
        cols += [f'{f}."{c}"' for c in columns]
    return f"{name} AS (SELECT {', '.join(cols)} FROM {fact} {' '.join(joins)})"


PRIOR = ["arsenal", "usage", "count_state", "form", "platoon", "batter_xwoba", "k_rate"]
TODAY = ["arsenal_td", "count_state_today", "form_today", "platoon_today", "batter_xwoba_td", "k_pct"]


def family_ctes(families) -> str:
    return ",\n".join(t for f in families for t in FAMILIES[f][0])


def historical_ctes() -> str:
    """pitches, running, every prior family, and the joined table ``hist``."""
    return (
        f"{pitches_sql()},\n{running_cte()},\n{family_ctes(PRIOR)},\n{joined_cte('hist', 'running', PRIOR)}"
    )


def offline_ctes() -> str:
    return f"{pitches_sql()},\n{family_ctes(TODAY)},\n{joined_cte('offline', 'pitches', TODAY)}"


RAW_WHOLE = "pitcher batter home_score".split()
RAW_MAYBE = "balls strikes inning outs_when_up on_1b on_2b on_3b away_score".split()
RAW_TEXT = "home_team p_throws stand pitch_type description events pitch_type_can".split()
RAW_REAL = ["release_speed", "release_spin_rate", "estimated_woba_using_speedangle"]


def raw_items() -> str:
    return (
        f"{KEY_SQL}, CAST(game_date AS VARCHAR) AS game_date"
        f"{whole(RAW_WHOLE)}{maybe(RAW_MAYBE)}{texts(RAW_TEXT)}{reals(RAW_REAL)}"
    )
