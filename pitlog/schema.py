"""Schemas, column lists and vocabularies of a pitch log.

Fixed values: the word lists, code maps and constants below must keep these
exact values, because outputs are compared by name and by value.
"""

from __future__ import annotations

from pyspark.sql import types as T

PITCH_KEY = ("game_pk", "at_bat_number", "pitch_number")

# --- fixed values: raw columns --------------------------------------------
_LONG = "game_pk pitcher batter on_1b on_2b on_3b".split()
_INT = (
    "at_bat_number pitch_number inning outs_when_up balls strikes "
    "home_score away_score zone"
).split()
_TEXT = (
    "home_team stand p_throws inning_topbot pitch_type pitch_name description events"
).split()

# Columns the feature build keeps, in output order.
FEATURE_KEEP = (
    "game_date game_pk at_bat_number pitch_number pitcher batter home_team "
    "stand p_throws "
    "inning inning_topbot outs_when_up on_1b on_2b on_3b balls strikes home_score away_score "
    "pitch_type release_speed release_spin_rate effective_speed description events "
    "estimated_woba_using_speedangle delta_home_win_exp delta_run_exp "
    "pfx_x pfx_z plate_x plate_z vx0 vy0 vz0 ax ay az sz_top sz_bot zone "
    "launch_speed launch_angle hit_distance_sc"
).split()

# Columns a landed season keeps, in output order.
LANDING_KEEP = (
    "game_date game_pk at_bat_number pitch_number pitcher batter home_team "
    "stand p_throws "
    "inning inning_topbot outs_when_up on_1b on_2b on_3b balls strikes home_score away_score "
    "pitch_type pitch_name release_speed release_spin_rate effective_speed release_extension "
    "description events "
    "estimated_woba_using_speedangle delta_home_win_exp delta_run_exp home_win_exp bat_win_exp "
    "pfx_x pfx_z plate_x plate_z vx0 vy0 vz0 ax ay az sz_top sz_bot zone spin_axis "
    "release_pos_x release_pos_y release_pos_z "
    "launch_speed launch_angle hit_distance_sc hc_x hc_y"
).split()

# Columns the offline feature table keeps, in output order.
OFFLINE_KEEP = [
    "game_date", "game_pk", "at_bat_number", "pitch_number", "inning", "inning_topbot", "batter", "pitcher",
    "stand", "p_throws", "home_team", "outs_when_up", "on_1b", "on_2b", "on_3b", "home_score", "away_score",
    "balls", "strikes", "pitch_type", "pitch_name", "release_speed", "effective_speed", "release_extension",
    "release_spin_rate", "pfx_x", "pfx_z", "plate_x", "plate_z", "spin_axis", "sz_top", "sz_bot", "zone",
    "release_pos_x", "release_pos_y", "release_pos_z", "vx0", "vy0", "vz0", "ax", "ay", "az", "events",
    "description", "delta_home_win_exp", "delta_run_exp", "home_win_exp", "bat_win_exp", "launch_speed",
    "launch_angle", "hit_distance_sc", "hc_x", "hc_y", "estimated_woba_using_speedangle",
]

# The strict ten-column subset of the CSV conversion.
CONVERT_COLUMNS = (
    "game_date pitch_type events release_speed release_spin_rate "
    "hc_x hc_y stand p_throws home_team"
).split()


def _field(name: str) -> T.StructField:
    if name == "game_date":
        return T.StructField(name, T.DateType())
    if name in _LONG:
        return T.StructField(name, T.LongType())
    if name in _INT:
        return T.StructField(name, T.IntegerType())
    if name in _TEXT:
        return T.StructField(name, T.StringType())
    return T.StructField(name, T.DoubleType())


RAW_PITCH = T.StructType([_field(c) for c in LANDING_KEEP])
CROSSWALK = T.StructType(
    [T.StructField("mlbam", T.LongType()), T.StructField("fg", T.LongType())]
)
PARK_FACTORS = T.StructType(
    [T.StructField("home_team", T.StringType()), T.StructField("PF", T.DoubleType())]
)

# --- fixed values: pitch types ---------------------------------------------
CANONICAL_TYPES = {
    "FF": "FF", "SI": "SI", "SL": "SL", "CH": "CH", "CU": "CU",
    "FC": "FC", "KC": "KC", "FS": "FS", "ST": "ST",
    "SV": "SL", "FA": "FF", "FT": "SI", "CS": "CU",
}
# The running-feature build spells out five more codes, all of them OTHER.
CANONICAL_TYPES_RUNNING = {
    **CANONICAL_TYPES, "SC": "OTHER", "KN": "OTHER", "EP": "OTHER", "UN": "OTHER", "PO": "OTHER",
}
# The to-date build also folds sweepers coded SW.
CANONICAL_TYPES_TO_DATE = {**CANONICAL_TYPES, "SW": "ST"}
UNKNOWN_TYPE = "OTHER"

PITCH_TYPES = ("CH", "CU", "FC", "FF", "FS", "KC", "OTHER", "SI", "SL", "ST")
EXPECTED_TYPES = ("FF", "SL", "CH", "CU", "SI", "FC", "KC", "FS", "OTHER")
COUNT_STATES = ("AHEAD", "BEHIND", "EVEN")
SIDES = ("L", "R")

PITCH_FAMILY = {
    "FF": "FB", "SI": "FB", "FC": "FB",
    "SL": "BR", "CU": "BR", "KC": "BR", "OTHER": "BR",
    "CH": "OS", "FS": "OS", "ST": "OS",
}
FAMILIES = ("BR", "FB", "OS")
DEFAULT_FAMILY = "BR"

PROBABILITY_GROUPS = {
    "FASTBALL": ("FF", "SI", "FC"),
    "BREAKING": ("SL", "CU", "KC"),
    "OFFSPEED": ("CH", "FS"),
}

# --- fixed values: sequence vocabularies ------------------------------------
SEQUENCE_TYPES = ("FF", "SL", "CH", "CU", "SI", "FC", "FS", "KC", "OTHER")
SEQUENCE_PAD = 8
SLOT_TYPES = ("FF", "SI", "SL", "CH", "CU", "FC", "FS", "KC", "ST")
SLOT_PAD = 9

# --- fixed values: outcomes --------------------------------------------------
IN_PLAY_CLASSES = ("HR", "3B", "2B", "1B", "FC", "SAC", "OUT")
STAGE1_CLASSES = ("IN_PLAY", "BALL", "STRIKE")
OUTCOME_CLASSES = IN_PLAY_CLASSES + ("BALL", "STRIKE")
RUN_VALUE = {
    "HR": 1.44, "3B": 1.03, "2B": 0.78, "1B": 0.47, "FC": 0.30, "SAC": 0.02,
    "OUT": -0.27, "BALL": 0.33, "STRIKE": 0.00,
}
OUTCOME6_CLASSES = ("BALL", "HIT", "OUT", "STRIKE", "STRIKEOUT", "WALK")
HIT_EVENTS = ("single", "double", "triple", "home_run")
WHIFF = "swinging_strike"

# --- fixed values: weights and thresholds -------------------------------------
CLASS_FACTOR = {"FS": 2.0, "OTHER": 2.0, "KC": 1.5, "FC": 1.3}
DECAY = 0.0008
MIN_CLASS_SHARE = 0.01
SPARSE_TARGET_SHARE = 0.3
MIN_RESIDUAL_PITCHES = 400
RESIDUAL_SHARE = 0.15
DEFAULT_XWOBA = 0.3
ENTROPY_EPS = 1e-10
DVELO_SPREAD_LIMIT = 20.0

# --- fixed values: leakage rules ----------------------------------------------
LEAK_TOKENS = (
    "release_ pfx_ plate_ vx0 vy0 vz0 ax ay az sz_top sz_bot effective_speed spin_axis "
    "zone hc_x hc_y launch_speed launch_angle hit_distance delta_run_exp delta_home_win_exp"
).split()
# The narrower list of the per-type expected-value models.
LEAK_TOKENS_SHORT = (
    "release_ pfx_ plate_ vx0 vy0 vz0 ax ay az launch_speed launch_angle hit_distance "
    "zone delta_"
).split()
CURRENT_PITCH_TOKENS = (
    "release_speed release_spin_rate release_pos pfx_x pfx_z plate_x plate_z vx0 vy0 vz0 "
    "ax ay az sz_top sz_bot effective_speed release_extension spin_axis zone hc_x hc_y "
    "launch_speed launch_angle hit_distance babip_value iso_value woba_value woba_denom"
).split()
RUN_DELTA_TOKENS = ("delta_run_exp", "delta_home_win_exp")
BASE_DROP = (
    "pitch_type_can estimated_woba_using_speedangle w game_date game_pk at_bat_number "
    "pitch_number inning inning_topbot batter pitcher home_team pitch_name events "
    "description pitch_type"
).split()
# Column-name rules of the profile report, first match wins.
AUDIT_BUCKETS = {
    "post_pitch": CURRENT_PITCH_TOKENS
    + list(RUN_DELTA_TOKENS)
    + ["events", "description", "pitch_name", "pitch_type"],
    "target": ["estimated_woba_using_speedangle"],
    "lag": ["prev_", "lag_", "dvelo"],
    "situational": ["balls", "strikes", "outs", "inning", "score", "on_"],
    "arsenal": ["usage_", "v_td_", "spin_td_", "velocity_30d_", "spin_rate_30d_"],
    "history": ["whiff_", "contact_", "hit_", "xwoba_", "k_rate", "k_pct"],
    "player": ["stand", "p_throws", "batter", "pitcher", "home_team"],
}
FEATURE_FAMILIES = {
    "arsenal_30d": ["velocity_30d_", "spin_rate_30d_", "whiff_rate_30d_", "usage_30d_"],
    "form_7d": ["velocity_7d", "whiff_rate_7d", "hit_rate_7d"],
    "count_state_30d": [f"whiff_rate_30d_{s}" for s in COUNT_STATES],
    "platoon_30d": ["vs_L", "vs_R"],
    "batter_30d": ["batter_xwoba_30d_", "k_rate_30d"],
    "within_game": ["cum_", "prev_pitch_", "dvelo1"],
}
REQUIRED_COLUMNS = "pitch_type_can game_date pitcher batter balls strikes count_state".split()
REQUIRED_LAGS = "prev_pitch_1 prev_pitch_2 prev_pitch_3 prev_pitch_4 dvelo1".split()

# --- fixed values: the features a model may see -----------------------------
SITUATION = (
    "balls strikes outs_when_up on_1b on_2b on_3b home_score away_score stand p_throws count_state"
).split()
SAFE_FEATURES = (
    SITUATION
    + ["batter_fg", "pitcher_fg"]
    + REQUIRED_LAGS
    + [f"{m}_{t}" for m in ("velocity_30d", "spin_rate_30d", "usage_30d", "batter_xwoba_30d")
       for t in PITCH_TYPES]
    + [f"{m}_{s}" for m in ("contact_rate_30d", "whiff_rate_30d") for s in COUNT_STATES]
    + [f"whiff_rate_30d_{t}" for t in PITCH_TYPES]
    + [f"{m}_30d_vs_{s}" for m in ("hit_rate", "whiff_rate", "xwoba") for s in SIDES]
    + ["k_rate_30d", "hit_rate_7d", "velocity_7d", "whiff_rate_7d"]
    + [f"cum_{t}_{m}" for t in ("ch", "ff", "sl") for m in ("count", "spin", "velocity")]
    + ["cum_game_pitches"]
    + [f"FAM_PROB_{f}" for f in ("FB", "BR", "OS")]
)
CATEGORICAL = "stand p_throws count_state prev_pitch_1 prev_pitch_2 prev_pitch_3 prev_pitch_4".split()
