import pytest
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.functions import labels as L
from pitlog.functions.situation import with_situation
from pitlog.functions.weights import class_weight, time_decay


def column(spark, rows, schema, **exprs):
    df = spark.createDataFrame(rows, schema).select("*", *[e.alias(n) for n, e in exprs.items()])
    return [r.asDict() for r in df.collect()]


def test_canonical_types(spark):
    codes = ["FF", "SV", "FA", "FT", "CS", "ST", "SW", "KN", "EP", "??", None]
    rows = column(
        spark,
        [(c,) for c in codes],
        "code string",
        prior=L.canonical_type(F.col("code")),
        running=L.canonical_type(F.col("code"), S.CANONICAL_TYPES_RUNNING),
        to_date=L.canonical_type(F.col("code"), S.CANONICAL_TYPES_TO_DATE),
    )
    expected = ["FF", "SL", "FF", "SI", "CU", "ST", "OTHER", "OTHER", "OTHER", "OTHER", "OTHER"]
    assert [r["prior"] for r in rows] == expected
    assert [r["running"] for r in rows] == expected
    assert rows[6]["to_date"] == "ST"


def test_family_defaults_to_breaking(spark):
    rows = column(
        spark,
        [("FF",), ("ST",), ("OTHER",), ("nope",), (None,)],
        "t string",
        fam=L.pitch_family(F.col("t")),
    )
    assert [r["fam"] for r in rows] == ["FB", "OS", "BR", "BR", "BR"]


@pytest.mark.parametrize(
    "balls, strikes, state, label",
    [
        (0, 0, "EVEN", "0_0"),
        (1, 1, "EVEN", "1_1"),
        (2, 1, "BEHIND", "2_1"),
        (2, 2, "AHEAD", "2_2"),
        (0, 2, "AHEAD", "0_2"),
        (4, 3, "BEHIND", "3_2"),
        (None, 1, "AHEAD", "0_1"),
        (3, None, "AHEAD", "3_0"),
        (None, None, "AHEAD", "0_0"),
    ],
)
def test_count_states(spark, balls, strikes, state, label):
    row = column(
        spark,
        [(balls, strikes)],
        "b int, s int",
        state=L.count_state3(F.col("b"), F.col("s")),
        label=L.count_label12(F.col("b"), F.col("s")),
    )[0]
    assert (row["state"], row["label"]) == (state, label)


@pytest.mark.parametrize(
    "event, text, nine, six",
    [
        ("home_run", "hit_into_play", "HR", "HIT"),
        ("triple", None, "3B", "HIT"),
        ("double", None, "2B", "HIT"),
        ("single", None, "1B", "HIT"),
        ("fielders_choice", None, "FC", "OUT"),
        ("fielders_choice_out", None, "FC", "OUT"),
        ("sac_fly", "hit_into_play", "SAC", "BALL"),
        ("groundout", None, "OUT", "OUT"),
        ("field_out", "hit_into_play", "STRIKE", "OUT"),
        ("strikeout", "swinging_strike", "STRIKE", "STRIKEOUT"),
        ("walk", "ball", "BALL", "WALK"),
        ("field_error", "hit_into_play", "STRIKE", "OUT"),
        ("", "blocked_ball", "STRIKE", "BALL"),
        (None, "blocked_ball", "STRIKE", "BALL"),
        (None, "ball", "BALL", "BALL"),
        (None, "hit_by_pitch", "BALL", "BALL"),
        (None, "called_strike", "STRIKE", "STRIKE"),
        (None, "foul_tip", "STRIKE", "STRIKE"),
        (None, "swinging_strike_blocked", "STRIKE", "STRIKE"),
        (None, "hit_into_play", "STRIKE", "BALL"),
        (None, None, "STRIKE", "BALL"),
    ],
)
def test_outcomes(spark, event, text, nine, six):
    row = column(
        spark,
        [(event, text)],
        "e string, d string",
        nine=L.outcome9(F.col("e"), F.col("d")),
        six=L.outcome6(F.col("e"), F.col("d")),
    )[0]
    assert (row["nine"], row["six"]) == (nine, six)


def test_whiff_is_exact(spark):
    rows = column(
        spark,
        [("swinging_strike",), ("swinging_strike_blocked",), (None,)],
        "d string",
        whiff=L.flag(L.is_whiff(F.col("d"))),
    )
    assert [r["whiff"] for r in rows] == [1, 0, 0]


def test_situation_without_optional_columns(spark):
    df = spark.createDataFrame(
        [(2, 3, 2, 660271, None, None, 5), (None, None, None, None, None, None, None), (2, 0, 0, 1, None, None, 1)],
        "outs_when_up int, balls int, strikes int, on_1b long, on_2b long, on_3b long, home_score int",
    )
    rows = with_situation(df).collect()
    assert rows[0]["high_leverage"] == 0 and rows[0]["runners_on"] == 1
    assert rows[0]["full_count"] == 1 and rows[0]["close_game"] == 0
    assert rows[1]["count_state"] == "0_0" and rows[1]["late_inning"] == 0
    assert rows[2]["high_leverage"] == 1 and rows[2]["score_diff"] == 1


def test_weights(spark):
    rows = column(
        spark,
        [("FF",), ("FS",), ("FF",), ("KC",), ("OTHER",), ("FC",)],
        "t string",
        w=class_weight(F.col("t")),
        decay=time_decay(F.lit("2024-01-01").cast("date"), "2024-01-11", 0.1),
    )
    assert [r["w"] for r in rows] == [1, 2, 1, 1.5, 2, 1.3]
    assert abs(rows[0]["decay"] - 0.36787944117) < 1e-9
