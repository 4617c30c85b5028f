import random

import pytest
from pyspark.sql import functions as F

from pitlog.operators.sequence import running_features
from pitlog.plans import features as P

SCHEMA = "k long, ab long, pn int, t string, v double"


def random_log(spark, hot_share=0.5, n=1500, seed=1):
    rnd = random.Random(seed)
    rows, used = [], set()
    while len(rows) < n:
        k = 0 if rnd.random() < hot_share else rnd.randrange(1, 30)
        ab = rnd.choice([rnd.randrange(0, 400), rnd.randrange(5000, 5010)])
        pn = rnd.randrange(1, 5)
        if (k, ab, pn) in used:
            continue
        used.add((k, ab, pn))
        rows.append((k, ab, pn, rnd.choice(["FF", "SL", None]), rnd.choice([None, rnd.random()])))
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def run(df, width):
    return running_features(
        df,
        ["k"],
        ["ab", "pn"],
        row_count="n",
        counts={"ff": F.col("t") == "FF"},
        means={"mean": F.col("v")},
        lags={"l1": ("t", 1), "l5": ("v", 5), "l3": ("t", 3)},
        block_width=width,
    )


def brute(df):
    rows = sorted(df.collect(), key=lambda r: (r["k"], r["ab"], r["pn"]))
    out, seen = {}, {}
    for r in rows:
        past = seen.setdefault(r["k"], [])
        vs = [p["v"] for p in past if p["v"] is not None]
        out[(r["k"], r["ab"], r["pn"])] = (
            len(past),
            sum(p["t"] == "FF" for p in past) if past else None,
            sum(vs) / len(vs) if vs else None,
            past[-1]["t"] if past else None,
            past[-5]["v"] if len(past) >= 5 else None,
            past[-3]["t"] if len(past) >= 3 else None,
        )
        past.append(r)
    return out


@pytest.mark.parametrize("width", [None, 1, 2, 7, 64, 65_536])
def test_blocks_equal_brute_force(spark, width):
    df = random_log(spark)
    want = brute(df)
    got = run(df, width).collect()
    assert len(got) == len(want)
    for r in got:
        n, ff, mean, l1, l5, l3 = want[(r["k"], r["ab"], r["pn"])]
        assert (r["n"], r["ff"], r["l1"], r["l5"], r["l3"]) == (n, ff, l1, l5, l3)
        assert (r["mean"] is None) == (mean is None)
        assert mean is None or r["mean"] == pytest.approx(mean)


def test_no_task_holds_a_whole_hot_sequence(spark):
    """The only window over a whole sequence runs on one row per block."""
    plan = run(random_log(spark), 64)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    whole = [w for w in windows if "_block" not in w.split("], [")[-2]]
    assert len(windows) >= 3 and len(whole) == 1
    assert "_carry_n" in whole[0]


def test_game_features_on_two_pitchers(spark):
    rows = [
        (1, 10, 1, 1, "FF", 90.0, 2000.0, 0, 0), (1, 10, 1, 2, "SL", 80.0, None, 1, 0),
        (1, 10, 2, 1, "FF", None, 2100.0, 0, 0), (1, 10, 2, 2, "CH", 82.0, 1500.0, 0, 1),
        (2, 10, 3, 1, "OTHER", 70.0, 1000.0, 0, 0), (2, 10, 3, 2, "FF", 95.0, 2300.0, 0, 1),
        (1, 11, 1, 1, "FF", 91.0, 2050.0, 0, 0),
    ]
    df = spark.createDataFrame(
        rows,
        "pitcher long, game_pk long, at_bat_number int, pitch_number int, pitch_type_can string, "
        "release_speed double, release_spin_rate double, balls int, strikes int",
    )
    got = {
        (r["pitcher"], r["game_pk"], r["at_bat_number"], r["pitch_number"]): r
        for r in P.within_game(df).collect()
    }
    first = got[(1, 10, 1, 1)]
    assert first["cum_game_pitches"] == 0 and first["cum_ff_count"] is None
    assert first["cum_ff_velocity"] is None and first["prev_pitch_1"] is None and first["dvelo1"] is None
    last = got[(1, 10, 2, 2)]
    assert last["cum_game_pitches"] == 3 and last["cum_ff_count"] == 2
    assert last["cum_ff_velocity"] == 90.0 and last["cum_ff_spin"] == 2050.0
    assert last["dvelo1"] is None and last["prev_pitch_3"] == "FF"
    assert got[(1, 10, 2, 1)]["dvelo1"] == -10.0
    assert got[(2, 10, 3, 2)]["prev_pitch_1"] == "OTHER"
    assert got[(1, 11, 1, 1)]["cum_game_pitches"] == 0

    current = {
        (r["pitcher"], r["at_bat_number"], r["pitch_number"]): r["dvelo_current"]
        for r in P.within_game_cumulative(df.where("game_pk = 10")).collect()
    }
    assert current[(1, 1, 2)] == -10.0 and current[(2, 3, 2)] == 25.0

    arrays = {
        (r["pitcher"], r["game_pk"], r["at_bat_number"], r["pitch_number"]): r
        for r in P.sequence_arrays(P.sequence_block(df)).collect()
    }
    row = arrays[(1, 10, 2, 2)]
    assert row["seq_types"] == [8, 8, 0, 1, 0] and row["target_id"] == 2
    assert row["seq_balls"] == [0, 0, 0, 1, 0]
    for r in P.sequence_arrays(P.sequence_block(df), include_current=True).collect():
        other = arrays[r["pitcher"], r["game_pk"], r["at_bat_number"], r["pitch_number"]]
        assert other["seq_dvelo"] == [0.0, *r["seq_dvelo"][:-1]]

    slots = P.slot_arrays(P.within_game(df)).collect()
    assert all(r["pitch_type_can"] != "OTHER" for r in slots)
    leaky = P.slot_arrays(P.within_game(df), include_current=True).collect()
    assert all(r["slot_ids"][0] == r["target_id"] for r in leaky)
