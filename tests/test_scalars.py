import math

import pytest
from pyspark.sql import functions as F

from puckspark.functions import scalars as S


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("period,clock,want", [(1, "00:21", 21), (2, "05:30", 1530), (4, "01:00", 3660), (1, None, None), (1, "x", None)])
def test_game_seconds(spark, period, clock, want):
    assert value(spark, S.game_seconds(F.lit(period), F.lit(clock).cast("string"))) == want


@pytest.mark.parametrize("home,side,want", [(True, "left", 89), (False, "left", -89), (True, "right", -89), (False, "right", 89)])
def test_attack_net(spark, home, side, want):
    assert value(spark, S.attack_net_x(F.lit(home), F.lit(side))) == want


@pytest.mark.parametrize("x,y,net,distance,angle", [(84, -10, 89, 11.18, 63.43), (59, 0, 89, 30.0, 0.0), (-70, 0, 89, 159.0, 0.0), (89, 0, 89, 0.0, 0.0)])
def test_shot_geometry(spark, x, y, net, distance, angle):
    args = F.lit(x), F.lit(y), F.lit(net)
    assert value(spark, S.shot_distance(*args)) == distance
    assert value(spark, S.shot_angle(*args)) == angle


@pytest.mark.parametrize("code,home,want", [("1551", True, "EV"), ("1451", True, "PP"), ("1451", False, "SH"), ("0651", False, "PP"), ("", True, "EV"), (None, True, "EV"), ("15", True, "EV"), ("wxyz", True, "EV")])
def test_strength(spark, code, home, want):
    assert value(spark, S.strength_state(F.lit(code).cast("string"), F.lit(home))) == want


def test_ids_and_labels(spark):
    game = F.lit(2025030415)
    assert [value(spark, S.digits(game, p, 1)) for p in (8, 9, 10)] == [4, 1, 5]
    assert value(spark, S.digits(game, 5, 2)) == 3
    assert value(spark, S.season_label(F.lit(19811982))) == "1981-82"
    assert value(spark, S.season_label(F.lit(19992000))) == "1999-00"
    assert value(spark, S.season_span(F.lit(19791980), F.lit(19981999))) == "1979-1999"
    assert value(spark, S.season_of_year(F.lit(2025))) == 20252026
    assert value(spark, S.last_in_list(F.lit("BUF, STL"))) == "STL"
    assert value(spark, S.last_in_list(F.lit("PIT"))) == "PIT"


def test_rounding_and_division(spark):
    assert value(spark, S.rnd(F.lit(0.285), 2)) == 0.28  # the binary value lies below the tie
    assert value(spark, S.rnd(F.lit(-2.5), 0)) == -3.0
    assert value(spark, S.rnd(F.lit(0.125), 2)) == 0.13
    assert value(spark, S.sdiv(F.lit(3), F.lit(0))) is None
    assert value(spark, S.sdiv(F.lit(3.0), F.lit(0.0))) is None
    assert value(spark, S.sdiv(F.lit(1), F.lit(4))) == 0.25
    assert value(spark, S.minutes(F.lit(95))) == pytest.approx(math.floor(95 / 60 * 100 + 0.5) / 100)


def test_age(spark):
    age = lambda born: value(spark, S.age_at_season_end(F.lit(born).cast("date"), F.lit(20252026)))
    # years of 365.25 days: on the 26th birthday itself 9,496 days are still 25.998 years
    assert (age("1987-08-07"), age("2000-04-14"), age("2000-04-15"), age(None)) == (38, 26, 25, None)


def test_keys_and_ratios(spark):
    assert value(spark, S.surrogate_key(F.lit(8), F.lit("PIT"))) == "8-PIT"
    assert value(spark, S.surrogate_key(F.lit(8), F.lit(None).cast("string"))) is None
    parts = lambda text: tuple(value(spark, S.ratio_part(F.lit(text).cast("string"), i)) for i in (0, 1))
    assert parts("25/28") == (25, 28)
    assert parts("0/0") == (0, 0)
    assert parts("a/28") == (None, 28)
    assert parts("25") == parts("1/2/3") == parts("") == parts(None) == (None, None)
    with pytest.raises(Exception):
        value(spark, S.ratio_part(F.lit("a/2"), 0, strict=True))
    with pytest.raises(Exception):
        value(spark, S.ratio_part(F.lit("2"), 1, strict=True))


def test_results(spark):
    result = lambda a, b, last: value(spark, S.game_result(F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(last).cast("string")))
    assert [result(3, 2, "OT"), result(1, 2, "REG"), result(1, 2, "SO"), result(None, None, None)] == ["W", "L", "OTL", "OTL"]
