"""Column functions: null-safe arithmetic, decoding of ids and clocks, rink geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data feed.
NET_X = 89.0
PERIOD_SECONDS = 1200


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sdiv(a, b) -> Column:
    """a / b, null when b is zero or either side is null."""
    return F.try_divide(as_col(a), as_col(b))


def rnd(x, k: int) -> Column:
    """Round half away from zero on the binary value (not on its decimal text)."""
    x = as_col(x).cast("double")
    scale = float(10**k)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / F.lit(scale)


def ratio(a, b, k: int) -> Column:
    return rnd(sdiv(a, b), k)


def minutes(seconds, k: int = 2) -> Column:
    return rnd(as_col(seconds) / 60, k)


def per_game(df_cols: dict[str, str], games: str, k: int = 4) -> dict[str, Column]:
    """{output: total column} -> per-game rates."""
    return {out: ratio(c, games, k) for out, c in df_cols.items()}


def per_60(pairs: dict[str, tuple[str, str]], k: int = 4) -> dict[str, Column]:
    """{output: (total column, seconds column)} -> rates per 60 minutes of that ice time."""
    return {out: ratio(as_col(c) * 3600, sec, k) for out, (c, sec) in pairs.items()}


def surrogate_key(*cols) -> Column:
    """Parts joined by '-', null if any part is null."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit("-"), as_col(c).cast("string")]
    return F.concat(*parts[1:])


def digits(number, pos: int, length: int) -> Column:
    """Integer read from decimal digits pos..pos+length-1 (1-based) of an id."""
    return F.substring(as_col(number).cast("string"), pos, length).cast("long")


def season_of_year(year) -> Column:
    """1998 -> 19981999."""
    y = as_col(year).cast("long")
    return y * 10000 + y + 1


def season_start(season) -> Column:
    return F.floor(as_col(season) / 10000).cast("long")


def season_end(season) -> Column:
    return (as_col(season) % 10000).cast("long")


def season_label(season) -> Column:
    """19811982 -> '1981-82'."""
    return F.concat(
        season_start(season).cast("string"),
        F.lit("-"),
        F.substring(season_end(season).cast("string"), 3, 2),
    )


def season_span(first, last) -> Column:
    """19791980, 19981999 -> '1979-1999'."""
    return F.concat(season_start(first).cast("string"), F.lit("-"), season_end(last).cast("string"))


def age_at_season_end(birth, season) -> Column:
    """Whole years on 15 April of the season's second year."""
    day = F.make_date(season_end(season).cast("int"), F.lit(4), F.lit(15))
    return F.floor(F.datediff(day, as_col(birth)) / 365.25).cast("long")


def clock_seconds(c) -> Column:
    """'MM:SS' -> seconds; null when absent or without a colon."""
    c = as_col(c)
    parts = F.split(c, ":")
    return F.when(
        c.contains(":"), parts[0].cast("long") * 60 + parts[1].cast("long")
    )


def game_seconds(period, clock) -> Column:
    """Seconds since the opening face-off."""
    return (as_col(period).cast("long") - 1) * PERIOD_SECONDS + clock_seconds(clock)


def attack_net_x(is_home, home_defends) -> Column:
    """x of the net a shooter attacks; the home side attacks right when it defends left."""
    toward_right = as_col(is_home) == (as_col(home_defends) == F.lit("left"))
    return F.when(toward_right, F.lit(NET_X)).otherwise(F.lit(-NET_X))


def shot_distance(x, y, net_x) -> Column:
    return rnd(F.hypot(as_col(net_x) - as_col(x), as_col(y).cast("double")), 2)


def shot_angle(x, y, net_x) -> Column:
    """Degrees off the centre line, 0 on the net itself (atan2(0, 0) is 0)."""
    across = F.abs(as_col(y).cast("double"))
    return rnd(F.degrees(F.atan2(across, F.abs(as_col(net_x) - as_col(x)))), 2)


def strength_state(code, is_home) -> Column:
    """PP / EV / SH for the shooter; digits 2 and 3 of the code count away and home skaters."""
    code = as_col(code)
    lead = F.substring(code, 3, 1).try_cast("int") - F.substring(code, 2, 1).try_cast("int")
    lead = F.when(as_col(is_home), lead).otherwise(-lead)
    known = F.length(code) == 4
    return F.when(known & (lead > 0), "PP").when(known & (lead < 0), "SH").otherwise("EV")


def position_group(code, goalies: bool = True) -> Column:
    code = as_col(code)
    chain = F.when(code == "D", "D")
    if goalies:
        chain = chain.when(code == "G", "G")
    return chain.otherwise("F")


def game_result(scored, conceded, last_period=None) -> Column:
    """W, L or OTL; without a last-period column only W and L exist."""
    won = as_col(scored) > as_col(conceded)
    if last_period is None:
        return F.when(won, "W").otherwise("L")
    return F.when(won, "W").when(as_col(last_period) == "REG", "L").otherwise("OTL")


def last_in_list(c, sep: str = ",") -> Column:
    """'BUF, STL' -> 'STL'."""
    return F.trim(F.element_at(F.split(as_col(c), sep), -1))


def ratio_part(c, index: int, strict: bool = False) -> Column:
    """Part 0 or 1 of 'a/b'. Lenient: null unless two parts and that part is all digits."""
    parts = F.split(as_col(c), "/")
    if strict:
        return parts[index].cast("long")
    part = F.get(parts, F.lit(index))
    return F.when((F.size(parts) == 2) & part.rlike(r"^\d+$"), part.try_cast("long"))


def json_text(c, path: str) -> Column:
    return F.get_json_object(as_col(c), path)
