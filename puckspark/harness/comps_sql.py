"""Player comparisons in DuckDB SQL, written apart from the library: z-scores, prior season, weights, cosine, best k.

Feature lists and weights are stated here again on purpose.
"""

from __future__ import annotations

from puckspark.harness.registry import R

# Fixed values of the comparison model: weight in the overall, offense and physical profile.
FORWARD = {
    "goals_per_60": (1, 1, 0.25), "assists_per_60": (1, 1, 0.25), "shots_per_60": (1, 1, 0.25), "shooting_pct": (1, 1, 0.25),
    "toi_minutes_per_gp": (1, 0.5, 0.75), "ev_points_per_60": (1, 1, 0.25), "pp_points_per_60": (1, 1, 0.25), "hits_per_60": (1, 0.25, 1),
    "blocks_per_60": (1, 0.25, 1), "pim_per_gp": (1, 0.25, 1), "plus_minus / nullif(games_played, 0)::DOUBLE": (1, 0.5, 0.5), "faceoff_pct": (1, 0.5, 0.5),
}
DEFENCE = {f: w for f, w in FORWARD.items() if f != "faceoff_pct"}
GOALIE = dict.fromkeys(("save_pct", "goals_against_average", "games_started", "win_pct_per_start", "shots_against_per_start", "shutout_rate"), (1,))


def compared(lines: str, features: dict[str, tuple[float, ...]], profiles: tuple[str, ...], now: int, before: int, min_prior: int = 2, k: int = 25) -> str:
    """(pool, id, profile, comp, s, rank) for ``lines``, a SELECT of pool, id, season and the features as x0, x1, ..."""
    n = range(len(features))
    z = ", ".join(
        f"CASE WHEN stddev_pop(coalesce(x{i}, m{i})) OVER w > 1e-12 THEN (coalesce(x{i}, m{i}) - m{i}) / stddev_pop(coalesce(x{i}, m{i})) OVER w ELSE 0 END" for i in n)
    means = ", ".join(f"coalesce(avg(x{i}) OVER w, 0) AS m{i}" for i in n)
    weights = ", ".join(f"('{p}', [{', '.join(str(float(w[j]) ** 0.5) for w in features.values())}])" for j, p in enumerate(profiles))
    return f"""WITH lines AS ({lines}), means AS (SELECT *, {means} FROM lines WHERE season IN ({now}, {before}) WINDOW w AS (PARTITION BY pool, season)),
  z AS (SELECT pool, id, season, [{z}] AS v, count(*) OVER w AS many FROM means WINDOW w AS (PARTITION BY pool, season)),
  prior AS (SELECT pool, id, v FROM z WHERE season = {before} AND many >= {min_prior}),
  blend AS (SELECT c.pool, c.id, CASE WHEN p.v IS NULL THEN c.v ELSE list_transform(list_zip(c.v, p.v), lambda e: 0.75 * e[1] + 0.25 * e[2]) END AS v
    FROM z c LEFT JOIN prior p ON p.pool = c.pool AND p.id = c.id WHERE c.season = {now}),
  scaled AS (SELECT pool, id, profile, list_transform(list_zip(v, g), lambda e: e[1] * e[2]) AS v FROM blend, (VALUES {weights}) AS p(profile, g)),
  pairs AS (SELECT a.pool, a.id, a.profile, b.id AS comp,
    round(coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0), 12) AS s
    FROM scaled a JOIN scaled b ON a.pool = b.pool AND a.profile = b.profile AND a.id <> b.id)
  SELECT *, row_number() OVER (PARTITION BY id, profile ORDER BY s DESC, comp) AS rank FROM pairs
  QUALIFY row_number() OVER (PARTITION BY id, profile ORDER BY s DESC, comp) <= {k}"""


def similarity_sql(now: int, before: int) -> str:
    """All pools of the comparison table."""
    def pool(group: str, table: str, games: int, features: dict, profiles: tuple[str, ...]) -> str:
        columns = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
        lines = f"SELECT 1 AS pool, player_id AS id, season_id AS season, {columns} FROM {table} WHERE games_played >= {games} AND position_group = '{group}'"
        return f"""SELECT id AS player_id, comp AS comp_player_id, {R('s', 6)} AS similarity_score, rank, CAST({now} AS BIGINT) AS season_id, profile,
  '{group}' AS position_group FROM ({compared(lines, features, profiles, now, before)})"""

    skater = ("overall", "offense", "physical")
    return " UNION ALL ".join((
        pool("F", "mart_player_season", 20, FORWARD, skater), pool("D", "mart_player_season", 20, DEFENCE, skater), pool("G", "mart_goalie_season", 15, GOALIE, ("overall",))))
