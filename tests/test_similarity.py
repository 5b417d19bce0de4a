"""Comps against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from puckspark.operators import similarity as sm
from puckspark.plans import comps


def brute(vectors, k):
    """{id: [(comp, score)]} over one pool, ties to the lower id."""
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], dtype=float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    s = np.round(unit @ unit.T, 12)
    return {i: sorted(((j, s[a, b]) for b, j in enumerate(ids) if j != i), key=lambda p: (-p[1], p[0]))[:k] for a, i in enumerate(ids)}


def pools(seed=3, hot=150):
    """One hot pool with duplicates and zero vectors, a small one, a pair and a single row."""
    rng = np.random.default_rng(seed)
    out = {}
    for pool, n in (("hot", hot), ("small", 9), ("pair", 2), ("one", 1), (None, 3)):
        m = rng.normal(size=(n, 5))
        if n > 5:
            m[3], m[4] = m[1], 0
            m[5:n // 2] = m[2]
        out[pool] = {len(out) * 1000 + i: list(map(float, v)) for i, v in enumerate(m)}
    return out


@pytest.mark.parametrize("block_rows", [10000, 20, 7])
def test_top_comps_equal_brute_force(spark, block_rows):
    data = pools()
    rows = [(p, i, v) for p, vs in data.items() for i, v in vs.items()]
    df = spark.createDataFrame(rows, "pool string, id long, vec array<double>")
    got = {}
    for r in sm.top_comps(df, ["pool"], "id", "vec", 25, block_rows).collect():
        got.setdefault((r.pool, r.id), []).append((r.rank, r.comp, r.score))
    want = {(p, i): best for p, vs in data.items() for i, best in brute(vs, 25).items() if best}
    assert set(got) == set(want)
    for key, best in want.items():
        mine = sorted(got[key])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [m[1] for m in mine] == [b[0] for b in best]
        assert np.allclose([m[2] for m in mine], [b[1] for b in best], atol=1e-11)


def clusters(spark, n, around=12, seed=2):
    """n vectors near ``around`` directions, a third of them copies of one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(around, 8))
    m = centres[rng.integers(0, around, n)] + rng.normal(scale=0.02, size=(n, 8))
    m[: n // 3] = centres[0]
    return {i: list(map(float, v)) for i, v in enumerate(m)}


def test_blocks_that_cannot_hold_a_better_row_are_left_out(spark):
    loads, sent = [], []
    for n in (1200, 2400):
        data = clusters(spark, n)
        df = spark.createDataFrame([("p", i, v) for i, v in data.items()], "pool string, id long, vec array<double>").repartition(4)
        loads.append(sm.comparison_load(df, ["pool"], "id", "vec", 5, block_rows=25))
        if n == 1200:
            got = {}
            for r in sm.top_comps(df, ["pool"], "id", "vec", 5, block_rows=25).collect():
                got.setdefault(r.id, []).append((r.rank, r.comp))
            want = brute(data, 5)
            assert {i: [c for _, c in sorted(v)] for i, v in got.items()} == {i: [c for c, _ in v] for i, v in want.items()}
    small, large = loads
    print(small, large)
    every = [x["blocks"] * (x["blocks"] - 1) // 2 for x in loads]
    assert all(x["pairs"] < e / 3 for x, e in zip(loads, every))
    assert small["vectors"] == 800 + 6 and large["vectors"] == 1600 + 6  # of the copies only k + 1 are compared
    assert large["rows_sent"] < 3.4 * small["rows_sent"]


def test_a_bound_holds_for_every_member():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    centres = {1: m[:4]}
    cell = (m @ m[:4].T).argmax(axis=1)
    angle = np.arccos(np.clip((m @ m[:4].T).max(axis=1), -1, 1))
    blocks = sm.Summaries(centres, [(1, c, c, float(angle[cell == c].max()), -2.0) for c in range(4)])
    for c in range(4):
        assert (blocks.reach(1, c, m) >= (m @ m[cell == c].T).max(axis=1) - 1e-12).all()
        assert blocks.partners(1, c) == list(range(c + 1, 4))


def test_leading_positions_with_ties():
    s = np.array([[0.5, 0.9, 0.5, -np.inf, 0.5], [-np.inf, -np.inf, 0.1, 0.2, 0.2]])
    row, col = sm._leading(s, 3)
    assert list(zip(row, col)) == [(0, 1), (0, 0), (0, 2), (1, 3), (1, 4), (1, 2)]


def players(spark, n, seed, group="F", season=20252026, start=1, nulls=()):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        feats = [float(x) for x in rng.uniform(0, 2, len(comps.SKATER_FEATURES))]
        faceoff = float(rng.uniform(0.4, 0.6)) if rng.random() > 0.5 else None
        for c in nulls:
            if i == 0:
                feats[comps.SKATER_FEATURES.index(c)] = None
        rows.append((start + i, season, f"{group}{i}", group, 40, *feats, faceoff))
    cols = ["player_id long", "season_id long", "full_name string", "position_group string", "games_played long"]
    return spark.createDataFrame(rows, ", ".join(cols + [f"{f} double" for f in comps.FORWARD_FEATURES]))


def matrix(df):
    return np.array([r.vec for r in df.orderBy("player_id").collect()])


def test_zscore_mean_zero_deviation_one_and_neutral_nulls(spark):
    z = matrix(sm.zscore(players(spark, 50, 1, nulls=["goals_per_60"]), ["position_group", "season_id"], comps.SKATER_FEATURES))
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(z.std(axis=0), 1, atol=1e-9)
    assert abs(z[0, 0]) < 1e-9


def test_constant_and_empty_features_become_zero(spark):
    df = players(spark, 20, 3).withColumn("pim_per_gp", F.lit(0.5)).withColumn("hits_per_60", F.lit(None).cast("double"))
    z = matrix(sm.zscore(df, ["position_group"], comps.SKATER_FEATURES))
    assert np.isfinite(z).all()
    assert not z[:, comps.SKATER_FEATURES.index("pim_per_gp")].any()
    assert not z[:, comps.SKATER_FEATURES.index("hits_per_60")].any()


def test_blend_only_returning_players(spark):
    now = sm.zscore(players(spark, 4, 4), ["position_group"], comps.SKATER_FEATURES)
    before = sm.zscore(players(spark, 2, 5, season=20242025), ["position_group"], comps.SKATER_FEATURES)
    mixed, a, b = matrix(sm.blend_prior(now, before, ["player_id"])), matrix(now), matrix(before)
    assert np.allclose(mixed[:2], 0.75 * a[:2] + 0.25 * b)
    assert np.allclose(mixed[2:], a[2:])


def test_a_single_earlier_player_is_not_blended(spark):
    now, before = players(spark, 6, 4), players(spark, 1, 5, season=20242025)
    both = comps.pool_vectors(now.unionByName(before), comps.SKATER_FEATURES, 20252026, 20242025)
    alone = comps.pool_vectors(now, comps.SKATER_FEATURES, 20252026, 20242025)
    assert np.allclose(matrix(both), matrix(alone))


def test_zero_weight_removes_a_feature(spark):
    z = sm.zscore(players(spark, 30, 6), ["position_group"], comps.SKATER_FEATURES)
    weights = dict.fromkeys(comps.SKATER_FEATURES, 0.0) | {"goals_per_60": 1.0}
    m = matrix(sm.apply_profiles(z, comps.SKATER_FEATURES, {"only": weights}))
    assert list(np.nonzero(np.abs(m).sum(axis=0))[0]) == [0]


def test_pools_profiles_and_ranks(spark):
    both = players(spark, 40, 8).unionByName(players(spark, 25, 9, "D", start=1000))
    pools_ = {"F": comps.FORWARD_FEATURES, "D": comps.SKATER_FEATURES}
    profiles = {"overall": {}, "light": dict.fromkeys(comps.PHYSICAL, 0.0)}
    out = comps.similarity(both, pools_, profiles, 20252026, 20242025, k=10).collect()
    assert len(out) == (40 + 25) * 2 * 10
    best = {}
    for r in out:
        assert r.player_id != r.comp_player_id
        assert (r.player_id < 1000) == (r.comp_player_id < 1000) == (r.position_group == "F")
        best.setdefault((r.profile, r.player_id), []).append((r["rank"], r.similarity_score, r.comp_player_id))
    for ranked in best.values():
        ranked.sort()
        assert [r[0] for r in ranked] == list(range(1, 11))
        assert [r[1] for r in ranked] == sorted((r[1] for r in ranked), reverse=True)
    assert any(best["overall", p][0][2] != best["light", p][0][2] for q, p in best if q == "overall")


def test_spot_check(spark):
    df = players(spark, 6, 2)
    sim = comps.similarity(df, {"F": comps.FORWARD_FEATURES}, {"overall": {}}, 20252026, 20242025, k=3)
    got = comps.spot_check(sim, df, ["F2", "nobody"]).collect()
    assert [(r.player_name, r["rank"]) for r in got] == [("F2", 1), ("F2", 2), ("F2", 3)]


@pytest.mark.parametrize("passing", [2, 16])
def test_blocks_passing_by_in_several_tasks_equal_brute_force(spark, monkeypatch, passing):
    """Vectors without clusters, so that no block can be left out; some copied, with names as ids."""
    monkeypatch.setattr(sm, "PASSING_BLOCKS", passing)
    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=(240, 4)) * 2)
    m[200:] = m[:40]
    data = {f"n{i:03d}": list(map(float, v)) for i, v in enumerate(m)}
    df = spark.createDataFrame([("p", i, v) for i, v in data.items()], "pool string, id string, vec array<double>")
    got = {}
    for r in sm.top_comps(df, ["pool"], "id", "vec", 6, block_rows=20).collect():
        got.setdefault(r.id, []).append((r.rank, r.comp, r.score))
    for i, best in brute(data, 6).items():
        assert [(c, round(s, 9)) for _, c, s in sorted(got[i])] == [(c, round(float(s), 9)) for c, s in best]


def test_nearest_keeps_the_best_whatever_the_order():
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 5))
    m[:60] = np.round(m[:60])  # many equal scores
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    row, comp, score = sm._best(np.arange(300), m, np.arange(300), m, 9)
    for piece in (300, 37):
        near = sm.Nearest(m, 9)
        for a in rng.permutation(np.arange(0, 300, piece)):
            there = m[a: a + piece]
            near.meet(there, np.arange(len(there) + 1), np.arange(a, a + len(there)))
        assert near.ids.ravel().tolist() == comp.tolist()
        assert np.allclose(near.scores.ravel(), score, atol=1e-12)


def test_copies_are_sent_once(spark):
    """Thirty copies of each vector take part as one row; a row for each of k + 1 copies was sent before."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(100, 4))
    rows = [("p", 100 * c + i, list(map(float, v))) for c in range(30) for i, v in enumerate(m)]
    load = sm.comparison_load(spark.createDataFrame(rows, "pool string, id long, vec array<double>"), ["pool"], "id", "vec", 5, block_rows=25)
    assert load["vectors"] == 600
    assert load["blocks"] < 12 and load["rows_sent"] <= 100 * load["blocks"]
