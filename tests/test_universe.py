import random

import pytest

from marlstone.operators import universe as U
from marlstone.plans import evaluate as G
from marlstone.plans import panel as P


@pytest.mark.parametrize("assets", [3, 63, 64, 200])
def test_changes_against_sets(spark, assets):
    """Universes of one word and of several, with times that lack some, have more, or have none of the first words' assets."""
    rng = random.Random(assets)
    names = [f"a{k:03d}" for k in range(assets)]
    sets = {f"t{t:02d}": set(rng.sample(names, rng.randint(1, assets))) if t % 3 else set(names[: assets - 1]) for t in range(12)}
    sets["t11"] = {names[-1]}
    rows = [(t, a) for t, s in sets.items() for a in s]
    d = spark.createDataFrame(rows, "timestamp string, asset string")
    ids = U.numbered(d)
    found = U.universes(d, ids)
    assert {r.timestamp: (r.n, r.size) for r in found.withColumn("size", U.size()).collect()} == {t: (len(s), len(s)) for t, s in sets.items()}
    got = {r.timestamp: (r.missing, r.extra) for r in G.universe_changes(d).collect()}
    first = sets["t00"]
    assert got == {t: (sorted(first - s), sorted(s - first)) for t, s in sets.items() if s != first}
    plan = G.universe_changes(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_duplicates_nulls_and_nothing(spark):
    d = spark.createDataFrame([("t0", "a", "t1"), ("t0", "a", "t1"), ("t0", None, "t1"), ("t1", "a", "t2"), ("t1", None, "t2")], "timestamp string, asset string, target_close_time string")
    got = {r.timestamp: (r.n, r.size) for r in U.universes(d, U.numbered(d)).withColumn("size", U.size()).collect()}
    assert got == {"t0": (3, 2), "t1": (2, 2)}
    assert U.universes(d.where("false"), U.numbered(d.where("false"))).collect() == []
    none = P.panel_quality(d.where("false")).first()
    assert (none.decision_timestamps, none.asset_count, none.stable_asset_universe, none.duplicate_keys) == (0, 0, True, False)
