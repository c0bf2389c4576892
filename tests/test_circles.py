"""Circle totals against the listed pairs."""

import random

from pyspark.sql import functions as F

from emberlake.operators import circles
from emberlake.operators import firestats as FS

CELL = "cell_id string, lat double, lon double, bec_zone string, fuel_type string"
FIRE = "fire_id long, lat double, lon double, year int, cause string, size_ha double"


def _rows(seed):
    r = random.Random(seed)
    spots = [(r.uniform(49, 59), r.uniform(-138, -115)) for _ in range(6)]
    around = lambda km: (lambda s: (s[0] + r.gauss(0, km / 111), s[1] + r.gauss(0, km / 60)))(r.choice(spots))
    cells = [(f"c{i}", *around(6), r.choice(["IDF", "MS"]), "C3") for i in range(150)]
    cells += [cells[0], (None, *around(3), "IDF", "C3"), ("lost", None, -120.0, "IDF", "C3"), ("far", 85.0, 10.0, "AT", "C3")]
    fires = [(i, *around(8), r.choice([None, *range(1960, 2010)]), r.choice(["human", "lightning", None]), r.choice([None, r.uniform(0, 900)])) for i in range(3000)]
    fires += [(5000 + i, cells[3][1], cells[3][2], 1970 + i % 40, "human", float(i)) for i in range(120)] + [(9000, None, -120.0, 2000, "human", 1.0)]
    return cells, fires


def _flat(df):
    tiers = [F.col(f"fires_{t}.{c}") if c != "nearest_km" else F.round(f"fires_{t}.{c}", 6) for t in FS.TIERS for c in ("count", "nearest_km", "largest_ha")]
    causes = [F.array_sort(F.map_entries(f"fires_{t}.causes")).cast("string") for t in FS.TIERS]
    return sorted(map(str, df.select("cell_id", *tiers, *causes, "record_start").collect()))


def test_tiers_equal_those_of_all_pairs(spark, monkeypatch):
    cells, fires = _rows(1)
    cells, fires = spark.createDataFrame(cells, CELL), spark.createDataFrame(fires, FIRE)
    want = _flat(FS.tier_summary(cells, FS.matched_fires(cells, fires), 2009))
    called = []
    monkeypatch.setattr(FS, "within_radius", lambda *a, **k: called.append(1))
    assert _flat(FS.cell_tiers(cells, fires, 2009).select("*")) == want
    # crowded tiles are parted, and distances measured in small batches
    monkeypatch.setattr(circles, "MOST_CELLS", 7)
    monkeypatch.setattr(circles, "MOST_FIRES", 90)
    monkeypatch.setattr(circles, "BATCH", 50)
    monkeypatch.setattr(circles, "BLOCK", 3)
    assert _flat(FS.cell_tiers(cells, fires, 2009)) == want
    assert not called  # no pairs were listed


def test_without_fires_or_cells(spark):
    cells = spark.createDataFrame([("a", 50.0, -120.0, "IDF", "C3")], CELL)
    none = spark.createDataFrame([], FIRE)
    got = FS.cell_tiers(cells, none, 2009).collect()[0]
    assert (got.fires_all["count"], got.fires_all["nearest_km"], got.fires_all["causes"], got.record_start) == (0, None, {}, None)
    assert FS.cell_tiers(cells.where("false"), none, 2009).count() == 0


def test_parity_totals_equal_those_of_all_pairs(spark, monkeypatch):
    cells, fires = _rows(5)
    cells += [("lone", 50.0, -120.0, None, "C3")] + [(f"e{i}", 49.5 + i / 3000, -121.0, "CWH", "C3") for i in range(9)]
    fires += [(20_000 + i, 49.4 + i / 500, -121.0 - i / 900, 1990, "human", 1.0) for i in range(150)]  # past the edge of the zone's box
    cells, fires = spark.createDataFrame(cells, CELL), spark.createDataFrame(fires, FIRE)
    pairs = FS.matched_fires(cells, fires, parity_envelope=True)
    counted = lambda df, n: {r.cell_id: r.s for r in df.groupBy("cell_id").agg(F.sum(n).alias("s")).collect()}
    tiers, want = _flat(FS.tier_summary(cells, pairs, 2009)), counted(pairs, "fires")
    assert want != counted(FS.matched_fires(cells, fires), "fires") and "lone" not in want
    called = []
    monkeypatch.setattr(FS, "within_radius", lambda *a, **k: called.append(1))
    for cells_at_once, fires_at_once in ((circles.MOST_CELLS, circles.MOST_FIRES), (7, 90)):
        monkeypatch.setattr(circles, "MOST_CELLS", cells_at_once)
        monkeypatch.setattr(circles, "MOST_FIRES", fires_at_once)
        assert counted(FS.matched_fires(cells, fires, parity_envelope=True, since={"all": None}), "n_all") == want
        assert _flat(FS.cell_tiers(cells, fires, 2009, parity_envelope=True)) == tiers
    assert not called  # no pairs were listed
