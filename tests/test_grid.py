"""Tiles, splits, slope, morphology, burning, sampling, uncertainty."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralume.operators import grid as G
from terralume.operators import morphology as M
from terralume.operators import sampling as S
from terralume.operators import terrain
from terralume.operators import uncertainty as U
from terralume.operators.ranks import placed


def pixels(spark, mask):
    return spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "r int, c int")


def back(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        out[r.r, r.c] = True
    return out


def test_tile_edges_are_shared(spark):
    n, tile = 1000, 153.6
    tiles = math.ceil(n / tile)
    df = spark.range(n).select(F.col("id").cast("int").alias("p")).withColumn("t", G.tiles_of_axis("p", tiles, tile))
    got = {}
    for r in df.collect():
        got.setdefault(r.p, set()).add(r.t)
    want = {p: {t for t in range(tiles) if math.floor(t * tile) <= p < math.ceil((t + 1) * tile)} for p in range(n)}
    assert got == want and sum(len(v) == 2 for v in got.values()) > 0


def test_split_keeps_a_buffer(spark):
    tiles = G.with_blocks(G.tile_grid(spark, (0, 0, 5000, 5000)))
    rows = G.cv_split(tiles).collect()
    split = {(r.row, r.col): r.split for r in rows}
    for (r, c), s in split.items():
        if s == "train":
            assert all(split.get((r + a, c + b)) != "test" for a in (-1, 0, 1) for b in (-1, 0, 1))
    assert set(split.values()) == {"train", "val", "test", "buffer"}
    assert split == {(r.row, r.col): r.split for r in G.cv_split(tiles).collect()}


def test_slope_of_an_invalid_centre(spark):
    z = np.add.outer(np.arange(4.0), np.arange(5.0) * 2)
    rows = [(r, c, None if (r, c) == (1, 2) else float(z[r, c])) for r in range(4) for c in range(5)]
    got = {(x.r, x.c): x.slope_deg for x in terrain.slope(spark.createDataFrame(rows, "r int, c int, dem double"), 4, 5).collect()}
    assert got[1, 2] == pytest.approx(math.degrees(math.atan(math.hypot(1, 2))))
    assert got[1, 1] is None and got[0, 2] is None and got[3, 4] == pytest.approx(got[1, 2])


def test_components_across_seams(spark, monkeypatch):
    rng = np.random.default_rng(1)
    mask = rng.random((40, 37)) < 0.6
    monkeypatch.setattr(M, "BLOCK", 8)
    got = {(r.r, r.c): r.comp for r in M.label_components(pixels(spark, mask)).collect()}
    seen, want = {}, {}
    for r, c in zip(*np.nonzero(mask)):
        if (r, c) in seen:
            continue
        todo, comp = [(r, c)], []
        seen[r, c] = True
        while todo:
            y, x = todo.pop()
            comp.append((y, x))
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < 40 and 0 <= b < 37 and mask[a, b] and (a, b) not in seen:
                    seen[a, b] = True
                    todo.append((a, b))
        low = min(int(y) * 2**31 + int(x) for y, x in comp)
        want |= {(int(y), int(x)): low for y, x in comp}
    assert got == want


def test_opening_and_small(spark):
    mask = np.zeros((9, 9), bool)
    mask[0:3, 0:3] = True
    mask[6, 6] = True
    mask[4:9, 0:4] = True
    got = back(M.opening(pixels(spark, mask), 9, 9), mask.shape)
    pad = np.pad(mask, 1)
    core = pad[1:-1, 1:-1] & pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]
    wide = np.pad(core, 1)
    want = wide[1:-1, 1:-1] | wide[:-2, 1:-1] | wide[2:, 1:-1] | wide[1:-1, :-2] | wide[1:-1, 2:]
    assert (got == want).all() and not got[6, 6]
    five = back(M.clean(pixels(spark, mask), 9, 9, 6), mask.shape)
    assert not five[1, 1] and five[6, 1]
    assert back(M.clean(pixels(spark, mask), 9, 9, 5), mask.shape)[1, 1]  # exactly the least area stays
    assert M.opening(pixels(spark, mask), 9, 9, 0).count() == mask.sum()


@pytest.mark.parametrize("shrink,grow", [(1, 1), (2, 2), (2, 0), (0, 3), (5, 5)])
def test_steps_over_seams(spark, monkeypatch, shrink, grow):
    """Squares with a halo against whole-grid steps; the halo may be wider than a square."""
    monkeypatch.setattr(M, "BLOCK", 8)
    mask = np.random.default_rng(shrink * 10 + grow).random((29, 37)) < (0.97 if shrink else 0.05)
    mask[9:26, 5:22] = bool(shrink)
    df = pixels(spark, mask)
    got = M.erode(df, shrink) if not grow else M.dilate(df, 29, 37, grow) if not shrink else M.opening(df, 29, 37, shrink)
    want = mask
    for step in [np.logical_and] * shrink + [np.logical_or] * grow:
        p = np.pad(want, 1)
        want = step.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
    rows = [(r.r, r.c) for r in got.collect()]
    assert len(rows) == len(set(rows)) == want.sum() > 0
    assert set(rows) == {(int(r), int(c)) for r, c in zip(*np.nonzero(want))}
    assert got.schema["r"].dataType == df.schema["r"].dataType
    if shrink == grow:
        together = M.opened_components(df, 29, 37, shrink).collect()
        apart = M.label_components(got).collect()
        assert {(r.r, r.c, r.comp) for r in together} == {(r.r, r.c, r.comp) for r in apart}


def test_steps_of_nothing(spark):
    none = spark.createDataFrame([], "r int, c int")
    assert M.opening(none, 9, 9).count() == M.erode(none).count() == M.opened_components(none, 9, 9).count() == 0
    assert M.opened_components(spark.createDataFrame([(3, 3)], "r int, c int"), 9, 9).count() == 0


@pytest.mark.parametrize("n", [0, 1, 700])
def test_places_without_a_global_window(spark, n):
    rows = spark.range(n).select((F.col("id") * 7919 % 1009).alias("k"), F.lit("x").alias("place_name"))
    got = placed(rows, [F.col("k").desc()]).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.place)] == sorted((i * 7919 % 1009 for i in range(n)), reverse=True)
    assert sorted(r.place for r in got) == list(range(n)) and all(r.n_rows == n and r.place_name == "x" for r in got)


def test_burn_polygon_against_points(spark):
    ring = [(1.2, 1.1), (6.3, 2.0), (4.0, 6.6)]
    df = spark.createDataFrame([(1, [dict(x=x, y=y) for x, y in ring]), (2, None)], "id int, ring array<struct<x:double,y:double>>")
    got = back(M.burn_polygons(df, 0.0, 8.0, 1.0, 8, 8), (8, 8))
    rng, touched = random.Random(0), np.zeros((8, 8), bool)

    def inside(x, y):
        out = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                out = not out
        return out

    for _ in range(60000):
        x, y = rng.random() * 8, rng.random() * 8
        if inside(x, y):
            touched[int(8 - y), int(x)] = True
    assert (got >= touched).all() and (got & ~touched).sum() <= 1
    assert M.burn_polygons(df, 0.0, 8.0, 1.0, 8, 8, 1.0).count() > got.sum()


def test_roofs_go(spark):
    lab = spark.createDataFrame([(0, c, 0) for c in range(5)] + [(2, c, 9) for c in range(5)] + [(4, 0, 20)], "r int, c int, comp long")
    green = spark.createDataFrame([(0, c, 0.2) for c in range(5)] + [(2, 0, 0.2)], "r int, c int, exg double")
    assert {r.comp for r in M.suppress_low_green(lab, green, 0.04, 5).collect()} == {0, 20}


def test_round_robin(spark):
    rows = [(i, f"c{i % 3}", 100, float(i % 50)) for i in range(40)]
    st = S.with_strata(spark.createDataFrame(rows, "tile_id int, city string, valid_px int, canopy_pct double"))
    got = S.round_robin(st, 12).orderBy("sample_id").collect()
    assert [r.sample_id for r in got] == [f"m3_{i:04d}" for i in range(12)] and len({r.tile_id for r in got}) == 12
    turns = [r.turn for r in got]
    assert turns == sorted(turns)
    one = S.with_strata(spark.createDataFrame([(1, 0, 5.0)], "tile_id int, valid_px int, canopy_pct double")).first()
    assert (one.city, one.slope_bin, one.removed_ratio, one.canopy_bin) == ("unknown", "unknown", 0.0, "sparse")


def test_probabilities(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0],), ([800.0, 0.0, 0.0],)], "z array<double>").withColumn("p", U.softmax("z"))
    got = df.select(U.argmax("p").alias("a"), U.confidence("p").alias("c"), U.entropy("p").alias("e"), U.pseudo_label("p").alias("k")).collect()
    assert [r.a for r in got] == [0, 0] and got[1].c == 1.0 and got[1].e == pytest.approx(0, abs=1e-6) and [r.k for r in got] == [255, 0]
    img = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "v array<int>").select(U.flip("v", 2, 3, True, False).alias("a"), U.flip("v", 2, 3, False, True).alias("b")).first()
    assert img.a == [4, 5, 6, 1, 2, 3] and img.b == [3, 2, 1, 6, 5, 4]


def test_grids_and_windows(spark):
    g = dict(crs="EPSG:2193", rows=3, cols=4, left=0.0, top=9.0, res=1.0)
    assert G.grid_warnings(g, dict(g)) == [] and len(G.grid_warnings(g, dict(g, rows=4, left=0.1))) == 2
    with pytest.raises(ValueError):
        G.require_crs(dict(g, crs="EPSG:4326"))
    v = np.zeros((10, 10))
    v[4:8, 2:6] = 1
    df = spark.createDataFrame([(r, c, float(v[r, c])) for r in range(10) for c in range(10)], "r int, c int, v double")
    best = G.best_window(df, "v", 4, 10, 10).first()
    assert (best.y0, best.x0, best.score) == (4, 2, 1.0)
    assert G.sample_points(df, 4, 10).count() == 16
    assert G.fixed_tiles(df, 4, 10, 10).count() == 64


def test_heightmap_takes_the_window_of_most_contrast(spark, monkeypatch):
    from terralume.plans import canopy

    h = np.zeros((120, 50))
    h[80:120, 30:50] = 9.0
    df = spark.createDataFrame([(r, c, float(h[r, c])) for r in range(120) for c in range(50)], "r int, c int, h double")
    monkeypatch.setattr(canopy.V, "chm_px", lambda *_: df)
    spots = [(y, x) for y in range(0, 81, 10) for x in range(0, 11, 10)]
    y0, x0 = max(spots, key=lambda s: (h[s[0] : s[0] + 40, s[1] : s[1] + 40] >= 3).std())
    at = np.linspace(0, 39, 16).astype(int)
    want = h[np.ix_(y0 + at, x0 + at)]
    got = {(r.gy, r.gx): (r.z, r.canopy) for r in canopy.heightmap(spark, "").collect()}
    assert (y0, x0) == (80, 10) and got == {(i, j): (want[i, j], bool(want[i, j] >= 3)) for i in range(16) for j in range(16)}
    told = canopy.heightmap_summary(spark, "").first()
    assert (told.zmin, told.zmax, told.canopy_fraction, told.n) == (0.0, 9.0, round(float((want >= 3).mean()), 2), 256)


@pytest.mark.parametrize("held", [250_000, 7])
def test_components_of_edges(spark, monkeypatch, held):
    """A long path, a hub and random pairs, in one task and in distributed rounds."""
    from terralume.operators import components as C
    from terralume.sources.scratch import Scratch

    monkeypatch.setattr(C, "TASK_EDGES", held)
    rng = np.random.default_rng(8)
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, 1000 + k) for k in range(1, 200)]
    loose = [(int(a), int(b)) for a, b in rng.integers(2000, 2060, (40, 2))]
    edges = path + hub + loose + [(b, a) for a, b in path] + [(-5, -9), (7, 7)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = C.components(frame, Scratch(spark)).collect()
    assert len(got) == len(up) and {r.node: r.root for r in got} == {x: top(x) for x in up}
    assert C.components(frame.limit(0), Scratch(spark)).count() == 0


def test_transverse_mercator(spark):
    from terralume.functions import indices as I

    # Published grid positions, to the metre.
    known = [(32617, -79.387139, 43.642567, 630084.0, 4833438.0), (2193, 173.0, 0.0, 1600000.0, 10000000.0), (32733, 15.0, 0.0, 500000.0, 10000000.0)]
    for epsg, lon, lat, east, north in known:
        df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
        e, n = I.transverse_mercator("lon", "lat", epsg)
        r = df.select(e.alias("e"), n.alias("n")).first()
        assert (r.e, r.n) == pytest.approx((east, north), abs=1.0)
    df = spark.range(400).select((166 + F.col("id") % 20 * 0.7).alias("lon"), (-48 + F.col("id") / 28).alias("lat"))
    e, n = I.transverse_mercator("lon", "lat", 2193)
    lon, lat = I.transverse_mercator_inverse("e", "n", 2193)
    back = df.select("lon", "lat", e.alias("e"), n.alias("n")).select("lon", "lat", lon.alias("lon2"), lat.alias("lat2"))
    assert back.filter((F.abs(F.col("lon") - F.col("lon2")) > 1e-9) | (F.abs(F.col("lat") - F.col("lat2")) > 1e-9)).count() == 0
    with pytest.raises(ValueError, match="EPSG"):
        I.transverse_zone(4326)
