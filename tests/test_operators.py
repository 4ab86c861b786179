import math
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from lumera.functions import color
from lumera.operators import bilateral, blur, order_statistics, pointwise, tonemap
from lumera.operators.order_statistics import percentiles
from lumera.schema import PIXELS, RGB, XYZ


def image(spark, values, name="i"):
    values = np.asarray(values, float)
    h, w, _ = values.shape
    return spark.createDataFrame([(name, x, y, *map(float, values[y, x])) for y in range(h) for x in range(w)], PIXELS)


def array(df, names=("c1", "c2", "c3")):
    rows = df.collect()
    out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1, len(names)), np.nan)
    for r in rows:
        out[r.y, r.x] = [r[n] for n in names]
    return out


def noise(h, w, seed=0):
    return np.random.default_rng(seed).uniform(0.01, 5, (h, w, 3))


def kernel_mean(v, weights, axis):
    r = len(weights) // 2
    pad = [(r, r) if i == axis else (0, 0) for i in range(3)]
    padded = np.pad(v, pad, mode="edge")
    n = v.shape[axis]
    return sum(k * np.take(padded, range(i, i + n), axis) for i, k in enumerate(weights)) / sum(weights)


@pytest.mark.parametrize(("h", "w", "r"), [(13, 7, 2), (5, 9, 6), (1, 1, 3)])
def test_blurs_against_numpy(spark, h, w, r):
    v = noise(h, w)
    px = image(spark, v)
    assert np.allclose(array(blur.box_blur(px, r, "x")), kernel_mean(v, [1] * (2 * r + 1), 1))
    assert np.allclose(array(blur.box_blur(px, r, "y")), kernel_mean(v, [1] * (2 * r + 1), 0))
    triangle = [r + 1 - abs(k) for k in range(-r, r + 1)]
    assert np.allclose(array(blur.stack_blur(px, r)), kernel_mean(kernel_mean(v, triangle, 1), triangle, 0))
    assert array(blur.stack_blur(px, 0)).shape == v.shape


def test_gaussian_keeps_mass_and_constants(spark):
    assert blur.box_sizes(3) == [5, 5, 7] and sum((n * n - 1) / 12 for n in blur.box_sizes(10)) == pytest.approx(100, rel=0.05)
    spot = np.zeros((33, 33, 3))
    spot[16, 16] = 1
    out = array(blur.fast_gaussian(image(spark, spot), 3))
    assert out[..., 0].sum() == pytest.approx(1) and out[16, 16, 0] == out[..., 0].max()
    assert np.allclose(array(blur.fast_gaussian(image(spark, np.full((6, 6, 3), 2.5)), 3)), 2.5)


def dense_bilateral(v, lum, space=16.0):
    """The luminance grid as dense arrays, pass by pass."""
    h, w = lum.shape
    low, step = lum.min(), (lum.max() - lum.min()) * 0.1
    size = [int((w - 1) / space) + 5, int((h - 1) / space) + 5, int((lum.max() - low) / step) + 5]
    grid = np.zeros((*size, 2))
    for y in range(h):
        for x in range(w):
            grid[int(x / space + 0.5) + 2, int(y / space + 0.5) + 2, int((lum[y, x] - low) / step + 0.5) + 2] += (lum[y, x], 1)
    for axis in range(3):
        for _ in range(2):
            new = np.zeros_like(grid)
            mid = (slice(1, -1),) * 3
            before, after = list(mid), list(mid)
            before[axis], after[axis] = slice(0, -2), slice(2, None)
            new[mid] = (grid[tuple(before)] + 2 * grid[mid] + grid[tuple(after)]) / 4
            grid = new
    value = np.divide(grid[..., 0], grid[..., 1], out=np.zeros(size), where=grid[..., 1] != 0)
    out = np.zeros_like(lum)
    for y in range(h):
        for x in range(w):
            at = np.array([x / space + 2, y / space + 2, (lum[y, x] - low) / step + 2])
            b = at.astype(int)
            a = at - b
            for d in np.ndindex(2, 2, 2):
                out[y, x] += np.prod([a[i] if d[i] else 1 - a[i] for i in range(3)]) * value[tuple(b + d)]
    return out


def test_luminance_bilateral_against_dense_grid(spark):
    v = noise(20, 40, 3)
    v[:, 20:] += 50
    out = array(bilateral.y_fast_bilateral(image(spark, v), XYZ))
    base = dense_bilateral(v, v[..., 1])
    assert np.allclose(out[..., 1], base) and np.allclose(out[..., 0], v[..., 0] - (v[..., 1] - base))
    assert out[:, 20:, 1].min() > 40 and out[:, :20, 1].max() < 10


def test_colour_bilateral(spark):
    v = noise(12, 12, 4)
    v[:, 6:] += 30
    out = array(bilateral.fast_bilateral(image(spark, v), RGB, sigma_space=4.0))
    assert out[:, 6:].min() > 25 and out[:, :6].max() < 10
    assert out[:, :6].std() < v[:, :6].std()


@pytest.mark.parametrize("name", ["fast_bilateral", "y_fast_bilateral"])
def test_grid_cells_are_never_broadcast(spark, name):
    """As many cells as pixels are a few bytes in Parquet: only statistics, one row an image, may go through the driver."""
    got = getattr(bilateral, name)(image(spark, noise(12, 12, 4)), RGB, sigma_space=0.4)
    assert got.count() == 144
    joins = re.findall(r"(\w+Join) \[(.*?)\]", got._jdf.queryExecution().executedPlan().toString())
    assert [keys for join, keys in joins if "Broadcast" in join and re.search(r"\b[bg]\d#", keys)] == []
    assert sum(join == "SortMergeJoin" for join, _ in joins) >= 3


def test_flat_images(spark):
    flat = image(spark, np.full((8, 8, 3), 0.5))
    assert np.allclose(array(bilateral.y_fast_bilateral(flat, XYZ)), 0.5)
    assert np.allclose(array(bilateral.fast_bilateral(flat, RGB)), 0.5)
    assert (array(tonemap.linear(flat, RGB), "rgb") == 0).all()


@pytest.mark.parametrize("name", sorted(tonemap.OPERATORS))
def test_tone_mapping_range_and_batches(spark, name):
    a, b = noise(24, 30, 5), noise(16, 20, 6) * 100
    op = tonemap.OPERATORS[name]
    both = op(image(spark, a, "a").unionByName(image(spark, b, "b")), RGB)
    rows = both.collect()
    assert len(rows) == 24 * 30 + 16 * 20 and all(0 <= c <= 65535 for r in rows for c in (r.r, r.g, r.b)) and {r.a for r in rows} == {65535}
    alone = array(op(image(spark, a, "a"), RGB), "rgb")
    together = array(both.where("image_id = 'a'"), "rgb")
    assert np.abs(alone - together).max() <= 1
    assert together.max() > together.min()


@pytest.mark.parametrize("name", ["linear", "logarithmic", "drago03"])
def test_ramps_stay_in_order(spark, name):
    ramp = np.repeat(2.0 ** (np.arange(256) / 16 - 8), 3).reshape(1, 256, 3)
    out = array(tonemap.OPERATORS[name](image(spark, ramp), RGB), "rgb")[0]
    assert (np.diff(out[:, 1]) >= 0).all()


def test_linear_ignores_scale(spark):
    v = noise(8, 8, 7)
    one, many = (array(tonemap.linear(image(spark, k * v), RGB), "rgb") for k in (1, 64))
    assert (one == many).all()


def test_black_pixels_are_white_in_drago(spark):
    v = noise(4, 4, 8)
    v[1, 1] = 0
    assert (array(tonemap.drago03(image(spark, v), RGB), "rgb")[1, 1] == 65535).all()


def test_pointwise(spark):
    v = noise(10, 4, 9)
    v[0, 0] = (0.0, 13.0, math.nan)
    px = image(spark, v)
    logs = array(pointwise.log10_filter(px))
    assert logs[0, 0, 0] == -4 and math.isnan(logs[0, 0, 2]) and np.allclose(logs[1:], np.log10(v[1:]))
    assert array(pointwise.pow10_filter(px))[0, 0, 1] == 1
    few = array(pointwise.quick_sampling(px, 0.6))
    rows = [int(np.float32(y) * np.float32(0.6)) for y in range(6)]
    assert np.array_equal(few, v[rows], equal_nan=True)
    assert pointwise.quick_sampling(px, 0.0).count() == 0
    with pytest.raises(ValueError):
        pointwise.quick_sampling(px, 1.5)
    twice = array(pointwise.apply2(px, image(spark, v[:5]), lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))))
    assert np.array_equal(twice, 2 * v[:5], equal_nan=True)


def test_percentiles(spark):
    r = np.random.default_rng(1)
    groups = {"a": r.normal(size=1000), "b": np.repeat([1.0, 2.0], [990, 10]), "c": np.array([5.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "image_id string, v double")
    got = {row.image_id: row for row in percentiles(df, "v", {"lo": 0.01, "hi": 0.99, "top": 1.0}).collect()}
    for g, xs in groups.items():
        xs = np.sort(xs)
        assert got[g].lo == xs[int(0.01 * len(xs))] and got[g].hi == xs[int(0.99 * len(xs))] and got[g].top == xs[-1]


@pytest.mark.parametrize("name", sorted(tonemap.OPERATORS))
def test_batches_with_black_flat_and_odd_images(spark, name):
    """Every pixel comes back, whatever else is in the batch; black images have one defined colour; others aren't touched by it."""
    def image(image_id, width, height, value):
        return [(image_id, x, y, *value(x, y)) for x in range(width) for y in range(height)]

    mixed = image("mixed", 9, 12, lambda x, y: (x + 0.5, (x * y) % 7 + 0.25, y * 0.3) if (x + y) % 5 else (0.0, 0.0, 0.0))
    rows = mixed + image("black", 8, 6, lambda x, y: (0.0, 0.0, 0.0)) + image("flat", 7, 8, lambda x, y: (2.0, 2.0, 2.0))
    nan = image("nan", 6, 7, lambda x, y: (float("nan"), 1.0 + x, 1.0 + y) if x == y == 2 else (1.0 + x, 1.0 + y, 2.0))
    schema = "image_id string, x int, y int, c1 double, c2 double, c3 double"
    alone = {(r.x, r.y): (r.r, r.g, r.b) for r in tonemap.OPERATORS[name](spark.createDataFrame(mixed, schema), "RGB").collect()}
    got = tonemap.OPERATORS[name](spark.createDataFrame(rows + nan * (name != "icam06"), schema), "RGB").collect()
    assert len(got) == len(rows) + len(nan) * (name != "icam06")
    assert all(0 <= v <= 65535 for r in got for v in (r.r, r.g, r.b))
    assert {(r.x, r.y): (r.r, r.g, r.b) for r in got if r.image_id == "mixed"} == alone
    assert len({(r.r, r.g, r.b) for r in got if r.image_id == "black"}) == 1


def test_gaussian_with_the_radius_in_a_column(spark):
    px = spark.createDataFrame([(i, x, y, float((x * 7 + y * 3) % 11), float(x), float(y)) for i, w, h in (("a", 13, 17), ("b", 5, 6)) for x in range(w) for y in range(h)], "image_id string, x int, y int, c1 double, c2 double, c3 double")
    sized = px.selectExpr("*", "CASE image_id WHEN 'a' THEN 4 ELSE 2 END AS radius")
    got = {(r.image_id, r.x, r.y): (r.c1, r.c2, r.c3) for r in blur.fast_gaussian_by(sized, "radius").collect()}
    for image, radius in (("a", 4), ("b", 2)):
        for r in blur.fast_gaussian(px.where(f"image_id = '{image}'"), radius).collect():
            assert np.allclose(got[image, r.x, r.y], (r.c1, r.c2, r.c3), atol=1e-9)
    assert len(got) == px.count()


def test_icam06_of_images_of_many_sizes(spark):
    schema = "image_id string, x int, y int, c1 double, c2 double, c3 double"
    rows = [(f"i{k}", x, y, 1.0 + x, 1.0 + y, 2.0 + (x * y) % 3) for k in range(2, 70) for x in range(k) for y in range(2)] + [(f"s{k}", x, y, 1.0 + x, 1.0 + y, 2.0) for k in (3, 5) for x in range(k) for y in range(k)]
    assert tonemap.icam06(spark.createDataFrame(rows, schema), "RGB").count() == len(rows)
    some = spark.createDataFrame([r for r in rows if r[0] in ("s3", "s5")], schema)
    plain, normal = (sorted(map(tuple, tonemap.icam06(some, "RGB", normalize_luminance=k).collect())) for k in (False, True))
    assert all(abs(a - b) <= 1 for p, q in zip(plain, normal, strict=True) for a, b in zip(p[3:], q[3:], strict=True))


@pytest.mark.parametrize("ranked", [50_000, 7])
def test_percentiles_of_heavy_tails(spark, monkeypatch, ranked):
    """Places in the sorted values, whether a bucket is ranked at once or divided again and again."""
    monkeypatch.setattr(order_statistics, "RANKED", ranked)
    rng = np.random.default_rng(5)
    groups = {
        "tail": np.concatenate([rng.normal(size=400) * 1e-3, [1e30, -1e30, 0.0, -0.0, 5e-324]]),
        "narrow": 1000 + rng.random(300) * 1e-9,
        "same": np.full(50, 3.5),
        "odd": np.array([np.inf, -np.inf, np.nan, 0.0, -2.0, 7.0]),
        "one": np.array([4.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("tail", None), ("none", None)]
    shares = {"least": 0.0, "low": 0.01, "middle": 0.5, "high": 0.99, "most": 1.0}
    found = order_statistics.percentiles(spark.createDataFrame(rows, "image_id string, v double"), "v", shares).collect()
    assert {r.image_id for r in found} == set(groups)
    for r in found:
        wanted = np.sort(groups[r.image_id])
        for name, share in shares.items():
            assert np.array_equal(r[name], wanted[min(int(share * len(wanted)), len(wanted) - 1)], equal_nan=True), (r.image_id, name)


def test_mixed_models_and_a_model_of_ones_own(spark, monkeypatch):
    """A batch of images in several models is mapped as each image by itself; a model that a user adds works everywhere."""
    own = color.ColorModel(rgb=lambda v: tuple(c / 2 for c in v), xyz=lambda v: color.rgb_to_xyz(tuple(c / 2 for c in v)), of_rgb=lambda v: tuple(c * 2 for c in v), of_xyz=lambda v: tuple(c * 2 for c in color.xyz_to_rgb(v)))
    monkeypatch.setitem(color.MODELS, "HALF", own)
    r = np.random.default_rng(4)
    images = {(f"i{k}", m): r.random((12, 9, 3)) * 3 + 0.01 for k, m in enumerate(("RGB", "XYZ", "RAW", "HALF"))}
    rows = [(n, m, x, y, *map(float, v[y, x])) for (n, m), v in images.items() for y in range(12) for x in range(9)]
    px = spark.createDataFrame(rows, "image_id string, color_model string, x int, y int, c1 double, c2 double, c3 double").cache()
    px.count()
    for name in ("linear", "reinhard05", "durand"):
        f = tonemap.OPERATORS[name]
        mixed = {tuple(q) for q in f(px, color.BY_COLUMN).collect()}
        alone = {tuple(q) for n, m in images for q in f(px.where(px.image_id == n).drop("color_model"), m).collect()}
        assert mixed == alone and len(mixed) == 4 * 108, name
    smooth = {(q.image_id, q.x, q.y): q.c1 for q in bilateral.y_fast_bilateral(px, color.BY_COLUMN).collect()}
    for n, m in images:
        for q in bilateral.y_fast_bilateral(px.where(px.image_id == n), m).collect():
            assert abs(smooth[n, q.x, q.y] - q.c1) < 1e-9
    back = color.convert(color.convert(px.where("image_id = 'i3'"), "HALF", "XYZ"), "XYZ", "HALF")
    assert all(abs(q.c2 - images["i3", "HALF"][q.y, q.x, 1]) < 1e-9 for q in back.collect())
    with pytest.raises(Exception, match="no colour model odd"):
        tonemap.linear(px.withColumn("color_model", F.lit("odd")), color.BY_COLUMN).collect()
    with pytest.raises(ValueError, match="no colour model odd"):
        tonemap.linear(px, "odd")


@pytest.mark.parametrize("share", [1.0, 0.97, 0.6, 1 / 3, 0.1, 0.03, 0.0])
def test_row_weights_are_the_sample(spark, share):
    """Weights by arithmetic are the rows that the sample takes, in images of all heights."""
    heights = [1, 2, 5, 100, 1003, 40_000]
    px = spark.createDataFrame([(f"h{h}", 0, y, 1.0, 1.0, 1.0, h) for h in heights for y in range(h)], "image_id string, x int, y int, c1 double, c2 double, c3 double, height int")
    got = {(q.image_id, q.y): q.w for q in px.select("image_id", "y", pointwise.row_weight(F.col("y"), F.col("height"), share).alias("w")).where("w > 0").collect()}
    want = {}
    for h in heights:
        for t in range(int(np.float32(h) * np.float32(share))):
            key = f"h{h}", int(np.float32(t) * np.float32(share))
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_reinhard_joins_no_pixels(spark):
    px = spark.range(3_000).selectExpr("'i' AS image_id", "CAST(id % 50 AS INT) AS x", "CAST(id DIV 50 AS INT) AS y", "id + 1D AS c1", "id + 2D AS c2", "id + 3D AS c3")
    for f in (tonemap.reinhard05, tonemap.custom_reinhard05):
        plan = f(px, "RGB")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") <= 1


@pytest.mark.parametrize("error", [0.1, 0.01])
def test_percentiles_within_their_error(spark, error):
    """Values of a heavy tail, ties and several groups: each place is within the stated error."""
    r = np.random.default_rng(2)
    groups = {"tail": np.exp(r.normal(size=5000) * 4), "ties": r.integers(0, 3, 3000).astype(float), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("tail", None)]
    shares = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.99, "e": 1.0}
    got = order_statistics.percentiles_within(spark.createDataFrame(rows, "image_id string, v double").repartition(4), "v", shares, error).collect()
    assert {q.image_id for q in got} == set(groups)
    for q in got:
        v = np.sort(groups[q.image_id])
        for name, share in shares.items():
            below, up_to = np.searchsorted(v, q[name], "left"), np.searchsorted(v, q[name], "right")
            assert up_to > below and below - error * len(v) - 1 <= share * len(v) <= up_to + error * len(v) + 1


def test_stored_tables_are_cleared(spark, tmp_path, monkeypatch):
    """All of an application's intermediate tables lie in one folder, which can be deleted; nothing else is."""
    from lumera import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    (tmp_path / "other").mkdir()
    assert session.materialised(spark.range(3), "a").count() == 3 and session.materialised(spark.range(2), "b").count() == 2
    assert len(list(tmp_path.iterdir())) == 2
    session.clear_stored(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]
