import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumera.functions import color, formats, ieee, quantize
from lumera.schema import PIXELS, RAW, RGB, XYZ, attach, blank, clip_to_bounds, f32, offset_in_raster

ODD = [0.0, -0.0, 1.0, -1.0, 2.5, math.inf, -math.inf, math.nan]


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-12 * max(abs(a), abs(b))


def test_ieee_division_and_logarithms(spark):
    rows = spark.createDataFrame([(a, b) for a in ODD for b in ODD if not (b == 0 and math.copysign(1, b) < 0)], "a double, b double")
    got = rows.select("a", "b", ieee.fdiv(F.col("a"), F.col("b")).alias("q"), ieee.ln(F.col("a")).alias("l"), ieee.log10(F.col("a")).alias("t"), ieee.log2(F.col("a")).alias("d")).collect()
    with np.errstate(all="ignore"):
        for r in got:
            assert same(r.q, float(np.float64(r.a) / np.float64(r.b))), r
            assert same(r.l, float(np.log(r.a))) and same(r.t, float(np.log10(r.a))) and same(r.d, float(np.log2(r.a))), r


def test_small_helpers(spark):
    one = spark.range(1)
    got = one.select(
        ieee.clamp(0.0, 1.0, F.lit(math.nan)).alias("n"), ieee.clamp(0.0, 1.0, F.lit(3.0)).alias("c"), ieee.finite_or_zero(F.lit(math.inf)).alias("z"),
        ieee.product_of_nonzero(F.array(*map(F.lit, (3, 0, 4)))).alias("p"), offset_in_raster(F.lit(3), F.lit(2), F.lit(10)).alias("o"), f32(F.lit(0.1)).alias("f"),
    ).first()
    assert math.isnan(got.n) and got.c == 1 and got.z == 0 and got.p == 12 and got.o == 23 and got.f == float(np.float32(0.1))


@pytest.mark.parametrize(("a", "b", "near"), [
    (color.RGB_TO_XYZ, color.XYZ_TO_RGB, 1e-12), (color.XYZ_TO_LMS, color.LMS_TO_XYZ, 1e-3), (color.XYZ_TO_CAT02, color.CAT02_TO_XYZ, 1e-3),
    (color.XYZ_TO_HPE, color.HPE_TO_XYZ, 1e-3), (color.LMS_TO_IPT, color.IPT_TO_LMS, 1e-3),
])
def test_matrices_are_inverse(a, b, near):
    assert np.abs(np.array(a) @ np.array(b) - np.eye(3)).max() < near


def test_models(spark):
    px = spark.createDataFrame([("i", 0, 0, 0.2, 0.5, 0.8)], PIXELS)
    there = color.convert(color.convert(px, RGB, XYZ), XYZ, RGB).first()
    assert abs(there.c1 - 0.2) < 1e-12 and abs(there.c3 - 0.8) < 1e-12
    assert color.convert(px, RAW, XYZ).first() == color.convert(px, RGB, XYZ).first()
    assert color.convert(px, RAW, RGB).first().c2 == 0.5
    ldr = color.view_16_bit(px, RGB).first()
    assert (ldr.r, ldr.g, ldr.b, ldr.a) == (13107, 32767, 52428, 65535)
    assert color.from_ldr(color.view_8_bit(px, RGB), RGB).first().c1 == 51.0


def test_shared_exponent_round_trip(spark):
    values = [(float(2.0**k), float(3.0 * 2.0 ** (k - 3)), 0.0) for k in range(-90, 90, 7)] + [(1e-33, 0.0, 0.0), (255.999, 1.0, 0.5)]
    px = spark.createDataFrame(values, "c1 double, c2 double, c3 double")
    cells = px.select("*", *[c.alias(n) for c, n in zip(formats.to_radiance(*color.columns()), ("b0", "b1", "b2", "e"), strict=True)])
    back = cells.select("*", *[c.alias(n) for c, n in zip(formats.from_radiance(*map(F.col, ("b0", "b1", "b2", "e"))), "rgb", strict=True)]).collect()
    for r in back:
        top = max(r.c1, r.c2, r.c3) if max(r.c1, r.c2, r.c3) > 1e-32 else 0.0
        assert all(0 <= b <= 255 for b in (r.b0, r.b1, r.b2))
        if top:
            assert all(abs(x - y) <= top / 128 for x, y in ((r.c1, r.r), (r.c2, r.g), (r.c3, r.b)))
        else:
            assert (r.b0, r.b1, r.b2, r.e) == (0, 0, 0, 0)


def test_logluv_round_trip(spark):
    values = [(0.95 * y, y, 1.09 * y) for y in (1e-6, 0.01, 1.0, 18.0, 3e4)] + [(0.0, 0.0, 0.0)]
    px = spark.createDataFrame(values, "c1 double, c2 double, c3 double")
    cells = px.select("*", *[c.alias(n) for c, n in zip(formats.to_logluv(*color.columns()), ("h", "l", "u", "v"), strict=True)])
    back = cells.select("c2", *[c.alias(n) for c, n in zip(formats.from_logluv(*map(F.col, ("h", "l", "u", "v"))), "xyz", strict=True)]).collect()
    assert all(abs(r.y / r.c2 - 1) < 0.005 for r in back if r.c2)


@pytest.mark.parametrize("big", [False, True])
def test_float_bytes(spark, big):
    px = spark.createDataFrame([(1.5, -2.25, 1e10)], "c1 double, c2 double, c3 double")
    raw = px.select(formats.to_bytes(*color.columns(), big).alias("b"))
    assert bytes(raw.first().b) == np.array([1.5, -2.25, 1e10], ">f4" if big else "<f4").tobytes()
    assert raw.select(formats.from_bytes(F.col("b"), big).alias("v")).first().v == [1.5, -2.25, 1e10]


def test_pixel_mapping_edges(spark):
    values = [-1.0, -0.0, 0.0, 1 / 65535, 0.5, 65533.5 / 65535, 65534 / 65535, 1.0, 7.0, math.inf, -math.inf, math.nan]
    got = [r.p for r in spark.createDataFrame([(v,) for v in values], "v double").select(quantize.inverse_pixel_mapping(F.col("v")).alias("p")).collect()]
    assert got == [0, 1, 1, 2, 32768, 65534, 65535, 65535, 65535, 65535, 0, 65535]
    curve = [r.p for r in spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.001, 0.5, 1.0)], "v double").select(quantize.srgb(F.col("v")).alias("p")).collect()]
    assert curve == [0, 0, 846, 48191, 65535]


def test_images_relation(spark):
    images = spark.createDataFrame([("a", 3, 2), ("b", 1, 1)], "image_id string, width int, height int")
    px = blank(images)
    assert px.count() == 7 and clip_to_bounds(px, 2, 1).count() == 3
    stats = px.groupBy("image_id").agg(F.count("*").alias("n"))
    assert attach(px, stats).where("n = 6").count() == 6 == attach(px, stats, most=1).where("n = 6").count()
