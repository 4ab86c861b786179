"""Tone mapping: floating-point pixels to 16-bit ones, image by image.

Each operator takes pixels and their colour model (or BY_COLUMN, if a column names each
image's) and returns 16-bit pixels. The
statistics of an image are aggregates per image that every pixel then refers to.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumera.functions.color import (
    CAT02_TO_XYZ, D65, HPE_TO_XYZ, IPT_TO_LMS, LMS_TO_IPT, LMS_TO_XYZ, XYZ_TO_CAT02, XYZ_TO_HPE, XYZ_TO_LMS, apply_matrix, as_rgb, as_xyz, carried, columns,
)
from lumera.functions.ieee import clamp, fdiv, finite_or_zero, ln, log10
from lumera.functions.quantize import inverse_pixel_mapping, normalize_gamma, shift_log_rescale, shift_rescale, srgb, to_ldr
from lumera.operators.bilateral import y_fast_bilateral
from lumera.operators.blur import fast_gaussian_by
from lumera.operators.order_statistics import percentiles, percentiles_within
from lumera.operators.pointwise import log10_of, pow10_of, row_weight
from lumera.schema import CHANNELS, XYZ, attach, channels
from lumera.session import materialised

SAMPLING = 0.6


def channel_range(px: DataFrame, model: str) -> DataFrame:
    """Least and greatest value of all channels of each image (low, high); not a number spoils both."""
    rgb = as_rgb(model)
    odd = F.max(F.isnan(rgb[0]) | F.isnan(rgb[1]) | F.isnan(rgb[2]))
    nan = F.lit(float("nan"))
    return px.groupBy("image_id").agg(F.when(odd, nan).otherwise(F.min(F.least(*rgb))).alias("low"), F.when(odd, nan).otherwise(F.max(F.greatest(*rgb))).alias("high"))


def linear(px: DataFrame, model: str) -> DataFrame:
    """All channels scaled by the range of the image."""
    low, high = F.col("low"), F.col("high")
    return to_ldr(attach(px, channel_range(px, model)), *[shift_rescale(c, low, high) for c in as_rgb(model)])


def logarithmic(px: DataFrame, model: str) -> DataFrame:
    """The logarithm of the distance from the least value, scaled."""
    stats = channel_range(px, model).select("image_id", "low", ln(F.col("high") - F.col("low")).alias("top"))
    return to_ldr(attach(px, stats), *[shift_log_rescale(c, F.col("low"), F.col("top")) for c in as_rgb(model)])


def drago03(px: DataFrame, model: str, bias: float = 0.5) -> DataFrame:
    """Adaptive logarithmic mapping: the base of the logarithm follows the luminance by ``bias``."""
    bias = min(1.0, max(0.0, bias))
    power = (math.log10(bias) if bias > 0 else -math.inf) / math.log(0.5)
    lum = as_xyz(model)[1]
    stats = px.groupBy("image_id").agg(F.exp(F.avg(ln(lum + 1e-4))).alias("mean"), F.max(lum).alias("top"))
    stats = stats.select("image_id", "mean", (F.col("top") / F.col("mean")).alias("peak"))
    px = attach(channels(px, *as_xyz(model)), stats)
    # A black image has a peak of 0: its level isn't a number, and that is white as at every black pixel.
    px = px.withColumn("q", F.col("c2") / F.col("mean")).withColumn("share", fdiv(F.col("q"), F.col("peak")))
    px = px.withColumn("upper", ln(F.col("q") + 1)).withColumn("lower", ln(2 + 8 * F.pow("share", F.lit(power))) * log10(F.col("peak") + 1))
    px = px.withColumn("level", fdiv(F.col("upper"), F.col("lower"))).withColumn("scale", fdiv(F.col("level"), F.col("c2")))
    px = channels(px, *apply_matrix_to_scaled(F.col("scale")))
    return to_ldr(px, *[inverse_pixel_mapping(c) for c in columns()])


def apply_matrix_to_scaled(scale: Column) -> tuple[Column, Column, Column]:
    """RGB of XYZ channels that are all multiplied by ``scale``."""
    return as_rgb(XYZ, tuple(c * scale for c in columns()))


def _weight(sampling: str) -> Column:
    """How often a row counts in the statistics of its image, whose ``height`` is known."""
    return F.lit(1) if sampling == "full" else row_weight(F.col("y"), F.col("height"), SAMPLING)


def _sample_range(px: DataFrame, values: list[Column], lum: Column, sampling: str) -> DataFrame:
    """Least and greatest value of each image where it isn't black (from, to), from 1 and 0 on; a black image keeps these.

    Pixels know the ``height`` of their image; an image too low to be sampled has the
    range of a black one.
    """
    lit = lambda v: F.when((lum != 0) & (_weight(sampling) > 0), v)
    low, high = F.min(lit(F.least(*values))), F.max(lit(F.greatest(*values)))
    return px.groupBy("image_id").agg(F.least(F.lit(1.0), low).alias("from"), F.greatest(F.lit(0.0), high).alias("to"))


def reinhard05(px: DataFrame, model: str, brightness: float = -5.0, chromatic: float = 0.89, light: float = 0.89, sampling: str = "quick") -> DataFrame:
    """Photoreceptor adaptation between the pixel and the image mean, by channel and by luminance.

    The sample repeats some rows and leaves others out; both are weights of rows. Pixels
    are summed up by row, which needs no height, and rows by image; nothing is joined
    but one row of statistics for each image.
    """
    brightness, chromatic, light = min(20.0, max(-20.0, brightness)), min(1.0, max(0.0, chromatic)), min(1.0, max(0.0, light))
    lum, rgb = as_xyz(model)[1], as_rgb(model)
    sums = {"world": ln(lum + 2.3e-5), "av0": rgb[0], "av1": rgb[1], "av2": rgb[2], "av": lum}
    rows = px.groupBy("image_id", "y").agg(F.min(lum).alias("low"), F.max(lum).alias("high"), F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])
    rows = rows.withColumn("height", F.max("y").over(Window.partitionBy("image_id")) + 1).withColumn("w", _weight(sampling))
    seen = lambda c: F.when(F.col("w") > 0, F.col(c))
    total = F.sum(F.col("w") * F.col("n"))
    stats = rows.groupBy("image_id", "height").agg(F.min(seen("low")).alias("low"), F.max(seen("high")).alias("high"), *[fdiv(F.sum(F.coalesce(seen(k) * F.col("w"), F.lit(0.0))), total).alias(k) for k in sums])
    key = fdiv(ln(F.col("high")) - F.col("world"), ln(F.col("high")) - ln(F.col("low")))
    stats = stats.select("image_id", "height", "av", "av0", "av1", "av2", (0.3 + 0.7 * F.pow(key, F.lit(1.4))).alias("m"))
    stats = materialised(stats, "statistics")
    f = math.exp(-brightness)

    def adapted(n: int) -> Column:
        own = chromatic * rgb[n] + (1 - chromatic) * lum
        mean = chromatic * F.col(f"av{n}") + (1 - chromatic) * F.col("av")
        return F.when(rgb[n] == 0, 0.0).otherwise(fdiv(rgb[n], rgb[n] + F.pow(f * (light * own + (1 - light) * mean), F.col("m"))))

    values = [adapted(n) for n in range(3)]
    spread = _sample_range(attach(px, stats), values, lum, sampling)
    return normalize_gamma(attach(px, stats.join(spread, "image_id")), values, F.col("from"), F.col("to"))


def custom_reinhard05(px: DataFrame, model: str, brightness: float = 0.0, chromatic: float = 0.0, light: float = 0.1, sampling: str = "quick") -> DataFrame:
    """A lighter variant: local adaptation chooses the range to which the raw channels are scaled."""
    brightness, chromatic, light = 10 * min(50.0, max(-50.0, brightness)), min(1.0, max(0.0, chromatic)), 10 * min(1.0, max(0.0, light))
    lum, rgb = as_xyz(model)[1], as_rgb(model)
    f = math.exp(-brightness)

    def adapted(c: Column) -> Column:
        power = light * (chromatic * c + (1 - chromatic) * lum)
        return F.when(c == 0, 0.0).otherwise(fdiv(c, c + F.pow(f * power, power)))

    values = [adapted(c) for c in rgb]
    # By row first, as the height decides which rows count.
    lit = lambda v: F.when(lum != 0, v)
    rows = px.groupBy("image_id", "y").agg(F.min(lit(F.least(*values))).alias("low"), F.max(lit(F.greatest(*values))).alias("high"))
    rows = rows.withColumn("height", F.max("y").over(Window.partitionBy("image_id")) + 1).withColumn("w", _weight(sampling))
    seen = lambda c: F.when(F.col("w") > 0, F.col(c))
    spread = rows.groupBy("image_id").agg(F.least(F.lit(1.0), F.min(seen("low"))).alias("from"), F.greatest(F.lit(0.0), F.max(seen("high"))).alias("to"))
    return normalize_gamma(attach(px, spread), list(rgb), F.col("from"), F.col("to"))


def durand(px: DataFrame, model: str, contrast: float = 5.0) -> DataFrame:
    """Contrast of the bilateral base of the log image is reduced, detail is kept."""
    rgb, at, known = ["r", "g", "b"], ["image_id", "x", "y"], carried(model)
    named = [as_xyz(model)[1].alias("lum"), *[c.alias(n) for c, n in zip(as_rgb(model), rgb, strict=True)]]
    logged = px.select(*at, *known, *named, *[log10_of(F.col(c)).alias(c) for c in CHANNELS])
    base = y_fast_bilateral(logged, model, keep=(*known, "lum", *rgb)).select(*at, "lum", *rgb, as_xyz(model)[1].alias("base"))
    base = materialised(base, "base")
    stats = base.groupBy("image_id").agg(F.min("base").alias("low"), F.max("base").alias("high"))
    factor = fdiv(F.lit(math.log10(contrast)), F.col("high") - F.col("low"))
    stats = stats.select("image_id", factor.alias("cf"), (factor * (F.col("high") - F.col("low"))).alias("absolute"))
    power = F.pow(F.pow(F.lit(10.0), F.col("cf")), F.lit(0.82))
    # One projection for each step: a step's code holds no other step's twice.
    both = attach(base, stats).select(*at, "base", "cf", "absolute", (2.48 * power / (1 + 1.48 * power)).alias("s"), "lum", *rgb)
    both = both.withColumn("detail", fdiv(F.col("lum"), F.pow(F.lit(10.0), F.col("base"))))
    both = both.withColumn("detail", log10(finite_or_zero(F.col("detail"))))
    both = both.withColumn("level", F.pow(F.lit(10.0), F.col("base") * F.col("cf") + F.col("detail") - F.col("absolute")))
    both = both.select(*at, "s", "level", *[fdiv(F.col(n), F.col("lum")).alias(n) for n in rgb])
    both = both.select(*at, *[(F.pow(n, "s") * F.col("level")).alias(n) for n in rgb])
    both = both.select(*at, *[F.pow(finite_or_zero(F.col(n)), F.lit(1 / 2.2)).alias(n) for n in rgb])
    return to_ldr(both, *[inverse_pixel_mapping(F.col(n)) for n in rgb])


def _adaptation(y: Column) -> Column:
    """The luminance-level adaptation factor of a luminance."""
    la5 = 5 * 0.2 * y
    k4 = F.pow(1 / (la5 + 1), F.lit(4.0))
    return 0.2 * k4 * la5 + 0.1 * F.pow(1 - k4, F.lit(2.0)) * F.pow(la5, F.lit(1 / 3))


def icam06(px: DataFrame, model: str, contrast: float = 0.7, min_clipping: float = 0.01, max_clipping: float = 0.99, normalize_luminance: bool = False, clip_error: float = 0.0) -> DataFrame:
    """Image appearance model: adaptation to the local white, cone and rod compression, detail and colour adjustment.

    Images of all sizes go through one plan: the deviations of both filters are columns,
    and the layers of a pixel stay in one row. A black image stays black.
    ``normalize_luminance`` divides by the greatest luminance before clipping.
    ``clip_error`` above 0: the clipping percentiles come of one pass, with that error of rank.
    """
    contrast, peak, at = min(0.85, max(0.6, contrast)), 20000.0, ["image_id", "x", "y"]
    px = materialised(channels(px, *as_xyz(model)), "pixels")
    stats = px.groupBy("image_id").agg(F.max("c2").alias("top"), (F.least(F.max("x"), F.max("y")) + 1).alias("side"))
    px = attach(px, stats)
    is_black = F.col("top") == 0
    black = to_ldr(px.where(is_black), *[F.lit(0)] * 3)
    names = {p: tuple(f"{p}{i}" for i in (1, 2, 3)) for p in "abw"}
    scaled = [F.greatest(F.lit(1e-8), peak * fdiv(c, F.col("top"))) for c in columns()]
    normal = px.where(~is_black).select(*at, F.floor(F.col("side") / 2).cast("int").alias("radius"), *[c.alias(n) for c, n in zip(scaled, names["a"], strict=True)])
    logged = normal.select("*", *[log10_of(F.col(n)).alias(c) for n, c in zip(names["a"], CHANNELS, strict=True)])
    side = F.least("max_x", "max_y") + 1
    base = y_fast_bilateral(logged, XYZ, sigma_space=side * 0.02, keep=("radius", *names["a"]))
    both = base.select(*at, "radius", *names["a"], *[pow10_of(F.col(c)).alias(n) for c, n in zip(CHANNELS, names["b"], strict=True)], *[F.col(n).alias(w) for n, w in zip(names["a"], names["w"], strict=True)])
    both = materialised(fast_gaussian_by(both, "radius", names["w"], keep=names["a"] + names["b"]), "layers")
    both = attach(both, both.groupBy("image_id").agg(F.max("w2").alias("sw")))
    # Every step is a projection of its own, so that no step's code holds another's more than once.
    keep = [*at, *names["a"], *names["b"], "sw", "w2"]

    def step(df: DataFrame, kept: list[str], prefix: str, values) -> DataFrame:  # noqa: ANN001
        return df.select(*kept, *[v.alias(f"{prefix}{i}") for i, v in enumerate(values, 1)])

    three = lambda p: columns(*[f"{p}{i}" for i in (1, 2, 3)])
    yw = F.col("w2")
    # Adaptation to the local white, incomplete by degree d.
    white_d65 = [sum(a * x for a, x in zip(row, D65, strict=True)) for row in XYZ_TO_CAT02]
    both = both.withColumn("d", 0.3 * (1 - F.exp(-(0.2 * yw / peak - 42) / 92) / 3.6))
    both = step(both, [*keep, "d", "w1", "w3"], "p", apply_matrix(XYZ_TO_CAT02, three("b")))
    both = step(both, [*keep, "d", "p1", "p2", "p3"], "u", apply_matrix(XYZ_TO_CAT02, three("w")))
    d = F.col("d")
    both = step(both, keep, "k", [c * (F.lit(ref) * d / own + 1 - d) for c, own, ref in zip(three("p"), three("u"), white_d65, strict=True)])
    both = step(both, keep, "t", apply_matrix(CAT02_TO_XYZ, three("k")))
    squeeze = lambda p: 400 * p / (27.13 + p)
    both = both.withColumn("fl", _adaptation(yw)).withColumn("fl_base", _adaptation(F.col("b2")))
    keep += ["fl_base"]
    both = step(both, [*keep, "fl", "t2"], "k", apply_matrix(XYZ_TO_HPE, three("t")))
    both = step(both, [*keep, "t2"], "h", [F.pow(F.col("fl") * c / yw, F.lit(contrast)) for c in three("k")])
    both = step(both, [*keep, "t2"], "k", [squeeze(c) + 0.1 for c in three("h")])
    # Rods.
    both = both.withColumn("st", F.abs("t2") / F.col("sw")).withColumn("j2", F.pow(1e-5 / (yw + 1e-5), F.lit(2.0)))
    st, j2 = F.col("st"), F.col("j2")
    fls = 3800 * j2 * yw + 0.2 * F.pow(1 - j2, F.lit(4.0)) * F.pow(yw, F.lit(1 / 6))
    both = both.withColumn("bleach", 0.5 / (1 + 0.3 * F.pow(yw * st, F.lit(0.3))) + 0.5 / (1 + 5 * yw)).withColumn("rods", F.pow(fls * st, F.lit(contrast)))
    both = both.withColumn("rod", 3.05 * F.col("bleach") * squeeze(F.col("rods")) + 0.3)
    both = step(both, keep, "k", [c + F.col("rod") for c in three("k")])
    both = step(both, keep, "t", apply_matrix(HPE_TO_XYZ, three("k")))
    both = step(both, [*keep, "t1", "t2", "t3"], "q", [fdiv(x, y) for x, y in zip(three("a"), three("b"), strict=True)])
    both = both.withColumn("power", F.pow(F.col("fl_base") + 0.8, F.lit(0.25)))
    detail = [F.pow(finite_or_zero(c), F.col("power")) for c in three("q")]
    step_ = both.select(*at, F.col("fl_base").alias("fl"), *[(x * y).alias(c) for x, y, c in zip(three("t"), detail, CHANNELS, strict=True)])
    # Colour in IPT: chroma is stretched with the luminance of the base.
    gamma = lambda v, p: tuple(F.pow(F.abs(c), F.lit(p)) for c in v)
    lms = step(step_, [*at, "fl"], "k", gamma(apply_matrix(XYZ_TO_LMS, columns()), 0.43))
    ipt = lms.select(*at, "fl", *[c.alias(k) for c, k in zip(apply_matrix(LMS_TO_IPT, three("k")), "ipt", strict=True)])
    ipt = ipt.withColumn("chroma2", F.col("p") * F.col("p") + F.col("t") * F.col("t")).withColumn("chroma", F.sqrt("chroma2"))
    chroma2, chroma = F.col("chroma2"), F.col("chroma")
    scale = F.pow(F.col("fl") + 1, F.lit(0.15)) * (1.29 * chroma2 - 0.27 * chroma + 0.42) / (chroma2 - 0.31 * chroma + 0.42)
    ipt = ipt.withColumn("scale", scale)
    lms = step(ipt, at, "k", apply_matrix(IPT_TO_LMS, (F.col("i"), F.col("p") * F.col("scale"), F.col("t") * F.col("scale"))))
    xyz = channels(step(lms, at, "g", gamma(three("k"), 1 / 0.43)), *apply_matrix(LMS_TO_XYZ, three("g")))
    if normalize_luminance:
        xyz = materialised(xyz, "colours")
        xyz = attach(xyz, xyz.groupBy("image_id").agg(F.max("c2").alias("most")))
        xyz = channels(xyz, *[fdiv(c, F.col("most")) for c in columns()])
    rgb = materialised(channels(xyz, *as_rgb(XYZ)), "toned")
    each = rgb.select("image_id", F.explode(F.array("c1", "c2", "c3")).alias("v"))
    shares = {"lo": min_clipping, "hi": max_clipping}
    clip = percentiles_within(each, "v", shares, clip_error) if clip_error else percentiles(each, "v", shares)
    clip = clip.withColumn("lo", F.least("lo", F.lit(0.0)))
    toned = to_ldr(attach(rgb, clip), *[srgb(clamp(0.0, 1.0, fdiv(c - F.col("lo"), F.col("hi") - F.col("lo")))) for c in columns()])
    return toned.unionByName(black)


#: Tone mapping operators by name; add one with ``OPERATORS[name] = f``.
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "linear": linear, "logarithmic": logarithmic, "drago03": drago03, "durand": durand,
    "reinhard05": reinhard05, "custom_reinhard05": custom_reinhard05, "icam06": icam06,
}
