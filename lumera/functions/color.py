"""Colour spaces: linear maps between RGB, XYZ, cone responses and IPT, and a registry of models with their readouts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumera.functions.ieee import clamp
from lumera.schema import RAW, RGB, XYZ, channels

# Published conversion matrices, row by row.
RGB_TO_XYZ = (
    (0.41239079926595948, 0.35758433938387796, 0.18048078840183429),
    (0.21263900587151036, 0.71516867876775593, 0.072192315360733715),
    (0.019330818715591851, 0.11919477979462599, 0.95053215224966058),
)
XYZ_TO_RGB = (
    (3.2409699419045214, -1.5373831775700935, -0.49861076029300328),
    (-0.96924363628087983, 1.8759675015077207, 0.041555057407175613),
    (0.055630079696993609, -0.20397695888897657, 1.0569715142428786),
)
XYZ_TO_LMS = ((0.4002, 0.7075, -0.0807), (-0.228, 1.15, 0.0612), (0.0, 0.0, 0.9184))
LMS_TO_XYZ = ((1.8501, -1.1385, 0.2384), (0.3668, 0.6438, -0.0107), (0.0, 0.0, 1.0889))
XYZ_TO_CAT02 = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6974, 0.0061), (0.0030, 0.0136, 0.9834))
CAT02_TO_XYZ = ((1.0961, -0.2789, 0.1827), (0.4544, 0.4736, 0.0721), (-0.0096, -0.0057, 1.0153))
XYZ_TO_HPE = ((0.38971, 0.68898, -0.07868), (-0.22981, 1.18340, 0.04641), (0.0, 0.0, 1.0))
HPE_TO_XYZ = ((1.91020, -1.11212, 0.20191), (0.37095, 0.62905, -0.00001), (0.0, 0.0, 1.0))
LMS_TO_IPT = ((0.4, 0.4, 0.2), (4.455, -4.851, 0.396), (0.8056, 0.3572, -1.1628))
IPT_TO_LMS = ((1.0, 0.0976, 0.2052), (1.0, -0.1139, 0.1332), (1.0, 0.0326, -0.6769))
#: Tristimulus values of the D65 white.
D65 = (96.047, 100.0, 108.883)

Triple = tuple[Column, Column, Column]


def columns(*names: str) -> Triple:
    """Three columns by name, the channels by default."""
    return tuple(F.col(n) for n in (names or ("c1", "c2", "c3")))


def apply_matrix(m, v: Triple) -> Triple:  # noqa: ANN001
    """The linear map ``m`` of three columns."""
    return tuple(F.lit(r[0]) * v[0] + F.lit(r[1]) * v[1] + F.lit(r[2]) * v[2] for r in m)


@dataclass(frozen=True)
class ColorModel:
    """How channels of a model are read as RGB and XYZ, and how its channels come of RGB and of XYZ."""

    rgb: Callable[[Triple], Triple]
    xyz: Callable[[Triple], Triple]
    of_rgb: Callable[[Triple], Triple]
    of_xyz: Callable[[Triple], Triple]


def same(v: Triple) -> Triple:
    """Channels as they are."""
    return v


def rgb_to_xyz(v: Triple) -> Triple:
    return apply_matrix(RGB_TO_XYZ, v)


def xyz_to_rgb(v: Triple) -> Triple:
    return apply_matrix(XYZ_TO_RGB, v)


#: Colour models by name; add one with ``MODELS[name] = ColorModel(...)``. RAW isn't converted.
MODELS: dict[str, ColorModel] = {
    RGB: ColorModel(same, rgb_to_xyz, same, xyz_to_rgb),
    XYZ: ColorModel(xyz_to_rgb, same, rgb_to_xyz, same),
    RAW: ColorModel(same, same, same, same),
}
#: In place of a model's name: the model of each pixel is in the column ``color_model``.
BY_COLUMN = "color_model"


def carried(model: str) -> list[str]:
    """The column to keep while channels are in ``model``."""
    return [BY_COLUMN] if model == BY_COLUMN else []


def _by_model(model: str, way: str, v: Triple) -> Triple:
    """``way`` of a model; with BY_COLUMN a case of all models, and an error for a name that isn't one."""
    if model in MODELS:
        return getattr(MODELS[model], way)(v)
    if model != BY_COLUMN:
        raise ValueError(f"no colour model {model}")
    found = {name: getattr(m, way)(v) for name, m in MODELS.items()}

    def case(i: int) -> Column:
        out = reduce(lambda c, n: (F if c is None else c).when(F.col(BY_COLUMN) == n, found[n][i]), found, None)
        return out.otherwise(F.raise_error(F.concat(F.lit("no colour model "), F.coalesce(BY_COLUMN, F.lit("null")))).cast("double"))

    return case(0), case(1), case(2)


def as_rgb(model: str, v: Triple | None = None) -> Triple:
    """The RGB readout of channels; RAW isn't converted."""
    return _by_model(model, "rgb", v or columns())


def as_xyz(model: str, v: Triple | None = None) -> Triple:
    """The XYZ readout of channels; RAW isn't converted."""
    return _by_model(model, "xyz", v or columns())


def of_xyz(model: str, v: Triple) -> Triple:
    """Channels of ``model`` from XYZ."""
    return _by_model(model, "of_xyz", v)


def luminance(model: str, v: Triple | None = None) -> Column:
    """Y of a pixel."""
    return as_xyz(model, v)[1]


def convert(px: DataFrame, source: str, target: str) -> DataFrame:
    """Pixels in another model, by way of RGB: so RAW read as XYZ is taken for RGB. To RAW nothing is converted."""
    if source == target and source != BY_COLUMN:
        return px
    if target == RAW:
        return channels(px, *columns())
    if source != BY_COLUMN:
        return channels(px, *MODELS[target].of_rgb(as_rgb(source)))
    # Pixels that are in the target model stay as they are.
    stays = F.col(BY_COLUMN) == target
    return channels(px, *[F.when(stays, c).otherwise(v) for c, v in zip(columns(), MODELS[target].of_rgb(as_rgb(source)), strict=True)])


def from_ldr(ldr: DataFrame, target: str) -> DataFrame:
    """16-bit pixels as floating-point ones; values aren't divided."""
    px = ldr.select("image_id", "x", "y", *[F.col(c).cast("double").alias(n) for c, n in zip("rgb", ("c1", "c2", "c3"), strict=True)])
    return convert(px, RGB, target)


def lms_cat02(px: DataFrame, model: str) -> DataFrame:
    """The CAT02 cone response of every pixel (RAW)."""
    return channels(px, *apply_matrix(XYZ_TO_CAT02, as_xyz(model)))


def lms_hpe(px: DataFrame, model: str) -> DataFrame:
    """The Hunt-Pointer-Estevez cone response of every pixel (RAW)."""
    return channels(px, *apply_matrix(XYZ_TO_HPE, as_xyz(model)))


def view_16_bit(px: DataFrame, model: str) -> DataFrame:
    """Channels times 65535 as whole numbers held in 0..65535; not a number is 0."""
    v = as_rgb(model)
    cell = lambda c: F.coalesce(F.nanvl(clamp(0.0, 65535.0, c * 65535), F.lit(0.0)).cast("int"), F.lit(0))
    return px.select("image_id", "x", "y", *[cell(c).alias(n) for c, n in zip(v, "rgb", strict=True)], F.lit(65535).alias("a"))


def view_8_bit(px: DataFrame, model: str) -> DataFrame:
    """Channels times 255 as whole numbers held in 0..255; not a number is 0."""
    cell = lambda c: F.nanvl(clamp(0.0, 255.0, c * 255), F.lit(0.0)).cast("int")
    return px.select("image_id", "x", "y", *[cell(c).alias(n) for c, n in zip(as_rgb(model), "rgb", strict=True)], F.lit(255).alias("a"))
