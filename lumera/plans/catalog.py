"""The registered queries of the image operators and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumera.functions import color, formats
from lumera.functions.quantize import inverse_pixel_mapping
from lumera.operators import bilateral, blur, pointwise, tonemap
from lumera.operators.order_statistics import percentiles, percentiles_within
from lumera.plans import oracle
from lumera.plans.fixtures import black_batch, embedding_batch, embedding_image, event_image, mixed_batch, order_xyz
from lumera.schema import CHANNELS, RGB, XYZ, blank, clip_to_bounds, describe_images, offset_in_raster
from lumera.session import scratch_path
from lumera.sources import formats as formats_of_files
from lumera.sources import images
from lumera.sources import sql as sql_functions
from lumera.sources.tiles import from_tiles, to_tiles

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, places: int = 6, keep: tuple[str, ...] = ("x", "y"), values: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Values to ``places`` places, -0 as 0."""
    return df.select(*keep, *[(F.round(v, places) + 0.0).alias(v) for v in values])


def _ten_digits(df: DataFrame) -> DataFrame:
    """Values to four places, from a million on to four places of the million."""
    cut = lambda v: F.when(v < 1e6, F.round(v, 4)).otherwise(F.round(v / 1e6, 4) * 1e6)
    return df.select("x", "y", *[cut(F.col(v)).alias(v) for v in CHANNELS])


def _of(fixture: Query, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(fixture(spark, sf_dir))


def _maps(*matrices) -> Callable[[DataFrame], DataFrame]:  # noqa: ANN002
    def run(px: DataFrame) -> DataFrame:
        v = color.columns()
        for m in matrices:
            v = color.apply_matrix(m, v)
        return _rounded(px.select("x", "y", *[c.alias(n) for c, n in zip(v, CHANNELS, strict=True)]))

    return run


def apply2_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event image over the order image where both have a pixel."""
    ratio = lambda a, b: tuple(p / (q + 1) for p, q in zip(a, b, strict=True))
    return _rounded(pointwise.apply2(event_image(spark, sf_dir), order_xyz(spark, sf_dir), ratio, ("x", "y")))


def percentile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1 % and 99 % values of all channels."""
    each = event_image(spark, sf_dir).select("image_id", F.explode(F.array(*CHANNELS)).alias("v"))
    return _rounded(percentiles(each, "v", {"lo": 0.01, "hi": 0.99}), keep=("image_id",), values=("lo", "hi"))


def _grid(px: DataFrame, smoothed: bool) -> DataFrame:
    grid = bilateral.splat_luminance(px, RGB)
    grid = bilateral.smooth(grid, 3, 1) if smoothed else grid
    return _rounded(grid, keep=("g0", "g1", "g2"), values=("s1", "w"))


def _rgbe(px: DataFrame) -> DataFrame:
    cells = formats.to_radiance(*color.columns())
    return px.select("x", "y", *[c.alias(n) for c, n in zip(cells, ("b0", "b1", "b2", "e"), strict=True)])


def _logluv(px: DataFrame) -> DataFrame:
    cells = formats.to_logluv(*color.columns())
    return px.select("x", "y", *[c.alias(n) for c, n in zip(cells, ("high", "low", "u", "v"), strict=True)])


def _unpacked(cells: DataFrame, f: Callable[..., tuple[Column, ...]], names: tuple[str, ...]) -> DataFrame:
    return _rounded(cells.select("x", "y", *[c.alias(n) for c, n in zip(f(*map(F.col, names)), CHANNELS, strict=True)]))


def _mapped(px: DataFrame) -> DataFrame:
    return px.select("x", "y", *[inverse_pixel_mapping(F.col(c) / 24 - 0.1).alias(n) for c, n in zip(CHANNELS, "rgb", strict=True)])


def _codec(codec: str, model: str = RGB, **options: str) -> Callable[[DataFrame], DataFrame]:
    """Pixels after files of the codec have been written, band by band, and read by ranges of rows."""

    def run(px: DataFrame) -> DataFrame:
        spark = px.sparkSession
        folder = scratch_path(spark, codec)
        formats_of_files.save(px, folder, codec, model, **options)
        return _rounded(spark.read.format(codec).option("split", str(1 << 20)).load(folder), 5)

    return run


def _headers(px: DataFrame) -> DataFrame:
    """What the headers of files of every codec say."""
    files = [images.encode_images(px, name) for name in sorted(images.CODECS)]
    heads = [images.decode_headers(f).select("image_id", "format", "width", "height", "color_model") for f in files]
    return heads[0].unionByName(heads[1]).unionByName(heads[2])


def _float_bytes(px: DataFrame) -> DataFrame:
    raw = px.select("x", "y", formats.to_bytes(*color.columns()).alias("raw"))
    read = raw.withColumn("v", formats.from_bytes(F.col("raw")))
    return _rounded(read.select("x", "y", *[F.col("v")[i].alias(c) for i, c in enumerate(CHANNELS)]), 5)


def _view(f: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An integer view of the image scaled to about 0..1."""
    return lambda px: f(pointwise.apply1(px, lambda *v: tuple(F.round(c / 24, 9) for c in v)), RGB).drop("image_id")


def _converted(px: DataFrame) -> DataFrame:
    """A mixed batch in RGB and in XYZ."""
    each = [_rounded(color.convert(px, color.BY_COLUMN, t).withColumn("target", F.lit(t)), 7, ("image_id", "target", "x", "y")) for t in (RGB, XYZ)]
    return each[0].unionByName(each[1])


def _weights(px: DataFrame) -> DataFrame:
    """How often each row is in the sample of the row-sampling operators."""
    rows = px.groupBy("image_id", "y").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("height", F.max("y").over(Window.partitionBy("image_id")) + 1)
    return rows.select("y", pointwise.row_weight(F.col("y"), F.col("height"), 0.6).alias("weight"))


def percentile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by a sketch of error 0.005, of values of a heavy tail, and whether each has its place within that error."""
    error, shares = 0.005, {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    tail = event_image(spark, sf_dir).select("image_id", F.pow(F.abs(F.col("c1")) + 0.5, F.lit(9.0)).alias("v"))
    found = percentiles_within(tail, "v", shares, error)
    named = found.select("image_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("share"), F.col(n).alias("found")) for n, s in shares.items()])).alias("p"))
    both = tail.join(F.broadcast(named.select("image_id", "p.*")), "image_id").groupBy("image_id", "name", "share")
    ranks = both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("v") < F.col("found")).cast("long")).alias("below"), F.sum((F.col("v") <= F.col("found")).cast("long")).alias("up_to"))
    off = F.greatest(F.lit(0.0), F.col("below") - F.col("share") * F.col("n"), F.col("share") * F.col("n") - F.col("up_to"))
    return ranks.select("image_id", "name", "n", (off <= error * F.col("n") + 1).alias("within"))


def _bounded(px: DataFrame) -> DataFrame:
    """The pixels within 20 by 30, and their places in a raster of that size."""
    inside = _rounded(clip_to_bounds(px, 20, 30))
    return inside.withColumn("place", offset_in_raster(F.col("x"), F.col("y"), F.lit(20)))


def _tiled(storage: str) -> Callable[[DataFrame], DataFrame]:
    """Pixels after they have been dense tiles."""
    return lambda px: _rounded(from_tiles(to_tiles(px, storage)), 5)


def sql_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the images of the batch, decoded inside SQL: what their headers say and sums of their pixels."""
    sql_functions.register(spark)
    view = f"files_{uuid.uuid4().hex}"
    images.encode_images(embedding_batch(spark, sf_dir), "pfm").createOrReplaceTempView(view)
    return spark.sql(f"""
      SELECT p.image_id, h.width, h.height, p.color_model, p.n, p.high
      FROM (SELECT image_id, color_model, count(*) AS n, round(max(c2), 5) AS high
            FROM decode_images(TABLE(SELECT image_id, content FROM {view})) GROUP BY image_id, color_model) p
      JOIN (SELECT image_id, image_header(content) AS h FROM {view}) USING (image_id)""")


QUERIES: dict[str, Query] = {
    "linear_tmo": _of(event_image, lambda px: tonemap.linear(px, RGB)),
    "linear_batch": _of(embedding_batch, lambda px: tonemap.linear(px, RGB)),
    "log_tmo": _of(event_image, lambda px: tonemap.logarithmic(px, RGB)),
    "drago_tmo": _of(order_xyz, lambda px: tonemap.drago03(px, XYZ)),
    "reinhard_tmo": _of(event_image, lambda px: tonemap.reinhard05(px, RGB)),
    "custom_reinhard_tmo": _of(event_image, lambda px: tonemap.custom_reinhard05(px, RGB)),
    "durand_tmo": _of(embedding_image, lambda px: tonemap.durand(px, RGB)),
    "icam_tmo": _of(embedding_image, lambda px: tonemap.icam06(px, RGB)),
    "tmo_black_batch_linear": _of(black_batch, lambda px: tonemap.linear(px, RGB)),
    "tmo_black_batch_drago": _of(black_batch, lambda px: tonemap.drago03(px, RGB)),
    "tmo_black_batch_reinhard": _of(black_batch, lambda px: tonemap.reinhard05(px, RGB)),
    "tmo_black_batch_custom_reinhard": _of(black_batch, lambda px: tonemap.custom_reinhard05(px, RGB)),
    "mixed_linear_tmo": _of(mixed_batch, lambda px: tonemap.linear(px, color.BY_COLUMN)),
    "mixed_convert": _of(mixed_batch, _converted),
    "row_weights": _of(event_image, _weights),
    "filter_log10": _of(embedding_image, lambda px: _rounded(pointwise.log10_filter(px))),
    "filter_pow10": _of(embedding_image, lambda px: _ten_digits(pointwise.pow10_filter(px))),
    "apply2_ratio": apply2_ratio,
    "quick_sample_rows": _of(event_image, lambda px: _rounded(pointwise.quick_sampling(px, 0.6))),
    "box_blur_h": _of(embedding_image, lambda px: _rounded(blur.box_blur(px, 4, "x"))),
    "box_blur_v": _of(embedding_image, lambda px: _rounded(blur.box_blur(px, 4, "y"))),
    "stack_blur": _of(embedding_image, lambda px: _rounded(blur.stack_blur(px, 5))),
    "fast_gaussian": _of(embedding_image, lambda px: _rounded(blur.fast_gaussian(px, 3))),
    "bilateral_splat": _of(embedding_image, lambda px: _grid(px, smoothed=False)),
    "bilateral_grid": _of(embedding_image, lambda px: _grid(px, smoothed=True)),
    "y_fast_bilateral": _of(embedding_image, lambda px: _rounded(bilateral.y_fast_bilateral(px, RGB))),
    "fast_bilateral_5d": _of(embedding_image, lambda px: _rounded(bilateral.fast_bilateral(px, RGB))),
    "percentile_clip": percentile_clip,
    "percentile_sketch": percentile_sketch,
    "tiles_f32": _of(event_image, _tiled("f32")),
    "tiles_f64": _of(event_image, _tiled("f64")),
    "sql_decode": sql_decode,
    "codec_xyze": _of(order_xyz, _codec("hdr", model=XYZ)),
    "rgb_to_xyz": _of(event_image, _maps(color.RGB_TO_XYZ)),
    "xyz_to_rgb": _of(order_xyz, _maps(color.XYZ_TO_RGB)),
    "lms_roundtrip": _of(order_xyz, _maps(color.XYZ_TO_LMS, color.LMS_TO_XYZ, color.XYZ_TO_CAT02, color.CAT02_TO_XYZ, color.XYZ_TO_HPE, color.HPE_TO_XYZ)),
    "ipt_roundtrip": _of(order_xyz, _maps(color.XYZ_TO_LMS, color.LMS_TO_IPT, color.IPT_TO_LMS, color.LMS_TO_XYZ)),
    "rgbe_pack": _of(event_image, _rgbe),
    "rgbe_unpack": _of(event_image, lambda px: _unpacked(_rgbe(px), formats.from_radiance, ("b0", "b1", "b2", "e"))),
    "logluv_pack": _of(order_xyz, _logluv),
    "logluv_unpack": _of(order_xyz, lambda px: _unpacked(_logluv(px), formats.from_logluv, ("high", "low", "u", "v"))),
    "pixel_mapping": _of(event_image, _mapped),
    "codec_pfm": _of(event_image, _codec("pfm")),
    "codec_rgbe": _of(event_image, _codec("hdr")),
    "codec_rgbe_flat": _of(event_image, _codec("hdr", rle="false")),
    "codec_hli_normal": _of(event_image, _codec("hli", pixel_format="RGB")),
    "codec_hli": _of(event_image, _codec("hli", preset="3")),
    "codec_hli_logluv": _of(order_xyz, _codec("hli", model=XYZ, preset="6")),
    "codec_hli_rgbe": _of(event_image, _codec("hli", preset="1")),
    "codec_hli_xyze": _of(order_xyz, _codec("hli", model=XYZ, preset="2")),
    "codec_hli_xyz": _of(order_xyz, _codec("hli", model=XYZ, preset="4")),
    "codec_hli_logluv_gzip": _of(order_xyz, _codec("hli", model=XYZ, preset="5")),
    "clip_bounds": _of(event_image, _bounded),
    "blank_images": _of(embedding_batch, lambda px: blank(describe_images(px, RGB))),
    "float_bytes": _of(event_image, _float_bytes),
    "view_8_bit": _of(event_image, _view(color.view_8_bit)),
    "view_16_bit": _of(event_image, _view(color.view_16_bit)),
    "cone_views": _of(embedding_image, lambda px: _rounded(color.lms_cat02(px, RGB).unionByName(color.lms_hpe(px, RGB)))),
    "file_headers": _of(embedding_batch, _headers),
    "image_metadata": _of(embedding_batch, lambda px: describe_images(px, RGB).select("image_id", "width", "height", "color_model")),
}
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
