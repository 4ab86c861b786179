import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest

from lumera.operators import tonemap
from lumera.schema import RGB, XYZ
from lumera.sources import formats, hli, images, pfm, rgbe, rows, sql, tiles
from lumera.sources.errors import FormatError, UnsupportedError
from lumera.sources.rows import Memory
from lumera.streaming.images import tone_map_stream


def values(h, w, seed=1):
    r = np.random.default_rng(seed)
    v = np.abs(r.normal(size=(h, w, 3))) * np.exp2(r.integers(-10, 10, (h, w, 1)))
    v[1] = v[1, :1]
    return v


@pytest.mark.parametrize("w", [1, 7, 8, 127, 128, 129, 255, 256, 300])
def test_round_trips(w):
    v = values(4, w)
    for rle in (True, False):
        head, got = rgbe.decode(rgbe.encode(v, XYZ, rle))
        assert head["model"] == XYZ and (np.abs(got - v) <= v.max(-1, keepdims=True) / 128).all()
    assert (pfm.decode(pfm.encode(v))[1] == v.astype(np.float32)).all()
    for n, preset in hli.PRESETS.items():
        head, got = hli.decode(hli.encode(v, XYZ, preset))
        assert got.shape == v.shape and head["raster_mode"] == "separately"
        if n == 4:
            assert (got == v.astype(np.float32)).all()
    assert len(rgbe.encode(np.ones((4, 300, 3)))) < 300


def test_radiance_headers_and_faults():
    body = bytes([128, 64, 32, 129]) * 2
    head, got = rgbe.decode(b"#?RADIANCE\n# note\nFORMAT=32-bit_rle_xyze\nEXPOSURE=4.0\nEXPOSURE=2.0\n\n-Y 1 +X 2\n" + body)
    assert head["model"] == XYZ and head["exposure"] == 2.0 and got[0, 0].tolist() == [0.5, 0.25, 0.125]
    for bad in (b"FORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 2\n" + body, b"#?RGBE\n\n+Y 1 +X 2\n" + body, b"#?RGBE\n\n-Y 1 +X 2\n" + body[:5], b"#?RGBE\n\n-Y 1 +X 8\n\x02\x02\x00\x08\xff\x01"):
        with pytest.raises(FormatError):
            rgbe.decode(bad)


def test_float_maps():
    v = values(3, 2).astype(np.float32)
    big = b"PF\n2 3\n2.0\n" + v[::-1].astype(">f4").tobytes()
    assert (pfm.decode(big)[1] == v / 2).all()
    with pytest.raises(UnsupportedError):
        pfm.decode(b"pf\n2 3\n-1.0\n")
    with pytest.raises(FormatError):
        pfm.decode(big[:-1])


def test_hli_headers_and_streams_without_end():
    v = values(5, 6)
    meta = {"author": "x" * 300, "n": "1"}
    data = hli.encode(v, RGB, hli.Header(format="RGB", metadata=meta))
    head, at = hli.read_header(data)
    assert head["metadata"] == meta and (head["width"], head["height"], head["depth"]) == (6, 5, 32)
    assert (hli.decode(data[:-8])[1] == v.astype(np.float32)).all()
    assert hli.PRESETS[1].format == ""
    assert hli.uncbor(hli.cbor({"a": -5, "b": 70000}))[0] == {"a": -5, "b": 70000}
    for bad, error in ((b"HLi.v2", FormatError), (data[:20], FormatError)):
        with pytest.raises(error):
            hli.decode(bad)
    with pytest.raises(UnsupportedError):
        hli.encode(v, RGB, hli.Header(raster_mode="sideways"))


def test_files_as_relations(spark, tmp_path):
    v = {"a": values(4, 9), "b": values(3, 8, 2)}
    for name, data in {"a.hdr": rgbe.encode(v["a"]), "b.pfm": pfm.encode(v["b"]), "c.hli": hli.encode(v["b"], RGB, hli.PRESETS[3])}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "junk.bin").write_bytes(b"nothing")
    found = {r.image_id.rpartition("/")[2]: r for r in images.read_images(spark, str(tmp_path), permissive=True).collect()}
    assert (found["a.hdr"].width, found["a.hdr"].height, found["a.hdr"].format) == (9, 4, "hdr")
    assert found["b.pfm"].metadata["scale"] == "-1.0" and found["junk.bin"].error and found["junk.bin"].width is None
    px = images.read_pixels(spark, f"{tmp_path}/b.pfm")
    back = images.write_files(images.encode_images(px, "pfm"), f"file://{tmp_path}/out", "pfm").collect()
    assert (pfm.decode(open(back[0].path.removeprefix("file://"), "rb").read())[1] == v["b"].astype(np.float32)).all()


def test_formats_of_spark_read(spark, tmp_path, monkeypatch):
    formats.register(spark)
    v = values(40, 9)
    files = {"hdr": rgbe.encode(v), "pfm": pfm.encode(v), "hli": hli.encode(v, RGB, replace(hli.PRESETS[3], metadata={"note": "n" * 9000}))}
    for name, data in files.items():
        (tmp_path / name / "deep").mkdir(parents=True)
        (tmp_path / name / f"a.{name}").write_bytes(data)
        (tmp_path / name / "deep" / f"b.{name}").write_bytes(data)
        (tmp_path / name / "_SUCCESS").write_bytes(b"")
        where = f"file://{tmp_path}/{name}"
        px = spark.read.format(name).load(where)
        assert {r.image_id for r in px.select("image_id").distinct().collect()} == {f"{where}/a.{name}", f"{where}/deep/b.{name}"}
        want = images.read_pixels(spark, f"{where}/a.{name}").drop("image_id")
        got = px.where(px.image_id.endswith(f"a.{name}")).drop("image_id")
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 360
        heads = spark.read.format(name).option("headers", "true").load(where).collect()
        assert [(r.width, r.height, r.color_model, r.format) for r in heads] == [(9, 40, "RGB", name)] * 2
        if name == "hli":
            assert heads[0].metadata["note"] == "n" * 9000
    (tmp_path / "none").mkdir()
    assert spark.read.format("pfm").load(f"file://{tmp_path}/none").count() == 0
    with pytest.raises(FormatError):
        images.read_head(Memory(b"PF\n9 "), pfm)
    # Rows don't matter to a header: the file may end behind it.
    assert images.read_head(Memory(files["pfm"][:14]), pfm)[0]["height"] == 40


def read_png(data):
    at, parts = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        parts[kind] = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + parts[kind])
        at += 12 + n
    w, h = struct.unpack(">II", parts[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + 8 * w)
    return np.ascontiguousarray(rows[:, 1:]).view(">u2").reshape(h, w, 4)


def test_stream_of_files_to_png(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pfm").write_bytes(pfm.encode(values(4, 5)))
    where = {k: f"file://{tmp_path}/{k}" for k in ("in", "out", "state")}
    for more in ("", "b.pfm"):
        if more:
            (tmp_path / "in" / more).write_bytes(pfm.encode(values(3, 5, 2)))
        tone_map_stream(spark, where["in"], where["out"], where["state"], lambda px: tonemap.linear(px, RGB)).awaitTermination()
    made = sorted((tmp_path / "out").glob("[!.]*.png"))
    assert len(made) == 2
    shapes = {read_png(p.read_bytes()).shape for p in made}
    assert shapes == {(4, 5, 4), (3, 5, 4)} and all(read_png(p.read_bytes())[..., 3].min() == 65535 for p in made)


def whole_file(module, v, pixels, **options):
    return rows.encoded(v, module.head, module.rows, RGB, getattr(module, "UPWARDS", False), pixels, **options)


def test_row_ranges_are_the_whole():
    """Any rows of a file, a few at a time, are those of the whole file; bands joined are the one-task file."""
    v = values(23, 40)
    kinds = [(pfm, {}), (rgbe, {}), (rgbe, {"rle": False}), (hli, {"header": hli.Header(format="RGB")}), *[(hli, {"header": p}) for p in hli.PRESETS.values()]]
    for module, options in kinds:
        data = whole_file(module, v, 100, **options)
        assert module is hli or data == module.encode(v, RGB, **options)
        n = rows.band_rows(40, 100)
        order = rows.band_order(23, n, getattr(module, "UPWARDS", False))
        assert data == module.head(40, 23, RGB, **options) + b"".join(module.rows(v[b * n : (b + 1) * n], RGB, **options) for b in order)
        head, whole = module.decode(data)
        at = module.read_header(data)[1]
        for a, b, step in ((0, 23, 5), (22, 23, 1), (7, 19, 4), (3, 3, 1)):
            got = list(module.iter_rows(Memory(data), head, at, a, b, step))
            assert [y for y, _ in got] == list(range(a, b, step)) and (np.concatenate([p for _, p in got] or [whole[:0]]) == whole[a:b]).all()
    data = rgbe.encode(v)
    head, at = rgbe.read_header(data)
    places = list(rgbe.row_offsets(Memory(data), head, at))
    assert [p for p, _ in places] == np.cumsum([at, *[n for _, n in places]]).tolist()[:-1] and sum(places[-1]) == len(data)


def test_golden_bytes():
    """Bytes written out by hand from the formats' rules."""
    one = np.array([[[1.0, 0.5, 0.25]] * 8])
    assert rgbe.encode(one) == b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 8\n" + bytes([2, 2, 0, 8, 136, 128, 136, 64, 136, 32, 136, 129])
    assert rgbe.encode(one[:, :2], XYZ, rle=False) == b"#?RADIANCE\nFORMAT=32-bit_rle_xyze\n\n-Y 1 +X 2\n" + bytes([128, 64, 32, 129] * 2)
    assert pfm.encode(np.array([[[1.0, 2.0, -0.5]], [[0.0, 3.0, 4.0]]])) == b"PF\n1 2\n-1.0\n" + struct.pack("<6f", 0, 3, 4, 1, 2, -0.5)
    run = lambda *parts: rgbe._runs(np.array([b for p in parts for b in p], np.uint8))
    different = list(range(1, 124))
    assert run([7] * 4) == bytes([4, 7, 7, 7, 7]) and run([7] * 5) == bytes([133, 7])
    assert run([7] * 127) == bytes([255, 7]) and run([7] * 128) == bytes([255, 7, 1, 7]) and run([7] * 132) == bytes([255, 7, 133, 7])
    assert run([1, 2], [7] * 6, [3]) == bytes([2, 1, 2, 134, 7, 1, 3])
    # A run is cut where its window of 128 bytes ends, and is none if fewer than five are left of it.
    assert run(different, [9] * 20) == bytes([123, *different, 133, 9, 143, 9])
    assert run(different, [200], [9] * 20) == bytes([128, *different, 200, *[9] * 4, 144, 9])
    raw = hli.encode(np.array([[[1.0, 2.0, 3.0]]]), RGB, hli.Header(format="RGB"))
    fields = b"\xa6\x65width\x01\x66height\x01\x65depth\x18\x20\x66format\x63RGB\x6braster_mode\x66normal\x6bcompression\x64gzip"
    assert raw.startswith(b"HLi.v1\x01" + bytes([len(fields)]) + fields)
    assert zlib.decompress(raw[8 + len(fields) :], 31) == struct.pack("<3f", 1, 2, 3)


def pixel_rows(spark, named, model=RGB):
    rows_ = [(n, x, y, *map(float, v[y, x]), model) for n, v in named.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows_, "image_id string, x int, y int, c1 double, c2 double, c3 double, color_model string")


def test_write_formats(spark, tmp_path):
    """Append, overwrite, bands without pixels, and the same bytes as the one-task encoder."""
    formats.register(spark)
    named = {"a/b": values(30, 9), "c": values(11, 20, 2)}
    px = pixel_rows(spark, named).repartition(5)
    gap = px.where("NOT (image_id = 'c' AND y BETWEEN 2 AND 7) AND NOT (image_id = 'a/b' AND y < 8)")
    for v, a, b in ((named["c"], 2, 8), (named["a/b"], 0, 8)):
        v[a:b] = 0
    for kind, options in (("hdr", {}), ("hdr", {"rle": "false"}), ("pfm", {}), ("hli", {"preset": "3", "metadata": '{"by": "me"}'})):
        where = tmp_path / f"{kind}{len(options)}"
        formats.save(gap, f"file://{where}", kind, pixels=64, **options)
        files = {f.name.rpartition("-")[0]: f for f in where.iterdir()}
        assert set(files) == {"a_b", "c"}
        module = images.CODECS[kind][0]
        for name, v in (("a_b", named["a/b"]), ("c", named["c"])):
            assert files[name].read_bytes() == whole_file(module, v, 64, **module.codec_options(options))
        # Read by ranges of rows, in many partitions.
        got = spark.read.format(kind).option("split", "300").load(f"file://{where}")
        assert got.rdd.getNumPartitions() > 5 and got.count() == 490
        want = images.read_pixels(spark, f"file://{where}")
        key = lambda df: sorted((r.image_id.rpartition("/")[2], *r[1:]) for r in df.collect())
        assert key(got) == key(want)
    where = f"file://{tmp_path}/pfm0"
    formats.save(px.where("image_id = 'c'"), where, "pfm")
    assert len(list((tmp_path / "pfm0").iterdir())) == 2
    (tmp_path / "pfm0" / "note.txt").write_text("stays")
    formats.save(px.where("image_id = 'c'"), where, "pfm", mode="overwrite")
    assert sorted(f.suffix for f in (tmp_path / "pfm0").iterdir()) == [".pfm", ".txt"]
    # Pixels may be written as they are when each image is in one task.
    px.coalesce(1).write.format("hdr").mode("append").save(f"file://{tmp_path}/plain")
    assert len(list((tmp_path / "plain").glob("*.hdr"))) == 2


def test_failed_writes_leave_no_file(spark, tmp_path):
    formats.register(spark)
    px = pixel_rows(spark, {f"i{k}": values(4, 5, k) for k in range(6)})
    good = images.in_file_order(images.encode_bands(px, "pfm"), "pfm")
    where = tmp_path / "out"
    bad = {
        "one task fails": good.repartition(3, "image_id").selectExpr("image_id", "width", "height", "color_model", "IF(image_id = 'i3', raise_error('lost'), band) AS band", "per_band", "content"),
        "band twice": good.unionByName(good).repartition(2, "image_id"),
        "an image in several tasks": px.repartition(4),
        "XYZ in a float map": images.in_file_order(images.encode_bands(px.withColumn("color_model", px.color_model), "hdr"), "pfm").selectExpr("image_id", "width", "height", "'XYZ' AS color_model", "per_band", "band", "content"),
    }
    for why, df in bad.items():
        with pytest.raises(Exception):  # noqa: B017
            df.write.format("pfm").mode("append").save(f"file://{where}")
        assert not where.exists() or not list(where.iterdir()), why
    good.write.format("pfm").mode("append").save(f"file://{where}")
    before = {f.name: f.read_bytes() for f in where.iterdir()}
    assert len(before) == 6
    with pytest.raises(Exception):  # noqa: B017
        bad["one task fails"].write.format("pfm").mode("overwrite").save(f"file://{where}")
    assert {f.name: f.read_bytes() for f in where.iterdir()} == before
    with pytest.raises(Exception, match="takes pixels or the bands"):
        spark.range(3).write.format("pfm").mode("append").save(f"file://{where}")


def test_files_are_chosen_before_they_are_opened(spark, tmp_path):
    """Small files share partitions; names and rows are chosen before reading; a damaged file that isn't wanted is no matter."""
    formats.register(spark)
    v = values(6, 5)
    for i in range(40):
        (tmp_path / f"f{i}.pfm").write_bytes(pfm.encode(v))
    (tmp_path / "x.hdr").write_bytes(rgbe.encode(v, XYZ))
    (tmp_path / "bad.pfm").write_bytes(b"PF\n5")
    where = f"file://{tmp_path}"
    df = spark.read.format("images").load(where)
    assert df.columns[-1] == "color_model" and df.rdd.getNumPartitions() == 1
    assert spark.read.format("images").option("headers", "true").option("split", str(20 * images.OPEN)).load(where).rdd.getNumPartitions() == 3
    one = spark.read.format("images").option("pathGlobFilter", "f7.pfm").option("rows", "2:4").load(where).where("x < 3")
    want = [(y, x, float(np.float32(v[y, x, 0]))) for y in (2, 3) for x in range(3)]
    assert sorted((r.y, r.x, r.c1) for r in one.collect()) == want
    some = spark.read.format("images").options(pathGlobFilter="*.hdr", rows="4:").load(where)
    assert {(r.color_model, r.y) for r in some.collect()} == {("XYZ", 4), ("XYZ", 5)}
    # The same by DataFrames: a condition on the listing chooses what is opened.
    files = images.find_files(spark, where)
    few = images.decode_files(files.where(files.image_id.endswith("/f7.pfm")), split=40)
    assert few.rdd.getNumPartitions() > 1 and sorted((r.y, r.x, r.c1) for r in few.where("y IN (2, 3) AND x < 3").collect()) == want
    assert images.decode_files(files.where(~files.image_id.contains("bad"))).count() == 41 * 30
    with pytest.raises(Exception, match="header does not end"):
        df.count()
    heads = spark.read.format("images").options(headers="true", permissive="true").load(where).collect()
    assert len(heads) == 42 and [r.metadata["error"] for r in heads if r.width is None] == ["pfm: the header does not end"]
    assert spark.read.format("images").option("permissive", "true").load(where).count() == 41 * 30
    assert images.read_images(spark, where, permissive=True).where("width = 5").count() == 41


class Plain:
    """A codec of three doubles a pixel, added by a user."""

    @staticmethod
    def read_header(data):
        if len(data) < 12:
            raise FormatError("plain: no header")
        w, h = struct.unpack("<2i", data[4:12])
        return {"width": w, "height": h, "model": "RAW"}, 12

    @staticmethod
    def iter_rows(f, head, at, y0, y1, step):
        for y in range(y0, y1, step):
            n = min(step, y1 - y) * head["width"] * 3
            yield y, np.frombuffer(f.read_at(8 * n, at + y * head["width"] * 24), "<f8").reshape(-1, head["width"], 3)

    @staticmethod
    def codec_options(options):
        return {}

    @staticmethod
    def head(width, height, model):
        return b"PLN\n" + struct.pack("<2i", width, height)

    @staticmethod
    def rows(values, model):
        return values.astype("<f8").tobytes()


def test_a_codec_of_ones_own(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(images.CODECS, "plain", (Plain, (b"PLN\n",)))
    v = values(7, 4)
    where = f"file://{tmp_path}/own"
    formats.save(pixel_rows(spark, {"p": v}), where, "plain", "RAW")
    for df in (spark.read.format("plain").option("split", "100").load(where), spark.read.format("images").load(where), images.read_pixels(spark, where)):
        assert sorted((r.y, r.x, r.c1, r.c2, r.c3) for r in df.collect()) == [(y, x, *v[y, x].tolist()) for y in range(7) for x in range(4)]


def test_tiles(spark):
    """Dense tiles of any side give the pixels back: all of them in 64 bits, rounded ones in 32; edges, gaps, no rows."""
    v = values(13, 7)
    px = pixel_rows(spark, {"a": v, "b": v[:5]})
    for side in (1, 5, 64):
        wide = tiles.to_tiles(px, "f64", side)
        assert wide.count() == -(-13 // side) * -(-7 // side) + -(-5 // side) * -(-7 // side)
        assert sorted(map(tuple, tiles.from_tiles(wide).collect())) == sorted(tuple(r)[:6] for r in px.collect())
    single = tiles.from_tiles(tiles.to_tiles(px.where("image_id = 'a' AND NOT (x = 3 AND y = 2)"), "f32", 4))
    assert {(r.x, r.y): r.c1 for r in single.collect()} == {(x, y): 0.0 if (x, y) == (3, 2) else float(np.float32(v[y, x, 0])) for y in range(13) for x in range(7)}
    assert tiles.from_tiles(tiles.to_tiles(px.limit(0))).count() == 0


def test_decoding_in_sql(spark):
    sql.register(spark)
    v = values(5, 4)
    files = [("a", pfm.encode(v)), ("b", rgbe.encode(v, XYZ)), ("c", hli.encode(v)), ("none", None)]
    spark.createDataFrame(files, "path string, content binary").createOrReplaceTempView("image_files")
    want = {(n, r.x, r.y, r.c1) for n in "abc" for r in images.decode_pixels(spark.createDataFrame([f for f in files if f[0] == n], "image_id string, content binary")).collect()}
    lateral = spark.sql("SELECT f.path, p.x, p.y, p.c1 FROM image_files f, LATERAL decode_image(f.content) p")
    table = spark.sql("SELECT image_id, x, y, c1 FROM decode_images(TABLE(SELECT path, content FROM image_files))")
    assert {tuple(r) for r in lateral.collect()} == {tuple(r) for r in table.collect()} == want
    heads = spark.sql("SELECT path, h.format, h.width, h.height, h.color_model FROM (SELECT path, image_header(content) AS h FROM image_files)")
    assert {tuple(r) for r in heads.collect()} == {("a", "pfm", 4, 5, "RGB"), ("b", "hdr", 4, 5, "XYZ"), ("c", "hli", 4, 5, "XYZ"), ("none", None, None, None, None)}
