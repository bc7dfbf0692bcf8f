"""Sources and sinks on files made here."""

import struct

import numpy as np
import pytest

from framelake.functions import labels, nal
from framelake.operators import decode
from framelake.sources import telemetry, video


@pytest.fixture(scope="module")
def known(spark):
    video.register(spark)
    telemetry.register(spark)
    return spark


def test_raw_video(known, tmp_path):
    w, h, n = 16, 8, 5
    frames = [bytes([i * 10]) * (w * h * 3 // 2) for i in range(n)]
    (tmp_path / "a.yuv").write_bytes(b"".join(frames) + b"tail")
    df = known.read.format("rawvideo").options(path=str(tmp_path / "a.yuv"), width=w, height=h, fourcc="YU12").load()
    assert [bytes(r.data) for r in df.orderBy("frame_idx").collect()] == frames
    part = known.read.format("rawvideo").options(path=str(tmp_path / "a.yuv"), width=w, height=h, fourcc="YU12", first=3, last=9).load()
    assert [r.frame_idx for r in part.orderBy("frame_idx").collect()] == [3, 4]
    back = tmp_path / "b.yuv"
    assert video.write_clip(df, str(back), 1, 2) == 2 * len(frames[0])
    assert back.read_bytes() == frames[1] + frames[2]
    rgb = decode.to_rgb(df)
    assert rgb.where("error is null and length(rgb) = 384").count() == n
    assert decode.pixels(rgb).count() == n * w * h
    nv = decode.to_format(df, "NV12").orderBy("frame_idx").collect()
    assert [r.fourcc for r in nv] == ["NV12"] * n and bytes(nv[2].data) == frames[2]
    assert decode.channels(df).where("length(plane) = 128").count() == 3 * n


@pytest.mark.parametrize("options", [{"width": 15, "height": 8, "fourcc": "YU12"}, {"width": 16, "height": 8, "fourcc": "HSV3"}, {"width": 9000, "height": 8, "fourcc": "GREY"}, {"width": 64, "height": 64, "fourcc": "YU12"}])
def test_raw_video_refuses(known, tmp_path, options):
    (tmp_path / "a.yuv").write_bytes(b"x" * 200)
    with pytest.raises(Exception, match="(?i)fit|shown|size|whole"):
        known.read.format("rawvideo").options(path=str(tmp_path / "a.yuv"), **options).load().count()


def test_y4m(known, tmp_path):
    body = [bytes([i]) * 24 for i in range(3)]
    (tmp_path / "a.y4m").write_bytes(b"YUV4MPEG2 W4 H4 F25:0 Ip A1:1 C420jpeg\n" + b"".join((b"FRAME\n" if i != 1 else b"FRAME Ip\n") + b for i, b in enumerate(body)))
    rows = known.read.format("y4m").option("path", str(tmp_path / "a.y4m")).load().orderBy("frame_idx").collect()
    assert [bytes(r.data) for r in rows] == body
    assert video.y4m_header("YUV4MPEG2 W4 H4 F25:0")["fps"] == (30, 1)
    assert [video.y4m_format(c) for c in ("420jpeg", "422p10", "444p12", "mono", "420")] == ["YU12", "2T22", "4C44", "GREY", "YU12"]
    with pytest.raises(ValueError):
        video.y4m_header("YUV4MPEG2 W4")


def test_images(spark, tmp_path):
    rgb = np.arange(27, dtype=np.uint8).tobytes()
    for i in (2, 10, 1):
        (tmp_path / f"shot_{i}.ppm").write_bytes(video.to_ppm(3, 3, rgb))
    (tmp_path / "other_1.bmp").write_bytes(video.to_bmp(3, 3, rgb))
    (tmp_path / "bad_1.bmp").write_bytes(b"BMxx")
    rows = video.images(spark, str(tmp_path)).orderBy("video", "frame_idx").collect()
    assert [(r.video, r.frame_idx) for r in rows] == [("bad_", 0), ("other_", 0), ("shot_", 0), ("shot_", 1), ("shot_", 2)]
    assert rows[0].data is None and "BMP" in rows[0].error
    assert all(bytes(r.data) == rgb for r in rows[1:])
    assert video.ppm(b"P3 # note\n1 1\n100\n50 100 0\n") == (1, 1, bytes([128, 255, 0]))
    assert video.ppm(b"P6 1 1 65535\n" + struct.pack(">3H", 65535, 0, 32768))[2] == bytes([255, 0, 128])
    written = video.write_frames(video.images(spark, str(tmp_path), "shot*.ppm"), str(tmp_path / "out"), "bmp").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in written) == [f"shot__{i:06d}.bmp" for i in range(3)]
    assert video.bmp((tmp_path / "out" / "shot__000001.bmp").read_bytes()) == (3, 3, rgb)


def container(path):
    texts = ["", "IDR", "Intra", "2Nx2N", "split", "1"]
    strings = struct.pack("<I", len(texts)) + b"".join(struct.pack("<I", len(t)) + t.encode() for t in texts)
    put = lambda kind, *rows: np.array([tuple(r.get(n, np.zeros(kind[n].shape)) if kind[n].shape else r.get(n, 0) for n in kind.names) for r in rows], kind).tobytes()
    frames = put(telemetry.FRAME, {"poc": 0, "type": 1, "output": 1, "vps": -1, "slice_bits": 100, "data_bits": -1, "block_off": 0, "block_n": 2, "aux_n": 2}, {"idx": 1, "poc": 4, "type": 1, "block_off": 312, "block_n": -1, "aux_off": 2, "aux_n": -1})
    blocks = put(telemetry.BLOCK, {"w": 8, "h": 8, "qp": 30, "mode": 2, "partition": 3, "bits": 64, "syntax_n": 1, "transforms_n": 1, "mv_flags": 4 | 64 | 128, "mv": (5, -6)}, {"x": 8, "w": 8, "h": 8, "qp": -3, "mode": 99, "syntax_off": 28})
    syntax = put(telemetry.SYNTAX, {"name": 4, "value": 5, "bits": 3})
    tx = put(telemetry.TRANSFORM, {"w": 4, "h": 4, "flags": 1 | 32, "count": 2, "group_count": 1, "abs_sum": 9, "nonzero": 7})
    coeffs = struct.pack("<5i", 4, -5, 0, 1, 1)
    parts = [strings, b'{"parameter_sets":[{"kind":"sps"}, 3]}', frames, blocks, syntax, b"", tx, b"", coeffs, b"{}"]
    at, directory = telemetry.HEADER, b""
    for p in parts:
        directory += struct.pack("<QQ", at, len(p))
        at += len(p)
    path.write_bytes(telemetry.MAGIC + struct.pack("<II", 4, 2) + directory + b"".join(parts))


def test_container(known, tmp_path):
    path = tmp_path / "a.catb"
    container(path)
    read = lambda section: known.read.format("catb").options(path=str(path), section=section).load()
    f = read("frames").orderBy("decode_idx").collect()
    assert [(r.poc, r.type, r.slice_bits, r.data_bits, r.vps) for r in f] == [(0, "IDR", 100, None, None), (4, "IDR", 0, 0, 0)]
    b = read("blocks").orderBy("block_idx").collect()
    assert [(r.decode_idx, r.qp, r.mode, r.mv_x, r.mv_y, r.mvp_x, r.long_term) for r in b] == [(0, 30, "Intra", 5, -6, None, 1), (0, -3, "", None, None, None, None)]
    assert [(r.block_idx, r.name, r.value, r.bits) for r in read("syntax").collect()] == [(0, "split", "1", 3)]
    assert [(r.abs_sum, r.nonzero) for r in read("transforms").collect()] == [(9, None)]
    assert [(r.levels, r.scan, r.group_flags) for r in read("coeffs").collect()] == [([4, -5], [0, 1], [1])]
    assert [r.aux for r in read("aux").collect()] == ["{}"] and read("cabac").count() == 0
    assert telemetry.parameter_sets(read("meta").first().meta) == [{"kind": "sps"}]
    (tmp_path / "b.catb").write_bytes(b"nothing at all")
    with pytest.raises(Exception, match="no telemetry container"):
        known.read.format("catb").options(path=str(tmp_path / "b.catb"), section="frames").load().count()


def test_side_data(spark, tmp_path):
    frame = struct.pack(">iH", 7, 3) + bytes([0x50, 0x40, 0x60, 0x18, 0x20, 1]) + struct.pack(">bbbHBBB", -2, 3, -4, 512, 200, 0, 0)
    unit = bytes([40, 8, 4, 32, 12, 16, 48, 32]) + struct.pack(">bbbHBbB", -5, 1, 2, 256, 9, -1, 77)
    (tmp_path / "a.bin").write_bytes(b"IP\x00\x02" + frame + unit * 2 + b"IP\x00\x00" + frame)
    (tmp_path / "b.bin").write_bytes(b"IP\x07\x00")
    rows = telemetry.sideband(spark, str(tmp_path)).orderBy("path", "seq", "ctu").collect()
    good = [r for r in rows if r.path.endswith("a.bin")]
    assert [(r.seq, r.ctu) for r in good] == [(0, 0), (0, 1), (1, None)]
    first = good[0]
    assert (first.frame_id, first.frame_scene_class, first.frame_qp_bias, first.frame_lambda_scale_q8) == (7, 5, -2, 512)
    assert (first.activity, first.noise, first.qp_delta, first.lambda_scale_q8, first.noise_sigma_q8) == (10, 2, -5, 256, None)
    assert [r.error is None for r in rows if r.path.endswith("b.bin")] == [False]
    assert telemetry.side_summary(telemetry.sideband(spark, str(tmp_path / "a.bin")), ["path"]).first().mean_qp_delta == -5


def test_byte_stream(spark):
    units = [bytes([0x40, 1, 0xFF]), bytes([0x42, 1, 1]), bytes([0x26, 1, 0x80, 5]), bytes([0x02, 1, 0x01]), bytes([0x02, 1, 0x80])]
    data = b"junk" + b"\x00" + b"\x00\x00\x01".join([b""] + units)
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, None)], "k int, data binary")
    got = nal.units(df, ["k"]).orderBy("unit").collect()
    assert [(r.offset, r.start_code_len, r.size, r.nal_type, r.is_vcl, r.au_id) for r in got] == [(4, 4, 3, 32, False, 0), (11, 3, 3, 33, False, 0), (17, 3, 4, 19, True, 0), (24, 3, 3, 1, True, 0), (30, 3, 3, 1, True, 1)]
    assert [r.name for r in nal.filtered(nal.units(df, ["k"]), "nonvcl", "ps").orderBy("unit").collect()] == ["VPS_NUT", "SPS_NUT"]
    assert [(r.k, r.codec, r.n_vcl) for r in nal.detected(df, ["k"]).collect()] == [(1, "hevc", 3)]


def test_labels(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(labels.mode_class(F.lit("Merge_SKIP")).alias("a"), labels.frame_type_class(F.lit("bla_n")).alias("b"), labels.ref_tier(F.lit(3)).alias("c"), labels.zscan_to_raster(F.lit(6)).alias("d"), labels.intra_angle_hevc(F.lit(2)).alias("e"), labels.grouped_digits(F.lit(1234567)).alias("f"), labels.normalized(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("g")).first()
    assert tuple(row) == ("skip", "I", 2, 6, 225.0, "1,234,567", 1.0)


def test_pixel_info(spark):
    w, h = 8, 4
    data = bytearray(range(w * h)) + bytes([100] * 8) + bytes([200] * 8)
    frames = spark.createDataFrame([("v", 0, w, h, "YU12", data)], "video string, frame_idx long, width int, height int, fourcc string, data binary")
    points = spark.createDataFrame([("v", 0, 1, 2), ("v", 0, 99, 0), ("v", 3, 0, 0)], "video string, frame_idx long, x int, y int")
    got = {r.x: r for r in decode.pixel_info(frames, points).collect()}
    assert set(got) == {1, 99} and got[99].components == {}
    assert got[1].components == {"Y": 17, "U": 100, "V": 200}
    assert got[1].neighbourhood[4][4] == "11" and got[1].neighbourhood[0][4] == "" and got[1].neighbourhood[3][3] == "08"


@pytest.mark.parametrize("step", [40, 1 << 20])
def test_byte_streams_in_files(spark, tmp_path, step):
    import random

    from framelake.sources import annexb

    r = random.Random(3)
    piece = lambda n: bytes(r.choice((0, 0, 0, 1, 1, 3, 65, 129, 255, 38, 2)) for _ in range(n))
    files = {"a.265": piece(900), "b.bin": b"\0\0\0\1\x26\1\x01" + piece(400) + b"\0\0\1", "c.h264": b"\0\0\1\x67" + b"\5" * 200 + b"\0\0\0\0\1\x65\x88", "d.hevc": b"no codes", "e.bin": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "notes.txt").write_bytes(b"\0\0\1\1")
    codes = annexb.read(spark, str(tmp_path), step)
    by_file = {row.path.rsplit("/", 1)[1]: row for row in annexb.streams(codes).collect()}
    got = {}
    for row in annexb.units(codes).orderBy("path", "unit").collect():
        got.setdefault(row.path.rsplit("/", 1)[1], []).append(row)
    assert set(got) == set(by_file) == {"a.265", "b.bin", "c.h264"}
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "k string, data binary")
    for name, rows in got.items():
        codec = by_file[name].codec
        whole = nal.units(table.where(f"k = '{name}'"), ["k"], codec=codec).orderBy("unit").collect()
        columns = ["unit", "offset", "start_code_len", "size", *nal.FIELDS, "is_vcl", "au_start", "opener", "au_id"]
        assert [[x[c] for c in columns] for x in rows] == [[x[c] for c in columns] for x in whole]
        assert by_file[name].n_vcl == sum(x.is_vcl for x in rows) and by_file[name].n_units == len(rows)
        # read one after another, as the format's rules say
        data, starts, at, au = files[name], [], 0, -1
        while (k := data.find(b"\0\0\1", at)) >= 0:
            starts.append((k - 1, 4) if k > at and data[k - 1] == 0 or k > 0 and at <= k - 1 and data[k - 1] == 0 else (k, 3))
            at = k + 3
        for (start, length), following, row in zip(starts, [*(s for s, _ in starts[1:]), len(data)], rows, strict=True):
            p = data[start + length : following]
            kind, least, flag = (p[0] >> 1 & 63, 2, p[2:3]) if codec == "hevc" and len(p) > 1 else (p[0] & 31, 1, p[1:2]) if codec == "avc" and p else (0, 9, b"")
            vcl = len(p) >= least and (kind < 32 if codec == "hevc" else 0 < kind < 6)
            starts_picture = vcl and bool(flag) and flag[0] > 127
            au += vcl and (starts_picture or au < 0)
            opener = not vcl and kind in ((32, 33, 34, 35, 39, 41, 42, 43, 44) if codec == "hevc" else (6, 7, 8, 9, 13, 14, 15, 16))
            assert (row.offset, row.size, row.nal_type, row.is_vcl, row.au_start, row.au_id) == (start, len(p), kind, vcl, starts_picture, max(0, au + opener))


@pytest.mark.parametrize("step", [1, 2, 3, 5, 64])
def test_any_cut_finds_the_same_codes(tmp_path, step, monkeypatch):
    import random

    from framelake.sources import annexb

    r = random.Random(8)
    monkeypatch.setattr(annexb, "AHEAD", 9)
    for k in range(40):
        data = bytes(r.choice((0, 0, 0, 1, 3)) for _ in range(r.randrange(60)))
        (tmp_path / "x").write_bytes(data)
        read = lambda n: [row for part in annexb.CodeReader(str(tmp_path / "x"), n).partitions() if part.total for row in zip(*(x.tolist() for x in annexb.codes_of(open(tmp_path / "x", "rb"), part)), strict=True)]  # noqa: E731, B023, SIM115
        # bytes behind a unit's end are masked later, so they count only within it
        same = lambda rows: [(a, b, c, *(v for i, v in enumerate(h) if i < c)) for a, b, c, *h in rows]
        assert same(read(step)) == same(read(1000))


def test_small_files_share_a_task(spark, tmp_path, monkeypatch):
    from framelake.sources import annexb

    for i in range(30):
        (tmp_path / f"{i:02d}.bin").write_bytes(b"\0\0\1\x26\1\x80" * (i + 1))
    (tmp_path / "15a.bin").write_bytes(b"\0\0\1\x26" * 50)
    codes = annexb.read(spark, str(tmp_path), 190)
    assert codes.rdd.getNumPartitions() < 8
    got = {(r.path[-6:-4], r.n) for r in annexb.units(codes).groupBy("path").agg({"unit": "max"}).toDF("path", "n").collect()}
    assert got == {(f"{i:02d}", i) for i in range(30)} | {("5a", 49)}
    monkeypatch.setattr(annexb, "BYTES_A_TASK", 400)
    parts = annexb.CodeReader(str(tmp_path), 150).partitions()
    assert sorted((r.path[-7:], r.low) for p in parts for r in (p, *p.others)) == sorted((path[-7:], low) for path, size in annexb.listed(str(tmp_path)) for low in range(0, size, 150))
    assert all(sum(r.total for r in (p, *p.others)) <= 400 and all(r.high == r.total for r in p.others) for p in parts if p.others)


def test_codec_by_header_faults(spark):
    from pyspark.sql import functions as F

    stream = lambda *units: bytearray(b"".join(b"\0\0\1" + u for u in units))
    rows = [("h", stream(b"\x40\1\2", b"\x26\1\x80")), ("a", stream(b"\x67\x42", b"\x68\xce", b"\x65\x88")), ("tie", stream(b"\x80\0")), ("short", stream(b"", b"\x40"))]
    got = {r.k: (r.codec, r.hevc_faults, r.avc_faults) for r in nal.detected(spark.createDataFrame(rows, "k string, data binary"), ["k"]).collect()}
    assert got == {"h": ("hevc", 0, 2), "a": ("avc", 6, 0), "tie": ("hevc", 4, 4), "short": ("hevc", 4, 4)} or got["a"][0] == "avc" and got["tie"][0] == "hevc" and got["short"] == ("hevc", 4, 4)
    hint = spark.range(1).select(nal.codec_hint(F.lit("x/y.AVC")).alias("a"), nal.codec_hint(F.lit("x.h265/y.bin")).alias("b"), nal.codec_by_faults(F.lit(1), F.lit(1), F.lit("avc")).alias("c")).first()
    assert tuple(hint) == ("avc", None, "avc")
    assert nal.detected(spark.createDataFrame(rows[2:3], "k string, data binary"), ["k"], hint="avc").first().codec == "avc"


@pytest.mark.parametrize("step", [40, 200, 1 << 20])
def test_y4m_by_ranges(known, tmp_path, step):
    head = b"YUV4MPEG2 W4 H4 F25:1 Ip A1:1 C420jpeg\n"
    body = [bytes([i]) * 24 for i in range(40)]
    odd = [b"FRAME" + (b" Ip" * (i % 4 == 1) + b" Xlong" * (i % 7 == 2)) + b"\n" for i in range(40)]
    (tmp_path / "plain.y4m").write_bytes(head + b"".join(b"FRAME\n" + b for b in body))
    (tmp_path / "odd.y4m").write_bytes(head + b"".join(m + b for m, b in zip(odd, body, strict=True)))
    (tmp_path / "alike.y4m").write_bytes(head + b"".join(b"FRAME\n" + b"FRAME\n" * 4 for _ in body))
    (tmp_path / "broken.y4m").write_bytes(head + b"".join(b"FRAME\n" + b for b in body[:20]) + b"noise" + b"".join(b"FRAME\n" + b for b in body))
    for name, want in (("plain", body), ("odd", body), ("alike", [b"FRAME\n" * 4] * 40), ("broken", body[:20])):
        rows = video.y4m(known, str(tmp_path / f"{name}.y4m"), step).orderBy("frame_idx").collect()
        assert [r.frame_idx for r in rows] == list(range(len(want))) and [bytes(r.data) for r in rows] == want, name
        walked = known.read.format("y4m").option("path", str(tmp_path / f"{name}.y4m")).load().orderBy("frame_idx").collect()
        assert [bytes(r.data) for r in walked] == want
    assert video.y4m(known, str(tmp_path), step).groupBy("video").count().count() == 4


def test_folders_and_patterns(known, tmp_path):
    for i in range(3):
        (tmp_path / f"v{i}.yuv").write_bytes(bytes([i]) * 48)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    raw = known.read.format("rawvideo").options(path=str(tmp_path), width=4, height=4, fourcc="YU12").load()
    assert sorted((r.video[-6:], r.frame_idx, r.data[0]) for r in raw.collect()) == [(f"v{i}.yuv", k, i) for i in range(3) for k in range(2)]
    some = known.read.format("rawvideo").options(path=f"{tmp_path}/v[12].yuv", width=4, height=4, fourcc="YU12", first=1).load()
    assert sorted((r.video[-6:], r.frame_idx) for r in some.collect()) == [("v1.yuv", 1), ("v2.yuv", 1)]


def test_committing_sinks(known, tmp_path):
    from pyspark.sql import functions as F

    from framelake.sources import sinks

    rows = known.range(0, 500, numPartitions=8).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"), F.lit(".bin")).alias("file"), (500 - F.col("id")).alias("seq"), F.encode(F.concat(F.col("id").cast("string"), F.lit(";")), "UTF-8").alias("data"))
    sinks.save(rows, str(tmp_path / "out"))
    want = {f"s{k}.bin": "".join(f"{i};" for i in range(499, -1, -1) if i % 3 == k) for k in range(3)}
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == want
    sinks.save(rows, str(tmp_path / "parts"), join=False)
    found = sorted(p.name for p in (tmp_path / "parts").iterdir())
    for k in range(3):
        assert "".join((tmp_path / "parts" / n).read_text() for n in found if n.startswith(f"s{k}.")) == want[f"s{k}.bin"]
    broken = rows.withColumn("data", F.when(F.col("seq") == 7, F.raise_error(F.lit("no such frame")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="no such frame"):
        sinks.save(broken, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())
    overlapping = rows.limit(0).unionAll(known.createDataFrame([("x", 1, bytearray(b"a")), ("x", 5, bytearray(b"b")), ("x", 3, bytearray(b"c"))], "file string, seq long, data binary"))
    with pytest.raises(Exception, match="out of order"):
        sinks.register(known)
        overlapping.coalesce(1).write.format("orderedfiles").mode("append").option("path", str(tmp_path / "y")).save()


def test_a_task_that_runs_again_leaves_no_second_part(tmp_path):
    import pyarrow as pa

    from framelake.sources import sinks

    writer = sinks.OrderedWriter(str(tmp_path / "o"), True)
    batch = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array(["f"] * (hi - lo)), pa.array(range(lo, hi), pa.int64()), pa.array([b"%d," % i for i in range(lo, hi)], pa.binary())], ["file", "seq", "data"])
    writer.write(iter([batch(0, 3)]))  # its report is lost
    writer.commit([writer.write(iter([batch(3, 6)])), None, writer.write(iter([batch(0, 3)]))])
    assert (tmp_path / "o" / "f").read_text() == "0,1,2,3,4,5," and [p.name for p in (tmp_path / "o").iterdir()] == ["f"]
    again = sinks.OrderedWriter(str(tmp_path / "o"), True)
    with pytest.raises(ValueError, match="overlap"):
        again.commit([again.write(iter([batch(0, 4)])), again.write(iter([batch(3, 6)]))])
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["f"]


def test_rows_are_written_in_runs(tmp_path):
    import pyarrow as pa

    from framelake.sources import sinks

    files, data = ["a", "a", "a", "b", "b", "a", "c"], [b"0", None, b"22", b"", b"44", b"5", None]
    for kind in (pa.binary(), pa.large_binary()):
        batch = pa.RecordBatch.from_arrays([pa.array(files), pa.array(range(7), pa.int64()), pa.array(data, kind)], ["file", "seq", "data"])
        assert sinks.runs(batch.column(0)) == [(0, 3), (3, 5), (5, 6), (6, 7)] and sinks.runs(batch.column(0).slice(0, 0)) == []
        assert [bytes(sinks.joined(batch.column(2).slice(a, n))) for a, n in ((0, 7), (1, 1), (2, 3), (6, 1), (3, 0))] == [b"022445", b"", b"2244", b"", b""]
        writer = sinks.OrderedWriter(str(tmp_path / str(kind)), True)
        done = writer.write(iter([batch.slice(0, 2), batch.slice(2, 3), batch.slice(5, 0)]))
        assert [(p.file, p.first, p.last, p.size) for p in done.parts] == [("a", 0, 2, 3), ("b", 3, 4, 2)]
        writer.commit([done, writer.write(iter([batch.slice(5)]))])
        assert {p.name: p.read_bytes() for p in (tmp_path / str(kind)).iterdir()} == {"a": b"0225", "b": b"44", "c": b""}


def test_conversion_to_files(known, tmp_path):
    from framelake.sources import sinks

    w, h, n = 8, 4, 6
    data = [bytes((i * 7 + k) % 256 for k in range(w * h * 3 // 2)) for i in range(n)]
    (tmp_path / "a b.yuv").write_bytes(b"".join(data))
    df = known.read.format("rawvideo").options(path=str(tmp_path / "a b.yuv"), width=w, height=h, fourcc="YU12").load()
    sinks.convert(df, str(tmp_path / "nv"), "NV12")
    back = known.read.format("rawvideo").options(path=str(tmp_path / "nv" / "a_b.yuv.yuv"), width=w, height=h, fourcc="NV12").load()
    assert [bytes(r.data) for r in decode.to_format(back, "YU12").orderBy("frame_idx").collect()] == data
    sinks.convert(df, str(tmp_path / "ppm"), "PPM")
    assert (tmp_path / "ppm" / "a_b.yuv.ppm").read_bytes().count(b"P6\n8 4\n255\n") == n
    sinks.save_clip(df, str(tmp_path / "clip.yuv"), 2, 4, "NV12")
    assert (tmp_path / "clip.yuv").stat().st_size == 3 * len(data[0])
    bad = df.withColumn("width", df.width + 1)
    with pytest.raises(Exception, match="frame"):
        sinks.convert(bad, str(tmp_path / "bad"), "NV12")


def png(path, width, height, rgb):
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_stills_in_the_jvm(spark, tmp_path):
    rgb = bytes(range(60))
    for i in (2, 10, 1):
        png(tmp_path / f"shot_{i}.png", 5, 4, bytes([i]) + rgb[1:])
    png(tmp_path / "alone.png", 5, 4, rgb)
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8\xff no image")
    (tmp_path / "other_1.bmp").write_bytes(video.to_bmp(5, 4, rgb))
    rows = {(r.video, r.frame_idx): r for r in video.stills(spark, str(tmp_path)).collect()}
    assert set(rows) == {("shot_", 0), ("shot_", 1), ("shot_", 2), ("alone", 0), ("bad", 0), ("other_", 0)}
    assert [rows["shot_", i].data[0] for i in range(3)] == [1, 2, 10] and bytes(rows["alone", 0].data) == rgb == bytes(rows["other_", 0].data)
    assert rows["bad", 0].data is None and rows["bad", 0].error


SCHEMA = """
[format]
magic = "IPX"
version = 2
endian = "big"
[header]
short_size = 5
extended_size = 7
extended_marker = 255
[frame_params]
size = 9
fields = [{name = "frame_id", offset = 0, type = "i32"}, {name = "gain", offset = 4, type = "u16", shift = 4}, {name = "mood", offset = 7, type = "i8", min_version = 2}]
[ctu_params]
size = 4
fields = [{name = "bias", offset = 0, type = "i8"}, {name = "level", offset = 1, type = "u8", shift = 5}, {name = "half", offset = 1, type = "i8", shift = 1, min_version = 1}, {name = "late", offset = 2, type = "u16", min_version = 2}]
"""


def test_side_data_by_a_schema(spark, tmp_path):
    """A version that the code doesn't know is read by its schema alone."""
    old = b"IPX\x00\x01" + struct.pack(">iHx", -2, 0x1234) + struct.pack(">b", -5)
    new = b"IPX\x02\xff\x01\x00" + struct.pack(">iHxbx", 8, 0xFFFF, -7) + b"".join(struct.pack(">bBH", -k % 128 - 64, 255 - k % 100, k) for k in range(256))
    (tmp_path / "a.bin").write_bytes(old + new)
    (tmp_path / "b.bin").write_bytes(new + b"IPX\x03\x00")
    (tmp_path / "c.bin").write_bytes(b"")
    rows = telemetry.sideband(spark, str(tmp_path), SCHEMA).orderBy("path", "seq", "ctu").collect()
    a = [r for r in rows if r.path.endswith("a.bin")]
    assert len(a) == 257 and [r.error for r in rows if not r.path.endswith("a.bin")] == [f"no side data at byte {len(new)}"]
    assert (a[0].frame_id, a[0].frame_gain, a[0].frame_mood, a[0].bias, a[0].level, a[0].half, a[0].late) == (-2, 0x123, None, -5, None, None, None)
    assert (a[1].frame_id, a[1].frame_gain, a[1].frame_mood) == (8, 0xFFF, -7) and [r.late for r in a[1:]] == list(range(256))
    assert (a[3].bias, a[3].level, a[3].half) == (-2 % 128 - 64, (255 - 2) >> 5, (255 - 2) >> 1)
    assert rows[0].__fields__ == ["path", "seq", "ctu", "frame_id", "frame_gain", "frame_mood", "bias", "level", "half", "late", "error"]
    for wrong in ("", "x = [", SCHEMA.replace("big", "little"), SCHEMA.replace("u16", "u24"), SCHEMA.replace('"level"', '"bias"')):
        with pytest.raises(ValueError):
            telemetry.SideLayout.from_toml(wrong)
