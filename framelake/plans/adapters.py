"""Relations of the engine's data model derived from general-purpose tables, so that every operator can be queried on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_frames(spark: SparkSession, sf_dir: str) -> int:
    """The number of pixel frames, the last one padded."""
    return -(-table(spark, sf_dir, "embeddings").count() // SIDE)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 64 frames: each vector is a row of samples, 64 vectors a frame, black rows at the end of the last; three frames a video."""
    vectors = table(spark, sf_dir, "embeddings")
    count = vectors.count()
    padding = spark.range(count, -(-count // SIDE) * SIDE).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(-1.0).cast("float"), SIDE).alias("embedding"))
    rows = vectors.select("vec_id", "embedding").union(padding).select("vec_id", F.posexplode("embedding").alias("x", "v"))
    r = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("v").cast("double") * 128 + 128))).cast("int")
    frame = F.floor(F.col("vec_id") / SIDE).cast("int")
    px = rows.select(F.floor(frame / 3).cast("int").alias("video"), frame.alias("frame"), "x", (F.col("vec_id") % SIDE).cast("int").alias("y"), r.alias("r"))
    return px.withColumn("g", (F.col("r") * 7 + F.col("x") * 3) % 256).withColumn("b", (F.col("r") * 3 + F.col("y") * 5) % 256)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as pixels(), as bytes: video, frame_idx, width, height, rgb. A vector is a row of hex text, 64 rows a frame
    are brought together, and rows that the last frame lacks are black; nothing is counted and no pixel is a row.
    """
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    bounded = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 128 + 128))).cast("int")
    sample = lambda r, x, y: F.concat(two(r), two((r * 7 + x * 3) % 256), two((r * 3 + y * 5) % 256))
    line = lambda values, y: F.array_join(F.transform(values, lambda v, x: sample(bounded(v), x, y)), "")
    y = (F.col("vec_id") % SIDE).cast("int")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / SIDE).alias("frame_idx"), y.alias("y"), line(F.col("embedding"), y).alias("line"))
    per = rows.groupBy("frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("lines"))
    black = F.array_repeat(F.lit(-1.0), SIDE)
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.coalesce(F.try_element_at("lines", k), line(black, k))), "")
    return per.select(F.floor(F.col("frame_idx") / 3).alias("video"), "frame_idx", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.unhex(whole).alias("rgb"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.floor(F.col("o_orderkey") / 4096).alias("video"), F.col("o_orderkey").alias("decode_idx"), (F.col("o_custkey") % 8).alias("poc"),
        F.when(F.col("o_orderkey") % 16 == 0, "IDR").when(F.col("o_orderpriority").startswith("1"), "P").otherwise("B").alias("frame_type"),
        (F.col("o_orderstatus") != "P").alias("output"), F.when(F.col("o_orderstatus") != "F", F.floor("o_totalprice")).alias("slice_bits"),
        F.when(F.col("o_orderstatus") == "O", F.floor("o_totalprice")).alias("data_bits"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    side = F.lit(8) * F.pow(F.lit(2), F.col("l_linenumber") % 4)
    mode = F.when(F.col("l_returnflag") == "A", "intra").when(F.col("l_returnflag") == "N", "inter").otherwise("skip")
    return li.select(
        F.floor(F.col("l_orderkey") / 4096).alias("video"), F.col("l_orderkey").alias("decode_idx"), F.col("l_linenumber").cast("long").alias("block"),
        (F.col("l_partkey") % 8 * 8).alias("x"), (F.col("l_suppkey") % 8 * 8).alias("y"), side.cast("long").alias("w"), side.cast("long").alias("h"),
        F.col("l_quantity").cast("long").alias("qp"), F.floor("l_extendedprice").alias("bits"), mode.alias("mode"),
        F.when(F.col("l_returnflag") != "A", F.col("l_partkey") % 65 - 32).alias("mvx"), F.when(F.col("l_returnflag") != "A", F.col("l_suppkey") % 33 - 16).alias("mvy"),
        F.when(F.col("l_linestatus") == "O", "L0").otherwise("L1").alias("list"),
    )


def byte_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of Annex-B streams as rows (file, seq, data): a stream a video, a unit a line item, with bytes of two and more."""
    li = table(spark, sf_dir, "lineitem")
    video = F.floor(F.col("l_orderkey") / 4096)
    order = Window.partitionBy(video).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    head = F.concat(two(2 + F.col("l_partkey") % 250), two(2 + F.col("l_suppkey") % 200), two(2 + F.col("l_quantity").cast("long") * 5 % 250), F.lit("4142434445"))
    code = F.when(F.col("l_suppkey") % 2 == 0, "000001").otherwise("00000001")
    size = ((F.col("l_linenumber") * 3 + F.col("l_partkey")) % 8).cast("int")
    return li.select(F.concat(video.cast("string"), F.lit(".bin")).alias("file"), F.row_number().over(order).cast("long").alias("seq"), F.unhex(F.concat(code, F.substring(head, F.lit(1), size * 2))).alias("data"))


def meta_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta data as JSON (doc, meta): a document an order, a frame a line item, one slice each. Some numbers are text, some lists are
    numbers, and one document of eleven is cut off.
    """
    li = table(spark, sf_dir, "lineitem")
    # numbers are shuffled, and text is made of them afterwards, by concat: a formatter reads its pattern anew for each row
    whole = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    def frame(x: Column) -> Column:
        entry = lambda k: whole('{"poc": ', x["l_suppkey"] % 32 + k, ', "long_term": ', F.when(x["l_quantity"] > 25, "true").otherwise("false"), f', "label": "r{k}"}}')
        entries = F.when(x["l_linenumber"] % 3 == 0, "").when(x["l_linenumber"] % 3 == 1, entry(0)).otherwise(whole(entry(0), ",", entry(1)))
        index = F.when(x["l_partkey"] % 7 == 0, whole('"', x["l_partkey"], '"')).otherwise(x["l_partkey"].cast("string"))
        header = whole('[{"nal_unit_name": "', x["l_returnflag"], '", "slice_type_label": "', x["l_linestatus"], '", "nal_index": ', index, ', "ref_list', x["l_partkey"] % 2, '": [', entries, "]}]")
        return whole('{"slice_headers": ', F.when(x["l_suppkey"] % 13 == 0, "5").otherwise(header), "}")

    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    docs = li.groupBy(F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_list(order)).alias("f"))
    doc, n = F.col("doc"), F.size("f")
    sets = whole('[{"kind": "SPS", "id": ', doc % 16, ', "fields": {"z_count": ', n, ', "Status": "s', n, '", "none": null, "sub": [1]}}, 3, {"kind": ', doc, "}]")
    # a document that is cut off lacks its last brace
    return docs.select("doc", whole('{"parameter_sets": ', sets, ', "frames_meta": [', F.array_join(F.transform("f", frame), ","), "]", F.when(doc % 11 == 0, "").otherwise("}")).alias("meta"))


def side_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side rows of frames as JSON (decode_idx, aux): a frame an order."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "not_applied").when(F.col("o_orderstatus") == "O", "band").otherwise("")
    row = F.format_string('{"sao": [{"x": %d, "type_y": "%s", "merge_up": %s}, 7]}', (F.col("o_custkey") % 8 * 64).cast("long"), kind, F.when(F.col("o_custkey") % 2 == 0, "true").otherwise("1"))
    return o.select(F.col("o_orderkey").alias("decode_idx"), F.when(F.col("o_custkey") % 17 == 0, "{").otherwise(row).alias("aux"))


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.floor(F.col("l_orderkey") / 4096).alias("video"), F.col("l_orderkey").alias("decode_idx"), F.col("l_linenumber").cast("long").alias("block"), (F.col("l_linestatus") == "O").alias("has_abs_sum"), (F.col("l_returnflag") != "N").alias("has_nonzero"), (F.col("l_partkey") % 50 - 5).alias("abs_sum"), (F.col("l_suppkey") % 17).alias("nonzero"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag <> 'A'").select(F.floor(F.col("l_orderkey") / 4096).alias("video"), F.col("l_orderkey").alias("decode_idx"), (F.col("l_partkey") % 8).alias("ref_poc"), F.when(F.col("l_linestatus") == "O", "L0").otherwise("L1").alias("list"))


def unit_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of prediction units: of every third block number, some without a vector."""
    return blocks(spark, sf_dir).where("block % 3 = 0").withColumn("mvy", F.when(F.col("mvy") % 2 == 0, F.col("mvy"))).select("video", "decode_idx", "block", "mvx", "mvy", "list")


def syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("frame"), F.col("event_type").alias("name"), (F.col("user_id") % 16).alias("ctx"), (F.col("event_id") % 2).alias("bin"), F.coalesce(F.floor("value"), F.lit(0)).alias("bits"), "user_id", "event_id")
