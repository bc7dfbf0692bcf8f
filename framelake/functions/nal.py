"""Annex-B byte streams as tables: units between start codes, their headers and access units; pages of hex."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import labels

START = re.compile(rb"\x00?\x00\x00\x01")
#: Units in one Arrow batch that goes back to the JVM.
BATCH = 50_000


def located(streams: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """One row a NAL unit: offset, start_code_len, size (without the code) and its first three bytes (null beyond its end).

    Each stream is scanned once for start codes; what lies before the first is no unit. Batches of units go back as they
    fill, so a stream of millions of units needs no more memory than its bytes. Null and empty streams have no units.
    """
    key = F.struct(*keys).alias("key")
    kind = streams.select(key).schema["key"].dataType.simpleString()
    names = ["key", "unit", "offset", "start_code_len", "size", "b0", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                stream = batch.column(1)[row].as_py() or b""
                found = np.array([m.span() for m in START.finditer(stream)], np.int64).reshape(-1, 2)
                ends = np.append(found[1:, 0], len(stream))
                raw = np.append(np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8))
                for at in range(0, len(found), BATCH):
                    start, head = found[at : at + BATCH].T
                    size = ends[at : at + BATCH] - head
                    first = [pa.array(raw[head + i].astype(np.int32), pa.int32(), mask=size <= i) for i in range(3)]
                    same = batch.column(0).take(pa.array(np.full(len(start), row)))
                    cols = [same, pa.array(np.arange(at, at + len(start))), pa.array(start), pa.array((head - start).astype(np.int32)), pa.array(size), *first]
                    yield pa.RecordBatch.from_arrays(cols, names)

    found = streams.select(key, F.col(data)).mapInArrow(run, f"key {kind}, unit long, offset long, start_code_len int, size long, b0 int, b1 int, b2 int")
    return found.select("key.*", *names[1:])


CODECS = ["hevc", "avc"]
#: File extensions of byte streams: fixed values, in the order in which they are tried.
EXTENSIONS = ["h265", "265", "hevc", "h264", "264", "avc", "bin"]
#: First units of a stream whose headers tell its codec.
SAMPLE = 64
FIELDS = ["nal_type", "temporal_id", "layer_id", "nal_ref_idc", "forbidden"]


def picture_starts(size: np.ndarray, b0: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether units start a picture, read as HEVC and as AVC: slices whose first bit behind the header is set."""
    return ((b0 >> 1 & 63) < 32) & (size > 2) & (b2 > 127), ((b0 & 31) > 0) & ((b0 & 31) < 6) & (size > 1) & (b1 > 127)


def described(codec: Column) -> dict[str, Column]:
    """Header fields of units with b0, b1, b2 (null beyond their end), read as the codec of the row. Units shorter than
    their header have zeros and hold no slices. An HEVC field that AVC hasn't is 0, and so the other way round.
    """
    hevc, whole = codec == "hevc", F.when(codec == "hevc", F.col("b1").isNotNull()).otherwise(F.col("b0").isNotNull())
    fields = {c: labels.nal_fields(F.col("b0"), F.col("b1"), c) for c in CODECS}
    pick = lambda name: F.when(whole, F.coalesce(F.when(hevc, fields["hevc"][name]).otherwise(fields["avc"][name]), F.lit(0))).otherwise(F.lit(0))
    kind = pick("nal_type")
    either = lambda rule: F.when(hevc, rule(kind, "hevc")).otherwise(rule(kind, "avc"))
    vcl = whole & either(labels.is_vcl)
    first = F.coalesce(F.when(hevc, F.col("b2")).otherwise(F.col("b1")), F.lit(0))
    out = {name: pick(name) for name in FIELDS}
    return out | {"temporal_id": F.greatest(out["temporal_id"], F.lit(0)), "is_vcl": vcl, "au_start": vcl & (first > 127), "opener": either(labels.opens_access_unit) & ~vcl}


def access_unit(starts: Column, is_vcl: Column, opener: Column) -> Column:
    """The access unit of a unit with so many starts up to it: slices belong to the last one started, what opens one to the next."""
    return F.greatest(F.lit(0).cast("long"), starts - F.when(~is_vcl & opener, F.lit(0)).otherwise(F.lit(1)))


def faults(codec: str) -> Column:
    """How badly a unit breaks the header rules of a codec: 2 for each thing forbidden or unspecified, 1 for what is reserved."""
    first, second = F.col("b0"), F.col("b1")
    kind = labels.nal_fields(first, second, codec)["nal_type"]
    if codec == "hevc":
        short, unspecified, reserved, rest = second.isNull(), kind >= 48, kind.between(41, 47), second.bitwiseAND(7) == 0
    else:
        short, unspecified, reserved, rest = first.isNull(), (kind == 0) | (kind >= 24), kind.isin(17, 18, 22, 23), F.lit(False)
    points = lambda rule, n: F.when(rule, F.lit(n)).otherwise(F.lit(0))
    return F.when(short, F.lit(2)).otherwise(points(first > 127, 2) + points(unspecified, 2) + points(reserved, 1) + points(rest, 2))


def codec_hint(path: Column) -> Column:
    """The codec that a file's extension names, or null."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return F.when(ext.isin(EXTENSIONS[:3]), "hevc").when(ext.isin(EXTENSIONS[3:6]), "avc")


def codec_by_faults(hevc: Column, avc: Column, hint: Column) -> Column:
    """The codec with fewer faults; of equals the one hinted at, else HEVC."""
    return F.when(hevc < avc, "hevc").when(hevc > avc, "avc").otherwise(F.coalesce(hint, F.lit("hevc")))


def units(streams: DataFrame, keys: list[str], data: str = "data", codec: str = "hevc") -> DataFrame:
    """Located units with their header's fields and access unit.

    An access unit starts with the first slice of a picture, which has the top bit after its header set; a unit that
    opens an access unit belongs to the picture that follows it. The first slice of all starts one in any case.
    """
    parsed = located(streams, keys, data).withColumns(described(F.lit(codec))).drop("b0", "b1", "b2")
    order = Window.partitionBy(*keys).orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    vcl_before = F.coalesce(F.count_if("is_vcl").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.col("au_start") | (F.col("is_vcl") & (F.col("vcl_before") == 0))
    running = F.sum(starts.cast("long")).over(order)
    return parsed.withColumn("vcl_before", vcl_before).withColumn("seen", running).withColumn("au_id", access_unit(F.col("seen"), F.col("is_vcl"), F.col("opener"))).drop("vcl_before", "seen")


def filtered(units_: DataFrame, kind: str = "all", contains: str = "", codec: str = "hevc") -> DataFrame:
    """Units of a kind (all, vcl, nonvcl) whose type's name contains a text, whatever its case."""
    named = units_.withColumn("name", labels.nal_name(F.col("nal_type"), codec)).where(F.lower("name").contains(contains.lower()))
    return named if kind == "all" else named.where(F.col("is_vcl") == (kind == "vcl"))


def detected(streams: DataFrame, keys: list[str], data: str = "data", hint: str | None = None) -> DataFrame:
    """Per stream with units: hevc_faults and avc_faults of its first units, the codec with fewer, n_units and n_vcl."""
    early = F.col("unit") < SAMPLE
    vcl = {c: described(F.lit(c))["is_vcl"] for c in CODECS}
    counted = located(streams, keys, data).groupBy(*keys).agg(*(F.sum(F.when(early, faults(c)).otherwise(F.lit(0))).alias(f"{c}_faults") for c in CODECS), *(F.count_if(vcl[c]).alias(f"{c}_vcl") for c in CODECS), F.count(F.lit(1)).alias("n_units"))
    codec = codec_by_faults(F.col("hevc_faults"), F.col("avc_faults"), F.lit(hint).cast("string"))
    return counted.withColumn("codec", codec).withColumn("n_vcl", F.when(F.col("codec") == "hevc", F.col("hevc_vcl")).otherwise(F.col("avc_vcl"))).select(*keys, "codec", "hevc_faults", "avc_faults", "n_units", "n_vcl")


def with_frames(units_: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Units with the frame of their access unit's number, an approximation: one row a unit, frame columns null without one."""
    return units_.join(frames.withColumnRenamed("decode_idx", "au_id"), [*keys, "au_id"], "left")


def hex_lines(streams: DataFrame, keys: list[str], data: str = "data", page: int | None = None, page_bytes: int = 4096, width: int = 16) -> DataFrame:
    """Bytes as lines: page, offset, hex pairs and the printable characters; of all pages, or of one."""
    last = lambda n, size: F.floor((n - 1) / size).cast("int")
    upto = lambda n, size: F.explode(F.when(n > 0, F.sequence(F.lit(0), last(n, size))).otherwise(F.expr("cast(array() as array<int>)")))
    pages = streams.select(*keys, F.col(data).alias("d"), upto(F.octet_length(data), page_bytes).alias("page"))
    if page is not None:
        pages = pages.where(F.col("page") == page)
    pages = pages.select(*keys, "page", F.substring("d", F.col("page") * page_bytes + 1, F.lit(page_bytes)).alias("d"))
    lines = pages.select(*keys, "page", "d", upto(F.octet_length("d"), width).alias("line"))
    part = F.substring(F.col("d"), F.col("line") * width + 1, F.lit(width))
    offset = F.col("page").cast("long") * page_bytes + F.col("line") * width
    return lines.select(*keys, F.col("page").cast("long").alias("page"), offset.alias("offset"), F.rtrim(F.regexp_replace(F.hex(part), "(..)", "$1 ")).alias("hex"), F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".").alias("ascii"))
