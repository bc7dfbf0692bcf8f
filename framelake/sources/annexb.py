"""Annex-B byte streams in files, read by byte ranges: a file of any size is split among tasks, and a task takes several small ones.

A task finds the start codes that begin in its range. A code is three or four bytes that show it wherever a scan starts,
but for a zero before the first byte, so a range is read from one byte before it; the last code's unit ends at the next code
or the file's end, which is looked for behind the range. Units are therefore whole and found once however a file is cut.

Numbers of units and access units run over a file. Ranges give their own counts, one row a range adds up to what lies before
each, and units get that by a join with these few rows; no window and no shuffle goes over the units of a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import nal
from .stores import listed, opened

BYTES_PER_PARTITION = 64 << 20
#: Bytes of small files that one task reads one after another, so that many don't make as many tasks.
BYTES_A_TASK = 4 << 20
#: Bytes that are read at a time where the end of a unit is looked for.
AHEAD = 1 << 20
ENDINGS = tuple(f".{e}" for e in nal.EXTENSIONS)
SCHEMA = "path string, part int, place int, offset long, start_code_len int, size long, b0 int, b1 int, b2 int, hevc_starts long, avc_starts long"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


@dataclass
class Range(InputPartition):
    path: str
    part: int
    low: int
    high: int
    total: int
    #: Whole small files that the same task reads after this one.
    others: list[Range] = field(default_factory=list)


def packed(ranges: list[Range], most: int) -> list[Range]:
    """Ranges with whole files that follow each other put into one, as far as these have no more than `most` bytes together."""
    out, size = [], most
    for r in ranges:
        if r.high - r.low < r.total:
            out.append(r)
            size = most
        elif size + r.total > most:
            out.append(r)
            size = r.total
        else:
            out[-1].others.append(r)
            size += r.total
    return out


def next_code(f, at: int, total: int) -> int:
    """Where the first start code from `at` on begins, or the end of the file."""
    while at < total:
        f.seek(at)
        data = f.read(min(AHEAD, total - at))
        if found := nal.START.search(data):
            return at + found.start()
        if at + len(data) >= total:
            break
        at += len(data) - 3  # a code that is cut off here begins in the last three bytes
    return total


def codes_of(f, part: Range) -> tuple[np.ndarray, ...]:
    """offset, code length, unit size and the next three bytes of the codes that begin in a range."""
    base = max(0, part.low - 1)
    f.seek(base)
    data = f.read(min(part.total, part.high + 6) - base)
    found = np.array([m.span() for m in nal.START.finditer(data)], np.int64).reshape(-1, 2) + base
    own = (found[:, 0] >= part.low) & (found[:, 0] < part.high)
    start, head = found[own].T
    if not len(start):
        return (start,) * 6
    behind = found[found[:, 0] >= part.high, 0]
    end = int(behind[0]) if len(behind) else next_code(f, max(int(head[-1]), base + len(data) - 3), part.total)
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))
    return start, head - start, np.append(start[1:], end) - head, *(raw[head - base + i].astype(np.int32) for i in range(3))


class AnnexB(DataSource):
    """Options: path (a file, a folder or a pattern), bytes_per_partition. One row a unit; see `units`."""

    @classmethod
    def name(cls) -> str:
        return "annexb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CodeReader(self.options["path"], int(self.options.get("bytes_per_partition", BYTES_PER_PARTITION)))


class CodeReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, max(1, step)

    def partitions(self) -> list[InputPartition]:
        found = [Range(path, k, low, min(low + self.step, total), total) for path, total in listed(self.path, ENDINGS) for k, low in enumerate(range(0, total, self.step))]
        return packed(found, BYTES_A_TASK) or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for one in (partition, *partition.others):
            if one.total:
                yield from self.read_range(one)

    def read_range(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            start, code, size, *head = codes_of(f, partition)
        counts = [np.cumsum(s) for s in nal.picture_starts(size, *head)]
        for at in range(0, len(start), nal.BATCH):
            cut = slice(at, at + nal.BATCH)
            n = len(start[cut])
            bytes_ = [pa.array(head[i][cut], pa.int32(), mask=size[cut] <= i) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * n), pa.array([partition.part] * n, pa.int32()), pa.array(np.arange(at, at + n), pa.int32()), pa.array(start[cut]), pa.array(code[cut].astype(np.int32)), pa.array(size[cut]), *bytes_, *(pa.array(c[cut]) for c in counts)], NAMES
            )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AnnexB)


def read(spark: SparkSession, path: str, bytes_per_partition: int = BYTES_PER_PARTITION) -> DataFrame:
    """The start codes of files; `units` and `streams` take them."""
    register(spark)
    return spark.read.format("annexb").options(path=path, bytes_per_partition=bytes_per_partition).load()


def ranges(codes: DataFrame) -> DataFrame:
    """One row a range with units: what lies before it in its file (units, picture starts), and of the file: units, bytes from
    the first code on, header faults of the first units, slices, and its first slice with whether that starts a picture.
    """
    parts = {c: nal.described(F.lit(c)) for c in nal.CODECS}
    first = lambda c: F.min(F.when(parts[c]["is_vcl"], F.struct("offset", parts[c]["au_start"].alias("starts"))))
    faults = F.struct("place", *(nal.faults(c).alias(c) for c in nal.CODECS))
    per = codes.groupBy("path", "part").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("place") < nal.SAMPLE, faults)).alias("faults"), F.sum(F.col("size") + F.col("start_code_len")).alias("bytes"),
        *(F.max(f"{c}_starts").alias(f"{c}_starts") for c in nal.CODECS), *(first(c).alias(f"{c}_first") for c in nal.CODECS), *(F.count_if(parts[c]["is_vcl"]).alias(f"{c}_vcl") for c in nal.CODECS),
    )
    before, whole = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "hevc_starts", "avc_starts")}
    placed = per.select("*", *(v.alias(k) for k, v in sums.items()))
    early = F.filter("faults", lambda f: F.col("n_before") + f["place"] < nal.SAMPLE)
    bad = lambda c: F.sum(F.aggregate(early, F.lit(0), lambda s, f: s + f[c])).over(whole)
    totals = {f"{c}_faults": bad(c) for c in nal.CODECS} | {f"{c}_first": F.min(f"{c}_first").over(whole) for c in nal.CODECS} | {f"{c}_vcl": F.sum(f"{c}_vcl").over(whole) for c in nal.CODECS}
    return placed.withColumns(totals | {"n_units": F.sum("n").over(whole), "bytes": F.sum("bytes").over(whole)}).drop("faults", "n")


def codec_of(known: DataFrame, codec: str | None) -> Column:
    return F.lit(codec) if codec else nal.codec_by_faults(F.col("hevc_faults"), F.col("avc_faults"), nal.codec_hint(F.col("path")))


def streams(codes: DataFrame, codec: str | None = None) -> DataFrame:
    """One row a file with units: path, codec (found by header faults where none is given), faults by codec, n_units, n_vcl, bytes."""
    known = ranges(codes)
    picked = known.withColumn("codec", codec_of(known, codec))
    vcl = F.when(F.col("codec") == "hevc", F.col("hevc_vcl")).otherwise(F.col("avc_vcl"))
    return picked.groupBy("path").agg(*(F.first(c).alias(c) for c in ("codec", "hevc_faults", "avc_faults", "n_units")), F.first(vcl).alias("n_vcl"), F.first("bytes").alias("bytes"))


def units(codes: DataFrame, codec: str | None = None) -> DataFrame:
    """Units with their number in the file, header fields, whether they hold slices or start a picture, and access unit."""
    known = ranges(codes)
    picked = known.select("path", "part", "n_before", codec_of(known, codec).alias("codec"), *(f"{c}_{x}" for c in nal.CODECS for x in ("first",)), F.col("hevc_starts_before"), F.col("avc_starts_before"))
    by = lambda name: F.when(F.col("codec") == "hevc", F.col(name.format("hevc"))).otherwise(F.col(name.format("avc")))
    joined = codes.join(picked, ["path", "part"])
    described = joined.withColumns(nal.described(F.col("codec")))
    first = by("{}_first")
    # the first slice opens access unit 0 even if it doesn't start a picture
    lifted = (~F.coalesce(first["starts"], F.lit(True)) & (F.col("offset") >= first["offset"])).cast("long")
    seen = by("{}_starts_before") + by("{}_starts") + F.coalesce(lifted, F.lit(0))
    numbered = described.withColumns({"unit": F.col("n_before") + F.col("place"), "au_id": nal.access_unit(seen, F.col("is_vcl"), F.col("opener"))})
    return numbered.select("path", "unit", "offset", "start_code_len", "size", *nal.FIELDS, "is_vcl", "au_start", "opener", "au_id", "codec")
