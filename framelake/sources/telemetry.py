"""Decoder telemetry containers (data source "catb") and camera side data ("sideband").

A container is a header with a directory of sections of fixed-size records. Option `section` picks the table: frames,
blocks, syntax, cabac, transforms, refs, coeffs, aux or meta. Child rows come with the key of their frame and block, so
tables join by equality; a partition is a range of frames. Counts are held against the section's size before anything
is allocated. Negative numbers that mean "absent", and fields whose presence bit is clear, are null.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .video import opened

MAGIC, VERSION, HEADER = b"CATB0001", 4, 176
SECTIONS = ["strings", "meta", "frames", "blocks", "syntax", "cabac", "transforms", "refs", "coeffs", "aux"]
# Layouts of the records, little-endian: fixed values.
FRAME = np.dtype({"names": ["idx", "poc", "type", "output", "vps", "sps", "pps", "slice_bits", "header_bits", "data_bits", "block_off", "block_n", "aux_off", "aux_n"], "formats": ["<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i8", "<i8", "<i8", "<u8", "<i4", "<u8", "<i8"], "offsets": [0, 4, 8, 12, 16, 20, 24, 28, 36, 44, 52, 60, 64, 72], "itemsize": 80})
BLOCK = np.dtype({"names": ["x", "y", "w", "h", "ctu", "qp", "partition", "mode", "bits", "bit_offset", "exactness", "syntax_off", "syntax_n", "cabac_off", "cabac_n", "transforms_off", "transforms_n", "refs_off", "refs_n", "mv_flags", "mvp", "mvd", "mv", "reference", "list", "label", "list_index", "ref_poc", "ref_frame"], "formats": ["<i4", "<i4", "<i4", "<i4", "<i8", "<i4", "<i4", "<i4", "<i8", "<i8", "<i4", "<u8", "<i4", "<u8", "<i8", "<u8", "<i4", "<u8", "<i4", "<u4", "(2,)<i4", "(2,)<i4", "(2,)<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4"], "offsets": [0, 4, 8, 12, 16, 24, 28, 32, 36, 44, 52, 56, 64, 68, 76, 80, 88, 92, 100, 104, 108, 116, 124, 132, 136, 140, 144, 148, 152], "itemsize": 156})
SYNTAX = np.dtype([("name", "<i4"), ("value", "<i4"), ("coding", "<i4"), ("bit_offset", "<i8"), ("bits", "<i8")])
CABAC = np.dtype([("name", "<i4"), ("ctx", "<i4"), ("bin", "<i4"), ("bit_offset", "<i8"), ("bits", "<i8")])
TRANSFORM = np.dtype({"names": ["x", "y", "w", "h", "depth", "type", "cbf", "bits", "bit_offset", "nonzero", "last_x", "last_y", "abs_sum", "flags", "count", "group_w", "group_h", "group_count", "component", "level_kind", "coeff_off"], "formats": ["<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<u4", "<i8", "<i8", "<i4", "<i4", "<i4", "<i8", "<u4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<u8"], "offsets": [0, 4, 8, 12, 16, 20, 24, 28, 36, 44, 48, 52, 60, 68, 72, 76, 80, 84, 88, 92, 96], "itemsize": 104})
REF = np.dtype({"names": ["list", "list_index", "ref_poc", "label", "pu_x", "pu_y", "pu_w", "pu_h", "flags", "mvp", "mvd", "mv", "ref_frame", "pu_part"], "formats": ["<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<u4", "(2,)<i4", "(2,)<i4", "(2,)<i4", "<i4", "<i4"], "offsets": [0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 44, 52, 60, 64], "itemsize": 68})
RECORDS = {"frames": FRAME, "blocks": BLOCK, "syntax": SYNTAX, "cabac": CABAC, "transforms": TRANSFORM, "refs": REF}
#: Fields that are ids of strings, and those whose negative values mean absent.
TEXTS = {"frames": ["type"], "blocks": ["partition", "mode", "reference", "list", "label"], "syntax": ["name", "value", "coding"], "cabac": ["name"], "transforms": ["type", "component", "level_kind"], "refs": ["list", "label"]}
ABSENT = {"frames": ["vps", "sps", "pps", "slice_bits", "header_bits", "data_bits"], "blocks": [], "syntax": [], "cabac": [], "transforms": [], "refs": ["list_index"]}
#: Presence bits: which bit of which field each nullable field hangs on. Fixed values.
PRESENT = {
    "blocks": ("mv_flags", {"mvp": 1, "mvd": 2, "mv": 4, "list_index": 8, "ref_poc": 16, "ref_frame": 32}),
    "refs": ("flags", {"mvp": 1, "mvd": 2, "mv": 4, "ref_frame": 8, "pu_part": 64}),
    "transforms": ("flags", {"nonzero": 4, "last_x": 8, "last_y": 16, "abs_sum": 32}),
}
#: The bit that tells whether a reference is known to be long-term or not, and the bit that says which. Fixed values.
LONG_TERM = {"blocks": (64, 128), "refs": (16, 32)}
HAS_DETAIL = 1
CHILDREN = ["syntax", "cabac", "transforms", "refs"]


class Container:
    """One open container: its directory, strings and frame records."""

    def __init__(self, path: str):
        self.file = opened(path)
        head = self.file.read(HEADER)
        if len(head) < HEADER or head[:8] != MAGIC:
            raise ValueError(f"{path} is no telemetry container")
        if int.from_bytes(head[8:12], "little") != VERSION:
            raise ValueError(f"{path} has version {int.from_bytes(head[8:12], 'little')}, not {VERSION}")
        self.count, total = int.from_bytes(head[12:16], "little"), self.file.size()
        places = np.frombuffer(head[16:], "<u8").reshape(10, 2)
        self.at = {name: (int(o), int(n)) for name, (o, n) in zip(SECTIONS, places)}
        for name, (offset, size) in self.at.items():
            if offset + size > total:
                raise ValueError(f"section {name} of {path} lies beyond its end")

    def bytes(self, section: str, start: int = 0, size: int | None = None) -> bytes:
        offset, whole = self.at[section]
        size = whole - start if size is None else size
        if start < 0 or size < 0 or start + size > whole:
            raise ValueError(f"{size} bytes at {start} lie beyond section {section}")
        self.file.seek(offset + start)
        return self.file.read(size)

    def records(self, section: str, first: int, count: int) -> np.ndarray:
        """Records from a place in bytes, as many as fit a frame or block; a negative count is none."""
        kind = RECORDS[section]
        return np.frombuffer(self.bytes(section, first, max(0, count) * kind.itemsize), kind)

    def strings(self) -> list[str]:
        raw = self.bytes("strings")
        out, at = [], 4
        for _ in range(int.from_bytes(raw[:4], "little") if raw else 0):
            n = int.from_bytes(raw[at : at + 4], "little")
            out.append(raw[at + 4 : at + 4 + n].decode("utf-8", "replace"))
            at += 4 + n
        return out


def columns(section: str, rows: np.ndarray, texts: list[str]) -> tuple[list[pa.Array], list[str]]:
    flag, bits = PRESENT.get(section, ("", {}))
    out, names = [], []
    for name in rows.dtype.names:
        if name == flag or name.endswith("_off") or name in ("syntax_n", "cabac_n", "transforms_n", "refs_n", "aux_n"):
            continue
        v = rows[name]
        gone = (rows[flag] & bits[name]) == 0 if name in bits else v < 0 if name in ABSENT[section] else None
        if name in TEXTS[section]:
            out.append(pa.array([texts[i] if 0 < i < len(texts) else "" for i in v.tolist()], pa.string()))
        elif v.ndim == 2:
            for i, axis in enumerate("xy"):
                out.append(pa.array(v[:, i].astype(np.int64), pa.int64(), mask=gone))
                names.append(f"{name}_{axis}")
            continue
        else:
            out.append(pa.array(v.astype(np.int64), pa.int64(), mask=gone))
        names.append(name)
    if section in LONG_TERM:
        known, value = LONG_TERM[section]
        out.append(pa.array(((rows[flag] & value) != 0).astype(np.int64), pa.int64(), mask=(rows[flag] & known) == 0))
        names.append("long_term")
    return out, names


def table_schema(section: str) -> str:
    if section == "meta":
        return "meta string"
    if section == "aux":
        return "decode_idx long, aux string"
    if section == "coeffs":
        return "decode_idx long, block_idx long, tx_idx long, levels array<int>, scan array<int>, group_flags array<int>"
    cols, names = columns(section, np.zeros(0, RECORDS[section]), [])
    keys = ["decode_idx long"] + (["block_idx long"] if section != "frames" else []) + (["child_idx long"] if section in CHILDREN else [])
    return ", ".join(keys + [f"`{n}` {'string' if pa.types.is_string(c.type) else 'long'}" for c, n in zip(cols, names)])


@dataclass
class FrameRange(InputPartition):
    first: int
    last: int


class ContainerReader(DataSourceReader):
    FRAMES = 256

    def __init__(self, path: str, section: str):
        self.path, self.section = path, section
        self.count = Container(path).count

    def partitions(self) -> list[InputPartition]:
        if self.section == "meta":
            return [FrameRange(0, 0)]
        return [FrameRange(i, min(i + self.FRAMES, self.count)) for i in range(0, self.count, self.FRAMES)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        c, section = Container(self.path), self.section
        if section == "meta":
            yield pa.RecordBatch.from_arrays([pa.array([c.bytes("meta").decode("utf-8", "replace")])], ["meta"])
            return
        texts = c.strings()
        frames = c.records("frames", partition.first * FRAME.itemsize, partition.last - partition.first)
        long = lambda v: pa.array(np.asarray(v, np.int64), pa.int64())
        if section == "frames":
            cols, names = columns(section, frames, texts)
            yield pa.RecordBatch.from_arrays([long(np.arange(partition.first, partition.last)), *cols], ["decode_idx", *names])
            return
        for i, frame in enumerate(frames, partition.first):
            if section == "aux":
                if frame["aux_n"] > 0:
                    yield pa.RecordBatch.from_arrays([long([i]), pa.array([c.bytes("aux", int(frame["aux_off"]), int(frame["aux_n"])).decode("utf-8", "replace")])], ["decode_idx", "aux"])
                continue
            blocks = c.records("blocks", int(frame["block_off"]), int(frame["block_n"]))
            if section == "blocks":
                cols, names = columns(section, blocks, texts)
                yield pa.RecordBatch.from_arrays([long(np.full(len(blocks), i)), long(np.arange(len(blocks))), *cols], ["decode_idx", "block_idx", *names])
                continue
            of = "transforms" if section == "coeffs" else section
            for b, block in enumerate(blocks):
                rows = c.records(of, int(block[f"{of}_off"]), int(block[f"{of}_n"]))
                if section == "coeffs":
                    yield from self.coeffs(c, i, b, rows)
                elif len(rows):
                    cols, names = columns(section, rows, texts)
                    yield pa.RecordBatch.from_arrays([long(np.full(len(rows), i)), long(np.full(len(rows), b)), long(np.arange(len(rows))), *cols], ["decode_idx", "block_idx", "child_idx", *names])

    @staticmethod
    def coeffs(c: Container, frame: int, block: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Levels, scan and group flags of each transform that has them: three arrays one after the other."""
        for t, tx in enumerate(rows):
            if tx["flags"] & HAS_DETAIL:
                n, g = max(0, int(tx["count"])), max(0, int(tx["group_count"]))
                v = np.frombuffer(c.bytes("coeffs", int(tx["coeff_off"]) * 4, (2 * n + g) * 4), "<i4")
                parts = [pa.array([p.tolist()], pa.list_(pa.int32())) for p in (v[:n], v[n : 2 * n], v[2 * n :])]
                yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in (frame, block, t)), *parts], ["decode_idx", "block_idx", "tx_idx", "levels", "scan", "group_flags"])


class Catb(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catb"

    def schema(self) -> str:
        return table_schema(self.options.get("section", "frames"))

    def reader(self, schema) -> DataSourceReader:
        return ContainerReader(self.options["path"], self.options.get("section", "frames"))


#: Side data, big-endian. Fields: name, offset, type, bits to drop, first version. Fixed values.
SIDE_FRAME = [
    ("frame_id", 0, "i4", 0, 0), ("valid_fields_mask", 4, "u2", 0, 0), ("scene_class", 6, "u1", 4, 0), ("noise_class", 7, "u1", 5, 0), ("motion_class", 8, "u1", 5, 0),
    ("denoise_strength", 9, "u1", 3, 0), ("sharpen_strength", 10, "u1", 3, 0), ("scene_flags", 11, "u1", 0, 0), ("frame_qp_bias", 12, "i1", 0, 0),
    ("frame_chroma_cb_bias", 13, "i1", 0, 0), ("frame_chroma_cr_bias", 14, "i1", 0, 0), ("frame_lambda_scale_q8", 15, "u2", 0, 0), ("global_confidence", 17, "u1", 0, 0),
    ("iso_class", 20, "u1", 0, 1), ("ae_state", 21, "u1", 0, 1), ("histogram_shape", 22, "u1", 0, 1), ("dynamic_range_q8", 23, "u1", 0, 1), ("ca_severity_q8", 24, "u1", 0, 1),
    ("distortion_k1_q8", 25, "i1", 0, 1), ("scene_change_score", 26, "u1", 0, 1),
]
SIDE_CTU = [
    ("activity", 0, "u1", 2, 0), ("flatness", 1, "u1", 2, 0), ("edge_density", 2, "u1", 2, 0), ("noise", 3, "u1", 4, 0), ("saliency", 4, "u1", 2, 0), ("chroma_importance", 5, "u1", 3, 0),
    ("confidence", 6, "u1", 4, 0), ("ctu_flags", 7, "u1", 5, 0), ("qp_delta", 8, "i1", 0, 0), ("chroma_cb_delta", 9, "i1", 0, 0), ("chroma_cr_delta", 10, "i1", 0, 0),
    ("lambda_scale_q8", 11, "u2", 0, 0), ("rc_importance_weight", 13, "u1", 0, 0), ("sao_prior", 14, "i1", 0, 0), ("temporal_stability", 15, "u1", 0, 0),
    ("noise_sigma_q8", 16, "u1", 0, 1), ("noise_confidence", 17, "u1", 0, 1), ("clip_risk", 18, "u1", 0, 1), ("structure_class", 19, "u1", 0, 1), ("dof_sharpness", 20, "u1", 0, 1),
    ("vignetting_gain_q8", 21, "u1", 0, 1), ("denoise_confidence", 22, "u1", 0, 1),
]
#: What a field may be: fixed values.
KINDS = {"u8": "u1", "i8": "i1", "u16": "u2", "i32": "i4"}


@dataclass(frozen=True)
class SideLayout:
    """How side data lie in bytes, big-endian: a header (magic, version, number of units), then a frame's fields, then its units'.

    Fields are (name, offset, type, shift, first version that has it). A section of an older version ends where the first
    field of a newer one would begin.
    """

    magic: bytes
    version: int
    short: int
    extended: int
    marker: int
    frame_size: int
    frame_fields: tuple
    unit_size: int
    unit_fields: tuple

    @staticmethod
    def from_toml(text: str) -> SideLayout:
        """A layout from tables format, header, frame_params and ctu_params; a ValueError for what can't be read by it."""
        try:
            found = tomllib.loads(text)
            form, head = found["format"], found["header"]
            if form.get("endian", "big") != "big":
                raise ValueError(f"byte order {form['endian']} isn't read, only big")
            sections = []
            for name in ("frame_params", "ctu_params"):
                fields = tuple((f["name"], int(f["offset"]), KINDS[f["type"]], int(f.get("shift", 0)), int(f.get("min_version", 0))) for f in found[name]["fields"])
                if len({f[0] for f in fields}) < len(fields):
                    raise ValueError(f"a field of {name} is named twice")
                sections += [int(found[name]["size"]), fields]
            return SideLayout(form["magic"].encode(), int(form["version"]), int(head["short_size"]), int(head["extended_size"]), int(head["extended_marker"]), *sections)
        except (KeyError, TypeError, tomllib.TOMLDecodeError) as e:
            raise ValueError(f"not a schema of side data: {e!r}") from e

    def size(self, units: bool, version: int) -> int:
        fields, whole = (self.unit_fields, self.unit_size) if units else (self.frame_fields, self.frame_size)
        return min((f[1] for f in fields if f[4] > version), default=whole)

    def records(self, units: bool, version: int) -> tuple[np.dtype, dict[str, int]]:
        """The layout of a record of a version, as unsigned numbers where they are shifted, and the shifts."""
        size = self.size(units, version)
        known = [f for f in (self.unit_fields if units else self.frame_fields) if f[4] <= version and f[1] + int(f[2][1]) <= size]
        kinds = [">" + (f[2].replace("i1", "u1") if f[3] else f[2]) for f in known]
        return np.dtype({"names": [f[0] for f in known], "formats": kinds, "offsets": [f[1] for f in known], "itemsize": size}), {f[0]: (f[3], f[2]) for f in known}

    def columns(self) -> tuple[list[str], list[str]]:
        """Names of the frame's columns, with frame_ before them, and of the units'."""
        return [n if n.startswith("frame_") else f"frame_{n}" for n, *_ in self.frame_fields], [n for n, *_ in self.unit_fields]

    def table(self) -> str:
        frame, unit = self.columns()
        return ", ".join(["path string, seq long, ctu long", *(f"`{n}` long" for n in (*frame, *unit)), "error string"])


def values(records: np.ndarray, shifts: dict, names: list[str]) -> list[np.ndarray | None]:
    """The fields as numbers, shifted; None for those that the version lacks."""
    out = []
    for name in names:
        if name not in shifts:
            out.append(None)
            continue
        shift, kind = shifts[name]
        v = records[name].astype(np.int64)
        if shift and kind != "i4":
            v = v >> shift
            v = v.astype(np.int8).astype(np.int64) if kind == "i1" else v
        out.append(v)
    return out


#: The two known versions.
SIDE = SideLayout(b"IP", 1, 4, 6, 255, 28, tuple(SIDE_FRAME), 24, tuple(SIDE_CTU))


def side_frames(data: bytes, layout: SideLayout = SIDE) -> Iterator[tuple[list, list, int]]:
    """Each frame's values, those of its units by field, and their number; anything malformed is a ValueError."""
    at = 0
    made: dict[int, tuple] = {}
    while at < len(data):
        m = len(layout.magic)
        if data[at : at + m] != layout.magic or at + layout.short > len(data) or data[at + m] > layout.version:
            raise ValueError(f"no side data at byte {at}")
        version, n = data[at + m], data[at + layout.short - 1]
        if n == layout.marker:
            n = int.from_bytes(data[at + layout.short : at + layout.extended], "big")
            at += layout.extended
        else:
            at += layout.short
        if version not in made:
            made[version] = layout.records(False, version), layout.records(True, version)
        (head, head_shifts), (unit, unit_shifts) = made[version]
        if at + head.itemsize + n * unit.itemsize > len(data):
            raise ValueError(f"side data end early at byte {at}")
        frame = values(np.frombuffer(data, head, 1, at), head_shifts, [f[0] for f in layout.frame_fields])
        units = values(np.frombuffer(data, unit, n, at + head.itemsize), unit_shifts, [f[0] for f in layout.unit_fields])
        yield [None if v is None else int(v[0]) for v in frame], units, n
        at += head.itemsize + n * unit.itemsize


def sideband(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Side data files, one row a unit: path, seq, ctu (null for a frame without units), the frame's and the unit's fields.

    schema: the text of a TOML schema, which gives the layout of bytes for each version and the table's columns; without one
    the two known versions are read. A malformed file gives one row with its error and nothing else.
    """
    layout = SideLayout.from_toml(schema) if schema else SIDE
    listed = spark.read.format("binaryFile").load(path).select("path", "content")
    frame_names, unit_names = layout.columns()
    names = ["path", "seq", "ctu", *frame_names, *unit_names, "error"]
    kinds = [pa.string(), *[pa.int64()] * (len(names) - 2), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                try:
                    for seq, (own, units, n) in enumerate(side_frames(content, layout)):
                        k = max(1, n)
                        numbers = [range(n) if n else [None], *([v] * k for v in own), *([None] * k if v is None or not n else v for v in units)]
                        out.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[path_] * k, [seq] * k, *numbers, [None] * k], kinds, strict=True)], names))
                except ValueError as e:
                    out = [pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([path_, *[None] * (len(names) - 2), str(e)], kinds, strict=True)], names)]
                yield from out

    return listed.mapInArrow(run, layout.table())


def side_summary(units: DataFrame, by: list[str]) -> DataFrame:
    return units.where("ctu is not null").groupBy(*by).agg(F.avg("qp_delta").alias("mean_qp_delta"), F.min("qp_delta").alias("least_qp_delta"), F.max("qp_delta").alias("most_qp_delta"), F.avg("activity").alias("mean_activity"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Catb)


def parameter_sets(meta: str) -> list[dict]:
    """The parameter sets of a container's meta data; what is missing or of another type is left out."""
    try:
        found = json.loads(meta).get("parameter_sets", [])
    except (ValueError, AttributeError):
        return []
    return [p for p in found if isinstance(p, dict)] if isinstance(found, list) else []
