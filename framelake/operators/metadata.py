"""Meta data of telemetry containers and the side rows of frames: JSON text as tables, parsed in the JVM as variants.

Reading is lenient as far as a document is JSON: a member that is missing or of another type takes its default, an element
that is no object where one is wanted is left out, and a list is known by its elements' places. A text that is no JSON gives
one row with an error. All functions take rows (keys..., json text) and keep the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALARS = ["BIGINT", "BOOLEAN", "STRING", "VOID", "DOUBLE", "FLOAT"]


def at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_a(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v) == kind, F.lit(False))


def integer(v: Column, name: str, default: int | None = 0) -> Column:
    return F.when(is_a(at(v, name), "BIGINT"), F.try_variant_get(v, f"$.{name}", "long")).otherwise(F.lit(default).cast("long"))


def text(v: Column, name: str) -> Column:
    return F.when(is_a(at(v, name), "STRING"), F.try_variant_get(v, f"$.{name}", "string")).otherwise(F.lit(""))


def truth(v: Column, name: str) -> Column:
    return F.when(is_a(at(v, name), "BOOLEAN"), F.try_variant_get(v, f"$.{name}", "boolean")).otherwise(F.lit(False))


def items(v: Column, name: str) -> Column:
    """The elements of a list; none if it is missing or no list."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.expr("cast(array() as array<variant>)"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def scalar_text(v: Column) -> Column:
    """A scalar as text: null, true, a number as it is written, a string as it is; null for lists and objects."""
    kind = F.schema_of_variant(v)
    plain = kind.isin(SCALARS) | kind.startswith("DECIMAL")
    return F.when(F.coalesce(kind == "VOID", F.lit(False)), "null").when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(plain, F.to_json(v))


def scalar_fields(v: Column) -> Column:
    """The scalar members of an object as (name, value), by name."""
    members = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    named = F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("name"), scalar_text(e["value"]).alias("value")))
    return F.array_sort(F.filter(named, lambda e: e["value"].isNotNull()))


def parsed(documents: DataFrame, keys: list[str], json: str) -> DataFrame:
    """The keys, the document as variant `v`, and an error if the text is no JSON."""
    read = documents.select(*keys, F.col(json).isNotNull().alias("given"), F.try_parse_json(json).alias("v"))
    return read.select(*keys, "v", F.when(F.col("v").isNull() & F.col("given"), "invalid JSON").alias("error"))


def spread(rows: DataFrame, keys: list[str], what: Column, place: str, *columns: tuple[str, Column]) -> DataFrame:
    """A row for each element of a list, with its place, as variant `e`; of a document with an error one row without."""
    found = rows.select(*keys, "error", *(c.alias(n) for n, c in columns), F.posexplode_outer(what).alias(place, "e")).where("error is not null or e is not null")
    return found.withColumn(place, F.col(place).cast("long"))


def summary(documents: DataFrame, keys: list[str], json: str = "meta") -> DataFrame:
    """One row a document: schema_version, codec, contract, capture_level, has_frames_meta, n_frames_meta, error."""
    rows = parsed(documents, keys, json)
    v, decoder = F.col("v"), at(F.col("v"), "decoder")
    listed = F.try_variant_get(v, "$.frames_meta", "array<variant>")
    return rows.select(*keys, integer(v, "schema_version", None).alias("schema_version"), *(text(decoder, n).alias(n) for n in ("codec", "contract", "capture_level")), listed.isNotNull().alias("has_frames_meta"), F.coalesce(F.size(listed), F.lit(0)).cast("long").alias("n_frames_meta"), "error")


def parameter_sets(documents: DataFrame, keys: list[str], json: str = "meta") -> DataFrame:
    """A row a parameter set: place, kind, id, nal_index (null without one), fields (name, value)."""
    rows = parsed(documents, keys, json)
    found = spread(rows, keys, F.filter(items(F.col("v"), "parameter_sets"), is_object), "place")
    e = F.col("e")
    return found.select(*keys, "place", text(e, "kind").alias("kind"), integer(e, "id").alias("id"), integer(e, "nal_index", None).alias("nal_index"), scalar_fields(at(e, "fields")).alias("fields"), "error")


def fields(rows: DataFrame, keys: list[str], contains: str = "") -> DataFrame:
    """A row a field (name, value) whose name contains a text, whatever the case of its Latin letters."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # outer, as Spark would make the fields twice to leave out rows without any
    return rows.select(*keys, F.inline_outer("fields")).where(lower(F.col("name")).contains(lower(F.lit(contains))))


def frames_meta(documents: DataFrame, keys: list[str], json: str = "meta") -> DataFrame:
    """A row a frame, in the order of the container's frames: decode_idx, the variant `e`, error."""
    return spread(parsed(documents, keys, json), keys, items(F.col("v"), "frames_meta"), "decode_idx")


def slice_headers(documents: DataFrame, keys: list[str], json: str = "meta") -> DataFrame:
    """A row a slice header: decode_idx, slice, nal_unit_name, slice_type_label, nal_index, fields, and the variant `header`."""
    found = frames_meta(documents, keys, json)
    slices = spread(found, [*keys, "decode_idx"], items(F.col("e"), "slice_headers"), "slice")
    e = F.col("e")
    return slices.select(*keys, "decode_idx", "slice", text(e, "nal_unit_name").alias("nal_unit_name"), text(e, "slice_type_label").alias("slice_type_label"), integer(e, "nal_index", None).alias("nal_index"), scalar_fields(e).alias("fields"), e.alias("header"), "error")


def slice_syntax(headers: DataFrame, keys: list[str]) -> DataFrame:
    """A row a syntax element of slice headers: place, name, value, bits; elements without a name are left out."""
    found = headers.select(*keys, "decode_idx", "slice", F.explode(F.filter(items(F.col("header"), "syntax"), lambda r: is_a(at(r, "name"), "STRING"))).alias("e"))
    e = F.col("e")
    return found.select(*keys, "decode_idx", "slice", text(e, "name").alias("name"), F.coalesce(scalar_text(at(e, "value")), F.lit("")).alias("value"), integer(e, "bits").alias("bits"))


def reference_lists(headers: DataFrame, keys: list[str]) -> DataFrame:
    """A row an entry of the reference lists of slice headers: list (0 or 1), place, poc, long_term, label."""
    both = F.array(*(F.struct(F.lit(k).alias("list"), items(F.col("header"), f"ref_list{k}").alias("entries")) for k in (0, 1)))
    lists = headers.select(*keys, "decode_idx", "slice", F.inline(both)).select(*keys, "decode_idx", "slice", "list", F.posexplode("entries").alias("place", "e"))
    e = F.col("e")
    return lists.select(*keys, "decode_idx", "slice", "list", F.col("place").cast("long").alias("place"), integer(e, "poc").alias("poc"), truth(e, "long_term").alias("long_term"), text(e, "label").alias("label"))


def picture_buffer(documents: DataFrame, keys: list[str], json: str = "meta") -> DataFrame:
    """A row a picture that the decoder holds at a frame: place, poc, slot, used_for_reference, long_term, output_mark, label."""
    rows = spread(frames_meta(documents, keys, json), [*keys, "decode_idx"], items(F.col("e"), "dpb"), "place")
    e = F.col("e")
    return rows.select(*keys, "decode_idx", "place", integer(e, "poc").alias("poc"), integer(e, "slot", None).alias("slot"), *(truth(e, n).alias(n) for n in ("used_for_reference", "long_term", "output_mark")), text(e, "label").alias("label"), "error")


def frame_details(documents: DataFrame, keys: list[str], json: str = "meta") -> DataFrame:
    """A row a frame: exactness_missing (texts), block_dropped_rows (numbers), stage_images (name, path)."""
    rows, e = frames_meta(documents, keys, json), F.col("e")
    texts = F.transform(items(e, "exactness_missing"), lambda t: F.when(is_a(t, "STRING"), F.try_variant_get(t, "$", "string")).otherwise(F.lit("")))
    numbers = F.transform(items(e, "block_dropped_rows"), lambda t: F.when(is_a(t, "BIGINT"), F.try_variant_get(t, "$", "long")).otherwise(F.lit(0).cast("long")))
    return rows.select(*keys, "decode_idx", texts.alias("exactness_missing"), numbers.alias("block_dropped_rows"), scalar_fields(at(e, "stage_images")).alias("stage_images"), "error")


def with_frame_details(frames: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """Frames beside the meta data at their place; a frame without has nulls, meta data without a frame go."""
    return frames.join(details.where("error is null").drop("error"), [*keys, "decode_idx"], "left")


def exactness_of_blocks(details: DataFrame, keys: list[str]) -> DataFrame:
    """A row a block of a frame: what it lacks to be exact, by the block's place."""
    return details.select(*keys, "decode_idx", F.posexplode("exactness_missing").alias("block_idx", "missing")).withColumn("block_idx", F.col("block_idx").cast("long"))


def loop_filters(frames: DataFrame, keys: list[str], json: str = "aux") -> DataFrame:
    """A row a filtered edge: place, x, y, w, h, vertical, boundary_strength, filter_strength, reason, qp."""
    found = spread(parsed(frames, keys, json), keys, F.filter(items(F.col("v"), "loop_filters"), is_object), "place")
    e = F.col("e")
    return found.select(*keys, "place", *(integer(e, n).cast("int").alias(n) for n in "xywh"), (text(e, "orientation") == "vertical").alias("vertical"), integer(e, "boundary_strength").cast("int").alias("boundary_strength"), text(e, "filter_strength").alias("filter_strength"), text(e, "reason").alias("reason"), integer(e, "qp").cast("int").alias("qp"), "error")


def offsets(frames: DataFrame, keys: list[str], json: str = "aux") -> DataFrame:
    """A row a unit of sample offsets: place, x, y, w, h, type_y, type_cb, type_cr, merge_left, merge_up, applied."""
    found = spread(parsed(frames, keys, json), keys, F.filter(items(F.col("v"), "sao"), is_object), "place")
    e = F.col("e")
    kinds = {n: text(e, n) for n in ("type_y", "type_cb", "type_cr")}
    applied = F.exists(F.array(*kinds.values()), lambda t: ~t.isin("", "not_applied"))
    return found.select(*keys, "place", *(integer(e, n).cast("int").alias(n) for n in "xywh"), *(c.alias(n) for n, c in kinds.items()), truth(e, "merge_left").alias("merge_left"), truth(e, "merge_up").alias("merge_up"), applied.alias("applied"), "error")
