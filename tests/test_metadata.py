"""Meta data as tables: what is missing, of another type, or no JSON at all."""

import json

import pytest

from framelake.operators import metadata as md

DOC = {
    "schema_version": 3,
    "decoder": {"codec": "hevc", "contract": 7},
    "parameter_sets": [{"kind": "SPS", "id": 2, "nal_index": "x", "fields": {"b": 1.5, "a": None, "list": [1], "t": True, "s": "x\"y", "n": -4}}, 3, "text", {"fields": [1]}, {"kind": 5, "id": 2.0, "nal_index": 9}],
    "frames_meta": [
        {"slice_headers": [{"nal_unit_name": "IDR", "nal_index": 4, "syntax": [{"name": "q", "value": 3, "bits": 2}, {"value": 1}, {"name": "l", "value": [1]}, 5], "ref_list0": [{"poc": 8, "long_term": True, "label": "a"}, 7], "ref_list1": "none"}, 12], "dpb": [{"poc": 1, "slot": 3, "output_mark": True}], "exactness_missing": ["mv", 3], "block_dropped_rows": [2, "x"], "stage_images": {"z": "p.png", "a": 1, "o": {}}},
        {"slice_headers": 5},
        4,
    ],
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("good", json.dumps(DOC)), ("empty", "{}"), ("other", '{"parameter_sets": {}, "frames_meta": 3, "decoder": []}'), ("bad", '{"parameter_sets": ['), ("none", None), ("list", "[1]")]
    return spark.createDataFrame(rows, "path string, meta string")


def test_summary(docs):
    got = {r.path: r for r in md.summary(docs, ["path"]).collect()}
    assert (got["good"].schema_version, got["good"].codec, got["good"].contract, got["good"].has_frames_meta, got["good"].n_frames_meta) == (3, "hevc", "", True, 3)
    assert {k: (r.has_frames_meta, r.error) for k, r in got.items() if k != "good"} == {"empty": (False, None), "other": (False, None), "bad": (False, "invalid JSON"), "none": (False, None), "list": (False, None)}


def test_parameter_sets(docs):
    rows = sorted(md.parameter_sets(docs, ["path"]).collect(), key=lambda r: (r.path, r.place or 0))
    assert [(r.path, r.error) for r in rows] == [("bad", "invalid JSON"), ("good", None), ("good", None), ("good", None)]
    assert [(r.place, r.kind, r.id, r.nal_index) for r in rows[1:]] == [(0, "SPS", 2, None), (1, "", 0, None), (2, "", 0, 9)]
    assert [tuple(f) for f in rows[1].fields] == [("a", "null"), ("b", "1.5"), ("n", "-4"), ("s", 'x"y'), ("t", "true")] and rows[2].fields == []
    named = md.fields(md.parameter_sets(docs, ["path"]), ["path", "place"], "S").collect()
    assert [(r.name, r.value) for r in named] == [("s", 'x"y')]


def test_slices_and_lists(docs):
    headers = md.slice_headers(docs, ["path"])
    rows = [r for r in headers.collect() if r.path == "good"]
    assert sorted((r.decode_idx, r.slice, r.nal_unit_name, r.nal_index) for r in rows) == [(0, 0, "IDR", 4), (0, 1, "", None)]
    assert [r.error for r in headers.collect() if r.path == "bad"] == ["invalid JSON"]
    assert sorted((r.name, r.value, r.bits) for r in md.slice_syntax(headers, ["path"]).collect()) == [("l", "", 0), ("q", "3", 2)]
    lists = md.reference_lists(headers, ["path"]).collect()
    assert sorted((r.list, r.place, r.poc, r.long_term, r.label) for r in lists) == [(0, 0, 8, True, "a"), (0, 1, 0, False, "")]
    held = [r for r in md.picture_buffer(docs, ["path"]).collect() if r.path == "good"]
    assert [(r.decode_idx, r.poc, r.slot, r.used_for_reference, r.output_mark) for r in held] == [(0, 1, 3, False, True)]


def test_details_by_place(spark, docs):
    details = md.frame_details(docs, ["path"])
    good = {r.decode_idx: r for r in details.where("path = 'good'").collect()}
    assert set(good) == {0, 1, 2} and good[0].exactness_missing == ["mv", ""] and good[0].block_dropped_rows == [2, 0]
    assert [tuple(f) for f in good[0].stage_images] == [("a", "1"), ("z", "p.png")] and good[2].stage_images == []
    frames = spark.createDataFrame([("good", 0, 5), ("good", 7, 6)], "path string, decode_idx long, poc int")
    joined = {r.decode_idx: r for r in md.with_frame_details(frames, details, ["path"]).collect()}
    assert joined[0].poc == 5 and joined[0].block_dropped_rows == [2, 0] and joined[7].exactness_missing is None
    assert sorted((r.block_idx, r.missing) for r in md.exactness_of_blocks(details, ["path"]).collect()) == [(0, "mv"), (1, "")]


def test_side_rows(spark):
    aux = {"loop_filters": [{"x": 8, "orientation": "vertical", "boundary_strength": 2, "reason": "tu"}, 1], "sao": [{"type_y": "band", "merge_up": True, "w": 64}, {"type_y": "not_applied", "type_cb": ""}, {}]}
    df = spark.createDataFrame([(0, json.dumps(aux)), (1, ""), (2, None), (3, "{}")], "decode_idx long, aux string")
    edges = {(r.decode_idx, r.place): r for r in md.loop_filters(df, ["decode_idx"]).collect()}
    assert set(edges) == {(0, 0), (1, None)} and edges[1, None].error == "invalid JSON"
    assert (edges[0, 0].x, edges[0, 0].y, edges[0, 0].vertical, edges[0, 0].boundary_strength, edges[0, 0].reason) == (8, 0, True, 2, "tu")
    assert [(r.place, r.w, r.applied, r.merge_up) for r in md.offsets(df, ["decode_idx"]).where("decode_idx = 0").orderBy("place").collect()] == [(0, 64, True, True), (1, 0, False, False), (2, 0, False, False)]
