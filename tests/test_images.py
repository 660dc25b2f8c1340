"""Files to pixels: getters and defaults, frames and their errors, palettes, rendering against column expressions."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pixelloom.functions import dictionaries as D
from pixelloom.functions import pixels, values
from pixelloom.operators import dataset, frames, render, rle, windowing
from pixelloom.sources import dicom
from pixelloom.sources.writer import encapsulated, packed_int16, part10, write_instances


def parsed(spark, *contents, **kw):
    rows = [(str(i), bytearray(c)) for i, c in enumerate(contents)]
    return dicom.parse_files(spark.createDataFrame(rows, "file_id string, content binary"), **kw)


def shown(spark, *contents, index=None, **kw):
    cut = render.frames_of(parsed(spark, *contents), None if index is None else F.lit(index))
    return sorted(render.render(cut, **kw).collect(), key=lambda r: (int(r["file_id"]), r["frame_index"]))


def rgba(row):
    return [tuple(row["rgba"][i : i + 4]) for i in range(0, len(row["rgba"]), 4)]


GRAY = {"Rows": 1, "Columns": 2, "BitsAllocated": 8, "WindowCenter": "128", "WindowWidth": "256"}


def test_defaults_of_an_empty_data_set(spark):
    got = dataset.instances(parsed(spark, part10({}))).first()
    want = {"transfer_syntax_uid": D.EXPLICIT_LE, "patient_name": "Anonymous", "patient_id": "", "study_date": "", "modality": "UNKNOWN", "study_description": "", "series_description": "", "number_of_frames": 1, "rows": 0, "columns": 0, "samples_per_pixel": 1, "bits_allocated": 16, "bits_stored": 16, "high_bit": 15, "planar_configuration": 0, "pixel_representation": 0, "is_signed": False, "photometric_interpretation": "MONOCHROME2", "rescale_slope": 1.0, "rescale_intercept": 0.0, "window_center_presets": [], "window_width_presets": [], "is_little_endian": True}
    assert {k: got[k] for k in want} == want
    for k in ("study_instance_uid", "series_number", "instance_number", "pixel_spacing", "slice_thickness", "window_center", "window_width", "pixel_padding_value", "encapsulated_data", "pixel_data_bytes", "manufacturer", "error"):
        assert got[k] is None, k


def test_empty_values_defeat_text_defaults_only(spark):
    got = dataset.instances(parsed(spark, part10({"PatientName": "", "Rows": b"", "WindowCenter": ""}))).first()
    assert (got["patient_name"], got["rows"], got["window_center"]) == ("", 0, None)


def test_presets_spacing_and_last_duplicate(spark):
    rows = [(D.TAG["WindowCenter"], "DS", "40\\x\\800"), (D.TAG["PixelSpacing"], "DS", "1.25\\0.85"), (D.TAG["PatientID"], "LO", "first"), (D.TAG["PatientID"], "LO", "second")]
    got = dataset.instances(parsed(spark, part10(rows))).first()
    assert (got["window_center_presets"], got["pixel_spacing"], got["patient_id"]) == ([40.0, 800.0], [1.25, 0.85], "second")


def test_sop_uids_have_no_fallback(spark):
    got = dataset.instances(parsed(spark, part10([(0x00020003, "UI", "1.2.3")]))).first()
    assert got["sop_instance_uid"] is None


def test_fail_fast(spark):
    with pytest.raises(Exception, match="less than 8"):
        parsed(spark, b"x", mode="failfast").collect()


def test_chosen_tags_only(spark):
    rows = dicom.element_rows(parsed(spark, part10({"Rows": 1, "Columns": 2}), tags=[D.TAG["Rows"]])).collect()
    assert [(r["group"], r["element"], r["ordinal"]) for r in rows] == [(0x28, 0x10, 1)]


def test_monochrome_and_inversion(spark):
    a, b = shown(spark, part10(GRAY, pixel_data=bytes([0, 255])), part10(GRAY | {"PhotometricInterpretation": "MONOCHROME1"}, pixel_data=bytes([0, 255])))
    assert rgba(a) == [(0, 0, 0, 255), (255, 255, 255, 255)] and rgba(b) == [(255, 255, 255, 255), (0, 0, 0, 255)]


def test_unknown_photometric_is_monochrome_and_width_zero_is_automatic(spark):
    (a,) = shown(spark, part10(GRAY | {"PhotometricInterpretation": "ODD", "WindowWidth": "0", "WindowCenter": "150"}, pixel_data=bytes([100, 200])))
    assert (a["wc"], a["ww"]) == (150.0, 100.0)


def test_short_pixel_data_is_filled(spark):
    (a,) = shown(spark, part10(GRAY | {"Rows": 2}, pixel_data=bytes([255, 255])))
    assert [p[0] for p in rgba(a)] == [255, 255, 0, 0]


def test_rgb_both_layouts(spark):
    head = {"Rows": 2, "Columns": 2, "SamplesPerPixel": 3, "BitsAllocated": 8, "PhotometricInterpretation": "RGB"}
    data = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 0])
    planes = bytes([255, 0, 0, 255, 0, 255, 0, 255, 0, 0, 255, 0])
    want = [(255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (255, 255, 0, 255)]
    got = shown(spark, part10(head, pixel_data=data), part10(head | {"PlanarConfiguration": 1}, pixel_data=planes))
    assert [rgba(g) for g in got] == [want, want]


def test_ybr_matches_columns(spark):
    data = bytes(range(0, 252, 4))[:63]
    head = {"Rows": 3, "Columns": 7, "SamplesPerPixel": 3, "BitsAllocated": 8, "PhotometricInterpretation": "YBR_FULL_422"}
    (got,) = shown(spark, part10(head, pixel_data=data))
    triples = [Row(y=data[i], b=data[i + 1], r=data[i + 2]) for i in range(0, 63, 3)]
    want = [tuple(r["x"]) for r in spark.createDataFrame(triples).select(pixels.ybr_to_rgb(F.col("y"), F.col("b"), F.col("r")).alias("x")).collect()]
    assert [p[:3] for p in rgba(got)] == want


def test_multi_frame_and_range(spark):
    content = part10({"Rows": 2, "Columns": 2, "NumberOfFrames": "3", "BitsAllocated": 8}, pixel_data=bytes([10] * 4 + [100] * 4 + [200] * 4))
    assert [rgba(r)[0][0] for r in shown(spark, content)] == [10, 100, 200]
    for index in (3, -1):
        (bad,) = shown(spark, content, index=index)
        assert bad["error"] == Row(kind="RangeError", message=f"Invalid frameIndex {index} (total frames: 3).")


def kinds(rows):
    return [r["error"]["kind"] if r["error"] else None for r in rows]


def test_frame_errors_in_order(spark):
    small = {"Rows": 1, "Columns": 2, "BitsAllocated": 8}
    good = rle.encode_frame(bytes([1, 2]))
    contents = [
        part10(small),
        part10(small, pixel_data=b""),
        part10(small, wrapped=encapsulated([])),
        part10(small, D.RLE, pixel_data=bytes(2)),
        part10(small | {"NumberOfFrames": "2"}, D.RLE, wrapped=encapsulated([good])),
        part10(small, D.RLE, wrapped=encapsulated([good], [0, 4])),
        part10(small, D.RLE, wrapped=encapsulated([good], [4])),
        part10(small, "1.2.840.10008.1.2.4.50", wrapped=encapsulated([b"\xff\xd8"])),
        part10(small, pixel_data=b"\xff\xd8\xff\xe0"),
        part10(small | {"BitsAllocated": 12}, pixel_data=bytes(4)),
        part10(small, D.RLE, wrapped=encapsulated([b"short!"])),
        part10(small, D.RLE, wrapped=encapsulated([good], [0])),
    ]
    got = [r for r in shown(spark, *contents) if r["frame_index"] == 0]
    assert kinds(got) == ["StateError", "StateError", "FormatException", "FormatException", "FormatException", "FormatException", "FormatException", "UnsupportedError", "UnsupportedError", "UnsupportedError", "FormatException", None]
    assert "Annex G" in got[4]["error"]["message"] and "count (2)" in got[5]["error"]["message"] and "JPEG Baseline" in got[7]["error"]["message"]


def test_images_look_at_compression_before_the_frame_number(spark):
    content = part10({"Rows": 2, "Columns": 2, "BitsAllocated": 8}, "1.2.840.10008.1.2.4.90", wrapped=encapsulated([b"\xff\x4f\xff\x51"]))
    rows = parsed(spark, content)
    assert kinds(render.render_images(rows, F.lit(5)).collect()) == ["UnsupportedError"]
    assert kinds(render.render(render.frames_of(rows, F.lit(5))).collect()) == ["RangeError"]


STARTS = (b"\xff\xd8\xff\xe0", b"\xff\x4f\xff\x51", b"\0\0\0\x0c")


def test_samples_that_begin_as_a_stream_does(spark):
    gray = {"Rows": 1, "Columns": 2, "BitsStored": 12, "PixelRepresentation": 1}
    big = shown(spark, *(part10(gray, D.EXPLICIT_BE, pixel_data=s) for s in STARTS))
    frames_ = shown(spark, *(part10({"Rows": 1, "Columns": 3, "BitsAllocated": 8, "NumberOfFrames": "3"}, pixel_data=s + bytes(5)) for s in STARTS))
    assert kinds(big) == [None] * 3 and kinds(frames_) == [None] * 9
    longer = shown(spark, *(part10({"Rows": 1, "Columns": 2, "BitsAllocated": 8}, pixel_data=s + bytes(4)) for s in STARTS))
    wrapped = shown(spark, *(part10(gray, wrapped=encapsulated([s])) for s in STARTS))
    assert kinds(longer) == kinds(wrapped) == ["UnsupportedError"] * 3


def test_short_samples_that_begin_as_a_stream_does(spark):
    colour = {"Rows": 2, "Columns": 3, "SamplesPerPixel": 3, "PhotometricInterpretation": "RGB", "BitsAllocated": 8}
    got = shown(spark, *(part10(colour, pixel_data=s + bytes([1] * 12)) for s in STARTS))
    assert kinds(got) == [None] * 3
    assert [[x for p in rgba(r) for x in p[:3]] for r in got] == [[*s, *[1] * 12, *[0] * (6 - len(s))] for s in STARTS]
    whole = [b"\xff\xd8\xff\xe0ab\xff\xd9", b"\xff\x4f\xff\x51a\xff\xd9", b"\0\0\0\x0cjP  \r\n\x87\na\xff\xd9"]
    assert kinds(shown(spark, *(part10(colour, pixel_data=s) for s in whole))) == ["UnsupportedError"] * 3


def test_many_frames_and_wide_palettes_take_linear_time(spark):
    n, part = 2000, rle.encode_frame(bytes(range(16)))
    offsets = [i * (len(part) + 8) for i in range(n)]
    head = {"Rows": 4, "Columns": 4, "NumberOfFrames": str(n), "BitsAllocated": 8, "WindowCenter": "128", "WindowWidth": "256"}
    began = time.monotonic()
    got = shown(spark, part10(head, D.RLE, wrapped=encapsulated([part] * n, offsets)))
    assert len(got) == n and all(r["rgba"] == got[0]["rgba"] for r in got) and time.monotonic() - began < 20
    wide = {f"{c}PaletteColorLookupTableDescriptor": [0, 0, 16] for c in CHANNELS}
    table = b"".join(bytes([0, k >> 8]) for k in range(65536))
    began = time.monotonic()
    (a,) = shown(spark, palette(data=(table,) * 3, stored=packed_int16([0, 255, 256, -1]), BitsAllocated=16, **wide))
    assert [p[0] for p in rgba(a)] == [0, 0, 1, 255] and time.monotonic() - began < 20


def test_samples_of_a_large_binary_take_linear_time(spark):
    n = 512 * 512
    row = spark.createDataFrame([(bytearray(range(256)) * (2 * n // 256),)], "b binary")
    began = time.monotonic()
    got = row.select(pixels.stored_values(F.col("b"), F.lit(n), 16, F.lit(True)).alias("x")).select(F.size("x"), F.get("x", F.lit(1)), F.element_at("x", -1)).first()
    assert tuple(got) == (n, 0x0302, 0xFFFE) and time.monotonic() - began < 20


def test_offsets_of_a_hot_key_over_many_ranges(spark):
    rows = [("hot" if i % 3 else None, i, (i * 37) % 50 - 5) for i in range(2000)]
    frame = spark.createDataFrame(rows, "file string, i int, n int").repartition(7)
    got = {(r["file"], r["i"]): r["relative_tag_start"] for r in frames.fragment_offsets(frame, ["file"], "i", "n").collect()}
    at = {}
    for key, i, n in rows:
        assert got.pop((key, i)) == at.get(key, 0)
        at[key] = at.get(key, 0) + (n + 8 if n > 0 else 0)
    assert not got


def test_batches_are_answered_by_bytes():
    batch = pa.RecordBatch.from_pydict({"payload": pa.array([b"x" * n for n in (5, 0, 900, 40, 2, 2, 300)] + [None], pa.binary()), "i": list(range(8))})
    for most in (1, 100, 10**6):
        runs = list(render._runs(batch, lambda f: (f["i"], len(f["payload"] or b"")), lambda g: g[1], most=max(most, 4)))
        assert [g[0] for _, got in runs for g in got] == list(range(8)) and [x for part, _ in runs for x in part.column(1).to_pylist()] == list(range(8))
        assert all(sum(g[1] for g in got[:-1]) < max(most, 4) for _, got in runs)
    assert not list(render._runs(batch.slice(0, 0), None, None))


class Given:
    """Stands for a DataFrame; mapInArrow gives back its function."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_few_rows_of_a_batch_are_objects_at_a_time(spark):
    n = 5000
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(n), pa.int64())})
    files = list(write_instances(Given(), lambda row: part10({"InstanceNumber": row["k"], **GRAY}, pixel_data=bytes(2)), "k")(iter([batch])))
    assert max(f.num_rows for f in files) <= 512
    whole = pa.Table.from_batches(files).combine_chunks().to_batches()
    found = list(dicom.parse_files(Given())(iter(whole)))
    assert len(whole) == 1 and max(len(f.column(1).flatten()) for f in found) <= 8192 + 8
    rows = [(i, next(e["whole"] for e in es if e["tag"] == D.TAG["InstanceNumber"])) for f in found for i, es in zip(f.column(0).to_pylist(), f.column(1).to_pylist())]
    assert rows == [(str(k), k) for k in range(n)]
    batch = batch.append_column("payload", pa.array([b"ab"] * n, pa.binary()))
    runs = list(render._runs(batch, lambda f: (f["k"],), lambda g: 2))
    assert max(len(got) for _, got in runs) <= 512 and [g[0] for _, got in runs for g in got] == [k for part, _ in runs for k in part.column(0).to_pylist()] == list(range(n))


def test_text_of_unknown_elements(spark):
    content = part10([(D.TAG["AcquisitionDate"], "UN", b"20200102")], D.IMPLICIT_LE)
    assert dataset.instances(parsed(spark, content)).first()["acquisition_date"] == "20200102"


def test_late_frame_and_image_without_area(spark):
    (late,) = shown(spark, part10({"Rows": 2, "Columns": 2, "BitsAllocated": 8, "NumberOfFrames": "5"}, pixel_data=bytes(4)), index=3)
    assert late["error"]["message"] == "Frame 3 start offset 12 exceeds pixel data length (4 bytes)."
    (flat,) = shown(spark, part10({"BitsAllocated": 8}, pixel_data=bytes(4)), image=True)
    assert flat["error"] == Row(kind="StateError", message="Invalid image dimensions: 0x0")


def test_single_frame_of_many_fragments(spark):
    whole = rle.encode_frame(bytes([9, 9, 9, 9]))
    (got,) = shown(spark, part10({"Rows": 2, "Columns": 2, "BitsAllocated": 8}, D.RLE, wrapped=encapsulated([whole[:64], whole[64:]])))
    assert got["error"] is None and rgba(got)[3][0] == 9


CHANNELS = ("Red", "Green", "Blue")


def palette(descriptor=(3, 0, 8), data=(b"\xff\0\0", b"\0\xff\0", b"\0\0\xff"), stored=bytes([0, 1, 2, 1]), **more):
    values = {f"{c}PaletteColorLookupTableDescriptor": list(descriptor) for c in CHANNELS} | {f"{c}PaletteColorLookupTableData": d for c, d in zip(CHANNELS, data)}
    return part10({"Rows": 1, "Columns": 4, "BitsAllocated": 8, "PhotometricInterpretation": "PALETTE COLOR"} | {k: v for k, v in (values | more).items() if v is not None}, pixel_data=stored)


def test_palette_colours(spark):
    a, b, c = shown(spark, palette(), palette((3, 50, 8), stored=bytes([0, 50, 51, 255])), palette((3, 0, 16), (b"\0\x10\0\x80\0\xff",) * 3))
    assert [p[:3] for p in rgba(a)] == [(255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 255, 0)]
    assert [p[:3] for p in rgba(b)] == [(255, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    assert [p[0] for p in rgba(c)] == [16, 128, 255, 128]


def test_palette_frames_that_begin_as_a_stream_does(spark):
    got = shown(spark, *(palette((100, 50, 8), (bytes(range(100)),) * 3, stored=s, Columns=len(s)) for s in STARTS))
    assert kinds(got) == [None] * 3
    assert [[p[0] for p in rgba(r)] for r in got] == [[max(0, min(99, k - 50)) for k in s] for s in STARTS]


def test_palette_ladder(spark):
    contents = [
        palette(RedPaletteColorLookupTableData=None, SegmentedRedPaletteColorLookupTableData=b"ab"),
        palette(GreenPaletteColorLookupTableData=None, EnhancedPaletteColorLookupTableSequence=b"ab"),
        palette(GreenPaletteColorLookupTableDescriptor=None),
        palette(BluePaletteColorLookupTableData=None),
        palette(RedPaletteColorLookupTableDescriptor=[3, 0]),
        palette((3, 0, 12)),
        palette(BluePaletteColorLookupTableDescriptor=[2, 0, 8]),
        palette((9, 0, 8)),
    ]
    got = shown(spark, *contents)
    assert kinds(got) == ["UnsupportedError", "UnsupportedError"] + ["FormatException"] * 6
    said = ["Segmented", "Enhanced", "missing Green Palette Color Lookup Table Descriptor (0028,1102)", "missing Blue Palette Color Lookup Table Data (0028,1203)", "expected at least 6 bytes, found 4", "bitsPerEntry: 12", "Inconsistent", "expected at least 9 bytes, found 4"]
    assert all(s in r["error"]["message"] for s, r in zip(said, got)), [r["error"] for r in got]


def test_palette_of_65536_entries_and_signed_start(spark):
    big = [bytes(65535) + bytes([v]) for v in (255, 128, 64)]
    head = {"BitsAllocated": 16, "Columns": 1}
    a = palette((0, 0, 8), big, b"\xff\xff", **head)
    signed = {f"{c}PaletteColorLookupTableDescriptor": [3, 65526, 8] for c in CHANNELS}
    b = palette(data=(b"\1\2\3",) * 3, stored=packed_int16([-10, -9, -8, -20, 5]), BitsAllocated=16, Columns=5, PixelRepresentation=1, **signed)
    got = shown(spark, a, b)
    assert rgba(got[0])[0] == (255, 128, 64, 255) and [p[0] for p in rgba(got[1])] == [1, 2, 3, 1, 3]


def test_auto_window_goldens(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (-1024, -1024, 100, 300, 500)], "k int, v double")
    stored = F.col("v").cast("bigint")
    plain = windowing.auto_window(rows, ["k"], F.col("v")).first()
    padded = windowing.auto_window(rows, ["k"], F.col("v"), stored, F.lit(-1024)).first()
    all_padding = windowing.auto_window(rows, ["k"], F.col("v"), stored, F.lit(-2000), F.lit(2000)).first()
    assert (plain["auto_width"], padded["auto_width"], padded["auto_center"], all_padding["auto_width"]) == (1524.0, 400.0, 300.0, 1524.0)
    arrays = rows.groupBy("k").agg(F.collect_list("v").alias("v")).select(*windowing.auto_window_array(F.col("v"), F.transform("v", lambda x: x.cast("bigint")), F.lit(-1024))).first()
    assert tuple(arrays) == (300.0, 400.0)
    assert tuple(rows.where("false").groupBy().agg(F.collect_list("v").alias("v")).select(*windowing.auto_window_array(F.col("v"))).first()) == (128.0, 256.0)


def test_last_wins_both_ways(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, x string")
    for f in (dataset.last_wins, dataset.last_wins_ranked):
        assert sorted(map(tuple, f(rows, ["k"], ["o"]).collect())) == [(1, 2, "b"), (2, 1, "c")]


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "a.dcm").write_bytes(part10(GRAY, pixel_data=bytes([0, 255])))
    (tmp_path / "b.txt").write_bytes(b"no")
    files = dicom.read_files(spark, str(tmp_path), "*.dcm")
    assert dataset.instances(dicom.parse_files(files, pixels=False), ["rows", "columns"]).select("rows", "columns").collect() == [Row(rows=1, columns=2)]
    stream = dicom.parse_files(dicom.stream_files(spark, str(tmp_path), "*.dcm"))
    run = dataset.instances(stream, ["rows"]).writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("files").count() == 1


def test_values_decoded_at_parsing_equal_the_column_functions(spark):
    texts = ["", " 12 ", "0045", "12.7", "-3.9\\4", "0x1F", "ABC", "NaN", "Infinity", "1e3", "1.5f", "40\\x\\800", "9" * 25, "\0 A \0", "é﻿", "5.", " \\2"]
    rows = [(0x00091000 + i, vr, t.encode()) for i, (vr, t) in enumerate((vr, t) for vr in ("DS", "IS", "LO", "CS", "AE", "UT", "PN") for t in texts)]
    rows += [(0x000B1000 + i, vr, bytes(range(200, 200 + n))) for i, (vr, n) in enumerate((vr, n) for vr in ("US", "UL", "SS", "SL", "FL", "FD") for n in (0, 2, 4, 8))]
    for syntax in (D.EXPLICIT_LE, D.EXPLICIT_BE):
        got = dicom.element_rows(parsed(spark, part10(rows, syntax)))
        e = F.struct("tag", "vr", "value_length", "value_bytes", "is_little_endian")
        both = got.select("vr", "text", "whole", "decimal", "decimals", values.as_string(e).alias("a"), values.as_int(e).alias("b"), values.as_double(e).alias("c"), values.as_double_list(e).alias("d")).collect()
        assert len(both) == len(rows) + 1
        for r in both:
            assert str(r[1:5]) == str(r[5:9]), r
