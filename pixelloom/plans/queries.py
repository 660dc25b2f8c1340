"""One query for each operator over the supplied tables, and DuckDB SQL that must give the same rows.

`embeddings` rows stand for 8 x 8 frames (stored = round(1000 x)), `events` for a viewer's log, scalar columns of
the other tables for element values. Where an operator needs files, they are written from the tables first, and
the SQL says what must come out again without any bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import dictionaries as D
from pixelloom.functions import display, pixels, values
from pixelloom.operators import dataset, frames, palette, render, rle, windowing
from pixelloom.sources import dicom, part10, writer
from pixelloom.streaming import interaction

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that checks it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """vec_id, stored (64 samples) and more of the table's columns."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *more, F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint")).alias("stored"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, i, stored: one row for each sample; exploded first, so that all arithmetic is generated code."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double") * 1000).cast("bigint").alias("stored"))


#: The same in SQL.
STORED = "s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS stored FROM embeddings)"
SAMPLES = f"{STORED}, p AS (SELECT vec_id, CAST(unnest(range(64)) AS BIGINT) AS i, unnest(stored) AS stored FROM s)"


def window_sql(v: str, c: str, w: str) -> str:
    return f"""CASE WHEN {v} <= ({c}) - 0.5::DOUBLE - (greatest({w}, 1.0::DOUBLE) - 1.0::DOUBLE) / 2.0::DOUBLE THEN 0
        WHEN {v} > ({c}) - 0.5::DOUBLE + (greatest({w}, 1.0::DOUBLE) - 1.0::DOUBLE) / 2.0::DOUBLE THEN 255
        ELSE CAST(round(least(greatest((({v} - (({c}) - 0.5::DOUBLE)) / (greatest({w}, 1.0::DOUBLE) - 1.0::DOUBLE) + 0.5::DOUBLE) * 255.0::DOUBLE, 0.0::DOUBLE), 255.0::DOUBLE)) AS INTEGER) END"""


@query(f"WITH {SAMPLES} SELECT vec_id, i, stored * 1.5::DOUBLE - 24.0::DOUBLE AS value FROM p")
def rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("vec_id", "i", pixels.rescaled(F.col("stored"), F.lit(1.5), F.lit(-24.0)).alias("value"))


@query(f"WITH {SAMPLES} SELECT vec_id, i, {window_sql('CAST(stored AS DOUBLE)', '40.0::DOUBLE', '400.0::DOUBLE')} AS gray FROM p")
def voi_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("vec_id", "i", pixels.voi_window(F.col("stored").cast("double"), F.lit(40.0), F.lit(400.0)).alias("gray"))


@query(f"WITH {SAMPLES} SELECT vec_id, i, 255 - ({window_sql('CAST(stored AS DOUBLE)', '0.0::DOUBLE', '300.0::DOUBLE')}) AS gray FROM p")
def mono1_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("vec_id", "i", pixels.inverted(pixels.voi_window(F.col("stored").cast("double"), F.lit(0.0), F.lit(300.0))).alias("gray"))


@query(
    f"""WITH {SAMPLES}, r AS (SELECT vec_id, min(stored * 2.0::DOUBLE - 10) AS lo, max(stored * 2.0::DOUBLE - 10) AS hi FROM p GROUP BY vec_id)
    SELECT vec_id, lo + (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) / 2.0::DOUBLE AS auto_center, greatest(CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 1.0::DOUBLE) AS auto_width FROM r"""
)
def auto_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowing.auto_window(samples(spark, sf_dir), ["vec_id"], pixels.rescaled(F.col("stored"), F.lit(2.0), F.lit(-10.0)))


@query(
    f"""WITH {SAMPLES}, r AS (SELECT vec_id, coalesce(min(CAST(stored AS DOUBLE)) FILTER (stored NOT BETWEEN -600 AND -50), min(CAST(stored AS DOUBLE))) AS lo,
        coalesce(max(CAST(stored AS DOUBLE)) FILTER (stored NOT BETWEEN -600 AND -50), max(CAST(stored AS DOUBLE))) AS hi FROM p GROUP BY vec_id)
    SELECT vec_id, lo + (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) / 2.0::DOUBLE AS auto_center, greatest(CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 1.0::DOUBLE) AS auto_width FROM r"""
)
def auto_window_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowing.auto_window(samples(spark, sf_dir), ["vec_id"], F.col("stored").cast("double"), F.col("stored"), F.lit(-50), F.lit(-600))


@query(
    """SELECT vec_id, coalesce(CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id AS DOUBLE) END, CASE WHEN vec_id % 2 = 0 THEN CAST(label AS DOUBLE) END, 128.0::DOUBLE) AS wc,
    coalesce(CASE WHEN vec_id % 5 = 0 THEN CAST(label - 3 AS DOUBLE) END, CASE WHEN vec_id % 7 = 0 THEN 350.0::DOUBLE END, 256.0::DOUBLE) AS ww FROM embeddings"""
)
def window_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, label = F.col("vec_id"), F.col("label").cast("double")
    wc = pixels.resolved_center(F.when(v % 3 == 0, v.cast("double")), F.when(v % 2 == 0, label))
    ww = pixels.resolved_width(F.when(v % 5 == 0, label - 3), F.when(v % 7 == 0, F.lit(350.0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", wc.alias("wc"), ww.alias("ww"))


def _rgb(spark: SparkSession, sf_dir: str, planar: bool) -> DataFrame:
    rows = stored(spark, sf_dir).select("vec_id", "stored", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(21).cast("bigint"))).alias("i"))
    return rows.select("vec_id", "i", F.inline(F.array(pixels.rgb_at(F.col("stored"), F.col("i"), F.lit(22), F.lit(planar)))))


def _rgb_sql(at: Callable[[int], str]) -> str:
    cols = ", ".join(f"CAST(greatest(least(coalesce(stored[{at(k)}], 0), 255), 0) AS INTEGER) AS {c}" for k, c in enumerate("rgb"))
    return f"WITH {STORED}, x AS (SELECT vec_id, stored, CAST(unnest(range(22)) AS BIGINT) AS i FROM s) SELECT vec_id, i, {cols} FROM x"


@query(_rgb_sql(lambda k: f"3 * i + {k + 1}"))
def rgb_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir, False)


@query(_rgb_sql(lambda k: f"22 * {k} + i + 1"))
def rgb_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir, True)


@query(
    f"""WITH {STORED}, x AS (SELECT vec_id, CAST(unnest(range(22)) AS BIGINT) AS i, stored FROM s),
    y AS (SELECT vec_id, i, CAST(coalesce(abs(stored[3 * i + 1]) % 256, 0) AS DOUBLE) AS y, CAST(coalesce(abs(stored[3 * i + 2]) % 256, 0) AS DOUBLE) - 128 AS b, CAST(coalesce(abs(stored[3 * i + 3]) % 256, 0) AS DOUBLE) - 128 AS r FROM x)
    SELECT vec_id, i, CAST(greatest(least(round(y + r * 1.402::DOUBLE), 255), 0) AS INTEGER) AS r, CAST(greatest(least(round(y - b * 0.344136::DOUBLE - r * 0.714136::DOUBLE), 255), 0) AS INTEGER) AS g,
    CAST(greatest(least(round(y + b * 1.772::DOUBLE), 255), 0) AS INTEGER) AS b FROM y"""
)
def ybr_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir).select("vec_id", F.transform("stored", lambda x: F.abs(x) % 256).alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(21).cast("bigint"))).alias("i"))
    at = lambda k: F.coalesce(F.get("s", (F.col("i") * 3 + k).cast("int")), F.lit(0))
    return rows.select("vec_id", "i", F.inline(F.array(pixels.ybr_to_rgb(at(0), at(1), at(2)))))


@query(f"WITH {SAMPLES}, x AS (SELECT vec_id, i, greatest(0, least(255, stored + 100)) AS k FROM p) SELECT vec_id, i, CAST(k AS INTEGER) AS r, CAST(255 - k AS INTEGER) AS g, CAST(k // 2 AS INTEGER) AS b FROM x")
def palette_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A palette of 256 entries as arrays in the plan: an index, not a join."""
    lut = lambda f: F.array(*[F.lit(f(k)) for k in range(256)])
    at = pixels.palette_index(F.col("stored"), F.lit(-100), F.lit(256)).cast("int")
    return samples(spark, sf_dir).select("vec_id", "i", *(F.get(lut(f), at).alias(c) for c, f in (("r", lambda k: k), ("g", lambda k: 255 - k), ("b", lambda k: k // 2))))


@query("SELECT l_orderkey, l_linenumber, (l_partkey * 37) & 4095 AS bits FROM lineitem")
def bit_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pixels.masked(F.col("l_partkey") * 37, F.lit(12)).alias("bits"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN ((l_partkey * 37) & 4095 & 2048) <> 0 THEN ((l_partkey * 37) & 4095) - 4096 ELSE (l_partkey * 37) & 4095 END AS stored FROM lineitem")
def sign_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pixels.sign_extended(F.col("l_partkey") * 37, F.lit(12), F.lit(11), F.lit(True)).alias("stored"))


@query(
    f"""WITH {SAMPLES} SELECT vec_id, CAST(i // 16 AS BIGINT) AS frame_index, CAST(i % 16 AS BIGINT) AS k, ((stored % 256) + 256) % 256 AS sample FROM p"""
)
def frame_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 bytes as four 4 x 4 frames, cut from the binary and decoded with column expressions."""
    data = F.unhex(F.array_join(F.transform("stored", lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")), ""))
    rows = stored(spark, sf_dir).select("vec_id", data.alias("data"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("frame_index"))
    own, _ = frames.slice_of(F.col("data"), F.col("frame_index"), F.lit(16), F.lit(4))
    out = rows.select("vec_id", "frame_index", F.posexplode(pixels.stored_values(own, F.lit(16), 8, F.lit(True))).alias("k", "sample"))
    return out.withColumn("k", F.col("k").cast("bigint"))


@query("SELECT source, doc_id, CAST(coalesce(sum(CASE WHEN n_chars > 0 THEN n_chars + 8 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS relative_tag_start FROM documents")
def fragment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return frames.fragment_offsets(rows, ["source"], "doc_id", "n_chars").select("source", "doc_id", "relative_tag_start")


@query(
    """SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULL WHEN vec_id % 4 = 1 THEN 'Basic Offset Table entry count (3) does not match numberOfFrames (2).'
    WHEN vec_id % 4 = 2 THEN 'Invalid Basic Offset Table: offsets are not non-decreasing.'
    ELSE 'Basic Offset Table entry 1 (' || CAST(50 + label AS VARCHAR) || ') does not match fragment relative offset (40).' END AS message FROM embeddings"""
)
def bot_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id") % 4
    longs = lambda *x: F.array(*[(F.lit(i) if isinstance(i, int) else i).cast("bigint") for i in x])
    offsets = F.when(v == 0, longs(0, 40)).when(v == 1, longs(0, 40, 80)).when(v == 2, longs(40, 0)).otherwise(longs(0, F.col("label") + 50))
    return table(spark, sf_dir, "embeddings").select("vec_id", frames.offset_table_error(offsets, longs(0, 40), F.lit(2))["message"].alias("message"))


@query("SELECT p_partkey, CAST(unnest(range(3)) AS INTEGER) AS k, unnest([trim(p_name), trim(p_brand), trim(p_type)]) AS item FROM part")
def string_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat_ws("\\", F.concat(F.lit(" "), "p_name", F.lit(" ")), "p_brand", F.concat("p_type", F.lit("\0 ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(values.parts(values.text(joined.cast("binary")))).alias("k", "item"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN CAST(trunc(p_retailprice) AS BIGINT) WHEN 2 THEN NULL WHEN 3 THEN 16 + p_size % 10 ELSE -p_size END AS n FROM part")
def int_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, v = F.col("p_size"), F.col("p_partkey") % 5
    s = F.when(v == 0, F.concat(F.lit(" 00"), size.cast("string"), F.lit(" "))).when(v == 1, F.col("p_retailprice").cast("string")).when(v == 2, F.lit("ABC")).when(v == 3, F.concat(F.lit("0x1"), (size % 10).cast("string"))).otherwise(F.concat(F.lit("-"), size.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", values.to_int(s).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN CAST(p_size AS DOUBLE) * 100 ELSE -0.5::DOUBLE END AS x FROM part")
def double_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    s = F.when(v == 0, F.col("p_retailprice").cast("string")).when(v == 1, F.concat(size, F.lit("d"))).when(v == 2, F.lit("inf")).when(v == 3, F.concat(size, F.lit("e+2"))).otherwise(F.lit(" -.5 "))
    return table(spark, sf_dir, "part").select("p_partkey", values.to_double(s).alias("x"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS row_spacing, CASE WHEN p_partkey % 4 = 0 THEN 0.85::DOUBLE END AS column_spacing FROM part")
def pixel_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    s = F.when(v == 0, F.concat(size, F.lit("\\0.85"))).when(v == 1, size).when(v == 2, F.concat(size, F.lit("\\1\\2"))).otherwise(F.concat(size, F.lit("\\x")))
    pair = dataset.pixel_spacing(values.parts(s))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(pair, F.lit(0)).alias("row_spacing"), F.get(pair, F.lit(1)).alias("column_spacing"))


@query("SELECT l_orderkey, l_linenumber, printf('(%04X,%04X)', l_partkey % 65536, l_suppkey * 257 % 65536) AS tag FROM lineitem")
def tag_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = D.tag_of(F.col("l_partkey") % 65536, F.col("l_suppkey") * 257 % 65536)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", D.tag_text(tag).alias("tag"))


@query(
    """WITH d AS (SELECT * FROM (VALUES (2621456, 'US', 'Rows'), (2621457, 'US', 'Columns'), (2621488, 'DS', 'PixelSpacing'), (2621442, 'US', 'SamplesPerPixel'), (2621444, 'CS', 'PhotometricInterpretation'),
    (2621446, 'US', 'PlanarConfiguration'), (2621448, 'IS', 'NumberOfFrames')) t(tag, vr, keyword)), e AS (SELECT p_partkey, 2621440 + p_partkey % 60 AS tag FROM part)
    SELECT p_partkey, e.tag, coalesce(d.vr, CASE WHEN e.tag % 65536 = 0 THEN 'UL' END, 'UN') AS dict_vr, keyword FROM e LEFT JOIN d ON e.tag = d.tag"""
)
def vr_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.lit(0x00280000) + F.col("p_partkey") % 60).alias("tag"))
    return D.with_vr(rows).select("p_partkey", "tag", "dict_vr", "keyword")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'OW' WHEN 1 THEN 'IS' WHEN 2 THEN 'UNKNOWN' ELSE 'UT' END AS vr, p_partkey % 4 IN (0, 3) AS long_header FROM part")
def vr_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_partkey") % 4
    code = D.vr_code(F.when(v == 0, F.lit("ow")).when(v == 1, F.lit("Is")).when(v == 2, F.lit("ZZ")).otherwise(F.lit("UT")))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("vr"), D.has_long_header(code).alias("long_header"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Implicit VR Little Endian' WHEN 1 THEN 'RLE Lossless' WHEN 2 THEN 'Explicit VR Big Endian' ELSE 'Transfer Syntax 1.2.' || p_size END AS syntax_name,
    p_partkey % 4 <> 0 AS is_explicit_vr, p_partkey % 4 <> 2 AS is_little_endian, p_partkey % 4 IN (1, 3) AS is_encapsulated FROM part"""
)
def transfer_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_partkey") % 4
    uid = F.when(v == 0, F.lit(D.IMPLICIT_LE + "\0")).when(v == 1, F.lit(f" {D.RLE} ")).when(v == 2, F.lit(D.EXPLICIT_BE)).otherwise(F.concat(F.lit("1.2."), F.col("p_size").cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", uid.alias("raw_uid"))
    return D.with_syntax(rows, "raw_uid").select("p_partkey", "syntax_name", "is_explicit_vr", "is_little_endian", "is_encapsulated")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'monochrome1' WHEN 1 THEN 'paletteColor' WHEN 2 THEN 'ybrFull' WHEN 3 THEN 'unsupported' ELSE 'rgb' END AS kind,
    o_orderkey % 5 = 0 AS inverted, o_orderkey % 5 = 0 AS monochrome FROM orders"""
)
def photometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_orderkey") % 5
    kind = D.photometric(F.when(v == 0, F.lit(" monochrome1 ")).when(v == 1, F.lit("PALETTE COLOR")).when(v == 2, F.lit("ybr_full_422")).when(v == 3, F.col("o_orderpriority")).otherwise(F.lit("Rgb")))
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), D.is_inverted(kind).alias("inverted"), D.is_monochrome(kind).alias("monochrome"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return dataset.last_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    """SELECT vec_id, CASE WHEN label = 0 THEN 1.0::DOUBLE WHEN vec_id % 3 = 0 THEN CAST(label AS DOUBLE) * 0.5::DOUBLE / (64 * 1.25::DOUBLE) ELSE CAST(label AS DOUBLE) / 64 END AS ratio FROM embeddings"""
)
def aspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id") % 3
    row_spacing = F.when(v == 0, F.lit(1.25)).when(v == 1, F.lit(-1.0))
    column_spacing = F.when(v == 0, F.lit(0.5)).when(v == 1, F.lit(float("nan")))
    return table(spark, sf_dir, "embeddings").select("vec_id", display.aspect_ratio(F.lit(64), F.col("label"), row_spacing, column_spacing).alias("ratio"))


@query(
    """SELECT p_partkey, p_name || chr(10) || 'ID: ' || p_partkey || chr(10) || 'Modality: CT' || chr(10) || 'Size: ' || p_size || ' x 64' || chr(10) ||
    CASE WHEN p_partkey % 2 = 0 THEN 'WC: ' || CAST(round(p_retailprice) AS BIGINT) || '  WW: 400' ELSE 'RGB' END AS overlay FROM part"""
)
def overlay_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = display.window_text(F.col("p_retailprice"), F.lit(400.0), F.col("p_partkey") % 2 == 0, F.lit("RGB"))
    return table(spark, sf_dir, "part").select("p_partkey", display.overlay_text(F.col("p_name"), F.col("p_partkey").cast("string"), F.lit("CT"), F.col("p_size"), F.lit(64), window).alias("overlay"))


@query(
    f"""WITH {SAMPLES}, w AS (SELECT * FROM (VALUES ('Brain', 40.0::DOUBLE, 80.0::DOUBLE), ('Lung', -600.0::DOUBLE, 1500.0::DOUBLE), ('Bone', 400.0::DOUBLE, 1800.0::DOUBLE), ('Soft tissue', 40.0::DOUBLE, 400.0::DOUBLE)) t(preset, c, w))
    SELECT vec_id, i, preset, {window_sql('CAST(stored AS DOUBLE)', 'c', 'w')} AS gray FROM p, w"""
)
def preset_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = pixels.voi_window(F.col("stored").cast("double"), F.col("preset_center"), F.col("preset_width"))
    return display.with_presets(samples(spark, sf_dir)).select("vec_id", "i", "preset", gray.alias("gray"))


def _drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", (F.col("value") - 50).alias("dx"), (F.get_json_object("props", "$.k").cast("double") - 50).alias("dy"))


DRAGS = "e AS (SELECT user_id, ts, event_id, value - 50 AS dx, CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50 AS dy FROM events)"


@query(
    f"""WITH {DRAGS}, g AS (SELECT user_id, list(dx ORDER BY ts, event_id) AS xs, list(dy ORDER BY ts, event_id) AS ys FROM e GROUP BY user_id)
    SELECT user_id, round(list_reduce(ys, lambda a, y: a - y * 2.0::DOUBLE, 40.0::DOUBLE), 6) AS wc, round(list_reduce(xs, lambda a, x: greatest(1.0::DOUBLE, a + x * 2.0::DOUBLE), 400.0::DOUBLE), 6) AS ww FROM g"""
)
def drag_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded, since sums by ranges and step by step differ in their last bits."""
    got = interaction.drag_fold(_drags(spark, sf_dir), ["user_id"], ["ts", "event_id"], "dx", "dy", 40.0, 400.0)
    return got.select("user_id", F.round("wc", 6).alias("wc"), F.round("ww", 6).alias("ww"))


@query(f"WITH {DRAGS} SELECT user_id, event_id, 40.0::DOUBLE - sum(dy * 2.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS wc FROM e")
def drag_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.running_center(_drags(spark, sf_dir), ["user_id"], ["ts", "event_id"], "dy", 40.0).select("user_id", "event_id", "wc")


@query(
    """WITH g AS (SELECT user_id, list(CAST(epoch_ms(ts) // 100000 AS BIGINT) ORDER BY ts, event_id) AS t FROM events GROUP BY user_id)
    SELECT user_id, list_reduce(t, lambda a, x: {'last': CASE WHEN a['last'] IS NOT NULL AND x['last'] - a['last'] < 300 THEN NULL ELSE x['last'] END,
        'n': a['n'] + CASE WHEN a['last'] IS NOT NULL AND x['last'] - a['last'] < 300 THEN 1 ELSE 0 END}, {'last': CAST(NULL AS BIGINT), 'n': CAST(0 AS BIGINT)})['n'] AS resets
    FROM (SELECT user_id, list_transform(t, lambda x: {'last': x, 'n': CAST(0 AS BIGINT)}) AS t FROM g)"""
)
def double_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times, shrunk so that gaps lie around the 300 ms limit."""
    taps = table(spark, sf_dir, "events").withColumn("ms", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 100000))
    return interaction.double_taps(taps, ["user_id"], ["ts", "event_id"], "ms")


@query(
    """WITH e AS (SELECT user_id, event_id, ts, event_type AS d, CAST(floor(value / 25) AS BIGINT) AS f FROM events),
    l AS (SELECT *, lag(d) OVER w AS pd, lag(f) OVER w AS pf, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, n = 1 OR d IS DISTINCT FROM pd AS reinit, n = 1 OR d IS DISTINCT FROM pd OR f IS DISTINCT FROM pf AS rerender FROM l"""
)
def dataset_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("frame", F.floor(F.col("value") / 25))
    return interaction.changes(rows, ["user_id"], ["ts", "event_id"], "event_type", "frame").select("user_id", "event_id", "reinit", "rerender")


@query("SELECT user_id, batch, event_id FROM (SELECT user_id, event_id // 500 AS batch, event_id, row_number() OVER (PARTITION BY user_id, event_id // 500 ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def render_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return interaction.coalesced(rows, ["user_id"], F.floor(F.col("event_id") / 500), ["ts", "event_id"]).select("user_id", "batch", "event_id")


@query("SELECT event_id, CASE WHEN user_id % 7 > 1 THEN (user_id % 5 + event_id) % (user_id % 7) ELSE user_id % 5 END AS frame, greatest(0, least(event_id % 11 - 2, user_id % 7)) AS scrubbed FROM events")
def cine(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, n = F.col("user_id"), F.col("user_id") % 7
    return table(spark, sf_dir, "events").select("event_id", display.cine_frame(user % 5, F.col("event_id"), n).alias("frame"), display.scrubbed(F.col("event_id") % 11 - 2, n + 1).alias("scrubbed"))


@query(
    """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN CAST(label AS DOUBLE) ELSE 128.0::DOUBLE END AS wc, CASE WHEN label <= 2 THEN 256.0::DOUBLE ELSE CAST(label - 2 AS DOUBLE) END AS ww FROM embeddings"""
)
def initial_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    wc, ww = interaction.initial_window(F.lit(None).cast("double"), F.lit(None).cast("double"), F.when(F.col("vec_id") % 3 == 0, F.col("label").cast("double")), (F.col("label") - 2).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", wc.alias("wc"), ww.alias("ww"))


@query(
    """WITH x AS (SELECT CAST(unnest(range(65536)) AS BIGINT) AS i), y AS (SELECT i, i % 256 AS x, i // 256 AS y, (i % 256 - 128) * (i % 256 - 128) + (i // 256 - 128) * (i // 256 - 128) AS q FROM x)
    SELECT i, x, y, CAST(CASE WHEN q >= 110 * 110 THEN -1000 WHEN q > 95 * 95 THEN 1000 WHEN q < 30 * 30 THEN 15 ELSE 40 END + 1024 AS BIGINT) AS stored FROM y"""
)
def phantom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writer.head_phantom(spark)


def _write(row: dict, syntax: str | None = None) -> bytes:
    """An 8 x 8 signed 16-bit instance in one of four transfer syntaxes, by its id."""
    syntax = syntax or (D.EXPLICIT_LE, D.IMPLICIT_LE, D.EXPLICIT_BE, D.RLE)[row["vec_id"] % 4]
    values_ = {"SOPInstanceUID": f"1.2.{row['vec_id']}", "InstanceNumber": row["vec_id"], "SeriesNumber": row["label"], "Modality": "CT", "PatientName": f"TEST^{row['label']}", "SamplesPerPixel": 1, "PhotometricInterpretation": "MONOCHROME1" if row["vec_id"] % 3 == 0 else "MONOCHROME2", "Rows": 8, "Columns": 8, "BitsAllocated": 16, "BitsStored": 12, "HighBit": 11, "PixelRepresentation": 1, "RescaleSlope": "1.5", "RescaleIntercept": "-24", "WindowCenter": "40\\50", "WindowWidth": "400\\500", "PixelSpacing": "0.5\\0.75"}
    little = writer.packed_int16(row["stored"])
    if syntax == D.RLE:
        return writer.part10(values_, syntax, wrapped=writer.encapsulated([rle.encode_frame(little, 16)]))
    return writer.part10(values_, syntax, writer.packed_int16(row["stored"], syntax != D.EXPLICIT_BE))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, and as many tasks as a shuffle has: a small table is one split, and what is made of each row is costly."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writer.write_instances(spread(stored(spark, sf_dir, "label")), _write, "vec_id")


@query(
    f"""WITH {SAMPLES}, g AS (SELECT vec_id, i, {window_sql("(stored * 1.5::DOUBLE - 24.0::DOUBLE)", '40.0::DOUBLE', '400.0::DOUBLE')} AS gray FROM p)
    SELECT CAST(vec_id AS VARCHAR) AS file_id, CAST(i AS INTEGER) AS i, CAST(CASE WHEN vec_id % 3 = 0 THEN 255 - gray ELSE gray END AS INTEGER) AS gray FROM g"""
)
def dicom_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as files of four transfer syntaxes, parsed, cut, decoded and rendered; every pixel's red compared."""
    shown = render.render(render.frames_of(dicom.parse_files(_files(spark, sf_dir))))
    return shown.select("file_id", F.posexplode(pixels.byte_values(F.col("rgba"), 4)).alias("i", "gray"))


@query(f"WITH {SAMPLES} SELECT CAST(vec_id AS VARCHAR) AS file_id, CAST(i AS INTEGER) AS i, stored FROM p")
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every row, through RLE files, as stored."""
    files = writer.write_instances(spread(stored(spark, sf_dir, "label")), lambda row: _write(row, D.RLE), "vec_id")
    return render.pixels_of(render.decode(render.frames_of(dicom.parse_files(files)))).select("file_id", "i", "stored")


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS file_id, '1.2.' || vec_id AS sop_instance_uid, vec_id AS instance_number, CAST(label AS BIGINT) AS series_number, 'CT' AS modality, 'TEST^' || label AS patient_name, '' AS patient_id,
    CAST(8 AS BIGINT) AS "rows", CAST(8 AS BIGINT) AS "columns", CAST(1 AS BIGINT) AS number_of_frames, CAST(12 AS BIGINT) AS bits_stored, TRUE AS is_signed, vec_id % 4 <> 2 AS is_little_endian, 1.5::DOUBLE AS rescale_slope,
    -24.0::DOUBLE AS rescale_intercept, 40.0::DOUBLE AS window_center, 500.0::DOUBLE AS second_width, 0.5::DOUBLE AS row_spacing FROM embeddings"""
)
def instance_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Getters of written files, without touching pixel data."""
    names = ["sop_instance_uid", "instance_number", "series_number", "modality", "patient_name", "patient_id", "rows", "columns", "number_of_frames", "bits_stored", "is_signed", "is_little_endian", "rescale_slope", "rescale_intercept", "window_center", "window_width_presets", "pixel_spacing", "transfer_syntax_uid"]
    rows = dataset.instances(dicom.parse_files(_files(spark, sf_dir), pixels=False), names)
    return rows.select("file_id", *(n for n in names[:11]), "is_little_endian", "rescale_slope", "rescale_intercept", "window_center", F.get("window_width_presets", F.lit(1)).alias("second_width"), F.get("pixel_spacing", F.lit(0)).alias("row_spacing"))


@query(
    """WITH t(tag, vr, text) AS (VALUES ('(0008,0060)', 'CS', 'CT'), ('(0028,1050)', 'DS', '40\\50'), ('(0020,0013)', 'IS', NULL))
    SELECT CAST(vec_id AS VARCHAR) AS file_id, t.tag, t.vr, coalesce(t.text, CAST(vec_id AS VARCHAR)) AS "text" FROM embeddings, t"""
)
def element_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form of a few chosen tags; the parser hands on no others."""
    tags = [D.TAG[k] for k in ("Modality", "WindowCenter", "InstanceNumber")]
    rows = dicom.element_rows(dicom.parse_files(_files(spark, sf_dir), tags, pixels=False))
    return rows.select("file_id", D.tag_text(F.col("tag")).alias("tag"), "vr", values.text(F.col("value_bytes")).alias("text"))


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS file_id, CASE vec_id % 5 WHEN 0 THEN 'FormatException' WHEN 1 THEN 'StateError' WHEN 2 THEN 'UnsupportedError' WHEN 3 THEN 'RangeError' END AS kind,
    CASE vec_id % 5 WHEN 0 THEN 'Invalid DICOM file: Data length is less than 8 bytes.' WHEN 1 THEN 'DICOM Dataset contains no Pixel Data (7FE0,0010).'
    WHEN 2 THEN 'Unsupported Transfer Syntax: JPEG 2000 (1.2.840.10008.1.2.4.91). Uncompressed and RLE Lossless files are supported.'
    WHEN 3 THEN 'Invalid frameIndex 1 (total frames: 1).' END AS message FROM embeddings"""
)
def render_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be shown, each for one reason; frame 1 of files with two frames can."""

    def build(row: dict) -> bytes:
        v, size = row["vec_id"] % 5, {"Rows": 2, "Columns": 2, "BitsAllocated": 8}
        if v == 0:
            return b"short"
        if v == 1:
            return writer.part10(size)
        if v == 2:
            return writer.part10(size | {"NumberOfFrames": "2"}, "1.2.840.10008.1.2.4.91", wrapped=writer.encapsulated([b"\xff\x4f\xff\x51", b"\xff\x4f\xff\x51"]))
        return writer.part10(size | {"NumberOfFrames": "1" if v == 3 else "2"}, pixel_data=bytes(range(8)))

    files = writer.write_instances(table(spark, sf_dir, "embeddings").select("vec_id"), build, "vec_id")
    shown = render.render(render.frames_of(dicom.parse_files(files), F.lit(1)))
    return shown.select("file_id", F.col("error.kind").alias("kind"), F.col("error.message").alias("message"))


@query(
    f"""WITH {STORED}, x AS (SELECT vec_id, CAST(unnest(range(22)) AS BIGINT) AS i, list_concat(list_transform(stored, lambda v: ((v % 256) + 256) % 256), [0, 0]) AS b FROM s)
    SELECT CAST(vec_id AS VARCHAR) AS file_id, CAST(i AS INTEGER) AS i, CAST(CASE WHEN vec_id % 2 = 0 THEN b[3 * i + 1] ELSE b[i + 1] END AS INTEGER) AS r,
    CAST(CASE WHEN vec_id % 2 = 0 THEN b[3 * i + 2] ELSE b[22 + i + 1] END AS INTEGER) AS g, CAST(CASE WHEN vec_id % 2 = 0 THEN b[3 * i + 3] ELSE b[44 + i + 1] END AS INTEGER) AS b FROM x"""
)
def color_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """11 x 2 colour frames, their last two samples missing, written interleaved or by plane, parsed and rendered."""

    def build(row: dict) -> bytes:
        data = bytes(v % 256 for v in row["stored"])
        return writer.part10({"Rows": 2, "Columns": 11, "SamplesPerPixel": 3, "PlanarConfiguration": row["vec_id"] % 2, "PhotometricInterpretation": "RGB", "BitsAllocated": 8}, pixel_data=data)

    shown = render.render(render.frames_of(dicom.parse_files(writer.write_instances(spread(stored(spark, sf_dir)), build, "vec_id"))))
    channels = F.arrays_zip(*(pixels.byte_values(F.col("rgba"), 4, k).alias(c) for k, c in enumerate("rgb")))
    return shown.select("file_id", F.posexplode(channels).alias("i", "c")).select("file_id", "i", "c.r", "c.g", "c.b")


@query(
    f"""WITH {SAMPLES}, x AS (SELECT vec_id, i, greatest(0, least(99, ((stored % 256) + 256) % 256 - 50)) AS k FROM p)
    SELECT CAST(vec_id AS VARCHAR) AS file_id, CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS r, CAST(255 - k AS INTEGER) AS g, CAST(k * 2 AS INTEGER) AS b FROM x"""
)
def palette_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-bit palette frames, 100 entries from 50 on, tables of 8- and 16-bit entries."""

    def build(row: dict) -> bytes:
        wide = row["vec_id"] % 2
        lut = lambda f: b"".join(bytes([7, f(k)]) if wide else bytes([f(k)]) for k in range(100))
        tables = {f"{c}PaletteColorLookupTableData": lut(f) for c, f in (("Red", lambda k: k), ("Green", lambda k: 255 - k), ("Blue", lambda k: k * 2))}
        described = {f"{c}PaletteColorLookupTableDescriptor": [100, 50, 16 if wide else 8] for c in ("Red", "Green", "Blue")}
        return writer.part10({"Rows": 8, "Columns": 8, "PhotometricInterpretation": "PALETTE COLOR", "BitsAllocated": 8, **tables, **described}, pixel_data=bytes(v % 256 for v in row["stored"]))

    shown = render.render(render.frames_of(dicom.parse_files(writer.write_instances(spread(stored(spark, sf_dir)), build, "vec_id"))))
    channels = F.arrays_zip(*(pixels.byte_values(F.col("rgba"), 4, k).alias(c) for k, c in enumerate("rgb")))
    return shown.select("file_id", F.posexplode(channels).alias("i", "c")).select("file_id", "i", "c.r", "c.g", "c.b")


@query(
    f"""WITH {SAMPLES} SELECT CAST(vec_id AS VARCHAR) AS file_id, CAST(i // 16 AS BIGINT) AS frame_index, CAST(i % 16 AS INTEGER) AS k, ((stored % 256) + 256) % 256 AS stored FROM p"""
)
def multi_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four 4 x 4 frames a file, uncompressed or RLE with an offset table."""

    def build(row: dict) -> bytes:
        data = bytes(v % 256 for v in row["stored"])
        head = {"Rows": 4, "Columns": 4, "NumberOfFrames": "4", "BitsAllocated": 8}
        if row["vec_id"] % 2 == 0:
            return writer.part10(head, pixel_data=data)
        parts = [rle.encode_frame(data[i : i + 16]) for i in range(0, 64, 16)]
        offsets = [sum(len(p) + len(p) % 2 + 8 for p in parts[:i]) for i in range(4)]
        return writer.part10(head, D.RLE, wrapped=writer.encapsulated(parts, offsets))

    rows = render.pixels_of(render.decode(render.frames_of(dicom.parse_files(writer.write_instances(spread(stored(spark, sf_dir)), build, "vec_id")))))
    return rows.select("file_id", "frame_index", F.col("i").alias("k"), "stored")


@query(
    f"""WITH {SAMPLES}, u AS (SELECT vec_id, i, ((stored % 65536) + 65536) % 65536 AS u FROM p)
    SELECT vec_id, i, u % 256 AS bits8, u AS little16, CASE WHEN i < 63 THEN u ELSE 0 END AS short16, u AS big16, u * 65536 + u AS little32, (u % 256) * 16777216 + (u // 256) * 65536 + u AS big32 FROM u"""
)
def pixel_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of 8, 16 and 32 bits from binary columns, both byte orders, and data that is a byte short."""
    rows = stored(spark, sf_dir).select("vec_id", F.transform("stored", lambda x: F.pmod(x, F.lit(65536))).alias("u"))
    words = lambda f: F.unhex(F.array_join(F.transform("u", f), ""))
    high, low = (lambda x: F.lpad(F.hex(F.shiftright(x, 8)), 2, "0")), (lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0"))
    pair = lambda x: F.concat(low(x), high(x))
    data = {"bits8": (low, 8, True), "little16": (pair, 16, True), "big16": (lambda x: F.concat(high(x), low(x)), 16, False), "little32": (lambda x: F.concat(pair(x), pair(x)), 32, True), "big32": (lambda x: F.concat(low(x), high(x), high(x), low(x)), 32, False)}
    rows = rows.select("vec_id", *(words(f).alias(c) for c, (f, _, _) in data.items()))
    read = lambda c, bits, little: pixels.stored_values(c, F.lit(64), bits, F.lit(little))
    wide = rows.select("vec_id", *(read(F.col(c), bits, little).alias(c) for c, (_, bits, little) in data.items()), read(F.substring("little16", 1, 127), 16, True).alias("short16"))
    out = wide.select("vec_id", F.posexplode(F.arrays_zip(*data, "short16")).alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("bigint").alias("i"), *(f"x.{c}" for c in (*data, "short16")))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 65536 ELSE p_size % 5 END AS n, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 32768 AS BIGINT) - 32768 ELSE CAST(p_partkey % 32768 AS BIGINT) + 32768 END AS "first",
    CASE WHEN p_size % 2 = 0 THEN 8 ELSE 16 END AS bits FROM part"""
)
def palette_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of US and SS elements, both byte orders."""
    key, size = F.col("p_partkey"), F.col("p_size")
    word = lambda x: F.lpad(F.hex(x), 4, "0")
    turned = lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))
    numbers = (size % 5, key % 32768 + 32768, F.when(size % 2 == 0, F.lit(8)).otherwise(F.lit(16)))
    little = key % 3 == 0
    value = F.unhex(F.concat(*[F.when(little, turned(word(x))).otherwise(word(x)) for x in numbers]))
    e = F.struct(F.when(key % 2 == 0, F.lit("SS")).otherwise(F.lit("US")).alias("vr"), value.alias("value_bytes"), little.alias("is_little_endian"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(palette.descriptor(e, F.lit(False)))))


@query("SELECT p_partkey, p_partkey % 5 <> 4 AS compressed FROM part")
def compression_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By first bytes, else by transfer syntax."""
    v = F.col("p_partkey") % 5
    head = F.unhex(F.when(v == 0, F.lit("FF4F0000")).when(v == 1, F.lit("0000000C6A50")).when(v == 2, F.lit("FFD8")).otherwise(F.lit("0102")))
    uid = F.when(v == 3, F.lit("1.2.840.10008.1.2.1.99")).otherwise(F.lit(D.EXPLICIT_LE))
    return table(spark, sf_dir, "part").select("p_partkey", frames.looks_compressed(head, uid).alias("compressed"))


@query(
    """SELECT p_partkey, CASE WHEN p_size - 25 < 0 OR (p_partkey % 7 > 0 AND p_size - 25 >= p_partkey % 7) THEN 'Invalid frameIndex ' || (p_size - 25) || ' (total frames: ' || (p_partkey % 7) || ').' END AS message FROM part"""
)
def frame_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", frames.range_error(F.col("p_size") - 25, F.col("p_partkey") % 7)["message"].alias("message"))


@query("SELECT p_partkey, '(0028,' || printf('%04X', p_partkey % 65536) || ') LO [' || (length(p_name) + 1) || ' bytes] -> ' || p_name AS line, CASE WHEN p_partkey % 2 = 0 THEN 'Error rendering image:' || chr(10) || p_brand ELSE p_name END AS overlay FROM part")
def element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as lines of text, and overlays that an error replaces."""
    raw = F.concat("p_name", F.lit(" ")).cast("binary")
    e = F.struct(D.tag_of(F.lit(0x0028), F.col("p_partkey") % 65536).alias("tag"), F.lit("LO").alias("vr"), F.octet_length(raw).cast("bigint").alias("value_length"), raw.alias("value_bytes"), F.lit(True).alias("is_little_endian"))
    failed = F.when(F.col("p_partkey") % 2 == 0, F.struct(F.lit("StateError").alias("kind"), F.col("p_brand").alias("message")))
    return table(spark, sf_dir, "part").select("p_partkey", values.described(e).alias("line"), display.overlay_or_error(F.col("p_name"), failed).alias("overlay"))


@query(
    f"""WITH {STORED}, x AS (SELECT vec_id, CAST(unnest(range(70)) AS BIGINT) AS i, stored FROM s), v AS (SELECT vec_id, i, coalesce(stored[i + 1] * 2.0::DOUBLE + 5.0::DOUBLE, 0.0::DOUBLE) AS v FROM x), g AS (SELECT vec_id, i, {window_sql('v', '10.0::DOUBLE', '500.0::DOUBLE')} AS gray FROM v)
    SELECT vec_id, i, CASE WHEN vec_id % 2 = 0 THEN 255 - gray ELSE gray END AS gray FROM g"""
)
def monochrome_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 70 pixels with 64 values."""
    rows = stored(spark, sf_dir).select("vec_id", F.transform("stored", lambda x: pixels.rescaled(x, F.lit(2.0), F.lit(5.0))).alias("v"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(69).cast("bigint"))).alias("i"))
    return rows.select("vec_id", "i", pixels.gray_at(F.col("v"), F.col("i"), F.lit(10.0), F.lit(500.0), F.col("vec_id") % 2 == 0).alias("gray"))


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS file_id, CAST(8 AS BIGINT) AS "rows", CAST(12 AS BIGINT) AS bits_stored, CAST(11 AS BIGINT) AS high_bit, CAST(64 AS BIGINT) AS total_pixels, CAST(128 AS BIGINT) AS frame_bytes FROM embeddings"""
)
def pixel_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["rows", "columns", "samples_per_pixel", "bits_allocated", "bits_stored", "high_bit"]
    rows = dataset.instances(dicom.parse_files(_files(spark, sf_dir), pixels=False), names)
    info = pixels.pixel_info(*(F.col(n) for n in names))
    return rows.select("file_id", info.alias("x")).select("file_id", "x.rows", "x.bits_stored", "x.high_bit", "x.total_pixels", "x.frame_bytes")


@query(
    """SELECT p_partkey, CASE WHEN p_size < 8 THEN 'Invalid DICOM file: Data length is less than 8 bytes.' WHEN p_partkey % 2 = 0 THEN 'Invalid DICOM file: Truncated or missing DICM header (' || p_size || ' bytes).' END AS message,
    p_size >= 8 AND p_partkey % 2 = 1 AS marked FROM part"""
)
def input_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and marker checks as expressions."""
    size = F.col("p_size")
    content = F.when((size >= 8) & (F.col("p_partkey") % 2 == 1), F.concat(F.repeat(F.lit("x"), 128), F.lit("DICM"))).otherwise(F.repeat(F.lit("x"), size)).cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", dicom.size_error(content)["message"].alias("message"), dicom.has_marker(content).alias("marked"))


@query(
    f"""WITH {SAMPLES}, r AS (SELECT vec_id, greatest(max(stored) - min(stored), 1) AS w FROM p GROUP BY vec_id)
    SELECT CAST(vec_id AS VARCHAR) AS file_id, CASE WHEN vec_id % 2 = 0 THEN 128.0::DOUBLE ELSE 7.5::DOUBLE END AS wc, CASE WHEN vec_id % 2 = 0 THEN CAST(w AS DOUBLE) ELSE 256.0::DOUBLE END AS ww FROM r"""
)
def render_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window a frame is shown with: automatic where the file's width is 0, else its own or the default."""

    def build(row: dict) -> bytes:
        head = {"Rows": 8, "Columns": 8, "PixelRepresentation": 1}
        own = {"WindowWidth": "0"} if row["vec_id"] % 2 == 0 else {"WindowCenter": "7.5"}
        return writer.part10(head | own, pixel_data=writer.packed_int16(row["stored"]))

    return render.render(render.frames_of(dicom.parse_files(writer.write_instances(spread(stored(spark, sf_dir)), build, "vec_id")))).select("file_id", "wc", "ww")


GETTERS = {"study_date": "StudyDate", "study_description": "StudyDescription", "series_description": "SeriesDescription", "study_instance_uid": "StudyInstanceUID", "study_time": "StudyTime", "series_instance_uid": "SeriesInstanceUID", "sop_class_uid": "SOPClassUID", "acquisition_date": "AcquisitionDate", "acquisition_time": "AcquisitionTime", "institution_name": "InstitutionName", "manufacturer": "Manufacturer"}
#: What SQL says of absent texts that have a default.
MISSING = dict.fromkeys(("study_date", "study_description", "series_description"), "ELSE ''")


@query(
    "SELECT CAST(vec_id AS VARCHAR) AS file_id, "
    + ", ".join(f"CASE WHEN (vec_id + {i}) % 3 > 0 THEN '{i}.' || vec_id {MISSING.get(k, '')} END AS {k}" for i, k in enumerate(GETTERS))
    + """, CASE WHEN vec_id % 2 = 0 THEN CAST(label AS DOUBLE) + 0.5::DOUBLE END AS slice_thickness, CAST(CASE WHEN vec_id % 2 = 1 THEN label - 5 END AS BIGINT) AS pixel_padding_value, CAST(CASE WHEN vec_id % 4 = 1 THEN label - 9 END AS BIGINT) AS pixel_padding_range_limit,
    vec_id % 4 <> 2 AS is_little_endian, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(label AS DOUBLE) END AS first_center, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 2 END AS centers FROM embeddings"""
)
def other_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Getters of files that hold a tag or leave it out, in all byte orders."""

    def build(row: dict) -> bytes:
        v, label = row["vec_id"], row["label"]
        held = {k: f"{i}.{v}" for i, k in enumerate(GETTERS.values()) if (v + i) % 3 > 0}
        held |= {"SliceThickness": f"{label}.5"} if v % 2 == 0 else {"PixelRepresentation": 1}
        held |= {"WindowCenter": f"{label}\\x\\80"} if v % 3 else {}
        syntax = (D.EXPLICIT_LE, D.IMPLICIT_LE, D.EXPLICIT_BE, D.EXPLICIT_LE)[v % 4]
        rows = [(D.TAG[k], part10.implicit_vr(D.TAG[k]), x) for k, x in held.items()]
        vr = "SS" if syntax != D.IMPLICIT_LE else part10.implicit_vr(D.TAG["PixelPaddingValue"])
        pad = lambda x: x if vr == "SS" else x & 0xFFFF
        rows += [(D.TAG["PixelPaddingValue"], "SS", pad(label - 5))] if v % 2 else []
        rows += [(D.TAG["PixelPaddingRangeLimit"], "SS", pad(label - 9))] if v % 4 == 1 else []
        return writer.part10(rows, D.EXPLICIT_LE if v % 2 else syntax)

    names = [*GETTERS, "slice_thickness", "pixel_padding_value", "pixel_padding_range_limit", "is_little_endian", "window_center_presets"]
    rows = dataset.instances(dicom.parse_files(writer.write_instances(table(spark, sf_dir, "embeddings").select("vec_id", "label"), build, "vec_id")), names)
    return rows.select("file_id", *names[:-1], F.get("window_center_presets", F.lit(0)).alias("first_center"), F.size("window_center_presets").alias("centers"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS file_id, CAST(unnest([1, 2, 3, 4, 5, 6]) AS INTEGER) AS ordinal, unnest(['DS', 'IS', 'LO', 'US', 'SL', 'FD']) AS vr,
    unnest([CAST(p_size AS VARCHAR) || '.5\\x\\7', CAST(p_size AS VARCHAR), p_name, NULL, NULL, NULL]) AS "text", unnest([p_size, p_size, NULL, p_partkey % 65536, -p_size, NULL]) AS whole,
    unnest([p_size + 0.5::DOUBLE, CAST(p_size AS DOUBLE), NULL, NULL, NULL, p_retailprice]) AS "decimal", unnest([2, 1, 0, NULL, NULL, NULL]) AS n_decimals FROM part"""
)
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of written elements as the parser decodes them: text, whole number, decimal number and list."""

    def build(row: dict) -> bytes:
        n = row["p_size"]
        return writer.part10([(0x00091000 + i, vr, x) for i, (vr, x) in enumerate((("DS", f"{n}.5\\x\\7"), ("IS", f" {n}"), ("LO", row["p_name"]), ("US", row["p_partkey"] % 65536), ("SL", -n), ("FD", row["p_retailprice"])))], (D.EXPLICIT_LE, D.EXPLICIT_BE)[n % 2])

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"), "p_name", "p_retailprice")
    got = dicom.element_rows(dicom.parse_files(writer.write_instances(rows, build, "p_partkey"))).where("ordinal > 0")
    text = F.when(~F.col("vr").isin("US", "SL", "FD"), F.col("text"))
    whole, decimal = (F.when(F.col("vr").isin(*vrs), F.col(c)).alias(c) for c, vrs in (("whole", ("DS", "IS", "US", "SL")), ("decimal", ("DS", "IS", "FD"))))
    return got.select("file_id", F.col("ordinal").cast("int").alias("ordinal"), "vr", text.alias("text"), whole, decimal, F.when(text.isNotNull(), F.size("decimals")).alias("n_decimals"))


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS file_id, 'P' || (vec_id + 10000000) AS patient_id, CASE vec_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 2 ELSE 3 END AS n_elements,
    CAST(CASE vec_id % 5 WHEN 1 THEN 100 WHEN 2 THEN 8 + 10 + 8 WHEN 3 THEN 0 END AS BIGINT) AS value_length, CASE vec_id % 5 WHEN 1 THEN 4 WHEN 2 THEN 8 + 10 + 8 WHEN 3 THEN 0 END AS n_bytes FROM embeddings"""
)
def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header cut short, a value cut short, a sequence of undefined length, another element of undefined length, a whole file."""

    def build(row: dict) -> bytes:
        own = writer.element(D.TAG["PatientID"], f"P{row['vec_id'] + 10000000}", "LO")
        head = writer.part10({})
        undefined = b"\xff\xff\xff\xff"
        inner = writer.element(0x00080060, "CT", "CS")
        item = b"\xfe\xff\x00\xe0" + len(inner).to_bytes(4, "little") + inner
        sequence = b"\x08\x00\x40\x11SQ\0\0" + undefined + item + b"\xfe\xff\xdd\xe0\0\0\0\0"
        other = b"\x08\x00\x41\x11OB\0\0" + undefined
        tail = b"\x20\x00\x0d\x00OB\0\0\x64\0\0\0abcd"
        return (head + own + b"\x20\x00\x0d", head + own + tail, head + sequence + own, head + other + own, head + own)[row["vec_id"] % 5]

    rows = dicom.parse_files(writer.write_instances(table(spark, sf_dir, "embeddings").select("vec_id"), build, "vec_id"))
    odd = F.get(F.filter("elements", lambda e: ~e["tag"].isin(D.TAG["PatientID"], D.TAG["TransferSyntaxUID"])), F.lit(0))
    found = dataset.with_dataset(rows)
    return found.select("file_id", dataset.getters()["patient_id"].alias("patient_id"), F.size("elements").alias("n_elements"), odd["value_length"].alias("value_length"), F.octet_length(odd["value_bytes"]).alias("n_bytes"))


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS file_id, CASE vec_id % 4 WHEN 0 THEN 'UnsupportedError' WHEN 1 THEN 'RangeError' WHEN 2 THEN 'StateError' END AS image_error,
    CASE vec_id % 4 WHEN 0 THEN 'RangeError' WHEN 1 THEN 'RangeError' END AS rgba_error, CASE vec_id % 4 WHEN 3 THEN 16 END AS n_bytes, CASE vec_id % 4 WHEN 3 THEN 255 * 4 END AS alpha FROM embeddings"""
)
def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of checks for images and for bare RGBA: a compressed file with too few frames, a native one, one without an area, a good one."""

    def build(row: dict) -> bytes:
        v, size = row["vec_id"] % 4, {"Rows": 2, "Columns": 2, "BitsAllocated": 8}
        if v == 0:
            return writer.part10(size, "1.2.840.10008.1.2.4.90", wrapped=writer.encapsulated([b"\xff\x4f\xff\x51"]))
        if v == 2:
            return writer.part10({"BitsAllocated": 8, "NumberOfFrames": "6"}, pixel_data=bytes(4))
        return writer.part10(size | {"NumberOfFrames": "6" if v == 3 else "1"}, pixel_data=bytes(range(24)))

    parsed = dicom.parse_files(writer.write_instances(table(spark, sf_dir, "embeddings").select("vec_id"), build, "vec_id"))
    image = render.render_images(parsed, F.lit(5)).select("file_id", F.col("error.kind").alias("image_error"), F.octet_length("rgba").alias("n_bytes"), F.aggregate(pixels.byte_values(F.col("rgba"), 4, 3), F.lit(0), lambda a, b: a + b).alias("alpha"))
    bare = render.render(render.frames_of(parsed, F.lit(5))).select("file_id", F.col("error.kind").alias("rgba_error"))
    return image.join(bare, "file_id")


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS file_id, CASE WHEN vec_id % 9 < 2 THEN 'UnsupportedError' WHEN vec_id % 9 < 8 THEN 'FormatException' END AS kind, CASE vec_id % 9
    WHEN 0 THEN 'Segmented Palette Color Lookup Table Data (0028,1221-1223) is unsupported. Only direct Palette Color LUT Data (0028,1201-1203) is supported.'
    WHEN 1 THEN 'Enhanced Palette Color Lookup Table Sequence (0028,140B) is unsupported. Only direct Palette Color LUT Data (0028,1201-1203) is supported.'
    WHEN 2 THEN 'PALETTE COLOR dataset missing Green Palette Color Lookup Table Descriptor (0028,1102).' WHEN 3 THEN 'PALETTE COLOR dataset missing Blue Palette Color Lookup Table Data (0028,1203).'
    WHEN 4 THEN 'Incomplete Palette Color LUT descriptor ((0028,1101)): expected at least 6 bytes, found 4 bytes.' WHEN 5 THEN 'Invalid Palette Color LUT bitsPerEntry: 12. Must be 8 or 16.'
    WHEN 6 THEN 'Inconsistent Palette Color LUT descriptors across red, green and blue.' WHEN 7 THEN 'Truncated Red Palette Color LUT data: expected at least 9 bytes, found 4.' END AS message, CASE WHEN vec_id % 9 = 8 THEN 3 END AS n FROM embeddings"""
)
def palette_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung of the palette ladder, and equal descriptors that pass it."""

    def build(row: dict) -> bytes:
        v, data, described = row["vec_id"] % 9, "PaletteColorLookupTableData", "PaletteColorLookupTableDescriptor"
        shape = {5: [3, 0, 12], 7: [9, 0, 8]}.get(v, [3, 0, 8])
        held = {f"{c}{described}": shape for c in palette.CHANNELS} | {f"{c}{data}": b"\x01\x02\x03\x04" for c in palette.CHANNELS}
        held |= {0: {"SegmentedRed" + data: b"ab"}, 1: {"EnhancedPaletteColorLookupTableSequence": b"ab"}, 4: {"Red" + described: [3, 0]}, 6: {"Blue" + described: [2, 0, 8]}}.get(v, {})
        gone = {0: "Red" + data, 1: "Green" + data, 2: "Green" + described, 3: "Blue" + data}.get(v)
        return writer.part10({"Rows": 1, "Columns": 4, "BitsAllocated": 8, "PhotometricInterpretation": "PALETTE COLOR"} | {k: x for k, x in held.items() if k != gone}, pixel_data=bytes(4))

    rows = dataset.with_dataset(dicom.parse_files(writer.write_instances(table(spark, sf_dir, "embeddings").select("vec_id"), build, "vec_id")))
    found = rows.select("file_id", palette.palette("dataset").alias("p"))
    return found.select("file_id", "p.error.kind", "p.error.message", "p.table.n")


@query(
    f"""WITH {STORED}, x AS (SELECT vec_id, CAST(unnest(range(22)) AS BIGINT) AS i, list_concat(list_transform(stored, lambda v: ((v % 256) + 256) % 256), [0, 0]) AS b FROM s)
    SELECT CAST(vec_id AS VARCHAR) AS file_id, CAST(i AS INTEGER) AS i, CAST(b[3 * i + 1] AS INTEGER) AS r, CAST(b[3 * i + 2] AS INTEGER) AS g, CAST(b[3 * i + 3] AS INTEGER) AS b, 255 AS a FROM x"""
)
def rle_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved 8-bit colour through RLE, with its alpha."""

    def build(row: dict) -> bytes:
        data = bytes(v % 256 for v in row["stored"]) + bytes(2)
        return writer.part10({"Rows": 2, "Columns": 11, "SamplesPerPixel": 3, "PhotometricInterpretation": "RGB", "BitsAllocated": 8}, D.RLE, wrapped=writer.encapsulated([rle.encode_frame(data, 8, 3)]))

    shown = render.render(render.frames_of(dicom.parse_files(writer.write_instances(spread(stored(spark, sf_dir)), build, "vec_id"))))
    channels = F.arrays_zip(*(pixels.byte_values(F.col("rgba"), 4, k).alias(c) for k, c in enumerate("rgba")))
    return shown.select("file_id", F.posexplode(channels).alias("i", "c")).select("file_id", "i", "c.r", "c.g", "c.b", "c.a")


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS file_id, CASE vec_id % 8 WHEN 0 THEN 'Unsupported RLE bytesPerSample: 4' WHEN 1 THEN '16-bit RLE grayscale requires 2 segments (got 1).' WHEN 2 THEN 'Unsupported RLE multi-sample format with 2 bytes/sample and 6 segments.'
    WHEN 3 THEN 'Unsupported RLE samplesPerPixel: 4' WHEN 4 THEN 'Invalid RLE frame: Header must be at least 64 bytes (got 6 bytes).' WHEN 5 THEN 'Unsupported BitsAllocated: 12'
    WHEN 6 THEN 'Invalid RLE DICOM data: Pixel Data (7FE0,0010) is explicit length. RLE Lossless requires encapsulated undefined length data per DICOM PS3.5.' END AS message,
    CASE vec_id % 8 WHEN 7 THEN vec_id % 256 END AS first_sample FROM embeddings"""
)
def rle_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RLE layouts that are no frame, odd bit depths, RLE of defined length, and one frame in two fragments."""

    def build(row: dict) -> bytes:
        v, size = row["vec_id"] % 8, {"Rows": 1, "Columns": 2}
        if v == 5:
            return writer.part10(size | {"BitsAllocated": 12}, pixel_data=bytes(4))
        if v == 6:
            return writer.part10(size | {"BitsAllocated": 8}, D.RLE, pixel_data=bytes(2))
        bits, samples = {0: (32, 1), 1: (16, 1), 2: (16, 3), 3: (8, 4)}.get(v, (8, 1))
        whole = rle.encode_frame(bytes(2), 8) if v == 1 else rle.encode_frame(bytes([row["vec_id"] % 256]) * (2 * samples * bits // 8), bits, samples)
        parts = [b"short!"] if v == 4 else [whole[:64], whole[64:]] if v == 7 else [whole]
        return writer.part10(size | {"BitsAllocated": bits, "SamplesPerPixel": samples}, D.RLE, wrapped=writer.encapsulated(parts))

    got = render.decode(render.frames_of(dicom.parse_files(writer.write_instances(table(spark, sf_dir, "embeddings").select("vec_id"), build, "vec_id"))))
    return got.select("file_id", F.col("error.message").alias("message"), F.get("stored", F.lit(0)).alias("first_sample"))


@query(
    f"""WITH {SAMPLES}, r AS (SELECT vec_id, coalesce(max(stored) FILTER (stored NOT BETWEEN CASE WHEN vec_id % 2 = 0 THEN -600 ELSE -50 END AND -50), max(stored)) AS hi, coalesce(min(stored) FILTER (stored NOT BETWEEN CASE WHEN vec_id % 2 = 0 THEN -600 ELSE -50 END AND -50), min(stored)) AS lo FROM p GROUP BY vec_id)
    SELECT CAST(vec_id AS VARCHAR) AS file_id, 128.0::DOUBLE AS wc, CAST(greatest(CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 1) AS DOUBLE) AS ww FROM r"""
)
def padded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic windows of files that name a padding value, or a range of them."""

    def build(row: dict) -> bytes:
        rows = [(D.TAG["Rows"], "US", 8), (D.TAG["Columns"], "US", 8), (D.TAG["PixelRepresentation"], "US", 1), (D.TAG["WindowWidth"], "DS", "0"), (D.TAG["PixelPaddingValue"], "SS", -50)]
        rows += [(D.TAG["PixelPaddingRangeLimit"], "SS", -600)] if row["vec_id"] % 2 == 0 else []
        return writer.part10(rows, pixel_data=writer.packed_int16(row["stored"]))

    return render.render(render.frames_of(dicom.parse_files(writer.write_instances(spread(stored(spark, sf_dir)), build, "vec_id")))).select("file_id", "wc", "ww")


@query(
    f"""WITH {DRAGS}, k AS (SELECT e.*, v.event_type FROM e JOIN events v USING (event_id)), t AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = (SELECT min(event_type) FROM events)) AS t FROM k GROUP BY user_id),
    d AS (SELECT k.user_id, ts, event_id, CASE WHEN (ts, event_id) = t THEN 0 ELSE dx END AS dx, CASE WHEN (ts, event_id) = t THEN 0 ELSE dy END AS dy FROM k JOIN t USING (user_id) WHERE t IS NULL OR (ts, event_id) >= t),
    g AS (SELECT user_id, list(dx ORDER BY ts, event_id) AS xs, list(dy ORDER BY ts, event_id) AS ys FROM d GROUP BY user_id)
    SELECT user_id, round(list_reduce(ys, lambda a, y: a - y * 2.0::DOUBLE, 40.0::DOUBLE), 6) AS wc, round(list_reduce(xs, lambda a, x: greatest(1.0::DOUBLE, a + x * 2.0::DOUBLE), 400.0::DOUBLE), 6) AS ww FROM g"""
)
def window_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each viewer's window by the drags since its last reset; the alphabetically first kind of event stands for resets."""
    rows = _drags(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    first = table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    since = interaction.drags_since_reset(rows, ["user_id"], ["ts", "event_id"], "event_type", [first])
    reset = F.col("event_type") == first
    since = since.select("user_id", "ts", "event_id", F.when(reset, F.lit(0.0)).otherwise(F.col("dx")).alias("dx"), F.when(reset, F.lit(0.0)).otherwise(F.col("dy")).alias("dy"))
    got = interaction.drag_fold(since, ["user_id"], ["ts", "event_id"], "dx", "dy", 40.0, 400.0)
    return got.select("user_id", F.round("wc", 6).alias("wc"), F.round("ww", 6).alias("ww"))


@query(
    """SELECT p_partkey, greatest(0.5::DOUBLE, least(5.0::DOUBLE, p_size / 20.0::DOUBLE * 1.5::DOUBLE)) AS pinched, CAST(greatest(p_size, 2) AS DOUBLE) AS scale, CAST(p_partkey AS DOUBLE) AS x, CAST(-p_size AS DOUBLE) AS y FROM part"""
)
def view_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom within its limits, and scale and place of a view's matrix."""
    size, key = F.col("p_size").cast("double"), F.col("p_partkey").cast("double")
    d = lambda *x: F.array(*[F.lit(float(v)) if isinstance(v, int) else v for v in x])
    view = display.view_of(d(size, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1, 0, key, -size, 0, 1))
    return table(spark, sf_dir, "part").select("p_partkey", display.pinched(size / 20.0, F.lit(1.5)).alias("pinched"), F.inline(F.array(view)))
