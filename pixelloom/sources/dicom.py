"""Files to parsed rows: one row for each file, with its elements as an array and any error as data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.errors import FORMAT, ImageError, error, fail_fast, first_error
from pixelloom.sources import RUN, part10

FRAGMENT = "struct<index: int, relative_tag_start: bigint, payload: binary>"
ENCAPSULATED = f"struct<bot_offsets: array<bigint>, fragments: array<{FRAGMENT}>>"
ELEMENT = f"struct<ordinal: int, tag: bigint, vr: string, value_length: bigint, value_bytes: binary, is_little_endian: boolean, is_last: boolean, text: string, whole: bigint, decimal: double, decimals: array<double>, encapsulated: {ENCAPSULATED}>"
PARSED = f"file_id string, elements array<{ELEMENT}>, error struct<kind: string, message: string>"
_FRAGMENT = pa.struct([("index", pa.int32()), ("relative_tag_start", pa.int64()), ("payload", pa.binary())])
_ENCAPSULATED = pa.struct([("bot_offsets", pa.list_(pa.int64())), ("fragments", pa.list_(_FRAGMENT))])
_ELEMENT = pa.struct([("ordinal", pa.int32()), ("tag", pa.int64()), ("vr", pa.string()), ("value_length", pa.int64()), ("value_bytes", pa.binary()), ("is_little_endian", pa.bool_()), ("is_last", pa.bool_()), ("text", pa.string()), ("whole", pa.int64()), ("decimal", pa.float64()), ("decimals", pa.list_(pa.float64())), ("encapsulated", _ENCAPSULATED)])
_ERROR = pa.struct([("kind", pa.string()), ("message", pa.string())])
ELEMENTS = 1 << 13  # elements parsed before they are handed on, as each is far larger as objects than in its file


def read_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """file_id (the path) and content of files; Spark's reader, so any store it knows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("file_id"), "content")


def stream_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The same as a stream of new files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file_id"), "content")


def parse_files(files: DataFrame, tags: Sequence[int] | None = None, pixels: bool = True, mode: str = "permissive") -> DataFrame:
    """file_id, elements and error. `tags` keeps only those elements; without `pixels` parsing stops before the pixel data.

    mode "failfast" raises on the first file that can't be parsed; otherwise it has an error and no elements.
    """
    wanted = frozenset(tags) if tags is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, elements, errors, held, n = 0, [], [], 0, 0
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py() or b""
                try:
                    found, failed = part10.parse(content, pixels), None
                except ImageError as e:
                    found, failed = [], e.row()
                last = {e.tag: i for i, e in enumerate(found)}
                elements.append([{**vars(e), **part10.decoded(e), "ordinal": i, "is_last": last[e.tag] == i} for i, e in enumerate(found) if wanted is None or e.tag in wanted])
                errors.append(failed)
                held, n = held + len(content), n + len(elements[-1]) + 1
                if held >= RUN or n >= ELEMENTS or i == batch.num_rows - 1:  # answered by bytes, so that no array outgrows its offsets
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i + 1 - begin), pa.array(elements, pa.list_(_ELEMENT)), pa.array(errors, _ERROR)], names=["file_id", "elements", "error"])
                    begin, elements, errors, held, n = i + 1, [], [], 0, 0

    parsed = files.select(F.col("file_id").cast("string"), "content").mapInArrow(run, PARSED)
    return parsed.withColumn("error", fail_fast(F.col("error"))) if mode == "failfast" else parsed


def element_rows(parsed: DataFrame) -> DataFrame:
    """The long form: a row for each file and element, with group and element number, and its decoded values."""
    rows = parsed.select("file_id", F.inline("elements"))
    return rows.withColumn("group", F.shiftright("tag", 16).cast("int")).withColumn("element", F.col("tag").bitwiseAND(F.lit(0xFFFF)).cast("int"))


def has_marker(content: Column) -> Column:
    """Whether a file has the preamble and its marker."""
    return F.coalesce(F.substring(content, 129, 4) == F.lit(b"DICM").cast("binary"), F.lit(False))


def size_error(content: Column) -> Column:
    """The error of files too short to be read, as the parser gives it, without parsing."""
    n = F.octet_length(content)
    header = F.concat(F.lit("Invalid DICOM file: Truncated or missing DICM header ("), n.cast("string"), F.lit(" bytes)."))
    return first_error((n < 8, error(FORMAT, "Invalid DICOM file: Data length is less than 8 bytes.")), (~has_marker(content) & (n < 132), error(FORMAT, header)))
