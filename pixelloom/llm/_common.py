"""What the operators share: shared-folder tables, byte views of Arrow columns, hashed n-gram sums."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_tables: list[tuple[SparkSession, str]] = []  # what `stored` has written and nothing has deleted


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where it is unset (a local test session) a temporary folder is made; a session with
    remote executors and no shared folder is an error, since a local folder would lose data.
    """
    global _own_dir
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="pixelloom-")
    return _own_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pixelloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    _tables.append((spark, path))
    return back


def mark() -> int:
    """A place in the list of stored tables, for `sweep`."""
    return len(_tables)


def sweep(begin: int, keep: DataFrame | None = None) -> None:
    """Delete the tables stored since `begin`, but for `keep`: for when nothing that reads them is still to run."""
    kept = getattr(keep, "stored_at", None)
    for spark, path in _tables[begin:]:
        if path != kept:
            _delete(spark, path)
    _tables[begin:] = [x for x in _tables[begin:] if x[1] == kept]


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that `stored` gave, when nothing will read it again."""
    _tables[:] = [x for x in _tables if x[1] != df.stored_at]
    _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only what a text kernel needs, under fixed names, so that other columns can't clash."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *more)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes back to back and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, where, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words (runs between ASCII white space) of a column of texts, dictionary encoded, and how many each text has."""
    split = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
    flat = split.flatten()
    solid = pc.greater(pc.binary_length(flat), 0)  # the ends of a text give empty words
    ends = np.append(0, np.cumsum(solid.to_numpy(zero_copy_only=False)))
    cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
    return flat.filter(solid).cast(pa.large_binary()).dictionary_encode(), np.diff(ends[cuts])


def word_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each word of UTF-8 texts back to back; equal words have equal numbers."""
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())])
    return words_of(texts)[0].indices.to_numpy()


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about `limit` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def padded(data: np.ndarray, offsets: np.ndarray, pad: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with `pad` bytes of `fill` before each and after the last; returns the starts of those pads."""
    raw, ends = data.tobytes(), offsets.tolist()
    gap = bytes([fill]) * pad
    joined = gap + gap.join([raw[a:b] for a, b in zip(ends, ends[1:])]) + gap
    starts = offsets[:-1] + pad * np.arange(len(offsets) - 1)
    return np.frombuffer(joined, np.uint8), starts


def gram_hashes(buf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in [0, 2**bits) of the byte pairs and byte triples that start at each byte but the last two."""
    b = buf.astype(np.uint32)
    two = (b[:-2] << np.uint32(8)) | b[1:-1]
    three = (two << np.uint32(8)) | b[2:]
    mix, shift = np.uint32(2654435761), np.uint32(32 - bits)
    return ((two + np.uint32(0x9E3779)) * mix) >> shift, (three * mix) >> shift


def segment_sums(hashes: list[np.ndarray], starts: np.ndarray, weights: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Sum weights[h] over each segment [starts[i], starts[i+1]) in blocks, so that memory has a bound."""
    out = np.zeros((len(starts), weights.shape[1]))
    total = len(hashes[0])
    for p in range(0, total, block):
        q = min(total, p + block)
        first = int(np.searchsorted(starts, p, "right")) - 1
        last = int(np.searchsorted(starts, q, "left"))
        local = np.maximum(starts[first:last] - p, 0)
        got = weights[hashes[0][p:q]]
        for h in hashes[1:]:
            got = got + weights[h[p:q]]
        out[first:last] += np.add.reduceat(got, local, axis=0)
    return out


def pick(salt: int, *columns: Column) -> Column:
    """A number from 0 to 1 for each row, by a hash of `columns` and of the row's place in its files.

    The same on every run over the same files, and evenly spread even where ids and texts repeat without end, so that a
    share of the rows is a share in each case.
    """
    return F.pmod(F.xxhash64(F.lit(salt), *columns, F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))


def filtered(docs: DataFrame, text_col: str, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int = 1 << 20) -> DataFrame:
    """docs' rows, all columns, whose text `keep` accepts; keep takes the texts' bytes and offsets and gives a mask."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for i, j in slices(offsets, limit):
                yield batch.slice(i, j - i).filter(pa.array(keep(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))

    return docs.mapInArrow(run, docs.schema)
