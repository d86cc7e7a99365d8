"""Helpers shared by the text operators of this subpackage.

Row data moves as *packed blocks*: a task turns a run of documents into
numpy arrays, deals them by hash into buckets and ships one compact binary
row per (block, bucket).  Spark partitions and shuffles those rows; a bucket
is a fixed share of a hash range, so its size is bounded by choosing the
number of buckets from the size of the input (`bucket_count`).
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from privtab.session import checkpoint_dir

#: Words gathered into one block before it is dealt out; bounds a task's memory
#: (a single longer document still makes one block).
BLOCK_WORDS = 500_000
#: Text bytes that one bucket or cell may stand for: a full one takes a task of
#: the language model about 400 MB, one of the repeated windows about 250 MB.
BUCKET_BYTES = 8 << 20
#: Least number of buckets; a power of two, as all counts of buckets are.
LEAST_BUCKETS = 256

#: Bytes that end a word for `[^\x20\x09-\x0D]+` are what bytes.split() splits at.
SPACES = b" \t\n\r\x0b\x0c"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder.  Spark's file system
    removes the folder when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, survives lost executors, keeps column pruning."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, one scan on the executors."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


def bucket_count(size: int, least: int = LEAST_BUCKETS) -> int:
    """A power of two so that a bucket stands for at most BUCKET_BYTES."""
    n = least
    while n * BUCKET_BYTES < size:
        n *= 2
    return n


def cell_of(key: Column, cells: int) -> Column:
    """Cell of a long key: its bytes folded together, modulo a power of two."""
    key = F.coalesce(key.cast("long"), F.lit(0))
    folded = key
    for shift in (8, 16, 24, 32, 48):
        folded = folded.bitwiseXOR(F.shiftright(key, shift))
    return folded.bitwiseAND(F.lit(cells - 1)).cast("int")


def cell_array(key: np.ndarray, cells: int) -> np.ndarray:
    """`cell_of` for a numpy array of int64."""
    folded = key.copy()
    for shift in (8, 16, 24, 32, 48):
        folded ^= key >> shift
    return folded & (cells - 1)


def words_exact(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged."""
    return text.split()


def words_lower(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then words `[^\\x20\\x09-\\x0D]+`."""
    return text.lower().split()


_ALNUM = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32
    for c in range(256))


def words_alnum(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    return text.translate(_ALNUM).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp value of every ``width`` consecutive words (mod 2^64)."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    acc = hashes[:n].copy()
    for j in range(1, width):
        acc *= _BASE
        acc += hashes[j:j + n]
    return mix(acc)


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Flat places where a window of ``width`` words starts inside one document."""
    usable = np.maximum(counts - (width - 1), 0)
    offsets = np.cumsum(counts) - counts
    shift = np.repeat(offsets - (np.cumsum(usable) - usable), usable)
    return np.arange(int(usable.sum())) + shift


def release() -> None:
    """Give freed memory back: workers live on, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def token_blocks(batches, cut, target: int = BLOCK_WORDS, columns: tuple[str, ...] = ("doc_id",)):
    """Yield (columns as numpy arrays, word counts, word hashes) of runs of documents.

    ``cut`` turns the UTF-8 bytes of a text into words.  A null text has none."""
    kept, counts, hashes, total = [[] for _ in columns], [], [], 0

    def block():
        return ([np.concatenate(k) for k in kept], np.asarray(counts, np.int64),
                np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))

    for batch in batches:
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        texts = batch.column("text").cast(pa.large_binary())
        since = 0
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            words = cut(text) if text else []
            counts.append(len(words))
            if words:
                hashes.append(word_hashes(words))
            total += len(words)
            if total >= target:
                for k, v in zip(kept, values):
                    k.append(v[since:i + 1])
                since = i + 1
                yield block()
                kept, counts, hashes, total = [[] for _ in columns], [], [], 0
                release()
        for k, v in zip(kept, values):
            k.append(v[since:])
    if counts:
        yield block()


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: small numbers take about a byte."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return _PACK.compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(_UNPACK.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def deltas(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[1:] = values[1:] - values[:-1]
    return out


def undelta(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)


def zip_text(text: bytes | None) -> bytes | None:
    return None if text is None else _PACK.compress(text)


def unzip_text(data: bytes | None) -> bytes | None:
    return None if data is None else _UNPACK.decompress(data)


def carried(columns: tuple[str, ...]) -> Column:
    """A struct of columns that an operator hands through; their names cannot clash."""
    return F.struct(*[F.col(c) for c in columns] or [F.lit(0).alias("none")]).alias("carry")


def row_type(df: DataFrame, *columns: str) -> StructType:
    """The type of some columns, to which an operator adds its own."""
    return StructType([df.schema[c] for c in columns])


def zipped_texts(docs: DataFrame) -> DataFrame:
    """The same rows with column ``text`` compressed to binary, for a shuffle."""
    schema = StructType([StructField(f.name, BinaryType() if f.name == "text" else f.dataType, True)
                         for f in docs.schema])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.large_binary())
            packed = pa.array([zip_text(texts[i].as_py()) for i in range(len(texts))], pa.binary())
            yield batch.set_column(at, "text", packed)

    return docs.mapInArrow(run, schema)


def sliced(batches, rows: int):
    """Arrow batches of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
