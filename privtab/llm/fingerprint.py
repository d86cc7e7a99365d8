"""Document fingerprints from prefix polynomial hashes.

For a text of n code points the prefix arrays S[i] = sum of c[j] B^j (j < i),
modulo a Mersenne prime and for two bases, answer whether any two spans are
equal in constant time, and by binary search the longest common extension of
two places (`Prefixes.common`).

A fingerprint is the length, the two hashes of the whole text, and a sketch:
the least SKETCH hashes of all spans of SPAN code points (the text itself if
shorter).  Likeness of two fingerprints is 1 if they are equal, else the
Jaccard similarity of the span sets as the sketches show it.

The next document in descending order of id comes from a range partition and a
sort inside it; only the first and last text of each partition meet again in a
small join, so there is no unpartitioned window and texts move once.

Cases: a null text is empty; two empty texts are alike (1), an empty and a
non-empty one are not (0); equal ids are ordered by a hash of their text; null
ids come last; a single row is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privtab.llm import common as C

PRIME = (1 << 31) - 1
BASES = (1_000_003 * 911 % PRIME, 777_767_777)
SPAN, SKETCH = 8, 64
_P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod PRIME for values below 2^62."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) mod PRIME; grown by doubling and kept."""
    have = _POWERS.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.r_[have, _mod(have * np.uint64(pow(base, len(have), PRIME)))]
    _POWERS[base] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Prefixes:
    """Prefix hashes of one text (an array of code points)."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = [np.r_[np.zeros(1, np.uint64), _mod(np.cumsum(_mod((codes + np.uint64(1)) * powers(b, self.n)),
                                                                 dtype=np.uint64))] for b in BASES]

    def same(self, i: int, other: Prefixes, j: int, size: int) -> bool:
        """Whether self[i:i+size] equals other[j:j+size]."""
        for base, a, b in zip(BASES, self.sums, other.sums):
            x = (int(a[i + size]) - int(a[i])) * pow(base, max(0, j - i), PRIME)
            y = (int(b[j + size]) - int(b[j])) * pow(base, max(0, i - j), PRIME)
            if (x - y) % PRIME:
                return False
        return True

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension from i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, size: int) -> np.ndarray:
        """Hash of every span of ``size`` code points, wherever it stands."""
        count = self.n - size + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        s = self.sums[0]
        value = _mod(s[size:] + (_P - s[:count]))
        return _mod(value * powers(pow(BASES[0], -1, PRIME), count))

    def fingerprint(self) -> str:
        size = min(SPAN, self.n)
        values = C.mix(self.spans(size) + np.uint64(size << 40)) >> np.uint64(32) if size else np.zeros(0, np.uint64)
        if len(values) > 8 * SKETCH:  # equal spans may be among the least: look further if so
            k = 4 * SKETCH
            while True:
                least = np.unique(np.partition(values, k)[:k])
                if len(least) >= SKETCH or k * 4 >= len(values):
                    break
                k *= 4
            values = least if len(least) >= SKETCH else values
        sketch = np.unique(values)[:SKETCH].astype(">u4").tobytes().hex()
        whole = "".join(f"{int(s[-1]):08x}" for s in self.sums)
        return f"{self.n:x}:{whole}:{sketch}"


def likeness(a: str, b: str) -> float:
    """From 0 to 1, of two fingerprints."""
    if a == b:
        return 1.0
    x, y = ({part[i:i + 8] for i in range(0, len(part), 8)} for part in (a.rpartition(":")[2], b.rpartition(":")[2]))
    both = sorted(x | y)
    # beyond the least SKETCH of both the sketches may not know a span
    if len(x) >= SKETCH or len(y) >= SKETCH:
        both = both[:SKETCH]
    return sum(v in x and v in y for v in both) / len(both) if both else 0.0


_ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("common_edited", pa.int64()), ("common_next", pa.int64())]
_ROW_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, common_edited long, common_next long")


class _Doc:
    def __init__(self, doc_id, packed):
        self.doc_id, self.packed = doc_id, packed
        self.text = (C.unzip_text(packed) or b"").decode()
        self.prefixes = Prefixes(code_points(self.text))
        self.print = self.prefixes.fingerprint()


def _compare(doc: _Doc, after: _Doc) -> tuple:
    n = len(doc.text)
    half = n // 2
    edited = doc.text[:n - half] + after.text[:half]
    changed = Prefixes(code_points(edited))
    mark = changed.fingerprint()
    return (doc.doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), doc.print, mark,
            likeness(doc.print, mark), likeness(doc.print, after.print),
            doc.prefixes.common(0, changed, 0), doc.prefixes.common(0, after.prefixes, 0))


def _along(batches):
    """One sorted partition: a row per document but the last; the first and
    the last text go on to meet their neighbours of other partitions."""
    part = TaskContext.get().partitionId()
    names = [n for n, _ in _ROW] + ["part", "role", "text"]
    kinds = [t for _, t in _ROW] + [pa.int32(), pa.string(), pa.binary()]
    empty = (None,) * (len(_ROW) - 1)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    before, rows = None, []
    for b in batches:
        for doc_id, packed in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            doc = _Doc(doc_id, packed)
            if before is None:
                rows.append((doc_id, *empty, part, "first", packed))
            else:
                rows.append((*_compare(before, doc), part, "done", None))
            before = doc
            if len(rows) >= 1000:
                yield batch(rows)
                rows = []
    if before is not None:
        rows.append((before.doc_id, *empty, part, "last", before.packed))
    if rows:
        yield batch(rows)


def _border(batches):
    for b in batches:
        rows = [_compare(_Doc(i, x), _Doc(None, y)) for i, x, y in zip(*(b.column(k).to_pylist() for k in range(3)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _ROW)],
                                             names=[n for n, _ in _ROW])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, common_edited and common_next (code points that the
    text shares with the edited and the next text from the start)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = max(C.text_bytes(base) // (16 << 20), int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = C.zipped_texts(base.withColumn("tie", F.xxhash64("text")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").asc()]
    ordered = packed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = C.stored(ordered.select("doc_id", "text").mapInArrow(_along, _ROW_DDL + ", part int, role string, text binary"), "prints")
    # one number per partition comes to the driver
    filled = sorted(r[0] for r in rows.filter("role = 'first'").select("part").collect())
    after = spark.createDataFrame([(p, filled[(i + 1) % len(filled)]) for i, p in enumerate(filled)], "part int, goes int")
    last = rows.filter("role = 'last'").select("doc_id", "part", "text").join(after, "part")
    first = rows.filter("role = 'first'").select(F.col("part").alias("goes"), F.col("text").alias("next"))
    ends = last.join(first, "goes").select("doc_id", "text", "next").mapInArrow(_border, _ROW_DDL)
    return rows.filter("role = 'done'").select(*[n for n, _ in _ROW]).unionByName(ends)
