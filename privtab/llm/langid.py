"""Language identification by nearest centroid.

A text is a vector of character n-grams (1 to 3 code points of the lower-cased
text, everything but letters as a gap) hashed into FEATURES places, weighed by
TF-IDF and scaled to length one.  Each language has several centroids (spherical
k-means); a text gets the language of the centroid with the largest cosine and
is rejected if that lies below what the language's own texts of such a length
reach.  For that, half of a language's sample is compared with centroids of the
other half, whole and cut to 1, 2, 4, ... letters; the limit of a length is the
share ``MARGIN`` of the ``QUANTILE`` of these cosines.

Document frequencies come from all training texts (one pass, one vector per
task, summed in Spark).  Clusters are fitted on a bounded sample: about
``SAMPLE`` training texts per language, chosen by a hash of their id.  What goes
to the executors is languages x CLUSTERS x FEATURES numbers, independent of the
number of documents.

Cases: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; without training texts every text is; ties go to the first language
in order; equal rows get equal results; a language learned from a single text
has no limits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from privtab.llm import common as C

FEATURES, CLUSTERS, SAMPLE = 2048, 4, 1000
#: A text is rejected below this share of this quantile of the cosines of a language's texts of its length.
MARGIN, QUANTILE = 0.5, 0.05
#: Letters of a text in powers of two, the last for all longer ones.
LENGTHS = 12
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []
_A, _B, _D = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def _is_letter(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(which code points are letters, code points)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _letters()[np.minimum(codes, 0x10FFFF)], codes


def _place(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint32(15)
    h = h * _D
    h ^= h >> np.uint32(13)
    return (h * _A) >> np.uint32(32 - FEATURES.bit_length() + 1)


def counts_of(text: str) -> tuple[np.ndarray, bool]:
    """(n-gram counts by place, has a letter) of a whole text."""
    letter, codes = _is_letter(text.lower())
    if not letter.any():
        return np.zeros(FEATURES), False
    # gaps of any length count once
    keep = letter | np.r_[True, letter[:-1]]
    c = np.where(letter, codes, np.uint32(1)).astype(np.uint32)[keep]
    c = np.r_[np.uint32(1), c, np.uint32(1)]
    two = c[:-1] * _A + c[1:] * _B
    three = two[:-1] * _D + c[2:] * _A + np.uint32(7)
    one = c[c != 1]  # a gap alone says nothing of a language
    grams = np.concatenate([_place(one * _B + np.uint32(3)), _place(two), _place(three)])
    return np.bincount(grams, minlength=FEATURES).astype(np.float64), True


def length_of(text: str) -> int:
    """Number of letters as a power of two, rounded down; the last for all longer ones."""
    return min(max(int(_is_letter(text)[0].sum()), 1).bit_length(), LENGTHS) - 1


def passage(text: str) -> str:
    """As many letters as the last length has, from the start of a word that the text itself chooses."""
    letter, codes = _is_letter(text.lower())
    starts = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    if not len(starts):
        return ""
    # not so late that the text ends before the passage does, if that can be
    upto = np.cumsum(letter)
    last = np.flatnonzero(upto[-1] - upto[starts] >= 1 << LENGTHS - 1)
    start = starts[zlib.crc32(codes.tobytes()) % max(len(last), 1)]
    return codes[start:][:np.searchsorted(np.cumsum(letter[start:]), 1 << LENGTHS - 1) + 1].tobytes().decode(
        "utf-32-le", "surrogatepass")


def cuts(text: str) -> list[tuple[int, np.ndarray]]:
    """(length, n-gram counts) of a passage's first 1, 2, 4, ... letters."""
    letter, codes = _is_letter(text)
    upto = np.cumsum(letter)
    return [(k, counts_of(codes[:np.searchsorted(upto, 1 << k) + 1].tobytes().decode("utf-32-le", "surrogatepass"))[0])
            for k in range(LENGTHS) if len(upto) and upto[-1] >= 1 << k]


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term frequency times inverse document frequency (idf is 1 for what all texts have)."""
    return counts * idf


def _frequencies(batches):
    total, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            counts, some = counts_of(text.as_py() or "")
            if some:
                total += counts > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES), pa.int32()), pa.array(np.r_[n, total])],
                                     names=["place", "n"])


def _vectors(idf: np.ndarray):
    kinds = (pa.string(), pa.binary(), pa.int32(), pa.string())

    def run(batches):
        for batch in batches:
            for small in C.sliced([batch], 256):
                rows = [(l, unit(weigh(v, idf)).astype(np.float32).tobytes(), length_of(t), passage(t))
                        for l, t in zip(small.column("lang").to_pylist(), small.column("text").to_pylist())
                        for v, some in [counts_of(t or "")] if some]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                     names=["lang", "vector", "length", "passage"])

    return run


def _centroids(vectors: np.ndarray) -> np.ndarray:
    """Spherical k-means; starts at the farthest texts."""
    chosen = [unit(vectors.mean(0))]
    while len(chosen) < min(CLUSTERS, len(vectors)):
        chosen.append(vectors[int(np.argmin((vectors @ np.stack(chosen).T).max(1)))])
    centroids = np.stack(chosen)
    for _ in range(20):
        own = (vectors @ centroids.T).argmax(1)
        after = np.stack([unit(vectors[own == k].mean(0)) if (own == k).any() else centroids[k]
                          for k in range(len(centroids))])
        if np.allclose(after, centroids):
            break
        centroids = after
    return centroids


def limits(lengths: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least cosine that is not rejected, by length; it never falls as texts get longer."""
    out = np.full(LENGTHS, np.nan)
    for k in np.unique(lengths):
        out[k] = MARGIN * max(0.0, float(np.quantile(cosines[lengths == k], QUANTILE)))
    # a length that no text has takes the limit of the next shorter one that some have
    for k in range(LENGTHS):
        if np.isnan(out[k]):
            out[k] = out[k - 1] if k else 0.0
    return np.minimum.accumulate(out[::-1])[::-1]


def _cluster(idf: np.ndarray):
    """Centroids of one language's sample, and the limits of its texts."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vector", "passage"], ignore_index=True)
        vectors = np.stack([np.frombuffer(v, np.float32) for v in frame["vector"]]).astype(np.float64)
        lengths, cosines = [], []
        for half in (0, 1):
            mine = np.arange(len(vectors)) % 2 == half
            if mine.any() and not mine.all():
                other = _centroids(vectors[~mine])
                lengths += frame["length"][mine].tolist()
                cosines += (vectors[mine] @ other.T).max(1).tolist()
                for text in frame["passage"][mine]:
                    for k, counts in cuts(text):
                        lengths.append(k)
                        cosines.append(float((other @ unit(weigh(counts, idf))).max()))
        least = limits(np.asarray(lengths, int), np.asarray(cosines))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes()
                                                                         for c in _centroids(vectors)],
                             "limits": [least.tolist()] * min(CLUSTERS, len(vectors))})

    return run


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], limits: list[list[float]], centroids: np.ndarray):
        self.idf, self.langs, self.limits, self.centroids = idf, langs, limits, centroids

    def predict(self, texts: list[str | None]):
        """(language, cosine, rejected) of each text."""
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        found = [(i, v) for i, t in enumerate(texts) if t for v, some in [counts_of(t)] if some]
        if not found or not self.langs:
            return out
        vectors = unit(weigh(np.stack([v for _, v in found]), self.idf))
        cosine = vectors @ self.centroids.T
        best = cosine.argmax(1)
        for (i, _), k, row in zip(found, best, cosine):
            score = float(min(1.0, max(0.0, row[k])))
            out[i] = (self.langs[k], score, score < self.limits[k][length_of(texts[i])])
        return out


def fit(train: DataFrame) -> Model:
    """From rows of doc_id, text and lang (none null)."""
    sums = (train.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place")
            .agg(F.sum("n").alias("n")).collect())  # FEATURES + 1 rows
    df = np.zeros(FEATURES + 1)
    for place, n in sums:
        df[place + 1] = n
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1
    # about SAMPLE texts per language: those whose hash falls under the language's share
    sizes = train.groupBy("lang").count().collect()  # a row per language, as the model has
    # (a share of 2^52, so it is no less than SAMPLE texts of any number of them)
    limit = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, (SAMPLE << 52) // n)]) if sizes else None
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))
    sample = train.filter(spot < limit[F.col("lang")] if sizes else F.lit(False)).select("lang", "text")
    rows = (sample.mapInArrow(_vectors(idf), "lang string, vector binary, length int, passage string")
            .groupBy("lang").applyInPandas(_cluster(idf), "lang string, centroid binary, limits array<double>").collect())
    rows = sorted(rows, key=lambda r: (r["lang"], r["centroid"]))
    centroids = np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]).astype(np.float64) \
        if rows else np.zeros((0, FEATURES))
    return Model(idf, [r["lang"] for r in rows], [list(r["limits"]) for r in rows], centroids)


def identify(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per row: doc_id, carry, trained (null counts as not), lang_pred, score,
    rejected, and the text if asked for.  ``trains``: a boolean expression over ``docs``; rows where it
    holds and language and text are not null are learned from."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), F.coalesce(trains, F.lit(False)).alias("trained"),
                       C.carried(carry))
    model = fit(base.filter("trained AND text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
                .select("doc_id", "text", "lang"))
    kept = base.select("doc_id", "carry", "trained", "text")
    same = ["doc_id", "carry", "trained"] + ["text"] * with_text
    kind = StructType(C.row_type(kept, *same).fields
                      + StructType.fromDDL("lang_pred string, score double, rejected boolean").fields)
    schema = to_arrow_schema(kind)

    def run(batches):
        for whole in batches:
            for batch in C.sliced([whole], 256):
                lang, score, rejected = zip(*model.predict(batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*map(batch.column, same), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(rejected, pa.bool_())], schema=schema)
            C.release()

    return kept.mapInArrow(run, kind)
