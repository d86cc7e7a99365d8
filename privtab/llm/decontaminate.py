"""Benchmark decontamination by winnowing.

A window is ``width`` (10) consecutive item words; an item of fewer words is
one window.  Fingerprints are k-gram hashes: of every w consecutive k-grams the
smallest is kept (the leftmost of equal ones), with w + k - 1 no longer than
the window, so every shared window leaves a shared fingerprint.  Each window
length that occurs is winnowed by itself (at most ``width`` of them), so a
short item does not change what longer ones look like.
Fingerprints of documents and items are joined in Spark (the benchmark side is
broadcast only if Spark finds it below its broadcast limit); the hits are
extended on the whole text: each window of the candidate items is looked up by
its Rabin-Karp value among the document's windows.

Cases: a null or empty text or item has no words; an item with a null id counts
as one item of that id and adds nothing to the list of ids; a document with a
null id is judged as any other (it is told by a hash of its text); rows that
share a doc_id are told apart by that hash too; equal rows get equal results.
Other columns ride in a struct.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from privtab.llm import common as C

WIDTH, GRAM = 10, 6


def winnow(counts: np.ndarray, hashes: np.ndarray, gram: int, window: int):
    """(document, fingerprint) pairs, each once: the least k-gram of every
    ``window`` consecutive k-grams of a document."""
    starts = C.window_starts(counts, gram + window - 1)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - (gram + window - 2), 0))
    grams = C.rolling(hashes, gram)
    if not len(starts):
        return doc, np.zeros(0, np.uint64)
    least = grams[starts].copy()
    for j in range(1, window):
        np.minimum(least, grams[starts + j], out=least)
    change = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]
    return doc[change], least[change]


def _fingerprints(width: int, gram: int, spans: list[int], own: bool):
    """(doc, sig, print) for every window length in ``spans``; with ``own``
    only of texts whose window has that length."""
    def run(batches):
        for (ids, sigs), counts, hashes in C.token_blocks(batches, C.words_alnum, columns=("doc", "sig")):
            for span in spans:
                k = min(gram, span)
                doc, prints = winnow(counts, hashes, k, span - k + 1)
                if own:
                    mine = np.minimum(counts, width)[doc] == span
                    doc, prints = doc[mine], prints[mine]
                prints = prints ^ np.uint64(span * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(sigs[doc]), pa.array(prints.view(np.int64))],
                                                 names=["doc", "sig", "print"])

    return run


def _extend(width: int, schema: pa.Schema):
    windows: dict[bytes, tuple[int, frozenset]] = {}

    def of_item(text: str):
        key = text.encode()
        if key not in windows:
            if len(windows) >= 4096:
                windows.clear()
            words = C.words_alnum(key)
            size = min(width, len(words))
            windows[key] = (size, np.unique(C.rolling(C.word_hashes(words), size)))
        return windows[key]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = batch.column("found")
            n_words, n_hit, n_items, items, begins, ends = [], [], [], [], [], []
            for i in range(batch.num_rows):
                words = C.words_alnum(texts[i].as_py() or b"")
                n_words.append(len(words))
                near = found[i].as_py()
                hits, cover = [], None
                if near:
                    hashes = C.word_hashes(words)
                    cover = np.zeros(len(words) + 1, np.int32)
                    rolled = {}
                    for item in near:
                        size, wanted = of_item(item["item_text"])
                        if size not in rolled:
                            rolled[size] = C.rolling(hashes, size)
                        at = np.flatnonzero(np.isin(rolled[size], wanted))
                        if len(at):
                            hits.append(item["item_id"])
                            np.add.at(cover, at, 1)
                            np.add.at(cover, at + size, -1)
                if hits:
                    hit = np.r_[0, (np.cumsum(cover)[:-1] > 0).astype(np.int8), 0]
                    begin, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
                else:
                    begin = end = np.zeros(0, int)
                n_hit.append(int((end - begin).sum()))
                begins.append(begin)
                ends.append(end)
                n_items.append(len(set(hits)))
                items.append(sorted(str(h) for h in set(hits) if h is not None))
            made = {"n_words": n_words, "n_hit": n_hit, "n_items": n_items, "items": items,
                    "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                    "contaminated": [h > 0 for h in n_hit], "begins": begins, "ends": ends}
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema],
                schema=schema)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, gram: int = GRAM,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, text, carry, n_words, n_hit, n_items, items (ids
    as sorted strings), items_sha256, contaminated, begins and ends of the hit
    spans (word places, half open)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("sig"), C.carried(carry))
    items = (benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
             .filter("text IS NOT NULL").distinct()
             .withColumn("doc", F.xxhash64("item_id", "text")).withColumn("sig", F.lit(0).cast("long")))
    # what tells rows apart: the id, or the text's hash where there is none
    base = base.withColumn("doc", F.coalesce("doc_id", "sig"))

    def window_lengths(batches):
        found = {min(width, len(C.words_alnum((text or "").encode())))
                 for batch in batches for text in batch.column(0).to_pylist()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["n"])

    # at most ``width`` lengths
    spans = sorted(r["n"] for r in items.select("text").mapInArrow(window_lengths, "n long").filter("n > 0").distinct().collect())
    prints = "doc long, sig long, print long"
    ours = (items.select("doc", "sig", "text").mapInArrow(_fingerprints(width, gram, spans, True), prints)
            .select(F.col("doc").alias("item"), "print").distinct())
    theirs = (base.filter("text IS NOT NULL").select("doc", "sig", "text")
              .mapInArrow(_fingerprints(width, gram, spans, False), prints))
    met = theirs.join(ours, "print").select("doc", "sig", "item").distinct()
    found = (met.join(items.select(F.col("doc").alias("item"), "item_id", F.col("text").alias("item_text")), "item")
             .groupBy(F.col("doc").alias("k"), F.col("sig").alias("s"))
             .agg(F.collect_list(F.struct("item_id", "item_text")).alias("found")))
    whole = (base.join(found, (F.col("doc") == F.col("k")) & (F.col("sig") == F.col("s")), "left")
             .select("doc_id", "text", "carry", "found"))
    kind = StructType(C.row_type(whole, "doc_id", "text", "carry").fields + StructType.fromDDL(
        "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, "
        "begins array<int>, ends array<int>").fields)
    return whole.mapInArrow(_extend(width, to_arrow_schema(kind)), kind)
