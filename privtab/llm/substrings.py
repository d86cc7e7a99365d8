"""Substring dedup: Rabin-Karp hashes of every window of tokens.

Every window of ``width`` consecutive words is hashed; a window whose word
sequence also starts in a document with a smaller id is repeated, and the
words it covers go.  Repeated windows are merged to maximal intervals.

Plan: one pass over the documents makes blocks of about half a million words.
Inside a block equal windows are met first: all but those of the smallest
document id are repeated for certain, so a window that a third of all
documents share leaves a block once, not once per document.  What remains is
dealt by hash into buckets (packed, about 10 bytes a window), where the
smallest id of every window is found; hits go back packed to the document's
cell, which holds the texts, and intervals are merged there.

Cases: a null or empty text has no words; a text of fewer than ``width``
words has no window; a document with a null id neither removes nor loses
words; rows that repeat an id with the same text get the same result, and an
id that stands for several texts is judged for each text (told apart by 16
bits of a hash of the text).  Other columns are carried in a struct, so their
names cannot clash.
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

WIDTH = 13

_REQUEST = pa.schema([("bucket", pa.int32()), ("hits", pa.bool_()), ("ids", pa.binary()),
                      ("sigs", pa.binary()), ("runs", pa.binary()), ("places", pa.binary()),
                      ("hashes", pa.binary())])
_REQUEST_DDL = ("bucket int, hits boolean, ids binary, sigs binary, runs binary, "
                "places binary, hashes binary")
_HIT_DDL = "cell int, ids binary, sigs binary, runs binary, places binary"
_HIT = pa.schema([("cell", pa.int32()), ("ids", pa.binary()), ("sigs", pa.binary()),
                  ("runs", pa.binary()), ("places", pa.binary())])


def _pack(ids, sigs, places):
    """Entries in order of (document, place) as runs of one document."""
    if not len(ids):
        first = np.zeros(0, np.int64)
    else:
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (sigs[1:] != sigs[:-1])])
    runs = np.diff(np.r_[first, len(ids)]).astype(np.uint32)
    return (C.squeeze(C.deltas(ids[first])), C.squeeze(sigs[first]), C.squeeze(runs),
            C.squeeze(C.deltas(places.astype(np.uint32))))


def _unpack(ids, sigs, runs, places):
    runs = C.unsqueeze(runs, np.uint32)
    return (np.repeat(C.undelta(C.unsqueeze(ids, np.int64)), runs),
            np.repeat(C.unsqueeze(sigs, np.uint16), runs),
            C.undelta(C.unsqueeze(places, np.uint32)))


def _grouped(keys):
    """Bounds of runs of equal keys in a sorted array."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return first, np.r_[first[1:], len(keys)].astype(np.int64)


def _requests(width: int, buckets: int):
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def run(batches):
        for (ids, sigs), counts, hashes in C.token_blocks(batches, C.words_exact,
                                                          columns=("doc_id", "sig")):
            starts = C.window_starts(counts, width)
            if not len(starts):
                continue
            values = C.rolling(hashes, width)[starts]
            doc = np.repeat(np.arange(len(counts)), counts)[starts]
            place = starts - (np.cumsum(counts) - counts)[doc]
            rank = np.empty(len(ids), np.int64)
            order = np.lexsort((sigs, ids))
            rank[order] = np.arange(len(ids))
            # by document id, so that a stable sort by hash puts the smallest id first
            flat = np.argsort(rank[doc], kind="stable")
            values, doc, place = values[flat], doc[flat], place[flat]
            del flat, starts, hashes
            by = np.argsort(values, kind="stable")
            first, until = _grouped(values[by])
            least = np.empty(len(by), np.int64)
            least[by] = np.repeat(ids[doc[by[first]]], until - first)
            own, sig = ids[doc], sigs[doc].astype(np.uint16)
            sure = own > least
            yield from _rows(own[sure], sig[sure], place[sure], None,
                             C.cell_array(own[sure], buckets), True)
            ask = ~sure
            yield from _rows(own[ask], sig[ask], place[ask], values[ask],
                             (values[ask] >> shift).astype(np.int64), False)

    def _rows(own, sig, place, values, target, hits):
        order = np.argsort(target, kind="stable")
        first, until = _grouped(target[order])
        rows = []
        for a, b in zip(first, until):
            at = order[a:b]
            rows.append((int(target[at[0]]), hits, *_pack(own[at], sig[at], place[at]),
                         None if values is None else C.squeeze(values[at])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REQUEST)],
                                             schema=_REQUEST)

    return run


def _answers(cells: int):
    """One bucket: the smallest id of every window, and the places that it beats."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["bucket"], r["ids"], r["sigs"], r["runs"], r["places"]) for r in rows if r["hits"]]
        asked = [r for r in rows if not r["hits"]]
        if asked:
            parts = [_unpack(r["ids"], r["sigs"], r["runs"], r["places"]) for r in asked]
            values = np.concatenate([C.unsqueeze(r["hashes"], np.uint64) for r in asked])
            ids, sigs, places = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(values, kind="stable")
            first, until = _grouped(values[order])
            several = until - first > 1
            first, until = first[several], until[several]
            sizes = until - first
            at = order[np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)]
            if len(at):
                least = np.minimum.reduceat(ids[at], np.cumsum(sizes) - sizes)
                at = at[ids[at] > np.repeat(least, sizes)]
                at = at[np.lexsort((places[at], sigs[at], ids[at]))]
                cell = C.cell_array(ids[at], cells)
                order = np.argsort(cell, kind="stable")
                at, cell = at[order], cell[order]
                for a, b in zip(*_grouped(cell)):
                    k = at[a:b]
                    out.append((int(cell[a]), *_pack(ids[k], sigs[k], places[k])))
        columns = list(zip(*out)) if out else [[] for _ in _HIT]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HIT)], schema=_HIT)

    return run


def _finish(width: int, schema: pa.Schema):
    """One cell: its texts meet their hits; places become removal intervals."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        parts = [_unpack(r["ids"], r["sigs"], r["runs"], r["places"]) for r in hits.to_pylist()]
        if parts:
            ids, sigs, places = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((places, sigs, ids))
            ids, sigs, places = ids[order], sigs[order], places[order]
            key = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (sigs[1:] != sigs[:-1])]) if len(ids) else []
            until = np.r_[key[1:], len(ids)].astype(int) if len(key) else []
            found = {(int(ids[a]), int(sigs[a])): (a, b) for a, b in zip(key, until)}
        else:
            found = {}
        doc_ids, doc_sigs = docs.column("doc_id").to_pylist(), docs.column("sig").to_pylist()
        texts = docs.column("text")
        kept, n_words, n_removed, begins, ends, digest = [], [], [], [], [], []
        for i, text in enumerate(texts):
            raw = C.unzip_text(text.as_py()) or b""
            words = raw.split()
            hit = found.get((doc_ids[i], doc_sigs[i]))
            n_words.append(len(words))
            if hit is None:
                joined, removed, a, b = b" ".join(words), 0, [], []
            else:
                p = places[hit[0]:hit[1]].astype(np.int64)
                cut = np.flatnonzero(np.r_[True, p[1:] > p[:-1] + width])
                a, b = p[cut], p[np.r_[cut[1:], len(p)] - 1] + width
                left, rest = 0, []
                for x, y in zip(a, b):
                    rest += words[left:x]
                    left = y
                rest += words[left:]
                removed, joined = int((b - a).sum()), b" ".join(rest)
            n_removed.append(removed)
            begins.append(a)
            ends.append(b)
            digest.append(hashlib.sha256(joined).hexdigest())
            kept.append((joined if removed else raw).decode("utf-8", "replace"))
        made = {"doc_id": docs.column("doc_id"), "carry": docs.column("carry").combine_chunks(),
                "n_words": n_words, "n_removed": n_removed, "begins": begins, "ends": ends,
                "kept_sha256": digest, "kept_text": kept}
        columns = []
        for f in schema:
            v = made[f.name]
            columns.append(v if isinstance(v, (pa.ChunkedArray, pa.Array)) else pa.array(v, f.type))
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = WIDTH, carry: tuple[str, ...] = (),
                   with_text: bool = True) -> DataFrame:
    """Per document: doc_id, carry (a struct of the named columns), n_words,
    n_removed, begins and ends (word intervals removed, half open),
    kept_sha256 of the kept words joined by one space, and kept_text: the text
    itself where nothing was removed, else the kept words joined by one space.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       C.carried(carry))
    sig = F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).cast("int")
    buckets = C.bucket_count(C.text_bytes(base))
    asked = (base.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", sig.alias("sig"), "text")
             .mapInArrow(_requests(width, buckets), _REQUEST_DDL))
    hits = asked.groupBy("bucket").applyInArrow(_answers(buckets), _HIT_DDL)
    # rows without an id have no hits, so any cell will do: by text, that they do not gather in one
    place = F.coalesce("doc_id", F.xxhash64("text"))
    whole = base.select("doc_id", sig.alias("sig"), "carry", "text", C.cell_of(place, buckets).alias("cell"))
    packed = C.zipped_texts(whole)
    kind = C.row_type(whole, "doc_id", "carry")
    extra = "n_words long, n_removed long, begins array<int>, ends array<int>, kept_sha256 string"
    kind = StructType(kind.fields + StructType.fromDDL(extra + ", kept_text string" * with_text).fields)
    return (packed.groupBy("cell").cogroup(hits.groupBy("cell"))
            .applyInArrow(_finish(width, to_arrow_schema(kind)), kind))
