"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The last token of the encoding of a prefix decides how the encoding goes on:
token t ends the prefix w[:i] exactly if w[:i - len(t)] ends in a token that t
may follow (the two, encoded together, stay the same two tokens).  So one state
per prefix, its last token, holds the whole encoding by back reference.

Distinct words are walked in sorted order, which is the depth-first traversal
of their trie: the states of the prefix that a word shares with the one before
it stay on a stack and are computed once.  Encodings of whole words are kept
between blocks in a bounded table (cleared when full), texts are put together
from it, and decoding goes back from the ids alone.

Matches the public library on the same file with ``add_special_tokens=False``
and decodes as its ``decode(ids, skip_special_tokens=False)``: special tokens
that occur in a text are found as in the library.  A null text is empty.
Texts are taken whole, one at a time; long ones only lengthen one row.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from privtab.llm import common as C

#: Fixed value: the split pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encodings a worker keeps.
KEPT_WORDS = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder for one vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = _byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.ids = {spell(t): i for t, i in model["vocab"].items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((spell(a), spell(b)), r)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
                                        or r"(?!)")
        self.split = regex.compile(PATTERN)
        top = max([*self.ids.values(), *self.special.values()]) + 1
        self.spelt = [b""] * top
        for t, i in self.ids.items():
            self.spelt[i] = t
        for t, i in self.special.items():
            self.spelt[i] = t.encode()
        self.sizes = np.fromiter(map(len, self.spelt), np.int64, top)
        self.place = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.spelt), np.uint8)
        self.longest = max(map(len, self.ids))
        self.alone = {}   # token -> it is its own encoding
        self.follows = {}  # (token id, token id) -> the two stay apart
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """Merges by rank; used for single tokens and pairs of tokens."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of sorted distinct words: a depth-first walk over their trie."""
        ids, longest, follows, alone, merged = self.ids, self.longest, self.follows, self.alone, self.merged
        spelt = self.spelt
        token, size = [-1], [0]   # per prefix length: last token and its length
        out, before = [], b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del token[shared + 1:], size[shared + 1:]
            for i in range(shared + 1, len(word) + 1):
                for n in range(1, min(i, longest) + 1):
                    t = ids.get(word[i - n:i])
                    if t is None:
                        continue
                    if n == i:
                        ok = alone.get(t)
                        if ok is None:
                            ok = alone[t] = len(merged(word[:i])) == 1
                    else:
                        p = token[i - n]
                        ok = follows.get((p, t))
                        if ok is None:
                            if len(follows) > 2_000_000:
                                follows.clear()
                            ok = follows[p, t] = merged(spelt[p] + spelt[t]) == [spelt[p], spelt[t]]
                    if ok:
                        token.append(t)
                        size.append(n)
                        break
                else:
                    raise ValueError(f"no token ends {word[:i]!r}: the vocabulary lacks a byte")
            code, i = [], len(word)
            while i:
                code.append(token[i])
                i -= size[i]
            code.reverse()
            out.append(code)
            before = word
        return out

    def _learn(self, pieces: list[str], table: dict[str, bytes]) -> None:
        """Encodings of text pieces (each safe to split by itself) go to ``table``."""
        split = [[w.encode() for w in self.split.findall(p)] for p in pieces]
        words = sorted(set(chain.from_iterable(split)))
        codes = {w: np.asarray(c, "<u4").tobytes() for w, c in zip(words, self.encode_sorted(words))}
        for piece, parts in zip(pieces, split):
            table[piece[1:] if table is self.after_space else piece] = b"".join([codes[w] for w in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.after_space) + len(self.at_start) > KEPT_WORDS:
            self.after_space.clear()
            self.at_start.clear()
        split = []  # per text: (pieces, whole parts)
        for text in texts:
            if self.special and self.special_at.search(text):
                split.append(None)
                continue
            pieces = text.split(" ")
            split.append(pieces)
        fresh = set(chain.from_iterable(p[1:] for p in split if p)).difference(self.after_space)
        safe = [p for p in fresh if p and not p[0].isspace() and not p[-1].isspace()]
        self._learn([" " + p for p in safe], self.after_space)
        heads = {p[0] for p in split if p}.difference(self.at_start)
        self._learn([p for p in heads if p and not p[-1].isspace()], self.at_start)
        spaced, start = self.after_space.__getitem__, self.at_start
        out = []
        for text, pieces in zip(texts, split):
            if not text:
                out.append(b"")
                continue
            if pieces is not None:
                try:
                    out.append(start[pieces[0]] + b"".join(map(spaced, pieces[1:])))
                    continue
                except KeyError:  # white space that needs its neighbours
                    pass
            out.append(self._encode_slow(text))
        return out

    def _encode_slow(self, text: str) -> bytes:
        parts, at = [], 0
        for m in self.special_at.finditer(text):
            parts += [(text[at:m.start()], None), ("", self.special[m.group()])]
            at = m.end()
        parts.append((text[at:], None))
        out = []
        for piece, special in parts:
            if special is not None:
                out.append(np.asarray([special], "<u4").tobytes())
            elif piece:
                words = [w.encode() for w in self.split.findall(piece)]
                distinct = sorted(set(words))
                codes = {w: np.asarray(c, "<u4").tobytes() for w, c in zip(distinct, self.encode_sorted(distinct))}
                out.append(b"".join([codes[w] for w in words]))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that the ids spell; broken sequences become U+FFFD."""
        parts = []
        for at in range(0, len(ids), 1 << 20):
            some = ids[at:at + (1 << 20)].astype(np.int64)
            sizes = self.sizes[some]
            total = int(sizes.sum())
            parts.append(self.blob[np.repeat(self.place[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)].tobytes())
        raw = b"".join(parts)
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


_CODERS: dict[str, TrieBpe] = {}


def coder(key: str, source: str) -> TrieBpe:
    """One encoder per worker process and vocabulary."""
    if key not in _CODERS:
        _CODERS[key] = TrieBpe(source)
    return _CODERS[key]


def _texts(batch, rows: int = 512, size: int = 2 << 20):
    """Runs of rows of a batch with a few MB of text at most (or one row)."""
    sizes = [len(x.as_py() or b"") for x in batch.column("text").cast(pa.large_binary())]
    at = 0
    while at < batch.num_rows:
        end, total = at, 0
        while end < batch.num_rows and end - at < rows and (end == at or total + sizes[end] <= size):
            total += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, carry, n_tokens, ids_sha256, decoded_sha256 and,
    with ``with_ids``, ids (array of int) and decoded (the decoded text).
    ``vocabulary`` is the path of a byte-level BPE file on the driver; its
    content (about 1.5 MB, fixed by the vocabulary) goes to the executors once."""
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    key = hashlib.sha256(source.encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(source)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       C.carried(carry))
    kind = StructType(C.row_type(base, "doc_id", "carry").fields + StructType.fromDDL(
        "n_tokens long, ids_sha256 string, decoded_sha256 string"
        + ", ids array<int>, decoded string" * with_ids).fields)
    schema = to_arrow_schema(kind)

    def run(batches):
        bpe = coder(key, sent.value)
        for whole in batches:
            for batch in _texts(whole):
                codes = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
                decoded = [bpe.decode(np.frombuffer(c, "<u4")) for c in codes]
                made = {"n_tokens": [len(c) // 4 for c in codes],
                        "ids_sha256": [hashlib.sha256(c).hexdigest() for c in codes],
                        "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded]}
                if with_ids:
                    made["ids"] = [np.frombuffer(c, "<i4") for c in codes]
                    made["decoded"] = [d.decode() for d in decoded]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema],
                    schema=schema)

    return base.mapInArrow(run, kind)
