"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct 5-word shingles (64-bit hashes).  Its
signature has 64 symbols of 16 bits, each the low bits of one minimum under a
random permutation; two sets of Jaccard similarity s differ in about
64 (1 - s) symbols.  The signature is split into 16 chunks of 4 symbols.  By
the pigeonhole principle two signatures that differ in at most 31 symbols have
a chunk with at most one error, so enumerating the four ways to leave out one
symbol of each chunk (64 keys of 3 symbols) makes every pair within that
distance meet in a key.  Sets of similarity 0.75 meet with probability
1 - 5e-10 (each chunk alone has at most one error with probability 0.74), and
every pair that meets is confirmed on the full sets.

Only links matter that join classes, so no key emits all its pairs.  A text
that shares many keys with many others is central (the source of a group of
edited copies).  Round 1 pairs each text with the most central text it shares
a key with, so a group of thousands of copies is mostly one class at one pair
per member.  Round 2 takes the keys that still hold several classes: their
members, gathered by the key's most central text, are compared on their full
sets in pairs of blocks of bounded size, in shingles and in texts (a matrix
product counts the shared shingles of a slice of rows at a time), and a task
returns a spanning forest of the links it finds between classes.  Before that a
group of more than one block is pruned exactly: sets as similar as asked for
share a shingle among the first quarter of each in any one order, so with rare
shingles first a member stays only if a member of another class has one of its
first shingles; and only blocks of sizes that can be similar meet.  So no link
is lost and pairs are never rows.

Equal texts are one node (a hash of the text), so exact copies never form
pairs.  Lineage between rounds is cut with tables in the checkpoint folder.

Cases: a null or empty text, or one without words, has the empty set, is
linked with nothing and stays; fewer than five words make one shingle; equal
rows share a class; a null id has a null component and is kept.  Other columns
are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privtab.llm import common as C

SHINGLE = 5
SYMBOLS, CHUNK = 64, 4
#: 100 * intersection >= PERCENT * union
PERCENT = 75
#: Parts into which a class is split where its members are joined with its head.
SALT = 32
#: Shingles and texts that a block of a group's members holds.
BLOCK, DOCS = 200_000, 2_000
#: Cells of a matrix of overlaps.
CELLS = 1 << 20
#: Members of a group that its common shingles are taken from, and how many of those are kept.
PICKS, COMMON = 64, 4096
#: Members from which a shingle's cell is looked up by broadcast.
HOT = 10_000

_SEEDS = np.random.default_rng(20240501)
_MULTIPLY = (_SEEDS.integers(1, 1 << 32, SYMBOLS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_FLIP = _SEEDS.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(counts: np.ndarray, hashes: np.ndarray, width: int = SHINGLE):
    """(sizes, values): the distinct shingles of each document, document after document."""
    starts = C.window_starts(counts, width)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - (width - 1), 0))
    values = C.rolling(hashes, width)[starts]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        offsets = np.cumsum(counts) - counts
        whole = [C.rolling(hashes[offsets[d]:offsets[d] + counts[d]], int(counts[d]))[0] ^ np.uint64(counts[d])
                 for d in short]
        doc, values = np.r_[doc, short], np.r_[values, np.asarray(whole, np.uint64)]
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])] if len(doc) else np.zeros(0, bool)
    return np.bincount(doc[fresh], minlength=len(counts)), values[fresh]


def signatures(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols per non-empty set."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    base = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), SYMBOLS), np.uint32)
    for j in range(SYMBOLS):
        h = (base ^ _FLIP[j]) * _MULTIPLY[j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:, j] = np.minimum.reduceat(h, first)
    return out & np.uint32(0xFFFF)


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature: every chunk with each one symbol left out."""
    symbols = signature.astype(np.uint64)
    keys = []
    for chunk in range(SYMBOLS // CHUNK):
        part = symbols[:, chunk * CHUNK:(chunk + 1) * CHUNK]
        for out in range(CHUNK):
            key = np.full(len(symbols), chunk * CHUNK + out, np.uint64)
            for j in range(CHUNK):
                if j != out:
                    key = (key << np.uint64(16)) | part[:, j]
            keys.append(C.mix(key))
    return np.stack(keys, 1).view(np.int64) if keys else np.zeros((0, 0), np.int64)


def _features(batches):
    for (ids, no_id, nodes), counts, hashes in C.token_blocks(batches, C.words_lower, 250_000,
                                                              ("doc_id", "no_id", "node")):
        sizes, values = shingle_sets(counts, hashes)
        some = sizes > 0
        keys = chunk_keys(signatures(sizes, values)) if some.any() else np.zeros((0, SYMBOLS), np.int64)
        offsets = np.zeros(len(sizes) + 1, np.int32)
        offsets[1:] = np.cumsum(some * keys.shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=no_id.astype(bool)), pa.array(nodes), pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))],
            names=["doc_id", "node", "n", "keys"])


def _set_of(packed: bytes) -> np.ndarray:
    """The shingles of a packed text."""
    words = C.unzip_text(packed).lower().split()
    return shingle_sets(np.asarray([len(words)]), C.word_hashes(words))[1]


def _compared(batches):
    """Pairs with both texts -> whether their full sets are similar enough."""
    last = {}

    def shingles(node, packed):
        if node not in last:
            if len(last) >= 64:
                last.clear()
            last[node] = _set_of(packed)
        return last[node]

    for batch in batches:
        rows = [batch.column(i).to_pylist() for i in range(4)]
        linked = []
        for a, b, ta, tb in zip(*rows):
            x, y = shingles(a, ta), shingles(b, tb)
            union = len(np.union1d(x, y))
            both = len(x) + len(y) - union
            linked.append(100 * both >= PERCENT * union)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                                         names=["a", "b", "linked"])


def _tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) of pairs of nodes, on their full sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return C.stored(met.mapInArrow(_compared, "a long, b long, linked boolean"), "tested")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, exactly."""
    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (vx, rx), (vy, ry) = flat(x), flat(y)
    shared = np.intersect1d(vx, vy)
    out = np.zeros((len(x), len(y)), np.int64)

    def columns(values, rows):
        at = np.searchsorted(shared, values)
        known = at < len(shared)
        known[known] = shared[at[known]] == values[known]
        at, rows = at[known], rows[known]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order]

    (ax, rx), (ay, ry) = columns(vx, rx), columns(vy, ry)
    for c in range(0, len(shared), chunk):
        width = min(chunk, len(shared) - c)
        m = []
        for at, rows, n in ((ax, rx, len(x)), (ay, ry, len(y))):
            a, b = np.searchsorted(at, (c, c + width))
            dense = np.zeros((n, width), np.float32)
            dense[rows[a:b], at[a:b] - c] = 1
            m.append(dense)
        out += np.rint(m[0] @ m[1].T).astype(np.int64)
    return out


def _similar(x: list[np.ndarray], y: list[np.ndarray]):
    """(places in x, places in y) of the sets that are similar enough, by slices
    of x; without equal places if x is y."""
    nx, ny = (np.asarray([len(s) for s in sets]) for sets in (x, y))
    if x is y:
        # a shingle that only one set has is in no overlap
        values, counts = np.unique(np.concatenate(x), return_counts=True)
        several = values[counts > 1]
        x = y = [s[np.isin(s, several)] for s in x]
    step = max(1, CELLS // len(y))
    for a in range(0, len(x), step):
        both = _overlaps(x[a:a + step], y)
        i, j = np.nonzero(100 * both >= PERCENT * (nx[a:a + step, None] + ny[None] - both))
        i += a
        yield (i[i != j], j[i != j]) if x is y else (i, j)


def _block_links(table: pa.Table) -> pa.Table:
    """Links between classes among the members of one pair of blocks, of one
    group or of several small ones; at most a spanning forest of them."""
    found: dict[int, int] = {}

    def root(v):
        while found.setdefault(v, v) != v:
            found[v] = v = found[found[v]]
        return v

    groups: dict[int, list] = {}
    for r in table.to_pylist():
        groups.setdefault(r["head"], []).append(r)
    links = []
    for rows in groups.values():
        for r in rows:
            r["set"] = _set_of(r["text"])
        x = [r for r in rows if r["block"] == r["bi"]]
        y = [r for r in rows if r["block"] == r["bj"]]
        if not x or not y:
            continue
        sx = [r["set"] for r in x]
        sy = sx if rows[0]["bi"] == rows[0]["bj"] else [r["set"] for r in y]
        lx, ly = np.asarray([r["label"] for r in x]), np.asarray([r["label"] for r in y])
        for i, j in _similar(sx, sy):
            apart = lx[i] != ly[j]
            for a, b in np.unique(np.stack([lx[i[apart]], ly[j[apart]]], 1), axis=0).tolist():
                a, b = root(a), root(b)
                if a != b:
                    found[max(a, b)] = min(a, b)
                    links.append((a, b))
    return pa.Table.from_arrays([pa.array([k[n] for k in links], pa.int64()) for n in (0, 1)], names=["a", "b"])


def _common(table: pa.Table) -> pa.Table:
    """Shingles that several of a group's picked members have, the most frequent ones,
    and in how many."""
    values, counts = np.unique(np.concatenate([_set_of(t) for t in table.column("text").to_pylist()]), return_counts=True)
    most = np.lexsort((values, -counts))[:COMMON]
    most = np.sort(most[counts[most] > 1])
    return pa.Table.from_arrays([table.column("head")[:1], pa.array([values[most].tobytes()], pa.binary()),
                                 pa.array([counts[most].astype(np.uint8).tobytes()], pa.binary())],
                                names=["head", "common", "often"])


def _prefixes(batches):
    """The shingles of each member by which it must meet any member it is linked
    with: the first of its set, those that the picked members have least first."""
    for whole in batches:
        for batch in C.sliced([whole], 256):
            rows = []
            for r in batch.to_pylist():
                own = _set_of(r["text"])
                often = np.zeros(len(own), np.uint8)
                if r["common"]:
                    known = np.frombuffer(r["common"], np.uint64)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    often = np.where(known[at] == own, np.frombuffer(r["often"], np.uint8)[at], 0)
                first = len(own) - (PERCENT * len(own) + 99) // 100 + 1
                rows.append(own[np.lexsort((own, often))[:first]].view(np.int64))
            at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(n).take(pa.array(at)) for n in ("head", "node", "label", "n")]
                                             + [pa.array(np.concatenate(rows), pa.int64())],
                                             names=["head", "node", "label", "n", "shingle"])


def alive(group: DataFrame, texts: DataFrame) -> DataFrame:
    """The members (head, node, label, n) of groups that share one of their first
    shingles with a member of another class; no other can have a link to one."""
    counts = group.groupBy("head").agg(F.ceil(F.count("*") / PICKS).alias("every"))
    picks = group.join(counts, "head").filter(F.pmod(F.xxhash64("node"), "every") == 0).select("head", "node")
    common = (picks.join(texts, "node").select("head", "text").groupBy("head")
              .applyInArrow(_common, "head long, common binary, often binary")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    met = (group.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALT))).join(common, ["head", "salt"], "left")
           .join(texts, "node").select("head", "node", "label", "n", "text", "common", "often"))
    firsts = C.stored(met.mapInArrow(_prefixes, "head long, node long, label long, n long, shingle long"), "firsts")
    cells = (firsts.groupBy("head", "shingle").agg(F.count("*").alias("size"), F.min("label").alias("lo"),
                                                   F.max("label").alias("hi")))
    cells = C.stored(cells.filter("lo != hi").select("head", "shingle", "size"), "cells")
    hot = F.broadcast(cells.filter(F.col("size") > HOT))
    by = ["head", "shingle"]
    stay = firsts.join(hot, by, "left_semi").unionByName(
        firsts.join(hot, by, "left_anti").join(cells.filter(F.col("size") <= HOT), by, "left_semi"))
    return stay.select("head", "node", "label", "n").distinct()


def _blocks() -> Column:
    """Number of blocks of a group's members."""
    return F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / DOCS))


def _spots(group: DataFrame, texts: DataFrame) -> DataFrame:
    """Members by the pairs of blocks in which they are compared: task, head,
    node, label, block, bi, bj.  Groups of one block share tasks; members of
    larger ones are pruned and then dealt by size, so that only neighbouring
    sizes (a factor of just over 100 / PERCENT) meet."""
    sizes = C.stored(group.groupBy("head").agg(_blocks().alias("blocks"), F.sum("n").alias("n"), F.count("*").alias("rows")),
                     "sizes")
    one = sizes.filter("blocks = 1")
    total, rows = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    packs = max(1, total // BLOCK, rows // DOCS)
    zero = F.lit(0).cast("long")
    small = group.join(one.select("head"), "head", "left_semi").select(
        F.pmod("head", F.lit(packs)).alias("task"), "head", "node", "label", zero.alias("block"), zero.alias("bi"),
        zero.alias("bj"))
    large = sizes.filter("blocks > 1").select("head")
    if large.isEmpty():
        return small
    kept = C.stored(alive(group.join(large, "head", "left_semi"), texts), "alive")
    kept = kept.withColumn("size", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT * 1.000001))).cast("long"))
    each = kept.groupBy("head", "size").agg(_blocks().alias("blocks"))
    each = each.groupBy("head").agg(F.collect_list(F.struct("size", "blocks")).alias("sizes"))  # a few dozen at most
    near = F.filter("sizes", lambda s: F.abs(s["size"] - F.col("size")) <= 1)
    number = lambda s, b: s["size"] * (1 << 32) + b
    others = F.flatten(F.transform(near, lambda s: F.transform(F.sequence(zero, s["blocks"] - 1), lambda b: number(s, b))))
    own = F.filter("sizes", lambda s: s["size"] == F.col("size"))[0]
    met = (kept.join(each, "head").withColumn("block", number(own, F.pmod(F.xxhash64("node"), own["blocks"])))
           .withColumn("with", F.explode(others)))
    return small.unionByName(met.select(
        F.col("head").alias("task"), "head", "node", "label", "block", F.least("block", "with").alias("bi"),
        F.greatest("block", "with").alias("bj")))


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label): the least node reachable, for every node with a link.

    Each round takes the least label of a node's neighbours and then the label
    of that label; tables between rounds are written to the shared folder."""
    both = C.stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = C.stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                      .withColumnRenamed("a", "node"), name)
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        near = (labels.join(seen, labels.node == seen.a, "left")
                .select("node", "label", F.least("label", F.coalesce("near", "label")).alias("near")))
        of = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = C.stored(near.join(of, "near", "left")
                         .select("node", "label", F.least("near", F.coalesce("far", "near")).alias("next")), name)
        moved = after.filter("label != next").limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable),
    kept (doc_id = component_id; true for a null id)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("node"))
    feats = C.stored(base.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                                 F.col("doc_id").isNull().alias("no_id"), "node", "text").mapInArrow(_features, "doc_id long, node long, n long, keys array<long>"), "features")

    # members of keys that at least two texts share; a text that shares many keys
    # with many others is central, and each key's most central text is its head
    once = feats.filter("n > 0").select("node", "n", "keys").dropDuplicates(["node"])
    spread = once.select(F.explode("keys").alias("key"), "node", "n").repartition("key")
    shared = spread.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = C.stored(spread.join(shared, "key"), "members")
    central = met.groupBy("node").agg(F.sum("size").alias("central"))
    met = met.join(central, "node")
    heads = (met.groupBy("key").agg(F.max(F.struct("central", "node")).alias("top"))
             .select("key", F.col("top.node").alias("head"), F.col("top.central").alias("weight")))
    members = C.stored(met.join(heads, "key").select("key", "node", "n", "head", "weight"), "members")
    some = (C.zipped_texts(base.filter("text IS NOT NULL").select("node", "text"))
            .groupBy("node").agg(F.first("text").alias("text")))
    texts = C.stored(some.join(members.select("node").distinct(), "node", "left_semi"), "texts")

    def torn(labels):
        """Members of keys that still hold several classes."""
        now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
        return now.join(mixed.select("key"), "key", "left_semi")

    # round 1: each text with the most central of its keys' heads
    first = (members.filter("head != node").groupBy(F.col("node").alias("a"))
             .agg(F.max(F.struct("weight", "head")).alias("top")).select("a", F.col("top.head").alias("b")))
    tests = _tested(first, texts)
    labels = components(tests.filter("linked").select("a", "b"))

    # round 2: the members of torn keys, gathered by the key's head and compared
    # on their full sets block by block; a block is bounded in shingles and texts,
    # so a large group becomes many tasks of bounded size, and small groups share one
    group = C.stored(torn(labels).select("head", "node", "label", "n").distinct(), "torn")
    spots = _spots(group, texts)
    met2 = spots.join(texts, "node").select("task", "head", "bi", "bj", "block", "node", "label", "text")
    more = C.stored(met2.groupBy("task", "bi", "bj").applyInArrow(_block_links, "a long, b long"), "links")
    labels = components(tests.filter("linked").select("a", "b").unionByName(more))

    # the least id of each text, then of each class; a class can hold a large
    # share of the texts, so that join is salted
    low = feats.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    linked = low.join(labels, "node").withColumn("salt", F.pmod(F.hash("node"), F.lit(SALT)))
    heads = (linked.groupBy("label").agg(F.min("low").alias("head"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    of = linked.join(heads, ["label", "salt"]).select("node", "head")
    heads = low.join(of, "node", "left").select("node", F.coalesce("head", "low").alias("head"))
    return (feats.select("doc_id", "node", "n").join(heads, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True))))
