"""Source divergence audit over a frequent-pattern tree of term rows.

Each language keeps the terms of at least ``spread`` of its documents.  With
counts n and N kept words, a (language, source) group gives a term the share
p = 1 + floor(UNIT * (n + 1) / (N + V)), V the kept terms of the language; the
divergence of p from q is floor((p - q)^2 / q), all in exact integers.  For
every two sources of a language it is summed over all kept terms; for every
group the terms that lie furthest above the language's own share are listed.

Most counts are zero, so the sum of a pair is put together from three parts:
V times the divergence of the two shares of an absent term; for each source
and count, how often it occurs times what it changes against an absent term;
and, for terms of both sources, the correction of that.  The last part walks
a frequent-pattern tree: a term's row is its nonzero counts in the order of
sources, equal rows are one with a multiplicity, rows with a common beginning
share its nodes, and every node is set against each of its ancestors once, for
all terms below it.

Plan: tasks count the words of a block of documents by group before anything is
shuffled, so a word or a source of a third of all rows arrives as one row a
block.  Term rows are grouped to multiplicities (with partial counts), then
range-partitioned in their order, so each task gets a run of neighbouring
branches and builds the tree of one Arrow batch of them at a time; what it
gives are sums by pair.  Joins on the language deal its sources over PARTS
keys.  Pairs of sources are rows of the result, so they are made (as an
equi-join by language); terms are never paired.

Cases: null lang, source or text reads as ''; rows are documents, so rows that
repeat an id count each; a group without terms has share 1 + floor(UNIT / V)
everywhere; a language without kept terms gives pairs of value 0 and no terms;
a language of one source has no pairs; ties in value go by item; an empty
table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privtab.llm import common as C

SPREAD, TOP = 3, 200
#: Shares are in parts of a (short) billion, computed as three digits of base 1000.
DIGITS = 3
#: Counts that a task holds before it gives them on.
HELD = 300_000
#: Bytes of one text that are cut into words at a time.
PIECE = 1 << 20
#: Parts that the sources of a language are dealt into for joins by language.
PARTS = 16
#: Node-ancestor combinations worked on at once.
COMBINED = 1 << 19

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes):
    """Words `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased, piece by piece."""
    plain, at = text.translate(_LETTERS), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                     ("docs", pa.int64())])


def _count(batches):
    """(lang, source, term, n, docs) of blocks of documents."""
    words, docs = defaultdict(Counter), defaultdict(Counter)

    def rows():
        for (lang, source), counter in words.items():
            terms, n = list(counter), len(counter)
            spread = docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counter.values()), pa.int64()),
                 pa.array([spread[t] for t in terms], pa.int64())], schema=_COUNTS)

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        texts = batch.column("text").cast(pa.large_binary())
        for i, group in enumerate(zip(langs, sources)):
            seen = set()
            for piece in terms_of(texts[i].as_py()):
                words[group].update(piece)
                seen.update(piece)
            docs[group].update(seen)
            if i % 64 == 0 and sum(map(len, words.values())) > HELD:
                yield from rows()
                words.clear(), docs.clear()
                C.release()
    yield from rows()


def quotient(a: Column, b: Column) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, b)


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * count / whole), count <= whole < 9 * 10^15, digit by digit
    so that no product leaves a long."""
    whole, out, left = F.greatest(whole, F.lit(1).cast("long")), F.lit(0).cast("long"), count
    for _ in range(DIGITS):
        out, left = out * 1000 + quotient(left * 1000, whole), (left * 1000) % whole
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return quotient((p - q) * (p - q), q)


def kept_counts(docs: DataFrame, spread: int) -> DataFrame:
    """(lang, source, term, n, whole, leads) of the terms that a language keeps;
    ``whole`` is the language's count, ``leads`` marks one row of each term."""
    counts = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    each = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # at most a row for each source
    return (each.withColumns({"whole": F.sum("n").over(term), "spread": F.sum("docs").over(term),
                              "leads": F.row_number().over(term.orderBy("source")) == 1})
            .filter(F.col("spread") >= spread).select("lang", "source", "term", "n", "whole", "leads"))


def source_table(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Every group: lang, source, place (its order in the language), size
    (N + V), v, lang_size, absent (the share of a term that it lacks)."""
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.sum(F.col("leads").cast("long")).alias("led"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["own", "led"])
    lang = Window.partitionBy("lang")
    return (groups.withColumns({"v": F.sum("led").over(lang), "all": F.sum("own").over(lang),
                                "place": F.row_number().over(lang.orderBy(F.desc("own"), "source"))})
            .select("lang", "source", "place", "v", (F.col("own") + F.col("v")).alias("size"),
                    (F.col("all") + F.col("v")).alias("lang_size"))
            .withColumn("absent", share(F.lit(1).cast("long"), F.col("size"))))


# ---- terms of two sources: the tree -----------------------------------------------------------------


def _f(p, q):
    return (p - q) * (p - q) // q


def tree_sums(place, p, absent, starts, lengths, times):
    """{(s, t): sum} of the corrections of all ordered pairs of sources over
    term rows in path order.  A row is ``lengths[i]`` items from ``starts[i]``
    of the flat arrays place, p, absent, and stands for ``times[i]`` terms.

    Rows that share their first items share those nodes; a node is a run of
    rows, and meets its ancestors (the items before it) once."""
    rows = len(starts)
    same = np.zeros(rows, np.int64)  # items that a row shares with the one before
    open_ = np.arange(1, rows)
    depth = 0
    while len(open_):
        open_ = open_[(lengths[open_] > depth) & (lengths[open_ - 1] > depth)]
        a, b = starts[open_] + depth, starts[open_ - 1] + depth
        open_ = open_[(place[a] == place[b]) & (p[a] == p[b])]
        same[open_] += 1
        depth += 1
    below = np.r_[0, np.cumsum(times)]
    found: dict[tuple[int, int], int] = defaultdict(int)
    for depth in range(1, int(lengths.max(initial=0))):
        begins = np.flatnonzero(same <= depth)  # here a run of rows with one node ends, and perhaps another begins
        terms = below[np.r_[begins[1:], rows]] - below[begins]
        new = lengths[begins] > depth
        begins, terms = begins[new], terms[new]
        step = max(1, COMBINED // depth)
        for k in range(0, len(begins), step):
            top = starts[begins[k:k + step]]
            ancestor = (top[:, None] + np.arange(depth)).ravel()
            node, many = np.repeat(top + depth, depth), np.repeat(terms[k:k + step], depth)
            ps, bs, pt, bt = p[node], absent[node], p[ancestor], absent[ancestor]
            pair, at = np.unique(place[node] << 32 | place[ancestor], return_inverse=True)
            there, back = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            np.add.at(there, at, (_f(ps, pt) - _f(ps, bt) - _f(bs, pt) + _f(bs, bt)) * many)
            np.add.at(back, at, (_f(pt, ps) - _f(pt, bs) - _f(bt, ps) + _f(bt, bs)) * many)
            for key, x, y in zip(pair.tolist(), there.tolist(), back.tolist()):
                s, t = key >> 32, key & 0xFFFFFFFF
                found[s, t] += x
                found[t, s] += y
    return found


_SUMS = "lang string, s int, t int, value long"
_SUMS_ARROW = pa.schema([("lang", pa.string()), ("s", pa.int32()), ("t", pa.int32()), ("value", pa.int64())])


def _trees(batches):
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        times = batch.column("times").to_numpy()
        path = batch.column("path")
        ends = path.offsets.to_numpy().astype(np.int64)
        items = path.values
        place, p, absent = (items.field(k).to_numpy().astype(np.int64) for k in range(3))
        code, out = langs.indices.to_numpy(), []
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            at = np.flatnonzero(code == k)
            sums = tree_sums(place, p, absent, ends[at], ends[at + 1] - ends[at], times[at])
            out += [(lang, s, t, value) for (s, t), value in sums.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SUMS_ARROW)],
                                             schema=_SUMS_ARROW)


def shared_terms(shares: DataFrame) -> DataFrame:
    """(lang, s, t, value): corrections for terms that both sources have."""
    rows = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("place", "p", "absent"))).alias("path"))
    paths = rows.filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    # ranges by the first items only: what Spark samples for them stays short
    begin = F.transform(F.slice("path", 1, 3), lambda x: F.struct(x["place"], x["p"]))
    dealt = paths.repartitionByRange("lang", begin).sortWithinPartitions("lang", "path")
    return dealt.mapInArrow(_trees, _SUMS)


# ---- the audit -----------------------------------------------------------------------------------------


def _others(sources: DataFrame) -> DataFrame:
    """The other side of a join by language, dealt over PARTS keys."""
    return sources.select(F.col("lang"), F.col("place").alias("t"), F.col("source").alias("item"),
                          F.col("absent").alias("t_absent"),
                          F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))


def source_divergence(docs: DataFrame, spread: int = SPREAD, top: int = TOP, lang_col: str = "lang",
                      source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    entries = C.stored(kept_counts(base, spread), "divergence-counts")
    sources = C.stored(source_table(base, entries), "divergence-sources")
    shares = (entries.join(sources, ["lang", "source"])
              .withColumn("p", share(F.col("n") + 1, F.col("size"))))

    # every ordered pair of sources, as if no term were in either
    none = (sources.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int"))
            .join(_others(sources), ["lang", "part"]).filter(F.col("place") != F.col("t"))
            .select("lang", F.col("place").alias("s"), "t", "source", "item",
                    (F.col("v") * divergence(F.col("absent"), F.col("t_absent"))).alias("base")))
    # terms of one source, by share: what they change for every other source, seen from either
    single = (shares.groupBy("lang", "place", "p", "absent").agg(F.count(F.lit(1)).alias("times"))
              .withColumn("part", F.pmod(F.xxhash64("p"), F.lit(PARTS)).cast("int"))
              .join(_others(sources), ["lang", "part"]).filter(F.col("place") != F.col("t")))
    p, own, other = F.col("p"), F.col("absent"), F.col("t_absent")
    single = single.groupBy("lang", "place", "t").agg(
        F.sum(F.col("times") * (divergence(p, other) - divergence(own, other))).alias("there"),
        F.sum(F.col("times") * (divergence(other, p) - divergence(other, own))).alias("back"))
    changes = (single.select("lang", F.col("place").alias("s"), "t", F.col("there").alias("value"))
               .unionByName(single.select("lang", F.col("t").alias("s"), F.col("place").alias("t"), F.col("back").alias("value")))
               .unionByName(shared_terms(shares)).groupBy("lang", "s", "t").agg(F.sum("value").alias("change")))
    value = (F.col("base") + F.coalesce("change", F.lit(0))).cast("long")
    pairs = none.join(changes, ["lang", "s", "t"], "left").select("lang", "source", F.lit("pair").alias("part"), "item",
                                                                  value.alias("value"))
    own_share, q = F.col("p"), F.col("q")
    terms = (shares.withColumn("q", share(F.col("whole") + 1, F.col("lang_size"))).filter(own_share > q)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     divergence(own_share, q).alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return (pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top)))
