"""Source divergence against a dense brute force in Python integers."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from privtab.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows):
    count, whole, spread = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = TERM.findall(low)
        groups[lang].add(source)
        count[lang, source].update(words)
        whole[lang].update(words)
        spread[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in spread[lang].items() if n >= 3]
        size = {s: sum(count[lang, s][t] for t in kept) + len(kept) for s in sources}
        all_ = sum(size.values()) - (len(sources) - 1) * len(kept)

        def p(s, t):
            return 1 + 10**9 * (count[lang, s][t] + 1) // size[s]

        for s in sources:
            pairs = [(sum((p(s, t) - p(o, t)) ** 2 // p(o, t) for t in kept), o) for o in sources - {s}]
            terms = []
            for t in kept:
                q = 1 + 10**9 * (whole[lang][t] + 1) // all_
                if count[lang, s][t] and p(s, t) > q:
                    terms.append(((p(s, t) - q) ** 2 // q, t))
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)
                        if part == "pair" or k < 200]
    return sorted(out)


def some_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abÀéZß") for _ in range(rng.randint(1, 4))) for _ in range(400)] + ["日本"]
    rows = []
    for _ in range(300):
        own = rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 80))
        rows.append((rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot", "hot", "b", "c", "", None, "Ünd", "d"]),
                     rng.choice([" ", "\n", "1", "-"]).join(own)))
    rows += [("xx", "only", "a b c"), ("yy", "p", None), ("yy", "q", "rare"), (None, None, None), ("zz", "", "")]
    rows += [("one", "s", "same same word"), ("one", "s", "same word"), ("one", "s", "word same")] + rows[:9]
    return rows


def got(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in frame.collect())


def test_against_brute_force(spark):
    rows = some_rows()
    named = "lang string, source string, text string, term string, n int, p string, place long"
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], named).repartition(5)
    assert got(divergence.source_divergence(docs)) == brute(rows)


def test_small_blocks_and_pieces_change_nothing(spark, monkeypatch):
    rows = some_rows()[:80]
    text = "aa bb cc " * 40
    rows += [("en", "b", text), ("en", "b", text), ("en", "c", text)]
    batches = [b for b in _batches(rows)]
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD", 5)
    made = defaultdict(lambda: [0, 0])
    for b in divergence._count(iter(batches)):
        for r in b.to_pylist():
            cell = made[r["lang"], r["source"], r["term"]]
            cell[0] += r["n"]
            cell[1] += r["docs"]
    want = defaultdict(lambda: [0, 0])
    for lang, source, text in rows:
        words = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        for w, n in Counter(words).items():
            want[lang or "", source or "", w][0] += n
            want[lang or "", source or "", w][1] += 1
    assert made == want


def _batches(rows):
    import pyarrow as pa
    for k in range(0, len(rows), 7):
        part = rows[k:k + 7]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] or "" for x in part]) for i in range(3)],
                                         names=["lang", "source", "text"])


def test_tree_shares_beginnings():
    rng = random.Random(8)
    rows = Counter(tuple((s, rng.randint(1, 3)) for s in range(6) if rng.random() < 0.5) for _ in range(4000))
    absent = [11, 5, 7, 3, 2, 13]
    ordered = sorted((r, n) for r, n in rows.items() if len(r) > 1)
    flat = [(s, p * 100 + s, absent[s]) for r, _ in ordered for s, p in r]
    lengths = np.array([len(r) for r, _ in ordered])
    place, p, a = (np.array(c, np.int64) for c in zip(*flat))
    found = divergence.tree_sums(place, p, a, np.cumsum(lengths) - lengths, lengths, np.array([n for _, n in ordered]))
    f = divergence._f
    want = Counter()
    for r, n in ordered:
        for (s, x), (t, y) in itertools.permutations(r, 2):
            x, y, bx, by = x * 100 + s, y * 100 + t, absent[s], absent[t]
            want[s, t] += n * (f(x, y) - f(x, by) - f(bx, y) + f(bx, by))
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v}


def test_shares_are_exact_beyond_longs(spark):
    cases = [(1, 3), (10**12, 10**12 + 7), (8 * 10**14, 9 * 10**15 - 1), (9 * 10**15 - 1, 9 * 10**15 - 1), (1, 9 * 10**15 - 1)]
    made = spark.createDataFrame(cases, "a long, b long").select("a", "b", divergence.share(F.col("a"), F.col("b")).alias("s"))
    assert all(r.s == 1 + 10**9 * r.a // r.b for r in made.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.source_divergence(docs).collect() == []


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "source", "text").collect()]
    assert got(queries.op11_source_divergence(spark, "/root/testdata/sf0.001")) == brute(rows)
