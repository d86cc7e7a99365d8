"""Line dedup against brute force on awkward rows."""

import hashlib
import random
from collections import defaultdict

from privtab.llm import linedup, queries

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))


def brute(rows):
    """A null id is one document before all others."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 40:
                holders[key_of(line)].add(float("-inf") if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [k for k, line in enumerate(lines) if len(holders[key_of(line)]) >= 5 and max(holders[key_of(line)]) != i]
        kept = "\n".join(line for k, line in enumerate(lines) if k not in set(gone))
        out.append((i, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest(), gone, kept))
    return out


def order(row):
    return (row[0] is not None, row[0] or 0, row[3])


def some_rows():
    rng = random.Random(6)
    shared = [f"Shared line {i} É " + "x" * rng.randint(20, 45) for i in range(12)]
    rows = []
    for i in range(120):
        lines = [rng.choice(["short", "", " \t", f"line of its own {i} " + "y" * 40]) for _ in range(rng.randint(0, 6))]
        lines += rng.choices(shared, k=rng.randint(0, 4))
        lines = [rng.choice(["", " ", "\t\x0b"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", "\r"])
                 for x in lines]
        rng.shuffle(lines)
        rows.append((i - 20, "\n".join(lines)))
    rows += [(None, "\n".join(shared[:6])), (None, "\n".join(shared[3:9])), (None, None), (200, None), (201, ""), (202, "\n\n")]
    rows += rows[30:34] + [(rows[40][0], rows[41][1])]  # repeated rows, and an id with two texts
    rows.append((300, "\n".join(f"{'z' * 40}{i % 50}" for i in range(5000)) + "\n" + shared[0]))
    rows += [(301 + k, "\n".join(f"{'Z' * 40}{i}" for i in range(50))) for k in range(5)]
    rows += [(400 + k, "e" * 39 + "É" * (k % 2)) for k in range(12)]  # 39 and 40 code points
    return rows


def test_against_brute_force(spark):
    rows = some_rows()
    named = "doc_id long, text string, sig string, place int, h1 int, last string, carry int"
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], named).repartition(4)
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest(), r.dropped, r.kept_text,
            r.carry.sig) for r in linedup.drop_common_lines(docs, carry=("sig",)).collect()]
    assert sorted((g[:6] for g in got), key=order) == sorted(brute(rows), key=order)
    assert all(g[6] == "x" for g in got)


def test_empty_table(spark):
    assert linedup.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_line_dedup(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(r[:4] for r in brute(rows))
