"""Conversation repair against a brute-force search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

from privtab.llm import queries, turns

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute_audit(symbols):
    """Cheapest, then least, (cost, letters) from every place and state, last place first."""
    ahead = {0: (0, ""), 3: (0, ""), 2: (5, "I"), 1: (10, "II")}
    for role, fault in reversed(symbols):
        here = {}
        for state in range(4):
            options = []
            for inserts in range(3):
                q = state
                for _ in range(inserts):
                    q = 3 if q == 2 else 2
                moves = [("D", 2, q)]
                if fault != "goes":
                    more = 5 if fault == "cut" else 0
                    if role == "s" and q == 0:
                        moves.append(("K", more, 1))
                    if role == "u" and q != 2 or role == "a" and q == 2:
                        moves.append(("K", more, 3 if q == 2 else 2))
                    moves.append(("R", 1 + more, 3 if q == 2 else 2))
                options += [(5 * inserts + cost + ahead[after][0], "I" * inserts + letter + ahead[after][1])
                            for letter, cost, after in moves]
            here[state] = min(options)
        ahead = here
    return ahead[0]


CLASS = {"s": turns.SYSTEM, "u": turns.USER, "a": turns.ASSISTANT, "x": turns.OTHER}
FAULT = {"": turns.SOUND, "cut": turns.TRUNCATED, "goes": turns.GOES}


def runs(symbols):
    coded = [FAULT[f] << 2 | CLASS[r] for r, f in symbols]
    grouped = [(k, len(list(g))) for k, g in itertools.groupby(coded)]
    return [k for k, _ in grouped], [n for _, n in grouped]


def test_audit_of_every_short_conversation():
    alphabet = [(r, f) for r in "suax" for f in FAULT]
    for n in range(4):
        for symbols in itertools.product(alphabet, repeat=n):
            assert turns.audit(*runs(symbols)) == brute_audit(symbols), symbols


def test_audit_of_long_runs(monkeypatch):
    rng = random.Random(3)
    alphabet = [(r, f) for r in "suax" for f in FAULT]
    monkeypatch.setattr(turns, "BLOCK", 7)  # runs of several blocks
    for _ in range(300):
        symbols = [s for _ in range(rng.randint(1, 5)) for s in [rng.choice(alphabet)] * rng.choice((1, 2, 3, 20, 33))]
        assert turns.audit(*runs(symbols)) == brute_audit(symbols)


def test_powers_of_a_huge_run():
    cost, letters = turns.audit([turns.USER], [100_000])
    assert cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] for c in letters) == 50_000
    assert letters == "KR" * 50_000


def brute_repair(rows):
    """The contract, one conversation after another, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            after += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, symbols, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in after:
            letters = BLANK.findall(text)
            fault = ("blank" if not letters else "duplicate" if (role, text) in seen
                     else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1]
            symbols.append((initial if initial in ("s", "u", "a") else "x",
                            {"": "", "truncated": "cut"}.get(fault, "goes")))
        cost, letters = brute_audit(symbols)
        lines, at, last = [], 0, ""
        for letter in letters:
            role, text = ("assistant" if last == "u" else "user"), ""
            if letter != "I":
                _, own, text = after[at]
                role = own if letter == "K" else role
                at += 1
            if letter != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        known = [t for t, _, _ in after if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:])]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts.values(),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, letters,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows, tmp_path, parts=3):
    named = "conv_id long, turn long, role string, text string, copies string, kind int, h1 int"
    frame = spark.createDataFrame([(*r, "x", 9, 3) for r in rows], named)
    frame.repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_repair(rows)
    assert len(got) == len({r[0] for r in rows})


def test_contract_on_awkward_rows(spark, tmp_path):
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "ünder", "use"]
    texts = ["Yes.", "No!", "so", " \t", "", None, "Why? ", "a\nb.", "é", "Ends. \x0b", "x" * 50_000, "again."]
    rows = []
    for conv in [*range(60), None, -3]:
        for turn in range(rng.randint(0, 9)):
            weights = [6, 6, 2, 1, 1, 1, 1, 1]
            rows.append((conv, turn * rng.choice((1, 1, 1, 2)) + 100 * turn, rng.choices(roles, weights)[0],
                         rng.choice(texts)))
        rows.append((conv, None, rng.choice(roles), rng.choice(texts)))
    rows += [r for r in rows if r[1] is not None][:5]  # repeated rows
    rows += [(500, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(3000)]  # one large conversation
    rows.append((700, next(t for t in range(999) if zlib.crc32(f"700:{t}".encode()) % 20 == 0), "user", "gone."))
    check(spark, rows, tmp_path)


def test_pieces_of_one_conversation(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]) if t % 2 else "user", f"{rng.randint(0, 90)}.")
            for t in range(0, 4000, 2)]
    check(spark, rows, tmp_path)


def test_empty_table_and_repaired_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert turns.repair(turns.plain_rows(empty)).collect() == []
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hi!"), (2, 0, "user", "why"),
            (2, 1, "assistant", "So.")]
    got = turns.repaired_turns(turns.plain_rows(spark.createDataFrame(rows, schema))).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in got] == [
        (1, "R", "user", "Hello."), (1, "R", "assistant", "Hi!"), (1, "D", "user", "Hi!"),
        (2, "D", "user", "why"), (2, "D", "assistant", "So.")]


def test_given_table(spark):
    got = {r[0]: tuple(r[1:]) for r in queries.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert got == brute_repair(rows)
