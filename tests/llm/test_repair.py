"""Conversation repair against an exhaustive search for the cheapest, smallest edits."""

import hashlib
import heapq
import random
import re
import zlib

from vanflow.llm import repair

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if case == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def cheapest(rows):
    """Dijkstra over (cost, letters): rows as (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, word, lines = heapq.heappop(heap)
        if (at, word) in done:
            continue
        done.add((at, word))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", word):
            return cost, letters, "\n".join(lines)
        legal = lambda c: re.fullmatch("s?(ua)*u?", word + c) and word + c

        def push(price, letter, to, word, line=()):
            short = {"s": "s", "u": "u", "a": "ua"}[word[-1]]  # nothing else decides what may follow
            heapq.heappush(heap, (cost + price, letters + letter, to, short, lines + line))

        for role in ("user", "assistant"):
            if legal(role[0]):
                push(2, "I", at, legal(role[0]), (f"{role}:",))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, letters + "D", at + 1, word, lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role and legal(role[0]) and role[0] in "sua":
                    push(extra, "K", at + 1, legal(role[0]), (f"{role}:{text}",))
                for other in ("user", "assistant"):
                    if legal(other[0]):
                        push(2 + extra, "R", at + 1, legal(other[0]), (f"{other}:{text}",))


def plain(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = damaged([r for r in table if r[0] == conv])
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, role, text in rows:
            solid = BLANK.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            faulty.append((role, text, fault))
        initials = [r[:1] for r, _, _ in faulty]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters, lines = cheapest(faulty)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_given_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = repair.damaged_and_repaired(table).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_random_and_odd_conversations(spark):
    rng = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys", "u"]
    texts = ["yes.", "no", "", " \x0b", None, "Why?  ", " ", "same.", "same.", "a! b", ".", "été!\n"]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + rng.randrange(4), None]), rng.choice(roles), rng.choice(texts)))
    rows += [(500, 0, "user", None), (501, None, None, None), (502, 3, "user", "x" * 200_000 + ".")] + [(503, 1, "user", "again.")] * 4
    # conversations whose rows are all dropped
    rows += [(c, 0, "user", "gone.") for c in range(1000, 1200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS fault", "'x' AS audit", "2 AS cost").repartition(7)
    got = repair.damaged_and_repaired(df).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    assert repair.damaged_and_repaired(df.limit(0)).count() == 0


def test_long_runs_equal_row_by_row(monkeypatch):
    rng = random.Random(5)
    for block in (1, 3, 1024):
        monkeypatch.setattr(repair, "BLOCK", block)
        for _ in range(60):
            runs, rows = repair.Runs(), []
            for _ in range(rng.randrange(1, 6)):
                role, fault = rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["blank", None, "truncated"])
                n = rng.randrange(1, 7)
                runs.add(repair.symbol(role[0], fault == "blank", fault == "truncated"), n)
                rows += [(role, "t", fault)] * n
            assert runs.solve() == cheapest(rows)[:2]
    giant = repair.Runs()
    giant.add(repair.symbol("u", False, False), 100_001)
    cost, letters = giant.solve()
    assert cost == 2 * 50_000 + 2 and len(letters) == 100_002
