"""Repair of conversation structure by run-length dynamic programming.

Roles should read `(s?(ua)+)?`. Walking through a conversation, a row is kept,
given another role or deleted, and empty turns may be inserted; the state is
what came last (nothing, system, user, assistant). Equal consecutive symbols
(role initial and fault) are collapsed into runs; a run advances the costs of
the four states through cached binary powers of its symbol's min-plus
transition. The costs-to-go at the runs' borders then say, state by state,
which edits stay cheapest, and the smallest letter is taken each time.

On Spark: faults are found on light rows (a digest instead of the text), which
are sorted by conversation and stream through the dynamic program; its answers
travel as one header row per conversation in front of the sorted texts, which
stream into the hash of the repaired conversation. A task holds one Arrow batch
and, per row of the conversation at hand, a few bytes: its symbol and letter.
A conversation's hash is sequential, so one task reads one conversation.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vanflow.llm.base import map_rows, type_of
from vanflow.session import materialise

# Blanks, sentence ends, legal neighbours and the prices of edits.
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
LEGAL = frozenset({"su", "ua", "au"})
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)  # what came last
_NEXT = (USER, USER, ASSISTANT, USER)  # state after a user/assistant turn put in place
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 60
MUST_DELETE = 0
_CLASSES = "sua"
BLOCK = 1024  # rows of a run whose costs are unrolled at a time


def symbol(initial: str, must_delete: bool, truncated: bool) -> int:
    if must_delete:
        return MUST_DELETE
    kind = _CLASSES.find(initial) if initial else -1
    return 1 + 2 * (kind if kind >= 0 else 3) + truncated


def _moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """Letters that take a row of this symbol away, with price and next state; ascending by letter."""
    out = [("D", DELETE, state)]
    if code != MUST_DELETE:
        kind, extra = divmod(code - 1, 2)
        after = _KEPT.get(_CLASSES[kind : kind + 1], {}).get(state)
        if after is not None:
            out.append(("K", extra * TRUNCATED, after))
        out.append(("R", REROLE + extra * TRUNCATED, _NEXT[state]))
    return out


MOVES = [[_moves(code, state) for state in range(4)] for code in range(9)]
Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def advance(matrix: Matrix, costs: Vector) -> Vector:
    a, b, c, d = costs
    return tuple(min(r[0] + a, r[1] + b, r[2] + c, r[3] + d) for r in matrix)


def _insertions() -> Matrix:
    rows = []
    for state in range(4):
        row, at, price = [_FAR] * 4, state, 0
        for _ in range(4):
            row[at] = min(row[at], price)
            at, price = _NEXT[at], price + INSERT
        rows.append(tuple(row))
    return tuple(rows)


_INSERTED = _insertions()
END: Vector = tuple(min(_INSERTED[state][START], _INSERTED[state][ASSISTANT]) for state in range(4))


def _transition(code: int) -> Matrix:
    step = []
    for state in range(4):
        row = [_FAR] * 4
        for _, price, after in MOVES[code][state]:
            row[after] = min(row[after], price)
        step.append(tuple(row))
    return _times(_INSERTED, tuple(step))


_POWERS: list[list[Matrix]] = [[_transition(code)] for code in range(9)]  # of 1, 2, 4, ... rows


def advance_run(code: int, rows: int, costs: Vector) -> Vector:
    """Costs-to-go before `rows` equal symbols, from those after them."""
    powers, bit = _POWERS[code], 0
    while rows >> bit:
        if bit == len(powers):
            powers.append(_times(powers[-1], powers[-1]))
        if rows >> bit & 1:
            costs = advance(powers[bit], costs)
        bit += 1
    return costs


class Runs:
    """Run-length encoded symbols of one conversation."""

    def __init__(self):
        self.codes, self.lengths = array("B"), array("q")

    def add(self, code: int, rows: int = 1) -> None:
        if not rows:
            return
        if self.codes and self.codes[-1] == code:
            self.lengths[-1] += rows
        else:
            self.codes.append(code)
            self.lengths.append(rows)

    def solve(self) -> tuple[int, str]:
        """Least cost, and the smallest letters that reach it."""
        n = len(self.codes)
        border = array("q", bytes(32 * n)) if n else array("q")  # costs-to-go after each run
        costs = END
        for i in range(n - 1, -1, -1):
            border[4 * i : 4 * i + 4] = array("q", costs)
            costs = advance_run(self.codes[i], self.lengths[i], costs)
        least, state, letters = costs[START], START, []
        for i in range(n):
            code, rows, after = self.codes[i], self.lengths[i], tuple(border[4 * i : 4 * i + 4])
            for low in range(0, rows, BLOCK):
                size = min(BLOCK, rows - low)
                ahead = [advance_run(code, rows - low - size, after)]
                for _ in range(size):
                    ahead.append(advance(_POWERS[code][0], ahead[-1]))
                for j in range(size, 0, -1):
                    state = self._row(code, state, ahead[j], ahead[j - 1], letters)
        while state in (SYSTEM, USER):
            letters.append("I")
            state = _NEXT[state]
        return least, "".join(letters)

    @staticmethod
    def _row(code: int, state: int, here: Vector, after: Vector, letters: list[str]) -> int:
        while True:
            (_, price, gone), *others = MOVES[code][state]
            if price + after[gone] == here[state]:
                letters.append("D")
                return gone
            if INSERT + here[_NEXT[state]] == here[state]:
                letters.append("I")
                state = _NEXT[state]
                continue
            for letter, price, then in others:
                if price + after[then] == here[state]:
                    letters.append(letter)
                    return then


class Repaired:
    """A conversation under its edits: rows go in, the hash of its lines `role:text` comes out."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.sha = audit, 0, START, 0, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, _NEXT[self.state]
            self._put(_NAMES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEPT[role[:1]][self.state]
            self._put(role, text)
        elif letter == "R":
            self.state = _NEXT[self.state]
            self._put(_NAMES[self.state], text)

    def finish(self) -> str:
        self._insert()
        return self.sha.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with planted faults, by crc32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats
    it, 4 makes the user speak. Nulls read as one space.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    case = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), case.alias("_case")).where("_case != 0").select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _plan(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """Counts, cost and letters of every conversation, from its sorted light rows."""
    names = ("conv_id", *_COUNTS, "audit")
    out: dict[str, list] = {n: [] for n in names}
    held, current = 0, None  # current: a 1-tuple with the conversation at hand

    def close() -> None:
        nonlocal held
        cost, audit = runs.solve()
        gaps = high - low + 1 - turns if turns else 0
        for n, v in zip(names, (current[0], gaps, *faults, illegal, cost, audit)):
            out[n].append(v)
        held += len(audit)

    for batch in batches:
        columns = (batch[n] for n in ("conv_id", "turn", "role", "fault", "first", "copies"))
        for conv, turn, role, fault, first, copies in zip(*columns):
            if current is None or conv != current[0]:
                if current:
                    close()
                current, runs, faults, illegal, before = (conv,), Runs(), [0, 0, 0], 0, None
                low = high = None
                turns = 0
            if not copies:
                continue
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            initial = role[:1]
            illegal += copies - 1 + (before is not None and before + initial not in LEGAL)
            before = initial
            if fault == "blank":
                faults[0] += copies
                runs.add(MUST_DELETE, copies)
                continue
            repeats = copies - 1 if first else copies
            faults[1] += repeats
            if first:
                faults[2] += fault == "truncated"
                runs.add(symbol(initial, False, fault == "truncated"))
            runs.add(MUST_DELETE, repeats)
        if held > 1 << 20 or len(out["cost"]) > 5000:
            yield out
            out, held = {n: [] for n in names}, 0
    if current:
        close()
    yield out


def _hash(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """The answers with the hash of each repaired conversation, from its header row and its sorted texts."""
    names = ("conv_id", *_COUNTS, "audit", "repaired_sha256")
    out: dict[str, list] = {n: [] for n in names}
    header = None

    def close() -> None:
        for n, v in zip(names, (*header, repaired.finish())):
            out[n].append(v)

    for batch in batches:
        columns = (batch[n] for n in ("conv_id", *_COUNTS, "audit", "role", "text"))
        for *answer, role, text in zip(*columns):
            if answer[-1] is None:
                repaired.row(role, text)
                continue
            if header:
                close()
            header, repaired = answer, Repaired(answer[-1])
        if len(out["conv_id"]) > 5000:
            yield out
            out = {n: [] for n in names}
    if header:
        close()
    yield out


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: faults found, cost and letters of the cheapest edits, hash of what they leave.

    Reads conv_id, turn, role and text of any table of turns (`damage` gives
    one); a row without turn, role and text stands for a conversation without
    rows. Rows are taken by turn (null first), of one turn by role and text
    digest, so repeated rows are neighbours; a null conversation is one; a null
    role or text reads as one space; an empty table gives no rows; further
    columns are ignored.
    """
    blank = F.lit(" ")
    empty = F.col("turn").isNull() & F.col("role").isNull() & F.col("text").isNull()
    markers = conversations.where(empty).select("conv_id").distinct()
    rows = conversations.where(~empty).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(*STOPS), "truncated")
    light = rows.select("conv_id", "turn", "role", "digest", fault.alias("fault"))
    light = light.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count("*").alias("copies"))
    order = [F.asc_nulls_first("turn")]
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(*order)) == 1
    light = light.withColumn("first", first).unionByName(markers.withColumn("copies", F.lit(0).cast("long")), allowMissingColumns=True)
    kind = type_of(conversations, "conv_id")
    numbers = ", ".join(f"{n} long" for n in _COUNTS)
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", *order, "role", "digest")
    plans = materialise(map_rows(ordered, _plan, f"conv_id {kind}, {numbers}, audit string"), "repair")
    texts = plans.unionByName(rows, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc_nulls_last("audit"), *order, "role", "digest"
    )
    return map_rows(
        texts.select("conv_id", *_COUNTS, "audit", "role", "text"), _hash, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string"
    )


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Repair of the damaged conversations; one that lost all its rows is answered too."""
    damaged = damage(conversations)
    return repair(damaged.unionByName(conversations.select("conv_id").distinct(), allowMissingColumns=True))
