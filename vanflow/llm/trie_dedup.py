"""Exact deduplication with Patricia tries.

Map side: each task inserts its whole byte strings into one compressed radix
trie of bounded size and tells every document the terminal node it reached; a
subtree that no longer fits is spilled as pre-aggregated rows. Reduce side:
terminal strings are dealt by (length, content hash) and inserted into the
tries of their partition, whose terminals keep the owner. A group of copies
therefore reaches the reduce side as a few rows per map task, however large it
is, and equality is decided by bytes, never by the hash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanflow.llm.base import keyed, map_rows, type_of
from vanflow.session import materialise

TRIE_BYTES = 48 << 20  # bytes a task's trie holds before a subtree is spilled
NODE_BYTES = 500  # what a node takes besides its label: objects, children, value

# The letters that are folded before texts are compared.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value = label, {}, value


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving on slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Patricia:
    """A compressed radix trie over byte strings, with a value at each terminal."""

    def __init__(self):
        self.root, self.bytes = Node(b""), NODE_BYTES

    def terminal(self, key: bytes) -> Node:
        """The node of a whole string, made where it is missing."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(key) - at + NODE_BYTES
                return child
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            shared = _common(child.label, key[at : at + len(child.label)])
            upper = Node(child.label[:shared])
            child.label = child.label[shared:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.bytes += NODE_BYTES
            node, at = upper, at + shared
        return node

    @staticmethod
    def terminals(node: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            here, before = stack.pop()
            whole = before + here.label
            if here.value is not None:
                yield whole, here.value
            stack.extend((child, whole) for child in here.children.values())

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Remove the root's subtree with the most bytes and give its terminals."""
        if not self.root.children:
            return
        sizes = {first: self._weight(child) for first, child in self.root.children.items()}
        first = max(sizes, key=sizes.get)
        self.bytes -= sizes[first]
        yield from self.terminals(self.root.children.pop(first))

    @staticmethod
    def _weight(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            here = stack.pop()
            total += len(here.label) + NODE_BYTES
            stack.extend(here.children.values())
        return total


def _later(a: tuple, b: tuple) -> tuple:
    """The owner of two (identifier, row number): largest identifier, then first row; null identifiers lose."""
    if (a[0] is None) != (b[0] is None):
        return b if a[0] is None else a
    if a[0] == b[0]:
        return min(a, b, key=lambda x: x[1])
    return max(a, b, key=lambda x: x[0])


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: the group's owner, its size and whether this row is the one that stays.

    Texts are equal when identical after lower-casing A-Z; the row with the
    largest identifier stays, of repeated identifiers the first row. A null
    text counts as empty, a null identifier loses against any other; an empty
    table gives no rows; further columns are ignored. `row` numbers the input
    rows; the same columns of the source come back with `kept_rows`.
    """
    source = keyed(docs, id_col, text_col)
    id_type = type_of(source, "doc_id")
    folded = source.select(
        "doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).cast("binary").alias("body")
    ).withColumn("text_sha256", F.sha2("body", 256))

    def insert(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        trie = Patricia()
        names = ("doc_id", "row", "node", "text_sha256", "owner", "owner_row", "copies", "body")
        out: dict[str, list] = {n: [] for n in names}
        held = 0

        def put(*values) -> None:
            for n, v in zip(names, values):
                out[n].append(v)

        def flush(terminals) -> None:
            nonlocal held
            for body, value in terminals:
                put(None, None, value[0], value[3], value[1][0], value[1][1], value[2], body)
                held += len(body)

        for batch in batches:
            for key, body, sha in zip(batch["doc_id"], batch["body"], batch["text_sha256"]):
                terminal = trie.terminal(body)
                if terminal.value is None:
                    terminal.value = (row, (key, row), 1, sha)
                else:
                    node, owner, copies, _ = terminal.value
                    terminal.value = (node, _later(owner, (key, row)), copies + 1, sha)
                put(key, row, terminal.value[0], sha, None, None, None, None)
                row += 1
                while trie.bytes > trie_bytes and trie.root.children:
                    flush(trie.spill())
                    if held > trie_bytes // 4:
                        yield out
                        out, held = {n: [] for n in names}, 0
            yield out
            out, held = {n: [] for n in names}, 0
        if trie.root.value is not None:
            flush([(b"", trie.root.value)])
        for first in list(trie.root.children):
            flush(trie.terminals(trie.root.children.pop(first)))
            yield out
            out, held = {n: [] for n in names}, 0
        yield out

    local = materialise(
        map_rows(
            folded, insert,
            f"doc_id {id_type}, row long, node long, text_sha256 string, owner {id_type}, owner_row long, copies long, body binary",
        ),
        "trie",
    )

    def merge(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        bucket, trie, nodes = None, Patricia(), []

        def answers() -> dict[str, list]:
            return {
                "node": [n for n, _ in nodes],
                "keep_id": [t.value[0][0] for _, t in nodes],
                "keep_row": [t.value[0][1] for _, t in nodes],
                "group_size": [t.value[1] for _, t in nodes],
            }

        for batch in batches:
            for length, sha, body, node, owner, owner_row, copies in zip(
                batch["length"], batch["text_sha256"], batch["body"], batch["node"], batch["owner"], batch["owner_row"], batch["copies"]
            ):
                if bucket != (length, sha):
                    # Equal strings share a bucket, so between two the whole trie of the partition may go.
                    if trie.bytes > trie_bytes // 4 or len(nodes) >= 5000:
                        yield answers()
                        trie, nodes = Patricia(), []
                    bucket = (length, sha)
                terminal = trie.terminal(body)
                if terminal.value is None:
                    terminal.value = ((owner, owner_row), copies)
                else:
                    best, size = terminal.value
                    terminal.value = (_later(best, (owner, owner_row)), size + copies)
                nodes.append((node, terminal))
        if nodes:
            yield answers()

    strings = local.where(F.col("body").isNotNull()).withColumn("length", F.octet_length("body"))
    dealt = strings.repartition("length", "text_sha256").sortWithinPartitions("length", "text_sha256")
    owners = map_rows(
        dealt.select("length", "text_sha256", "body", "node", "owner", "owner_row", "copies"), merge,
        f"node long, keep_id {id_type}, keep_row long, group_size long",
    )
    rows = local.where(F.col("row").isNotNull()).select("doc_id", "row", "node", "text_sha256")
    return rows.join(owners, "node").select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row"
    )

