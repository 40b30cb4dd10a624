"""Exact dedup by Patricia tries: equal texts meet in one partition and share one terminal node."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwell.llm.shared import staged

SPACES = r"[\x20\x09-\x0D]+"


class Node:
    """An edge label and what hangs below it; ``members`` is None unless a string ends here."""

    __slots__ = ("label", "kids", "owner", "count", "members")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.count, self.members = label, {}, None, 0, None


def shared_length(label: bytes, data: bytes, at: int) -> int:
    """How many bytes of ``label`` agree with ``data`` from ``at``; the first one does."""
    low, high = 1, min(len(label), len(data) - at)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if data.startswith(label[:middle], at) else (low, middle - 1)
    return low


class Trie:
    """A compressed radix trie over bytes whose terminal nodes hold the smallest identifier, a count and members."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, data: bytes, owner: int | None, count: int, member) -> None:
        node, at = self.root, 0
        while at < len(data):
            kid = node.kids.get(data[at])
            if kid is None:
                kid = node.kids[data[at]] = Node(data[at:])
                self.held += len(kid.label) + 200
                at = len(data)
            elif data.startswith(kid.label, at):
                at += len(kid.label)
            else:
                common = shared_length(kid.label, data, at)
                upper = Node(kid.label[:common])
                kid.label = kid.label[common:]
                upper.kids[kid.label[0]] = kid
                node.kids[data[at]] = kid = upper
                self.held += 200
                at += common
            node = kid
        if node.members is None:
            node.members = []
        node.members.append(member)
        self.held += 40
        node.count += count
        if owner is not None and (node.owner is None or owner < node.owner):
            node.owner = owner

    def heaviest(self) -> int:
        """The first byte of the subtree below the root with the most text and members."""
        return max(self.root.kids, key=lambda first: self._weight(self.root.kids[first]))

    @staticmethod
    def _weight(top: Node) -> int:
        total, todo = 0, [top]
        while todo:
            node = todo.pop()
            total += len(node.label) + 200 + 40 * len(node.members or ())
            todo.extend(node.kids.values())
        return total

    def cut(self, first: int) -> Iterator[tuple[bytes, Node]]:
        """Take the subtree that starts with ``first`` out and give its strings."""
        top = self.root.kids.pop(first)
        self.held -= self._weight(top)
        return walk(top, b"")

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        return walk(self.root, b"")


def walk(top: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
    todo = [(top, prefix)]
    while todo:
        node, before = todo.pop()
        here = before + node.label
        if node.members is not None:
            yield here, node
        todo.extend((kid, here) for kid in node.kids.values())


LOCAL = "doc_id long, token long, body binary, owner long, copies long"
OWNERS = "token long, keep_id long, group_size long, text_sha256 string"


def local_groups(memory: int):
    """Group the texts of one task: a row per document with its local group's token; the first also carries the text.

    When the trie holds more than ``memory`` bytes its heaviest subtree is given out; a text that comes again
    later starts another local group, which the second step joins to the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, trie = TaskContext.get().partitionId() << 36, 0, Trie()
        rows: list[tuple] = []
        size = 0

        def give(found):
            nonlocal made, size
            for text, node in found:
                token = base + made
                made += 1
                rows.append((node.members[0], token, text, node.owner, node.count))
                rows.extend((doc, token, None, None, None) for doc in node.members[1:])
                size += len(text) + 40 * node.count
                if size > 8 << 20:
                    yield batch(rows, LOCAL_FIELDS)
                    rows.clear()
                    size = 0

        for part in batches:
            for doc, body in zip(part["doc_id"].to_pylist(), part["body"]):
                trie.insert(body.as_py(), doc, 1, doc)
                if trie.held > memory and trie.root.kids:
                    yield from give(trie.cut(trie.heaviest()))
        yield from give(trie.terminals())
        yield batch(rows, LOCAL_FIELDS)

    return run


def owners(memory: int):
    """Merge the local groups of one partition in a trie; a subtree that does not fit is spilled and merged last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        # unnamed files of this task: gone with the task, and made again if the task is
        spilled: dict[int, tempfile._TemporaryFileWrapper] = {}

        def spill(first: int) -> None:
            file = spilled.get(first) or spilled.setdefault(first, tempfile.TemporaryFile())
            for text, node in trie.cut(first):
                pickle.dump((text, node.owner, node.count, node.members), file)

        for part in batches:
            for body, owner, copies, token in zip(part["body"], part["owner"].to_pylist(), part["copies"].to_pylist(), part["token"].to_pylist()):
                trie.insert(body.as_py(), owner, copies, token)
                if trie.held > memory and trie.root.kids:
                    spill(trie.heaviest())
        for first in spilled.keys() & trie.root.kids.keys():
            spill(first)
        yield from summed(trie)
        for file in spilled.values():
            merged = Trie()
            file.seek(0)
            while True:
                try:
                    text, owner, count, members = pickle.load(file)
                except EOFError:
                    break
                for i, token in enumerate(members):
                    merged.insert(text, owner, count if i == 0 else 0, token)
            file.close()
            yield from summed(merged)

    def summed(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows = []
        for text, node in trie.terminals():
            digest = hashlib.sha256(text).hexdigest()
            rows.extend((token, node.owner, node.count, digest) for token in node.members)
            if len(rows) > 50_000:
                yield batch(rows, OWNER_FIELDS)
                rows = []
        yield batch(rows, OWNER_FIELDS)

    return run


LOCAL_FIELDS = pa.schema([("doc_id", pa.int64()), ("token", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
OWNER_FIELDS = pa.schema([("token", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def exact_groups(docs: DataFrame, memory: int = 192 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space became one space; a null text is empty.
    The smallest doc_id of a group stays. A row without doc_id counts in its group and stays only if no row of the
    group has one; a repeated row stays with its twin. Other columns are ignored; an empty table gives no rows.

    A task first groups its own rows, so a text travels once per task however often it occurs, and a hot group is
    never in one place: the second trie sees one entry per task, and the join back goes by the task's own token.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ").cast("binary")
    local = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")).mapInArrow(local_groups(memory), LOCAL))
    entries = local.filter(F.col("body").isNotNull()).select("token", "body", "owner", "copies")
    dealt = entries.repartition(F.length("body"), F.xxhash64("body"))
    groups = dealt.mapInArrow(owners(memory), OWNERS)
    rows = local.select("doc_id", "token").join(groups, "token")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
