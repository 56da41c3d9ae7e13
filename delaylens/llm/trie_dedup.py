"""Exact duplicates by Patricia tries that own the smallest identifiers.

Texts are equal when they are identical without ASCII white space. A task puts
the bytes of its texts into a compressed radix trie; a terminal node holds the
number of rows and the owner, the row that stays: most code points in the
original text, then smallest doc_id.

1. One pass over the documents. Every row leaves its digest and length; every
   distinct text of a task leaves once, with its owner and count. A trie that
   passes ``Params.budget`` bytes sends its heaviest subtree on its way early.
2. Distinct texts are dealt by length and content hash, so equal texts of
   different tasks meet and a text has at most one row per task (and spill) of
   the first pass, however many copies there are. A trie per partition merges
   owners and counts byte for byte. A subtree that does not fit is spilled: its
   texts, and all later ones that lead there, leave the task unmerged, and are
   dealt anew by another hash in the next round; the others are done. Spilled
   rows are a written table, so lost executors repeat no earlier round.
3. Rows get their owner through the digest (SHA-256); a digest that stands for
   two texts of a partition is an error, so no row can get a wrong owner unseen.
   Owners of at least a thousandth of all rows are broadcast (at most a
   thousand), the others are joined by a shuffle.

Defined results: NULL counts as empty, empty texts are equal to each other;
doc_ids that are NULL are larger than all others; of rows that agree in code
points and doc_id one stays; every row of a repeated doc_id has its own result;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.llm.common import join_groups, materialise, slices

SPACE = b" \t\n\v\f\r"
OWNER = "doc_id long, points long, place long, sha binary, n long"
TEXT = "size long, hash long, body binary"


@dataclass(frozen=True)
class Params:
    budget: int = 48 << 20    # bytes of a trie, about; one text at least
    node: int = 240           # bytes of a node besides its label, about
    batch: int = 8 << 20      # bytes of a batch of texts
    partitions: int = 50_000  # of a later round, at most


class Node:
    __slots__ = ("label", "children", "bytes", "owner", "spilled")

    def __init__(self, label: bytes, size: int):
        self.label, self.children, self.bytes = label, {}, size
        self.owner: tuple | None = None   # (-points, id is NULL, id, place, n, digest)
        self.spilled = False


class Trie:
    """Compressed radix trie; terminal nodes keep the smallest owner and the number of rows."""

    def __init__(self, params: Params):
        self.params, self.root, self.texts = params, Node(b"", 0), 0

    def add(self, key: bytes, owner: tuple) -> bool:
        """Insert a text or merge it with an equal one; False where its subtree has been spilled."""
        node, at, path, grown = self.root, 0, [], 0
        while True:
            path.append(node)
            if node.spilled:
                return False
            if at == len(key):
                break
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:], 0)
                node.children[key[at]] = child
                grown += len(child.label) + self.params.node
                path.append(child)
                node = child
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = common(label, key, at)
            fork = Node(label[:shared], child.bytes)
            child.label = label[shared:]
            child.bytes -= shared
            fork.children[child.label[0]] = child
            node.children[key[at]] = fork
            grown += self.params.node
            node, at = fork, at + shared
        for n in path:
            n.bytes += grown
        self.texts += node.owner is None
        node.owner = owner if node.owner is None else merged(node.owner, owner)
        return True

    def heaviest(self) -> tuple[Node, bytes]:
        """A subtree of at most half the budget, or a single node, on the heaviest way down, and the text before it."""
        node, before = self.root, b""
        while live := [c for c in node.children.values() if not c.spilled]:
            before += node.label
            node = max(live, key=lambda c: c.bytes)
            if node.bytes * 2 <= self.params.budget:
                break
        return node, before

    def spill(self, stub: bool) -> Iterator[tuple[bytes, tuple]]:
        """Empty the heaviest subtree: its texts and owners. With ``stub``, later texts that lead there are refused."""
        node, before = self.heaviest()
        out = list(terminals(node, before))
        self.texts -= len(out)
        lost, at, key = node.bytes, self.root, before + node.label[:1]
        # the first byte decides among siblings, so a stub needs no more of its label
        way, place = [self.root], 0
        while at is not node:
            at = at.children[key[place]]
            place += len(at.label)
            way.append(at)
        for n in way:
            n.bytes -= lost
        if stub:
            node.label, node.children, node.owner, node.spilled, node.bytes = node.label[:1], {}, None, True, 0
        else:
            del way[-2].children[node.label[0]]
        yield from out

    def full(self) -> bool:
        """Past the budget; a single text always stays, so every round gets done with some."""
        return self.root.bytes > self.params.budget and self.texts > 1


def common(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of ``label`` and ``key[at:]``, by halving."""
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[lo:mid] == key[at + lo: at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def merged(a: tuple, b: tuple) -> tuple:
    if a[5] != b[5]:
        raise ValueError("equal texts with different digests")
    return *min(a[:4], b[:4]), a[4] + b[4], a[5]


def terminals(node: Node, before: bytes) -> Iterator[tuple[bytes, tuple]]:
    """Texts and owners below ``node`` (depth first, without recursion)."""
    rest = [(node, before)]
    while rest:
        node, before = rest.pop()
        text = before + node.label
        if node.owner is not None:
            yield text, node.owner
        rest.extend((c, text) for c in node.children.values())


def owner(points: int, doc_id: int | None, place: int, n: int, sha: bytes) -> tuple:
    return -points, doc_id is None, doc_id or 0, place, n, sha


def owner_columns(owners: list[tuple]) -> list[pa.Array]:
    points, null, doc_id, place, n, sha = zip(*owners)
    return [pa.array([None if x else i for x, i in zip(null, doc_id)], pa.int64()),
            pa.array([-p for p in points], pa.int64()), pa.array(place, pa.int64()), pa.array(sha, pa.binary()),
            pa.array(n, pa.int64())]


def text_columns(texts: list[bytes], shas: list[bytes]) -> list[pa.Array]:
    return [pa.array(map(len, texts), pa.int64()),
            pa.array([int.from_bytes(s[:8], "little", signed=True) for s in shas], pa.int64()), pa.array(texts, pa.binary())]


def batched(found: Iterable[tuple[bytes, tuple]], params: Params) -> Iterator[tuple[list, list]]:
    """Lists of texts and owners of about a batch's bytes."""
    texts, owners, held = [], [], 0
    for text, own in found:
        texts.append(text)
        owners.append(own)
        held += len(text) + 64
        if held >= params.batch:
            yield texts, owners
            texts, owners, held = [], [], 0
    if texts:
        yield texts, owners


def first_pass(documents: DataFrame, params: Params) -> DataFrame:
    """Every row (``body`` NULL), and every distinct text of a task with its owner so far."""
    schema = f"{OWNER}, {TEXT}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, place = Trie(params), TaskContext.get().partitionId() << 36

        def leave(found):
            for texts, owners in batched(found, params):
                yield pa.RecordBatch.from_arrays(owner_columns(owners) + text_columns(texts, [o[5] for o in owners]), names)

        for part in slices(batches, "text", params.batch):
            raw = part.column("text").fill_null("")
            points = pc.utf8_length(raw).to_pylist()
            ids = part.column("doc_id").to_pylist()
            owners = []
            for text, length, doc_id in zip(raw.cast(pa.binary()).to_pylist(), points, ids):
                body = text.translate(None, SPACE)
                own = owner(length, doc_id, place, 1, hashlib.sha256(body).digest())
                place += 1
                owners.append(own)
                trie.add(body, own)
                while trie.full():
                    yield from leave(trie.spill(stub=False))
            none = pa.nulls(len(owners), pa.int64())
            yield pa.RecordBatch.from_arrays([*owner_columns(owners), none, none, pa.nulls(len(owners), pa.binary())], names)
        yield from leave(terminals(trie.root, b""))

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, schema))


def merge_round(texts: DataFrame, params: Params, number: int) -> DataFrame:
    """One trie per partition of length and content hash; ``body`` stays only on spilled rows.

    What earlier rounds spilled is dealt to as many partitions as tries of half the budget need.
    """
    schema = f"{OWNER}, {TEXT}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(params)

        def leave(found):
            for texts, owners in batched(found, params):
                yield pa.RecordBatch.from_arrays(owner_columns(owners) + text_columns(texts, [o[5] for o in owners]), names)

        for part in slices(batches, "body", params.batch):
            refused = []
            columns = [part.column(c).to_pylist() for c in ("points", "doc_id", "place", "n", "sha")]
            for body, *values in zip(part.column("body").to_pylist(), *columns):
                own = owner(*values)
                if not trie.add(body, own):
                    refused.append((body, own))
                while trie.full():
                    yield from leave(trie.spill(stub=True))
            yield from leave(refused)
        done: set[bytes] = set()
        for _, owners in batched(terminals(trie.root, b""), params):
            before = len(done)
            done.update(o[5] for o in owners)
            if len(done) - before < len(owners):
                raise ValueError("one digest for different texts")
            none = pa.nulls(len(owners), pa.int64())
            yield pa.RecordBatch.from_arrays([*owner_columns(owners), none, none, pa.nulls(len(owners), pa.binary())], names)

    if number == 0:
        return texts.repartition("size", "hash").mapInArrow(run, schema)
    held = texts.agg(F.sum(F.col("size") + 2 * params.node)).first()[0]
    partitions = max(1, min(params.partitions, -(-2 * held // params.budget)))
    return texts.repartition(partitions, F.xxhash64("size", "hash", F.lit(number))).mapInArrow(run, schema)


def owners(documents: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, points, place, sha) and one owner per distinct text (doc_id, points, place, sha, n)."""
    both, _ = materialise(first_pass(documents, params), "texts")
    rows = both.where(F.col("body").isNull()).select("doc_id", "points", "place", "sha")
    left, found, number = both.where(F.col("body").isNotNull()), None, 0
    while True:
        out, _ = materialise(merge_round(left, params, number), "owners")
        done = out.where(F.col("body").isNull()).select("doc_id", "points", "place", "sha", "n")
        found = done if found is None else found.unionByName(done)
        left, number = out.where(F.col("body").isNotNull()), number + 1
        if left.isEmpty():
            return rows, found


def exact_groups(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``documents``."""
    rows, found = owners(documents, params)
    groups = found.select("sha", F.col("doc_id").alias("keep_id"), F.col("place").alias("keep_place"), F.col("n").alias("group_size"))
    joined = join_groups(rows, groups, "sha", "group_size", rows.count())
    return joined.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"),
                         F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``documents`` that stay, all columns, one of each group of equal texts."""
    names = documents.columns
    sha, points = (next(x for k in range(len(names) + 1) if (x := f"_{name}{k}") not in names) for name in ("sha", "points"))
    _, found = owners(documents, params)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = F.regexp_replace(text, r"[ \t\n\x0B\f\r]", "")
    keyed = documents.withColumns({sha: F.unhex(F.sha2(body.cast("binary"), 256)), points: F.length(text).cast("long")})
    same = ((keyed[sha] == found["sha"]) & (keyed[points] == found["points"])
            & keyed["doc_id"].cast("long").eqNullSafe(found["doc_id"]))
    # rows that agree in text, code points and id: one of them
    return keyed.join(found, same, "left_semi").dropDuplicates([sha]).select(*names)


def oracle_sql() -> str:
    return r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST)"""
