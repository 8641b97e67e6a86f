"""SimHash near-duplicates found with a Gray-order hierarchical index.

Texts become 64-bit fingerprints. Two fingerprints that differ in at most four bits agree on at
least one of five bit blocks, so the upper nodes of the index are (block, value) patterns: every
fingerprint is dealt to its five nodes. Inside a node the members are sorted by Gray rank, runs of
neighbours share masked bit patterns, and a search walks down from run to run, adding up differing
bits and leaving out every run whose shared pattern alone differs in more than four.

Only links that span the components leave a node, never all its pairs.

Nulls: a null text is empty (fingerprint zero); a null doc_id names no component but its text links
others. Repeated rows and ties each give a row of their own. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import map_batches, per_task, texts
from corpusloom.session import store

SHINGLE = 4
SEED = 42
MAX_DIFFERENCE = 4
#: Five blocks over 64 bits: (first bit, width). Four differing bits leave one block untouched.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FANOUT = 16
#: A node of m members is searched in about sqrt(m) / CHUNK_ROOT chunks, pair by pair.
CHUNK_ROOT = 16
_HASH_RUN = 1 << 16


def fingerprint(text: str) -> int:
    """The unsigned SimHash of one text; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _HASH_RUN):
        run = b"".join(
            [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _HASH_RUN], ends[at : at + _HASH_RUN])]
        )
        bits = np.unpackbits(np.frombuffer(run, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batch) -> dict:
    marks = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
    return {"doc_id": batch.column("doc_id"), "mark": marks}


def _marked_rows(batch) -> dict:
    return {"_digest": batch.column("_digest"), **_fingerprints(batch)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long, a row per row of ``docs``."""
    return map_batches(docs.select("doc_id", "text"), _fingerprints, "doc_id long, mark long")


def gray_rank(marks: np.ndarray) -> np.ndarray:
    """Position of each pattern in the reflected Gray code."""
    rank = marks.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_index(marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, own mask) of every level, the leaves first; ``marks`` come in Gray order.

    The mask of a run has the bits on which all of it agrees; bits already held by the run above
    are taken out, so differences add up from the top down without counting a bit twice.
    """
    low = high = marks
    levels = [(marks, np.full(len(marks), 2**64 - 1, np.uint64))]
    while len(low) > FANOUT:
        at = np.arange(0, len(low), FANOUT)
        low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
        levels.append((low, ~(low ^ high)))
    for k in range(len(levels) - 1):
        pattern, mask = levels[k]
        above = levels[k + 1][1][np.arange(len(pattern)) // FANOUT]
        levels[k] = (pattern, mask & ~above)
    return levels


def search(levels, queries: np.ndarray, limit: int = MAX_DIFFERENCE) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) positions within ``limit`` differing bits."""
    top = len(levels[-1][0])
    query = np.repeat(np.arange(len(queries)), top)
    node = np.tile(np.arange(top), len(queries))
    apart = np.zeros(len(query), np.uint8)
    for depth in range(len(levels) - 1, -1, -1):
        pattern, mask = levels[depth]
        apart = apart + np.bitwise_count((queries[query] ^ pattern[node]) & mask[node])
        near = apart <= limit
        query, node, apart = query[near], node[near], apart[near]
        if depth:
            below = len(levels[depth - 1][0])
            query, apart = np.repeat(query, FANOUT), np.repeat(apart, FANOUT)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            inside = node < below
            query, node, apart = query[inside], node[inside], apart[inside]
    return query, node


def spanning_links(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component) among distinct marks, by the Gray-order index."""
    marks = marks[np.argsort(gray_rank(marks))]
    levels, label = gray_index(marks), np.arange(len(marks))
    step = max(1, (1 << 20) // len(levels[-1][0]))
    for at in range(0, len(marks), min(step, 512)):
        left, right = search(levels, marks[at : at + min(step, 512)])
        left = left + at
        while True:
            a, b = label[left], label[right]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    root = marks[label]
    linked = root != marks
    return marks[linked], root[linked]


@per_task
class _Nodes:
    """Searches each node of its partition; rows come sorted by node."""

    def __init__(self):
        self.node, self.held = None, []

    def _links(self, member: list, root: list) -> None:
        if self.held:
            marks = np.unique(np.concatenate(self.held))
            if len(marks) > 1:
                a, b = spanning_links(marks)
                member.append(a)
                root.append(b)

    def __call__(self, batch) -> dict:
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        marks = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero(np.diff(nodes)) + 1
        member, root = [], []
        for at, part in zip([0, *cuts], np.split(marks, cuts)):
            if nodes[at] != self.node:
                self._links(member, root)
                self.node, self.held = nodes[at], []
            self.held.append(part)
        return self._columns(member, root)

    def finish(self):
        member, root = [], []
        self._links(member, root)
        if out := self._columns(member, root):
            yield out

    @staticmethod
    def _columns(member: list, root: list) -> dict:
        if not member:
            return {}
        return {
            "a": np.concatenate(member).view(np.int64),
            "b": np.concatenate(root).view(np.int64),
        }


def _block(mark: Column, k: int) -> Column:
    """The upper node of a mark under block ``k``: block number and bits, as one long."""
    first, width = BLOCKS[k]
    bits = F.shiftrightunsigned(mark, 64 - first - width).bitwiseAND(F.lit((1 << width) - 1))
    return F.lit(k << 13).cast("long") + bits


def links(distinct_marks: DataFrame) -> DataFrame:
    """Spanning links (a, b) between distinct marks of at most four differing bits.

    A node with m members is cut into g chunks, g about sqrt(m) / 16, and every pair of chunks is
    searched by itself, so no task holds more than about 32 sqrt(m) members of one node.
    """
    nodes = distinct_marks.select(
        "mark", F.explode(F.array(*[_block(F.col("mark"), k) for k in range(len(BLOCKS))])).alias("block")
    )
    nodes = store(nodes, "simhash-nodes")
    chunks = F.ceil(F.sqrt(F.count("*").cast("double")) / CHUNK_ROOT).cast("long")
    large = nodes.groupBy("block").agg(chunks.alias("g")).where("g > 1")
    small = nodes.join(large, "block", "left_anti").select(F.xxhash64("block").alias("node"), "mark")
    own = F.pmod(F.xxhash64("mark"), F.col("g"))
    pairs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))
    split = (
        nodes.join(large, "block")
        .select("block", "mark", "g", own.alias("own"), pairs.alias("other"))
        .select(F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "mark")
    )
    dealt = small.unionByName(split).repartition("node").sortWithinPartitions("node")
    return map_batches(dealt, _Nodes, "a long, b long").distinct()


def _total(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges, to see when they stop changing."""
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def components(edges: DataFrame) -> DataFrame:
    """(mark, root) for every mark that occurs in ``edges``; root is the smallest of its component.

    Alternating large-star and small-star steps: a few rounds, each of which hooks neighbours to
    their smallest neighbour. The driver sees two numbers per round.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _total(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(store(least, "least"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(store(least, "least"), "a")
        hooked = small.select("a", F.col("m").alias("b")).unionByName(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        edges = store(hooked.distinct(), "small-star")
    return edges.select(F.col("a").alias("mark"), F.col("b").alias("root"))


def _known(marked: DataFrame) -> DataFrame:
    """mark, root (smallest mark of its component) and component_id (smallest doc_id there)."""
    by_mark = store(marked.groupBy("mark").agg(F.min("doc_id").alias("id")), "marks")
    roots = components(links(by_mark.select("mark")))
    named = store(
        by_mark.join(roots, "mark", "left").select("mark", "id", F.coalesce("root", "mark").alias("root")), "named"
    )
    smallest = store(named.groupBy("root").agg(F.min("id").alias("component_id")), "smallest")
    return store(named.join(smallest, "root").select("mark", "root", "component_id"), "known")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row per row of ``docs``."""
    marked = store(fingerprints(docs), "fingerprints")
    return marked.join(_known(marked), "mark").select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, the smallest by doc_id and then by a digest of all columns.

    Rows are linked by their texts alone: rows that share a doc_id but not a text stay as long as nothing
    links them, and of rows that are the same in every column one stays. Rows without doc_id stay.
    """
    names = [c if c in ("doc_id", "text") else f"_{k}" for k, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    digest = F.sha2(F.to_json(F.struct(*names)), 256)
    rows = plain.where("doc_id IS NOT NULL").withColumn("_digest", digest)
    marked = map_batches(rows.select("doc_id", "_digest", "text"), _marked_rows, "doc_id long, _digest string, mark long")
    marked = store(marked, "fingerprints")
    least = marked.join(_known(marked), "mark").groupBy("root").agg(F.min(F.struct("doc_id", "_digest")).alias("row"))
    kept = store(least.select("row.*"), "representatives")
    # Equal rows are made one before they are shuffled, so that many of them are no hot key.
    chosen = rows.dropDuplicates(["doc_id", "_digest"]).join(kept, ["doc_id", "_digest"], "left_semi")
    return chosen.select(names).unionByName(plain.where("doc_id IS NULL")).toDF(*docs.columns)
