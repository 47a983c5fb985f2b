"""Exact Jaccard join of documents over word shingles, in the metric space of Jaccard distance.

1. Every whole text becomes its set of distinct k-word shingles (64-bit hashes). Documents with equal sets are one class.
2. Rings: the common part is no larger than the smaller set and the union no smaller than the larger one, so linked sets
   differ in size by the threshold at most. A set belongs to its ring of sizes and, near the border, to the next ring too.
3. Regions: in a ring the hash space is cut into slices. Two linked sets differ in at most D elements, so among the
   first D + 1 slices that a set fills, one is the same in both: the slice's content acts as pivot, all sets at
   distance zero from it there form its region. (Whole documents as global pivots can't do this: unrelated documents
   are all at distance ~1 from every pivot, and the windows would copy each document to each region.)
4. Such a region holds unrelated sets that share a passage. It is split into Voronoi cells by parity sketches, whose
   Hamming distance is a metric and at most the number of differing elements: a set farther than D from all leaders
   becomes one, and every set is tied to each leader within the sum of its own and the leader's members' bounds, so linked
   sets are tied to a common leader. What ties connect is one region from here on.
5. In a region: pivots are chosen, sets go to the cell of the nearest one, and sets whose distance to another pivot is at
   most 2 eps larger are copied to its cell; cells are joined in turn, until they are small or no longer shrink. Distances
   are exact integer comparisons. Sets within eps of a pivot are linked to it; sets in one component need no comparing.
6. Regions above a size are never gathered: pivots come to all members where they are, in broadcast batches of bounded
   size, until every set outside the region's largest component has been a pivot. Copies of one page, which link with the
   first pivots, are so joined in one round, however many they are.

No link is lost: 2 and 3 hold for every linked pair, 4 and 5 by the triangle inequality, 6 by exhaustion.

Signatures are never stored: they go from the text into one shuffle, and signatures with the same few nodes become one
before sketches are attached. Intermediate tables and shuffle files are deleted as soon as their reader has written its
result. Of the texts, only those of candidates move (a bitmap of their ids, of bounded size, sorts out the others).

A text without words (or a null one) has an empty set, which links with nothing, not even other empty ones. Copies and
repeated rows are linked. A null id can't name a component: it has the smallest non-null id of its documents, or null.
Of rows with one id but different texts each is a document of its own. An empty table gives an empty result. Only the id
and the text are read; other names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, hashing, runtime
from .hashing import U64, mix

#: Rings of sizes grow by this factor.
RING = 1.4
#: Bits of a parity sketch for each element in which linked sets may differ, and at least.
SKETCH_BITS, LEAST_BITS = 8, 128
#: Shingles and sets of a region that one task may hold; larger regions stay spread out.
REGION, REGION_SETS = 1_000_000, 200
#: Shingles, and sets, of the pivots that large regions try in one round, all together; so much is broadcast.
PIVOTS, PIVOT_SETS = 1_500_000, 16_384
#: Pivots of each region in the first round: most copies of one page link with any of its copies.
FIRST = 4
#: Signatures of up to so many nodes are told by their nodes.
FEW = 64
#: Cells of so many sets are compared directly.
LEAF = 48
#: Tables of up to so many keys are sent to all executors (about 10 MB); larger ones are shuffled.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link when ``den`` * common >= ``num`` * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def most_changes(self, n: int) -> int:
        """Elements in which a set of n elements can differ from a linked set that is no smaller."""
        return n * (self.den - self.num) // self.num

    def rings(self, n: int) -> list[int]:
        """The rings of a set of n elements: that of each size from n up to n / threshold."""
        ring_of = lambda size: int(math.log(size) / math.log(RING))
        return list(range(ring_of(n), ring_of(max(n, n * self.den // self.num)) + 1))

    def slices(self, ring: int) -> int:
        """Slices of the hash space in a ring: more than the changes of its largest sets, with room for empty ones."""
        return 11 * self.most_changes(math.ceil(RING ** (ring + 1))) // 10 + 6


def signatures(s: np.ndarray, rule: Rule) -> np.ndarray:
    """Signatures of a sorted set: linked sets that differ have one in common."""
    n = len(s)
    wanted = rule.most_changes(n) + 1
    if wanted == 1:
        return np.zeros(0, U64)  # links to equal sets only
    weight = mix(s * U64(0x9FB21C651E98DF25))
    out = []
    for ring in rule.rings(n):
        cell = ((s >> U64(32)) * U64(rule.slices(ring))) >> U64(32)
        starts = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1))
        salt = U64((ring + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        used = starts[: wanted + 1]
        end = used[wanted] if len(used) > wanted else n
        used = used[:wanted]
        out.append(mix(np.add.reduceat(weight[:end], used) ^ mix(cell[used] + salt)))
        if len(starts) < wanted:  # too few filled slices: the first elements stand for themselves
            out.append(mix(s[:wanted] ^ mix(np.array([salt ^ U64(0x5555)], U64))))
    return np.concatenate(out)


def _set_key(s: np.ndarray) -> bytes:
    a = mix(s ^ U64(0x1234567887654321)).sum(dtype=U64)
    b = mix(s * U64(0xC2B2AE3D27D4EB4F) + U64(77)).sum(dtype=U64)
    return int(a).to_bytes(8, "big") + (int(b) ^ len(s)).to_bytes(8, "big")


def _sets(column: pa.Array, rule: Rule) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, _, data, bounds in hashing.blocks(column):
        yield first, hashing.shingle_hashes(*hashing.word_hashes(data, bounds), rule.words)


def sketch(s: np.ndarray, rule: Rule) -> bytes:
    """For each bit the parity of the elements that hash to it; the number of bits is a power of two that grows with the set."""
    bits = 1 << max(LEAST_BITS, SKETCH_BITS * rule.most_changes(len(s)) - 1).bit_length()
    at = mix(s + U64(0x2545F4914F6CDD1D)) & U64(bits - 1)  # so halves can be folded onto each other
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _describe(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (no_id, id, text_hash, text) to (no_id, id, text_hash, n, set_key, node, sketch); of copies within a task, the first has a sketch."""
    seen: set[bytes] = set()
    for batch in batches:
        for first, sets in _sets(batch.column(3), rule):
            keys = [_set_key(s) if len(s) else b"" for s in sets]
            sketches = []
            for s, key in zip(sets, keys, strict=True):
                fresh = rule.most_changes(len(s)) > 0 and key not in seen  # smaller sets link to equal ones only
                if fresh:
                    seen.add(key)
                sketches.append(sketch(s, rule) if fresh else None)
            if len(seen) > 500_000:
                seen.clear()
            part = batch.slice(first, len(sets))
            nodes = [int.from_bytes(k[:8], "big", signed=True) if k else 0 for k in keys]
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *own], names=["no_id", "id", "text_hash", "n", "set_key", "node", "sketch"])


def _sign(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to (signature, node); of copies within a task, the first is signed."""
    seen: set[int] = set()
    for batch in batches:
        for _, sets in _sets(batch.column(0), rule):
            found, nodes = [], []
            for s in sets:
                node = int.from_bytes(_set_key(s)[:8], "big", signed=True) if len(s) else 0
                if len(s) and node not in seen:
                    seen.add(node)
                    found.append(signatures(s, rule))
                    nodes.append(node)
            if len(seen) > 500_000:
                seen.clear()
            if found:
                node = np.repeat(np.array(nodes, np.int64), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(node)], names=["signature", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (signature, node) in order, the distinct ones whose signature has two nodes or more, as (met, node).

    A signature of few nodes is renamed by a hash of these, so signatures with the same nodes can be told to be one.
    Of a signature that goes on in the next batch few rows are held; longer ones are given out as they come.
    """
    held = np.zeros((0, 2), np.int64)
    given = False  # the held row belongs to a long signature, and has been given out

    def told(rows: np.ndarray, last: bool) -> Iterator[np.ndarray]:
        nonlocal held, given
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        rows = rows[keep]
        starts = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1))
        sizes = np.diff(np.append(starts, len(rows)))
        names = rows[starts, 0].copy()
        by_nodes = np.add.reduceat(mix(rows[:, 1].view(U64) ^ U64(0x94D049BB133111EB)), starts) ^ mix(sizes.astype(U64))
        out = sizes > 1
        long = sizes > FEW
        long[0] |= given
        names[~long] = by_nodes.view(np.int64)[~long]
        if not last and not long[-1]:
            out[-1] = False  # held as a whole
        mask = np.repeat(out, sizes)
        if given:
            mask[0] = False
        held, given = (rows[:0], False) if last else (rows[-1:], True) if long[-1] else (rows[starts[-1] :], False)
        if mask.any():
            yield np.stack([np.repeat(names, sizes)[mask], rows[mask, 1]], axis=1)

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["met", "node"])

    for batch in batches:
        rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns], axis=1)))
        if len(rows):
            yield from map(batch_of, told(rows, False))
    if len(held):
        yield from map(batch_of, told(held, True))


def fold(bits: np.ndarray, to: int) -> np.ndarray:
    """Sketches of fewer bits (the last axis has words of 64): what fell on either half falls on the same bit then."""
    while bits.shape[-1] > to:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class _Leaders:
    """Sketches of a signature's leaders, one growing matrix for each number of bits."""

    def __init__(self):
        self.nodes: dict[int, list[int]] = {}
        self.rows: dict[int, np.ndarray] = {}

    def add(self, node: int, bits: np.ndarray) -> None:
        nodes, rows = self.nodes.setdefault(len(bits), []), self.rows.get(len(bits))
        if rows is None or len(nodes) == len(rows):
            more = np.zeros((max(4, len(nodes)), len(bits)), U64)
            self.rows[len(bits)] = rows = more if rows is None else np.concatenate((rows, more))
        rows[len(nodes)] = bits
        nodes.append(node)

    def distances(self, bits: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
        """Leaders, and how far they are at least."""
        for size, nodes in self.nodes.items():
            least = min(size, len(bits))
            yield nodes, np.bitwise_count(fold(self.rows[size][: len(nodes)], least) ^ fold(bits, least)).sum(axis=1, dtype=np.int64)


def _ties(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (met, node, n, sketch) in order to ties (a, b) of nodes with leaders of their signature.

    A task gives out a forest: ties between nodes that it has connected already are left out (as far as it remembers).
    Leaders of a signature are found in the order of nodes, so most ties of a group of near copies are to the same few nodes.
    """
    current, leaders, forest = None, _Leaders(), graph.Forest()
    out: list[tuple[int, int]] = []

    def batch_of() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        out.clear()
        return found

    for batch in batches:
        for met, node, n, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if met != current:
                current, leaders = met, _Leaders()
            value = np.frombuffer(bits, U64)
            own = rule.most_changes(n)
            near = own + rule.most_changes(n * rule.den // rule.num)  # a linked set is within own, its leader within its own bound
            lead = True
            for nodes, apart in leaders.distances(value):
                for j in np.flatnonzero(apart <= near).tolist():
                    if forest.connect(node, nodes[j]):
                        out.append((node, nodes[j]))
                lead = lead and not (apart <= own).any()
            if lead:
                leaders.add(node, value)
        if len(out) > 20_000:
            yield batch_of()
        if len(forest.parent) > 1_000_000:
            forest.parent.clear()
    if out:
        yield batch_of()


class Region:
    """Links among the sets of one region, as components."""

    def __init__(self, sets: list[np.ndarray], rule: Rule):
        self.rule = rule
        self.eps = 1 - rule.num / rule.den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        self.universe, self.flat = np.unique(flat, return_inverse=True)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        self.mark = np.zeros(len(self.universe), np.uint8)
        self.parent = list(range(len(sets)))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def rows(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members' elements one after the other, and where each member's begin."""
        sizes = self.sizes[members]
        starts = np.cumsum(sizes) - sizes
        take = np.arange(int(sizes.sum())) + np.repeat(self.bounds[members] - starts, sizes)
        return self.flat[take], starts

    def common(self, x: int, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        own = self.flat[self.bounds[x] : self.bounds[x + 1]]
        self.mark[own] = 1
        out = np.add.reduceat(self.mark[flat], starts, dtype=np.int64)
        self.mark[own] = 0
        return out

    def linked(self, x: int, members: np.ndarray, common: np.ndarray) -> np.ndarray:
        return self.rule.den * common >= self.rule.num * (self.sizes[x] + self.sizes[members] - common)

    def sweep(self, members: np.ndarray) -> None:
        """Each set against all later ones that are not yet in its component."""
        flat, starts = self.rows(members)
        roots = np.array([self.root(int(m)) for m in members])
        for k, x in enumerate(members[:-1].tolist()):
            rest = roots[k + 1 :] != roots[k]
            if not rest.any():
                continue
            begin = starts[k + 1]
            hit = rest & self.linked(x, members[k + 1 :], self.common(x, flat[begin:], starts[k + 1 :] - begin))
            if hit.any():
                for y in members[k + 1 :][hit].tolist():
                    self.link(x, y)
                roots = np.array([self.root(int(m)) for m in members])

    def join(self, members: np.ndarray) -> None:
        if len(members) <= LEAF:
            return self.sweep(members) if len(members) > 1 else None
        flat, starts = self.rows(members)
        pivots, distance = [0], []
        while True:  # farthest first
            x = int(members[pivots[-1]])
            common = self.common(x, flat, starts)
            for y in members[self.linked(x, members, common)].tolist():
                self.link(x, y)
            distance.append(1 - common / (self.sizes[x] + self.sizes[members] - common))
            nearest = np.min(distance, axis=0)
            if len(pivots) == 12 or nearest.max() <= self.eps:
                break
            pivots.append(int(nearest.argmax()))
        cell = np.argmin(distance, axis=0)
        cells = [np.flatnonzero(d <= nearest + 2 * self.eps + 1e-9) for d in distance]
        cells = [c for j, c in enumerate(cells) if (cell == j).any()]
        if max(map(len, cells)) > 0.7 * len(members):
            return self.sweep(members)  # the windows hold nearly everything: cells would not shrink
        for c in cells:
            self.join(members[c])

    def labels(self) -> list[int]:
        self.join(np.arange(len(self.sizes)))
        return [self.root(x) for x in range(len(self.sizes))]


_KEY = "no_id boolean, id long, text_hash long"
_KEYS = ["no_id", "id", "text_hash"]


def _load(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, set_key, region, n, no_id, id, text_hash) to the same with the set itself in place of the text."""
    for batch in batches:
        for first, sets in _sets(batch.column(0), rule):
            part = batch.slice(first, len(sets))
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), *part.columns[1:]], names=["elements", *part.schema.names[1:]])


def _join_regions(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (elements, set_key, region, n, no_id, id, text_hash) in order of region and set_key to (set_key, no_id, id, text_hash) of components."""
    done: list[tuple] = []
    rows: list[tuple] = []
    current = None

    def close() -> None:
        if len(rows) > 1:
            labels = Region([r[0] for r in rows], rule).labels()
            best: dict[int, tuple] = {}
            for label, r in zip(labels, rows, strict=True):
                best[label] = min(best.get(label, r[2]), r[2])
            done.extend((r[1], *best[label]) for label, r in zip(labels, rows, strict=True))
        else:
            done.extend((r[1], *r[2]) for r in rows)
        rows.clear()

    def batch_of() -> pa.RecordBatch:
        out = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.binary(), pa.bool_(), pa.int64(), pa.int64()), strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(out, names=["set_key", *_KEYS])

    for batch in batches:
        for elements, key, region, _, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if region != current:
                close()
                current = region
            if not rows or rows[-1][1] != key:  # repeated rows come one after the other
                rows.append((np.frombuffer(elements, U64), key, tuple(own)))
        if len(done) > 5000:
            yield batch_of()
    close()
    if done:
        yield batch_of()


def _by_element(pivots: list[tuple[bytes, bytes]]) -> tuple:
    """For pivots (set_key, elements): keys, all elements in order, whose they are, sizes."""
    sets = [np.frombuffer(elements, U64) for _, elements in pivots]
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    return [key for key, _ in pivots], flat[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes


def _try_pivots(rule: Rule, pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (elements, set_key, region) to links (a, b) with their region's pivots.

    A task gives out a forest: of copies that all link with each other, one link a set, not all pairs.
    """
    ready: dict[int, tuple] = {}
    forest = graph.Forest()
    for batch in batches:
        out = []
        for elements, key, region in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if region not in pivots.value:
                continue
            if region not in ready:
                ready[region] = _by_element(pivots.value[region])
            names, flat, owner, sizes = ready[region]
            s = np.frombuffer(elements, U64)
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            hits = hi - lo
            at = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
            common = np.bincount(owner[at], minlength=len(sizes))
            for j in np.flatnonzero(rule.den * common >= rule.num * (sizes + len(s) - common)).tolist():
                if forest.connect(key, names[j]):
                    out.append((key, names[j]))
        if len(forest.parent) > 500_000:
            forest.parent.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])


def _pivots(members: DataFrame, left: DataFrame, each: float) -> dict[int, list[tuple[bytes, bytes]]]:
    """About ``each`` of the sets in ``left`` for every region, as far as the bounds allow (one at least).

    A set's turn is a uniform number from its hash times the number of its region's sets: the n-th in a region has its turn
    at about n, so the first ones of all regions are found without ranking any region.
    """
    sizes = left.groupBy("region").agg(F.count(F.lit(1)).alias("sets"))
    uniform = F.shiftrightunsigned(F.xxhash64("set_key"), 11) / float(1 << 53)
    turns = left.join(_small(sizes), "region").select("region", "set_key", "n", (uniform * F.col("sets")).alias("turn"))
    first = turns.orderBy("turn", "set_key").limit(PIVOT_SETS).collect()
    chosen, total = [], 0
    for r in first:
        total += r.n
        if not chosen or (total <= PIVOTS and r.turn <= each):
            chosen.append((r.region, r.set_key))
    if not chosen:
        return {}
    wanted = F.broadcast(members.sparkSession.createDataFrame(chosen, "region long, set_key binary"))
    found: dict[int, dict[bytes, bytes]] = {}
    for r in members.join(wanted, ["region", "set_key"]).groupBy("region", "set_key").agg(F.first("elements").alias("elements")).collect():
        found.setdefault(r.region, {})[bytes(r.set_key)] = bytes(r.elements)
    return {region: sorted(sets.items()) for region, sets in found.items()}


def _large_regions(members: DataFrame, rule: Rule, about: int) -> DataFrame:
    """(set_key, no_id, id, text_hash) of components in regions that no task holds as a whole.

    Each round sends a bounded batch of pivots to all executors; members stay where they are.
    """
    spark = members.sparkSession
    keys = runtime.cut(members.select("region", "set_key", "n").distinct(), "keys", about)
    links = runtime.cut(keys.select(F.col("set_key").alias("a"), F.col("set_key").alias("b")), "tried", about)
    left, found, tried, each = keys, None, None, FIRST
    while pivots := _pivots(members, left, each):
        rows = members.select("elements", "set_key", "region")
        new = rows.mapInArrow(partial(_try_pivots, rule, spark.sparkContext.broadcast(pivots)), "a binary, b binary")
        before, links = links, runtime.cut(links.unionByName(new), "tried", about)
        known, found = found, graph.components(links, about)
        runtime.drop(before, *([known] if known is not None else []))
        own = spark.createDataFrame([(key,) for sets in pivots.values() for key, _ in sets], "set_key binary")
        before, tried = tried, runtime.cut(own if tried is None else tried.unionByName(own), "pivots", about)
        if before is not None:
            runtime.drop(before)
        at = keys.join(found.withColumnRenamed("node", "set_key"), "set_key")
        counts = at.groupBy("region", "root").agg(F.count(F.lit(1)).alias("count"))
        largest = counts.groupBy("region").agg(F.max_by("root", F.struct("count", "root")).alias("root"))
        left = at.join(_small(largest), ["region", "root"], "left_anti").join(_small(tried), "set_key", "left_anti").select("region", "set_key", "n")
        each = math.inf
    ids = members.select(F.col("set_key").alias("node"), *_KEYS).distinct().join(found, "node")
    best = ids.groupBy("root").agg(F.min(F.struct(*_KEYS)).alias("best"))
    out = runtime.cut(ids.select("node", "root").join(best, "root").select(F.col("node").alias("set_key"), "best.*"), "spread", about)
    runtime.drop(keys, links, tried, found)
    return out


def _small(df: DataFrame) -> DataFrame:
    """Sent to all executors if its checked size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What a document is told by: its id, or the text's hash where it has none, and the text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    return [own.isNull().alias("no_id"), F.coalesce(own, F.xxhash64(text)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")]


def _regions(rows: DataFrame, described: DataFrame, rule: Rule, about: int) -> DataFrame:
    """(node, root) of all nodes that share a signature with another one of a similar sketch."""
    signed = rows.select("text").mapInArrow(partial(_sign, rule), "signature long, node long")
    shared = signed.repartition("signature").sortWithinPartitions("signature", "node").mapInArrow(_shared, "met long, node long")
    shared = runtime.cut(shared, "shared")
    sketches = described.where("sketch is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    meeting = shared.distinct().join(sketches, "node").select("met", "node", "n", "sketch").repartition("met").sortWithinPartitions("met", "node")
    regions = graph.components(meeting.mapInArrow(partial(_ties, rule), "a long, b long"), about)
    runtime.drop(shared)
    return regions


def classes(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``no_id, id, text_hash, n`` and ``first``: the smallest (no_id, id, text_hash) among all it is linked with, itself included."""
    runtime.ship(docs.sparkSession)
    rows = docs.select(*_keyed(docs, id_col, text_col))
    described = runtime.cut(rows.mapInArrow(partial(_describe, rule), f"{_KEY}, n long, set_key binary, node long, sketch binary"), "sets")
    about = described.count()
    regions = _regions(rows, described, rule, about)
    whole = described.where("n > 0").groupBy("set_key").agg(F.min(F.struct(*_KEYS)).alias("own"), F.first("n").alias("n"), F.first("node").alias("node"))
    whole = runtime.cut(whole, "classes", about)
    there = runtime.cut(whole.join(regions, "node").select("set_key", F.col("root").alias("region"), "n", "own.*"), "candidates", about)
    runtime.drop(regions)

    texts = runtime.hits(there.select("id"), rows, F.col("id")).where("hit").select("row.*")
    texts = texts.join(_small(there), _KEYS).select("text", "set_key", "region", "n", *_KEYS)
    sets = runtime.cut(texts.mapInArrow(partial(_load, rule), f"elements binary, set_key binary, region long, n long, {_KEY}"), "elements")
    sizes = there.groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets"))
    large = runtime.cut(sizes.where((F.col("total") > REGION) | (F.col("sets") > REGION_SETS)).select("region"), "large", about)
    if large.isEmpty():
        members, small = None, sets
    else:
        small = sets.join(_small(large), "region", "left_anti").select(*sets.columns)
        members = sets.join(_small(large), "region", "left_semi").select(*sets.columns)
    found = small.repartition("region").sortWithinPartitions("region", "set_key").mapInArrow(partial(_join_regions, rule), f"set_key binary, {_KEY}")
    spread = _large_regions(members, rule, about) if members is not None else None
    if spread is not None:
        found = found.unionByName(spread)
    found = found.select("set_key", F.struct(*_KEYS).alias("found"))
    best = runtime.cut(whole.join(found, "set_key", "left").select("set_key", F.coalesce("found", "own").alias("best")), "best", about)
    runtime.drop(whole, there, sets, large, *([spread] if spread is not None else []))
    out = described.select(*_KEYS, "n", "set_key").join(best, "set_key", "left")
    return out.select(*_KEYS, "n", F.coalesce("best", F.struct(*_KEYS)).alias("first"))


def join_documents(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; component_id is the smallest doc_id reachable by links."""
    out = classes(docs, rule, id_col, text_col)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(~F.col("first.no_id"), F.col("first.id")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are linked, directly or not, with one of a smaller id; all columns stay.

    Of linked rows with equal id the one of the smallest text hash stays, of rows with equal id and text one. Documents
    without words stay. Only rows whose id is that of a row to go, or is repeated, move.
    """
    found = runtime.cut(classes(docs, rule, id_col, text_col), "found")
    about = found.count()
    gone = runtime.cut(found.where(F.struct(*_KEYS) != F.col("first")).select(*_KEYS).distinct(), "gone", about)
    again = runtime.cut(found.groupBy(*_KEYS).count().where("count > 1").select(*_KEYS), "again", about)
    runtime.drop(found)
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keyed(docs, id_col, text_col)[:3])
    flagged = runtime.hits(gone.select("id").unionByName(again.select("id")), told, F.col("id"))
    sure, maybe = flagged.where("not hit").select("row.*"), flagged.where("hit").select("row.*")
    maybe = maybe.join(_small(gone), _KEYS, "left_anti")
    if not again.isEmpty():
        maybe = maybe.dropDuplicates(_KEYS)
    return sure.select(*columns).union(maybe.select(*columns))
