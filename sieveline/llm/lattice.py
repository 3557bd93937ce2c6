"""Embedding near-duplicates by lattice hashing.

In each of TABLES tables a vector's direction is projected at random to two blocks of 8 numbers, each
decoded to its nearest point of the lattice E8; the two points name the vector's cell. A vector is also
filed in the PROBES neighbouring cells that its projection lies nearest to. Two vectors are
candidates where one's own cell is among the other's cells; cosines in double precision decide.

Equal vectors are one node with a multiplicity, so copies cost nothing. A pair counts only in the first
table and least cell in which it meets, so the links of a node are a sum over cells and no pair
leaves its task: tasks emit counts, and the links of a spanning forest for the components. A cell of
more than CELL_MOST nodes is dealt to tasks by pairs of its parts.

For 64 dimensions a pair at cosine 0.9 meets with a chance of 0.53 in a table and 0.99 in six.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing
and represent themselves; vectors of different lengths do not link; equal rows are vectors of their own; a
null vec_id represents others only if all are null; an empty table gives an empty result."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import connected_components, ensure_workers, materialize, partitions_for, stream_groups
from sieveline.llm._text import mix, rows_of

TABLES, PROBES, BLOCKS = 6, 4, 2
SCALE = 3.0  # for 64 dimensions; a projection to 8 of d shrinks distances by sqrt(8 / d)
CELL_MOST = 1_024


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: by rule, two entries of +-1, or all +-1/2 with evenly many minuses."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


SHORTEST = _shortest()


def _even_sum(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum (the lattice D8)."""
    near = np.rint(x)
    gap = x - near
    worst = np.abs(gap).argmax(1)
    row = np.arange(len(x))
    other = near.copy()
    other[row, worst] += np.where(gap[row, worst] >= 0, 1, -1)
    return np.where((near.sum(1) % 2 != 0)[:, None], other, near)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the nearer of D8 and D8 moved by halves."""
    a, b = _even_sum(x), _even_sum(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 11) -> np.ndarray:
    """(rows, tables, 1 + probes) of 64-bit cell names, a row's own cell first."""
    n, d = unit.shape
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    row = np.arange(n)[:, None]
    for t in range(tables):
        rng = np.random.RandomState(seed * 1000 + t)
        turn = rng.standard_normal((d, 8 * BLOCKS))
        turn = np.linalg.qr(turn)[0] if d >= 8 * BLOCKS else turn / np.sqrt(d)
        z = unit @ turn * (scale * np.sqrt(d / 64)) + rng.uniform(0, 1, 8 * BLOCKS)
        points, costs = [], []
        for k in range(BLOCKS):
            part = z[:, 8 * k : 8 * k + 8]
            base = decode(part)
            gain = (part - base) @ SHORTEST.T
            top = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            points.append(np.concatenate([base[:, None], base[:, None] + SHORTEST[top]], 1))
            costs.append(np.concatenate([np.zeros((n, 1)), 2 - 2 * np.take_along_axis(gain, top, 1)], 1))
        total = (costs[0][:, :, None] + costs[1][:, None, :]).reshape(n, -1)
        order = np.argsort(total, axis=1, kind="stable")[:, : 1 + probes]
        both = np.concatenate([points[0][row, order // (1 + probes)], points[1][row, order % (1 + probes)]], 2)
        halves = np.rint(both * 2).astype(np.int64).astype(np.uint64)
        h = np.full(halves.shape[:2], np.uint64(d * 131 + t + 1), np.uint64)
        for k in range(halves.shape[2]):
            h = mix(h * np.uint64(3) + halves[:, :, k])
        out[:, t] = h
    return out


def _usable(x: list | None) -> np.ndarray | None:
    if not x or None in x:
        return None
    v = np.array(x, np.float64)
    return v + 0.0 if np.isfinite(v).all() and v.any() else None


def rows_with_nodes(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, vec) of each row; node names the vector, null where it is not usable."""
    ensure_workers(vectors.sparkSession)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in rows_of(batches, 4000):
            got = [_usable(x) for x in b.column(1).to_pylist()]
            raw = [None if v is None else v.tobytes() for v in got]
            node = [None if r is None else int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "node", "vec"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(name, "vec_id long, node long, vec binary")


def _join_find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = int(parent[i])
    return i


def links_of(x: np.ndarray, own: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray, cell: np.uint64, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each row, forest links) among candidate pairs of `left` and `right` rows that count in this cell."""
    sims = x[left] @ x[right].T
    a, b = np.nonzero(sims >= least)
    i, j = left[a], right[b]
    ok = i < j if left is right else i != j
    i, j = i[ok], j[ok]
    t = int(np.flatnonzero((own[0] == cell).any(1))[0])
    meets = lambda k: ((own[i, k, :1] == own[j, k]).any(1), (own[j, k, :1] == own[i, k]).any(1))
    first, second = meets(t)
    at = np.where(first & second, np.minimum(own[i, t, 0], own[j, t, 0]), np.where(first, own[i, t, 0], own[j, t, 0]))
    ok = (first | second) & (at == cell)
    for k in range(t):
        p, q = meets(k)
        ok &= ~(p | q)
    i, j = i[ok], j[ok]
    links = np.bincount(i, times[j], len(x)) + np.bincount(j, times[i], len(x))
    parent, forest = np.arange(len(x)), []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        u, v = _join_find(parent, p), _join_find(parent, q)
        if u != v:
            parent[u] = v
            forest.append((p, q))
    return links, forest


def near_vectors(vectors: DataFrame, least: float = 0.9, tables: int = TABLES, probes: int = PROBES, most: int = CELL_MOST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links are the other rows found with a cosine of at least `least`."""
    spark = vectors.sparkSession
    rows = materialize(rows_with_nodes(vectors), "vectors")
    named = rows.where("node is not null")
    nodes = named.groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.min("vec").alias("vec"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 4000):
            raw = b.column(3).to_pylist()
            out: list = [None] * len(raw)
            for d in {len(r) for r in raw}:
                at = [i for i, r in enumerate(raw) if len(r) == d]
                v = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
                v = v / np.abs(v).max(1)[:, None]
                got = cells(v / np.linalg.norm(v, axis=1)[:, None], tables, probes)
                for i, c in zip(at, got, strict=True):
                    out[i] = c.reshape(-1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], names=["node", "least", "times", "vec", "cells"])

    nodes = materialize(nodes.mapInArrow(file, "node long, least long, times long, vec binary, cells array<long>"), "nodes")
    filed = nodes.select("node", F.posexplode("cells").alias("at", "cell")).select("node", "cell", (F.col("at") % (1 + probes) == 0).alias("own"))
    busy = filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n >= 2 and any_own").select("cell", "n")
    members = filed.join(busy.hint("shuffle_hash"), "cell").withColumn("parts", F.ceil(F.col("n") / F.lit(most // 2)))
    members = members.withColumn("parts", F.when(F.col("n") <= most, 1).otherwise(F.col("parts"))).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "node", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    dealt = materialize(dealt, "cells")

    def compare(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, p, q = key
        node, part, times = (t.column(c).to_numpy() for c in ("node", "part", "times"))
        if len(node) < 2:
            return
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(len(node), -1)
        x = x / np.abs(x).max(1)[:, None]
        x = x / np.linalg.norm(x, axis=1)[:, None]
        own = np.array(t.column("cells").to_pylist(), np.int64).astype(np.uint64).reshape(len(node), tables, 1 + probes)
        every = np.arange(len(node))
        left, right = (every, every) if p == q else (np.flatnonzero(part == p), np.flatnonzero(part == q))
        left, right = (left, left) if p == q else (left, right)
        links, forest = links_of(x, own, times, left, right, np.int64(cell).astype(np.uint64), least)
        some = np.flatnonzero(links)
        if len(some):
            a, b = (np.array(forest, int).reshape(-1, 2)).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((node[some], node[a]))), pa.array(np.concatenate((links[some].astype(np.int64), np.zeros(len(a), np.int64)))), pa.array([None] * len(some) + node[b].tolist(), pa.int64())],
                names=["node", "links", "other"],
            )

    full = dealt.join(nodes.select("node", "times", "vec", "cells"), "node")
    found = materialize(stream_groups(full, ["cell", "p", "q"], compare, "node long, links long, other long", partitions_for(spark, dealt.count(), 50_000)), "found")
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("node", "least", "times").join(sums, "node", "left").join(roots, "node", "left")
    info = info.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    rep = info.groupBy("root").agg(F.min("least").alias("component_id"))
    info = info.join(rep, "root").select("node", "links", "component_id")
    out = rows.select("vec_id", "node").join(info, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
