"""Embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors with cosine c are at squared distance 2 - 2c. After a fixed random rotation the
vectors are split into blocks of a few dimensions; a linked pair is within its proportional share of
the squared-distance budget in one block at least. Each block is range-joined by itself: vectors fall
into cells of twice the radius on the block's first two coordinates and are sent on as guests to the
neighbouring cells within the radius. A task compares a cell's vectors in bounded tiles, in the block
first, and verifies what passes by the exact cosine in double precision. A pair counts in the first
block that is within its share, so no pair counts twice and none leaves a task: what leaves is, per
vector, its number of partners and one link of a spanning forest. Equal vectors are one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import attach, components, settle

COSINE = 0.93
BLOCK = 8             # dimensions of a block
TILE = 1024           # vectors compared at once
CELL_ROWS = 4096      # a cell with more vectors is compared in parts of this many
EDGE = 1e-9           # blocks are cut a hair wider than the share, against rounding


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_list(dim: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, dim)) for i in range(0, dim, BLOCK)]


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)            # against overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clean(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(rid, vec_id, label, body): the vector's doubles as bytes, NULL where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, body = batch.column(2).to_pylist(), []
            for lab, v in zip(labels, batch.column(3).to_pylist()):
                x = np.array(v, float) + 0.0 if v and lab is not None and None not in v else None
                body.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            key = [hashlib.sha256(b).digest() if b else None for b in body]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(body, pa.binary()), pa.array(key, pa.binary())],
                                             names=["rid", "vec_id", "label", "body", "key"])

    cols = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                       F.col(embedding).cast("array<double>").alias("v"))
    return cols.mapInArrow(run, "rid long, vec_id long, label string, body binary, key binary")


def _cells(classes: DataFrame, cosine: float) -> DataFrame:
    """Every vector in its cell of every block, and as a guest in the cells before it within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, list[int]] = {}
            bodies = batch.column(batch.schema.get_field_index("body")).to_pylist()
            for i, b in enumerate(bodies):
                by_dim.setdefault(len(b) // 8, []).append(i)
            for dim, rows in by_dim.items():
                x = unit(np.stack([np.frombuffer(bodies[i], np.float64) for i in rows])) @ rotation(dim)
                for k, block in enumerate(block_list(dim)):
                    radius = np.sqrt((2 - 2 * cosine) * (block.stop - block.start) / dim) + EDGE
                    y = x[:, block][:, :2] / (2 * radius)
                    y = np.hstack([y, np.zeros((len(y), 2 - y.shape[1]))])
                    home = np.floor(y).astype(np.int64)
                    part = y - home
                    at, cells, guest = [np.arange(len(rows))], [home], [np.zeros(len(rows), bool)]
                    for d0, d1 in ((0, 1), (1, -1), (1, 0), (1, 1)):                  # half of the neighbours: a pair meets once
                        gap = sum(np.where(d == 0, 0.0, np.where(d > 0, 1 - p, p)) ** 2 for d, p in ((d0, part[:, 0]), (d1, part[:, 1])))
                        near = np.flatnonzero(gap <= 0.25 + 1e-9)
                        at.append(near)
                        cells.append(home[near] + (d0, d1))
                        guest.append(np.ones(len(near), bool))
                    at, cells, guest = np.concatenate(at), np.concatenate(cells), np.concatenate(guest)
                    picked = batch.take(pa.array([rows[i] for i in at]))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([
                        picked.column(0), picked.column(1), picked.column(2), picked.column(3), pa.array([dim] * n, pa.int32()), pa.array([k] * n, pa.int32()),
                        pa.array(cells[:, 0], pa.int64()), pa.array(cells[:, 1], pa.int64()), pa.array(guest, pa.bool_())],
                        names=["node", "label", "n", "body", "dim", "block", "c0", "c1", "guest"])

    return classes.select("node", "label", "n", "body").mapInArrow(
        run, "node long, label string, n long, body binary, dim int, block int, c0 long, c1 long, guest boolean")


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest member that each of ``size`` members reaches by the links a - b."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(cosine: float):
    """For applyInPandas: a cell (or a part of a large one against another) to (node, partners, link)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["guest", "node"], ignore_index=True)
        dim, k = int(pdf.dim[0]), int(pdf.block[0])
        raw = np.stack([np.frombuffer(b, np.float64) for b in pdf.body])
        exact, node, n = unit(raw), pdf.node.to_numpy(), pdf.n.to_numpy()
        x, blocks, budget = exact @ rotation(dim), block_list(dim), 2 - 2 * cosine
        left = pdf.left.to_numpy()                     # rows that are compared with the others, and among themselves where both
        right = pdf.right.to_numpy()
        share = [budget * (b.stop - b.start) / dim + EDGE for b in blocks]
        partners, ends = np.zeros(len(pdf), np.int64), []
        own, other = np.flatnonzero(left), np.flatnonzero(right)
        half = (x[:, blocks[k]] ** 2).sum(1)
        for i in range(0, len(own), TILE):
            p = own[i:i + TILE]
            for j in range(0, len(other), TILE):
                q = other[j:j + TILE]
                near = half[p][:, None] + half[q] - 2 * (x[p][:, blocks[k]] @ x[q][:, blocks[k]].T) <= share[k] + EDGE
                ordered = pdf.guest.to_numpy()[q][None, :] | (node[p][:, None] < node[q][None, :])
                near &= ordered & (node[p][:, None] != node[q][None, :])
                if not near.any():
                    continue
                rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                pr, q2 = p[rows], q[cols]
                hit = near[np.ix_(rows, cols)] & (exact[pr] @ exact[q2].T >= cosine)
                a, b = np.nonzero(hit)
                a, b = pr[a], q2[b]
                first = np.ones(len(a), bool)
                for s in range(0, len(a), 1 << 16):
                    e = slice(s, s + (1 << 16))
                    gap = x[a[e]] - x[b[e]]
                    for m in range(k):
                        first[e] &= (gap[:, blocks[m]] ** 2).sum(1) > share[m] + EDGE
                a, b = a[first], b[first]
                np.add.at(partners, a, n[b])
                np.add.at(partners, b, n[a])
                root = _forest(a, b, len(pdf)) if len(a) else np.arange(0)
                kids = np.flatnonzero(root != np.arange(len(root)))
                ends.append(np.stack([node[kids], node[root[kids]]]) if len(kids) else np.zeros((2, 0), np.int64))
        some = np.flatnonzero(partners)
        links = np.concatenate(ends, 1) if ends else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"node": np.concatenate([node[some], links[0]]), "partners": np.concatenate([partners[some], np.zeros(links.shape[1], np.int64)]),
                             "link": pd.array([None] * len(some) + links[1].tolist(), "Int64")})

    return run


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link when their labels are equal and not NULL, their vectors have one length and their cosine is
    ``cosine`` or more. Vectors that are NULL, empty or zero, or hold NULL or non-finite components, link with
    nothing. Repeated vectors link with each other. kept is vec_id = component_id: rows that repeat a kept
    vec_id are kept too; a NULL vec_id is never kept and names a component only if all its ids are NULL. No
    rows give no rows; other columns are ignored."""
    read = settle(clean(rows, vec_id, embedding, label), "vectors")
    total = read.count()
    classes = read.where("key IS NOT NULL").groupBy("label", "key").agg(F.first("body").alias("body"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    cells = settle(_cells(classes, cosine), "cells")
    place = ["label", "dim", "block", "c0", "c1"]
    # a large cell is dealt into parts; each pair of parts is a group of its own
    sizes = cells.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int").alias("parts"))
    dealt = cells.join(sizes, place).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # left: residents of part i; right: everything of part j
    as_left = dealt.where("NOT guest").select("*", F.explode(every).alias("j")).select("*", F.col("part").alias("i")).withColumn("left", F.lit(True)).withColumn("right", F.col("i") == F.col("j"))
    as_right = dealt.select("*", F.explode(every).alias("i")).select("*", F.col("part").alias("j")).where("guest OR i <> j").withColumn("left", F.lit(False)).withColumn("right", F.lit(True))
    found = as_left.unionByName(as_right).groupBy(*place, "i", "j").applyInPandas(_compare(cosine), "node long, partners long, link long")
    found = settle(found, "links")
    roots = components(found.where("link IS NOT NULL").select(F.col("node").alias("a"), F.col("link").alias("b")))
    partners = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    named = classes.drop("body").join(partners, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = settle(named, "named-vectors")
    ends = settle(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "vector-roots")
    named = attach(named, ends, "root", max(named.count(), 1), "m")
    named = settle(named.select("label", "key", "n", F.coalesce("partners", F.lit(0)).alias("partners"), "component_id"), "vector-names")
    name = F.struct("label", "key")
    out = attach(read.where("key IS NOT NULL").select("vec_id", name.alias("c")), named.select(name.alias("c"), "n", "partners", "component_id"), "c", max(total, 1), "n")
    out = out.select("vec_id", (F.col("partners") + F.col("n") - 1).alias("n_links"), "component_id")
    rest = read.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
