"""Exact duplicates: binary-fuse filters per immutable snapshot screen incoming digests.

A snapshot's texts are indexed once: exact buckets (digest, rows, the row that stays) and, per bucket
and snapshot, a static three-wise binary-fuse filter of 16-bit fingerprints. A new batch is first
grouped by itself. Its distinct digests then meet the filters of their bucket; what the filters let
through joins the exact buckets. Where more than one row has a digest, the bytes of the normalised
texts are compared, so equal digests of different texts stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import attach, crc, settle, short_batches, text_batches

BUCKET_KEYS = 200_000       # digests per filter, as planned; a filter holds what its bucket holds
BROADCAST_ROWS = 200_000    # digests with several rows are broadcast up to this many (32 bytes each), else shuffled


# -- filters ------------------------------------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mult)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segments: int, length: int) -> np.ndarray:
    """Three slots in three neighbouring segments for every hash."""
    first = (h >> np.uint64(40)) % np.uint64(segments)
    spots = [(h >> np.uint64(s)) & np.uint64(length - 1) for s in (0, 13, 26)]
    return np.stack([(first + np.uint64(i)) * np.uint64(length) + s for i, s in enumerate(spots)], 1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(48)).astype(np.uint16)


def build_filter(keys: np.ndarray, tries: int = 100) -> tuple[int, int, int, np.ndarray]:
    """(seed, segments, segment length, slots) over distinct uint64 keys, by peeling in layers."""
    keys = np.unique(keys)
    n = len(keys)
    length = 1 << max(2, min(13, int(np.log2(max(n, 1)) / 1.75 + 2.25)))
    segments = max(1, -(-int(max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) * n + 32) // length))
    for seed in range(tries):
        h = _mix(keys, seed)
        at = _places(h, segments, length)
        size = (segments + 2) * length
        counts = np.bincount(at.ravel(), minlength=size)
        alive, layers = np.ones(n, bool), []
        while alive.any():
            single = counts[at] == 1
            single[~alive] = False
            who = np.flatnonzero(single.any(1))
            if not len(who):
                break
            layers.append((who, single[who].argmax(1)))
            alive[who] = False
            counts -= np.bincount(at[who].ravel(), minlength=size)
        if alive.any():
            segments += 1 + segments // 20
            continue
        slots, prints = np.zeros(size, np.uint16), _prints(h)
        for who, col in reversed(layers):
            own = at[who, col]
            slots[own] = 0
            slots[own] = prints[who] ^ slots[at[who]].T[0] ^ slots[at[who]].T[1] ^ slots[at[who]].T[2]
        return seed, segments, length, slots
    raise RuntimeError("no binary-fuse filter found")


def screen(keys: np.ndarray, seed: int, segments: int, length: int, slots: np.ndarray) -> np.ndarray:
    """True where a key may be in the filter's set; never False for a member."""
    h = _mix(keys, seed)
    at = _places(h, segments, length)
    return (slots[at[:, 0]] ^ slots[at[:, 1]] ^ slots[at[:, 2]]) == _prints(h)


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[-8:].rjust(8, b"\0") for d in digests), "<u8")


# -- plan ---------------------------------------------------------------------------------------

def digest_rows(docs: DataFrame, text: str, keep: list[str], body: bool = False, length: int = 32) -> DataFrame:
    """``keep`` columns and the digest of the normalised text (A-Z lower-cased, NULL empty), with its bytes if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "__text"):
            low = [t.lower() for t in texts]
            cols = [batch.column(i) for i in range(len(keep))]
            full = [hashlib.sha256(t).digest() for t in low]
            cols += [pa.array([d[:length] for d in full], pa.binary()), pa.array([d.hex() for d in full], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(low, pa.binary())] if body else []), names=[*keep, "digest", "sha256", *(["body"] if body else [])])

    cols = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema[:len(keep)]), "digest binary, sha256 string", *(["body binary"] if body else [])])
    return cols.mapInArrow(run, schema)


def filters(buckets: DataFrame) -> DataFrame:
    """One row per snapshot and bucket: the filter of its digests."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segments, length, slots = build_filter(_keys(pdf.digest))
        return pd.DataFrame([(pdf.snapshot[0], pdf.bucket[0], seed, segments, length, slots.tobytes())], columns=["snapshot", "bucket", "seed", "segments", "length", "slots"])

    return buckets.select("snapshot", "bucket", "digest").groupBy("snapshot", "bucket").applyInPandas(
        run, "snapshot int, bucket long, seed int, segments int, length int, slots binary")


def screened(batch: DataFrame, made: DataFrame) -> DataFrame:
    """The digests of a batch that the filter of some snapshot lets through, with that snapshot."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, keys = [], _keys(left.digest)
        for f in right.itertuples():
            hit = screen(keys, f.seed, f.segments, f.length, np.frombuffer(f.slots, np.uint16))
            out.append(pd.DataFrame({"digest": left.digest[hit], "snapshot": f.snapshot}))
        return pd.concat(out) if out else pd.DataFrame({"digest": [], "snapshot": []})

    return batch.groupBy("bucket").cogroup(made.groupBy("bucket")).applyInPandas(run, "digest binary, snapshot int")


def duplicates(docs: DataFrame, snapshot: Column, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32,
               bucket_keys: int = BUCKET_KEYS, rid: Column | None = None) -> DataFrame:
    """Of every row: rid (given, or a number), doc_id, keep_id, group_size, kept, text_sha256, in_snapshot.

    ``snapshot`` gives the number of the immutable snapshot a row is in; NULL means the new batch.
    NULL text counts as empty; empty texts equal each other. Of equal texts the row with the largest
    doc_id stays (a NULL doc_id is smallest); of repeated rows with that doc_id one stays, and kept says
    which. No rows give no rows; other columns are ignored. ``digest_bytes`` shortens the digest for
    tests: results do not depend on it."""
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), snapshot.cast("int").alias("snapshot"), F.col(text).cast("string").alias("text"))
    named = docs.select(*[c.alias(n) for n, c in (("doc_id", F.col(doc_id).cast("long")), ("snapshot", snapshot.cast("int")), ("text", F.col(text).cast("string")))],
                        (F.monotonically_increasing_id() if rid is None else rid).alias("rid"))
    with short_batches(docs.sparkSession):
        rows = settle(digest_rows(named, "text", ["rid", "doc_id", "snapshot"], length=digest_bytes), "digests")
    total = rows.count()
    wide = max(1, -(-total // bucket_keys))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(wide))
    # exact buckets of every snapshot, and the new batch grouped by itself
    grouped = settle(rows.groupBy("digest", "snapshot").agg(F.count("*").alias("n")).withColumn("bucket", bucket), "buckets")
    old, new = grouped.where("snapshot IS NOT NULL"), grouped.where("snapshot IS NULL")
    hits = screened(new.select("bucket", "digest"), filters(old))
    met = hits.join(old.select("digest", "snapshot"), ["digest", "snapshot"]).select("digest").distinct()
    within = grouped.where("n > 1").select("digest").distinct()
    across = old.groupBy("digest").count().where("count > 1").select("digest")
    several = settle(met.union(within).union(across).distinct(), "repeated")
    # bytes are compared wherever a digest has more than one row
    some = several.count()
    side = F.broadcast(several) if some <= BROADCAST_ROWS else several
    bodies = digest_rows(ids, "text", ["doc_id"], body=True, length=digest_bytes).join(side, "digest", "left_semi")
    with short_batches(docs.sparkSession):
        classes = settle(bodies.groupBy("digest", "body").agg(F.count("*").alias("size"), F.max("doc_id").alias("keep_id"), F.first("sha256").alias("sha256"))
                         .drop("body"), "classes")
    apart = classes.groupBy("digest").count().where("count > 1").select("digest")         # different texts, one digest
    one = classes.join(F.broadcast(apart) if digest_bytes < 32 else apart, "digest", "left_anti").drop("sha256")
    more = classes.join(apart, "digest").drop("digest")
    lone = rows.join(side, "digest", "left_anti").select("rid", "doc_id", "snapshot", "sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    multi = settle(rows.join(side, "digest", "left_semi"), "repeated-rows")
    count = multi.count()
    named = attach(multi, settle(one, "one-text"), "digest", count, "size")
    done = named.where("size IS NOT NULL").drop("digest")
    rest = attach(named.where("size IS NULL").drop("size", "keep_id", "digest"), settle(more, "more-texts"), "sha256", count, "size")
    multi = settle(done.unionByName(rest), "named-rows")
    winner = (multi.where("doc_id <=> keep_id").groupBy("sha256").agg(F.min("rid").alias("win")))
    multi = multi.join(winner.withColumnRenamed("win", "rid").select("rid", F.lit(True).alias("kept")), "rid", "left")
    out = lone.withColumn("kept", F.lit(True)).unionByName(multi.withColumn("kept", F.coalesce("kept", F.lit(False))))
    return out.select("rid", "doc_id", "keep_id", F.col("size").alias("group_size"), "kept", F.col("sha256").alias("text_sha256"),
                      F.col("snapshot").isNotNull().alias("in_snapshot"))


def by_age(doc_id: str = "doc_id", snapshots: int = 2) -> Column:
    """The snapshots of the query: each row falls by its id in one of ``snapshots`` earlier crawls or in the new batch."""
    turn = F.pmod(crc(doc_id), F.lit(snapshots + 1))
    return F.when(turn < snapshots, turn)
