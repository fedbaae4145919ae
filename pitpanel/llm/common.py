"""Shared pieces: settled tables, joins on keys that may be hot, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.session import checkpoint_dir

HOT_KEYS = 10_000        # a key is hot if it has over total / HOT_KEYS rows, so hot keys are fewer than this
HOT_LEAST = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def settle(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet in the shared checkpoint folder and read back.

    Several passes read it and a lost executor costs a re-read. The folder is the session's own."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, keyed: DataFrame, key: str, total: int, n: str) -> DataFrame:
    """Left join of ``rows`` with ``keyed`` (one row per key; column ``n`` counts the rows of the key).

    A key with over total / HOT_KEYS rows is joined by broadcast: there are fewer than HOT_KEYS of
    those whatever the size, so the broadcast is bounded. All other keys are joined by shuffle,
    where no key has more rows than that. ``rows`` and ``keyed`` are read twice: settle them first."""
    limit = total // HOT_KEYS + HOT_LEAST
    hot = F.broadcast(keyed.where(F.col(n) > limit))
    few = keyed.where(F.col(n) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(few, key, "left"))


RID = "__row_of_file"
SENT_ROWS = 400_000      # row names (16 bytes) are broadcast up to this many, beyond that both sides are shuffled


def named_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a name for every row that is the same on every read: its file's hash and its place there.

    A table that does not come from files is written to the shared folder first. A column of the table's own
    called ``_metadata`` stays as it is."""

    def name(d: DataFrame) -> Column:
        file = d.metadataColumn("_metadata")
        return F.struct(F.xxhash64(file["file_path"]).alias("f"), file["row_index"].alias("r")).alias(RID)

    try:
        return docs.select("*", name(docs))
    except AnalysisException:
        kept = settle(docs, "docs")
        return kept.select("*", name(kept))


def by_names(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """``docs`` (of ``named_rows``) joined with a settled list of row names; the name goes."""
    side = F.broadcast(names) if names.count() <= SENT_ROWS else names
    return docs.join(side, RID, how).drop(RID)


def crc(column: str) -> Column:
    """crc32 of a column as text; NULL stays NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1024         # whole texts that are sent to a Python worker at once, where the result does not depend on it


@contextmanager
def short_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs run inside send Python workers at most ``rows`` rows at once; the session's own setting comes back after.

    A batch is held by the executor and its worker, each with room to grow: 10,000 texts are some 100 MB a task."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def give_back() -> None:
    """Memory that this process has freed goes back to the system.

    A Python worker lives on after its task: what one stage held at its peak would count in all later ones."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):          # glibc has it
        trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of at most ``rows`` rows with one column as UTF-8 bytes, NULL as empty."""
    give_back()                          # what the worker's last task left
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            texts = part.column(part.schema.get_field_index(column)).cast(pa.large_binary())
            yield part, [t or b"" for t in texts.to_pylist()]
    give_back()


def local_forest(schema: pa.Schema):
    """A function for mapInArrow: edges (a, b) of a task become (node, smallest node it reaches in the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def out() -> Iterator[pa.RecordBatch]:
            kids = [(x, r) for x in list(up) if (r := root(x)) != x]
            for i in range(0, len(kids), 100_000):
                part = kids[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], schema=schema)
            up.clear()

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > 1_000_000:          # memory stays bounded; later rounds join the pieces
                yield from out()
        yield from out()

    return run


FINISH = 100_000      # links that one task may join: 16 bytes each and a bounded table of their nodes


def components(edges: DataFrame, rounds: int = 60, finish: int = FINISH) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b, both long): root is the smallest node reachable.

    Every task first shrinks its links to a forest. Where ``finish`` links or fewer are left, one task joins
    them; where more, alternating large-star and small-star steps do. Each step first shrinks a task's edges to a forest,
    so a star around one node is at most one edge per member and task, and takes the smallest
    neighbour by partial aggregation. State lives in the checkpoint folder between rounds; nothing is
    collected but two checksums. Self-links and repeated links are allowed; no edges give no rows."""
    checkpoint_dir(edges.sparkSession)
    shrink = local_forest(pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    state = edges.select("a", "b").where("a <> b").mapInArrow(shrink, "u long, v long").distinct().checkpoint()
    if 0 < state.count() <= finish:
        state = state.coalesce(1).mapInArrow(shrink, "u long, v long").checkpoint()
        rounds = 0
    before = None
    for _ in range(rounds):
        both = state.select("u", "v").union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        total = state.count()
        if not total:
            break
        low = low.checkpoint()
        large = attach(both, low, "u", 2 * total, "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct().checkpoint()
        # small star: every node has only smaller neighbours now
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).checkpoint()
        small = attach(large, low, "u", max(large.count(), 1), "n")
        state = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct().checkpoint())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if rounds:
            raise RuntimeError(f"components not settled after {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v").distinct())
