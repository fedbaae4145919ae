"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits agree in at least six of their eight
positional bytes. Postings are kept per pair of byte pairs, (positions, byte values): of the four
byte pairs at least two are untouched, so linked fingerprints always share a posting of 32 bits.
Inside a posting the shared positional bytes of a pair are tallied, pairs below six go, the others
are verified by their differing bits. A posting with over ``POSTING`` fingerprints is not paired: its
members go to finer postings of six agreeing bytes, and where those are still long, to postings with
two of the free sixteen bits masked, whose members (four at most) all link. Work is on distinct
fingerprints, so a text with a third of all rows is one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import attach, components, settle, short_batches, text_batches

POSTING = 256
SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit number; no words give zero."""
    w = text.lower().split()                       # bytes: lower-cases A-Z only, splits at ASCII white space
    if not w:
        return 0
    grams = [b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    counts, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(grams), step):           # a very long text in pieces: memory is bounded
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[i:i + step]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(grams), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, rid: Column | None = None) -> DataFrame:
    """(doc_id, rid, fp) of every row; only the columns named are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t, words) for t in texts], pa.int64())], names=["doc_id", "rid", "fp"])

    row = (F.monotonically_increasing_id() if rid is None else rid).alias("rid")
    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row, F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(run, f"doc_id long, rid {cols.schema['rid'].dataType.simpleString()}, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _bits(bits: tuple[int, ...]) -> int:
    m = ~sum(1 << b for b in bits) & ((1 << 64) - 1)
    return m - (1 << 64) if m >= 1 << 63 else m


def _postings(fps: DataFrame, sets: list[tuple[int, ...]], given: list[str]) -> DataFrame:
    """A row for each fingerprint and position set: what was given, the set's number, the masked bytes."""
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("bytes")) for i, s in enumerate(sets)])
    return fps.select("fp", *given, F.explode(keys).alias("p")).select("fp", *given, "p.k", "p.bytes")


def _shared_bytes(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    return sum(F.when(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8))


def _pairs(short: DataFrame, key: list[str], bits: int) -> DataFrame:
    """Pairs of a short posting that pass the tally and the check."""
    a, b = short.alias("a"), short.alias("b")
    fa, fb = F.col("a.fp"), F.col("b.fp")
    on = (fa < fb) & (_shared_bytes(fa, fb) >= 8 - bits) & (F.bit_count(fa.bitwiseXOR(fb)) <= bits)
    for k in key:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on).select(fa.alias("a"), fb.alias("b"))


def links(fps: DataFrame, limit: int = POSTING) -> DataFrame:
    """Links (a, b) between distinct fingerprints at two or fewer differing bits: every linked pair,
    but in very long postings; there, links that connect the same fingerprints."""
    two = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2)]
    six = list(combinations(range(8), 6))

    def split(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
        long = postings.groupBy("k", "bytes").count().where(F.col("count") > limit).drop("count")
        return postings.join(long, ["k", "bytes"], "left_anti"), postings.join(long, ["k", "bytes"], "left_semi")

    short, long = split(_postings(fps, two, []))
    # members of a long posting, each once, in postings of six bytes
    short6, long6 = split(_postings(long.select("fp").distinct(), six, []))
    free = F.array(*[F.lit(_bits(tuple(8 * p + i for p, i in pair))) for pair in combinations([(p, i) for p in range(8) for i in range(8)], 2)])
    masked = (long6.select("fp").distinct().select("fp", F.explode(F.transform(free, lambda m: F.struct(m.alias("m"), m.bitwiseAND(F.col("fp")).alias("bytes")))).alias("p"))
              .select("fp", "p.m", "p.bytes"))
    ends = masked.groupBy("m", "bytes").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))      # four at most
    ends = ends.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return _pairs(short, ["k", "bytes"], 2).unionByName(_pairs(short6, ["k", "bytes"], 2)).unionByName(ends)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, limit: int = POSTING,
                    rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, fingerprint, component_id, kept) of every row; one row of each component is kept, the
    first of those with its smallest doc_id. ``rid`` names the rows; without it they are numbered.

    NULL and empty texts, and texts without a word, have fingerprint zero and link like any other.
    Repeated rows stay repeated. A NULL doc_id is kept; it counts for component_id only where the
    component has no other. No rows give no rows. Other columns are ignored."""
    with short_batches(docs.sparkSession):
        rows = settle(fingerprints(docs, doc_id, text, words, rid), "fingerprints")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "rid"))
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), first.alias("first"), F.count("*").alias("n")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), limit))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = settle(classes, "rooted")
    ends = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"), F.count("*").alias("m"))
    ends = settle(ends, "roots")
    named = settle(attach(classes.select("fp", "n", "root"), ends, "root", classes.count(), "m").select("fp", "n", "component_id", F.col("first.rid").alias("keep")), "named")
    out = attach(rows, named, "fp", rows.count(), "n")
    return out.select("rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("rid") == F.col("keep")).alias("kept"))
