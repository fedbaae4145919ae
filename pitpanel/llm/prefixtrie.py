"""Trie of the conversations' prefixes, screened by a count-min sketch.

A prefix is named by a polynomial digest modulo 2^127 - 1 over the SHA-256 of its turns. Such digests
of a row of turns compose, so a conversation of any length is digested in sorted blocks by many tasks,
a few totals a block carry on to the next, and a conversation that takes over another's first turns
needs one product a turn and no second look at a text. Texts never leave the scan.

Every task counts the digests of its prefixes in a count-min sketch; the merged sketch (a bit a cell:
one, or more) goes to all tasks. An estimate of one proves that a prefix has one member, so its node
is complete where it stands: tails are written by the task that holds them. Only prefixes that may be
shared are shuffled and grouped exactly; wrong alarms come out of that as nodes with one member.

Subtree sums need no walk. The smallest member of a node is the smallest of all nodes below it on its
own path, so every conversation owns the end of its path from some depth on. With that depth known, a
member's share in a node's children, leaves and saved code points is a sum over its own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import attach, settle

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefix trie").digest()[:15], "big")
BACK = pow(BASE, -1, PRIME)
GROUP = 100               # conversations of one template: c - c % GROUP lends its first turns
LENT = 6                  # a conversation takes over crc32(c) % LENT turns
ROWS = 4                  # rows of the sketch
MOST_CELLS = 1 << 26      # cells of a row at most: the merged sketch has 4 bits a cell, 32 MB. Beyond it fewer prefixes are proven single
SLICE = 1 << 16           # cells merged at once
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
CHUNK = 4096              # bytes of a node's list of ends that are hashed as one row
NONE = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)

Batches = Iterator[pa.RecordBatch]


def _num(b: bytes) -> int:
    return int.from_bytes(b[:16], "big")


def _key(n: int) -> bytes:
    return n.to_bytes(16, "big")


def _scan(batches: Batches) -> Batches:
    """Sorted turns of a block with their place, digest and code points so far, counted from the block's start."""
    block, conv, q, h, total = TaskContext.get().partitionId(), None, 0, 0, 0
    for batch in batches:
        at, digests, sums = [], [], []
        for c, x, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if c != conv:
                conv, q, h, total = c, 0, 0, 0
            q, h, total = q + 1, (h * BASE + _num(x)) % PRIME, total + n
            at.append(q)
            digests.append(_key(h))
            sums.append(total)
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int32()), batch.column(0), pa.array(at, pa.int64()), batch.column(1),
                                          pa.array(digests, pa.binary()), batch.column(2), pa.array(sums, pa.int64())], names=PLACED)


PLACED = ["block", "conv_id", "q", "x", "h", "chars", "total"]
PLACES = "block int, conv_id long, q long, x binary, h binary, chars long, total long"


def _carry(batches: Batches) -> Batches:
    for batch in batches:
        q, h, total, q0, h0, total0 = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("q", "h", "total", "q0", "h0", "total0"))
        whole = [_key((_num(b) * pow(BASE, i, PRIME) + _num(a)) % PRIME) for i, a, b in zip(q, h, h0)]
        cols = {n: batch.column(batch.schema.get_field_index(n)) for n in PLACED}
        cols |= {"q": pa.array([a + b for a, b in zip(q, q0)], pa.int64()), "h": pa.array(whole, pa.binary()), "total": pa.array([a + b for a, b in zip(total, total0)], pa.int64())}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=PLACED)


def places(conversations: DataFrame) -> DataFrame:
    """Every turn with its place q in its conversation, and the digest h and code points of the turns up to it.

    One sort over all turns, so a conversation may lie in many blocks; what a block adds for the next one
    is three numbers, kept for its last conversation only."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), digest.alias("x"), F.length(text).cast("long").alias("chars"),
                                                              F.col("turn").cast("long").alias("turn"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.asc_nulls_first("turn"), "x", "row"]
    placed = settle(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "x", "chars").mapInArrow(_scan, PLACES), "places")
    last = F.max(F.struct("conv_id", "q", "h", "total")).alias("last")
    carried, before, went_in = [], None, None
    for b in placed.groupBy("block").agg(F.min("conv_id").alias("first"), last).orderBy("block").collect():       # a row per block
        into = None
        if before and before["last"].conv_id == b["first"]:
            q, h, total = before["last"].q, _num(before["last"].h), before["last"].total
            if went_in and before["first"] == b["first"]:
                q, h, total = q + went_in[0], (went_in[1] * pow(BASE, q, PRIME) + h) % PRIME, total + went_in[2]
            into = (q, h, total)
            carried.append((b["block"], b["first"], q, _key(h), total))
        before, went_in = b, into
    if not carried:
        return placed
    carry = F.broadcast(conversations.sparkSession.createDataFrame(carried, "block int, conv_id long, q0 long, h0 binary, total0 long"))
    moved = settle(placed.join(carry, ["block", "conv_id"]).mapInArrow(_carry, PLACES), "places-carried")
    return placed.join(carry, ["block", "conv_id"], "left_anti").unionByName(moved)


def _rebuild(batches: Batches) -> Batches:
    for batch in batches:
        power, add, sub, h, x = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("power", "add", "sub", "h", "x"))
        whole = [((_num(a) - _num(s)) * pow(BASE, p, PRIME) + _num(v)) % PRIME for p, a, s, v in zip(power, add, sub, h)]
        above = [(v - _num(t)) * BACK % PRIME for v, t in zip(whole, x)]
        keep = [batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "len", "depth", "chars", "before")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(map(_key, whole), pa.binary()), pa.array(map(_key, above), pa.binary())], names=["conv_id", "len", "depth", "chars", "before", "key", "above"])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) of every rebuilt conversation, and its turns: depth, code points, those before it, digests of it and of the prefix above."""
    turns = places(conversations)
    head = F.sort_array(F.collect_list(F.when(F.col("q") < LENT, F.struct("q", "h", "x", "chars", "total")))).alias("head")     # five at most
    own = settle(turns.groupBy("conv_id").agg(F.count("*").alias("n"), head), "conversation-heads")
    lender = own.select(F.col("conv_id").alias("lender"), F.col("head").alias("lent"))
    convs = own.withColumn("cut", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).cast("int")).withColumn("lender", F.col("conv_id") - F.col("conv_id") % GROUP)
    convs = convs.join(lender, "lender", "left").withColumn("lent", F.coalesce(F.slice("lent", F.lit(1), F.col("cut")), F.slice("head", 1, 0)))
    end = lambda a, field, none: F.coalesce(F.try_element_at(F.col(a), F.lit(-1))[field], F.lit(none))
    mine = F.slice("head", F.lit(1), F.col("cut"))
    convs = convs.withColumn("mine", mine).select(
        "conv_id", "n", "lent", F.size("lent").alias("m"), "cut", (F.size("lent") + F.greatest(F.col("n") - F.col("cut"), F.lit(0))).cast("long").alias("len"),
        end("lent", "h", ROOT).alias("add"), end("mine", "h", ROOT).alias("sub"), (end("lent", "total", 0) - end("mine", "total", 0)).alias("shift"))
    convs = settle(convs, "conversation-cuts")
    later = attach(turns.select("conv_id", "q", "x", "h", "chars", "total"), convs.drop("lent"), "conv_id", convs.agg(F.sum("n")).first()[0] or 0, "n").where("q > cut")
    later = later.select("conv_id", "len", (F.col("q") - F.col("cut") + F.col("m")).alias("depth"), "chars", (F.col("total") + F.col("shift") - F.col("chars")).alias("before"),
                         "h", "x", (F.col("q") - F.col("cut")).alias("power"), "add", "sub")
    first = convs.select("conv_id", "len", F.explode("lent").alias("t")).select(
        "conv_id", "len", F.col("t.q").alias("depth"), F.col("t.chars").alias("chars"), (F.col("t.total") - F.col("t.chars")).alias("before"), F.col("t.h").alias("h"),
        F.col("t.x").alias("x"), F.lit(0).cast("long").alias("power"), F.lit(ROOT).alias("add"), F.lit(ROOT).alias("sub"))
    rows = later.unionByName(first).mapInArrow(_rebuild, "conv_id long, len long, depth long, chars long, before long, key binary, above binary")
    return convs.select("conv_id", "len"), settle(rows, "rebuilt")


def cells(keys: pa.Array, bits: int) -> np.ndarray:
    """The cells of every digest: one of 2^bits in each row of the sketch."""
    halves = np.frombuffer(b"".join(keys.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    return np.stack([((halves[:, 0] * np.uint64(ODD[2 * r]) + halves[:, 1] * np.uint64(ODD[2 * r + 1])) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r in range(ROWS)])


def _count(bits: int) -> Callable[[Batches], Batches]:
    """A task's sketch by slices: the cells it met once and those it met more often."""

    def run(batches: Batches) -> Batches:
        cell, n, pending, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([cell, *pending]), return_inverse=True)
            weight = np.concatenate([n, np.ones(sum(map(len, pending)), np.int64)])
            return every, np.minimum(np.bincount(at, weight, len(every)).astype(np.int64), 2)

        for batch in batches:
            pending.append(cells(batch.column(0), bits).ravel())
            size += len(pending[-1])
            if size > 4_000_000:
                cell, n = merged()
                pending, size = [], 0
        cell, n = merged()
        starts = np.flatnonzero(np.diff(cell // SLICE, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(cell)]):
            low, many = (cell[a:b] % SLICE).astype(np.uint16), n[a:b] > 1
            yield pa.RecordBatch.from_pylist([{"slice": int(cell[a] // SLICE), "once": low[~many].tobytes(), "more": low[many].tobytes()}],
                                             schema=pa.schema([("slice", pa.int64()), ("once", pa.binary()), ("more", pa.binary())]))

    return run


def _merge(batches: Batches) -> Batches:
    """Slices of many tasks to one bit a cell: met more than once."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, once, more in zip(*(c.to_pylist() for c in batch.columns)):
            got = found.setdefault(s, np.zeros(SLICE, np.uint8))
            low = np.frombuffer(once, np.uint16)
            got[low] = np.minimum(got[low] + 1, 2)
            got[np.frombuffer(more, np.uint16)] = 2
    for s, got in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(got > 1).tobytes()], pa.binary())], names=["slice", "bits"])


def sketch(keys: DataFrame, total: int, most: int = MOST_CELLS) -> tuple[np.ndarray, int]:
    """Packed bits of the merged count-min sketch of ``keys`` (one binary column), and the log of a row's cells."""
    bits = max(min((2 * total).bit_length(), most.bit_length() - 1), 10)
    parts = keys.mapInArrow(_count(bits), "slice long, once binary, more binary").repartition("slice").mapInArrow(_merge, "slice long, bits binary")
    packed = np.zeros(max((ROWS << bits) // 8, SLICE // 8), np.uint8)
    for s, got in parts.toLocalIterator():
        packed[s * SLICE // 8:(s + 1) * SLICE // 8] = np.frombuffer(got, np.uint8)[:len(packed) - s * SLICE // 8]
    return packed, bits


def _screen(sent, bits: int) -> Callable[[Batches], Batches]:
    def many(keys: pa.Array) -> np.ndarray:
        at = cells(keys, bits)
        return ((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            above = many(batch.column(batch.schema.get_field_index("above"))) | (np.array(batch.column(batch.schema.get_field_index("depth"))) == 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(many(batch.column(batch.schema.get_field_index("key")))), pa.array(above)], names=[*batch.schema.names, "shared", "under"])

    return run


def _chunks(batches: Batches) -> Batches:
    """Ends in ascending order to pieces of a node's comma-joined list, with the first id of each."""
    held: dict[bytes, list[int]] = {}
    waiting = 0
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("piece", pa.binary())])

    def rows(keys) -> Batches:
        keys = list(keys)
        for i in range(0, len(keys), 1000):
            part = [(k, held.pop(k)) for k in keys[i:i + 1000]]
            yield pa.RecordBatch.from_pylist([{"key": k, "first": ids[0], "piece": ",".join(map(str, ids)).encode()} for k, ids in part], schema=schema)

    for batch in batches:
        for key, c in zip(*(x.to_pylist() for x in batch.columns)):
            ids = held.setdefault(key, [])
            ids.append(c)
            waiting += 1
            if len(ids) * 20 >= CHUNK:
                waiting -= len(ids)
                yield from rows([key])
        if waiting > 500_000:
            yield from rows(held)
            waiting = 0
    yield from rows(held)


def _hashes(batches: Batches) -> Batches:
    """Pieces sorted by node and first id to the SHA-256 of each node's whole list, one piece at a time."""
    last, state = None, None

    def out(keys: list[bytes], values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], names=["key", "ends_sha256"])

    for batch in batches:
        keys, values = [], []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key == last:
                state.update(b"," + piece)
            else:
                if state:
                    keys.append(last)
                    values.append(state.hexdigest())
                last, state = key, hashlib.sha256(piece)
        yield out(keys, values)
    if state:
        yield out([last], [state.hexdigest()])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): pieces are joined where the ids are sorted, so a node with many ends is few rows in one stream."""
    pieces = ends.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(_chunks, "key binary, first long, piece binary")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations, the empty one included.

    Turns are in the order of turn (NULL first), rows of one turn in that of their SHA-256; a repeated row is a
    turn of its own. NULL role or text is empty. conv_id % 100 has the sign of conv_id. Rows with a NULL conv_id
    belong to no conversation and are left out; a conversation with no turns left ends at the root; no rows give
    no nodes; other columns are ignored. At most ``most_cells`` cells a row of the sketch: more prefixes than
    that are still grouped exactly, fewer of them locally."""
    spark = conversations.sparkSession
    convs, rows = rebuilt(conversations)
    packed, bits = sketch(rows.select("key"), rows.count(), most_cells)
    screened = rows.mapInArrow(_screen(spark.sparkContext.broadcast(packed), bits), "conv_id long, len long, depth long, chars long, before long, key binary, above binary, shared boolean, under boolean")

    roots = convs.select("conv_id", "len", *(F.lit(0).cast("long").alias(c) for c in ("depth", "chars", "before")), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("above"))
    shared = settle(screened.where("shared").drop("shared", "under").unionByName(roots), "shared-prefixes")
    total = shared.count()
    groups = settle(shared.groupBy("key").agg(F.min("conv_id").alias("low"), F.max("len").alias("deepest"), F.count("*").alias("n")), "prefix-groups")
    # a conversation's path is another's down to some depth and its own from there on
    back = attach(shared, groups, "key", total, "n").withColumn("lent", F.col("low") != F.col("conv_id"))
    paths = back.groupBy("conv_id").agg(F.count_if("lent").alias("owned"), F.max(F.when(F.col("lent"), F.col("before") + F.col("chars"))).alias("lent_chars"),
                                        (~F.max((F.col("depth") == F.col("len")) & (F.col("lent") | (F.col("deepest") > F.col("len"))))).cast("long").alias("leaf"), F.count("*").alias("n"))
    paths = settle(paths, "prefix-paths")
    saved = F.when(F.col("owned") > F.col("depth"), F.col("lent_chars") - F.col("before")).otherwise(0)
    nodes = attach(shared, paths, "conv_id", total, "n").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("above").alias("above"), F.count("*").alias("n_convs"),
        F.count_if((F.col("owned") <= F.col("depth") + 1) & (F.col("len") > F.col("depth"))).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    nodes = nodes.join(end_hashes(shared.where("depth = len").select("key", "conv_id")), "key", "left")

    ends = F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NONE))
    single = screened.where("NOT shared").select(
        "conv_id", "depth", "above", "under", F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ends.alias("ends_sha256"))
    joined = settle(nodes.drop("key").unionByName(single.where("under").drop("under")), "nodes-under-groups")
    parents = groups.select(F.col("key").alias("above"), F.col("low").alias("parent_conv_id"), "n")
    named = attach(joined.where("depth > 0"), parents, "above", total, "n")
    named = named.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))        # under a prefix proved single: a wrong alarm
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")]
    top = joined.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    alone = single.where("NOT under").withColumn("parent_conv_id", F.col("conv_id"))
    return named.select(*out).unionByName(top.select(*out)).unionByName(alone.select(*out))


CRC = """xor(4294967295, reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda a, b: reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""

ORACLE = f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    x AS (SELECT c, turn, length(text) AS chars, sha256(length(role) || ':' || role || text) AS x FROM t),
    o AS (SELECT c, x, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x[1:32]) AS q FROM x),
    i AS (SELECT c, {CRC} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
    r AS (SELECT i.c, o.x, o.chars, o.q, 0 AS part FROM i JOIN o ON o.c = i.c - i.c % 100 AND o.q <= i.h
          UNION ALL SELECT i.c, o.x, o.chars, o.q, 1 FROM i JOIN o ON o.c = i.c AND o.q > i.h),
    d AS (SELECT c, chars, row_number() OVER w AS depth, string_agg(x, ',') OVER w AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY part, q ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT c, depth, sha256(k) AS k, chars FROM d UNION ALL SELECT c, 0, '', 0 FROM i),
    l AS (SELECT *, max(depth) OVER (PARTITION BY c) AS len FROM m),
    n AS (SELECT k, depth, min(c) AS c, count(*) AS n, max(len) > depth AS inner_node, any_value(chars) AS chars, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = depth) AS ends FROM l GROUP BY k, depth),
    s AS (SELECT a.k, a.depth, count(*) FILTER (WHERE NOT n.inner_node) AS n_leaves, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (WHERE n.depth = a.depth + 1) AS kids
          FROM n JOIN l a ON a.c = n.c AND a.depth <= n.depth GROUP BY a.k, a.depth)
    SELECT n.c::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.c::BIGINT AS parent_conv_id, n.n::BIGINT AS n_convs, s.kids::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
        s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM n JOIN s USING (k, depth) LEFT JOIN l pl ON pl.c = n.c AND pl.depth = n.depth - 1 LEFT JOIN n p ON p.k = pl.k AND p.depth = pl.depth"""
