"""Product codes of vectors, found by equal-average search.

A vector is cut into equal parts; each part position has a codebook of its own. A codebook's entries are
sorted by the sum of their components. The search for a part starts at its own sum and goes outward, always
to the nearer of the next entries below and above: by Cauchy-Schwarz the squared gap of two sums over the
part's dimension is at most the squared distance, so it ends as soon as that strictly exceeds the best
distance found. Equal distances go to the lower index, so nothing is lost and nothing is approximate: all
numbers are integers, Python's own where 64 bits might not do.

Rounds run as Spark jobs over all vectors. A task sums its parts by position and entry; what is shuffled is one
row per task, position and entry, and the driver holds the codebooks, whose size does not depend on the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import attach, settle

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LONG = (1 << 63) - 1
BATCH = 8192              # vectors coded at once

Batches = Iterator[pa.RecordBatch]


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers where sums of BATCH of them fit, else Python's."""
    scaled = np.floor(values * scale) if np.abs(values).max(initial=0) < 2.0 ** 900 else None
    if scaled is not None and np.abs(scaled).max(initial=0) < 2.0 ** 49:
        return scaled.astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 2.0 ** 53 else int(np.floor(v * scale)) for v in values.ravel()], object).reshape(values.shape)


class Codebook:
    """Entries of one part position, sorted by the sum of their components."""

    def __init__(self, entries: list[tuple[int, ...]]):
        self.entries = np.array(entries, object).reshape(len(entries), len(entries[0]))
        self.sums = self.entries.sum(1) if self.entries.shape[1] else np.zeros(len(entries), object)
        self.order = np.array(sorted(range(len(entries)), key=lambda i: (self.sums[i], i)))
        self.most = max((abs(v) for e in entries for v in e), default=0)
        self.small = self.most < 1 << 31 and (self.entries.astype(np.int64), self.sums.astype(np.int64))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every part, and the squared distance."""
        n, width = parts.shape
        reach = 2 * max(width, 1) * max(self.most, *(abs(int(v)) for v in (parts.max(initial=0), parts.min(initial=0))))       # no gap of sums is wider
        if self.small and parts.dtype == np.int64 and reach < 1 << 31:        # squared gaps and width x distance stay under 2^62
            (entries, sums), kind = self.small, np.int64
        else:
            entries, sums, kind, parts = self.entries, self.sums, object, parts.astype(object)
        total, ranked, last = parts.sum(1) if width else np.zeros(n, kind), sums[self.order], len(sums) - 1
        above = np.searchsorted(ranked, total)
        below = above - 1
        best, found, live = np.zeros(n, kind), np.full(n, -1), np.arange(n)
        while len(live):
            lo, hi, t = below[live], above[live], total[live]
            down = np.where(lo >= 0, t - ranked[np.maximum(lo, 0)], reach + 1)
            up = np.where(hi <= last, ranked[np.minimum(hi, last)] - t, reach + 1)
            gap = np.minimum(down, up)
            going = (gap <= reach) & ((found[live] < 0) | (gap * gap <= width * best[live]))
            live, left = live[going], (down <= up)[going]
            entry = self.order[np.where(left, lo[going], hi[going])]
            below[live] -= left
            above[live] += ~left
            away = parts[live] - entries[entry]
            d = (away * away).sum(1) if width else np.zeros(len(live), kind)
            better = (found[live] < 0) | (d < best[live]) | ((d == best[live]) & (entry < found[live]))
            best[live[better]], found[live[better]] = d[better], entry[better]
        return found, best


def _vectors(batch: pa.RecordBatch, column: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vectors have ``length`` components, and those as integers."""
    v = batch.column(batch.schema.get_field_index(column))
    sizes = np.diff(np.array(v.offsets))
    rows = np.flatnonzero(sizes == length)
    flat = np.array(v.flatten(), float)
    values = flat[np.repeat(sizes == length, sizes)].reshape(len(rows), length)
    return rows, whole(values, SCALE)


def _split(batches: Batches) -> Batches:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield batch.slice(start, BATCH)


def _sums(books: list[Codebook], length: int) -> Callable[[Batches], Batches]:
    """A task's parts by position and nearest entry: how many, and the sums of their components as text of whole numbers."""
    width = length // len(books)

    def run(batches: Batches) -> Batches:
        n = np.zeros((len(books), len(books[0].order)), np.int64)
        total = np.zeros((*n.shape, width), object)
        for batch in _split(batches):
            rows, x = _vectors(batch, "v", length)
            for p, book in enumerate(books):
                part = x[:, p * width:(p + 1) * width]
                found, _ = book.nearest(part)
                n[p] += np.bincount(found, minlength=n.shape[1])
                some = np.zeros(total[p].shape, x.dtype)
                np.add.at(some, found, part)
                total[p] += some
        at = np.argwhere(n)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array([int(n[p, e]) for p, e in at], pa.int64()),
                                          pa.array([",".join(map(str, total[p, e])) for p, e in at], pa.string())], names=["part", "entry", "n", "total"])

    return run


def _merge(batches: Batches) -> Batches:
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for p, e, n, total in zip(*(c.to_pylist() for c in batch.columns)):
            values = [int(t) for t in total.split(",")] if total else []
            got = found.setdefault((p, e), [0, [0] * len(values)])
            found[p, e] = [got[0] + n, [a + b for a, b in zip(got[1], values)]]
    rows = [(p, e, ",".join(str(t // n) for t in total)) for (p, e), (n, total) in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int32(), pa.string()))], names=["part", "entry", "mean"])


def _codes(books: list[Codebook], length: int) -> Callable[[Batches], Batches]:
    width = length // len(books)

    def run(batches: Batches) -> Batches:
        for batch in _split(batches):
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            rows, x = _vectors(batch, "v", length)
            found, away = zip(*(book.nearest(x[:, p * width:(p + 1) * width]) for p, book in enumerate(books)))
            total = np.stack([a.astype(object) for a in away]).sum(0)
            for i, row in enumerate(np.stack(found, 1).astype(np.uint8)):
                code[rows[i]], error[rows[i]] = row.tobytes().hex(), min(int(total[i]), LONG)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def encode(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector is usable; ``entries`` is 256 at most.

    Rows whose vector is NULL or holds NULL or non-finite components are left out. The books start from the
    ``entries`` first rows by vec_id (NULL last, then by vector; a repeated row is a row), fewer if there are no
    more. Vectors of another length than the first, or of one that ``parts`` does not divide, stay with NULL code
    and error and change no book. Labels are equal as text, NULLs together. An error beyond a long is the largest
    long. No rows give no rows; other columns are ignored."""
    spark = rows.sparkSession
    usable = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    usable = usable.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    first = [r.v for r in usable.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]          # as many as a book has entries
    length = len(first[0]) if first else 0
    width = length // parts
    first = [tuple(int(t) for t in whole(np.array(v, float), SCALE)) for v in first if len(v) == length]
    coded = bool(first) and length % parts == 0
    books = [Codebook([v[p * width:(p + 1) * width] for v in first]) for p in range(parts)] if coded else []
    for _ in range(rounds if coded else 0):
        sent = usable.select("v").mapInArrow(_sums(books, length), "part int, entry int, n long, total string")
        means = sent.repartition("part", "entry").mapInArrow(_merge, "part int, entry int, mean string").collect()      # parts x entries rows
        new = [[tuple(map(int, e)) for e in book.entries] for book in books]
        for part, entry, mean in means:
            new[part][entry] = tuple(int(t) for t in mean.split(",")) if mean else ()
        books = [Codebook(e) for e in new]
    digest = hashlib.sha256(",".join(str(int(v)) for book in books for e in book.entries for v in e).encode()).hexdigest()
    if not coded:
        return usable.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
    found = settle(usable.select("vec_id", "label", "v").mapInArrow(_codes(books, length), "vec_id long, label string, code string, error long")
                   .withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("-"))), "codes")
    total = F.sum(F.col("error").cast("decimal(28,0)"))
    sums = settle(found.groupBy("key").agg(F.when(total > LONG, F.lit(LONG)).otherwise(total.cast("long")).alias("label_error"), F.count("*").alias("n")), "label-errors")
    out = attach(found, sums, "key", found.count(), "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _near(book: str) -> str:
    return f"""SELECT vec_id, part, e, d FROM (SELECT x.vec_id, x.part, b.e, list_sum(list_transform(list_zip(x.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM x JOIN {book} b USING (part)) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) = 1"""


def _means(near: str, book: str) -> str:
    return f"""SELECT b.part, b.e, coalesce(m.p, b.p) AS p FROM {book} b LEFT JOIN (SELECT part, e, list(floor(s / n)::BIGINT ORDER BY i) AS p
        FROM (SELECT part, e, i, sum(x.p[i]) AS s, count(*) AS n FROM {near} JOIN x USING (vec_id, part), range(1, 5) r(i) GROUP BY part, e, i) GROUP BY part, e) m USING (part, e)"""


#: For tables with one row per vec_id and vectors of 64 components.
ORACLE = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS (SELECT vec_id, part, v[4 * part + 1:4 * part + 4] AS p FROM k, range(16) r(part)),
    b0 AS (SELECT part, e, p FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64) USING (vec_id)),
    n0 AS MATERIALIZED ({_near("b0")}), b1 AS MATERIALIZED ({_means("n0", "b0")}), n1 AS MATERIALIZED ({_near("b1")}), b2 AS MATERIALIZED ({_means("n1", "b1")}), n2 AS MATERIALIZED ({_near("b2")}),
    c AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n2 GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
    FROM c JOIN k USING (vec_id)"""
