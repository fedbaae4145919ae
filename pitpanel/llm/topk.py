"""Exact top-k search by inner product, pruned by segment statistics from coarse to fine.

A vector's segments are told by mean m and deviation s. For a query and a candidate the squared distance is at
least the sum over segments of length L of L((m - m')^2 + (s - s')^2), by Cauchy-Schwarz; the inner product is
half of both squared norms less the squared distance, so a lower bound of the distance is an upper bound of the
score. With few segments the bound is loose and costs two products a segment, with more it tightens. A
candidate goes to the next resolution, and at last to its exact integer score, only while its bound is not
under the query's k-th best score so far; one that could still tie stays.

Queries and candidates are dealt into groups of bounded size; every pair of a query group and a candidate group
is a task that returns at most k rows a query, and these are ranked once more by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.common import settle

SCALE = 64
K = 20
SEGMENTS = (1, 4, 16)
GROUP = 1 << 16           # queries, and candidates, of a task at most (on average: they are dealt by hash)
LEAST = 1 << 11           # smaller groups are not worth a task
QUERIES, CANDIDATES = 512, 4096     # compared at once
FIRST = 256               # candidates of the first step, which has no scores to prune by; later steps double
LONG = (1 << 63) - 1
EXACT = 2.0 ** 53


def packed(vectors: DataFrame, is_query: Column, vec_id: str, embedding: str) -> DataFrame:
    """(rid, vec_id, query, dim, body): floor(SCALE x) of usable vectors, as floats where those hold them and else as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = []
            for v in batch.column(3):
                x = np.floor(v.values.to_numpy(zero_copy_only=False) * SCALE)
                body.append(x.astype(np.float32 if np.abs(x).max(initial=0) < 1 << 24 else np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), batch.column(3).value_lengths(), pa.array(body, pa.binary())], names=["rid", "vec_id", "query", "dim", "body"])

    v = F.col(embedding).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    rows = vectors.where(usable).select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), v.alias("v"))
    return rows.mapInArrow(run, "rid long, vec_id long, query boolean, dim int, body binary")


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean and the deviation, times the root of its length: their product with another's is an upper bound of the score."""
    cuts = [c for c in np.array_split(np.arange(x.shape[1]), segments) if len(c)]
    out = []
    for c in cuts:
        mean = x[:, c].mean(1)
        out += [mean * np.sqrt(len(c)), np.linalg.norm(x[:, c] - mean[:, None], axis=1)]
    return np.stack(out, 1) if out else np.zeros((len(x), 0))


def _scores(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer scores of the pairs (a, b); beyond a long the largest or smallest long."""
    if x.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < EXACT:
        if len(a) * 4 > len(q) * len(x):
            return (q @ x.T)[a, b].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", q[a[i:i + 65536]], x[b[i:i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]).astype(np.int64)
    whole = lambda m: [[int(t) for t in r] for r in m]
    qs, xs = whole(q), whole(x)
    return np.array([max(-LONG - 1, min(LONG, sum(s * t for s, t in zip(qs[i], xs[j])))) for i, j in zip(a, b)], np.int64)


def _matrix(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(pdf), 0))
    return np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64) for b in pdf.body])


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, dim: int, k: int) -> tuple[pd.DataFrame, list[int]]:
    """The k best rows of every query, and how many pairs were left at each resolution and scored."""
    x, q = _matrix(rows, dim), _matrix(queries, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        far_first = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")           # long vectors first: good scores come early
        x, rows = x[far_first], rows.iloc[far_first]
        ids = rows.vec_id.astype("Int64").fillna(LONG).to_numpy(np.int64)            # NULL last
        null, rid = rows.vec_id.isna().to_numpy(), rows.rid.to_numpy()
        levels = [(features(q, s), features(x, s)) for s in SEGMENTS if s <= max(dim, 1)]
        slack = 1e-9 * np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(x, axis=1)[None, :]
        seen, out = [0] * (len(levels) + 1), []
        for i in range(0, len(q), QUERIES):
            p = slice(i, i + QUERIES)
            own = queries.rid.to_numpy()[p]
            least = np.full(len(own), -np.inf)
            top_q, top_x, top_s = (np.zeros(0, np.int64) for _ in range(3))
            j, step = 0, min(FIRST, CANDIDATES)
            while j < len(x):
                c = slice(j, j + step)
                margin = least[:, None] - slack[0][p] * slack[1][:, c] - 1e-6
                left = own[:, None] != rid[None, c]
                for n, (fq, fx) in enumerate(levels):
                    if left.mean() > 0.2:
                        left &= ~(fq[p] @ fx[c].T < margin)                          # an undefined bound prunes nothing
                        a, b = np.nonzero(left)
                    else:
                        a, b = np.nonzero(left)
                        keep = np.concatenate([~(np.einsum("ij,ij->i", fq[p][a[e:e + 65536]], fx[c][b[e:e + 65536]]) < margin[a[e:e + 65536], b[e:e + 65536]])
                                               for e in range(0, len(a), 65536)] or [np.zeros(0, bool)])
                        left[a[~keep], b[~keep]] = False
                        a, b = a[keep], b[keep]
                    seen[n] += len(a)
                score = _scores(q[p], x[c], a, b)
                seen[-1] += len(a)
                keep = score >= least[a]
                a, b, score = np.concatenate([top_q, a[keep]]), np.concatenate([top_x, b[keep] + j]), np.concatenate([top_s, score[keep]])
                order = np.lexsort((rid[b], null[b], ids[b], np.invert(score), a))
                a, b, score = a[order], b[order], score[order]
                starts = np.flatnonzero(np.diff(a, prepend=-1))
                rank = np.arange(len(a)) - np.repeat(starts, np.diff([*starts, len(a)]))
                top_q, top_x, top_s = a[rank < k], b[rank < k], score[rank < k]
                full = rank == k - 1
                low = score[full].astype(float)
                least[a[full]] = np.where(np.abs(low) < EXACT, low, np.nextafter(low, -np.inf))
                j, step = j + step, min(2 * step, CANDIDATES)
            out.append(pd.DataFrame({"qid": own[top_q], "query_id": queries.vec_id.to_numpy()[p][top_q], "rid": rid[top_x], "vec_id": pd.array(ids[top_x], "Int64").copy(), "score": top_s}).assign(
                vec_id=lambda d, at=null[top_x]: d.vec_id.mask(at)))
    return pd.concat(out), seen


def _task(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c: pd.Series([], dtype="Int64") for c in ("qid", "query_id", "rid", "vec_id", "score")})
        return search_block(queries, rows, int(key[0]), k)[0]

    return run


def groups(n: int, cores: int) -> int:
    """As many groups as keep to GROUP rows; more while there are idle cores and LEAST rows a group."""
    return max(1, -(-n // GROUP), min(n // LEAST, cores))


def search(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` other rows with the highest inner product of floor(64 x), for every row of ``is_query``.

    Ties go to the smaller vec_id, NULL last. Vectors that are NULL or hold NULL or non-finite components take no
    part; only vectors of one length are compared. A repeated row is a row: a candidate of its twin and, as a
    query, ranked by itself. Scores beyond a long are the largest or smallest long, and tie. No rows, or no other
    row, give no rows; other columns are ignored."""
    rows = settle(packed(vectors, is_query, vec_id, embedding), "packed-vectors")
    n, queries = rows.agg(F.count("*"), F.count_if("query")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    across, down = groups(n, cores), groups(queries, 1)
    deal = lambda m, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = rows.where("query").select("dim", deal(down, 1).alias("i"), every(across).alias("j"), "rid", "vec_id", "body")
    given = rows.select("dim", every(down).alias("i"), deal(across, 2).alias("j"), "rid", "vec_id", "body")
    key = ["dim", "i", "j"]
    found = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInPandas(_task(k), "qid long, query_id long, rid long, vec_id long, score long")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2]))::BIGINT AS score
        FROM k q JOIN k x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 20"""


def every_twentieth(vectors: DataFrame) -> DataFrame:
    """``search`` with the rows whose vec_id 20 divides as queries."""
    return search(vectors, F.col("vec_id").cast("long") % 20 == 0)
