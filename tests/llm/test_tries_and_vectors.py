"""Prefix trie, vector codes and top-k search against plain versions on odd tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from pitpanel.llm import prefixtrie, topk, vectorcodes


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            x = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0, x), (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda v: v[0])] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    nodes = collections.defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for v in nodes:
        kids[v[:-1]] += bool(v)
    for v, m in nodes.items():
        for d in range(len(v) + 1):
            leaves[v[:d]] += not kids[v]
            saved[v[:d]] += (len(m) - 1) * len(v[-1][1]) if v else 0
    return collections.Counter((min(m), len(v), min(nodes[v[:-1]]) if v else None, len(m), kids[v], leaves[v], saved[v],
                                hashlib.sha256(",".join(str(c) for c in sorted(m) if full[c] == v).encode()).hexdigest()) for v, m in nodes.items())


def conversations():
    rng = np.random.default_rng(3)
    rows = [(7, t, "user", f"turn {t % 11} é😀") for t in range(700)]                         # lies in several blocks
    rows += [(200, t, "user", f"lent {t}") for t in range(300)] + [(203 + i, t, None, "same") for i in range(40) for t in range(9)]
    for c in [*range(90), 100, *range(-130, -95), 10**15, 10**15 + 3]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, int(t), ["user", "assistant", None, "system"][rng.integers(4)], [None, "", "a", "b b", "x" * 5000][rng.integers(5)]))
    return rows + [(5, None, "user", "first"), (5, None, "user", "first"), (5, 1, "user", "twice"), (None, 0, "user", "nobody's"), (301, 0, "user", "only"), (302, None, None, None)]


@pytest.mark.parametrize("cells", [prefixtrie.MOST_CELLS, 1 << 10])
def test_trie(spark, cells, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 100)
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, key string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefixtrie.trie(df, cells).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert collections.Counter(map(tuple, got)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(df.where("false")).count() == 0 and prefixtrie.trie(df.where("conv_id IS NULL")).count() == 0
    only = prefixtrie.trie(spark.createDataFrame([(302, None, None, None)], df.schema)).collect()      # its one turn is cut, nobody lends
    assert [(r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in only] == [(0, 1, 1, hashlib.sha256(b"302").hexdigest())]


def test_places_carry_over_blocks(spark):
    df = spark.createDataFrame([(1, t, "r", "t") for t in range(900)] + [(2, 0, "r", "t")], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.conv_id, r.q, r.total, bytes(r.h)) for r in prefixtrie.places(df).collect())
        assert prefixtrie.places(df).select("block").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    x, h = int.from_bytes(hashlib.sha256(b"1:rt").digest()[:16], "big"), 0
    for i, (c, q, total, digest) in enumerate(got[:900]):
        h = (h * prefixtrie.BASE + x) % prefixtrie.PRIME
        assert (c, q, total, digest) == (1, i + 1, i + 1, h.to_bytes(16, "big"))
    assert got[900][:3] == (2, 1, 1)


def test_sketch_proves_singles(spark):
    keys = [hashlib.sha256(str(i).encode()).digest()[:15].rjust(16, b"\0") for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys + keys[:300]], "key binary").repartition(4)
    import pyarrow as pa

    packed, bits = prefixtrie.sketch(df, 3300)
    at = prefixtrie.cells(pa.array(keys, pa.binary()), bits)
    many = ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)
    assert many[:300].all() and many[300:].mean() < 0.05


def plain_codes(rows, parts=16, size=64, rounds=2):
    kept = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = min(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    fit = [r for r in kept if len(r[2]) == len(first[2])]
    w = len(first[2]) // parts
    # the first rows of all, of whatever length
    start = [r for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:size] if len(r[2]) == len(first[2])]
    books = [[r[2][p * w:(p + 1) * w] for r in start] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = collections.defaultdict(list)
            for r in fit:
                x = r[2][p * w:(p + 1) * w]
                got[near(p, x)[1]].append(x)
            new.append([[sum(c) // len(got[i]) for c in zip(*got[i])] if i in got else e for i, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    codes = {}
    for n, r in enumerate(kept):
        if len(r[2]) == len(first[2]):
            found = [near(p, r[2][p * w:(p + 1) * w]) for p in range(parts)]
            codes[n] = "".join(f"{i:02x}" for _, i in found), min(sum(d for d, _ in found), 2**63 - 1)
    sums = collections.Counter()
    for n, (_, e) in codes.items():
        sums[kept[n][1]] += e
    return [(r[0], *codes.get(n, (None, None)), min(sums[r[1]], 2**63 - 1) if r[1] in sums else None, digest) for n, r in enumerate(kept)]


CODED = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("dim,big", [(16, 1), (32, 1), (64, 1e18), (48, 3e38)])
def test_codes(spark, dim, big):
    rng = np.random.default_rng(dim)
    rows = []
    for i in range(150):
        v = np.round(rng.normal(size=dim), 1 if i % 3 else 2) * (big if i % 10 == 0 else 1)
        rows.append((i * 3 - 60, [float(x) for x in np.float32(np.clip(v, -3e38, 3e38))], None if i % 4 == 0 else i % 3))
    rows += [(1, None, 1), (2, [float("nan")] * dim, 1), (3, [None] * dim, 1), (4, [float("-inf")] * dim, 1), (None, rows[3][1], 2), (rows[5][0], rows[5][1], 1), (rows[5][0], rows[6][1], 1),
             (900, [1.0] * (dim + 16), None), (901, [], 5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, n int").repartition(3)
    got = vectorcodes.encode(df).select(CODED).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_codes(rows))


def test_codes_odd(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = [(2, [1.0, 2.0] * 8, 1), (1, [0.5, -2.0] * 8, None)]
    assert collections.Counter(map(tuple, vectorcodes.encode(spark.createDataFrame(few, schema)).select(CODED).collect())) == collections.Counter(plain_codes(few))
    assert vectorcodes.encode(spark.createDataFrame(few, schema).where("false")).count() == 0
    uneven = vectorcodes.encode(spark.createDataFrame([(1, [1.0] * 5, 1)], schema)).collect()
    assert [(r.vec_id, r.code, r.error) for r in uneven] == [(1, None, None)]
    none = vectorcodes.encode(spark.createDataFrame([(1, [], 1)], schema)).collect()
    assert [(r.code, r.error, r.label_error) for r in none] == [("00" * 16, 0, 0)]


def test_search_stops_only_beyond_the_best():
    rng = np.random.default_rng(0)
    for width in (1, 4, 7):
        book = vectorcodes.Codebook([tuple(int(t) for t in rng.integers(-9, 9, width)) for _ in range(64)])
        x = rng.integers(-12, 12, (500, width))
        d = ((x[:, None].astype(np.int64) - book.entries.astype(np.int64)[None]) ** 2).sum(2)
        found, best = book.nearest(x)
        assert (found == d.argmin(1)).all() and (best == d.min(1)).all()


def plain_search(rows, k=20):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(kept):
        if q is not None and q % 20 == 0:
            found = [(-max(-2**63, min(2**63 - 1, sum(s * t for s, t in zip(v, w)))), i is None, i or 0) for b, (i, w) in enumerate(kept) if a != b and len(v) == len(w)]
            out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize("dim", [1, 20, 64])
def test_search(spark, dim, monkeypatch):
    monkeypatch.setattr(topk, "LEAST", 100)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(dim)
    rows = [(i - 30, [float(x) for x in np.float32(rng.normal(size=dim) * rng.choice([0.1, 1]) + (i % 4))]) for i in range(400)]
    rows += [(1000 + 20 * i, rows[7][1]) for i in range(30)] + [(None, rows[7][1]), (20, rows[7][1]), (20, rows[7][1])]
    rows += [(40, None), (60, [float("nan")] * dim), (80, [float("inf")] * dim), (100, [None] * dim), (120, []), (121, []), (140, [1.0] * (dim + 1))]
    rows += [(160, [3e38] * dim), (161, [-3e38] * dim), (162, [1e10] * dim)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rid int").repartition(3)
    got = topk.every_twentieth(df)
    assert collections.Counter(map(tuple, got.collect())) == plain_search(rows)
    assert topk.every_twentieth(df.where("false")).count() == 0


def test_bounds_prune_and_hold():
    import pandas as pd

    rng = np.random.default_rng(1)
    smooth = np.cumsum(rng.normal(size=(3000, 64)), 1) * 3
    x = np.floor(smooth)
    pdf = pd.DataFrame({"rid": np.arange(3000), "vec_id": np.arange(3000), "body": [r.astype(np.float32).tobytes() for r in x]})
    got, seen = topk.search_block(pdf[:50], pdf, 64, 20)
    for s in topk.SEGMENTS:
        assert (topk.features(x[:50], s) @ topk.features(x, s).T >= x[:50] @ x.T - 1e-6).all()
    assert len(got) == 1000 and seen[0] >= seen[1] >= seen[2] == seen[3] and seen[3] < 0.6 * 50 * 3000
