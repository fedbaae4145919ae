"""Operators on documents against brute force, with odd rows and empty tables."""

import collections
import hashlib
import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import ODD, empty, odd, reach  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pitpanel.llm import exactdedup, langid, langmodel, licenses, mixing, packing, simhash  # noqa: E402
from pitpanel.llm.common import components, tokenizer_file  # noqa: E402

SMALL = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SMALL)


@pytest.fixture(scope="module")
def rows(docs):
    return sorted([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


# -- SimHash ------------------------------------------------------------------------------------

def plain_fingerprint(t):
    w = words(t)
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(texts):
    f = np.array([plain_fingerprint(t) for t in texts], np.uint64)
    return f, np.bitwise_count(f[:, None] ^ f[None, :]) <= 2


@pytest.mark.parametrize("limit", [256, 1])
def test_simhash(spark, rows, docs, limit):
    f, links = near([r[1] for r in rows])
    low = reach(links)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, limit=limit).collect()}
    assert [got[r[0]].fingerprint for r in rows] == [f"{int(x):016x}" for x in f]
    assert [got[r[0]].component_id for r in rows] == [rows[i][0] for i in low]
    assert sum(r.kept for r in got.values()) == len(set(low))


def test_simhash_long_postings_lose_no_link(spark):
    """Fingerprints around one centre: every posting is long, and is paired by finer postings."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)}
    fps = np.array(sorted(fps), np.uint64).astype(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    u = fps.astype(np.uint64)
    low = reach(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2)
    groups = collections.Counter(low.tolist())
    got = {r.node: r.root for r in components(simhash.links(df, 4)).collect()}
    assert sorted(collections.Counter(got.get(int(x), int(x)) for x in fps).values()) == sorted(groups.values())


def test_simhash_odd(spark):
    df = odd(spark)
    got = simhash.near_duplicates(df)
    assert got.count() == len(ODD) and simhash.near_duplicates(empty(df)).count() == 0
    zero = [r for r in got.collect() if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {3, 4, 5} and {r.component_id for r in zero} == {3} and sum(r.kept for r in zero) == 1
    assert sum(r.kept for r in got.where("doc_id = 2 OR doc_id = 1").collect()) == 1


# -- exact duplicates ---------------------------------------------------------------------------

def check_exact(table, got):
    groups = collections.defaultdict(list)
    for r in table:
        groups[(r[1] or "").encode().lower()].append(r[0])
    assert len(got) == len(table)
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for text, ids in groups.items():
        own = by.pop(hashlib.sha256(text).hexdigest())
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in own)
        assert all(r.keep_id == keep and r.group_size == len(ids) for r in own) and sum(r.kept for r in own) == 1
        assert all(r.doc_id == keep for r in own if r.kept)
    assert not by


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact(rows, docs, digest_bytes):
    """One-byte digests collide, so texts are told apart by their bytes alone."""
    check_exact(rows, exactdedup.duplicates(docs, exactdedup.by_age(), digest_bytes=digest_bytes, bucket_keys=50).collect())


def test_exact_odd(spark):
    df = odd(spark)
    for snapshot in (exactdedup.by_age(), F.lit(None), F.lit(1)):
        check_exact(ODD, exactdedup.duplicates(df, snapshot).collect())
    assert exactdedup.duplicates(empty(df), exactdedup.by_age()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 57, 5000, 60000])
def test_filter_has_no_false_negative_and_few_false_positives(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    made = exactdedup.build_filter(keys)
    assert exactdedup.screen(keys, *made).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 50000).astype(np.uint64)
    assert exactdedup.screen(others, *made).mean() < 0.001


# -- language ID --------------------------------------------------------------------------------

def test_rows_are_named_beside_a_column_called_metadata(spark, tmp_path):
    from pitpanel.llm.common import RID, by_names, named_rows

    spark.range(20).selectExpr("id", "id * 2 AS _metadata").repartition(3).write.parquet(str(tmp_path / "t"))
    for df in (spark.read.parquet(str(tmp_path / "t")), spark.range(20).selectExpr("id", "id * 2 AS _metadata"), spark.range(20).selectExpr("id", "named_struct('file_path', 'x', 'row_index', 1L) AS _metadata")):
        named = named_rows(df)
        assert named.select(RID).distinct().count() == 20
        kept = by_names(named, named.where("id % 3 = 0").select(RID), "left_semi")
        assert kept.columns == ["id", "_metadata"] and sorted(r.id for r in kept.collect()) == list(range(0, 20, 3))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) / len(got) < 0.005


def test_language_centroids_stand_for_shares():
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    middle = np.eye(4, 12)
    x = unit(np.concatenate([middle[rng.integers(0, 4, 300)], np.eye(12)[8:]]) + 0.05 * rng.normal(size=(304, 12)))     # four topics, four outliers
    c = langid.cluster(x, 4)
    size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    assert len(c) == 4 and size.min() >= langid.LEAST * len(x) and ((c @ middle.T).max(1) > 0.98).all()
    assert len(langid.cluster(x[:1], 4)) == 1 and 1 <= len(langid.cluster(np.repeat(x[:1], 9, 0), 4)) <= 4


def test_language_score_by_hand(spark):
    """Cosines from trigrams counted one by one in Python numbers."""
    docs = spark.read.parquet(SMALL)
    model = langid.fit(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    for r in docs.where("length(text) < 3000").orderBy("doc_id").limit(25).collect():
        words = re.findall(rb"[a-z\x80-\xff]+", r.text.lower().encode())
        clean, tally = b" " + b" ".join(words) + b" ", collections.Counter()
        for i in range(len(clean) - 2):
            tally[((clean[i] * 65536 + clean[i + 1] * 256 + clean[i + 2]) * 2654435761 % 2**32) >> 19] += 1
        weight = {d: (1 + math.log(n)) * float(model.idf[d]) for d, n in tally.items()}
        norm = math.sqrt(sum(v * v for v in weight.values())) or 1.0
        cosines = [sum(v * float(c[d]) for d, v in weight.items()) / norm for c in model.centroids]
        if words:
            assert got[r.doc_id].score == pytest.approx(max(cosines), abs=1e-5) and got[r.doc_id].lang_pred == model.langs[int(np.argmax(cosines))]


def test_language_sample_counts_copies_once(spark):
    base = spark.range(300).selectExpr("'en' AS lang", "crc32(concat('the text number ', id)) AS h", "concat('the text number ', id) AS text")
    hot = base.orderBy("h").limit(1).crossJoin(spark.range(2000)).drop("id")
    got = langid._sample(base.unionByName(hot).repartition(3), 50).toPandas()
    assert got.text.nunique() >= 50 and set(base.orderBy("h").limit(50).toPandas().text) <= set(got.text)


def test_language_rejects_what_is_far_and_handles_odd_rows(spark, docs):
    model = langid.fit(docs)
    df = spark.createDataFrame([(1, "Ελληνικά γράμματα και λέξεις εδώ"), (2, None), (3, "123 ..."), (4, "the of and with that which")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(df, model, ["doc_id"]).collect()}
    assert got[1].rejected and got[2].lang_pred == got[3].lang_pred == "und" and not got[4].rejected
    out = langid.identify(odd(spark)).collect()
    assert len(out) == len(ODD) and all((r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 6)) for r in out)
    assert langid.identify(empty(odd(spark))).count() == 0
    assert langid.accepted(odd(spark)).columns == odd(spark).columns


@pytest.mark.parametrize("out", ["de", "fr"])
def test_language_left_out_of_the_fit_is_rejected(spark, out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()).where(f"lang <> '{out}'"))
    got = langid.predict(docs.withColumn("held_out", langid.held_out()), model, ["lang", "held_out"]).toPandas()
    strange, clean = got[got.lang == out], got[(got.lang != out) & got.held_out]
    assert strange.rejected.mean() > 0.8 and clean.rejected.mean() < 0.01


def test_letters_at_random_are_rejected(spark, docs):
    rng = np.random.default_rng(3)
    noise = [(i, " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60))) for i in range(20)]
    got = langid.predict(spark.createDataFrame(noise, "doc_id long, text string"), langid.fit(docs), ["doc_id"]).collect()
    assert all(r.rejected for r in got)


# -- packing ------------------------------------------------------------------------------------

def check_packing(table, got, capacity=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = collections.Counter()
    for doc, text, *_ in table:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want[doc, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), -(-sum(r.length for r in got) // capacity)


def test_packing(rows, docs):
    used, least = check_packing(rows, packing.sequences(docs, tokenizer_file("word_bpe_49k.json")).collect())
    assert used <= least + 1
    used, least = check_packing(rows, packing.sequences(docs, tokenizer_file("word_bpe_49k.json"), group=40).collect())
    assert used <= least + 2


def test_packing_odd(spark):
    df = odd(spark)
    check_packing(ODD, packing.sequences(df, tokenizer_file("word_bpe_49k.json")).collect())
    assert packing.sequences(empty(df), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_local_search_empties_a_bin_that_best_fit_leaves():
    lengths = [6, 6, 4, 4, 4, 3, 3]                      # 30 = 3 bins of 10, by exchanges only
    start = [[0, 5], [1, 6], [2, 3], [4]]
    done = packing.local_search(start, lengths, 10)
    assert sorted(i for b in done for i in b) == list(range(7)) and all(sum(lengths[i] for i in b) <= 10 for b in done)
    assert len(done) == 3
    best = packing.pack([5] * 7 + [3, 2] * 3, 10)
    assert len(best) == 5


def test_local_search_looks_at_all_underfull_bins():
    lengths = [2058] * 600 + [1044] * 600 + [1034] * 600 + [1004] * 1200                 # 900 sequences of 4096 hold them
    start = packing.best_fit(lengths, 4096)
    done = packing.local_search(start, lengths, 4096)
    assert sorted(i for b in done for i in b) == list(range(3000)) and all(sum(lengths[i] for i in b) <= 4096 for b in done)
    assert len(start) == 1100 and len(done) < 1000


# -- licences -----------------------------------------------------------------------------------

def plain_license(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark, rows, docs):
    for df, table in ((docs, rows), (odd(spark), ODD)):
        got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect())
        assert got == collections.Counter((r[0], *plain_license(r[1])) for r in table)
    assert licenses.scan(empty(docs)).count() == 0


def test_license_templates_are_found_in_place(spark):
    bodies = [(i, f"Some prose first. {t[1]} and more after it", t[0]) for i, t in enumerate(licenses.TEMPLATES)]
    df = spark.createDataFrame([(i, t) for i, t, _ in bodies] + [(99, "bring the permission and the software free of charge to the source")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, _, label in bodies:
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    assert got[99].labels == "" and got[99].score == 0.0


# -- language model -----------------------------------------------------------------------------

def test_language_model(rows, docs):
    got = {r.doc_id: r for r in langmodel.score(docs, head=2000).collect()}
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    counts = collections.Counter(w for r in rows if not held[r[0]] for w in words(r[1]) + [b""])
    n, v = sum(counts.values()), len(counts)
    for doc, text, *_ in rows:
        w = words(text) + [b""]
        r = got[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[doc], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_is_normalised(docs):
    vocabulary, params, counts = langmodel.fit(docs.select("text"), rounds=1, head=1500)
    a1, a2, z = langmodel.tables(params)
    for w2, w1 in ((langmodel.START, langmodel.START), (3, 5), (0, langmodel.SYMBOLS + 2)):
        assert abs(np.exp(a1[w1] + a2[w2] - z[w1, w2]).sum() - 1) < 1e-9
    v = langmodel.Vocabulary(*vocabulary.value)
    inside = collections.defaultdict(float)
    known = {w for w, s in zip(v.words, v.symbol) if s < langmodel.SYMBOLS}
    for r in counts.collect():
        w = r.word.encode()
        if w not in known and w:
            inside[langmodel.ending(w)] += (r.n + 1) / 10 ** v.class_log[langmodel.ending(w)]
    assert all(p < 1 + 1e-9 for p in inside.values())


def test_language_model_odd(spark):
    df = odd(spark)
    got = langmodel.score(df).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert langmodel.score(empty(df)).count() == 0


# -- mixture ------------------------------------------------------------------------------------

def test_mixture_fills_siblings_before_ancestors(spark):
    df = spark.createDataFrame([("web", "en", "a", 10, 1), ("web", "en", "b", 1000, 9), ("web", "fr", "c", 1000, 9), ("books", "en", "d", 50, 3)],
                               "domain string, lang string, source string, tokens long, docs long")
    got = {r.source: r.budget for r in mixing.budgets(df, 1000, 1, {"web": 1, "books": 1}, {"en": 1, "fr": 1}, {}).collect()}
    # books can give 50 of 500, web takes the rest; in web half to each language; a gives 10, its sibling b the rest
    assert got == {"d": 50, "a": 10, "b": 465, "c": 475}


def test_mixture_streams(spark, docs):
    got = mixing.select(docs, budget=20000, epochs=3).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.domain, r.lang, r.source].append(r)
    assert sum(r.take_tokens for r in got) == 20000
    for leaf in by.values():
        at = 0
        for r in sorted(leaf, key=lambda r: r.start_token):
            assert r.start_token == at and 0 < r.take_tokens <= r.n_tokens
            at += r.take_tokens
        assert sum(r.take_tokens < r.n_tokens for r in leaf) <= 1


def test_mixture_odd(spark):
    got = mixing.select(odd(spark)).collect()
    assert {r.doc_id for r in got}.isdisjoint({3, 4, 5}) and None in {r.doc_id for r in got}
    assert mixing.select(empty(odd(spark))).count() == 0


@pytest.mark.parametrize("finish", [0, 100_000])
def test_components(spark, finish):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, 220), rng.integers(0, 300, 220)
    chain = [(1000 + i, 1001 + i) for i in range(120)]
    star = [(5000, 5001 + i) for i in range(400)]
    pairs = [(int(x), int(y)) for x, y in zip(a, b)] + chain + star
    nodes = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    links = np.eye(len(nodes), dtype=bool)
    for x, y in pairs:
        links[at[x], at[y]] = links[at[y], at[x]] = True
    low = reach(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7), finish=finish).collect()}
    assert all(got.get(x, x) == nodes[low[i]] for i, x in enumerate(nodes))


def test_words_of_slices():
    """Tokens, ends and contexts of slices of a batch, against plain splitting."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(list("aBcé😀ß \t\n\x0b\x0c\x1c\x85\xa0ÀK"), rng.integers(0, 60))) for _ in range(400)]
    column = pa.array(texts)
    for start, stop in ((0, 400), (7, 8), (100, 400), (399, 400), (5, 5)):
        w = langmodel.Words(column.slice(start, stop - start))
        names = [*w.distinct.cast(pa.large_binary()).to_pylist(), b""]
        want = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""] for t in texts[start:stop]]
        assert [[names[t] for t in w.tokens[s:s + n]] for s, n in zip(w.starts, w.sizes)] == want
        w2, w1 = w.before(w.tokens, -1)
        flat = [t for s, n in zip(w.starts, w.sizes) for t in zip([-1, -1, *w.tokens[s:s + n]], [-1, *w.tokens[s:s + n]], w.tokens[s:s + n])]
        assert [(int(a), int(b), int(c)) for a, b, c in flat] == list(zip(w2.tolist(), w1.tolist(), w.tokens.tolist()))
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    parts = list(langmodel.parts_of(iter([batch, batch.slice(50, 100)]), "text", 500))
    assert sum(p.num_rows for p, _ in parts) == 500 and len(parts) > 10
    got = [names for p, w in parts for s, n in zip(w.starts, w.sizes) for names in [[*w.distinct.cast(pa.large_binary()).to_pylist(), b""]] for names in [[names[t] for t in w.tokens[s:s + n]]]]
    assert got == [[*(t or "").encode().lower().split(), b""] for t in [*texts, *texts[50:150]]]
