"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

The model predicts a symbol from the two before it: the context is r[w1] * c1 + r[w2] * c2, a symbol's
score its product with q[symbol] plus a bias. Symbols are the most frequent words, the end of a text,
and classes of the other words by their ending; inside a class a word has its smoothed frequency. Each
task trains on its documents in numpy and the parameters are averaged, for a few rounds over all
training documents. As scores are sums over the two context places, the normaliser of every context is
one matrix product, exp(A1) @ exp(A2).T, so log-probabilities are exact.

All words are counted. Counts of the most frequent ``HEAD`` words travel to the tasks; tokens beyond
them meet their counts in a shuffle join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import crc, settle

HEAD = 1 << 18        # words whose counts are broadcast, at most
SYMBOLS = 960         # words (and the end) that are symbols of their own
CLASSES = 64          # classes of the other words
DIM = 16
NOISE, SAMPLES = 20, 32      # noise per word in the objective, and shared draws per batch that stand for it
BATCH = 4096
ROUNDS = 2
RATE = 0.1
END = b""             # no word is empty


def ending(word: bytes) -> int:
    return zlib.crc32(word.decode("utf-8", "replace")[-2:].encode()) % CLASSES


class Words:
    """The words of some rows' texts and an end after each: distinct words, and every token as a number among them."""

    def __init__(self, texts: pa.Array):
        texts = pa.concat_arrays([texts, pa.array([None], texts.type)]).fill_null("").cast(pa.large_string())[:-1]      # a copy: functions misread the offsets of a slice
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets))
        there = np.asarray(pc.not_equal(flat, ""), bool)                  # white space at the ends leaves empty pieces
        row = np.repeat(np.arange(len(sizes)), sizes)[there]
        codes = flat.filter(pa.array(there)).dictionary_encode() if len(flat) else pa.array([], pa.large_string()).dictionary_encode()
        self.distinct = codes.dictionary
        self.sizes = np.bincount(row, minlength=len(sizes)) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.full(int(self.sizes.sum()), len(self.distinct), np.int64)          # the end: one beyond the distinct words
        self.tokens[np.arange(len(row)) + row] = np.asarray(codes.indices)

    def before(self, symbols: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols two and one before every token of its text."""
        out = []
        for back in (2, 1):
            x = np.concatenate([np.full(back, start, symbols.dtype), symbols])[:len(symbols)]
            for first in range(back):
                at = self.starts + first
                x[at[at < len(x)]] = start
            out.append(x)
        return out[0], out[1]


def parts_of(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Rows of about ``size`` bytes of text at a time: looking words up costs a pass over the head each time."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        part = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start), Words(texts.slice(start, stop - start))


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts: counts of some texts at a time, summed before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in parts_of(batches, "text"):
            n = np.bincount(words.tokens, minlength=len(words.distinct) + 1)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.distinct.cast(pa.string()), pa.array([""])]), pa.array(n, pa.int64())], names=["word", "n"])

    return train.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of the head words, the symbols among them, and the classes of the others."""

    def __init__(self, head: dict[bytes, int], least: int, total: int, distinct: int, class_n: list[int], class_v: list[int]):
        top = sorted((w for w in head if w != END), key=lambda w: (-head[w], w))[:SYMBOLS - 1]
        self.least, self.total, self.distinct = least, total, distinct
        symbol = {w: i for i, w in enumerate([END, *top])}
        self.words = list(head)
        self.array = pa.array(self.words, pa.large_binary()).cast(pa.large_string())
        n = np.array(list(head.values()), float) if head else np.zeros(0)
        self.log_count = np.log10(n + 1)
        self.symbol = np.array([symbol.get(w, SYMBOLS + ending(w)) for w in head], np.int32)
        class_n, class_v = np.array(class_n, float), np.array(class_v, float)
        for w in symbol:
            if w in head:
                class_n[ending(w)] -= head[w]
                class_v[ending(w)] -= 1
        self.class_log = np.log10(class_n + class_v + 1)
        own = np.zeros(SYMBOLS + CLASSES)
        for w, s in symbol.items():
            own[s] = head.get(w, 0)
        own[SYMBOLS:] = class_n
        self.noise = (own + 0.5) / (own.sum() + 0.5 * len(own))

    def symbols(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of every word, and of the end after them, the place in the head (-1: none) and the symbol."""
        both = pa.concat_arrays([words, pa.array([""], words.type)])
        at = np.asarray(pc.index_in(both, value_set=self.array).fill_null(-1), np.int64)
        sym = self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int32)
        beyond = np.flatnonzero(at < 0)
        if len(beyond):
            tails = pc.utf8_slice_codeunits(both.take(pa.array(beyond)), -2).dictionary_encode()
            sym[beyond] = SYMBOLS + np.array([ending(t.encode()) for t in tails.dictionary.to_pylist()], np.int32)[np.asarray(tails.indices)]
        sym[-1] = 0
        return at, sym


K = SYMBOLS + CLASSES
START = K            # before a text's first word
SHAPES = [(K + 1, DIM), (K, DIM), (K,), (DIM,), (DIM,)]


def initial(noise: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Small random vectors and the unigram as bias: the untrained model is the unigram."""
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.1, SHAPES[0]), rng.normal(0, 0.1, SHAPES[1]), np.log(noise), np.ones(DIM), np.full(DIM, 0.5)]


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in SHAPES:
        size = int(np.prod(shape))
        out.append(flat[at:at + size].reshape(shape))
        at += size
    return out


def _add(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by row number."""
    d = values.shape[1]
    return np.bincount((rows[:, None] * d + np.arange(d)).ravel(), values.ravel(), n * d).reshape(n, d)


class Trainer:
    """Noise-contrastive steps with AdaGrad on batches of (two before, one before, word)."""

    def __init__(self, params: list[np.ndarray], noise: np.ndarray, seed: int):
        self.p = [x.astype(np.float32) for x in params]             # single precision: steps are small against the noise
        self.g = [np.full(x.shape, 1e-6, np.float32) for x in self.p]
        self.log_noise, self.cum = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise)
        self.rng, self.seen = np.random.default_rng(seed), 0

    def step(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> None:
        r, q, b, c1, c2 = self.p
        drawn = np.minimum(np.searchsorted(self.cum, self.rng.random(SAMPLES)), K - 1)
        r1, r2, qw, qn = r.take(w1, 0), r.take(w2, 0), q.take(w, 0), q[drawn]
        h = r1 * c1
        h += r2 * c2
        good = np.einsum("ij,ij->i", h, qw)
        good += (b - self.log_noise)[w]
        good = 1 / (1 + np.exp(-good)) - 1
        bad = h @ np.ascontiguousarray(qn.T)
        bad += (b - self.log_noise)[drawn]
        np.negative(bad, bad)
        np.exp(bad, bad)
        bad += 1
        np.divide(np.float32(NOISE / SAMPLES), bad, bad)
        qw *= good[:, None]
        dh = bad @ qn
        dh += qw
        dq = _add(w, h * good[:, None], K)
        np.add.at(dq, drawn, bad.T @ h)
        db = np.bincount(w, good, K) + np.bincount(drawn, bad.sum(0), K)
        dr = _add(w1, dh * c1, K + 1) + _add(w2, dh * c2, K + 1)
        for x, s, d in zip(self.p, self.g, (dr, dq, db, np.einsum("ij,ij->j", dh, r1), np.einsum("ij,ij->j", dh, r2))):
            d = (d / len(w)).astype(np.float32)
            s += d * d
            x -= np.float32(RATE) * d / np.sqrt(s)
        self.seen += len(w)


def train_round(train: DataFrame, vocabulary, params: np.ndarray, number: int) -> np.ndarray:
    """Every task trains from the same parameters on all its documents; the average by words seen comes back."""
    sent = train.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*vocabulary.value)
        model = Trainer(unpack(sent.value), v.noise, 1000 * number + TaskContext.get().partitionId())
        stock, have = [], 0

        def use(least: int) -> None:
            nonlocal stock, have
            if have < least or not have:
                return
            x = np.concatenate(stock, axis=1)
            at = 0
            while x.shape[1] - at >= max(least, 1):
                part = x[:, at:at + BATCH]
                model.step(part[0], part[1], part[2])
                at += part.shape[1]
            stock, have = [x[:, at:]], x.shape[1] - at

        for _, words in parts_of(batches, "text"):
            s = v.symbols(words.distinct)[1][words.tokens]
            stock.append(np.stack([*words.before(s, START), s]))
            have += len(s)
            use(BATCH)
        use(1)
        flat = np.concatenate([x.ravel() for x in model.p]).astype(np.float64) * model.seen
        yield pa.RecordBatch.from_arrays([pa.array([[*flat, float(model.seen)]], pa.list_(pa.float64()))], names=["x"])

    sums = (train.select("text").mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("at", "x"))
            .groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at").x.to_numpy())        # one number per parameter
    return sums[:-1] / sums[-1] if len(sums) and sums[-1] else params


def tables(params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A1, A2, Z): the natural log-probability of w after (w2, w1) is A1[w1, w] + A2[w2, w] - Z[w1, w2]."""
    r, q, b, c1, c2 = unpack(params)
    a1, a2 = (r * c1) @ q.T + b, (r * c2) @ q.T
    m1, m2 = a1.max(1, keepdims=True), a2.max(1, keepdims=True)
    return a1, a2, np.log(np.exp(a1 - m1) @ np.exp(a2 - m2).T) + m1 + m2.T


def fit(train: DataFrame, rounds: int = ROUNDS, head: int = HEAD):
    """Vocabulary (broadcast), parameters and the settled counts of all words of ``train`` (text)."""
    counts = settle(count_words(train), "word-counts")
    step = F.floor(F.log2("n") * 8).cast("int")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, room = 1, head
    for row in counts.groupBy(step.alias("k")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("k")).collect():   # some hundred rows
        room -= row.words
        if room < 0:
            break
        least = row.n
    if room < 0 and room + row.words == head:
        least = row.n + (1 << 62)
    top = {r.word.encode(): r.n for r in counts.where((F.col("n") >= least) | (F.col("word") == "")).toLocalIterator()}                  # ``head`` rows at most
    found = {r.c: r for r in counts.groupBy(F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(CLASSES)).cast("int").alias("c"))
             .agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    vocabulary = train.sparkSession.sparkContext.broadcast((top, least, total, distinct, [found[c].n if c in found else 0 for c in range(CLASSES)],
                                                            [found[c].v if c in found else 0 for c in range(CLASSES)]))
    params = np.concatenate([x.ravel() for x in initial(Vocabulary(*vocabulary.value).noise)])
    for number in range(rounds):
        params = train_round(train, vocabulary, params, number)
    return vocabulary, params, counts


def held_out(doc_id: str = "doc_id") -> Column:
    """A NULL doc_id is not held out."""
    return F.coalesce(F.pmod(crc(doc_id), F.lit(7)) == 2, F.lit(False))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Scores are sums of log10 probabilities over a text's words and its end. NULL and empty texts are one
    end. Repeated rows stay repeated and teach as often; a NULL doc_id stays NULL and teaches. Without
    training documents every word is unknown. No rows give no rows; other columns are ignored."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    vocabulary, params, counts = fit(rows.where("NOT held_out"), rounds, head)
    sent = docs.sparkSession.sparkContext.broadcast(params)
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*vocabulary.value)
        a1, a2, z = tables(sent.value)
        row, ln10, everything = TaskContext.get().partitionId() << 40, np.log(10), np.log10(v.total + v.distinct + 1)
        for part, words in parts_of(batches, "text"):
            head, sym = v.symbols(words.distinct)
            at, w = head[words.tokens], sym[words.tokens]
            w2, w1 = words.before(w, START)
            freq = np.where(head >= 0, v.log_count[head], 0.0)[words.tokens] if len(v.log_count) else np.zeros(len(w))
            inside = w >= SYMBOLS
            value = (a1[w1, w] + a2[w2, w] - z[w1, w2]) / ln10
            value[inside] += freq[inside] - v.class_log[w[inside] - SYMBOLS]
            per_row = lambda x: np.add.reduceat(x, words.starts)
            base, model, known = per_row(freq) - words.sizes * everything, per_row(value), per_row((at >= 0).astype(np.int64))
            rare: dict[int, Counter] = {}
            beyond = np.flatnonzero((at < 0) & (words.tokens < len(words.distinct)))
            for i, t in zip((np.searchsorted(words.starts, beyond, "right") - 1).tolist(), words.distinct.take(pa.array(words.tokens[beyond])).to_pylist()):
                rare.setdefault(i, Counter())[t] += 1
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(part.num_rows), pa.int64()), part.column(0), part.column(1), pa.array(words.sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(model),
                pa.array([[{"word": k, "n": n} for k, n in rare.get(i, {}).items()] for i in range(part.num_rows)], kind)],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])
            row += part.num_rows

    scored = settle(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
                                    "rare array<struct<word: string, n: bigint>>"), "scored")
    # tokens beyond the head meet their counts; a word never seen in training adds log10(0 + 1) = 0
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(
        counts.where(F.col("n") < vocabulary.value[1]).withColumnRenamed("n", "c"), "word")
    more = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
                       F.col("n").alias("n_known"), (F.col("n") * F.log10(F.col("c") + 1)).alias("base_score")).withColumn("score", F.col("base_score"))
    both = scored.drop("rare").unionByName(more).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return both.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(vocabulary.value[2])).cast("long").alias("train_tokens"), "base_score", "score")
