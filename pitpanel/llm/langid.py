"""Language ID: nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors.

Documents become vectors of hashed byte trigrams over whole lower-cased texts (letters only, words
parted by one space), weighted by (1 + ln tf) * idf and normalised. Document frequencies count all
training documents. The centroids come from at most ``sample`` training documents per language (the
stated bound of the fit), clustered by spherical k-means. A document is rejected if its cosine to its
nearest centroid is under the limit of that centroid's language for texts of its length (in distinct
trigrams). Limits come from passages of many lengths out of training documents that were held out of
the centroids they are compared with (two folds).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import crc, settle, short_batches, text_batches

DIMS = 1 << 13
SAMPLE = 400        # training documents per language that the centroids are fitted on
CLUSTERS = 4
STARTS = 4          # random starts of the clustering
LEAST = 0.05        # the smallest share of a language's sample that a centroid stands for
LANGUAGES = 10_000  # languages whose counts are broadcast, at most; with more they are joined by shuffle
UNKNOWN = "und"
PASSAGES = 2        # passages of each length out of a training document that limits are set from
STEPS = 26          # length classes: half octaves of distinct trigrams
FEWEST = 30         # passages that a length class needs for a limit of its own; with fewer it has that of the next shorter
TAIL = 0.002        # a limit: the lower of this quantile of the held-out cosines and their geometric mean less SPREAD deviations (of logarithms)
SPREAD = 4.5        # at many documents; (1 + FEW / root of the documents) times as wide at few
FEW = 8

_KEEP = bytearray(b" " * 256)
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _KEEP[_b] = _b
    elif 65 <= _b <= 90:
        _KEEP[_b] = _b + 32
KEEP = bytes(_KEEP)


def counts(text: bytes, dims: int = DIMS, step: int = 1 << 20) -> np.ndarray:
    """Trigram counts of a whole text; a long text goes piece by piece."""
    clean = b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().translate(KEEP).split()) + b" "
    total = np.zeros(dims, np.int64)
    for i in range(0, max(len(clean) - 2, 0), step):
        b = np.frombuffer(clean[i:i + step + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(2654435761)
            total += np.bincount(h >> np.uint32(32 - int(np.log2(dims))), minlength=dims)
    return total


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass
class Model:
    """langs[i] is the language of row i of ``centroids`` (unit rows); ``limits`` its smallest accepted cosine by length class."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray

    def vector(self, text: bytes) -> np.ndarray:
        c = counts(text)
        v = np.zeros(len(c), np.float32)
        at = np.flatnonzero(c)
        v[at] = (1 + np.log(c[at])) * self.idf[at]
        return v / (np.linalg.norm(v) or 1.0)

    def rejects(self, x: np.ndarray, best: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Whether the texts of the rows of ``x``, nearest to the centroids ``best`` with cosine ``score``, are too far from them."""
        return score < self.limits[best, length_class(np.count_nonzero(x, axis=1))]


def length_class(distinct: np.ndarray) -> np.ndarray:
    return np.minimum(2 * np.log2(np.maximum(distinct, 1)), STEPS - 1).astype(int)


def passages(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """The whole text, and runs of words from random places, of half-octave lengths up to the text's."""
    words = text.decode("utf-8", "replace").lower().encode().translate(KEEP).split()
    ends = np.cumsum([len(w) + 1 for w in words])
    out = [text]
    for j in range(4, 2 * STEPS):
        n = int(2 ** (j / 2))
        if not len(ends) or n > ends[-1]:
            break
        for _ in range(PASSAGES):
            first = int(np.searchsorted(ends, rng.integers(ends[-1] - n + 1), "right"))
            out.append(b" ".join(words[first:int(np.searchsorted(ends, (ends[first - 1] if first else 0) + n)) + 1]))
    return out


def limits(model: Model, texts: list[bytes], x: np.ndarray, clusters: int) -> np.ndarray:
    """The smallest accepted cosine of every length class, from ``texts`` of one language with their vectors ``x``."""
    rng, cosines, classes = np.random.default_rng(7), [], []
    for fold in (0, 1):
        if not len(x[1 - fold::2]):
            break
        c = cluster(x[1 - fold::2], clusters)
        for t in texts[fold::2]:
            held = np.stack([model.vector(p) for p in passages(t, rng)])
            cosines.append((held @ c.T).max(1))
            classes.append(length_class(np.count_nonzero(held, axis=1)))
    low, least, spread = np.zeros(STEPS), 0.0, SPREAD * (1 + FEW / max(len(texts), 1) ** 0.5)
    if cosines:
        cosine, of = np.concatenate(cosines), np.concatenate(classes)
        for k in range(STEPS):
            got = cosine[of == k]
            if len(got) >= FEWEST:
                log = np.log(np.maximum(got, 0.01))                          # a share of the cosine, so short texts have limits too
                least = min(max(0.01, float(np.quantile(got, TAIL))), float(np.exp(log.mean() - spread * log.std())))
            low[k] = least
    return low


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every dimension over all training documents, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for _, texts in text_batches(batches, "text"):
            for t in texts:
                df += counts(t) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(DIMS), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], names=["dim", "n"])

    with short_batches(train.sparkSession):
        got = train.select("text").mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()   # DIMS + 1 rows
    found = {r.dim: r.n for r in got}
    return np.array([found.get(i, 0) for i in range(DIMS)], float), found.get(-1, 0)


def cluster(x: np.ndarray, k: int, rounds: int = 15, starts: int = STARTS, least: float = LEAST) -> np.ndarray:
    """Spherical k-means from seeded random rows, the start with the largest summed cosine.

    A cluster under ``least`` of the rows is started anew from a random row of the largest one while rounds are
    left, and given up at the end: every centroid returned is nearest to at least that share of the rows."""
    rng, best, kept = np.random.default_rng(11), -np.inf, None
    few = least * len(x)
    for _ in range(starts):
        c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for turn in range(rounds):
            near = (x @ c.T).argmax(1)
            size = np.bincount(near, minlength=len(c))
            crowd = np.flatnonzero(near == size.argmax())
            fresh = lambda j: x[rng.choice(crowd)] if size[j] < few and turn < rounds - 3 else c[j]
            c = np.stack([x[near == j].sum(0) if size[j] >= max(few, 1) else fresh(j) for j in range(len(c))])
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        while (size := np.bincount((x @ c.T).argmax(1), minlength=len(c))).min() < few:
            c = np.delete(c, size.argmin(), 0)
        if (total := (x @ c.T).max(1).sum()) > best:
            best, kept = total, c
    return kept


def _sample(train: DataFrame, size: int) -> DataFrame:
    """At most ``size`` different texts per language and task, those of the smallest hash; copies of a text are one."""

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for lang, part in batch.to_pandas().groupby("lang"):
                both = pd.concat([kept[lang], part] if lang in kept else [part])
                kept[lang] = both.drop_duplicates(["h", "text"]).nsmallest(size, "h")
        for part in kept.values():
            for start in range(0, len(part), 50):
                yield pa.RecordBatch.from_pandas(part.iloc[start:start + 50], preserve_index=False)

    n = settle(train.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")), "languages")
    # a hash threshold per language first, so a task sends its share and not ``size`` documents
    share = n.select("lang", F.least(F.lit(1.0), F.lit(1.5 * size) / F.col("texts")).alias("p"))
    share = F.broadcast(share) if n.count() <= LANGUAGES else share
    near = train.join(share, "lang").where("(h + 0.5) / 4294967296 < p").select("lang", "h", "text")
    return near.mapInArrow(lowest, "lang string, h long, text string")


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS, text: str = "text", lang: str = "lang") -> Model:
    """The model of labelled rows (text, lang); rows with a NULL text or lang, or no letter, teach nothing."""
    train = train.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    train = train.withColumn("h", F.crc32(F.concat_ws(":", F.xxhash64("text").cast("string"), F.lit("langid")).cast("binary")))
    df, n = _frequencies(train)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    base = Model([], idf, np.zeros((0, DIMS)), np.zeros((0, STEPS)))

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode() for t in pdf.sort_values(["h", "text"]).text.drop_duplicates().head(sample)]      # copies in both folds would not be held out
        texts = [t for t in texts if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centroid": [], "low": []})
        x = np.stack([base.vector(t) for t in texts])
        c, low = cluster(x, clusters), limits(base, texts, x, clusters)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]] * len(c), "centroid": [v.tolist() for v in c], "low": [low.tolist()] * len(c)})

    with short_batches(train.sparkSession):
        rows = _sample(train, sample).groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>, low array<double>").collect()  # languages x clusters
    rows = sorted(rows, key=lambda r: (r.lang, r.centroid))
    return Model([r.lang for r in rows], idf, np.array([r.centroid for r in rows], np.float32).reshape(-1, DIMS), np.array([r.low for r in rows], float).reshape(-1, STEPS))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected.

    A NULL text, a text without a letter, and every text where nothing was learned give ``und`` with
    score 0, rejected. Ties go to the first language in order."""
    sent = docs.sparkSession.sparkContext.broadcast(astuple(model))      # languages x clusters x DIMS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch, texts in text_batches(batches, "__text"):
            known = [bool(m.langs) and has_letter(t) for t in texts]
            x = np.stack([m.vector(t) if k else np.zeros(DIMS, np.float32) for t, k in zip(texts, known)])
            near = x @ m.centroids.T if m.langs else np.zeros((len(texts), 1))
            best = near.argmax(1)
            score = np.clip(near[np.arange(len(best)), best].astype(float), 0.0, 1.0)
            far = m.rejects(x, best, score) if m.langs else np.ones(len(best), bool)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(len(keep))),
                pa.array([m.langs[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                pa.array([float(s) if k else 0.0 for s, k in zip(score, known)], pa.float64()),
                pa.array([not k or bool(f) for f, k in zip(far, known)], pa.bool_()),
            ], names=[*keep, "lang_pred", "score", "rejected"])

    cols = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema[:len(keep)]), "lang_pred string, score double, rejected boolean"])
    return cols.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """A NULL doc_id is not held out."""
    return F.coalesce(F.pmod(crc(doc_id), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row, learned from the rows not held out.

    Repeated rows stay repeated; no rows give no rows; extra columns are ignored."""
    model = fit(docs.where(~held_out(doc_id)), text=text, lang=lang)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("__in"))
    return predict(rows, model, ["doc_id", "held_out"], "__in")


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, whatever their names.

    A NULL text, a text without a letter, and every row where nothing was learned are rejected; a NULL doc_id or
    lang rejects nothing. Repeated rows stay repeated; no rows give no rows."""
    model = fit(docs.where(~held_out(doc_id)), text=text, lang=lang)
    sent = docs.sparkSession.sparkContext.broadcast(astuple(model))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch, texts in text_batches(batches, text):
            keep = []
            for t in texts:
                ok = bool(m.langs) and has_letter(t)
                if ok:
                    x = m.vector(t)[None]
                    near = x @ m.centroids.T
                    ok = not m.rejects(x, near.argmax(1), np.clip(near.max(1).astype(float), 0.0, 1.0))[0]
                keep.append(ok)
            part = batch.filter(pa.array(keep, pa.bool_()))
            if part.num_rows:
                yield part

    return docs.select(*names).mapInArrow(run, docs.schema)
