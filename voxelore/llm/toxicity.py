"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct terms i of a text: its words and the leading 4 and 5
bytes of longer words, each hashed to HASH_BITS bits. The pair term learns interactions that additive weights miss.

The model is fitted on a bounded sample of labelled rows, TOXIC_ROWS toxic and CLEAN_ROWS clean ones at most, taken in the
order of a hash of the id. All terms of at least three of its documents are kept, as a term that tells nothing alone may do
so in a pair; only beyond MOST_TERMS the ones that differ least between the classes go. A term's value is the square of its
gap, cut to [LEAST_VALUE, 1] as parts of FULL_GAP, so that many neutral terms don't drown the telling ones. The sample's intercept is corrected
to the labels' true share. The steps are taken in one task on an executor; the driver holds the terms and the weights.

Defined cases: a null text is the empty text, which gets the intercept's score. Null labels and ids without a text teach
nothing. If the labels lack a class, all scores are the share of toxic labels (0 without labels). Repeated ids are scored
row by row; an id labelled twice is taken as toxic if any label says so. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from voxelore.llm.store import written
from voxelore.llm.text import in_fold

HASH_BITS = 40
#: Bounds of the fitting sample and of the model.
TOXIC_ROWS, CLEAN_ROWS, MOST_TERMS = 8_000, 12_000, 1 << 20
FACTORS, EPOCHS, BATCH, SEED = 4, 20, 256, 7
LEAST_VALUE, FULL_GAP = 0.3, 4.0
MEMO = 300_000
_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def _hash(term: bytes) -> int:
    return xxh3_64_intdigest(term) & ((1 << HASH_BITS) - 1)


def word_terms(word: bytes) -> list[int]:
    """Hashed terms of a word: the word, and its leading 4 and 5 bytes if it is longer."""
    return [_hash(b"w" + word)] + [_hash(b"p%d" % n + word[:n]) for n in (4, 5) if len(word) > n]


@dataclass
class Model:
    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def rows(self) -> dict[int, int]:
        return {int(t): k for k, t in enumerate(self.terms)}

    def score(self, rows: np.ndarray) -> float:
        v = self.v[rows]
        z = self.w0 + self.w[rows].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class Finder:
    """The model's rows that a text activates. Words seen before are remembered, up to a bound."""

    def __init__(self, rows: dict[int, int]):
        self.known, self.memo = rows, {}

    def _word(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.known[t] for t in word_terms(word) if t in self.known)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        get, own, hit = self.memo.get, self._word, []
        for w in set(words(text)):
            r = get(w)
            if r is None:
                r = own(w)
            if r:
                hit += r
        return np.unique(np.array(hit, np.int64))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic documents, clean documents) of each batch."""
    for batch in batches:
        parts: dict[int, list[np.ndarray]] = {0: [], 1: []}
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {t for w in set(words(text or "")) for t in word_terms(w)}
            parts[toxic].append(np.fromiter(own, np.int64, len(own)))
        both = [np.concatenate([np.array([], np.int64), *parts[k]]) for k in (1, 0)]
        terms = np.unique(np.concatenate(both))
        counts = [np.bincount(np.searchsorted(terms, x), minlength=len(terms)) for x in both]
        yield pa.RecordBatch.from_arrays([pa.array(terms), *(pa.array(c.astype(np.int64)) for c in counts)], ["term", "toxic", "clean"])


def _active(terms: np.ndarray):
    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder({int(t): k for k, t in enumerate(terms)})
        for batch in batches:
            rows = [find(t or "").astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["toxic", "rows"])

    return active


def fit(rows: list[np.ndarray], labels: np.ndarray, x: np.ndarray, share: float, l2: float = 1e-4, rate: float = 0.3) -> tuple[float, np.ndarray, np.ndarray]:
    """AdaGrad on the logistic loss in batches; x: the value of each term, which the weights given back contain; share: the
    true share of label 1, to which the intercept is corrected."""
    n_terms = len(x)
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, FACTORS))
    gw, gv = np.full(n_terms, 1e-2), np.full((n_terms, FACTORS), 1e-2)
    w0, g0 = float(np.log(max(labels.mean(), 1e-6) / max(1 - labels.mean(), 1e-6))), 1e-2
    used, local = np.zeros(n_terms, bool), np.zeros(n_terms, np.int64)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            size = np.array([len(rows[k]) for k in some])
            idx, doc = np.concatenate([rows[k] for k in some]).astype(np.int64), np.repeat(np.arange(len(some)), size)
            y, xi = labels[some], x[idx]
            vi = v[idx] * xi[:, None]
            total = np.stack([np.bincount(doc, vi[:, f], len(some)) for f in range(FACTORS)], axis=1)
            z = w0 + np.bincount(doc, w[idx] * xi, len(some)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(doc, (vi * vi).sum(axis=1), len(some)))
            err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(some)
            used[idx] = True
            hit = np.flatnonzero(used)
            used[hit], local[hit] = False, np.arange(len(hit))
            place = local[idx]
            dw = np.bincount(place, err[doc] * xi, len(hit)) + l2 * w[hit]
            pull = (err[doc] * xi)[:, None] * (total[doc] - vi)
            dv = np.stack([np.bincount(place, pull[:, f], len(hit)) for f in range(FACTORS)], axis=1) + l2 * v[hit]
            d0 = err.sum()
            g0 += d0 * d0
            gw[hit] += dw * dw
            gv[hit] += dv * dv
            w0 -= rate * d0 / g0**0.5
            w[hit] -= rate * dw / gw[hit] ** 0.5
            v[hit] -= rate * dv / gv[hit] ** 0.5
    own = labels.mean()
    return w0 + float(np.log(share / (1 - share)) - np.log(own / (1 - own))), w * x, v * x[:, None]


def _fit_rows(x: np.ndarray, share: float):
    """The intercept, the weights and the factors, one after another, fitted in one task on the rows of terms."""

    def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        got.sort()  # the order of the rows must not depend on partitions
        w0, w, v = fit([np.frombuffer(r, "<i4") for _, r in got], np.array([k for k, _ in got], float), x, share)
        flat = np.concatenate([[w0], w, v.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "value"])

    return fit_rows


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model:
    """Fit on the labelled rows outside fold 0."""
    none = np.array([], np.int64)
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    lab = lab.where(in_fold(F.col("id"), folds) != 0).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, n_toxic = lab.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        share = n_toxic / n if n else 0.0
        return Model(none, 60.0 if share else -60.0, np.zeros(0), np.zeros((0, FACTORS)))
    # Bounded by TOXIC_ROWS + CLEAN_ROWS, hence the broadcast.
    some = [lab.where(F.col("toxic") == k).orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(m) for k, m in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    some = written(some[0].unionByName(some[1]), "toxicity-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = written(texts.join(F.broadcast(some), "id").select("toxic", "text"), "toxicity-texts")
    counted = sample.mapInArrow(_count_terms, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    sizes = dict(sample.groupBy("toxic").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(none, 60.0 if n1 else -60.0, np.zeros(0), np.zeros((0, FACTORS)))
    pooled = (F.col("t") + F.col("c")) / (n1 + n0)
    gap = F.abs(F.col("t") / n1 - F.col("c") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    counted = written(counted.select("term", (F.col("t") + F.col("c")).alias("df"), gap.alias("gap")).where("df >= 3"), "toxicity-terms")
    if counted.count() > MOST_TERMS:
        counted = written(counted.orderBy(F.desc("gap"), "term").limit(MOST_TERMS), "toxicity-most-terms")
    kept = counted.select("term", "gap").toArrow()
    terms, gaps = kept.column("term").to_numpy(), kept.column("gap").to_numpy()
    order = np.argsort(terms)
    terms, x = terms[order], np.clip((gaps[order] / FULL_GAP) ** 2, LEAST_VALUE, 1)
    # The documents and the state of the fit stay off the driver, which gets the weights alone.
    active = written(sample.mapInArrow(_active(terms), "toxic int, rows binary"), "toxicity-rows")
    fitted = active.coalesce(1).mapInArrow(_fit_rows(x, n_toxic / n), "k long, value double").toArrow()
    flat = np.empty(fitted.num_rows)
    flat[fitted.column("k").to_numpy()] = fitted.column("value").to_numpy()
    return Model(terms, float(flat[0]), flat[1 : 1 + len(terms)], flat[1 + len(terms) :].reshape(-1, FACTORS))


def _scores(model: Model):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model.rows())
        for batch in batches:
            found = [model.score(find(t or "")) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "score"])

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_scores(model), "doc_id long, score double")


def clean_rows(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    work = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col(text_col).alias("text"))
    schema = StructType([*work.schema.fields[:-1], StructField("score", DoubleType())])
    kept = work.mapInArrow(_scores(model), schema).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
