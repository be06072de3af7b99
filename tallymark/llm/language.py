"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of one to three letters of the lower-cased text, where whatever is no
letter counts as one blank. Document frequencies cover all training documents. The model is trained
with follow-the-regularised-leader and elastic-net penalties on a sample of at most ``per_language``
documents of each language (chosen by hash), so its training is bounded; a fifth of that sample sets
the temperature that calibrates the probabilities. Training documents are those whose
crc32(doc_id as text) mod 4 isn't 2; predictions use the text alone.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows without a
language are predicted but not learned from; repeated rows are predicted one by one; without any
language everything is ``und``; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import chunks, without_rows
from tallymark.llm.spans import GAP, LETTER, _classes, code_points, mix

CHUNK = 300_000
FEATURES = 1 << 14


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and count of every n-gram that occurs, and which texts hold a letter."""
    _, units, text_starts = code_points([t.lower() for t in texts])
    kind = _classes()[units]
    kind[text_starts[1:] - 1] = GAP
    letter = kind == LETTER
    signs = np.where(letter, units, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[text_starts[:-1]] = True
    keep |= kind == GAP
    at = np.flatnonzero(keep)
    signs, inside = signs[at], kind[at] != GAP
    text = np.searchsorted(text_starts, at, side="right") - 1
    code = mix(signs)
    grams = [(code, inside & (signs != 32))]
    for n in (2, 3):
        value = np.zeros(max(0, len(code) - n + 1), np.uint64)
        good = np.ones(len(value), bool)
        for j in range(n):
            part = slice(j, j + len(value))
            value = value * np.uint64(0x9FB21C651E98DF25) + code[part]
            good &= inside[part]
        grams.append((mix(value + np.uint64(n)), good))
    keys = np.concatenate(
        [text[: len(v)][ok] * FEATURES + (v[ok] % np.uint64(FEATURES)).astype(np.int64) for v, ok in grams]
    )
    if len(texts) * FEATURES <= 4 * len(keys):
        counts = np.bincount(keys, minlength=len(texts) * FEATURES)
        used = np.flatnonzero(counts)
        counts = counts[used]
    else:  # many short texts: only what occurs
        used, counts = np.unique(keys, return_counts=True)
    has_letter = np.bincount(np.searchsorted(text_starts, np.flatnonzero(letter), side="right") - 1, minlength=len(texts))
    return used // FEATURES, used % FEATURES, counts, has_letter > 0


def tf_idf(text: np.ndarray, counts: np.ndarray, idf: np.ndarray, n_texts: int) -> np.ndarray:
    """Weights of length one per text; ``idf`` is that of each entry's feature."""
    value = (1 + np.log(counts)) * idf
    norm = np.sqrt(np.bincount(text, value * value, minlength=n_texts))
    return value / np.maximum(norm[text], 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: np.ndarray, feature: np.ndarray, counts: np.ndarray, n_texts: int) -> np.ndarray:
        value = tf_idf(text, counts, self.idf[feature], n_texts)
        logits = np.stack(
            [np.bincount(text, value * w[feature], minlength=n_texts) for w in self.weights], 1
        ) + self.bias
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, one learning rate per coordinate, L1 and L2 penalties."""

    def __init__(self, classes: int, features: int, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3):
        self.z, self.n = np.zeros((2, classes, features))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax((w @ value)[None])[0]
        p[label] -= 1
        g = np.outer(p, value)
        n = self.n[:, at]
        more = n + g * g
        self.z[:, at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = more


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature occurs, and the number of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for _, texts in chunks(batches, "text", CHUNK):
            total[:-1] += np.bincount(gram_counts(texts)[1], minlength=FEATURES)
            total[-1] += len(texts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["feature", "n"])

    rows = docs.select("text").mapInArrow(work, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    got = rows.toPandas()
    out = np.zeros(FEATURES + 1, np.int64)
    out[got["feature"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out[:-1], int(out[-1])


def train(docs: DataFrame, per_language: int = 600, epochs: int = 3) -> Model:
    """Model from (doc_id, text, lang) of training rows."""
    frequency, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) < 2:
        return Model(languages, idf, np.zeros((len(languages), FEATURES)), np.zeros(len(languages)), 1.0)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", CHUNK):
            text, feature, counts, _ = gram_counts(texts)
            cut = np.searchsorted(text, np.arange(len(texts) + 1))
            slices = [slice(a, b) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    batch.column("draw"),
                    pa.array([feature[s].astype(np.uint16).tobytes() for s in slices], pa.binary()),
                    pa.array([counts[s].astype(np.uint32).tobytes() for s in slices], pa.binary()),
                ],
                names=["lang", "draw", "features", "counts"],
            )

    drawn = docs.select("lang", "text", draw.alias("draw")).where(F.col("draw") < share[F.col("lang")])
    sample = drawn.mapInArrow(work, "lang string, draw double, features binary, counts binary").collect()
    rng = np.random.default_rng(11)
    sample = [sample[i] for i in rng.permutation(len(sample))] if sample else []
    sample.sort(key=lambda r: r["draw"] / min(1.0, per_language / sizes[r["lang"]]))
    rows = []
    for r in sample:
        feature = np.frombuffer(r["features"], np.uint16).astype(np.int64)
        counts = np.frombuffer(r["counts"], np.uint32)
        value = tf_idf(np.zeros(len(feature), np.int64), counts, idf[feature], 1)
        rows.append((np.append(feature, FEATURES), np.append(value, 1.0), languages.index(r["lang"])))
    apart = [r for i, r in enumerate(rows) if i % 5 == 4]
    fit = [r for i, r in enumerate(rows) if i % 5 != 4]
    ftrl = Ftrl(len(languages), FEATURES + 1)
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            ftrl.learn(*fit[i])
    w = ftrl.weights(slice(None))
    logits = np.array([w[:, a] @ v for a, v, _ in apart or fit])
    truth = np.array([k for _, _, k in apart or fit])
    grid = np.geomspace(0.02, 20, 200)
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return Model(languages, idf, w[:, :-1], w[:, -1], float(grid[int(np.argmin(loss))]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, lang_pred, score) of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch, texts in chunks(batches, "text", CHUNK):
            text, feature, counts, letters = gram_counts(texts)
            if model.languages:
                p = model.probabilities(text, feature, counts, len(texts))
                best, score = p.argmax(1), p.max(1)
            else:
                best, score, letters = np.zeros(len(texts), int), np.zeros(len(texts)), letters & False
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array([model.languages[b] if ok else "und" for b, ok in zip(best, letters)], pa.string()),
                    pa.array(np.where(letters, score, 0.0)),
                ],
                names=["row", "doc_id", "lang_pred", "score"],
            )

    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    return own.mapInArrow(work, "row long, doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the training rows of ``docs`` and predict all of them."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return predict(docs, train(known.select("doc_id", "text", "lang"), **options))


def accepted(docs: DataFrame, least: float = 0.35, **options) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least``, with all columns."""
    found = identify(docs, **options)
    return without_rows(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < least)).select("row"))
