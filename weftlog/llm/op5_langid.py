"""Language identification by a byte convolutional network.

Bytes are classed (letters without case, blanks, digits, signs, and each byte of multi-byte characters); filters of
widths 2, 3 and 4 slide over fixed windows of `WINDOW` bytes, each filter's largest value in a window is kept, and a
softmax layer gives the languages. Training is numpy, on windows of labelled documents: of each language about `DOCUMENTS`
documents, those whose hashes are below a threshold from the language's count (so what meets is bounded at every size), up
to `WINDOWS` windows spread evenly over a document's whole text, and of those the `SAMPLE` with the smallest hashes of
doc_id and place (documented bounds; nothing but training is sampled). Documents whose crc32(doc_id) mod 3 is 1 are held out.

Prediction covers every whole text: its windows (the last moved back to be full) are run in batches, and the mean of
their probabilities decides. Filters of two adjacent bytes are tables of byte pairs, so a window costs a few lookups.

Text that is null or has no letter: `und` with score 0. Without labelled documents every text is `und`. Repeated rows
each give their row; ties go to the language first in code point order; an empty table gives no rows; further columns
are ignored; null ids are not held out and never train.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.llm.common import Written, if_small, slices, small_batches, table, text_buffers, texts

WINDOW, WINDOWS, DOCUMENTS, SAMPLE = 256, 4, 2000, 1000
WIDTHS, FILTERS, EPOCHS, SEED = (2, 3, 4), 8, 6, 5
CLASSES = 128
DOCUMENT = [("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long")]


def _classes() -> np.ndarray:
    """Class of each byte; 0 is padding."""
    c = np.full(256, 4, np.uint8)
    c[[9, 10, 11, 12, 13, 32]] = 1
    c[48:58], c[33:48] = 2, 3
    for i in range(26):
        c[65 + i] = c[97 + i] = 5 + i
    c[128:192] = 31 + np.arange(64)  # trailing bytes
    c[192:224] = 95 + np.arange(32)
    c[224:] = 127
    return c


_CLASS = _classes()
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a text has a character of the Unicode categories L."""
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text)




def windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of byte classes, text of each window) over whole texts; short texts are padded."""
    length = np.diff(at)
    many = np.maximum(1, -(-length // WINDOW))
    owner = np.repeat(np.arange(len(length)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(place * WINDOW, np.maximum(length[owner] - WINDOW, 0)) + at[:-1][owner]
    index = start[:, None] + np.arange(WINDOW)
    inside = index < at[1:][owner][:, None]
    padded = np.append(_CLASS[raw], np.uint8(0))
    return padded[np.where(inside, index, len(raw))], owner


class Net:
    def __init__(self, languages: list[str]):
        r = np.random.default_rng(SEED)
        self.languages = languages
        self.filters = [r.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def ready(self) -> Net:
        """Tables of byte pairs, for prediction."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        two, three, four = self.filters
        self.pairs = [pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1]), pair(four[2], four[3])]
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each window."""
        both = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
        out = [
            self.pairs[0][both].max(1),
            (self.pairs[1][both[:, :-1]] + self.filters[1][2][x[:, 2:]]).max(1),
            (self.pairs[2][both[:, :-2]] + self.pairs[3][both[:, 2:]]).max(1),
        ]
        return np.maximum(np.concatenate(out, 1), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), 512):
            z = self.pooled(x[i : i + 512]) @ self.dense + self.bias
            e = np.exp(z - z.max(1, keepdims=True))
            out.append(e / e.sum(1, keepdims=True))
        return np.concatenate(out)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Net:
        """Adam on the cross-entropy; a filter's gradient goes to the bytes where its largest value stood."""
        r = np.random.default_rng(SEED)
        params = [*self.filters, self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _epoch in range(EPOCHS):
            order = r.permutation(len(x))
            for b in range(0, len(order), 64):
                xs, ys = x[order[b : b + 64]], y[order[b : b + 64]]
                n, rows = len(xs), np.arange(len(xs))
                hidden, tops = [], []
                for w, f in zip(WIDTHS, self.filters, strict=True):
                    v = sum(f[j][xs[:, j : WINDOW - w + 1 + j]] for j in range(w))
                    top = v.argmax(1)
                    tops.append(top)
                    hidden.append(np.take_along_axis(v, top[:, None, :], 1)[:, 0])
                h = np.concatenate(hidden, 1)
                active = np.maximum(h, 0)
                z = active @ self.dense + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[rows, ys] -= 1
                p /= n
                back = (p @ self.dense.T) * (h > 0)
                grads = []
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g = np.zeros_like(f)
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (xs[rows[:, None], tops[k] + j], np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [active.T @ p, p.sum(0)]
                step += 1
                for value, g, m, v2 in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v2 += 0.001 * (g * g - v2)
                    value -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.999**step)) + 1e-8)
        return self


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _training(batches):
    for batch in slices(batches, "text"):
        raw, at = text_buffers(batch.column("text"))
        rows = []
        for i, (doc, lang) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
            text = raw[at[i] : at[i + 1]]
            last = max(0, len(text) - WINDOW)
            for k, s in enumerate(sorted({round(last * j / max(1, WINDOWS - 1)) for j in range(WINDOWS)})):
                rows.append((doc, k, lang, text[s : s + WINDOW].tobytes()))
        if rows:
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(d, pa.binary())], names=["doc_id", "place", "lang", "window"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Net | None:
    """A network for the languages of docs (doc_id, text, lang), or None without any labelled text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    counts = Written(docs.sparkSession).write(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    place = F.xxhash64("doc_id", F.lit("training")).cast("double") / 2.0**64 + 0.5
    rows = rows.join(if_small(counts), "lang").where(place * F.col("n") < DOCUMENTS).select("doc_id", "text", "lang")
    parts = rows.mapInArrow(_training, "doc_id long, place int, lang string, window binary")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place", "window")
    taken = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).select("lang", "window", "rank").orderBy("lang", "rank").toArrow()
    if not taken.num_rows:
        return None
    names = taken.column("lang").to_pylist()
    languages = sorted(set(names))
    bytes_ = taken.column("window").to_pylist()
    at = np.concatenate([[0], np.cumsum([len(b) for b in bytes_])])
    x, owner = windows(np.frombuffer(b"".join(bytes_), np.uint8), at)
    y = np.array([languages.index(n) for n in names])[owner]
    return Net(languages).fit(x, y)


def predictor(net: Net | None, keep: list[str]):
    """Adds lang_pred and score to the columns named in keep."""

    def predict(batches):
        if net is not None:
            net.ready()
        for batch in slices(batches, "text", 1 << 20):
            lettered = np.array([has_letter(t) for t in texts(batch.column("text"))])
            lang, score = np.full(len(lettered), "und", object), np.zeros(len(lettered))
            if net is not None and lettered.any():
                x, owner = windows(*text_buffers(batch.column("text")))
                p = net.probabilities(x)
                mean = np.stack([np.bincount(owner, p[:, k], len(lettered)) for k in range(p.shape[1])], 1)
                mean /= mean.sum(1, keepdims=True)
                best = mean.argmax(1)
                lang[lettered] = np.array(net.languages, object)[best][lettered]
                score[lettered] = mean[np.arange(len(best)), best][lettered]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(list(lang), pa.string()), pa.array(np.clip(score, 0, 1))], names=[*keep, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, lang_pred, score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(predictor(net, ["doc_id"]), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, net: Net | None, least: float) -> DataFrame:
    """The rows of documents (doc_id, text, lang, source, n_chars) whose language is recognised with a score of at least `least`."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.col(c).cast(t).alias(c) for c, t in DOCUMENT))
    schema = ", ".join(f"{c} {t}" for c, t in DOCUMENT) + ", lang_pred string, score double"
    found = rows.mapInArrow(predictor(net, [c for c, _ in DOCUMENT]), schema)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op5_langid": op5_langid}
ORACLES: dict[str, str] = {}
