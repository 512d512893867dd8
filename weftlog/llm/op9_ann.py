"""Approximate nearest neighbours by additive quantisation.

Vectors are scaled to length 1. `BOOKS` codebooks of full-dimensional codewords are fitted one after the other on what
the ones before leave (k-means on the `SAMPLE` vectors with the smallest hashes of their ids, a documented bound). Every
row is encoded by beam search: the `BEAM` sums of codewords that leave least are kept from book to book. The index holds each distinct vector once, with its codes, the squared norm of their sum, and the smallest ids of
its rows: 2 k of them, of one id k at most, as many as any query can need.

A search runs in blocks of queries (at most `BLOCK`, so what goes to the executors is bounded). A scan of codes and norms
alone gives each vector's score by lookup tables of query times codeword, 2 <q, sum> - |sum|^2; a task keeps the `RERANK`
best of each query over all its rows, and the `RERANK` best of all tasks are compared exactly, in double precision on the
original vectors, which are fetched for those only.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor do
rows without id. Rows that repeat an id are candidates each; a query never finds rows of its own id; a repeated query id
is searched once, with its smallest vector. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.llm.common import Written, small_batches, table

BOOKS, WORDS, SAMPLE, BEAM, RERANK, BLOCK, K, EVERY = 32, 256, 16384, 2, 192, 1024, 5, 50


def kmeans(x: np.ndarray, k: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    centres = x[r.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        for d in range(x.shape[1]):
            sums = np.bincount(near, x[:, d], k)
            counts = np.bincount(near, minlength=k)
            centres[:, d] = np.where(counts > 0, sums / np.maximum(counts, 1), centres[:, d])
    return centres


class Quantiser:
    def __init__(self, books: np.ndarray):
        self.books = books  # books x words x dimensions
        self.norms = (books**2).sum(2)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 3) -> Quantiser:
        r, rest, books = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        for _ in range(BOOKS):
            books.append(kmeans(rest, WORDS, 6, r))
            rest = rest - books[-1][(rest @ books[-1].T * 2 - (books[-1] ** 2).sum(1)).argmax(1)]
        return cls(np.array(books, np.float32))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes: rows x books, squared norm of each row's sum)."""
        codes, norms = [], []
        for i in range(0, len(x), 1024):
            a, b = self._encode(x[i : i + 1024], beam)
            codes.append(a)
            norms.append(b)
        return np.concatenate(codes), np.concatenate(norms)

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, dims = x.shape
        x = x.astype(np.float32)
        rest = x[:, None, :]  # what the words chosen so far leave, for each sum of the beam
        chosen = np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for book, norms in zip(self.books, self.norms, strict=True):
            error = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, dims) @ book.T).reshape(n, -1, len(book)) + norms
            flat = error.reshape(n, -1)
            best = np.argpartition(flat, beam - 1, 1)[:, :beam] if beam < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
            parent, word = best // len(book), best % len(book)
            rest = rest[rows, parent] - book[word]
            chosen = np.concatenate([chosen[rows, parent], word[:, :, None].astype(np.uint8)], 2)
        best = (rest**2).sum(2).argmin(1)
        sums = x - rest[np.arange(n), best]
        return chosen[np.arange(n), best], (sums**2).sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products: books x words x queries."""
        return np.einsum("mwd,qd->mwq", self.books, queries.astype(np.float32), optimize=True)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def indexer(q: Quantiser, dims: int):
    def index(batches):
        for batch in batches:
            if batch.num_rows:
                codes, norms = q.encode(_unit(_matrix(batch.column("vec"), dims)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=[*batch.schema.names, "codes", "norm"])

    return index


def scanner(q: Quantiser, ids: np.ndarray, queries: np.ndarray, rerank: int):
    """The `rerank` best vectors (a, b) of each query, by codes, of a partition."""

    def scan(batches):
        tables = q.tables(_unit(queries))
        best, names = np.zeros((len(ids), 0), np.float32), np.zeros((len(ids), 0, 2), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                part = batch.slice(first, 8192)
                n = part.num_rows
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(n, -1)
                stored = part.column("norm").to_numpy().astype(np.float32)
                own = np.stack([part.column(c).to_numpy() for c in "ab"], 1)
                grown, called = [], []
                for k in range(0, len(ids), 128):
                    scores = np.zeros((n, min(128, len(ids) - k)), np.float32)
                    for m in range(len(tables)):
                        scores += tables[m][codes[:, m], k : k + 128]
                    scores = np.concatenate([best[k : k + 128], (2 * scores - stored[:, None]).T], 1)
                    keep = min(rerank, scores.shape[1])
                    at = np.argpartition(-scores, keep - 1, 1)[:, :keep]
                    held = best.shape[1]
                    old = names[k : k + 128]
                    called.append(np.where((at < held)[:, :, None], np.take_along_axis(old, np.minimum(at, held - 1)[:, :, None], 1) if held else 0, own[np.maximum(at - held, 0)]))
                    grown.append(np.take_along_axis(scores, at, 1))
                best, names = np.concatenate(grown), np.concatenate(called)
        if best.shape[1]:
            flat = names.reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(best.reshape(-1))], names=["query_id", "a", "b", "near"])

    return scan


def exact(ids: np.ndarray, queries: np.ndarray, dims: int, k: int):
    """query_id, vec_id, score of the rows (query_id, vec, ids): cosines in double precision, the k smallest other ids of each vector."""
    order = np.argsort(ids)

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), dims)
            asked = batch.column("query_id").to_numpy()
            y = queries[order[np.searchsorted(ids[order], asked)]]
            # Sums go along one row at a time: equal rows get equal sums.
            scores = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            out = [(q, i, s) for q, s, each in zip(asked.tolist(), scores.tolist(), batch.column("ids").to_pylist(), strict=True) for i in [i for i in sorted(each) if i != q][:k]]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    return compare


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vec: array of doubles) of the rows that take part, and their length."""
    vec = F.col("embedding").cast("array<double>")
    big = F.lit(float("inf"))
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(fine)
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return (rows.where(F.size("vec") == lengths[0]["d"]), lengths[0]["d"]) if lengths else (rows, 0)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """rows (vec_id, vec) -> a, b (fingerprints), vec, ids: each vector once, with the ids of 2 k of its rows, the smallest, of one id k at most."""
    marked = rows.select(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(7), "vec").alias("b"), "vec_id", "vec")
    each = marked.groupBy("a", "b", "vec_id").agg(F.count(F.lit(1)).alias("n")).select("a", "b", F.explode(F.array_repeat("vec_id", F.least("n", F.lit(k)).cast("int"))).alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    ids = each.withColumn("rank", rank).where(F.col("rank") <= 2 * k).groupBy("a", "b").agg(F.collect_list("vec_id").alias("ids"))
    return marked.groupBy("a", "b").agg(F.first("vec").alias("vec")).join(ids, ["a", "b"])


def search(vectors: DataFrame, queries: DataFrame, k: int = K, rerank: int = RERANK) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest found of each query."""
    spark = vectors.sparkSession
    small_batches(spark)
    store = Written(spark)
    rows, dims = usable(vectors)
    asked, _ = usable(queries)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    quantiser = Quantiser.fit(_unit(_matrix(sample, dims)))
    index = store.write(distinct_vectors(rows, k).mapInArrow(indexer(quantiser, dims), "a long, b long, vec array<double>, ids array<bigint>, codes binary, norm float"), "index")
    asked = asked.where(F.size("vec") == dims).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = store.write(asked.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id"), "queries")
    after, found = None, None
    while True:  # a block of queries after the other, in order of their ids
        part = asked if after is None else asked.where(F.col("vec_id") > after)
        block = part.orderBy("vec_id").limit(BLOCK).toArrow()
        if not block.num_rows:
            break
        ids, own = block.column("vec_id").to_numpy(), _matrix(block.column("vec").combine_chunks(), dims)
        after = int(ids[-1])
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "a", "b")
        near = index.select("a", "b", "codes", "norm").mapInArrow(scanner(quantiser, ids, own, rerank), "query_id long, a long, b long, near float")
        near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rerank).select("query_id", "a", "b")
        scored = near.join(index.select("a", "b", "vec", "ids"), ["a", "b"]).select("query_id", "vec", "ids").mapInArrow(exact(ids, own, dims, k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = store.write(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        found = best if found is None else found.unionByName(best)
        if block.num_rows < BLOCK:
            break
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op9_ann": op9_ann}
ORACLES: dict[str, str] = {}
