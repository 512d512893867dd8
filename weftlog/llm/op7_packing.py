"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document's ids (with the closing id 0) longer than the capacity are cut into capacity-sized pieces, the first one being
the rest. How pieces are packed depends on their lengths alone, so the plan is made over the histogram of lengths, which
has as many entries as the capacity however large the corpus is:

* pieces above one third of the capacity: greedy matching, longest first, each with the longest partner that fits; two a bin at most;
* the others, longest first, go to the fullest bin that still holds them; new bins are opened only where none does.

Many equal pieces are placed in one step, so a plan is a few thousand runs "so many pieces of this length, from this bin
on, at this offset". A piece finds its slot by its rank among the pieces of its length: rank within its partition, plus
the counts of the partitions before. No piece is ever shuffled by length.

Null and empty texts are the closing id alone; rows that repeat are packed each; an empty table gives no rows; further
columns are ignored. Ids are those of the byte-level BPE of 50k entries, read from its rank file by tiktoken (the tests
hold them against the tokenizers file); a string that spells a special token (`SPECIAL`) is that token, as it is by that file.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.llm.common import Written, slices, small_batches, table, texts

CAPACITY, TOKENIZER = 2048, "byte_bpe_50k.tiktoken"
#: The vocabulary's special tokens and their ids (fixed values).
SPECIAL = {"<|endoftext|>": 50256}
#: A worker's memory of encoded chunks is emptied beyond these numbers of chunks and ids.
MOST_CHUNKS, MOST_IDS = 800_000, 6_000_000
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")


class Encoder:
    """Ids of many texts at once. A space that follows a non-space always begins a piece of the BPE's pattern, so chunks between single spaces are encoded once and kept."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ordinary, self.piece = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece
        self.clear()

    def encode(self, text: str) -> list[int]:
        """Ids of a text, also of one that spells special tokens."""
        if not any(t in text for t in SPECIAL):
            return self.ordinary(text)
        out: list[int] = []
        for part in _SPECIAL.split(text):
            if part in SPECIAL:
                out.append(SPECIAL[part])
            elif part:
                out += self.ordinary(part)
        return out

    def clear(self) -> None:
        self.ids, self.starts, self.lengths = array("I", [0]), array("q", [0]), array("q", [1])
        self.marks = {m: array("I", self.encode(m)) for m in ".,!"}
        outer = self

        class Chunks(dict):
            def __missing__(self, chunk):
                if len(chunk) > 48:
                    return outer.keep(outer.encode(" " + chunk))
                word = chunk[:-1] if chunk.endswith((".", ",", "!")) else chunk
                if not (word.isalpha() and max(word) < "\u0250"):
                    found = outer.encode(" " + chunk)
                elif word is chunk:  # letters after one space are a single piece of the pattern
                    found = outer.piece(b" " + chunk.encode())
                else:
                    at = self[word]
                    found = outer.ids[outer.starts[at] : outer.starts[at] + outer.lengths[at]] + outer.marks[chunk[-1]]
                number = self[chunk] = outer.keep(found)
                return number

        self.chunks = Chunks()

    def keep(self, found) -> int:
        self.starts.append(len(self.ids))
        self.lengths.append(len(found))
        self.ids.extend(found)
        return len(self.lengths) - 1

    def documents(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, each document closed by 0; number of ids of each document)."""
        if len(self.chunks) > MOST_CHUNKS or len(self.ids) > MOST_IDS:
            self.clear()
        numbers, per = [], np.empty(len(many), np.int64)
        get = self.chunks.__getitem__
        for i, text in enumerate(many):
            was = len(numbers)
            if not text:
                pass
            elif "  " in text or any(t in text for t in SPECIAL):
                numbers.append(self.keep(self.encode(text)))
            else:
                parts = text.split(" ")
                if parts[0]:
                    numbers.append(self.keep(self.encode(parts[0])))
                del parts[0]
                numbers.extend(map(get, parts))
            numbers.append(0)
            per[i] = len(numbers) - was
        at = np.array(numbers, np.int64)
        starts, lengths, ids = np.array(self.starts), np.array(self.lengths), np.array(self.ids)
        n = lengths[at]
        ends = np.cumsum(n)
        out = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].astype("<u4")
        return out, np.diff(np.concatenate([[0], ends[np.cumsum(per) - 1]]))


def pieces_of(length: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the rest first, then whole ones."""
    whole, rest = divmod(length, capacity)
    return [rest] * bool(rest) + [capacity] * whole


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cutter(path: str, capacity: int):
    def cut(batches):
        encoder, part, seen = Encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", 1 << 20):
            ids, lengths = encoder.documents(texts(batch.column("text")))
            doc, piece, start, size, crc = [], [], [], [], []
            first = 0
            names = batch.column("doc_id").to_pylist()
            view = memoryview(ids.tobytes())
            for name, n in zip(names, lengths.tolist(), strict=True):
                inner = 0
                for k, m in enumerate(pieces_of(n, capacity)):
                    doc.append(name)
                    piece.append(k)
                    start.append(inner)
                    size.append(m)
                    crc.append(zlib.crc32(view[4 * (first + inner) : 4 * (first + inner + m)]))
                    inner += m
                first += n
            size = np.array(size, np.int64)
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            run = np.arange(len(size)) - np.searchsorted(ordered, ordered, "left")
            rank = np.empty(len(size), np.int64)
            rank[order] = run + seen[ordered]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return cut


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first bin, offset) that place every piece, and the number of bins."""
    left = dict(counts)
    used: dict[int, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first bin, count)
    free: list[int] = []

    def put(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, used.get(length, 0), count, first, offset))
        used[length] = used.get(length, 0) + count
        left[length] -= count

    def spare(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(free, gap)
            gaps[gap].append((first, count))

    large = sorted((n for n, c in counts.items() if c and 3 * n > capacity))
    for length in reversed(large):
        at = len(large) - 1
        while left[length]:
            at = min(at, bisect_left(large, capacity - length + 1) - 1)
            while at >= 0 and (not left[large[at]] or large[at] == length and left[length] < 2):
                at -= 1
            if at < 0:
                count, partner = left[length], 0
            else:
                partner = large[at]
                count = left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, count, bins, 0)
            if partner:
                put(partner, count, bins, length)
            spare(capacity - length - partner, bins, count)
            bins += count
    for length in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(free, length)
            if at < len(free):
                gap = free[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    del free[at]
                taken = min(count, left[length])
                put(length, taken, first, capacity - gap)
                spare(gap - length, first, taken)
                spare(gap, first + taken, count - taken)
                continue
            each = capacity // length
            count = max(1, left[length] // each)
            inside = min(each, left[length])
            for k in range(inside):
                put(length, count, bins, k * length)
            spare(capacity - inside * length, bins, count)
            bins += count
    return runs, bins


def placer(runs: list[tuple[int, int, int, int, int]]):
    table_ = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = (table_[:, 0] << 44) | table_[:, 1]

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            run = table_[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; tokenizer: path of a rank file, on every executor."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    small_batches(spark)
    store = Written(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = store.write(rows.mapInArrow(cutter(str(tokenizer), capacity), _PIECES), "pieces")
    parts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many rows as the capacity at most
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("length", "part", "earlier")
    ranked = cut.join(parts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    runs, _ = plan(counts, capacity)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placer(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
