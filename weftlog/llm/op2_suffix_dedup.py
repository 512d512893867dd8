"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every byte covered by a string of `LENGTH` bytes that also starts earlier (in a document with a smaller id, or earlier in
the same one) is removed; strings are judged on the input.

Which suffixes are sorted. Sorting all of them would move many times the input (each byte begins one), so a content-defined
choice comes first, without loss: of the `LENGTH - GRAM + 1` grams of `GRAM` bytes in a string the one with the smallest
fingerprint (the leftmost of equals) is its anchor. Equal strings have equal anchors at equal offsets, so a string can
repeat only if its anchor's gram does. Suffixes that begin at an anchor are kept if their gram occurs twice or more; of a
gram that occurs twice in one batch of texts that is known at once, and one row of the batch goes to meet the others.

The sort. A task sorts its suffixes (what follows the anchor, up to `LENGTH` bytes) and cuts them into runs, one for each
part (a part has all suffixes of its grams); runs travel front-coded: common prefix with the suffix before, and the rest.
A part merges its runs by a loser tree whose players carry their common prefix with the last suffix given out: the longer
one wins unread, and equal ones are compared beyond the prefix that is known. Out come the suffixes in order with their
common prefixes, which give, for every r, the classes of suffixes that agree on r bytes; sorting what precedes the anchors
gives the same to the left. A string at offset o before its anchor is one pair of classes (o bytes to the left,
LENGTH - o to the right); all but the earliest of a pair are repeated. No fingerprint decides here, only bytes. Suffixes of
a task that agree in all bytes on both sides are combined before they move: the earliest stands for them, and the strings
around the others are repeated for certain, so the inside of a passage meets as one row for each task.

Documents with equal texts: all but the first are removed whole (if they have LENGTH bytes) and take no part in the sort,
so groups of copies never meet. Text is moved by a fingerprint of the row, once: the three joins share that exchange.

Null text is empty. Rows that repeat id and text count as one document and each give its row; rows of one id with other
texts are ordered by a fingerprint; a null id comes before all. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm.common import _LETTERS, _M1, _inverse_powers, _powers, mix, slices, small_batches, table, text_buffers

LENGTH, GRAM = 100, 24
LEFT = LENGTH - GRAM
#: Stands for a null id.
NO_ID = -(2**63) + 1
#: A task cuts its sorted suffixes into runs when it holds so many.
RUN = 40_000


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Fingerprint of the gram that begins at each byte (one that runs over the end is left out)."""
    n = len(raw) - gram + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[raw] * _powers(len(raw)), dtype=np.uint64)])
        return mix((sums[gram:] - sums[:-gram]) * _inverse_powers(len(raw))[:n])


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints) of the anchors of all strings of LENGTH bytes inside each text."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(raw)
    value = ((hashes >> np.uint64(32)) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    # Smallest of each window of LEFT + 1, through smallest from block starts and to block ends.
    w = LEFT + 1
    pad = np.full(-len(value) % w, np.iinfo(np.uint64).max)
    blocks = np.concatenate([value, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    count = n - LENGTH + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    start = np.arange(count)
    inside = np.zeros(count, bool)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= LENGTH:
            inside[s : e - LENGTH + 1] = True
    places = np.unique(least[start[inside]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return places, hashes[places]


def _anchored(batches):
    for batch in slices(batches, "text", 1 << 20):
        raw, at = text_buffers(batch.column("text"))
        places, keys = anchors(raw, at)
        owner = np.searchsorted(at, places, "right") - 1
        # Empty texts share a start with the next one; the last of equals is the owner.
        row, pos = batch.column("row").to_numpy()[owner], (places - at[owner]).astype(np.int32)
        # 0: the gram's only row here; 1: one of several, which goes to meet other batches; 2: the others, known to be repeated, dealt evenly.
        _, first, inverse, many = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        state = np.where(many[inverse] > 1, 2, 0).astype(np.int8)
        state[first] //= 2
        keys = np.where(state == 2, mix(row.view(np.uint64) + pos.astype(np.uint64)), keys)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(row), pa.array(pos), pa.array(state)], names=["key", "row", "pos", "state"])


def _repeated(batches):
    """Of a partition sorted by key: the rows whose key another row has, or that are known to be repeated. Holds one row back between batches."""
    last = None
    for batch in batches:
        key, row, pos, state = (batch.column(c).to_numpy() for c in ("key", "row", "pos", "state"))
        known = state == 2
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(row[known]), pa.array(pos[known])], names=["row", "pos"])
            key, row, pos, state = (x[~known] for x in (key, row, pos, state))
        if not len(key):
            continue
        if last is not None:
            key, row, pos, state = (np.concatenate([[x], y]) for x, y in zip(last[:4], (key, row, pos, state), strict=True))
        same = key[1:] == key[:-1]
        give = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (state == 1)
        done = last is not None and last[4]
        shared = bool(give[-1])
        if done:
            give[0] = False
        last = (key[-1], row[-1], pos[-1], state[-1], shared or done and len(key) == 1)
        out = np.flatnonzero(give)
        yield pa.RecordBatch.from_arrays([pa.array(row[out]), pa.array(pos[out].astype(np.int32))], names=["row", "pos"])


# A suffix in a task: (what follows the anchor, what precedes it, document number in the task, place of the anchor).


def encode(run: list[tuple[bytes, bytes, int, int]], documents: list[tuple[int, int]]) -> bytes:
    """A sorted run, front-coded."""
    used = sorted({s[2] for s in run})
    number = {d: i for i, d in enumerate(used)}
    n = len(run)
    lcp, size, left = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    doc, pos = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    tails, heads, before = [], [], b""
    for i, (after, head, d, p) in enumerate(run):
        common = common_prefix(before, after, 0)
        lcp[i], size[i], left[i], doc[i], pos[i] = common, len(after), len(head), number[d], p
        tails.append(after[common:])
        heads.append(head)
        before = after
    ids = np.array([documents[d] for d in used], np.int64).reshape(-1, 2)
    body = [lcp.tobytes(), size.tobytes(), left.tobytes(), doc.tobytes(), pos.tobytes(), ids.tobytes(), b"".join(heads), b"".join(tails)]
    return struct.pack("<II", n, len(used)) + b"".join(body)


class Run:
    """A front-coded run that gives its suffixes one by one."""

    def __init__(self, blob: bytes):
        n, m = struct.unpack_from("<II", blob)
        at = 8

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        self.n = n
        self.lcp, self.size, self.left = (take(np.uint8, n) for _ in range(3))
        self.doc, self.pos = take(np.uint32, n), take(np.uint32, n)
        self.ids = take(np.int64, 2 * m).reshape(-1, 2)
        self.heads = np.frombuffer(blob, np.uint8, int(self.left.sum(dtype=np.int64)), at)
        self.tails, self.tail = blob, at + len(self.heads)
        self.next, self.now = 0, b""
        self.lcps, self.sizes = self.lcp.tolist(), self.size.tolist()

    def advance(self) -> bool:
        """Move to the next suffix (self.now); False at the end."""
        i = self.next
        if i == self.n:
            return False
        common = self.lcps[i]
        rest = self.sizes[i] - common
        self.now = self.now[:common] + self.tails[self.tail : self.tail + rest]
        self.tail += rest
        self.next = i + 1
        return True


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known."""
    n = min(len(a), len(b))
    while known + 16 <= n and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


def merged(runs: list[Run]):
    """(run, number in the run, common prefix with the one before) of all suffixes in order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    live = [r.advance() for r in runs] + [False] * (k - len(runs))
    known = [0] * k  # common prefix of a player's suffix with the last winner at its place in the tree

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows its prefix with the winner."""
        if not live[b]:
            return a, b
        if not live[a]:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a].now, runs[b].now
        common = common_prefix(x, y, known[a])
        if x[common : common + 1] < y[common : common + 1] or x[common : common + 1] == y[common : common + 1] and a < b:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    losers = [-1] * k
    level = list(range(k))
    size = k
    while size > 1:
        following = []
        for i in range(0, size, 2):
            winner, loser = play(level[i], level[i + 1])
            losers[size // 2 + i // 2] = loser
            following.append(winner)
        level, size = following, size // 2
    winner = level[0]
    while live[winner]:
        run = runs[winner]
        yield winner, run.next - 1, known[winner]
        live[winner] = run.advance()
        known[winner] = run.lcps[run.next - 1] if live[winner] else 0
        at = (winner + k) // 2
        while at:
            winner, losers[at] = play(winner, losers[at])
            at //= 2


def covered(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of what the repeated strings around each anchor cover."""
    order = list(merged(runs))
    n = len(order)
    which, number, lcp = (np.array(x, np.int64) for x in zip(*order, strict=True))
    base = np.concatenate([[0], np.cumsum([r.n for r in runs])])
    flat = base[which] + number
    join = lambda f: np.concatenate([f(r) for r in runs])[flat]
    right, left, pos = (join(lambda r, c=c: getattr(r, c).astype(np.int64)) for c in ("size", "left", "pos"))
    ids = np.concatenate([r.ids[r.doc] for r in runs])[flat]
    # What precedes each anchor, read backwards, in rows of LEFT bytes.
    back = np.zeros((n, LEFT), np.uint8)
    starts = np.concatenate([np.cumsum(r.left, dtype=np.int64) - r.left + b for r, b in zip(runs, np.cumsum([0] + [len(r.heads) for r in runs[:-1]]), strict=True)])[flat]
    heads = np.concatenate([r.heads for r in runs] + [np.zeros(1, np.uint8)])
    for j in range(LEFT):
        has = left > j
        back[:, j] = np.where(has, heads[np.where(has, starts + left - 1 - j, len(heads) - 1)], 0)
    fresh = lcp < GRAM
    fresh[0] = True
    group = np.cumsum(fresh)
    words = np.concatenate([back, np.zeros((n, -LEFT % 8), np.uint8)], 1).view(">u8")
    by_left = np.lexsort([words[:, j] for j in range(words.shape[1] - 1, -1, -1)] + [group])
    sorted_back = back[by_left]
    differ = sorted_back[1:] != sorted_back[:-1]
    left_lcp = np.where(differ.any(1), differ.argmax(1), LEFT)
    left_lcp = np.concatenate([[-1], np.where(group[by_left][1:] != group[by_left][:-1], -1, left_lcp)])
    by_place = np.lexsort([pos, ids[:, 1], ids[:, 0]])
    again = np.concatenate([[False], (np.diff(ids[by_place], axis=0) == 0).all(1) & (np.diff(pos[by_place]) == 0)])
    by_place = by_place[~again]
    low, high = np.full(n, LEFT + 1), np.full(n, -1)
    for o in range(LEFT + 1):
        at = by_place[(left[by_place] >= o) & (right[by_place] >= LENGTH - o)]
        if not len(at):
            continue
        to_left = np.empty(n, np.int64)
        to_left[by_left] = np.cumsum(left_lcp < o)
        key = (to_left * (n + 1) + np.cumsum(lcp < LENGTH - o))[at]
        ordered = np.argsort(key, kind="stable")
        later = at[ordered[1:][key[ordered][1:] == key[ordered][:-1]]]
        low[later] = np.minimum(low[later], o)
        high[later] = o
    out = np.flatnonzero(high >= 0)
    return ids[out, 1], pos[out] - high[out], pos[out] - low[out] + LENGTH


def combined(suffixes: list[tuple[bytes, bytes, int, int]], documents: list[tuple[int, int]]) -> tuple[list[tuple[bytes, bytes, int, int]], list[tuple[int, int, int]]]:
    """Of sorted suffixes, the earliest of those that agree in all bytes, and what the repeated strings around the others cover (row, start, end)."""
    kept, spans, first = [], [], 0
    while first < len(suffixes):
        after, head = suffixes[first][:2]
        end = first + 1
        while end < len(suffixes) and suffixes[end][0] == after and suffixes[end][1] == head:
            end += 1
        group = suffixes[first:end]
        place = lambda x: (documents[x[2]], x[3])
        earliest = min(group, key=place) if end > first + 1 else group[0]
        kept.append(earliest)
        low, high = max(0, LENGTH - len(after)), len(head)
        if low <= high:  # rows that repeat id and text are one document
            spans += [(documents[d][1], p - high, p - low + LENGTH) for _, _, d, p in group if (documents[d], p) != place(earliest)]
        first = end
    return kept, spans


def runner(parts: int):
    """Sorted, front-coded runs of the suffixes at the given anchors of each text, and (without a run) spans that are known already."""

    def run(batches):
        held: list[tuple[int, bytes, bytes, int, int]] = []
        documents: list[tuple[int, int]] = []

        def cut():
            held.sort()
            rows, first = [], 0
            while first < len(held):
                end = first
                while end < len(held) and held[end][0] == held[first][0]:
                    end += 1
                kept, spans = combined([s[1:] for s in held[first:end]], documents)
                rows.append((held[first][0], encode(kept, documents), None, None, None))
                rows += [(row % parts, None, row, start, stop) for row, start, stop in spans]
                first = end
            held.clear()
            documents.clear()
            a, b, c, d, e = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.int64()), pa.array(d, pa.int32()), pa.array(e, pa.int32())], names=["part", "run", "row", "start", "end"])

        for batch in slices(batches, "text"):
            raw, at = text_buffers(batch.column("text"))
            data = raw.tobytes()
            ids, names = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for i, places in enumerate(batch.column("places").to_pylist()):
                s, e = int(at[i]), int(at[i + 1])
                where = np.array(places, np.int64) + s
                part = (gram_hashes(raw[s:e])[where - s] % np.uint64(parts)).astype(np.int64).tolist()
                documents.append((ids[i], names[i]))
                d = len(documents) - 1
                for p, k in zip(where.tolist(), part, strict=True):
                    held.append((k, data[p : min(p + LENGTH, e)], data[max(s, p - LEFT) : p], d, p - s))
                if len(held) >= RUN:
                    yield cut()
        if held:
            yield cut()

    return run


def _merge(batches):
    """Merge the runs of each part of a partition sorted by part."""
    part, blobs = None, []

    def done():
        row, start, end = covered([Run(b) for b in blobs])
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["row", "start", "end"])

    for batch in batches:
        known = batch.filter(batch.column("run").is_null())
        if known.num_rows:
            yield known.select(["row", "start", "end"])
            batch = batch.filter(batch.column("run").is_valid())
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), strict=True):
            if p != part and blobs:
                yield done()
                blobs = []
            part = p
            blobs.append(blob)
    if blobs:
        yield done()


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_out(length: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    runs: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(e, runs[-1][1])
        else:
            runs.append((s, e))
    return runs


def _digest(batches):
    for batch in slices(batches, "text"):
        raw, at = text_buffers(batch.column("text"))
        data, out = raw.tobytes(), []
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        for i, (doc, copy, a, b) in enumerate(zip(batch.column("shown").to_pylist(), batch.column("copy").to_pylist(), starts, ends, strict=True)):
            s, e = int(at[i]), int(at[i + 1])
            n = e - s
            runs = ([(0, n)] if n >= LENGTH else []) if copy else cut_out(n, list(zip(a, b, strict=True))) if a else []
            kept, last = hashlib.sha256(), s
            for x, y in runs:
                kept.update(data[last : s + x])
                last = s + y
            kept.update(data[last:e])
            out.append((doc, n, sum(y - x for x, y in runs), len(runs), kept.hexdigest()))
        a, b, c, d, h = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(h)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # All joins take these three columns, so that the exchange of the texts is made once and used again.
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = text.select(F.xxhash64("doc_id", "text", F.lit(1)).alias("row"), "doc_id", "text")
    # The first row of each text: two fingerprints and the length stand for the text.
    marks = text.select("row", "doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"), F.octet_length("text").alias("n"))
    firsts = marks.groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "row")).alias("m")).where(F.col("n") >= LENGTH).select(F.col("m.row").alias("row"))
    found = text.join(firsts, "row").select("row", "doc_id", "text").mapInArrow(_anchored, "key long, row long, pos int, state byte")
    shared = found.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_repeated, "row long, pos int")
    places = shared.groupBy("row").agg(F.collect_set("pos").alias("places"))
    parts = 4 * n
    runs = text.join(places, "row").select("row", "doc_id", "text", "places").mapInArrow(runner(parts), "part int, run binary, row long, start int, end int")
    spans = runs.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_merge, "row long, start int, end int")
    spans = spans.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    whole = text.join(spans, "row", "left").join(firsts.withColumn("first", F.lit(True)), "row", "left")
    return whole.select(F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("shown"), "text", "starts", "ends", F.col("first").isNull().alias("copy")).mapInArrow(_digest, _RESULT)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES = {
    "op2_suffix_dedup": f"""
WITH data AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, i, b[i + 1:i + {LENGTH}] AS w FROM data, LATERAL (SELECT unnest(range(0, n - {LENGTH - 1})) AS i)),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM strings),
gone AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM placed WHERE k > 1),
marked AS (SELECT doc_id, i, sum(CASE WHEN last IS NULL OR i > last + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone),
runs AS (SELECT doc_id, min(i) AS s, max(i) + {LENGTH} AS e FROM marked GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM runs
  UNION ALL SELECT d.doc_id, coalesce(max(r.e), 0), d.n FROM data d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id, d.n),
texts AS (SELECT k.doc_id, sha256(unhex(string_agg(hex(b[s + 1:e]), '' ORDER BY s))) AS kept_sha256 FROM kept k JOIN data USING (doc_id) GROUP BY k.doc_id),
sums AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM data JOIN texts USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
}
