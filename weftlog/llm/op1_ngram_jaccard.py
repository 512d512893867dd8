"""N-gram Jaccard join: groups of documents whose sets of word shingles are similar, found exactly.

Sets are compared through 64-bit fingerprints of shingles; documents with equal sets are one node (the set's fingerprint).

Candidates, by universe partition and pigeonhole. Sizes fall into bands; within a band (and its upper neighbour) the
symmetric difference of two similar sets is at most H. Shingles are hashed into m segments. If v_i is allotted to segment
i and the v_i add up to H + 1, two similar sets differ in fewer than v_i shingles in some segment. A filled segment gets
1 (it must be equal), an empty one 0, a reserve segment of two shingles or more 2 (equal up to one shingle: its
one-deletion neighbourhood is indexed as well). How many spare and reserve segments a band has is chosen by cost: the
fewest expected keys for which the allotment falls short in at most one of `SHORT` sets. A set whose allotment still
falls short also indexes its empty segments, so no similar pair is ever missed: such a pair meets in a key unless one of
the two is not short, and then that one's allotment finds it.

Links without pairs: of buckets (keys) that hold the same nodes one is kept. In each bucket all nodes are compared with one
pivot only; the linked ones are one component, and buckets within one component are done. `ROUNDS` rounds with other pivots
leave the nodes outside their bucket's largest component; those are compared with the rest of the bucket.

Buckets of more than `HOT` nodes (copies that differ in a little too much, a passage that very many documents share) aren't
compared so: those that have one more pivot in common are one group, and its sets are replaced by their differences from the
pivot's, which leave out what the group shares. Symmetric difference is a metric: sets whose differences are small enough
together are similar without a test, and then each of them is to the one with most room, which is all they are linked with.
Other sets are similar only if their differences overlap by what exceeds that room, so they meet in one of as many of the first (the
rarest) members of each as the overlap can't do without. Pairs that don't meet are not similar; no pair is lost, whatever the order.

A parity sketch (each shingle flips one of as many bits as the set has members,
rounded up to a power of two, at least `BITS`) bounds the symmetric difference from below without error, so what reaches
the exact test, on the sets themselves, is nearly all similar; only the sets of such pairs are moved.

Null or blank text has an empty set and is linked with nothing; rows of one id are rows of their own, with the component
of their own text; ties of ids share a component's smallest; null ids are allowed, and a component's smallest is null only
if all its ids are; very long texts are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm.common import Written, if_small, mix, shingles, slices, small_batches, table, text_buffers, word_hashes

WORDS, PERCENT = 4, 85
FIRST, RATIO, SHORT = 6, 1.25, 1000
BITS = 1024
ROUNDS, HOT = 2, 128
#: Members of a group whose differences tell what is rare in it; only the order depends on them.
SAMPLE, OFTEN = 256, 3
_C1, _C2, _C3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


@lru_cache(maxsize=8)
def bands(percent: int, most: int = 1 << 34) -> np.ndarray:
    """First sizes of the bands; smaller sets are similar only if equal."""
    first = next(n for n in range(1, 200) if n * (100 - percent) >= percent)
    out, ratio = [first], max(RATIO, 100 / percent + 0.05)
    while out[-1] < most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
    return np.array(out)


@lru_cache(maxsize=1024)
def allotment(low: int, high: int, percent: int) -> tuple[int, int, int]:
    """(H, segments, reserve segments) of a band of sizes low..high-1, by least expected number of keys."""
    apart = (high - 1) * (100 - percent) // percent
    best = None
    for reserve in range(4):
        for spare in range(60 + apart // 8):
            m = apart + 1 + spare
            if reserve > m:
                continue
            mean = m * math.exp(-low / m)  # empty segments of the band's smallest sets, nearly Poisson
            tail, term = 1.0, math.exp(-mean)
            for k in range(spare + reserve + 1):
                tail -= term
                term *= mean / (k + 1)
            if tail <= 1 / SHORT:
                cost = m + reserve * (low + high) / 2 / m
                if best is None or cost < best[0]:
                    best = cost, m, reserve
                break
    if best is None:
        best = 0, apart + 1 + 60 + apart // 8, 0
    return apart, best[1], best[2]


def keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """All keys of a set, of its own band and of the one below where it can be the larger partner."""
    n, edges = len(tokens), bands(percent)
    own = int(np.searchsorted(edges, n, "right")) - 1
    if own < 0:
        return np.zeros(0, np.uint64)
    out = []
    for band in (own, own - 1):
        if band < 0 or band < own and n * percent > 100 * (int(edges[own]) - 1):
            continue
        apart, m, reserve = allotment(int(edges[band]), int(edges[band + 1]), percent)
        with np.errstate(over="ignore"):
            value = mix(tokens + _C1)
            segment = (mix(tokens ^ _C2) % np.uint64(m)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            segment, value = segment[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            sums = np.add.reduceat(value, first)
            place = segment[first]
            salt = mix((np.arange(m, dtype=np.uint64) + np.uint64(band << 32)) * _C3)
            out.append(mix(sums + salt[place]))
            size = np.diff(np.concatenate([first, [n]]))
            allotted = len(first)
            for j in range(min(reserve, len(first))):
                if place[j] < reserve and size[j] >= 2:
                    allotted += 1
                    out.append(mix(sums[j] - value[first[j] : first[j] + size[j]] + salt[place[j]]))
            if allotted < apart + 1:
                empty = np.ones(m, bool)
                empty[place] = False
                out.append(mix(salt[empty] ^ _C2))
    return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit: two sketches differ in no more bits than the sets in shingles. The halves of a sketch, one on the other, are the next smaller one."""
    bits = max(BITS, 1 << (len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((mix(tokens ^ _C3) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def fingerprint(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        both = np.array([np.sum(mix(tokens + _C2), dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)
    return int(mix(both).view(np.int64)[0])


def _sets(batches, words):
    """(batch, set of each row)."""
    for batch in slices(batches, "text", 1 << 20):
        raw, at = text_buffers(batch.column("text"))
        hashes, counts = word_hashes(raw, at)
        ends = np.cumsum(counts)
        yield batch, [shingles(hashes[e - c : e], words) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def _summaries(words):
    def run(batches):
        for batch, sets in _sets(batches, words):
            filled = [bool(len(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if f else None for s, f in zip(sets, filled, strict=True)], pa.int64()), pa.array([sketch(s) if f else None for s, f in zip(sets, filled, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "h", "n", "node", "sketch"],
            )

    return run


def _entries(words, percent):
    def run(batches):
        seen: set[int] = set()  # a copy within a task adds nothing
        for _, sets in _sets(batches, words):
            nodes, found = [], []
            for s in sets:
                if len(s) and (node := fingerprint(s)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(node)
                    found.append(keys(s, percent))
                    nodes.append(np.full(len(found[-1]), node, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return run


def shared_rows(batches):
    """Of a partition sorted by key, then node: the rows of keys with two nodes or more, once for each node. Holds one row back between batches."""
    last = None  # (key, node, given out)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
        if last is not None:
            key, node = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], node])
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        at = np.flatnonzero(fresh)
        key, node = key[at], node[at]
        same = key[1:] == key[:-1]
        give = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        done = last is not None and last[2]  # the row held back has been given out
        shared = bool(give[-1]) or done and len(key) == 1
        if done:
            give[0] = False
        last = (key[-1], node[-1], shared)
        out = np.flatnonzero(give)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], names=["key", "node"])


def _arrays(words):
    def run(batches):
        for batch, sets in _sets(batches, words):
            # Two texts may share a fingerprint.
            kept = {node: s.view(np.int64) for node, s in zip(batch.column("node").to_pylist(), sets, strict=True) if len(s) and fingerprint(s) == node}
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.list_(pa.int64()))], names=["node", "items"])

    return run


def similar(percent: int):
    """Condition on a_n, b_n and `both` (size of the intersection)."""
    return F.col("both") * 100 >= percent * (F.col("a_n") + F.col("b_n") - F.col("both"))


def _near(percent: int):
    """Whether sizes and sketches allow that a and b are similar: |a - b| * (100 + percent) <= (100 - percent) * (|a| + |b|)."""
    least = " + ".join(f"bit_count(a_sk[{i}] ^ b_sk[{i}])" for i in range(BITS // 64))
    # Sizes of similar sets differ by less than half, so one sketch is twice the other at most.
    folded = lambda x, y: f"CASE WHEN size({x}) > size({y}) THEN transform({y}, (v, i) -> {x}[i] ^ {x}[i + size({y})]) ELSE {x} END"
    larger = f"aggregate(zip_with({folded('a_sk', 'b_sk')}, {folded('b_sk', 'a_sk')}, (v, w) -> bit_count(v ^ w)), 0, (s, v) -> s + v)"
    apart = F.abs(F.col("a_n") - F.col("b_n"))
    total = (100 - percent) * (F.col("a_n") + F.col("b_n"))
    bits = F.expr(f"CASE WHEN size(a_sk) = {BITS // 64} AND size(b_sk) = {BITS // 64} THEN {least} ELSE {larger} END")
    return F.when(apart * (100 + percent) <= total, bits * (100 + percent) <= total).otherwise(False)


def components(edges: DataFrame, store: Written) -> DataFrame:
    """edges (a, b) -> node, comp (smallest node reachable), by rounds of large-star and small-star until nothing changes."""
    now = store.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = store.write(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = store.write(small.where(F.col("u") != F.col("v")).distinct(), "small")
        # Done when every node points at one root and no root points on.
        many = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).count()
        if not many and not after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        store.drop(now)
        store.drop(large)
        now = after


def _rest(open_: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar, of nodes outside their bucket's largest component and the others of the bucket."""
    sizes = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("s")).select("key", F.col("s.comp").alias("main"))
    full = open_.join(nodes.select("node", "n", "sk"), "node").join(main, "key")
    side = lambda c: full.select("key", F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"), F.col("n").alias(f"{c}_n"), F.col("sk").alias(f"{c}_sk"), F.col("main").alias(f"{c}_main"))
    x = side("a").where(F.col("a_comp") != F.col("a_main"))
    y = side("b").withColumnRenamed("key", "b_key")
    once = (F.col("b_comp") == F.col("a_main")) | (F.col("a") < F.col("b"))
    return x.join(y, (F.col("key") == F.col("b_key")) & (F.col("a_comp") != F.col("b_comp")) & once & _near(percent)).select("a", "b").distinct()


def _differences(members: DataFrame, arrays: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """members (p, node, comp) -> with d (the symmetric difference of the sets of node and p) and room: a and b are similar if a's and b's room add up to 0 or more."""
    both = members.join(arrays, "node").join(pivots, "p")
    apart = both.select("p", "node", "comp", F.size("items").alias("n"), F.concat(F.array_except("items", "p_items"), F.array_except("p_items", "items")).alias("d"))
    return apart.select("p", "node", "comp", "d", ((100 - percent) * F.col("n").cast("long") - (100 + percent) * F.size("d").cast("long")).alias("room"))


def _widest(apart: DataFrame) -> DataFrame:
    """Of each group p: its largest component (main), the most room inside and outside that, the node with the most room, the group's size."""
    per = apart.groupBy("p", "comp").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("room", "node", "comp")).alias("best"))
    main = per.groupBy("p").agg(F.max(F.struct("m", "comp")).alias("s"), F.max("best").alias("best"), F.sum("m").alias("members"))
    main = main.select("p", F.col("s.comp").alias("main"), F.col("best.room").alias("best_room"), F.col("best.node").alias("best"), F.col("best.comp").alias("best_comp"), "members")
    is_main = F.col("comp") == F.col("main")
    rooms = per.select("p", "comp", "best.room").join(main.select("p", "main"), "p")
    rooms = rooms.groupBy("p").agg(F.max(F.when(is_main, F.col("room"))).alias("inside"), F.max(F.when(~is_main, F.col("room"))).alias("outside"))
    return main.join(rooms, "p")


def _overlapping(full: DataFrame, percent: int) -> DataFrame:
    """full (p, node, comp, d in the group's order, room, main, inside, outside) -> pairs (a, b) of two components whose differences may overlap enough."""
    unit = 2 * (100 + percent)

    def least(room: str, other: str):
        """Members that two differences must share at least."""
        return F.expr(f"greatest(1, ({unit - 1} - {room} - {other}) div {unit})")

    def listed(df: DataFrame, c: str):
        """A row for each member that can be the first one shared: its place in d tells how many may come after."""
        df = df.withColumn("first", F.slice("d", F.lit(1), F.greatest(F.lit(0), F.size("d") + 1 - F.col("need")).cast("int")))
        return df.select(F.col("p").alias(f"{c}_p"), F.col("role").alias(f"{c}_role"), F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"), F.col("room").alias(f"{c}_room"), F.size("d").alias(f"{c}_d"), F.posexplode("first").alias(f"{c}_at", f"{c}_item"))

    out = F.col("comp") != F.col("main")
    roles = F.explode(F.array(F.struct(F.lit(0).alias("role"), least("room", "inside").alias("need")), F.struct(F.lit(1).alias("role"), least("room", "outside").alias("need")))).alias("r")
    x = listed(full.where(out).select("p", "node", "comp", "room", "d", roles).select("p", "node", "comp", "room", "d", "r.role", "r.need"), "a")
    y = listed(full.withColumn("role", F.when(out, 1).otherwise(0)).withColumn("need", least("room", "outside")), "b")
    met = (F.col("a_p") == F.col("b_p")) & (F.col("a_role") == F.col("b_role")) & (F.col("a_item") == F.col("b_item"))
    once = (F.col("a_comp") != F.col("b_comp")) & ((F.col("a_role") == 0) | (F.col("a") < F.col("b")))
    need = least("a_room", "b_room")
    enough = (F.col("a_at") + need <= F.col("a_d")) & (F.col("b_at") + need <= F.col("b_d"))
    return x.join(y, met & once & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def distinct_buckets(buckets: DataFrame) -> DataFrame:
    """One of the buckets (key, node, ...) that hold the same nodes."""
    marks = buckets.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("m"))
    return buckets.join(marks.groupBy("x", "y", "m").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def classes(docs: DataFrame, words: int, percent: int, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, h (the text's fingerprint), n (set size), comp (the component; null for an empty set)."""
    spark = docs.sparkSession
    small_batches(spark)
    store = Written(spark)
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text)
    sets = store.write(rows.mapInArrow(_summaries(words), "doc_id long, h long, n long, node long, sketch array<bigint>"), "sets")
    repeats = not sets.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).isEmpty()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def buckets_of(entries: DataFrame, name: str) -> DataFrame:
        shared = store.write(entries.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(shared_rows, "key long, node long"), name)
        kept = store.write(distinct_buckets(shared), f"{name}-distinct")
        store.drop(shared)
        return kept

    buckets = buckets_of(rows.select("text").mapInArrow(_entries(words, percent), "key long, node long"), "buckets")
    # What the tests of a node need: its size and sketch, and one of its texts.
    taking = buckets.select("node").distinct()
    nodes = sets.join(taking, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("of"), F.first("n").alias("n"), F.first("sketch").alias("sk"))
    nodes = store.write(nodes.select("node", "of.doc_id", "of.h", "n", "sk"), "nodes")

    def held(some: DataFrame) -> DataFrame:
        """node, text of some nodes."""
        of = nodes.join(some, "node", "left_semi").select("node", F.col("doc_id").alias("of_id"), F.col("h").alias("of_h"))
        return rows.join(if_small(store.write(of, "held")), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h"))).select("node", "text")  # rows that repeat come more than once

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of distinct nodes whose sets are similar."""
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sk").alias(f"{c}_sk"))
        near = store.write(pairs.join(side("a"), "a").join(side("b"), "b").where(_near(percent)).select("a", "b", "a_n", "b_n"), "near")
        asked = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        arrays = held(asked).mapInArrow(_arrays(words), "node long, items array<bigint>")
        arrays = store.write(arrays.dropDuplicates(["node"]) if repeats else arrays, "arrays")
        first = near.join(arrays.select(F.col("node").alias("a"), F.col("items").alias("a_items")), "a")
        both = first.join(arrays.select(F.col("node").alias("b"), F.col("items").alias("b_items")), "b")
        found = both.select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_items", "b_items")).alias("both")).where(similar(percent)).select("a", "b")
        found = store.write(found, name)
        store.drop(near)
        store.drop(arrays)
        return found

    def unsettled(members: DataFrame, comp: DataFrame, name: str) -> DataFrame:
        """The buckets of members (key, node) with two components or more: key, node, comp."""
        named = store.write(members.select("key", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named")
        keys_ = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where(F.col("x") != F.col("y")).select("key")
        left = store.write(named.join(keys_, "key", "left_semi"), name)
        store.drop(named)
        return left

    def by_differences(large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of large buckets (key, node, comp): links (a, b) known without a test, and pairs to be tested."""
        # The node of most buckets is near the middle of a group, and the pivot of many of them.
        known_by = large.join(large.groupBy("node").agg(F.count(F.lit(1)).alias("m")), "node")
        pivots = known_by.groupBy("key").agg(F.max(F.struct("m", F.xxhash64("node").alias("h"), "node")).alias("s")).select("key", F.col("s.node").alias("p"))
        members = store.write(large.join(pivots, "key").select("p", "node", "comp").distinct(), "members")
        arrays = held(members.select("node").distinct()).mapInArrow(_arrays(words), "node long, items array<bigint>")
        arrays = store.write(arrays.dropDuplicates(["node"]) if repeats else arrays, "arrays")
        sets_ = store.write(arrays.join(members.select(F.col("p").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("p"), F.col("items").alias("p_items")), "pivots")
        apart = store.write(_differences(members, arrays, sets_, percent), "differences")
        for df in (members, arrays, sets_):
            store.drop(df)
        widest = store.write(_widest(apart), "widest")
        known = apart.join(if_small(widest), "p")
        star = known.where((F.col("comp") != F.col("best_comp")) & (F.col("room") + F.col("best_room") >= 0))
        star = store.write(star.select(F.least("node", "best").alias("a"), F.greatest("node", "best").alias("b")).distinct(), "stars")
        some = known.where(F.pmod(F.xxhash64("node", F.lit(-1)), F.greatest(F.lit(1), F.floor(F.col("members") / SAMPLE))) == 0).select("p", F.explode("d").alias("item"))
        often = some.groupBy("p", "item").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= OFTEN)
        often = store.write(often.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("m", "item"))).alias("o")).select("p", F.col("o.item").alias("often")), "often")
        # The rare members first, then the others by how often they were met.
        full = known.join(often, "p", "left").withColumn("often", F.coalesce("often", F.array().cast("array<bigint>")))
        full = full.withColumn("d", F.concat(F.array_except("d", "often"), F.array_intersect("often", "d")))
        met = store.write(_overlapping(full, percent), "met")
        for df in (apart, widest, often):
            store.drop(df)
        return star, met

    edges: DataFrame | None = None
    comp: DataFrame | None = None
    open_ = buckets.withColumn("comp", F.col("node"))
    for turn in range(ROUNDS):
        rank = F.struct(F.xxhash64(F.col("node"), F.lit(turn)).alias("h"), F.col("node"), F.col("comp"))
        pivots = open_.groupBy("key").agg(F.min(rank).alias("p")).select("key", F.col("p.node").alias("b"), F.col("p.comp").alias("b_comp"))
        pairs = open_.join(pivots, "key").where(F.col("comp") != F.col("b_comp")).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        found = confirmed(pairs, f"links{turn}")
        edges = found if edges is None else edges.unionByName(found)
        comp = components(edges, store)
        before, open_ = open_, unsettled(open_, comp, f"open{turn}")
        store.drop(before)
        if open_.isEmpty():
            break
    else:
        large = open_.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("key")
        large = store.write(open_.join(large, "key", "left_semi"), "large")
        if large.isEmpty():
            pairs = _rest(open_, nodes, percent)
        else:
            near, met = by_differences(large)
            edges = edges.unionByName(near)
            pairs = _rest(open_.join(large.select("key").distinct(), "key", "left_anti"), nodes, percent).unionByName(met).distinct()
        comp = components(edges.unionByName(confirmed(pairs, "links")), store)
        store.drop(large)
        store.drop(open_)
    store.drop(nodes)
    return sets.select("doc_id", "h", "n", "node").join(comp, "node", "left").select("doc_id", "h", "n", F.coalesce("comp", "node").alias("comp"))


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    whole = classes(docs, words, percent)
    smallest = whole.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("least_id"))
    return whole.join(smallest, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least_id", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns of docs: that of the smallest doc_id (null last), then of the text with the smallest fingerprint.

    A row is told by its id and text, so one id may stand for several texts, which stay or go each by its own component.
    Rows that repeat id and text are one (their other columns: the smallest). Texts without words all stay.
    """
    store = Written(docs.sparkSession)
    found = store.write(classes(docs, words, percent), "classes").where(F.col("comp").isNotNull())
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    first = found.groupBy("comp").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    first = store.write(first.select("comp", F.col("f.doc_id").alias("f_id"), F.col("f.h").alias("f_h")), "firsts")
    is_first = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    members = found.join(first, "comp").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("m"), F.first(is_first).alias("stays"))
    # What goes, and what stays once though it stands in several rows.
    marked = store.write(members.where(~F.col("stays") | (F.col("m") > 1)).select(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"), "stays"), "marked")
    own = docs.select(*docs.columns)
    same = own["doc_id"].cast("long").eqNullSafe(marked["m_id"]) & (F.xxhash64(own["text"].cast("string")) == marked["m_h"])
    kept = own.join(if_small(marked), same, "left_anti")
    again = marked.where("stays")
    if again.isEmpty():
        return kept
    names = docs.columns
    once = own.join(if_small(again), same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*[c for c in names if c not in ("doc_id", "text")])).alias("rest"))
    return kept.unionByName(once.select(*[c if c in ("doc_id", "text") else F.col(f"rest.{c}").alias(c) for c in names]))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
ORACLES = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + {WORDS - 1}], ' ') FOR i IN range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)]) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n_both >= {PERCENT} * (len(p.s) + len(q.s) - n_both)),
sides AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least_id AS component_id FROM sets JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) ON a = doc_id
"""
}
