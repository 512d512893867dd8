"""Mixing sources to target weights.

Every document gets a hash-random key (md5 of its id and a seed). Rows are range-sorted by source and key, each
partition sums its own part, the partitions' totals give each partition's offset, and so every document knows the words
of its source before it. A source is cut at its exact budget: as many whole epochs as fit, then the words of the first
documents in key order, the last of them in part. A hot source spans many ranges; nothing of it meets in one task but
one total for each partition.

Targets: the sources in code point order (null last) weigh 1, 2, 3, repeating. They share all words by weight; a target
stops at `most` times its source's words and the excess is shared again. That is min(most * S, level * weight) for one
level, found over one row per source.

Null text has 0 words, takes nothing and stays in the result; a null source is a source; repeated rows count each; an
empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.llm.common import WORD, Written, count_words, small_batches, table

CYCLE, MOST, SEED = 3, 3, "mix-1"
#: A table of up to this many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
_WORD = re.compile(WORD)
_RUN = "doc_id long, source string, size long, mix_key string, part int, before long"


def _running(batches):
    """Words of the same source before each row of a sorted partition, and the partition's number."""
    part, last, total = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        source = batch.column("source").to_pylist()
        before = np.empty(len(size), np.int64)
        first = 0
        turns = [i for i in range(1, len(source)) if source[i] != source[i - 1]] + [len(source)]
        for end in turns:
            if source[first] != last:
                last, total = source[first], 0
            sums = np.cumsum(size[first:end])
            before[first:end] = total + sums - size[first:end]
            total += int(sums[-1])
            first = end
        columns = [*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(before)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "size", "mix_key", "part", "before"])


def targets(sizes: DataFrame, most: int = MOST, cycle: int = CYCLE) -> DataFrame:
    """One row per source (source, source_size) -> with weight, target and budget (whole words)."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", ((F.row_number().over(every) - 1) % cycle + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    # Full sources come first in this order, so the first other one has the final level.
    final = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(final * F.col("weight"), F.col("cap").cast("double")))
    return leveled.withColumn("target", target).select("source", "source_size", "weight", "target", F.round("target").cast("long").alias("budget"))


def _key(seed: str):
    """The hash-random key of a document."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 16)


def _placed(docs: DataFrame, most: int, seed: str) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, mix_key, source_size, target, epochs (whole repeats), part (words taken beyond them)."""
    spark = docs.sparkSession
    small_batches(spark)
    store = Written(spark)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), _key(seed).alias("mix_key"))
    order = ["source", "mix_key", "doc_id", "size"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = store.write(sized, "sizes")  # else sampling for the ranges would count all words again
    runs = store.write(sized.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_running, _RUN), "runs")
    store.drop(sized)
    parts = runs.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    goals = targets(runs.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    named = parts.alias("p").join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.source", "p.part", "p.offset", "g.source_size", "g.target", "g.budget")
    placed = runs.alias("r").join(named.alias("n"), (F.col("r.part") == F.col("n.part")) & F.col("r.source").eqNullSafe(F.col("n.source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    placed = placed.select("r.doc_id", "r.source", "r.size", "r.mix_key", (F.col("r.before") + F.col("n.offset")).alias("before"), "n.source_size", "n.target", "n.budget", epochs.alias("epochs"))
    return placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before"))))


def mix(docs: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, taken, epochs (whole repeats), source."""
    return _placed(docs, most, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("part")).alias("taken"), "epochs", "source")


def _repeat(batches):
    """Whole copies of each text, then its first words where the cut falls inside."""
    for batch in batches:
        rows = batch.to_pydict()
        names = [n for n in rows if n not in ("size", "taken")]
        out = {n: [] for n in names}
        for i, (text, size, taken) in enumerate(zip(rows["text"], rows["size"], rows["taken"], strict=True)):
            for k in range(-(-taken // size) if size else 0):
                rest = taken - k * size
                cut = text if rest >= size else text[: next(m.end() for j, m in enumerate(_WORD.finditer(text), 1) if j == rest)]
                for n in names:
                    out[n].append(rows[n][i])
                out["text"][-1], out["n_chars"][-1] = cut, len(cut)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([batch.schema.field(n) for n in names]))


def mixed(docs: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) as the mix takes them: a row for each epoch; the row at a source's cut has its first words. Texts without words go.

    A source's cut is one place in its order of keys, so texts stay where they are: each row compares its own place with the
    cut of its source. Rows of one id, source and size stand at one place and all get the largest share of them.
    """
    store = Written(docs.sparkSession)
    rows = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))))
    place = F.struct("mix_key", "doc_id", "size")
    last = F.max(F.when(F.col("part") > 0, F.struct(place.alias("place"), "part")))
    cuts = _placed(rows, most, seed).groupBy("source").agg(F.max("epochs").alias("epochs"), last.alias("cut"))
    cuts = store.write(cuts.select(F.col("source").alias("of"), "epochs", F.col("cut.place").alias("cut"), F.col("cut.part").alias("part")), "cuts")
    sized = rows.withColumn("size", count_words(F.col("text"))).withColumn("mix_key", _key(seed))
    found = sized.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts, F.col("source").eqNullSafe(F.col("of")))
    own = F.when(place < F.col("cut"), F.col("size")).when(place.eqNullSafe(F.col("cut")), F.col("part")).otherwise(F.lit(0))
    taken = found.select(*rows.columns, "size", (F.col("size") * F.col("epochs") + own).alias("taken"))
    return taken.where(F.col("taken") > 0).mapInArrow(_repeat, rows.schema)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {
    "op3_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 16) AS k
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {CYCLE} + 1)::BIGINT AS weight, source_size * {MOST} AS cap FROM sums),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ranked WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap::DOUBLE / weight <= level AS is_full FROM leveled),
goals AS (
  SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE least((SELECT arg_min(level, cap::DOUBLE / weight) FROM marked WHERE NOT is_full) * weight, cap::DOUBLE) END AS target FROM marked),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target, (size * epochs + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM cut
"""
}
