"""Mixing sources to target weights by systematic sampling.

Sources get targets in words; inside a source every document expects
``target / source size`` copies. Documents stand in order of size, expected
copies are summed along that order, one random offset is added, and a document
is emitted once for each integer that its stretch of the sum crosses. As
neighbours in the order are of like size, the words taken come near the target
and not only the number of documents. Only DataFrame functions are used.

A source may hold any share of the rows: its documents are summed in blocks
of about ``BLOCK_ROWS``, and only the blocks' counts are summed along a source.

Defined results: a null text has size 0; a null source is a source, the last
in order; sources without words take nothing; equal rows may take different
numbers of copies, but the same ones in each run; where more than 16,000 rows
are equal in key, size and text, which of them take more follows the layout of
the input; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import boxed, small, text_or_empty, unboxed, with_row_key, word_count, written

#: The weights, repeated along the sources in order, and the most copies of a source.
WEIGHTS, MAX_COPIES = (5, 2, 1), 3

BLOCK_ROWS = 4_000
MAX_BROADCAST_SOURCES = 100_000


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in the given order, without ever
    having all of them in one task: ranges are counted, then numbered."""
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition of the range exchange
    before = counts.select(
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    numbered = ranges.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return (
        numbered.join(small(before, 100_000), F.col("_range") == F.col("_r"))
        .withColumn(rank, F.col("_before") + F.col("_row") - 1)
        .drop("_range", "_r", "_row", "_before")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source of ``(source, size)``: its rows, size, target and rate.

    What a target is above ``max_copies`` times its source's size is shared
    out anew by weight until no target is above: each round raises the words
    per weight and can only add capped sources, so it ends.
    """
    by_source = written(
        sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "sources"
    )
    by_source = written(
        ranked(by_source, [F.col("source").asc_nulls_last()], "_rank", "sources-ranked").withColumn(
            "weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
        ),
        "sources-weighed",
    )
    cap = max_copies * F.col("source_size")
    per_weight = 0.0
    while True:
        above = F.col("weight") * F.lit(per_weight) >= cap
        got = by_source.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        now = (got["all"] - got["capped"]) / got["weights"] if got["weights"] else per_weight
        if now <= per_weight:
            break
        per_weight = now
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(per_weight)))
    return by_source.select(
        "source", "n_docs", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def copies(sizes: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (``source``, ``size``, ``doc_id``, ``_hash``, ``_rid``;
    written) with ``source_size``, ``target`` and the number of ``copies`` taken.

    The order within a source is by class of size, then by block of a hash of
    the row, then by size. A block that equal rows have swelled is split by row
    key. Counts are summed over the blocks of a class, then over the classes.
    """
    blocks = max(1, -(-sizes.count() // BLOCK_ROWS))
    dealt = sizes.withColumn("_class", F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int")).withColumn(
        "_block", F.pmod(F.xxhash64("doc_id", "size", "_hash"), F.lit(blocks)).cast("int")
    )
    null_safe = lambda keys, mark: F.expr(" and ".join(f"{k} <=> {mark}{k}" for k in keys))
    part = ["source", "_class", "_block"]
    swelled = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 4 * BLOCK_ROWS)
    swelled = written(swelled.select(*[F.col(k).alias(f"w{k}") for k in part], F.ceil(F.col("_n") / BLOCK_ROWS).alias("_parts")), "mix-swelled")
    dealt = dealt.join(small(swelled, MAX_BROADCAST_SOURCES), null_safe(part, "w"), "left").withColumn("_part", F.pmod(F.xxhash64("_rid"), F.coalesce("_parts", F.lit(1))).cast("int"))
    placed = dealt.drop(*[f"w{k}" for k in part], "_parts")
    key = [*part, "_part"]
    counted = written(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), "mix-blocks")
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = counted.groupBy("source", "_class").agg(F.sum("_n").alias("_n"))
    classes = classes.select(F.col("source").alias("csource"), F.col("_class").alias("c_class"), earlier(Window.partitionBy("source").orderBy("_class")).alias("_low"))
    within = counted.select(*key, earlier(Window.partitionBy("source", "_class").orderBy("_block", "_part")).alias("_in"))
    before = within.join(classes, null_safe(["source", "_class"], "c")).select(*[F.col(k).alias(f"b{k}") for k in key], (F.col("_low") + F.col("_in")).alias("_before"))
    rates = targets(sizes, weights, max_copies).select(F.col("source").alias("_source"), "source_size", "target", "rate")
    numbered = placed.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id", "_hash", "_rid")))
    joined = numbered.join(before, null_safe(key, "b"))
    joined = joined.join(small(rates, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
    place = F.col("_before") + F.col("_row")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("_source", F.lit("\0"))), F.lit(1 << 30)) / float(1 << 30)
    crossed = lambda n: F.floor(n * F.col("rate") + offset)
    taken = F.greatest(F.least(crossed(place) - crossed(place - 1), F.ceil("rate"), F.lit(max_copies)), F.lit(0)).cast("long")
    return joined.withColumn("copies", taken).drop(*[f"b{k}" for k in key], *key[1:], "_before", "_row", "_source", "rate", "_hash")


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text_or_empty(text)).alias("size"), F.xxhash64(text).alias("_hash")
    )


def report(docs: DataFrame, seed: int = 7) -> DataFrame:
    """A row per document: its size, its source's size and target, words taken."""
    sizes = written(with_row_key(sized(docs)), "sizes")
    return copies(sizes, seed).select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken")
    )


def emit(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    whole = written(with_row_key(boxed(docs).withColumn("_size", word_count(text_or_empty("_row.text"))).withColumn("_hash", F.xxhash64("_row.text"))), "mix-rows")
    sizes = whole.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), F.col("_size").alias("size"), "_hash", "_rid")
    taken = copies(sizes, seed).filter(F.col("copies") > 0).select(F.col("_rid").alias("_key"), "copies")
    joined = whole.join(taken, F.col("_rid") == F.col("_key"))
    return unboxed(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
