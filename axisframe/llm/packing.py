"""Packing token sequences by minimum bin slack.

Documents become token ids with one end id, and only those longer than a
sequence are cut. Bins depend on lengths alone, so the bins are planned on the
histogram of lengths, which has at most ``capacity`` entries however many
pieces there are. For a bin the largest length left is fixed, a dynamic program
on bitsets over the lengths available finds the fullest sum that fits beside
it, and the combination found is removed as many times as the counts allow.
Pieces then get places by their rank among pieces of equal length.

Defined results: a null text is empty and gives the end id alone; equal rows
are packed one by one; an empty table gives an empty result; further columns
are left out.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import text_or_empty, with_row_key, written

CAPACITY, END_ID = 2048, 0

ROWS_PER_BLOCK = 4_000


def encoder(ranks_path: str | None = None):
    """The byte-level BPE of 50,257 ids. The vocabulary is read in its form
    for tiktoken, whose ids are those of the form for tokenizers."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``_rid, doc_id, piece, start, length, ids_crc32`` of every piece, and
    its ``ids`` if asked for."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(ranks_path)
        names = ["_rid", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
        for batch in batches:
            rows = []
            for rid, doc_id, text in zip(batch["_rid"], batch["doc_id"], batch["_text"]):
                ids = np.append(own.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4"), np.uint32(END_ID))
                for k, (at, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[at : at + n]
                    rows.append((rid, doc_id, k, at, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=names)

    # keys pass as text: pandas would turn numbers beside nulls into floats
    rows = with_row_key(docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("_text")))
    shape = "_rid long, doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return rows.mapInPandas(encode, shape).withColumn("doc_id", F.col("doc_id").cast("long"))


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination with the largest sum up to ``room``.

    Bit s of a state is set if s is the sum of some pieces of the lengths so
    far; doubling steps add up to ``counts`` pieces of a length.
    """
    mask = (1 << (room + 1)) - 1
    lengths = [x for x in sorted(counts, reverse=True) if x <= room]
    states, state = [], 1
    for x in lengths:
        states.append(state)
        most = min(counts[x], room // x)
        step = 1
        while most > 0:
            step = min(step, most)
            state |= (state << (x * step)) & mask
            most -= step
            step *= 2
        if state >> room & 1:
            break
    left = state.bit_length() - 1
    chosen = []
    for x, before in zip(reversed(lengths[: len(states)]), reversed(states)):
        times = 0
        while not before >> left & 1:
            left -= x
            times += 1
        if times:
            chosen.append((x, times))
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, combination) until all pieces are in bins. The number
    of combinations depends on the distinct lengths, not on the counts."""
    counts = {x: n for x, n in histogram.items() if n}
    bins = []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        chosen = dict(fullest({x: n for x, n in counts.items() if n}, capacity - largest))
        counts[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        bins.append((times, sorted(chosen.items(), reverse=True)))
    return bins


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (written pieces) with ``sequence_id`` and ``offset``."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    bins = plan(histogram, capacity)
    # per length: ranks from `low` on belong to bins from `first` on, `times` in each, the first of them at `offset`
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for n, combination in bins:
        offset = 0
        for x, times in combination:
            table.setdefault(x, []).append((used.get(x, 0), first, times, offset))
            used[x] = used.get(x, 0) + times * n
            offset += x * times
        first += n
    tables = {x: np.array(rows, np.int64) for x, rows in table.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for x, at in batch.groupby("length").indices.items():
                rank, rows = batch["_rank"].to_numpy()[at], tables[x]
                low, start, times, base = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1].T
                sequence[at] = start + (rank - low) // times
                offset[at] = base + (rank - low) % times * x
            yield batch.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    ranked = _ranks(found).withColumn("doc_id", F.col("doc_id").cast("string"))
    shape = ", ".join(f"`{f.name}` {'string' if f.name == 'doc_id' else f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, shape).withColumn("doc_id", F.col("doc_id").cast("long"))


def _ranks(found: DataFrame) -> DataFrame:
    """``_rank`` from 0 among pieces of equal length. A length may be that of
    any share of the pieces: they are ranked in blocks, whose counts are summed."""
    blocks = max(1, -(-found.count() // ROWS_PER_BLOCK))
    key = ["length", "_block"]
    dealt = found.withColumn("_block", F.pmod(F.xxhash64("_rid", "piece"), F.lit(blocks)).cast("int"))
    before = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("length").alias("_length"), F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    numbered = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy("_rid", "piece")))
    joined = numbered.join(before, (F.col("length") == F.col("_length")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("_rank", (F.col("_before") + F.col("_row") - 1).cast("long")).select(*found.columns, "_rank")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from placed pieces with ``ids``: at
    most ``capacity`` ids each."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"))


def report(docs: DataFrame) -> DataFrame:
    """A row per piece with its place, without the ids."""
    return placed(written(pieces(docs), "pieces")).drop("_rid")
