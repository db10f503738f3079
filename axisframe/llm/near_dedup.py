"""Near-duplicate documents by circulant MinHash, banding and exact checks.

A text's set holds hashes of its shingles of ``width`` words (2 in the query). Rows with one and the same
set form a class, and only classes are compared. Coordinate ``k`` of a
signature is the least ``pi(sigma(x) + k)`` over the set: ``sigma`` and ``pi``
are two fixed permutations of the 32-bit numbers, and adding ``k`` modulo 2^32
shifts ``pi`` circularly. ``BANDS`` bands of ``ROWS`` coordinates name buckets:
a pair at the threshold of 0.8 misses all of them with probability 1e-7.

No bucket's pairs are written out. First every class of a bucket is checked
against the smallest one only; what that links is contracted to components,
and the smallest one's pairs are settled. Where the others of a bucket are then
still in several components, they are compared in blocks inside tasks: of pairs
of different components that meet in no earlier bucket and whose signatures come
near the threshold the full sets are compared there, and only links that join
components leave.
All links are confirmed on the full sets of both texts, and components are
found by alternating large-star and small-star rounds on tables.

Defined results: a null or empty text, or one of white space, has an empty set
and is linked with nothing; one word is a set of one; equal rows form a class;
a null key is the largest and marks a component only where all keys are null;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import boxed, looked_up, small, text_or_empty, unboxed, with_row_key, written

BANDS, ROWS = 40, 5
SIZE = BANDS * ROWS
#: The low bits of a bucket's number are its band.
BAND_BITS, BAND_MASK = 6, 63

#: A link needs 100 * intersection >= 80 * union.
PERCENT = 80

#: Least agreeing coordinates of a pair worth an exact check: five standard deviations below the threshold.
LEAST_EQUAL = int(SIZE * PERCENT / 100 - 5 * (SIZE * 0.8 * 0.2) ** 0.5)

#: Rows of a block of a bucket.
BLOCK = 800
#: Rows of at most some 40 bytes, so 8 MB of a broadcast.
BROADCAST_ROWS = 200_000
#: Rows of one key beyond which a join does not leave them to one task.
HOT_ROWS = 20_000


class _WordHashes(dict):
    """64-bit hashes of words, kept while there are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, cache: _WordHashes, width: int = 2) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of fewer than ``width``
    words the whole is one. For bytes, lower() changes A-Z only and split()
    cuts at 0x20 and 0x09-0x0D only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    if k > 1:
        n = len(h) - k + 1
        words_, h = h, h[:n]
        for i in range(1, k):
            b = words_[i : i + n]
            h = h * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33)))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers; changes ``x`` in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(items: np.ndarray) -> bytes:
    """The circulant MinHash signature of a set: a byte of each coordinate.

    Equal coordinates have equal bytes; bands, buckets and comparisons all go
    by the bytes, so what the others would find is found by them too."""
    start = _permute((items ^ (items >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shifts = np.arange(SIZE, dtype=np.uint32)[:, None]
    least = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(start), 512):  # so that a block stays in the cache, however long the text
        block = _permute(start[None, i : i + 512] + shifts, 0x7FEB352D, 0x846CA68B)
        np.minimum(least, block.min(axis=1), out=least)
    return least.astype(np.uint8).tobytes()


def _signed(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _WordHashes()
        for batch in batches:
            rows = []
            for rid, text in zip(batch["_rid"], batch["_text"]):
                items = shingle_set(text, cache, width)
                n = len(items)
                rows.append((rid, n, xxhash.xxh3_128_digest(items.tobytes()) if n else None, signature(items) if n else None))
            yield pd.DataFrame(rows, columns=["_rid", "n", "cid", "sig"])

    return run


def _linked(width: int):
    """The pairs whose full sets are near enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _WordHashes()
        last, kept = None, None
        for batch in batches:
            good = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
                if b != last:
                    last, kept = b, shingle_set(tb, cache, width)
                own = shingle_set(ta, cache, width)
                both = len(np.intersect1d(own, kept, assume_unique=True)) if 100 * min(len(own), len(kept)) >= PERCENT * max(len(own), len(kept)) else 0
                good.append(100 * both >= PERCENT * (len(own) + len(kept) - both))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    return run


def _near(batch: pd.DataFrame, width: int) -> pd.DataFrame:
    """Of one block, or of two blocks of a bucket, links that join components.

    A pair of like sizes and different roots is looked at in the first band
    only in which its signatures agree, then by its signatures as a whole, and
    last by its full sets."""
    i, j, band = batch["x"].iloc[0], batch["y"].iloc[0], int(batch["bucket"].iloc[0]) & BAND_MASK
    c, n, block, texts = (batch[k].to_numpy() for k in ("c", "n", "block", "_text"))
    root = batch["root"].to_numpy().copy()
    sig = np.frombuffer(b"".join(batch["sig"]), np.uint8).reshape(len(batch), SIZE)
    earlier = sig[:, : band * ROWS].reshape(len(batch), band, ROWS).astype(np.uint64) @ (1 << np.arange(0, 8 * ROWS, 8, dtype=np.uint64))
    cache, sets, found = _WordHashes(), {}, []

    def full(at: int) -> np.ndarray:
        if at not in sets:
            sets[at] = shingle_set(texts[at], cache, width)
        return sets[at]

    second = np.flatnonzero(block == j)
    least, most = -(-n * PERCENT // 100), n * 100 // PERCENT
    for k in np.flatnonzero(block == i):
        own = second[second > k] if i == j else second
        at = own[(root[own] != root[k]) & (n[own] >= least[k]) & (n[own] <= most[k])]
        if band and len(at):
            at = at[~(earlier[at] == earlier[k]).any(axis=1)]
        if len(at):
            at = at[np.count_nonzero(sig[at] == sig[k], axis=1) >= LEAST_EQUAL]
        for m in at:
            if root[m] != root[k]:
                a, b = full(k), full(m)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= PERCENT * (len(a) + len(b) - both):
                    found.append((max(c[k], c[m]), min(c[k], c[m])))
                    root[root == root[m]] = root[k]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = 2) -> DataFrame:
    """The pairs (``a``, ``b``) of row keys whose texts are near duplicates.

    ``b`` may be in very many pairs: of such with over ``HOT_ROWS`` the text is
    repeated, a salt for each ``HOT_ROWS`` of its pairs, and each of these goes
    to one salt. ``pairs`` is a written table."""

    def own(end: str) -> DataFrame:
        needed = small(pairs.select(F.col(end).alias("_need")).distinct(), BROADCAST_ROWS)
        return texts.join(needed, F.col("_rid") == F.col("_need"), "left_semi")

    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > HOT_ROWS)
    many = small(written(many.select(F.col("b").alias("_hot"), F.ceil(F.col("_size") / HOT_ROWS).alias("_salts")), "hot"), BROADCAST_ROWS)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = pairs.join(many, F.col("b") == F.col("_hot"), "left").select("a", "b", F.pmod(F.xxhash64("a"), salts).alias("salt"))
    centres = own("b").join(many, F.col("_rid") == F.col("_hot"), "left")
    centres = centres.select(F.col("_rid").alias("_b"), F.col("_text").alias("tb"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"))
    full = dealt.join(own("a").select(F.col("_rid").alias("_a"), F.col("_text").alias("ta")), F.col("a") == F.col("_a")).drop("_a")
    full = full.join(centres, (F.col("b") == F.col("_b")) & (F.col("salt") == F.col("_salt"))).select("a", "b", "ta", "tb")
    return full.mapInPandas(_linked(width), "a long, b long")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``node, root`` for all ends of ``edges`` (``a``, ``b``): the root is the
    smallest node reachable. Large-star and small-star rounds alternate until
    the edges no longer change; then they are stars around the roots.

    A node's least neighbour is broadcast where twice the edges, so all nodes
    too, are at most ``BROADCAST_ROWS``; beyond that for the nodes of over
    ``HOT_ROWS`` edges only."""

    def round_(pairs: DataFrame, both: bool, few: bool) -> DataFrame:
        # pairs (u, v) with u > v; for large stars a node also sees its larger neighbours
        seen = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else pairs
        least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_size")).select(F.col("u").alias("_key"), F.least("u", "m").alias("m"), "_size")
        joined = seen.join(F.broadcast(least), F.col("u") == F.col("_key")) if few else looked_up(seen, "u", written(least, "least"), BROADCAST_ROWS, HOT_ROWS)
        if both:  # larger neighbours go to the least
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # smaller neighbours and the node itself go to the least
            out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return out.filter("u > v").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())

    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), name)
    before = mark(pairs)
    while True:
        few = 2 * before[0] <= BROADCAST_ROWS
        half = round_(pairs, True, few)
        pairs = written(round_(half if few else written(half, name), False, few), name)
        after = mark(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def links(classes: DataFrame, texts: DataFrame, width: int = 2) -> DataFrame:
    """Confirmed links (``a``, ``b``) that connect the classes (``c``, ``n``,
    ``sig``) just as all pairs near enough would."""
    key = lambda i: F.shiftleft(F.xxhash64(i, F.substring("sig", i * ROWS + 1, F.lit(ROWS))), BAND_BITS).bitwiseOR(i.cast("long"))
    places = classes.select("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("bucket"))
    facts = [F.min("c").alias("least"), F.max("c").alias("most"), F.bit_xor("c").alias("odd"), F.count(F.lit(1)).alias("_size")]
    shared = written(places.groupBy(F.col("bucket").alias("_key")).agg(*facts).filter("least < most"), "buckets")
    # members but the smallest; of up to three classes they follow from these facts, so that only larger buckets are looked up again
    few = F.when(F.col("_size") == 2, F.array("most")).otherwise(F.array("most", F.col("least").bitwiseXOR(F.col("most")).bitwiseXOR(F.col("odd"))))
    members = shared.filter("_size <= 3").select(F.col("_key").alias("bucket"), F.explode(few).alias("c"), "least")
    large = looked_up(places, "bucket", shared.filter("_size > 3").select("_key", "least", "_size"), BROADCAST_ROWS, HOT_ROWS)
    members = written(members.unionByName(large.filter("c > least").select("bucket", "c", "least")), "members")
    stars = written(confirmed(written(members.select(F.col("c").alias("a"), F.col("least").alias("b")).distinct(), "pairs"), texts, width), "links")
    roots = components(stars).select(F.col("node").alias("_node"), "root")
    placed = members.join(small(roots, BROADCAST_ROWS), F.col("c") == F.col("_node"), "left").select("bucket", "c", F.coalesce("root", "c").alias("root"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
    mixed = mixed.select(F.col("bucket").alias("_bucket"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rest = placed.join(small(written(mixed, "mixed"), BROADCAST_ROWS), F.col("bucket") == F.col("_bucket")).drop("_bucket")
    rest = written(rest, "rest")
    needed = small(rest.select(F.col("c").alias("_need")).distinct(), BROADCAST_ROWS)
    facts = classes.select(F.col("c").alias("_c"), "n", "sig").join(needed, F.col("_c") == F.col("_need"), "left_semi")
    facts = facts.join(texts.join(needed, F.col("_rid") == F.col("_need"), "left_semi"), F.col("_c") == F.col("_rid")).drop("_rid")
    rest = rest.join(facts, F.col("c") == F.col("_c")).drop("_c").withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("x"), F.greatest(o, "block").alias("y")))
    rest = rest.withColumn("_m", F.explode(meets)).select("bucket", F.col("_m.x").alias("x"), F.col("_m.y").alias("y"), "block", "c", "root", "n", "sig", "_text")
    return stars.unionByName(rest.groupBy("bucket", "x", "y").applyInPandas(lambda batch: _near(batch, width), "a long, b long"))


def _order(key: Column) -> Column:
    return F.struct(key.isNull().alias("unknown"), key.alias("id"), F.col("_rid").alias("rid"))


def grouped(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """For written ``rows`` with ``_rid``: ``_rid``, ``n`` and ``first``, the
    ``id`` and ``rid`` of the first row of the row's component."""
    texts = rows.select("_rid", text_or_empty(text).alias("_text"))
    signed = written(texts.mapInPandas(_signed(width), "_rid long, n long, cid binary, sig binary"), "signatures")
    ids = rows.select("_rid", F.col(doc_id).alias("_id"))
    full = signed.filter("n > 0")
    owners = ids.join(full.select(F.col("_rid").alias("_r"), "cid"), F.col("_rid") == F.col("_r")).drop("_r")
    sizes = F.count(F.lit(1)).alias("_size")
    by_class = written(owners.groupBy("cid").agg(F.min("_rid").alias("c"), F.min(_order(F.col("_id"))).alias("first"), sizes), "classes")
    reps = written(full.select("_rid", "n", "sig").join(by_class.select("c"), F.col("_rid") == F.col("c")).select("c", "n", "sig"), "representatives")
    roots = components(written(links(reps, texts, width), "links"))
    linked = written(by_class.select("cid", "c", "first").join(roots, F.col("c") == F.col("node")).select("cid", "root", "first"), "linked")
    least = written(linked.groupBy(F.col("root").alias("_key")).agg(F.min("first").alias("least"), sizes), "least")
    led = looked_up(linked, "root", least, BROADCAST_ROWS, HOT_ROWS).select(F.col("cid").alias("_cid"), "least")
    firsts = by_class.join(led, F.col("cid") == F.col("_cid"), "left").select(F.col("cid").alias("_key"), F.coalesce("least", "first").alias("least"), "_size")
    whole = looked_up(signed.select("_rid", "n", "cid"), "cid", written(firsts, "firsts"), BROADCAST_ROWS, HOT_ROWS, "left")
    return whole.select("_rid", "n", F.col("least.id").alias("first_id"), F.col("least.rid").alias("first_rid"))


def report(docs: DataFrame) -> DataFrame:
    """A row per document: size of its set, smallest key of its component."""
    rows = written(with_row_key(docs.select("doc_id", "text")), "dedup-rows")
    found = grouped(rows).withColumnRenamed("_rid", "_key")
    out = rows.select("_rid", "doc_id").join(found, F.col("_rid") == F.col("_key"))
    component = F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_rows(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest key;
    rows with empty sets stay. Shingles have ``width`` words."""
    rows = written(with_row_key(boxed(docs)), "dedup-rows")
    gone = grouped(rows, "_row.doc_id", "_row.text", width).filter("n > 0 and _rid <> first_rid").select(F.col("_rid").alias("_key"))
    gone = small(written(gone, "gone"), BROADCAST_ROWS)
    return unboxed(rows.join(gone, F.col("_rid") == F.col("_key"), "left_anti"))
