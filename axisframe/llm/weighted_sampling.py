"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by how often a text has them. For coordinate ``k``
and a term the random values r, c ~ Gamma(2, 1) and b ~ U(0, 1) follow from a
hash of both alone; r and c are drawn as -ln(u v) from uniform u and v, so that
their tails, which decide the minimum of a long text, are not cut. With t = floor(ln(weight) / r + b) the sample of a term is
ln(a) = ln(c) - r (t - b + 1), and the smallest one over the text's terms is
the coordinate. The minimum names its term and t, as equal values come only
from equal (term, t), so two texts agree in a coordinate with the probability
of their generalised Jaccard similarity: sum of smaller over sum of larger
weights. Only DataFrame functions are used.

Most samples need no logarithm: ``a >= c exp(-r) / weight`` and
``-ln u >= 2 (1 - u) / (1 + u)`` bound a sample from below by its uniform values
alone, and the minimum of a text of W words exceeds ``BOUND / W`` with
probability exp(-BOUND) only. Samples that cannot be below that are left out;
a text that lacks a coordinate then is signed again without the bound.

Only keys are put in order, by range; a text moves to the document before it,
and both to where they are signed, by exchanges on a row key that has no
repeats, so neither equal keys nor the number of documents make a task large.
Texts are read from ``docs`` again instead of from a copy. A row is the one
meant if row key and hash of the text agree, so that its text is right
whatever order a second read has; if rows do not find theirs in it, as the
source was dealt out otherwise, a copy is written and used.

Defined results: a null text is empty, all empty texts share one fingerprint;
a null key comes first in order; equal keys are ordered by a hash of their text,
equal rows by their place; an only document is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, small, text_or_empty, with_row_key, written

#: Coordinates of a signature.
SIZE = 64
#: Samples are computed in full if they can be below BOUND / words of the text.
BOUND = 14.0
BROADCAST_ROWS = 200_000


def coordinate(k: int, seed: int, bounded: bool) -> Column:
    """The sample of ``_term`` with weight ``_wt`` (its logarithm ``_lw``) for
    coordinate ``k``: 2 x 32 bits of one 64-bit hash make v and so r, 2 x 21
    bits of another make u and so c, and its other 22 make b; a uniform value is
    the middle of its step. If ``bounded``, null if sure to be above ``_most``."""
    one, two = (f"xxhash64(_term, {seed * 1_000_003 + 2 * k + i})" for i in (0, 1))
    part = lambda h, shift, n: f"((shiftrightunsigned({h}, {shift}) & {(1 << n) - 1}L) + 0.5D)"
    v = f"({part(one, 32, 32)} * {part(one, 0, 32)} * {2.0**-64!r}D)"
    u = f"({part(two, 43, 21)} * {part(two, 22, 21)} * {2.0**-42!r}D)"
    b = f"({part(two, 0, 22)} * {2.0**-22!r}D)"
    # a weight of 1 gives t = 0
    steps = f"if(_wt = 1, 1D - {b}, floor(_lw / -ln({v}) + {b}) - {b} + 1D)"
    sample = f"ln(-ln({u})) + ln({v}) * {steps}"
    return F.expr(f"if((1D - {u}) * {v} * 2D <= _most * _wt * (1D + {u}), {sample}, null)" if bounded else sample)


def signatures(texts: DataFrame, keys: list[str], text: str = "_text", size: int = SIZE, seed: int = 1, bound: float | None = None) -> DataFrame:
    """Per combination of ``keys``: ``signature``, 16 bits for each
    coordinate, and ``open``, whether ``bound`` left a coordinate of a text with
    words without a sample. No exchange if ``texts`` is dealt by some of the ``keys``."""
    words = texts.select(*keys, F.split(text, f"[{SPACE}]+").alias("_ws")).select(*keys, F.size("_ws").alias("_n"), F.explode("_ws").alias("_w"))
    # a text without words keeps one row with a null term, whose null weight gives no sample
    terms = words.select(*keys, "_n", F.when(F.col("_w") != "", F.xxhash64("_w")).alias("_term"))
    weight = F.when(F.col("_term").isNotNull(), F.count(F.lit(1)).cast("double"))
    terms = terms.groupBy(*keys, "_n", "_term").agg(weight.alias("_wt"))
    terms = terms.select(*keys, "_term", "_wt", F.log("_wt").alias("_lw"), (F.lit(bound) / F.col("_n")).alias("_most"))
    sample = lambda k: coordinate(k, seed, bound is not None)
    least = terms.groupBy(*keys).agg(F.count("_term").alias("_known"), *[F.min(sample(k)).alias(f"_s{k}") for k in range(size)])
    minima = F.array(*[F.col(f"_s{k}") for k in range(size)])
    digits = F.transform(minima, lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(0xFFFF))), 4, "0"))
    return least.select(*keys, F.unhex(F.array_join(digits, "")).alias("signature"), ((F.col("_known") > 0) & F.exists(minima, lambda x: x.isNull())).alias("open"))


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """The share of coordinates in which two signatures agree."""
    parts = lambda x: F.regexp_extract_all(F.hex(x), F.lit("...."), F.lit(0))
    equal = F.filter(F.zip_with(parts(a), parts(b), lambda x, y: x == y), lambda same: same)
    return F.size(equal) / float(size)


def successors(rows: DataFrame) -> DataFrame:
    """``_rid, _hash, doc_id, _next, _next_hash, _half`` of written ``rows``
    (``_rid, doc_id, _hash, _chars``): the row that follows in order of key
    (after the last: the first), and half of the row's length."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_rid").asc()]
    keys = rows.select("_rid", "doc_id", "_hash", F.expr("int(floor(_chars / 2))").alias("_half"))
    keys = written(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "fingerprint-order")
    rank = F.struct(F.col("doc_id").isNotNull(), "doc_id", "_hash", "_rid")
    row = F.struct("_rid", "_hash")
    firsts = keys.groupBy("_part").agg(F.min_by(row, rank).alias("_first"))  # a row per partition of the range exchange
    firsts = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"), F.first("_first").over(Window.orderBy("_part")).alias("_top"))
    firsts = F.broadcast(firsts.select(F.col("_part").alias("_p"), F.coalesce("_after", "_top").alias("_after")))
    inside = F.lead(row).over(Window.partitionBy("_part").orderBy(*order))
    found = keys.withColumn("_next", inside).join(firsts, F.col("_part") == F.col("_p"))
    found = found.withColumn("_next", F.coalesce("_next", "_after"))
    return found.select("_rid", "_hash", "doc_id", F.col("_next._rid").alias("_next"), F.col("_next._hash").alias("_next_hash"), "_half")


def paired(texts: DataFrame, following: DataFrame) -> DataFrame:
    """``_rid, _hash, _text, _edited`` of the rows in ``following``, from
    ``texts`` (``_rid, _hash, _text``), dealt by the first two. All columns are used wherever this is, so that
    its exchanges are made once."""
    wanted = following.select(F.col("_rid").alias("_to"), F.col("_hash").alias("_to_hash"), F.col("_next").alias("_from"), F.col("_next_hash").alias("_from_hash"), "_half")
    wanted = small(wanted, BROADCAST_ROWS)
    heads = texts.join(wanted, (F.col("_rid") == F.col("_from")) & (F.col("_hash") == F.col("_from_hash")))
    heads = heads.select("_to", "_to_hash", "_half", F.expr("substring(_text, 1, _half)").alias("_head"))
    edited = F.expr("concat(substring(_text, 1, length(_text) - _half), _head)").alias("_edited")
    return texts.join(heads, (F.col("_rid") == F.col("_to")) & (F.col("_hash") == F.col("_to_hash"))).select("_rid", "_hash", "_text", edited)


def signed(texts: DataFrame, following: DataFrame, size: int = SIZE, bound: float = BOUND) -> DataFrame:
    """``_rid``, ``_hash``, ``n_chars``, ``edited_sha256`` and the signatures
    ``fingerprint`` and ``edited_fingerprint``; written."""

    row = ["_rid", "_hash"]

    def side_by_side(which: DataFrame, limit: float | None) -> DataFrame:
        one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("text"))
        both = paired(texts, which)
        sides = both.select(*row, F.explode(F.array(one(0, "_text"), one(1, "_edited"))).alias("x")).select(*row, "x.kind", F.col("x.text").alias("_text"))
        of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        made = signatures(sides, [*row, "kind"], size=size, bound=limit).groupBy(*row).agg(
            of(0, "signature").alias("fingerprint"), of(1, "signature").alias("edited_fingerprint"), F.max("open").alias("open")
        )
        facts = both.select(*row, F.length("_text").cast("long").alias("n_chars"), F.unhex(F.sha2("_edited", 256)).alias("edited_sha256"))
        return written(made.join(facts, row), "fingerprints")

    quick = side_by_side(following, bound)
    if not quick.filter("open").limit(1).count():
        return quick
    again = following.join(small(quick.filter("open").select(F.col("_rid").alias("_key")), BROADCAST_ROWS), F.col("_rid") == F.col("_key"), "left_semi")
    return quick.filter("not open").unionByName(side_by_side(written(again, "fingerprint-open"), None))


def report(docs: DataFrame, size: int = SIZE, bound: float = BOUND) -> DataFrame:
    """A row per document: fingerprints of its text and of the edited text,
    whose last half is the next document's beginning, and their likeness."""
    rows = with_row_key(docs.select("doc_id", text_or_empty().alias("_text"))).withColumn("_hash", F.xxhash64("_text"))
    keys = written(rows.select("_rid", "doc_id", "_hash", F.length("_text").alias("_chars")), "fingerprint-keys")
    following = written(successors(keys), "fingerprint-next")
    found = signed(rows.select("_rid", "_hash", "_text"), following, size, bound)
    if found.count() != keys.count():
        rows = written(rows, "fingerprint-rows")
        following = written(successors(rows.withColumn("_chars", F.length("_text"))), "fingerprint-next")
        found = signed(rows.select("_rid", "_hash", "_text"), following, size, bound)
    wanted = following.select(F.col("_rid").alias("_to"), "doc_id", F.col("_next").alias("_from"))
    near = found.select("_rid", F.col("fingerprint").alias("_following")).join(wanted, F.col("_rid") == F.col("_from")).select("_to", "doc_id", "_following")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.join(near, F.col("_rid") == F.col("_to")).select(
        "doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), size).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_following"), size).alias("near_next"),
    )
