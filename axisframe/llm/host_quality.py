"""Quality rules judged by document and by host.

Every document is measured; rule failures are counted by host (``source``);
each host's failure rate is shrunk towards the mean of all hosts with a beta
prior fitted to the hosts by moments; the verdict on the host is joined back.
Only DataFrame functions are used.

Defined results: a null or empty text has no words and fails the base rule; a
null source is a host of its own; repeated rows are judged one by one; an
empty table gives an empty result; further columns, whatever their names, are
left out by :func:`report` and carried by :func:`keep_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, boxed, once, small, text_or_empty, unboxed, words_of, written

#: The base rule.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: Hosts beyond which verdicts are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_HOSTS = 100_000


def n_repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Windows are hashed to 64 bits with their places; only a text in which two
    hashes agree is sorted. After sorting, equal windows stand side by side;
    the places of those are put in order again and every place adds the words
    that its window covers before the next such place: at most three.
    """
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def same(s: Column, x: Column, at: Column) -> Column:
        return F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = once(ordered, lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
            lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum")),
            lambda a: a["sum"],
        )

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(
        once(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def measures(text: Column) -> dict[str, Column]:
    """What is measured of a text, from columns ``_words`` and ``_n``."""
    has_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "n_words": F.col("_n").cast("long"),
        "word_chars": (F.length(text) - F.length(F.regexp_replace(text, f"[^{SPACE}]+", ""))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": once(has_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(has_word).cast("long"),
        "n_repeat_words": n_repeat_words(F.col("_words"), F.col("_n")),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``soft_failed``."""
    t = text_or_empty(text)
    whole = docs.withColumn("_words", words_of(t)).withColumn("_n", F.size("_words"))
    found = whole.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(f"_m_{k}") for k, c in measures(t).items()])
    m = lambda k: F.col(f"_m_{k}")
    return found.withColumn(
        "_m_base_failed", (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > MAX_REPEATED_PERCENT * m("n_words"))
    ).withColumn(
        # softer rules, which alone reject nothing: many symbols, repeated lines, repeated words, very short or long words
        "_m_soft_failed",
        (20 * m("n_symbols") > m("word_chars"))
        | (10 * m("n_dup_lines") > 3 * m("n_lines"))
        | (100 * m("n_repeat_words") > 25 * m("n_words"))
        | (m("word_chars") < 2 * m("n_words"))
        | (m("word_chars") > 20 * m("n_words")),
    )


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and verdict.

    The prior Beta(a, b) has the mean and the variance of the hosts' rates;
    the binomial share of that variance is taken off first, and a + b is held
    between 1 and 1000, so that one host or equal hosts give a defined prior.
    """
    by_host = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("_m_base_failed") | F.col("_m_soft_failed")).cast("long")).alias("failed"),
    )
    by_host = written(by_host, "hosts")
    rate = F.col("failed") / F.col("n")
    prior = by_host.agg(
        (F.sum("failed") / F.sum("n")).alias("mean"),
        F.avg((rate) * rate).alias("square"),
        F.avg(rate).alias("plain"),
        F.avg(1.0 / F.col("n")).alias("inverse"),
    ).first()
    mean = prior["mean"] or 0.0
    spread = mean * (1 - mean)
    between = (prior["square"] or 0.0) - (prior["plain"] or 0.0) ** 2 - spread * (prior["inverse"] or 0.0)
    strength = min(1000.0, max(1.0, spread / between - 1)) if between > 0 else 1000.0
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return by_host.select("host", "n", "failed", shrunk.alias("rate"), (shrunk > max_rate).alias("bad_host"))


def judged(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Each row with its measures and ``_m_kept``.

    A row goes if the base rule fails, or if its host's shrunk rate is above
    ``max_rate`` and the row fails a softer rule itself: clean documents of a
    bad host stay.
    """
    carry = docs.columns if carry is None else carry
    measured = measure(docs, text)
    measured = written(measured.select(*[F.col(f"`{c}`") for c in carry], *[c for c in measured.columns if c.startswith("_m_")]), "measured")
    bad = host_verdicts(measured, host, max_rate).filter("bad_host").select(F.col("host").alias("_host"))
    bad = small(bad, MAX_BROADCAST_HOSTS).withColumn("_bad", F.lit(True))
    out = measured.join(bad, F.col(host).eqNullSafe(F.col("_host")), "left")
    return out.withColumn("_m_kept", ~(F.col("_m_base_failed") | (F.coalesce(F.col("_bad"), F.lit(False)) & F.col("_m_soft_failed")))).drop("_host", "_bad")


def keep_rows(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``."""
    return unboxed(judged(boxed(docs), f"_row.{text}", f"_row.{host}", max_rate).filter("_m_kept"))


def report(docs: DataFrame) -> DataFrame:
    """A row per document: counts and verdict, without the text."""
    m = lambda k: F.col(f"_m_{k}").alias(k)
    return judged(docs.select("doc_id", "source", "text"), carry=["doc_id", "source"]).select(
        "doc_id", m("n_words"), m("word_chars"), m("n_symbols"), m("n_dup_lines"), m("n_repeat_words"), m("base_failed"), m("kept")
    )
