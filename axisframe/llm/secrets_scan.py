"""Secret scans: fixed patterns, and character Markov models of random strings
against ordinary identifiers.

Two first-order models over characters are counted from labelled samples:
tokens of the corpus that a fixed pattern proves to be secrets and generated
random strings on the one side, fixed plain words and the words and joined words
of the corpus on the other. Random letters look like a word to a pattern, so a
word of the corpus is a sample only if the models of the fixed samples alone
find it ordinary; each counts once, however often it is repeated. A long token is a secret if the log-likelihood ratio of the two models
exceeds ``MARGIN`` per character over the whole token, or over a stretch of it of
``LEAST`` characters or more that begins and ends at a sign or an end of the
token, so that a path or a name before a key does not hide it; numbers between
signs count as neutral in stretches. The span is the whole token. Tokens without
letters, so numbers and joined numbers, are never secrets by the models. Offsets are code points: the text is split
at the matches, and the lengths of pieces and matches are summed in order.
Only DataFrame functions are used.

Defined results: null and empty texts have no spans; repeated rows are judged
one by one; an empty table gives an empty result; further columns are left out
by :func:`spans` and carried by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import boxed, once, small, text_or_empty, unboxed, with_row_key, written
from .plain_words import plain_samples

#: The base patterns by kind (a match of ``assign`` also needs 6 characters in its group), in the order that breaks ties.
PATTERNS = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "markov": r"[A-Za-z0-9+/_=-]{16,}",
}
KINDS = tuple(PATTERNS)
ASSIGN_LEAST = 6

#: What makes a token with letters an ordinary sample, and one without a number: words joined by one sign, any one case, or digits alone.
#: Its repetitions give nothing back, so that Java matches them in a loop and not by recursion.
ORDINARY = r"^(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)(?:[_/=+-](?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+))*+$"
PROVEN = r"^(?:AKIA[A-Z0-9]{16,}+|(?=[a-f]*+[0-9])[0-9a-f]{24,}+)$"

#: Fixed value: the signs at which a stretch of a token may begin or end.
SIGNS = "+/_=-"
LEAST = 16
#: Fixed value: each digit of the parts between signs that have digits alone.
NUMBER = r"(?:\G(?!^)|(?<![A-Za-z0-9])(?=[0-9]++(?![A-Za-z0-9])))[0-9]"

ALPHABET = 66
SMOOTHING = 0.1
MARGIN = 0.35
N_GENERATED = 6_000
BROADCAST_ROWS = 200_000
#: Characters of a token in one row.
CHUNK = 4_096


def _cut(text: Column, kind: str) -> Column:
    """Per match of a kind: length before it, its length, that of its group, and the token."""
    rule = F.lit(PATTERNS[kind])
    found = lambda i: F.regexp_extract_all(text, rule, F.lit(i))
    shape = "array<struct<gap:int,len:int,value:int,token:string>>"
    if kind == "assign":
        rows = F.arrays_zip(F.split(text, PATTERNS[kind]).alias("p"), found(0).alias("m"), found(1).alias("v"))
        value = lambda x: F.length(x["v"])
    else:
        rows = F.arrays_zip(F.split(text, PATTERNS[kind]).alias("p"), found(0).alias("m"))
        value = lambda x: F.lit(ASSIGN_LEAST)
    token = (lambda x: x["m"]) if kind == "markov" else (lambda x: F.lit(None).cast("string"))
    cut = F.transform(
        F.filter(rows, lambda x: x["m"].isNotNull()),
        lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("len"), value(x).alias("value"), token(x).alias("token")),
    )
    return F.when(text.rlike(PATTERNS[kind]), cut.cast(shape))


def matched(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with a column of matches for each kind."""
    t = text_or_empty(text)
    return docs.withColumns({f"_{k}": _cut(t, k) for k in KINDS}).drop(text)


def placed(found: DataFrame) -> DataFrame:
    """``_rid, kind, start, end, token`` of every match; ``value`` as cut."""
    kinds = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f"_{k}").alias("m")) for i, k in enumerate(KINDS)])
    rows = found.select("_rid", F.explode(kinds).alias("k")).select("_rid", "k.rank", F.posexplode("k.m").alias("at", "m"))
    so_far = F.sum(F.col("m.gap").cast("long") + F.col("m.len")).over(Window.partitionBy("_rid", "rank").orderBy("at"))
    return rows.withColumn("end", so_far).select(
        "_rid", "rank", (F.col("end") - F.col("m.len")).alias("start"), "end", F.col("m.value").alias("value"), F.col("m.token").alias("token")
    )


def _pairs(tokens: DataFrame, *keep: str, mask: str = "token") -> DataFrame:
    """``_i, now, before, _mask`` and the columns ``keep``: a row per character
    of each token with the one before ('' at first). Tokens are cut into chunks
    first, and only characters go on, so work and memory grow with the length."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    chunks = F.transform(F.arrays_zip(cut("token").alias("t"), cut(mask).alias("m")), lambda x: F.struct(x["t"].alias("t"), x["m"].alias("m"), F.right(x["t"], F.lit(1)).alias("last")))
    linked = once(chunks, lambda c: F.transform(c, lambda x, i: F.struct(x["t"].alias("t"), x["m"].alias("m"), F.coalesce(F.get(c, i - 1)["last"], F.lit("")).alias("edge"))))
    rows = tokens.select(*keep, F.posexplode(linked).alias("_chunk", "_c")).select(*keep, "_chunk", "_c.edge", F.split("_c.t", "").alias("_now"), F.split("_c.m", "").alias("_masks"))
    rows = rows.withColumn("_before", F.concat(F.array("edge"), "_now"))
    rows = rows.select(*keep, "_chunk", F.posexplode(F.arrays_zip("_now", "_masks", F.slice("_before", 1, F.size("_now")).alias("_before"))).alias("_at", "_p"))
    return rows.select(*keep, (F.col("_chunk") * CHUNK + F.col("_at") + 1).alias("_i"), F.col("_p._now").alias("now"), F.col("_p._before").alias("before"), F.col("_p._masks").alias("_mask"))


def generated(spark: SparkSession, n: int = N_GENERATED) -> DataFrame:
    """Random strings over base 16, 62 and 64 and over letters of one case,
    whole and in fours, the same in each run."""
    hexed = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    b64 = F.rtrim(F.base64(F.unhex(hexed)), F.lit("="))
    letters = F.regexp_replace(F.lower(b64), "[^a-z]", "")
    kinds = [hexed, b64, F.regexp_replace(b64, "[+/]", ""), letters, F.upper(letters), F.regexp_replace(letters, "(.{4})(?=.)", "$1-")]
    token = F.get(F.array(*kinds), (F.col("id") % len(kinds)).cast("int"))
    return spark.range(n).select(token.alias("token"), F.lit(1).alias("label"))


def trained(samples: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """``before, now, ratio``: the log of the two models' quotient for each
    pair of characters in ``samples`` (``token``, ``label``); and, with ``now``
    null, the quotient for a character not seen after ``before``.

    The result has at most as many rows as there are pairs of the 66 characters.
    """
    pairs = written(_pairs(samples, "label").groupBy("before", "now").agg(
        F.sum(F.col("label")).alias("random"), F.sum(1 - F.col("label")).alias("ordinary")
    ), "pairs")
    totals = pairs.groupBy(F.col("before").alias("b")).agg(F.sum("random").alias("all_random"), F.sum("ordinary").alias("all_ordinary"))
    logp = lambda n, total: F.log((n + smoothing) / (total + smoothing * ALPHABET))
    ratio = lambda a, b: logp(a, F.col("all_random")) - logp(b, F.col("all_ordinary"))
    seen = pairs.join(totals, F.col("before") == F.col("b")).select("before", "now", ratio(F.col("random"), F.col("ordinary")).alias("ratio"))
    return seen.unionByName(totals.select(F.col("b").alias("before"), F.lit(None).cast("string").alias("now"), ratio(F.lit(0), F.lit(0)).alias("ratio")))


def scored(tokens: DataFrame, model: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Distinct ``token`` values with ``ratio``, the mean per character of the
    whole token, and ``surplus``, by how much the sum over the best of its
    stretches exceeds ``margin`` per character (null if it has none)."""
    model = small(written(model, "markov"), ALPHABET * (ALPHABET + 2))
    exact = model.filter(F.col("now").isNotNull()).select(F.col("before").alias("b1"), F.col("now").alias("n1"), F.col("ratio").alias("r1"))
    other = model.filter(F.col("now").isNull()).select(F.col("before").alias("b2"), F.col("ratio").alias("r2"))
    keyed = written(with_row_key(tokens.select("token").distinct(), "_tid"), "tokens")
    pairs = _pairs(keyed.withColumn("_masked", F.regexp_replace("token", NUMBER, "#")), "_tid", mask="_masked")
    joined = pairs.join(F.broadcast(exact), (F.col("before") == F.col("b1")) & (F.col("now") == F.col("n1")), "left")
    joined = joined.join(F.broadcast(other), F.col("before") == F.col("b2"), "left")
    sign = lambda c: F.col(c).isin("", *SIGNS)
    along = Window.partitionBy("_tid").orderBy("_i")
    early = along.rowsBetween(Window.unboundedPreceding, 1 - LEAST)
    rows = joined.select("_tid", "_i", "before", "now", "_mask", F.coalesce("r1", "r2", F.lit(0.0)).alias("x"))
    rows = rows.withColumn("over", F.when(F.col("_mask") == "#", 0.0).otherwise(F.col("x")) - margin).withColumn("sum", F.sum("over").over(along))
    rows = rows.withColumn("start", F.when(sign("before"), F.col("sum") - F.col("over"))).withColumn("next", F.lead("now", 1, "").over(along))
    rows = rows.withColumn("surplus", F.when(sign("next"), F.col("sum") - F.min("start").over(early)))
    return keyed.join(rows.groupBy("_tid").agg(F.avg("x").alias("ratio"), F.max("surplus").alias("surplus")), "_tid").drop("_tid")


def spans(found: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Every span of the written result of :func:`matched`: base ones and those
    of the models."""
    spark = found.sparkSession
    every = written(placed(found), "secret-places")
    base = every.filter((F.col("rank") < 3) & (F.col("value") >= ASSIGN_LEAST))
    tokens = every.filter("rank = 3")
    label = F.when(F.col("token").rlike(PROVEN), 1).when(F.col("token").rlike(ORDINARY) & F.col("token").rlike("[A-Za-z]"), 0)
    samples = tokens.select("token").distinct().withColumn("label", label).filter(F.col("label").isNotNull())
    fixed = generated(spark).unionByName(spark.createDataFrame([(w, 0) for w in plain_samples()], "token string, label int"))
    random = (F.col("ratio") > margin) | (F.coalesce("surplus", F.lit(0.0)) > 0)
    plain = scored(samples.filter("label = 0"), trained(fixed), margin).filter(~random).select("token", F.lit(0).alias("label"))
    samples = samples.filter("label = 1").unionByName(plain).unionByName(fixed)
    number = ~F.col("token").rlike("[A-Za-z]")
    secret = scored(tokens, trained(samples), margin).filter(random & ~number)
    by_model = tokens.join(secret.select("token"), "token", "left_semi")
    names = F.array(*[F.lit(k) for k in KINDS])
    return base.unionByName(by_model).select("_rid", "rank", F.get(names, F.col("rank")).alias("kind"), "start", "end")


def by_document(found: DataFrame, margin: float = MARGIN) -> DataFrame:
    """A row for each document that has spans: counts and ordered span lists."""
    one = F.struct("start", "rank", "end", F.concat_ws(":", "kind", "start", "end").alias("s"), (F.col("rank") < 3).alias("base"))
    listed = lambda x: F.array_join(F.transform(x, lambda s: s["s"]), ",")
    rows = spans(found, margin).groupBy("_rid").agg(F.sort_array(F.collect_list(one)).alias("list"), *[
        F.count(F.when(F.col("rank") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)
    ])
    return rows.withColumn("base_spans", listed(F.filter("list", lambda s: s["base"]))).withColumn("spans", listed(F.col("list")))


def report(docs: DataFrame) -> DataFrame:
    """A row per document: base counts, digest of base spans, all spans."""
    found = written(with_row_key(matched(docs.select("doc_id", "text"))), "secret-matches")
    count = lambda k: F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}")
    listed = lambda c: F.coalesce(c, F.lit(""))
    return found.select("_rid", "doc_id").join(by_document(found), "_rid", "left").select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "<secret>", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the characters of all spans replaced, overlapping and
    touching spans by one ``mark``; ``n_chars``, if there is one, follows."""
    whole = written(with_row_key(boxed(docs)), "redact-rows")
    found = written(matched(whole.select("_rid", F.col(f"_row.{text}").alias("text"))), "secret-matches")
    lists = by_document(found).select(F.col("_rid").alias("_key"), F.transform("list", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("list"))
    marked = written(lists, "secret-spans")
    lists = F.broadcast(marked) if (marked.agg(F.sum(F.size("list") + 4)).first()[0] or 0) <= BROADCAST_ROWS else marked

    def cut(t: Column, s: Column) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
        step = lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(F.struct(
            x["end"].alias("at"),
            F.when(x["start"] > a["at"], F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark)))
            .when(a["at"] == 0, F.lit(mark)).otherwise(a["out"]).alias("out"),
        ))
        return F.aggregate(s, state, step, lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))

    joined = whole.join(lists, F.col("_rid") == F.col("_key"), "left")
    new = joined.withColumn("_new", F.when(F.col("list").isNotNull(), once(F.col(f"_row.{text}"), lambda t: cut(t, F.col("list")))))
    row = F.col("_row").withField(text, F.coalesce("_new", f"_row.{text}"))
    if n_chars and n_chars in docs.columns:
        row = row.withField(n_chars, F.coalesce(F.length("_new").cast("long"), f"_row.{n_chars}"))
    return unboxed(new.withColumn("_row", row))
