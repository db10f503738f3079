"""License scans by a positional index of rare words.

Only words of the templates are kept of a text, with their places, and places
only where a text has every word of some template's key phrase. Document
frequencies of those words over all documents give weights (IDF). Each file's
licence words are ranked by weight, and for each template that may stand in it
the rarest of them is looked up: its places name starts of the template. From
every such start the template's postings (word, relative place) are intersected
with the file's postings. A start stands if all words of the mandatory key
phrase agree and the agreeing words hold enough of the template's weight. Only
DataFrame functions are used, and no text is shuffled.

Defined results: null and empty texts have no words and no labels; repeated
rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, text_or_empty, with_row_key, written

#: Fixed value: what stands between words, before A-Z are put in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Words that only hold places in the templates beyond the base ones, outside of key phrases.
COMMON = frozenset("a and any are as at be can for from in is it may of on or that the this to under use with without you your".split())


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    def postings(self) -> list[tuple[int, str, bool]]:
        """(relative place, word, mandatory) of each indexed word."""
        words, key = self.text.split(), self.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return [(i, w, at <= i < at + len(key)) for i, w in enumerate(words) if self.base or w not in COMMON or at <= i < at + len(key)]


def _base(label: str, phrase: str) -> Template:
    return Template(label, phrase, phrase, True)


#: The base phrases and their labels, then templates of further licences with their key phrases.
TEMPLATES = (
    _base("gpl", "gnu general public license"),
    _base("apache", "apache license"),
    _base("cc-by", "cc by"),
    _base("mit", "mit license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("bsd", "bsd license", "bsd license"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("boost", "boost software license", "boost software license"),
    Template("unlicense", "free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("cc-by", "creative commons attribution", "creative commons attribution"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd", "cc by nd"),
)


def postings(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """``docs`` without the text: ``n_words``, the distinct licence ``words``
    and ``hits`` (place, word), none if no key phrase has all its words there."""
    vocabulary = sorted({w for t in templates for _, w, _ in t.postings()})
    keys = F.array(*[F.array(*[F.lit(w) for w in dict.fromkeys(t.key.split())]) for t in templates])
    words = F.col("_words")
    edge = lambda at: F.when(F.element_at(words, at) == "", 1).otherwise(0)
    # lower() only lets through more than A-Z in lower case would; what it lets through is spelled exactly and looked up again
    near = F.transform(words, lambda w, i: F.when(F.lower(w).isin(vocabulary), F.struct((i - F.col("_lead")).cast("long").alias("pos"), ascii_lower(w).alias("word"))))
    return (
        docs.withColumn("_words", F.split(text_or_empty(text), BETWEEN))
        .withColumn("_lead", edge(1))
        .withColumn("n_words", (F.size(words) - F.col("_lead") - F.when(F.size(words) > 1, edge(-1)).otherwise(0)).cast("long"))
        .withColumn("_hits", F.filter(near, lambda h: h.isNotNull() & h["word"].isin(vocabulary)))
        .drop("_words", "_lead", text)
        .withColumn("words", F.array_distinct(F.transform("_hits", lambda h: h["word"])))
        .withColumn("hits", F.when(F.exists(keys, lambda k: F.size(F.array_except(k, F.col("words"))) == 0), F.col("_hits")))
        .drop("_hits")
    )


def weights(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of each template word over all rows of ``found``; at most as many
    entries as the templates have words, however large the input."""
    n = found.count()
    known = {r["word"]: r["df"] for r in found.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    return {w: math.log(1 + (n + 1) / (1 + known.get(w, 0))) for t in templates for _, w, _ in t.postings()}


def matches(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """A row per document and standing start: ``_rid``, ``label``, ``base``,
    ``start`` and ``share``, the part of the template's weight that agrees."""
    spark = found.sparkSession
    idf = weights(found, templates)
    rows = [(tid, i, w, idf[w], int(must)) for tid, t in enumerate(templates) for i, w, must in t.postings()]
    index = spark.createDataFrame(rows, "tid int, rel int, t_word string, weight double, must int")
    wanted = spark.createDataFrame(
        [(tid, t.label, t.base, sum(r[4] for r in rows if r[0] == tid), sum(r[3] for r in rows if r[0] == tid)) for tid, t in enumerate(templates)],
        "w_tid int, label string, base boolean, all_must int, all_weight double",
    )
    # index and wanted are fixed by the templates, a few hundred rows, so they are broadcast
    files = found.filter(F.size("hits") > 0)
    hits = files.select("_rid", F.explode("hits").alias("h")).select("_rid", F.col("h.pos").alias("pos"), F.col("h.word").alias("word"))
    rarest = F.max_by(F.struct("t_word", "rel"), F.struct("weight", -F.col("rel"))).alias("rarest")
    looked_up = (
        files.select("_rid", F.explode("words").alias("word")).join(F.broadcast(index.filter("must = 1")), F.col("word") == F.col("t_word"))
        .groupBy("_rid", "tid").agg(F.count(F.lit(1)).alias("n"), rarest)
        .join(F.broadcast(wanted), (F.col("tid") == F.col("w_tid")) & (F.col("n") == F.col("all_must")))
        .select(F.col("_rid").alias("_file"), "tid", "label", "base", "all_must", "all_weight", F.col("rarest.t_word").alias("_rare"), F.col("rarest.rel").alias("_rel"))
    )
    starts = hits.join(looked_up, (F.col("_rid") == F.col("_file")) & (F.col("word") == F.col("_rare"))).withColumn("start", F.col("pos") - F.col("_rel"))
    expected = starts.drop("_rid", "pos", "word", "_rare", "_rel").join(F.broadcast(index.withColumnRenamed("tid", "_tid")), F.col("tid") == F.col("_tid")).drop("_tid")
    expected = expected.withColumn("_at", F.col("start") + F.col("rel"))
    agreed = hits.join(expected, (F.col("_rid") == F.col("_file")) & (F.col("pos") == F.col("_at")) & (F.col("word") == F.col("t_word")))
    agreed = agreed.groupBy("_rid", "tid", "start", "label", "base", "all_must", "all_weight").agg(F.sum("weight").alias("weight"), F.sum("must").alias("must"))
    return agreed.filter((F.col("must") == F.col("all_must")) & (F.col("weight") >= least * F.col("all_weight"))).select(
        "_rid", "label", "base", "start", F.least(F.lit(1.0), F.col("weight") / F.col("all_weight")).alias("share")
    )


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(labels), ",")


def report(docs: DataFrame) -> DataFrame:
    """A row per document: words, base places, labels and score (the largest
    share of a template that the text has)."""
    found = written(with_row_key(postings(docs.select("doc_id", "text"))), "license-postings")
    base = lambda c: F.when(F.col("base"), c)
    by_doc = matches(found).groupBy("_rid").agg(
        F.count(base(F.lit(1))).alias("n_base"),
        F.min(base(F.col("start"))).alias("first_word"),
        F.max(base(F.col("start"))).alias("last_word"),
        _joined(F.collect_set(base(F.col("label")))).alias("base_labels"),
        _joined(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    return found.select("_rid", "doc_id", "n_words").join(by_doc, "_rid", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
