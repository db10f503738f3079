"""What the operators of this folder share: the shared work folder, written
tables, size-checked broadcasts and the word classes of the contracts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the white space of the word contracts, as a Java/RE2 class body.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset a
    temporary folder serves, but only in local mode: on a cluster no executor
    would see it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="axisframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage.

    A lost executor costs only its running tasks: what was written stays.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most
    ``max_rows`` rows; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def looked_up(rows: DataFrame, key: str, facts: DataFrame, max_rows: int, hot: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each ``_key`` and
    the number of ``rows`` of that key in ``_size``, which are left out.

    ``facts`` of up to ``max_rows`` rows are broadcast. Of more, only those of
    keys with over ``hot`` rows are, at most a ``hot``-th of the rows; the
    others shuffle, so that no key makes a task large. Both are written tables.
    """
    plain = lambda found: found.drop("_key", "_size")
    same = F.col(key) == F.col("_key")
    if facts.limit(max_rows + 1).count() <= max_rows:
        return plain(rows.join(F.broadcast(facts), same, how))
    many = small(facts.filter(F.col("_size") > hot), max_rows)
    rest = rows.join(many.select("_key"), same, "left_anti").join(facts.filter(F.col("_size") <= hot), same, how)
    return plain(rows.join(many, same)).unionByName(plain(rest))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of other than white space, in order."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many such runs there are, without keeping them."""
    pieces = F.split(text, f"[{SPACE}]+")
    edge = lambda at: F.when(F.element_at(pieces, at) == "", 1).otherwise(0)
    return F.when(F.length(F.rtrim(F.ltrim(text))) == 0, 0).otherwise(
        F.size(pieces) - edge(1) - F.when(F.size(pieces) > 1, edge(-1)).otherwise(0)
    ).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` where ``value`` is computed once, however often ``f`` uses
    it: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def with_row_key(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A key for each row; only steady once the result is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def boxed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``_row``, so that no name of theirs
    can clash with one that an operator adds."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("_row.*")
