"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Words of the whitespace tokenisation (Java regex; the SQL twin writes its own).
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def landed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` under ``spark.checkpoint.dir``; the table read back, and its
    folder for ``drop_scratch``.

    Cuts the lineage at a table that survives a lost executor, and lets
    several consumers scan only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def land(df: DataFrame, name: str) -> DataFrame:
    """``landed`` for a table that is needed until the process ends."""
    return landed(df, name)[0]


def row_key(text: str = "text") -> Column:
    """64 bits of a row's text; with the id it names a row among clashing ids."""
    return F.xxhash64(text_or_empty(text))


def pick(docs: DataFrame, decisions: DataFrame, copies: str, id_col: str = "doc_id",
         text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` repeated as ``decisions`` says.

    ``decisions`` has one row per row of ``docs``: the id, ``row_key`` and a
    number of copies (0 drops the row).  Rows alike in id and text are one
    key: the key's copies are summed and given to one of its rows, which
    returns the same rows whichever of them that is; where other columns must
    agree too, ``also`` names them (both tables have them).  Null ids match null ids.
    All columns of ``docs`` and nothing else come back.  One exchange of the
    rows, by id and text, which no hot group can share.
    """
    key = lambda text: F.xxhash64(text, *[F.col(f"`{c}`") for c in also]) if also else text
    per_key = (decisions.groupBy(F.xxhash64(F.col(f"`{id_col}`")).alias("_a"), key(F.col("row_key")).alias("_b"))
               .agg(F.sum(F.col(copies).cast("long")).alias("_copies"))
               .where(F.col("_copies") > 0))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.xxhash64(F.col(f"`{id_col}`")).alias("_a"), key(row_key(f"`{text_col}`")).alias("_b"))
    # the window reuses the join's partitioning: keys are plain columns, never null
    nth = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("_copies"))
    picked = keyed.join(per_key, ["_a", "_b"]).withColumn("_nth", nth).where("_nth = 1")
    return picked.select("_row", F.explode(F.expr("sequence(1L, _copies)"))).select("_row.*")
