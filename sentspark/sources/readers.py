"""Readers with declared schemas (S1-S5, S9); nothing is inferred.

Parquet is the landing format: column pruning and filter/partition
pushdown come from the scan for free.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_arrays import read_json_array

PAIR_SCHEMA = T.StructType([
    T.StructField("sentence1", T.StringType(), True),
    T.StructField("sentence2", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
])
HEADLINE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
])
SENTENCE_SCHEMA = T.StructType([T.StructField("sentence", T.StringType(), True)])


#: What a null is written as, so that it differs from an empty string.
NULL_MARK = "\u0001"


def read_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool | None = None) -> DataFrame:
    """JSON records, either a whole-file array (the reference's format) or
    one record a line.  ``multiline=None`` looks at the first character of the
    first file: ``[`` is an array, which is read by many tasks
    (``json_arrays.read_json_array``).  Unknown fields are ignored.
    ``multiline=True`` leaves each file to one task of Spark's own reader."""
    if multiline is None:
        first = spark.read.option("lineSep", "}").text(path).where(F.trim("value") != "").limit(1).collect()
        if first and first[0][0].lstrip("\ufeff \t\r\n").startswith("["):
            return read_json_array(spark, path, schema)
        multiline = False
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)


def land_json(spark: SparkSession, path: str, schema: T.StructType, name: str = "json") -> DataFrame:
    """The one-off landing step for array files: Parquet under ``spark.checkpoint.dir``."""
    from .sinks import land
    return land(read_json(spark, path, schema), name)


def _typed(raw: Column, kind: str | T.DataType | None) -> Column:
    return raw if kind is None else raw.try_cast(kind)


def _lines(spark: SparkSession, path: str, sep: str, names: Sequence[str] | None,
           header: bool) -> tuple[DataFrame, list[str]]:
    """Rows as one column ``value`` without the header, and the file's own names.

    Spark's CSV reader takes the first line of each file as its header; read
    with a separator that cannot occur, the whole line is that header, and
    ``enforceSchema=false`` fails if any other file's header differs."""
    if not header:
        if names is None:
            raise ValueError("names are required without a header")
        return spark.read.text(path), list(names)
    whole = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "ignoreLeadingWhiteSpace": False,
             "ignoreTrailingWhiteSpace": False, "header": True}
    line = spark.read.options(**whole).csv(path).columns
    if not line:
        raise ValueError(f"no header in {path}")
    schema = T.StructType([T.StructField(line[0], T.StringType())])
    rows = spark.read.options(**whole, enforceSchema=False).schema(schema).csv(path)
    return rows.toDF("value"), line[0].removeprefix("\ufeff").split(sep)


def read_tsv(spark: SparkSession, path: str, names: Sequence[str] | None = None,
             types: Mapping[str, str | T.DataType] | None = None, header: bool = True,
             sep: str = "\t") -> DataFrame:
    """Delimited text, columns by the name in the file's header.

    ``names`` picks columns (all by default, in the file's order); one that
    the header lacks is an error.  Rows with *more* fields than the header are
    dropped, rows with *fewer* are padded with nulls, quoting is off, an empty
    field is null, a value that does not fit its type is null (``tsv_rejects``
    counts both).  Only the first line of a file is its header; all files of
    a folder must have the same.  Spark's own CSV modes do not offer that
    combination (PERMISSIVE truncates long rows, DROPMALFORMED also drops
    short ones), so the fields are split with native expressions.
    """
    rows, own = _lines(spark, path, sep, names, header)
    picked = list(names) if names is not None else own
    if missing := [n for n in picked if n not in own]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(own)}")
    types = dict(types or {})
    fields = rows.select(F.split("value", _regex_quote(sep), -1).alias("_f")).where(F.size("_f") <= len(own))
    return fields.select(*[_typed(F.nullif(F.get("_f", F.lit(own.index(n))), F.lit("")), types.get(n)).alias(n)
                           for n in picked])


def tsv_rejects(spark: SparkSession, path: str, types: Mapping[str, str | T.DataType],
                names: Sequence[str] | None = None, header: bool = True, sep: str = "\t") -> DataFrame:
    """``reason, n``: rows that ``read_tsv`` drops (``fields``) and values it nulls (by column)."""
    rows, own = _lines(spark, path, sep, names, header)
    f = rows.select(F.split("value", _regex_quote(sep), -1).alias("_f"))
    long = F.size("_f") > len(own)
    counts = [F.count_if(long).alias("fields")]
    for n, kind in types.items():
        raw = F.nullif(F.get("_f", F.lit(own.index(n))), F.lit(""))
        counts.append(F.count_if(~long & raw.isNotNull() & raw.try_cast(kind).isNull()).alias(n))
    one = f.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("reason"), F.col(f"`{c}`").alias("n"))
                                          for c in one.columns])).alias("_r")).select("_r.*")


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in s)


def spread(df: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Hash-distribute ``df`` on ``keys`` over ``parts`` partitions, for a table
    stored as one file that a single task would read.  The caller decides: at
    scale a scan has far more splits than task slots and needs no shuffle."""
    return df.repartition(parts, *keys)


def read_corpus(spark: SparkSession, name: str, col: str = "text") -> DataFrame:
    """S3: one text column of a table (only that column is read), by the name
    of a table or view of the session's catalog, or else by the path of Parquet files."""
    named = "/" not in name and spark.catalog.tableExists(name)
    return (spark.table(name) if named else spark.read.parquet(name)).select(col)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             multiline: bool = False) -> DataFrame:
    """CSV with a header, columns by name (a missing one is an error), values
    that do not fit their type null.  ``NULL_MARK`` is null, a quoted ``""`` an
    empty string.  ``multiline`` allows line breaks in quoted fields, at the
    price of one task per file; cleaned sentences hold none."""
    rows = (spark.read.option("header", True).option("enforceSchema", False).option("escape", '"')
            .option("multiLine", multiline).option("nullValue", NULL_MARK)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    if schema is None:
        return rows
    if missing := [n for n in schema.fieldNames() if n not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(rows.columns)}")
    return rows.select(*[_typed(F.col(f"`{f.name}`"), None if isinstance(f.dataType, T.StringType) else f.dataType)
                         .alias(f.name) for f in schema.fields])


def read_by_extension(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      multiline: bool = False) -> DataFrame:
    """Reader chosen by the text after the last '.' of the path
    (``multiline``: as in ``read_csv``)."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext == "csv":
        return read_csv(spark, path, schema, multiline)
    if ext == "tsv":
        return read_tsv(spark, path, names=schema.fieldNames() if schema else None,
                        types={f.name: f.dataType for f in schema.fields
                               if not isinstance(f.dataType, T.StringType)} if schema else None)
    if ext in ("json", "jsonl"):
        if schema is None:
            raise ValueError("a schema is required for JSON")
        return read_json(spark, path, schema, False if ext == "jsonl" else None)
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext in ("txt", "text"):
        return spark.read.text(path)
    raise ValueError(f"no reader for extension {ext!r}")


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType,
                split_col: str = "split") -> DataFrame:
    """One delimited file per split, tagged and unioned (splits optional,
    but at least one is required)."""
    if not paths:
        raise ValueError("no split given")
    out = None
    for split, p in paths.items():
        d = read_by_extension(spark, p, schema).withColumn(split_col, F.lit(split))
        out = d if out is None else out.unionByName(d)
    return out


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """Reload a ``partitionBy(split)`` Parquet dataset and keep one split;
    the filter prunes whole folders."""
    return spark.read.parquet(path).where(F.col(split_col) == F.lit(split))
