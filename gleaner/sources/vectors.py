"""Readers and writers of dense, sparse and multi-vector files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.vectorfiles import register


def read_fvecs(
    spark: SparkSession,
    path: str,
    on_truncated: str = "fail",
    max_rows: int | None = None,
    layout: str = "fixed",
) -> DataFrame:
    """``(pos, vec)`` of a file or folder of float vectors.

    ``on_truncated`` is ``fail`` or ``stop``; ``layout="variable"`` accepts records
    of different dimensions.
    """
    return _read_vectors(spark, "fvecs", path, on_truncated, max_rows, layout)


def read_ivecs(
    spark: SparkSession,
    path: str,
    on_truncated: str = "fail",
    max_rows: int | None = None,
    layout: str = "fixed",
) -> DataFrame:
    """Same for integer vectors."""
    return _read_vectors(spark, "ivecs", path, on_truncated, max_rows, layout)


def _read_vectors(spark, name, path, on_truncated, max_rows, layout) -> DataFrame:
    register(spark)
    reader = spark.read.format(name).option("onTruncated", on_truncated).option("layout", layout)
    if max_rows is not None:
        reader = reader.option("maxRows", max_rows)
    rows = reader.load(path)
    # Files read record by record each honour the cap; the first positions win.
    return rows.where(F.col("pos") < max_rows) if max_rows is not None else rows


def _in_order(df: DataFrame, pos: str, *cols: str) -> DataFrame:
    """Rows in position order across and inside part files."""
    return df.repartitionByRange(pos).sortWithinPartitions(pos).select(*cols)


def write_fvecs(df: DataFrame, path: str, pos: str = "pos", vec: str = "vec", name: str = "fvecs") -> None:
    """Write vectors in position order; reading the folder restores the order."""
    register(df.sparkSession)
    rows = df.select(F.col(pos).alias("pos"), F.col(vec).alias("vec"))
    _in_order(rows, "pos", "pos", "vec").write.format(name).mode("overwrite").save(path)


def write_ivecs(df: DataFrame, path: str, pos: str = "pos", vec: str = "vec") -> None:
    write_fvecs(df, path, pos, vec, "ivecs")


def write_multivectors(df: DataFrame, path: str, pos: str = "pos", vecs: str = "vecs") -> None:
    register(df.sparkSession)
    rows = df.select(F.col(pos).alias("pos"), F.col(vecs).alias("vecs"))
    _in_order(rows, "pos", "pos", "vecs").write.format("multivec").mode("overwrite").save(path)


def read_multivectors(spark: SparkSession, path: str, on_truncated: str = "stop") -> DataFrame:
    """``(pos, vecs)``; positions order the records, file by file."""
    register(spark)
    return spark.read.format("multivec").option("onTruncated", on_truncated).load(path)


def write_sparse(df: DataFrame, path: str, pos: str = "pos") -> None:
    """Write ``(pos, indices, values)`` as binary sparse files."""
    register(df.sparkSession)
    rows = _in_order(df, pos, F.col(pos).alias("pos"), "indices", "values")
    rows.write.format("sparsevec").mode("overwrite").save(path)


def _sparse_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects of JSON arrays ``[{"index": weight, ...}, ...]``.

    Objects hold numbers only, so a closing brace ends a record. Splitting the
    text there lets Spark read one large array in parallel.
    """
    records = (
        spark.read.option("lineSep", "}")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        )
        .where(F.instr("value", "{") > 0)
    )
    body = F.concat(F.substring_index("value", "{", -1), F.lit("}"))
    weights = F.from_json(F.concat(F.lit("{"), body), "map<string,float>")
    # The sort keys restore the order of the records: file, block, place in the block.
    return records.select("file", "block", "seq", weights.alias("weights"))


def read_sparse(spark: SparkSession, path: str, form: str = "map") -> DataFrame:
    """Sparse vectors of a ``.json`` or ``.data`` file or folder, by suffix of ``path``.

    ``form="map"`` gives ``sparse map<int,float>``, ``form="coo"`` gives the arrays
    ``indices`` and ``values``. Order columns: ``pos`` for ``.data``, and
    ``file, block, seq`` for ``.json``.
    """
    if form not in ("map", "coo"):
        raise ValueError(f"unknown form {form!r}; use map or coo")
    suffix = path.rstrip("/").rsplit(".", 1)[-1]
    if suffix == "json":
        rows = _sparse_json(spark, path)
        indices = F.transform(F.map_keys("weights"), lambda x: x.cast("int"))
        rows = rows.select("file", "block", "seq", indices.alias("indices"), F.map_values("weights").alias("values"))
    elif suffix == "data":
        register(spark)
        rows = spark.read.format("sparsevec").load(path)
    else:
        raise ValueError(f"unsupported sparse file {path!r}; use .json or .data")
    if form == "coo":
        return rows
    return sparse_convert(rows, "map")


def sparse_convert(df: DataFrame, to: str) -> DataFrame:
    """Between ``sparse`` (map), ``indices`` + ``values`` and rows of ``idx, val``.

    Rows are produced from either form; other columns are kept.
    """
    if to == "map":
        pairs = F.map_from_arrays("indices", "values").cast("map<int,float>")
        return df.withColumn("sparse", pairs).drop("indices", "values")
    if to == "coo":
        return df.withColumns(
            {"indices": F.map_keys("sparse"), "values": F.map_values("sparse")}
        ).drop("sparse")
    if to == "rows":
        source = df if "sparse" in df.columns else sparse_convert(df, "map")
        rest = [c for c in source.columns if c != "sparse"]
        return source.select(*rest, F.explode("sparse").alias("idx", "val"))
    raise ValueError(f"unknown form {to!r}; use map, coo or rows")
