"""Replacement of a collection: all or nothing, readers bound to a version."""

import pytest
from pyspark.sql import functions as F

from gleaner.plans import versions
from gleaner.plans.workspace import fresh_dir
from tests.conftest import rows


def load(spark, root, texts, lang="en", **options):
    docs = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "pos long, docid string, text string")
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(len(texts))], "pos long, vec array<float>")
    return versions.replace_collection(docs, vectors, root, lang, **options)


def texts(spark, root, bound=None):
    return rows(versions.read_snapshot(spark, root, bound), "lang", "docid_col", "fulltext_col")


def test_failing_loads_leave_the_old_rows_readable(spark):
    root = fresh_dir(spark, "versions")
    with pytest.raises(FileNotFoundError):
        versions.read_snapshot(spark, root)
    load(spark, root, ["a", None])
    load(spark, root, ["x"], lang="fr")
    old = [("en", "0", "a"), ("en", "1", None), ("fr", "0", "x")]
    assert texts(spark, root) == sorted(old, key=repr)
    # A bad row, an error in a task while files are written, a manifest that was not written out.
    report = load(spark, root, ["b", "c", "d"], batch_size=2, is_bad=F.col("fulltext_col") == "d")
    assert rows(report, "batch_num", "n_rows", "n_bad", "ok") == [(1, 2, 0, True), (2, 1, 1, False)]
    broken = spark.range(3).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("docid"), F.when(F.col("id") < 2, "b").otherwise(F.raise_error(F.lit("broken"))).cast("string").alias("text"))
    vectors = spark.range(3).select(F.col("id").alias("pos"), F.array(F.lit(1.0)).alias("vec"))
    with pytest.raises(Exception, match="broken"):
        versions.replace_collection(broken, vectors, root, "en")
    fs, _, _ = versions._files(spark, root)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/en/2.json"), False).close()
    with pytest.raises(ValueError, match="not complete"):
        versions.commit(spark, root, "en", "data/nothing")
    assert texts(spark, root) == sorted(old, key=repr)


def test_readers_keep_their_version(spark):
    root = fresh_dir(spark, "versions")
    load(spark, root, ["a", "b"])
    bound = versions.snapshot(spark, root)
    load(spark, root, ["c", "d", "e"], batch_size=2, is_bad=F.col("fulltext_col") == "e", whole=False)
    assert texts(spark, root) == [("en", "0", "c"), ("en", "1", "d")]
    assert texts(spark, root, bound) == [("en", "0", "a"), ("en", "1", "b")]
    load(spark, root, [])
    assert texts(spark, root) == []
    assert versions.expire_versions(spark, root, keep=2) == list(bound.values())
    assert texts(spark, root) == [] and [v for v, _ in versions._manifests(spark, root, "en")] == [2, 3]
