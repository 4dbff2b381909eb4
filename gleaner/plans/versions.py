"""Collections replaced as a whole: staged files, a committed manifest, readers bound to one version.

A load writes its rows to a folder of its own. Only when all of them are written is a manifest created that
names the folder; until then readers see the version before, and a load that fails leaves it in place. A reader takes a
:func:`snapshot` once and keeps reading the same files whatever is committed meanwhile. Every language has
manifests of its own, so loads of different languages never wait for or undo one another; of two
loads of one language the later commit is the one that readers see.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.functions.constants import LOAD_BATCH_SIZE
from gleaner.plans.load import batch_report, collection_rows, good_batches


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, its path object there and those of the files in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, target, [s.getPath() for s in fs.listStatus(target)] if fs.exists(target) else []


def _manifests(spark: SparkSession, root: str, lang: str) -> list[tuple[int, str | None]]:
    """``(version, folder)`` of all manifests of a language, oldest first; no folder for one that isn't written out."""
    fs, _, found = _files(spark, f"{root}/versions/{lang}")
    out = []
    for path in found:
        if not path.getName().endswith(".json"):
            continue
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            folder = json.loads(text)["folder"]
        except ValueError:
            folder = None
        out.append((int(path.getName().removesuffix(".json")), folder))
    return sorted(out)


def commit(spark: SparkSession, root: str, lang: str, folder: str) -> int:
    """Make the complete ``folder`` under ``root`` the newest version of ``lang``; the version's number."""
    fs, _, done = _files(spark, f"{root}/{folder}")
    if not any(p.getName() == "_SUCCESS" for p in done):
        raise ValueError(f"{folder} is not complete")
    text = json.dumps({"folder": folder}).encode()
    version = max((v for v, _ in _manifests(spark, root, lang)), default=0)
    while True:
        version += 1
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{lang}/{version}.json")
        if fs.exists(path):  # another load was faster
            continue
        out = fs.create(path, False)
        out.write(bytearray(text))
        out.close()
        return version


def snapshot(spark: SparkSession, root: str) -> dict[str, str]:
    """Folder of the newest committed version of each language."""
    _, _, languages = _files(spark, f"{root}/versions")
    newest = {}
    for path in languages:
        folders = [f for _, f in _manifests(spark, root, path.getName()) if f]
        if folders:
            newest[path.getName()] = folders[-1]
    return newest


def read_snapshot(spark: SparkSession, root: str, bound: dict[str, str] | None = None) -> DataFrame:
    """All rows of one snapshot, by default of the newest; an error when nothing was ever committed."""
    folders = snapshot(spark, root) if bound is None else bound
    if not folders:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.parquet(*[f"{root}/{folder}" for folder in folders.values()])


def replace_collection(
    docs: DataFrame,
    vectors: DataFrame,
    root: str,
    lang: str,
    max_rows: int | None = None,
    batch_size: int = LOAD_BATCH_SIZE,
    is_bad: Column | None = None,
    whole: bool = True,
) -> DataFrame:
    """Replace the collection of ``lang`` when its load is complete, and return the batch report.

    With ``whole`` a batch with a bad row keeps the version before in place; without, such batches
    are left out of the new one. An empty load commits an empty version. Repeated loads are versions of their own.
    """
    spark = docs.sparkSession
    rows = collection_rows(docs, vectors, lang, max_rows, batch_size)
    report = batch_report(rows, batch_size, is_bad)
    if whole and is_bad is not None and not report.where("not ok").isEmpty():
        return report
    folder = f"data/{lang}-{uuid.uuid4().hex}"
    good = good_batches(rows, batch_size, is_bad).drop("pos").withColumn("created_at", F.current_timestamp())
    good.write.parquet(f"{root}/{folder}")
    commit(spark, root, lang, folder)
    return report


def expire_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` (at least one) versions of each language; the folders deleted.

    Folders that no manifest names stay: a load may be writing them. Readers bound to a deleted version fail.
    """
    _, _, languages = _files(spark, f"{root}/versions")
    gone = []
    for lang in (path.getName() for path in languages):
        committed = [(v, f) for v, f in _manifests(spark, root, lang) if f]
        for version, folder in committed[: -max(keep, 1)]:
            for path in (f"versions/{lang}/{version}.json", folder):  # the manifest first, so nobody finds what is going
                fs, target, _ = _files(spark, f"{root}/{path}")
                fs.delete(target, True)
            gone.append(folder)
    return gone
