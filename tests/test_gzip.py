"""Gzip files in ranges against Python's own reading of them."""

import gzip
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.sources import corpus as C
from gleaner.sources import gziplines as G
from tests.conftest import rows


def records(n, seed=1, long=0):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=rnd.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 120))) for _ in range(n)]
    if long:
        texts[n // 2] = " ".join(rnd.choices(words, k=long))
    return [{"docid": f"d{i}", "text": t} for i, t in enumerate(texts)]


def lines_of(path, every):
    with open(path, "rb") as handle:
        found = list(G.checkpoints(handle, every))
    out = []
    for (at, bits, begin, _, window), following in zip(found, found[1:]):
        stop = -1 if following[0] < 0 else following[2]
        with open(path, "rb") as handle:
            out.append(list(G.range_lines(handle, at, bits, begin, stop, window)))
    return found, out


@pytest.mark.parametrize("end", ["", "\n"])
@pytest.mark.parametrize("level", [1, 6, 9])
def test_ranges_hold_every_line_once(tmp_path, level, end):
    path = tmp_path / "a.gz"
    text = "\n".join(json.dumps(r) for r in records(3000, level, long=60_000)) + end
    path.write_bytes(gzip.compress(text.encode(), level))
    found, parts = lines_of(path, 20_000)
    assert len(parts) > 8
    want = text.encode().split(b"\n")
    assert [x for part in parts for x in part] == (want[:-1] if end else want)
    assert found[-1][3] == len(want) - bool(end)
    firsts = [len([x for p in parts[:i] for x in p]) for i in range(len(parts))]
    assert firsts == [lines + (no > 0 and window[-1:] != b"\n") for no, (_, _, _, lines, window) in enumerate(found[:-1])]


def test_members_stored_blocks_and_empty_files(tmp_path):
    path = tmp_path / "a.gz"
    noise = random.Random(2).randbytes(200_000).replace(b"\n", b" ")
    texts = [b"one\ntwo\nthr", b"ee\n\nfour\n", b"", noise + b"\n", b"end\n" * 5000]
    stored_blocks = zlib.compressobj(0, zlib.DEFLATED, 31)
    members = [gzip.compress(t) for t in texts]
    members[3] = stored_blocks.compress(texts[3]) + stored_blocks.flush()
    path.write_bytes(b"".join(members) + b"\0" * 100)
    for every in (1, 5000, 1 << 30):
        _, parts = lines_of(path, every)
        assert [x for part in parts for x in part] == b"".join(texts).split(b"\n")[:-1]
    path.write_bytes(gzip.compress(b""))
    assert lines_of(path, 10)[1] == [[]]


def test_one_file_is_read_by_many_tasks_with_positions(spark, tmp_path):
    made = records(4000)
    (tmp_path / "corpus.jsonl.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, made)).encode()))
    corpus = C.read_gzip_corpus(spark, str(tmp_path / "corpus.jsonl.gz"), "en", split_bytes=40_000)
    tasks = corpus.groupBy(F.spark_partition_id()).count().count()
    ranges = G.gzip_ranges(spark, {"en": str(tmp_path)}, 40_000)
    assert ranges.where("at >= 0").count() >= 8 and tasks >= 1
    lines = G.gzip_lines(ranges, str(tmp_path))
    assert lines.rdd.getNumPartitions() >= 8
    got = corpus.orderBy("pos").collect()
    assert [(r.pos, r.docid, r.text, r.lang) for r in got] == [(i, d["docid"], d["text"], "en") for i, d in enumerate(made)]


def test_positions_run_on_over_files(spark, tmp_path):
    made = records(900)
    for i in range(3):
        (tmp_path / f"part-{i}.jsonl.gz").write_bytes(gzip.compress("".join(json.dumps(r) + "\n" for r in made[i * 300 : i * 300 + 300]).encode()))
    corpus = C.read_gzip_corpus(spark, str(tmp_path), "en", split_bytes=10_000)
    assert [r.docid for r in corpus.orderBy("pos").collect()] == [d["docid"] for d in made]
    assert corpus.agg(F.max("pos")).first()[0] == 899


def test_broken_files_are_reported(spark, tmp_path):
    data = gzip.compress("\n".join(json.dumps(r) for r in records(2000)).encode())
    for lang, raw in (("en", data), ("de", data[: len(data) // 2]), ("fr", b"no gzip"), ("es", data[:200_000] + b"\xff" * 50 + data[200_050:])):
        (tmp_path / f"corpus-{lang}").mkdir()
        (tmp_path / f"corpus-{lang}" / "corpus.jsonl.gz").write_bytes(raw)
    for split in (20_000, 1 << 30):
        docs, status = C.read_all_languages(spark, str(tmp_path), ["en", "de", "fr", "es", "hi"], split_bytes=split)
        assert rows(status, "lang", "status") == [("de", "failed"), ("en", "success"), ("es", "failed"), ("fr", "failed"), ("hi", "failed")]
        assert docs.count() == 2000 and rows(docs.select("lang").distinct(), "lang") == [("en",)]
    with pytest.raises(Exception, match="ends inside"):
        C.read_gzip_corpus(spark, str(tmp_path / "corpus-de"), "de", split_bytes=20_000).count()


def test_query_reads_files_of_bounded_size(spark, sf, monkeypatch):
    from checks.compare import compare, views
    from gleaner.operators import fulltext

    seen, ranges = [], C.gzip_ranges
    monkeypatch.setattr(fulltext, "TEXT_BYTES", 1 << 15)
    monkeypatch.setattr(C, "gzip_ranges", lambda spark, paths, *rest: seen.append(len(C.data_files(*paths.values()))) or ranges(spark, paths, *rest))
    assert compare(spark, views(sf), sf, "read_gzip_corpus") is None
    assert seen and seen[0] > 1
