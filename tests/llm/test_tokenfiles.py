"""Token files against the library itself."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleaner.llm import tokenfiles
from gleaner.llm.queries import vocabulary_path
from tests.conftest import rows

TEXTS = [
    (5, "Hello, world. It's <|endoftext|> here <|endoftext|>and there", "x", 1),
    (3, None, "x", 1),
    (None, "no id", "x", 1),
    (9, "", "x", 1),
    (9, "same id", "x", 1),
    (9, "same id", "x", 1),
    (-4, "  two  blanks\t tab \n line \x1c odd\x85  nbsp ", "x", 1),
    (7, "long " * 30_000 + "end\n\n", "x", 1),
    (8, "x" * 5000 + " " + "漢字" * 300 + " é́ 😀 word. next;word , a", "x", 1),
    (11, " lead", "x", 1),
]


def library():
    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def written(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string, `a.b` string, ids int").repartition(4)
    folder = tokenfiles.token_folder(docs)
    return tokenfiles.write_tokens(docs, folder, vocabulary_path()), folder


def test_files_give_back_the_ids_of_the_library(spark, written):
    encode, want, start = library(), [], 0
    got = sorted(tokenfiles.read_tokens(*written).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((t[0] for t in TEXTS), key=lambda i: (i is not None, i))
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in got))) == sorted(map(repr, ((i, encode(t)) for i, t, *_ in TEXTS)))
    for r in got:
        raw = np.array(r.ids, dtype="<u4").tobytes()
        want.append((r.doc_id, start, len(r.ids), zlib.crc32(raw)))
        start += len(r.ids)
    assert [tuple(r)[:4] for r in got] == want
    again = tokenfiles.read_tokens(*written, with_ids=False)
    assert rows(again, *again.columns) == sorted(want, key=repr)


def test_short_documents_are_read_on_their_own(spark, written):
    encode = library()
    asked = spark.createDataFrame([(9,), (-4,), (100,), (None,), (9,)], "doc_id long")
    got = rows(tokenfiles.lookup(*written, asked), "doc_id", "n_tokens", "ids")
    want = [(i, len(encode(t)), encode(t)) for i, t, *_ in TEXTS if i in (9, -4)]
    assert got == sorted(want, key=repr)


def test_several_files_a_task_and_no_documents(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 100)
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(200)], "doc_id long, text string")
    folder = tokenfiles.token_folder(docs)
    manifest = tokenfiles.write_tokens(docs, folder, vocabulary_path())
    encode, got = library(), tokenfiles.read_tokens(manifest, folder).orderBy("start").collect()
    assert [(r.doc_id, r.ids) for r in got] == [(i, encode(t)) for i, t in sorted(map(tuple, docs.collect()))]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    none = tokenfiles.write_tokens(docs.limit(0), folder, vocabulary_path())
    assert none.count() == 0 and tokenfiles.read_tokens(none, folder).count() == 0


def test_another_dictionary_is_refused(spark, written):
    from pyspark.sql import functions as F

    manifest, folder = written
    with pytest.raises(Exception, match="another dictionary"):
        tokenfiles.read_tokens(manifest.withColumn("dictionary", F.lit("00" * 32)), folder).collect()


def test_cut_texts_encode_like_whole_ones(spark):
    import random

    rnd = random.Random(3)
    encoder = tokenfiles.Encoder(open(vocabulary_path(), encoding="utf-8").read())
    pieces = ["a", "it's", "'s", "x" * 60, "é", "12", "(", ")", ".", " ", "  ", "\t", "\n", "\x85", "\xa0", "　", "\x1c", "<|endoftext|>", "漢", "😀", "​", "-", "’re"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    plain = library()
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)] == [plain(t)[:-1] for t in part]
