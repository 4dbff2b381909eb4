"""Phrases against brute force, and the index against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import collocations
from tests.conftest import rows


def brute(texts, least, longest=4, best=2000):
    """``{(lang, phrase): ...}`` counted word by word."""
    counts, sizes = Counter(), Counter()
    for lang, text in texts:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\x0b\x0c\r":
            text = text.replace(mark, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            sizes[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {key: n for key, n in counts.items() if n >= least}
    out = []
    for key, a in found.items():
        lang, *words = key
        if len(words) < 2:
            continue
        longer = [n for other, n in found.items() if other[0] == lang and len(other) > len(key)
                  and any(other[i : i + len(words)] == tuple(words) for i in range(1, len(other) - len(words) + 1))]
        if any(100 * n >= 80 * a for n in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = found[(lang, *words[:k])], found[(lang, *words[k:])]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    ranked, place = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        place[lang] += 1
        if place[lang] <= best:
            ranked.append((lang, place[lang], phrase.decode(), -a, l, r, sizes[lang], -score))
    return ranked


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def corpus(seed, n=250):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "É", "e\xa0f", "g", "漢字", "h", "i"]
    fixed = ["a b c g", "dé É h", "i i i i i"]
    texts = [(rnd.choice(["en", "fr", None]), rnd.choice([" ", "  ", "\t"]).join(
        rnd.choice(fixed) if rnd.random() < 0.4 else rnd.choice(vocabulary) + rnd.choice(["", "", ".", " ;", "\n", "\r\n"]) for _ in range(rnd.randrange(30)))) for _ in range(n)]
    return texts + [("en", None), (None, ""), ("de", "nothing often"), ("und", "a b"), ("en", "..,\n ?")]


@pytest.mark.parametrize(("shard", "least"), [(40, 5), (collocations.SHARD_WORDS, 12)])
def test_phrases_equal_brute_force(spark, monkeypatch, shard, least):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    texts = corpus(shard)
    docs = spark.createDataFrame([(t, g, 1, "x") for g, t in texts], "text string, lang string, id int, word string").repartition(3)
    got = collocations.collocations(docs, least=least)
    assert rows(got, *COLUMNS) == sorted(brute(texts, least), key=repr) and got.count() > 20
    few = collocations.collocations(docs, least=least, best=7)
    assert rows(few, *COLUMNS) == sorted(brute(texts, least, best=7), key=repr)


def test_long_texts_and_copies_and_nothing(spark):
    texts = [("en", "x y z. " * 40_000)] + [("en", "copy of it")] * 50 + [("en", "word " * 3000)]
    docs = spark.createDataFrame([(t, g) for g, t in texts], "text string, lang string")
    assert rows(collocations.collocations(docs), *COLUMNS) == sorted(brute(texts, 30), key=repr)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text like 'nothing%'")).count() == 0


def test_index_extends_both_ways():
    rnd = np.random.default_rng(5)
    text = rnd.integers(0, 6, 3000).astype(np.int32)
    text[0] = text[-1] = 0
    index, arrays = collocations.Index.build(text, np.arange(5), 4)
    words = "".join(map(str, text))
    patterns = np.array([[1, 2], [3, 3], [5, 1], [2, 4]])
    left, right = index.neighbours(patterns)
    for (owner, symbol, count), form in ((left, "{1}{0}"), (right, "{0}{1}")):
        for o, s, n in zip(owner, symbol, count):
            wanted = form.format("".join(map(str, patterns[o])), s)
            assert n == sum(words.startswith(wanted, i) for i in range(len(words)))
        assert len(owner) == sum(form.format("".join(map(str, p)), s) in words for p in patterns for s in range(1, 6))
    longer, count = index.extend(patterns)
    assert all(tuple(p[1:]) in set(map(tuple, patterns)) for p in longer) and len(longer)
