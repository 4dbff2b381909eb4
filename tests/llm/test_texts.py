"""Decontamination, licenses, classifiers and BPE against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontaminate, labelled, licenses, quality, toxicity
from gleaner.llm.queries import vocabulary_path
from tests.conftest import rows

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Écho", "x1"]
    item = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([40, 30, 20, 13, 12, 9, 7, 4, 1, 60])] + [(50, ""), (51, None), (52, "same " * 20)]
    texts = [item(200) + " " + items[i][1].upper().replace(" ", "--") + " " + item(rnd.randrange(300)) for i in range(7)]
    texts += [" ".join(items[0][1].split()[5:17]), " ".join(items[0][1].split()[5:18]), "same " * 30, "", None, "...", items[9][1], items[9][1], item(500)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add(str(i))
    want = []
    for i, t in enumerate(texts):
        w, hit, held = words(t), set(), set()
        for n in range(1, 14):
            for at in range(len(w) - n + 1):
                if found := windows.get(tuple(w[at : at + n])):
                    held |= found
                    hit.update(range(at, at + n))
        want.append((i, len(w), len(hit), len(held), sorted(held), bool(hit) and 20 * len(hit) >= len(w), "n"))
    got = decontaminate.contamination(docs, bench)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated", "key").collect()) == want
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_license_scan(spark):
    texts = ["MIT License, mit-license x apache LICENSE version 2.0 cc by-nc Cc By Nc", "released under the MIT license. émit license; SPDX-License-Identifier: Apache-2.0",
             "", None, "no findings here", "under the GNU General Public License, version 3.", "mit license"]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        w, places, labels = words(t), [], set()
        for phrase, label in [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]:
            p = phrase.split()
            here = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels))
        assert labels <= set(r.labels) and 0 <= r.score <= 1 and r.labels == sorted(set(r.labels))
    # The longer detection wins over the plain name inside it; each kept one lies in no other.
    assert got[5].labels == ["gpl-3"] and got[1].labels == ["apache-2", "mit"] and got[4].score == 0
    for r in got.values():
        spans = [(d.start, d.end) for d in r.detections or []]
        assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans)
    assert len(licenses.rules()) > 200 and licenses.scan(docs.limit(0)).count() == 0


def test_every_license_rule_passes_the_gate(spark):
    samples = []
    for label, keyword, names in licenses.LICENSES:
        assert all(keyword in name.split() for name in names)
        for name in names:
            forms = [f"SPDX-License-Identifier: {name}", f"Licensed under the {name}", f"redistributed under {name}", f"License: {name}", f"{name} license"]
            samples += [(label, s) for s in forms + [name] * (len(name.split()) >= licenses.BARE_WORDS)]
    assert len(samples) == len(licenses.rules()) == 380
    for (label, text), (*_, regex, _) in zip(samples, licenses.rules()):
        assert re.search(regex, f" {' '.join(words(text))} ")
    docs = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(samples)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    missed = [(label, s, got[i].labels) for i, (label, s) in enumerate(samples) if label not in got[i].labels or not got[i].score]
    # Names that go on are told apart by the longer match, so every miss would be a wrong one.
    assert not missed
    assert got[[s for _, s in samples].index("License: gplv3")].labels == ["gpl-3"]


def test_grammar_scores_clauses():
    grammar = toxicity.Grammar(["grob"])
    tags = lambda text: {t: n for t, n in zip(toxicity.TAGS, grammar.tags(text)) if n}
    assert tags("what an idiot") == {"plain_insult": 1}
    assert tags("You are an idiot. You idiot!") == {"targeted_insult": 2}
    assert tags("he is not an idiot") == {"negated_insult": 1}
    assert tags('she said the idiot left') == {"reported_insult": 1}
    assert tags("“idiot” is a word") == {"reported_insult": 1}
    assert tags("i will kill you, they destroy") == {"plain_threat": 1, "targeted_threat": 1}
    assert tags("ein grobian kommt") == {"plain_insult": 1} and tags("idiotic skills") == {} and tags("") == {}


@pytest.mark.parametrize(("text", "tag"), [
    ('He said "you are an idiot".', "reported_insult"),
    ("He said you are an idiot.", "reported_insult"),
    ("She wrote: you are an idiot.", "reported_insult"),
    ("He said nothing and you are an idiot", "targeted_insult"),
    ('"Fine," he wrote, "you are an idiot"', "reported_insult"),
    ('he called it "fine" but you are an idiot', "targeted_insult"),
    ("he said you are a liar and an idiot", "reported_insult"),
    ("you don’t look like an idiot", "negated_insult"),
    ("you can't be an idiot", "negated_insult"),
    ("no, you are an idiot", "targeted_insult"),
    ("this is not fine and you are an idiot", "targeted_insult"),
    ("note: you are an idiot", "targeted_insult"),
])
def test_grammar_of_reports_and_negations(text, tag):
    assert toxicity.Grammar([]).tags(text)[toxicity.TAGS.index(tag)] == 1 == sum(toxicity.Grammar([]).tags(text))


def scanned(words):
    """Tag of each insult or threat, looked up from the words before it."""
    T, found = toxicity, []
    for i, w in enumerate(words):
        if w not in (T.INSULT, T.THREAT):
            continue
        before = words[:i]
        quotes = [j for j, x in enumerate(before) if x == T.QUOTE]
        inside = len(quotes) % 2 == 1
        since = before[quotes[-1] + 1 :] if quotes else before
        verbs = [j for j, x in enumerate(since) if x == T.REPORT]
        ended = verbs and any((x, y) == (T.JOIN, T.TARGET) for x, y in zip(since[verbs[-1] :], since[verbs[-1] + 1 :]))
        near = [x for x in before if x != T.COMMA][-T.NEAR :]
        cut = max((j for j, x in enumerate(before) if x in (T.JOIN, T.COMMA)), default=-1)
        kind = 3 if inside or (verbs and not ended) else 2 if T.NEGATION in before[cut + 1 :][-T.SCOPE :] else 1 if T.TARGET in near else 0
        found.append(kind + (0 if w == T.INSULT else len(T.KINDS)))
    return found


def test_grammar_equals_a_scan_of_the_words():
    rnd, seen = random.Random(4), set()
    for _ in range(3000):
        symbols = rnd.choices(range(toxicity.SYMBOLS), weights=[8, 3, 2, 2, 1, 1, 1, 2, 1], k=rnd.randrange(25))
        state, got = 0, []
        for symbol in symbols:
            got.append(toxicity.OUT[state][symbol])
            state = toxicity.NEXT[state][symbol]
        want = scanned(symbols)
        assert [t for t in got if t >= 0] == want
        seen |= set(want)
    assert len(seen) == len(toxicity.TAGS)


def test_composition_runs_its_parts_side_by_side():
    parts = [toxicity.noting(toxicity.INSULT), toxicity.fading(toxicity.TARGET, 2), toxicity.reporting()]
    table, out = toxicity.compose(parts, lambda o: o)
    rnd, state, single = random.Random(0), 0, [0, 0, 0]
    for _ in range(500):
        symbol = rnd.randrange(toxicity.SYMBOLS)
        moves = [m.table[s, symbol] for m, s in zip(parts, single)]
        assert out[state][symbol].tolist() == [o for _, o in moves]
        state, single = table[state][symbol], [t for t, _ in moves]


@pytest.fixture(scope="module")
def labelled_docs(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "text without id"), (-1, None)], "doc_id long, text string")
    return docs.select("doc_id", "text").union(odd), labels


def test_quality_ranks_held_out_documents(spark, labelled_docs):
    docs, labels = labelled_docs
    got = quality.score(docs, quality.learn(docs, labels))
    both = got.join(labels, "doc_id").where("held_out").toPandas()
    good, bad = both.score[both.quality == 1], both.score[both.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert ((both.predicted == 1) == (both.score >= 0.3)).all() and (both.predicted == both.quality).mean() > 0.9
    odd = got.where("doc_id < 0 or doc_id is null").collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    empty = quality.score(docs, quality.learn(docs, labels.limit(0)))
    assert empty.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(docs.limit(0), quality.fit(np.empty((0, quality.N_FEATURES)), np.empty(0))).count() == 0


def test_toxicity_finds_held_out_documents(spark, labelled_docs):
    docs, labels = labelled_docs
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model)
    both = got.join(labels, "doc_id").toPandas()
    assert both.predicted[both.toxic == 0].mean() < 0.02
    assert both.predicted[both.toxic == 1].mean() > 0.5  # few labels here; most in larger tables
    kept = toxicity.keep_civil(docs.withColumn("score", F.lit(1)), model)
    assert kept.count() == got.where("predicted = 0").count() and kept.columns == ["doc_id", "text", "score"]
    without = toxicity.learn(docs, labels.limit(0))
    assert without.stems == [] and np.allclose(without.weights, toxicity.PRIOR)


def test_learning_rows_leave_the_held_out_fold(spark, labelled_docs):
    docs, labels = labelled_docs
    chosen = labelled.learning_rows(docs, labels, "toxic", "doc_id", "text", 50)
    assert chosen.count() == 50
    import zlib

    flags = labels.select("doc_id", labelled.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in flags)


def test_quality_learns_from_every_row(spark, monkeypatch):
    """Labels beyond any fixed number of rows decide, whether rows are paired in one group or in several."""
    ids = [i for i in range(60_000) if zlib.crc32(str(i).encode()) % 5][:40_000]
    texts = ["plain words of a text", "{x} 123 456 ## $$"]
    rows = [(i, texts[n % 2], int(n % 2 == 0) if n % 8 else 1) for n, i in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.learn(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    x = np.stack([quality.features(pa.array([r[1]]))[0] for r in rows[:8]] * 5000)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    monkeypatch.setattr(quality, "GROUP_ROWS", 700)
    parts = quality.learn(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert np.allclose(parts.weights, model.weights, atol=0.05) and parts.rank(x)[0] > parts.rank(x)[1]


def test_quantiles_are_exact(spark):
    values = np.random.default_rng(3).normal(size=5_001)
    ranks = spark.createDataFrame([(0, [float(v)]) for v in values], "y int, x array<double>")
    for before in (0, 1, 2_500, 5_000):
        got = quality._quantile(ranks, lambda x: x[:, 0], values.min(), values.max(), before)
        assert abs(got - np.sort(values)[before]) < 1e-12


def test_bpe_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rnd = random.Random(9)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "é", "ß", "日本", "😀", "12", "'s", "'LL", "!?", "\x1c", "\x85", "\u00a0", "<|endoftext|>"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(120))) for _ in range(150)] + ["", None, "z" * 5000, " " * 300]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, rest string, made int")
    files = bpe.prepare(docs, vocabulary_path(), words=50)
    got = bpe.decode(bpe.encode(docs, files), files).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and (r.rest, r.made) == ("r", 1)
    both = {r.doc_id: (r.ids, r.decoded) for r in bpe.round_trip(docs, files).collect()}
    assert both == {r.doc_id: (r.ids, r.decoded) for r in got}
    odd = spark.createDataFrame([(1, [5, None, -3, 10**6, 6]), (2, None), (3, [])], "i int, `ids` array<int>")
    assert dict(rows(bpe.decode(odd, files), "i", "decoded")) == {1: library.decode([5, 6]), 2: "", 3: ""}
    none = docs.limit(0)
    assert bpe.encode(none, bpe.prepare(none, vocabulary_path())).count() == 0


def test_latin_texts_are_cut_like_others():
    cutter = bpe.Cutter({"<s>": 1})
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(chr(rnd.randrange(256)) if rnd.random() < 0.5 else rnd.choice(" \n's 'll9²a") for _ in range(rnd.randrange(40)))
        assert cutter.latin(text) == cutter.any(text)
    assert cutter.segments("a<s>b") == ["a", "<s>", "b"]


def test_words_of_all_lengths_are_merged_like_the_library_does():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    with open(vocabulary_path(), encoding="utf-8") as handle:
        vocabulary = bpe.Vocabulary(data=bpe.compile_vocabulary(handle.read()))
    rnd = random.Random(4)
    words = ["".join(rnd.choice("etaoinshrdlué") for _ in range(n)) for n in [*range(1, 70), 500, 5000] for _ in range(4)]
    raw = [w.encode() for w in words]
    lengths = np.array([len(w) for w in raw])
    ids, sizes = vocabulary.merge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths)
    cut = np.split(ids, np.cumsum(sizes)[:-1])
    assert [c.tolist() for c in cut] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_frequent_words_come_in_whole_classes(spark):
    texts = ["".join(f" w{i}".translate(str.maketrans("0123456789", "abcdefghij")) * n for i, n in enumerate([40, 40, 9, 5, 5, 5, 1]))] * 2 + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").toDF("te.xt").repartition(3)
    take = lambda n: sorted(bpe.frequent_words(docs, "te.xt", {}, n))
    assert take(2) == take(1) + [" wa", " wb"] and take(5) == [" wa", " wb", " wc"] and len(take(6)) == 6 and len(take(100)) == 7
    assert bpe.frequent_words(docs.limit(0), "te.xt", {}, 10) == []


def test_lexicon_is_minimal_and_complete():
    pairs = [(w.encode(), (i, i + 1)) for i, w in enumerate(["tap", "taps", "top", "tops", "a", "äö", "stop", "stops"])]
    lexicon = bpe.Lexicon(data=bpe.compile_lexicon(pairs))
    assert all(lexicon.get(w) == ids for w, ids in pairs)
    assert all(lexicon.get(w) is None for w in (b"", b"t", b"tapss", b"sto", b"zz"))
    # tap(s), top(s) and stop(s) share the state before "p"; all ends share theirs.
    assert len(lexicon.final) == 10  # 31 without sharing
    assert bpe.Lexicon(data=bpe.compile_lexicon([])).get(b"a") is None


def test_oracle_digests():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
