"""Phrase clauses against a scan of the words."""

import math
import random
import re

from gleaner.operators import phrases
from tests.conftest import rows


def words_of(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def count(words, clause, slop):
    terms = [(i, t) for i, t in enumerate(words_of(clause)) if 3 <= len(t) <= 84]
    base, found = terms[0][0], 0
    for start, word in enumerate(words):
        if word != terms[0][1]:
            continue
        last, before = start, 0
        for at, term in terms[1:]:
            places = [p for p, w in enumerate(words) if w == term and p >= last + (at - base) - before]
            if not places:
                break
            last, before = min(places), at - base
        else:
            found += last <= start + (terms[-1][0] - base) + slop
    return found


def brute(queries, docs, k):
    """``queries``: qid -> [(clause, slop)], words as clauses of their own."""
    bags = {d: words_of(t) for d, t in docs}
    lengths = {d: sum(3 <= len(w) <= 84 for w in b) for d, b in bags.items()}
    lengths = {d: n for d, n in lengths.items() if n}
    mean, out = sum(lengths.values()) / len(lengths), []
    for qid, clauses in queries.items():
        scores = {}
        for clause, slop in clauses:
            tf = {d: c for d in lengths if (c := count(bags[d], clause, slop))}
            idf = math.log(1 + (len(lengths) - len(tf) + 0.5) / (len(tf) + 0.5))
            for d, c in tf.items():
                scores[d] = scores.get(d, 0) + idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * lengths[d] / mean))
        ranked = sorted((-round(s, 6), d) for d, s in scores.items())[:k]
        out += [(qid, d, -s, i) for i, (s, d) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def test_phrases_equal_a_scan(spark):
    rnd = random.Random(9)
    vocabulary = ["red", "blue", "fish", "of", "a", "sea", "été", "under_score"]
    docs = [(f"d{i}", rnd.choice([" ", ", ", " - "]).join(rnd.choices(vocabulary, k=rnd.randrange(1, 40)))) for i in range(120)]
    docs += [("none", None), ("empty", ""), ("short", "of a"), ("long", "red of fish " * 4000)]
    texts = {
        "q1": '"red fish"', "q2": '"Red, of fish" sea', "q3": '"red blue"~2 "red blue"', "q4": '"fish a sea"~3 été',
        "q5": '"red red"', "q6": '"red red red"~4', "q7": "nothing", "q8": '"of a"', "q9": '"sea" sea sea', "q10": None,
    }
    clauses = {
        "q1": [("red fish", 0)], "q2": [("red of fish", 0), ("sea", 0)], "q3": [("red blue", 2), ("red blue", 0)], "q4": [("fish a sea", 3), ("été", 0)],
        "q5": [("red red", 0)], "q6": [("red red red", 4)], "q7": [("nothing", 0)], "q9": [("sea", 0)],
    }
    index = phrases.build_positional_index(spark.createDataFrame(docs, "docid string, text string").repartition(5))
    queries = spark.createDataFrame(list(texts.items()), "qid string, query string")
    got = phrases.phrase_search(queries, index, 20)
    assert rows(got, "qid", "docid", "score", "rank") == brute(clauses, docs, 20)
    assert phrases.phrase_search(queries.limit(0), index).count() == 0


def test_languages_stay_apart(spark):
    docs = spark.createDataFrame([("en", "a", "red fish"), ("fr", "b", "red fish here")], "lang string, docid string, text string")
    queries = spark.createDataFrame([("fr", "q", phrases.quoted("red fish", 1)), ("de", "q", '"red fish"')], "lang string, qid string, query string")
    assert rows(phrases.phrase_search(queries, phrases.build_positional_index(docs)), "lang", "qid", "docid") == [("fr", "q", "b")]
