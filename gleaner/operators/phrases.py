"""Phrase and proximity clauses over positional postings.

A query string holds words, phrases in double quotes and phrases with a slop: ``"red fish"~2``. A phrase
occurs where its terms stand in their order, from the first to the last over at most
``slop`` further tokens. Positions count tokens, short and long ones included, so that a phrase never
reaches over a word that the index leaves out.

Positions of a term in a document are one array, so a document's part in a phrase is one row per term; its places are
found by an ordered join of the arrays inside the row, in built-in functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.constants import BM25_B, BM25_K1, MAX_HITS, TOKEN_MAX_LEN, TOKEN_MIN_LEN
from gleaner.operators.bounds import broadcast_if_small
from gleaner.operators.topk import query_keys, rounded, top_k

#: A quoted phrase with its slop.
CLAUSE = r'"([^"]*)"(?:~([0-9]{1,6}))?'


@dataclass(frozen=True)
class PositionalIndex:
    """``postings(lang, term, docid, places array<int>, dl)``, ``doc_freqs`` and ``corpus_stats`` as in a full-text index."""

    postings: DataFrame
    doc_freqs: DataFrame
    corpus_stats: DataFrame


def build_positional_index(
    docs: DataFrame,
    id_col: str = "docid",
    text_col: str = "text",
    min_len: int = TOKEN_MIN_LEN,
    max_len: int = TOKEN_MAX_LEN,
) -> PositionalIndex:
    """Positions of every index term per document; a ``lang`` column separates collections.

    A document is complete in its row, so its postings need no shuffle: tokens are sorted by term and
    place within the row and cut where the term changes.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    pieces = F.filter(T.pieces(F.col(text_col)), lambda p: p != "")
    tokens = docs.select(lang.alias("lang"), F.col(id_col).alias("docid"), pieces.alias("pieces"))
    placed = F.transform("pieces", lambda p, i: F.struct(p.alias("term"), i.alias("place")))
    kept = F.filter(placed, lambda t: T.is_token(t.term, min_len, max_len))
    bags = tokens.select("lang", "docid", kept.alias("tokens")).where(F.size("tokens") > 0)
    bags = bags.select("lang", "docid", F.size("tokens").cast("bigint").alias("dl"), F.array_sort("tokens").alias("tokens"))
    # Number of tokens before each new term, and behind the last one.
    cuts = F.filter(
        F.sequence(F.lit(0), F.size("tokens")),
        lambda i: (i == 0) | (i == F.size("tokens")) | (F.get("tokens", i).term != F.get("tokens", i - 1).term),
    )
    runs = bags.withColumn("cuts", cuts)
    run = F.transform(
        F.slice("cuts", 1, F.size("cuts") - 1),
        lambda start, i: F.struct(
            F.get("tokens", start).term.alias("term"),
            F.transform(F.slice("tokens", start + 1, F.get("cuts", i + 1) - start), lambda t: t.place).alias("places"),
        ),
    )
    postings = runs.select("lang", "docid", "dl", F.explode(run).alias("run"))
    postings = postings.select("lang", "run.term", "docid", "run.places", "dl")
    freqs = postings.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))
    stats = bags.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return PositionalIndex(postings, freqs, stats)


def query_clauses(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """``(lang, qid, clause, slop, terms)``: the phrases and single words of every query, repeated ones once.

    A phrase of one term is a word; words that the index leaves out don't count, in phrases they leave a gap that
    any token may fill.
    """
    lang = F.col("lang") if "lang" in queries.columns else F.lit("")
    text = F.coalesce(F.col(query_col), F.lit(""))
    quoted = F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(1))
    slops = F.transform(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(2)), lambda s: F.when(s == "", F.lit(0)).otherwise(s.cast("int")))
    words = F.transform(T.tokens(F.regexp_replace(text, CLAUSE, " ")), lambda w: F.struct(w.alias("body"), F.lit(0).alias("slop")))
    phrases = F.zip_with(quoted, slops, lambda b, s: F.struct(b.alias("body"), s.alias("slop")))
    clause = F.explode(F.array_distinct(F.concat(phrases, words)))
    found = queries.select(lang.alias("lang"), "qid", clause.alias("c")).select("lang", "qid", "c.body", "c.slop")
    pieces = F.transform(F.filter(T.pieces(F.col("body")), lambda p: p != ""), lambda p, i: F.struct(p.alias("term"), i.alias("at")))
    found = found.withColumn("terms", F.filter(pieces, lambda t: T.is_token(t.term))).where(F.size("terms") > 0)
    first = F.col("terms")[0].at
    found = found.withColumn("terms", F.transform("terms", lambda t: F.struct(t.term.alias("term"), (t["at"] - first).alias("at"))))
    return found.select("lang", "qid", "slop", "terms").distinct().withColumn("clause", F.xxhash64("slop", "terms"))


def _starts(terms: Column, slop: Column) -> Column:
    """First places of a phrase's occurrences: of ``terms``, arrays of places in phrase order with the places they have in the phrase.

    Without slop the arrays, moved to the phrase's beginning, are intersected. Otherwise from each place of the first
    term the nearest place of every further term is taken; the nearest ones make the shortest occurrence.
    """

    def reach(place: Column) -> Column:
        return F.aggregate(
            F.slice(terms, 2, F.size(terms)),
            F.struct(place.alias("last"), F.lit(0).alias("before")),
            lambda acc, t: F.struct(
                F.array_min(F.filter(t.places, lambda p: p >= acc.last + (t["at"] - acc.before))).alias("last"),
                t["at"].alias("before"),
            ),
            lambda acc: acc.last,
        )

    length = F.element_at(terms, -1)["at"]
    exact = F.aggregate(
        F.slice(terms, 2, F.size(terms)),
        terms[0].places,
        lambda acc, t: F.array_intersect(acc, F.transform(t.places, lambda p: p - t["at"])),
    )
    return F.when(slop == 0, exact).otherwise(F.filter(terms[0].places, lambda p: reach(p) <= p + length + slop))


def phrase_matches(queries: DataFrame, index: PositionalIndex) -> DataFrame:
    """``(lang, qid, clause, docid, tf, dl)``: how often each clause occurs in each document that has it.

    Clause terms meet the postings once; a document is kept for a clause when it has all of
    its different terms, and only then its places are compared.
    """
    clauses = query_clauses(queries)
    wanted = clauses.select("lang", "clause", "slop", "terms").distinct()
    listed = wanted.select("lang", "clause", "slop", F.size("terms").alias("parts"), F.explode("terms").alias("t"))
    listed = listed.select("lang", "clause", "slop", "parts", F.col("t.term").alias("term"), F.col("t.at").alias("at"))
    met = index.postings.join(broadcast_if_small(listed), ["lang", "term"])
    part = F.struct("at", "places")
    held = met.groupBy("lang", "clause", "slop", "parts", "docid", "dl").agg(F.array_sort(F.collect_list(part)).alias("terms"))
    held = held.where(F.size("terms") == F.col("parts"))
    held = held.withColumn("tf", F.size(_starts(F.col("terms"), F.col("slop"))).cast("bigint")).where("tf > 0")
    asked = broadcast_if_small(clauses.select("lang", "qid", "clause"))
    return held.join(asked, ["lang", "clause"]).select("lang", "qid", "clause", "docid", "tf", "dl")


def phrase_search(
    queries: DataFrame, index: PositionalIndex, k: int = MAX_HITS, k1: float = BM25_K1, b: float = BM25_B
) -> DataFrame:
    """``(qid, docid, score, rank)`` by BM25 over the clauses of each query: a phrase counts like a term.

    Its frequency in a document is the number of places where it begins, its document frequency that of the
    documents which hold it. Documents need one clause. Queries with a ``lang`` column stay in their language.
    """
    keys = query_keys(queries)
    matches = phrase_matches(queries, index)
    freqs = matches.select("lang", "clause", "docid").distinct().groupBy("lang", "clause").agg(F.count(F.lit(1)).alias("df"))
    rows = matches.join(freqs, ["lang", "clause"]).join(index.corpus_stats, "lang")
    n, df, tf, dl = (F.col(c).cast("double") for c in ("n", "df", "tf", "dl"))
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    return top_k(rows.groupBy(*keys, "docid").agg(rounded(F.sum(weight)).alias("score")), k)


def quoted(words: str, slop: int = 0) -> str:
    """A phrase clause of ``words``."""
    return '"' + re.sub('"', " ", words) + '"' + (f"~{slop}" if slop else "")
