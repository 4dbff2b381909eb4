"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insult, threat, target, negation, reporting, quote, joining word,
comma, other. Five small transducers read the same symbols: one notes insults, one
threats, one whether a target is near, one whether a negation governs the word and one
whether the words are somebody else's. Their composition is a single machine whose
output names what a clause does: a plain, targeted, negated or reported insult or threat.
Its tags, not single words, are scored: the weight of each kind of clause is a
logistic fit on labelled documents that starts from (and without labels, stays at) hand-set weights.

The insult lexicon is a short fixed list plus the word stems that the labelled
documents show: beginnings of words found in many toxic and hardly any other documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.labelled import fit_logistic_rows, held_out, learning_rows
from gleaner.plans.workspace import stored

# Seed words of the grammar.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile bastard".split()
INSULTS += "dummkopf abschaum trottel versager imbécile crétin ordure idiota imbécil basura escoria".split()
THREATS = "kill destroy hurt beat burn punish crush töten vernichten tuer détruire matar destruir".split()
TARGETS = "you your yours he she they them him her people everyone du ihr dich euch sie tu vous toi ils te usted ellos".split()
NEGATIONS = "not no never isn't aren't don't wasn't without can't cannot won't doesn't didn't couldn't shouldn't wouldn't weren't hasn't haven't hadn't nicht kein keine nie pas jamais ne nunca ningún".split()
REPORTS = "said says wrote writes called calls claimed quoted reported sagte schrieb behauptete écrit déclaré dijo escribió".split()
JOINS = "and but yet und aber et mais y pero".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, JOIN, COMMA = range(9)
SYMBOLS = 9
KINDS = ("plain", "targeted", "negated", "reported")
TAGS = [f"{kind}_{what}" for what in ("insult", "threat") for kind in KINDS]
#: Bias, then one weight per tag, in natural logarithms of odds.
PRIOR = np.array([-3.0, 4.0, 5.0, 1.0, 1.0, 0.5, 2.5, 0.2, 0.2])
NEAR = 4  # words over which a target is near
SCOPE = 5  # words that a negation governs, up to a comma or joining word

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„,]")
CLAUSE = re.compile(r"[^.!?;\n]+")  # not cut at a colon: what follows "she wrote:" is reported


@dataclass
class Transducer:
    """States ``0..n-1`` from 0; ``step`` gives the next state and an output for a state and a symbol."""

    states: int
    table: dict = field(default_factory=dict)

    @classmethod
    def of(cls, states: int, step) -> Transducer:
        return cls(states, {(s, a): step(s, a) for s in range(states) for a in range(SYMBOLS)})


def fading(trigger: int, length: int, stops: tuple[int, ...] = ()) -> Transducer:
    """Outputs whether ``trigger`` was read within the last ``length`` words and no symbol of ``stops`` since; commas are no words."""
    left = lambda s, a: length if a == trigger else 0 if a in stops else s if a == COMMA else max(s - 1, 0)
    return Transducer.of(length + 1, lambda s, a: (left(s, a), s > 0))


def noting(symbol: int) -> Transducer:
    return Transducer.of(1, lambda s, a: (0, a == symbol))


def reporting() -> Transducer:
    """Outputs whether the word is somebody else's: between quotes, or in what a reporting verb governs.

    States: own words, words after a reporting verb, an open quote, and a joining word among the words after a verb. A
    quote opens after a verb as anywhere, and with its end the report ends. A joining word with a target behind it begins a clause of its own.
    """
    own, verb, quote, joined = range(4)
    after = {own: {REPORT: verb, QUOTE: quote}, quote: {QUOTE: own}}
    after[verb] = {s: verb for s in range(SYMBOLS)} | {QUOTE: quote, JOIN: joined}
    after[joined] = after[verb] | {TARGET: own}
    return Transducer.of(4, lambda s, a: (after[s].get(a, s), s != own))


def compose(machines: list[Transducer], output) -> tuple[np.ndarray, np.ndarray]:
    """Next-state and output tables of the machine that runs all ``machines`` on the same symbols.

    Only combinations of states that can be reached become states.
    """
    number, todo, rows, outs = {(0,) * len(machines): 0}, [(0,) * len(machines)], [], []
    for state in todo:
        row, out = [], []
        for symbol in range(SYMBOLS):
            moves = [m.table[s, symbol] for m, s in zip(machines, state)]
            target = tuple(t for t, _ in moves)
            if target not in number:
                number[target] = len(todo)
                todo.append(target)
            row.append(number[target])
            out.append(output([o for _, o in moves]))
        rows.append(row)
        outs.append(out)
    return np.array(rows), np.array(outs)


def _tag(outputs: list[bool]) -> int:
    """Tag number of one word, -1 for none; reported beats negated beats targeted."""
    insult, threat, target, negated, reported = outputs
    if not insult and not threat:
        return -1
    kind = 3 if reported else 2 if negated else 1 if target else 0
    return kind + (0 if insult else len(KINDS))


NEXT, OUT = (t.tolist() for t in compose(
    [noting(INSULT), noting(THREAT), fading(TARGET, NEAR), fading(NEGATION, SCOPE, (JOIN, COMMA)), reporting()], _tag
))


class Grammar:
    """The composed machine with a lexicon; reads a text, yields tag counts."""

    def __init__(self, stems: list[str]):
        self.symbols = dict.fromkeys(JOINS, JOIN) | {",": COMMA} | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(TARGETS, TARGET)
        self.symbols |= dict.fromkeys(THREATS, THREAT) | dict.fromkeys(INSULTS, INSULT)
        whole = "|".join(map(re.escape, sorted(INSULTS + THREATS)))
        begin = "|".join(map(re.escape, sorted(stems)))
        self.stems = tuple(stems)
        self.find = re.compile(rf"\b(?:(?:{whole})\b" + (rf"|(?:{begin})" if begin else "") + ")")

    def symbol(self, word: str) -> int:
        known = self.symbols.get(word)
        if known is None:
            known = QUOTE if word in "\"“”«»„" else INSULT if self.stems and word.startswith(self.stems) else OTHER
        return known

    def tags(self, text: str) -> list[int]:
        """Number of clauses per tag; a clause counts once for each tag in it."""
        counts = [0] * len(TAGS)
        text = text.lower().replace("’", "'")
        end = 0
        for match in self.find.finditer(text):
            if match.start() < end:
                continue  # in a clause already read
            start = max(text.rfind(c, 0, match.start()) for c in ".!?;\n") + 1
            clause = CLAUSE.match(text, start)
            end = clause.end()
            found, state = set(), 0
            for word in WORD.findall(clause.group()):
                symbol = self.symbol(word)
                found.add(OUT[state][symbol])
                state = NEXT[state][symbol]
            for tag in found - {-1}:
                counts[tag] += 1
        return counts


def _features(counts: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(counts)), np.log1p(counts) / np.log(2)]


@dataclass
class ToxicityModel:
    stems: list[str]
    weights: np.ndarray

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(counts) @ self.weights, -30, 30)))


def learn_stems(rows: DataFrame, least_docs: int = 6, share: float = 0.01, contexts: int = 6, ratio: float = 30.0, most: int = 2000
) -> list[str]:
    """Up to ``most`` beginnings of words that mark toxic documents among ``rows(text, y)``.

    A beginning of 4 to 8 letters that at least ``least_docs`` toxic documents, and a ``share`` of them, hold
    after ``contexts`` different words (copies of one toxic text hold it after the same) and that is ``ratio`` times as frequent there. Of nested ones the shortest stays that is no mere part of a longer one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        after: Counter = Counter()  # bits of the words a beginning stands after, in toxic texts

        def flush():
            for y, c in total.items():
                bits = [after[s] if y else 0 for s in c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64()), pa.array(bits, pa.int64())],
                    ["stem", "y", "n", "after"],
                )
                c.clear()
            after.clear()

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                words, toxic = WORD.findall(text.as_py().lower()), min(1, y.as_py())
                total[toxic].update({w[:k] for w in set(words) for k in range(4, min(8, len(w)) + 1)})
                if toxic:
                    for before, w in set(zip(["", *words], words)):
                        bit = 1 << crc32(before.encode()) % 63
                        for k in range(4, min(8, len(w)) + 1):
                            after[w[:k]] |= bit
                if len(total[0]) + len(total[1]) > 300_000:
                    yield from flush()
        yield from flush()

    toxic, clean = (F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    sizes = {r.y: r.n for r in rows.groupBy(F.least("y", F.lit(1)).alias("y")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return []
    counts = rows.mapInArrow(count, "stem string, y int, n long, after long").groupBy("stem")
    counts = counts.agg(toxic.alias("t"), clean.alias("c"), F.bit_count(F.bit_or("after")).alias("contexts"))
    lift = (F.col("t") / sizes[1]) / ((F.col("c") + 0.5) / sizes[0])
    least = max(least_docs, share * sizes[1])
    marked = counts.where((F.col("t") >= least) & (F.col("contexts") >= contexts) & (lift >= ratio)).orderBy(F.desc("t"), "stem").limit(most)
    held = {r.stem: r.t for r in marked.select("stem", "t").collect()}
    # A longer beginning that nearly all of the documents share says more than the shorter one.
    tight = [s for s, t in held.items() if not any(o != s and o.startswith(s) and n >= 0.9 * t for o, n in held.items())]
    out: list[str] = []
    for stem in sorted(tight, key=lambda s: (len(s), s)):
        if not out or not stem.startswith(tuple(out)):
            out.append(stem)
    return out


def _tag_counts(column: pa.Array, grammar: Grammar) -> np.ndarray:
    return np.array([grammar.tags(t.as_py() or "") for t in column], dtype=float).reshape(-1, len(TAGS))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", learn_rows: int | None = None) -> ToxicityModel:
    """Stems and clause weights from all labelled documents outside the held-out fold, or ``learn_rows`` of them.

    Only the stems and sums over the tag counts reach the driver.
    """
    rows = learning_rows(docs, labels, label, id_col, text_col, learn_rows)
    stems = learn_stems(rows)
    grammar = Grammar(stems)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(_tag_counts(batch.column(0), grammar))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    counts = rows.mapInArrow(read, "y int, x array<double>").withColumn("y", F.least("y", F.lit(1)))
    return ToxicityModel(stems, fit_logistic_rows(stored(counts, "toxicity-counts"), PRIOR, strength=1.0))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(id_col, held_out, score, predicted, tags)`` of every row; ``tags`` counts the clauses of each kind.

    Null and empty texts have no clauses and get the score of such texts. Repeated rows and null ids stay, equal texts score alike, an empty table gives no rows, and other columns are not
    returned. A text is read whole, clause by clause, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.stems)
        for batch in batches:
            counts = _tag_counts(batch.column(1), grammar)
            tags = pa.array([{t: int(n) for t, n in zip(TAGS, row) if n} for row in counts], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(counts)), tags], ["id", "score", "tags"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    kind = given.schema["id"].dataType.simpleString()
    out = given.mapInArrow(run, f"id {kind}, score double, tags map<string,int>")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "tags")


def keep_civil(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged, whatever their other columns are called.

    Null and empty texts score like texts without clauses; repeated rows stay or go together; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.stems)
        for batch in batches:
            keep = model.score(_tag_counts(batch.column(at), grammar)) < threshold
            yield batch.filter(pa.array(keep))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
