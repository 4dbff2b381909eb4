"""Benchmark decontamination by winnowing, in built-in functions.

A benchmark item occurs in a text where ``WINDOW`` of its consecutive words stand
consecutively (all of them, if the item has fewer). Both sides keep, of every run of
``w`` consecutive ``k``-word hashes, the smallest one. With ``k + w - 1`` equal to the
window's words, every shared window has a kept hash in common, so joining the kept
hashes finds every text with a hit. Texts without one are done after that join.

Candidates are then extended: each shared hash puts text and item side by side at
one offset; along it, the windows that agree word by word are the hits.

Items of fewer words get ``k`` and ``w`` for their own length; texts are fingerprinted once for each
such length that the benchmark holds (at most ``WINDOW`` lengths). Words are compared by 64-bit hashes.
Equal texts are worked on once: everything between the first and the last join is keyed by the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.sides import ascii_lower, checked_broadcast
from gleaner.plans.workspace import stored

WINDOW = 13
GRAM = 7
#: Words are runs of other characters, once A-Z are lower-case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing


def count_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_hashes(text: str) -> Column:
    """Array of the 64-bit hashes of a text's words; empty for null."""
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS, " ")), " ")
    words = F.when(F.get(parts, F.lit(0)) != "", parts).otherwise(F.array().cast("array<string>"))
    return F.transform(words, lambda w: F.xxhash64(w))


# explode_outer below: for explode Spark infers a filter on the array's size, and computes the array twice.


def _gram_size(length: int) -> tuple[int, int]:
    """``k`` and ``w`` that find every shared window of ``length`` words."""
    k = min(GRAM, length)
    return k, length - k + 1


def grams(words: str, length: int) -> str:
    """SQL of the hashes of all runs of ``k`` words, told apart by the window length they serve."""
    k, _ = _gram_size(length)
    run = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return (
        f"if(size({words}) >= {k}, transform(sequence(0, size({words}) - {k}), i -> xxhash64({length}, {run})), "
        f"cast(array() as array<bigint>))"
    )


def smallest(hashes: str, length: int) -> list[str]:
    """SQL steps that turn an array into the smallest of each run of ``w`` hashes.

    A step takes the smaller of neighbours 1, 2, 4, ... apart; runs cut off by the end count too.
    """
    _, w = _gram_size(length)
    steps, have = [], 1
    while have < w:
        step = min(have, w - have)
        steps.append(f"transform({hashes}, (x, i) -> least(x, get({hashes}, i + {step})))")
        have += step
    return steps


def _with_kept(rows: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """``rows`` with an array ``kept`` of the distinct kept hashes for all ``lengths``."""
    parts = []
    for length in lengths:
        name = f"g{length}"
        rows = rows.withColumn(name, F.expr(grams(words, length)))
        for step in smallest(name, length):
            rows = rows.withColumn(name, F.expr(step))
        parts.append(name)
    return rows.withColumn("kept", F.array_distinct(F.concat(*parts))).drop(*parts)


def _key(text: str) -> Column:
    """128-bit name of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _fingerprints(items: DataFrame, lengths: list[int]) -> DataFrame:
    """``(fp, item, length, at, words)``: kept hashes of the items and where they stand."""
    parts = []
    for length in lengths:
        mine = items.where((F.col("length") == length))
        kept = _with_kept(mine, "words", [length]).select("key", F.explode_outer("kept").alias("fp"))
        placed = mine.select("key", "item_id", "length", F.posexplode_outer(F.expr(grams("words", length))).alias("at", "fp"))
        parts.append(placed.join(kept, ["key", "fp"], "left_semi"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(key, n_hit, n_items, items)`` of the texts that hold a window of an item.

    ``key`` names the text (see ``_key``); ``items`` are the distinct item ids, as strings, sorted.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), word_hashes(item_text).alias("words"))
    items = items.where(F.size("words") > 0).distinct()
    items = items.withColumn("length", F.least(F.size("words"), F.lit(WINDOW))).withColumn("key", F.xxhash64("words"))
    items = stored(items, "bench-items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # at most WINDOW rows
    if not lengths:
        none = docs.sparkSession.createDataFrame([], "key struct<a:long,b:long>, n_hit long, n_items long, items array<string>")
        return none
    index = stored(_fingerprints(items, lengths), "bench-fingerprints")

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    kept = _with_kept(texts.select(_key("text").alias("key"), word_hashes("text").alias("words")), "words", lengths)
    kept = kept.select("key", F.explode_outer("kept").alias("fp"))
    shared = checked_broadcast(stored(index.select("fp").distinct(), "bench-hashes"))
    found = stored(kept.join(shared, "fp", "left_semi").select("key").distinct(), "bench-found")

    some = texts.withColumn("key", _key("text")).join(checked_broadcast(found), "key", "left_semi")
    some = some.groupBy("key").agg(F.first("text").alias("text"))
    some = stored(some.select("key", word_hashes("text").alias("words")), "bench-texts")
    offsets = []
    for length in lengths:
        placed = some.select("key", F.posexplode_outer(F.expr(grams("words", length))).alias("pos", "fp"))
        mine = index.where(F.col("length") == length).select("fp", "item_id", F.col("key").alias("item"), "length", "at")
        offsets.append(placed.join(mine, "fp").select("key", "item", "length", (F.col("pos") - F.col("at")).alias("off")))
    pairs = offsets[0]
    for part in offsets[1:]:
        pairs = pairs.union(part)
    pairs = pairs.distinct()
    by_text = items.select(F.col("key").alias("item"), F.col("words").alias("want"), "length").distinct()
    wide = pairs.join(by_text, ["item", "length"]).join(some, "key")
    agree = (
        "filter(sequence(0, size(want) - length), s -> off + s >= 0 and off + s + length <= size(words) "
        "and slice(words, off + s + 1, length) = slice(want, s + 1, length))"
    )
    # Negative starts are guarded: slice() refuses them.
    agree = agree.replace("slice(words, off + s + 1, length)", "slice(words, greatest(off + s, 0) + 1, length)")
    hits = wide.select("key", "item", "off", "length", F.explode_outer(F.expr(agree)).alias("s")).where("s is not null")
    hits = stored(hits.select("key", "item", (F.col("off") + F.col("s")).alias("start"), "length").distinct(), "bench-hits")
    covered = hits.select("key", "start", "length").distinct()
    covered = covered.select("key", F.explode(F.expr("sequence(start, start + length - 1)")).alias("pos"))
    words = covered.groupBy("key").agg(F.count_distinct("pos").alias("n_hit"))
    names = hits.select("key", "item").distinct().join(items.select(F.col("key").alias("item"), "item_id"), "item")
    names = names.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))  # at most the benchmark
    return words.join(names, "key", "left").select("key", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    share: int = 20,
    **options,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items, contaminated`` beside their columns.

    A text is contaminated when it has hits and ``share * n_hit >= n_words``. Null and
    wordless texts have no words and no hits; wordless items occur nowhere; items with
    a null id hit words without being named. Equal texts get equal results, rows that repeat stay apart.
    Columns of ``docs`` named like a result are replaced.
    """
    hits = stored(benchmark_hits(docs, benchmark, text_col, **options), "bench-result")
    results = ("n_words", "n_hit", "n_items", "items", "contaminated")
    rest = [c for c in docs.columns if c not in results]
    rows = docs.select(F.struct(*rest).alias("row"), count_words(text_col).alias("n_words"), _key(text_col).alias("key"))
    rows = rows.join(checked_broadcast(hits, 20_000), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        *[F.col(f"row.`{c}`") for c in rest],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
