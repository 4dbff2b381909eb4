"""License scans by ordered signature rules, in built-in functions.

Rules are regular expressions over the words of a text, joined by single spaces. They
come from a table of licenses (names, short names, versions) and of the forms in which a license is
declared, a few hundred in all. A rule is tried only on texts that hold its keyword: one
pass over a text collects its keywords, which are joined with the rules. Detections that
lie inside a longer one, or inside one of equal extent and higher priority, are suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm.decontaminate import SEPARATORS, count_words
from gleaner.llm.sides import ascii_lower

# Licenses as (label, keyword, names in words). The keyword is a word of each of its names.
LICENSES = [
    ("mit", "mit", ["mit"]),
    ("apache-2", "apache", ["apache license version 2", "apache license 2", "apache 2"]),
    ("apache-1.1", "apache", ["apache software license version 1 1"]),
    ("gpl-2", "gpl", ["gpl v2", "gpl 2", "gpl 2 0"]),
    ("gpl-2", "gplv2", ["gplv2"]),
    ("gpl-2", "gnu", ["gnu general public license version 2", "gnu gpl version 2"]),
    ("gpl-3", "gpl", ["gpl v3", "gpl 3", "gpl 3 0"]),
    ("gpl-3", "gplv3", ["gplv3"]),
    ("gpl-3", "gnu", ["gnu general public license version 3", "gnu gpl version 3"]),
    ("gpl", "gnu", ["gnu general public license", "gnu gpl"]),
    ("lgpl-2.1", "lgpl", ["lgpl v2 1", "lgpl 2 1"]),
    ("lgpl-2.1", "lgplv2", ["lgplv2 1"]),
    ("lgpl-3", "gnu", ["gnu lesser general public license version 3"]),
    ("lgpl", "gnu", ["gnu lesser general public license", "gnu library general public license"]),
    ("agpl-3", "gnu", ["gnu affero general public license version 3", "gnu affero general public license"]),
    ("agpl-3", "agpl", ["agpl v3", "agpl 3"]),
    ("agpl-3", "agplv3", ["agplv3"]),
    ("bsd-3", "bsd", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"]),
    ("bsd-2", "bsd", ["bsd 2 clause", "2 clause bsd", "simplified bsd"]),
    ("bsd-2", "freebsd", ["freebsd"]),
    ("bsd", "bsd", ["bsd"]),
    ("mpl-2", "mpl", ["mpl 2 0", "mpl 2"]),
    ("mpl-2", "mplv2", ["mplv2"]),
    ("mpl-2", "mozilla", ["mozilla public license version 2", "mozilla public license"]),
    ("epl", "eclipse", ["eclipse public license"]),
    ("isc", "isc", ["isc"]),
    ("unlicense", "unlicense", ["unlicense"]),
    ("zlib", "zlib", ["zlib", "zlib libpng"]),
    ("boost", "boost", ["boost software"]),
    ("artistic-2", "artistic", ["artistic license 2 0", "artistic license 2"]),
    ("cc0", "cc0", ["cc0 1 0", "cc0"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa"]),
    ("cc-by-nc", "cc", ["cc by nc"]),
    ("cc-by-nd", "cc", ["cc by nd"]),
    ("cc-by-sa", "cc", ["cc by sa"]),
    ("cc-by", "cc", ["cc by"]),
    ("cc-by-nc-sa", "creative", ["creative commons attribution noncommercial sharealike"]),
    ("cc-by-nc", "creative", ["creative commons attribution noncommercial", "creative commons attribution non commercial"]),
    ("cc-by-sa", "creative", ["creative commons attribution sharealike", "creative commons attribution share alike"]),
    ("cc-by", "creative", ["creative commons attribution"]),
    ("public-domain", "domain", ["public domain"]),
    ("proprietary", "reserved", ["all rights reserved"]),
]
#: Forms of a declaration as (pattern around the name, confidence).
FORMS = [
    ("spdx license identifier {name}", 1.0),
    ("(?:this (?:work|software|program|code|text) is )?(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?{name}(?: license| licence)?(?: \\d+(?: \\d+)?)?", 0.95),
    ("(?:permission is granted|redistributed) under (?:the )?{name}", 0.9),
    ("licen[sc]e (?:is )?{name}", 0.85),
    ("{name} licen[sc]e(?:d)?", 0.8),
]
#: Names that say enough on their own, by number of words.
BARE_WORDS, BARE_CONFIDENCE = 3, 0.7
#: The phrases every scan reports whatever else it finds.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


def rules() -> list[tuple[int, str, str, str, float]]:
    """``(priority, keyword, label, regex, confidence)`` of all rules; smaller priorities come first."""
    out = []
    for label, keyword, names in LICENSES:
        for name in names:
            forms = list(FORMS)
            if len(name.split()) >= BARE_WORDS:
                forms.append(("{name}", BARE_CONFIDENCE))
            for form, confidence in forms:
                out.append((keyword, label, f"(?<= ){form.format(name=name)}(?= )", confidence))
    return [(i, *rule) for i, rule in enumerate(out)]


def _places(words: str, phrase: str) -> Column:
    """Starts (in words, from 0) of a phrase in a text given as words between single spaces.

    ``words`` starts and ends with a space. Text before a match has one space more than words.
    """
    pieces = f"split({words}, ' (?={re.escape(phrase)} )')"
    spaces = "length(p) - length(replace(p, ' ', ''))"
    # Each cut takes away one space; sums of the pieces' spaces give the word numbers.
    sums = (
        f"aggregate(slice({pieces}, 1, size({pieces}) - 1), named_struct('n', 0L, 'all', cast(array() as array<bigint>)), "
        f"(acc, p) -> named_struct('n', acc.n + ({spaces}) + 1, 'all', array_append(acc.all, acc.n + ({spaces}))), acc -> acc.all)"
    )
    return F.expr(f"if(instr({words}, ' {phrase} ') > 0, {sums}, cast(array() as array<bigint>))")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_base, first_word, last_word, base_labels, detections, labels, score`` beside their columns.

    ``detections`` holds ``(start, end, label, confidence)`` in characters of the normalised text, overlaps resolved. ``labels``
    are the distinct labels of phrases and detections, ``score`` the highest confidence (a base phrase
    counts 0.8, no finding 0). Null and empty texts have no words and no findings. Equal texts are scanned
    once; rows that repeat or lack an id stay. Columns named like a result are replaced.
    """
    spark = docs.sparkSession
    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score")
    rest = [c for c in docs.columns if c not in results]
    found = _findings(spark, docs.select(F.col(text_col).alias("text")))
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("text"))
    rows = rows.select("row", count_words("text").alias("n_words"), key.alias("key")).join(found, "key", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        *[F.col(f"row.`{c}`") for c in rest],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        "detections",
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _findings(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """Findings by text, for texts that hold a keyword at all."""
    values = ", ".join(f"({i}, '{keyword}', '{label}', r'{regex}', {confidence}D)" for i, keyword, label, regex, confidence in rules())
    table = spark.sql(f"select * from values {values} as t(priority, keyword, label, regex, confidence)")
    keywords = sorted({r[1] for r in rules()})
    gate = r"(?i)(?<![a-z0-9])(?:" + "|".join(keywords) + r")(?![a-z0-9])"
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"))
    gated = texts.where(F.col("text").rlike(gate)).select(key.alias("key"), "text")
    gated = gated.groupBy("key").agg(F.first("text").alias("text"))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower("text"), SEPARATORS, " ")), F.lit(" "))
    gated = gated.select("key", words.alias("words"))
    plain = gate.replace("(?i)", "")
    present = F.array_distinct(F.regexp_extract_all("words", F.lit(plain), F.lit(0)))

    tried = gated.select("key", "words", F.explode_outer(present).alias("keyword")).join(F.broadcast(table), "keyword")
    # All matches with their places: pieces between matches and the matches themselves take turns.
    tried = tried.withColumn("hits", F.expr("regexp_extract_all(words, regex, 0)")).where("size(hits) > 0")
    tried = tried.withColumn("gaps", F.expr("split(words, regex)"))
    spans = F.expr(
        "aggregate(sequence(0, size(hits) - 1), named_struct('at', 0, 'all', cast(array() as array<struct<s:int,e:int>>)), "
        "(acc, i) -> named_struct('at', acc.at + length(gaps[i]) + length(hits[i]), "
        "'all', array_append(acc.all, named_struct('s', acc.at + length(gaps[i]), 'e', acc.at + length(gaps[i]) + length(hits[i])))), "
        "acc -> acc.all)"
    )
    one = tried.select("key", "priority", "label", "confidence", F.explode_outer(spans).alias("span"))
    one = one.select("key", F.struct(
        F.col("span.s").alias("start"), F.col("span.e").alias("end"), "label", "confidence", "priority").alias("d"))
    # A text's detections are at most its words times the rules.
    held = one.groupBy("key").agg(F.collect_set("d").alias("all"))
    inside = (
        "exists(all, o -> o.start <= d.start and o.end >= d.end and o != d and "
        "(o.end - o.start > d.end - d.start or o.priority < d.priority))"
    )
    held = held.select("key", F.expr(f"sort_array(filter(all, d -> not {inside}))").alias("kept"))
    held = held.select("key", F.expr("transform(kept, d -> named_struct('start', d.start, 'end', d.end, 'label', d.label, 'confidence', d.confidence))").alias("detections"))

    places = [(_places("words", phrase), label) for phrase, label in BASE]
    base = gated.select("key", *[c.alias(f"p{i}") for i, (c, _) in enumerate(places)])
    starts = F.concat(*[F.col(f"p{i}") for i in range(len(places))])
    named = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, label) for i, (_, label) in enumerate(places)]))
    base = base.select("key", starts.alias("starts"), F.array_sort(named).alias("base_labels"))
    both = base.join(held, "key", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce(F.expr("transform(detections, d -> d.label)"), F.array().cast("array<string>"))))
    best = F.greatest(F.when(F.size("starts") > 0, 0.8).otherwise(0.0), F.coalesce(F.expr("array_max(transform(detections, d -> d.confidence))"), F.lit(0.0)))
    return both.select(
        "key",
        F.size("starts").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        "base_labels",
        "detections",
        labels.alias("labels"),
        best.alias("score"),
    )
