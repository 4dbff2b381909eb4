"""Hits out of JSON search responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAT = "array<variant>"


def _number(value: Column) -> Column:
    """JSON number or numeric text as double; null for anything else."""
    return value.try_cast("double")


def _field(hit: Column, path: str) -> Column:
    return F.try_variant_get(hit, path, "string")


def parse_hits(df: DataFrame, qid: str = "qid", response: str = "response") -> DataFrame:
    """``(qid, rank, docid, score)`` of every hit, ``rank`` from 1 in response order.

    Two shapes are understood. A list carries scores in the hit and its hits
    without docid are dropped; an object ``hits.hits`` carries keyword and
    semantic scores in ``_source`` and keeps empty docids. The first non-null of
    keyword, semantic and plain score counts, a missing one is 0. A response that
    cannot be parsed, or that holds a score that is no number, has no hits.
    """
    # The parser stops at the end of the first value; inside an envelope anything
    # that follows it is an error too.
    envelope = F.concat(F.lit('{"response":'), F.col(response), F.lit(',"end":0}'))
    whole = F.when(F.size(F.json_object_keys(envelope)) == 2, F.try_parse_json(envelope))
    parsed = df.select(F.col(qid).alias("qid"), whole.alias("whole")).select(
        "qid", F.try_variant_get("whole", "$.response", "variant").alias("doc")
    )
    is_list = F.schema_of_variant("doc").startswith("ARRAY")
    flat = F.try_variant_get("doc", "$", FLAT)
    nested = F.try_variant_get("doc", "$.hits.hits", FLAT)
    hits = parsed.select(
        "qid", F.when(is_list, flat).otherwise(nested).alias("hits"), is_list.alias("is_list")
    )

    def shaped(hit: Column) -> Column:
        is_list = F.col("is_list")
        is_object = F.schema_of_variant(hit).startswith("OBJECT")
        docid = F.when(is_list, _field(hit, "$.docid_col")).otherwise(_field(hit, "$._source.docid_col"))
        special = [
            F.when(is_list, _field(hit, f"$.{name}")).otherwise(_field(hit, f"$._source.{name}"))
            for name in ("_keyword_score", "_semantic_score")
        ]
        text = F.coalesce(*special, _field(hit, "$._score"))
        return F.struct(
            (is_object & docid.isNotNull() & (~is_list | (docid != ""))).alias("keep"),
            docid.alias("docid"),
            text.alias("score_text"),
        )

    shaped_hits = hits.select("qid", F.filter(F.transform("hits", shaped), lambda h: h.keep).alias("hits"))
    good = F.forall("hits", lambda h: h.score_text.isNull() | _number(h.score_text).isNotNull())
    return (
        shaped_hits.where(good)
        .select("qid", F.posexplode("hits").alias("place", "hit"))
        .select(
            "qid",
            (F.col("place") + 1).cast("bigint").alias("rank"),
            F.col("hit.docid").alias("docid"),
            F.coalesce(_number(F.col("hit.score_text")), F.lit(0.0)).alias("score"),
        )
    )
