"""URL filters by host-suffix and path-prefix expressions, short hash prefixes and full digests.

Every URL is expanded into the expressions a rule could be written in: each suffix of
its host at a dot, with each beginning of its path that is as long as some rule's
path. The first bytes of an expression's digest are the join key, as in safe-browsing lists:
the join is an equi-join on short keys, a full digest confirms the match, and the longest
rule wins. Beginnings of other lengths match no rule, so none is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.sides import ascii_lower, checked_broadcast
from gleaner.plans.workspace import stored

KEY_DIGITS = 8  # hex digits of the digest that are joined: 4 bytes
RULE_SCHEMA = "host string, path string, verdict string"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without ``://``."""
    rest = F.expr(f"case when instr({url}, '://') > 0 then substring({url}, instr({url}, '://') + 3) else '' end")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` beside their columns (columns of these names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's. Of
    several the longest (host and path together) wins, then the one that sorts first; of equal
    rules with different verdicts, block. Without a rule ``rule`` is null and the
    verdict is ``default``. Rules with a null in them are ignored, empty hosts fit no rule. Rows that
    repeat are judged alike, null URLs get the default.
    """
    listed = rules.where("host is not null and path is not null and verdict is not null and host != ''")
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
    text = F.concat("host", "path")
    listed = listed.select(
        text.alias("rule"),
        F.sha2(F.concat_ws("\0", "host", "path"), 256).alias("digest"),
        F.char_length("path").alias("reach"),
        "verdict",
    )
    listed = stored(listed.withColumn("key", F.left("digest", F.lit(KEY_DIGITS))), "url-rules")
    reaches = listed.agg(F.sort_array(F.collect_set("reach"))).first()[0]  # distinct lengths of rule paths

    results = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c not in results]
    host, path = host_and_path("url")
    urls = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url")).distinct()
    urls = urls.select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffix = F.explode_outer(F.sequence(F.lit(1), F.size(labels)))
    spread = urls.where("host != ''").select("url", "path", labels.alias("labels"), suffix.alias("from"))
    suffixes = spread.select("url", "path", F.array_join(F.expr("slice(labels, `from`, size(labels))"), ".").alias("suffix"))
    reach = F.explode_outer(F.lit(reaches or [-1]))
    wide = suffixes.select("url", "suffix", "path", reach.alias("reach")).where("reach >= 0 and char_length(path) >= reach")
    digest = F.sha2(F.concat_ws("\0", "suffix", F.expr("left(path, reach)")), 256)
    wide = wide.select("url", digest.alias("mine")).withColumn("key", F.left("mine", F.lit(KEY_DIGITS)))
    hits = wide.join(checked_broadcast(listed.drop("reach")), "key").where("mine = digest")
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.char_length("rule"), F.expr("transform(split(rule, ''), c -> -ascii(c))")))
    best = hits.groupBy("url").agg(best.alias("best"))

    h, p = host_and_path("url_")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(url_col).alias("url_"))
    rows = rows.select("row", "url_", h.alias("host"), p.alias("path")).join(best, F.col("url_") == F.col("url"), "left")
    return rows.select(
        *[F.col(f"row.`{c}`") for c in rest],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
