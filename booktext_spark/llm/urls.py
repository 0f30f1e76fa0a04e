"""URL filters: explicit rules, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from booktext_spark.llm.common import cut

#: (host, path, verdict) of the registered query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str) -> tuple[Column, Column]:
    """(host, path): after the first `://`; both empty for null and for a text without it."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url))))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens() -> Column:
    """Distinct tokens of host, path and url: host labels from the right, path folders, file ending, scheme, query."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -n, n), ".")))
    folders = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.concat(F.lit("dir:"), s))
    ending = F.concat(F.lit("ending:"), F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1))
    scheme = F.concat(F.lit("scheme:"), F.regexp_extract("url", "^([A-Za-z]+)://", 1))
    query = F.when(F.contains("url", F.lit("?")), F.lit("query"))
    return F.array_distinct(F.filter(F.concat(suffixes, folders, F.array(ending, scheme, query)), lambda t: t.isNotNull() & ~F.endswith(t, F.lit(":"))))


def frequent_tokens(labelled: DataFrame, support: float) -> dict[str, str]:
    """Tokens of a share `support` of the rows or more, each with the one that stands for it.

    Tokens that the same rows hold, such as the folders of one much used url, stand for each other: the shortest of them
    is mined for all, which keeps every rule and makes no itemset for each choice among them. Rows are told by a hash of their tokens.
    """
    n = labelled.count()
    each = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").cast("decimal(38,0)").alias("row"))
    counted = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("rows")).where(F.col("n") >= support * n)
    same = Window.partitionBy("n", "rows").orderBy(F.length("token"), "token")
    return {r.token: r.one for r in counted.select("token", F.first("token").over(same).alias("one")).collect()}  # as many as tokens of a url for each 1 / support


def mine_rules(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """antecedent, size, verdict, confidence, support of all rules tokens => verdict.

    labelled has tokens and verdict. Items below the support go before the mining, so the number of
    rules depends on the support, not on the rows.
    """
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict="), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.startswith(F.element_at("consequent", 1), F.lit("verdict=")))
    rules = rules.where(~F.exists("antecedent", lambda t: F.startswith(t, F.lit("verdict="))))
    return rules.select(F.array_sort("antecedent").alias("antecedent"), F.size("antecedent").alias("size"), F.substring(F.element_at("consequent", 1), 9, 1000).alias("verdict"), "confidence", "support")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = 0.01, confidence: float = 0.8, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) for each row.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins. Rows
    without a rule are judged by the association rules mined from those with one, over all labels of the host, all folders and
    the other tokens: an inverted index from tokens to rules finds the rules whose tokens all occur, the most confident decides (then the more
    supported, then the longer, then block), and `default` where none fits. Token sets are matched once
    each, however many pages share one. Null urls have empty host and path, no rule and the default;
    repeated rows are judged each; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = url_parts("url")
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "tokens": url_tokens()})
    known = frequent_tokens(rows.where("ruled is not null"), support)
    one = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]) if known else F.create_map().cast("map<string,string>")
    met = F.array_distinct(F.filter(F.transform("tokens", lambda t: F.try_element_at(one, t)), lambda t: t.isNotNull()))
    rows = rows.withColumn("met", F.array_sort(met)).drop("tokens")
    labelled = rows.where("ruled is not null").select(F.col("met").alias("tokens"), F.col("ruled").alias("verdict"))
    mined = cut(mine_rules(labelled, support, confidence).withColumn("rule_id", F.xxhash64("antecedent", "verdict")))

    index = mined.select(F.explode("antecedent").alias("token"), "rule_id", "size", "verdict", "confidence", "support")
    open_ = rows.where("rule is null").select("met").distinct().select("met", F.explode("met").alias("token"))
    found = open_.join(index, "token").groupBy("met", "rule_id").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support")).where("n = size")
    best = found.groupBy("met").agg(F.max_by("verdict", F.struct("confidence", "support", "size", "verdict")).alias("mined"))
    judged = rows.join(best, "met", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "mined", F.lit(default)).alias("verdict"))
