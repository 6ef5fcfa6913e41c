"""URL filter by a tree of path templates per host, in SQL expressions only.

Variable segments (numbers, codes, long slugs) become wildcards.  Level by level, down to the end of the deepest path, sibling
branches whose labelled share does not differ significantly from that of all siblings are merged into a
wildcard branch; a branch without siblings never differs from itself, so stretches without a fork are
passed at once and there are as many rounds as a path has forks.  A template is rejected if the smoothed share of its good labels is low;
smoothing draws it towards its host, and a host towards the corpus.  Fixed rules come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.stages import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = "://([^/?#]*)"
PATH = "://[^/?#]*([^?#]*)"
# A segment that names one item: digits, hex codes, names with digits, slugs of many words.
VARIABLE = r"^(?:[^.]*[0-9][^.]*|[0-9a-fA-F-]{16,}|(?:[^-_]+[-_]){3,}[^.]*)(\.[A-Za-z]{1,5})?$"
SMOOTHING = 10.0  # labelled pages that the prior counts for
LEAST_SHARE = 0.5
SIGNIFICANT = 1.96


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits.  A rule is host and
    path in one string; it fits the host, its subdomains, and paths that start with its path."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """All segments of a path, variable ones as ``*`` with their extension."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, VARIABLE, 1))).otherwise(s))


def _shared(one: Column, two: Column) -> Column:
    """How many first entries two arrays share."""
    least = F.least(F.size(one), F.size(two))
    same = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.coalesce(F.get(one, i - 1) == F.get(two, i - 1), F.lit(False)))
    differs = F.array_position(same, F.lit(False)).cast("int")
    return F.when(least == 0, 0).when(differs == 0, least).otherwise(differs - 1)


def grown_level(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their prefixes grown to behind the next fork, where similar sibling branches are merged.

    ``nodes`` has host, segs, rest (segments behind the prefix), prefix, n and good per distinct path shape.  What
    comes out has ``over`` too: the path ends at this fork."""
    parent = staged(
        nodes.groupBy("host", "prefix").agg(
            _shared(F.min("rest"), F.max("rest")).alias("run"), F.sum("n").alias("siblings_n"), F.sum("good").alias("siblings_good")
        ),
        "url-parents",
    )
    seg = F.coalesce(F.get("rest", F.col("run")), F.lit(""))
    here = staged(nodes.join(parent, ["host", "prefix"]).withColumn("seg", seg), "url-forks")
    branch = here.groupBy("host", "prefix", "seg").agg(
        F.sum("n").alias("b_n"), F.sum("good").alias("b_good"), F.max("siblings_n").alias("siblings_n"), F.max("siblings_good").alias("siblings_good")
    )
    share = (F.col("siblings_good") + 0.5) / (F.col("siblings_n") + 1.0)
    away = F.abs(F.col("b_good") - F.col("b_n") * share) > SIGNIFICANT * F.sqrt(F.col("b_n") * share * (1 - share))
    step = F.when((F.col("seg") == "") | F.col("seg").startswith("*") | away, F.col("seg")).otherwise(F.lit("*"))
    steps = staged(branch.select("host", "prefix", "seg", step.alias("step")), "url-steps")
    passed = F.transform(F.slice("rest", F.lit(1), F.col("run")), lambda s: F.when(s.startswith("*"), s).otherwise(F.lit("*")))
    added = F.concat(passed, F.when(F.col("step") == "", F.array().cast("array<string>")).otherwise(F.array("step")))
    prefix = F.concat("prefix", F.array_join(F.transform(added, lambda s: F.concat(F.lit("/"), s)), ""))
    rest = F.slice("rest", F.col("run") + 2, F.greatest(F.size("rest") - F.col("run") - 1, F.lit(0)))
    grown = here.join(steps, ["host", "prefix", "seg"])
    return staged(
        grown.select("host", "segs", rest.alias("rest"), prefix.alias("prefix"), "n", "good", (F.col("step") == "").alias("over")), "url-nodes"
    )


def judged_templates(pages: DataFrame) -> DataFrame:
    """(host, segs, template, purity): ``pages`` has host, segs and good (1, 0 or null)."""
    nodes = pages.groupBy("host", "segs").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    nodes = staged(nodes.select("host", "segs", F.col("segs").alias("rest"), F.lit("").alias("prefix"), "n", "good"), "url-nodes")
    ended = []
    while nodes.where(F.size("rest") > 0).head(1):
        grown = grown_level(nodes)
        # A path that ended at this fork is done: what goes on has a longer prefix.
        ended.append(grown.where("over").drop("rest", "over"))
        nodes = grown.where("not over").drop("over")
    ended.append(nodes.drop("rest"))
    nodes = reduce(DataFrame.unionByName, ended)
    templates = nodes.groupBy("host", "prefix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = staged(nodes.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "url-hosts")
    whole = hosts.agg(F.sum("host_n").alias("all_n"), F.sum("host_good").alias("all_good"))
    row = whole.head()
    prior = ((row["all_good"] or 0) + 1.0) / ((row["all_n"] or 0) + 2.0)
    of_host = (F.col("host_good") + SMOOTHING * prior) / (F.col("host_n") + SMOOTHING)
    purity = (F.col("good") + SMOOTHING * of_host) / (F.col("n") + SMOOTHING)
    scored = staged(templates.join(hosts, "host").select("host", "prefix", purity.alias("purity")), "url-templates")
    return nodes.join(scored, ["host", "prefix"]).select("host", "segs", F.col("prefix").alias("template"), "purity")


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row.

    ``labels`` has url_key and good (1 or 0); a page takes the label whose url_key is the first
    number in its path, or none.  Of several labels of one key the least counts.  A null URL, or
    one without ``://``, has empty host and path and is judged like any other.  ``rules``
    are (verdict, host and path), some hundred at most, as they become one expression.  Rows are
    independent: repeated rows and null ids stay as they are.  Very long paths are taken whole; an empty table gives
    no rows; extra columns of ``pages`` are not read.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    keyed = base.select(
        "*",
        rule.alias("rule"),
        verdict.alias("ruled"),
        segments(F.col("path")).alias("segs"),
        F.regexp_extract("path", r"/([0-9]{1,18})(?:[./]|$)", 1).try_cast("bigint").alias("url_key"),
    )
    given = labels.where(F.col("url_key").isNotNull()).groupBy("url_key").agg(F.min("good").alias("good"))
    rows = staged(keyed.join(staged(given, "url-labels"), "url_key", "left").drop("url_key"), "url-rows")
    judged = staged(judged_templates(rows.select("host", "segs", "good")), "url-judged")
    method = F.when(F.col("purity") < LEAST_SHARE, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(judged, ["host", "segs"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity"
    )
