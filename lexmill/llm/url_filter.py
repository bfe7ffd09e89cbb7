"""Operator 6: URL rules, and gradient-boosted trees on lexical features where no rule fits; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower, drawn, join_groups
from lexmill.session import stage

#: (host and path, verdict)
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: Labelled URLs that the trees are fitted on, and parts they are dealt to for the suffix statistics.
SAMPLE, FOLDS = 20_000, 4
TREES, DEPTH = 20, 4
FEATURES = (
    "n_url", "n_host", "n_path", "depth", "labels", "digits", "entropy", "parameters", "has_fragment", "dashes",
    "secure", "suffix_blocked", "suffix_weight",
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` or for null."""
    whole = F.coalesce(url, F.lit(""))
    pick = lambda i: F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return ascii_lower(pick(1)), pick(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    ranked = sorted(rules, key=lambda r: -len(r[0]))

    def fits(rule: str) -> Column:
        at, slash, rest = rule.partition("/")
        return ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)

    first = lambda pick: reduce(lambda e, r: F.when(fits(r[0]), pick(r)).otherwise(e), reversed(ranked), F.lit(None).cast("string"))
    return first(lambda r: F.lit(r[0])), first(lambda r: F.lit(r[1]))


def entropy(text: Column) -> Column:
    """Bits a character of the text's own character distribution."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    letters = F.array_distinct(F.split(text, ""))
    bits = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(size > 0, bits).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, ruled verdict, host suffix and the features that depend on the URL alone."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = parts(F.col("url"))
    named = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"))
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    count = lambda text, c: (F.length(text) - F.length(F.translate(text, c, ""))).cast("double")
    return named.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
        F.element_at(F.split(host, r"\."), -1).alias("suffix"),
        F.length(url).cast("double").alias("n_url"),
        F.length(host).cast("double").alias("n_host"),
        F.length(path).cast("double").alias("n_path"),
        count(path, "/").alias("depth"),
        count(host, ".").alias("labels"),
        F.when(F.length(url) > 0, count(url, "0123456789") / F.length(url)).otherwise(0.0).alias("digits"),
        entropy(url).alias("entropy"),
        count(F.regexp_extract(url, r"\?([^#]*)", 1), "=&").alias("parameters"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        count(url, "-_").alias("dashes"),
        F.startswith(url, F.lit("https:")).cast("double").alias("secure"),
    )


def with_suffixes(rows: DataFrame) -> DataFrame:
    """The rows with smoothed share of blocked URLs and log count of their host's suffix.

    A labelled URL sees the statistics of the other folds only, so its own label isn't among what predicts it; other URLs
    see those of all labelled ones. Every suffix has statistics, however rare. They are counts summed before the shuffle;
    the most frequent suffixes are joined back by broadcast (join_groups), the others by shuffling.
    """
    blocked = (F.col("ruled") == "block").cast("int")
    each = [x for k in range(FOLDS) for x in (F.count_if(F.col("fold") == k).alias(f"n{k}"), F.sum(F.when(F.col("fold") == k, blocked).otherwise(0)).alias(f"b{k}"))]
    folded = rows.withColumn("fold", F.when(F.col("ruled").isNotNull(), F.pmod(F.xxhash64("page_id", F.lit("fold")), F.lit(FOLDS)).cast("int")))
    groups = folded.groupBy("suffix").agg(F.count("*").alias("size"), *each)
    joined = join_groups(folded, groups, "suffix", "size", rows.count())
    own = lambda c: reduce(lambda a, b: a + b, (F.when(F.col("fold").eqNullSafe(F.lit(k)), 0).otherwise(F.col(f"{c}{k}")) for k in range(FOLDS)))
    found = joined.withColumns({"suffix_blocked": (own("b") + 1) / (own("n") + 2), "suffix_weight": F.log1p(own("n").cast("double"))})
    return found.select(*rows.columns, "suffix_blocked", "suffix_weight")


def fit_trees(full: DataFrame, sample: int = SAMPLE) -> PipelineModel:
    """Boosted trees fitted on about `sample` of the labelled URLs, drawn by the hash of what they look like; URLs that are
    alike in all features and in their fold count once."""
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    labelled = full.filter(F.col("ruled").isNotNull())
    chosen = drawn(labelled, ["host", "path", *FEATURES], sample, "urls")
    examples = stage(chosen.select("host", "path", (F.col("ruled") == "block").cast("double").alias("label"), *FEATURES).distinct().drop("host", "path"), "urls")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label")
    return Pipeline(stages=[vector, trees]).fit(examples)


def judge_urls(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict for each page.

    The longest fitting rule decides. URLs that a rule decides are also the labelled examples: suffix statistics cover
    all of them, and the boosted trees are fitted on a bounded sample. The trees judge all other URLs; a score of exactly
    one half is allowed. Null URLs and URLs without `://` have an empty host and path and are judged by the trees too.
    Where the labelled URLs know one verdict only, that verdict holds; where there are none, all is allowed. Repeated rows
    are judged alike, null ids like others. Empty table: no rows. Columns other than page_id and url are not read.
    """
    rows = lexical(pages)
    sizes = {r["ruled"]: r["count"] for r in rows.filter(F.col("ruled").isNotNull()).groupBy("ruled").count().collect()}
    if len(sizes) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(next(iter(sizes), "allow"))).alias("verdict"))
    full = with_suffixes(rows)
    judged = fit_trees(full).transform(full)
    verdict = F.coalesce("ruled", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
