"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that the rules label. Features: lengths, depth, digit ratio, character entropy, parameter
counts, and how often labelled URLs of the same host suffix (and first path segment) are blocked.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage

BLOCK, ALLOW = "block", "allow"
# The trees are fitted on at most about this many labelled URLs, drawn by hash; statistics and verdicts use all.
TRAINING_ROWS = 200_000
SMOOTHING = 5.0
PRIOR = 0.5  # block rate of a key without labels
FOLDS = 5  # of labels; a labelled row's statistics come from the other folds
STATISTICS = ("suffix1", "suffix2", "section")
LEXICAL = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "upper_ratio", "entropy", "parameters", "hyphens", "has_fragment", "longest_digits",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the URL is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules: list[Rule], pick) -> Column:
    """``pick(rule)`` of the longest rule that fits the host or one of its parent domains and starts the path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(pick(rule))).otherwise(out)
    return out


def _counts(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the keys of the suffix statistics to rows with url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    letters = F.split(url, "")
    # Entropy of the characters: each distinct one with its number of places.
    spread = F.aggregate(
        F.array_distinct(letters),
        F.lit(0.0),
        lambda total, c: total + (lambda n: n * F.log2(n))(F.greatest(F.size(F.filter(letters, lambda x: x == c)), F.lit(1)).cast("double")),
    )
    parts = F.split("host", r"\.")
    return urls.select(
        "*",
        F.char_length(url).cast("double").alias("url_length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"),
        _counts(F.col("path"), "/").alias("depth"),
        F.size(parts).cast("double").alias("labels"),
        (_counts(url, "[0-9]") / size).alias("digit_ratio"),
        (_counts(url, "[A-Z]") / size).alias("upper_ratio"),
        (F.log2(size) - spread / size).alias("entropy"),
        _counts(url, "[?&][^=&#]*=").alias("parameters"),
        _counts(F.col("host"), "-").alias("hyphens"),
        url.contains("#").cast("double").alias("has_fragment"),
        F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit("([0-9]+)")), lambda d: F.char_length(d))), F.lit(0)).cast("double").alias("longest_digits"),
        F.substring_index("host", ".", -1).alias("suffix1"),
        F.substring_index("host", ".", -2).alias("suffix2"),
        F.concat(F.substring_index("host", ".", -2), F.lit("/"), F.regexp_extract("path", "^/([^/]*)/", 1)).alias("section"),
    )


def with_statistics(rows: DataFrame) -> DataFrame:
    """Replaces each statistics key by its smoothed block rate among labelled rows.

    A labelled row takes the rate of the labels in the other folds, so neither its own label nor those of copies of its
    URL are in it; other rows take the rate of all labels. Folds are dealt by the URL's hash. Of a key all labels go
    into one row, combined before the shuffle.
    """
    rows = rows.withColumn("__fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    labelled = rows.where(F.col("label").isNotNull())
    for key in STATISTICS:
        of_fold = [F.when(F.col("__fold") == fold, F.col("label")) for fold in range(FOLDS)]
        rates = labelled.groupBy(key).agg(
            F.count("*").alias("__n"),
            F.sum("label").alias("__blocked"),
            F.array(*(F.count(x) for x in of_fold)).alias("__n_of"),
            F.array(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in of_fold)).alias("__blocked_of"),
        )
        rows = rows.join(rates, key, "left")
        own = F.col("label").isNotNull()
        known = F.coalesce("__n", F.lit(0)) - F.when(own, F.get("__n_of", F.col("__fold"))).otherwise(0)
        blocked = F.coalesce("__blocked", F.lit(0.0)) - F.when(own, F.get("__blocked_of", F.col("__fold"))).otherwise(0.0)
        rows = rows.withColumn(key, (blocked + SMOOTHING * PRIOR) / (known + SMOOTHING)).drop("__n", "__blocked", "__n_of", "__blocked_of")
    return rows.drop("__fold")


def training_rows(rows: DataFrame, kinds: dict[float, int], max_rows: int) -> DataFrame:
    """All labelled rows, or of each label that has more than half of ``max_rows`` so many, by the hash of a row number.

    Rows are drawn one by one, so copies of one URL neither fill the sample nor fall out of it together.
    """
    if "__row" not in rows.columns:
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
    bound, drawn = max(1, max_rows // 2), None
    for label, n in sorted(kinds.items()):
        own = rows.where(F.col("label") == label).select("features", "label", "__row")
        if sum(kinds.values()) > max_rows and n > bound:
            own = own.orderBy(F.xxhash64("__row"), "__row").limit(bound)
        drawn = own if drawn is None else drawn.unionByName(own)
    return drawn.select("features", "label")


def fit_trees(rows: DataFrame, max_rows: int = TRAINING_ROWS, seed: int = 7) -> GBTClassificationModel | str:
    """Boosted trees from at most ``max_rows`` rows with a label; a fixed verdict where there is nothing to tell apart.

    Without any label everything is allowed; with one kind of label that verdict holds for all.
    """
    kinds = {r.label: r["count"] for r in rows.where(F.col("label").isNotNull()).groupBy("label").count().collect()}
    if len(kinds) < 2:
        return BLOCK if 1.0 in kinds else ALLOW
    drawn = training_rows(rows, kinds, max_rows)
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=4, seed=seed).fit(drawn)


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", max_rows: int = TRAINING_ROWS) -> DataFrame:
    """``id_col``, host, path, rule, verdict, block_probability of every row.

    Rules decide where they fit (the longest wins); elsewhere the trees do, blocking from a probability of one half on.
    A null URL or one without ``://`` has an empty host and path, fits no rule and is judged by its features.
    Repeated rows and ids are judged one by one; an empty table gives no rows; other columns are ignored.
    The statistics are joined by key without a broadcast; a host with a third of all rows is split by the adaptive
    skew join, as its side of statistics is one row.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("*", host.alias("host"), path.alias("path"))
    ruled = urls.select(
        "*",
        matching_rule(F.col("host"), F.col("path"), rules, lambda r: r.text).alias("rule"),
        matching_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict).alias("ruled"),
    )
    labelled = ruled.withColumn("label", F.when(F.col("ruled") == BLOCK, 1.0).when(F.col("ruled") == ALLOW, 0.0))
    rows = stage(with_statistics(with_features(labelled)).withColumn("__row", F.monotonically_increasing_id()), "urls")
    assembled = VectorAssembler(inputCols=[*LEXICAL, *STATISTICS], outputCol="features").transform(rows)
    model = fit_trees(assembled, max_rows)
    if isinstance(model, str):
        judged = assembled.withColumn("p", F.lit(1.0 if model == BLOCK else 0.0))
    else:
        judged = model.transform(assembled).withColumn("p", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("p") >= 0.5, BLOCK).otherwise(ALLOW))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.col("p").alias("block_probability"))
