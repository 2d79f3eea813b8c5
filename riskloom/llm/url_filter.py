"""URL filter: listed rules first, boosted trees on lexical features for the rest.

A rule is a host and a path beginning with a verdict; it fits its host and all subdomains if the path starts
with the rule's, and of several the longest wins (of equally long ones that with the longer host, then
block). URLs that no rule fits are judged by gradient-boosted trees, trained on labelled URLs, over lengths,
depth, digit and letter shares, entropy, parameter counts, and statistics of the host's last one and two labels:
how often they occur among all pages, and how often they are blocked among the labelled. A URL that teaches the trees
gets the blocked shares of the other folds of labelled URLs, so its own label is not among its features.

A NULL URL and one without ``://`` have an empty host and path; no rule fits, and the trees judge the text
(NULL as empty). Repeated URLs are judged each. Without labelled URLs, or with allowed ones only, all URLs
that no rule fits are allowed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import boosting
from riskloom.llm.common import ascii_lower, table
from riskloom.session import materialise


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)

FEATURES = 20
#: Folds of the labelled URLs, and the statistics of host endings among the features.
FOLDS = 5
STATISTICS = ("rate1", "rate2", "count1", "count2")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z in lower case; empty without it."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the winning rule, NULL where none fits; for a short list of rules."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def suffix(host: Column, labels: int) -> Column:
    """The last ``labels`` dot-separated labels of a host."""
    return F.substring_index(host, ".", -labels)


def features_of(url: str, host: str, path: str) -> list[float]:
    """Lexical features of one URL."""
    n = max(len(url), 1)
    seen = Counter(url)
    entropy = -sum(v / n * math.log2(v / n) for v in seen.values()) if url else 0.0
    query = url.partition("#")[0].partition("?")[2]
    digits = sum(v for c, v in seen.items() if c.isdigit())
    labels = host.split(".") if host else []
    name = max(labels, key=len, default="")
    return [
        len(url), len(host), len(path), len(query), len(labels), path.count("/"), digits / n,
        sum(c.isdigit() for c in host) / max(len(host), 1), entropy, query.count("=") + query.count("&"),
        host.count("-"), path.count("-") + path.count("_"), float("#" in url), float(url.startswith("https")),
        len(name), float("." in path.rpartition("/")[2]),
    ]


def with_suffix_statistics(urls: DataFrame, labelled: DataFrame, pages: DataFrame, teach: bool = False) -> DataFrame:
    """``urls`` (url, host) with ``STATISTICS`` of the host's last one and two labels.

    ``rate`` is the blocked share among ``labelled`` (url, host, blocked), smoothed to one half; with ``teach`` that of
    the folds that the URL is not in. ``count`` is the logarithm of their number among ``pages`` (host). All are
    aggregated before they are joined.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    out = urls.withColumn("_fold", fold) if teach else urls
    for k in (1, 2):
        s = suffix(F.col("host"), k).alias(f"s{k}")
        out = out.withColumn(f"s{k}", suffix(F.col("host"), k))
        stat = labelled.groupBy(s).agg(F.sum("blocked").alias("_b"), F.count("*").alias("_n"))
        out = out.join(stat, f"s{k}", "left").fillna(0, ["_b", "_n"])
        if teach:
            own = labelled.groupBy(s, fold.alias("_fold")).agg(F.sum("blocked").alias("_fb"), F.count("*").alias("_fn"))
            out = out.join(own, [f"s{k}", "_fold"], "left").fillna(0, ["_fb", "_fn"])
            out = out.withColumns({"_b": F.col("_b") - F.col("_fb"), "_n": F.col("_n") - F.col("_fn")}).drop("_fb", "_fn")
        number = pages.groupBy(s).agg(F.log1p(F.count("*")).alias(f"count{k}"))
        out = out.join(number, f"s{k}", "left").fillna(0.0, [f"count{k}"])
        out = out.withColumn(f"rate{k}", (F.col("_b") + 1.0) / (F.col("_n") + 2.0)).drop("_b", "_n", f"s{k}")
    return out.drop("_fold")


def _matrix(url: pd.Series, host: pd.Series, path: pd.Series, *statistics: pd.Series) -> np.ndarray:
    lexical = np.array([features_of(u or "", h, p) for u, h, p in zip(url, host, path, strict=True)], dtype=float)
    return np.column_stack([lexical.reshape(-1, FEATURES - len(STATISTICS)), *[s.to_numpy(float) for s in statistics]])


def _blocked_score(model: boosting.Trees) -> Column:
    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(model.scores(_matrix(*cols)))

    return of("url", "host", "path", *STATISTICS)


def fit(labelled: DataFrame, per_class: int = 10_000) -> boosting.Trees:
    """Trees from at most ``per_class`` URLs of each class of ``labelled`` (url, host, path, STATISTICS, blocked)."""
    size = dict(labelled.groupBy("blocked").count().collect())
    order = [F.xxhash64("url"), "url"]
    parts = [labelled.where(F.col("blocked") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    names = ["url", "host", "path", *STATISTICS, "blocked"]
    got = pd.concat([pd.DataFrame([tuple(r) for r in p.select(*names).collect()], columns=names) for p in parts])
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n1:
        return boosting.fit(np.zeros((0, FEATURES)), np.zeros(0), prior=1e-6)
    x = _matrix(*(got[c] for c in names[:-1]))
    return boosting.fit(x, got["blocked"].to_numpy(np.int64), prior=n1 / (n0 + n1))


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of ``pages`` (page_id, url).

    ``labelled`` has url and blocked (0 or 1); by default the URLs that a rule fits teach the trees.
    """
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    parsed = pages.select("page_id", "url").withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = ruled(host, path, rules)
    parsed = materialise(parsed.withColumns({"rule": rule, "listed": verdict}), "urls")
    if labelled is None:
        known = parsed.where("listed IS NOT NULL").select("url", "host", "path", (F.col("listed") == "block").cast("int").alias("blocked"))
    else:
        known = labelled.select("url", host_of(url).alias("host"), path_of(url).alias("path"), F.col("blocked").cast("int").alias("blocked"))
    stats, hosts = known.select("url", "host", "blocked"), parsed.select("host")
    model = fit(materialise(with_suffix_statistics(known, stats, hosts, teach=True), "taught"))
    scored = with_suffix_statistics(parsed, stats, hosts).withColumn("score", _blocked_score(model))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("listed", own).alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
