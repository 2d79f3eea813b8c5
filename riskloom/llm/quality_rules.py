"""Quality rules that vote: weak supervision without labels, in DataFrame operations only.

Each rule votes for a document (1), against it (0) or abstains (NULL). Expectation-maximisation estimates the
share of good documents and, for each rule, how often it votes for, votes against and abstains on good documents
and on bad ones; abstaining is evidence too, so a rule that only ever votes against counts for what it is worth. The
posterior probability that a document is good replaces an all-must-pass filter: it is kept from 0.5 on.
``accuracies`` gives how often each rule's votes are right.

Documents with equal votes have equal posteriors, so the iterations run over the table of vote patterns (at
most 3 to the number of rules, whatever the corpus holds) with their counts, which come from all documents.
An iteration is one aggregation to a few sums; they end when no estimate moves by ``SETTLED``, or after ``ROUNDS``.
The estimates begin with votes of one accuracy and have a prior of ``PSEUDO`` documents of that kind in each class,
which the data of any corpus outweigh. Without documents they stay where they began.

A text without words (NULL and empty ones too) fails the base rules and is not kept. Repeated rows count
each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import table
from riskloom.llm.statistics import REPEAT_WINDOW, with_counts
from riskloom.session import materialise

#: name: (against it if, for it if), in SQL over the counts of ``statistics``; neither is an abstention.
RULES = {
    "repeats": ("100 * n_repeat_words > 30 * n_words", "FALSE"),
    "symbols": ("10 * n_symbols > n_words", "FALSE"),
    "endings": ("5 * n_odd > n_words", "FALSE"),
    "bars": ("20 * n_bars > n_words", "FALSE"),
    "capitals": ("100 * n_upper > 30 * word_chars", "FALSE"),
    "marks": ("2 * n_marks > n_words", "FALSE"),
    "sentences": ("n_words >= 20 AND 100 * n_marks < n_words", "FALSE"),
    "vocabulary": ("n_words >= 20 AND 100 * n_distinct < (CASE WHEN n_words < 1000 THEN 35 ELSE 15 END) * n_words", "FALSE"),
    "lines": ("3 * n_dup_lines > n_lines", "FALSE"),
    "word_length": ("2 * word_chars < 5 * n_words OR word_chars > 14 * n_words", "FALSE"),
    "prose": (
        "FALSE",
        "40 * n_marks >= n_words AND 4 * n_marks <= n_words AND 50 * n_symbols <= n_words "
        "AND 100 * n_upper <= 15 * word_chars AND 20 * n_repeat_words <= n_words",
    ),
}
ROUNDS, SETTLED = 30, 1e-6
#: Where share and accuracies begin, and how many documents of each class the prior counts for.
START_SHARE, START_RIGHT, PSEUDO = 0.85, 0.9, 1.0

#: share, and for each rule how often good (g) and bad (b) documents get its vote for (1) and against (0).
Estimate = dict[str, float]
CELLS = ("g1", "g0", "b1", "b0")
#: The prior: half of the documents get a vote, which is right as often as at the start.
PRIOR = {"g1": START_RIGHT / 2, "g0": (1 - START_RIGHT) / 2, "b1": (1 - START_RIGHT) / 2, "b0": START_RIGHT / 2}


def votes(counts: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """``counts`` with a vote column v_<rule> for each rule."""
    cols = [F.when(F.expr(bad), F.lit(0)).when(F.expr(good), F.lit(1)).alias(f"v_{n}") for n, (bad, good) in rules.items()]
    return counts.select("*", *cols)


def start(names: Sequence[str]) -> Estimate:
    return {"share": START_SHARE, **{f"{c}_{n}": p for n in names for c, p in PRIOR.items()}}


def accuracies(names: Sequence[str], e: Estimate) -> dict[str, float]:
    """Share of each rule's votes that are right, by an estimate."""
    good, bad = e["share"], 1 - e["share"]
    right = {n: good * e[f"g1_{n}"] + bad * e[f"b0_{n}"] for n in names}
    return {n: r / (r + good * e[f"g0_{n}"] + bad * e[f"b1_{n}"]) for n, r in right.items()}


def posterior(names: Sequence[str], e: Estimate) -> Column:
    """Probability of being good, given the votes and an estimate."""
    z = F.lit(math.log(e["share"] / (1 - e["share"])))
    for n in names:
        g1, g0, b1, b0 = (e[f"{c}_{n}"] for c in CELLS)
        v = F.col(f"v_{n}")
        z = z + F.when(v == 1, math.log(g1 / b1)).when(v == 0, math.log(g0 / b0)).otherwise(math.log((1 - g1 - g0) / (1 - b1 - b0)))
    return 1.0 / (1.0 + F.exp(-z))


def estimate(voted: DataFrame, names: Sequence[str], rounds: int = ROUNDS) -> Estimate:
    """Expectation-maximisation over the vote patterns of ``voted``."""
    patterns = materialise(voted.groupBy(*[f"v_{n}" for n in names]).agg(F.count("*").alias("n")), "patterns")
    e = start(names)
    weight = {"g": F.col("n") * F.col("q"), "b": F.col("n") * (1.0 - F.col("q"))}
    for _ in range(rounds):
        sums = [F.sum(w).alias(c) for c, w in weight.items()]
        sums += [F.sum(F.when(F.col(f"v_{n}") == int(c[1]), weight[c[0]])).alias(f"{c}_{n}") for n in names for c in CELLS]
        got = patterns.withColumn("q", posterior(names, e)).agg(*sums).first()
        size = {c: got[c] or 0.0 for c in weight}
        new = {"share": (size["g"] + PSEUDO * START_SHARE) / (size["g"] + size["b"] + PSEUDO)}
        for n in names:
            for c in CELLS:
                new[f"{c}_{n}"] = ((got[f"{c}_{n}"] or 0.0) + 2 * PSEUDO * PRIOR[c]) / (size[c[0]] + 2 * PSEUDO)
        moved, e = max(abs(new[k] - e[k]) for k in e), new
        if moved < SETTLED:
            break
    return e


def judged(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> tuple[DataFrame, Estimate]:
    """A row for each document with counts, votes, posterior, base_failed and kept; and the estimate."""
    names = list(rules)
    voted = materialise(votes(with_counts(docs), rules), "votes")
    e = estimate(voted, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.select("*", posterior(names, e).alias("posterior"), failed.alias("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)), e


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the rules' joint verdict for every document."""
    found, _ = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _score_sql(names: Sequence[str]) -> str:
    """Log-odds of being good, given the votes and an estimate."""
    weights = [
        f"CASE v_{n} WHEN 1 THEN ln(g1_{n} / b1_{n}) WHEN 0 THEN ln(g0_{n} / b0_{n}) ELSE ln((1 - g1_{n} - g0_{n}) / (1 - b1_{n} - b0_{n})) END"
        for n in names
    ]
    return " + ".join(["ln(share / (1 - share))", *weights])


def _round_sql(i: int, names: Sequence[str]) -> str:
    """One iteration: posteriors from the estimate e{i}, then e{i + 1}."""
    weight = {"g": "n * q", "b": "n * (1 - q)"}
    cols = [f"(coalesce(sum(n * q), 0) + {PSEUDO * START_SHARE}) / (coalesce(sum(n), 0) + {PSEUDO}) AS share"]
    for n in names:
        for c in CELLS:
            hits = f"coalesce(sum({weight[c[0]]}) FILTER (v_{n} = {c[1]}), 0)"
            cols.append(f"({hits} + {2 * PSEUDO * PRIOR[c]}) / (coalesce(sum({weight[c[0]]}), 0) + {2 * PSEUDO}) AS {c}_{n}")
    votes_ = ", ".join(f"v_{n}" for n in names)
    return f"""q{i} AS MATERIALIZED (SELECT {votes_}, n, 1 / (1 + exp(-({_score_sql(names)}))) AS q FROM patterns, e{i}),
e{i + 1} AS MATERIALIZED (SELECT {", ".join(cols)} FROM q{i})"""


def _op1_sql() -> str:
    names = list(RULES)
    votes_ = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END AS v_{n}" for n, (bad, good) in RULES.items())
    begin = ", ".join(f"{v} :: DOUBLE AS {k}" for k, v in start(names).items())
    rounds = ",\n".join(_round_sql(i, names) for i in range(ROUNDS))
    z = _score_sql(names)
    lost = lambda chars: f"length(t) - length(regexp_replace(t, '{chars}', '', 'g'))"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT r, s, array_to_string(w[s:s + {REPEAT_WINDOW - 1}], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {REPEAT_WINDOW} + 2)) AS s FROM texts WHERE len(w) >= {REPEAT_WINDOW})),
again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + {REPEAT_WINDOW})) AS p FROM again) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
         {lost("[#*$%&|<>]")} AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
         {lost("[A-Z]")} AS n_upper, {lost("[.!?]")} AS n_marks, len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) AS n_odd,
         len(list_filter(w, lambda x: x = '|')) AS n_bars
  FROM texts LEFT JOIN repeated USING (r)),
voted AS MATERIALIZED (SELECT *, {votes_} FROM counts),
patterns AS MATERIALIZED (SELECT {", ".join(f"v_{n}" for n in names)}, count(*) AS n FROM voted GROUP BY ALL),
e0 AS (SELECT {begin}),
{rounds},
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1 / (1 + exp(-({z}))) AS posterior
  FROM voted, e{ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND posterior >= 0.5 AS kept
FROM judged
"""


OP1_SQL = _op1_sql()
