"""Quality rules under weak supervision.

Every rule looks at statistics of a whole text and votes good (1), bad (0) or abstains
(-1). What a vote is worth is not set but estimated: expectation maximisation finds how
often each rule objects to good texts and to texts with each kind of fault, and how common
these are, from how the votes agree. The posterior probability of a good text then
decides, instead of asking that all rules pass. Abstaining says nothing either way.

Texts with equal votes are alike to the estimate, so it works on counts of vote patterns:
at most 3 to the power of the rules (``RULES``), whatever the number of texts. Only these
counts come to the driver, and the posteriors of the patterns go back.

Defined cases: a null or empty text has zero counts; all rules but the length abstain; it
fails the base check. An empty table gives no rows. Repeated documents give repeated rows
and count as often. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.base import lean, stash
from cardwatch.llm.text_stats import STATS, statistics

# (name, good if, bad if, noise): SQL over the statistics; bad comes first, and a rule abstains if
# neither holds. noise: the share of good texts to which a rule like this is thought to object.
RULES = (
    ("few_symbols", "n_words > 0", "n_symbols * 10 > n_words", 0.001),
    ("no_repeated_runs", "n_words >= 20", "n_repeat_words * 10 > n_words * 3", 0.001),
    ("no_repeated_lines", "n_lines > 2", "n_dup_lines * 2 > n_lines", 0.02),
    ("mixed_case", "n_letters > 0", "n_upper * 2 > n_letters", 0.001),
    ("ended_lines", "n_lines > 0", "n_lines > 0 and n_ended_lines * 5 < n_lines", 0.02),
    ("calm", "n_words > 0", "n_marks * 5 > n_words", 0.001),
    ("varied_words", "n_words >= 20", "n_adjacent * 5 > n_words", 0.005),
    ("word_length", "n_words > 0", "word_chars > 12 * n_words or word_chars < 2 * n_words", 0.02),
)
GOOD_PRIOR = 0.8
ACCURACY_PRIOR = 0.9
PRIOR_WEIGHT = 4.0
# How much the expected noise weighs against what the texts show: which part of a rule's
# objections is noise can't be told from votes alone.
NOISE_WEIGHT = 4.0
ROUNDS = 200

_SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in STATS)


@lean
def _stats(batches):
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(1)]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *STATS])


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_stats, _SCHEMA)


def votes(rules=RULES) -> Column:
    """The votes of all rules, as an array."""
    return F.array(*(F.expr(f"cast(case when {bad} then 0 when {good} then 1 else -1 end as int)") for _, good, bad, _ in rules))


def estimate(
    patterns: np.ndarray, counts: np.ndarray, noise: np.ndarray, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class shares, chance of a bad vote by (class, rule), and posterior of class 0 by pattern.

    patterns: one row of votes (0, 1, -1) each. Class 0 are the good texts, class k + 1 those
    with the fault rule k looks for: faults differ, so texts that have one needn't be bad in
    the eyes of all rules. Pseudo-counts hold that a rule objects to good texts no more than
    its noise, and is rather right on texts with its own fault.
    """
    rules = patterns.shape[1]
    bad, good = (patterns == 0).astype(float), (patterns == 1).astype(float)
    expected = np.full((rules + 1, rules), 0.2)
    expected[0] = noise
    expected[np.arange(rules) + 1, np.arange(rules)] = ACCURACY_PRIOR
    weight = np.full((rules + 1, 1), PRIOR_WEIGHT)
    weight[0] += NOISE_WEIGHT * counts.sum()
    shares, chance = np.full(rules + 1, 1 / (rules + 1)), expected
    objected = bad.any(1)
    belong = np.concatenate([np.where(objected, 1 - ACCURACY_PRIOR, 1.0)[:, None], ACCURACY_PRIOR * bad / np.maximum(bad.sum(1), 1)[:, None]], 1)
    for _ in range(rounds):
        mass = counts[:, None] * belong
        chance = (weight * expected + mass.T @ bad) / (weight + mass.T @ (bad + good))
        prior = PRIOR_WEIGHT * np.concatenate([[GOOD_PRIOR], np.full(rules, (1 - GOOD_PRIOR) / rules)])
        shares = (mass.sum(0) + prior) / (counts.sum() + PRIOR_WEIGHT)
        log = bad @ np.log(chance).T + good @ np.log(1 - chance).T + np.log(shares)
        likely = np.exp(log - log.max(1, keepdims=True)) if len(log) else log
        before, belong = belong, likely / likely.sum(1, keepdims=True)
        if np.abs(belong - before).max(initial=0.0) < 1e-10:
            break
    return shares, chance, belong[:, 0]


def judge(documents: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the statistics, votes and posterior of every document."""
    spark = documents.sparkSession
    voted = stash(text_statistics(documents).withColumn("votes", votes(rules)), "votes")
    known = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in known], np.int64).reshape(len(known), len(rules))
    _, _, posterior = estimate(patterns, np.array([r["n"] for r in known], float), np.array([r[3] for r in rules]))
    table = [(r["votes"], float(p)) for r, p in zip(known, posterior, strict=True)]
    found = spark.createDataFrame(table, "votes array<int>, posterior double")
    # At most 3 ** rules patterns: a proven bound.
    return voted.join(F.broadcast(found), "votes")


def verdicts(documents: DataFrame, rules=RULES) -> DataFrame:
    """The judged documents with base_failed and kept."""
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return judge(documents, rules).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)
    )
