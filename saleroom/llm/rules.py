"""Quality rules as weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a document. An expectation-maximisation
run over the histogram of vote patterns estimates how often each rule is right, and a
document is kept by its posterior probability of being good instead of by passing all rules.

Nulls, empty and repeated rows: a null or empty text has zero words and zero of everything,
so its base test fails and it is not kept; its posterior is still given. Repeated rows are
counted and returned as often as they occur. An empty table gives an empty result (the
model then keeps its starting values). A very long text is one row of arrays. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ids import pinned
from saleroom.llm.tokens import words

SYMBOLS = "#*$%&|<>"


def _repeated_positions(tokens: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more.

    Windows are sorted by their 64-bit hash, each with its place; equal ones are neighbours.
    """
    grams = F.transform(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )
    return F.expr("""
        aggregate(
          array(sort_array(transform(_grams, (g, i) -> named_struct('g', g, 'p', i)))),
          0L,
          (unused, s) -> aggregate(
            sort_array(filter(transform(s, (v, i) ->
              CASE WHEN v.g = get(s, i + 1).g OR v.g = get(s, i - 1).g THEN v.p END),
              p -> p IS NOT NULL)),
            named_struct('n', 0L, 'end', 0L),
            (a, p) -> named_struct('n', a.n + p + 3 - greatest(a.end, CAST(p AS BIGINT)), 'end', CAST(p + 3 AS BIGINT)),
            a -> a.n))
    """), grams


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the base counts of every whole text; one pass, no shuffle."""
    whole = F.coalesce(F.col(text), F.lit(""))
    repeats, grams = _repeated_positions(F.col("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), whole.alias("_text"))
        .withColumn("_words", words(F.col("_text")))
        .withColumn("_grams", grams)
        .withColumn("_lines", lines)
        .select(
            "doc_id",
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        )
    )


@dataclass(frozen=True)
class Rule:
    """bad and good: conditions for a vote; neither (or unknown): it abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN 0 WHEN {self.good} THEN 1 ELSE -1 END")


# Thresholds are shares of words or characters, so a rule means the same for every length.
RULES = (
    Rule("word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words", "false"),
    Rule("symbols", "10 * n_symbols > n_words", "n_words >= 20 AND 100 * n_symbols <= n_words"),
    Rule("other_characters", "100 * n_letters < 90 * word_chars", "n_words >= 20 AND 100 * n_letters >= 93 * word_chars"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", "n_lines >= 5 AND n_dup_lines = 0"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words", "n_words >= 50 AND 100 * n_repeat_words <= 15 * n_words"),
    Rule("shouting", "n_letters >= 20 AND 2 * n_upper > n_letters", "n_letters >= 20 AND 10 * n_upper < n_letters"),
    Rule("length", "n_words < 5", "false"),
)


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good documents; right[i] = (P(vote bad | bad), P(vote good | good)) of rule i when it votes."""

    prior: float
    right: tuple[tuple[float, float], ...]

    def weights(self, i: int) -> tuple[float, float]:
        """Log odds that a bad and a good vote of rule i add."""
        bad, good = self.right[i]
        return math.log((1 - good) / bad), math.log(good / (1 - bad))

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(
            self.weights(i)[v] for i, v in enumerate(votes) if v >= 0
        )


def fitted(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100) -> VoteModel:
    """EM over (votes, number of documents). There are at most 3^rules patterns at any scale.

    Starts from rules that are right 80 % of the time; pseudo-counts keep rules with few votes
    near that. Accuracies stay within 0.01 and 0.99 and a bad vote always speaks against a
    document, so no rule swaps its meaning; the prior stays within 0.05 and 0.95.
    """
    model = VoteModel(0.8, ((0.8, 0.8),) * n_rules)
    if not patterns:
        return model
    for _ in range(rounds):
        counts = [[[4.0, 1.0], [1.0, 4.0]] for _ in range(n_rules)]  # [true class][vote]
        good = total = 0.0
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(votes)))))
            good, total = good + n * p, total + n
            for i, v in enumerate(votes):
                if v >= 0:
                    counts[i][0][v] += n * (1 - p)
                    counts[i][1][v] += n * p
        right = []
        for on_bad, on_good in counts:
            says_good = max(0.01, min(0.99, on_good[1] / sum(on_good)))
            says_bad = max(1.02 - says_good, min(0.99, on_bad[0] / sum(on_bad)))
            right.append((says_bad, says_good))
        model = VoteModel(max(0.05, min(0.95, good / total)), tuple(right))
    return model


def vote_patterns(counted: DataFrame, rules: tuple[Rule, ...]) -> list[tuple[tuple[int, ...], int]]:
    names = [f"_v{i}" for i in range(len(rules))]
    found = counted.groupBy(*(r.vote().alias(n) for r, n in zip(rules, names))).count().collect()
    return sorted((tuple(row[n] for n in names), row["count"]) for row in found)


def with_posterior(counted: DataFrame, model: VoteModel, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds posterior, the probability of being good given the votes."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for i, rule in enumerate(rules):
        bad, good = model.weights(i)
        vote = rule.vote()
        odds = odds + F.when(vote == 0, F.lit(bad)).when(vote == 1, F.lit(good)).otherwise(F.lit(0.0))
    return counted.withColumn("posterior", 1 / (1 + F.exp(-odds)))


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    least: float = 0.5,
) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept of every document."""
    counted = pinned(measured(docs, doc_id, text))  # a few longs per document, read twice
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # what the base test decides anyway would make up the "bad" class; the rules judge the rest
    model = fitted(vote_patterns(counted.where(~base_failed), rules), len(rules))
    return (
        with_posterior(counted, model, rules)
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
    )
