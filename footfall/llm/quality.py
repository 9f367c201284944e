"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated.

Every rule sees counts of a text and votes good (1), bad (-1) or abstains (0). Votes are
taken as independent given the unknown quality; expectation-maximisation over the table of
vote patterns (at most 3 ** rules rows, however many documents) estimates how often each rule
votes which way about good and about bad texts, hence how accurate it is. A text is kept if
its posterior probability of being good is at least one half. Texts that fail the base test
are decided already and are left out of the estimate.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import SPACES, written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, by name. Columns are those of :func:`text_counts`."""
    mean_length = _ratio("word_chars", "n_words")
    symbols, marks = _ratio("n_symbols", "n_words"), _ratio("n_symbols", "word_chars")
    never = F.lit(False)
    return {
        "word_length": _vote(never, (mean_length < 2.5) | (mean_length > 9)),
        "symbols": _vote(symbols < 0.02, symbols > 0.1),
        "marks": _vote(marks < 0.004, marks > 0.02),
        "digits": _vote(never, _ratio("n_digits", "word_chars") > 0.1),
        "lines": _vote(never, _ratio("n_dup_lines", "n_lines") > 0.2),
        "repeats": _vote(never, _ratio("n_repeat_words", "n_words") > 0.2),
        "variety": _vote(never, _ratio("n_distinct_words", "n_words") < 0.3),
    }


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more.

    Window hashes that are all distinct settle most texts. The others sort their windows and
    compare neighbours as strings.
    """
    last = F.size(words) - 3
    at = F.sequence(F.lit(0), last)
    get = lambda array, i: F.get(array, i)
    hashes = F.transform(at, lambda i: F.xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)))
    windows = F.sort_array(F.transform(at, lambda i: F.struct(
        F.concat_ws(" ", get(words, i), get(words, i + 1), get(words, i + 2)).alias("words"), i.alias("at"))))

    def starts(sorted_windows: Column) -> Column:
        same = lambda x, k: F.coalesce(x["words"] == get(sorted_windows, k)["words"], F.lit(False))
        marked = F.transform(
            sorted_windows, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["at"]))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    def covered(found: Column) -> Column:
        steps = F.transform(found, lambda x, k: F.least(F.lit(3), F.coalesce(get(found, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    # An array of one binds a lambda variable, so that what it holds is computed once.
    exact = F.transform(F.transform(F.array(windows), starts), covered)[0]
    return (
        F.when(last < 1, 0)
        .when(F.size(F.array_distinct(hashes)) == last + 1, 0)
        .otherwise(exact)
    )


def text_counts(docs: DataFrame) -> DataFrame:
    """Counts over each whole text: ``doc_id``, ``n_words`` and what the rules need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    without = lambda letters: F.length("text") - F.length(F.translate(F.col("text"), letters, ""))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated(F.col("words")),
        "n_lines": F.size("lines"),
        "n_digits": without("0123456789"),
        "n_distinct_words": F.size(F.array_distinct("words")),
    }
    return split.select("doc_id", *(count.cast("long").alias(name) for name, count in counts.items()))


@dataclass
class VoteModel:
    """``good``: the share of good texts. ``shares[rule][vote]``: how often the rule votes so
    about good and about bad texts."""

    good: float
    shares: dict[str, dict[int, tuple[float, float]]]

    def evidence(self, rule: str, vote: int) -> float:
        """Log-odds that a vote, or an abstention, adds."""
        good, bad = self.shares[rule][vote]
        return log(good / bad)

    def accuracy(self, rule: str) -> tuple[float, float]:
        """How often the rule's votes are right about good and about bad texts."""
        up, down = self.shares[rule][1], self.shares[rule][-1]
        return up[0] / (up[0] + down[0]), down[1] / (up[1] + down[1])


# Before any text is seen: a rule abstains on two texts of five, else is right five times in six.
START = {1: (0.5, 0.1), 0: (0.4, 0.4), -1: (0.1, 0.5)}
# The start counts like so many texts of either kind, so that no share becomes 0.
START_WEIGHT = 10.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 300) -> VoteModel:
    """Expectation-maximisation over ``(votes, number of texts)``; without texts the start."""
    model = VoteModel(0.8, {name: dict(START) for name in names})
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = 0.0
        held = {name: {v: [START_WEIGHT * x for x in START[v]] for v in START} for name in names}
        for votes, n in patterns:
            p = 1 / (1 + exp(-log_odds(model, dict(zip(names, votes)))))
            good += n * p
            for name, vote in zip(names, votes):
                held[name][vote][0] += n * p
                held[name][vote][1] += n * (1 - p)
        shares = {}
        for name, by_vote in held.items():
            sums = [sum(x[i] for x in by_vote.values()) for i in (0, 1)]
            shares[name] = {v: (x[0] / sums[0], x[1] / sums[1]) for v, x in by_vote.items()}
        new = VoteModel(min(0.999, max(0.001, good / total)), shares)
        moved = abs(new.good - model.good) + sum(
            abs(a - b) for name in names for v in START
            for a, b in zip(new.shares[name][v], model.shares[name][v]))
        model = new
        if moved < 1e-9:
            break
    return model


def log_odds(model: VoteModel, votes: dict[str, int]) -> float:
    return log(model.good / (1 - model.good)) + sum(model.evidence(name, vote) for name, vote in votes.items())


def judge_quality(docs: DataFrame) -> DataFrame:
    """Counts, votes, posterior and verdict of each row of ``docs``.

    A row gives a row; repeated rows and ids are judged alike and each counts in the
    estimate, a null id stays, a null text counts as empty. Only ``doc_id`` and ``text`` are
    read. ``base_failed``: fewer than 50 words, or more than half of them in repeated
    windows; such a text is not kept whatever the posterior.
    """
    votes = rules()
    columns = {name: f"vote_{name}" for name in votes}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = written(text_counts(docs))
    voted = counts.select(
        "*", failed.alias("base_failed"), *(vote.alias(columns[name]) for name, vote in votes.items()))
    table = voted.where(~F.col("base_failed")).groupBy(*columns.values()).count().collect()
    model = estimate([(tuple(row[:-1]), row[-1]) for row in table], list(votes))

    odds = F.lit(log(model.good / (1 - model.good)))
    for name, column in columns.items():
        shown = F.when(F.col(column) > 0, model.evidence(name, 1)).when(F.col(column) < 0, model.evidence(name, -1))
        odds = odds + shown.otherwise(model.evidence(name, 0))
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
