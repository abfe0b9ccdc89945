"""Quality rules under weak supervision (operator 3), with DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document or abstains (0). Votes of all documents are counted by
pattern (at most three to the power of the rules), and expectation-maximisation over these counts estimates
the rules' accuracies and how common good documents and the kinds of bad ones are: bad documents share no
one defect, so there are as many kinds as the votes tell apart. No rule may be worse than chance, see ``fit``. A document is kept if
its posterior probability of being good is at least one half and the base rules pass.

Cases: null text counts as empty; documents without words fail the base rules. Repeated rows are judged alike.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, let, materialise, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def twice(ordered: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            other = F.when(i > 0, F.get(ordered, i - 1)["h"]), F.get(ordered, i + 1)["h"]
            return F.coalesce(other[0] == x["h"], F.lit(False)) | F.coalesce(other[1] == x["h"], F.lit(False))

        return let(F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"])), covered)

    def windows(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(ordered, twice))

    made = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(let(made, windows))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over each whole text that the rules look at."""
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    def of_words(h: Column) -> Column:
        again = F.filter(h, lambda x, i: F.when(i > 0, F.get(h, i - 1)) == x)
        return F.struct(F.size(h).alias("n"), _repeat_words(h).alias("repeat"), F.size(again).alias("again"))

    w, x = F.col("w"), F.col("l")
    return docs.select(
        docs[id_col].alias("doc_id"),
        let(F.transform(words_of(text), lambda v: F.xxhash64(v)), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).alias("chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("symbols"),
        _count(text, r"\p{Lu}+").alias("upper"),
        _count(text, r"!+").alias("shouts"),
        _count(text, r"\|+").alias("bars"),
        _count(text, r"[.,;:?]").alias("points"),
    ).select(
        "doc_id",
        w["n"].cast("bigint").alias("n_words"),
        F.col("chars").cast("bigint").alias("word_chars"),
        F.col("symbols").cast("bigint").alias("n_symbols"),
        x["dup"].cast("bigint").alias("n_dup_lines"),
        w["repeat"].cast("bigint").alias("n_repeat_words"),
        x["all"].cast("bigint").alias("n_lines"),
        w["again"].cast("bigint").alias("n_again"),
        *(F.col(c).cast("bigint").alias(f"n_{c}") for c in ("upper", "shouts", "bars", "points")),
    )


def _vote(bad: str, good: str) -> Column:
    return F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")


#: Rule name, when it votes bad, when it votes good; otherwise it abstains.
RULES = (
    ("symbols", "10 * n_symbols > 3 * n_words", "50 * n_symbols <= n_words"),
    ("capitals", "2 * n_upper > word_chars", "5 * n_upper <= word_chars"),
    ("repeats", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    ("line_copies", "n_lines >= 4 AND 3 * n_dup_lines > n_lines", "n_lines >= 4 AND n_dup_lines = 0"),
    ("word_length", "word_chars > 14 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    ("stutter", "10 * n_again > n_words", "50 * n_again <= n_words"),
    ("shouting", "10 * n_shouts > n_words", "100 * n_shouts <= n_words"),
    ("bars", "5 * n_bars > n_words", "100 * n_bars <= n_words"),
    ("sentences", "n_words >= 60 AND 200 * n_points < n_words", "20 * n_points >= n_words"),
)


@dataclass
class Fit:
    """What is believed of the rules: how common good documents and each kind of bad ones are, and how rules vote on them."""

    good: float
    kinds: list[float]  # share of each kind of bad documents: kind k is what rule k is to find, 0 if the votes don't tell it apart; the last has many defects
    alarm: list[float]  # how often a vote of each rule on good documents is bad, and so wrong
    found: list[list[float]]  # found[k][r]: how often a vote of rule r on kind k is bad, and so right
    abstains: list[float]

    def accuracy(self) -> list[float]:
        """How often a vote of each rule is right, over all documents."""
        n = self.good + sum(self.kinds)
        return [(self.good * (1 - self.alarm[r]) + sum(p * f[r] for p, f in zip(self.kinds, self.found, strict=True))) / n for r in range(len(self.alarm))]

    def caught(self) -> list[float]:
        """How often a vote of each rule on bad documents of any kind is bad."""
        return [sum(p * f[r] for p, f in zip(self.kinds, self.found, strict=True)) / sum(self.kinds) for r in range(len(self.alarm))]

    def weights(self) -> list[tuple[float, list[tuple[float, float]]]]:
        """For each kind its log odds against good, and for each rule what a bad and a good vote add to them."""
        return [
            (math.log(p / self.good), [(math.log(f / a), math.log((1 - f) / (1 - a))) for f, a in zip(found, self.alarm, strict=True)])
            for p, found in zip(self.kinds, self.found, strict=True)
            if p > 0
        ]

    def posterior(self, votes: Iterable[int]) -> float:
        """The probability that a document with these votes is good."""
        votes = list(votes)
        return 1 / (1 + sum(math.exp(odds + sum(w[0] if v < 0 else w[1] for v, w in zip(votes, adds, strict=True) if v)) for odds, adds in self.weights()))


def _maximise(votes: np.ndarray, count: np.ndarray, kinds: list[int], rounds: int, doubt: float, most: float, least: float, trust: float) -> tuple[float, Fit]:
    """Expectation-maximisation with a kind of bad documents for each rule in ``kinds`` and one of many defects; the log posterior, and the fit."""
    n, n_rules = float(count.sum()), votes.shape[1]
    bad, said = (votes < 0).astype(float), (votes != 0).astype(float)
    start = np.array([[0.9 if r == k else doubt for r in range(n_rules)] for k in kinds] + [[0.7] * n_rules])
    own = np.array([[r == k for r in range(n_rules)] for k in [*kinds, -1]])
    alarm, found, good, share = np.full(n_rules, doubt), start, 0.9, np.full(len(start), 0.1 / len(start))
    value = -math.inf
    for _ in range(rounds if n else 0):
        rates = np.vstack([alarm, found])
        logs = np.log(np.append(good, share)) + bad @ np.log(rates).T + (said - bad) @ np.log1p(-rates).T
        top = logs.max(axis=1, keepdims=True)
        part = np.exp(logs - top)
        total = part.sum(axis=1, keepdims=True)
        before, value = value, float(count @ (top + np.log(total))[:, 0] + trust * (doubt * np.log(alarm) + (1 - doubt) * np.log1p(-alarm)).sum())
        weight = part / total * count[:, None]
        mass, bad_votes, all_votes = weight.sum(axis=0), weight.T @ bad, weight.T @ said
        alarm = np.minimum(most, (bad_votes[0] + trust * doubt) / (all_votes[0] + trust))
        found = (bad_votes[1:] + start) / (all_votes[1:] + 1)
        over = alarm + 1e-4 * (1 - alarm)
        found = np.clip(np.maximum(found, np.where(own, np.maximum(least, over), over)), 1e-6, 0.999)
        good, share = (mass[0] + 1) / (n + 2), (mass[1:] + 1 / len(start)) / (n + 2)
        if abs(value - before) < 1e-9 * max(1.0, n):
            break
    abstains = [float(count @ (1 - said[:, r])) / max(n, 1.0) for r in range(n_rules)]
    shares, rates = [0.0] * (n_rules + 1), [np.maximum(alarm, [0.9 if r == k else doubt for r in range(n_rules)]) for k in range(n_rules + 1)]
    for k, p, f in zip([*kinds, n_rules], share, found, strict=True):
        shares[k], rates[k] = float(p), f
    return value, Fit(float(good), shares, alarm.tolist(), [f.tolist() for f in rates], abstains)


def fit(counts: Iterable[tuple[tuple[int, ...], int]], rounds: int = 400, doubt: float = 0.002, most: float = 0.5, least: float = 0.6, apart: bool = True, trust: float = 2.0, price: float = 0.85) -> Fit:
    """Expectation-maximisation over counted vote patterns, for one class of good documents, one of bad ones with many defects, and kinds with a defect each.

    The rules' accuracies are estimated: how often a vote of a rule on good documents is bad, and how often one on bad documents is. Before
    any vote is seen, one on good documents is bad in ``doubt`` of cases, with the weight of ``trust`` votes, however many
    documents there are. Rules that raise alarms of their own do so independently, and patterns of several bad votes show how
    often; a defect of its own shows in votes that go together or keep apart. Kinds of bad documents that one rule is to find are
    added one by one, the best first, and of all these models the one counts whose logarithm of the posterior is highest, less ``price``
    for each parameter of a kind. Rules stay on their side: none raises fewer bad votes on a kind of bad documents than on good ones, ``most`` on
    good ones at most, and one finds at least ``least`` of its own kind. Abstentions are as frequent in every class, so they
    weigh nothing in the posterior. Without ``apart`` bad documents are one class.
    """
    counts = sorted(counts)
    votes = np.array([v for v, _ in counts], dtype=float).reshape(len(counts), len(RULES))
    count = np.array([c for _, c in counts], dtype=float)
    run = lambda kinds: _maximise(votes, count, kinds, rounds, doubt, most, least, trust)
    kinds: list[int] = []
    left = [r for r in range(len(RULES)) if apart and (votes[:, r] < 0).any()]
    value, best = run(kinds)
    while left:
        more = {r: run([*kinds, r]) for r in left}
        add = max(more, key=lambda r: (more[r][0], -r))
        kinds.append(add)
        left.remove(add)
        worth = more[add][0] - price * (len(RULES) + 1) * len(kinds)
        if worth > value:
            value, best = worth, more[add][1]
    return best


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's counts, base_failed, quality (posterior probability of good) and kept."""
    found = features(docs, id_col, text_col)
    found = found.select("*", *(_vote(bad, good).alias(f"vote_{name}") for name, bad, good in RULES))
    found = materialise(found, "quality-features")
    votes = [f"vote_{name}" for name, _, _ in RULES]
    counted = found.where("n_words > 0").groupBy(*votes).count().collect()
    fitted = fit((tuple(r[v] for v in votes), r["count"]) for r in counted)
    against = F.lit(0.0)
    for odds, adds in fitted.weights():
        said = (F.when(F.col(v) < 0, bad).when(F.col(v) > 0, good).otherwise(0.0) for v, (bad, good) in zip(votes, adds, strict=True))
        against = against + F.exp(sum(said, F.lit(odds)))
    quality = 1 / (1 + against)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return found.withColumns({"base_failed": failed, "quality": quality}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's base counts and the verdict of the rules."""
    from .shared import table

    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
