"""Quality rules: base counts against a plain version, and the fit against known rules."""

import re
from collections import Counter

import numpy as np
import pytest
from plain import AWKWARD, WORDS
from slatecast.llm.quality import RULES, fit, judge


def expected(i, text):
    text = text or ""
    w = WORDS.findall(text)
    n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def got(df):
    out = judge(df).collect()
    assert all(not r["kept"] for r in out if r["base_failed"])
    assert all(0 <= r["quality"] <= 1 for r in out)
    return sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out), key=str)


def test_driver_rows(documents, rows):
    assert got(documents) == sorted((expected(r["doc_id"], r["text"]) for r in rows), key=str)


def test_awkward_rows(awkward, no_documents):
    assert got(awkward) == sorted((expected(r[0], r[1]) for r in AWKWARD), key=str)
    assert got(no_documents) == []


def test_fit_recovers_rules():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.9
    right = np.linspace(0.7, 0.95, len(RULES))
    votes = np.where(rng.random((20_000, len(RULES))) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    counts = Counter(map(tuple, votes.tolist()))
    fitted = fit(counts.items(), most=0.45, doubt=0.2, apart=False)  # rules that raise many false alarms over one defect
    believed = {v: fitted.posterior(v) >= 0.5 for v in counts}
    assert np.mean([believed[tuple(v)] == g for v, g in zip(votes.tolist(), good.tolist())]) > 0.97
    accuracy = fitted.accuracy()
    assert all(accuracy[k] > 0.5 for k in range(len(RULES))) and accuracy[-1] > accuracy[0]


def test_no_rule_is_reversed_and_each_kind_of_defect_is_caught():
    """Most documents are clean; bad ones break one rule each, some of them two, and one defect is rare."""
    rng = np.random.default_rng(1)
    votes = np.where(rng.random((20_000, len(RULES))) < 0.03, 0, 1)
    kind = np.where(rng.random(20_000) < 0.1, rng.integers(0, 4, 20_000), -1)
    for k in range(4):
        votes[kind == k, k] = -1
    votes[(kind == 0) & (rng.random(20_000) < 0.5), 1] = -1
    noise = rng.random(votes.shape) < 0.0003
    votes[noise] = -1
    fitted = fit(Counter(map(tuple, votes.tolist())).items())
    assert all(bad > alarm for bad, alarm in zip(fitted.caught(), fitted.alarm))
    assert all(fitted.found[k][r] >= fitted.alarm[r] for k in range(len(RULES)) for r in range(len(RULES)))
    quality = {v: fitted.posterior(v) for v in set(map(tuple, votes.tolist()))}
    rejected = np.array([quality[tuple(v)] < 0.5 for v in votes.tolist()])
    assert rejected[kind >= 0].mean() > 0.99 and rejected[(kind < 0) & ~noise.any(axis=1)].mean() == 0
    assert fit([]).posterior([1] * len(RULES)) > 0.5


def test_posterior_finds_the_junk_that_the_base_rules_pass(llm):
    """On labelled documents that pass the base rules: recall of bad ones and precision of the verdict."""
    sf = "/root/testdata/sf0.1"
    judged = judge(llm.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").select("doc_id", "kept", "quality")
    got = judged.join(llm.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    bad = [r for r in got if r["label"] == 0]
    caught = [r for r in bad if not r["kept"]]
    rejected = [r for r in got if not r["kept"]]
    assert len(bad) >= 250 and len(caught) >= 0.9 * len(bad)
    assert len(caught) >= 0.95 * len(rejected)


def test_clean_documents_stay(documents, rows):
    kept = {r["doc_id"] for r in judge(documents).where("kept").collect()}
    plain = [r["doc_id"] for r in rows if not expected(0, r["text"])[-1] and not re.search(r"[#*$%&|<>]|!!|[A-Z]{4}", r["text"])]
    assert len(set(plain) - kept) <= 0.01 * len(plain)


@pytest.mark.parametrize("rate", [0.01, 0.05, 0.12, 0.2])
@pytest.mark.parametrize("caught", [0.7, 0.9])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_accuracies_of_independent_rules_are_found(rate, caught, seed):
    """With the settings of the query: alarm rates, the share of good documents, and what one bad vote of a weak rule weighs."""
    rng = np.random.default_rng(seed)
    good = rng.random(5000) < 0.9
    votes = np.where(rng.random((5000, len(RULES))) < np.where(good, rate, caught)[:, None], -1, 1)
    fitted = fit(Counter(map(tuple, votes.tolist())).items())
    assert np.abs(np.array(fitted.alarm) - rate).max() < 0.02 and abs(fitted.good - 0.9) < 0.03
    assert np.abs(np.array(fitted.caught()) - caught).max() < 0.06
    assert all(fitted.posterior([-1 if r == k else 1 for r in range(len(RULES))]) > 0.9 for k in range(len(RULES)))
    assert fitted.posterior([-1] * len(RULES)) < 0.01


def test_rules_of_unlike_accuracy():
    rng = np.random.default_rng(9)
    rates = np.linspace(0.002, 0.25, len(RULES))
    good = rng.random(40_000) < 0.8
    votes = np.where(rng.random((40_000, len(RULES))) < np.where(good[:, None], rates, 0.75), -1, 1)
    votes[rng.random(votes.shape) < 0.3] = 0
    fitted = fit(Counter(map(tuple, votes.tolist())).items())
    assert np.abs(np.array(fitted.alarm) - rates).max() < 0.02 and abs(fitted.good - 0.8) < 0.03
    one = lambda k: fitted.posterior([-1 if r == k else 1 for r in range(len(RULES))])
    assert one(0) < one(len(RULES) - 1)  # a bad vote of an accurate rule weighs more
