import random
import re
from collections import Counter

import numpy as np

from tiergraph.llm import quality_rules as Q

WORD = re.compile(r"[^ \t-\r]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def good(rng, n):
    return ". ".join(" ".join(rng.choice(["the", "river", "runs", "under", "old", "stone", "bridges", "every", "winter", "while", f"child{rng.randrange(400)}"]) for _ in range(9)).capitalize() for _ in range(n)) + "."


def test_base_counts_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "a b c ", "\n", "x#", "|", "\t", "é ", "<"]) for _ in range(rng.randrange(60)))
        assert Q.text_features(text)[:5] == brute_base(text)


def test_verdicts(spark):
    rng = random.Random(1)
    rows = [(i, good(rng, 12)) for i in range(400)]
    bad = [(1000 + i, " ".join(w + "###" for w in good(rng, 12).split())) for i in range(30)] + [(2000 + i, "! ".join(good(rng, 12).upper().split()).replace("!", "!!")) for i in range(30)] + [(3000 + i, " | ".join(good(rng, 12).replace(".", "").split())) for i in range(30)]
    edge = [(5, None), (6, ""), (7, "word " * 49), (8, "same words here " * 40), (4, good(rng, 12)), (4, good(rng, 12))]
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows[10:] + bad + edge], "doc_id long, text string, quality double, kept boolean")
    got = [(r.doc_id, r) for r in Q.score_quality(docs).collect()]
    assert len(got) == docs.count()
    assert all(r.base_failed and not r.kept for i, r in got if i in (5, 6, 7, 8))
    assert all(r.kept for i, r in got if 10 <= i < 1000 or i == 4)
    assert not any(r.kept for i, r in got if i >= 1000)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 392
    assert Q.score_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_is_bayes():
    shares, rates = np.array([0.6, 0.4]), np.array([[[0.1, 0.2, 0.7], [0.3, 0.3, 0.4]], [[0.5, 0.3, 0.2], [0.25, 0.25, 0.5]]])
    want = 0.6 * 0.7 * 0.3 / (0.6 * 0.7 * 0.3 + 0.4 * 0.2 * 0.25)
    got = Q.posteriors(np.array([[Q.GOOD, Q.STRONG], [-1, -1]]), shares, rates)[:, 0]
    assert abs(got[0] - want) < 1e-12 and abs(got[1] - 0.6) < 1e-12


def drawn(rng, n, shares, rates):
    """Vote patterns of a made-up table: each class votes by its rates, and abstains at times."""
    votes = Counter()
    for _ in range(n):
        by_rule = rng.choices(rates, shares)[0]
        votes[tuple(-1 if rng.random() < 0.1 else rng.choices((0, 1, 2), r)[0] for r in by_rule)] += 1
    return sorted(votes.items())


def made_up():
    names = list(Q.rules())
    rates = [[(0.002, 0.05, 0.948)] * len(names)]
    for own in Q.KINDS.values():
        rates.append([(0.6, 0.3, 0.1) if x in own else (0.02, 0.08, 0.9) for x in names])
    return names, [0.8, 0.05, 0.05, 0.05, 0.05], rates


def test_fit_recovers_rates():
    names, shares, rates = made_up()
    got_shares, got = Q.fit_rules(drawn(random.Random(2), 30_000, shares, rates), *Q.starting_rates(names))
    assert abs(got_shares[0] - 0.8) < 0.04
    assert np.abs(got[0] - np.array(rates[0])).max() < 0.02
    noise = [names.index(x) for x in Q.KINDS["noise"]]
    assert np.abs(got[2, noise] - np.array(rates[2])[noise]).max() < 0.12


def test_votes_decide_and_not_the_start():
    """One bad vote is outvoted, weak ones together reject, and a start ten times as strong changes neither."""
    names, shares, rates = made_up()
    patterns = drawn(random.Random(5), 30_000, shares, rates)
    at = {x: i for i, x in enumerate(names)}

    def pattern(**bad):
        out = [Q.GOOD] * len(names)
        for x, v in bad.items():
            out[at[x]] = v
        return out

    cases = [pattern(), pattern(symbols=Q.STRONG), pattern(repeats=Q.WEAK), pattern(sentences=Q.WEAK), pattern(symbols=Q.WEAK, bare_symbols=Q.WEAK, word_length=Q.WEAK), pattern(symbols=Q.STRONG, bare_symbols=Q.STRONG), pattern(capitals=Q.WEAK, shouts=Q.WEAK, sentences=Q.WEAK)]
    for strength in (2.0, 20.0, 200.0):
        found = Q.posteriors(np.array(cases), *Q.fit_rules(patterns, *Q.starting_rates(names), strength=strength))[:, 0]
        assert [bool(x >= 0.5) for x in found] == [True, True, True, True, False, False, False]


def test_a_rule_that_is_often_wrong_is_learnt_as_such():
    """Where good documents get weak votes of one rule all the time, these say little."""
    names, shares, rates = made_up()
    rates[0] = [(0.002, 0.7, 0.298) if x == "variety" else r for x, r in zip(names, rates[0], strict=True)]
    fitted = Q.fit_rules(drawn(random.Random(6), 20_000, shares, rates), *Q.starting_rates(names))
    votes = [Q.WEAK if x == "variety" else Q.GOOD for x in names]
    assert Q.posteriors(np.array([votes]), *fitted)[0, 0] > 0.95


def test_posterior_of_the_query_equals_that_of_the_votes(spark):
    rng = random.Random(8)
    texts = [good(rng, 12) for _ in range(120)] + [" ".join(w + "##" for w in good(rng, 9).split()) for _ in range(15)] + ["one two " * 60, None, "", "long words " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, votes string")
    rows = Q.score_quality(docs).collect()
    fitted = Q.fit_rules(sorted(Counter(tuple(r.votes) for r in rows).items()), *Q.starting_rates(list(Q.rules())))
    want = Q.posteriors(np.array([r.votes for r in rows]), *fitted)[:, 0]
    assert np.allclose([r.quality for r in rows], want, atol=1e-9)
    assert all(r.kept == (not r.base_failed and r.quality >= 0.5) for r in rows)
