"""What is learned, against plain versions: votes and posteriors one document at a time, languages one text at a time."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import plain

from maskwright.llm import langid, quality, queries


# Quality


def plain_votes(text):
    """The eight rules, 0 bad, 1 none, 2 good."""
    words, symbols = len(plain.words(text)), plain.base_stats(text)[2]
    chars, lines, again = plain.base_stats(text)[1], [x for x in text.split("\n") if plain.WORD.search(x)], plain.base_stats(text)[4]
    stops, shouts = sum(text.count(c) for c in ".!?"), text.count("!")
    upper = sum("A" <= c <= "Z" for c in text)
    letters = sum("A" <= c <= "Z" or "a" <= c <= "z" for c in text)
    plain_words = sum(w[-1] not in "!#*$%&|<>" for w in plain.words(text))
    repeats = len(lines) - len(set(lines))

    def vote(bad, good=False):
        return 0 if bad else 2 if good else 1

    return (
        vote(10 * symbols > words, 100 * symbols < words),
        vote(10 * plain_words < 7 * words, 100 * plain_words > 95 * words),
        vote(100 * stops < words or 2 * stops > words, 50 * stops > words and 4 * stops < words),
        vote(5 * shouts > words),
        vote(10 * upper > 4 * letters),
        vote(10 * repeats > 3 * len(lines)),
        vote(10 * again > 4 * words),
        vote(chars < 2 * words or chars > 14 * words),
    )


def plain_posteriors(votes, rounds):
    """Expectation maximisation with a loop over documents."""
    good = []
    for v in votes:
        lead = sum(x - 1 for x in v)
        good.append(0.9 if lead > 0 else 0.1 if lead < 0 else 0.5)
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(votes) + 2)
        chance = []
        for rule in range(len(votes[0])):
            mass = [[1.0, 1.0] for _ in range(3)]
            for v, g in zip(votes, good):
                mass[v[rule]][0] += 1 - g
                mass[v[rule]][1] += g
            total = [sum(m[c] for m in mass) for c in range(2)]
            chance.append([[m[c] / total[c] for c in range(2)] for m in mass])
        new = []
        for v in votes:
            logit = math.log(prior / (1 - prior)) + sum(math.log(chance[r][x][1] / chance[r][x][0]) for r, x in enumerate(v))
            new.append(1 / (1 + math.exp(-max(-700, min(700, logit)))))
        moved, good = max(abs(a - b) for a, b in zip(new, good)), new
        if moved < 1e-9:
            break
    return good


def test_quality_query_by_hand(llm_spark, docs, sf):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    want = dict(zip(ids, plain_posteriors([plain_votes(texts[i]) for i in ids], quality.ROUNDS)))
    got = {r.doc_id: r for r in queries.op2_quality_rules(llm_spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        words, *_, again = plain.base_stats(texts[i])
        assert r.posterior == pytest.approx(want[i], abs=1e-6)
        assert r.base_failed == (words < 50 or 100 * again > 50 * words)
        if abs(want[i] - 0.5) > 1e-6:
            assert r.kept == (not r.base_failed and want[i] >= 0.5)


def test_votes_counted_by_pattern_or_one_by_one():
    rng = random.Random(4)
    votes = [tuple(rng.choices((0, 1, 2), (1, 2, 4) if rng.random() < 0.7 else (4, 2, 1), k=5)) for _ in range(300)]
    counts = Counter(votes)
    patterns = np.array(sorted(counts))
    model = quality.fit_votes(patterns, np.array([counts[tuple(p)] for p in patterns]), rounds=60)
    want = plain_posteriors(votes, 61)  # the model's last table is one step behind its posteriors
    for v, w in zip(votes, want):
        logit = math.log(model.prior / (1 - model.prior)) + sum(math.log(model.table[r][x][1] / model.table[r][x][0]) for r, x in enumerate(v))
        assert 1 / (1 + math.exp(-logit)) == pytest.approx(w, abs=1e-3)


# Languages


def plain_features(text):
    """Trigram frequencies of the bytes, by a loop."""
    data = [b if b > 127 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode()]
    counts = [0] * langid.FEATURES
    for a, b, c in zip(data, data[1:], data[2:]):
        if (a, b) != (32, 32):
            counts[((a << 16 | b << 8 | c) * 2654435761 >> 12) % langid.FEATURES] += 1
    size = math.sqrt(sum(counts))
    return [math.sqrt(c) / size for c in counts]


def plain_prediction(model, text):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = [*plain_features(text), 1.0]

    def chance(row, slope):
        return 1 / (1 + math.exp(-slope * sum(float(a) * b for a, b in zip(row, x))))

    own = [chance(row, slope) for row, slope in zip(model.family_rows, model.family_slopes)]
    f = own.index(max(own))
    langs = model.families[f]
    if len(langs) == 1:
        return langs[0], own[f]
    wins, sure = [0] * len(langs), [0.0] * len(langs)
    for (family, a, b), row, slope in zip(model.pairs, model.pair_rows, model.pair_slopes):
        if family == f:
            p = chance(row, slope)
            wins[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
    best = max(range(len(langs)), key=lambda k: (wins[k], sure[k]))
    return langs[best], own[f] * sure[best] / (len(langs) - 1)


def test_language_query_by_hand(llm_spark, docs, sf):
    model = langid.train(docs)
    rows = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id")).limit(60).collect()
    got = {r.doc_id: r for r in queries.op10_language(llm_spark, sf).collect()}
    assert len(got) == docs.count()
    for row in rows:
        lang, score = plain_prediction(model, row.text)
        assert got[row.doc_id].lang_pred == lang
        assert got[row.doc_id].score == pytest.approx(score, abs=1e-3)


def test_a_machine_by_small_steps():
    """The accelerated steps end where plain ones do."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0.4, 1, (60, 6)), rng.normal(-0.4, 1, (30, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.r_[np.ones(60), -np.ones(30)]
    got, _ = langid.linear_svm(x, y, penalty=0.1)
    full, share = np.hstack([x, np.ones((90, 1))]), np.where(y > 0, 0.5 / 60, 0.5 / 30)

    def loss(w):
        return 0.05 * w @ w + (share * np.maximum(0, 1 - y * (full @ w)) ** 2).sum()

    w = np.zeros(7)
    for _ in range(20_000):
        w -= 0.05 * (0.1 * w - 2 * (np.maximum(0, 1 - y * (full @ w)) * y * share) @ full)
    assert loss(got) <= loss(w) + 1e-4
