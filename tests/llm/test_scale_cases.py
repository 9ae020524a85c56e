"""Cases that only show at size: crowded keys, unequal vectors, many languages; and passages against brute force."""

import random
import sys
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import plain

from maskwright.llm import components, hnsw, langid, licenses, mixing, paragraphs, urlfilter


def vocabulary(seed, n, size=4000):
    rng = random.Random(seed)
    return [f"{rng.choice('qua zor mip lek'.split())}{rng.randint(0, size)}" for _ in range(n)]


def test_passages_by_brute_force(llm_spark):
    rng, texts = random.Random(8), []
    shared = [vocabulary(900 + i, 90) for i in range(6)]
    for d in range(100):
        words = vocabulary(d, rng.randint(60, 75))  # short enough to be one paragraph
        s, begin, at = rng.choice(shared), rng.randint(0, 40), rng.randint(0, len(words))
        words[at:at] = s[begin : begin + rng.choice([0, 9, 25, 50])]
        texts.append(words)
    df = llm_spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = paragraphs.repeated_passages(df).collect()
    removed = {}
    for r in found:
        if r.removed:
            removed.setdefault(r.id, set()).update(range(r.start, r.start + r.n_words))

    k, edge, owner, long_ones = paragraphs.WINDOW, paragraphs.WINNOW - 1, {}, 0
    for d, w in enumerate(texts):
        # Stretches of words whose every window an earlier document has.
        known = [owner.setdefault(tuple(w[i : i + k]), d) < d for i in range(len(w) - k + 1)] + [False]
        assert removed.get(d, set()) <= {i + j for i, x in enumerate(known) if x for j in range(k)}
        begin = 0
        for i, x in enumerate(known):
            if not x:
                if i - begin + k - 1 >= paragraphs.MIN_RUN + 2 * edge:
                    long_ones += 1
                    assert set(range(begin + edge, i + k - 1 - edge)) <= removed.get(d, set())
                begin = i + 1
    assert long_ones > 5


def test_a_crowded_key_is_linear(llm_spark, monkeypatch):
    rng = random.Random(3)
    base, other = vocabulary(1, 100), vocabulary(2, 100)
    rows = [" ".join(base)] * 5
    for i in range(4000):
        words = list(base)
        words[rng.randrange(100)] = f"own{i}"
        rows.append(" ".join(words))
    rows += [" ".join(other)] * 2 + [" ".join([*other[:50], "changed", *other[51:]])]
    df = llm_spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    table = paragraphs.staged(paragraphs.paragraph_table(df, "doc_id", "text"), "test")
    compared = []
    verified = paragraphs._verified
    monkeypatch.setattr(paragraphs, "_verified", lambda members, s: compared.append(members.count()) or verified(members, s))
    links = paragraphs.paragraph_links(table, block=200)
    roots = {r.node: r.root for r in components.components(links).collect()}
    digests = {r.digest for r in table.select("digest").collect()}
    # Keys of variants of one paragraph need no comparison of blocks; two groups of the whole are left.
    assert sum(compared) < 4 * len(digests)
    groups = {}
    for d in digests:
        groups.setdefault(roots.get(d, d), []).append(d)
    assert sorted(map(len, groups.values()))[-2:] == [2, 4001]


def test_crowded_keys_lose_no_link(llm_spark):
    """With blocks of two every key is crowded: the same classes as without."""
    rng, rows = random.Random(4), []
    for s in range(12):
        words = vocabulary(50 + s, 30)
        for _ in range(8):
            edited = list(words)
            for _ in range(rng.randint(0, 2)):
                edited[rng.choice([0, 1, 28, 29, 15])] = f"new{rng.randint(0, 9)}"
            rows.append(" ".join(edited))
    df = llm_spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    table = paragraphs.staged(paragraphs.paragraph_table(df, "doc_id", "text"), "test")

    def classes(block):
        return {(r.node, r.root) for r in components.components(paragraphs.paragraph_links(table, block=block)).collect()}

    assert classes(2) == classes(1024)


def recall(found, vectors, k):
    hits = total = 0
    for q, ids in found.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(set(ids) & set(np.argsort(-scores, kind="stable")[:k].tolist()))
        total += k
    return hits / total


def test_recall_of_gaussian_vectors_in_a_full_shard():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((6000, 64)), rng.standard_normal((150, 64))
    graph, order = hnsw.build_graph(x)
    near = graph.nearest(np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32), max(hnsw.EF_SEARCH, len(x) // hnsw.WIDEN))
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(order[n[n >= 0]]) & set(w)) / 20 for n, w in zip(near, want)]) >= 0.9


def test_vectors_of_very_unequal_lengths(llm_spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1e4
    x[8:12] *= 1e-3
    df = llm_spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert len(found) == 75 and recall(found, x, 20) >= 0.95
    huge = df.select("vec_id", F.transform("embedding", lambda c: c * 1e153).alias("embedding")).where("vec_id < 300 and vec_id <> 7")
    ranks = hnsw.nearest(huge, huge.where("vec_id = 0"), 5).orderBy("rank").collect()
    want = [int(i) for i in np.argsort(-(x[:300] @ x[0])) if i not in (0, 7)][:5]
    assert [r.rank for r in ranks] == [1, 2, 3, 4, 5]
    assert [r.vec_id for r in ranks] == want


def test_every_language_is_learned(llm_spark):
    """Languages of few ids and many repeats too; predictions are those of the machines one by one."""
    data = []
    for k in range(14):
        stem = "".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=5))
        for i in range(6):
            text = " ".join(f"{stem}{'aeiou'[j % 5]}{stem[:2]}" for j in range(20 + i))
            data += [(100 * k + i, text, f"x{k}")] * (1 if k else 50)
    df = llm_spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(df, per_language=5, others=14)
    assert sorted(lang for f in model.families for lang in f) == sorted({r[2] for r in data})
    texts = sorted({(r[1], r[2]) for r in data})
    made = np.array([langid.features(t) for t, _ in texts])
    names, scores, sure = model.predict(made)
    assert names == [lang for _, lang in texts] and (scores <= sure).all()
    for row, name in zip(made, names):
        margins = [(float(np.r_[row, 1.0] @ w) * s, f[0]) for w, s, f in zip(model.family_rows, model.family_slopes, model.families)]
        assert max(margins)[1] == name


def test_a_machine_holds_few_doubles():
    """Beside the rows it is given, a family's machine holds a block of them as doubles; the weights are those of plain steps."""
    rng = np.random.default_rng(3)
    own, others = (rng.random((n, langid.FEATURES), np.float32) ** 8 for n in (150, 570))
    both = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (own, others)]
    tracemalloc.start()
    top, pair = langid.fit_family(both[0], ["a"] * 75 + ["b"] * 75, both[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(x.nbytes for x in both)  # doubles of all rows would take twice this
    y = np.r_[np.ones(150), -np.ones(570)]
    for got, x, y in ((top, np.concatenate(both), y), (pair, both[0], y[:150] - 2 * (np.arange(150) >= 75))):
        x = np.hstack([x, np.ones((len(x), 1))])
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        step, w, ahead = 1 / (4 * np.sqrt(1e-3) + 4), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for k in range(300):
            new = ahead - step * (1e-3 * ahead - 2 * ((np.maximum(0, 1 - y * (x @ ahead)) * y * share) @ x))
            w, ahead = new, new + k / (k + 3) * (new - w)
        assert np.abs(got[2] - w).max() < 1e-9


def test_a_long_list_of_keys_is_exact(llm_spark):
    """Building is linear: 300,000 listed keys of 600,000."""
    universe = paragraphs.staged(llm_spark.range(600_000).select(F.concat(F.lit("host"), "id", F.lit(".net/")).alias("key")), "universe")
    listed = universe.where(F.xxhash64("key") % 2 == 0)
    made = urlfilter.cascade(listed, universe)
    assert len(made.levels) > 2 and len(made.levels[0].data) > urlfilter.CHUNK
    wrong = universe.where(made.holds(F.col("key")) != (F.xxhash64("key") % 2 == 0))
    assert wrong.count() == 0


# Licenses


@pytest.mark.parametrize("seed", range(6))
def test_every_place_of_a_notice_and_nothing_else(seed):
    rng = random.Random(seed)
    names = ["mit-text", "apache-2.0", "cc-by-nc-4.0", "apache-2.0-header", "isc"]
    wording = {n: next(t for name, _, t in licenses.NOTICES if name == n) for n in names}
    templates = licenses.by_word([licenses.Notice.of(*n) for n in licenses.NOTICES])
    parts, want = [], []
    for _ in range(12):
        parts += [f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 1, 5, 90]))]
        name = rng.choice(names)
        words = wording[name].split()
        for _ in range(rng.choice([1, 1, 2, 3])):  # copies one behind the other
            want.append((name, len(parts), len(parts) + len(words)))
            parts += words
    got = licenses.find_notices(" ".join(parts), templates, every_place=True)
    found = {(n, s, e) for n, _, _, s, e in got}
    assert found >= set(want)
    # Whatever else is listed lies inside of one that was planted: a header holds the name of its license.
    assert all(any(s >= a and e <= b for _, a, b in want) for _, s, e in found)
    # Places of one license do not overlap, and each is as similar as it is said to be.
    of = {}
    for name, coverage, matched, s, e in got:
        of.setdefault(name, []).append((s, e))
        text = licenses.words_of(" ".join(parts[s:e]))
        most = max(plain.longest_common(text, licenses.words_of(t)) / len(licenses.words_of(t)) for n, _, t in licenses.NOTICES if n == name)
        assert licenses.COVERAGE <= coverage <= most + 1e-9
    for spans in of.values():
        assert all(a[1] <= b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
    best = {n: h for n, *h in licenses.find_notices(" ".join(parts), templates)}
    assert best.keys() == of.keys() and all((h[2], h[3]) in of[n] for n, h in best.items())


def test_shuffled_words_of_notices_are_none():
    templates = licenses.by_word([licenses.Notice.of(*n) for n in licenses.NOTICES])
    words = sorted({w for _, _, t in licenses.NOTICES for w in licenses.words_of(t) if w and "://" not in w})
    for seed in range(20):
        assert licenses.find_notices(" ".join(random.Random(seed).choices(words, k=400)), templates, every_place=True) == []


def test_many_copies_of_a_notice_take_linear_time():
    templates = licenses.by_word([licenses.Notice.of(*n) for n in licenses.NOTICES])
    line = "Released under the MIT License. "
    took = []
    for n in (1000, 4000):
        begun = time.perf_counter()
        got = licenses.find_notices(line * n, templates, every_place=True)
        took.append(time.perf_counter() - begun)
        assert [h[3] for h in got if h[0] == "mit"] == list(range(0, 5 * n, 5))
    assert took[1] < 10 * took[0]


# Mixing


def test_the_mix_reads_its_rows_once(llm_spark):
    df = llm_spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    mixed = mixing.mix(df, epochs=2.0)
    assert "rangepartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()
    rows = mixed.select("order_key", F.spark_partition_id().alias("p")).collect()
    assert [r.order_key for r in rows] == sorted(r.order_key for r in rows)
    n = int(llm_spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = np.bincount([r.p for r in rows], minlength=n)
    assert len(sizes) == n and sizes.max() < 1.5 * sizes.mean()
