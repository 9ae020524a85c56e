import hashlib
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import plain

import corpus_pipeline as pipeline
from maskwright.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_by_brute_force(llm_spark, docs, sf):
    kept = staged(pipeline.language(llm_spark, docs, sf), "test")
    assert kept.columns == COLUMNS
    have = {r.doc_id for r in kept.collect()}
    assert all(r.doc_id in have for r in docs.collect() if len(plain.words(r.text)) >= 20)

    single = staged(pipeline.near_copies(llm_spark, kept, sf), "test")
    prints = {r.doc_id: plain.simhash(r.text) for r in kept.collect()}
    group = plain.groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {r.doc_id for r in single.collect()} == set(group.values()) and single.columns == COLUMNS

    cut = staged(pipeline.passages(llm_spark, single, sf), "test")
    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r.text for r in cut.collect()}
    assert set(before) == set(after) and cut.columns == COLUMNS
    for d, text in after.items():
        rest = iter(before[d].split())
        assert all(w in rest for w in text.split())  # words only go, in order
    owners: dict = {}
    for d in sorted(after):
        w = after[d].lower().split()
        for i in range(len(w) - 79):
            assert owners.setdefault(tuple(w[i : i + 80]), d) == d  # no long passage is left in two documents

    mixed = staged(pipeline.source_mix(llm_spark, cut, sf), "test")
    rows = cut.collect()
    n = Counter(r.source for r in rows)
    scale = len(rows) / sum(k**0.5 for k in n.values())
    want = Counter()
    for r in rows:
        u = int(hashlib.md5(f"0:n:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        want[r.doc_id] += plain.poisson_quantile(n[r.source] ** 0.5 * scale / n[r.source], u)
    assert Counter(r.doc_id for r in mixed.collect()) == +want and mixed.columns == COLUMNS

    last = pipeline.tokens(llm_spark, mixed, sf).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in last) == Counter(
        (r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect()
    )
    assert all(len(r.ids) == 4 * r.n_tokens for r in last)
    assert sorted(map(tuple, pipeline.run(llm_spark, sf).collect())) == sorted(map(tuple, last))


def test_stages_take_odd_and_empty_tables(llm_spark, odd, none, sf):
    for docs in (odd, none):
        for name, stage in pipeline.STAGES:
            made = stage(llm_spark, docs, sf)
            if name != "tokens":
                assert made.columns == docs.columns
                for c in ("n_copies", "copy", "order_key", "_said", "_spans"):
                    assert not c in docs.columns or {r[0] for r in made.select(c).distinct().collect()} <= {f"extra {c}"}
            docs = staged(made, "test")
        assert docs.count() >= 0
