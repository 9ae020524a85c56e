"""Token counts, the Merkle manifest and periodic runs against plain versions."""

import hashlib
import random
import sys
import zlib
from fractions import Fraction
from pathlib import Path

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from maskwright.llm import manifest, periodic, queries, tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = " \t\n\x0b\x0c\r"


# Token counts


@pytest.fixture(scope="module")
def model():
    return tokencount.read_model(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def made_texts(model, seed, n=700):
    rng, pieces = random.Random(seed), list(model.scores)
    for k in range(n):
        yield "".join([
            lambda: (rng.choice(pieces) for _ in range(rng.randint(0, 30))),
            lambda: (rng.choice("abcxe  \n\t.") for _ in range(rng.randint(0, 60))),
            lambda: (rng.choice(" ▁a") for _ in range(rng.randint(0, 80))),
            lambda: (chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x7FF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1F700)])) for _ in range(rng.randint(0, 40))),
            lambda: rng.choice(pieces) * rng.randint(1, 40),
            lambda: (rng.choice("xoe0-=.*") for _ in range(rng.randint(0, 200))),
            lambda: (rng.choice("etaoinshr") for _ in range(rng.randint(0, 100))),
        ][k % 7]())


@pytest.mark.parametrize("chunk, table", [(256, 1 << 28), (7, 1 << 28), (2, 1 << 28), (64, 100_000)])
def test_counts_are_those_of_the_library(model, library, chunk, table):
    texts = list(made_texts(model, chunk))
    machine = tokencount.Machine(model.scores, table)
    got = tokencount.count_texts(machine, texts, model.prefix, chunk)
    assert [int(c[-1]) for c in got] == [len(x) for x in library.encode(texts)]
    if table == 100_000:
        assert len(machine.keys) < 8 * len(texts)  # it has started again


def test_counts_of_prefixes(model, library):
    text = "A handle, the 1234 café▁s  and\nmore words of it " * 9
    whole = model.prefix + text.replace(" ", "▁")
    (got,) = tokencount.count_texts(model.machine(), [text], model.prefix, 10)
    assert len(got) == -(-len(whole) // 10)
    assert got.tolist() == [len(library.encode(text[: k - 1])) for k in (*range(10, len(whole), 10), len(whole))]


def test_chunks_that_never_say_what_was_before(model, library):
    texts = ["x" * 5000, " " * 5000, "a" + " " * 3001 + "the", "the" * 1500, "=" * 4097]
    got = tokencount.count_texts(model.machine(), texts, model.prefix, 64)
    assert [int(c[-1]) for c in got] == [len(x) for x in library.encode(texts)]


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as file:
        data = file.read()
    for change in (b"\x12\x02\x18\x01", b"\x1a\x02\x20\x01", b"\x0a\x05\x0a\x01q\x18\x04"):  # unigram, spaces removed, a user's piece
        (tmp_path / "other.model").write_bytes(data + change)
        with pytest.raises(ValueError):
            tokencount.read_model(str(tmp_path / "other.model"))


def test_token_query(llm_spark, library, docs, sf):
    got = queries.op11_token_counts(llm_spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    want = []
    for r in docs.collect():
        n = len(library.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_token_counts_of_odd_rows(llm_spark, library, odd, odd_rows, none):
    got = tokencount.count_tokens(odd, MODEL, chunk=100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in odd_rows]
    assert sorted(map(repr, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(repr, want))
    assert tokencount.count_tokens(none, MODEL).count() == 0


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and for every leaf the digests left and right of its way up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    ways = []
    for i in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            begin = i - i % 3
            run = level[begin : begin + 3]
            way.append(("".join(run[: i - begin]), "".join(run[i - begin + 1 :])))
            i //= 3
        ways.append(way)
    return levels[-1][0], ways


def plain_manifest(rows):
    """The contract's rows for rows of documents."""

    def leaf(r, text):
        fields = [None if v is None else str(v) for v in (r[0], r[3], r[2], r[4], text)]
        return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in fields])

    trees = {}
    for r in rows:
        broken = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        trees.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if broken else r[1])))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = [plain_tree([x[1] for x in trees[s]]) for s in order]
    root, upper = plain_tree([t for t, _ in tops])
    out = []
    for s, (top, ways), above in zip(order, tops, upper):
        for (i, mine, later), way in zip(trees[s], ways):
            folded = later
            for left, right in way + above:
                folded = sha(left, folded, right)
            out.append((i, mine, top, root, sha(*[a + b for a, b in way + above]), folded, folded == root))
    return sorted(out, key=repr)


def derived(df):
    return sorted(
        map(tuple, df.select("id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("p"), "folded_root", "verified").collect()), key=repr
    )


def manifest_of(df, depth=manifest.DEPTH):
    broken = F.when(queries._crc32("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    return manifest.merkle_manifest(df, names, "source", "doc_id", manifest.encoded([*map(F.col, names[:-1]), broken]), depth)


def test_manifest_query(llm_spark, docs, sf):
    want = plain_manifest([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    got = sorted(map(tuple, queries.op12_merkle(llm_spark, sf).collect()), key=repr)
    assert got == want and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("depth", [1, 2, 9])
def test_manifest_of_odd_rows(odd, odd_rows, none, depth):
    assert derived(manifest_of(odd, depth)) == plain_manifest(odd_rows)
    assert manifest_of(none, depth).count() == 0


@pytest.mark.parametrize("depth", [1, 2])
def test_a_hot_group_in_blocks(llm_spark, depth):
    rows = [(i, f"text\n{i}", "en", "hot" if i % 3 else f"s{i % 40}", i) for i in range(500)]
    rows += [(7, "text\n7", "en", "hot", 7)] * 40 + [(1000 + i, "alone", "en", f"one{i}", 1) for i in range(30)]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = derived(manifest_of(df, depth))
    assert got == plain_manifest(rows)


def test_queue_stays_small(monkeypatch):
    most = 0
    push = manifest.heapq.heappush

    def counted(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    monkeypatch.setattr(manifest.heapq, "heappush", counted)
    leaves = [sha(str(i)) for i in range(3**7)]
    top, _, _ = manifest.block_top(leaves)
    assert most <= 3 * manifest.DEPTH
    folded = {manifest.fold(leaf, way) for leaf, way in zip(leaves, manifest.block_paths(leaves, []))}
    assert folded == {top}


# Periodic runs


def plain_runs(w):
    """All runs by comparing every word with the one a period behind it."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q) and not any(q % p == 0 and w[s : e - p] == w[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_rest(w, runs):
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def nested(rng):
    """Words with repeats in repeats, cut and changed here and there."""

    def some(depth):
        if not depth:
            return [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 6))]
        out = []
        for _ in range(rng.randint(1, 3)):
            out += some(depth - 1) * rng.choice([1, 1, 2, 3, 4, 7, 9])
            if rng.random() < 0.4:
                out = out[: rng.randint(0, len(out))]
            if out and rng.random() < 0.2:
                out[rng.randrange(len(out))] = "éé"
        return out

    return some(rng.randint(0, 4))[:400]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(8):
        texts = [nested(rng) for _ in range(20)]
        texts += [texts[0], [], ["a"] * rng.randint(0, 90)]
        column = pa.array([rng.choice([" ", "\n", "\t  "]).join(w) if w else rng.choice([None, "", " \n"]) for w in texts])
        runs, rest = periodic._described(column)
        want = [plain_runs(w) for w in texts]
        assert runs == want
        assert [r.decode() for r in rest] == [plain_rest(w, r) for w, r in zip(texts, want)]


def test_runs_of_long_and_regular_texts():
    fibonacci, more = ["a"], ["a", "b"]
    while len(more) < 1500:
        fibonacci, more = more, more + fibonacci
    morse = ["ab"[bin(i).count("1") % 2] for i in range(1500)]
    for w in (more, morse, ["a"] * 1000, ("a " * 30 + "b ").split() * 20, [f"w{i % 97}" for i in range(1500)] + ["z"]):
        runs, _ = periodic._described(pa.array([" ".join(w)]))
        assert runs == [plain_runs(w)]


def test_grammar_gives_the_texts_back():
    rng = random.Random(5)
    texts = [nested(rng) for _ in range(30)]
    ids = periodic.np.array([ord(c[0]) for w in texts for c in w])
    text = periodic.np.repeat(periodic.np.arange(len(texts)), [len(w) for w in texts])
    nodes = periodic.Node()
    place, size = periodic._passes(ids, text, nodes)
    assert size.sum() == len(ids) and (place == periodic.np.cumsum(size) - size).all()
    low, _, high, node, at = nodes.columns()
    for k, p in zip(node, at):  # every place of a node reads as its first
        assert (ids[p : p + high[k] - low[k]] == ids[low[k] : high[k]]).all()


def split(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_query_row(doc_id, text):
    w = split(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *four, sha(lines), sha(plain_rest(w, runs)))


def test_run_query(llm_spark, docs, sf):
    got = queries.op13_periodic(llm_spark, sf)
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    rows = [r for r in docs.collect() if len((r.text or "").split()) < 1200]
    want = {r.doc_id: plain_query_row(r.doc_id, r.text) for r in rows}
    found = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(found) == docs.count() and {d: found[d] for d in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_runs_of_odd_rows(odd, odd_rows, none):
    done = periodic.periodic_runs(odd, ("doc_id", "n_chars"))
    assert done.columns == ["doc_id", "n_chars", "runs", "collapsed"]
    short = [r for r in odd_rows if len(r[1] or "") < 1000]
    want = [(r[0], r[4], plain_runs(split(r[1] or "")), plain_rest(split(r[1] or ""), [])) for r in short]
    got = [(r.doc_id, r.n_chars, [tuple(x) for x in r.runs], r.collapsed) for r in done.collect()]
    assert sorted(map(repr, [r for r in got if len(r[3]) < 1000])) == sorted(map(repr, want))
    assert len(got) == len(odd_rows) and periodic.periodic_runs(none).count() == 0
