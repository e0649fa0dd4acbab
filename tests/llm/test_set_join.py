"""The n-gram Jaccard join against all pairs of Python sets."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from volquery.llm import set_join
from volquery.llm.set_join import INDEX, PROBE, Bands, Costs, forest_of, may_be_similar, open_sets, picked, signatures, similar_sets, sketch


def shingles(text, width=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join("\x20" if c in "\x20\t\n\x0b\x0c\r" else c for c in lower).split("\x20") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.5:
            words[at] = prose(rng, 1)
        elif kind < 0.8:
            words.insert(at, prose(rng, 1))
        elif len(words) > 1:
            del words[at]
    return words


def families(seed):
    """Texts of many sizes with near copies around the limit, chains of them and shared passages."""
    rng = random.Random(seed)
    passage = prose(rng, 60).split()
    rows = []
    for size in (1, 3, 5, 6, 7, 8, 9, 10, 12, 14, 20, 33, 50, 90, 200, 500):
        for _ in range(3):
            base = prose(rng, size).split()
            base = base + passage if rng.random() < 0.4 else base
            last = base
            for _ in range(7):
                rows.append(edited(rng, base, rng.randint(0, 1 + len(base) // 28)))
                last = edited(rng, last, 1 + len(base) // 60)
                rows.append(last)
    few = [[rng.choice(["a", "b"]) for _ in range(rng.randint(5, 40))] for _ in range(60)]
    texts = [" ".join(r) for r in rows + few]
    rng.shuffle(texts)
    return list(enumerate(texts))


def got(frame):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("rounds, tokens", [(2, 1 << 18), (0, 3000)])
def test_families_equal_all_pairs(spark, monkeypatch, rounds, tokens):
    monkeypatch.setattr(set_join, "ROUNDS", rounds)
    monkeypatch.setattr(set_join, "TOGETHER", 1 << 14 if rounds else 40)
    rows = families(11 + rounds)
    assert got(similar_sets(frame(spark, rows), tokens=tokens)) == plain(rows)


def test_nasty_rows(spark, nasty, empty):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    found = similar_sets(nasty)
    assert found.columns == ["doc_id", "n_shingles", "component_id"] and got(found) == plain(rows)
    assert similar_sets(empty).count() == 0


def test_similar_sets_share_a_probed_signature():
    rng = np.random.default_rng(2)
    bands = Bands(80)
    for trial in range(300):
        n = int(rng.integers(4, 12)) if trial % 2 else int(rng.integers(12, 700))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        most = int(bands.differing(np.array([len(x)]))[0])
        gone = int(rng.integers(0, min(most, len(x)) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, max(0, most - gone) + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or both == len(x) == len(y):
            continue
        sets, ends = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
        # any costs will do: here some of the signatures are said to be common
        some = np.unique(rng.permutation(signatures(sets, ends, bands, None)[1])[: len(x) // 2])
        of, signature, flags = signatures(sets, ends, bands, Costs(some, rng.integers(1, 50, len(some))))
        met = {(o, f): set(signature[(of == o) & (flags & f > 0)].tolist()) for o in (0, 1) for f in (PROBE, INDEX)}
        assert met[0, PROBE] & met[1, INDEX] or met[1, PROBE] & met[0, INDEX]


def test_worth_is_given_where_it_costs_least():
    one, two = np.array([1, 9, 1, 5, 2, 2]), np.array([3, 20, 50])
    worth = picked(one, two, np.array([4, 2]), np.array([2, 1]), np.array([4, 2]))
    assert worth.tolist() == [2, 0, 1, 1, 1, 1]
    assert picked(one, two, np.array([4, 2]), np.array([2, 1]), np.array([6, 3])).tolist() == [2, 2, 1, 1, 2, 1]


def test_forests_join_what_all_pairs_join():
    rng = np.random.default_rng(8)
    for trial in range(20):
        base = rng.integers(0, 1 << 60, 60)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(48, 60))], rng.integers(0, 1 << 60, int(rng.integers(0, 6)))])).astype(np.uint64) for _ in range(25)]
        chunk = rng.integers(0, 1 + trial % 2, 25)
        rows = pa.table({"_set": np.arange(25), "n": [len(s) for s in sets], "root": np.arange(25) % 20, "probe": np.arange(25) % 3, "chunk": chunk, "sketch": [sketch(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})
        a, b = forest_of(rows, 0.8)
        wanted = [(i, j) for i in range(25) for j in range(i) if i % 20 != j % 20 and (i % 3 or j % 3) and (chunk[i] != chunk[j] or chunk.min() == chunk.max()) and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)]

        def parts(links):
            top = list(range(20))
            for x, y in links:
                x, y = top[x % 20], top[y % 20]
                top = [y if t == x else t for t in top]
            return [[i == j for i in top] for j in top]

        assert parts(zip(a.tolist(), b.tolist())) == parts(wanted) and len(a) < 20
        assert {i for pair in wanted for i in pair} <= set(open_sets(rows, 0.8).tolist())


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(9)
    ruled = 0
    for n in [3, 20, 300, 511, 513, 700, 3000] * 8:
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        gone = int(rng.integers(0, n // 3 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, gone + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        alike = 100 * both >= 80 * (len(x) + len(y) - both)
        open_ = may_be_similar(sketch(x), len(x), sketch(y), len(y), 80)
        assert open_ or not alike
        ruled += not open_
    assert ruled > 5
