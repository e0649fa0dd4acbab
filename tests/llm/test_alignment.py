"""Alignment of two tokenizers against a plain count over all pairs of tokens of all groups."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from volquery.llm.alignment import Files, _encoders, align_tokenizers, default_tokenizers, groups_of, pairs_by_class

FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(texts):
    """The figures of all texts by sets and loops, encoded by the tokenizers themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    pieces = _encoders(Files.read(path_a, path_b))
    bytes_of = lambda p, i: p.bytes[p.starts[i] : p.starts[i] + p.sizes[i]].tobytes()
    groups = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelled = [[bytes_of(p, i) for i in ids] for p, ids in ((pieces.a, ids_a), (pieces.b, ids_b))]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            groups.append([])
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        low, mine = 0, []
        for high in cuts:
            mine.append([[i for i, e in zip(ids, end) if low < e <= high] for ids, end in zip((ids_a, ids_b), ends)])
            low = high
        groups.append(mine)
    links = [Counter((x, y) for g in mine for x in g[0] for y in g[1]) for mine in groups]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for mine, c in zip(groups, links):
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in mine)
        digest = hashlib.sha256(said.encode()).hexdigest() if mine else ""
        out.append((sum(len(g[0]) for g in mine), sum(len(g[1]) for g in mine), len(mine), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), digest))
    return out


def got(frame):
    return Counter((r["doc_id"], *(r[c] for c in FIGURES)) for r in frame.collect())


def test_nasty_rows_equal_a_plain_count(spark, nasty, empty):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    extra = ["▁under", "<s> </s> <|endoftext|>", "漢字" * 200 + "\U0001f600‍" * 50, "=" * 3000, "a\x00b�", "ﬁ ligature", " " * 40 + "x", "Ж" * 333]
    rows += [(1000 + i, t) for i, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = Counter((k, *f) for (k, _), f in zip(rows, plain([t for _, t in rows])))
    assert got(align_tokenizers(docs)) == wanted
    # few pairs in place, and documents worked on by classes of ids
    assert got(align_tokenizers(docs, listed=20, limit=500)) == wanted
    assert got(align_tokenizers(nasty, listed=0)).total() == nasty.count()
    none = align_tokenizers(empty)
    assert none.count() == 0 and none.columns == ["doc_id", *FIGURES]


def test_a_gap_that_nothing_spans_ends_a_group():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.randint(1, 40)
        one, two = (np.diff([0, *sorted(rng.sample(range(1, size), rng.randint(0, size - 1))), size]) for _ in range(2))
        cuts = sorted(set(np.cumsum(one)) & set(np.cumsum(two)))
        of_a, of_b = groups_of(one, two)
        assert of_a.tolist() == np.searchsorted(cuts, np.cumsum(one)).tolist()
        assert of_b.tolist() == np.searchsorted(cuts, np.cumsum(two)).tolist()


@pytest.mark.parametrize("limit", [1, 7, 60, 10_000])
def test_classes_of_ids_share_no_pair(limit):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 6, 50)
    of_a, of_b = np.sort(np.concatenate([np.arange(4), rng.integers(0, 4, 56)])), np.sort(np.concatenate([np.arange(4), rng.integers(0, 4, 46)]))
    wanted = Counter(int(x) * 6 + int(y) for g in range(4) for x in a[of_a == g] for y in b[of_b == g])
    found = Counter()
    for pair, n in pairs_by_class(a, b, of_a, of_b, 6, limit):
        assert not set(pair.tolist()) & set(found)
        found.update(dict(zip(pair.tolist(), n.tolist())))
    assert found == wanted


def test_a_very_long_run_is_encoded(spark):
    docs = spark.createDataFrame([(1, "^" * 200_000), (2, " " * 200_000), (3, "a" * 200_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in align_tokenizers(docs).collect()}
    assert [found[i]["n_a"] > 0 and found[i]["n_groups"] > 0 for i in (1, 2, 3)] == [True] * 3
