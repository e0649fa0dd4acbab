import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from volquery.llm.components import connected_components
from volquery.llm.repeats import repeated_passages
from volquery.llm.run_length_index import RunLengthIndex, repeated_starts
from volquery.llm.shared import cut
from volquery.llm.simhash import _cross, _forest, fingerprint_bytes, links, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keys, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        least.setdefault(find(i), []).append(k)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(keys))]


def test_near_duplicates_match_all_pairs(nasty):
    rows = nasty.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = collections.Counter((r.doc_id, f, c) for r, f, c in zip(rows, fps, slow_components([r.doc_id for r in rows], fps)))
    got = collections.Counter((r.doc_id, r.fp & (2**64 - 1), r.component) for r in near_duplicates(nasty).collect())
    assert got == want


def test_near_duplicates_of_nothing(empty):
    assert near_duplicates(empty).count() == 0


def test_fingerprints_follow_ascii_rules():
    for text in ("A\x1cB c", "İ I ſ K", "a\x0bb\x0cc d", "x" * 100_000, "É é e É é"):
        assert fingerprint_bytes(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("chunk", [3, 2048])
def test_dense_groups_keep_their_links(spark, chunk):
    """Fingerprints in tight balls: chunks of cells give the components of all pairs."""
    rng = random.Random(7)
    centers = [rng.getrandbits(64) for _ in range(4)]
    values = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centers for _ in range(40)}
    values |= {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = links(frame, chunk)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in found.collect())
    component = {r.node & (2**64 - 1): r.root for r in connected_components(found, "a", "b").collect()}
    want = slow_components(values, values)
    groups = collections.defaultdict(set)
    for v, c in zip(values, want):
        groups[c].add(v)
    mine = collections.defaultdict(set)
    for v in values:
        mine[component.get(v, ("alone", v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_forests_span():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**12, 60, dtype=np.uint64))
    assert len(_forest(a, a[:0], True)) < len(a)
    b = np.unique(rng.integers(2**12, 2**13, 50, dtype=np.uint64))
    assert all(bin(x ^ y).count("1") <= 3 for x, y in _cross(a, np.ones(len(a), bool), b, np.zeros(len(b), bool)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 3), (7, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_take_few_tables(spark, monkeypatch):
    """Each table is a stage of tasks that the driver keeps in memory."""
    from volquery.llm import components

    names = []
    monkeypatch.setattr(components, "cut", lambda df, name: names.append(name) or cut(df, name))
    edges = spark.range(0, 4000, 1, 4).selectExpr("id AS a", "id + 1 AS b")
    got = connected_components(edges, "a", "b").groupBy("root").count().collect()
    assert [tuple(r) for r in got] == [(0, 4001)] and len(names) <= 12


@pytest.mark.parametrize("held", [3, 16, 10_000])
def test_forests_of_a_task_keep_components(monkeypatch, held):
    import pyarrow as pa

    from volquery.llm import components

    monkeypatch.setattr(components, "HELD", held)
    rng = np.random.default_rng(held)
    u, v = rng.integers(-300, 300, (2, 250))
    batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 7]), pa.array(v[i : i + 7])], ["u", "v"]) for i in range(0, 250, 7)]
    out = [r for b in components._forests(iter(batches)) for r in zip(b.column("u").to_pylist(), b.column("v").to_pylist())]
    assert all(b < a for a, b in out) and len(out) <= 250

    def smallest(links):
        name = {int(x): int(x) for x in (*u, *v)}
        for _ in range(len(name)):
            for a, b in links:
                name[a] = name[b] = min(name[a], name[b])
        return name

    assert smallest(out) == smallest(list(zip(u.tolist(), v.tolist())))
    assert held < 10_000 or sorted(out) == sorted((x, r) for x, r in smallest(out).items() if x != r)


def slow_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [{"length": 60, "gram": 20}, {"length": 40, "gram": 16, "hot": 2, "chunk": 900}, {"length": 40, "gram": 16, "hot": 1, "chunk": 300}, {}])
def test_repeats_match_all_windows(nasty, settings):
    rows = nasty.collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, slow_repeats([r.text for r in rows], settings.get("length", 400))))
    got = collections.Counter(tuple(r) for r in repeated_passages(nasty, **settings).collect())
    assert got == want


def test_repeats_of_nothing(empty):
    assert repeated_passages(empty).count() == 0


def test_run_length_index():
    text = np.frombuffer(b"banana_bandana_banana", np.uint8).astype(np.int64)
    index = RunLengthIndex(text)
    assert index.lengths.sum() == len(text) and len(index.symbols) < len(text)
    raw = bytes(text.astype(np.uint8))
    for i, n in enumerate(index.matching_statistics()):
        longest = max(k for k in range(len(raw) - i + 1) if any(raw[j : j + k] == raw[i : i + k] for j in range(len(raw) - k + 1) if j != i) or k == 0)
        assert n == longest
    rng = random.Random(2)
    for _ in range(100):
        length = rng.randint(2, 9)
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) * rng.randint(1, 3) for _ in range(rng.randint(1, 5))]
        count = collections.Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        got = repeated_starts([np.frombuffer(p, np.uint8) for p in pieces], length)
        assert [g.tolist() for g in got] == [[count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in pieces]


def test_a_common_line_shorter_than_a_window_stays(spark):
    rng = random.Random(12)
    line = "".join(rng.choice("abcdefghij") for _ in range(220))
    texts = ["".join(rng.choice("klmnopqrst") for _ in range(260)) for _ in range(700)]
    frame = spark.createDataFrame([(i, t + line + t[::-1]) for i, t in enumerate(texts)], "doc_id long, text string")
    assert repeated_passages(frame).agg({"n_removed": "sum"}).first()[0] == 0


def test_chunks_of_one_key_stand_once_in_an_index(spark):
    # one gram in hundreds of distinct texts: the key is dealt as pairs of chunks, which all meet in one task
    rng = random.Random(8)
    words = [bytes(rng.choice(b"abcdefghijklmnop") for _ in range(40)).decode() for _ in range(300)]
    shared = "a passage longer than a gram and shorter than a window"
    rows = [(i, w + shared + w[::-1]) for i, w in enumerate(words)]
    rows += [(300 + i, w + shared + w[::-1] + str(i)) for i, w in enumerate(words[:20])]
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, slow_repeats([t for _, t in rows], 60)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = collections.Counter(tuple(r) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), length=60, gram=20, chunk=2000).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


@pytest.mark.parametrize("tokens", [1 << 18, 400])
def test_groups_that_are_alike_leave_a_forest_of_links(spark, monkeypatch, tokens):
    """Texts that share passages, most of them below the limit: components as all pairs give, and no list of
    pairs is written."""
    import random

    from conftest import prose
    from volquery.llm import similar as s

    rng, rows = random.Random(4), []
    for _ in range(4):
        passage = prose(rng, 60).split()
        for _ in range(30):
            own = prose(rng, 40).split()
            rows.append(passage + own[: rng.randint(1, 25)])
    rows += [rows[0], [], ["one"], ["ONE"]]
    sets = [{tuple(w.lower() for w in r[i : i + 5]) for i in range(max(1, len(r) - 4))} if r else set() for r in rows]
    smallest, moved = list(range(len(rows))), True
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while moved:
        moved = False
        for i, j in near:
            if smallest[i] != smallest[j]:
                smallest[i] = smallest[j] = min(smallest[i], smallest[j])
                moved = True
    written = []

    def seen(*parts):
        links = links_inside(*parts)
        written.append(links.count())
        return links

    links_inside = s.links_inside
    monkeypatch.setattr(s, "links_inside", seen)
    # without hubs' links and fingerprints, all is left to the inside of groups
    monkeypatch.setattr(s, "similar_pairs", lambda pairs, sets, similarity: pairs.where("false"))
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component for r in s.similar_documents(docs, tokens=tokens).collect()}
    assert len(near) > len(rows) and got == dict(enumerate(smallest))
    groups = len(rows) * 30  # a forest of each group of a shingle
    assert written and sum(written) < groups
    with pytest.raises(ValueError):
        s.similar_documents(docs, similarity=0.805)


def test_whole_sets_are_read_only_where_sketches_leave_a_pair_open(spark, monkeypatch):
    """Families that share most of their words, below the limit: their groups stay apart, but hardly a set is read."""
    from conftest import prose
    from volquery.llm import set_join
    from volquery.llm import similar as s

    rng, rows = random.Random(6), []
    for _ in range(3):
        passage = prose(rng, 84)
        rows += [f"{passage} {prose(rng, 20)}" for _ in range(12)]
    rows += [rows[0], rows[0] + " tail"]
    read, rooted, cut, inside = [], [], s.cut, s.links_inside

    def written(df, name):
        out = cut(df, name)
        if name == "similar-sets":
            read.append(out.count())
        return out

    def seen(groups, *more):
        rooted.append(groups.select("_set").distinct().count())
        read.clear()
        return inside(groups, *more)

    monkeypatch.setattr(s, "cut", written)
    monkeypatch.setattr(s, "links_inside", seen)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in s.similar_documents(docs).collect()}
    assert got == {**{i: i for i in range(36)}, 36: 0, 37: 0}
    # groups were apart; before, each of their sets was read for each of the groups it was in
    assert rooted[0] > 20 and sum(read) < 5

    member = [(1, 0, 0, 0, 5, 1), (1, 0, 0, 0, 6, 1), (2, 0, 0, 0, 5, 1), (2, 0, 0, 0, 6, 1), (3, 0, 1, 0, 5, 1), (3, 0, 1, 1, 6, 1), (4, 0, 0, 0, 5, 1), (4, 0, 0, 0, 6, 0)]
    groups = spark.createDataFrame(member, "g long, ci int, cj int, chunk int, _set long, probe int")
    assert sorted(r.g for r in set_join.different_groups(groups).collect()) == [1, 1, 3, 3, 4, 4]
