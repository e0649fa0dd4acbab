import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from volquery.llm.mixing import SCHEDULES, invert_demand, mix, source_targets, word_sizes
from volquery.llm.packing import default_tokenizer, encode_texts, pack
from volquery.llm.shared import cut, prefix_sums, row_slices
from volquery.llm.topk import first_meetings, segments, sign_codes, top_k
from volquery.llm.word_bpe import WordBpe

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def bpe():
    return WordBpe.load(default_tokenizer())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        left, open_ = total - sum(fixed.values()), [s for s in names if s not in fixed]
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / whole for s in open_}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_its_targets(nasty):
    rows = nasty.collect()
    words = collections.Counter()
    for r in rows:
        words[r.source] += len(WORD.findall(r.text or ""))
    want = slow_targets(words)
    sizes = cut(word_sizes(nasty, ["doc_id", "source"]), "t")
    got = mix(sizes).collect()
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in got) == collections.Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in rows)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == words[r.source]
        assert 0 <= r.taken <= 2 * r["size"] and (r.position is None) == (r.taken == 0) and (r.position_2 is None or r.position_2 >= r.position)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) < 1 for s, t in want.items())
    assert got == mix(sizes).collect()  # reruns agree, order included
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 40, "e": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    assert got == pytest.approx(slow_targets(sizes)) and sum(got.values()) == pytest.approx(1.5 * 1355)


def test_mix_of_nothing(empty):
    assert mix(word_sizes(empty, ["doc_id", "source"])).count() == 0


@pytest.mark.parametrize("schedule", SCHEDULES)
def test_demand_is_inverted(spark, schedule):
    times = [r.t for r in spark.range(101).select(invert_demand(F.col("id") / 100.0, schedule).alias("t")).orderBy("id").collect()]
    knots, weights = zip(*schedule)
    grid = np.linspace(0, 1, 20001)
    used = np.cumsum(np.interp(grid, knots, weights))
    used = (used - used[0]) / (used[-1] - used[0])
    np.testing.assert_allclose(times, np.interp(np.arange(101) / 100, used, grid), atol=2e-3)


def test_prefix_sums_cross_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else rng.choice("ab"), i, rng.randint(0, 9)) for i in range(500)]
    frame = spark.createDataFrame(rows, "s string, i long, v long").repartition(5)
    got = {r.i: r.before_v for r in prefix_sums(frame, ["s", "i"], ["v"], "t").collect()}
    total = 0
    for s, i, v in sorted(rows):
        assert got[i] == total
        total += v


def test_slices_are_whole_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 50, "", "c" * 5]})
    assert [b.num_rows for b in row_slices(batch, "t", 12)] == [2, 2, 1] or sum(b.num_rows for b in row_slices(batch, "t", 12)) == 5


ALPHABETS = ["abcdefghijklmnopqrstuvwxyzéüß", "ABCZÉ'sStTllRrVe", "0123456789", ".,;:!?#$%&*|<>()'\"-_", "\n\t \x0b", "中文字ひñΣςİﬁé​\xa0\x85\x1c\x7f", "<|endoftext|>"]


def test_fast_ids_are_the_tokenizers(bpe, reference):
    rng = random.Random(5)
    texts = [None, "", " ", "it's WE'LL o'er 2024x <|endoftext|> <|startoftext|>a"]
    for _ in range(1500):
        parts = (rng.choice(ALPHABETS) for _ in range(rng.randint(0, 10)))
        texts.append("".join(("".join(rng.choice(a) for _ in range(rng.randint(1, 9))) if a[0] != "<" or rng.random() < 0.7 else a) + rng.choice(["", " "]) for a in parts))
    ids, offsets = encode_texts(bpe, pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == reference.encode(t or "", add_special_tokens=False).ids + [2], repr(t)


def test_packing_covers_every_id_once(nasty, reference):
    rows = nasty.collect()
    pieces = pack(nasty).collect()
    want = collections.Counter()
    for r in rows:
        want[r.doc_id, tuple(reference.encode(r.text or "", add_special_tokens=False).ids + [2])] += 1
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) and p.length == len(p.ids) > 0
        by_sequence[p.sequence_id].append(p)
    stream = []
    for s in range(len(by_sequence)):
        parts = sorted(by_sequence[s], key=lambda p: p.offset)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        assert sum(p.length for p in parts) == 4096 or s == len(by_sequence) - 1
        stream += parts
    got = collections.Counter()
    at = 0
    while at < len(stream):
        ids, n = list(stream[at].ids), stream[at].doc_tokens
        assert stream[at].start == 0
        key = stream[at].doc_id
        while len(ids) < n:
            at += 1
            assert stream[at].start == len(ids) and stream[at].doc_id == key
            ids += stream[at].ids
        got[key, tuple(ids)] += 1
        at += 1
    assert got == want
    short = pack(nasty, keep_ids=False)
    assert short.count() == len(pieces) and "ids" not in short.columns


def test_packing_of_nothing(empty):
    assert pack(empty, keep_ids=False).count() == 0


def test_top_k_matches_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 20))
    vectors = [base[i % 30] + rng.normal(scale=0.4, size=20) for i in range(260)] + [base[0]] * 30
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(vectors)] + [(500, None, 1), (550, [None, 1.0, float("nan")] + [1.0] * 17, 1), (None, [float(v) for v in base[1]], 1), (3, [float(v) for v in base[1]], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    got = top_k(frame, F.col("vec_id") % 50 == 0, 7).collect()
    codes = [(i, sum((v is not None and v > 0) << b for b, v in enumerate(x))) for i, x, _ in rows if x is not None]
    queries = [(i, c) for i, c in codes if i is not None and i % 50 == 0]
    want = []
    for q, c in queries:
        near = sorted(((c ^ d).bit_count(), i is None, i or 0, i) for i, d in codes)[:7]
        want += [(q, r + 1, i, n) for r, (n, _, _, i) in enumerate(near)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(frame.where("vec_id < 5"), F.col("vec_id") % 50 == 0, 9).count() == 6


@pytest.mark.parametrize("chunk", (2, 4096))
def test_top_k_with_split_buckets_and_queries(spark, chunk):
    """Buckets and common queries in many pieces, against all pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(5, 64))
    vectors = np.concatenate([base[rng.integers(0, 5, 150)] + rng.normal(scale=0.6, size=(150, 64)), np.repeat(base[:1], 100, axis=0), rng.normal(size=(50, 64))])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(frame, F.col("vec_id") % 4 == 0, 5, chunk=chunk).collect()))
    codes = np.packbits(vectors > 0, axis=1).view(np.uint64).ravel()
    want = []
    for q in range(0, len(codes), 4):
        distance = np.bitwise_count(codes ^ codes[q])
        order = np.lexsort((np.arange(len(codes)), distance))[:5]
        want += [(q, r + 1, int(i), int(distance[i])) for r, i in enumerate(order)]
    assert got == want


def test_pairs_meet_once(spark):
    """Over all rounds every pair is verified exactly once, and early rounds cover what they claim."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, (40, 1), dtype=np.int64) ^ (rng.integers(0, 2, (40, 1), dtype=np.int64) << 63)
    apart = np.bitwise_count(codes.view(np.uint64) ^ codes.view(np.uint64).T)
    parts = segments(1, 300)
    frame = spark.createDataFrame([(i, [int(c[0])]) for i, c in enumerate(codes)], "i int, code array<bigint>")
    cross = frame.crossJoin(frame.select(F.col("i").alias("j"), F.col("code").alias("query")))
    cross = cross.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1)))).cache()
    seen = collections.Counter()
    for radius in range(max(p.bits for p in parts) + 1):
        # what probes of this radius would meet
        differ = [F.bit_count(p.value(F.col("code")).bitwiseXOR(p.value(F.col("query")))) for p in parts]
        met = cross.where(F.array(*differ)[F.col("segment")] == radius)
        seen.update((r.i, r.j) for r in first_meetings(met.withColumn("radius", F.lit(radius)), parts, 1).collect())
        covered = len(parts) * (radius + 1) - 1
        assert all(seen[i, j] == 1 for i in range(40) for j in range(40) if apart[i, j] <= covered)
    assert set(seen.values()) == {1} and len(seen) == 1600


def test_codes_of_any_width(spark):
    frame = spark.createDataFrame([(1, [1.0] * 70), (2, [-1.0] * 3)], "vec_id long, embedding array<double>")
    assert {r.vec_id: len(r.code) for r in sign_codes(frame).collect()} == {1: 2, 2: 1}
    assert top_k(frame, F.lit(True), 5).count() == 2  # codes of different widths are not compared
