"""Every stage against a brute-force version on the rows it gets."""

import collections
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from volquery.llm import queries
from volquery.llm.packing import default_tokenizer
from volquery.llm.quality_classifier import classify
from volquery.llm.shared import cut

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, nasty, labels):
    root = tmp_path_factory.mktemp("sf")
    nasty.write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    return str(root)


def rows_of(frame):
    return collections.Counter(tuple(r) for r in frame.select(*pipeline.COLUMNS).collect())


def test_quality_drops_what_is_rejected(spark, nasty, labels, folder):
    bad = {(r.doc_id, r.text) for r in classify(nasty.select("doc_id", "text", F.col("text").alias("t2")), labels, carry=("t2",)).where("predicted = 0").select("doc_id", F.col("t2").alias("text")).collect()}
    got = rows_of(pipeline.quality(spark, nasty, folder))
    assert got == collections.Counter({k: n for k, n in rows_of(nasty).items() if (k[0], k[1]) not in bad and not (k[1] is None and (k[0], "") in bad)})


def test_one_document_of_each_group_stays(spark, nasty, folder):
    rows = nasty.select(*pipeline.COLUMNS).collect()
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    groups = collections.defaultdict(list)
    for row, c in zip(rows, root):
        groups[c].append(row)
    got = pipeline.near_dedup(spark, nasty, folder).collect()
    assert len(got) == len(groups)
    kept = collections.Counter(r.doc_id for r in got)
    assert kept == collections.Counter(min((r.doc_id for r in g if r.doc_id is not None), default=None) for g in groups.values())


def test_secrets_are_replaced(spark, nasty, folder):
    """Against Python: base spans are cut out of every text, and what is left of it stays as it was."""
    from test_text_rules import slow_secrets

    def redacted(text):
        out, end = "", 0
        for start, _, stop in slow_secrets(text):
            if start >= end:
                out += text[end:start] + "[SECRET]"
            end = max(end, stop)
        return out + text[end:]

    want = collections.Counter((r.doc_id, r.text if r.text is None else redacted(r.text), r.lang, r.source) for r in nasty.collect())
    out = pipeline.secrets(spark, nasty, folder).collect()
    assert collections.Counter((r.doc_id, r.text, r.lang, r.source) for r in out) == want and sum("[SECRET]" in (t or "") for _, t, _, _ in want) > 0
    assert all(len(r.text) == r.n_chars for r in out if "[SECRET]" in (r.text or ""))


def test_mixing_repeats_and_cuts(spark, nasty, folder):
    from test_mix_pack_search import slow_targets

    rows = nasty.select(*pipeline.COLUMNS).collect()
    unique = {(r.doc_id, r.text or "") for r in rows}
    words = collections.Counter()
    for r in rows:  # repeated rows are mixed each
        words[r.source] += len(WORD.findall(r.text or ""))
    got = collections.Counter()
    for r in pipeline.mixing(spark, nasty, folder).collect():
        got[r.source] += len(WORD.findall(r.text))
        assert any(r.doc_id == k and (t == r.text or WORD.findall(t)[: len(WORD.findall(r.text))] == WORD.findall(r.text)) for k, t in unique)
    want = slow_targets(words)
    assert all(abs(got[s] - t) < 1 for s, t in want.items())


def test_stages_in_order_and_whole_run(spark, folder):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), "t")
        assert tuple(docs.columns) == pipeline.COLUMNS
    last = pipeline.STAGES[-1][1](spark, docs, folder)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = collections.Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (2,)) for r in docs.collect())
    got, ids = collections.Counter(), ()
    for r in last.orderBy("sequence_id", "offset").collect():  # documents are cut where a sequence ends
        ids += tuple(r.ids)
        if r.start + r.length == r.doc_tokens:
            got[r.doc_id, ids] += 1
            ids = ()
    assert got == want and not ids
    whole = pipeline.run(spark, folder)
    assert whole.agg(F.sum("length")).first()[0] == last.agg(F.sum("length")).first()[0]


def test_stages_survive_empty_tables(spark, empty, folder):
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_every_operator_is_registered_once():
    names = sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [re.match(r"op(\d+)_", n)[1] for n in names] == [str(i) for i in range(1, 11)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_search_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.ORACLES["op4_topk_search"]).fetchall()
    got = queries.QUERIES["op4_topk_search"](spark, SF).select("query_id", "rank", "vec_id", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_copies_at_five_words_and_similarity_go(spark, folder):
    import random

    from conftest import prose

    rng = random.Random(11)
    rows = []
    boiler = prose(rng, 60)
    for _ in range(60):
        words = prose(rng, rng.randint(20, 120)).split()
        rows.append(" ".join(words) + (" " + boiler if rng.random() < 0.4 else ""))
        for _ in range(rng.randint(0, 3)):  # copies with some words changed, near and far
            copy = rows[-1].split()
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(1000))
            rows.append(" ".join(copy))
    base = prose(rng, 200).split()  # a group in which each is a copy of the one before
    for i in range(12):
        base[i * 16] = f"step{i}"
        rows.append(" ".join(base))
    rng.shuffle(rows)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, rows)]
    smallest, moved = list(range(len(rows))), True
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while moved:
        moved = False
        for i, j in near:
            if smallest[i] != smallest[j]:
                smallest[i] = smallest[j] = min(smallest[i], smallest[j])
                moved = True
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in pipeline.near_dedup(spark, docs, folder).select("doc_id").collect()}
    assert len(near) > 20 and got == {i for i, s in enumerate(smallest) if i == s}


def test_packed_sequences_leave_the_pipeline(spark, nasty, folder):
    import zlib

    import numpy as np

    pieces = pipeline.packing(spark, nasty.select(*pipeline.COLUMNS), folder).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in pieces)
    ids = [i for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) for i in r.ids]
    assert ids.count(2) >= nasty.count() and ids[-1] == 2
