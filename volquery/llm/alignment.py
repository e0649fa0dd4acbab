"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of aligned token ids.

The tokens of tokenizer B, end to end, are a static interval index: their byte starts and ends are sorted.
Every token of A is a stabbing query of two bisections, which give the first and the last token of B that
it overlaps.  A gap that no token spans, on either side, ends a group.  Tokens of a group are linked each
with each; an id pair counts the documents that hold it.

Texts are encoded once and kept as distinct id pairs with their number of links.  The pairs that most
documents hold (``LISTED``, a fixed number) are looked up in place; only the others are joined.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_cut, row_slices, small_batches, task_id, text_buffers
from .word_bpe import byte_of_symbol

#: The published pre-token pattern of the byte-level vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs that are looked up in place: at most so many, whatever the corpus.
LISTED = 1 << 18
#: Links worked on at once; a document with more is worked on by classes of its A ids.
LINKS = 1 << 21
SPACE_PIECE = "▁"
_NAMES = "_row bigint, _first boolean, `{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, links array<bigint>"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The bytes of each id of a vocabulary."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.bytes[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


@dataclass(frozen=True)
class Files:
    """Both vocabulary files as bytes: executors need not have them."""

    a: bytes
    b: bytes

    @classmethod
    def read(cls, a: str, b: str) -> Files:
        with open(a, "rb") as one, open(b, "rb") as two:
            return cls(one.read(), two.read())


class Encoders:
    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(files.a.decode())
        self.slow.encode_special_tokens = True
        model = json.loads(files.a)["model"]
        byte = byte_of_symbol()
        ids = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in byte for c in piece)}
        special = {t["content"].encode() for t in json.loads(files.a).get("added_tokens", ())}
        ranks = {piece: i for piece, i in ids.items() if piece not in special}
        self.size_a = max(model["vocab"].values()) + 1
        named = {i: piece for piece, i in ids.items()}
        self.a = Pieces([named.get(i, b"") for i in range(self.size_a)])
        # the rank engine merges by id: it is used where ids follow the order of the merges
        merged = [ids.get(bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" "))), -1) for m in model["merges"]]
        ordered = merged == sorted(set(merged)) and len(ranks) == 256 + len(merged)
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        self.size_b = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(self.size_b)]
        self.b = Pieces([bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(SPACE_PIECE, " ").encode() for i, n in enumerate(names)])

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as error:  # its pattern engine gives up on some very long runs
                if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=1)
def _encoders(files: Files) -> Encoders:
    return Encoders(files)


def stabbed(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last interval of the index (sorted, disjoint) that overlap each interval asked for."""
    return np.searchsorted(ends, low, side="right"), np.searchsorted(starts, high, side="left") - 1


def groups_of(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token of A and of B; the two cover the same bytes, group by group."""
    end_a, end_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    first, last = stabbed(end_b - sizes_b, end_b, end_a - sizes_a, end_a)
    gaps = np.flatnonzero(first[1:] > last[:-1])  # nothing of B spans the end of this token of A
    of_a = np.zeros(len(end_a), np.int64)
    of_a[gaps + 1] = 1
    return np.cumsum(of_a), np.searchsorted(end_a[gaps], end_b - sizes_b, side="right")


@functools.lru_cache(maxsize=1)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids in five or more places, with one more for a separator, and which are used."""
    width = len(str(size))
    digits = np.frombuffer("".join(f"{i:>{width}} " for i in range(size)).encode(), np.uint8).reshape(size, width + 1).copy()
    used = digits != 0x20
    used[:, width] = True
    return digits, used


def group_digests(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as text; ``docs_a`` and ``docs_b`` are the documents' token offsets."""
    n = int(of_a[-1]) + 1
    count_a, count_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    place_a = np.arange(len(a)) + (np.cumsum(count_b) - count_b)[of_a]
    place_b = np.arange(len(b)) + np.cumsum(count_a)[of_b]
    digits, used = _digits(1 << int(max(a.max(), b.max()) + 1).bit_length())
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[place_a[np.cumsum(count_a) - 1]] = ord("|")
    mark[place_b[np.cumsum(count_b) - 1]] = ord(";")
    out, keep = digits[ids], used[ids]
    out[:, -1] = mark
    keep[place_b[docs_b[1:] - 1], -1] = False
    ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])[docs_a + docs_b]
    flat = memoryview(out[keep])
    return [hashlib.sha256(flat[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


def linked_pairs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, size_b: int) -> np.ndarray:
    """``a * size_b + b`` of all links, group by group."""
    n = int(of_a[-1]) + 1
    count_a, count_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    links = count_a * count_b
    group = np.repeat(np.arange(n), links)
    nth = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    return a[first_a[group] + nth // count_b[group]] * size_b + b[first_b[group] + nth % count_b[group]]


def pairs_by_class(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, size_b: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of one document and their links, in pieces without a pair in common: a piece has the
    links of some A ids.  An id with more links than ``limit`` in groups is counted over distinct B ids."""
    n = int(of_a[-1]) + 1
    count_b = np.bincount(of_b, minlength=n)
    first_b = np.cumsum(count_b) - count_b
    by_id = np.argsort(a, kind="stable")
    weight = np.cumsum(count_b[of_a[by_id]])
    at = 0
    while at < len(a):
        base = weight[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(weight, base + limit, side="right")))
        if stop < len(a):  # whole ids only
            low = int(np.searchsorted(a[by_id], a[by_id[stop]], side="left"))
            stop = low if low > at else int(np.searchsorted(a[by_id], a[by_id[at]], side="right"))
        found: dict[str, np.ndarray] = {"pair": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
        step = at
        while step < stop:  # one id may have very many links: they are summed piece by piece
            upto = min(stop, max(step + 1, int(np.searchsorted(weight, (weight[step - 1] if step else 0) + limit, side="right"))))
            rows = by_id[step:upto]
            n_b = count_b[of_a[rows]]
            nth = np.arange(int(n_b.sum())) - np.repeat(np.cumsum(n_b) - n_b, n_b)
            pair, links = np.unique(np.repeat(a[rows], n_b) * size_b + b[np.repeat(first_b[of_a[rows]], n_b) + nth], return_counts=True)
            both, where = np.unique(np.concatenate([found["pair"], pair]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, where, np.concatenate([found["n"], links]))
            found = {"pair": both, "n": total}
            step = upto
        yield found["pair"], found["n"]
        at = stop


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _equal_bytes(encoders: Encoders, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and B and their counts by row, only of rows whose tokens spell the text, and which rows these are."""
    data, offsets = text_buffers(texts)
    rows = np.flatnonzero(np.diff(offsets) > 0)
    chosen = texts.take(pa.array(rows)).to_pylist()
    list_a, list_b = [encoders.encode_a(" " + t) for t in chosen], encoders.encode_b(chosen) if chosen else []
    ids = [np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in y]]) for y in (list_a, list_b)]
    counts = [np.array([len(x) for x in y], np.int64) for y in (list_a, list_b)]
    wanted = np.diff(offsets)[rows] + 1
    good = np.ones(len(rows), bool)
    for pieces, i, n in zip((encoders.a, encoders.b), ids, counts):
        good &= np.add.reduceat(np.append(pieces.sizes[i], 0), _offsets(n)[:-1]) * (n > 0) == wanted if len(n) else True
    for _ in range(2):  # lengths, then bytes
        ids = [i[np.repeat(good, n)] for i, n in zip(ids, counts)]
        counts, rows, wanted = [n[good] for n in counts], rows[good], wanted[good]
        if _ or not len(rows):
            break
        ends = _offsets(wanted)
        spelled = np.full(int(ends[-1]), 0x20, np.uint8)
        inner = np.ones(len(spelled), bool)
        inner[ends[:-1]] = False
        lengths = np.diff(offsets)[rows]
        spelled[inner] = data[np.repeat(offsets[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
        good = np.ones(len(rows), bool)
        for pieces, i in zip((encoders.a, encoders.b), ids):
            wrong = np.flatnonzero(pieces.joined(i) != spelled)
            good[np.searchsorted(ends, wrong, side="right") - 1] = False
    return ids[0], ids[1], counts[0], counts[1], rows


def _described(encoders: Encoders, batch: pa.RecordBatch, key: str, before: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_NAMES`` for the rows of a batch; a row with very many links has more than one."""
    a, b, count_a, count_b, rows = _equal_bytes(encoders, batch.column("_text"))
    total = batch.num_rows
    n_a, n_b, n_groups, n_links = (np.zeros(total, np.int64) for _ in range(4))
    n_a[rows], n_b[rows] = count_a, count_b
    digests = np.full(total, "", object)
    pairs, links = [np.zeros(0, np.int64)] * total, [np.zeros(0, np.int64)] * total
    more: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(rows):
        of_a, of_b = groups_of(encoders.a.sizes[a], encoders.b.sizes[b])
        docs_a, docs_b = _offsets(count_a), _offsets(count_b)
        digests[rows] = group_digests(a, b, of_a, of_b, docs_a, docs_b)
        groups = np.diff(np.concatenate([of_a[docs_a[:-1]], [of_a[-1] + 1]]))
        n_groups[rows] = groups
        product = np.bincount(of_a) * np.bincount(of_b)
        n_links[rows] = sums = np.add.reduceat(product, of_a[docs_a[:-1]])
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(sums[at:]), limit, side="right")) + at)
            one, two = slice(docs_a[at], docs_a[stop]), slice(docs_b[at], docs_b[stop])
            g_a, g_b = of_a[one] - of_a[docs_a[at]], of_b[two] - of_a[docs_a[at]]
            if sums[at] > limit:
                pieces = pairs_by_class(a[one], b[two], g_a, g_b, encoders.size_b, limit)
                more += [(int(rows[at]), *p) for p in pieces]
            else:
                doc = np.repeat(np.arange(at, stop), sums[at:stop])
                space = encoders.size_a * encoders.size_b
                pair, n = np.unique((doc - at) * space + linked_pairs(a[one], b[two], g_a, g_b, encoders.size_b), return_counts=True)
                edges = np.searchsorted(pair, np.arange(stop - at + 1) * space)
                for i, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    pairs[rows[at + i]], links[rows[at + i]] = pair[x:y] - i * space, n[x:y]
            at = stop
    ids = (np.int64(task_id()) << np.int64(36)) + before + np.arange(total)
    columns = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests}

    def out(take: np.ndarray, first: bool, p: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        fixed = {"_row": pa.array(ids[take]), "_first": pa.array(np.full(len(take), first)), key: batch.column(key).take(pa.array(take))}
        rest = {name: pa.array(x[take], pa.string() if name == "groups_sha256" else pa.int64()) for name, x in columns.items()}
        return pa.RecordBatch.from_pydict(fixed | rest | {"pairs": _lists(p), "links": _lists(n)})

    yield out(np.arange(total), True, pairs, links)
    for row, pair, n in more:
        yield out(np.array([row]), False, [pair], [n])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = _offsets(np.array([len(v) for v in values], np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def aligned_documents(docs: DataFrame, key: str, text: str, files: Files, limit: int) -> DataFrame:
    """``_NAMES``: each row's figures, and its distinct id pairs (``a * size of B + b``) with their links.
    Rows that are not ``_first`` have more pairs of the same ``_row``; no pair comes twice in a ``_row``."""
    shared = docs.sparkSession.sparkContext.broadcast(files)  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, before = _encoders(shared.value), 0
        for batch in batches:
            for rows in row_slices(batch, "_text", 1 << 20):
                yield from _described(encoders, rows, key, before, limit)
                before += rows.num_rows

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, _NAMES.format(key=key, kind=kind))


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """``pair, n_docs, is_best``: documents that hold a pair; whether no pair of its A id has more."""
    counted = cut(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "align-pairs")
    of_a = F.floor(F.col("pair") / size_b).cast("long").alias("_a")
    most = counted.groupBy(of_a).agg(F.max("n_docs").alias("_most"))  # a row for each id of the vocabulary
    out = counted.select("pair", "n_docs", of_a).join(most, "_a").select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("is_best"))
    out = cut(out, "align-counts")
    drop_cut(counted)
    return out


def align_tokenizers(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", text: str = "text", listed: int = LISTED, limit: int = LINKS) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per input row.

    A encodes a space and the text, B the text, which it puts a space before; special tokens are neither
    added nor recognised.  ``n_best`` counts the links whose pair is held by the most documents of all
    pairs of its A id (ties included), ``count_sum`` sums the documents over the links.  Null and empty
    texts, and texts that either tokenizer does not spell byte for byte, have no tokens: zeros and an empty
    string.  Texts of any length are read whole; a group of any size is counted exactly in bounded memory.
    Repeated rows count and are returned each; null keys are kept; other columns, whatever their names, are
    ignored; an empty table gives no rows."""
    files = Files.read(*((a, b) if a and b else default_tokenizers()))
    size_b = _encoders(files).size_b
    spark = docs.sparkSession
    table = cut(aligned_documents(docs, key, text, files, limit), "align-documents")
    counts = pair_counts(table, size_b)
    common = counts.orderBy(F.desc("n_docs"), "pair").limit(listed).toArrow().sort_by("pair")
    hot = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("pair", "n_docs", "is_best")))  # ``listed`` rows at most

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n_docs, best = hot.value
        for batch in batches:
            lists = batch.column("pairs")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            asked, links = lists.flatten().to_numpy(), batch.column("links").flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, asked), max(0, len(pair) - 1))
            known = pair[at] == asked if len(pair) else np.zeros(len(asked), bool)
            sums = [_offsets(np.where(known, x, 0)) for x in ((n_docs[at] * links, best[at] * links) if len(pair) else (links, links))]
            seen = _offsets(~known)
            rest = [pa.ListArray.from_arrays(pa.array(seen[ends].astype(np.int32)), pa.array(x[~known])) for x in (asked, links)]
            yield pa.RecordBatch.from_pydict({"_row": batch.column("_row"), "s": pa.array(np.diff(sums[0][ends])), "n": pa.array(np.diff(sums[1][ends])), "pairs": rest[0], "links": rest[1]})

    with small_batches(spark):
        looked = cut(table.select("_row", "pairs", "links").mapInArrow(look_up, "_row bigint, s bigint, n bigint, pairs array<bigint>, links array<bigint>"), "align-looked")
    others = looked.select("_row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    joined = others.join(counts.hint("merge"), "pair").select("_row", (F.col("n_docs") * F.col("links")).alias("s"), F.when(F.col("is_best"), F.col("links")).otherwise(0).alias("n"))
    sums = looked.select("_row", "s", "n").unionByName(joined).groupBy("_row").agg(F.sum("n").alias("n_best"), F.sum("s").alias("count_sum"))
    figures = table.where("_first").select("_row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return figures.join(sums.hint("merge"), "_row").select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
