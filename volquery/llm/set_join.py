"""Jaccard join of n-gram sets by a pigeonhole over a partition of the universe.

A band holds sets of nearly one size, so that similar sets lie in one band or in two next to each other.
Each band has a scheme: a number of segments that tokens are dealt to by hash.  Two sets of the scheme that
are similar differ in at most H tokens.  A set therefore picks, of its segments, some to be probed as they
are (worth one each) and some with their one-deletion neighbourhoods (worth two), of total worth H + 1: if
the first all differed by one token and the others by two, the sets would differ in more than H.  It picks
those that cost least by a sample's counts of signatures, so that common and empty segments are left out
where the others suffice.  Every set is indexed whole under its own scheme and the next: all segments, and
the one-deletion neighbourhoods of those that may be picked with theirs.

Sets that share a signature are a group.  Groups of the same sets are one.  Members of a group are first
compared with its best connected set; groups that still hold several components are compared inside, chunk
against chunk: by sketches, then on the whole sets, and only a forest of the links leaves the task.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, drop_cut, row_slices, small_batches
from .shingles import _mix, set_id, shingle_sets_of, similar

WIDTH, PERCENT = 5, 80
#: Documents sampled for the costs, the count from which a signature is listed, and the most that are.
#: They change the work only: any choice of segments of enough worth finds all links.
SAMPLE, COMMON, LISTED = 10_000, 4, 1 << 17
#: Cost of a signature that the sample holds once more, and of an empty segment.
PER_COUNT, EMPTY = 16, 4000
#: Bits of the sketch of a set of up to so many tokens; larger sets have more.
SKETCH_BITS, SKETCH_TOKENS = 1024, 512
#: Tokens of the sets of one chunk of a group, and rounds in which members are compared with one of them.
CHUNK_TOKENS, ROUNDS = 1 << 18, 2
#: Rows of a group that are looked at together for its membership.
TOGETHER = 1 << 14
#: Sets of a task that are remembered, so that copies are dealt once.
REMEMBERED = 1 << 17
PROBE, INDEX = 1, 2
_WHOLE, _LESS_ONE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Bands:
    """Sizes, segments and the worth that is needed, for ``percent`` of similarity."""

    percent: int

    def lows(self, largest: int) -> np.ndarray:
        """The least size of each band, up to one beyond ``largest``: each at most ``percent`` of the next."""
        out = [1]
        while out[-1] <= largest:
            out.append(max(out[-1] + 1, -(-100 * out[-1] // self.percent)))
        return np.array([*out, max(out[-1] + 1, -(-100 * out[-1] // self.percent))], np.int64)

    def differing(self, size: np.ndarray) -> np.ndarray:
        """The most tokens in which a set of this size and a similar one that is not larger differ."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    def segments(self, high: np.ndarray) -> np.ndarray:
        """Segments of a band of sizes below ``high``: a tenth more than are needed, to choose from."""
        needed = self.differing(high - 1) + 1
        return needed + 1 + needed // 10

    def doubled(self, segments: np.ndarray) -> np.ndarray:
        """How many of the segments may be picked with their one-deletion neighbourhoods."""
        return np.minimum(segments, 2 + segments // 32)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _kept(values: np.ndarray, kind: np.uint64, scheme: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Signatures without flags (62 bits)."""
    at = _mix(scheme.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + segment.astype(np.uint64) * _LESS_ONE + kind)
    return _mix(_mix(values + at) ^ at) >> np.uint64(2)


class Costs:
    """Counts of listed signatures in the sample."""

    def __init__(self, listed: np.ndarray, count: np.ndarray):
        self.listed, self.count = listed, count

    def of(self, signatures: np.ndarray) -> np.ndarray:
        if not len(self.listed):
            return np.zeros(len(signatures), np.int64)
        at = np.minimum(np.searchsorted(self.listed, signatures), len(self.listed) - 1)
        return np.where(self.listed[at] == signatures, self.count[at], 0)


def picked(cost_one: np.ndarray, cost_two: np.ndarray, segments: np.ndarray, doubled: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Worth (0, 1 or 2) given to each segment of each set, ``needed`` in total at the least cost: the
    cheapest steps are taken, and the second step of a segment never costs less than its first."""
    sets = np.arange(len(segments))
    first, firsts = np.repeat(sets, segments), _ranges(np.cumsum(segments) - segments, segments)
    second, seconds = np.repeat(sets, doubled), _ranges(np.cumsum(segments) - segments, doubled)
    owner, place = np.concatenate([first, second]), np.concatenate([firsts, seconds])
    cost = np.concatenate([cost_one, np.maximum(cost_two, cost_one[seconds])])
    order = np.lexsort((cost, owner))  # stable: of equal steps a segment's first comes first
    per_set = segments + doubled
    nth = np.arange(len(order)) - np.repeat(np.cumsum(per_set) - per_set, per_set)
    chosen = place[order[nth < needed[owner[order]]]]
    return np.bincount(chosen, minlength=int(segments.sum()))


def signatures(hashes: np.ndarray, ends: np.ndarray, bands: Bands, costs: Costs | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, signature and flags of all sets end to end (``ends``: their n + 1 offsets); without costs only
    what is indexed."""
    size = np.diff(ends)
    rows = np.flatnonzero(size > 0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = size[rows]
    lows = bands.lows(int(size.max()))
    band = np.searchsorted(lows, size, side="right") - 1
    tokens, dealt = _mix(hashes ^ _WHOLE), _mix(hashes + _LESS_ONE) >> np.uint64(32)
    owner = np.repeat(np.arange(len(rows)), size)

    def add(of: np.ndarray, kind: np.uint64, scheme: np.ndarray, segment: np.ndarray, value: np.ndarray, flags: np.ndarray) -> None:
        out.append((rows[of], _kept(value, kind, scheme[of], segment), flags))

    for own in (True, False):
        scheme = band if own else band + 1
        segments = bands.segments(lows[scheme + 1])
        doubled = bands.doubled(segments)
        base = np.cumsum(segments) - segments
        segment = (dealt * segments[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        place = base[owner] + segment
        content = np.zeros(int(segments.sum()), np.uint64)
        np.add.at(content, place, tokens)
        count = np.bincount(place, minlength=len(content))
        of = np.repeat(np.arange(len(rows)), segments)
        number = np.arange(len(content)) - base[of]
        some = np.flatnonzero(segment < doubled[owner])  # tokens with a one-deletion neighbour
        less = content[place[some]] - tokens[some]
        flags = np.full(len(content), INDEX)
        if own and costs is not None:
            whole = _kept(content, _WHOLE, scheme[of], number)
            two = np.flatnonzero(number < doubled[of])
            neighbours = costs.of(_kept(less, _WHOLE, scheme[owner[some]], segment[some])) * PER_COUNT + 1
            cost_two = np.zeros(len(content), np.int64)
            np.add.at(cost_two, place[some], neighbours)
            cost_two = cost_two[two] + 1 + PER_COUNT * costs.of(_kept(content[two], _LESS_ONE, scheme[of[two]], number[two])) + np.where(count[two] == 0, EMPTY, 0)
            worth = picked(1 + PER_COUNT * costs.of(whole) + np.where(count == 0, EMPTY, 0), cost_two, segments, doubled, bands.differing(size) + 1)
            worth[np.repeat(bands.differing(size) == 0, segments)] = 0  # similar sets would be equal
            flags = flags | np.where(worth > 0, PROBE, 0)
            pairs = np.flatnonzero(worth == 2)
            add(of[pairs], _LESS_ONE, scheme, number[pairs], content[pairs], np.full(len(pairs), PROBE))
            probing = worth[place[some]] == 2
            add(owner[some[probing]], _WHOLE, scheme, segment[some[probing]], less[probing], np.full(int(probing.sum()), PROBE))
        add(of, _WHOLE, scheme, number, content, flags)
        add(owner[some], _LESS_ONE, scheme, segment[some], less, np.full(len(some), INDEX))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def sketch(tokens: np.ndarray) -> bytes:
    """The parity of the number of tokens in each bucket.  Where two sketches differ, so do the sets: the
    number of such buckets is at most the number of tokens in only one of them."""
    bits = SKETCH_BITS << max(0, (len(tokens) - 1) // SKETCH_TOKENS).bit_length()
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer buckets."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def may_be_similar(x: bytes, n_x: int, y: bytes, n_y: int, percent: int) -> bool:
    one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(one), len(two))
    apart = int(np.bitwise_count(folded(one, size) ^ folded(two, size)).sum())
    return (100 + percent) * apart <= (100 - percent) * (n_x + n_y)


def _batches(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for rows in row_slices(batch, "_text"):
        hashes, ends = shingle_sets_of(rows.column("_text"), width)
        names = np.array([set_id(hashes[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], np.int64)
        yield rows, hashes, ends, names


def common_signatures(texts: DataFrame, width: int, bands: Bands) -> Costs:
    """Signatures that several documents of a sample hold."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    # drawn from texts before they are hashed; copies in the sample count once
    sampled = texts.where(F.pmod(F.xxhash64("_text"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, ends, _ in _batches(batch, width):
                yield pa.RecordBatch.from_pydict({"signature": pa.array(signatures(hashes, ends, bands, None)[1].view(np.int64))})

    found = sampled.select("_text").distinct().mapInArrow(run, "signature bigint").groupBy("signature").count()
    found = found.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "signature").limit(LISTED).toArrow().sort_by("signature")
    return Costs(found.column("signature").to_numpy().view(np.uint64), found.column("count").to_numpy())


def described(texts: DataFrame, key: str, width: int, bands: Bands, costs: Costs) -> DataFrame:
    """``key, _set, n, sketch, alone, listed``: signatures with their flags in the lowest bits; ``listed``
    are known to be shared.  A set's signatures may be left to another of its rows in the same task."""
    shared = texts.sparkSession.sparkContext.broadcast(costs)  # LISTED entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        for batch in batches:
            for rows, hashes, ends, names in _batches(batch, width):
                fresh = np.zeros(len(names), bool)
                for i, name in enumerate(names.tolist()):
                    fresh[i] = name not in seen
                    seen[name] = None
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
                sizes = np.where(fresh, np.diff(ends), 0)
                of, signature, flags = signatures(hashes[_ranges(ends[:-1], sizes)], np.concatenate([[0], np.cumsum(sizes)]), bands, shared.value)
                order = np.argsort(of, kind="stable")
                of, signature, flags = of[order], signature[order], flags[order]
                value = (signature << np.uint64(2) | flags.astype(np.uint64)).view(np.int64)
                known = shared.value.of(signature) > 0
                lists = []
                for mask in (~known, known):
                    edges = np.searchsorted(of[mask], np.arange(len(names) + 1)).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(value[mask])))
                sketches = [sketch(hashes[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_pydict({key: rows.column(key), "_set": pa.array(names), "n": pa.array(np.diff(ends).astype(np.int32)), "sketch": pa.array(sketches, pa.binary()), "alone": lists[0], "listed": lists[1]})

    kind = texts.schema[key].dataType.simpleString()
    return texts.mapInArrow(run, f"`{key}` {kind}, _set bigint, n int, sketch binary, alone array<bigint>, listed array<bigint>")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """``g, _set, probe``: the sets of each signature that several sets hold and one probes.  A signature is
    named after the sets that hold it, so that groups of the same sets are one."""

    def groups(signature: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        g, flags = signature >> 2, signature & 3
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (sets[1:] != sets[:-1])
        firsts = np.flatnonzero(fresh)
        if len(firsts):
            flags = np.bitwise_or.reduceat(flags, firsts)
        g, sets = g[firsts], sets[firsts]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(g)))
        probe = flags & PROBE
        many = counts > 1
        if many.any():
            many &= np.add.reduceat(probe, starts) > 0
            one = _mix(sets.view(np.uint64) + np.uint64(1) + probe.astype(np.uint64) * _WHOLE)
            name = _mix(np.add.reduceat(one, starts)) ^ np.bitwise_xor.reduceat(_mix(one ^ _LESS_ONE), starts)
            _, once = np.unique(np.where(many, name, np.uint64(0)), return_index=True)
            pick = np.zeros(len(starts), bool)
            pick[once] = True
            pick &= many
            rows = _ranges(starts[pick], counts[pick])
            g, sets, probe = np.repeat(name[pick].view(np.int64), counts[pick]), sets[rows], probe[rows]
        else:
            g, sets, probe = g[:0], sets[:0], probe[:0]
        return pa.RecordBatch.from_pydict({"g": pa.array(g), "_set": pa.array(sets), "probe": pa.array(probe.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        crowd = None  # a signature of very many rows, which pass by under its own name
        for batch in batches:
            signature, sets = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("signature", "_set")))
            if not len(signature):
                continue
            last = int(np.searchsorted(signature >> 2, signature[-1] >> 2, side="left"))
            if last and crowd is not None:
                passed = signature >> 2 == crowd
                yield _crowd(crowd, signature[passed], sets[passed])
                done, crowd = int(passed.sum()), None
            else:
                done = 0
            if last > done:
                yield groups(signature[done:last], sets[done:last])
            held = signature[last:], sets[last:]
            if len(held[0]) > TOGETHER:
                crowd = int(held[0][0] >> 2)
                yield _crowd(crowd, *held)
                held = held[0][:0], held[1][:0]
        if len(held[0]):
            yield _crowd(crowd, *held) if crowd == held[0][0] >> 2 else groups(*held)

    def _crowd(g: int, signature: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"g": pa.array(np.full(len(sets), g)), "_set": pa.array(sets), "probe": pa.array((signature & PROBE).astype(np.int32))})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = rows.select(F.explode("alone").alias("signature"), "_set").repartition(n, F.shiftright("signature", 2))
    named = alone.sortWithinPartitions(F.shiftright("signature", 2), "_set").mapInArrow(run, "g bigint, _set bigint, probe int")
    listed = rows.select(F.explode("listed").alias("signature"), "_set")
    listed = listed.select(F.shiftright("signature", 2).alias("g"), "_set", F.col("signature").bitwiseAND(PROBE).cast("int").alias("probe"))
    return named.unionByName(listed).groupBy("g", "_set").agg(F.max("probe").alias("probe"))


def whole_sets(texts: DataFrame, key: str, chosen: DataFrame, width: int) -> DataFrame:
    """``_set, shingles`` of the sets of ``chosen`` (``_set, smallest``: a key that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, ends, names in _batches(batch, width):
                yield pa.RecordBatch.from_pydict({"_set": pa.array(names), "shingles": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))})

    keys = chosen.select(F.col("smallest").alias("_chosen")).distinct()
    found = texts.join(keys.hint("merge"), F.col(key).eqNullSafe(F.col("_chosen")), "left_semi").select("_text").mapInArrow(run, "_set bigint, shingles array<bigint>")
    found = found.join(chosen.select("_set").hint("merge"), "_set", "left_semi")
    return found.groupBy("_set").agg(F.first("shingles").alias("shingles"))


def checked_pairs(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``a, b`` whose sets are similar: what sketches do not rule out is checked whole."""

    percent = round(similarity * 100)

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(c).to_pylist() for c in ("of_a", "n_a", "of_b", "n_b")))
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*r, percent) for r in both], pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("of_a"), batch.column("of_b")
            good = [similar(x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64), similarity) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def both(frame: DataFrame, table: DataFrame, column: str, *more: str) -> DataFrame:
        one, two = (table.select(F.col("_set").alias(c), F.col(column).alias(f"of_{c}"), *[F.col(m).alias(f"{m}_{c}") for m in more]).hint("merge") for c in "ab")
        return frame.join(one, "a").join(two, "b")

    kept = cut(both(pairs, nodes, "sketch", "n").mapInArrow(open_, "a bigint, b bigint"), "join-possible")
    with small_batches(pairs.sparkSession):
        out = cut(both(kept, sets, "shingles").mapInArrow(check, "a bigint, b bigint"), "join-links")
    drop_cut(kept)
    return out


class Forest:
    def __init__(self, roots: np.ndarray):
        self.names = {r: r for r in roots.tolist()}

    def top(self, x: int) -> int:
        while self.names[x] != x:
            self.names[x] = x = self.names[self.names[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.names[max(x, y)] = min(x, y)
        return x != y


def _candidates(rows: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of two chunks (or one) of a group, each with those after it that it has to be compared with."""
    root, chunk, probe, n = (rows.column(c).to_numpy() for c in ("root", "chunk", "probe", "n"))
    two = chunk.min() != chunk.max()
    for i in range(len(root)):
        ahead = (root[i + 1 :] != root[i]) & ((probe[i + 1 :] | probe[i]) > 0) & ((chunk[i + 1 :] != chunk[i]) | (not two))
        ahead &= np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i]) - 1e-9
        if ahead.any():
            yield i, np.flatnonzero(ahead) + i + 1


def open_sets(rows: pa.Table, similarity: float) -> np.ndarray:
    """Rows with a partner that sketches do not rule out."""
    percent = round(similarity * 100)
    full = rows.column("sketch").to_pylist()
    least = min(len(x) for x in full) // 8
    small = np.stack([folded(np.frombuffer(x, np.uint64), least) for x in full])
    n = rows.column("n").to_numpy().astype(np.int64)
    open_ = np.zeros(len(full), bool)
    for i, ahead in _candidates(rows, similarity):
        apart = np.bitwise_count(small[i] ^ small[ahead]).sum(axis=1, dtype=np.int64)
        near = ahead[(100 + percent) * apart <= (100 - percent) * (n[i] + n[ahead])]
        near = [j for j in near.tolist() if not (open_[i] and open_[j]) and may_be_similar(full[i], int(n[i]), full[j], int(n[j]), percent)]
        open_[near] = True
        open_[i] |= bool(near)
    return np.flatnonzero(open_)


def forest_of(rows: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between different components, as many as join them, of all similar pairs of the rows."""
    ids, n = rows.column("_set").to_numpy(), rows.column("n").to_numpy()
    lists = rows.column("shingles").combine_chunks()
    _, token = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    forest, mark = Forest(rows.column("root").to_numpy()), np.zeros(int(token.max(initial=0)) + 1, bool)
    root = rows.column("root").to_numpy().tolist()
    a, b = [], []
    for i, ahead in _candidates(rows, similarity):
        ahead = np.array([j for j in ahead.tolist() if forest.top(root[j]) != forest.top(root[i])], np.int64)
        if not len(ahead):
            continue
        mark[token[ends[i] : ends[i + 1]]] = True
        both = np.add.reduceat(mark[token[_ranges(ends[ahead], n[ahead])]], np.cumsum(n[ahead]) - n[ahead], dtype=np.int64)
        mark[token[ends[i] : ends[i + 1]]] = False
        for j in ahead[both >= similarity * (n[i] + n[ahead] - both) - 1e-9].tolist():
            if forest.join(root[i], root[j]):
                a.append(int(ids[i]))
                b.append(int(ids[j]))
    return np.array(a, np.int64), np.array(b, np.int64)


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``g, ci, cj`` of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy() for c in ("g", "ci", "cj")])
        edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for x, y in zip(edges[:-1], edges[1:]):
            group = tuple(names[:, x].tolist())
            if held and group != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = group
    if held:
        yield pa.Table.from_batches(held)


def different_groups(rows: DataFrame) -> DataFrame:
    """Of the groups (``g, ci, cj``) that hold the same ``chunk, _set, probe``, the rows of one."""
    names, member = ["g", "ci", "cj"], F.xxhash64("chunk", "_set", "probe")
    named = rows.groupBy(*names).agg(F.count("*").alias("k"), F.bit_xor(member).alias("x"), F.sum(member % (1 << 31)).alias("s"))
    first = named.groupBy("k", "x", "s").agg(F.min(F.struct(*names)).alias("first")).select("first.*")
    return rows.join(first.hint("merge"), names, "left_semi")


def links_inside(rooted: DataFrame, nodes: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], similarity: float, tokens: int) -> DataFrame:
    """``a, b``: links that join the components of each group (``g, _set, probe, root``) as all its similar
    pairs would.  A task holds two chunks of a group, of about ``tokens`` tokens, at a time.  ``sets`` may be
    a function that makes a table (dropped here) of the sets of the rows that sketches leave open, which are
    few; of groups that are then the same one is checked."""
    n = int(rooted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "g bigint, ci int, cj int, chunk int, _set bigint, n int, root bigint, probe int"

    def grouped(frame: DataFrame) -> DataFrame:
        return frame.repartition(n, "g", "ci", "cj").sortWithinPartitions("g", "ci", "cj")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            kept = rows.drop_columns(["sketch"]).take(pa.array(open_sets(rows, similarity)))
            yield from kept.combine_chunks().to_batches()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            a, b = forest_of(rows, similarity)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    sized = rooted.join(nodes.select("_set", "n", "sketch").hint("merge"), "_set")
    chunks = sized.groupBy("g").agg(F.ceil(F.sum(F.col("n") + 64) / tokens).cast("int").alias("chunks"))
    met = sized.join(chunks.hint("merge"), "g").withColumn("chunk", F.pmod(F.xxhash64("_set"), "chunks").cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    names = ["g", F.least("chunk", "o").alias("ci"), F.greatest("chunk", "o").alias("cj"), "chunk", "_set", "n", "root", "probe"]
    open_ = cut(grouped(met.select(*names, "sketch")).mapInArrow(sift, fields), "join-open")
    made = callable(sets)
    if made:
        left, open_ = open_, cut(different_groups(open_), "join-different")
        drop_cut(left)
        sets = sets(open_)
    with small_batches(rooted.sparkSession):
        links = cut(grouped(open_.join(sets.hint("merge"), "_set").select(*[f.split()[0] for f in fields.split(", ")], "shingles")).mapInArrow(check, "a bigint, b bigint"), "join-inside")
    for table in (open_, sets) if made else (open_,):
        drop_cut(table)
    return links


def apart(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``g, _set, probe, root`` of the groups that hold several components."""
    named = met.select("g", "_set", "probe")
    if roots is not None:
        named = named.join(roots.withColumnRenamed("node", "_set").hint("merge"), "_set", "left")
    named = named.withColumn("root", F.coalesce("root", "_set") if roots is not None else F.col("_set"))
    several = named.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("probe").alias("asks")).where("low <> high AND asks > 0")
    return cut(named.join(several.select("g").hint("merge"), "g"), "join-apart")


def set_components(rooted: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, tokens: int) -> DataFrame:
    """``node, root`` of all sets that are linked, by groups from ``apart``."""
    links, roots = [], None
    for i in range(ROUNDS + 1):
        if rooted.isEmpty():
            break
        if i == ROUNDS:
            links.append(links_inside(rooted, nodes, sets, similarity, tokens))
        else:
            if i == 0:  # the set that meets the most others
                sizes = rooted.groupBy("g").agg(F.count("*").alias("size"))
                weight = rooted.join(sizes.hint("merge"), "g").groupBy("_set").agg(F.sum("size").alias("weight"))
                weighed = rooted.join(weight.hint("merge"), "_set")
            else:
                weighed = rooted.withColumn("weight", F.xxhash64("_set", F.lit(i)))
            hubs = weighed.groupBy("g").agg(F.max(F.struct("weight", "_set", "root")).alias("hub")).select("g", F.col("hub._set").alias("hub"), F.col("hub.root").alias("of"))
            pairs = rooted.join(hubs.hint("merge"), "g").where("root <> of")
            pairs = cut(pairs.select(F.least("hub", "_set").alias("a"), F.greatest("hub", "_set").alias("b")).distinct(), "join-pairs")
            links.append(checked_pairs(pairs, nodes, sets, similarity))
            drop_cut(pairs)
        linked = links[0]
        for more in links[1:]:
            linked = linked.unionByName(more)
        roots = connected_components(linked, "a", "b", f"join-roots-{i}")
        if i < ROUNDS:
            old, rooted = rooted, apart(rooted, roots)
            drop_cut(old)
    return roots


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``key, n_shingles, component_id``: one row per input row.  Two rows are linked when ``percent``
    hundredths of the union of their sets of ``width``-word shingles, or more, are common; the component is
    the smallest key reachable, the row's own included.

    ASCII letters are lower-cased; fewer words than ``width`` are one shingle.  Null, empty and blank texts
    have no shingles and are linked with nothing.  Equal sets are one node, whatever the number of rows;
    repeated rows are returned each.  Texts of any length are read whole.  A null key is nobody's smallest:
    rows that only null keys reach have a null component.  Other columns, whatever their names, are ignored;
    an empty table gives no rows."""
    bands, similarity = Bands(percent), percent / 100
    texts = docs.select(key, F.col(text).alias("_text"))
    costs = common_signatures(texts, width, bands)
    with small_batches(docs.sparkSession):
        rows = cut(described(texts, key, width, bands, costs), "join-rows")
    met = cut(shared_signatures(rows), "join-met")
    table = cut(rows.select(key, "_set", "n"), "join-table")
    nodes = rows.where("n > 0").groupBy("_set").agg(F.min(key).alias("smallest"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes, "join-nodes")
    drop_cut(rows)
    groups = apart(met, None)
    drop_cut(met)
    chosen = nodes.join(groups.select("_set").distinct().hint("merge"), "_set", "left_semi")
    sets = cut(whole_sets(texts, key, cut(chosen.select("_set", "smallest"), "join-chosen"), width), "join-sets")
    roots = set_components(groups, nodes, sets, similarity, tokens)
    if roots is None:
        names = nodes.select(F.col("_set").alias("_node"), F.col("smallest").alias("component_id"))
    else:
        linked = roots.join(nodes.hint("merge"), roots["node"] == nodes["_set"]).select("root", "_set", "smallest")
        smallest = linked.groupBy("root").agg(F.min("smallest").alias("component_id"))
        renamed = linked.join(smallest.hint("merge"), "root").select("_set", "component_id")
        names = nodes.join(renamed.hint("merge"), "_set", "left").select(F.col("_set").alias("_node"), F.coalesce("component_id", "smallest").alias("component_id"))
    names = cut(names, "join-names")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id")
    return table.join(names.hint("merge"), table["_set"] == names["_node"], "left").select(key, F.col("n").cast("long").alias("n_shingles"), own)
