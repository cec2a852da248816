"""N-gram Jaccard join by chosen paths.

Documents are sets of word n-grams. Every set gets a signature of T coordinates, each a token (n-gram) sampled from it so that two
sets agree on a coordinate with a chance equal to their Jaccard similarity. The join splits sets recursively: at a
node, coordinates are chosen at random, each with chance 1 / (threshold * T), and every token value of a chosen coordinate is a child
that holds the sets sharing it. Nodes of few sets are compared by brute force; so are, in larger ones, the sets that are on
average as similar to the node as the threshold, since splitting them would not end. Runs with other choices are added until the
pairs found more than once say that the target recall is reached (Christiani, Pagh & Sivertsen 2018).

Sets that are equal are joined first and take part once. Signatures decide which pairs are candidates; each candidate is verified on
the whole sets, so the result has no false pair. Nodes are counted before they are gathered: a small one is split to the end
inside one task; a large one is cut into blocks that separate tasks test, and what must be compared by brute force is
compared in tiles of two blocks. So no node, however hot, meets in one task, and the rule is the same at every size.

Clusters of many near sets would give pairs by the square of their size, in every run. So a first pass over one run finds the nodes
that hold more than HOT sets close to each other; sets that share such nodes are a hub. The pairs within a hub are no candidates: all
its sets are compared with each other on whole sets, in tiles, and a tile returns links by set and the edges that connect it, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, unused
from .words import mix, words

#: Words in an n-gram, the similarity from which documents are near duplicates, and coordinates of a signature.
N, THRESHOLD, T = 2, 0.65, 64
#: Recall to reach and runs made at once. Batches of runs are added until the estimate holds.
RECALL, RUNS = 0.97, 6
#: Pairs this close to the threshold are the hardest to find: their recall is estimated on its own.
MARGIN = 0.1
#: Sets up to which a node is compared by brute force, and up to which it is split within one task or is one block of a larger node.
BRUTE, LOCAL = 200, 20_000
#: A set is compared with all of its node if its mean similarity to it is at least this part of the threshold.
CLOSE = 0.9
#: Sets that are close to each other in one node from which on they are a hub: compared among themselves by whole sets, outside of the runs.
HOT = 200
#: Sets and grams of a block of a hub, on average; two blocks are a tile.
HUB_SETS, HUB_GRAMS = 1000, 500_000
#: Pairs that a task holds before it passes them on.
FLUSH = 200_000
#: Rows of a checked broadcast (of nodes above LOCAL); beyond, they are joined by a shuffle.
BROADCAST_NODES = 100_000
#: Ids of a checked broadcast (of the documents whose texts hubs need): the other texts stay where they are. Beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of text; shorter texts are one n-gram of all their words."""
    _, _, h = words(text)
    if not len(h):
        return h
    size = min(n, len(h))
    grams = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        grams = mix(grams * np.uint64(31) + h[k : len(h) - size + 1 + k])
    return np.unique(grams)


def signature(grams: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates of 16 bits by one-permutation minhash: the least gram of each of t bins, empty bins filled from a bin drawn by hash."""
    h = mix(grams)
    bins = (h >> np.uint64(48)).astype(np.int64) * t >> 16
    order = np.lexsort((h, bins))
    first = order[np.flatnonzero(np.diff(bins[order], prepend=-1))]
    out = np.zeros(t, dtype=np.uint64)
    filled = np.zeros(t, dtype=bool)
    out[bins[first]], filled[bins[first]] = h[first], True
    full = filled.copy()
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        attempt += 1
        source = (mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(t)).astype(np.int64)
        ok = full[source]
        out[empty[ok]] = mix(out[source[ok]] + np.uint64(attempt))
        empty = empty[~ok]
    return (mix(out) & np.uint64(0xFFFF)).astype(np.uint16)


def chosen(path: int, level: int, seed: int, t: int, threshold: float) -> np.ndarray:
    """The coordinates that a node splits on, by hash of its path; the mean number is 1 / threshold. A root draws until it has one."""
    attempt = 0
    while True:
        rng = mix(np.arange(t, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((path ^ seed * 0x2545F4914F6CDD1D ^ level ^ attempt << 20) & (1 << 64) - 1))
        out = np.flatnonzero(rng < np.uint64(min(0.999999, 1 / (threshold * t)) * 0xFFFFFFFFFFFFFFFF))
        if len(out) or level:
            return out
        attempt += 1


def mean_match(sig: np.ndarray) -> np.ndarray:
    """Of each set in a node: the share of coordinates that it has in common with another of its sets, on average."""
    total = np.zeros(len(sig))
    for j in range(sig.shape[1]):
        _, at, n = np.unique(sig[:, j], return_inverse=True, return_counts=True)
        total += n[at] - 1
    return total / (sig.shape[1] * max(1, len(sig) - 1))


def least_match(threshold: float, t: int) -> int:
    """Coordinates that a candidate must share: three standard deviations under the mean of a pair at the threshold."""
    return max(1, math.floor(t * threshold - 3 * math.sqrt(t * threshold * (1 - threshold))))


class Splitter:
    """Splits nodes in memory and gathers candidate pairs (numbers of sets, lower first). Pairs within a hub (0: in none) are left out."""

    def __init__(self, threshold: float, t: int, seed: int):
        self.threshold, self.t, self.seed, self.least = threshold, t, seed, least_match(threshold, t)
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def few(self) -> int:
        """Sets up to which a node isn't split."""
        return BRUTE

    def keep(self, pairs: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.held += len(pairs)

    def compare(self, a: np.ndarray, a_sig: np.ndarray, a_hub: np.ndarray, b: np.ndarray, b_sig: np.ndarray, b_hub: np.ndarray) -> Iterator[None]:
        """Compares each of the sets a with each of b, a block at a time; stops where more than FLUSH pairs are held, for the caller to take them."""
        if not a_hub.any():
            yield from self._all(a, a_sig, b, b_sig)
            return
        for hub in np.unique(a_hub).tolist():
            mine, others = a_hub == hub, (b_hub != hub) | (hub == 0)
            yield from self._all(a[mine], a_sig[mine], b[others], b_sig[others])

    def _all(self, a: np.ndarray, a_sig: np.ndarray, b: np.ndarray, b_sig: np.ndarray) -> Iterator[None]:
        step = max(1, (1 << 22) // max(1, len(b) * self.t))
        for k in range(0, len(a) if len(b) else 0, step):
            same = (a_sig[k : k + step, None, :] == b_sig[None, :, :]).sum(axis=2, dtype=np.int16)
            i, j = np.nonzero(same >= self.least)
            x, y = a[k + i], b[j]
            apart = x != y
            x, y = x[apart], y[apart]
            if len(x):
                self.keep(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1))
                if self.held > FLUSH:
                    yield

    def walk(self, ids: np.ndarray, sig: np.ndarray, hub: np.ndarray, path: int, level: int) -> Iterator[None]:
        """Splits a node to the end; stops as compare does."""
        while len(ids) > 1 and not (hub[0] and (hub == hub[0]).all()):
            if len(ids) <= self.few():
                yield from self.compare(ids, sig, hub, ids, sig, hub)
                return
            close = mean_match(sig) >= CLOSE * self.threshold
            if not close.any():
                break
            yield from self.compare(ids[close], sig[close], hub[close], ids, sig, hub)
            ids, sig, hub = ids[~close], sig[~close], hub[~close]
        if len(ids) < 2 or hub[0] and (hub == hub[0]).all():
            return
        for j in chosen(path, level, self.seed, self.t, self.threshold).tolist():
            order = np.argsort(sig[:, j], kind="stable")
            cuts = np.flatnonzero(np.diff(sig[order, j].astype(np.int32))) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    yield from self.walk(ids[part], sig[part], hub[part], child(path, j, int(sig[part[0], j])), level + 1)

    def node(self, ids: np.ndarray, sig: np.ndarray, path: int, level: int) -> None:
        """Splits a node to the end and holds all its pairs."""
        for _ in self.walk(ids, sig, np.zeros(len(ids), dtype=np.int64), path, level):
            pass

    def take(self) -> np.ndarray:
        out = np.concatenate([*self.pairs, np.zeros((0, 2), dtype=np.int64)])
        self.pairs, self.held = [], 0
        return np.unique(out, axis=0)


class HubFinder(Splitter):
    """Gathers, for nodes with more than HOT sets that are close to the node, these sets, each paired with the least of them."""

    def few(self) -> int:
        return HOT

    def compare(self, a: np.ndarray, a_sig: np.ndarray, a_hub: np.ndarray, b: np.ndarray, b_sig: np.ndarray, b_hub: np.ndarray) -> Iterator[None]:
        if len(a) > HOT:
            self.keep(np.stack((np.full(len(a), a.min()), a), axis=1))
            if self.held > FLUSH:
                yield


def child(path: int, coordinate: int, value: int) -> int:
    return int(mix(np.array([(path * 0x9E3779B97F4A7C15 + (coordinate << 16 | value) + 1) & (1 << 64) - 1], dtype=np.uint64))[0])


def children(paths: np.ndarray, coordinate: int, values: np.ndarray) -> np.ndarray:
    return mix(paths * np.uint64(0x9E3779B97F4A7C15) + (np.uint64(coordinate << 16) | values.astype(np.uint64)) + np.uint64(1))


_NODE = "path long, run int, level int, sid long, sig binary, hub long"


def set_hash(grams: np.ndarray) -> int:
    """A hash of a set of grams, as a signed number."""
    total = int(mix(grams).sum()) + len(grams)
    return int(mix(np.array([total & (1 << 64) - 1], dtype=np.uint64)).view(np.int64)[0])


def _sets(docs: DataFrame, n: int, t: int | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, sid (hash of the set) and sig of t coordinates, or with t None the set itself. Rows without words, text or id have no sid."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, out = [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g = shingles(text.as_py(), n) if number is not None and text.is_valid else ()
                if not len(g):
                    sids.append(None)
                    out.append(None)
                    continue
                sids.append(set_hash(g))
                # Half a hash tells the grams of two sets apart well enough to count them.
                out.append((np.unique((g >> np.uint64(32)).astype(np.uint32)) if t is None else signature(g, t)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "sid", name])

    name = "grams" if t is None else "sig"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(build, f"doc_id long, sid long, {name} binary")


def _signatures(column: pa.Array, t: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, t)


def _roots(runs: range, threshold: float, t: int):
    """A map from sets (sid, sig and, if there are any, hub) to the children of every run's root."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch.column(1), t)
            hub = batch.column(2) if batch.num_columns > 2 else pa.array(np.zeros(len(sig), dtype=np.int64))
            for run in runs:
                root = np.full(len(sig), run + 1, dtype=np.uint64)
                for j in chosen(run + 1, 0, run + 1, t, threshold).tolist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(children(root, j, sig[:, j]).view(np.int64)), pa.array(np.full(len(sig), run, dtype=np.int32)), pa.array(np.ones(len(sig), dtype=np.int32)), batch.column(0), batch.column(1), hub],
                        names=["path", "run", "level", "sid", "sig", "hub"],
                    )

    return grow


def _root_sizes(runs: range, threshold: float, t: int):
    """A map from sets to (run, path, n): how many of a task's sets are in each child of every run's root."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {run: [] for run in runs}
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for run, parts in held.items():
                paths, n = np.unique(np.concatenate([*parts, np.zeros(0, dtype=np.uint64)]), return_counts=True)
                parts.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), run, dtype=np.int32)), pa.array(paths.view(np.int64)), pa.array(n.astype(np.int64))], names=["run", "path", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch.column(0), t)
            for run in runs:
                root = np.full(len(sig), run + 1, dtype=np.uint64)
                held[run] += [children(root, j, sig[:, j]) for j in chosen(run + 1, 0, run + 1, t, threshold).tolist()]
            rows += len(sig)
            if rows > 200_000:  # a flush of the combiner: counts are summed later all the same
                yield from flush()
                rows = 0
        yield from flush()

    return count


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[pa.RecordBatch]]]:
    """Of rows sorted by their first columns (whole numbers): each value of these, and its rows."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for s, e in zip(bounds, bounds[1:], strict=False):
            key = tuple(int(c[s]) for c in columns)
            if key != now:
                if parts:
                    yield now, parts
                now, parts = key, []
            parts.append(batch.slice(s, e - s))
    if parts:
        yield now, parts


def _found(run: int, splitter: Splitter) -> pa.RecordBatch:
    p = splitter.take()
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(p), run, dtype=np.int32)), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["run", "a", "b"])


def _split(threshold: float, t: int, kind: type[Splitter] = Splitter):
    """A map over nodes (run, path, level, sid, sig, hub; sorted by the first three) of at most LOCAL sets: candidate pairs (run, a, b)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, now = None, None
        for (run, path, level), parts in _groups(batches, 3):
            if sum(p.num_rows for p in parts) < 2:
                continue
            if run != now:
                if splitter:
                    yield _found(now, splitter)
                splitter, now = kind(threshold, t, run + 1), run
            ids, sig, hub = (np.concatenate(x) for x in zip(*((p.column(3).to_numpy(), _signatures(p.column(4), t), p.column(5).to_numpy()) for p in parts), strict=True))
            for _ in splitter.walk(ids, sig, hub, path & (1 << 64) - 1, level):
                yield _found(run, splitter)
        if splitter:
            yield _found(now, splitter)

    return work


_BLOCK = "run int, path long, level int, block int, blocks int, sid long, sig binary, hub long"


def _test_blocks(threshold: float, t: int):
    """A map over blocks of large nodes (rows of _BLOCK, sorted by the first four columns): the same rows with close.

    A block is a random part of its node, of LOCAL / 2 sets at least: the mean similarity to it stands for that to the node.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 4):
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            close = mean_match(_signatures(rows.column(6), t)) >= CLOSE * threshold
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(close)], names=[*rows.schema.names, "close"])

    return work


def _deeper(threshold: float, t: int):
    """A map over rows of large nodes (run, path, level, sid, sig, hub; sorted by the first three) to those of their children."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (run, path, level), parts in _groups(iter([batch]), 3):
                above = path & (1 << 64) - 1
                for rows in parts:
                    sig = _signatures(rows.column(4), t)
                    for j in chosen(above, level, run + 1, t, threshold).tolist():
                        paths = children(np.full(len(sig), above, dtype=np.uint64), j, sig[:, j]).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(paths), rows.column(0), pa.array(np.full(len(sig), level + 1, dtype=np.int32)), rows.column(3), rows.column(4), rows.column(5)], names=["path", "run", "level", "sid", "sig", "hub"])

    return work


def _compare_tiles(threshold: float, t: int):
    """A map over tiles (run, path, i, j, side, sid, sig, hub; sorted by the first five): candidate pairs of a set of side 0 and one of side 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (run, _, _, _), parts in _groups(batches, 4):
            side, ids, sig, hub = (np.concatenate(x) for x in zip(*((p.column(4).to_numpy(), p.column(5).to_numpy(), _signatures(p.column(6), t), p.column(7).to_numpy()) for p in parts), strict=True))
            splitter = Splitter(threshold, t, run + 1)
            mine, other = side == 0, side == 1
            for _ in splitter.compare(ids[mine], sig[mine], hub[mine], ids[other], sig[other], hub[other]):
                yield _found(run, splitter)
            yield _found(run, splitter)

    return work


def _split_large(rows: DataFrame, threshold: float, t: int, hubs: bool) -> tuple[DataFrame, DataFrame]:
    """The candidate pairs of nodes above LOCAL (rows with n, the size of their node) that brute force gives, or their hubs, and the rows of their children."""
    blocks = F.ceil(F.col("n") / LOCAL).cast("int")
    cut = rows.select("run", "path", "level", F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("block"), blocks.alias("blocks"), "sid", "sig", "hub")
    placed = cut.repartition("run", "path", "block").sortWithinPartitions("run", "path", "level", "block")
    tested = durable(placed.mapInArrow(_test_blocks(threshold, t), _BLOCK + ", close boolean"))
    below = tested.where("NOT close").select("run", "path", "level", "sid", "sig", "hub").mapInArrow(_deeper(threshold, t), _NODE)
    close = tested.where("close")
    if hubs:
        heads = close.groupBy("run", "path").agg(F.min("sid").alias("a"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT)
        return close.join(heads, ["run", "path"]).select("run", "a", F.col("sid").alias("b")), below
    hot = close.groupBy("run", "path", "block").agg(F.count(F.lit(1)).alias("rows"))
    # The close sets of block i meet all sets of block j in tile (i, j); where j comes before i, those that are close there have met them in (j, i).
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = close.select("run", "path", F.col("block").alias("i"), every.alias("j"), F.lit(0).alias("side"), "sid", "sig", "hub")
    other = tested.join(hot.select("run", "path", F.col("block").alias("i")), ["run", "path"]).where("i <= block OR NOT close").select("run", "path", "i", F.col("block").alias("j"), F.lit(1).alias("side"), "sid", "sig", "hub")
    tiles = mine.unionByName(other).repartition("run", "path", "i", "j").sortWithinPartitions("run", "path", "i", "j", "side")
    return tiles.mapInArrow(_compare_tiles(threshold, t), _FOUND), below


_FOUND = "run int, a long, b long"


def _walk(sets: DataFrame, runs: range, threshold: float, t: int, hubs: bool = False) -> DataFrame:
    """run, a, b: the candidate pairs of these runs, outside of hubs; with hubs the sets of every node's hub (b), each with the least of them (a)."""
    rows = sets.mapInArrow(_roots(runs, threshold, t), _NODE)
    sizes = sets.select("sig").mapInArrow(_root_sizes(runs, threshold, t), "run int, path long, n long")
    found = None
    # Nodes of up to HOT sets hold no hub, nor do their children.
    least = HOT if hubs else LOCAL
    while True:
        counted = durable(sizes.groupBy("run", "path").agg(F.sum("n").alias("n")).where(F.col("n") > least))
        count, large, small = counted.count(), counted.where(F.col("n") > LOCAL), rows
        if count or hubs:
            marked = rows.join(F.broadcast(counted) if count <= BROADCAST_NODES else counted, ["run", "path"], "inner" if hubs else "left")
            small = marked.where(F.col("n").isNull() | (F.col("n") <= LOCAL))
        nodes = small.select("run", "path", "level", "sid", "sig", "hub").repartition("run", "path").sortWithinPartitions("run", "path", "level")
        if count or not hubs:
            pairs = durable(nodes.mapInArrow(_split(threshold, t, HubFinder if hubs else Splitter), _FOUND))
            found = pairs if found is None else found.unionByName(pairs)
        if not count or hubs and large.isEmpty():
            return found
        tiled, below = _split_large(marked.where(F.col("n") > LOCAL), threshold, t, hubs)
        found = found.unionByName(durable(tiled))
        rows = durable(below)
        sizes = rows.select("run", "path", F.lit(1).cast("long").alias("n"))


def _candidates(sets: DataFrame, runs: range, threshold: float, t: int) -> DataFrame:
    """a, b, runs (how many of these runs found the pair)."""
    return _walk(sets, runs, threshold, t).groupBy("a", "b").agg(F.count_distinct("run").alias("runs"))


def _hubs(sets: DataFrame, threshold: float, t: int) -> DataFrame | None:
    """sid, hub (its least set) of the sets in hubs, by the nodes of the first run; None if there are none. Nodes with a set in common are one hub."""
    found = _walk(sets, range(1), threshold, t, hubs=True)
    if found is None or found.isEmpty():
        return None
    return durable(components(found.select("a", "b").distinct()).select(F.col("x").alias("sid"), F.col("label").alias("hub")).where("hub <> 0"))


#: Pairs that are verified in one go, on average; a larger cluster is verified in several.
BLOCK_PAIRS = 200_000
_CHECK = "block long, tile int, kind int, a long, b long, runs long, grams binary"


def _verify_blocks(threshold: float):
    """A map over blocks (rows sorted by block, tile, kind: the sets, then the pairs): the pairs at or above the threshold."""

    def judge(sets: dict[int, np.ndarray], pairs: list[tuple[int, int, int]]) -> list[tuple[int, int, float, int]]:
        names = {k: i for i, k in enumerate(sets)}
        lengths = np.array([len(g) for g in sets.values()], dtype=np.int64)
        values, tokens = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        mark = np.zeros(len(values), dtype=bool)
        by_a: dict[int, list[tuple[int, int]]] = {}
        for a, b, runs in pairs:
            by_a.setdefault(a, []).append((b, runs))
        out = []
        for a, others in by_a.items():
            i = names[a]
            own = tokens[starts[i] : starts[i + 1]]
            mark[own] = True
            for k in range(0, len(others), 1000):
                some = others[k : k + 1000]
                at = np.array([names[b] for b, _ in some])
                joined = np.concatenate([tokens[starts[j] : starts[j + 1]] for j in at])
                first = np.concatenate(([0], np.cumsum(lengths[at])[:-1]))
                common = np.add.reduceat(mark[joined].astype(np.int64), first)
                jaccard = common / (len(own) + lengths[at] - common)
                out += [(a, b, float(x), runs) for (b, runs), x in zip(some, jaccard, strict=True) if x >= threshold]
            mark[own] = False
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, pairs, done = None, {}, [], []

        def flush() -> pa.RecordBatch:
            rows = list(zip(*done, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["a", "b", "jaccard", "runs"])

        for batch in batches:
            for block, tile, kind, a, b, runs, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, tile) != now:
                    if pairs:
                        done += judge(sets, pairs)
                    now, sets, pairs = (block, tile), {}, []
                if kind == 0:
                    sets[a] = np.frombuffer(grams, dtype=np.uint32)
                else:
                    pairs.append((a, b, runs))
            if len(done) > 200_000:
                yield flush()
                done = []
        if pairs:
            done += judge(sets, pairs)
        yield flush()

    return work


def _grams(docs: DataFrame, sets: DataFrame, needs: DataFrame, n: int, id_col: str, text_col: str, few: bool = False) -> DataFrame:
    """sid, grams of the sets in needs (distinct sid), and it may be of some others."""
    # One document of each needed set brings its text; texts of other documents stay where they are or fall out at the join.
    source = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id")).join(needs, "sid", "left_semi")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    ids = source.select("doc_id").distinct()
    texts = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return _sets(texts, n, None, "doc_id", "text").where("sid IS NOT NULL").select("sid", "grams").dropDuplicates(["sid"])


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, threshold: float, n: int, id_col: str, text_col: str) -> DataFrame:
    """a, b, jaccard, runs of the candidate pairs that hold, by their whole sets.

    Pairs are gathered around the least set of their cluster, so that a set is sent once or twice and not once a pair.
    """
    least = F.least("a", "b").alias("m")
    label = pairs.select(F.col("a").alias("x"), least).union(pairs.select(F.col("b"), least)).groupBy("x").agg(F.min("m").alias("block"))
    placed = pairs.join(label, F.col("a") == F.col("x")).drop("x")
    # Tiles by both ends: each holds a part of the sets of either side.
    tiles = placed.groupBy("block").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / BLOCK_PAIRS)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("a"), F.col("tiles")) * F.col("tiles") + F.pmod(F.xxhash64("b"), F.col("tiles"))
    placed = durable(placed.join(tiles, "block").select("block", tile.cast("int").alias("tile"), "a", "b", "runs"))
    needs = placed.select("block", "tile", F.col("a").alias("sid")).union(placed.select("block", "tile", "b")).distinct()
    grams = _grams(docs, sets, needs.select("sid").distinct(), n, id_col, text_col)
    sent = needs.join(grams, "sid").select("block", "tile", F.lit(0).alias("kind"), F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("runs"), "grams")
    asked = placed.select("block", "tile", F.lit(1).alias("kind"), "a", "b", "runs", F.lit(None).cast("binary").alias("grams"))
    both = sent.unionByName(asked).repartition("block", "tile").sortWithinPartitions("block", "tile", "kind")
    return both.mapInArrow(_verify_blocks(threshold), "a long, b long, jaccard double, runs long")


def _hub_tiles(threshold: float, work: type):
    """A map over tiles of hubs (hub, i, j, side, sid, size, grams; sorted by the first four) to what work makes of each set and the sets near to it."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), parts in _groups(batches, 3):
            side, sids, sizes = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (3, 4, 5))
            grams = [np.frombuffer(g.as_buffer(), dtype=np.uint32) for p in parts for g in p.column(6)]
            lengths = np.array([len(g) for g in grams], dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            values, tokens = np.unique(np.concatenate(grams), return_inverse=True)
            tokens, mark = tokens.astype(np.int32), np.zeros(len(values), dtype=np.uint8)
            del grams, parts
            made, border = work(sids, sizes), int((side == 0).sum())
            for a in range(border):
                # The sets of a block meet each other once; those of two blocks all meet.
                b = a + 1 if i == j else border
                if b == len(sids):
                    break
                own = tokens[starts[a] : starts[a + 1]]
                mark[own] = 1
                common = np.add.reduceat(mark[tokens[starts[b] :]], starts[b:-1] - starts[b], dtype=np.int32)
                mark[own] = 0
                jaccard = common / (lengths[a] + lengths[b:] - common)
                near = np.flatnonzero(jaccard >= threshold)
                if len(near):
                    yield from made.add(a, b + near, jaccard[near])
            yield made.end()

    return judge


class _Links:
    """Of a tile: for each set the documents of the sets near to it (b NULL), and edges that connect what is near (links NULL)."""

    SCHEMA = "a long, b long, links long"

    def __init__(self, sids: np.ndarray, sizes: np.ndarray):
        self.sids, self.sizes = sids, sizes
        self.links, self.label = np.zeros(len(sids), dtype=np.int64), np.arange(len(sids))
        self.edges: list[tuple[int, int]] = []

    def add(self, a: int, near: np.ndarray, jaccard: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.links[a] += self.sizes[near].sum()
        self.links[near] += self.sizes[a]
        apart = near[self.label[near] != self.label[a]]
        if len(apart):
            labels, first = np.unique(self.label[apart], return_index=True)
            self.edges += [(a, b) for b in apart[first].tolist()]
            self.label[np.isin(self.label, labels)] = self.label[a]
        yield from ()

    def end(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.links)
        a, b = self.sids[np.array(self.edges, dtype=np.int64).reshape(-1, 2)].T
        none = pa.nulls(len(some), pa.int64()), pa.nulls(len(a), pa.int64())
        columns = ((pa.array(self.sids[some]), pa.array(a)), (none[0], pa.array(b)), (pa.array(self.links[some]), none[1]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["a", "b", "links"])


class _Pairs:
    """Of a tile: the pairs, lower first."""

    SCHEMA = "a long, b long, jaccard double"

    def __init__(self, sids: np.ndarray, sizes: np.ndarray):
        self.sids, self.held, self.parts = sids, 0, []

    def add(self, a: int, near: np.ndarray, jaccard: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = self.sids[a], self.sids[near]
        self.parts.append((np.minimum(x, y), np.maximum(x, y), jaccard))
        self.held += len(near)
        if self.held > FLUSH:
            yield self.end()

    def end(self) -> pa.RecordBatch:
        empty = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        columns = [pa.array(np.concatenate(c)) for c in zip(empty, *self.parts, strict=True)]
        self.held, self.parts = 0, []
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "jaccard"])


def _within(hubs: DataFrame, threshold: float, work: type, sizes: DataFrame | None = None) -> DataFrame:
    """What work makes of the pairs within hubs (hub, sid, grams), every two sets compared once; sizes: sid, size (documents of a set)."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / HUB_SETS, F.sum(F.length("grams")) / (4 * HUB_GRAMS))).cast("int")
    counted = hubs.groupBy("hub").agg(blocks.alias("blocks"))
    if sizes is not None:
        hubs = hubs.join(sizes, "sid")
    cut = hubs.join(counted, "hub").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
    size = F.lit(1) if sizes is None else F.col("size")
    tiles = cut.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), "sid", size.cast("long").alias("size"), "grams")
    placed = tiles.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side")
    return placed.mapInArrow(_hub_tiles(threshold, work), work.SCHEMA)


def estimated_recall(once: int, twice: int, found: int) -> float:
    """The share of all pairs found so far, from how many of them one run and two runs found (Chao's estimate of the unseen)."""
    unseen = once * (once - 1) / (2 * (twice + 1))
    return found / (found + unseen) if found else 1.0


def _join(docs: DataFrame, n: int, threshold: float, recall: float, t: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The sets (doc_id, sid, sig), the pairs of sets (a, b, jaccard) but for those within hubs, and the hubs (hub, sid, grams; None if there are none)."""
    sets = durable(_sets(docs, n, t, id_col, text_col))
    distinct = durable(sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min("sig").alias("sig")))
    hubs = _hubs(distinct, threshold, t)
    if hubs is not None:
        distinct = durable(distinct.join(hubs, "sid", "left").select("sid", "sig", F.coalesce("hub", F.lit(0).cast("long")).alias("hub")))
        hubs = durable(hubs.join(_grams(docs, sets, hubs.select("sid"), n, id_col, text_col, hubs.count() <= BROADCAST_IDS), "sid").select("hub", "sid", "grams"))
    found, first = None, 0
    while True:
        pairs = durable(_candidates(distinct, range(first, first + RUNS), threshold, t))
        first += RUNS
        if found is None:
            found = durable(_verified(docs, sets, pairs, threshold, n, id_col, text_col))
        else:
            known = found.join(pairs.withColumnRenamed("runs", "more"), ["a", "b"], "left").select("a", "b", "jaccard", (F.col("runs") + F.coalesce("more", F.lit(0).cast("long"))).alias("runs"))
            fresh = durable(pairs.join(found, ["a", "b"], "left_anti"))
            found = durable(known.unionByName(_verified(docs, sets, fresh, threshold, n, id_col, text_col)))
        # One cluster of easy pairs must not hide that those at the threshold are still short: both parts have to reach the recall. Pairs within hubs, which are complete, don't count.
        edge = F.col("jaccard") < threshold + MARGIN
        seen = found.agg(*[F.count_if(part & runs) for part in (edge, ~edge) for runs in (F.col("runs") == 1, F.col("runs") == 2, F.lit(True))]).first()
        if min(estimated_recall(*seen[:3]), estimated_recall(*seen[3:])) >= recall:
            return sets, found.select("a", "b", "jaccard"), hubs


def near_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, t: int = T, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id_a, doc_id_b, jaccard, ids_a, ids_b: every row says that any document of ids_a and any other of ids_b are near duplicates.

    For those who need the pairs themselves: a cluster of near copies has as many rows as pairs of different sets. Documents with equal sets
    stand in one list (ids_a = ids_b for a row of equal sets, jaccard 1), so that copies are not multiplied out; doc_id_a and doc_id_b are
    a pair of the row. near_classes has a row per document instead. Words are runs of letters and digits in any case; whole texts count, however long.
    Defined cases: rows with a NULL id or text, and texts without words, are near to nothing; repeated rows are one document; an id
    with several texts stands for each of them, and may be paired with itself; a similarity equal to the threshold counts; other columns
    are ignored; no rows give no rows. Sets with equal 64-bit hashes are taken for equal.
    """
    sets, pairs, hubs = _join(docs, n, threshold, recall, t, id_col, text_col)
    if hubs is not None:
        pairs = pairs.unionByName(_within(hubs, threshold, _Pairs))
    groups = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    same = groups.where(F.size("ids") > 1).select(F.element_at("ids", 1).alias("doc_id_a"), F.element_at("ids", 2).alias("doc_id_b"), F.lit(1.0).alias("jaccard"), F.col("ids").alias("ids_a"), F.col("ids").alias("ids_b"))
    a, b = groups.select(F.col("sid").alias("a"), F.col("ids").alias("ids_a")), groups.select(F.col("sid").alias("b"), F.col("ids").alias("ids_b"))
    near = pairs.join(a, "a").join(b, "b")
    swap = F.element_at("ids_a", 1) <= F.element_at("ids_b", 1)
    first, second = F.when(swap, F.col("ids_a")).otherwise(F.col("ids_b")), F.when(swap, F.col("ids_b")).otherwise(F.col("ids_a"))
    return near.select(F.element_at(first, 1).alias("doc_id_a"), F.element_at(second, 1).alias("doc_id_b"), "jaccard", first.alias("ids_a"), second.alias("ids_b")).unionByName(same)


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, t: int = T, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links: one row per document, with its class and how many other documents are near to it.

    A class is a connected component of the pairs of near_pairs, and class_id the least id in it; a document that is near to none is its own
    class with no links. n_links counts documents of any class member whose similarity is at least the threshold, copies each for itself.
    Defined cases: a NULL id has a NULL class and no links; a NULL text, or one without words, is near to nothing, copies of it too; repeated rows
    (one id, one set of n-grams) are one row; an id with several texts has a row for each, which may be linked with each other; a similarity equal to the
    threshold counts; very long texts count whole; other columns are ignored, whatever their names; no rows give no rows.
    """
    sets, pairs, hubs = _join(docs, n, threshold, recall, t, id_col, text_col)
    members = durable(sets.where("sid IS NOT NULL").groupBy("sid", "doc_id").agg(F.lit(1).alias("one")).select("sid", "doc_id"))
    classes = durable(members.groupBy("sid").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least")))
    # Links of a set: the other members of its own class of equal sets, and all members of the sets near to it.
    ends = pairs.select(F.col("a").alias("sid"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    beyond = ends.join(classes.select(F.col("sid").alias("other"), "size"), "other").groupBy("sid").agg(F.sum("size").alias("beyond"))
    edges = pairs.select("a", "b")
    if hubs is not None:
        within = durable(_within(hubs, threshold, _Links, classes.select("sid", "size")))
        beyond = beyond.unionByName(within.where("b IS NULL").select(F.col("a").alias("sid"), F.col("links").alias("beyond"))).groupBy("sid").agg(F.sum("beyond").alias("beyond"))
        edges = edges.unionByName(within.where("b IS NOT NULL").select("a", "b"))
    labelled = classes.join(components(edges).withColumnRenamed("x", "sid"), "sid", "left").select("sid", "size", "least", F.coalesce("label", "sid").alias("label"))
    heads = labelled.groupBy("label").agg(F.min("least").alias("class_id"))
    by_set = labelled.join(heads, "label").join(beyond, "sid", "left").select("sid", "class_id", (F.col("size") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    bare = sets.where("sid IS NULL").select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return members.join(by_set, "sid").select("doc_id", "class_id", "n_links").unionByName(bare)


def components(edges: DataFrame) -> DataFrame:
    """x, label: for every end of the edges (a, b) the least node of its connected component."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).toDF("x", "y"))
    labels = durable(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("label")))
    while True:
        # Each node takes the least label around it, then that label's own label.
        near = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("m"))
        stepped = labels.join(near, "x").select("x", "label", F.least("label", "m").alias("m"))
        jump = labels.select(F.col("x").alias("m"), F.col("label").alias("far"))
        new = durable(stepped.join(jump, "m", "left").select("x", "label", F.least("m", F.coalesce("far", F.col("m"))).alias("new")))
        moved = not new.where("new <> label").isEmpty()
        labels = new.select("x", F.col("new").alias("label"))
        if not moved:
            return labels


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, t: int = T, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, that of the least id, of each group of near duplicates (pairs of near_pairs, taken transitively).

    Defined cases: rows with a NULL id, a NULL text or one without words stay, also repeated ones; of other repeated rows one stays; among
    texts of one least id, the one with the least hash of its set stays (an id with several texts is treated text by text); very long texts count
    whole; all columns are returned as they are, whatever their names; no rows give no rows.
    """
    sets, pairs, hubs = _join(docs, n, threshold, recall, t, id_col, text_col)
    sets, edges = sets.where("sid IS NOT NULL"), pairs.select("a", "b")
    if hubs is not None:
        edges = edges.unionByName(durable(_within(hubs, threshold, _Links).where("b IS NOT NULL").select("a", "b")))
    labels = components(edges)
    grouped = sets.select("doc_id", "sid").join(labels, F.col("sid") == F.col("x"), "left").select("doc_id", "sid", F.coalesce("label", "sid").alias("label"))
    winners = grouped.groupBy("label").agg(F.min(F.struct("doc_id", "sid")).alias("w"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    judged = durable(grouped.join(winners, "label").select("doc_id", "sid", (F.struct("doc_id", "sid") == F.col("w")).alias("wins")))
    repeated = durable(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    plain = judged.where("NOT wins").select("doc_id").join(repeated, "doc_id", "left_anti")

    key, sid = unused(docs, "__id"), unused(docs, "__sid")
    number = F.col(f"`{id_col}`").cast("long")

    def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
        # No hint: the list of ids grows with the corpus. Spark broadcasts it if it measures that it is small; else the rows are joined by one shuffle.
        return rows.join(ids.select(F.col("doc_id").alias(key)).distinct(), number == F.col(key), "left_anti")

    if repeated.isEmpty():
        return without(docs, durable(plain))
    # Rows that share an id are told apart by their sets.
    once = without(docs, durable(plain.union(repeated)))
    several = docs.join(repeated.select(F.col("doc_id").alias(key)), number == F.col(key), "left_semi")

    @F.pandas_udf("long")
    def sid_of(texts: pd.Series) -> pd.Series:
        found = [shingles(x, n) if x else np.zeros(0) for x in texts]
        return pd.Series([set_hash(g) if len(g) else None for g in found], dtype="Int64")

    marked = several.withColumn(sid, sid_of(F.col(f"`{text_col}`").cast("string")))
    bare = marked.where(F.col(sid).isNull()).drop(sid)
    won, lost = (judged.where(c).select(F.col("doc_id").alias(key), F.col("sid").alias(sid)).distinct() for c in ("wins", "NOT wins"))
    lost = lost.join(won, [key, sid], "left_anti").select(key, F.col(sid).alias(sid + "_"))
    kept = marked.where(F.col(sid).isNotNull()).join(lost, (number == F.col(key)) & (F.col(sid) == F.col(sid + "_")), "left_anti")
    return once.unionByName(kept.dropDuplicates([id_col, sid]).drop(sid)).unionByName(bare)
