"""Near-duplicate detection by SimHash, with candidates from a pigeonring filter.

A 64-bit fingerprint is cut into a ring of four 16-bit segments. Where two
fingerprints differ in at most two bits, the pigeonring principle says more than the
pigeonhole principle: from some segment on, every chain of j consecutive segments
has at most floor(j * 2 / 4) differences, for j = 1 to 4. The first segment of that
chain is then equal (budget 0), and of the next two one is equal as well (budget 1).
So a pair has an equal pair of segments, of which there are six: these are the 32-bit
keys that bring candidates together. A candidate's chains are checked against their
budgets before its whole Hamming distance.

Equal fingerprints are collapsed first. Keys held by more than ``bucket`` different
fingerprints don't go by pairs: there, each fingerprint is sent to the points at most
one bit away. Two fingerprints differ in at most two bits exactly if they share such
a point, and no point has more than 65 fingerprints, so links run to the least one of
a point and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.graph import components
from palimpsest.llm.workers import lean
from palimpsest.operators.skew import hot_left_join
from palimpsest.sources.scratch import Scratch

BITS, SEGMENTS, WIDTH, DISTANCE, BUCKET = 64, 4, 16, 2, 128
BUDGETS = [j * DISTANCE // SEGMENTS for j in range(1, SEGMENTS + 1)]
PAIRS = list(combinations(range(SEGMENTS), 2))


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text; 0 where it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    bits = np.unpackbits(_hashes(words, shingle).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    n, ones = len(bits), np.zeros(BITS, np.int64)
    for at in range(0, n, 255):
        ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@lean
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fps = np.fromiter((simhash(x.as_py() or b"") for x in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])


def in_chain(x: np.ndarray) -> np.ndarray:
    """Which differences (XOR of two fingerprints) have a chain within its budgets from some segment of the ring."""
    d = np.stack([np.bitwise_count((x >> np.uint64(BITS - WIDTH * (s + 1))) & np.uint64(0xFFFF)).astype(np.uint8) for s in range(SEGMENTS)])
    found = np.zeros(len(x), bool)
    for start in range(SEGMENTS):
        ok, sum_ = np.ones(len(x), bool), np.zeros(len(x), np.uint8)
        for j, budget in enumerate(BUDGETS):
            sum_ = sum_ + d[(start + j) % SEGMENTS]
            ok &= sum_ <= budget
        found |= ok
    return found


def links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: links that join what is within the distance in a key's run, a forest per run."""
    n, shift = len(keys), 1
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    while shift < n:
        same = keys[:-shift] == keys[shift:]
        if not same.any():
            break
        at = np.flatnonzero(same)
        x = fps[at] ^ fps[at + shift]
        chain = in_chain(x)
        at, x = at[chain], x[chain]
        at = at[np.bitwise_count(x) <= DISTANCE]
        u.append(at)
        v.append(at + shift)
        shift += 1
    if not u:
        return fps[:0], fps[:0]
    a, b = np.concatenate(u).tolist(), np.concatenate(v).tolist()
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.get(i, i) != i:
            parent[i] = parent.get(parent[i], parent[i])
            i = parent[i]
        return i

    kept = []
    for i, j in zip(a, b):
        i_, j_ = root(i), root(j)
        if i_ != j_:
            parent[max(i_, j_)] = min(i_, j_)
            kept.append((i, j))
    w = np.array(kept, np.int64).reshape(-1, 2)
    return fps[w[:, 0]], fps[w[:, 1]]


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within the runs of equal keys of a partition sorted by key; a run may go on in the next frame."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for frame in frames:
        keys = np.concatenate([keys, frame["key"].to_numpy(np.int64)])
        fps = np.concatenate([fps, frame["fp"].to_numpy(np.int64).view(np.uint64)])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        u, v = links_of(keys[:cut], fps[:cut])
        yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})
        keys, fps = keys[cut:], fps[cut:]
    u, v = links_of(keys, fps)
    yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def fingerprint_links(fps: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links whose components are those of all pairs of ``fps`` (distinct fp: long) within the distance."""
    segment = [F.shiftrightunsigned("fp", BITS - WIDTH * (s + 1)).bitwiseAND(F.lit(0xFFFF)) for s in range(SEGMENTS)]
    key = [F.lit(i << 32).cast("long") + F.shiftleft(segment[a], WIDTH) + segment[b] for i, (a, b) in enumerate(PAIRS)]
    keyed = fps.select("fp", F.explode(F.array(*key)).alias("key"))
    shared = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    total = len(PAIRS) * fps.count()
    keyed = scratch.keep(hot_left_join(keyed, shared, ["key"], "n", total, F.col("fp")).filter("n is not null"), "keyed")
    pairs = keyed.filter(F.col("n") <= bucket).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    pairs = pairs.mapInPandas(_verified, "u long, v long")
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), b)) for b in range(BITS)))
    points = keyed.filter(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(near).alias("point"))
    points = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    stars = points.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v")
    return scratch.keep(pairs.unionByName(stars).distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the least
    doc_id that links reach. A null or empty text, or one of white space, has fingerprint
    zero and links like any other. A row with a null id gets its component's id, which
    is null where no member has one. Rows that repeat an id give a row each. Other columns
    of ``docs`` are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")
    each = scratch.keep(each, "each")
    fps = scratch.keep(each.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "fps")
    roots = components(fingerprint_links(fps.select("fp"), scratch, bucket), scratch)
    labelled = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    labelled = scratch.keep(labelled, "labelled")
    of_root = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    by_fp = hot_left_join(labelled, of_root, ["root"], "members", fps.count(), F.col("fp")).select("fp", "n", "component_id")
    out = hot_left_join(each, by_fp, ["fp"], "n", each.count(), F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similar texts -------------------------------------------------------------------------
#
# Texts are alike if the Jaccard likeness of their sets of five-word shingles is 0.8 or more.
# Fingerprints and the ring bring the first candidates: texts whose SimHash differs in two
# bits at most. Fillers can give texts that aren't alike one fingerprint, so the sets are
# compared. Two bits of 64 find texts that are nearly the same only, and at 0.8 no Hamming
# search is exact, so the rest comes from prefix filtering, which loses no pair: order all
# shingles the rarest first; sets x and y that are alike by t share a shingle within the first
# |x| - ceil(t |x|) + 1 of x and the same of y. Shingles of one set only come first and
# meet nothing, so most texts drop out there. Of what meets, sizes and positions bound the
# likeness; then the sets themselves are compared. Only confirmed links are ever thinned.
#
# Equal sets are one node, named by a 64-bit hash of the set. The many (shingle, node)
# entries travel as bytes of arrays, a row for each slice of texts and part of the range
# of hashes, since a row for each would cost several times as much.
#
# No task gathers what a large share of the texts holds. Any order of shingles that all
# texts agree on will do, so shingles that very many texts hold (which a summary of
# frequent items finds on the way) are all put last, need no count, and travel to their
# nodes straight away. Of a text in very many copies one row is spread. Keys that very
# many nodes hold are cut into runs by a salt.

SHINGLE, SIMILARITY, BLOCK, PART, RUN, CHUNK = 5, 0.8, 512, 1 << 20, 1 << 16, 1 << 13
HOT_ROWS, HOT_SHARE, COUNTERS, LISTED = 1024, 0.005, 1 << 16, 1 << 16
_SLACK = 1e-9  # bounds err on the side of comparing


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of the shingles of a list of words; of the whole list if it is shorter."""
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[min(shingle, len(words)) - 1 :])]), ">u8").astype(np.uint64)


def _set(text: bytes | None) -> tuple[int, np.ndarray]:
    """The node of a text and its distinct shingles."""
    words = (text or b"").lower().split()
    own = np.unique(_hashes(words, SHINGLE)) if words else np.zeros(0, np.uint64)
    return xxhash.xxh64_intdigest(own.tobytes(), 7), own


def _sets(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
    return [_set(x.as_py()) for x in batch.column(1).cast(pa.binary())]


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


class Frequent:
    """A summary of the most frequent items of a stream in a fixed number of counters; counts err below by n / counters at most."""

    def __init__(self, counters: int = COUNTERS):
        self.counters = counters
        self.items, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, items: np.ndarray) -> None:
        new, counts = np.unique(items, return_counts=True)
        both, at = np.unique(np.concatenate([self.items, new]), return_inverse=True)
        total = np.bincount(at, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
        if len(both) > self.counters:
            total -= np.partition(total, len(total) - self.counters - 1)[len(total) - self.counters - 1]
        self.items, self.counts = both[total > 0], total[total > 0]


@lean
def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, size, fp) of each text; then, with sizes below zero, frequent shingles and in how many of the task's texts they are."""
    names, frequent, rows = ["doc_id", "node", "size", "fp"], Frequent(), 0
    for batch in batches:
        sets = _sets(batch)
        if sets:
            frequent.add(np.concatenate([s for _, s in sets]))
            rows += len(sets)
        fps = [simhash(x.as_py() or b"") for x in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), _longs([n for n, _ in sets]), pa.array([len(s) for _, s in sets], pa.int64()), _longs(fps)], names)
    often = frequent.counts >= max(2, 0.4 * HOT_SHARE * rows)
    items = frequent.items[often].view(np.int64)
    nulls = pa.nulls(len(items), pa.int64())
    yield pa.RecordBatch.from_arrays([nulls, pa.array(items), pa.array(-frequent.counts[often]), nulls], names)


@lean
def _node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = dict(_sets(batch))
        yield pa.RecordBatch.from_arrays([_longs(list(sets)), pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64()))], ["node", "shingles"])


PARTS = "part long, shingle binary, node binary, n binary"


def _scatter(by: np.ndarray, bits: int, shingle: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each part of the range of ``by`` (its ``bits`` highest bits) with the entries that belong there."""
    part = (by >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(starts[1:], len(part))
    columns = [[c[s:e].tobytes() for s, e in zip(starts, ends)] for c in (shingle[order], node[order], n[order])]
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), *(pa.array(c, pa.binary()) for c in columns)], ["part", "shingle", "node", "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries (shingle, node, n) of each part, from rows sorted by part."""
    part, held = None, ([], [], [])

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(b"".join(h), t) for h, t in zip(held, (np.uint64, np.uint64, np.uint32)))

    for batch in batches:
        for at, p in enumerate(batch.column(0).to_pylist()):
            if p != part and part is not None:
                yield whole()
                held = ([], [], [])
            part = p
            for h, column in zip(held, batch.columns[1:]):
                h.append(column[at].as_py())
    if part is not None:
        yield whole()


_LAST = np.uint32(0xFFFFFFFF)  # the count of shingles that are put last


def _spread(bits: int, hot: np.ndarray, copied: dict[int, int]):
    """Texts to entries by shingle; of shingles in ``hot`` (sorted) to entries by node; of ``copied`` nodes only the row with the id given."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {n: s for i, (n, s) in zip(batch.column(0).to_pylist(), _sets(batch)) if copied.get(n, i) == i}
            sizes = [len(s) for s in sets.values()]
            if sum(sizes):
                shingle = np.concatenate(list(sets.values()))
                node = np.repeat(np.array(list(sets), np.uint64), sizes)
                last = np.isin(shingle, hot)
                if not last.all():
                    yield _scatter(shingle[~last], bits, shingle[~last], node[~last], np.zeros((int((~last).sum()), 0), np.uint32))  # n comes later
                if last.any():
                    yield _scatter(node[last], bits, shingle[last], node[last], np.full(int(last.sum()), _LAST))

    return run


def _shared(bits: int):
    """Entries by shingle to entries by node, of shingles that several nodes hold, with their number; those with a number pass."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []

        def without_number() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbered = pc.greater(pc.binary_length(batch.column(3)), 0)
                ready.append(batch.filter(numbered))
                yield batch.filter(pc.invert(numbered))

        for shingle, node, _ in _gather(without_number()):
            yield from (b for b in ready if b.num_rows)
            ready.clear()
            order = np.lexsort((node, shingle))
            shingle, node = shingle[order], node[order]
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
            shingle, node = shingle[new], node[new]
            starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
            n = np.diff(np.append(starts, len(shingle)))
            n = np.repeat(np.minimum(n, int(_LAST) - 1), n).astype(np.uint32)
            if (n > 1).any():
                yield _scatter(node[n > 1], bits, shingle[n > 1], node[n > 1], n[n > 1])
        yield from (b for b in ready if b.num_rows)

    return run


def _sized(bits: int):
    """Nodes to entries with n = 0 that hold the size in place of a shingle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            if len(node):
                yield _scatter(node, bits, size, node, np.zeros(len(node), np.uint32))

    return run


def _prefixes(similarity: float):
    """Entries by node to those of prefixes: (key: shingle, node, size, at: its place among the set's, the rarest first)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, node, n in _gather(batches):
            order = np.lexsort((shingle, n, node))
            shingle, node, n = shingle[order], node[order], n[order]
            new = np.ones(len(n), bool)  # copies that were spread in other slices
            new[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])
            shingle, node, n = shingle[new], node[new], n[new]
            starts = np.flatnonzero(n == 0)  # a node's size comes first
            count = np.diff(np.append(starts, len(n)))
            size = np.repeat(shingle[starts].astype(np.int64), count)
            place = np.arange(len(n)) - np.repeat(starts, count) - 1
            at = size - np.repeat(count - 1, count) + place  # after those that no other set has
            keep = (n > 0) & (at < size - np.ceil(similarity * size - _SLACK) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(shingle[keep].view(np.int64)), pa.array(node[keep].view(np.int64)), pa.array(size[keep]), pa.array(at[keep])], ["key", "node", "size", "at"])

    return run


def _may_be_alike(size: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets that share a shingle, none before it, can reach the likeness by their sizes and what is left of them."""
    both = np.minimum(size[i] - at[i], size[j] - at[j])
    long = np.maximum(size[i], size[j])
    return (np.minimum(size[i], size[j]) >= similarity * long - _SLACK) & (both * (1 + similarity) >= similarity * (size[i] + size[j]) - _SLACK)


def _pairs_of(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    w = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1])], ["u", "v"])


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first ``by`` of them, cut between runs of equal values there; the run's number is put in front."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy() for c in batch.columns]
        cols = new if held is None else [np.concatenate(p) for p in zip(held, new)]
        if not len(cols[0]):
            continue
        change = np.zeros(len(cols[0]), bool)
        for c in cols[:by]:
            change[1:] |= c[1:] != c[:-1]
        run = np.cumsum(change)
        cut = int(np.searchsorted(run, run[-1]))
        if cut:
            yield [run[:cut], *(c[:cut] for c in cols)]
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield [np.zeros(len(held[0]), np.int64), *held]


def _first_pairs(similarity: float):
    """Of each run of (key, salt), sorted by size: each row with the one before and with the run's first."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None  # first and latest row of a run that may go on
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            if last is not None:
                cols = [np.concatenate(p) for p in zip(last, cols)]
            key, salt, node, size, at = cols
            starts = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            first = np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))
            j = np.flatnonzero(~starts)
            i, j = np.concatenate([first[j], j - 1]), np.concatenate([j, j])
            ok = (node[i] != node[j]) & _may_be_alike(size, at, i, j, similarity)
            yield _pairs_of(node, i[ok], j[ok])
            last = [c[[first[-1], len(key) - 1]] for c in cols]

    return run


def _all_pairs(similarity: float):
    """Of each run of (key, home, chunk): pairs of different groups.

    Rows of the block that is at home come first, and each is compared with those after
    it; with one another in the first chunk only. Guests are rows of smaller groups from
    other blocks; two rows of smaller groups meet in the lower block of theirs.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, home, chunk, guest, node, size, at, label, minor, block in _runs(batches, 3):
            i = np.flatnonzero(guest == 0)
            shift, u, v, held = 1, [], [], 0
            while True:
                i = i[i + shift < len(node)]
                i = i[number[i] == number[i + shift]]
                if not len(i):
                    break
                j = i + shift
                here = np.where(guest[j] == 0, chunk[i] == 0, (minor[i] == 0) | (home[i] < block[j]))
                ok = here & (label[i] != label[j]) & _may_be_alike(size, at, i, j, similarity)
                u.append(i[ok])
                v.append(j[ok])
                held, shift = held + int(ok.sum()), shift + 1
                if held > PART:
                    yield _pairs_of(node, np.concatenate(u), np.concatenate(v))
                    u, v, held = [], [], 0
            if held:
                yield _pairs_of(node, np.concatenate(u), np.concatenate(v))

    return run


def _runs_of_keys(prefix: DataFrame, held: DataFrame, run: int) -> DataFrame:
    """(key, salt, node, size, at): the rows of a key in runs of about ``run`` at most; a key's first rows of its runs are one more."""
    plain = prefix.select("key", F.lit(0).alias("salt"), "node", "size", "at")
    large = held.filter(F.col("n") > run)
    if large.isEmpty():
        return plain
    rows = hot_left_join(prefix, large, ["key"], "n", prefix.count(), F.col("node"))
    salted = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / run)), F.lit(0)).cast("int"))
    first = salted.filter("n is not null").groupBy("key", "salt").agg(F.min(F.struct("size", "node", "at")).alias("f"))
    return salted.select(*plain.columns).unionByName(first.select("key", F.lit(-1).alias("salt"), "f.node", "f.size", "f.at"))


def ring_pairs(marked: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, run: int = RUN, bucket: int = BUCKET) -> DataFrame:
    """(u, v): pairs of nodes whose fingerprints are within the distance, to be compared; ``marked`` are distinct (fp, node, size).

    For each link of the ring the smallest nodes of its two fingerprints; of the nodes with
    one fingerprint, by size, each with the one before and with the first.
    """
    fps = scratch.keep(marked.groupBy("fp").agg(F.min(F.struct("size", "node")).alias("least"), F.count("*").alias("n")), "fps")
    links = fingerprint_links(fps.select("fp"), scratch, bucket)
    for end in ("u", "v"):
        links = links.join(fps.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_least")), end)
    sizes = F.col("u_least.size"), F.col("v_least.size")
    links = links.filter(F.least(*sizes) + _SLACK >= similarity * F.greatest(*sizes)).select(*(f(F.col("u_least.node"), F.col("v_least.node")).alias(c) for c, f in (("u", F.least), ("v", F.greatest))))
    several = fps.filter("n > 1").select(F.col("fp").alias("key"), "n")
    rows = marked.select(F.col("fp").alias("key"), "node", "size", F.lit(0).cast("long").alias("at"))
    rows = hot_left_join(rows, several, ["key"], "n", marked.count(), F.col("node")).filter("n is not null").drop("n")
    equal = _runs_of_keys(rows, several, run).repartition("key", "salt").sortWithinPartitions("key", "salt", "size", "node").mapInArrow(_first_pairs(similarity), "u long, v long")
    pairs = scratch.keep(links.filter("u <> v").unionByName(equal).distinct(), "pairs")
    scratch.drop("fps", "keys", "keyed", "links")
    return pairs


def similar_links(texts: DataFrame, nodes: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, block: int = BLOCK, frequent: DataFrame | None = None, hot: int = HOT_ROWS, run: int = RUN, close: DataFrame | None = None) -> DataFrame:
    """(u, v): links between nodes whose sets are alike; their components are those of all such pairs.

    ``texts`` are (doc_id, text), ``nodes`` their (node, id, size, n: copies), ``frequent``
    (shingle, n), ``close`` pairs (u, v) to compare besides. First those are, and each node
    of a key with two others, which links most of a family; then, between what is still apart, all pairs of all keys are: those of a
    key's largest group are spread over blocks, and only rows of its other groups visit
    every block. Shingles that more than ``hot`` and a share of the texts hold are put
    last, at most ``LISTED`` of them; so many nodes with most copies are spread from one row.
    """
    total, rows = nodes.agg(F.sum("size"), F.sum("n")).first()
    total, rows = total or 0, rows or 0
    bits = max(6, (total // PART).bit_length())
    often = frequent.filter(F.col("n") >= max(hot, HOT_SHARE * rows)).orderBy(F.desc("n"), "shingle").limit(LISTED).collect() if frequent is not None else []
    hot_shingles = np.sort(np.array([r["shingle"] for r in often], np.int64).view(np.uint64))
    copied = nodes.filter(F.col("n") > max(7, rows // LISTED)).orderBy(F.desc("n"), "node").limit(LISTED).select("node", "id").collect()
    copied = {r["node"] % (1 << 64): r["id"] for r in copied}
    entries = texts.mapInArrow(_spread(bits, hot_shingles, copied), PARTS).repartition("part").sortWithinPartitions("part")
    by_node = scratch.keep(entries.mapInArrow(_shared(bits), PARTS).unionByName(nodes.filter("size > 0").select("node", "size").mapInArrow(_sized(bits), PARTS)), "entries")
    scratch.sweep()
    prefix = by_node.repartition("part").sortWithinPartitions("part").mapInArrow(_prefixes(similarity), "key long, node long, size long, at long")
    prefix = scratch.keep(prefix, "prefix")
    scratch.drop("entries")
    scratch.sweep()

    held = scratch.keep(prefix.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "held")
    pairs = _runs_of_keys(prefix, held, run).repartition("key", "salt").sortWithinPartitions("key", "salt", "size", "node").mapInArrow(_first_pairs(similarity), "u long, v long")
    met = prefix.join(held, "key", "left_semi").select("node")
    if close is not None:
        pairs = pairs.unionByName(close)
        met = met.unionByName(close.select(F.explode(F.array("u", "v")).alias("node")))
    pairs, met = scratch.keep(pairs.distinct(), "pairs1"), met.distinct()
    ids = nodes.join(met, "node", "left_semi").select("id")
    sets = texts.join(ids, texts["doc_id"] == ids["id"], "left_semi").select("doc_id", "text").mapInArrow(_node_sets, "node long, shingles array<bigint>")
    sets = scratch.keep(sets.dropDuplicates(["node"]), "sets")
    scratch.sweep()

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
        common = F.size(F.array_intersect("a", "b"))
        return both.filter(common + _SLACK >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")

    links = scratch.keep(confirmed(pairs), "links1")
    scratch.drop("pairs1")
    scratch.sweep()
    roots = components(links, Scratch(texts.sparkSession, "similar-first"))
    labels = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"))
    labelled = scratch.keep(prefix.join(labels, "node"), "labelled")
    groups = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    apart = groups.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    apart = scratch.keep(apart.select("key", "n", F.col("top.label").alias("largest"), (F.col("n") - F.col("top.c")).alias("others")), "apart")
    rows = hot_left_join(labelled, apart, ["key"], "n", labelled.count(), F.col("node")).filter("n is not null")
    blocks, chunks = F.ceil(F.col("n") / block), F.ceil(F.col("others") / CHUNK)
    rows = rows.withColumn("minor", (F.col("label") != F.col("largest")).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    whole = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    columns = ["node", "size", "at", "label", "minor", "block"]
    home = rows.select("key", F.col("block").alias("home"), F.explode(whole(chunks)).alias("chunk"), F.lit(0).alias("guest"), *columns)
    guests = rows.filter("minor = 1").select("key", F.explode(whole(blocks)).alias("home"), F.pmod(F.xxhash64(F.lit(1), "node"), chunks).alias("chunk"), F.lit(1).alias("guest"), *columns).filter("home <> block")
    placed = home.unionByName(guests).repartition("key", "home", "chunk").sortWithinPartitions("key", "home", "chunk", "guest", "size", "node")
    rest = placed.mapInArrow(_all_pairs(similarity), "u long, v long")
    rest = scratch.keep(rest.distinct(), "pairs2")
    scratch.drop("labelled", "prefix")
    return scratch.keep(links.unionByName(confirmed(rest)), "links")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK, hot: int = HOT_ROWS, run: int = RUN) -> DataFrame:
    """(doc_id, component_id) of documents that are like another: their sets of five-word shingles by ``similarity`` or more.

    Every such pair is linked: those with fingerprints within the distance by the ring, the
    others by shared shingles. Rows without an id are left out. ``component_id`` is the least
    doc_id that links reach.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    told = scratch.keep(texts.mapInArrow(_nodes, "doc_id long, node long, size long, fp long"), "each")
    each = told.filter("size >= 0")
    frequent = told.filter("size < 0").groupBy(F.col("node").alias("shingle")).agg(F.sum(-F.col("size")).alias("n"))
    nodes = scratch.keep(each.groupBy("node").agg(F.min("doc_id").alias("id"), F.max("size").alias("size"), F.count("*").alias("n")), "nodes")
    marked = scratch.keep(each.filter("size > 0").select("fp", "node", "size").distinct(), "marked")
    close = ring_pairs(marked, Scratch(docs.sparkSession, "similar-ring"), similarity, run)
    roots = components(similar_links(texts, nodes, scratch, similarity, block, frequent, hot, run, close), scratch)
    group = scratch.keep(nodes.join(roots, "node", "left").select("node", "id", "n", F.coalesce("root", "node").alias("root")), "groups")
    least = group.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("members"))
    group = hot_left_join(group, least, ["root"], "members", nodes.count(), F.col("node")).select("node", "n", "component_id")
    out = hot_left_join(each.select("doc_id", "node"), group, ["node"], "n", each.count(), F.col("doc_id"))
    return out.select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` but for those that are like one with a smaller id (or linked to one); rows without an id stay.

    Rows that repeat an id stay or go together.
    """
    gone = similar_groups(docs, id_col, text_col, similarity).filter("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
