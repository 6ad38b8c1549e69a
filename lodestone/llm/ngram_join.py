"""N-gram Jaccard self-join by PartEnum signatures.

Two documents link when their sets of word shingles have a Jaccard similarity of
at least ``PERCENT`` %. Equal sets are one node from the start. For the rest:

Signatures. Sizes are cut into bands so that sets that can link are in one band
or in neighbouring ones. For each pair of bands a bound ``k`` on the number of
features in which two linking sets differ is known. The feature domain is cut
into parts, one more than k / 2 and some spare, so that two linking sets differ
by one feature at most in some part; each part is cut in three cells, and every
two of three cells are hashed to a signature. Linking sets share one. Where k is
2 or less, each feature is a part of its own, and the subsets that leave out up
to k of them are the signatures. Signatures of very few features are left out as
far as the spare parts allow: a set may drop those below a count of features
that at most the spare number of its parts fall short of, and since a shared
signature has the same count in both sets, one that both keep remains.

Candidates. Signatures are packed per task and bucket and shuffled by bucket; the
number of buckets grows with the data. Only where a signature is shared are the
sizes and parity sketches of its nodes joined to the bucket, and a group of nodes
that share many signatures is kept in one of its buckets. Sizes and parity sketches of the sets rule out most pairs that cannot link: a sketch has a
bit for each cell of the feature domain, the parity of the set's features in it,
so two sketches differ in at most as many bits as the sets in features.

Verification, in rounds, each on exact sets: (1) every node against the closest,
by sketch, of the first nodes of its groups; (2) twice, every node against the
closest node of another component that it shares a signature with and was not
held against; (3) all pairs of unconnected nodes that share a signature and are
left by sketches of ``FINE`` times the size. Members of one component need no
more comparing, so a large group of near copies costs comparisons in proportion
to its size, and no link is lost. Components are found by joins.

A node is named by a 64-bit hash of its set.

Defined results: null text or text without words has an empty set, links with
nothing and is its own component; rows with one doc_id and different texts are
judged each by its text; a component's id is its smallest doc_id that is not
null; very long texts give all their shingles; repeated rows are one node; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mixed, shingles
from .shared import freed, row_name, spread_join, written

PERCENT = 80
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SPARE = 0.1
FEW = 2
FINE = 8
CLOSEST_ROUNDS = 2
HELD_BYTES = 16 << 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def distance_bound(a, b, percent: int = PERCENT):
    """Features in which sets of these sizes may differ and still link."""
    return (a + b) * (100 - percent) // (100 + percent)


@functools.lru_cache(maxsize=4)
def bands(percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(largest size, bound on differences) of each band of sizes."""
    tops, at = [0], 1
    while at < 1 << 40:
        tops.append(at * 100 // percent)
        at = tops[-1] + 1
    tops = np.array(tops, np.int64)
    return tops, distance_bound(tops, tops, percent)


def parities(features: np.ndarray, times: int = 1) -> bytes:
    """The parity of the number of features in each cell; ``times`` cells a feature and up, a power of two."""
    cells = max(64, 1 << (len(features) * times - 1).bit_length())
    odd = np.bincount((features >> np.uint64(30)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _small(features: np.ndarray, band: int, k: int) -> np.ndarray:
    """Signatures of all subsets that leave out up to k features."""
    whole = mixed(features * _C[1])
    total = whole.sum(dtype=np.uint64, keepdims=True)
    out = [total]
    for gone in range(1, min(k, len(features) - 1) + 1):
        left_out = np.array(list(itertools.combinations(range(len(features)), gone)))
        out.append(total - whole[left_out].sum(axis=1, dtype=np.uint64))
    return mixed(np.concatenate(out) + mixed(np.full(1, band, np.uint64)))


def _large(sets: list[np.ndarray], band: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, which set) of many sets at once, each with its band and bound."""
    sizes = np.array([len(s) for s in sets])
    spare = np.maximum(1, (k * SPARE / 2).astype(np.int64))
    parts = k // 2 + 1 + spare
    base = np.cumsum(parts * 3) - parts * 3
    features = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), sizes)
    spun = mixed(features + (band.astype(np.uint64) * _C[3])[own])
    cell = (((spun >> np.uint64(32)) * (parts * 3).astype(np.uint64)[own]) >> np.uint64(32)).astype(np.int64) + base[own]
    n = int((parts * 3).sum())
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, cell, mixed(features * _C[1]))
    counts = np.bincount(cell, minlength=n).reshape(-1, 3)
    sums = sums.reshape(-1, 3)
    part_of = np.repeat(np.arange(len(sets)), parts)
    within = np.arange(len(part_of)) - np.repeat(base // 3, parts)
    two = ((0, 1), (0, 2), (1, 2))
    held = np.stack([counts[:, a] + counts[:, b] for a, b in two])
    # The highest count of features below which at most the spare number of parts fall.
    weakest, enough = held.min(axis=0), np.zeros(len(sets), np.int64)
    for least in (1, 2, 3):
        short = np.bincount(part_of, weights=weakest < least, minlength=len(sets))
        enough = np.where((short <= spare) & (enough == least - 1), least, enough)
    tag = mixed(within.astype(np.uint64) * _C[0] + (band.astype(np.uint64) * _C[2])[part_of])
    out, whose = [], []
    for j, (a, b) in enumerate(two):
        kept = held[j] >= enough[part_of]
        out.append(mixed(mixed(sums[kept, a] + tag[kept] + np.uint64(j)) + sums[kept, b] * _C[2]))
        whose.append(part_of[kept])
    return np.concatenate(out), np.concatenate(whose)


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, which set) of all of some sets, none empty."""
    tops, bounds = bands(percent)
    sizes = np.array([len(s) for s in sets])
    first = np.searchsorted(tops, sizes)
    out, whose = [], []
    for step in (0, 1):
        band = first + step
        k = bounds[band]
        for i in np.flatnonzero(k <= FEW):
            got = _small(sets[i], int(band[i]), int(k[i]))
            out.append(got)
            whose.append(np.full(len(got), i))
        many = np.flatnonzero(k > FEW)
        if len(many):
            got, i = _large([sets[i] for i in many], band[many], k[many])
            out.append(got)
            whose.append(many[i])
    return np.concatenate(out), np.concatenate(whose)


def node_of(features: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(features.tobytes()) - (1 << 63)


def _shingled(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each text, one text at a time."""
    return (shingles(x.as_py() or b"") for x in column.cast(pa.binary()))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, shapes = [], [], []
        for s in _shingled(batch.column(1)):
            sizes.append(len(s))
            nodes.append(node_of(s) if len(s) else None)
            shapes.append(parities(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(shapes, pa.binary())], ["doc_id", "row", "n_shingles", "node", "shape"])


def _sign(buckets: int, percent: int):
    """Texts in; packed signatures, one row per chunk and bucket, out."""

    def packed(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        nodes = np.array(list(sets), np.int64)
        arrays = list(sets.values())
        sigs, whose = signatures(arrays, percent)
        bucket = ((sigs >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        order = np.lexsort((whose, bucket))
        sigs, whose, bucket = sigs[order] & np.uint64((1 << 40) - 1), whose[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for k in range(buckets):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                continue
            present, counts = np.unique(whose[a:b], return_counts=True)
            rows.append((k, nodes[present].tobytes(), counts.astype(np.uint32).tobytes(), (sigs[a:b] >> np.uint64(8)).astype(np.uint32).tobytes(), (sigs[a:b] & np.uint64(255)).astype(np.uint8).tobytes()))
        cols = list(zip(*rows))
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["bucket", "nodes", "counts", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for s in _shingled(batch.column(0)):
                if len(s) and (node := node_of(s)) not in sets:
                    sets[node] = s
                    size += 8 * len(s)
                    if size >= CHUNK_BYTES:
                        yield from packed(sets)
                        sets, size = {}, 0
        if sets:
            yield from packed(sets)

    return run


_SIGNED = "bucket int, nodes binary, counts binary, high binary, low binary"
_GROUPS = "bucket int, nodes binary, members binary, ends binary, names binary"


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    return sketch if len(sketch) == words else np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


class Sketches:
    """Sizes and sketches of some nodes, by length of sketch."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes], percent: int):
        self.sizes, self.percent = sizes, percent
        self.words = np.array([len(s) // 8 for s in sketches], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for words in set(self.words.tolist()):
            # Those of this length, and longer ones folded, as far as their sizes can meet.
            who = np.flatnonzero((self.words == words) | (self.words == 2 * words))
            place = np.full(len(sketches), -1)
            place[who] = np.arange(len(who))
            self.tables[words] = place, np.stack([folded(np.frombuffer(sketches[i], np.uint64), words) for i in who])

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At most the number of features in which the sets differ; -1 for pairs that cannot link."""
        out = np.full(len(a), -1, np.int64)
        bound = distance_bound(self.sizes[a], self.sizes[b], self.percent)
        fits = np.abs(self.sizes[a] - self.sizes[b]) <= bound
        words = np.minimum(self.words[a], self.words[b])
        for w in set(words[fits].tolist()):
            place, table = self.tables[w]
            pairs = np.flatnonzero(fits & (words == w))
            step = max(1, HELD_BYTES // (8 * w))
            for k in range(0, len(pairs), step):
                some = pairs[k : k + step]
                d = np.bitwise_count(table[place[a[some]]] ^ table[place[b[some]]]).sum(axis=1, dtype=np.int64)
                out[some] = np.where(d <= bound[some], d, -1)
        return out


def _group(table: pa.Table) -> pa.Table:
    """All packed rows of a bucket in; its groups of nodes that share a signature out."""
    flat = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])
    bucket = table.column("bucket")[0].as_py()
    unique, own = np.unique(flat("nodes", np.int64), return_inverse=True)
    who = np.repeat(own.astype(np.int32), flat("counts", np.uint32))
    sig = (flat("high", np.uint32).astype(np.uint64) << np.uint64(8)) | flat("low", np.uint8)
    del table, own
    order = np.argsort(sig, kind="stable")
    sig, who = sig[order], who[order]
    # Keep signatures that several entries have, then drop a node's repeats in one.
    edge = np.concatenate([[True], sig[1:] != sig[:-1]])
    alone = edge & np.concatenate([edge[1:], [True]])
    sig, who = sig[~alone], who[~alone]
    del order, edge, alone
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])]) if len(sig) else np.zeros(0, bool)
    sig, who = sig[fresh], who[fresh]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(sig)]]))
    # Groups with the same members count once; they are named by 128 bits.
    hashed = mixed(unique[who].view(np.uint64))
    name = np.stack([np.add.reduceat(h, starts) for h in (hashed, mixed(hashed * _C[0]))], axis=1) if len(sig) else np.zeros((0, 2), np.uint64)
    _, one = np.unique(name, return_index=True, axis=0)
    one = one[sizes[one] > 1]
    members = np.concatenate([who[starts[i] : starts[i] + sizes[i]] for i in one]) if len(one) else np.zeros(0, np.int32)
    present, local = np.unique(members, return_inverse=True)
    out = {"bucket": [bucket], "nodes": [unique[present].tobytes()], "members": [local.astype(np.int32).tobytes()], "ends": [np.cumsum(sizes[one]).astype(np.int64).tobytes()], "names": [name[one].tobytes()]}
    return pa.Table.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("nodes", pa.binary()), ("members", pa.binary()), ("ends", pa.binary()), ("names", pa.binary())]))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, names in zip(batch.column(0).to_pylist(), batch.column(1)):
            names = np.frombuffer(names.as_py(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), bucket, np.int32)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())], ["bucket", "name", "more"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets with the names of the groups that stay in them in; the buckets with only those out."""
    for batch in batches:
        for k in range(batch.num_rows):
            bucket, nodes, members, ends, names = (batch.column(i)[k].as_py() for i in range(5))
            stay = batch.column(5)[k].values
            stay = set(zip(stay.field(0).to_pylist(), stay.field(1).to_pylist()))
            ends, members = np.frombuffer(ends, np.int64), np.frombuffer(members, np.int32)
            keep = np.array([tuple(x) in stay for x in np.frombuffer(names, np.int64).reshape(-1, 2).tolist()], bool)
            sizes = np.diff(np.concatenate([[0], ends]))
            members, sizes = members[np.repeat(keep, sizes)], sizes[keep]
            present, local = np.unique(members, return_inverse=True)
            cols = [np.frombuffer(nodes, np.int64)[present], local.astype(np.int32), np.cumsum(sizes).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["bucket", "nodes", "members", "ends"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes = np.frombuffer(nodes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), bucket, np.int32)), pa.array(nodes)], ["bucket", "node"])


class Groups:
    """The groups of a bucket, with what is known of its nodes by now."""

    def __init__(self, nodes: bytes, members: bytes, ends: bytes, facts: pa.StructArray, known: pa.StructArray | None, percent: int):
        self.nodes, self.members, self.ends = np.frombuffer(nodes, np.int64), np.frombuffer(members, np.int32), np.frombuffer(ends, np.int64)
        facts = facts.take(pa.array(np.argsort(facts.field("node").to_numpy())))
        self.coarse = Sketches(facts.field("size").to_numpy(), facts.field("shape").to_pylist(), percent)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        # Nodes of which nothing is known yet are components of their own.
        self.label, self.known = self.nodes.copy(), known
        self.at = np.searchsorted(self.nodes, known.field("node").to_numpy()) if known is not None else np.zeros(0, np.int64)
        if len(self.at):
            self.label[self.at] = known.field("root").to_numpy()

    def tried(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, node) pairs that were held against each other, as far as both are here."""
        if not len(self.at):
            return self.at, self.at
        lists = self.known.field("tried")
        who, other = np.repeat(self.at, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(self.nodes, other), len(self.nodes) - 1)
        here = self.nodes[place] == other
        return who[here], place[here]

    def fine(self) -> dict[int, bytes]:
        return {int(at): x for at, x in zip(self.at, self.known.field("fine").to_pylist()) if x is not None} if len(self.at) else {}

    def cross_pairs(self, wanted: np.ndarray | None = None, held: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, sketch distance) of pairs of a group in different components that may link."""
        if not len(self.ends):
            return
        tagged = self.label[self.members]
        several = np.flatnonzero(np.maximum.reduceat(tagged, self.starts) != np.minimum.reduceat(tagged, self.starts))
        waiting: list[np.ndarray] = []
        size = 0
        for g in several:
            who = self.members[self.starts[g] : self.ends[g]]
            if wanted is not None:
                who = who[wanted[who]]
            who = who[np.argsort(self.label[who], kind="stable")]
            # Each node against the nodes of later components.
            later = np.searchsorted(self.label[who], self.label[who], side="right")
            step = max(1, held // max(len(who), 1))
            for at in range(0, len(who), step):
                left = np.arange(at, min(at + step, len(who)))
                n = len(who) - later[left]
                a = np.repeat(left, n)
                b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + later[a]
                waiting.append(who[a].astype(np.int64) * len(self.nodes) + who[b])
                size += len(a)
                if size >= held:
                    yield from self._fitting(waiting)
                    waiting, size = [], 0
        if size:
            yield from self._fitting(waiting)

    def _fitting(self, waiting: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        pairs = np.unique(np.concatenate(waiting))
        a, b = pairs // len(self.nodes), pairs % len(self.nodes)
        d = self.coarse.distance(a, b)
        ok = d >= 0
        if ok.any():
            yield a[ok], b[ok], d[ok]


def _each(percent: int, make):
    """make(groups) -> record batches, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from make(Groups(*(batch.column(i)[k].as_py() for i in range(3)), batch.column(3)[k].values, batch.column(4)[k].values, percent))

    return run


def _firsts(groups: Groups) -> Iterator[pa.RecordBatch]:
    """(a, b, d): for each node the closest of the first nodes of its groups."""
    n = len(groups.nodes)
    if not len(groups.ends):
        return
    leader = np.repeat(groups.members[groups.starts], groups.ends - groups.starts)
    pairs = np.unique(groups.members.astype(np.int64) * n + leader)
    a, b = pairs // n, pairs % n
    d = np.where(a == b, -1, groups.coarse.distance(a, b))
    order = np.lexsort((b, d, a))
    order = order[d[order] >= 0]
    first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
    yield pa.RecordBatch.from_arrays([pa.array(groups.nodes[a[first]]), pa.array(groups.nodes[b[first]]), pa.array(d[first])], ["a", "b", "d"])


def _closest(groups: Groups) -> Iterator[pa.RecordBatch]:
    """(a, b, d): for each node its closest node of another component that it was not held against."""
    n = len(groups.nodes)
    one, other = groups.tried()
    tried = one * n + other
    best, least = np.full(n, -1, np.int64), np.full(n, 1 << 40, np.int64)
    for a, b, d in groups.cross_pairs():
        fresh = ~np.isin(a * n + b, tried)
        a, b, d = a[fresh], b[fresh], d[fresh]
        a, b, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
        order = np.lexsort((b, d))[::-1]
        a, b, d = a[order], b[order], d[order]
        now = np.full(n, 1 << 40, np.int64)
        who = np.full(n, -1, np.int64)
        now[a], who[a] = d, b
        better = now < least
        best[better], least[better] = who[better], now[better]
    has = np.flatnonzero(best >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(groups.nodes[has]), pa.array(groups.nodes[best[has]]), pa.array(least[has])], ["a", "b", "d"])


def _open(groups: Groups) -> Iterator[pa.RecordBatch]:
    """The nodes that still may link with a node of another component."""
    seen = np.zeros(len(groups.nodes), bool)
    for a, b, _ in groups.cross_pairs():
        seen[a] = seen[b] = True
    yield pa.RecordBatch.from_arrays([pa.array(groups.nodes[seen])], ["node"])


def _left(groups: Groups) -> Iterator[pa.RecordBatch]:
    """(a, partners): all pairs of open nodes that the fine sketches leave, listed by one of them."""
    known = groups.fine()
    wanted = np.zeros(len(groups.nodes), bool)
    wanted[list(known)] = True
    fine = Sketches(groups.coarse.sizes, [known.get(k, bytes(8)) for k in range(len(groups.nodes))], groups.coarse.percent) if known else None
    found: dict[int, set[int]] = {}
    for a, b, _ in groups.cross_pairs(wanted) if fine else ():
        ok = fine.distance(a, b) >= 0
        for x, y in zip(groups.nodes[a[ok]].tolist(), groups.nodes[b[ok]].tolist()):
            found.setdefault(max(x, y), set()).add(min(x, y))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([list(v) for v in found.values()], pa.list_(pa.int64()))], ["a", "partners"])


def _with_fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts packed, as they are shuffled in each round, and their sketches."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        fine = [parities(s, FINE) for s in _shingled(batch.column(1))]
        packed = [pack(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(fine, pa.binary())], ["node", "text", "fine"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, unpack = None, None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            good = []
            for k, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if a != last:
                    last, own = a, shingles(unpack(x.as_py()))
                other = shingles(unpack(y.as_py()))
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    return run


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, row, n_shingles, component_id, root.

    ``row`` is the 128-bit digest of id and text (``shared.row_name``), by which the
    rows of ``docs`` can be joined.
    ``root`` names the component by a node of it, whatever the ids are: ids may be
    null or repeat, so components can share a ``component_id``. Null for empty sets.
    """
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table; the shuffle files it was made from go at once."""
        table = written(df, name)
        freed(spark)
        return table

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), row_name(F.col(key), F.col(text)).alias("row"))
    profile = written(rows.select("doc_id", "text", "row").mapInArrow(_profile, "doc_id long, row binary, n_shingles long, node long, shape binary"), "shingle-profile")
    total = profile.where("node IS NOT NULL").agg(F.sum("n_shingles")).first()[0] or 0
    # About 0.8 signatures of 5 bytes a shingle.
    buckets = max(2 * spark.sparkContext.defaultParallelism, int(total * 4 // BUCKET_BYTES) + 1)
    signed = rows.where(F.col("text").isNotNull()).select("text").mapInArrow(_sign(buckets, percent), _SIGNED)
    found = kept(signed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_group, _GROUPS), "signature-groups")
    # Sets that share one signature share many, in many buckets: each group stays in one of its buckets.
    named = found.select("bucket", "names").mapInArrow(_names, "bucket int, name long, more long")
    one = named.groupBy("name", "more").agg(F.min_by("bucket", F.xxhash64("bucket", "name")).alias("bucket")).groupBy("bucket").agg(F.collect_list(F.struct("name", "more")).alias("stay"))
    groups = kept(found.join(one, "bucket").select("bucket", "nodes", "members", "ends", "names", "stay").mapInArrow(_kept, "bucket int, nodes binary, members binary, ends binary"), "groups-once")

    placed = written(groups.select("bucket", "nodes").mapInArrow(_nodes, "bucket int, node long"), "group-nodes")
    active = placed.select("node").distinct()
    facts = kept(profile.join(active, "node").groupBy("node").agg(F.min("row").alias("row"), F.first("n_shingles").alias("size"), F.first("shape").alias("shape")), "active-nodes")
    shown = facts.select("node", "row")
    # One row a node was chosen, and the join has dealt the texts by it already.
    chosen = rows.select("row", "text").join(shown, "row").dropDuplicates(["row"]).select("node", "text")
    texts = kept(chosen.mapInArrow(_with_fine, "node long, text binary, fine binary"), "active-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
        return kept(both.mapInArrow(_verify(percent), "a long, b long"), "links")

    sizes = placed.join(facts.select("node", F.struct("node", "size", "shape").alias("fact")), "node").groupBy("bucket").agg(F.collect_list("fact").alias("facts"))
    full = kept(groups.join(sizes, "bucket"), "groups")

    def told(known: DataFrame | None, make, schema: str) -> DataFrame:
        """``make`` of the groups with what is known of their nodes by now: root, tried, fine."""
        kind = "array<struct<node:bigint,root:bigint,tried:array<bigint>,fine:binary>>"
        if known is None:
            rows = full.withColumn("known", F.lit(None).cast(kind))
        else:
            rest = {"root": "bigint", "tried": "array<bigint>", "fine": "binary"}
            columns = [F.col(n).cast(t).alias(n) if n in known.columns else F.lit(None).cast(t).alias(n) for n, t in rest.items()]
            of = known.select("node", F.struct("node", *columns).alias("known"))
            rows = full.join(placed.join(of, "node").groupBy("bucket").agg(F.collect_list("known").alias("known")), "bucket", "left")
        return rows.select("nodes", "members", "ends", "facts", "known").mapInArrow(_each(percent, make), schema)

    def nearest(pairs: DataFrame) -> DataFrame:
        best = pairs.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
        return kept(best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")

    tried = nearest(told(None, _firsts, "a long, b long, d long"))
    links = verified(tried)
    roots = components(links)
    for _ in range(CLOSEST_ROUNDS):
        both = tried.unionAll(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ways = both.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("tried"))
        known = roots.join(ways, "node", "full_outer").select("node", F.coalesce("root", "node").alias("root"), "tried")
        pairs = nearest(told(known, _closest, "a long, b long, d long"))
        fresh = verified(pairs)
        tried = tried.unionAll(pairs)
        if not fresh.limit(1).count():
            break
        links = links.unionAll(fresh)
        roots = components(links)
    still = kept(told(roots, _open, "node long").distinct(), "open-nodes")
    known = still.join(texts.select("node", "fine"), "node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "fine")
    rest = told(known, _left, "a long, partners array<bigint>").groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("p"))
    rest = kept(rest.select("a", F.explode("p").alias("b")).join(tried, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        links = links.unionAll(verified(rest))
        roots = components(links)

    per_node = profile.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n"))
    rooted = per_node.join(roots, "node", "left").withColumn("_root", F.coalesce("root", "node"))
    least = rooted.where("root IS NOT NULL").groupBy("_root").agg(F.min("_least").alias("_id"))
    named = rooted.join(least, "_root", "left").where("_n > 1 OR root IS NOT NULL").select("node", "_root", F.coalesce("_id", "_least").alias("_component"))
    out = spread_join(profile.drop("shape"), kept(named, "classes"), "node", "row")
    return out.select("doc_id", "row", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"), F.coalesce("_root", "node").alias("root"))
