"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

Every text becomes the set of its distinct word shingles (64-bit hashes). Equal sets
are one node. Sizes are cut into bands; a tile joins a band with itself and with the
sizes above it that can still be similar enough. Within a tile two linked sets differ
in at most D shingles, so when the hash range is cut into more than D segments, some
segment holds the same shingles in both: nodes meet only on such segment keys, and no
link is lost. A tile has ``spare`` segments more than that, so segments that are empty
need no key; a node with too many empty segments shares one more key with its like.

Nodes that share a key are compared in three steps, none of which lists all pairs of
a group. (1) Each meets one node of the key, the smallest under one of ``HUBS`` hashes, so
that keys with the same nodes name the same few and a node of a large group meets those
once, not another for each of its keys. The bit counts of two hashed bitmaps bound the
overlap from above; pairs that pass are settled by intersecting the sorted arrays. (2) Links are contracted to components. (3) Only keys whose nodes are still in
several components go on, and of keys with the same nodes, as a passage leaves many, only
the smallest: their bitmaps are compared block by block (blocks of ``BLOCK``
nodes) across components, and those of the largest one only with the nodes outside it. A pair counts on its smallest shared key only, and nodes with
a likely partner meet there again with their arrays. A task intersects exactly and
reports only the links that join components, so pairs never become rows.

Keys are spread over the cluster once, with the smallest and largest node of each key
pre-aggregated. Those that two nodes share are marked in a bitmap of ``MARK_BITS`` places
at most; only keys with a mark go on to the exact join, and without enough room for
marks more keys go there, none is lost. Tables are deleted when their last reader ends.

Defined results: a null, empty or wordless text has the empty set and links with
nothing; a text of fewer words than a shingle has its whole sequence as the only
shingle; repeated rows have the same node; rows without an id get their size but a
null component; an id that stands on several texts names all of them; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, digests, table

WORDS = 5
PERCENT = 80
BLOCK = 1024
BANDS = 2
HUBS = 4
BROADCAST_ROWS = 400_000
MARK_BITS = 1 << 27
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHIFT = np.uint64(31)

SIGNED = pa.schema([("n", pa.int64()), ("node", pa.int64()), ("proof", pa.int64()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of a text; remembers the words' hashes."""

    def __init__(self, words: int, seed: int = 0):
        self.words, self.seed, self.known = words, seed, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z and the six white-space characters only
        if not words:
            return np.empty(0, np.uint64)
        known, seed = self.known, self.seed
        if len(known) > 1_000_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, seed)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, len(h) if len(h) < self.words else 0, np.uint64)
        for i in range(k):
            out = out * _M1 + h[i : len(h) - k + 1 + i]
            out ^= out >> _SHIFT
            out *= _M2
        return np.unique(_mix(out))


class Tiles:
    """Bands of sizes for a threshold of ``percent``: edges, differences and segments."""

    def __init__(self, percent: int):
        self.percent, self.ratio = percent, (100 / percent) ** BANDS
        self.shapes: dict[int, tuple[int, int, int, int]] = {}

    def shape(self, tile: int) -> tuple[int, int, int, int]:
        """(lowest size, sizes below, segments, spare segments) of a tile; 0 segments if only equal sets link."""
        if tile not in self.shapes:
            self.shapes[tile] = self._shape(tile)
        return self.shapes[tile]

    def _shape(self, tile: int) -> tuple[int, int, int, int]:
        low, high = math.ceil(self.ratio**tile), math.ceil(self.ratio ** (tile + 1))
        top = high - 1
        most = self.most_apart(top + top * 100 // self.percent)
        if top < low or not most:
            return low, high, 0, 0
        spare, segments = 1, most + 1
        for _ in range(4):
            segments = most + spare
            empty = segments * math.exp(-low / segments)
            spare = 1 + math.ceil(empty + 5 * math.sqrt(empty) + 0.5)
        return low, high, most + spare, spare

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> list[int]:
        tile = int(math.log(size) / math.log(self.ratio)) if size > 1 else 0
        while math.ceil(self.ratio ** (tile + 1)) <= size:
            tile += 1
        while tile and math.ceil(self.ratio**tile) > size:
            tile -= 1
        below = [tile - 1] if tile and size * self.percent <= (math.ceil(self.ratio**tile) - 1) * 100 else []
        return [t for t in (tile, *below) if self.shape(t)[2]]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Segment keys of a node: equal keys mean equal shingles in that segment."""
        out, sums = [], None
        for tile in self.of(len(shingles)):
            _, _, segments, spare = self.shape(tile)
            if sums is None:
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(shingles), dtype=np.uint64)])
            bounds = (np.arange(segments + 1, dtype=np.float64) * (2.0**64 / segments))[1:-1].astype(np.uint64)
            cuts = np.concatenate([[0], np.searchsorted(shingles, bounds), [len(shingles)]])
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            own = sums[cuts[full + 1]] - sums[cuts[full]]
            out.append(_mix(own * _M1 + np.uint64((tile + 1) * int(_M3) & (2**64 - 1)) + full.astype(np.uint64)))
            if segments - len(full) >= spare:
                out.append(_mix(np.array([(tile + 1) * 0x5851F42D4C957F2D & (2**64 - 1)], np.uint64)))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def bitmap(shingles: np.ndarray, bits: int = 1) -> bytes:
    """Parities of the shingles by hashed place; ``bits`` places a shingle at least, a power of two."""
    size = max(64, 1 << (bits * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap cut to ``size`` bytes; places are taken modulo, so halves add up."""
    return bits if len(bits) == size else np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def signatures(rows: DataFrame, words: int, percent: int, seed: int = 0) -> DataFrame:
    """The columns of ``rows`` but for the last, the text; set size, node and proof (two digests of the set), bitmap and segment keys."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, tiles = Shingler(words, seed), Tiles(percent)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                made = [_signed(shingler(x.as_py()), tiles, seed) for x in part.columns[-1]]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), SIGNED.types, strict=True))], names=[*kept, *SIGNED.names])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, n bigint, node bigint, proof bigint, bits binary, keys array<bigint>")


def _signed(shingles: np.ndarray, tiles: Tiles, seed: int) -> tuple:
    data = shingles.tobytes()
    node, proof = (np.uint64(xxhash.xxh64_intdigest(data, s)).astype(np.int64) for s in (2 * seed + 1, 2 * seed + 2))
    return len(shingles), int(node), int(proof), bitmap(shingles) if len(shingles) else b"", tiles.keys(shingles).view(np.int64) if len(shingles) else np.empty(0, np.int64)


def shingle_sets(rows: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """node and sorted shingles of each wanted (node, digest); ``rows`` has digest and text.

    A digest is that of an id and a text, so of a node's copies one row is read. Another
    row with a wanted digest does no harm: its node is not wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words, seed), set()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [t for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True) if d not in seen and not seen.add(d)]  # copies once a task
                if len(seen) > 1_000_000:
                    seen.clear()
                data = [shingler(t.as_py()).tobytes() for t in texts]
                nodes = [int(np.uint64(xxhash.xxh64_intdigest(d, 2 * seed + 1)).astype(np.int64)) for d in data]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], names=["node", "shingles"])

    there = rows.select("digest", "text").join(_small(wanted.select("digest")), "digest", "left_semi")
    made = there.mapInArrow(run, "node bigint, shingles binary").join(_small(wanted.select("node")), "node", "left_semi")
    return made.groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def _small(table: DataFrame) -> DataFrame:
    """Marks a written table for broadcast while it has few rows of a few numbers."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _marks(shared: DataFrame) -> np.ndarray:
    """A bitmap with two places set for every shared key; its size is bounded."""
    bits = 1 << 16
    while bits < min(MARK_BITS, 16 * shared.count()):
        bits *= 2
    place = lambda k: F.col("key").bitwiseAND(F.lit(bits - 1)) if k == 0 else F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1))
    places = shared.select(F.explode(F.array(place(0), place(1))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    rows = words.toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which keys may be shared."""
    last = np.uint64(64 * len(marks) - 1)
    hit = lambda at: (marks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
    k = keys.view(np.uint64)
    return (hit(k & last) & hit((k >> np.uint64(32)) & last)).astype(bool)


def _shared_members(wide: DataFrame, work: Scratch) -> DataFrame:
    """(key, node) of every key that at least two nodes have, as a written table."""
    sides = wide.select(F.explode("keys").alias("key"), "node").groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = work.stored(sides.where("low != high").select("key"), "jaccard-keys")
    marks = wide.sparkSession.sparkContext.broadcast(_marks(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            lists = batch.column(1)
            keys, node = lists.flatten().to_numpy(), batch.column(0).to_numpy()
            fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)  # copies once a task
            if len(seen) > 1_000_000:
                seen.clear()
            counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
            keep = np.repeat(fresh, counts) & _marked(keys, marks.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(np.repeat(node, counts)[keep])], names=["key", "node"])

    likely = wide.select("node", "keys").mapInArrow(run, "key bigint, node bigint")
    out = work.stored(likely.join(shared, "key", "left_semi").distinct(), "jaccard-members")
    work.drop(shared)
    return out


def _by_bits(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow enough overlap, with the bits that differ."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(percent)
        for batch in batches:
            found = []
            for a, b, n, m, x, y in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns[:4]), *(c.to_pylist() for c in batch.columns[4:]), strict=True):
                if 100 * min(n, m) >= percent * max(n, m) and (d := apart(x, y)) <= tiles.most_apart(n + m):
                    found.append((a, b, d))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    one, two = (sig.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a bigint, b bigint, bits bigint")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by intersecting their sorted arrays."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, x, y in zip(*batch.columns, strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    found.append((a.as_py(), b.as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set{k}")) for k in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "seta", "setb").mapInArrow(run, "a bigint, b bigint")


def _dealt(rows: DataFrame, payload: str) -> DataFrame:
    """Rows of (key, node, n, payload, comp and perhaps others) as runs of two blocks of a key's nodes each.

    Two blocks bound a task's memory whatever a key's size. A key of no more rows is one
    run, each row once. The nodes of a larger one are dealt to blocks and a pair of blocks
    becomes one run. Nodes of its largest component, if that fills a block, have blocks of
    their own after the others; those never meet each other, so a node of that component
    stands once for each block of the nodes outside it, not for each block of the key.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 2 * BLOCK)
    comps = rows.join(sizes, "key").groupBy("key", "comp").agg(F.first("size").alias("size"), F.count("*").alias("own"))
    largest = comps.groupBy("key").agg(F.first("size").alias("size"), F.max_by("comp", F.struct("own", "comp")).alias("main"), F.max("own").alias("own"))
    inside = F.when(F.col("own") >= BLOCK, F.col("own")).otherwise(0)
    cut = largest.select("key", F.when(inside > 0, F.col("main")).alias("main"), F.greatest(F.ceil((F.col("size") - inside) / BLOCK), F.lit(1)).cast("int").alias("apart"), F.ceil(inside / BLOCK).cast("int").alias("within"))
    apart_, within = F.coalesce("apart", F.lit(1)), F.coalesce("within", F.lit(0))
    place, of_main = F.xxhash64("node"), F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    own = F.when(of_main, apart_ + F.pmod(place, F.greatest(within, F.lit(1)))).otherwise(F.pmod(place, apart_)).cast("int")
    met = F.sequence(F.lit(0), F.when(of_main, apart_).otherwise(apart_ + within) - 1)
    dealt = rows.join(cut, "key", "left").withColumn("own", own).withColumn("other", F.explode(met))
    sides = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    sides = sides.select("key", "i", "j", "node", "n", "comp", (F.col("own") == F.col("i")).alias("left"), (F.col("own") == F.col("j")).alias("right"), payload, *[c for c in ("others",) if c in rows.columns])
    return sides.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


class Run:
    """The rows of two blocks of a key: node, n, comp, left, right, payloads and perhaps the nodes' other keys."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.key = parts[0].column(0)[0].as_py()
        read = lambda c: np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts])
        self.node, self.n, self.comp, self.left, self.right = (read(c) for c in range(3, 8))
        self.payloads = [x for p in parts for x in p.column(8).to_pylist()]
        self.others = [p.column(9) for p in parts if p.num_columns > 9]

    def met_before(self) -> np.ndarray:
        """Bits by row of the smaller keys that rows of the run share; a pair with a bit in common meets there too."""
        below = [k[k < self.key] for column in self.others for x in column for k in [np.asarray(x.values.to_numpy(), np.int64)]]
        _, at, n = np.unique(np.concatenate(below), return_inverse=True, return_counts=True)
        place, many = np.cumsum(n > 1) - 1, n[at] > 1
        flags = np.zeros((len(below), max(64, -(-int((n > 1).sum()) // 64) * 64)), bool)
        row = np.repeat(np.arange(len(below)), [len(k) for k in below])
        flags[row[many], place[at[many]]] = True
        return np.packbits(flags, axis=1).view(np.uint64)

    def near(self, bitmaps: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of the left block the right block's rows, across components, whose bits allow a link and that meet on no smaller of the others."""
        if (self.comp == self.comp[0]).all():
            return
        tiles = Tiles(percent)
        left, right, n, comp, met = np.flatnonzero(self.left), np.flatnonzero(self.right), self.n, self.comp, None
        names, counts = np.unique(comp, return_counts=True)
        largest = names[counts.argmax()]
        outside = right[comp[right] != largest]
        size = min(map(len, bitmaps))
        bits = np.stack([folded(np.frombuffer(b, np.uint8), size) for b in bitmaps]).view(np.uint64)
        for i in left.tolist():
            at = outside if comp[i] == largest else right[comp[right] != comp[i]]
            at = at[100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i])]
            if self.left[i] and self.right[i]:
                at = at[self.node[at] > self.node[i]]  # both stand in one block
            if len(at):
                at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64) <= (n[at] + n[i]) * (100 - percent) // (100 + percent)]
            if len(at):
                if self.others:
                    met = self.met_before() if met is None else met
                    at = at[~(met[at] & met[i]).any(axis=1)]
                at = np.array([j for j in at.tolist() if apart(bitmaps[i], bitmaps[j]) <= tiles.most_apart(int(n[i] + n[j]))], np.int64)
                if len(at):
                    yield i, at


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
        bounds = [0, *(np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(bounds, bounds[1:], strict=False):
            if (head := tuple(heads[:, low].tolist())) != now:
                if parts:
                    yield Run(parts)
                now, parts = head, []
            parts.append(batch.slice(low, high - low))
    if parts:
        yield Run(parts)


def _open_keys(placed: DataFrame) -> DataFrame:
    """Keys of (key, node, comp) whose nodes are in several components; of keys with the same nodes, the smallest.

    Up to three nodes follow from their number, ends and sum modulo 2; more are told apart
    by that and by a second digest, 128 bits beside the ends.
    """
    of_nodes = [F.count("*").alias("size"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor("node").alias("sum"), F.bit_xor(F.xxhash64("node")).alias("proof")]
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *of_nodes).where("low != high")
    return several.groupBy("size", "first", "last", "sum", "proof").agg(F.min("key").alias("key")).select("key")


def _with_partner(rows: DataFrame, sig: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """(key, node) of the rows that have a partner in another component by their bitmaps, then on each pair's smallest key alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches):
            at = {k for i, found in own.near(own.payloads, percent) for k in (i, *found.tolist())}
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([own.key] * len(at), pa.int64()), pa.array(own.node[sorted(at)])], names=["key", "node"])

    likely = work.stored(_dealt(rows.join(sig, "node"), "bits").mapInArrow(run, "key bigint, node bigint").distinct(), "jaccard-flagged")
    again = work.stored(rows.join(likely, ["key", "node"], "left_semi"), "jaccard-flagged")
    out = work.stored(_dealt(_with_others(again, sig), "bits").mapInArrow(run, "key bigint, node bigint").distinct(), "jaccard-flagged")
    work.drop(likely, again)
    return out


def _overlap(a: np.ndarray, b: np.ndarray, percent: int) -> int | None:
    """Size of the intersection of two sets that link, else None."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both if 100 * both >= percent * (len(a) + len(b) - both) else None


def _spanning_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what a run of rows with shingles can connect, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches):
            sets = [np.frombuffer(x, np.uint64) for x in own.payloads]
            heads: dict[int, int] = {}

            def head(c: int, heads=heads) -> int:
                while (up := heads.get(c, c)) != c:
                    heads[c] = heads.get(up, up)
                    c = up
                return c

            found = []
            for i, at in own.near([bitmap(s, 16) for s in sets], percent):
                for j in at.tolist():
                    x, y = head(int(own.comp[i])), head(int(own.comp[j]))
                    if x != y and _overlap(sets[i], sets[j], percent) is not None:
                        heads[x] = y
                        found.append((int(own.node[i]), int(own.node[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return _dealt(rows, "shingles").mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """node and comp (the smallest node reachable) of every node on a link (a, b), as a written table.

    Large-star and small-star rounds until nothing moves; each round ends in a
    written table. Neighbourhoods are only aggregated and joined, never gathered.
    """
    edges = work.stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        new = work.stored(small, "components")
        work.drop(edges)
        edges, state = new, new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    out = work.stored(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "components")
    work.drop(edges)
    return out


def _keyed(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), *more, F.xxhash64(F.col(doc_id).cast("long"), body).alias("digest"), body.alias("text"))


def _signed_rows(rows: DataFrame, words: int, percent: int, work: Scratch) -> tuple[DataFrame, int]:
    """The signatures of all rows, under a seed that gives different sets different nodes."""
    seed = 0
    while True:
        signed = work.stored(signatures(rows, words, percent, seed), "jaccard-signatures")
        nodes = signed.where("n > 0").groupBy("node")
        if not nodes.agg(F.min("proof").alias("p"), F.max("proof").alias("q")).where("p != q").take(1):
            return signed, seed
        work.drop(signed)
        seed += 1  # two different sets had one digest


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes (node, n, rows, doc_id: the smallest) and every link (a, b, overlap) between two of them.

    Rows of one node link as well; they are not listed. Rows without an id or words have no node.
    Two blocks bound a task's memory, and a pair is intersected on its smallest shared key only.
    """
    rows, work = _keyed(docs, doc_id, text), Scratch(docs.sparkSession)
    signed, seed = _signed_rows(rows, words, percent, work)
    usable = signed.where("n > 0 and doc_id is not null")
    nodes = work.stored(usable.groupBy("node").agg(F.any_value("n").alias("n"), F.count("*").alias("rows"), F.min("doc_id").alias("doc_id")), "jaccard-nodes")
    members = _shared_members(usable, work)
    sig = _first(usable, members.select("node").distinct(), work)
    # The component of a row is its node: no pair is left out for being connected already.
    every = members.withColumn("comp", F.col("node"))
    placed = work.stored(every.join(_open_keys(every), "key", "left_semi"), "jaccard-open")
    flagged = _with_partner(placed, sig, percent, work)
    sets = _sets_of(rows, usable, flagged.select("node"), words, seed, work)
    work.drop(signed)
    with_sets = _with_others(placed.join(flagged, ["key", "node"], "left_semi"), sets).withColumn("n", F.expr("octet_length(shingles) div 8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches):
            sets = [np.frombuffer(x, np.uint64) for x in own.payloads]
            for i, at in own.near([bitmap(x, 16) for x in sets], percent):
                pairs = [(int(min(own.node[i], own.node[j])), int(max(own.node[i], own.node[j])), both) for j in at.tolist() if (both := _overlap(sets[i], sets[j], percent)) is not None]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b", "overlap"])

    return nodes, _dealt(with_sets, "shingles").mapInArrow(run, "a bigint, b bigint, overlap bigint")


def link_counts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (the smallest), rows and n_links of every set: how many other rows each of its rows links with."""
    nodes, found = links(docs, words, percent, doc_id, text)
    sides = found.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
    others = sides.join(nodes.select(F.col("node").alias("other"), F.col("rows").alias("copies")), "other").groupBy("node").agg(F.sum("copies").alias("copies"))
    return nodes.join(others, "node", "left").select("doc_id", "rows", (F.col("rows") - 1 + F.coalesce("copies", F.lit(0))).alias("n_links"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, comps = _components_of(_keyed(docs, doc_id, text), "doc_id is not null", words, percent)
    first = rows.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = first.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    heads = joined.groupBy("comp").agg(F.min("first").alias("component"))
    of_node = joined.join(heads, "comp").select("node", "component")
    return rows.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def _components_of(keyed: DataFrame, usable: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keyed`` with n and node in place of the text, and node and comp of every node that has a link."""
    work = Scratch(keyed.sparkSession)
    signed, seed = _signed_rows(keyed, words, percent, work)
    rows = work.stored(signed.drop("proof", "bits", "keys"), "jaccard-rows")
    used = signed.where(f"n > 0 and {usable}")
    members = _shared_members(used, work)
    sig = _first(used, members.select("node").distinct(), work)
    work.drop(signed)  # nearly as large as the texts
    used = rows.where(f"n > 0 and {usable}")
    hubs = members.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.pmod("key", F.lit(HUBS)))).alias("b"))
    met = work.stored(members.join(hubs, "key").where("node != b").select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct(), "jaccard-met")
    passed = work.stored(_by_bits(met, sig, percent), "jaccard-passed")
    work.drop(met)
    sets = _sets_of(keyed, used, passed.select(F.explode(F.array("a", "b")).alias("node")), words, seed, work)
    # First every node with the nearest of its smaller partners, then what that leaves apart.
    nearest = passed.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b"))
    found = work.stored(_linked(nearest, sets, percent), "jaccard-links")
    comps = components(found, work)
    more = work.stored(_linked(_across(passed.join(nearest, ["a", "b"], "left_anti"), comps), sets, percent), "jaccard-links")
    if more.take(1):
        found = found.unionByName(more)
        work.drop(comps)
        comps = components(found, work)
    work.drop(passed, sets)
    placed = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_rows = work.stored(placed.join(_open_keys(placed), "key", "left_semi").select("key", "node", "comp"), "jaccard-open")
    flagged = _with_partner(open_rows, sig, percent, work)
    if flagged.take(1):
        near = _sets_of(keyed, used, flagged.select("node"), words, seed, work)
        with_sets = _with_others(work.stored(open_rows.join(flagged, ["key", "node"], "left_semi"), "jaccard-open"), near)
        last = work.stored(_spanning_links(with_sets.withColumn("n", F.expr("octet_length(shingles) div 8")), percent), "jaccard-links")
        if last.take(1):
            work.drop(comps)
            comps = components(found.unionByName(last), work)
    work.drop(*[t for t, _ in work.paths if t is not rows and t is not comps])
    return rows, comps


def _with_others(placed: DataFrame, of_node: DataFrame) -> DataFrame:
    """Each (key, node, comp) with the columns of ``of_node`` and all keys of its node; a text's own segments bound their number.

    A node's list and columns meet first, once a node, so no join's side holds a list for each key.
    """
    return placed.join(of_node.join(placed.groupBy("node").agg(F.collect_list("key").alias("others")), "node"), "node")


def _sets_of(keyed: DataFrame, used: DataFrame, nodes: DataFrame, words: int, seed: int, work: Scratch) -> DataFrame:
    """Shingles of the named nodes, from one text of each."""
    wanted = work.stored(used.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest")), "jaccard-wanted")
    return work.stored(shingle_sets(keyed, wanted, words, seed), "jaccard-sets")


def _first(usable: DataFrame, nodes: DataFrame, work: Scratch) -> DataFrame:
    """Size and bitmap of each of ``nodes``, which all its rows share, as a written table."""
    wanted = work.stored(nodes, "jaccard-wanted")
    return work.stored(usable.select("node", "n", "bits").join(_small(wanted), "node", "left_semi").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits")), "jaccard-bitmaps")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose nodes are not in one component yet."""
    for k in "ab":
        pairs = pairs.join(comps.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}")), k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k))
    return pairs.where("ca != cb").select("a", "b")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicate rows the one with the smallest id stays.

    Rows without an id come after the others; a digest of the row settles repeated ids,
    and of rows that are equal in every column one stays. Rows without words are kept as
    they are. Only ids and digests go through the join; the texts move once, to the verdicts.
    """
    one, two = digests(docs, docs.columns)
    rows, comps = _components_of(_keyed(docs, "doc_id", "text", one.alias("one"), two.alias("two")), "true", WORDS, PERCENT)
    placed = rows.where("n > 0").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "one", "two")).alias("rank")).select(F.col("rank.one").alias("one"), F.col("rank.two").alias("two"))
    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(docs.columns)]
    worded = F.coalesce(F.rlike("text", F.lit(WORD)), F.lit(False))
    keyed = docs.where(worded).select(*carried, one.alias("one"), two.alias("two")).join(first, ["one", "two"], "left_semi")
    kept = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("one", "two").orderBy("one"))).where("nth = 1")
    return kept.select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)]).unionByName(docs.where(~worded))
