"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least `percent` / 100.

1. Documents with the same set become one node, its smallest doc_id.
2. Candidates. Two linked sets of sizes a and b differ in at most k elements, k from the sizes alone. Sets are cut by
   hash into parts, a few more than k, per size band; each set emits its first k + 1 non-empty parts. The one of two
   linked sets whose last emitted part comes first has k + 1 parts of which one at least is the same in the other
   (pigeonhole), so linked sets always share a (band, part, content) key. Small sets emit the pairs among their
   smallest hashes instead, as many hashes as two linked sets must share two of (prefix filter).
   Keys are dealt as packed arrays. Each task first joins its own documents of equal keys, so that a key leaves a task
   once however many documents share it.
3. Stars. Each node is compared with the centre of the keys it shares most; components so found need no further
   comparison inside, which keeps large groups of near copies linear.
4. Size-banded tiles. Nodes of a key that lie in different components are compared by hashed bitmaps: the bits in
   which two differ bound their overlap from above. What the bound can't exclude makes candidate groups of nodes, which are cut
   into blocks of bounded size, components kept together; tiles are the pairs of blocks that hold different
   components. In a tile, pairs of a size band that the bitmaps can't exclude and that are not yet connected are
   decided by exact intersection of the sorted hash arrays.
5. Components of all verified links.

Shingles are told apart by 64-bit hashes; keys need only 48 bits, as a false candidate is refuted later. Hashing may
fill fewer than k + 1 parts of a set, with a probability of about 1e-9; if that happens to any set, all sets also emit the
elements of their prefixes as keys (as many smallest hashes as two linked sets must share one of), which needs no parts. So no link is
lost, and no cap or sample is applied. The stars, the tiles and the keys need only the candidates' texts, which are read again.

Defined cases: texts that are null or have no word are empty sets, linked with nothing; fewer words than a shingle
are one shingle; rows with a null doc_id link with nothing and have a null component; rows that repeat a doc_id are
one document with several texts; an empty table gives an empty one; only id and text are read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, read_table, scratch
from threadloom.llm.components import components

BLOCK_SETS = 4096
BLOCK_SHINGLES = 1 << 20
STAR_SETS = 2048
DEAL_KEYS = 4_000_000

_LOWER = bytes(32 if b in b" \t\n\x0b\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(raw: bytes, size: int, words: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text in UTF-8."""
    found = raw.translate(_LOWER).split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * _B + w[i : n - k + 1 + i] * _A)
    return np.unique(h)


@lru_cache(maxsize=None)
def most_different(n: int, percent: int) -> int:
    """The largest symmetric difference of a set of n with any set it links with."""
    most = 0
    for b in range(-(-percent * n // 100), 100 * n // percent + 1):
        overlap = -(-percent * (n + b) // (100 + percent))
        if overlap <= min(n, b):
            most = max(most, n + b - 2 * overlap)
    return most


def small_sets(percent: int) -> int:
    """The largest set that emits pairs of hashes; larger ones emit parts."""
    return 17 if percent >= 90 else 63


def parts_of(most: int, top: int, percent: int) -> int:
    """Into how many parts a band's sets are cut, of which most + 1 must not be empty."""
    return most + -(-top // 100) + 4 if percent >= 90 else most + -(-most * 15 // 100) + 14


def keys_of(s: np.ndarray, percent: int, prefixes: bool = False) -> tuple[np.ndarray, bool]:
    """The candidate keys of a set (see the module's second step), and whether it fills too few parts to be sure of its links.

    prefixes: with the elements of its prefix, for when some set does.
    """
    n, small, short = len(s), small_sets(percent), False
    out = [np.empty(0, np.uint64)]
    if prefixes:
        out.append(mixed(np.sort(mixed(s ^ _B))[: n - -(-percent * n // 100) + 1]))
    if percent * n <= 100 * small:
        prefix = mixed(s[: n - -(-percent * n // 100) + 2] ^ _C)
        i, j = np.triu_indices(len(prefix), 1)
        out.append(mixed(prefix[i] * _A + prefix[j] * _B))
    if n > small:
        each, k = mixed(s ^ _C), most_different(n, percent)
        band = (n // (small + 1)).bit_length() - 1
        near = 100 * n >= percent * ((small + 1) << (band + 1))  # it may link with the next band
        for i in (band, band + 1)[: 1 + near]:
            top = (small + 1) << (i + 1)
            most = most_different(top, percent)
            parts = parts_of(most, top, percent)
            part = (mixed(s + np.uint64((i + 1) * int(_B) & _MASK)) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part = part[order]
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            short |= len(begin) < k + 1
            end = int(begin[k + 1]) if len(begin) > k + 1 else n
            begin = begin[: k + 1]
            content = np.add.reduceat(each[order][:end], begin)
            out.append(mixed(content * _A + part[begin] * _B + np.uint64((i + 2) * int(_C) & _MASK)))
    return np.unique(np.concatenate(out) >> np.uint64(16)), short


def signatures(docs: DataFrame, size: int, percent: int, prefixes: bool = False) -> DataFrame:
    """doc_id, row (a number of its own), n, set (128-bit hash of the shingle set), keys, short (see keys_of)."""

    def run(batches):
        from pyspark import TaskContext

        words, row = WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t.as_py() or b"", size, words) for t in part.column(1)]
                number, row = np.arange(row, row + len(sets)), row + len(sets)
                found = [keys_of(s, percent, prefixes) if len(s) else (np.empty(0, np.uint64), False) for s in sets]
                keys = [k.view(np.int64) for k, _ in found]
                offsets = np.cumsum([0] + [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(number, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)]))), pa.array([x for _, x in found], pa.bool_())],
                    ["doc_id", "row", "n", "set", "keys", "short"],
                )

    return docs.mapInArrow(run, "doc_id long, row long, n long, set binary, keys array<long>, short boolean")


def own_bitmap(s: np.ndarray) -> bytes:
    return bitmaps([s], own_width(len(s)))[0].tobytes()


def with_sets(docs: DataFrame, places: DataFrame, size: int, form=np.ndarray.tobytes) -> DataFrame:
    """places (node and other columns) with the sorted shingle hashes of the node's text, as bytes in s (or their
    form()), and how many they are in size."""
    columns = places.columns

    def run(batches):
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t.as_py() or b"", size, words) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([len(s) for s in sets], pa.int64()), pa.array([form(s) for s in sets], pa.binary())], [*columns, "size", "s"])

    # Spark sends out the ids alone, sorted and so small, up to its broadcast threshold; beyond it, texts are shuffled.
    ids = _sorted(places.select("node").distinct(), "node", "jaccard-ids")
    wanted = docs.join(ids.withColumnRenamed("node", "wanted"), docs["doc_id"] == F.col("wanted"), "left_semi")
    rows = wanted.join(places, docs["doc_id"] == places["node"]).select("text", *[places[c] for c in columns])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema.fields)
    return rows.mapInArrow(run, f"{schema}, size long, s binary")


def _sorted(df: DataFrame, column: str, label: str) -> DataFrame:
    """df written in order of a column, which Parquet then stores in few bytes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, column).sortWithinPartitions(column), label)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits), bool)
    for i, s in enumerate(sets):
        out[i, mixed(s + _B) & np.uint64(bits - 1)] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def own_width(n: int) -> int:
    """The bits of a set's own bitmap: a power of two, at least its size."""
    return max(64, 1 << int(n - 1).bit_length())


def folded(bits: int, width: int, to: int) -> int:
    """A bitmap at half its width, again and again: the bitmap that hashing to fewer bits would have given."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def plausible(n: int, a: int, m: int, b: int, percent: int) -> bool:
    """Whether sets of n and m with own bitmaps a and b may link: differing bits bound the overlap from above."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    width = min(own_width(n), own_width(m))
    apart = (folded(a, own_width(n), width) ^ folded(b, own_width(m), width)).bit_count()
    bound = (n + m - apart) // 2
    return 100 * bound >= percent * (n + m - bound)


def candidate_links(keys, nodes, roots, sides, sizes, maps, percent: int):
    """Links that the bitmaps can't exclude between nodes of a key and of different components, enough to bring both nodes
    of every such pair into one group.

    keys tell the tiles apart; nodes that one key has brought together are not compared again for another. Nothing is
    verified here, so a link says nothing about the other nodes of its two components: nodes are grouped, not components.
    """
    group = {int(x): int(x) for x in set(nodes.tolist())}

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    links = []
    order = np.lexsort((sizes, keys))
    keys, nodes, roots, sides, sizes = (x[order].tolist() for x in (keys, nodes, roots, sides, sizes))
    maps = [int.from_bytes(maps[i], "little") for i in order]
    begin = 0
    for i in range(len(keys)):
        if keys[i] != keys[begin]:
            begin = i
        while 100 * sizes[begin] < percent * sizes[i]:
            begin += 1
        mine = find(nodes[i])
        for j in range(i - 1, begin - 1, -1):
            if roots[i] != roots[j] and (sides[i] < 0 or sides[i] != sides[j]) and (other := find(nodes[j])) != mine and plausible(sizes[i], maps[i], sizes[j], maps[j], percent):
                links.append((nodes[i], nodes[j]))
                group[max(mine, other)] = mine = min(mine, other)
    return links


def tile_links(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int):
    """Verified links that connect different components among the sets of one tile.

    sides: -1 for a block compared with itself; else only sets of different sides are compared.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, roots, sides = nodes[order], roots[order].copy(), sides[order]
    sets = [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    links = []
    lo = 0
    while lo < len(sets):
        # A band: sizes under twice its smallest, and the smaller sets that they may link with.
        hi = int(np.searchsorted(size, 2 * size[lo], "left")) if size[lo] else lo + 1
        hi = max(hi, lo + 1)
        from_ = int(np.searchsorted(size, -(-percent * size[lo] // 100), "left"))
        bits = max(64, 1 << int(4 * size[hi - 1] - 1).bit_length())
        step = max(1, (64 << 20) // bits)
        maps = np.concatenate([bitmaps(sets[k : min(k + step, hi)], bits) for k in range(from_, hi, step)])
        for i in range(lo, hi):
            first = int(np.searchsorted(size, -(-percent * size[i] // 100), "left"))
            others = np.arange(first, i)
            others = others[roots[others] != roots[i]]
            if sides[i] >= 0:
                others = others[sides[others] != sides[i]]
            if not len(others):
                continue
            apart = np.bitwise_count(maps[others - from_] ^ maps[i - from_]).sum(1, dtype=np.int64)
            total = size[others] + size[i]
            bound = (total - apart) // 2  # the overlap is this at most
            others = others[100 * bound >= percent * (total - bound)]
            while len(others):
                j, others = others[-1], others[:-1]
                if linked(sets[i], sets[j], percent):
                    links.append((int(nodes[i]), int(nodes[j])))
                    roots[roots == roots[j]] = roots[i]
                    others = others[roots[others] != roots[i]]
        lo = hi
    return links


def _arrow_links(links) -> pa.Table:
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table["s"].to_pylist()]


def packed_keys(nodes: DataFrame, buckets: int) -> DataFrame:
    """bucket, keys, nodes, centres: packed arrays of (key, node), sorted by key.

    A task joins its own nodes of equal keys (centres set, buckets from `buckets` on) and hands on one of them a key.
    """

    def pack(bucket, keys, nodes, centres):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in (np.diff(keys, prepend=0).astype("<i8").tobytes(), nodes.astype("<i8").tobytes(), None if centres is None else centres.astype("<i8").tobytes())]], ["bucket", "keys", "nodes", "centres"])

    def deal(keys, nodes, salt):
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
        run = np.cumsum(first) - 1
        many = np.bincount(run)[run] > 1 if len(run) else first
        if many.any():
            yield pack(buckets + salt % buckets, keys[many], nodes[many], nodes[first][run[many]])
        keys, nodes = keys[first], nodes[first]
        bucket = (mixed(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                yield pack(k, keys[order[i:j]], nodes[order[i:j]], None)

    def run(batches):
        from pyspark import TaskContext

        salt, held, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            n = batch.column(1).value_lengths().to_numpy()
            held.append((batch.column(1).flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), n)))
            size += len(held[-1][0])
            if size >= DEAL_KEYS:
                yield from deal(*map(np.concatenate, zip(*held)), salt)
                held, size = [], 0
        if size:
            yield from deal(*map(np.concatenate, zip(*held)), salt)

    return nodes.select("doc_id", "keys").mapInArrow(run, "bucket int, keys binary, nodes binary, centres binary")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """key, node, centre of the keys of two nodes or more."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(table: pa.Table) -> pa.Table:
        out = []
        open_ = [], []
        for k, n, c in zip(table["keys"].to_pylist(), table["nodes"].to_pylist(), table["centres"].to_pylist()):
            keys, ns = np.cumsum(np.frombuffer(k, "<i8")), np.frombuffer(n, "<i8")
            if c is None:
                open_[0].append(keys)
                open_[1].append(ns)
            else:
                out.append((keys, ns, np.frombuffer(c, "<i8")))
        if open_[0]:
            keys, ns = map(np.concatenate, open_)
            order = np.lexsort((ns, keys))
            keys, ns = keys[order], ns[order]
            first = np.append(True, keys[1:] != keys[:-1])
            number = np.cumsum(first) - 1
            many = np.bincount(number)[number] > 1
            out.append((keys[many], ns[many], ns[first][number[many]]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("key", "node", "centre"), columns)})

    return packed_keys(nodes, 4 * parts).groupBy("bucket").applyInArrow(meet, "key long, node long, centre long")


def star_links(docs: DataFrame, shared: DataFrame, maps: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of nodes with the centre they share most keys with, where the bitmaps allow one; big stars are dealt over
    blocks, each with the centre."""
    pairs = shared.where("node != centre").groupBy("node", "centre").agg(F.count("*").alias("k"))
    best = pairs.groupBy("node").agg(F.max_by("centre", F.struct(F.col("k"), -F.col("centre"))).alias("centre"))
    near = best.join(maps, "node").join(maps.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("s").alias("t")), "centre")

    def allowed(batches):
        for b in batches:
            n, s, m, t = (b.column(c).to_pylist() for c in ("n", "s", "m", "t"))
            ok = [plausible(i, int.from_bytes(x, "little"), j, int.from_bytes(y, "little"), percent) for i, x, j, y in zip(n, s, m, t)]
            yield b.select(["node", "centre"]).filter(pa.array(ok, pa.bool_()))

    best = materialize(near.select("node", "centre", "n", "s", "m", "t").mapInArrow(allowed, "node long, centre long").distinct(), "jaccard-stars")
    blocks = best.groupBy("centre").agg(F.ceil(F.count("*") / STAR_SETS).cast("int").alias("blocks"))
    arms = best.join(blocks, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    hubs = blocks.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    places = materialize(arms.unionByName(hubs), "jaccard-places")

    def verify(table: pa.Table) -> pa.Table:
        nodes, centres, sets = table["node"].to_pylist(), table["centre"].to_pylist(), _sets(table)
        hubs = [s for n, c, s in zip(nodes, centres, sets) if n == c]
        return _arrow_links([(n, c) for n, c, s in zip(nodes, centres, sets) if n != c and any(linked(s, h, percent) for h in hubs)])

    return with_sets(docs, places, size).groupBy("centre", "block").applyInArrow(verify, "a long, b long")


def open_tiles(known: DataFrame) -> DataFrame:
    """key, node, root, side, tile of keys whose nodes lie in different components; known is (key, node, root).

    A key of more than BLOCK_SETS nodes is cut into blocks by component; pairs of blocks of one component are left out.
    """
    keys = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo != hi")
    keys = materialize(keys.select("key", "c"), "jaccard-open")
    rows = known.join(keys, "key")
    small = rows.where(F.col("c") <= BLOCK_SETS).select("node", "root", F.lit(-1).alias("side"), F.col("key").alias("tile"), F.col("key").alias("grp"))
    large = rows.where(F.col("c") > BLOCK_SETS).select("node", "root", F.col("key").alias("grp"), F.lit(0).cast("long").alias("n"))
    return small.unionByName(tiles_of(large))


def candidate_places(shared: DataFrame, roots: DataFrame, maps: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The tiles of exact comparison: of the groups that links which the bitmaps can't exclude connect."""
    known = shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    tiles = open_tiles(known).join(maps, "node")
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.withColumn("bin", F.pmod(F.xxhash64("tile"), F.lit(16 * parts)).cast("int"))

    def compare(t: pa.Table) -> pa.Table:
        columns = (t[c].to_numpy() for c in ("tile", "node", "root", "side", "n"))
        return _arrow_links(candidate_links(*columns, t["s"].to_pylist(), percent))

    maybe = tiles.select("bin", "tile", "node", "root", "side", "n", "s").groupBy("bin").applyInArrow(compare, "a long, b long")
    maybe = materialize(maybe, "jaccard-candidates")
    groups = components(maybe, "jaccard-groups")
    grouped = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    nodes = grouped.select("node", F.col("root").alias("grp")).join(roots, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("root"))
    return tiles_of(nodes.join(sizes, "node").select("node", "root", "grp", "n"))


def tiles_of(nodes: DataFrame) -> DataFrame:
    """node, root, side, tile, grp of nodes (node, root, grp, n): pairs of blocks of a group that hold different components."""
    # Blocks: runs of (component, size) order of bounded count and shingles. A component of a group is first summed up
    # by hash slices, so that no window runs over more than the slices of a group.
    slice_ = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("members") / 512))).cast("int")
    members = nodes.groupBy("grp", "root").agg(F.count("*").alias("members"))
    nodes = nodes.join(members, ["grp", "root"]).select("node", "root", "grp", "n", slice_.alias("slice"))
    sums = nodes.groupBy("grp", "root", "slice").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    run = Window.partitionBy("grp").orderBy("root", "slice").rowsBetween(Window.unboundedPreceding, -1)
    number = F.greatest(F.coalesce(F.sum("c").over(run), F.lit(0)) / BLOCK_SETS, F.coalesce(F.sum("m").over(run), F.lit(0)) / BLOCK_SHINGLES)
    sums = sums.select("grp", "root", "slice", F.floor(number).alias("block"))
    nodes = materialize(nodes.join(sums, ["grp", "root", "slice"]).select("node", "root", "grp", "block"), "jaccard-blocks")
    blocks = nodes.groupBy("grp", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    other = blocks.select("grp", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # Pairs of blocks of one group (not of documents), without those that hold one component only.
    tiles = blocks.join(other, "grp").where("block <= block2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    tiles = tiles.withColumn("tile", F.xxhash64("grp", "block", "block2"))
    same = F.col("block") == F.col("block2")
    uses = tiles.select("grp", "block", F.when(same, -1).otherwise(0).alias("side"), "block2", "tile").unionByName(
        tiles.where(~same).select("grp", F.col("block2").alias("block"), F.lit(1).alias("side"), F.col("block").alias("block2"), "tile")
    )
    return materialize(nodes.join(uses, ["grp", "block"]).select("node", "root", "side", "tile", "grp"), "jaccard-tiles")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    with scratch(docs.sparkSession, "jaccard-signatures", "jaccard-sets", "jaccard-components"):
        return _components(docs, size, percent, id_col, text_col)


def _components(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = materialize(signatures(rows, size, percent), "jaccard-signatures")
    if not signed.where("short").isEmpty():
        signed = materialize(signatures(rows, size, percent, prefixes=True), "jaccard-signatures")
    with_id = signed.where("doc_id IS NOT NULL AND n > 0")
    sets = with_id.groupBy("set").agg(F.min(F.struct("doc_id", "row", "n")).alias("r"))
    sets = materialize(sets.select("set", F.col("r.doc_id").alias("node"), F.col("r.row").alias("row"), F.col("r.n").alias("n")), "jaccard-sets")
    # Rows whose set another row stands for; their keys are dropped before anything is shuffled by key.
    copies = with_id.select("set", F.col("row").alias("copy")).join(sets.select("set", "row"), "set").where("copy != row").select("copy")
    copies = _sorted(copies, "copy", "jaccard-copies")
    nodes = with_id.join(copies, F.col("row") == F.col("copy"), "left_anti")

    shared = materialize(shared_keys(nodes), "jaccard-keys")
    sizes = sets.groupBy("node").agg(F.max("n").alias("n"))
    wanted = shared.select("node").distinct()
    maps = materialize(with_sets(rows, wanted, size, own_bitmap).select("node", F.col("size").alias("n"), "s"), "jaccard-bitmaps")
    links = materialize(star_links(rows, shared, maps, size, percent), "jaccard-star-links")
    roots = components(links, "jaccard-roots")
    places = candidate_places(shared, roots, maps, sizes, percent)

    def tile(table: pa.Table) -> pa.Table:
        return _arrow_links(tile_links(table["node"].to_numpy(), table["root"].to_numpy(), table["side"].to_numpy(), _sets(table), percent))

    more = with_sets(rows, places, size).groupBy("grp", "tile").applyInArrow(tile, "a long, b long")
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "jaccard-components")

    of_set = sets.join(final, "node", "left").select("set", F.coalesce("root", "node").alias("component_id"))
    return signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set")).alias("set")).join(of_set, "set", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are linked with a document of a smaller id."""
    name = "gone"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    with scratch(docs.sparkSession, "jaccard-gone"):
        found = jaccard_components(docs, size, percent, id_col, text_col)
        gone = _sorted(found.where("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct(), name, "jaccard-gone")
    return docs.join(gone, docs[id_col] == F.col(name), "left_anti")


def op2_jaccard_join(spark, sf_dir):
    return jaccard_components(read_table(spark, sf_dir, "documents"), size=3, percent=90)
