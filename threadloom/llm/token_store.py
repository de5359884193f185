"""Token-ID output: a content-addressed store of token ids.

Files under one folder (Parquet):
  chunks/    key (SHA-256 of the ids), ids (little-endian unsigned 32-bit); every distinct chunk once
  recipes/   part, pos, doc_id, start, n_tokens, keys, ends, root; in ascending doc_id order, start counts the ids before
  manifest/  level, part, node, root: a Merkle tree of FAN children a node over the documents; the top level is one root

A rolling hash over the last WINDOW ids cuts a stream where its low bits are zero, MIN_CHUNK to MAX_CHUNK ids apart,
so equal passages cut alike wherever they stand. A document's root is the Merkle root over its chunk keys. The leaves
of the manifest's tree hold a document's id, place, ends and root; each level joins runs of FAN neighbours, first within
the parts of recipes/, then over the parts, so no step gathers more than FAN digests. Reading verifies: each chunk
against its key, each document against its root, all documents against the manifest.

Defined cases: a null text is empty and is the end id alone; null doc_ids come first; rows that repeat a doc_id are
stored one by one, next to each other; an empty table gives an empty store; only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import fresh_path, materialize, read_table, scratch
from threadloom.llm.encoding import encoder_of, shared_tokenizer, slices

END_ID = 0
WINDOW, MIN_CHUNK, MAX_CHUNK, CUT_BITS = 12, 128, 4096, 9
FAN = 1024
CRC_POLY = 0xEDB88320


def gear(ids: np.ndarray) -> np.ndarray:
    """A mixed 32-bit value for each id."""
    x = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(13))


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Where the chunks of one id stream end."""
    n = len(ids)
    g = gear(ids)
    rolling = g.copy()
    for k in range(1, min(WINDOW, n)):
        rolling[k:] += g[:-k] << np.uint32(k)
    wanted = np.flatnonzero(((rolling >> np.uint32(WINDOW)) & np.uint32((1 << CUT_BITS) - 1)) == 0) + 1
    ends, last = [], 0
    for at in wanted.tolist():
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if at - last >= MIN_CHUNK:
            ends.append(at)
            last = at
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def merkle_root(keys: list[bytes]) -> bytes:
    """Pairwise SHA-256; leaves and inner nodes are told apart, an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + k).digest() for k in keys]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _multmodp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    a, b = a.astype(np.uint32), b.astype(np.uint32).copy()
    out = np.zeros_like(b)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(CRC_POLY), np.uint32(0))
    return out


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a piece with this CRC-32 adds (by exclusive or) to the CRC of a stream in which n_bytes follow it."""
    n = n_bytes.astype(np.uint64).copy()
    power = np.full(len(n), 0x00800000, np.uint32)  # x^8
    out = np.asarray(crc, np.uint32)
    while n.any():
        out = np.where(n & np.uint64(1), _multmodp(power, out), out)
        power = _multmodp(power, power)
        n >>= np.uint64(1)
    return out


def encode_and_cut(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """part, row, doc_id, n_tokens, root, first (chunks of the task before), chunks (key, end, ids)."""
    shared = shared_tokenizer(docs.sparkSession, tokenizer_path)

    def run(batches):
        from pyspark import TaskContext

        part, row, first = TaskContext.get().partitionId(), 0, 0
        encoder = encoder_of(*shared.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                out = []
                for ids in encoder.encode(texts[a:b]):
                    ids = np.append(ids, np.uint32(END_ID))
                    raw = ids.astype("<u4").tobytes()
                    cuts = [4 * c for c in chunk_ends(ids)]
                    parts = [raw[i:j] for i, j in zip([0, *cuts], cuts)]
                    keys = [hashlib.sha256(p).digest() for p in parts]
                    out.append((part, row, len(raw) // 4, merkle_root(keys), first, [{"key": k, "end": c // 4, "ids": p} for k, c, p in zip(keys, cuts, parts)]))
                    row, first = row + 1, first + len(parts)
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), batch.column(0).slice(a, b - a), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64()),
                     pa.array(cols[5], pa.list_(pa.struct([("key", pa.binary()), ("end", pa.int64()), ("ids", pa.binary())])))],
                    ["part", "row", "doc_id", "n_tokens", "root", "first", "chunks"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "part int, row long, doc_id long, n_tokens long, root binary, first long, chunks array<struct<key binary, end long, ids binary>>")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode docs and write the store under path."""
    spark = docs.sparkSession
    with scratch(spark):
        raw = materialize(encode_and_cut(docs, tokenizer_path, id_col, text_col), "token-log")

        # Each distinct chunk has one home: the first (part, number) that holds it. Only keys are shuffled for this.
        each = raw.select("part", F.posexplode("chunks.key").alias("i", "key"), "first").select("part", (F.col("first") + F.col("i")).alias("at"), "key")
        homes = each.groupBy("key").agg(F.min(F.struct("part", "at")).alias("home")).select("home.part", "home.at")
        # The homes of a part as bits, 64 to a word: so small beside the chunks that Spark can send them out up to its
        # broadcast threshold, and joins by shuffle beyond it.
        bits = homes.groupBy("part", F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("b"))
        bits = materialize(bits.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("bits")), "token-homes")
        _write_homes(raw, bits, f"{path}/chunks")

        recipes = raw.select("doc_id", "n_tokens", F.col("chunks.key").alias("keys"), F.col("chunks.end").alias("ends"), "root")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = recipes.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
        local = materialize(ordered.mapInArrow(_number, "part int, pos long, doc_id long, local long, n_tokens long, keys array<binary>, ends array<long>, root binary"), "token-recipes")
        totals = local.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
        # One row a part, so this window is over as many rows as there are parts.
        before = totals.select("part", (F.expr("sum(tokens) over (order by part)") - F.col("tokens")).alias("before"))
        placed = local.join(before, "part").select("part", "pos", "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "keys", "ends", "root")
        placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _write_tree(spark.read.parquet(f"{path}/recipes"), f"{path}/manifest")
    return path


def _write_tree(recipes: DataFrame, path: str) -> None:
    """The levels of the tree, each from the one before as written, up to a single root."""
    spark, level, nodes = recipes.sparkSession, 0, _leaves(recipes)
    while True:
        nodes.select(F.lit(level).alias("level"), "part", "node", "root").write.mode("append").parquet(path)
        written = spark.read.parquet(path).where(F.col("level") == level)
        count, last = written.agg(F.count("*"), F.max("node")).first()
        if count <= 1:
            return
        nodes, level = _joined(_over_parts(written) if last == 0 else written), level + 1


def _leaves(recipes: DataFrame) -> DataFrame:
    """part, node (a run of FAN documents), root: what a document's recipe says, hashed, and runs of them joined."""
    number = lambda c: F.coalesce(F.hex(c), F.lit("-"))
    said = F.concat_ws(",", number(F.col("doc_id")), number(F.col("start")), number(F.col("n_tokens")), F.array_join(F.transform("ends", F.hex), "."), F.hex("root"))
    return _joined(recipes.select("part", F.col("pos").alias("node"), F.unhex(F.sha2(F.concat(F.lit("0,"), said), 256)).alias("root")))


def _over_parts(nodes: DataFrame) -> DataFrame:
    """The roots of all parts as nodes of one."""
    return nodes.select(F.lit(0).alias("part"), F.col("part").cast("long").alias("node"), "root")


def _joined(nodes: DataFrame) -> DataFrame:
    """The next level: each run of FAN neighbours as one node."""
    run = nodes.groupBy("part", F.expr(f"node div {FAN}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("all"))
    hexes = F.array_join(F.transform("all", lambda x: F.concat(F.hex(x["node"]), F.lit(":"), F.hex(x["root"]))), ",")
    return run.select("part", "node", F.unhex(F.sha2(F.concat(F.lit("1,"), hexes), 256)).alias("root"))


def _write_homes(raw: DataFrame, bits: DataFrame, path: str) -> None:
    def keep(c, i):
        at = F.col("first") + i
        return F.getbit(F.coalesce(F.try_element_at(F.col("near"), (F.floor(at / 64) - F.floor(F.col("first") / 64) + 1).cast("int")), F.lit(0).cast("long")), F.pmod(at, F.lit(64)).cast("int")) == 1

    # The words of a document's own chunks, looked up once each.
    span = F.sequence(F.floor(F.col("first") / 64), F.floor((F.col("first") + F.size("chunks") - 1) / 64))
    near = F.transform(span, lambda w: F.try_element_at(F.col("bits"), w))
    own = raw.select("part", "first", "chunks").join(bits, "part").select("first", "chunks", near.alias("near"))
    own.select(F.explode(F.filter("chunks", keep)).alias("c")).select("c.key", "c.ids").write.option("compression", "zstd").parquet(path)


def _number(batches):
    """Adds the number of the part, and the documents and ids of the part before each document."""
    from pyspark import TaskContext

    part, pos, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = np.cumsum(n) + before
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(pos, pos + len(n))), batch.column(0), pa.array(ends - n), *batch.columns[1:]], ["part", "pos", "doc_id", "local", "n_tokens", "keys", "ends", "root"])
        pos += len(n)
        before = int(ends[-1]) if len(n) else before


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """key, ids of every chunk, each verified against its key."""
    chunks = spark.read.parquet(f"{path}/chunks")
    ok = F.unhex(F.sha2("ids", 256)) == F.col("key")
    return chunks.select("key", F.when(ok, F.col("ids")).otherwise(F.raise_error(F.lit("a chunk differs from its key")).cast("binary")).alias("ids"))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes whose documents agree with their roots and, all together, with the manifest's tree.

    Checking the tree runs one job over the recipes before anything is returned.
    """

    def verify(batches):
        for batch in batches:
            for keys, root in zip(batch.column("keys").to_pylist(), batch.column("root").to_pylist()):
                if merkle_root(keys) != root:
                    raise ValueError("a recipe differs from its root")
            yield batch

    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    levels = {r["level"]: (r["n"], r["last"]) for r in manifest.groupBy("level").agg(F.count("*").alias("n"), F.max("node").alias("last")).collect()}  # a row a level
    found, top = _leaves(recipes).withColumn("level", F.lit(0)), max(levels, default=0)
    if levels.get(top, (0, 0))[0] > 1 or sorted(levels) != list(range(len(levels))):
        raise ValueError("the manifest has no root")
    for k in range(top):
        below = manifest.where(F.col("level") == k)
        found = found.unionByName(_joined(_over_parts(below) if levels[k][1] == 0 else below).withColumn("level", F.lit(k + 1)))
    both = manifest.withColumnRenamed("root", "wanted").join(found, ["level", "part", "node"], "full_outer")
    if not both.where(~F.col("root").eqNullSafe(F.col("wanted"))).isEmpty():
        raise ValueError("the recipes differ from the manifest")
    return recipes.mapInArrow(verify, recipes.schema)


def root_of(spark: SparkSession, path: str) -> bytes | None:
    """The root of the whole store; None for an empty one. Equal stores have equal roots."""
    top = spark.read.parquet(f"{path}/manifest").orderBy(F.col("level").desc()).first()
    return bytes(top["root"]) if top else None


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (bytes) of every document, reassembled from its chunks."""
    uses = read_recipes(spark, path).select("doc_id", "start", "n_tokens", F.posexplode("keys").alias("i", "key"))
    parts = uses.join(read_chunks(spark, path), "key").groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("p"))
    joined = F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return parts.select("doc_id", "start", "n_tokens", joined.alias("ids"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, without moving the ids of a document to one place.

    The CRC of a stream is the exclusive or of its chunks' CRCs, each shifted by the bytes that follow it.
    """
    chunks = read_chunks(spark, path).select("key", F.crc32("ids").alias("crc"), (F.octet_length("ids") / 4).cast("long").alias("n"))
    uses = read_recipes(spark, path).select("doc_id", "start", "n_tokens", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("ends").alias("end"))).alias("u"))
    # What follows a chunk: all ids less those up to its end.
    uses = uses.select("doc_id", "start", "n_tokens", F.col("u.key").alias("key"), (F.col("n_tokens") - F.col("u.end")).alias("after"))

    def shift(batches):
        for b in batches:
            got = crc_shifted(b.column("crc").to_numpy().astype(np.uint32), 4 * b.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(got.astype(np.int64)), b.column("n")], ["doc_id", "start", "wanted", "crc", "n"])

    read = uses.join(chunks, "key").select("doc_id", "start", "n_tokens", "after", "crc", "n").mapInArrow(shift, "doc_id long, start long, wanted long, crc long, n long")
    per = read.groupBy("doc_id", "start", "wanted").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n_tokens"))
    n = F.when(F.col("n_tokens") == F.col("wanted"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("chunks are missing")).cast("long"))
    return per.select("doc_id", "start", n.alias("n_tokens"), "ids_crc32")


def op4_token_store(spark, sf_dir):
    import public_tokenizers

    path = fresh_path(spark, "token-store")
    write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(spark, path)
