"""Byte-level BPE by ranks: a global shuffle of distinct words, and decoding by the token-byte table.

1. Blocks of the corpus (BLOCK_BYTES of text of one task) cut their texts into words with positions: runs of pattern
   matches between places where a match always begins (see encoding.Units). A block keeps each distinct word once and
   its texts as sequences of word numbers. That packs the exploded (word, document, position) rows.
2. The blocks' distinct words are shuffled by hash, many to a row. All occurrences of a word meet in one partition,
   which encodes it once, and the ids go back to the blocks.
3. A block's texts and words meet; the ids are put in place of the word numbers, position by position.

Steps 1's two results (words, and texts as numbers) come from two passes over the input, so texts are never shuffled
with their words; a block whose passes differ fails instead of giving wrong ids. A frequent word is one row in each
block however often it occurs, and a block is bounded, so no key is hot.

Decoding looks each id up in the table of token bytes (the fixed vocabulary, sent to every task).

Defined cases: a null text is empty and has no ids; null and repeated doc_ids are encoded row by row; an empty table
gives an empty one; only id and text are read. The input is read twice, so what isn't a scan of files is written first.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, read_table
from threadloom.llm.encoding import TABLE_BYTES, TABLE_UNITS, Table, Units, pieces, ragged, slices

BLOCK_BYTES, BATCH_BYTES = 8_000_000, 2_000_000
BUCKETS_A_PARTITION = 4


def packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def squeezed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def widened(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _numbered(u: Units, new: np.ndarray):
    """Words that are only numbered."""
    yield new, np.empty(0, np.uint32), np.zeros(len(new), np.int32)


class Block:
    """The distinct words of some texts, numbered as they come, and the texts as numbers."""

    def __init__(self):
        self.table, self.size = Table(), 0

    def add(self, texts: list[bytes]):
        """The words of each text: how many, and their numbers."""
        parts = [x for t in texts for x in (pieces(t, BATCH_BYTES) if len(t) > 2 * BATCH_BYTES else [t])]
        counts, refs = [], []
        for a, b in slices(parts, len(parts) + 1, 2 * BATCH_BYTES):
            u = Units(parts[a:b])
            refs.append(self.table.numbers(u, _numbered).astype(np.uint32))
            counts.append(np.diff(u.first))
            self.size += len(u.data)
        counts = np.concatenate(counts)
        if len(parts) > len(texts):
            own = [len(pieces(t, BATCH_BYTES)) if len(t) > 2 * BATCH_BYTES else 1 for t in texts]
            counts = np.add.reduceat(counts, np.cumsum(own) - own)
        return counts, np.concatenate(refs)

    @property
    def count(self) -> int:
        return self.table.size

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all distinct words in order, and their lengths."""
        return self.table.data[: self.table.filled], self.table.length[: self.table.size].astype(np.int64)

    def hashes(self) -> np.ndarray:
        """Their hashes; 0 for a word whose hash another word has."""
        return self.table.own[: self.table.size]

    def mark(self) -> int:
        """Equal for equal words in equal order."""
        h = self.hashes()
        return int((h * (2 * np.arange(len(h), dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64) >> np.uint64(1))


def blocks_of(batches, block_bytes: int):
    """Runs over the batches of a task: yields (block id, block, doc ids, word counts, numbers), the last None at a block's end."""
    from pyspark import TaskContext

    number, block = TaskContext.get().partitionId() << 24, Block()
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        for a, b in slices(texts, most=BATCH_BYTES):
            counts, refs = block.add(texts[a:b])
            yield number, block, batch.column(0).slice(a, b - a), counts, refs
            if block.size >= block_bytes:
                yield number, block, None, None, None
                number, block = number + 1, Block()
    if block.size or block.count:
        yield number, block, None, None, None


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, stored: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every row; stored says that docs are a scan of files."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if not stored:
        rows = materialize(rows, "bpe-input")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_A_PARTITION * parts
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def words(batches):
        for number, block, ids, _, _ in blocks_of(batches, block_bytes):
            if ids is not None:
                continue
            data, size = block.words
            begin = np.cumsum(size) - size
            bucket = (block.hashes() >> np.uint64(7)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            out, mark = [], block.mark()
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    own = order[i:j]
                    out.append((number, k, packed(np.diff(own, prepend=0)), packed(size[own]), squeezed(data[ragged(begin[own], size[own])].tobytes()), mark))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:5]], pa.array(cols[5], pa.int64())], ["block", "bucket", "numbers", "sizes", "words", "mark"]
            )

    def texts(batches):
        for number, block, ids, counts, refs in blocks_of(batches, block_bytes):
            if ids is not None:
                row = (ids.to_pylist(), packed(counts), packed(refs), None, None)
            else:
                row = (None, None, None, block.count, block.mark())
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "ids": pa.array([row[0]], pa.list_(pa.int64())), "counts": pa.array([row[1]], pa.binary()), "refs": pa.array([row[2]], pa.binary()), "n_words": pa.array([row[3]], pa.int64()), "mark": pa.array([row[4]], pa.int64())})

    def encode_words(batches):
        import tiktoken

        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        table = Table()

        def learn(u, new):
            ids = [bpe.encode_ordinary(u.text(i).decode("utf-8", "replace")) for i in new.tolist()]
            count = np.array([len(x) for x in ids], np.int32)
            yield new, np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum())), count

        for batch in batches:
            block, numbers, sizes, found = (batch.column(c).to_pylist() for c in ("block", "numbers", "sizes", "words"))
            out_counts, out_ids = [], []
            for s, raw in zip(sizes, found):
                if table.size > TABLE_UNITS or table.bytes > TABLE_BYTES:
                    table = Table()
                number = table.numbers(Units.of(widened(raw), unpacked(s).astype(np.int64)), learn)
                count = table.count[number]
                out_counts.append(packed(count))
                out_ids.append(packed(table.ids[ragged(table.begin[number], count.astype(np.int64))]))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(numbers, pa.binary()), pa.array(out_counts, pa.binary()), pa.array(out_ids, pa.binary()), batch.column("mark")], ["block", "numbers", "counts", "ids", "mark"])

    def reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        runs = [(np.cumsum(unpacked(n)), unpacked(c).astype(np.int64), unpacked(i)) for n, c, i in zip(words["numbers"].to_pylist(), words["counts"].to_pylist(), words["ids"].to_pylist())]
        total = sum(len(n) for n, _, _ in runs)
        count, begin, at = np.full(total, -1, np.int64), np.zeros(total, np.int64), 0
        for n, c, i in runs:
            count[n], begin[n] = c, at + np.cumsum(c) - c
            at += len(i)
        ids = np.concatenate([*[i for _, _, i in runs], np.empty(0, np.uint32)])
        wanted = [n for n in texts["n_words"].to_pylist() if n is not None]
        marks = {m for t in (texts, words) for m in t["mark"].to_pylist() if m is not None}
        if wanted != [total] or (count < 0).any() or len(marks) > 1:
            raise ValueError("the words and the texts of a block come from different inputs")
        out = []
        for docs_, counts, refs in zip(texts["ids"], texts["counts"], texts["refs"]):
            docs_, counts, refs = docs_.as_py(), counts.as_py(), refs.as_py()
            if docs_ is None:
                continue
            refs = unpacked(refs)
            c = count[refs]
            got = ids[ragged(begin[refs], c)]
            ends = np.concatenate([[0], np.cumsum(c)])[np.concatenate([[0], np.cumsum(unpacked(counts).astype(np.int64))])].tolist()
            own = [got[i:j].astype("<u4").tobytes() for i, j in zip(ends, ends[1:])]
            out.append(pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(own, pa.binary())], schema=schema))
        return pa.Table.from_batches(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    dealt = rows.mapInArrow(words, "block long, bucket int, numbers binary, sizes binary, words binary, mark long").repartition(parts, "bucket")
    encoded = dealt.mapInArrow(encode_words, "block long, numbers binary, counts binary, ids binary, mark long")
    numbered = rows.mapInArrow(texts, "block long, ids array<long>, counts binary, refs binary, n_words long, mark long")
    return numbered.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(reassemble, "doc_id long, ids binary")


def _token_bytes(spark, ranks_path: str):
    """The table of token bytes, one entry an id: a fixed vocabulary, so it is sent to every task."""
    return spark.sparkContext.broadcast({i: token for token, i in read_ranks(ranks_path).items()})


def _decoded(raw: bytes, table: dict[int, bytes]) -> tuple[list[int], bytes]:
    ids = np.frombuffer(raw, "<u4").tolist()
    return ids, b"".join(map(table.__getitem__, ids))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (doc_id, ids) with the bytes that the ids stand for, as decoded."""
    table = _token_bytes(encoded.sparkSession, ranks_path)

    def run(batches):
        for batch in batches:
            got = [_decoded(x, table.value)[1] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the decimal ids and of the decoded bytes, in the pass that decodes."""
    table = _token_bytes(encoded.sparkSession, ranks_path)

    def run(batches):
        text = {i: b"%d" % i for i in table.value}.__getitem__
        for batch in batches:
            rows = []
            for x in batch.column(1):
                ids, raw = _decoded(x.as_py(), table.value)
                rows.append((len(ids), hashlib.sha256(b",".join(map(text, ids))).hexdigest(), hashlib.sha256(raw).hexdigest()))
            n, a, b = list(zip(*rows)) or ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digest(encode(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, stored=True), path)
