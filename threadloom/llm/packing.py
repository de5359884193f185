"""Packing: non-negative least squares over shallow length combinations.

A document of n tokens gives n // window full windows and a rest. The rests' lengths make a histogram of at most
window - 1 bins. Combinations of up to three lengths that fill a window (or one power of two, which needs no padding)
are enumerated; non-negative least squares solves how often to repeat each so that their sum meets the histogram; the
counts are rounded down. What is left over is packed greedily, longest first, each piece cut where a window is full,
so that of all sequences only the last can hold padding.

Only the histogram reaches the driver. A rest's place follows from its rank among the rests of its length: ranks are
counted within a task, and a table of counts per (task, length) gives each task's first rank. So neither a common
length nor a long document gathers in one task, and no step orders the corpus.

Defined cases: a null text is empty and is the end id alone; rows that repeat a doc_id are packed one by one; an
empty table gives no pieces; null doc_ids are kept; only id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import give_back, materialize, read_table, scratch
from threadloom.llm.encoding import encoder_of, shared_tokenizer, text_slices

SEQUENCE = 1024
END_ID = 0
#: The solver ends when CHECK rounds have lowered what is left unmet by less than this share.
TOLERANCE = 1e-3
CHECK = 25


def combinations(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """All combinations of up to three of the lengths present (at most window^2 / 12) that leave no padding."""
    here = hist > 0
    out = [(n,) for n in (1 << k for k in range(window.bit_length())) if n < window and here[n]]
    out += [(window - b, b) for b in range(1, window // 2 + 1) if here[b] and here[window - b]]
    lengths = np.flatnonzero(here)
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    c = window - a - b
    three = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[three], b[three], c[three]
    three = here[c]
    return out + list(zip(a[three].tolist(), b[three].tolist(), c[three].tolist()))


def nnls(combos: list[tuple[int, ...]], hist: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """min |A x - hist|^2 over x >= 0 by accelerated projected gradient; A counts a length in a combination.

    Each combination has a step of its own, from the sum of its row of A'A, which bounds A'A as A has no negative entry. The
    momentum is dropped whenever the objective would rise.
    """
    if not combos:
        return np.zeros(0)
    row = np.array([n for c in combos for n in c])
    col = np.array([i for i, c in enumerate(combos) for _ in c])
    mul = lambda x: np.bincount(row, x[col], len(hist))
    back = lambda y: np.bincount(col, y[row], len(combos))
    step = 1.0 / np.maximum(1.0, back(mul(np.ones(len(combos)))))
    x = y = np.zeros(len(combos))
    t, done, unmet = 1.0, 0, float((hist.astype(float) ** 2).sum())
    least, checked = 1e-9 * unmet, unmet
    while unmet > least:
        new = np.maximum(0.0, y - step * back(mul(y) - hist))
        now = float(((mul(new) - hist) ** 2).sum())
        if now > unmet:
            new = np.maximum(0.0, x - step * back(mul(x) - hist))
            t, now = 1.0, float(((mul(new) - hist) ** 2).sum())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t, unmet, done = new, t_new, now, done + 1
        if done % CHECK == 0:
            if checked - unmet <= tolerance * checked:
                break
            checked = unmet
    return x


class Plan:
    """Where the rest of length n and rank r goes: arrays sorted by (n, first rank)."""

    def __init__(self, hist: np.ndarray, window: int = SEQUENCE):
        self.window = window
        combos = combinations(hist, window)
        repeats = nnls(combos, hist.astype(float))
        left, used = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64)
        keys, seqs, offsets, ends = [], [], [], []
        sequence = 0
        # Rounded counts first, then each combination again for what is left of its lengths.
        order = np.argsort(-repeats, kind="stable").tolist()
        for final in (False, True):
            for i in order:
                combo = combos[i]
                each = {n: combo.count(n) for n in combo}
                can = min(left[n] // k for n, k in each.items())
                k = int(can if final else min(can, int(repeats[i])))
                if k <= 0:
                    continue
                at = 0
                for n in combo:
                    keys.append((n, int(used[n])))
                    ends.append(int(used[n]) + k)
                    seqs.append(sequence)
                    offsets.append(at)
                    used[n] += k
                    left[n] -= k
                    at += n
                sequence += k
        self.planned = sequence
        self.used = used
        # The greedy rest: one stream, longest pieces first, cut at every window.
        tokens = left * np.arange(len(hist))
        self.stream = np.zeros(len(hist), np.int64)
        self.stream[::-1] = np.concatenate([[0], np.cumsum(tokens[::-1])[:-1]])
        self.greedy = -(-int(tokens.sum()) // window)
        order = np.array(sorted(range(len(keys)), key=lambda i: keys[i]), np.int64)
        self.key = np.array([keys[i][0] << 44 | keys[i][1] for i in order], np.int64)
        self.first = np.array([keys[i][1] for i in order], np.int64)
        self.sequence = np.array([seqs[i] for i in order], np.int64)
        self.offset = np.array([offsets[i] for i in order], np.int64)

    @property
    def sequences(self) -> int:
        """Sequences before those of the full windows."""
        return self.planned + self.greedy

    def place(self, n: np.ndarray, rank: np.ndarray):
        """For each rest: sequence, offset, and how many tokens go to the next sequence instead."""
        planned = rank < self.used[n]
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        if len(self.key):
            at = np.maximum(np.searchsorted(self.key, n.astype(np.int64) << 44 | rank, "right") - 1, 0)
            seq, off = self.sequence[at] + rank - self.first[at], self.offset[at].copy()
        position = self.stream[n] + (rank - self.used[n]) * n
        seq = np.where(planned, seq, self.planned + position // self.window)
        off = np.where(planned, off, position % self.window)
        return seq, off, np.where(planned, 0, np.maximum(off + n - self.window, 0))


def encode(docs: DataFrame, tokenizer_path: str, window: int, id_col: str, text_col: str) -> DataFrame:
    """part, row, doc_id, n, rest and its rank in the task, windows before it in the task, CRCs, ids."""
    shared = shared_tokenizer(docs.sparkSession, tokenizer_path)

    def run(batches):
        from pyspark import TaskContext

        part, row, windows = TaskContext.get().partitionId(), 0, 0
        ranks = np.zeros(window, np.int64)
        encoder = encoder_of(*shared.value)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                out = []
                for ids in encoder.encode(texts):
                    raw = np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    full, rest = divmod(n, window)
                    crcs = [zlib.crc32(raw[4 * window * k : 4 * window * (k + 1)]) for k in range(full)]
                    out.append((part, row, n, rest, int(ranks[rest]), windows, crcs, zlib.crc32(raw[4 * window * full :]), raw))
                    ranks[rest] += 1
                    row, windows = row + 1, windows + full
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(c[0], pa.int32()), *[pa.array(x, pa.int64()) for x in c[1:6]], pa.array(c[6], pa.list_(pa.int64())), pa.array(c[7], pa.int64()), pa.array(c[8], pa.binary())],
                    ["doc_id", "part", "row", "n", "rest", "rank", "windows", "crcs", "rest_crc", "ids"],
                )
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part int, row long, n long, rest long, rank long, windows long, crcs array<long>, rest_crc long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (bytes)."""
    return _packed(docs, tokenizer_path, window, id_col, text_col, with_ids=True)


def pack_digest(docs: DataFrame, tokenizer_path: str, window: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack() without ids; ids are read again only for the pieces that the plan cuts."""
    with scratch(docs.sparkSession, "packing", "packing-pieces", "packing-cuts"):
        return _packed(docs, tokenizer_path, window, id_col, text_col, with_ids=False)


def _packed(docs, tokenizer_path, window, id_col, text_col, with_ids):
    encoded = materialize(encode(docs, tokenizer_path, window, id_col, text_col), "packing")
    rests = encoded.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("k"))
    full = encoded.groupBy("part").agg(F.sum(F.size("crcs")).alias("k")).select("part", F.lit(0).cast("long").alias("rest"), "k")
    counts = materialize(rests.unionByName(full), "packing-counts")
    hist = np.zeros(window, np.int64)
    for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("k").alias("k")).collect():  # at most window - 1 rows
        hist[r["rest"]] = r["k"]
    plan = Plan(hist, window)
    # The first rank of each task in each length; the windows of full sequences count as length 0.
    base = counts.select("part", "rest", (F.expr("sum(k) over (partition by rest order by part)") - F.col("k")).alias("base"))
    rows = encoded.select("doc_id", "part", "row", "n", "rest", "rank", "windows", "crcs", "rest_crc")
    zero = base.where("rest = 0").select("part", F.col("base").alias("window_base"))
    rows = rows.join(base.where("rest > 0"), ["part", "rest"], "left").join(zero, "part")
    rows = rows.select("doc_id", "part", "row", "n", "rest", (F.col("rank") + F.coalesce("base", F.lit(0).cast("long"))).alias("rank"), (F.col("windows") + F.col("window_base")).alias("window"), "crcs", "rest_crc")
    pieces = rows.mapInArrow(_pieces_of(plan), "doc_id long, part int, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long")
    ids = encoded.select("part", "row", "ids")
    own = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        return pieces.join(ids, ["part", "row"]).withColumn("ids", own).withColumn("ids_crc32", F.crc32("ids")).select(*columns, "ids")
    pieces = materialize(pieces, "packing-pieces")
    cut = materialize(pieces.where("ids_crc32 IS NULL"), "packing-cuts").join(ids, ["part", "row"]).withColumn("ids_crc32", F.crc32(own))
    return pieces.where("ids_crc32 IS NOT NULL").select(*columns).unionByName(cut.select(*columns))


def _pieces_of(plan: Plan):
    window = plan.window

    def run(batches):
        for b in batches:
            doc, part, row = b.column("doc_id"), b.column("part"), b.column("row")
            n, rest, rank, first = (b.column(c).to_numpy() for c in ("n", "rest", "rank", "window"))
            crc = b.column("rest_crc").to_numpy()
            full = n // window
            # Full windows, each a sequence of its own.
            src = np.repeat(np.arange(len(n)), full)
            nth = np.arange(len(src)) - np.repeat(np.cumsum(full) - full, full)
            yield _rows(doc, part, row, n, src, nth * window, np.full(len(src), window), b.column("crcs").flatten(), plan.sequences + first[src] + nth, np.zeros(len(src), np.int64))
            at = np.flatnonzero(rest > 0)
            seq, off, over = plan.place(rest[at], rank[at])
            whole = over == 0
            known = pa.array(crc[at], pa.int64(), mask=~whole)
            yield _rows(doc, part, row, n, at, (full * window)[at], rest[at] - over, known, seq, off)
            more = at[~whole]
            over = over[~whole]
            yield _rows(doc, part, row, n, more, n[more] - over, over, pa.nulls(len(more), pa.int64()), seq[~whole] + 1, np.zeros(len(more), np.int64))

    return run


def _rows(doc, part, row, n, src, start, length, crc, seq, off):
    take = pa.array(src, pa.int64())
    return pa.RecordBatch.from_arrays(
        [doc.take(take), part.take(take), row.take(take), pa.array(start, pa.int64()), pa.array(length, pa.int64()), crc, pa.array(n[src], pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
        ["doc_id", "part", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


def op10_packing(spark, sf_dir):
    import public_tokenizers

    return pack_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
