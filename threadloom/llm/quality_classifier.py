"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network with calibrated output.

Word vectors. A word is a run of letters and digits, or a run of other characters that aren't white space; case counts.
Each word has a fixed sparse random index vector (`NONZERO` entries of plus or minus one, from its hash). Its word vector is
the sum of the index vectors of its neighbours (`WINDOW` words to either side) over every text of the table, less the mean
vector and scaled to length one. Words share `BUCKETS` rows by hash, so the table of vectors has a fixed size whatever
the vocabulary.

Pooling. A document is the mean of its word vectors, and the mean of the products of adjacent ones (which tells repetition
apart). Network. Two layers in numpy, trained on the driver on at most `max_rows` labelled documents of each class (the
documented bound; the first by a hash of the id). A fifth of them is held back to fit the temperature that the output is
divided by, so that scores are probabilities.

Defined cases: a null or empty text, or one of white space alone, has a pooled vector of zeros and gets the score that the
network has for it. Labels that are null or neither 0 nor 1, rows without doc_id and documents whose labels disagree teach nothing. Of rows that
share a doc_id one text teaches. If fewer than two classes are known, every score is the smoothed share of class 1 (0.5 without labels).
Every row is scored by itself, repeated ones too; an empty table gives an empty one; only the named columns are read. Texts
beyond `CHUNK_CHARS` characters are read in pieces, cut at white space if there is any; windows end at a cut.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import read_table

BUCKETS = 1 << 15
DIMS = 64
NONZERO = 4
WINDOW = 2
BLOCK = 256
HIDDEN = 32
MAX_ROWS = 10_000
CHUNK_CHARS = 500_000
PRIOR = 3  # words of no direction that each document is taken to hold, so that a few words can't point far
THRESHOLD = 0.3
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point: 0 white space, 1 letter or digit, 2 other."""
    return np.fromiter((0 if chr(c).isspace() else 1 if chr(c).isalnum() else 2 for c in range(0x110000)), np.uint8, 0x110000)


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket: the places of its index vector's entries, and their signs."""
    h = mixed(np.arange(BUCKETS * NONZERO, dtype=np.uint64)).reshape(BUCKETS, NONZERO)
    # One entry in each of NONZERO equal slices, so entries never meet.
    width = DIMS // NONZERO
    place = (h % np.uint64(width)).astype(np.int64) + np.arange(NONZERO) * width
    return place, np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def pieces(texts: list[str]):
    """Lists of (number of the text, piece) with a bounded number of characters together."""
    held, size = [], 0
    for i, text in enumerate(texts):
        begin = 0
        while begin < len(text):
            end = begin + CHUNK_CHARS
            if end < len(text):
                cut = max(text.rfind(" ", begin, end), text.rfind("\n", begin, end))
                end = cut + 1 if cut > begin else end
            part = text[begin:end]
            begin = end
            if held and size + len(part) > CHUNK_CHARS:
                yield held
                held, size = [], 0
            held.append((i, part))
            size += len(part) + 1
    if held:
        yield held


def words_of(held: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Of a list of pieces: each word's bucket, and the piece that it stands in."""
    joined = "\n" + "\n".join(p for _, p in held) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    kind = kinds()[chars]
    edge = np.flatnonzero(np.diff(kind)) + 1
    start, end = edge, np.append(edge[1:], len(chars))
    inside = kind[start] != 0
    start, end = start[inside], end[inside]
    place = np.arange(len(chars), dtype=np.uint64)
    place -= np.repeat(np.append(0, edge), np.diff(np.concatenate([[0], edge, [len(chars)]]))).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(chars.astype(np.uint64) + (place << np.uint64(21))))])
    bucket = (mixed(total[end] - total[start]) % np.uint64(BUCKETS)).astype(np.int64)
    first = np.cumsum([1] + [len(p) + 1 for _, p in held])[:-1]
    return bucket, np.searchsorted(first, start, "right") - 1


def add_contexts(sums: np.ndarray, counts: np.ndarray, bucket: np.ndarray, piece: np.ndarray) -> None:
    """Adds, for every word, the index vectors of its neighbours."""
    place, sign = index_vectors()
    counts += np.bincount(bucket, minlength=BUCKETS)
    flat, weight = [], []
    for k in range(1, WINDOW + 1):
        near = piece[:-k] == piece[k:]
        a, b = bucket[:-k][near], bucket[k:][near]
        for own, other in ((a, b), (b, a)):
            flat.append((own[:, None] * DIMS + place[other]).ravel())
            weight.append(sign[other].ravel())
    if flat:
        sums += np.bincount(np.concatenate(flat), np.concatenate(weight), BUCKETS * DIMS).astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIMS vectors, learned from all texts. Tasks send blocks of counts; blocks are added in two levels."""
    blocks = BUCKETS // BLOCK

    def count(batches):
        sums, counts = np.zeros(BUCKETS * DIMS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for held in pieces([t or "" for t in batch.column(0).to_pylist()]):
                add_contexts(sums, counts, *words_of(held))
        table = np.concatenate([sums.reshape(BUCKETS, DIMS), counts[:, None]], 1).reshape(blocks, -1)
        some = np.flatnonzero(table.any(1))
        salt = int(table[:, -1].sum()) % 16
        yield packed(some, table[some], salt)

    def packed(at, rows, salt):
        data = [zlib.compress(r.astype("<i8").tobytes(), 1) for r in rows]
        return pa.RecordBatch.from_pydict({"block": pa.array(at, pa.int32()), "salt": pa.array([salt] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                got = np.frombuffer(zlib.decompress(data), "<i8")
                held[b] = held[b] + got if b in held else got
        if held:
            yield packed(np.array(sorted(held)), [held[b] for b in sorted(held)], 0)

    shape = "block int, salt int, data binary"
    counted = docs.select(text_col).mapInArrow(count, shape)
    once = counted.repartition("block", "salt").mapInArrow(add, shape)
    table = np.zeros((blocks, BLOCK * (DIMS + 1)), np.int64)
    for row in once.repartition("block").mapInArrow(add, shape).toLocalIterator():
        table[row["block"]] = np.frombuffer(zlib.decompress(row["data"]), "<i8")
    table = table.reshape(BUCKETS, DIMS + 1)
    return unit(table[:, :DIMS].astype(np.float64), table[:, DIMS])


def unit(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = sums / np.maximum(length, 1e-9)
    if counts.sum():
        # What all words share says nothing; frequent words weigh by the root of their count.
        weight = np.sqrt(counts)[:, None]
        vectors = np.where(length > 0, vectors - (vectors * weight).sum(0) / weight.sum(), 0)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """For each text, the mean vector of its words and the mean product of adjacent ones."""
    out, n, pairs = np.zeros((len(texts), 2 * DIMS)), np.zeros(len(texts)), np.zeros(len(texts))
    for held in pieces(texts):
        bucket, piece = words_of(held)
        if not len(bucket):
            continue
        own = np.array([i for i, _ in held])
        at, begin = np.unique(piece, return_index=True)
        got = vectors[bucket]
        np.add.at(out[:, :DIMS], own[at], np.add.reduceat(got, begin, 0, np.float64))
        n += np.bincount(own[piece], minlength=len(texts))
        product = got[:-1] * got[1:]
        product[piece[:-1] != piece[1:]] = 0
        product = np.concatenate([product, np.zeros((1, DIMS), np.float32)])
        np.add.at(out[:, DIMS:], own[at], np.add.reduceat(product, begin, 0, np.float64))
        pairs += np.bincount(own[piece[:-1][piece[:-1] == piece[1:]]], minlength=len(texts))
    out[:, :DIMS] /= (n + PRIOR)[:, None]
    out[:, DIMS:] *= DIMS / (pairs + PRIOR)[:, None]
    return out


class Network:
    """probability = sigmoid(two layers / temperature); inputs are scaled to mean 0 and deviation 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3):
        self.base = float((y.sum() + 1) / (len(y) + 2))
        self.known = 0 < y.sum() < len(y)
        if not self.known:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        back = order[: len(x) // 5]
        fit = order[len(x) // 5 :]
        if len(set(y[fit])) < 2:
            back, fit = order[:0], order
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        z = self.scaled(x)
        self.w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
                t += 1
                for i, g in enumerate(self.gradients(z[at], y[at])):
                    g = g + decay * self.w[i]
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(back):
            self.temperature = temperature(self.logits(z[back]), y[back])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def gradients(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(z @ self.w[0] + self.w[1])
        d = (sigmoid(h @ self.w[2] + self.w[3]) - y) / len(y)
        dh = np.outer(d, self.w[2]) * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.base)
        return sigmoid(self.logits(self.scaled(x)) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor that makes the held-back labels likeliest, by golden section over its logarithm."""

    def loss(t: float) -> float:
        p = np.clip(sigmoid(logits / np.exp(t)), 1e-12, 1 - 1e-12)
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    low, high, part = np.log(0.25), np.log(8.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def pool(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, x (float32 vector as binary) of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            x = pooled([t or "" for t in batch.column(1).to_pylist()], shared.value).astype("<f4")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x binary")


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label_col: str = "quality", max_rows: int = MAX_ROWS) -> Network:
    """Learns from labels of rows that aren't held out. 2 * max_rows ids are broadcast, and as many pooled vectors come back."""
    y = F.col(label_col).cast("int")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    agreed = given.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", "y")
    chosen = [agreed.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    one = pool(rows, vectors).groupBy("doc_id").agg(F.min("x").alias("x"))
    table = one.join(F.broadcast(ids), "doc_id").select("doc_id", "x", "y").toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    x = np.array([np.frombuffer(b, "<f4") for b in table["x"].to_pylist()], np.float64).reshape(-1, 2 * DIMS)[order]
    return Network(x, table["y"].to_numpy().astype(np.float64)[order])


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches):
        v, net = shared.value
        for batch in batches:
            x = pooled([t or "" for t in batch.column(1).to_pylist()], v).astype("<f4").astype(np.float64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(net.score(x), pa.float64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    vectors = word_vectors(docs)
    scored = score(docs, vectors, train(docs, labels, vectors, max_rows=max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op11_quality_classifier(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return classify(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
