"""Vector functions in double precision, on arrays of float."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; null for different sizes or a zero norm."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale)))


def _cosines(column, query):
    """Cosines of an Arrow column of vectors (lists of float, or little-endian 32-bit bytes), and which have the query's size."""
    import numpy as np
    import pyarrow as pa

    n, width = len(column), len(query)
    raw = pa.types.is_binary(column.type)
    lengths = column.fill_null(b"" if raw else []).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.frombuffer(lengths.buffers()[1], np.int32, n + 1, 4 * lengths.offset)) // (4 if raw else 1) if n else np.empty(0, np.int64)
    if lengths.null_count:
        size = np.where(np.asarray(lengths.is_valid()), size, -1)
    fits, score = size == width, np.full(n, np.nan)
    at = np.flatnonzero(fits)
    if len(at):
        if len(at) < n:
            lengths = lengths.take(pa.array(at))
        if raw:
            begin = np.frombuffer(lengths.buffers()[1], np.int32, len(at) + 1, 4 * lengths.offset)
            m = np.frombuffer(lengths.buffers()[2], "<f4", (begin[-1] - begin[0]) // 4, int(begin[0]))
        else:
            m = lengths.flatten().to_numpy(zero_copy_only=False)
        m = m.reshape(len(at), width).astype(np.float64)
        scale = np.sqrt(np.einsum("ij,ij->i", m, m)) * float(np.sqrt((query * query).sum()))
        with np.errstate(divide="ignore", invalid="ignore"):
            score[at] = np.where(scale > 0, np.clip(m @ query / scale, -1.0, 1.0), np.nan)
    return score, fits


def with_cosine(rows: DataFrame, vector: str, query: list[float], score: str = "score", fits: str = "fits") -> DataFrame:
    """rows with the cosine of their vector and the query, and whether the sizes agree, in place of the vector.

    A batch of vectors is one matrix product. The score is null for another size, a zero norm or a value that is no number.
    """
    import numpy as np
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    others, q = [c for c in rows.columns if c != vector], np.asarray(query, np.float64)
    kept = rows.select(*others, vector)
    schema = StructType([*(f for f in kept.schema.fields if f.name != vector), StructField(score, DoubleType()), StructField(fits, BooleanType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s, ok = _cosines(b.column(len(others)), q)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(others))), pa.array(s, pa.float64(), mask=np.isnan(s)), pa.array(ok)], [*others, score, fits])

    return kept.mapInArrow(run, schema)


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """key, score of the k rows of the largest positive cosine, ties by key. A batch hands on no more than its own first k."""
    import numpy as np
    from pyspark.sql.types import DoubleType, StructField, StructType

    q, kept = np.asarray(query, np.float64), rows.select(key, vector)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s, _ = _cosines(b.column(1), q)
            at = np.flatnonzero(s > 0)
            if len(at) > k:
                at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]  # with all that tie with the k-th
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(s[at], pa.float64())], [key, "score"])

    return kept.mapInArrow(run, StructType([kept.schema[key], StructField("score", DoubleType())])).orderBy(F.col("score").desc(), key).limit(k)


def unit(a: Column) -> Column:
    """The vector over its norm; null for a zero or non-finite norm."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n))


def to_bytes(values) -> bytes:
    """Little-endian 32-bit floats, the stored form."""
    import numpy as np

    v = np.asarray(values, "<f4")
    if not len(v) or not np.isfinite(v).all() or not np.any(v):
        raise ValueError("a vector must be nonempty, finite and of nonzero norm")
    return v.tobytes()


def from_bytes(raw: bytes) -> list[float]:
    import numpy as np

    if not raw or len(raw) % 4:
        raise ValueError("not a vector")
    return np.frombuffer(raw, "<f4").tolist()
