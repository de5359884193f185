"""Vectors of chunks from an embedding service that is called from the tasks, in requests of bounded number and size."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from threadloom.functions.identity import backoff_ms
from threadloom.operators.requests import next_starts

VECTORS = "thread_id bigint, chunk_index int, chunk_count int, chunk_hash string, vector array<double>"


class ResponseError(ValueError):
    """A request that the service can't be sent, or an answer that no caller may use."""


@dataclass(frozen=True)
class Service:
    """call takes texts and gives a vector for each in order, or (index, vector) pairs in any order.

    A request holds at most `most` texts and most_bytes together, a text at most input_bytes. What fails to connect, or takes too long,
    is tried again up to `attempts` times within `seconds`, with growing pauses; anything else is an error at once.
    """

    call: Callable[[list[str]], list]
    most: int = 64
    most_bytes: int = 1 << 20
    input_bytes: int = 1 << 16
    dimensions: int | None = None
    attempts: int = 5
    seconds: float = 120.0
    pause: Callable[[float], None] = time.sleep

    def request(self, texts: list[str]) -> list[list[float]]:
        """The vectors of one request."""
        if any(not t.strip() for t in texts):
            raise ResponseError("a text without content")
        began = time.monotonic()
        for attempt in range(self.attempts):
            try:
                return self.checked(self.call(texts), len(texts))
            except (ConnectionError, TimeoutError):
                wait = backoff_ms(attempt) / 1000
                if attempt + 1 == self.attempts or time.monotonic() - began + wait >= self.seconds:
                    raise
                self.pause(wait)
        raise ResponseError("no attempts")

    def checked(self, answer: list, n: int) -> list[list[float]]:
        """The vectors in the order of the texts: all there, once each, of one size, finite, and not all zero."""
        answer = list(answer)
        if answer and all(isinstance(a, tuple) and len(a) == 2 and not hasattr(a[0], "__len__") for a in answer) and n == len(answer) and all(hasattr(a[1], "__len__") for a in answer):
            if sorted(i for i, _ in answer) != list(range(n)):
                raise ResponseError("an index is missing, repeated or unknown")
            answer = [v for _, v in sorted(answer, key=lambda a: a[0])]
        if len(answer) != n:
            raise ResponseError(f"{len(answer)} vectors for {n} texts")
        vectors = [[float(x) for x in v] for v in answer]
        sizes = {len(v) for v in vectors}
        if len(sizes) > 1 or 0 in sizes or (self.dimensions and sizes != {self.dimensions}):
            raise ResponseError("vectors of several sizes, or of another than asked for")
        if any(not all(map(math.isfinite, v)) or not any(v) for v in vectors):
            raise ResponseError("a vector that isn't finite, or has no direction")
        return vectors

    def vectors(self, texts: list[str]) -> list[list[float]]:
        """The vectors of any number of texts, in requests cut as the budgets say."""
        sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        if len(sizes) and sizes.max() > min(self.input_bytes, self.most_bytes):
            raise ResponseError("a text is larger than a request may hold")
        out, i = [], 0
        then = next_starts(sizes, self.most, self.most_bytes) if len(sizes) else sizes
        while i < len(texts):
            out += self.request(texts[i : then[i]])
            i = int(then[i])
        return out


def embedded(chunks: DataFrame, service: Service | Callable[[list[str]], list]) -> DataFrame:
    """thread_id, chunk_index, chunk_count, chunk_hash, vector of chunks. All vectors of an Arrow batch must have one size."""
    own = service if isinstance(service, Service) else Service(service)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            vectors = own.vectors(b.column("chunk").to_pylist())
            if len({len(v) for v in vectors}) > 1:
                raise ResponseError("vectors of several sizes")
            columns = [b.column(c) for c in ("thread_id", "chunk_index", "chunk_count", "chunk_hash")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.float64()))], ["thread_id", "chunk_index", "chunk_count", "chunk_hash", "vector"])

    return chunks.select("thread_id", "chunk_index", "chunk_count", "chunk_hash", "chunk").mapInArrow(run, VECTORS)
