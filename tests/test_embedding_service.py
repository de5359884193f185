"""The embedding service: budgets of requests, order of answers, retries."""

import pytest

from threadloom.operators.embedding_service import ResponseError, Service
from threadloom.workflows import Archive, Filters, NoVectors


def by_length(texts):
    return [[float(len(t)), 1.0] for t in texts]


def test_requests_keep_their_budgets():
    asked = []

    def call(texts):
        asked.append(list(texts))
        return by_length(texts)

    service = Service(call, most=3, most_bytes=10, input_bytes=8)
    texts = ["aaaa", "bb", "cc", "d", "eeee", "ff", "ééé", "g", "hhhhhhhh", "i"]
    assert service.vectors(texts) == by_length(texts)
    assert asked == [["aaaa", "bb", "cc"], ["d", "eeee", "ff"], ["ééé", "g"], ["hhhhhhhh", "i"]] and service.vectors([]) == []
    for bad in (["x" * 9], ["ok", " \n"], [""]):
        with pytest.raises(ResponseError):
            service.vectors(bad)


def test_answers_are_put_in_order():
    shuffled = lambda texts: sorted(enumerate(by_length(texts)), key=lambda a: -a[0])
    assert Service(shuffled).vectors(["a", "bb", "ccc"]) == by_length(["a", "bb", "ccc"])
    assert Service(lambda texts: [(5.0, 6.0) for _ in texts]).vectors(["a", "b"]) == [[5.0, 6.0]] * 2


@pytest.mark.parametrize("answer", [
    [[1.0, 2.0]], [[1.0], [1.0, 2.0]], [[], []], [[0.0, 0.0], [1.0, 1.0]], [[float("nan"), 1.0], [1.0, 1.0]], [[float("inf"), 1.0], [1.0, 1.0]], [(0, [1.0, 1.0]), (0, [1.0, 1.0])], [(0, [1.0, 1.0]), (2, [1.0, 1.0])], [[1.0, 2.0, 3.0]] * 2,
])
def test_answers_that_are_refused(answer):
    with pytest.raises(ResponseError):
        Service(lambda texts: answer, dimensions=2).request(["a", "b"])


def test_retries_end():
    waits, tries = [], []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return by_length(texts)

    assert Service(flaky, pause=waits.append).request(["a"]) == by_length(["a"]) and waits == [0.25, 0.5]

    def down(texts):
        tries.append(1)
        raise ConnectionError("down")

    tries.clear()
    with pytest.raises(ConnectionError):
        Service(down, attempts=4, pause=waits.append).request(["a"])
    assert len(tries) == 4
    tries.clear()
    with pytest.raises(ConnectionError):
        Service(down, seconds=0.1, pause=waits.append).request(["a"])
    assert len(tries) == 1
    tries.clear()

    def wrong(texts):
        tries.append(1)
        return []

    with pytest.raises(ResponseError):
        Service(wrong, pause=waits.append).request(["a"])
    assert len(tries) == 1


def test_the_service_is_asked_only_if_vectors_could_fit(spark, sf):
    from threadloom.sources.archive import coverage, relation

    def never(texts):
        raise AssertionError("asked")

    t, chunks = relation(spark, sf, "threads"), relation(spark, sf, "chunks")
    ask = lambda embed, chunks: Archive(threads=t, coverage=coverage(spark, sf), chunks=chunks, embed=embed).search_threads("with", Filters(sort="relevance"), mode="semantic")
    for embed, held in ((never, chunks.limit(0)), (Service(never, dimensions=3), chunks)):
        with pytest.raises(NoVectors):
            ask(embed, held)
    size = len(chunks.first()["vector"])
    assert ask(Service(lambda texts: [[1.0] * size for _ in texts], dimensions=size), chunks).count() > 0
