"""Whole-text encoding with a file of the tokenizers library, as ids in little-endian unsigned 32-bit bytes.

A byte-level BPE with the usual word pattern works word by word, and these places always lie between two words: before
a blank that a non-blank follows, between a line feed that no other white space surrounds and what follows, between a letter and . , ; : ! or ?. Texts are
cut there into units, with numpy on their bytes, and a worker keeps the ids of the units that it has met in a hash
table; the library encodes the others, strung together as whole text, and the bytes that each id stands for tell where
a unit ends. Units are found by 64-bit hashes and compared byte by byte. Texts with control strings of the vocabulary are
cut at them first, as the library does, and very long texts between units, so memory stays bounded but for a single
unit. The ids are those of encoding the whole text, as the tests check.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What the table holds before it is emptied; a bound on memory, not on what is encoded.
TABLE_UNITS, TABLE_BYTES = 1_000_000, 64 << 20  # so many that its arrays need not grow beyond 2**20 units
BATCH_TEXTS, BATCH_BYTES = 1000, 500_000  # numpy takes some 50 bytes for one of a text

_SPACE, _BREAK, _LETTER, _MARK, _PLAIN = (np.zeros(256, bool) for _ in range(5))
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_MARK[list(b".,;:!?")] = True
_PLAIN[33:127] = True  # surely not white space; so are most characters of two bytes, by their first byte
_PLAIN[0xC3:0xE0] = True
#: Masks of the first 0 to 8 bytes of a number in little-endian order.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each of the consecutive runs of bytes that make up data."""
    x = np.arange(len(data), dtype=np.uint64)
    x -= np.repeat(begin.astype(np.uint64), end - begin)
    x <<= np.uint64(8)
    x += data
    x += np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mixed(x), out=total[1:])
    return mixed(total[end] - total[begin] + (end - begin).astype(np.uint64)) | np.uint64(1)


class Units:
    """Texts (UTF-8) cut into units: data, begin and end of each unit in it, its hash, and the first unit of each text."""

    _ends8 = None

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.cumsum(size) - size
        d, n = self.data, len(self.data)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            before, now = d[:-1], d[1:]
            plain = _PLAIN[now]
            cut[2:n] = _PLAIN[d[:-2]] & (before[1:] == 10) & plain[1:]  # before what follows a single line feed
            letter = _LETTER[before]
            letter[1:] |= (d[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7) & (before[1:] >= 0x80)
            cut[1:n] |= letter & _MARK[now]
            cut[: n - 1] |= (before == 32) & plain  # before a blank that a non-blank follows
        cut[first[size > 0]] = True
        cut[n] = False
        self.begin = np.flatnonzero(cut)
        self.end = np.append(self.begin[1:], n) if len(self.begin) else self.begin
        self.first = np.searchsorted(self.begin, np.append(first, n))
        if len(size) and n:
            self.first = np.where(np.append(size, 0) > 0, self.first, np.searchsorted(self.begin, np.append(first, n), "left"))
        self.hash = hashes(d, self.begin, self.end)

    @classmethod
    def of(cls, data: bytes, size: np.ndarray) -> Units:
        """Units that are known already, by their bytes and sizes."""
        u = cls.__new__(cls)
        u.data, u.end = np.frombuffer(data, np.uint8), np.cumsum(size)
        u.begin = u.end - size
        u.hash = hashes(u.data, u.begin, u.end)
        return u

    def ends8(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last 8 bytes of each unit as numbers; of shorter units all bytes, and 0."""
        if self._ends8 is None:
            padded = np.concatenate([np.zeros(8, np.uint8), self.data, np.zeros(8, np.uint8)])
            rows, size = np.lib.stride_tricks.sliding_window_view(padded, 8), self.end - self.begin
            head = rows[self.begin + 8].view("<u8").ravel() & _FIRST[np.minimum(size, 8)]
            self._ends8 = head, np.where(size >= 8, rows[self.end].view("<u8").ravel(), np.uint64(0))
        return self._ends8

    def text(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices begin[0], begin[0] + 1, ... of all runs, one after another."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - count), count)


class Table:
    """A hash table from units to runs of ids, probed for many units at once.

    A unit that is found by its hash is compared byte by byte; units whose hash another one holds live in a dict beside.
    """

    def __init__(self, bits: int = 16):
        self.mask = np.uint64((1 << bits) - 1)
        self.hash = np.zeros(1 << bits, np.uint64)
        self.slot = np.zeros(1 << bits, np.int32)
        self.own = np.zeros(1 << 12, np.uint64)  # the hash of each unit, to deal them anew when the table grows
        self.begin, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.at, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.head, self.tail = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0
        self.data, self.filled = np.zeros(1 << 14, np.uint8), 0
        self.size = 0
        self.others: dict[bytes, int] = {}

    @property
    def bytes(self) -> int:
        """What units and ids take."""
        return 4 * self.used + self.filled

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of a unit with each hash, -1 for those that aren't there."""
        at = (h >> np.uint64(20)) & self.mask
        there = self.hash[at]
        out = np.where(there == h, self.slot[at], -1)
        todo = np.flatnonzero((there != h) & (there != 0))
        at = at[todo]
        while len(todo):
            at = (at + np.uint64(1)) & self.mask
            there = self.hash[at]
            hit = there == h[todo]
            out[todo[hit]] = self.slot[at[hit]]
            go = ~hit & (there != 0)
            todo, at = todo[go], at[go]
        return out

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        at, todo = (h >> np.uint64(20)) & self.mask, np.arange(len(h))
        while len(todo):
            free = self.hash[at] == 0
            slot, who = np.unique(at[free], return_index=True)  # one unit takes a slot, others move on
            took = np.flatnonzero(free)[who]
            self.hash[slot], self.slot[slot] = h[todo[took]], number[todo[took]]
            go = np.ones(len(todo), bool)
            go[took] = False
            todo, at = todo[go], (at[go] + np.uint64(1)) & self.mask

    def _room(self, n: int) -> None:
        """Keeps at least half of the slots free."""
        bits = len(self.hash).bit_length() - 1
        if 2 * (self.size + n) > 1 << bits:
            while 2 * (self.size + n) > 1 << bits:
                bits += 1
            self.mask = np.uint64((1 << bits) - 1)
            self.hash, self.slot = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            at = np.flatnonzero(self.own[: self.size])
            self._place(self.own[at], at.astype(np.int32))

    def add(self, u: Units, new: np.ndarray, ids: np.ndarray, count: np.ndarray, hashed: bool = True) -> int:
        """Adds units that aren't there, of different hashes; the number of the first."""
        n, first, size = len(new), self.size, (u.end[new] - u.begin[new])
        raw = u.data[ragged(u.begin[new], size)]
        if hashed:
            self._room(n)
        for name, need in (("own", first + n), ("begin", first + n), ("count", first + n), ("at", first + n), ("length", first + n), ("head", first + n), ("tail", first + n), ("ids", self.used + len(ids)), ("data", self.filled + len(raw))):
            old = getattr(self, name)
            if need > len(old):
                grown = np.zeros(max(need, 2 * len(old)), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        to = slice(first, first + n)
        self.begin[to], self.count[to] = self.used + np.cumsum(count) - count, count
        self.at[to], self.length[to] = self.filled + np.cumsum(size) - size, size
        head, tail = u.ends8()
        self.head[to], self.tail[to] = head[new], tail[new]
        self.ids[self.used : self.used + len(ids)] = ids
        self.data[self.filled : self.filled + len(raw)] = raw
        self.size, self.used, self.filled = first + n, self.used + len(ids), self.filled + len(raw)
        if hashed:
            self.own[to] = u.hash[new]
            self._place(u.hash[new], np.arange(first, first + n, dtype=np.int32))
        return first

    def unlike(self, u: Units, number: np.ndarray) -> np.ndarray:
        """The units of u whose bytes are not those of the unit with their number."""
        size, (head, tail) = u.end - u.begin, u.ends8()
        bad = (self.length[number] != size) | (self.head[number] != head) | (self.tail[number] != tail)
        check = np.flatnonzero((size > 16) & ~bad)  # units of up to 16 bytes are compared whole by now
        if len(check):
            size = size[check]
            differ = np.flatnonzero(self.data[ragged(self.at[number[check]], size)] != u.data[ragged(u.begin[check], size)])
            bad[check[np.searchsorted(np.cumsum(size), differ, "right")]] = True
        return np.flatnonzero(bad)

    def numbers(self, u: Units, learn) -> np.ndarray:
        """The number of every unit of u; learn(u, units) yields (units, ids, counts) of those that are new."""
        number = self.find(u.hash)
        if (missing := np.flatnonzero(number < 0)).size:
            _, at = np.unique(u.hash[missing], return_index=True)
            for new, ids, count in learn(u, missing[np.sort(at)]):
                self.add(u, new, ids, count)
            number[missing] = self.find(u.hash[missing])
        for i in self.unlike(u, number).tolist():
            raw = u.text(i)
            if raw not in self.others:
                ((new, ids, count),) = learn(u, np.array([i]))
                self.others[raw] = self.add(u, new, ids, count, hashed=False)
            number[i] = self.others[raw]
        return number


class Encoder:
    """Encodes lists of texts; `data` is the content of the file of a byte-level tokenizer.

    As with the library's own settings, a control string in a text gets its id, unless special_as_text is set.
    """

    def __init__(self, data: bytes, special_as_text: bool = False):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # byte level: one character stands for one byte
        added = [t for t in json.loads(data).get("added_tokens", []) if not (special_as_text and t["special"])]
        #: Added tokens stand for themselves wherever their text occurs; those that take in their surroundings need the library.
        self.whole = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.added = {t["content"].encode(): t["id"] for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.pattern = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None
        self.table = Table()

    def _learn(self, u: Units, new: np.ndarray):
        """Encodes units in one go: those that begin with a blank or follow a letter stand apart when strung together."""
        lead = u.data[u.begin[new]]
        long = u.end[new] - u.begin[new] > 1
        # " word" and its like begin at a blank that a non-blank follows, wherever they stand.
        after = u.data[np.minimum(u.begin[new] + 1, len(u.data) - 1)]
        tied = (lead == 32) & long & _PLAIN[after]
        for group, apart in ((new[tied], False), (new[~tied], True)):
            for k in range(0, len(group), 5000):
                g = group[k : k + 5000]
                size = u.end[g] - u.begin[g]
                if apart:
                    found = self.tokenizer.encode_batch_fast([u.text(i).decode("utf-8", "replace") for i in g], add_special_tokens=False)
                    ids = [x.ids for x in found]
                    count = np.array([len(x) for x in ids], np.int32)
                    ids = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
                else:
                    text = u.data[ragged(u.begin[g], size)].tobytes().decode("utf-8", "replace")
                    (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
                    ids = np.array(found.ids, np.uint32)
                    ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(size)) + 1
                    count = np.diff(ends, prepend=0).astype(np.int32)
                yield g, ids, count

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. Long texts, and those with control strings, are encoded in parts."""
        parts, known, bounds = [], {}, [0]
        for t in texts:
            own = self.pattern.split(t) if self.pattern and self.pattern.search(t) else [t]
            if self.whole and len(own) > 1:
                known[len(parts)] = self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids
                own = [b""]
            for k, x in enumerate(own):
                if k % 2:  # every second part is a control string
                    known[len(parts)], x = [self.added[x]], b""
                parts += pieces(x) if len(x) > 2 * BATCH_BYTES else [x]
            bounds.append(len(parts))
        ids: list[np.ndarray] = []
        for a, b in slices(parts, len(parts) + 1, 2 * BATCH_BYTES):
            ids += self._encode(parts[a:b])
        for k, own in known.items():
            ids[k] = np.array(own, np.uint32)
        return ids if len(ids) == len(texts) else [np.concatenate(ids[i:j]) for i, j in zip(bounds, bounds[1:])]

    def _encode(self, parts: list[bytes]) -> list[np.ndarray]:
        u = Units(parts)
        if self.table.size > TABLE_UNITS or self.table.bytes > TABLE_BYTES:
            self.table = Table()
        number = self.table.numbers(u, self._learn)
        count = self.table.count[number].astype(np.int64)
        ids = self.table.ids[ragged(self.table.begin[number], count)]
        cuts = np.concatenate([[0], np.cumsum(count)])[u.first]
        return [ids[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist())]


def pieces(text: bytes, most: int = BATCH_BYTES, stretch: int = 1 << 16) -> list[bytes]:
    """A long text cut between units: each piece but the last ends at the first cut after `most` bytes."""
    out, begin, at = [], 0, most
    while at < len(text):
        cuts = Units([text[at - 2 : at + stretch]]).begin
        cuts = cuts[cuts >= 2]  # whether a place is a cut shows in the two bytes before it and the one after
        if len(cuts):
            end = at - 2 + int(cuts[0])
            out.append(text[begin:end])
            begin, at = end, end + most
        else:
            at += stretch - 1
    return [*out, text[begin:]]


def slices(texts, count: int = BATCH_TEXTS, most: int = BATCH_BYTES):
    """Index ranges with a bounded number of texts and, but for a longer single text, of bytes."""
    return runs([len(t) for t in texts], count, most)


def runs(sizes: list[int], count: int = BATCH_TEXTS, most: int = BATCH_BYTES):
    """slices() of texts whose sizes are known."""
    begin = size = 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= count or size + n > most):
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_slices(column: pa.Array):
    """(begin, end, texts) of a binary column, nulls as empty texts; only one slice at a time is copied out of Arrow."""
    for a, b in runs(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        yield a, b, [t or b"" for t in column.slice(a, b - a).to_pylist()]


_encoders: dict[str, Encoder] = {}


def encoder_of(key: str, data: bytes) -> Encoder:
    """One encoder a worker process, so that its cache outlives a task."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def shared_tokenizer(spark, path: str):
    """The tokenizer's file (a fixed vocabulary) as a broadcast (key, bytes)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((path, f.read()))
