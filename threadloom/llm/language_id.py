"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A model holds, for each language, log probabilities of character n-grams (2 to 4, word ends included) hashed to a
fixed number of buckets, and the scripts that its training text uses. A word's candidates are the languages that use
its script. A text's path maximises the sum of its word scores less `penalty` for each switch; runs of one language
are the spans of mixed-language text. The predicted language is the one that covers most letters.

Defined cases: a text that is null or has no letter is `und` with score 0 and no spans, and so is any text when nothing
could be learned. A text none of whose words has a candidate gets the language whose n-grams fit best, with score 0
and no spans. Ties go to the language first in order of code point; repeated rows are judged one by one; an
empty table gives an empty one; only the named columns are read; a row without doc_id is not held out.

Training reads at most about `max_rows` labelled rows of each language (a documented bound; the rows are chosen by
a hash of the id, so the sample is spread over the whole table). Prediction covers all rows and whole texts.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import give_back, read_table

# First code points of script ranges, in order, with the script that starts there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
PENALTY = 8.0
MAX_ROWS = 20_000
CHUNK_CHARS = 4_000_000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    starts = np.array([s for s, _ in SCRIPTS])
    number = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.uint8)
    return letter, number[np.searchsorted(starts, np.arange(0x110000), "right") - 1]


class Words:
    """The words (runs of letters, lower case) of several texts; n-grams are taken once from each distinct word."""

    def __init__(self, texts: list[str]):
        letter, script = tables()
        lowered = [t.lower() for t in texts]
        chars = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32)
        is_letter = letter[chars]
        edge = np.diff(is_letter.view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        #: Where each text begins; offsets count code points of the lower-cased text.
        self.first = np.cumsum([1] + [len(t) + 1 for t in lowered])[:-1]
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        self.script = script[chars[(self.start + self.end - 1) // 2]]
        size = self.end - self.start
        # Words are told apart by a 64-bit hash: the sum of mixed (character, place) pairs.
        mixed = np.arange(len(chars), dtype=np.uint64)
        mixed -= np.repeat(np.append(self.start, 0).astype(np.uint64), np.append(np.diff(np.append(0, self.end)), len(chars) - (self.end[-1] if len(self.end) else 0)))
        mixed <<= np.uint64(21)
        mixed += chars
        mixed += np.uint64(1)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mixed, out=total[1:])
        _, at, self.word = np.unique(total[self.end] - total[self.start], return_index=True, return_inverse=True)
        # The distinct words, a blank before and after each.
        n = size[at]
        self.edges = np.concatenate([[0], np.cumsum(n + 1)])
        code = np.full(int(self.edges[-1]) + 1, 32, np.uint32)
        where = np.arange(int(n.sum())) + np.repeat(np.arange(1, len(n) + 1), n)
        code[where] = chars[np.arange(int(n.sum())) + np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)] if len(n) else 0
        self.code = code
        self.blank = code == 32

    def grams(self):
        """For each order: buckets, a mask of those inside one word and its two blanks, and the order."""
        for n in ORDERS:
            size = max(len(self.code) - n + 1, 0)
            h = np.zeros(size, np.uint32)
            for k in range(n):
                h = (h ^ self.code[k : k + size]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            inside = np.ones(size, bool)
            for k in range(1, n - 1):
                inside &= ~self.blank[k : k + size]
            yield (h + np.uint32(n * 7919)) % np.uint32(BUCKETS), inside, n

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each word, the sums of the rows of table (buckets x languages) over its grams."""
        out = np.zeros((len(self.edges) - 1, table.shape[1]))
        if not len(out):
            return out
        for bucket, inside, n in self.grams():
            at = np.flatnonzero(inside)
            word = np.searchsorted(self.edges, at, "right") - 1
            got = table[bucket[at]]
            for lang in range(table.shape[1]):
                out[:, lang] += np.bincount(word, got[:, lang], len(out))[: len(out)]
        return out[self.word]


def chunks(values, ids=None):
    """Slices of a batch with a bounded number of characters; a longer text is a slice of its own."""
    begin = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > CHUNK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(v) + 1
    if begin < len(values):
        yield begin, len(values)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, penalty: float = PENALTY):
        """counts: languages x buckets of n-grams; scripts: languages x scripts, words counted."""
        self.langs, self.penalty = langs, penalty
        smooth = counts + 0.5
        self.logp = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T) if len(langs) else smooth.T
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.uses = share >= 0.001

    def label(self, texts: list[str]):
        """For each text: (language, score, spans of (language, first word, words))."""
        out = [("und", 0.0, [])] * len(texts)
        if not self.langs or not texts:
            return out
        words = Words(texts)
        if not len(words.start):
            return out
        score = words.sums(self.logp)
        whole = np.stack([np.bincount(words.doc, score[:, k], len(texts)) for k in range(len(self.langs))], 1)
        score -= score.max(1, keepdims=True)
        score = np.maximum(score, -40.0)  # one odd word doesn't decide
        allowed = self.uses[:, words.script].T
        known = allowed.any(1)
        score = np.where(allowed, score, -1e6)
        score[~known] = 0.0
        path = viterbi(score, words.doc, self.penalty)
        weight = (words.end - words.start) * known
        docs, begin = np.unique(words.doc, return_index=True)
        cell, shape = words.doc * len(self.langs) + path, (len(texts), len(self.langs))
        cover = np.bincount(cell, weight, len(texts) * len(self.langs)).reshape(shape)
        # Words whose best language is the predicted one support it fully, others by how little they lose.
        fit = np.exp(np.maximum(score[np.arange(len(path)), path], -40.0) / 4)
        support = np.bincount(cell, weight * fit, len(texts) * len(self.langs)).reshape(shape)
        bounds = np.append(begin, len(path))
        for k, d in enumerate(docs):
            total = cover[d].sum()
            if not total:
                out[d] = (self.langs[int(whole[d].argmax())], 0.0, [])
                continue
            p = path[bounds[k] : bounds[k + 1]]
            best = int(cover[d].argmax())
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])
            spans = [(self.langs[p[a]], int(a), int(b - a)) for a, b in zip(cuts, cuts[1:])]
            out[d] = (self.langs[best], float(min(1.0, support[d, best] / total)), spans)
        return out


def viterbi(score: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of every text at once: step t handles the t-th word of each text that has one."""
    n, langs = score.shape
    _, begin, length = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    longest = int(length[0])
    active = np.searchsorted(-length, -np.arange(longest), "left")  # texts with more than t words
    best = score[begin].copy()
    back = [None] * longest
    ends = np.empty(len(begin), np.int64)
    own = np.arange(langs)
    for t in range(1, longest):
        a = active[t]
        ends[a : active[t - 1]] = best[a : active[t - 1]].argmax(1)
        now = best[:a]
        top = now.argmax(1)[:, None]
        switch = now.max(1, keepdims=True) - penalty
        back[t] = np.where(now >= switch, own, top).astype(np.int16)
        best = np.maximum(now, switch) + score[begin[:a] + t]
    ends[: active[longest - 1]] = best[: active[longest - 1]].argmax(1)
    path = np.empty(n, np.int16)
    at = ends
    for t in range(longest - 1, -1, -1):
        a = active[t]
        path[begin[:a] + t] = at[:a]
        if t:
            at[:a] = back[t][np.arange(a), at[:a]]
    return path


def train(labelled: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", max_rows: int = MAX_ROWS, penalty: float = PENALTY) -> Model:
    """Learn from the labelled rows. What reaches the driver: BUCKETS + scripts counts a language."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPT_NAMES))), penalty)
    langs = sorted(sizes)
    part = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_rows / sizes[lang]))])
    chosen = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < F.try_element_at(part, F.col("l")) * (1 << 20))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in chunks(texts):
                for lang in set(names[a:b]):
                    words = Words([t for t, n in zip(texts[a:b], names[a:b]) if n == lang])
                    got = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    times = np.bincount(words.word, minlength=len(words.edges) - 1)
                    for bucket, inside, _ in words.grams():
                        at = np.flatnonzero(inside)
                        word = np.minimum(np.searchsorted(words.edges, at, "right") - 1, len(times) - 1)
                        got[:BUCKETS] += np.bincount(bucket[at], times[word], BUCKETS).astype(np.int64)
                    got[BUCKETS:] += np.bincount(words.script, minlength=len(SCRIPT_NAMES))
        for lang, got in totals.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_pydict({"l": pa.array([lang] * len(at), pa.string()), "b": pa.array(at, pa.int32()), "n": pa.array(got[at], pa.int64())})

    summed = chosen.select("t", "l").mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    row = np.array([langs.index(x) for x in table["l"].to_pylist()], np.int64)
    counts[row, table["b"].to_numpy().astype(np.int64)] = table["n"].to_numpy()
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:], penalty)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (language, first word, words) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            got = [x for a, b in chunks(texts) for x in m.label(texts[a:b])]
            spans = pa.array([[{"lang": s[0], "first_word": s[1], "n_words": s[2]} for s in g[2]] for g in got], pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang string, first_word int, n_words int>>")


def keep_known(docs: DataFrame, model: Model, least_score: float = 0.2, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language is `und` or scores under least_score; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            known = []
            for a, b in chunks(texts):
                known += [lang != "und" and score >= least_score for lang, score, _ in m.label(texts[a:b])]
            del texts
            yield batch.filter(pa.array(known, pa.bool_()))
            give_back()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def train_on_open_rows(docs: DataFrame) -> Model:
    return train(docs.where(~held_out(F.col("doc_id"))))


def op8_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = label(docs.select("doc_id", "text"), train_on_open_rows(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
