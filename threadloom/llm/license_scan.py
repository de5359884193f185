"""License scans: fuzzy search for short notices.

Texts are lower-cased (A-Z) and reduced to their words, one blank between two. A notice may differ by `errors`
edits (insertions, deletions, substitutions of characters). It is cut into errors + 1 pieces; by the pigeonhole
principle one of them occurs unchanged in every match, so an Aho-Corasick automaton over all pieces finds every
candidate place, and the regex library's bounded-error matching verifies the edits there and gives the span.

Defined cases: null and empty texts have no words, no spans and score 0; repeated rows are scanned one by one;
an empty table gives an empty one; only id and text are read, whatever else the table holds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import read_table

# Phrases whose words must stand exactly, with their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int


# Short notices that are matched with edits.
NOTICES = (
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("mit", "released under the mit license", 2),
    Notice("apache-2.0", "licensed under the apache license version 2 0", 4),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 7),
    Notice("gpl-notice", "gnu general public license", 2),
    Notice("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu", 6),
    Notice("mpl-2.0", "subject to the terms of the mozilla public license", 4),
    Notice("cc-notice", "licensed under a creative commons attribution", 4),
    Notice("cc-notice", "licensed under cc by", 1),
    Notice("reserved-notice", "all rights reserved", 1),
    Notice("spdx", "spdx license identifier", 2),
)

_BLANK = re.compile(" ")
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 128 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("matched", pa.string())])
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("spans", pa.list_(SPAN)), ("score", pa.float64()),
])
DDL = (
    "doc_id long, n_words long, base array<struct<label string, word long>>, "
    "spans array<struct<label string, first_word long, last_word long, errors int, matched string>>, score double"
)


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces of nearly equal length, with their offsets."""
    n, k = len(notice.text), notice.errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Built once in a task; scan() takes the UTF-8 bytes of one text."""

    def __init__(self, notices):
        import ahocorasick
        import regex

        self.notices = notices
        self.patterns = [regex.compile(rf"(?e)(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.errors}}}") for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for at, piece in pieces(n):
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def scan(self, raw: bytes):
        words = raw.translate(_TABLE).split()
        norm = b" ".join(words)
        padded = b" " + norm + b" "
        base = []
        for phrase, label in BASE_PHRASES:
            wanted = f" {phrase} ".encode()
            at, word, counted = padded.find(wanted), 0, 0
            while at >= 0:
                word, counted = word + padded.count(b" ", counted, at), at  # from place to place, so the text is counted once
                base.append({"label": label, "word": word})
                at = padded.find(wanted, at + 1)
        text = norm.decode("utf-8", "replace")
        starts: list[int] = []  # where the words begin, once a notice is found

        def word_at(place: int) -> int:
            if not starts:
                starts.append(0)
                starts.extend(m.end() for m in _BLANK.finditer(text))
            return bisect_right(starts, place) - 1

        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.seeds.iter(text):
            for i, at in where:
                n = self.notices[i]
                begin = end + 1 - size - at
                lo, hi = max(0, begin - n.errors), min(len(text), begin + len(n.text) + n.errors)
                if hi - lo < len(n.text) - n.errors:
                    continue
                seen = windows.setdefault(i, [])
                if seen and lo <= seen[-1][1] and seen[-1][0] <= lo:
                    seen[-1][1] = max(seen[-1][1], hi)
                else:
                    seen.append([lo, hi])
        spans = []
        for i, found in windows.items():
            n, done = self.notices[i], -1
            for lo, hi in sorted(found):
                for m in self.patterns[i].finditer(text, max(lo, done), hi):
                    done = m.end()
                    first = word_at(m.start() + (text[m.start() : m.start() + 1] == " "))
                    last = word_at(m.end() - 1 - (text[m.end() - 1 : m.end()] == " "))
                    spans.append({"label": n.label, "first_word": first, "last_word": last, "errors": sum(m.fuzzy_counts), "matched": m.group()})
                    best = 1 - sum(m.fuzzy_counts) / len(n.text)
                    spans[-1]["_score"] = best
        score = 1.0 if base else max((s["_score"] for s in spans), default=0.0)
        for s in spans:
            del s["_score"]
        spans.sort(key=lambda s: (s["first_word"], s["last_word"], s["label"], s["errors"]))
        base.sort(key=lambda b: (b["word"], b["label"]))
        return len(words), base, spans, float(score)


def scan(docs: DataFrame, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, exact places of the base phrases, verified spans of the notices, score."""

    def run(batches):
        scanner = Scanner(notices)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            found = [scanner.scan(t.as_py() or b"") for t in texts]
            cols = [ids] + [pa.array([f[i] for f in found], SCHEMA.field(i + 1).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, SCHEMA)], schema=SCHEMA)

    # Texts travel as bytes; columns keep fixed places, whatever they are called.
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, DDL)


def op9_license_scan(spark, sf_dir):
    found = scan(read_table(spark, sf_dir, "documents"))
    own = F.transform("base", lambda b: b["label"])
    words = F.transform("base", lambda b: b["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        "score",
    )
