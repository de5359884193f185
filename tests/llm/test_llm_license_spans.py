"""License scans against an exhaustive search with bounded edits."""

import random

import numpy as np

from threadloom.llm import license_scan


def fewest_edits(notice: str, text: str) -> int:
    """The smallest edit distance between a notice and any stretch of a text, by dynamic programming over every place."""
    n = len(notice)
    letters = np.array(list(notice))
    places = np.arange(n + 1)
    column = places.copy()
    best = column[n]
    for c in text:
        step = np.empty(n + 1, np.int64)
        step[0] = 0
        step[1:] = np.minimum(column[:-1] + (letters != c), column[1:] + 1)
        column = np.minimum.accumulate(step - places) + places
        best = min(best, column[n])
    return int(best)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        kind, i = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            del out[i]
        elif kind == 1:
            out.insert(i, rng.choice("abcxyz"))
        else:
            out[i] = rng.choice("abcxyz")
    return "".join(out)


def test_spans_equal_an_exhaustive_search():
    """Every notice is found in exactly the texts that hold it within its edits, up to the last allowed one."""
    rng = random.Random(9)
    scanner, found, missed = license_scan.Scanner(license_scan.NOTICES), 0, 0
    for k in range(60):
        notice = license_scan.NOTICES[k % len(license_scan.NOTICES)]
        filler = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 25)))
        planted = edited(rng, notice.text, rng.choice((0, 1, notice.errors, notice.errors + 1, notice.errors + 3)))
        raw = f"{filler()} {planted} {filler()}"
        text = " ".join(raw.split())
        _, _, spans, score = scanner.scan(raw.encode())
        best = {}
        for n in license_scan.NOTICES:
            edits = fewest_edits(n.text, text)
            if edits <= n.errors:
                best.setdefault(n.label, []).append(1 - edits / len(n.text))
        assert {s["label"] for s in spans} == set(best), raw
        found, missed = found + bool(best), missed + (not best)
        for s in spans:  # a span reads as its words do, and needs the edits that it says
            words = text.split()[s["first_word"] : s["last_word"] + 1]
            assert s["matched"].strip() in " ".join(words)
            assert any(n.label == s["label"] and s["errors"] <= n.errors and fewest_edits(n.text, s["matched"]) <= s["errors"] for n in license_scan.NOTICES)
        if score < 1:
            assert score <= max((x for xs in best.values() for x in xs), default=0.0) + 1e-9
    assert found > 20 and missed > 5
