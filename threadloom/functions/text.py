"""Text functions of search, documents and clustering."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters that decompose to a letter and marks, and those letters; marks that stand alone fold to nothing."""
    pairs = {}
    for c in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs[chr(c)] = base
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


#: Accented letters (then combining marks) and the letters that they fold to, as translate() takes them.
ACCENTED, FOLDED = _accents()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed value: the title words that count as support.
TITLE_TOKEN = "[A-Za-z0-9]{4,}"
# The least title overlap that supports a pair, and how far into a body a mention is early.
MIN_TITLE_OVERLAP = 0.18
EARLY_BODY_BYTES = 240


def ascii_lower(c: Column) -> Column:
    """Folds A-Z only, as case-insensitive identity comparison does."""
    return F.translate(c, UPPER, LOWER)


def search_tokens(c: Column) -> Column:
    """Index tokens: letters and digits, case-folded, accents stripped."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(c, F.lit("")), ACCENTED, FOLDED)), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def keyword_terms(query: str) -> list[str]:
    """Terms of a plain query: runs of letters, digits and _."""
    import regex

    return regex.findall(r"[\p{L}\p{N}_]+", query)


def keyword_expression(query: str) -> str | None:
    """Quoted terms joined by blanks (all must match), or None when there is no term."""
    terms = keyword_terms(query)
    return " ".join(f'"{t}"' for t in terms) or None


def title_tokens(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TITLE_TOKEN), F.lit(0)), ascii_lower))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common tokens over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def dedupe_text(c: Column) -> Column:
    """NUL as a blank, white space collapsed, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, "\0", " ")), r"(?U)\s+", " "))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


#: Words between the characters that Unicode calls white space.
_WORD = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def chunk_text(text: str, max_bytes: int) -> list[str]:
    """Pieces of at most max_bytes in UTF-8: whole words as long as the white space after them fits too, else characters."""
    import numpy as np

    words = [m.span() for m in _WORD.finditer(text)]
    if not words:
        return []
    starts, ends = [a for a, _ in words], [b for _, b in words]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])  # bytes before each character
    out, begin, last = [], starts[0], ends[-1]
    while at[last] - at[begin] > max_bytes:
        full = int(np.searchsorted(at, at[begin] + max_bytes, "right")) - 1
        if full == begin:
            raise ValueError("the budget is smaller than a character")
        k = bisect_left(ends, full)  # words before k end before a white space that fits
        if k and ends[k - 1] > begin:
            cut, then = ends[k - 1], starts[k]
        else:
            cut, then = full, starts[k + 1] if ends[k] == full else full
        out.append(text[begin:cut])
        begin = then
    return [*out, text[begin:last]]


# A mention is a mark, "#" or "issues/" or "pull/" with a number after it, and a repository (owner/name) that may stand right
# before it. So marks are what is searched for, and repositories are read backwards from them: names are runs of
# word characters, dots and dashes.
_MARK = re.compile(r"#(\d+)|(?:issues|pull)/(\d+)", re.IGNORECASE)
_NO_NAME = re.compile(r"[^\w.-]")
_EDGE = re.compile(r"\b")


def _name_before(text: str, end: int) -> int:
    """Where the run of name characters that ends at `end` begins; `end` itself where there is none."""
    width = 64
    while True:
        begin = max(0, end - width)
        if found := _NO_NAME.search(text[begin:end][::-1]):
            return end - found.start()
        if not begin:
            return 0
        width *= 4


def mentions_of(text: str | None):
    """(repository or None, number, byte offset) of the mentions in a text, leftmost first, none inside another.

    owner/name#1, owner/name/issues/1, owner/name/pull/1, issues/1, pull/1, and #12 (a bare number sign needs two digits), in any case. An
    owner begins where a word does. Time is linear in the text. Numbers in digits other than 0-9, or of 64 bits or more, are passed over.
    """
    text = text or ""
    marks = list(_MARK.finditer(text))
    if not marks:
        return

    def repository(mark, done):
        """Where the repository before a mark begins and ends, if there is one after `done`."""
        end = mark.start()
        if mark[1] is None:
            if text[end - 1 : end] != "/":
                return None
            end -= 1
        slash = _name_before(text, end) - 1
        if slash < max(done, 0) or slash == end - 1 or text[slash] != "/":
            return None
        owner = _name_before(text, slash)
        if owner == slash:
            return None
        edge = _EDGE.search(text, max(owner, done), slash)
        return (edge.start(), end) if edge and edge.start() < slash else None

    done = counted = size = i = 0
    while i < len(marks):
        best, k = None, i
        # The next mark may begin earlier, or at the same place, by the repository before it. Of one place, a number sign with a
        # repository goes first, then any mark with one.
        while k < len(marks) and (best is None or k == best[2] + 1):
            mark = marks[k]
            if mark.start() >= done:
                found = repository(mark, done)
                begin = found[0] if found else mark.start()
                bare = mark[1] is not None and len(mark[1]) < 2
                rank = (begin, not found, mark[1] is None)
                if (found or not bare) and (best is None or rank < best[0]):
                    best = (rank, found, k, mark)
            k += 1
        if best is None:
            return
        (begin, *_), found, k, mark = best
        size, counted = size + len(text[counted:begin].encode("utf-8", "surrogatepass")), begin
        digits = mark[1] or mark[2]
        if digits.isascii() and int(digits) < 1 << 63:
            yield (text[slice(*found)] if found else None), int(digits), size
        done = mark.end()
        i = k + 1


def exploded(rows: DataFrame, text: str, parts, schema: str) -> DataFrame:
    """A row for each tuple that parts(text of a row) gives: the other columns of the row, then schema's columns.

    Texts reach Python as Arrow batches; a row without parts is left out.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    others = [c for c in rows.columns if c != text]
    kept = rows.select(*others, text)
    own = StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in own.fields]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parents, made = [], []
            for i, value in enumerate(batch.column(len(others)).to_pylist()):
                got = list(parts(value))
                parents += [i] * len(got)
                made += got
            columns = list(zip(*made)) or [[] for _ in types]
            take = pa.array(parents, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(others))), *(pa.array(list(c), t) for c, t in zip(columns, types))], [*others, *own.names])

    return kept.mapInArrow(run, StructType([*(f for f in kept.schema.fields if f.name != text), *own.fields]))


def chunks_in(rows: DataFrame, text: str, max_bytes: int) -> DataFrame:
    """rows with chunk_index, chunk_count, chunk in place of the text."""

    def parts(value):
        found = chunk_text(value or "", max_bytes)
        return [(i, len(found), c) for i, c in enumerate(found)]

    return exploded(rows, text, parts, "chunk_index int, chunk_count int, chunk string")


def mentions_in(rows: DataFrame, text: str) -> DataFrame:
    """rows with repository, target, byte_offset of each mention in place of the text."""
    return exploded(rows, text, mentions_of, "repository string, target bigint, byte_offset bigint")
