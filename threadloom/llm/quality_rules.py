"""Quality rules: one threshold table, compiled into one Spark projection without user functions.

The stop words of the default table are those of English, French, German and Spanish. A text of another language holds few of
them and fails stop_word_ratio: the table is meant for corpora of these four, others need rules of their own.

Defined cases: null and empty texts have no words, fail the base rule and are not kept; repeated rows are judged
one by one; an empty table gives an empty one; columns of the input that clash with a metric's name are not read,
because the projection starts from id and text alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WHITE, WHITE_CLASS, let, read_table

# Frequent function words of the languages that the rules know.
STOP_WORDS = tuple(
    "a and are as at be but by for from had has have he in is it of on or that the this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "auf das dem den der des die ein eine er es für im in ist mit nicht sich sie und von war zu "
    "al como con de del el en es la las lo los más no para por que se su un una y".split()
)
SYMBOLS = r"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails when metric lies outside [low, high]."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Ratios that prose of any of the languages meets; texts of under 50 words fail the base rule before.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.5),
)


def words_of(text: Column) -> Column:
    """Words of a non-null text: maximal runs without white space."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, its first occurrence included.

    Windows are hashed to 64 bits with their position; sorted, equal windows are neighbours. Linear but for the
    sort, which only texts with a repeated window pay for.
    """

    def marked(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        pairs = let(at, lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(*[p["i"] + k for p in (a, b) for k in range(3)]))))
        return F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def hashes(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        later = F.zip_with(F.slice(w, F.lit(2), n), F.slice(w, F.lit(3), n), lambda b, c: F.struct(b.alias("b"), c.alias("c")))
        return F.zip_with(F.slice(w, F.lit(1), n), later, lambda a, bc: F.xxhash64(a, bc["b"], bc["c"]))

    windows = let(words, hashes)
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    base = base.select("doc_id", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{WHITE_CLASS[1:]}")).alias("lines"))
    n_lines = F.greatest(F.size("lines"), F.lit(1))
    n_words = F.size("w")
    counts = base.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"{WHITE_CLASS}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
    )
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_words")), F.lit(0.0))
    per_line = lambda c: F.col(c) / F.col("n_lines")
    return counts.select(
        "*",
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbol_ratio"),
        per_word("n_stop_words").alias("stop_word_ratio"),
        per_line("n_dup_lines").alias("dup_line_ratio"),
        per_word("n_repeat_words").alias("repeat_word_ratio"),
        per_line("n_bullet_lines").alias("bullet_line_ratio"),
        per_line("n_ellipsis_lines").alias("ellipsis_line_ratio"),
    )


def compiled(rules=RULES) -> dict[str, Column]:
    """The threshold table as one boolean expression for each rule: true where the document fails."""
    out = {}
    for r in rules:
        v = F.col(r.metric)
        bounds = [v < r.low] * (r.low is not None) + [v > r.high] * (r.high is not None)
        out[r.metric] = reduce(lambda a, b: a | b, bounds, F.lit(False))
    return out


def judge(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics and verdict of every row: base_failed, kept and the names of the rules that it fails."""
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in compiled(rules).items()]))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        metrics(docs, id_col, text_col)
        .select("*", base_failed.alias("base_failed"), failed.alias("failed_rules"))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def keep_good(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs that every rule passes, with all their columns, without a join.

    Rows are kept by exploding, as Spark would push a filter below the metrics and so compute them again.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    judged = judge(docs.select(row, docs[text_col].alias("text")), rules, "row", "text")
    return judged.select(F.explode(F.when(F.col("kept"), F.array("doc_id"))).alias("row")).select("row.*")


def op7_quality_rules(spark, sf_dir):
    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def sql_of(rules=RULES) -> str:
    """The same threshold table as DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    bad = " OR ".join(f"{r.metric} {op} {bound}" for r in rules for op, bound in (("<", r.low), (">", r.high)) if bound is not None)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), (VALUES (0), (1), (2)) v(k)
  WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, greatest(len(lines), 1) AS n_lines,
         len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({stop}))) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
         coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio, n_dup_lines / n_lines AS dup_line_ratio,
         coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio, n_bullet_lines / n_lines AS bullet_line_ratio,
         n_ellipsis_lines / n_lines AS ellipsis_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({bad}) AS kept FROM r
"""
