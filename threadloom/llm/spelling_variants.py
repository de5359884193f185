"""Spelling variant grouping by anagram hashing.

A word's key is the sum of a power of each of its letters, so anagrams share a key, and taking a letter away subtracts that
letter's value. Two words that differ by one letter taken away or added have keys that differ by its value; two that differ
by an exchanged letter have keys that are equal once each has lost its own letter. So each word offers its key and its key
less each of its letters' values, and a join on these integers finds the candidates: keys that a single word offers are done.
For the rest the order of letters is verified: what is left after the removal must be the same string, and exchanged letters
must have stood in the same place. Words that are equal but for the letter in one place are at most as many as there are letters,
so a verified group is bounded by the alphabet, however many words share a key; each member takes its best partner from
the group, and pairs are never rows.

A word's form is its near word of largest n (then the smallest in code-point order), if that n is at least `ratio` times its own. Roots
follow forms by pointer doubling; as n grows tenfold a step, a few rounds do.

Defined cases: null texts have no words and a null doc_id is the empty string in the hashed text; repeated rows count each
time; an empty table gives no words; only doc_id and text are read. A run may be as long as a text: its removals are spelled
out only where another word offers the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import CRC_SQL, crc_sql, let, materialize, read_table, scratch

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
POWER = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, place: Column) -> Column:
    """word less its letter at place (from 1)."""
    return F.concat(F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word)))


def value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    power = code
    for _ in range(POWER - 1):
        power = power * code
    return power


def letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all texts. One run in 31 loses a letter, as a hash of document and run decides."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{least_length},}})"), F.lit(1))).alias("run"),
    )
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")).alias("h"))
    lost = without(F.col("run"), (F.pmod("h", F.length("run").cast("long")) + 1).cast("int"))
    words = runs.select(F.when(F.col("h") % 31 == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def with_key(words: DataFrame) -> DataFrame:
    return words.withColumn("key", F.aggregate(letters(F.col("word")), F.lit(0).cast("long"), lambda a, c: a + value(c)))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best, a struct of (less, form): -n and the word of the best near word, for words that have one.

    words: word, n, key.
    """
    # Keys offered by a word: its own (no letter), and one for each distinct letter taken away.
    offers = F.concat(F.array(F.lit("")), F.array_distinct(letters(F.col("word"))))
    offered = words.select("word", "n", "key", F.explode(offers).alias("letter"))
    offered = offered.select("word", "n", "letter", F.when(F.col("letter") == "", F.col("key")).otherwise(F.col("key") - value(F.col("letter"))).alias("key"))
    shared = offered.groupBy("key").agg(F.count("*").alias("offers")).where("offers > 1").select("key")
    candidates = offered.join(shared, "key", "left_semi")
    # The order of letters: what is left, and the place of the letter (0: none was taken).
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.lit(1)) == F.col("letter"))
    spelled = candidates.select("word", "n", F.explode(F.when(F.col("letter") == "", F.array(F.lit(0))).otherwise(places)).alias("place"))
    spelled = spelled.select("place", "word", "n", F.when(F.col("place") == 0, F.col("word")).otherwise(without(F.col("word"), F.col("place"))).alias("rest"))
    entry = F.struct("place", (-F.col("n")).alias("less"), "word")
    # What is left has one key, so this deals the words of a hot key by their letters' order.
    groups = spelled.groupBy("rest").agg(F.sort_array(F.collect_list(entry)).alias("e")).where(F.size("e") > 1)
    whole = F.filter("e", lambda x: x["place"] == 0)[0]
    groups = groups.select(F.filter("e", lambda x: x["place"] > 0).alias("e"), F.when(F.col("e")[0]["place"] == 0, whole).alias("whole"))

    def partner(x: Column) -> Column:
        return F.struct(x["less"].alias("less"), x["word"].alias("form"))

    def exchanged(e: Column) -> Column:
        """Entries are ordered by place, then best first; each takes the first other of its place."""
        def of(x: Column) -> Column:
            return let(F.filter(e, lambda y: (y["place"] == x["place"]) & (y["word"] != x["word"])), lambda o: F.when(F.size(o) > 0, F.struct(x["word"].alias("word"), F.size(o).cast("long").alias("n_near"), partner(o[0]).alias("best"))))
        return F.filter(F.transform(e, of), lambda x: x.isNotNull())

    def lengthened(e: Column, w: Column) -> Column:
        """The whole word's longer neighbours, each once, and the whole word as theirs."""
        longer = F.array_sort(F.array_distinct(F.transform(e, partner)))
        own = let(longer, lambda o: F.array(F.struct(w["word"].alias("word"), F.size(o).cast("long").alias("n_near"), o[0].alias("best"))))
        theirs = F.transform(longer, lambda o: F.struct(o["form"].alias("word"), F.lit(1).cast("long").alias("n_near"), partner(w).alias("best")))
        return F.concat(own, theirs)

    both = F.when(F.col("whole").isNotNull() & (F.size("e") > 0), F.concat(exchanged(F.col("e")), lengthened(F.col("e"), F.col("whole")))).otherwise(exchanged(F.col("e")))
    found = groups.select(F.explode(both).alias("f")).select("f.*")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form), by pointer doubling."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        moved = at.join(up, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
        at = materialize(moved, "spelling-roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    with scratch(docs.sparkSession, "spelling-formed", "spelling-roots"):
        words = materialize(with_key(word_counts(docs, least_length, least_count)), "spelling-words")
        enough = -F.col("best.less") >= F.col("n") * ratio
        formed = words.join(near_words(words), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
        formed = materialize(formed, "spelling-formed")
        ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir):
    return variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT doc, run, count(*) AS n, coalesce(doc, '') || ':' || run AS s FROM (
    SELECT doc_id::VARCHAR AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{{7,}}}}')), '{UPPER}', '{LOWER}') AS run FROM documents) GROUP BY doc, run),
hashed AS (SELECT run, n, {crc_sql("s")} AS h FROM runs, crc),
w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) GROUP BY word HAVING sum(n) >= 2 AND length(word) >= 7),
d AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.rest),
best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS top, max(o.n) AS top_n FROM near JOIN w o ON o.word = other GROUP BY near.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * w.n THEN top END AS form, CASE WHEN top_n >= 10 * w.n THEN top_n END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, form AS last_form, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON f.word = up.last_form WHERE f.form IS NOT NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN (SELECT word, max_by(last_form, step) AS root FROM up GROUP BY word) r USING (word)
""".replace("{{7,}}", "{7,}")
