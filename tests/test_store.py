"""Stored archives: merges by bucket, rules, versions, migrations and streams."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.sources.store import Check, Migration, Reference, Store, StoreError, Table, Unique, Violation, Write, merging

STEPS = [
    Migration("a", {"t": Table("k bigint, v string, n bigint", ("k",), 8)}, (Check("t", "v_known", "v <> 'bad'"), Unique("t", "one_n", ("n",)))),
    Migration("b", {"c": Table("k bigint, i int, x string", ("k", "i"), 4)}, (Reference("c", "c_of_t", ("k",), "t", ("k",)),)),
]
T, C = "k bigint, v string, n bigint", "k bigint, i int, x string"


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, str(tmp_path / "a"), STEPS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(store, name):
    return {b: tuple(f) for b, f in store.manifest["tables"][name].items()}


def test_merges_rewrite_touched_buckets_only(spark, store):
    want, rng = {}, random.Random(1)
    for step in range(4):
        changes = [(rng.randrange(60), f"v{step}", None) for _ in range(40 if step == 0 else 2)]
        changes = list({c[0]: c for c in changes}.values())
        before = files(store, "t")
        df = spark.createDataFrame(changes, T)
        touched = {str(r["b"]) for r in df.select(F.pmod(F.xxhash64("k"), F.lit(8)).cast("int").alias("b")).collect()}
        store.merge("t", df)
        want |= {c[0]: c for c in changes}
        after = files(store, "t")
        assert {b for b in set(before) | set(after) if before.get(b) != after.get(b)} == touched
    assert rows(store.read("t")) == sorted(want.values())
    assert rows(Store(spark, store.path, STEPS).read("t")) == sorted(want.values())
    store.merge("t", spark.createDataFrame([], T))
    assert store.manifest["version"] == 6


def test_rules_may_drop_rows(spark, store):
    store.merge("t", spark.createDataFrame([(i, "a", i) for i in range(20)], T))
    store.merge("t", spark.createDataFrame([(3, "", None)], T), lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    assert [r[0] for r in rows(store.read("t"))] == [i for i in range(20) if i != 3]
    with pytest.raises(Exception, match="other buckets"):
        store.merge("t", spark.createDataFrame([(3, "a", None)], T), lambda old, new: old.unionByName(spark.range(50, 90).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(None).cast("bigint").alias("n"))))


def test_a_write_that_breaks_a_rule_publishes_nothing(spark, store):
    store.merge("t", spark.createDataFrame([(1, "a", 10), (2, "b", 20)], T))
    before = rows(store.read("t"))
    for changes, found in (
        ([("t", T, [(1, "new", 10), (3, "bad", 30)])], {"v_known": 1}),
        ([("t", T, [(4, "d", 20)])], {"one_n": 1}),
        ([("t", T, [(5, "e", 50)]), ("c", C, [(5, 1, "x"), (9, 1, "y")])], {"c_of_t": 1}),
        ([("c", C, [(1, 1, "x"), (1, 1, "y")])], {"c_key": 1}),
    ):
        write = Write(store)
        for name, schema, new in changes:
            write.merge(name, spark.createDataFrame(new, schema))
        with pytest.raises(Violation) as e:
            write.commit()
        assert e.value.found == found
        again = Store(spark, store.path, STEPS)
        assert rows(again.read("t")) == before and rows(again.read("c")) == [] and again.manifest["version"] == 3
    # The same rows in one valid write; a null names nothing, and null is no duplicate.
    write = Write(store)
    write.merge("t", spark.createDataFrame([(5, None, None), (6, "f", None)], T))
    write.merge("c", spark.createDataFrame([(5, 1, "x")], C))
    assert write.commit() == 4 and rows(store.read("c")) == [(5, 1, "x")]
    write = Write(store)
    write.merge("t", spark.createDataFrame([(5, "", None)], T), lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    with pytest.raises(Violation, match="c_of_t"):  # a parent that goes leaves its children alone
        write.commit()


def test_failed_writes_leave_no_files(spark, store, tmp_path):
    store.merge("t", spark.createDataFrame([(1, "a", 1)], T))
    count = lambda: sum(1 for _ in (tmp_path / "a" / "t").rglob("*.parquet"))
    before = count()
    with pytest.raises(Violation):
        store.merge("t", spark.createDataFrame([(2, "bad", 2)], T))
    assert count() == before


def test_two_writers(spark, store):
    one, two = Store(spark, store.path, STEPS), Store(spark, store.path, STEPS)
    one.merge("t", spark.createDataFrame([(1, "a", 1)], T))
    with pytest.raises(StoreError, match="faster"):
        two.merge("t", spark.createDataFrame([(2, "b", 2)], T))
    assert rows(Store(spark, store.path, STEPS).read("t")) == [(1, "a", 1)]


def test_history(spark, store, tmp_path):
    with pytest.raises(StoreError, match="already"):
        Store.create(spark, store.path, STEPS)
    with pytest.raises(StoreError, match="history"):
        Store(spark, store.path, [Migration("other"), *STEPS[1:]])
    with pytest.raises(StoreError, match="history"):
        Store(spark, store.path, STEPS[:1])
    with pytest.raises(StoreError, match="no archive"):
        Store(spark, str(tmp_path / "none"), STEPS)
    store.merge("t", spark.createDataFrame([(1, "a", 1), (2, "a", 2)], T))
    later = Store(spark, store.path, [*STEPS, Migration("d", {}, (Check("t", "small", "n < 2"),))])
    with pytest.raises(Violation, match="small"):
        later.migrate()
    assert Store(spark, store.path, STEPS).manifest["version"] == 3
    fine = Store(spark, store.path, [*STEPS, Migration("d", {"e": Table("k bigint", ("k",), 2)}, (Check("t", "small", "n < 3"),))])
    fine.migrate()
    assert rows(fine.read("e")) == [] and fine.history().count() == 5
    with pytest.raises(Violation, match="small"):
        fine.merge("t", spark.createDataFrame([(3, "a", 3)], T))


def test_old_versions_and_their_removal(spark, store, tmp_path):
    for v in ("a", "b", "c"):
        store.merge("t", spark.createDataFrame([(1, v, 1)], T))
    assert rows(store.read("t", version=3)) == [(1, "a", 1)] and rows(store.read("t")) == [(1, "c", 1)]
    assert store.vacuum(keep=2) == 1 and store.versions() == [4, 5]
    assert rows(store.read("t", version=4)) == [(1, "b", 1)] and rows(store.read("t")) == [(1, "c", 1)]


def test_a_stream_merges_each_batch_once(spark, store):
    add = merging(store, "t", "s", lambda old, new: old.unionByName(new).groupBy("k").agg(F.max("v").alias("v"), F.sum("n").alias("n")).select("k", "v", "n"))
    batch = spark.createDataFrame([(1, "a", 5), (2, "a", 7)], T)
    add(batch, 0)
    add(batch, 0)  # run again after it was published
    add(spark.createDataFrame([(1, "b", 1)], T), 1)
    merging(Store(spark, store.path, STEPS), "t", "s")(batch, 1)
    assert rows(Store(spark, store.path, STEPS).read("t")) == [(1, "b", 6), (2, "a", 7)]
