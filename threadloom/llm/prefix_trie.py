"""Conversation prefix trie: shared beginnings of conversations as a tree of owned chains.

Every prefix of a conversation has a digest; the smallest conversation with a prefix owns its node. A conversation that owns
one prefix owns all its longer ones, so what it owns is a chain that begins at its first owned depth. That depth is found by
binary search: each round looks the digest at the middle depth of every open conversation up among the minima of prefix
digests, in one join. The last owner met above the chain is the chain's parent. Chains form a tree; leaves and saved
tokens are added up it by pointer doubling, so a tree of height h takes about log2 h rounds of joins over chains, and
running sums along a chain give its nodes.

A prefix digest is 128 bits: the running xor of hashes of (depth, role and text by MD5). Turns move as digests and
lengths; texts are hashed where they are read. Running values are window functions, which spill; a conversation is never
an array. The members that end at a node are hashed as a stream in order of their ids, so a node where a large share of all
conversations ends needs no memory for them (SHA-256 of one text is one task's work all the same).

Defined cases: null roles and texts are empty; a null turn comes first, and tied turns and repeated rows are ordered by the
MD5 of their content; rows without conv_id belong to no conversation and are left out; an empty table gives no nodes, not even a
root; other columns are not read. c - c % 100 is taken with the remainder's sign as in SQL.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import CRC_SQL, crc_sql, materialize, read_table, scratch

FAMILY, BORROWED = 100, 6


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, i (from 1), a and b (128 bits of the turn's content), chars."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    small = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), content.alias("m"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "m")
    return small.select("conv_id", F.row_number().over(order).cast("long").alias("i"), F.xxhash64("m").alias("a"), F.xxhash64(F.lit("second"), "m").alias("b"), "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns) and their rebuilt turns (conv_id, depth from 1, a, b, chars)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", h.alias("h"), base.alias("base"))
    # At most BORROWED - 1 turns of a base are ever borrowed.
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("i") < BORROWED))
    lent = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "a", "b", "chars"))).alias("lent"))
    convs = convs.join(lent, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", F.array().cast("array<struct<i:bigint,a:bigint,b:bigint,chars:bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("shift", F.size("lent").cast("long") - F.col("h"))
    borrowed = convs.select("conv_id", F.explode("lent").alias("x")).select("conv_id", F.col("x.i").alias("depth"), "x.a", "x.b", "x.chars")
    kept = turns.join(convs.select("conv_id", "h", "shift"), "conv_id").where("i > h").select("conv_id", (F.col("i") + F.col("shift")).alias("depth"), "a", "b", "chars")
    return convs.select("conv_id", (F.size("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n_turns")), borrowed.unionByName(kept)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, p and q (the digest of the first depth turns), chars of the last of them."""
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    p, q = F.xxhash64("depth", "a", "b"), F.xxhash64(F.lit("second"), "depth", "a", "b")
    return turns.select("conv_id", "depth", F.bit_xor(p).over(upto).alias("p"), F.bit_xor(q).over(upto).alias("q"), "chars")


def first_owned(convs: DataFrame, prefix: DataFrame, minima: DataFrame, label: str = "trie-search") -> DataFrame:
    """conv_id, n_turns, first (its first owned depth, n_turns + 1 if none), above (owner of the prefix one shorter).

    prefix: conv_id, depth, p, q. minima: depth, p, q, owner. The smallest conversation owns the root: its first is 0.
    """
    top = F.broadcast(convs.agg(F.min("conv_id").alias("top")))
    # Open: depth low belongs to another conversation, `above`; depth high (or the place past the end) to this one.
    start = convs.crossJoin(top).select("conv_id", "n_turns", F.lit(0).cast("long").alias("low"), (F.col("n_turns") + 1).alias("high"), F.col("top").alias("above"))
    begun = start.where("conv_id = above").select("conv_id", "n_turns", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("above"))
    done = [materialize(begun, label)]
    at = materialize(start.where("conv_id != above"), label)
    while True:
        done.append(at.where("high - low <= 1").select("conv_id", "n_turns", F.col("high").alias("first"), "above"))
        still = at.where("high - low > 1")
        if still.isEmpty():
            break
        asked = still.withColumn("depth", ((F.col("low") + F.col("high")) / 2).cast("long")).join(prefix.select("conv_id", "depth", "p", "q"), ["conv_id", "depth"])
        answered = asked.join(minima, ["depth", "p", "q"])
        own = F.col("owner") == F.col("conv_id")
        at = materialize(answered.select("conv_id", "n_turns", F.when(own, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(own, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(own, F.col("above")).otherwise(F.col("owner")).alias("above")), label)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def subtree_sums(chains: DataFrame, names: list[str], label: str = "trie-sums") -> DataFrame:
    """chains(conv_id, above, names) with each of names summed over the chain and all chains below it, by pointer doubling."""
    at = materialize(chains.select("conv_id", F.col("above").alias("to"), *names), label)
    while True:
        sent = at.where("to IS NOT NULL").groupBy(F.col("to").alias("conv_id")).agg(*[F.sum(x).alias("more_" + x) for x in names])
        jump = at.where("to IS NOT NULL").select(F.col("conv_id").alias("to"), F.col("to").alias("next"))
        moved = at.join(sent, "conv_id", "left").join(jump, "to", "left")
        at = materialize(moved.select("conv_id", F.col("next").alias("to"), *[(F.col(x) + F.coalesce("more_" + x, F.lit(0))).alias(x) for x in names]), label)
        if at.where("to IS NOT NULL").isEmpty():
            return at.drop("to")


def digest_lists(members: DataFrame) -> DataFrame:
    """at_conv, depth, ends_sha256 of members(at_conv, depth, conv_id): the ids of each node, in order, as one stream."""

    def run(batches):
        key, state, n = None, None, 0
        for batch in batches:
            got = []
            for k, i in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if k != key:
                    if state is not None:
                        got.append((*key, state.hexdigest()))
                    key, state, n = k, hashlib.sha256(), 0
                state.update((b"," if n else b"") + str(i).encode())
                n += 1
            if got:
                yield out(got)
        if state is not None:
            yield out([(*key, state.hexdigest())])

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["at_conv", "depth", "ends_sha256"])

    dealt = members.select("at_conv", "depth", "conv_id").repartition("at_conv", "depth").sortWithinPartitions("at_conv", "depth", "conv_id")
    return dealt.mapInArrow(run, "at_conv long, depth long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch(rows.sparkSession, "trie-found", "trie-nodes", "trie-chains", "trie-sums"):
        convs, turns = rebuilt(materialize(turns_of(rows), "trie-turns"))
        convs = materialize(convs, "trie-convs")
        prefix = materialize(prefixes(turns), "trie-prefixes")
        nodes = prefix.groupBy("depth", "p", "q").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
        minima = materialize(nodes, "trie-minima")
        found = materialize(first_owned(convs, prefix, minima.drop("n_convs", "chars")), "trie-found")
        root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("conv_id IS NOT NULL").select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars"))
        owned = root.unionByName(minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "chars"))
        owned = materialize(owned.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-nodes")
        # A conversation that owns nothing ends at the last node above it.
        chains = found.where("first <= n_turns")
        ends = found.select(F.when(F.col("first") <= F.col("n_turns"), F.col("conv_id")).otherwise(F.col("above")).alias("at_conv"), F.col("n_turns").alias("depth"), "conv_id")
        hung = chains.where("above IS NOT NULL").select(F.col("above").alias("to"), (F.col("first") - 1).alias("depth"), F.col("conv_id").alias("below"))
        # A chain's end is a leaf unless another chain hangs there.
        busy = hung.select(F.col("to").alias("conv_id"), F.col("depth").alias("n_turns")).distinct().withColumn("busy", F.lit(1))
        own = owned.groupBy("conv_id").agg(F.sum("saved").alias("saved_tokens"))
        chains = chains.join(busy, ["conv_id", "n_turns"], "left").join(own, "conv_id")
        chains = chains.select("conv_id", "first", "above", "n_turns", F.when(F.col("busy").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), "saved_tokens")
        chains = materialize(chains, "trie-chains")
        sums = subtree_sums(chains, ["n_leaves", "saved_tokens"])
    hanging = hung.join(sums.withColumnRenamed("conv_id", "below"), "below").groupBy(F.col("to").alias("conv_id"), "depth")
    hanging = hanging.agg(F.count("*").alias("n_hung"), F.sum("n_leaves").alias("hung_leaves"), F.sum("saved_tokens").alias("hung_saved"))
    of = chains.select("conv_id", "first", "above", F.col("n_turns").alias("last"), F.col("n_leaves").alias("end_leaf"))
    zero = F.lit(0).cast("long")
    at = owned.join(hanging, ["conv_id", "depth"], "left").join(of, "conv_id")
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    listed = digest_lists(ends).withColumnRenamed("at_conv", "conv_id")
    nodes = at.select(
        "conv_id", "depth", F.when(F.col("depth") == 0, F.lit(None).cast("long")).when(F.col("depth") == F.col("first"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", (F.coalesce("n_hung", zero) + (F.col("depth") < F.col("last")).cast("long")).alias("n_children"),
        (F.col("end_leaf") + F.sum(F.coalesce("hung_leaves", zero)).over(below)).alias("n_leaves"),
        F.sum(F.col("saved") + F.coalesce("hung_saved", zero)).over(below).alias("saved_tokens"),
    )
    return nodes.join(listed, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def op13_prefix_trie(spark, sf_dir):
    return trie(read_table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH {CRC_SQL},
c AS (
  SELECT conv_id, text, md5(length(role) || ':' || role || text) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
k AS (SELECT *, (SELECT count(*) FROM c WHERE c.conv_id = base AND c.i <= h) AS lent FROM (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM c), crc)),
t AS (
  SELECT k.conv_id, c.i AS depth, m, text FROM k JOIN c ON c.conv_id = k.base AND c.i <= k.h
  UNION ALL SELECT k.conv_id, c.i - k.h + k.lent, m, text FROM k JOIN c ON c.conv_id = k.conv_id AND c.i > k.h),
p AS (
  SELECT conv_id, depth, text, string_agg(m, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS p FROM t
  UNION ALL SELECT conv_id, 0, '', '' FROM k),
ends AS (SELECT p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(p, depth) AS p FROM p GROUP BY conv_id) GROUP BY p),
n AS (SELECT p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(length(text)) AS saved FROM p GROUP BY p),
kids AS (SELECT left(p, 32 * (depth::INT - 1)) AS p, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT a.p, count(*) FILTER (q.p IS NULL) AS n_leaves, sum(d.saved)::BIGINT AS saved_tokens FROM n d JOIN n a ON a.depth <= d.depth AND a.p = left(d.p, 32 * a.depth::INT) LEFT JOIN kids q ON q.p = d.p GROUP BY a.p)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n u ON n.depth > 0 AND u.p = left(n.p, 32 * greatest(n.depth::INT - 1, 0)) LEFT JOIN kids ON kids.p = n.p JOIN below ON below.p = n.p LEFT JOIN ends ON ends.p = n.p
"""
