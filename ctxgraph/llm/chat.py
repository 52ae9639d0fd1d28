"""Chat formatting after collapsing cumulative snapshots.

Logged conversations are often snapshots of a longer one: all their turns are the first turns of it. Turns are ordered by
(turn, role, text), nulls first; rows that repeat a turn, role and text of the same conversation count once. A prefix is
identified by a rolling hash: each place of a conversation carries the sums, over the turns up to it, of two 64-bit
hashes of (place, role, text). A conversation whose whole hash is the hash of a proper prefix of another is left out
(anti-join), and of conversations with equal turns the one of the smallest id stays. The maximal ones are rendered turn
by turn: ``<|im_start|>role`` line end, text, ``<|im_end|>`` line end; joined in order they are the formatted chat. Special
strings inside texts are made harmless by a space after ``<|``.

A null text renders as empty, a null role as ``unknown``, but both differ from empty strings in the comparison. Rows
without a conversation id are left out: nothing tells which conversation they belong to.

Scale: no conversation is gathered in one task. The running sums are made by sorting all turns by range of (conversation,
order), adding within partitions, and adding the totals of the partitions before (a few numbers each). Only ids, places
and hashes are shuffled for the comparison, and an equal prefix of many conversations is reduced to its longest
conversation's size before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, table

#: A turn's key beside its digest: a null turn is 0 and ``no_t``, so that it can be joined by equality.
TURN = ["conv_id", "t", "no_t"]
LANES = range(4)  # of 31 bits, whose sums are exact


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, t, no_t, role, text, digest) of the rows that belong to a conversation."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.coalesce("turn", F.lit(0)).alias("t"), F.col("turn").isNull().alias("no_t"), "role", "text")
    form = F.concat_ws("|", F.col("role").isNull().cast("string"), F.length("role").cast("string"), F.coalesce("role", F.lit("")), F.col("text").isNull().cast("string"), F.coalesce("text", F.lit("")))
    return rows.withColumn("digest", F.substring(F.unhex(F.sha2(form, 256)), 1, 16))


def distinct_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, t, no_t, role, text, digest) of each distinct turn, with the text only where it decides the order."""
    groups = cut(rows.groupBy(*TURN, "role").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")), "chat")
    one = groups.where("digest = other").select(*TURN, "role", F.lit(None).cast("string").alias("text"), "digest")
    tied = groups.where("digest <> other").select(*(F.col(c).alias("k_" + c) for c in TURN), F.col("role").alias("k_role"))
    if tied.isEmpty():
        return one
    same = [rows[c] == F.col("k_" + c) for c in TURN] + [rows.role.eqNullSafe(F.col("k_role"))]
    several = rows.join(tied, same, "left_semi").groupBy(*TURN, "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return one.unionByName(several.select(*one.columns))


def places(rows: DataFrame) -> DataFrame:
    """(conv_id, t, no_t, digest, place, last, a, b) of digested rows: each distinct turn with its place from 1, whether it
    is its conversation's last, and the hashes of the prefix that ends there."""
    spark = rows.sparkSession
    order = [F.col("no_t").desc(), F.col("t"), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("digest")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = cut(distinct_turns(rows), "chat")  # ranging evaluates its input twice
    local = cut(turns.repartitionByRange(n, "conv_id", *order).withColumn("part", F.spark_partition_id()), "chat")
    # conversations that reach over the end of a partition are the first or last of one; at most two rows a partition
    ends = local.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).collect()
    over = sorted({e.low for e in ends} & {e.high for e in ends}) or [None]
    pieces = local.where(F.col("conv_id").isin(over)).groupBy("conv_id", "part")

    def running(rows: list, names: list) -> DataFrame:
        """By conversation and partition the sums over the partitions before, and whether more follow."""
        out, sums, by_conv = [], {}, {}
        for r in sorted(rows, key=lambda r: (r.conv_id, r.part)):
            got = sums.setdefault(r.conv_id, [0] * len(names))
            by_conv[r.conv_id] = r.part
            out.append((r.conv_id, r.part, *got))
            sums[r.conv_id] = [x + r[c] for x, c in zip(got, names)]
        done = [(*r, by_conv[r[0]] != r[1]) for r in out]
        return F.broadcast(spark.createDataFrame(done, ", ".join([f"conv_id {local.schema['conv_id'].dataType.simpleString()}", "part int", *(f"before_{c} long" for c in names), "more boolean"])))

    within = Window.partitionBy("conv_id", "part").orderBy(*order)
    held = local.join(running(pieces.agg(F.count("*").alias("n")).collect(), ["n"]), ["conv_id", "part"], "left")
    placed = held.withColumn("k", F.row_number().over(within)).withColumn("place", F.col("k") + F.coalesce("before_n", F.lit(0)))
    last = (F.col("k") == F.count("*").over(Window.partitionBy("conv_id", "part"))) & ~F.coalesce("more", F.lit(False))
    placed = placed.withColumn("last", last).withColumn("x", F.xxhash64("place", "digest", F.lit(1))).withColumn("y", F.xxhash64("place", "digest", F.lit(2)))
    lane = lambda i: F.shiftrightunsigned(F.col("xy"[i // 2]), 33 if i % 2 else 2).bitwiseAND(F.lit((1 << 31) - 1))
    sums = placed.select(*TURN, "part", "role", "text", "digest", "place", "last", *(lane(i).alias(f"h{i}") for i in LANES))
    names = [f"h{i}" for i in LANES]
    totals = sums.where(F.col("conv_id").isin(over)).groupBy("conv_id", "part").agg(*(F.sum(c).alias(c) for c in names)).collect()
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = sums.select(*TURN, "part", "digest", "place", "last", *(F.sum(c).over(up_to).alias(c) for c in names))
    whole = hashed.join(running(totals, names).drop("more"), ["conv_id", "part"], "left")
    prefix = [F.col(c) + F.coalesce("before_" + c, F.lit(0)) for c in names]
    return whole.select(*TURN, "digest", "place", "last", F.xxhash64(*prefix, F.lit(3)).alias("a"), F.xxhash64(*prefix, F.lit(4)).alias("b"))


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another."""
    first = placed.where("last").groupBy("a", "b", "place").agg(F.min("conv_id").alias("conv_id"))
    # of every prefix that is shorter than its conversation
    inner = placed.where("NOT last").select("a", "b", "place").distinct()
    return first.join(inner, ["a", "b", "place"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(rows: DataFrame, placed: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, place, segment)"""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    segment = F.concat(F.lit("<|im_start|>"), safe(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), safe(F.coalesce("text", F.lit(""))), F.lit("<|im_end|>\n"))
    texts = rows.groupBy(*TURN, "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    turns = placed.join(kept, "conv_id").select(*TURN, "digest", F.col("n_turns").cast("long").alias("n_turns"), F.col("place").cast("long").alias("place"))
    return turns.join(texts, [*TURN, "digest"]).select("conv_id", "n_turns", "place", segment.alias("segment"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, place, segment) of every turn of the maximal conversations."""
    rows = digested(turns)
    placed = cut(places(rows), "chat")
    return render(rows, placed, maximal(placed))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list([role, text] ORDER BY place) AS turns FROM p GROUP BY conv_id),
f AS (SELECT min(conv_id) AS conv_id, n_turns, turns FROM c GROUP BY n_turns, turns),
inner_prefixes AS (SELECT DISTINCT turns[1 : k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
kept AS (SELECT conv_id, n_turns FROM f WHERE turns NOT IN (SELECT turns FROM inner_prefixes))
SELECT conv_id, n_turns, place, '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS segment
FROM p JOIN kept USING (conv_id)
"""
