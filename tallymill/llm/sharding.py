"""Shards of even row counts by balanced label propagation: copies of a text move together, under quotas.

Documents are linked where their texts are equal.  They begin at a shard of their row's hash.  In each
round a joined table tells every group its copies by shard; copies elsewhere propose to move to the shard that holds most of them (ties
fall anew in each round).  Flows from
shard s to shard t are bounded by a quota: as much as wants to flow back, and a share of the room that t has left.  Proposals of a
flow are taken in the order of a hash bucket up to the quota, so a round's decision is a table of a few thousand numbers.
Groups too large for that are cut into pieces, of which there are a few hundred at most in any corpus; they are seated first, and all others begin
in the room that is left.

At last shards give what they have above their count, unlinked documents first, to shards below it, by number: counts
differ by one at most, whatever the groups.  All of it is joins, aggregations and windows over buckets of bounded size.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import scratch
from tallymill.operators.numbering import bucket_count, literal_rows, numbered_in_buckets

SHARDS, ROUNDS = 16, 10
#: Buckets by which the proposals of a flow are taken; a group of more than 1 / PIECE of a shard's rows is cut into pieces of that size.
BUCKETS, PIECE = 128, 8


def _rows(df: DataFrame) -> DataFrame:
    """uid, doc_id, size, text_crc32 and g (digest of the text) of each row."""
    text = F.coalesce("text", F.lit(""))
    raw = text.cast("binary")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("g"))
    return rows.withColumn("uid", F.monotonically_increasing_id())


def _seats(pieces: list[tuple[bytes, int, int]], cap: int, shards: int) -> tuple[dict[tuple[bytes, int], int], list[int]]:
    """A shard for each piece (g, piece, rows) of the largest groups, those of a group together as far as there is room; and each shard's rows."""
    load, at = [0] * shards, {}
    size: dict[bytes, int] = {}
    for g, _, n in pieces:
        size[g] = size.get(g, 0) + n
    for g in sorted(size, key=lambda g: (-size[g], g)):
        here = None
        for _, piece, n in sorted(p for p in pieces if p[0] == g):
            if here is None or load[here] + n > cap:
                here = min(range(shards), key=lambda s: (load[s], s))
            at[g, piece] = here
            load[here] += n
    return at, load


def _begun(base: DataFrame, total: int, shards: int) -> tuple[DataFrame, list[int]]:
    """``base`` with each row's first shard and whether it is ``seated`` for good; and the seated rows by shard.

    A seated group has more than 1 / (PIECE * shards) of all rows: there are fewer than PIECE * shards of them, and fewer than twice as many pieces.
    """
    large = base.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") * (PIECE * shards) > total)
    large, _ = scratch.store(large.select("g", F.ceil(F.col("n") * (PIECE * shards) / F.lit(total)).cast("int").alias("pieces")), "large")
    rows = base.join(F.broadcast(large), "g", "left").withColumn("piece", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("pieces")).cast("int"))
    found = rows.where("piece IS NOT NULL").groupBy("g", "piece").agg(F.count("*").alias("n")).collect() if large.count() else []
    cap = -(-total // shards)
    at, load = _seats([(bytes(r.g), r.piece, r.n) for r in found], cap, shards)
    room = list(accumulate((max(0, cap - n) for n in load), initial=0))
    draw = F.pmod(F.xxhash64("uid"), F.lit(max(1, room[-1])))
    first = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        first = F.when(draw < room[s + 1], s).otherwise(first)
    seat = F.lit(None).cast("int")
    for s in sorted(set(at.values())):
        names = [f"{g.hex().upper()}:{p}" for (g, p), t in at.items() if t == s]
        seat = F.when(F.concat(F.hex("g"), F.lit(":"), F.col("piece").cast("string")).isin(names), s).otherwise(seat)
    seat = F.when(F.col("piece").isNotNull(), seat)
    return rows.select("uid", "doc_id", "size", "text_crc32", "g", F.col("piece").isNotNull().alias("seated"), F.coalesce(seat, first).alias("first")), load


def _linked(rows: DataFrame) -> DataFrame:
    """g, first, n: how many copies of a text begin in each shard, for texts that occur more than once."""
    counts, _ = scratch.store(rows.where("NOT seated").groupBy("g", "first").agg(F.count("*").alias("n")), "cells")
    return counts.join(counts.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1").select("g"), "g")


def _quotas(flows: dict[tuple[int, int], int], load: dict[int, int], cap: int) -> dict[tuple[int, int], int]:
    """Rows that may move from s to t: as many as want back, and t's room shared by what else wants in."""
    back = {(s, t): min(n, flows.get((t, s), 0)) for (s, t), n in flows.items()}
    rest: dict[int, int] = {}
    for (s, t), n in flows.items():
        rest[t] = rest.get(t, 0) + n - back[s, t]
    return {(s, t): back[s, t] + max(0, cap - load.get(t, 0)) * (n - back[s, t]) // max(1, rest[t]) for (s, t), n in flows.items()}


def propagate(cells: DataFrame, seated: list[int], cap: int, rounds: int = ROUNDS) -> DataFrame:
    """``cells``: g, first, n.  The same cells with the shard where each settles; ``seated``: rows of each shard that stay."""
    spark = cells.sparkSession
    state, path = scratch.store(cells.withColumn("shard", F.col("first")), "labels")
    idle = 0
    for k in range(rounds):
        load = dict(enumerate(seated))
        for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            load[r.shard] += r.n
        rank = F.struct("copies", "tie", "shard")
        tally = state.groupBy("g", "shard").agg(F.sum("n").alias("copies")).withColumn("tie", F.xxhash64("g", "shard", F.lit(k)))
        choice = tally.groupBy("g").agg(F.max(rank).getField("shard").alias("target"))
        wish = F.when(F.col("target") != F.col("shard"), F.col("target")).alias("wish")
        bucket = F.pmod(F.xxhash64("g", "first", F.lit(k)), F.lit(BUCKETS)).alias("bucket")
        asked, asked_path = scratch.store(state.join(choice, "g").select(*state.columns, wish, bucket), "wishes")
        demand = asked.where("wish IS NOT NULL").groupBy("shard", "wish", "bucket").agg(F.sum("n").alias("n")).collect()  # 16 * 15 * BUCKETS rows at most
        flows: dict[tuple[int, int], int] = {}
        for r in demand:
            flows[r.shard, r.wish] = flows.get((r.shard, r.wish), 0) + r.n
        quotas, used, taken = _quotas(flows, load, cap), {}, []
        for r in sorted(demand, key=lambda r: (r.bucket, r.shard, r.wish)):
            key = (r.shard, r.wish)
            if used.get(key, 0) + r.n <= quotas[key]:  # a bucket that does not fit is passed over
                used[key] = used.get(key, 0) + r.n
                taken.append((*key, r.bucket))
        idle = 0 if taken else idle + 1
        if not demand or idle == 2:
            scratch.drop(spark, asked_path)
            break
        accepted = literal_rows(spark, taken, ["shard", "wish", "bucket"]).withColumn("goes", F.lit(True))
        after = asked.join(F.broadcast(accepted), ["shard", "wish", "bucket"], "left")
        old = path
        state, path = scratch.store(after.select("g", "first", "n", F.when(F.col("goes"), F.col("wish")).otherwise(F.col("shard")).alias("shard")), "labels")
        scratch.drop(spark, old, asked_path)
    return state


def _even(rows: DataFrame, counts: dict[int, int], total: int, shards: int) -> DataFrame:
    """``rows``: shard, slot by shard.  Rows above a shard's even count go, by number, to the shards below theirs."""
    order = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    cap = {s: total // shards + (k < total % shards) for k, s in enumerate(order)}
    over = [max(0, counts.get(s, 0) - cap[s]) for s in range(shards)]
    under = [max(0, cap[s] - counts.get(s, 0)) for s in range(shards)]
    spare, need = list(accumulate(over, initial=0)), list(accumulate(under, initial=0))
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("shard") + 1)
    extra = F.when(F.col("slot") >= pick([cap[s] for s in range(shards)]), F.col("slot") - pick([cap[s] for s in range(shards)]) + pick(spare[:-1]))
    rows = rows.withColumn("extra", extra)
    shard, slot = F.col("shard"), F.col("slot")
    for t in range(shards):
        if under[t]:
            here = (F.col("extra") >= need[t]) & (F.col("extra") < need[t + 1])
            shard = F.when(here, F.lit(t)).otherwise(shard)
            slot = F.when(here, F.col("extra") - need[t] + counts.get(t, 0)).otherwise(slot)
    return rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shards(df: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row a document: doc_id, size (UTF-8 bytes and 1), text_crc32, law (``rows``), shard, slot (gapless from 0), grown_shard (null).

    Shard counts differ by one at most.  A null text counts as empty, and so as a copy of empty ones; null and repeated doc_ids are rows of their
    own; equal texts are equal sha256 digests; an empty table gives no row.  Columns other than doc_id and text are not read.  Rows equal in
    every column are dealt by their place in the input's files.
    """
    base, _ = scratch.store(_rows(df), "rows")
    total = base.count()
    begun, seated = _begun(base, total, shards)
    begun, _ = scratch.store(begun, "begun")
    settled = propagate(_linked(begun), seated, -(-total // shards), rounds).select("g", "first", F.col("shard").alias("settled"))
    free = begun.where("NOT seated").join(settled, ["g", "first"], "left")
    placed = free.unionByName(begun.where("seated").withColumn("settled", F.col("first")))
    buckets = bucket_count(total, shards)
    bucket = F.pmod(F.xxhash64("uid", F.lit(2)), F.lit(buckets)) + F.when(F.col("settled").isNull(), buckets).otherwise(0)  # unlinked rows last
    placed, _ = scratch.store(placed.select("uid", "doc_id", "size", "text_crc32", F.coalesce("settled", "first").alias("shard"), bucket.cast("long").alias("bucket")), "placed")
    counts = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    even = _even(numbered_in_buckets(placed, ["shard"], "bucket", ["uid"], "slot"), counts, total, shards)
    return even.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
