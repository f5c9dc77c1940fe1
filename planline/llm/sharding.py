"""Shards by jump consistent hashing: no ring table, and a new shard takes rows only into itself."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planline.llm.ranks import ranked

#: The published generator: key = key * MULTIPLIER + 1 modulo 2^64, its upper 31 bits are drawn.
MULTIPLIER = 2862933555777941757
TWO_64 = 2**64


def jump_shard(key: Column, n_shards: int) -> Column:
    """The shard, 0 to n_shards - 1, of a 64-bit integer key (null counts as 0).

    The jump consistent hash as published (Lamping and Veach 2014), so other programs find
    the same shard: from shard b the next jump goes to floor((b + 1) * 2^31 / (r + 1)) with
    r of 31 bits drawn from the key; the last place below n_shards is the answer. Products
    modulo 2^64 are taken in decimals, as a long would overflow. Jumps number about
    log(n_shards); the fold has a step for each shard and those after the last jump do nothing.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    unsigned = F.pmod(F.coalesce(key.cast("long"), F.lit(0).cast("long")).cast("decimal(20,0)"), F.lit(Decimal(TWO_64))).cast("decimal(20,0)")
    start = F.struct(unsigned.alias("key"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def jump(s: Column, _: Column) -> Column:
        key = F.pmod(s["key"] * F.lit(Decimal(MULTIPLIER)) + F.lit(Decimal(1)), F.lit(Decimal(TWO_64))).cast("decimal(20,0)")
        drawn = F.floor(key / F.lit(Decimal(2**33))).cast("long")
        after = F.floor((s["next"] + 1) * (F.lit(2.0**31) / (drawn + 1).cast("double"))).cast("long")
        return F.when(s["next"] < n_shards, F.struct(key.alias("key"), s["next"].alias("at"), after.alias("next"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, jump, lambda s: s["at"].cast("int"))


def write_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Write every row to the files of its shard and return them with their places.

    The key is doc_id. Files lie in the shared folder, one folder for each shard, in order
    of doc_id (null first), then of the text's crc32 and length; ``slot`` is a row's place
    in its shard, without gaps from 0, and ``grown_shard`` is where the row would be with
    one shard more: its own shard or the new one. All columns of ``docs`` are kept; columns
    named like the added ones (size, text_crc32, shard, slot, grown_shard) are replaced.

    Rows are dealt by ranges of (shard, doc_id, crc32, length, number of the row), so a shard
    with very many rows, an id on a third of all rows, or one row repeated that often, is
    spread over as many tasks as its rows need. Null ids share the key 0. A null text has 8
    bytes and crc32 0, as an empty one. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    names = ("size", "text_crc32", "shard", "slot", "grown_shard")
    dealt = docs.drop(*names).select(
        "*",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_shard(F.col("doc_id"), n_shards + 1).alias("grown_shard"),
        jump_shard(F.col("doc_id"), n_shards).alias("shard"),
    )
    return ranked(dealt, ["doc_id", "text_crc32", "size"], "shards", within="shard", rank="slot")
