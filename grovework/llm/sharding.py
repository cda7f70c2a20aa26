"""Operator 10: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, unused

P = 2_147_483_647


def _mix(shard: int) -> tuple[int, int]:
    """Two constants of a shard: a multiplier and an offset below P."""
    h = hashlib.md5(f"shard-{shard}".encode()).hexdigest()
    return int(h[:12], 16) % (P - 1) + 1, int(h[12:24], 16) % P


def _draw(h: Column, shard: int) -> Column:
    """The shard's draw in (0, 1) for a record hash: two rounds of multiply, add, fold."""
    a, b = _mix(shard)
    x = (h * F.lit(a) + F.lit(b)) % F.lit(P)
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(48271) + F.lit(b)) % F.lit(P)
    return (x + F.lit(0.5)) / F.lit(float(P))


def key_hash(key: Column) -> Column:
    """31 bits of the key's MD5, as other languages have it too; a null key is the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("long") % F.lit(P)


def rendezvous(h: Column, weights: Sequence[float], ids: Sequence[int] | None = None) -> Column:
    """The shard whose cost -ln(draw)/weight is least (ties: the lower shard).

    Adding a shard leaves the costs of the others alone, so a record moves only
    if the new shard wins it; removing one moves only its own records.
    """
    ids = list(range(len(weights))) if ids is None else list(ids)
    if not ids or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("shards need positive, finite weights")
    return F.least(*_costs(h, weights, ids)).getField("shard") if len(ids) > 1 else F.lit(ids[0])


def _costs(h: Column, weights: Sequence[float], ids: Sequence[int]) -> list[Column]:
    return [
        F.struct((-F.log(_draw(h, s)) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard"))
        for s, w in zip(ids, weights, strict=True)
    ]


def assign_shards(
    df: DataFrame, key: str, weights: Sequence[float], grown_weight: float = 1.0, order: Sequence[str] = ()
) -> DataFrame:
    """`df` with shard int, grown_shard int (with one more shard) and slot long.

    The key alone decides the shard.  slot counts a shard's rows from 0 without
    gaps, in the order of (key, `order`); rows equal in all of these are
    interchangeable.  Rows are numbered in ranges of that order, so that no
    shard and no key, however frequent, is sorted by one task.  Null keys are
    one key, before all others.  Columns named shard, grown_shard or slot are
    replaced; an empty table gives none.
    """
    n = len(weights)
    h, best, more = unused(df, "h", "best", "more")
    hashed = df.drop("shard", "grown_shard", "slot").withColumn(h, key_hash(F.col(key)))
    if n > 1:
        least = F.least(*_costs(F.col(h), weights, range(n)))
    else:
        least = _costs(F.col(h), weights, [0])[0]
    placed = (
        hashed.withColumn(best, least)
        .withColumn(more, F.least(best, _costs(F.col(h), [grown_weight], [n])[0]))
        .withColumn("shard", F.col(f"{best}.shard").cast("int"))
        .withColumn("grown_shard", F.col(f"{more}.shard").cast("int"))
        .drop(h, best, more)
    )
    return numbered(placed, ["shard"], [key, *order], "slot")


def shard_documents(docs: DataFrame, shards: int = 40, keep: Sequence[str] = ()) -> DataFrame:
    """Documents over `shards` equal shards, by doc_id.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; null text: 16),
    text_crc32 (null text: that of the empty one), law 'key', shard, slot,
    grown_shard, and the columns named in `keep`.  Without these the text itself
    is never shuffled.  Equal texts need not meet: doc_id alone decides.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        *keep,
    )
    out = assign_shards(slim, "doc_id", [1.0] * shards, order=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", *keep)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every row with its text, language and source, its shard, and its slot there, which tells copies apart.

    Null and empty texts count 16 bytes, null doc_ids are one key, rows that
    repeat each have a slot, very long texts stay whole; an empty table gives none.
    """
    return shard_documents(docs, keep=[c for c in ("text", "lang", "source") if c in docs.columns])


_SHARDS = ", ".join(f"({s}, {a}, {b})" for s, (a, b) in ((s, _mix(s)) for s in range(41)))
OP10_SQL = rf"""
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT) AS bytes,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT % {P} AS h FROM documents),
c AS (SELECT doc_id, size, h, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM d, poly),
s AS (SELECT * FROM (VALUES {_SHARDS}) v(shard, a, b)),
x AS (SELECT h, shard, b, (h * a + b) % {P} AS x FROM (SELECT DISTINCT h FROM d), s),
y AS (SELECT h, shard, -ln(((xor(x, x >> 15) * 48271 + b) % {P} + 0.5::DOUBLE) / {P}.0::DOUBLE) AS cost FROM x),
w AS (SELECT h, min_by(shard, struct_pack(cost := cost, shard := shard)) FILTER (shard < 40) AS shard, min_by(shard, struct_pack(cost := cost, shard := shard)) AS grown FROM y GROUP BY h)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown::INT AS grown_shard
FROM c JOIN w USING (h)
"""
