"""Operator 5: approximate nearest neighbours by NN-descent and greedy graph search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions, table

#: Neighbours kept for a vector, reverse neighbours that take part in a round, rounds at most.
KEPT, REVERSE, ROUNDS = 48, 64, 9
#: A round that renews less than this share of the lists is the last.
SETTLED = 0.02
#: Vectors of a random first group; centres whose neighbourhoods one task joins at a time.
FIRST_GROUP, BLOCK_CENTRES = 128, 4096
#: A query's list is so many times the binary logarithm of the table, and expands a quarter of it in a hop; hops at most;
#: a hop that renews less than this share of the lists is the last.
BEAM, HOPS, FOUND = 8, 3, 0.001
#: Queries that meet all rows at a time in an exact search.
QUERY_BLOCK = 4096
NEVER = float("-inf")

_LISTS = "nbrs array<long>, sims array<float>"


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, e (array of doubles) of the vectors that can take part, once for each id.

    Null ids or vectors, zero vectors, those with null or non-finite components
    and those not of the most frequent length take none; of rows that repeat an
    id the least vector stays.
    """
    fine = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e")).where(
        F.col("id").isNotNull()
        & F.col("e").isNotNull()
        & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("e", lambda x: x != 0)
    )
    top = fine.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = top["d"] if top else 0
    return fine.where(F.size("e") == width).groupBy("id").agg(F.min("e").alias("e"))


def _coded(distinct: DataFrame) -> DataFrame:
    """Adds code (one byte a component) and scale, to steer by; final scores come from the vectors themselves."""
    top = F.array_max(F.transform("e", lambda x: F.abs(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            scale = np.abs(e).max(1, initial=1e-300) / 127
            code = np.rint(e / scale[:, None]).astype(np.int8)
            rows = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), rows, pa.array(scale)], names=["id", "code", "scale"])

    return distinct.where(top > 0).select("id", "e").mapInArrow(run, "id long, code binary, scale double")


def _top(u: np.ndarray, v: np.ndarray, s: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `kept` most similar distinct v of each u, most similar first."""
    order = np.lexsort((v, u))
    u, v, s = u[order], v[order], s[order]
    own = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
    u, v, s = u[own], v[own], s[own]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
    rank = np.arange(len(u)) - np.repeat(at, np.diff(np.r_[at, len(u)]))
    own = rank < kept
    return u[own], v[own], s[own]


def _listed(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
    offsets = pa.array(np.r_[at, len(u)].astype(np.int32))
    return (
        u[at],
        pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))),
        pa.ListArray.from_arrays(offsets, pa.array(s.astype(np.float32))),
    )


def _join_block(rows: pa.Table, star: bool, kept: int) -> pa.RecordBatch:
    """Compares the members of each centre (star: the centre with its members) and gives each side its best."""
    ids = rows.column("id").to_numpy()
    scale = rows.column("scale").to_numpy()
    raw = b"".join(rows.column("code").to_pylist())
    vec = np.frombuffer(raw, np.int8).reshape(len(ids), -1).astype(np.float32) * scale[:, None].astype(np.float32)
    limit = rows.column("limit").to_numpy().astype(np.float32)
    lists = rows.column("centres").combine_chunks()
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    centre, member = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lengths)
    order = np.argsort(centre, kind="stable")
    centre, member = centre[order], member[order]
    at = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
    u, v, s, held = [], [], [], 0

    def shrink() -> None:
        nonlocal u, v, s, held
        if u:
            a, b, c = _top(np.concatenate(u), np.concatenate(v), np.concatenate(s), kept)
            u, v, s, held = [a], [b], [c], 0

    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(centre)], strict=True):
        m = member[i:j]
        if star:
            own = np.flatnonzero(ids[m] == centre[i])
            if not len(own):
                continue
            c = m[own[0]]
            sim = vec[m] @ vec[c]
            a = np.flatnonzero((sim > limit[c]) & (m != c))
            u.append(np.full(len(a), c))
            v.append(m[a])
            s.append(sim[a])
        else:
            if len(m) < 2:
                continue
            x = vec[m]
            sim, t = x @ x.T, limit[m]
            a, b = np.nonzero(sim > t[:, None])  # b may serve a
            a, b = a[a != b], b[a != b]
            u.append(m[a])
            v.append(m[b])
            s.append(sim[a, b])
        held += len(a)
        if held > 1_000_000:
            shrink()
    shrink()
    if not u or not len(u[0]):
        return pa.RecordBatch.from_arrays(
            [pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float32()))], names=["id", "nbrs", "sims"]
        )
    a, nbrs, sims = _listed(u[0], ids[v[0]], s[0])
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), nbrs, sims], names=["id", "nbrs", "sims"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows cut where `key` changes, in pieces of one or more whole keys."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy()
        if rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        last = int(np.flatnonzero(keys == keys[-1])[0])
        if last:
            yield pa.Table.from_batches([*rest, b.slice(0, last)])
            rest = []
        rest.append(b.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def _compared(pairs: DataFrame, state: DataFrame, blocks: int, star: bool, kept: int) -> DataFrame:
    """pairs (centre, member) -> id, nbrs, sims: what neighbourhoods have found for their members.

    A vector goes to each block of centres once, with the list of those centres.
    """
    block = F.pmod(F.xxhash64("centre"), F.lit(blocks)).cast("int")
    memberships = pairs.groupBy(F.col("member").alias("id"), block.alias("block")).agg(F.collect_set("centre").alias("centres"))
    limit = F.when(F.size("sims") >= kept, F.element_at("sims", kept)).otherwise(F.lit(NEVER)).cast("float")
    rows = memberships.join(state.select("id", "code", "scale", limit.alias("limit")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "block"):
            keys = t.column("block").to_numpy()
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
                yield _join_block(t.slice(i, j - i), star, kept)

    return rows.repartition(max(partitions(rows), blocks), "block").sortWithinPartitions("block").mapInArrow(run, f"id long, {_LISTS}")


def _merged(state: DataFrame, found: DataFrame, kept: int, inner: bool = False) -> DataFrame:
    """state with the best of its lists and those found; changed counts the entries that are new."""
    names = ["id", "code", "scale", "nbrs", "sims"]
    both = state.select(*names).unionByName(
        found.select("id", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("scale"), "nbrs", "sims")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "id"):
            t = t.combine_chunks()
            ids, base = t.column("id").to_numpy(), np.asarray(t.column("code").is_valid())
            nbrs = t.column("nbrs").combine_chunks()
            lengths = np.asarray(nbrs.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            u, old = np.repeat(ids, lengths), np.repeat(base, lengths)
            v = nbrs.flatten().to_numpy()
            s = t.column("sims").combine_chunks().flatten().to_numpy()
            rows = np.flatnonzero(base)
            a, b, c = _top(u, v, s, kept)
            before = _pairs(u[old], v[old])
            fresh = ~np.isin(_pairs(a, b), before)
            own = ids[rows]  # sorted, one row each
            start = np.searchsorted(a, own)
            stop = np.searchsorted(a, own, side="right")
            offsets = pa.array(np.r_[start, stop[-1:] if len(stop) else [0]].astype(np.int32))
            total = np.r_[0, np.cumsum(fresh)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own),
                    t.column("code").take(pa.array(rows)).combine_chunks(),
                    t.column("scale").take(pa.array(rows)).combine_chunks(),
                    pa.ListArray.from_arrays(offsets, pa.array(b)),
                    pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.float32))),
                    pa.array((total[stop] - total[start]).astype(np.int32)),
                ],
                names=[*names, "changed"],
            )

    dealt = both.repartition(partitions(both), "id").sortWithinPartitions("id", F.col("code").isNull())
    return dealt.mapInArrow(run, f"id long, code binary, scale double, {_LISTS}, changed int")


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit number for a pair, to count by; never used to decide what stays."""
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def build_graph(nodes: DataFrame, kept: int = KEPT, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """NN-descent: id, code, scale -> with nbrs, sims, each vector's most similar others as far as found.

    First everyone meets in random groups.  Then, round by round, the
    neighbours of each vector, and up to `reverse` of those that have it for a
    neighbour, are compared with each other; what one finds better than its
    worst goes to its list.
    """
    n = nodes.count()
    blocks = max(partitions(nodes), math.ceil(n / BLOCK_CENTRES))
    empty = nodes.select("*", F.array().cast("array<long>").alias("nbrs"), F.array().cast("array<float>").alias("sims"))
    groups = max(1, n // FIRST_GROUP)
    meet = [F.pmod(F.xxhash64("id", F.lit(r)), F.lit(groups)) + r * groups for r in range(2 if groups > 1 else 1)]
    pairs = nodes.select(F.explode(F.array(*meet)).alias("centre"), F.col("id").alias("member"))
    state = checkpoint(_merged(empty, _compared(pairs, empty, blocks, False, kept), kept))
    for r in range(rounds):
        edges = state.select(F.col("id").alias("u"), F.explode("nbrs").alias("v"))
        order = Window.partitionBy("v").orderBy(F.xxhash64("u", "v", F.lit(r)))
        edges = edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= reverse)
        ends = F.array(F.struct(F.col("u").alias("centre"), F.col("v").alias("member")), F.struct(F.col("v").alias("centre"), F.col("u").alias("member")))
        pairs = edges.select(F.explode(ends).alias("p")).select("p.*")
        state = checkpoint(_merged(state, _compared(pairs, state, blocks, False, kept), kept))
        if (state.agg(F.sum("changed")).first()[0] or 0) < SETTLED * n * kept:
            break
    return state


def search_graph(state: DataFrame, queries: DataFrame, kept: int | None = None, hops: int = HOPS) -> DataFrame:
    """Greedy search from each query's own node (column id): its list after expanding its best nodes' neighbours.

    The list holds `kept` nodes, by default BEAM for each doubling of the table
    (KEPT at least): the larger it is, the wider a search must be to miss as
    little.  Each hop expands the nearest quarter of as many not expanded before,
    until one renews less than a share FOUND of the lists, `hops` at most.
    """
    n = state.count()
    blocks = max(partitions(state), math.ceil(n / BLOCK_CENTRES))
    kept = max(KEPT, BEAM * math.ceil(math.log2(n + 1))) if kept is None else kept
    beam = state.join(queries, "id", "left_semi").withColumn("done", F.array().cast("array<long>"))
    for _ in range(hops):
        beam = beam.withColumn("todo", F.slice(F.array_except("nbrs", "done"), 1, max(1, kept // 4)))
        front = beam.select(F.col("id").alias("centre"), F.explode("todo").alias("f"))
        reached = front.join(state.select(F.col("id").alias("f"), "nbrs"), "f").select("centre", F.explode("nbrs").alias("member"))
        pairs = reached.unionByName(beam.select(F.col("id").alias("centre"), F.col("id").alias("member")))
        found = _compared(pairs, state, blocks, True, kept)
        grown = _merged(beam, found, kept)
        seen = beam.select("id", F.array_union("done", "todo").alias("done"))
        beam = checkpoint(grown.join(seen, "id"))
        now = beam.agg(F.sum("changed"), F.count("*")).first()
        if (now[0] or 0) <= FOUND * kept * now[1]:
            break
    return beam.select("id", "nbrs")


def nearest(rows: DataFrame, k: int = 20, is_query: Callable[[Column], Column] | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k of largest inner product found for each query among all other rows.

    Equal vectors are one node of the graph: their rows join its neighbours at
    the end, as many as can count.  Scores are exact, in double precision; ties
    go to the smaller vec_id.  An empty table gives none; a query with fewer
    than k others gets all.
    """
    own = checkpoint(usable(rows, key, vector))
    query = is_query or (lambda c: c % 20 == 0)
    groups = own.groupBy("e").agg(F.min("id").alias("node"))
    nodes = checkpoint(_coded(groups.select(F.col("node").alias("id"), "e")))
    within = Window.partitionBy("node").orderBy("id")
    member = checkpoint(own.join(groups, "e").select("id", "node"))
    first = member.withColumn("r", F.row_number().over(within)).where(F.col("r") <= k + 1).select("id", "node")
    asking = member.where(query(F.col("id")))
    state = build_graph(nodes)
    found = search_graph(state, asking.select(F.col("node").alias("id")).distinct())
    near = found.select(F.col("id").alias("node"), F.explode(F.array_union("nbrs", F.array("id"))).alias("near"))
    candidates = (
        asking.select(F.col("id").alias("query_id"), "node")
        .join(near, "node")
        .join(first.select(F.col("id").alias("vec_id"), F.col("node").alias("near")), "near")
        .where(F.col("vec_id") != F.col("query_id"))
        .select("query_id", "vec_id")
    )
    scored = (
        candidates.join(own.select(F.col("id").alias("query_id"), F.col("e").alias("q")), "query_id")
        .join(own.select(F.col("id").alias("vec_id"), F.col("e").alias("c")), "vec_id")
        .withColumn("score", F.aggregate(F.zip_with("q", "c", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(rows: DataFrame, k: int = 20, is_query: Callable[[Column], Column] | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """What nearest() gives, from every query against every row: to measure recall by, or where none may be missed.

    Queries meet all rows in blocks of QUERY_BLOCK, which bounds what is
    broadcast; each task gives its own k best of a block's queries.  What takes
    part, ties and repeated rows are as in nearest(); an empty table, or one
    without queries, gives none.
    """
    own = checkpoint(usable(rows, key, vector))
    asking = own.where((is_query or (lambda c: c % 20 == 0))(F.col("id")))
    blocks = max(1, math.ceil(asking.count() / QUERY_BLOCK))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for n in range(blocks):
        block = asking.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).collect()
        ids, q = np.array([r["id"] for r in block], np.int64), np.array([r["e"] for r in block], float)
        shared = rows.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                v = b.column(0).to_numpy()
                e = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                for at in range(0, len(ids), 256):
                    s = np.zeros((len(ids[at : at + 256]), len(v)))
                    for x in range(e.shape[1]):  # added in the order of the components, as elsewhere
                        s += q[at : at + 256, x, None] * e[None, :, x]
                    s[ids[at : at + 256, None] == v] = -np.inf
                    top = np.lexsort((np.broadcast_to(v, s.shape), -s), axis=1)[:, :k]
                    score = np.take_along_axis(s, top, 1)
                    u, w = np.nonzero(score > -np.inf)
                    cols = [pa.array(ids[at : at + 256][u]), pa.array(v[top[u, w]]), pa.array(score[u, w])]
                    yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

        found = own.select("id", "e").mapInArrow(run, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
