"""Operator 2: SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, partitions, table, unused

BITS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A bucket of more fingerprints than this is compared in pairs of parts of this size.
PART = 2048


def _ones(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes, 65,280 at most, each bit is set."""
    lanes = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    return np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = 4, seeds: int = 1) -> list[int]:
    """Unsigned 64-bit SimHashes of a text: majority bits of its shingles' XXH64 (seed 42), then of mixes of these."""
    words = text.lower().split() if text else []  # bytes: A-Z alone, and ASCII white space
    if not words:
        return [0] * seeds
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths).tolist(), ends[shingle - 1 :].tolist() or [len(joined)]
    ones, n = np.zeros((seeds, BITS), np.int64), len(stops)
    for at in range(0, n, 65_280):  # 256 rows of 255, whose sums of bits fit in bytes
        part = zip(starts[at : at + 65_280], stops[at : at + 65_280], strict=False)
        h = np.array([digest(joined[a:b], 42) for a, b in part], np.uint64)
        for k in range(seeds):
            if k:
                h = (h ^ (h >> np.uint64(31))) * _MIX
                h ^= h >> np.uint64(29)
            ones[k] += _ones(h)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def fingerprints(docs: DataFrame, shingle: int = 4, seeds: int = 1) -> DataFrame:
    """doc_id, text_hash (to tell rows of one doc_id apart), fps (fingerprints as signed longs) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle, seeds) for t in b.column(2)]
            fps = pa.array(np.array(found, np.uint64).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, seeds, dtype=np.int32)), fps)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["doc_id", "text_hash", "fps"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, text_hash long, fps array<long>")


def plan_blocks(n: int, distance: int) -> int:
    """Into how many blocks to cut: least rows sent plus pairs met by chance, for n random fingerprints.

    With b blocks, a pair at `distance` or fewer bits agrees on b - distance of
    them at least, so C(b, distance) tables find every pair, whatever b is.
    """

    def cost(b: int) -> float:
        tables, key_bits = math.comb(b, distance), BITS * (b - distance) / b
        return tables * n + tables * n * n / 2 ** (key_bits + 1)

    return min(range(distance + 1, distance + 6), key=cost)


def _choices(n: int, distance: int) -> list[int]:
    """Masks of the blocks that candidates may share: every choice of plan_blocks, so that no pair is missed."""
    blocks = plan_blocks(n, distance)
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(whole, blocks - distance)]


def _bucket_rows(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """A row (tab, bits, node) for each choice of blocks; bits: what the fingerprint has there."""

    def bits(m: int) -> Column:
        return F.col("fp").bitwiseAND(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m))

    keys = F.array(*[F.struct(F.lit(i).alias("tab"), bits(m).alias("bits")) for i, m in enumerate(masks)])
    return nodes.select("node", F.get("fps", 0).alias("fp")).select("node", F.explode(keys).alias("k")).select("k.tab", "k.bits", "node")


def _forest(nodes: np.ndarray, fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that join the nodes linked within one bucket: a star for each tree.  fps: nodes x seeds."""
    edges = []
    while len(nodes) > 1:
        root, front, nodes, fps = nodes[0], [fps[0]], nodes[1:], fps[1:]
        while front and len(nodes):
            near = np.bitwise_count(fps ^ front.pop()).sum(1) <= most
            if near.any():
                edges += [(int(root), int(x)) for x in nodes[near]]
                front += list(fps[near])
                nodes, fps = nodes[~near], fps[~near]
    return edges


def _links(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (tab, bits, part) -> verified edges; a bucket holds two parts at most."""

    def pairs(p: pd.DataFrame) -> pd.DataFrame:
        keys = [p[k].values for k in ("tab", "bits", "part")]
        new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
        at = np.flatnonzero(new)
        size, node = np.diff(np.r_[at, len(p)]), p["node"].values.astype(np.int64)
        fps = np.array(p["fps"].tolist(), np.int64).view(np.uint64).reshape(len(p), -1)
        two = at[size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]).sum(1) <= most
        out = [np.stack([node[two], node[two + 1]], 1)[near]]
        for i, n in zip(at[size > 2], size[size > 2], strict=True):
            if e := _forest(node[i : i + n], fps[i : i + n], most):
                out.append(np.array(e, np.int64))
        e = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    rest = None
    for p in batches:
        p = p if rest is None else pd.concat([rest, p], ignore_index=True)
        if not len(p):
            continue
        last = p.iloc[-1]
        same = (p["tab"].values == last["tab"]) & (p["bits"].values == last["bits"]) & (p["part"].values == last["part"])
        whole, rest = p[~same], p[same]
        if len(whole):
            yield pairs(whole.reset_index(drop=True))
    if rest is not None and len(rest):
        yield pairs(rest.reset_index(drop=True))


def _in_parts(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, part, node: a group's nodes dealt over its `parts`, and each sent to every pair of parts with its own in it."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own")),
    )
    part = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(others))
    return rows.withColumn("own", own).withColumn("part", part).select(*group, "part", "node")


def link_fingerprints(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Edges a, b that connect linked nodes; nodes: node (distinct), fps (its one fingerprint).

    Nodes link if their fingerprints differ in `distance` bits or fewer.
    Candidates share a choice of blocks, so that no link is missed.  They meet
    in one bucket, where distances are verified; a bucket gives a star for each
    tree, not all its pairs.  A bucket above PART nodes is cut into parts, and
    every two parts meet as a bucket of their own, so that no task holds more
    than two.
    """
    rows = _bucket_rows(nodes, _choices(nodes.count(), distance))
    sizes = rows.groupBy("tab", "bits").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["tab", "bits"]).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    met = _in_parts(rows, ["tab", "bits"]).join(nodes.select("node", "fps"), "node").select("tab", "bits", "part", "node", "fps")
    dealt = met.repartition(partitions(nodes), "tab", "bits", "part").sortWithinPartitions("tab", "bits", "part", "node")
    return dealt.mapInPandas(lambda it: _links(it, distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp (a signed long), component_id of every document.

    Fingerprints of distinct documents link at `distance` or fewer differing
    bits; component_id is the smallest doc_id reachable.  Documents without
    words (null, empty) have fingerprint zero and link as any other; null
    doc_ids are never the smallest; rows that repeat keep their place; an empty
    table gives none.  Exact copies are one fingerprint from the start.
    """
    prints = checkpoint(fingerprints(docs, shingle))
    prints = prints.withColumn("node", F.get("fps", 0))
    return _grouped(prints, lambda nodes: link_fingerprints(nodes, distance)).select("doc_id", F.col("node").alias("fp"), "component_id")


def _grouped(prints: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, node of prints with component_id and keep: the group's first (doc_id, text_hash), null doc_ids last.

    prints: doc_id, text_hash, node, and columns that follow from the node (fps among them).  link gives edges a, b
    of the distinct nodes (node, those columns, and id and hash of the first of its documents).
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    own = [c for c in prints.columns if c not in ("doc_id", "text_hash", "node")]
    distinct = checkpoint(
        prints.groupBy("node").agg(*[F.min(c).alias(c) for c in own], F.min("doc_id").alias("first"), F.min(order).alias("least"))
    )
    one = [F.coalesce("least.doc_id", F.lit(-(1 << 63))).alias("id"), F.col("least.text_hash").alias("hash")]
    roots = components(link(distinct.select("node", *own, *one)))
    placed = distinct.select("node", "first", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.min("least").alias("keep"))
    return prints.select("doc_id", "node").join(placed.join(smallest, "root").select("node", "component_id", "keep"), "node")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The pipeline's near-duplicates: sets of five-word shingles of similarity (shared over all) 4/5 or more, which are
#: compared exactly in groups of linked SimHashes.  As a pair of similarity 0.8 differs in some 10 of 64 bits, pairs of
#: different such groups also meet if they share one of BANDS of ROWS minima each: a pair of similarity 0.8 agrees on a band with a chance of 0.8^6 = 0.262, so on none of 24 with
#: one of 0.0007, whatever the number of documents; one of 0.5 meets with a chance of 0.31, and is then turned down.
STAGE_SHINGLE, BANDS, ROWS = 5, 24, 6
#: A group of more shingles than this is compared in pairs of parts of this size.
PART_SHINGLES = 1 << 20
_DRAW = np.random.default_rng(6)
_FACTORS = _DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted XXH64s; a shorter text is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    grams = (b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def set_fingerprint(found: np.ndarray) -> list[int]:
    """The SimHash (a signed long) of a set of hashes, each counted once; none of the empty set."""
    if not len(found):
        return []
    ones = sum(_ones(found[at : at + 65_280]) for at in range(0, len(found), 65_280))
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.int64).tolist()


def bands(found: np.ndarray) -> list[int]:
    """Signed hashes of a set's bands of minima; none of the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):  # bounds the array
        np.minimum(least, (found[at : at + 2048, None] * _FACTORS + _SHIFTS).min(0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in least.reshape(BANDS, ROWS)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (a hash of the text's set of shingles), n (its size), fps (its SimHash), bands of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column(2)]
            nodes = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            lists = [pa.array([of(s) for s in sets], pa.list_(pa.int64())) for of in (set_fingerprint, bands)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), nodes, sizes, *lists], names=["doc_id", "text_hash", "node", "n", "fps", "bands"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, text_hash long, node long, n long, fps array<long>, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, s (its shingles as signed longs), from the one document (id, hash) given of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(t.as_buffer().to_pybytes()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["node", "s"])

    texts = docs.select(_key(docs).alias("id"), F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text"))
    return texts.join(nodes.select("node", "id", "hash"), ["id", "hash"]).select("node", "text").mapInArrow(run, "node long, s array<long>")


def similar_forest(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join the nodes whose sets share four fifths of their union: a star for each tree, all exact.

    Each node reached is held against all those not reached yet, at once: their
    shingles are looked up in a table of its own.  Whole numbers decide, so that 0.8 itself counts.
    """
    size = np.array([len(s) for s in sets])
    if len(nodes) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(nodes[0]), int(nodes[1]))] if 9 * shared >= 4 * size.sum() else []
    words, code = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(code, np.cumsum(size)[:-1])
    mark, left, edges = np.zeros(len(words), np.int32), np.arange(len(nodes)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front, flat = [root], np.concatenate([own[k] for k in left])
        while front and len(left):
            x = front.pop()
            mark[own[x]] = 1
            shared = np.add.reduceat(mark[flat], np.cumsum(size[left]) - size[left])
            mark[own[x]] = 0
            near = 9 * shared >= 4 * (size[left] + size[x])
            if near.any():
                edges += [(int(nodes[x]), int(nodes[k])) for k in left[near]]
                front += left[near].tolist()
                flat, left = flat[np.repeat(~near, size[left])], left[~near]
    return edges


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, node, s) sorted by (a, part) -> verified edges a, b; one group is held at a time."""
    held: dict[int, np.ndarray] = {}
    group, found = None, []

    def close() -> None:
        if len(held) > 1:
            found.extend(similar_forest(np.array(list(held)), list(held.values())))
        held.clear()

    def out() -> pa.RecordBatch:
        e = np.array(found, np.int64).reshape(-1, 2)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    for batch in batches:
        a, part, node = (batch.column(k).to_numpy() for k in range(3))
        s = batch.column(3)
        flat, at = s.flatten().to_numpy(), np.r_[0, np.cumsum(s.value_lengths().to_numpy())]
        for k in range(len(a)):
            if group != (a[k], part[k]):
                close()
                group = (a[k], part[k])
            held[int(node[k])] = flat[at[k] : at[k + 1]]
        if found:
            yield out()
    close()
    if found:
        yield out()


def simhash_groups(nodes: DataFrame) -> DataFrame:
    """node, n, root (one of its group, a fingerprint) of every node that has shingles: groups of linked fingerprints."""
    prints = nodes.where("n > 0").select("node", "n", F.get("fps", 0).alias("fp"))
    distinct = checkpoint(prints.select(F.col("fp").alias("node")).distinct())
    roots = components(link_fingerprints(distinct.withColumn("fps", F.array("node")))).select(F.col("node").alias("fp"), "root")
    return checkpoint(prints.join(roots, "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("root")))


def link_similar(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges a, b that connect the nodes whose shingles are similar; nodes: node, n (size of its set), fps (its SimHash), bands, id, hash.

    Nodes whose SimHashes are linked (blocks by pigeonhole, then four differing
    bits) are one group, in which all pairs are compared exactly.  What differs
    in more bits meets by bands: all in buckets whose least node is a are one
    group, a's, so a node goes to each such a once, however many bands they
    share; a group whose nodes are all of one SimHash group has been compared
    there and is not sent again.  Groups give a spanning star of each tree.  A
    group of more than PART_SHINGLES is cut into parts, and every two parts meet
    as a group of their own, so that no task holds more than two.
    """
    placed = simhash_groups(nodes)
    rows = nodes.select("node", F.posexplode("bands").alias("tab", "bits"))
    buckets = rows.groupBy("tab", "bits").agg(F.count("*").alias("c"), F.min("node").alias("a")).where("c > 1")
    pairs = rows.join(buckets.select("tab", "bits", "a"), ["tab", "bits"]).select("a", "node").distinct()
    met = checkpoint(pairs.join(placed, "node"))
    mixed = met.groupBy("a").agg(F.sum("n").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    alike = placed.groupBy("root").agg(F.sum("n").alias("size"), F.count("*").alias("c")).where("c > 1")
    together = placed.join(alike.select("root", "size"), "root").select(F.col("root").alias("a"), "node", "n", "size")
    groups = checkpoint(met.select("a", "node", "n").join(mixed.select("a", "size"), "a").select("a", "node", "n", "size").unionByName(together))
    sent = _in_parts(groups.withColumn("parts", F.ceil(F.col("size") / PART_SHINGLES).cast("int")), ["a"])
    sets = _sets(docs, nodes.join(groups.select("node").distinct(), "node", "left_semi"))
    whole = sent.join(sets, "node").select("a", "part", "node", "s")
    volume = groups.agg(F.sum("n")).first()[0] or 0
    dealt = whole.repartition(max(partitions(nodes), math.ceil(volume / PART_SHINGLES)), "a", "part").sortWithinPartitions("a", "part")
    return dealt.mapInArrow(_compare, "a long, b long")


def _key(docs: DataFrame) -> Column:
    """The doc_id, and one value for all null ones."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group, that with the smallest doc_id (null ones last); of equal rows, one.

    Documents link if their sets of five-word shingles, met by SimHash or by
    bands, have a similarity of 0.8 or more; a group is all that is linked.  Texts without words are one group.
    """
    found = _grouped(checkpoint(sketches(docs)), lambda nodes: link_similar(nodes, docs))
    gid, ghash = unused(docs, "id", "hash")
    kept = found.select(F.coalesce("keep.doc_id", F.lit(-(1 << 63))).alias(gid), F.col("keep.text_hash").alias(ghash)).distinct()
    own = docs.withColumn(gid, _key(docs)).withColumn(ghash, F.xxhash64("text"))
    return own.join(kept, [gid, ghash]).dropDuplicates([gid, ghash]).select(*docs.columns)
