"""Operator 3: exact substring deduplication by super-k-mer partitioning."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, table

#: Words in a window; windows are dealt by the least hash of the GRAM-word runs in them.
WINDOW, GRAM = 20, 4
#: Text that a map task tokenizes at once, and packed text it holds back to join copies; packed text of a bucket.
SLICE_BYTES, FLUSH_BYTES, BUCKET_BYTES = 1 << 20, 24 << 20, 6 << 20
#: Buckets that travel in one blob and come to one task: packed by themselves, they would be too small to compress.
GROUP = 8
#: A bucket of more packed text than so many times BUCKET_BYTES is settled on the way, and if most of it stays, dealt anew
#: by whole windows, over so many slots (a byte of the windows' hashes) each time, as long as the hashes have bytes.
HEAVY, SLOTS, LEVELS = 4, 256, 8
#: Compression of packed text; what travels is written to disk on the way, and level 4 makes a tenth less of it than 1.
LEVEL = 4
NO_ID = -(1 << 63)

_draws = np.random.default_rng(WINDOW)
_PLACE = _draws.integers(0, 1 << 64, 4096, np.uint64) | np.uint64(1)
_STEP = [np.uint64(x) for x in _draws.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)]
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _STEP[7]
    return h ^ (h >> np.uint64(32))


def word_table(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of a byte array."""
    word = ~_GAP[buf]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    size = ends - starts
    letters, at = buf[word], np.cumsum(size) - size
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    place &= 4095
    return starts, ends, _mix(np.add.reduceat((letters + np.uint64(1)) * _PLACE[place], at))


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of 20 words: its hash, and its minimiser."""
    n = len(h)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    two = h[:-1] * _STEP[0] + h[1:]
    four = two[:-2] * _STEP[1] + two[2:]
    eight = four[:-4] * _STEP[2] + four[4:]
    sixteen = eight[:-8] * _STEP[3] + eight[8:]
    twenty = sixteen[: n - 19] * _STEP[4] + four[16:]
    least = gram = _mix(four)
    for width in (1, 2, 4, 8):
        least = np.minimum(least[:-width], least[width:])
    return _mix(twenty), np.minimum(least[: n - 19], gram[16:])


def _blob(doc: np.ndarray, text: np.ndarray, start: np.ndarray, to: np.ndarray, inner: np.ndarray, joined: bytes, pack: Callable[[bytes], bytes | int]) -> bytes | int:
    """Super-k-mers (`to`: their bytes, in order of `inner`, their bucket within the group) or word ranges, packed."""
    head = (np.int32(len(doc)), doc.astype(np.int64), text.astype(np.int64), start.astype(np.int32), to.astype(np.int32), inner.astype(np.uint8))
    return pack(b"".join(x.tobytes() for x in head) + joined)


class Packer:
    """Gathers super-k-mers of documents and gives them as compressed blobs, one for each group of buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.slices, self.columns, self.bytes = buckets, [], [], 0

    def add(self, ids: list[int], hashes: list[int], texts: list[bytes]) -> None:
        joined = b" ".join(texts)
        buf = np.frombuffer(joined, np.uint8)
        starts, ends, h = word_table(buf)
        window, least = window_hashes(h)
        if not len(window):
            return
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        owner = np.searchsorted(begin, starts, side="right") - 1
        first = np.searchsorted(starts, begin)
        valid = owner[: len(window)] == owner[WINDOW - 1 :]
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]))
        last = valid.copy()
        last[:-1] &= ~valid[1:] | new[1:]
        if not valid.any():  # short texts, one after the other
            return
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        bucket = (least[a] % np.uint64(self.buckets)).astype(np.int64)
        doc = owner[a]
        count = b - a + 1
        same = _mix(window[a] * _STEP[5] + window[b] * _STEP[6] + count.astype(np.uint64))
        self.columns.append(
            (
                bucket,
                np.array(ids, np.int64)[doc],
                np.array(hashes, np.int64)[doc],
                (a - first[doc]).astype(np.int32),
                count.astype(np.int32),
                same,
            )
        )
        cut = zip(starts[a].tolist(), ends[b + WINDOW - 1].tolist(), strict=True)
        self.slices += [joined[s:e] for s, e in cut]
        self.bytes += int((ends[b + WINDOW - 1] - starts[a]).sum())

    def flush(self, pack: Callable[[bytes], bytes | int] | None = None) -> Iterator[tuple[int, bool, bytes | int]]:
        """(group, decided, blob): super-k-mers, and word ranges that copies met here already decide."""
        if not self.columns:
            return
        bucket, doc, text, start, count, same = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        slices = self.slices
        # copies within this task: all but the first document's are decided, and stay here
        order = np.lexsort((start, text, doc, same))
        repeat = np.r_[False, same[order][1:] == same[order][:-1]]
        leader = order[np.maximum.accumulate(np.where(repeat, 0, np.arange(len(order))))]
        send, gone = np.ones(len(order), bool), []
        for i, r in zip(order[repeat].tolist(), leader[repeat].tolist(), strict=True):
            # the first and the last window cover the words between them
            if count[i] == count[r] <= WINDOW + 1 and (slices[i] == slices[r] or slices[i].split() == slices[r].split()):
                send[i] = False
                if (doc[i], text[i], start[i]) != (doc[r], text[r], start[r]):
                    gone.append(i)
        pack = pack or zstandard.ZstdCompressor(level=LEVEL).compress
        if gone:
            to = start[gone] + count[gone] + WINDOW - 1
            yield int(bucket[gone[0]]) // GROUP, True, _blob(doc[gone], text[gone], start[gone], to, np.zeros(len(gone)), b"", pack)
        order = np.argsort(np.where(send, bucket, np.iinfo(np.int64).max), kind="stable")[: int(send.sum())]
        at = np.flatnonzero(np.r_[True, np.diff(bucket[order] // GROUP) > 0]) if len(order) else []
        for i, j in zip(at, [*at[1:], len(order)], strict=True):
            own = order[i:j]
            parts = [slices[k] for k in own.tolist()]
            size = np.array([len(p) for p in parts], np.int32)
            yield int(bucket[own[0]]) // GROUP, False, _blob(doc[own], text[own], start[own], size, bucket[own] % GROUP, b" ".join(parts), pack)
        self.slices, self.columns, self.bytes = [], [], 0


#: Super-k-mers: document, hash of its text, first word, bytes, and their text with a space between them.
Mers = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]
#: Word ranges: document, hash of its text, from, to.
Ranges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _unpack(blob: bytes) -> tuple[Mers, np.ndarray]:
    """Super-k-mers (or word ranges, `to` in place of their bytes), and each one's bucket within the group."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    doc, text = (np.frombuffer(raw, np.int64, n, 4 + 8 * n * k) for k in range(2))
    start, size = (np.frombuffer(raw, np.int32, n, 4 + 16 * n + 4 * n * k) for k in range(2))
    return (doc, text, start, size, raw[4 + 25 * n :]), np.frombuffer(raw, np.uint8, n, 4 + 24 * n)


def _by_bucket(blob: bytes) -> Iterator[tuple[int, Mers]]:
    (doc, text, start, size, joined), inner = _unpack(blob)
    begin = np.r_[0, np.cumsum(size.astype(np.int64) + 1)]
    at = np.flatnonzero(np.r_[True, np.diff(inner) != 0]).tolist()
    for i, j in zip(at, [*at[1:], len(inner)], strict=True):
        yield int(inner[i]), (doc[i:j], text[i:j], start[i:j], size[i:j], joined[begin[i] : begin[j] - 1])


def repeated(blobs: list[bytes]) -> Ranges:
    """Word ranges of packed super-k-mers covered by windows that start earlier elsewhere."""
    return settle([_unpack(b)[0] for b in blobs], False)[0]


def settle(held: list[Mers], rest: bool = True) -> tuple[Ranges, tuple[Mers, np.ndarray] | None]:
    """Word ranges of one bucket covered by windows that start earlier elsewhere; of the rest (if asked) the windows, each once.

    The rest are super-k-mers again, the first of each window met here, with
    the hashes of all their windows: what later ones of the bucket, or those
    settled elsewhere, have to be held against.

    Sorting window hashes brings equal windows together; each is then compared
    with the first of its kind word by word, so that no two windows are taken
    for equal because of their hashes.
    """
    docs, texts, starts0, sizes, parts = zip(*held, strict=True)
    doc, text, start, size = (np.concatenate(x) for x in (docs, texts, starts0, sizes))
    joined = b" ".join(parts)
    buf = np.frombuffer(joined, np.uint8)
    starts, ends, h = word_table(buf)
    window, _ = window_hashes(h)
    begin = np.cumsum(size.astype(np.int64) + 1) - size - 1
    owner = np.searchsorted(begin, starts, side="right") - 1
    first = np.searchsorted(starts, begin)
    valid = owner[: len(window)] == owner[WINDOW - 1 :]
    at = np.flatnonzero(valid)
    order = np.argsort(window[at], kind="stable")
    sorted_ = window[at][order]
    twin = np.r_[False, sorted_[1:] == sorted_[:-1]]
    twin[:-1] |= twin[1:]
    at = np.sort(at[order[twin]])  # windows that aren't alone
    skm = owner[at]
    where = (start[skm] + (at - first[skm])).astype(np.int64)
    order = np.lexsort((where, text[skm], doc[skm], window[at]))
    head = np.r_[True, window[at][order][1:] != window[at][order][:-1]][: len(at)]
    lead = np.empty(len(at), np.int64)
    lead[order] = at[order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]]
    if len(at):
        lead = _verified(joined, starts, ends, at, lead, window, doc, text, start, owner, first)
    lskm = owner[lead]
    lwhere = start[lskm] + (lead - first[lskm])
    later = (lead != at) & ~((doc[lskm] == doc[skm]) & (text[lskm] == text[skm]) & (lwhere == where))
    kept = None
    if rest:
        valid[at[lead != at]] = False
        stay = np.flatnonzero(valid)
        new = np.r_[True, (np.diff(stay) != 1) | (np.diff(owner[stay]) != 0)][: len(stay)]
        a, b = stay[new], stay[np.r_[new[1:], True][: len(stay)]]
        skm2 = owner[a]
        mers = [joined[i:j] for i, j in zip(starts[a].tolist(), ends[b + WINDOW - 1].tolist(), strict=True)]
        size2 = np.array([len(m) for m in mers], np.int32)
        kept = (doc[skm2], text[skm2], (start[skm2] + (a - first[skm2])).astype(np.int32), size2, b" ".join(mers)), window[stay]
    at, skm, where = at[later], skm[later], where[later]
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(skm) != 0)][: len(at)]
    i = np.flatnonzero(new)
    j = np.r_[i[1:], len(at)][: len(i)] - 1
    return (doc[skm[i]], text[skm[i]], where[i].astype(np.int32), (where[j] + WINDOW).astype(np.int32)), kept


def _verified(joined, starts, ends, at, lead, window, doc, text, start, owner, first) -> np.ndarray:
    """`lead`, corrected where words differ though hashes agree."""

    def words(i: int, n: int = 1) -> bytes:
        return joined[starts[i] : ends[i + n + WINDOW - 2]]

    new = np.r_[True, (np.diff(at) != 1) | (np.diff(lead) != 1) | (np.diff(owner[at]) != 0)]
    i = np.flatnonzero(new)
    n = np.diff(np.r_[i, len(at)])
    keep = lead[i] != at[i]
    wrong = []
    for k, m in zip(i[keep].tolist(), n[keep].tolist(), strict=True):
        one, two = words(at[k], m), words(lead[k], m)
        if one != two and one.split() != two.split():
            wrong += [x for x in range(k, k + m) if words(at[x]).split() != words(lead[x]).split()]
    if wrong:
        lead = lead.copy()
        for value in np.unique(window[at[wrong]]):
            least: dict[tuple, tuple] = {}
            members = np.flatnonzero(window[at] == value).tolist()
            own = {x: tuple(words(at[x]).split()) for x in members}
            for x in members:
                s = owner[at[x]]
                place = (doc[s], text[s], start[s] + at[x] - first[s], at[x])
                least[own[x]] = min(least.get(own[x], place), place)
            for x in members:
                lead[x] = least[own[x]][-1]
    return lead


def _packed(batches: Iterator[pa.RecordBatch], packer: Packer) -> Iterator[list[tuple]]:
    """What the packer gives for rows of doc_id, text_hash, text, flush by flush."""
    for batch in batches:
        ids, hashes, texts = (c.to_pylist() for c in batch.columns)
        i, size = 0, 0
        for j, t in enumerate(texts):
            size += len(t)
            if size >= SLICE_BYTES or j == len(texts) - 1:
                packer.add(ids[i : j + 1], hashes[i : j + 1], texts[i : j + 1])
                i, size = j + 1, 0
                if packer.bytes >= FLUSH_BYTES:
                    yield list(packer.flush())
    yield list(packer.flush())


class Buckets:
    """The buckets of one group in one task: held up to a size, then settled, and dealt anew where that doesn't shrink them.

    A passage that stands anywhere comes once from each map task; settled on
    the way, it is held once, so what a task holds is bounded by `most` bytes
    a bucket whatever arrives.  What is dealt anew goes by whole
    windows, by one more byte of their hashes each time (level: how often it
    was).  Windows of one hash shrink to one, or to those that differ.
    """

    def __init__(self, group: int, level: int, most: int):
        self.group, self.level, self.most = group, level, most
        self.held: dict[int, list[Mers]] = {}
        self.size: dict[int, int] = {}
        self.open: set[int] = set()

    def add(self, blob: bytes) -> Iterator[pa.RecordBatch]:
        for k, mers in _by_bucket(blob):
            self.held.setdefault(k, []).append(mers)
            self.size[k] = self.size.get(k, 0) + len(mers[-1])
            if self.size[k] > self.most:
                yield from self.shrink(k)
        while self.level < LEVELS and sum(self.size.values()) > GROUP * self.most // 2:
            yield from self.shrink(max(self.size, key=self.size.get), True)

    def shrink(self, k: int, away: bool = False) -> Iterator[pa.RecordBatch]:
        """Settles bucket k; what stays is held on, or dealt anew if it is too much (or is to go away)."""
        ranges, (rest, windows) = settle(self.held.pop(k))
        yield _given(ranges)
        self.size[k] = len(rest[-1])
        if self.level < LEVELS and (away or k in self.open or self.size[k] > self.most // 2):
            self.open.add(k)
            self.size[k] = 0
            yield self.dealt(k, rest, windows)
        elif len(rest[0]):
            self.held[k] = [rest]

    def dealt(self, k: int, rest: Mers, windows: np.ndarray) -> pa.RecordBatch:
        doc, text, start, _, joined = rest
        starts, ends, _ = word_table(np.frombuffer(joined, np.uint8))
        begin = np.cumsum(rest[3].astype(np.int64) + 1) - rest[3] - 1
        owner, first = np.searchsorted(begin, starts, side="right") - 1, np.searchsorted(starts, begin)
        at = np.flatnonzero(owner[: len(starts) - WINDOW + 1] == owner[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
        slot = (windows >> np.uint64(8 * self.level)) % np.uint64(SLOTS)
        order = np.argsort(slot, kind="stable")
        cuts = np.searchsorted(slot[order], np.arange(SLOTS + 1, dtype=np.uint64)).tolist()
        pack, rows = zstandard.ZstdCompressor(level=LEVEL).compress, []
        for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i < j:
                own = at[order[i:j]]
                skm = owner[own]
                mers = [joined[x:y] for x, y in zip(starts[own].tolist(), ends[own + WINDOW - 1].tolist(), strict=True)]
                size = np.array([len(m) for m in mers], np.int32)
                # buckets that get one number by chance are settled together, which changes nothing
                name = (((self.group * GROUP + k) % (1 << 52)) * SLOTS + n) % (1 << 62)
                rows.append((name, int(size.sum()), _blob(doc[skm], text[skm], start[skm] + (own - first[skm]), size, np.zeros(len(own)), b" ".join(mers), pack)))
        return _given(None, rows)

    def finish(self) -> Iterator[pa.RecordBatch]:
        for k in sorted(self.held):
            if k in self.open:
                yield from self.shrink(k)
            else:
                yield _given(settle(self.held.pop(k), False)[0])


_SETTLED = "doc_id long, text_hash long, a int, b int, bucket long, size long, blob binary"


def _given(ranges: Ranges | None, dealt: list[tuple[int, int, bytes]] = ()) -> pa.RecordBatch:
    """Rows of _SETTLED: word ranges, or buckets dealt anew."""
    n, m = len(ranges[0]) if ranges else 0, len(dealt)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    cols = [pa.array(x, t) for x, t in zip(ranges, kinds, strict=True)] if ranges else [pa.nulls(m, t) for t in kinds]
    more = [pa.array([row[i] for row in dealt], t) if dealt else pa.nulls(n, t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
    return pa.RecordBatch.from_arrays([*cols, *more], names=[c.split()[0] for c in _SETTLED.split(", ")])


def _settled(packed: DataFrame, parts: int, level: int, most: int) -> DataFrame:
    """packed: bucket (long), decided, blob."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for n, decided, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if decided:
                    yield _given(_unpack(blob)[0][:4])
                    continue
                if own is None or n != own.group:
                    if own is not None:
                        yield from own.finish()
                    own = Buckets(n, level, most)
                yield from own.add(blob)
        if own is not None:
            yield from own.finish()

    # by number, as hashes of it would bring several large groups to one task and none to others
    dealt = packed.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("bucket").mapInArrow(compare, _SETTLED)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Word ranges [a, b) to remove, by (doc_id, text_hash); docs: doc_id (no nulls), text_hash, text (binary)."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(3 * total / BUCKET_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _packed(batches, Packer(buckets)):
            if rows:
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([r[0] for r in rows], pa.int64()),
                        "decided": pa.array([r[1] for r in rows], pa.bool_()),
                        "blob": pa.array([r[2] for r in rows], pa.binary()),
                    }
                )

    packed = docs.mapInArrow(pack, "bucket long, decided boolean, blob binary")
    parts, level, found = max(partitions(docs), math.ceil(buckets / GROUP)), 0, []
    while True:
        # written, as it says whether anything is to be dealt anew
        out = materialize(_settled(packed, parts, level, HEAVY * BUCKET_BYTES))
        found.append(out.where("bucket IS NULL").select("doc_id", "text_hash", "a", "b"))
        left = out.agg(F.sum("size")).first()[0]
        if not left:
            break
        packed = out.where("bucket IS NOT NULL").select("bucket", F.lit(False).alias("decided"), "blob")
        parts, level = max(partitions(docs), math.ceil(left / BUCKET_BYTES / GROUP)), level + 1
    return functools.reduce(lambda a, b: a.unionByName(b), found)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept of every document.

    Words are runs of anything but ASCII white space.  A window is 20
    consecutive words of one document; words covered by a window whose words
    also start earlier (a smaller doc_id, or the same document at an earlier
    word) are removed, all judged on the input.  Null texts have no words; a
    null doc_id comes before all others.  Rows of one doc_id with different
    texts are documents of their own, in the order of the texts' 64-bit hashes; rows
    equal in both are one document, given as often as it stands there.

    Windows that share a minimiser travel as one packed string to its bucket;
    copies that meet in one map task are decided there, so that however many
    copies there are, each task sends a passage once.  A bucket that grows too
    large for its task is settled on the way, which leaves each window once, and
    what is still too large is dealt anew by whole windows.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("given"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    ).select("given", F.coalesce("given", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = repeated_ranges(keyed.select("doc_id", "text_hash", "text"))
    ranges = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("cut"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, cuts = (c.to_pylist() for c in batch.columns)
            words_n, removed, kept = [], [], []
            for text, ranges in zip(texts, cuts, strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in ranges or ():
                    gone[r["a"]] += 1
                    gone[r["b"]] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                words_n.append(len(words))
                removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join(words if not ranges else [words[i] for i in np.flatnonzero(stay).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    both = keyed.join(ranges.hint("shuffle_hash"), ["doc_id", "text_hash"], "left").select("given", "text", "cut")
    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
w AS (SELECT doc_id, s, array_to_string(t[s : s + 19], ' ') AS win FROM (SELECT doc_id, t, unnest(range(1, len(t) - 18)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS pos FROM r, range(20) x(k)),
kept AS (SELECT u.doc_id, count(*) AS n, string_agg(u.word, ' ' ORDER BY u.pos) AS s
  FROM (SELECT doc_id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS pos FROM d) u ANTI JOIN gone g ON g.doc_id = u.doc_id AND g.pos = u.pos GROUP BY 1)
SELECT d.doc_id, len(t)::BIGINT AS n_words, (len(t) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int, str]]:
    """The same from a dictionary of all windows; for tests."""
    seen: set[tuple] = set()
    out = {}
    for doc_id, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - WINDOW + 1):
            w = tuple(words[i : i + WINDOW])
            if w in seen:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
