"""Operator 12: periodic runs of words by seeds and extension along diagonals."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

#: A run repeats its period REPEATS times at least, and has LEAST words.
REPEATS, LEAST = 4, 6
#: Words of several documents that are looked at together; bytes of a text that are split at a time.
CHUNK_WORDS, PIECE = 1 << 19, 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some PIECE bytes at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def _repeated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose pair (a, b) stands at another one too, by pair and position, and where each pair begins among them; -1 is no name."""
    at = np.flatnonzero((a >= 0) & (b >= 0))
    pair = a[at] << 32 | b[at]
    order = np.argsort(pair, kind="stable")
    pair, at = pair[order], at[order]
    same = np.zeros(len(at), bool)
    same[1:] = pair[1:] == pair[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    return at[twice], ~same[twice]


def _named(n: int, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    name = np.full(n, -1, np.int64)
    name[at] = np.cumsum(new) - 1
    return name


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    return np.r_[x[by:], np.full(min(by, len(x)), -1, np.int64)]


def _matched(code: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The largest stretch [l, r) round `at` whose words are those `lag` further on."""
    right, step = at, 64
    while (m := min(step, len(code) - lag - right)) > 0:
        same = code[right : right + m] == code[right + lag : right + lag + m]
        if not same.all():
            right += int(same.argmin())
            break
        right, step = right + m, min(2 * step, 1 << 16)
    left, step = at, 64
    while (m := min(step, left)) > 0:
        same = (code[left - m : left] == code[left - m + lag : left + lag])[::-1]
        if not same.all():
            left -= int(same.argmin())
            break
        left, step = left - m, min(2 * step, 1 << 16)
    return left, right


def find_runs(code: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence; code: numbers of words, those of different documents different.

    A run of period q overlaps itself, q words on, by 3q words (period 1: by 5),
    so it holds two occurrences q apart of every k-gram within that overlap.
    Periods of [p, 2p) are sought by k-grams of the least overlap, 3p words (5
    and 6 for periods 1, 2 and 3).  As 3p is above 1.5q, a third occurrence
    between these two would give the run a smaller period; so each occurrence is
    paired with the next one alone, which finds every run and never one at a
    multiple of its period.  A pair is a diagonal (its lag), on which it is
    extended both ways; `furthest` holds where the last extension of each lag
    ended, and pairs before that are passed over.  Names of 2, 4, 8, ... words
    come from names of half as many, for words that are repeated at all.
    """
    n, found = len(code), []
    furthest: dict[int, int] = {}
    name = _named(n, *_repeated(code, np.zeros(n, np.int64)))
    width, low = 1, 1
    while REPEATS * low <= max(longest, LEAST) and (name >= 0).any():
        while width < max(4, 2 * low):
            name = _named(n, *_repeated(name, _shifted(name, width)))
            width *= 2
        gram = 5 if low == 1 else 3 * low
        at, new = _repeated(name, _shifted(name, gram - width))
        lag = np.diff(at)
        pair = np.flatnonzero(~new[1:] & (lag >= low) & (lag < 2 * low))
        at, lag = at[pair], lag[pair]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        head = np.r_[True, (np.diff(at) != 1) | (np.diff(lag) != 0)] if len(at) else []
        for i, q in zip(at[head].tolist(), lag[head].tolist(), strict=True):
            if i < furthest.get(q, -1):
                continue
            left, furthest[q] = _matched(code, i, q)
            length = furthest[q] - left + q
            if length >= max(LEAST, REPEATS * q):
                found.append((left, length, q))
        low *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(text: bytes, gone: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    kept, at = [], 0
    for words in pieces(text):
        drop = gone[at : at + len(words)]
        at += len(words)
        kept.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if drop.any() else words))
    return b" ".join(k for k in kept if k)


def _chunk(texts: list[bytes], codes: list[np.ndarray]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, collapsed text) of each document."""
    size = np.array([len(c) for c in codes])
    begin = np.cumsum(size) - size
    found = find_runs(np.concatenate(codes), int(size.max(initial=0)))
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, q in found:
        d = int(np.searchsorted(begin, start, side="right")) - 1
        own[d].append((start - int(begin[d]), length, q))
    out = []
    for text, n, runs in zip(texts, size.tolist(), own, strict=True):
        edge = np.zeros(n + 1, np.int64)
        for start, length, q in runs:
            edge[start + q] += 1
            edge[start + length] -= 1
        out.append((n, runs, _collapsed(text, np.cumsum(edge)[:n] > 0)))
    return out


_RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed text of every document.

    Words are runs of anything but ASCII white space.  A run is a stretch of
    consecutive words with smallest period q (words q apart are the same) of
    max(6, 4q) words or more that can be extended neither way; collapsed is the
    text without the words that some run holds after its first q, joined by one
    space.  Each text is looked at as a whole, whatever its length, in memory of
    some 100 bytes a word; nothing is shuffled.  A null or empty text has no
    words, no runs and an empty collapsed text; rows that repeat and null
    doc_ids each keep their row; an empty table gives none; other columns, of
    any name, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(ids: list, texts: list[bytes], codes: list[np.ndarray]) -> pa.RecordBatch:
            n, runs, kept = zip(*_chunk(texts, codes), strict=True)
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            ends = pa.array(np.r_[0, np.cumsum([len(r) for r in runs])], pa.int32())
            cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], names=["start", "length", "period"])
            cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, cells), pa.array(kept, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "collapsed"])

        for b in batches:
            ids, texts, codes, base, size = [], [], [], 0, 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                seen: dict[bytes, int] = {}
                parts = [np.fromiter((seen.setdefault(w, base + len(seen)) for w in words), np.int64, len(words)) for words in pieces(raw)]
                ids.append(doc)
                texts.append(raw)
                codes.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
                base, size = base + len(seen), size + len(codes[-1])
                if size >= CHUNK_WORDS:
                    yield give(ids, texts, codes)
                    ids, texts, codes, base, size = [], [], [], 0, 0
            if ids:
                yield give(ids, texts, codes)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = source.mapInArrow(run, f"doc_id long, n_words long, runs {_RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose last words repeat with some period, in each tenth document; null doc_ids are none of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.nullif(F.size(words), F.lit(0)).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    both = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (F.size(words) > 0), both).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # the longest, then the first, then that of the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("fine"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]))
    digest = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(digest, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.fine")
    return out.select(
        "doc_id", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: Every pair of equal five-word sequences, chained to stretches; of equal stretches the smallest period counts.
OP12_SQL = r"""
WITH RECURSIVE poly AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)::BIGINT AS h FROM documents, poly),
e AS MATERIALIZED (SELECT doc_id, w, h, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1)::INT]) ELSE w END AS w FROM e),
p AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word, unnest(list_transform(range(n), lambda i: CASE WHEN i + 5 <= n THEN array_to_string(w[i + 1:i + 5], ' ') END)) AS gram FROM f),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS lag FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
r AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM q),
s AS (SELECT doc_id, lag AS period, min(i) AS start, count(*) + 4 + lag AS length FROM r GROUP BY doc_id, lag, island HAVING count(*) + 4 + lag >= greatest(6, 4 * lag)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(period) AS period FROM s GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i WHERE gone.i IS NULL GROUP BY p.doc_id),
best AS (SELECT doc_id, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY doc_id)
SELECT f.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM f LEFT JOIN lines ON f.doc_id = lines.doc_id LEFT JOIN best ON f.doc_id = best.doc_id LEFT JOIN kept ON f.doc_id = kept.doc_id
"""
