"""Operator 11: spelling variants by dynamic programming down sorted lists of words."""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, partitions, table

#: Words are runs of these letters, all of one byte in Latin-1; A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
#: Code points and occurrences that a word must have; a form is so many times as frequent as its variant.
LENGTH, OCCURS, TIMES = 6, 5, 5
#: A list of more words than this is compared in pairs of parts; words that walk down their lists together; words counted in a task before they are passed on.
PART_WORDS, BLOCK, HELD = 1 << 16, 4096, 1 << 18

Edit = Callable[[int | None, str], str]


def word_counts(docs: DataFrame, edit: Edit | None = None, length: int = LENGTH, occurs: int = OCCURS) -> DataFrame:
    """word, n (occurrences) of the words of at least `length` code points and `occurs` occurrences in all whole texts.

    `edit` gives another spelling of a word of a document.  Null and empty texts
    have no words; repeated rows count each; an empty table gives none.
    """
    run_of = re.compile(f"[{LETTERS}]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        held: Counter[str] = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                # bytes lower-case A-Z alone
                own = Counter(m[0] for m in run_of.finditer(text.as_buffer().to_pybytes().lower().decode()))
                for word, n in own.items():
                    word = edit(doc, word) if edit else word
                    if len(word) >= length:
                        held[word] += n
                if len(held) >= HELD:
                    yield give()
        yield give()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= occurs)


def _lists(words: DataFrame, length: int) -> DataFrame:
    """back, size, half, part, own, s, n: the lists that each word stands in, sorted within tasks.

    Two words one edit apart, the shorter of `size` code points, share their
    first or their last size // 2 ones.  So a word stands in the list of its
    first (back: last) size // 2 letters for its own length and that less one:
    in such a list are words of `size` and one more.  s is the word, or the word
    reversed.  A list of more than PART_WORDS is cut into parts, and every two
    parts meet as a list of their own.
    """
    size = F.char_length("word")
    sizes = F.explode(F.filter(F.array(size, size - 1), lambda k: k >= max(2, length)))
    rows = words.select("word", "n", sizes.alias("size"))
    rows = rows.select("n", "size", F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("s")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("s")))).alias("w"))
    rows = rows.select("w.back", "size", F.substring("w.s", F.lit(1), F.floor(F.col("size") / 2).cast("int")).alias("half"), "w.s", "n")
    keys = ["back", "size", "half"]
    large = rows.groupBy(*keys).count().where(F.col("count") > PART_WORDS).withColumn("parts", F.ceil(F.col("count") / PART_WORDS).cast("int")).drop("count")
    rows = rows.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own")))
    rows = rows.withColumn("own", own).withColumn("part", F.explode(pair)).withColumn("mixed", F.floor(F.col("part") / F.col("parts")) != F.col("part") % F.col("parts"))
    dealt = rows.repartition(partitions(words), *keys, "part")
    return dealt.sortWithinPartitions(*keys, "part", "s").select("back", "size", "half", "part", "mixed", "own", "s", "n")


def neighbours(texts: list[str], group: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (of either order) of words one edit apart, within each group; the shorter word has `size` code points.

    texts: sorted within each group, distinct, all words of a group with the
    same first size // 2 letters.  A word walks down its sorted list as down a
    tree: the words of a range share a prefix of some depth (what the LCPs of
    adjacent words say), so its row of the edit matrix, as far as one edit
    reaches - three cells -, is worked out once for the whole range.  Ranges
    are split where the LCP is no longer than the depth, and one whose cells are
    all above one edit is skipped with all that is in it.
    """
    n = len(texts)
    length = np.array([len(t) for t in texts])
    begin = np.cumsum(length + 1) - length - 1
    # a zero ends each word
    letters = np.frombuffer("\0".join(texts).encode("latin-1") + b"\0", np.uint8)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    lcp = np.full(n + 1, -1)
    lcp[same], depth = 0, 0
    while len(same):
        same = same[(letters[begin[same] + depth] == letters[begin[same - 1] + depth]) & (length[same] > depth) & (length[same - 1] > depth)]
        depth += 1
        lcp[same] = depth
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    home = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    last = np.r_[first[1:], n]
    for at in range(0, n, BLOCK):
        q = np.arange(at, min(at + BLOCK, n))
        lo, hi, depth = first[home[q]], last[home[q]], size // 2
        # cells of one letter less than the depth, as many, and one more
        a, b, c = np.ones(len(q), np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        while len(q):
            ends = length[lo] == depth
            off = length[q] - depth
            cost = np.where(off == 0, b, np.where(off == 1, c, np.where(off == -1, a, 2)))
            near = ends & (cost == 1) & (np.minimum(length[q], depth) == size)
            if near.any():
                yield q[near], lo[near]
            lo = lo + ends
            cuts = np.flatnonzero(lcp <= depth)
            i, j = np.searchsorted(cuts, lo), np.searchsorted(cuts, hi)
            count = np.where(lo < hi, j - i, 0)
            own = np.repeat(np.arange(len(q)), count)
            k = np.repeat(i - (np.cumsum(count) - count), count) + np.arange(len(own))
            q, lo, hi, a, b, c = q[own], cuts[k], cuts[k + 1], a[own], b[own], c[own]
            letter = letters[begin[lo] + depth]

            def other(back: int, q: np.ndarray = q, letter: np.ndarray = letter, depth: int = depth) -> np.ndarray:
                place = np.minimum(depth + back, length[q])
                return np.where(depth + back < length[q], letters[begin[q] + place] != letter, 2).astype(np.int8)

            a2 = np.minimum(a + other(-1), b + 1)
            b2 = np.minimum(np.minimum(b + other(0), c + 1), a2 + 1)
            c2 = np.minimum(c + other(1), b2 + 1)
            # cells beyond the word's end are none
            b2 = np.where(length[q] > depth, b2, 2)
            c2 = np.where(length[q] > depth + 1, c2, 2)
            a2 = np.where(length[q] >= depth, a2, 2)
            depth += 1
            live = np.minimum(np.minimum(a2, b2), c2) <= 1
            q, lo, hi, a, b, c = (x[live] for x in (q, lo, hi, a2, b2, c2))


def _apart(texts: list[str], x: int, y: int, half: int) -> bool:
    """Whether two reversed words, which share their ends, differ in their first halves, so that no other list has both."""
    return texts[x][-half:] != texts[y][-half:]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lists -> word, near (words one edit away), form, form_n (the most frequent of them, the first of equals) of each task's part."""
    held: list[tuple] = []  # (list, mixed, own, s, n) of lists of one direction and size

    def close(back: bool, size: int) -> pa.RecordBatch:
        keys, mixed, own, texts, counts = zip(*held, strict=True)
        group = np.cumsum([k != p for k, p in zip(keys, (None, *keys[:-1]), strict=True)])
        n_near: Counter[int] = Counter()
        best: dict[int, tuple[int, str]] = {}
        for qs, ws in neighbours(list(texts), group, size):
            for q, w in zip(qs.tolist(), ws.tolist(), strict=True):
                if (mixed[q] and own[q] == own[w]) or (back and not _apart(texts, q, w, size // 2)):
                    continue
                n_near[q] += 1
                found = (-counts[w], texts[w][::-1] if back else texts[w])
                if q not in best or found < best[q]:
                    best[q] = found
        held.clear()
        words = [texts[q][::-1] if back else texts[q] for q in n_near]
        cols = [pa.array(words, pa.string()), pa.array(list(n_near.values()), pa.int64())]
        cols += [pa.array([best[q][1] for q in n_near], pa.string()), pa.array([-best[q][0] for q in n_near], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["word", "near", "form", "form_n"])

    kind = key = None
    for batch in batches:
        for back, size, half, part, mixed, own, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (back, size, half, part) != key:
                # whole lists, until there are enough words of them
                if held and ((back, size) != kind or len(held) >= PART_WORDS):
                    yield close(*kind)
                kind, key = (back, size), (back, size, half, part)
            held.append((key, mixed, own, s, n))
    if held:
        yield close(*kind)


def near_words(words: DataFrame, length: int = LENGTH) -> DataFrame:
    """word, n_near, form, form_n of the words that have others one inserted, deleted or replaced code point away."""
    found = _lists(words, length).mapInArrow(_near, "word string, near long, form string, form_n long")
    least = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("f")).select("word", "n_near", "f.form", (-F.col("f.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form; forms: word, form, where forms lead on to no word twice.

    Each round lets a word's root be that of its root so far, so a chain of k
    steps takes log2(k) rounds; forms are TIMES as frequent as their variants, so
    chains are short.
    """
    rows = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = rows.select(F.col("word").alias("root"), F.col("root").alias("further"))
        rows = checkpoint(rows.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not rows.where("moved").head(1):
            return rows.select("word", "root")
        rows = rows.drop("moved")


def spelling_variants(words: DataFrame, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; words: word (distinct, of code points up to U+00FF), n.

    Words are near if they differ by exactly one inserted, deleted or replaced
    code point.  A word's form is its near word of largest n (of equals the
    first in code-point order), if that is at least `times` its own n, else null;
    root follows forms to the last one, and is the word itself if it has none.
    Words shorter than `length` are near none.  Null words are left out; an empty
    table gives none; other columns, of any name, are left out.
    """
    own = checkpoint(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")))
    has = F.col("form_n") >= times * F.col("n")
    met = own.join(near_words(own.where(F.char_length("word") >= length), length), "word", "left")
    placed = checkpoint(met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    ends = roots(placed.where("form is not null").select("word", "form"))
    return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(doc_id: int | None, word: str) -> str:
    """The word without one code point in some of the documents; documents without an id keep theirs."""
    h = 1 if doc_id is None else zlib.crc32(word.encode(), zlib.crc32(b"%d:" % doc_id))
    if h % 199:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), misspelt))


#: Near words share what is left without one code point, or one is what is left of the other.
OP11_SQL = rf"""
WITH RECURSIVE poly AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id,
  unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
h AS MATERIALIZED (SELECT run, c, doc_id,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)::BIGINT AS h FROM runs, poly WHERE length(run) >= 6),
w AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 AND doc_id IS NOT NULL THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1),
v AS MATERIALIZED (SELECT * FROM w WHERE length(word) >= 6 AND n >= 5),
cut AS MATERIALIZED (SELECT word, k, substring(word, 1, k) || substring(word, k + 2) AS rest FROM (SELECT word, unnest(range(length(word)))::INT AS k FROM v)),
pair AS MATERIALIZED (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.k = y.k AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT v.word, cut.word FROM v JOIN cut ON v.word = cut.rest UNION SELECT cut.word, v.word FROM v JOIN cut ON v.word = cut.rest),
near AS (SELECT a, count(*) AS n_near FROM pair GROUP BY a),
best AS (SELECT a, b, v.n AS form_n FROM pair JOIN v ON b = v.word QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1),
form AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * v.n THEN b END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN near ON v.word = near.a LEFT JOIN best ON v.word = best.a),
walk AS (SELECT word, word AS root, form FROM form UNION ALL SELECT walk.word, walk.form, f.form FROM walk JOIN form f ON walk.form = f.word)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM form f JOIN walk ON f.word = walk.word AND walk.form IS NULL
"""
