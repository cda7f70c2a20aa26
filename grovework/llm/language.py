"""Operator 7: language identification by cross-parsing entropy."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unused

#: A text is parsed in blocks of so many symbols at a time; a block's parse begins so many symbols before it, since
#: parses that begin apart soon go on from the same symbol.
BLOCK, LEAD = 1024, 64
#: Characters parsed in one call, and lanes advanced together; they bound the arrays of a task.
CALL_CHARS, LANES = 2_000_000, 8192
#: The model is fitted on at most so many documents a language, so many symbols of them, and so many characters of each.
SAMPLE_DOCS, SAMPLE_SYMBOLS, SAMPLE_DOC_CHARS = 200, 40_000, 20_000


def symbols(text: str) -> str:
    """Lower-cased letters; every run of anything else is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbol_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the symbols of all texts, one text after the other, and how many each has."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    letter = _letters()[points]
    so_far = np.cumsum(letter)
    # the first of a run of other characters is the space, if a letter of its text follows
    space = np.r_[False, letter[:-1]] & ~letter & (so_far < np.repeat(so_far[ends - 1], np.diff(ends, prepend=0)))
    kept = np.flatnonzero(letter | space)
    return np.where(letter[kept], points[kept], 32), np.diff(np.searchsorted(kept, ends), prepend=0)


class SuffixAutomaton:
    """All substrings of one text: each state's moves (symbol -> state); 0 is the root."""

    def __init__(self, codes: list[int]):
        link, length, nxt = [-1], [0], [{}]
        last = 0
        for c in codes:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
            last = cur
        self.moves = nxt

    def parser(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base, cells, first: moves laid over each other in one array, as many cells as moves, more or less.

        The move of state s by symbol c stands at base[s] + c, as s << 32 | next,
        if there is one.  Where there is none a phrase ends, and c begins the
        next one in state first[c]: the root's moves, and for symbols that the
        text doesn't have one more state, that nothing continues.
        """
        states = len(self.moves) + 1
        base, taken, cells = np.zeros(states, np.int64), set(), {}
        free = mark = 0
        for s in sorted(range(1, len(self.moves)), key=lambda s: -len(self.moves[s])):
            own = sorted(self.moves[s])
            if not own:
                break
            # states of several moves pass over what is nearly full, and those of one fill it in the end
            at = begun = free if len(own) == 1 else max(free, mark)
            while any(at - own[0] + c in taken for c in own):
                at += 1
            if at > begun + 32:
                mark = at
            shift = at - own[0] + width  # never negative
            base[s] = shift
            for c in own:
                taken.add(shift - width + c)
                cells[shift + c] = s << 32 | self.moves[s][c]
            while free in taken:
                free += 1
        packed = np.full(int(base.max()) + width + 1, -1, np.int64)
        packed[list(cells)] = list(cells.values())
        first = np.full(width, states - 1, np.int64)
        for c, t in self.moves[0].items():
            first[c] = t
        return base, packed, first


class CrossParser:
    """Counts, for a text and each language, the phrases of its greedy parse into longest matches."""

    def __init__(self, sample: dict[str, str]):
        self.names = sorted(sample)
        letters = sorted(set("".join(sample.values())))
        self.width = len(letters) + 1  # 0: a letter that no language has
        self.code = np.zeros(0x110000, np.uint16)
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.tables = []
        for name in self.names:
            codes = self.code[[ord(c) for c in sample[name]]].tolist()
            self.tables.append(SuffixAutomaton(codes).parser(self.width))
        self.bits = np.array([math.log2(len(sample[n]) + 2) for n in self.names])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases, texts x languages, and the symbols of each text."""
        points, lengths = symbol_points(texts)
        codes = self.code[points]
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lead = np.where(inner > 0, LEAD, 0)
        start = np.repeat(np.cumsum(lengths) - lengths, blocks) + inner * BLOCK - lead
        size = np.minimum(BLOCK, np.repeat(lengths, blocks) - inner * BLOCK) + lead
        out = np.zeros((len(texts), len(self.names)), np.int64)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            n = size[lanes]
            grid = np.zeros((n[0], len(lanes)), np.int64)  # step x lane, longest lanes first
            for c in range(0, len(lanes), 1024):
                m = n[c]
                index = start[lanes[c : c + 1024], None] + np.arange(m)
                grid[:m, c : c + 1024] = codes[np.minimum(index, len(codes) - 1)].T
            live = np.searchsorted(-n, -np.arange(n[0]), side="left")  # lanes longer than the step
            early = np.flatnonzero(lead[lanes])
            for k, (base, cells, first) in enumerate(self.tables):
                state, begun = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
                for step in range(n[0]):
                    if step == LEAD:
                        begun[early] = 0
                    a = live[step]
                    c, s = grid[step, :a], state[:a]
                    got = cells.take(base.take(s) + c)
                    stuck = got >> 32 != s
                    begun[:a] += stuck
                    np.copyto(s, np.where(stuck, first.take(c), got & 0xFFFFFFFF))
                out[:, k] += np.bincount(owner[lanes], weights=begun, minlength=len(texts)).astype(np.int64)
        return out, lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and rate (phrase bits a symbol) of each text; 'und', 0, 0 where there is no letter."""
        names, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not texts or not self.names:
            return names, scores, rates
        counts, n = self.phrases([t or "" for t in texts])
        has = np.flatnonzero(n)
        rate = counts[has] * self.bits / n[has, None]
        best = rate.argmin(1)
        least = rate[np.arange(len(has)), best]
        rest = rate.copy()
        rest[np.arange(len(has)), best] = np.inf
        second = rest.min(1) if len(self.names) > 1 else 2 * least
        for i, b, s, r in zip(has.tolist(), best, 1 - least / second, least, strict=True):
            names[i], scores[i], rates[i] = self.names[b], float(min(1.0, max(0.0, s))), float(r)
        return names, scores, rates


def fit(labelled: DataFrame, key: str = "doc_id") -> CrossParser:
    """A parser from rows (key, text, lang): per language the rows whose key hashes lowest.

    Rows without letters, language or text are passed over.  Of each row chosen, of whatever length, the
    first SAMPLE_DOC_CHARS characters from its first letter on are taken; at most SAMPLE_DOCS such
    excerpts of each language come to the driver, and SAMPLE_SYMBOLS symbols of them are learnt.
    """
    excerpt = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{SAMPLE_DOC_CHARS - 1}}}", 0)
    ranked = (
        labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.xxhash64(F.col(key).cast("string"), F.col("text")).alias("h"), excerpt.alias("text"))
        .withColumn("n", F.length("text"))
    )
    slim = ranked.select("lang", "h", "n").distinct()
    w = Window.partitionBy("lang").orderBy("h")
    chosen = slim.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE_DOCS)
    chosen = chosen.withColumn("before", F.sum("n").over(w) - F.col("n")).where(F.col("before") < SAMPLE_SYMBOLS)
    picked = F.broadcast(chosen.select("lang", "h"))  # SAMPLE_DOCS rows a language
    rows = ranked.join(picked, ["lang", "h"], "left_semi").select("lang", "h", "text").distinct().collect()
    sample: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        sample[r["lang"]] = (sample.get(r["lang"], "") + " " + symbols(r["text"]))[:SAMPLE_SYMBOLS]
    return CrossParser(sample)


def identify(docs: DataFrame, parser: CrossParser, added: tuple[str, str, str] = ("lang_pred", "score", "rate")) -> DataFrame:
    """`docs` with language, score and rate under the names `added`; columns of those names are replaced.

    Only the text is looked at.  Null texts and those without a letter are
    'und' with score 0, as all are if the parser knows no language.  score is
    1 - fewest / second fewest phrase bits; with one language it is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # some 2 MB a language: as many cells as a sample of SAMPLE_SYMBOLS has moves

    @F.pandas_udf("lang string, score double, rate double")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows, held, size = [], [], 0
        for k, t in enumerate(texts):
            held.append(t)
            size += len(t or "")
            if size >= CALL_CHARS or k == len(texts) - 1:
                rows += zip(*shared.value.predict(held), strict=True)
                held, size = [], 0
        return pd.DataFrame(rows, columns=["lang", "score", "rate"])

    # the text alone goes to Python, and three values come back
    rows = docs.drop(*added)
    (got,) = unused(rows, "found")
    rows = rows.withColumn(got, found(F.col("text").cast("string")))
    for name, part in zip(added, ("lang", "score", "rate"), strict=True):
        rows = rows.withColumn(name, F.col(f"{got}.{part}"))
    return rows.drop(got)


def held_out_mod(key: str, mod: int):
    """Whether crc32 of the key's text leaves remainder 1; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == 1, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = fit(docs.where(~held_out_mod("doc_id", 3)))
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parser)
    return found.select("doc_id", held_out_mod("doc_id", 3).alias("held_out"), "lang_pred", "score", "rate")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents in which a language was found; without a letter (or a text) they go.

    The parser is fitted on the documents' own labelled rows; where none tells a language, all texts with a letter stay.
    """
    parser = fit(docs.where(~held_out_mod("doc_id", 3)))
    if not parser.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    added = unused(docs, "lang", "score", "rate")
    return identify(docs, parser, tuple(added)).where(F.col(added[0]) != "und").select(*docs.columns)
