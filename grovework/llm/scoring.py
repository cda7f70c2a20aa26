"""Operator 9: language-model scores from a gated recurrent network trained in numpy."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, table
from .language import held_out_mod

#: Text of a chunk (whole documents; a larger one is a chunk of its own), and chunks at most: beyond, they grow, so that
#: a word that all of them hold has no more counts to add in one place.  Text behind a bucket of words.
CHUNK_BYTES, MOST_CHUNKS, BUCKET_BYTES = 12 << 20, 1_000_000, 16 << 20
#: The network's units.  Its output has as many classes as a class has words: the fourth root of the number of distinct
#: training words, between these bounds; the most frequent words are those it knows.
UNITS, LEAST_SIDE, MOST_SIDE = 32, 32, 256
END, UNKNOWN = 0, 1
#: Training: rounds of averaging, lanes of text side by side, tokens dealt over them at once, steps of truncated
#: backpropagation, rate.  Long documents are dealt in pieces, each of which first reads so many tokens before it.
TRAIN_ROUNDS, TRAIN_LANES, TRAIN_TOKENS, TRAIN_STEPS, RATE = 4, 256, 6_000_000, 16, 0.05
TRAIN_PIECE, TRAIN_LEAD = 2048, 64
SCORE_LANES, SCORE_STEPS = 512, 32
#: A network's weights travel in so many pieces when they are averaged; networks of so many tasks are summed first.
SLICES, FAN = 16, 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


_DRAW = np.random.default_rng(9)
_PLACE, _MIX = _DRAW.integers(0, 1 << 64, 4096, np.uint64) | np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def side_for(distinct: int) -> int:
    """Classes of the output, and words of a class, for so many distinct training words."""
    return min(MOST_SIDE, max(LEAST_SIDE, math.ceil(distinct**0.25)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of tall arrays (b: one or several of them), in blocks of rows that stay in the processor's cache."""
    n = len(a) // 256 * 256
    one, many = a[:n].reshape(-1, 256, a.shape[1]).transpose(0, 2, 1), b[..., :n, :].reshape(*b.shape[:-2], -1, 256, b.shape[-1])
    return np.matmul(one, many).sum(-3) + np.matmul(a[n:].T, b[..., n:, :])


#: Gates are logistic functions of 2x, so what goes to them is wanted times -2.
_HEARD = np.array([-2, -2, 1], np.float32)[:, None, None]


def _logistic(x: np.ndarray) -> None:
    """1 / (1 + exp x) in place: exponentials cost half of what hyperbolic tangents do; one too large makes it 0."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class GatedNetwork:
    """A gated recurrent unit over side * side words, with an output softmax factored into classes and words within them."""

    def __init__(self, side: int, flat: np.ndarray | None = None):
        """All weights lie in one array; w names its parts."""
        self.side = side
        self.shapes = {
            "words": (side * side, UNITS),
            "into": (3, UNITS, UNITS),
            "back": (3, UNITS, UNITS),
            "to_class": (UNITS, side),
            "class_bias": (side,),
            "to_word": (side, UNITS, side),
            "word_bias": (side, side),
        }
        size = sum(math.prod(s) for s in self.shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else np.array(flat, np.float32)
        self.w = self.parts(self.flat)

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def __reduce__(self):
        return GatedNetwork, (self.side, self.flat)

    @classmethod
    def start(cls, counts: np.ndarray, side: int = LEAST_SIDE, seed: int = 9) -> GatedNetwork:
        """Small random weights; output biases are the logarithms of the words' shares, so it starts as a unigram model."""
        draw = np.random.default_rng(seed)
        share = np.zeros(side * side)
        share[: len(counts)] = counts + 0.5
        share = (share + 1e-9).reshape(side, side)
        by_class = share.sum(1)
        net = cls(side)
        net.w["words"][:] = draw.normal(0, 0.2, net.w["words"].shape)
        net.w["into"][:] = draw.normal(0, 0.5 / math.sqrt(UNITS), net.w["into"].shape)
        net.w["back"][:] = draw.normal(0, 0.5 / math.sqrt(UNITS), net.w["back"].shape)
        net.w["to_class"][:] = draw.normal(0, 0.05, net.w["to_class"].shape)
        net.w["to_word"][:] = draw.normal(0, 0.05, net.w["to_word"].shape)
        net.w["class_bias"][:] = np.log(by_class / by_class.sum())
        net.w["word_bias"][:] = np.log(share / by_class[:, None])
        return net

    def run(self, a: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray, learn: bool = True) -> tuple[np.ndarray, ...]:
        """Advances lanes of text through one window, a step at a time, the first live[t] lanes at step t.

        a: what the words before say to z, r and the candidate (rows step after
        step), as `heard` gives it; fresh: steps x lanes that begin without a
        state; h: states before the window.  Returns states before and after
        each step, gates (z and r), candidates and their part from the state,
        and the states at the end; unless it is to learn, only the states after
        each step and those at the end are whole, the others one step's, which
        stay in the processor's cache.
        """
        total, width, any_fresh = a.shape[1], fresh.shape[1], fresh.any(1).tolist()
        new = np.empty((total, UNITS), np.float32)
        old, cand, b3 = (np.empty((total if learn else width, UNITS), np.float32) for _ in range(3))
        gate = np.empty((2, len(old), UNITS), np.float32)
        ends, back = np.cumsum(live).tolist(), self.w["back"] * _HEARD
        for t, (n, end) in enumerate(zip(live.tolist(), ends, strict=True)):
            own = slice(end - n, end)
            at = own if learn else slice(0, n)
            o, g, c, y = old[at], gate[:, at], cand[at], new[own]
            o[:] = h[:n]
            if any_fresh[t]:
                o[np.flatnonzero(fresh[t, :n])] = 0
            b = np.matmul(o, back)
            np.add(a[:2, own], b[:2], out=g)
            _logistic(g)
            if learn:
                b3[at] = b[2]
            np.multiply(g[1], b[2], out=c)
            c += a[2, own]
            c *= -2
            _logistic(c)  # tanh x is 2 / (1 + exp -2x) - 1
            c *= 2
            c -= 1
            np.subtract(o, c, out=y)
            y *= g[0]
            y += c
            h = y
        return old, new, gate, cand, b3, h

    def heard(self, words: np.ndarray) -> np.ndarray:
        """What words' vectors say to z, r (times -2, as exponents) and the candidate."""
        return np.matmul(words, self.w["into"] * _HEARD)

    def output(self, h: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None):
        """log P(target | h), and the gradient of its negative mean by h; that by the weights goes to `grads`, if given."""
        learn, w, m, side = grads is not None, self.w, len(h), self.side
        rows, ones = np.arange(m), np.ones(side, np.float32)
        kind, word = np.divmod(target.astype(np.uint16), np.uint16(side))
        p = h @ w["to_class"]
        p += w["class_bias"]
        np.minimum(p, 60, out=p)
        out = p[rows, kind]
        np.exp(p, out=p)
        total = p @ ones
        out -= np.log(total)
        if learn:
            p *= (1 / (total * m))[:, None]
            p[rows, kind] -= 1 / m
            dh = p @ w["to_class"].T
            grads["to_class"][:] = _product(h, p)
            np.matmul(np.ones(m, np.float32), p, out=grads["class_bias"])
        # each class's rows together
        order = np.argsort(kind, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(kind, minlength=side))].tolist()
        held = [(c, a, b) for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
        hs, word, q = h.take(order, 0), word[order], np.empty((m, side), np.float32)
        for c, a, b in held:
            np.matmul(hs[a:b], w["to_word"][c], out=q[a:b])
            q[a:b] += w["word_bias"][c]
        np.minimum(q, 60, out=q)
        inner = q[rows, word]
        np.exp(q, out=q)
        total = q @ ones
        inner -= np.log(total)
        out[order] += inner
        if not learn:
            return out, None
        q *= (1 / (total * m))[:, None]
        q[rows, word] -= 1 / m
        back, many = np.empty_like(hs), np.ones(m, np.float32)
        for c, a, b in held:
            np.matmul(q[a:b], w["to_word"][c].T, out=back[a:b])
            np.matmul(hs[a:b].T, q[a:b], out=grads["to_word"][c])
            np.matmul(many[a:b], q[a:b], out=grads["word_bias"][c])
        dh[order] += back
        return out, dh


class Lanes:
    """Stretches of text dealt over lanes, each lane a stream of them; longest lanes first.

    Lane after lane: place, where each token stood; tokens; before, the token
    before it (END before a document's first); fresh, whether a stretch begins
    there, with no state; counts, whether it is to be predicted.
    """

    def __init__(self, tokens: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: np.ndarray, lanes: int):
        """tokens: documents, each with END at its end; stretches [begin, end), of which the first `lead` aren't predicted."""
        size = end - begin
        lanes = max(1, min(lanes, len(size)))
        mine: list[list[int]] = [[] for _ in range(lanes)]
        heap = [(0, k) for k in range(lanes)]
        longest = np.argsort(-size, kind="stable")
        for d, n in zip(longest.tolist(), size[longest].tolist(), strict=True):
            had, k = heap[0]
            mine[k].append(d)
            heapq.heapreplace(heap, (had + n, k))
        heap.sort(key=lambda x: (-x[0], x[1]))
        self.load = np.array([had for had, _ in heap], np.int64)
        self.start = np.cumsum(self.load) - self.load
        dealt = np.array([d for _, k in heap for d in mine[k]], np.int64)
        n = size[dealt]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.place = np.repeat(begin[dealt], n) + inner
        self.tokens, self.before = tokens[self.place], tokens[self.place - 1]  # the last token is an END too
        self.fresh, self.counts = inner == 0, inner >= np.repeat(lead[dealt], n)

    @classmethod
    def whole(cls, tokens: np.ndarray, offsets: np.ndarray, lanes: int) -> Lanes:
        """Whole documents, each one stretch."""
        return cls(tokens, offsets[:-1], offsets[1:], np.zeros(len(offsets) - 1, np.int64), lanes)

    @classmethod
    def pieces(cls, tokens: np.ndarray, offsets: np.ndarray, lanes: int, most: int, lead: int) -> Lanes:
        """Documents in pieces of `most` tokens; each piece reads the `lead` tokens before it first, to have a state."""
        count = np.maximum(1, -(-np.diff(offsets) // most))
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(offsets[:-1], count) + number * most
        end = np.minimum(begin + most, np.repeat(offsets[1:], count))
        lead = np.where(number > 0, min(lead, most), 0)
        return cls(tokens, begin - lead, end, lead, lanes)

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """at (steps x lanes, index into tokens) and live (lanes at each step), window by window."""
        for t in range(0, int(self.load[0]) if len(self.load) else 0, steps):
            width = int(np.searchsorted(-self.load, -t, side="left"))
            step = t + np.arange(min(steps, int(self.load[0]) - t))
            live = np.searchsorted(-self.load[:width], -step, side="left")
            at = self.start[None, :width] + step[:, None]
            yield np.minimum(at, len(self.tokens) - 1), live


def train(net: GatedNetwork, lanes: Lanes, squares: np.ndarray, steps: int = TRAIN_STEPS, rate: float = RATE) -> None:
    """One pass over the lanes, in place: backpropagation within windows, the state carried from one to the next.

    Each weight's rate falls with the squares of its gradients so far (Adagrad).
    Gradients are sums over a window's tokens, over those of a full window: so
    all tokens count alike, and the last lanes' small windows change little.
    """
    u, h = UNITS, np.zeros((len(lanes.load), UNITS), np.float32)
    flat, change = np.zeros_like(net.flat), np.empty_like(net.flat)
    grads, w = net.parts(flat), net.w
    for at, live in lanes.windows(steps):
        fresh = lanes.fresh[at]
        own = np.concatenate([a[:n] for a, n in zip(at, live.tolist(), strict=True)])
        inputs = lanes.before[own]
        x = w["words"].take(inputs, 0)
        said = net.heard(w["words"]).take(inputs, 1) if len(w["words"]) < len(own) else net.heard(x)
        old, new, (z, r), cand, b3, h = net.run(said, fresh, live, h[: at.shape[1]])
        counts = np.flatnonzero(lanes.counts[own])
        if not len(counts):
            continue
        flat[:] = 0
        target, share = lanes.tokens[own], len(counts) / (len(lanes.load) * steps)
        if len(counts) == len(own):
            _, dh_all = net.output(new, target, grads)
        else:
            dh_all = np.zeros_like(new)
            _, dh_all[counts] = net.output(new[counts], target[counts], grads)
        # what the gradient of a state is multiplied with to give those of z's, r's and the candidate's sums
        keep = 1 - z
        to_cand = cand * cand
        np.subtract(1, to_cand, out=to_cand)
        to_cand *= keep
        to_b = np.empty((3, len(own), u), np.float32)
        np.subtract(old, cand, out=to_b[0])
        np.multiply(to_cand, r, out=to_b[2])
        np.multiply(to_b[2], b3, out=to_b[1])
        to_b[0] *= z
        to_b[0] *= keep
        np.subtract(1, r, out=keep)
        to_b[1] *= keep
        to_b[:2] *= 2
        ends = np.cumsum(live).tolist()
        ahead = np.zeros((at.shape[1], u), np.float32)
        db, back = np.empty((3, len(own), u), np.float32), np.ascontiguousarray(w["back"].transpose(0, 2, 1))
        for t in range(len(live) - 1, -1, -1):
            n = int(live[t])
            mine = slice(ends[t] - n, ends[t])
            dh = dh_all[mine]
            dh += ahead[:n]
            d = db[:, mine]
            np.multiply(dh, to_b[:, mine], out=d)
            before = np.multiply(dh, z[mine], out=ahead[:n])
            for k in range(3):
                before += d[k] @ back[k]
            if fresh[t, :n].any():
                before[fresh[t, :n]] = 0
        grads["back"][:] = _product(old, db)
        np.multiply(dh_all, to_cand, out=db[2])  # to the candidate from the word before
        grads["into"][:] = _product(x, db)
        dx = db[0] @ w["into"][0].T
        for k in (1, 2):
            dx += db[k] @ w["into"][k].T
        order = np.argsort(inputs, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(inputs[order]) != 0])
        grads["words"][inputs[order[start]]] = np.add.reduceat(dx.take(order, 0), start, axis=0)
        flat *= share * min(1.0, 1.0 / (float(np.sqrt(flat @ flat)) * share + 1e-12))
        np.multiply(flat, flat, out=change)
        squares += change
        np.sqrt(squares, out=change)
        np.divide(flat, change, out=change, where=change > 0)
        change *= rate
        net.flat -= change


def log_likelihood(net: GatedNetwork, lanes: Lanes, steps: int = SCORE_STEPS) -> np.ndarray:
    """Natural log-probability of every token dealt, by its place."""
    out = np.zeros(int(lanes.place.max(initial=-1)) + 1)
    h, table = np.zeros((len(lanes.load), UNITS), np.float32), net.heard(net.w["words"])
    for at, live in lanes.windows(steps):
        own = np.concatenate([a[:n] for a, n in zip(at, live.tolist(), strict=True)])
        _, new, *_, h = net.run(table.take(lanes.before[own], 1), lanes.fresh[at], live, h[: at.shape[1]], learn=False)
        mine = lanes.counts[own]
        out[lanes.place[own[mine]]] = net.output(new, lanes.tokens[own])[0][mine]
    return out


# chunks: documents as numbers of their own words


class Chunk:
    """Some documents: doc_id, held, words of each (sizes, and tokens as numbers), and the distinct words of all (an Arrow array)."""

    def __init__(self, ids: np.ndarray, valid: np.ndarray, held: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, words: pa.Array):
        self.ids, self.valid, self.held, self.sizes, self.tokens, self.words = ids, valid, held, sizes, tokens, words

    @classmethod
    def of(cls, ids: list[int | None], held: list[bool], texts: list[bytes]) -> Chunk:
        buf = _LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
        word = np.zeros(len(buf) + 2, bool)
        np.logical_not(_GAP[buf], out=word[1:-1])
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[::2], edge[1::2]
        offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[word[1:-1]])])
        coded = column.dictionary_encode()
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        sizes = np.diff(np.r_[np.searchsorted(starts, begin), len(starts)])
        valid = np.array([i is not None for i in ids])
        return cls(np.array([i or 0 for i in ids], np.int64), valid, np.array(held, bool), sizes.astype(np.int32), coded.indices.to_numpy().astype(np.int32), coded.dictionary)

    def pack(self) -> bytes:
        _, ends, letters = self.words.buffers()  # an array of its own, from its first byte
        ends = np.frombuffer(ends, np.int32, len(self.words) + 1)
        head = np.array([len(self.ids), len(self.tokens), len(ends)], np.int64)
        arrays = (head, self.ids, self.valid, self.held, self.sizes, self.tokens, ends)
        text = letters.to_pybytes()[: ends[-1]] if letters else b""
        return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays) + text)

    @classmethod
    def unpack(cls, blob: bytes) -> Chunk:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, m, k = np.frombuffer(raw, np.int64, 3).tolist()
        at, out = 24, []
        for kind, count in ((np.int64, n), (bool, n), (bool, n), (np.int32, n), (np.int32, m), (np.int32, k)):
            out.append(np.frombuffer(raw, kind, count, at))
            at += out[-1].nbytes
        ends = out.pop()
        return cls(*out, pa.Array.from_buffers(pa.binary(), k - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[at:])]))

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words' numbers in order of their buckets, and where each bucket's begin (n + 1 places)."""
        _, ends, letters = self.words.buffers()
        ends = np.frombuffer(ends, np.int32, len(self.words) + 1).astype(np.int64)
        letters = np.frombuffer(letters, np.uint8, ends[-1]) if letters else np.zeros(0, np.uint8)
        place = np.arange(len(letters)) - np.repeat(ends[:-1], np.diff(ends))
        sums = np.add.reduceat((letters + np.uint64(1)) * _PLACE[place & 4095], ends[:-1]) if len(letters) else np.zeros(0, np.uint64)
        where = ((sums ^ (sums >> np.uint64(29))) * _MIX >> np.uint64(32)) % np.uint64(n)
        order = np.argsort(where, kind="stable")
        return order, np.searchsorted(where[order], np.arange(n + 1, dtype=np.uint64))

    def train_counts(self) -> np.ndarray:
        use = np.repeat(~self.held, self.sizes)
        return np.bincount(self.tokens[use], minlength=len(self.words))

    def known(self, vocabulary: list[bytes]) -> np.ndarray:
        """The network's number of each distinct word."""
        found = pc.index_in(self.words, value_set=pa.array(vocabulary, pa.binary()))
        return (pc.fill_null(found, UNKNOWN - 2).to_numpy() + 2).astype(np.uint16)

    def with_ends(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Network tokens with END after each document, and the documents' offsets."""
        offsets = np.r_[0, np.cumsum(self.sizes.astype(np.int64) + 1)]
        tokens = np.full(offsets[-1], END, np.uint16)
        inner = np.ones(offsets[-1], bool)
        inner[offsets[1:] - 1] = False
        tokens[inner] = numbers[self.tokens] if len(self.tokens) else 0
        return tokens, offsets


def chunk_documents(docs: DataFrame, size: int) -> DataFrame:
    """chunk long, blob binary; docs: doc_id, held, text (binary); size: bytes of text in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, held, texts, got = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal number, ids, held, texts, got
            blob, name = Chunk.of(ids, held, texts).pack(), part << 32 | number
            number, ids, held, texts, got = number + 1, [], [], [], 0
            return pa.RecordBatch.from_pydict({"chunk": pa.array([name], pa.int64()), "blob": pa.array([blob], pa.binary())})

        for b in batches:
            for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t)
                got += len(t)
                if got >= size:
                    yield out()
        if ids:
            yield out()

    return docs.mapInArrow(run, "chunk long, blob binary")


def _packed_words(words: pa.Array, counts: np.ndarray) -> bytes:
    _, ends, letters = words.buffers()
    ends = np.frombuffer(ends, np.int32, len(words) + words.offset + 1)[words.offset :]
    text = letters.to_pybytes()[ends[0] : ends[-1]] if letters else b""
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.int32).tobytes() + np.diff(ends).astype(np.int32).tobytes() + text)


_ANSWER = "chunk long, bucket int, n long, v long, words array<binary>, counts array<long>, blob binary"


def count_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Training counts of all words, sent back to the chunks that hold them.

    A chunk sends each distinct word once to the word's bucket, with its count
    there, packed with the bucket's other words; the bucket adds up and answers
    every chunk in its order (blob).  A row with chunk -1 has the bucket's
    totals and its most frequent words: words are spread over the buckets by a
    hash, so the most frequent of all are among some more than their share of each.
    """
    most = 64 + math.ceil(8 * MOST_SIDE**2 / buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = Chunk.unpack(blob)
                if not len(c.words):
                    continue
                order, at = c.buckets(buckets)
                words, counts = c.words.take(pa.array(order)), c.train_counts()[order]
                rows = [(k, j - i, _packed_words(words[i:j], counts[i:j])) for k, (i, j) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)) if i < j]
                cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), *cols], names=["chunk", "bucket", "size", "blob"])

    def answer(held: list[tuple[int, int, bytes]], bucket: int) -> pa.RecordBatch:
        counts, sizes, letters = [], [], []
        for _, size, blob in held:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            counts.append(np.frombuffer(raw, np.int32, size))
            sizes.append(np.frombuffer(raw, np.int32, size, 4 * size))
            letters.append(raw[8 * size :])
        ends = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(letters))])
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        top = np.flatnonzero(total > 0)
        if len(top) > most:
            top = top[total[top] >= np.partition(total[top], len(top) - most)[len(top) - most]]
        names = coded.dictionary.take(pa.array(top)).to_pylist()
        first = sorted(range(len(top)), key=lambda k: (-total[top[k]], names[k]))[:most]
        pack, cuts = zstandard.ZstdCompressor(level=1).compress, np.r_[0, np.cumsum([h[1] for h in held])].tolist()
        blobs = [pack(total[at[i:j]].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
        n, none = len(held), [None] * len(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*(h[0] for h in held), -1], pa.int64()),
                pa.array([bucket] * (n + 1), pa.int32()),
                pa.array([*none, int(total.sum())], pa.int64()),
                pa.array([*none, int((total > 0).sum())], pa.int64()),
                pa.array([*none, [names[k] for k in first]], pa.list_(pa.binary())),
                pa.array([*none, [int(total[top[k]]) for k in first]], pa.list_(pa.int64())),
                pa.array([*blobs, None], pa.binary()),
            ],
            names=["chunk", "bucket", "n", "v", "words", "counts", "blob"],
        )

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for name, where, size, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if where != bucket and held:
                    yield answer(held, bucket)
                    held = []
                bucket = where
                held.append((name, size, blob))
        if held:
            yield answer(held, bucket)

    asked = chunks.mapInArrow(ask, "chunk long, bucket int, size int, blob binary")
    return asked.repartition(max(partitions(chunks), buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(reply, _ANSWER)


def _average(parts: DataFrame) -> np.ndarray | None:
    """Sum of weight vectors over the sum of their tokens; parts: slice, n, x (packed doubles, times n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(x, np.float64)
                had = held.get(k)
                held[k] = [n, x.copy()] if had is None else [had[0] + n, had[1] + x]
        if held:
            cols = [pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()]), pa.array([x.tobytes() for _, x in held.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["slice", "n", "x"])

    kind = "slice int, n long, x binary"
    # what FAN tasks give is summed first, so that the last tasks read a network for each FAN
    near = parts.withColumn("near", F.floor(F.spark_partition_id() / FAN)).repartition(max(SLICES, partitions(parts)), "slice", "near")
    sums = near.select("slice", "n", "x").mapInArrow(run, kind)
    # one network comes back, in pieces, whatever the number of tasks
    rows = sorted(sums.repartition(SLICES, "slice").mapInArrow(run, kind).collect())
    return np.concatenate([np.frombuffer(r["x"]) / r["n"] for r in rows]) if rows else None


def train_network(chunks: DataFrame, vocabulary: list[bytes], net: GatedNetwork, rounds: int = TRAIN_ROUNDS) -> GatedNetwork:
    """Trains on the chunks' training documents: each round's tasks start from the last average and are averaged.

    Every training document is read once, in one of the rounds.  Averages are
    weighted by tokens.
    """
    spark = chunks.sparkSession
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, net))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, own = shared.value
            own = GatedNetwork(own.side, own.flat)
            seen, squares, held = 0, np.full(own.flat.size, 1e-8, np.float32), []

            def learn() -> None:
                tokens, sizes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                held.clear()
                train(own, Lanes.pieces(tokens, np.r_[0, np.cumsum(sizes)], TRAIN_LANES, TRAIN_PIECE, TRAIN_LEAD), squares)

            for b in batches:
                for blob in b.column(0).to_pylist():
                    c = Chunk.unpack(blob)
                    if c.held.all():
                        continue
                    tokens, offsets = c.with_ends(c.known(words))
                    sizes = np.diff(offsets)
                    tokens = tokens[np.repeat(~c.held, sizes)]
                    held.append((tokens, sizes[~c.held]))
                    seen += len(tokens)
                    if sum(len(h[0]) for h in held) >= TRAIN_TOKENS:
                        learn()
            if held:
                learn()
            if seen:
                pieces = np.array_split(own.flat.astype(np.float64) * seen, SLICES)
                cols = [pa.array(range(SLICES), pa.int32()), pa.array([seen] * SLICES), pa.array([x.tobytes() for x in pieces], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["slice", "n", "x"])

        part = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == k).select("blob")
        mean = _average(part.mapInArrow(run, "slice int, n long, x binary"))
        shared.unpersist()
        if mean is not None:
            net = GatedNetwork(net.side, mean)
    return net


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, is_held: Column, rounds: int = TRAIN_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Tokens are the lower-cased (A-Z) words and one end; a null text has the end
    only.  Counts are those of all documents not held out.  score is the base-ten
    log-probability of the whole document under the network; a word it doesn't
    know has the probability of an unknown word there, times its smoothed share
    of all such words.  How many words it knows follows from how many there are
    (side_for).  With nothing to learn from, every word is unknown.  Very long
    texts are scored whole, the state carried from window to window (training
    takes them in pieces).  Rows that repeat are each scored; null doc_ids stay
    null; an empty table gives none; other columns, of any name, are left out.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), is_held.alias("held"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    )
    totals = source.agg(F.sum(F.length("text")).alias("bytes"), F.sum((~F.col("held")).cast("long")).alias("docs")).first()
    train_docs, size = totals["docs"] or 0, totals["bytes"] or 0
    chunk_size, buckets = max(CHUNK_BYTES, math.ceil(size / MOST_CHUNKS)), max(1, math.ceil(size / BUCKET_BYTES))
    chunks = materialize(chunk_documents(source, chunk_size))
    answers = materialize(count_words(chunks, buckets))
    sums = answers.where("chunk = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = (sums["n"] or 0) + train_docs, (sums["v"] or 0) + (train_docs > 0)
    side = side_for(v)
    top = (
        answers.where("chunk = -1")
        .select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
        .select("w.words", "w.counts")
        .orderBy(F.desc("counts"), "words")
        .limit(side * side - 2)
        .collect()
    )
    vocabulary, counts = [bytes(r["words"]) for r in top], [r["counts"] for r in top]
    rest_n, rest_v = (sums["n"] or 0) - sum(counts), (sums["v"] or 0) - len(counts)
    net = train_network(chunks, vocabulary, GatedNetwork.start(np.array([train_docs, rest_n, *counts], float), side), rounds)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, net))
    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    def finish(chunk: Chunk, replies: list[tuple[int, bytes]]) -> pa.RecordBatch:
        words, own = shared.value
        count = np.zeros(len(chunk.words), np.int64)
        if len(count):
            got = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.int64) for _, b in sorted(replies)]
            count[chunk.buckets(buckets)[0]] = np.concatenate(got)
        number = chunk.known(words)
        tokens, offsets = chunk.with_ends(number)
        inner = np.ones(len(tokens), bool)
        inner[offsets[1:] - 1] = False
        base = np.full(len(tokens), base_of(train_docs))
        known = np.full(len(tokens), train_docs > 0)
        model = log_likelihood(own, Lanes.whole(tokens, offsets, SCORE_LANES)) / math.log(10)
        if len(chunk.tokens):
            base[inner] = base_of(count)[chunk.tokens]
            known[inner] = (count > 0)[chunk.tokens]
            rare = np.where(number == UNKNOWN, np.log10((count + 0.5) / (rest_n + 0.5 * (rest_v + 1))), 0.0)
            model[inner] += rare[chunk.tokens]
        at = offsets[:-1]
        m = len(chunk.ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(chunk.ids, mask=~chunk.valid),
                pa.array(chunk.held),
                pa.array(np.diff(offsets)),
                pa.array(np.add.reduceat(known.astype(np.int64), at)),
                pa.array(np.full(m, n, np.int64)),
                pa.array(np.add.reduceat(base, at)),
                pa.array(np.add.reduceat(model, at)),
            ],
            names=[c.split()[0] for c in _SCORES.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, chunk, replies = None, None, []
        for b in batches:
            for c, bucket, blob in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != name:
                    if chunk is not None:
                        yield finish(chunk, replies)
                    name, chunk, replies = c, Chunk.unpack(blob), []
                else:
                    replies.append((bucket, blob))
        if chunk is not None:
            yield finish(chunk, replies)

    rows = chunks.select("chunk", F.lit(-1).alias("bucket"), "blob").unionByName(answers.where("chunk >= 0").select("chunk", "bucket", "blob"))
    dealt = rows.repartition(max(partitions(docs), math.ceil(2 * size / chunk_size)), "chunk").sortWithinPartitions("chunk", "bucket")
    return dealt.mapInArrow(run, _SCORES)


def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), held_out_mod("doc_id", 5))
