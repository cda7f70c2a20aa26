"""Operator 4: secret scans by a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

KINDS = ("assign", "access", "hex", "random")
_KEYWORD = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as all runs of which the short ones are dropped
#: What might be an encoded key: a long run of the characters that encodings use.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Encodings by size; the first that holds all characters of a run is inferred.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", string.ascii_uppercase + "234567"),
    ("base36", string.digits + string.ascii_lowercase),
    ("base62", string.digits + string.ascii_uppercase + string.ascii_lowercase),
    ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
)
#: Pieces between '=', and those that the separators foreign to base64, to base64url and to both leave.
_BETWEEN = re.compile(r"[^=]+(?:=+$)?")
_CUTS = [re.compile(rf"[^{re.escape(c)}]+") for c in ("-_", "+/", "+/-_")]
_ORDER = [(name, {c: i for i, c in enumerate(alphabet)}) for name, alphabet in ENCODINGS]
#: Shares of the letters in English text, in percent (fixed values).
LETTER_PERCENT = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074,
}
#: Chance that ordinary text goes from one of capitals, small letters and digits to another between two characters; from a capital to
#: a small letter, as in names and compounds, doesn't count.
SWITCH = 0.12
#: Rates of false discoveries, among runs found unlike random characters and among those found unlike text.
RANDOM_RATE, DISCOVERY_RATE = 0.001, 0.01
#: Base-ten logarithms of p-values are counted in bins of a tenth; strata are powers of two of the length.
BINS_PER_DECADE, MOST_DECADES, STRATA = 10, 40, 12


def _fits(body: str) -> bool:
    return any(all(c in index for c in body) for _, index in _ORDER)


def _in_text(alphabet: str) -> tuple[float, float, float]:
    """Share of ordinary letters that are of an alphabet, share of digits, and how often two of its ordinary letters are equal."""
    own = [LETTER_PERCENT[c] / 100 for c in sorted(set(alphabet.lower()) & LETTER_PERCENT.keys())]
    return sum(own), sum(c.isdigit() for c in alphabet) / 10, sum(f * f for f in own) / sum(own) ** 2


_TEXT = {name: _in_text(alphabet) for name, alphabet in ENCODINGS}


def _fisher(*ps: float) -> float:
    """One p-value of independent ones."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return min(1.0, math.exp(-half) * sum(half**k / math.factorial(k) for k in range(len(ps))))


def _switches(body: str) -> float:
    """The chance that ordinary text changes between capitals, small letters and digits as often as this."""
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 for c in body if c.isalnum()]
    n, k = len(kinds) - 1, sum(a != b and (a, b) != (2, 1) for a, b in zip(kinds, kinds[1:], strict=False))
    if n > 400:
        return _normal_tail((k - 0.5 - n * SWITCH) / math.sqrt(n * SWITCH * (1 - SWITCH)))
    return sum(math.comb(n, i) * SWITCH**i * (1 - SWITCH) ** (n - i) for i in range(k, n + 1))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str) -> tuple[str, float, float] | None:
    """Encoding, p-value if the run were random, p-value if it were ordinary text; None if no encoding fits.

    The encoding is the smallest that holds all characters, which is the one
    most likely to give them by uniform draws.  The first p-value joins three
    tests (Fisher's method): chi-squared against a uniform alphabet (Wilson and
    Hilferty's normal form), runs above and below the alphabet's middle, and
    lag-one serial correlation, both two-sided.  The second joins what ordinary
    text would have to do to look like that: use no letters and digits but the
    encoding's, whose chi-squared would then be as small as the run's though
    text doesn't use them alike, and change between capitals, small letters and
    digits as often.  So small alphabets, which text seldom keeps to, and large
    ones, which it uses unevenly, are told from it alike: the longer, the surer.
    """
    body = run.rstrip("=")
    if len(body) < 20 or body.isdigit() or body.isalpha() and (body.islower() or body.isupper()):
        return None  # numbers and words
    name, index = next(((n, o) for n, o in _ORDER if all(c in o for c in body)), (None, None))
    if name is None:
        return None
    x, k, n = [index[c] for c in body], len(index), len(body)
    counts = [0] * k
    for i in x:
        counts[i] += 1
    chi, df = sum(c * c for c in counts) * k / n - n, k - 1
    spread = 2 / (9 * df)
    uniform = _normal_tail(((max(chi, 0.0) / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    high = [2 * i >= k for i in x]
    up = sum(high)
    mean = 2 * up * (n - up) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    runs_p = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    mid = sum(x) / n
    power = sum((i - mid) ** 2 for i in x)
    serial = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:], strict=False)) / power if power else 1.0
    serial_p = 2 * _normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    random_p = _fisher(uniform, runs_p, serial_p)
    letters, digits, match = _TEXT[name]
    within = letters ** sum(c.isalpha() for c in body) * digits ** sum(c.isdigit() for c in body)
    excess = max(0.0, n * (k * match - 1))
    uneven = _normal_tail((df + excess - chi) / math.sqrt(2 * (df + 2 * excess)))
    text_p = _fisher(within * uneven, _switches(body))
    return name, max(random_p, 10.0**-MOST_DECADES), max(text_p, 10.0**-MOST_DECADES)


def pieces(run: str) -> list[tuple[int, int]]:
    """Start and end of what the battery can test of a run: all of it where an encoding holds it, else its pieces.

    Such a run is cut at each '=' (trailing ones stay with the last piece).  A
    piece that still fits none mixes the separators of base64 and base64url: it
    is cut at those foreign to either, and at all of them, and every piece of 20
    characters or more is tested.
    """
    if _fits(run.rstrip("=")):
        return [(0, len(run))]
    out: list[tuple[int, int]] = []
    for m in _BETWEEN.finditer(run):
        if _fits(m.group().rstrip("=")):
            out.append(m.span())
            continue
        out += sorted({(m.start() + p.start(), m.start() + p.end()) for cut in _CUTS for p in cut.finditer(m.group())})
    return [(a, b) for a, b in out if len(run[a:b].rstrip("=")) >= 20]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float, float]]]:
    """Base spans (kind, start, end) by start, then kind; and tested runs (start, end, random p, text p) apart from them."""
    base = []
    low = text.lower()
    if any(k in low for k in _KEYWORD):
        base += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        base += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], s[0]))
    tested = []
    for m in _RUN.finditer(text):
        for start, end in pieces(m.group()):
            start, end = start + m.start(), end + m.start()
            if (t := battery(text[start:end])) and not any(a < end and start < b for _, a, b in base):
                tested.append((start, end, t[1], t[2]))
    return base, tested


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_RUNS = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("random_p", pa.float64()), ("text_p", pa.float64())])


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans), base_sha256, tested (runs with their p-values) of every document; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, digests, runs = [], [], []
            for t in b.column(1).to_pylist():
                base, tested = scan(t or "")
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
                runs.append([dict(zip(("start", "end", "random_p", "text_p"), r, strict=True)) for r in tested])
            cols = [b.column(0), pa.array(bases, pa.list_(_SPAN)), pa.array(digests, pa.string()), pa.array(runs, pa.list_(_RUNS))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "base", "base_sha256", "tested"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(
        run,
        "doc_id long, base array<struct<kind:int,start:int,end:int>>, base_sha256 string, "
        "tested array<struct<start:int,end:int,random_p:double,text_p:double>>",
    )


def _stratum(n: Column) -> Column:
    return F.least(F.lit(STRATA), F.floor(F.log2(n.cast("double")))).cast("int")


def discoveries(scanned: DataFrame, p: str, rate: float = DISCOVERY_RATE) -> dict[int, float]:
    """The largest p-value (field `p` of tested) rejected, by stratum of length: Benjamini and Hochberg's step, on binned p-values.

    Every tested run of every document counts as a test of its stratum.  At most
    STRATA times the number of bins rows are summed, and STRATA come back.
    """
    runs = scanned.select(F.explode("tested").alias("r")).select(
        _stratum(F.col("r.end") - F.col("r.start")).alias("stratum"),
        F.floor(-F.log10(f"r.{p}") * BINS_PER_DECADE).cast("int").alias("bin"),
    )
    counts = runs.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = counts.withColumn("rank", F.sum("n").over(smaller)).withColumn("m", F.sum("n").over(Window.partitionBy("stratum")))
    bound = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    kept = ranked.where(bound <= rate * F.col("rank") / F.col("m")).groupBy("stratum").agg(F.max(bound).alias("p"))
    return {r["stratum"]: r["p"] for r in kept.collect()}


def find_secrets(docs: DataFrame, random_rate: float = RANDOM_RATE, rate: float = DISCOVERY_RATE) -> DataFrame:
    """doc_id, base spans, base_sha256 and added `random` spans of every document.

    Base spans are those of fixed patterns.  A tested run is added if the joined
    battery doesn't find it unlike random characters, and ordinary text of its
    length would hardly imitate it; false discoveries are held to `random_rate`
    of the former and `rate` of the latter, among the runs of like length.  Positions are code points.  Null
    texts are empty, rows that repeat are each scanned, an empty table gives none.
    """
    scanned = checkpoint(scan_documents(docs))

    bounds = {
        p: F.create_map(*[F.lit(x) for pair in ({-1: -1.0} | discoveries(scanned, p, most)).items() for x in pair])
        for p, most in (("random_p", random_rate), ("text_p", rate))
    }

    def found(p: str, r: Column) -> Column:
        return r[p] <= F.coalesce(F.try_element_at(bounds[p], _stratum(r["end"] - r["start"])), F.lit(-1.0))

    added = F.filter("tested", lambda r: ~found("random_p", r) & found("text_p", r))
    # of pieces that stand, one inside another is no secret of its own
    whole = F.filter(
        added,
        lambda r: ~F.exists(added, lambda q: (q["start"] <= r["start"]) & (q["end"] >= r["end"]) & (q["end"] - q["start"] > r["end"] - r["start"])),
    )
    spans = F.transform(whole, lambda r: F.struct(F.lit(3).alias("kind"), r["start"].alias("start"), r["end"].alias("end")))
    return scanned.select("doc_id", "base", "base_sha256", spans.alias("added"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("k"), s["end"].alias("e"))))
    text = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["a"], s["e"])), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", number(0), number(1), number(2), "base_sha256", text.alias("spans"))
