"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import canonical

from grovework.llm import entry, jaccard, periodic, spelling
from grovework.llm.simhash import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, repeated and null doc_ids, clashing names."""
    rows = [(1, None, None), (2, "", "a"), (3, LONG, None), (4, "a b", "b"), (4, "a b", "b"), (5, "x", "b"), (None, "no id here", "a"), (None, None, None), (6, "  \t\n ", "c"), (7, "é ü ß", "a"), (8, LONG, "a"), (5, "y z", "b")]
    names = ["word", "n", "form", "root", "region", "node", "key", "keys", "text_hash", "id", "hash", "runs", "h"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame([(*r, *names) for r in rows], schema)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_periodic", "op13_jaccard"])
def test_sql(spark, duck, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


# -- 11 --------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(words: dict[str, int]) -> list[tuple]:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def random_words(seed: int) -> dict[str, int]:
    draw = random.Random(seed)
    words: dict[str, int] = {}
    for _ in range(60):
        w = "".join(draw.choice("abcé") for _ in range(draw.choice([6, 6, 7, 9, 14])))
        for _ in range(6):
            words[w] = draw.choice([5, 5, 30, 200, 1000])
            k, c = draw.randrange(len(w)), draw.choice("abcéÿ")
            w = draw.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]])
            if len(w) < 6:
                break
    return words


@pytest.mark.parametrize("part", [1 << 16, 7])
def test_variants_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART_WORDS", part)  # 7: lists are cut into parts
    words = random_words(1)
    got = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == variants(words)


def test_walks_down_lists_in_blocks(monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 5)
    for seed in range(20):
        draw = random.Random(seed)
        size = draw.choice([2, 3, 6, 7])
        half = size // 2
        words = {draw.choice(["ab" * half, "ba" * half])[:half] + "".join(draw.choice("abé") for _ in range(draw.choice([size, size + 1]) - half)) for _ in range(50)}
        texts = sorted(words)
        group = np.cumsum([i == 0 or texts[i][:half] != texts[i - 1][:half] for i in range(len(texts))])
        got = sorted((int(a), int(b)) for q, w in spelling.neighbours(texts, group, size) for a, b in zip(q, w, strict=True))
        n = range(len(texts))
        assert got == [(i, j) for i in n for j in n if group[i] == group[j] and one_edit(texts[i], texts[j]) and min(len(texts[i]), len(texts[j])) == size]


def test_forms_tie_by_word_and_chain(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdeh": 25, "abcdehk": 125, "zzzzzz": 9, "short": 100, "shor": 900}
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame([*words.items(), (None, 3)], "word string, n long")).collect()}
    assert got["abcdef"]["form"] == "abcdeg" and got["abcdef"]["n_near"] == 2
    assert got["abcdeh"]["form"] == "abcdehk" and got["abcdeg"]["form"] is None and got["abcdeg"]["root"] == "abcdeg"
    assert got["zzzzzz"]["n_near"] == 0 and got["short"]["form"] is None and len(got) == 7
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_long_chains_of_forms(spark):
    words = {"a" * (6 + k): 5**k for k in range(1, 14)}
    got = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r["root"] for r in got} == {"a" * 19}


def test_words_are_counted_in_whole_texts(spark, odd):
    docs = frame(spark, [(k, f"Élan VITAL-vitals naïveté×÷ {LONG[:50]}") for k in range(400)] + [(None, "Abcdefg ABCDEFG abcdefg abcdefg abcdefg")])
    got = dict(spelling.word_counts(docs).collect())
    # × and ÷ are within the letters' range; capital É stays
    assert got == {"vitals": 400, "naïveté×÷": 400, "abcdefg": 5}
    want = Counter()
    for k in range(400):
        for w in ("vitals", "naïveté×÷", "Élan", "vital"):
            h = zlib.crc32(f"{k}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    got = dict(spelling.word_counts(docs, spelling.misspelt).collect())
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5} | {"abcdefg": 5}
    assert spelling.word_counts(odd).count() == 0 and spelling.word_counts(odd.limit(0)).count() == 0


# -- 12 --------------------------------------------------------------------------------------------


def all_runs(w: list) -> list[tuple[int, int, int]]:
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                own = w[i : i + size]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(draw: random.Random) -> list[int]:
    n, letters = draw.randrange(0, 120), draw.choice([1, 2, 2, 3])
    w = [draw.randrange(letters) for _ in range(n)]
    for _ in range(draw.randrange(3) if n else 0):
        a, p = draw.randrange(n), draw.randrange(1, max(2, n // 4))
        for i in range(a, min(n, a + draw.randrange(2, 9) * p)):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_equal_brute_force():
    draw = random.Random(5)
    for _ in range(600):
        w = periodic_words(draw)
        assert periodic.find_runs(np.array(w, np.int64), len(w)) == all_runs(w)


def test_runs_of_documents_side_by_side(spark):
    draw = random.Random(6)
    texts = [" ".join(f"é{x}" for x in periodic_words(draw)) for _ in range(150)]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(frame(spark, list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        w = text.split()
        runs = all_runs(w)
        gone = {i for start, size, q in runs for i in range(start + q, start + size)}
        assert [tuple(r) for r in got[k]["runs"]] == runs and got[k]["n_words"] == len(w)
        assert got[k]["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_texts_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 7)
    for text in (b"", b" ", b"aaaaaaaaaaaaaaa", b" a b  cccccccccccccccc\td ", b"one two three four five six", LONG.encode()[:500]):
        assert [w for p in periodic.pieces(text) for w in p] == text.split()
        assert periodic._collapsed(text, np.zeros(len(text.split()), bool)) == b" ".join(text.split())


def test_odd_tables_have_runs(spark, odd):
    got = sorted(periodic.periodic_runs(odd).collect(), key=repr)
    assert len(got) == 12 and periodic.periodic_runs(odd.limit(0)).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [tuple(r) for r in by[3]["runs"]] == [(0, 30_000, 997)] and by[3]["collapsed"] == " ".join(LONG.split()[:997])
    assert by[1]["n_words"] == by[2]["n_words"] == by[6]["n_words"] == 0 and by[1]["collapsed"] == "" and by[1]["runs"] == []


def test_one_long_run_takes_few_extensions():
    assert periodic.find_runs(np.zeros(300_000, np.int64), 300_000) == [(0, 300_000, 1)]
    assert periodic.find_runs(np.tile(np.arange(50_000), 5), 250_000) == [(0, 250_000, 50_000)]


def test_digests_of_runs(spark, tmp_path):
    rows = [(1, "a b c d e f"), (3, "x " * 7 + "y"), (7, None), (9, ""), (None, "z " * 6)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in periodic.op12_periodic(spark, str(tmp_path)).collect()}
    assert all(zlib.crc32(str(d).encode()) % 10 for d, _ in rows)  # none of them is planted
    assert tuple(got[3])[1:6] == (1, 0, 7, 1, 7000) and got[3]["runs_sha256"] == hashlib.sha256(b"0,7,1\n").hexdigest()
    assert got[3]["collapsed_sha256"] == hashlib.sha256(b"x y").hexdigest() and got[None]["length"] == 6
    assert tuple(got[7])[1:6] == (0, None, None, None, None) and got[7]["collapsed_sha256"] == got[9]["runs_sha256"] == hashlib.sha256(b"").hexdigest()


# -- 13 --------------------------------------------------------------------------------------------


def similar(rows: list[tuple]) -> list[tuple]:
    """By all pairs of rows."""
    sets = [set(shingles(t.encode() if t else None).tolist()) for _, t in rows]
    n = range(len(rows))
    link = {i: [j for j in n if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in n}
    out = []
    for i in n:
        seen, left = {i}, [i]
        while left:
            new = [j for j in link[left.pop()] if j not in seen]
            seen |= set(new)
            left += new
        out.append((rows[i][0], len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(link[i])))
    return sorted(out, key=repr)


def near_copies(seed: int, n: int = 160) -> list[tuple]:
    """Copies of copies of a few texts of 4 to 60 words, near 0.8 on both sides, some with a passage of their own in common."""
    draw, out = random.Random(seed), []
    passage = [f"p{k}" for k in range(12)]
    bases = [[f"w{draw.randrange(400)}" for _ in range(draw.choice([4, 5, 9, 30, 60]))] for _ in range(8)]
    for k in range(n):
        w = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2])):
            w[draw.randrange(len(w))] = f"x{draw.randrange(40)}"
        if draw.random() < 0.4:
            at = draw.randrange(len(w))
            w[at:at] = passage
        if draw.random() < 0.2:
            bases.append(w)
        out.append((k + 7, " ".join(w)))
    return out


@pytest.mark.parametrize("region", [1 << 20, 300])
def test_join_equals_all_pairs(spark, monkeypatch, region):
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", region)  # 300: regions are parted by pivots, then cut
    rows = [*near_copies(3), (None, "a text of some words without id"), (None, "a text of some words without id"), (1, None), (2, "  "), (3, "two words"), (4, "TWO  words"), (5, "")]
    got = jaccard.similar_documents(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == similar(rows)


def test_pivots_part_distinct_clusters(spark, monkeypatch):
    """Clusters far from each other that one common passage brings together are parted between tasks, without loss."""
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", 200)
    draw, rows = random.Random(1), []
    for c in range(6):
        base = [f"c{c}_{k}" for k in range(16)]
        for k in range(25):
            w = ["all", "of", "them", "share", "this", *base]
            w[-1 - draw.randrange(3)] = f"y{k}"
            rows.append((100 * c + k, " ".join(w)))
    monkeypatch.setattr(jaccard, "sketched", lambda docs, own=jaccard.sketched: (own(docs)[0], np.zeros(1024, np.int64)))
    seen = []
    parted = jaccard._parted
    monkeypatch.setattr(jaccard, "_parted", lambda *a: seen.append(1) or parted(*a))
    assert sorted(map(tuple, jaccard.similar_documents(frame(spark, rows)).collect()), key=repr) == similar(rows)
    assert seen


@pytest.mark.parametrize("seed", range(4))
def test_regions_part_without_loss(monkeypatch, seed):
    """Voronoi regions with guests count each pair once, whatever the order of ids."""
    rows = near_copies(seed + 10, 250)
    sets = list({s.tobytes(): s for s in (shingles(t.encode()) for _, t in rows)}.values())
    ids = np.random.default_rng(seed).permutation(len(sets)).astype(np.int64)

    def joined(leaf: int) -> tuple[list, set]:
        monkeypatch.setattr(jaccard, "LEAF", leaf)
        r = jaccard.Region(ids, sets, [np.ones(len(s), bool) for s in sets], np.ones(len(sets), np.int64), np.zeros(len(sets), bool), None)
        r.join()
        root = {int(i): int(i) for i in ids}
        for a, b in r.edges:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
        groups = {}
        for k, v in root.items():
            groups.setdefault(v, set()).add(k)
        return r.linked.tolist(), {frozenset(g) for g in groups.values()}

    whole = joined(10**6)
    assert joined(3) == whole
    want = [sum(100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o)) for o in sets) - 1 for s in sets]
    assert whole[0] == want


def test_join_of_odd_and_empty_tables(spark, odd):
    got = sorted(map(tuple, jaccard.similar_documents(odd).collect()), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got == similar(rows)
    assert jaccard.similar_documents(odd.limit(0)).count() == 0


def test_share_of_four_fifths_counts(spark):
    base = [f"b{k}" for k in range(13)]  # 9 shingles
    more = [*base, "c1", "c2"]  # 11, of which 9 are shared: 0.818
    most = [*more, "c3"]  # 12: 0.75 with base, 11 of 12 with more
    rows = [(3, " ".join(base)), (2, " ".join(more)), (1, " ".join(most)), (9, " ".join(f"d{k}" for k in range(12))), (8, " ".join(f"d{k}" for k in range(14)))]
    assert sorted(map(tuple, jaccard.similar_documents(frame(spark, rows)).collect())) == [(1, 12, 1, 1), (2, 11, 1, 2), (3, 9, 1, 1), (8, 10, 8, 1), (9, 8, 8, 1)]
