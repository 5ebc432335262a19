"""Vector codes, vector near duplicates and spelling variants against brute-force versions."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest

from lumenframe.llm import spelling, vector_codes, vector_dedup

VECTORS = "vec_id long, embedding array<float>, label string, code string, list int, node long, n int, number string"


def table_of(spark, rows):
    """Rows of (id, vector, label) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "c", 1, 2, 3, "x") for r in rows], VECTORS).repartition(3)


def clusters(seed, sizes, labels=2, dims=16, noise=0.02):
    """Groups of near copies, exact copies, null and broken vectors, missing labels, repeated rows, negative zeros."""
    rng, rows = np.random.default_rng(seed), []
    for size in sizes:
        centre, label = rng.normal(size=dims), f"k{rng.integers(labels)}"
        for _ in range(size):
            rows.append((len(rows), (centre + noise * math.sqrt(dims) * rng.normal(size=dims) * rng.uniform(0, 2)).astype(np.float32).tolist(), label))
    base = rows[0][1]
    rows += [(1000, base, rows[0][2]), (1001, base, rows[0][2]), (1002, base, None), (1003, None, "k0"), (1004, [0.0] * dims, "k0"),
             (1005, [float("nan")] + base[1:], "k0"), (1006, [None] + base[1:], "k0"), (1007, [float("inf")] + base[1:], "k1"),
             (1008, [-0.0] + [1.0] * (dims - 1), "k1"), (1009, [0.0] + [1.0] * (dims - 1), "k1"), (1010, [2.0 * x for x in base], rows[0][2])]
    return rows


# --- Vector codes -----------------------------------------------------------------------------------------------------

def brute_codes(rows):
    kept = sorted(((i, [math.floor(4096 * float(np.float32(x))) for x in v], k) for i, v, k in rows
                   if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[1]))
    parts, out = vector_codes.PARTS, {}
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[: vector_codes.ENTRIES]] for p in range(parts)]
    for turn in range(vector_codes.ROUNDS + 1):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for n, (_, v, _) in enumerate(kept):
                d, e = min((away(cut(v, p), entry), e) for e, entry in enumerate(books[p]))
                groups[e].append(cut(v, p))
                out.setdefault(n, {})[p] = (e, d)
            if turn < vector_codes.ROUNDS:
                for e, own in groups.items():
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((kept[n][0], bytes(c[p][0] for p in range(parts)), sum(d for _, d in c.values())) for n, c in out.items()), key=str), books


@pytest.mark.parametrize("sizes", [(5, 30, 1, 1, 1, 12, 40), (3,), (1,) * 25])
def test_codes_equal_brute_force(spark, sizes):
    rows = clusters(3, sizes, noise=0.2)
    coded, books = vector_codes.compress(table_of(spark, rows))
    want, expected = brute_codes(rows)
    assert sorted(((r.vec_id, bytes(r.code), r.error) for r in coded.collect()), key=str) == want
    assert [b.tolist() for b in books] == expected


def test_codes_of_odd_tables(spark):
    empty, books = vector_codes.compress(table_of(spark, clusters(1, (2,))).limit(0))
    assert empty.count() == 0 and all(len(b) == 0 for b in books)
    odd = [(1, [1.0] * 8, "a"), (1, [1.0] * 8, "a"), (2, [1.0] * 7, "a"), (3, [1.0] * 16, None), (4, [], "a"), (None, [5.0] * 8, "b"), (5, [3e38] + [0.0] * 7, "b")]
    coded, books = vector_codes.compress(table_of(spark, odd))
    got = {(r.vec_id, r.error) for r in coded.collect()}
    # The vector without an id is coded, though it starts no entry; those that do not fit have no code.
    assert coded.count() == 7 and {(2, None), (3, None), (4, None), (5, None)} <= got and len(books[0]) == 2
    assert all(r.code is not None for r in coded.collect() if r.vec_id in (1, None))


def test_slices_find_the_nearest_entry_with_ties():
    rng = np.random.default_rng(5)
    for k, dims, spread in ((16, 8, 1000), (16, 1, 3), (1, 4, 50), (7, 3, 2)):
        entries, parts = rng.integers(-spread, spread, (k, dims)), rng.integers(-3 * spread, 3 * spread, (500, dims))
        codes, errors = vector_codes.Slices(entries).nearest(parts)
        away = ((parts[:, None] - entries) ** 2).sum(axis=2)
        assert (codes == away.argmin(axis=1)).all() and (errors == away.min(axis=1)).all()
        radius = rng.integers(0, 2 * spread, 500)
        inside = (np.abs(parts[:, None] - entries) <= radius[:, None, None]).all(axis=2)
        masks = vector_codes.Slices(entries).masks(parts, radius)
        assert (((masks[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(bool) == inside).all()


# --- Vector near duplicates -------------------------------------------------------------------------------------------

def brute_links(rows):
    usable = [n for n, (i, v, k) in enumerate(rows) if i is not None and k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    units = {n: np.array(rows[n][1], dtype=np.float32).astype(float) for n in usable}
    units = {n: v / np.linalg.norm(v) for n, v in units.items()}
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(n):
        return n if root[n] == n else top(root[n])

    for x, a in enumerate(usable):
        for b in usable[:x]:
            if rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98:
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[top(a)] = top(b)
    least = {}
    for n in usable:
        least[top(n)] = min(least.get(top(n), rows[n][0]), rows[n][0])
    component = [least.get(top(n), i) if n in units else i for n, (i, _, _) in enumerate(rows)]
    return sorted(((i, links[n], component[n], component[n] in (i, None)) for n, (i, _, _) in enumerate(rows)), key=str)


def linked(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect()), key=str)


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_links_equal_brute_force(spark, monkeypatch, block):
    """In one block a list, and in many."""
    monkeypatch.setattr(vector_dedup, "BLOCK_VALUES", block)
    rows = clusters(7, (40, 90, 5, 5, 3, 1, 1, 1, 25, 150), dims=16)
    rows += [(2000, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2]), (2001, rows[5][1][:9], rows[5][2]), (2002, rows[5][1][:9] , rows[5][2]),
             (2003, rows[0][1] + [0.0], rows[0][2]), (5, rows[60][1], rows[60][2]), (2004, [], "k0"), (2005, [1e30] * 16, "k1")]
    want = brute_links(rows)
    assert linked(table_of(spark, rows)) == want
    assert max(w[1] for w in want) > 64 and any(w[1] > 0 and w[2] != w[0] for w in want)


def test_every_probe_is_made(spark, monkeypatch):
    """With many lists for few vectors, near copies lie in different lists and are still all found."""
    monkeypatch.setattr(vector_dedup, "MIN_LISTS", 60)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 12))
    rows = [(2 * i + j, (v / np.linalg.norm(v) + j * 0.19 * d / np.linalg.norm(d)).astype(np.float32).tolist(), "k")
            for i, (v, d) in enumerate(zip(base, rng.normal(size=(150, 12)))) for j in (0, 1)]
    want = brute_links(rows)
    assert linked(table_of(spark, rows)) == want and sum(w[1] for w in want) >= 280


def test_odd_vector_tables(spark):
    assert linked(table_of(spark, clusters(1, (2,))).limit(0)) == []
    none = [(1, None, "a"), (2, [1.0], None), (None, [1.0], "a")]
    assert linked(table_of(spark, none)) == brute_links(none)
    one = [(3, [1.0], "a"), (3, [1.0], "a"), (4, [-1.0], "a"), (9, [2.0], "a"), (9, [2.0], "b")]
    assert linked(table_of(spark, one)) == brute_links(one)


# --- Spelling variants ------------------------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items()), key=str)


def found(df):
    return sorted((tuple(r) for r in spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


@pytest.mark.parametrize("hot", [1024, 1])
def test_variants_equal_brute_force(spark, monkeypatch, hot):
    """With the usual look-up, and with every shared reduced word taken for a hot one."""
    monkeypatch.setattr(spelling, "HOT_WORDS", hot)
    rng = random.Random(hot)
    letters = "abiqyèéÿ×"
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 9]))) for _ in range(150)}
    for w in sorted(words)[:120]:
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:], w + w[-1]}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "iiiiiii", "aaaaaai", "qaaaaaa", "z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1500}
    counts = {w: rng.choice([2, 2, 3, 25, 300, 4000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    want = brute_variants(counts)
    assert found(table) == want
    assert any(w[3] and w[5] != w[3] for w in want)


def test_word_counts(spark):
    texts = [(1, "Hello, wörldly WÖRLDLY hellooo! Äpfelmus Äpfelmus äpfelmus"), (2, "hellooo snake_caseword's caseword CASEWORD"), (3, None), (4, ""),
             (5, "x" * 5000), (6, "x" * 5000), (None, "hellooo"), (7, "東京abcdefg abcdefg"), (8, "seven×seven seven×seven")]
    docs = spark.createDataFrame([(i, t, 1, "k", "w") for i, t in texts], "doc_id long, text string, n int, id string, word string").repartition(2)
    for slips in (None, 3):
        want = collections.Counter()
        for i, t in texts:
            low = "".join(c.lower() if c.isascii() else c for c in t or "")
            run = ""
            for c in low + " ":
                if c.isascii() and c.isalpha() or 0xC0 <= ord(c) <= 0xFF:
                    run += c
                    continue
                if run:
                    h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                    if slips and h % slips == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1:]
                    want[run] += len(run) >= 7
                run = ""
        got = {r.word: r.n for r in spelling.word_counts(docs, slips=slips).collect()}
        assert got == {w: n for w, n in want.items() if n >= 2}
    assert spelling.word_counts(docs.limit(0), slips=31).count() == 0 and found(spark.createDataFrame([], "word string, n long")) == []
