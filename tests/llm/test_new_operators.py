"""Whitening, periodic runs and line dedup against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailscope.llm import line_dedup, periodic, queries, whitening

BLANKS = " \t\n\x0b\x0c\r"


def _frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).repartition(3)


# ---- whitening


def _vectors(seed: int, n: int, dim: int) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * np.logspace(0, -2, dim)
    return (rng.normal(size=(n, dim)) @ mix * 4).tolist()


def _whitening_oracle(vectors: dict):
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in vectors.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = {k: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for k, v in x.items()}
    centred = {k: np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums)]) for k, v in x.items()}
    a = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    _, sigma, right = np.linalg.svd(a, full_matrices=False)
    return n, deviation, centred, sigma, right


@pytest.mark.parametrize("n,dim", [(300, 12), (7, 12), (200, 20)])
def test_whitening_matches_svd(spark, n, dim):
    vectors = dict(enumerate(_vectors(n + dim, n, dim)))
    vectors |= {n: vectors[0], n + 1: vectors[0], n + 2: None, n + 3: [None] * dim, n + 4: [math.nan] * dim, n + 5: [math.inf] + [0.0] * (dim - 1)}
    df = _frame(spark, [(k, v, "u", 1) for k, v in vectors.items()], "vec_id long, embedding array<float>, x string, whitened int")
    single = {r.vec_id: r.embedding for r in df.collect()}  # what a float holds
    count, deviation, centred, sigma, right = _whitening_oracle(single)
    rows = df.select("vec_id", whitening.lattice(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    model = whitening.fit_whitening(rows)
    rank = int((sigma > sigma[0] * dim * 1e-14).sum())
    assert model.n == count and len(model.eigenvalues) == min(16, rank)
    e = sigma**2 / count
    assert np.allclose(model.eigenvalues, e[: len(model.eigenvalues)], rtol=1e-9)
    assert np.allclose(model.explained, (e / e.sum())[: len(model.eigenvalues)], rtol=1e-9)
    assert model.identity_error < 1e-9
    got = {r.vec_id: r.whitened for r in whitening.whiten(rows.withColumn("whitened", F.lit(1)), model).collect()}
    assert got.keys() == centred.keys() == deviation.keys()
    for k, r in got.items():
        assert r.deviation == deviation[k]
        for j, w in enumerate(r.whitened):
            sign = np.sign(np.dot(model.components[j], right[j]))
            assert abs(w - sign * np.dot(centred[k], right[j]) / math.sqrt(e[j])) < 1e-6


def test_whitening_ill_conditioned_and_degenerate(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(10**9), 10**9, size=(400, 6))
    base[:, 5] = base[:, 0] + rng.integers(-1, 2, 400)  # all but equal to another dimension: condition number beyond 1e9
    base[:, 4] = 7  # constant
    df = _frame(spark, [(i, (v / 64).tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    rows = df.select("vec_id", whitening.lattice(F.col("embedding")).alias("x"))
    model = whitening.fit_whitening(rows)
    assert len(model.eigenvalues) == 5 and model.identity_error < 1e-6
    a = base - base.mean(axis=0)
    sigma = np.linalg.svd(a[:, [0, 1, 2, 3, 5]], compute_uv=False)
    assert np.allclose(np.sqrt(model.eigenvalues * 400), sigma, rtol=1e-5)

    one = rows.limit(1)
    assert whitening.fit_whitening(one) is None and whitening.fit_whitening(rows.limit(0)) is None
    assert whitening.whiten(one, None).first().whitened is None
    huge = _frame(spark, [(1, [1e300, 2.0]), (2, [-1e300, 5.0]), (3, [1.0, 9.0]), (4, [1.0]), (5, [])], "vec_id long, embedding array<double>")
    rows = huge.select("vec_id", whitening.lattice(F.col("embedding")).alias("x"))
    got = {r.vec_id: r.whitened for r in whitening.whiten(rows, whitening.fit_whitening(rows)).collect()}
    assert got[1].deviation is None and len(got[1].whitened) >= 1 and got[4] is None and got[5] is None


def test_whitening_query(spark, tmp_path):
    vectors = dict(enumerate(_vectors(1, 120, 5)))
    _frame(spark, [(k, v, 0) for k, v in vectors.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op11_whitening(spark, str(tmp_path)).collect()
    assert Counter(r.vec_id for r in rows) == {k: 5 for k in vectors}
    assert {r.component for r in rows} == {1, 2, 3, 4, 5} and abs(sum({r.component: r.explained for r in rows}.values()) - 1) < 1e-12
    empty = _frame(spark, [(1, None, 0)], "vec_id long, embedding array<float>, label int")
    empty.write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.op11_whitening(spark, f"{tmp_path}/none").collect() == []


# ---- periodic runs


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    n, out = len(w), []
    for p in range(1, n // 3 + 1):
        k = p
        while k < n:
            if w[k] != w[k - p]:
                k += 1
                continue
            start = k - p
            while k < n and w[k] == w[k - p]:
                k += 1
            length = k - start
            if length >= max(24, 3 * p) and not any(all(w[start + j] == w[start + j - q] for j in range(q, length)) for q in range(1, p)):
                out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(rng: random.Random, n: int, kinds: int) -> list[str]:
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p, size = rng.randrange(n), rng.randint(1, 20), rng.randint(1, 80)
        for i in range(a, min(n, a + size)):
            w[i] = w[min(a + (i - a) % p, n - 1)]
    return w


def test_runs_of_random_words():
    rng = random.Random(2)
    for _ in range(400):
        w = np.array([int(x[1:]) for x in _words(rng, rng.randint(1, 150), rng.choice([1, 2, 3, 5, 50]))])
        assert periodic.text_runs(w) == brute_runs(w.tolist())
        # the automaton alone, without the stretches that lead to it
        assert sorted(periodic.stretch_runs(w), key=lambda r: (r[0], r[2])) == brute_runs(w.tolist())


def test_runs_of_a_fibonacci_word_and_of_one_word():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert periodic.text_runs(np.array(b[:900])) == brute_runs(b[:900])
    assert periodic.text_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def test_access_tree_keeps_last_occurrences():
    rng = random.Random(3)
    for _ in range(30):
        w = [rng.randrange(3) for _ in range(60)]
        longest, link, ends = periodic.automaton(w)
        tree, seen = periodic.AccessTree(link), {}
        for i, state in enumerate(ends):
            path, node = [], state
            while node >= 0:
                path.append(node)
                node = link[node]
            want = {(max((p for p in path if seen.get(p, -1) == c), key=lambda p: longest[p]), c) for c in {seen.get(p, -1) for p in path} - {-1}}
            assert {s for s in tree.access(state, i) if s[1] >= 0} == want
            seen |= dict.fromkeys(path, i)


def _expected_runs(doc_id, text):
    words = [w for w in "".join(" " if c in BLANKS else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{length},{p}\n" for s, length, p in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def test_runs_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(_words(rng, rng.randint(1, 400), rng.choice([1, 2, 9, 3000]))) for _ in range(80)]
    texts += [None, "", " \n\t", "é x " * 30, "a\x0bb\x0cc\r" * 25, "one two"]
    rows = [(i, t, "r") for i, t in enumerate(texts)] + [(3, texts[3], "r"), (None, texts[2], "r")]
    docs = _frame(spark, rows, "doc_id long, text string, repeats string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert got == Counter(_expected_runs(i, t) for i, t, _ in rows)
    assert sum(n for r, n in got.items() if r[1]) > 20
    found = periodic.find_runs(docs)
    assert sorted(found.columns) == ["doc_id", "repeats", "text"] and found.limit(0).count() == 0


# ---- line dedup


def _key(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def _lines_oracle(rows, judged, min_docs=10, min_chars=1):
    refs = Counter(k for _, t in rows for k in {_key(x) for x in (t or "").split("\n")})
    out = Counter()
    for i, t in judged:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(_key(x)) < min_chars or refs[_key(x)] < min_docs]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def _line_docs(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    pool = [f"Line {k} É" for k in range(60)]
    rows = [(seed * 1000 + i, "\n".join(rng.choice(["  {}\t", "{}", "{}\r"]).format(rng.choice(pool[: rng.randint(1, 60)])) for _ in range(rng.randint(1, 12)))) for i in range(n)]
    return [*rows, (None, rows[0][1]), (seed * 1000, rows[0][1]), (seed * 1000 + n, None), (seed * 1000 + n, ""), (seed * 1000 + n + 1, "\n\n"), (seed * 1000 + n + 2, " \nÉ\né\nLINE 1 É")]


def _kept(df):
    return Counter((r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.lines.kept) for r in df.collect())


def test_lines_match_brute_force(spark):
    rows = _line_docs(1, 60)
    df = _frame(spark, [(*r, "s", 1) for r in rows], "doc_id long, text string, lines string, rid int")
    got = line_dedup.dedup_lines(df)
    assert sorted(got.columns) == ["doc_id", "lines", "rid", "text"]
    assert _kept(got) == _lines_oracle(rows, rows)
    assert _kept(line_dedup.dedup_lines(df, min_docs=3, min_chars=8)) == _lines_oracle(rows, rows, 3, 8)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_index_is_incremental_and_reversible(spark):
    parts = [_line_docs(k, 25) for k in (1, 2, 3)]
    a, b, c = (_frame(spark, rows, "doc_id long, text string") for rows in parts)
    index = line_dedup.empty_index(spark, shards=4)
    first = line_dedup.insert_documents(index, a)
    both = line_dedup.insert_documents(first, b)
    every = line_dedup.insert_documents(both, c)
    less = line_dedup.delete_documents(every, b)
    for held, rows in ((first, parts[0]), (both, parts[0] + parts[1]), (every, sum(parts, [])), (less, parts[0] + parts[2])):
        assert _kept(line_dedup.drop_common_lines(a, held)) == _lines_oracle(rows, parts[0])
    none = line_dedup.delete_documents(line_dedup.delete_documents(less, a), c)
    assert none.refs.count() == 0 and all(not any(r["cells"]) and not r["stash"] for r in none.filters.collect())
    with pytest.raises(Exception, match="not in the index"):
        line_dedup.delete_documents(none, a)


def test_filters_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "ROUND_BYTES", 1)
    rows = _line_docs(4, 60)
    assert _kept(line_dedup.dedup_lines(_frame(spark, rows, "doc_id long, text string"))) == _lines_oracle(rows, rows)


def test_shard_bounds(spark):
    for shards in (1, 3, 256):
        bounds = [line_dedup._first_key(k, shards) for k in range(shards + 1)]
        assert bounds[0] == -(1 << 63) and bounds[-1] == 1 << 63
        keys = [(b + d, k - (d < 0)) for k, b in enumerate(bounds) for d in (-1, 0) if -(1 << 63) <= b + d < 1 << 63]
        got = spark.createDataFrame(keys, "k1 long, want int").select(line_dedup._shard_of("k1", shards).alias("got"), "want").collect()
        assert all(r.got == r.want for r in got)


def test_cuckoo_filter():
    rng = np.random.default_rng(6)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, size=6000)
    f = line_dedup.CuckooFilter.sized(len(keys))
    f.insert(keys)
    assert f.contains(keys).all() and not f.stash
    assert f.contains(rng.integers(-(1 << 63), (1 << 63) - 1, size=200_000)).mean() < 0.001
    f.delete(keys[:3000])
    assert f.contains(keys[3000:]).all() and f.contains(keys[:3000]).mean() < 0.01
    full = line_dedup.CuckooFilter(np.zeros((4, line_dedup.SLOTS), np.uint16))
    full.insert(keys[:40])  # far beyond its places: the rest is stashed, none is lost
    assert full.contains(keys[:40]).all() and full.stash
    full.delete(keys[:40])
    assert not full.table.any() and not full.stash


# ---- near duplicates of rows that share an id


def test_near_duplicates_of_an_id_with_several_texts(spark):
    from trailscope.llm import minhash

    rng = random.Random(12)
    prose = [" ".join(f"w{rng.randrange(900)}" for _ in range(200)) for _ in range(4)]
    near = prose[1].split(" ")
    near[50] = "other"
    rows = [(1, prose[0]), (1, prose[1]), (2, " ".join(near)), (3, prose[2]), (3, prose[2]), (4, prose[2].upper()), (5, ""), (5, ""), (None, prose[2]), (6, prose[3]), (6, None)]
    rng.shuffle(rows)
    df = _frame(spark, [(*r, 0) for r in rows], "doc_id long, text string, near_id int")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (5, 5, True), (6, 6, True), (None, None, True)}
    kept = Counter((r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect())
    # Texts decide: both unrelated texts of id 1 stay, one row of each group of copies, all blank ones.
    assert kept == Counter([(1, prose[0]), (1, prose[1]), (3, prose[2]), (5, ""), (5, ""), (None, prose[2]), (6, prose[3]), (6, None)])
