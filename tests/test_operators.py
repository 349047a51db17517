"""Property checks of the rewrites against their textbook forms."""

from __future__ import annotations

import random

import pytest

from pyspark.sql.functions import expr as E

from trailscope.functions.steps import DEFAULT_STEPS, step_sql
from trailscope.operators.chains import funnel_chains, funnel_depth, successor_pairs
from trailscope.operators.expand import replicate_rows
from trailscope.operators.ranking import first_pages, rank_pages, rank_pages_plain

URLS = list(DEFAULT_STEPS) + ["/other", "/error"]


def random_pageviews(spark, seed: int, sessions: int = 40):
    rng = random.Random(seed)
    rows, pid = [], 0
    for sid in range(sessions):
        n = rng.choice([1, 2, 3, 5, 8, 12])
        for _ in range(n):
            pid += rng.choice([0, 1, 1, 1, 1, 2, 5])  # 0: a tied id
            # Mostly walk the funnel, sometimes jump or restart.
            url = rng.choice(URLS) if rng.random() < 0.4 else list(DEFAULT_STEPS)[min(len(rows) % 10, 9)]
            rows.append((pid, sid, url))
    return spark.createDataFrame(rows, "website_pageview_id long, website_session_id long, pageview_url string")


@pytest.mark.parametrize("width", [1, 3, 16])
def test_chunked_rank_equals_rank(spark, width):
    pv = random_pageviews(spark, 7)
    a = sorted(map(tuple, rank_pages(pv, chunk_rows=width).collect()))
    b = sorted(map(tuple, rank_pages_plain(pv).collect()))
    assert a == b


def test_chunked_rank_keeps_ties(spark):
    pv = spark.createDataFrame(
        [(5, 1, "/a"), (5, 1, "/b"), (9, 1, "/c"), (2, 1, "/d")],
        "website_pageview_id long, website_session_id long, pageview_url string",
    )
    got = sorted((r.pageview_url, r.rank_page) for r in rank_pages(pv, chunk_rows=4).collect())
    assert got == [("/a", 2), ("/b", 2), ("/c", 4), ("/d", 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_diagonal_chains_equal_a_walk(spark, seed):
    """Walk every chain page by page in Python, from each first-step page on."""
    pv = random_pageviews(spark, seed)
    by_session = {}
    for r in pv.select("website_session_id", "website_pageview_id", "pageview_url", E(f"{step_sql('pageview_url')} AS step")).collect():
        by_session.setdefault(r.website_session_id, []).append(r)
    walked = []
    for sid, pages in by_session.items():
        place = {id(p): 1 + sum(q.website_pageview_id < p.website_pageview_id for q in pages) for p in pages}
        at = {}
        for p in pages:
            at.setdefault((place[id(p)], p.step), []).append(p)
        ends = [(place[id(p)], p) for p in pages if p.step == 1]
        while ends:
            k, p = ends.pop()
            walked.append((sid, p.pageview_url, p.step, k, 1 if k == p.step else None))
            ends += [(k + 1, q) for q in at.get((k + 1, p.step + 1), [])]
    key = lambda t: tuple((x is None, x if x is not None else 0) for x in t)
    want = sorted(walked, key=key)
    got = sorted((tuple(r) for r in funnel_chains(rank_pages(pv, chunk_rows=4)).collect()), key=key)
    assert got == want
    # Depth from the first seven pages equals the longest valid chain.
    depth = {r.website_session_id: r.depth for r in funnel_depth(first_pages(pv, 7)).collect()}
    valid = {}
    for r in want:
        if r[4] == 1:
            valid[r[0]] = max(valid.get(r[0], 0), r[2])
    assert {s: d for s, d in depth.items() if d > 0} == valid


def test_funnel_counts_never_rise(spark):
    pv = random_pageviews(spark, 11)
    depth = funnel_depth(first_pages(pv, 7)).collect()
    counts = [sum(1 for r in depth if r.depth >= k) for k in range(1, 8)]
    assert counts == sorted(counts, reverse=True)


def test_replicate_rows_small_and_hot(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3), ("hot", 23)], "k string, n int")
    out = replicate_rows(df, "n", chunk_rows=5).groupBy("k").count().collect()
    assert dict((r.k, r["count"]) for r in out) == {"b": 1, "c": 3, "hot": 23}


def test_half_up_rounding_is_exact_near_a_tie(spark):
    from trailscope.functions.ratios import round_ratio_half_up_sql

    d = 600000000 * 10**6  # large denominators, like summed microseconds
    cases = [((2674999999 * d) // 10**9, d, 2.67), ((2675 * d) // 1000, d, 2.68), (25, 8, 3.13), (0, 7, 0.0)]
    for num, den, want in cases:
        got = spark.sql(f"SELECT {round_ratio_half_up_sql(str(num), str(den))} AS v").collect()[0].v
        assert got == want, (num, den, got)
    assert spark.sql(f"SELECT {round_ratio_half_up_sql('5', '0')} AS v").collect()[0].v is None


@pytest.mark.parametrize("seed", [4, 5])
def test_successor_pairs_equal_self_join(spark, seed):
    pv = random_pageviews(spark, seed)
    ranked = rank_pages_plain(pv)
    ranked.createOrReplaceTempView("ranked_pv")
    step = step_sql("pageview_url")
    self_join = spark.sql(
        f"""WITH s AS (SELECT website_session_id, pageview_url, rank_page, {step} AS step FROM ranked_pv)
            SELECT a.website_session_id, a.pageview_url, b.pageview_url, CAST(a.step AS INT), CAST(a.rank_page AS INT)
            FROM s a JOIN s b ON a.website_session_id = b.website_session_id
             AND b.rank_page = a.rank_page + 1 AND b.step = a.step + 1"""
    )
    got = sorted(map(tuple, successor_pairs(ranked).collect()))
    assert got == sorted(map(tuple, self_join.collect()))
    assert len(got) > 0


def test_rank_and_replication_properties(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(
        sizes=st.lists(st.integers(min_value=1, max_value=40), min_size=1, max_size=5),
        gaps=st.integers(min_value=1, max_value=7),
        width=st.integers(min_value=1, max_value=50),
    )
    def check(sizes, gaps, width):
        rows, pid = [], 0
        for sid, n in enumerate(sizes):
            for _ in range(n):
                pid += gaps
                rows.append((pid, sid, "/home"))
        pv = spark.createDataFrame(rows, "website_pageview_id long, website_session_id long, pageview_url string")
        assert sorted(map(tuple, rank_pages(pv, chunk_rows=width).collect())) == sorted(
            map(tuple, rank_pages_plain(pv).collect())
        )
        counts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k long, n long")
        out = replicate_rows(counts, "n", chunk_rows=max(1, width // 5))
        assert {r.k: r["count"] for r in out.groupBy("k").count().collect()} == dict(enumerate(sizes))

    check()
