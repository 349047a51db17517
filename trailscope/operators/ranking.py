"""Page position inside a session: ``RANK() OVER (PARTITION BY session ORDER BY id)``.

Sessions of ordinary size are ranked by a window over the session. A hot session, one with more page views than a task should sort, is
first folded to distinct page views with their number, then cut at quantiles of its ids; ranks are running sums of the numbers. So neither a long session
nor a page view that is repeated millions of times is ever sorted, or even held, by one task; copies are expanded last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import COPIES
from trailscope.operators.expand import replicate_rows

SID = "website_session_id"
PID = "website_pageview_id"
DEFAULT_CHUNK_ROWS = 1 << 20
#: A session counts as hot with more than one part in this many of all rows, so there are fewer hot sessions than this: a bounded list.
MAX_HOT_SESSIONS = 100_000
#: Quantiles a hot session can be cut at, and the size of the sketch that gives them (rank error about 1 part in 5,000).
CUT_BITS = 12
SKETCH_SIZE = 8192
E = F.expr


def first_pages(pv: DataFrame, k: int, rank_col: str = "rank_page") -> DataFrame:
    """Rows with rank <= k. Planned as a partial ``WindowGroupLimit`` before the
    shuffle, so at most ``k`` rows per session leave each map task (more where page views are repeated: see :func:`leading_pages`)."""
    return pv.withColumn(rank_col, E(f"rank() OVER (PARTITION BY {SID} ORDER BY {PID})")).filter(f"{rank_col} <= {k}")


def _leading(pv: DataFrame, k: int, page: str) -> DataFrame:
    local = pv.select(SID, PID, E(f"{page} AS page"), E(f"named_struct('s', {SID}, 't', spark_partition_id()) AS __key"))
    local = local.withColumn("__r", E(f"rank() OVER (PARTITION BY __key ORDER BY {PID} NULLS LAST)")).filter(f"__r <= {k}")
    folded = local.groupBy("__key", PID, "page").agg(E("count(1) AS n_views"), E(f"count({PID}) AS n_ids"))
    return (
        folded.select(E(f"__key.s AS {SID}"), PID, "page", "n_views", "n_ids")
        .withColumn("rank_page", E(f"rank() OVER (PARTITION BY {SID} ORDER BY {PID} NULLS LAST)"))
        .filter(f"rank_page <= {k}")
    )


def entry_pages(pv: DataFrame, k: int = 1, page: str = "pageview_url") -> DataFrame:
    """The first page views of every session: ``website_session_id, page, rank_page, n_views, n_ids``.

    Equal views (same id and ``page``, a SQL text over the page view) of one map
    task are one row with their number; ``n_ids`` counts those with an id. All
    views of the smallest id have ``rank_page`` 1; with ``k > 1`` at least ``k``
    views of each longer session are represented. Views without an id come last.

    Ranks are limited per (session, map task) first, before the shuffle, and
    equal views folded there, so neither a session nor a page view that holds
    a third of all rows ends up in one task.
    """
    return _leading(pv, k, page).select(SID, "page", "rank_page", "n_views", "n_ids")


def _smaller_sql(n: str, partition: str, order: str) -> str:
    """Views with a smaller id than the row's: a running sum of the numbers less those of its own id (one sort serves both windows)."""
    upto = f"sum({n}) OVER (PARTITION BY {partition} ORDER BY {order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"({upto} - sum({n}) OVER (PARTITION BY {partition}, {PID}))"


def leading_pages(pv: DataFrame, k: int, page: str = "pageview_url", rank_col: str = "rank_page") -> DataFrame:
    """The page views of rank <= k, equal ones of a map task as one row: ``website_session_id, page, rank_col, n_views``.

    The same ranks as :func:`first_pages`, ties included, from the folded views that :func:`entry_pages` also starts from: a view with
    rank <= k and all before it survive the limits, so running sums of their numbers give its rank. Views without an id come last.
    """
    ranked = _leading(pv, k, page).withColumn("__rank", E(f"1 + {_smaller_sql('n_views', SID, f'{PID} NULLS LAST')}"))
    return ranked.filter(f"__rank <= {k}").select(SID, "page", E(f"CAST(__rank AS INT) AS {rank_col}"), "n_views")


def hot_sessions(pv: DataFrame, chunk_rows: int) -> DataFrame:
    """``(__hot, __n)``: sessions with more than ``chunk_rows`` page views, and more than one in :data:`MAX_HOT_SESSIONS` of all."""
    counts = pv.groupBy(SID).agg(E("count(1) AS __n"))
    total = pv.agg(E("count(1)")).scalar()
    return counts.filter(F.col("__n") > F.greatest(F.lit(chunk_rows), total / MAX_HOT_SESSIONS)).select(E(f"{SID} AS __hot"), "__n")


def _cuts(folded: DataFrame, chunk_rows: int) -> DataFrame:
    """``(__cut, __cuts)``: ids at which a hot session is cut, quantiles of its distinct page views from a mergeable sketch.

    Every session has the same grid of quantiles and takes as many of them as it has chunks (a power of two), so
    all sessions together have at most twice as many cuts as the table has chunks.
    """
    # One constant text, cast: thousands of literals would cost the analyzer seconds.
    grid = "CAST(split('" + ",".join(str(i / (1 << CUT_BITS)) for i in range(1, 1 << CUT_BITS)) + "', ',') AS ARRAY<DOUBLE>)"
    sketch = folded.groupBy(SID).agg(E(f"kll_sketch_agg_bigint({PID}, {SKETCH_SIZE}) AS __sketch"), E("count(1) AS __rows"))
    step = f"shiftright({1 << CUT_BITS}, CAST(least({CUT_BITS}, ceil(log2(greatest(1.0D, __rows / {float(chunk_rows)})))) AS INT))"
    points = sketch.select(SID, E(f"{step} AS __step"), E(f"kll_sketch_get_quantile_bigint(__sketch, {grid}) AS __all"))
    return points.select(E(f"{SID} AS __cut"), E("filter(__all, (x, i) -> (i + 1) % __step = 0) AS __cuts"))


#: Number of cuts <= the id, by binary search from the highest bit down. Views without an id come first.
_PLACE = (
    f"aggregate(sequence({CUT_BITS - 1}, 0), 0, (p, b) -> IF(p + shiftleft(1, b) <= size(__cuts) "
    f"AND element_at(__cuts, p + shiftleft(1, b)) <= {PID}, p + shiftleft(1, b), p))"
)


def _ranked_hot(views: DataFrame, chunk_rows: int, columns: list[str], rank_col: str) -> DataFrame:
    """Folded page views of the hot sessions with their number and rank.

    A view's chunk is its place among the session's cuts; the views before a chunk are a running sum over the (small) table of chunk sizes.
    Fold, chunks and windows are keyed by the whole view or by ``struct(session, chunk)``: no step brings a session together.
    """
    folded = views.groupBy(*columns).agg(E(f"count(1) AS {COPIES}"))
    cut = folded.join(F.broadcast(_cuts(folded, chunk_rows)), E(f"{SID} = __cut"))  # at most MAX_HOT_SESSIONS rows and twice as many cuts
    keyed = cut.withColumn("__key", E(f"named_struct('s', {SID}, 'c', {_PLACE})")).select(*columns, COPIES, "__key")
    counts = keyed.groupBy("__key").agg(E(f"sum({COPIES}) AS __n"))
    before = "OVER (PARTITION BY __key.s ORDER BY __key.c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = counts.select("__key", E(f"sum(__n) {before} AS __off")).filter("__off > 0")
    rank = f"CAST(1 + coalesce(__off, 0) + {_smaller_sql(COPIES, '__key', PID)} AS INT) AS {rank_col}"
    return keyed.join(offsets, "__key", "left").select(*columns, E(rank), COPIES)


def over_ranks(
    pv: DataFrame,
    then: Callable[[DataFrame], DataFrame],
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    rank_col: str = "rank_page",
) -> DataFrame:
    """``then`` over all page views with their rank, where ``then`` works session by session.

    It is applied to the ordinary sessions and to the folded views of the hot ones, whose rows stand for ``COPIES`` equal views; what it
    returns of those is expanded at the end. ``then`` must keep that column.
    """
    hot = F.broadcast(hot_sessions(pv, chunk_rows).select("__hot"))  # fewer than MAX_HOT_SESSIONS ids
    plain = rank_pages_plain(pv.join(hot, E(f"{SID} = __hot"), "left_anti"), rank_col)
    folded = _ranked_hot(pv.join(hot, E(f"{SID} = __hot"), "left_semi"), chunk_rows, pv.columns, rank_col)
    return then(plain).unionByName(replicate_rows(then(folded), COPIES, spread_all=True).drop(COPIES))


def rank_pages(pv: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS, rank_col: str = "rank_page") -> DataFrame:
    """Full page rank per session, one row per page view, without sorting a hot session in one task."""
    return over_ranks(pv, lambda ranked: ranked, chunk_rows, rank_col)


def rank_pages_plain(pv: DataFrame, rank_col: str = "rank_page") -> DataFrame:
    """The textbook window form (one sort per session)."""
    return pv.withColumn(rank_col, E(f"rank() OVER (PARTITION BY {SID} ORDER BY {PID})"))
