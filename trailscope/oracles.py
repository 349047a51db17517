"""DuckDB twins of the registry queries.

Every SQL text starts with the same derivation of the three web tables from
``events`` (see :mod:`trailscope.sources.events`). The page-view reports are then
computed from one list per session, the trail of its page views ordered by id:
places, landing pages, stays and funnel chains are list expressions over it.
Sales reports count "legs", the session rows once per order row. The Spark side
gets the same results from rollups, limited windows, diagonals and weights, so
each pair checks two different formulations against each other.
"""

from __future__ import annotations

from trailscope.functions.steps import DEFAULT_FUNNEL_COLUMNS, step_sql
from trailscope.registry import AB_PAGES, REPEATED_QUERIES, SEGMENT, W, W_AB, W_UPDATE, W_UPDATE_WEEKS

DERIVE = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         user_id * 100 + day(ts) AS sid
  FROM events
),
ev_r AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY event_id) AS r FROM ev
),
website_pageviews AS (
  SELECT event_id AS website_pageview_id, ts AS created_at, sid AS website_session_id,
         CASE WHEN k >= 25 THEN
              CASE WHEN r = 1 THEN CASE WHEN event_id % 2 = 0 THEN '/home' ELSE '/lander-1' END
                   WHEN r = 2 THEN '/products'
                   WHEN r = 3 THEN CASE event_id % 3 WHEN 0 THEN '/the-original-mr-fuzzy'
                                                     WHEN 1 THEN '/the-forever-love-bear'
                                                     ELSE '/the-birthday-sugar-panda' END
                   WHEN r = 4 THEN '/cart'
                   WHEN r = 5 THEN '/shipping'
                   WHEN r = 6 THEN '/billing'
                   WHEN r = 7 THEN '/thank-you-for-your-order'
                   ELSE '/other' END
              ELSE CASE event_type WHEN 'view' THEN '/home' WHEN 'click' THEN '/products'
                                   WHEN 'signup' THEN '/cart' WHEN 'purchase' THEN '/billing'
                                   ELSE '/error' END
         END AS pageview_url
  FROM ev_r
),
raw_sessions AS (
  SELECT sid AS website_session_id, ts AS created_at, user_id,
         CAST(CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 0 ELSE 1 END AS INTEGER)
           AS is_repeat_session,
         CASE k % 5 WHEN 0 THEN 'gsearch' WHEN 1 THEN 'gsearch' WHEN 2 THEN 'bsearch' WHEN 3 THEN 'socialbook' END
           AS utm_source,
         CASE WHEN k % 5 = 4 THEN NULL WHEN k % 2 = 0 THEN 'nonbrand' ELSE 'brand' END AS utm_campaign,
         CASE WHEN k % 3 = 0 THEN NULL ELSE 'g_ad_' || CAST(k % 2 AS VARCHAR) END AS utm_content,
         CASE WHEN k % 10 < 6 THEN 'desktop' ELSE 'mobile' END AS device_type,
         CASE k % 5 WHEN 0 THEN 'https://www.gsearch.com' WHEN 1 THEN 'https://www.gsearch.com'
                    WHEN 2 THEN 'https://www.bsearch.com' WHEN 3 THEN 'https://www.socialbook.com' END
           AS http_referer
  FROM ev_r WHERE r = 1
),
website_sessions AS (
  SELECT website_session_id, created_at, user_id, is_repeat_session,
         COALESCE(utm_source, 'direct') AS utm_source,
         COALESCE(utm_campaign, 'noncampaign') AS utm_campaign,
         COALESCE(utm_content, 'noncontent') AS utm_content,
         device_type,
         COALESCE(http_referer, 'nonreferer') AS http_referer
  FROM raw_sessions
),
website_orders AS (
  SELECT sid AS website_session_id,
         CAST(1 + k % 2 AS INTEGER) AS items_purchased,
         CAST(value AS DECIMAL(10,2)) AS price_usd,
         CAST(CAST(value AS DECIMAL(10,2)) * 0.4 AS DECIMAL(12,4)) AS cogs_usd
  FROM ev WHERE event_type = 'purchase' AND k < 70
)"""

SEG = f"utm_source = '{SEGMENT.source}' AND utm_campaign = '{SEGMENT.campaign}'"
IN_SEGMENT = f"(SELECT website_session_id FROM website_sessions WHERE {SEG})"

# The tables with repeated rows: every fourth page view, fifth session and third order row a second time.
REPEATS = {
    "website_sessions": "website_session_id % 5 = 0",
    "website_pageviews": "website_pageview_id % 4 = 0",
    "website_orders": "website_session_id % 3 = 0",
}


def over_tables(sql: str) -> str:
    """The same oracle without the derivation: for views named ``website_sessions``,
    ``raw_sessions``, ``website_pageviews`` and ``website_orders`` registered directly."""
    head = "WITH " + DERIVE
    if not sql.startswith(head):
        raise ValueError("not an oracle over the derived tables")
    rest = sql[len(head) :]
    return "WITH " + rest[1:].lstrip("\n") if rest.startswith(",") else rest.lstrip("\n")


def over_repeated(sql: str) -> str:
    """The same oracle over tables with planted repeated rows (:data:`REPEATS`)."""
    derive = DERIVE
    for table, rows in REPEATS.items():
        derive = derive.replace(f"\n{table} AS (", f"\nonce_{table} AS (")
        derive += f",\n{table} AS (SELECT * FROM once_{table} UNION ALL SELECT * FROM once_{table} WHERE {rows})"
    return sql.replace(DERIVE, derive, 1)


def _sql(body: str, *parts: str) -> str:
    return f"WITH {DERIVE}" + "".join(f",\n{p}" for p in parts) + f"\n{body}"


def _visits(window, only: str = "") -> str:
    """One row per session: its trail of page views in the window, a list ordered by page-view id.

    ``doors`` are the urls of the views that share the smallest id (one, unless a page view is repeated).
    """
    keep = f" AND website_session_id IN {only}" if only else ""
    return f"""trails AS (
  SELECT website_session_id, count(website_pageview_id) AS n_views,
         date_diff('microsecond', min(created_at), max(created_at)) AS micros,
         list({{'pid': website_pageview_id, 'url': pageview_url}} ORDER BY website_pageview_id) AS trail
  FROM website_pageviews
  WHERE {window.sql('created_at')}{keep}
  GROUP BY ALL
),
visits AS (
  SELECT *, list_transform(list_filter(trail, lambda v: v.pid = trail[1].pid), lambda v: v.url) AS doors FROM trails
)"""


# Every view of a trail with its place: one more than the views with a smaller id (so equal ids share a place).
STOPS = f"""stops AS (
  SELECT *, {step_sql('url')} AS step
  FROM (SELECT website_session_id, v.pid AS pid, v.url AS url,
               1 + len(list_filter(trail, lambda w: w.pid < v.pid)) AS place
        FROM (SELECT website_session_id, trail, unnest(trail) AS v FROM visits))
)"""

# A stop of step n continues a chain if the n - 1 places before it hold the steps 1 .. n - 1.
CHAIN_STOPS = """chain_stops AS (
  SELECT website_session_id, url, step, place
  FROM stops JOIN (SELECT website_session_id, list(place * 100 + step) AS marks FROM stops WHERE step IS NOT NULL GROUP BY ALL)
       USING (website_session_id)
  WHERE step IS NOT NULL
    AND list_has_all(marks, list_transform(range(1, step), lambda j: (place - step + j) * 100 + j))
)"""

# Session rows once per order row of the session; sessions without an order once.
LEGS = """legs AS (
  SELECT s.*, TRUE AS bought, o.items_purchased * o.price_usd AS sale, o.items_purchased * o.cogs_usd AS cost
  FROM website_sessions AS s, website_orders AS o
  WHERE s.website_session_id = o.website_session_id
  UNION ALL
  SELECT s.*, FALSE, NULL, NULL FROM website_sessions AS s ANTI JOIN website_orders USING (website_session_id)
)"""

BASKETS = """baskets AS (
  SELECT website_session_id, CAST(sum(items_purchased * price_usd) AS DECIMAL(18,2)) AS sales
  FROM website_orders GROUP BY ALL
)"""


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} END"


def _half_up(num: str, den: str) -> str:
    """A quotient of non-negative integers rounded to two places, exactly."""
    return f"CASE WHEN {den} > 0 THEN CAST((CAST({num} AS HUGEINT) * 200 + {den}) // (2 * {den}) AS DOUBLE) / 100.0 END"


def _names(singular: bool, *plural: str) -> list[str]:
    return [n.removesuffix("s") if singular else n for n in plural]


def _weekly_body(window, dims: str = "", segment: bool = False, extra: str = "") -> str:
    keep = f" AND {SEG}" if segment else ""
    return f"""SELECT CAST(created_at AS DATE) - CAST(isodow(created_at) - 1 AS INTEGER) AS weekly_date,
       {dims + ', ' if dims else ''}count(website_session_id) AS total_traffic{extra}
FROM website_sessions
WHERE {window.sql('created_at')}{keep}
GROUP BY ALL"""


def _top(dims: str, segment: bool) -> str:
    keep = f" AND {SEG}" if segment else ""
    return _sql(f"SELECT {dims}, count(*) AS total_traffic FROM website_sessions WHERE {W.sql('created_at')}{keep} GROUP BY ALL")


def _conversion(window, dims: str, segment: bool, singular: bool = False) -> str:
    sessions, orders = _names(singular, "total_sessions", "total_orders")
    keep = f" AND {SEG}" if segment else ""
    return f"""SELECT {dims}, n AS {sessions}, n_bought AS {orders}, {_share('n_bought', 'n')} AS conversion_rate,
       CAST(sales AS DECIMAL(18,2)) AS total_sales
FROM (SELECT {dims}, count(website_session_id) AS n, CAST(count_if(bought) AS BIGINT) AS n_bought, sum(sale) AS sales
      FROM legs WHERE {window.sql('created_at')}{keep} GROUP BY ALL)"""


def _bounce(window, singular: bool = False) -> str:
    sessions, bounces = _names(singular, "total_sessions", "total_bounces")
    return _sql(
        f"""SELECT landed AS {sessions}, bounced AS {bounces}, {_share('bounced', 'landed')} AS bounce_rate
FROM (SELECT CAST(coalesce(sum(len(list_filter(doors, lambda d: d = '/home'))), 0) AS BIGINT) AS landed,
             CAST(count_if(n_views = 1 AND doors[1] = '/home') AS BIGINT) AS bounced
      FROM visits)""",
        _visits(window, IN_SEGMENT),
    )


VARIANTS = "[" + ", ".join(f"'{p}'" for p in AB_PAGES) + "]"

AB_BOUNCE = _sql(
    f"""SELECT page AS pageview_url, landed AS total_session, bounced AS total_bounce, {_share('bounced', 'landed')} AS bounce_rate
FROM (SELECT page, CAST(sum(len(list_filter(doors, lambda d: d = page))) AS BIGINT) AS landed,
             CAST(count_if(n_views = 1 AND doors[1] = page) AS BIGINT) AS bounced
      FROM visits JOIN (SELECT unnest({VARIANTS}) AS page) ON list_contains(list_transform(trail, lambda v: v.url), page)
      GROUP BY ALL)""",
    _visits(W_AB, IN_SEGMENT),
)

# Sales are summed over every tied landing view of the session before they are attached to each of them.
AB_CONVERSION = _sql(
    f"""SELECT page AS pageview_url, n AS total_session, n_bought AS total_order, {_share('n_bought', 'n')} AS conversion_rate,
       CAST(sales AS DECIMAL(18,2)) AS total_sales
FROM (SELECT page, count(*) AS n, count(b.website_session_id) AS n_bought, sum(b.sales * CAST(len(pages) AS INTEGER)) AS sales
      FROM (SELECT website_session_id, pages, unnest(pages) AS page
            FROM (SELECT website_session_id, list_filter(doors, lambda d: list_contains({VARIANTS}, d)) AS pages FROM visits))
           LEFT JOIN baskets AS b USING (website_session_id)
      GROUP BY ALL)""",
    _visits(W_AB, IN_SEGMENT),
    BASKETS,
)

LANDING_PAGES = _sql(
    f"""SELECT door AS pageview_url, count(*) AS total_landing_traffic
FROM (SELECT unnest(doors) AS door
      FROM visits JOIN website_sessions AS s USING (website_session_id)
      WHERE {W.sql('s.created_at')} AND s.is_repeat_session = 0)
GROUP BY ALL""",
    _visits(W, IN_SEGMENT),
)


def _funnel_report() -> str:
    reached, shown = [], []
    for k, (sessions, exit_rate) in enumerate(DEFAULT_FUNNEL_COLUMNS, start=1):
        reached.append(f"count(DISTINCT website_session_id) FILTER (step = {k}) AS at_{k}")
        shown.append(f"at_{k} AS {sessions}")
        if exit_rate:
            shown.append(f"1 - {_share(f'at_{k + 1}', f'at_{k}')} AS {exit_rate}")
    return _sql(
        f"SELECT {', '.join(shown)}\nFROM (SELECT {', '.join(reached)}\n      FROM chain_stops WHERE place = step)",
        _visits(W),
        STOPS,
        CHAIN_STOPS,
    )


FUNNEL_TABLE = _sql(
    """SELECT website_session_id, url AS pageview_url, CAST(step AS INTEGER) AS funnel_step, CAST(place AS INTEGER) AS user_page_step,
       CAST(CASE WHEN place = step THEN 1 END AS INTEGER) AS is_valid_step
FROM chain_stops""",
    _visits(W),
    STOPS,
    CHAIN_STOPS,
)

SUCCESSORS = _sql(
    """SELECT website_session_id, before.url AS from_url, to_url, CAST(before.step AS INTEGER) AS from_step,
       CAST(before.place AS INTEGER) AS from_rank
FROM (SELECT website_session_id, url AS to_url,
             unnest(list_filter(around, lambda b: b.place = place - 1 AND b.step = step - 1)) AS before
      FROM stops JOIN (SELECT website_session_id, list({'url': url, 'place': place, 'step': step}) AS around
                       FROM stops WHERE step IS NOT NULL GROUP BY ALL) USING (website_session_id)
      WHERE step IS NOT NULL)""",
    _visits(W),
    STOPS,
)

PEAK_TIME = _sql(
    f"""SELECT lower(dayname(created_at)) AS day, CAST((hour(created_at) + 23) % 24 + 1 AS INTEGER) AS hour,
       count(website_session_id) AS total_traffic
FROM website_sessions WHERE {W.sql('created_at')} GROUP BY ALL"""
)


def _scorecard(strict: bool) -> str:
    # The strict outlier filter keeps stays of more than a minute and less than a day.
    kept = "n_views <> 1" + (" AND micros > 60000000 AND micros < 86400000000" if strict else "")
    return _sql(
        f"""SELECT users AS total_user, repeaters AS repeat_user, n AS total_session, n - bounced AS active_session,
       bounced AS bounce_session, {_half_up('stay', '(CAST(n_stay AS HUGEINT) * 60000000)')} AS avg_session_duration,
       {_half_up('pages', 'n_pages')} AS avg_page_session, {_share('n_bought', 'n')} * 100 AS conversion_rate,
       CAST(sales AS DECIMAL(18,2)) AS total_sales, CAST(sales - costs AS DECIMAL(18,4)) AS total_revenue
FROM (SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (is_repeat_session = 1) AS repeaters,
             count(website_session_id) AS n, count(website_session_id) FILTER (n_views = 1) AS bounced,
             sum(micros) FILTER ({kept}) AS stay, count(micros) FILTER ({kept}) AS n_stay,
             sum(n_views) FILTER (n_views <> 1) AS pages, count(n_views) FILTER (n_views <> 1) AS n_pages,
             CAST(count_if(bought) AS BIGINT) AS n_bought, sum(sale) AS sales, sum(cost) AS costs
      FROM legs LEFT JOIN visits USING (website_session_id)
      WHERE {W.sql('legs.created_at')})""",
        _visits(W),
        LEGS,
    )


MASTER_TABLE = _sql(
    f"""SELECT user_id, website_session_id, created_at, is_repeat_session, utm_source, utm_campaign, device_type,
       CASE n_views WHEN 1 THEN 'bounce_session' ELSE 'active_session' END AS is_bounce,
       door AS landing_page,
       CASE WHEN bought THEN 'convert' ELSE 'not_convert' END AS is_convert,
       CASE WHEN n_views <> 1 THEN CAST((micros + 300000) // 600000 AS DOUBLE) / 100.0 END AS session_duration,
       CASE WHEN n_views <> 1 THEN n_views END AS session_total_page
FROM legs LEFT JOIN (SELECT website_session_id, n_views, micros, unnest(doors) AS door FROM visits) USING (website_session_id)
WHERE {W.sql('created_at')}""",
    _visits(W),
    LEGS,
)

SESSION_COLS = [
    "website_session_id",
    "created_at",
    "user_id",
    "is_repeat_session",
    "utm_source",
    "utm_campaign",
    "utm_content",
    "device_type",
    "http_referer",
]
PAGEVIEW_COLS = ["website_pageview_id", "created_at", "website_session_id", "pageview_url"]
ORDER_COLS = ["website_session_id", "items_purchased", "price_usd", "cogs_usd"]


def _null_profile(table: str, cols: list[str]) -> str:
    arms = "\nUNION ALL\n".join(
        f"SELECT CAST({i} AS INTEGER) AS column_index, '{c}' AS column_name, count(*) - count({c}) AS null_count FROM {table}"
        for i, c in enumerate(cols)
    )
    return _sql(arms)


def _duplicates(table: str, cols: list[str]) -> str:
    c = ", ".join(cols)
    return _sql(
        f"""SELECT {c} FROM (SELECT {c}, unnest(range(n - 1)) AS copy
                 FROM (SELECT {c}, count(*) AS n FROM {table} GROUP BY ALL) AS whole WHERE n > 1)"""
    )


RANGE_JOIN_STEPS = _sql(
    f"""SELECT c.website_session_id, CAST(c.step AS INTEGER) AS funnel_step, v.website_pageview_id
FROM chain_stops AS c JOIN website_pageviews AS v
     ON v.website_session_id = c.website_session_id AND {W.sql('v.created_at')}
WHERE c.place = c.step""",
    _visits(W),
    STOPS,
    CHAIN_STOPS,
)

RANGE_JOIN_FIRST_HOUR = _sql(
    f"""SELECT s.website_session_id, s.created_at AS started_at, v.website_pageview_id, v.created_at, v.pageview_url
FROM website_sessions AS s JOIN website_pageviews AS v
     ON v.website_session_id = s.website_session_id AND v.created_at BETWEEN s.created_at AND s.created_at + INTERVAL 1 HOUR
WHERE {W_AB.sql('s.created_at')} AND {SEG}"""
)


def _quality_summary() -> str:
    def row(name: str, table: str, cols: list[str], raw: str) -> str:
        c = ", ".join(cols)
        nulls = "CAST((SELECT " + " + ".join(f"count(*) - count({x})" for x in cols) + " FROM {}) AS BIGINT)"
        return f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM {table}) AS total_rows, n AS distinct_rows,
       (SELECT count(*) FROM {table}) - n AS duplicate_rows, {nulls.format(raw)} AS nulls_before, {nulls.format(table)} AS nulls_after
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT {c} FROM {table}))"""

    parts = (
        row("sessions", "website_sessions", SESSION_COLS, "unfilled_sessions"),
        row("pageviews", "website_pageviews", PAGEVIEW_COLS, "website_pageviews"),
        row("orders", "website_orders", ORDER_COLS, "website_orders"),
    )
    # The sessions before the fill, repeated like the filled ones.
    unfilled = f"""unfilled_sessions AS (
  SELECT r.{', r.'.join(SESSION_COLS)} FROM raw_sessions AS r JOIN website_sessions AS s USING (website_session_id)
)"""
    return _sql("\nUNION ALL\n".join(parts), unfilled)


def oracle_sql() -> dict[str, str]:
    pv = ", ".join(PAGEVIEW_COLS)
    first_seen = "min(created_at) FILTER (is_repeat_session = 0)"
    source, device = "utm_source, utm_campaign", "device_type"
    found = {
        "weekly_traffic": _sql(_weekly_body(W)),
        "weekly_traffic_by_source": _sql(_weekly_body(W, source)),
        "weekly_traffic_by_device": _sql(_weekly_body(W, device, segment=True)),
        "top_sources": _top(source, False),
        "device_split": _top(device, True),
        "conversion_by_source": _sql(_conversion(W, source, False), LEGS),
        "conversion_by_device": _sql(_conversion(W, device, True), LEGS),
        "conversion_segment_update": _sql(_conversion(W_UPDATE, source, True, singular=True), LEGS),
        "landing_pages": LANDING_PAGES,
        "bounce_rate": _bounce(W),
        "bounce_rate_update": _bounce(W_UPDATE, singular=True),
        "weekly_traffic_update": _sql(_weekly_body(W_UPDATE_WEEKS)),
        "ab_bounce": AB_BOUNCE,
        "ab_conversion": AB_CONVERSION,
        "funnel_report": _funnel_report(),
        "peak_time": PEAK_TIME,
        "scorecard": _scorecard(strict=False),
        "scorecard_strict_outliers": _scorecard(strict=True),
        "master_table": MASTER_TABLE,
        "funnel_table": FUNNEL_TABLE,
        "null_profile_sessions": _null_profile("raw_sessions", SESSION_COLS),
        "null_profile_pageviews": _null_profile("website_pageviews", PAGEVIEW_COLS),
        "null_profile_orders": _null_profile("website_orders", ORDER_COLS),
        "null_rows": _sql("SELECT * FROM raw_sessions WHERE utm_source IS NULL"),
        "null_rows_head": _sql("SELECT * FROM raw_sessions WHERE utm_source IS NULL ORDER BY website_session_id LIMIT 5"),
        "fill_nulls": _sql("SELECT * FROM website_sessions"),
        "null_recheck": _null_profile("website_sessions", SESSION_COLS),
        "quality_summary": _quality_summary(),
        "duplicate_rows_sessions": _duplicates("website_sessions", SESSION_COLS),
        "duplicate_rows_pageviews": _duplicates("website_pageviews", PAGEVIEW_COLS),
        "duplicate_rows_orders": _duplicates("website_orders", ORDER_COLS),
        "csv_roundtrip": _sql("SELECT * FROM website_sessions"),
        "csv_inferred": _sql(
            """SELECT website_session_id, CAST(items_purchased AS BIGINT) AS items_purchased, CAST(price_usd AS DOUBLE) AS price_usd,
       CAST(cogs_usd AS DOUBLE) AS cogs_usd,
       CASE WHEN website_session_id % 100 = 7 THEN 'gift' ELSE CAST(items_purchased AS VARCHAR) END AS note,
       CASE WHEN website_session_id % 3 <> 0 THEN CAST(items_purchased AS DOUBLE) END AS discount,
       website_session_id % 2 = 0 AS is_gift, CASE WHEN website_session_id % 2 = 0 THEN 15.0::DOUBLE ELSE 7.0::DOUBLE END AS weight,
       CAST(NULL AS DOUBLE) AS coupon
FROM website_orders"""
        ),
        "page_rank": _sql(
            """SELECT website_session_id, pid AS website_pageview_id, url AS pageview_url, CAST(place AS INTEGER) AS rank_page
FROM stops""",
            _visits(W),
            STOPS,
        ),
        "session_landing_page": _sql("SELECT website_session_id, unnest(doors) AS landing_page FROM visits", _visits(W)),
        "bounce_sessions": _sql("SELECT website_session_id FROM visits WHERE n_views = 1", _visits(W)),
        "session_duration": _sql(
            "SELECT website_session_id, CAST(micros AS DOUBLE) / 60000000.0 AS duration FROM visits WHERE n_views <> 1", _visits(W)
        ),
        "pages_per_session": _sql("SELECT website_session_id, n_views AS total_page FROM visits WHERE n_views <> 1", _visits(W)),
        "user_first_visit": _sql(
            f"""SELECT user_id, {first_seen} AS start_date
FROM website_sessions WHERE {W.sql('created_at')} GROUP BY ALL HAVING count_if(is_repeat_session = 0) > 0"""
        ),
        "first_visit_join": _sql(
            f"""SELECT website_session_id, user_id, created_at,
       CAST(coalesce(user_id IS NOT NULL AND created_at = {first_seen} OVER (PARTITION BY user_id), FALSE) AS INTEGER) AS is_first_visit
FROM website_sessions WHERE {W.sql('created_at')}"""
        ),
        "semi_join_segment": _sql(
            f"SELECT {pv} FROM website_pageviews WHERE {W.sql('created_at')} AND website_session_id IN {IN_SEGMENT}"
        ),
        "anti_join_active": _sql(
            f"""SELECT {pv} FROM website_pageviews WHERE {W.sql('created_at')}
QUALIFY count(website_pageview_id) OVER (PARTITION BY website_session_id) <> 1"""
        ),
        "anti_join_left_null": _sql(
            f"""SELECT website_session_id, user_id, created_at
FROM website_sessions ANTI JOIN (FROM website_pageviews WHERE {W_AB.sql('created_at')}) USING (website_session_id)
WHERE {W.sql('created_at')}"""
        ),
        "successor_join": SUCCESSORS,
        "range_join_steps": RANGE_JOIN_STEPS,
        "range_join_first_hour": RANGE_JOIN_FIRST_HOUR,
        "distinct_users": _sql(
            f"""SELECT count(*) AS total_user, CAST(count_if(repeats) AS BIGINT) AS repeat_user
FROM (SELECT user_id, bool_or(is_repeat_session = 1) AS repeats
      FROM website_sessions WHERE {W.sql('created_at')} AND user_id IS NOT NULL GROUP BY ALL)"""
        ),
        "conditional_distinct": _sql(
            """SELECT step AS funnel_step, count(*) AS sessions
FROM (SELECT DISTINCT website_session_id, step FROM stops WHERE step IS NOT NULL) GROUP BY ALL""",
            _visits(W),
            STOPS,
        ),
        "union_all": _sql(
            _weekly_body(W, extra=", 'launch' AS period") + "\nUNION ALL\n" + _weekly_body(W_UPDATE_WEEKS, extra=", 'update' AS period")
        ),
        "desc_nulls_first_sort": _sql(
            """SELECT *, CAST(row_number() OVER (ORDER BY total_sales DESC NULLS FIRST, utm_source ASC NULLS LAST,
                                         utm_campaign ASC NULLS LAST) AS INTEGER) AS sort_rank
FROM rates""",
            LEGS,
            f"rates AS ({_conversion(W, source, False)})",
        ),
        "mart_roundtrip": MASTER_TABLE,
        "master_mart": MASTER_TABLE,
        "funnel_mart": FUNNEL_TABLE,
        "numbered_sessions": _sql(
            """SELECT utm_source, created_at, website_session_id,
       row_number() OVER (ORDER BY utm_source DESC NULLS FIRST, created_at ASC NULLS LAST, website_session_id ASC NULLS LAST) AS row_number
FROM website_sessions"""
        ),
    }
    return found | {f"{name}_repeated": over_repeated(found[name]) for name in REPEATED_QUERIES}
