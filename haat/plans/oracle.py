"""DuckDB oracle SQL for the registered queries.

The driver registers the Parquet tables as views; every statement below
rebuilds the same logical ``tx`` table from them and recomputes the query
independently of Spark.  Column names and types match the Spark results.
"""

from __future__ import annotations

from haat.functions import labels as L
from haat.plans import registry as Q


def R(expr: str, n: int = 2) -> str:
    """Half-up rounding through DECIMAL(38, n+4), as ``numeric.rnd``."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,{n + 4})), {n}) AS DOUBLE)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


TX = """tx AS (
  SELECT l.l_orderkey AS transaction_id, o.o_orderdate AS order_ts,
         CAST(o.o_orderdate AS DATE) AS dt, p.p_type AS product, p.p_type AS category,
         p.p_brand AS brand, p.p_name AS product_name, CAST(l.l_quantity AS INTEGER) AS quantity,
         l.l_extendedprice / NULLIF(l.l_quantity, 0) AS price,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS total_amount, o.o_custkey AS user_id,
         l.l_discount > 0 AS discount_applied
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""
AO = """ao AS (SELECT CAST(max(o_orderdate) AS DATE) AS as_of FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""

LAST = "(dt > as_of - 30 AND dt <= as_of)"
PREV = "(dt > as_of - 60 AND dt <= as_of - 30)"


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def pct(c: str, p: str) -> str:
    return (f"(CASE WHEN CAST({p} AS DOUBLE) > 0 THEN (CAST({c} AS DOUBLE) - CAST({p} AS DOUBLE))"
            f" / CAST({p} AS DOUBLE) * 100.0 ELSE 0.0 END)")


def div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


PP = f"""pp AS (SELECT product, SUM(total_amount) AS total, COUNT(*) AS n_rows,
  SUM(CASE WHEN {LAST} THEN total_amount END) AS last_sum,
  COUNT(CASE WHEN {LAST} THEN 1 END) AS last_n,
  SUM(CASE WHEN {PREV} THEN total_amount END) AS prev_sum,
  COUNT(CASE WHEN {PREV} THEN 1 END) AS prev_n,
  SUM(CASE WHEN dt = as_of THEN total_amount END) AS today_sum,
  SUM(CASE WHEN dt >= date_trunc('week', as_of) AND dt <= as_of THEN total_amount END) AS week_sum,
  SUM(CASE WHEN dt >= date_trunc('month', as_of) AND dt <= as_of THEN total_amount END) AS month_sum
  FROM tx, ao GROUP BY product)"""

PG = f"""pg AS (SELECT product, CAST(COALESCE(last_sum, 0) AS DOUBLE) AS last30_revenue,
  CAST(COALESCE(prev_sum, 0) AS DOUBLE) AS prev30_revenue,
  CASE WHEN COALESCE(prev_sum, 0) > 0 THEN {R(pct('COALESCE(last_sum, 0)', 'COALESCE(prev_sum, 0)'))} END AS growth_pct
  FROM pp)"""

TREND = """trend AS (SELECT name, growth FROM (
    SELECT product AS name, growth_pct AS growth, 0 AS fb FROM pg WHERE growth_pct IS NOT NULL
    UNION ALL SELECT 'N/A', 0.0, 1) t ORDER BY fb, growth DESC, name LIMIT 1)"""

WEEKDAY = "CAST(isodow(dt) - 1 AS INTEGER)"


def _in(values) -> str:
    return ", ".join(lit(v) for v in values)


SQL: dict[str, str] = {}

SQL["top_products"] = W(TX) + """SELECT product, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM tx GROUP BY product ORDER BY revenue DESC, product LIMIT 5"""

SQL["revenue_by_product"] = W(TX) + """SELECT product, CAST(SUM(total_amount) AS DOUBLE) AS revenue,
COUNT(*) AS n_rows FROM tx GROUP BY product"""

SQL["kpi_sheet"] = W(TX, AO, PP, PG, TREND, """tot AS (SELECT SUM(total) AS total,
  CAST(SUM(n_rows) AS BIGINT) AS n_rows, SUM(last_sum) AS last_sum, SUM(prev_sum) AS prev_sum,
  SUM(prev_n) AS prev_n, SUM(today_sum) AS today_sum, SUM(week_sum) AS week_sum,
  SUM(month_sum) AS month_sum FROM pp)""", """ords AS (SELECT COUNT(*) AS n_orders,
  COUNT(DISTINCT user_id) AS n_customers FROM (SELECT transaction_id, max(user_id) AS user_id
  FROM tx GROUP BY transaction_id) o)""") + f"""SELECT {R('CAST(total AS DOUBLE)')} AS total_revenue,
  {R(pct('COALESCE(last_sum, 0)', 'CASE WHEN prev_n = 0 THEN 1 ELSE prev_sum END'))} AS growth_rate,
  n_rows AS total_orders,
  {R(div('total', '(SELECT n_orders FROM ords)'))} AS avg_order_value,
  (SELECT n_customers FROM ords) AS unique_customers,
  {R('CAST(COALESCE(today_sum, 0) AS DOUBLE)')} AS today_revenue,
  {R('CAST(COALESCE(week_sum, 0) AS DOUBLE)')} AS week_revenue,
  {R('CAST(COALESCE(month_sum, 0) AS DOUBLE)')} AS month_revenue,
  (SELECT name FROM trend) AS trending_product, (SELECT growth FROM trend) AS trending_growth
FROM tot"""

SQL["period_growth"] = W(TX, AO, PP, PG) + "SELECT * FROM pg"

SQL["trending_product"] = W(TX, AO, PP, PG, TREND) + "SELECT * FROM trend"

SQL["weekday_pattern"] = W(TX) + f"""SELECT s.day_num, {arr(L.WEEKDAYS_EN)}[s.day_num + 1] AS day,
  CAST(COALESCE(a.rev, 0) AS DOUBLE) AS revenue
FROM (SELECT CAST(range AS INTEGER) AS day_num FROM range(7)) s
LEFT JOIN (SELECT {WEEKDAY} AS day_num, SUM(total_amount) AS rev FROM tx GROUP BY 1) a
  ON s.day_num = a.day_num"""

SQL["best_day"] = W(TX) + f"""SELECT day, revenue, day || {lit(L.TRENDS_ADVICE)} AS recommendation FROM (
  SELECT {arr(L.WEEKDAYS_EN)}[{WEEKDAY} + 1] AS day, CAST(SUM(total_amount) AS DOUBLE) AS revenue
  FROM tx GROUP BY 1) t ORDER BY revenue DESC, day LIMIT 1"""

SQL["monthly_revenue"] = W(TX) + """SELECT CAST(date_trunc('month', dt) AS DATE) AS month,
  CAST(SUM(total_amount) AS DOUBLE) AS revenue FROM tx GROUP BY 1"""

SQL["mom_growth"] = W(TX, """m AS (SELECT CAST(date_trunc('month', dt) AS DATE) AS month,
  SUM(total_amount) AS rev FROM tx GROUP BY 1 ORDER BY month DESC LIMIT 2)""", """a AS (
  SELECT COUNT(*) AS n, max(month) AS latest_month, arg_max(rev, month) AS latest,
         min(month) AS prev_month, arg_min(rev, month) AS prev FROM m)""") + f"""SELECT latest_month,
  CAST(latest AS DOUBLE) AS latest_revenue,
  CASE WHEN n >= 2 THEN prev_month END AS prev_month,
  CASE WHEN n >= 2 THEN CAST(prev AS DOUBLE) END AS prev_revenue,
  CASE WHEN n >= 2 THEN {R(pct('latest', 'prev'))} ELSE 0.0 END AS mom_growth FROM a"""

SQL["season_top"] = W(TX, """s AS (SELECT CASE WHEN month(dt) IN (3, 4, 5) THEN 'eid'
    WHEN month(dt) IN (11, 12, 1, 2) THEN 'winter' END AS season, product,
    CAST(SUM(total_amount) AS DOUBLE) AS revenue FROM tx
  WHERE month(dt) IN (3, 4, 5, 11, 12, 1, 2) GROUP BY 1, 2)""") + """SELECT season, rank, product, revenue FROM (
  SELECT season, CAST(row_number() OVER (PARTITION BY season ORDER BY revenue DESC, product) AS INTEGER) AS rank,
         product, revenue FROM s) t WHERE rank <= 3"""

SQL["peak_month"] = W(TX) + f"""SELECT month, {arr(L.MONTHS_BN_SEASON)}[month] AS name, revenue FROM (
  SELECT CAST(month(dt) AS INTEGER) AS month, CAST(SUM(total_amount) AS DOUBLE) AS revenue
  FROM tx GROUP BY 1) t ORDER BY revenue DESC, month LIMIT 1"""

SQL["upcoming_season"] = f"""SELECT as_of, CAST(month(as_of) AS INTEGER) AS month,
  CASE WHEN month(as_of) IN (2, 3) THEN {lit(L.SEASON_RAMADAN)}
       WHEN month(as_of) IN (3, 4) THEN {lit(L.SEASON_EID)}
       WHEN month(as_of) IN (10, 11) THEN {lit(L.SEASON_WINTER)}
       ELSE {lit(L.SEASON_NORMAL)} END AS upcoming_season
FROM (SELECT CAST(max(o_orderdate) AS DATE) AS as_of FROM orders) t"""

SQL["stock_alert"] = W(TX, AO, f"""per AS (SELECT product, CAST(SUM(q) AS BIGINT) AS total_sold_30d,
    COUNT(*) AS n_days FROM (SELECT product, dt, SUM(quantity) AS q FROM tx, ao
    WHERE {LAST} GROUP BY product, dt) d GROUP BY product)""", f"""s AS (SELECT product,
    {div('total_sold_30d', 'n_days')} AS avg, total_sold_30d FROM per)""", """k AS (SELECT product,
    100 AS current_stock, avg, total_sold_30d,
    CASE WHEN avg > 0 THEN CAST(trunc(100.0 / avg) AS INTEGER) ELSE 999 END AS days_until_stockout,
    CAST(trunc(avg * 7.0) AS INTEGER) AS reorder_point FROM s)""", """b AS (SELECT *,
    CASE WHEN days_until_stockout < 7 THEN 'critical' WHEN days_until_stockout < 14 THEN 'warning'
         ELSE 'ok' END AS status FROM k)""") + f"""SELECT product, current_stock, {R('avg')} AS daily_avg_sales,
  total_sold_30d, days_until_stockout, reorder_point, status,
  CASE WHEN status <> 'ok' THEN {lit(L.STOCK_ORDER_PREFIX)} || CAST(reorder_point AS VARCHAR) || {lit(L.STOCK_ORDER_SUFFIX)}
       ELSE {lit(L.STOCK_OK)} END AS recommendation,
  CASE WHEN status = 'critical' THEN {lit(L.BADGE_CRITICAL)} WHEN status = 'warning' THEN {lit(L.BADGE_WARNING)}
       ELSE {lit(L.BADGE_OK)} END AS badge
FROM b"""

RFM = """r AS (SELECT user_id, CAST(date_diff('day', max(dt), max(as_of)) AS INTEGER) AS recency,
  COUNT(*) AS frequency, SUM(total_amount) AS monetary_dec FROM tx, ao GROUP BY user_id)"""

SQL["rfm"] = W(TX, AO, RFM) + """SELECT user_id, recency, frequency, CAST(monetary_dec AS DOUBLE) AS monetary FROM r"""

SQL["top_customers"] = W(TX, AO, RFM) + """SELECT user_id AS customer_id, CAST(monetary_dec AS DOUBLE) AS total_spent,
  frequency AS orders FROM r ORDER BY total_spent DESC, customer_id LIMIT 5"""

SQL["customer_summary"] = W(TX, AO, RFM, """a AS (SELECT COUNT(*) AS total_customers,
  SUM(monetary_dec) AS spend, COUNT(*) FILTER (WHERE recency > 60) AS at_risk_customers FROM r)""") + f"""
SELECT total_customers, {R(div('spend', 'total_customers'))} AS avg_ltv, at_risk_customers,
  CAST(at_risk_customers AS VARCHAR) || {lit(L.CUSTOMERS_ADVICE)} AS recommendation FROM a"""

PROFIT = """pr AS (SELECT product, SUM(total_amount) AS rev, SUM(total_amount * 0.70) AS cost_dec,
  CAST(SUM(quantity) AS BIGINT) AS quantity FROM tx GROUP BY product)"""
PROFIT_ROWS = f"""pb AS (SELECT product, CAST(rev AS DOUBLE) AS revenue, CAST(cost_dec AS DOUBLE) AS cost,
  CAST(rev - cost_dec AS DOUBLE) AS profit, quantity,
  {R(div('rev - cost_dec', 'rev') + ' * 100.0')} AS margin FROM pr)"""

SQL["profit_by_product"] = W(TX, PROFIT, PROFIT_ROWS) + "SELECT * FROM pb"

SQL["top_profitable"] = W(TX, PROFIT, PROFIT_ROWS) + "SELECT * FROM pb ORDER BY profit DESC, product LIMIT 5"

SQL["profit_summary"] = W(TX, PROFIT, PROFIT_ROWS, """best AS (SELECT product, margin FROM pb
  ORDER BY margin DESC, product LIMIT 1)""", """tot AS (SELECT SUM(total_amount) AS rev,
  SUM(total_amount * 0.70) AS cost_dec FROM tx)""") + f"""SELECT {R('CAST(rev - cost_dec AS DOUBLE)')} AS total_profit,
  {R(div('rev - cost_dec', 'rev') + ' * 100.0')} AS profit_margin,
  (SELECT product FROM best) AS best_margin_product, (SELECT margin FROM best) AS best_margin,
  (SELECT product FROM best) || {lit(L.PROFIT_ADVICE)} AS recommendation FROM tot"""

BEST_CAMPAIGN = f"""bc AS (SELECT day_num, {arr(L.WEEKDAYS_BN)}[day_num + 1] AS day_name,
  {R('mean_raw')} AS mean_revenue FROM (SELECT {WEEKDAY} AS day_num,
  {div('SUM(total_amount)', 'COUNT(*)')} AS mean_raw FROM tx GROUP BY 1) t
  ORDER BY mean_raw DESC, day_num LIMIT 1)"""

SQL["best_campaign_day"] = W(TX, BEST_CAMPAIGN) + "SELECT * FROM bc"

DECLINING = f"""dc AS (SELECT product, decline FROM (
  SELECT product, r, o, {R('CASE WHEN o > 0 THEN (o - r) / o * 100.0 ELSE 0.0 END')} AS decline FROM (
    SELECT product, CAST(COALESCE(SUM(CASE WHEN {LAST} THEN total_amount END), 0) AS DOUBLE) AS r,
      CAST(CASE WHEN COUNT(CASE WHEN {PREV} THEN 1 END) = 0 THEN 1
           ELSE SUM(CASE WHEN {PREV} THEN total_amount END) END AS DOUBLE) AS o
    FROM tx, ao GROUP BY product) a WHERE r < o) b ORDER BY decline DESC, product LIMIT 3)"""

SQL["declining_products"] = W(TX, AO, DECLINING) + "SELECT * FROM dc"

SQL["campaign_plan"] = W(TX, AO, BEST_CAMPAIGN, DECLINING, """names AS (SELECT
  COALESCE(list(product ORDER BY decline DESC, product), CAST([] AS VARCHAR[])) AS c FROM dc)""") + f"""SELECT day_name AS best_campaign_day,
  (SELECT c FROM names) AS discount_recommendations, {lit(L.RECOMMENDED_DISCOUNT)} AS recommended_discount,
  day_name || {lit(L.CAMPAIGN_ADVICE_1)} || array_to_string((SELECT c FROM names)[1:2], ', ')
    || {lit(L.CAMPAIGN_ADVICE_2)} AS recommendation FROM bc"""

_CMP = _in(p.strip() for p in Q.COMPARE_PRODUCTS.split(","))

SQL["compare_products"] = W(TX) + f"""SELECT product, total_sales, {R(div('p_sum', 'transaction_count'))} AS avg_price,
  transaction_count, {R(div('total_sales', 'transaction_count'))} AS avg_quantity FROM (
  SELECT product, CAST(SUM(quantity) AS BIGINT) AS total_sales, SUM(price) AS p_sum,
         COUNT(*) AS transaction_count FROM tx WHERE product IN ({_CMP}) GROUP BY product) t"""

SQL["comparison_stats"] = W(TX) + f"""SELECT product, CAST(SUM(quantity) AS BIGINT) AS qty_sum,
  {R('avg(quantity)')} AS qty_mean, {R('stddev_samp(quantity)')} AS qty_std,
  {R('avg(price)')} AS price_mean, {R('stddev_samp(price)')} AS price_std
FROM tx WHERE product IN ({_CMP}) GROUP BY product"""

SQL["export_summary"] = W(TX) + f"""SELECT product, CAST(SUM(quantity) AS BIGINT) AS qty_sum,
  {R('avg(quantity)')} AS qty_mean, COUNT(quantity) AS qty_count, {R('avg(price)')} AS price_mean,
  {R('min(price)')} AS price_min, {R('max(price)')} AS price_max FROM tx GROUP BY product"""

SQL["export_daily"] = W(TX) + f"""SELECT dt, product, CAST(SUM(quantity) AS BIGINT) AS quantity,
  {R('avg(price)')} AS price FROM tx GROUP BY dt, product"""

SQL["sales_range"] = W(TX) + f"""SELECT transaction_id, dt, product, product_name, quantity,
  {R('price')} AS price, CAST(total_amount AS DOUBLE) AS total_amount, user_id, discount_applied
FROM tx WHERE dt >= DATE '{Q.RANGE_START}' AND dt <= DATE '{Q.RANGE_END}'"""


# --- sentiment, interest and text ---------------------------------------------------
from haat.functions import text as TXT  # noqa: E402

SENT = """sent AS (SELECT CAST(ts AS DATE) AS date, event_type AS product,
  greatest(CAST(0.35 AS DOUBLE), least(CAST(0.95 AS DOUBLE), value / 100.0)) AS sentiment FROM events)"""

SQL["sentiment_mean"] = W(SENT) + f"""SELECT product, {R('avg(sentiment)', 4)} AS sentiment,
  COUNT(*) AS n FROM sent GROUP BY product"""

SQL["sentiment_series"] = W(SENT) + f"""SELECT product, date,
  CAST(row_number() OVER (PARTITION BY product ORDER BY date) AS INTEGER) AS seq,
  {R('s', 4)} AS sentiment FROM (SELECT product, date, avg(sentiment) AS s FROM sent GROUP BY 1, 2) t"""

WEEKLY = """wk AS (SELECT product, CAST(date_trunc('week', date) AS DATE) + 6 AS week,
    avg(sentiment) AS s, COUNT(*) AS n FROM sent GROUP BY 1, 2)""", """sp AS (SELECT product,
    CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week
    FROM (SELECT product, min(week) AS lo, max(week) AS hi FROM wk GROUP BY product) t)"""
WEEKLY_SELECT = f"""SELECT sp.week, sp.product, {R('s', 4)} AS sentiment, COALESCE(n, 0) AS n_scores
FROM sp LEFT JOIN wk ON sp.product = wk.product AND sp.week = wk.week"""

SQL["social_weekly"] = W(SENT, *WEEKLY) + WEEKLY_SELECT
SQL["append_dedup"] = SQL["social_weekly"]

# Words and values stated here again, on purpose.
LEXICON = {
    "amazing": 2.8, "awesome": 3.1, "best": 3.2, "better": 1.9, "comfy": 1.5, "durable": 1.2,
    "educational": 1.2, "excellent": 2.7, "fast": 1.0, "fresh": 1.3, "good": 1.9,
    "great": 3.1, "happy": 2.7, "helpful": 1.8, "love": 3.2, "lovely": 2.8, "nice": 1.8,
    "perfect": 2.7, "recommended": 1.5, "safe": 1.9, "useful": 1.9, "value": 1.4,
    "wonderful": 2.7, "affordable": 1.3, "fine": 0.8, "glad": 2.0, "like": 1.5,
    "bad": -2.5, "broken": -2.0, "cheap": -0.8, "damaged": -2.2, "disappointed": -2.3,
    "fake": -2.2, "hate": -2.7, "late": -1.1, "poor": -2.1, "problem": -1.7, "refund": -1.0,
    "slow": -1.3, "terrible": -2.9, "useless": -2.4, "waste": -2.2, "worst": -3.1,
    "wrong": -2.1, "awful": -2.9, "sad": -2.1, "angry": -2.3, "error": -1.5,
}
DOCUMENT_WORDS = {"the": 0.5, "and": -0.2, "that": -0.9, "der": 0.4, "und": -0.3, "de": 0.2, "la": -0.6,
                  "les": 0.3, "que": -0.1, "el": 0.7}


def _lexicon_sql(words: dict) -> str:
    values = ", ".join(f"({lit(w)}, CAST({v!r} AS DOUBLE))" for w, v in words.items())
    return W(
        f"lex AS (SELECT * FROM (VALUES {values}) t(word, valence))",
        r"""tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}]+'),
      lambda t: t <> '')) AS word FROM documents)""",
        """agg AS (SELECT tok.doc_id, COUNT(*) AS n_tokens, COUNT(lex.valence) AS n_hits,
      SUM(lex.valence) AS s FROM tok LEFT JOIN lex ON tok.word = lex.word GROUP BY tok.doc_id)""",
        """a2 AS (SELECT d.doc_id, COALESCE(n_tokens, 0) AS n_tokens, COALESCE(n_hits, 0) AS n_hits,
      COALESCE(s, 0.0) AS s FROM documents d LEFT JOIN agg ON d.doc_id = agg.doc_id)""") + f"""
SELECT doc_id, n_tokens, n_hits, {R('s', 4)} AS score, {R('s / sqrt(s * s + 15.0)', 4)} AS compound,
  {R('greatest(CAST(0.35 AS DOUBLE), least(CAST(0.95 AS DOUBLE), s / sqrt(s * s + 15.0)))', 4)} AS sentiment
FROM a2"""


SQL["lexicon_sentiment"] = _lexicon_sql(LEXICON)
SQL["lexicon_documents"] = _lexicon_sql(DOCUMENT_WORDS)

SQL["interest_index"] = f"""SELECT product, date, n_events,
  {R(div('n_events * 100', 'peak'))} AS interest FROM (
  SELECT event_type AS product, CAST(ts AS DATE) AS date, COUNT(*) AS n_events,
         max(COUNT(*)) OVER (PARTITION BY event_type) AS peak FROM events GROUP BY 1, 2) t"""

_WS = TXT.char_class(TXT.WHITESPACE, java=False)
_NWS = TXT.char_class(TXT.WHITESPACE, java=False, negate=True)
_LB = TXT.line_break_regex(java=False)
SQL["answer_cleanup"] = f"""SELECT conv_id, turn, role,
  CASE WHEN text IS NULL OR text = '' THEN ''
       WHEN length(body) < 40 THEN body || {lit(L.SHORT_ANSWER_HINT)} ELSE body END AS cleaned
FROM (SELECT *, regexp_replace(array_to_string(list_transform(list_filter(
    string_split_regex(text, {lit(_LB)}), lambda l: regexp_matches(l, {lit(_NWS)})),
    lambda l: regexp_replace(l, {lit(_WS + '+\\z')}, '')), chr(10)), {lit('\\A' + _WS + '+')}, '') AS body
  FROM conversations) t"""

SQL["bengali_flag"] = f"""SELECT doc_id, lang, regexp_matches(text, {lit(TXT.bengali_regex(java=False))}) AS is_bengali
FROM documents"""

SQL["json_coalesce"] = "SELECT event_id, json_extract_string(props, '$.k') AS reply FROM events"

SQL["reply_shapes"] = "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 <> 1 THEN text END AS reply FROM conversations"

SQL["bengali_mixed"] = "SELECT doc_id, lang, doc_id % 5 = 0 AS is_bengali FROM documents"

SQL["date_labels"] = f"""SELECT dt, dayname(dt) AS weekday,
  concat_ws(' ', {arr(L.WEEKDAYS_EN)}[isodow(dt)], CAST(day(dt) AS VARCHAR), {arr(L.MONTHS_EN)}[month(dt)],
            CAST(year(dt) AS VARCHAR)) AS label_en,
  concat_ws(' ', {arr(L.WEEKDAYS_BN)}[isodow(dt)], CAST(day(dt) AS VARCHAR), {arr(L.MONTHS_BN)}[month(dt)],
            CAST(year(dt) AS VARCHAR)) AS label_bn
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders) t"""

# --- forecast -----------------------------------------------------------------------
T_EXPR = "CAST(date_diff('day', DATE '2000-01-01', {d}) AS DOUBLE)"


def _fc_ctes(grain: str) -> list[str]:
    if grain == "day":
        obs = f"""obs AS (SELECT product, dt, CAST(SUM(quantity) AS DOUBLE) AS y, COUNT(*) AS n_rows,
    {T_EXPR.format(d='dt')} AS t FROM tx GROUP BY product, dt)"""
    else:
        obs = f"""obs AS (SELECT product, dt, CAST(quantity AS DOUBLE) AS y, 1 AS n_rows,
    {T_EXPR.format(d='dt')} AS t FROM tx)"""
    return [TX, obs,
            """tr AS (SELECT product, regr_slope(y, t) AS b, regr_intercept(y, t) AS a,
    SUM(n_rows) AS n_rows, max(dt) AS last_dt FROM obs GROUP BY product HAVING SUM(n_rows) >= 10)""",
            """r1 AS (SELECT o.product, o.dt, o.y - (tr.a + tr.b * o.t) AS r1,
    CAST(isodow(o.dt) - 1 AS INTEGER) AS wd, CAST(month(o.dt) AS INTEGER) AS mo
    FROM obs o JOIN tr ON o.product = tr.product)""",
            "wk AS (SELECT product, wd, avg(r1) AS w FROM r1 GROUP BY 1, 2)",
            """r2 AS (SELECT r1.product, r1.dt, r1.mo, r1.r1 - wk.w AS r2 FROM r1
    JOIN wk ON r1.product = wk.product AND r1.wd = wk.wd)""",
            "mo AS (SELECT product, mo, avg(r2) AS m FROM r2 GROUP BY 1, 2)",
            """r3 AS (SELECT r2.product, r2.dt, r2.r2 - mo.m AS r3 FROM r2
    JOIN mo ON r2.product = mo.product AND r2.mo = mo.mo)""",
            "sg AS (SELECT product, stddev_samp(r3) AS sigma FROM r3 GROUP BY product)",
            """fut AS (SELECT product, a, b, CAST(last_dt + CAST(h AS INTEGER) AS DATE) AS ds
    FROM tr, range(1, 31) r(h))""",
            f"""fc AS (SELECT f.product, f.ds, f.a + f.b * {T_EXPR.format(d='f.ds')}
      + COALESCE(wk.w, 0.0) + COALESCE(mo.m, 0.0) AS yhat, 1.2816 * COALESCE(sg.sigma, 0.0) AS band
    FROM fut f LEFT JOIN wk ON wk.product = f.product AND wk.wd = CAST(isodow(f.ds) - 1 AS INTEGER)
    LEFT JOIN mo ON mo.product = f.product AND mo.mo = CAST(month(f.ds) AS INTEGER)
    LEFT JOIN sg ON sg.product = f.product)"""]


FC_SELECT = f"""SELECT product, ds, {R('yhat')} AS yhat, {R('yhat - band')} AS yhat_lower,
  {R('yhat + band')} AS yhat_upper FROM fc"""
SQL["forecast_daily"] = W(*_fc_ctes("day")) + FC_SELECT
SQL["forecast_row_grain"] = W(*_fc_ctes("row")) + FC_SELECT
SQL["forecast_mean"] = W(*_fc_ctes("day")) + f"""SELECT product, {R('avg(yhat)')} AS mean_yhat,
  COUNT(*) AS horizon FROM fc GROUP BY product"""
SQL["error_by_group"] = W(*_fc_ctes("day"), """per AS (SELECT product AS "group", SUM(abs(r3)) AS abs_sum,
  COUNT(*) AS n FROM r3 GROUP BY product)""", """both_ AS (SELECT * FROM per UNION ALL
  SELECT '__overall__', SUM(abs_sum), CAST(SUM(n) AS BIGINT) FROM per)""") + f"""SELECT "group", n,
  {R('abs_sum / n', 4)} AS mae FROM both_"""

# --- pricing ---------------------------------------------------------------------------
CP = f"cp AS (SELECT product, {div('SUM(price)', 'COUNT(*)')} AS current_raw FROM tx GROUP BY product)"
DAILY_PQ = """d AS (SELECT product, dt, CAST(SUM(quantity) AS DOUBLE) AS q, SUM(price) / COUNT(*) AS p
  FROM tx GROUP BY product, dt)"""
ACT = "CAST(a AS INTEGER) AS action, (1.0 + CAST(a AS DOUBLE) / 10.0) AS f"

SQL["price_parity"] = W(TX, CP, f"""g AS (SELECT product, current_raw, {ACT} FROM cp, range(-5, 6) r(a))""",
                        """g2 AS (SELECT *, current_raw * f AS new_raw FROM g)""",
                        """g3 AS (SELECT *, row_number() OVER (PARTITION BY product
    ORDER BY -abs(new_raw - current_raw) DESC, abs(action), action) AS rn FROM g2)""") + f"""
SELECT product, {R('current_raw')} AS current_price, action, {R('new_raw')} AS optimized_price
FROM g3 WHERE rn = 1"""

SQL["price_elastic"] = W(TX, CP, DAILY_PQ, """el AS (SELECT product, regr_slope(ln(q), ln(p)) AS e,
  avg(q) AS q_bar FROM d GROUP BY product)""", f"""g AS (SELECT el.product, e, q_bar, current_raw, {ACT}
  FROM el JOIN cp ON el.product = cp.product, range(-5, 6) r(a))""", """g2 AS (SELECT *,
  current_raw * f AS price_raw, q_bar * pow(f, e) AS qty_raw FROM g)""", f"""g3 AS (SELECT *,
  {R('(price_raw - 0.7 * current_raw) * qty_raw')} AS profit_r FROM g2)""", """g4 AS (SELECT *,
  row_number() OVER (PARTITION BY product ORDER BY profit_r DESC, abs(action), action) AS rn FROM g3)""") + f"""
SELECT product, {R('e', 4)} AS elasticity, {R('current_raw')} AS current_price, action AS best_action,
  {R('price_raw')} AS best_price, {R('qty_raw')} AS expected_quantity, profit_r AS expected_profit,
  abs(action) = 5 AS at_grid_edge FROM g4 WHERE rn = 1"""

SQL["regression_fit"] = W(TX, DAILY_PQ) + f"""SELECT product, {R('regr_slope(q, p)', 4)} AS slope,
  {R('regr_intercept(q, p)', 4)} AS intercept, {R('regr_r2(q, p)', 4)} AS r2,
  CAST(regr_count(q, p) AS BIGINT) AS n FROM d GROUP BY product"""

SQL["price_attribution"] = W(TX, DAILY_PQ, """c AS (SELECT product, regr_slope(q, p) AS slope,
  avg(p) AS p_mean FROM d GROUP BY product)""") + f"""SELECT d.product, d.dt, {R('d.p')} AS price,
  {R('c.slope * (d.p - c.p_mean)', 4)} AS attribution FROM d JOIN c ON d.product = c.product"""

# --- recommenders ------------------------------------------------------------------------
POP = "pop AS (SELECT product, COUNT(*) AS n FROM tx GROUP BY product)"
SQL["popularity"] = W(TX, POP) + "SELECT product, n FROM pop"
RECS = """recs AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, product) AS INTEGER) AS rank,
  product, n AS score FROM pop ORDER BY n DESC, product LIMIT 5)"""
SQL["recommend_popular"] = W(TX, POP, RECS) + "SELECT * FROM recs"

# --- graph -------------------------------------------------------------------------------
EDGES = """e AS (SELECT product, 'user_' || CAST(user_id AS VARCHAR) AS "user",
  max({'d': dt, 't': transaction_id, 'q': quantity}).q AS weight,
  CAST(SUM(quantity) AS BIGINT) AS total_quantity, COUNT(*) AS n_lines FROM tx GROUP BY product, user_id)"""
SQL["graph_edges"] = W(TX, EDGES) + "SELECT * FROM e"
SQL["graph_nodes"] = W(TX, EDGES) + """SELECT product AS id, 'product' AS kind, COUNT(*) AS degree FROM e
GROUP BY product UNION ALL SELECT "user", 'user', COUNT(*) FROM e GROUP BY "user\""""
SQL["graph_neighbours"] = W(TX, EDGES) + f"""SELECT product, "user" AS neighbour, weight FROM e
WHERE product = {lit(Q.GRAPH_PRODUCT)}"""
DEGREES = """dg AS (SELECT product, COUNT(*) AS degree, CAST(SUM(total_quantity) AS BIGINT) AS units
  FROM e GROUP BY product)"""
SQL["graph_insights"] = W(TX, EDGES, DEGREES) + """SELECT e.product, "user" AS neighbour, weight, degree, units
FROM e JOIN dg ON e.product = dg.product"""
INSIGHTS = """gi AS (SELECT product, 'Related to: ' || degree || ' customers, ' || units || ' units' AS insight FROM dg)"""

SQL["knn_l2"] = W("""c AS (SELECT label, list(x ORDER BY pos) AS vec FROM (
    SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) u
    GROUP BY label, pos) v GROUP BY label)""", """s AS (SELECT c.label, e.vec_id,
    sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i:
      (c.vec[i] - CAST(e.embedding[i] AS DOUBLE)) * (c.vec[i] - CAST(e.embedding[i] AS DOUBLE))))) AS d
    FROM c, embeddings e)""") + f"""SELECT label, rank, vec_id, {R('d', 4)} AS distance FROM (
  SELECT label, vec_id, d, CAST(row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS INTEGER) AS rank
  FROM s) t WHERE rank <= 5"""


# --- context, catalog, spines --------------------------------------------------------------
def F2(x: str) -> str:
    return f"CAST(CAST(ROUND(CAST({x} AS DECIMAL(38,6)), 2) AS DECIMAL(38,2)) AS VARCHAR)"


SQL["dashboard_context"] = W(*_fc_ctes("day"), CP, SENT, POP, RECS, EDGES, DEGREES, INSIGHTS,
                             "fl AS (SELECT product, arg_max(yhat, ds) AS f_yhat FROM fc GROUP BY product)",
                             f"""pr AS (SELECT product, {R('current_raw')} AS cur, {R('current_raw')} AS opt FROM cp)""",
                             f"""se AS (SELECT CASE product WHEN 'view' THEN 'STANDARD' WHEN 'click' THEN 'PROMO'
                               WHEN 'purchase' THEN 'LARGE' WHEN 'signup' THEN 'SMALL' END AS product,
                               {R('avg(sentiment)', 4)} AS s_avg FROM sent GROUP BY sent.product)""",
                             "rt AS (SELECT array_to_string(list(product ORDER BY rank), ', ') AS r FROM recs)") + f"""
SELECT p.product, concat_ws(chr(10),
  COALESCE('Forecast (next period) yhat=' || {F2('fl.f_yhat')}, 'Forecast: unavailable'),
  COALESCE('Price: current=' || {F2('pr.cur')} || ', optimized=' || {F2('pr.opt')}, 'Price: unavailable'),
  CASE WHEN (SELECT r FROM rt) <> '' THEN 'Top recommendations: ' || (SELECT r FROM rt) END,
  COALESCE('Social sentiment (avg): ' || {F2('se.s_avg')}, 'Social sentiment: unavailable'),
  'Graph: ' || COALESCE(gi.insight, 'No relations')) AS context
FROM pop p LEFT JOIN fl ON p.product = fl.product LEFT JOIN pr ON p.product = pr.product
LEFT JOIN se ON p.product = se.product LEFT JOIN gi ON p.product = gi.product"""

SQL["catalog"] = f"""WITH sold AS (SELECT l_partkey AS p_partkey, CAST(SUM(l_quantity) AS BIGINT) AS units,
  avg(l_discount) AS disc FROM lineitem GROUP BY 1)
SELECT p.p_partkey AS id, p.p_name AS name, {R('p.p_retailprice * (1.0 - COALESCE(disc, 0.0))')} AS price,
  CASE WHEN COALESCE(disc, 0.0) > 0 THEN p.p_retailprice END AS old_price, 'USD' AS currency,
  COALESCE(units, 0) AS stock,
  list_filter([p.p_brand, p.p_type, CASE WHEN COALESCE(disc, 0.0) > 0 THEN 'Sale' END],
              lambda t: t IS NOT NULL) AS tags
FROM part p LEFT JOIN sold ON p.p_partkey = sold.p_partkey"""

SQL["date_spine"] = W(TX, """d AS (SELECT product, dt, SUM(quantity) AS q, SUM(total_amount) AS rev
  FROM tx GROUP BY 1, 2)""", """sp AS (SELECT product, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS dt
  FROM (SELECT product, min(dt) AS lo, max(dt) AS hi FROM d GROUP BY product) t)""") + """SELECT sp.product, sp.dt,
  CAST(COALESCE(q, 0) AS BIGINT) AS quantity, CAST(COALESCE(rev, 0) AS DOUBLE) AS revenue
FROM sp LEFT JOIN d ON sp.product = d.product AND sp.dt = d.dt"""


SQL["seasonal_index"] = W(TX, """bm AS (SELECT product, CAST(month(dt) AS INTEGER) AS month,
  CAST(SUM(total_amount) AS DOUBLE) AS revenue FROM tx GROUP BY 1, 2)""") + f"""SELECT product, month, revenue,
  {R('revenue / avg(revenue) OVER (PARTITION BY product)', 4)} AS seasonal_index FROM bm"""

SQL["category_distinct"] = W(TX) + """SELECT category, COUNT(DISTINCT product_name) AS n_products,
  COUNT(*) AS n_rows FROM tx GROUP BY category"""

SQL["csv_round_trip"] = SQL["export_daily"]

SQL["records_json"] = W(TX) + """SELECT CAST(to_json({'product': product, 'revenue': SUM(total_amount),
  'n_rows': COUNT(*)}) AS VARCHAR) AS record FROM tx GROUP BY product"""


SQL["forecast_input"] = W(TX) + f"""SELECT dt AS ds, quantity AS y FROM tx WHERE product = {lit(Q.FORECAST_PRODUCT)}"""

SQL["user_top_products"] = W(TX) + """SELECT user_id, rank, product, score FROM (
  SELECT user_id, product, score,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product) AS INTEGER) AS rank
  FROM (SELECT user_id, product, CAST(SUM(quantity) AS BIGINT) AS score FROM tx GROUP BY 1, 2) a) b
WHERE rank <= 3"""

SQL["product_list"] = W(TX) + "SELECT DISTINCT product FROM tx"


SQL["orphan_counts"] = """SELECT (SELECT COUNT(*) FROM lineitem) AS n_lines,
  (SELECT COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lines_without_order,
  (SELECT COUNT(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS lines_without_part,
  (SELECT COUNT(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS orders_without_lines"""

SQL["stock_alert_levels"] = SQL["stock_alert"].replace("k AS (SELECT product,", """lv AS (SELECT p_type AS product,
  CAST(CAST(SUM(l_quantity) AS BIGINT) * (length(p_type) - 4) // 400 AS INTEGER) AS stock
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type),
k AS (SELECT product,""").replace("100 AS current_stock", "stock AS current_stock").replace(
    "trunc(100.0 / avg)", "trunc(stock / avg)").replace("FROM s)", "FROM s JOIN lv USING (product))")

SQL["profit_brand_costs"] = W(TX, """pr AS (SELECT product, SUM(total_amount) AS rev,
  SUM(total_amount * CAST((50 + CAST(regexp_extract(brand, '([0-9]+)$', 1) AS INTEGER)) / 100.0 AS DECIMAL(5,4))) AS cost_dec,
  CAST(SUM(quantity) AS BIGINT) AS quantity FROM tx GROUP BY product)""", PROFIT_ROWS) + "SELECT * FROM pb"

SQL["revenue_by_month"] = W(TX) + """SELECT CAST(month(dt) AS INTEGER) AS month,
  CAST(SUM(total_amount) AS DOUBLE) AS revenue FROM tx GROUP BY 1"""

SQL["forecast_latest"] = W(*_fc_ctes("day")) + f"""SELECT product, max(ds) AS ds, {R('arg_max(yhat, ds)')} AS yhat
FROM fc GROUP BY product"""

SQL["sales_ingest"] = W(TX) + f"""SELECT dt, product, product AS category,
  quantity, {R('price')} AS price, {R('quantity * ' + R('price'))} AS total_amount, user_id FROM tx"""

SQL["sales_export"] = W(TX) + """SELECT 'sales_data' AS sheet, COUNT(*) AS n_rows, CAST(SUM(quantity) AS BIGINT) AS units FROM tx
UNION ALL SELECT 'summary_statistics', COUNT(DISTINCT product), CAST(SUM(quantity) AS BIGINT) FROM tx
UNION ALL SELECT 'daily_sales', COUNT(DISTINCT (dt, product)), CAST(SUM(quantity) AS BIGINT) FROM tx"""

SQL["comparison_export"] = W(TX) + f"""SELECT product, COUNT(*) AS n_rows, CAST(SUM(quantity) AS BIGINT) AS units
FROM tx WHERE product IN ({_CMP}) GROUP BY product"""

SQL["trend_append"] = "SELECT *, 'trends' AS source FROM (" + SQL["interest_index"] + ") i"

# Least squares with two features, from the centred sums.
SQL["regression_multi"] = W(TX, DAILY_PQ, f"""x AS (SELECT q AS y, p AS a, CAST(isodow(dt) - 1 AS DOUBLE) AS b
  FROM d WHERE product = {lit(Q.FORECAST_PRODUCT)})""", """m AS (SELECT covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
  covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(y) AS yy, avg(y) AS my, avg(a) AS ma, avg(b) AS mb,
  COUNT(*) AS n FROM x)""", """c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca,
  (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m)""", """t AS (
  SELECT 'intercept' AS term, my - ca * ma - cb * mb AS coefficient, (ca * ay + cb * by_) / yy AS r2, n FROM c
  UNION ALL SELECT 'p', ca, (ca * ay + cb * by_) / yy, n FROM c
  UNION ALL SELECT 'wd', cb, (ca * ay + cb * by_) / yy, n FROM c)""") + f"""SELECT term, {R('coefficient', 3)} AS coefficient,
  {R('r2', 4)} AS r2, n FROM t"""

SQL["knn_all"] = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, 65),
    lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))) AS d FROM v q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {R('d', 4)} AS distance FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) t WHERE rank <= 5"""

# Every window counted anew from the facts.
SQL["customers_trailing"] = W(TX, """sp AS (SELECT product, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS dt
  FROM (SELECT product, min(dt) AS lo, max(dt) AS hi FROM tx WHERE user_id IS NOT NULL GROUP BY product) t)""",
                              "d AS (SELECT DISTINCT product, dt, user_id FROM tx)") + """
SELECT sp.product, sp.dt, COUNT(DISTINCT d.user_id) AS customers FROM sp LEFT JOIN d
  ON d.product = sp.product AND d.dt > sp.dt - 30 AND d.dt <= sp.dt GROUP BY sp.product, sp.dt"""


def _copurchase(edges: str) -> tuple[str, str, str]:
    return (edges, "sz AS (SELECT item, COUNT(*) AS n FROM ed GROUP BY item)",
            """co AS (SELECT p.item, p.other, p.n_both, p.n_both / sqrt(CAST(x.n AS DOUBLE) * CAST(y.n AS DOUBLE)) AS cosine
  FROM (SELECT l.item, r.item AS other, COUNT(*) AS n_both FROM ed l JOIN ed r
    ON l.usr = r.usr AND l.item <> r.item GROUP BY 1, 2) p
  JOIN sz x ON x.item = p.item JOIN sz y ON y.item = p.other)""")


SQL["copurchase_neighbours"] = W(*_copurchase("""ed AS (SELECT DISTINCT l_partkey AS item, o_custkey AS usr
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")) + f"""SELECT item AS part, CAST(rank AS INTEGER) AS rank,
  other AS neighbour, n_both AS "both", {R('cosine', 6)} AS cosine FROM (SELECT *,
  row_number() OVER (PARTITION BY item ORDER BY cosine DESC, n_both DESC, other) AS rank FROM co) t WHERE rank <= 5"""

SQL["copurchase_products"] = W(TX, *_copurchase("ed AS (SELECT DISTINCT product AS item, user_id AS usr FROM tx)")) + f"""
SELECT item AS product, other AS neighbour, n_both AS "both", {R('cosine', 6)} AS cosine FROM co"""

# --- models over all products -------------------------------------------------------------------
DAYS = """dd AS (SELECT product, dt, CAST(SUM(quantity) AS DOUBLE) AS y, SUM(price) / COUNT(*) AS p FROM tx
  GROUP BY product, dt)"""


def _fourier_row(d: str) -> str:
    u = f"(date_diff('day', lo, {d}) / greatest(date_diff('day', lo, hi), 1))"
    t = T_EXPR.format(d=d)
    waves = [f"{w}({t} * 2 * pi() * {j} / {period})" for period, pairs in (("365.25", 2), ("7.0", 3))
             for j in range(1, pairs + 1) for w in ("sin", "cos")]
    return "[1.0, " + u + ", " + ", ".join([f"greatest({u} - {c}, 0)" for c in (0.25, 0.5, 0.75)] + waves) + "]"


# The 15 equations of each product, with a ridge of 0.001, by Gauss-Jordan.
SQL["forecast_fourier"] = "WITH RECURSIVE " + ",\n".join((TX, DAYS, """sp AS (SELECT product, min(dt) AS lo, max(dt) AS hi,
  COUNT(*) AS n FROM dd GROUP BY product HAVING COUNT(*) >= 10)""", f"""z AS (SELECT dd.product,
  list_append(CAST({_fourier_row('dt')} AS DOUBLE[]), y) AS z FROM dd JOIN sp ON sp.product = dd.product)""",
    """sums AS (SELECT product, i, j, sum(z[i] * z[j]) + CASE WHEN i = j AND i > 1 THEN 0.001 ELSE 0 END AS s
  FROM z, range(1, 16) a(i), range(1, 17) b(j) GROUP BY product, i, j)""",
    """m0 AS (SELECT product, list(r ORDER BY i) AS m FROM (SELECT product, i, list(s ORDER BY j) AS r FROM sums
  GROUP BY product, i) t GROUP BY product)""", """gj(product, k, m) AS (SELECT product, 0, m FROM m0 UNION ALL
  SELECT product, k + 1, list_transform(range(1, 16), lambda r: list_transform(range(1, 17), lambda c:
    CASE WHEN r = k + 1 THEN m[r][c] / m[r][r] ELSE m[r][c] - m[r][k + 1] * m[k + 1][c] / m[k + 1][k + 1] END))
  FROM gj WHERE k < 15)""", """be AS (SELECT product, list_transform(range(1, 16), lambda i: m[i][16]) AS b FROM gj WHERE k = 15)""",
    """sg AS (SELECT z.product, sqrt(sum(pow(z[16] - list_sum(list_transform(range(1, 16), lambda i: z[i] * b[i])), 2))
  / (count(*) - 1)) AS sigma FROM z JOIN be ON be.product = z.product GROUP BY z.product)""",
    f"""ahead AS (SELECT sp.product, ds, list_sum(list_transform(range(1, 16), lambda i: x[i] * b[i])) AS yhat,
  1.2816 * sigma AS band FROM (SELECT *, {_fourier_row('ds')} AS x FROM (SELECT product, lo, hi,
    CAST(hi + CAST(h AS INTEGER) AS DATE) AS ds FROM sp, range(1, 31) r(h)) f) sp
  JOIN be ON be.product = sp.product JOIN sg ON sg.product = sp.product)""")) + f"""
SELECT product, ds, {R('yhat', 4)} AS yhat, {R('yhat - band', 4)} AS yhat_lower, {R('yhat + band', 4)} AS yhat_upper FROM ahead"""

SQL["forecast_backtest"] = W(TX, DAYS, """o AS (SELECT *, CAST(date_diff('day', min(dt) OVER (PARTITION BY product), dt) AS DOUBLE) AS t
  FROM dd)""", """f AS (SELECT product, dt, t, regr_slope(y, t) OVER w AS b, regr_intercept(y, t) OVER w AS a, COUNT(*) OVER w AS n
  FROM o WINDOW w AS (PARTITION BY product ORDER BY dt))""", """s AS (SELECT f.product, CAST(h AS INTEGER) AS ahead,
  a + b * (f.t + h) - o.y AS e, o.y FROM f, range(1, 31) r(h) JOIN o ON o.product = f.product
  AND o.dt = f.dt + CAST(h AS INTEGER) WHERE n >= 30)""") + f"""SELECT product, ahead, COUNT(*) AS n,
  {R('avg(abs(e))', 4)} AS mae, {R('avg(e)', 4)} AS bias, {R('sum(abs(e)) / sum(y)', 4)} AS share FROM s GROUP BY product, ahead"""

SQL["regression_products"] = W(TX, DAYS, """x AS (SELECT product, y, p AS a, CAST(isodow(dt) - 1 AS DOUBLE) AS b FROM dd)""",
                               """m AS (SELECT product, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(a, b) AS ab,
  var_pop(a) AS aa, var_pop(b) AS bb, var_pop(y) AS yy, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, COUNT(*) AS n FROM x
  GROUP BY product)""", """c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca,
  (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m)""") + f"""SELECT product, {R('my - ca * ma - cb * mb', 3)} AS intercept,
  {R('ca', 3)} AS price, {R('cb', 3)} AS weekday, {R('(ca * ay + cb * by_) / yy', 4)} AS r2, n FROM c"""

# Shapley values over the six orders in which three features can join.
_ORDERS = [(a, b, c) for a in "pwm" for b in "pwm" for c in "pwm" if len({a, b, c}) == 3]


def _gain(x: str) -> str:
    v = lambda s: "v_" + "".join(k for k in "pwm" if k in s)      # noqa: E731
    return "(" + " + ".join(f"({v(o[:o.index(x) + 1])} - {v(o[:o.index(x)])})" for o in _ORDERS) + ") / 6.0"


SQL["demand_shapley"] = W(TX, DAYS, """x AS (SELECT product, y, CAST(CASE WHEN p < 0.95 * mp THEN -1 WHEN p > 1.05 * mp THEN 1
  ELSE 0 END AS INTEGER) AS p, CAST(isodow(dt) - 1 AS INTEGER) AS w, CAST(month(dt) AS INTEGER) AS m
  FROM (SELECT *, avg(p) OVER (PARTITION BY product) AS mp FROM dd) t)""", "v AS (SELECT DISTINCT product, p, w, m, " + ", ".join(
    f"avg(y) OVER (PARTITION BY {', '.join(['product', *s])}) AS v_{s}" for s in ("", "p", "w", "m", "pw", "pm", "wm", "pwm"))
    + ", COUNT(*) OVER (PARTITION BY product, p, w, m) AS n FROM x)") + f"""SELECT product, p AS price_band, w AS weekday,
  m AS month, n, {R('v_pwm', 4)} AS mean, {R('v_', 4)} AS base, {R(_gain('p'), 4)} AS phi_price_band,
  {R(_gain('w'), 4)} AS phi_weekday, {R(_gain('m'), 4)} AS phi_month FROM v"""

# --- whole sheets, the report's lines, dates and prefixes ---------------------------------------
def _unbounded(sql: str) -> str:
    return sql[:sql.rindex("WHERE dt >=")]


def _body(name: str) -> str:
    """A statement without the common ``tx``."""
    return SQL[name][len(W(TX)):]


SQL["sales_sheets"] = W(TX) + "SELECT 'sales_data' AS sheet, * FROM (" + _unbounded(_body("sales_range")) + """) a
UNION ALL BY NAME SELECT 'summary_statistics' AS sheet, * FROM (""" + _body("export_summary") + """) b
UNION ALL BY NAME SELECT 'daily_sales' AS sheet, * FROM (""" + _body("export_daily") + ") c"

SQL["comparison_sheets"] = W(TX) + f"""SELECT product AS sheet, transaction_id, product, product_name, quantity,
  {R('price')} AS price, CAST(total_amount AS DOUBLE) AS total_amount FROM tx WHERE product IN ({_CMP})
UNION ALL BY NAME SELECT 'comparison' AS sheet, * FROM (""" + _body("comparison_stats") + ") c"

SQL["forecast_report"] = W(*_fc_ctes("day"), "rep AS (" + FC_SELECT + ")") + """SELECT product,
  strftime(ds, '%Y-%m-%d') || '  yhat=' || CAST(yhat AS VARCHAR) || '  lower=' || CAST(yhat_lower AS VARCHAR)
  || '  upper=' || CAST(yhat_upper AS VARCHAR) AS line FROM rep
UNION ALL SELECT product, unnest(['=== Demand Forecast Report ===', 'Product: ' || product]) FROM (SELECT DISTINCT product FROM rep) r"""

SQL["day_of_year"] = W(TX) + """SELECT CAST(dayofyear(dt) AS INTEGER) AS day_of_year, COUNT(DISTINCT transaction_id) AS n_orders,
  CAST(SUM(total_amount) AS DOUBLE) AS revenue FROM tx GROUP BY 1"""

SQL["sheet_names"] = """SELECT product, CASE WHEN n > 1 THEN prefix || '~' || i ELSE prefix END AS sheet FROM (
  SELECT product, prefix, count(*) OVER (PARTITION BY prefix) AS n, row_number() OVER (PARTITION BY prefix ORDER BY product) AS i
  FROM (SELECT DISTINCT p_name AS product, p_name[1:30] AS prefix FROM part) a) b"""

# --- rules, bad lines, repeated ingestion -------------------------------------------------------
def _rules_sql(table: str, ids: str) -> str:
    words = ", ".join(f"({lit(w)}, CAST({v!r} AS DOUBLE))" for w, v in DOCUMENT_WORDS.items())
    b = lambda d: f"coalesce(b{d}.strength, 0)"      # noqa: E731
    return W(
        f"lex AS (SELECT * FROM (VALUES {words}) t(word, valence))",
        "boost AS (SELECT * FROM (VALUES ('of', 0.293), ('in', 0.293), ('le', -0.293), ('en', 0.293)) t(word, strength))",
        f"""src AS (SELECT row_number() OVER () AS rid, {ids}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+'),
      lambda t: t <> '') AS w FROM {table})""",
        "tok AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM src)",
        """back AS (SELECT *, lag(word, 1) OVER p AS w1, lag(word, 2) OVER p AS w2, lag(word, 3) OVER p AS w3 FROM tok
      WINDOW p AS (PARTITION BY rid ORDER BY i))""",
        f"""hits AS (SELECT rid, valence, coalesce(w1 IN ('to', 'is', 'die', 'un'), false) OR coalesce(w2 IN ('to', 'is', 'die', 'un'), false)
      OR coalesce(w3 IN ('to', 'is', 'die', 'un'), false) AS neg, {b(1)} + 0.95 * {b(2)} + 0.9 * {b(3)} AS boost
      FROM back JOIN lex ON back.word = lex.word LEFT JOIN boost b1 ON b1.word = w1 LEFT JOIN boost b2 ON b2.word = w2
      LEFT JOIN boost b3 ON b3.word = w3)""",
        """agg AS (SELECT rid, COUNT(*) AS n_hits, COUNT(*) FILTER (neg) AS n_negated,
      SUM((valence + sign(valence) * boost) * CASE WHEN neg THEN -0.74 ELSE 1 END) AS s FROM hits GROUP BY rid)""",
        f"""a2 AS (SELECT {ids}, len(w) AS n_tokens, coalesce(n_hits, 0) AS n_hits, coalesce(n_negated, 0) AS n_negated,
      CAST(coalesce(s, 0.0) AS DOUBLE) AS s FROM src LEFT JOIN agg ON src.rid = agg.rid)""") + f"""
SELECT {ids}, n_tokens, n_hits, n_negated, {R('s', 4)} AS score, {R('s / sqrt(s * s + 15.0)', 4)} AS compound,
  {R('greatest(CAST(0.35 AS DOUBLE), least(CAST(0.95 AS DOUBLE), s / sqrt(s * s + 15.0)))', 4)} AS sentiment FROM a2"""


SQL["rules_documents"] = _rules_sql("documents", "doc_id")
SQL["rules_conversations"] = _rules_sql("conversations", "conv_id, turn")

SQL["csv_bad_lines"] = W(TX, "d AS (" + _body("export_daily") + ")") + """SELECT
  CASE WHEN bad IS NULL THEN dt END AS dt, CASE WHEN bad IS NULL THEN product END AS product,
  CASE WHEN bad IS NULL THEN quantity END AS quantity, CASE WHEN bad IS NULL THEN price END AS price, bad AS reason,
  CASE bad WHEN 'value' THEN concat_ws(',', dt, product, quantity, 'n/a') WHEN 'fields' THEN concat_ws(',', dt, product) END AS line
FROM (SELECT *, CASE WHEN quantity % 7 = 0 THEN 'value' WHEN quantity % 11 = 0 OR quantity % 13 = 0 THEN 'fields' END AS bad FROM d) t"""

SQL["ingest_twice"] = SQL["export_daily"]

# --- gaps between groups, quality of recommendations ---------------------------------------------
def _gaps_sql(ctes: list[str], src: str) -> str:
    """``src`` gives g (group), y (value) and k (key).  Poisson(1) weights: the
    number of cuts (its distribution function in 65,536ths) not above four hex
    digits of an md5."""
    cuts = arr(["5e2d", "bc5b", "eb71", "fb24", "ff10", "ffd9", "fffb", "ffff"])
    return W(*ctes, f"src AS ({src})", f"""w AS (SELECT g, y, b, i, len(list_filter({cuts},
      lambda c: c <= substr(md5(k || '|' || b), CAST(4 * i + 1 AS INTEGER), 4))) AS w FROM src, range(25) t(b), range(8) u(i) WHERE y IS NOT NULL)""",
             "rep AS (SELECT g, b, i, SUM(w) AS n, SUM(w * y) AS s, COUNT(*) AS n0, SUM(y) AS s0 FROM w GROUP BY g, b, i)",
             """rest AS (SELECT *, SUM(n) OVER q - n AS rn, SUM(s) OVER q - s AS rs, SUM(n0) OVER q - n0 AS rn0, SUM(s0) OVER q - s0 AS rs0
      FROM rep WINDOW q AS (PARTITION BY b, i))""",
             f"""each AS (SELECT g, n0, {div('s0', 'n0')} AS m, {div('rs0', 'rn0')} AS r, {div('s', 'n')} - {div('rs', 'rn')} AS gap,
      {div(div('s', 'n'), div('rs', 'rn'))} AS ratio FROM rest)""",
             """a AS (SELECT g, max(n0) AS n0, max(m) AS m, max(r) AS r, quantile_cont(gap, [0.025, 0.975]) AS gq,
      quantile_cont(ratio, [0.025, 0.975]) AS rq FROM each GROUP BY g)""") + f"""SELECT g AS "group", n0 AS n_rows,
  {R('m', 4)} AS mean, {R('r', 4)} AS rest, {R('m - r', 4)} AS gap, {R('gq[1]', 4)} AS gap_low, {R('gq[2]', 4)} AS gap_high,
  {R(div('m', 'r'), 4)} AS ratio, {R('rq[1]', 4)} AS ratio_low, {R('rq[2]', 4)} AS ratio_high FROM a"""


SQL["error_gaps"] = _gaps_sql(_fc_ctes("day"),
                              "SELECT product AS g, abs(r3) AS y, product || '|' || CAST(dt AS VARCHAR) AS k FROM r3")
SQL["order_value_gaps"] = _gaps_sql([], """SELECT c_mktsegment AS g, o_totalprice AS y, CAST(o_orderkey AS VARCHAR) AS k
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")


def _quality_sql(item: str, ks: tuple) -> str:
    n = max(ks)
    return W(TX, f"""u AS (SELECT user_id, {item} AS product, dt, transaction_id, quantity FROM tx
      WHERE user_id IS NOT NULL AND {item} IS NOT NULL AND dt IS NOT NULL)""",
             """o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dt DESC, transaction_id DESC) AS nth,
      count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, dt, transaction_id FROM u) d)""",
             "held AS (SELECT user_id, transaction_id FROM o WHERE nth = 1 AND n > 1)",
             "train AS (SELECT u.* FROM u ANTI JOIN held USING (user_id, transaction_id))",
             "test AS (SELECT DISTINCT u.user_id, u.product FROM u SEMI JOIN held USING (user_id, transaction_id))",
             "pop AS (SELECT product, row_number() OVER (ORDER BY count(*) DESC, product) AS rank FROM train GROUP BY product)",
             """hist AS (SELECT user_id, product, row_number() OVER (PARTITION BY user_id ORDER BY sum(quantity) DESC, product) AS rank
      FROM train GROUP BY user_id, product)""",
             """h AS (SELECT 'popular' AS model, test.user_id, rank FROM test LEFT JOIN pop ON pop.product = test.product UNION ALL
      SELECT 'history', test.user_id, rank FROM test LEFT JOIN hist ON hist.user_id = test.user_id AND hist.product = test.product)""",
             f"""per AS (SELECT model, CAST(k AS INTEGER) AS k, user_id, count(*) AS wanted, count(*) FILTER (rank <= k) AS hits,
      coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rank <= k), 0.0) AS dcg,
      list_sum([1.0::DOUBLE / log2(i + 1) for i in range(1, least(k, count(*)) + 1)]) AS best
      FROM h, (VALUES {", ".join(f"({k})" for k in ks)}) ks(k) GROUP BY model, k, user_id)""") + f"""
SELECT model, k, count(*) AS n_users, CAST(sum(hits) AS BIGINT) AS n_hits, {R('avg(hits / wanted)', 4)} AS recall,
  {R('avg(dcg / best)', 4)} AS ndcg FROM per GROUP BY model, k"""


SQL["recommend_quality"] = _quality_sql("product", (1, 2, 3))
SQL["recommend_quality_brands"] = _quality_sql("brand", (1, 5, 10))
