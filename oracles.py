"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

RAW = """raw AS (
  SELECT event_id AS seq,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE concat('T', CAST(user_id % 10 AS VARCHAR)) END AS ticker,
    CASE WHEN event_id % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS price,
    value AS open, value * CAST(1.01 AS DOUBLE) AS high, value * CAST(0.99 AS DOUBLE) AS low,
    CAST(props::JSON->>'k' AS BIGINT) AS volume, ts,
    CASE WHEN event_id % 2 = 0 THEN 'alpha_vantage' ELSE 'massive' END AS source
  FROM events)"""
VALID = "valid AS (SELECT * FROM raw WHERE ticker IS NOT NULL AND price > 0)"
HOT = "valid AS (SELECT * REPLACE ('HOT' AS ticker) FROM raw WHERE ticker IS NOT NULL AND price > 0)"
# Tickers with the number of the micro-batch they came in, of three.
BY_BATCH = """batched AS (SELECT raw.* REPLACE (concat(CAST(least(floor(seq * 3.0 / total), 2) AS INT), ':', ticker) AS ticker)
  FROM (SELECT * FROM raw WHERE ticker IS NOT NULL) raw, (SELECT max(event_id) + 1 AS total FROM events)),
valid AS (SELECT * FROM batched WHERE price > 0)"""
FRAME = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
FIELDS = ("price", "open", "high", "low", "volume", "sma_20", "sma_50", "rsi_14", "vwap")
RULES = (("sma_5_20", 5, 20), ("sma_20_50", 20, 50), ("rsi_7_25_75", 7, 25, 75), ("rsi_14_30_70", 14, 30, 70))


def r(expression: str, name: str | None = None) -> str:
    rounded = f"round(CAST({expression} AS DOUBLE), 6) + 0.0"
    return f"{rounded} AS {name or expression}"


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


def numbered(by: str = "ticker") -> str:
    return f"""numbered AS (
  SELECT *, row_number() OVER w AS n, coalesce(price - lag(price) OVER w, 0) AS chg
  FROM valid WINDOW w AS (PARTITION BY {by} ORDER BY ts, seq))"""


def sma(period: int, by: str = "ticker") -> str:
    frame = f"(PARTITION BY {by} ORDER BY n ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN n >= {period} THEN avg(price) OVER {frame} ELSE 0 END"


def rsi(period: int, seed: str = "zero", by: str = "ticker") -> list[str]:
    """CTEs smoothed_<p> and rsi_cte_<p>, the recurrence step by step."""
    keys = [key.strip() for key in by.split(",")]
    listed = ", ".join(keys)
    picked = ", ".join(f"c.{key}" for key in keys)
    match = " AND ".join(f"c.{key} = s.{key}" for key in keys)
    first = (
        f"SELECT {listed}, n, greatest(chg, 0) / {period} AS ag, greatest(-chg, 0) / {period} AS al FROM numbered WHERE n = {period + 1}"
        if seed == "zero"
        else f"SELECT {listed}, CAST({period + 1} AS BIGINT) AS n, sum(greatest(chg, 0)) / {period} AS ag, sum(greatest(-chg, 0)) / {period} AS al "
        f"FROM numbered WHERE n <= {period + 1} GROUP BY {listed} HAVING max(n) = {period + 1}"
    )
    return [
        f"""smoothed_{period} AS (
  {first}
  UNION ALL
  SELECT {picked}, c.n, (s.ag * {period - 1} + greatest(c.chg, 0)) / {period}, (s.al * {period - 1} + greatest(-c.chg, 0)) / {period}
  FROM smoothed_{period} s JOIN numbered c ON {match} AND c.n = s.n + 1)""",
        f"""rsi_cte_{period} AS (
  SELECT c.seq, CASE WHEN s.n IS NULL THEN 0 WHEN s.al = 0 THEN 100 ELSE 100 - 100 / (1 + s.ag / s.al) END AS rsi_{period}
  FROM numbered c LEFT JOIN smoothed_{period} s ON {match} AND c.n = s.n)""",
    ]


def vwap(by: str = "ticker", order: str = "n") -> str:
    over = f"OVER (PARTITION BY {by} ORDER BY {order} {FRAME})"
    counted = "CASE WHEN volume > 0 AND high > 0 AND low > 0 THEN {} ELSE 0 END"
    money = f"sum({counted.format('(high + low + price) / 3.0 * volume')}) {over}"
    total = f"sum({counted.format('CAST(volume AS DOUBLE)')}) {over}"
    return f"CASE WHEN {total} > 0 THEN {money} / {total} ELSE 0 END"


def enriched(valid: str = VALID) -> str:
    """CTE enriched: valid ticks with the four indicators and n."""
    return with_(
        RAW,
        valid,
        numbered(),
        *rsi(14),
        f"""enriched AS (
  SELECT numbered.*, {sma(20)} AS sma_20, {sma(50)} AS sma_50, rsi_14, {vwap()} AS vwap, n >= 50 AS ready
  FROM numbered JOIN rsi_cte_14 USING (seq))""",
        recursive=True,
    )


# What has come in four chunks, and the watermark before each: six days behind the valid ticks of the chunks before.
ARRIVED = """arrived AS (SELECT *, least(floor((seq
    + CASE WHEN seq % 11 = 3 THEN total // 7 WHEN seq % 11 = 7 THEN total // 2 ELSE 0 END) * 4.0 / total), 3) AS chunk
  FROM raw, (SELECT max(event_id) + 1 AS total FROM events) WHERE ticker IS NOT NULL AND price > 0),
marks AS (SELECT c.chunk, date_trunc('millisecond', max(a.ts)) - INTERVAL 6 DAYS AS mark
  FROM (SELECT DISTINCT chunk FROM arrived) c LEFT JOIN arrived a ON a.chunk < c.chunk GROUP BY c.chunk),
judged AS (SELECT arrived.* EXCLUDE (chunk, total), mark IS NOT NULL AND ts <= mark AS late FROM arrived JOIN marks USING (chunk)),
valid AS (SELECT * EXCLUDE late FROM judged WHERE NOT late)"""


def late() -> str:
    return (
        enriched(ARRIVED)
        + f"""SELECT *, false AS late FROM ({FLAT})
UNION ALL SELECT seq, ticker, {r('price')}, 0, 0, 0, 0, false, true FROM judged WHERE late"""
    )


FLAT = f"""SELECT seq, ticker, {r('price')}, {r('sma_20')}, {r('sma_50')}, {r('rsi_14')}, {r('vwap')}, ready AS indicators_ready
FROM enriched"""


def points_cte() -> str:
    gated = ", ".join(f"CASE WHEN ready THEN {name} END AS {name}" for name in FIELDS[5:])
    return f"points AS (SELECT ticker, source, ts, seq, price, open, high, low, volume, {gated} FROM enriched)"


def points() -> str:
    return enriched().rstrip("\n") + ",\n" + points_cte() + "\n"


POINT_LIST = "ticker, source, ts, seq, " + ", ".join(r(name) for name in FIELDS if name != "volume") + ", volume"
NOW = "(SELECT max(ts) + INTERVAL 1 MICROSECOND FROM valid)"


def summary(valid: str, counted: str) -> str:
    base = enriched(valid).rstrip("\n")
    final = ", ".join(f"coalesce(max_by({name}, n), 0) AS {name}" for name in ("sma_20", "sma_50", "rsi_14", "vwap"))
    return f"""{base},
counts AS (SELECT ticker, count(*) AS tick_count FROM {counted} WHERE ticker IS NOT NULL GROUP BY ticker),
final AS (SELECT ticker, max_by(price, n) AS last_price, {final}, max(n) >= 50 AS ready FROM enriched GROUP BY ticker)
SELECT ticker, {r('coalesce(last_price, 0)', 'last_price')}, {r('coalesce(sma_20, 0)', 'sma_20')},
  {r('coalesce(sma_50, 0)', 'sma_50')}, {r('coalesce(rsi_14, 0)', 'rsi_14')}, {r('coalesce(vwap, 0)', 'vwap')},
  tick_count, coalesce(ready, false) AS indicators_ready
FROM counts LEFT JOIN final USING (ticker)"""


def judged(reason: str, columns: dict[str, str], where: str) -> str:
    listed = ", ".join(
        f"{text} AS {name}" if name in ("ts", "source", "ticker") else r(text, name) for name, text in columns.items()
    )
    return with_(RAW) + f"SELECT seq, {listed}, {reason} AS reject_reason FROM raw WHERE {where}"


def decoded() -> str:
    good = "seq % 89 <> 0 AND seq % 83 <> 0 AND seq % 79 <> 0 AND seq % 73 <> 0"
    whole = f"({good} AND seq % 71 <> 0)"
    return judged(
        f"CASE WHEN NOT ({good}) THEN 'malformed_json' WHEN NOT price > 0 THEN 'invalid_price' END",
        {
            "ticker": "coalesce(ticker, 'unknown')",
            "price": f"CASE WHEN {good} THEN price END",
            "open": f"CASE WHEN {whole} THEN open WHEN {good} THEN 0 END",
            "high": f"CASE WHEN {whole} THEN high WHEN {good} THEN 0 END",
            "low": f"CASE WHEN {whole} THEN low WHEN {good} THEN 0 END",
            "volume": f"CASE WHEN {good} THEN volume END",
            "ts": f"CASE WHEN {whole} THEN date_trunc('second', ts) ELSE ts END",
            "source": f"CASE WHEN {whole} THEN source ELSE 'unknown' END",
        },
        "true",
    )


def quotes_one() -> str:
    readable = "seq % 89 <> 0 AND seq % 73 <> 0"
    columns = {
        "ticker": "ticker",
        "price": f"CASE WHEN {readable} AND seq % 79 <> 0 THEN price END",
        "open": f"CASE WHEN {readable} THEN open END",
        "high": f"CASE WHEN {readable} AND seq % 83 <> 0 THEN high END",
        "low": f"CASE WHEN {readable} THEN low END",
        "volume": f"CASE WHEN {readable} THEN volume END",
        "ts": "ts + INTERVAL 1 MINUTE",
        "source": "'alpha_vantage'",
    }
    reason = (
        "CASE WHEN seq % 89 = 0 THEN 'rate_limited' WHEN seq % 73 = 0 THEN 'malformed_json' "
        "WHEN seq % 83 = 0 THEN 'missing_field:03. high' WHEN seq % 79 = 0 THEN 'bad_number:05. price' END"
    )
    return judged(reason, columns, "source = 'alpha_vantage'")


def quotes_two(exchange: bool = False) -> str:
    held = "seq % 83 <> 0"
    price = f"CASE WHEN {held} THEN price ELSE 0 END"
    traded = f"CASE WHEN {held} AND seq % 7 <> 0 THEN date_trunc('millisecond', ts) ELSE ts + INTERVAL 1 MINUTE END"
    columns = {
        "ticker": "ticker",
        **{name: price for name in ("price", "open", "high", "low")},
        "volume": f"CASE WHEN {held} AND seq % 79 <> 0 THEN volume ELSE 0 END",
        "ts": traded if exchange else "ts + INTERVAL 1 MINUTE",
        "source": "'massive'",
    }
    reason = "CASE WHEN seq % 83 = 0 THEN 'missing_results' WHEN seq % 89 = 0 THEN 'bad_status' END"
    return judged(reason, columns, "source = 'massive'")


def union() -> str:
    listed = f"seq, ticker, {r('price')}, {r('open')}, {r('high')}, {r('low')}, volume, ts, source"
    listed = listed.replace("volume,", "CAST(volume AS BIGINT) AS volume,")
    return f"""WITH one AS ({quotes_one()}), two AS ({quotes_two()})
SELECT {listed} FROM one WHERE reject_reason IS NULL UNION ALL SELECT {listed} FROM two WHERE reject_reason IS NULL"""


def grid() -> str:
    smas, rsis = (5, 10, 200), (1, 2, 7, 21)
    ctes = [cte for period in rsis for cte in rsi(period)]
    joins = " ".join(f"JOIN rsi_cte_{p} USING (seq)" for p in rsis)
    return (
        with_(RAW, VALID, numbered(), *ctes, recursive=True)
        + "SELECT seq, ticker, n AS tick_no, "
        + ", ".join(r(sma(p), f"sma_{p}") for p in smas)
        + ", "
        + ", ".join(r(f"rsi_{p}") for p in rsis)
        + f" FROM numbered {joins}"
    )


def one_rsi(period: int, seed: str = "zero") -> str:
    ctes = with_(RAW, VALID, numbered(), *rsi(period, seed), recursive=True)
    return ctes + f"SELECT seq, ticker, {r(f'rsi_{period}')} FROM numbered JOIN rsi_cte_{period} USING (seq)"


def daily_reset() -> str:
    valid = "valid AS (SELECT *, CAST(ts AS DATE) AS day FROM raw WHERE ticker IS NOT NULL AND price > 0)"
    by = "ticker, day"
    return (
        with_(RAW, valid, numbered(by), *rsi(3, by=by), recursive=True)
        + f"SELECT seq, ticker, n AS tick_no, {r(sma(5, by), 'sma_5')}, {r('rsi_3')}, {r(vwap(by), 'vwap')} "
        "FROM numbered JOIN rsi_cte_3 USING (seq)"
    )


def movers(extra: str, order: str, limit: int, series: str = "ticker") -> str:
    return (
        with_(
            RAW,
            VALID,
            f"""moved AS (SELECT {series}, arg_min(price, (ts, seq)) AS first_price, arg_max(price, (ts, seq)) AS last_price
  FROM valid WHERE ts >= {NOW} - INTERVAL 24 HOUR AND ts < {NOW} GROUP BY {series})""",
            "ranked AS (SELECT *, (last_price - first_price) / first_price * 100 AS change_pct FROM moved)",
        )
        + f"SELECT {series}, {r('first_price')}, {r('last_price')}, {r('change_pct')} FROM ranked {extra} "
        + (f"ORDER BY {order} DESC, {series} LIMIT {limit}" if limit else "")
    )


def ohlc(bucket: str, valid: str = VALID) -> str:
    return f"""bars AS (SELECT ticker, {bucket} AS bucket, arg_min(price, (ts, seq)) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, (ts, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS ticks,
    sum(CASE WHEN volume > 0 THEN (valid.high + valid.low + price) / 3.0 * volume ELSE 0 END) / nullif(sum(volume), 0) AS vwap
  FROM valid GROUP BY ALL)"""


BARS = f"SELECT ticker, bucket, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume, ticks FROM bars"


HALF_FLAT = """valid AS (SELECT * EXCLUDE total REPLACE (CASE WHEN ticker = 'T1' AND seq * 2 >= total THEN 100.0 ELSE price END AS price)
  FROM raw, (SELECT max(event_id) + 1 AS total FROM events)
  WHERE ticker IS NOT NULL AND price > 0 AND NOT (ticker = 'T2' AND seq * 10 < total * 6))"""
FINITE = {name: f"CASE WHEN isfinite({name}) THEN {name} ELSE 0 END" for name in ("open", "high", "low")}
DIRTY = """dirty AS (SELECT * REPLACE (
    CASE WHEN seq % 13 = 0 THEN 'nan'::DOUBLE WHEN seq % 17 = 0 THEN 'inf'::DOUBLE WHEN seq % 19 = 0 THEN '-inf'::DOUBLE ELSE price END AS price,
    CASE WHEN seq % 31 <> 0 THEN open END AS open,
    CASE WHEN seq % 23 = 0 THEN 'nan'::DOUBLE WHEN seq % 37 = 0 THEN 'inf'::DOUBLE ELSE high END AS high,
    CASE WHEN seq % 29 = 0 THEN '-inf'::DOUBLE ELSE low END AS low) FROM raw)"""
DIRTY_VALID = f"""{DIRTY},
valid AS (SELECT * REPLACE ({", ".join(f"coalesce({text}, 0) AS {name}" for name, text in FINITE.items())})
  FROM dirty WHERE ticker IS NOT NULL AND isfinite(price) AND price > 0)"""


def correlations(full: bool, valid: str = VALID) -> str:
    side = "<>" if full else "<"
    return (
        with_(
            RAW,
            valid,
            ohlc("date_trunc('hour', ts)"),
            "steps AS (SELECT ticker, bucket, close / lag(close) OVER (PARTITION BY ticker ORDER BY bucket) - 1 AS ret FROM bars)",
            "returns AS (SELECT * FROM steps WHERE ret IS NOT NULL)",
        )
        + f"""SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, count(*) AS n,
  {r('CASE WHEN min(a.ret) < max(a.ret) AND min(b.ret) < max(b.ret) THEN corr(a.ret, b.ret) END', 'corr')}
FROM returns a JOIN returns b ON a.bucket = b.bucket AND a.ticker {side} b.ticker GROUP BY ALL"""
    )


def backtests(valid: str = VALID) -> str:
    periods = sorted({rule[1] for rule in RULES if len(rule) == 4})
    ctes = [cte for period in periods for cte in rsi(period)]
    joins = " ".join(f"JOIN rsi_cte_{p} USING (seq)" for p in periods)
    parts = []
    for rule in RULES:
        if len(rule) == 3:
            _, fast, slow = rule
            position = f"CASE WHEN n >= {slow} AND ({sma(fast)}) > ({sma(slow)}) THEN 1 ELSE 0 END"
        else:
            _, period, low, high = rule
            position = (
                f"CASE WHEN n > {period} AND rsi_{period} < {low} THEN 1 "
                f"WHEN n > {period} AND rsi_{period} > {high} THEN -1 ELSE 0 END"
            )
        parts.append(f"SELECT '{rule[0]}' AS rule, ticker, n, price, {position} AS pos FROM numbered {joins}")
    return (
        with_(
            RAW,
            valid,
            numbered(),
            *ctes,
            "positions AS (" + "\n  UNION ALL ".join(parts) + ")",
            """made AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS before, lead(price) OVER w AS next_price,
    pos * coalesce(ln(lead(price) OVER w / price), 0) AS made
  FROM positions WINDOW w AS (PARTITION BY rule, ticker ORDER BY n))""",
            f"curve AS (SELECT *, sum(made) OVER (PARTITION BY rule, ticker ORDER BY n {FRAME}) AS level FROM made)",
            f"peaks AS (SELECT *, greatest(max(level) OVER (PARTITION BY rule, ticker ORDER BY n {FRAME}), 0) AS top FROM curve)",
            recursive=True,
        )
        + f"""SELECT ticker, rule, count(CASE WHEN pos <> 0 AND pos <> before THEN 1 END) AS trades,
  count(CASE WHEN pos <> 0 AND next_price IS NOT NULL THEN 1 END) AS held,
  {r("CAST(count(CASE WHEN pos <> 0 AND made > 0 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN pos <> 0 AND next_price IS NOT NULL THEN 1 END), 0)", "hit_rate")},
  {r("sum(made)", "log_return")}, {r("greatest(max(top - level), 0)", "max_drawdown")}
FROM peaks GROUP BY ticker, rule"""
    )


LOG = """log AS (
  SELECT concat('c', CAST(user_id AS VARCHAR)) AS client_id,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type IN ('view', 'purchase', 'signup') THEN 'subscribe' ELSE 'unsubscribe' END AS action,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE
      [concat('T', CAST(CAST(props::JSON->>'k' AS BIGINT) % 10 AS VARCHAR)), concat('T', CAST(event_id % 10 AS VARCHAR))] END AS tickers,
    ts, event_id AS seq, user_id
  FROM events)"""
# User 5 never connects and every seventh user (3, 10, 17, ...) has closed by the end.
CONNECTED = "user_id <> 5"
OPEN = f"{CONNECTED} AND user_id % 7 <> 3"
CLIENTS = f"""clients AS (SELECT DISTINCT client_id FROM log WHERE {OPEN} UNION ALL SELECT 'w0' UNION ALL SELECT 'w1')"""
SUBSCRIBED = f"""pairs AS (SELECT client_id, action, unnest(tickers) AS ticker, ts, seq FROM log
    WHERE {OPEN} AND action IS NOT NULL AND tickers IS NOT NULL),
subscribed AS (SELECT client_id, ticker FROM
    (SELECT client_id, ticker, arg_max(action, (ts, seq)) AS action FROM pairs GROUP BY client_id, ticker) WHERE action = 'subscribe')"""


# Every client at every moment its log names: the set that the actions up to then leave, and when the next one comes.
STATES = f"""moments AS (SELECT user_id, client_id, ts, seq FROM log WHERE {CONNECTED} AND action IS NOT NULL AND tickers IS NOT NULL
  UNION ALL SELECT user_id, client_id, min(ts) - INTERVAL 1 SECOND, -1 FROM log WHERE {CONNECTED} GROUP BY ALL
  UNION ALL SELECT -1, unnest(['w0', 'w1']), min(ts), -1 FROM log),
closes AS (SELECT client_id, max(ts) + INTERVAL 1 SECOND AS ts, -2 AS seq FROM log WHERE user_id % 7 = 3 GROUP BY client_id),
named AS (SELECT client_id, action, unnest(tickers) AS ticker, ts, seq FROM log WHERE {CONNECTED} AND action IS NOT NULL AND tickers IS NOT NULL),
latest AS (SELECT m.client_id, m.ts, m.seq, n.ticker, arg_max(n.action, (n.ts, n.seq)) AS action
  FROM moments m JOIN named n ON n.client_id = m.client_id AND (n.ts, n.seq) <= (m.ts, m.seq) GROUP BY ALL),
states AS (SELECT m.client_id, m.ts, m.seq, coalesce(list(l.ticker) FILTER (l.action = 'subscribe'), []) AS held
  FROM moments m LEFT JOIN latest l USING (client_id, ts, seq) GROUP BY m.client_id, m.ts, m.seq),
spells AS (SELECT s.client_id, s.ts, s.seq, held,
    coalesce(lead(s.ts) OVER w, c.ts) AS end_ts, coalesce(lead(s.seq) OVER w, c.seq) AS end_seq
  FROM states s LEFT JOIN closes c USING (client_id) WINDOW w AS (PARTITION BY s.client_id ORDER BY s.ts, s.seq))"""


def subscription_versions() -> str:
    """The subscriptions that each third of the log's time leaves, opens and closes included."""
    return (
        with_(
            LOG,
            f"""acts AS (SELECT client_id, action, tickers, ts, seq FROM log
  UNION ALL SELECT client_id, 'open', NULL, min(ts) - INTERVAL 1 SECOND, -1 FROM log WHERE {CONNECTED} GROUP BY client_id
  UNION ALL SELECT client_id, 'close', NULL, max(ts) + INTERVAL 1 SECOND, -2 FROM log WHERE {CONNECTED} AND user_id % 7 = 3 GROUP BY client_id
  UNION ALL SELECT unnest(['w0', 'w1']), 'open', NULL, min(ts), -1 FROM log)""",
            """cut AS (SELECT *, floor((epoch_us(ts) - low) * 3.0 / (high - low + 1)) AS chunk
  FROM acts, (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM acts))""",
            "upto AS (SELECT v AS version, cut.* FROM cut, (SELECT unnest([0, 1, 2]) AS v) WHERE chunk <= v)",
            """here AS (SELECT version, client_id FROM upto GROUP BY ALL
  HAVING count(*) FILTER (action = 'open') > 0 AND count(*) FILTER (action = 'close') = 0)""",
            """last AS (SELECT version, client_id, ticker, arg_max(action, (ts, seq)) AS action
  FROM (SELECT *, unnest(tickers) AS ticker FROM upto WHERE action IN ('subscribe', 'unsubscribe')) GROUP BY ALL)""",
        )
        + """SELECT h.version, h.client_id, coalesce(string_agg(ticker, ',' ORDER BY ticker) FILTER (action = 'subscribe'), '') AS tickers
FROM here h LEFT JOIN last l ON l.version = h.version AND l.client_id = h.client_id GROUP BY ALL"""
    )


def routed_in_time() -> str:
    return (
        with_(RAW, VALID, LOG, STATES)
        + """SELECT s.client_id, t.ticker, count(*) AS ticks, min(t.seq) AS first_seq, max(t.seq) AS last_seq
FROM valid t JOIN spells s ON s.ts <= t.ts AND (s.end_ts IS NULL OR t.ts <= s.end_ts)
  AND (s.ts, s.seq) <= (t.ts, t.seq) AND (s.end_ts IS NULL OR (t.ts, t.seq) < (s.end_ts, s.end_seq))
WHERE len(held) = 0 OR list_contains(held, t.ticker)
GROUP BY s.client_id, t.ticker"""
    )


def subscription_timelines() -> str:
    """From the states: a spell of a ticker begins where the state before did not hold it and ends where one does not."""
    return (
        with_(RAW, LOG, STATES)
        + """, held AS (SELECT client_id, ts, seq, unnest(CASE WHEN len(held) = 0 THEN [NULL] ELSE held END) AS ticker,
    row_number() OVER (PARTITION BY client_id ORDER BY ts, seq) AS n, end_ts, end_seq FROM spells),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY client_id, ticker ORDER BY n) AS run FROM held)
SELECT client_id, ticker, min(ts) AS since_ts, arg_min(seq, n) AS since_seq,
  arg_max(struct_pack(v := end_ts), n).v AS until_ts, CAST(arg_max(struct_pack(v := end_seq), n).v AS DOUBLE) AS until_seq
FROM runs GROUP BY client_id, ticker, run"""
    )


def routed() -> str:
    return (
        with_(RAW, VALID, LOG, CLIENTS, SUBSCRIBED)
        + """SELECT c.client_id, t.ticker, count(*) AS ticks, min(t.seq) AS first_seq, max(t.seq) AS last_seq
FROM valid t JOIN clients c ON EXISTS (SELECT 1 FROM subscribed s WHERE s.client_id = c.client_id AND s.ticker = t.ticker)
  OR NOT EXISTS (SELECT 1 FROM subscribed s WHERE s.client_id = c.client_id)
GROUP BY c.client_id, t.ticker"""
    )


def sql() -> dict[str, str]:
    base = with_(RAW, VALID)
    counted = with_(RAW, VALID, numbered())
    stored = points()
    recent = f"ts >= {NOW} - INTERVAL {{}} AND ts < {NOW}"
    history = (
        stored
        + f"SELECT ts, seq, {r('sma_20')}, {r('sma_50')}, {r('rsi_14')}, {r('vwap')} FROM points "
        + f"WHERE ticker = 'T3' AND sma_20 IS NOT NULL AND {recent.format('7 DAY')}"
    )
    long_parts = "\nUNION ALL ".join(
        f"SELECT ticker, source, ts, seq, '{name}' AS field, {r(name, 'value')} FROM points WHERE {name} IS NOT NULL" for name in FIELDS
    )
    market = (
        f"SELECT ticker, {r('arg_max(price, (ts, seq))', 'price')}, max(ts) AS ts FROM valid WHERE {recent.format('1 HOUR')} GROUP BY ticker"
    )
    per_source = (
        f"SELECT ticker, source, {r('arg_max(price, (ts, seq))', 'price')}, max(ts) AS ts FROM valid "
        f"WHERE {recent.format('24 HOUR')} GROUP BY ticker, source"
    )
    signals = (
        enriched()
        + """SELECT seq, ticker, CASE WHEN n > 14 THEN CASE WHEN rsi_14 > 70 THEN 'overbought' WHEN rsi_14 < 30 THEN 'oversold' ELSE 'neutral' END END AS rsi_signal,
  CASE WHEN vwap > 0 THEN CASE WHEN price > vwap * 1.001 THEN 'above' WHEN price < vwap * 0.999 THEN 'below' ELSE 'fair' END END AS vwap_signal
FROM enriched"""
    )
    all_feed = """, changed AS (SELECT client_id, count(*) AS changes FROM log
    WHERE user_id <> 5 AND action IS NOT NULL AND tickers IS NOT NULL GROUP BY client_id),
last_pairs AS (SELECT client_id, ticker, arg_max(action, (ts, seq)) AS action FROM
    (SELECT client_id, action, unnest(tickers) AS ticker, ts, seq FROM log WHERE user_id <> 5 AND action IS NOT NULL AND tickers IS NOT NULL)
    GROUP BY client_id, ticker),
lists AS (SELECT client_id, string_agg(ticker, ',' ORDER BY ticker) AS tickers FROM last_pairs WHERE action = 'subscribe' GROUP BY client_id)
SELECT client_id, changes, coalesce(tickers, '') AS tickers FROM changed LEFT JOIN lists USING (client_id)"""
    pos = "CASE WHEN volume > 0 AND high > 0 AND low > 0 THEN {} END"
    queries = {
        "tick_validate": base + f"SELECT seq, ticker, {r('price')}, {r('open')}, {r('high')}, {r('low')}, volume, ts, source FROM valid",
        "tick_rejects": with_(RAW)
        + "SELECT seq, CASE WHEN ticker IS NULL THEN 'missing_ticker' ELSE 'invalid_price' END AS reject_reason FROM raw "
        "WHERE ticker IS NULL OR NOT price > 0",
        "tick_reject_counts": with_(RAW)
        + "SELECT CASE WHEN ticker IS NULL THEN 'missing_ticker' ELSE 'invalid_price' END AS reject_reason, count(*) AS n FROM raw "
        "WHERE ticker IS NULL OR NOT price > 0 GROUP BY 1",
        "storable_ticks": with_(RAW) + f"SELECT seq, ticker, {r('price')} FROM raw WHERE ticker IS NOT NULL AND price IS NOT NULL",
        "watchlist": base + f"SELECT seq, ticker, {r('price')} FROM valid WHERE ticker IN ('T1', 'T3', 'T5')",
        "decoded_messages": decoded(),
        "quotes_source1": quotes_one(),
        "quotes_source2": quotes_two(),
        "quotes_source2_exchange": quotes_two(exchange=True),
        "ticks_union": union(),
        "sma_20": counted + f"SELECT seq, ticker, {r(sma(20), 'sma_20')} FROM numbered",
        "sma_50": counted + f"SELECT seq, ticker, {r(sma(50), 'sma_50')} FROM numbered",
        "rsi_14_zero": one_rsi(14),
        "rsi_14_wilder": one_rsi(14, "wilder"),
        "rsi_7_zero": one_rsi(7),
        "vwap_running": counted + f"SELECT seq, ticker, {r(vwap(), 'vwap')}, ({vwap()}) > 0 AS vwap_ready FROM numbered",
        "vwap_daily": counted + f"SELECT seq, ticker, {r(vwap('ticker, CAST(ts AS DATE)'), 'vwap')} FROM numbered",
        "vwap_total": base
        + f"SELECT ticker, {r('sum(' + pos.format('(high + low + price) / 3.0 * volume') + ') / sum(' + pos.format('volume') + ')', 'vwap')} FROM valid GROUP BY ticker",
        "daily_reset": daily_reset(),
        "enriched_ticks": enriched() + FLAT,
        "enriched_hot_ticker": enriched(HOT) + FLAT,
        "indicator_grid": grid(),
        "signals": signals,
        "ticker_summary": summary(VALID, "raw"),
        "ticker_summary_hot": summary(HOT, "valid"),
        "batch_counters": with_(RAW)
        + "SELECT count(*) AS ticks, count(ticker) AS ticks_with_ticker, count(CASE WHEN ticker IS NOT NULL AND price > 0 THEN 1 END) AS ticks_valid FROM raw",
        "stored_raw_points": with_(RAW)
        + "SELECT ticker, coalesce(source, 'unknown') AS source, ts, seq, round(price, 6) AS price, "
        + ", ".join(f"round(coalesce({name}, 0), 6) AS {name}" for name in ("open", "high", "low"))
        + ", coalesce(volume, 0) AS volume, "
        + ", ".join(f"CAST(NULL AS DOUBLE) AS {name}" for name in ("sma_20", "sma_50", "rsi_14", "vwap"))
        + " FROM raw WHERE ticker IS NOT NULL AND price IS NOT NULL",
        "stored_points": stored + f"SELECT {POINT_LIST} FROM points",
        "points_long": stored + long_parts,
        "points_wide": stored + "SELECT ticker, source, ts, seq, " + ", ".join(r(name) for name in FIELDS) + " FROM points",
        "store_scan": history,
        "latest_tick": stored + f"SELECT {POINT_LIST} FROM points WHERE ticker = 'T3' AND {recent.format('1 HOUR')} ORDER BY ts DESC, seq DESC LIMIT 1",
        "price_history": base + f"SELECT ts, seq, {r('price')} FROM valid WHERE ticker = 'T3' AND {recent.format('24 HOUR')}",
        "indicator_history": history,
        "top_movers": movers("", "change_pct", 5),
        "top_movers_abs": movers("", "abs(change_pct)", 5),
        "top_movers_per_source": movers("", "change_pct", 7, "ticker, source"),
        "first_last_join": movers("", "", 0),
        "market_summary": base + market,
        "market_summary_per_source": base + per_source,
        "newest_n": base
        + f"SELECT seq, ticker, {r('price')} FROM valid QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, seq DESC) <= 25",
        "newest_overall": base + f"SELECT seq, {r('price')} FROM valid ORDER BY ts DESC, valid.seq DESC LIMIT 100",
        "oldest_n": base + f"SELECT seq, {r('price')} FROM valid ORDER BY ts, valid.seq LIMIT 500",
        "overwritten": base + "SELECT ticker, greatest(count(*) - 100, 0) AS overwritten FROM valid GROUP BY ticker",
        "known_actions": with_(LOG)
        + f"SELECT client_id, action, seq FROM log WHERE {CONNECTED} AND action IS NOT NULL AND tickers IS NOT NULL",
        "subscription_state": with_(LOG, SUBSCRIBED) + "SELECT client_id, ticker FROM subscribed",
        "subscription_lists": with_(LOG, CLIENTS, SUBSCRIBED)
        + "SELECT client_id, coalesce(string_agg(ticker, ',' ORDER BY ticker), '') AS tickers FROM clients LEFT JOIN subscribed USING (client_id) GROUP BY client_id",
        "subscription_timelines": subscription_timelines(),
        "routed_ticks": routed_in_time(),
        "routed_by_final_sets": routed(),
        "candles_1h": with_(RAW, VALID, ohlc("date_trunc('hour', ts)")) + BARS,
        "candles_1m": with_(RAW, VALID, ohlc("date_trunc('minute', ts)")) + BARS,
        "daily_summary": with_(RAW, VALID, ohlc("CAST(ts AS DATE)"))
        + f"SELECT ticker, CAST(bucket AS VARCHAR) AS dt, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume, ticks, {r('coalesce(vwap, 0)', 'vwap')}, "
        + r("(close - open) / open * 100", "change_pct")
        + ", "
        + r("(close / lag(close) OVER (PARTITION BY ticker ORDER BY bucket) - 1) * 100", "day_change_pct")
        + ", "
        + r("(high - low) / low * 100", "range_pct")
        + " FROM bars",
        "correlation": correlations(full=False),
        "correlation_blocks": correlations(full=True),
        "correlation_flat": correlations(False, HALF_FLAT),
        "dirty_numbers": with_(RAW, DIRTY)
        + "SELECT ticker, coalesce(source, 'unknown') AS source, ts, seq, round(price, 6) AS price, "
        + ", ".join(f"round(coalesce({text}, 0), 6) AS {name}" for name, text in FINITE.items())
        + ", coalesce(volume, 0) AS volume, "
        + ", ".join(f"CAST(NULL AS DOUBLE) AS {name}" for name in FIELDS[5:])
        + " FROM dirty WHERE ticker IS NOT NULL AND isfinite(price)",
        "dirty_rejects": with_(RAW, DIRTY)
        + "SELECT seq, CASE WHEN ticker IS NULL THEN 'missing_ticker' ELSE 'price_not_finite' END AS reject_reason"
        + " FROM dirty WHERE ticker IS NULL OR NOT coalesce(isfinite(price), false)",
        "dirty_points": enriched(DIRTY_VALID).rstrip("\n") + ",\n" + points_cte() + "\n" + f"SELECT {POINT_LIST} FROM points",
        "backtest": backtests(),
        "backtest_hot": backtests(HOT),
        "stream_late": late(),
        "stream_candles": with_(RAW, VALID, ohlc("date_trunc('hour', ts)"))
        + BARS
        + " WHERE bucket + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM valid)) - INTERVAL 1 HOUR",
        "stream_two_sinks": base + "SELECT ticker, count(*) AS stored, count(*) AS sent FROM valid GROUP BY ticker",
        "stream_health": with_(RAW)
        + "SELECT 5 AS batches, count(*) AS ticks, count(CASE WHEN ticker IS NOT NULL AND price > 0 THEN 1 END) AS valid, "
        "count(CASE WHEN ticker IS NOT NULL AND price > 0 THEN 1 END) AS points FROM raw",
        "stream_subscriptions": subscription_versions(),
        "stream_feed": with_(LOG).rstrip("\n") + all_feed,
    }
    queries["routed_ticks_salted"] = queries["routed_ticks"]
    queries["routed_by_final_sets_salted"] = queries["stream_routed"] = queries["routed_by_final_sets"]
    queries["stream_enriched"] = queries["stream_topics"] = queries["enriched_ticks"]
    queries["stream_routed_in_time"] = queries["routed_ticks"]
    queries["stream_newest_n"], queries["stream_overwritten"] = queries["newest_n"], queries["overwritten"]
    queries["known_actions_salted"] = queries["known_actions"]
    queries["stream_summary"] = summary(BY_BATCH, "batched")
    queries["stream_points"] = queries["store_committed"] = queries["stored_points"]
    queries["stream_dirty_points"] = queries["dirty_points"]
    return queries
