"""The same results in SQL, for the driver's comparison."""

from __future__ import annotations

_READINGS = """cur AS (SELECT series_ref, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY series_ref, ts ORDER BY seq DESC) AS rn FROM samples) WHERE rn = 1),
readings AS (SELECT * FROM cur WHERE value IS NOT NULL AND isfinite(value))"""

_HASH = """CASE WHEN length(trim(series_hash)) > 16 AND NOT starts_with(lower(trim(series_hash)), '0x')
  THEN lpad(lower(to_hex(CAST(trim(series_hash) AS UBIGINT))), 16, '0')
  ELSE lpad(regexp_replace(lower(trim(series_hash)), '^0x', ''), 16, '0') END"""

_RES = """CASE WHEN lower(trim(resolution)) IN ('1m', '60s', '1m0s') THEN '1m' WHEN lower(trim(resolution)) IN ('5m', '300s', '5m0s') THEN '5m'
  WHEN lower(trim(resolution)) IN ('1h', '60m', '3600s', '1h0m0s') THEN '1h' END"""

_STEP = "CASE resolution WHEN '1m' THEN 60000 WHEN '5m' THEN 300000 ELSE 3600000 END"

P1_FOUND = f"""WITH {_READINGS},
pts AS (SELECT 'samples' AS origin, series_hash, resolution, ts FROM readings JOIN series USING (series_ref)
  UNION ALL SELECT 'rollup_points', {_HASH}, {_RES}, ts FROM rollup_points WHERE v_count > 0),
g AS (SELECT DISTINCT origin, series_hash, resolution, {_STEP} AS step, ts // ({_STEP}) AS b FROM pts),
ends AS (SELECT origin, series_hash, resolution, step, min(b) AS lo, max(b) AS hi FROM g GROUP BY ALL),
grid AS (SELECT origin, series_hash, resolution, step, unnest(generate_series(lo, hi)) AS b FROM ends)
SELECT origin, series_hash, resolution, b * step AS ts FROM grid ANTI JOIN g USING (origin, series_hash, resolution, b)"""

P1_GRID = f"""WITH {_READINGS},
pts AS (SELECT series_ref, series_hash, resolution, {_STEP} AS step, ts, value FROM readings JOIN series USING (series_ref)),
g AS (SELECT series_ref, series_hash, resolution, step, ts // step AS b, count(*) AS n, arg_max(value, ts) AS v FROM pts GROUP BY ALL),
grid AS (SELECT series_ref, series_hash, resolution, step, unnest(generate_series(min(b), max(b))) AS b FROM g GROUP BY series_ref, series_hash, resolution, step),
j AS (SELECT grid.*, g.n, g.v, last_value(CASE WHEN g.n > 0 THEN g.b END IGNORE NULLS) OVER w AS lb, last_value(CASE WHEN g.n > 0 THEN g.v END IGNORE NULLS) OVER w AS lv
  FROM grid LEFT JOIN g USING (series_ref, series_hash, resolution, step, b) WINDOW w AS (PARTITION BY grid.series_ref, grid.resolution ORDER BY grid.b))
SELECT series_ref, series_hash, resolution, CAST(step AS BIGINT) AS period_ms, b * step AS period_start, coalesce(n, 0) AS n,
  CASE WHEN b - lb <= 5 THEN lv END AS value, CASE WHEN n > 0 THEN 'observed' WHEN b - lb <= 5 THEN 'filled' ELSE 'missing' END AS status FROM j"""

P2_FOUND = """WITH b AS (SELECT store, CAST(min_time AS HUGEINT) AS s, CAST(max_time AS HUGEINT) AS e FROM blocks WHERE min_time <= max_time),
m AS (SELECT *, max(e) OVER (PARTITION BY store ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
h AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY store ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
p AS (SELECT store, g, min(s) AS s, max(e) AS e FROM h GROUP BY ALL),
q AS (SELECT *, lag(e) OVER (PARTITION BY store ORDER BY s) AS pe FROM p)
SELECT store, 'period' AS kind, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms FROM q
UNION ALL SELECT store, 'gap', CAST(pe + 1 AS BIGINT), CAST(s - 1 AS BIGINT) FROM q WHERE pe IS NOT NULL"""

_TRAIL = f"""{_READINGS},
d AS (SELECT series_ref, ts // 86400000 AS dd, sum(value) AS s, count(*) AS n FROM readings GROUP BY ALL),
days AS (SELECT series_ref, unnest(generate_series(min(dd), max(dd))) AS dd FROM d GROUP BY series_ref),
f AS (SELECT series_ref, dd, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM days LEFT JOIN d USING (series_ref, dd)),
t AS (SELECT series_ref, dd, CAST(7 AS INT) AS trailing_days, sum(s) OVER w AS total, CAST(sum(n) OVER w AS BIGINT) AS n FROM f WINDOW w AS (PARTITION BY series_ref ORDER BY dd ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
  UNION ALL SELECT series_ref, dd, CAST(30 AS INT), sum(s) OVER w, CAST(sum(n) OVER w AS BIGINT) FROM f WINDOW w AS (PARTITION BY series_ref ORDER BY dd ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, strftime(DATE '1970-01-01' + CAST(dd AS INT), '%Y-%m-%d') AS day FROM t)"""

P3_TOTALS = f"""WITH {_TRAIL} SELECT series_ref, trailing_days, day, total, n, CASE WHEN n > 0 THEN total / n END AS average FROM x"""

P3_FOUND = f"""WITH {_TRAIL}
SELECT 'silent' AS kind, series_ref, trailing_days, day FROM x WHERE n = 0
UNION ALL SELECT 'peak', series_ref, trailing_days, day FROM (SELECT *, row_number() OVER (PARTITION BY series_ref, trailing_days ORDER BY total DESC, dd) AS rn FROM x WHERE n > 0) WHERE rn = 1"""

_WAL = r"""w AS (SELECT record_id, producer, series_ref, samples, written_at,
  CASE WHEN d <> '' THEN coalesce(nullif(ltrim(d, '0'), ''), '0') END AS m
  FROM (SELECT *, regexp_replace(regexp_replace(lower(entry_id), '^[^0-9a-z]*0x', ''), '[^0-9a-f]', '', 'g') AS d FROM wal_entries)),
k AS (SELECT *, array_to_string(list_sort(list_distinct(list_transform(samples, lambda s: concat(s.ts, ':', s.value)))), ',') AS c FROM w)"""

P4_FOUND = f"""WITH {_WAL}
SELECT record_id FROM k WHERE record_id > (SELECT min(record_id) FROM k AS o WHERE o.producer = k.producer AND o.m = k.m)
UNION SELECT record_id FROM k WHERE m IS NULL AND record_id > (SELECT min(record_id) FROM k AS o WHERE o.producer = k.producer AND o.series_ref = k.series_ref AND o.c = k.c)
UNION SELECT record_id FROM k WHERE m IS NOT NULL AND record_id > (SELECT min(record_id) FROM k AS o WHERE o.m IS NULL AND o.producer = k.producer AND o.series_ref = k.series_ref AND o.c = k.c)"""

P4_MESSAGES = f"""WITH {_WAL} SELECT record_id, producer, m AS message FROM (SELECT *, row_number() OVER (PARTITION BY producer, m ORDER BY written_at NULLS FIRST, record_id) AS rn FROM k WHERE m IS NOT NULL) WHERE rn = 1"""

P4_DELIVERED = f"""WITH {_WAL} SELECT record_id, producer, m AS message FROM k WHERE record_id NOT IN ({P4_FOUND})"""

P5_FOUND = f"SELECT DISTINCT {_HASH} AS series_hash, {_RES} AS resolution, ts FROM rollup_points"

_JUDGED = """j AS (SELECT series_ref, ts, value, isinf(value) OR CASE metric WHEN 'cpu_busy_percent' THEN value < 0 OR value > 100 WHEN 'humidity_percent' THEN value < 0 OR value > 100
  WHEN 'error_ratio' THEN value < 0 OR value > 1 WHEN 'temperature_celsius' THEN value < -273.15 ELSE value < 0 END AS bad
  FROM (SELECT *, row_number() OVER (PARTITION BY series_ref, ts ORDER BY seq DESC) AS rn FROM samples) WHERE rn = 1 AND value IS NOT NULL AND NOT isnan(value))"""

P6_IMPOSSIBLE = f"WITH {_JUDGED} SELECT series_ref, ts FROM j WHERE bad"

P6_STUCK = f"""WITH {_JUDGED},
a AS (SELECT *, lag(value) OVER (PARTITION BY series_ref ORDER BY ts) AS before, row_number() OVER (PARTITION BY series_ref ORDER BY ts) AS i FROM j),
b AS (SELECT *, sum(CASE WHEN i > 1 AND value = before THEN 0 ELSE 1 END) OVER (PARTITION BY series_ref ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY series_ref, run) AS length FROM b),
s AS (SELECT series_ref, count(*) AS n, count(*) FILTER (WHERE length < 12) AS short, count(*) FILTER (WHERE length < 12 AND i > 1 AND value = before) AS again FROM c GROUP BY 1),
l AS (SELECT series_ref, CASE WHEN short < 0.25 * n THEN NULL WHEN again = 0 THEN 12 ELSE greatest(12, 1 + ln(0.01 / n) / ln(least(again / short, 0.999))) END AS least FROM s)
SELECT series_ref, ts FROM c JOIN l USING (series_ref) WHERE length >= least AND NOT bad"""

def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_grid": P1_GRID, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_totals": P3_TOTALS, "p4_found": P4_FOUND, "p4_messages": P4_MESSAGES, "p4_delivered": P4_DELIVERED, "p5_found": P5_FOUND, "p5_incremental": P5_FOUND, "p6_impossible": P6_IMPOSSIBLE, "p6_stuck": P6_STUCK}
