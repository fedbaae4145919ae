"""Common table expressions of the reference SQL (the same panels, written for DuckDB)."""


def rnd(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


LEAST = 12           # statistics of fewer observations are NULL; their row stays with its count


def shown(expr: str, name: str, n: str = "n") -> str:
    return rnd(f"CASE WHEN {n} >= {LEAST} THEN {expr} END", name)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


NM = """nm AS (
  SELECT c.c_nationkey AS entity, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS ref_month,
         CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 104729.0 AS v,
         count(*) AS n,
         CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1009.0 AS p
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)"""

# complete monthly grid per entity
GRID = """grid AS (
  SELECT s.entity, s.ref_month, nm.v, nm.n, nm.p FROM (
    SELECT entity, CAST(unnest(generate_series(min(ref_month), max(ref_month), INTERVAL 1 MONTH)) AS DATE) AS ref_month
    FROM nm GROUP BY entity) s
  LEFT JOIN nm ON nm.entity = s.entity AND nm.ref_month = s.ref_month)"""

REGS = """regs AS (
  SELECT nm.*, x.qty, x.disc, x.tax FROM nm LEFT JOIN (
    SELECT c.c_nationkey AS entity, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS ref_month,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 997.0 AS qty,
           CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS disc,
           CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS tax
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
    GROUP BY 1, 2) x ON nm.entity = x.entity AND nm.ref_month = x.ref_month)"""

LONG = """lng AS (
  SELECT entity, ref_month, 'v' AS series_id, v AS value FROM nm UNION ALL
  SELECT entity, ref_month, 'n', CAST(n AS DOUBLE) FROM nm UNION ALL
  SELECT entity, ref_month, 'p', p FROM nm)"""

TWO = """two AS (
  SELECT c.c_nationkey AS entity, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS ref_month,
         CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 104729.0 AS a,
         CASE WHEN date_trunc('month', o.o_orderdate) < DATE '2001-01-01' THEN
           CAST(sum(CASE WHEN o.o_orderstatus <> 'P' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE)
             / 104729.0 * CAST(1.07 AS DOUBLE) END AS b
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey, date_trunc('month', o.o_orderdate))"""

REL = """rel AS (
  SELECT entity, ref_month, realtime_start,
         CAST(sum(amount) OVER (PARTITION BY entity, ref_month ORDER BY realtime_start) AS DOUBLE) / 104729.0 AS value
  FROM (SELECT c.c_nationkey AS entity, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS ref_month,
               CAST(l.l_shipdate AS DATE) AS realtime_start, sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS amount
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        WHERE CAST(l.l_shipdate AS DATE) >= CAST(o.o_orderdate AS DATE) GROUP BY 1, 2, 3))"""

DAILY = """daily AS (
  SELECT event_type, CAST(ts AS DATE) AS day,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 7.0 AS value, count(*) AS n,
         max_by(value, struct_pack(ts := ts, event_id := event_id)) / 7.0 AS last_value
  FROM events GROUP BY 1, 2)"""


def hac_slope(name: str, src: str, y: str, x: str, lags: int) -> str:
    """CTEs ending in ``name``(entity, n, slope, const, r2, se): one-regressor OLS, Bartlett HAC."""
    weights = " + ".join(["s * s"] + [f"2 * {1 - j / (lags + 1)}::DOUBLE * s * coalesce(lag(s, {j}) OVER o, 0)" for j in range(1, lags + 1)])
    return f"""{name}_f AS (SELECT entity, count(*) AS n, regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a, regr_r2({y}, {x}) AS r2, avg({x}) AS mx, regr_sxx({y}, {x}) AS sxx
   FROM {src} WHERE {y} IS NOT NULL AND {x} IS NOT NULL GROUP BY 1 HAVING count(*) > 2),
 {name}_s AS (SELECT t.entity, t.ref_month, ({x} - mx) * ({y} - a - b * {x}) AS s FROM {src} t JOIN {name}_f f ON f.entity = t.entity WHERE {y} IS NOT NULL AND {x} IS NOT NULL),
 {name}_w AS (SELECT entity, {weights} AS q FROM {name}_s WINDOW o AS (PARTITION BY entity ORDER BY ref_month)),
 {name} AS (SELECT f.entity, n, b AS slope, a AS const, r2, sqrt(m.q) / sxx AS se FROM {name}_f f JOIN (SELECT entity, sum(q) AS q FROM {name}_w GROUP BY 1) m ON m.entity = f.entity)"""


COMP = """comp AS (SELECT *, CASE WHEN gap_a IS NOT NULL AND gap_b IS NOT NULL THEN (0.5 * gap_a + 0.5 * gap_b) / 1.0 END AS ect FROM (
  SELECT entity, ref_month, p, v, n, ln(p) AS level, CASE WHEN count(v) OVER o = 12 THEN ln(v / avg(v) OVER o) END AS gap_a,
    CASE WHEN count(p) OVER o = 12 THEN ln(p / avg(p) OVER o) END AS gap_b FROM grid
  WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)))"""


def target_cte(name: str, src: str, x: str, horizons: str) -> str:
    return f"""{name} AS (SELECT c.entity, k.h, c.ref_month, c.{x} AS x, d.level - c.level AS y FROM {src} c CROSS JOIN (VALUES {horizons}) k(h)
  LEFT JOIN {src} d ON d.entity = c.entity AND d.ref_month = CAST(c.ref_month + INTERVAL 1 MONTH * k.h AS DATE))"""


def forecast_cte(name: str, tgt: str, min_train: int) -> str:
    return f"""{name} AS (SELECT o.entity, o.h, o.ref_month, o.x, o.y, avg(t.y) AS f_drift, regr_intercept(t.y, t.x) + regr_slope(t.y, t.x) * o.x AS f_model,
   regr_slope(t.y, t.x) AS slope, regr_intercept(t.y, t.x) AS const, count(*) AS n_train
  FROM {tgt} o JOIN {tgt} t ON t.entity = o.entity AND t.h = o.h AND t.x IS NOT NULL AND t.y IS NOT NULL AND CAST(t.ref_month + INTERVAL 1 MONTH * t.h AS DATE) <= o.ref_month
  WHERE o.x IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= {min_train})"""


def mean_test_cte(name: str, src: str, x: str, by: str = "entity, h", lags: str = "h - 1") -> str:
    """CTEs ending in ``name``(by, n, mean, t): Bartlett long-run variance of a mean."""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    cols = ", ".join(f"a.{c.strip()}" for c in by.split(","))
    lag = lags.replace("h", "a.h") if "h" in lags else lags
    return f"""{name}_d AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY ref_month) AS rn, {x} AS raw, {x} - avg({x}) OVER (PARTITION BY {by}) AS e FROM {src} WHERE {x} IS NOT NULL),
 {name}_l AS (SELECT {cols}, sum(CASE WHEN a.rn = b.rn THEN 1.0 ELSE 2 * (1 - (a.rn - b.rn) / CAST({lag} + 1 AS DOUBLE)) END * a.e * b.e) AS q
   FROM {name}_d a JOIN {name}_d b ON {on} AND b.rn <= a.rn AND a.rn - b.rn <= {lag} GROUP BY {cols}),
 {name} AS (SELECT {cols}, count(*) AS n, avg(raw) AS mean, avg(raw) / sqrt(any_value(q) / count(*) / count(*)) AS t FROM {name}_d a JOIN {name}_l b ON {on} GROUP BY {cols})"""


def ols_cte(name: str, src: str, by: str, y: str, xs: list[str], keep: str = "") -> str:
    """CTEs ending in ``name``: the rows of ``src`` (none of whose ``xs`` and ``y`` is NULL) with ``by``, ``keep``, the number of rows n, the
    coefficients b0.. of ``xs``, the residual e, the sum of squares zz and the cross sum zy of the last
    regressor after the others are taken out, and ssr. The columns are made orthogonal one after the other."""
    p, extra = len(xs), f", {keep}" if keep else ""
    names = [f"q{i}" for i in range(p)] + ["qy"]
    parts = [f"{name}_0 AS (SELECT {by}{extra}, " + ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for c, n in zip([*xs, y], names)) + f" FROM {src})"]
    known = ""
    for i in range(p):
        rest = names[i + 1:]
        ratios = ", ".join(f"sum(q{i} * {n}) OVER w / sum(q{i} * q{i}) OVER w AS r{i}_{n}" for n in rest)
        parts.append(f"{name}_r{i} AS (SELECT *, {ratios} FROM {name}_{i} WINDOW w AS (PARTITION BY {by}))")
        known += "".join(f", r{i}_{n}" for n in rest)
        kept = ", ".join([f"q{j}" for j in range(i + 1)] + [f"{n} - r{i}_{n} * q{i} AS {n}" for n in rest])
        parts.append(f"{name}_{i + 1} AS (SELECT {by}{extra}{known}, {kept} FROM {name}_r{i})")
    last = f"{name}_{p}"
    for i in reversed(range(p)):
        step = f"{name}_b{i}"
        parts.append(f"{step} AS (SELECT *, r{i}_qy" + "".join(f" - r{i}_q{j} * b{j}" for j in range(i + 1, p)) + f" AS b{i} FROM {last})")
        last = step
    z = f"q{p - 1}"
    parts.append(f"{name} AS (SELECT {by}{extra}, " + ", ".join(f"b{i}" for i in range(p)) + f", qy AS e, count(*) OVER w AS n, sum({z} * {z}) OVER w AS zz, sum({z} * {z}) OVER w * b{p - 1} AS zy, "
                 f"sum(qy * qy) OVER w AS ssr FROM {last} WINDOW w AS (PARTITION BY {by}))")
    return ",\n ".join(parts)


def trend_cte(name: str, src: str, time: str, value: str, smooth: float, two_sided: bool = False) -> str:
    """CTEs (of a WITH RECURSIVE) ending in ``name``(entity, time, rn, trend): level and slope filtered row by row, and smoothed back.

    The covariance (a, b; b, c) does not depend on the data: one recursion over positions, then one over the rows."""
    q = f"(1 / {smooth}::DOUBLE)"
    ahead = f"a + 2 * b + c + {q} AS a1, b + c + {q} AS b1, c + {q} AS c1"
    parts = f"""{name}_n AS (SELECT entity, {time}, CAST({value} AS DOUBLE) AS y, row_number() OVER (PARTITION BY entity ORDER BY {time}) AS rn FROM {src} WHERE {value} IS NOT NULL),
 {name}_g AS (SELECT 2::BIGINT AS rn, 1::DOUBLE AS a, 1::DOUBLE AS b, 2::DOUBLE AS c, 0::DOUBLE AS g, 0::DOUBLE AS h
  UNION ALL SELECT rn + 1, a1 - a1 * a1 / (a1 + 1), b1 - a1 * b1 / (a1 + 1), c1 - b1 * b1 / (a1 + 1), a1 / (a1 + 1), b1 / (a1 + 1)
   FROM (SELECT rn, {ahead} FROM {name}_g) WHERE rn < (SELECT max(rn) FROM {name}_n)),
 {name}_f AS (SELECT t.entity, t.{time}, t.rn, t.y AS m, t.y - u.y AS d FROM {name}_n t JOIN {name}_n u ON u.entity = t.entity AND u.rn = 1 WHERE t.rn = 2
  UNION ALL SELECT f.entity, t.{time}, t.rn, f.m + f.d + k.g * (t.y - f.m - f.d), f.d + k.h * (t.y - f.m - f.d)
   FROM {name}_f f JOIN {name}_n t ON t.entity = f.entity AND t.rn = f.rn + 1 JOIN {name}_g k ON k.rn = t.rn)"""
    if not two_sided:
        return parts + f""",
 {name} AS (SELECT entity, {time}, rn, m AS trend FROM {name}_f UNION ALL SELECT entity, {time}, rn, y FROM {name}_n WHERE rn = 1)"""
    return parts + f""",
 {name}_j AS (SELECT rn, ((a + b) * c1 - b * b1) / det AS j00, (b * a1 - (a + b) * b1) / det AS j01, ((b + c) * c1 - c * b1) / det AS j10, (c * a1 - (b + c) * b1) / det AS j11
   FROM (SELECT *, a1 * c1 - b1 * b1 AS det FROM (SELECT rn, a, b, c, {ahead} FROM {name}_g))),
 {name}_s AS (SELECT entity, {time}, rn, m, d FROM {name}_f WHERE (entity, rn) IN (SELECT entity, max(rn) FROM {name}_f GROUP BY 1)
  UNION ALL SELECT f.entity, f.{time}, f.rn, f.m + j00 * (s.m - f.m - f.d) + j01 * (s.d - f.d), f.d + j10 * (s.m - f.m - f.d) + j11 * (s.d - f.d)
   FROM {name}_s s JOIN {name}_f f ON f.entity = s.entity AND f.rn = s.rn - 1 JOIN {name}_j j ON j.rn = f.rn),
 {name} AS (SELECT entity, {time}, rn, m AS trend FROM {name}_s UNION ALL SELECT n.entity, n.{time}, n.rn, coalesce(s.m - s.d, n.y) FROM {name}_n n LEFT JOIN {name}_s s ON s.entity = n.entity AND s.rn = 2 WHERE n.rn = 1)"""
