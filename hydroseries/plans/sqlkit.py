"""DuckDB oracle SQL pieces for the driver queries.

These strings are the independent statement of each query in plain SQL, run
by the driver's DuckDB against the same parquet tables.  They mirror
``staging`` (``obs``, ``sites``, the two feeds) and the operator semantics with
un-chunked windows.
"""

from __future__ import annotations

W = "PARTITION BY site_id ORDER BY ts"
UP = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DOWN = f"({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

OBS_SELECT = """SELECT event_type AS site_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
  avg(value) / 40.0 AS local_water_level_m,
  sum(greatest(value - 100.0, 0.0)) / 10.0 AS rain_1h,
  avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS humidity
FROM {src} GROUP BY 1, 2"""

OBS = "obs AS (" + OBS_SELECT.format(src="events") + ")"
FEED0 = "feed0 AS (" + OBS_SELECT.format(src="(SELECT * FROM events WHERE minute(ts) < 30)") + ")"
FEED1 = "feed1 AS (" + OBS_SELECT.format(src="(SELECT * FROM events WHERE minute(ts) >= 30)") + ")"
SPANS = "spans AS (SELECT site_id, min(ts) AS s, max(ts) AS e FROM obs GROUP BY 1)"
GRID = "grid AS (SELECT site_id, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS ts FROM spans)"
DENSE = ("dense AS (SELECT g.site_id, g.ts, o.local_water_level_m, o.rain_1h, o.humidity "
         "FROM grid g LEFT JOIN obs o ON g.site_id = o.site_id AND g.ts = o.ts)")
SITES = ("sites AS (SELECT e.site_id, n.n_name AS site_name, "
         "CAST(n.n_regionkey AS DOUBLE) * 10.0 + CAST(n.n_nationkey AS DOUBLE) * 0.5 AS elevation_m, "
         "CAST(n.n_nationkey AS DOUBLE) * 0.01 AS lon, CAST(n.n_regionkey AS DOUBLE) * 0.01 AS lat "
         "FROM (SELECT DISTINCT event_type AS site_id FROM events) e JOIN nation n ON length(e.site_id) = n.n_nationkey)")
# with the fourth sensor of ``staging.obs(sea=True)``
OBS_SEA = OBS.replace("AS humidity\n", "AS humidity,\n  max(value) / 50.0 AS sea_level_m\n")
DENSE_SEA = DENSE.replace("o.humidity ", "o.humidity, o.sea_level_m ")
COLS = ("local_water_level_m", "rain_1h", "humidity")
RAIN = ("rain_1h",)


def ep(ts: str = "ts") -> str:
    return f"CAST(epoch({ts}) AS DOUBLE)"


def neighbours(c: str, src: str = "dense") -> str:
    """Previous / next observed (time, value) of column ``c``."""
    t = f"CASE WHEN {c} IS NOT NULL THEN {ep()} END"
    return (f"last_value({t} IGNORE NULLS) OVER {UP} AS _pt_{c}, "
            f"last_value({c} IGNORE NULLS) OVER {UP} AS _pv_{c}, "
            f"first_value({t} IGNORE NULLS) OVER {DOWN} AS _nt_{c}, "
            f"first_value({c} IGNORE NULLS) OVER {DOWN} AS _nv_{c}")


def interp(c: str) -> str:
    return (f"CASE WHEN _nt_{c} = _pt_{c} THEN _pv_{c} "
            f"ELSE _pv_{c} + (_nv_{c} - _pv_{c}) * ({ep()} - _pt_{c}) / (_nt_{c} - _pt_{c}) END")


def impute_expr(c: str, edges: bool = True, fallback: str | None = None) -> str:
    parts = [c, interp(c)]
    if edges:
        parts += [f"_pv_{c}", f"_nv_{c}"]
    if fallback is not None:
        parts.append(fallback)
    return f"coalesce({', '.join(parts)})"


def imputed_cte(name: str = "imputed", src: str = "dense", cols=COLS, extra: str = "") -> str:
    """F1 over ``src``: interpolation, both carries, rain fallback 0.0."""
    nb = ", ".join(neighbours(c) for c in cols)
    sel = ", ".join(f"{impute_expr(c, True, '0.0' if c in RAIN else None)} AS {c}" for c in cols)
    return (f"_nb_{name} AS (SELECT site_id, ts{extra}, {', '.join(cols)}, {nb} FROM {src}), "
            f"{name} AS (SELECT site_id, ts{extra}, {sel} FROM _nb_{name})")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def rnd(e: str) -> str:
    return f"(round({e}, 9) + 0.0)"


def final(doubles, others, src: str, where: str = "") -> str:
    cols = list(others) + [f"{rnd(d)} AS {d}" for d in doubles]
    return f"SELECT {', '.join(cols)} FROM {src}{(' WHERE ' + where) if where else ''}"
