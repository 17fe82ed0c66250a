"""Pieces of DuckDB SQL that the queries' oracles share: formulas as text and common table expressions."""

from __future__ import annotations


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a}))))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    d = f"(radians({lon2}) - radians({lon1}))"
    p, q = f"radians({lat1})", f"radians({lat2})"
    return f"((degrees(atan2(sin({d}) * cos({q}), cos({p}) * sin({q}) - sin({p}) * cos({q}) * cos({d}))) + 360) % 360)"


def direction(angle: str) -> str:
    return f"['North','Northeast','East','Southeast','South','Southwest','West','Northwest'][1 + CAST(floor(({angle} + 22.5) / 45) AS INT) % 8]"


def angle(x1: str, y1: str, x2: str, y2: str, degenerate: str) -> str:
    size = f"(sqrt(({x1})*({x1}) + ({y1})*({y1})) * sqrt(({x2})*({x2}) + ({y2})*({y2})))"
    return f"(CASE WHEN {size} = 0 THEN {degenerate} ELSE degrees(acos(least(1.0, greatest(-1.0, (({x1})*({x2}) + ({y1})*({y2})) / {size})))) END)"


def foot(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    size = f"((({x2})-({x1}))*(({x2})-({x1})) + (({y2})-({y1}))*(({y2})-({y1})))"
    return f"(CASE WHEN {size} = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ((({px})-({x1}))*(({x2})-({x1})) + (({py})-({y1}))*(({y2})-({y1}))) / {size})) END)"


def to_segment(lat: str, lon: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    t = foot(lon, lat, lon1, lat1, lon2, lat2)
    return haversine(lat, lon, f"({lat1} + {t} * ({lat2} - {lat1}))", f"({lon1} + {t} * ({lon2} - {lon1}))")


def destination(lat: str, lon: str, angle: str, metres: float) -> tuple[str, str]:
    """(lon, lat)"""
    r = f"({metres} / 6378137.0)"
    lat2 = f"asin(sin(radians({lat})) * cos({r}) + cos(radians({lat})) * sin({r}) * cos({angle}))"
    lon2 = f"(radians({lon}) + atan2(sin({angle}) * sin({r}) * cos(radians({lat})), cos({r}) - sin(radians({lat})) * sin({lat2})))"
    return f"degrees({lon2})", f"degrees({lat2})"


def stamp(t: str) -> str:
    return f"strftime(make_timestamp(CAST(({t} + 28800) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S')"


WALK = "PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING"
CELL_LON, CELL_LAT = "((CAST(floor({0} / 100000.0) AS DOUBLE) + 0.5) / 1000.0)", "((CAST({0} % 100000 AS DOUBLE) + 0.5) / 1000.0)"


def centre(cell: str) -> tuple[str, str]:
    return CELL_LON.format(cell), CELL_LAT.format(cell)


PARTS = {
    "ev": f"""SELECT user_id AS devid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t,
        104060000 + (user_id % 10) * 3000 + CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 - 495) OVER ({WALK}) AS BIGINT) AS lon6,
        30650000 + (CAST(floor(user_id / 10.0) AS BIGINT) % 10) * 3000 + CAST(sum(CAST(floor(value * 100) AS BIGINT) % 1001 - 500) OVER ({WALK}) AS BIGINT) AS lat6 FROM events""",
    "points": "SELECT devid, seq, CAST(lon6 AS DOUBLE) / 1000000 AS lon, CAST(lat6 AS DOUBLE) / 1000000 AS lat, t, CAST(floor(lon6 / 1000.0) AS BIGINT) * 100000 + CAST(floor(lat6 / 1000.0) AS BIGINT) AS road_id FROM ev",
    "pairs": "SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(t) OVER w AS t2, lead(road_id) OVER w AS road2 FROM points WINDOW w AS (PARTITION BY devid ORDER BY seq)",
    "moves": f"SELECT *, {haversine('lat', 'lon', 'lat2', 'lon2')} AS dist, t2 - t AS dt FROM pairs WHERE t2 IS NOT NULL",
    "steps": "SELECT *, CASE WHEN dt = 0 THEN 0.0 ELSE dist / dt END AS speed FROM moves",
    "parts": "SELECT *, CAST(ntile(4) OVER (PARTITION BY devid ORDER BY seq) - 1 AS BIGINT) AS seg FROM points",
    "part_pairs": "SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(t) OVER w AS t2 FROM parts WINDOW w AS (PARTITION BY devid, seg ORDER BY seq)",
    "part_moves": f"SELECT *, {haversine('lat', 'lon', 'lat2', 'lon2')} AS dist, t2 - t AS dt FROM part_pairs WHERE t2 IS NOT NULL",
    "part_steps": "SELECT *, CASE WHEN dt = 0 THEN 0.0 ELSE dist / dt END AS speed FROM part_moves",
    "part_valid": "SELECT *, abs(speed - lag(speed) OVER (PARTITION BY devid, seg ORDER BY seq)) / dt AS accel FROM part_steps WHERE dt > 0",
    "backs": "SELECT *, row_number() OVER (PARTITION BY devid ORDER BY seq DESC) AS back, count(*) OVER (PARTITION BY devid) AS n FROM points",
    "boxes": "SELECT devid, min(lon) - 0.01 AS min_lon, max(lon) + 0.01 AS max_lon, min(lat) - 0.01 AS min_lat, max(lat) + 0.01 AS max_lat FROM points GROUP BY devid",
    "cuts": "SELECT DISTINCT road_id AS u, road2 AS v FROM pairs WHERE t2 IS NOT NULL AND road_id <> road2",
    "edges": "SELECT CAST(row_number() OVER (ORDER BY u, v) - 1 AS BIGINT) AS fid, u, v, {0} AS lon1, {1} AS lat1, {2} AS lon2, {3} AS lat2 FROM cuts".format(*centre("u"), *centre("v")),
    "nodes": "SELECT road_id AS osmid, {0} AS lon, {1} AS lat FROM (SELECT DISTINCT road_id FROM points)".format(*centre("road_id")),
    "lights": "SELECT osmid AS id, lon, lat FROM nodes WHERE osmid % 17 = 0",
}
NEEDS = {
    "points": ["ev"], "pairs": ["points"], "moves": ["pairs"], "steps": ["moves"], "parts": ["points"], "part_pairs": ["parts"], "part_moves": ["part_pairs"], "part_steps": ["part_moves"],
    "part_valid": ["part_steps"], "backs": ["points"], "boxes": ["points"], "cuts": ["pairs"], "edges": ["cuts"], "nodes": ["points"], "lights": ["nodes"],
}


def with_(*names: str, body: str, **more: str) -> str:
    """``body`` after the named expressions, what they need, and ``more`` in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in [*((n, PARTS[n]) for n in order), *more.items()]) + f"\n{body}"
