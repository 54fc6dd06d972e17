"""SQL for each registered query, for an independent engine over the same tables."""

from __future__ import annotations

from .grid import COUNT, FINE_COUNT, FINE_SIDE, HALF_AREA, ISLANDS, SHORE, SIDE, SUPPORT

#: Reports of the events table; copies adds the repeated and moved ones.
VESSEL = "lpad(CAST(200000000 + user_id % (SELECT greatest(1, count(*) // 2000) FROM events) AS VARCHAR), 9, '0')"
E = f"""e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value, {VESSEL} AS mmsi FROM events)"""


def positions(copies: bool = False) -> str:
    source = "SELECT *, 0 AS copy, 0.0::DOUBLE AS shift FROM e"
    if copies:
        source += """ UNION ALL SELECT *, 1, CASE WHEN event_id % 30 = 0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END
            FROM e WHERE event_id % 10 = 0"""
    return f"""{E}, s AS ({source}), p AS (SELECT event_id, mmsi, ts,
        'events:' || lpad(CAST(event_id AS VARCHAR), 20, '0') || CASE WHEN copy = 1 THEN 'c' ELSE '' END AS record_key,
        19.9::DOUBLE + ((event_id * 37) % 2000) / 10000.0::DOUBLE + shift AS lon,
        9.9::DOUBLE + ((event_id * 53) % 2000) / 10000.0::DOUBLE AS lat,
        CASE WHEN value <= 99.9 THEN value END AS sog, event_type AS code,
        CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS equipment FROM s)"""


RAW = f"""{E}, r AS (SELECT event_id, mmsi AS vessel, ts, value, event_type, event_id AS i, event_id % 29 = 0 AS bad_mmsi,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM e), parsed AS (SELECT *,
    CASE WHEN bad_mmsi THEN '12345' ELSE vessel END AS mmsi,
    CASE WHEN i % 11 = 0 THEN date_trunc('second', ts)
         WHEN i % 13 = 0 THEN date_trunc('second', ts) - INTERVAL 90 MINUTE
         WHEN i % 17 = 0 THEN NULL
         WHEN i % 19 = 0 THEN try_cast('2017' || substr(t, 5, 15) AS TIMESTAMP)
         WHEN i % 23 = 0 THEN NULL ELSE date_trunc('second', ts) END AS event_ts,
    i % 11 = 0 AS naive, NOT (i % 97 = 0 OR i % 101 = 0) AS lat_ok, i % 103 <> 0 AS lon_ok,
    (990 * 100 + (i * 53) % 2000) / 10000.0::DOUBLE AS lat, (1990 * 100 + (i * 37) % 2000) / 10000.0::DOUBLE AS lon,
    CASE WHEN i % 7 = 0 THEN NULL WHEN i % 31 = 0 THEN NULL WHEN value BETWEEN 0 AND 102.2 THEN value END AS sog,
    CASE WHEN i % 7 = 0 THEN 'missing_sog' WHEN i % 31 = 0 OR NOT value BETWEEN 0 AND 102.2 THEN 'invalid_or_sentinel_sog' END AS sog_flag,
    CASE WHEN i % 5 = 0 THEN NULL ELSE event_type END AS code, CASE i % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' END AS equipment
    FROM r)"""
REASONS = """concat_ws(',', CASE WHEN bad_mmsi THEN 'invalid_mmsi' END,
    CASE WHEN event_ts IS NULL OR ({reject} AND naive) THEN 'invalid_or_naive_timestamp'
         WHEN NOT year(event_ts) BETWEEN 2018 AND 2024 THEN 'timestamp_outside_source_era' END,
    CASE WHEN NOT lat_ok THEN 'invalid_lat' END, CASE WHEN NOT lon_ok THEN 'invalid_lon' END)"""
PARSED = f"{RAW}, q AS (SELECT *, {REASONS.format(reject='true')} AS reasons, concat_ws(',', sog_flag, CASE WHEN equipment = 'C' THEN 'unknown_equipment_class' END) AS flags FROM parsed)"

SIGNATURE = "concat_ws('|', lon, lat, coalesce(CAST(sog AS VARCHAR), '-'), code, coalesce(equipment, '-'))"
CORE_START, CORE_END = "TIMESTAMP '2024-01-05'", "TIMESTAMP '2024-01-20'"


def scoped(copies: bool) -> str:
    return f"""{positions(copies)}, sc AS (SELECT *, {SIGNATURE} AS sig,
        ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' AS declared,
        ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-21' AND lon BETWEEN 19.95::DOUBLE - 0.01::DOUBLE AND 20.05::DOUBLE + 0.01::DOUBLE
            AND lat BETWEEN 9.95::DOUBLE - 0.01::DOUBLE AND 10.05::DOUBLE + 0.01::DOUBLE AS inside FROM p),
        scoped AS (SELECT *, CASE WHEN NOT declared THEN 'rejected' WHEN inside THEN 'candidate' ELSE 'filtered' END AS outcome0,
        CASE WHEN NOT declared THEN 'unknown' WHEN NOT inside THEN 'outside'
             WHEN ts >= {CORE_START} AND ts < {CORE_END} THEN 'core' ELSE 'halo' END AS scope,
        CASE WHEN NOT declared THEN 'outside_declared_source_window' WHEN NOT inside THEN 'outside_candidate_filter' ELSE '' END AS reasons0
        FROM sc)"""


AUDIT = f"""{scoped(True)}, g AS (SELECT mmsi, ts, count(DISTINCT sig) AS kinds, min(record_key) AS keeper FROM scoped
        WHERE outcome0 <> 'rejected' GROUP BY ALL),
    audit AS (SELECT s.*, CASE WHEN outcome0 <> 'rejected' AND kinds > 1 THEN 'rejected' WHEN outcome0 <> 'candidate' THEN outcome0
        WHEN record_key = keeper THEN 'accepted' ELSE 'duplicate' END AS outcome,
        concat_ws(',', nullif(reasons0, ''), CASE WHEN outcome0 <> 'rejected' AND kinds > 1 THEN 'simultaneous_identity_position_conflict' END) AS reasons
        FROM scoped s LEFT JOIN g USING (mmsi, ts))"""

R, PHI0, LON0 = "6371007.180918475", "radians(10.0::DOUBLE)", "20.0::DOUBLE"
PROJECTED = f"""pr AS (SELECT *, sin({PHI0}) * sin(radians(lat)) + cos({PHI0}) * cos(radians(lat)) * cos(radians(lon - {LON0})) AS c FROM p),
    xy AS (SELECT *, {R} * cos(radians(lat)) * sin(radians(lon - {LON0})) / c AS x,
        {R} * (cos({PHI0}) * sin(radians(lat)) - sin({PHI0}) * cos(radians(lat)) * cos(radians(lon - {LON0}))) / c AS y FROM pr)"""
#: Greatest relative length error of the projection (50 km): see LocalProjection.metric_error_bound.
BOUND = f"""((1 + greatest(abs({R} / (6378137.0::DOUBLE * (1 - (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE))) - 1),
    abs({R} / (6378137.0::DOUBLE / sqrt(1 - (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE))) - 1)))
    / (cos(50000.0::DOUBLE / {R}) * cos(50000.0::DOUBLE / {R})) - 1)"""


def tracks(core_end: str = "TIMESTAMP '2025-01-01'") -> str:
    return f"""{positions()}, {PROJECTED}, ev AS (SELECT *, CASE WHEN event_id % 89 = 0 THEN 'filtered' ELSE 'accepted' END AS outcome FROM xy),
    adj AS (SELECT *, {SIGNATURE} AS sig, lag(record_key) OVER w AS left_key, lag(ts) OVER w AS left_ts, lag(outcome) OVER w AS left_outcome,
        lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(sog) OVER w AS left_sog, lag(code) OVER w AS left_code,
        lag(equipment) OVER w AS left_equipment, row_number() OVER w AS nth,
        (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6::DOUBLE AS gap
        FROM ev WINDOW w AS (PARTITION BY mmsi ORDER BY ts, record_key)),
    lad AS (SELECT *, left_key IS NOT NULL AND left_ts < {core_end} AS hit,
        concat_ws(',', CASE WHEN left_outcome <> 'accepted' OR outcome <> 'accepted' THEN 'original_adjacency_barrier' END,
            CASE WHEN gap <= 0 THEN 'unknown_or_nonpositive_time' WHEN gap > 1800 THEN 'excessive_gap' END) AS early,
        sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)) AS len FROM adj),
    led AS (SELECT *, CASE WHEN hit AND early = '' THEN len / gap / (1852.0::DOUBLE / 3600) END AS knots FROM lad),
    dec AS (SELECT *, CASE WHEN early = 'original_adjacency_barrier,excessive_gap' THEN 'excessive_gap,original_adjacency_barrier'
            WHEN early <> '' THEN early WHEN knots * (1 + {BOUND}) > 90 THEN 'implied_speed_jump_or_threshold_uncertainty' ELSE '' END AS reasons
        FROM led),
    brk AS (SELECT *, (hit AND reasons <> '') OR outcome <> 'accepted' AS breaks FROM dec),
    epi AS (SELECT *, coalesce(last_value(CASE WHEN breaks THEN record_key END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY ts, record_key
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(record_key) OVER (PARTITION BY mmsi ORDER BY ts, record_key)) AS ep
        FROM brk),
    acc AS (SELECT * FROM epi WHERE hit AND reasons = '')"""


def episode(key: str) -> str:
    return f"""sha256('{{"episode_start":"' || {key} || '","source_mmsi":"' || mmsi || '"}}')"""


#: Cuts of each accepted route at grid lines and the area's bounds; its UTC days; parts at the midpoints.
LINES = f"SELECT v FROM (SELECT -{SIDE * COUNT / 2}::DOUBLE + {SIDE}::DOUBLE * i AS v FROM range(0, {COUNT + 1}) t(i)) UNION SELECT -{HALF_AREA}::DOUBLE UNION SELECT {HALF_AREA}::DOUBLE"
PARTS = f"""{tracks()}, lines AS ({LINES}),
    cuts AS (SELECT record_key, 0.0::DOUBLE AS t FROM acc UNION SELECT record_key, 1.0::DOUBLE FROM acc
        UNION SELECT record_key, (v - x1) / (x - x1) FROM acc, lines WHERE x <> x1 AND (v - x1) / (x - x1) BETWEEN 0 AND 1
        UNION SELECT record_key, (v - y1) / (y - y1) FROM acc, lines WHERE y <> y1 AND (v - y1) / (y - y1) BETWEEN 0 AND 1),
    spans AS (SELECT * FROM (SELECT record_key, t AS lo, lead(t) OVER (PARTITION BY record_key ORDER BY t) AS hi FROM cuts) WHERE hi IS NOT NULL),
    days AS (SELECT record_key, greatest(left_ts, d) AS b, least(ts, d + INTERVAL 1 DAY) AS f FROM
        (SELECT record_key, left_ts, ts, unnest(generate_series(date_trunc('day', left_ts), date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM acc)
        WHERE greatest(left_ts, d) < least(ts, d + INTERVAL 1 DAY)),
    pt AS (SELECT a.*, lo, hi, x1 + (lo + hi) / 2 * (x - x1) AS mx, y1 + (lo + hi) / 2 * (y - y1) AS my,
        greatest(lo, (epoch_us(b) - epoch_us(left_ts)) / 1e6::DOUBLE / gap) AS u, least(hi, (epoch_us(f) - epoch_us(left_ts)) / 1e6::DOUBLE / gap) AS v
        FROM acc a JOIN spans USING (record_key) JOIN days USING (record_key)),
    part AS (SELECT *, epoch_us(left_ts) + CAST(round_even(u * gap * 1e6::DOUBLE, 0) AS BIGINT) AS bu,
        epoch_us(left_ts) + CAST(round_even(v * gap * 1e6::DOUBLE, 0) AS BIGINT) AS fu FROM pt WHERE v > u),
    con AS (SELECT *, (fu - bu) / 1e6::DOUBLE AS seconds, len / 1000 * (v - u) AS km, CAST(make_timestamp(bu) AS DATE) AS utc_date,
        CASE WHEN abs(mx) < {HALF_AREA} AND abs(my) < {HALF_AREA} THEN
            'r' || lpad(CAST(CAST(floor((my + {SIDE * COUNT / 2}) / {SIDE}) AS BIGINT) AS VARCHAR), 2, '0') ||
            'c' || lpad(CAST(CAST(floor((mx + {SIDE * COUNT / 2}) / {SIDE}) AS BIGINT) AS VARCHAR), 2, '0') END AS cell,
        CASE WHEN left_sog IS NOT NULL AND sog IS NOT NULL THEN (fu - bu) / 1e6::DOUBLE * (left_sog + (sog - left_sog) * (u + v) / 2) END AS integral
        FROM part WHERE fu > bu)"""



def candidates(prefix: str, side: float, count: int) -> str:
    """Every accepted route against every cell of a grid, box by box."""
    at = lambda k: f"({k} - {count / 2}::DOUBLE) * {side}::DOUBLE"
    e = "0.001::DOUBLE"
    return f"""WITH {tracks()}, cells AS (SELECT '{prefix}' || lpad(CAST(i // {count} AS VARCHAR), 2, '0') || 'c' || lpad(CAST(i % {count} AS VARCHAR), 2, '0') AS cell,
            {at(f"(i % {count})")} AS cx, {at(f"(i // {count})")} AS cy FROM range(0, {count * count}) t(i))
        SELECT record_key AS right_record_key, count(*) AS n, min(cell) AS first_cell, max(cell) AS last_cell FROM acc JOIN cells
        ON cx <= greatest(x1, x) + {e} AND cx + {side}::DOUBLE >= least(x1, x) - {e} AND cy <= greatest(y1, y) + {e} AND cy + {side}::DOUBLE >= least(y1, y) - {e}
        GROUP BY record_key"""


def slab(low: str, high: str, p: str, d: str) -> str:
    """Where p + t d is between low and high, as [from, to]; all or nothing if d is 0."""
    return f"""CASE WHEN {d} = 0 THEN CASE WHEN {p} BETWEEN {low} AND {high} THEN [-1e9::DOUBLE, 1e9::DOUBLE] ELSE [1e9::DOUBLE, -1e9::DOUBLE] END
        ELSE [least(({low} - {p}) / {d}, ({high} - {p}) / {d}), greatest(({low} - {p}) / {d}, ({high} - {p}) / {d})] END"""


def inside_length(shrunk: str) -> str:
    """Metres of the route within an island's rectangle made smaller on each side."""
    sx, sy = slab(f"ax + {shrunk}", f"bx - {shrunk}", "x1", "dx"), slab(f"ay + {shrunk}", f"by_ - {shrunk}", "y1", "dy")
    return f"CASE WHEN least(bx - ax, by_ - ay) < 2 * {shrunk} THEN 0 ELSE greatest(0, least(1, ({sx})[2], ({sy})[2]) - greatest(0, ({sx})[1], ({sy})[1])) * len END"


def to_box(x: str, y: str) -> str:
    return f"sqrt(greatest(ax - {x}, 0, {x} - bx) ** 2 + greatest(ay - {y}, 0, {y} - by_) ** 2)"


def to_route(x: str, y: str) -> str:
    """Distance of a point from the route."""
    t = f"least(1, greatest(0, (({x} - x1) * dx + ({y} - y1) * dy) / nullif(len * len, 0)))"
    return f"sqrt((x1 + coalesce({t}, 0) * dx - {x}) ** 2 + (y1 + coalesce({t}, 0) * dy - {y}) ** 2)"


#: Each route against each island: metres deep inside it, metres inside, and the distance where they don't meet.
D = f"{SHORE.config.shoreline_uncertainty_m}::DOUBLE"
SCREENED = f"""islands(ax, ay, bx, by_) AS (VALUES {", ".join("(" + ", ".join(f"{v}::DOUBLE" for v in i) + ")" for i in ISLANDS)}),
    open_ AS (SELECT record_key, x1, y1, x - x1 AS dx, y - y1 AS dy, x, y, len FROM dec WHERE hit AND early = ''),
    met AS (SELECT record_key, {inside_length(D)} AS deep, {inside_length("0.0::DOUBLE")} AS held, least({to_box("x1", "y1")}, {to_box("x", "y")},
            {to_route("ax", "ay")}, {to_route("ax", "by_")}, {to_route("bx", "ay")}, {to_route("bx", "by_")}) AS away FROM open_, islands),
    land AS (SELECT record_key, sum(deep) AS deep, bool_or(held > 0 OR away <= {D}) AS touched FROM met GROUP BY record_key),
    screened AS (SELECT o.record_key, CASE WHEN greatest(abs(x1), abs(x), abs(y1), abs(y)) > {SUPPORT + 0.001}::DOUBLE THEN 'water_mask_unavailable'
            WHEN deep >= {SHORE.config.material_land_crossing_m}::DOUBLE THEN 'material_land_crossing' WHEN touched THEN 'shoreline_uncertainty' END AS reason
        FROM open_ o JOIN land USING (record_key))"""

STABLE = "code IS NOT DISTINCT FROM left_code AND equipment IS NOT DISTINCT FROM left_equipment"
STATE = f"""SELECT mmsi, arg_max(record_key, ts) FILTER (outcome = 'accepted' AND ts < {CORE_END}) AS point_key,
    max(ts) FILTER (outcome = 'accepted' AND ts < {CORE_END}) AS point_ts, coalesce(bool_or(outcome = 'rejected'), false) AS barrier_seen
    FROM audit GROUP BY mmsi"""

OBSERVED = f"""{tracks()}, o AS (SELECT mmsi, CAST(ts AS DATE) AS utc_date,
        'r' || lpad(CAST(CAST(floor((y + {SIDE * COUNT / 2} - 0.001::DOUBLE) / {SIDE}) AS BIGINT) AS VARCHAR), 2, '0') ||
        'c' || lpad(CAST(CAST(floor((x + {SIDE * COUNT / 2} - 0.001::DOUBLE) / {SIDE}) AS BIGINT) AS VARCHAR), 2, '0') AS cell
        FROM ev WHERE outcome = 'accepted' AND abs(x) < {HALF_AREA} AND abs(y) < {HALF_AREA})"""
MADE_DIGITS = " + ".join(
    f"""(CASE WHEN r >= {k} THEN (i // {3 * k + 1} + {k} * user_id) % (CASE WHEN i % 5 = 0 THEN 8 WHEN i % 3 = 0 THEN 2 ELSE 7 END)
        WHEN i % 31 = 0 AND r = {k - 1} THEN 6 ELSE 7 END) * {8 ** (15 - k)}"""
    for k in range(1, 16)
)
MADE_CELLS = f"""e0 AS (SELECT event_id, user_id, event_id AS i, CASE WHEN event_id % 2 = 0 THEN 7 ELSE event_id // 2 % 16 END AS r FROM events),
    e1 AS (SELECT event_id, i, printf('%x', CAST(((CASE WHEN i % 37 = 0 THEN 2 WHEN i % 41 = 0 THEN 9 ELSE 1 END * 128 + r) * 128
        + CASE WHEN i % 4 = 1 THEN 14 WHEN i % 4 = 2 THEN 117 ELSE user_id % 128 END)::HUGEINT * 35184372088832 + {MADE_DIGITS} AS BIGINT)) AS c FROM e0),
    made AS (SELECT event_id, CASE WHEN i % 59 = 0 THEN NULL WHEN i % 43 = 0 THEN upper(c) WHEN i % 47 = 0 THEN '0' || c WHEN i % 53 = 0 THEN c || ' ' ELSE c END AS cell FROM e1)"""

ORACLE_SQL = {
    "parse_positions": f"""WITH {PARSED} SELECT event_id, mmsi, event_ts AS ts, lon AS longitude, lat AS latitude, sog AS sog_knots,
        code AS raw_vessel_code, equipment AS equipment_class, flags FROM q WHERE reasons = ''""",
    "parse_reasons": f"WITH {PARSED} SELECT reasons, count(*) AS n FROM q WHERE reasons <> '' GROUP BY reasons",
    "naive_time_policy": f"""WITH {RAW}, q AS (SELECT *, {REASONS.format(reject="false")} AS reasons FROM parsed)
        SELECT count(*) FILTER (reasons = '') AS accepted, count(*) FILTER (reasons = '' AND naive) AS assumed FROM q""",
    "sog_flags": f"""WITH {PARSED}, f AS (SELECT sog, unnest(CASE WHEN flags = '' THEN [NULL] ELSE string_split(flags, ',') END) AS flag
        FROM q WHERE reasons = '') SELECT flag, count(*) AS n, count(sog) AS with_sog FROM f GROUP BY flag""",
    "era_check": f"""WITH {PARSED} SELECT contains(reasons, 'timestamp_outside_source_era') AS outside_era, count(*) AS n FROM q GROUP BY ALL""",
    "null_like": f"WITH {RAW} SELECT code, equipment, count(*) AS n, count(*) FILTER (i % 7 <> 0) AS with_speed_text FROM parsed GROUP BY ALL",
    "classify": f"""WITH {positions()} SELECT coalesce(category, 'unknown') AS category, count(*) AS n FROM p LEFT JOIN
        (VALUES ('click', 'active'), ('view', 'passive'), ('purchase', 'active')) m(code, category) USING (code) GROUP BY ALL""",
    "validate_report": f"""WITH {PARSED}, g AS (SELECT mmsi, event_ts, count(*) AS n,
        count(DISTINCT concat_ws('|', lon, lat, coalesce(CAST(sog AS VARCHAR), '-'), coalesce(code, '-'), coalesce(equipment, '-'), flags)) AS kinds
        FROM q WHERE reasons = '' GROUP BY ALL)
        SELECT (SELECT count(*) FROM q) AS input_rows, (SELECT count(*) FROM q WHERE reasons = '') AS accepted,
        (SELECT count(*) FROM q WHERE reasons <> '') AS rejected, (SELECT count(*) FROM q WHERE reasons = '' AND flags <> '') AS flagged_rows,
        CAST((SELECT coalesce(sum(n - 1), 0) FROM g WHERE n > 1 AND kinds = 1) AS BIGINT) AS duplicate_rows,
        (SELECT count(*) FROM g WHERE kinds > 1) AS conflict_groups""",
    "scope_filter": f"""WITH {scoped(False)} SELECT outcome0 AS outcome, scope, reasons0 AS reasons, count(*) AS n, min(record_key) AS first_key
        FROM scoped GROUP BY ALL""",
    "record_key_hash": f"""WITH {positions()} SELECT record_key, sha256('{{"key":"' || record_key || '","vessel":"' || mmsi || '"}}') AS fingerprint FROM p""",
    "reconcile_groups": f"""WITH {positions(True)} SELECT mmsi, ts, CASE WHEN count(DISTINCT {SIGNATURE}) = 1 THEN 'duplicate' ELSE 'conflict' END AS outcome,
        string_agg(record_key, ',' ORDER BY record_key) AS messages FROM p GROUP BY mmsi, ts HAVING count(*) > 1""",
    "reconcile_outcomes": f"""WITH {AUDIT} SELECT outcome, scope, reasons, count(*) AS n, min(record_key) AS first_key, max(record_key) AS last_key
        FROM audit GROUP BY ALL""",
    "reconcile_vessels": f"""WITH {AUDIT} SELECT mmsi, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'duplicate') AS duplicate,
        count(*) FILTER (outcome = 'filtered') AS filtered, count(*) FILTER (outcome = 'rejected') AS rejected FROM audit GROUP BY mmsi""",
    "carry_conflict": f"""WITH {scoped(False)}, c AS (SELECT mmsi, arg_min(struct_pack(ts, record_key, event_id), (ts, record_key)) AS r FROM scoped
        WHERE outcome0 = 'candidate' GROUP BY mmsi)
        SELECT s.record_key, 'rejected' AS outcome, concat_ws(',', nullif(reasons0, ''), 'simultaneous_identity_position_conflict',
        'carried_endpoint_conflict:carry:' || r.record_key) AS reasons FROM scoped s JOIN c ON s.mmsi = c.mmsi AND s.ts = r.ts
        WHERE r.event_id % 2 = 1 AND outcome0 <> 'rejected'""",
    "ingestion_state": f"WITH {AUDIT} {STATE}",
    "ingestion_state_carried": f"WITH {AUDIT} {STATE}",
    "adjacency": f"WITH {tracks()} SELECT record_key, left_key, round(gap, 6) AS gap_seconds, false AS skip FROM adj WHERE left_key IS NOT NULL",
    "global_order": f"""WITH {positions(True)}, o AS (SELECT record_key, CASE WHEN event_id % 97 <> 0 THEN mmsi END AS mmsi, CASE WHEN event_id % 89 <> 0 THEN ts END AS ts FROM p)
        SELECT record_key, mmsi, row_number() OVER (ORDER BY mmsi NULLS FIRST, ts NULLS FIRST, record_key) AS position FROM o""",
    "carry_chain": f"""WITH {tracks()}, seen AS (SELECT mmsi, bool_or(breaks) AS barrier FROM brk WHERE ts < {CORE_START} GROUP BY mmsi),
        chained AS (SELECT dec.* EXCLUDE (reasons), CASE WHEN coalesce(barrier, false) AND left_ts < {CORE_START} AND ts >= {CORE_START}
            THEN concat_ws(',', 'conservative_carry_or_unknown_time_barrier', CASE WHEN early <> '' THEN reasons END) ELSE reasons END AS reasons FROM dec LEFT JOIN seen USING (mmsi)),
        broken AS (SELECT *, (hit AND reasons <> '') OR outcome <> 'accepted' AS breaks FROM chained),
        named AS (SELECT *, coalesce(last_value(CASE WHEN breaks THEN record_key END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY ts, record_key
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(record_key) OVER (PARTITION BY mmsi ORDER BY ts, record_key)) AS ep FROM broken)
        SELECT record_key AS right_record_key, left_key AS left_record_key, CASE WHEN reasons = '' THEN 'accepted_estimate' ELSE 'rejected' END AS outcome, reasons,
            {episode("ep")} AS episode_id FROM named WHERE hit""",
    "interval_ladder": f"""WITH {tracks()} SELECT record_key AS right_record_key, left_key AS left_record_key,
        CASE WHEN reasons = '' THEN 'accepted_estimate' ELSE 'rejected' END AS outcome, reasons,
        CASE WHEN {STABLE} THEN 'stable_raw_attributes' ELSE 'endpoint_class_change_unknown' END AS class_status FROM epi WHERE hit""",
    "episodes": f"""WITH {tracks()} SELECT record_key, breaks, {episode("ep")} AS episode_id,
        {episode("CASE WHEN breaks THEN record_key ELSE ep END")} AS episode_after FROM epi""",
    "checkpoint": f"""WITH {tracks(CORE_END)}, k AS (SELECT mmsi, arg_max(record_key, nth) AS last_key, bool_or(breaks) AS barrier_seen,
        arg_max(CASE WHEN breaks THEN record_key ELSE ep END, nth) AS ep FROM epi WHERE ts < {CORE_END} GROUP BY mmsi)
        SELECT mmsi, last_key, barrier_seen, {episode("ep")} AS episode_id FROM k""",
    "assess_pairs": f"""WITH {tracks()}, a AS (SELECT left_outcome <> 'accepted' OR outcome <> 'accepted' AS bad, right(record_key, 2) = '77' AS other,
        gap, lon = lag(lon) OVER w AND lat = lag(lat) OVER w AS still, left_key FROM adj WINDOW w AS (PARTITION BY mmsi ORDER BY ts, record_key)),
        b AS (SELECT *, concat_ws(',', CASE WHEN NOT bad AND gap > 1800 THEN 'excessive_gap' END, CASE WHEN other THEN 'identity_conflict' END,
            CASE WHEN bad THEN 'invalid_sample_barrier' END, CASE WHEN NOT bad AND gap <= 0 THEN 'nonpositive_or_unordered_time' END) AS reasons
            FROM a WHERE left_key IS NOT NULL)
        SELECT CASE WHEN reasons = '' THEN 'pending_scientific_validation' ELSE 'rejected' END AS outcome, reasons, coalesce(still AND NOT bad, false) AS stationary,
        count(*) AS n, round(sum(CASE WHEN reasons = '' THEN gap END), 3) AS supported_seconds FROM b GROUP BY ALL""",
    "project_xy": f"WITH {positions()}, {PROJECTED} SELECT record_key, round(x, 3) AS x, round(y, 3) AS y FROM xy",
    "inverse_xy": f"""WITH {positions()}, m AS (SELECT record_key, (lon - 20.0::DOUBLE) * 100000 AS x, (lat - 10.0::DOUBLE) * 100000 AS y FROM p),
        h AS (SELECT *, sqrt(x * x + y * y) AS rho, atan(sqrt(x * x + y * y) / {R}) AS c FROM m)
        SELECT record_key, CASE WHEN rho = 0 THEN 20.0::DOUBLE ELSE round(degrees(radians({LON0}) + atan2(x * sin(c), rho * cos({PHI0}) * cos(c) - y * sin({PHI0}) * sin(c))), 6) END AS lon,
        CASE WHEN rho = 0 THEN 10.0::DOUBLE ELSE round(degrees(asin(cos(c) * sin({PHI0}) + y * sin(c) * cos({PHI0}) / rho)), 6) END AS lat FROM h""",
    "implied_speed": f"WITH {tracks()} SELECT record_key, round(len, 2) AS length_m, round(knots, 3) AS knots FROM epi WHERE knots IS NOT NULL",
    "midnight_split": f"""WITH {PARTS} SELECT CAST(b AS DATE) AS utc_date, count(*) AS slices, round(sum((epoch_us(f) - epoch_us(b)) / 1e6::DOUBLE), 3) AS seconds
        FROM days GROUP BY ALL""",
    "spatial_candidates": candidates("r", SIDE, COUNT).replace(
        "GROUP BY record_key", "GROUP BY record_key UNION ALL SELECT record_key, 0, NULL, NULL FROM acc WHERE NOT EXISTS (SELECT 1 FROM cells "
        "WHERE cx <= greatest(x1, x) + 0.001 AND cx + 3000 >= least(x1, x) - 0.001 AND cy <= greatest(y1, y) + 0.001 AND cy + 3000 >= least(y1, y) - 0.001)"
    ),
    "spatial_candidates_fine": candidates("f", FINE_SIDE, FINE_COUNT),
    "land_screen": f"""WITH {tracks()}, {SCREENED} SELECT record_key AS right_record_key, CASE WHEN reasons = '' AND reason IS NULL THEN 'accepted_estimate' ELSE 'rejected' END AS outcome,
        concat_ws(',', nullif(reasons, ''), reason) AS reasons FROM epi LEFT JOIN screened USING (record_key) WHERE hit""",
    "clip_allocation": f"""WITH {PARTS} SELECT coalesce(cell, 'outside') AS cell, utc_date, count(cell) AS parts, round(sum(seconds), 2) AS seconds, round(sum(km), 3) AS km
        FROM con GROUP BY ALL""",
    "ledger_rollup": f"""WITH {PARTS} SELECT record_key AS right_record_key, round(max(gap), 3) AS owned_seconds,
        round(coalesce(sum(seconds) FILTER (cell IS NOT NULL), 0), 2) AS inside_seconds, round(coalesce(sum(seconds) FILTER (cell IS NULL), 0), 2) AS outside_seconds,
        round(max(len) / 1000, 3) AS distance_km FROM con GROUP BY record_key""",
    "conservation": f"WITH {tracks()} SELECT record_key AS right_record_key FROM acc WHERE right(record_key, 1) = '7'",
    "daily_metrics": f"""WITH {PARTS} SELECT cell, utc_date, count(DISTINCT mmsi) AS unique_estimated_present_vessels, round(sum(seconds) / 3600, 4) AS vessel_hours,
        round(sum(km), 3) AS vessel_km, round(sum(integral) / sum(CASE WHEN integral IS NOT NULL THEN seconds END), 3) AS knots,
        round(sum(seconds) / 3600 / 24, 5) AS concurrency FROM con WHERE cell IS NOT NULL GROUP BY ALL""",
    "daily_export": f"""WITH {PARTS}, g AS (SELECT cell, utc_date, count(DISTINCT mmsi) AS n, sum(seconds) AS s, sum(km) AS km, sum(integral) AS i,
        coalesce(sum(CASE WHEN integral IS NOT NULL THEN seconds END), 0) AS sup FROM con WHERE cell IS NOT NULL GROUP BY ALL),
        m AS (SELECT cell, utc_date, s, sup, unnest([struct_pack(metric := 'unique_estimated_present_vessels', v := CAST(n AS DOUBLE)),
            struct_pack(metric := 'vessel_hours', v := s / 3600), struct_pack(metric := 'vessel_km', v := km),
            struct_pack(metric := 'reported_sog_time_weighted_knots', v := CASE WHEN sup > 0 THEN i / sup END),
            struct_pack(metric := 'mean_supported_concurrency', v := s / 3600 / 24)], recursive := true) FROM g)
        SELECT cell, utc_date, metric, round(v, 3) AS value, CASE WHEN metric <> 'reported_sog_time_weighted_knots' OR sup >= s THEN 'observed' WHEN sup > 0 THEN 'partial' ELSE 'unknown' END AS status,
        round(CASE WHEN metric = 'reported_sog_time_weighted_knots' THEN sup ELSE s END, 3) AS available, round(s, 3) AS expected, 'none' AS fault FROM m""",
    "observed_vessels": f"""WITH {OBSERVED}
        SELECT cell, utc_date, count(DISTINCT mmsi) AS unique_observed_vessels FROM o GROUP BY ALL""",
    "vessel_windows": f"""WITH {OBSERVED}, k AS (SELECT unnest(['day', 'week', 'month']) AS kind)
        SELECT cell, kind, CAST(date_trunc(kind, utc_date) AS DATE) AS window_start, count(DISTINCT mmsi) AS unique_observed_vessels FROM o, k GROUP BY ALL""",
    "cell_ids": f"""WITH {MADE_CELLS}, v AS (SELECT *, regexp_full_match(coalesce(cell, ''), '[1-9a-f][0-9a-f]{{0,15}}') AS canonical,
        CASE WHEN canonical THEN CAST('0x' || cell AS BIGINT) END AS v FROM made),
        f AS (SELECT *, CAST((v >> 52) & 15 AS INTEGER) AS res, CAST((v >> 45) & 127 AS INTEGER) AS bc, list_transform(range(1, 16), lambda k: (v >> (45 - 3 * k)) & 7) AS ds FROM v),
        g AS (SELECT *, CASE WHEN NOT canonical THEN 'not_canonical' WHEN (v >> 56) <> 8 THEN 'mode' WHEN bc > 121 THEN 'base_cell'
            WHEN list_contains(ds[1:res], 7) OR len(list_filter(ds[res + 1:], lambda x: x <> 7)) > 0 THEN 'digits'
            WHEN bc IN (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117) AND list_filter(ds[1:res], lambda x: x <> 0)[1] = 1 THEN 'pentagon' END AS fault FROM f)
        SELECT event_id, cell, fault, CASE WHEN fault IS NULL THEN res ELSE -1 END AS resolution, CASE WHEN fault IS NULL THEN bc ELSE -1 END AS base_cell,
        CASE WHEN fault IS NULL THEN printf('%x', CAST(8::HUGEINT * 72057594037927936 + (res // 2)::HUGEINT * 4503599627370496 + bc::HUGEINT * 35184372088832 +
            list_sum(list_transform(range(1, 16), lambda k: (CASE WHEN k <= res // 2 THEN ds[k] ELSE 7 END)::HUGEINT * CAST(pow(8, 15 - k) AS BIGINT))) AS BIGINT)) END AS parent,
        fault IS NULL AND res = 7 AS fits_7 FROM g""",
    "speed_bands": f"""WITH {PARTS}, b AS (SELECT seconds, integral / seconds AS kn FROM con WHERE cell IS NOT NULL)
        SELECT CASE WHEN kn < 5 THEN 'slow' WHEN kn < 20 THEN 'medium' WHEN kn < 1000 THEN 'fast' ELSE 'unknown' END AS band,
        round(sum(seconds / 3600), 3) AS hours FROM b GROUP BY ALL""",
    "dayparts": f"""WITH {positions()}, h AS (SELECT hour(timezone('America/New_York', timezone('UTC', ts))) AS h FROM p)
        SELECT CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS daypart, count(*) AS n FROM h GROUP BY ALL""",
    "civil_day": f"""WITH {E}, d AS (SELECT DISTINCT CAST(ts AS DATE) + CAST(60 * (event_id % 6) AS INTEGER) AS day FROM e),
        b AS (SELECT day, timezone('UTC', timezone('America/New_York', CAST(day AS TIMESTAMP))) AS day_start,
        timezone('UTC', timezone('America/New_York', CAST(day + 1 AS TIMESTAMP))) AS day_end FROM d)
        SELECT day, day_start, day_end, date_diff('hour', day_start, day_end) AS hours FROM b""",
    "export_check": f"""WITH {positions()}, x AS (SELECT code AS cell, date_trunc('day', ts) AS s, event_id % 200 = 1 AS half, coalesce(equipment, 'none') AS variant
        FROM p), r AS (SELECT 'duplicate_key' AS fault FROM x GROUP BY cell, s, half, variant HAVING count(*) > 1),
        m AS (SELECT 'mixed_batch' AS fault WHERE (SELECT count(DISTINCT variant) FROM x) > 1)
        SELECT fault, count(*) AS n FROM (SELECT fault FROM r UNION ALL SELECT 'not_one_utc_day' FROM x WHERE half UNION ALL SELECT fault FROM m) GROUP BY fault""",
    "metric_envelope": f"""WITH {positions()}, g AS (SELECT mmsi, code, avg(sog) AS v, count(sog) AS have, count(*) AS total FROM p GROUP BY ALL)
        SELECT CASE WHEN have = total THEN 'observed' WHEN have > 0 THEN 'partial' ELSE 'unknown' END AS status, true AS valid, count(*) AS n,
        count(v) AS n_values FROM g GROUP BY ALL""",
    "catalog": """SELECT * FROM (VALUES
        ('noaa_marinecadastre', 'CSV.zst (2015 onward); implemented parser eras start 2018', 'offline_local_ingestion', 'no_acquisition_authorized'),
        ('canada_configurable', NULL, 'unavailable_pending_access', 'unverified')) t(provider, delivery, adapter_status, access_status)""",
    "metrics_list": """SELECT * FROM (VALUES
        ('unique_observed_vessels', 'identities/window', 'point_observation', 'identity union; never sum subgroup counts'),
        ('unique_estimated_present_vessels', 'identities/window', 'track_estimate', 'identity union; never sum subgroup counts'),
        ('vessel_hours', 'vessel h', 'track_estimate', 'sum'), ('vessel_km', 'vessel km', 'track_estimate', 'sum'),
        ('reported_sog_time_weighted_knots', 'knots', 'reported_speed_reduction', 'sum knot-seconds / sum supported seconds'),
        ('speed_band_hours', 'vessel h', 'track_estimate', 'sum within same variant/band'),
        ('mean_supported_concurrency', 'vessels', 'track_estimate', 'sum vessel-hours / window hours')) t(name, unit, method_kind, reduction)""",
}

for _name in ("adjacency", "episodes", "checkpoint"):
    ORACLE_SQL[f"crowded_{_name}"] = ORACLE_SQL[_name].replace(VESSEL, f"CASE WHEN event_id % 10 < 9 THEN '200000000' ELSE {VESSEL} END")
