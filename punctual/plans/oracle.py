"""SQL counterparts of the named queries, assembled from shared common table expressions."""

from __future__ import annotations

from .fixtures import ROLL_ROWS

_PARTS: dict[str, tuple[str, str]] = {}


def _part(name: str, needs: str, sql: str) -> None:
    _PARTS[name] = (needs, sql)


def _with(needs: str, body: str) -> str:
    """Prefix ``body`` with the expressions it needs, each once, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dependency in _PARTS[name][0].split():
            visit(dependency)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_PARTS[name][1].strip()})" for name in order)
    return f"WITH {ctes}\n{body.strip()}"


# ---- timetable ------------------------------------------------------------------------------------------------------

_part("routes", "", """
SELECT c_custkey AS route, c_nationkey AS agency_id, c_name AS route_short_name, c_mktsegment AS route_long_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 401 WHEN 'HOUSEHOLD' THEN 401 WHEN 'AUTOMOBILE' THEN 700
    WHEN 'MACHINERY' THEN 100 WHEN 'FURNITURE' THEN 900 END AS route_type
FROM customer
""")
_part("lines", "", """
SELECT l_orderkey AS trip, l_linenumber, min(l_suppkey) AS stop FROM lineitem GROUP BY 1, 2
""")
_part("raw_stops", "lines", """
SELECT trip, stop, q, 18000 + (trip % 20) * 3600 - 300 * (trip % 3) + 180 * q AS raw
FROM (SELECT trip, stop, row_number() OVER (PARTITION BY trip ORDER BY l_linenumber) AS q FROM lines)
""")
_part("st", "raw_stops", """
SELECT trip, stop, q, raw, secs, o_orderpriority AS headsign, s_name AS stop_name, 1000.0::DOUBLE * q AS dist,
  round(59.0::DOUBLE + (stop % 10) * 0.01::DOUBLE, 2) AS lat,
  round(18.0::DOUBLE + (stop // 10) * 0.01::DOUBLE, 2) AS lon,
  printf('%02d:%02d:%02d', secs // 3600, secs % 3600 // 60, secs % 60) AS arrival_time,
  printf('%02d:%02d:%02d', (secs + 30) // 3600, (secs + 30) % 3600 // 60, (secs + 30) % 60) AS departure_time
FROM (SELECT *, CASE WHEN (trip // 20) % 2 = 1 THEN raw % 86400 ELSE raw END AS secs FROM raw_stops)
JOIN supplier ON s_suppkey = stop JOIN orders ON o_orderkey = trip
""")
_part("heads", "st", """
SELECT trip, count(*) AS n, arg_min(headsign, q) AS headsign FROM st GROUP BY 1
""")
_part("trips", "routes heads", """
SELECT o_orderkey AS trip, o_custkey AS route, o_custkey AS shape_id, CAST(o_orderkey % 2 AS INTEGER) AS direction_id,
  route_type, route_short_name, route_long_name, r.agency_id, n_name AS agency_name, n, headsign
FROM orders LEFT JOIN routes r ON r.route = o_custkey LEFT JOIN nation ON n_nationkey = r.agency_id
LEFT JOIN heads ON heads.trip = o_orderkey
""")
_ATTRIBUTES = """CAST(t.trip AS VARCHAR) AS trip_id, shape_id, CAST(route AS VARCHAR) AS route_id, direction_id,
  route_type, route_short_name, route_long_name, headsign AS trip_headsign, agency_id, agency_name"""

# ---- positions ------------------------------------------------------------------------------------------------------

_part("metro", "trips", """
SELECT trip, n, row_number() OVER (ORDER BY trip) - 1 AS ix FROM trips WHERE route_type = 401 AND n IS NOT NULL
""")
_part("driven", "metro st", """
SELECT e.seq, CAST(e.user_id AS VARCHAR) AS id, event_type, e.trip,
  st.lat + ((e.seq % 3) - 1) * 0.0005::DOUBLE + CASE WHEN e.seq % 7 = 0 THEN 0.004::DOUBLE ELSE 0 END AS lat,
  st.lon AS lng, e.period * 864000 + st.raw - 3600 + ((e.seq % 41) - 20) * 60 AS ts
FROM (
  SELECT event_id AS seq, user_id, event_type, period, trip, (event_id // 3) % n + 1 AS q
  FROM (SELECT *, (user_id * 31 + period) % (SELECT count(*) FROM metro) AS ix
        FROM (SELECT *, CAST(floor(epoch(events.ts)) AS BIGINT) // 864000 AS period FROM events)) d
  JOIN metro USING (ix)
) e JOIN st ON st.trip = e.trip AND st.q = e.q
""")
_part("mixed", "driven", """
SELECT seq, id, lat, lng, ts, CASE event_type WHEN 'error' THEN NULL
  WHEN 'signup' THEN (seq * 7) % ((SELECT count(*) FROM orders) + 5) ELSE trip END AS trip
FROM driven
""")



for tag, source in (("p", "driven"), ("m", "mixed")):
    _part(f"hits_{tag}", f"{source} trips st", f"""
SELECT id, seq, ts, trip, n, CASE WHEN dist < 250 THEN i END AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY dist, i) AS rn FROM (
    SELECT e.id, e.seq, e.ts, e.trip, t.n, s.q - 1 AS i,
      2 * 6378137.0 * atan2(sqrt(a), sqrt(1 - a)) AS dist
    FROM {source} e JOIN trips t ON t.trip = e.trip AND t.route_type = 401 JOIN st s ON s.trip = e.trip,
    LATERAL (SELECT pow(sin((radians(s.lat) - radians(e.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(e.lat))
      * pow(sin((radians(s.lon) - radians(e.lng)) / 2), 2) AS a)
  )
) WHERE rn = 1
""")
    _part(f"numbered_{tag}", f"hits_{tag}", f"""
SELECT *, CAST(sum(CASE WHEN trip <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq) AS BIGINT) AS run
FROM (SELECT *, lag(trip) OVER (PARTITION BY id ORDER BY seq) AS prev FROM hits_{tag})
""")
    _part(f"runs_{tag}", f"numbered_{tag}", f"""
SELECT *, CASE WHEN n >= 3 THEN CASE WHEN highest IS NOT DISTINCT FROM before THEN 'resend' ELSE 'new' END END AS kind
FROM (
  SELECT *, last_value(CASE WHEN n >= 3 THEN highest END IGNORE NULLS)
    OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT id, seq, ts, trip, n, hit, run,
    coalesce(max(hit) OVER (PARTITION BY id, run ORDER BY seq), 0) AS highest FROM numbered_{tag})
)
""")
    _part(f"arr_{tag}", f"runs_{tag}", f"""
SELECT id, run, trip, n, hit, min(seq) AS seq, arg_min(ts, seq) AS ts FROM runs_{tag}
WHERE hit IS NOT NULL GROUP BY 1, 2, 3, 4, 5
""")

# ---- schedules and sequences ----------------------------------------------------------------------------------------

_part("plans", "st", """
SELECT trip, max(secs) < 86400 AS plain, coalesce(max(CASE WHEN secs % 86400 < prev THEN q - 1 END), 0) AS rollover,
  min(CASE WHEN q = 1 THEN secs END) AS secs0
FROM (SELECT *, lag(secs % 86400) OVER (PARTITION BY trip ORDER BY q) AS prev FROM st) GROUP BY 1
""")
_part("route_words", "", """
SELECT c_custkey AS route, row_number() OVER (ORDER BY c_custkey) - 1 AS ix FROM customer
WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')
""")
_part("stop_words", "", """
SELECT s_suppkey AS stop, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS ix FROM supplier
""")
_part("layout", "route_words stop_words", """
SELECT r, 34 + 2 * r AS stop0, 34 + 2 * r + s AS day0, 41 + 2 * r + s AS hour0, 65 + 2 * r + s AS skip
FROM (SELECT count(*) AS r FROM route_words), (SELECT count(*) AS s FROM stop_words)
""")
_part("gate", "arr_p", """
SELECT *, row_number() OVER (PARTITION BY trip ORDER BY gate) AS nth FROM (
  SELECT id, run, trip, n, greatest(max(CASE WHEN hit = n - 1 THEN seq END),
    max(CASE WHEN k = n - n // 2 THEN seq END)) AS gate,
    max(CASE WHEN hit = n - 1 THEN seq END) AS last_seq, max(CASE WHEN k = n - n // 2 THEN seq END) AS enough
  FROM (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY seq) AS k FROM arr_p)
  WHERE n >= 3 GROUP BY 1, 2, 3, 4
) WHERE last_seq IS NOT NULL AND enough IS NOT NULL
""")
# Runs to turn into training sequences: the first per trip, then plain-day trips only.
_part("chosen", "gate runs_p plans", """
SELECT g.id, g.run, g.trip, g.n, g.gate AS seq, e.ts, e.ts // 86400 AS day, p.rollover, p.secs0
FROM gate g JOIN runs_p e ON e.id = g.id AND e.seq = g.gate JOIN plans p ON p.trip = g.trip
WHERE g.nth = 1 AND p.plain
""")
_DELTAS = """
SELECT key.*, s.q - 1 AS i, s.stop, a.ts - (day * 86400 + s.secs - CASE WHEN s.q - 1 < rollover THEN 86400 ELSE 0 END
  - 3600) AS delay
FROM {source} key JOIN st s ON s.trip = key.trip
LEFT JOIN arr_p a ON a.id = key.id AND a.run = key.run AND a.hit = s.q - 1 AND a.seq <= key.seq
"""
_STEPS = """
SELECT *, coalesce(delay - coalesce(last_value(delay IGNORE NULLS) OVER (PARTITION BY id, seq ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS step FROM {source}
"""
_TOKENS = """
SELECT *, CASE WHEN i = 0 THEN 15 ELSE greatest(least(lag(step) OVER (PARTITION BY id, seq ORDER BY i) // 60, 15), -15)
  + 15 END AS token FROM {source}
"""
for tag, source in (("t", "chosen"), ("i", "asked")):
    _part(f"delay_{tag}", f"{source} st arr_p", _DELTAS.format(source=source))
    _part(f"step_{tag}", f"delay_{tag}", _STEPS.format(source=f"delay_{tag}"))
    _part(f"token_{tag}", f"step_{tag}", _TOKENS.format(source=f"step_{tag}"))
_part("asked", "runs_p plans", """
SELECT r.id, r.run, r.trip, r.n, r.seq, r.highest, r.ts, r.ts // 86400 AS day, p.rollover, p.secs0
FROM runs_p r JOIN plans p ON p.trip = r.trip WHERE r.kind = 'new' AND p.plain
""")
_HEAD = """'31,' || (34 + l.r * (t.trip % 2) + rw.ix) || ',' ||
  (l.day0 + (day - CASE WHEN rollover > 0 THEN 1 ELSE 0 END + 3) % 7) || ',' || (l.hour0 + secs0 // 3600)"""
_part("train", "token_t layout route_words stop_words trips", f"""
SELECT id, seq, t.trip, t.n, {_HEAD} || ',' || string_agg((l.stop0 + sw.ix) || ',' || token, ',' ORDER BY i) || ',32'
  || repeat(',33', greatest(75 - 5 - 2 * t.n, 0)::INTEGER) AS tokens
FROM token_t t JOIN trips USING (trip) JOIN route_words rw USING (route) JOIN stop_words sw USING (stop), layout l
GROUP BY id, seq, t.trip, t.n, rw.ix, day, rollover, secs0, l.r, l.day0, l.hour0
""")
_part("infer", "token_i layout route_words stop_words trips", f"""
SELECT id, seq, t.trip, t.n, highest, {_HEAD} || ',' || string_agg((l.stop0 + sw.ix) || ',' ||
  CASE WHEN i <= highest + 1 THEN token ELSE l.skip END, ',' ORDER BY i)
  || repeat(',33', greatest(75 - 4 - 2 * t.n, 0)::INTEGER) AS tokens
FROM token_i t JOIN trips USING (trip) JOIN route_words rw USING (route) JOIN stop_words sw USING (stop), layout l
GROUP BY id, seq, t.trip, t.n, highest, rw.ix, day, rollover, secs0, l.r, l.day0, l.hour0
""")
# Decoded inference sequences: skip tokens count as zero delay and the padding ends the answer.
_part("infer_list", "infer", """
SELECT id, seq, trip, n, highest, CAST(string_split(tokens, ',') AS INTEGER[]) AS tk FROM infer
""")
_part("infer_parts", "infer_list layout", """
SELECT id, seq, trip, n, tk[p + 1] AS x, p, list_contains(tk, skip) AS asking,
  CASE WHEN list_contains(tk, skip) THEN (list_position(tk, skip) - 1 - 3) // 2 - 1 ELSE 100 END AS first_predicted
FROM infer_list, layout, LATERAL (SELECT unnest(range(5, len(tk), 2)) AS p)
""")
_part("decoded", "infer_parts", """
SELECT id, seq, first_predicted, list(CAST(total AS INTEGER) ORDER BY p) AS delay FROM (
  SELECT *, sum(CASE WHEN x > 30 THEN 0 ELSE x - 15 END) OVER (PARTITION BY id, seq ORDER BY p) AS total
  FROM infer_parts WHERE NOT asking OR p < 4 + 2 * n
) GROUP BY 1, 2, 3
""")
_part("train_list", "train", """
SELECT trip, id, seq, n, CAST(string_split(tokens, ',') AS INTEGER[]) AS tk FROM train
""")
_part("examples", "train_list", """
SELECT trip, tk, p AS place, CAST(tk[p + 1] - 15 AS DOUBLE) AS label
FROM train_list, LATERAL (SELECT unnest(range(7, len(tk), 2)) AS p) WHERE tk[p + 1] <> 33
""")
_part("persisted", "examples", """
SELECT trip, place, label, CAST(tk[place - 1] - 15 AS DOUBLE) AS prediction FROM examples
""")
_part("state", "mixed trips", """
SELECT id, arg_max(lat, seq) AS lat, arg_max(lng, seq) AS lng, arg_max(trip, seq) AS trip,
  arg_max(route_type, seq) FILTER (WHERE route_type IS NOT NULL) AS route_type, max(seq) AS seq,
  min(seq) FILTER (WHERE route_type IS NOT NULL) AS entered
FROM mixed LEFT JOIN trips t USING (trip) WHERE trip IS NOT NULL GROUP BY 1
""")
_part("spots", "driven", """
SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth
FROM (SELECT id, lat, lng, max(seq) AS seq FROM driven GROUP BY 1, 2, 3)
""")
_part("moves", "spots", """
SELECT a.id, a.seq, a.lat, a.lng, coalesce(b.lat, a.lat) AS prev_lat, coalesce(b.lng, a.lng) AS prev_lng
FROM spots a LEFT JOIN spots b ON b.id = a.id AND b.nth = 2 WHERE a.nth = 1
""")
_part("grams", "train_list", """
SELECT tk[p + 1] AS next, tk[p] AS prev, CASE WHEN p >= 2 THEN tk[p - 1] ELSE -1 END AS before,
  CASE WHEN p > 1 THEN tk[2] ELSE -1 END AS route, CASE WHEN p > 3 THEN tk[4] ELSE -1 END AS hour, split
FROM (SELECT *, {split} AS split FROM train_list), LATERAL (SELECT unnest(range(1, len(tk))) AS p)
WHERE tk[p + 1] <> 33
""".replace("{split}", """CASE WHEN ('0x' || substr(md5(CAST(trip AS VARCHAR) || '#0'), 1, 8))::BIGINT
  / 4294967296.0 < 0.85 THEN 'train' ELSE 'test' END"""))

for level, columns in (("1", "prev"), ("2", "before, prev"), ("3", "route, hour, before, prev")):
    _part(f"count{level}", "grams", f"""
SELECT {columns}, next, count(*) AS n, sum(count(*)) OVER (PARTITION BY {columns}) AS total,
  count(*) OVER (PARTITION BY {columns}) AS kinds,
  row_number() OVER (PARTITION BY {columns} ORDER BY count(*) DESC, next) AS nth
FROM grams WHERE split = 'train' GROUP BY {columns}, next
""")
_part("count0", "grams", """
SELECT next, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, next) AS nth
FROM grams WHERE split = 'train' GROUP BY next
""")
for level, columns in (("1", "prev"), ("2", "before, prev"), ("3", "route, hour, before, prev")):
    _part(f"seen{level}", f"count{level}", f"SELECT DISTINCT {columns}, total, kinds FROM count{level}")
    _part(f"best{level}", f"count{level}", f"SELECT {columns}, next AS best FROM count{level} WHERE nth = 1")
# Most likely token for (route, hour, stop, last delta), place by place; the exact context needs every part equal.
_part("filling", "infer_list layout best1 best2 best3 count0", """
SELECT * FROM (
  WITH RECURSIVE walk(id, seq, n, tk, asked, p) AS (
    SELECT id, seq, n, tk[1:4 + 2 * n], list_contains(tk, skip), 5 FROM infer_list, layout
    UNION ALL
    SELECT w.id, w.seq, w.n, list_concat(list_concat(w.tk[1:p], [CASE WHEN w.tk[p + 1] = skip
      THEN coalesce(b3.best, b2.best, b1.best, (SELECT next FROM count0 WHERE nth = 1)) ELSE w.tk[p + 1] END]),
      w.tk[p + 2:4 + 2 * w.n]), asked, p + 2
    FROM walk w JOIN layout ON w.p < 4 + 2 * w.n
    LEFT JOIN best3 b3 ON b3.route = w.tk[2] AND b3.hour = w.tk[4] AND b3.before = w.tk[p - 1] AND b3.prev = w.tk[p]
    LEFT JOIN best2 b2 ON b2.before = w.tk[p - 1] AND b2.prev = w.tk[p]
    LEFT JOIN best1 b1 ON b1.prev = w.tk[p]
  )
  SELECT * FROM walk WHERE p >= 4 + 2 * n
)
""")
# What was asked is decoded from the filled sequence, the rest as it is.
_part("predicted", "filling infer_list layout", """
SELECT id, seq, first_predicted, list(CAST(total AS INTEGER) ORDER BY p) AS delay FROM (
  SELECT id, seq, p, CASE WHEN f.asked THEN (list_position(i.tk, skip) - 1 - 3) // 2 - 1 ELSE 100 END AS first_predicted,
    sum(CASE WHEN x > 30 THEN 0 ELSE x - 15 END) OVER (PARTITION BY id, seq ORDER BY p) AS total
  FROM (SELECT id, seq, f.asked, u.p, CASE WHEN u.p < len(f.tk) THEN f.tk[u.p + 1] ELSE 33 END AS x
    FROM filling f, LATERAL (SELECT unnest(range(5, CASE WHEN f.asked THEN len(f.tk) ELSE 75 END, 2)) AS p) u) f
  JOIN infer_list i USING (id, seq), layout
) GROUP BY 1, 2, 3
""")

# ---- timetables that change, archives that roll ---------------------------------------------------------------------

_part("turn", "driven", "SELECT (min(ts) + max(ts)) // 2 AS turned FROM driven")
_part("versions", "trips turn", """
SELECT trip, route_type, 0 AS valid_from, CASE WHEN trip % 7 = 0 OR (trip % 3 = 0 AND n > 1) THEN turned END AS valid_to, n
FROM trips, turn WHERE n IS NOT NULL
UNION ALL
SELECT trip, route_type, turned, NULL, n - 1 FROM trips, turn WHERE trip % 7 <> 0 AND trip % 3 = 0 AND n > 1
""")
_part("hits_v", "driven versions st", """
SELECT id, seq, ts, trip, valid_from, n, CASE WHEN dist < 250 THEN i END AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY dist, i) AS rn FROM (
    SELECT e.id, e.seq, e.ts, e.trip, v.valid_from, v.n, s.q - 1 AS i, 2 * 6378137.0 * atan2(sqrt(a), sqrt(1 - a)) AS dist
    FROM driven e JOIN versions v ON v.trip = e.trip AND v.route_type = 401 AND v.valid_from <= e.ts
      AND (v.valid_to IS NULL OR e.ts < v.valid_to)
    JOIN st s ON s.trip = e.trip AND s.q <= v.n,
    LATERAL (SELECT pow(sin((radians(s.lat) - radians(e.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(e.lat))
      * pow(sin((radians(s.lon) - radians(e.lng)) / 2), 2) AS a)
  )
) WHERE rn = 1
""")
_part("numbered_v", "hits_v", """
SELECT *, CAST(sum(CASE WHEN trip <> prev OR valid_from <> since THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq) AS BIGINT)
  AS run
FROM (SELECT *, lag(trip) OVER (PARTITION BY id ORDER BY seq) AS prev,
  lag(valid_from) OVER (PARTITION BY id ORDER BY seq) AS since FROM hits_v)
""")
_part("archived", "mixed", f"""
SELECT *, row_number() OVER (ORDER BY seq) - 1 AS rank, seq < low + step AS in1, seq < low + 2 * step AS in2
FROM (SELECT *, min(seq) OVER () AS low, (max(seq) OVER () - min(seq) OVER ()) // 3 + 1 AS step FROM mixed)
WHERE trip IS NOT NULL
""")
# The first group closes with the first third of the events that makes it large enough; its first file ends at the limit
# unless the group is shorter than two files.
_part("first_file", "archived", f"""
SELECT CASE WHEN held >= 2 * {ROLL_ROWS} THEN {ROLL_ROWS} ELSE held END AS n FROM (
  SELECT CASE WHEN n1 >= {ROLL_ROWS} THEN n1 WHEN n2 >= {ROLL_ROWS} THEN n2 ELSE n3 END AS held
  FROM (SELECT count(*) FILTER (in1) AS n1, count(*) FILTER (in2) AS n2, count(*) AS n3 FROM archived)
)
""")
# Feed messages of the events of five ingest numbers; every ninth is cut off.
_part("feed", "mixed", """
SELECT *, (seq // 5) % 9 = 0 AS broken, seq % 11 = 0 OR seq % 13 = 0 OR seq % 17 = 0 AS incomplete FROM mixed
""")


def sql() -> dict[str, str]:
    out = {
        "stop_arrivals": _with("arr_p plans st", """
SELECT a.id, a.run, CAST(a.trip AS VARCHAR) AS trip_id, s.q AS stop_sequence, s.stop_name, a.ts AS arrival,
  (a.ts // 86400) * 86400 + s.secs % 86400 - CASE WHEN a.hit < p.rollover THEN 86400 ELSE 0 END - 3600 AS scheduled,
  a.ts - ((a.ts // 86400) * 86400 + s.secs % 86400 - CASE WHEN a.hit < p.rollover THEN 86400 ELSE 0 END - 3600) AS delay_s
FROM arr_p a JOIN plans p ON p.trip = a.trip JOIN st s ON s.trip = a.trip AND s.q = a.hit + 1
"""),
        "trip_nested_stops": _with("trips st", f"""
SELECT {_ATTRIBUTES}, n AS n_stops, (SELECT string_agg(q || ':' || stop || ':' || arrival_time || ':' ||
  departure_time, ' ' ORDER BY q) FROM st WHERE st.trip = t.trip) AS calls FROM trips t
"""),
        "trip_pipe_lists": _with("trips st", f"""
SELECT {_ATTRIBUTES}, stop_id, stop_name, stop_lat, stop_lon, stop_sequence, arrival_time, departure_time,
  shape_dist_traveled
FROM trips t LEFT JOIN (SELECT trip, string_agg(stop, '|' ORDER BY q) AS stop_id,
  string_agg(stop_name, '|' ORDER BY q) AS stop_name, string_agg(lat, '|' ORDER BY q) AS stop_lat,
  string_agg(lon, '|' ORDER BY q) AS stop_lon, string_agg(q, '|' ORDER BY q) AS stop_sequence,
  string_agg(arrival_time, '|' ORDER BY q) AS arrival_time,
  string_agg(departure_time, '|' ORDER BY q) AS departure_time,
  string_agg(dist, '|' ORDER BY q) AS shape_dist_traveled FROM st GROUP BY 1) x ON x.trip = t.trip
"""),
        "pipe_roundtrip": _with("st", """
SELECT CAST(trip AS VARCHAR) AS trip_id, q AS stop_sequence, CAST(stop AS VARCHAR) AS stop_id, stop_name,
  arrival_time, departure_time, lat AS stop_lat, lon AS stop_lon, dist AS shape_dist_traveled FROM st
"""),
        "compact_timetable": _with("st", """
SELECT CAST(trip AS VARCHAR) AS trip_id, q AS stop_sequence, stop_name, lon AS stop_lon, lat AS stop_lat,
  arrival_time FROM st
"""),
        "trip_lookup": _with("st", """
SELECT CAST(trip AS VARCHAR) AS trip_id, q AS stop_sequence, stop_name, arrival_time FROM st
WHERE trip = (SELECT max(o_orderkey) // 2 FROM orders)
"""),
        "enriched_positions": _with("mixed trips", """
SELECT seq, id, round(lng, 6) AS lng, round(lat, 6) AS lat, ts AS timestamp, CAST(trip AS VARCHAR) AS trip_id,
  route_type, agency_name, route_short_name, route_long_name, headsign AS trip_headsign, shape_id, direction_id
FROM mixed LEFT JOIN trips USING (trip) WHERE trip IS NOT NULL
"""),
        "feed_positions": _with("mixed", """
SELECT seq, id, round(lat, 6) AS lat, round(lng, 6) AS lng, CAST(trip AS VARCHAR) AS trip_id, ts AS timestamp
FROM mixed
"""),
        "live_messages": _with("mixed trips", """
SELECT seq, id, CAST(trip AS VARCHAR) AS trip_id, route_type FROM mixed LEFT JOIN trips USING (trip)
WHERE trip IS NOT NULL
"""),
        "trip_runs": _with("runs_m", """
SELECT id, seq, CAST(trip AS VARCHAR) AS trip_id, run FROM runs_m
"""),
        "real_stop_snapshots": _with("runs_m arr_m", """
SELECT r.id, r.seq, r.run, r.highest, string_agg(coalesce(CAST(a.ts AS VARCHAR), '-'), ',' ORDER BY i) AS times
FROM runs_m r, LATERAL (SELECT unnest(range(0, r.n)) AS i)
LEFT JOIN arr_m a ON a.id = r.id AND a.run = r.run AND a.hit = i AND a.seq <= r.seq
GROUP BY 1, 2, 3, 4
"""),
        "inference_emits": _with("runs_m", """
SELECT id, seq, highest, kind FROM runs_m WHERE kind IS NOT NULL
"""),
        "schedule_resolved": _with("plans st", """
SELECT CAST(s.trip AS VARCHAR) AS trip_id, q AS stop_sequence, CAST(epoch(o_orderdate) AS BIGINT) // 86400 * 86400
  + secs % 86400 - CASE WHEN q - 1 < rollover THEN 86400 ELSE 0 END - 3600 AS scheduled
FROM st s JOIN plans p ON p.trip = s.trip JOIN orders ON o_orderkey = s.trip
"""),
        "delay_tokens": _with("step_t", """
SELECT CAST(trip AS VARCHAR) AS trip_id, i AS stop_index, delay, step,
  greatest(least(step // 60, 15), -15) + 15 AS token FROM step_t
"""),
        "training_gate": _with("gate", """
SELECT id, run, CAST(trip AS VARCHAR) AS trip_id, n AS n_stops, gate AS seq FROM gate
"""),
        "train_sequences": _with("train", """
SELECT CAST(trip AS VARCHAR) AS trip_id, id, seq, tokens FROM train
"""),
        "infer_sequences": _with("infer", """
SELECT CAST(trip AS VARCHAR) AS trip_id, id, seq, highest, tokens FROM infer
"""),
        "infer_messages": _with("infer runs_p", """
SELECT id, seq, id || ':' || tokens AS message FROM infer
UNION ALL SELECT id, seq, id FROM runs_p WHERE kind = 'resend'
"""),
        "vocab_coverage": _with("trips st route_words", """
SELECT 'route' AS kind, CAST(route AS VARCHAR) AS name, count(*) AS uses FROM trips
WHERE route NOT IN (SELECT route FROM route_words) GROUP BY 2
UNION ALL SELECT 'stop', stop_name, count(*) FROM st
WHERE stop_name NOT IN (SELECT s_name FROM supplier WHERE s_acctbal >= 0) GROUP BY 2
"""),
        "vocabulary": _with("layout route_words stop_words", """
SELECT i AS token, CASE WHEN i < 15 THEN 'd-' || (15 - i) ELSE 'd+' || (i - 15) END AS text, 'delta' AS kind
FROM (SELECT unnest(range(0, 31)) AS i)
UNION ALL SELECT * FROM (VALUES (31, '<sos>', 'marker'), (32, '<eos>', 'marker'), (33, '<pad>', 'marker'))
UNION ALL SELECT skip, '<skp>', 'marker' FROM layout
UNION ALL SELECT 34 + r * dir + ix, route || '|' || dir, 'route' FROM route_words, layout, (VALUES (0), (1)) v(dir)
UNION ALL SELECT stop0 + ix, s_name, 'stop' FROM stop_words, layout
UNION ALL SELECT day0 + i, day, 'weekday' FROM layout, (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'),
  (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) v(i, day)
UNION ALL SELECT hour0 + i, 'h' || i, 'hour' FROM layout, (SELECT unnest(range(0, 24)) AS i)
"""),
        "decode_delays": _with("predicted", """
SELECT id, seq, first_predicted AS first_predicted_sequence, array_to_string(delay, ',') AS delay FROM predicted
"""),
        "resend_predictions": _with("predicted runs_p", """
SELECT id, seq, first_predicted_sequence, array_to_string(d, ',') AS delay FROM (
  SELECT id, seq, kind, last_value(delay IGNORE NULLS) OVER w AS d,
    last_value(first_predicted IGNORE NULLS) OVER w AS first_predicted_sequence
  FROM runs_p LEFT JOIN predicted USING (id, seq)
  WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)
) WHERE kind = 'resend' AND d IS NOT NULL
"""),
        "timetable_view": _with("state predicted st", """
SELECT v.id, CAST(v.trip AS VARCHAR) AS trip_id, s.q AS stop_sequence, s.stop_name, s.arrival_time,
  d.delay[s.q] AS delay, s.q >= coalesce(nullif(d.first_predicted, 0), 1000) AS predicted
FROM state v JOIN st s ON s.trip = v.trip
LEFT JOIN (SELECT id, arg_max(delay, seq) AS delay, arg_max(first_predicted, seq) AS first_predicted, max(seq) AS made
  FROM predicted GROUP BY 1) d ON d.id = v.id AND d.made >= v.entered
WHERE v.entered IS NOT NULL
"""),
        "latest_vehicle_state": _with("state trips", """
SELECT s.id, s.seq, round(lat, 6) AS lat, round(lng, 6) AS lng, CAST(s.trip AS VARCHAR) AS trip_id,
  coalesce(s.route_type, t.route_type) AS route_type, route_short_name, headsign AS trip_headsign
FROM state s LEFT JOIN trips t USING (trip) WHERE entered IS NOT NULL
"""),
        "viewport_vehicles": _with("moves", """
SELECT id, seq, round(lat, 6) AS lat, round(lng, 6) AS lng FROM moves
WHERE ((lat < 59.055 AND lat > 59.015) OR (prev_lat < 59.055 AND prev_lat > 59.015))
  AND ((lng < 18.455 AND lng > 18.015) OR (prev_lng < 18.455 AND prev_lng > 18.015))
"""),
        "nearest_vehicle": _with("moves", """
SELECT point_id, id, dist FROM (
  SELECT point_id, id, round(dist, 3) AS dist, row_number() OVER (PARTITION BY point_id ORDER BY round(dist, 3), id) AS nth
  FROM (
    SELECT s_suppkey AS point_id, m.id, 2 * 6378137.0 * atan2(sqrt(a), sqrt(1 - a)) AS dist
    FROM (SELECT s_suppkey, round(59.0::DOUBLE + (s_suppkey % 10) * 0.01::DOUBLE, 2) AS lat,
      round(18.0::DOUBLE + (s_suppkey // 10) * 0.01::DOUBLE, 2) AS lng FROM supplier) p, moves m,
    LATERAL (SELECT pow(sin((radians(m.lat) - radians(p.lat)) / 2), 2) + cos(radians(m.lat)) * cos(radians(p.lat))
      * pow(sin((radians(m.lng) - radians(p.lng)) / 2), 2) AS a)
  ) WHERE dist < 250
) WHERE nth = 1
"""),
        "resampled_tracks": _with("driven", """
SELECT id, seq, ts + e AS timestamp, round(prev_lat * (1 - e * 1000 / (dur + 1)) + lat * (e * 1000 / (dur + 1)), 6)
  AS lat, round(prev_lng * (1 - e * 1000 / (dur + 1)) + lng * (e * 1000 / (dur + 1)), 6) AS lng
FROM (SELECT *, (ts - prev_ts) * 1000 * 1.5::DOUBLE AS dur FROM (
    SELECT *, lag(lat) OVER w AS prev_lat, lag(lng) OVER w AS prev_lng, lag(ts) OVER w AS prev_ts FROM driven
    WINDOW w AS (PARTITION BY id ORDER BY seq))
  WHERE ts > prev_ts AND (lat <> prev_lat OR lng <> prev_lng)),
LATERAL (SELECT unnest(range(0, CAST(floor(dur / 1000) AS BIGINT) + 1, 3600)) AS e)
"""),
        "route_class_counts": _with("mixed trips", """
SELECT CASE WHEN route_type IS NULL OR route_type = 0 THEN 'other' WHEN route_type < 400 THEN 'train'
  WHEN route_type < 700 THEN 'metro' WHEN route_type < 900 THEN 'bus' WHEN route_type < 1000 THEN 'tram'
  WHEN route_type IN (1000, 1200) THEN 'water' WHEN route_type BETWEEN 1500 AND 1507 THEN 'taxi' ELSE 'other' END
  AS class, count(*) AS events, count(DISTINCT id) AS vehicles
FROM mixed LEFT JOIN trips USING (trip) WHERE trip IS NOT NULL GROUP BY 1
"""),
        "display_text": _with("trips", """
SELECT CAST(trip AS VARCHAR) AS trip_id, coalesce(nullif(concat_ws(' ', nullif(route_short_name, ''),
  nullif(route_long_name, ''), 'mot ' || nullif(headsign, '')), ''), 'Ingen information') AS text FROM trips
"""),
        "visit_stats": """
SELECT count(*) FILTER (WHERE age < 3600) AS last_hour, count(*) FILTER (WHERE age < 86400) AS last_day,
  count(*) AS total
FROM (SELECT (SELECT max(epoch_us(ts)) FROM events) / 1e6 - epoch_us(ts) / 1e6 AS age FROM events)
""",
        "prefix_examples": _with("examples", """
SELECT CAST(trip AS VARCHAR) AS trip_id, place, label,
  array_to_string(list_transform(tk, lambda x, i: CASE WHEN i - 1 >= place THEN 33 ELSE x END), ',') AS tokens
FROM examples
"""),
        "tree_delay_model": _with("examples", """
SELECT count(*) FILTER (v >= 0.7) AS tested, round(avg(label) FILTER (v >= 0.7), 6) AS label_mean,
  round(var_pop(label) FILTER (v >= 0.7), 6) AS label_variance, true AS fits, count(*) FILTER (v < 0.7) AS fitted
FROM (SELECT *, ('0x' || substr(md5(CAST(trip AS VARCHAR) || '#0'), 1, 8))::BIGINT / 4294967296.0 AS v FROM examples)
"""),
        "shifted_pairs": _with("train_list", """
SELECT CAST(trip AS VARCHAR) AS trip_id, array_to_string(tk[1:len(tk) - 1], ',') AS x,
  array_to_string(tk[2:len(tk)], ',') AS y FROM train_list
"""),
        "wide_features": _with("train_list", "SELECT " + ", ".join(
            f"coalesce(tk[{i + 1}], 33) AS feature_{i:02d}" for i in range(75)) + " FROM train_list"),
        "split_counts": _with("train_list", """
SELECT split, count(*) AS samples, max(longest) AS longest, count(DISTINCT token) AS tokens_used FROM (
  SELECT split, trip, max(longest) OVER (PARTITION BY split) AS longest, unnest(list_distinct(tk)) AS token, tk FROM (
    SELECT *, len(list_filter(tk, lambda x: x <> 33)) AS longest, CASE WHEN v < 0.7 THEN 'train' WHEN v < 0.85 THEN 'val'
      ELSE 'test' END AS split
    FROM (SELECT *, ('0x' || substr(md5(CAST(trip AS VARCHAR) || '#0'), 1, 8))::BIGINT / 4294967296.0 AS v
      FROM train_list))
) GROUP BY 1
""".replace("count(*) AS samples", "count(DISTINCT trip) AS samples")),
        "residual_topk": _with("persisted", """
SELECT CAST(trip AS VARCHAR) AS trip_id, place, label, prediction, label - prediction AS err FROM persisted
ORDER BY err DESC, CAST(trip AS VARCHAR), place LIMIT 30
"""),
        "error_metrics": _with("persisted", """
SELECT round(avg((label - prediction) * (label - prediction)), 6) AS mse, round(avg(abs(label - prediction)), 6)
  AS mae, max(abs(label - prediction)) AS max_error, max(prediction) AS max_prediction,
  min(prediction) AS min_prediction, round(avg(prediction), 6) AS mean_prediction FROM persisted
"""),
        "next_token_model": _with("grams", """
SELECT route, hour, before, prev, next, count(*) AS n FROM grams WHERE split = 'train' GROUP BY ALL
"""),
    }
    out["next_token_loss"] = _with("grams count0 count1 count2 count3 seen1 seen2 seen3 layout", """
SELECT count(*) AS targets, round(avg(-ln(p3)), 6) AS loss, round(avg(-ln(p0)), 6) AS unigram_loss FROM (
  SELECT *, CASE WHEN s3.total IS NULL THEN p2 ELSE (coalesce(c3.n, 0) + s3.kinds * p2) / (s3.total + s3.kinds) END
    AS p3
  FROM (
    SELECT *, CASE WHEN s2.total IS NULL THEN p1 ELSE (coalesce(c2.n, 0) + s2.kinds * p1) / (s2.total + s2.kinds) END
      AS p2
    FROM (
      SELECT *, CASE WHEN s1.total IS NULL THEN p0 ELSE (coalesce(c1.n, 0) + s1.kinds * p0) / (s1.total + s1.kinds)
        END AS p1
      FROM (
        SELECT g.route, g.hour, g.before, g.prev, g.next, (coalesce(c0.n, 0) + 1.0::DOUBLE)
          / ((SELECT max(total) FROM count0) + skip + 1) AS p0
        FROM grams g JOIN layout ON g.split = 'test' LEFT JOIN count0 c0 ON c0.next = g.next
      ) g LEFT JOIN count1 c1 USING (prev, next) LEFT JOIN seen1 s1 USING (prev)
    ) g LEFT JOIN count2 c2 USING (before, prev, next) LEFT JOIN seen2 s2 USING (before, prev)
  ) g LEFT JOIN count3 c3 USING (route, hour, before, prev, next) LEFT JOIN seen3 s3 USING (route, hour, before, prev)
)
""")
    out["fill_predictions"] = out["decode_delays"]
    out["stream_stop_arrivals"] = _with("arr_p", """
SELECT id, run, CAST(trip AS VARCHAR) AS trip_id, hit AS stop_index, seq, ts AS timestamp FROM arr_p
""")
    out["prediction_messages"] = _with("predicted", """
SELECT '{"id":"' || id || '","delay":[' || array_to_string(delay, ',') || '],"first_predicted_sequence":' ||
  first_predicted || '}' AS value FROM predicted
""")
    out["latest_predictions"] = _with("predicted", """
SELECT id, max(seq) AS seq, arg_max(first_predicted, seq) AS first_predicted_sequence,
  array_to_string(arg_max(delay, seq), ',') AS delay FROM predicted GROUP BY 1
""")
    out["stream_predictions"] = out["fill_predictions"]
    out["stream_feed_positions"] = _with("mixed", """
SELECT id, round(lat, 6) AS lat, round(lng, 6) AS lng, CAST(trip AS VARCHAR) AS trip_id, ts AS timestamp FROM mixed
""")
    out["stream_train_sequences"] = out["train_sequences"]
    out["stream_infer_messages"] = out["infer_messages"]
    out["archive_roll"] = _with("mixed trips", """
SELECT id, round(lng, 6) AS lng, round(lat, 6) AS lat, ts AS timestamp, CAST(trip AS VARCHAR) AS trip_id, route_type,
  agency_name, route_short_name, route_long_name, headsign AS trip_headsign, shape_id, direction_id
FROM mixed LEFT JOIN trips USING (trip) WHERE trip IS NOT NULL
""")
    out["archive_replay"] = _with("mixed trips", """
SELECT id, round(lng, 6) AS lng, round(lat, 6) AS lat, ts AS timestamp, CAST(trip AS VARCHAR) AS trip_id
FROM mixed WHERE trip IS NOT NULL
""")
    out["versioned_arrivals"] = out["stream_versioned_arrivals"] = _with("numbered_v", """
SELECT id, run, CAST(trip AS VARCHAR) AS trip_id, valid_from, hit AS stop_index, n AS n_stops, min(seq) AS seq,
  arg_min(ts, seq) AS timestamp
FROM numbered_v WHERE hit IS NOT NULL GROUP BY id, run, trip, valid_from, hit, n
""")
    out["stream_archive_roll"] = out["archive_roll"]
    out["replay_order"] = _with("archived first_file", """
SELECT rank - n + 1 AS seq, id, round(lat, 6) AS lat, round(lng, 6) AS lng, CAST(trip AS VARCHAR) AS trip_id, ts AS timestamp
FROM archived, first_file WHERE rank >= n
""")
    out["replay_arrivals"] = _with("arr_m", """
SELECT id, run, CAST(trip AS VARCHAR) AS trip_id, hit AS stop_index, ts AS timestamp FROM arr_m
""")
    out["stream_feature_table"] = out["wide_features"]
    out["feed_quarantine"] = _with("feed", """
SELECT 'position' AS kind, 1 AS n, id, round(lat, 6) AS lat, round(lng, 6) AS lng, CAST(trip AS VARCHAR) AS trip_id, ts AS timestamp
FROM feed WHERE NOT broken AND NOT incomplete
UNION ALL SELECT kind, n, NULL, NULL, NULL, NULL, NULL FROM (
  SELECT 'messages' AS kind, count(DISTINCT seq // 5) AS n FROM feed
  UNION ALL SELECT 'broken', count(DISTINCT seq // 5) FROM feed WHERE broken
  UNION ALL SELECT 'kept broken', count(DISTINCT seq // 5) FROM feed WHERE broken
  UNION ALL SELECT 'entities', count(*) FROM feed WHERE NOT broken
  UNION ALL SELECT 'incomplete', count(*) FROM feed WHERE NOT broken AND incomplete
  UNION ALL SELECT 'kept incomplete', count(*) FROM feed WHERE NOT broken AND incomplete
  UNION ALL SELECT 'positions', count(*) FROM feed WHERE NOT broken AND NOT incomplete
)
""")
    answer = """'{"id":"' || id || '","delay":[' || array_to_string(delay, ',') || '],"first_predicted_sequence":' || first_predicted || '}'"""
    out["stream_prediction_messages"] = _with("predicted runs_p", f"""
SELECT id, seq, 'fresh' AS kind, {answer} AS value FROM predicted
UNION ALL
SELECT id, seq, 'repeated', {answer} FROM (
  SELECT id, seq, kind, last_value(p.delay IGNORE NULLS) OVER w AS delay, last_value(p.first_predicted IGNORE NULLS) OVER w AS first_predicted
  FROM runs_p LEFT JOIN predicted p USING (id, seq) WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)
) WHERE kind = 'resend' AND delay IS NOT NULL
""")
    out["best_model"] = f"""
WITH entropy AS ({out["next_token_loss"]})
SELECT 1 AS version, unigram_loss AS loss, unigram_loss < loss AS best FROM entropy
UNION ALL SELECT 2, loss, loss <= unigram_loss FROM entropy
"""
    out["stream_visit_stats"] = """
SELECT start, count(*) AS visits FROM (
  SELECT unnest([b, b - 900, b - 1800, b - 2700]) AS start FROM (SELECT epoch_us(ts) // 900000000 * 900 AS b FROM events)
) GROUP BY 1
"""
    out["timetable_files"] = out["trip_nested_stops"]
    out["trip_list_rejects"] = _with("trips st", """
SELECT CAST(t.trip AS VARCHAR) AS trip_id, n = 0 OR (t.trip % 5 <> 0 AND t.trip % 7 <> 0) AS parsed, n AS n_stops
FROM (SELECT t.trip, count(st.trip) AS n FROM trips t LEFT JOIN st ON st.trip = t.trip GROUP BY 1) t
""")
    out["stored_features"] = _with("train_list", """
SELECT array_to_string(list_resize(tk, greatest(75, (SELECT max(len(tk)) FROM train_list)), 33), ',') AS tokens FROM train_list
""")
    out["token_csv"] = _with("examples", "SELECT place, label, count(*) AS n FROM examples GROUP BY 1, 2")
    out["tree_signal_model"] = _with("examples", """
SELECT count(*) AS tested, round(avg(place), 6) AS label_mean, round(var_pop(place), 6) AS label_variance, true AS learned
FROM examples WHERE ('0x' || substr(md5(CAST(trip AS VARCHAR) || '#0'), 1, 8))::BIGINT / 4294967296.0 >= 0.7
""")
    return out
