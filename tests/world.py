"""A small made-up network, random traffic over it, and an event-at-a-time model of what must come out."""

import math
import random
from collections import defaultdict

TRIP_DDL = (
    "trip_id string, shape_id bigint, route_id string, direction_id int, route_type bigint, route_short_name string, "
    "route_long_name string, trip_headsign string, agency_id bigint, agency_name string, "
    "stops array<struct<stop_sequence:int,stop_id:string,stop_name:string,arrival_time:string,departure_time:string,"
    "stop_lat:double,stop_lon:double,shape_dist_traveled:double>>"
)
POSITION_DDL = "seq bigint, id string, lat double, lng double, trip_id string, timestamp bigint"


def make_trip(trip_id, times, places=None, route_type=401, route="R0", direction=0, names=None):
    """A trip whose i-th stop is at latitude 59 + places[i] / 100, about 1.1 km apart."""
    places = list(range(len(times))) if places is None else places
    names = [f"S{p}" for p in places] if names is None else names
    stops = [
        (i + 1, f"id{p}", name, t, t, 59.0 + p * 0.01, 18.0, 1000.0 * i)
        for i, (t, p, name) in enumerate(zip(times, places, names))
    ]
    return (trip_id, 1, route, direction, route_type, "13", None, "Ropsten", 1, "SL", stops or None)


def trips_frame(spark, trips):
    return spark.createDataFrame(trips, TRIP_DDL)


def positions_frame(spark, rows):
    return spark.createDataFrame(rows, POSITION_DDL)


def at(seq, vehicle, trip, place, ts):
    """A position at a place (``None``: 500 m beside it all)."""
    lat = 58.0 if place is None else 59.0 + place * 0.01
    return (seq, vehicle, lat, 18.0, trip, ts)


def clock(seconds):
    return f"{seconds // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"


def random_world(seed, events=600, hot=True):
    rng = random.Random(seed)
    trips = []
    for i in range(12):
        n = rng.choice([1, 2, 3, 4, 5, 6, 8])
        start = rng.choice([6 * 3600, 23 * 3600 + 2400, 86_400 + 600 if i == 5 else 12 * 3600])
        seconds = [start + 240 * k for k in range(n)]
        if start < 86_400:
            seconds = [s % 86_400 for s in seconds]
        places = [rng.randrange(8) for _ in range(n)]
        kind = 401 if i % 4 else rng.choice([401, 700])
        trips.append(make_trip(f"t{i}", [clock(s) for s in seconds], places, kind, f"R{i % 3}", i % 2))
    trips.append(make_trip("empty", []))
    current = {}
    rows = []
    for seq in range(events):
        vehicle = "v0" if hot and rng.random() < 0.4 else f"v{rng.randrange(6)}"
        if vehicle not in current or rng.random() < 0.08:
            current[vehicle] = rng.choice([f"t{i}" for i in range(12)] + ["empty", "missing", "", None])
        place = rng.choice([None] + list(range(8)))
        rows.append(at(seq, vehicle, current[vehicle], place, 1_700_000_000 + seq * 37 + rng.randrange(-500, 500)))
    rng.shuffle(rows)
    return trips, rows


def metres(lat1, lon1, lat2, lon2):
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6378137.0 * math.asin(math.sqrt(a))


class Model:
    """Goes through the events one by one and notes what each vehicle must show."""

    def __init__(self, trips, rows):
        self.by_id = {t[0]: t for t in trips}
        self.tracked = {}  # seq -> (id, trip, run, highest, kind, times)
        self.gated = {}  # trip -> (seq, id, times, ts), first opening only
        trip_now, run_now, times_now, judged = {}, defaultdict(lambda: -1), {}, {}
        for seq, vehicle, lat, lng, trip_id, ts in sorted(rows):
            trip = self.by_id.get(trip_id)
            if trip is None or trip[4] != 401 or trip[10] is None:
                continue
            stops = trip[10]
            if trip_now.get(vehicle) != trip_id:
                trip_now[vehicle] = trip_id
                run_now[vehicle] += 1
                times_now[vehicle] = [None] * len(stops)
            times = times_now[vehicle]
            best, where = min((metres(s[5], s[6], lat, lng), i) for i, s in enumerate(stops))
            if best < 250 and times[where] is None:
                times[where] = ts
            known = [i for i, t in enumerate(times) if t is not None]
            highest, kind = (known[-1] if known else 0), None
            if len(stops) >= 3:
                kind = "resend" if judged.get(vehicle) == highest else "new"
                judged[vehicle] = highest
                if times[-1] is not None and times.count(None) <= len(stops) // 2 and trip_id not in self.gated:
                    self.gated[trip_id] = (seq, vehicle, list(times), ts)
            self.tracked[seq] = (vehicle, trip_id, run_now[vehicle], highest, kind, list(times))

    @staticmethod
    def plan(stops, ts):
        """Scheduled epoch seconds, walking backwards from the last stop; None if a time is past 23:59:59."""
        seconds = [int(h) * 3600 + int(m) * 60 + int(s) for h, m, s in (x[3].split(":") for x in stops)]
        if max(seconds) >= 86_400:
            return None
        day, out, later = ts // 86_400 * 86_400, [], None
        for s in reversed(seconds):
            if later is not None and s + day > later:
                day -= 86_400
            later = s + day
            out.append(later)
        return list(reversed(out))

    def tokens(self, trip_id, times, ts, layout, upto=None):
        """Sequence of a trip; with ``upto`` an inference sequence for that highest index."""
        trip = self.by_id[trip_id]
        plan = self.plan(trip[10], ts)
        if plan is None:
            return None
        out = [31, layout.route0 + layout.routes * trip[3] + int(trip[2][1:])]
        out += [layout.weekday0 + (plan[0] // 86_400 + 3) % 7, layout.hour0 + plan[0] % 86_400 // 3600]
        late = 0
        for i, stop in enumerate(trip[10]):
            out.append(layout.stop0 + int(stop[2][1:]))
            token = 15
            if i and upto is not None and i - 1 > upto:
                token = layout.skip
            elif i and times[i - 1] is not None:
                now = times[i - 1] - (plan[i - 1] - 3600)
                token = max(-15, min(15, int((now - late) / 60))) + 15
                late = now
            out.append(token)
        if upto is None:
            out.append(32)
        return out + [33] * (75 - len(out))
