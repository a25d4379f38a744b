"""Route events for tests, and a sequential simulator of the engine that is written apart from it."""

from routeloom.functions.prefix import parse_text
from routeloom.schema import ROUTE_EVENTS


def event(seq, ts, kind, prefix, path=(), peer="p1", peer_asn=1, from_set=False):
    return (seq, float(ts), kind, *parse_text(prefix), list(path) if kind == "announce" else [], from_set, None, None, None, None, [], peer, peer_asn, "test")


def frame(spark, rows):
    return spark.createDataFrame(rows, ROUTE_EVENTS)


def ann(seq, ts, prefix, path, **more):
    return event(seq, ts, "announce", prefix, path, **more)


def wd(seq, ts, prefix, **more):
    return event(seq, ts, "withdraw", prefix, **more)


def simulate(rows, vrps, watch, rels, window, spike_window, factor, least, cooldown):
    """(seq, detector number, type, observed, emitted) of every candidate, by an event loop over plain dictionaries."""

    def covers(o, i):
        if o[0] != i[0] or o[1] > i[1]:
            return False
        bits = lambda p: format((p[2] % 2**64) << 64 | p[3] % 2**64, "0128b")
        return bits(o)[: o[1]] == bits(i)[: o[1]]

    base, spikes, last, out = {}, {}, {}, []
    for text, origin in watch:
        base[parse_text(text)] = {"first": 0.0, "locked": origin != 0, "origins": [origin] if origin else [], "watched": True}
    for r in rows:
        seq, ts, kind, prefix, path, from_set, peer, peer_asn = r[0], r[1], r[2], r[3:7], r[7], r[8], r[14], r[15]
        origin = path[-1] if kind == "announce" and path else 0
        found = []
        if kind == "announce":
            own = base.get(prefix)
            if origin and not from_set and own and own["locked"] and own["origins"] and origin not in own["origins"]:
                found.append((0, "hijack", prefix, origin))
            if origin and not from_set and not (own and origin in own["origins"]):
                above = sorted((p for p, b in base.items() if p != prefix and p[1] < prefix[1] and covers(p, prefix) and b["locked"] and b["origins"]), key=lambda p: p[1])
                if above and origin not in base[above[-1]]["origins"]:
                    found.append((1, "subprefix", prefix, origin))
            down = False
            for i in range(len(path) - 1, 0, -1) if len(path) >= 3 else ():
                a, b = path[i], path[i - 1]
                rel = rels.get((a, b)) if a != b else None
                if rel in ("c2p", "peer") and down:
                    found.append((2, "leak", prefix, a))
                    break
                down = down or rel in ("p2c", "peer")
            if origin:
                over = [v for v in vrps if covers(v[:4], prefix)]
                if over and not any(v[4] == origin and v[4] and prefix[1] <= v[5] for v in over):
                    found.append((3, "rpki_invalid", prefix, origin))
        for ord_, key, observed in ((4, ("prefix", prefix), origin), (5, ("peer", peer), peer_asn)):
            s = spikes.setdefault(key, [ts, ts, 0, 0, 0])
            age = ts - s[0]
            if age >= 2 * spike_window:
                s[0], s[2], s[3] = ts, 0, 0
            elif age >= spike_window:
                s[0], s[2], s[3] = s[0] + spike_window, 0, s[2]
            s[2] += 1
            s[4] += 1
            seen = s[2] + s[3] * max(0.0, 1 - (ts - s[0]) / spike_window)
            usual = (s[4] - s[2]) / (s[0] - s[1]) if s[0] > s[1] else 0.0
            if seen > max(factor * usual * spike_window, least):
                found.append((ord_, "spike", prefix if ord_ == 4 else (0, 0, 0, 0), observed))
        for ord_, name, where, observed in found:
            k = (name, where, observed)
            quiet = last.get(k, 0) != 0 and ts - last[k] < cooldown
            if not quiet:
                last[k] = ts
            out.append((seq, ord_, name, observed, int(not quiet)))
        if origin:
            b = base.setdefault(prefix, {"first": ts, "locked": False, "origins": [], "watched": False})
            if not b["locked"]:
                if ts - b["first"] > window:
                    b["locked"] = True
                elif origin not in b["origins"] and len(b["origins"]) < 4:
                    b["origins"].append(origin)
    return out
