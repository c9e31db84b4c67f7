"""Host reputation against a plain statement of its formulas, and on pages held out."""

import collections
import math
import random

from pyspark.sql import functions as F

from fleetrisk.llm import hosts

TWO = set(hosts.TWO_LABELS)


def domain(h):
    p = h.split(".")
    return ".".join(p[-3:] if ".".join(p[-2:]) in TWO else p[-2:])


def suffix(h):
    p = h.split(".")
    return ".".join(p[-2:]) if ".".join(p[-2:]) in TWO else p[-1]


def plain(outcomes, z):
    def sums(key):
        out = collections.defaultdict(lambda: [0, 0])
        for h, bad in outcomes:
            out[key(h)][0] += 1
            out[key(h)][1] += bad
        return out

    def strength(groups, parent):
        scatter = sum(n * (k / n - parent[g]) ** 2 for g, (n, k) in groups.items())
        one = sum(parent[g] * (1 - parent[g]) for g in groups)
        all_ = sum(n * parent[g] * (1 - parent[g]) for g, (n, _) in groups.items())
        if not all_ or all_ <= one or (rho := (scatter - one) / (all_ - one)) <= 0:
            return 1000.0
        return min(1000.0, max(0.5, 1 / rho - 1))

    n, k = len(outcomes), sum(b for _, b in outcomes)
    levels = [(sums(suffix), lambda g: None), (sums(domain), suffix), (sums(lambda h: h), domain)]
    rates, out = {None: (k + 0.5) / (n + 1)}, {}
    for groups, up in levels:
        parent = {g: rates[up(g)] for g in groups}
        s = strength(groups, parent)
        rates = {g: (k + s * parent[g]) / (n + s) for g, (n, k) in groups.items()}
        out = {g: (rates[g], max(0.0, rates[g] - z * math.sqrt(rates[g] * (1 - rates[g]) / (n + s + 1)))) for g, (n, _) in groups.items()}
    return out


def world(seed):
    rng = random.Random(seed)
    names = [f"{a}.site{i}.{s}" for i in range(25) for s in ("com", "co.uk", "org") for a in ("www", "blog")]
    rate = {h: 0.7 if domain(h).startswith("site1") else 0.08 for h in names}
    draw = lambda n: [(h, int(rng.random() < rate[h])) for h in (rng.choice(names) for _ in range(n))]
    return rate, draw(6000) + [("www.site3.com", int(rng.random() < 0.08)) for _ in range(3000)], draw(2000)


def test_posterior_and_bound(spark):
    _, seen, _ = world(1)
    got = {r.host: (r.rate, r.low) for r in hosts.reputations(spark.createDataFrame(seen, "host string, bad int").repartition(3)).collect()}
    want = plain(seen, hosts.BOUND_Z)
    assert got.keys() == want.keys()
    for h in want:
        assert math.isclose(got[h][0], want[h][0], rel_tol=1e-9) and math.isclose(got[h][1], want[h][1], rel_tol=1e-9, abs_tol=1e-12)


def test_blocks_bad_hosts_on_held_out_pages(spark):
    rate, seen, later = world(2)
    pages = spark.createDataFrame([(i, f"https://{h}/x", "", "r", "v") for i, (h, _) in enumerate(later)], "page_id long, url string, html string, rule string, verdict string")
    got = {r.page_id: r.verdict for r in hosts.judge(pages, [], outcomes=spark.createDataFrame(seen, "host string, bad int")).collect()}
    blocked = [i for i, v in got.items() if v == "block"]
    truly = [i for i, (h, _) in enumerate(later) if rate[h] > 0.5]
    assert len(set(blocked) & set(truly)) / len(blocked) > 0.95 and len(set(blocked) & set(truly)) / len(truly) > 0.95
    assert sum(later[i][1] for i in blocked) / len(blocked) > 0.6


def test_addresses_ports_and_dots(spark):
    rows = [("10.0.0.1",), ("10.0.0.1:80",), ("[::1]",), ("www.a.co.uk.",), ("b.a.com:8080",), ("localhost",), ("a.b.c",)]
    df = spark.createDataFrame(rows, "h string").select("h", hosts.domain_of(F.col("h")), hosts.suffix_of(F.col("h")))
    assert [tuple(r)[1:] for r in df.collect()] == [("10.0.0.1", "address"), ("10.0.0.1", "address"), ("[::1]", "address"), ("a.co.uk", "co.uk"), ("a.com", "com"), ("localhost", "localhost"), ("b.c", "c")]
