"""Histories, as-of lookups, spaced attempts and entry clusters against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from webestate.operators import graph, history, resolution, spacing

START = datetime(2024, 1, 1)


def day(n):
    return START + timedelta(days=n)


# Interval history --------------------------------------------------------------


def brute_history(states, coverage, runs):
    """``states`` of (run, portal, key, value); versions as tuples."""
    when = dict(runs)
    seen = sorted({(r, p) for r, p in coverage} | {(r, p) for r, p, _, _ in states})
    out = []
    for p, k in {(p, k) for _, p, k, _ in states}:
        visits = sorted((when[r], r) for r, q in seen if q == p and r in when)
        found = {}
        for r, q, key, v in states:
            if (q, key) == (p, k) and r in when:
                found[r] = min(found[r], v, key=lambda x: (x is not None, x or "")) if r in found else v
        version, last = 0, None
        rows = []
        for at, r in visits:
            if r not in found:
                if last is not None and rows[-1][-1] is None:
                    rows[-1][4], rows[-1][-1] = at, "resolved"
                last = None
                continue
            if last is None or last != (found[r],):
                what = "appeared" if not rows else "reopened" if last is None else "changed"
                if what == "changed":
                    rows[-1][4], rows[-1][-1] = at, "changed"
                version += 1
                rows.append([p, k, version, at, None, found[r], 0, what, None])
            rows[-1][6] += 1
            last = (found[r],)
        out += map(tuple, rows)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_history_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    runs = [(f"r{n}", day(7 * n)) for n in range(9)]
    coverage = [(r, p) for r, _ in runs for p in (1, 2, 3, 7) if rng.random() < 0.8]
    states = [(r, p, k, rng.choice(("high", "low", None))) for r, p in coverage for k in ("a", "b", "c") if rng.random() < 0.6]
    states += [states[0], states[1][:3] + ("low",), ("r4", 9, "only state", "x"), ("unknown run", 1, "a", "high")]
    df = spark.createDataFrame(states, "run_id string, portal_id bigint, k string, v string")
    got = history.interval_history(df, spark.createDataFrame(coverage, "run_id string, portal_id bigint"),
                                   spark.createDataFrame(runs, "run_id string, run_at timestamp_ntz"), "portal_id", ["k"], ["v"])
    rows = got.select("portal_id", "k", "version", "valid_from", "valid_to", "v", "n_runs", "opened_by", "closed_by").collect()
    expected = brute_history(states, coverage, runs)
    assert sorted(map(tuple, rows), key=str) == expected
    at = day(30)
    assert history.open_at(got, F.lit(at)).count() == sum(r[3] <= at and (r[4] is None or r[4] > at) for r in expected)
    changes = history.changes_per_run(got).orderBy("at").collect()
    assert sum(r["appeared"] for r in changes) == sum(r[7] == "appeared" for r in expected)
    assert changes[-1]["open_after"] == sum(r[8] is None for r in expected)


def test_history_of_nothing_is_empty(spark):
    states = spark.createDataFrame([], "run_id string, portal_id bigint, k string, v string")
    coverage = spark.createDataFrame([("r", 1)], "run_id string, portal_id bigint")
    runs = spark.createDataFrame([("r", START)], "run_id string, run_at timestamp_ntz")
    assert history.interval_history(states, coverage, runs, "portal_id", ["k"], ["v"]).collect() == []


def test_asof_join_matches_brute_force(spark):
    rng = random.Random(3)
    left = [(n, rng.choice((1, 1, 1, 2, 5, None)), day(rng.randrange(200)) + timedelta(hours=rng.randrange(3)) if rng.random() < 0.95 else None) for n in range(400)]
    right = [(rng.choice((1, 2, 3, None)), day(rng.randrange(180)), f"v{n}") for n in range(60)] + [(1, day(10), "z"), (1, day(10), "a"), (1, None, "never")]
    expected = []
    for n, k, at in left:
        past = [(t, v) for key, t, v in right if key == k and t is not None and at is not None and t <= at]
        expected.append((n, k, at, max(past)[1] if past else None))
    l, r = spark.createDataFrame(left, "n int, k int, at timestamp_ntz"), spark.createDataFrame(right, "k int, since timestamp_ntz, v string")
    for days in (1, 7, 1000):
        got = history.asof_join(l, r, ["k"], "at", "since", ["v"], days)
        assert got.columns == ["n", "k", "at", "v"]
        assert sorted(map(tuple, got.collect())) == expected if all(x[1] is not None for x in expected) else sorted(map(tuple, got.collect()), key=lambda x: x[0]) == expected
    assert history.asof_join(l, r.where("false"), ["k"], "at", "since", ["v"]).where("v IS NULL").count() == 400


# Spaced attempts ---------------------------------------------------------------


def greedy(times, spacing):
    n, last = 0, None
    for t in sorted(times):
        if last is None or t >= last + spacing:
            n, last = n + 1, t
    return n, last


def test_tables_of_stretches_join_in_any_grouping():
    rng = random.Random(7)
    for _ in range(200):
        spacing_, width = rng.choice((3, 5, 10)), 10
        times = sorted({rng.randrange(80) for _ in range(rng.randrange(1, 40))})
        tables = [spacing.stretch_table(b, np.array([t for t in times if b <= t < b + width], dtype=np.int64), spacing_)
                  for b in range(0, 80, width) if any(b <= t < b + width for t in times)]
        while len(tables) > 1:
            i = rng.randrange(len(tables) - 1)
            tables[i:i + 2] = [spacing.joined_tables(tables[i], tables[i + 1], spacing_)]
        begin, starts, counts, lasts = tables[0]
        assert (counts[0], lasts[0]) == greedy(times, spacing_)
        for s, c, last in zip(starts, counts, lasts):
            assert (c, last) == greedy([t for t in times if t >= s], spacing_)


def test_spaced_counts_match_greedy_and_merge_over_runs(spark):
    rng = random.Random(8)
    rows = [(rng.choice((1, 1, 1, 2, 3, None)), START + timedelta(minutes=rng.randrange(4000))) for _ in range(500)] + [(2, None), (4, START), (4, START)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz")
    want = {}
    for k in {k for k, _ in rows}:
        times = [t for key, t in rows if key == k and t is not None]
        n, last = greedy(times, timedelta(minutes=15))
        want[k] = (n, min(times), last)
    got = {r["k"]: (r["spaced_n"], r["first_at"], r["last_at"]) for r in spacing.count_spaced(df, ["k"], "at", 15).collect()}
    assert got == want
    cut = day(1)
    early, late = (spacing.spaced_states(df.where(c), ["k"], "at", 15) for c in (F.col("at") < cut, F.col("at") >= cut))
    stored = spacing.merged_states(early, ["k"], 15)
    again = spacing.spaced_counts(spacing.merged_states(stored.unionByName(late), ["k"], 15), ["k"])
    assert {r["k"]: (r["spaced_n"], r["first_at"], r["last_at"]) for r in again.collect()} == want
    with pytest.raises(ValueError):
        spacing.spaced_states(df, ["k"], "at", 2000)


# Graphs and entries --------------------------------------------------------------


def find_components(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(200, 200), (301, 300)] + [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b] + [(200, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == find_components([(a, b) for a, b in edges if a != b])


def test_entries_cluster_by_address_name_and_score(spark):
    rows = [
        (1, "a", "Registry of Motor Vehicles", "https://www.motor.example.org/"),
        (2, "b", "Something else", "http://motor.example.org/index.html?x=1"),  # address of 1
        (3, "a", "Vehicles, Motor: Registry", "https://other.example.net/home"),  # name of 1
        (4, "a", "Registry of Motor Vehicles Online", "https://motor.example.org/apply"),  # host stem and half of the name of 1
        (5, "b", "Motor Registry", "https://far.example.com/"),
        (6, "b", "Land Records Search Portal", "https://land.example.org/"),
        (7, "c", "Land Records Search", "https://records.example.org/x"),  # 3 of 4 words on one domain
        (8, "c", "Land", "https://records.example.org/y"),
        (9, "c", None, "no url"), (10, "c", "", None), (11, "c", "Motor Registry", "https://m.far.example.com/b"),
    ]
    entries = spark.createDataFrame(rows, "entry_id bigint, source_id string, name string, url string")
    clusters, pairs = resolution.portal_clusters(entries)
    assert {r["entry_id"]: r["cluster_id"] for r in clusters.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 5}
    evidence = {r["cluster_id"]: r.asDict() for r in resolution.cluster_evidence(clusters, pairs).collect()}
    assert set(evidence) == {1, 5, 6}
    assert evidence[6] == {"cluster_id": 6, "entries": 2, "sources": 2, "addresses": 2, "names": 2, "pairs": 1, "weakest": 1.0, "mean_score": 1.0}
    assert (evidence[1]["entries"], evidence[1]["addresses"], evidence[1]["names"], evidence[1]["pairs"]) == (4, 3, 3, 1)


def test_tiles_of_a_hot_block_lose_no_pair(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"word{i:02d}" for i in range(14)]
    rows = [(n, "s", " ".join(rng.sample(words, rng.randrange(2, 7))), f"https://h{n % 3}.example.org/{n}") for n in range(150)]
    entries = spark.createDataFrame(rows, "entry_id bigint, source_id string, name string, url string")
    named = resolution.profiles(entries).withColumn("profile", F.format_string("p%05d", "entry_id")).select("profile", "stem", "domain", "tokens")
    want = set()
    for i, (a, _, x, u) in enumerate(rows):
        for b, _, y, v in rows[i + 1:]:
            s, t = set(x.split()), set(y.split())
            score = len(s & t) / len(s | t) + (0.5 if u.split("/")[2] == v.split("/")[2] else 0.25)
            if score >= 1:
                want.add((f"p{a:05d}", f"p{b:05d}", round(score, 9)))
    for block in (7, 1000):
        monkeypatch.setattr(resolution, "BLOCK", block)
        got = [(r["a"], r["b"], round(r["score"], 9)) for r in resolution.scored_pairs(named).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_graph_holds_only_names_that_meet_others(spark, monkeypatch):
    rows = [(n, "s", f"alpha{n} beta{n} gamma{n}", f"https://h{n}.org/{n}") for n in range(40)]
    rows += [(100 + n, "t", "gamma1 alpha1 beta1", f"https://t{n}.org/") for n in range(30)]  # the name of 1
    rows += [(200, "t", "quite another name", "http://www.h2.org/2"), (201, "t", None, "https://h3.org/3/index.html"), (202, "t", "pair", "https://h4.org/4"), (3, "u", "Delta Words Here", "https://u.org/")]
    seen = []
    monkeypatch.setattr(resolution, "components", lambda edges: (seen.append(edges.distinct().count()), graph.components(edges))[1])
    clusters, _ = resolution.portal_clusters(spark.createDataFrame([*rows, (None, "v", "x", "https://h5.org/5")], "entry_id bigint, source_id string, name string, url string"))
    got = sorted((r["entry_id"], r["cluster_id"]) for r in clusters.collect())
    own = {**{n: n for n in range(40)}, **{100 + n: 1 for n in range(30)}, 200: 2, 201: 3, 202: 4}
    assert got == sorted([*own.items(), (3, 3)]) and seen == [4]
