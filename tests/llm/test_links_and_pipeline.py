"""Embedding links, URL filters, the pipeline and the registry."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_text_operators import table
from webestate.llm import decontam, graph, urlfilter, vectors


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    ids = list(range(200))
    chain = [(i, i + 1) for i in range(60)]
    star = [(199, i) for i in range(100, 150)]
    ring = [(rng.randrange(150, 190), rng.randrange(150, 190)) for _ in range(60)]
    links = [*chain, *star, *ring, (5, 5), (None, 3), *chain[:5]]
    expected = brute.labels(ids, [x for x in links if None not in x])
    out = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    touched = {i for a, b in links if None not in (a, b) and a != b for i in (a, b)}
    assert out == {i: expected[i] for i in touched}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(3)
    x = vectors.unit_rows(rng.normal(size=(300, 24)) ** 3 + 1e-9)
    q, s, e = vectors.quantised(x)
    exact, near = x @ x.T, (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(exact - near) <= e[:, None] + e[None, :] + e[:, None] * e[None, :]).all()


@pytest.mark.parametrize("block", [4096, 16])
def test_vector_links_match_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 12))
    rows = [(i, [float(v) for v in np.float32(base[i % 6] + rng.normal(size=12) * rng.choice([0.1, 0.35]))]) for i in range(70)]
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, None), (73, []), (74, [0.0] * 12), (75, [float("nan")] + [1.0] * 11), (76, [float("inf")] + [1.0] * 11),
             (77, [None] + [1.0] * 11), (78, rows[0][1][:6]), (79, [v * 1e30 for v in rows[5][1]]), (None, rows[3][1])]
    df = spark.createDataFrame([(i, e, 1, "x", "y") for i, e in rows], "vec_id bigint, embedding array<float>, label int, block string, rep string")

    def good(e):
        return e and all(v is not None and np.isfinite(v) for v in e) and any(e)

    real = {r["vec_id"]: r["embedding"] for r in df.collect()}
    ids = [i for i in real if i is not None]
    links = []
    for a in ids:
        for b in ids:
            if a < b and good(real[a]) and good(real[b]) and len(real[a]) == len(real[b]):
                x, y = np.float64(real[a]), np.float64(real[b])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.9:
                    links.append((a, b))
    label = brute.labels(ids, links)
    expected = {i: (sum(i in p for p in links), label[i], label[i] == i) for i in ids}
    out = vectors.vector_links(df, block=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out if r["vec_id"] is not None} == expected
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in out if r["vec_id"] is None] == [(0, None, True)]
    assert vectors.vector_links(df.where("false")).collect() == []


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls)], "page_id bigint, url string, rule string, host string, canon string")


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "x://example.org/en/12?q#f", "x://notexample.org/en/1", "x://org", "x://a.com/de/", "x://a.com/fr/?x", "x://com/de/1",
            "x://a.b.c.com#/de/", "a://b://c.com/de/", "x://u.org:80/p", "x://" + "a." * 3000 + "com/de/q"]
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("com", "/de/", "allow")], "host string, path string, verdict string")
    out = {r["page_id"]: r for r in urlfilter.judge_pages(pages(spark, urls), rules, spark.createDataFrame([("b:",)], "canon string")).collect()}
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) for i in range(14)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/en/1", "org/", "allow"), ("org", "", None, "allow"), ("a.com", "/de/", "com/de/", "block"),
        ("a.com", "/fr/", "com/fr/", "allow"), ("com", "/de/1", "com/de/", "block"), ("a.b.c.com", "", None, "allow"), ("b:", "//c.com/de/", None, "allow"), ("u.org:80", "/p", None, "allow")]
    assert out[14]["rule"] == "com/de/"
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urlfilter.judge_pages(pages(spark, urls), none, spark.createDataFrame([], "canon string")).collect()} == {"allow"}
    assert urlfilter.judge_pages(pages(spark, []).where("false"), rules, none.select(F.col("host").alias("canon"))).collect() == []


@pytest.mark.parametrize("bits,size", [(12, 1 << 25), (1, 1 << 25), (12, 0)])
def test_listed_urls_are_exact(spark, monkeypatch, bits, size):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", bits)
    urls = [f"http{'s' * (i % 2)}://h{i % 7}.net/p{i}{'/' * (i % 3 == 0)}?a={i}&utm_source=x#f" for i in range(400)] * 2
    listed = [(f"h{i % 7}.net/p{i}?a={i}",) for i in range(0, 400, 3)] + [("other",), (None,), ("other",)]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    out = urlfilter.judge_pages(pages(spark, urls), none, spark.createDataFrame(listed, "canon string"), broadcast_bytes=size).collect()
    assert len(out) == 800 and all((r["verdict"] == "block") == (r["page_id"] % 400 % 3 == 0) for r in out)


def test_pipeline_stages(spark, sf):
    """Each stage on what its predecessor kept, against brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mixing"]
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(corpus_pipeline.materialise(stage(spark, held[-1], sf), "test-stage"))
    assert all(d.columns == docs.columns for d in held)
    rows = [{r["doc_id"]: r["text"] for r in d.collect()} for d in held]
    assert len(rows[0]) - len(rows[1]) <= 1 and all(rows[0][i] == t for i, t in rows[1].items())
    before = sorted(rows[1].items())
    assert rows[2] == {i: k for (i, _), (_, _, k) in zip(before, brute.drop_lines(before), strict=True)}
    classes = brute.near_classes(sorted(rows[2].items()))
    assert set(rows[3]) == {i for i, c in classes.items() if i == c} and len(rows[3]) < len(rows[2])
    clean = {i for i, t in rows[3].items() if not any(decontam.normal(b) in decontam.normal(t) for b in bench)}
    assert set(rows[4]) == clean and len(clean) < len(rows[3])
    taken = [len(brute.words(r["text"])) for r in held[5].collect()]
    total = sum(len(brute.words(t)) for t in rows[4].values())
    assert abs(sum(taken) - total) < 0.25 * total
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, held[5].collect()))


def test_pipeline_keeps_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = table(spark, [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()] + [(None, None, None, None), (5000, "", None, None), (5001, "the and of " * 4000, "en", None)])
    out = odd
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, out, sf), "test-stage")
    assert out.columns == odd.columns and out.count() > 50
    nothing = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).collect() == []


def test_every_numbered_query_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
