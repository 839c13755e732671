"""Streams over several micro-batches give the batch results."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_jobs import REQUEST, T0, _greedy, _requests
from webestate.operators import experience as ex
from webestate.streaming import flows, tables


def batches(spark, df, path, order, parts):
    """Write a table as files in time order and read it back one file per batch."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1).write.parquet(f"{path}/{i:02d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


DECIDED = "request_id bigint, key bigint, portal_id string, accepted boolean, late boolean"


def test_admission_over_batches(spark, tmp_path):
    rows = _requests(120, 6, 3, 5) + [(1000 + r[0], 99, r[2], r[3]) for r in _requests(60, 1, 3, 6)]
    stream = batches(spark, spark.createDataFrame(rows, REQUEST), str(tmp_path / "in"), "created_at", 4)
    out = str(tmp_path / "out")
    flows.run_available(flows.admission(stream, out), out + "-cp")
    done = spark.read.schema(DECIDED).parquet(out).collect()
    assert {r["request_id"]: r["accepted"] for r in done} == _greedy(rows) and not any(r["late"] for r in done)


def test_late_requests_are_marked(spark, tmp_path):
    df = spark.createDataFrame([(i, 1, "p", T0 + dt.timedelta(hours=30 * i)) for i in (2, 0, 3)], REQUEST)
    rows = df.collect()
    for i, r in enumerate(rows):
        spark.createDataFrame([r], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{tmp_path}/in")
    out = str(tmp_path / "out")
    flows.run_available(flows.admission(stream, out), out + "-cp")
    assert {r["request_id"]: (r["accepted"], r["late"]) for r in spark.read.schema(DECIDED).parquet(out).collect()} == {2: (True, False), 0: (False, True), 3: (True, False)}


def duplicates_of(df):
    marked = ex.mark_duplicates(df, df.select("key", "portal_id", "created_at"))
    return {r["submission_id"]: r["duplicate_of"] for r in marked.collect()}


def marks(df):
    return {r["submission_id"]: r["duplicate_of"] for r in df.collect()}


def test_duplicates_over_batches(spark, sf, tmp_path):
    from webestate.plans.report_queries import duplicate_input

    df = duplicate_input(spark, sf).withColumn("content_key", F.lit("same"))
    got = flows.run_duplicates(batches(spark, df, str(tmp_path / "in"), "created_at", 3), str(tmp_path / "out"), "31 days")
    want = duplicates_of(df)
    assert marks(got) == want and any(v is not None for v in want.values()) and got.where("late").count() == 0


REPORT = "submission_id bigint, key bigint, portal_id string, task_type bigint, outcome string, created_at timestamp_ntz, content_key string, status string"


def report(i, minute, status="pending", key=1):
    return (i, key, "p", 0, "completed", T0 + dt.timedelta(minutes=minute), "note", status)


def put(spark, rows, folder):
    spark.createDataFrame(rows, REPORT).coalesce(1).write.parquet(str(folder))


def test_duplicates_go_on_after_a_restart_and_late_rows_find_their_predecessors(spark, tmp_path):
    parts = [[report(1, 0), report(2, 4, key=2), report(3, 5)], [report(4, 60), report(5, 300)], [report(6, 9), report(7, 64), report(8, 40, "rejected")], [report(9, 305), report(10, 64)]]
    out = str(tmp_path / "out")
    for i, rows in enumerate(parts):  # a run of both queries for each part, so every part is a restart from the checkpoints
        put(spark, rows, tmp_path / "in" / str(i))
        stream = spark.readStream.schema(REPORT).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        done = flows.run_duplicates(stream, out)
    rows = {r["submission_id"]: (r["duplicate_of"], r["late"]) for r in done.collect()}
    assert rows == {1: (None, False), 2: (None, False), 3: (1, False), 4: (None, False), 5: (None, False), 6: (1, True), 7: (4, True), 8: (None, True), 9: (5, False), 10: (4, True)}
    again = flows.run_duplicates(stream, out)
    assert again.count() == 10


def test_state_of_one_content_is_cut_by_hour(spark, tmp_path):
    rows = [report(i, 7 * i, key=i % 3) for i in range(1, 400)] + [report(1000 + i, 7 * i + 2, "rejected", key=i % 3) for i in range(1, 400)]
    for part in range(2):
        put(spark, rows[part::2], tmp_path / "in" / str(part))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = flows.run_duplicates(stream, out, "31 days")
    assert got.count() == len(rows)
    state = spark.read.format("statestore").load(f"{out}/checkpoint-marks").select(F.size("value.groupState.times").alias("n"))
    assert state.agg(F.max("n")).first()[0] <= 11 and state.agg(F.sum("n")).first()[0] >= 399
    one = flows.run_duplicates(spark.readStream.schema(REPORT).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), str(tmp_path / "one"), "31 days")
    assert marks(one) == duplicates_of(spark.createDataFrame(rows, REPORT)) and any(v is not None for v in marks(one).values())


def test_thinned_times_answer_alike():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(50):
        times = np.unique(rng.integers(0, 40 * flows.WIDTH // 10, 60))
        few = flows._sparse(times)
        asked = rng.integers(0, 5 * flows.WIDTH, 200)

        def active(known):
            place = np.searchsorted(known, asked) - 1
            return (place >= 0) & (asked - known[np.maximum(place, 0)] <= flows.WIDTH)

        assert (active(few) == active(times)).all() and len(few) <= 12


def test_live_summary_over_batches(spark, sf, tmp_path):
    from webestate.plans.flow_queries import LIVE
    from webestate.plans.report_queries import visible

    df = visible(spark, sf).select("portal_id", "outcome", "created_at", "occurred_on", "rating", "themes")
    out = str(tmp_path / "out")
    flows.run_available(flows.live_summary(batches(spark, df, str(tmp_path / "in"), "created_at", 5), out), out + "-cp")
    got = tables.read_table(spark, out, LIVE).drop("theme_counts")
    want = ex.experience_summary(df).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.count() == got.count() > 0
    stored = spark.read.parquet(f"{out}/rows")
    assert stored.count() <= 2 * want.count()  # two copies at most, after five batches


def test_upsert_survives_batches_that_run_again(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k bigint, v string"

    def batch(*rows):
        return spark.createDataFrame(list(rows), schema)

    def now():
        return {r["k"]: r["v"] for r in tables.read_table(spark, path, schema).collect()}

    assert now() == {}
    first = batch(*((k, "a") for k in range(40)))
    tables.upsert(first, path, 0, ["k"], 4)
    tables.upsert(batch((1, "b"), (50, "b")), path, 1, ["k"], 4)
    want = {**{k: "a" for k in range(40)}, 1: "b", 50: "b"}
    assert now() == want
    tables.upsert(batch((1, "b"), (50, "b")), path, 1, ["k"], 4)  # the epoch again, after its commit
    assert now() == want
    # An epoch that runs again starts from the version before it.
    tables.upsert(batch((2, "half")), path, 2, ["k"], 4)
    tables.upsert(batch((2, "c"), (3, "c")), path, 2, ["k"], 4)
    assert now() == {**want, 2: "c", 3: "c"}
    tables.upsert(batch(), path, 3, ["k"], 4)
    assert now() == {**want, 2: "c", 3: "c"}


def test_a_run_split_over_batches_is_evaluated_whole(spark, tmp_path):
    from tests.test_jobs import OBS, context, obs
    from webestate.operators.rules import run_rules

    rows = [(*obs(i, "DNS_FAILURE"), "r1") for i in (2, 0, 1)]
    schema = OBS + ", run_id string"
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    ctx = context(spark, [obs(9)])

    def of(pages, run_id):
        return type(ctx)(run_id, ctx.analyzed_at, ctx.portals, ctx.sources, pages, ctx.links, ctx.skips)

    out = str(tmp_path / "out")
    only = [{"rule_id": "availability.unavailable.v1"}]
    flows.run_available(flows.incremental_findings(stream, of, out, only), out + "-cp")
    got = spark.read.parquet(f"{out}/findings/run_id=r1").select("rule_id", "severity").collect()
    want = run_rules(of(spark.createDataFrame(rows, schema), "r1"), only).select("rule_id", "severity").collect()
    assert got == want and len(got) == 1


def test_findings_of_a_given_version_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    df = spark.range(4).selectExpr("id AS n")
    counted = df.mapInPandas(lambda frames: (made.add(len(f)) or f for f in frames), "n bigint")
    for _ in range(3):
        assert sorted(r["n"] for r in flows._once(counted, str(tmp_path / "given")).collect()) == [0, 1, 2, 3]
    assert made.value == 4
    spark.range(1).selectExpr("7L AS n").write.parquet(str(tmp_path / "broken" / "rows"))  # a write that did not end
    assert flows._once(df, str(tmp_path / "broken")).count() == 4
