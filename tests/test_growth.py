"""What a query holds, writes or calls grows no faster than its input."""

import os
import shutil

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparquill.operators import codecs, score
from sparquill.operators.history import History
from sparquill.plans import catalogue
from sparquill.specs import KvSpec, ProdSpec
from sparquill.streaming import capture


def test_exact_products_come_without_vectors(spark, sf_dir):
    """the inner product is worked out where the score is; rows of pairs carry no vectors."""
    rng = np.random.default_rng(1)
    spec = ProdSpec(8, 3)
    x = {i: rng.normal(size=8).astype(np.float32).astype(float).tolist() for i in range(30)}
    keys = codecs.encode(spark.createDataFrame([(i, v) for i, v in x.items()] + [(99, None)], "k_id long, x array<float>"), "x", spec)
    queries = spark.createDataFrame([(i, x[i]) for i in range(5)], "q_id long, q array<float>")
    found = score.attention_score(queries, keys, spec, exact="x")
    assert found.columns == ["k_id", "q_id", "score", "exact"]
    rows = found.collect()
    assert len(rows) == 150 and all(abs(r["exact"] - np.dot(x[r["q_id"]], x[r["k_id"]])) < 1e-9 for r in rows)
    plan = catalogue.score_vs_exact(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan


def test_keys_of_one_file_are_scored_by_several_tasks(spark, monkeypatch):
    """how many tasks score is told by the scores to make, not by the files that the keys lie in."""
    rng = np.random.default_rng(3)
    spec = ProdSpec(8, 3)
    keys = codecs.encode(spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)], "k_id long, x array<float>").coalesce(1), "x", spec)
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(5)], "q_id long, q array<float>")
    found = lambda: score.attention_score(queries, keys, spec, exact="x")
    whole = found()
    monkeypatch.setattr(score, "TASK_ROWS", 50)
    dealt = found()
    assert len({r[0] for r in dealt.select(F.spark_partition_id()).collect()}) == 4
    got, want = (sorted((r["k_id"], r["q_id"], r["score"], r["exact"]) for r in df.collect()) for df in (dealt, whole))
    assert len(got) == 200 and np.allclose(got, want, rtol=0, atol=1e-12)


def test_rounding_of_many_is_that_of_sql(spark, duck):
    x = [0.0, 4e-7, 5e-7, 0.1234565, 1.0000005, 12345.6789995, 999999999.1234564, 1e9, 1e15, 3e20]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(catalogue._r_of_many(F.col("x"))).collect()
    assert [r[0] for r in got] == [duck.execute("select round(?::double, 6)", [v]).fetchall()[0][0] for v in x]


def test_sql_attention_has_a_group_for_each_session(spark, sf_dir):
    """a session of few tokens is one call of the aggregate, wherever its tokens lie in the order of all."""
    catalogue.attn_sql_aggregate(spark, sf_dir)
    plan = catalogue.attn_sql_aggregate(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "div 1000" not in plan and "pieces" in plan


def test_generated_scores_hold_no_row_for_each_pair(spark, sf_dir):
    """ids are counted in words of 64 bits, and vectors stay behind."""
    plan = catalogue.generated_scores(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "bit_or" in plan


def test_scores_come_key_by_key(spark):
    """one key after the other, each with all queries of a block, which a file keeps small."""
    spec = ProdSpec(8, 3)
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(20)]
    keys = codecs.encode(spark.createDataFrame(vectors, "k_id long, x array<float>").coalesce(1), "x", spec).drop("x")
    rows = score.attention_score(spark.createDataFrame(vectors[:6], "q_id long, q array<float>").coalesce(1), keys, spec).collect()
    assert [(r["k_id"], r["q_id"]) for r in rows] == [(k, q) for k in range(20) for q in range(6)]


def test_sessions_of_a_bucket_share_a_call(spark, tmp_path, monkeypatch):
    """F4, F5, F7 to F11: Spark sees as many groups as there are buckets, and every session keeps its own state."""
    monkeypatch.setattr(capture, "BUCKETS", 2)
    monkeypatch.setattr(capture, "HELD", 8)
    monkeypatch.setattr(capture, "ROWS", 5)
    v = lambda i: [float(i)] * 8
    for lo, hi in ((0, 5), (5, 12)):
        rows = [(s, i, "decode", None, None, v(i), v(s)) for s in range(20) for i in range(lo, hi)]
        spark.createDataFrame(rows, capture.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(capture.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spec = KvSpec(8, 1, 4, 4, 8, 4)
    history = History(spark, str(tmp_path / "history"), spec)
    counts = capture.run_available(source, history, str(tmp_path / "counts"), str(tmp_path / "state")).collect()
    assert sorted(tuple(r) for r in counts) == [(s, 0, 12, 8, 4) for s in range(20)]
    ring = capture.recent(spark, str(tmp_path / "state"), spec).collect()
    assert sorted((r["session"], r["token_idx"], r["key"], r["value"]) for r in ring) == [(s, i, v(i), v(s)) for s in range(20) for i in range(8, 12)]
    state = spark.read.format("statestore").option("stateVarName", "sessions").load(str(tmp_path / "state"))
    assert state.select("key").distinct().count() == 2


def test_events_travel_in_blocks(spark, tmp_path):
    """F8, F9, F10: what Spark hands to the operator is a row for each bucket of a task's events, with all that they hold."""
    v = lambda i: None if i % 5 == 0 else [float(i), -0.5 * i] * 4
    rows = [(s % 3, i, "decode", None, None, v(i), v(i + 1)) for s in range(30) for i in range(s, 300, 30)]
    df = spark.createDataFrame(rows, capture.EVENTS).coalesce(1).select((F.col("session") % 2).alias("bucket"), *capture.NUMBERS[:2], "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in capture.NUMBERS[2:]], "key", "value")
    found = df.mapInArrow(capture._dealt, "bucket long, events binary").collect()
    assert sorted(r["bucket"] for r in found) == [0, 1]
    frames = {r["bucket"]: capture._unpack_events(r["events"]) for r in found}
    for bucket, frame in frames.items():
        mine = [r for r in rows if r[0] % 2 == bucket]
        assert frame[["session", "seq"]].values.tolist() == [[r[0], r[1]] for r in mine]
        for c, i in (("key", 5), ("value", 6)):
            assert [None if b is None else np.frombuffer(b, "<f4").tolist() for b in frame[c]] == [r[i] for r in mine]
    frame = capture._block([(1, "token", 0, 0, i, b, None, None, None, None) for i, b in enumerate(capture._bytes_of([v(1), None, v(2)]))])
    out = spark.createDataFrame([(bytes(b),) for b in frame["rows"]], "rows binary")
    assert [(r["seq"], r["key"], r["value"]) for r in capture._rows(out).collect()] == [(0, v(1), None), (1, None, None), (2, v(2), None)]


def shuffled(spark):
    """Bytes of all shuffle files."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if "shuffle_" in files.apply(i).getName())


def test_a_stream_holds_one_slice(spark, sf_dir, monkeypatch):
    """F1 to F8: slices of so many events come one after the other, each gone before the next is written, and so are the shuffles."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = rows.count()
    monkeypatch.setattr(catalogue, "SLICE_ROWS", -(-n // 5))
    places, there, before = [], [], shuffled(spark)
    folder, store = catalogue._shared_folder, catalogue._stored
    monkeypatch.setattr(catalogue, "_shared_folder", lambda s, kind: places.append(folder(s, kind)) or places[-1])
    monkeypatch.setattr(catalogue, "_stored", lambda part, at: (there.append(len(os.listdir(f"{places[-1]}/events"))), store(part, at)))
    counts, history = catalogue._streamed(spark, sf_dir, catalogue._decoded(spark, sf_dir))
    assert there == [0] * 5 and not os.listdir(f"{places[0]}/events") and not os.listdir(f"{places[0]}/next") and not os.path.exists(f"{places[0]}/state")
    assert shuffled(spark) - before < 512 * n // 5
    totals = {r["session"]: r["total"] for r in counts.collect()}
    assert totals == {r["user_id"]: r["count"] for r in rows.groupBy("user_id").count().collect()} and history.read().count() == sum((t - 1) // 16 * 16 for t in totals.values())
    assert all(spark.conf.get(name, None) is None for name, _ in (capture.STATE_STORE, *capture.KEPT))


def test_controls_are_placed_once(spark, sf_dir):
    """a slice reads the numbers of its events, which are placed already, and brings no vectors through the places."""
    rows = catalogue._controls(spark, sf_dir)
    plan = rows.where("seq < 10")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "key" not in rows.columns and rows.where("_v is null").count() > 0


def test_arrivals_follow_each_other(spark, tmp_path, monkeypatch):
    """an arrival is worked off before the next is asked for and may go, and a state that events pass through is compacted."""
    monkeypatch.setattr(capture, "BUCKETS", 2)
    start, seen, schema = pd.Timestamp("2024-01-01"), [], f"{capture.EVENTS}, ts timestamp"
    spec = KvSpec(8, 1, 4, 4, 8, 4)
    history = History(spark, str(tmp_path / "history"), spec)

    def arrivals():
        for i in range(3):
            rows = [(s, j, "decode", 0, 0, [float(j)] * 8, [0.0] * 8, (start + pd.Timedelta(minutes=j)).to_pydatetime()) for s in (1, 2) for j in range(8 * i, 8 * i + 8)]
            rows = rows if i < 2 else [(-1, -1, "tick", 0, 0, None, None, (start + pd.Timedelta(days=1)).to_pydatetime())]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "next" / str(i)))
            (tmp_path / "in").mkdir(exist_ok=True)
            os.rename(tmp_path / "next" / str(i), tmp_path / "in" / str(i))
            yield
            seen.append((spark.conf.get(capture.COMPACT[0], None), sorted(r["token_idx"] for r in history.latest().where("session = 1").collect())))
            shutil.rmtree(tmp_path / "in" / str(i))

    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")).withWatermark("ts", "1 minute")
    counts = capture.run_available(source, history, str(tmp_path / "counts"), str(tmp_path / "state"), bucket_ms=60_000, arrivals=arrivals()).collect()
    # of 8 and 16 minutes, 6 and 14 are before the watermark; a full buffer of 4 drains when another token comes
    assert seen == [("true", list(range(4))), ("true", list(range(12))), ("true", list(range(12)))]
    assert sorted(tuple(r) for r in counts) == [(1, 0, 16, 12, 4), (2, 0, 16, 12, 4)] and spark.conf.get(capture.COMPACT[0], None) is None


class Held(dict):
    """A map or value state in memory that counts what is written."""

    writes = 0

    def updateValue(self, k, v):
        self[k] = v
        self.writes += 1

    getValue, removeKey = dict.get, dict.pop

    def iterator(self):
        return iter(list(self.items()))

    def get(self):
        return self.getValue(())

    def update(self, v):
        self[()] = v


def test_waiting_events_are_written_few_times():
    """events of 512 steps are put away in parts by powers of two, and again as often as the logarithm says, not part by part."""
    p = capture.CaptureProcessor(4, 1000)
    p.due, p.early, p.parts, timers = Held(), Held(), Held(), set()
    p.handle = type("Handle", (), {"registerTimer": staticmethod(timers.add)})
    n = 512
    ts = pd.to_datetime(np.arange(n) * 1000, unit="ms")
    frame = pd.DataFrame({"session": 1, "seq": np.arange(n), "kind": "decode", "batch_id": 0, "batch_size": 0, "key": None, "value": None, "ts": ts})
    p._keep(frame, 0)
    assert p.early.writes <= 10
    worked = []
    p._work = lambda f, order: worked.extend(f["seq"].tolist()) or iter(())
    for now in range(0, (n + 2) * 1000, 1000):
        if any(t <= now for t in timers):
            values = type("Values", (), {"getCurrentWatermarkInMs": lambda self: now})()  # noqa: B023
            list(p.handleExpiredTimer((0,), values, None))
            assert sorted(worked) == list(range(now // 1000))
            timers = {t for t in timers if t > now}
            p.handle.registerTimer = timers.add
    assert sorted(worked) == list(range(n)) and not p.early and p.early.writes < 4 * n
