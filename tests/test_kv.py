import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.errors import BufferTooSmall, InvalidArgument, InvalidDim, ShapeMismatch
from sparquill.functions import kernels as k
from sparquill.operators import attention, codecs, kv, score
from sparquill.operators.history import History
from sparquill.specs import KvSpec, ProdSpec
from sparquill.streaming import capture
from sparquill.streaming.capture import Engine, Ring


def test_engine_examples():
    e = Engine(8)
    for i in range(29):
        e.decode([i])
    assert (e.compressed, len(e.ring)) == (24, 5)
    e = Engine(16)
    e.prefill(list(range(50)))
    assert (e.compressed, len(e.ring)) == (34, 16)
    e = Engine(16)
    e.prefill(list(range(10)))
    assert (e.compressed, len(e.ring)) == (0, 10)
    e.drain()
    assert (e.compressed, len(e.ring), e.total) == (10, 0, 10)
    e.reset()
    assert (e.compressed, e.total) == (0, 0)


def test_bulk_equals_one_at_a_time():
    a, b = Engine(8), Engine(8)
    a.decode(list(range(25)))
    for i in range(25):
        b.decode([i])
    assert a.drained == b.drained and a.ring == b.ring


@pytest.mark.parametrize("cap", [1, 3, 8])
def test_batch_equals_engine(spark, cap):
    cases = [(p, d) for p in (0, 1, cap, cap + 1, 2 * cap + 3) for d in (0, 1, cap, 17) if p + d]
    tokens = [(s, i) for s, (p, d) in enumerate(cases) for i in range(p + d)]
    prefill = spark.createDataFrame([(s, p) for s, (p, _) in enumerate(cases)], "session long, prefill long")
    got = kv.capture(spark.createDataFrame(tokens, "session long, token_idx long"), cap, prefill)
    out = sorted((r["session"], r["chunk_id"], r["token_idx"]) for r in got.collect() if not r["is_recent"])
    want = []
    for s, (p, d) in enumerate(cases):
        e = Engine(cap)
        if p:
            e.prefill(list(range(p)))
        e.decode(list(range(p, p + d)))
        want += [(s, c, i) for c, i in e.drained]
    assert out == sorted(want)


def test_ring():
    ring = Ring(4)
    ring.write([1, 2, 3])
    assert (len(ring), ring.space_left, ring.is_full, ring.contents) == (3, 1, False, [1, 2, 3])
    with pytest.raises(BufferTooSmall):
        ring.write([4, 5])
    assert ring.contents == [1, 2, 3]  # nothing was written
    ring.write([4])
    assert ring.is_full and ring.drain() == [1, 2, 3, 4] and len(ring) == 0 and ring.total_written == 4
    ring.reset()
    assert ring.total_written == 0
    with pytest.raises(InvalidDim):
        Ring(0)


def test_reset_begins_an_epoch():
    e = Engine(2)
    e.decode([1, 2, 3])
    e.reset()
    e.decode([4, 5, 6])
    assert e.drained == [(0, 1), (0, 2), (0, 4), (0, 5)] and (e.epoch, e.chunks, e.total) == (1, 1, 3)


def test_placed_equals_row_number(spark):
    rows = [(i % 3 if i % 7 else 0, i * 37 % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "s long, ts long, id long")
    got = {r["id"]: r["token_idx"] for r in kv.placed(df, "s", ["ts", "id"], F.floor(F.col("ts") / 10)).collect()}
    for session in (0, 1, 2):
        mine = sorted((ts, i) for s, ts, i in rows if s == session)
        assert [got[i] for _, i in mine] == list(range(len(mine)))


def test_history_appends_resets_and_ignores_what_failed(spark, tmp_path):
    spec = KvSpec(8, 2, 3, 2, 4, 4)
    rng = np.random.default_rng(0)
    rows = [(1, 0, t // 4, t, h, rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for t in range(6) for h in range(2)]
    tokens = spark.createDataFrame(rows, "session long, epoch long, chunk_id long, token_idx long, kv_head int, key array<float>, value array<float>")
    history = History(spark, str(tmp_path / "h"), spec)
    assert history.read().count() == 0
    history.append(tokens.where("chunk_id = 0"), "a")
    history.append(tokens.where("chunk_id = 1"), "b")
    history.append(tokens.where("chunk_id = 1"), "b")  # again under its name
    history.append(tokens.limit(0))
    with pytest.raises(Exception):
        history.append(tokens.withColumn("key", F.array(F.lit(1.0).cast("float"))))
    flat = history.flat().collect()
    assert [(r["kv_head"], r["token_idx"]) for r in flat] == [(h, t) for h in range(2) for t in range(6)]
    value = k.value_quantize(np.array([rows[0][6]], np.float32), spec.value)
    assert bytes(flat[0]["value_code"]["data"]) == value[0].tobytes()
    assert history.counters().first().asDict() == {"session": 1, "num_tokens": 6, "num_chunks": 2, "bytes": 12 * (spec.key.bytes_per_vector + spec.value.bytes_per_vector)}
    back = {(r["token_idx"], r["kv_head"]): r["value"] for r in kv.decompress(history.read(), spec).collect()}
    assert all(np.abs(np.array(back[r[3], r[4]]) - r[6]).max() < 1.5 for r in rows)
    history.append(tokens.where("token_idx = 0").withColumn("epoch", F.lit(1).cast("long")))
    history.append_resets(spark.createDataFrame([(1, 1)], "session long, epoch long"))
    assert history.flat().count() == 2  # an earlier epoch is gone
    history.reset()
    assert history.read().count() == 0


def test_stream_equals_engine(spark, tmp_path):
    """Prefill in parts, decode, flush and reset over several micro-batches against the engine in memory."""
    spec = KvSpec(4, 2, 2, 2, 4, 3)
    vector = lambda s, q: [float(s), float(q), 0.5, -1.0] * 2
    token = lambda s, q, kind="decode", b=0, n=0: (s, q, kind, b, n, vector(s, q), vector(q, s))
    control = lambda s, q, kind: (s, q, kind, 0, 0, None, None)
    files = [
        [token(1, q) for q in range(5)] + [token(2, q, "prefill", 7, 8) for q in range(5)],
        [token(1, 5), control(1, 6, "flush"), token(1, 7)] + [token(2, q, "prefill", 7, 8) for q in range(5, 8)] + [token(2, 8)],
        [control(1, 8, "reset"), *[token(1, q) for q in range(9, 13)]] + [token(2, q, "prefill", 9, 2) for q in (9, 10)],
    ]
    for rows in files:
        spark.createDataFrame(rows, capture.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(capture.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    history = History(spark, str(tmp_path / "history"), spec)
    counts = {r["session"]: (r["epoch"], r["total"], r["compressed"], r["buffered"]) for r in capture.run_available(source, history, str(tmp_path / "counts"), str(tmp_path / "state")).collect()}
    one, two = Engine(3), Engine(3)
    one.decode(list(range(6)))
    one.drain()
    one.decode([7])
    one.reset()
    one.decode(list(range(9, 13)))
    two.prefill(list(range(8)))
    two.decode([8])
    two.prefill([9, 10])
    assert counts == {1: (1, 4, one.compressed, len(one.ring)), 2: (0, 11, two.compressed, len(two.ring))}
    got = {(r["session"], r["epoch"], r["chunk_id"], r["token_idx"]) for r in history.read().collect()}
    assert got == {(1, 0, 0, 0), (1, 0, 0, 1), (1, 0, 0, 2), *((1, 0, 1, q) for q in (3, 4, 5)), *((1, 1, 0, q) for q in (9, 10, 11)), *((2, 0, c, q) for c, q in two.drained)}
    row = history.read().where("session = 2 and token_idx = 3 and kv_head = 1").first()
    assert bytes(row["value_code"]["data"]) == k.value_quantize(np.array([vector(3, 2)[4:]]), spec.value)[0].tobytes()


def _dense(q, keys, values, scale):
    s = q @ keys.T * scale
    w = np.exp(s - s.max(1, keepdims=True))
    return w / w.sum(1, keepdims=True) @ values


@pytest.mark.parametrize("n_hist, n_recent, q_heads, scale, block", [(512, 64, 4, 0.0, 1 << 25), (2048, 0, 2, 0.25, 1 << 25), (20, 6, 8, 0.0, 300), (5, 6, 2, 0.0, 1 << 25)])
def test_attention_equals_dense(spark, monkeypatch, n_hist, n_recent, q_heads, scale, block):
    monkeypatch.setattr(score, "BLOCK_BYTES", block)  # a small one makes many blocks of queries
    spec = KvSpec(16, 2, 4, 4, 8)
    rng = np.random.default_rng(n_hist)
    q, keys, values = rng.normal(size=(2, q_heads, 16)).astype(np.float32), *rng.normal(size=(2, 2, n_hist + n_recent, 16)).astype(np.float32)
    rows = [(h, t, keys[h, t].tolist(), values[h, t].tolist()) for h in range(2) for t in range(n_hist + n_recent)]
    tokens = spark.createDataFrame(rows, "kv_head int, token_idx long, key array<float>, value array<float>").repartition(3)
    asked = spark.createDataFrame([(i, h, q[i, h].tolist()) for i in range(2) for h in range(q_heads)], "q_token int, q_head int, q array<float>")
    store = kv.compress(tokens.where(F.col("token_idx") < n_hist), spec)
    out = attention.hybrid_attention(asked, store, tokens.where(F.col("token_idx") >= n_hist), spec, q_heads, scale)
    got = np.zeros((2, q_heads, 16))
    for r in out.collect():
        got[r["q_token"], r["q_head"], r["pos"]] = r["value"]
    back = keys.astype(float), values.astype(float)
    for h in range(2):
        key_code = [np.asarray(c, np.float32).astype(float) if c.dtype == float else c for c in k.prod_quantize(keys[h, :n_hist], spec.key)]
        value_code = [np.asarray(c, np.float32).astype(float) if c.dtype == float else c for c in k.value_quantize(values[h, :n_hist], spec.value)]
        back[0][h, :n_hist], back[1][h, :n_hist] = k.prod_dequantize(*key_code, spec.key), k.value_dequantize(*value_code, spec.value)
    first = 0 if n_hist >= spec.min_history else n_hist
    for h in range(q_heads):
        mine = h // (q_heads // 2)
        want = _dense(q[:, h].astype(float), back[0][mine, first:], back[1][mine, first:], scale or 16**-0.5)
        assert np.abs(got[:, h] - want).max() < 1e-9


@pytest.mark.parametrize("block", [1 << 25, 2000])
def test_scores_in_blocks_and_top(spark, monkeypatch, block):
    monkeypatch.setattr(score, "BLOCK_BYTES", block)
    monkeypatch.setattr(score, "ROWS", 500)
    spec, rng = ProdSpec(16, 3), np.random.default_rng(8)
    q, keys = rng.normal(size=(40, 16)).astype(np.float32), rng.normal(size=(300, 16)).astype(np.float32)
    asked = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(q)] + [(99, 0, None)], "q_id long, g int, q array<float>")
    held = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(keys)] + [(999, 0, None)], "k_id long, g int, x array<float>").repartition(3)
    coded = codecs.encode(held, "x", spec).drop("x")
    code = [np.asarray(c, np.float32).astype(float) if c.dtype == float else c for c in k.prod_quantize(keys, spec)]
    want = k.prod_score(q, *code, spec)
    out = {(r["q_id"], r["k_id"]): r["score"] for r in score.attention_score(asked.drop("g"), coded.drop("g"), spec).collect()}
    assert len(out) == want.size and all(abs(out[i, j] - want[i, j]) < 1e-9 for i in range(40) for j in range(300))
    within = {(r["q_id"], r["k_id"]) for r in score.attention_score(asked, coded, spec, group="g").collect()}
    assert within == {(i, j) for i in range(40) for j in range(300) if i % 2 == j % 2}
    best = score.attention_score(asked.drop("g"), coded.drop("g"), spec, top=5)
    assert best.count() <= 40 * 5 * 3  # a task gives its own best only
    got = {(r["q_id"], r["rank"]): r["k_id"] for r in score.top_k(best, 5).collect()}
    assert got == {(i, r + 1): j for i in range(40) for r, j in enumerate(np.argsort(-want[i])[:5].tolist())}


def test_weights_sum_to_one(spark):
    rng = np.random.default_rng(5)
    tokens = spark.createDataFrame([(t % 2, t // 2, rng.normal(size=8).tolist()) for t in range(100)], "kv_head int, token_idx long, key array<float>")
    asked = spark.createDataFrame([(0, h, rng.normal(size=8).tolist()) for h in range(4)], "q_token int, q_head int, q array<float>")
    for r in attention.attention_weights(asked, tokens, 4, 2, 8).groupBy("q_head").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect():
        assert abs(r["w"] - 1) < 1e-12 and r["n"] == 50


def test_attention_rejects(spark):
    q = spark.createDataFrame([], "q_token int, q_head int, q array<float>")
    t = spark.createDataFrame([], "kv_head int, token_idx long, key array<float>, value array<float>")
    with pytest.raises(InvalidArgument):
        attention.hybrid_attention(q, t, t, KvSpec(64, 2), 3)
    with pytest.raises(InvalidDim):
        attention.hybrid_attention(q, t, t, KvSpec(64, 2), 0)
    short = spark.createDataFrame([(0, 0, [1.0])], "q_token int, q_head int, q array<float>")
    with pytest.raises(ShapeMismatch):
        attention.hybrid_attention(short, t, t, KvSpec(64, 2), 4)
