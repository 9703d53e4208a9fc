"""Blocks that meet on executors, attention by session, the stored history's resets and view, the stream's state and order."""

from collections import Counter

import numpy as np
import pytest

from sparquill.functions import kernels as k
from sparquill.functions.udfs import plain
from sparquill.operators import attention, blocks, codecs, kv, score
from sparquill.operators.history import FANOUT, History
from sparquill.specs import KvSpec, ProdSpec
from sparquill.streaming import capture
from sparquill.streaming.capture import Engine


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_block_pairs_meet_once(spark, by):
    """Every pair of rows that agree is in one pair of blocks; a group with most rows is in several cells; null meets nothing."""
    left = [(i, "hot" if i % 3 else f"g{i % 5}", i % 2) for i in range(60)] + [(99, None, 1)]
    right = [(i, "hot" if i % 4 else f"g{i % 7}", i % 2) for i in range(90)] + [(98, "hot", None)]
    a, b = spark.createDataFrame(left, "a long, g string, h int").repartition(3), spark.createDataFrame(right, "b long, g string, h int").repartition(2)
    pairs = blocks.block_pairs(a, b, by, 4, 7, cell=10)
    rows = pairs.collect()
    met, sizes = Counter(), set()
    for r in rows:
        x, y = blocks.from_bytes(r["left"]), blocks.from_bytes(r["right"])
        assert "g" not in x.schema.names if "g" in by else True
        sizes |= {(len(x) <= 4, len(y) <= 7)}
        met.update((p, q) for p in x["a"].to_pylist() for q in y["b"].to_pylist())
    agree = lambda l, r: all(l[i] is not None and l[i] == r[i] for i, c in ((1, "g"), (2, "h")) if c in by)
    assert met == Counter((l[0], r[0]) for l in left for r in right if agree(l, r)) and sizes == {(True, True)}
    if by == ["g"]:
        assert sum(r["g"] == "hot" for r in rows) > 4 * 4  # cells of both sides


def test_many_queries_are_met_in_blocks(spark, monkeypatch):
    """Beyond BLOCK_BYTES the driver collects no query; same rows, and the best keys come with slack for rounding."""
    rng = np.random.default_rng(1)
    spec = ProdSpec(16, 3)
    keys = spark.createDataFrame([(i, rng.normal(size=16).tolist() if i % 9 else None) for i in range(200)], "k_id long, x array<float>")
    queries = spark.createDataFrame([(i, rng.normal(size=16).tolist() if i % 7 else None) for i in range(40)], "q_id long, q array<float>")
    coded = codecs.encode(keys, "x", spec).drop("x")
    rows = lambda df: sorted((r["q_id"], r["k_id"], round(r["score"], 9)) for r in df.collect())
    want = rows(score.attention_score(queries, coded, spec))
    assert len(want) == 34 * 177 and score.attention_score(queries.limit(0), coded, spec).count() == 0
    monkeypatch.setattr(score, "BLOCK_BYTES", 1)
    monkeypatch.setattr(score, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(score, "BLOCK_KEYS", 11)
    monkeypatch.setattr(blocks, "CELL_ROWS", 30)
    monkeypatch.setattr(type(queries), "toArrow", lambda self: pytest.fail("queries came to the driver"))
    assert rows(score.attention_score(queries, coded, spec)) == want
    best = score.top_k(score.attention_score(queries, coded, spec, top=3, slack=1e-6), 3)
    by_query = {}
    for q, key, s in want:
        by_query.setdefault(q, []).append((-s, key))
    assert sorted((r["q_id"], r["k_id"]) for r in best.collect()) == sorted((q, key) for q, v in by_query.items() for _, key in sorted(v)[:3])


def test_top_keeps_what_rounding_makes_equal(spark):
    """The smaller id wins where scores differ by less than the rounding."""
    spec = ProdSpec(4, 2)
    base = np.array([1.0, 2.0, -1.0, 0.5])
    keys = spark.createDataFrame([(i, (base * (1 + 1e-7 * i)).tolist()) for i in range(20)], "k_id long, x array<float>").coalesce(1)
    queries = spark.createDataFrame([(0, base.tolist())], "q_id long, q array<float>")
    found = score.attention_score(queries, codecs.encode(keys, "x", spec).drop("x"), spec, top=1, slack=1e-5).collect()
    assert {r["k_id"] for r in found} > {19, 0}


def plain_attention(q, tokens, scale):
    if not tokens:
        return np.zeros(len(q))
    keys, values = (np.array([t[i] for t in tokens], float) for i in (0, 1))
    w = np.exp((keys @ q) * scale - ((keys @ q) * scale).max())
    return (w / w.sum()) @ values


@pytest.mark.parametrize("cell", [1 << 18, 8])
def test_session_attention_equals_plain(spark, monkeypatch, cell):
    """Sessions with a long, a short and no history, with and without recent tokens, and one without any; small cells spread them."""
    monkeypatch.setattr(blocks, "CELL_ROWS", cell)
    monkeypatch.setattr(attention, "BLOCK_KEYS", 7)
    monkeypatch.setattr(attention, "ROWS", 12)
    rng = np.random.default_rng(2)
    spec = KvSpec(8, 2, 4, 4, 8, 4, min_history=5)
    vec = lambda: rng.normal(size=8).astype(np.float32).tolist()
    lengths = {1: (40, 3), 2: (4, 2), 3: (0, 4), 4: (4, 0), 5: (0, 0), 6: (6, 0)}
    old = [(s, t, h, vec(), vec()) for s, (n, _) in lengths.items() for t in range(n) for h in range(2)]
    new = [(s, 100 + t, h, vec(), vec()) for s, (_, n) in lengths.items() for t in range(n) for h in range(2)]
    schema = "session long, token_idx long, kv_head int, key array<float>, value array<float>"
    nulls = [(1, 999, 0, None, vec())]
    store = kv.compress(spark.createDataFrame(old, schema), spec)
    back = {(r["session"], r["token_idx"], r["kv_head"]): (r["key"], r["value"]) for r in kv.decompress(store, spec).collect()}
    asked = [(s, t, h, vec()) for s in lengths for t in range(3) for h in range(4)]
    queries = spark.createDataFrame(asked, "session long, q_token int, q_head int, q array<float>")
    got = attention.session_attention(queries, store, spark.createDataFrame(new + nulls, schema), spec, 4).collect()
    found = {}
    for r in got:
        found.setdefault((r["session"], r["q_token"], r["q_head"]), {})[r["pos"]] = r["value"]
    assert len(got) == len(asked) * 8
    for s, t, h, q in asked:
        tokens = [back[x[:3]] for x in old if x[0] == s and x[2] == h // 2] if lengths[s][0] >= 5 else []
        tokens = tokens + [x[3:] for x in new if x[0] == s and x[2] == h // 2]
        want = plain_attention(np.array(q, np.float32).astype(float), tokens, 8**-0.5)
        assert np.allclose([found[s, t, h][p] for p in range(8)], want, atol=1e-6)


def test_partials_take_steps(monkeypatch):
    """A task makes at most ROWS logits at once."""
    import pyarrow as pa

    monkeypatch.setattr(attention, "ROWS", 10)
    rng = np.random.default_rng(3)
    x, keys = rng.normal(size=(4, 8)), rng.normal(size=(33, 8)).astype(np.float32)
    seen, part = [], k.Partial(4, 8)
    add = part.add
    part.add = lambda at, logits, values: (seen.append(logits.size), add(at, logits, values))
    column = pa.array(keys.tolist(), pa.list_(pa.float32()))
    attention._attend(part, np.arange(4), (x,), column, column, None, 1.0, 8)
    assert max(seen) <= 10 and np.allclose(part.sums / part.total[:, None], [plain_attention(q, [(r, r) for r in keys], 1.0) for q in x])
    assert plain(ProdSpec(8, 3)).dim == 8


SPEC = KvSpec(8, 1, 4, 4, 8, 4)
TOKENS = "session long, epoch long, chunk_id long, token_idx long, kv_head int, key array<float>, value array<float>"


def tokens(spark, rows):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(*r, 0, rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for r in rows], TOKENS)


def places(df):
    return sorted((r["session"], r["epoch"], r["token_idx"]) for r in df.collect())


def files(history):
    fs, at = history._at("view")
    if not fs.exists(at):
        return {}
    found, it = {}, fs.listFiles(at, True)
    while it.hasNext():
        s = it.next()
        if "/part-" in s.getPath().toString() and ".crc" not in s.getPath().toString():
            found[s.getPath().toString()] = s.getModificationTime()
    return found


def test_view_rewrites_no_older_chunk(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), SPEC)
    assert history.refresh() == {"sorted": 0, "merged": 0} and history.view().count() == 0
    merged, rows = 0, []
    for n in range(9):
        mine = [(s, 0, n, 10 * n + i) for s in range(3) for i in range(4)]
        rows += [(s, 0, t) for s, _, _, t in mine]
        history.append(tokens(spark, mine), f"b{n}")
        before = files(history)
        done = history.refresh()
        assert done["sorted"] == 1  # the new batch alone is sorted
        if not done["merged"]:
            assert before.items() <= files(history).items()
        merged += done["merged"]
        assert places(history.view()) == sorted(rows)
        assert len(history._runs()) <= 2 * FANOUT
    assert merged == 2 * FANOUT and history.refresh() == {"sorted": 0, "merged": 0}
    assert places(history.view([1])) == sorted(r for r in rows if r[0] == 1)
    # a merge that was broken off before it removed what it merged: each batch is still read once
    runs = history._runs()
    history._write_run(history._load([f"view/{n}" for n in runs], history.view().schema), set().union(*runs.values()), 7)
    assert places(history.view()) == sorted(rows) and len(history._runs()) == 1


def test_resets_hide_what_came_before(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), SPEC)
    history.append(tokens(spark, [(1, 0, 0, 0), (1, 0, 0, 1), (2, 0, 0, 0)]), "a")
    history.append_resets(spark.createDataFrame([(1, 1)], "session long, epoch long"), "a")
    history.refresh()
    assert places(history.latest()) == places(history.flat()) == places(history.view()) == [(2, 0, 0)]
    assert {r["session"]: (r["num_tokens"], r["num_chunks"], r["bytes"]) for r in history.counters().collect()}[1] == (0, 0, 0)
    history.append(tokens(spark, [(1, 1, 0, 5)]), "b")
    history.append_resets(spark.createDataFrame([(1, 1), (9, 3)], "session long, epoch long"), "a")  # the same mark again
    assert places(history.latest()) == [(1, 1, 5), (2, 0, 0)]
    assert {r["session"]: r["num_tokens"] for r in history.counters().collect()} == {1: 1, 2: 1, 9: 0}
    history.reset()
    assert history.latest().count() == 0


def events(spark, rows, schema=capture.EVENTS):
    return spark.createDataFrame(rows, schema)


def test_state_of_the_stream_can_be_read(spark, tmp_path):
    """Buffer after decodes, a prefill that comes in two files, a flush and a reset, as the engine has it."""
    v = lambda i: [float(i)] * 8
    steps = [[(1, i, "decode", 0, 0, v(i), v(-i)) for i in range(6)] + [(2, i, "prefill", 7, 5, v(i), v(i)) for i in range(3)]]
    steps += [[(2, i, "prefill", 7, 5, v(i), v(i)) for i in range(3, 5)] + [(1, 6, "decode", 0, 0, v(6), v(-6)), (3, 0, "decode", 0, 0, v(0), None)]]
    steps += [[(3, 1, "reset", 0, 0, None, None), (3, 2, "reset", 0, 0, None, None), (4, 0, "decode", 0, 0, v(1), v(1)), (4, 1, "flush", 0, 0, None, None)]]
    for i, rows in enumerate(steps):
        events(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(capture.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    history = History(spark, str(tmp_path / "history"), SPEC)
    counts = {r["session"]: (r["epoch"], r["total"], r["compressed"], r["buffered"]) for r in capture.run_available(source, history, str(tmp_path / "counts"), str(tmp_path / "state")).collect()}
    one, two = Engine(4), Engine(4)
    one.decode(list(range(7)))
    two.prefill(list(range(5)))
    ring = {}
    for r in capture.recent(spark, str(tmp_path / "state"), SPEC).collect():
        ring.setdefault(r["session"], []).append((r["token_idx"], r["key"], r["value"]))
    assert sorted(x[0] for x in ring[1]) == one.ring and sorted(x[0] for x in ring[2]) == two.ring and set(ring) == {1, 2}
    assert sorted(ring[1]) == [(i, v(i), v(-i)) for i in one.ring]
    assert counts == {1: (0, 7, 4, 3), 2: (0, 5, 1, 4), 3: (2, 0, 0, 0), 4: (0, 1, 1, 0)}
    assert {r["session"]: r["num_tokens"] for r in history.counters().collect()} == {1: 4, 2: 1, 3: 0, 4: 1}


def test_late_events_are_put_in_order(spark, tmp_path):
    """Files in any order give the chunks of the order by time, as long as nothing is later than the watermark."""
    import datetime as dt

    start, rng = dt.datetime(2024, 1, 1), np.random.default_rng(5)
    rows = [(s, i, "decode", 0, 0, [float(i)] * 8, [0.0] * 8, start + dt.timedelta(minutes=7 * (i // 2))) for s in (1, 2) for i in range(30)]
    order = rng.permutation(len(rows))
    for i in range(3):
        part = [rows[j] for j in order[i::3]]
        events(spark, part, f"{capture.EVENTS}, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events(spark, [(-1, 0, "tick", 0, 0, None, None, start + dt.timedelta(days=9))], f"{capture.EVENTS}, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(f"{capture.EVENTS}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 day")
    history = History(spark, str(tmp_path / "history"), SPEC)
    capture.run_available(source, history, str(tmp_path / "counts"), str(tmp_path / "state"), bucket_ms=600_000)
    found = sorted((r["session"], r["chunk_id"], r["token_idx"]) for r in history.latest().collect())
    assert found == [(s, i // 4, i) for s in (1, 2) for i in range(28)]
