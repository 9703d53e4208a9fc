"""SQL functions with attributes, the attention aggregates, generated sources, and the batch capture of any events."""

import json
import random

import numpy as np
import pytest
from away import run_away

from sparquill.errors import CodebookCorrupt, InvalidArgument, InvalidDim
from sparquill.functions import aggregates, udfs
from sparquill.functions.codebook import lloyd_max
from sparquill.functions.udfs import plain
from sparquill.operators import kv
from sparquill.sources import generated
from sparquill.specs import MseSpec, ProdSpec, ValueSpec
from sparquill.streaming.capture import Engine


def test_constants_of_a_worker_are_the_driver_s():
    for codec, spec, third in (("mse", MseSpec(8, 3, 5), 5), ("prod", ProdSpec(8, 3, 5), 5), ("value", ValueSpec(8, 4, 4), 4)):
        a, b = udfs._made_here(codec, 8, spec.bits, third), plain(spec)
        flat = lambda n: {k: flat(v) if hasattr(v, "__dict__") else np.asarray(v).tolist() for k, v in vars(n).items()}
        assert flat(a) == flat(b)
        assert udfs._made_here(codec, 8, spec.bits, third) is a
    for bad in (("mse", 8, 5, 1), ("prod", 8, 1, 1), ("mse", 2, 1, 1), ("mse", 8, 1, -1), ("value", 8, 3, 4), ("value", 8, 4, 3), ("mse", -1, -1, -1)):
        with pytest.raises(ValueError):
            udfs._made_here(*bad)


def test_attributes_may_differ_from_row_to_row(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist() if i % 5 else None, 1 + i % 4, i % 3) for i in range(40)]
    udfs.register_with_attributes(spark)
    spark.createDataFrame(rows, "id long, x array<float>, bits int, seed int").createOrReplaceTempView("t")
    got = {r["id"]: r for r in spark.sql("select id, bits, seed, mse_quantize_with(x, 8, bits, seed) as c, mse_dequantize_with(mse_quantize_with(x, 8, bits, seed), 8, bits, seed) as d from t").collect()}
    from sparquill.functions import kernels as k

    for i, x, bits, seed in rows:
        if x is None:
            assert got[i]["c"] is None and got[i]["d"] is None
            continue
        spec = MseSpec(8, bits, seed)
        data, norms = k.mse_quantize(np.array([x], np.float32), spec)
        assert bytes(got[i]["c"]["indices"]) == data.tobytes()
        assert np.allclose(got[i]["d"], k.mse_dequantize(data, norms, spec)[0], atol=1e-5)
    with pytest.raises(Exception, match="no mse codec"):
        spark.sql("select mse_quantize_with(x, 8, 7, 1) from t where x is not null").collect()


def test_attributes_and_sources_on_bare_workers(tmp_path):
    run_away(
        tmp_path,
        """
        from sparquill.functions import aggregates, udfs
        from sparquill.sources import generated
        udfs.register_with_attributes(spark), aggregates.register_aggregates(spark), generated.register(spark)
        v = spark.read.format("gaussian_vectors").option("rows", 20).option("dim", 8).load()
        v.createOrReplaceTempView("v")
        assert spark.sql("select attention_score_with(x, prod_quantize_with(x, 8, 3, 1), 8, 3, 1) s from v").where("s > 0").count() == 20
        assert len(spark.sql("select attention_merge(p) o from (select attention_part(x, x, x, 1.0D) p from v group by vec_id % 3)").first()["o"]) == 8
        assert spark.read.format("codebooks").option("dims", "8").option("bits", "2").load().count() == 1
        """,
    )


def test_aggregates_equal_plain_attention(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, rng.normal(size=4).tolist() if t != 3 else None, rng.normal(size=4).tolist()) for s in range(3) for t in range(25)] + [(7, 0, None, None)]
    q = {s: rng.normal(size=4).tolist() for s in range(3)} | {7: [1.0] * 4}
    aggregates.register_aggregates(spark)
    spark.createDataFrame([(s, t, q[s], k, v) for s, t, k, v in rows], "s int, t int, q array<float>, k array<float>, v array<float>").createOrReplaceTempView("tokens")
    got = {r["s"]: r["o"] for r in spark.sql("select s, attention_merge(p) as o from (select s, attention_part(q, k, v, 0.5D) as p from tokens group by s, t div 4) group by s").collect()}
    for s in range(3):
        kept = [(k, v) for x, _, k, v in rows if x == s and k]
        logits = np.float32([k for k, _ in kept]) @ np.float32(q[s]) * 0.5
        w = np.exp(logits - logits.max())
        assert np.allclose(got[s], (w / w.sum()) @ np.float32([v for _, v in kept]), atol=1e-6)
    assert got[7] == [0.0] * 4


def test_generated_vectors(spark):
    generated.register(spark)
    load = lambda **o: spark.read.format("gaussian_vectors").options(**o).load()
    a, b = (sorted(map(tuple, load(rows=9000, dim=3, seed=4, partitions=p).collect())) for p in (1, 5))
    assert a == b and [i for i, _ in a] == list(range(9000))
    x = np.array([v for _, v in a])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03
    assert load(rows=0, dim=3).count() == 0 and load(rows=10, dim=3, std=0.0).where("x[0] <> 0").count() == 0
    for bad, error in (({"rows": 3}, InvalidArgument), ({"rows": 3, "dim": 0}, InvalidDim), ({"rows": -1, "dim": 2}, InvalidArgument)):
        with pytest.raises(error):
            generated.GaussianReader({k: str(v) for k, v in bad.items()})


def test_codebook_source(spark, tmp_path):
    generated.register(spark)
    book = lloyd_max(8, 2)
    made = spark.read.format("codebooks").option("dims", "8,16").option("bits", "1,2").load()
    rows = {(r["dim"], r["bits"]): r for r in made.collect()}
    assert set(rows) == {(8, 1), (8, 2), (16, 1), (16, 2)} and rows[8, 2]["centroids"] == list(book.centroids)
    text = {"d": 8, "bits": 2, "centroids": list(book.centroids), "boundaries": [-1.0, *book.boundaries, 1.0]}
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text("/* levels */\n" + json.dumps(text))
    bad.write_text(json.dumps({**text, "boundaries": [0.0, *book.boundaries, 1.0]}))
    read = spark.read.format("codebooks").option("path", f"{good},file://{good}").load().collect()
    assert len(read) == 2 and read[0]["centroids"] == list(book.centroids) and read[0]["boundaries"] == list(book.boundaries)
    with pytest.raises(CodebookCorrupt):
        generated.read_book(str(bad))
    with pytest.raises(InvalidArgument):
        generated.CodebookReader({"path": "x", "dims": "8", "bits": "1"})


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_batch_capture_equals_engine(spark, block):
    """Random decodes, prefills of any size, flushes and resets, event by event."""
    rng, cap = random.Random(block), 4
    rows, want = [], set()
    for session in range(8):
        engine, place = Engine(cap), 0
        for step in range(rng.randrange(0, 14)):
            kind = rng.choice(["decode"] * 4 + ["prefill", "prefill", "flush", "reset"])
            size = rng.randrange(1, 12) if kind == "prefill" else rng.randrange(1, 7) if kind == "decode" else 1
            mine = list(range(place, place + size))
            rows += [(session, p, kind, step, size) for p in mine]
            place += size
            epoch = engine.epoch
            if kind == "decode":
                engine.decode([(epoch, p) for p in mine])
            elif kind == "prefill":
                engine.prefill([(epoch, p) for p in mine])
            else:
                lost = list(engine.ring) if kind == "reset" else []
                engine.drain() if kind == "flush" else engine.reset()
                want |= {(session, p, e, "lost", False) for e, p in lost}
            want |= {(session, p, e, c, False) for c, (e, p) in engine.drained}
            engine.drained = []
        want |= {(session, p, e, None, True) for e, p in engine.ring}
    df = spark.createDataFrame(rows, "session long, place long, kind string, batch_id long, batch_size long").repartition(3)
    got = {tuple(r) for r in kv.capture_events(df, cap, block).collect()}
    lost = {(s, p, e) for s, p, e, c, _ in want if c == "lost"}
    assert {(*r[:3], "lost", False) if r[:3] in lost else r for r in got} == want and len(got) == len(want)
    with pytest.raises(InvalidDim):
        kv.capture_events(df, 0)
