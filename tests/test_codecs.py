import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparquill.errors import CodebookCorrupt, CodebookMissing, InvalidArgument, InvalidBits, InvalidDim, InvalidSeed, ShapeMismatch
from sparquill.functions import expressions as x
from sparquill.functions import kernels as k
from sparquill.functions import udfs
from sparquill.functions.codebook import lloyd_max
from sparquill.functions.linalg import rotation, sketch
from sparquill.operators import codecs
from sparquill.sources import codebooks
from sparquill.specs import KvSpec, MseSpec, ProdSpec, ValueSpec, packed_bytes


@given(st.integers(1, 70), st.sampled_from([1, 2, 3, 4, 8]), st.integers(0, 1000))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(dim, bits, seed):
    v = np.random.default_rng(seed).integers(0, 1 << bits, (3, dim)).astype(np.uint8)
    data = k.pack(v, bits)
    assert data.shape == (3, packed_bytes(dim, bits))
    assert (k.unpack(data, dim, bits) == v).all()


def test_golden_bytes(spark):
    assert k.pack([[1, 0, 1]], 1).tolist() == [[5]]
    assert k.pack([[i % 4 for i in range(16)]], 2).tolist() == [[0xE4] * 4]
    assert k.pack((np.array([[0.5, -0.1, 2, 0.3, -0.2, -0.9, 1.2, -0.5]]) > 0).astype(np.uint8), 1).tolist() == [[77]]
    df = spark.createDataFrame([([1, 2, 15, 4, 7],)], "v array<int>")
    packed = x.fence(df.withColumn("b", x.pack(F.col("v"), 5, 4)))
    row = packed.select(x.to_hex(F.col("b")).alias("h"), x.unpack(F.col("b"), 5, 4).alias("back"), x.from_binary(x.to_binary(F.col("b"))).alias("bytes")).first()
    assert row["h"] == "214F07" and row["back"] == [1, 2, 15, 4, 7] and row["bytes"] == [0x21, 0x4F, 0x07]


def test_ties_go_low(spark):
    df = spark.createDataFrame([([-0.5, 0.0, 0.5, 0.6],)], "v array<double>")
    assert df.select(x.cells(F.col("v"), [-0.5, 0.0, 0.5])).first()[0] == [0, 1, 2, 3]


def test_codebook_is_symmetric_and_improves():
    books = [lloyd_max(96, b) for b in (1, 2, 3, 4)]
    assert all(a.mse_per_coord > b.mse_per_coord for a, b in zip(books, books[1:]))
    for b in books:
        assert np.allclose(np.array(b.centroids), -np.array(b.centroids)[::-1], atol=1e-7)
        assert len(b.boundaries) == len(b.centroids) - 1 and list(b.boundaries) == sorted(b.boundaries)
    # one bit: the mean of the positive half of the density, close to sqrt(2 / (pi d)) for large d
    assert abs(lloyd_max(576, 1).centroids[1] - math.sqrt(2 / (math.pi * 576))) < 1e-4


@pytest.mark.parametrize("dim", [3, 64, 128])
def test_rotation(dim):
    pi = rotation(dim, 42)
    assert np.abs(pi @ pi.T - np.eye(dim)).max() < 1e-5
    assert (rotation(dim, 42) == pi).all() and not np.allclose(rotation(dim, 43), pi)
    assert sketch(dim, (1 << 32) - 1).shape == (dim, dim)


@pytest.mark.parametrize("bits, bound", [(1, 0.70), (2, 0.25), (3, 0.10), (4, 0.04)])
def test_mse_error(bits, bound):
    v = np.sin(0.13 * np.arange(128) + 0.7 * np.arange(4)[:, None])
    spec = MseSpec(128, bits)
    back = k.mse_dequantize(*k.mse_quantize(v, spec), spec)
    assert ((v - back) ** 2).sum() / (v**2).sum() < bound


def test_zero_vector_is_exact():
    for spec in (MseSpec(64, 3), ProdSpec(64, 3)):
        name = "mse" if isinstance(spec, MseSpec) else "prod"
        code = getattr(k, f"{name}_quantize")(np.zeros((1, 64)), spec)
        assert (getattr(k, f"{name}_dequantize")(*code, spec) == 0).all()


def test_score_equals_decoded_product():
    rng = np.random.default_rng(1)
    q, keys = rng.normal(size=(3, 128)), rng.normal(size=(6, 128))
    spec = ProdSpec(128, 3)
    code = k.prod_quantize(keys, spec)
    assert np.abs(k.prod_score(q, *code, spec) - q @ k.prod_dequantize(*code, spec).T).max() < 1e-9


def test_score_is_unbiased():
    rng = np.random.default_rng(2)
    q, keys = rng.normal(size=(4, 64)), rng.normal(size=(4, 64))
    mean = sum(k.prod_score(q, *k.prod_quantize(keys, s), s) for s in (ProdSpec(64, 3, seed) for seed in range(42, 106))) / 64
    assert np.abs(mean - q @ keys.T).mean() < 2


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_value_error_bound(bits):
    v = np.random.default_rng(bits).normal(size=(8, 128))
    spec = ValueSpec(128, bits)
    data, scales, zeros = k.value_quantize(v, spec)
    back = k.value_dequantize(data, scales, zeros, spec)
    assert (np.abs(v - back) <= 0.5001 * np.repeat(scales, 32, 1) + 1e-6).all()
    data, scales, zeros = k.value_quantize(np.full((1, 32), 3.0), ValueSpec(32, bits))
    assert scales[0, 0] == 1e-10 and zeros[0, 0] == 3


def test_specs_reject():
    for bad in (lambda: MseSpec(2, 3), lambda: MseSpec(1025, 3), lambda: ValueSpec(30, 2, 32), lambda: ValueSpec(32, 2, 0), lambda: KvSpec(64, 0)):
        with pytest.raises(InvalidDim):
            bad()
    for bad in (lambda: MseSpec(64, 5), lambda: ProdSpec(64, 1), lambda: ValueSpec(64, 3)):
        with pytest.raises(InvalidBits):
            bad()
    with pytest.raises(InvalidSeed):
        MseSpec(64, 3, -1)
    with pytest.raises(ShapeMismatch):
        MseSpec(64, 3, matrix=np.eye(63))
    own = MseSpec(3, 2, matrix=np.eye(3))
    assert (own.pi == np.eye(3)).all()


def test_arrow_round_trip_nulls_and_modes(spark):
    rows = [(0, [0.1] * 8), (1, None), (2, [0.0] * 8), (3, [1.0, -1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, x array<float>")
    for spec in (MseSpec(8, 4), ProdSpec(8, 3), ValueSpec(8, 8, 4)):
        out = {r["id"]: r["decoded"] for r in codecs.decode(codecs.encode(df, "x", spec, "arrow"), spec, "arrow").collect()}
        assert out[1] is None and len(out[0]) == 8 and np.allclose(out[2], 0, atol=1e-6)
    odd = spark.createDataFrame([(0, [1.0] * 7), (1, [float("nan")] * 8), (2, [1.0] * 8), (3, [None] + [1.0] * 7)], "id long, x array<float>")
    kept = {r["id"]: r["c"] for r in odd.select("id", udfs.encoder(MseSpec(8, 4), "permissive")("x").alias("c")).collect()}
    assert kept[0] is None and kept[1] is None and kept[3] is None and kept[2] is not None
    for bad, says in ((0, "8 elements"), (1, "not finite"), (3, "not finite")):  # one bad row at a time: any task may fail first
        with pytest.raises(Exception, match=says):
            odd.where(f"id = {bad}").select(udfs.encoder(MseSpec(8, 4))("x")).collect()
    with pytest.raises(InvalidArgument):
        codecs.encode(odd, "x", MseSpec(8, 4), "fast")


def test_slices_and_widths_of_codes():
    import pyarrow as pa

    rows = np.arange(24, dtype=np.uint8).reshape(6, 4)
    column = udfs._binary(rows)
    assert column.to_pylist() == [r.tobytes() for r in rows]
    assert (udfs._bytes(column.slice(2, 3), 4) == rows[2:5]).all()
    assert (udfs._bytes(pa.array([b"abcd"], pa.large_binary()), 4) == [[97, 98, 99, 100]]).all()
    with pytest.raises(ValueError, match="5 bytes"):
        udfs._bytes(column, 5)


def test_engines_agree_in_many_dimensions(spark):
    rng = np.random.default_rng(4)
    for dim in (3, 5, 16, 33):
        df = spark.createDataFrame([(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(50)], "id long, x array<float>")
        for spec in (MseSpec(dim, 1), MseSpec(dim, 3), *([ProdSpec(dim, 2), ProdSpec(dim, 4)] if dim < 33 else [])):
            a = {r["id"]: r["codes"] for r in codecs.code_text(codecs.encode(df, "x", spec), spec).collect()}
            b = {r["id"]: r["codes"] for r in codecs.code_text(codecs.encode(df, "x", spec, "jvm"), spec, "jvm").collect()}
            assert a == b


def test_sql_functions(spark):
    names = udfs.register(spark, MseSpec(8, 4), ProdSpec(8, 3), ValueSpec(8, 4, 4))
    assert len(names) == 7
    spark.createDataFrame([([0.1, 0.2, -0.3, 0.4, 0.0, -1.0, 0.5, 0.6],)], "x array<float>").createOrReplaceTempView("v8")
    row = spark.sql(
        "select mse_dequantize(mse_quantize(x)) as m, value_dequantize(value_quantize(x)) as v, prod_dequantize(prod_quantize(x)) as p, attention_score(x, prod_quantize(x)) as s, x from v8"
    ).first()
    assert np.allclose(row["v"], row["x"], atol=0.06) and abs(row["s"] - np.dot(row["p"], row["x"])) < 1e-5


def test_codebook_json(spark, tmp_path):
    book = lloyd_max(64, 2)
    good = tmp_path / "codebook_d64_b2.json"
    edges = [-1.0, *book.boundaries, 1.0]
    good.write_text(f'/* levels */ {{"d": 64, "bits": 2, "centroids": {list(book.centroids)}, "boundaries": {edges}}}')
    assert codebooks.find(codebooks.read_json(spark, str(good)), 64, 2).centroids == book.centroids
    spark.conf.set(codebooks.FOLDER_CONF, str(tmp_path))
    assert codebooks.get(spark, 64, 2).mse_per_coord == 0.0  # from the file, which has none
    spark.conf.unset(codebooks.FOLDER_CONF)
    with pytest.raises(CodebookMissing):
        codebooks.find(codebooks.to_table(spark, [book]), 64, 3)
    bad = tmp_path / "bad.json"
    bad.write_text('{"d": 64, "bits": 2, "centroids": [0.1, 0.0, 0.2, 0.3], "boundaries": [-1.0, 0.0, 0.1, 0.2, 1.0]}')
    with pytest.raises(CodebookCorrupt):
        codebooks.read_json(spark, str(bad))


def test_plan_has_no_shuffle_and_prunes(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x"))
    for engine in codecs.ENGINES:
        plan = codecs.encode(df, "x", MseSpec(64, 3), engine)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "label" not in plan and ("Python" in plan) == (engine == "arrow")


def test_a_codebook_that_is_handed_in_decides_the_codes():
    from sparquill.functions.codebook import Codebook

    book = Codebook(8, 1, (-0.5, 0.25), (0.1,), 0.0)
    spec = MseSpec(8, 1, matrix=np.eye(8), book=book)
    x = np.array([[0.2, 0.05, -0.3, 0.6, 0.09, 0.11, 0.0, 0.7]])
    cells = k.unpack(k.mse_quantize(x / np.sqrt((x**2).sum()), spec)[0], 8, 1)
    assert cells.tolist() == [[int(v > 0.1) for v in (x / np.sqrt((x**2).sum()))[0]]]
    levels = set(np.round(k.mse_dequantize(*k.mse_quantize(x, spec), spec) / np.sqrt((x**2).sum()), 6).ravel().tolist())
    assert levels == {-0.5, 0.25}
    assert ProdSpec(8, 2, book=book).mse.codebook is book
    for bad in (lambda: MseSpec(8, 2, book=book), lambda: MseSpec(9, 1, book=book), lambda: ProdSpec(8, 3, book=book)):
        with pytest.raises(ShapeMismatch):
            bad()


@pytest.mark.parametrize(("dim", "bits"), [(8, 1), (9, 1), (9, 2), (7, 3), (7, 4), (5, 8)])
def test_codes_are_spelled_byte_by_byte(dim, bits):
    values = np.arange(1 << bits) * 0.5 - 1
    codes = np.random.default_rng(bits).integers(0, 1 << bits, (50, dim)).astype(np.uint8)
    assert (k.spelled(values, k.pack(codes, bits), dim, bits) == values[codes]).all()
