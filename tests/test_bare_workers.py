from away import run_away


def test_codecs_and_attention_run_on_bare_workers(tmp_path):
    run_away(
        tmp_path,
        """
        from pyspark.sql import functions as F
        from sparquill.operators import attention, codecs, kv, score
        from sparquill.specs import KvSpec, MseSpec, ProdSpec, ValueSpec
        df = spark.range(40).select("id", F.array(*[F.sin(F.col("id") + i).cast("float") for i in range(8)]).alias("x"))
        for spec in (MseSpec(8, 3), ProdSpec(8, 3), ValueSpec(8, 4, 4)):
            assert codecs.decode(codecs.encode(df, "x", spec), spec).where("decoded is null").count() == 0
        asked = df.where("id < 2").selectExpr("id as q_id", "x as q")
        assert score.attention_score(asked, codecs.encode(df, "x", ProdSpec(8, 3)).drop("x"), ProdSpec(8, 3)).count() == 80
        tokens = df.selectExpr("0 as kv_head", "id as token_idx", "x as key", "x as value")
        spec = KvSpec(8, 1, 3, 4, 4)
        out = attention.hybrid_attention(asked.selectExpr("cast(q_id as int) as q_token", "0 as q_head", "q"), kv.compress(tokens, spec), tokens, spec, 1)
        assert out.count() == 16
        """,
    )
