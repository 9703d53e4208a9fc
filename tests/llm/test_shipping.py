from away import run_away


def test_model_operators_run_on_bare_workers(tmp_path):
    run_away(
        tmp_path,
        """
        from sparquill.llm import ctw, jaccard_join, langid
        words = ["the cat sat on the mat again", "der hund lag vor der tuer im haus"]
        docs = spark.createDataFrame([(i, words[i % 2] + f" {i}", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
        assert langid.predict(docs, *langid.train(langid.sample(docs), steps=3)).count() == 40
        assert ctw.score(docs, ctw.training_part(docs)).count() == 40
        assert jaccard_join.join(docs).count() == 40
        """,
    )


def test_a_shared_folder_is_asked_for(tmp_path):
    run_away(
        tmp_path,
        """
        from sparquill.llm._common import stash
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        try:
            stash(spark.range(3))
        except ValueError as e:
            assert "spark.checkpoint.dir" in str(e)
        else:
            raise AssertionError("a local folder was taken")
        """,
        shared=False,
    )
