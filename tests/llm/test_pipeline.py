"""The pipeline's stages against what each operator decides, one by one."""

import pytest

import corpus_pipeline
from tallymill.llm import exact_dedup, hd_language, parity_join, weak_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_take_effect(stages):
    decide = [
        lambda d: weak_quality.score(d).where("kept"),
        lambda d: hd_language.identify(d).where(f"lang_pred <> 'und' AND score >= {hd_language.LEAST}"),
        lambda d: exact_dedup.groups(d).where("kept"),
        lambda d: parity_join.groups(d).where("doc_id = component_id"),
    ]
    for (before, after), keep in zip(stages, decide):
        assert after.columns == before.columns and ids(after) == ids(keep(before))
    before, pieces = stages[-1]
    assert sorted({r.doc_id for r in pieces.collect()}) == ids(before)


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(stages[0][0], "doc_id").select("doc_id")
    clean, left = ids(labels), set(ids(stages[1][1]))
    assert sum(i in left for i in clean) >= 0.98 * len(clean)


def test_run(spark, stages):
    a, b = corpus_pipeline.run(spark, SF).collect(), stages[-1][1].collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in a) == sum(r.length for r in b) and {r.doc_id for r in a} == {r.doc_id for r in b} and len({*map(key, a)}) == len(a)


def test_stages_take_awkward_rows(spark, tmp_path):
    """Null and empty texts, a very long one, ties, repeats, extra columns with the operators' own names, and an empty table."""
    good = "The river runs slowly past the old mill, and nobody in the village minds the noise."
    rows = [(1, good), (1, good), (2, good + " "), (3, None), (4, ""), (5, " \n"), (6, good + " It never did."), (None, good), (7, "word " * 100_000), (8, "!!! ||| $$$ " * 50)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, row long, _n long, _kept string, _sha string, kept string, h long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "a", "b", "c", 3) for i, t in rows], columns)
    for which, table in enumerate((docs, docs.limit(0))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{which}-{k}")
            stage(spark, table, SF).write.parquet(path)
            out = spark.read.parquet(path)
            if name != "packing":
                assert out.columns == docs.columns
            table = out
            if name == "quality classifier" and out.count():
                assert {1, 2, 6, None} <= {r.doc_id for r in out.collect()} and not {3, 4, 5, 8} & {r.doc_id for r in out.collect()}
            if name == "exact dedup" and out.count():
                assert [r.doc_id for r in out.collect() if r.text and r.text.strip() == good].count(1) == 1 and 2 in {r.doc_id for r in out.collect()}
