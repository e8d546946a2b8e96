"""What the plans read and how they run."""

import io
from contextlib import redirect_stdout

import pytest

from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "name,columns",
    [("op2_quality_knn", "doc_id:bigint,text:string"), ("op3_quality_rules", "doc_id:bigint,text:string,lang:string"), ("op7_decontaminate", "doc_id:bigint,text:string"), ("op10_language_id", "doc_id:bigint,text:string,lang:string")],
)
def test_scans_read_what_is_needed_and_stay_in_arrow(spark, name, columns):
    text = plan(Q.QUERIES[name](spark, SF))
    assert f"ReadSchema: struct<{columns}>" in text
    assert "BatchEvalPython" not in text and "MapInArrow" in text


def test_filtering_needs_no_shuffle(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (C.quality, C.decontaminate):
        assert "Exchange" not in plan(stage(spark, docs, SF))


def test_temporary_tables_lie_in_the_shared_folder(spark):
    from tidemark import cluster

    path = cluster.new_path(spark, "x")
    assert path.startswith(cluster.shared_dir(spark))
    assert cluster.written(spark, spark.range(3), "y").count() == 3
