"""Pipeline stages on documents whose other columns are named like the stages' own."""

import pytest

import corpus_pipeline
from greenlattice.llm.common import column_safe, release

CLASHING = ["_lang", "_raw", "_counts", "_failed", "_kept", "_rules", "_row", "_spans", "_secrets_key", "_nd_text", "_nd_id", "_nd_tkey",
            "_dc_text", "_dc_id", "_dc_tkey", "component_id", "n", "given1", "_source", "kept"]
PROSE = " ".join(f"word{i} lies{i * 7 % 13} here{i * 3 % 11}" for i in range(40))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_leave_other_columns_alone(spark, name, stage):
    rows = [(i, f"{PROSE} number{i * 31 % 17} tail{i}" * (i % 2 + 1), "en", "s", 10, *[f"{c}-{i}" for c in CLASHING]) for i in range(6)]
    rows += [(50, None, None, None, None, *[None] * len(CLASHING)), (51, "", "en", "s", 0, *["x"] * len(CLASHING))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all(r[c] in (None, "x", f"{c}-{r['doc_id']}") for r in found for c in CLASHING)


def test_column_safe_restores_order_and_names(spark):
    docs = spark.createDataFrame([("p", 1, "t")], "b string, doc_id long, text string")
    seen = []
    stage = column_safe(lambda spark, docs, sf_dir: seen.append(docs.columns) or docs.select("text", "doc_id", "given0"))
    assert tuple(stage(spark, docs, "").first()) == ("p", 1, "t") and seen == [["given0", "doc_id", "text"]]
    release()
