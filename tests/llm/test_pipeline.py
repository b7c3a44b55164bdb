"""The stages together, against the stages' own brute-force versions where there are any."""

import corpus_pipeline
from netfell.llm import quality
from netfell.tables import table
from tests.llm.test_duplicates import jaccard_brute, passages_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(d.columns == columns for d in kept[:-1])
    rows = [[tuple(r) for r in d.select(columns).collect()] for d in kept[:-1]]
    ids = [{r[0] for r in own} for own in rows]
    judged = {r.doc_id for r in quality.judge(kept[1]).where("kept").collect()}
    assert ids[2] == judged
    single = {int(d) for d, _, c in jaccard_brute(rows[2], corpus_pipeline.WIDTH, corpus_pipeline.PERCENT) if int(d) == c}
    assert ids[3] == single
    want = {d: text for d, text, *_ in passages_brute(rows[3])}
    at = columns.index("text"), columns.index("n_chars")
    assert {str(r[0]): r[at[0]] for r in rows[4]} == want and all(r[at[1]] == len(r[at[0]]) for r in rows[4])
    assert {r.doc_id for r in kept[5].select("doc_id").collect()} == ids[4]
    assert corpus_pipeline.run(spark, SF).count() == kept[5].count()


def test_clean_documents_stay(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").where("quality = 1")
    after = corpus_pipeline.language(spark, docs, SF)
    assert after.join(labels, "doc_id").count() == docs.join(labels, "doc_id").count()
