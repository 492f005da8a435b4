"""The pipeline's stages on a small table: each decision takes effect, nothing else goes."""

import corpus_pipeline
from cloakwork.llm import decontaminate, importance, simhash, tokens
from cloakwork.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, bench = docs.columns, table(spark, SF, "benchmark")
    kept = {0: {r.doc_id for r in importance.classify(docs, table(spark, SF, "labels"), importance.Settings(reject_toxic=True)).filter("kept").collect()}}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{i}")
            before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            if i == 1:
                kept[1] = {r.component_id for r in simhash.classes(before).collect()}
            elif i == 2:
                kept[2] = {r.doc_id for r in decontaminate.report(before, bench).filter("not contaminated").collect()}
            assert len(ids) == len(set(ids)) and set(ids) == (kept[i] if i in kept else kept[2])
        else:
            rows = sorted(out.collect(), key=lambda r: r.start)
            placed = docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
            assert [r.doc_id for r in rows] == [r.doc_id for r in sorted(placed, key=lambda r: (r.file_name, r.row_index))]
            plain = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.report(docs, tokens.Settings(tokens.default_tokenizer())).collect()}
            assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows} == plain
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
