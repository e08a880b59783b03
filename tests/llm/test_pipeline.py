import corpus_pipeline
import sentencepiece
from helpers import docs, prose

from trolley.llm import sentencepiece_backend


def test_stages_take_effect_in_order(spark, tmp_path):
    def text(k, n=60):
        w = prose(n, k)
        return " ".join(w[:30]) + "\n" + " ".join(w[30:])

    good = [text(k) for k in range(30)]
    junk = ["!! ".join(w.upper() for w in prose(60, 200 + k)) for k in range(20)]
    near = text(1, 60) + " tail"  # all its lines are close to those of document 1
    leak = text(77) + "\n" + " ".join(prose(12, 99, 5000))
    texts = [*good, *junk, good[3], near, leak, None, "short"]
    table = docs(spark, texts).drop("tkey", "words", "doc")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 30)) for k in range(50)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(prose(12, 99, 5000)))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "benchmark_decontamination", "tokens"]
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        left = stage(spark, left, str(tmp_path))
        assert left.columns == table.columns
        left.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
    kept = {r["doc_id"] for r in left.collect()}
    assert set(range(30)) <= kept and not kept & {50, 51, 52} and not kept & set(range(30, 50))
    rows = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == kept
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_backend.MODEL)
    assert all(rows[k] == sp.encode(good[k]) for k in range(30))


def test_empty_documents(spark, tmp_path):
    docs(spark, ["x"]).drop("tkey", "words", "doc").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
