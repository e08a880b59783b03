"""Documents whose other columns are named as what the operators use inside."""

import corpus_pipeline
import pytest
from helpers import prose
from pyspark.sql import functions as F

from trolley.llm import (decontam, langid, line_edit_dedup, line_quality, pii_tagger, quality_fm, repeated_phrases, sentencepiece_backend, simhash_blocks,
                         spelling_variants)

NAMES = ("label l_id c_id g_doc g_key id doc tkey key h at pos len lead gram window words lower hashes found ids decoded_sha256 round_trip score language place "
         "text2 chars node fp root a b n_lines n_removed n_words kept low marks host line base spans run word reduced r n blocks w v k").split()


@pytest.fixture(scope="module")
def table(spark):
    texts = [" ".join(prose(60, k)) + "\nsame line in all of these texts\n" + " ".join(prose(12, 500 + k)) for k in range(12)] + [None, "", " ".join(prose(60, 3))]
    plain = spark.createDataFrame([(k, t, "en" if k % 2 else "fr", "s", None if t is None else len(t)) for k, t in enumerate(texts)],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2)
    return plain, plain.withColumns({c: F.lit(f"own {c}") for c in NAMES})


def test_operators_read_their_columns_only(spark, table):
    plain, wide = table
    labels = spark.createDataFrame([(k, k % 2, "x", "y") for k in range(12)], "doc_id bigint, quality int, label string, l_id string")
    bench = spark.createDataFrame([(1, " ".join(prose(12, 503)), "x")], "item_id bigint, text string, doc string")

    def both(f, *columns):
        got = [sorted(map(str, f(d).select(*columns).collect())) for d in (plain, wide)]
        assert got[0] == got[1] and got[0]

    both(lambda d: quality_fm.score(d, quality_fm.fit(d, labels)), "doc_id", F.round("score", 6))
    both(lambda d: decontam.report(d, bench), "doc_id", "n_hit", "items")
    both(lambda d: decontam.decontaminate(d, bench, remove="spans"), "doc_id", "text")
    both(lambda d: langid.predict(d, langid.fit(d)), "doc_id", "language.lang_pred")
    both(line_quality.line_rules, "doc_id", "n_words", "boiler_words", "kept")
    both(lambda d: line_quality.strip_boilerplate(d, min_docs=3), "doc_id", "text")
    both(lambda d: sentencepiece_backend.encode(d, back=True), "doc_id", "ids", "round_trip")
    both(lambda d: repeated_phrases.dedup_repeats(d), "doc_id", "n_removed", "kept")
    both(lambda d: simhash_blocks.near_copies(d), "doc_id", "component_id")
    both(lambda d: line_edit_dedup.removed_lines(d), "doc", "places")
    both(lambda d: pii_tagger.find(d, None), "doc_id", "spans")
    both(spelling_variants.runs, "doc", "run")


def test_stages_pass_all_columns_on(spark, table, tmp_path):
    plain, wide = table
    spark.createDataFrame([(k, 1) for k in range(12)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(prose(12, 503)))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, narrow = wide, plain
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = []
        for kind, docs in (("wide", left), ("narrow", narrow)):
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{kind}{k}"))
            out.append(spark.read.parquet(str(tmp_path / f"{kind}{k}")))
        left, narrow = out
        assert sorted(map(str, left.select(*narrow.columns).collect())) == sorted(map(str, narrow.collect()))
        if name != "tokens":
            assert left.columns == wide.columns and all(r["n_removed"] == "own n_removed" and r["label"] == "own label" for r in left.collect())
