"""The corpus pipeline, stage by stage, against what each stage promises on its own input."""

import duckdb
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from delaylens.llm import ngram_join, quality, toxicity
from delaylens.llm.common import fold, read_table

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    from test_search_and_dedup import brute
    from test_text_operators import check_packing
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "ngram_join", "packing"]
    docs = read_table(spark, SF, "documents")
    label = {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, toxic, quality FROM read_parquet('{SF}/labels.parquet')").fetchall()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            check_packing(out.collect(), {i: exact.encode(t, add_special_tokens=False).ids + [0] for i, t in before.items()})
            continue
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in after.collect()}
        if name == "ngram_join":
            assert ids == {c for _, c, _ in brute([(i, t) for i, t in before.items()])}
        else:
            module, target = (toxicity, 0) if name == "toxicity" else (quality, 1)
            model = module.fit(docs, read_table(spark, SF, "labels"), fold(F.col("doc_id")) != 2)
            least = model.params.threshold
            want = {r.doc_id for r in module.score(docs, model).collect() if (r.score < least) == (target == 0)}
            assert ids == want
            clean = [i for i in before if i in label and label[i][target] == target]
            assert sum(i in ids for i in clean) >= 0.9 * len(clean)
        docs = after


def test_run_packs_what_the_stages_keep(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    kept = {r.doc_id for r in rows}
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert rows and kept < {r.doc_id for r in docs.select("doc_id").collect()}
    left = docs.where(docs.doc_id.isin(sorted(kept)))
    assert ngram_join.keep_one(left).count() == len(kept)


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, NULLs anywhere, repeated rows and ids, a very long text, and columns with the stages' own names."""
    good = read_table(spark, SF, "documents").where("length(text) BETWEEN 300 AND 6000").limit(400)
    extra = ["score", "key", "rep", "n", "component", "class", "first", "raw", "_raw0", "_gone0", "_place0", "keys", "node"]
    odd = spark.createDataFrame([(None, None), (None, "some words"), (-1, None), (-1, None), (-2, ""), (-3, " \n"), (-4, "long words here " * 6_000),
                                 (-5, "one text"), (-5, "another text"), (-5, "one text")], "doc_id long, text string")
    docs = good.unionByName(good.limit(5)).unionByName(odd, allowMissingColumns=True)
    for c in extra:
        docs = docs.withColumn(c, F.lit("x"))
    for name, table in (("odd", docs), ("empty", docs.limit(0))):
        folder = tmp_path / name
        table.write.parquet(f"{folder}/documents.parquet")
        read_table(spark, SF, "labels").write.parquet(f"{folder}/labels.parquet")
        before = read_table(spark, str(folder), "documents")
        for stage, fn in corpus_pipeline.STAGES:
            out = fn(spark, before, str(folder))
            if stage != "packing":
                assert out.columns == docs.columns
                out.write.parquet(f"{folder}/{stage}")
                before = spark.read.schema(out.schema).parquet(f"{folder}/{stage}")
            else:
                assert out.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        rows = corpus_pipeline.run(spark, str(folder)).count()
        assert (rows > 0) == (name == "odd")


def test_keep_one_keeps_the_odd_rows(spark):
    rows = [(None, None), (None, "w " * 9), (-1, None), (-1, None), (-2, ""), (-5, "one text"), (-5, "another text"), (-5, "one text")]
    out = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted(
        (str(i), str(t)) for i, t in [*rows[:5], (-5, "one text"), (-5, "another text")])


def test_entry_registers_all():
    names = [k for k in __spark_entry__.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
