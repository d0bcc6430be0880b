import pandas as pd

import corpus_pipeline
from ampliflow.llm.common import materialize

GOOD = "The lake was calm this morning and we walked along it for an hour. Nobody else was there, which was nice for {}.\nLater we went home number {} and had some tea with the others who live near {}."
BAD = "tea | home | lake | {}\nTEA!! HOME!! LAKE!! {}!! NOW!! AND!! THEN!!\nlake%%% of### stars&&& {} "


def test_stages(spark, tmp_path):
    words = ["".join(chr(97 + (k * 7 + j * 5) % 26) for j in range(6)) for k in range(200)]
    docs = [(k, (GOOD if k % 4 else BAD).format(words[k], words[(k * 3) % 200], words[(k * 11) % 200]) + " " + " ".join(words[(k * 13 + j * j) % 200] for j in range(60)) * (k % 4 > 0) + "." , "en", f"s{k % 2}", 0) for k in range(120)]
    docs += [(200, docs[1][1], "en", "s", 0), (201, None, None, None, None), (202, "", "en", "s", 0), (201, None, None, None, None)]
    frame = pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"])
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), "t")
        kept[name] = now.toPandas()
        if name != "best-fit packing":
            assert tuple(now.columns) == corpus_pipeline.COLUMNS
            assert (kept[name]["text"].str.len() == kept[name]["n_chars"]).all()
    good = {k for k in range(120) if k % 4} | {200}
    assert set(kept["quality rules"]["doc_id"]) == good and set(kept["quality classifier"]["doc_id"]) == good
    assert set(kept["SimHash near-dedup"]["doc_id"]) <= good - {200} and 1 in set(kept["SimHash near-dedup"]["doc_id"])
    packed = kept["best-fit packing"]
    assert set(packed["doc_id"]) == set(kept["suffix-array dedup"]["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert frame["doc_id"].nunique() == 123
    run = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(run["ids_crc32"]) == sorted(packed["ids_crc32"])


def test_rows_without_id_and_repeated_ids_stay(spark):
    words = ["".join(chr(97 + (k * 7 + j * 5 + k * j) % 26) for j in range(6)) for k in range(300)]
    text = [" ".join(words[(k * 13 + j * j + j * k) % 300] for j in range(80)) for k in range(8)]
    rows = [(None, text[0], "en", "s", 1), (None, text[1], "en", "s", 1), (7, text[2], "en", "s", 1), (7, text[3], "en", "s", 1), (9, text[4], "en", "s", 1)]
    rows += [(None, text[4], "en", "s", 1), (8, text[4], "en", "t", 1), (8, text[4], "en", "t", 1), (None, text[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[4])], key=str)


def test_phrases_at_word_boundaries(spark):
    lines = ["You find it in our catalog in the hall.", "She wrote on her blog in the spring.", "Please log in to see more of this."]
    docs = spark.createDataFrame([(1, "\n".join([*lines, "The lake was calm this morning and we walked along it for an hour."]), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.clean_lines(spark, docs, "").first()["text"]
    assert lines[0] in kept and lines[1] in kept and lines[2] not in kept


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeats_are_removed_once_a_row(spark):
    rows = [(k, f"{k} " + " ".join(f"w{j}x{j * j}" for j in range(60)), "en", "s", 1) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_repeats(spark, docs, "")
    assert plan_of(kept).count("cleaned(") == 1
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[0] == rows[0][1]


def test_packing_gives_its_tables_without_python(spark):
    docs = spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")
    assert "ExistingRDD" not in plan_of(corpus_pipeline.pack(spark, docs, ""))
