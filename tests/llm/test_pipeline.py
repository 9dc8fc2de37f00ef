"""The pipeline stage by stage on planted documents."""

import random

import corpus_pipeline


def planted():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    docs, labels = [], []
    for i in range(900):
        text = prose(rng.randint(60, 120))
        if i % 3 == 2:
            text = text.replace(" ", " scumbag ", 1 + i % 2)
        docs.append([i, text, "en", f"s{i % 4}", len(text)])
        labels.append((i, 0, int(i % 3 == 2)))
    passage = prose(70)
    for i, at in enumerate((0, 40, 81, 123)):
        docs[at][1] += " " + passage
    near = docs[6][1].split(" ")
    near[len(near) // 2] = "changed"
    docs.append([1000, " ".join(near), "en", "s1", 1])
    docs.append([1001, docs[7][1], "fr", "s2", 1])
    docs.append([1002, None, None, None, None])
    docs.append([1003, "", "en", "s0", 0])
    docs.append([1004, prose(40) + " scumbag " + prose(20), "en", "s3", 1])
    return docs, labels, passage


def test_stages(spark, tmp_path):
    docs, labels, passage = planted()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now.collect()
        assert name == "byte_bpe" or now.columns == columns
    ids = lambda name: {r.doc_id for r in kept[name]}
    toxic = {i for i in range(900) if i % 3 == 2} | {1004}
    everything = {d[0] for d in docs}
    assert ids("toxicity") == everything - toxic and {r.doc_id for r in kept["toxicity"] if r.text is None} == {1002}
    assert ids("minhash_dedup") == ids("toxicity") - {1000, 1001}
    assert ids("suffix_dedup") == ids("minhash_dedup")
    holding = {r.doc_id for r in kept["suffix_dedup"] if r.text and passage in r.text}
    assert len(holding) == 1 and holding == {0}
    assert all(r.n_chars == len(r.text or "") for r in kept["suffix_dedup"])
    sizes = {}
    for r in kept["suffix_dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    taken = {}
    for r in kept["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert sum(taken.values()) > 1.4 * sum(sizes.values()) and all(taken[s] <= 2 * sizes[s] for s in taken)
    assert len(kept["byte_bpe"]) == len(kept["mixing"])


def test_empty_documents(spark, tmp_path):
    docs, labels, _ = planted()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_stage_chains_python_processes(spark, tmp_path):
    # each would stay with its executor, beside the memory of the stages that follow
    import re

    docs, labels, _ = planted()
    spark.createDataFrame(docs[:50], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    encoded = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert len(re.findall("MapInArrow", encoded._jdf.queryExecution().executedPlan().toString())) == 1
    assert encoded.where("n_tokens > 0").count() == 50
