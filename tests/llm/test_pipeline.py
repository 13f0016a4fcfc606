"""The pipeline stage by stage on planted cases, and the registration of all queries."""

import random

import corpus_pipeline
from gleanery.llm import decontam, mixing, simhash, suffix_dedup, toxicity

import __spark_entry__


def plant(spark, path):
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    bad = ["wretched", "despicable", "vermin", "filthy", "moronic"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    docs, labels, bench = [], [], [(i, " ".join(text(25))) for i in range(10)]
    for i in range(600):
        body = text(rng.randint(40, 150))
        if toxic := i % 5 == 0:
            for _ in range(len(body) // 8):
                body[rng.randrange(len(body))] = rng.choice(bad)
        docs.append([i, " ".join(body)])
        labels.append((i, int(toxic)))
    docs.append([700, docs[1][1]])  # exact copy
    docs.append([701, docs[2][1] + " end"])  # near copy
    passage = " ".join(text(60))
    docs.append([702, passage + " " + " ".join(text(50))])
    docs.append([703, " ".join(text(50)) + " " + passage])
    docs.append([704, " ".join(text(20)) + " " + bench[3][1] + " " + " ".join(text(20))])
    docs += [[705, ""], [706, None], [None, " ".join(text(30))]]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return passage


def test_stages(spark, tmp_path):
    passage = plant(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert kept[-1].columns[: len(docs.columns)] == docs.columns
    gone = [ids(a) - ids(b) for a, b in zip(kept, kept[1:])]
    toxic = set(range(0, 600, 5))
    assert len(gone[0] & toxic) >= 0.9 * len(toxic) and len(gone[0] - toxic) <= 10
    assert gone[1] == {700, 701, 706} and gone[2] == set()
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    assert passage in texts[702] and passage not in texts[703] and None in texts
    assert gone[3] == {704}
    assert all(r.copies >= 1 for r in kept[5].select("copies").collect()) and 705 in gone[4]
    assert len(corpus_pipeline.STAGES) == 5


def test_stage_operators_agree(spark, tmp_path):
    """Stages decide as their operators do on the same rows."""
    plant(spark, str(tmp_path))
    docs, labels, bench = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    ids = lambda df: sorted(map(str, (r.doc_id for r in df.select("doc_id").collect())))
    assert ids(toxicity.drop_toxic(docs, labels)) == ids(toxicity.toxicity(docs, toxicity.learn(docs, labels)).where("predicted = 0"))
    named = docs.where("doc_id IS NOT NULL")
    assert ids(simhash.keep_one(named)) == ids(simhash.near_duplicates(named, width=5, radius=3).where("doc_id = component"))
    left = {r.doc_id: bytes(r["__kept"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert {r.doc_id: r.text.encode() for r in suffix_dedup.cut_repeats(docs).collect()} == left
    leaky = {r.doc_id for r in decontam.leaks(docs, bench).collect()}
    assert ids(decontam.drop_leaks(docs, bench)) == ids(docs.where(~docs.doc_id.isin(*leaky) | docs.doc_id.isNull()))
    assert ids(mixing.take_mix(docs)) == ids(mixing.mix(docs).where("taken > 0"))


def test_every_query_is_registered():
    known = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in known) == 1
    assert "pipeline" in known and set(__spark_entry__.oracle_sql()) <= set(known)


def test_run_on_its_own_output(spark, tmp_path):
    """``run`` gives the rows of its stages, leaves one folder behind, and takes its own output as documents."""
    import os

    from gleanery.session import shared_dir

    plant(spark, f"{tmp_path}/a")
    first = corpus_pipeline.run(spark, f"{tmp_path}/a")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"{tmp_path}/a")
    key = lambda df: sorted(str((r.doc_id, r.text, r.copies)) for r in df.collect())
    assert key(docs) == key(first)
    folder = os.path.dirname(first.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(folder)) == ["4"] and shared_dir(spark).removeprefix("file://") in folder
    first.write.parquet(f"{tmp_path}/b/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{table}.parquet").write.parquet(f"{tmp_path}/b/{table}.parquet")
    again = corpus_pipeline.run(spark, f"{tmp_path}/b")
    assert again.columns == first.columns and 0 < again.count() <= first.count()
