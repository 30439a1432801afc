from collections import defaultdict

import corpus_pipeline
from dropletry.llm import jaccard, lines, op02_toxicity, toxicity
from dropletry.llm.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        if k < 3:
            assert docs.columns == columns and len({r["doc_id"] for r in rows}) == len(rows) and {r["doc_id"] for r in rows} <= ids
        if k == 0:
            scored = toxicity.score(before, op02_toxicity.model(spark, FOLDER, before), score_column="p")
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in scored.collect() if r["p"] < op02_toxicity.THRESHOLD} and len(rows) > len(ids) / 2
        elif k == 1:
            wanted = {r["doc_id"]: r["text"] for r in lines.dedup(before).collect()}
            assert {r["doc_id"]: r["text"] for r in rows} == wanted and all(r["n_chars"] == len(r["text"] or "") for r in rows)
        elif k == 2:
            groups = defaultdict(set)
            for r in jaccard.classes(before).collect():
                groups[r["component"]].add(r["id"])
            assert {r["doc_id"] for r in rows} == {min(g) for g in groups.values()}
        else:
            assert rows and {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}
            used = defaultdict(int)
            for r in rows:
                used[r["sequence_id"]] += r["length"]
            assert max(used.values()) <= 4096


def test_run_equals_the_stages(spark):
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    key = lambda r: (r["doc_id"], r["start"])
    pick = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = sorted(corpus_pipeline.run(spark, FOLDER).select(pick).collect(), key=key)
    assert whole == sorted(docs.select(pick).collect(), key=key)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _toxicity double, _gone int, id int, label string"


def odd_documents(spark):
    same = "one two three four five six seven eight nine ten"
    texts = [(1, same), (2, same), (2, same), (3, None), (4, ""), (5, ""), (None, same), (6, "x " * 30_000), (7, same + " eleven"), (8, "a line of its own here\na line of its own here")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, k, -k, "l") for k, (i, t) in enumerate(texts)], SCHEMA)


def test_nulls_repeats_ties_and_clashing_names(spark):
    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, FOLDER)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in docs.collect()}
    lined = stages["line dedup"](spark, docs, FOLDER)
    rows = lined.collect()
    assert lined.columns == docs.columns and len(rows) == 10
    by = {(r["doc_id"], r["_gone"]): r["text"] for r in rows}
    assert by[1, 0] and by[2, 1] == by[2, 2] == "" and by[3, 3] is None and by[4, 4] == "" and by[None, 6] and by[8, 9] == "a line of its own here"
    near = stages["near copies"](spark, docs, FOLDER)
    assert near.columns == docs.columns and sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "3", "4", "5", "6", "8", "None"]
    packed = stages["packing"](spark, docs, FOLDER).collect()
    assert sum(r["start"] == 0 for r in packed) == 10 and all(0 < r["length"] <= 4096 for r in packed)


def test_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
