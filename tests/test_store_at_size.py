"""Work on stored cases that must not grow faster than their number."""

import os

from causeway.sources import case_store


def test_a_store_of_many_cases_is_read_by_a_bounded_number_of_tasks(tmp_path):
    for i in range(3000):
        os.mkdir(tmp_path / f"c{i}.case")
    parts = case_store.CaseReader({"path": str(tmp_path)}).partitions()
    assert len(parts) <= case_store.PARTITIONS and sorted(n for p in parts for n in p.names) == sorted(f"c{i}.case" for i in range(3000))


def test_small_records_are_dealt_to_all_tasks(spark, tmp_path):
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        docs = spark.range(200).selectExpr("concat('c', id) AS case_id", "'1' AS version")
        case_store.save_cases([case_store.as_records("manifest", docs)], str(tmp_path / "store"))
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(None) for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    assert max((s.stageId, s.numTasks) for s in stages if s)[1] == 6
    assert case_store.catalogue(spark, str(tmp_path / "store")).count() == 200


def test_counts_and_digests_take_a_row_a_file(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.range(50).selectExpr("'c' AS case_id", "cast(id AS string) AS relation_id")
    case_store.save_cases([case_store.as_records("relations", rows, "relation_id")], root)
    open(f"{root}/c.case/model/relations.jsonl", "a").write("no json\n")
    counts = [(r.line, r.problem) for r in case_store.scan(spark, root, "relations", detail="counts").collect()]
    assert sorted(counts) == [(50, None), (51, "model/relations.jsonl:51: JSONDecodeError")]
    assert case_store.load_cases(spark, root).first().relations == 50
    digests = case_store.scan(spark, root, detail="digests").collect()
    assert [(r.entity, r.line) for r in digests] == [("relations", os.path.getsize(f"{root}/c.case/model/relations.jsonl"))]
