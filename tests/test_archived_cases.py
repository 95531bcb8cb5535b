"""Cases that are stored as archives: the files of the folders on a fraction of their disk, from rows that are shuffled once and narrow."""

import glob
import json
import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from causeway.plans import records, views
from causeway.sources import case_store


def parts(spark, ids, rows=3, version="1.0.0"):
    lines = spark.createDataFrame([(i, f"r{k:04}", 'é "x"', "node.event." + str(k)) for i in ids for k in range(rows)], "case_id string, relation_id string, note string, source_ref string")
    docs = spark.createDataFrame([(i, version) for i in ids], "case_id string, version string")
    return [case_store.as_records("relations", lines, "relation_id"), *[case_store.as_records(e, docs) for e in case_store.REQUIRED]]


def on_disk(root):
    found = [f for f in glob.glob(f"{root}/**", recursive=True) if "_staging" not in f]
    return sum(os.stat(f).st_blocks * 512 for f in found), len(found)


def test_an_archive_holds_the_files_of_the_folder_and_reads_alike(spark, tmp_path):
    ids, roots = ["a/b", "ü 1", "c"], {form: str(tmp_path / form) for form in case_store.FORMS}
    for form, root in roots.items():
        case_store.save_cases(parts(spark, ids), root, form=form)
    for name in (case_store.quote(i, safe="") + ".case" for i in ids):
        with zipfile.ZipFile(f"{roots['archives']}/{name}") as archive:
            assert archive.testzip() is None and len(archive.namelist()) == 6
            for path in archive.namelist():
                assert archive.read(path) == open(f"{roots['folders']}/{name}/{path}", "rb").read()
    assert sorted(os.listdir(roots["archives"])) == sorted(os.listdir(roots["folders"])) and not os.listdir(f"{roots['archives']}/_staging")
    for detail in case_store.DETAILS:
        a, b = (sorted(map(tuple, case_store.scan(spark, root, detail=detail).collect()), key=str) for root in roots.values())
        assert a == b and a
    case_store.save_cases(parts(spark, ids), str(tmp_path / "again"), form="archives")
    assert open(tmp_path / "again" / "c.case", "rb").read() == open(f"{roots['archives']}/c.case", "rb").read()


def test_archives_take_a_fraction_of_the_disk(spark, tmp_path):
    for form in case_store.FORMS:
        case_store.save_cases(parts(spark, [f"c{i}" for i in range(20)], 200), str(tmp_path / form), form=form)
    (folders, many), (archives, few) = (on_disk(tmp_path / form) for form in case_store.FORMS)
    assert few == 21 < many / 5 and archives < folders / 4


def test_forms_live_side_by_side_and_are_overwritten(spark, tmp_path):
    root = str(tmp_path / "store")
    case_store.save_cases(parts(spark, ["old"]), root)
    case_store.save_cases(parts(spark, ["new"], 4), root, form="archives")
    assert {r.case_id: r.relations for r in case_store.load_cases(spark, root).collect()} == {"old": 3, "new": 4}
    for form in case_store.FORMS:
        with pytest.raises(Exception, match="stored already"):
            case_store.save_cases(parts(spark, ["old" if form == "archives" else "new"]), root, form=form)
    case_store.save_cases(parts(spark, ["x"]), root, "overwrite", "archives")
    assert sorted(os.listdir(root)) == ["_staging", "x.case"]
    with pytest.raises(Exception, match="unknown form"):
        case_store.save_cases(parts(spark, ["y"]), root, form="tar")


def test_a_damaged_archive_is_a_row_with_a_problem(spark, tmp_path):
    root = str(tmp_path / "store")
    case_store.save_cases(parts(spark, ["cut", "flipped", "good", "lacking"], 400), root, form="archives")
    whole = open(f"{root}/cut.case", "rb").read()
    open(f"{root}/cut.case", "wb").write(whole[: len(whole) // 2])
    with zipfile.ZipFile(f"{root}/flipped.case") as archive:
        entry = archive.getinfo("model/relations.jsonl")
    whole = bytearray(open(f"{root}/flipped.case", "rb").read())
    whole[entry.header_offset + 200] ^= 0xFF
    open(f"{root}/flipped.case", "wb").write(whole)
    with zipfile.ZipFile(f"{root}/lacking.case", "w") as archive:
        for entity in ("case", "system", "execution"):
            archive.writestr(case_store.FILES[entity], "{}\n" if entity != "case" else "{")
    cases = {r.case_id: r for r in case_store.load_cases(spark, root).collect()}
    assert cases["good"].problems == [] and cases["good"].relations == 400
    assert cases["cut"].problems == ["cut.case: BadZipFile"] and cases["cut"].manifest is None
    assert len(cases["flipped"].problems) > 0 and all(p.startswith("model/relations.jsonl:") for p in cases["flipped"].problems) and json.loads(cases["flipped"].manifest) == {"version": "1.0.0"}
    assert cases["lacking"].problems == ["missing: manifest.json", "specification/case.json:1: JSONDecodeError"]
    found = {r.case_id: r.problem for r in case_store.catalogue(spark, root).collect()}
    assert found == {"cut": "cut.case: BadZipFile", "flipped": None, "good": None, "lacking": "missing: manifest.json"}
    with pytest.raises(Exception, match="BadZipFile"):
        case_store.content_index(spark, root).collect()


def test_dealt_tables_are_the_tables(spark, sf_dir):
    plain, dealt = views.tables(spark, sf_dir), views.dealt_tables(spark, sf_dir)
    for name, rows in plain.items():
        assert dealt[name].schema == rows.schema
        mine, theirs = (df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("r")) for df in (dealt[name], rows))
        assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()


def test_records_of_dealt_tables_are_not_shuffled(spark, sf_dir):
    rows = case_store.by_case(records._case_parts(views.dealt_tables(spark, sf_dir)))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" not in plan[: plan.index("Union")]
    for entity in ("nodes", "contexts", "relations"):  # windows by case stay in the task too: one exchange below each
        [mine] = [p for p in re.split(r"(?=\b\w+ AS entity#)", plan) if p.startswith(f"{entity} AS entity#")]
        assert mine.count("Exchange hashpartitioning") == 1 and mine.count("Window") >= 1
    where = rows.select("case_id", F.spark_partition_id().alias("p")).distinct().groupBy("case_id").count()
    assert where.agg(F.max("count")).first()[0] == 1


def test_records_that_are_taken_as_they_are_are_canonical(spark, tmp_path):
    odd = ["", None, '"', "\\", "\\u001f", "/", "\u2028\u2029\u007f\u0085\ufeff\ufffe", "😀é", *map(chr, range(32))]
    rows = spark.createDataFrame(
        [("c", f"{i:03}", t, -(2**63) + i, None if i % 2 else 2**31 - 1, i % 3 == 0, [t, "x"] if i % 5 else [], [[i]]) for i, t in enumerate(odd)],
        "case_id string, id string, `Z text` string, a long, `é` int, b boolean, list array<string>, deep array<array<int>>")
    other = rows.select("case_id", "id", F.lit(1e20).alias("d"), F.struct(F.lit(1).alias("z"), F.lit(2).alias("a")).alias("s"), F.lit("1.50").cast("decimal(5,2)").alias("n"))
    parts = {"nodes": case_store.as_records("nodes", rows, "id"), "effects": case_store.as_records("effects", other, "id")}
    assert {e: {r.canonical for r in df.collect()} for e, df in parts.items()} == {"nodes": {True}, "effects": {False}}
    anew = {e: df.drop("canonical") for e, df in parts.items()}
    for name, those in {"mixed": parts, "anew": anew, "some": {"nodes": parts["nodes"], "effects": anew["effects"]}}.items():
        case_store.save_cases(list(those.values()), str(tmp_path / name))
    for entity in parts:
        want = "".join(case_store.canonical(json.loads(r.record)) for r in parts[entity].orderBy("key").collect()).encode()
        for name in ("mixed", "anew", "some"):
            assert open(tmp_path / name / "c.case" / case_store.FILES[entity], "rb").read() == want
