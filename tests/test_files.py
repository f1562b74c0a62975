"""Many small files as rows, annotator files of several shapes, and exports whose splits cut notes."""

import json
import pickle
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import annotations
from cohortlens.sources import annotation_files as AF
from cohortlens.sources import note_files as NF
from cohortlens.sources import readers as R

FILE = "folder string, file_name string, content string"


def files_of(path):
    return {str(p.relative_to(path)): p.read_text() for p in path.rglob("*") if p.is_file()}


def test_files_keep_their_names_and_texts(spark, tmp_path):
    rows = [("", "a_time_10:15:00.txt", "one\nline, é"), ("x/y", "b.txt", None), ("x", "c.json", "{}")] + [("n", f"{i}.txt", f"{i}") for i in range(40)]
    NF.write_files(spark.createDataFrame(rows, FILE).repartition(3), str(tmp_path / "f"))
    assert files_of(tmp_path / "f") == {"/".join(x for x in r[:2] if x): r[2] or "" for r in rows}
    back = NF.read_files(spark, str(tmp_path / "f"), part_files=7)
    assert back.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, back.collect())) == sorted((a, b, c or "") for a, b, c in rows)
    assert NF.read_files(spark, f"file:{tmp_path}/f", "*.json").collect() == [("x", "c.json", "{}")]
    assert NF.read_files(spark, str(tmp_path / "none")).count() == 0
    both = back.where(F.col("file_name").endswith(".txt")).crossJoin(back.where(F.col("file_name").endswith(".json")).select(F.col("content").alias("j")))
    assert both.count() == 42


def test_names_are_a_stream_and_go_to_few_tasks(spark, tmp_path, monkeypatch):
    path = tmp_path / "f"
    for folder in ("", "a", "a/b", "_staging-x", "c/_staging-y"):
        (path / folder).mkdir(parents=True, exist_ok=True)
        for i in range(3):
            (path / folder / f"{i}.txt").write_text(f"{folder} {i} é")
    (path / "_staging-z.txt").touch()
    (path / "far.txt").symlink_to(path / "a/1.txt")
    (path / "gone.txt").symlink_to(path / "a/none")
    (path / "1.json").touch()
    exp = {(f, f"{i}.txt", f"{f} {i} é") for f in ("", "a", "a/b", "c/_staging-y") for i in range(3)} | {("", "far.txt", "a 1 é")}
    assert sorted(NF.listed(str(path), "*.txt")) == sorted(x[:2] for x in exp)
    assert sorted(NF.listed(f"{path}/")) == sorted([x[:2] for x in exp] + [("", "1.json")])
    monkeypatch.setattr(NF, "MOST_PARTS", 3)
    back = NF.read_files(spark, str(path), "*.txt", part_files=1)
    assert back.rdd.getNumPartitions() == 4  # the session's shuffle partitions
    assert sorted(map(tuple, back.collect())) == sorted(exp)
    names = [pa.RecordBatch.from_pydict({"folder": f, "file_name": n}) for f, n in ((["a", "a"], ["0.txt", "1.txt"]), (["", "a/b"], ["1.json", "2.txt"]))]
    monkeypatch.setattr(NF, "BATCH_CHARS", 1)
    assert [b.to_pylist()[0]["content"] for b in NF._contents(str(path))(iter(names))] == ["a 0 é", "a 1 é", "", "a/b 2 é"]


def test_the_driver_holds_no_names_of_files(spark, tmp_path):
    for i in range(20_000):
        (tmp_path / f"annA_notes_empi_{i}_note_BWH_{i}_time_2014-01-02 10:15:00.txt").touch()
    assert list(NF.listed(str(tmp_path / "none"))) == []  # imports are no names
    tracemalloc.start()
    try:
        assert sum(1 for _ in NF.listed(str(tmp_path), "*.txt")) == 20_000
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()
    back = NF.read_files(spark, str(tmp_path), "*.txt")
    assert back.rdd.getNumPartitions() == 79
    # no scan whose partitions, kept by the driver, hold names
    plan = back._jdf.queryExecution().optimizedPlan()
    assert "RelationV2" not in plan.toString()
    # nor is it taken for small, which would broadcast it through the driver
    assert int(str(plan.stats().sizeInBytes())) > 1 << 40
    assert back.select("file_name").distinct().count() == 20_000


def test_overwrite_clears_only_the_folders_written(spark, tmp_path):
    def write(rows, **kw):
        NF.write_files(spark.createDataFrame(rows, FILE), str(tmp_path / "f"), **kw)
    write([("a", "1", "old"), ("a", "2", "old"), ("b", "1", "old")])
    write([("a", "1", "new")])
    assert files_of(tmp_path / "f") == {"a/1": "new", "a/2": "old", "b/1": "old"}
    write([("a", "3", "new")], overwrite=True)
    assert files_of(tmp_path / "f") == {"a/3": "new", "b/1": "old"}


@pytest.mark.parametrize("bad", [("", None, "x"), ("", "a/b", "x"), ("../up", "a", "x"), ("", "7", "again")])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    NF.write_files(spark.createDataFrame([("", "old", "old")], FILE), str(tmp_path / "f"))
    rows = [("", f"{i}", "new") for i in range(20)] + [bad]
    with pytest.raises(Exception, match="no file can be named|same folder and file name"):
        NF.write_files(spark.createDataFrame(rows, FILE).repartition(4), str(tmp_path / "f"), overwrite=True)
    assert files_of(tmp_path / "f") == {"old": "old"}
    assert [p.name for p in (tmp_path / "f").iterdir()] == ["old"]


@pytest.mark.parametrize("lists", [2, 256])
def test_a_commit_gets_lists_and_not_names(tmp_path, monkeypatch, lists):
    monkeypatch.setattr(NF, "MOST_LISTS", lists)
    monkeypatch.setattr(NF, "MOVED", 3)
    path = tmp_path / "f"
    (path / "b").mkdir(parents=True)
    (path / "b" / "old").write_text("old")

    def job(rows, tasks=5):
        w = NF.NoteFilesWriter({"path": str(path)}, True)
        return w, [w.write(iter([dict(zip(("folder", "file_name", "content"), r, strict=True)) for r in rows[i::tasks]])) for i in range(tasks)]
    rows = [(f, f"é {i}:\n.txt", f"{f}{i}") for f in ("", "a", "a/c", "b") for i in range(25)]
    w, sent = job(rows)
    assert max(len(pickle.dumps(m)) for m in sent) == max(len(pickle.dumps(m)) for m in job(rows[:5])[1])
    w.commit([*sent, None])
    assert {k: v for k, v in files_of(path).items() if not k.startswith(NF.STAGING)} == {"/".join(x for x in r[:2] if x): r[2] for r in rows}
    w, sent = job([*rows, ("a/c", "é 7:\n.txt", "again")])
    with pytest.raises(ValueError, match="same folder and file name"):
        w.commit(sent)
    assert len([k for k in files_of(path) if not k.startswith(NF.STAGING)]) == len(rows)


def test_annotator_files_of_any_shape(spark, tmp_path):
    text = "EBL: 800 cc, atony. PPH"
    name = "annA_notes_empi_{}_note_BWH_3_time_2014-01-02 10:15:00"
    usual = [{"decision": "accepted", "CUIMode": False, "labels": [{"labelId": 1, "title": "estimated blood loss", "categories": [{"type": "A"}]}],
              "spans": [{"start": 5, "end": 12}]}]
    odd = [{"decision": "accepted", "labels": [{"title": "x", "categories": ["A"]}, {"title": "y", "categories": [{"name": "B"}]}],
            "spans": [{"start": "5", "end": "12"}, {"start": 13.0, "end": 18, "note": {"deep": [1]}}, {"start": 0, "end": 1}]},
           {"labels": [{"title": "no decision", "categories": []}], "spans": [{"start": 20, "end": 23}]},
           {"decision": "accepted", "labels": "none", "spans": None}, {"decision": "rejected", "labels": [{"title": "z"}], "spans": [{}]}]
    contents = {1: json.dumps(usual), 2: json.dumps(odd), 3: "[{", 4: '{"a": 1}', 5: "[]", 6: json.dumps(usual)}
    rows = [("", name.format(i) + ".json", c) for i, c in contents.items()] + [("", name.format(i) + ".txt", text) for i in range(1, 6)]
    NF.write_files(spark.createDataFrame(rows, FILE), str(tmp_path / "f"))
    files = AF.read_annotation_files(spark, str(tmp_path / "f"))
    flat = annotations.flatten_annotations(files, ["annA"]).collect()
    assert sorted((r.EMPI, r.label_type, r.label_category, r.start, r.end, r.span) for r in flat if r.label_category) == [
        ("1", "estimated blood loss", "A", 5, 12, "800 cc"), ("2", "x", "A", 5, 12, "800 cc"), ("2", "y", "B", 13, 18, "atony")]
    assert [(r.EMPI, r.label_type, r.span) for r in flat if r.label_category is None] == [("2", "no decision", "PPH")]
    assert {r.file_name: r.reason for r in AF.unreadable_files(spark, str(tmp_path / "f")).collect()} == {
        name.format(3) + ".json": "no JSON array", name.format(4) + ".json": "no JSON array", name.format(6) + ".json": "no text"}
    assert annotations.category_violations(files).count() == 1
    assert annotations.empty_annotation_files(files).collect()[0].file_name == name.format(5) + ".json"


def test_preannotations_and_metrics_as_files(spark, tmp_path):
    notes = spark.createDataFrame([("a_10:00.txt", "EBL 800, uterine atony"), ("b.txt", "nothing"), ("c.txt", None)],
                                  "file_name string, Report_Text string")
    AF.export_preannotations(notes, str(tmp_path / "f"))
    assert files_of(tmp_path / "f") == {"a_10:00.csv": "start,end,cui\n4,7,estimated blood loss\n9,22,uterine atony\n",
                                        "b.csv": "start,end,cui\n", "c.csv": "start,end,cui\n"}
    m = spark.createDataFrame([("a/b c", 0.5, None), ("d", 1.0, 3)], "label string, acc double, n long")
    AF.write_metrics(m, str(tmp_path / "m"), "label", "run_")
    assert sorted(files_of(tmp_path / "m")) == ["run_a_b_c_metrics.json", "run_d_metrics.json"]
    assert json.loads((tmp_path / "m/run_a_b_c_metrics.json").read_text()) == {"label": "a/b c", "acc": 0.5, "n": None}
    assert AF.read_metrics(spark, str(tmp_path / "m"), "label string, acc double, n long").exceptAll(m).count() == 0


@pytest.mark.parametrize("split", [40, 100, 333, 1 << 20])
def test_notes_over_split_edges(spark, tmp_path, split):
    random.seed(split)
    d = tmp_path / "raw"
    d.mkdir()
    exp, last = {}, set()
    for f in range(2):
        lines, now = [R.NOTE_FIELDS[0] + "|x|y"], None
        lines += ["no note yet"] * (f * 2)
        for i in range(40):
            number = f"{f}-{i}"
            lines.append(f"{i}|E|BWH|M|{number}|1/2/2014 10:15:00 AM|Discharge Summary|F|DS|")
            body = ["".join(random.choices("ab |é", k=random.randint(0, 30))) for _ in range(random.choice([0, 1, 3, 12]))]
            body = [x for x in body if x.count("|") != 9]
            lines += body
            if body:
                exp[number] = " ".join(x + "\n" for x in body)
            now = number
        last.add(now)
        (d / f"{f}_Dis.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = {r.Report_Number: r.Report_Text for r in R.read_note_exports(spark, str(d)).collect()}
        fewer = {r.Report_Number for r in R.read_note_exports(spark, str(d), drop_last=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == exp
    assert fewer == set(exp) - last
