"""IO1/IO5/IO11 readers on small hand-written exports (fixed inputs, expected values by hand)."""

import json

from cohortlens.operators import annotations as A
from cohortlens.sources import annotation_files as AF
from cohortlens.sources import readers as R

HEADER = "EMPI|EPIC_PMRN|MRN_Type|MRN|Report_Number|Report_Date_Time|Report_Description|Report_Status|Report_Type|Report_Text"


def _note(empi, rn, ts):
    return f"{empi}|E{empi}|BWH|M{empi}|BWH/{rn}|{ts}|Discharge Summary|F|DS|"


def test_multiline_notes(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "a_Dis.txt").write_text("\n".join([
        HEADER, _note(1, 10, "1/2/2014 10:15:00 AM"), "first line", "second | line",
        _note(2, 11, "3/4/2014"), "x|y|z body with pipes", _note(3, 12, "3/5/2014"), _note(4, 13, "3/6/2014"), "tail"]) + "\n")
    (d / "b_Dem.txt").write_text("EMPI|Sex\n1|F\n")
    rows = {r.EMPI: r for r in R.read_note_exports(spark.getActiveSession() or spark, str(d)).collect()}
    assert sorted(rows) == ["1", "2", "4"]          # note 3 has no body lines
    assert rows["1"].Report_Text == "first line\n second | line\n"
    assert rows["2"].Report_Text == "x|y|z body with pipes\n"
    assert rows["4"].Report_Text == "tail\n"          # last note of the file is kept
    last_dropped = R.read_note_exports(spark, str(d), drop_last=True).collect()
    assert sorted(r.EMPI for r in last_dropped) == ["1", "2"]
    n = R.read_notes(spark, str(d)).collect()
    assert {str(r.Report_Date_Time) for r in n} == {"2014-01-02 10:15:00", "2014-03-04 00:00:00", "2014-03-06 00:00:00"}


def test_diagnoses_keep_code_text(spark, tmp_path):
    d = tmp_path / "dx"
    d.mkdir()
    (d / "x_Dia.txt").write_text("EMPI|Date|Diagnosis_Name|Code_Type|Code|Diagnosis_Flag|Inpatient_Outpatient|Encounter_number\n"
                                 "1|1/2/2014|PPH|ICD9|666.20|P|Inpatient|9\n2|6/2/2015|PPH|ICD9|666.1|P|Inpatient|8\n")
    rows = R.read_diagnoses(spark, str(d)).collect()
    assert [(r.EMPI, r.Code, r.Name) for r in rows] == [("1", "666.20", "PPH")]


def test_annotation_files(spark, tmp_path):
    d = tmp_path / "ann"
    d.mkdir()
    name = "annA_notes_empi_7_note_BWH_3_time_2014-01-02 10:15:00"
    text = "EBL: 800 cc, atony."
    (d / f"{name}.txt").write_text(text)
    recs = [{"decision": "accepted", "CUIMode": False, "experimentMode": False,
             "labels": [{"labelId": 1, "title": "estimated blood loss", "categories": [{"type": "PPH Definiton"}]}],
             "spans": [{"start": 5, "end": 12}]},
            {"decision": "rejected", "CUIMode": False, "experimentMode": False,
             "labels": [{"labelId": 2, "title": "uterine atony", "categories": [{"type": "Problem"}]}],
             "spans": [{"start": 14, "end": 19}]}]
    (d / f"{name}.json").write_text(json.dumps(recs))
    files = AF.read_annotation_files(spark, str(d))
    flat = A.flatten_annotations(files, ["annA", "annB"]).collect()
    assert len(flat) == 1
    r = flat[0]
    assert (r.EMPI, r.Report_Number, r.label_type, r.label_category, r.span, r.annotator) == \
        ("7", "BWH_3", "estimated blood loss", "PPH Definiton", "800 cc", "annA")
    assert str(r.Report_Date_Time) == "2014-01-02 10:15:00"


def test_note_exports_are_sorted_by_empi(spark, tmp_path):
    from datetime import datetime

    from cohortlens.sources import readers

    rows = [(str(1000 + i * 37 % 101), "1", "MGB", "2", str(i), datetime(2020, 1, 1), "d", "Final", "DIS", f"text {i}")
            for i in range(300)]
    types = ", ".join(f"{f} {'timestamp' if f == 'Report_Date_Time' else 'string'}" for f in readers.NOTE_FIELDS)
    readers.write_note_exports(spark.createDataFrame(rows, types).repartition(4), str(tmp_path / "notes"))
    heads = [line.split("|") for file in sorted((tmp_path / "notes").glob("part-*"))
             for line in file.read_text().splitlines() if line.count("|") == 9 and not line.startswith("EMPI")]
    empi = [h[0] for h in heads]
    assert empi == sorted(empi) and sorted(h[4] for h in heads) == sorted(r[4] for r in rows)
