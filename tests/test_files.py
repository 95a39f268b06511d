"""Logs in and results out."""

from driftwise.sources import files


def test_a_log_is_read_past_a_half_written_line(spark, tmp_path):
    log = tmp_path / "feedback.jsonl"
    log.write_text('{"feedback_id": "1", "judgement": "confirmed", "movement_inr": 2.5}\n'
                   '{"feedback_id": "2", "judgement": "wrong_cause", "learnable": true}\n'
                   '{"feedback_id": "3", "judg')
    rows = files.read_log(spark, str(log), files.FEEDBACK).orderBy("feedback_id").collect()
    assert [(r.feedback_id, r.judgement, r.movement_inr) for r in rows] == [
        ("1", "confirmed", 2.5), ("2", "wrong_cause", None)]


def test_rows_survive_csv_and_json(spark, tmp_path):
    frame = spark.createDataFrame([("2024-01-01", 1.5, True)], "ts string, value double, in_window boolean")
    files.write_csv(frame, str(tmp_path / "rows"))
    back = spark.read.schema(frame.schema).option("header", True).csv(str(tmp_path / "rows"))
    assert back.exceptAll(frame).count() == 0 and back.count() == 1
    files.write_report(frame, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_evidence_is_appended_by_run(spark, tmp_path):
    frame = spark.createDataFrame([("a",)], "evidence_id string")
    for run in ("r1", "r2"):
        files.append_evidence(frame, str(tmp_path / "ev"), run)
    held = spark.read.parquet(str(tmp_path / "ev"))
    assert {(r.evidence_id, r.run_id) for r in held.collect()} == {("a", "r1"), ("a", "r2")}
