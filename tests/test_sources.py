import json
import os

import pytest

from clipmill.session import require_empty
from clipmill.sources import media as E
from clipmill.sources import records as Q
from clipmill.sources.lines import read_lines
from clipmill.operators import labels as L
from clipmill.operators import gates as G


def test_metadata_file(spark, tmp_path):
    doc = [{"gloss": "hello", "instances": [{"video_id": "001", "split": "train", "signer_id": 3, "fps": 25}, {"video_id": "002", "signer_id": None}]}]
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    flat = Q.read_metadata(spark, str(tmp_path / "m.json"))
    rows = sorted(Q.cast_metadata(flat).collect(), key=lambda r: r.sample_id)
    assert [(r.sample_id, r.split, r.signer_id, r.fps) for r in rows] == [("hello_001", "train", 3, 25.0), ("hello_002", "unspecified", None, None)]
    assert [(r.key, r.detail) for r in Q.validate_official_split(flat).collect()] == [("hello_002", "unspecified")]


def test_lines_across_blocks_and_files(spark, tmp_path):
    for name, n in (("a.jsonl", 500), ("b.jsonl", 30)):
        (tmp_path / name).write_text("".join("\n" if i % 10 == 3 else f"{name}-{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = read_lines(spark, str(tmp_path))
        assert df.select("path").distinct().count() == 2
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 477 and all(r.value == f"{os.path.basename(r.path)}-{r.line_no - 1}" for r in rows)


def test_jsonl_faults_and_head(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"instruction":"i","input":"a","output":"x"}\n\n{bad\n[1]\n{"input":"b"}\n')
    good, bad = Q.read_records_jsonl(spark, str(p))
    assert sorted((r.line_no, r.input, r.output) for r in good.collect()) == [(1, "a", "x"), (5, "b", None)]
    assert sorted((r.key, r.rule) for r in bad.collect()) == [("r.jsonl:3", "not_json"), ("r.jsonl:4", "not_an_object")]
    good, bad = Q.read_records_jsonl(spark, str(p), max_samples=1)
    assert good.count() == 1 and bad.count() == 0
    with pytest.raises(ValueError):
        require_empty(Q.read_records_jsonl(spark, str(p))[1])


def test_contracts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"version": "v1", "glosses": ["b", "a", "a"]}))
    (tmp_path / "m.json").write_text(json.dumps({"labels": ["x", "y"]}))
    (tmp_path / "l.txt").write_text("one\ntwo\n")
    assert L.label_list(Q.read_label_contract(spark, str(tmp_path / "c.json"))) == ["b", "a", "a"]
    assert L.label_list(Q.read_label_contract(spark, str(tmp_path / "m.json"))) == ["x", "y"]
    assert L.label_list(Q.read_label_contract(spark, str(tmp_path / "l.txt"))) == ["one", "two"]
    rules = {r.rule for r in L.contract_checks(Q.read_label_contract(spark, str(tmp_path / "c.json")), 3).collect()}
    assert rules == {"unique"}
    clash = spark.createDataFrame([("Thank You!",), ("thank you",), ("no",)], "x string")
    assert {r.original for r in L.label_collisions(clash, "x").collect()} == {"Thank You!", "thank you"}


def test_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('index,sample_id,expected_gloss,predicted_gloss,raw_model_output,valid_label,correct,mode\n0,a,x,x,"two\nlines ""q""",True,maybe,real\n')
    rows, bad = Q.read_predictions_csv(spark, str(tmp_path / "p.csv"))
    r = rows.first()
    assert (r["index"], r.raw_model_output, r.valid_label, r.correct) == (0, 'two\nlines "q"', True, None)
    assert [(b.key, b.detail) for b in bad.collect()] == [("a", "correct=maybe")]
    with pytest.raises(ValueError):
        Q.read_gate_csv(spark, str(tmp_path / "p.csv"))
    (tmp_path / "e.csv").write_text("filename,expected_label\nd/a.mp4,Hello\na.mp4,No!\nb.mp4, !\n")
    assert [tuple(r) for r in Q.read_expected_labels(spark, str(tmp_path / "e.csv")).collect()] == [("a.mp4", "no")]


def test_media(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("B.MP4", "in/a.mov", "c.txt", "in/.mp4"):
        (tmp_path / n).write_bytes(b"12")
    rows = E.in_name_order(E.list_media(spark, str(tmp_path))).collect()
    assert [(r.name, r.length) for r in rows] == [("a.mov", 2), ("B.MP4", 2)]


def test_identity(spark):
    df = spark.createDataFrame([(0, "a ", "x"), (1, "a", "y"), (2, " ", "z")], "index bigint, sample_id string, expected_gloss string")
    assert {(r.rule, r.key) for r in G.identity_violations(Q.identity_rows(df)).collect()} == {("duplicate_sample_id", "a"), ("empty_sample_id", "")}
