"""Files split inside quoted values and nested arrays give the same rows as one task that reads them whole."""

import csv
import io
import json
import random
from contextlib import contextmanager

import pytest

from clipmill import constants as K
from clipmill.sources import blocks as B
from clipmill.sources import records as Q
from clipmill.sources import sinks


@contextmanager
def block_size(spark, n):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def whole_csv(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@pytest.mark.parametrize("size", [100, 1000, 1 << 20])
@pytest.mark.parametrize("line_break", ["\n", "\r\n"])
def test_csv_blocks_equal_the_whole_file(spark, tmp_path, size, line_break):
    rnd = random.Random(7)
    values = ["", "a", "b,c", 'say "hi"', '"', '""', "two\nlines", "\n\n\n", "x" * 150, 'q"q', "line,\n\"mid\"\n,end", " pad ", "é字", None]
    for name, n in (("a.csv", 120), ("b.csv", 3), ("c.csv", 0)):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=line_break)
        w.writerow(["id", "text", "more"])
        for i in range(n):
            w.writerow([f"{name}{i}", rnd.choice(values), rnd.choice(values)])
        (tmp_path / name).write_bytes(out.getvalue().encode())
    with block_size(spark, size):
        got = Q.read_csv(spark, str(tmp_path), ["id", "text"])
        if size == 100:
            assert B.fragments(spark, str(tmp_path / "a.csv"), "\n").select("block").distinct().count() > 20
    assert got.columns == ["id", "text", "more"]
    assert bag(got) == bag(whole_csv(spark, str(tmp_path)))
    with pytest.raises(ValueError):
        Q.read_csv(spark, str(tmp_path), ["absent"])


def test_csv_with_quotes_inside_plain_values(spark, tmp_path):
    text = 'id,text\n1,ab"c\n2,"x"y,z\n3,5" by 6"\n\n4,"open\nline"\n5, "blank before"\n6,\n7,""\n'
    (tmp_path / "q.csv").write_text(text)
    with block_size(spark, 8):
        assert bag(Q.read_csv(spark, str(tmp_path), ["id"])) == bag(whole_csv(spark, str(tmp_path)))


def test_csv_states_by_brute_force():
    rnd = random.Random(1)

    def plain(state, line):
        """One character at a time: value begins, plain, quoted, quote seen."""
        at = "Q" if state else "S"
        for c in line:
            if at == "Q":
                at = "E" if c == '"' else "Q"
            elif at == "E" and c == '"':
                at = "Q"
            elif c == ",":
                at = "S"
            elif at == "S" and c == '"':
                at = "Q"
            else:
                at = "U"
        return int(at == "Q")

    for _ in range(20_000):
        line = "".join(rnd.choice('",a\r') for _ in range(rnd.randrange(12)))
        for state in (0, 1):
            assert B.csv_step(state, line)[0] == plain(state, line), (state, line)


def entries(n, seed):
    rnd = random.Random(seed)
    odd = ["}", "{", "]", "[", '"', "\\", "\\\"}", "a}{b", "é", "", "x" * 90, "\n", "},{"]
    return [{"gloss": rnd.choice(odd) + str(i), "instances": [{"video_id": f"{i}_{k}" + rnd.choice(odd), "split": rnd.choice([None, "train", "}"]), "fps": rnd.choice([25, 29.97, None])}
                                                              for k in range(rnd.randrange(4))]} for i in range(n)]


@pytest.mark.parametrize("size", [90, 700, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_blocks_equal_the_whole_file(spark, tmp_path, size, indent):
    for name, n in (("a.json", 60), ("b.json", 1), ("c.json", 0)):
        (tmp_path / name).write_text(json.dumps(entries(n, n), indent=indent, ensure_ascii=False), encoding="utf-8")
    whole = Q.flatten_metadata(spark.read.schema(K.METADATA).option("multiLine", True).json(str(tmp_path)))
    with block_size(spark, size):
        assert bag(Q.read_metadata(spark, str(tmp_path))) == bag(whole)
        if size == 90:
            assert B.fragments(spark, str(tmp_path / "a.json"), "}").select("block").distinct().count() > 20


def test_json_lines_and_single_object_are_read_too(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(json.dumps(e) for e in entries(20, 3)) + "\n")
    (tmp_path / "o.json").write_text(json.dumps(entries(1, 4)[0] | {"instances": [{"video_id": "only"}]}))
    want = Q.flatten_metadata(spark.read.schema(K.METADATA).json(str(tmp_path)))
    with block_size(spark, 60):
        assert bag(Q.read_metadata(spark, str(tmp_path))) == bag(want)


def test_metadata_is_written_as_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(e["gloss"], [{k: str(v) for k, v in i.items()} for i in e["instances"]]) for e in entries(30, 9)], K.METADATA).repartition(3)
    sinks.write_metadata(rows, str(tmp_path / "out"))
    parts = list((tmp_path / "out").glob("part-*"))
    assert sum(len(json.loads(p.read_text())) for p in parts) == 30
    assert bag(Q.read_metadata(spark, str(tmp_path / "out"))) == bag(Q.flatten_metadata(rows))
    sinks.write_metadata(rows.limit(0), str(tmp_path / "none"))
    assert Q.read_metadata(spark, str(tmp_path / "none")).count() == 0
