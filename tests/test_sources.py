"""S1-S8 on files generated in a fresh temp directory."""

import json
import os
import tempfile

import pytest

from tidemark.sources import files as S


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="tidemark-src-")


def _write(path, text, enc="utf-8"):
    with open(path, "w", encoding=enc, newline="") as fh:
        fh.write(text)
    return path


def test_csv_overflow_rows_skipped_short_rows_padded(spark, tmp):
    p = _write(os.path.join(tmp, "a.csv"), "id,tenure,charge\n1,10,5\n2,20,6,EXTRA\n3,30\n4,40,8\n")
    df = S.read_table(spark, p, lineage="core")
    rows = sorted(tuple(r) for r in df.collect())
    assert df.columns == ["id", "tenure", "charge"]
    assert rows == [("1", "10", "5"), ("3", "30", None), ("4", "40", "8")]


@pytest.mark.parametrize("sep", [";", "\t", "|"])
def test_delimiter_trial(spark, tmp, sep):
    text = sep.join(["a", "b", "c"]) + "\n" + sep.join(["1", "10", "5"]) + "\n"
    p = _write(os.path.join(tmp, "b.txt"), text)
    df = S.read_table(spark, p, lineage="core")
    assert df.columns == ["a", "b", "c"] and df.count() == 1


def test_delimiter_by_count():
    assert S.pick_delimiter_by_count("a;b;c\n1;2;3\n") == ";"
    assert S.pick_delimiter_by_count("abc") == ","


def test_encoding_fallback_latin1(spark, tmp):
    p = os.path.join(tmp, "c.csv")
    with open(p, "wb") as fh:
        fh.write("name,charge\nJosé,5\nZoë,6\n".encode("latin1"))
    df = S.read_table(spark, p, lineage="core")
    assert sorted(r[0] for r in df.collect()) == ["José", "Zoë"]


def test_bom_stripped(spark, tmp):
    p = _write(os.path.join(tmp, "d.csv"), "customerID,tenure\nA,1\nB,2\n", enc="utf-8-sig")
    assert S.read_table(spark, p, lineage="core").columns == ["customerID", "tenure"]


def test_headerless_first_name(spark, tmp):
    p = _write(os.path.join(tmp, "e.csv"), ",tenure,charge\n1,10,5\n2,11,6\n")
    assert S.read_table(spark, p, lineage="core").columns[0] == "Unnamed: 0"
    assert S.read_table(spark, p, lineage="adaptive").columns[0] == "nan"


def test_json_shapes(spark, tmp):
    recs = [{"id": 1, "tenure": 5}, {"id": 2, "tenure": 7}]
    p1 = _write(os.path.join(tmp, "r.json"), json.dumps(recs))
    p2 = _write(os.path.join(tmp, "l.json"), "\n".join(json.dumps(r) for r in recs) + "\n")
    p3 = _write(os.path.join(tmp, "d.json"), json.dumps({"id": [1, 2], "tenure": [5, 7]}))
    p4 = _write(os.path.join(tmp, "s.json"), json.dumps({"id": 1, "tenure": 5}))
    p5 = _write(os.path.join(tmp, "v.json"), json.dumps([3, 4, 5, 6]))
    for p in (p1, p2, p3):
        df = S.read_table(spark, p)
        assert sorted((int(r["id"]), int(r["tenure"])) for r in df.collect()) == [(1, 5), (2, 7)]
    assert S.read_table(spark, p4).count() == 1
    df5 = S.read_table(spark, p5)
    assert df5.columns == ["value"] and sorted(int(r[0]) for r in df5.collect()) == [3, 4, 5, 6]


def test_parquet_as_text_keeps_null(spark, tmp):
    p = os.path.join(tmp, "p.parquet")
    spark.createDataFrame([(1, 2.5), (2, None)], "id long, x double").write.parquet(p)
    df = S.read_table(spark, p)
    assert dict(df.dtypes) == {"id": "string", "x": "string"}
    assert sorted((r["id"], r["x"]) for r in df.collect()) == [("1", "2.5"), ("2", None)]


def test_refuses_tiny_and_missing(spark, tmp):
    with pytest.raises(ValueError):
        S.read_table(spark, _write(os.path.join(tmp, "t.csv"), "a,b\n"))
    with pytest.raises(ValueError):
        S.read_table(spark, _write(os.path.join(tmp, "z.csv"), ""))
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, os.path.join(tmp, "missing.csv"))


def test_quoted_newlines(spark, tmp):
    p = _write(os.path.join(tmp, "q.csv"), 'id,note,charge\n1,"two\nlines",5\n2,plain,6\n')
    df = S.read_table(spark, p, lineage="core")
    assert sorted((r["id"], r["note"]) for r in df.collect()) == [("1", "two\nlines"), ("2", "plain")]


def test_doubled_quotes_and_empty_surplus_fields(spark, tmp):
    p = _write(os.path.join(tmp, "dq.csv"), 'id,note,charge\n1,"say ""hi"", twice",5\n2,20,6,\n3,30,7,,X\n4,"a,b",8\n5,"x""y",9\n6\n')
    rows = sorted(tuple(r) for r in S.read_table(spark, p, lineage="core").collect())
    assert rows == [("1", 'say "hi", twice', "5"), ("4", "a,b", "8"), ("5", 'x"y', "9"), ("6", None, None)]
    assert S.read_table(spark, p, lineage="core").select("id").count() == 4  # also when columns are pruned


def test_missing_value_texts_are_null(spark, tmp):
    p = _write(os.path.join(tmp, "na.csv"), 'id,a,b\n1,NA,5\n2,null,"N/A"\n3,None,x\n4,nan ,NULL\n')
    rows = sorted(tuple(r) for r in S.read_table(spark, p, lineage="core").collect())
    assert rows == [("1", None, "5"), ("2", None, None), ("3", None, "x"), ("4", "nan ", None)]


def test_late_bytes_quotes_and_long_headers(spark, tmp):
    many = "".join(f"{i},plain,{i}\n" for i in range(9000))
    p = os.path.join(tmp, "late.csv")
    with open(p, "wb") as fh:
        fh.write(("id,name,charge\n" + many).encode() + "9000,José,1\n".encode("latin1"))
    got = S.read_table(spark, p, lineage="core")
    assert got.count() == 9001 and got.filter("id = '9000'").first()["name"] == "José"
    q = _write(os.path.join(tmp, "latequote.csv"), "id,name,charge\n" + many + '9000,"two\nlines",1\n')
    assert S.read_table(spark, q, lineage="core").count() == 9001
    names = [f"a_rather_long_column_name_number_{i:05d}_to_pass_the_first_64_kilobytes" for i in range(1200)]
    w = _write(os.path.join(tmp, "wide.csv"), ",".join(names) + "\n" + (",".join(["1"] * 1200) + "\n") * 3)
    wide = S.read_table(spark, w, lineage="core")
    assert wide.columns == names and wide.count() == 3


def test_json_lines_with_a_long_first_record(spark, tmp):
    p = _write(os.path.join(tmp, "long.json"), "\n".join([json.dumps({"id": 0, "t": "x" * 70_000})] + [json.dumps({"id": i, "t": "y"}) for i in range(1, 5)]))
    assert S.read_table(spark, p).count() == 5
    pretty = _write(os.path.join(tmp, "pretty.json"), json.dumps({"id": [1, 2], "x": [3, 4]}, indent=2))
    assert S.read_table(spark, pretty).count() == 2
    listed = _write(os.path.join(tmp, "list.json"), json.dumps([{"id": 1}, {"id": 2}], indent=1))
    assert S.read_table(spark, listed).count() == 2


def test_folders_and_plain_doubles(spark, tmp):
    p = os.path.join(tmp, "folder.parquet")
    v = [12345678.0, 1e16, 1.5e-5, 0.00012, -98765432.125, 0.1, 1e15, 123456789012345.6]
    spark.createDataFrame([(x,) for x in v], "x double").repartition(3).write.parquet(p)
    assert sorted(r.x for r in S.read_table(spark, p).collect()) == sorted(map(repr, v))
    c = os.path.join(tmp, "folder_csv")
    spark.range(10).selectExpr("id", "id * 2 as y").repartition(2).write.option("header", True).csv(c)
    assert S.read_table(spark, c, lineage="core").count() == 10


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_line_feeds_across_splits(spark, tmp, small_splits):
    import csv as pycsv
    rows = [[str(i), ("a\nb, \"q\"\n" * (i % 40)) + f"end {i}", "x" if i % 3 else 'pipe 5" wide'] for i in range(300)]
    rows[7][1], rows[8][1] = "\n" * 3000, "long " * 900
    with open(p := os.path.join(tmp, "q.csv"), "w", newline="") as fh:
        w = pycsv.writer(fh, lineterminator="\n")
        w.writerow(["id", "text", "kind"])
        w.writerows(rows[:150])
        for r in rows[150:]:  # quotes inside an unquoted field open nothing
            fh.write(f'{r[0]},"{r[1].replace(chr(34), chr(34) * 2)}",{r[2]}\n')
    df = S.read_table(spark, p, lineage="core")
    assert spark.read.text(p).rdd.getNumPartitions() > 20
    assert sorted((r.id, r.text, r.kind) for r in df.collect()) == sorted(map(tuple, rows))


def test_split_states_compose(spark, tmp, small_splits):
    from tidemark.sources.records import QuotedLines, _pieces, split_starts
    p = _write(os.path.join(tmp, "s.csv"), "a,b\n" + '1,"' + "line\n" * 700 + '"\n' + "2,x\n" * 300)
    starts = sorted(split_starts(_pieces(spark, p, b"\n"), QuotedLines(",")).values(), key=lambda s: s.no)
    inside = [s.inside for s in starts]
    assert inside[0] == 0 and 1 in inside and inside[-1] == 0 and [s.no for s in starts] == list(range(len(starts)))


@pytest.mark.parametrize("layout", [None, 1])
def test_json_list_across_splits(spark, tmp, small_splits, layout):
    recs = [{"id": i, "text": ", ]}{[ \"quoted\" \\ " * (i % 30), "in": {"a": [i, {"b": "],["}]}} for i in range(200)]
    p = _write(os.path.join(tmp, "r.json"), json.dumps(recs, indent=layout))
    got = S.read_table(spark, p).collect()
    assert sorted((r.id, r.text, r["in"].a[0]) for r in got) == [(r["id"], r["text"], str(r["in"]["a"][0])) for r in recs]
    values = ["x, y" * i if i % 2 else i for i in range(1, 90)]
    p = _write(os.path.join(tmp, "v.json"), json.dumps(values, indent=layout))
    assert sorted(r.value for r in S.read_table(spark, p).collect()) == sorted(map(str, values))
    for text, n in (("[ ]          ", 0), ('[{"a": 1}]     ', 1), ('  [ {"a": 1} , {"a": 2} ]  \n', 2)):
        assert S.list_elements(spark, _write(os.path.join(tmp, f"e{n}.json"), text)).count() == n


def test_finished_records_leave_a_task_in_small_batches(spark):
    import pyarrow as pa
    from types import SimpleNamespace
    from tidemark.sources import records as R

    n, size = 3000, 20_000  # 60 MB in records of 20 kB, in one batch
    pieces = [b"[{}"] + [b'{"v":"' + b"x" * size + b'"}'] * n
    batch = pa.record_batch([pa.array(["f"] * len(pieces)), pa.array([0] * len(pieces)), pa.array(pieces, pa.binary())], names=["file", "at", "piece"])
    starts = SimpleNamespace(value={("f", 0): R.Start(0, 0, 0, None)})
    out = list(R._assembled(R.ListElements(), starts)(iter([batch])))
    assert sum(b.num_rows for b in out) == n + 1 and max(b.nbytes for b in out) < 8 << 20


def test_reading_records_bounds_the_batches_of_python_workers(spark, tmp_path):
    from tidemark.session import BATCH_BYTES
    from tidemark.sources.records import list_elements

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 30))
        (tmp_path / "list.json").write_text('[{"a": 1},\n{"a": "x, y"}]')
        got = [r.value for r in list_elements(spark, str(tmp_path / "list.json")).collect()]
        assert got == ['{"a": 1}', '{"a": "x, y"}'] and int(spark.conf.get(key)) <= BATCH_BYTES
    finally:
        spark.conf.set(key, before)
