"""Logs in pieces against logs read by element."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from drillframe.sources import log_lines, logs_xml

START = dt.datetime(2008, 2, 3)
CURVES = "".join(f"<logCurveInfo uid='{i}'><mnemonic> {m} </mnemonic><unit>u</unit><curveDescription>d &amp; {m}</curveDescription></logCurveInfo>\n" for i, m in enumerate(("TIME", "ROP", "SWOB", "RPM")))


def lines(n, first=0, tag="data"):
    return "\n".join(f"<{tag}>{(START + dt.timedelta(seconds=i)).isoformat()},{i},{i / 4},{i % 50}</{tag}>" for i in range(first, first + n))


def log(n, first=0, curves=CURVES, listed=""):
    return f"<log uid='1'><indexType>date time</indexType>{curves}<logData>{listed}\n{lines(n, first)}\n</logData></log>"


def write(root, files):
    for path, text in files.items():
        os.makedirs(f"{root}/{os.path.dirname(path)}", exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)
    return str(root)


def wrapped(*logs):
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<logs xmlns="urn:x" version="1.3">\n{"".join(logs)}\n</logs>\n'


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_long_element_is_split_and_gives_the_same_rows(spark, tmp_path, small_splits):
    files = {"w/b/log/1/o/1/1.xml": wrapped(log(6000)), "w/b/log/1/o/2/1.xml": wrapped(log(500, 6000, "", "<mnemonicList>TIME,RPM,ROP,SWOB</mnemonicList>")), "w/b/log/1/o/3/1.xml": wrapped(log(300, 7000, ""))}
    root = write(tmp_path, files)
    records = log_lines.scan_logs(spark, root)
    held = records.groupBy("path", F.spark_partition_id().alias("part")).count().where(F.col("path").endswith("/1/1.xml")).collect()
    assert len(held) > 8 and max(r["count"] for r in held) < 1000
    got = rows_of(log_lines.parse_scan(records))
    assert len(got) == 6800 and got == rows_of(logs_xml.parse_logs(logs_xml.read_logs(spark, root)))


def test_heads_equal_those_of_elements(spark, tmp_path, small_splits):
    files = {"w/b/log/1/o/1/1.xml": wrapped(log(700)), "w/b/log/1/o/2/1.xml": wrapped(log(3, 0, "", "<mnemonicList>TIME , A&lt;B</mnemonicList>")), "w/b/log/1/o/3/1.xml": wrapped("<log><logHeader><indexType>Depth</indexType></logHeader></log>")}
    root = write(tmp_path, files)
    heads, logs = log_lines.scan_heads(log_lines.scan_logs(spark, root)), logs_xml.read_logs(spark, root)
    for view in (logs_xml.log_channels, logs_xml.log_header, logs_xml.log_sample, logs_xml.log_structure):
        assert rows_of(view(heads)) == rows_of(view(logs))


def test_several_elements_in_a_file(spark, tmp_path, small_splits):
    other = CURVES.replace("SWOB", "X").replace("RPM", "SWOB").replace(" X ", " RPM ")
    root = write(tmp_path, {"w/b/log/1/o/1/1.xml": wrapped(log(900), "<log><indexType>none</indexType></log>", log(400, 900, other))})
    heads = log_lines.scan_heads(log_lines.scan_logs(spark, root)).orderBy("start").collect()
    assert [(r.n_data, r.index_type, r.error) for r in heads] == [(900, "date time", None), (0, "none", None), (400, "date time", None)]
    got = {r.ts: r for r in log_lines.parse_scan(log_lines.scan_logs(spark, root)).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "rop", "wob", "rpm").collect()}
    assert len(got) == 1300
    for i in (0, 899, 900, 1299):
        r = got[START + dt.timedelta(seconds=i)]
        assert r.rop == i and (r.wob, r.rpm) == ((i / 4, i % 50) if i < 900 else (i % 50, i / 4))


@pytest.mark.parametrize("broken", [
    wrapped(log(400)).replace("</log>", ""),  # no end
    wrapped(log(400)).replace("<unit>u</unit>", "<unit>u", 1),  # a head that is no XML
    wrapped(log(400)).replace("</data>", "</dat>", 1),  # data cut short
    wrapped(log(400))[:-4000],  # a file cut short
])
def test_broken_elements_are_errors_and_give_no_rows(spark, tmp_path, broken):
    root = write(tmp_path, {"w/b/log/1/o/1/1.xml": wrapped(log(150)), "w/b/log/1/o/2/1.xml": broken, "w/b/log/1/o/3/1.xml": "", "w/b/log/1/o/4/1.xml": "<other/>"})
    records = log_lines.scan_logs(spark, root)
    heads = {r.path[-7:]: r.error for r in log_lines.scan_heads(records).collect()}
    assert heads == {"1/1.xml": None, "2/1.xml": "malformed log element"}
    assert log_lines.parse_scan(records).count() == 150
    files = spark.createDataFrame([(f"file:{root}/w/b/log/1/o/{i}/1.xml",) for i in range(1, 5)], "path string")
    every = {r.path[-7:]: r.error for r in logs_xml.with_unreadable(log_lines.scan_heads(records), files).collect()}
    assert every == heads | {"3/1.xml": "no whole log element", "4/1.xml": "no whole log element"}


def test_cells_with_entities_blanks_and_attributes(spark, tmp_path):
    odd = log(120).replace("<data>", "<data id='7'>", 1).replace(",5,", ", 5 ,", 1).replace(",7,", ",&lt;7&gt;,", 1)
    root = write(tmp_path, {"w/b/log/1/o/1/1.xml": wrapped(odd)})
    got = {r.ts: r.rop for r in log_lines.parse_scan(log_lines.scan_logs(spark, root)).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "rop").collect()}
    at = lambda i: START + dt.timedelta(seconds=i)
    assert len(got) == 120 and got[at(0)] == 0 and got[at(5)] == 5 and got[at(7)] is None


def test_no_range_exchange(spark, tmp_path):
    root = write(tmp_path, {"w/b/log/1/o/1/1.xml": wrapped(log(150))})
    plan = log_lines.parse_scan(log_lines.scan_logs(spark, root))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort [log_obj" in plan


def test_many_small_files_take_few_tasks_and_are_read_as_large_ones_are(spark, tmp_path, monkeypatch):
    from drillframe.sources import files, log_lines

    body = "<logs><log><indexType>date time</indexType><logData>\n" + "".join(f"<data>2008-02-03 04:05:0{i}, {i} &lt;</data>\n" for i in range(3)) + "</logData></log></logs>"
    for i in range(1200):
        (tmp_path / f"{i}.xml").write_text(("\ufeff" if i % 2 else "") + body + ("\n" if i % 3 else ""))
    asked = lambda: log_lines.scan_logs(spark, str(tmp_path))
    assert asked().rdd.getNumPartitions() <= files.few_tasks(spark)
    shaped = lambda df: sorted(map(str, df.select("path", "line", "before").collect()))
    small, heads = shaped(asked()), log_lines.scan_heads(asked()).select("n_data", "error").distinct().collect()
    assert [tuple(h) for h in heads] == [(3, None)]
    for i in range(40, 1200):
        (tmp_path / f"{i}.xml").unlink()
    some = {f"/{i}.xml'" for i in range(40)}
    monkeypatch.setattr(log_lines, "SMALL", 0)
    assert shaped(asked()) == [r for r in small if any(name in r for name in some)]


def test_tasks_list_folders_and_give_what_the_driver_would(spark, tmp_path, monkeypatch):
    """The driver knew every file, once for the listing and again for each plan: its work grew with their number."""
    from drillframe.sources import files

    monkeypatch.setattr(files, "HELD", 3)
    names = [f"w{i % 2}/b/log/1/o {i % 3}%/{i}/1 é[{i}].xml" for i in range(12)]
    root = write(tmp_path, dict.fromkeys([*names, "w/.x/1.xml", "w/_x/1.xml", "w/_k=1/1.xml", "w/1.txt", "w/_1.xml", "top.xml"], wrapped(log(4))))
    found, rows = files.listed(spark, root), lambda df: sorted(map(str, df.collect()))
    assert {r.path: r.length for r in found.collect()} == {f"{root}/{n}": os.path.getsize(f"{root}/{n}") for n in [*names, "w/_k=1/1.xml", "top.xml"]}
    records = log_lines.scan_logs(spark, root)
    assert not [f for f in records.inputFiles() if f.endswith(".xml")]
    monkeypatch.setattr(log_lines, "local_root", lambda spark, path: None)
    other = log_lines.scan_logs(spark, root)
    assert len([f for f in other.inputFiles() if f.endswith(".xml")]) == len(names) + 2 and rows(records) == rows(other)


def test_an_empty_folder_and_a_pattern(spark, tmp_path):
    from drillframe.sources import files

    root = write(tmp_path, {"w/b/log/1/o/1/1.xml": wrapped(log(150)), "x/b/log/1/o/1/1.xml": wrapped(log(130))})
    os.makedirs(f"{root}/none")
    assert log_lines.scan_logs(spark, f"{root}/none").count() == 0 and files.local_root(spark, f"file:{root}/w") == f"{root}/w"
    assert log_lines.parse_scan(log_lines.scan_logs(spark, f"{root}/*")).count() == 280


def test_structure_with_other_columns_reads_heads_once(spark, tmp_path):
    root = write(tmp_path, {"w/b/log/1/o/1/1.xml": wrapped(log(150))})
    made = logs_xml.log_structure(log_lines.scan_heads(log_lines.scan_logs(spark, root), 2), "index_type", "data").first()
    assert (made.n_curves, made.n_data, made.index_type, len(made.data)) == (4, 150, "date time", 2)
