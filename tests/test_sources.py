"""Sources on small trees of files written here."""

import threading
import zipfile

import pytest

from drillframe.operators import windows
from drillframe.plans import tops as tops_plan
from drillframe.sources import files, logs_xml, tables, tops_text

NS = 'xmlns="http://www.witsml.org/schemas/1series"'


def log_xml(curves, rows, listed=None):
    heads = "".join(f"<logCurveInfo><mnemonic>{c}</mnemonic><unit>u</unit><curveDescription>{c} curve</curveDescription></logCurveInfo>" for c in curves)
    names = f"<mnemonicList>{listed}</mnemonicList>" if listed else ""
    data = "".join(f"<data>{r}</data>" for r in rows)
    return f"<logs {NS}><log uid='a'><indexType>date time</indexType>{heads}<logData>{names}{data}</logData></log></logs>"


def tree(root):
    def put(path, text):
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)

    ts = lambda i: f"2008-05-01T10:{i // 60:02d}:{i % 60:02d}.000Z"
    put("F-1/bore/log/1/objA/1/00001.xml", log_xml(["TIME", "ROP5", "ROP", "SWOB", "RPM"], [f"{ts(i)},9,{i},2.5,null" for i in range(60)]))
    put("F-1/bore/log/1/objA/1/00002.xml", log_xml([], [f"{ts(i + 60)},7,8" for i in range(50)], "TIME, SWOB ,ROP"))
    put("F-1/bore/log/1/objA/2/00001.xml", log_xml([], ["2008-03-01T00:00:00.000Z,1,1", "2012-01-01T10:00:00.000Z,1,1", "never,1,1", f"{ts(200)},5,6"]))
    put("F-2/bore/log/1/objB/1/00001.xml", log_xml(["TIME", "ROP"], [f"{ts(i)},1" for i in range(200)]))
    put("F-2/bore/log/1/objC/1/00001.xml", log_xml(["TIME", "ROP", "SWOB", "RPM"], [f"{ts(i)},1,2,3" for i in range(20)]))
    put("F-2/bore/log/_meta/00001.xml", "<x/>")
    put("F-2/bore/log/1/objB/1/Meta.xml", "<x/>")
    put("F-2/bore/log/1/objB/1/00002.xml", "<logs><log>broken")
    put("F-2/bore/log/1/objB/1/00003.xml", "<logs><log><indexType>a</b></log></logs>")


def test_logs(spark, tmp_path):
    tree(tmp_path)
    logs = logs_xml.read_logs(spark, str(tmp_path)).cache()
    rows = {(r.well_name, r.ts.strftime("%H:%M:%S")): r for r in logs_xml.parse_logs(logs).collect()}
    assert len(rows) == 111 and {w for w, _ in rows} == {"F-1"}
    first, second, third = rows["F-1", "10:00:07"], rows["F-1", "10:01:05"], rows["F-1", "10:03:20"]
    assert (first.rop, first.wob, first.rpm, first.spp) == (7.0, 2.5, None, None)
    assert (second.rop, second.wob) == (8.0, 7.0)
    assert (third.rop, third.wob) == (6.0, 5.0)
    assert {r.index_type for r in logs_xml.log_header(logs).collect()} == {"date time", "error: malformed log element"}
    sample = logs_xml.log_sample(logs, 2).where("size(listed) = 3").first()
    assert sample.listed == ["TIME", "SWOB", "ROP"] and len(sample.rows) == 2
    assert {r.n_curves for r in logs_xml.log_structure(logs).collect()} >= {0, 5}
    channels = logs_xml.log_channels(logs).where("mnemonic IS NOT NULL")
    assert {r.mnemonic: len(r.wells) for r in logs_xml.shared_mnemonics(channels, 2).collect()} == {"TIME": 2, "ROP": 2, "SWOB": 2, "RPM": 2}
    assert {r.keyword: r.mnemonics for r in logs_xml.keyword_wells(channels, ["ROP", "ZZ"]).collect()} == {"ROP": ["ROP", "ROP5"]}


def test_broken_files_give_error_rows(spark, tmp_path):
    tree(tmp_path)
    (tmp_path / "F-2/bore/log/1/objB/1/00004.xml").write_text("<other/>")
    found = files.data_files(files.file_index(spark, str(tmp_path)))
    logs = logs_xml.with_unreadable(logs_xml.read_logs(spark, str(tmp_path)), found)
    errors = {r.path.rsplit("/", 1)[-1]: (r.well, r.error) for r in logs_xml.log_channels(logs).where("error IS NOT NULL").collect()}
    assert errors == {"00002.xml": ("F-2", "malformed log element"), "00003.xml": ("F-2", "malformed log element"), "00004.xml": ("F-2", "no whole log element")}
    assert {r.index_type for r in logs_xml.log_header(logs).where("index_type LIKE 'error%'").collect()} == {"error: no whole log element", "error: malformed log element"}
    assert logs_xml.log_channels(logs).where("error IS NULL AND mnemonic IS NOT NULL").count() == 11
    assert logs_xml.parse_logs(logs).count() == 111


def test_logs_are_parsed_in_one_scan_of_xml_and_in_order(spark, tmp_path):
    from drillframe.operators.durable import stored

    tree(tmp_path)
    scans = []

    def keep(df):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan xml"))
        return stored(df)

    out = logs_xml.parse_logs(logs_xml.read_logs(spark, str(tmp_path)), keep=keep)
    assert scans == [1, 0] and "FileScan xml" not in out._jdf.queryExecution().executedPlan().toString()
    ts = [r.ts for r in out.collect()]
    assert ts == sorted(ts) and len(ts) == 111


def test_file_tree(spark, tmp_path):
    tree(tmp_path)
    found = files.file_index(spark, str(tmp_path)).cache()
    assert files.data_files(found).count() == 7
    objects = {r.log_obj: r for r in files.log_objects(found).collect()}
    assert objects["F-1/bore/1/objA"].first_path.endswith("objA/1/00001.xml") and objects["F-1/bore/1/objA"].n_files == 3
    assert {(r.entry, r.kind) for r in files.top_entries(found, str(tmp_path)).collect()} == {("F-1", "dir"), ("F-2", "dir")}
    assert files.totals(found).first().n_files == 8  # Spark lists no folders that begin with an underscore
    assert files.largest_files(files.log_files(found)).count() == 2


def test_top_entries_of_any_file_system(spark):
    for place in ("hdfs://host:8020", "s3a://bucket", "file:", ""):
        paths = spark.createDataFrame([(f"{place}/data/root/{x}", 2) for x in ("a/1.xml", "a/b/2.xml", "c.xml")], "path string, length long")
        for root in (f"{place}/data/root", "hdfs:///data/root/", "/data/root"):
            assert {tuple(r) for r in files.top_entries(paths, root).collect()} == {("a", "dir", 2, 4), ("c.xml", "file", 1, 2)}


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/", "")
        z.writestr("top/a.xml", "<x/>")
        z.writestr("top/b/c.xml", "<y/>")
    assert files.extract_archive(spark, str(tmp_path / "a.zip"), str(tmp_path / "out")) == {"entries": 2, "megabytes": 8e-6}
    assert (tmp_path / "out/top/b/c.xml").read_text() == "<y/>"
    assert files.choose_root(spark, str(tmp_path / "out")).endswith("/out/top")
    assert files.choose_root(spark, str(tmp_path / "out/top")).endswith("/out/top")


def test_tops(spark, tmp_path):
    lines = [
        '<CD_WELL well_id="w1" well_common_name="F-99"/>',
        '<CD_WELL well_id="w1" well_common_name="F-15"/>',
        '<CD_WELL well_id="w2" well_common_name="F-15"/>',
        '<CD_WELLBORE_FORMATION well_id="w1" formation_name="Utsira Fm" prognosed_md="3000" phase="PLAN"/>',
        '<CD_WELLBORE_FORMATION well_id="w1" formation_name="Utsira Fm" prognosed_md="3280.84" phase="ACTUAL"/>',
        '<CD_WELLBORE_FORMATION well_id="w2" formation_name="T. Hugin" prognosed_md="9842.52" phase="OTHER"/>',
        '<CD_WELLBORE_FORMATION well_id="w2" formation_name="Hordaland" prognosed_md="5000" phase="ACTUAL"/>',
        '<CD_WELLBORE_FORMATION well_id="w2" formation_name="Grid" prognosed_md="" phase="ACTUAL"/>',
        '<CD_WELLBORE_FORMATION well_id="w2" formation_name="Grid" prognosed_md="-5" phase="ACTUAL"/>',
    ]
    (tmp_path / "edm.xml").write_text("\n".join(lines))
    read = tops_text.read_lines(spark, str(tmp_path / "edm.xml"))
    assert tops_text.wells(read).count() == 3 and tops_text.tops(read).count() == 5
    best = tops_plan.best_tops(tops_text.tops(read), tops_text.wells(read))
    drilled = spark.createDataFrame([("15/9-F-15S", 1500.0), ("15/9-F-15", 9000.0), ("X", 20_000.0)], "well_name string, dmea double")
    made = tops_plan.formation_intervals(best, drilled).cache()
    want = {(1000.0, 3000.0, "Utsira", 1), (3000.0, 99_999.0, "Hugin", 12)}
    assert {(r.md_from_m, r.md_to_m, r.formation, r.formation_id) for r in made.collect()} == want and made.count() == 4
    assert [r.well_name for r in tops_plan.wells_without_tops(made, drilled).collect()] == ["X"]
    assert {r.well_name: r.state for r in tops_plan.coverage(made, drilled).collect()} == {"15/9-F-15S": "covered", "15/9-F-15": "covered", "X": "no tops"}
    assert {r.formation: r.md_m for r in tops_plan.field_medians(best).collect()}["Utsira"] == 1000.0


def test_tables(spark):
    df = spark.range(5)
    tables.drop_table(spark, "own_rows")
    tables.append_table(df, "own_rows")
    tables.append_table(df, "own_rows")
    assert tables.read_table(spark, "own_rows").count() == 10
    tables.replace_table(tables.read_table(spark, "own_rows").where("id < 2"), "own_rows")
    assert tables.read_table(spark, "own_rows").count() == 4
    tables.write_sorted(spark.range(2000).selectExpr("id * 7919 % 2003 AS x").repartition(6), "own_rows", ["x"])
    assert tables.version_of(spark, "own_rows") == 3 and spark.sql("SELECT count(*) FROM own_rows").first()[0] == 2000
    spans = tables.read_table(spark, "own_rows").selectExpr("_metadata.file_name AS f", "_metadata.row_index AS i", "x").collect()
    assert [r.x for r in sorted(spans, key=lambda r: (r.f, r.i))] == sorted(r.x for r in spans)
    tables.drop_table(spark, "own_rows")
    assert not [r for r in spark.sql("SHOW TABLES LIKE 'own_rows*'").collect()] and tables.version_of(spark, "own_rows") == 0
    tables.append_table(df.selectExpr("id", "id % 2 AS part"), "own_rows", ["part"])
    assert tables.read_table(spark, "own_rows").count() == 5
    tables.drop_table(spark, "own_rows")


def test_a_reader_never_misses_the_table(spark):
    tables.drop_table(spark, "read_rows")
    tables.append_table(spark.range(10), "read_rows")
    seen, failed, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.add(spark.sql("SELECT count(*), min(id) FROM read_rows").first())
                seen.add(tables.read_table(spark, "read_rows").selectExpr("count(*)", "min(id)").first())
            except Exception as error:
                failed.append(error)

    readers = [threading.Thread(target=read) for _ in range(3)]
    for r in readers:
        r.start()
    for i in range(1, 8):
        tables.replace_table(tables.read_table(spark, "read_rows").selectExpr("id + 1 AS id"), "read_rows")
    stop.set()
    for r in readers:
        r.join()
    assert not failed, failed[:1]
    assert {n for n, _ in seen} == {10} and {low for _, low in seen} <= set(range(8)) and len(seen) > 1
    assert [n for n, _ in tables._versions(spark, "read_rows")] == [6, 7, 8]
    tables.drop_table(spark, "read_rows")


def test_the_second_of_two_writers_is_refused(spark):
    tables.drop_table(spark, "written")
    tables.append_table(spark.range(5), "written")
    read = tables.version_of(spark, "written")
    tables.replace_table(spark.range(6), "written", read=read)
    with pytest.raises(tables.Conflict):
        tables.replace_table(spark.range(7), "written", read=read)
    outcome = []

    def write(n):
        try:
            outcome.append(tables.replace_table(spark.range(n), "written", read=2))
        except tables.Conflict:
            outcome.append(None)

    writers = [threading.Thread(target=write, args=(20 + i,)) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(outcome, key=str) == [3, None, None, None] and tables.version_of(spark, "written") == 3
    assert len(tables._versions(spark, "written")) == 3
    tables.drop_table(spark, "written")


def test_a_writer_that_stops_after_its_claim_can_be_finished(spark, monkeypatch):
    tables.drop_table(spark, "halted")
    tables.append_table(spark.range(5), "halted")
    with monkeypatch.context() as m:
        m.setattr(tables, "_move", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            tables.replace_table(spark.range(9), "halted")
    assert tables.read_table(spark, "halted").count() == 5
    with pytest.raises(tables.Conflict):
        tables.replace_table(spark.range(7), "halted")
    assert tables.finish_replacement(spark, "halted") == 2 and tables.read_table(spark, "halted").count() == 9
    assert tables.replace_table(spark.range(7), "halted") == 3
    tables.drop_table(spark, "halted")


def test_rows_laid_out_for_windows_need_no_exchange(spark):
    df = spark.range(4000).selectExpr("id % 7 AS k", "(id * 7919) % 4001 AS t", "IF(id % 3 = 0, NULL, id * 0.5D) AS v", "id")
    by = ["k"], ["t"]
    tables.drop_table(spark, "laid_out")
    tables.write_for_windows(df, "laid_out", *by, buckets=4)
    laid = tables.read_table(spark, "laid_out")
    # Without broadcasts, which small tables would make of joins.
    for f, less in ((lambda x: windows.forward_fill(x, *by, ["v"]), 1), (lambda x: windows.rolling(x, *by, ["v"], 3, 9), 1)):
        def exchanges(x):
            return f(x)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

        assert exchanges(df) - exchanges(laid) == less and exchanges(laid) == 0
        assert sorted(map(tuple, f(laid).collect()), key=repr) == sorted(map(tuple, f(df).collect()), key=repr)
    tables.drop_table(spark, "laid_out")
