"""Sources and sinks: workbooks, landing, manifests, day tables, row ids."""
import io
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from docket.operators.ranking import rank_within
from docket.sources import days, landing, workbook


def _xlsx(rows):
    shared, sheet_rows = [], []
    for r, row in enumerate(rows, start=1):
        cells = []
        for c, val in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(val, str):
                shared.append(val)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{val}</v></c>')
        sheet_rows.append(f'<row r="{r}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(sheet_rows)}</sheetData></worksheet>")
    return buf.getvalue()


def test_workbook_reader(spark):
    d = tempfile.mkdtemp(prefix="wb-", dir="/tmp")
    with open(os.path.join(d, "day1.xlsx"), "wb") as f:
        f.write(_xlsx([["Processo", "Intimação", "Jornal"], ["P1", "texto um", "D J E N"], ["P2", "texto dois", "DJSP"]]))
    rows = workbook.read_workbooks(spark, d)
    t = workbook.workbook_table(rows, {"Processo": "processo", "Intimação": "intimacao", "Jornal": "jornal"}, day=1)
    got = sorted((r.row_id, r.processo, r.intimacao, r.jornal, r.dia) for r in t.collect())
    assert got == [(0, "P1", "texto um", "D J E N", 1), (1, "P2", "texto dois", "DJSP", 1)]
    ct = spark.createDataFrame([(bytearray(_xlsx([["a"]])),)], "content binary")
    assert ct.select(landing.content_type(F.col("content"))).first()[0] == landing.OOXML_SHEET


def test_workbook_keeps_rows_columns_and_bad_files(spark, tmp_path):
    """Blank rows keep their number, repeated headers and unnamed columns stay,
    phonetic hints do not, and a damaged file is a row of its own."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    pack = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    text = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
    sheet = (f'<row r="1">{text("A")}{text("A")}</row><row r="5">{text("x")}{text("y")}{text("z")}</row>'
             '<row r="6"><c r="B6" t="s"><v>0</v></c></row>')
    with zipfile.ZipFile(tmp_path / "good.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="s" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships {pack}><Relationship Id="r2" Target="worksheets/sheet7.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>ru</t></r><r><t>n</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/worksheets/sheet7.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    (tmp_path / "bad.xlsx").write_bytes(b"PK no zip")
    rows = workbook.read_workbooks(spark, str(tmp_path))
    got = {r.row_id: r.cells for r in rows.where("error is null").collect()}
    assert got == {3: {"A": "x", "A.1": "y", "col2": "z"}, 4: {"A": None, "A.1": "run", "col2": None}}
    assert [r.source_path.endswith("bad.xlsx") for r in workbook.workbook_errors(rows).collect()] == [True]
    assert workbook.workbook_table(rows, {"A": "a"}).count() == 2


def test_landing_is_stored_once(spark, tmp_path):
    """Files of a committed batch clash with the same batch later; equal paths
    with equal first orders and files without an order do not land."""
    batch = spark.createDataFrame(
        [(1, "a", b"x"), (1, "a", b"y"), (2, "a", b"z"), (3, "b", b"x"), (None, "c", b"x"), (4, "b", b"x")],
        "order bigint, name string, content binary")
    acc, ref = landing.plan_landing(batch, spark.createDataFrame([], "path string"), "inbox", "me")
    assert [(r.order, r.path) for r in acc.collect()] == [(3, "inbox/b")]
    assert sorted((str(r.order), r.reason) for r in ref.collect()) == [
        ("1", "same_order"), ("1", "same_order"), ("2", "exists"), ("4", "exists"), ("None", "no_order")]
    place = str(tmp_path / "catalog")
    assert landing.commit_landing(acc, place, 0)
    version, catalog = landing.stored_catalog(spark, place)
    acc, ref = landing.plan_landing(batch, catalog, "inbox", "me")
    assert version == 1 and acc.count() == 0 and ref.count() == batch.count()


def test_two_writers_one_winner(spark, tmp_path):
    """Two plans against the same state: the second commit is refused, and its
    batch, planned again, gets ``exists`` where the first has won."""
    place = str(tmp_path / "catalog")
    one, two = _batch(spark, ["a", "b"]), _batch(spark, ["b", "c"])
    version, catalog = landing.stored_catalog(spark, place)
    plans = [landing.plan_landing(b, catalog, "inbox", "me")[0] for b in (one, two)]
    assert version == 0 and [p.count() for p in plans] == [2, 2]
    assert landing.commit_landing(plans[0], place, version)
    assert not landing.commit_landing(plans[1], place, version)
    assert sorted(r.path for r in landing.stored_catalog(spark, place)[1].collect()) == ["inbox/a", "inbox/b"]
    version, refused = landing.land(two, place, "inbox", "me", planned_at=(version, catalog))
    assert version == 2 and [(r.path, r.reason) for r in refused.collect()] == [("inbox/b", "exists")]
    version, catalog = landing.stored_catalog(spark, place)
    assert version == 2 and sorted(r.path for r in catalog.collect()) == ["inbox/a", "inbox/b", "inbox/c"]
    assert {bytes(r.content) for r in catalog.collect()} == {b"%PDF-1.4 x"}


def test_html_after_much_space(spark):
    kinds = spark.createDataFrame([(b" " * 5000 + b"<!DOCTYPE html><p>",), (b" " * 5000 + b"x<html>",)], "content binary")
    assert [r.t for r in kinds.select(landing.content_type(F.col("content")).alias("t")).collect()] == [
        "text/html", "text/plain"]


def test_day_read_under_a_schema(spark, tmp_path):
    """Good and rejected lines are all lines; one day reads its folder alone."""
    lines = {1: ["row_id,processo,valor", "1,P1,2.5", '2,"P,2",3', "x,P3,1", "4,P4", "5,P5,1,2", ",P6,1", "7,,1", "8,P8,"],
             2: ["row_id,processo,valor", "1,P1,abc"]}
    for day, text in lines.items():
        (tmp_path / f"dia={day}").mkdir()
        (tmp_path / f"dia={day}" / "f.csv").write_text("\n".join(text) + "\n")
    schema = "row_id long, processo string, valor double"
    good, bad = days.read_days_checked(spark, str(tmp_path), schema)
    assert sorted((r.dia, r.row_id, r.processo, r.valor) for r in good.collect()) == [
        (1, 1, "P1", 2.5), (1, 2, "P,2", 3.0), (1, 8, "P8", None)]
    assert sorted((r.dia, r.reason, r.line) for r in bad.collect() if r.line) == [
        (1, "bad_line", "4,P4"), (1, "bad_line", "5,P5,1,2"), (1, "bad_line", "x,P3,1"), (2, "bad_line", "1,P1,abc")]
    assert sorted(r.reason for r in bad.collect()) == ["bad_line"] * 4 + ["null_key", "null_row_id"]
    assert good.count() + bad.count() == 9
    one, rest = days.read_days_checked(spark, str(tmp_path), schema, days=[2])
    assert one.count() == 0 and rest.count() == 1
    assert "PartitionFilters: [" in (plan := rest._jdf.queryExecution().executedPlan().toString())
    assert "dia" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_checked_sink_can_be_repeated(spark, tmp_path):
    place = str(tmp_path / "out")
    rows = [(i, i % 2, "P", "t", -1 if i % 5 == 0 else i - i % 3) for i in range(30)]
    lab = spark.createDataFrame(rows, "row_id long, dia long, processo string, intimacao string, similar long")
    told = days.write_checked(lab, place)
    assert told == {"rows": 30, "decided": 24, "undecided": 6,
                    "removed": sum(s >= 0 and s != i for i, *_, s in rows), "representatives": sum(s == i for i, *_, s in rows)}
    assert days.write_checked(lab.where("dia = 1"), place)["rows"] == 15
    assert sorted(r.row_id for r in days.read_days(spark, place).collect()) == list(range(30))


def _batch(spark, names):
    return spark.createDataFrame([(i, n, bytearray(b"%PDF-1.4 x")) for i, n in enumerate(names)],
                                 "order int, name string, content binary")


def test_landing_set_based_and_stop_at_first(spark):
    catalog = spark.createDataFrame([("inbox/a.xlsx",), ("inbox/b.xlsx",), ("inbox/c.xlsx",)], "path string")
    batch = _batch(spark, ["x.xlsx", "b.xlsx", "y.xlsx", "x.xlsx"])
    acc, ref = landing.plan_landing(batch, catalog, "inbox", "ana")
    assert sorted(r.name for r in acc.collect()) == ["x.xlsx", "y.xlsx"]
    assert sorted(r.order for r in ref.collect()) == [1, 3]
    assert {r.content_type for r in acc.collect()} == {"application/pdf"}
    acc, ref = landing.plan_landing(batch, catalog, "inbox", "ana", stop_at_first=True)
    assert [r.order for r in acc.collect()] == [0]
    assert [r.order for r in ref.collect()] == [1]


def test_manifest_listing(spark):
    schema = "name string, generation bigint, list_files_compare string"
    objs = spark.createDataFrame([("compare/1", 11, "['a.xlsx', 'b.xlsx']"), ("compare/2", 12, "['c.xlsx']"),
                                  ("compare/3", 13, "[]"), ("other/4", 14, "['z.xlsx']"),
                                  ("compare/5", 15, """["O'Brien.xlsx", 'x\\', y.xlsx']""")], schema)
    listed = landing.list_prefix(objs, "compare")
    assert sorted(r.file_name for r in landing.manifest_files(listed).collect()) == [
        "O'Brien.xlsx", "a.xlsx", "b.xlsx", "c.xlsx", "x', y.xlsx"]
    assert landing.manifest_count(listed).first()[0] == 4
    empty = landing.list_prefix(objs, "nothing")
    assert landing.manifest_count(empty).first()[0] == 1
    assert landing.manifest_count(empty, compat=False).first()[0] == 0
    assert sorted(r.generation for r in landing.generations(listed).collect()) == [11, 12, 13, 15]


def test_odd_literals_and_names_are_kept(spark):
    odd = ["['a.xlsx',]", "('a.xlsx','b.xlsx')", "[u'a.xlsx']", "['a' 'b']", "['a.xlsx', None]"]
    objs = spark.createDataFrame([(f"compare/{i}", i, x) for i, x in enumerate(odd)],
                                 "name string, generation bigint, list_files_compare string")
    got = sorted((r.generation, str(r.file_name)) for r in landing.manifest_files(objs).collect())
    assert got == [(0, "a.xlsx"), (1, "a.xlsx"), (1, "b.xlsx"), (2, "a.xlsx"), (3, "ab"),
                   (4, "None"), (4, "a.xlsx")]
    batch = spark.createDataFrame([(1, None, b"x"), (2, "a", b"x")], "order bigint, name string, content binary")
    acc, ref = landing.plan_landing(batch, spark.createDataFrame([], "path string"), "inbox", "me")
    assert [r.order for r in acc.collect()] == [2]
    assert [(r.order, r.reason) for r in ref.collect()] == [(1, "no_name")]
    kinds = spark.createDataFrame([(b"a" * 600 + b"\0",), (b"a" * 600,)], "content binary")
    assert [r.t for r in kinds.select(landing.content_type(F.col("content")).alias("t")).collect()] == [
        "application/octet-stream", "text/plain"]


def test_files_from_binary_can_land(spark, tmp_path):
    for n in ("b.xlsx", "a.xlsx"):
        (tmp_path / n).write_bytes(b"PK")
    batch = landing.files_from_binary(spark, str(tmp_path))
    acc, _ = landing.plan_landing(batch, spark.createDataFrame([], "path string"), "inbox", "me")
    assert sorted((r.order, r.name) for r in acc.collect()) == [(1, "a.xlsx"), (2, "b.xlsx")]


def test_rank_within_keeps_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, None), (1, 5), (1, 9)], "g long, o long")
    got = sorted((str(r.g), str(r.o), r["rank"]) for r in rank_within(df, ["g"], "o", chunk=4).collect())
    assert got == [("1", "5", 1), ("1", "9", 2), ("1", "None", 0), ("None", "1", 0), ("None", "2", 1)]


def test_rank_within_sparse_ids(spark):
    """Ids 2^17 apart, each a chunk of its own, over several spans; negative ones too."""
    df = spark.range(-300, 2700).select((F.col("id") % 2).alias("g"), (F.col("id") * (1 << 17)).alias("o"))
    got = rank_within(df, ["g"], "o", chunk=4)
    from pyspark.sql import Window
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint") - 1)
    assert got.select("g", "o", "rank").exceptAll(ref).count() == 0 and got.count() == 3000


def test_rank_within_cuts_follow_the_data(spark):
    """Ids 2^18 apart or in one lump: pieces of a group stay few and even, and a
    small group is not cut."""
    from docket.operators import ranking
    far = spark.range(0, 4000).select(F.lit(0).alias("g"), (F.col("id") * (1 << 18)).alias("o"))
    lump = spark.range(0, 4000).select(F.lit(1).alias("g"), F.when(F.col("id") < 8, F.col("id") * (1 << 40))
                                       .otherwise(F.col("id")).alias("o")).distinct()
    df = far.unionByName(lump).unionByName(spark.range(0, 90).select(F.lit(2).alias("g"), F.col("id").alias("o")))
    cuts = ranking._cuts(df.withColumn("o", F.col("o").cast("bigint")), ["g"], "o", chunk=100, pieces=16)
    held = {r.g: r._cuts for r in cuts.collect()}
    assert held[2] == [] and all(10 <= len(held[g]) <= 15 for g in (0, 1))
    rows = {g: sorted(r.o for r in df.where(F.col("g") == g).collect()) for g in (0, 1)}
    for g in (0, 1):
        edges = [-1, *held[g], 1 << 62]
        sizes = [sum(a < o <= b for o in rows[g]) for a, b in zip(edges, edges[1:])]
        assert max(sizes) <= 2 * 4000 / 16
    got = rank_within(df, ["g"], "o", chunk=100, pieces=16)
    from pyspark.sql import Window
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint") - 1)
    assert got.select("g", "o", "rank").exceptAll(ref).count() == 0 and got.count() == df.count()


def test_rank_within_cuts_a_group_by_its_size(spark):
    """A group has a cut for every chunk, not all that ``pieces`` allow."""
    from docket.operators import ranking
    df = spark.range(0, 6000).select(F.when(F.col("id") < 450, 0).otherwise(1).alias("g"), F.col("id").alias("o"))
    held = {r.g: r._cuts for r in ranking._cuts(df, ["g"], "o", chunk=100, pieces=1024).collect()}
    assert len(held[0]) == 4 and len(held[1]) == 55
    got = rank_within(df, ["g"], "o", chunk=100)
    assert got.where(F.col("rank") != F.col("o") - F.when(F.col("g") == 0, 0).otherwise(450)).count() == 0
    assert got.count() == 6000


def test_rank_within_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5003).alias("o"))
    ours = rank_within(df, ["g"], "o", chunk=64).select("g", "o", "rank")
    from pyspark.sql import Window
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert ours.exceptAll(ref.select("g", "o", F.col("rank").cast("bigint"))).count() == 0


def test_write_days_refuses_overwrite(spark):
    out = tempfile.mkdtemp(prefix="days-", dir="/tmp") + "/t"
    df = spark.createDataFrame([(0, 1, "P", "t")], "row_id bigint, dia bigint, processo string, intimacao string")
    days.write_days(df, out)
    assert days.read_days(spark, out).count() == 1
    with pytest.raises(Exception):
        days.write_days(df, out)


def test_extension_filter_and_repeated_both_ways(spark):
    from docket.operators import report
    files = spark.createDataFrame([("a.XLSX",), ("b.pdf",), ("c.xlsx",)], "name string")
    assert sorted(r.name for r in landing.only_extension(files).collect()) == ["a.XLSX", "c.xlsx"]
    s = "row_id bigint, processo string"
    d0 = spark.createDataFrame([(0, "A"), (1, "B")], s)
    d1 = spark.createDataFrame([(0, "B"), (1, "C")], s)
    assert [r.processo for r in report.repeated_cases(d1, d0).collect()] == ["B"]
    assert [r.processo for r in report.repeated_cases(d0, d1).collect()] == ["B"]
    assert [r.processo for r in report.new_cases(d1, d0).collect()] == ["C"]


def test_write_labelled_and_filtered(spark):
    from docket.operators import dedup
    base = tempfile.mkdtemp(prefix="out-", dir="/tmp")
    df = spark.createDataFrame([(0, 1, "P", "x"), (1, 1, "P", "x"), (2, 1, "Q", "y")],
                               "row_id bigint, dia bigint, processo string, intimacao string")
    lab = dedup.label_similar(df)
    days.write_labelled_and_filtered(lab, dedup.filtered(lab), base)
    assert days.read_days(spark, f"{base}/labelled").count() == 3
    assert days.read_days(spark, f"{base}/filtered").count() == 2
