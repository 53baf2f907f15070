import os

from muster.operators import report, schema
from muster.plans.storage import scratch_path
from muster.sinks import files as sk
from muster.sources import files as sr


def put(spark, name, data):
    folder = scratch_path(spark, "raw")
    os.makedirs(folder)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_encodings_are_told_apart(spark):
    paths = [
        put(spark, "u.csv", "id,n\n1,é\n".encode()), put(spark, "b.csv", b"\xef\xbb\xbf" + "id,n\n2,é\n".encode()),
        put(spark, "w.csv", "id,n\n3,’é\n".encode("cp1252")), put(spark, "l.csv", b"id,n\n4,\xe9\x81\n"),
    ]
    found = {os.path.basename(r["file"]): r["encoding"] for r in sr.file_encodings(spark, paths).collect()}
    assert found == {"u.csv": "utf-8", "b.csv": "utf-8", "w.csv": "cp1252", "l.csv": "latin1"}
    rows = {r["id"]: r["n"] for r in sr.read_any_encoding(spark, paths).collect()}
    assert rows == {"1": "é", "2": "é", "3": "’é", "4": "é\x81"}


def test_delimiters_and_bad_lines(spark):
    paths = [put(spark, "c.csv", b"a,b\n1,x;y\n"), put(spark, "s.csv", b"a;b\n2;z\n"), put(spark, "t.csv", b"a\tb\n3\tw\n")]
    found = {os.path.basename(r["file"]): r["delimiter"] for r in sr.delimiters(spark, paths).collect()}
    assert found == {"c.csv": ",", "s.csv": ";", "t.csv": "\t"}
    good, bad = sr.split_bad_lines(spark, put(spark, "bad.csv", b"a,b\n1,x\n2,y,z\n3\n"), ["a", "b"])
    assert good.collect() == [("1", "x")]
    assert sorted(r["line"] for r in bad.collect()) == ["2,y,z", "3"]


def test_lists_and_aliases(spark):
    path = put(spark, "l.txt", b" Acme \n\nacme\nBeta\n")
    assert sorted(r["name"] for r in sr.read_list(spark, path).collect()) == ["Acme", "Beta"]
    lines = sr.ordered_lines(spark, put(spark, "a.txt", b"A => X\nb=>Y => Z\na =>  W\nnothing\n => Q\n"))
    assert {r["variant"]: r["canonical"] for r in sr.parse_aliases(lines).collect()} == {"a": "W", "b": "Y => Z"}


def test_quoted_cells_and_missing_text(spark):
    path = put(spark, "q.csv", b'id,t\n1,"a ""b"", c\nd"\n2,NA\n3,\n')
    assert [r["t"] for r in sr.read_text(spark, path).orderBy("id").collect()] == ['a "b", c\nd', "NA", ""]
    assert [r["t"] for r in sr.read_text(spark, path, na_text=True).orderBy("id").collect()] == ['a "b", c\nd', None, None]


def test_sheet_names_are_unique(spark):
    long = "a" * 40
    df = spark.createDataFrame([(long + "1", 1), (long + "2", 2), ("x/y", 3)], "n string, pos int")
    got = {r["n"]: r["sheet"] for r in sk.sheet_names(df, "n", "pos").collect()}
    assert got == {long + "1": "a" * 31, long + "2": "a" * 29 + "_1", "x/y": "x_y"}


def test_manifest_lists_empty_segments(spark):
    df = spark.createDataFrame([("a",), ("a",)], "s string")
    assert {r["s"]: r["n"] for r in sk.manifest(df, "s", ["a", "b"]).collect()} == {"a": 2, "b": 0}


def test_schema_projection_and_validation(spark):
    df = spark.createDataFrame([(" x ", None), ("", "http://a")], "a string, b string")
    assert schema.to_schema(df, ["T", "U"], {"T": "a"}, fill="", trim=True).collect() == [("x", ""), ("", "")]
    assert {r["column"]: r["empty"] for r in schema.empty_required(df, ["a", "b"]).collect()} == {"a": 1, "b": 1}
    assert schema.bad_urls(df, "b").collect() == [(1, 2)]
    urls = spark.createDataFrame([("x", "https://linkedin.com/in/a")], "n string, link string")
    assert schema.url_column(urls).collect() == [("link",)]
    assert schema.url_column(urls.withColumnRenamed("n", "ProfileURL")).collect() == [("ProfileURL",)]


def test_id_column_falls_back(spark):
    df = spark.createDataFrame([("t", None, "e", "f"), ("t", None, "e", "g")], "t string, id string, email string, first string")
    assert report.distinct_by_id(df, "t", ["id", "email"]).collect() == [("t", 1)]
    assert report.distinct_by_id(df, "t", ["id"], ["email", "first"]).collect() == [("t", 2)]


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    from muster.sources import files as sr

    (tmp_path / "my list.csv").write_text("a,b\n1,2\n")
    (tmp_path / "other.csv").write_text("b,a\n2,1\n")
    (tmp_path / "one.csv").write_text("a\n5\n")
    for read in (sr.read_any_encoding, sr.read_sniffed):
        got = read(spark, str(tmp_path)).select("a", "b").collect()
        assert sorted((r.a, r.b or "") for r in got) == [("1", "2"), ("1", "2"), ("5", "")]


def test_sheets_without_a_header_are_skipped(spark, tmp_path):
    for name, text in (("full", "a,b\n1,2\n"), ("header", "a,c\n"), ("empty", "")):
        (tmp_path / f"{name}.csv").write_text(text)
    out = sr.read_sheets(spark, {("f", n): str(tmp_path / f"{n}.csv") for n in ("empty", "full", "header")})
    assert set(out.columns) == {"a", "b", "c", "_source_file", "_source_sheet_or_type"}
    assert [(r.a, r.b, r._source_sheet_or_type) for r in out.collect()] == [("1", "2", "full")]


def test_quoted_line_breaks_in_files_of_several_blocks(spark):
    import csv
    import io
    import random

    from muster.sources import records

    rnd = random.Random(3)
    rows = [[str(i), "".join(rnd.choice('ab"\n,; x') for _ in range(rnd.randint(0, 12)))] for i in range(200)] + [["200", 'x""\n' * 3000]]
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n").writerows([["id", "t"], *rows])
    path = put(spark, "my file+1 %.csv", buffer.getvalue().encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
        assert records.lines_of(spark, path).select("block").distinct().count() > 20
        assert {r.id: r.t for r in sr.read_text(spark, path).collect()} == {i: t for i, t in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bad_records_are_kept_whole(spark):
    path = put(spark, "bad.csv", b'a,b\n1,"x\ny"\n2,"y\nz",3\n4,5" pipe\n6\n7,"open\n8,z\n')
    good, bad = sr.split_bad_lines(spark, path, ["a", "b"])
    assert sorted(map(tuple, good.collect())) == [("1", "x\ny"), ("4", '5" pipe'), ("7", "open"), ("8", "z")]
    assert sorted(r.line for r in bad.collect()) == ['2,"y\nz",3', "6"]


def test_types_follow_all_values(spark):
    path = put(spark, "t.csv", b"i,l,d,s,b,day,at,none\n1,3000000000,1.5,x,true,2024-01-31,2024-01-31 10:00:00,\n,1,2,2d,False,2024-02-01,2024-02-01T11:00:00,\n")
    df = sr.read_typed(spark, path)
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "string", "boolean", "date", "timestamp", "string"]
    assert sorted((r.i or 0, r.s) for r in df.collect()) == [(0, "2d"), (1, "x")]
    assert sorted(map(tuple, sr.read_typed(spark, path, "s string, i bigint, l int").collect()), key=str) == [("2d", None, 1), ("x", 1, None)]


def test_many_sheets_make_one_plan_of_constant_size(spark, tmp_path):
    headers = ["a,b", "b,c", 'a,"x y"']
    plans = []
    for n in (9, 90):
        sheets = {}
        for k in range(n):
            path = tmp_path / f"{n} s{k}.csv"
            path.write_text(headers[k % 3] + f"\n{k},v{k}\n")
            sheets[f"f{k % 7}", f"s{k}"] = str(path)
        out = sr.read_sheets(spark, sheets, workbook=True)
        plans.append(len(out._jdf.queryExecution().analyzed().toString().split("\n")))
        rows = out.collect()
        assert len(rows) == n and {r["_source_workbook"] for r in rows} == {f"f{k}" for k in range(7)}
        for r in rows:
            k = int(r["_source_sheet_or_type"][1:])
            want = [{"a": f"{k}", "b": f"v{k}"}, {"b": f"{k}", "c": f"v{k}"}, {"a": f"{k}", "x y": f"v{k}"}][k % 3]
            assert {c: r[c] for c in ("a", "b", "c", "x y") if r[c] is not None} == want
    assert plans[0] == plans[1]


def test_many_files_take_few_jobs(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"{k}.csv").write_bytes([f"n;v\n{k};é\n".encode(), f"v,n\né,{k}\n".encode(), f"n\tw\n{k}\té\n".encode()][k % 3])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("files", "sniffed files")
    try:
        rows = sr.read_sniffed(spark, str(tmp_path)).collect()
        jobs = tracker.getJobIdsForGroup("files")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {int(r.n): r.v or r.w for r in rows} == dict.fromkeys(range(60), "é")
    # Stages of adaptive plans are jobs of their own; their number does not follow the files.
    assert len(jobs) <= 24


def test_repeated_and_blank_headers(spark):
    path = put(spark, "h.csv", b"a,,a,a\n1,2,3,4\n")
    assert sr.read_text(spark, path).collect()[0].asDict() == {"a": "1", "_c1": "2", "a.1": "3", "a.2": "4"}


def test_numbered_sheet_names_never_clash(spark):
    names = ["a" * 40 + "x", "a" * 41 + "y", "a" * 29 + "_1", "a" * 29 + "_1x", "", "[", "Sheet", "sheet_1"] + [f"{'b' * 31}{i}" for i in range(15)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, pos int")
    got = {r["n"]: r["sheet"] for r in sk.sheet_names(df, "n", "pos").collect()}
    assert len(got) == len(names) == len(set(got.values())) and max(map(len, got.values())) == 31
    assert got["a" * 40 + "x"] == "a" * 31 and got["a" * 29 + "_1"] == "a" * 29 + "_1"
