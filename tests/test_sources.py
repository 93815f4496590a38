from pyspark.sql import functions as F

from sluice.operators.tagging import Rule
from sluice.sources import files, properties, sql_text, templates
from sluice.streaming import tagging


def test_statements_and_places():
    text = "\nselect firstName,\nlastName from customer;\n\n-- note\nselect a from b"
    assert sql_text.statements(text) == [("select firstName,\nlastName from customer;", 2)]
    got = [(r[2], r[4], r[6], r[7]) for r in sql_text.column_rows(text)]
    assert got == [("SELECT", "customer", "firstName", 2), ("SELECT", "customer", "lastName", 3)]


def test_kinds_of_statements():
    names = lambda sql: [(q.kind, q.table[0], [c[0] for c in q.columns]) for q in sql_text.parse(sql)]
    assert names("CREATE TABLE IF NOT EXISTS votes(\nid SERIAL NOT NULL,\nday date, PRIMARY KEY (id));") == [("CREATE", "votes", ["id", "day"])]
    assert names("select cast(x as int), count(a, b), c + f(1) from d join e on d.k = e.k") == [("SELECT", "d", ["x", "a", "b", "c"])]
    assert names("with a as (select x from y) select m from n") == [("SELECT", "y", ["x"]), ("SELECT", "n", ["m"])]
    assert names("select a from (select b from c) t union all select d from e") == [("SELECT", "c", ["b"]), ("SELECT", "e", ["d"])]
    assert names("insert into s.t (a, `b`) values (:x, 2) -- end") == [("INSERT", "t", ["a", "b"])]
    assert names("update t set a = 1, u.b = f(2, 3) where c = 4") == [("UPDATE", "t", ["a", "b"])]
    assert [sql_text.parse(x) for x in ("delete from t", "", "select (", "nonsense;", "insert into t values (1)")] == [None] * 5


def test_property_formats():
    flat = lambda f, t: [(n, v) for n, v, _ in f(t)]
    assert flat(properties.key_values, "# c\\\n a = 1\nb:2\\\n   #3\n[s]\nk v w\na=4\n") == [("a", "4"), ("b", "2#3"), ("[s]", ""), ("k", "v w")]
    assert flat(properties.json_values, '{"a":{"b":[{"c":1},true,"x"]}}') == [("a.b[0].c", "1"), ("a.b[1]", "true"), ("a.b[2]", "x")]
    assert list(properties.yaml_values("a:\n  b: [1, 2]\n  c: @@x@@\n")) == [("a.b[0]", "1", 2), ("a.b[1]", "2", 2), ("a.c", "x", 3)]
    assert not flat(properties.json_values, "{") and not flat(properties.yaml_values, "a: [") and not flat(properties.yaml_values, "")


def test_dotenv_last_wins(spark):
    df = spark.createDataFrame([("f", "A=1\n#B=2\n\nbad\nA=3=4\nC="), ("g", None), ("h", "")], "file string, content string")
    assert sorted(tuple(r) for r in properties.dotenv(df).collect()) == [("f", "A", "3=4", -1), ("f", "C", "", -1)]


def test_files_of_a_folder(spark, tmp_path):
    for name in ("a/x.sql", "a/y.sql", "b/z.sql", "b/z.txt", "b/.env"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("select a\nfrom b;\n")
    found = files.by_extension(spark, str(tmp_path), [".sql"], [".*/y\\.sql"])
    text = files.text_of(found).select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "content")
    assert sorted((r.file, r.column_name, r.line) for r in sql_text.columns(text).collect()) == [("x.sql", "a", 1), ("z.sql", "a", 1)]
    assert files.by_name(spark, str(tmp_path), ["z.txt"]).count() == 1
    kept, skipped = files.within_directory_count(files.by_extension(spark, str(tmp_path), [".sql"]), 1)
    assert (kept.count(), skipped.count()) == (1, 2)


def test_template_nodes(spark):
    df = spark.createDataFrame([(1, '<p id=a>x<script src="s">// c\nrun()</script><br/>'), (2, None), (3, "")], "page_id int, html string")
    got = templates.nodes(df)
    assert [r.code for r in got.where(F.col("name") == templates.ELEMENT).collect()] == ['<p  id="a" > </p>', '<script  src="s" content="run()" > </script>', "<br  > </br>"]
    assert got.where(F.col("name") == templates.ATTRIBUTE).count() == 2


def test_stream_of_tagged_nodes(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'email' as name union all select timestamp'2024-01-01 00:09:00', 'e_mail' union all select timestamp'2024-01-01 00:11:00', 'email'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counts = tagging.tag_counts(tagging.tag_stream(stream, "name", [Rule("Mail", ("e_?mail",))]), "ts")
    counts.writeStream.format("memory").queryName("tagged").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.start.minute, r.n) for r in spark.table("tagged").collect()) == [(0, 2), (10, 1)]
