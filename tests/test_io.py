"""Frontier, HTTP source, sinks, streaming, CLI and the registered queries."""

import http.server
import json
import threading
from collections import Counter

import pytest

from pagequery import Config, load_config
from pagequery.sources.frontier import frontier
from pagequery.sources.http import fetch_pages, http_get

LINKS = {"queries": {"q": {"selector": "a", "extract": [{"name": "h", "rule": {"attribute": "href", "transform": ["urljoin"], "aggregate": "first"}}]}}}


def urls(spark, **config):
    return [r["url"] for r in frontier(spark, Config.of(config)).orderBy("pos").collect()]


def test_frontier(spark):
    assert urls(spark, url="http://a/i", pagination={"type": "url_param", "param": "p", "start_page": 3, "max_pages": 9}) == [f"http://a/i?p={i}" for i in range(3, 10)]
    assert urls(spark, url="a", url_list=["b", "a", "c", "b"]) == ["a", "b", "c"]
    assert urls(spark, pagination={"type": "offset", "base_url": "u", "offset_step": 15, "start_page": 2, "max_pages": 4}) == ["u?offset=15", "u?offset=30", "u?offset=45"]
    assert urls(spark, url="a?x", url_list=["b"], pagination={"type": "url_param", "param": "p", "start_page": 2, "max_pages": 3}) == ["a?x&p=2", "a?x&p=3"]
    assert urls(spark, url="a", pagination={"type": "next_link"}) == ["a"]
    assert urls(spark, url="a", pagination={"type": "url_param", "param": "p", "start_page": 5, "max_pages": 3}) == []


@pytest.fixture
def server():
    hits = Counter()

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            hits[self.path] += 1
            busy = self.path == "/busy" and hits[self.path] < 3
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/ok")
                self.end_headers()
                return
            body = f'<a href="/x">{self.headers["User-Agent"]}</a>'.encode()
            self.send_response(503 if busy else 404 if self.path == "/none" else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", hits
    s.shutdown()


def test_fetch(spark, server):
    base, hits = server
    config = load_config({**LINKS, "url_list": [f"{base}/{p}" for p in ("ok", "none", "busy", "moved")] + ["http://127.0.0.1:1/"], "user_agent": "me", "limits": {"max_retries": 2, "retry_delay_ms": 1, "timeout_ms": 5000}})
    rows = {r["url"].rsplit("/", 1)[1]: r for r in fetch_pages(frontier(spark, config), config).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"ok": 200, "none": 404, "busy": 200, "moved": 200, "": 0}
    assert rows[""]["error"].startswith("[HTTP]") and rows[""]["html"] is None and rows["none"]["error"] is None
    assert "me" in rows["ok"]["html"] and rows["moved"]["final_url"].endswith("/ok") and hits["/busy"] == 3
    assert http_get(f"{base}/ok").status == 200


def test_cli(spark, server, tmp_path, capsys):
    from pagequery.cli import main

    base, _ = server
    path = tmp_path / "c.json"
    path.write_text(json.dumps({**LINKS, "url": f"{base}/ok"}))
    assert main([str(path), str(tmp_path / "out.jsonl")]) == 0
    assert json.loads((tmp_path / "out.jsonl").read_text())["h"] == f"{base}/x"
    assert main([]) == 2 and main(["--version"]) == 0 and main(["--example"]) == 0 and main([str(tmp_path / "absent.json")]) == 1


def test_sinks(spark, tmp_path):
    from pagequery.sinks import coerce_numbers, detect_format, engine_flat, flat, write, write_file

    df = spark.createDataFrame([(1, ["a", "b"], [], [True, None], 1.5, None), (2, ["x"], [], [True], 2.0, "q\"u,o\n")], "i long, l array<string>, e array<string>, b array<boolean>, d double, s string")
    engine = df.select(*[engine_flat(df[c], df.schema[c].dataType).alias(c) for c in df.columns]).orderBy("i").collect()
    assert tuple(engine[0]) == ("1", "a; b", "", "true; ", "1.5", "") and tuple(engine[1])[:5] == ("2", "x", "", "true", "2")
    plain = df.select(*[flat(df[c], df.schema[c].dataType).alias(c) for c in df.columns]).orderBy("i").collect()
    assert tuple(plain[0]) == (1, "a; b", None, "True; ", 1.5, None) and plain[1]["l"] == "x"
    for fmt in ("parquet", "csv", "jsonl", "txt"):
        write(df, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(str(tmp_path / "csv")).filter("i = '2'").first()["s"] == 'q"u,o\n'
    assert write_file(df, str(tmp_path / "one.json"))["records"] == 2 and len(json.loads((tmp_path / "one.json").read_text())) == 2
    assert write_file(df, str(tmp_path / "one.csv"), columns=["i", "zz"])["records"] == 2 and (tmp_path / "one.csv").read_text().startswith("i,zz\n1,\n")
    assert (detect_format("x.ndjson"), detect_format("x", "pq")) == ("jsonl", "parquet")
    with pytest.raises(ValueError):
        detect_format("x")
    mixed = spark.createDataFrame([(str(i), f"{i}.5", "a" if i < 5 else "1") for i in range(10)], "a string, b string, c string")
    assert [t for _, t in coerce_numbers(mixed).dtypes] == ["bigint", "double", "string"]


def test_sinks_read_back(spark, tmp_path):
    from pagequery import export_records
    from pagequery.sinks import json_lines, write, write_file

    df = spark.range(0, 10, 1, 3).selectExpr("id AS no", "cast(id AS string) AS word", "id / 8.0D AS part", "array(concat('m\"', id)) AS list", "id = 4 AS flag")
    write(df, str(tmp_path / "txt"), "txt", ["no", "word"])
    lines = [x for f in sorted((tmp_path / "txt").glob("part-*")) for x in f.read_text().split("\n")]
    assert [x for x in lines if x.startswith("---")] == [f"--- record {i} ---" for i in range(1, 11)]
    assert [x for x in lines if x.startswith("no: ")] == [f"no: {i}" for i in range(10)]
    write(df, str(tmp_path / "json"), "json")
    arrays = [json.loads(f.read_text()) for f in sorted((tmp_path / "json").glob("part-*.txt")) if f.read_text()]
    expected = [{"no": i, "word": str(i), "part": i / 8, "list": [f'm"{i}'], "flag": i == 4} for i in range(10)]
    assert sorted([r for a in arrays for r in a], key=lambda r: r["no"]) == expected
    write(df, str(tmp_path / "jsonl"), "jsonl")
    assert sorted([json.loads(x) for f in (tmp_path / "jsonl").glob("part-*") for x in f.read_text().splitlines()], key=lambda r: r["no"]) == expected
    assert json_lines(spark.sql("SELECT 2.0D AS d, cast(NULL AS string) AS s, cast('NaN' AS double) AS n")).first()[0] == '{"d": 2.0, "s": null, "n": null}'
    done = write_file(df, str(tmp_path / "one.parquet"))
    back = spark.read.parquet(str(tmp_path / "one.parquet"))
    assert done["records"] == 10 and dict(back.dtypes)["word"] == "bigint" and dict(back.dtypes)["list"] == "string" and back.count() == 10
    records = [{"m": 1, "n": ["a", "b"]}, {"m": 2, "k": None}]
    assert export_records(spark, records, str(tmp_path / "some.csv"))["records"] == 2
    assert (tmp_path / "some.csv").read_text() == "m,n,k\n1,a; b,\n2,,\n"


def test_scrape(spark, server, tmp_path, capsys):
    from pagequery import backend_info, scrape, scrape_file
    from pagequery.cli import main

    base, _ = server
    config = {"url_list": [f"{base}/ok", f"{base}/none"], "user_agent": "me", "queries": {
        "b": {"selector": "a", "extract": [{"name": "h", "rule": {"attribute": "href", "aggregate": "first"}}]},
        "a": {"selector": "a", "extract": [{"name": "h", "rule": {"text": True, "transform": ["int"]}}, {"name": "t", "rule": {"text": True, "aggregate": "first"}}]},
    }}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(config))
    found = scrape(spark, config)
    expected = [{"_url": f"{base}/{p}", "_status": s, **r} for p, s in (("ok", 200), ("none", 404)) for r in ({"h": [None], "t": "me"}, {"h": "/x"})]
    assert found.records == expected == scrape_file(spark, str(path)).records and found.stats.succeeded == 2
    assert found.to_dataframe(spark).columns == ["_url", "_status", "h", "t"] and found.to_dataframe(spark, coerce=True).count() == 4
    assert backend_info()["backend"] == "spark"
    assert main([str(path), str(tmp_path / "all.json")]) == 0
    assert json.loads((tmp_path / "all.json").read_text()) == [{k: r[k] for k in (*[k for k in r if k[0] != "_"], "_url", "_status")} for r in expected]
    path.write_text(json.dumps(config | {"output": {"format": "csv", "csv_fields": ["t", "h"]}}))
    assert main([str(path), str(tmp_path / "all.csv")]) == 0 and (tmp_path / "all.csv").read_text().splitlines()[0] == "t,h"
    assert main([str(path), str(tmp_path / "all.parquet")]) == 0 and spark.read.parquet(str(tmp_path / "all.parquet")).count() == 4


def test_odd_charset():
    from pagequery.sources.http import _decoded

    assert _decoded("ø".encode(), "no-such-name") == "ø" == _decoded("ø".encode("latin-1"), "latin-1")


def test_rate(spark, server):
    import time

    base, _ = server
    config = load_config({**LINKS, "url_list": [f"{base}/{i}" for i in range(6)], "limits": {"max_concurrent": 1, "requests_per_second": 4}})
    began = time.monotonic()
    assert fetch_pages(frontier(spark, config), config).count() == 6 and time.monotonic() - began >= 1.2


def test_stream(spark, tmp_path):
    from pagequery.streaming import extract_stream, new_urls, read_pages

    spark.createDataFrame([(1, "http://h/", '<a href="/x">'), (2, "http://h/", "<p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    stream = read_pages(spark, str(tmp_path / "in"))
    assert new_urls(stream.selectExpr("url", "current_timestamp() as ts")).isStreaming
    query = extract_stream(stream, LINKS).writeStream.format("memory").queryName("links").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["page_id"], r["h"]) for r in spark.table("links").orderBy("page_id").collect()] == [(1, "http://h/x"), (2, None)]


def test_sql_functions(spark):
    from pagequery.functions.register import register

    register(spark)
    assert spark.sql("SELECT tag FROM html_elements('<p><b>x</b>') ORDER BY seq").collect() == [("b",), ("p",)]
    assert spark.sql("SELECT url_host('http://u@h.org/x') h, ascii_lower('ÉA') l").first() == ("h.org", "Éa")


def test_sql_functions_are_the_builders(spark):
    from pyspark.sql import functions as F

    from pagequery.config import DEFAULT_CLEAN
    from pagequery.functions.htmltext import html_text
    from pagequery.functions.register import register
    from pagequery.functions.sieve import nulls, sieve
    from pagequery.functions.transforms import url_join

    assert register(spark) == ["html_elements", "url_host", "ascii_lower", "clean_text", "html_text", "url_join"]
    texts = [None, "", " it's \\ 'so' ", "<p>Oak &amp; <b>elm</b>&#8212;ash\n\t x</p>", "<script>1 < 2</script>left", "a&nbsp;&eacute;\u200bz", "<![CDATA[&amp;]]> &amp;", "/down?x=1", "?q", "//h.net/p", "mailto:x@y.z", "up one"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    rows.createOrReplaceTempView("sql_texts")
    base = "https://w.example/a/b?c"
    by_sql = spark.sql(f"SELECT clean_text(t), html_text(t), url_join('{base}', t) FROM sql_texts")
    t = F.col("t")
    assert "Python" not in by_sql._jdf.queryExecution().executedPlan().toString()
    assert by_sql.collect() == rows.select(nulls(sieve(t, DEFAULT_CLEAN), DEFAULT_CLEAN), html_text(t), url_join(F.lit(base), t)).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_combined_records(spark):
    from pagequery import Engine

    pages = spark.createDataFrame([(1, "u", "<p>1</p><b>x</b>")], "page_id long, url string, html string")
    config = {"queries": {"b": {"selector": "b", "extract": [{"name": "v", "rule": {"text": True}}]}, "a": {"selector": "p", "extract": [{"name": "v", "rule": {"text": True, "transform": ["int"]}}]}}}
    assert [(r["_name"], r["v"]) for r in Engine(config).records(pages).orderBy("_query").collect()] == [("a", '{"v":[1]}'), ("b", '{"v":["x"]}')]


def test_json_doubles_is_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    odd = [None, 0.0, -0.0, 0.49999999999999994, -0.49999999999999994, 5e-324, -5e-324, 999999999999999.4, 999999999999999.5, -1e15, 2.0**52 - 0.5, 2.0**52 + 1, 2.0**53 - 1, 9.3e18, -1e20, 1e23, float("nan"), float("inf"), float("-inf")]
    values = [i / 100 for i in range(-300, 301)] + odd
    spark.createDataFrame(list(enumerate(values)), "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = dict(map(tuple, e.queries()["json_doubles"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == dict(con.execute(e.oracle_sql()["json_doubles"]).fetchall())
    assert {values[i]: v for i, v in got.items() if i in (250, 251, 299, 301)} == {-0.5: "-1.0", -0.49: "-0.0", -0.01: "-0.0", 0.01: "0.0"}
    con.close()


def test_json_number_zero_and_null(spark):
    from pyspark.sql import functions as F

    from pagequery.functions.aggregates import json_number
    from pagequery.sinks import json_lines

    values = [-0.0, 0.0, None, -1500.0, 999999999999999.0, 1e15, float("nan"), float("-inf")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").coalesce(1)
    assert [r[0] for r in rows.select(json_number(F.col("x"))).collect()] == ["-0.0", "0.0", None, "-1500.0", "999999999999999.0", "1e+15", "null", "null"]
    assert [r["value"] for r in json_lines(rows.select("x")).collect()] == [f'{{"x": {v}}}' for v in ("-0.0", "0.0", "null", "-1500.0", "999999999999999.0", "1e+15", "null", "null")]
