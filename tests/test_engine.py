"""Unit tests of what the driver's tables can't cover: receivers of paths and names, ignore rules, areas, streams."""

import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.functions import digests, languages
from codeloom.functions import names as N
from codeloom.operators import areas, changes, graph, ranking, resolve, search
from codeloom.sources import ignore, python_source, snapshot
from codeloom.streaming import coalesce


def one(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_path_predicates(spark):
    paths = ["tests/a.py", "src/Project.Tests/a.cs", "src/test_a.py", "src/a_test.go", "src/a.spec.ts", "src/attest.py", "a/migrations/1.py", "a/x.g.cs", "a/x.min.js", "contest/x.py"]
    assert one(spark, paths, N.is_test_path("x")) == [True, True, True, True, True, False, False, False, False, False]
    assert one(spark, paths, N.is_generated_path("x")) == [False] * 6 + [True] * 3 + [False]
    assert one(spark, ["app/a", "application/a", "app", "APP/a"], N.in_scope("x", "app")) == [True, False, True, True]


def test_names(spark):
    assert one(spark, ["httpServer", "server_a", "my_server", "observer", "HTTPServer"], N.prefix_at_word_start("x", "server")) == [True, True, True, False, False]
    assert one(spark, ["parseHTTPBody", "http2", "xhttp", "HTTP"], N.subtoken_match("x", "http")) == [True, True, False, True]
    assert one(spark, ["OrderHandler", "Handler", "OrderService"], N.name_stem("x")) == ["Order", "Handler", "Order"]
    assert one(spark, ["foo_bar", "foo.bar2", "xfoo"], N.phrase_hit("x", "foo.bar")) == [True, True, False]
    assert one(spark, ["a/b/__init__.py", "a/c.py"], F.array_join(N.path_segments("x"), "|")) == ["a|b", "a|c"]
    assert one(spark, ["a::b/c", ".a"], F.array_join(N.import_segments("x"), "|")) == ["a|b|c", "a"]


def test_handles_and_continuations(spark):
    handle = digests.handle_of("id")
    assert one(spark, ["id", None], digests.symbol_handle(F.col("x")))[0] == handle
    token = f"c_{handle[2:]}@12:0123456789abcdef"
    rows = one(spark, [token, token.replace("@12", "@012"), "c_x@1:0"], digests.parse_continuation(F.col("x")))
    assert rows[0]["line"] == 12 and rows[0]["handle"] == handle and rows[1:] == [None, None]


def test_resolver_orders_its_evidence(spark):
    symbols = spark.createDataFrame([("1", "class", "Repo", "m.Repo"), ("2", "method", "save", "m.Repo.save"), ("3", "method", "save", "m.Cache.save"), ("4", "function", "lone", "n.lone"), ("5", "namespace", "ns", "ns")], "id string, kind string, name string, qualified_name string")
    refs = spark.createDataFrame([("a", "save", "m.Repo.save", None), ("b", "save", "Cache.save", None), ("c", "save", None, "m.Cache"), ("d", "lone", None, None), ("e", "save", None, None), ("f", "ns", None, None)], "ref_id string, to_name string, qualified_text string, scope_prefix string")
    got = {r["ref_id"]: (r["to_symbol_id"], r["resolution"]) for r in resolve.resolve(refs, symbols).collect()}
    assert got == {"a": ("2", "exact"), "b": ("3", "exact"), "c": ("3", "scoped"), "d": ("4", "unique-name"), "e": (None, "ambiguous"), "f": (None, "unresolved")}


def test_innermost_takes_the_shortest_span(spark):
    spans = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 10, 20), ("f", 3, 12, 20)], "file string, span_id int, start int, end int")
    points = spark.createDataFrame([("f", 1, 15), ("f", 2, 11), ("f", 3, 100), ("f", 4, 101), ("g", 5, 15)], "file string, point_id int, at int")
    assert {r[0]: r[1] for r in ranking.innermost(points, spans).collect()} == {1: 3, 2: 2, 3: 1, 4: None, 5: None}


def test_area_partition_splits_the_largest(spark):
    paths = [f"src/core/a{i}.py" for i in range(20)] + [f"src/ui/b{i}.py" for i in range(10)] + [f"docs/d{i}.md" for i in range(5)] + ["setup.py", "one/two/three.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = areas.areas_of(files)
    assert found == sorted(found) and len(found) <= areas.MOST and "src/core" in found and "docs" in found
    got = files.select(areas.area_of("path", found).alias("a")).groupBy("a").count().collect()
    assert sum(r["count"] for r in got) == len(paths) and all(r["a"] is not None for r in got)


def test_ignore_rules(spark):
    rules, problems = ignore.compile_rules("# c\nbuild/\n!build/keep.py\n*.min.js\n/dist\ndocs/**\n!docs/a.md\n/\n")
    assert [p[0] for p in problems] == [8]
    paths = ["build/x.py", "build/keep.py", "a/b.min.js", "dist/x", "a/dist/x", "docs/b.md", "docs/a.md", ".git/config", "a/.git/x", "src/x.py", "build"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r[0]: r[1] for r in df.select("path", ignore.is_ignored("path", rules)).collect()}
    assert got == {"build/x.py": True, "build/keep.py": True, "a/b.min.js": True, "dist/x": True, "a/dist/x": False, "docs/b.md": True, "docs/a.md": False, ".git/config": True, "a/.git/x": True, "src/x.py": False, "build": False}


def test_python_files_become_symbols_references_and_edges(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import os\n\nLIMIT = 3\n\nclass Repo:\n    def save(self, x):\n        return helper(x)\n\n\ndef helper(x):\n    return os.path.join(x)\n")
    (tmp_path / "pkg" / "b.py").write_text("from pkg.a import Repo\n\ndef use():\n    r = Repo()\n    return r.save(1)\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (:\n")
    parsed = python_source.parse(python_source.scan(spark, str(tmp_path), "*.py"))
    symbols, refs = python_source.symbols(parsed), python_source.raw_refs(parsed)
    names = {(r["kind"], r["qualified_name"]) for r in symbols.collect()}
    assert {("class", "pkg.a.Repo"), ("method", "pkg.a.Repo.save"), ("function", "pkg.a.helper"), ("constant", "pkg.a.LIMIT"), ("import", "pkg.b.Repo")} <= names
    edges = {(r["from_symbol_id"], r["to_name"], r["resolution"]) for r in resolve.relations(refs, symbols).where("kind = 'references'").collect()}
    assert any(n == "helper" and how == "unique-name" for _, n, how in edges)
    assert parsed.count() == 3


def test_snapshots_flip_their_pointer_last(spark, tmp_path):
    root = str(tmp_path / "index")
    a = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, content_hash string")
    first = snapshot.publish(spark, root, {"files": a})
    held = snapshot.read(spark, root, "files")
    b = snapshot.replaced(held, spark.createDataFrame([("b", "2"), ("c", "1")], "path string, content_hash string"), "path")
    second = snapshot.publish(spark, root, {"files": b})
    assert second > first and sorted(map(tuple, snapshot.read(spark, root, "files").collect())) == [("a", "1"), ("b", "2"), ("c", "1")]
    assert sorted(map(tuple, snapshot.read(spark, root, "files", version=first).collect())) == [("a", "1"), ("b", "1")]


def test_replaced_files_without_rows_lose_their_old_ones(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, id string")
    keys = spark.createDataFrame([("a",), ("b",)], "path string")
    assert sorted(map(tuple, snapshot.replaced(old, old.where("path = 'b'"), "path", keys).collect())) == [("b", "1"), ("c", "1")]


def test_suffixes_of_other_separators(spark):
    symbols = spark.createDataFrame([("1", "class", "C", "a::b::C"), ("2", "class", "D", "a\\D")], "id string, kind string, name string, qualified_name string")
    texts = lambda sep, i: {r["text"] for r in resolve.suffix_index(symbols.where(F.col("id") == i), sep).collect()}
    assert texts("::", "1") == {"a::b::C", "b::C", "C"} and texts("\\", "2") == {"a\\D", "D"}


def test_languages(spark):
    names = ["src/a.py", "x/App.component.html", ".component.html", "a.HPP", ".py", "Makefile", "a.unknown", "b.tar.rs"]
    want = ["python", "angular_template", None, "cpp", None, None, None, "rust"]
    assert [languages.detect(n) for n in names] == want and one(spark, names, languages.language_of("x")) == want
    assert one(spark, ["rust", "php", "python"], languages.separator_of("x")) == ["::", "\\", "."]
    assert len(languages.LANGUAGES) == len(set(languages.LANGUAGES)) == languages.dimension(spark).count()
    with pytest.raises(ValueError):
        languages.extension_map("one .x\ntwo .x")


def test_changes_and_journal(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {r[0]: r[1] for r in changes.changes(a, b).collect()} == {"a": "skip", "b": "reindex", "c": "remove", "d": "reindex"}
    journal = spark.createDataFrame([("intent", "1"), ("complete", "1"), ("intent", "2")], "type string, batch_id string")
    assert [r[0] for r in changes.unfinished(journal).collect()] == ["2"]


def test_stream_emits_a_path_once_a_burst(spark, tmp_path):
    feed, out = tmp_path / "feed", []
    feed.mkdir()
    schema = "kind string, path string, old_path string, ts timestamp, seq long"
    stream = coalesce.coalesced(coalesce.normalised(spark.readStream.schema(schema).json(str(feed))), 200, 1000)
    run = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").foreachBatch(lambda df, _: out.extend(map(tuple, df.select("path", "intent").collect()))).start()
    try:
        lines = [("create", "a", None, 1), ("modify", "a", None, 2), ("delete", "b", None, 3), ("rename", "c", "d", 4), ("overflow", None, None, 5), ("modify", "x.tmp", None, 6)]
        import json

        (feed / "1.json").write_text("\n".join(json.dumps({"kind": k, "path": p, "old_path": o, "ts": "2024-01-01T00:00:00Z", "seq": s}) for k, p, o, s in lines))
        end = time.time() + 90
        while len(out) < 4 and time.time() < end:
            time.sleep(0.5)
    finally:
        run.stop()
    assert sorted(out) == [("a", "reindex"), ("b", "remove"), ("c", "reindex"), ("d", "remove")]
    assert pytest and graph and search


def test_every_event_is_a_site_and_a_point(spark):
    import __spark_entry__ as entry
    from codeloom.plans import views

    data = "/root/testdata/sf0.001"
    events = [(r["user_id"], r["event_id"], math.floor(r["value"])) for r in views.read(spark, data, "events").collect()]
    holding = lambda u, at: [(e % 40, v, e) for x, e, v in events if x == u and v <= at <= v + e % 40]
    want = {e: min(holding(u, v + e % 7), default=(None,))[-1] for u, e, v in events}
    assert {r["point_id"]: r["span_id"] for r in entry.queries()["enclosing_interval_of_every_event"](spark, data).collect()} == want
    rebound = lambda u, e, v: any(x == u and f % 5 == e % 5 and f % 3 and w <= v + 3 <= w + 5 + f % 60 for x, f, w in events)
    assert {r["site_id"] for r in entry.queries()["rebound_sites_of_every_event"](spark, data).collect()} == {e for u, e, v in events if rebound(u, e, v)}
    assert {r["site_id"] for r in entry.queries()["declared_type_at_every_event"](spark, data).collect()} == {e for _, e, _ in events}


def test_imports_of_all_files(spark):
    import __spark_entry__ as entry
    from codeloom.plans import views

    data = "/root/testdata/sf0.001"
    want = {(r["page_id"], r["to_name"]) for r in views.imports(spark, data).collect()}
    got = entry.queries()["imports_for_all_files"](spark, data).collect()
    assert {r["page_id"]: r["n_names"] for r in got} == Counter(p for p, _ in want) and max(p for p, _ in want) >= 20


def test_small_top_level_directory_beside_many_larger_ones(spark):
    wide = spark.range(9**4 * 4).select(F.concat(F.lit("src"), *[x for k in range(4) for x in (F.lit("/d"), (F.col("id") / 4 / 9**k).cast("long") % 9)], F.lit("/f"), F.col("id") % 4).alias("path"))
    files = wide.unionAll(spark.createDataFrame([("docs/a.md",), ("docs/b.md",), ("docs/c.md",)], "path string"))
    found = areas.areas_of(files)
    assert "docs" in found and files.where(areas.area_of("path", found).isNull()).count() == 0


def test_depths_of_deep_nesting_and_cycles(spark):
    chain = spark.createDataFrame([(f"s{k:02}", f"s{k - 1:02}" if k else None) for k in range(19)], "id string, container_id string")
    assert {tuple(r) for r in ranking.depths(chain).collect()} == {(f"s{k:02}", k, "s00") for k in range(19)}
    with pytest.raises(ValueError):
        ranking.depths(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, container_id string"))


def test_enclosing_interval_of_ids_beyond_a_million(spark, tmp_path):
    """The SQL's rank adds the id to a million times the start, so a larger id can outweigh a smaller start."""
    import duckdb

    import __spark_entry__ as entry

    events = [(3_000_039, 7, 10.5), (39, 7, 12.5), (5_000_079, 7, 11.0), (1_000_000, 7, 12.0), (2_000_041, 8, 1.0), (4_000_000, 9, None)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    name = "enclosing_interval_of_every_event"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(entry.oracle_sql()[name]).fetchall())
    assert {r["point_id"]: r["span_id"] for r in entry.queries()[name](spark, str(tmp_path)).collect()} == want
    assert want[39] == 39 and want[4_000_000] is None
