import json

import pytest
from pyspark.sql import functions as F

from unitgraph.config import Settings
from unitgraph.functions import columns as C
from unitgraph.operators import graph as G
from unitgraph.operators import retrieval as R
from unitgraph.operators import rows
from unitgraph.operators import service as S
from unitgraph.plans import embedding, impact, scan, search
from unitgraph.plans.store import FILE, Store
from unitgraph.queries import sources as INLINE
from unitgraph.sources import diffs
from unitgraph.sources.files import scan_tree
from unitgraph.streaming import watch
from unitgraph.streaming.state import accumulated

HASHES = "repo_id bigint, file_path string, hash string"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "lib" / "repo +1"
    for name, text in {"src/A.java": INLINE.JAVA_A, "src/web/cart.JS": INLINE.JS, "lib/x.java": "class X {}", "src/jquery.min.js": "x", "README.md": "x", "conf/beans.xml": INLINE.BEANS, "empty.java": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan_tree(spark, tree):
    got = {r.file_path: (r.language, r.size) for r in scan_tree(spark, str(tree), 7).collect()}
    assert set(got) == {"src/A.java", "src/web/cart.JS", "conf/beans.xml"} and got["src/web/cart.JS"][0] == "javascript"


def test_scan_and_apply(spark, tree):
    none = spark.createDataFrame([], HASHES)
    first = scan.scan(spark, str(tree), 7, none, embedding.HashingEmbedder(32))
    units = first.units.cache()
    assert units.count() == 7 + 7 + 3
    assert first.vectors.groupBy("collection").count().count() == 2
    hashes = first.files.select("repo_id", "file_path", "hash").union(spark.createDataFrame([(7, "gone.java", "0")], HASHES)).cache()
    hashes.count()
    (tree / "src/A.java").write_text("class A { void only(int a) { run(a);\n go(); } }")
    second = scan.scan(spark, str(tree), 7, hashes)
    assert [r.file_path for r in second.changed.collect()] == ["src/A.java"] and [r.file_path for r in second.gone.collect()] == ["gone.java"]
    stored = scan.apply_scan(units, second.units, second)
    assert sorted(r.qualified_name for r in stored.where("language = 'java'").collect()) == ["A#only"]
    assert {r.callee for r in second.edges.collect()} == {"run", "go"}


def test_bfs_rules(spark):
    """Cycles, self-calls, short and general names, the cap."""
    pairs = [("p.A#first", "second"), ("p.B#second", "p.A#first"), ("p.A#first", "first"), ("p.C#x", "abcd"), ("p.D#y", "abcde"), ("p.E#z", "update"), ("p.E#z", "p.U#update")] + [(f"n{i:03d}", "hub") for i in range(250)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "caller string, callee string, call_line int")
    starts = spark.createDataFrame([(x,) for x in ("p.A#first", "q#abcd", "q#abcde", "p.U#update", "hub", "nobody")], "start_qn string")
    got = {}
    for r in G.upstream(starts, edges).collect():
        got.setdefault(r.start_qn, {})[r.qualified_name] = r.depth
    assert got["p.A#first"] == {"p.A#first": 0, "p.B#second": 1}
    assert got["q#abcd"] == {"q#abcd": 0} and got["q#abcde"] == {"q#abcde": 0, "p.D#y": 1}
    assert got["p.U#update"] == {"p.U#update": 0, "p.E#z": 1} and got["nobody"] == {"nobody": 0}
    assert len(got["hub"]) == 200 and max(got["hub"]) == "n198"
    deep = spark.createDataFrame([(f"c{i + 1}", f"c{i}", 1) for i in range(6)], "caller string, callee string, call_line int")
    one = spark.createDataFrame([("c0",)], "start_qn string")
    assert {r.qualified_name for r in G.upstream(one, deep).collect()} == {"c0", "c1", "c2", "c3"}
    assert G.upstream(one, deep, Settings(max_nodes=3)).count() == 3


def test_impact_of_diff(spark):
    diff = "diff --git a/src/A.java b/src/A.java\n--- a/src/A.java\n+++ b/src/A.java\n@@ -1,2 +3,4 @@ x\n+y\n@@ -9 +8 @@\ndiff --git a/B.JS b/B.JS\nnew file mode 100644\n--- /dev/null\n+++ b/B.JS\n@@ -0,0 +1,3 @@\ndiff --git a/n.txt b/n.txt\n+++ b/n.txt\n"
    frame = spark.createDataFrame([(0, diff), (1, diff.replace("+3,4", "+90,1"))], "ordinal int, diff string")
    files = {r.file_path: r for r in diffs.changed_files(frame).collect()}
    assert set(files) == {"src/A.java", "B.JS"} and files["B.JS"].change_type == "added"
    assert [tuple(x) for x in files["src/A.java"].line_ranges] == [(3, 7), (8, 9)]
    units = spark.createDataFrame([("src\\A.java", "a#one", 1, 2), ("src/A.java", "a#two", 7, 7), ("src/A.java", "a#three", 10, 12), ("B.JS", "b", 1, 1)], "file_path string, qualified_name string, start_line int, end_line int")
    units = units.withColumn("signature", F.col("qualified_name")).withColumn("language", F.lit("java")).withColumn("body_text", F.lit("b"))
    edges = spark.createDataFrame([("x", "a#two", 5), ("y", "x", 6)], "caller string, callee string, call_line int")
    out = {r.start_qn: r for r in impact.impact_of_diff(frame, units, edges).collect()}
    assert set(out) == {"a#two", "b"} and [(n.depth, n.qualified_name, n.call_line) for n in out["a#two"].impact_chain] == [(1, "x", 5), (2, "y", 0)]
    assert out["b"].impact_chain == [] and out["a#two"].changed.start_line == 7
    exact = G.units_of_hunks(units, spark.createDataFrame([("src/A.java", 3, 7)], "file_path string, r_start int, r_end int"), exact_end=True)
    assert exact.count() == 0
    with pytest.raises(ValueError):
        impact.impact_of_diff(frame, units, edges, mode="between")


def test_search(spark, tree):
    units = scan.scan(spark, str(tree), 7, spark.createDataFrame([], HASHES), embedding.HashingEmbedder(64))
    queries = spark.createDataFrame([(1, "add an item to the cart"), (2, "isEmpty"), (3, "")], "query_id bigint, query string")
    got = search.search(queries, units.units, units.vectors, embedding.HashingEmbedder(64)).collect()
    best = {r.query_id: r.qualified_name for r in got if r.final_place == 1}
    assert best[1] == "com.acme.shop.Cart#addItem" and best[2] == "Cart.isEmpty"
    assert max(r.final_place for r in got) <= 5


def test_column_rules(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    lit = F.lit
    assert value(C.contains_like(lit("Äbc_X"), lit("BC_x"))) and not value(C.contains_like(lit("Äbc"), lit("ä"))) and value(C.contains_like(lit("a\\b"), lit("a\\b")))
    assert value(C.language_of(lit("a/b.JSP"))) == "jsp" and value(C.language_of(lit("a/.java"))) is None
    assert value(C.third_party(lit("src/Interface.java"), lit("java"), lit(10))) and not value(C.third_party(lit("src/Order.java"), lit("java"), lit(10)))
    assert value(C.third_party(lit("a.js"), lit("javascript"), lit(512001))) and not value(C.third_party(lit("WebContent/static/a.jsp"), lit("jsp"), lit(1)))
    assert value(C.display_name(lit("a.b.C#m"))) == "C#m" and value(C.display_name(lit("a.b.c"))) == "b.c"
    assert value(C.percent(lit(5), lit(3))) == 100 and value(C.percent(lit(1), lit(0))) == 0 and value(C.percent(lit(1), lit(3))) == 33
    assert value(C.embeddable(lit("method"), lit("getX"), lit("{\n x\n}"), lit(0))) and not value(C.embeddable(lit("method"), lit("getX"), lit("{ x\n}"), lit(0)))
    assert value(C.embeddable(lit("method"), lit("run"), lit("{ x }"), lit(1))) and not value(C.embeddable(lit("el_expression"), lit("run"), lit("a\nb\nc"), lit(1)))
    assert [tuple(x) for x in value(C.hunk_ranges(lit("@@ -1,2 +3,4 @@\n@@ -9 +8 @@\n@@ -5,3 +5,0 @@")))] == [(3, 7), (8, 9), (5, 5)]
    assert value(C.fingerprint(lit("a  b"), lit("\n c "))) == value(C.fingerprint(lit("a b"), lit(" c")))


def test_service_tables(spark):
    log = spark.createDataFrame([(1, 0, "read"), (1, 1, "pending"), (1, 2, "done"), (1, 3, "error"), (1, 4, "read"), (2, 1, "pending"), (2, 2, "read")], "k int, seq int, status string")
    assert {r.k: (r.status, r.hit_count) for r in S.cache_state(log, ["k"]).collect()} == {1: ("done", 1), 2: ("pending", 0)}
    terms = R.keywords(spark.createDataFrame([(1, "如何判空 foo")], "query_id int, query string"), R.term_table(spark))
    assert {r.word for r in terms.collect()} == {"foo", "empty", "null", "blank", "isEmpty", "isNull", "isBlank"}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, rows.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_generate(spark):
    class Client:
        def generate(self, prompt):
            if prompt == "bad":
                raise RuntimeError("down")
            return prompt.upper()

    got = {r.prompt: (r.answer, r.error) for r in embedding.generate(spark.createDataFrame([("a",), ("bad",)], "prompt string"), Client).collect()}
    assert got == {"a": ("A", None), "bad": ("", "down")}


def test_streamed_bursts_are_the_batch(spark, tmp_path):
    times = [0, 0.5, 1.4, 2.9, 5.0, 5.2, 30, 60, 200]
    rows_ = [{"seq": i, "ts": f"2024-01-01T00:{int(t // 60):02d}:{t % 60:06.3f}Z", "path": f"src/F{i % 3}.{'java' if i != 5 else 'txt'}", "kind": "modified"} for i, t in enumerate(times)]
    (tmp_path / "in").mkdir()
    for i in range(0, len(rows_), 3):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows_[i : i + 3])))
    stream = watch.bursts(watch.event_stream(spark, str(tmp_path / "in"), 1))
    q = stream.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r.first_ts), r.events, tuple(r.paths)) for r in spark.table("bursts").collect()}
    batch = spark.read.schema(watch.WATCH_EVENTS).json(str(tmp_path / "in")).where(watch.watched(F.col("path")))
    want = {(str(r.first_ts), r.events, tuple(r.paths)) for r in S.debounced(batch).collect()}
    assert got <= want and len(got) >= len(want) - 1


def test_watch_loop(spark, tmp_path):
    """Two bursts on one file: the second is compared with what the first left, and a clear empties the accumulated changes."""
    event = lambda seq, at: json.dumps({"seq": seq, "ts": f"2024-01-01T00:{at}:00Z", "path": "A.java", "kind": "modified"})
    (tmp_path / "in").mkdir()
    (tmp_path / "clears").mkdir()
    (tmp_path / "in" / "1.json").write_text(event(1, "00") + "\n" + event(2, "10"))
    schema = "repo_id bigint, file_path string, qualified_name string, name string, signature string, body_text string, start_line int, end_line int, language string"
    stored = spark.createDataFrame([(1, "A.java", "A#run", "run", "run()", "old", 1, 2, "java"), (1, "A.java", "A#same", "same", "same()", "x", 3, 4, "java"), (1, "B.java", "B#main", "main", "main()", "y", 1, 1, "java")], schema)
    edge_schema = "repo_id bigint, file_path string, caller string, callee string, call_line int"
    edges = spark.createDataFrame([(1, "B.java", "B#main", "A#run", 3), (1, "A.java", "A#old", "A#run", 9)], edge_schema)
    bodies = iter(["new", "newer", "newer"])

    def reparse(paths):
        body = next(bodies)
        units = stored.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").withColumn("body_text", F.when(F.col("name") == "run", body).otherwise(F.col("body_text")))
        files = paths.select(F.lit(1).cast("bigint").alias("repo_id"), F.col("path").alias("file_path"))
        return watch.Parsed(files, units, spark.createDataFrame([(1, "A.java", "A#same", "A#run", 4)], edge_schema), files.withColumn("hash", F.lit(body)))

    store = Store(spark, str(tmp_path / "store"), {"units": schema, "edges": edge_schema, "hashes": HASHES}, buckets=4)
    store.replace(stored.select(*FILE), {"units": stored, "edges": edges})
    out = []
    log = watch.ProgressLog()
    spark.streams.addListener(log)

    def sink(chains, batch):
        out.append([(r.start_qn, [n.qualified_name for n in r.impact_chain]) for r in chains.collect()])
        watch.frame_sink(str(tmp_path / "frames"))(chains, batch)

    def run():
        stream = watch.bursts(watch.event_stream(spark, str(tmp_path / "in")))
        watch.watch_loop(stream, store, reparse, str(tmp_path / "changes"), str(tmp_path / "cp")).awaitTermination(180)
        operations = watch.change_stream(spark, str(tmp_path / "changes"), str(tmp_path / "clears"))
        watch.report_loop(operations, store, sink, str(tmp_path / "cp2"), slices=2).awaitTermination(180)

    run()
    spark.streams.removeListener(log)
    assert out[-1] == [("A#run", ["A#same", "B#main"])]
    names = lambda: [(r.qualified_name, r.change) for r in accumulated(spark, str(tmp_path / "cp2")).collect()]
    assert names() == [("A#run", "modified")]
    units = {(r.qualified_name, r.body_text) for r in store.read("units").collect()}
    assert len(units) == 3 and ("B#main", "y") in units and ("A#run", "old") not in units
    assert {(r.caller, r.callee) for r in store.read("edges").collect()} == {("B#main", "A#run"), ("A#same", "A#run")}
    assert [r.hash for r in store.read("hashes").collect()][0].startswith("new")
    assert any(json.loads(r.value.removeprefix("data: "))["start_qn"] == "A#run" for r in spark.read.text(str(tmp_path / "frames")).where("value != ''").collect())
    # the repository is cleared, and what comes next is the same text: nothing is accumulated
    (tmp_path / "clears" / "1.json").write_text(json.dumps({"repo_id": 1, "seq": 1704067200_000000 + 40 * 60 * 1_000_000}))
    bodies = iter([store.read("units").where("name = 'run'").first().body_text] * 3)
    (tmp_path / "in" / "2.json").write_text(event(3, "30") + "\n" + event(4, "50"))
    version = store.versions()[-1]
    run()
    assert names() == [] and out[-1] == [] and store.versions()[-1] > version
    # a batch that is part of the store already isn't done again
    version = store.versions()[-1]
    assert store.replace(stored.select(*FILE), {"units": stored.limit(0)}, (f"watch:{tmp_path / 'cp'}", 0)) == [] and store.versions()[-1] == version


def test_git_diffs(spark, tmp_path):
    import shutil
    import subprocess

    if not shutil.which("git"):
        pytest.skip("git isn't there")
    git = lambda *args: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "A.java").write_text("class A {\n}\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "A.java").write_text("class A {\n int x;\n}\n")
    git("commit", "-qam", "two")
    (tmp_path / "A.java").write_text("class A {\n int x;\n int y;\n}\n")
    (tmp_path / "B.js").write_text("f();\n")
    git("add", "B.js")
    changed = lambda *args: {r.file_path: [tuple(x) for x in r.line_ranges] for r in diffs.changed_files(diffs.git_diffs(spark, str(tmp_path), *args)).collect()}
    assert changed() == {"A.java": [(1, 5)], "B.js": [(1, 2)]}
    assert changed("between", "HEAD~1", "HEAD") == {"A.java": [(1, 4)]} == changed("recent")
    with pytest.raises(ValueError):
        diffs.git_diffs(spark, str(tmp_path), "between")


def test_save_scan(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"), scan.TABLES, buckets=8)
    first = scan.scan(spark, str(tree), 7, store.read("hashes"), embedding.HashingEmbedder(16))
    assert scan.save_scan(store, first)
    sizes = {name: store.read(name).count() for name in scan.TABLES}
    assert sizes["units"] == 7 + 7 + 3 and sizes["hashes"] == 3 and sizes["vectors"] and sizes["edges"]
    assert scan.save_scan(store, scan.scan(spark, str(tree), 7, store.read("hashes"))) == [] and len(store.versions()) == 1
    (tree / "src/web/cart.JS").unlink()
    (tree / "src/A.java").write_text("class A { void only(int a) { run(a);\n go(); } }")
    written = scan.save_scan(store, scan.scan(spark, str(tree), 7, store.read("hashes"), embedding.HashingEmbedder(16)))
    assert 1 <= len(written) <= 2
    assert sorted({r.file_path for r in store.read("units").collect()}) == ["conf/beans.xml", "src/A.java"] == sorted(r.file_path for r in store.read("hashes").collect())
    assert {r.callee for r in store.read("edges").where("file_path = 'src/A.java'").collect()} == {"run", "go"}
    assert store.read("units", version=0).count() == sizes["units"]


def test_counts_and_autocomplete(spark):
    assert R.count_or_error(lambda: spark.read.parquet("/nowhere/at/all")) == -1 and R.count_or_error(lambda: spark.range(3)) == 3
    units = spark.createDataFrame([(f"p.C#m{i:02d}", f"m{i:02d}") for i in range(60)], "qualified_name string, name string")
    assert R.autocomplete(units, " M0 ", 5).count() == 5 and R.autocomplete(units, "\t ").count() == 0 and R.autocomplete(units, "c#m", 99).count() == 50


def test_keyword_batches_agree(spark, monkeypatch):
    rng = __import__("random").Random(3)
    units = spark.createDataFrame([(f"q{i:03d}", " ".join(rng.choice(["Alpha", "be_ta", "ga%mma", "d\\elta", "x"]) for _ in range(4))) for i in range(80)], "qualified_name string, summary string")
    words = spark.createDataFrame([(q, w) for q in range(6) for w in rng.sample(["alph", "e_t", "a%m", "d\\e", "Q00", "q_1", "nothing"], 3)], "query_id bigint, word string")
    whole = sorted(map(tuple, R.keyword_hits(units, words, 7).collect()))
    match = F.exists("words", lambda w: C.contains_like(F.col("qualified_name"), w) | C.contains_like(F.col("summary"), w))
    plain = units.join(words.groupBy("query_id").agg(F.collect_set("word").alias("words")), match).collect()
    want = sorted((*r[:2], q) for q in range(6) for r in sorted((x for x in plain if x.query_id == q), key=lambda x: x.qualified_name)[:7])
    assert whole == want
    monkeypatch.setattr(R, "WORD_BATCH", 2)
    assert sorted(map(tuple, R.keyword_hits(units, words, 7).collect())) == want
    assert R.keyword_hits(units, words.limit(0)).count() == 0


def test_scan_summary(spark):
    units = spark.createDataFrame([(1, "a", "q1", 5), (1, "a", "q2", 5), (1, "b", "q3", 4), (2, "a", "q4", 1), (3, "a", "q5", 1), (4, "a", "q6", None), (9, "a", "q7", 5)], "repo_id int, file_path string, qualified_name string, scan_id bigint")
    scans = spark.createDataFrame([(1, 5, False), (2, 5, False), (3, 5, None), (4, 5, True), (5, 5, True)], "repo_id int, scan_id bigint, force boolean")
    vectors = spark.createDataFrame([(1, 7), (3, 2)], "repo_id int, n bigint")
    got = {r.repo_id: (r.updated_units, r.updated_files, r.mode) for r in S.scan_summary(units, scans, vectors).collect()}
    assert got == {1: (2, 1, "updated"), 2: (1, 1, "rebuild"), 3: (0, 0, "none"), 4: (1, 1, "rebuild"), 5: (0, 0, "none")}
    assert {r.qualified_name for r in S.units_to_embed(units, scans, vectors).collect()} == {"q1", "q2", "q4", "q6"}
    assert S.scan_summary(units.limit(0), scans.limit(0), vectors).count() == 0
