"""Operators against small sequential models, and queries against their SQL."""

import glob
import os
import random

import pytest

from scholiast import queries as Q
from scholiast.operators import margin, select

SF = "/root/testdata/sf0.001"
SQL = ["clean_text", "tokenize", "selected_quote", "sentence_candidates", "note_body", "equation_fields", "repair_json", "response_text", "symbol_map", "headings", "section_titles", "references", "candidate_blocks", "equation_like", "align_exact", "equation_contexts", "neighbour_contexts", "key_ideas_by_rank", "key_ideas_by_model", "page_cap", "rebalance", "note_placement", "equation_rows", "job_progress", "progress_case", "job_views"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(map(plain, r)) for r in got), key=key) == sorted((tuple(map(plain, r)) for r in want), key=key)


def test_entry(spark):
    import __spark_entry__

    import duckdb

    from scholiast.operators.align import exact_alignment

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = __spark_entry__.entry(spark)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()['align_exact']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert exact_alignment(*(spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark")), least=5).count() == 8


def place_one_by_one(notes, width, page_height, most):
    """The layout rule read literally: place, push down, shift up, pack."""
    room, out, cursor = page_height - 24, [], 24.0
    for n in sorted(notes, key=lambda n: (n["anchor_y"], n["priority"], n["note_id"]))[:most]:
        h = n["h"]
        y = max(cursor, max(24.0, min(n["anchor_y"] - h / 2, room - h)))
        out.append([n["note_id"], y, h])
        cursor = y + h + 12
    over = max(0.0, out[-1][1] + out[-1][2] - room) if out else 0
    for o in out:
        o[1] -= over
    if over and out[0][1] < 24:
        cursor, fit = 24.0, []
        for i, _, h in out:
            if cursor + h > room:
                break
            fit.append([i, cursor, h])
            cursor += h + 12
        out = fit
    return {i: round(y, 6) for i, y, _ in out}


def test_margin_layout(spark):
    rnd = random.Random(1)
    rows = [(p, f"n{p}-{i}", "t", "b" * rnd.randrange(400), rnd.randrange(2), rnd.uniform(0, 800), False, 0) for p in range(40) for i in range(rnd.randrange(1, 7))]
    df = spark.createDataFrame(rows, "page int, note_id string, title string, body string, priority int, anchor_y double, has_latex boolean, symbols int")
    got = {}
    for r in margin.place(df, ["page"], 220.0, 792.0, 5).collect():
        got.setdefault(r["page"], {})[r["note_id"]] = round(r["y0"], 6)
    for p in range(40):
        own = [{"note_id": r[1], "priority": r[4], "anchor_y": r[5], "h": 22 + 14 + max(3, -(-len(r[3]) // 38) + 1) * 12} for r in rows if r[0] == p]
        assert got.get(p, {}) == place_one_by_one(own, 220.0, 792.0, 5)


def test_page_cap(spark):
    rnd = random.Random(2)
    rows = [(p, rnd.choice("abcd"), i) for p in range(60) for i in range(rnd.randrange(8))]
    got = {}
    for r in select.page_cap(spark.createDataFrame(rows, "page int, block string, pos int"), 3, ["page"], "block", "pos").collect():
        got.setdefault(r["page"], set()).add(r["pos"])
    for p in range(60):
        own = [(b, i) for q, b, i in rows if q == p]
        first = [i for k, (b, i) in enumerate(own) if b not in [x for x, _ in own[:k]]]
        want = {i for _, i in own} if len(own) <= 3 else set(first[:3]) if len(first) >= 3 else {i for _, i in own[:3]}
        assert got.get(p, set()) == want


def test_progress_stream(spark, tmp_path):
    from scholiast.sources import stores
    from scholiast.streaming import progress

    rows = [("j", 0, "request", "key_idea_extraction"), ("j", 1, "response", "key_idea_extraction"), ("j", 2, "request", "equation_selection"), ("k", 0, "selection_skip", None)]
    e = spark.createDataFrame(rows, "job_id string, seq long, type string, prompt_name string")
    stores.append_trace(e, str(tmp_path / "t"))
    q = progress.fold(stores.stream_trace(spark, str(tmp_path / "t"))).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("progress").collect()
    assert [(r["job_id"], r["progress_percent"], r["started_steps"]) for r in got] == [("j", 65, 2)]
    assert progress.fold(stores.read_trace(spark, str(tmp_path / "t"))).collect()[0]["message"] == got[0]["message"]


def test_plan_with_trace_and_drawings(spark, tmp_path):
    from scholiast.plans import highlight as H
    from scholiast.plans.scorer import OfflineScorer, TracedScorer
    from scholiast.schema import PLAN
    from scholiast.sources import layout, stores
    from scholiast.streaming import progress

    b = layout.document_blocks(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 3"))
    plan = H.build(b, layout.words(b), TracedScorer(OfflineScorer(), str(tmp_path / "trace"), "job", strict=True))
    m = H.manifest(plan).groupBy().sum("highlights", "notes").first()
    assert m[0] >= 1 and m[1] >= 1
    assert spark.createDataFrame(plan.rdd, PLAN).count() == plan.count()
    stores.write_json(plan, str(tmp_path / "plan"))
    stored = stores.read_plan(spark, str(tmp_path / "plan"), PLAN)
    assert sorted(map(str, stored.collect())) == sorted(map(str, plan.select(*stored.columns).collect()))

    events = stores.read_trace(spark, str(tmp_path / "trace"))
    kinds = {r["type"]: r["count"] for r in events.groupBy("type").count().collect()}
    assert kinds["request"] == kinds["response"] >= 3 and events.select("seq").distinct().count() == events.count()
    assert progress.fold(events).first()["completed_steps"] == kinds["response"]

    pages = b.select("doc_id", "page_number", "page_width", "page_height").distinct()
    drawn = H.drawings(stored, pages).collect()
    notes = {n["note_id"] for r in stored.collect() for p in r["pages"] for n in p["notes"]}
    assert drawn and {r["note_id"] for r in drawn} <= notes
    assert all(24 <= r["y0"] < r["y1"] <= 792 - 24 and r["width"] == 832 and r["y0"] <= r["connector"]["y1"] <= r["y1"] for r in drawn)


def test_unreadable_answers_fail_a_strict_run(spark, tmp_path):
    from pyspark.sql import functions as F

    from scholiast.plans.scorer import Scorer, TracedScorer
    from scholiast.sources import stores

    class Mumbling(Scorer):
        def __call__(self, requests):
            return requests.withColumn("answer", F.lit("well, ...")).withColumn("error", F.lit(None).cast("string"))

    asked = spark.createDataFrame([("1", "note_generation", "{}")], "request_id string, task string, payload string")
    assert TracedScorer(Mumbling(), str(tmp_path / "t"), "j")(asked).count() == 1
    with pytest.raises(ValueError, match="1 answers of note_generation"):
        TracedScorer(Mumbling(), str(tmp_path / "t"), "j", strict=True)(asked)
    assert stores.read_trace(spark, str(tmp_path / "t")).where("type = 'response'").count() == 2


def test_endpoint(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from scholiast.plans.scorer import HttpScorer, answers

    class Handler(BaseHTTPRequestHandler):
        def _say(self, what):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(what).encode())

        def do_GET(self):
            self._say({"data": [{"id": "m"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert asked["model"] == "m" and "PAYLOAD_JSON_START" in asked["messages"][1]["content"]
            self._say({"choices": [{"message": {"content": '<think>x</think>{"notes":[{"highlight_id":"h","title":"t","body":"b","confidence":1}]}'}}]})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert HttpScorer(url, "m").models() == ["m"]
        with pytest.raises(RuntimeError):
            HttpScorer(url, "other").models()
        asked = spark.createDataFrame([("1", "note_generation", "{}")], "request_id string, task string, payload string")
        assert answers(HttpScorer(url, "m")(asked), "note_generation").first()["parsed"]["notes"][0]["title"] == "t"
    finally:
        server.shutdown()
    lost = HttpScorer("http://127.0.0.1:9", "m")(asked).first()
    assert lost["answer"] is None and lost["error"]


def test_job_log(spark, tmp_path):
    from scholiast.sources import stores
    from scholiast.streaming import progress

    path = str(tmp_path / "jobs")
    new = spark.createDataFrame([("a", "x.pdf", "t", "queued", None, "1", "1", None), ("b", "y.pdf", "u", "queued", None, "2", "2", None)], stores.JOB)
    stores.append_jobs(new, path)
    stores.append_jobs(stores.changed(new, "running", "3"), path)
    stores.append_jobs(stores.changed(new.where("job_id = 'a'"), "failed", "4", "no text"), path)
    stores.append_jobs(stores.changed(new.where("job_id = 'b'"), "deleted", "5"), path)
    assert [(r["job_id"], r["status"], r["error"]) for r in stores.current(spark, path).collect()] == [("a", "failed", "no text")]
    states = progress.transitions(spark.read.schema(stores.JOB).json(path).where("job_id = 'a'"))
    assert [r["valid"] for r in states.orderBy("updated_at").collect()] == [True, True, True]
    assert stores.job_paths("/jobs/", "a")["trace"] == "/jobs/a/work/trace" and stores.run_paths("w")["plan"] == "w/plan"


def test_small_text_functions(spark):
    from pyspark.sql import functions as F

    from scholiast.functions import text as T

    row = spark.range(1).select(
        T.has_content(F.lit(0)).alias("a"),
        T.has_content(F.lit(5)).alias("b"),
        T.has_content(F.lit(None).cast("long")).alias("c"),
        T.plan_path(F.lit("out/"), F.lit("A Title: Of Two")).alias("d"),
        (T.latex_key(F.lit("$x$"), F.lit(10), F.lit("red")) == T.latex_key(F.lit(" x "), F.lit(10), F.lit("red"))).alias("e"),
        (T.latex_key(F.lit("x"), F.lit(11), F.lit("red")) == T.latex_key(F.lit("x"), F.lit(10), F.lit("red"))).alias("f"),
    ).first()
    assert tuple(row) == (False, True, False, "out/a-title-of-two.annotated.pdf", True, False)


def test_web_blocks_have_all_their_text(spark):
    from scholiast.sources import layout

    html = "<html><head><title>A &amp; B</title><script>var x='<p>no</p>'</script></head><body><!-- <p>no</p> --><h1>Top</h1><div>out</div><p>one <b>two</b><br>three <a href='x'>four</a></p><ul><li><i>five</i> six<li>seven</ul> tail <p class=x>eight"
    got = layout.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("block_pos").collect()
    assert [r["text"].strip() for r in got] == ["A &amp; B", "Top", "one two three four", "five six", "seven", "eight"]
    assert [r["font"] for r in got] == [20.0, 20.0, 10.0, 10.0, 10.0, 10.0]


def test_profile():
    from scholiast.plans.highlight import Profile

    with pytest.raises(ValueError):
        Profile(density="dense")
