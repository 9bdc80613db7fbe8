import json
import tarfile
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from kbspark.operators import events as E
from kbspark.operators import ingest as I
from kbspark.operators import quality as Q
from kbspark.sources import readers as R
from kbspark.streaming import jobs as J
from kbspark.streaming import state


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_text_tree(spark, tmp_path):
    for name in ("README.md", "src/a.py", "docs/deep/x.bin", "docs/deep/x.rst", ".hidden/a.md", "node_modules/b.js", "uv.lock", "x.meta.json", "empty.jsonl", "chat.jsonl", "big.txt"):
        put(tmp_path / "tree" / name, "" if name == "empty.jsonl" else "x" * (600_000 if name == "big.txt" else 3))
    assert {r.path for r in R.read_text_tree(spark, str(tmp_path / "tree")).collect()} == {"README.md", "src/a.py", "docs/deep/x.rst", "chat.jsonl"}
    assert {r.path for r in R.read_text_tree(spark, str(tmp_path / "tree"), scope="docs").collect()} == {"README.md", "docs/deep/x.rst"}


def test_transcripts(spark, tmp_path):
    lines = [{"type": "human", "message": {"content": "hi"}, "timestamp": "2024-01-01T00:00:00Z"}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "yes"}, {"type": "tool_use", "name": "grep"}]}}, {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "grep"}]}}, {"role": "user", "content": "two"}, {"role": "user", "content": " "}]
    put(tmp_path / "t/s1.jsonl", "\n".join(map(json.dumps, lines)) + "\nnot json\n")
    assert [(r.session, r.role, r.content) for r in R.read_transcripts(spark, str(tmp_path / "t")).orderBy("seq").collect()] == [("s1", "user", "hi"), ("s1", "assistant", "yes\n[tool: grep]"), ("s1", "user", "two")]
    put(tmp_path / "m/s2.md", "intro\n## Human\nhello\n\nthere\n## Assistant\nyes")
    assert [(r.role, r.content) for r in R.markdown_transcripts(spark, str(tmp_path / "m")).orderBy("seq").collect()] == [("user", "hello\n\nthere"), ("assistant", "yes")]


def test_logs_and_sidecars(spark, tmp_path):
    put(tmp_path / "l/a.jsonl", "\n".join(json.dumps({"ts": f"2024-01-0{i}", "event": "e", "run_id": f"r{i % 2}"}) for i in range(1, 6)) + "\n{bad\n")
    assert [r.ts for r in R.read_logs(spark, str(tmp_path / "l"), run_id="r1", tail=2).collect()] == ["2024-01-05", "2024-01-03"]
    put(tmp_path / "s/p.json", json.dumps({"page": "wiki/p.md", "beliefs": [{"statement": "a", "topic": "t", "footnote_ids": ["1"]}]}))
    assert [tuple(r)[:3] for r in R.read_sidecars(spark, str(tmp_path / "s"), "w").collect()] == [("w", "wiki/p.md", "a")]


def test_feeds_mail_archives(spark, tmp_path):
    put(tmp_path / "f/a.xml", '<rss><channel><item><guid>g1</guid><title>T</title><link>http://a</link><description>Subscribe to read [x](javascript:y)</description><category>c</category></item></channel></rss>')
    put(tmp_path / "f/b.xml", '<feed><entry><id>e1</id><title>U</title><summary>s</summary><content>body</content><link href="http://b"/><updated>2024-01-02</updated><author><name>N</name></author><category term="k"/></entry></feed>')
    got = {r.external_id: (r.title, r.content, r.tags, r.paywalled) for r in R.read_feed(spark, str(tmp_path / "f")).collect()}
    assert got == {"g1": ("T", "Subscribe to read x", ["c"], True), "e1": ("U", "body", ["k"], False)}
    put(tmp_path / "e/m.eml", "From: Ann <ann@x.org>\r\nSubject: Hi\r\nMessage-ID: <1@x>\r\nContent-Type: text/html\r\n\r\n<p>t</p><img src=p width=1>\r\n")
    put(tmp_path / "e/none.eml", "From: a@b\r\nSubject: no body\r\nContent-Type: application/pdf\r\n\r\n")
    rows = R.read_mail(spark, str(tmp_path / "e")).collect()
    assert [(r.from_name, r.from_addr, r.html.strip()) for r in rows] == [("Ann", "ann@x.org", "<p>t</p>")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.md", "one"), z.writestr("../evil.md", "two"), z.writestr("b.bin", "x")
    put(tmp_path / "c.txt", "three")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "c.txt", "in/c.txt")
    assert {(r.member, r.content) for r in R.read_archives(spark, str(tmp_path)).collect()} == {("a.md", "one"), ("in/c.txt", "three")}


def test_dumps(spark, tmp_path):
    put(tmp_path / "g.log", "s1\x00ann\x002024-01-01T00:00:00Z\x00subject\x00body\n\x1e\ns2\x00bob\x00bad date\x00other\x1ebroken\x00x\x1e")
    rows = R.gitlog_to_events(spark, str(tmp_path / "g.log")).collect()
    assert [(r.event_data["sha"], r.title, r.body) for r in rows] == [("s1", "subject", "body"), ("s2", "other", "")] and rows[1].occurred_at is None
    put(tmp_path / "i.json", "\n".join(json.dumps(x) for x in ({"number": 1, "title": "a", "created_at": "2024-01-01T00:00:00Z", "user": {"login": "u"}, "labels": [{"name": "x"}, {"name": "y"}]}, {"number": 2, "title": "b", "pull_request": {"url": "p"}})))
    got = R.issues_to_events(spark.read.schema(R.ISSUE).json(str(tmp_path / "i.json"))).collect()
    assert [(r.event_type, r.author, r.event_data["labels"]) for r in got] == [("issue", "u", "x,y"), ("pull_request", None, None)]
    put(tmp_path / "r.json", "\n".join(json.dumps({"tag_name": f"v{i}", "published_at": f"2024-01-0{i}T00:00:00Z"}) for i in (1, 2, 3)))
    assert [r.title for r in R.releases_to_events(spark.read.schema(R.RELEASE).json(str(tmp_path / "r.json")), "2024-01-02").collect()] == ["v2", "v3"]
    blocks = json.dumps([{"type": "heading_2", "text": "H"}, {"type": "to_do", "text": "d", "checked": True}, {"type": "code", "text": "x", "language": "py"}, {"type": "divider"}])
    assert spark.range(1).select(R.blocks_to_markdown(F.lit(blocks)).alias("m")).first().m == "## H\n\n- [x] d\n\n```py\nx\n```\n\n---"


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([("w", "p", "c")], "workspace string, path string, content string")
    beliefs = spark.createDataFrame([("w", "b", ["1", "2"])], "workspace string, belief_id string, footnote_ids array<string>")
    R.export_bundle(docs, beliefs, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o/documents")).first().path == "p"
    R.export_beliefs(beliefs, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().footnote_ids == "1;2"


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


ITEM = "item_id long, workspace string, external_id string, content_hash string, title string, url string, published_at timestamp"
T0 = datetime(2024, 1, 1)


def test_new_items_and_second_poll(spark, tmp_path):
    a = [(1, "w", "e1", "h1", "t", "u", T0), (2, "w", "e1", "h1", "t", "u", T0), (3, "w", None, "h", "t", "u", T0)]
    b = [(4, "w", "e1", "h1", "t", "u", T0), (5, "w", "e1", "h2", "t", "u", T0), (6, "w", None, "h", "t", "u", T0)]
    out, events = str(tmp_path / "items"), str(tmp_path / "events")

    def poll():
        J.stream_new_items(stream(spark, tmp_path / "in", ITEM), out, events, str(tmp_path / "cp")).awaitTermination()
        return sorted(r.item_id for r in spark.read.schema(ITEM).parquet(out).collect())

    land(spark, a, ITEM, tmp_path / "in")
    first = poll()
    assert len(first) == 2 and 3 in first
    land(spark, b, ITEM, tmp_path / "in")
    assert poll() == sorted([*first, 5, 6]) and poll() == sorted([*first, 5, 6])
    assert spark.read.parquet(events).count() == 4
    # Items that were published long before those seen arrive too.
    land(spark, [(7, "w", "e9", "h9", "t", "u", datetime(2023, 8, 1)), (8, "w", "e9", "h9", "t", "u", datetime(2023, 8, 1))], ITEM, tmp_path / "in")
    assert set(poll()) & {7, 8} and len(poll()) == len(first) + 3


def test_changed_files(spark, tmp_path):
    schema, out = "path string, content string", str(tmp_path / "state")
    for rows in ([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")], [("b", "1")]):
        land(spark, rows, schema, tmp_path / "in")
        J.stream_changed_files(stream(spark, tmp_path / "in", schema), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.path for r in spark.read.schema("path string, content_hash string").parquet(out).collect()) == ["a", "b", "b", "b"]


def test_commits(spark, tmp_path):
    schema, out = "repository string, sha string, occurred_at timestamp", str(tmp_path / "sink")

    def poll(rows):
        land(spark, rows, schema, tmp_path / "in")
        J.stream_commits(stream(spark, tmp_path / "in", schema), out, str(tmp_path / "cp"), first=3, buckets=4).awaitTermination()
        return sorted(f"{r.repository}-{r.sha}" for r in spark.read.schema(schema).parquet(out).collect())

    assert poll([("r", f"s{i}", datetime(2024, 1, 1 + i)) for i in range(5)]) == ["r-s2", "r-s3", "r-s4"]
    # Of the newest one's second, older (rebased, merged), repeated, and those that the first batch left out.
    more = [("r", "s4", datetime(2024, 1, 5)), ("r", "s9", datetime(2024, 1, 9)), ("r", "same", datetime(2024, 1, 5)), ("r", "old", datetime(2020, 1, 1)), ("r", "none", None), ("r", "s0", datetime(2024, 1, 1)), ("r", "s9", datetime(2024, 1, 9))]
    want = ["r-none", "r-old", "r-s2", "r-s3", "r-s4", "r-s9", "r-same"]
    assert poll(more) == want
    assert poll([*more, ("q", "s4", datetime(2019, 1, 1))]) == ["q-s4", *want]


def test_lookups_read_a_constant_number_of_files(spark, tmp_path):
    out, files, read = str(tmp_path / "items"), [], J.Seen.__init__

    def counted(self, *args):
        read(self, *args)
        files.append(len(self.known.inputFiles()))

    J.Seen.__init__ = counted
    try:
        for k in range(12):
            land(spark, [(10 * k + i, "w", f"e{k}-{i}", "h", "t", "u", T0) for i in range(8)] + [(1000 + k, "w", "e0-0", "h", "t", "u", T0)], ITEM, tmp_path / "in")
        J.stream_new_items(stream(spark, tmp_path / "in", ITEM), out, str(tmp_path / "events"), str(tmp_path / "cp"), window="1 second", buckets=4).awaitTermination()
    finally:
        J.Seen.__init__ = read
    assert len(files) >= 12 and max(files) <= 4  # a file for each bucket, however many batches there were
    assert spark.read.schema(ITEM).parquet(out).count() == 96


def test_a_batch_that_runs_again_finds_the_same(spark, tmp_path):
    schema = "repository string, sha string, occurred_at timestamp"
    df = spark.createDataFrame([("r", "a", T0), ("r", "b", T0)], schema)
    for _ in range(2):
        seen = J.Seen(df, str(tmp_path / "keys"), ["repository", "sha"], 5, 4)
        assert seen.known.count() == 0
        seen.record(df)
    assert J.Seen(df, str(tmp_path / "keys"), ["repository", "sha"], 6, 4).known.count() == 2


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    path, schema = str(tmp_path / "docs"), "workspace string, path string, content string, updated_at timestamp"
    documents = lambda rows: spark.createDataFrame([("w", p, c, datetime(2024, 1, d)) for p, c, d in rows], schema)
    assert len(I.write_upserts(documents([(f"p{i}", "a", 1) for i in range(100)]), path, 8)) == 8
    times = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "docs").rglob("*.parquet")}
    before = times()
    touched = I.write_upserts(documents([("p7", "b", 2), ("p8", "older", 1)]), path, 8)
    after = times()
    assert len(touched) <= 2 and {f for f in before if f in after} == {f for f in before if int(f.parent.name.split("=")[1]) not in touched}
    assert len(after) == 8 and all(before[f] == after[f] for f in before if f in after)
    rows = lambda: sorted((r.path, r.content) for r in spark.read.parquet(path).collect())
    held = rows()
    assert len(held) == 100 and ("p7", "b") in held and ("p8", "older") in held
    I.write_upserts(documents([("p7", "b", 2)]), path, 8)
    assert rows() == held
    assert I.write_upserts(documents([]), path, 8) == []


def collected(df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table("out").collect()


EVENT = "workspace string, source_type string, event_type string, occurred_at timestamp, ingested_at timestamp"


def test_timeline_equals_batch(spark, tmp_path):
    rows = [("w", "k", "e", datetime(2024, 1, d, h), datetime(2024, 1, d, h)) for d in range(1, 9) for h in (1, 5, 9)]
    land(spark, rows, EVENT, tmp_path / "in")
    land(spark, [("w", "k", "e", datetime(2024, 2, 1), datetime(2024, 2, 1))], EVENT, tmp_path / "in")
    got = {(r.day, r.n) for r in collected(J.stream_timeline(stream(spark, tmp_path / "in", EVENT)), tmp_path)}
    assert got == {(f"2024-01-0{d}", 3) for d in range(1, 9)}
    weekly = J.stream_weekly(spark.createDataFrame(rows, EVENT)).where("until = '2024-01-09'").first()
    assert weekly.n == 21  # the second to the eighth


def test_debounce(spark):
    rows = [("a", T0), ("a", datetime(2024, 1, 1, 0, 0, 0, 300000)), ("a", datetime(2024, 1, 1, 0, 0, 5)), ("b", T0)]
    assert sorted((r.path, r.changes) for r in J.debounce(spark.createDataFrame(rows, "path string, ts timestamp")).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_sessions_as_they_grow(spark, tmp_path):
    schema, sink = "session_id long, seq long, role string, content string", str(tmp_path / "sink")
    for rows in ([(1, 1, "user", "a"), (2, 1, "user", "x")], [(1, 2, "assistant", "b")], [(1, 2, "assistant", "b")]):
        land(spark, rows, schema, tmp_path / "in")
        J.stream_sessions(stream(spark, tmp_path / "in", schema), sink, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.schema("session_id long, version long, n long, content string, content_hash string").parquet(sink)
    last = Q.latest_per_key(got, ["session_id"], [F.desc("version")])
    batch = Q.capture_sessions(spark.read.parquet(str(tmp_path / "in")).distinct())
    assert {(r.session_id, r.content_hash) for r in last.collect()} == {(r.session_id, r.content_hash) for r in batch.collect()}
    assert got.where("session_id = 1").count() == 2  # the third batch changed nothing


def test_late_events_are_kept(spark, tmp_path):
    """The timeline of the same batches and the late events add up to all of them."""
    batches = [[1, 1, 2, 5], [6, 3, 1, 20], [1, 17, 2, 18, 21], [30, 19, 4]]
    rows = [[("w", "k", f"e{b}-{i}", datetime(2024, 1, d, 12), T0) for i, d in enumerate(days)] for b, days in enumerate(batches)]
    counts, late = {}, None
    for k in range(len(rows)):
        land(spark, rows[k], EVENT, tmp_path / "in")
        J.split_late(stream(spark, tmp_path / "in", EVENT), str(tmp_path / "ok"), str(tmp_path / "late"), str(tmp_path / "cp")).awaitTermination()
        timeline = J.stream_timeline(stream(spark, tmp_path / "in", EVENT))
        timeline.writeStream.format("parquet").option("path", str(tmp_path / "days")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    on_time, late = (spark.read.schema(EVENT).parquet(str(tmp_path / x)) for x in ("ok", "late"))
    assert sorted(r.event_type for r in on_time.unionByName(late).collect()) == sorted(r[2] for b in rows for r in b)
    days = {r.day: r.n for r in spark.read.parquet(str(tmp_path / "days")).collect()}  # those that the watermark has passed
    day = F.date_format("occurred_at", "yyyy-MM-dd").alias("day")
    counts = {r.day: r["count"] for r in on_time.groupBy(day).count().collect()}
    assert days == {d: n for d, n in counts.items() if d < "2024-01-28"} and late.count() >= 4


def test_stale_runs_by_timers(spark, tmp_path):
    schema = "run_id long, status string, started_at timestamp, seen_at timestamp"
    at = lambda minute: datetime(2024, 1, 1, 10, minute)
    batches = [[(1, "pending", at(0), at(0)), (2, "pending", at(0), at(0)), (3, "pending", at(9), at(9))], [(2, "committed", at(0), at(10)), (9, "committed", at(1), at(16))], [(9, "committed", at(1), at(17))], [(4, "pending", at(1), at(18)), (9, "committed", at(1), at(18))]]
    out = str(tmp_path / "out")
    for rows in batches:
        land(spark, rows, schema, tmp_path / "in")
        swept = state.stale_runs(stream(spark, tmp_path / "in", schema), ttl_seconds=600)
        swept.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("run_id long, version long, status string").parquet(out)
    got = {r.run_id: r.status for r in Q.latest_per_key(told, ["run_id"], [F.desc("version")]).collect()}
    runs = Q.latest_per_key(spark.read.parquet(str(tmp_path / "in")), ["run_id"], [F.desc("seen_at")])
    want = {r.run_id: r.status for r in J.sweep_stale(runs, F.lit(at(18)).cast("timestamp"), 600).collect()}
    assert got == want == {1: "abandoned", 2: "committed", 3: "pending", 4: "abandoned", 9: "committed"}


def test_redacted_stream(spark, tmp_path):
    put(tmp_path / "in/a.log", "password=abc\nfine")
    df = J.stream_redact_logs(spark.readStream.text(str(tmp_path / "in")))
    assert sorted(r.value for r in collected(df, tmp_path)) == ["fine", "password=[REDACTED]"]


def test_digest(spark):
    now = F.lit(datetime(2024, 1, 10)).cast("timestamp")
    events = spark.createDataFrame([(1, "w", "old", T0), (2, "w", "new", datetime(2024, 1, 9))], "event_id long, workspace string, title string, occurred_at timestamp")
    beliefs = spark.createDataFrame([], "belief_id string, workspace string, statement string, asserted_at timestamp, superseded_at timestamp")
    items = spark.createDataFrame([], "item_id long, workspace string, title string, published_at timestamp")
    found = E.digest_items(events, beliefs, items, now)
    assert [r.title for r in found.collect()] == ["new"]
    assert E.digest_text(found).first().text == "- 2024-01-09 new"
