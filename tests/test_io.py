"""Files in, files out, and streams that resume."""

import gzip
import json
import zipfile

from pyspark.sql import functions as F

from urlsieve.operators import profile as P, scanlog as L
from urlsieve.plans import feed_queries
from urlsieve.sources import feeds, readers, writers
from urlsieve.streaming import jobs
from urlsieve.streaming.state import StateTable, UrlHistory


def urls_of(df):
    return sorted(r["url"] for r in df.collect())


def test_source_summary_reads_each_feed_once(spark):
    sources = [feeds.Source("a", "txt_lines"), feeds.Source("off", "txt_lines", default_on=False), feeds.Source("b", "domain_list")]
    frames = {"a": ["http://x.vn/", "http://x.vn/", "# no", "https://both/", "https://d.org/"], "b": ["0.0.0.0 d.org", "! no.t", "e.org", "e.org", "plain"]}
    active = feeds.active_sources(sources)
    union = feeds.union_sources(active, {n: spark.createDataFrame([(v,) for v in vs], "value string") for n, vs in frames.items()})
    summary = feeds.source_summary(union, sources, active)
    assert [tuple(r) for r in summary.collect()] == [
        ("a", "OK", 4, 3, 1, 33.333333), ("off", "skipped", 0, 0, 0, 0.0), ("b", "OK", 3, 1, 0, 0.0), ("TOTAL", "", 7, 4, 1, 25.0)]
    empty = feeds.source_summary(union.where("false"), sources, active)
    assert [tuple(r)[2:] for r in empty.collect()] == [(0, 0, 0, 0.0)] * 4
    query = feed_queries.source_summary(spark, "/root/testdata/sf0.001")
    for df, feeds_read in ((summary, len(active)), (query, len(feed_queries.ACTIVE))):
        assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == feeds_read


def test_filters_do_not_repeat_parsers(spark):
    lines = spark.range(1).select(F.col("id").cast("string").alias("value"))
    for parse in (feeds.txt_lines, feeds.domain_list, feeds.strict_domain_list, feeds.url_lines, feeds.json_feed):
        plan = parse(lines)._jdf.queryExecution().optimizedPlan().toString()
        kept = [line for line in plan.splitlines() if "Filter" in line]
        assert kept and not any("trim(" in line or "regexp" in line for line in kept), parse.__name__


def test_last_words_of_list_lines(spark):
    values = ["a.b", " a.b ", "x a.b", "x\ta.b", "x\u2028a.b\u3000", "x.y\na.b", "x.y z", "x\u00a0\u0085 a.b", "", " ", "x\x1ca.b", "# a.b", "a.b #c"]
    lines = spark.createDataFrame([(v,) for v in values], "value string")
    assert urls_of(feeds.domain_list(lines)) == ["https://a.b/"] * 8
    assert urls_of(feeds.strict_domain_list(lines)) == ["https://a.b/"] * 8


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n\n http://a/ \nhttp://b/\n")
    assert urls_of(feeds.txt_lines(readers.read_lines(spark, str(tmp_path / "a.txt")))) == ["http://a/", "http://b/"]
    (tmp_path / "f.json").write_text(json.dumps([{"value": "http://v/"}, 3, {"url": "http://u/"}], indent=1))
    assert urls_of(feeds.json_feed(readers.read_documents(spark, str(tmp_path / "f.json")))) == ["http://u/", "http://v/"]
    (tmp_path / "h.csv").write_text('id, URL ,x\n1,"http://q/?a,b",2\n2,none,3\n')
    assert urls_of(feeds.header_csv(readers.read_header_csv(spark, str(tmp_path / "h.csv")))) == ["http://q/?a,b"]
    (tmp_path / "n.csv").write_text("id,link\n1,http://z/\n")
    assert urls_of(feeds.header_csv(readers.read_header_csv(spark, str(tmp_path / "n.csv")))) == ["http://z/"]


def test_lists_know_their_category(spark, tmp_path):
    for name in ("scam", "fraud"):
        (tmp_path / f"{name}.txt").write_text(f"0.0.0.0 {name}.com\n")
    rows = readers.read_lists(spark, [str(tmp_path / "scam.txt"), str(tmp_path / "fraud.txt")]).collect()
    assert sorted((r["category"], r["value"]) for r in rows) == [("fraud", "0.0.0.0 fraud.com"), ("scam", "0.0.0.0 scam.com")]


def test_archives_and_sitemaps(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "full.zip", "w") as z:
        z.writestr("csv.txt", '# "x\n"1","d","http://in-zip/","on"\n')
        z.writestr("b.txt", "not read")
    (tmp_path / "plain.csv").write_text('"2","d","http://plain/","on"\n')
    got = urls_of(feeds.comment_csv(readers.read_archives(spark, str(tmp_path))))
    assert got == ["http://in-zip/", "http://plain/"]
    maps = tmp_path / "maps"
    maps.mkdir()
    (maps / "s.xml").write_bytes(gzip.compress(b"<urlset><loc>http://a/</loc></urlset>"))
    (maps / "t.xml").write_bytes(b"<urlset/>")
    (maps / "u.xml").write_bytes(b"\x1f\x8bbroken")
    found = readers.read_sitemaps(spark, str(maps)).collect()
    assert [r["error"] is None for r in found] == [r["text"] is not None for r in found]
    assert any(r["error"] for r in found)
    assert sorted(r["text"] for r in found if r["text"] is not None) == [
        "<urlset/>", "<urlset><loc>http://a/</loc></urlset>"]


def test_html_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>1")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.htm").write_bytes(b"<p>\xff2")
    assert readers.read_html_folder(spark, str(tmp_path)).count() == 1
    assert sorted(r["html"] for r in readers.read_html_folder(spark, str(tmp_path), True).collect()) == ["<p>1", "<p>2"]


def test_labelled_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('http://a/?q="x",y', 1), ("http://b/", 0)], "url string, label int")
    writers.write_quoted_csv(rows, str(tmp_path / "out"))
    back = readers.read_labelled(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert readers.read_labelled(spark, str(tmp_path / "out"), 1).count() == 1
    raw = tmp_path / "raw.csv"
    raw.write_text('url,label\n"http://a/",1\n"",0\n"http://b/",x\n"http://c/",2\n')
    o = P.overview(readers.read_raw_rows(spark, str(raw))).first()
    assert (o["total"], o["missing_url"], o["invalid_label"], o["valid"]) == (4, 1, 2, 1)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("u1", "s", 1), ("u2", "s", 0)], "url string, source string, is_vn_target int")
    writers.write_feed(df, str(tmp_path / "feed"))
    assert spark.read.option("header", True).csv(str(tmp_path / "feed")).where("is_vn_target = 1").count() == 1
    writers.append_rows(df, str(tmp_path / "t"), separate=True)
    writers.append_rows(df, str(tmp_path / "t"))
    assert writers.read_table_or_none(spark, str(tmp_path / "t")).count() == 4
    assert writers.read_table_or_none(spark, str(tmp_path / "absent")) is None
    calls = []
    make = lambda: (calls.append(1), df)[1]
    first = writers.cached(make(), str(tmp_path / "c"), {"bits": 20})
    assert first.count() == 2 and len(list((tmp_path / "c").iterdir())) == 1
    writers.cached(make(), str(tmp_path / "c"), {"bits": 18})
    assert len(list((tmp_path / "c").iterdir())) == 2
    crawl = spark.createDataFrame([("a", "u"), ("b", "v"), ("", "w")], "seed string, url string")
    crawl.write.parquet(str(tmp_path / "crawl"))
    done = writers.processed_seeds(spark, str(tmp_path / "state"), str(tmp_path / "crawl"))
    assert sorted(r["seed"] for r in done.collect()) == ["a", "b"]
    seeds = spark.createDataFrame([("a",), ("c",)], "seed string")
    assert [r["seed"] for r in writers.pending_seeds(seeds, done).collect()] == ["c"]
    splits = df.select("url", F.lit("random").alias("mode"), F.lit("val").alias("split"))
    writers.write_splits(splits, str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "mode=random" / "split=val").is_dir()
    writers.write_artifact(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_scan_log_appends_by_day(spark, tmp_path):
    scored = spark.createDataFrame([("http://a/x?s=1", 0.9, 0.4)], "url string, p double, q double")
    rows = L.scan_rows(scored, "p", "q", F.lit("2024-05-01 10:00:00.5").cast("timestamp"))
    for _ in range(2):
        L.append_scans(rows, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 and str(back.first()["day"]) == "2024-05-01"
    newest = L.recent(back.withColumn("id", F.lit(1)), 1).first()
    assert newest["created_at"] == "2024-05-01 10:00:00" and newest["ensemble_verdict"] == "MAL"
    assert newest["url_display"] == "http://a/x"


def test_ingest_resumes_and_skips_known_urls(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def run():
        lines = jobs.read_stream(spark, str(inbox), "value string", "text", files_per_batch=1)
        jobs.ingest_feed(lines, feeds.txt_lines, "feed", str(tmp_path / "out"), str(tmp_path / "state"),
                         fetched_at=F.lit("2024-05-01").cast("timestamp")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    (inbox / "1.txt").write_text("http://a/\nhttp://a/\nhttp://b.vn/\n")
    (inbox / "2.txt").write_text("http://b.vn/\nhttp://c/\n")
    assert urls_of(run()) == ["http://a/", "http://b.vn/", "http://c/"]
    (inbox / "3.txt").write_text("http://a/\nhttp://d/\n")
    out = run()
    assert urls_of(out) == ["http://a/", "http://b.vn/", "http://c/", "http://d/"]
    assert {r["url"]: r["is_vn_target"] for r in out.collect()}["http://b.vn/"] == 1
    assert out.select("batch_id").distinct().count() == 3


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 5).alias("client"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
    jobs.windowed_requests(stream, str(tmp_path / "out"), str(tmp_path / "state"), delay="1 hour").awaitTermination()
    counts = jobs.latest(spark, str(tmp_path / "out"), ("client", "window_start"))
    assert counts.count() == 50 and {r["requests"] for r in counts.collect()} == {12}
    assert L.rate_limit_violations(rows).count() == 50


def test_bounded_stream_dedupe(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("url"),
                                  F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
    jobs.write_batches(jobs.distinct_within(stream, "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"),
                       lambda batch, _: batch).awaitTermination()
    assert urls_of(spark.read.parquet(str(tmp_path / "out"))) == [f"u{i}" for i in range(7)]


def test_state_table_compacts_and_survives_replays(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ("k",), every=2)
    assert table.read() is None
    made = lambda rows: spark.createDataFrame(rows, "k string, n long")
    state = lambda t: {r["k"]: r["n"] for r in t.read().collect()}
    table.write(made([("a", 1), ("b", 1)]), 0)
    table.write(made([("a", 2)]), 1)
    table.write(made([("c", 1)]), 2)  # folds 0 and 1 first
    assert table.sources()[1] == [2] and table.manifest()["upto"] == 1
    assert state(table) == {"a": 2, "b": 1, "c": 1}
    table.write(made([("c", 5)]), 2)  # the replay replaces its own delta
    table.compact(2)  # nothing new to fold, and no second manifest
    assert table.sources()[1] == [2] and state(table) == {"a": 2, "b": 1, "c": 5}
    spark.range(1).write.parquet(str(tmp_path / "t" / "_snapshots" / "left-by-a-failed-run"))
    table.vacuum()
    assert table.batches() == [2] and len(table.folder.names("_snapshots")) == 1 and state(table) == {"a": 2, "b": 1, "c": 5}
    table.write(made([("a", 3)]), 3)
    table.write(made([("b", 9)]), 4)  # folds the snapshot with 2 and 3
    assert table.manifest()["upto"] == 3 and state(table) == {"a": 3, "b": 9, "c": 5}
    assert {r["k"]: r["n"] for r in table.read(before=3).collect()} == {"a": 2, "b": 1, "c": 5}


def test_profile_stream_with_compaction_between_batches(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").alias("v"))
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
    jobs.running_profile(stream, str(tmp_path / "out"), str(tmp_path / "state"), ("g",), {"s": F.col("v")}, every=2).awaitTermination()
    assert StateTable(spark, str(tmp_path / "out"), ("g",)).manifest() is not None
    got = {r["g"]: (r["n"], r["s"]) for r in jobs.latest(spark, str(tmp_path / "out"), ("g",)).collect()}
    assert got == {str(g): (len(range(g, 400, 3)), sum(range(g, 400, 3))) for g in range(3)}


def test_history_opens_only_buckets_that_may_hold_a_url(spark, tmp_path):
    made = lambda urls: spark.createDataFrame([(u,) for u in urls], "url string")
    names = lambda df: sorted(r["url"] for r in df.collect()) if df is not None else []
    history = UrlHistory(spark, str(tmp_path / "h"), buckets=64, words=256)
    assert history.known(made(["a"]), 0) is None and history.opened == []
    history.seed(made(["s1", "s2", "s2", None]))
    history.seed(made(["never"]))  # done already
    history.add(made([f"u{i}" for i in range(100)]), 0)
    history.add(made(["v"]), 1)
    assert names(history.known(made(["u7", "s1", "new"]), 2)) == ["s1", "u7"]
    buckets = {r["b"] for r in made(["u7", "s1"]).select(history.bucket(F.col("url")).alias("b")).collect()}
    assert {int(p.rsplit("=", 1)[1]) for p in history.opened} <= buckets and history.opened
    assert history.known(made([f"x{i}" for i in range(3)]), 2) is None or len(history.opened) < 6
    assert names(history.known(made(["v", "u1"]), 1)) == ["u1"]  # a replay of batch 1 does not meet itself
    history.add(made(["w"]), 1)
    assert names(history.known(made(["v", "w"]), 2)) == ["w"]


def test_ingest_replays_a_batch_after_a_crash(spark, tmp_path):
    """A batch that was stored but not committed runs again and gives the same rows."""
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "1.txt").write_text("http://a/\nhttp://b/\n")

    def run():
        lines = jobs.read_stream(spark, str(tmp_path / "inbox"), "value string", "text", files_per_batch=1)
        stored = spark.createDataFrame([("http://b/",)], "url string")
        jobs.ingest_feed(lines, feeds.txt_lines, "feed", str(tmp_path / "out"), str(tmp_path / "state"), stored).awaitTermination()
        return urls_of(spark.read.parquet(str(tmp_path / "out")))

    assert run() == ["http://a/"]
    for f in (tmp_path / "state" / "commits").glob("*0*"):
        f.unlink()
    (tmp_path / "inbox" / "2.txt").write_text("http://a/\nhttp://c/\n")
    assert run() == ["http://a/", "http://c/"]
