"""Semantics at their edges: boundaries, ties, nulls, rounding, rerun."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import calendar as C
from tidewatch.functions import numbers as N
from tidewatch.functions import text as T
from tidewatch.operators import copying, finance, ingest, jobs, merge, scoring, verify, worker
from tidewatch.sources import landing, sinks
from tidewatch.sources.parted import Conflict, PartedTable

ARTICLE = "ordinal long, id string, title string, content string, link string, cat string, source_name string, pub timestamp_ntz"


def value(spark, column, row="1 AS one"):
    return spark.sql(f"SELECT {row}").select(column.alias("v")).first().v


def articles(spark, *rows):
    full = [(i, r.get("id", f"id{i}"), r["title"], r.get("content", ""), r.get("link"), r.get("cat", "en"), r.get("source", "s"), r.get("pub")) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(*r[:7], r[7]) for r in full], ARTICLE.replace("timestamp_ntz", "string"))
    return df.withColumn("pub", F.col("pub").cast("timestamp_ntz"))


def test_merge_keeps_first_direct_link_and_earliest_date(spark):
    rows = [{"title": "Title A", "link": "https://news.google.com/x", "pub": "2026-07-15"}, {"title": "title a！", "link": "", "pub": "2026-03-15"}, {"title": "TITLE A", "link": "https://b.example/2"}, {"title": "Title a", "link": "https://c.example/3", "pub": "2026-08-01"}, {"title": "！！"}, {"title": "Other", "link": None, "pub": None}]
    got = {r.key: r for r in merge.merge_titles(articles(spark, *rows), T.title_key(F.col("title"), 120), True).collect()}
    assert set(got) == {"titlea", "other"}
    a = got["titlea"]
    assert (a.link, str(a.pub), a.n_merged, a.ordinal) == ("https://b.example/2", "2026-03-15 00:00:00", 4, 0)
    assert a.id != "id0" and got["other"].id == "id5" and got["other"].pub is None


def test_dates_at_their_boundaries(spark):
    at = C.instant("2024-03-20 12:00:00")
    assert [value(spark, C.within_age(C.instant(t), at)) for t in ("2024-01-19 12:00:01", "2024-01-19 12:00:00")] == [True, False]
    assert not value(spark, C.within_age(F.lit(None).cast("timestamp_ntz"), at))
    assert str(value(spark, C.retention_cutoff(C.instant("2024-08-10 00:00:00")))) == "2024-06-30 16:00:00"
    assert str(value(spark, C.retention_cutoff(C.instant("2024-01-10 00:00:00")))) == "2023-11-30 16:00:00"
    assert str(value(spark, C.local_start(C.instant("2024-01-28 15:59:59"), "WEEK"))) == "2024-01-21 16:00:00"
    assert str(value(spark, C.local_start(C.instant("2024-01-28 16:00:00"), "WEEK"))) == "2024-01-28 16:00:00"
    assert [value(spark, C.market_open(C.instant(t))) for t in ("2024-01-05 01:00:00", "2024-01-05 05:35:59", "2024-01-05 05:36:00", "2024-01-06 02:00:00")] == [True, True, False, False]
    assert [value(spark, C.iso_day(F.lit(t))) for t in ("1120309", "112/03/09", "20230309", "2023-03-09", "", "no day", None)] == ["2023-03-09"] * 4 + [""] * 3
    assert str(value(spark, C.reported_period(F.lit("2024-01-15").cast("date")))) == "2023-12-01"


def test_text_and_number_rules(spark):
    assert value(spark, T.loose_title_key(F.lit("星海 資訊：發布　新品！"))) == "星海資訊發布新品"
    assert value(spark, T.title_key(F.lit("A-b_c 新！"), 4)) == "ab_c"
    assert [value(spark, T.mentions(F.lit(t), "tide board")) for t in ("a tide board!", "tide boarding")] == [True, False]
    bad = ("javascript:x", "data:x", "file:///x", "https://u@h.example/", "https://a b/", "https:///x", "", None)
    assert [value(spark, T.safe_url(F.lit(u))) for u in ("https://x.example/a?b#c", "HTTP://x", *bad)] == [True, True] + [False] * len(bad)
    assert value(spark, T.content_hash(F.lit("a"), F.lit(None))) != value(spark, T.content_hash(F.lit(None), F.lit("a")))
    assert value(spark, N.nonzero(F.lit(0.0), F.lit(None).cast("double"), F.lit(2.0))) == 2.0
    assert [value(spark, N.share(F.lit(a), F.lit(b))) for a, b in ((1, 8), (1, 0), (0, 0))] == [13, 100, 0]
    assert value(spark, N.growth(F.lit(5.0), F.lit(0.0))) is None and [value(spark, N.parsed(F.lit(t))) for t in ("1,234.5x", "none", None)] == [1234.5, 0.0, 0.0]
    assert value(spark, T.bullets(F.lit("• a • b ••"))) == ["a", "b"]


def test_importance_rounds_halves_to_even(spark):
    v = scoring.Vocabulary("E", {"E": ("own",)}, (), (), (), (), {"x": 15})
    got = scoring.rule_scores(articles(spark, {"title": "own", "cat": "x"}, {"title": "nothing", "cat": "y"}), v).orderBy("ordinal").collect()
    assert [(r.relevance, r.importance, r.relevant) for r in got] == [(70, 38, True), (0, 0, False)]


def test_jobs(spark):
    rows = [(1, "processing", 3, "me", None), (2, "processing", 1, "me", "2024-01-01"), (3, "processing", 1, "you", "2024-03-01"), (4, "pending", 0, None, None)]
    df = spark.createDataFrame(rows, "job_id long, status string, attempts long, owner string, lease string").selectExpr("job_id", "status", "attempts", "owner", "CAST(lease AS timestamp_ntz) AS lease_until", "CAST(NULL AS timestamp_ntz) AS next_at", "job_id AS priority")
    at = C.instant("2024-01-01 00:00:00")
    assert {r.job_id: (r.status, str(r.next_at)) for r in jobs.fail(df, at, "me", "Error:\n no   reply").collect()} == {1: ("failed", "None"), 2: ("pending", "2024-01-01 00:01:00"), 3: ("processing", "None"), 4: ("pending", "None")}
    failed = {r.job_id: (r.owner, r.lease_until, r.last_error) for r in jobs.fail(df, at, "me", "Error:\n no   reply").collect()}
    assert failed[1] == failed[2] == (None, None, "Error: no reply") and failed[3][0] == "you" and failed[3][2] is None
    back = {r.job_id: (r.status, r.owner, r.last_error) for r in jobs.recover(df, at).where("recovered").collect()}
    assert back == {i: ("pending", None, "the worker before broke off") for i in (1, 2)}
    assert [r.job_id for r in jobs.claim(df, at, "me", 5).collect()] == [4]
    for call in (lambda: jobs.claim(df, at, "me", 0), lambda: jobs.expired(df, at, 0), lambda: jobs.page(df, F.col("job_id"), F.col("job_id"), None, -1)):
        with pytest.raises(ValueError):
            call()


def test_copies_are_compared_with_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (5, None)], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "w")], "k long, v string")
    assert {r.k: r.verdict for r in verify.compared(a, b, "k").collect()} == {1: "match", 2: "match", 3: "differs", 4: "extra", 5: "missing"}


def test_sinks_can_be_rerun(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k long, v string, w string")
    later = spark.createDataFrame([(2, "c", None), (3, "d", "r")], "k long, v string, w string")
    for df in (first, later, later):
        sinks.upsert(df, root, "k")
    assert {tuple(r) for r in sinks.current(spark, root).select("k", "v", "w").collect()} == {(1, "a", "p"), (2, "c", "q"), (3, "d", "r")}
    sinks.snapshot(first, str(tmp_path / "s"), "v")
    sinks.snapshot(first.where("k = 2").withColumn("w", F.lit("new")), str(tmp_path / "s"), "v")
    assert {(r.k, r.w) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(1, "p"), (2, "new")}
    assert not sinks.write_if_changed(first, first.limit(0), str(tmp_path / "n")) and not (tmp_path / "n").exists()
    calls = []
    assert sinks.once(spark, str(tmp_path / "done"), lambda: calls.append(1)) and not sinks.once(spark, str(tmp_path / "done"), lambda: calls.append(1)) and calls == [1]


def test_landed_sources(spark):
    rows = spark.createDataFrame([(i, "s" + str(i % 2)) for i in range(100)], "ordinal long, label string")
    assert landing.first_entries(rows, "label", 30).count() == 60
    assert landing.by_priority(rows.limit(0), rows.where("label = 's1'"), rows).count() == 50
    pages = spark.createDataFrame([(1, "<table><tr><td>a <b>b</b></td><th>c</th></tr></table>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in landing.html_cells(pages).collect()] == [(1, 0, ["a b", "c"])]


def test_table_by_parts_rewrites_what_a_batch_touches(spark, tmp_path):
    root = str(tmp_path / "p")

    def newest(now, rows):
        return merge.latest(rows if now is None else now.unionByName(rows), "k", F.col("v"))

    rows = lambda *x: spark.createDataFrame(list(x), "k long, v long")
    sinks.upsert_parts(spark.range(100).selectExpr("id AS k", "0L AS v"), root, "k", newest, 4)
    for _ in range(2):  # a batch that runs again merges to the same table
        sinks.upsert_parts(rows((1, 5), (1, 3), (200, 1)), root, "k", newest, 4)
    got = {r.k: r.v for r in sinks.current(spark, root).select("k", "v").collect()}
    assert got == {k: 0 for k in range(100)} | {1: 5, 200: 1}
    assert len(sinks.upsert_parts(rows((1, 5), (200, 1)), root, "k", newest, 4)) <= 2
    for i in range(6):
        sinks.upsert_parts(spark.range(100).selectExpr("id AS k", f"{10 + i}L AS v"), root, "k", newest, 4)
    assert len(list((tmp_path / "p" / "versions").glob("[0-9]*"))) == 2 and len(list((tmp_path / "p" / "data").iterdir())) <= 3
    assert sinks.upsert_parts(rows(), root, "k", newest, 4) == []
    assert sinks.current(spark, root).count() == 101


def test_of_two_writers_of_a_version_the_second_fails(spark, tmp_path):
    t = PartedTable(spark, str(tmp_path / "w"), "k")
    rows = lambda v, *ks: spark.createDataFrame([(k, v) for k in ks], "k long, v long")
    plus = lambda more: lambda now: (now.join(more, "k", "left_anti") if now is not None else more.limit(0)).unionByName(more)
    assert t.version() is None and t.read() is None and t.delete(rows(0, 1)) == []
    start = t.create(rows(0, *range(50)), 8, split=2)
    with pytest.raises(Conflict):
        t.create(rows(0, 1), 8)
    first = t.rewrite(rows(1, 7), plus(rows(1, 7)), start)
    assert len(first) == 1
    with pytest.raises(Conflict):
        t.rewrite(rows(2, 8), plus(rows(2, 8)), start)
    assert {r.k: r.v for r in t.read().collect()} == {k: int(k == 7) for k in range(50)}
    t.merge(rows(3, 8), lambda now, more: plus(more)(now))
    assert t.version().number == 2 and t.read().where("k = 8").first().v == 3
    with pytest.raises(ValueError):
        t.rewrite(rows(1, 7), lambda now: rows(1, *range(50)))
    before = t.version()
    gone = t.delete(rows(0, 7, 8, 9, 1000, 1000))
    after = t.version()
    assert t.read().count() == 47 and 1 <= len(gone) <= 3
    assert {p for p in range(8) if before.folders.get(p) != after.folders.get(p)} == set(gone)
    assert t.delete(rows(0, 1000, 7)) == [] and t.version() == after
    t.delete(rows(0, *range(50)))
    assert t.read() is None or t.read().count() == 0


def test_copies_halt_on_their_own_and_resume(spark, tmp_path):
    good, root = spark.range(5), str(tmp_path)
    bad = good.select(F.raise_error(F.lit("broken")).alias("x"))
    key = copying.fingerprint(cutoff="2024-01", tables=["a", "b"])
    first = {r.collection: r.status for r in copying.copy(spark, [("a", good), ("b", bad)], root, key).collect()}
    again = {r.collection: r.status for r in copying.copy(spark, [("a", good), ("b", good)], root, key).collect()}
    assert first == {"a": "copied", "b": "failed"} and again == {"a": "skipped", "b": "copied"}
    assert copying.fingerprint(cutoff="2024-02", tables=["a", "b"]) != key
    assert copying.gate(spark.createDataFrame([], "collection string, class string, children long"), ("a",)).first().blocked is False
    assert copying.gate(spark.createDataFrame([("a", "preserve", None)], "collection string, class string, children long"), ("a",)).first().blocked is True
    assert copying.blocking(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "c", ("a",)).count() == 2


def test_media_in_order_and_both_directions(spark):
    domains = (("one.example", "One Daily"), ("two.example", "Two"))
    name = lambda title, author="", link="": value(spark, ingest.media_name(F.lit(title), F.lit(author), F.lit(link), domains))
    assert name("News - One Daily") == "One Daily" and name("News – One") == "One Daily" and name("News - The Two Times") == "Two"
    assert name("News - 2024", "Two") == "Two" and name("News", "a@b.example", "https://www.one.example/x") == "One Daily"
    assert name("News", "", "https://other.example/x") == "other.example" and name("News", "", "https://news.google.com/x") == "unknown"
    strip = lambda title, media: value(spark, ingest.without_suffix(F.lit(title), F.lit(media)))
    assert strip("A - B - One", "One Daily") == "A - B" and strip("A - B", "One") == "A - B" and strip("A - B", "unknown") == "A - B"


def test_worker_output_and_locks(spark):
    rows = spark.createDataFrame([(1, "```json\n{\"summary\": \"s\", \"importanceScore\": 250, \"confidence\": -1}\n```"), (2, "{}"), (3, None), (4, "{\"summary\": \"" + "x" * 600 + "\", \"entities\": \"none\"}")], "id long, o string")
    got = {r.id: r for r in worker.checked_output(rows, "o", ("a",), ("risk",)).collect()}
    assert [got[i].valid for i in (1, 2, 3)] == [True, False, False] and (got[1].importance, got[1].confidence, got[1].event, got[1].impact) == (100, 0.0, "other", "neutral")
    assert value(spark, worker.unfenced(F.lit("```\na\n```"))) == "a" and value(spark, worker.unfenced(F.lit(" a "))) == "a"
    with pytest.raises(ValueError):
        worker.acquired(rows, rows, C.instant("2024-01-01 00:00:00"), 0)


def test_quotes_and_flows_without_rows(spark):
    q = spark.createDataFrame([("a", 1, "-", "10", "1,000"), ("a", 2, "99", "1", "1"), ("b", 3, "12.5", "", ""), ("c", 4, "", "-", None)], "code string, ordinal long, z string, y string, v string")
    assert {r.code: (r.price, r.change, r.pct, r.volume) for r in finance.quotes(q, "code").collect()} == {"a": (10.0, 0.0, 0.0, 1000000), "b": (12.5, 0.0, 0.0, 0), "c": (0.0, 0.0, 0.0, 0)}
    none = spark.createDataFrame([], "name string, day string, buy double, sell double, ordinal long")
    assert finance.chosen_flow(none, ["x"]).collect() == []


def test_similar_titles_with_ties_and_empty_sets(spark):
    rows = [(0, ["a", "b"]), (1, ["b", "c", "d"]), (2, ["x"]), (3, []), (4, ["a", "b"]), (20, ["c", "z"]), (21, ["q"])]
    df = spark.createDataFrame(rows, "ordinal long, k array<string>")
    got = {r.ordinal: r.similar for r in merge.similar(df, df.where("ordinal % 20 = 0")).collect()}
    want = {i: any(j % 20 == 0 and i != j and a and b and len(set(a) & set(b)) >= 0.5 * min(len(a), len(b)) for j, b in rows) for i, a in rows}
    assert got == want
