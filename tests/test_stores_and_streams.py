"""Tables by parts, saves, retention, layouts, pages, vocabularies and selection at their edges."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import calendar as C
from tidewatch.functions import text as T
from tidewatch.operators import copying, ingest, merge, scoring, upkeep, vocabulary
from tidewatch.sources import landing, layout
from tidewatch.streaming import state

ARTICLE = "ordinal long, id string, title string, content string, link string, source_name string, media string, brand string, cat string, pub timestamp_ntz"


def articles(spark, *rows):
    names = ["ordinal", "id", "title", "content", "link", "source_name", "media", "brand", "cat", "pub"]
    full = [tuple({"ordinal": i, "id": f"id{i}", "title": "t", "content": ""}.get(n, None) if n not in r else r[n] for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ARTICLE.replace("timestamp_ntz", "string")).withColumn("pub", F.col("pub").cast("timestamp_ntz"))


def test_search_and_scores_look_at_medium_and_brand(spark):
    rows = articles(spark, {"title": "a", "media": "Harbour Daily", "source_name": "feed"}, {"title": "b", "brand": "Acme"}, {"title": "c", "media": "", "source_name": "Tide"}, {"title": "d", "link": "https://acme.example/", "cat": "acme"})
    ids = lambda **k: [r.title for r in ingest.matching(rows, **k).orderBy("ordinal").collect()]
    assert ids(query="harbour") == ["a"] and ids(query="ACME ") == ["b"] and ids(media="Tide") == ["c"] and ids(media="unknown") == ["b", "d"] and ids(query="unknown") == ["b", "d"] and len(ids()) == 4
    v = scoring.Vocabulary("E", {"E": ("acme",), "H": ("harbour",)}, (), (), (), (), {})
    assert [r.relevance for r in scoring.rule_scores(rows, v).orderBy("ordinal").collect()] == [35, 55, 0, 0]
    without = rows.drop("media", "brand")
    assert [r.relevance for r in scoring.rule_scores(without, v).orderBy("ordinal").collect()] == [0, 0, 0, 0]
    marked = scoring.briefing_marks(rows, (), (), (("Tide", "TIDE"), ("x", "harbour d"))).orderBy("ordinal").collect()
    assert [r.key_medium for r in marked] == [True, False, True, False]


def test_a_save_that_broke_off_is_finished_by_the_next(spark, tmp_path):
    store = upkeep.Store(spark, str(tmp_path), 8)
    rows = lambda *x: articles(spark, *({"id": i, "title": t, "ordinal": n} for n, (i, t) in enumerate(x)))
    hashed = T.content_hash(F.col("title"))
    to_jobs = lambda df: df.select("id", F.lit("pending").alias("status"))
    save = lambda df, jobs=to_jobs: {r.action: r.n_rows for r in upkeep.save(store, df, hashed, "20240101", jobs).collect()}

    def broken(df):
        raise RuntimeError("no queue")

    with pytest.raises(RuntimeError):
        save(rows(("a", "1"), ("b", "1")), broken)
    assert store.table("articles").read().count() == 2 and store.table("index").version() is None
    assert save(rows(("a", "1"), ("b", "1"))) == {"added": 2}
    assert save(rows(("a", "1"), ("b", "2"), ("c", "1"), ("c", "3"))) == {"skipped": 1, "updated": 1, "added": 2}
    assert {(r.id, r.title) for r in store.table("articles").read().collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    assert save(rows(("a", "1"), ("b", "2"), ("c", "3"))) == {"skipped": 3}
    (tmp_path / "index" / "versions" / "7").write_text("broken")
    before = store.table("articles").version()
    with pytest.raises(Exception):
        save(rows(("z", "1")))
    assert store.table("articles").version() == before


def test_a_save_reads_whole_only_what_it_writes(spark, tmp_path):
    store = upkeep.Store(spark, str(tmp_path), 64)
    save = lambda df: {r.action: r.n_rows for r in upkeep.save(store, df, T.content_hash(F.col("title")), "20240101", lambda d: d.select("id", F.col("h").alias("content_hash"))).collect()}
    rows = articles(spark, {"id": "a", "title": "1", "brand": "x"}, {"id": "b", "title": "1"})
    assert save(rows) == {"added": 2}
    assert save(rows.withColumn("brand", F.raise_error(F.lit("read")).cast("string"))) == {"skipped": 2}
    # One row of an id is unchanged, two rows are equal in id, ordinal and hash, and new keys fall into parts that hold nothing yet.
    more = articles(spark, {"id": "a", "title": "1"}, {"id": "a", "title": "2", "ordinal": 0}, {"id": "c", "title": "3", "ordinal": 5}, {"id": "c", "title": "3", "ordinal": 5}, {"id": "c", "title": "0", "ordinal": 4})
    assert save(more) == {"skipped": 1, "updated": 1, "added": 3}
    assert {(r.id, r.title, r.brand) for r in store.table("articles").read().collect()} == {("a", "2", "x"), ("b", "1", None), ("c", "3", None)}
    assert store.table("articles").read().count() == store.table("jobs").read().count() == store.table("index").read().count() == 3
    d = articles(spark, *({"id": f"d{i}", "title": "4"} for i in range(40)))
    assert save(d.limit(1)) == {"added": 1} and save(d) == {"skipped": 1, "added": 39} and store.table("jobs").read().count() == 43


def test_retention_keeps_undated_and_later_rows(spark, tmp_path):
    store = upkeep.Store(spark, str(tmp_path), 4)
    days = ["2024-01-01", "2024-01-02", None, "2024-01-03", "2024-01-04"]
    store.table("articles").create(articles(spark, *({"pub": d} for d in days)).select("id", "pub"), 4)
    for name in ("jobs", "insights"):
        store.table(name).create(spark.createDataFrame([("id0",), ("id4",), ("other",)], "id string"), 4)
    gone, parts, remaining = upkeep.retain(store, C.instant("2024-01-04 00:00:00"), 2)
    assert {r.id for r in gone.collect()} == {"id0", "id1"} and remaining and len(parts["jobs"]) == 1
    _, parts, remaining = upkeep.retain(store, C.instant("2024-01-04 00:00:00"), 2)
    assert not remaining and len(parts["articles"]) == 1 and parts["jobs"] == []
    assert {r.id for r in store.table("articles").read().collect()} == {"id2", "id4"} and store.table("jobs").read().count() == 2
    assert upkeep.retain(store, C.instant("2024-01-04 00:00:00"), 2)[2] is False


def test_vocabularies_without_nested_loops(spark):
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(60)})
    texts = ["".join(rng.choice("abcé 1.") for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    table = spark.createDataFrame([(t,) for t in [*terms, "", None, terms[0]]], "term string")
    plain = {(i, t) for i, x in enumerate(texts) for t in terms if x and t in x}
    for bound in (None, 20):
        assert {(r.n, r.term) for r in vocabulary.term_hits(df, "text", table, most_bytes=bound).collect()} == plain
    import re

    alone = {(i, t) for i, t in plain if not t.isascii() or re.search(f"(^|[^a-z0-9]){t}($|[^a-z0-9])", texts[i])}
    assert {(r.n, r.term) for r in vocabulary.term_hits(df, "text", table, whole_words=True).collect()} == alone
    kept = ingest.without_phrases(df.withColumnRenamed("text", "title"), spark.createDataFrame([("AB",), ("",)], "phrase string"), "title")
    assert "NestedLoop" not in kept._jdf.queryExecution().executedPlan().toString()
    assert {r.n for r in kept.collect()} == {i for i, x in enumerate(texts) if "ab" not in (x or "")}
    with pytest.raises(ValueError):
        vocabulary.matcher(spark.range(1).select(F.repeat(F.lit("x"), 9 << 20).alias("term")))
    assert vocabulary.term_hits(df, "text", table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_selection_is_that_of_a_loop(spark, tmp_path, seed):
    rng = random.Random(seed)
    titles = [(i, sorted(rng.sample("abcdefghijklmnop", rng.randint(0, 5)))) for i in range(0, 240, 2)]
    taken = []
    want = {}
    for i, k in titles:
        like = any(k and s and len(set(k) & set(s)) / min(len(k), len(s)) >= 0.5 for s in taken)
        want[i] = not like
        if not like:
            taken.append(k)
    df = spark.createDataFrame(titles, "ordinal long, k array<string>").repartition(3)
    assert {r.ordinal: r.selected for r in merge.selected(df, f"{tmp_path}/s{seed}").collect()} == want


@pytest.mark.parametrize("share", [0.5, 0.7])
def test_similar_and_selected_in_blocks_are_those_of_a_loop(spark, tmp_path, share):
    """Common and rare words, equal sets, and blocks much smaller than the table."""
    rng = random.Random(7)
    weighted = lambda n: sorted({"abcdefghijklmnopqrstuvwxyz"[min(int(rng.expovariate(0.12)), 25)] + rng.choice(["", "", "2", str(rng.randint(0, 30))]) for _ in range(n)})
    titles = [(i, weighted(rng.choice([0, 1, 2, 3, 5, 8, 12]))) for i in range(260)]
    like = lambda a, b: bool(a and b) and len(set(a) & set(b)) >= share * min(len(a), len(b))
    df = spark.createDataFrame(titles, "ordinal long, k array<string>").repartition(3)
    taken = []
    for i, k in titles:
        if not any(like(k, x) for _, x in taken):
            taken.append((i, k))
    assert {r.ordinal for r in merge.selected(df, f"{tmp_path}/s", share, block=40).where("selected").collect()} == {i for i, _ in taken}
    want = {i: any(j % 20 == 0 and i != j and like(k, x) for j, x in titles) for i, k in titles}
    assert {r.ordinal: r.similar for r in merge.similar(df, df.where("ordinal % 20 = 0"), share, f"{tmp_path}/n").collect()} == want


def test_titles_meet_without_the_driver(spark, tmp_path, monkeypatch):
    """No join of titles or their words is broadcast, however small its files look; pairs with many words in common come once."""
    rng = random.Random(9)
    titles = [(i, sorted({f"w{min(int(rng.expovariate(0.04)), 120)}" for _ in range(rng.choice([1, 3, 6, 20]))})) for i in range(120)] + [(200 + i, [f"v{j}" for j in range(12) if j != i]) for i in range(8)]
    df = spark.createDataFrame(titles, "ordinal long, k array<string>")
    plans, written = [], merge._written
    seen = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or d
    monkeypatch.setattr(merge, "_written", lambda d, *a: written(seen(d), *a))
    seen(merge.selected(df, f"{tmp_path}/s", block=40)), seen(merge.similar(df, df.where("ordinal % 20 = 0"), 0.5, f"{tmp_path}/n"))
    lines = [line for plan in plans for line in plan.split("\n")]
    assert any("SortMergeJoin" in x for x in lines) and [x for x in lines if "BroadcastHashJoin" in x and "[part#" not in x] == []  # parts of the vocabulary are a number each
    sets = df.groupBy("k").agg(F.min("ordinal").alias("ordinal"))
    met = sorted((r.a, r.b) for r in merge.alike(merge.coded(sets, f"{tmp_path}/p")).collect())
    first = sorted((r.ordinal, set(r.k)) for r in sets.collect())
    assert met == [(i, j) for i, a in first for j, b in first if i < j and 2 * len(a & b) >= min(len(a), len(b))]
    assert [r.k for r in merge.coded(spark.createDataFrame([(1, ["a"]), (2, ["b"])], sets.select("ordinal", "k").schema), f"{tmp_path}/q").collect()] == []


def test_a_group_of_near_copies_does_not_meet_in_all_pairs(spark, tmp_path):
    """A block that compares its titles too often is decided by parts: the first of a group drops the others before they form pairs."""
    rng = random.Random(11)
    group = [f"g{j}" for j in range(20)]
    titles = [(i, [w for w in group if w != f"g{i % 20}"] + [f"x{i}"]) if i % 2 else (i, sorted({f"w{rng.randint(0, 60)}" for _ in range(rng.choice([1, 4, 9]))})) for i in range(240)]
    df, taken = spark.createDataFrame(titles, "ordinal long, k array<string>"), []
    for i, k in titles:
        if not any(2 * len(set(k) & set(x)) >= min(len(k), len(x)) for _, x in taken):
            taken.append((i, k))
    assert {r.ordinal for r in merge.selected(df, f"{tmp_path}/s", often=40).where("selected").collect()} == {i for i, _ in taken}
    copies = spark.read.parquet(f"{tmp_path}/s/block-*/block-*/pairs-0").where("a % 2 = 1 AND b % 2 = 1").count()
    assert 0 < copies < 120 * 119 / 2 / 4


def test_keywords_are_letters_only(spark):
    said = spark.createDataFrame([("DDR5 chip 2024 price the café 創見資訊 ab_c Ünder well-known",)], "t string").select(T.keywords(F.col("t")).alias("k")).first().k
    assert said == ["chip", "price", "創見資訊", "well", "known"]


def test_pages_in_several_encodings(spark):
    text = "<table><tr><td>營收 <b>月</b></td><th>1,234</th></tr></table><a class=x href='/a?b=1'>新聞</a><a>none</a>"
    rows = [(i, bytearray(text.encode(e))) for i, e in enumerate(("utf-8", "big5", "cp950"))] + [(3, None), (4, bytearray(b"\xff\xff<tr><td>x</td></tr>"))]
    pages = spark.createDataFrame(rows, "page_id long, raw binary").select("page_id", landing.decoded(F.col("raw")).alias("html"))
    assert {r.page_id: r.cells for r in landing.html_cells(pages).collect()} == {i: ["營收 月", "1,234"] for i in range(3)} | {4: ["x"]}
    assert {(r.page_id, r.place, r.href, r.text) for r in landing.html_links(pages).collect()} == {(i, 0, "/a?b=1", "新聞") for i in range(3)}


def test_layout_reads_only_what_it_must(spark, tmp_path):
    rows = articles(spark, *({"pub": p, "cat": c} for p, c in (("2024-01-31 15:59:59", "a"), ("2024-01-31 16:00:00", "a"), ("2024-02-10 00:00:00", "b"), (None, "a"), ("2024-02-20 00:00:00", None))))
    layout.write_by_month(rows, str(tmp_path / "l"), files=2)
    found = layout.window(spark, str(tmp_path / "l"), since="2024-02-05 00:00:00")
    assert {r.id for r in found.collect()} == {"id2", "id4"} and found.columns == rows.columns
    assert layout.scanned(spark, str(tmp_path / "l"), since="2024-02-05 00:00:00", cats=["a"]) | {"bytes": 0} == {"rows": 1, "bytes": 0, "returned": 0}
    assert layout.window(spark, str(tmp_path / "l")).count() == 5


def test_layout_shares_a_large_month_between_tasks(spark, tmp_path):
    """One month and category, and rows without a time: several files each, of ranges of time; nothing is lost."""
    rows = articles(spark, *({"pub": f"2024-02-{1 + i % 28:02d} 0{i % 10}:00:00" if i % 3 else None, "cat": "a"} for i in range(300)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layout.write_by_month(rows, str(tmp_path / "l"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folders = [f for f in (tmp_path / "l").rglob("category=a")]
    assert len(folders) == 2 and sum(len(list(f.glob("*.parquet"))) for f in folders) >= 4
    assert layout.window(spark, str(tmp_path / "l")).count() == 300
    since = layout.window(spark, str(tmp_path / "l"), since="2024-02-20 00:00:00", cats=["a"])
    assert {r.id for r in since.collect()} == {r.id for r in rows.where("pub >= '2024-02-20'").collect()}


def test_a_copy_halts_at_its_first_bad_page(spark, tmp_path):
    rows = spark.range(10).select((F.col("id") * 3).alias("k"), F.lit("v").alias("v"))
    bad = rows.withColumn("v", F.when(F.col("k") == 15, F.raise_error(F.lit("bad"))).otherwise(F.col("v")))
    states = lambda df, run="r": [(r.page, r.status, r.n_rows) for r in copying.copy_pages(spark, "c", df, str(tmp_path), run, "k", 4).orderBy("page").collect()]
    assert states(bad) == [(0, "copied", 4), (1, "failed", None), (2, "halted", None)]
    assert states(rows) == [(0, "skipped", 4), (1, "copied", 4), (2, "copied", 2)]
    assert states(rows, "other")[0] == (0, "copied", 4) and states(rows.limit(0), "none") == []
    assert {r.k for r in spark.read.parquet(*(f"{tmp_path}/r/c/page={i}" for i in range(3))).collect()} == set(range(0, 30, 3))


def test_a_copy_of_many_pages_takes_few_jobs(spark, tmp_path):
    """Jobs grow with the logarithm of the number of pages, whichever page is bad; counts are those of the rows that were copied."""
    rows = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("v").alias("v"))
    for at in (37, 199):
        bad = rows.withColumn("v", F.when(F.col("k") == 5 * at + 2, F.raise_error(F.lit("bad"))).otherwise(F.col("v")))
        states = lambda df: {r.page: (r.status, r.n_rows) for r in copying.copy_pages(spark, "c", df, str(tmp_path), f"r{at}", "k", 5).collect()}  # noqa: B023, E731
        assert states(bad) == {p: ("copied", 5) if p < at else ("failed", None) if p == at else ("halted", None) for p in range(200)}
        later = rows.where("k <> 998")  # gone since the pages were laid out
        assert states(later) == {p: ("skipped" if p < at else "copied", 4 if p == 199 else 5) for p in range(200)}
        folders = [f for f in (tmp_path / f"r{at}" / "c").iterdir() if f.name.startswith("page=")]
        assert len(folders) <= 20
        assert sorted(r.k for r in spark.read.parquet(*map(str, folders)).collect()) == [k for k in range(1000) if k != 998]


def test_counts_by_the_clock_run_again_alike(spark, tmp_path):
    rows = spark.createDataFrame(pd.DataFrame({"kind": ["a", "a", "b"], "ts": ["2024-01-31 15:00:00", "2024-01-31 16:30:00", "2024-02-01 01:00:00"]})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    feed = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name in ("one", "two"):  # the second has another checkpoint, as a batch that is run again
        state.keep_counts(feed(), str(tmp_path / "t"), str(tmp_path / name), lambda n: "2024-02-01 02:00:00").awaitTermination()
        assert {tuple(r) for r in state.reports(spark, str(tmp_path / "t"), 1).collect()} == {(0, "a", 1, 1, 1), (0, "b", 1, 1, 1)}
