"""Small cases with known answers for the census operators."""

import pytest
from pyspark.sql import functions as F

from orrery.functions.text import casefold, csv_row, decimal_number, mentions
from orrery.operators import categories, compare, graph, history, observations, quality, reports, serving, topics
from orrery.plans import publish
from orrery.sources import dump


def degrees(spark, titles, links, redirects):
    c = spark.createDataFrame([("x", k, t, None) for k, t in enumerate(titles)], "language string, page_id long, title string, item string")
    k = spark.createDataFrame([("x", s, t) for s, t in links], "language string, source_id long, target_title string")
    r = spark.createDataFrame([("x", a, b) for a, b in redirects], "language string, title string, target string")
    occ = graph.resolved_links(k, c, graph.resolve_redirects(r))
    rows = {x.page_id: (x.in_degree, x.out_degree) for x in graph.degrees(c, graph.edges(occ)).collect()}
    lost = graph.unresolved(occ).collect()
    return [rows[k][0] for k in range(len(titles))], [rows[k][1] for k in range(len(titles))], lost[0].unresolved if lost else 0


@pytest.mark.parametrize("titles, links, redirects, want", [
    ("ABC", [(0, "B"), (0, "R"), (0, "A"), (0, "X")], [("R", "R2"), ("R2", "B"), ("X", "Y"), ("Y", "X")], ([0, 1, 0], [1, 0, 0], 1)),
    ("AB", [(0, "A")], [], ([0, 0], [0, 0], 0)),
    ("ABC", [(0, "C"), (0, "C"), (1, "C")], [], ([0, 0, 2], [1, 1, 0], 0)),
    ("A", [(0, "R")], [("R", "missing")], ([0], [0], 1)),
    ("AB", [(0, "R0")], [(f"R{k}", f"R{k + 1}") for k in range(37)] + [("R37", "B")], ([0, 1], [1, 0], 0)),
])
def test_degrees(spark, titles, links, redirects, want):
    assert degrees(spark, titles, links, redirects) == want


def test_items(spark):
    rows = spark.createDataFrame([("Q1",), ("Q0",), ("Q12\n",), ("q1",), ("Q1２",), (None,), ("Q99999999999999999999999",)], "item string")
    assert [r[0] for r in rows.select(graph.valid_item(F.col("item"))).collect()] == [True, False, False, False, False, False, True]


def test_categories(spark):
    pc = spark.createDataFrame([("x", 1, "Leaf"), ("x", 1, "Root"), ("x", 1, "stub maintenance"), ("x", 2, "CycleA"), ("x", 2, "CycleB"), ("x", 2, "CycleA")], "language string, page_id long, category string")
    up = spark.createDataFrame([("x", "Leaf", "Mid"), ("x", "Mid", "Root"), ("x", "CycleA", "CycleB"), ("x", "CycleB", "CycleA")], "language string, category string, parent string")
    census = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3)], "language string, page_id long")
    rank = categories.ranked(pc, census, categories.ancestors(up), patterns=("stub",), min_support=1)
    assert sorted((r.page_id, r.category, r["rank"]) for r in rank.collect()) == [(1, "Leaf", 1), (2, "CycleA", 1), (2, "CycleB", 2)]
    named = lambda *rows: spark.createDataFrame(rows, "language string, page_id long, category string")
    assert sorted((r.page_id, r.choice, r.manual) for r in categories.choices(rank, census, named(("x", 1, "Root"), ("y", 2, "CycleB")), pc).collect()) == [(1, "Root", True), (2, "CycleA", False), (3, None, False)]
    with pytest.raises(Exception, match="an override names"):
        categories.choices(rank, census, named(("x", 3, "Root")), pc).collect()
    for bad in (0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            categories.check_rules((), {}, bad)


WIKI = {
    "Plain prose without any markup.": (0, 0, 0, 0, 0),
    "See [[Alpha]] and [[Beta|the second]], but not [Gamma] or [[Delta].": (0, 0, 2, 0, 0),
    "[[Image:a.png|thumb|of [[Alpha]]]] next to [[Media:b.ogg]]": (0, 0, 0, 2, 0),
    "[[Category:One]]\n[[Category:Two|key]] [[:Category:Three]]": (0, 0, 1, 0, 2),
    "[[two\nlines]] [[]] [[open": (0, 0, 2, 0, 0),
    "[[]] an empty find, then one to the next end]]": (0, 0, 2, 0, 0),
    "== One ==\ntext\n=== Two ===\n==== Four ====\n=half=": (0, 2, 0, 0, 0),
    'a<ref>x</ref> b<ref name="n" /> c<REFERENCES/> d<reF group=g>y\n</rEf>': (3, 0, 0, 0, 0),
    "ü==é==<ref/>[[Ö]]": (1, 1, 1, 0, 0),
}


@pytest.mark.parametrize("text", WIKI)
def test_wikitext_features(spark, text):
    r = quality.features(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.refs, r.headings, r.links, r.media, r.categories) == WIKI[text] and r.bytes == len(text.encode())


def test_quantiles(spark):
    import numpy as np

    from orrery.operators.ranks import quantile

    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 999)) for v in np.round(rng.exponential(3, n), 1)] + [("a", None), ("b", float("nan")), ("d", None)]
    got = {r.g: r.q for r in quantile(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), 0.95, "q").collect()}
    assert set(got) == {"a", "b", "c"} and all(got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None and v == v], 0.95)) for g in got)


def test_quality_status(spark):
    content = spark.createDataFrame([("x", 1, ""), ("x", 2, None), ("x", 3, "a" * 400)], "language string, page_id long, text string")
    pages = spark.createDataFrame([("x", k) for k in range(1, 5)], "language string, page_id long")
    got = {r.page_id: (r.quality_status, r.quality_score) for r in quality.supplement(content, pages).collect()}
    assert got[1] == ("scored", 0.0) and got[2] == ("missing_wikitext", None) and got[4] == ("missing_current_page", None)
    assert got[3][1] == pytest.approx(0.395 * 0.2)


def test_history(spark):
    made = spark.createDataFrame([(1, 7, 10), (2, 7, 20), (3, 7, 20), (4, 7, 30)], "page_id long, user_id long, us long")
    edit = spark.createDataFrame([(7, 5, 0), (7, 10, 0), (7, 20, 1), (7, 29, 0)], "user_id long, us long, ns long")
    got = sorted((r.page_id, r.prior_main, r.prior_other, r.prior_articles) for r in history.prior_edits(made, edit).collect())
    assert got == [(1, 1, 0, 0), (2, 2, 0, 1), (3, 2, 0, 1), (4, 3, 1, 3)]
    stamps = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00.0"), (2, "2024-01-01 00:00:60"), (3, "")], "page_id long, at string")
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id long")
    assert [r.creation_status.split("_")[0] for r in history.creation_dates(stamps, pages).orderBy("page_id").collect()] == ["reconstructed", "ambiguous", "missing"]
    assert [r[0] for r in spark.range(26).select(history.continuity(F.col("id"))).collect()][::6] == ["none", "three_to_six", "seven_to_twelve", "thirteen_to_twenty_four", "thirteen_to_twenty_four"]


def test_titles_of_two_pages(spark):
    with pytest.raises(Exception, match="two pages have the title"):
        degrees(spark, "AAB", [(2, "A")], [])
    r = spark.createDataFrame([("x", "R", "A", 1), ("x", "R", "B", 0)], "language string, title string, target string, position int")
    assert graph.resolve_redirects(r).first().target == "A"


def test_comparison(spark):
    c = spark.createDataFrame([("a", 1, "t1", "Q1"), ("a", 2, "t2", "Q2"), ("b", 1, "u1", "Q1"), ("b", 2, "u2", "Q2")], "language string, page_id long, title string, item string")
    edge = spark.createDataFrame([("b", 2, 1)], "language string, source_id long, target_id long")
    unique, degree = graph.unique_items(c), graph.degrees(c, edge)
    orphans = unique.join(degree.filter("in_degree = 0"), ["language", "page_id"]).select("language", "page_id", "item")
    found = compare.evidence(orphans, unique, graph.matchable_edges(edge, unique)).collect()
    assert [tuple(r) for r in found] == [("a", 1, 2, "b", 2, 1)]
    c12 = spark.createDataFrame([("a", 1, k, 1, k > 6, k) for k in range(1, 13)], "language string, target_id long, link_id long, references int, dead_end boolean, position int")
    assert {(r.dead_end, r.link_id) for r in compare.shortlist(c12).collect()} == {(False, k) for k in range(1, 6)} | {(True, k) for k in range(7, 12)}


def test_reports(spark):
    rows = spark.createDataFrame([(k % 2 == 0, float(k)) for k in range(101)] + [(True, None), (False, float("nan"))], "orphan boolean, value double")
    assert reports.order_statistics(rows).first() == (2.0, 98.0)
    got = {(r.orphan, r.bin): r["count"] for r in reports.histogram(rows).collect()}
    assert len(got) == 40 and got[True, 0] == 1 and got[False, 0] == 1 and got[True, 19] == 1 and got[False, 19] == 1 and sum(got.values()) == 101
    same = spark.createDataFrame([(True, 3.0)], "orphan boolean, value double")
    assert [r.bin for r in reports.histogram(same).filter("count > 0").collect()] == [10]
    with pytest.raises(ValueError):
        reports.calculate("nothing")


def test_history_supplement(spark):
    """Unknown stays apart from zero, and an unreadable edit takes the dated measures of its user alone."""
    from orrery.operators import supplement

    rev = "page_id long, revision_id long, parent_id long, at string, user_id long, hidden boolean, groups string, tags string, registration string, created string, first string, before boolean"
    one = lambda page, user, at="2024-03-05 00:00:00", **kw: tuple({"page_id": page, "revision_id": page * 10, "parent_id": 0, "at": at, "user_id": user, "hidden": False, "groups": "", "tags": "a,b", "registration": "2024-03-01 00:00:00", "created": None, "first": "", "before": False, **kw}.values())
    revisions = spark.createDataFrame([one(1, 7), one(2, 8), one(3, None), one(4, 7), one(4, 7, revision_id=41), one(5, 9, hidden=True), one(6, 7, created="2020-01-01 00:00:00")], rev)
    pages = spark.createDataFrame([(k,) for k in range(1, 8)], "page_id long")
    stamps = spark.createDataFrame([(k, "2024-03-05 00:00:00") for k in (1, 2, 4)], "page_id long, at string")
    months = [(7, f"2024-{m:02d}-0{k} 00:00:00", k % 2) for m in (1, 2) for k in range(1, 6)]
    edits = spark.createDataFrame([*months, (8, "2024-01-01 00:00:00", 0), (8, "2024-13-01 00:00:00", 0), (99, "bad", 0)], "user_id long, at string, ns long")
    groups = spark.createDataFrame([(7, "bot", "invalid"), (8, "sysop", None)], "user_id long, name string, expiry string")
    events = spark.createDataFrame([], "page_id long, event_type string, at string")
    got = {r.page_id: r for r in supplement.supplement(revisions, events, stamps, edits, groups, pages, F.lit("2025-01-01").cast("timestamp"), "xx").collect()}
    assert (got[1].prior_main, got[1].prior_other, got[1].prior_articles, got[1].months, got[1].bucket, got[1].tenure_days, got[1].is_bot_now, got[1].creator_key) == (4, 6, 0, 2, "two", 4.0, None, "xx:history-user:7")
    assert (got[2].prior_main, got[2].bucket, got[2].creator_history_status, got[2].is_bot_now, got[2].creation_tags_history, got[2].creator_groups_status) == (None, None, "invalid_history_timestamp", False, ["a", "b"], "unknown")
    want = {3: "history_hidden_or_unregistered_creator", 4: "history_ambiguous_initial_revisions", 5: "history_hidden_or_unregistered_creator", 6: "history_inconsistent_creation_dates", 7: "history_missing_initial_revision"}
    assert {k: got[k].creator_attribution for k in want} == want and all(got[k].creator_history_status == "unavailable" and got[k].prior_main is None for k in want)


def test_time_key(spark):
    from orrery.operators.supplement import time_key

    times = ["2024-01-01 10:00:59.999999999", "2024-01-01 10:00:60", "2024-01-01 10:00:60.000000001", "2024-01-01 10:01:00", "0000-01-01 00:00:00", "2024-02-30 00:00:00", "2024-01-01 10:00:61", "bad"]
    rows = spark.createDataFrame([(t,) for t in times], "at string").withColumn("k", time_key(F.col("at")))
    assert [r.at for r in rows.filter("k IS NOT NULL").orderBy("k").collect()] == times[:4]


def test_creators_listing(spark):
    from orrery.operators import editorial

    rows = spark.createDataFrame([(f"U{k:02d}", k, None if k % 3 else 100 - k, k % 2) for k in range(40)], "key string, articles long, total long, orphans long")
    total, page = editorial.creators(rows, "u", "articles-desc", 25, census_counts=False)
    assert total.first().total == 40 and [r.key for r in page.collect()][-1] == "U38" and editorial.creators(rows, "u3")[0].first().total == 10
    with pytest.raises(ValueError):
        editorial.creators(rows, offset=3)


def test_serving(spark):
    pages = spark.createDataFrame([("a", k, f"Page {k:02d}", None, None, True, None if k == 3 else k, 1.0) for k in range(1, 61)], "language string, page_id long, title string, category string, topic_labels array<string>, orphan boolean, count long, age double")
    total, page = serving.run(pages, serving.PageQuery(sort="count", descending=True, offset=50))
    assert total.first().total == 60 and page.collect()[-1].page_id == 3
    for bad in (dict(offset=7), dict(kind="x"), dict(kind="creators"), dict(sort="x"), dict(hidden=["c"] * 129)):
        with pytest.raises(ValueError):
            serving.PageQuery(**bad).check()


def test_topics(spark):
    with pytest.raises(ValueError):
        topics.predicted(type("M", (), {"labels": ["a", "b"], "predict": lambda self, t: {"a": 1.0}})(), "x")
    inputs = spark.createDataFrame([("a", 1, "Q2 Q4", 2, True), ("a", 2, "", 0, True), ("a", 3, "", 0, False)], "language string, page_id long, input string, n long, mapped boolean")
    got = [tuple(r[2:]) for r in topics.supplement(inputs, topics.LinearStub(["__label__A_b", "c"])).orderBy("page_id").collect()]
    assert got == [("predicted", 2, ["A b"]), ("no_model_vocabulary", 0, None), ("no_mapped_outlinks", 0, None)]


def test_dump(spark, tmp_path):
    assert dump.parse_insert(r"INSERT INTO `t` VALUES (1,'a\'b\\',NULL),(-2.5,'x,(y)\n','');") == [["1", "a'b\\", None], ["-2.5", "x,(y)\n", ""]]
    for bad in ("INSERT INTO t VALUES (1,", "INSERT INTO t VALUES (,1);", "INSERT INTO t VALUES (1"):
        with pytest.raises(ValueError):
            dump.parse_insert(bad)
    (tmp_path / "page.sql").write_text("CREATE TABLE `page` (\n  `page_id` int,\n  `page_title` text\n);\nINSERT INTO `page` VALUES (1,'A_b'),(2,'C');\n")
    assert [tuple(r) for r in dump.read_dump(spark, str(tmp_path / "page.sql"), "page", ["page_title"]).collect()] == [("A_b",), ("C",)]
    (tmp_path / "e.tsv").write_text("\t".join(str(k) for k in range(78)) + "\n")
    assert dump.read_events(spark, str(tmp_path / "e.tsv")).first().revision_id == "60"
    (tmp_path / "c.xml").write_text("<mediawiki xmlns='x'><page><id>1</id><ns>0</ns><revision><id>9</id><text> a </text></revision></page><page><id>2</id><ns>0</ns><revision><id>8</id><text/></revision></page><page><id>3</id><ns>0</ns><revision><id>7</id><model>json</model><text>x</text></revision></page></mediawiki>")
    assert [tuple(r) for r in dump.read_content(spark, str(tmp_path / "c.xml")).orderBy("page_id").collect()] == [(1, 9, " a "), (2, 8, ""), (3, 7, None)]
    assert dump.history_partitions(["2021-01", "2020"]) == ["2020", "2021-01"]
    for bad in (["2020", "2020-05"], ["2020", "2022"], ["x"]):
        with pytest.raises(ValueError):
            dump.history_partitions(bad)
    assert dump.wiki_database("zh-yue") == "zh_yuewiki" and dump.select_languages(["c", "a", "b"], ["b", "c"]) == ["c", "b"]


def test_anchors(spark):
    html = """<a href="x>y">1</a><A class='c' HREF='q"r'>2</a><a title="href=no" href=plain>3</a><abbr href="no">"""
    assert spark.createDataFrame([(html,)], "h string").select(dump.anchors(F.col("h"))).first()[0] == ["x>y", 'q"r', "plain"]


def test_text(spark):
    r = spark.createDataFrame([("Straße", "٣٤")], "a string, b string").select(casefold("a"), decimal_number("b")).first()
    assert tuple(r) == ("strasse", 34)
    assert mentions("x {{t|Foo}} [[Foo]] foo bar", "Foo Bar") and not mentions("{{ a {{b}} Foo }} foobar [[Foo]]", "Foo")
    assert csv_row([None, True, 1.5, ["a", "b"], 'q"', 0]) == ",True,1.5,\"['a', 'b']\",\"q\"\"\",0\r\n"


def test_observations(spark):
    rows = spark.createDataFrame([("c", "2024-01-01T01:00:00+02:00", "2024-01-02T00:00:00Z", 2), ("c", "2023-12-31T23:00:00Z", "2024-01-02T01:00:00+01:00", 1)], "k string, started string, finished string, position long")
    assert observations.collection_interval(rows, ["k"]).first()[1:] == ("2023-12-31T23:00:00Z", "2024-01-02T01:00:00+01:00")
    left, right = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([], "id int, v int")
    with pytest.raises(Exception, match="no record"):
        observations.strictly_joined(left, right, ["id"], "quality").collect()


def test_publish(spark, tmp_path):
    root, t = str(tmp_path / "p"), spark.createDataFrame([("a", 1), ("b", 2)], "language string, v int")
    m = publish.publish(spark, root, {"pages": t})
    assert publish.current(spark, root) == m and publish.table(spark, root, "pages").count() == 2
    with pytest.raises(ValueError):
        publish.publish(spark, root, {"pages": t}, {"orphans without target": t})
    assert publish.current(spark, root) == m
    assert publish.fingerprint(t).first() == publish.fingerprint(t.repartition(3)).first()
    print_of = lambda *rows: publish.fingerprint(spark.createDataFrame(rows, "a string, b string")).first().total
    assert len({print_of(r) for r in (("x", None), (None, "x"), ("x", "null"), ("x", ""), ('x","', None), ("x", "x"))}) == 6
    publish.publish(spark, root, {"pages": t.limit(1)})
    assert publish.current(spark, root) != m and publish.table(spark, root, "pages").count() == 1
    assert publish.stale_pairs({"a": "1", "b": "1", "z": "1"}, {"a": "1", "b": "2", "c": "1"})[1] == ["z"]
    assert publish.reuse({"sources": "s", "definition": "d", "output": "o"}, "s", "d", "o") == "verified_reuse"
    reviews = {}
    publish.upsert_review(reviews, ("a", 1, 2), "closed", 0)
    with pytest.raises(ValueError):
        publish.upsert_review(reviews, ("a", 1, 2), "open", 0)
    assert publish.bench_verdict([(2, 1)] * 3, [(1, 1)] * 3) == "passed" and publish.bench_verdict([(2, 1)], []) == "inconclusive"


def test_monthly_edits(spark, tmp_path):
    from orrery.streaming.ingest import monthly_edits

    rows = [(7, f"2024-03-{k:02d} 10:00:00") for k in range(1, 32)] + [(7, "2024-04-01 00:00:00"), (8, "2024-03-31 23:59:59")]
    spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "e"))
    stream = monthly_edits(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("monthly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.month.month, r["count"]) for r in spark.table("monthly").collect()) == [(7, 3, 31), (7, 4, 1), (8, 3, 1)]


def test_ingest(spark, tmp_path):
    from orrery.streaming.ingest import ingest

    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.range(5).write.parquet(src)
    ingest(spark, src, "id long", out, cp)
    spark.range(5, 8).write.mode("append").parquet(src)
    ingest(spark, src, "id long", out, cp)
    assert spark.read.parquet(out).count() == 8
