"""Golden rows and edge rows of the market monitoring operators."""

import os
import re
import time

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souklens.functions import text, urls
from souklens.operators import classify, dedupe, hosts, index, keywords, products, requests, results, search, top
from souklens.plans import pipeline as plans
from souklens.schema import CURRENT_RUN, PREVIOUS_RUN, PROBABILITY, Prompt
from souklens.shared import Scratch
from souklens.sources import dims, replies
from souklens.streaming import dedupe as streaming
from souklens.streaming import pipeline as stream_stages


def column(spark, kind, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_domain(spark):
    cases = {"http://u:p@WWW.F.ch:80/p": "f.ch", "a.ch:8080/z": "a.ch", "www.www.x.ch": "www.x.ch", "HTTPS://Foo.com/x": "https", "": "http", "https://[::1]:8/x": "::1", None: None}
    assert column(spark, "string", list(cases), urls.domain) == list(cases.values())


def test_country(spark):
    cases = [("http://laden.at", "at", True), ("http://laden.at/angebot?id=7", "at", True), ("http://magasin.com/a", "at", True), ("http://magasin.fr", "at", False), ("http://magasin.fr/b.html", "ht", True), ("HTTP://LADEN.AT/X", "at", True)]
    df = spark.createDataFrame(cases, "u string, cc string, want boolean")
    assert df.where(urls.in_country(F.col("u"), F.col("cc")) != F.col("want")).count() == 0


def test_labels(spark):
    cases = {" 1\n": 1, "1.0": None, "yes": None, "": None, "+7": 7, "1_0": None, "99999999999999999999": None, None: None}
    assert column(spark, "string", list(cases), text.whole_number) == list(cases.values())


def test_hosts_and_marketplaces(spark):
    h = dims.hosts(spark, [("Markt", "markt.at, kiosk.at,laden.at"), ("Other", ["kiosk.at", "b.ch"]), ("Empty", "a.ch, ,c.ch")])
    assert [r.domains for r in h.orderBy("ord").collect()] == [["markt.at", "kiosk.at", "laden.at"], ["kiosk.at", "b.ch"], ["a.ch", "", "c.ch"]]
    df = spark.createDataFrame([("Kiosk.at",), ("b.ch",), ("x.ch",)], "domain string")
    assert {r.domain: r.marketplace_name for r in hosts.with_marketplace(df, h).collect()} == {"Kiosk.at": "Markt", "b.ch": "Other", "x.ch": "Google"}
    assert {r.marketplace_name for r in hosts.with_marketplace(df, None).collect()} == {"Google"}
    assert {r.domain for r in hosts.exclude_hosts(df, h).collect()} == {"Kiosk.at", "x.ch"}
    assert {r.domain for r in hosts.exclude_hosts(df, h, case_sensitive=False).collect()} == {"x.ch"}


def test_codes(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"name": "Hebrew", "code": "iw"}, {"name": "Hebrew", "code": "he"}, {"name": "German", "code": "de"}]')
    dim = dims.read_languages(spark, str(tmp_path / "l.json"))
    df = spark.createDataFrame([("Hebrew", None), ("german", "DE"), ("German", "")], "name string, given string")
    assert sorted(r.code for r in dims.with_code(df, dim, "name", "given", "code", "language").collect()) == ["de", "de", "he"]
    with pytest.raises(Exception, match="unknown language: Klingon"):
        dims.with_code(spark.createDataFrame([("Klingon", None)], df.schema), dim, "name", "given", "code", "language").collect()


def test_prompts(spark):
    Prompt("a", "c", "s", (3, 5, 8)), Prompt("a", "c", "s", ())
    for bad in ((4, -2), (True, 2), (1.5,)):
        with pytest.raises(ValueError):
            Prompt("a", "c", "s", bad)
    bad = spark.createDataFrame([("a", [6, -3])], "name string, allowed_classes array<int>")
    with pytest.raises(Exception, match="negative class"):
        dims.checked_prompts(bad).collect()


def test_search_string(spark):
    df = spark.createDataFrame([("t", ["a.ch", "b.ch"]), ("u", [])], "t string, s array<string>")
    assert [r[0] for r in df.orderBy("t").select(requests.search_string(F.col("t"), F.col("s"))).collect()] == ["t site:a.ch OR site:b.ch", "u"]


def test_replies(spark):
    df = spark.createDataFrame([(1, '{"organic_results":[{"link":"a"},{"link":null},{"link":"b"}]}'), (2, "{}"), (3, None), (4, "junk")], "search_id int, payload string")
    good, bad = replies.usable_hits(replies.search_hits(df))
    assert [(r.position, r.url) for r in good.orderBy("position").collect()] == [(0, "a"), (2, "b")] and bad.count() == 1
    k = spark.createDataFrame([('{"tasks":null}',), ("{}",), ('{"tasks":[{"result":[{"items":null}]},{"result":[{"items":[{"keyword":"b","keyword_info":{"search_volume":null}},{"keyword":"a","keyword_info":{"search_volume":10}}]}]}]}',)], "payload string")
    good, bad = replies.usable_keywords(replies.keyword_items(k, "suggested"))
    assert [(r.text, r.volume) for r in good.collect()] == [("a", 10)] and [r.reason for r in bad.collect()] == ["no volume"]


def test_replies_that_are_no_json(spark):
    """What can't be read is kept with its reason; of a reply with one bad part the rest is read all the same."""
    search_ = [None, "", "junk", '{"organic_results":[{"link":"a"}', "[1, 2]", "5", "{}", '{"organic_results":null}', '{"organic_results":"none"}', '{"organic_results":[{"link":"a"},7]}', '{"organic_results":[{"link":"b"}]}']
    df = spark.createDataFrame(list(enumerate(search_)), "search_id int, payload string")
    reasons = {r.search_id: r.reason for r in replies.unreadable(df, "search").collect()}
    assert reasons == {0: "no reply", 1: "no JSON", 2: "no JSON", 3: "no JSON", 4: "other shape", 5: "other shape", 8: "other shape", 9: "other shape"}
    assert {r.payload for r in replies.unreadable(df, "search").where("search_id = 9").collect()} == {search_[9]}
    assert ("b",) in {(r.url,) for r in replies.search_hits(df).collect()}
    for kind, ok, bad in (("suggested", '{"tasks":[{"result":null}]}', '{"tasks":[{"result":[{"items":[{"keyword_info":{"search_volume":"many"}}]}]}]}'), ("related", '{"tasks":[]}', '{"tasks":{}}'), ("details", '{"product":{"metadata":{"probability":"x"}}}', '{"product":"none"}')):
        df = spark.createDataFrame([(0, ok), (1, bad), (2, bad[:-1])], "i int, payload string")
        assert {r.i: r.reason for r in replies.unreadable(df, kind).collect()} == {1: "other shape", 2: "no JSON"}, kind


def test_details(spark):
    product = '{"product":{"name":"n","price":12.50,"mainImage":{"url":"m"},"images":[{"url":"m"},{"url":""},{"url":null},{"url":"n"}],"metadata":{"probability":"0.1"}}}'
    rows = replies.product_details(spark.createDataFrame([("u", product), ("v", "{}")], "url string, payload string")).orderBy("url").collect()
    assert rows[0].product_images == ["m", "m", "n"] and rows[0].probability == 0.1 and rows[1].product_images == [] and rows[1].probability is None
    df = spark.createDataFrame([(0.1,), (float("nan"),), (None,), (0.5,)], "probability double").withColumns({"filtered": F.lit(False), "filtered_at_stage": F.lit(None).cast("string")})
    assert [r.filtered for r in products.flag_probability(df).collect()] == [True, True, False, False]
    assert [r.filtered for r in products.flag_probability(df, 0.6, "drop").collect()] == [True, True, True, True]
    assert {r.filtered_at_stage for r in products.flag_probability(df).where("filtered").collect()} == {PROBABILITY}


def test_ranking(spark):
    own = spark.createDataFrame([("seed", "a", 10, 0), ("seed", "seed", 99, 1)], "seed string, text string, volume long, ord int")
    other = spark.createDataFrame([("seed", "a", 20, 0), ("seed", "c", 20, 1)], own.schema)
    assert [r.text for r in keywords.rank_terms(own, other, 5).orderBy("rank").collect()] == ["a", "c"]


@pytest.mark.parametrize("partitions", ["1", "4", "50"])
def test_repeated_urls(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = [("r", 0, 0, "u", False), ("r", 1, 0, "u", False), ("r", 0, 1, "v", True), ("r", 1, 1, "v", False), ("r", 2, 0, "w", False), ("r", 2, 1, "w", False), ("q", 0, 0, "u", False)]
    df = spark.createDataFrame(rows, "run_id string, search_ord int, position int, url string, filtered boolean").withColumn("filtered_at_stage", F.when(F.col("filtered"), "earlier"))
    out = dedupe.flag_current_run(dedupe.flag_previous_runs(df, spark.createDataFrame([("w",), ("w",)], "url string")))
    got = {(r.run_id, r.search_ord, r.position): r.filtered_at_stage for r in out.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 7 and {k for k, v in got.items() if v == CURRENT_RUN} == {("r", 1, 0)} and {k for k, v in got.items() if v == PREVIOUS_RUN} == {("r", 2, 0), ("r", 2, 1)}
    assert {r.url for r in dedupe.new_seen_urls(out, spark.createDataFrame([("u",)], "url string")).collect()} == {"v"}


def test_store_of_seen_urls(spark, tmp_path):
    """The store is joined without a shuffle of its own, and holds each url once, whichever sessions add them."""
    urls_ = lambda *xs: spark.createDataFrame([(x,) for x in xs], "url string")
    path = str(tmp_path / "seen")
    assert dedupe.stored_seen(spark, path, 8).count() == 0
    dedupe.add_seen(urls_("a", "b", "b", None), path, 8)
    dedupe.add_seen(urls_("b", "c"), path, 8)
    for session in (spark, spark.newSession()):
        assert sorted(r.url for r in dedupe.stored_seen(session, path, 8).collect()) == ["a", "b", "c"]
    hits = spark.createDataFrame([("a", False), ("x", False), (None, False), ("c", True)], "url string, filtered boolean").withColumn("filtered_at_stage", F.when(F.col("filtered"), "earlier"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = dedupe.flag_previous_runs(hits, dedupe.stored_seen(spark, path, 8))
    got, plan = {r.url: r.filtered_at_stage for r in out.collect()}, out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"a": PREVIOUS_RUN, "x": None, None: None, "c": "earlier"}
    initial = plan.partition("Initial Plan")[2] or plan
    assert initial.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in initial


def test_classify(spark):
    df = spark.createDataFrame([(1, "u", "n", "", False), (2, "v", None, "d", False), (3, "w", "n", "d", True)], "id int, url string, product_name string, product_description string, filtered boolean")
    seen = spark.sparkContext.accumulator(0)

    def predict(batch: pd.DataFrame) -> pd.Series:
        seen.add(len(batch))
        return pd.Series([" 1\n" if p == "a" else "7" for p in batch["prompt"]])

    out = {r.id: r.classifications for r in classify.classify(df, [Prompt("a", "c", "s", (0, 1)), Prompt("x.b", "c", "s", (0, 1))], predict).collect()}
    assert out == {1: {"a": 1, "x.b": -1}, 2: {"a": -1, "x.b": -1}, 3: {}} and seen.value == 2


def products_of(spark, names, parts=2):
    rows = [(i, f"u{i}", n, "d", False, [n], None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "id int, url string, product_name string, product_description string, filtered boolean, product_images array<string>, gone int").repartition(parts)


def test_predictor_that_fails_for_some_rows(spark):
    """A row that makes it raise, or has no reply, loses its own label alone, whatever stands in the same batch."""
    names = [f"n{i}" for i in range(40)] + ["bad", "bad", "short", None]
    asked = spark.sparkContext.accumulator(0)

    def predict(batch: pd.DataFrame) -> pd.Series:
        asked.add(1)
        if (batch["product_name"] == "bad").any():
            raise KeyError("no such thing")
        return pd.Series(1, index=batch.index)[batch["product_name"] != "short"]  # numbers are replies, too

    out = classify.classify(products_of(spark, names, 1), [Prompt("a", "c", "s", (0, 1)), Prompt("b", "c", "s", (0,))], predict, errors="errors").collect()
    by = {r.id: r for r in out}
    assert len(out) == len(names) and by[3].product_images == ["n3"] and by[3].gone is None
    assert all(by[i].classifications == {"a": 1, "b": -1} and by[i].errors == {} for i in range(40))
    assert by[40].classifications == {"a": -1, "b": -1} and by[40].errors == dict.fromkeys("ab", "KeyError: 'no such thing'")
    assert by[42].errors == dict.fromkeys("ab", "0 replies for 1 rows") and by[43].classifications == {"a": -1, "b": -1} and by[43].errors == {}
    assert asked.value < 2 * 2 * (3 * 6 + 1)


def test_predictor_that_always_fails(spark):
    def predict(batch):
        raise RuntimeError("down")

    out = classify.classify(products_of(spark, ["a", "b", "c"]), [Prompt("a", "c", "s", (1,))], predict, default=-7).collect()
    assert [r.classifications for r in out] == [{"a": -7}] * 3
    assert classify.classify(products_of(spark, []), [Prompt("a", "c", "s", (1,))], predict).collect() == []
    assert [r.classifications for r in classify.classify(products_of(spark, ["a"]), [], predict, errors="e").collect()] == [{}]


def test_predictor_made_once_for_each_task(spark):
    made = spark.sparkContext.accumulator(0)

    def make():
        made.add(1)
        time.sleep(0.2)  # a model that is slow to load
        return lambda batch: pd.Series(["1"] * len(batch))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    out = classify.classify(products_of(spark, ["x"] * 60, 3), [Prompt("a", "c", "s", (1,)), Prompt("b", "c", "s", (1,))], make=make).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made.value == 3 and all(r.classifications == {"a": 1, "b": 1} for r in out) and len(out) == 60


def test_prompts_by_run(spark):
    df = products_of(spark, ["x", "y", "z"]).withColumn("run_id", F.element_at(F.array(F.lit("r"), F.lit("q"), F.lit("none")), F.col("id") + 1))
    prompts = spark.createDataFrame([("r", 0, "a", "c", "old", [1]), ("r", 1, "a", "c", "new", [0, 1]), ("r", 2, "b", "c", "s", [2]), ("q", 0, "b", "c", "new", [1])], "run_id string, ord int, name string, context string, system_prompt string, allowed_classes array<int>")

    def predict(batch):
        assert batch["prompt"].nunique() == 1 and batch["system_prompt"].nunique() == 1 and "old" not in set(batch["system_prompt"])
        return pd.Series(["1"] * len(batch))

    out = {r.run_id: r.classifications for r in classify.classify(df, prompts, predict).collect()}
    assert out == {"r": {"a": 1, "b": -1}, "q": {"b": 1}, "none": {}}


def test_hosts_by_run(spark):
    h = spark.createDataFrame([("r", 0, "Markt", ["a.ch", "B.ch"]), ("q", 1, "Bazar", ["b.ch"])], "run_id string, ord int, name string, domains array<string>")
    df = spark.createDataFrame([("r", "b.ch"), ("q", "b.ch"), ("q", "a.ch"), ("p", "a.ch"), (None, "a.ch")], "run_id string, domain string")
    assert {(r.run_id, r.domain): r.marketplace_name for r in hosts.with_marketplace(df, h, by=["run_id"]).collect()} == {("r", "b.ch"): "Markt", ("q", "b.ch"): "Bazar", ("q", "a.ch"): "Google", ("p", "a.ch"): "Google", (None, "a.ch"): "Google"}
    assert {(r.run_id, r.domain) for r in hosts.exclude_hosts(df, h, by=["run_id"]).collect()} == {("r", "b.ch"), ("q", "a.ch"), ("p", "a.ch"), (None, "a.ch")}


def test_settings_by_run(spark):
    runs = spark.createDataFrame([("r", "t", "German", "Wien", None, ""), ("q", "t", "Latin", "Roma", "LA", "VA")], "run_id string, search_term string, language string, location string, language_code string, location_code string")
    dim = lambda n, c: spark.createDataFrame([(n, c)], "name string, code string")
    h = spark.createDataFrame([("r", 1, "N", ["b.at"]), ("r", 0, "M", ["a.at", "b.at"])], "run_id string, ord int, name string, domains array<string>")
    out = {r.run_id: (r.language, r.country, r.sites) for r in plans.own_settings(runs, dim("German", "DE"), dim("Wien", "at"), h).collect()}
    assert out == {"r": ("de", "at", ["a.at", "b.at", "b.at"]), "q": ("la", "va", None)}
    with pytest.raises(Exception, match="unknown location: Wien"):
        plans.own_settings(runs, dim("German", "DE"), dim("Bern", "ch"), h).collect()


def test_details_of_one_url_twice(spark):
    kind = "url string, product_name string, product_price string, product_description string, product_images array<string>, probability double"
    details = spark.createDataFrame([("u", "n", None, "d", [], 0.5), ("u", "n", "1", "d", ["i"], 0.4), ("u", None, None, None, None, None), ("v", "a", None, None, [], None), ("v", "b", None, None, [], None), (None, "x", "y", "z", [], 1.0)], kind)
    hits = spark.createDataFrame([(0, "u"), (1, "u"), (2, "v"), (3, "w"), (4, None)], "id int, url string")
    assert {r.id: r.product_name for r in products.with_details(hits, details).collect()} == {0: "n", 1: "n", 2: "b", 3: None, 4: None}
    assert {r.product_price for r in products.with_details(hits, details).where("url = 'u'").collect()} == {"1"}


PAGES = [
    (0, "http://a.example.at/1", "<p>Red bike, red bell</p>"), (1, "http://b.example.ch", "red <b>bike</b>"), (1, "http://b.example.ch", "bike bell"), (1, "http://c.example.ch", "red bike"), (2, "http://www.example.at", "red"),
    (3, None, "red bike"), (None, "http://a.example.at", "bike red red"), (4, "http://d.at", None), (5, "http://d.at", ""), (6, "http://xexample.at", "red bike"), (7, "http://a.example.at/2", "<script>red</script> bike"),
]
SEARCHES = [("s", "Red bike", 100, None), ("t", "red RED", 2, []), ("u", "bike", 100, ["example.at"]), ("v", "absent", 5, None), ("w", "", 5, None), ("x", "red bike", 2**31 - 1, None)]


def hit_rows(df):
    return sorted((tuple(r) for r in df.select("search_id", "position", "page_id", "url", "score").collect()), key=str)


@pytest.mark.parametrize("few", [200, 0])
def test_search_with_and_without_index(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)  # wanted tokens sent to the pages, or joined
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    requests_ = spark.createDataFrame(SEARCHES, "search_id string, term string, num_results int, sites array<string>")
    want = hit_rows(search.search_pages(pages, requests_))
    assert [r[1:] for r in want if r[0] == "s"] == [(0, None, "http://a.example.at", 3), (1, 0, "http://a.example.at/1", 3), (2, 1, "http://b.example.ch", 3), (3, 1, "http://c.example.ch", 2), (4, 3, None, 2), (5, 6, "http://xexample.at", 2)]
    assert [r[2] for r in want if r[0] == "u"] == [None, 0, 7] and [r[1:] for r in want if r[0] == "x"] == [r[1:] for r in want if r[0] == "s"] and not [r for r in want if r[0] in "vw"]
    index.write_index(pages, str(tmp_path), buckets=7)
    found = index.indexed_search(spark, str(tmp_path), requests_)
    assert hit_rows(found) == want
    plan = index.indexed_search(spark, str(tmp_path), requests_.where("num_results <= 100"))._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and re.search(r"PartitionFilters: \[[^]]*bucket#\d+ IN", plan)
    index.write_index(pages.limit(0), str(tmp_path / "none"))
    assert index.indexed_search(spark, str(tmp_path / "none"), requests_).collect() == []


def test_places_of_a_large_group(spark):
    """No task has more than a tenth of a list of a million rows, and small groups and nulls are placed beside it."""
    df = spark.range(1_000_000, numPartitions=8).select(F.lit("big").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("score"), "id")
    df = df.unionByName(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 5, 3), (None, 4, 4)], "g string, score long, id long"))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # else ranges of less than 64 MB are put together
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    scratch = Scratch(spark, "test")
    out = top.placed(df, "g", [F.desc("score"), F.asc("id")], "place", scratch)
    sizes = [r["count"] for r in scratch.paths[next(iter(scratch.paths))][1].groupBy(F.shiftright("__at", 33)).count().collect()]
    for k, v in before.items():
        spark.conf.set(k, v)
    assert max(sizes) < 100_000
    small = sorted(map(tuple, out.where("g is null or g = 'a'").select("g", "id", "place").collect()), key=str)
    assert small == [("a", 1, 1), ("a", 2, 0), (None, 3, 0), (None, 4, 1)]
    order = W.orderBy(F.desc("score"), F.asc("id"))
    assert out.where("g = 'big'").withColumn("want", F.row_number().over(order) - 1).where("want <> place").count() == 0
    assert out.where("g = 'big'").count() == 1_000_000
    assert top.placed(df.limit(0), "g", [F.asc("id")], "place", scratch).count() == 0


def run_rows(spark, runs, day, **more):
    df = spark.createDataFrame([(r, i, f"2024-01-{day:02}") for r in runs for i in range(3)], "run_id string, i int, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_runs_are_seen_once_committed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    results.write_runs(run_rows(spark, ["a/b", "c"], 2), path)
    ids = lambda: {r["index"]: r.run_id for r in results.registry(spark, path).collect()}
    assert ids() == {-2: "a/b", -1: "c"}

    def stop(*_):
        raise RuntimeError("the writer ends here")

    with monkeypatch.context() as m:  # rows are there, the manifest is not
        m.setattr(results, "_commit", stop)
        with pytest.raises(RuntimeError):
            results.write_runs(run_rows(spark, ["c", "d"], 5, i=99), path)
    assert ids() == {-2: "a/b", -1: "c"} and sorted(r.i for r in results.load_results(spark, path).collect()) == [0, 1, 2]
    with monkeypatch.context() as m:  # the rows themselves are not all there
        m.setattr(results, "_write_rows", stop)
        with pytest.raises(RuntimeError):
            results.write_runs(run_rows(spark, ["e"], 6), path)
    assert ids() == {-2: "a/b", -1: "c"}
    # Two writers, the second of which commits first; each run has the rows of its last commit.
    one, two = results.staged(run_rows(spark, ["c"], 3, i=7, late="x"), path), results.staged(run_rows(spark, ["c", "f"], 4, i=8), path)
    results.commit(spark, path, two)
    assert {r.i for r in results.load_results(spark, path, -2).collect()} == {8} and ids() == {-3: "a/b", -2: "c", -1: "f"}
    results.commit(spark, path, one)
    got = results.load_results(spark, path, -2).collect()
    assert {(r.run_id, r.i, r.late) for r in got} == {("c", 7, "x")} and len(got) == 3
    assert {(r.i, r.late) for r in results.load_results(spark, path, -3).collect()} == {(0, None), (1, None), (2, None)}  # a later column
    everything = results.all_results(spark, path)
    assert sorted((r.run_id, r.i, r.late) for r in everything.collect() if r.run_id != "c") == [("a/b", i, None) for i in range(3)] + [("f", 8, None)] * 3
    assert everything.where("run_id = 'c' and late = 'x'").count() == 3 and everything.count() == 9
    with pytest.raises(IndexError):
        results.load_results(spark, path, -4)


def test_csv_of_one_run(spark, tmp_path):
    """Empty texts and nulls stay apart, and a run's file has all columns in order."""
    rows = run_rows(spark, ["a"], 2).withColumns({"name": F.element_at(F.array(F.lit(""), F.lit(None).cast("string"), F.lit('say "x"\n, y')), F.col("i") + 1), "images": F.array(F.lit("u"))})
    results.write_runs(rows, str(tmp_path / "store"))
    results.write_run_csv(spark, str(tmp_path / "store"), str(tmp_path / "csv"), -1)
    back = results.read_csv(spark, str(tmp_path / "csv" / "a"), "i int, ts timestamp, name string, images string")
    assert {r.i: (r.name, r.images) for r in back.collect()} == {0: ("", '["u"]'), 1: (None, '["u"]'), 2: ('say "x"\n, y', '["u"]')}


def test_wide_and_csv(spark, tmp_path):
    assert results.label_columns(["u"], ["rel", "x.y"]) == {"rel": "rel", "x.y": "y"}
    assert results.label_columns(["u"], ["a", "x.a"]) == {"a": "classifications.a", "x.a": "classifications.x.a"}
    df = spark.createDataFrame([('q"uo\nte', ["a", "b"], {"rel": 1}), ("", [], {})], "url string, images array<string>, classifications map<string,int>")
    results.write_csv(results.wide(df, ["rel"]), str(tmp_path / "c"))
    back = results.read_csv(spark, str(tmp_path / "c"), "url string, images string, rel int")
    assert sorted(map(tuple, back.collect()), key=str) == sorted([('q"uo\nte', '["a","b"]', 1), ("", "[]", None)], key=str)
    results.written(df, lambda x: called_with.append(x.count()))
    assert called_with == [2]


called_with = []


def test_runs(spark):
    runs = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "run_id string, ts int")
    assert {r.run_id: r["index"] for r in results.listed_runs(runs).collect()} == {"a": -3, "c": -2, "b": -1}
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int")
    assert [r.x for r in results.load_run(rows, runs).collect()] == [2] and rows.limit(10).count() == 2


def test_stored_runs(spark, tmp_path):
    rows = spark.createDataFrame([("a_1", 1, 10), ("a_1", 2, 10), ("b_2", 3, 20)], "run_id string, x int, ts int")
    results.write_runs(rows, path := str(tmp_path / "store"))
    results.write_runs(spark.createDataFrame([("a_1", 7, 11), ("c_3", 8, 15)], rows.schema), path)
    assert {r.run_id: r["index"] for r in results.registry(spark, path).collect()} == {"a_1": -3, "c_3": -2, "b_2": -1}
    assert [[r.x for r in results.load_results(spark, path, i).collect()] for i in (-1, -2, -3)] == [[3], [8], [7]]
    with pytest.raises(IndexError):
        results.load_results(spark, path, -4)


@pytest.mark.parametrize("few", [10_000, 1])
def test_keywords_count_documents(spark, monkeypatch, few):
    monkeypatch.setattr(keywords, "FEW", few)
    docs = spark.createDataFrame([(1, "red seed box"), (1, "red seed box"), (2, "seed seed"), (None, "a seed"), (None, "a seed"), (3, None), (4, "")], "doc_id long, text string")
    seeds = spark.createDataFrame([("seed",), ("seed",), ("red  Seed",), ("",)], "seed string")
    own = {(r.seed, r.text): r.volume for r in keywords.suggest_terms(docs, seeds, 50).collect()}
    assert own[("seed", "seed")] == 4 and own[("seed", "red seed box")] == 1 and own[("seed", "a seed")] == 2 and own[("red  Seed", "red seed")] == 1
    other = {(r.seed, r.text): r.volume for r in keywords.related_terms(docs, seeds, 50).collect()}
    assert other == {("seed", "seed"): 4, ("red  Seed", "seed"): 1}
    assert keywords.suggest_terms(docs.limit(0), seeds, 5).count() == 0


def test_streams_that_drop_and_flag(spark, tmp_path):
    rows = spark.createDataFrame([("u", False, None), ("u", False, None), ("v", False, None), ("w", True, "x")], "url string, filtered boolean, filtered_at_stage string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streaming.run(streaming.drop_repeated(stream), streaming.batch_sink(str(tmp_path / "a")), str(tmp_path / "sa"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "a")).collect()) == ["u", "v", "w"]
    seen = spark.createDataFrame([("v",), ("v",), ("w",), (None,)], "url string")
    streaming.run(streaming.flag_known(stream, seen), sink := streaming.batch_sink(str(tmp_path / "b")), str(tmp_path / "sb"))
    got = spark.read.parquet(str(tmp_path / "b"))
    assert sorted((r.url, r.filtered_at_stage) for r in got.collect() if r.filtered) == [("v", PREVIOUS_RUN), ("w", "x")] and got.count() == 4
    sink(rows, 0)  # a batch that comes again
    assert spark.read.parquet(str(tmp_path / "b")).count() == 4


HIT = "url string, search_ord int, position int, filtered boolean, filtered_at_stage string, at timestamp"


def hit_stream(spark, folder):
    os.makedirs(folder, exist_ok=True)
    return spark.readStream.schema(HIT).option("maxFilesPerTrigger", 1).parquet(folder)


def add_hits(spark, folder, rows):
    """One file with hits (url, search_ord, position, flagged, second)."""
    df = spark.createDataFrame([(u, s, p, f, "x" if f else None, t) for u, s, p, f, t in rows], HIT.replace("at timestamp", "t long"))
    df.select("*", F.timestamp_seconds("t").alias("at")).drop("t").coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # files are taken by age


def stages(spark, path):
    return sorted(((r.url, r.search_ord, r.position, r.filtered_at_stage) for r in spark.read.parquet(path).collect()), key=str)


def test_first_by_rank_in_a_stream(spark, tmp_path):
    """Whatever the order and batches in which hits arrive, the rows are those of the batch operator."""
    t0 = 1_700_000_000
    files = [
        [("u", 2, 0, False, t0), ("v", 1, 5, False, t0), (None, 0, 0, False, t0), ("w", 0, 0, True, t0)],
        [("u", 0, 7, False, t0 + 5), ("v", 1, 6, False, t0 + 1), (None, 0, 1, False, t0 + 1), ("w", 3, 1, False, t0 + 2)],
        [("u", 0, 3, False, t0 + 3), ("u", 1, 0, True, t0 + 3), ("w", 2, 9, False, t0 + 3)],
    ]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in files:
        add_hits(spark, folder, rows)
    stream = streaming.flag_by_rank(hit_stream(spark, folder).withWatermark("at", "1 minute"), "at", wait_ms=60_000)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    streaming.run(stream, streaming.batch_sink(out), state)
    assert ("u", 0, 3, None) not in stages(spark, out)  # not known to be the first before its time is over
    add_hits(spark, folder, [(None, 9, 9, False, t0 + 3600)])
    streaming.run(stream, streaming.batch_sink(out), state)
    whole = spark.createDataFrame([(u, s, p, f, "x" if f else None, "r") for rows in files for u, s, p, f, _ in rows] + [(None, 9, 9, False, None, "r")], HIT.replace("at timestamp", "run_id string"))
    want = sorted(((r.url, r.search_ord, r.position, r.filtered_at_stage) for r in dedupe.flag_current_run(whole).collect()), key=str)
    assert stages(spark, out) == want and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    add_hits(spark, folder, [("u", 0, 0, False, t0 + 3601), ("new", 0, 0, False, t0 + 10), (None, 9, 9, False, t0 + 7200)])  # closed; too late; and what moves the watermark
    streaming.run(stream, streaming.batch_sink(out), state)
    assert [x for x in stages(spark, out) if x not in want] == [("u", 0, 0, CURRENT_RUN)]


def test_closed_urls_are_forgotten_in_event_time(spark, tmp_path):
    t0, (folder, out, state) = 1_700_000_000, (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = streaming.flag_by_rank(hit_stream(spark, folder).withWatermark("at", "1 second"), "at", wait_ms=10_000, keep_ms=60_000)
    for second, rows in ((0, ["u"]), (30, []), (40, ["u"]), (200, []), (201, ["u"]), (400, [])):
        add_hits(spark, folder, [(u, second, 0, False, t0 + second) for u in rows] + [(None, second, 1, False, t0 + second)])
        streaming.run(stream, streaming.batch_sink(out), state)
    assert [x[1:] for x in stages(spark, out) if x[0] == "u"] == [(0, 0, None), (201, 0, None), (40, 0, CURRENT_RUN)]


def test_repeats_within_a_bound_of_event_time(spark, tmp_path):
    t0, (folder, out, state) = 1_700_000_000, (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = streaming.drop_repeated_within(hit_stream(spark, folder), "at", "1 minute")
    for rows in ([("u", 0, 0), ("v", 0, 0)], [("u", 1, 30), ("v", 1, 20)], [("x", 0, 300)], [("x", 1, 301)], [("u", 2, 310), ("u", 3, 311), ("late", 0, 5)]):
        add_hits(spark, folder, [(u, s, 0, False, t0 + t) for u, s, t in rows])
    streaming.run(stream, streaming.batch_sink(out), state)
    assert [x[:2] for x in stages(spark, out)] == [("u", 0), ("u", 2), ("v", 0), ("x", 0)]


def test_time_to_live_of_seen_urls(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = streaming.flag_repeated(hit_stream(spark, folder), ttl_ms=20_000)
    for wait, rows in ((0, [("u", 0), (None, 0)]), (0, [("u", 1), (None, 1)]), (21, [("u", 2), (None, 2)])):
        time.sleep(wait)
        add_hits(spark, folder, [(u, s, 0, False, 0) for u, s in rows])
        streaming.run(stream, streaming.batch_sink(out), state, idle=False)
    assert [(x[0], x[1], x[3]) for x in stages(spark, out)] == [("u", 0, None), ("u", 1, CURRENT_RUN), ("u", 2, None), (None, 0, None), (None, 1, None), (None, 2, None)]


def test_details_are_made_once_for_each_url(spark, tmp_path):
    """However many micro-batches there are, no page is looked at twice, and none that was not hit."""
    folder, base = str(tmp_path / "in"), str(tmp_path / "o")
    made = spark.sparkContext.accumulator(0)

    def details(urls):
        def one(batches):
            for pdf in batches:
                made.add(len(pdf))
                pdf = pdf[pdf["url"] != "gone"]
                yield pdf.assign(product_name="n " + pdf["url"], product_price=None, product_description="d", product_images=[[]] * len(pdf), probability=0.05 if (pdf["url"] == "low").any() else 0.9)

        return urls.mapInPandas(one, stream_stages.DETAILS)

    for rows in (["a", "b", "gone"], ["a", "c", "b"], ["low"], ["a", "gone", None, "low"]):
        add_hits(spark, folder, [(u, 0, i, False, 0) for i, u in enumerate(rows)])
    sink = stream_stages.detailing_sink(base, f"{base}/details", details, [Prompt("p", "c", "s", (1,))], lambda b: pd.Series(["1"] * len(b)))
    stream = hit_stream(spark, folder)
    streaming.run(stream, sink, f"{base}/state")
    got = spark.read.parquet(f"{base}/out").collect()
    assert made.value == 5 and len(got) == 11 and spark.read.parquet(f"{base}/details").where("batch >= 0").count() == 5
    assert {(r.url, r.product_name, r.filtered_at_stage, r.classifications.get("p")) for r in got} == {("a", "n a", None, 1), ("b", "n b", None, 1), ("c", "n c", None, 1), ("low", "n low", PROBABILITY, None), ("gone", None, None, -1), (None, None, None, -1)}
    sink(spark.read.schema(HIT).parquet(folder).where("url = 'c'"), 1)  # a batch that comes again
    assert spark.read.parquet(f"{base}/out").where("batch = 1").count() == 1


def test_requests_are_answered_in_their_language(spark):
    docs = spark.createDataFrame([(1, "red seed", "en"), (2, "red seed box", "en"), (3, "roter seed", "de"), (4, "seed blau", "de"), (5, "seed red", None)], "doc_id long, text string, lang string")
    seeds, runs = spark.createDataFrame([("seed",)], "seed string"), spark.createDataFrame([("en", "Bern"), ("de", "Bern"), ("fr", "Bern")], "language string, location string")
    got = lambda limit, n: [(r.lang, r["rank"], r.text, r.volume) for r in keywords.requested_terms(docs, requests.keyword_requests(seeds, runs, limit), n).orderBy("lang", "rank").collect()]
    assert got(10, 2) == [("de", 1, "roter seed", 1), ("de", 2, "seed blau", 1), ("en", 1, "red seed", 2), ("en", 2, "red seed box", 1)]
    assert got(1, 5) == [("en", 1, "red seed", 2)]  # all other lists of one term have the seed itself, which goes


def test_terms_of_both_sources_from_one_pass(spark):
    """The same rows as from each source alone; a doc_id that comes twice counts once, documents without one count each."""
    rows = [(1, "red bike bell"), (1, "red bike"), (2, "a red bike"), (None, "red bike"), (None, "red bike"), (3, "bike red"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seeds = spark.createDataFrame([("red",), ("red bike",), ("absent",), ("red",)], "seed string")
    both = keywords.both_terms(docs, seeds.distinct(), 100)
    for source, alone in (("suggested", keywords.suggest_terms(docs, seeds, 100)), ("related", keywords.related_terms(docs, seeds, 100))):
        got = both.where(F.col("source") == source).drop("source").select(alone.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alone.collect()))
    volume = {(r.seed, r.text): r.volume for r in both.where("source = 'suggested'").collect()}
    assert volume["red", "red bike"] == 4 and volume["red", "red"] == 5 and volume["red bike", "red bike bell"] == 1 and volume["red", "bike red"] == 1
    assert {(r.seed, r.text): r.volume for r in both.where("source = 'related'").collect()} == {("red", "bike"): 5, ("red", "bell"): 1, ("red bike", "bike"): 4, ("red bike", "bell"): 1}
    plan = keywords.ranked(both, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(concat(") <= 1


def test_funnel_counted_while_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, PROBABILITY), (3, PROBABILITY), (4, "own stage")], "i int, filtered_at_stage string")
    stored, counts = results.written_with_counts(df, str(tmp_path / "r"))
    assert {k: v for k, v in counts.items() if v} == {"kept": 1, PROBABILITY: 2, "other": 1} and stored.count() == 4


def test_sink_that_learns_urls(spark, tmp_path):
    batch = lambda *urls: spark.createDataFrame([(u, False, None) for u in urls], "url string, filtered boolean, filtered_at_stage string")
    out, known = str(tmp_path / "out"), str(tmp_path / "known")
    spark.createDataFrame([("old",)], "url string").write.parquet(f"{known}/batch=-1")
    sink = streaming.refreshing_sink(out, known)
    for i, urls in ((0, ("old", "a", "a")), (1, ("a", "b", None)), (0, ("old", "a", "a")), (1, ("a", "b", None))):  # both come again
        sink(batch(*urls), i)
    got = sorted((r.batch, r.url or "", r.filtered_at_stage) for r in spark.read.parquet(out).collect())
    assert got == [(0, "a", None), (0, "a", None), (0, "old", PREVIOUS_RUN), (1, "", None), (1, "a", PREVIOUS_RUN), (1, "b", None)]
    assert sorted((r.batch, r.url) for r in spark.read.parquet(known).collect()) == [(-1, "old"), (0, "a"), (1, "b")]


def test_runs_are_numbered_in_many_tasks(spark):
    from datetime import datetime, timedelta

    rows = [(f"r{i * 7919 % 3000:04d}", datetime(2024, 1, 1) + timedelta(hours=i % 700) if i % 50 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp")
    want = {r[0]: i - 3000 for i, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime(2024, 1, 1), r[0])))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = results.listed_runs(df).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.run_id: r["index"] for r in out} == want and len({r.task for r in out}) > 1
    assert results.listed_runs(df.limit(0)).count() == 0 and results.listed_runs(df.where("ts is null")).agg(F.min("index"), F.max("index")).first() == (-60, -1)


def test_first_rows_in_two_steps(spark):
    terms = spark.createDataFrame([("s", f"t{i:04d}", i * 37 % 101) for i in range(1000)] + [("o", "x", 1)], "seed string, text string, volume long")
    out = keywords._limited(terms, 50)
    got = [(r.text, r.ord) for r in out.where("seed = 's'").orderBy("ord").collect()]
    best = sorted(((f"t{i:04d}", i * 37 % 101) for i in range(1000)), key=lambda x: (-x[1], x[0]))[:50]
    assert got == [(t, i) for i, (t, _) in enumerate(best)] and out.where("seed = 'o'").count() == 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("row_number()") >= 2
