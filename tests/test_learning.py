"""Extraction, embeddings, ranks and streams."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import extract, kge, splits, vectors
from graphloom.sources.tables import dense_ids
from graphloom.streaming import ingest
from graphloom.terms import TRIPLE_SCHEMA


def test_main_text():
    html = "<html><head><title>t</title><script>x</script></head><body><nav>menu</nav><article><h1>Head</h1><p>One  two.</p></article><footer>f</footer></body></html>"
    assert extract.main_text(html) == "Head\nOne two."
    assert extract.main_text("<p>a</p><p>b</p>") == "a\nb" and extract.main_text("") is None and extract.main_text(None) is None and extract.main_text("<script>x</script>") is None


def test_relations_and_mentions(spark):
    tokens = [
        (1, 0, "Neil Armstrong commanded Apollo 11 from Houston", i, text, lemma, pos, dep, head, label, iob)
        for i, (text, lemma, pos, dep, head, label, iob) in enumerate(
            [("Neil", "neil", "PROPN", "compound", 1, "PERSON", "B"), ("Armstrong", "armstrong", "PROPN", "nsubj", 2, "PERSON", "I"), ("commanded", "command", "VERB", "ROOT", 2, "", "O"), ("Apollo", "apollo", "PROPN", "dobj", 2, "EVENT", "B"), ("11", "11", "NUM", "nummod", 3, "EVENT", "I"), ("from", "from", "ADP", "prep", 2, "", "O"), ("Houston", "houston", "PROPN", "pobj", 5, "GPE", "B")]
        )
    ]
    df = spark.createDataFrame(tokens + [(2, *t[1:]) for t in tokens], extract.TOKENS)
    got = sorted(tuple(r) for r in extract.relations(df).where("page_id = 1").select("subject", "predicate", "object", "object_label").collect())
    assert got == [("Neil Armstrong", "command", "Apollo 11", "EVENT"), ("Neil Armstrong", "command_from", "Houston", "GPE")]
    assert sorted(r["text"] for r in extract.entities(df).where("page_id = 2").collect()) == ["Apollo 11", "Houston", "Neil Armstrong"]


def test_facts_keep_the_first_and_relations_first(spark):
    pages = spark.createDataFrame([(1, "http://w/A", "A", "In 1969 Neil Armstrong commanded Apollo 11. Neil Armstrong visited Houston."), (2, "http://w/B", None, "Later Neil Armstrong commanded Apollo 11."), (3, "http://w/C", "C", None)], "page_id long, url string, title string, text string")
    rows = extract.facts(pages).collect()
    rel = [r for r in rows if r["extraction_type"] == "relation"]
    assert any((r["subject"], r["predicate"], r["object"], r["source_url"]) == ("Neil Armstrong", "command", "Apollo 11", "http://w/A") for r in rel)
    keys = [(r["subject"], r["predicate"], r["object"]) for r in rows]
    assert len(keys) == len(set(keys)) and ("1969", "mentionedIn", "A") in keys


def test_texts_are_annotated_once(spark, tmp_path):
    log = tmp_path / "calls"

    def annotator(text):
        with open(log, "a") as out:
            out.write("x")
        return extract.default_annotator(text)

    pages = spark.createDataFrame([(i, "u", "A", "Later Neil Armstrong commanded Apollo 11. He left.") for i in range(5)], "page_id long, url string, title string, text string")
    assert extract.facts(pages, annotator).count() > 0 and log.read_text() == "x" * 5
    first = extract.tokenize(pages, annotator).where("page_id = 0").collect()
    assert [r["sentence"] is not None for r in first] == [r["i"] == 0 for r in first]


def test_legacy_spans_leave_the_first_word_out(spark):
    tokens = extract.tokenize(spark.createDataFrame([(1, "In 1969 Neil Armstrong visited Cape Canaveral.")], "page_id long, text string"))
    whole = {r["subject"] for r in extract.relations(tokens).collect()}
    legacy = {r["subject"] for r in extract.relations(tokens, legacy_span=True).collect()}
    assert whole == {"Neil Armstrong"} and legacy == {"Armstrong"}


def test_crawl_filters_pages(spark):
    fetched = spark.createDataFrame([(1, "http://w/Apollo_11", "<p>" + "word " * 600 + "</p>"), (2, "u", "<p>few</p>"), (3, "v", None)], "page_id long, url string, html string")
    rows = extract.crawl(fetched).collect()
    assert [(r["title"], r["word_count"]) for r in rows] == [("Apollo 11", 600)]


def test_nearest_leaves_self_out_and_breaks_ties(spark):
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate([0, 0, 0.1, 0.1, 3])], "id long, vector array<double>")
    got = vectors.nearest(df, df.where("id = 0"), 3).orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [1, 2, 3]
    before, vectors.SPOTLIGHT_BLOCK = vectors.SPOTLIGHT_BLOCK, 2
    try:
        assert vectors.nearest(df, df, 2).count() == 10
    finally:
        vectors.SPOTLIGHT_BLOCK = before


def test_scores_equal_numpy(spark):
    rng = np.random.default_rng(0)
    h, r, t = rng.normal(size=(3, 8))
    df = spark.createDataFrame([([float(x) for x in h], [float(x) for x in r], [float(x) for x in t])], "h array<double>, r array<double>, t array<double>")
    got = df.select(vectors.transe_score("h", "r", "t"), vectors.distmult_score("h", "r", "t"), vectors.complex_score("h", "r", "t")).first()
    c = lambda x: x[:4] + 1j * x[4:]
    assert np.allclose(got, [-np.abs(h + r - t).sum(), (h * r * t).sum(), (c(h) * c(r) * np.conj(c(t))).sum().real])
    for i, kind in enumerate(kge.MODELS):
        order = (0, 1, 2)[i]
        assert np.isclose(kge.score(kind, h, r, t), got[order])
        base, eps = [h, r, t], 1e-6
        for k, g in enumerate(kge.gradients(kind, h, r, t)):
            moved = [x.copy() for x in base]
            moved[k][3] += eps
            assert np.isclose((kge.score(kind, *moved) - kge.score(kind, *base)) / eps, g[3], atol=1e-4)


def test_realistic_ranks(spark):
    df = spark.createDataFrame([("q", 1.0, True), ("q", 1.0, False), ("q", 2.0, False), ("q", 0.5, False)], "q string, score double, is_true boolean")
    assert vectors.ranks(df, ["q"]).first()["rank"] == 2.5


@pytest.mark.parametrize("kind", kge.MODELS)
def test_training_learns_and_repeats(spark, kind):
    rows = [(f"e{i}", "uri", f"r{k}", f"e{(i + k + 1) % 12}", "uri", "", "") for i in range(12) for k in range(3)]
    data = splits.enforce_coverage(splits.assign(splits.uri_triples(spark.createDataFrame(rows, TRIPLE_SCHEMA)))).cache()
    train, test = data.where("split = 'train'"), data.where("split <> 'train'")
    options = {"dim": 16, "lr": 0.1, "batch": 16, "epochs": 12, "workers": 1}
    model, losses = kge.train(spark, train, kind, **options)
    again, _ = kge.train(spark, train, kind, **options)
    assert losses[-1] < losses[0] and np.array_equal(model.entities, again.entities) and len(losses) == 12
    parted, lost = kge.train(spark, train, kind, **options | {"workers": 3, "local_epochs": 5})
    assert len(lost) == 12 and lost[-1] < lost[0] and parted.entities.shape == model.entities.shape
    m = kge.evaluate(model, test if test.count() else train, data)
    assert 0 < m["mrr_both"] <= 1 and m["hits_at_1"] <= m["hits_at_10"]
    with pytest.raises(ValueError):
        kge.train(spark, train, kind, max_parameters=1)
    assert kge.embeddings(model, spark).count() == len(model.entity_ids)


def test_projection_keeps_clusters_apart():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (15, 10)), rng.normal(5, 0.1, (15, 10))])
    for method in ("pca", "tsne"):
        y = kge.project(x, method, rounds=300)
        a, b = y[:15].mean(0), y[15:].mean(0)
        assert np.linalg.norm(a - b) > 2 * max(np.linalg.norm(y[:15] - a, axis=1).mean(), np.linalg.norm(y[15:] - b, axis=1).mean())


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"n{i:04d}",) for i in range(500)], "name string").repartition(7)
    assert [r["id"] for r in dense_ids(df).orderBy("name").collect()] == list(range(500))


def test_dense_ids_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ids = dense_ids(spark.range(1_000_000).selectExpr("md5(cast(id as string)) as name"))
        r = ids.selectExpr("count(*) as n", "count(distinct id) as d", "min(id) as a", "max(id) as z").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(r) == (1_000_000, 1_000_000, 0, 999_999)


def test_streams(spark, tmp_path):
    events = tmp_path / "in"
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i, t + datetime.timedelta(minutes=i), "a" if i % 2 else "b") for i in range(180)], "event_id long, ts timestamp, event_type string").write.parquet(str(events))
    stream = ingest.event_counts(spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(str(events)))
    q = ingest.into_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count(F.lit(1))).first()[0] >= 0
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.json").write_text('{"url": "u", "text": "' + "word " * 600 + '", "crawled_at": "2024-01-01T00:00:00"}\n' * 1 + '{"url": "u", "text": "' + "word " * 600 + '", "crawled_at": "2024-01-01T00:00:01"}\n')
    q = ingest.into_table(ingest.page_stream(spark, str(pages)), str(tmp_path / "o2"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 1


def test_models_are_saved_and_mapped(spark, tmp_path):
    rows = [(f"http://x/Mars_{i}", "uri", "r", f"http://x/Apollo_{i}", "uri", "", "") for i in range(6)]
    model, _ = kge.train(spark, splits.uri_triples(spark.createDataFrame(rows, TRIPLE_SCHEMA)), "ComplEx", dim=4, epochs=2)
    kge.save_model(model, spark, str(tmp_path / "m"))
    back = kge.load_model(spark, str(tmp_path / "m"))
    assert back.kind == "ComplEx" and np.allclose(back.entities, model.entities) and back.relation_ids == model.relation_ids
    got = kge.coordinates(kge.embeddings(model, spark), "pca").collect()
    assert {(r["class"], r["colour"]) for r in got} == {("CelestialBody", "#27AE60"), ("SpaceMission", "#E67E22")} and len(got) == 12
    assert "TransE" in kge.format_comparison([{"model": "TransE", "mrr_both": 0.5}]) and "n/a" in kge.format_comparison([{"model": "TransE"}])


def test_facts_are_counted_before_the_choice(spark):
    from pyspark.sql import Observation

    pages = spark.createDataFrame([(i, "u", "A", "Later Neil Armstrong commanded Apollo 11.") for i in range(3)], "page_id long, url string, title string, text string")
    seen = Observation()
    assert extract.facts(pages, counters=seen).count() < seen.get["relations"] + seen.get["mentions"]


def test_fetching_tries_again_and_reports(spark):
    from graphloom.sources import remote

    tried, waits = [], []

    def opener(address, headers, seconds):
        tried.append(address)
        if address == "busy":
            return (200, "ok") if len(tried) == 3 else (429, "")
        if address == "gone":
            return 404, ""
        raise TimeoutError("slow")

    assert remote.fetched("busy", opener, wait=waits.append) == ("ok", None) and waits == [2.0, 4.0]
    assert remote.fetched("gone", opener, wait=waits.append) == (None, "status 404") and tried.count("gone") == 1
    assert remote.fetched("x", opener, wait=waits.append) == (None, "TimeoutError: slow") and tried.count("x") == 3
    df = spark.createDataFrame([("a", 1), (None, 2)], "url string, k int")
    got = {r["k"]: (r["body"], r["error"]) for r in remote.fetch(df, opener=lambda u, h, s: (200, u.upper())).collect()}
    assert got == {1: ("A", None), 2: (None, "no address")}
    urls = remote.search_addresses(spark.createDataFrame([("Apollo 11",)], "label string"), "http://s").first()["url"]
    assert urls.endswith("limit=5&search=Apollo+11")
    assert "wd%3AQ1+%3Fprop" in remote.neighbour_addresses(spark.createDataFrame([("Q1",)], "qid string"), "http://s").first()["url"]


def test_found_facts_are_counted_without_a_shuffle(spark):
    from pyspark.sql import Observation

    said = "Later Neil Armstrong commanded Apollo 11. Later Neil Armstrong commanded Apollo 11."
    pages = spark.createDataFrame([(i, "u", "A", said) for i in (1, 2, 2)], "page_id long, url string, title string, text string")
    once, twice = Observation(), Observation()
    counted = extract.count_found(extract.annotate(pages.where("page_id = 1")), once)
    counted.collect()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert once.get == {"relations": 1, "mentions": 2}
    extract.count_found(extract.annotate(pages), twice).collect()
    assert twice.get == {"relations": 2, "mentions": 4}  # a page that is there twice counts once


def test_nearest_equals_all_pairs_of_odd_vectors(spark):
    from pyspark.sql import Window

    from graphloom.functions.text import cosine

    rng = np.random.default_rng(3)
    rows = [[float(x) for x in rng.normal(size=6).astype("float32")] for _ in range(300)]
    rows += [rows[7]] * 40 + [[2 * x for x in rows[8]]] * 9 + [None, [0.0] * 6, [0.0] * 6, [1.0] * 5, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1e-170] * 6, [1e200] * 6]
    df = spark.createDataFrame([(i * 7 % len(rows), x) for i, x in enumerate(rows)], "id long, vector array<double>").repartition(3)
    n = len(rows)
    pairs = df.toDF("query", "q").crossJoin(df.toDF("neighbour", "v")).where("query <> neighbour").withColumn("similarity", cosine("q", "v"))
    for k in (4, n):
        kept = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
        wanted = pairs.withColumn("rank", F.row_number().over(kept)).where(F.col("rank") <= k).select("query", "neighbour", "rank", "similarity")
        key = lambda frame: sorted(tuple(map(str, r)) for r in frame.collect())
        assert key(vectors.nearest(df, df, k)) == key(wanted)
    names = df.withColumn("id", F.col("id").cast("string"))
    assert vectors.nearest(names, names.where("id < '2'"), 3).count() == 3 * names.where("id < '2'").count()


def test_only_sentences_with_names_are_annotated(spark):
    said = ["It ended. Nasa won.", "A_ one. A one. \u00b2 two.", "Moon \u00b2 rose.", "Mars landed. mars landed.", "in 1999 it ended. So Neil Armstrong left. \U0001d400bc said.", "So \U0001d400bc said. \u00c9t\u00e9 was.", "NASA was. no. Was no. Apollo 11 landed in Houston.", ""]
    named = lambda tokens: [t for t in tokens if any(x[9] != "O" or x[8] for x in tokens if x[0] == t[0])]
    for text in said:
        assert named(extract.default_annotator(text, whole=False)) == named(extract.default_annotator(text))
    assert extract.default_annotator("It was so. It ended.", whole=False) == []


def test_annotated_pages_are_given_on_in_parts(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["So Neil Armstrong left. " * 1000] * 40)], names=["page_id", "__text"])
    parts = list(extract._annotated(extract.default_annotator, lambda tokens: True)(iter([batch])))
    assert len(parts) >= 4 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(40))
    assert {len(x) for p in parts for x in p.column(1).to_pylist()} == {1000}


def test_packed_choice_equals_the_plain_one(spark):
    rows = spark.range(4_000, numPartitions=3).selectExpr("nullif(concat('s', id % 70), 's3') as s", "concat('p', id % 11) as p", "cast(id % 2 as int) as kind", "nullif(id * 37 % 101, 5) as page", "concat('x', id % 5) as said")
    before, extract.PACKED_ROWS = extract.PACKED_ROWS, 300
    try:
        got = extract.first_of_packed(rows, ["s", "p"], ["kind", "page"])
        key = lambda df: sorted(tuple(map(str, r)) for r in df.select("s", "p", "kind", "page", "said").collect())
        assert key(got) == key(extract.first_of(rows, ["s", "p"], ["kind", "page"]))
        assert extract.first_of_packed(rows.where("false"), ["s", "p"], ["kind", "page"]).count() == 0
    finally:
        extract.PACKED_ROWS = before
