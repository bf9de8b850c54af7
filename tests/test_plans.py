"""The catalogue plan, the ledger, exports and streams."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from gondola import schemas
from gondola.operators import ledger, pages, ranking, shelves, summaries
from gondola.plans import catalog, runs
from gondola.sources import readers, sinks
from gondola.streaming import tail
from tests.test_functions import ITEM, PAGE

PAGES = [(1, "http://loja.com/a", PAGE), (2, "http://loja.com/b", PAGE), (3, "http://loja.com/c", "<p>nada"), (4, "http://loja.com/d", None)]


@pytest.fixture(scope="module")
def landed(spark):
    captures = [("http://loja.com/c", 0, "http://loja.com/api/products", "application/json", json.dumps([ITEM, {**ITEM, "id": 8, "nome": "Feijão"}])), ("http://loja.com/c", 1, "http://hotjar.com/api", "application/json", json.dumps([ITEM])), ("http://loja.com/c", 2, "http://loja.com/api", "application/json", "not json")]
    return spark.createDataFrame(PAGES, schemas.PAGE), spark.createDataFrame(captures, "page_url string, seq int, url string, content_type string, body string")


def test_catalogue(spark, landed):
    sections = spark.createDataFrame([("s1", "Ofertas", "http://loja.com/s1", u, k) for k, (_, u, _) in enumerate(PAGES)], "sectionId string, sectionLabel string, sectionUrl string, pageUrl string, place int")
    found = catalog.catalogue(*landed, sections)
    assert found.columns == [f.split(" ")[0] for f in schemas.PRODUCT.split(", ")]
    rows = {r["name"]: r for r in found.collect()}
    assert set(rows) == {"Arroz 5kg", "Feijão preto", "Arroz Tipo 1", "Feijão"}
    a = rows["Arroz 5kg"]
    assert (a["price"], a["originalPrice"], a["discountPercent"], a["isPromotion"], a["isClubOffer"], a["campaignLabel"], a["pageUrl"]) == ("R$ 5,99", "R$ 7,99", 25, True, True, "Clube", "http://loja.com/a")
    assert rows["Arroz Tipo 1"]["link"] == "http://loja.com/produto/arroz-1" and rows["Arroz Tipo 1"]["originalPriceValue"] == 9.99


def test_links_and_sections(spark, landed):
    links = pages.links(landed[0]).cache()
    assert [r["href"] for r in pages.discovered_links(links.where("page_id = 1")).orderBy("rank").collect()][0] == "http://loja.com/categorias/y"
    assert [r["href"] for r in pages.sections(links.where("page_id = 1"), 3).collect()] == ["http://loja.com/categorias/y"]
    assert pages.max_page_number(links).collect()[0]["pages"] == 1
    assert json.loads(pages.extracted(landed[0], {"fields": {"t": {"type": "pageTitle"}}}).orderBy("page_id").first()["data"]) == {"t": "Loja"}
    assert {r["selector"] for r in pages.group_stats(landed[0]).where("page_id = 1").collect()} >= {"li.card.big"}


def product(**own):
    base = {"id": None, "link": None, "name": "Arroz", "price": "R$ 5,00", "priceValue": 5.0, "image": None, "originalPrice": None, "discountPercent": None, "promotionLabel": None, "limitText": None, "unit": None, "campaignLabel": None, "badges": [], "isClubOffer": False, "isSiteExclusive": False, "sectionLabel": "s", "seq": 0}
    return {**base, **own}


PRODUCTS = "id string, link string, name string, price string, priceValue double, image string, originalPrice string, discountPercent int, promotionLabel string, limitText string, unit string, campaignLabel string, badges array<string>, isClubOffer boolean, isSiteExclusive boolean, sectionLabel string, seq int"


def test_dedupe_keeps_the_richest_then_the_earliest(spark):
    rows = [product(id="1", link="L", seq=0), product(id="1", link="L", image="i", seq=1), product(id="2", seq=2, unit="a"), product(id="2", seq=3, unit="b"), product(name="ácido", seq=4), product(name="Água", seq=5), product(name="banana", seq=6), product(name="abacaxi", seq=7)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {t}" for k in rows[0] for t in [dict(x.split(" ") for x in PRODUCTS.split(", "))[k]]))
    got = [(r["id"], r["name"], r["seq"]) for r in ranking.distinct_products(df).collect()]
    assert [x[1] for x in got if x[0] is None] == ["abacaxi", "ácido", "Água", "banana"] and {x for x in got if x[0]} == {("1", "Arroz", 1), ("2", "Arroz", 2)}
    once = ranking.distinct_products(df)
    assert sorted(map(str, ranking.distinct_products(once).collect())) == sorted(map(str, once.collect())) == sorted(map(str, ranking.distinct_products(df.repartition(7)).collect()))
    first = {r["id"]: r["seq"] for r in ranking.distinct_extracted(df, ["sectionLabel"]).where("id is not null").collect()}
    assert first == {"1": 0, "2": 2}


def test_shelf_dedupe(spark):
    rows = [("1", "d", "D", "a", 2, 5.0, 0), ("1", "d", "D", "a", 1, 9.0, 1), (None, "d", "D", "B c", 1, 2.0, 2), (None, "d", "D", "b C", 1, 1.0, 3)]
    df = spark.createDataFrame(rows, "product_id string, department_id string, department_label string, name string, page int, price_value double, seq int")
    from gondola.functions import text

    assert [r["seq"] for r in ranking.distinct_shelf(df, text.slug(F.col("name"))).collect()] == [1, 3]


def test_chunks_and_pages(spark):
    rows = spark.range(23).withColumn("job", F.lit("j"))
    chunks = ranking.in_chunks(rows, ["job"], [F.col("id")], 10).orderBy("id").collect()
    assert [sum(r["batchIndex"] == k for r in chunks) for k in (1, 2, 3)] == [10, 10, 3] and chunks[22]["itemIndexInBatch"] == 3 and chunks[22]["totalBatches"] == 3 and chunks[22]["batchSize"] == 3
    five = spark.range(5).withColumn("job", F.lit("j"))
    page = ledger.log_page(five, ["job"], [F.col("id")], 2, 2).orderBy("line").collect()
    assert [r["line"] for r in page] == [3, 4] and page[0]["total"] == 5 and page[0]["nextAfter"] == 4
    assert ledger.log_page(five, ["job"], [F.col("id")], 0, 0).count() == 1
    whole = [r["id"] for after in (0, 2, 4) for r in ledger.log_page(five, ["job"], [F.col("id")], after, 2).orderBy("line").collect()]
    assert whole == list(range(5))


def test_hot_groups_are_numbered_alike(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "a").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 3001).alias("k"), F.xxhash64("id").alias("x"))
    order = [F.col("k").desc(), F.col("x")]
    small, large = (ranking.numbered(rows.repartition(5), ["g"], order, hot) for hot in (10_000, 50))
    assert small.columns == large.columns and "Exchange rangepartitioning" not in small._jdf.queryExecution().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_sources_batches_and_ids(spark):
    inputs = [("Loja A", "www.loja.com", " Gaspar ", None, "12abc", None, None, "-1", None, "no", None, None, None), (None, "https://b.com/x", None, "shelf", None, None, None, None, None, None, None, None, None), ("sem url", None, *[None] * 11)]
    df = spark.createDataFrame(inputs, schemas.SOURCE_INPUT)
    a, b = ledger.normalised_sources(df).orderBy("label").collect()
    assert (a["url"], a["city"], a["scheduleMinutes"], a["maxItemsPerPage"], a["enabled"], a["adapterHint"]) == ("https://www.loja.com", "Gaspar", 12, 250, False, "auto")
    assert (b["label"], b["adapterHint"], b["workerCount"]) == ("b.com", "shelf", 3)
    again = ledger.normalised_sources(spark.createDataFrame([("Loja A", "www.loja.com", *[None] * 11)], schemas.SOURCE_INPUT), ledger.normalised_sources(df)).first()
    assert (again["scheduleMinutes"], again["city"], again["enabled"]) == (12, None, False)  # only a city that is given stays
    batches = spark.createDataFrame([("b1", None, "Gaspar", None, [("x", "a.com", None, None), (None, "b.com", "Ilhota", "shelf")], None, None), ("b2", None, None, None, None, "c.com\r\n\n# no\nd.com", None), ("b3", None, None, None, None, None, "e.com"), ("b4", *[None] * 6)], schemas.BATCH_INPUT)
    got = [(r["batchLabel"], r["index"], r["url"], r["city"], r["adapterHint"]) for r in ledger.normalised_batches(batches).orderBy("batchLabel", "index").collect()]
    assert got == [("b1", 1, "https://a.com", "Gaspar", "auto"), ("b1", 2, "https://b.com", "Ilhota", "shelf"), ("b2", 1, "https://c.com", None, "auto"), ("b2", 2, "https://d.com", None, "auto"), ("b3", 1, "https://e.com", None, "auto")]
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, name string")
    assert [r["id"] for r in ledger.unique_ids(names, F.col("name"), [F.col("k")], spark.createDataFrame([("a",), ("a-2",)], "id string")).orderBy("k").collect()] == ["a-3", "a-4", "b"]
    at = F.lit("2024-05-06 07:08:09.123").cast("timestamp")
    assert spark.range(1).select(ledger.job_id(at, F.lit("Loja A")), ledger.batch_id(at, F.lit("x"))).first()[:] == ("2024-05-06T07-08-09-123Z-loja-a", "2024-05-06T07-08-09-123Z-batch-x")


def test_next_run(spark):
    rows = [(True, 120, "2024-01-01 05:00:00", "2024-01-01 00:00:00"), (True, 120, None, None), (False, 120, None, None), (True, 60, "2024-01-01 05:00:00", None)]
    t = "timestamp"
    df = spark.createDataFrame(rows, "e boolean, m int, r string, s string")
    got = df.select(ledger.next_run(F.col("e"), F.col("m"), F.col("r").cast(t), F.col("s").cast(t), F.lit("2024-01-01 05:30:00").cast(t)).cast("string")).collect()
    assert [r[0] for r in got] == ["2024-01-01 02:00:00", "2024-01-01 05:30:00", None, "2024-01-01 06:00:00"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all', ["a", "", None, "b"], ("x", 1)), (2, None, None, None)], "id int, t string, l array<string>, s struct<p:string,q:int>")
    sinks.write_csv(df.coalesce(1), f"{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == '"id","t","l","s"' and lines[2] == '"2","","",""'
    assert list(csv.reader(lines))[1] == ["1", 'say "hi", all', "a | b", '{"p":"x","q":1}']
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out")
    assert back.where("id = '1'").first()["t"] == 'say "hi", all'


def test_artifacts_and_readers(spark, tmp_path, landed):
    sections = spark.createDataFrame([("s1", "S", "u", PAGES[0][1], 0)], "sectionId string, sectionLabel string, sectionUrl string, pageUrl string, place int")
    products = catalog.catalogue(*landed, sections)
    sinks.write_catalog(products, f"{tmp_path}/run")
    assert spark.read.json(f"{tmp_path}/run/summary").first()["totalProducts"] == 2
    (tmp_path / "urls.txt").write_text("b.com\n\n# c\n a.com \nb.com\n")
    assert [r["url"] for r in readers.url_file(spark, f"{tmp_path}/urls.txt").orderBy("seq").collect()] == ["https://b.com", "https://a.com"]
    (tmp_path / "doc.json").write_text(json.dumps([{"id": "x", "label": "L"}], indent=1))
    assert readers.documents(spark, f"{tmp_path}/doc.json", schemas.SOURCE).first()["label"] == "L"
    assert readers.documents_or_none(spark, f"{tmp_path}/none.json", schemas.SOURCE).count() == 0
    (tmp_path / "bad.json").write_text('{"level": "info"}\nnot json\n')
    with pytest.raises(Exception):
        readers.logs(spark, f"{tmp_path}/bad.json").collect()


def test_shelf_and_scrape_artifacts(spark, tmp_path, landed):
    rows = spark.createDataFrame([("d", "Padaria", "http://s/d", 1, "http://s/d?p=1", SHELF, "Rede", "Gaspar")], shelves.PAGES)
    departments = spark.createDataFrame([(0, "d", "Padaria", "http://s/d", 23, 1)], "place int, departmentId string, departmentLabel string, departmentUrl string, totalProducts int, totalPages int")
    stores = spark.createDataFrame([("http://s", None, "Gaspar", "Rede")], "source string, requestedCity string, effectiveCity string, storeLabel string")
    sinks.write_shelf_catalog(shelves.products(rows, "div.card"), departments, stores, f"{tmp_path}/shelf")
    summary = spark.read.json(f"{tmp_path}/shelf/summary").first()
    assert (summary["totalProducts"], summary["cityCoverage"], summary["departments"][0]["scrapedProducts"]) == (2, "default", 2)
    assert spark.read.json(f"{tmp_path}/shelf/catalog").count() == spark.read.option("header", True).csv(f"{tmp_path}/shelf/catalog-csv").count() == 2
    config = {"collection": {"selector": "li.card", "fields": {"img": {"selector": "img", "type": "src"}}}}
    read = pages.extracted(landed[0], config)
    items = read.select("page_id", F.explode(F.from_json("data", "collection array<struct<img string>>")["collection"]).alias("item")).select("page_id", "item.*")
    assert sinks.write_scrape(read, items, landed[0], f"{tmp_path}/a") and not sinks.write_scrape(read, items.where("page_id = 3"), landed[0], f"{tmp_path}/b")
    assert (tmp_path / "a" / "results-csv").exists() and not (tmp_path / "b" / "results-csv").exists()
    assert spark.read.json(f"{tmp_path}/b/rendered").where("page_id = 1").first()["html"] == PAGE


def test_webhooks(spark):
    products = spark.createDataFrame([("j", k, f"p{k}") for k in range(5)], "job string, id int, name string")
    context = spark.createDataFrame([("j", "done")], "job string, event string")
    rows = summaries.webhook_rows(products, context, ["job"], [F.col("id")], 2)
    found = sorted(rows.collect(), key=lambda r: r["batchIndex"])
    bodies = [json.loads(r["body"]) for r in found]
    assert [len(b) for b in bodies] == [2, 2, 1] and bodies[1][0] == {"job": "j", "event": "done", "totalProducts": 5, "batchIndex": 2, "totalBatches": 3, "batchSize": 2, "itemIndexInBatch": 1, "id": 2, "name": "p2"}
    named = context.withColumn("name", F.lit("envelope"))
    assert [x["name"] for r in summaries.webhook_rows(products, named, ["job"], [F.col("id")], 9).collect() for x in json.loads(r["body"])] == [f"p{k}" for k in range(5)]

    def post(url, body):
        if '"batchIndex":2' in body:
            raise OSError("down")
        return 500 if '"batchIndex":3' in body else 200

    calls = sinks.post_rows(rows, "http://x", ["batchIndex"], post).collect()
    assert sorted(str(r["error"]) for r in calls) == ["None", "down", "status 500"]
    event = sinks.job_event(spark.createDataFrame([("1", "completed"), ("2", "running")], "id string, status string")).collect()
    assert len(event) == 1 and json.loads(event[0]["body"])["event"] == "catalog.completed"


def test_flat_catalogs_product_keys_win(spark):
    df = spark.createDataFrame([("b", "env", [("p", "own"), ("q", "own2")]), ("c", "env", [])], "batch string, label string, products array<struct<id:string,label:string>>")
    assert [tuple(r) for r in summaries.flat_catalogs(df).orderBy("itemIndex").collect()] == [("b", 1, "p", "own"), ("b", 2, "q", "own2")]


def test_tail_is_the_batch_read(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    lines = events.select(F.col("ts").cast("timestamp").alias("at"), F.lit("info").alias("level"), F.col("event_type").alias("scope"), F.col("event_id").cast("string").alias("message"), F.col("props").alias("context"))
    lines.repartition(4).write.json(f"{tmp_path}/logs")
    for _ in range(2):  # the second run finds nothing new
        tail.tail(tail.log_stream(spark, f"{tmp_path}/logs", 1), f"{tmp_path}/cp", f"{tmp_path}/out", once=True).awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, readers.logs(spark, f"{tmp_path}/logs").collect()))
    q = tail.counts(tail.log_stream(spark, f"{tmp_path}/logs")).writeStream.format("memory").queryName("level_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM level_counts").first()[0] == events.count()


def test_tail_ends_with_its_job(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.json").write_text('{"level": "info", "message": "m"}\n')
    seen = iter(["running", "running", "failed"])
    query = tail.tail(tail.log_stream(spark, str(folder)), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert tail.until_done(query, lambda: next(seen), 0.2) == "failed" and not query.isActive
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    query = tail.tail(tail.log_stream(spark, str(folder)), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert tail.until_done(query, lambda: None) == "missing" and not query.isActive


def test_capture_stream(spark, tmp_path):
    folder = tmp_path / "captures"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"url": "http://a/api/products", "content_type": "application/json", "body": json.dumps({"items": [ITEM]})}) + "\n")
    stream = spark.readStream.schema(schemas.CAPTURE).json(str(folder))
    q = tail.capture_products(stream).writeStream.format("memory").queryName("captured").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["name"] for r in spark.sql("SELECT name FROM captured").collect()] == ["Arroz Tipo 1"]


def test_frontier_is_bounded_and_has_no_repeats(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e")], "url string, href string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert sorted(map(tuple, catalog.frontier(links, seeds, F.lit(True)).collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]
    assert catalog.frontier(links, seeds, F.lit(True), most=3).count() == 3 and catalog.visit_cap(8) == 32 and catalog.visit_cap(1) == 7


SHELF = """<h1>23 Produtos</h1><a href="/departamentos/padaria">Padaria </a><a href="/departamentos/padaria">de novo</a><a>1</a><a>3</a><a>900</a>
<div class="card"><a href="/produto/77/pao"><span>Pão</span></a><img alt="Pão francês" src="/p.png"><b>R$ 1.299,90 /KG</b><i>R$ 999,00</i></div>
<div class="card"><img alt="Bolo"><b>R$ 5</b></div><div class="card"><img alt="Broa"><b>R$ 4,00</b></div>"""


def test_shelf_pages(spark):
    rows = spark.createDataFrame([("d", "Padaria", "http://s/d", 1, "http://s/d?p=1", SHELF, "Rede - Gaspar (SC)", "Gaspar")], shelves.PAGES)
    a, b = shelves.products(rows, "div.card").orderBy("row_id").collect()[::-1]
    assert (a["row_id"], a["product_id"], a["price"], a["original_price_value"], a["discount_percent"], a["unit"], a["product_url"]) == ("d-1-77", "77", "R$ 999,00", 1299.9, 23, "/kg", "http://s/produto/77/pao")
    assert (b["row_id"], b["name"], b["original_price"], b["unit"]) == ("d-1-3", "Broa", None, None)
    assert shelves.products(rows, "div.card").columns == [f.split(" ")[0] for f in schemas.SHELF_PRODUCT.split(", ")]
    links = pages.links(rows.select(F.lit(1).alias("page_id"), "url", "html"))
    assert [tuple(r) for r in shelves.departments(links).select("id", "label").collect()] == [("padaria", "Padaria")]
    assert rows.select(pages.total_products("html")).first()[0] == 23


def test_section_pages_in_order(spark):
    links = spark.createDataFrame([(1, "http://a/s", k, h, t, False, False) for k, (h, t) in enumerate([("http://a/s?page=4", "4"), ("http://a/categorias/x", "Ver tudo"), ("http://b/y", "Ver tudo"), ("http://a/login", "Ver tudo"), ("http://a/produto/1", "x")])], "page_id int, url string, seq int, href string, text string, has_image boolean, in_frame boolean")
    got = [r["pageUrl"] for r in catalog.section_pages(links, 8).orderBy("place").collect()]
    assert got == ["http://a/s", "http://a/categorias/x", "http://a/s?page=4", "http://a/s?page=2", "http://a/s?page=3"]
    assert catalog.section_pages(links, 2).count() == 2


def test_runs(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    sources = spark.createDataFrame([("a", "A", "http://a", None, None), ("b", "B", "http://b", "x", None)], "id string, label string, url string, lastError string, latestJobId string")
    started = runs.started(sources, "manual", at)
    assert {r["status"] for r in started.collect()} == {"running"}
    results = spark.createDataFrame([("a", "generic", 2, 10, True, None), ("b", None, None, None, None, "boom")], "sourceId string, adapterId string, totalSections int, totalProducts int, catalogDetected boolean, message string")
    jobs = {r["sourceId"]: r for r in runs.finished(started, results, at).collect()}
    assert jobs["a"]["status"] == "completed" and jobs["a"]["metrics"]["totalProducts"] == 10 and jobs["b"]["status"] == "failed" and jobs["b"]["error"]["message"] == "boom"
    after = {r["id"]: r for r in runs.patched_sources(sources.withColumn("lastRunAt", F.lit(None).cast("timestamp")).withColumn("lastSuccessAt", F.lit(None).cast("timestamp")), runs.finished(started, results, at)).collect()}
    assert after["a"]["lastError"] is None and after["a"]["lastSuccessAt"] and after["a"]["latestJobId"] and after["b"]["lastError"] == "boom" and after["b"]["lastSuccessAt"] is None
