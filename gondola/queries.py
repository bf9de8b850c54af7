"""Registered queries of the operators over the shared tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions import badges, payloads, prices, text, urls
from gondola.operators import cities, ledger, pages, ranking, scoring, summaries
from gondola.plans import catalog
from gondola.sources import readers, sinks

NOW = "1998-08-02 00:00:00"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) and its SQL under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(x: str, rules: tuple) -> str:
    """SQL for scoring.total."""
    return " + ".join(f"CASE WHEN regexp_matches({x}, '{p}', 'i') THEN {w} ELSE 0 END" for p, w in rules)


# Text and URLs


@query("SELECT page_id, substr(lower(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 80) AS slug FROM pages")
def slug_urls(spark, d):
    return table(spark, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages")
def host_no_www(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("SELECT page_id, 'https://' || regexp_replace(url, '^[a-zA-Z]+://', '') AS full_url FROM pages")
def ensure_scheme(spark, d):
    bare = F.regexp_replace("url", "^[a-zA-Z]+://", "")
    return table(spark, d, "pages").select("page_id", urls.ensure_scheme(bare).alias("full_url"))


@query("SELECT page_id, p AS place, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || '/' || root AS candidate FROM pages, (SELECT unnest(['produtos','categorias','categoria','departamentos','departamento','shop','catalog','catalogo','listar.php','loja']) AS root, unnest(range(10)) AS p)")
def root_candidates(spark, d):
    found = table(spark, d, "pages").select("page_id", F.posexplode(urls.root_candidates(F.col("url"))).alias("place", "candidate"))
    return found.select("page_id", F.col("place").cast("long").alias("place"), "candidate")


@query("SELECT doc_id, trim(lower(strip_accents(text))) AS normal FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.folded("text").alias("normal"))


@query("SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS clean, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM documents")
def clean_text(spark, d):
    n = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(text.NOT_SPACE)))
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("clean"), n.cast("long").alias("lines"))


@query("SELECT doc_id, trim(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '\\s+', ' ', 'g')) AS first_line FROM documents")
def first_line(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_line(F.col("text")).alias("first_line"))


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title FROM part")
def title_case(spark, d):
    return table(spark, d, "part").select("p_partkey", text.title_case(F.col("p_name")).alias("title"))


# Prices


@query("SELECT p_partkey, 'R$ ' || replace(printf('%.2f', p_retailprice), '.', ',') AS price, round(p_retailprice, 2) AS value FROM part")
def price_round_trip(spark, d):
    shown = table(spark, d, "part").select("p_partkey", prices.format_price(F.col("p_retailprice")).alias("price"))
    return shown.select("p_partkey", "price", prices.parse_price(F.col("price")).alias("value"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice > l_extendedprice * (1 - l_discount) "
    "THEN floor((l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice * 100 + 0.5)::INT END AS discount FROM lineitem"
)
def discount_percent(spark, d):
    now = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    found = prices.discount_percent(F.lit(None).cast("string"), now, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found.alias("discount"))


@query(
    "SELECT l_orderkey, min(round(l_extendedprice, 2)) AS current, CASE WHEN max(round(l_extendedprice, 2)) > min(round(l_extendedprice, 2)) THEN max(round(l_extendedprice, 2)) END AS original, "
    "count(*)::INT AS n FROM lineitem GROUP BY l_orderkey"
)
def price_state(spark, d):
    """The lowest and highest price in a text of all prices of an order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(prices.format_price(F.round("l_extendedprice", 2))), " ").alias("text"))
    return lines.select("l_orderkey", prices.price_state(F.col("text")).alias("s")).select("l_orderkey", "s.current", "s.original", "s.n")


# Scores and links


@query(
    f"SELECT page_id, 7 * least(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)), 40) + {cases('url', scoring.ROOT)} "
    f"+ CASE WHEN regexp_matches(url, '{scoring.ROOT_INPUT}', 'i') AND regexp_matches(url, '{scoring.ROOT_LANDED}', 'i') THEN -240 ELSE 0 END AS score FROM pages"
)
def url_rule_score(spark, d):
    n = F.size(pages.href_values(F.col("html")))
    score = scoring.root_score(F.col("url"), F.col("url"), F.lit("dom"), F.lit(0), n)
    return table(spark, d, "pages").select("page_id", score.cast("long").alias("score"))


LINKS = "SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS seq FROM pages"


def href_rows(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.posexplode(pages.href_values(F.col("html"))).alias("seq", "href"))


@query(f"SELECT page_id, seq, href FROM ({LINKS})")
def page_links(spark, d):
    return href_rows(spark, d).select("page_id", F.col("seq").cast("long").alias("seq"), "href")


@query(f"SELECT href, arg_min(page_id, (page_id, seq)) AS first_page, count(*) AS n FROM ({LINKS}) GROUP BY href")
def link_dedupe(spark, d):
    return href_rows(spark, d).groupBy("href").agg(F.min_by("page_id", F.struct("page_id", "seq")).alias("first_page"), F.count("*").alias("n"))


SECTION_CASES = cases("replace(href, '/', ' ') || ' ' || href", scoring.SECTION)


@query(
    f"SELECT page_id, href, score, rank FROM (SELECT page_id, href, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS rank "
    f"FROM (SELECT *, {SECTION_CASES} + CASE WHEN length(replace(href, '/', ' ')) BETWEEN 3 AND 80 THEN 8 ELSE 0 END AS score FROM ({LINKS}))) WHERE rank <= 3"
)
def section_topk(spark, d):
    label = F.replace(F.col("href"), F.lit("/"), F.lit(" "))
    scored = href_rows(spark, d).withColumn("score", scoring.section_score(label, F.col("href"), F.lit(False)).cast("long"))
    return ranking.top(scored, ["page_id"], [F.col("score").desc(), F.col("seq")], 3).select("page_id", "href", "score", F.col("rank").cast("long").alias("rank"))


PAGE_OF = "coalesce(try_cast(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS INT), 1)"


@query(f"SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host, max({PAGE_OF}) AS pages FROM pages GROUP BY 1")
def max_page_number(spark, d):
    number = F.coalesce(F.nullif(F.regexp_extract("url", r"[?&]page=(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1))
    return table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.max(number).alias("pages"))


@query(
    f"SELECT page_id, base || CASE WHEN contains(base, '?') THEN '&page=' ELSE '?page=' END || n AS page_url FROM (SELECT page_id, "
    f"regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])page=[^&]*(&|$)', '\\1', 'g'), '[?&]$', '') AS base, unnest(range(2, least({PAGE_OF}, 8) + 1)) AS n FROM pages)"
)
def synthesised_pages(spark, d):
    number = F.coalesce(F.nullif(F.regexp_extract("url", r"[?&]page=(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.explode(urls.numbered_pages(F.col("url"), number, 8)).alias("page_url"))


@query(
    f"WITH RECURSIVE e AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '') AS a, regexp_replace(lower(regexp_extract(href, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '') AS b FROM ({LINKS})), "
    "s AS (SELECT min(a) AS n FROM e WHERE a <> ''), f(n, depth) AS (SELECT n, 0 FROM s UNION SELECT b, depth + 1 FROM f JOIN e ON a = n WHERE depth < 3 AND b <> '') SELECT n AS url, min(depth) AS depth FROM f GROUP BY n"
)
def frontier_bfs(spark, d):
    """Hosts that three links lead to from the first host of the pages' own links."""
    found = href_rows(spark, d).select(urls.host(F.col("url")).alias("url"), urls.host(F.col("href")).alias("href")).where("url <> ''")
    links = found.where("href <> ''")
    return catalog.frontier(links, found.agg(F.min("url").alias("url")), F.lit(True), rounds=3, most=1 << 30)


# Keep-the-best


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def dedupe_best_event(spark, d):
    best = ranking.keep_first(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("value").desc(), F.col("event_id")])
    return best.orderBy("user_id", "event_type")


@query(
    "SELECT p_partkey, p_name, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) || '|' || p_brand ORDER BY p_size DESC, p_retailprice, p_partkey) AS r FROM part) WHERE r = 1"
)
def dedupe_part(spark, d):
    part = table(spark, d, "part").withColumn("key", ranking.joined_key(F.lower("p_name"), F.col("p_brand")))
    return ranking.keep_first(part, ["key"], [F.col("p_size").desc(), F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query(
    "SELECT l_orderkey, string_agg(l_partkey || ':' || l_suppkey || ':' || l_linenumber, '|' ORDER BY r) AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 20 GROUP BY l_orderkey"
)
def fingerprint_orders(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("name"), F.col("l_linenumber").alias("price"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    return ranking.fingerprints(items, ["l_orderkey"])


@query(
    "WITH f AS (SELECT l_orderkey, string_agg(l_quantity::INT::VARCHAR, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS fingerprint FROM lineitem GROUP BY l_orderkey) SELECT min(l_orderkey) AS l_orderkey, fingerprint FROM f GROUP BY fingerprint"
)
def first_pages(spark, d):
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").cast("string").alias("q"))))
    marks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(lines, lambda x: x["q"]), "|").alias("fingerprint"))
    return ranking.first_pages(marks, [], "l_orderkey")


@query(
    "WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS dom, count(*) FILTER (event_type = 'view') AS network FROM events GROUP BY user_id) "
    "SELECT user_id, CASE WHEN dom = 0 AND network = 0 THEN 'none' WHEN network > dom THEN 'network' ELSE 'dom' END AS strategy FROM n"
)
def choose_strategy(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("dom"), F.count_if(F.col("event_type") == "view").alias("network"))
    return n.select("user_id", ranking.chosen_strategy(F.col("dom"), F.col("network")).alias("strategy"))


@query(
    "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, (lang = 'en') DESC, doc_id) AS r FROM documents) WHERE r = 1"
)
def best_candidate(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("n_items"), F.when(F.col("lang") == "en", "network").otherwise("dom").alias("strategy"))
    return ranking.best_candidate(docs, ["source"], "doc_id").select("source", "doc_id", F.col("n_items").alias("n_chars"))


@query(
    "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_acctbal > 0) DESC, (c_mktsegment <> 'BUILDING') DESC, c_custkey) AS r FROM customer) WHERE r = 1"
)
def best_city(spark, d):
    found = table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") > 0).alias("cityEligible"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("effectiveCity"))
    return ranking.best_city(found, ["c_nationkey"], "c_custkey").select("c_nationkey", "c_custkey")


@query("SELECT s_nationkey AS key, arg_min(kind, priority) AS kind FROM (SELECT s_nationkey, 'supplier' AS kind, 0 AS priority FROM supplier UNION ALL SELECT c_nationkey, 'customer', 1 FROM customer UNION ALL SELECT n_nationkey, 'nation', 2 FROM nation) GROUP BY 1")
def set_union_priority(spark, d):
    frames = [table(spark, d, t).select(F.col(c).alias("key"), F.lit(t).alias("kind")) for t, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"))]
    return ranking.in_priority([f.distinct() for f in frames], ["key"]).select("key", "kind")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti").distinct()


# Ledger: orders stand for jobs, customers for sources, events for log lines


def jobs(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sourceId"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("startedAt"))


@query("SELECT o_orderkey AS id, o_custkey AS \"sourceId\", o_orderstatus AS status, o_orderdate AS \"startedAt\" FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def latest_index_500(spark, d):
    every = jobs(spark, d)
    return ledger.kept_index(every.where("status = 'F'"), every.where("status <> 'F'"))


@query("SELECT o_orderkey AS id, o_orderdate AS \"startedAt\" FROM orders WHERE o_custkey = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def list_by_source(spark, d):
    return ledger.listed(jobs(spark, d), [F.col("startedAt").desc(), F.col("id")], 50, sourceId=1).select("id", "startedAt")


@query(
    "SELECT user_id, event_id, line, total, least(total, 15)::INT AS \"nextAfter\" FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE line > 5 AND line <= 15"
)
def log_page(spark, d):
    found = ledger.log_page(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 5, 10)
    return found.select("user_id", "event_id", F.col("line").cast("long").alias("line"), "total", "nextAfter")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (i - 1) // 3 + 1 AS \"batchIndex\", (n + 2) // 3 AS \"totalBatches\", least(3, n - (i - 1) // 3 * 3) AS \"batchSize\", (i - 1) % 3 + 1 AS \"itemIndexInBatch\" "
    "FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"
)
def webhook_chunks(spark, d):
    found = ranking.in_chunks(table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 3)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.col(c).cast("long").alias(c) for c in ("batchIndex", "totalBatches", "batchSize", "itemIndexInBatch")))


@query(
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS \"itemIndex\", l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
)
def flatten_batch(spark, d):
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    products = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(lines.alias("products"))
    catalogs = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(products, "o_orderkey")
    return summaries.flat_catalogs(catalogs).select("o_orderkey", "o_orderstatus", F.col("itemIndex").cast("long").alias("itemIndex"), "l_partkey", "l_quantity")


@query(
    "WITH n AS (SELECT l_orderkey, count(*) AS products FROM lineitem GROUP BY 1) SELECT o_custkey AS \"batchId\", count(*) AS \"totalItems\", count(*) FILTER (o_orderstatus = 'O') AS \"completedItems\", "
    "count(*) FILTER (o_orderstatus = 'F') AS \"failedItems\", sum(coalesce(products, 0))::BIGINT AS \"totalProducts\" FROM orders LEFT JOIN n ON o_orderkey = l_orderkey GROUP BY 1"
)
def batch_summary(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("products"))
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "failed")
    items = table(spark, d, "orders").join(n, "o_orderkey", "left").select(F.col("o_custkey").alias("batchId"), status.alias("status"), "products")
    return summaries.batch_totals(items)


@query(
    "SELECT l_shipdate::DATE AS \"sectionId\", count(DISTINCT l_suppkey) AS \"totalPages\", count(*) AS \"totalProducts\" FROM lineitem GROUP BY 1"
)
def section_totals(spark, d):
    day = F.col("l_shipdate").cast("date")
    products = table(spark, d, "lineitem").select(day.alias("sectionId"), day.alias("sectionLabel"), day.alias("sectionUrl"), F.col("l_suppkey").alias("pageUrl"))
    return summaries.section_totals(products).select("sectionId", "totalPages", "totalProducts")


@query(
    "SELECT (SELECT count(*) FROM customer) AS sources, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS enabled, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P') AS running, (SELECT least(count(*), 10) FROM orders) AS \"recentJobs\""
)
def health_totals(spark, d):
    running = jobs(spark, d).where("status = 'P'")
    return ledger.health(table(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("enabled")), running, jobs(spark, d))


@query(
    "WITH j AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job FROM orders GROUP BY 1), s AS (SELECT l_orderkey, count(*) AS products FROM lineitem GROUP BY 1) "
    "SELECT c_custkey AS id, job AS \"latestJobId\", products FROM customer JOIN j ON c_custkey = o_custkey LEFT JOIN s ON l_orderkey = job"
)
def latest_catalog(spark, d):
    latest = jobs(spark, d).groupBy(F.col("sourceId").alias("id")).agg(F.max_by("id", F.struct("startedAt", "id")).alias("latestJobId"))
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(latest, "id")
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("jobId")).agg(F.count("*").alias("products"))
    return ledger.latest_catalog(sources, jobs(spark, d).select("id", "status"), counts).select("id", "latestJobId", "products")


def sources(spark, d) -> DataFrame:
    last = jobs(spark, d).groupBy(F.col("sourceId").alias("id")).agg(F.max("startedAt").alias("lastRunAt"), F.max(F.when(F.col("status") == "F", F.col("startedAt"))).alias("lastSuccessAt"))
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("enabled"), (F.col("c_nationkey") * 1440).alias("scheduleMinutes"))
    return every.join(last, "id", "left")


SOURCES = (
    "WITH l AS (SELECT o_custkey, max(o_orderdate) AS last_run, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last_ok FROM orders GROUP BY 1), s AS (SELECT c_custkey AS id, c_acctbal > 0 AS enabled, "
    f"CASE WHEN NOT (c_acctbal > 0) THEN NULL WHEN last_run IS NULL THEN TIMESTAMP '{NOW}' ELSE coalesce(last_ok, last_run) + to_minutes(c_nationkey * 1440) END AS next FROM customer LEFT JOIN l ON o_custkey = c_custkey), "
    "r AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate > TIMESTAMP '1998-06-01') "
)


def running(spark, d) -> DataFrame:
    return jobs(spark, d).where((F.col("status") == "P") & (F.col("startedAt") > F.lit("1998-06-01").cast("timestamp_ntz")))


@query(SOURCES + f"SELECT id, next AS \"nextRunAt\" FROM s WHERE enabled AND next <= TIMESTAMP '{NOW}' AND id NOT IN (SELECT o_custkey FROM r)")
def due_sources(spark, d):
    return ledger.due(sources(spark, d), running(spark, d), F.lit(NOW).cast("timestamp_ntz")).select("id", "nextRunAt")


@query(SOURCES + "SELECT id, next AS \"nextRunAt\", id IN (SELECT o_custkey FROM r) AS running FROM s")
def next_run(spark, d):
    return ledger.with_state(sources(spark, d), running(spark, d), F.lit(NOW).cast("timestamp_ntz")).select("id", "nextRunAt", "running")


@query("SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'patched' ELSE p_brand END AS brand, p_size AS size FROM part")
def upsert_patch(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    patch = part.where("size > 40").select("id", F.lit("patched").alias("brand"), F.lit(None).cast("int").alias("size"))
    return ledger.patched(part, patch.unionByName(spark.createDataFrame([(-1, "nobody", 1)], "id long, brand string, size int")))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def delete_by_id(spark, d):
    gone = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    return ledger.deleted(table(spark, d, "part").select(F.col("p_partkey").alias("id")), gone)


@query(
    "SELECT p_partkey, CASE WHEN r = 1 THEN slug ELSE slug || '-' || r END AS id FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS r "
    "FROM (SELECT p_partkey, substr(lower(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 80) AS slug FROM part))"
)
def unique_id_suffix(spark, d):
    return ledger.unique_ids(table(spark, d, "part").select("p_partkey", "p_name"), text.slug(F.col("p_name")), [F.col("p_partkey")]).select("p_partkey", "id")


@query("SELECT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region) ORDER BY name")
def sorted_labels(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("id")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("label"), F.col("r_regionkey").alias("id")))
    return ledger.sorted_sources(names).select(F.col("label").alias("name"))


@query(
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'default' WHEN n_name IS NULL THEN 'unknown' WHEN lower(n_name) = lower(r_name) THEN 'match' ELSE 'mismatch' END AS coverage "
    "FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal > 0 LEFT JOIN region ON r_regionkey = c_nationkey % 5"
)
def city_coverage(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = table(spark, d, "customer").join(nation, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("c_acctbal") > 0), "left").join(region, F.col("r_regionkey") == F.col("c_nationkey") % 5, "left")
    return rows.select("c_custkey", cities.coverage(F.when(F.col("c_mktsegment") != "BUILDING", F.col("r_name")), F.col("n_name")).alias("coverage"))


# Lists, JSON and exports


@query(
    "WITH w AS (SELECT doc_id, string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ') AS words FROM documents), u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w), "
    "f AS (SELECT doc_id, arg_min(word, i) AS word, min(i) AS i FROM u WHERE length(word) BETWEEN 2 AND 80 GROUP BY doc_id, lower(word)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f) "
    "SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS badges FROM r WHERE k <= 8 GROUP BY doc_id"
)
def badges_distinct_ci(spark, d):
    words = F.split(text.squeeze(F.col("text")), " ")
    some = table(spark, d, "documents").where(F.col("text").rlike(r"(?<!\S)\S{2,80}(?!\S)"))
    return some.select("doc_id", F.array_join(badges.badge_list(words), " ").alias("badges"))


@query(
    "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, string_agg(l_partkey::VARCHAR, ' | ' ORDER BY l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus"
)
def csv_join_arrays(spark, d):
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    return sinks.csv_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(parts, "o_orderkey"))


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_widen(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return sinks.widened([c, s])


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def json_flatten(spark, d):
    flat = table(spark, d, "events").select("event_id", F.explode(payloads.flat_json("props")).alias("f"))
    return flat.select("event_id", "f.path", "f.value")


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS price FROM events")
def json_pick(spark, d):
    wrapped = F.concat(F.lit('{"id":1,"offer":{"price":'), F.get_json_object("props", "$.k"), F.lit('},"longer":{"way":{"price":0}}}'))
    flat = table(spark, d, "events").select("event_id", payloads.flat_json(wrapped).alias("flat"))
    return flat.select("event_id", prices.parse_price(payloads.pick_path(F.col("flat"), payloads.PRICES)).alias("price"))


@query(
    "WITH e AS (SELECT c_nationkey, min(c_custkey) AS stop FROM customer WHERE c_acctbal < 0 GROUP BY 1) SELECT c.c_nationkey, c.c_custkey FROM customer c LEFT JOIN e USING (c_nationkey) WHERE stop IS NULL OR c_custkey < stop"
)
def until_empty(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") < 0, 0).otherwise(1).alias("n_items"))
    return readers.until_empty(rows, "c_nationkey", "c_custkey").select("c_nationkey", "c_custkey")


@query("SELECT min(seq) AS seq, url FROM (SELECT page_id AS seq, 'https://' || regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', '') AS url FROM pages) GROUP BY url")
def url_list(spark, d):
    lines = table(spark, d, "pages").select(F.col("page_id").alias("seq"), F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://", ""), "[?#].*$", "").alias("value"))
    comments = lines.select(F.col("seq"), F.lit("# comment").alias("value"))
    return readers.url_list(lines.unionByName(comments))
