"""Queries of sources, sinks and ledgers: tables are written to the work folder and read back."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text
from .functions.numeric import round_scaled
from .operators import quality, rules
from .registry import query, r, table
from .session import work_path
from .sources import readers, sinks
from .streaming import ledgers


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@query("""SELECT o_orderkey, o_totalprice, true AS tagged FROM orders""")
def csv_union(spark, sf):
    """Yearly CSV files written, and read as one table with their names."""
    path = work_path(spark, "yearly")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    o.write.partitionBy("y").csv(path, header=True)
    files = [f"{path}/y={row.y}" for row in o.select("y").distinct().collect()]  # a few years
    out = readers.union_csv(spark, files, _struct("o_orderkey long, o_totalprice double"))
    return out.select("o_orderkey", "o_totalprice", F.col("_source_file").endswith(".csv").alias("tagged"))


@query("""SELECT 'ATP-' || (c_custkey % 1000)::VARCHAR AS player_id, trim(c_name || ' ' || c_mktsegment) AS player_name, DATE '1990-01-01' + (c_custkey % 300)::INT AS dob, c_nationkey FROM customer""")
def player_dimension(spark, sf):
    c = table(spark, sf, "customer")
    raw = c.select((F.col("c_custkey") % 1000).alias("player_id"), F.col("c_name").alias("name_first"), F.col("c_mktsegment").alias("name_last"), F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyyMMdd").alias("dob"), "c_nationkey")
    return readers.player_dimension(raw, "atp")


@query("""SELECT count(*) AS n_ids, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT c_custkey % 1000 AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1)""")
def duplicate_players(spark, sf):
    return readers.duplicate_ids(table(spark, sf, "customer").select((F.col("c_custkey") % 1000).alias("k")), "k")


@query("""SELECT o_orderdate::DATE AS ranking_date, o_custkey AS player, o_orderkey AS rank, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 END AS tours FROM orders""")
def rankings_union(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("ranking_date"), F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("rank"), (F.col("o_orderkey") % 9).alias("tours"))
    return readers.rankings([o.filter("rank % 2 = 0"), o.filter("rank % 2 = 1").drop("tours")])


@query("""SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1""")
def override_scan(spark, sf):
    """A combined table beside the original takes its place."""
    base, other = work_path(spark, "base"), work_path(spark, "combined")
    o = table(spark, sf, "orders")
    sinks.overwrite(o, base, ["o_orderstatus"])
    sinks.save_beside(readers.history(spark, base).filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")), other, [base])
    return readers.history(spark, base, override=other).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_orderpriority, count(*) OVER () AS n_places FROM orders WHERE date_part('year', o_orderdate) = (SELECT max(date_part('year', o_orderdate)) FROM orders)""")
def newest_table(spark, sf):
    """The newest of several text tables by name, its rows placed."""
    path = work_path(spark, "radar")
    table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y")).write.partitionBy("y").csv(path, header=True)
    rows = readers.text_csv(spark, readers.newest_file(spark, path, "y=*"), ["o_orderkey", "o_orderpriority"])
    places = rows.agg(F.count_distinct("row_seq").alias("n_places"))
    return rows.crossJoin(F.broadcast(places)).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", "n_places")


@query("""SELECT event_id, ts - INTERVAL 8 HOUR AS event_utc, ts - INTERVAL 11 HOUR AS event_display, 'ATP' AS tour FROM events""")
def calendar_files(spark, sf):
    """Calendar files of several groups, validated, with UTC and display times."""
    path = work_path(spark, "agenda")
    e = table(spark, sf, "events")
    e.select(F.col("event_id").cast("string").alias("event_id"), F.lit("ATP").alias("tour"), F.col("ts").cast("string").alias("event_datetime_original"), F.lit("Asia/Shanghai").alias("event_timezone"), "event_type").write.partitionBy("event_type").csv(path, header=True)
    columns = ["event_id", "tour", "event_datetime_original", "event_timezone"]
    out = readers.calendar_files(spark, f"{path}/event_type=*", columns, {"tour": ("ATP", "WTA")}, ["event_id"], "America/Sao_Paulo")
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("event_utc").cast("timestamp_ntz").alias("event_utc"), F.col("event_display").cast("timestamp_ntz").alias("event_display"), "tour")


@query("""SELECT c_nationkey AS source, 'a,b,c' AS header, count(*) AS n_rows, count(*) FILTER (WHERE c_custkey % 5 = 0) AS n_ragged FROM customer GROUP BY 1""")
def inspected_text(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("source"), F.when(F.col("c_custkey") % 5 == 0, '1,2').otherwise('1,"2,3",4').alias("value"), (F.col("c_custkey") + 1).alias("line_no"))
    heads = c.select("source").distinct().select("source", F.lit("a,b,c").alias("value"), F.lit(0).cast("long").alias("line_no"))
    return readers.inspect_text(c.unionByName(heads))


@query("""SELECT lang, count(*) AS n, round(avg((quality IS NULL OR toxic IS NULL)::INT), 8) AS share_any_missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def coverage(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return quality.coverage_report(d, ["lang"], ["quality", "toxic"]).select("lang", "n", r("share_any_missing", 8).alias("share_any_missing"))


@query("""SELECT n_nationkey, n_name FROM nation""")
def json_lists(spark, sf):
    """JSON files that hold a list, one for each region."""
    path = work_path(spark, "json")
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    n.write.partitionBy("n_regionkey").text(path)
    return readers.json_records(spark, f"{path}/*/*", _struct("n_nationkey int, n_name string"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS label, c_acctbal FROM customer""")
def metric_rows(spark, sf):
    path = work_path(spark, "metrics")
    c = table(spark, sf, "customer")
    c.select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).otherwise(" ").alias("label"), "c_acctbal").write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    return readers.metric_rows(spark, path, _struct("c_custkey long, label string, c_acctbal double"))


@query("""SELECT 'F' AS tour, date_part('year', o_orderdate)::INT AS fold, o_orderkey, o_totalprice AS target FROM orders WHERE o_orderstatus = 'F' AND date_part('year', o_orderdate) IN (1996, 1997)""")
def fold_predictions(spark, sf):
    """Predictions by tour and fold, of which some folds are read."""
    path = work_path(spark, "folds")
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("tour"), F.year("o_orderdate").alias("fold"), "o_orderkey", F.col("o_totalprice").alias("target"), "o_orderpriority")
    sinks.predictions_by_fold(o, ["o_orderkey", "target"], path)
    return readers.fold_rows(spark, path, "F", [1996, 1997]).select("tour", "fold", "o_orderkey", "target")


@query("""SELECT event_id, event_id::VARCHAR AS first_field, 'a,b' AS second_field, event_type AS third_field, 2::BIGINT AS n_rows FROM events""")
def script_matrix(spark, sf):
    """Rows of a matrix in a page's script, and their quoted fields."""
    page = F.concat(F.lit("<html><script>var other = [1]; var matchmx = [["), F.col("event_id").cast("string"), F.lit(", \"a,b\", '"), "event_type", F.lit("'], [1, 2, 3]];</script>"))
    rows = readers.script_rows(page, "matchmx")
    fields = readers.quoted_fields(rows[0])
    return table(spark, sf, "events").select("event_id", fields[0].alias("first_field"), fields[1].alias("second_field"), fields[2].alias("third_field"), F.size(rows).cast("long").alias("n_rows"))


@query("""SELECT event_id, (event_id % 30)::VARCHAR || '+' AS display, 1 + (event_id % 7) / 4.0 AS odds FROM events""")
def line_sections(spark, sf):
    """Pairs of a line and its price within one section of a page's text."""
    k = F.col("event_id")
    body = F.concat(F.lit("Top\n9+\n1,5\n  Aces \n"), (k % 30).cast("string"), F.lit("+\n"), F.regexp_replace((1 + (k % 7) / 4.0).cast("string"), "[.]", ","), F.lit("\nSets\n8+\n2,5"))
    pair = readers.plus_pairs(readers.section(readers.normal_lines(body), "Aces", ["Sets"]))
    return table(spark, sf, "events").select("event_id", F.explode(pair).alias("p")).select("event_id", "p.*")


@query("""SELECT event_id, 'aces' AS market, (event_id % 9)::VARCHAR || '+' AS bookmaker_display, (1.5 + event_id % 3)::DOUBLE AS decimal_odds FROM events WHERE event_id % 4 > 0""")
def model_answers(spark, sf):
    """Readings in a model's fenced JSON answer; incomplete ones and other markets are left out."""
    k = F.col("event_id")
    item = F.concat(F.lit('{"market": "aces", "bookmaker_display": "'), (k % 9).cast("string"), F.lit('+", "decimal_odds": '), F.when(k % 4 == 0, "null").otherwise((1.5 + k % 3).cast("string")), F.lit("}"))
    answer = F.concat(F.lit("```json\n["), item, F.lit(', {"market": "x", "bookmaker_display": "1+", "decimal_odds": 2}]\n```'))
    return table(spark, sf, "events").select("event_id", F.explode(readers.model_readings(answer, ["aces"])).alias("m")).select("event_id", "m.market", "m.bookmaker_display", "m.decimal_odds")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'adequate' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'blocked' WHEN 3 THEN 'blocked' ELSE 'unavailable' END AS http, CASE event_id % 3 WHEN 0 THEN 'adequate' WHEN 1 THEN 'inadequate_schema' ELSE 'unavailable' END AS schema_status, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'score' ELSE 'date,score' END AS missing FROM events""")
def source_adequacy(spark, sf):
    k = F.col("event_id")
    code = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(403), F.lit(429), F.lit(None).cast("int")), (k % 5 + 1).cast("int"))
    header = F.when(k % 3 == 0, "date, score ,x").when(k % 3 == 1, "date,x")
    a = rules.schema_adequacy(header, ["date", "score"])
    return table(spark, sf, "events").select("event_id", rules.http_status(code).alias("http"), a["status"].alias("schema_status"), F.array_join(a["missing"], ",").alias("missing"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 6""")
def report_sample(spark, sf):
    """The last rows of a report, as its CSV file has them."""
    path = work_path(spark, "sample")
    sinks.report_csv(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, ["o_totalprice", "o_orderkey"], last=6)
    return readers.union_csv(spark, [path], _struct("o_orderkey long, o_totalprice double")).drop("_source_file")


@query("""SELECT o_orderpriority AS priority, count(*) AS n, max(o_orderkey) AS top, NULL::VARCHAR AS note FROM orders GROUP BY 1""")
def summary_json(spark, sf):
    """Diagnostics of orders written as JSON and read back."""
    path = work_path(spark, "summary")
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"), F.lit(None).cast("string").alias("note"))
    sinks.summary_json(rows, path)
    return spark.read.schema("priority string, n long, top long, note string").json(path)


@query("""SELECT '| ' || c_custkey::VARCHAR || ' | ' || c_name || ' | ' || CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_mktsegment || '\\|' || c_nationkey::VARCHAR END || ' |' AS line FROM customer UNION ALL SELECT '| c_custkey | c_name | segment |' UNION ALL SELECT '|---|---|---|'""")
def markdown_lines(spark, sf):
    """All customers as a Markdown table, written in order by Spark and read back."""
    path, k = work_path(spark, "markdown"), F.col("c_nationkey")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(k % 5 != 0, F.concat("c_mktsegment", F.lit("|"), k.cast("string"))).alias("segment"))
    sinks.markdown_table(rows, path, ["c_custkey"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT o_orderstatus AS id, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS refused FROM orders GROUP BY 1""")
def stored_record(spark, sf):
    """A record for each status of orders in a folder of its own; the same folder again is refused."""
    path = work_path(spark, "record")
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    sinks.store_record(rows, path, "id")
    try:
        sinks.store_record(rows.withColumn("n", F.lit(0)), path, "id")
        refused = False
    except Exception as error:  # noqa: BLE001  (Spark's own error classes differ by version)
        refused = "already exists" in str(error)
    return readers.json_records(spark, path, _struct("n long, total double, id string")).withColumn("refused", F.lit(refused))


@query("""
SELECT 'f' || c_custkey::VARCHAR AS path, CASE c_custkey % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'skip' ELSE 'conflict' END AS action,
 CASE c_custkey % 3 WHEN 0 THEN 'f' || c_custkey::VARCHAR WHEN 2 THEN 'f' || c_custkey::VARCHAR || '.conflict-t2' END AS stored_as FROM customer""")
def content_store(spark, sf):
    """Files stored by content, never overwritten."""
    folder = work_path(spark, "store")
    k = F.col("c_custkey")
    files = lambda content: table(spark, sf, "customer").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), content.cast("binary").alias("content"), k)
    sinks.store_contents(spark, files(F.col("c_name")).filter(k % 3 > 0).drop("c_custkey"), folder, "t1")
    done = sinks.store_contents(spark, files(F.when(k % 3 == 2, F.lit("other")).otherwise(F.col("c_name"))).drop("c_custkey"), folder, "t2")
    return done.select("path", "action", "stored_as")


@query("""SELECT 1::BIGINT AS n_files, true AS same""")
def hash_snapshot(spark, sf):
    """Hashes of a table's files before and after reading it."""
    before = readers.file_hashes(spark, f"{sf}/nation.parquet")
    table(spark, sf, "nation").count()
    after = readers.file_hashes(spark, f"{sf}/nation.parquet").select("path", F.col("sha256").alias("now"))
    return before.join(after, "path", "full_outer").agg(F.count(F.lit(1)).alias("n_files"), F.bool_and(F.col("sha256").eqNullSafe(F.col("now"))).alias("same"))


# --- ledgers ------------------------------------------------------------------------------


_EV = "(SELECT event_id, user_id, event_type, event_id // 2 AS pair, value FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr("event_id div 2").alias("pair"), "value")


@query("""
WITH m AS (SELECT user_id, event_type, max_by(value, event_id) AS closing FROM events GROUP BY ALL)
SELECT event_id, round((value / closing - 1) * 100, 4) AS clv_pct, round(1 / closing - 1 / value, 8) AS prob_diff, value > closing AS beat_close FROM events JOIN m USING (user_id, event_type)""")
def closing_values(spark, sf):
    e = _events(spark, sf)
    priced = F.when(F.col("value").isNotNull(), F.col("event_id"))  # the SQL's max_by passes NULL prices over
    move = e.groupBy("user_id", "event_type").agg(F.max_by("value", priced).alias("closing_odds"))
    out = ledgers.clv(e, move, ["user_id", "event_type"], used="value", unpriced=True)
    return out.select("event_id", round_scaled(F.col("clv_pct"), 4).alias("clv_pct"), round_scaled(F.col("prob_diff"), 8).alias("prob_diff"), "beat_close")


@query("""
WITH s AS (SELECT user_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'WIN' WHEN event_id % 4 = 2 THEN 'LOSS' ELSE 'UNRESOLVED' END AS s, value / 1000 AS edge FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE s IS NULL OR s = 'UNRESOLVED') AS pending, count(*) FILTER (WHERE s = 'WIN') AS wins, count(*) FILTER (WHERE s = 'LOSS') AS losses,
 round(count(*) FILTER (WHERE s = 'WIN') / nullif(count(*) FILTER (WHERE s IN ('WIN', 'LOSS')), 0), 8) AS hit_rate, round(avg(edge), 8) AS mean_edge FROM s GROUP BY 1""")
def ledger_dashboard(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("prediction_id"), "event_type", (F.col("value") / 1000).alias("edge"))
    k = F.col("prediction_id") % 4
    settled = e.filter(k > 0).select("prediction_id", F.when(k == 1, "WIN").when(k == 2, "LOSS").otherwise("UNRESOLVED").alias("settlement"))
    out = ledgers.dashboard(e, settled, ["event_type"])
    return out.select("event_type", "n", "pending", "wins", "losses", r("hit_rate", 8).alias("hit_rate"), r("mean_edge", 8).alias("mean_edge"))


@query("""
WITH l AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'WIN' WHEN event_id % 4 = 1 THEN 'UNRESOLVED' END AS last, CASE WHEN event_id % 3 = 0 THEN 'WIN' ELSE 'LOSS' END AS now, event_type FROM events),
a AS (SELECT *, CASE WHEN last = 'WIN' THEN 'WIN' ELSE now END AS state FROM l)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE state = 'WIN') AS wins, count(*) FILTER (WHERE state = 'LOSS') AS losses, count(*) FILTER (WHERE last = 'WIN' AND now = 'LOSS') AS rejected, count(*) FILTER (WHERE last IS NULL OR last = 'UNRESOLVED') AS written FROM a GROUP BY 1""")
def ledger_day(spark, sf):
    """A day's settlement events, and the dashboard after them."""
    e = _events(spark, sf).select(F.col("event_id").alias("prediction_id"), "event_type", F.lit(0.05).alias("edge"), F.lit(1).alias("one"))
    k = F.col("prediction_id")
    log = e.filter(k % 4 < 2).select("prediction_id", F.when(k % 4 == 0, "WIN").otherwise("UNRESOLVED").alias("settlement"), F.lit(0).alias("settled_at"))
    results = spark.range(1).select(F.lit(1).alias("one"))
    events, board = ledgers.run_day(e, results, log, lambda: F.when(k % 3 == 0, "WIN").otherwise("LOSS"), ["one"], F.lit(1), ["event_type"])
    tally = events.join(e.select("prediction_id", "event_type"), "prediction_id").groupBy("event_type").agg(F.count_if(F.col("event") == "rejected").alias("rejected"), F.count_if(F.col("event") != "rejected").alias("written"))
    return board.join(tally, "event_type").select("event_type", "n", "wins", "losses", "rejected", "written")


@query("""
WITH n AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'abandoned' ELSE 'completed' END AS st, event_id % 50 AS m, (event_id % 10) + (event_id % 3) AS total FROM events), o AS (SELECT m, total FROM (SELECT event_id % 50 AS m, (event_id % 10) + (event_id % 3) AS total, row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id) AS k FROM events) WHERE k = 1 AND m % 2 = 0),
h AS (SELECT n.*, o.total AS old, first_value(n.total) OVER (PARTITION BY n.m ORDER BY n.event_id) AS head, row_number() OVER (PARTITION BY n.m ORDER BY n.event_id) AS nth FROM n LEFT JOIN o ON n.m = o.m WHERE st = 'completed')
SELECT event_id, CASE WHEN old IS NULL AND nth = 1 THEN 'added' WHEN total = coalesce(old, head) THEN 'skipped' ELSE 'rejected' END AS status FROM h UNION ALL SELECT event_id, 'rejected' FROM n WHERE st = 'abandoned'""")
def recorded_results(spark, sf):
    """Results with a status of the list and totals added up where they aren't given."""
    k = F.col("event_id")
    new = _events(spark, sf).select("event_id", (k % 50).alias("m"), F.when(k % 7 == 0, "abandoned").otherwise("completed").alias("match_status"), (k % 10).alias("a"), (k % 3).alias("b"), F.lit(None).cast("long").alias("total"))
    from .operators.windows import first

    old = first(new.filter("m % 2 = 0"), ["m"], ["event_id"]).withColumn("total", F.col("a") + F.col("b"))
    return ledgers.record_results(old, new, "m", {"total": ("a", "b")}, ["total"], ["event_id"]).select("event_id", "status")


@query("""SELECT event_id AS prediction_id, 'book' AS bookmaker, value AS decimal_odds, ts AS collected_at, 'v1' AS model_version, NULL::VARCHAR AS git_commit, date_diff('day', ts::DATE, DATE '2024-03-01')::INT AS staleness_at_registration FROM events WHERE event_id % 3 = 0""")
def first_snapshots(spark, sf):
    """The price of each prediction newly registered, stamped with versions."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("prediction_id"), F.lit("book").alias("bookmaker"), F.col("value").alias("decimal_odds"), F.col("ts").alias("collected_at"), F.when(F.col("event_id") % 3 == 0, "added").otherwise("skipped").alias("status"))
    return ledgers.with_versions(ledgers.first_snapshot(e), {"model_version": "v1", "git_commit": None}, F.datediff(F.lit("2024-03-01").cast("date"), F.to_date("collected_at")))


@query("""
SELECT event_id, value, 'old' AS origin FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL
SELECT event_id, value * 2, 'new' FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-10')""")
def integrated_rows(spark, sf):
    """A ledger and what is new of a batch, transformed."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).alias("early"))
    context = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    old = e.filter("early").drop("early").withColumn("origin", F.lit("old"))
    out = ledgers.integrate(old, e.filter("NOT early").drop("early"), lambda d: d.withColumn("value", F.col("value") * 2).withColumn("origin", F.lit("new")), {"id": "event_id"}, {"context": (context, context)})
    return out.select("event_id", "value", "origin")


@query("""SELECT 'L' || (event_id % 100)::VARCHAR AS id, 1.5 + (event_id % 40) / 8.0 AS odds, event_id FROM events WHERE event_id % 100 < 50""")
def text_report(spark, sf):
    """Blocks of a text report, with the values after their labels."""
    k = F.col("event_id")
    body = F.concat(F.lit("Report\nOdds: 9\n"), F.when(k % 100 < 50, F.concat(F.lit("Line: L"), (k % 100).cast("string"), F.lit("\n  Odds: about "), F.regexp_replace((1.5 + (k % 40) / 8.0).cast("string"), "[.]", ","), F.lit(" units\n"))).otherwise("end"))
    blocks = text.parse_report(body, {"id": "Line", "odds": "Odds"}, "Line:")
    return table(spark, sf, "events").select("event_id", F.explode(blocks).alias("b")).select("b.id", text.clean_number(F.col("b.odds")).alias("odds"), "event_id")
