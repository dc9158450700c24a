"""Reading, writing, parsing, report and streaming queries.

Texts are derived from the tables, written to the working folder and read back by the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.cleaning import rounded
from checks.comparing import cohort_pairs, PAIRED_STATS
from checks.registry import registry
from runlens import schemas
from runlens.functions import keys
from runlens.operators import compare
from runlens.session import fresh_path
from runlens.sources import console, files, lines, report, results, runlog, stats
from runlens.streaming import ingest as stream_ingest
from runlens.streaming import progress, tail, timeouts

QUERIES, SQL, query = registry()


VARIANTS = ["base", "old", "new"]


def raw_result_lines(spark, sf):
    """One text line per order line; some kinds of parts give broken lines."""
    status = F.when(F.col("l_returnflag") == "A", "S").when(F.col("l_returnflag") == "R", "E").otherwise("G")
    q = F.col("l_quantity").cast("int")
    item1 = F.format_string("S %d %d", q, "l_partkey")
    item2 = F.format_string("%s %d %d", status, q + 1, "l_partkey")
    item3 = F.format_string("%s %d %d", status, q + 2, "l_suppkey")
    name = F.format_string("U%d.%d.%d.%d..", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    kind = F.col("l_partkey") % 10

    def line(*items):
        return F.concat(F.col("l_orderkey").cast("string"), F.lit(" #["), F.concat_ws(", ", *items), F.lit("] "), name)

    value = (
        F.when(kind == 0, F.concat(F.lit("x "), line(item1, item2, item3)))
        .when(kind == 1, F.concat(F.lit("7 no list"), F.col("l_orderkey").cast("string")))
        .when(kind == 2, line(item1, item2))
        .when(kind == 3, line(item1, item2, F.lit("S")))
        .when(kind == 4, F.lit(""))
        .otherwise(line(item1, item2, item3))
    )
    return t.table(spark, sf, "lineitem").select(value.alias("value"))


def result_files(spark, sf):
    path = fresh_path(spark, "lines")
    raw_result_lines(spark, sf).write.text(path)
    return path


@query(
    "lenient_results",
    """WITH l AS (SELECT 'U' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS unit,
      l_returnflag = 'A' AS a, CAST(l_quantity AS BIGINT) AS q, l_partkey % 10 AS kind FROM lineitem)
    SELECT 'base' AS variant, unit, true AS ok, q AS value FROM l WHERE kind = 3 OR kind > 4
    UNION ALL SELECT 'old', unit, a, q + 1 FROM l WHERE kind = 3 OR kind > 4
    UNION ALL SELECT 'new', unit, a, q + 2 FROM l WHERE kind > 4""",
)
def lenient_results(spark, sf):
    return results.read_runs(spark, result_files(spark, sf), VARIANTS, glob="*.txt")


@query(
    "lenient_results_whole_lines",
    """SELECT 'U' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS unit,
    CAST(l_quantity AS BIGINT) AS value FROM lineitem WHERE l_partkey % 10 > 4""",
)
def lenient_results_whole_lines(spark, sf):
    runs = results.read_runs(spark, result_files(spark, sf), VARIANTS, glob="*.txt", drop_line=True)
    return runs.filter(F.col("variant") == "base").select("unit", "value")


@query(
    "parse_errors",
    """SELECT CASE l_partkey % 10 WHEN 1 THEN 'no_match' WHEN 2 THEN 'wrong_length' ELSE 'misformatted_result' END AS outcome,
    count(*) AS lines FROM lineitem WHERE l_partkey % 10 IN (1, 2, 3) GROUP BY outcome""",
)
def parse_errors(spark, sf):
    parsed = results.parse_lenient(lines.read_lines(spark, result_files(spark, sf), "*.txt"), VARIANTS)
    return results.parse_errors(parsed)


def result_table(spark, sf):
    """Results per order line with module and key parts, as the harness would hold them."""
    code = F.when(F.col("l_returnflag") == "A", "S").when(F.col("l_returnflag") == "R", "E").otherwise("T")

    def item(status, ms):
        return F.struct(status.alias("status"), ms.cast("bigint").alias("ms"), F.col("l_partkey").alias("hb"))

    def text(c):
        return F.struct(c.alias("text"), F.lit(None).cast("bigint").alias("number"))

    def number(c):
        return F.struct(F.lit(None).cast("string").alias("text"), c.cast("bigint").alias("number"))

    return t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("Lib.S"), F.col("l_suppkey").cast("string")).alias("module"),
        F.array(
            text(F.concat(F.lit("a.b\\"), F.col("l_orderkey").cast("string"))), number(F.col("l_linenumber")),
            number(F.col("l_partkey")),
        ).alias("key"),
        F.array(item(F.lit("S"), F.col("l_quantity")), item(code, F.col("l_quantity") + 1)).alias("results"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    )


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
CODE = "CASE l_returnflag WHEN 'A' THEN 'S' WHEN 'R' THEN 'E' ELSE 'T' END"
ESCAPED = "'a\\db\\\\' || l_orderkey || '.\\' || l_linenumber || '.\\' || l_partkey || '.'"


@query(
    "gathered_lines",
    f"""SELECT idx, idx || ' #[S ' || CAST(l_quantity AS BIGINT) || ' ' || l_partkey || ', ' || {CODE} || ' '
      || CAST(l_quantity + 1 AS BIGINT) || ' ' || l_partkey || '] ' || {ESCAPED} AS value
    FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS idx FROM lineitem)
    UNION ALL VALUES (-4, 'Total elapsed time: Not applicable'), (-3, ''), (-2, 'Summary:'), (-1, '')""",
)
def gathered_lines(spark, sf):
    return results.gather_lines(result_table(spark, sf), ORDER)


@query(
    "strict_results",
    f"""SELECT 'Lib.S' || l_suppkey AS module, 'a.b\\' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS unit,
    CAST(l_quantity AS BIGINT) AS first_ms, {CODE} AS second_status, l_partkey AS hb FROM lineitem""",
)
def strict_results(spark, sf):
    path = results.written_modules(result_table(spark, sf), ORDER)
    rows = results.read_strict(spark, path, glob="*.txt")
    return rows.select(
        keys.module_of_folder(F.col("path")).alias("module"),
        keys.readable_key(F.col("key")).alias("unit"),
        F.col("results")[0]["ms"].alias("first_ms"),
        F.col("results")[1]["status"].alias("second_status"),
        F.col("results")[1]["hb"].alias("hb"),
    )


@query(
    "flattened_results",
    f"""SELECT 'a.b\\' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS unit, 0 AS place, 'S' AS status,
      CAST(l_quantity AS BIGINT) AS ms FROM lineitem
    UNION ALL SELECT 'a.b\\' || l_orderkey || '.' || l_linenumber || '.' || l_partkey, 1, {CODE},
      CAST(l_quantity + 1 AS BIGINT) FROM lineitem""",
)
def flattened_results(spark, sf):
    rows = result_table(spark, sf).select(
        keys.readable_key(F.col("key")).alias("unit"), F.posexplode("results").alias("place", "r")
    )
    return rows.select("unit", "place", "r.status", "r.ms")


@query(
    "status_codes",
    """SELECT CASE l_returnflag WHEN 'N' THEN 'nonProp' WHEN 'A' THEN 'success' ELSE 'other' END AS status_class,
    CASE l_returnflag WHEN 'N' THEN 'N' WHEN 'A' THEN 'S' END AS status, count(*) AS n FROM lineitem GROUP BY l_returnflag""",
)
def status_codes(spark, sf):
    flag = F.col("l_returnflag")
    named = F.when(flag == "N", "nonProp").when(flag == "A", "success").otherwise("other")
    rows = t.table(spark, sf, "lineitem").groupBy(named.alias("status_class")).agg(F.count("*").alias("n"))
    return schemas.encode_status(rows)


@query(
    "status_classes",
    """SELECT l_returnflag AS status, CASE l_returnflag WHEN 'N' THEN 'nonProp' END AS status_class, count(*) AS n
    FROM lineitem GROUP BY l_returnflag""",
)
def status_classes(spark, sf):
    rows = t.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("status")).agg(F.count("*").alias("n"))
    return schemas.decode_status(rows)


# Kinds of parts stand for the seven codes and one unknown.
CODES = list(schemas.STATUS)
CODE_SQL = "CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " ELSE '?' END"
CLASS_SQL = "CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{schemas.STATUS[c]}'" for i, c in enumerate(CODES)) + " END"


def coded(spark, sf):
    codes = F.array(*[F.lit(c) for c in [*CODES, "?"]])
    return t.table(spark, sf, "lineitem").select(F.get(codes, (F.col("l_partkey") % 8).cast("int")).alias("status"))


@query(
    "status_all_codes",
    f"""SELECT status, status_class, CASE WHEN status_class IS NULL THEN NULL ELSE status END AS back, status = 'S' AS ok, count(*) AS n
    FROM (SELECT {CODE_SQL} AS status, {CLASS_SQL} AS status_class FROM lineitem) GROUP BY ALL""",
)
def status_all_codes(spark, sf):
    known = schemas.decode_status(coded(spark, sf))
    both = schemas.encode_status(known, into="back").withColumn("ok", schemas.is_success(F.col("status")))
    return both.groupBy("status", "status_class", "back", "ok").agg(F.count("*").alias("n"))


@query(
    "status_success",
    "SELECT l_returnflag, l_linestatus, l_returnflag = 'S' AS ok, count(*) AS n FROM lineitem GROUP BY ALL",
)
def status_success(spark, sf):
    rows = t.table(spark, sf, "lineitem").withColumn("ok", schemas.is_success(F.col("l_returnflag")))
    return rows.groupBy("l_returnflag", "l_linestatus", "ok").agg(F.count("*").alias("n"))


def result_tree(spark, sf):
    """Nested result files of the suppliers: some without results, some empty, some absent."""
    planned = t.table(spark, sf, "supplier").select(
        F.concat(F.lit("Lib.S"), F.col("s_suppkey").cast("string")).alias("module"), F.col("s_suppkey") % 10
    ).toDF("module", "kind")
    rows = result_table(spark, sf)
    rows = rows.filter(F.col("l_suppkey") % 10 < 7)
    root = fresh_path(spark, "tree")
    results.write_tree(rows, ORDER, planned.filter("kind < 8"), root, empty=planned.filter("kind = 8"))
    return root, planned


@query(
    "tree_results",
    f"""SELECT 'Lib.S' || l_suppkey AS module, 'a.b\\' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS unit,
    CAST(l_quantity AS BIGINT) AS first_ms, {CODE} AS second_status FROM lineitem WHERE l_suppkey % 10 < 7""",
)
def tree_results(spark, sf):
    root, _ = result_tree(spark, sf)
    rows = results.read_tree(spark, root)
    first, second = F.col("results")[0], F.col("results")[1]
    unit = keys.readable_key(F.col("key")).alias("unit")
    return rows.select("module", unit, first["ms"].alias("first_ms"), second["status"].alias("second_status"))


@query(
    "not_returning",
    """SELECT 'Lib.S' || s_suppkey AS module, CASE s_suppkey % 10 WHEN 8 THEN 'empty' ELSE 'no_file' END AS state
    FROM supplier WHERE s_suppkey % 10 >= 8""",
)
def not_returning(spark, sf):
    root, planned = result_tree(spark, sf)
    return results.not_returning(spark, root, planned)


@query(
    "gathered_tree",
    f"""SELECT 'a.b\\' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS unit, CAST(l_quantity AS BIGINT) AS first_ms
    FROM lineitem WHERE l_suppkey % 10 < 7
    UNION ALL SELECT 'Lib.S' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 10 = 8""",
)
def gathered_tree(spark, sf):
    root, planned = result_tree(spark, sf)
    path = fresh_path(spark, "end")
    results.gather_tree(spark, root, planned, path)
    rows = results.read_strict(spark, f"{path}/gathered", glob="*.txt")
    found = rows.select(keys.readable_key(F.col("key")).alias("unit"), F.col("results")[0]["ms"].alias("first_ms"))
    silent = spark.read.text(f"{path}/not_returning")
    return found.unionByName(silent.select(F.col("value").alias("unit"), F.lit(None).cast("bigint").alias("first_ms")))


@query(
    "gathered_round_trip",
    f"""SELECT 'a.b\\' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS unit,
    CAST(l_quantity AS BIGINT) AS first_ms, {CODE} AS second_status FROM lineitem""",
)
def gathered_round_trip(spark, sf):
    path = fresh_path(spark, "gathered")
    results.write_gathered(results.gather_lines(result_table(spark, sf), ORDER), path)
    rows = results.read_strict(spark, path, glob="*.txt")
    first, second = F.col("results")[0], F.col("results")[1]
    unit = keys.readable_key(F.col("key")).alias("unit")
    return rows.select(unit, first["ms"].alias("first_ms"), second["status"].alias("second_status"))


@query(
    "strict_violations",
    """SELECT CASE l_partkey % 10 WHEN 0 THEN 'garbage ' || l_orderkey ELSE l_orderkey || ' #[S 1] a.' END AS value
    FROM lineitem WHERE l_partkey % 10 < 2""",
)
def strict_violations(spark, sf):
    order = F.col("l_orderkey").cast("string")
    value = (
        F.when(F.col("l_partkey") % 10 == 0, F.concat(F.lit("garbage "), order))
        .when(F.col("l_partkey") % 10 == 1, F.concat(order, F.lit(" #[S 1] a.")))
        .otherwise(F.concat(order, F.lit(" #[S 1 2, E 3 4] a.")))
    )
    path = fresh_path(spark, "odd")
    results.write_gathered(t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("idx"), value.alias("value")), path)
    return results.strict_violations(spark, path, glob="*.txt").select("value")


@query(
    "escaped_keys",
    """SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '.', '\\d'), chr(10), '\\n') || '.' AS escaped,
    true AS same FROM documents""",
)
def escaped_keys(spark, sf):
    part = F.struct(F.col("text").alias("text"), F.lit(None).cast("bigint").alias("number"))
    rows = t.table(spark, sf, "documents").select("doc_id", "text", keys.escape_key(F.array(part)).alias("escaped"))
    back = keys.parse_key(F.col("escaped"))
    return rows.select("doc_id", "escaped", (back[0]["text"] == F.col("text")).alias("same"))


@query(
    "module_paths",
    """SELECT page_id, list_transform(range(1, len(p) + 1), lambda i: '/' || array_to_string(p[1:i], '/')) AS paths,
    list_bool_and(list_transform(p, lambda x: regexp_full_match(x, '[A-Za-z0-9_'']+'))) AS file_safe, p[1] AS package
    FROM (SELECT page_id, string_split(url, '.') AS p FROM pages)""",
)
def module_paths(spark, sf):
    return t.table(spark, sf, "pages").select(
        "page_id",
        keys.path_prefixes(F.col("url")).alias("paths"),
        keys.file_safe(F.col("url")).alias("file_safe"),
        keys.first_part(F.col("url")).alias("package"),
    )


def name_lists(spark, sf):
    parts = keys.text_parts(F.col("url"))
    docs = t.table(spark, sf, "pages").select(F.concat(F.lit("m"), (F.col("page_id") % 7).cast("string")).alias("module"), parts.alias("key"))
    path = fresh_path(spark, "names")
    runlog.save_names(docs, path)
    return path


@query("name_lists", "SELECT 'm' || (page_id % 7) AS module, url AS unit FROM pages")
def name_lists_query(spark, sf):
    loaded = runlog.load_names(spark, name_lists(spark, sf))
    return loaded.select("module", keys.readable_key(F.col("key")).alias("unit"))


@query("unit_count", "SELECT CAST(count(*) AS VARCHAR) AS value FROM orders")
def unit_count(spark, sf):
    path = fresh_path(spark, "count")
    runlog.write_count(t.table(spark, sf, "orders"), path)
    return spark.read.text(path)


def log_events(spark, sf):
    """Sign-ups start and purchases end the work of a user on a day."""
    events = t.table(spark, sf, "events").filter(F.col("event_type").isin("signup", "purchase"))
    module = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(".D"), F.date_format("ts", "yyyyMMdd"))
    return events.select(
        module.alias("module"),
        F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("kind"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") % 3).cast("int").alias("code"),
    )


def log_files(spark, sf):
    path = fresh_path(spark, "log")
    runlog.append_log(log_events(spark, sf), path)
    return path


LOG = """log AS (SELECT 'U' || user_id || '.D' || strftime(ts, '%Y%m%d') AS module, event_type = 'purchase' AS ended,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id % 3 AS INTEGER) END AS code
  FROM events WHERE event_type IN ('signup', 'purchase'))"""


@query("log_started", f"WITH {LOG} SELECT module FROM log WHERE NOT ended")
def log_started(spark, sf):
    return runlog.started(runlog.read_log(spark, log_files(spark, sf)))


@query("log_ended", f"WITH {LOG} SELECT module, code FROM log WHERE ended")
def log_ended(spark, sf):
    return runlog.ended(runlog.read_log(spark, log_files(spark, sf)))


@query(
    "stream_progress",
    f"""WITH {LOG} SELECT module, bool_or(NOT ended) AS started, bool_or(ended) AS ended, max(code) AS code,
    NOT bool_or(ended) AS running FROM log GROUP BY module""",
)
def stream_progress(spark, sf):
    out = fresh_path(spark, "progress")
    progress.track(spark, log_files(spark, sf), out)
    return progress.current(spark, out)


APPENDED = """log AS (SELECT 'U' || user_id AS module, event_type = 'purchase' AS ended,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id % 3 AS INTEGER) END AS code, ts
  FROM events WHERE event_type IN ('signup', 'purchase'))"""


def timed_log(spark, sf):
    """Sign-ups start and purchases end the work of a user, with their time."""
    events = t.table(spark, sf, "events").filter(F.col("event_type").isin("signup", "purchase"))
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("module"),
        F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("kind"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") % 3).cast("int").alias("code"),
        F.col("ts").cast("timestamp").alias("at"),
    )


@query(
    "stream_appended_progress",
    f"""WITH {APPENDED} SELECT module, bool_or(NOT ended) AS started, bool_or(ended) AS ended, max(code) AS code,
    NOT bool_or(ended) AS running FROM log GROUP BY module""",
)
def stream_appended_progress(spark, sf):
    """Starts are taken in first, then the ends that came since."""
    log, out = fresh_path(spark, "log"), fresh_path(spark, "progress")
    rows = timed_log(spark, sf).select("module", "kind", "code")
    for kind in ("start", "end"):
        runlog.append_log(rows.filter(F.col("kind") == kind), log)
        progress.track(spark, log, out)
    return progress.current(spark, out)


LIMIT = 40 * 24 * 3600


@query(
    "stream_time_limits",
    f"""WITH {APPENDED}, l AS (SELECT module, ended, code, epoch_us(ts) // 1000 AS ms FROM log),
    m AS (SELECT module, min(ms) FILTER (NOT ended) AS started, min(ms) FILTER (ended) AS ended,
      arg_min(code, (ms, code)) FILTER (ended) AS code FROM l GROUP BY module),
    clock AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events)
    SELECT module, CASE WHEN ended IS NOT NULL AND (started IS NULL OR ended <= started + {LIMIT * 1000}) THEN 'ended'
      WHEN started + {LIMIT * 1000} <= now THEN 'timed out' ELSE 'running' END AS state, started, ended, code FROM m, clock""",
)
def stream_time_limits(spark, sf):
    """The log comes in three parts in the order of time; the last event of any kind is the clock."""
    log, out = fresh_path(spark, "timed"), fresh_path(spark, "limits")
    rows = timed_log(spark, sf)
    clock = t.table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("at"), F.min("ts").cast("timestamp").alias("low"))
    bounds = clock.select("low", "at").first()
    third = (bounds["at"] - bounds["low"]) / 3
    tick = clock.select(F.lit(None).cast("string").alias("module"), F.lit("clock").alias("kind"), F.lit(None).cast("int").alias("code"), "at")
    for i in range(3):
        part = rows.filter((F.col("at") >= bounds["low"] + i * third) & ((F.col("at") < bounds["low"] + (i + 1) * third) | F.lit(i == 2)))
        if i == 2:
            part = part.unionByName(tick)
        part.select(F.to_json(F.struct("module", "kind", "code", F.unix_micros("at").alias("us"))).alias("value")).write.mode("append").text(log)
        fields = F.from_json("value", "module string, kind string, code int, us long").alias("r")
        stream = tail.tail(spark, log).select(fields).select("r.module", "r.kind", "r.code", F.timestamp_micros("r.us").alias("at"))
        timeouts.track_limits(stream, out, LIMIT)
    found = timeouts.current_limits(spark, out)
    return found.select("module", "state", F.unix_millis("started").alias("started"), F.unix_millis("ended").alias("ended"), "code")


SMALL_STATS = "declaration string, total bigint, goalSolved boolean, props struct<k:int>"


def stats_files(spark, sf):
    """JSON lines per event type; some events give broken or blank lines."""
    events = t.table(spark, sf, "events")
    record = F.struct(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("declaration"),
        F.col("event_id").alias("total"),
        (F.col("value") > 20).alias("goalSolved"),
        F.from_json("props", "k int").alias("props"),
    )
    kind = F.col("user_id") % 17
    value = F.when(kind == 0, F.substring(F.to_json(record), 1, 25)).when(kind == 1, "").otherwise(F.to_json(record))
    path = fresh_path(spark, "jsonl")
    events.select(F.col("event_type").alias("variant"), value.alias("value")).write.partitionBy("variant").text(path)
    return path


STATS_ROWS = """SELECT event_type AS variant, 'u' || user_id AS declaration, event_id AS total, value > 20 AS "goalSolved",
    CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE user_id % 17 > 1"""


def parsed_stats(spark, sf):
    raw = spark.read.option("recursiveFileLookup", "true").text(stats_files(spark, sf))
    variant = keys.module_of_folder(F.col("_metadata.file_path"), "variant")
    return stats.parse_stats(raw.select("value", variant.alias("_v")), F.col("_v"), SMALL_STATS)


def flat(df):
    return df.select("variant", "declaration", "total", "goalSolved", F.col("props.k").alias("k"))


@query("json_stats", STATS_ROWS)
def json_stats(spark, sf):
    return flat(stats.good_rows(parsed_stats(spark, sf)))


@query(
    "json_totals",
    """SELECT count(*) FILTER (user_id % 17 > 1) AS rows, count(*) FILTER (user_id % 17 = 0) AS errors FROM events""",
)
def json_totals(spark, sf):
    return stats.load_totals(parsed_stats(spark, sf))


@query("named_stats", STATS_ROWS)
def named_stats(spark, sf):
    """The variant comes from the names of the files, one per type of event and group of users in nested folders."""
    rows = spark.read.option("recursiveFileLookup", "true").text(stats_files(spark, sf))
    variant = keys.module_of_folder(F.col("_metadata.file_path"), "variant")
    lines = rows.select(variant.alias("v"), "value").withColumn("part", F.pmod(F.hash("value"), F.lit(5)))
    file = F.concat(F.lit("Lib/P"), F.col("part").cast("string"), F.lit("/run.stats."), F.col("v"), F.lit(".jsonl"))
    root = fresh_path(spark, "named")
    files.write_named(lines.select(file.alias("file"), F.lit(0).alias("seq"), "value"), root)
    return flat(stats.good_rows(stats.read_stats(spark, root, schema=SMALL_STATS)))


@query("stream_ingest", STATS_ROWS)
def stream_ingest_query(spark, sf):
    out = fresh_path(spark, "ingested")
    variant = keys.module_of_folder(F.col("_metadata.file_path"), "variant")
    stream = stream_ingest.stats_stream(spark, stats_files(spark, sf), schema=SMALL_STATS, variant=variant)
    stream_ingest.append_new(stream, out)
    return flat(stats.good_rows(spark.read.parquet(out)))


@query(
    "union_by_name",
    """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS brand FROM customer
    UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part""",
)
def union_by_name(spark, sf):
    customers = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    parts = t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")
    )
    return stats.union_tables([customers, parts])


@query("parquet_round_trip", "SELECT event_type, count(*) AS n, max(value) AS high FROM events GROUP BY event_type")
def parquet_round_trip(spark, sf):
    path = fresh_path(spark, "table")
    stats.write_table(t.table(spark, sf, "events"), path, by=["event_type"])
    view = "events_" + path.rsplit("-", 1)[1]
    stats.read_table(spark, path, view=view)
    return spark.sql(f"SELECT event_type, count(*) AS n, max(value) AS high FROM {view} GROUP BY event_type")


RUN_NS = """bench AS (SELECT event_type, user_id % 2 AS algo, (user_id // 2) % 2 AS big, CAST(extract(hour FROM ts) AS BIGINT) AS x,
    CAST(round(value * 1e6) AS BIGINT) AS ns FROM events),
means AS (SELECT event_type, big, algo, x, (CAST(sum(ns) AS BIGINT) // count(*)) / 1e6 AS y FROM bench GROUP BY ALL)"""


def bench_series(spark, sf):
    events = t.table(spark, sf, "events").select(
        F.col("event_type").alias("figure"),
        F.when(F.col("user_id") % 2 == 0, "naive").otherwise("inc").alias("variant"),
        (F.when(F.floor(F.col("user_id") / 2) % 2 == 0, 0).otherwise(100)).alias("size"),
        F.hour("ts").cast("bigint").alias("x"),
        F.round(F.col("value") * 1e6).cast("bigint").alias("ns"),
    )
    return console.mean_series(events, ["figure", "size", "variant"])


NAMED = "CASE big WHEN 0 THEN 0 ELSE 100 END AS size, CASE algo WHEN 0 THEN 'naive' ELSE 'inc' END AS variant"


@query("bench_means", f"WITH {RUN_NS} SELECT event_type AS figure, {NAMED}, x, round(y, 6) AS y_ms FROM means")
def bench_means(spark, sf):
    return rounded(bench_series(spark, sf))


SERIES = f"""{RUN_NS}, series AS (SELECT event_type AS figure, {NAMED},
    string_agg('(' || x || ', ' || printf('%.6f', y) || ')', ' ' ORDER BY x) AS text FROM means GROUP BY ALL)"""


@query("series_text", f"WITH {SERIES} SELECT figure, size, variant, CAST(0 AS BIGINT) AS line, text FROM series")
def series_text(spark, sf):
    return console.series_text(bench_series(spark, sf), ["figure", "size", "variant"])


@query(
    "numbers_text",
    f"""WITH {SERIES} SELECT DISTINCT figure || ' Benchmark' AS value FROM series
    UNION ALL SELECT CASE variant WHEN 'naive' THEN 'Naive' ELSE 'Inc' END || ' - ' || size FROM series
    UNION ALL SELECT text FROM series""",
)
def numbers_text(spark, sf):
    series = console.series_text(bench_series(spark, sf), ["figure", "size", "variant"])
    label = F.format_string("%s - %d", F.initcap("variant"), F.col("size"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    out = report.figure_lines(series.withColumn("label", label), {k: f"{k} Benchmark" for k in kinds})
    path = fresh_path(spark, "numbers")
    report.write_figures(out, path)
    return spark.read.text(path)


def console_lines(spark, sf):
    """A console log per event type, as lines with their place."""
    series = console.series_text(bench_series(spark, sf), ["figure", "size", "variant"])
    order = F.col("size") * 10 + F.when(F.col("variant") == "naive", 1).otherwise(5)

    def at(place, text):
        return F.struct((order + place).cast("bigint").alias("seq"), text.alias("value"))

    title = F.format_string("%s (term size %d)", "figure", "size")
    mode = F.concat(F.lit("StatefulForward: "), F.when(F.col("variant") == "naive", "false").otherwise("true"))
    texts = F.array(
        at(0, F.when(F.col("variant") == "naive", title).otherwise(F.lit("building"))), at(1, mode), at(2, F.col("text"))
    )
    return series.select(F.col("figure").alias("path"), F.lit(0).alias("block"), F.explode(texts).alias("l")).select(
        "path", "block", "l.*"
    )


@query(
    "series_round_trip",
    """SELECT CASE l_linestatus WHEN 'O' THEN 'naive' ELSE 'inc' END AS variant, l_orderkey * 8 + l_linenumber AS x,
    round(l_extendedprice, 2) AS y_ms FROM lineitem""",
)
def series_round_trip(spark, sf):
    variant = F.when(F.col("l_linestatus") == "O", "naive").otherwise("inc")
    series = t.table(spark, sf, "lineitem").select(
        variant.alias("variant"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("x"), F.col("l_extendedprice").alias("y_ms")
    )
    texts = console.series_text(series, ["variant"])
    mode = F.concat(F.lit("StatefulForward: "), F.when(F.col("variant") == "naive", "false").otherwise("true"))
    place = F.when(F.col("variant") == "naive", 0).otherwise(10**9) + F.col("line") + 1
    found = texts.select(place.cast("bigint").alias("seq"), F.col("text").alias("value"))
    heads = texts.filter("line = 0").select((place - 1).cast("bigint").alias("seq"), mode.alias("value"))
    lines = found.unionByName(heads).select(F.lit("log").alias("path"), F.lit(0).alias("block"), "seq", "value")
    return console.parse_console(lines).select("variant", "x", F.round("y_ms", 2).alias("y_ms"))


@query("console_points", f"WITH {RUN_NS} SELECT event_type AS path, {NAMED}, x, round(y, 6) AS y_ms FROM means")
def console_points(spark, sf):
    return console.parse_console(console_lines(spark, sf))


@query(
    "console_state",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN props END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS state FROM events""",
)
def console_state(spark, sf):
    from runlens.operators.ordered import fill_forward

    rows = t.table(spark, sf, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("props")).alias("state")
    )
    return fill_forward(rows, ["user_id"], ["event_id"], ["state"], limit=50)


def outlier_rows(spark, sf):
    pairs = compare.slowdowns(cohort_pairs(spark, sf), 1.5, 20000.0)
    return pairs.select(
        F.col("new_payload").cast("string").alias("file"),
        "unit",
        F.col("new_run").cast("string").alias("syntax"),
        (F.col("old_value") / 1e3).alias("old_ms"),
        (F.col("new_value") / 1e3).alias("new_ms"),
        "slowdown",
    )


@query(
    "outlier_records",
    f"""WITH {t.COHORT}, p AS (SELECT o.unit, o.value AS a, n.value AS b, n.payload, n.run FROM stats o JOIN stats n ON o.unit = n.unit
      WHERE o.variant = 'A' AND n.variant = 'R' AND o.unit IN (SELECT unit FROM cohort) AND n.value > o.value * 1.5 AND n.value >= 20000)
    SELECT line FROM (SELECT unnest(['file:     ' || payload, 'name:     ' || unit, 'syntax:   ' || run,
      'old_time: ' || printf('%.2f', a / 1e3) || ' ms', 'new_time: ' || printf('%.2f', b / 1e3) || ' ms',
      'slowdown: ' || printf('%.2f', b / a) || 'x', '']) AS line FROM p)""",
)
def outlier_records(spark, sf):
    path = fresh_path(spark, "outliers")
    report.write_outliers(outlier_rows(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "problem_log",
    """SELECT CAST(l_linenumber AS INTEGER) AS variant_index, 'O' || l_orderkey AS unit, l_returnflag AS status,
    CAST(l_quantity AS BIGINT) AS ms, l_partkey AS hb, true AS stamped FROM lineitem""",
)
def problem_log(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("variant_index"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("unit"),
        F.col("l_linestatus").alias("text"),
        F.col("l_returnflag").alias("status"),
        F.col("l_quantity").cast("bigint").alias("ms"),
        F.col("l_partkey").alias("hb"),
    )
    path = fresh_path(spark, "problems")
    runlog.append_problems(rows, path)
    saved = spark.read.parquet(path)
    return saved.select("variant_index", "unit", "status", "ms", "hb", F.col("started").isNotNull().alias("stamped"))
