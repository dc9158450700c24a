"""Rule, catalogue and sampling queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import registry
from runlens.operators import catalog, fixpoint, sampling

QUERIES, SQL, query = registry()


def turn_edges(spark, sf):
    """Each turn of a conversation leads to the next one."""
    return t.table(spark, sf, "conversations").filter(F.col("turn") > 0).select(
        "conv_id", (F.col("turn") - 1).alias("src"), F.col("turn").alias("dst")
    )


REACH = """WITH RECURSIVE e AS (SELECT conv_id, turn - 1 AS src, turn AS dst FROM conversations WHERE turn > 0),
r AS (SELECT conv_id, src, dst FROM e UNION SELECT r.conv_id, r.src, e.dst FROM r JOIN e ON r.conv_id = e.conv_id AND r.dst = e.src)
"""


@query("closure_incremental", REACH + "SELECT conv_id, src, dst FROM r")
def closure_incremental(spark, sf):
    return fixpoint.closure(turn_edges(spark, sf), ["conv_id"]).drop("round")


@query("closure_naive", REACH + "SELECT conv_id, src, dst FROM r")
def closure_naive(spark, sf):
    return fixpoint.closure_naive(turn_edges(spark, sf), ["conv_id"])


def event_chains(spark, sf):
    """Each user's events in order, as a chain with a step from one to the next."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    places = t.table(spark, sf, "events").select("user_id", F.row_number().over(order).cast("long").alias("dst"))
    return places.filter("dst > 1").select("user_id", (F.col("dst") - 1).alias("src"), "dst")


DEEP = """WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events)
SELECT a.user_id, a.place AS src, b.place AS dst FROM n a JOIN n b ON a.user_id = b.user_id AND a.place < b.place"""


@query("deep_closure_incremental", DEEP)
def deep_closure_incremental(spark, sf):
    return fixpoint.closure(event_chains(spark, sf), ["user_id"]).drop("round")


@query("deep_closure_naive", DEEP)
def deep_closure_naive(spark, sf):
    return fixpoint.closure_naive(event_chains(spark, sf), ["user_id"])


@query("closure_bounded", REACH + "SELECT conv_id, src, dst FROM r WHERE dst - src <= 4")
def closure_bounded(spark, sf):
    return fixpoint.closure(turn_edges(spark, sf), ["conv_id"], max_rounds=2).drop("round")


@query(
    "one_rule_step",
    """SELECT DISTINCT a.conv_id, a.turn - 1 AS src, b.turn AS dst FROM conversations a
    JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn > 0""",
)
def one_rule_step(spark, sf):
    edges = turn_edges(spark, sf)
    return fixpoint.closure(edges, ["conv_id"], max_rounds=1).filter(F.col("round") == 1).drop("round")


@query(
    "derived_facts",
    """SELECT conv_id, max(turn) AS given, max(turn) * (max(turn) - 1) // 2 AS derived FROM conversations
    GROUP BY conv_id HAVING max(turn) > 0""",
)
def derived_facts(spark, sf):
    return fixpoint.derived_counts(fixpoint.closure(turn_edges(spark, sf), ["conv_id"]), ["conv_id"])


@query(
    "hub_closure",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || l_suppkey AS src, l_returnflag AS dst FROM lineitem
      UNION SELECT DISTINCT l_returnflag, 'p' || l_linenumber FROM lineitem),
    r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r""",
)
def hub_closure(spark, sf):
    line = t.table(spark, sf, "lineitem")
    into = line.select(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("src"), F.col("l_returnflag").alias("dst"))
    out = line.select(F.col("l_returnflag").alias("src"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("dst"))
    return fixpoint.closure(into.unionByName(out), limit=20).drop("round")


SLOTS = ["click", "error", "purchase", "signup", "view"]
DEPTH = """SELECT user_id, CAST(ts AS DATE) AS day,
    bool_or(event_type = 'click') AS s0, bool_or(event_type = 'error') AS s1, bool_or(event_type = 'purchase') AS s2,
    bool_or(event_type = 'signup') AS s3, bool_or(event_type = 'view') AS s4 FROM events GROUP BY ALL"""


def event_facts(spark, sf):
    return t.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("predicate"))


@query(
    "match_depth",
    f"""SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(CASE WHEN NOT s4 THEN 0 WHEN NOT s3 THEN 1 WHEN NOT s2 THEN 2
    WHEN NOT s1 THEN 3 WHEN NOT s0 THEN 4 ELSE 5 END AS INTEGER) AS depth, s0 AND s1 AND s2 AND s3 AND s4 AS matched FROM ({DEPTH})""",
)
def match_depth(spark, sf):
    out = fixpoint.match_depth(event_facts(spark, sf), ["user_id", "day"], SLOTS)
    return out.withColumn("day", F.col("day").cast("string"))


@query("full_matches", f"SELECT user_id, CAST(day AS VARCHAR) AS day FROM ({DEPTH}) WHERE s0 AND s1 AND s2 AND s3 AND s4")
def full_matches(spark, sf):
    out = fixpoint.match_depth(event_facts(spark, sf), ["user_id", "day"], SLOTS).filter(F.col("matched"))
    return out.select("user_id", F.col("day").cast("string").alias("day"))


@query(
    "chain_workload",
    """WITH s AS (SELECT o_custkey AS chain, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT chain, 100 + i AS src, 100 + i + 1 AS dst FROM (SELECT chain, unnest(range(n)) AS i FROM s)""",
)
def chain_workload(spark, sf):
    specs = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("chain")).agg(F.count("*").alias("n"))
    return fixpoint.chain_facts(specs.withColumn("start", F.lit(100).cast("bigint")), ["chain"], chunk=4)


@query(
    "depth_workload",
    """SELECT c_custkey AS "case", CAST(1 + c_custkey % 6 AS INTEGER) AS depth, c_custkey % 6 = 5 AS matched FROM customer""",
)
def depth_workload(spark, sf):
    specs = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("case"),
        F.lit(6).alias("premises"),
        (F.col("c_custkey") % 3).cast("int").alias("inert"),
        (1 + F.col("c_custkey") % 6).cast("int").alias("depth"),
        F.lit(100).alias("a"),
    )
    facts = fixpoint.depth_facts(specs, ["case"])
    found = fixpoint.match_depth(facts, ["case", "n"], [f"P{i}" for i in range(6)])
    return found.filter(F.col("n") == 100).drop("n")


LOGIC, BOOLS, NATS = list("aeiotl"), list("bhnrswq"), list("dfcvpgmuj")


def doc_catalog(spark, sf):
    """Documents as units: the first letters of all words are the type's constants, all words the proof's."""
    docs = t.table(spark, sf, "documents")
    flags = t.table(spark, sf, "labels").withColumnRenamed("doc_id", "_doc")
    words = F.split(F.lower("text"), "[^a-z]+")
    head = F.transform(words, lambda w: F.substring(w, 1, 1))

    def clean(a):
        return F.array_distinct(F.filter(a, lambda w: w != ""))

    rows = docs.join(flags, docs["doc_id"] == flags["_doc"], "left")
    return rows.select(
        F.concat(F.lit("d"), docs["doc_id"].cast("string")).alias("name"),
        F.concat("lang", F.lit("."), "source").alias("module"),
        F.col("quality").isNotNull().alias("has_range"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("is_theorem"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_proj"),
        (F.col("n_chars") % 5 == 0).alias("is_private"),
        (F.col("n_chars") % 7 == 0).alias("is_type"),
        (F.col("n_chars") % 11 == 0).alias("is_instance"),
        (F.col("n_chars") % 3 == 0).alias("is_simp"),
        clean(head).alias("type_consts"),
        clean(words).alias("value_consts"),
    )


CATALOG = """catalog AS (
  SELECT 'd' || d.doc_id AS name, lang || '.' || source AS module, quality IS NOT NULL AS has_range,
    coalesce(quality, 0) = 1 AS is_theorem, coalesce(toxic, 0) = 1 AS is_proj, n_chars % 5 = 0 AS is_private,
    n_chars % 7 = 0 AS is_type, n_chars % 11 = 0 AS is_instance, n_chars % 3 = 0 AS is_simp,
    list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w != ''), lambda w: w[1])) AS type_consts,
    list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w != '')) AS value_consts
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("human_units", f"WITH {CATALOG} SELECT name, module FROM catalog WHERE has_range AND is_theorem AND NOT is_proj")
def human_units(spark, sf):
    return catalog.human_units(doc_catalog(spark, sf)).select("name", "module")


@query("package_units", f"WITH {CATALOG} SELECT name FROM catalog WHERE string_split(module, '.')[1] = 'en'")
def package_units(spark, sf):
    return catalog.from_package(doc_catalog(spark, sf), "en").select("name")


@query(
    "filtered_modules",
    f"""WITH {CATALOG} SELECT name, module FROM catalog WHERE module LIKE 'en.%' OR module IN (SELECT module FROM catalog WHERE is_proj)""",
)
def filtered_modules(spark, sf):
    units = doc_catalog(spark, sf)
    english = catalog.module_filter(units, F.col("module").like("en.%"))
    rest = catalog.module_filter(units, ~F.col("module").like("en.%"))
    others = catalog.module_filter(rest, units.filter(F.col("is_proj")).select("module"))
    return english.select("name", "module").unionByName(others.select("name", "module"))


def sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


for _name, _simp in [("relevant_units", False), ("relevant_units_simp", True)]:

    @query(
        _name,
        f"""WITH {CATALOG} SELECT name FROM catalog WHERE NOT is_private AND NOT is_type AND NOT is_instance
        AND NOT list_has_all({sql_list(LOGIC)}, type_consts) {"" if _simp else "AND NOT is_simp"}""",
    )
    def _relevant(spark, sf, simp=_simp):
        return doc_catalog(spark, sf).filter(catalog.relevant(simp, LOGIC)).select("name")


@query(
    "unsafe_names",
    "SELECT url AS module FROM pages WHERE NOT regexp_full_match(url, '[A-Za-z0-9_''.]+') OR contains(url, '..')",
)
def unsafe_names(spark, sf):
    return catalog.unsafe_names(t.table(spark, sf, "pages").select(F.col("url").alias("module")))


@query(
    "tiers",
    f"""WITH {CATALOG}, x AS (SELECT name, CASE WHEN list_has_all({sql_list(LOGIC)}, type_consts) THEN 'logic'
      WHEN list_has_all({sql_list(LOGIC + BOOLS)}, type_consts) THEN 'bool'
      WHEN list_has_all({sql_list(LOGIC + BOOLS + NATS)}, type_consts) THEN 'nat' END AS tier
      FROM catalog WHERE has_range AND is_theorem AND NOT is_proj)
    SELECT name, tier FROM x WHERE tier IS NOT NULL""",
)
def tiers(spark, sf):
    out = catalog.with_tiers(doc_catalog(spark, sf), logic=LOGIC, bools=BOOLS, nats=NATS)
    return out.select("name", "tier")


@query(
    "only_uses_set",
    f"WITH {CATALOG} SELECT name, list_has_all({sql_list(LOGIC + BOOLS)}, type_consts) AS within FROM catalog",
)
def only_uses_set(spark, sf):
    return doc_catalog(spark, sf).select(
        "name", catalog.only_uses(F.col("type_consts"), LOGIC + BOOLS).alias("within")
    )


@query(
    "module_tally",
    f"""WITH {CATALOG} SELECT module, CAST(0 AS BIGINT) AS chunk, count(*) AS units, list(name ORDER BY name) AS names
    FROM catalog WHERE has_range AND is_theorem AND NOT is_proj GROUP BY module""",
)
def module_tally(spark, sf):
    units = doc_catalog(spark, sf)
    return catalog.tally_by_module(catalog.human_units(units).select("name"), units)


@query(
    "owning_modules",
    f"""WITH {CATALOG}, n AS (SELECT DISTINCT 'd' || doc_id AS name FROM labels UNION SELECT 'd' || item_id || 'x' FROM benchmark)
    SELECT n.name, module FROM n LEFT JOIN catalog USING (name)""",
)
def owning_modules(spark, sf):
    names = t.table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")).distinct()
    other = t.table(spark, sf, "benchmark").select(F.concat(F.lit("d"), F.col("item_id").cast("string"), F.lit("x")).alias("name"))
    return catalog.with_module(names.unionByName(other), doc_catalog(spark, sf))


@query("import_set", f"WITH {CATALOG} SELECT DISTINCT module FROM catalog JOIN labels ON name = 'd' || doc_id")
def import_set(spark, sf):
    names = t.table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    return catalog.imports_of(names, doc_catalog(spark, sf))


@query(
    "new_names",
    """SELECT DISTINCT o_custkey AS name FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'
    AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')""",
)
def new_names(spark, sf):
    orders = t.table(spark, sf, "orders").withColumnRenamed("o_custkey", "name")
    cut = F.lit("1999-01-01").cast("timestamp")
    before, after = orders.filter(F.col("o_orderdate") < cut), orders.filter(F.col("o_orderdate") >= cut)
    return catalog.new_names(before, after).select("name").distinct()


# Words as units: a word counts as a theorem when it has at least four letters in the benchmark texts.
def word_catalog(spark, sf):
    bench = t.table(spark, sf, "benchmark")
    words = bench.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name")).filter(F.col("name") != "").distinct()
    return words.withColumn("is_theorem", F.length("name") >= 4)


WORDS = "words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS name FROM benchmark)"


@query(
    "used_theorems",
    f"""WITH {CATALOG}, {WORDS}, u AS (SELECT name AS unit, unnest(value_consts) AS name FROM catalog)
    SELECT unit, name FROM u WHERE name IN (SELECT name FROM words WHERE length(name) >= 4)""",
)
def used_theorems(spark, sf):
    refs = doc_catalog(spark, sf).select("name", "value_consts", F.lit(False).alias("is_theorem"))
    words = word_catalog(spark, sf).withColumn("value_consts", F.array().cast("array<string>"))
    return catalog.used_theorems(refs.unionByName(words, allowMissingColumns=True), limit=200)


@query(
    "unknown_references",
    f"""WITH {CATALOG}, {WORDS}, u AS (SELECT DISTINCT name AS unit, unnest(list_concat(value_consts, type_consts)) AS name FROM catalog)
    SELECT unit, name FROM u WHERE name NOT IN (SELECT name FROM words WHERE name IS NOT NULL)""",
)
def unknown_references(spark, sf):
    return catalog.unknown_references(doc_catalog(spark, sf), word_catalog(spark, sf))


GRID_VARIANTS = ["old", "new"]


@query(
    "experiment_grid",
    """SELECT p_partkey AS unit, v.variant, CAST(r AS INTEGER) AS repetition FROM part,
    (VALUES ('old'), ('new')) v(variant), range(3) t(r)""",
)
def experiment_grid(spark, sf):
    units = t.table(spark, sf, "part").select(F.col("p_partkey").alias("unit"))
    return catalog.experiment_grid(units, GRID_VARIANTS, 3).drop("variant_index")


@query(
    "skipped_runs",
    """SELECT p_partkey AS unit, v.variant, CASE WHEN p_size = 7 THEN 'T' END AS status FROM part, (VALUES ('old'), ('new')) v(variant)""",
)
def skipped_runs(spark, sf):
    parts = t.table(spark, sf, "part")
    grid = catalog.experiment_grid(parts.select(F.col("p_partkey").alias("unit")), GRID_VARIANTS)
    skips = catalog.skip_list(parts.filter(F.col("p_size") == 7).select(F.col("p_partkey").alias("unit")), GRID_VARIANTS)
    return catalog.with_skips(grid, skips).select("unit", "variant", "status")


@query("first_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20")
def first_rows(spark, sf):
    return sampling.first_n(t.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 20)


@query("seeded_sample", "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || '#11'), c_custkey LIMIT 50")
def seeded_sample(spark, sf):
    return sampling.sample(t.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 50, seed=11)


@query("random_sample")
def random_sample(spark, sf):
    return sampling.sample(t.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 50)


@query(
    "random_sample_contract",
    """SELECT least(50, count(*)) AS rows, least(50, count(*)) AS different, least(50, count(*)) AS members FROM customer
    UNION ALL SELECT count(*), count(*), count(*) FROM nation""",
)
def random_sample_contract(spark, sf):
    """Size, distinctness and membership of draws whose seed nobody gave; a table smaller than the sample gives all its rows."""
    parts = []
    for name, key in (("customer", "c_custkey"), ("nation", "n_nationkey")):
        table = t.table(spark, sf, name).select(key)
        drawn = sampling.sample(table, key, 50)
        met = drawn.join(table.withColumn("known", F.lit(1)), key, "left")
        parts.append(met.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("different"), F.count("known").alias("members")))
    return parts[0].unionByName(parts[1])


@query(
    "sample_with_replacement",
    """WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer),
    d AS (SELECT draw, ('0x' || substr(md5(draw || '#11'), 1, 15))::BIGINT AS h FROM range(500) r(draw))
    SELECT draw, c_custkey FROM d JOIN k ON h % n = place""",
)
def sample_with_replacement(spark, sf):
    return sampling.sample_with_replacement(t.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 500, seed=11)
