"""Registered queries of the library's own operators, each over the given tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.functions import props as P
from loomstead.functions import text as X
from loomstead.operators import catalog as C
from loomstead.operators import match as M
from loomstead.operators import trace as R
from loomstead.operators import transfers as V
from loomstead.operators.protocols import TransformCatalog
from loomstead.operators.select import select
from loomstead.plans import derive as D
from loomstead.plans import goals as G
from loomstead.plans.rounds import checkpoint_root
from loomstead.plans.store import ClosureStore
from loomstead.sources import documents as S
from loomstead.sources import libraries as L
from loomstead.sources import logs
from loomstead.sources.commits import CommitLog
from loomstead.sources.index import StoredIndex
from loomstead.streaming import frames
from loomstead.streaming import logs as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{tag}-{uuid.uuid4().hex}"


def text(*columns: str) -> list:
    return [F.col(c).cast("string").alias(c) for c in columns]


# Document store ------------------------------------------------------------------------------------------


def customer_docs(spark, d):
    return S.doc_import(table(spark, d, "customer"), ["c_custkey"], ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def event_docs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("json"))


FOREIGN = {
    "customer": (["c_custkey"], {"customer_nation": ("c_nationkey", "nation")}),
    "nation": (["n_nationkey"], {"nation_region": ("n_regionkey", "region")}),
    "orders": (["o_orderkey"], {"order_customer": ("o_custkey", "customer")}),
    "supplier": (["s_suppkey"], {"supplier_nation": ("s_nationkey", "nation")}),
    "lineitem": (["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], {"line_order": ("l_orderkey", "orders"), "line_part": ("l_partkey", "part"), "line_supplier": ("l_suppkey", "supplier")}),
}


#: Indexes of one value a document: all of the given tables'.
SINGLE = {n for _, indexes in FOREIGN.values() for n in indexes}


def postings(spark, d, build=S.si_rows):
    """Postings of the foreign keys of all tables, with their table; traces make their hops distinct themselves."""
    out = None
    for name, (keys, indexes) in FOREIGN.items():
        one = build(table(spark, d, name), keys, {n: c for n, (c, _) in indexes.items()}).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def declared(spark, d) -> list[tuple[str, str, str, int]]:
    """Links as declared (table, index, target, number), checked against the tables' schemas; no data are read."""
    rows = []
    for name, (_, indexes) in FOREIGN.items():
        columns = table(spark, d, name).columns
        for index, (column, target) in indexes.items():
            if column not in columns or target not in ("part", *FOREIGN, "region"):
                raise ValueError(f"the link {index} has no column {column} or no table {target}")
            rows.append((name, index, target, len(rows)))
    return rows


def links(spark, d):
    """Declared links that have postings in the data."""
    rows = spark.createDataFrame(declared(spark, d), "table_name string, si_name string, target string, ord int")
    return rows.join(postings(spark, d).select("table_name", "si_name").distinct(), ["table_name", "si_name"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_nationkey', c_nationkey, 'c_mktsegment', c_mktsegment) AS VARCHAR) AS json FROM customer")
def doc_import(spark, d):
    return customer_docs(spark, d)


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name, c_nationkey, c_mktsegment FROM customer")
def doc_scan(spark, d):
    return S.doc_scan(customer_docs(spark, d), "c_name string, c_nationkey int, c_mktsegment string")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders")
def list_entries(spark, d):
    return S.list_entries(S.doc_import(table(spark, d, "orders"), ["o_orderkey"], ["o_custkey"]))


@query("SELECT event_id, CAST(json_object('event_id', event_id, 'event_type', event_type) AS VARCHAR) AS json FROM events")
def json_document(spark, d):
    return table(spark, d, "events").select("event_id", X.json_document("event_id", "event_type").alias("json"))


@query("SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def json_keys(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(X.json_keys(F.col("props"))).alias("key"))


@query("SELECT DISTINCT unnest(json_keys(props)) AS key, 'events' AS table_name FROM events")
def key_catalog(spark, d):
    return S.key_catalog(event_docs(spark, d), "events")


@query("SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) AS key WHERE EXISTS (SELECT 1 FROM customer)")
def keys_of_table(spark, d):
    both = S.key_catalog(event_docs(spark, d), "events").unionByName(S.key_catalog(customer_docs(spark, d), "customer"))
    return S.keys_of_table(both, "customer")


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events UNION SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) WHERE EXISTS (SELECT 1 FROM customer)")
def keys_union(spark, d):
    return S.keys_union(S.key_catalog(event_docs(spark, d), "events"), S.key_catalog(customer_docs(spark, d), "customer"))


LINE_KEY = "concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query(" UNION ".join(f"SELECT 'line_{n}' AS si_name, CAST({c} AS VARCHAR) AS si_key, {LINE_KEY} AS parent_key FROM lineitem" for n, c in (("order", "l_orderkey"), ("part", "l_partkey"), ("supplier", "l_suppkey"))))
def si_build(spark, d):
    keys, indexes = FOREIGN["lineitem"]
    return S.si_build(table(spark, d, "lineitem"), keys, {n: c for n, (c, _) in indexes.items()})


@query("SELECT unnest(['line_order', 'line_part', 'line_supplier']) AS si_name WHERE EXISTS (SELECT 1 FROM lineitem)")
def si_names(spark, d):
    return S.si_names(si_build(spark, d))


@query("SELECT doc_id, source || '_' || lang AS si_key FROM documents")
def si_value_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.index_value(F.array("source", "lang")).alias("si_key"))


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def select_columns(spark, d):
    return select(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_custkey"])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, d):
    return select(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], unique=True)


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def select_where(spark, d):
    return select(table(spark, d, "orders"), where="o_orderstatus = 'F' AND o_totalprice > 100000")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_pairs(spark, d):
    return select(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], unique=True)


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_nationkey', c_nationkey, 'c_mktsegment', c_mktsegment) AS VARCHAR) AS json FROM customer WHERE c_custkey = 7")
def get_entry(spark, d):
    return S.get_entry(customer_docs(spark, d), "7")


def part_index(spark, d):
    part = table(spark, d, "part")
    docs = S.doc_import(part, ["p_partkey"], ["p_partkey", "p_brand", "p_type"])
    return docs, S.si_build(part, ["p_partkey"], {"brand": "p_brand", "type": "p_type"})


PART_JSON = "SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(json_object('p_partkey', p_partkey, 'p_brand', p_brand, 'p_type', p_type) AS VARCHAR) AS json FROM part WHERE "


@query(PART_JSON + "p_brand = 'Brand#1'")
def si_lookup_exact(spark, d):
    return S.si_lookup(*part_index(spark, d), "Brand#1", "brand")


@query(PART_JSON + "p_brand ILIKE 'brand#1%'")
def si_lookup_wildcard(spark, d):
    return S.si_lookup(*part_index(spark, d), "brand#1*")


@query(PART_JSON + "p_brand ILIKE 'brand#1%' UNION ALL " + PART_JSON + "p_type ILIKE '%ass%'")
def si_lookup_trigram(spark, d):
    """Patterns over a stored index of brands and types: only trigrams of the patterns are read."""
    docs, si = part_index(spark, d)
    index = StoredIndex(spark, scratch(spark, "index")).write(si)
    return index.lookup(docs, "brand#1*", "brand").unionByName(index.lookup(docs, "*ass*"))


def tables_registry(spark, d):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    keys = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": FOREIGN["lineitem"][0], "events": ["event_id"]}
    return S.registry({n: ("stream" if n == "events" else "data", table(spark, d, n), keys[n]) for n in names})


def sizes(spark, d):
    """Rows of postings of each table."""
    return postings(spark, d, S.si_build).groupBy("table_name").agg(F.count("*").alias("n_postings"))


SIZES = "SELECT 'customer' AS name, count(*) AS n_postings FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer) UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) UNION ALL SELECT 'supplier', count(*) FROM (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier) UNION ALL SELECT 'lineitem', 3 * count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"


@query(f"SELECT 'data' AS type, CAST(sum(n_postings) AS BIGINT) AS n_postings FROM ({SIZES})")
def registry_types(spark, d):
    reg = tables_registry(spark, d)
    counted = reg.join(sizes(spark, d), F.col("name") == F.col("table_name")).groupBy("type").agg(F.sum("n_postings").alias("n_postings"))
    return S.registry_types(reg).join(counted, "type")


@query(f"SELECT name, 'data' AS type, n_postings FROM ({SIZES})")
def registry_tables(spark, d):
    return S.registry_tables(tables_registry(spark, d), "data").join(sizes(spark, d), F.col("name") == F.col("table_name")).select("name", "type", "n_postings")


@query("SELECT unnest(['customer', 'nation', 'orders', 'supplier', 'lineitem']) AS name")
def registry_has(spark, d):
    return S.registry_has(tables_registry(spark, d), postings(spark, d).select(F.col("table_name").alias("name")).distinct())


@query(f"SELECT name AS \"table\", count(*) AS n_fields, any_value(n_postings) AS n_postings FROM ({SIZES}) JOIN (SELECT table_name, column_name FROM information_schema.columns) ON name = table_name GROUP BY name")
def registry_fields(spark, d):
    fields = S.registry_fields(tables_registry(spark, d)).groupBy("table").agg(F.count("*").alias("n_fields"))
    return fields.join(sizes(spark, d), F.col("table") == F.col("table_name")).select("table", "n_fields", "n_postings")


@query("SELECT 'n_documents' AS key, CAST(count(*) AS VARCHAR) AS val FROM documents UNION ALL SELECT 'n_sources', CAST(count(DISTINCT source) AS VARCHAR) FROM documents")
def info_scan(spark, d):
    return S.info_table(table(spark, d, "documents").agg(F.count("*").alias("n_documents"), F.count_distinct("source").alias("n_sources")))


@query(
    "WITH b AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS st, o_custkey FROM orders UNION ALL SELECT o_orderkey, nullif(o_orderstatus, 'P'), o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), "
    "n AS (SELECT o_orderkey, count(*) AS n FROM b WHERE st IS NOT NULL GROUP BY 1), "
    "e AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F') "
    "SELECT o_orderkey, CASE WHEN st IS NULL THEN 'null' WHEN n > 1 THEN 'duplicate' ELSE 'exists' END AS reason FROM b LEFT JOIN n USING (o_orderkey) LEFT JOIN e USING (o_orderkey) WHERE st IS NULL OR n > 1 OR e.o_orderkey IS NOT NULL"
)
def checked_append(spark, d):
    orders = table(spark, d, "orders")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderstatus", T.StringType(), False), T.StructField("o_custkey", T.LongType(), True)])
    one = orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"), "o_custkey", "o_orderpriority")
    batch = one.unionByName(one.where("o_orderpriority = '1-URGENT'")).drop("o_orderpriority")
    _, rejected = S.checked_append(orders.where("o_orderstatus = 'F'"), batch, schema, ["o_orderkey"])
    return rejected.select("o_orderkey", "reason")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 3 END AS version, "
    "CAST(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS INTEGER) + CAST(o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AS INTEGER) AS n_refused FROM orders"
)
def append_commits(spark, d):
    """Two writers append to what both have read: urgent orders, then all of them."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    log = CommitLog(spark, scratch(spark, "commits"), T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_orderpriority", T.StringType())]), ["o_orderkey"])
    first, _ = log.append(orders.where("o_orderstatus = 'F'"))
    _, one = log.append(orders.where("o_orderpriority = '1-URGENT'"), at=first)
    _, two = log.append(orders, at=first)
    refused = one.unionByName(two).groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return log.history().join(refused, "o_orderkey", "left").select("o_orderkey", F.col("version").cast("int").alias("version"), F.coalesce("n", F.lit(0)).cast("int").alias("n_refused"))


# Traces ----------------------------------------------------------------------------------------------------


@query("SELECT source, target, si_name, forward FROM (VALUES ('customer','nation','customer_nation'),('nation','region','nation_region'),('orders','customer','order_customer'),('supplier','nation','supplier_nation'),('lineitem','orders','line_order'),('lineitem','part','line_part'),('lineitem','supplier','line_supplier')) t(a, b, si_name), LATERAL (SELECT a AS source, b AS target, true AS forward UNION ALL SELECT b, a, false)")
def link_graph(spark, d):
    return R.link_graph(links(spark, d))


@query("SELECT * FROM (VALUES (1, 'part', 'lineitem', 'line_part', false), (2, 'lineitem', 'supplier', 'line_supplier', true), (3, 'supplier', 'nation', 'supplier_nation', true), (4, 'nation', 'region', 'nation_region', true)) t(step, source, target, si_name, forward)")
def trace_path(spark, d):
    steps = R.trace_path(links(spark, d), "part", "region")
    return spark.createDataFrame([(k + 1, *s) for k, s in enumerate(steps)], "step int, source string, target string, si_name string, forward boolean")


@query("SELECT * FROM (VALUES (1, 'region -> nation', 'nation_region (reverse)'), (2, 'nation -> customer', 'customer_nation (reverse)')) t(step, edge, via)")
def trace_explain(spark, d):
    return R.trace_explain(links(spark, d), "region", "customer")


@query("SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS source, CAST(s_nationkey AS VARCHAR) AS target FROM supplier")
def trace_one_hop(spark, d):
    return R.trace_one_hop(postings(spark, d).where("table_name = 'supplier'"), "supplier_nation")


def traced(spark, d, source, target, via=None):
    path = R.trace_path(declared(spark, d), source, target, via)
    return postings(spark, d), path


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS source, CAST(n_regionkey AS VARCHAR) AS target FROM customer JOIN nation ON c_nationkey = n_nationkey")
def trace_multi_hop(spark, d):
    return R.trace_multi_hop(*traced(spark, d, "customer", "region"), SINGLE)


@query(f"SELECT DISTINCT {LINE_KEY} AS source, CAST(n_regionkey AS VARCHAR) AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def trace_four_hops(spark, d):
    return R.trace_multi_hop(*traced(spark, d, "lineitem", "region", ["orders", "customer", "nation"]), SINGLE)


@query("SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS k0, CAST(s_suppkey AS VARCHAR) AS k2, CAST(n_nationkey AS VARCHAR) AS k3, count(DISTINCT (l_orderkey, l_linenumber)) OVER (PARTITION BY p_partkey, s_suppkey) AS n_lines FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def trace_reduced(spark, d):
    """Lines between parts and the nations that supply them: a step back, reduced before the joins."""
    whole = R.trace_intermediates(*traced(spark, d, "part", "nation", ["lineitem", "supplier"]))
    return whole.groupBy("k0", "k2", "k3").agg(F.count("*").alias("n_lines"))


@query("SELECT DISTINCT CAST(r_regionkey AS VARCHAR) AS source, CAST(s_suppkey AS VARCHAR) AS target FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def trace_reverse(spark, d):
    return R.trace_multi_hop(*traced(spark, d, "region", "supplier"))


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS k0, CAST(c_custkey AS VARCHAR) AS k1, CAST(n_nationkey AS VARCHAR) AS k2, CAST(n_regionkey AS VARCHAR) AS k3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def trace_intermediates(spark, d):
    return R.trace_intermediates(*traced(spark, d, "orders", "region"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source, string_agg(DISTINCT CAST(o_custkey AS VARCHAR), ',' ORDER BY CAST(o_custkey AS VARCHAR)) AS targets FROM orders GROUP BY 1")
def trace_maps_forward(spark, d):
    there, _ = R.trace_maps(R.trace_multi_hop(*traced(spark, d, "orders", "customer")))
    return there.select("source", F.array_join("targets", ",").alias("targets"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS target, string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS sources FROM orders GROUP BY 1")
def trace_maps_reverse(spark, d):
    _, back = R.trace_maps(R.trace_multi_hop(*traced(spark, d, "orders", "customer")))
    return back.select("target", F.array_join("sources", ",").alias("sources"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT c.c_mktsegment AS source, lead_.c_mktsegment AS target FROM customer c JOIN customer lead_ ON lead_.c_custkey = c.c_custkey + 1), r AS (SELECT * FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source) SELECT source, target FROM r")
def type_reachability(spark, d):
    customer = table(spark, d, "customer")
    after = customer.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_mktsegment").alias("target"))
    return R.reachable(customer.select("c_custkey", F.col("c_mktsegment").alias("source")).join(after, "c_custkey").select("source", "target"))


# Properties and keys ------------------------------------------------------------------------------------------


def part_props(spark, d, *extra):
    part = table(spark, d, "part")
    pairs = F.create_map(F.lit("name"), F.split("p_name", " "), F.lit("brand"), F.array("p_brand"), F.lit("type"), F.array("p_type"))
    return part.select("p_partkey", *extra, P.props_encode(pairs).alias("props"))


PROPS = """list_sort(list_distinct(list_concat(list_transform(string_split(p_name, ' '), lambda w: '{"name":"' || w || '"}'), ['{"brand":"' || p_brand || '"}', '{"type":"' || p_type || '"}'])))"""


@query(f"SELECT p_partkey, array_to_string({PROPS}, '|') AS props FROM part")
def props_encode(spark, d):
    return part_props(spark, d).select("p_partkey", F.array_join("props", "|").alias("props"))


@query(f"SELECT p_partkey, array_to_string({PROPS}, '|') AS props FROM part")
def props_sorted(spark, d):
    return part_props(spark, d).select("p_partkey", F.array_join(P.props_sorted(F.reverse("props")), "|").alias("props"))


@query("SELECT p_partkey, 'name' AS k, unnest(list_distinct(string_split(p_name, ' '))) AS v FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")
def props_decode(spark, d):
    each = part_props(spark, d).select("p_partkey", F.explode("props").alias("p"))
    return each.select("p_partkey", P.prop_key(F.col("p")).alias("k"), P.prop_value(F.col("p")).alias("v"))


@query("SELECT p_partkey, 'brand=' || p_brand || ';name=' || array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') || ';type=' || p_type AS packed FROM part")
def props_pack(spark, d):
    packed = C.props_pack(part_props(spark, d), "p_partkey")
    return packed.select("p_partkey", F.array_join(F.transform(F.map_entries("packed"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("packed"))


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append({PROPS}, '{{"size":' || p_size || '}}'))), '|') AS props FROM part""")
def add_property(spark, d):
    return part_props(spark, d, "p_size").select("p_partkey", F.array_join(P.add_property(F.col("props"), F.lit("size"), F.col("p_size")), "|").alias("props"))


def _against(f):
    def run(spark, d):
        other = F.array(F.lit('{"brand":"Brand#1"}'), F.lit('{"name":"red"}'))
        return part_props(spark, d).select("p_partkey", F.array_join(f(F.col("props"), other), "|").alias("props"))

    return run


OTHER = """['{"brand":"Brand#1"}', '{"name":"red"}']"""
for _name, _f, _sql in (
    ("props_union", P.props_union, f"list_sort(list_distinct(list_concat({PROPS}, {OTHER})))"),
    ("props_intersect", P.props_intersect, f"list_sort(list_filter({PROPS}, lambda x: list_contains({OTHER}, x)))"),
    ("props_except", P.props_except, f"list_sort(list_filter({PROPS}, lambda x: NOT list_contains({OTHER}, x)))"),
):
    QUERIES[_name] = _against(_f)
    ORACLES[_name] = f"SELECT p_partkey, array_to_string({_sql}, '|') AS props FROM part"


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_transform(string_split(p_name, ' '), lambda w: '["' || w || '"]'), ['["' || p_brand || '"]']))), '|') AS props FROM part""")
def add_property_value(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", F.array_join(P.add_value(P.props_encode_list(F.split("p_name", " ")), F.col("p_brand")), "|").alias("props"))


@query(f"""SELECT p_partkey, list_has_all({PROPS}, ['{{"brand":"Brand#1"}}']) AS fits, true AS any_fits FROM part""")
def is_a(spark, d):
    need = F.array(F.lit('{"brand":"Brand#1"}'))
    return part_props(spark, d).select("p_partkey", P.is_a(F.col("props"), need).alias("fits"), P.is_a(F.col("props"), F.array().cast("array<string>")).alias("any_fits"))


def key_sql(expression: str, length: int) -> str:
    """The SQL of a content key."""
    size = 62**length
    number = f"list_reduce(list_transform(range(32), lambda i: CAST('0x' || substr(sha256({expression}), CAST(2 * i + 1 AS BIGINT), 2) AS HUGEINT)), lambda a, x: (a * 256 + x) % {size}, CAST(0 AS HUGEINT))"
    return f"array_to_string(list_transform(range({length - 1}, -1, -1), lambda k: substr('{P.DIGITS}', CAST(({number} // CAST(pow(62, k) AS HUGEINT)) % 62 + 1 AS BIGINT), 1)), '')"


@query(f"SELECT c_custkey, {key_sql('c_name', 8)} AS key8, {key_sql('c_name', 5)} AS key5 FROM customer")
def content_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", P.content_key(F.col("c_name"), 8).alias("key8"), P.content_key(F.col("c_name"), 5).alias("key5"))


@query("SELECT p_partkey, array_to_string(list_sort([p_brand, p_type]), ',') || ':[' || array_to_string(list_sort(string_split(p_name, ' ')), ',') || ']' AS signature FROM part")
def signature(spark, d):
    return table(spark, d, "part").select("p_partkey", P.signature(F.array("p_brand", "p_type"), F.split("p_name", " ")).alias("signature"))


@query("SELECT doc_id, " + key_sql("concat_ws('|', doc_id, lang, source, 'docs')", 8) + " AS instance FROM documents")
def instance_key(spark, d):
    return table(spark, d, "documents").select("doc_id", P.instance_key(F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.lit("docs")).alias("instance"))


# Catalogs ------------------------------------------------------------------------------------------------------


def manifest(spark, d):
    return table(spark, d, "documents").select(F.lit("docs").alias("lib"), F.col("doc_id").cast("string").alias("path"), F.concat_ws("::", "lang", "source").alias("dtype_name"), F.col("doc_id").alias("ord"))


def doc_types(spark, d):
    """A type for each source of a language, but none for src3."""
    found = table(spark, d, "documents").where("source <> 'src3'").groupBy("lang", "source").agg(F.min("doc_id").alias("ord"))
    pairs = F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array("source"))
    return found.select(F.col("lang").alias("namespace"), F.col("source").alias("name"), P.props_encode(pairs).alias("props"), "ord")


def listing(spark, d):
    return table(spark, d, "labels").select(F.lit("docs").alias("lib"), F.col("doc_id").cast("string").alias("path")).distinct()


@query("SELECT doc_id, lang AS namespace, source AS name FROM documents")
def dtype_split(spark, d):
    names = F.concat_ws("::", F.lit("docs"), "lang", "source")
    return table(spark, d, "documents").select("doc_id", X.dtype_namespace(names).alias("namespace"), X.dtype_name(names).alias("name"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, '{"lang":"' || lang || '"}|{"source":"' || source || '"}' AS props FROM documents WHERE source <> 'src3'""")
def manifest_resolve(spark, d):
    return C.manifest_resolve(manifest(spark, d), doc_types(spark, d)).select("path", F.array_join("props", "|").alias("props"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, lang || '::' || source AS dtype_name FROM documents WHERE source = 'src3'")
def manifest_unknown_types(spark, d):
    return C.manifest_unknown_types(manifest(spark, d), doc_types(spark, d)).select("path", "dtype_name")


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def manifest_existing(spark, d):
    return C.manifest_existing(manifest(spark, d), listing(spark, d)).select("path")


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def manifest_missing(spark, d):
    return C.manifest_missing(manifest(spark, d), listing(spark, d)).select("path")


@query("SELECT doc_id, lang || '::' || source AS type_name FROM documents WHERE source <> 'src3'")
def type_name_of(spark, d):
    docs = table(spark, d, "documents")
    pairs = F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array("source"))
    named, _ = C.type_name_of(docs.select("doc_id", P.props_encode(pairs).alias("props")), doc_types(spark, d))
    return named.select("doc_id", "type_name")


@query("SELECT lang || '::' || arg_max(source, doc_id) AS type_name FROM documents GROUP BY lang")
def name_last_wins(spark, d):
    """Sources of one language are names of one property set: the last one counts."""
    docs = table(spark, d, "documents")
    types = docs.select(F.col("lang").alias("namespace"), F.col("source").alias("name"), F.array(P.encode_pair(F.lit("lang"), F.col("lang"))).alias("props"), F.col("doc_id").alias("ord"))
    return C.name_last_wins(types).select("type_name")


@query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def mask_first_wins(spark, d):
    first, _ = C.mask_first_wins(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"])
    return first


@query("SELECT doc_id FROM documents d WHERE doc_id <> (SELECT min(doc_id) FROM documents e WHERE e.lang = d.lang AND e.source = d.source)")
def masked_rows(spark, d):
    _, masked = C.mask_first_wins(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"])
    return masked.select("doc_id")


@query("SELECT 0 AS lib_ord, CAST(c_custkey AS VARCHAR) AS path FROM customer UNION ALL SELECT 1, CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT 2, CAST(p_partkey AS VARCHAR) FROM part")
def library_union(spark, d):
    libs = [table(spark, d, t).select(F.col(k).cast("string").alias("path")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return C.library_union(libs)


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new::labelled' ELSE lang || '::' || source END AS dtype_name, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'retyped' ELSE 'kept' END AS action FROM documents UNION ALL SELECT 'page-' || page_id, 'new::page', 'added' FROM pages")
def manifest_upsert(spark, d):
    items = listing(spark, d).select("lib", "path", F.lit("new::labelled").alias("dtype_name"), F.lit(0).cast("long").alias("ord"))
    pages = table(spark, d, "pages").select(F.lit("docs").alias("lib"), F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), F.lit("new::page").alias("dtype_name"), F.col("page_id").alias("ord"))
    return C.manifest_upsert(manifest(spark, d), items.unionByName(pages), "skip").select("path", "dtype_name", "action")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new::labelled' ELSE lang || '::' || source END AS dtype_name FROM documents UNION ALL SELECT 'page-' || page_id, 'new::page' FROM pages")
def upsert_commits(spark, d):
    """Two writers replace entries of a manifest that both have read: neither loses what the other wrote."""
    first = manifest(spark, d)
    log = CommitLog(spark, scratch(spark, "manifest"), T.StructType([T.StructField(f.name, f.dataType) for f in first.schema]), ["lib", "path"])
    read = log.update(lambda _: first)
    items = listing(spark, d).select("lib", "path", F.lit("new::labelled").alias("dtype_name"), F.lit(0).cast("long").alias("ord"))
    pages = table(spark, d, "pages").select(F.lit("docs").alias("lib"), F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), F.lit("new::page").alias("dtype_name"), F.col("page_id").alias("ord"))
    for more in (items, pages):
        log.update(lambda rows, more=more: C.manifest_upsert(rows, more, "replace").drop("action"), at=read)
    return log.rows().select("path", "dtype_name")


@query("SELECT DISTINCT lang AS namespace, source AS name FROM documents WHERE source <> 'src3' UNION SELECT DISTINCT 'segments', c_mktsegment FROM customer")
def namespace_add(spark, d):
    more = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("ord")).select(F.lit("segments").alias("namespace"), F.col("c_mktsegment").alias("name"), F.array(P.encode_pair(F.lit("segment"), F.col("c_mktsegment"))).alias("props"), "ord")
    return C.namespace_add(doc_types(spark, d), more).select("namespace", "name")


DIGEST = "CAST(CAST('0x' || substr(sha256(concat_ws('=', CAST(doc_id AS VARCHAR), lang || '::' || source)), 1, 15) AS BIGINT) AS HUGEINT)"


@query(f"SELECT 'docs' AS lib, {key_sql('t', 5)} AS fingerprint FROM (SELECT count(*) || ':' || CAST(sum({DIGEST}) AS VARCHAR) AS t FROM documents)")
def library_fingerprint(spark, d):
    return C.library_fingerprint(manifest(spark, d))


@query(f"SELECT o_custkey, {key_sql('t', 5)} AS fingerprint FROM (SELECT o_custkey, string_agg(l, chr(10) ORDER BY l) AS t FROM (SELECT o_custkey, concat_ws(' ', o_orderkey, o_orderstatus) AS l FROM orders) GROUP BY o_custkey)")
def plan_fingerprint(spark, d):
    return C.fingerprint_of_lines(table(spark, d, "orders"), "o_custkey", F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus"))


@query("""SELECT DISTINCT lang AS namespace, source AS name, '{"lang":"' || lang || '"}|{"source":"' || source || '"}' AS props FROM documents WHERE source <> 'src3'""")
def types_load(spark, d):
    folder = scratch(spark, "types")
    L.save_documents(L.types_packed(doc_types(spark, d)), "namespace", folder)
    return L.types_load(spark, f"{folder}/name=*/*.txt").where("error is null").select("namespace", "name", F.array_join("props", "|").alias("props"))


@query("SELECT lang AS namespace, count(DISTINCT source) AS n_types FROM documents WHERE source <> 'src3' GROUP BY lang")
def types_save(spark, d):
    folder = scratch(spark, "types")
    L.save_documents(L.types_packed(doc_types(spark, d)), "namespace", folder)
    read = spark.read.text(folder, wholetext=True)
    return read.select(F.col("name").alias("namespace"), F.size(F.json_object_keys(F.get_json_object("value", "$.types"))).cast("long").alias("n_types"))


@query("SELECT lang AS lib, CAST(doc_id AS VARCHAR) AS path, lang || '::' || source AS dtype_name FROM documents")
def manifest_load(spark, d):
    folder = scratch(spark, "manifest")
    by_lang = manifest(spark, d).withColumn("lib", X.dtype_namespace(F.col("dtype_name")))
    L.save_documents(L.manifest_packed(by_lang), "lib", folder)
    return L.manifest_load(spark, f"{folder}/name=*/*.txt").where("error is null").select("lib", "path", "dtype_name")


@query("SELECT lang AS lib, CAST(count(*) AS BIGINT) AS n_entries FROM documents GROUP BY lang")
def manifest_save(spark, d):
    by_lang = manifest(spark, d).withColumn("lib", X.dtype_namespace(F.col("dtype_name")))
    size = F.size(F.json_object_keys(F.get_json_object("document", "$.manifest"))).cast("long")
    return L.manifest_packed(by_lang).groupBy("lib").agg(F.sum(size).alias("n_entries"))


@query("SELECT DISTINCT lang AS namespace, true AS has_bytes FROM documents WHERE source <> 'src3'")
def file_listing(spark, d):
    folder = scratch(spark, "types")
    L.save_documents(L.types_packed(doc_types(spark, d)), "namespace", folder)
    files = L.file_listing(spark, folder).where("path like '%.txt'")
    return files.select(F.regexp_extract("path", "/name=([^/]*)/", 1).alias("namespace"), (F.col("length") > 0).alias("has_bytes")).distinct()


def order_steps(spark, d):
    """A plan for each order: its lines in order are steps that use a part and produce a supplier's delivery."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_returnflag").alias("transform"), "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return C.step_order(lines, "target", ["l_linenumber", "l_partkey", "l_suppkey", "transform"])


STEPS = "SELECT l_orderkey AS target, l_returnflag AS transform, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS step FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM lineitem)"


@query(f"SELECT target, CAST(step AS INTEGER) AS step, transform FROM ({STEPS})")
def step_order(spark, d):
    return order_steps(spark, d).select("target", "step", "transform")


@query(f"SELECT target, CAST(step AS INTEGER) AS step, transform, 'p' || l_partkey AS uses FROM ({STEPS})")
def plan_save_load(spark, d):
    folder = scratch(spark, "plans")
    steps = order_steps(spark, d).select("target", "step", "transform", F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("uses"), F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("produces"))
    L.plan_save(steps, folder)
    return L.plan_load(spark, folder).select("target", "step", "transform", F.array_join("uses", ",").alias("uses"))


@query(f"SELECT target, transform, l_suppkey AS key, CAST(min(step) AS INTEGER) AS step FROM ({STEPS}) GROUP BY 1, 2, 3")
def process_dedupe(spark, d):
    return C.process_dedupe(order_steps(spark, d).withColumn("key", F.col("l_suppkey"))).select("target", "transform", "key", "step")


@query(f"SELECT target, count(*) AS n_steps FROM ({STEPS}) GROUP BY target")
def plan_lengths(spark, d):
    return C.plan_lengths(order_steps(spark, d))


@query("SELECT o_custkey, o_orderkey, n, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY n, o_orderkey) AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def solutions_ranked(spark, d):
    return C.solutions_ranked(order_sizes(spark, d), "o_custkey", "n", "o_orderkey")


def order_sizes(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT c_custkey AS o_custkey, min(n) AS n, arg_min(o_orderkey, n * 1000000000 + o_orderkey) AS o_orderkey FROM customer LEFT JOIN s ON o_custkey = c_custkey GROUP BY c_custkey")
def best_solution(spark, d):
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    best, none = C.best_solution(targets, order_sizes(spark, d), "o_custkey", "n", "o_orderkey")
    return best.unionByName(none, allowMissingColumns=True)


@query(f"SELECT target, CAST(step AS INTEGER) AS step, 'use' AS role, 0 AS ix, 'p' || l_partkey AS id, p_name AS path FROM ({STEPS}) JOIN part ON p_partkey = l_partkey UNION ALL SELECT target, CAST(step AS INTEGER), 'produce', 0, 's' || l_suppkey, s_name FROM ({STEPS}) JOIN supplier ON s_suppkey = l_suppkey")
def step_edges(spark, d):
    steps = order_steps(spark, d).select("target", "step", F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("uses"), F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("produces"))
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("path"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("path"))
    return C.step_edges(steps, parts.unionByName(suppliers))


@query("SELECT DISTINCT l_orderkey, l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1')")
def publish_targets(spark, d):
    made = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id")).distinct()
    return C.publish_targets(made, table(spark, d, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("id")))


# Matching and bindings ---------------------------------------------------------------------------------------------


def brand_types(spark, d, condition="true"):
    """Requirements: a transform for each brand, one requirement for each of its types among some parts."""
    found = table(spark, d, "part").where(condition).select("p_brand", "p_type").distinct()
    pairs = F.create_map(F.lit("brand"), F.array("p_brand"), F.lit("type"), F.array("p_type"))
    return found.select(F.col("p_brand").alias("transform"), F.dense_rank().over(_by_brand()).alias("req_ix"), "p_type", P.props_encode(pairs).alias("props"))


def _by_brand():
    from pyspark.sql import Window

    return Window.partitionBy("p_brand").orderBy("p_type")


@query("SELECT p.p_partkey, r.p_brand AS transform, r.p_type FROM part p JOIN (SELECT DISTINCT p_brand, p_type FROM part) r ON p.p_brand = r.p_brand AND p.p_type = r.p_type UNION ALL SELECT p_partkey, 'any', '' FROM part")
def containment_join(spark, d):
    need = brand_types(spark, d).select("transform", "p_type", "props")
    free = need.select(F.lit("any").alias("transform"), F.lit("").alias("p_type"), F.array().cast("array<string>").alias("props")).distinct()
    return M.containment_join(part_props(spark, d), need.unionByName(free), ["p_partkey"], ["transform", "p_type"])


@query("SELECT DISTINCT p_brand AS transform, p_type AS target_ix FROM part")
def producers_of(spark, d):
    targets = table(spark, d, "part").select(F.col("p_type").alias("target_ix"), F.array(P.encode_pair(F.lit("type"), F.col("p_type"))).alias("props")).distinct()
    return M.producers_of(brand_types(spark, d), targets)


SOME = "WITH r AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 40), i AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 10) "


def small_parts(spark, d):
    return part_props(spark, d, "p_size").where("p_size <= 10").withColumnRenamed("p_partkey", "id")


@query(SOME + "SELECT p_brand AS transform FROM r LEFT JOIN (SELECT *, 1 AS met FROM i) USING (p_brand, p_type) GROUP BY p_brand HAVING count(*) = count(met)")
def applicable_transforms(spark, d):
    return M.applicable_transforms(brand_types(spark, d, "p_size > 40"), small_parts(spark, d))


@query(SOME + "SELECT p_brand AS transform, p_type FROM r ANTI JOIN i USING (p_brand, p_type)")
def unsatisfied_requirements(spark, d):
    need = brand_types(spark, d, "p_size > 40")
    return M.unsatisfied_requirements(need, small_parts(spark, d)).join(need, ["transform", "req_ix"]).select("transform", "p_type")


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def satisfies_lineage(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    need = P.encode_pair(F.lit("segment"), F.col("c_mktsegment"))
    ancestors = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_custkey").alias("ancestor"), F.array(need).alias("props"))
    protos = customer.where("c_mktsegment = 'BUILDING'").select(F.lit(1).alias("need"), F.lit("p").alias("proto"), F.array(need).alias("props")).distinct()
    return M.satisfies_lineage(orders.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("need")), protos, ancestors).select("id")


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def lineage_acceptable(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nearest = both.select(F.col("o_orderkey").alias("id"), F.lit("nation").alias("proto"), F.col("c_nationkey").alias("ancestor"))
    bound = table(spark, d, "nation").where("n_nationkey = 3").select(F.lit("nation").alias("proto"), F.col("n_nationkey").alias("ancestor"))
    return M.lineage_acceptable(both.select(F.col("o_orderkey").alias("id")), bound, nearest)


def order_edges(spark, d):
    """Orders as ancestors of their customers, later ones added later."""
    prop = P.encode_pair(F.lit("status"), F.col("o_orderstatus"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("child"), F.col("o_orderkey").alias("ancestor"), F.col("o_orderkey").alias("ord"), F.array(prop).alias("props"))


def status_protos(spark, d):
    prop = P.encode_pair(F.lit("status"), F.col("o_orderstatus"))
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("proto"), F.array(prop).alias("props")).distinct()


@query("SELECT o_custkey AS child, o_orderstatus AS proto, max(o_orderkey) AS ancestor FROM orders GROUP BY 1, 2")
def nearest_ancestor(spark, d):
    return M.nearest_ancestor(order_edges(spark, d), status_protos(spark, d))


@query("SELECT child, proto, ancestor FROM (SELECT o_custkey AS child, o_orderstatus AS proto, max(o_orderkey) AS ancestor FROM orders GROUP BY 1, 2) JOIN orders ON o_orderkey = ancestor WHERE o_orderpriority = '1-URGENT'")
def lineage_join(spark, d):
    edges = order_edges(spark, d)
    bound = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderstatus").alias("proto"), F.col("o_orderkey").alias("ancestor"))
    return M.lineage_join(edges.select("child").distinct(), edges, status_protos(spark, d), bound)


def flagged(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag in ('R', 'A')").select("l_orderkey", F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("req_ix"), F.col("l_partkey").alias("id"))
    return lines.distinct()


@query("WITH c AS (SELECT DISTINCT l_orderkey, l_returnflag, l_partkey FROM lineitem) SELECT r.l_orderkey, r.l_partkey AS b0, a.l_partkey AS b1 FROM c r JOIN c a USING (l_orderkey) WHERE r.l_returnflag = 'R' AND a.l_returnflag = 'A'")
def bindings_all(spark, d):
    return M.bindings_all(flagged(spark, d), 2, ["l_orderkey"])


@query("WITH c AS (SELECT DISTINCT l_orderkey, l_returnflag, l_partkey FROM lineitem) SELECT r.l_orderkey, r.l_partkey AS b0, a.l_partkey AS b1 FROM c r JOIN c a USING (l_orderkey) WHERE r.l_returnflag = 'R' AND a.l_returnflag = 'A' AND r.l_partkey <> a.l_partkey")
def bindings_valid(spark, d):
    return M.bindings_valid(flagged(spark, d), {}, None, 2, ["l_orderkey"])


@query("WITH n AS (SELECT o_custkey, max(o_orderkey) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT 'o' || o AS b0, 'c' || o_custkey AS b1 FROM n")
def bindings_linked(spark, d):
    """A finished order and the customer whose last finished order it is."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(name("o", "o_orderkey").alias("id"), F.lit(0).alias("req_ix"))
    customers = table(spark, d, "customer").select(name("c", "c_custkey").alias("id"), F.lit(1).alias("req_ix"))
    near = M.nearest_ancestor(order_edges(spark, d), status_protos(spark, d).where("proto = 'F'"))
    near = near.select(name("c", "child").alias("child"), F.lit(0).alias("proto"), name("o", "ancestor").alias("ancestor"))
    return M.bindings_valid(orders.unionByName(customers), {1: [0]}, near, 2)


# Derivation ----------------------------------------------------------------------------------------------------------

#: Transforms over documents: tokens from English and German text, an index from tokens and the text itself, and
#: a text from tokens, which makes a cycle.
TRANSFORMS = TransformCatalog()


@TRANSFORMS.register("tokenize", [(['{"data":"text"}'], [])], [(['{"data":"tokens"}'], "tokens")])
def _tokenize(pdf):
    return pdf


@TRANSFORMS.register("detokenize", [(['{"data":"tokens"}'], [])], [(['{"data":"text"}', '{"from":"tokens"}'], "text")])
def _detokenize(pdf):
    return pdf


@TRANSFORMS.register("index", [(['{"data":"text"}', '{"lang":"en"}'], []), (['{"data":"tokens"}'], [0])], [(['{"data":"index"}'], "index")])
def _index(pdf):
    return pdf


def texts(spark, d):
    pairs = F.create_map(F.lit("data"), F.array(F.lit("text")), F.lit("lang"), F.array("lang"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("root"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), P.props_encode(pairs).alias("props"))


def closure(spark, d):
    return D.derive(texts(spark, d), TRANSFORMS.requirements(spark), TRANSFORMS.products(spark))


CLOSURE = """WITH RECURSIVE t(src, dst, lang, step) AS (VALUES ('text', 'tokens', '%', 1), ('tokens', 'text2', '%', 1), ('tokens', 'index', 'en', 1)),
 r AS (SELECT doc_id, lang, 'text' AS what, 0 AS round FROM documents UNION SELECT doc_id, r.lang, dst, round + 1 FROM r JOIN t ON src = what AND r.lang LIKE t.lang WHERE round < 8) """


@query(CLOSURE + "SELECT doc_id AS root, what, min(round) AS round FROM r GROUP BY 1, 2")
def derive_closure(spark, d):
    what = F.when(F.col("transform").isNull(), "text").when(F.col("transform") == "tokenize", "tokens").when(F.col("transform") == "detokenize", "text2").otherwise("index")
    return closure(spark, d).endpoints().groupBy("root", what.alias("what")).agg(F.min("round").alias("round"))


@query("SELECT doc_id AS root, 'tokens' AS child_of, 1 AS n FROM documents UNION ALL SELECT doc_id, 'text2', 2 FROM documents UNION ALL SELECT doc_id, 'index', 2 FROM documents WHERE lang = 'en'")
def lineage_propagate(spark, d):
    known = closure(spark, d)
    what = F.when(F.col("transform") == "tokenize", "tokens").when(F.col("transform") == "detokenize", "text2").otherwise("index")
    named = known.endpoints().where("transform is not null").select("root", F.col("id").alias("child"), what.alias("child_of"))
    return known.lineage().join(named, ["root", "child"]).groupBy("root", "child_of").agg(F.count("*").cast("int").alias("n"))


@query(CLOSURE + "SELECT doc_id AS root, what, min(round) AS round FROM r GROUP BY 1, 2")
def derive_incremental(spark, d):
    """English and German texts first, then all: what the first ones' kinds lead to is looked up."""
    store = ClosureStore(spark, scratch(spark, "closures"), TRANSFORMS.requirements(spark), TRANSFORMS.products(spark))
    every = texts(spark, d)
    store.extend(every.where(F.exists("props", lambda p: p.isin('{"lang":"en"}', '{"lang":"de"}'))))
    what = F.when(F.col("transform").isNull(), "text").when(F.col("transform") == "tokenize", "tokens").when(F.col("transform") == "detokenize", "text2").otherwise("index")
    return store.extend(every).endpoints().groupBy("root", what.alias("what")).agg(F.min("round").alias("round"))


def goals(spark, *targets):
    """Targets (goal, target_ix, props, parents) as rows."""
    return spark.createDataFrame(list(targets), G.TARGETS)


@query("SELECT doc_id AS root, 0 AS target_ix, 1 AS step, 'tokenize' AS transform FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 0, 2, 'index' FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1, 1, 'tokenize' FROM documents UNION ALL SELECT doc_id, 1, 2, 'detokenize' FROM documents")
def derivation_plan(spark, d):
    """Two goals of one target each."""
    want = goals(spark, (0, 0, ['{"data":"index"}'], []), (1, 0, ['{"from":"tokens"}'], []))
    steps = G.solve(texts(spark, d), TRANSFORMS.requirements(spark), TRANSFORMS.products(spark), want)[1]
    return steps.select("root", F.col("goal").alias("target_ix"), "step", "transform")


@query("SELECT doc_id AS root, step, transform FROM documents, (VALUES (1, 'tokenize'), (2, 'detokenize'), (3, 'index')) v(step, transform) WHERE lang = 'en'")
def derivation_joint(spark, d):
    """An index and a text from tokens, wanted together: the tokens are made once."""
    want = goals(spark, (0, 0, ['{"data":"index"}'], []), (0, 1, ['{"from":"tokens"}'], []))
    return G.solve(texts(spark, d), TRANSFORMS.requirements(spark), TRANSFORMS.products(spark), want)[1].select("root", "step", "transform")


@query("SELECT doc_id AS root, 2 AS n_steps FROM documents WHERE lang = 'en'")
def batch_derivation(spark, d):
    return D.batch_derivation(texts(spark, d), TRANSFORMS.requirements(spark), TRANSFORMS.products(spark), ['{"data":"index"}'])


#: Three ways to a summary, and a translation before them for texts that aren't English.
ROUTES = TransformCatalog()


@ROUTES.register("summarize", [(['{"data":"text"}', '{"lang":"en"}'], [])], [(['{"data":"summary"}'], "summary")])
def _summarize(pdf):
    return pdf


@ROUTES.register("shorten", [(['{"data":"text"}', '{"lang":"en"}'], [])], [(['{"data":"short"}'], "short")])
def _shorten(pdf):
    return pdf


@ROUTES.register("condense", [(['{"data":"short"}'], [])], [(['{"data":"summary"}'], "summary")])
def _condense(pdf):
    return pdf


@ROUTES.register("translate", [(['{"data":"text"}', '{"lang":"de"}'], [])], [(['{"data":"text"}', '{"lang":"en"}'], "english")])
def _translate(pdf):
    return pdf


@query("WITH w(lang, rank, steps) AS (VALUES ('en', 1, 'summarize'), ('en', 2, 'shorten,condense'), ('de', 1, 'translate,summarize'), ('de', 2, 'translate,shorten,condense')) SELECT doc_id AS root, w.rank::INT AS rank, len(string_split(steps, ','))::INT AS n_steps, steps, true AS exact FROM documents JOIN w USING (lang)")
def derivation_alternatives(spark, d):
    """The ways to a summary, shortest first."""
    plans, steps = G.solve(texts(spark, d), ROUTES.requirements(spark), ROUTES.products(spark), goals(spark, (0, 0, ['{"data":"summary"}'], [])), k=3)
    named = steps.groupBy("root", "rank").agg(F.array_sort(F.collect_list(F.struct("step", "transform"))).alias("s")).select("root", "rank", F.array_join(F.col("s.transform"), ",").alias("steps"))
    return plans.join(named, ["root", "rank"]).select("root", "rank", "n_steps", "steps", "exact")


#: What is done with an order: its lines are packed one by one, a parcel gets a label, an order an invoice.
SHIPPING = TransformCatalog()


@SHIPPING.register("pack", [(['{"data":"order"}'], []), (['{"data":"line"}'], [0])], [(['{"data":"parcel"}'], "parcel")])
def _pack(pdf):
    return pdf


@SHIPPING.register("label", [(['{"data":"parcel"}'], [])], [(['{"data":"label"}'], "label")])
def _label(pdf):
    return pdf


@SHIPPING.register("invoice", [(['{"data":"order"}', '{"status":"F"}'], [])], [(['{"data":"invoice"}'], "invoice")])
def _invoice(pdf):
    return pdf


@query("WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem), g AS (SELECT l_orderkey, count(DISTINCT (l_linenumber, l_partkey, l_suppkey)) AS n FROM l WHERE l_returnflag = 'R' GROUP BY 1)"
 " SELECT o_orderkey AS root, 3 AS n_steps, true AS exact, true AS returned FROM orders JOIN g ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")  # fmt: skip
def derivation_linked(spark, d):
    """Finished orders: a returned line, a parcel and label made from that very line, and the order's invoice."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("root"), F.lit("order").alias("id"), F.array(F.lit('{"data":"order"}'), P.encode_pair(F.lit("status"), F.col("o_orderstatus"))).alias("props"), F.array().cast("array<string>").alias("parents"))
    flags = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_returnflag").alias("flag"), F.collect_set("l_returnflag").alias("flags"))
    # What is the same for all lines isn't encoded line by line; `data` sorts before `flag`.
    props = F.concat(F.array(F.lit('{"data":"line"}')), F.transform(F.sort_array("flags"), lambda v: P.encode_pair(F.lit("flag"), v)))
    lines = flags.join(orders.select("root"), F.col("l_orderkey") == F.col("root"), "left_semi").select(F.col("l_orderkey").alias("root"), F.concat_ws("_", "flag", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), props.alias("props"), F.array(F.lit("order")).alias("parents"))
    want = goals(spark, (0, 0, ['{"flag":"R"}'], []), (0, 1, ['{"data":"parcel"}'], [0]), (0, 2, ['{"data":"label"}'], [1]), (0, 3, ['{"data":"invoice"}'], []))
    plans, _ = G.solve(orders.unionByName(lines), SHIPPING.requirements(spark), SHIPPING.products(spark), want)
    return plans.select("root", "n_steps", "exact", F.get("uses", F.lit(0)).startswith("R").alias("returned"))


@query("SELECT doc_id AS root, 'tokenize' AS transform, 1 AS round FROM documents UNION ALL SELECT doc_id, 'detokenize', 2 FROM documents UNION ALL SELECT doc_id, 'index', 2 FROM documents WHERE lang = 'en'")
def plan_consolidate(spark, d):
    return D.plan_consolidate(closure(spark, d).applications()).select("root", "transform", "round")


@query("SELECT doc_id AS root, CASE WHEN lang = 'en' THEN 4 ELSE 3 END AS n_endpoints, 2 AS last_round FROM documents")
def cycle_guard(spark, d):
    """The cycle of tokens and text ends."""
    return closure(spark, d).endpoints().groupBy("root").agg(F.count("*").cast("int").alias("n_endpoints"), F.max("round").alias("last_round"))


@query("SELECT doc_id AS root, 1 AS produced FROM documents")
def apply_transform_rows(spark, d):
    """One round of tokenizing every document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("root"), F.col("doc_id").cast("string").alias("id"), F.array(F.lit('{"data":"text"}')).alias("props"))
    start, need = D.given_endpoints(docs), TRANSFORMS.requirements(spark).where("transform = 'tokenize'")
    made, _ = D.apply_transform_rows(D.bindings(D.fitting(start, need).withColumn("fresh", F.lit(True)), need, [], 1), TRANSFORMS.products(spark), 1)
    return made.groupBy("root").agg(F.count("*").cast("int").alias("produced"))


# Transfers -----------------------------------------------------------------------------------------------------------


def transfers(spark, d):
    """Pages to fetch, by number: from the web, from a cloud endpoint by address or by URL, or over ssh, and some illegal."""
    page = table(spark, d, "pages")
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    src = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("globus://ep1:/data/"), n, F.lit(".html"))).when(k == 2, F.concat(F.lit("https://app.globus.org/file-manager?origin_id=ep2&origin_path=%2Fdata%2F"), n)).when(k == 3, F.concat(F.lit("ssh://host1:/srv/"), n)).otherwise(F.concat(F.lit("/local/"), n, F.lit(".tar.gz")))
    dest = F.when(k == 1, F.concat(F.lit("globus://ep9:/in/"), n)).when(k == 2, F.concat(F.lit("ssh://host2:/in/"), n)).when(k == 4, F.concat(F.lit("https://example.org/put/"), n)).otherwise(F.concat(F.lit("/in/"), n))
    return page.select("page_id", src.alias("src_address"), dest.alias("dest_address")).select("page_id", "src_address", X.address_type(F.col("src_address")).alias("src_type"), "dest_address", X.address_type(F.col("dest_address")).alias("dest_type"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'GLOBUS' WHEN 2 THEN 'GLOBUS' WHEN 3 THEN 'SSH' ELSE 'DIRECT' END AS kind, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) WHEN 1 THEN 'ep1' WHEN 2 THEN 'ep2' WHEN 3 THEN 'host1' ELSE '' END AS endpoint, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) WHEN 1 THEN '/data/' || page_id || '.html' WHEN 2 THEN '/data/' || page_id WHEN 3 THEN '/srv/' || page_id ELSE '/local/' || page_id || '.tar.gz' END AS path FROM pages")
def address_parse(spark, d):
    a = F.col("src_address")
    return transfers(spark, d).select("page_id", X.address_type(a).alias("kind"), X.address_endpoint(a).alias("endpoint"), X.address_path(a).alias("path"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/new/x' WHEN 1 THEN 'globus://ep1:/new/x' WHEN 2 THEN 'globus://ep2:/new/x' WHEN 3 THEN 'ssh://host1:/new/x' ELSE '/new/x' END AS moved, CASE WHEN page_id % 5 IN (0, 3) THEN '/out/' || page_id ELSE NULL END AS outside FROM pages")
def address_rewrite(spark, d):
    moved = X.child(X.with_path(F.col("src_address"), F.lit("/new/")), F.lit("x"))
    outside = F.when(F.col("dest_type") == "DIRECT", X.relocated(F.col("dest_address"), F.lit("/in"), F.lit("/out")))
    return transfers(spark, d).select("page_id", moved.alias("moved"), outside.alias("outside"))


@query("SELECT page_id, CASE page_id % 5 WHEN 1 THEN page_id || '.html' WHEN 2 THEN '' || page_id WHEN 3 THEN '' || page_id WHEN 4 THEN page_id || '.tar.gz' ELSE regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1) END AS name, CASE page_id % 5 WHEN 4 THEN page_id || '.tar' WHEN 0 THEN regexp_replace(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1), '(.)[.][^.]*$', '\\1') ELSE '' || page_id END AS stem FROM pages")
def address_name(spark, d):
    a = F.col("src_address")
    return transfers(spark, d).select("page_id", X.address_name(a).alias("name"), X.address_stem(a).alias("stem"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'GLOBUS' WHEN 3 THEN 'SSH' END AS dominant, CASE page_id % 5 WHEN 2 THEN 'between platforms' WHEN 4 THEN 'to HTTP' END AS reason FROM pages")
def transfer_validate(spark, d):
    good, bad = V.transfer_validate(transfers(spark, d))
    return good.select("page_id", "dominant").unionByName(bad.select("page_id", "reason"), allowMissingColumns=True)


@query("SELECT CASE page_id % 5 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'GLOBUS' ELSE 'SSH' END AS dominant, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) WHEN 1 THEN 'ep1' ELSE 'host1' END AS src_endpoint, CASE page_id % 5 WHEN 1 THEN 'ep9' ELSE '' END AS dest_endpoint, count(*) AS n FROM pages WHERE page_id % 5 IN (0, 1, 3) GROUP BY 1, 2, 3")
def transfer_batches(spark, d):
    return V.transfer_batches(V.transfer_validate(transfers(spark, d))[0])


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'GLOBUS' ELSE 'SSH' END AS dominant, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) WHEN 1 THEN 'ep1' ELSE 'host1' END AS src_endpoint, CASE page_id % 5 WHEN 1 THEN 'ep9' ELSE '' END AS dest_endpoint, CASE page_id % 5 WHEN 1 THEN 'globus://ep9:/in/' || page_id ELSE '/in/' || page_id END AS dest_address FROM pages WHERE page_id % 5 IN (0, 1, 3)")
def batch_contents(spark, d):
    return V.batch_contents(V.transfer_validate(transfers(spark, d))[0]).select("page_id", "dominant", "src_endpoint", "dest_endpoint", "dest_address")


@query("SELECT CASE page_id % 5 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'GLOBUS' ELSE 'SSH' END AS dominant, count(*) AS n FROM pages WHERE page_id % 5 IN (0, 1, 3) GROUP BY 1")
def transfers_by_type(spark, d):
    return V.transfers_by_type(V.transfer_validate(transfers(spark, d))[0])


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS priority FROM pages WHERE page_id % 5 IN (0, 1, 3)")
def transfer_priority(spark, d):
    return V.transfer_priority(V.transfer_validate(transfers(spark, d))[0]).select("page_id", F.col("priority").cast("int").alias("priority"))


@query("SELECT page_id, page_id % 5 IN (0, 3) AND page_id IN (SELECT doc_id FROM labels) AS completed FROM pages WHERE page_id % 5 IN (0, 1, 3)")
def transfer_reconcile(spark, d):
    files = table(spark, d, "labels").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"))
    done, failed = V.transfer_reconcile(V.transfer_validate(transfers(spark, d))[0], files)
    return done.select("page_id", F.lit(True).alias("completed")).unionByName(failed.select("page_id", F.lit(False).alias("completed")))


# Logs, streams and protocols -------------------------------------------------------------------------------------------

LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'view' THEN 'debug' ELSE 'info' END"


def event_lines(spark, d):
    """Events as log lines, coloured, with carriage returns."""
    level = F.expr(LEVEL)
    message = F.concat(F.lit("\x1b[31m"), F.col("event_id").cast("string"), F.lit("\x1b[0m "), "props")
    return table(spark, d, "events").select(F.concat(logs.log_line(F.col("ts"), level, message), F.lit("\r")).alias("value"))


def log_folder(spark, d):
    folder = scratch(spark, "logs")
    event_lines(spark, d).write.text(folder)
    return folder


@query(f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {LEVEL} AS level, event_id || ' ' || props AS message FROM events")
def log_scan(spark, d):
    return logs.log_scan(spark, log_folder(spark, d)).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "level", "message")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS stamp, epoch_ms(date_trunc('second', ts)) AS ms FROM events")
def std_time(spark, d):
    stamp = X.std_time(F.col("ts"))
    return table(spark, d, "events").select("event_id", stamp.alias("stamp"), X.millis(X.parse_std_time(stamp)).alias("ms"))


@query("SELECT event_id, event_type || ' ' || props AS clean FROM events")
def text_clean(spark, d):
    dirty = F.concat(F.lit("\x1b[1;32m"), "event_type", F.lit("\x1b[0m "), "props", F.lit("\r\n"))
    return table(spark, d, "events").select("event_id", X.text_clean(dirty).alias("clean"))


@query(f"SELECT {LEVEL} AS level, count(*) AS n FROM events GROUP BY 1")
def log_stream(spark, d):
    folder, out = log_folder(spark, d), scratch(spark, "lines")
    lines = streams.log_stream(spark, folder)
    lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(lines.schema).parquet(out).groupBy("level").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(event_id // 1000 AS VARCHAR) AS feed, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {LEVEL} AS level, event_id || chr(10) || props AS message FROM events")
def log_frames(spark, d):
    """Events as messages of two lines in feeds of a thousand, each in two chunks cut inside a line."""
    line = logs.log_line(F.col("ts"), F.expr(LEVEL), F.concat(F.col("event_id").cast("string"), F.lit("\n"), "props", F.lit("\n")))
    order = Window.partitionBy("feed").orderBy("event_id")
    rows = table(spark, d, "events").select(F.expr("CAST(event_id DIV 1000 AS STRING)").alias("feed"), "event_id", F.encode(line, "UTF-8").alias("bytes"))
    rows = rows.withColumn("n", F.row_number().over(order).cast("long"))
    cut = F.pmod(F.col("event_id"), F.lit(29)).cast("int") + 1
    halves = rows.select("feed", F.explode(F.array(F.struct((2 * F.col("n") - 2).alias("number"), F.substring("bytes", F.lit(1), cut).alias("content")), F.struct((2 * F.col("n") - 1).alias("number"), F.substring("bytes", cut + 1, F.octet_length("bytes")).alias("content")))).alias("c")).select("feed", "c.*")
    ends = rows.groupBy("feed").agg((2 * F.max("n")).alias("number"), F.lit(None).cast("binary").alias("content"))
    folder, out = scratch(spark, "chunks"), scratch(spark, "messages")
    halves.unionByName(ends).write.parquet(folder)
    messages = frames.log_frames(spark.readStream.schema("feed string, number long, content binary").parquet(folder))
    messages.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(messages.schema).parquet(out).select("feed", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "level", "message")


@query(f"SELECT CASE WHEN {LEVEL} = 'error' THEN 'err' ELSE 'out' END AS listener, count(*) AS n FROM events GROUP BY 1")
def stream_split(spark, d):
    folder, out = log_folder(spark, d), scratch(spark, "split")
    keep = lambda name: lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/listener={name}/batch={number}")
    streams.stream_split(streams.log_stream(spark, folder), keep("out"), keep("err"), scratch(spark, "offsets")).awaitTermination()
    return spark.read.option("basePath", out).schema("ts timestamp, level string, message string, listener string, batch int").parquet(out).groupBy("listener").agg(F.count("*").alias("n"))


@query("SELECT 'tokenize' AS transform, 1 AS req_ix, count(*) AS n_candidates FROM documents UNION ALL SELECT 'index', 1, count(*) FROM documents WHERE lang = 'en'")
def register_transform(spark, d):
    """Documents that meet the first requirement of each registered transform."""
    pairs = F.create_map(F.lit("data"), F.array(F.lit("text")), F.lit("lang"), F.array("lang"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), P.props_encode(pairs).alias("props"))
    met = M.candidates(TRANSFORMS.requirements(spark), docs)
    return met.groupBy("transform", (F.col("req_ix") + 1).alias("req_ix")).agg(F.count("*").alias("n_candidates"))


@query("SELECT transform, n_requirements, n_products, (SELECT count(*) FROM documents) AS n_documents FROM (VALUES ('tokenize', 1, 1), ('detokenize', 1, 1), ('index', 2, 1)) t(transform, n_requirements, n_products)")
def transform_catalog(spark, d):
    n = table(spark, d, "documents").agg(F.count("*").alias("n_documents"))
    known = TRANSFORMS.transform_catalog(spark).select("transform", F.col("n_requirements").cast("int").alias("n_requirements"), F.col("n_products").cast("int").alias("n_products"))
    return M.product(known, n, ["transform"])


PROTOCOLS = TransformCatalog()


@PROTOCOLS.register("summarize", [(['{"data":"conversation"}'], [])], [(['{"data":"summary"}'], "summary")])
def summarize(pdf):
    if len(pdf) < 2:
        raise ValueError("too few turns")
    return f"{len(pdf)} turns, {int(pdf['text'].str.len().sum())} characters"


@query("SELECT CAST(conv_id AS VARCHAR) AS binding, count(*) >= 2 AS success, CASE WHEN count(*) < 2 THEN 'ValueError: too few turns' END AS error, CASE WHEN count(*) >= 2 THEN count(*) || ' turns, ' || CAST(sum(length(text)) AS BIGINT) || ' characters' END AS output FROM conversations GROUP BY conv_id")
def apply_protocol(spark, d):
    return PROTOCOLS.apply_protocol("summarize", table(spark, d, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("text")), "conv_id")
