"""Feeds, lookups, joins, groups, matrices and writes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.operators import dml, grouping, hierarchy, joins, lookup, paging
from agoraflow.sources.catalog import catalog, effective, translated
from agoraflow.sources.tables import table

Q, SQL = {}, {}


def query(sql: str):
    """Register a query under its function's name with its SQL."""

    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT o.o_orderkey, o.o_orderdate, coalesce(c.c_name, 'Anonymous') AS author, o.o_totalprice
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus <> 'P'
ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 20 OFFSET 20""")
def feed_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a feed: visible rows, newest first, with authors; the page is cut before authors are joined."""
    shown = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate", "o_custkey", "o_totalprice")
    page = paging.page_of(shown, "o_orderdate", "o_orderkey", paging.Page(2, 20))
    return joins.with_author(page, table(spark, d, "customer"), "o_custkey", "c_custkey", "c_name", default="Anonymous").drop("o_custkey")


@query("SELECT count(*) AS n, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM orders WHERE o_orderstatus <> 'P'")
def feed_count(spark, d):
    """Visible rows and pages of 20."""
    n = F.count(F.lit(1))
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").agg(n.alias("n"), F.greatest(F.lit(1).cast("long"), F.ceil(n / 20)).alias("pages"))


@query("SELECT count(*) AS n FROM orders WHERE CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END IS NULL")
def comment_count_null_item(spark, d):
    """A null parameter selects rows whose item is null."""
    rows = table(spark, d, "orders").withColumn("item", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    return lookup.by_key(rows, item=None).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007')")
def lookup_ci(spark, d):
    return lookup.by_any_fold(table(spark, d, "customer"), "CUSTOMER#000000007", "c_name").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_name) = 'building' OR lower(c_mktsegment) = 'building'")
def lookup_either(spark, d):
    return lookup.by_any_fold(table(spark, d, "customer"), "Building", "c_name", "c_mktsegment").select("c_custkey", "c_name", "c_mktsegment")


@query("""SELECT name FROM (SELECT 'customer#000000001' AS name UNION ALL SELECT 'nobody' UNION ALL SELECT 'CUSTOMER#000000002' UNION ALL SELECT 'Someone')
WHERE lower(name) NOT IN (SELECT lower(c_name) FROM customer)""")
def available_names(spark, d):
    """Names that nobody has, without regard to case."""
    names = spark.createDataFrame([("customer#000000001",), ("nobody",), ("CUSTOMER#000000002",), ("Someone",)], "name string")
    return lookup.missing(names, table(spark, d, "customer"), "name", "c_name")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def dynamic_filter(spark, d):
    """Only allowed columns of the request filter."""
    asked = {"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "o_comment": "x"}
    return lookup.filtered(table(spark, d, "orders"), asked, {"o_orderstatus", "o_orderpriority", "o_custkey"}).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT doc_id, source FROM documents WHERE source LIKE 'src1%'")
def prefix_like(spark, d):
    return lookup.like_prefix(table(spark, d, "documents"), "source", "src1").select("doc_id", "source")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY user_id")
def semi_existence(spark, d):
    """Events of known users, existence tested as a semi-join."""
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return lookup.present(table(spark, d, "events").select("user_id"), known, ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(max(CASE WHEN event_type = 'none' THEN props END), 'default') AS props FROM events")
def config_value(spark, d):
    return lookup.first_or_default(table(spark, d, "events"), "event_type", "props", "none", "default")


@query("""SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name FROM supplier s
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def resolved_view(spark, d):
    """A view of left joins along references."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return joins.resolved(s, (n, "s_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""SELECT kind, id, label FROM (SELECT 'customer' AS kind, CAST(c_custkey AS BIGINT) AS id, c_name AS label FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part)""")
def typed_union(spark, d):
    """Three subtype tables as one."""
    part = lambda t, k, n: table(spark, d, t).select(F.col(k).cast("long").alias("id"), F.col(n).alias("label"))
    return joins.typed_union(customer=part("customer", "c_custkey", "c_name"), supplier=part("supplier", "s_suppkey", "s_name"), part=part("part", "p_partkey", "p_name")).select("kind", "id", "label")


def _places(spark, d):
    """Regions, nations and customers as one hierarchy of texts."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    text = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = n.select(text("r", "n_regionkey").alias("parent"), text("n", "n_nationkey").alias("child")).unionByName(c.select(text("n", "c_nationkey").alias("parent"), text("c", "c_custkey").alias("child")))
    nodes = r.select(text("r", "r_regionkey").alias("node")).unionByName(edges.select(F.col("child").alias("node")))
    return edges, nodes


_EDGES = """e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
nodes AS (SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT child FROM e),
p AS (SELECT node AS ancestor, node AS descendant, 0 AS depth FROM nodes UNION ALL SELECT p.ancestor, e.child, p.depth + 1 FROM p JOIN e ON p.descendant = e.parent)"""


@query(f"WITH RECURSIVE {_EDGES} SELECT descendant, string_agg(ancestor, '/' ORDER BY depth DESC) AS ancestors FROM p GROUP BY descendant")
def ancestors(spark, d):
    """Every node's ancestors and itself, from the top."""
    spans = hierarchy.closure(*_places(spark, d))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor"))), lambda s: s["ancestor"]), "/")
    return spans.groupBy("descendant").agg(path.alias("ancestors"))


@query(f"WITH RECURSIVE {_EDGES} SELECT ancestor, count(*) AS n FROM p WHERE depth > 0 GROUP BY ancestor")
def descendants(spark, d):
    return hierarchy.closure(*_places(spark, d)).where("depth > 0").groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_EDGES} SELECT ancestor AS parent, descendant AS child FROM p WHERE depth = 1")
def direct_children(spark, d):
    return hierarchy.direct_children(hierarchy.closure(*_places(spark, d)))


@query("SELECT n.n_nationkey, concat(r.r_name, '/', n.n_name) AS path FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def include_path(spark, d):
    """A nation's path by its ancestors' keys."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    names = r.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).unionByName(n.select((F.col("n_nationkey") + 1000).alias("key"), F.col("n_name").alias("name")))
    pairs = n.select(F.col("n_regionkey").alias("ancestor"), (F.col("n_nationkey") + 1000).alias("descendant")).unionByName(n.select((F.col("n_nationkey") + 1000).alias("ancestor"), (F.col("n_nationkey") + 1000).alias("descendant")))
    return hierarchy.include_path(pairs, names, "key", "name").select((F.col("descendant") - 1000).cast("int").alias("n_nationkey"), "path")


_TREE = """s AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL ELSE {parent} END AS parent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM {table}),
t AS (SELECT conv_id, turn, 0 AS depth, [place] AS path FROM s WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM s q WHERE q.conv_id = s.conv_id AND q.turn = s.parent)
UNION ALL SELECT s.conv_id, s.turn, t.depth + 1, list_append(t.path, s.place) FROM t JOIN s ON s.conv_id = t.conv_id AND s.parent = t.turn)"""


def _turns(spark, d, parent):
    return table(spark, d, "conversations").select("conv_id", "turn").withColumn("parent", F.when(F.col("turn") > 0, parent))


@query(f"WITH RECURSIVE {_TREE.format(parent='turn // 2', table='conversations')} SELECT conv_id, turn, CAST(depth AS INT) AS depth, EXISTS (SELECT 1 FROM s WHERE s.conv_id = t.conv_id AND s.parent = t.turn) AS has_children, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) AS INT) AS position FROM t")
def tree_preorder(spark, d):
    """Replies in pre-order with depth; turn n answers turn n div 2."""
    return hierarchy.reply_tree(_turns(spark, d, F.floor(F.col("turn") / 2)), "turn", "parent", ["conv_id"], ["turn"]).select("conv_id", "turn", "depth", "has_children", "position")


@query(f"WITH RECURSIVE sl AS (SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn BETWEEN 3 AND 6), {_TREE.format(parent='turn // 2', table='sl')} SELECT conv_id, turn, CAST(depth AS INT) AS depth, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) AS INT) AS position FROM t")
def slice_then_tree(spark, d):
    """The tree of a page of replies: those whose parent is on another page become roots."""
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    cut = _turns(spark, d, F.floor(F.col("turn") / 2)).withColumn("rn", rn).where("rn BETWEEN 3 AND 6").drop("rn")
    return hierarchy.reply_tree(cut, "turn", "parent", ["conv_id"], ["turn"]).select("conv_id", "turn", "depth", "position")


@query(f"WITH RECURSIVE {_TREE.format(parent='turn // 2', table='conversations')}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS position, lead(depth) OVER (PARTITION BY conv_id ORDER BY path) AS nxt FROM t) SELECT conv_id, turn, CAST(CASE WHEN nxt IS NULL THEN depth + 1 WHEN nxt > depth THEN 0 ELSE depth - nxt + 1 END AS INT) AS closes FROM o")
def closing_tags(spark, d):
    """Levels that end after each reply."""
    tree = hierarchy.reply_tree(_turns(spark, d, F.floor(F.col("turn") / 2)), "turn", "parent", ["conv_id"], ["turn"])
    return hierarchy.closing_tags(tree, ["conv_id"]).select("conv_id", "turn", "closes")


@query("SELECT event_type, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS users FROM events GROUP BY event_type")
def group_multimap(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("user"))
    return grouping.multimap(rows, "event_type", "user", "users").select("event_type", F.array_join("users", ",").alias("users"))


@query("""SELECT r_name, string_agg(n_name || ':' || suppliers, ';' ORDER BY n_name) AS nations FROM (
SELECT r.r_name, n.n_name, coalesce(string_agg(s.s_name, ',' ORDER BY s.s_name), '') AS suppliers FROM region r
LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY r.r_name, n.n_name) GROUP BY r_name""")
def nested_groups(spark, d):
    """Regions with their nations with their suppliers."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    flat = joins.resolved(r, (n, "r_regionkey", "n_regionkey"), (s, "n_nationkey", "s_nationkey"))
    inner = grouping.nested(flat, ["r_name", "n_name"], ["s_name"], "suppliers")
    text = inner.select("r_name", "n_name", F.array_join(F.transform("suppliers", lambda x: x["s_name"]), ",").alias("suppliers"))
    outer = grouping.nested(text, ["r_name"], ["n_name", "suppliers"], "nations")
    return outer.select("r_name", F.array_join(F.transform("nations", lambda x: F.concat(x["n_name"], F.lit(":"), x["suppliers"])), ";").alias("nations"))


@query("""SELECT n.n_nationkey, s.c_mktsegment, EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.c_mktsegment AND c.c_acctbal > 9000) AS held
FROM nation n, (SELECT DISTINCT c_mktsegment FROM customer) s""")
def matrix_flags(spark, d):
    """Every nation with every market segment, two catalogs, and whether a rich customer is in both."""
    c = table(spark, d, "customer")
    rich = c.where("c_acctbal > 9000").withColumnRenamed("c_nationkey", "n_nationkey")
    return joins.flag_matrix(table(spark, d, "nation").select("n_nationkey"), c.select("c_mktsegment").distinct(), rich, ["n_nationkey", "c_mktsegment"]).select("n_nationkey", "c_mktsegment", "held")


@query("SELECT p_partkey, p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) AS highlighted FROM part")
def member_highlight(spark, d):
    """Rows marked if their brand is among some ids."""
    p = table(spark, d, "part")
    return joins.marked_members(p.select("p_partkey", "p_brand"), p.where("p_size = 1"), "p_brand", "p_brand", "highlighted").select("p_partkey", "highlighted")


@query("SELECT split_part(p_brand, '#', 1) AS prefix, count(*) AS n, count(DISTINCT p_brand) AS codes FROM part GROUP BY 1")
def codes_by_prefix(spark, d):
    return table(spark, d, "part").groupBy(grouping.prefix_of(F.col("p_brand"), "#").alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("codes"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) % 2 AS INT) AS odd FROM orders")
def row_parity(spark, d):
    return paging.parity(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], ["o_custkey"]).drop("o_orderdate")


@query("SELECT p AS page, array_to_string(range(greatest(1, p - 2), least(7, p + 2) + 1), ',') AS links FROM range(1, 8) t(p)")
def page_links(spark, d):
    """Page numbers around each of seven pages."""
    return spark.range(1, 8).select(F.col("id").alias("page"), F.array_join(paging.page_links(F.col("id"), F.lit(7).cast("long"), 2).cast("array<string>"), ",").alias("links"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def cap_newest(spark, d):
    """The three newest events of each user."""
    return paging.newest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", 3, "event_id").drop("ts")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event(spark, d):
    return dml.latest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)
UNION ALL SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'P') WHERE rn = 1""")
def upsert_latest(spark, d):
    """Balances replaced by the latest pending order of each customer."""
    changes = dml.latest(table(spark, d, "orders").where("o_orderstatus = 'P'"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return dml.upserted(table(spark, d, "customer").select("c_custkey", "c_acctbal"), changes.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal")), ["c_custkey"])


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def insert_ignore(spark, d):
    """First event of each user, with rows added for customers without one."""
    first = dml.earliest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_type")
    return dml.insert_ignored(first, table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type")), ["user_id"])


@query("""SELECT o.o_orderkey, CASE WHEN c.c_nationkey IN (3, 7) THEN NULL ELSE o.o_custkey END AS o_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def set_null_on_delete(spark, d):
    """Orders after customers of two nations are deleted: their reference becomes null."""
    gone = table(spark, d, "customer").where("c_nationkey IN (3, 7)")
    return dml.set_null(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def cascade_delete(spark, d):
    """Customers after the nations of a region are deleted."""
    gone = table(spark, d, "nation").where("n_regionkey = 1")
    return dml.cascaded(table(spark, d, "customer").select("c_custkey", "c_nationkey"), gone, "c_nationkey", "n_nationkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'BLOCKED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def bulk_update(spark, d):
    return dml.updated(table(spark, d, "customer"), F.col("c_acctbal") < 0, c_acctbal=0.0, c_mktsegment="BLOCKED").select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 1 - p_size ELSE p_size END AS p_size FROM part")
def toggle(spark, d):
    return dml.toggled(table(spark, d, "part"), F.col("p_brand") == "Brand#2", "p_size", {"p_size"}).select("p_partkey", "p_size")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'deleted_' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_nationkey = 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def tombstone(spark, d):
    return dml.tombstoned(table(spark, d, "customer"), F.col("c_nationkey") == 5, "c_custkey", "c_name", ["c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, CASE WHEN o_custkey = 10 THEN 0 ELSE o_custkey END AS o_custkey FROM orders")
def reassign(spark, d):
    """One owner's rows given to another."""
    return dml.reassigned(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 10, 0)


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey <> 4 UNION ALL SELECT n_nationkey, 4 FROM nation")
def replace_group(spark, d):
    """All rows of a group replaced by others."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), F.lit(4).alias("s_nationkey"))
    return dml.replaced_group(table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_nationkey"), "s_nationkey", 4, rows)


@query("""SELECT event_id, coalesce(CASE event_type WHEN 'view' THEN 'Seen' WHEN 'click' THEN 'Klick' END, event_type) AS label FROM events""")
def translate(spark, d):
    """Event types by the catalog of a locale, later files overriding earlier ones."""
    own = effective(catalog(spark, ("en", {"view": "View", "click": "Click"}), ("en", {"view": "Seen", "click": "Klick", "bad": 7}), ("it", {"signup": "Iscrizione"})))
    return translated(table(spark, d, "events").select("event_id", "event_type"), own, "event_type", "en").select("event_id", "label")
