"""The queries of a site by name, over the driver's tables: customers stand for users, orders for news, parts for pages, events for
comments and requests, suppliers for mailboxes. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.functions import net, text, web
from agoraflow.operators import accounts, dml, grouping, hierarchy, joins, lookup, paging, policy, temporal
from agoraflow.sources.tables import table

Q, SQL = {}, {}

#: The views over the tables, in SQL; the functions below are the same in DataFrames.
USERS = "u AS (SELECT c_custkey AS id, c_name AS username, c_nationkey AS type, c_acctbal < 0 AS deleted, lower(replace(c_name, '#', '.')) || '@example.org' AS email, c_mktsegment AS display_name, c_acctbal AS balance FROM customer)"
NEWS = "n AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderdate AS created_at, o_orderstatus = 'P' AS hidden, o_custkey AS author FROM orders)"
PAGES = "p AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS slug, p_type AS template, p_size % 7 = 0 AS hidden, p_size % 2 = 1 AS i18n, p_brand AS site FROM part)"
COMMENTS = "c AS (SELECT event_id AS id, user_id, event_id % 50 AS page, CASE WHEN event_id % 4 = 3 THEN event_id // 2 END AS reply_to, ts AS made, event_type AS kind, value, value > 100 AS hidden FROM events)"


def users(spark: SparkSession, d: str) -> DataFrame:
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_nationkey").alias("type"), (F.col("c_acctbal") < 0).alias("deleted"), email.alias("email"), F.col("c_mktsegment").alias("display_name"), F.col("c_acctbal").alias("balance"))


def news(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "P").alias("hidden"), F.col("o_custkey").alias("author"))


def pages(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.col("p_type").alias("template"), (F.col("p_size") % 7 == 0).alias("hidden"), (F.col("p_size") % 2 == 1).alias("i18n"), F.col("p_brand").alias("site"))


def comments(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("id"), "user_id", (i % 50).alias("page"), F.when(i % 4 == 3, F.floor(i / 2)).alias("reply_to"), F.col("ts").alias("made"), F.col("event_type").alias("kind"), "value", (F.col("value") > 100).alias("hidden"))


def query(sql: str, *views: str):
    """Register a query under its function's name with its SQL over some of the views."""

    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, (f"WITH {', '.join(views)} " if views else "") + sql
        return f

    return add


# ---- one row, or a few


@query("SELECT id, slug, template FROM p WHERE id = 7 AND NOT hidden", PAGES)
def page_by_id(spark, d):
    return lookup.by_key(pages(spark, d), id=7, hidden=False).select("id", "slug", "template")


@query("SELECT slug, min(id) AS id FROM p WHERE NOT hidden GROUP BY slug", PAGES)
def page_id_by_slug(spark, d):
    """Every slug with the first visible page that has it."""
    return lookup.by_key(pages(spark, d), hidden=False).groupBy("slug").agg(F.min("id").alias("id"))


@query("SELECT id, slug FROM p WHERE i18n AND NOT hidden", PAGES)
def i18n_pages(spark, d):
    return lookup.by_key(pages(spark, d), i18n=True, hidden=False).select("id", "slug")


@query("SELECT * FROM n WHERE id = 3 AND NOT hidden", NEWS)
def news_visible(spark, d):
    return lookup.by_key(news(spark, d), id=3, hidden=False)


@query("SELECT * FROM n WHERE id = 4", NEWS)
def news_any(spark, d):
    """A news item for an admin, hidden or not."""
    return lookup.by_key(news(spark, d), id=4)


@query("SELECT id, user_id, page, reply_to, hidden FROM c WHERE id = 11", COMMENTS)
def comment_by_id(spark, d):
    return lookup.by_key(comments(spark, d), id=11).select("id", "user_id", "page", "reply_to", "hidden")


@query("SELECT id, username, display_name FROM u WHERE id = 5 AND NOT deleted", USERS)
def profile_by_id(spark, d):
    """What others may see of a user who is not deleted."""
    return lookup.by_key(users(spark, d), id=5, deleted=False).select("id", "username", "display_name")


@query("SELECT id, username, display_name FROM u WHERE lower(username) = 'customer#000000008' AND NOT deleted", USERS)
def profile_by_name(spark, d):
    return lookup.by_any_fold(users(spark, d).where("NOT deleted"), "CUSTOMER#000000008", "username").select("id", "username", "display_name")


@query("SELECT id, username, deleted FROM u WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderkey < 5)", USERS)
def users_even_deleted(spark, d):
    """Authors of some news, deleted ones too."""
    asked = table(spark, d, "orders").where("o_orderkey < 5").select(F.col("o_custkey").alias("id")).distinct()
    return lookup.present(users(spark, d), asked, ["id"]).select("id", "username", "deleted")


@query("SELECT * FROM u WHERE id = 12", USERS)
def admin_user_row(spark, d):
    return lookup.by_key(users(spark, d), id=12)


@query("SELECT sha256(username) AS hash FROM u WHERE id = 6", USERS)
def password_hash_of(spark, d):
    return lookup.by_key(users(spark, d), id=6).select(F.sha2("username", 256).alias("hash"))


@query("SELECT email FROM u WHERE id = 6", USERS)
def email_of_user(spark, d):
    return lookup.by_key(users(spark, d), id=6).select("email")


@query("SELECT DISTINCT kind FROM c WHERE user_id = 3", COMMENTS)
def trusted_list(spark, d):
    """The senders that one user trusts."""
    return lookup.by_key(comments(spark, d), user_id=3).select("kind").distinct()


@query("SELECT id, user_id, made FROM c WHERE id = 42 AND TIMESTAMP '2024-01-01 00:00:00' <= made + INTERVAL 600 SECOND", COMMENTS)
def captcha_lookup(spark, d):
    """A challenge that is not over; at its very end it is still good."""
    over = temporal.expired(F.expr("made + INTERVAL 600 SECOND"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return lookup.by_key(comments(spark, d), id=42).where(~over).select("id", "user_id", "made")


@query("SELECT id, user_id, EXISTS (SELECT 1 FROM c b WHERE b.id = a.id + 1 AND NOT b.hidden) AS valid FROM c a WHERE user_id = 4", COMMENTS)
def session_valid(spark, d):
    """Sessions of a user and whether the id that follows is held by a live one."""
    c = comments(spark, d)
    live = c.where("NOT hidden").select((F.col("id") - 1).alias("id"))
    return joins.marked_members(lookup.by_key(c, user_id=4).select("id", "user_id"), live, "id", "id", "valid")


@query("SELECT s_suppkey AS ban_id, u.id FROM supplier JOIN u ON lower(u.username) = 'customer#' || right('000000000' || s_suppkey, 9) WHERE s_nationkey <> 1", USERS)
def ban_by_email(spark, d):
    """Users whose name a ban has, without regard to case."""
    bans = table(spark, d, "supplier").where("s_nationkey <> 1").select(F.col("s_suppkey").alias("ban_id"), F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"))
    return users(spark, d).join(bans, lookup.same_fold(F.col("username"), F.col("name"))).select("ban_id", "id")


@query("SELECT id, slug FROM p WHERE slug LIKE 'cold%' AND NOT hidden", PAGES)
def pinned_search(spark, d):
    return lookup.like_prefix(lookup.by_key(pages(spark, d), hidden=False), "slug", "cold").select("id", "slug")


@query("SELECT id, CASE kind WHEN 'view' THEN 'admin.news' WHEN 'click' THEN 'admin.users' WHEN 'purchase' THEN 'admin.bans' ELSE 'admin.other' END AS label FROM c", COMMENTS)
def nav_registry(spark, d):
    """A fixed list of sections and their labels."""
    labels = {"view": "admin.news", "click": "admin.users", "purchase": "admin.bans"}
    return comments(spark, d).select("id", text.labelled(F.col("kind"), labels, "admin.other").alias("label"))


@query("SELECT kind AS route, count(*) AS rounds, max(value) AS most FROM c GROUP BY kind", COMMENTS)
def ban_routes(spark, d):
    """Every route with its rounds."""
    return comments(spark, d).groupBy(F.col("kind").alias("route")).agg(F.count(F.lit(1)).alias("rounds"), F.max("value").alias("most"))


@query("SELECT count(*) AS affected FROM c WHERE page = 3 AND NOT hidden", COMMENTS)
def affected_rows(spark, d):
    """Rows that hiding a page's comments changes."""
    return lookup.by_key(comments(spark, d), page=3, hidden=False).agg(F.count(F.lit(1)).alias("affected"))


@query("SELECT kind, count(*) AS n FROM c WHERE user_id = 2 GROUP BY kind", COMMENTS)
def audit_count(spark, d):
    return lookup.filtered(comments(spark, d), {"user_id": 2, "other": 1}, {"user_id", "kind"}).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- joins, groups and pages


@query("SELECT p.id, string_agg(w, ', ' ORDER BY w) AS keywords FROM (SELECT id, unnest(string_split(slug, '-')) AS w FROM p) p GROUP BY p.id", PAGES)
def page_keywords(spark, d):
    words = pages(spark, d).select("id", F.explode(F.split("slug", "-")).alias("w"))
    return words.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("w")), ", ").alias("keywords"))


@query("SELECT s.s_suppkey AS id, n.n_name, r.r_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'")
def ban_with_subtypes(spark, d):
    """Bans with whichever subtype row they have."""
    r = table(spark, d, "region").where("r_name <> 'ASIA'")
    return joins.resolved(table(spark, d, "supplier"), (table(spark, d, "nation"), "s_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey")).select(F.col("s_suppkey").alias("id"), "n_name", "r_name")


@query("SELECT id, slug, site FROM p WHERE NOT hidden AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)", PAGES)
def linkable_pages(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return dml.cascaded(pages(spark, d).where("NOT hidden"), used, "id", "l_partkey").select("id", "slug", "site")


@query("SELECT p.id, slug, hidden, coalesce(k, 0) AS used FROM p LEFT JOIN (SELECT l_partkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_partkey = id", PAGES)
def admin_page_list(spark, d):
    used = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))
    return joins.resolved(pages(spark, d), (used, "id", "l_partkey")).select("id", "slug", "hidden", F.coalesce("k", F.lit(0)).alias("used"))


@query("SELECT k.kind, t.type, EXISTS (SELECT 1 FROM c JOIN u ON c.user_id = u.id WHERE c.kind = k.kind AND u.type = t.type AND c.hidden) AS shown FROM (SELECT DISTINCT kind FROM c) k, (SELECT DISTINCT type FROM u) t", COMMENTS, USERS)
def level_matrix(spark, d):
    """Every kind of event with every type of user and whether the pair is marked."""
    c, u = comments(spark, d), users(spark, d)
    held = c.where("hidden").join(u.select(F.col("id").alias("user_id"), "type"), "user_id")
    return joins.flag_matrix(u.select("type").distinct(), c.select("kind").distinct(), held, ["kind", "type"], "shown").select("kind", "type", "shown")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def navbar_entries(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 2")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("SELECT site, slug, min(id) AS id FROM p GROUP BY site, slug", PAGES)
def slug_map(spark, d):
    return pages(spark, d).groupBy("site", "slug").agg(F.min("id").alias("id"))


@query("SELECT id, title FROM n ORDER BY created_at DESC, id LIMIT 20", NEWS)
def admin_feed(spark, d):
    return paging.page_of(news(spark, d), "created_at", "id", paging.Page(1, 20)).select("id", "title")


@query("SELECT id, username FROM u ORDER BY username, id LIMIT 25 OFFSET 50", USERS)
def user_list(spark, d):
    return paging.page_of(users(spark, d), "username", "id", paging.Page(3, 25, False)).select("id", "username")


@query("SELECT id, user_id FROM c WHERE kind LIKE 'p%' ORDER BY made DESC, id LIMIT 50", COMMENTS)
def audit_page(spark, d):
    return paging.page_of(lookup.like_prefix(comments(spark, d), "kind", "p"), "made", "id", paging.Page(1, 50)).select("id", "user_id")


@query("SELECT id, user_id FROM c WHERE page = 2 AND NOT hidden ORDER BY made, id LIMIT 20", COMMENTS)
def comment_page(spark, d):
    return paging.page_of(lookup.by_key(comments(spark, d), page=2, hidden=False), "made", "id", paging.Page(1, 20, False)).select("id", "user_id")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place FROM part")
def pin_sort(spark, d):
    """Entries within their pin by two keys."""
    from pyspark.sql import Window as W

    return table(spark, d, "part").select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy("p_size", "p_partkey")).alias("place"))


@query("SELECT p_brand, string_agg(p_partkey, ',' ORDER BY p_name, p_partkey) AS parts FROM part GROUP BY p_brand")
def sections_by_name(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("p_name", "p_partkey")))
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(rows, lambda x: x["p_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT id, row_number() OVER (ORDER BY created_at, id DESC) AS place FROM (SELECT id, created_at FROM n ORDER BY created_at DESC, id LIMIT 10)", NEWS)
def page_reversed(spark, d):
    """The newest page, told from its oldest row on."""
    from pyspark.sql import Window as W

    page = paging.page_of(news(spark, d), "created_at", "id", paging.Page(1, 10))
    return page.select("id", F.row_number().over(W.orderBy("created_at", F.desc("id"))).alias("place"))


@query("SELECT p AS page, CASE WHEN p > 1 THEN '/news?page=' || (p - 1) END AS before, CASE WHEN p < 9 THEN '/news?page=' || (p + 1) END AS after FROM range(1, 10) t(p)")
def pagination_urls(spark, d):
    at = lambda n: F.concat(F.lit("/news?page="), n.cast("string"))
    p = F.col("page")
    return spark.range(1, 10).select(F.col("id").alias("page")).select("page", F.when(p > 1, at(p - 1)).alias("before"), F.when(p < 9, at(p + 1)).alias("after"))


@query("SELECT site, bool_or(hidden) AS marked FROM p GROUP BY site", PAGES)
def any_child_marked(spark, d):
    return pages(spark, d).groupBy("site").agg(F.bool_or("hidden").alias("marked"))


# ---- hierarchy


@query("SELECT r_regionkey AS ancestor, 100 + n_nationkey AS descendant FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, r_regionkey FROM region UNION ALL SELECT 100 + n_nationkey, 100 + n_nationkey FROM nation UNION ALL SELECT r_regionkey, 999 FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 3 UNION ALL SELECT 103, 999 UNION ALL SELECT 999, 999")
def closure_insert(spark, d):
    """The closure of regions and nations after a leaf is put below a nation."""
    return hierarchy.inserted(_closure(spark, d), 999, 103)


@query("SELECT r_regionkey AS ancestor, 100 + n_nationkey AS descendant FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey <> 3 UNION ALL SELECT r_regionkey, r_regionkey FROM region UNION ALL SELECT 100 + n_nationkey, 100 + n_nationkey FROM nation WHERE n_nationkey <> 3")
def closure_delete(spark, d):
    return hierarchy.removed(_closure(spark, d), 103)


@query("SELECT n_nationkey AS nation, n_regionkey = 2 AS inside FROM nation")
def child_reroute(spark, d):
    """Nations as tails of an address, and whether the page before them, a region, is among their ancestors."""
    below = _closure(spark, d).where("ancestor = 2").select((F.col("descendant") - 100).alias("n"))
    return joins.marked_members(table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), below, "nation", "n", "inside")


def _closure(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("ancestor"), (F.col("n_nationkey") + 100).alias("descendant"))
    own = table(spark, d, "region").select(F.col("r_regionkey").alias("ancestor"), F.col("r_regionkey").alias("descendant"))
    return n.unionByName(own).unionByName(n.select(F.col("descendant").alias("ancestor"), "descendant"))


# ---- writes


@query("SELECT id, title FROM n WHERE id <> 9", NEWS)
def news_deleted(spark, d):
    return dml.deleted(news(spark, d), F.col("id") == 9).select("id", "title")


@query("SELECT id FROM c WHERE NOT (user_id = 3 AND kind = 'click')", COMMENTS)
def untrusted(spark, d):
    """Trust after a user takes one sender's away."""
    return dml.deleted(comments(spark, d), (F.col("user_id") == 3) & (F.col("kind") == "click")).select("id")


@query("SELECT id, CASE WHEN type = 5 THEN 'deleted_' || id ELSE username END AS username, CASE WHEN type = 5 THEN NULL ELSE email END AS email, type = 5 OR deleted AS deleted FROM u", USERS)
def soft_redacted(spark, d):
    """Users of a type redacted: they keep their rows and what they wrote."""
    gone = F.col("type") == 5
    return dml.updated(dml.tombstoned(users(spark, d), gone, "id", "username", ["email"]), gone, deleted=True).select("id", "username", "email", "deleted")


@query("SELECT id, username, type = 6 OR deleted AS deleted FROM u", USERS)
def kept_visible(spark, d):
    return dml.updated(users(spark, d), F.col("type") == 6, deleted=True).select("id", "username", "deleted")


@query("SELECT id, CASE WHEN id = 3 THEN 'New title' ELSE title END AS title, hidden OR id = 3 AS hidden FROM n", NEWS)
def news_updated(spark, d):
    return dml.updated(news(spark, d), F.col("id") == 3, title="New title", hidden=True).select("id", "title", "hidden")


@query("SELECT id, title FROM n UNION ALL SELECT -1, 'Added'", NEWS)
def news_inserted(spark, d):
    return news(spark, d).select("id", "title").unionByName(spark.createDataFrame([(-1, "Added")], "id long, title string"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE CASE WHEN id % 11 = 0 THEN 'edited' ELSE kind END END AS kind, CASE WHEN id % 7 = 0 THEN true WHEN id % 3 = 0 THEN false ELSE hidden END AS hidden FROM c WHERE id % 5 <> 0 OR id % 7 = 0", COMMENTS)
def moderation(spark, d):
    """Comments after one action each: those by five are deleted unless hidden by seven, others shown, edited or left."""
    c = comments(spark, d).select("id", "hidden", F.lit(False).alias("flagged"), F.col("kind").alias("content"))
    i = F.col("id")
    action = F.when(i % 7 == 0, "hide").when(i % 5 == 0, "delete").when(i % 3 == 0, "unhide").otherwise("nonsense")
    out = accounts.moderated(c, c.select("id", action.alias("action"), F.lit("x").alias("content")))
    edits = c.where((i % 11 == 0) & (i % 5 != 0)).select("id", F.lit("update").alias("action"), F.lit("edited").alias("content"))
    out = accounts.moderated(out, edits)
    return out.select("id", F.when(i % 5 != 0, F.col("content")).alias("kind"), "hidden")


_MODES = "CASE id % 7 WHEN 0 THEN 'full' WHEN 1 THEN 'hard_redact' WHEN 2 THEN 'soft_redact' WHEN 3 THEN 'keep_visible' WHEN 4 THEN 'keep_suspended' WHEN 5 THEN 'burn' END"
_REMOVAL = f"r AS (SELECT id, {_MODES} AS mode, id % 3 = 0 AS by_admin, id % 2 = 0 AS knows FROM u WHERE id % 7 < 6), o AS (SELECT id, mode, CASE WHEN mode = 'burn' THEN 'bad mode' WHEN by_admin OR knows THEN 'done' ELSE 'refused' END AS outcome FROM r)"


def _removed(spark, d):
    u = users(spark, d).withColumns({"secret_hash": F.sha2("username", 256), "verified": F.lit(True)})
    mode = F.expr(_MODES)
    asked = u.where("id % 7 < 6").select("id", mode.alias("mode"), F.when(F.col("id") % 2 == 0, F.col("username")).otherwise("wrong").alias("secret"), F.lit(False).alias("unlocked"), (F.col("id") % 3 == 0).alias("by_admin"))
    return accounts.removed(u, comments(spark, d).select("id", "user_id"), asked, 0)


@query("SELECT id, mode, outcome FROM o", USERS, _REMOVAL)
def deletion_outcomes(spark, d):
    """Requests to be deleted, by mode, and what comes of them."""
    return _removed(spark, d)[2]


@query("SELECT u.id, CASE WHEN outcome = 'done' AND mode IN ('hard_redact', 'soft_redact') THEN 'deleted_' || u.id ELSE username END AS username, deleted OR coalesce(outcome = 'done', false) AS deleted, coalesce(NOT (outcome = 'done' AND mode = 'keep_suspended'), true) AS verified FROM u LEFT JOIN o ON u.id = o.id WHERE NOT coalesce(outcome = 'done' AND mode = 'full', false)", USERS, _REMOVAL)
def deletion_users(spark, d):
    return _removed(spark, d)[0].select("id", "username", "deleted", "verified")


@query("SELECT c.id, CASE WHEN outcome = 'done' AND mode = 'hard_redact' THEN 0 WHEN outcome = 'done' AND mode = 'full' THEN NULL ELSE user_id END AS user_id FROM c LEFT JOIN o ON c.user_id = o.id", USERS, COMMENTS, _REMOVAL)
def deletion_comments(spark, d):
    """What deleted users wrote goes to the ghost, loses its owner, or stays."""
    return _removed(spark, d)[1]


@query("SELECT code, level FROM (SELECT kind AS code, CAST(id % 6 AS INT) AS level, row_number() OVER (PARTITION BY kind ORDER BY id DESC) AS rn FROM c WHERE id % 6 BETWEEN 1 AND 4) WHERE rn = 1", COMMENTS)
def level_save(spark, d):
    """Overrides saved from a form: empty and unknown levels are left out, the last of a code counts."""
    c = comments(spark, d).select(F.col("kind").alias("code"), F.when(F.col("id") % 6 == 0, "").otherwise((F.col("id") % 6).cast("string")).alias("text"), F.col("id").alias("n"))
    return accounts.saved_levels(spark.createDataFrame([("old", 1)], "code string, level int"), c, [1, 2, 3, 4])


# ---- sequences


@query("""SELECT a.id, CASE WHEN u.id IS NULL THEN 'unknown' WHEN u.id % 4 = 0 THEN 'muted' WHEN a.id % 3 = 0 THEN 'wrong' WHEN u.balance < 1000 THEN 'unverified' ELSE 'ok' END AS outcome
FROM c a LEFT JOIN u ON u.id = a.user_id * 20""", COMMENTS, USERS)
def login(spark, d):
    """Sign-ins by name or address: unknown, muted after five failures, wrong, unverified or ok."""
    u = users(spark, d).select("id", "username", "email", F.sha2("username", 256).alias("secret_hash"), (F.col("balance") >= 1000).alias("verified"), F.when(F.col("id") % 4 == 0, 5).otherwise(0).alias("failed"))
    number = F.lpad((F.col("user_id") * 20).cast("string"), 9, "0")
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("CUSTOMER#"), number)).otherwise(F.concat(F.lit("Customer."), number, F.lit("@EXAMPLE.org")))
    asked = comments(spark, d).select(F.col("id").alias("attempt"), name.alias("name"), F.when(F.col("id") % 3 == 0, "no").otherwise(F.concat(F.lit("Customer#"), number)).alias("secret"))
    return accounts.signed_in(asked, u, 5).select(F.col("attempt").alias("id"), "outcome")


@query("""SELECT c.id, CASE WHEN c.id % 13 = 0 THEN 'empty name' WHEN c.id % 11 = 0 THEN 'bad name' WHEN u.id IS NOT NULL THEN 'name taken' WHEN c.id % 7 = 0 THEN 'short password' WHEN c.id % 5 = 0 THEN 'no match'
WHEN c.kind = 'error' THEN 'bad mailbox' WHEN c.user_id < 5 THEN 'mailbox taken' WHEN c.page < 10 THEN 'too young' END AS error FROM c LEFT JOIN u ON u.id = c.id AND c.id % 2 = 0""", COMMENTS, USERS)
def registration(spark, d):
    """Registrations with the first rule they break."""
    u = users(spark, d).select("username", F.when(F.col("id") < 5, F.concat(F.lit("box"), F.col("id").cast("string"))).alias("mailbox"))
    i = F.col("id")
    name = F.when(i % 13 == 0, "").when(i % 11 == 0, "a b").when(i % 2 == 0, F.concat(F.lit("CUSTOMER#"), F.lpad(i.cast("string"), 9, "0"))).otherwise(F.concat(F.lit("new_"), i.cast("string")))
    secret = F.when(i % 7 == 0, "short").otherwise("long enough")
    asked = comments(spark, d).select("id", name.alias("username"), secret.alias("password"), F.when(i % 5 == 0, "other").otherwise(secret).alias("repeat"), F.when(F.col("kind") == "error", ".dot").otherwise(F.concat(F.lit("BOX"), F.col("user_id").cast("string"))).alias("mailbox"), F.when(F.col("page") < 10, "2020-01-01").otherwise("1990-01-01").cast("date").alias("birth"))
    return accounts.registered(asked, u, F.lit("2024-06-01").cast("timestamp"), 13, 120).select("id", "error")


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN 'no match' WHEN id % 7 = 0 THEN 'empty' WHEN id % 11 = 0 THEN 'short' WHEN id % 3 = 0 THEN 'wrong' END AS error FROM u""", USERS)
def password_change(spark, d):
    u = users(spark, d).select("id", F.sha2("username", 256).alias("secret_hash"), "username")
    i = F.col("id")
    new = F.when(i % 7 == 0, "").when(i % 11 == 0, "tiny").otherwise("a new secret")
    asked = u.select("id", F.when(i % 3 == 0, "bad").otherwise(F.col("username")).alias("old"), new.alias("new"), F.when(i % 5 == 0, "else").otherwise(new).alias("repeat"), F.lit(False).alias("unlocked"))
    return accounts.password_changed(asked, u).select("id", "error")


@query("SELECT c.id, u.id AS found FROM c LEFT JOIN u ON u.id = c.user_id AND NOT u.deleted", COMMENTS, USERS)
def recovery(spark, d):
    """Users found by name or address for a recovery mail."""
    number = F.lpad(F.col("user_id").cast("string"), 9, "0")
    asked = comments(spark, d).select(F.col("id").alias("request"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("customer#"), number)).otherwise(F.concat(F.lit("CUSTOMER."), number, F.lit("@example.ORG"))).alias("asked"))
    return accounts.recovered(asked, users(spark, d)).select(F.col("request").alias("id"), F.col("id").alias("found"))


@query("""SELECT a.id, CASE WHEN a.kind = 'error' THEN 'forbidden' WHEN a.id % 9 = 0 THEN 'empty' WHEN a.id % 10 = 0 THEN 'bad email' WHEN a.reply_to IS NOT NULL AND b.id IS NULL THEN 'no such comment'
WHEN a.reply_to IS NOT NULL AND b.page <> a.page THEN 'other page' WHEN a.id % 17 = 0 THEN 'spam' WHEN m.until > a.made THEN 'muted' WHEN epoch_us(a.made) - epoch_us(a.last_at) < 10000000 THEN 'flood' ELSE 'posted' END AS outcome
FROM (SELECT *, lag(made) OVER (PARTITION BY user_id ORDER BY made, id) AS last_at FROM c) a LEFT JOIN (SELECT * FROM c WHERE NOT hidden) b ON a.reply_to = b.id
LEFT JOIN (SELECT user_id, max(made) AS until FROM c WHERE hidden GROUP BY 1) m ON a.user_id = m.user_id""", COMMENTS)
def comment_post(spark, d):
    """Posts through all checks in their order."""
    from pyspark.sql import Window as W

    c = comments(spark, d)
    i = F.col("id")
    content = F.when(i % 9 == 0, "  ").when(i % 17 == 0, "buy cheap pills").otherwise("hello")
    posts = c.select(i.alias("post_id"), "user_id", "page", content.alias("content"), F.when(i % 10 == 0, "nobody").alias("email"), "reply_to", (F.col("kind") != "error").alias("allowed"), F.col("made").alias("at"), F.lag("made").over(W.partitionBy("user_id").orderBy("made", "id")).alias("last_at"))
    mutes = c.where("hidden").select("user_id", F.col("made").alias("until"))
    return accounts.posted(posts, c.where("NOT hidden").select("id", "page"), mutes, [r"(?i)cheap\s+pills"], 10).select(F.col("post_id").alias("id"), "outcome")


@query("SELECT user_id, max(made) + INTERVAL 30 SECOND AS until FROM c WHERE id % 17 = 0 GROUP BY user_id", COMMENTS)
def mute_on_spam(spark, d):
    out = comments(spark, d).select("user_id", F.col("made").alias("at"), F.when(F.col("id") % 17 == 0, "spam").otherwise("posted").alias("outcome"))
    return accounts.muted_after(out, 30)


@query("SELECT o_orderkey AS id, date_diff('second', o_orderdate, TIMESTAMP '2010-01-01') BETWEEN 13 * 31557600 AND 14 * 31557600 AS allowed FROM orders")
def age_gate(spark, d):
    """Births between two ages in seconds."""
    age = accounts.aged(F.col("o_orderdate"), F.lit("2010-01-01").cast("timestamp"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), age.between(13 * 31_557_600, 14 * 31_557_600).alias("allowed"))


@query("SELECT id, kind = 'signup' OR coalesce(epoch_us(made) - epoch_us(last) >= CASE kind WHEN 'click' THEN 600000000 ELSE 1800000000 END, false) AS due FROM (SELECT *, lag(made) OVER (PARTITION BY user_id ORDER BY made, id) AS last FROM c)", COMMENTS)
def rotation(spark, d):
    """Sessions whose id is to change, by force or after their kind's interval."""
    from pyspark.sql import Window as W

    s = comments(spark, d).select("id", "kind", (F.col("kind") == "signup").alias("forced"), "made", F.lag("made").over(W.partitionBy("user_id").orderBy("made", "id")).alias("last"))
    return accounts.rotation_due(s, "made", "last", {"click": 600}, 1800).select("id", "due")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN kind <> 'error' ELSE id % 3 <> 0 END AS allowed FROM c", COMMENTS)
def own_policy(spark, d):
    """A permission on one's own rows demands ownership; others abstain."""
    c = comments(spark, d)
    i = F.col("id")
    asked = c.select("id", F.when(i % 5 == 0, "comment.edit").otherwise("comment.edit.own").alias("permission"), F.lit(1).alias("owner"), F.when(i % 3 == 0, 2).otherwise(1).alias("me"), ((i % 5 != 0) | (F.col("kind") != "error")).alias("role"))
    return asked.select("id", policy.decided(F.col("role"), policy.own_verdict(F.col("permission"), F.col("owner"), F.col("me"))).alias("allowed"))


# ---- columns


@query("SELECT id, username, lower(username) AS name, regexp_matches(username, '^[a-zA-Z0-9][a-zA-Z0-9._-]{0,63}$') AS mailbox FROM u", USERS)
def name_rules(spark, d):
    return users(spark, d).select("id", "username", text.normalised(F.col("username")).alias("name"), F.col("username").rlike(accounts.MAILBOX).alias("mailbox"))


@query("SELECT id, lower(email) AS email, '> ' || username || chr(10) || '> ' || display_name AS quoted FROM u", USERS)
def mail_text(spark, d):
    u = users(spark, d)
    shown = F.concat(F.col("username"), F.lit(" <"), F.upper("email"), F.lit(">"))
    return u.select("id", text.email_of(shown).alias("email"), text.quoted(F.concat_ws("\n", "username", "display_name")).alias("quoted"))


@query("SELECT id, CASE WHEN kind = 'view' THEN CAST(id AS INT) ELSE -1 END AS n, NOT (kind = 'error' OR id % 2 = 0) AS b FROM c", COMMENTS)
def lenient_values(spark, d):
    c = comments(spark, d)
    return c.select("id", text.lenient_int(F.when(F.col("kind") == "view", F.col("id").cast("string")).otherwise(F.col("kind")), -1).alias("n"), text.lenient_bool(F.when(F.col("kind") == "error", F.lit(None)).when(F.col("id") % 2 == 0, F.lit("0")).otherwise(F.lit("no"))).alias("b"))


@query("SELECT id, '/en/' || slug AS path, '/en?page=' || slug AS query FROM p", PAGES)
def page_urls(spark, d):
    p = pages(spark, d)
    return p.select("id", web.page_url(F.lit("/en"), F.col("slug"), True).alias("path"), web.page_url(F.lit("/en"), F.col("slug"), False).alias("query"))


@query("""SELECT id, concat_ws('&', CASE WHEN page <> 1 THEN 'page=' || page END, CASE WHEN kind <> 'view' THEN 'kind=' || kind END) AS query,
CASE WHEN kind <> 'view' THEN page || '/' || kind WHEN page <> 1 THEN CAST(page AS VARCHAR) ELSE '' END AS path FROM c""", COMMENTS)
def comment_state(spark, d):
    """The state of a list as an address, without what is the default."""
    page, kind = (F.col("page"), F.lit(1).cast("long")), (F.col("kind"), F.lit("view"))
    return comments(spark, d).select("id", web.state_query(page=page, kind=kind).alias("query"), web.state_path(page, kind).alias("path"))


@query("SELECT id, concat_ws('&', CASE WHEN reply_to IS NOT NULL THEN 'reply_to=' || reply_to END, 'kind=' || kind) AS query FROM c", COMMENTS)
def filter_queries(spark, d):
    return comments(spark, d).select("id", web.filter_query(reply_to=F.col("reply_to"), kind=F.col("kind")).alias("query"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '8.8.' || (id % 200) || '.9' ELSE '10.0.0.1' END AS ip FROM c", COMMENTS)
def client_ips(spark, d):
    """The first public address behind a proxy, else the peer's."""
    i = F.col("id")
    listed = F.when(i % 3 == 0, F.concat(F.lit("192.168.1.5, junk, 8.8."), (i % 200).cast("string"), F.lit(".9, 1.1.1.1"))).otherwise(F.lit("172.16.0.1,127.0.0.1"))
    return comments(spark, d).select("id", web.client_ip(F.lit("10.0.0.1"), listed, True).alias("ip"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'tok' || id END AS token FROM c", COMMENTS)
def bearer_tokens(spark, d):
    i = F.col("id").cast("string")
    return comments(spark, d).select("id", web.bearer(F.when(F.col("id") % 2 == 0, F.concat(F.lit("bearer  tok"), i)).otherwise(F.concat(F.lit("Basic "), i))).alias("token"))


@query("SELECT id, CASE kind WHEN 'view' THEN 'safe' WHEN 'click' THEN 'idempotent' ELSE 'unsafe' END AS safety, CASE WHEN page BETWEEN 1 AND 5 THEN CAST(page AS INT) END AS class FROM c", COMMENTS)
def http_classes(spark, d):
    method = F.when(F.col("kind") == "view", "get").when(F.col("kind") == "click", "Put").otherwise("POST")
    return comments(spark, d).select("id", web.method_class(method).alias("safety"), text.status_class(F.col("page") * 100 + 4).alias("class"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'https://example.org' ELSE 'http://example.org:8080' END || '/' || slug || CASE WHEN hidden THEN '?x=1' ELSE '' END AS uri FROM p", PAGES)
def uris(spark, d):
    even = F.col("id") % 2 == 0
    return pages(spark, d).select("id", web.uri_text(F.when(even, "https").otherwise("http"), F.lit("example.org"), F.when(even, 443).otherwise(8080), F.col("slug"), F.when(F.col("hidden"), "x=1")).alias("uri"))


@query("SELECT id, CASE WHEN type % 3 = 0 THEN 'Admin' WHEN type % 3 = 1 THEN 'User' ELSE 'Guest' END AS label, CASE WHEN deleted THEN 'Anonymous' ELSE username END AS shown FROM u", USERS)
def group_labels(spark, d):
    u = users(spark, d)
    return u.select("id", text.labelled(F.col("type") % 3, {0: "Admin", 1: "User"}, "Guest").alias("label"), text.display_name(F.when(~F.col("deleted"), F.col("username")), F.lit("")).alias("shown"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN right('000000' || lower(to_hex(id)), 6) ELSE '000000' END AS colour, CASE WHEN type % 2 = 0 THEN 'it' ELSE 'en' END AS locale FROM u", USERS)
def colours_and_locales(spark, d):
    i = F.col("id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("#"), F.lpad(F.hex(i), 6, "0"))).otherwise("red")
    return users(spark, d).select("id", text.hex_colour(raw).alias("colour"), text.locale_of(F.when(F.col("type") % 2 == 0, "IT-it").otherwise("zz"), ["en", "it"], "en").alias("locale"))


@query("SELECT id, 'Sent' || id AS leaf, string_split(slug, '-')[1] || '__' || id AS key FROM p", PAGES)
def folder_names(spark, d):
    i = F.col("id").cast("string")
    return pages(spark, d).select("id", text.leaf(F.concat(F.lit("INBOX/Old/Sent"), i), "/").alias("leaf"), text.code_key(F.concat(F.split_part("slug", F.lit("-"), F.lit(1)), F.lit("."), i)).alias("key"))


@query("SELECT id, 'Dear ' || username || ', {x} ' || CASE WHEN deleted THEN '' ELSE display_name END AS text FROM u", USERS)
def interpolation(spark, d):
    """A template with names filled in: unknown ones stay, null values vanish."""
    values = F.create_map(F.lit("name"), F.col("username"), F.lit("of"), F.when(~F.col("deleted"), F.col("display_name")))
    return users(spark, d).select("id", text.interpolated(F.lit("Dear {name}, {x} {of}"), values).alias("text"))


@query("SELECT id, CAST(10 AS VARCHAR) || '.' || (id % 256) || '.0.' || (id % 7) AS shown, 96 + 24 AS prefix FROM c", COMMENTS)
def addresses(spark, d):
    """Addresses to bytes and back, and the length of a network in 16-byte form."""
    i = F.col("id")
    ip = F.concat(F.lit("10."), (i % 256).cast("string"), F.lit(".0."), (i % 7).cast("string"))
    return comments(spark, d).select("id", net.binary_to_ip(net.ip_to_binary(ip)).alias("shown"), net.cidr(F.concat(ip, F.lit("/24")))["prefix"].alias("prefix"))


@query("SELECT c.id, s_suppkey AS ban FROM c JOIN supplier ON (c.id % 64) // 4 = s_suppkey % 16 AND s_nationkey <> 3 WHERE c.id % 2 = 0", COMMENTS)
def cidr_match_v6(spark, d):
    """IPv6 addresses and every ban whose network of 126 bits holds them."""
    hosts = comments(spark, d).where("id % 2 = 0").select("id", F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("id") % 64))).alias("ip"))
    bans = table(spark, d, "supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").alias("ban"), F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("s_suppkey") % 16 * 4)), F.lit("/126")).alias("network"))
    return net.address_matches(hosts, bans, "ip", "network").select("id", "ban")


@query("SELECT site, string_agg(DISTINCT slug, ',' ORDER BY slug) AS slugs FROM p GROUP BY site", PAGES)
def grouped_slugs(spark, d):
    return grouping.multimap(pages(spark, d), "site", "slug", "slugs").select("site", F.array_join("slugs", ",").alias("slugs"))
