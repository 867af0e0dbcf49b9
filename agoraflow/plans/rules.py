"""Policies, rule pipelines, time-based state and column functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoraflow.functions import ids, net, sanitize, text, web
from agoraflow.operators import joins, policy, temporal
from agoraflow.sources.tables import table

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


_GRANTS = [("ADMIN", "*"), ("MOD", "comment.*"), ("MOD", "news.read"), ("USER", "comment.post"), ("USER", "news.read")]
_ASKED = ["comment.post", "comment.delete", "commentary.read", "news.read", "news.write", "user.ban"]


@query("""WITH g(role, pattern) AS (VALUES ('ADMIN', '*'), ('MOD', 'comment.*'), ('MOD', 'news.read'), ('USER', 'comment.post'), ('USER', 'news.read')),
a(permission) AS (VALUES ('comment.post'), ('comment.delete'), ('commentary.read'), ('news.read'), ('news.write'), ('user.ban')),
r(role) AS (VALUES ('ADMIN'), ('MOD'), ('USER'), ('GUEST'))
SELECT r.role, a.permission, EXISTS (SELECT 1 FROM g WHERE g.role = r.role AND (g.pattern = '*' OR g.pattern = a.permission
OR (g.pattern LIKE '%.*' AND starts_with(a.permission, left(g.pattern, length(g.pattern) - 1))))) AS allowed FROM r, a""")
def permission_match(spark, d):
    """Roles and the permissions that their grants cover."""
    asked = spark.createDataFrame([(r, p) for r in ("ADMIN", "MOD", "USER", "GUEST") for p in _ASKED], "role string, permission string")
    return policy.granted(asked, spark.createDataFrame(_GRANTS, "role string, pattern string"))


@query("""WITH e AS (SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 7 WHEN 'view' THEN 1 ELSE 3 END AS level FROM events),
o(code, level) AS (VALUES ('view', 5), ('signup', 0)), g(code, group_name) AS (VALUES ('view', 'MOD'), ('error', 'MOD'), ('click', 'USER'), ('signup', 'MOD'))
SELECT e.event_id, e.event_type, coalesce(o.level, e.level) AS effective_level FROM e LEFT JOIN o ON e.event_type = o.code
WHERE coalesce(o.level, e.level) >= 3 AND e.event_type IN (SELECT code FROM g WHERE group_name = 'MOD')""")
def visibility_filter(spark, d):
    """Diagnostics at or above a level after overrides that a group may see."""
    rows = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", 7).when(F.col("event_type") == "view", 1).otherwise(3).alias("level"))
    over = spark.createDataFrame([("view", 5), ("signup", 0)], "code string, level int")
    groups = spark.createDataFrame([("view", "MOD"), ("error", "MOD"), ("click", "USER"), ("signup", "MOD")], "code string, group_name string")
    return policy.visible(rows, over, groups, "event_type", "level", "MOD", 3).select("event_id", "event_type", "effective_level")


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) >= 3000 THEN 'too_long'
WHEN length(text) - length(replace(text, chr(10), '')) >= 10 THEN 'too_many_lines' WHEN regexp_matches(text, 'https?://') THEN 'link' END AS error FROM documents""")
def rule_pipeline(spark, d):
    """The first broken rule of each text."""
    t = F.col("text")
    rules = [{"key": 30, "regex": "https?://", "checking_for": True, "message": "link"}, {"key": 20, "regex": "x{99}", "checking_for": True, "enabled": False, "message": "off"}]
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    first = policy.first_error((t.isNull() | (F.trim(t) == ""), "empty"), (F.length(t) >= 3000, "too_long"), (lines >= 10, "too_many_lines"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(first, policy.regex_rules(t, rules)).alias("error"))


@query("""SELECT event_id, gap_us, coalesce(gap_us < 600000000, false) AS flood FROM (
SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events)""")
def flood_gap(spark, d):
    """Events that come too soon after the user's last."""
    return temporal.flooded(_events(spark, d), "user_id", "ts", "event_id", 600).select("event_id", "gap_us", "flood")


@query("""SELECT event_id, tries, CASE WHEN tries > 4 THEN 86400 WHEN tries > 2 THEN 3600 WHEN tries > 1 THEN 60 ELSE 0 END AS penalty FROM (
SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS tries FROM events)""")
def penalty_window(spark, d):
    """Tries within a sliding day and the penalty of the round they reach."""
    ladder = [{"max_tries": 1, "penalty": 60, "enabled": True}, {"max_tries": 2, "penalty": 3600, "enabled": True}, {"max_tries": 3, "penalty": 7200, "enabled": False}, {"max_tries": 4, "penalty": 86400, "enabled": True}]
    counted = temporal.recent_count(_events(spark, d), ["user_id", "event_type"], "ts", 86400, "tries")
    return counted.select("event_id", "tries", temporal.penalty_round(F.col("tries"), ladder).alias("penalty"))


@query("""SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM events m WHERE m.event_type = 'error' AND m.user_id = e.user_id AND e.ts > m.ts AND e.ts < m.ts + INTERVAL 1 HOUR)""")
def mute_join(spark, d):
    """Events while their user is muted: an hour after each error."""
    e = _events(spark, d)
    spans = e.where("event_type = 'error'").select("user_id", F.expr("ts + INTERVAL 1 MICROSECOND").alias("start"), F.expr("ts + INTERVAL 1 HOUR").alias("end"))
    return joins.within(e, spans, ["user_id"], "ts", "start", "end").select("event_id", "user_id")


@query("SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS purged, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS kept FROM events")
def ttl_purge(spark, d):
    """Rows past a cutoff, counted and left out."""
    cutoff = F.lit("2024-01-15").cast("timestamp")
    gone = temporal.expired(F.col("ts"), cutoff)
    return _events(spark, d).agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept"))


@query("""SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS attempts FROM (
SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)""")
def attempts_since_success(spark, d):
    """Failures since the user's last success."""
    t = F.col("event_type")
    return temporal.since_reset(_events(spark, d), "user_id", "ts", "event_id", t == "error", t == "purchase", "attempts").select("event_id", "attempts")


@query("""SELECT s.event_id AS id, CASE WHEN s.event_id % 3 = 0 AND 20000 - s.event_id <= 19000 THEN coalesce(n.props, s.props) ELSE s.props END AS served
FROM events s LEFT JOIN events n ON CASE WHEN s.event_id % 3 = 0 THEN s.event_id + 1 END = n.event_id""")
def handover(spark, d):
    """Sessions served by their successor, one hop, within the grace."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("data"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 1).alias("replaced_by"), F.col("event_id").alias("replace_at"))
    return temporal.handed_over(rows, F.lit(20000), 19000).select("id", "served")


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN 'used' WHEN event_type = 'error' THEN 'mismatch' WHEN ts < TIMESTAMP '2024-01-10' THEN 'expired' ELSE 'ok' END AS status,
ts > TIMESTAMP '2024-01-10' AS live FROM events""")
def token_lifecycle(spark, d):
    """The state of tokens at an instant."""
    t, at = F.col("event_type"), F.lit("2024-01-10").cast("timestamp")
    return _events(spark, d).select("event_id", temporal.token_status(t == "signup", t != "error", F.col("ts"), at).alias("status"), temporal.live(F.col("ts"), at).alias("live"))


@query("""WITH n(network, prefix, label) AS (VALUES (167772160::BIGINT, 8, 'ten'), (167772160, 30, 'small'), (167772196, 31, 'pair'), (167772290, 32, 'one'), (0, 0, 'all')),
p AS (SELECT DISTINCT user_id, 167772160 + user_id AS ip FROM events)
SELECT p.user_id, n.label FROM p JOIN n ON p.ip // (1::BIGINT << (32 - n.prefix)) = n.network // (1::BIGINT << (32 - n.prefix))""")
def cidr_match(spark, d):
    """Addresses with every network that holds them."""
    nets = spark.createDataFrame([("10.0.0.0", 8, "ten"), ("10.0.0.0", 30, "small"), ("10.0.0.36", 31, "pair"), ("10.0.0.130", 32, "one"), ("0.0.0.0", 0, "all")], "text string, prefix int, label string")
    nets = nets.select(net.ipv4_number(F.col("text")).alias("network"), "prefix", "label")
    points = table(spark, d, "events").select("user_id", net.ipv4_text(F.lit(167772160) + F.col("user_id")).alias("ip")).distinct().select("user_id", net.ipv4_number(F.col("ip")).alias("number"))
    return net.ipv4_matches(points, nets, "number", "network", "prefix").select("user_id", "label")


_PARTS = ", ".join(f"CASE WHEN {e} > 0 THEN {e} || '{u}' END" for e, u in (("s // 31536000", "y"), ("s % 31536000 // 2592000", "mo"), ("s % 31536000 % 2592000 // 604800", "w"), ("s % 31536000 % 2592000 % 604800 // 86400", "d"), ("s % 31536000 % 2592000 % 604800 % 86400 // 3600", "h"), ("s % 3600 // 60", "m"), ("s % 60", "s")))


@query(f"SELECT doc_id, CASE WHEN s = 0 THEN '0s' ELSE array_to_string(list_slice(list_filter([{_PARTS}], lambda x: x IS NOT NULL), 1, 2), ' ') END AS shown FROM (SELECT doc_id, n_chars * n_chars AS s FROM documents)")
def duration_fmt(spark, d):
    return table(spark, d, "documents").select("doc_id", text.duration(F.col("n_chars") * F.col("n_chars")).alias("shown"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024, 1)) || ' KB' ELSE printf('%.1f', round(n / 1048576, 1)) || ' MB' END AS shown
FROM (SELECT doc_id, n_chars * 100 AS n FROM documents)""")
def bytes_fmt(spark, d):
    return table(spark, d, "documents").select("doc_id", text.byte_size(F.col("n_chars") * 100).alias("shown"))


@query("""SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/'), lambda x: x <> ''), '|') AS parts FROM pages""")
def url_segments(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(web.segments(F.col("url")), "|").alias("parts"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS source, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def query_params(spark, d):
    """Parameters and host of addresses."""
    q = web.query_params(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.try_element_at(q, F.lit("page")).alias("page"), F.try_element_at(q, F.lit("utm_source")).alias("source"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("SELECT doc_id, sha256(text) AS digest, lower(hex(encode(source))) AS hex_id, lower(left(sha256(source), 6)) AS colour FROM documents")
def hash_ids(spark, d):
    """Digests, and binary ids through hexadecimal text and back."""
    back = ids.hex_id(ids.binary_id(ids.hex_id(F.col("source").cast("binary"))))
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), back.alias("hex_id"), F.left(text.identicon_seed(F.col("source"), F.lit(None).cast("string")), F.lit(6)).alias("colour"))


@query("""SELECT c_custkey, 'Re: ' || c_name AS subject, regexp_replace(c_name, '[^a-zA-Z0-9._-]', '_', 'g') AS file_name,
CASE WHEN regexp_matches(CAST(c_nationkey AS VARCHAR), '^-?[0-9]+$') THEN c_nationkey::BIGINT END AS number, c_nationkey = 1 AS flag_one FROM customer""")
def scalar_text(spark, d):
    """Subjects, file names and typed readings."""
    n, s = F.col("c_nationkey").cast("string"), F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", text.reply_subject(F.concat(F.lit("RE: re: "), s)).alias("subject"), text.safe_file_name(s).alias("file_name"), text.typed_int(n).alias("number"), F.coalesce(text.typed_bool(n), F.lit(False)).alias("flag_one"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_escaped(F.col("url")).alias("escaped"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%d %b %Y %H:%M') AS shown FROM orders")
def date_formats(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd").alias("day"), F.unix_timestamp(at).alias("seconds"), F.date_format(at, "dd MMM yyyy HH:mm").alias("shown"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_props(spark, d):
    """A number out of JSON text."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(None)
def html_sanitize(spark, d):
    """Pages without active content."""
    return table(spark, d, "pages").select("page_id", sanitize.sanitize("html").alias("safe"))
