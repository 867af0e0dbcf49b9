"""Semantics at the edges: pages, trees, closures, writes, policies, networks, mail, HTML and streams."""

import ipaddress
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agoraflow.functions import ids, mail, net, sanitize, text, web
from agoraflow.operators import dml, hierarchy, joins, lookup, paging, policy, temporal
from agoraflow.sources import catalog, mailbox, tables, uploads
from agoraflow.streaming import keyed


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_pages(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(7)], "id int, at int")
    ids_of = lambda p: [r.id for r in paging.page_of(df, "at", "id", p).collect()]
    assert ids_of(paging.Page(1, 3)) == [6, 4, 5] and ids_of(paging.Page(3, 3)) == [1] and ids_of(paging.Page(9, 3)) == []
    assert ids_of(paging.Page(9, 3).clamped(7)) == [1] and len(ids_of(paging.Page(1, 0))) == 7
    assert paging.Page.requested("x", "-5", "ASC") == paging.Page(1, 0, False) and paging.Page(1, 3).count(0) == 1
    assert paging.Page(3, 3).label(7) == (7, 7) and paging.Page(1, 3).label(0) == (0, 0)


def test_tree_drops_cycles_and_roots_orphans(spark):
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 99), (1, 5, 6), (1, 6, 5), (1, 7, 7), (2, 8, 1), (1, 9, 1)]
    df = spark.createDataFrame(rows, "page int, id int, reply_to int")
    got = {(r.page, r.id): (r.depth, r.has_children, r.position) for r in hierarchy.reply_tree(df, "id", "reply_to", ["page"], ["id"]).collect()}
    assert got == {(1, 1): (0, True, 1), (1, 2): (1, True, 2), (1, 3): (2, False, 3), (1, 9): (1, False, 4), (1, 4): (0, False, 5), (2, 8): (0, False, 1)}


def test_deep_tree_and_recursive_query(spark):
    df = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(20)], "page int, id int, reply_to int")
    assert max(r.depth for r in hierarchy.reply_tree(df, "id", "reply_to", ["page"], ["id"]).collect()) == 19
    df.createOrReplaceTempView("replies")
    assert max(r.depth for r in spark.sql(hierarchy.reply_tree_sql("replies", "page", "id", "reply_to", "id")).collect()) == 19


def test_closure_and_direct_children(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "parent int, child int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node int")
    pairs = hierarchy.closure(edges, nodes)
    assert {(r.ancestor, r.descendant): r.depth for r in pairs.collect() if r.depth} == {(1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 3): 1, (2, 4): 2, (3, 4): 1, (1, 5): 1}
    assert {tuple(r) for r in hierarchy.direct_children(pairs).collect()} == {(1, 2), (2, 3), (3, 4), (1, 5)}
    grown = hierarchy.inserted(pairs, 9, 3)
    assert {r.ancestor for r in grown.where("descendant = 9").collect()} == {1, 2, 3, 9}
    assert {tuple(r) for r in hierarchy.removed(grown, 2).where("ancestor <> descendant").select("ancestor", "descendant").collect()} == {(1, 3), (1, 4), (3, 4), (1, 5), (1, 9), (3, 9)}


def test_writes(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, 1), (3, "c", 1)], "id int, name string, flag int")
    assert [r.name for r in dml.updated(df, F.col("name") == "a", name="z").orderBy("id").collect()] == ["z", None, "c"]
    assert [r.id for r in dml.deleted(df, F.col("name") == "a").orderBy("id").collect()] == [2, 3]
    assert [r.flag for r in dml.toggled(df, F.col("id") > 1, "flag", {"flag"}).orderBy("id").collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        dml.toggled(df, F.lit(True), "id", {"flag"})
    changes = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (4, "d", 0)], "id int, name string, flag int")
    assert [(r.id, r.name) for r in dml.upserted(df, changes, ["id"], "flag").orderBy("id").collect()] == [(1, "a"), (2, "new"), (3, "c"), (4, "d")]
    assert [r.id for r in dml.insert_ignored(df, changes, ["id"]).orderBy("id").collect()] == [1, 2, 3, 4]
    gone = df.where("id = 1")
    child = spark.createDataFrame([(1,), (2,), (None,)], "fk int")
    assert sorted(str(r.fk) for r in dml.cascaded(child, gone, "fk", "id").collect()) == ["2", "None"]
    assert sorted(str(r.fk) for r in dml.set_null(child, gone, "fk", "id").collect()) == ["2", "None", "None"]


def test_lookups(spark):
    df = spark.createDataFrame([("Ann", None), ("bob", "x%"), (None, "xy")], "name string, code string")
    assert lookup.by_key(df, code=None).count() == 1 and lookup.by_any_fold(df, "ANN", "name", "code").count() == 1
    assert lookup.like_prefix(df, "code", "x_").count() == 2 and lookup.like_prefix(df, "code", "x%", escaped=True).count() == 1
    assert [r.n for r in lookup.missing(spark.createDataFrame([("ANN",), ("eve",)], "n string"), df, "n", "name").collect()] == ["eve"]
    assert lookup.exists(df) and not lookup.exists(df.limit(0))
    assert lookup.as_map(df.where("name IS NOT NULL"), "name", "code").first().entries == {"Ann": None, "bob": "x%"}


def test_deep_trees_are_whole_or_refused(spark):
    rows = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(5)], "s int, id int, up int")
    assert hierarchy.reply_tree(rows, "id", "up", ["s"], ["id"], max_depth=4).count() == 5
    with pytest.raises(ValueError, match="max_depth"):
        hierarchy.reply_tree(rows, "id", "up", ["s"], ["id"], max_depth=3)


def test_closure_is_whole_or_refused(spark):
    edges, nodes = spark.createDataFrame([(i, i + 1) for i in range(4)], "parent int, child int"), spark.createDataFrame([(i,) for i in range(5)], "node int")
    assert hierarchy.closure(edges, nodes, max_depth=4).count() == 15
    with pytest.raises(ValueError, match="max_depth"):
        hierarchy.closure(edges, nodes, max_depth=2)


def test_policies(spark):
    m = lambda p, v: one(spark, policy.pattern_matches(F.lit(p), F.lit(v)))
    assert m("*", "x") and m("a.*", "a.b") and not m("a.*", "ab.c") and m("a.b", "a.b") and not m("a.b", "a")
    assert one(spark, policy.own_verdict(F.lit("c.edit.own"), F.lit(1), F.lit(2))) is False
    assert one(spark, policy.own_verdict(F.lit("c.edit.own"), F.lit(None).cast("int"), F.lit(2))) is None
    assert one(spark, policy.decided(F.lit(True), F.lit(None).cast("boolean"))) is True
    rules = [{"key": 2, "regex": "b", "checking_for": True, "message": "has b"}, {"key": 1, "regex": "a", "checking_for": False, "message": "no a"}, {"key": 0, "regex": "", "checking_for": True, "message": "empty"}]
    assert [one(spark, policy.regex_rules(F.lit(x), rules)) for x in ("b", "ab", "a")] == ["no a", "has b", None]


def test_time_boundaries(spark):
    at, later = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:01").cast("timestamp")
    assert one(spark, temporal.live(later, at)) and not one(spark, temporal.live(at, at)) and not one(spark, temporal.expired(at, at)) and one(spark, temporal.expired(at, later))
    status = lambda used, same, exp: one(spark, temporal.token_status(F.lit(used), F.lit(same), exp, at))
    assert [status(True, True, later), status(False, False, later), status(False, True, at), status(False, True, F.lit("2023-12-31").cast("timestamp"))] == ["used", "mismatch", "ok", "expired"]
    s = spark.createDataFrame([("a", "A", "b", 90), ("b", "B", None, None), ("c", "C", "b", 10), ("d", "D", "gone", 95)], "id string, data string, replaced_by string, replace_at int")
    assert {r.id: r.served for r in temporal.handed_over(s, F.lit(100), 30).collect()} == {"a": "B", "b": "B", "c": "C", "d": "D"}


def test_networks(spark):
    assert net.parse_network("1.2.3.4") == (b"\0" * 10 + b"\xff\xff\x01\x02\x03\x04", 128) and net.parse_network("10.1.2.3/8") == (b"\0" * 10 + b"\xff\xff\x0a\0\0\0", 104)
    assert [net.parse_network(x) for x in ("1.2.3.4/33", "1.2.3.4/abc", "1.2.3.4/-1", "x", None, "::1/129")] == [None] * 6
    assert net.parse_network(" ::1 ") == (ipaddress.ip_address("::1").packed, 128) and net.shown(net.parse_network("1.2.3.4")[0]) == "1.2.3.4"
    rnd = random.Random(1)
    points = [(rnd.randrange(1 << 32),) for _ in range(200)] + [(0,), ((1 << 32) - 1,)]
    nets = [(p := rnd.randint(0, 32), (n := rnd.choice(points)[0]) >> (32 - p) << (32 - p)) for _ in range(40)]
    got = net.ipv4_matches(spark.createDataFrame(points, "ip long"), spark.createDataFrame(nets, "prefix int, network long"), "ip", "network", "prefix")
    want = sorted((ip, p, n) for (ip,) in points for p, n in nets if ip >> (32 - p) == n >> (32 - p))
    assert sorted((r.ip, r.prefix, r.network) for r in got.collect()) == want
    shown = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("1.2.3",), (None,)], "a string").select(net.ipv4_number(F.col("a")).alias("n"), net.binary_to_ip(net.ip_to_binary("a")).alias("t"), net.cidr("a").alias("c")).collect()
    assert [r.n for r in shown] == [16909060, None, None, None] and shown[0].t == "1.2.3.4" and shown[0].c.prefix == 128 and shown[1].c.network is None


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=80), st.binary(min_size=1, max_size=16))
def test_keystream_is_an_involution(data, key):
    x = lambda v: bytes(a ^ b for a, b in zip(v, ids.keystream(key, len(v)), strict=True))
    assert x(x(data)) == data


def test_ids(spark):
    assert one(spark, ids.hex_id(ids.binary_id(F.lit("00ff")))) == "00ff" and one(spark, F.length(ids.new_id())) == 16
    key = F.lit(b"0" * 32)
    assert one(spark, ids.opened(ids.sealed(F.lit("v"), key), key)) == "v" and one(spark, ids.opened(ids.sealed(F.lit("v"), key), F.lit(b"1" * 32))) == ""
    assert ids.same_digest("a", "a") and not ids.same_digest("a", "b")


def test_texts(spark):
    d = lambda n: one(spark, text.duration(F.lit(n)))
    assert [d(n) for n in (0, 59, 60, 86400, 90061, 31536000 + 2592000)] == ["0s", "59s", "1m", "1d", "1d 1h", "1y 1mo"]
    assert [one(spark, text.byte_size(F.lit(n))) for n in (1023, 1024, 1048576)] == ["1023 B", "1.0 KB", "1.0 MB"]
    assert [one(spark, text.email_of(F.lit(x))) for x in ("Ann <A@x.Y>", " b@c ", "none")] == ["a@x.y", "b@c", None]
    assert one(spark, text.interpolated(F.lit("{a} and {b} {c}"), F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit(None).cast("string")))) == "{b} and  {c}"
    assert one(spark, text.quoted(F.lit("a\nb"))) == "> a\n> b" and one(spark, text.class_name(F.lit("my_page"))) == "MyPage" and one(spark, text.code_key(F.lit("a/b.c-d"))) == "a__b__c__d"
    assert [one(spark, text.typed_bool(F.lit(x))) for x in ("ON", "0", "maybe")] == [True, False, None] and one(spark, text.lenient_int(F.lit("x"), 7)) == 7
    assert one(spark, text.css_minified(F.lit("a { /* x */ color : red ; }"))) == "a{color:red;}" and one(spark, text.status_class(F.lit(404))) == 4
    assert one(spark, text.display_name(F.lit(None).cast("string"), F.lit(""))) == "Anonymous"


def test_web(spark):
    assert one(spark, web.segments(F.lit("http://h/base/a%2Fb//c+d?x=/y#z"), "/base")) == ["a/b", "c+d"]
    assert one(spark, web.query_params(F.lit("http://h/?a=1&b=2#c"))) == {"a": "1", "b": "2"} and one(spark, web.query_params(F.lit("/x"))) == {}
    d = lambda v: (F.lit(v), F.lit(1))
    assert one(spark, web.state_path(d(1), d(2), d(1))) == "1/2" and one(spark, web.state_path(d(1), d(1))) == "" and one(spark, web.state_query(p=d(1), q=d(3))) == "q=3"
    assert one(spark, web.bearer(F.lit("bearer abc"))) == "abc" and one(spark, web.page_url(F.lit("/x"), F.lit("a b"), True)) == "/x/a+b"
    assert one(spark, web.headers(F.lit("A: 1\r\n two\r\nB: x:y"))) == {"a": "1 two", "b": "x:y"} and one(spark, web.head_and_body(F.lit("a\r\n\r\nb\n\nc"))) == ["a", "b\n\nc"]


def test_mail(spark, tmp_path):
    raw = mail.built_message({"Subject": "=?utf-8?q?caf=C3=A9?=", "From": "a@b"}, "hé", "<p>hé</p>")
    got = mail.parsed_message(raw.encode())
    assert (got["subject"], got["text"].strip(), got["html"].strip()) == ("café", "hé", "<p>hé</p>")
    attached = b"Content-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain; charset=latin-1\n\nh\xe9\n--x\nContent-Disposition: attachment; filename=a.bin\nContent-Transfer-Encoding: base64\n\nAAEC\n--x--\n"
    got = mail.parsed_message(attached)
    assert got["text"].strip() == "hé" and got["attachments"] == [{"name": "a.bin", "type": "text/plain", "size": 3}]
    (tmp_path / "m.eml").write_bytes(attached)
    assert mailbox.eml_files(spark, str(tmp_path)).first().message.attachments[0]["size"] == 3
    assert mail.envelope_tokens('("a \\"b\\"" NIL (x y))') == [['a "b"', None, ["x", "y"]]] and mail.addresses([["Ann", None, "a", "b"], [None, None, "c", "d"]]) == "Ann <a@b>, c@d"


def test_mailbox(spark):
    m = spark.createDataFrame([("INBOX", i, ["\\Seen"] if i % 2 else []) for i in range(1, 13)], "folder string, uid int, flags array<string>")
    assert mailbox.status(m).first().asDict() == {"folder": "INBOX", "total": 12, "unseen": 6, "recent": 0}
    assert [r.uid for r in mailbox.header_page(m, "INBOX", 2, 1).collect()] == [7, 6, 5, 4, 3]
    assert mailbox.status(mailbox.flagged(m, 2, "\\Seen", True)).first().unseen == 5 and mailbox.moved(m, 2, "Trash").where("folder = 'Trash'").count() == 1
    names = spark.createDataFrame([("b", []), ("INBOX", []), ("a", ["\\Noselect"])], "name string, flags array<string>")
    assert [r.name for r in mailbox.folders(names).collect()] == ["INBOX", "b"]
    lines = spark.createDataFrame([("ann:1",), ("bob:2",)], "value string")
    assert [r.value for r in mailbox.accounts(lines, "ann", None).collect()] == ["bob:2"] and mailbox.accounts(lines, "ann", "ann:9").first().value == "ann:9"


def test_sanitize():
    bad = '<p onclick=x style="background:url(http://x)">a<script>1</script><img src=http://t><img src="cid:1"><a href="javascript:1">j</a><a href=http://x>l</a><iframe>z</iframe></p>'
    safe = sanitize.sanitized(bad)
    assert not any(x in safe for x in ("onclick", "<script", "javascript:", "iframe", 'img src="http', "url(")) and 'src="cid:1"' in safe and "noopener" in safe
    assert 'src="http://t"' in sanitize.sanitized(bad, trusted=True) and sanitize.sanitized(None) is None


def test_catalogs(spark):
    own = catalog.effective(catalog.catalog(spark, ("en", {"a": "1"}), ("en", {"a": "2", 5: "x", "f": len})))
    assert [(r.key, r.template) for r in own.collect()] == [("a", "2")]
    c = catalog.config(spark, {"Mail": {"x": 1, "y": 2}}, {"Mail": {"x": 3}})
    assert [(r.key, r.value) for r in c.collect()] == [("x", "3")] and catalog.unused(c, c.limit(0)).count() == 1
    assert tables.statements("-- no\nA;\n B ;") == ["A", "B"]


def test_uploads(spark):
    df = spark.createDataFrame([([1, 0, 2], ["a", "b", ""], [True, True, True], ["m", "n", "o"])], "key array<int>, pattern array<string>, enabled array<boolean>, message array<string>")
    assert [r.pattern for r in uploads.form_rules(df).collect()] == ["a"]
    df = spark.createDataFrame([({"a": None}, {"a": "q", "b": "r"})], "body map<string,string>, query map<string,string>")
    assert [df.select(uploads.input_value("body", "query", k, "d")).first()[0] for k in "abc"] == [None, "r", "d"]


def test_matrix_and_spans(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "r int"), spark.createDataFrame([("x",), ("y",)], "c string")
    held = spark.createDataFrame([(1, "x"), (1, "x")], "r int, c string")
    assert sorted((r.r, r.c, r.held) for r in joins.flag_matrix(a, b, held, ["r", "c"]).collect()) == [(1, "x", True), (1, "y", False), (2, "x", False), (2, "y", False)]
    spans = spark.createDataFrame([(1, 10, 20)], "r int, s int, e int")
    points = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20), (2, 15)], "r int, at int")
    assert sorted(r.at for r in joins.within(points, spans, ["r"], "at", "s", "e").collect()) == [10, 19]


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_flood_stream_equals_batch(spark, tmp_path):
    from conftest import SF

    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    got = run_stream(keyed.flood_stream(stream, "user_id", "ts", "event_id", 600), "floods").count()
    assert got == rows.count()
    single = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.gap_us, r.flood) for r in run_stream(keyed.flood_stream(single, "user_id", "ts", "event_id", 600), "floods1").collect()}
    want = {r.event_id: (r.gap_us, r.flood) for r in temporal.flooded(rows, "user_id", "ts", "event_id", 600).collect()}
    assert got == want


def test_read_once_and_upsert_streams(spark, tmp_path):
    values = spark.createDataFrame([("k", "v", "put"), ("k", None, "pull"), ("k", None, "pull")], "k string, v string, kind string").coalesce(1)
    values.write.parquet(str(tmp_path / "v"))
    got = run_stream(keyed.read_once(spark.readStream.schema(values.schema).parquet(str(tmp_path / "v")), "k", "v", "kind"), "once").collect()
    assert [r.v for r in got] == ["v", None]
    write = keyed.upsert_batches(f"file://{tmp_path}/t", ["id"], "n")
    for number, rows in enumerate([[(1, 1), (2, 1)], [(2, 5), (2, 4), (3, 1)]]):
        write(spark.createDataFrame(rows, "id int, n int"), number)
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [(1, 1), (2, 5), (3, 1)]


def test_batches_that_come_again_or_stop_in_between(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = keyed.upsert_batches(path, ["id"], "n")
    first, second = (spark.createDataFrame(rows, "id int, n int") for rows in ([(1, 1), (2, 1)], [(2, 5)]))
    write(first, 0)
    write(spark.createDataFrame([(1, 9)], "id int, n int"), 0)  # the number is known: nothing changes
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 1)]
    (tmp_path / "t").rename(tmp_path / "t.old")  # stopped between the two renames
    write(second, 1)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 5)] and not (tmp_path / "t.old").exists()


def test_statements_keep_quotes():
    script = "-- one; two\nINSERT INTO t VALUES ('a;b', 'it''s -- no'); /* x;y */ SELECT 1 - 2;\n# z;\nSELECT \"q;\", `c;d`"
    assert tables.statements(script) == ["INSERT INTO t VALUES ('a;b', 'it''s -- no')", "SELECT 1 - 2", 'SELECT "q;", `c;d`']


def test_groups_replaced_beside_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, g string")
    assert sorted(r.id for r in dml.replaced_group(df, "g", "a", spark.createDataFrame([(9, "a")], df.schema)).collect()) == [2, 3, 9]


def test_matrix_of_too_many_columns(spark, monkeypatch):
    monkeypatch.setattr(joins, "MATRIX_COLUMNS", 2)
    rows = spark.createDataFrame([(1,)], "r int")
    held = spark.createDataFrame([("a", 1)], "c string, r int")
    two = spark.createDataFrame([("a",), ("b",)], "c string")
    assert sorted((r.c, r.held) for r in joins.flag_matrix(rows, two, held, ["r", "c"]).collect()) == [("a", True), ("b", False)]
    with pytest.raises(ValueError, match="more than 2"):
        joins.flag_matrix(rows, two.unionByName(spark.createDataFrame([("c",)], "c string")), held, ["r", "c"])


def test_scheme_with_a_tab_is_a_script():
    cleaner = sanitize._Cleaner(True)
    cleaner.feed('<a href="java\tscript:x()">a</a><img src="java\nscript:y()" lowsrc="http://x/y">')
    text = "".join(cleaner.out)
    assert "script:x" not in text and ' src="' not in text and "<img data-blocked-src" in text


def test_addresses_of_both_kinds_in_networks(spark):
    points = spark.createDataFrame([(1, "10.0.0.7"), (2, "2001:db8::5"), (3, "junk"), (4, None), (5, "11.0.0.1")], "id int, ip string")
    nets = spark.createDataFrame([("a", "10.0.0.0/8"), ("b", "10.0.0.7"), ("c", "2001:db8::/32"), ("d", "::/0"), ("e", "bad/8"), ("f", "10.0.0.0/33")], "net string, cidr string")
    got = sorted((r.id, r.net) for r in net.address_matches(points, nets, "ip", "cidr").collect())
    assert got == [(1, "a"), (1, "b"), (1, "d"), (2, "c"), (2, "d"), (5, "d")]
    assert net.address_matches(points, nets.limit(0), "ip", "cidr").count() == 0
