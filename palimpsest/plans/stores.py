"""The registered queries of stored tables, histories with merges, exchanges of chunks, and logs read as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import xml as XM
from palimpsest.operators import diff as D
from palimpsest.operators import history as H
from palimpsest.operators import ordered as O
from palimpsest.operators import space as SP
from palimpsest.operators import sync
from palimpsest.operators import trees as T
from palimpsest.operators.pointers import NumberedFiles
from palimpsest.operators.store import Conflict, Store
from palimpsest.plans.queries import OVERLAY, query
from palimpsest.session import dealt, median, shared_folder, table, written
from palimpsest.sources import files as S
from palimpsest.sources import folder as W
from palimpsest.streaming.log_source import NumberedLog
from palimpsest.streaming.txn import committed


def _folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def orders_store(spark, d) -> Store:
    """The orders under three transactions: patches, removals, and copies of every 29th under a negative key."""
    t = Store(spark, _folder(spark, "store")).begin()
    t.base_at("orders", f"{d.rstrip('/')}/orders.parquet", ("o_orderkey",))
    t = t.commit("opened").begin()
    t.update("orders", F.col("o_orderkey") % 13 == 0, {"o_orderstatus": F.lit("X")})
    t.update("orders", F.col("o_orderkey") % 26 == 0, {"o_orderpriority": F.lit(None).cast("string")})
    t = t.commit("patched").begin()
    t.delete("orders", F.col("o_orderkey") % 17 == 0)
    new = table(spark, d, "orders").filter("o_orderkey % 29 = 0").withColumns({"o_orderkey": -F.col("o_orderkey") - 1, "o_orderstatus": F.lit("N")})
    t.insert("orders", new)
    return t.commit("cut and copied")


@query(OVERLAY + "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM v")
def store_reopened(spark, d):
    """The rows as another session finds them by the store's path alone."""
    again = Store(spark.newSession(), orders_store(spark, d).path)
    return spark.read.schema(again.state.tables["orders"].kind).parquet(_copied(again)).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _copied(store: Store) -> str:
    """The rows of another session's store, handed over as a compacted base: a frame belongs to the session that made it."""
    t = store.begin()
    t.compact("orders")
    return t.commit().state.tables["orders"].base


@query("""
SELECT CAST(seq AS BIGINT) AS seq, op, o_orderkey, old_status, new_status FROM (
  SELECT 2 AS seq, 'U' AS op, o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS old_status, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS new_status FROM orders WHERE o_orderkey % 26 = 0
  UNION ALL SELECT 3, 'D', o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END, NULL FROM orders WHERE o_orderkey % 17 = 0
  UNION ALL SELECT 4, 'I', -o_orderkey - 1, NULL, 'N' FROM orders WHERE o_orderkey % 29 = 0)""")
def store_journal(spark, d):
    """What the second and later statements did, read back from the store."""
    rows = Store(spark, orders_store(spark, d).path).journal("orders", since=2)
    return rows.select("seq", "op", "o_orderkey", F.col("old.o_orderstatus").alias("old_status"), F.col("new.o_orderstatus").alias("new_status"))


@query("SELECT c_custkey, count(o_orderkey) AS n, 'kept' AS main FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY 1")
def store_all_or_nothing(spark, d):
    """Customers, orders and a reference moved in one commit; a writer who began before it and touches the orders is refused."""
    t = Store(spark, _folder(spark, "store")).begin()
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        t.base_at(name, f"{d.rstrip('/')}/{name}.parquet", (key,))
    first = t.commit()
    t, late = first.begin(), first.begin()
    t.delete("customer", F.col("c_acctbal") < 0)
    t.delete("orders", F.col("o_orderstatus") == "F")
    t.set_ref("main", None, "kept")
    late.delete("orders", F.lit(True))
    late.set_ref("main", None, "lost")
    now = t.commit()
    try:
        late.commit()
        raise AssertionError("the second writer was let in")
    except Conflict:
        now = Store(spark, now.path)
    own = now.table("customer").join(now.table("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return own.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")).withColumn("main", F.lit(now.ref("main")))


# Histories with merges: each customer's orders as commits upon commits, every second one with the order of half its number as second parent

MERGES = """
WITH RECURSIVE o AS (SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey > 0 THEN o_orderkey // 2 END AS q FROM orders),
e AS (SELECT k, p AS ref FROM o WHERE p IS NOT NULL UNION SELECT k, q FROM o WHERE q IN (SELECT o_orderkey FROM orders)),
asked AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 = 0 UNION SELECT b.o_orderkey FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey - 5 WHERE a.o_orderkey % 7 = 0),
anc(k, n) AS (SELECT k, k FROM asked UNION SELECT anc.k, e.ref FROM anc JOIN e ON e.k = anc.n)"""


def orders_graph(spark, d) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    half = F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderkey") > 0), F.floor(F.col("o_orderkey") / 2))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.array_compact(F.array(before, half)).alias("refs"))


@query(MERGES + ", m AS (SELECT a.o_orderkey AS new, b.o_orderkey AS old FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey // 4 WHERE a.o_orderkey % 7 = 0 UNION SELECT o_orderkey, o_orderkey // 2 FROM orders WHERE o_orderkey % 70 = 0) SELECT new, old, EXISTS (SELECT 1 FROM anc WHERE anc.k = new AND anc.n = old) AS forward FROM m")
def ancestor_merges(spark, d):
    """Moves of a reference from the order of a quarter or of half the number: which need no merge."""
    graph = written(orders_graph(spark, d), "graph")
    key = F.col("node")
    moves = graph.filter(key % 7 == 0).select(key.alias("new"), F.floor(key / 4).alias("old")).join(graph.select(key.alias("old")), "old", "left_semi").select("new", "old")
    halves = graph.filter(key % 70 == 0).select(key.alias("new"), F.floor(key / 2).alias("old"))
    return H.fast_forwards(graph, moves.unionByName(halves).distinct())


@query(MERGES + """
, pairs AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey - 5 WHERE a.o_orderkey % 7 = 0),
common AS (SELECT a, b, x.n FROM pairs JOIN anc x ON x.k = a JOIN anc y ON y.k = b AND y.n = x.n),
up(k, n) AS (SELECT DISTINCT n, n FROM common UNION SELECT up.k, e.ref FROM up JOIN e ON e.k = up.n)
SELECT a, b, n AS base FROM common c WHERE NOT EXISTS (SELECT 1 FROM common o JOIN up ON up.k = o.n AND up.n = c.n WHERE o.a = c.a AND o.b = c.b AND o.n <> c.n)""")
def merge_bases(spark, d):
    """Where the lines of two orders five numbers apart meet first."""
    graph = written(orders_graph(spark, d), "graph")
    pairs = graph.filter(F.col("node") % 7 == 0).select(F.col("node").alias("a"), (F.col("node") - 5).alias("b")).join(graph.select(F.col("node").alias("b")), "b", "left_semi")
    return H.merge_bases(graph, pairs.select("a", "b"))


@query("""
WITH c AS (SELECT 'o' || o_orderkey AS hash, o_custkey AS cust, o_orderkey AS k FROM orders), half AS (SELECT median(o_orderkey) AS h FROM orders)
SELECT hash FROM c, half WHERE k > h AND cust % 2 = 0 UNION ALL SELECT 'l' || k || '-' || l_linenumber FROM c JOIN lineitem ON l_orderkey = k, half WHERE k > h AND cust % 2 = 0 GROUP BY 1""")
def push_missing(spark, d):
    """Orders as commits that hold their lines: what a store that has the first half lacks to take the heads of every second customer."""
    from pyspark.sql import Window

    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    leaf = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    of_order = written(dealt(lines.select("l_orderkey", "l_linenumber"), "l_orderkey").distinct(), "lines")
    of_lines = of_order.groupBy("l_orderkey").agg(F.collect_list(leaf).alias("leaves"))
    before = o.withColumn("before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    commits = before.join(of_lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    refs = F.concat(F.array_compact(F.array(F.when(F.col("before").isNotNull(), name("before")))), F.coalesce("leaves", F.array().cast("array<string>")))
    known = o.select("o_orderkey")
    whole = commits.select(name("o_orderkey").alias("hash"), F.lit(b"").alias("data"), refs.alias("refs"))
    leaves = of_order.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(leaf.alias("hash"), "l_orderkey")
    chunks = written(whole.unionByName(leaves.select("hash", F.lit(b"").alias("data"), F.array().cast("array<string>").alias("refs"))), "chunks")
    half = median(o, "o_orderkey")
    have = o.filter(F.col("o_orderkey") <= half).select(name("o_orderkey").alias("hash")).unionByName(leaves.filter(F.col("l_orderkey") <= half).select("hash"))
    heads = o.filter("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).select(name("k").alias("hash"))
    return sync.lacking(chunks, have, heads).select("hash")


# Values that move between nullable columns


@query("SELECT c_custkey, 'changed' AS kind FROM customer WHERE c_custkey % 6 = 0 AND c_mktsegment IS NOT NULL")
def null_moves(spark, d):
    """Every sixth customer's segment moved to another column that was NULL: found by digests of buckets and of stored trees alike."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("a"), F.lit(None).cast("string").alias("b"))
    move = F.col("c_custkey") % 6 == 0
    moved = c.withColumns({"a": F.when(~move, F.col("a")), "b": F.when(move, F.col("a"))})
    trees = T.build(c, ("c_custkey",), 64).diff(T.build(moved, ("c_custkey",), 64)).select("c_custkey")
    return D.diff_by_buckets(c, moved, ["c_custkey"]).join(trees, "c_custkey", "left_semi").select("c_custkey", "kind")


# Posts as files of a folder


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'renamed' ELSE 'customer' END AS slug, c_mktsegment || CASE WHEN c_custkey % 10 = 0 THEN ' again' ELSE '' END AS body FROM customer WHERE c_custkey % 7 <> 0")
def posts_written(spark, d):
    """Customers written as posts, then every tenth renamed with a new text and every seventh removed in one commit, and read back."""
    k, folder = F.col("c_custkey"), _folder(spark, "posts")
    at = lambda slug: F.concat(F.floor(k / 1000).cast("string"), F.lit("/"), k.cast("string"), F.lit(f"-{slug}.md"))  # noqa: E731  # no folder of millions
    text = lambda more: F.concat(F.lit('---\npost_title: "x"\n---\n'), "c_mktsegment", F.lit(more))
    rows = table(spark, d, "customer")
    W.write_files(rows.select(at("customer").alias("path"), text("").alias("text")), folder)
    gone, moved = k % 7 == 0, (k % 10 == 0) & (k % 7 != 0)
    then = rows.filter(gone | moved).select(F.when(gone, at("customer")).otherwise(at("renamed")).alias("path"), F.when(moved, text(" again")).alias("text"), F.when(moved, at("customer")).alias("was"))
    W.write_files(then, folder)
    return S.parsed_posts(W.read_files(spark, folder, r"\.md$")).select("id", "slug", "body")


# Ordered trees


def ordered_orders(spark, d) -> tuple[O.OrderedTree, O.OrderedTree]:
    """The orders as an ordered tree, and a commit upon it that rewrites every 500th and takes out every 700th."""
    o = table(spark, d, "orders")
    first = O.build(o, ("o_orderkey",), 7)
    put = o.filter("o_orderkey % 500 = 0 and o_orderkey % 700 <> 0").withColumn("o_orderstatus", F.lit("X"))
    return first, first.commit(put, o.filter("o_orderkey % 700 = 0").select("o_orderkey"))


@query("SELECT o_orderkey, o_orderstatus AS before, CASE WHEN o_orderkey % 700 = 0 THEN NULL ELSE 'X' END AS after FROM orders WHERE o_orderkey % 500 = 0 OR o_orderkey % 700 = 0")
def ordered_diff(spark, d):
    """What differs between the two versions, found from the roots down."""
    first, then = ordered_orders(spark, d)
    return first.diff(then).select("o_orderkey", F.col("a.o_orderstatus").alias("before"), F.col("b.o_orderstatus").alias("after"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 700 <> 0 AND o_orderkey BETWEEN (SELECT max(o_orderkey) // 4 FROM orders) AND (SELECT max(o_orderkey) // 2 FROM orders)")
def ordered_range(spark, d):
    """The second quarter of the newer version by a range of keys."""
    top = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return ordered_orders(spark, d)[1].range((top // 4,), (top // 2,)).select("o_orderkey", "o_orderstatus")


# Snapshots that share what they hold: month by month the orders of a priority come, and go after some months

SNAPSHOTS = """
WITH s AS (SELECT CAST(o_custkey % 12 AS BIGINT) AS born, CAST(o_custkey % 12 + 1 + o_orderkey % 9 AS BIGINT) AS died, o_orderpriority AS branch, CAST(o_orderkey AS VARCHAR) AS hash, CAST(length(o_orderpriority) + o_orderkey % 50 AS BIGINT) AS size FROM orders),
m AS (SELECT range AS snap FROM range(12)), held AS (SELECT snap, s.* FROM m JOIN s ON born <= snap AND snap < died)"""


@query(SNAPSHOTS + "SELECT snap, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(CASE WHEN greatest(born, 0) = least(died, 12) - 1 THEN size ELSE 0 END) AS BIGINT) AS own FROM held GROUP BY 1")
def snapshot_space(spark, d):
    """What each of twelve snapshots holds, and what it alone holds, from the months in which things came and went."""
    return SP.space(order_lives(spark, d), 12)


@query(SNAPSHOTS + ", r AS (SELECT a.range AS first, b.range AS last FROM range(12) a, range(12) b WHERE a.range <= b.range) SELECT first, last, CAST(coalesce(sum(size), 0) AS BIGINT) AS freed FROM r LEFT JOIN s ON born >= first AND least(died, 12) - 1 <= last AND born < least(died, 12) GROUP BY 1, 2")
def snapshot_freed(spark, d):
    """What goes if all snapshots from one to another are deleted, for every such range."""
    return SP.freed(order_lives(spark, d), 12)


def order_lives(spark, d) -> DataFrame:
    k = F.col("o_custkey") % 12
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("hash"), (F.length("o_orderpriority") + F.col("o_orderkey") % 50).cast("long").alias("size"), k.cast("long").alias("born"), (k + 1 + F.col("o_orderkey") % 9).cast("long").alias("died"))


# A log in numbered files, read on from where the reader stopped


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL")
def log_read_on(spark, d):
    """The events as a log of three files; the third comes when the first two were read, and the reader goes on from its checkpoint."""
    spark.dataSource.register(NumberedLog)
    folder = _folder(spark, "numbered")
    files = NumberedFiles(spark, f"{folder}/log")
    files.fs.mkdirs(files.where(files.folder))
    middle = median(table(spark, d, "events"), "event_id")
    text = table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("value"))
    parts = (text.filter(F.col("event_id") <= middle / 2), text.filter((F.col("event_id") > middle / 2) & (F.col("event_id") <= middle)), text.filter(F.col("event_id") > middle))
    for number, part in zip((9, 10, 11), parts):
        part.select("value").coalesce(1).write.text(f"{folder}/part{number}")
        (made,) = files.fs.globStatus(files.where(f"{folder}/part{number}/part-*"))
        files.fs.rename(made.getPath(), files.where(f"{files.folder}/log.{number:06d}"))
        if number > 9:
            stream = spark.readStream.format("numbered_log").option("path", files.folder).load()
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(once=True).start().awaitTermination()
    value = F.from_json("value", "event_id long, event_type string").alias("e")
    return spark.read.parquet(f"{folder}/out").select(value).select("e.event_id", "e.event_type").filter("event_type is not null")


# XML: customers with their orders as documents, the two prefixes swapped in every second one


def order_documents(spark, d) -> DataFrame:
    o, odd = table(spark, d, "orders"), F.col("o_custkey") % 2 == 1
    c, own = F.when(odd, "x").otherwise("c"), F.when(odd, "c").otherwise("x")
    one = F.concat(F.lit("<"), own, F.lit(":order id='"), F.col("o_orderkey").cast("string"), F.lit("' "), c, F.lit(':status="'), "o_orderstatus", F.lit('"/>'))
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("one")))).alias("all"))
    inner = F.array_join(F.transform("all", lambda s: s["one"]), "")
    head = F.concat(F.lit("<"), c, F.lit(":customer xmlns:"), c, F.lit('="urn:c" xmlns:'), own, F.lit('="urn:o">'))
    return rows.select("o_custkey", F.concat(head, inner, F.lit("<note xmlns:"), c, F.lit('="urn:other" '), c, F.lit(':status="n"/></'), c, F.lit(":customer>")).alias("xml"))


@query("SELECT o_custkey, 'urn:c' AS namespace, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT o_custkey, 'urn:other', 'n', 1 FROM (SELECT DISTINCT o_custkey FROM orders)")
def xml_attribute_names(spark, d):
    """Every status by the namespace that its prefix stands for where it stands."""
    some = XM.elements(XM.tokens(order_documents(spark, d), "o_custkey", "xml"), "o_custkey")
    return XM.attribute_names(some, "o_custkey").filter("local = 'status'").groupBy("o_custkey", "namespace", "value").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT *, CASE WHEN o_custkey % 2 = 1 THEN 'x' ELSE 'c' END AS c, CASE WHEN o_custkey % 2 = 1 THEN 'c' ELSE 'x' END AS o FROM orders),
one AS (SELECT o_custkey, c, o, o_orderkey, '<' || o || ':order id=''' || o_orderkey || ''' ' || c || ':status="' || CASE WHEN o_orderstatus = 'F' THEN 'done &amp; &lt;gone>' ELSE o_orderstatus END || '"/>' AS one FROM p)
SELECT o_custkey, sha256('<' || c || ':customer xmlns:' || c || '="urn:c" xmlns:' || o || '="urn:o">' || string_agg(one, '' ORDER BY o_orderkey) || '<note xmlns:' || c || '="urn:other" ' || c || ':status="n"/></' || c || ':customer>') AS hash FROM one GROUP BY o_custkey, c, o""")
def xml_rewrite(spark, d):
    """Statuses of one namespace rewritten, all else byte for byte."""
    docs = written(order_documents(spark, d), "documents")
    some = XM.elements(XM.tokens(docs, "o_custkey", "xml"), "o_custkey")
    edits = XM.attribute_names(some, "o_custkey").filter("namespace = 'urn:c' and local = 'status' and value = 'F'").select("o_custkey", "pos", "at", F.lit("done & <gone>").alias("value"))
    return XM.with_values(docs, "o_custkey", "xml", edits).select("o_custkey", F.sha2("xml", 256).alias("hash"))


@query("SELECT c_nationkey, CAST(1 AS BIGINT) AS level, c_mktsegment AS above, c_name || ' & co' AS text FROM customer UNION ALL SELECT DISTINCT c_nationkey, 0, NULL, c_mktsegment FROM customer")
def opml_outlines(spark, d):
    """Each nation's customers as an outline under their segments."""
    c = table(spark, d, "customer")
    leaf = F.concat(F.lit('<outline text="'), "c_name", F.lit(' &amp; co"/>'))
    parts = c.groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.collect_list(leaf), "").alias("inner"))
    part = F.concat(F.lit('<outline text="'), "c_mktsegment", F.lit('">'), "inner", F.lit("</outline>"))
    docs = written(parts.groupBy("c_nationkey").agg(F.concat(F.lit('<opml version="2.0"><body>'), F.array_join(F.collect_list(part), ""), F.lit("</body></opml>")).alias("xml")), "opml")
    rows = written(XM.outlines(docs, "c_nationkey", "xml"), "outlines")
    above = rows.select("c_nationkey", F.col("pos").alias("parent"), F.col("text").alias("above"))
    return rows.join(above, ["c_nationkey", "parent"], "left").select("c_nationkey", "level", "above", "text")


# Counts of changes over a database, hashes of other makers


@query("""
SELECT 'customer' AS "table", kind, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'removed' WHEN c_custkey % 5 = 0 THEN 'changed' END AS kind FROM customer) WHERE kind IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'orders', 'added', count(*) FROM orders WHERE o_orderkey % 4 = 0 HAVING count(*) > 0 UNION ALL SELECT 'supplier', 'removed', count(*) FROM supplier HAVING count(*) > 0""")
def database_changes(spark, d):
    """Changes by table and kind between two states of a database: a table changed, one grown, one dropped."""
    c, o, s = (table(spark, d, t) for t in ("customer", "orders", "supplier"))
    before = {"customer": c, "orders": o.filter("o_orderkey % 4 <> 0"), "supplier": s}
    after = {"customer": c.filter("c_custkey % 9 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))), "orders": o}
    return D.change_counts(before, after, {"customer": ["c_custkey"], "orders": ["o_orderkey"], "supplier": ["s_suppkey"]})


# Transactions over a stream: each user's events as a log, a signup begins a transaction, an error rolls one back, a click commits


@query("""
WITH w AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS open,
  count(*) FILTER (WHERE event_type IN ('click', 'error')) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ends FROM events),
g AS (SELECT user_id, ends, min(event_id) FILTER (WHERE event_type = 'signup') AS began, max(event_id) FILTER (WHERE event_type IN ('click', 'error')) AS last,
  max(event_type) FILTER (WHERE event_type IN ('click', 'error')) AS how FROM w GROUP BY 1, 2)
SELECT w.user_id, w.event_id, w.event_id AS at FROM w JOIN g USING (user_id, ends)
WHERE w.event_type NOT IN ('signup', 'click', 'error') AND (g.began IS NULL OR w.event_id < g.began OR g.how = 'click')""")
def stream_transactions(spark, d):
    """The rows that are out when the whole log has come, from a stream of several batches that cut transactions anywhere."""
    kind = F.col("event_type")
    to = F.when(kind == "signup", "begin").when(kind == "click", "commit").when(kind == "error", "rollback").otherwise("row")
    events = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("log"), F.lit(1).cast("long").alias("number"), F.col("event_id").alias("position"), to.alias("kind"), F.lit(1).cast("long").alias("table_id"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<string>").alias("columns"), F.col("event_id").cast("string").alias("row"),
    )
    folder, own = _folder(spark, "txn"), spark.sparkContext.defaultParallelism
    half = median(table(spark, d, "events"), "event_id")
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(own)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        for part in (events.filter(F.col("position") <= half), events.filter(F.col("position") > half)):
            part.write.mode("append").parquet(f"{folder}/in")
            stream = committed(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.col("log").cast("long").alias("user_id"), F.col("row").cast("long").alias("event_id"), F.col("position").alias("at"))
