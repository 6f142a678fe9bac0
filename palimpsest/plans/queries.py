"""The registered queries of the versioned-table operators. Overlays, branches and commits are derived from the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import lines as L
from palimpsest.functions import markup as M
from palimpsest.functions import text as X
from palimpsest.operators import branches as B
from palimpsest.operators import content as C
from palimpsest.operators import diff as D
from palimpsest.operators import posts as P
from palimpsest.operators import trees as T
from palimpsest.operators.overlay import VersionedTable, apply_net, fold, local_table
from palimpsest.session import shared_folder, table, written
from palimpsest.sources import files as S
from palimpsest.streaming import cdc


def money(c: str | Column) -> Column:
    """An exact sum of amounts, whatever the order."""
    return F.sum(F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")).cast("double")


def orders_overlay(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """orders with every 13th row's status patched (and every 26th's priority set to NULL), every 17th removed, and a copy of every 29th under a negative key."""
    orders = table(spark, sf_dir, "orders")
    new = orders.filter("o_orderkey % 29 = 0").withColumns({"o_orderkey": -F.col("o_orderkey") - 1, "o_orderstatus": F.lit("N")})
    t = VersionedTable(orders, ("o_orderkey",)).update(F.col("o_orderkey") % 13 == 0, {"o_orderstatus": F.lit("X")})
    t = t.update(F.col("o_orderkey") % 26 == 0, {"o_orderpriority": F.lit(None).cast("string")})
    return t.delete(F.col("o_orderkey") % 17 == 0).insert(new)


OVERLAY = """
WITH v AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate,
    CASE WHEN o_orderkey % 26 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 17 <> 0
  UNION ALL SELECT -o_orderkey - 1, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 29 = 0
)"""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# Reads through an overlay


@query(OVERLAY + "SELECT o_orderstatus, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM v GROUP BY 1")
def overlay_status_totals(spark, d):
    return orders_overlay(spark, d).read().groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), money("o_totalprice").alias("total"))


@query(OVERLAY + "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM v WHERE o_orderstatus = 'X' AND o_orderpriority IS NULL")
def overlay_filter_after_patch(spark, d):
    rows = orders_overlay(spark, d).read().filter("o_orderstatus = 'X' and o_orderpriority is null")
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(OVERLAY + "SELECT o_orderkey, o_totalprice FROM v ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def overlay_topk(spark, d):
    return orders_overlay(spark, d).read().select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(OVERLAY + "SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM v JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'N' GROUP BY 1")
def overlay_join_customer(spark, d):
    rows = orders_overlay(spark, d).read().filter("o_orderstatus <> 'N'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), money("o_totalprice").alias("total"))


@query(OVERLAY + """
SELECT c_custkey, (SELECT max(o_totalprice) FROM v WHERE o_custkey = c_custkey) AS dearest FROM customer
WHERE EXISTS (SELECT 1 FROM v WHERE o_custkey = c_custkey AND o_orderstatus = 'X') AND c_custkey NOT IN (SELECT o_custkey FROM v WHERE o_orderstatus = 'N' AND o_custkey IS NOT NULL)
AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)""")
def overlay_subqueries(spark, d):
    """Customers by correlated subqueries over the merged rows: some patched order, no new one, and a balance above the mean; the price of each one's dearest order."""
    v, c = orders_overlay(spark, d).read(), table(spark, d, "customer")
    mine = v.filter(F.col("o_custkey") == F.col("c_custkey").outer())
    some = c.filter(mine.filter("o_orderstatus = 'X'").exists()).filter(~mine.filter("o_orderstatus = 'N'").exists())
    rich = some.filter(F.col("c_acctbal") > c.select(F.avg("c_acctbal")).scalar())
    return rich.select("c_custkey", mine.select(F.max("o_totalprice")).scalar().alias("dearest"))


@query("SELECT n_nationkey, n_name, n_regionkey, count(*) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 1 GROUP BY ALL")
def overlay_local_only(spark, d):
    nation = table(spark, d, "nation")
    mine = local_table(nation, ("n_nationkey",)).insert(nation).delete(F.col("n_regionkey") == 1).read()
    return mine.join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.count("*").alias("suppliers"))


@query("""
WITH o AS (SELECT event_id, user_id, event_type, value, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events),
last AS (SELECT user_id, max(event_id) AS at, arg_max(op, event_id) AS op FROM o WHERE op IN ('I', 'D') GROUP BY 1),
net AS (
  SELECT o.user_id, any_value(last.op) AS bop,
    arg_max(struct_pack(v := value), event_id) FILTER (WHERE event_type IN ('click', 'signup')) AS pv,
    arg_max(struct_pack(v := event_type), event_id) FILTER (WHERE event_type <> 'error') AS pk
  FROM o LEFT JOIN last USING (user_id) WHERE last.at IS NULL OR event_id >= last.at GROUP BY 1
), base AS (SELECT c_custkey AS user_id, c_acctbal AS value, CAST('base' AS VARCHAR) AS kind FROM customer)
SELECT coalesce(b.user_id, n.user_id) AS user_id, CASE WHEN n.pv IS NOT NULL THEN n.pv.v ELSE b.value END AS value,
  CASE WHEN n.pk IS NOT NULL THEN n.pk.v ELSE b.kind END AS kind
FROM base b FULL JOIN net n ON b.user_id = n.user_id
WHERE coalesce(n.bop, '-') <> 'D' AND (b.user_id IS NOT NULL OR n.bop = 'I')""")
def oplog_fold(spark, d):
    """The events as a log over the customers' balances: a signup is a row, an error a removal, a click sets value, all set kind."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"), F.lit("base").alias("kind"))
    kind = F.col("event_type")
    ops = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U").alias("op"),
        F.when(kind.isin("click", "signup"), F.array(F.lit("value"), F.lit("kind"))).when(kind == "error", F.array().cast("array<string>")).otherwise(F.array(F.lit("kind"))).alias("changed"),
        "user_id", "value", kind.alias("kind"),
    )
    return apply_net(base, written(fold(ops, ["user_id"], base.columns), "net"), ["user_id"])


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'RESCUED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update_where(spark, d):
    t = VersionedTable(table(spark, d, "customer"), ("c_custkey",))
    t = t.update((F.col("c_acctbal") < 0) & (F.col("c_mktsegment") == "BUILDING"), {"c_acctbal": F.col("c_acctbal") + 100, "c_mktsegment": F.lit("RESCUED")})
    return t.read().select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment LIKE 'A%')")
def dml_delete_where(spark, d):
    t = VersionedTable(table(spark, d, "customer"), ("c_custkey",)).delete((F.col("c_acctbal") < 0) | F.col("c_mktsegment").startswith("A"))
    return t.read().select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'replaced' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 7 = 0")
def replace_upsert(spark, d):
    base = table(spark, d, "supplier")
    same = base.filter("s_suppkey % 5 = 0").withColumns({"s_name": F.lit("replaced"), "s_acctbal": F.lit(0.0)})
    new = base.filter("s_suppkey % 7 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000)
    return VersionedTable(base, ("s_suppkey",)).insert(same.unionByName(new)).read()


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40")
def truncate_insert(spark, d):
    base = table(spark, d, "part")
    return VersionedTable(base, ("p_partkey",)).truncate().insert(base.filter("p_size > 40")).read().select("p_partkey", "p_name", "p_size")


@query("SELECT CAST(seq AS BIGINT) AS seq, op, s_suppkey, old_name, new_name FROM (SELECT 2 AS seq, 'U' AS op, s_suppkey, s_name AS old_name, 'two' AS new_name FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 3, 'D', s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'two' ELSE s_name END, NULL FROM supplier WHERE s_suppkey % 6 = 0)")
def journal_changes_since(spark, d):
    t = VersionedTable(table(spark, d, "supplier"), ("s_suppkey",))
    t = t.update(F.col("s_suppkey") % 3 == 0, {"s_acctbal": F.lit(1.0)}).update(F.col("s_suppkey") % 4 == 0, {"s_name": F.lit("two")}).delete(F.col("s_suppkey") % 6 == 0)
    return t.changes_since(2).select("seq", "op", "s_suppkey", F.get_json_object("old_row", "$.s_name").alias("old_name"), F.get_json_object("new_row", "$.s_name").alias("new_name"))


# Differences and merges

AFTER = """
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 19 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 22 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 23 <> 0),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  a.o_custkey IS DISTINCT FROM b.o_custkey AS c1, a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS c2, a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS c3
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""


def two_states(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    b = o.filter(key % 23 != 0).withColumns({
        "o_custkey": F.when(key % 11 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")),
        "o_orderstatus": F.when(key % 22 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")),
    })
    return o.filter(key % 19 != 0), b


@query(AFTER + "SELECT o_orderkey, kind FROM j WHERE kind <> 'changed' OR c1 OR c2 OR c3")
def snapshot_diff(spark, d):
    return D.diff(*two_states(spark, d), ["o_orderkey"]).select("o_orderkey", "kind")


@query(AFTER + "SELECT kind, count(*) AS n FROM j WHERE kind <> 'changed' OR c1 OR c2 OR c3 GROUP BY 1")
def snapshot_diff_summary(spark, d):
    return D.diff(*two_states(spark, d), ["o_orderkey"]).groupBy("kind").agg(F.count("*").alias("n"))


@query(AFTER + "SELECT o_orderkey, concat_ws(',', CASE WHEN c1 THEN 'o_custkey' END, CASE WHEN c2 THEN 'o_orderstatus' END, CASE WHEN c3 THEN 'o_orderpriority' END) AS columns FROM j WHERE kind = 'changed' AND (c1 OR c2 OR c3)")
def diff_changed_columns(spark, d):
    return D.diff(*two_states(spark, d), ["o_orderkey"]).filter("kind = 'changed'").select("o_orderkey", F.array_join("changed", ",").alias("columns"))


@query(AFTER + "SELECT o_orderkey, kind FROM j WHERE kind <> 'changed' OR c1 OR c2 OR c3")
def bucket_diff(spark, d):
    return D.diff_by_buckets(*two_states(spark, d), ["o_orderkey"], 256).select("o_orderkey", "kind")


LINES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2, 3, 4"


@query(f"""
WITH l AS ({LINES}), s AS (SELECT * REPLACE (CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM l WHERE l_suppkey % 5 <> 0),
t AS (SELECT * FROM l WHERE l_suppkey % 3 <> 0)
SELECT * FROM (SELECT coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(s.l_partkey, t.l_partkey) AS l_partkey, coalesce(s.l_suppkey, t.l_suppkey) AS l_suppkey,
  coalesce(s.l_linenumber, t.l_linenumber) AS l_linenumber,
  CASE WHEN t.l_orderkey IS NULL THEN 'insert' WHEN s.l_orderkey IS NULL THEN (CASE WHEN t.l_returnflag = 'R' THEN NULL ELSE 'delete' END) WHEN s.l_quantity <> t.l_quantity THEN 'update' END AS action
  FROM s FULL JOIN t ON s.l_orderkey = t.l_orderkey AND s.l_partkey = t.l_partkey AND s.l_suppkey = t.l_suppkey AND s.l_linenumber = t.l_linenumber) WHERE action IS NOT NULL""")
def reconcile_composite(spark, d):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = table(spark, d, "lineitem").groupBy(*keys).agg(F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"))
    source = rows.filter("l_suppkey % 5 <> 0").withColumn("l_quantity", F.when(F.col("l_partkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return D.reconcile(source, rows.filter("l_suppkey % 3 <> 0"), keys, protected=F.col("l_returnflag") == "R")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(NULL AS VARCHAR) AS s_note FROM supplier")
def schema_reconcile(spark, d):
    supplier = table(spark, d, "supplier")
    return D.with_schema_of(supplier, supplier.withColumn("s_note", F.lit("x")))


MERGE = """
WITH b AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer),
s AS (SELECT k, CASE WHEN k % 3 = 0 THEN v || '-s' ELSE v END AS v FROM b WHERE k % 10 <> 0 UNION ALL SELECT k + 10000000, v FROM b WHERE k % 50 = 0),
t AS (SELECT k, CASE WHEN k % 4 = 0 THEN v || '-t' WHEN k % 9 = 0 THEN v || '-s' ELSE v END AS v FROM b WHERE k % 14 <> 0),
m AS (SELECT coalesce(b.k, s.k, t.k) AS k, b.v AS bv, s.v AS sv, t.v AS tv, CASE WHEN s.v IS NOT DISTINCT FROM t.v THEN 'noop' WHEN b.v IS NOT DISTINCT FROM t.v THEN 'apply'
  WHEN b.v IS NOT DISTINCT FROM s.v THEN 'keep' ELSE 'conflict' END AS decision
  FROM b FULL JOIN s ON b.k = s.k FULL JOIN t ON coalesce(b.k, s.k) = t.k)"""


def three_states(spark, d):
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    k, v = F.col("k"), F.col("v")
    s = b.filter("k % 10 <> 0").withColumn("v", F.when(k % 3 == 0, F.concat(v, F.lit("-s"))).otherwise(v)).unionByName(b.filter("k % 50 = 0").withColumn("k", k + 10000000))
    t = b.filter("k % 14 <> 0").withColumn("v", F.when(k % 4 == 0, F.concat(v, F.lit("-t"))).when(k % 9 == 0, F.concat(v, F.lit("-s"))).otherwise(v))
    return b, s, t


@query(MERGE + "SELECT decision, count(*) AS n FROM m GROUP BY 1")
def merge_decisions(spark, d):
    return D.three_way(*three_states(spark, d), ["k"]).groupBy("decision").agg(F.count("*").alias("n"))


@query(MERGE + "SELECT k, v FROM (SELECT k, CASE WHEN decision = 'apply' THEN sv ELSE tv END AS v FROM m) WHERE v IS NOT NULL")
def merge_ours(spark, d):
    return D.merged(*three_states(spark, d), ["k"], "ours")


@query(MERGE + "SELECT k, v FROM (SELECT k, CASE WHEN decision IN ('apply', 'conflict') THEN sv ELSE tv END AS v FROM m) WHERE v IS NOT NULL")
def merge_theirs(spark, d):
    return D.merged(*three_states(spark, d), ["k"], "theirs")


@query(MERGE + "SELECT k FROM m WHERE decision = 'conflict'")
def merge_conflicts(spark, d):
    return D.three_way(*three_states(spark, d), ["k"]).filter("decision = 'conflict'").select("k")


# Branches: regions are the trunk's children, nations their branches, orders the files

BRANCHES = """
WITH RECURSIVE br AS (
  SELECT 'trunk' AS branch, CAST(NULL AS VARCHAR) AS parent
  UNION ALL SELECT r_name, 'trunk' FROM region
  UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
), en AS (
  SELECT 'trunk' AS branch, '/parts/' || (p_size % 10) || '/' || p_partkey || '.txt' AS path, p_name AS hash, false AS is_dir FROM part
  UNION ALL SELECT r_name, '/parts/' || (p_size % 10) || '/' || p_partkey || '.txt', CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE r_name || p_name END, false FROM part JOIN region ON p_partkey % 20 = r_regionkey
  UNION ALL SELECT n_name, '/parts/' || (p_size % 10) || '/' || p_partkey || '.txt', CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE n_name || p_name END, false FROM part JOIN nation ON p_partkey % 100 = n_nationkey
  UNION ALL SELECT r_name, '/parts/new-' || r_regionkey, CAST(NULL AS VARCHAR), true FROM region
), chain AS (
  SELECT branch, branch AS ancestor, parent, CAST(0 AS BIGINT) AS depth FROM br
  UNION ALL SELECT c.branch, b.branch, b.parent, c.depth + 1 FROM chain c JOIN br b ON b.branch = c.parent
), tree AS (
  SELECT branch, path, hash, is_dir FROM (
    SELECT c.branch, e.path, e.hash, e.is_dir, row_number() OVER (PARTITION BY c.branch, e.path ORDER BY c.depth) AS rn FROM chain c JOIN en e ON e.branch = c.ancestor
  ) WHERE rn = 1 AND (hash IS NOT NULL OR is_dir)
)"""


def branch_tables(spark, d):
    region, nation, part = (table(spark, d, t) for t in ("region", "nation", "part"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("branch"), F.col("r_name").alias("parent"))
    trunk = spark.range(1).select(F.lit("trunk").alias("branch"), F.lit(None).cast("string").alias("parent"))
    branches = trunk.unionByName(region.select(F.col("r_name").alias("branch"), F.lit("trunk").alias("parent"))).unionByName(up)
    path = F.concat(F.lit("/parts/"), (F.col("p_size") % 10).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path")
    file, folder = F.lit(False).alias("is_dir"), F.lit(True).alias("is_dir")

    def own(rows, on, name, gone):
        text = F.when(F.col("p_partkey") % gone != 0, F.concat(name, "p_name"))
        return part.join(rows, on).select(F.col(name).alias("branch"), path, text.alias("hash"), file)

    entries = part.select(F.lit("trunk").alias("branch"), path, F.col("p_name").alias("hash"), file)
    entries = entries.unionByName(own(region, F.col("p_partkey") % 20 == F.col("r_regionkey"), "r_name", 3)).unionByName(own(nation, F.col("p_partkey") % 100 == F.col("n_nationkey"), "n_name", 7))
    folders = region.select(F.col("r_name").alias("branch"), F.concat(F.lit("/parts/new-"), F.col("r_regionkey").cast("string")).alias("path"), F.lit(None).cast("string").alias("hash"), folder)
    return branches, entries.unionByName(folders)


@query(BRANCHES + "SELECT branch, path, hash, is_dir FROM tree")
def branch_resolve(spark, d):
    return B.resolved(*branch_tables(spark, d))


@query(BRANCHES + "SELECT branch, substr(path, 8) AS name, is_dir FROM tree WHERE path LIKE '/parts/%' AND NOT contains(substr(path, 8), '/') UNION ALL SELECT branch, substr(path, 10), is_dir FROM tree WHERE path LIKE '/parts/3/%' AND NOT contains(substr(path, 10), '/')")
def branch_list_dir(spark, d):
    tree = B.resolved(*branch_tables(spark, d))
    return B.listed(tree, "/parts").unionByName(B.listed(tree, "/parts/3")).select("branch", "name", "is_dir")


@query(BRANCHES + "SELECT branch, count(*) AS n FROM tree WHERE regexp_full_match(path, '/parts/[^/]/[^/]*7\\.txt') GROUP BY 1")
def branch_glob(spark, d):
    return B.globbed(B.resolved(*branch_tables(spark, d)), "/parts/?/*7.txt").groupBy("branch").agg(F.count("*").alias("n"))


@query(BRANCHES + "SELECT a, b, arg_min(ancestor, s) AS ancestor FROM (SELECT x.branch AS a, y.branch AS b, x.ancestor, x.depth + y.depth AS s FROM chain x JOIN chain y ON x.ancestor = y.ancestor AND x.branch < y.branch) GROUP BY 1, 2")
def branch_common_ancestor(spark, d):
    return B.common_ancestors(branch_tables(spark, d)[0])


@query(BRANCHES + ", wanted AS (SELECT path, hash, is_dir FROM tree WHERE branch = (SELECT n_name FROM nation WHERE n_nationkey = 1)) SELECT path, hash, is_dir FROM wanted")
def branch_reset(spark, d):
    """The second nation's tree, snapshotted and put back after all of its files are rewritten and its parent has gained some."""
    branches, entries = branch_tables(spark, d)
    name = table(spark, d, "nation").filter("n_nationkey = 1").first().n_name
    snap = B.snapshot(B.resolved(branches, entries, [name]), name, 1).select("path", "hash", "is_dir")
    region = branches.filter(F.col("branch") == name).first().parent
    wrong = entries.withColumn("hash", F.when(F.col("branch") == name, "wrong").otherwise(F.col("hash"))).unionByName(entries.filter("branch = 'trunk'").select(F.lit(region).alias("branch"), F.concat("path", F.lit(".more")).alias("path"), "hash", "is_dir"))
    return B.resolved(branches, B.reset(wrong, branches, name, snap), [name]).select("path", "hash", "is_dir")


LINE = "sha256(path || chr(31) || coalesce(hash, '') || chr(31) || CASE WHEN is_dir THEN 'true' ELSE 'false' END)"
LANES = " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(line, {8 * k + 1}, 8) AS UBIGINT)) AS VARCHAR)" for k in range(4))


@query(BRANCHES + f", l AS (SELECT branch, {LINE} AS line FROM tree) SELECT branch, sha256({LANES}) AS digest, count(*) AS files FROM l GROUP BY 1")
def tree_digest(spark, d):
    return B.tree_digest(B.resolved(*branch_tables(spark, d)))


@query("""
SELECT branch, commit_id, "before", rank FROM (SELECT c_mktsegment AS branch, o_orderkey AS commit_id, row_number() OVER w AS rank, lead(o_orderkey) OVER w AS "before"
FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_mktsegment ORDER BY o_orderkey DESC)) WHERE rank <= 20""")
def commit_log(spark, d):
    commits = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("branch"), F.col("o_orderkey").alias("commit_id"))
    return B.commit_log(commits).select("branch", "commit_id", "before", "rank")


@query("""
WITH RECURSIVE n AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN c_custkey WHEN c_custkey % 83 = 0 THEN 99999999
  WHEN c_custkey % 97 = 1 AND c_custkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END AS parent FROM customer),
ok(node, d) AS (SELECT node, 0 FROM n WHERE parent IS NULL UNION ALL SELECT n.node, d + 1 FROM n JOIN ok ON n.parent = ok.node WHERE n.node <> n.parent),
self AS (SELECT node FROM n WHERE node = parent), lost AS (SELECT node FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM n)),
hang(node, d) AS (SELECT node, 0 FROM self UNION ALL SELECT node, 0 FROM lost UNION ALL SELECT n.node, d + 1 FROM n JOIN hang ON n.parent = hang.node WHERE n.node <> n.parent)
SELECT node, 'self' AS fault FROM self UNION ALL SELECT node, 'missing' FROM lost
UNION ALL SELECT node, 'cycle' FROM n WHERE node NOT IN (SELECT node FROM ok) AND node NOT IN (SELECT node FROM hang)""")
def hierarchy_validate(spark, d):
    k = F.col("c_custkey")
    parent = F.when(k % 97 == 0, F.lit(None)).when(k % 89 == 0, k).when(k % 83 == 0, F.lit(99999999)).when((k % 97 == 1) & (k % 5 == 0), k + 1).otherwise(k - 1)
    return B.hierarchy_faults(table(spark, d, "customer").select(k.alias("node"), parent.cast("long").alias("parent")))


# Content


@query("SELECT sha256(coalesce(text, '')) AS hash, CAST(min(strlen(coalesce(text, ''))) AS BIGINT) AS size, count(*) AS refs FROM documents GROUP BY 1")
def blob_dedup(spark, d):
    return C.stored_once(table(spark, d, "documents"))


@query("SELECT c_custkey, sha256(concat_ws(chr(31), 'V:' || c_custkey, coalesce('V:' || c_name, 'N'), coalesce('V:' || c_nationkey, 'N'), coalesce('V:' || CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END, 'N'))) AS hash FROM customer")
def row_hash(spark, d):
    rows = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    return rows.select("c_custkey", C.row_hash(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).alias("hash"))


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS hash FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE source IN ('src1', 'src2')) AND sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'de')")
def blob_gc(spark, d):
    docs = table(spark, d, "documents").withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return C.garbage(docs.select("hash").distinct(), docs.filter("source in ('src1', 'src2')"), docs.filter("lang = 'de'"))


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS node, o_orderkey * 2 + 1 AS ref FROM orders UNION ALL SELECT o_orderkey, o_orderkey * 3 + 2 FROM orders WHERE o_orderstatus = 'F'),
r(node, depth) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderkey < 3 OR o_orderkey % 500 = 7 UNION SELECT e.ref, depth + 1 FROM r JOIN e ON e.node = r.node)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1""")
def reachable_chunks(spark, d):
    """Orders as chunks that refer to others; what is reached from the first and from every 500th."""
    o = table(spark, d, "orders")
    edges = o.select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") * 2 + 1).alias("ref")).unionByName(o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") * 3 + 2).alias("ref")))
    return C.reachable(edges, o.filter("o_orderkey < 3 or o_orderkey % 500 = 7").select(F.col("o_orderkey").alias("node")))


@query(BRANCHES + "SELECT branch AS remote, ancestor AS local, depth FROM chain WHERE branch <> ancestor")
def fast_forward(spark, d):
    """The moves that a branch may make without a merge: to what inherits from it."""
    return B.chains(branch_tables(spark, d)[0]).filter("branch <> ancestor").select(F.col("branch").alias("remote"), F.col("ancestor").alias("local"), "depth")


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE lang = 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def missing_chunks(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").withColumn("hash", F.sha2("text", 256))
    return C.missing(docs.filter("lang = 'en'").select("hash").distinct(), docs.filter("doc_id % 2 = 0"))


@query(BRANCHES + "SELECT branch, count(*) FILTER (WHERE is_dir) AS folders, count(*) FILTER (WHERE NOT is_dir) AS files, CAST(coalesce(sum(length(hash)), 0) AS BIGINT) AS bytes, count(DISTINCT hash) AS blobs FROM tree GROUP BY 1")
def tree_stats(spark, d):
    return B.resolved(*branch_tables(spark, d)).groupBy("branch").agg(
        F.count_if("is_dir").alias("folders"), F.count_if(~F.col("is_dir")).alias("files"), F.coalesce(F.sum(F.length("hash")), F.lit(0)).cast("long").alias("bytes"), F.countDistinct("hash").alias("blobs")
    )


@query("""
WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'customer-' || (c_custkey - c_custkey % 10 + (c_custkey % 10) // 3) END AS up, 'customer-' || c_custkey AS slug FROM customer),
p AS (SELECT id, slug, '/' || id || '-' || slug AS path FROM n WHERE up IS NULL UNION ALL SELECT n.id, n.slug, p.path || '/' || n.id || '-' || n.slug FROM n JOIN p ON n.up = p.slug)
SELECT id, path || '/index.md' AS path FROM p""")
def nested_paths(spark, d):
    """Customers as posts whose parents are named by slug: each one's place in a nested folder."""
    k = F.col("c_custkey")
    up = F.when(k % 10 != 0, F.concat(F.lit("customer-"), (k - k % 10 + F.floor((k % 10) / 3)).cast("string")))
    posts = table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("customer-"), k.cast("string")).alias("slug"), up.alias("up"))
    return B.nested_paths(posts)


@query("SELECT o_orderkey, sum(CASE WHEN line LIKE '+%' THEN 1 ELSE 0 END)::BIGINT AS added, sum(CASE WHEN line LIKE '-%' THEN 1 ELSE 0 END)::BIGINT AS removed FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [' a', '-' || o_orderstatus, '+' || o_orderpriority] WHEN o_orderkey % 3 = 1 THEN [' a', ' s', '+new'] ELSE [' a', ' s'] END) AS line FROM orders) GROUP BY 1")
def line_diffs(spark, d):
    """Two versions of a small text for each order, by lines."""
    k = F.col("o_orderkey") % 3
    before = F.concat_ws("\n", F.lit("a"), "o_orderstatus")
    after = F.when(k == 0, F.concat_ws("\n", F.lit("a"), "o_orderpriority")).when(k == 1, F.concat_ws("\n", before, F.lit("new"))).otherwise(before)
    lines = F.split(L.line_diff(before, after), "\n")
    count = lambda mark: F.size(F.filter(lines, lambda x: x.startswith(mark))).cast("long")
    return table(spark, d, "orders").select("o_orderkey", count("+").alias("added"), count("-").alias("removed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'a' || chr(10) || 'ours' || chr(10) || 'c' || chr(10) || 'theirs' WHEN o_orderkey % 4 = 1 THEN 'a' || chr(10) || 'same' ELSE NULL END AS text, o_orderkey % 4 > 1 AS conflict FROM orders")
def line_merges(spark, d):
    """Three versions of a small text for each order, merged by lines; the merged text where there is no conflict."""
    k, text = F.col("o_orderkey") % 4, lambda *lines: F.lit("\n".join(lines))
    base, same = text("a", "b", "c", "d"), text("a", "same")
    ours = F.when(k == 1, same).otherwise(text("a", "ours", "c", "d"))
    theirs = F.when(k == 0, text("a", "b", "c", "theirs")).when(k == 1, same).otherwise(text("a", "other", "c", "d"))
    rows = table(spark, d, "orders").select("o_orderkey", L.line_merge(base, ours, theirs).alias("m"))
    return rows.select("o_orderkey", F.when(~F.col("m.conflict"), F.col("m.text")).alias("text"), "m.conflict")


# Change events


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def cdc_current_state(spark, d):
    changes = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return cdc.current_state(changes, "user_id", "event_id", F.col("event_type") == "error")


@query('SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS "before" FROM events')
def cdc_before_after(spark, d):
    return cdc.images(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")


@query("SELECT user_id, txn, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS txn FROM events) GROUP BY 1, 2")
def cdc_txn(spark, d):
    rows = cdc.transactions(table(spark, d, "events"), F.col("event_type") == "signup", "user_id", "event_id")
    return rows.groupBy("user_id", "txn").agg(F.count("*").alias("n"), money("value").alias("total"))


def event_log(spark, d) -> str:
    """A folder with the events as a log of row changes, an envelope a line."""
    events = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    rows = events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.lit("app").alias("database"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table"),
        op.alias("operation"), F.col("event_id").alias("next_position"), F.struct("event_id", "user_id", "event_type", "value").alias("row"),
    )
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    cdc.envelopes(rows).repartition(3).write.text(folder)
    return folder


def logged(events: DataFrame) -> DataFrame:
    return cdc.row_changes(events).withColumn("r", F.from_json("row", "event_id bigint, user_id bigint, event_type string, value double")).select("table", "operation", "timestamp", "r.*")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def cdc_stream_replay(spark, d):
    """The events as a log of envelopes, read as a stream of several batches and replayed into a state by buckets of users."""
    changes = logged(cdc.read_events(spark, event_log(spark, d), stream=True, files_per_batch=1))
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    cdc.replay_stream(changes, f"{folder}/state", f"{folder}/checkpoint", "user_id", "event_id", F.col("operation") == "D", buckets=16).awaitTermination()
    return cdc.streamed_state(spark, f"{folder}/state").select("user_id", "event_id", "event_type", "value")


@query("SELECT 't' || (user_id % 3) AS \"table\", CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS operation, count(*) AS n, max(event_id) AS last, (SELECT max(event_id) FROM events) AS position FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) GROUP BY 1, 2")
def cdc_table_logs(spark, d):
    """Each table's part of the log from a day after its beginning on, by operation, and how far the log was read."""
    events = cdc.read_events(spark, event_log(spark, d))
    changes, start = logged(events), table(spark, d, "events").agg(F.date_format(F.min("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).first()[0]
    logs = [cdc.table_log(changes, name, start) for name in ("t0", "t1", "t2")]
    counts = reduce(DataFrame.unionByName, logs).groupBy("table", "operation").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return counts.withColumn("position", cdc.positions(events).select("next_position").scalar())


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def cdc_event_counts(spark, d):
    return cdc.windowed_counts(table(spark, d, "events"), "ts", "event_type").select("event_type", "start", "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def json_extract(spark, d):
    events = table(spark, d, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


# Functions over texts, paths and pages


@query("SELECT conv_id, role, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2")
def eav_flatten(spark, d):
    """Conversations nested into one row each and laid out again."""
    nested = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    flat = nested.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.role", "t.text")
    return flat.groupBy("conv_id", "role").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS system, count(*) FILTER (WHERE role = 'user') AS \"user\", count(*) FILTER (WHERE role = 'assistant') AS assistant FROM conversations GROUP BY 1")
def eav_pivot(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).count()
    return rows.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("system", "user", "assistant")])


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'post' ELSE s END AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("SELECT page_id, host, array_to_string(p[1:n], '/') AS folder, n FROM (SELECT page_id, lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, string_split(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), '/') AS p, unnest(range(1, len(string_split(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), '/')))) AS n FROM pages)")
def path_parents(spark, d):
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    rows = table(spark, d, "pages").select("page_id", X.url_host(F.col("url")).alias("host"), F.posexplode(X.parents(path)).alias("at", "folder"))
    return rows.select("page_id", "host", F.substring("folder", 2, 1 << 20).alias("folder"), (F.col("at") + 1).cast("long").alias("n"))


@query("SELECT lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host(spark, d):
    return table(spark, d, "pages").groupBy(X.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL")
def utf8_validity(spark, d):
    """Sizes of the documents whose bytes are valid UTF-8 and unchanged by scrubbing: all of them."""
    raw = F.encode("text", "UTF-8")
    docs = table(spark, d, "documents").filter("text is not null").filter(F.is_valid_utf8("text") & (F.make_valid_utf8("text") == F.col("text")))
    return docs.select("doc_id", F.length("text").cast("long").alias("chars"), F.length(raw).cast("long").alias("bytes"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS hash FROM documents WHERE text IS NOT NULL")
def nfc_hash(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(X.nfc(F.col("text")), 256).alias("hash"))


@query("""SELECT page_id, CAST(len(l) AS BIGINT) AS n, list_extract(l, 1) AS first_link FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*"([^"]*)"', 1) AS l FROM pages)""")
def html_links(spark, d):
    found = M.links(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first_link"))


@query("""SELECT page_id, CAST(len(l) AS BIGINT) AS headings, len(l) > 0 AND list_extract(l, 1) <> '1' AS starts_low FROM (SELECT page_id, regexp_extract_all(html, '(?i)<h([1-6])[\\s>]', 1) AS l FROM pages)""")
def heading_lint(spark, d):
    levels = X.headings(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(levels).cast("long").alias("headings"), F.coalesce(F.get(levels, F.lit(0)) != 1, F.lit(False)).alias("starts_low"))


@query("SELECT doc_id, name FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '_transient_' || source WHEN 1 THEN '_site_transient_' || lang WHEN 2 THEN 'siteurl' ELSE source END AS name FROM documents) WHERE NOT (name IN ('siteurl', 'home') OR starts_with(name, '_transient_') OR starts_with(name, '_site_transient_'))")
def option_exclusion(spark, d):
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("_transient_"), "source")).when(k == 1, F.concat(F.lit("_site_transient_"), "lang")).when(k == 2, "siteurl").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", name.alias("name")).filter(~X.is_machine_option(F.col("name")))


@query("SELECT page_id, replace(url, 'example.com', 'moved.example.org') AS url, length(html) - length(replace(html, 'example', '')) AS spread FROM pages")
def site_rewrite(spark, d):
    """Addresses made a mark and a new site put in its place."""
    moved = X.with_address(X.with_placeholder(F.col("url"), "example.com/"), "moved.example.org/")
    gone = X.with_address(X.with_placeholder(F.col("html"), "example"), "")
    return table(spark, d, "pages").select("page_id", moved.alias("url"), (F.length("html") - F.length(gone)).cast("long").alias("spread"))


@query("SELECT doc_id, 'a:2:{s:3:\"url\";s:' || strlen('https://new.example/' || source) || ':\"https://new.example/' || source || '\";i:0;i:' || n_chars || ';}' AS value FROM documents")
def serialized_rewrite(spark, d):
    """Addresses inside serialized values, lengths set right."""
    old = F.concat(F.lit("http://old/"), F.col("source"))
    value = F.concat(F.lit('a:2:{s:3:"url";s:'), F.length(F.encode(old, "UTF-8")).cast("string"), F.lit(':"'), old, F.lit('";i:0;i:'), F.col("n_chars").cast("string"), F.lit(";}"))
    return table(spark, d, "documents").select("doc_id", X.rewrite_serialized(value, "http://old/", "https://new.example/").alias("value"))


@query("SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g') AS html FROM pages")
def html_strip_active(spark, d):
    return table(spark, d, "pages").select("page_id", M.without_active(F.col("html")).alias("html"))


# Writes to branches, commits, merges of files

PART = r"try_cast(regexp_extract(path, '/([0-9]+)\.txt$', 1) AS BIGINT)"


@query(BRANCHES + f"""
, k AS (SELECT t.*, {PART} AS n FROM tree t JOIN region ON branch = r_name), m AS (SELECT * FROM k WHERE n % 13 = 0 AND n % 11 <> 0)
SELECT branch, path, hash, is_dir FROM k WHERE n IS NULL OR n % 11 <> 0 AND n % 13 <> 0
UNION ALL SELECT branch, '/moved/' || n || '.txt', hash, is_dir FROM m UNION ALL SELECT DISTINCT branch, '/moved', CAST(NULL AS VARCHAR), true FROM m""")
def branch_writes(spark, d):
    """In each region's branch every 11th part's file is removed and every 13th moved to a new folder; what the branches then show."""
    branches, entries = branch_tables(spark, d)
    names = table(spark, d, "region").select(F.col("r_name").alias("branch"))
    part = F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).try_cast("long")
    tree = written(B.resolved(branches, entries, names), "tree")
    gone = B.removed(tree.filter(part % 11 == 0))
    left = tree.join(gone.select("branch", "path"), ["branch", "path"], "left_anti")
    moves = B.renamed(left, left.filter(part % 13 == 0).select("branch", "path", F.concat(F.lit("/moved/"), part.cast("string"), F.lit(".txt")).alias("to")))
    after = written(B.with_writes(entries, gone, moves, B.missing_folders(left, moves)), "after")
    return B.resolved(branches, after, names).select("branch", "path", "hash", "is_dir")


@query(BRANCHES + f"""
, x AS (SELECT c.branch, e.path, e.hash, e.is_dir, c.depth, row_number() OVER (PARTITION BY c.branch, e.path ORDER BY c.depth) AS rn FROM chain c JOIN en e ON e.branch = c.ancestor),
h AS (SELECT DISTINCT x.branch FROM x LEFT JOIN region ON branch = r_name WHERE rn = 1 AND (hash IS NOT NULL OR is_dir) AND {PART} % 500 = 0 AND branch <> 'trunk' AND (r_name IS NOT NULL OR depth > 0))
SELECT branch, branch IN (SELECT branch FROM h) AS dirty FROM br""")
def branch_dirty(spark, d):
    """Every branch is committed, then each region's branch loses some files: which branches show other than their commits."""
    branches, entries = branch_tables(spark, d)
    none = spark.createDataFrame([], "commit_id long, branch string, parent_id long, marker string, message string, digest string")
    commits, _ = B.recorded(B.resolved(branches, entries), none, branches.select("branch", F.lit("m").alias("marker"), F.lit("first").alias("message")))
    commits = written(commits, "commits")
    regions = table(spark, d, "region").select(F.col("r_name").alias("branch"))
    some = entries.filter(F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).try_cast("long") % 500 == 0).select("path").distinct()
    after = written(B.with_writes(entries, B.removed(some.withColumn("branch", F.explode(F.array(*[F.lit(r.branch) for r in regions.collect()]))))), "after")
    return B.dirty(B.resolved(branches, after), commits, commits.select("branch", "commit_id"))


@query("SELECT branch, commit_id, CAST(back AS BIGINT) AS back FROM (SELECT o_custkey AS branch, o_orderkey AS commit_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS back FROM orders) WHERE back < 5")
def commit_history(spark, d):
    """Each customer's orders as commits upon commits: the latest five, by parent pointers."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("branch"), F.col("o_orderkey").alias("commit_id"))
    commits = cdc.images(o, "branch", "commit_id", "commit_id").withColumnRenamed("before", "parent_id")
    return B.history(commits, o.groupBy("branch").agg(F.max("commit_id").alias("commit_id")), 5)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS marker, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS has_files FROM orders")
def commit_pairs(spark, d):
    log = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("marker"))
    return B.paired(log, table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").cast("string").alias("marker")))


@query("""
WITH t AS (SELECT DISTINCT doc_id AS path, text FROM documents WHERE text <> '' AND doc_id IS NOT NULL)
SELECT path, sha256(CASE WHEN path % 3 = 0 THEN 'S' || chr(10) ELSE '' END || text || CASE WHEN path % 4 = 0 THEN chr(10) || 'T' ELSE '' END) AS hash,
  CASE WHEN path % 12 = 0 THEN 'merged' WHEN path % 3 = 0 THEN 'apply' WHEN path % 4 = 0 THEN 'keep' ELSE 'noop' END AS decision FROM t""")
def merge_files(spark, d):
    """The documents as files that two branches changed: a line before every third in one, a line after every fourth in the other."""
    base = table(spark, d, "documents").filter("text <> '' and doc_id is not null").select(F.col("doc_id").alias("path"), "text").distinct()
    source = base.withColumn("text", F.when(F.col("path") % 3 == 0, F.concat(F.lit("S\n"), "text")).otherwise(F.col("text")))
    target = base.withColumn("text", F.when(F.col("path") % 4 == 0, F.concat("text", F.lit("\nT"))).otherwise(F.col("text")))
    return B.merged_files(base, source, target, "ours").select("path", F.sha2("text", 256).alias("hash"), "decision")


@query(BRANCHES + """
, p AS (SELECT n_name AS child, r_name AS old FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3)
SELECT branch, CASE WHEN branch = child THEN 'trunk' WHEN branch = old THEN child ELSE parent END AS parent FROM br, p""")
def branch_promote(spark, d):
    """The fourth nation's branch trades places with its region's."""
    name = table(spark, d, "nation").filter("n_nationkey = 3").first().n_name
    return B.promoted(branch_tables(spark, d)[0], name)


@query("""
WITH m AS (SELECT o_orderkey AS new, min(o_orderkey) OVER (PARTITION BY o_custkey) AS old FROM orders
  UNION ALL SELECT a.o_orderkey, b.o_orderkey FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey // 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 50 = 0)
SELECT new, old, old IS NULL OR (a.o_custkey = b.o_custkey AND old <= new) AS forward FROM m JOIN orders a ON a.o_orderkey = new LEFT JOIN orders b ON b.o_orderkey = old""")
def ancestor_test(spark, d):
    """Each customer's orders as commits upon commits: which moves of a reference need no merge, for three kinds of moves."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("branch"), F.col("o_orderkey").alias("commit_id"))
    commits = written(cdc.images(o, "branch", "commit_id", "commit_id").select("commit_id", F.col("before").alias("parent_id")), "commits")
    firsts = o.join(o.groupBy("branch").agg(F.min("commit_id").alias("old")), "branch").select(F.col("commit_id").alias("new"), "old")
    halves = o.select(F.col("commit_id").alias("new"), F.floor(F.col("commit_id") / 2).alias("old")).join(o.select(F.col("commit_id").alias("old")), "old", "left_semi").select("new", "old")
    fresh = o.filter("commit_id % 50 = 0").select(F.col("commit_id").alias("new"), F.lit(None).cast("long").alias("old"))
    return B.fast_forwards(commits, firsts.unionByName(halves).unionByName(fresh))


@query("SELECT c_mktsegment AS branch, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS earliest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def commit_ends(spark, d):
    commits = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return B.ends(commits.select(F.col("c_mktsegment").alias("branch"), F.col("o_orderkey").alias("commit_id"), "o_orderdate"), "o_orderdate")


@query(BRANCHES + """
, blobs AS (SELECT DISTINCT p_name AS hash, length(p_name) AS size FROM part)
SELECT t.branch, br.parent, count(*) AS files, count(size) AS stored, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM tree t JOIN br USING (branch) LEFT JOIN blobs USING (hash) WHERE NOT is_dir GROUP BY ALL""")
def files_with_blobs(spark, d):
    """Every branch's files beside the blobs that a store has of them, under the branch's parent; blobs of rewritten files are not in the store."""
    branches, entries = branch_tables(spark, d)
    blobs = table(spark, d, "part").select(F.col("p_name").alias("hash"), F.length("p_name").alias("size")).distinct()
    rows = B.resolved(branches, entries).filter("not is_dir").join(blobs, "hash", "left").groupBy("branch").agg(F.count("*").alias("files"), F.count("size").alias("stored"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return rows.join(branches, "branch").select("branch", "parent", "files", "stored", "bytes")


# Stored trees, applied states, posts


@query("SELECT o_orderkey, o_orderstatus AS before, CASE WHEN o_orderkey % 700 = 0 THEN NULL ELSE 'X' END AS after FROM orders WHERE o_orderkey % 500 = 0 OR o_orderkey % 700 = 0")
def tree_diff(spark, d):
    """Orders stored as a digest tree, one commit upon it, and the rows that differ between the two versions, both sides of each."""
    o = table(spark, d, "orders")
    first = T.build(o, ("o_orderkey",), 64)
    then = first.commit(o.filter("o_orderkey % 500 = 0 and o_orderkey % 700 <> 0").withColumn("o_orderstatus", F.lit("X")), o.filter("o_orderkey % 700 = 0").select("o_orderkey"))
    return first.diff(then).select("o_orderkey", F.col("a.o_orderstatus").alias("before"), F.col("b.o_orderstatus").alias("after"))


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 9 <> 0) GROUP BY 1")
def tree_read(spark, d):
    """Customers through three versions of a tree: every fifth rewritten, then every ninth taken out."""
    c = table(spark, d, "customer")
    tree = T.build(c, ("c_custkey",), 32).commit(c.filter("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("moved"))).commit(gone=c.filter("c_custkey % 9 = 0").select("c_custkey"))
    return tree.read().groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").cast("long").alias("keys"))


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment = 'MACHINERY'")
def apply_state(spark, d):
    """Customers made equal to another state of them, the machinery segment protected."""
    target = table(spark, d, "customer")
    source = target.filter("c_custkey % 3 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return D.applied(source, target, ["c_custkey"], F.col("c_mktsegment") == "MACHINERY").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("""
WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey - c_custkey % 10 END AS parent FROM customer),
t AS (SELECT max(CASE WHEN id % 100 = 0 THEN id + 10000000 ELSE id END) AS top FROM p),
q AS (SELECT CASE WHEN id % 100 = 0 THEN id + 10000000 ELSE id END AS id, CASE WHEN parent % 100 = 0 THEN parent + 10000000 ELSE parent END AS parent, id AS old FROM p WHERE id % 10 <> 7),
m AS (SELECT o_custkey AS old, count(*) AS n FROM orders GROUP BY 1)
SELECT q.id, q.parent, coalesce(m.n, 0) AS n_meta FROM q LEFT JOIN m USING (old)
UNION ALL SELECT (SELECT max(id) FROM q) + row_number() OVER (), NULL, 0 FROM supplier""")
def posts_dml(spark, d):
    """Customers as posts with their orders as meta rows: some deleted, some renumbered with all that hangs on them, new ones put in."""
    k = F.col("c_custkey")
    posts = table(spark, d, "customer").select(k.alias("id"), F.when(k % 10 != 0, k - k % 10).alias("parent"))
    meta = table(spark, d, "orders").select(F.col("o_orderkey").alias("meta_id"), F.col("o_custkey").alias("post_id"))
    posts, meta = P.delete_posts(posts, meta, posts.filter("id % 10 = 7").select("id"))
    moves = posts.filter("id % 100 = 0").select("id", (F.col("id") + 10000000).alias("new_id"))
    posts, meta = P.renumber_posts(posts, meta, moves)
    posts = P.insert_posts(posts, table(spark, d, "supplier").select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("parent")))
    count = meta.groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("n_meta"))
    return posts.join(count, "id", "left").select("id", "parent", F.coalesce("n_meta", F.lit(0)).alias("n_meta"))


@query("""
WITH b AS (SELECT sha256(coalesce(text, '')) AS hash, min(strlen(coalesce(text, ''))) AS size, bool_or(coalesce(source IN ('src1', 'src2') OR lang = 'de', false)) AS live FROM documents GROUP BY 1)
SELECT count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE live) AS kept, CAST(coalesce(sum(size) FILTER (WHERE live), 0) AS BIGINT) AS kept_bytes,
  count(*) FILTER (WHERE NOT live) AS freed, CAST(coalesce(sum(size) FILTER (WHERE NOT live), 0) AS BIGINT) AS freed_bytes FROM b""")
def blob_gc_totals(spark, d):
    docs = table(spark, d, "documents").withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return C.garbage_totals(C.stored_once(table(spark, d, "documents")), docs.filter("source in ('src1', 'src2')"), docs.filter("lang = 'de'"))


@query("SELECT c_custkey AS id, 'customer ' || c_custkey || ': \"' || c_mktsegment || '\"' AS title, c_name AS meta_value, c_mktsegment AS body FROM customer")
def posts_round_trip(spark, d):
    """Customers written as front-matter documents and read back."""
    k = F.col("c_custkey")
    title = F.concat(F.lit("customer "), k.cast("string"), F.lit(': "'), "c_mktsegment", F.lit('"'))
    meta = F.array(F.struct(F.lit("name").alias("meta_key"), F.col("c_name").alias("meta_value")))
    posts = table(spark, d, "customer").select(k.alias("id"), F.create_map(F.lit("post_title"), title).alias("fields"), meta.alias("meta"), F.col("c_mktsegment").alias("body"))
    files = S.rendered(posts).select(F.concat(F.lit("/posts/"), F.col("id").cast("string"), F.lit("-customer.md")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    back = S.parsed_posts(files)
    values = S.post_meta(back).filter("meta_key = 'name'").select(F.col("post_id").alias("id"), "meta_value")
    return back.join(values, "id").select("id", F.col("fields")["post_title"].alias("title"), "meta_value", "body")


@query("SELECT p_partkey AS post_id, p_name || ' <' || p_brand || '> & more' AS title, 'part' AS post_type, p_type AS content FROM part")
def feed_round_trip(spark, d):
    """Parts written as the items of a feed and read back."""
    title = F.concat("p_name", F.lit(" <"), "p_brand", F.lit("> & more"))
    posts = table(spark, d, "part").select(F.col("p_partkey").alias("post_id"), title.alias("title"), F.lit("part").alias("post_type"), F.col("p_type").alias("content"))
    return S.read_items(S.feed_items(posts))


# Markup, blocks, encodings


@query("""SELECT page_id, sha256(regexp_replace(html, '<a href="([^"]*)">', '<a href="\\1" rel="nofollow">', 'g')) AS hash FROM pages""")
def html_set_attribute(spark, d):
    """Every link that says nothing about it marked as not to be followed."""
    return table(spark, d, "pages").select("page_id", F.sha2(M.with_attribute_where_missing(F.col("html"), "a", "rel", "nofollow"), 256).alias("hash"))


@query("""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1, 2""")
def html_tags(spark, d):
    return M.elements(table(spark, d, "pages"), "page_id", "html").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=')) FROM pages) GROUP BY 1")
def html_links_in_items(spark, d):
    """Links directly in list items, by what stands around them."""
    rows = M.elements(table(spark, d, "pages"), "page_id", "html")
    return M.inside(rows, "page_id", "li", "a").groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, '<' || source || chr(233) || chr(128512) || '&lt; ' || lang || ' &unknown;' AS text FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def html_unescape(spark, d):
    coded = F.concat(F.lit("&lt;"), "source", F.lit("&#233;&#x1F600;&amp;lt; "), "lang", F.lit(" &unknown;"))
    return table(spark, d, "documents").filter("source is not null and lang is not null").select("doc_id", M.decoded(coded).alias("text"))


TURNS = "SELECT conv_id, turn, CAST(1 + (turn * turn + conv_id) % 6 AS INTEGER) AS level FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"


def block_posts(spark, d):
    """Conversations as posts of heading blocks, one a turn, in a group block with an embed."""
    k, level = F.col("conv_id"), (1 + (F.col("turn") * F.col("turn") + F.col("conv_id")) % 6).cast("string")
    block = F.concat(F.lit('<!-- wp:heading {"level":'), level, F.lit("} -->\n<h>x</h>\n<!-- /wp:heading -->"))
    turns = table(spark, d, "conversations").filter("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("all"))
    host = F.when(k % 3 == 0, "twitter.com").when(k % 3 == 1, "mobile.twitter.com").otherwise("nottwitter.com")
    embed = F.concat(F.lit('<!-- wp:embed {"url":"https://'), host, F.lit('/x","providerNameSlug":"x"} /-->'))
    text = F.concat(F.lit("<!-- wp:group -->\n"), F.array_join(F.transform("all", lambda t: t["block"]), "\n"), F.lit("\n"), embed, F.lit("\n<!-- /wp:group -->"))
    return turns.select("conv_id", text.alias("content"))


@query(f"WITH t AS ({TURNS}), l AS (SELECT *, lag(level, 1, 1) OVER (PARTITION BY conv_id ORDER BY turn, level) AS \"before\" FROM t) SELECT conv_id, level, \"before\", count(*) AS n FROM l WHERE level > \"before\" + 1 GROUP BY 1, 2, 3")
def block_heading_lint(spark, d):
    """Headings that skip a level."""
    found = M.skipped_levels(M.heading_levels(M.block_rows(block_posts(spark, d), "conv_id", "content"), "conv_id"), "conv_id")
    return found.groupBy("conv_id", "level", "before").agg(F.count("*").alias("n"))


@query(f"WITH t AS ({TURNS}) SELECT 'core/heading' AS name, CAST(1 AS BIGINT) AS depth, count(*) AS n FROM t UNION ALL SELECT 'core/group', 0, count(DISTINCT conv_id) FROM t UNION ALL SELECT 'core/embed', 1, count(DISTINCT conv_id) FROM t")
def block_counts(spark, d):
    return M.block_rows(block_posts(spark, d), "conv_id", "content").groupBy("name", "depth").agg(F.count("*").alias("n"))


@query(f"WITH t AS ({TURNS}) SELECT DISTINCT conv_id FROM t WHERE conv_id % 3 < 2")
def stale_embeds(spark, d):
    return M.stale_embeds(M.block_rows(block_posts(spark, d), "conv_id", "content"), ["twitter.com"]).select("conv_id")


@query("SELECT doc_id, sha256(text || chr(65533)) AS scrubbed, doc_id % 5 = 0 AS nonchar FROM documents WHERE text IS NOT NULL")
def encoding_scrub(spark, d):
    """Texts with a broken byte behind them and, in every fifth, a code point that is no character."""
    odd = F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, F.lit("\ufffe")).otherwise(""))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(X.scrubbed(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))), 256).alias("scrubbed"), X.has_noncharacters(odd).alias("nonchar"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE regexp_full_match(text, '(?s)[\\x00-\\xff]*')")
def encoding_salvage(spark, d):
    """Texts that Latin-1 can hold, as its bytes, read back without being told what they are."""
    docs = table(spark, d, "documents").withColumn("data", F.when(F.col("text").rlike("^[\\x00-\\xff]*$"), F.encode("text", "ISO-8859-1")))
    return docs.filter("data is not null").select("doc_id", F.sha2(X.salvaged(F.col("data")), 256).alias("hash"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'patched' ELSE CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k, event_type AS kind, CASE WHEN event_type = 'click' THEN 'k,kind' ELSE 'k,kind' END AS keys FROM events")
def map_patches(spark, d):
    """Each event's properties under a patch that names its kind and, for clicks, a new value."""
    props = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    patch = F.when(F.col("event_type") == "click", F.create_map(F.lit("k"), F.lit("patched"), F.lit("kind"), "event_type")).otherwise(F.create_map(F.lit("kind"), "event_type"))
    m = X.patched(props, patch)
    return table(spark, d, "events").select("event_id", m["k"].alias("k"), m["kind"].alias("kind"), F.array_join(X.sorted_keys(m), ",").alias("keys"))


@query("SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def local_dates(spark, d):
    return table(spark, d, "events").select("event_id", X.local_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "+02:00").alias("local"))


@query("""SELECT event_id, CASE WHEN x = 0 THEN '0' WHEN CAST(printf('%.15G', x) AS DOUBLE) = x THEN printf('%.15G', x) ELSE printf('%.17G', x) END AS text, sha1(CAST(event_id AS VARCHAR)) AS sha
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value / 3 WHEN event_id % 3 = 1 THEN value * 1e20 ELSE value END AS x FROM events WHERE value IS NOT NULL)""")
def float_texts(spark, d):
    """Values, thirds of values and very large values as the shortest text that reads back the same."""
    k = F.col("event_id") % 3
    x = F.when(k == 0, F.col("value") / 3).when(k == 1, F.col("value") * 1e20).otherwise(F.col("value"))
    return table(spark, d, "events").filter("value is not null").select("event_id", X.float_text(x).alias("text"), F.sha1(F.col("event_id").cast("string")).alias("sha"))


@query("""SELECT page_id, name, regexp_full_match(name, '[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}') AND name NOT IN ('HEAD', 'main', 'master', 'origin', 'refs', 'new') AS branch, regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)*') AS slug,
  regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') AS identifier, name <> '' AND name NOT IN ('.', '..') AS path
FROM (SELECT page_id, unnest([url_part, 'a-' || page_id, 'main', '-' || page_id, 'p_' || page_id, '.', repeat('x', CAST(page_id % 80 AS INTEGER))]) AS name FROM (SELECT page_id, regexp_extract(url, '([^/?#]*)$', 1) AS url_part FROM pages WHERE url IS NOT NULL))""")
def names_checked(spark, d):
    """Names out of the pages' URLs and ids: which may name a branch, a post, a column or a file."""
    k = F.col("page_id").cast("string")
    names = F.array(F.regexp_extract("url", "([^/?#]*)$", 1), F.concat(F.lit("a-"), k), F.lit("main"), F.concat(F.lit("-"), k), F.concat(F.lit("p_"), k), F.lit("."), F.repeat(F.lit("x"), (F.col("page_id") % 80).cast("int")))
    rows = table(spark, d, "pages").filter("url is not null").select("page_id", F.explode(names).alias("name"))
    name = F.col("name")
    return rows.select("page_id", "name", X.is_branch_name(name).alias("branch"), X.is_slug(name).alias("slug"), X.is_identifier(name).alias("identifier"), X.is_tree_path(F.concat(F.lit("/"), name)).alias("path"))
