"""Diffs, merges, branches, content and change streams on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import branches as B
from palimpsest.operators import content as C
from palimpsest.functions import lines as L
from palimpsest.functions import text as X
from palimpsest.operators import diff as D
from palimpsest.operators import posts as P
from palimpsest.operators import sync
from palimpsest.operators import trees as T
from palimpsest.streaming import cdc


@pytest.fixture
def tree(spark):
    branches = spark.createDataFrame([("main", None), ("dev", "main"), ("fix", "dev")], "branch string, parent string")
    entries = spark.createDataFrame(
        [("main", "/a", "1", False), ("main", "/d/b", "2", False), ("main", "/d/.h", "5", False), ("dev", "/a", None, False), ("dev", "/e", None, True), ("fix", "/a", "3", False), ("fix", "/d/b", None, False)],
        "branch string, path string, hash string, is_dir boolean",
    )
    return branches, entries


def shown(df, branch):
    return sorted((r.path, r.hash) for r in df.filter(F.col("branch") == branch).collect())


def test_nearest_entry_wins_and_tombstones_hide(tree):
    got = B.resolved(*tree)
    assert shown(got, "main") == [("/a", "1"), ("/d/.h", "5"), ("/d/b", "2")]
    assert shown(got, "dev") == [("/d/.h", "5"), ("/d/b", "2"), ("/e", None)]
    assert shown(got, "fix") == [("/a", "3"), ("/d/.h", "5"), ("/e", None)]


def test_what_is_seen_is_sorted_in_parts(tree, monkeypatch):
    branches, entries = tree
    want = sorted(map(tuple, B.resolved(branches, entries).collect()))
    monkeypatch.setattr(B, "SEEN_ROWS", 4)  # of 14 rows that are seen
    got = B.resolved(branches, entries)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("BroadcastHashJoin") < plan.index("Exchange ") and "hashpartitioning(path" in plan and ", 4)" in plan  # branches meet entries that are dealt out, nothing is after it
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(B, "FEW_LINES", 0)
    got = B.resolved(branches, entries)
    assert got._jdf.queryExecution().executedPlan().toString().index("Exchange hashpartitioning(of") > 0 and sorted(map(tuple, got.collect())) == want


def test_listing_and_glob(tree):
    got = B.resolved(*tree).filter("branch = 'main'")
    assert sorted(r.name for r in B.listed(got, "/d").collect()) == [".h", "b"] and [r.name for r in B.listed(got, "").collect()] == ["a"]
    assert [r.path for r in B.globbed(got, "/d/*").collect()] == ["/d/b"] and B.globbed(got, "/*").count() == 1


def test_reset_gives_back_the_snapshot(tree):
    branches, entries = tree
    snap = B.snapshot(B.resolved(branches, entries), "fix", 1).select("path", "hash", "is_dir")
    later = entries.unionByName(entries.sparkSession.createDataFrame([("dev", "/new", "9", False), ("fix", "/a", "8", False)], entries.schema)).filter("not (branch = 'fix' and hash = '3')")
    assert shown(B.resolved(branches, later), "fix") != shown(B.resolved(branches, entries), "fix")
    assert shown(B.resolved(branches, B.reset(later, branches, "fix", snap)), "fix") == shown(B.resolved(branches, entries), "fix")


def test_promote_and_ancestors(tree):
    got = {r.branch: r.parent for r in B.promoted(tree[0], "fix").collect()}
    assert got == {"main": None, "fix": "main", "dev": "fix"}
    assert {r.branch: r.parent for r in B.promoted(tree[0], "dev").collect()} == {"dev": None, "main": "dev", "fix": "dev"}


def test_digest_ignores_order_and_sees_changes(tree):
    got = B.resolved(*tree)
    digests = lambda t: {r.branch: r.digest for r in B.tree_digest(t).collect()}
    assert digests(got) == digests(got.orderBy(F.rand(1)).repartition(3))
    other = digests(got.withColumn("hash", F.when(F.col("hash") == "3", "4").otherwise(F.col("hash"))))
    assert other["main"] == digests(got)["main"] and other["fix"] != digests(got)["fix"]


def test_hierarchy_faults(spark):
    rows = [(1, None), (2, 1), (3, 3), (4, 99), (5, 6), (6, 7), (7, 5), (8, 5), (9, 3), *[(k, k - 1) for k in range(1001, 1300)], (1000, None)]
    got = {r.node: r.fault for r in B.hierarchy_faults(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert got == {3: "self", 4: "missing", 5: "cycle", 6: "cycle", 7: "cycle", 8: "cycle"}


@pytest.fixture
def states(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, v string, w long")
    base = make([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4), (5, None, 5)])
    source = make([(1, "a", 1), (2, "s", 2), (3, "s", 3), (5, "s", 5), (6, "new", 6)])
    target = make([(1, "t", 1), (2, "b", 2), (3, "t", 3), (4, "d", 4), (5, "s", 5)])
    return base, source, target


def test_diff(states):
    base, source, _ = states
    got = {r.k: (r.kind, r.changed) for r in D.diff(base, source, ["k"]).collect()}
    assert got == {2: ("changed", ["v"]), 3: ("changed", ["v"]), 4: ("removed", []), 5: ("changed", ["v"]), 6: ("added", [])}
    assert D.diff(base, base, ["k"]).count() == 0
    assert sorted(map(str, D.diff_by_buckets(base, source, ["k"], 8).collect())) == sorted(map(str, D.diff(base, source, ["k"]).collect()))


def test_three_way(states):
    got = {r.k: r.decision for r in D.three_way(*states, ["k"]).collect()}
    assert got == {1: "keep", 2: "apply", 3: "conflict", 4: "apply", 5: "noop", 6: "apply"}
    ours = {r.k: r.v for r in D.merged(*states, ["k"], "ours").collect()}
    assert ours == {1: "t", 2: "s", 3: "t", 5: "s", 6: "new"}
    assert {r.k: r.v for r in D.merged(*states, ["k"], "theirs").collect()} == {**ours, 3: "s"}
    with pytest.raises(ValueError, match="conflicts"):
        D.merged(*states, ["k"])


def test_reconcile_and_schema(states):
    base, source, _ = states
    got = {r.k: r.action for r in D.reconcile(source, base, ["k"], protected=F.col("k") == 4).collect()}
    assert got == {2: "update", 3: "update", 5: "update", 6: "insert"}
    assert D.with_schema_of(base.drop("w"), base).columns == ["k", "v", "w"]
    assert D.schema_changes(base, base.withColumnRenamed("v", "V")) == []
    with pytest.raises(ValueError):
        D.schema_changes(base.withColumnRenamed("v", "x"), base)


def test_reachable_with_shared_nodes_and_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (9, 10)], "node long, ref long")
    got = {r.node: r.depth for r in C.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_row_hash_tells_null_from_text(spark):
    df = spark.createDataFrame([(None, "b"), ("N", "b"), ("", "b")], "a string, b string")
    assert df.select(C.row_hash(["a", "b"]).alias("h")).distinct().count() == 3


def test_streamed_state_equals_batch_state(spark, tmp_path):
    changes = [(k, f"t{k}", k % 7, "D" if k % 5 == 0 else "U", k) for k in range(1, 60)]
    for part in range(3):
        lines = [json.dumps({"event": "row", "operation": op, "table": t, "rows": [json.dumps({"id": i, "v": v})], "next_position": seq}) for seq, t, i, op, v in changes[part::3]]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))

    def flat(events):
        row = cdc.row_changes(events.withColumn("timestamp", F.col("next_position").cast("string")))
        return row.select(F.get_json_object("row", "$.id").cast("long").alias("id"), F.col("timestamp").cast("long").alias("seq"), F.get_json_object("row", "$.v").cast("long").alias("v"), "operation")

    want = cdc.current_state(flat(cdc.read_events(spark, str(tmp_path / "in"))), "id", "seq", F.col("operation") == "D").select("id", "seq", "v")
    stream = flat(cdc.read_events(spark, str(tmp_path / "in"), stream=True))
    for _ in range(2):  # the second run finds nothing new
        running = cdc.replay_stream(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"), "id", "seq", F.col("operation") == "D")
        running.awaitTermination()
    got = cdc.streamed_state(spark, str(tmp_path / "state"), 0).select("id", "seq", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_streamed_batches_touch_only_their_buckets(spark, tmp_path):
    state, want = tmp_path / "state", {}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("id long, seq long, v long, op string").json(str(tmp_path / "in"))
    batches = [[(k, k, k, "U") for k in range(40)], [(3, 50, 7, "U"), (5, 51, 0, "D")], [(5, 10, 9, "U"), (3, 60, 8, "U")], [(3, 70, 9, "U"), (100, 71, 1, "U")]]
    for number, batch in enumerate(batches):
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("id", "seq", "v", "op"), r))) for r in batch))
        cdc.replay_stream(stream, str(state), str(tmp_path / "checkpoint"), "id", "seq", F.col("op") == "D", buckets=8).awaitTermination()
        for k, seq, v, op in batch:
            if k not in want or want[k][0] < seq:
                want[k] = (seq, v, op)
        got = {r.id: r.v for r in cdc.streamed_state(spark, str(state), number).collect()}
        assert got == {k: v for k, (_, v, op) in want.items() if op != "D"}
    kept = [str(p.parent.name) + str(p.name) for p in state.glob("version=*/_bucket=*")]
    assert len([k for k in kept if k.startswith("version=1")]) <= 2 and max(sum(k.endswith(f"_bucket={b}") for k in kept) for b in range(8)) == 2


def test_moves_that_need_no_merge(spark):
    commits = spark.createDataFrame([(1, None), *[(k, k - 1) for k in range(2, 40)], (100, 20), (101, 100), (200, None)], "commit_id long, parent_id long")
    moves = [(39, 1), (39, 38), (39, 39), (101, 20), (101, 21), (101, 100), (20, 101), (200, 1), (39, None), (39, 999), (999, 1)]
    got = {(r.new, r.old): r.forward for r in B.fast_forwards(commits, spark.createDataFrame(moves, "new long, old long")).collect()}
    assert [got[m] for m in moves] == [True, True, True, True, False, True, False, False, True, False, False]
    assert B.fast_forwards(commits.limit(0), spark.createDataFrame([(1, 2)], "new long, old long")).first().forward is False


def test_commits_at_their_root_climb_no_more(spark, monkeypatch):
    plans, write = [], B.written
    monkeypatch.setattr(B, "written", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, label))
    commits = spark.createDataFrame([(n, n - 1 if n else None) for n in range(4)], "commit_id long, parent_id long")
    assert B.fast_forwards(commits, spark.createDataFrame([(3, 0)], "new long, old long")).first().forward
    joined = [plan for label, plan in plans if label == "depth"]
    assert joined and all("isnull(" in plan and "Union" in plan for plan in joined)  # those done are joined with nothing



def test_texts_of_doubles(spark):
    rows = spark.createDataFrame([(0.1, "0.1"), (0.1 + 0.2, "0.30000000000000004"), (-0.0, "0"), (1e25, "1E+25"), (float("nan"), "NAN"), (float("-inf"), "-INF"), (None, None), (1234567.0, "1234567")], "x double, want string")
    assert all(r.got == r.want for r in rows.select(X.float_text(F.col("x")).alias("got"), "want").collect())


def test_gaps_are_told_apart(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"event":"row","error":"gap"}\n{"event":"row","rows":["{}","{}"]}\n')
    events = cdc.read_events(spark, str(tmp_path))
    assert cdc.gaps(events).count() == 1 and cdc.row_changes(events).count() == 2


def test_push_copies_what_is_missing_once(spark, tmp_path):
    chunks = spark.createDataFrame([("r2", b"2", ["t", "u"]), ("r1", b"1", ["t"]), ("t", b"t", []), ("u", b"u", []), ("x", b"x", [])], "hash string, data binary, refs array<string>")
    have = chunks.filter("hash in ('r1', 't')")
    moved = sync.to_copy(chunks, have, "r2")
    assert {r.hash: r.depth for r in moved.collect()} == {"r2": 0, "u": 1}
    assert sync.to_copy(chunks, have.unionByName(moved.drop("depth")), "r2").count() == 0
    commits = spark.createDataFrame([("c1", []), ("c2", ["c1"]), ("c3", ["c2", "x"])], "hash string, parents array<string>")
    assert sync.descends(commits, "c3", "c1") and not sync.descends(commits, "c1", "c3") and sync.descends(commits, "c2", None)
    refs = sync.Refs(spark, str(tmp_path))
    assert refs.get("main") is None and refs.compare_and_set("main", None, "c1") and refs.get("main") == "c1"
    assert not refs.compare_and_set("main", None, "c2") and refs.compare_and_set("main", "c1", "c2") and refs.get("main") == "c2"


def test_line_merge():
    split = lambda s: s.split()
    assert L.merge_lines(split("a b c d"), split("a x c d"), split("a b c y")) == (split("a x c y"), False)
    assert L.merge_lines(split("a b c"), split("a x c"), split("a x c")) == (split("a x c"), False)
    lines, conflict = L.merge_lines(split("a b c"), split("a x c"), split("a y c"))
    assert conflict and lines == ["a", "<<<<<<< ours", "x", "=======", "y", ">>>>>>> theirs", "c"]
    assert L.merge_lines([], ["n"], []) == (["n"], False) and L.merge_lines(["a"], [], ["a"]) == ([], False)
    assert L.diff_lines(split("a b"), split("a c")) == [" a", "-b", "+c"]


def test_branch_writes(tree):
    branches, entries = tree
    shown_now = B.resolved(branches, entries)
    some = lambda *rows: entries.sparkSession.createDataFrame(rows, "branch string, path string")
    moves = B.renamed(shown_now, entries.sparkSession.createDataFrame([("fix", "/a", "/n/m/a"), ("fix", "/none", "/x")], "branch string, path string, to string"))
    after = B.with_writes(entries, B.removed_with_contents(shown_now, some(("dev", "/d"))), moves, B.missing_folders(shown_now, moves))
    got = B.resolved(branches, after)
    assert shown(got, "main") == [("/a", "1"), ("/d/.h", "5"), ("/d/b", "2")]  # the parent is left alone
    assert shown(got, "dev") == [("/e", None)] and shown(got, "fix") == [("/e", None), ("/n", None), ("/n/m", None), ("/n/m/a", "3")]
    assert [r.path for r in B.exported(got, "fix", F.col("is_dir")).collect()] == ["/n/m/a"]


def test_commits_and_the_dirty_check(tree):
    branches, entries = tree
    spark = entries.sparkSession
    none = spark.createDataFrame([], "commit_id long, branch string, parent_id long, marker string, message string, digest string")
    heads = branches.select("branch", F.lit("m1").alias("marker"), F.lit("one").alias("message"))
    first, files_of = B.recorded(B.resolved(branches, entries), none, heads)
    first = spark.createDataFrame(first.collect(), none.schema)
    assert sorted(r.commit_id for r in first.collect()) == [1, 2, 3]
    at = first.select("branch", "commit_id")
    assert not any(r.dirty for r in B.dirty(B.resolved(branches, entries), first, at).collect())
    later = B.resolved(branches, B.with_writes(entries, B.files_written(spark.createDataFrame([("dev", "/z", "9")], "branch string, path string, hash string"))))
    assert {r.branch: r.dirty for r in B.dirty(later, first, at).collect()} == {"main": False, "dev": True, "fix": True}
    second, _ = B.recorded(later, first, heads)
    rows = {r.branch: (r.commit_id, r.parent_id) for r in second.collect()}
    ids = {r.branch: r.commit_id for r in first.collect()}
    assert set(rows) == {"dev", "fix"} and all(rows[b][1] == ids[b] and rows[b][0] > 3 for b in rows)
    every = first.unionByName(spark.createDataFrame(second.collect(), none.schema))
    line = B.history(every, every.filter("branch = 'dev'").groupBy("branch").agg(F.max("commit_id").alias("commit_id")), 20)
    assert sorted((r.back, r.commit_id) for r in line.collect()) == [(0, rows["dev"][0]), (1, ids["dev"])]


def test_a_commit_for_each_write(tree, spark):
    branches, entries = tree
    commits = spark.createDataFrame([], "commit_id long, branch string, parent_id long, marker string, message string, digest string")
    files = spark.createDataFrame([], "commit_id long, path string, hash string, is_dir boolean")
    name = branches.first().branch
    write = lambda h: B.files_written(spark.createDataFrame([(name, "/w.txt", h)], "branch string, path string, hash string"))
    entries, commits, files = B.written_and_recorded(branches, entries, commits, files, [(write("1"), "m1", "one"), (write("1"), "m2", "same"), (write("2"), "m3", "two")])
    got = [(r.commit_id, r.parent_id, r.marker) for r in commits.orderBy("commit_id").collect()]
    assert got == [(1, None, "m1"), (2, 1, "m3")] and {(r.commit_id, r.hash) for r in files.filter("path = '/w.txt'").collect()} == {(1, "1"), (2, "2")}
    names = [r.name for r in B.listing(B.resolved(branches, entries, [name]), "/").collect()]
    assert names == sorted(names) and "w.txt" in names


def test_merge_of_files(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, text string")
    base = make([("a", "1\n2\n3"), ("b", "x"), ("c", "y"), ("d", "z")])
    source = make([("a", "0\n2\n3"), ("b", "s"), ("d", "z"), ("e", "new")])
    target = make([("a", "1\n2\n4"), ("b", "t"), ("c", "y"), ("d", "z")])
    got = {r.path: (r.text, r.decision) for r in B.merged_files(base, source, target, "theirs").collect()}
    assert got == {"a": ("0\n2\n4", "merged"), "b": ("s", "conflict"), "d": ("z", "noop"), "e": ("new", "apply")}
    with pytest.raises(ValueError, match="conflicts"):
        B.merged_files(base, source, target)


def test_trees_share_roots_and_read_what_differs(spark):
    rows = spark.createDataFrame([(k, f"v{k}", None if k % 3 else k) for k in range(300)], "k long, v string, n long")
    a = T.build(rows, ("k",), 64)
    assert T.build(rows.repartition(5), ("k",), 64).root == a.root and a.diff(a).count() == 0 and a.commit() is a
    b = a.commit(spark.createDataFrame([(7, "new", 1), (900, "more", None)], rows.schema), spark.createDataFrame([(9,)], "k long"))
    assert sorted((r.k, r.a and r.a.v, r.b and r.b.v) for r in a.diff(b).collect()) == [(7, "v7", "new"), (9, "v9", None), (900, None, "more")]
    assert len(a.changed_buckets(b)) <= 3 and len({r.location for r in b.nodes().filter("level = 0").collect()}) == 2
    assert [r.v for r in b.get(7).collect()] == ["new"] and b.get(9).count() == 0 and a.get(9).count() == 1
    back = b.commit(rows.filter("k in (7, 9)"), spark.createDataFrame([(900,)], "k long"))
    assert back.root == a.root == back.compact().root != b.root
    empty = T.build(rows.limit(0), ("k",), 64)
    assert empty.read().count() == 0 and empty.diff(a).count() == 300 and empty.root == a.commit(gone=rows.select("k")).root


def test_a_database_keeps_clean_tables(spark):
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    first = T.database_commit({}, {"x": (rows, ("k",)), "y": (rows, ("k",))}, set(), 4)
    then = T.database_commit(first, {"x": (rows.withColumn("v", F.lit("b")), ("k",)), "y": (rows, ("k",))}, {"x"}, 4)
    assert then["y"] is first["y"] and T.database_root(then) != T.database_root(first)
    wider = T.database_commit(first, {"x": (rows, ("k",)), "y": (rows.withColumn("w", F.lit(1)), ("k",))}, set(), 4)
    assert wider["x"] is first["x"] and wider["y"] is not first["y"]


def test_posts_and_their_meta(spark):
    posts = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (5, None, "c")], "id long, parent long, slug string")
    meta = spark.createDataFrame([(1, 1, "k", "v"), (2, 2, "k", "w")], "meta_id long, post_id long, meta_key string, meta_value string")
    more = P.insert_posts(posts, spark.createDataFrame([(None, 1, "d"), (None, None, "e"), (9, None, "f")], posts.schema))
    assert sorted(r.id for r in more.collect()) == [1, 2, 5, 9, 10, 11]
    out, moved = P.renumber_posts(posts, meta, spark.createDataFrame([(1, 100)], "id long, new_id long"))
    assert sorted((r.id, r.parent) for r in out.collect()) == [(2, 100), (5, None), (100, None)] and sorted((r.meta_id, r.post_id) for r in moved.collect()) == [(1, 100), (2, 2)]
    left, rest = P.delete_posts(posts, meta, spark.createDataFrame([(2,)], "id long"))
    assert left.count() == 2 and [r.meta_id for r in rest.collect()] == [1]
    assert sorted((r.meta_id, r.post_id) for r in P.move_meta(posts, meta, spark.createDataFrame([(1, 5)], "meta_id long, to long")).collect()) == [(1, 5), (2, 2)]
    assert sorted(r.meta_id for r in P.insert_meta(posts, meta, spark.createDataFrame([(None, 5, "k", "x")], meta.schema)).collect()) == [1, 2, 3]
    for wrong in (
        lambda: P.insert_posts(posts, posts.limit(1)), lambda: P.delete_posts(posts, meta, spark.createDataFrame([(1,)], "id long")), lambda: P.renumber_posts(posts, meta, spark.createDataFrame([(1, 2)], "id long, new_id long")),
        lambda: P.insert_meta(posts, meta, spark.createDataFrame([(None, 77, "k", "x")], meta.schema)), lambda: P.move_meta(posts, meta, spark.createDataFrame([(1, 77)], "meta_id long, to long")),
    ):
        with pytest.raises(ValueError):
            wrong()


def test_push_and_fetch(spark, tmp_path):
    import hashlib

    chunk = lambda data, refs: (hashlib.sha256(data).hexdigest(), data, refs)
    leaf = chunk(b"leaf", [])
    c1 = chunk(b"c1", [leaf[0]])
    c2 = chunk(b"c2", [c1[0], leaf[0]])
    local = spark.createDataFrame([leaf, c1, c2], "hash string, data binary, refs array<string>")
    commits = spark.createDataFrame([(c1[0], []), (c2[0], [c1[0]])], "hash string, parents array<string>")
    refs, remote = sync.Refs(spark, str(tmp_path)), local.limit(0)
    remote, n, told = sync.push(local, remote, refs, "main", c1[0], commits)
    assert (n, told) == (2, "pushed") and refs.get("main") == c1[0]
    remote, n, _ = sync.push(local, remote, refs, "main", c2[0], commits)
    assert n == 1 and sync.push(local, remote, refs, "main", c2[0], commits)[1:] == (0, "up-to-date")
    with pytest.raises(ValueError, match="fast-forward"):
        sync.push(local, remote, refs, "main", c1[0], commits)
    got, at = sync.fetch(local.limit(0), remote, refs, "main")
    assert got.count() == 3 and at == c2[0]
    with pytest.raises(ValueError, match="hashes"):
        C.put_once(local, spark.createDataFrame([("0", b"x", [])], local.schema))


def test_other_events(spark, tmp_path):
    lines = [{"event": "query", "sql": "x"}, {"event": "xid", "xid": 5}, {"event": "rotate", "next_file": "f"}, {"event": "rows", "operation": "insert", "table": "t", "timestamp": "2", "rows": ["{}"]}, {"event": "rows", "operation": "insert", "table": "u", "timestamp": "1", "rows": ["{}"]}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, lines)))
    events = cdc.read_events(spark, str(tmp_path))
    assert {(r.event, r.operation): (r.n, r.statements, r.commits, r.rotations) for r in cdc.counted(events).collect()} == {("query", ""): (1, 1, 0, 0), ("xid", ""): (1, 0, 1, 0), ("rotate", ""): (1, 0, 0, 1), ("rows", "insert"): (2, 0, 0, 0)}
    assert cdc.table_log(cdc.row_changes(events), "t", "2").count() == 1 and cdc.table_log(cdc.row_changes(events), "u", "2").count() == 0
