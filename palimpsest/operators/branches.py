"""Branch trees: live inheritance along parent pointers, tombstones, snapshots, resets, ancestors.

branches(branch, parent); entries(branch, path, hash, is_dir): a null hash that is no directory is a tombstone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.lines import line_merge
from palimpsest.functions.text import is_server_path, parents
from palimpsest.operators.diff import three_way
from palimpsest.session import numbered, written


def chains(branches: DataFrame, only: list[str] | DataFrame | None = None) -> DataFrame:
    """(branch, ancestor, depth): every branch, or those named in `only` (a list, or a table with a column branch), with itself (depth 0) and what it inherits from.

    Pointers are doubled: each round joins the steps known so far with themselves, so chains of n branches take log2(n)
    rounds. Branches that are their own ancestors are an error.
    """
    known = written(branches.select("branch", "parent"), "branches")
    n, out = known.count(), known
    if only is not None:
        out = known.join(only.select("branch"), "branch", "left_semi") if isinstance(only, DataFrame) else known.filter(F.col("branch").isin(only))
    out = out.select("branch", F.col("branch").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    jump = known.filter("parent is not null and parent <> branch").join(known.select(F.col("branch").alias("parent")), "parent").select("branch", F.col("parent").alias("to"))
    step = 1
    while not jump.isEmpty():
        if step >= n:  # a chain of n branches has n - 1 steps
            raise ValueError("branches that are their own ancestors")
        more = out.alias("o").join(jump.alias("j"), F.col("o.ancestor") == F.col("j.branch")).select("o.branch", F.col("j.to").alias("ancestor"), (F.col("o.depth") + step).alias("depth"))
        out = out.unionByName(more)
        if step >= 4:  # shallow chains, nearly all there are, need no table between rounds
            out = written(out, "chains")
        jump = written(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.branch")).select("a.branch", F.col("b.to").alias("to")), "jump")
        step *= 2
    return out


#: Rows that a task of resolved() sorts, and rows of chains up to which a path's entries meet all branches in one task.
SEEN_ROWS, FEW_LINES = 1 << 19, 10_000


def resolved(branches: DataFrame, entries: DataFrame, only: list[str] | DataFrame | None = None) -> DataFrame:
    """(branch, path, hash, is_dir): what each branch shows, or those named in `only`; the nearest entry of a path wins and a tombstone hides it.

    An entry is seen by every branch below its own. Entries are dealt out before they meet these, by path and into as many
    parts as what is seen needs, so no task sorts more than its part; with many branches, what is seen is dealt out instead.
    """
    line = written(chains(branches, only).withColumnRenamed("branch", "of"), "line")
    below = line.groupBy("ancestor").agg(F.count("*").alias("below"))
    rows = entries.groupBy("branch").agg(F.count("*").alias("n")).join(below, F.col("ancestor") == F.col("branch")).agg(F.sum(F.col("n") * F.col("below")).alias("rows")).first()
    parts = max(1, -(-(rows.rows or 0) // SEEN_ROWS))
    few = line.count() <= FEW_LINES
    near, dealt = (F.broadcast(line), entries.repartition(parts, "path")) if few else (line, entries)
    seen = near.join(dealt, F.col("ancestor") == F.col("branch")).select("of", "path", "hash", "is_dir", "depth")
    nearest = (seen if few else seen.repartition(parts, "of", "path")).groupBy("of", "path").agg(F.min_by(F.struct("hash", "is_dir"), "depth").alias("e"))
    return nearest.filter("e.hash is not null or e.is_dir").select(F.col("of").alias("branch"), "path", "e.hash", "e.is_dir")


def listed(tree: DataFrame, folder: str) -> DataFrame:
    """Direct children of a folder, with their names; order the rows by name where they are shown."""
    base = "" if folder in ("", "/") else "/" + folder.strip("/")
    inside = F.substring("path", len(base) + 2, 1 << 20)
    return tree.filter(F.startswith("path", F.lit(base + "/"))).filter(~F.contains(inside, F.lit("/"))).withColumn("name", inside)


def listing(tree: DataFrame, folder: str) -> DataFrame:
    """listed() in the order that it is shown in: by branch, then by name."""
    return listed(tree, folder).orderBy("branch", "name")


def globbed(tree: DataFrame, pattern: str) -> DataFrame:
    """Paths that match segment by segment; * and ? don't cross a slash or match a leading dot."""
    regex = ""
    for segment in pattern.strip("/").split("/"):
        regex += "/" + ("(?!\\.)" if segment[:1] in "*?" else "")
        regex += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() else c for c in segment)
    return tree.filter(F.col("path").rlike(f"^{regex}$"))


def tree_digest(tree: DataFrame) -> DataFrame:
    """(branch, digest, files): a digest of each branch's paths, hashes and kinds, the same whatever the order of rows.

    The lines of a tree are hashed on their own and the hashes added in four lanes, so a branch of any size is summed
    up in parts; no list of its paths is ever made.
    """
    line = F.sha2(F.concat_ws("\x1f", "path", F.coalesce("hash", F.lit("")), F.col("is_dir").cast("string")), 256)
    lanes = [F.sum(F.conv(F.substring(line, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return tree.groupBy("branch").agg(F.sha2(F.concat_ws("-", *lanes), 256).alias("digest"), F.count("*").alias("files"))


def common_ancestors(branches: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, ancestor): the nearest branch that both inherit from, for pairs(a, b), or for every two branches that have one."""
    line = chains(branches)
    if pairs is None:
        both = line.toDF("a", "ancestor", "da").join(line.toDF("b", "ancestor", "db"), "ancestor").filter("a < b")
    else:
        both = pairs.join(line.toDF("a", "ancestor", "da"), "a").join(line.toDF("b", "ancestor", "db"), ["b", "ancestor"])
    return both.groupBy("a", "b").agg(F.min_by("ancestor", F.struct(F.col("da") + F.col("db"), "ancestor")).alias("ancestor"))


# Writes: rows (branch, path, hash, is_dir) that with_writes() lays over the entries


def files_written(files: DataFrame) -> DataFrame:
    """files(branch, path, hash) as writes."""
    return files.select("branch", "path", "hash", F.lit(False).alias("is_dir"))


def removed(paths: DataFrame) -> DataFrame:
    """Tombstones for paths(branch, path): a folder's own row goes, what is in it stays."""
    return paths.select("branch", "path", F.lit(None).cast("string").alias("hash"), F.lit(False).alias("is_dir"))


def removed_with_contents(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """Tombstones for paths(branch, path) and all that tree(branch, path, ...) shows below them: each path is looked up by its own folders."""
    above = tree.select("branch", F.col("path").alias("of"), F.explode(F.concat(parents(F.col("path")), F.array("path"))).alias("path"))
    return removed(above.join(paths.select("branch", "path"), ["branch", "path"], "left_semi").select("branch", F.col("of").alias("path")).distinct())


def folders_made(paths: DataFrame) -> DataFrame:
    return paths.select("branch", "path", F.lit(None).cast("string").alias("hash"), F.lit(True).alias("is_dir"))


def missing_folders(tree: DataFrame, writes: DataFrame) -> DataFrame:
    """Folders that the paths written stand in and tree lacks, as writes."""
    above = writes.filter("hash is not null or is_dir").select("branch", F.explode(parents(F.col("path"))).alias("path")).distinct()
    return folders_made(above.join(tree.select("branch", "path"), ["branch", "path"], "left_anti"))


def renamed(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(branch, path, to) as writes: a copy of what the branch shows at path, and a tombstone there; a move of nothing writes nothing."""
    found = tree.join(moves, ["branch", "path"])
    return found.select("branch", F.col("to").alias("path"), "hash", "is_dir").unionByName(removed(found.join(moves.select("branch", F.col("to").alias("path")), ["branch", "path"], "left_anti")))


def with_writes(entries: DataFrame, *writes: DataFrame) -> DataFrame:
    """entries after the writes, later ones over earlier ones: one row a branch and path, nothing of other branches touched.

    Rows are dealt out before they are summed up, as a task that reads a large file would sort all of it first.
    """
    names = ["branch", "path", "hash", "is_dir"]
    rows = [t.select(*names).withColumn("turn", F.lit(n)) for n, t in enumerate((entries, *writes))]
    last = reduce(DataFrame.unionByName, rows).repartition("branch", "path").groupBy("branch", "path").agg(F.max_by(F.struct("hash", "is_dir"), "turn").alias("e"))
    return last.select("branch", "path", "e.hash", "e.is_dir")


# Commits: commits(commit_id, branch, parent_id, marker, message, digest) and files(commit_id, path, hash, is_dir)


def recorded(tree: DataFrame, commits: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows of commits and of files: a commit of what each branch of heads(branch, marker, message) shows, above its latest one.

    A branch whose tree is what its latest commit holds gets none; ids go on from the greatest there is.
    """
    latest = commits.groupBy("branch").agg(F.max_by(F.struct("commit_id", "digest"), "commit_id").alias("last"))
    now = heads.join(tree_digest(tree).select("branch", "digest"), "branch", "left").withColumn("digest", F.coalesce("digest", F.lit("")))
    now = now.join(latest, "branch", "left").filter(F.col("last").isNull() | (F.col("last.digest") != F.col("digest")))
    top = commits.agg(F.coalesce(F.max("commit_id"), F.lit(0))).first()[0]
    new = numbered(now, "n").select((F.col("n") + top + 1).alias("commit_id"), "branch", F.col("last.commit_id").alias("parent_id"), "marker", "message", "digest")
    return new, tree.join(new.select("branch", "commit_id"), "branch").select("commit_id", "path", "hash", "is_dir")


def written_and_recorded(branches: DataFrame, entries: DataFrame, commits: DataFrame, files: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries, commits and files after writes, each step (writes, marker, message) a commit of every branch that it wrote to."""
    for writes, marker, message in steps:
        entries = written(with_writes(entries, writes), "entries")
        heads = writes.select("branch").distinct().withColumns({"marker": F.lit(marker), "message": F.lit(message)})
        new, held = recorded(resolved(branches, entries, heads), commits, heads)
        new = written(new, "commits")
        commits, files = commits.unionByName(new), files.unionByName(written(held, "files"))
    return entries, commits, files


def dirty(tree: DataFrame, commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(branch, dirty): whether a branch shows other than the commit that heads(branch, commit_id) says it stands at, which need not be its newest."""
    at = heads.join(commits.select("commit_id", "digest"), "commit_id", "left").select("branch", F.col("digest").alias("at"))
    now = at.join(tree_digest(tree).select("branch", "digest"), "branch", "left")
    return now.select("branch", (~F.coalesce("digest", F.lit("")).eqNullSafe(F.col("at"))).alias("dirty"))


def history(commits: DataFrame, heads: DataFrame, n: int = 20) -> DataFrame:
    """(branch, commit_id, back): the n commits (1 to 500) from heads(branch, commit_id) along first parents; the steps are doubled each round."""
    n = max(1, min(n, 500))
    out = heads.select("branch", "commit_id", F.lit(0).cast("long").alias("back"))
    jump, step = commits.filter("parent_id is not null").select("commit_id", F.col("parent_id").alias("to")), 1
    while step < n:
        more = out.join(jump, "commit_id").select("branch", F.col("to").alias("commit_id"), (F.col("back") + step).alias("back"))
        out = written(out.unionByName(more.filter(F.col("back") < n)), "history")
        jump = written(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.commit_id")).select("a.commit_id", F.col("b.to").alias("to")), "jump")
        step *= 2
    return out


def fast_forwards(commits: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(new, old) of references with `forward`: whether old is new or among its first parents in commits(commit_id, parent_id).

    Every commit's depth is found by doubling its pointer; then each new commit climbs as far as the depths differ, by the
    same pointers, 2 ** k steps at a time. A commit that is not known is no one's forebear; a null old is always one.
    """
    jumps = [commits.filter("parent_id is not null").select("commit_id", F.col("parent_id").alias("to"))]
    depth = commits.select("commit_id", F.col("parent_id").alias("to"), F.col("parent_id").isNotNull().cast("long").alias("depth"))
    while not jumps[-1].isEmpty():
        above = depth.select(F.col("commit_id").alias("to"), F.col("to").alias("over"), F.col("depth").alias("more"))
        climbing, done = depth.filter("to is not null"), depth.filter("to is null")  # nulls would all meet in one task
        climbed = climbing.join(above, "to", "left").select("commit_id", F.col("over").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        depth = written(done.unionByName(climbed), "depth")
        jump = jumps[-1]
        jumps.append(written(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.commit_id")).select("a.commit_id", F.col("b.to").alias("to")), "jump"))
        if len(jumps) > 40:
            raise ValueError("commits that are their own forebears")
    of = depth.select("commit_id", "depth")
    asked = moves.select("new", "old").repartition("new", "old").distinct()  # dealt out first: no task that reads a large file holds all of its moves
    wanted = asked.join(of.toDF("new", "dn"), "new").join(of.toDF("old", "do"), "old")
    at = written(wanted.select("new", "old", F.col("new").alias("at"), (F.col("dn") - F.col("do")).alias("up")).filter("up >= 0"), "moves")
    for k, jump in enumerate(jumps[:-1]):
        climbed = at.join(jump.toDF("at", "to"), "at", "left")
        at = climbed.select("new", "old", F.when(F.getbit("up", F.lit(k)) == 1, F.col("to")).otherwise(F.col("at")).alias("at"), "up")
    forward = at.filter("at = old").select("new", "old", F.lit(True).alias("forward"))
    return moves.join(forward, ["new", "old"], "left").withColumn("forward", F.coalesce("forward", F.col("old").isNull() | (F.col("old") == F.col("new")), F.lit(False)))


def ends(commits: DataFrame, order: str) -> DataFrame:
    """(branch, earliest, latest) commit of each branch of commits(branch, commit_id, ...) in an order, ties by id."""
    by = F.struct(order, "commit_id")
    return commits.groupBy("branch").agg(F.min_by("commit_id", by).alias("earliest"), F.max_by("commit_id", by).alias("latest"))


def paired(log: DataFrame, files_of: DataFrame) -> DataFrame:
    """log(marker, ...) with whether a commit of files is paired with each marker, so that a reset there brings files back."""
    return log.join(files_of.select("marker").filter("marker is not null").distinct().withColumn("has_files", F.lit(True)), "marker", "left").withColumn("has_files", F.coalesce("has_files", F.lit(False)))


def exported(tree: DataFrame, branch: str, transient: Column | None = None) -> DataFrame:
    """(path, hash, is_dir) of one branch on its own, without the rows that are the server's or that `transient` holds for."""
    rows = tree.filter((F.col("branch") == branch) & ~is_server_path(F.col("path"))).select("path", "hash", "is_dir")
    return rows if transient is None else rows.filter(~F.coalesce(transient, F.lit(False)))


def merged_files(base: DataFrame, source: DataFrame, target: DataFrame, strategy: str = "abort") -> DataFrame:
    """(path, text, decision) after a merge of three states of (path, text): whole files by three_way(), files that both sides changed line by line.

    decision is noop, apply, keep, merged or conflict; a conflict's text has both sides between markers, or the side that the strategy names.
    """
    plan = three_way(base, source, target, ["path"])
    of = lambda t, name: t.select("path", F.struct("text").alias(name))
    rows = plan.join(of(base, "b"), "path", "left").join(of(source, "s"), "path", "left").join(of(target, "t"), "path", "left")
    clash = rows.filter("decision = 'conflict'").withColumn("m", F.when(F.expr("s is not null and t is not null"), line_merge(F.col("b.text"), F.col("t.text"), F.col("s.text"))))
    side = {"theirs": F.col("s.text"), "ours": F.col("t.text")}.get(strategy, F.col("m.text"))
    clean = F.coalesce(~F.col("m.conflict"), F.lit(False))
    decided = clash.select("path", F.when(clean, F.col("m.text")).otherwise(side).alias("text"), F.when(clean, "merged").otherwise("conflict").alias("decision"))
    if strategy == "abort" and (some := decided.filter("decision = 'conflict'").select("path").limit(20).collect()):
        raise ValueError(f"conflicts on {[r.path for r in some]}")
    plain = rows.filter("decision <> 'conflict'").select("path", F.when(F.col("decision") == "apply", F.col("s.text")).otherwise(F.col("t.text")).alias("text"), "decision")
    return plain.unionByName(decided).filter("text is not null")


def snapshot(tree: DataFrame, branch: str, commit: int) -> DataFrame:
    return tree.filter(F.col("branch") == branch).select(F.lit(commit).cast("long").alias("commit_id"), "path", "hash", "is_dir")


def reset(entries: DataFrame, branches: DataFrame, branch: str, snap: DataFrame) -> DataFrame:
    """entries after the branch is set to a snapshot: its own rows become what makes it show just that, tombstones where it inherits more."""
    inherited = resolved(branches, entries.filter(F.col("branch") != branch), [branch])
    hide = inherited.join(snap, "path", "left_anti").select(F.lit(branch).alias("branch"), "path", F.lit(None).cast("string").alias("hash"), F.lit(False).alias("is_dir"))
    own = snap.select(F.lit(branch).alias("branch"), "path", "hash", "is_dir")
    return entries.filter(F.col("branch") != branch).unionByName(own).unionByName(hide)


def commit_log(commits: DataFrame, n: int = 20) -> DataFrame:
    """The latest n commits (1 to 500) of each branch, latest first, with the commit before."""
    n, latest = max(1, min(n, 500)), Window.partitionBy("branch").orderBy(F.desc("commit_id"))
    some = commits.withColumn("rank", F.row_number().over(latest)).filter(F.col("rank") <= n + 1)  # tasks drop the rest before the shuffle
    return some.withColumns({"before": F.lead("commit_id").over(latest), "rank": F.col("rank").cast("long")}).filter(F.col("rank") <= n)


def promoted(branches: DataFrame, branch: str) -> DataFrame:
    """branches with a branch and its parent trading places: it takes its grandparent as parent, and becomes its old parent's."""
    old = branches.filter(F.col("branch") == branch).first().parent
    above = branches.filter(F.col("branch") == old).first() if old is not None else None
    parent = F.when(F.col("branch") == branch, F.lit(above and above.parent).cast("string")).when(F.col("branch") == old, F.lit(branch)).otherwise(F.col("parent"))
    return branches.select("branch", parent.alias("parent"))


def hierarchy_faults(nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, fault): self for a node that is its own parent, missing for an unknown parent, cycle for one that never gets to a root.

    nodes(node, parent), parent null for a root. Pointers are doubled each round, so a chain of n nodes takes log2(n) rounds.
    """
    known = nodes.select(F.col("node").alias("parent")).distinct()
    own = nodes.filter("node = parent").select("node", F.lit("self").alias("fault"))
    lost = nodes.filter("parent is not null").join(known, "parent", "left_anti").select("node", F.lit("missing").alias("fault"))
    jump = nodes.filter("parent is not null and node <> parent").join(lost, "node", "left_anti").select("node", F.col("parent").alias("to"))
    for _ in range(rounds):
        count = jump.count()
        after = written(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.to").alias("to")), "jump")
        if after.isEmpty() or after.count() == count:
            return own.unionByName(lost).unionByName(after.select("node", F.lit("cycle").alias("fault")))
        jump = after
    raise ValueError(f"chains longer than 2 ** {rounds}")


def flat_paths(posts: DataFrame) -> DataFrame:
    """(id, path) of posts(id, slug): one file each beside the others."""
    return posts.select("id", F.concat(F.lit("/"), F.col("id").cast("string"), F.coalesce(F.concat(F.lit("-"), "slug"), F.lit("")), F.lit(".md")).alias("path"))


def nested_paths(posts: DataFrame) -> DataFrame:
    """(id, path) of posts(id, slug, up): folders named id-slug inside the folder of the post whose slug is `up`.

    Slugs that name a parent must belong to one post; posts whose parents lead to no root have no path.
    Each round puts what stands above a post's known parents before them, so a chain of n posts takes log2(n) rounds.
    """
    named = posts.join(posts.filter("up is not null").select(F.col("up").alias("slug")).distinct(), "slug", "left_semi")
    if twice := named.groupBy("slug").count().filter("count > 1").limit(5).collect():
        raise ValueError(f"parents named by slugs of several posts: {[r.slug for r in twice]}")
    own = F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("-"), "slug")
    state = written(posts.select("id", "slug", "up", own.alias("path")), "posts")
    done, left = state.filter("up is null"), state.filter("up is not null")
    while not left.isEmpty():
        above = done.unionByName(left).select(F.col("slug").alias("up"), F.col("up").alias("over"), F.col("path").alias("above"))
        after = written(left.join(above, "up").select("id", "slug", F.col("over").alias("up"), F.concat("above", "path").alias("path")), "posts")
        placed, left = after.filter("up is null"), after.filter("up is not null")
        if placed.isEmpty():
            break
        done = done.unionByName(placed)
    return done.select("id", F.concat("path", F.lit("/index.md")).alias("path"))
