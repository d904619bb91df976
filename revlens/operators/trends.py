"""Complexity trends of sampled series, and function-level analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.numeric import DAY, decay
from revlens.operators.hotspots import once_a_commit
from revlens.plans.model import Model


def classify(points: DataFrame, now: DataFrame) -> DataFrame:
    """file, direction, change, refactored, points for points(file, ts, complexity, seq), series of three and more."""
    order = Window.partitionBy("file").orderBy("ts", "seq")
    p = points.join(F.broadcast(now)).withColumn("before", F.lag("complexity").over(order)).withColumn("before_ts", F.lag("ts").over(order))
    place = F.struct("ts", "seq")
    ends = p.groupBy("file").agg(
        F.count("*").alias("n"),
        F.max_by("complexity", place).alias("last"),
        F.coalesce(F.max(F.when(F.col("ts") <= F.col("now") - 365 * DAY, place)), F.min(place)).alias("at"),
    )
    p = p.join(ends.filter("n >= 3"), "file").filter(F.col("ts") >= F.col("at.ts"))
    dropped = (F.col("before_ts") >= F.col("at.ts")) & (F.col("complexity") < F.col("before") * 0.8)
    out = p.groupBy("file").agg(
        F.max(F.when(F.struct("ts", "seq") == F.col("at"), F.col("complexity"))).alias("base"),
        F.max("last").alias("last"),
        F.max(F.coalesce(dropped, F.lit(False))).alias("refactored"),
        F.count("*").alias("points"),
    )
    delta = F.col("last") - F.col("base")
    change = delta / F.greatest("base", F.lit(10.0))
    direction = F.when((change > 0.25) & (delta >= 5), "deteriorating").when(change < -0.15, "improving").otherwise("stable")
    return out.select("file", direction.alias("direction"), F.round(change, 3).alias("change"), "refactored", "points")


def sample(series: DataFrame, now: DataFrame, samples: int = 12) -> DataFrame:
    """The rows of series(file, ts, seq) that are looked at: some evenly over all, some over the last year, the last before it."""
    year = F.col("now") - 365 * DAY
    order = Window.partitionBy("file").orderBy("ts", "seq")

    def even(rows: DataFrame, n: int) -> DataFrame:
        rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("len", F.count("*").over(Window.partitionBy("file")))
        picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("len") - 1) / max(n - 1, 1)))
        return rows.filter((F.col("len") <= n) | F.array_contains(picks, F.col("i").cast("long"))).select("file", "ts", "seq")

    s = series.join(F.broadcast(now))
    s = s.withColumn("all", F.count("*").over(Window.partitionBy("file"))).filter("all >= 2").drop("all")
    before = s.filter(F.col("ts") < year).groupBy("file").agg(F.max(F.struct("ts", "seq")).alias("p")).select("file", "p.ts", "p.seq")
    return even(s, samples).union(even(s.filter(F.col("ts") >= year), samples // 2 + 1)).union(before).distinct()


#: Bins of lines by which lines meet ranges: a range is filed at the first size that holds its length, in two bins at most.
BINS = (64, 4096, 262_144)
TOP_LEVEL = "(top level)"


def innermost(lines: DataFrame, ranges: DataFrame, *carry: str) -> DataFrame:
    """lines(key, line, and columns to carry along) with fn: the innermost of ranges(key, fn, start, end) that holds the line, or (top level).

    Lines and ranges meet by key and bin. A range is filed in the bins of its size that it reaches into, a line looks into
    its bin of each size, so that a line meets the ranges around it and not all of its key. Equal rows are one. Ranges that
    end before they begin hold nothing; those longer than the largest bin are filed in several. Only keys and lines are
    looked up, each once; what is carried along meets the answers by them.
    """
    length = F.col("end") - F.col("start")
    size = F.lit(BINS[-1])
    for n in reversed(BINS[:-1]):
        size = F.when(length <= n, n).otherwise(size)
    at = lambda x, n: F.floor(x / n).cast("long")
    r = ranges.filter("start <= end").withColumn("size", size)
    r = r.select(F.col("key").alias("of"), "fn", "start", "end", F.col("size").alias("of_size"), F.explode(F.sequence(at(F.col("start"), F.col("size")), at(F.col("end"), F.col("size")))).alias("of_bin"))
    bins = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), at(F.col("line"), n).alias("bin")) for n in BINS])).alias("b")
    places = lines.select("key", "line").distinct().select("*", bins)
    inside = (F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end"))
    # Ranges that are exploded look as small as what they were made of: without the hint the driver would gather them to broadcast.
    j = places.join(r.hint("merge"), (F.col("key") == F.col("of")) & (F.col("b.size") == F.col("of_size")) & (F.col("b.bin") == F.col("of_bin")) & inside)
    found = j.groupBy("key", "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), "fn")).alias("least")).select("key", "line", F.col("least.fn").alias("fn"))
    own = lines.select("key", "line", *carry).repartition("key", "line").distinct()  # one shuffle for both
    return own.join(found.hint("merge"), ["key", "line"], "left").select("key", "line", *carry, F.coalesce("fn", F.lit(TOP_LEVEL)).alias("fn"))


#: Functions of a content up to which each of its lines is asked for all of them.
FEW = 200


def segments(ranges: DataFrame) -> DataFrame:
    """key, segments of ranges(key, fn, start, end): stretches of lines, array of (first, last, fn), with the innermost range that holds them; lines outside of all are in none.

    They begin where a range begins or one has ended. Of keys with many ranges the beginnings are looked up like lines.
    """
    r = ranges.filter("start <= end").groupBy("key").agg(F.collect_set(F.struct("start", "end", "fn")).alias("fns"))
    first = F.array_sort(F.array_distinct(F.flatten(F.transform("fns", lambda f: F.array(f["start"], f["end"] + 1)))))
    r = r.withColumn("first", first)
    least = lambda x: F.array_min(F.transform(F.filter("fns", lambda f: (f["start"] <= x) & (f["end"] >= x)), lambda f: F.struct((f["end"] - f["start"]).alias("n"), f["fn"].alias("fn"))))["fn"]
    few = r.filter(F.size("fns") <= FEW).select("key", F.transform("first", lambda x: F.struct(x.alias("first"), F.coalesce(least(x), F.lit(TOP_LEVEL)).alias("fn"))).alias("at"))
    many = r.filter(F.size("fns") > FEW)
    found = innermost(many.select("key", F.explode("first").alias("line")), many.select("key", F.explode("fns").alias("f")).select("key", "f.fn", "f.start", "f.end"))
    at = few.unionByName(found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("line").alias("first"), "fn"))).alias("at")))
    # The last begins after all ranges.
    each = F.transform("at", lambda x, i: F.struct(x["first"].alias("first"), (F.get("at", i + 1)["first"] - 1).alias("last"), x["fn"].alias("fn")))
    return at.select("key", F.filter(each, lambda x: x["last"].isNotNull() & (x["fn"] != TOP_LEVEL)).alias("segments"))


def disjoint(runs: Column) -> Column:
    """Runs of lines, array of (first, last), in order and without what an earlier one has. Where none meet, as in a patch, nothing is put together anew."""
    runs = F.array_sort(runs)
    before, no = F.lit(-(1 << 62)), F.lit(False)
    meet = F.aggregate(runs, F.struct(before.alias("last"), no.alias("meet")), lambda a, x: F.struct(F.greatest(a["last"], x["last"]).alias("last"), (a["meet"] | (x["first"] <= a["last"])).alias("meet")))["meet"]

    def put(a: Column, x: Column) -> Column:
        left = F.struct(F.greatest(x["first"], a["last"] + 1).alias("first"), x["last"].alias("last"))
        return F.struct(F.greatest(a["last"], x["last"]).alias("last"), F.when(x["last"] > a["last"], F.concat(a["runs"], F.array(left))).otherwise(a["runs"]).alias("runs"))

    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return F.when(meet, F.aggregate(runs, F.struct(before.alias("last"), none.alias("runs")), put)["runs"]).otherwise(runs)


def commit_functions(files: DataFrame, functions: DataFrame) -> DataFrame:
    """function_changes() with commit_id, by which the rows are dealt, so that they meet their commits where they are.

    Hunks are never made lines: those of one side of a file are one row, which meets the functions of its content and
    comes back with a number for each of them.
    """
    # No content has these names: what has none meets nothing, and not in one task.
    none = F.concat(F.lit(":"), F.pmod(F.xxhash64("repo", "sha", "path"), F.lit(1 << 20)).cast("string"))
    side = lambda kind: F.struct(F.coalesce(f"{kind}_blob", none).alias("key"), F.lit(kind == "new").alias("new"), F.filter(F.transform("hunks", lambda h: F.struct(h[f"{kind}_start"].cast("long").alias("first"), (h[f"{kind}_start"].cast("long") + h[f"{kind}_count"] - 1).alias("last"))), lambda x: x["first"] <= x["last"]).alias("runs"))
    # A file that stands in a patch twice has each line once.
    h = files.groupBy("repo", "sha", "path").agg(F.flatten(F.collect_list(F.array(side("new"), side("old")))).alias("sides"))
    h = h.select("repo", "sha", "path", F.explode("sides").alias("s")).select("repo", "sha", "path", "s.*").filter(F.size("runs") > 0)
    h = h.groupBy("repo", "sha", "path", "key", "new").agg(F.flatten(F.collect_list("runs")).alias("runs")).withColumn("runs", disjoint(F.col("runs")))
    ranges = functions.select(F.col("blob").alias("key"), "fn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    h = h.join(segments(ranges).hint("merge"), "key", "left")
    zero = F.lit(0).cast("long")
    within = lambda x: F.aggregate("runs", zero, lambda n, r: n + F.greatest(F.least(x["last"], r["last"]) - F.greatest(x["first"], r["first"]) + 1, zero))
    inside = F.filter(F.transform("segments", lambda x: F.struct(x["fn"].alias("fn"), within(x).alias("n"))), lambda x: x["n"] > 0)
    h = h.withColumn("of", F.coalesce(inside, F.array().cast("array<struct<fn:string,n:bigint>>")))
    rest = F.aggregate("runs", zero, lambda n, r: n + r["last"] - r["first"] + 1) - F.aggregate("of", zero, lambda n, x: n + x["n"])
    h = h.select("repo", "sha", "path", "new", F.concat("of", F.filter(F.array(F.struct(F.lit(TOP_LEVEL).alias("fn"), rest.alias("n"))), lambda x: x["n"] > 0)).alias("of"))
    commit = F.concat_ws(":", "repo", "sha")
    h = h.repartition(commit).withColumn("commit_id", commit).select("commit_id", "repo", "sha", "path", "new", F.explode_outer("of").alias("f"))  # never empty, and not asked for twice
    of = lambda new: F.sum(F.when(F.col("new") == new, F.col("f.n")).otherwise(0))
    return h.groupBy("commit_id", "repo", "sha", "path", F.col("f.fn").alias("fn")).agg(of(True).alias("added"), of(False).alias("deleted"))


def function_changes(files: DataFrame, functions: DataFrame) -> DataFrame:
    """repo, sha, path, fn, added, deleted: how many lines each change of a patch's files added to, and took from, each function.

    files is what parse_patches() gives, functions(blob, fn, start, end) are the functions of contents. New lines fall into
    the functions of the new content, old ones into those of the old; lines outside of all, and of contents without
    functions, are (top level). Files without lines have no row.
    """
    return commit_functions(files, functions).drop("commit_id")


def function_history(model: Model, changes: DataFrame) -> DataFrame:
    """What function_hotspots() and function_coupling() take, of function_changes() or commit_functions() rows: those of commits and files of the model."""
    named = (changes if "commit_id" in changes.columns else changes.withColumn("commit_id", F.concat_ws(":", "repo", "sha"))).drop("repo", "sha")
    # How many rows a file's function has in a commit: one, unless several paths are one file.
    rows = F.lit(1) if model.paths is None else F.lit(2)
    if model.paths is not None:
        named = named.join(model.paths.select("commit_id", "path", "file").distinct(), ["commit_id", "path"])
    else:
        named = named.withColumnRenamed("path", "file")
    commits = model.commits.select("commit_id", "ts", "now", "defect", "weight", "authors").hint("merge")
    return named.join(commits, "commit_id").select("file", "fn", "commit_id", "ts", "now", "added", "deleted", "defect", "weight", "authors", rows.cast("long").alias("n_changes"))


def function_hotspots(changes: DataFrame, functions: DataFrame, half_life_days: float = 180.0) -> DataFrame:
    """file, fn, revisions, rev_w, churn, defects, authors, last_ts, cc, score for changes(file, fn, commit_id, ts, now, added, deleted, defect, weight, authors).

    Where changes have n_changes, a row with 1 is the only one that its file's function has in its commit, and is not looked for among others.
    """
    n = F.col("n_changes") if "n_changes" in changes.columns else F.lit(None).cast("long")
    per = changes.select("file", "fn", "commit_id", F.coalesce(n, F.lit(2)).alias("n_changes"), "weight", "now", (F.col("added") + F.col("deleted")).alias("churn"), "defect", "ts", "authors")
    same = [F.max(c).alias(c) for c in ("weight", "now", "defect", "ts")]  # a commit's own
    per = once_a_commit(per, ("file", "fn"), *same, F.sum("churn").alias("churn"), F.array_distinct(F.flatten(F.collect_list("authors"))).alias("authors"))
    # One pass: what a person did in a function, the commit's own numbers with its first author.
    per = per.repartition("file", "fn")
    w = F.col("weight") * decay(F.col("now") - F.col("ts"), half_life_days)
    who = per.select("file", "fn", w.alias("w"), "churn", F.col("defect").cast("long").alias("defect"), "ts", F.posexplode_outer("authors").alias("at", "author"))
    first = F.coalesce("at", F.lit(0)) == 0
    who = who.groupBy("file", "fn", "author").agg(
        F.count_if(first).alias("revisions"), F.sum(F.when(first, F.col("w"))).alias("w"), F.sum(F.when(first, F.col("churn"))).alias("churn"), F.sum(F.when(first, F.col("defect"))).alias("defects"), F.max("ts").alias("ts"), F.count("at").alias("named")
    )
    h = who.groupBy("file", "fn").agg(F.sum("revisions").alias("revisions"), F.sum("w").alias("rev_w"), F.sum("churn").alias("churn"), F.sum("defects").alias("defects"), F.max("ts").alias("last_ts"), F.count_if(F.col("named") > 0).alias("authors"))
    h = h.join(functions.hint("merge"), ["file", "fn"])
    top = F.max("rev_w").over(Window.partitionBy("file"))
    freq = F.when(top > 0, F.log(1 + F.col("rev_w")) / F.log(1 + top)).otherwise(0.0)
    return h.select("file", "fn", "revisions", F.round("rev_w", 4).alias("rev_w"), "churn", "defects", "authors", "last_ts", "cc", F.round(freq * (0.4 + 0.6 * F.least(F.col("cc") / 15, F.lit(1.0))), 3).alias("score"))


def function_coupling(changes: DataFrame, min_support: int = 3, min_confidence: float = 0.5, top: int = 20) -> DataFrame:
    """Pairs of functions of one file that change together: file, a, b, support, confidence."""
    s = changes.select("file", "fn", "commit_id").distinct()
    n = s.groupBy("file", "fn").agg(F.count("*").alias("n"))
    s = s.join(n.filter(F.col("n") >= min_support).select("file", "fn"), ["file", "fn"], "left_semi")
    left, right = s.withColumnRenamed("fn", "a"), s.withColumnRenamed("fn", "b")
    p = left.join(right, ["file", "commit_id"]).filter(F.col("a") < F.col("b")).groupBy("file", "a", "b").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
    p = p.join(n.withColumnRenamed("fn", "a").withColumnRenamed("n", "na"), ["file", "a"]).join(n.withColumnRenamed("fn", "b").withColumnRenamed("n", "nb"), ["file", "b"])
    p = p.withColumn("confidence", F.round(F.col("support") / F.least("na", "nb"), 3)).filter(F.col("confidence") >= min_confidence)
    order = Window.partitionBy("file").orderBy(F.desc("support"), F.desc("confidence"), "a", "b")
    return p.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).select("file", "a", "b", "support", "confidence")
