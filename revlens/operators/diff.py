"""Changes between two states: what became of each file and function, how risky that is, and who should look at it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.coupling import missed_by_change
from revlens.operators.hotspots import hotspots, scored
from revlens.operators.resolution import path_index
from revlens.operators.social import experts_of_many, knowledge
from revlens.operators.trends import TOP_LEVEL, innermost
from revlens.plans.model import Model
from revlens.plans.staging import stage

REVIEWERS = 5

# Tables of files, contents and functions are joined with a hint to merge: after a projection, an explode or compression they look
# smaller than they are, and the driver would gather them to broadcast.


def snapshot_diff(before: DataFrame, after: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """repo, path, old_path, status, old_blob, new_blob of what differs between two trees(repo, path, blob).

    renames(repo, old_path, path) says which file of the first is which of the second. status is added, deleted, renamed
    or modified; a renamed file is told even if its content is the same, other equal files are not.
    """
    b = before.select("repo", F.col("path").alias("old_path"), F.col("blob").alias("old_blob"))
    if renames is None:
        b = b.withColumn("path", F.col("old_path"))
    else:
        b = b.join(renames.select("repo", "old_path", F.col("path").alias("to")).hint("merge"), ["repo", "old_path"], "left").withColumn("path", F.coalesce("to", "old_path")).drop("to")
    d = b.join(after.select("repo", "path", F.col("blob").alias("new_blob")), ["repo", "path"], "full")
    moved = F.col("old_path") != F.col("path")
    status = F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "deleted").when(moved, "renamed").when(F.col("old_blob") != F.col("new_blob"), "modified")
    d = d.withColumn("status", status).filter(F.col("status").isNotNull())
    return d.select("repo", F.when(F.col("status") == "deleted", F.col("old_path")).otherwise(F.col("path")).alias("path"), F.when(F.col("status") == "renamed", F.col("old_path")).alias("old_path"), "status", "old_blob", "new_blob")


def diff_functions(files: DataFrame, functions: DataFrame) -> DataFrame:
    """change, repo, path, fn, cc_before, cc_after of the functions that files(change, repo, path, old_blob, new_blob, hunks) touch.

    functions(blob, fn, start, end, cc) are those of contents. With hunks a function of the new content is touched where it
    is innermost around a changed line; a place where lines were only taken counts as its first line. Without the column,
    all functions of the new content count, which makes no difference to what rises. The old function is the one of the
    same name.
    """
    cc = functions.groupBy("blob", "fn").agg(F.min("cc").alias("cc"))
    after = cc.select(F.col("blob").alias("new_blob"), "fn", F.col("cc").alias("cc_after")).hint("merge")
    before = cc.select(F.col("blob").alias("old_blob"), "fn", F.col("cc").alias("cc_before")).hint("merge")
    own = files.select("change", "repo", "path", "old_blob", "new_blob")
    if "hunks" in files.columns:
        h = files.filter(F.col("new_blob").isNotNull()).select("change", "repo", "path", F.col("new_blob").alias("key"), F.explode("hunks").alias("h"))
        first, n = F.col("h.new_start").cast("long"), F.greatest(F.col("h.new_count").cast("long"), F.lit(1))
        lines = h.select("change", "repo", "path", "key", F.explode(F.sequence(first, first + n - 1)).alias("line"))
        ranges = functions.select(F.col("blob").alias("key"), "fn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        touched = innermost(lines, ranges, "change", "repo", "path").filter(F.col("fn") != TOP_LEVEL).select("change", "repo", "path", "fn").distinct()
        f = own.join(touched.hint("merge"), ["change", "repo", "path"]).join(after, ["new_blob", "fn"], "left")
    else:
        f = own.join(after, "new_blob")
    return f.join(before, ["old_blob", "fn"], "left").select("change", "repo", "path", "fn", "cc_before", "cc_after")


def diff_files(model: Model, files: DataFrame, metrics: DataFrame) -> DataFrame:
    """change, repo, path, status, file, hotspot_rank, hotspot_score, complexity and health before and after of files(change, repo, path, old_path, status, old_blob, new_blob).

    metrics(blob, complexity, health) are those of contents. file is the model's file at the old path, null where it has none.
    Where only one side has metrics the file counts as added or deleted.
    """
    m = metrics.groupBy("blob").agg(F.min("complexity").alias("complexity"), F.min("health").alias("health"))
    side = lambda name: m.select(F.col("blob").alias(f"{name}_blob"), F.col("complexity").alias(f"complexity_{'before' if name == 'old' else 'after'}"), F.col("health").alias(f"health_{'before' if name == 'old' else 'after'}")).hint("merge")
    d = files.join(side("old"), "old_blob", "left").join(side("new"), "new_blob", "left")
    known_before, known_after = F.col("health_before").isNotNull(), F.col("health_after").isNotNull()
    d = d.withColumn("status", F.when(~known_before & known_after, "added").when(known_before & ~known_after, "deleted").otherwise(F.col("status")))
    d = with_file(model, d).join(hotspots(model, "file").select(F.col("name").alias("file"), F.col("rank").alias("hotspot_rank"), F.col("score").alias("hotspot_score")).hint("merge"), "file", "left")
    return d.select("change", "repo", "path", "status", "file", "hotspot_rank", F.coalesce("hotspot_score", F.lit(0.0)).alias("hotspot_score"), "complexity_before", "complexity_after", "health_before", "health_after")


def with_file(model: Model, files: DataFrame) -> DataFrame:
    """files(repo, path, old_path) with file, the model's file at the old path; null where there is none."""
    known = model.files if "path" in model.files.columns else model.files.withColumn("path", F.col("file"))
    at = path_index(known.select("repo", "path", "file", "alive")).select(F.col("repo").alias("_repo"), F.col("path").alias("_path"), "file").hint("merge")
    return files.join(at, (F.col("repo") == F.col("_repo")) & (F.coalesce("old_path", "path") == F.col("_path")), "left").drop("_repo", "_path")


def rises(functions: DataFrame, files: DataFrame) -> DataFrame:
    """change, rise, drops: how much complexity diff_functions() gained, and whether the health of any of diff_files() drops by half a point."""
    more = F.greatest(F.coalesce("cc_after", F.lit(0)) - F.coalesce("cc_before", F.lit(0)), F.lit(0))
    f = functions.groupBy("change").agg(F.sum(more).cast("long").alias("rise"))
    h = files.groupBy("change").agg(F.max(F.coalesce(F.col("health_after") + 0.5 <= F.col("health_before"), F.lit(False))).alias("drops"))
    return h.join(f, "change", "full").fillna(0, ["rise"]).fillna(False, ["drops"])


def risk_of(model: Model, touched: DataFrame, people: DataFrame, level: str = "file", worse: DataFrame | None = None) -> DataFrame:
    """change, risk, level, missed for touched(change, file, lines, and the files' key at level and alive where they are at hand): risk from 0 to 100 and low, medium or high.

    Counts the worst hotspot that is touched, the hotspots among the touched files, keys of level that usually change
    along and did not, the size of the change, and whether its people(change, author) know what is touched, a null author
    being somebody without any history; a change of nobody loses nothing by that. worse is what rises() gives. Files that
    the model does not have, or null ones, count by their lines.
    """
    if "alive" in touched.columns:
        t = touched.groupBy("change", "file", "key", "alive").agg(F.sum("lines").alias("lines"))  # the last two are the file's; nothing is sorted so
    else:
        about = model.files.select("file", F.col(level).alias("key"), "alive")
        t = touched.groupBy("change", "file").agg(F.sum("lines").alias("lines")).join(about.hint("merge"), "file", "left")
    # Written once: it is asked for known people, for hotspots, and twice for what is missed.
    t = stage(t, "touched")
    k = knowledge(model, "file", by_key=True).withColumnRenamed("lines", "own_lines")
    k = k.select("file", "author", (F.col("own_lines") / F.sum("own_lines").over(Window.partitionBy("file"))).alias("part"))
    # Dealt by change before they are told apart, so that they meet what a change touches, and each other again, where they are.
    people = people.select("change", "author").repartition("change").distinct()
    met = people.join(t.filter("alive").select("change", "file").hint("merge"), "change", "left").join(k.hint("merge"), ["file", "author"], "left")
    known = met.select("change", "file", "part").repartition("change").groupBy("change", "file").agg(F.sum("part").alias("part")).groupBy("change").agg(F.round(F.max("part"), 6).alias("known"), F.lit(True).alias("named"))
    h = scored(model, "file", people=False).select("file", "score", "revisions")
    g = t.join(h.hint("merge"), "file", "left").groupBy("change").agg(
        F.coalesce(F.max("score"), F.lit(0.0)).alias("worst"),
        F.count_if(F.col("score") >= 0.5).alias("hot"),
        F.sum("lines").alias("lines"),
        F.max(F.coalesce("revisions", F.lit(0))).alias("busiest"),
    )
    missed = missed_by_change(model, t.filter("key is not null").select("change", "key"), level).groupBy("change").agg(F.count_if(F.col("kind") != "test").alias("missed"), F.count_if(F.col("kind") == "test").alias("missed_tests"))
    g = g.join(known, "change", "left").join(missed, "change", "left").fillna(False, ["named"]).fillna(0, ["known", "missed", "missed_tests"])
    size = F.when(F.col("lines") > 1500, 15).when(F.col("lines") > 500, 10).otherwise(0)
    new = F.when(F.col("named") & (F.col("known") < 0.1) & (F.col("busiest") >= 5), 10).otherwise(0)
    risk = 40 * F.col("worst") + F.least(5 * F.col("hot"), F.lit(15)) + F.least(7 * F.col("missed") + 3 * F.col("missed_tests"), F.lit(20)) + size + new
    if worse is not None:
        g = g.join(worse, "change", "left").fillna(0, ["rise"]).fillna(False, ["drops"])
        risk = risk + F.least("rise", F.lit(15)) + F.when(F.col("drops"), 5).otherwise(0)
    g = g.withColumn("risk", F.round(F.least(F.lit(100.0), risk)).cast("long"))
    return g.select("change", "risk", F.when(F.col("risk") < 30, "low").when(F.col("risk") < 60, "medium").otherwise("high").alias("level"), (F.col("missed") + F.col("missed_tests")).alias("missed"))


def change_risk(model: Model, changes: DataFrame, level: str = "file", worse: DataFrame | None = None) -> DataFrame:
    """risk_of() for changes(change, commit_id) of the model's own commits."""
    rows = changes.join(model.changes, "commit_id")
    return risk_of(model, rows.select("change", "file", (F.col("added") + F.col("deleted")).alias("lines")), rows.select("change", F.explode("authors").alias("author")), level, worse)


def ticket_risk(model: Model, level: str = "file") -> DataFrame:
    """risk_of() for what was done for each ticket. A change of the model has its tickets and what is known of its file: nothing is looked for."""
    touched = model.changes.select(F.explode("tickets").alias("change"), "file", F.col(level).alias("key"), "alive", (F.col("added") + F.col("deleted")).alias("lines"))
    people = model.commits.select(F.explode("tickets").alias("change"), "authors").select("change", F.explode("authors").alias("author"))
    return risk_of(model, touched, people, level)


def diff_risk(model: Model, files: DataFrame, people: DataFrame, metrics: DataFrame, functions: DataFrame, level: str = "file") -> DataFrame:
    """risk_of() for files(change, repo, path, old_path, status, old_blob, new_blob, added, deleted, and hunks where known) of revisions the model may not have.

    people(change, author) wrote it, null for whom the model does not know; metrics(blob, complexity, health) and
    functions(blob, fn, start, end, cc) are those of contents.
    """
    touched = with_file(model, files).select("change", "file", (F.col("added") + F.col("deleted")).alias("lines"))
    return risk_of(model, touched, people, level, rises(diff_functions(files, functions), diff_files(model, files, metrics)))


def reviewers(model: Model, changes: DataFrame, limit: int = REVIEWERS) -> DataFrame:
    """change, place, reviewer, name, score for changes(change, commit_id): the experts of what is touched but for its authors."""
    rows = changes.join(model.changes.select("commit_id", "file", "authors"), "commit_id")
    return _reviewers(model, rows.select("change", "file"), rows.select("change", F.explode("authors").alias("author")), limit)


def ticket_reviewers(model: Model, limit: int = REVIEWERS) -> DataFrame:
    """reviewers() of what was done for each ticket. A change of the model has its tickets: nothing is looked for."""
    touched = model.changes.select(F.explode("tickets").alias("change"), "file")
    people = model.commits.select(F.explode("tickets").alias("change"), "authors").select("change", F.explode("authors").alias("author"))
    return _reviewers(model, touched, people, limit)


def _reviewers(model: Model, touched: DataFrame, people: DataFrame, limit: int) -> DataFrame:
    return experts_of_many(model, touched, people, limit).select("change", "place", F.col("author").alias("reviewer"), "name", "score")
