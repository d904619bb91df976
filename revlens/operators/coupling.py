"""Change coupling: keys that change together, by commit, by ticket, or by an author's session."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.numeric import DAY
from revlens.functions.paths import entity_key
from revlens.plans.model import Model, Params, Scope
from revlens.plans.staging import stage

RECENT_DAYS = 180


def _by_commit(changes: DataFrame, level: str) -> DataFrame:
    """commit_id, author, ts, repo, n, keys of each commit: a commit's only change is all that it has, others' are brought together."""
    about = ("author", "ts", "repo")
    one = changes.filter("n_changes = 1").select("commit_id", *about, F.lit(1).cast("long").alias("n"), F.array(level).alias("keys"))
    many = changes.filter("n_changes > 1").groupBy("commit_id").agg(*[F.first(c).alias(c) for c in about], F.count("*").alias("n"), _distinct(F.col(level)).alias("keys"))
    return one.unionByName(many)


def _distinct(key: Column) -> Column:
    """The different keys of a group, null too."""
    return F.collect_set(F.struct(key.alias("key")))["key"]


def commit_sets(model: Model, level: str, scope: Scope = Scope()) -> DataFrame:
    """keys, ts: the keys of each commit that is neither formatting nor too large."""
    return _by_commit(model.changes.filter(F.col("couples") & scope.commits()), level).select("keys", "ts")


def ticket_sets(model: Model, level: str, scope: Scope = Scope()) -> DataFrame:
    """The keys of all commits that name a ticket, for tickets of at most twice max_commit_files changes.

    Commits without a ticket are put together by their authors' sessions.
    """
    changes = model.changes.filter(F.col("couples") & scope.commits())
    rows = changes.select(F.explode("tickets").alias("set_id"), F.col(level).alias("key"), "ts")
    # Tickets that are too large go before their keys are gathered.
    small = rows.withColumn("n", F.count("*").over(Window.partitionBy("set_id"))).filter(F.col("n") <= 2 * model.params.max_commit_files)
    by_ticket = small.groupBy("set_id").agg(_distinct(F.col("key")).alias("keys"), F.max("ts").alias("ts")).drop("set_id")
    return by_ticket.unionByName(_keys_of_sessions(changes.filter(F.size("tickets") == 0), model.params, level))


def commit_session_sets(model: Model, level: str, scope: Scope = Scope()) -> DataFrame:
    """The keys of all commits by their authors' sessions, whether they name a ticket or not."""
    return _keys_of_sessions(model.changes.filter(F.col("couples") & scope.commits()), model.params, level)


def _keys_of_sessions(changes: DataFrame, params: Params, level: str) -> DataFrame:
    """keys, ts: sessions over several repos with at most twice max_commit_files changes, other commits one each."""
    commits = _by_commit(changes, level)
    window = int(params.session_hours * 3600)
    if window <= 0:
        return commits.select("keys", "ts")
    s = _sessions(commits.withColumnRenamed("commit_id", "id"), window, 2 * params.max_commit_files)
    met = s.filter("together").groupBy("author", "anchor").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), F.max("set_ts").alias("ts"))
    return s.filter("not together").select("keys", F.col("set_ts").alias("ts")).unionByName(met.select("keys", "ts"))


def anchored_sessions(events: DataFrame, window_seconds: int) -> DataFrame:
    """events(author, ts, id, and columns to carry along) with anchor: the start of the session that the row falls in.

    A session takes what comes within the window of its first row; the next row starts the next. Sessions hang on the
    ones before, so that an author's rows are read in order by one task, sorted on disk if need be, which holds no more
    than the current anchor and a batch.
    """
    kinds = dict(events.dtypes)
    carried = [c for c in events.columns if c not in ("author", "id", "ts")]
    rows = events.select("author", "id", F.col("ts").cast("long").alias("ts"), *carried).repartition("author").sortWithinPartitions("author", "ts")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        author = anchor = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ts = batch.column(2).fill_null(0).to_numpy()
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            words = batch.column(0).dictionary_encode("encode")
            of = words.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            out = np.zeros(len(of), np.int64)
            for i, stop in itertools.pairwise(edges):
                if (who := words.dictionary[of[i]].as_py()) != author:
                    author, anchor = who, None
                i += int((~known[i:stop]).sum())  # rows without a time come first and have no anchor
                while i < stop:
                    if anchor is None or ts[i] - anchor > window_seconds:
                        anchor = int(ts[i])
                    j = i + max(1, int(np.searchsorted(ts[i:stop], anchor + window_seconds, "right")))
                    out[i:j] = anchor
                    i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=~known)], ["author", "id", "ts", *carried, "anchor"])

    return rows.mapInArrow(fold, ", ".join(f"`{c}` {kinds[c]}" for c in ("author", "id")) + ", ts bigint, " + "".join(f"`{c}` {kinds[c]}, " for c in carried) + "anchor bigint")


def pair_counts(sets: DataFrame, params: Params, now: DataFrame) -> DataFrame:
    """a, b, support, recent, n_a, n_b, conf_ab, conf_ba, lift, jaccard for keys that meet often enough in sets(keys, ts).

    A set is one row with its different keys, of which there are few, so that its pairs are made where it is. Keys that
    occur in fewer sets than the least support can be in no pair that counts and leave before; all sets and keys count
    for the marginals.
    """
    sets = stage(sets, "change-sets")
    marginals = stage(sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")), "marginals")
    total = F.broadcast(sets.agg(F.count("*").alias("total")))
    often = marginals.filter(F.col("n") >= params.min_support)
    kept = sets.filter(F.size("keys") > 1)
    if not marginals.filter(F.col("n") < params.min_support).isEmpty():
        flat = kept.withColumn("set_id", F.monotonically_increasing_id()).select("set_id", "ts", F.explode("keys").alias("key"))
        kept = flat.join(often.select("key"), "key", "left_semi").groupBy("set_id").agg(F.collect_list("key").alias("keys"), F.first("ts").alias("ts"))
    recent = (F.col("ts") >= F.col("now") - RECENT_DAYS * DAY).cast("long")
    pairs = kept.select(F.array_sort(F.array_compact("keys")).alias("keys"), "ts").select("keys", "ts", F.posexplode("keys").alias("i", "a"))
    pairs = pairs.select("a", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("b"), "ts").join(F.broadcast(now))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("support"), F.sum(recent).alias("recent")).filter(F.col("support") >= params.min_support)
    pairs = pairs.join(often.select(F.col("key").alias("a"), F.col("n").alias("n_a")), "a").join(often.select(F.col("key").alias("b"), F.col("n").alias("n_b")), "b").join(total)
    s, na, nb = F.col("support"), F.col("n_a"), F.col("n_b")
    pairs = pairs.withColumn("conf_ab", s / na).withColumn("conf_ba", s / nb).withColumn("lift", s * F.col("total") / (na * nb)).withColumn("jaccard", s / (na + nb - s))
    return pairs.filter((F.greatest("conf_ab", "conf_ba") >= params.min_confidence) & (F.col("lift") >= params.min_lift))


def keys_of(model: Model, level: str, scope: Scope = Scope()) -> DataFrame:
    """key, repo, unit, entity, alive, test, config, in_scope: test and config where all of a file's or entity's files are; units and repos never are."""
    small = level in ("file", "entity")
    every = lambda c: F.min(c) if small else F.lit(False)
    f = model.files.withColumn("in_scope", scope.files()).withColumn("config", F.col("lang") == "data")
    unit = F.min_by("unit", F.struct("test", "file")) if level != "repo" else F.lit(None).cast("string")
    return f.groupBy(F.col(level).alias("key")).agg(
        F.max("repo").alias("repo"),
        unit.alias("unit"),
        F.min("entity").alias("entity"),
        F.max("alive").alias("alive"),
        every("test").alias("test"),
        every("config").alias("config"),
        F.max("in_scope").alias("in_scope"),
    )


def stem(key: Column) -> Column:
    """The last segment of a key without extension and test suffix."""
    return F.element_at(F.split(entity_key(key), "/"), -1)


def coupling(
    model: Model,
    level: str = "entity",
    by: str = "commit",
    scope: Scope = Scope(),
    focus: str | None = None,
    cross_repo: bool = False,
    cross_only: bool = False,
    include_tests: bool = False,
    include_config: bool = False,
    include_expected: bool = False,
) -> DataFrame:
    """Coupled pairs by commit, ticket or session, strongest first, with rounded ratios.

    Pairs with a dead key are left out, and unless asked for, those with a test, with configuration only, and of files
    of one entity. The days of the scope choose the sets; repo, unit and path must hold for one of the two keys.
    """
    if by not in SETS:
        raise ValueError(f"by is one of {', '.join(SETS)}, not {by!r}")
    sets = SETS[by](model, level, scope)
    now = model.commits.agg(F.max("now").alias("now"))
    pairs = pair_counts(sets, model.params, now)
    keys = keys_of(model, level, scope)
    side = lambda x: keys.select(F.col("key").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("repo", "unit", "entity", "alive", "test", "config", "in_scope")])
    p = pairs.join(side("a"), "a").join(side("b"), "b").filter("a_alive and b_alive and (a_in_scope or b_in_scope)")
    p = p.withColumn("cross_repo", F.col("a_repo") != F.col("b_repo")).withColumn("cross_unit", F.col("cross_repo") | ~F.col("a_unit").eqNullSafe(F.col("b_unit")))
    p = p.withColumn("same_entity", (F.col("a_entity") == F.col("b_entity")) if level == "file" else F.lit(False))
    p = p.withColumn("test_pair", (F.col("a_test") != F.col("b_test")) & (stem(F.col("a")) == stem(F.col("b"))))
    p = p.withColumn("involves_test", F.col("a_test") | F.col("b_test")).withColumn("involves_config", F.col("a_config") | F.col("b_config"))
    for shown, flag in ((include_tests, "involves_test"), (include_config, "involves_config"), (include_expected, "same_entity")):
        if not shown:
            p = p.filter(~F.col(flag))
    if cross_repo:
        p = p.filter("cross_repo")
    if cross_only:
        p = p.filter("cross_unit or cross_repo")
    if focus is not None:
        p = p.filter(F.col("a").contains(focus) | F.col("b").contains(focus))
    degree = F.greatest("conf_ab", "conf_ba")
    strength = F.round(degree * (1 - 1 / F.sqrt(F.col("support"))), 6)
    r3 = lambda c: F.round(c, 3).alias(c)
    flags = ("cross_unit", "cross_repo", "same_entity", "test_pair", "involves_test", "involves_config")
    return p.select("a", "b", "support", "recent", "n_a", "n_b", r3("conf_ab"), r3("conf_ba"), r3("lift"), r3("jaccard"), *flags, strength.alias("strength")).orderBy(F.desc("strength"), F.desc("support"), "a", "b")


def sum_of_coupling(model: Model, level: str = "entity") -> DataFrame:
    """How many other keys each key met, summed over its commits."""
    others = (F.size("keys") - 1).cast("long")
    return commit_sets(model, level).select(F.explode("keys").alias("name"), others.alias("others")).groupBy("name").agg(F.sum("others").alias("soc"))


def session_sets(events: DataFrame, window_seconds: int, max_changes: int) -> DataFrame:
    """set_id, key: sessions over several repos and not too large are one set, other rows one each. events(author, ts, id, repo)."""
    s = _sessions(events.withColumn("n", F.lit(1)), window_seconds, max_changes)
    return s.select("set_id", F.col("repo").alias("key")).distinct()


def _sessions(events: DataFrame, window_seconds: int, max_changes: int) -> DataFrame:
    """events(author, ts, id, repo, n, and columns to carry along) with anchor, together, set_id and set_ts: whether a row's session is one set, the row's set, and the time of its last row."""
    s = anchored_sessions(events, window_seconds).filter("id is not null")
    whole = Window.partitionBy("author", "anchor")
    several = F.coalesce(F.min("repo").over(whole) < F.max("repo").over(whole), F.lit(False))
    s = s.withColumn("together", several & (F.sum("n").over(whole) <= max_changes)).withColumn("last", F.max("ts").over(whole))
    set_id = F.when(F.col("together"), F.concat_ws(":", F.col("author").cast("string"), F.col("anchor").cast("string"))).otherwise(F.concat(F.lit("one:"), F.col("id").cast("string")))
    return s.withColumn("set_id", set_id).withColumn("set_ts", F.when(F.col("together"), F.col("last")).otherwise(F.col("ts"))).drop("last")


SETS = {"commit": commit_sets, "ticket": ticket_sets, "session": commit_session_sets}


def unit_graph(model: Model, limit: int = 400) -> DataFrame:
    """Edges between units: by commit first, by ticket across repos where there is none yet."""
    loose = replace(model, params=replace(model.params, min_support=3, min_confidence=model.params.graph_confidence, min_lift=1.0))
    cols = ["a", "b", "support", "conf_ab", "conf_ba", "lift", "cross_repo", "strength"]
    top = lambda by, cross: coupling(loose, "unit", by, cross_repo=cross).select(*cols).limit(limit)
    by_commit = top("commit", False)
    by_ticket = top("ticket", True).join(by_commit.select("a", "b"), ["a", "b"], "left_anti")
    return by_commit.withColumn("kind", F.lit("commit")).unionByName(by_ticket.withColumn("kind", F.lit("ticket")))


def directed(model: Model, level: str, min_lift: float | None = 1.0, tickets_across_only: bool = False) -> DataFrame:
    """source, target, confidence, support, lift, by, and flags: coupled pairs by commit and by ticket, in both directions.

    Tests and files of one entity count at level file.
    """
    loose = model if min_lift is None else replace(model, params=replace(model.params, min_lift=min_lift))
    at_file = level == "file"
    out = None
    for by in ("commit", "ticket"):
        c = coupling(loose, level, by, cross_repo=by == "ticket" and tickets_across_only, include_tests=at_file, include_expected=at_file).withColumn("by", F.lit(by))
        ways = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("target"), F.col(conf).alias("confidence")) for x, y, conf in (("a", "b", "conf_ab"), ("b", "a", "conf_ba"))])
        c = c.select(F.explode(ways).alias("way"), "support", "lift", "by", "cross_repo", "cross_unit", "same_entity", "test_pair").select("way.*", "support", "lift", "by", "cross_repo", "cross_unit", "same_entity", "test_pair")
        out = c if out is None else out.unionByName(c)
    return out


def partners(model: Model, key: str | None = None, level: str = "entity", limit: int = 25) -> DataFrame:
    """What changes with a key, the first by name unless told otherwise, by the share of the key's own changes; ticket pairs only across repos."""
    one = model.files.agg((F.min(level) if key is None else F.max(F.lit(key))).alias("_key"))
    d = directed(model, level, 1.0, tickets_across_only=True).join(F.broadcast(one), F.col("source") == F.col("_key"))  # one row
    return d.select(F.col("target").alias("name"), "support", "confidence", "lift", "by", "cross_repo", "cross_unit", F.col("same_entity").alias("expected")).orderBy(F.desc("confidence"), F.desc("support"), "name", "by").limit(limit)


def missed_by_change(model: Model, touched: DataFrame, level: str = "file", limit: int = 15) -> DataFrame:
    """change, source, target, confidence, support, kind for touched(change, key): keys that usually change with one of a change's, and did not.

    For each change and target the best source; of each change the limit surest targets.
    """
    kind = F.when(F.col("test_pair"), "test").when(F.col("cross_repo"), "cross-repo").when(F.col("same_entity"), "same component").otherwise("coupled")
    sure = directed(model, level).filter((F.col("confidence") >= model.params.missed_confidence) & (F.col("support") >= model.params.min_support))
    sure = sure.select("source", "target", "confidence", "support", kind.alias("kind"), "by")
    t = touched.select("change", "key").distinct()
    out = sure.join(t, F.col("source") == F.col("key")).drop("key")
    out = out.join(t.select(F.col("change").alias("in_change"), "key"), (F.col("change") == F.col("in_change")) & (F.col("target") == F.col("key")), "left_anti")
    best = Window.partitionBy("change", "target").orderBy(F.desc("confidence"), F.desc("support"), "source", "by")
    out = out.withColumn("k", F.row_number().over(best)).filter("k = 1")
    first = Window.partitionBy("change").orderBy(F.desc("confidence"), F.desc("support"), "target")
    return out.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= limit).drop("k", "by")


def missed_changes(model: Model, touched: DataFrame, level: str = "file") -> DataFrame:
    """missed_by_change() for one change that touched(key), best first."""
    out = missed_by_change(model, touched.select(F.lit(0).alias("change"), "key"), level)
    return out.drop("change").orderBy(F.desc("confidence"), F.desc("support"), "target")
