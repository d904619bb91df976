"""Identity resolution: people from names and addresses that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.paths import normalized_name
from revlens.plans.staging import stage

#: Parts that the nodes of one label are dealt to.
SALTS = 8

# Names and addresses of bots.
BOTS = (
    r"(?i)\[bot\]",
    r"(?i)dependabot",
    r"(?i)renovate",
    r"(?i)github-actions",
    r"(?i)^(ci|build|jenkins|gitlab-ci|semantic-release)(-bot)?\b",
    r"(?i)noreply@github\.com$",
    r"(?i)noreply@anthropic\.com$",
    r"(?i)^(claude|copilot|github copilot|cursor( agent)?|devin|codex|chatgpt|gemini|aider)\b",
)


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node that is reached over edges(a, b): label propagation with pointer jumping.

    Each round is written to the shared folder; only whether a label changed reaches the driver. Where a label leads is
    looked up once for each label, not for each node that has it. Without edges the result is empty; rows with a null
    are no edges.
    """
    edges = edges.filter("a is not null and b is not null")
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jumps = labels.filter("node <> label").select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumps = jumps.join(labels.select(F.col("label").alias("at")).distinct(), "at", "left_semi").select("at", "further", every)
        step = step.withColumn("own_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        new = step.join(jumps, (F.col("label") == F.col("at")) & (F.col("own_salt") == F.col("salt")), "left")
        new = stage(new.select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "cc-labels")
        if not new.filter("old <> label").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _key(name: Column) -> Column:
    """How an address, or a name, is compared."""
    return F.when(F.contains(name, F.lit("@")), F.concat(F.lit("e:"), F.lower(name))).otherwise(F.concat(F.lit("n:"), normalized_name(name)))


def resolve(identities: DataFrame, aliases: DataFrame | None = None, teams: DataFrame | None = None) -> DataFrame:
    """id, person, display, bot, team for identities(id, name, email, commits); aliases(canonical, alias) may join more, teams(team, member) name teams.

    Identities with one address, or one name of three letters and more, are one person. A person is a bot if any
    of its identities is; it is displayed by its canonical name, or by the name with the most commits, and is in the
    first team, by name, that lists one of its names or addresses.
    """
    email = F.when(F.col("email").contains("@"), F.concat(F.lit("e:"), F.lower("email")))
    name = F.when(F.length(normalized_name(F.col("name"))) >= 3, F.concat(F.lit("n:"), normalized_name(F.col("name"))))
    own = identities.select("id", F.format_string("i:%020d", "id").alias("a"), F.explode(F.array_compact(F.array(email, name))).alias("b"))
    links = own.select("a", "b")
    if aliases is not None:
        canonical = F.concat(F.lit("c:"), F.col("canonical"))
        links = links.union(aliases.select(canonical.alias("a"), _key(F.col("alias")).alias("b")))
        links = links.union(aliases.select(canonical.alias("a"), _key(F.col("canonical")).alias("b")))
    found = components(links)
    person = found.filter(F.col("node").startswith("i:")).select(F.substring("node", 3, 20).cast("long").alias("id"), F.col("label"))
    d = identities.join(person, "id", "left").withColumn("label", F.coalesce("label", F.format_string("i:%020d", "id")))
    bot = F.lit(False)
    for pattern in BOTS:
        bot = bot | F.coalesce(F.col("name").rlike(pattern), F.lit(False)) | F.coalesce(F.col("email").rlike(pattern), F.lit(False))
    g = d.groupBy("label").agg(F.min("id").alias("person"), F.max_by("name", F.struct("commits", -F.col("id"))).alias("most"), F.max(bot).alias("bot"))
    named = found.filter(F.col("node").startswith("c:")).groupBy("label").agg(F.min(F.expr("substring(node, 3)")).alias("canonical"))
    g = g.join(named, "label", "left").withColumn("display", F.coalesce("canonical", "most"))
    if teams is None:
        g = g.withColumn("team", F.lit(None).cast("string"))
    else:
        keys = own.join(person, "id").select("label", F.col("b").alias("key")).union(g.select("label", _key(F.col("display")).alias("key"))).distinct()
        g = g.join(keys.join(teams.select("team", _key(F.col("member")).alias("key")), "key").groupBy("label").agg(F.min("team").alias("team")), "label", "left")
    return d.select("id", "label").join(g, "label").select("id", "person", "display", "bot", "team")
