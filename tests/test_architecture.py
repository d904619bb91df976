from revlens.operators.architecture import detect_units, frameworks, tree_excludes
from revlens.operators.resolution import resolve_units
from revlens.plans.model import Params
from revlens.sources.history import from_history


def tree_of(spark, repo, files):
    return spark.createDataFrame([(repo, p, None if c is None else c.encode()) for p, c in files.items()], "repo string, path string, content binary")


def units(df, repo):
    return {r["root"]: (r["unit"], r["kind"], r["tags"], r["source"]) for r in df.filter(df["repo"] == repo).collect()}


FRONT = {
    "nx.json": "{}", "package.json": '{"dependencies": {"@angular/core": "19"}}', "apps/bake/project.json": '{"name": "bake", "projectType": "application", "tags": ["scope:bake", 3]}',
    "apps/bake/package.json": '{"name": "@oven/bake"}', "apps/bake/module-federation.config.ts": "export default { remotes: ['till'] }", "apps/till/project.json": '{"name": "till"}',
    "apps/till/webpack.prod.config.js": "module.exports = withModuleFederation({ exposes: {} })", "apps/till/src/app/sum/sum.routes.ts": "", "apps/till/src/app/app.routes.ts": "",
    "apps/till/src/app/sum/e2e/x.module.ts": "", "libs/dough/project.json": '{"projectType": "library"}', "libs/bad/project.json": "{", "libs/dough/x.ts": "", "tools/gen/package.json": '{"name": "bake"}',
    "tools/webpack.config.js": "plain", "node_modules/a/package.json": "{}", "free/federation.config.js": "", "free/in/federation.config.mjs": "exposes", "free/a/federation.config.mjs": "",
    "libs/dough/part/part.module.ts": "", "libs/dough/part/package.json": "{}",
}
SHOP = {"angular.json": '{"projects": {"orders": {"root": "", "sourceRoot": "src/", "projectType": "application"}, "ui": {"root": "projects/ui", "projectType": "library"}, "odd": "text"}}', "federation.config.js": "withNativeFederation({ exposes: {} })", "src/app/a.ts": ""}
API = {
    "composer.json": '{"require": {"laravel/framework": "^11"}}', "artisan": "", "app/Models/Order.php": "", "app/Http/Controllers/C.php": "", "app/Http/Kernel.php": "", "routes/api.php": "", "app/Providers.php": "",
    "pkg/mail/composer.json": '{"name": "acme/mail", "require": {"symfony/framework-bundle": "7"}}', "pkg/mail/src/Entity/M.php": "", "pkg/mail/src/Kernel.php": "", "tool/composer.json": "no json", "tool/artisan": "", "tool/app/Jobs/J.php": "",
}


def test_units_of_manifests(spark):
    tree = tree_of(spark, "front", FRONT).unionByName(tree_of(spark, "shop", SHOP)).unionByName(tree_of(spark, "api", API)).unionByName(tree_of(spark, "plain", {"a/b.ts": "x", ".gitattributes": None}))
    got = detect_units(tree)
    assert units(got, "front") == {
        "apps/bake": ("bake", "mfe", ["scope:bake", "3", "host"], "nx"),  # the project, not the package of its directory
        "apps/till": ("till", "mfe", ["remote"], "nx"),
        "libs/dough": ("dough", "lib", [], "nx"),
        "tools/gen": ("tools/gen", "package", [], "node"),  # its name is taken
        "apps/till/src/app/sum": ("sum", "feature", [], "angular"),
        "libs/dough/part": ("part", "package", [], "node"),  # where a unit is, no feature is made
        "free/a": ("a", "mfe", ["mfe"], "module-federation"),
        "free": ("free", "mfe", ["mfe", "remote"], "module-federation"),  # after free/a by path; what lies below and follows is in it
    }
    assert units(got, "shop") == {"src": ("orders", "app", [], "angular"), "projects/ui": ("ui", "lib", [], "angular"), "": ("odd", "mfe", ["remote"], "angular")}
    assert units(got, "api") == {
        "app/Models": ("app/Models", "layer", [], "laravel"), "app/Http/Controllers": ("app/Http/Controllers", "layer", [], "laravel"), "pkg/mail/src/Entity": ("src/Entity", "layer", [], "symfony"),
        "pkg/mail": ("acme/mail", "service", [], "php"), "tool/app/Jobs": ("app/Jobs", "layer", [], "laravel"), "tool": ("tool", "service", [], "php"),
    }
    assert units(got, "plain") == {}
    f = {}
    for r in frameworks(tree).collect():
        f.setdefault(r["repo"], set()).add(r["framework"])
    assert f == {"front": {"nx", "node", "angular", "module-federation"}, "shop": {"angular", "module-federation"}, "api": {"php", "laravel", "symfony"}}
    none = spark.createDataFrame([], "repo string, place int, glob string, unit string, kind string")
    resolved = {(r["repo"], r["path"]): r["unit"] for r in resolve_units(tree.select("repo", "path"), none, got).collect()}
    assert resolved["front", "apps/till/src/app/sum/sum.routes.ts"] == "sum" and resolved["front", "libs/dough/x.ts"] == "dough" and resolved["api", "routes/api.php"] == "routes"
    assert detect_units(tree.limit(0)).count() == 0


def test_model_with_units_of_its_tree(spark):
    tree = tree_of(spark, "front", {**FRONT, ".gitattributes": "*.gen.ts linguist-generated\n", "libs/dough/y.gen.ts": "x"})
    assert [r["glob"] for r in tree_excludes(tree).collect()] == ["**/*.gen.ts"]
    log = spark.createDataFrame(
        [("front", 1, "a" * 40, "Ida", "ida@mill.org", 1000, "start", [], ["1\t0\tlibs/dough/x.ts", "1\t0\tapps/till/src/app/sum/sum.routes.ts", "2\t0\tlibs/dough/y.gen.ts"])],
        "repo string, seq long, sha string, author_name string, author_email string, ts long, message string, coauthors array<struct<name:string,email:string>>, lines array<string>",
    )
    m = from_history(log, tree, Params())
    assert {r["path"]: r["unit"] for r in m.files.collect()} == {"libs/dough/x.ts": "front:dough", "apps/till/src/app/sum/sum.routes.ts": "front:sum"}
