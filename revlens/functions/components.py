"""What a source text says of its component: decorators, injected dependencies, inputs, outputs and linked files, by columns alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a component, its parts and its links in a source text.
DECORATOR = r"(?m)^\s*(export\s+)?@(Component|Directive|Pipe|Injectable|NgModule)\s*\("
FUNCTIONAL = r":\s*(CanActivateFn|CanMatchFn|CanDeactivateFn|ResolveFn|HttpInterceptorFn)\b"
INJECT = r"\binject\s*[<(]"
INPUT = r"@Input\s*\(|\binput(\.required)?\s*[<(]|\bmodel(\.required)?\s*[<(]"
OUTPUT = r"@Output\s*\(|\boutput\s*[<(]"
NOT_STANDALONE = r"standalone\s*:\s*false"
STANDALONE = r"standalone\s*:\s*true"
TEMPLATE_URL = r"""templateUrl\s*:\s*['"`]([^'"`]+)['"`]"""
STYLE_URLS = r"""styleUrls?\s*:\s*(\[[^\]]*\]|['"`][^'"`]+['"`])"""
QUOTED = r"""['"`]([^'"`]+)['"`]"""
# Kinds by decorator, by the name of an injectable's file, and by the type of a function.
KINDS = {"Component": "component", "Directive": "directive", "Pipe": "pipe", "NgModule": "module"}
NAMED_KINDS = {".guard.": "guard", ".interceptor.": "interceptor", ".resolver.": "resolver"}
FUNCTION_KINDS = {"HttpInterceptorFn": "interceptor", "ResolveFn": "resolver", "CanActivateFn": "guard", "CanMatchFn": "guard", "CanDeactivateFn": "guard"}
VIEWS = ("component", "directive", "pipe")
SCRIPTS = ("typescript", "tsx", "javascript")

#: Comments, and quoted texts with their quote as a group: brackets and commas mean nothing in them.
_ASIDE = r"""(?s)//[^\n]*+|/\*.*?\*/|(")[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|(')[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|(`)[^`\\]*+(?:\\.[^`\\]*+)*+`"""
_CONSTRUCTOR = r"(?<![\w.$])constructor\s*\("
#: An arrow is no bracket; words only tell that something stands there.
_TOKEN = r"=>|[()\[\]{}<>,]|[^\s()\[\]{}<>,=]+|="


def constructor_params(text: Column) -> Column:
    """How many parameters the constructors of a text have, all together; signatures without a body don't count.

    After each opening bracket the tokens are folded with the depth of brackets: commas outside of all brackets part the
    parameters, and the bracket that closes the list ends it.
    """
    tails = F.slice(F.split(F.regexp_replace(text, _ASIDE, " $1$2$3 "), _CONSTRUCTOR), F.lit(2), F.lit(1 << 30))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("params"), F.lit(False).alias("some"), F.lit(False).alias("closed"), F.lit("").alias("behind"))

    def step(s: Column, t: Column) -> Column:
        up, down = t.isin("(", "[", "{", "<"), t.isin(")", "]", "}", ">")
        closes = down & (s["depth"] == 0)
        parts = closes | ((t == ",") & (s["depth"] == 0))
        going = F.struct(
            (s["depth"] + up.cast("int") - (down & ~closes).cast("int")).alias("depth"),
            (s["params"] + (parts & s["some"]).cast("int")).alias("params"),
            (~parts).alias("some"),
            closes.alias("closed"),
            s["behind"].alias("behind"),
        )
        over = F.struct(s["depth"].alias("depth"), s["params"].alias("params"), s["some"].alias("some"), s["closed"].alias("closed"), F.when(s["behind"] == "", t).otherwise(s["behind"]).alias("behind"))
        return F.when(s["closed"], over).otherwise(going)

    of = lambda tail: F.aggregate(F.regexp_extract_all(tail, F.lit(_TOKEN), F.lit(0)), start, step, lambda s: F.when(s["closed"] & (s["behind"] == "{"), s["params"]).otherwise(0))
    return F.aggregate(F.transform(tails, of), F.lit(0), lambda a, n: a + n)


def component_of(path: Column, text: Column) -> Column:
    """kind, deps, inputs, outputs, standalone, template_url and style_urls of a script; null where it is no component.

    deps are parameters of constructors and calls of inject(). Null texts are none.
    """
    lower = F.element_at(F.split(path, "/"), -1)
    decorator = F.nullif(F.regexp_extract(text, DECORATOR, 2), F.lit(""))
    functional = F.nullif(F.regexp_extract(text, FUNCTIONAL, 1), F.lit(""))
    by = lambda value, names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value]
    injectable = F.lit("service")
    for part, kind in reversed(NAMED_KINDS.items()):
        injectable = F.when(F.contains(lower, F.lit(part)), kind).otherwise(injectable)
    kind = F.when(decorator == "Injectable", injectable).when(decorator.isNotNull(), by(decorator, KINDS)).otherwise(by(functional, FUNCTION_KINDS))
    n = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    styles = F.regexp_extract_all(F.regexp_extract(text, STYLE_URLS, 1), F.lit(QUOTED), F.lit(1))
    found = F.struct(
        kind.alias("kind"),
        (constructor_params(text) + n(INJECT)).cast("long").alias("deps"),
        n(INPUT).alias("inputs"),
        n(OUTPUT).alias("outputs"),
        (~text.rlike(NOT_STANDALONE) & (text.rlike(STANDALONE) | kind.isin(*VIEWS))).alias("standalone"),
        F.nullif(F.regexp_extract(text, TEMPLATE_URL, 1), F.lit("")).alias("template_url"),
        styles.alias("style_urls"),
    )
    return F.when(kind.isNotNull(), found)


def links_of(component: Column) -> Column:
    """The files that a component links to; none for null."""
    urls = F.concat(F.array(component["template_url"]), component["style_urls"])
    return F.coalesce(F.array_compact(urls), F.array().cast("array<string>"))
