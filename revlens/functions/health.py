"""How healthy a file of code is, from 1 to 10, and why not better."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beyond these a file loses health, and what the reasons below say of it.
BRAIN_CC = 15
DEEP_NESTING = 4
LONG_FUNCTION = 80
LARGE_FILE = 600
HUGE_FILE = 1500
MANY_DEPS = 7
MANY_INPUTS = 10
COMPLEX_TEMPLATE = 25.0
MANY_METHODS = 20
CODE = ("typescript", "tsx", "javascript", "php")
PARSED = (*CODE, "template", "scss", "css")


def _penalties() -> list[tuple[Column, Column, Column]]:
    """(holds, penalty, reason) of each rule."""
    c = F.col
    code = c("lang").isin(*CODE)
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    total = lambda items, f: F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))
    worst = lambda items, field: F.element_at(F.array_sort(items, lambda x, y: (y[field] - x[field]).cast("int")), 1)
    plural = lambda items: F.when(F.size(items) == 1, "").otherwise("s")
    brain, long_ = F.filter("functions", lambda f: f["cc"] > BRAIN_CC), F.filter("functions", lambda f: f["loc"] > LONG_FUNCTION)
    return [
        (code & (F.size(brain) > 0), F.least(total(brain, lambda f: F.least(1 + (f["cc"] - BRAIN_CC) / 10, F.lit(3.0))), F.lit(5.0)),
         text(F.size(brain), " complex function", plural(brain), f" (cc > {BRAIN_CC}); worst `", worst(brain, "cc")["name"], "` cc ", worst(brain, "cc")["cc"])),
        (code & (F.size(long_) > 0), F.least(F.size(long_) * 0.5, F.lit(2.0)),
         text(F.size(long_), " long function", plural(long_), f" (> {LONG_FUNCTION} lines); longest `", worst(long_, "loc")["name"], "` ", worst(long_, "loc")["loc"], " lines")),
        (c("max_nesting") > DEEP_NESTING, F.when(c("max_nesting") > DEEP_NESTING + 2, 1.5).otherwise(1.0), text("deep nesting (depth ", c("max_nesting"), ")")),
        (c("loc") > HUGE_FILE, F.lit(2.0), text("very large file (", c("loc"), " lines)")),
        ((c("loc") > LARGE_FILE) & (c("loc") <= HUGE_FILE) & code, F.lit(1.0), text("large file (", c("loc"), " lines)")),
        (c("deps") > MANY_DEPS, F.lit(1.0), text(c("deps"), f" injected dependencies (> {MANY_DEPS})")),
        (c("inputs") > MANY_INPUTS, F.lit(1.0), text(c("inputs"), f" inputs (> {MANY_INPUTS})")),
        ((c("lang") == "template") & (c("complexity") > COMPLEX_TEMPLATE), F.least((c("complexity") - COMPLEX_TEMPLATE) / 15 + 1, F.lit(3.0)), text("complex template (complexity ", c("complexity").cast("int"), ")")),
        ((c("lang") == "php") & (c("methods") > MANY_METHODS), F.lit(1.0), text(c("methods"), f" methods in one file (> {MANY_METHODS})")),
    ]


def health() -> Column:
    """health and reasons as a struct, over lang, generated, functions(name, cc, loc), max_nesting, loc, deps, inputs, complexity and methods.

    Null metrics cost nothing. Files that are not code, and generated ones, are as healthy as can be.
    """
    counts = F.col("lang").isin(*PARSED) & ~F.coalesce(F.col("generated"), F.lit(False))
    total, reasons = F.lit(0.0), []
    for holds, penalty, reason in _penalties():
        holds = F.coalesce(counts & holds, F.lit(False))
        total = total + F.when(holds, penalty).otherwise(0.0)
        reasons.append(F.when(holds, reason))
    return F.struct(F.round(F.greatest(10 - F.least(total, F.lit(9.0)), F.lit(1.0)), 1).alias("health"), F.array_compact(F.array(*reasons)).alias("reasons"))
