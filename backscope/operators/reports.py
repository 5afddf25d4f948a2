"""Compliance reports as text: JSON, Markdown, HTML and console, a report for each framework.

A report has its title, score, rate and risk, its categories with their scores, and its findings with what to do. The
control list bounds its size. Controls are those of proofs.judged().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import proofs

#: What `render` takes, and how it calls a control's state.
MARKS = {"compliant": "[ok]", "partial": "[part]", "non_compliant": "[fail]"}


def facts(controls: DataFrame) -> DataFrame:
    """framework, score, rate, risk, status, categories (name, score, status) and findings (control, severity, recommendation), in order."""
    points = F.when(F.col("status") == "compliant", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    counted = F.col("status") != "not_applicable"
    per = controls.groupBy("framework", "category").agg(F.sum(F.when(counted, points)).alias("points"), F.count_if(counted).alias("n"))
    score = F.round(F.when(F.col("n") > 0, 100.0 * F.col("points") / F.col("n")).otherwise(0.0), 1)
    state = F.when(score >= 100, "compliant").when(score > 0, "partial").otherwise("non_compliant")
    categories = per.groupBy("framework").agg(F.sort_array(F.collect_list(F.struct(F.col("category").alias("name"), score.alias("score"), state.alias("status")))).alias("categories"))
    found = proofs.findings(controls).groupBy("framework").agg(F.sort_array(F.collect_list(F.struct("control", "severity", "recommendation"))).alias("findings"))
    whole = proofs.scores(controls).select("framework", F.round("score", 1).alias("score"), F.round("rate", 1).alias("rate"), "risk")
    out = whole.join(categories, "framework").join(found, "framework", "left")
    none = F.array().cast("array<struct<control: string, severity: string, recommendation: string>>")
    out = out.withColumn("findings", F.coalesce("findings", none))
    return out.withColumn("status", F.when(F.col("score") >= 100, "compliant").when(F.size("findings") > 0, "non_compliant").otherwise("partial"))


def _mark(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), status)


def _safe(text: Column) -> Column:
    out = text
    for raw, told in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(told))
    return out


def _lines(*parts: Column | str | Callable) -> Column:
    """Lines of text, and arrays of lines, as one text."""
    return F.array_join(F.flatten(F.array(*[p if isinstance(p, Column) else F.array(F.lit(p)) for p in parts])), "\n")


def _one(*parts: Column | str) -> Column:
    return F.array(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def _each(column: str, line: Callable[[Column], Column]) -> Column:
    return F.transform(column, line)


def render(controls: DataFrame, style: str, title: str, as_of: str) -> DataFrame:
    """(framework, report): style is json, markdown, html or console."""
    f = facts(controls)
    number = lambda c: F.format_string("%.1f", c)
    score, rate, risk = number(F.col("score")), number(F.col("rate")), F.col("risk").cast("string")
    if style == "json":
        text = F.to_json(F.struct(F.lit(title).alias("title"), "framework", F.lit(as_of).alias("generated_at"), "status", "score", "rate", "risk", "categories", "findings"))
    elif style == "markdown":
        text = _lines(
            _one("# ", F.lit(title), ": ", F.col("framework")), "", _one("Made at ", F.lit(as_of), ". State: ", F.col("status"), ". Score ", score, " %, rate ", rate, " %, risk ", risk, "."), "",
            "| Category | Score | State |", "|-|-|-|", _each("categories", lambda c: F.concat(F.lit("| "), c["name"], F.lit(" | "), number(c["score"]), F.lit(" | "), c["status"], F.lit(" |"))), "",
            "| Control | Severity | What to do |", "|-|-|-|", _each("findings", lambda x: F.concat(F.lit("| "), x["control"], F.lit(" | "), x["severity"], F.lit(" | "), x["recommendation"], F.lit(" |"))),
        )
    elif style == "html":
        cell = lambda c: F.concat(F.lit("<td>"), _safe(c), F.lit("</td>"))
        text = _lines(
            "<!DOCTYPE html>", _one("<html><head><meta charset=\"UTF-8\"><title>", _safe(F.lit(title)), "</title></head><body>"), _one("<h1>", _safe(F.lit(title)), ": ", _safe(F.col("framework")), "</h1>"),
            _one("<p class=\"", F.col("status"), "\">Made at ", F.lit(as_of), ". Score ", score, " %, rate ", rate, " %, risk ", risk, ".</p>"),
            "<table>", _each("categories", lambda c: F.concat(F.lit("<tr class=\""), c["status"], F.lit("\">"), cell(c["name"]), cell(number(c["score"])), F.lit("</tr>"))), "</table>",
            "<table>", _each("findings", lambda x: F.concat(F.lit("<tr class=\""), x["severity"], F.lit("\">"), cell(x["control"]), cell(x["recommendation"]), F.lit("</tr>"))), "</table>", "</body></html>",
        )
    elif style == "console":
        text = _lines(
            _one(F.lit(title), ": ", F.col("framework")), _one("made at ", F.lit(as_of), ", ", F.col("status"), ", score ", score, " %, rate ", rate, " %, risk ", risk), "categories",
            _each("categories", lambda c: F.concat(F.lit("  "), F.rpad(_mark(c["status"]), 7, " "), F.rpad(c["name"], 24, " "), number(c["score"]))), "findings",
            _each("findings", lambda x: F.concat(F.lit("  "), F.rpad(x["severity"], 7, " "), F.rpad(x["control"], 24, " "), x["recommendation"])),
        )
    else:
        raise ValueError(f"no style {style}: json, markdown, html or console")
    return f.select("framework", text.alias("report"))
