"""Parsers from files (path, value) to facts: splitting, carrying headers forward and classifying are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cells, lstrip_set, strip
from ..schema import FACT
from .files import lines

#: Lengths that texts are cut at, fewest characters of prose and of a paragraph, code fence.
LONG, SHORT, PROSE, PARAGRAPH, FENCE = 800, 400, 40, 30, "```"
HEADER = r"(?U)^## (\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2})?) — (.+)$"


def _carried(value: Column) -> Column:
    """The last value set at or above a line of its file."""
    order = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(value, ignorenulls=True).over(order), F.lit(""))


def _fact(df: DataFrame, source: str | Column, text: Column, kind: str | Column, section: Column, date: Column | None = None, order: str = "n") -> DataFrame:
    made = df.select(
        F.col(order).cast("long").alias("ord"),
        text.alias("text"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        section.alias("section"),
        F.col("path").alias("file_path"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        (F.lit(None).cast("string") if date is None else date).alias("date"),
    )
    return made.where("text is not null and type is not null")


def markdown_facts(files: DataFrame, source: str = "vps-docs") -> DataFrame:
    """Table rows whose first cell is bold, bullets and prose of a server document, each behind its section's title."""
    line = F.col("line")
    heading = line.startswith("## ") | line.startswith("### ")
    df = lines(files).withColumn("section", _carried(F.when(heading, strip(lstrip_set(line, "# ")))))
    row = cells(line)
    name, rest = F.replace(F.get(row, F.lit(0)), F.lit("**"), F.lit("")), F.array_join(F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))), " | ")
    kind = (
        F.when(heading, None)
        .when(line.startswith("| **"), F.when(F.size(row) >= 4, "service"))
        .when(line.startswith(FENCE) | line.startswith("    "), None)
        .when(line.startswith("- ") | line.startswith("* "), "config")
        .when((F.char_length(line) > PROSE) & ~line.startswith("|"), "documentation")
    )
    df = df.withColumn("kind", kind)
    body = F.when(F.col("kind") == "service", F.concat(name, F.lit(" — "), rest)).when(F.col("kind") == "config", lstrip_set(line, "-* ")).otherwise(line)
    return _fact(df, source, F.substring(F.concat(F.col("section"), F.lit(": "), body), 1, LONG), F.col("kind"), F.col("section"))


def changelog_facts(files: DataFrame, source: str = "changelog") -> DataFrame:
    """Dated headers and the bullets below them, each behind its date; bullets before the first header go."""
    line = F.col("line")
    day = F.nullif(F.regexp_extract(line, HEADER, 1), F.lit(""))
    df = lines(files).withColumn("day", day).withColumn("date", _carried(day))
    bullet = line.startswith("- ") & (F.col("date") != "")
    text = F.when(F.col("day").isNotNull(), F.concat("day", F.lit(": "), F.regexp_extract(line, HEADER, 2)))
    text = text.when(bullet, F.substring(F.concat("date", F.lit(": "), lstrip_set(line, "- ")), 1, LONG))
    kind = F.when(F.col("day").isNotNull(), "changelog-entry").when(bullet, "changelog-detail")
    return _fact(df, source, text, kind, F.lit("changelog"), F.col("date"))


def project_facts(files: DataFrame, root: str = "/var/www") -> DataFrame:
    """Paragraphs of more than 30 characters that are no heading and no code, behind their project's name."""
    project = F.regexp_extract("path", "^" + root.rstrip("/") + "/([^/]+)/", 1)
    split = files.withColumn("project", project).where("project <> ''").select("path", "project", F.posexplode(F.split("value", "\n\n")).alias("n", "raw"))
    p = strip(F.col("raw"))
    kept = split.withColumn("p", p).where((F.char_length("p") > PARAGRAPH) & ~F.col("p").startswith("#") & ~F.col("p").startswith(FENCE))
    text = F.substring(F.concat(F.lit("["), F.col("project"), F.lit("] "), F.replace(F.col("p"), F.lit("\n"), F.lit(" "))), 1, LONG)
    return _fact(kept, F.concat(F.lit("project-"), F.col("project")), text, "project-doc", F.col("project"))


def _first(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("value", pattern, group), F.lit(""))


def proxy_facts(files: DataFrame, source: str = "nginx-routes") -> DataFrame:
    """Each listen address with each proxied target of a configuration."""
    name = F.element_at(F.split("path", "/"), -1)
    df = files.where(~F.contains("path", F.lit("default")))
    df = df.withColumns(
        {
            "name": F.coalesce(strip(_first(r"(?U)server_name\s+([^;]+);")), name),
            "rate": _first(r"rate=([^;]+);"),
            "targets": F.regexp_extract_all("value", F.lit(r"(?U)proxy_pass\s+(https?://[^;]+);"), F.lit(1)),
            "listens": F.regexp_extract_all("value", F.lit(r"(?U)listen\s+([^;]+);"), F.lit(1)),
        }
    )
    df = df.select("path", "name", "rate", F.posexplode("listens").alias("i", "listen"), "targets").select("*", F.posexplode("targets").alias("j", "target"))
    df = df.withColumn("n", F.col("i") * F.size("targets") + F.col("j"))
    tail = F.coalesce(F.concat(F.lit(" | rate limit: "), F.col("rate")), F.lit(""))
    text = F.concat(F.lit("nginx: "), F.col("name"), F.lit(" → "), F.trim("target"), F.lit(" (port "), F.trim("listen"), F.lit(")"), tail)
    return _fact(df, source, F.substring(text, 1, SHORT), "nginx-route", F.lit("nginx-routes"))


def service_facts(files: DataFrame, source: str = "systemd-services") -> DataFrame:
    """The command of a service unit, with its description."""
    name = F.replace(F.element_at(F.split("path", "/"), -1), F.lit(".service"), F.lit(""))
    df = files.withColumns({"command": strip(_first(r"ExecStart=([^\n]+)")), "about": strip(_first(r"Description=([^\n]+)")), "n": F.lit(0)})
    text = F.concat(F.lit("systemd service "), name, F.lit(": "), F.col("command"), F.coalesce(F.concat(F.lit(" ("), F.col("about"), F.lit(")")), F.lit("")))
    return _fact(df, source, F.substring(text, 1, SHORT), "systemd", F.lit("systemd-services"))


def static_facts(spark: SparkSession, rows: list[tuple[str, str]], source: str = "infrastructure") -> DataFrame:
    """Literal facts: (section, text)."""
    return spark.createDataFrame([(i, t, source, s, "rules", "infrastructure", None) for i, (s, t) in enumerate(rows)], FACT)
