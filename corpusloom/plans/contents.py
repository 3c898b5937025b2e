"""From captures to canonical documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.digests import digest
from corpusloom.functions.text import is_blank
from corpusloom.functions.urls import capturable
from corpusloom.operators.route import matches, routed
from corpusloom.operators.validate import envelope_errors
from corpusloom.sources import visible_html


def envelopes(rows: DataFrame, id_col: Column, kind: str, text: Column | None = None, html: Column | None = None, url: Column | None = None, title: Column | None = None, captured_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Envelopes of a table's rows: a selection (text) or a whole page (html)."""
    null = F.lit(None).cast("string")
    either = lambda x: null if x is None else x
    return rows.select(
        F.lit("0.3").alias("schema_version"),
        id_col.cast("string").alias("id"),
        F.struct(F.lit("browser" if url is not None else "api").alias("type"), null.alias("provider"), either(url).alias("url")).alias("source"),
        F.struct(F.lit(kind).alias("type"), null.alias("mime_type"), either(text).alias("text"), either(html).alias("html"), null.alias("file_ref"), F.when(~is_blank(either(title)), either(title)).alias("title")).alias("payload"),
        F.struct(F.lit(captured_at).alias("captured_at"), null.alias("device"), null.alias("application")).alias("context"),
        F.struct(F.lit("save").alias("action"), null.alias("collection"), F.array().cast("array<string>").alias("tags")).alias("intent"),
    )


def admitted(captures: DataFrame, processors: dict | None = None) -> DataFrame:
    """captures with errors, and with the processor that each goes to (or the routing error)."""
    names = matches(F.col("payload.type"), F.coalesce(F.col("payload.mime_type"), F.lit("")), processors)
    return captures.withColumn("errors", envelope_errors()).withColumn("_to", routed(names)).withColumns({"processor": F.col("_to.processor"), "route_error": F.col("_to.error")}).drop("_to")


def text_contents(captures: DataFrame) -> DataFrame:
    """A segment with the text as it is."""
    return _one_segment(captures.withColumn("_text", F.col("payload.text")).withColumn("_title", F.col("payload.title")), "text", "original", F.col("payload.text"))


def web_contents(captures: DataFrame, closed: bool = False) -> DataFrame:
    """A segment with the page's visible text; the submitted title before the page's own. Pages
    without visible text are an error of processing, not an empty document. closed: references
    count with their semicolon only."""
    read = visible_html.read(captures, "payload", "html", text="_text", title="_found", closed=closed).withColumn("_title", F.coalesce("payload.title", "_found"))
    return _one_segment(read, "web", "html", F.col("payload.html"))


def _one_segment(df: DataFrame, kind: str, provenance: str, original: Column) -> DataFrame:
    return df.select(
        F.col("id").alias("capture_id"),
        F.lit(kind).alias("type"),
        F.col("_title").alias("title"),
        digest(original).alias("sha256"),
        F.array(F.struct(F.lit(0).alias("position"), F.lit("text").alias("type"), F.col("_text").alias("text"), F.lit(provenance).alias("provenance"))).alias("segments"),
        F.when(is_blank(F.col("_text")), "failed").otherwise("complete").alias("status"),
    )


def capturable_pages(pages: DataFrame, url_col: str = "url", html_col: str | None = None) -> DataFrame:
    """The pages whose address may be captured and, if html_col is told, whose HTML isn't blank."""
    fine = capturable(F.col(url_col))
    return pages.where(fine if html_col is None else fine & ~is_blank(F.col(html_col)))
