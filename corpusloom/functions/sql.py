"""The readers as table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="text: string, title: string")
class VisibleHtml:
    def eval(self, html: str):
        from corpusloom.sources.visible_html import visible

        if html is not None:
            yield visible(html)


@udtf(returnType="position: int, text: string, table_index: int, row_index: int")
class DocxBlocks:
    def eval(self, content: bytes):
        from corpusloom.sources.documents import docx_blocks

        for i, block in enumerate(docx_blocks(content)[1] if content else []):
            yield (i, *block)


@udtf(returnType="page: int, text: string")
class PdfPages:
    def eval(self, content: bytes):
        from corpusloom.sources.documents import pdf_pages

        for n, text in enumerate(pdf_pages(content)[1] if content else [], 1):
            yield n, text


@udtf(returnType="position: int, text: string, start: double, end: double")
class CaptionCues:
    def eval(self, xml: str):
        from corpusloom.sources.media import caption_cues

        for i, cue in enumerate(caption_cues(xml) if xml else []):
            yield (i, *cue)


def register(spark: SparkSession) -> None:
    for name, function in (("visible_html", VisibleHtml), ("docx_blocks", DocxBlocks), ("pdf_pages", PdfPages), ("caption_cues", CaptionCues)):
        spark.udtf.register(name, function)
