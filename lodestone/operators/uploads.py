"""Selection of uploaded files and labels of media blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.articles import IMAGE_TYPES, PDF_TYPE


def allowed(mime: Column) -> Column:
    return F.coalesce(mime.isin(*IMAGE_TYPES, PDF_TYPE), F.lit(False))


def _held(attached: DataFrame) -> DataFrame:
    return attached.select(F.col("name").alias("held_name"), F.col("mime_type").alias("held_type"))


def _same() -> Column:
    """PDFs are the same by name, images by name and type; an image is never the same as a PDF."""
    return (F.col("name") == F.col("held_name")) & (F.col("mime_type") == F.col("held_type"))


def duplicates(files: DataFrame, attached: DataFrame) -> DataFrame:
    """Allowed files that are attached already."""
    return files.where(allowed(F.col("mime_type"))).join(_held(attached), _same(), "left_semi")


def unique(files: DataFrame, attached: DataFrame) -> DataFrame:
    """Allowed files that are not attached yet; equal files of one drop all pass."""
    return files.where(allowed(F.col("mime_type"))).join(_held(attached), _same(), "left_anti")


def is_media(kind: Column, mime: Column) -> Column:
    """An image block, or a file block of an image or PDF."""
    image = F.coalesce(mime.startswith("image/"), F.lit(False))
    return F.coalesce(((kind == "image") & image) | ((kind == "file") & (image | (mime == PDF_TYPE))), F.lit(False))


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), data)


def file_label(filename: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(filename, F.lit("")), F.nullif(name, F.lit("")), F.lit("PDF file"))


def removed_at(blocks: Column, index: int) -> Column:
    """An array without the element at a 0-based index."""
    return F.filter(blocks, lambda _, i: i != index)
