"""Text rules and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SHOWN_CHARS = 1000
DEFAULT_TEXT, DEFAULT_FONT = "Double-click to edit", "Arial"


def shown(text: Column) -> Column:
    """Texts of over 1000 characters are cut there and end in three dots. Characters are code points."""
    return F.when(F.length(text) > SHOWN_CHARS, F.concat(F.left(text, F.lit(SHOWN_CHARS)), F.lit("..."))).otherwise(text)


def style(runs: Column) -> Column:
    """Font, size and colour of the first run; without runs Arial, no size, black."""
    first = F.try_element_at(runs, F.lit(1))
    black = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in zip("rgba", (0, 0, 0, 1), strict=True)])
    return F.struct(F.coalesce(first["font_family"], F.lit(DEFAULT_FONT)).alias("font_family"), first["font_size"].alias("font_size"), F.coalesce(first["color"], black).alias("color"))


def alignment(code: Column) -> Column:
    return F.when(code == 1, "center").when(code == 2, "right").otherwise("left")


def suffix(path: Column) -> Column:
    """What follows the last dot of the file name, lower case."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def title(path: Column, dirty: Column, application: str) -> Column:
    name = F.when(F.coalesce(path, F.lit("")) == "", F.lit("Untitled")).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))
    return F.concat(name, F.when(dirty, F.lit(" *")).otherwise(F.lit("")), F.lit(f" - {application}"))


def page_label(index: Column, count: Column) -> Column:
    return F.format_string("Page %d of %d", index + 1, count)


def zoom_label(zoom: Column) -> Column:
    return F.concat((zoom * 100).try_cast("int").cast("string"), F.lit("%"))


def selection_label(element_id: Column) -> Column:
    """Ready where nothing is selected (null)."""
    return F.when(element_id.isNull(), F.lit("Ready")).otherwise(F.concat(F.lit("Selected element "), element_id.cast("string")))


def cursor(mode: Column) -> Column:
    return F.when(mode == "TextEdit", "IBeam").when(mode.isin("DrawRect", "DrawEllipse", "DrawLine", "InsertImage"), "Cross").otherwise("Arrow")
