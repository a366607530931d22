"""Text expressions. Lengths and positions are in characters (code points)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII white space that is stripped from both ends.
WHITE_SPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Without leading and trailing white space, tabs and line ends included."""
    return F.trim(c, F.lit(WHITE_SPACE))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def has(c: Column, part: str) -> Column:
    """Whether a text contains a part, whatever their case."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def search_term(c: Column, length: int = 40) -> Column:
    """The first characters of a passage on one line, stripped: what is looked for on pages."""
    return strip(F.replace(F.substring(c, 1, length), F.lit("\n"), F.lit(" ")))


def first_part(c: Column, delimiter: str = ",") -> Column:
    """What stands before the first delimiter, stripped; null: empty."""
    return strip(F.split_part(or_empty(c), F.lit(delimiter), F.lit(1)))


def shown(c: Column) -> Column:
    """A value in running text; null shows as None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def file_name(key: Column, number: Column, suffix: str = ".pdf") -> Column:
    """The file that a catalogue entry's document is kept under: <key>_<number with / as _>.pdf."""
    return F.concat(shown(key), F.lit("_"), F.replace(number, F.lit("/"), F.lit("_")), F.lit(suffix))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def title(source: Column, suffix: str = ".pdf", longest: int = 40) -> Column:
    """A file name as a heading: without suffix, underscores as spaces, cut to `longest` characters and dots."""
    name = F.replace(F.replace(source, F.lit(suffix), F.lit("")), F.lit("_"), F.lit(" "))
    return F.when(F.length(name) > longest, F.concat(F.substring(name, 1, longest), F.lit("..."))).otherwise(name)


def grouped(c: Column, decimals: int = 0) -> Column:
    """A number with thousands separators."""
    return F.format_number(c.cast("double"), decimals)


def megabytes(size: Column) -> Column:
    """A size in bytes as megabytes with two decimals."""
    return F.format_string("%.2f", size.cast("double") / F.lit(1024.0 * 1024.0))


def percent(part: Column, whole: Column) -> Column:
    """A share with one decimal; null where there is no whole."""
    return F.when(whole != 0, F.format_string("%.1f", part.cast("double") * 100.0 / whole.cast("double")))


def data_uri(content: Column, page: Column | None = None, mime: str = "application/pdf") -> Column:
    """Bytes as a data URI that opens at a page."""
    uri = F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))
    return uri if page is None else F.concat(uri, F.lit("#page="), page.cast("string"))


def natural_id(*parts: Column) -> Column:
    """A reproducible id of a natural key. Parts keep their bounds, and nulls differ from empty texts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
