"""Strict JSON parsing into a layout or a variant, and type tests on variant values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import left_trimmed, trimmed_long

FENCE = "```"
_MARK = "~~ end of value ~~"
# From this size on a valid value may be larger than a variant can be.
_LARGE = 16 << 20
_STRICT = {
    "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxStringLen": str(2 ** 31 - 1),
}


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_value(text: Column, layout: str) -> Column:
    """The text as ``layout`` (columns, or ``array<struct<...>>``) if it is exactly one JSON value.

    Null for anything else, and where the root is of another kind; members of another type
    are null. One parse and no limit of size: the text is the first element of an array with
    an end mark as its second. A text with something behind its value leaves the mark out of
    that place. One that holds the mark itself is marked with its digest, which no text holds.
    """
    listed = layout.startswith("array<struct<")
    members = layout.removeprefix("array<struct<").removesuffix(">>") if listed else layout
    root = f"struct<{members}, `~end` string>"
    mark = F.when(text.contains(_MARK), F.sha2(text, 256)).otherwise(_MARK)
    tail = (',[{"~end":"', '"}]]') if listed else (',{"~end":"', '"}]')
    marked = F.concat(F.lit("["), text, F.lit(tail[0]), mark, F.lit(tail[1]))

    def unmarked(pair: Column) -> Column:
        last = F.get(F.get(pair, F.lit(1)), F.lit(0)) if listed else F.get(pair, F.lit(1))
        return F.when((F.size(pair) == 2) & (last["~end"] == mark), F.get(pair, F.lit(0)))

    parsed = F.from_json(marked, f"array<array<{root}>>" if listed else f"array<{root}>", _STRICT)
    return F.when(left_trimmed(text).startswith("[" if listed else "{"), let(parsed, unmarked))


def strict_json(text: Column) -> Column:
    """Variant of exactly one JSON value, null for anything else.

    A variant holds 128 MB at most. A valid value that is too large fails the job.
    """
    return let(_marked(text), lambda marked: _strict(text, marked))


def _marked(text: Column) -> Column:
    """The text in an array with an end mark behind it, parsed; null for text that holds the mark."""
    return F.when(
        ~text.contains(_MARK), F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]'))))


def _strict(text: Column, marked: Column) -> Column:
    """The value of :func:`_marked` text; no function of an array, so Spark compiles it.

    The built-in parser stops after the first value. Inside an array with an end mark
    behind it, trailing text or a second value leaves the mark out of second place. Text
    that holds the mark itself is checked by wrapping it in an object and in an array,
    which cannot both swallow the same trailing text.
    """
    ends = F.try_variant_get(marked, "$[1]", "string") == _MARK
    single = F.when(ends, F.try_variant_get(marked, "$[0]", "variant"))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    wrapped = F.when(as_element.isNotNull(), F.try_variant_get(as_member, "$.v", "variant"))
    value = F.when(text.contains(_MARK), wrapped).otherwise(single)
    elements = F.from_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')), "array<string>", _STRICT)
    valid = (F.size(elements) == 2) & (F.get(elements, F.lit(1)) == _MARK)
    lost = (F.octet_length(text) > _LARGE) & valid
    too_large = F.raise_error(F.lit("JSON value is larger than a variant can be"))
    return F.coalesce(value, F.when(lost, too_large.cast("variant")))


def without_fences(text: Column) -> Column:
    """Drops a leading and a trailing code fence, then trims."""
    return let(_unfenced(text), trimmed_long)


def _unfenced(text: Column) -> Column:
    opened = F.regexp_replace(text, "(?i)^" + FENCE + r"(?:json)?\s*", "")
    closed = F.regexp_replace(opened, r"\s*" + FENCE + r"\z", "")
    return F.when(text.contains(FENCE), closed).otherwise(text)


def _bracketed(text: Column) -> Column:
    """Whether the text is within braces, brackets or quotes, each with an end of its own."""
    quoted = text.startswith('"') & text.endswith('"') & (F.octet_length(text) > 1)
    return (text.startswith("{") & text.endswith("}")) | (text.startswith("[") & text.endswith("]")) | quoted


def _braces(text: Column) -> Column:
    """The text from its first opening to its last closing brace, empty without these."""
    start = F.instr(text, "{")
    end = F.length(text) - F.length(F.substring_index(text, "}", -1))
    return F.when(start == 0, "").otherwise(F.substring(text, start, end - start + 1))


def computed_once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that later filters must not copy.

    Spark moves a filter below the projection it reads and so evaluates the expression
    twice. The output of a one-element generator is left where it is.
    """
    return frame.select("*", F.explode_outer(F.array(value)).alias(name))


def with_document(frame: DataFrame, text: str, into: str) -> DataFrame:
    """Adds ``struct<root, doc>``: the JSON document in a text and its opening character.

    The document is the text without fences, else the widest brace-to-brace span in it.
    Every step is a column that the next ones name more than once, so Spark neither merges nor
    copies them, and none is a function of an array, which Spark does not compile. A filter on
    the result would copy them all: readers put it behind a generator (:func:`computed_once`).
    """
    opened = frame.withColumn("__open", _unfenced(F.col(text)))
    cleaned = opened.withColumn("__clean", trimmed_long(F.col("__open")))
    clean, direct, span = F.col("__clean"), F.col("__direct"), F.col("__span")
    # A failing parse is costly, so only text with matching outer brackets is tried. Bare
    # numbers and words are no document and hold no braces, so they need no parse either.
    bracketed = _bracketed(clean)
    marked = cleaned.withColumn("__marked", F.when(bracketed, _marked(clean)))
    parsed = marked.withColumn("__direct", F.when(bracketed, _strict(clean, F.col("__marked"))))
    spanned = parsed.withColumn("__span", F.when(direct.isNull(), _braces(clean)))
    inner = spanned.withColumn("__inner", F.when(span != "", _marked(span)))
    found = F.when(
        direct.isNotNull(), F.struct(F.substring(clean, 1, 1).alias("root"), direct.alias("doc"))
    ).otherwise(F.struct(
        F.lit("{").alias("root"), F.when(span != "", _strict(span, F.col("__inner"))).alias("doc")))
    return inner.withColumn(into, found).drop("__open", "__clean", "__marked", "__direct", "__span", "__inner")


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_value(member: Column) -> Column:
    """A variant as string, null when it is of another type."""
    return F.when(_kind(member) == "STRING", F.try_variant_get(member, "$", "string"))


def text_field(value: Column, name: str) -> Column:
    """String member, null when absent or of another type."""
    return F.when(_kind(field(value, name)) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def number_field(value: Column, name: str) -> Column:
    """Numeric member as double, null when absent or of another type."""
    numeric = _kind(field(value, name)).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(numeric, F.try_variant_get(value, f"$.{name}", "double"))


def array_field(value: Column, name: str, of: str = "variant") -> Column:
    """Array member as ``array<of>``, null when absent or of another type; elements of another type are null."""
    return F.try_variant_get(value, f"$.{name}", f"array<{of}>")
