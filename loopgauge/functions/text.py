"""Text projections as Columns. Patterns use explicit character classes, so they mean the same in other engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Limits of excerpts and recommendations.
EXCERPT_LINES, RECOMMENDATION_LINES, RECOMMENDATION_CHARS, SIMILAR_FROM = 80, 45, 180, 40
#: Prefixes that recommendations lose, and words that make an English one generic.
PREFIXES = ("рекомендация", "совет", "recommendation", "advice")
GENERIC = r"(?i)(^|[^\p{L}\p{N}_])(recommendation|advice|performance|complexity|optimi[sz]e)($|[^\p{L}\p{N}_])"
CYRILLIC = r"[А-Яа-яЁё]"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


#: Every line end, as Python's splitlines() knows them.
LINE_END = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def line_starts(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, line, start): the byte offset of every line, a running sum of lengths."""
    each = texts.select(key, F.posexplode(lines(F.col(column))).alias("line", "text")).withColumn("n", F.octet_length("text") + 1)
    before = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    return each.select(key, "line", (F.sum("n").over(before) - F.col("n")).cast("bigint").alias("start"))


def normalised_source(text: Column) -> Column:
    """Each line up to its first #, trimmed, spaces collapsed, empty ones dropped."""
    bare = F.transform(F.split(text, LINE_END, -1), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "#.*$", ""), r"[ \t\r\x0b\f]+", " ")))
    return F.array_join(F.filter(bare, lambda x: x != ""), "\n")


def normalised_hash(text: Column) -> Column:
    return F.sha1(normalised_source(text))


def excerpt(text: Column, n: int = EXCERPT_LINES) -> Column:
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def similarity_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def similar(a: Column, b: Column) -> Column:
    """Whether two similarity keys are equal, or one holds the other and the shorter is long enough; an empty left key is similar to all."""
    long_enough = F.least(F.length(a), F.length(b)) > SIMILAR_FROM
    return (a == "") | (a == b) | (long_enough & (F.contains(a, b) | F.contains(b, a)))


def sanitised(text: Column) -> Column:
    """A recommendation in one line, without bullets and label, ended by a mark or cut at a word; empty if it says nothing."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[-• \t\r\n]+|[-• \t\r\n]+$", ""), r"\s+", " ")
    bare = F.trim(F.regexp_replace(one, r"(?iu)^(" + "|".join(PREFIXES) + r")\s*[:：-]\s*", ""))
    cut = F.regexp_replace(F.regexp_replace(F.substring(bare, 1, RECOMMENDATION_CHARS), r" [^ ]*$", ""), r"[.,;:]+$", "")
    return (
        F.when((bare == "") | (bare.rlike(GENERIC) & ~bare.rlike(CYRILLIC)), "")
        .when(F.length(bare) > RECOMMENDATION_CHARS, F.concat(cut, F.lit(".")))
        .when(bare.rlike(r"[.!?]$"), bare).otherwise(F.concat(bare, F.lit(".")))
    )


def json_object(text: Column) -> Column:
    """The JSON object in a model's reply: the whole, else a fenced block, else from the first to the last brace; null if none parses."""
    whole = F.trim(text)
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), x)
    return F.coalesce(ok(whole), ok(fenced), ok(braces))


def regex_calls(code: Column, keywords: list[str]) -> Column:
    """Identifiers before an opening bracket, from the second line on (all of a single line), without keywords."""
    parts = lines(code)
    body = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), "\n")).otherwise(code)
    found = F.regexp_extract_all(body, F.lit(r"(?:^|[^\p{L}\p{N}_])([A-Za-z_][A-Za-z0-9_]*)[ \t\r\n]*\("), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*keywords))


def canonical(value: Column, kind: DataType) -> Column:
    """A value as JSON whose objects have sorted names and keep nulls, whatever the order of a struct's fields: equal content, equal text."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = [F.concat(F.lit(f'{"," if i else ""}"{f.name}":'), canonical(value.getField(f.name), f.dataType)) for i, f in enumerate(fields)]
        text = F.concat(F.lit("{"), *inner, F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(canonical(e["key"], kind.keyType), F.lit(":"), canonical(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ","), F.lit("}"))
    elif isinstance(kind, StringType):
        text = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)
