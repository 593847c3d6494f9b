"""Cost classes as Columns: rank, maximum, product, labels and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes in order, and the labels outside the order.
CLASSES = ("O(1)", "O(log n)", "O(n)", "O(n log n)", "O(n^2)", "O(n^2 log n)", "O(n^3)", "O(2^n)", "O(n!)")
UNRANKED = ("unknown", "N/A", "container")
#: Degree in n and in log n of the classes that can be multiplied.
DEGREES = {"O(1)": (0, 0), "O(log n)": (0, 1), "O(n)": (1, 0), "O(n log n)": (1, 1), "O(n^2)": (2, 0), "O(n^2 log n)": (2, 1), "O(n^3)": (3, 0)}
#: Spellings of a class in model replies, without spaces and in lower case.
SPELLINGS = {
    "o(1)": "O(1)", "o(logn)": "O(log n)", "o(n)": "O(n)", "o(nlogn)": "O(n log n)", "o(n^2)": "O(n^2)", "o(n²)": "O(n^2)",
    "o(n^2logn)": "O(n^2 log n)", "o(n^3)": "O(n^3)", "o(2^n)": "O(2^n)", "o(n!)": "O(n!)",
}
#: Heavy classes of recommendations and summaries; reviews leave one of them out.
HEAVY = ("O(n^2)", "O(n^2 log n)", "O(n^3)", "O(2^n)", "O(n!)")
HEAVY_REVIEW = ("O(n^2)", "O(n^3)", "O(2^n)", "O(n!)")
LINEAR_OR_BETTER = ("O(1)", "O(log n)", "O(n)")
#: Colours.
GREEN, YELLOW, GRAY, RED = "green", "yellow", "gray", "red"

_by_key = {d * 10 + g: c for c, (d, g) in DEGREES.items()}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank(c: Column | str) -> Column:
    """Place in CLASSES; -1 for null and anything else."""
    return F.coalesce(F.try_element_at(_map({c: i for i, c in enumerate(CLASSES)}), F.coalesce(col(c), F.lit(""))), F.lit(-1))


def is_ranked(c: Column | str) -> Column:
    return rank(c) >= 0


def class_max(a: Column | str, b: Column | str) -> Column:
    """The larger class; the left one on ties and where neither has a rank."""
    return F.when((rank(b) >= 0) & (rank(b) > rank(a)), col(b)).otherwise(col(a))


def multiply(a: Column | str, b: Column | str) -> Column:
    """Degrees add up; log times log stays log; null beyond the table."""
    key = {c: d * 10 + g for c, (d, g) in DEGREES.items()}
    total = F.try_element_at(_map(key), F.coalesce(col(a), F.lit(""))) + F.try_element_at(_map(key), F.coalesce(col(b), F.lit("")))
    return F.try_element_at(_map({**_by_key, 2: "O(log n)"}), total)


def normalise(label: Column | str) -> Column:
    """A class from a free label; `unknown` if there is none."""
    trimmed = F.trim(col(label))
    squeezed = F.lower(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(trimmed.isin(*CLASSES), trimmed).otherwise(F.coalesce(F.try_element_at(_map(SPELLINGS), squeezed), F.lit("unknown")))


def colour(c: Column | str) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    return (
        F.when(c.isin("", "unknown", "O(n)"), GRAY).when(c.isin("O(1)", "O(log n)"), GREEN)
        .when(c.isin("O(n log n)", "O(n^2 log n)"), YELLOW).otherwise(RED)
    )


def fold_product(items: Column) -> Column:
    """Product of an array of classes, from O(1); null as soon as one step has none."""
    return F.aggregate(items, F.lit("O(1)"), lambda acc, x: F.when(acc.isNull(), F.lit(None).cast("string")).otherwise(multiply(acc, x)))


def fold_max(items: Column) -> Column:
    """Maximum of an array of classes in its order; null if empty."""
    return F.aggregate(items, F.lit(None).cast("string"), lambda acc, x: class_max(acc, x))
