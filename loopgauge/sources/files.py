"""Source trees as a DataFrame of files (file_path, language, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are not read, at any depth, unless other ones are given.
IGNORED = (".git", "__pycache__", "node_modules", "venv", ".venv")
#: Language by file name ending.
LANGUAGES = {
    "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "tsx", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust",
    "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "lua": "lua", "sh": "bash", "sql": "sql", "r": "r",
    "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown",
}


def language(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_ending = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(F.regexp_extract(path, r"([^/]*)$", 1) == "Dockerfile", "dockerfile").otherwise(F.try_element_at(by_ending, ending))


def relative_path(path: Column, root: str) -> Column:
    """The path below root; the path itself where it lies elsewhere."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 2**31 - 1)).otherwise(path)


def kept(path: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    """No ignored folder on the way to the file."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in ignored]))


def decoded(raw: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Files from (path, content binary, and modificationTime if there is one): known language, no ignored folder, valid UTF-8. The rest is left out."""
    when = [F.col("modificationTime").alias("modified")] if "modificationTime" in raw.columns else []
    return (
        raw.select(F.col("path").alias("file_path"), language(F.col("path")).alias("language"), "content", *when)
        .filter(F.col("language").isNotNull() & kept(F.col("file_path"), ignored))
        .withColumn("content", F.try_validate_utf8(F.col("content").cast("string"))).filter(F.col("content").isNotNull())
    )


def scan(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """All source files under root; sort by file_path where an order matters."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content", "modificationTime"), ignored)
