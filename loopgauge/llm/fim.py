"""Fill-in-the-middle by escaped marker injection, in DataFrame functions only.

A delimiter is escaped wherever a text holds it, regexp_replace() appends it after each unit, the delimiters are counted, and
substring_index() takes the first or last so many units. Then delimiters go, escapes are undone, and the parts are assembled.
Every row is made where it lies: one read, no shuffle, whole texts.

Units are runs of ASCII letters and single other code points. Cuts and form come from a hash of the id, so every run gives the same rows.

Defined cases: a null text is an empty one; empty texts and those that hold a marker are plain (the output is the text, the lengths are null);
a null doc_id hashes as an empty one; repeated rows give equal rows; an empty table gives an empty result; other columns pass
unchanged, those named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of documents that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: The delimiter, the escape sign, and what follows the escape sign for either. None is a letter.
END, ESCAPE, WAS_ESCAPE, WAS_END = "\x01", "\x02", "\x03", "\x04"
UNIT = f"{ESCAPE}[{WAS_ESCAPE}{WAS_END}]|[A-Za-z]+|[^A-Za-z]"
RESULT = ("n", "form", "prefix", "middle", "suffix", "output", "restored")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + WAS_ESCAPE)), F.lit(END), F.lit(ESCAPE + WAS_END))


def unescaped(marked: Column) -> Column:
    """A stretch of marked units as text again."""
    plain = F.replace(marked, F.lit(END))
    return F.replace(F.replace(plain, F.lit(ESCAPE + WAS_END), F.lit(END)), F.lit(ESCAPE + WAS_ESCAPE), F.lit(ESCAPE))


def _part(text: Column, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(END), count.cast("int"))


def hashes(doc_id: Column) -> list[Column]:
    """Four unsigned numbers of 32 bits from the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    def between(start: str, stop: str) -> Column:
        return F.substring_index(F.substring_index(output, stop, 1), start, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def filled(docs: DataFrame) -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain), output, and restored: the text made from output and form."""
    kept = F.struct(*[c for c in docs.columns if c not in RESULT]) if set(docs.columns) - set(RESULT) else F.lit(None)
    h = hashes(F.col("doc_id"))
    rows = docs.select(kept.alias("row"), F.coalesce("text", F.lit("")).alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(h, 1)])
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= 100 - PLAIN)
    for m in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(m))
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + END))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(END)))).cast("long"))
    rows = rows.withColumns({"a": F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)), "b": F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))})
    cut = F.col("form") != "plain"
    rows = rows.withColumns({  # the end of the marked text is a delimiter too, hence one more from the right
        "head": F.when(cut, _part(F.col("marked"), F.col("b"))),
        "suffix": F.when(cut, unescaped(_part(F.col("marked"), F.col("b") - F.col("n") - 1))),
    })
    rows = rows.withColumns({
        "prefix": F.when(cut, unescaped(_part(F.col("head"), F.col("a")))),
        "middle": F.when(cut, unescaped(_part(F.col("head"), F.col("a") - F.col("b")))),
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    rows = rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))
    rows = rows.withColumn("restored", restored(F.col("output"), F.col("form")))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in RESULT], *RESULT)


def op12(spark, sf_dir: str) -> DataFrame:
    found = filled(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
    SELECT *, CASE WHEN x = '' THEN []::VARCHAR[] ELSE regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') END AS units,
           ('0x' || h[1:8])::UBIGINT::BIGINT AS h1, ('0x' || h[9:16])::UBIGINT::BIGINT AS h2, ('0x' || h[17:24])::UBIGINT::BIGINT AS h3, ('0x' || h[25:32])::UBIGINT::BIGINT AS h4
    FROM t
),
v AS (
    SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
           CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM u
),
w AS (
    SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM v
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM w
"""
