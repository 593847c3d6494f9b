"""Code pattern detectors: each is a list of regexes, applied as one Column; the highest class wins, the first listed on ties."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lattice

#: Word boundaries that mean the same in Java and RE2.
_L, _R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def word(pattern: str, after: str = _R) -> str:
    return f"{_L}({pattern}){after}"


#: Names of bounds, and the texts that each detector looks for.
BOUND = "left|right|low|high|l|r|start|end"
WHILE, FOR = word("while"), word("for")
BOUND_WORD = "(?i)" + word(BOUND)
MID = "(?i)" + word("mid")
NARROWING = r"(?i)(left|right|low|high|l|r)\s*=\s*mid|mid\s*[=+\-]"
WHILE_BOUND = "(?i)" + _L + rf"while\s+({BOUND})\s*[<>=]"
WHILE_BOUNDS = "(?i)" + _L + rf"while\s+({BOUND})\s*<\s*({BOUND})" + _R
BOUND_STEP = r"(?i)(left|right|l|r|low|high)\s*(\+=|-=)"
LEFT_STEP = r"(?i)left\s*\+=\s*1|left\s*=\s*left\s*\+\s*1|" + _L + r"left\s*[-+]="
POINTER_STEP = _L + r"[\p{L}\p{N}_]+\s*(\+=|-=)\s*1" + _R + "|" + _L + r"(left|right|i|j|ptr)\s*(\+=|-=)"
SORT_CALL = _L + r"sort(ed)?\s*\(|\.sort\s*\("
RANGE_OF_NAME = r"for\s+[\p{L}\p{N}_]+\s+in\s+range\s*\(\s*(0\s*,\s*)?[\p{L}\p{N}_]+\s*\)"
RANGE_WITH_COLON = r"for\s+[\p{L}\p{N}_]+\s+in\s+range\s*\([^)]*:\s*[\p{L}\p{N}_]+\s*\)"
#: Texts behind the features.
SORT_TEXT = _L + r"sort(ed)?\s*\(|qsort\s*\("
LOG_TEXT = r">>\s*1|/=\s*2|/2($|[^\p{L}\p{N}_])|mid\s*=|binary_search"
DYNAMIC_TEXT = r"(?i)" + _L + r"(eval|exec|getattr|globals|locals|__import__|compile)\s*\(|importlib\s*\.\s*import_module"
BRANCH_TEXT = r"(?:^|[^\p{L}\p{N}_])(if|elif|else)(?=$|[^\p{L}\p{N}_])"


@dataclass(frozen=True)
class Detector:
    """Matches where all of `needs` are found, none of `lacks`, and `condition`, an SQL text over loop_count, max_loop_depth, has_sorting and code, holds.

    `words` stand in every text that `needs` match, in any case: a plain search for them spares most texts the regexes.
    """

    name: str
    result: str
    confidence: str
    needs: tuple[str, ...]
    lacks: tuple[str, ...] = ()
    condition: str = "true"
    flag: str | None = None
    words: tuple[str, ...] = ()


#: In order of preference on ties.
DETECTORS = (
    Detector("binary_search", "O(log n)", "high", (WHILE, BOUND_WORD, MID, NARROWING), words=("while", "mid")),
    Detector("dependent_nested_loop", "O(n^2)", "medium", (RANGE_OF_NAME,), condition="nested", flag="dependent_inner_loop_heuristic", words=("range",)),
    Detector("dependent_nested_loop", "O(n^2)", "medium", (RANGE_WITH_COLON,), (RANGE_OF_NAME,), condition="nested", words=("range",)),
    Detector("sort_then_scan", "O(n log n)", "high", (), condition="sorted_scan"),
    Detector("two_pointers", "O(n)", "high", (WHILE_BOUNDS, BOUND_STEP), words=("while",)),
    Detector("sliding_window", "O(n)", "medium", (FOR, WHILE, BOUND_WORD, LEFT_STEP), flag="sliding_window_heuristic", words=("while", "left")),
    Detector("linear_while_pointer", "O(n)", "medium", (WHILE, POINTER_STEP), (WHILE_BOUND,), flag="while_pointer_monotonic_assumed", words=("while",)),
)


#: A match of these begins with the text named here, in any case, or one character before it: nothing before its first place needs a search.
HEADS = {WHILE: "while", FOR: "for", MID: "mid", WHILE_BOUND: "while", WHILE_BOUNDS: "while", LEFT_STEP: "left", SORT_CALL: "sort"}
#: A match of these holds one of the texts.
PARTS = {NARROWING: ("mid",), BOUND_STEP: ("+=", "-="), POINTER_STEP: ("+=", "-="), RANGE_OF_NAME: ("range",), RANGE_WITH_COLON: ("range",)}


def _found(pattern: str, code: Column, low: Column) -> Column:
    """code.rlike(pattern), with searches of long texts spared. low: code in lower case."""
    onward = lambda mark, text: F.substring(code, F.greatest(F.locate(mark, text) - 2, F.lit(1)), F.length(code))
    if pattern in HEADS:
        head = HEADS[pattern]
        tail = F.when(F.length(low) == F.length(code), onward(head, low)).otherwise(code)  # one letter (U+0130) gets longer in lower case, places differ then
        return F.contains(low, F.lit(head)) & tail.rlike(pattern)
    if pattern in (RANGE_OF_NAME, RANGE_WITH_COLON):
        return F.contains(low, F.lit("range")) & code.rlike(pattern)
    # mostly found behind the loop's word; the letter in front keeps the cut from looking like the beginning of a word
    found = F.concat(F.lit("_"), onward("while", code)).rlike(pattern) | code.rlike(pattern)
    return reduce(or_, [F.contains(low, F.lit(x)) for x in PARTS[pattern]]) & found if pattern in PARTS else found


def _best(code: Column, low: Column, loop_count: Column, max_loop_depth: Column, has_sorting: Column) -> Column:
    conditions = {
        "true": F.lit(True),
        "nested": (max_loop_depth >= 2) | (F.length(code) - F.length(F.replace(code, F.lit("for "), F.lit(""))) >= 8),
        "sorted_scan": (has_sorting | _found(SORT_CALL, code, low)) & ((loop_count >= 1) | _found(FOR, code, low)),
    }
    hits = []
    for i, d in sorted(enumerate(DETECTORS), key=lambda x: (-lattice.CLASSES.index(x[1].result), x[0])):
        tests = [F.contains(low, F.lit(w)) for w in d.words] + [conditions[d.condition]] + [_found(p, code, low) for p in d.needs] + [~_found(p, code, low) for p in d.lacks]
        hit = F.struct(
            F.lit(lattice.CLASSES.index(d.result)).alias("rank"), F.lit(-i).alias("preference"), F.lit(d.name).alias("pattern"),
            F.lit(d.result).alias("complexity"), F.lit(d.confidence).alias("confidence"), F.lit(d.flag).cast("string").alias("flag"),
        )
        hits.append(F.when(reduce(and_, tests), hit))
    return F.coalesce(*hits)


def best_hit(code: Column, loop_count: Column, max_loop_depth: Column, has_sorting: Column) -> Column:
    """struct(pattern, class, confidence, flag) of the best detector, or null. Detectors are tried from the best on, and none after the first that matches."""
    seen = F.array(F.struct(code.alias("code"), F.lower(code).alias("low")))  # a lambda's variable is computed once
    return F.transform(seen, lambda s: _best(s["code"], s["low"], loop_count, max_loop_depth, has_sorting))[0]


def best_hit_sql(code: str, loop_count: str = "0", max_loop_depth: str = "0", has_sorting: str = "false") -> str:
    """The same as a DuckDB expression: the best detector's (rank, -place) coded as rank * 100 - place, or null."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    conditions = {
        "true": "true",
        "nested": f"({max_loop_depth} >= 2 OR length({code}) - length(replace({code}, 'for ', '')) >= 8)",
        "sorted_scan": f"(({has_sorting} OR regexp_matches({code}, {q(SORT_CALL)})) AND ({loop_count} >= 1 OR regexp_matches({code}, {q(FOR)})))",
    }
    parts = []
    for i, d in enumerate(DETECTORS):
        tests = [conditions[d.condition], *(f"regexp_matches({code}, {q(p)})" for p in d.needs), *(f"NOT regexp_matches({code}, {q(p)})" for p in d.lacks)]
        parts.append(f"CASE WHEN {' AND '.join(tests)} THEN {lattice.CLASSES.index(d.result) * 100 - i} END")
    return f"greatest({', '.join(parts)})"
