"""The record of a block, whatever its language: schema, identity, and the facts that text alone decides."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql.types import StructType

#: Names that are no calls, calls and methods of containers, and calls of unknown target.
KEYWORDS = ("if", "for", "while", "switch", "return", "sizeof", "catch", "new", "delete", "elif", "def", "class", "print", "with", "except")
BUILTINS = ("all", "any", "deque", "enumerate", "heapify", "heappop", "heappush", "len", "max", "min", "range", "set", "sorted", "sum", "zip")
METHODS = ("append", "extend", "insert", "pop", "remove", "sort", "add", "clear", "copy", "discard", "get", "items", "keys", "setdefault", "update", "values")
DYNAMIC = ("eval", "exec", "getattr", "globals", "locals")
TOP_LEVEL = "<top-level>"

_LOOP = (
    "kind: string, start_line: int, end_line: int, start_byte: int, end_byte: int, nesting_depth: int, parent_loop_index: int, "
    "raw_expression: string, bound_hint: string, estimated_complexity: string, has_break: boolean, has_continue: boolean, has_return: boolean"
)
_CALL = (
    "call_name: string, receiver: string, qualified_hint: string, raw_expression: string, start_line: int, end_line: int, start_byte: int, "
    "end_byte: int, inside_loop_depth: int, is_method: boolean, is_dynamic: boolean, is_builtin_like: boolean"
)
_BRANCH = "kind: string, start_line: int, end_line: int, raw_expression: string"
_OPERATION = "operation: string, operation_type: string, receiver: string, line: int, raw_expression: string, inside_loop_depth: int"
_IMPORT = "kind: string, module: string, name: string, alias: string, line: int"
BLOCK_DDL = f"""
    file_path string, language string, ordinal int, block_id string, stable_id string, parent_id string, kind string, name string,
    qualified_name string, signature string, parameters array<string>, start_line int, end_line int, start_byte int, end_byte int,
    body_start_line int, body_end_line int, body_start_byte int, body_end_byte int, source string, source_hash string,
    calls array<string>, loop_count int, max_loop_depth int, loops array<struct<{_LOOP}>>, call_sites array<struct<{_CALL}>>,
    branches array<struct<{_BRANCH}>>, container_operations array<struct<{_OPERATION}>>, imports array<struct<{_IMPORT}>>,
    defined_symbols array<string>, local_symbols array<string>, error_state boolean, is_container boolean
"""

#: How often a loop runs, by its kind and whole text; the first pattern that occurs decides.
BOUNDS = {
    "while": (
        (r"/=\s*2|//=\s*2|>>=\s*1|mid\s*=", "logarithmic"),
        (r"\+=\s*1|-=\s*1|=\s*\w+\s*[+-]\s*1", "linear"),
        (r"", "unknown"),
    ),
    "for": (
        (r"(?s)\A(?=.*range\()(?:(?!range\s*\().)*range\s*\(\s*\d+\s*\)", "constant"),  # the first range() has one number
        (r"range\(", "linear"),
        (r"(?s)\bin\s+\[.*\]|\bin\s+\(.*\)", "constant"),
        (r"", "data_dependent"),
    ),
}
#: Classes of loops by that.
CLASS_OF_BOUND = {"logarithmic": "O(log n)", "constant": "O(1)", "linear": "O(n)"}


def bound_hint(kind: str, raw: str) -> str:
    """How often a loop runs, judged by its whole text."""
    return next(hint for pattern, hint in BOUNDS[kind] if re.search(pattern, raw))


def sha1(text: str) -> str:
    return hashlib.sha1(text.encode("utf-8", "ignore")).hexdigest()


def head(text: str) -> str:
    return text.split("\n", 1)[0].rstrip("\r")


def loop_record(kind: str, place: dict, depth: int, outer: int | None, raw: str, bound_kind: str | None = None) -> dict:
    """A loop at nesting depth `depth`; bound_kind is given where the bound isn't judged as that of its kind."""
    hint = bound_hint(bound_kind or kind, raw)
    return {
        "kind": kind, **place, "nesting_depth": depth, "parent_loop_index": outer, "raw_expression": head(raw),
        "bound_hint": hint, "estimated_complexity": CLASS_OF_BOUND.get(hint, "unknown"),
        **{f"has_{w}": bool(re.search(rf"\b{w}\b", raw)) for w in ("break", "continue", "return")},
    }


def call_record(name: str, receiver: str | None, target: str, raw: str, place: dict, depth: int) -> dict:
    return {
        "call_name": name, "receiver": receiver, "qualified_hint": target, "raw_expression": raw, **place, "inside_loop_depth": depth,
        "is_method": receiver is not None, "is_dynamic": name in DYNAMIC, "is_builtin_like": name in BUILTINS or name in METHODS,
    }


def operations(calls: list[dict], text: str, first_line: int) -> list[dict]:
    """Container operations: calls of containers, then lines that test membership or build by comprehension."""
    out = [
        {"operation": c["call_name"], "operation_type": "method" if c["receiver"] else "builtin", "receiver": c["receiver"], "line": c["start_line"], "raw_expression": c["raw_expression"], "inside_loop_depth": c["inside_loop_depth"]}
        for c in calls if c["is_builtin_like"]
    ]
    for n, line in enumerate(text.splitlines(), first_line):
        line = line.strip()
        kinds = ["membership"] * (" in " in line and not line.startswith(("for ", "async for "))) + ["comprehension"] * (" for " in line and ("[" in line or "{" in line))
        out += [{"operation": k, "operation_type": "container", "receiver": None, "line": n, "raw_expression": line, "inside_loop_depth": None} for k in kinds]
    return out


def call_names(sites: list[str], text: str) -> list[str]:
    """Distinct names of call sites, then of identifiers before brackets below the first line; no keywords, builtins or container methods."""
    rest = text.split("\n", 1)[1] if "\n" in text else text
    names = [*sites, *re.findall(r"\b([A-Za-z_]\w*)\s*\(", rest)]
    return [n for n in dict.fromkeys(names) if n not in KEYWORDS and n not in BUILTINS and n not in METHODS]


def stable_id(path: str, language: str, kind: str, name: str, start: int, end: int, source_hash: str) -> str:
    return sha1("|".join(map(str, (path, language, kind, name, start, end, source_hash))))


def block_record(path: str, language: str, ordinal: int, kind: str, name: str, qualified: str, parent: str | None, text: str, place: dict, facts, imports: list[dict], **more) -> dict:
    """A block's row; facts has the lists loops, calls and branches, and deepest, the depth of its loops."""
    source_hash = sha1(text)
    row = {
        "file_path": path, "language": language, "ordinal": ordinal, "block_id": f"{path}#{ordinal}", "parent_id": parent, "kind": kind, "name": name,
        "stable_id": stable_id(path, language, kind, name, place["start_line"], place["end_line"], source_hash), "qualified_name": qualified, **place,
        "signature": None, "parameters": [], "body_start_line": place["start_line"], "body_end_line": place["end_line"], "body_start_byte": place["start_byte"],
        "body_end_byte": place["end_byte"], "source": text, "source_hash": source_hash, "calls": call_names([c["call_name"] for c in facts.calls], text),
        "loop_count": len(facts.loops), "max_loop_depth": facts.deepest, "loops": facts.loops, "call_sites": facts.calls, "branches": facts.branches,
        "container_operations": operations(facts.calls, text, place["start_line"]), "imports": imports, "defined_symbols": [name], "local_symbols": [],
        "error_state": False, "is_container": False,
    }
    return row | more


def block_schema() -> StructType:
    return StructType.fromDDL(BLOCK_DDL)
