"""Blocks of brace languages by island parsing: only functions, classes, loops, calls and branches are known, all else is water.

A lexer that knows each language's comments, strings and characters gives tokens; brackets are matched with tolerance, so that
damage stays in the block it stands in; islands are found by what surrounds a bracket. No grammar is needed, and any text gives
some result: a block with unmatched brackets or an unfinished string is flagged error_state.

Kinds as for Python: a function straight in a class is a method, constructors of Java and C# are constructors, arrow lambdas of
Java and C# and C++ lambdas are lambdas. Loops are for, while, do and Rust's loop.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from .records import KEYWORDS, block_record, call_record, head, loop_record

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_STRING, _CHAR = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"


@dataclass(frozen=True)
class Language:
    """What differs between languages: texts that are no code, words before which no block stands, and how its islands look."""

    name: str
    skipped: tuple[str, ...] = (_LINE, _BLOCK)
    strings: tuple[str, ...] = (_STRING, _CHAR)
    classes: tuple[str, ...] = ("class",)
    #: How functions look: word (fn name(...) {), plain (name(...) {), or c (anything with brackets before a brace, outside functions).
    functions: tuple[str, ...] = ()
    word: str = ""
    #: Loops and branches have their condition in brackets.
    bracketed: bool = True
    lambdas: str = ""
    typed_last: bool = False  # the name of a parameter is the last word of its piece
    loops: tuple[str, ...] = ("for", "while", "do")


_PREPROCESSOR = r"(?m:^[ \t]*\#(?:\\\r?\n|[^\n])*)"
LANGUAGES = {
    lang.name: lang
    for lang in (
        Language("javascript", functions=("word", "plain"), word="function"),
        Language("typescript", classes=("class", "interface"), functions=("word", "plain"), word="function"),
        Language("tsx", classes=("class", "interface"), functions=("word", "plain"), word="function"),
        Language("java", strings=(r'"""(?:\\.|[^\\])*?"""', _STRING, _CHAR), classes=("class", "interface"), functions=("plain",), lambdas="->", typed_last=True),
        Language("csharp", skipped=(_LINE, _BLOCK, _PREPROCESSOR), strings=(r'\$?@\$?"(?:""|[^"])*"', r"\$?" + _STRING, _CHAR), classes=("class", "interface"), functions=("plain",), lambdas="=>", typed_last=True, loops=("for", "foreach", "while", "do")),
        Language("c", skipped=(_LINE, _BLOCK, _PREPROCESSOR), classes=(), functions=("c",), typed_last=True),
        Language("cpp", skipped=(_LINE, _BLOCK, _PREPROCESSOR), strings=(r'R"(?P<raw>[^()\\\s]{0,16})\(.*?\)(?P=raw)"', _STRING, _CHAR), functions=("c",), lambdas="[", typed_last=True),
        Language("go", strings=(r"`[^`]*`", _STRING, _CHAR), classes=(), functions=("word",), word="func", bracketed=False, loops=("for",)),
        Language("rust", strings=(r'b?r(?P<raw>\#*)".*?"(?P=raw)', "b?" + r'"(?:\\.|[^"\\])*"', r"b?'(?:\\(?:u\{[0-9a-fA-F]*\}|x..|.)|[^'\\\n])'", r"'[A-Za-z_]\w*"), classes=(), functions=("word",), word="fn", bracketed=False, loops=("for", "while", "loop")),
    )
}
#: Words before a name and brackets that make no declaration of it, and words that no function bears.
_NO_TYPE = frozenset("return new else throw case await yield typeof delete in of instanceof assert goto do void=".split()) | {"=>", "->", ".", "::", "?.", ","}
_NO_NAME = frozenset("if for while switch catch return function new typeof sizeof do else synchronized using lock fixed foreach when with super base this match loop await throw assert in of not and or defined".split())
_MODIFIERS = frozenset("public private protected internal static final abstract native synchronized strictfp default override virtual async unsafe extern sealed partial new readonly".split())
_EXPRESSION = frozenset("= ( , : [ ? & | ! + - * / % < > ~ ^".split()) | {"=>", "return", "typeof", "new", "await", "yield", "case", "throw", "void", "in", "of", "delete"}
_ID = r"[A-Za-z_$\u0080-\U0010ffff][\w$]*"


@dataclass
class Token:
    kind: str  # id, num, str, op
    text: str
    start: int
    end: int
    bad: bool = False
    match: int | None = None  # index of the other bracket


@dataclass
class Facts:
    """Loops, calls and branches of a span of tokens."""

    loops: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    branches: list[dict] = field(default_factory=list)
    deepest: int = 0


def _lexer(lang: Language) -> re.Pattern:
    parts = [f"(?P<skip>{'|'.join(lang.skipped)}|[ \\t\\r\\n\\f\\v\\ufeff]+)", f"(?P<str>{'|'.join(lang.strings)})", f"(?P<id>[#@]?{_ID})", r"(?P<num>\d(?:[\w.]|(?<=[eE])[+-])*)", r"(?P<op>=>|->|::|\?\.|&&|\|\||==|.)"]
    return re.compile("|".join(parts), re.S)


_LEXERS = {name: _lexer(lang) for name, lang in LANGUAGES.items()}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


def tokens(text: str, lang: Language) -> list[Token]:
    """Tokens of a text without comments; brackets carry the index of their counterpart, and what has none is bad."""
    out: list[Token] = []
    lexer, scripts, at = _LEXERS[lang.name], lang.name in ("javascript", "typescript", "tsx"), 0
    templates: list[int] = []  # depth of braces at which each open template goes on
    depth = 0
    while at < len(text):
        c = text[at]
        if scripts and (c == "`" or (c == "}" and templates and templates[-1] == depth)):
            inside = c == "}"
            if inside:
                templates.pop()
            end = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S).match(text, at + 1)
            out.append(Token("str", text[at : end.end()], at, end.end(), bad=end[1] == ""))
            if end[1] == "${":
                templates.append(depth)
            at = end.end()
            continue
        if scripts and c == "/" and (not out or out[-1].text in _EXPRESSION or out[-1].text in ("{", "}", ";", "&&", "||", "==")) and (m := _REGEX.match(text, at)):
            out.append(Token("str", m[0], at, m.end()))
            at = m.end()
            continue
        m = lexer.match(text, at)
        kind = m.lastgroup if m.lastgroup != "raw" else "str"
        at = m.end()
        if kind == "skip":
            if lang.name == "rust" and m[0].startswith("/*"):
                at = _nested_comment(text, m.start())
            continue
        depth += (m[0] == "{") - (m[0] == "}")
        out.append(Token(kind, m[0], m.start(), m.end(), bad=kind == "op" and m[0] in "\"'`"))
    stack: list[int] = []
    for i, t in enumerate(out):
        if t.kind == "op" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "op" and t.text in _CLOSE:
            near = next((k for k in range(len(stack) - 1, -1, -1) if out[stack[k]].text == _CLOSE[t.text]), None)
            # a brace closes whatever is open in it; a round or square bracket closes nothing beyond a brace
            if near is None or (t.text != "}" and any(out[k].text == "{" for k in stack[near + 1 :])):
                t.bad = True
                continue
            for k in stack[near + 1 :]:
                out[k].bad = True
            t.match, out[stack[near]].match = stack[near], i
            del stack[near:]
    for k in stack:
        out[k].bad = True
    return out


def _nested_comment(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return m.end()
    return len(text)


class File:
    """One file's tokens, and the blocks found in them."""

    def __init__(self, path: str, text: str, lang: Language):
        self.path, self.text, self.lang, self.out = path, text, lang, []
        self.t = tokens(text, lang)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()
        self.bytes = None if self.ascii else self._byte_offsets()

    def _byte_offsets(self) -> list[int]:
        total, out = 0, [0]
        for c in self.text:
            total += len(c.encode("utf-8", "ignore"))
            out.append(total)
        return out

    # places

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind != "str"

    def id_(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id"

    def close(self, i: int) -> int:
        """Index after the group that opens at i; after i where it never closes."""
        return self.t[i].match + 1 if self.t[i].match is not None else i + 1

    def place(self, a: int, b: int) -> dict:
        """Of tokens a to b - 1."""
        start, end = self.t[a].start, self.t[b - 1].end
        at = (lambda x: x) if self.ascii else self.bytes.__getitem__
        return {"start_line": bisect_right(self.lines, start), "end_line": bisect_right(self.lines, max(start, end - 1)), "start_byte": at(start), "end_byte": at(end)}

    def source(self, a: int, b: int) -> str:
        return self.text[self.t[a].start : self.t[b - 1].end] if b > a else ""

    def seek(self, i: int, stop: int, wanted: tuple[str, ...], give_up: tuple[str, ...] = (), over: tuple[str, ...] = ("(", "[")) -> int | None:
        """Index of the first of `wanted` from i on, passing over groups; none where something of give_up comes first."""
        while i < stop:
            if self.is_(i, *wanted):
                return i
            if self.is_(i, *give_up):
                return None
            i = self.close(i) if self.is_(i, *over) else i + 1
        return None

    # facts

    def statement_end(self, i: int, stop: int) -> int:
        """Index after the statement that begins at i."""
        if i >= stop:
            return stop
        if self.is_(i, "{"):
            return min(self.close(i), stop)
        if self.is_(i, "if", "for", "while", "switch", "foreach") and self.lang.bracketed:
            chain = self.is_(i, "if")
            while True:
                paren = self.seek(i + 1, stop, ("(",), (";", "{", "}"))
                end = self.statement_end(self.close(paren), stop) if paren is not None else i + 1
                if not (chain and self.is_(end, "else")):
                    return end
                if not self.is_(end + 1, "if"):
                    return self.statement_end(end + 1, stop)
                i = end + 1
        if self.is_(i, "do"):
            end = self.statement_end(i + 1, stop)
            if self.is_(end, "while") and self.is_(end + 1, "("):
                end = self.close(end + 1)
            return end + 1 if self.is_(end, ";") else end
        if self.is_(i, "try"):
            end = self.statement_end(i + 1, stop)
            while self.is_(end, "catch", "finally"):
                brace = self.seek(end + 1, stop, ("{",), (";",))
                end = self.close(brace) if brace is not None else end + 1
            return end
        j = i
        while j < stop and not self.is_(j, "}", ")", "]"):
            if self.is_(j, ";"):
                return j + 1
            after = self.close(j) if self.is_(j, *_OPEN) else j + 1
            if self.lang.name in ("javascript", "typescript", "tsx") and after < stop and "\n" in self.text[self.t[after - 1].end : self.t[after].start] and self.t[after].kind != "op" and (self.t[after - 1].kind != "op" or self.is_(after - 1, ")", "]", "}")):
                return after  # a line's end ends the statement
            j = after
        return j

    def loop_at(self, i: int, stop: int) -> tuple[str, str, int] | None:
        """(kind, kind of its bound, end) of a loop that begins at i."""
        if not self.is_(i, *self.lang.loops) or self.is_(i - 1, ".", "?.", "->", "::") or self.t[i].kind != "id":
            return None
        word = self.t[i].text
        if word == "do":
            return ("while", "for", min(self.statement_end(i, stop), stop)) if self.lang.loops[-1] == "do" and not self.is_(i + 1, "(", ":", "=", ",") else None
        kind = {"while": "while", "loop": "loop"}.get(word, "for")
        bound = "while" if word in ("while", "loop") else "for"
        if not self.lang.bracketed:
            brace = self._control_brace(i + 1, stop)
            if brace is None or (word == "for" and (self.is_(i + 1, "<") or self._in_impl(i))):
                return None
            return kind, bound, min(self.close(brace), stop)
        paren = i + 2 if self.is_(i + 1, "await") else i + 1
        if not self.is_(paren, "("):
            return None
        return kind, bound, self.statement_end(self.close(paren), stop)

    def _control_brace(self, i: int, stop: int) -> int | None:
        """The brace that opens the body of a statement without brackets round its condition."""
        while (i := self.seek(i, stop, ("{",), ("}",))) is not None and self.is_(i - 1, "struct", "interface"):
            i = self.close(i)
        return i

    def _in_impl(self, i: int) -> bool:
        """Rust: this `for` belongs to the head of an impl."""
        while i >= 0 and not self.is_(i, "{", "}", ";"):
            if self.is_(i, "impl"):
                return True
            i -= 1
        return False

    def facts(self, a: int, b: int) -> Facts:
        """Of tokens a to b - 1, blocks inside included."""
        f, open_loops, tails, attribute = Facts(), [], set(), a  # open_loops: (end, index)
        for i in range(a, b):
            if self.lang.name == "rust" and self.is_(i, "#") and self.is_(i + 1, "["):
                attribute = self.close(i + 1)
            if i < attribute:
                continue
            while open_loops and open_loops[-1][0] <= i:
                open_loops.pop()
            t = self.t[i]
            if t.kind != "id":
                continue
            if i not in tails and (found := self.loop_at(i, b)):
                kind, bound, end = found
                end = max(min(end, b), i + 1)
                outer = open_loops[-1][1] if open_loops else None
                f.loops.append(loop_record(kind, self.place(i, end), len(open_loops) + 1, outer, self.source(i, end), bound))
                open_loops.append((end, len(f.loops) - 1))
                f.deepest = max(f.deepest, len(open_loops))
                if t.text == "do":
                    tails.add(self.statement_end(i + 1, b))
            if t.text in ("if", "else", "try", "match", "catch") and not self.is_(i - 1, ".", "?.", "::", "->") and not self.is_(i + 1, ":", "=", "."):
                end = self.statement_end(i + 1 if t.text == "else" else i, b) if self.lang.bracketed else self.close(brace) if (brace := self._control_brace(i + 1, b)) is not None else i + 1
                p = self.place(i, max(min(end, b), i + 1))
                f.branches.append({"kind": "except" if t.text == "catch" else t.text, "start_line": p["start_line"], "end_line": p["end_line"], "raw_expression": head(self.source(i, max(min(end, b), i + 1)))})
            if call := self._call(i, b, len(open_loops)):
                f.calls.append(call)
        return f

    def _call(self, i: int, stop: int, depth: int) -> dict | None:
        """A call whose name stands at i."""
        after = i + 1
        if self.lang.name == "rust" and self.is_(after, "::") and self.is_(after + 1, "<"):
            after = self._angle(after + 1, stop) or after
        if self.is_(after, "?."):
            after += 1
        name = self.t[i].text
        if not self.is_(after, "(") or name in KEYWORDS or name in _NO_NAME or name in (self.lang.word, "pub" if self.lang.name == "rust" else "") or name.startswith(("@", "#")) or i in self.heads:
            return None
        a = i
        while a - 2 >= 0 and self.is_(a - 1, ".", "?.", "::", "->"):
            if self.id_(a - 2):
                a -= 2
            elif self.is_(a - 2, ")", "]") and self.t[a - 2].match is not None:
                a = self.t[a - 2].match
                if self.id_(a - 1) and not self.is_(a - 1, "return", "await"):
                    a -= 1
            elif self.t[a - 2].kind == "str":
                a -= 2
            else:
                break
        if self.is_(a - 1, "new") or (self.lang.name == "rust" and self.is_(i + 1, "!")):
            return None
        receiver = self.text[self.t[a].start : self.t[i - 1].start].strip() if a < i else None
        end = min(self.close(after), stop)
        return call_record(name, receiver or None, self.source(a, i + 1), self.source(a, end), self.place(a, end), depth)

    def _angle(self, i: int, stop: int) -> int | None:
        """Index after the angle brackets that open at i; none where they are no brackets."""
        depth = 0
        while i < stop:
            if self.is_(i, "<"):
                depth += 1
            elif self.is_(i, ">"):
                depth -= 1
                if depth == 0:
                    return i + 1
            elif self.is_(i, ";", "{", "}", ")"):
                return None
            i = self.close(i) if self.is_(i, "(", "[") else i + 1
        return None

    # islands

    def blocks(self) -> list[dict]:
        self.heads: set[int] = set()  # tokens that name a block, not a call
        self.found: list[tuple] = []
        self._walk()
        for a, b, kind, name, stack, parent, params, body in self.found:
            self._emit(a, b, kind, name, stack, parent, params, body)
        return self.out

    def _walk(self) -> None:
        """Finds all blocks, each before those inside it.

        A frame is a stretch of tokens with what holds in it: the names around, the block around, the name of the class straight around,
        whether it lies outside of functions (C, C++), and where its statement began. Frames lie on a stack of our own, so depth has no limit.
        """
        frames = [(0, len(self.t), (), None, None, "c" in self.lang.functions, 0)]
        while frames:
            i, stop, stack, parent, owner, outside, first = frames.pop()
            while i < stop:
                if self.is_(i, ";") or (self.is_(i, ":") and self.is_(i - 1, "public", "private", "protected", "default")):
                    i = first = i + 1
                    continue
                if found := self._class(i, first, stop) or self._function(i, first, stop, owner, outside) or self._lambda(i, stop):
                    a, end, kind, name, params, body = found
                    end, own, container = max(end, i + 1), len(self.found), kind == "class"
                    self.found.append((a, end, kind, name, stack, parent, params, body))
                    frames.append((end, stop, stack, parent, owner, outside, end))
                    if body:
                        inner = (body[0] + 1, body[1] - 1) if self.is_(body[0], "{") and self.t[body[0]].match is not None else (body[0] + self.is_(body[0], "{"), body[1])
                        frames.append((*inner, (name,) if container else (*stack, name), own, name if container else None, outside and container, inner[0]))
                    if params and params[1] - params[0] > 2:
                        frames.append((params[0] + 1, params[1] - 1, (*stack, name), own, None, False, params[0] + 1))
                    break
                if self.is_(i, *_OPEN) and self.t[i].match is not None:
                    end, brace = self.close(i), self.is_(i, "{")
                    frames.append((end, stop, stack, parent, owner, outside, end if brace else first))
                    frames.append((i + 1, end - 1, stack, parent, *(self._held(first, i, outside) if brace else (None, False)), i + 1))
                    break
                first = i + 1 if self.is_(i, "{", "}") else first
                i += 1

    def _held(self, first: int, brace: int, outside: bool) -> tuple[str | None, bool]:
        """(type whose members, or whether declarations) the braces after tokens first to brace - 1 hold: namespaces, structs, enums, records."""
        if "c" in self.lang.functions:
            return None, outside and (brace == first or any(self.is_(k, "namespace", "struct", "union", "extern") for k in range(first, brace)))
        return next((self.t[k + 1].text for k in range(first, brace) if self.is_(k, "enum", "record", "struct") and self.id_(k + 1)), None), False

    def _class(self, i: int, first: int, stop: int):
        if not (self.is_(i, *self.lang.classes) and self.t[i].kind == "id" and self.id_(i + 1)) or self.is_(i - 1, ".", "@", "enum", "::"):
            return None
        if self.lang.name in ("javascript", "typescript", "tsx") and self.is_(i - 1, *_EXPRESSION):
            return None
        if self.lang.name == "cpp" and self.is_(i - 1, "<", ",", "friend"):
            return None
        brace = self.seek(i + 2, stop, ("{",), (";", "=", ")", "}") if self.lang.name != "csharp" else (";", "}"))
        if brace is None:
            return None
        name, at = self.t[i + 1].text, i + 2
        while self.lang.name == "cpp" and at < brace and (self.id_(at) or self.is_(at, "::")) and not self.is_(at, "final"):
            name, at = self.t[at].text, at + 1  # macros before the name, and outer names
        modifiers = self.lang.name in ("java", "csharp")
        start = first if modifiers else i - 1 if self.is_(i - 1, "abstract") else i
        return start, self.close(brace) if self.t[brace].match is not None else stop, "class", name, None, (brace, self.close(brace) if self.t[brace].match is not None else stop)

    def _body(self, brace: int, stop: int) -> tuple[int, int]:
        return brace, self.close(brace) if self.t[brace].match is not None else stop

    def _function(self, i: int, first: int, stop: int, owner: str | None, outside: bool):
        for form in self.lang.functions:
            if found := getattr(self, f"_{form}_function")(i, first, stop, owner, outside):
                return found
        return None

    def _word_function(self, i, first, stop, owner, outside):
        """function name(...) {, func (receiver) name(...) {, fn name(...) {"""
        if not self.is_(i, self.lang.word) or self.is_(i - 1, ".", "?."):
            return None
        if self.lang.word == "function" and self.is_(i - 1 - self.is_(i - 1, "async"), *_EXPRESSION):
            return None
        at = i + 1 + self.is_(i + 1, "*")
        method = self.lang.word == "func" and self.is_(at, "(")
        if method:
            at = self.close(at)
        if not self.id_(at):
            return None
        paren = at + 1
        if self.is_(paren, "<"):
            paren = self._angle(paren, stop) or paren
        elif self.is_(paren, "[") and self.lang.name == "go":
            paren = self.close(paren)
        if not self.is_(paren, "("):
            return None
        brace = self._type_brace(self.close(paren), stop) if self.lang.word == "function" else self.seek(self._control_brace(self.close(paren), stop) or stop, stop, ("{",))
        semicolon = self.seek(self.close(paren), stop, (";",), ("{", "}"))
        if brace is None or (semicolon is not None and semicolon < brace):
            return None
        start = i
        while start > first and self.is_(start - 1, "async", "pub", "unsafe", "const", "extern", "default") or (self.is_(start - 1, ")") and self.lang.word == "fn" and self.is_(self.t[start - 1].match - 1 if self.t[start - 1].match else -1, "pub")) or (self.lang.word == "fn" and start > first and self.t[start - 1].kind == "str" and self.is_(start - 2, "extern")):
            start = self.t[start - 1].match if self.is_(start - 1, ")") else start - 1
        if self.lang.word == "function" and self.is_(start, "default"):
            start += 1
        self.heads.add(at)
        body = self._body(brace, stop)
        return start, body[1], "method" if method or owner else "function", self.t[at].text, (paren, self.close(paren)), body

    def _type_brace(self, i: int, stop: int) -> int | None:
        """The brace of a body at i, behind a type (name(...): type {)."""
        if not self.is_(i, ":"):
            return i if self.is_(i, "{") else None
        i += 1
        while i < stop and not self.is_(i, ";", "=", "}", ")"):
            if self.is_(i, "{") and not self.is_(i - 1, ":", "|", "&", "=>", "is", "<", ","):
                return i
            i = self.close(i) if self.is_(i, *_OPEN) else i + 1
        return None

    def _plain_function(self, i, first, stop, owner, outside):
        """name(...) { of a method, with a type before it in Java and C#."""
        if not self.id_(i) or self.t[i].text in _NO_NAME or self.is_(i - 1, *_NO_TYPE):
            return None
        paren = i + 1
        if self.is_(paren, "<"):
            paren = self._angle(paren, stop) or paren
        if not self.is_(paren, "(") or self.t[paren].match is None:
            return None
        after = self.close(paren)
        scripts = self.lang.word == "function"
        if scripts:
            if self.is_(i - 1, "function", "new") or self.is_(i - 1, "=", "(", "[", "?", "&&", "||", "!", "+", "-") or self.t[i].text.startswith("@"):
                return None
            brace = self._type_brace(after, stop) if owner or self.is_(after, "{") else None
            if brace is None:
                if owner:
                    self.heads.add(i)  # a signature alone
                return None
            start = i
            while start > first and self.is_(start - 1, "static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override"):
                start -= 1
            self.heads.add(i)
            body = self._body(brace, stop)
            return start, body[1], "method", self.t[i].text, (paren, after), body
        typed = (self.id_(i - 1) and i > first and self.t[i - 1].text not in _MODIFIERS and not self.t[i - 1].text.startswith("@")) or (i > first and self.is_(i - 1, ">", "]", "?", "*"))
        builds = owner is not None and self.t[i].text == owner and not typed
        if not typed and not builds or self.t[i].text.startswith("@"):
            return None
        brace = self.seek(after, stop, ("{", "=>"), (";", "=", "}", ",", ")")) if not self.is_(after, ".", "?.") else None
        if brace is not None and any(self.t[k].kind == "op" and self.t[k].text not in (",", ".", "::", ":", "(", ")", "<", ">", "?", "[", "]") and self.t[k].match is None for k in range(after, brace)):
            return None
        if brace is None:
            end = self.seek(after, stop, (";",), ("{", "=", "}", ",")) if owner else None
            if end is None or not typed:
                return None
            self.heads.add(i)
            return first, end + 1, "method", self.t[i].text, (paren, after), None
        self.heads.add(i)
        if self.is_(brace, "=>"):
            end = self.seek(brace, stop, (";",), ("}",), ("(", "[", "{"))
            body = (brace + 1, (end if end is not None else stop - 1) + 1)
        else:
            body = self._body(brace, stop)
        return first, body[1], "constructor" if builds else "method", self.t[i].text, (paren, after), body

    def _c_function(self, i, first, stop, owner, outside):
        """declarator(...) { outside of functions."""
        if not outside or not self.id_(i) or self.t[i].text in _NO_NAME or not self.is_(i + 1, "(") or self.t[i + 1].match is None:
            return None
        if self.t[i].text in ("__attribute__", "alignas", "decltype", "noexcept", "__declspec", "explicit") or any(self.is_(k, "=") for k in range(first, i)):
            return None
        name, paren, after = self.t[i].text, i + 1, self.close(i + 1)
        if name == "operator" and self.is_(after, "("):
            name, paren, after = "operator()", after, self.close(after)
        if self.is_(i - 1, "~"):
            name = "~" + name
        brace = self._c_brace(after, stop)
        if brace is None:
            self.heads.add(i)  # a prototype
            return None
        while self.is_(first, "template") and self.is_(first + 1, "<"):
            first = self._angle(first + 1, stop) or first + 1
        self.heads.add(i)
        self.heads.update(k for k in range(after, brace) if self.id_(k))
        body = self._body(brace, stop)
        return min(first, i), body[1], "method" if owner else "function", name, (paren, self.close(paren)), body

    def _c_brace(self, i: int, stop: int) -> int | None:
        """The brace of a body behind a parameter list: over qualifiers, a trailing type and members' initial values."""
        values = False
        while i < stop:
            if self.is_(i, "{"):
                if values and self.id_(i - 1) and (self.is_(self.close(i), ",", "{")):
                    i = self.close(i)
                    continue
                return i
            if self.is_(i, ":"):
                values = True
            elif self.is_(i, ";", "=", "}", ")") or (self.is_(i, ",") and not values):
                return None
            i = self.close(i) if self.is_(i, "(", "[") else i + 1
        return None

    def _lambda(self, i: int, stop: int):
        mark = self.lang.lambdas
        if mark == "[":
            if not self.is_(i, "[") or self.t[i].match is None or self.id_(i - 1) and not self.is_(i - 1, "return") or self.is_(i - 1, ")", "]", "[") or self.is_(i + 1, "["):
                return None
            after = self.close(i)
            paren = after if self.is_(after, "(") else None
            brace = self._c_brace(self.close(after) if paren is not None else after, stop) if paren is not None or self.is_(after, "{") else None
            if brace is None:
                return None
            body = self._body(brace, stop)
            return i, body[1], "lambda", head(self.source(i, body[1]))[:80].strip(), (paren, self.close(paren)) if paren is not None else None, body
        if not mark or i + 1 >= stop:
            return None
        params = (i, self.close(i)) if self.is_(i, "(") and self.t[i].match is not None else None
        arrow = params[1] if params else i + 1
        if not (params or self.id_(i)) or not self.is_(arrow, mark) or arrow + 1 >= stop or self.is_(i - 1, "case", "default"):
            return None
        if self.is_(arrow + 1, "{"):
            end = min(self._body(arrow + 1, stop)[1], stop)
        else:
            end = self.seek(arrow + 1, stop, (",", ";", ")", "]", "}"), (), ("(", "[", "{")) or stop
        if end <= arrow + 1:
            return None
        return i, end, "lambda", head(self.source(i, end))[:80].strip(), params or (i - 1, i + 2), (arrow + 1, end)

    # rows

    def _parameters(self, params: tuple[int, int] | None) -> list[str]:
        """Names in a parameter list, in order."""
        if not params:
            return []
        pieces, piece, i = [], [], params[0] + 1
        while i < params[1] - 1:
            if self.is_(i, ","):
                pieces.append(piece)
                piece = []
            else:
                piece.append(i)
            i = (self._angle(i, params[1]) or i + 1) if self.is_(i, "<") else self.close(i) if self.is_(i, *_OPEN) else i + 1
        names = []
        pieces = [p for p in [*pieces, piece] if p]
        typed = any(len([k for k in p if self.id_(k)]) > 1 for p in pieces)
        for p in pieces:
            until = next((n for n, k in enumerate(p) if self.is_(k, ":", "=", "?")), len(p))
            words = [self.t[k].text for k in p[:until] if self.id_(k) and not self.t[k].text.startswith("@") and not self.is_(k, "mut", "ref", "self", "const", "final", "this", "void", *_MODIFIERS)]
            if words and self.lang.typed_last:
                names += words[-1:] if len(words) > 1 or not typed and self.lang.name in ("java", "csharp") else []
            elif words:
                names.append(words[0])
        return list(dict.fromkeys(names))

    def _emit(self, a, b, kind, name, stack, parent, params, body) -> None:
        b = min(b, len(self.t))
        up = self.out[parent] if parent is not None else None
        if kind == "function" and up is not None and up["kind"] == "class":
            kind = "method"
        facts, place, text = self.facts(a, b), self.place(a, b), self.source(a, b)
        more = {}
        if body:
            inside = self.place(body[0], min(body[1], len(self.t)))
            more = {f"body_{k}": v for k, v in inside.items()} | {"signature": self.text[self.t[a].start : self.t[body[0]].start].strip()}
        else:
            more = {"signature": head(text).strip()[:200], "body_start_line": min(place["start_line"] + 1, place["end_line"]), "body_end_line": place["end_line"], "body_start_byte": None, "body_end_byte": None}
        self.out.append(block_record(
            self.path, self.lang.name, len(self.out), kind, name, name if kind == "class" else ".".join((*stack, name)), up["stable_id"] if up else None, text, place, facts, [],
            calls=list(dict.fromkeys(c["call_name"] for c in facts.calls if not c["is_builtin_like"])), parameters=self._parameters(params) if kind != "class" else [], is_container=kind == "class", error_state=any(t.bad for t in self.t[a:b]), **more,
        ))


def blocks(language: str, path: str, text: str) -> list[dict]:
    """Blocks of a file in source order, those that enclose others first."""
    return File(path, text, LANGUAGES[language]).blocks()
