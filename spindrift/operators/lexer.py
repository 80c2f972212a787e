"""Tokens of a source file, in one scan from left to right, and which of them begin and end what.

A small helper that runs in tasks, a file at a time: it tells code from what
only looks like it (comments, raw strings, regular expressions, heredocs,
markup), pairs brackets, and ends statements by each language's rule: braces,
ends of lines, depth of indentation, or keyword pairs. What the statements and
names mean is said by patterns in ``extract``.
"""

from __future__ import annotations

import bisect
import re
from array import array
from functools import lru_cache

#: Words that are no names (fixed values).
KEYWORDS = {
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct super trait true type unsafe use where while yield".split(),
    "scala": "abstract case catch class def do else enum extends false final finally for forSome if implicit import lazy match new null object override package private protected return sealed super this throw trait try true type using val var while with yield given then".split(),
    "typescript": "async await break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null of return static super switch this throw true try typeof var void while with yield as satisfies keyof is asserts infer declare abstract".split(),
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split(),
    "ruby": "alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __method__".split(),
}
KEYWORDS = {k: frozenset(v) for k, v in KEYWORDS.items()}
#: Words that are values all the same.
_VALUES = frozenset("this super self true false null nil None True False end".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}

_BLANK = r"(?P<nl>\n)|(?P<blank>[^\S\n]+|\\\r?\n)"
_NUMBER = r"(?P<number>\d(?:\w|\.(?=\d))*)"
_SLASHES = r"(?P<note>//[^\n]*)|(?P<nested>/\*)"
_REST = r"(?P<op>=>|->|::|\?\.|&\.|\.\.\.?|==|!=|<=|>=|&&|\|\||\*\*|[^\s\w])|(?P<other>.)"
_RULES = {
    "rust": [_BLANK, _SLASHES, r'(?P<raw>(?:b|c)?r(?P<hashes>\#*)")', r'(?P<string>[bc]?"(?:\\[\s\S]|[^"\\])*"?|b?\'(?:\\[^\n][^\'\n]*|[^\\\'\n])\')', r"(?P<lifetime>'\w+)", r"(?P<word>(?:r\#)?[^\W\d]\w*)", _NUMBER, _REST],
    "scala": [_BLANK, _SLASHES, r'(?P<fill3>[^\W\d]\w*""")', r'(?P<fill>[^\W\d]\w*")', r'(?P<string>"""[\s\S]*?"""(?!")|"(?:\\[^\n]|[^"\\\n])*"?|\'(?:\\u\w{4}|\\.|[^\\\'\n])\')', r"(?P<lifetime>'[^\W\d]\w*)", r"(?P<word>(?:[^\W\d]|\$)[\w$]*|`[^`\n]+`)", _NUMBER, _REST],
    "typescript": [_BLANK, r"(?P<note>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))", r"""(?P<string>"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?)""", r"(?P<template>`)", r"(?P<word>\#?(?:[^\W\d]|\$)[\w$]*)", _NUMBER, _REST],
    "python": [_BLANK, r"(?P<note>\#[^\n]*)", r"""(?P<fill>(?:[rR]?[fFtT]|[fFtT][rR])(?:\"\"\"|'''|"|'))""", r"""(?P<string>(?:[rRbBuU]|[rR][bB]|[bB][rR])?(?:\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?))""", r"(?P<word>[^\W\d]\w*)", _NUMBER, _REST],
    "ruby": [_BLANK, r"(?P<note>\#[^\n]*|(?:(?<=\n)|\A)=begin\b[\s\S]*?(?:\n=end[^\n]*|\Z))", r"(?P<rest>(?:(?<=\n)|\A)__END__\r?\n[\s\S]*)", r"(?P<heredoc><<[~-]?(?:[A-Z_]\w*|\"[^\"\n]+\"|'[^'\n]+'))", r"(?P<label>[^\W\d]\w*[?!]?:(?!:))", r"(?P<symbol>:(?:[^\W\d]\w*[?!=]?|\"(?:\\[\s\S]|[^\"\\])*\"|\[\]=?|<=>|===?|[+*/<>%!~^&|-]))", r"(?P<percent>%[wWiIqQrx]?(?=[^\w\s=]))", r"(?P<fill>[\"`])", r"(?P<string>'(?:\\[\s\S]|[^'\\])*'?)", r"(?P<word>(?:@@?|\$)?[^\W\d]\w*(?:[?!](?![=~]))?)", _NUMBER, _REST],
}
_MASTER = {k: re.compile("|".join(v)) for k, v in _RULES.items()}
_TAG = re.compile(r"<(?=>|[A-Za-z_][\w.:-]*(?:\s*/?>|\s+[A-Za-z_{/]))(?![A-Za-z_]\w*\s+extends\b)")
_REGEX = re.compile(r"/(?![*/\s=])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*|/ (?:\\.|[^/\\\n])+/\w*(?=[.,)\s])")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


@lru_cache(maxsize=64)
def _stop(end: str, opens: str, raw: bool = False):
    """What to look for within a string: an escape, its end, or code within it."""
    return re.compile(("" if raw else r"\\[\s\S]|") + (r"\{\{|" if opens == "{" else "") + f"(?P<end>{end})" + (f"|(?P<open>{re.escape(opens)})" if opens else ""))


class Tokens:
    """Sequences of equal length: text, where it begins and ends, and whether it is first on its line. Strings are a quote; code inside them stands between parentheses.

    Equal texts are one string and numbers lie in arrays, so a token of a long file takes about 50 bytes.
    """

    def __init__(self, src: str, language: str, markup: bool = False):
        self.src, self.language, self.keywords = src, language, KEYWORDS[language]
        self.text: list[str] = []
        self.kind: list[str] = []
        self.start, self.end, self.first = array("q"), array("q"), bytearray()
        self._same: dict[str, str] = {}
        self.comments: dict[int, tuple[int, int]] = {}  # of those before a token the last, by the token's number
        self.lines = array("q", [0])
        self.lines.extend(m.end() for m in re.finditer("\n", src))
        self._fresh, self._modes, self._heredocs = True, [], []
        self._scan(markup and language == "typescript")
        self._pair()
        self._same.clear()

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def column(self, at: int) -> int:
        return at - self.lines[self.line(at) - 1]

    def _add(self, kind: str, text: str, start: int, end: int) -> None:
        self.kind.append(kind)
        self.text.append(self._same.setdefault(text, text))
        self.start.append(start)
        self.end.append(end)
        self.first.append(self._fresh)
        self._fresh = False

    def operand(self, i: int) -> bool:
        """Whether a value can end with token ``i``."""
        if i < 0:
            return False
        kind, text = self.kind[i], self.text[i]
        if kind == "word":
            return text not in self.keywords or text in _VALUES
        return kind in ("string", "number") or text in (")", "]", "}")

    def _scan(self, markup: bool) -> None:
        src, n, rule, pos = self.src, len(self.src), _MASTER[self.language], 0
        while pos < n:
            mode = self._modes[-1] if self._modes else None
            if mode and mode[0] == "string":
                pos = self._in_string(pos, mode)
                continue
            if mode and mode[0] in ("tag", "children"):
                pos = self._in_markup(pos, mode)
                continue
            m = rule.match(src, pos)
            kind, end = m.lastgroup, m.end()
            text = m.group()
            if kind == "nl":
                self._fresh = True
                if self._heredocs:
                    word = self._heredocs.pop(0)
                    self._modes.append(["string", _stop(rf"(?m:^[ \t]*{re.escape(word)}\b)", "#{")])
            elif kind == "note" or kind == "nested":
                if kind == "nested":
                    end = self._nested(end)
                self.comments[len(self.text)] = (pos, end)
            elif kind == "raw":
                close = '"' + m.group("hashes")
                at = src.find(close, end)
                end = n if at < 0 else at + len(close)
                self._add("string", '"', pos, end)
            elif kind in ("fill", "fill3", "template"):
                self._add("string", '"', pos, end)
                quote = text.lstrip("rRfFtTbBuU") if self.language == "python" else '"""' if kind == "fill3" else text[-1]
                opens = {"python": "{", "ruby": "#{"}.get(self.language, "${")
                close = re.escape(quote) + ('(?!")' if kind == "fill3" else "")
                if len(quote) == 1 and self.language in ("python", "scala"):
                    close += r"|(?=\n)"
                self._modes.append(["string", _stop(close, opens, kind == "fill3")])
            elif kind == "heredoc":
                if self.operand(len(self.text) - 1) and src[pos + 2 : pos + 3] not in ("~", "-"):
                    end = pos + 1
                    self._add("op", "<", pos, end)
                else:
                    self._heredocs.append(text.lstrip("<~-").strip("\"'"))
                    self._add("string", '"', pos, end)
            elif kind == "percent" and (not self.operand(len(self.text) - 1) or (len(text) > 1 and src[pos - 1].isspace())):
                opener = src[end]
                self._add("string", '"', pos, end)
                end = self._percent(end + 1, opener, _PAIRS.get(opener, opener))
            elif kind == "label":
                if self.text and self.text[-1] == "?":  # a choice between two values
                    end -= 1
                    self._add("word", text[:-1], pos, end)
                else:
                    self._add("label", text, pos, end)
            elif kind in ("string", "symbol"):
                self._add("string", '"', pos, end)
            elif kind in ("blank", "lifetime", "rest"):
                pass
            elif text == "/" and self._regex_here(pos) and (found := _REGEX.match(src, pos)):
                end = found.end()
                self._add("string", '"', pos, end)
            elif text == "<" and markup and not self.operand(len(self.text) - 1) and _TAG.match(src, pos):
                self._add("string", '"', pos, end)
                self._modes.append(["tag"])
            else:
                if mode and mode[0] == "code":
                    if text == "{":
                        mode[1] += 1
                    elif text == "}":
                        if not mode[1]:
                            self._modes.pop()
                            self._add("op", ")", pos, end)
                            pos = end
                            continue
                        mode[1] -= 1
                    elif text in "([":
                        mode[2] += 1
                    elif text in ")]":
                        mode[2] -= 1
                    elif text == ":" and self.language == "python" and not mode[1] and mode[2] <= 0:  # how to show a value is no code
                        self._modes.append(["string", _stop(r"(?=\}|\n)", "{")])
                self._add("word" if kind == "word" else "number" if kind == "number" else "op", text, pos, end)
            pos = end

    def _regex_here(self, pos: int) -> bool:
        last = len(self.text) - 1
        if self.language == "typescript":
            return not self.operand(last)
        if self.language != "ruby":
            return False
        spaced = self.src[pos - 1 : pos].isspace() and not self.src[pos + 1 : pos + 2].isspace()
        return not self.operand(last) or (spaced and self.kind[last] == "word")

    def _nested(self, pos: int) -> int:
        depth = 1
        for m in re.compile(r"/\*|\*/").finditer(self.src, pos):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return len(self.src)

    def _percent(self, pos: int, opener: str, closer: str) -> int:
        depth = 1
        for m in re.compile(rf"\\[\s\S]|[{re.escape(opener + closer)}]").finditer(self.src, pos):
            if m.group() == closer:
                depth -= 1
                if not depth:
                    return m.end()
            elif m.group() == opener:
                depth += 1
        return len(self.src)

    def _in_string(self, pos: int, mode: list) -> int:
        m = mode[1].search(self.src, pos)
        if m is None:
            self._modes.pop()
            return len(self.src)
        if m.lastgroup == "end":
            self._modes.pop()
        elif m.lastgroup == "open":
            self._add("op", "(", m.start(), m.end())
            self._modes.append(["code", 0, 0])
        return m.end()

    _IN_TAG = re.compile(r"""(?P<end>/>)|(?P<body>>)|(?P<open>\{)|"[^"]*"|'[^']*'|[^/>{"']+|[\s\S]""")
    _IN_CHILDREN = re.compile(r"(?P<end></[^>]*>)|(?P<open>\{)|(?P<tag><)|[^<{]+|[\s\S]")

    def _in_markup(self, pos: int, mode: list) -> int:
        m = (self._IN_TAG if mode[0] == "tag" else self._IN_CHILDREN).match(self.src, pos)
        if m.lastgroup == "end":
            self._modes.pop()
        elif m.lastgroup == "body":
            mode[0] = "children"
        elif m.lastgroup == "tag":
            self._modes.append(["tag"])
        elif m.lastgroup == "open":
            self._add("op", "(", m.start(), m.end())
            self._modes.append(["code", 0, 0])
        return m.end()

    def _pair(self) -> None:
        """``mate``: each bracket's other one (or -1); ``inside``: the bracket that a token stands directly in (or -1); ``depth``."""
        n = len(self.text)
        self.mate, self.inside, stack = array("q", [-1]) * n, array("q", [-1]) * n, []
        for i, (text, kind) in enumerate(zip(self.text, self.kind)):
            if kind == "op" and text in _CLOSE:
                want = _CLOSE[text]
                if any(self.text[o] == want for o in stack[-50:]):
                    while self.text[stack[-1]] != want:
                        self.mate[stack.pop()] = i - 1
                    o = stack.pop()
                    self.mate[o], self.mate[i] = i, o
            self.inside[i] = stack[-1] if stack else -1
            if kind == "op" and text in _OPEN:
                stack.append(i)
        for o in stack:
            self.mate[o] = n - 1
        #: Rust's macros take any tokens, so these say nothing.
        self.opaque = {o for o in range(n) if self.text[o] in _OPEN and self.kind[o] == "op" and self._of_macro(o)} if self.language == "rust" else set()

    def _of_macro(self, o: int) -> bool:
        if self.before(o) == "!" and o > 1 and self.kind[o - 2] == "word" and self.start[o - 1] == self.end[o - 2]:
            return True
        return o > 2 and self.text[o - 3 : o - 1] == ["macro_rules", "!"]

    def after(self, i: int) -> str:
        return self.text[i + 1] if i + 1 < len(self.text) else ""

    def before(self, i: int) -> str:
        return self.text[i - 1] if i > 0 else ""

    def new_line(self, i: int) -> bool:
        """Whether token ``i`` is the first of a line, or there is none."""
        return i >= len(self.text) or self.first[i]


# where statements begin and end

_RUST_GOES_ON = frozenset(". ? else ; , => as = == != && || + / < > .. ) ]".split())
_TS_GOES_ON = frozenset(". ?. ? ; , ) ] else catch finally = == != && || ?? : => + * / % < > | & ^ instanceof".split())
_TS_SAME_LINE = frozenset("from as satisfies ( [ in of while { - ! extends implements".split())
_TS_BEGINS_NOT = frozenset("extends implements instanceof in of as satisfies is".split())
_TS_ENDS_NOT = frozenset("extends implements new typeof return case default export const let var async await yield in of instanceof else keyof class interface function abstract declare public private protected static readonly".split())


def _statements_braces(t: Tokens) -> list[tuple[int, int]]:
    """(first, last) of the statements of all blocks of braces, in order of their first token."""
    script = t.language == "typescript"
    open_at: dict[int, int] = {}
    out = []
    n = len(t.text)
    i = 0
    while i < n:
        text, block = t.text[i], t.inside[i]
        if text == "}" and t.mate[i] >= 0 and t.mate[i] in open_at:
            out.append((open_at.pop(t.mate[i]), i - 1))
        if block >= 0 and t.text[block] != "{":
            i += 1
            continue
        if not script and text == "#" and t.after(i) in ("[", "!"):  # an attribute
            o = i + 1 if t.after(i) == "[" else i + 2
            if o < n and t.text[o] == "[":
                i = max(i, t.mate[o]) + 1
                continue
        begin = open_at.setdefault(block, i)
        last = t.mate[i] if text in _OPEN and t.kind[i] == "op" and t.mate[i] >= i else i
        if i in t.opaque and last > i:
            i = last
            continue
        if last > i:  # what stands in brackets has its own turn
            i += 1
            if text != "{":
                i = i if "{" in t.text[i:last] else last
            continue
        nxt = t.after(i)
        ends = text == ";" or (text == "," and not (script and _listed(t, begin, i)))
        if not ends and text == "}":
            ends = nxt not in (_TS_GOES_ON if script else _RUST_GOES_ON)
            if ends and script and not t.new_line(i + 1) and nxt in _TS_SAME_LINE:
                ends = False
        elif not ends and script and t.new_line(i + 1):
            can_end = t.operand(i) or text in (">",) or (t.kind[i] == "word" and text not in _TS_ENDS_NOT)
            ends = can_end and i + 1 < n and t.kind[i + 1] in ("word", "number", "string") and nxt not in _TS_BEGINS_NOT
            ends = ends or (can_end and (nxt == "@" or (nxt == "[" and text != ")")))
        if ends or i + 1 == n:
            out.append((begin, i))
            open_at.pop(block, None)
        i += 1
    out += [(begin, n - 1) for begin in open_at.values()]
    return sorted(out)


def _listed(t: Tokens, first: int, comma: int) -> bool:
    """Whether a comma parts types of a head or of type arguments, not statements."""
    return bool({"class", "interface", "function"} & set(t.text[first : first + 5])) or t.text[max(first, comma - 200) : comma].count("<") > t.text[max(first, comma - 200) : comma].count(">")


def _head(t: Tokens, first: int, last: int, most: int = 400) -> str:
    """A statement's tokens, with nothing in its brackets."""
    parts, i = [], first
    while i <= last and len(parts) < most:
        parts.append(t.text[i])
        if t.kind[i] == "op" and t.text[i] in _OPEN and t.mate[i] >= i:
            i = t.mate[i]
            if i <= last:
                parts.append(t.text[i])
        i += 1
    return " ".join(parts)


_RUST_ITEMS = frozenset("fn struct enum trait mod const static type impl".split())
_TS_ITEMS = frozenset("class interface enum type function".split())


def _rust(t: Tokens):
    for first, last in _statements_braces(t):
        if _RUST_ITEMS & set(t.text[first : min(last, first + 12) + 1]):
            yield first, last, first, _head(t, first, last)


def _typescript(t: Tokens):
    """Definitions begin after decorators and ``export``; a variable's at its name, its head beginning with ``let``."""
    listing: dict[int, str] = {}  # the block whose last statement, a list of variables, goes on after a comma
    for first, last in _statements_braces(t):
        block, i = t.inside[first], first
        while t.text[i] == "@" and i < last:
            i += 2
            while t.text[i] == "." and i < last:
                i += 2
            if t.text[i] == "(" and t.mate[i] > i:
                i = t.mate[i] + 1
            if i > last:
                break
        lead = i
        while i < last and t.text[i] in ("export", "default", "declare"):
            i += 1
        if i > last:
            continue
        word = t.text[i]
        variable = word in ("const", "let", "var") and t.after(i) != "enum"
        goes_on = listing.pop(block, None)
        end = last - 1 if t.text[last] in (",", ";") and last > i else last
        if variable or (goes_on and not variable):
            lead = i if variable and lead == i else first if goes_on else -1
            i += variable
            if t.text[last] == ",":
                listing[block] = "let"
            if i <= end:
                yield i, end, lead, "let " + _head(t, i, end)
        elif _TS_ITEMS & set(t.text[i : i + 3]) or (t.text[end] == "}" and "(" in t.text[i : i + 40]):
            yield i, end, lead, _head(t, i, end)


def _logical_lines(t: Tokens) -> list[tuple[int, int, int]]:
    """(first, last, indent) of Python's statements' lines."""
    out = []
    for i in range(len(t.text)):
        if t.first[i] and t.inside[i] == -1 and not (t.text[i] in _CLOSE and t.mate[i] >= 0):
            out.append([i, i, t.column(t.start[i])])
        elif not out:
            out.append([i, i, 0])
        out[-1][1] = i
    return [tuple(x) for x in out]


def _python(t: Tokens):
    """A block goes on as long as lines are indented deeper than its head: a stack of open heads is closed by each line."""
    open_heads: list[list] = []
    done = []
    previous = -1
    lead = None
    for first, last, indent in _logical_lines(t):
        while open_heads and open_heads[-1][0] >= indent:
            done.append((*open_heads.pop()[1:], previous))
        if t.text[first] == "@":
            lead = first if lead is None else lead
        else:
            i = first
            while i <= last:  # heads after a colon or semicolon too, as in `if x: class A: pass`
                word = t.text[i]
                at = i + 1 if word == "async" and t.after(i) == "def" else i
                if t.text[at] in ("def", "class") and at < last and t.kind[at + 1] == "word":
                    open_heads.append([indent, i, lead if lead is not None and i == first else i])
                nxt = next((k for k in range(i, last) if t.text[k] in (":", ";") and t.inside[k] == -1), None)
                if nxt is None or (t.text[nxt] == ":" and t.text[i] not in ("if", "else", "try", "for", "while", "with", "class", "def", "async", "finally", "elif", "except")):
                    break
                i = nxt + 1
            lead = None
        previous = last
    done += [(*h[1:], previous) for h in open_heads]
    for first, lead, last in done:
        colon = next((k for k in range(first, last + 1) if t.text[k] == ":" and t.inside[k] == -1), last)
        yield first, last, lead, _head(t, first, colon)


_SCALA_ITEMS = frozenset("object class trait def val var type".split())
_SCALA_BEFORE = frozenset("private protected final sealed abstract implicit lazy override case inline open transparent infix opaque".split())
_SCALA_GOES_ON = frozenset("} ) ] { . else catch finally with extends yield match =>".split())
_SCALA_ENDS_NOT = frozenset("= => <- + - * / && || == != < > , ( [ { : . extends with else match yield".split())


def _scala(t: Tokens):
    """A definition ends before the next line that is indented no deeper, or where its block of braces ends."""
    n = len(t.text)
    for i, word in enumerate(t.text):
        block = t.inside[i]
        if t.kind[i] != "word" or word not in _SCALA_ITEMS or t.before(i) in (".", "#", "new", "package") or (block >= 0 and t.text[block] != "{"):
            continue
        first = i
        while first > 0 and t.inside[first - 1] == block:
            p = first - 1
            if t.text[p] in _SCALA_BEFORE and t.kind[p] == "word":
                first = p
            elif t.text[p] == "]" and t.mate[p] > 0 and t.text[t.mate[p] - 1] in ("private", "protected"):
                first = t.mate[p] - 1
            elif t.kind[p] == "word" and p > 0 and t.text[p - 1] == "@":
                first = p - 1
            elif t.text[p] == ")" and t.mate[p] > 1 and t.text[t.mate[p] - 2] == "@":
                first = t.mate[p] - 2
            else:
                break
        depth = t.column(t.start[first])
        if not t.first[first]:  # a definition after others on its line: the line's depth counts
            begin = t.lines[t.line(t.start[first]) - 1]
            depth = len(re.match(r"[^\S\n]*", t.src[begin : begin + 1000]).group())
        k, last = i + 1, i
        limit = t.mate[block] if block >= 0 else n
        while k < limit:
            if t.text[k] == ";" and t.kind[k] == "op":
                break
            deep = t.column(t.start[k]) if t.first[k] else depth + 1
            if deep < depth or (deep == depth and t.text[k] not in _SCALA_GOES_ON and t.text[last] not in _SCALA_ENDS_NOT):
                break
            last = t.mate[k] if t.text[k] in _OPEN and t.kind[k] == "op" and t.mate[k] > k else k
            k = last + 1
        yield first, last, first, _head(t, first, last)


_RUBY_OPENS = frozenset("class module def if unless while until case for begin do".split())
_RUBY_TAILS = frozenset("if unless while until rescue".split())


def _ruby(t: Tokens):
    """Openers and ``end`` pair on a stack; one that follows a value on its line only qualifies it, and a loop's ``do`` is the loop's own."""
    stack: list[list] = []
    n = len(t.text)
    for i, word in enumerate(t.text):
        if t.kind[i] != "word" or t.before(i) in (".", "&.", "::"):
            continue
        if word == "end":
            if stack:
                opener, head = stack.pop()
                if head is not None:
                    yield opener, i, opener, head
        elif word in _RUBY_OPENS:
            if t.before(i) == "def":  # a method of that name
                continue
            if word in _RUBY_TAILS and not t.first[i] and (t.operand(i - 1) or t.text[i - 1] in ("return", "next", "break", "redo", "retry", "yield")):
                continue
            if word == "do" and stack and t.text[stack[-1][0]] in ("while", "until", "for") and not any(t.text[k] in ("do", ";") or (t.first[k] and t.inside[k] == t.inside[i]) for k in range(stack[-1][0] + 1, i)):
                continue
            head = None
            if word in ("class", "module", "def") and not (word == "class" and t.after(i) == "<"):
                k = i + 1
                while k < n and (not t.first[k] or t.inside[k] != t.inside[i]) and t.text[k] != ";":
                    k += 1
                head = _head(t, i, k - 1)
                if word == "def":
                    at = i + 2
                    if t.text[at : at + 1] == ["="] and t.start[at] == t.end[at - 1]:  # what sets a value is no plain name
                        head = None
                    while at + 1 < n and t.text[at] in (".", "::"):
                        at += 2
                    if at < n and t.text[at] == "(" and t.mate[at] > at:
                        at = t.mate[at] + 1
                    if at < k and t.text[at] == "=" and t.src[t.end[at] : t.end[at] + 1].isspace() and t.src[t.start[at] - 1].isspace():  # without an end
                        last = k - 1
                        while last + 1 < n and t.text[last] in ("=", ",", ".", "+", "&&", "||"):
                            last += 1
                        yield i, last, i, head
                        continue
            stack.append([i, head])


_SPLIT = {"rust": _rust, "typescript": _typescript, "python": _python, "scala": _scala, "ruby": _ruby}


def definitions(t: Tokens) -> list[tuple[int, int, int, str]]:
    """(first, last, lead, head) of what may define something, in the order of the source; a comment before token ``lead`` is about it."""
    return sorted(_SPLIT[t.language](t), key=lambda d: (d[0], -d[1]))


# names that refer to something


def qualifier(t: Tokens, i: int) -> str | None:
    """The last word before the mark (a dot, say) that stands before token ``i``, in the expression that the mark belongs to."""
    j = i - 2
    while j >= 0:
        begin = t.start[j]
        closer = t.kind[j] == "op" and t.text[j] in _CLOSE and 0 <= t.mate[j] < j
        if closer:
            begin = t.start[t.mate[j]]
        elif t.text[j] == ">":  # type arguments
            o = next((k for k in range(j - 1, max(-1, j - 100), -1) if t.text[k] == "<" and t.text[k:j].count("<") > t.text[k:j].count(">")), None)
            if o is None:
                return None
            begin = t.start[o]
        elif not (t.kind[j] in ("string", "number") or t.kind[j] == "word"):
            return None
        found = re.findall(r"\w+", t.src[max(begin, t.start[i] - 4000) : t.start[i]])
        if found:
            return found[-1]
        j = t.mate[j] - 1 if closer else j - 1
        if not closer or not t.operand(j):
            return None
    return None


def _blank_between(t: Tokens, i: int) -> bool:
    return i + 1 < len(t.text) and t.end[i] < t.start[i + 1]


def _calls_rust(t: Tokens):
    skip = set()
    for i, word in enumerate(t.text):
        if i in t.opaque:
            skip.update(range(i + 1, t.mate[i]))
        elif word == "#" and t.kind[i] == "op" and t.after(i) in ("[", "!"):  # an attribute
            o = i + 1 if t.after(i) == "[" else i + 2
            if o < len(t.text) and t.text[o] == "[":
                skip.update(range(o, t.mate[o]))
        elif word in ("let", "for") and t.kind[i] == "word":  # patterns, to the value that they take apart
            stop, k = ("=", "else", ";") if word == "let" else ("in", "{"), i + 1
            while k < len(t.text) and not (t.inside[k] == t.inside[i] and t.text[k] in stop) and t.inside[k] >= t.inside[i]:
                skip.add(k)
                k += 1
        elif word == "enum" and t.kind[i] == "word":
            o = next((k for k in range(i, min(len(t.text), i + 200)) if t.text[k] == "{"), None)
            if o:
                skip.update(range(o, t.mate[o]))
        elif word == "match" and t.kind[i] == "word":
            o = next((k for k in range(i, min(len(t.text), i + 2000)) if t.text[k] == "{" and t.inside[k] == t.inside[i]), None)
            k = o + 1 if o else 0
            while o and k < t.mate[o]:  # from an arm's start to its arrow, or to its condition
                while k < t.mate[o] and not (t.inside[k] == o and t.text[k] in ("=>", "if")):
                    skip.add(k)
                    k += 1
                while k < t.mate[o] and not (t.inside[k] == o and t.text[k] == "=>"):
                    k += 1
                k += 1
                if t.text[k : k + 1] == ["{"]:
                    k = t.mate[k] + 1
                    k += t.text[k : k + 1] == [","]
                else:
                    while k < t.mate[o] and not (t.inside[k] == o and t.text[k] == ","):
                        k += 1
                    k += 1
    for i, word in enumerate(t.text):
        if t.kind[i] != "word" or word in t.keywords or i in skip:
            continue
        if t.after(i) == "(" and t.before(i) not in ("fn", "struct", "mod", "!") and word not in ("Fn", "FnMut", "FnOnce", "self", "Self"):
            yield i
        elif t.after(i) == "!" and i + 2 in t.opaque and t.before(i) != "::" and word != "macro_rules":
            yield i


def _calls_scala(t: Tokens):
    skip = set()
    for i, word in enumerate(t.text):
        if word == "case" and t.after(i) not in ("class", "object"):
            k = i + 1
            while k < len(t.text) and not (t.inside[k] == t.inside[i] and t.text[k] in ("=>", "if")) and t.inside[k] >= t.inside[i]:
                skip.add(k)
                k += 1
    no = frozenset("def class trait object new extends with @ enum package given".split())
    for i, word in enumerate(t.text):
        if t.kind[i] != "word" or word in t.keywords or i in skip or t.before(i) in no:
            continue
        infix = t.before(i) not in (".", "") and not t.first[i] and t.operand(i - 1)
        block = t.after(i) == "{" and not t.new_line(i + 1) and t.before(i) not in (":", "match", "<:", "=>" if t.before(i) == ":" else ":")
        if (t.after(i) == "(" or block) and not infix and not t.new_line(i + 1):
            yield i


def _type_arguments(t: Tokens, i: int) -> int:
    """The token after the type arguments that follow token ``i``, or ``i`` + 1."""
    if t.after(i) != "<":
        return i + 1
    depth, k = 0, i + 1
    while k < min(len(t.text), i + 200):
        if t.text[k] == "<":
            depth += 1
        elif t.text[k] == ">":
            depth -= 1
            if not depth:
                return k + 1
        elif t.kind[k] not in ("word", "string") and t.text[k] not in (",", ".", "[", "]", "{", "}", "|", "&", ":", "?", ";", "(", ")", "=>"):
            break
        k += 1
    return i + 1


def _calls_typescript(t: Tokens):
    members = set()  # names of members, in the blocks of classes, interfaces and types
    kinds: dict[int, bool] = {}
    for first, last in _statements_braces(t):
        block = t.inside[first]
        if kinds.get(block):
            k = first
            while k < last and t.text[k] in ("public", "private", "protected", "static", "readonly", "abstract", "override", "async", "get", "set", "*", "declare") and t.after(k) not in ("(", "<"):
                k += 1
            members.add(k)
        head = t.text[first : first + 5]
        typed = any(w in ("class", "interface") for w in head) or ("type" in head[:3] and "=" in t.text[first : first + 12])
        if typed:
            k = first
            while k <= last:
                if t.text[k] == "{":
                    kinds[k] = True
                k = t.mate[k] + 1 if t.kind[k] == "op" and t.text[k] in _OPEN and t.mate[k] > k else k + 1
    for i, word in enumerate(t.text):
        if t.kind[i] != "word" or (word in t.keywords and word not in ("of", "declare", "is", "as", "infer")) or i in members or word.startswith("#"):
            continue
        if t.before(i) in ("new", "function", "class", "*") and not (t.before(i) == "*" and t.operand(i - 2)):
            continue
        if t.before(i) == "function" or (t.before(i) == "new"):
            continue
        k = _type_arguments(t, i)
        if k < len(t.text) and t.text[k] == "?." and t.text[k + 1 : k + 2] == ["("]:
            k += 1
        if k >= len(t.text) or word in ("of", "is", "as") and t.operand(i - 1):
            continue
        if t.text[k] == "(" and t.kind[k] == "op":
            follows = t.after(t.mate[k])
            if follows == "{" and not t.new_line(t.mate[k] + 1):  # a method of an object
                continue
            if follows == ":" and t.inside[i] >= 0 and t.text[t.inside[i]] == "{" and t.before(i) in ("{", ",", "async", "get", "set"):
                continue
            yield i
        elif k == i + 1 and t.kind[k] == "string" and t.src[t.start[k]] == "`":
            yield i


def _calls_python(t: Tokens):
    patterns = set()  # of a match statement's cases, up to their conditions
    for first, last, _ in _logical_lines(t):
        if t.text[first] == "case" and first < last and t.text[first + 1] not in ("=", ".", ",", ":"):
            colon = next((k for k in range(first, last + 1) if t.text[k] in (":", "if") and t.inside[k] == -1), None)
            if colon:
                patterns.update(range(first, colon))
    for i, word in enumerate(t.text):
        if t.kind[i] == "word" and t.after(i) == "(" and word not in t.keywords and t.before(i) not in ("def", "class") and i not in patterns and not (t.first[i + 1] and t.inside[i + 1] == -1):
            yield i


_RUBY_ARGUMENT = frozenset("[ -> ! * & :: ** { -".split())


def _calls_ruby(t: Tokens):
    n = len(t.text)
    for i, word in enumerate(t.text):
        if t.kind[i] not in ("word",) or word[0] in "@$" or not (word[0].islower() or word[0] == "_") or t.before(i) in ("def", "alias", "undef", "class", "module"):
            continue
        sent = t.before(i) in (".", "&.") or (t.before(i) == "::" and t.after(i) == "(")
        if sent and t.before(i - 2) == "def":  # `def self.name`
            continue
        if sent:
            yield i
            continue
        if word in t.keywords and word != "defined?":
            continue
        if i + 1 >= n or t.new_line(i + 1):
            continue
        nxt, blank = t.text[i + 1], _blank_between(t, i)
        parameter = t.before(i) == "|" and t.before(i - 1) in ("{", "do")
        begins = (t.first[i] or not t.operand(i - 1)) and not parameter
        if nxt == "(" and not blank:
            yield i
        elif nxt in ("{", "do") and begins and (t.first[i] or t.before(i) not in ("while", "until", "for", "in")):
            yield i
        elif blank and begins and t.before(i) not in ("::", ".") and (
            t.kind[i + 1] in ("string", "number", "label")
            or (t.kind[i + 1] == "word" and (nxt not in t.keywords or nxt in ("nil", "true", "false", "self", "not", "def", "lambda", "proc", "defined?", "super", "case", "__method__")))
            or (nxt in _RUBY_ARGUMENT and not _blank_between(t, i + 1))
        ):
            yield i


_CALLS = {"rust": _calls_rust, "scala": _calls_scala, "typescript": _calls_typescript, "python": _calls_python, "ruby": _calls_ruby}


def calls(t: Tokens):
    """The numbers of the names that are called."""
    return _CALLS[t.language](t)


def parents(t: Tokens, found: list[tuple[int, int, int, str]]):
    """The numbers of the names that definitions extend."""
    n = len(t.text)
    if t.language == "ruby":
        for first, *_ in found:
            k = first + 1
            while k + 2 < n and t.text[first] == "class" and t.text[k + 1] == "::":
                k += 2
            if t.text[first] == "class" and t.text[k + 1 : k + 2] == ["<"] and k + 2 < n and t.text[k + 2][0].isupper() and (t.new_line(k + 3) or t.after(k + 2) == ";"):
                yield k + 2
    elif t.language == "python":
        for first, *_ in found:
            o = first + 2
            if t.text[o : o + 1] == ["["]:  # type parameters
                o = t.mate[o] + 1
            if t.text[first] == "class" and t.text[o : o + 1] == ["("]:
                yield from (k for k in range(o + 1, t.mate[o]) if t.inside[k] == o and t.kind[k] == "word" and t.text[k - 1] in ("(", ",") and t.text[k + 1] in (")", ",") and t.text[k] not in t.keywords)
    elif t.language == "scala":
        for i, word in enumerate(t.text):
            if t.kind[i] == "word" and word in ("extends", "with") and i + 1 < n and t.kind[i + 1] == "word" and t.after(i + 1) not in (".", "[", "#"):
                if word == "extends" or _in_parents(t, i):
                    yield i + 1
    elif t.language == "rust":
        for first, last, *_ in found:
            i = first + (t.text[first] == "unsafe")
            if t.text[i] == "impl":
                i = _angle_end(t, i + 1, last) if t.after(i) == "<" else i + 1
                if i + 1 <= last and t.kind[i] == "word" and t.text[i + 1] == "for":
                    yield i
    else:
        for i, word in enumerate(t.text):
            if t.kind[i] != "word" or word != "class" or t.before(i) in (".", "?."):
                continue
            k, depth, mode = i + 1, 0, None
            while k < n and not (t.text[k] == "{" and not depth):
                text = t.text[k]
                depth += (text == "<") - (text == ">")
                if not depth and text in ("extends", "implements"):
                    mode = text
                elif not depth and mode and t.kind[k] == "word" and t.text[k - 1] in ("extends", "implements", ","):
                    if t.after(k) in ("{", ",", "implements") or (mode == "extends" and t.after(k) == "<"):
                        yield k
                k = t.mate[k] + 1 if t.kind[k] == "op" and text in _OPEN and t.mate[k] > k else k + 1


def _in_parents(t: Tokens, i: int) -> bool:
    """Whether the ``with`` at ``i`` goes on a list that ``extends`` began."""
    k = i - 1
    while k > 0 and i - k < 200:
        if t.text[k] in ("]", ")") and 0 <= t.mate[k] < k:
            k = t.mate[k] - 1
            continue
        if t.text[k] == "extends":
            return True
        if t.kind[k] != "word" and t.text[k] not in (".",) or t.text[k] in ("new", "class", "object", "trait", "def", "val"):
            return False
        k -= 1
    return False


def _angle_end(t: Tokens, i: int, last: int) -> int:
    depth = 0
    while i <= last:
        depth += (t.text[i] == "<") - (t.text[i] == ">")
        i += 1
        if not depth:
            break
    return i


def imports(t: Tokens):
    """(line, text): whole import statements, or in TypeScript the imported names."""
    n = len(t.text)
    if t.language == "rust":
        for first, last in _statements_braces(t):
            i = first
            if t.text[i] == "pub":
                i += 1
                if i < n and t.text[i] == "(":
                    i = t.mate[i] + 1
            if i < n and t.text[i] == "use":
                yield t.line(t.start[first]), t.src[t.start[first] : t.end[last]]
    elif t.language == "python":
        for first, last, _ in _logical_lines(t):
            if t.text[first] in ("import", "from") and t.text[first + 1 : first + 2] != ["__future__"]:
                end = next((k for k in range(first, last) if t.text[k] == ";"), last + 1) - 1
                yield t.line(t.start[first]), t.src[t.start[first] : t.end[end]]
    elif t.language == "scala":
        for i, word in enumerate(t.text):
            if word == "import" and t.kind[i] == "word" and t.before(i) != ".":
                k = i
                while k + 1 < n and (not t.first[k + 1] or t.inside[k + 1] != t.inside[i] or t.text[k] in (",", ".")) and t.text[k + 1] != ";":
                    k += 1
                yield t.line(t.start[i]), t.src[t.start[i] : t.end[k]]
    elif t.language == "typescript":
        for i, word in enumerate(t.text):
            if word != "import" or t.kind[i] != "word" or t.after(i) in ("(", ".") or t.before(i) in (".", ":"):
                continue
            k = i + 1
            if t.text[k : k + 1] == ["type"] and t.after(k) not in ("from", ","):
                k += 1
            if k < n and t.kind[k] == "word" and t.text[k] not in ("from",) and t.after(k) in (",", "from"):
                yield t.line(t.start[k]), t.text[k]
                k += 1
            if t.text[k : k + 1] == [","]:
                k += 1
            if t.text[k : k + 1] == ["{"]:
                for j in range(k + 1, t.mate[k]):
                    if t.kind[j] == "word" and (t.text[j - 1] in ("{", ",") or (t.text[j - 1] == "type" and t.text[j - 2] in ("{", ","))) and not (t.text[j] == "type" and t.kind[j + 1] == "word" and t.after(j) != "as"):
                        yield t.line(t.start[j]), t.text[j]
