"""A lexer and shallow parser of TypeScript and JavaScript: references, functions, tokens, blocks.

It finds what the facts need by looking at tokens and matching brackets; it builds no syntax tree. Syntax
errors are those that show at that depth: open strings, comments, templates and brackets, declarations or
operators that lack an operand, and neighbours on one line that no statement, expression or type has side by
side (two operands, a statement's keyword behind an operator, a condition without its bracket). Positions are lines from 1 and columns from 1 in UTF-16 units.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass, field

LINE_END = re.compile("\r\n|[\r\n\u2028\u2029]")
GENERATED = re.compile(r"^\s*(?://[^\n]*@generated\b|/\*[\s\S]{0,500}?@generated\b)")
IDENT = re.compile(r"[A-Za-z_$#\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
SPACE = re.compile("[\\s\ufeff]+")
PUNCTUATION = sorted(
    "{ } ( ) [ ] . ... ; , < > <= >= == != === !== => + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= "
    "<<= >>= >>>= &= |= ^= &&= ||= ??= @".split(),
    key=len,
    reverse=True,
)
ASSIGNMENTS = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())
CONTROL = frozenset("if for while switch catch with function return typeof await new throw delete void in of case do else yield super import".split())
MODIFIERS = frozenset("static async get set public private protected readonly override abstract accessor * declare".split())
PAIRS = {")": "(", "]": "[", "}": "{"}
BINARY = frozenset("* / % ** === !== == != && || ?? = += -= => ".split())


# Words that may stand directly before a name, a string or a number: keywords, modifiers, and words with a meaning in place.
LEADS = frozenset("""
    abstract accessor as asserts async await of break case class const constructor continue declare default defer delete do else enum
    export extends for from function get global implements import in infer instanceof interface is keyof let module namespace new of out
    override package private protected public readonly require return satisfies set source static throw type typeof unique using var
    void with yield
""".split())  # fmt: skip
# Words that may stand directly behind an operand.
FOLLOWS = frozenset("as assert else extends from implements in instanceof is of satisfies while with".split())
STATEMENTS = frozenset("break case catch const continue default do else export finally for if return switch throw try var while with".split())
OPERATORS = frozenset("return throw typeof void delete new in instanceof case".split())
CONDITIONS = frozenset("if while switch".split())
NO_OPERAND = frozenset("* % ** === !== == != && || ?? = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => <= , ; ) ] ? . ?. :".split())
NEEDS_OPERAND = frozenset("% ** === !== == != && || ?? = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= <=".split())


class SyntaxProblem(Exception):
    def __init__(self, position: int, message: str):
        super().__init__(message)
        self.position = position


@dataclass
class Token:
    kind: str  # name, number, string, template, template-part, regex, text, punctuation
    text: str
    start: int
    end: int


@dataclass
class Parsed:
    valid: bool = True
    generated: bool = False
    lines: int = 0
    dependencies: list[dict] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)
    tokens: list[dict] = field(default_factory=list)
    blocks: list[tuple[int, int]] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)


class Lexer:
    def __init__(self, source: str, jsx: bool):
        self.s, self.jsx, self.at = source, jsx, 0
        self.tokens: list[Token] = []
        self.comments: list[str] = []
        self.controls: list[bool] = []  # for each open '(': whether if, while, for or with stands before it
        self.closed_control = False

    def add(self, kind: str, start: int) -> None:
        self.tokens.append(Token(kind, self.s[start : self.at], start, self.at))

    def operand_expected(self) -> bool:
        """Whether a '/' begins a regular expression and a '<' an element here."""
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == "name":
            return last.text in BEFORE_REGEX
        if last.kind != "punctuation":
            return last.kind == "template-part" and last.text.endswith("${")
        if last.text == ")":
            return self.closed_control
        return last.text not in ("]", "++", "--")

    def run(self) -> list[Token]:
        self.code(None)
        return self.tokens

    def code(self, stop: str | None) -> None:
        """Up to the end, or to the '}' that closes a substitution or an embedded expression."""
        depth = 0
        while self.at < len(self.s):
            c = self.s[self.at]
            if m := SPACE.match(self.s, self.at):
                self.at = m.end()
                continue
            start = self.at
            if self.s.startswith("//", start) or (start == 0 and self.s.startswith("#!")):
                m = LINE_END.search(self.s, start)
                self.at = m.start() if m else len(self.s)
                self.comments.append(self.s[start : self.at])
            elif self.s.startswith("/*", start):
                end = self.s.find("*/", start + 2)
                if end < 0:
                    raise SyntaxProblem(start, "comment without end")
                self.at = end + 2
            elif c in "\"'":
                self.string(c)
            elif c == "`":
                self.template()
            elif c == "/" and self.operand_expected():
                self.regex()
            elif c == "<" and self.jsx and self.operand_expected() and self.element_begins():
                self.element()
            elif c.isdigit() or (c == "." and self.s[start + 1 : start + 2].isdigit()):
                self.at = NUMBER.match(self.s, start).end()
                self.add("number", start)
            elif m := IDENT.match(self.s, start):
                self.at = m.end()
                self.add("name", start)
            else:
                if c == "}" and stop and depth == 0:
                    return
                self.punctuation()
                depth += {"{": 1, "}": -1}.get(self.tokens[-1].text, 0)
        if stop:
            raise SyntaxProblem(len(self.s), "'}' expected")

    def punctuation(self) -> None:
        start = self.at
        for p in PUNCTUATION:
            if self.s.startswith(p, start) and not (p == "?." and self.s[start + 2 : start + 3].isdigit()):
                break
        else:
            raise SyntaxProblem(start, "unknown character")
        if p.startswith(">"):
            p = ">" if not p.endswith("=") or p == ">=" else p  # nested type arguments close one by one
            p = ">" if p == ">=" and self.s.startswith(">=>", start) else p
        if p == "(":
            self.controls.append(bool(self.tokens) and self.tokens[-1].text in ("if", "while", "for", "with"))
        elif p == ")":
            self.closed_control = self.controls.pop() if self.controls else False
        self.at = start + len(p)
        self.add("punctuation", start)

    def string(self, quote: str) -> None:
        start = self.at
        self.at += 1
        while self.at < len(self.s) and self.s[self.at] != quote:
            if self.s[self.at] in "\r\n":
                raise SyntaxProblem(start, "string without end")
            self.at += 2 if self.s[self.at] == "\\" else 1
        if self.at >= len(self.s):
            raise SyntaxProblem(start, "string without end")
        self.at += 1
        self.add("string", start)

    def template(self) -> None:
        start, whole = self.at, True
        self.at += 1
        while self.at < len(self.s):
            c = self.s[self.at]
            if c == "`":
                self.at += 1
                self.add("template" if whole else "template-part", start)
                return
            if c == "\\":
                self.at += 2
            elif self.s.startswith("${", self.at):
                whole = False
                self.at += 2
                self.add("template-part", start)
                self.code("}")
                start = self.at
                self.at += 1
            else:
                self.at += 1
        raise SyntaxProblem(start, "template without end")

    def regex(self) -> None:
        start, in_class = self.at, False
        self.at += 1
        while self.at < len(self.s):
            c = self.s[self.at]
            if c in "\r\n":
                break
            if c == "\\":
                self.at += 2
                continue
            if c == "/" and not in_class:
                self.at = re.compile(r"[A-Za-z]*").match(self.s, self.at + 1).end()
                self.add("regex", start)
                return
            in_class = c == "[" or (in_class and c != "]")
            self.at += 1
        raise SyntaxProblem(start, "regular expression without end")

    def element_begins(self) -> bool:
        """Not the type parameters of a generic function."""
        return bool(re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?!\s*,|\s+extends\b)(?:[\s/>]))").match(self.s, self.at))

    def element(self) -> None:
        """An element with its attributes and children."""
        self.tag()
        if self.tokens[-1].text == "/>":
            return
        while True:
            start = self.at
            m = re.compile(r"[<{]").search(self.s, self.at)
            if not m:
                raise SyntaxProblem(start, "element without end")
            self.at = m.start()
            if self.s[start : self.at].strip():
                self.add("text", start)
            if self.s[self.at] == "{":
                self.embedded()
            elif re.compile(r"<\s*/").match(self.s, self.at):
                self.tag()
                return
            else:
                self.element()

    def embedded(self) -> None:
        self.punctuation()
        self.code("}")
        self.punctuation()

    def tag(self) -> None:
        start = self.at
        self.at += 1
        self.add("markup", start)
        while self.at < len(self.s):
            if m := SPACE.match(self.s, self.at):
                self.at = m.end()
                continue
            start, c = self.at, self.s[self.at]
            if self.s.startswith("/>", start):
                self.at += 2
                self.add("markup", start)
                return
            if c == ">":
                self.at += 1
                self.add("markup", start)
                return
            if c == "{":
                self.embedded()
            elif c in "\"'":
                end = self.s.find(c, start + 1)
                if end < 0:
                    raise SyntaxProblem(start, "attribute without end")
                self.at = end + 1
                self.add("string", start)
            elif m := re.compile(r"[\w$.:-]+").match(self.s, start):
                self.at = m.end()
                self.add("text", start)
            elif c in "=/<,":
                self.at += 1
                self.add("markup", start)
            else:
                raise SyntaxProblem(start, "unknown character in an element")
        raise SyntaxProblem(start, "element without end")


def literal(token: Token | None) -> str | None:
    if token is None or token.kind not in ("string", "template"):
        return None
    return re.sub(r"\\(?:u\{([\da-fA-F]+)\}|u([\da-fA-F]{4})|x([\da-fA-F]{2})|(\r\n|[\s\S]))", _unescaped, token.text[1:-1])


def _unescaped(m: re.Match) -> str:
    code = m.group(1) or m.group(2) or m.group(3)
    if code:
        return chr(int(code, 16))
    return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}.get(m.group(4), m.group(4))


class Parser:
    def __init__(self, file: str, source: str, out: Parsed, limits: dict[str, int]):
        self.file, self.s, self.out, self.limits = file, source, out, limits
        self.starts = [0, *(m.end() for m in LINE_END.finditer(source))]
        lexer = Lexer(source, file.lower().endswith((".tsx", ".jsx", ".js", ".mjs", ".cjs")))
        self.t = lexer.run()
        self.comments = lexer.comments
        self.match: dict[int, int] = {}
        self.brackets()

    def place(self, position: int) -> tuple[int, int]:
        line = bisect_right(self.starts, position) - 1
        return line + 1, len(self.s[self.starts[line] : position].encode("utf-16-le", "surrogatepass")) // 2 + 1

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind in ("name", "punctuation") else ""

    def brackets(self) -> None:
        open_: list[int] = []
        for i, token in enumerate(self.t):
            if token.kind != "punctuation":
                continue
            if token.text in "({[":
                open_.append(i)
            elif token.text in PAIRS:
                if not open_ or self.t[open_[-1]].text != PAIRS[token.text]:
                    raise SyntaxProblem(token.start, "bracket without a partner")
                j = open_.pop()
                self.match[i], self.match[j] = j, i
        if open_:
            raise SyntaxProblem(self.t[open_[-1]].start, "bracket without a partner")
        for i, token in enumerate(self.t):
            if token.kind == "name" and token.text in ("const", "let", "var") and self.text(i - 1) != ".":
                if self.text(i + 1) in ASSIGNMENTS and token.text != "let":
                    raise SyntaxProblem(self.t[i + 1].start, "a name is expected")
            if token.kind == "punctuation" and token.text in BINARY and self.text(i + 1) in (";", ")", "]", ","):
                if not (token.text == "*" or (token.text == "=" and self.text(i - 1) == ">")):
                    raise SyntaxProblem(self.t[i + 1].start, "an expression is expected")

        for i in range(len(self.t) - 1):
            self.neighbours(i, self.t[i], self.t[i + 1])

    def neighbours(self, i: int, token: Token, after: Token) -> None:
        """Whether two tokens may follow each other. Only pairs that no construct has on one line are refused."""
        operand = ("name", "number", "string")
        if token.kind == "number" and after.kind in ("name", "number") and token.end == after.start:
            raise SyntaxProblem(after.start, "a number ends in a name")
        if token.kind == "punctuation" and token.text in NEEDS_OPERAND and after.kind == "punctuation" and after.text in NO_OPERAND:
            if not (token.text == "=" and self.text(i - 1) == ">") and not (after.text == "*" and token.text == "="):
                raise SyntaxProblem(after.start, "an expression is expected")
        if token.kind not in operand or after.kind not in operand or LINE_END.search(self.s, token.end, after.start):
            return
        member = self.text(i - 1) in (".", "?.", "@") or self.decorates(i)
        if token.kind == "name" and not member:
            if token.text in OPERATORS and after.kind == "name" and after.text in STATEMENTS and self.text(i + 2) not in (":", "(", ".", "=", ";", ",", ")"):
                raise SyntaxProblem(after.start, "an expression is expected")
            if token.text in CONDITIONS:
                raise SyntaxProblem(after.start, "'(' expected")
            if token.text in ("const", "var") and after.kind != "name" or token.text == "function" and after.kind == "number":
                raise SyntaxProblem(after.start, "a name is expected")
            if token.text in LEADS:
                return
        if after.kind == "name" and after.text in FOLLOWS or member:
            return
        raise SyntaxProblem(after.start, "';' expected")

    def decorates(self, i: int) -> bool:
        """Whether a name is the last of a decorator's."""
        while self.text(i - 1) == ".":
            i -= 2
        return self.text(i - 1) == "@"

    # --- scopes

    def ambient_ranges(self) -> list[tuple[int, int]]:
        out = [(0, len(self.t))] if re.search(r"\.d\.[cm]?ts$", self.file) else []
        for i, token in enumerate(self.t):
            if token.kind == "name" and token.text == "declare" and self.text(i - 1) in ("", ";", "}", "{", "export", ")"):
                if self.text(i + 1) in ("module", "namespace", "global", "function", "class", "const", "let", "var", "enum", "abstract", "interface", "type", "async"):
                    j = i + 1
                    while j < len(self.t) and self.text(j) not in ("{", ";"):
                        j = self.match[j] + 1 if self.text(j) in ("(", "[") else j + 1
                    out.append((i, self.match[j] if j < len(self.t) and self.text(j) == "{" else j))
        return out

    def require_changes(self) -> bool:
        """A binding named require, or a write to it, anywhere in the file."""
        for i, token in enumerate(self.t):
            if token.kind != "name" or token.text != "require" or self.text(i - 1) == ".":
                continue
            before, after = self.text(i - 1), self.text(i + 1)
            if before in ("const", "let", "var", "function", "class", "enum", "namespace", "module", "as", "++", "--"):
                return True
            if after in ASSIGNMENTS or after in ("++", "--", "=>") or (after in ("of", "in") and before == "("):
                return True
            if before == "import" or (before == "*" and self.text(i - 2) == "function"):
                return True
            if self.in_pattern(i):
                return True
        return False

    def in_pattern(self, i: int) -> bool:
        """Inside brackets that bind or are assigned to: declarations, imports, parameters, destructuring."""
        j = i
        after = self.text(i + 1)
        if after not in (",", "}", "]", ")", "=", ":", ""):
            return False
        if after == ":" and self.text(i - 1) in ("{", ",") and not self.is_parameter_list(self.opening(i)):
            return False  # a property's name, not a binding
        while (j := self.opening(j)) is not None:
            close, before = self.match[j], self.text(j - 1)
            if before in ("const", "let", "var"):
                return True
            if self.text(j) == "{" and (before == "import" or (self.text(j - 2) in ("import", "type") and before in (",", "type"))) and self.text(close + 1) == "from":
                return True
            if self.text(j) in ("{", "[") and (self.text(close + 1) == "=" or (self.text(close + 1) in ("of", "in") and before in ("(", "const", "let", "var"))):
                return True
            if self.is_parameter_list(j):
                return True
            if self.text(j) == "(" or self.text(j) == "{" and before in (")", "=>"):
                return False
        return False

    def opening(self, i: int) -> int | None:
        """The innermost bracket that holds token i."""
        depth = i - 1
        while depth >= 0:
            text = self.text(depth)
            if text in PAIRS and depth in self.match:
                depth = self.match[depth] - 1
                continue
            if text in ("(", "[", "{"):
                return depth
            depth -= 1
        return None

    def is_parameter_list(self, j: int | None) -> bool:
        if j is None or self.text(j) != "(":
            return False
        return self.text(self.match[j] + 1) == "=>" or self.body_after(self.match[j]) is not None and (self.text(j - 1) not in CONTROL or self.text(j - 1) in ("function", "catch"))

    # --- functions

    def body_after(self, close: int) -> int | None:
        """The '{' of the body behind a parameter list, past a return type; None if there is no body."""
        i = close + 1
        if self.text(i) == "{":
            return i
        if self.text(i) != ":":
            return None
        i += 1
        while i < len(self.t):
            text, before = self.text(i), self.text(i - 1)
            if text == "{":
                if before in (":", "|", "&", "is", ",", "<", "extends", "?", "=>"):
                    i = self.match[i] + 1
                    continue
                return i
            if text in ("(", "["):
                i = self.match[i] + 1
                continue
            if text in (";", "=", "}", ")", ",") and not (text == "," and "<" in self.s[self.t[close].end : self.t[i].start]):
                return None
            i += 1
        return None

    def back_over_types(self, i: int) -> int:
        """From before a '(' over type arguments: the token in front of '<...>'."""
        if self.text(i) != ">":
            return i
        depth, j = 0, i
        while j >= 0:
            depth += {">": 1, "<": -1}.get(self.text(j), 0)
            if depth == 0:
                return j - 1
            if self.text(j) in (";", "{", "}"):
                break
            j -= 1
        return i

    def find_functions(self) -> list[tuple[int, int, int, int, str]]:
        """(first token, last token, first and last token of the body, name)."""
        out = []
        for i, token in enumerate(self.t):
            if token.kind != "punctuation":
                continue
            if token.text == "(":
                name_at = self.back_over_types(i - 1)
                found = self.named(i, name_at)
                if found:
                    out.append(found)
            elif token.text == "=>":
                found = self.arrow(i)
                if found:
                    out.append(found)
        return out

    def named(self, i: int, k: int) -> tuple[int, int, int, int, str] | None:
        close = self.match[i]
        body = self.body_after(close)
        if body is None or k < 0:
            return None
        name = self.t[k]
        start = k
        keyword = k if name.text == "function" and name.kind == "name" else None
        if keyword is None and self.text(k) == "*" and self.text(k - 1) == "function":
            keyword = k - 1
        if keyword is None and name.kind == "name":
            p = k - 1
            p -= self.text(p) == "*"
            if self.text(p) == "function":
                keyword = p
        if keyword is not None:
            start = keyword - (self.text(keyword - 1) == "async")
            start -= self.text(start - 1) == "default"
            start -= self.text(start - 1) == "export"
            called = self.variable_before(start) or (name.text if name.kind == "name" and name.text != "function" else "(anonymous/computed)")
            return start, self.match[body], body, self.match[body], called
        if name.kind not in ("name", "string", "number") and self.text(k) != "]":
            return None
        if name.kind == "name" and (name.text in CONTROL or self.text(k - 1) in (".", "?.", "new")):
            return None
        if self.text(k) == "]":
            start = self.match[k]
        while self.text(start - 1) in MODIFIERS and not (self.text(start - 1) == "*" and self.text(start - 2) == ")"):
            start -= 1
        if self.text(start - 1) not in ("{", "}", ";", ",", ")", "") and self.t[start - 1].end == self.t[start].start:
            return None
        if self.opening(start) is None:  # methods stand in a class or an object
            return None
        called = "(anonymous/computed)" if self.text(k) == "]" else literal(name) if name.kind == "string" else name.text
        return start, self.match[body], body, self.match[body], called

    def variable_before(self, start: int) -> str | None:
        """The variable that a function expression or arrow is the value of."""
        if self.text(start - 1) != "=":
            return None
        j = start - 2
        if self.t[j].kind == "name" and self.text(j - 1) in ("const", "let", "var", ","):
            return self.t[j].text
        while j > 0 and self.text(j) not in ("const", "let", "var", ";", "{", "}"):
            j = self.match[j] - 1 if self.text(j) in PAIRS else j - 1
        if self.text(j) in ("const", "let", "var") and self.t[j + 1].kind == "name" and self.text(j + 2) == ":":
            return self.t[j + 1].text
        return None

    def arrow(self, i: int) -> tuple[int, int, int, int, str] | None:
        p = i - 1
        if self.text(p) != ")" and self.text(p) != "" and self.t[p].kind == "name" and self.text(p - 1) not in (":", "|", "&", ".", "is", "]", "extends"):
            start = p
        else:
            while p >= 0 and self.text(p) != ")":  # over a return type
                if self.text(p) in (";", "{", "=", ","):
                    return None
                p = self.match[p] - 1 if self.text(p) in ("]", "}") else p - 1
            if p < 0:
                return None
            start = self.back_over_types(self.match[p] - 1) + 1 if self.text(self.match[p] - 1) == ">" else self.match[p]
        if self.text(start - 1) == "async":
            start -= 1
        if self.text(start - 1) in (":", "|", "&", "<") or (self.text(start - 1) == "=" and self.is_type_alias(start - 2)):
            return None if self.text(start - 1) != ":" or not self.is_property(start - 1) else self.finish_arrow(start, i)
        return self.finish_arrow(start, i)

    def is_type_alias(self, j: int) -> bool:
        while j > 0 and self.text(j) not in (";", "{", "}", "type"):
            j -= 1
        return self.text(j) == "type"

    def is_property(self, colon: int) -> bool:
        """A colon of an object literal or of a conditional, not of a type."""
        holder = self.opening(colon)
        if holder is None or self.text(holder) != "{":
            return "?" in [self.text(k) for k in range(max(0, colon - 40), colon)]
        return self.text(holder - 1) in ("=", "(", ",", "return", ":", "[", "=>", "?", "default", "??", "||", "&&")

    def finish_arrow(self, start: int, i: int) -> tuple[int, int, int, int, str] | None:
        if i + 1 >= len(self.t):
            return None
        end = self.match[i + 1] if self.text(i + 1) == "{" else self.expression_end(i + 1)
        return start, end, i + 1, end, self.variable_before(start) or "(anonymous/computed)"

    def expression_end(self, i: int) -> int:
        j = i
        while j < len(self.t):
            text = self.text(j)
            if text in (",", ";", ")", "]", "}"):
                return j - 1
            if j > i and self.place(self.t[j].start)[0] > self.place(self.t[j - 1].end - 1)[0] and self.t[j].kind in ("name", "string") and text not in ("in", "of", "as", "instanceof", "satisfies"):
                if self.text(j - 1) not in BINARY and self.text(j - 1) not in ("+", "-", "?", ":", ".", "&", "|", "<"):
                    return j - 1
            j = self.match[j] + 1 if text in ("(", "[", "{") else j + 1
        return j - 1

    # --- references

    def reference(self, at: int, specifier: str | None, kind: str, syntax: str, reason: str | None = None) -> None:
        line, column = self.place(self.t[at].start)
        if any(a <= at <= b for a, b in self.ambient):
            kind = "type-only"
        why = reason or (None if specifier is not None else "The argument is no literal: the target cannot be told.")
        self.out.dependencies.append(
            {"from_file": self.file, "line": line, "column": column, "specifier": specifier, "kind": kind, "syntax": syntax, "resolution": "indeterminate" if why else "unresolved", "to_file": None, "reason": why}
        )
        if why:
            self.out.diagnostics.append({"code": "INDETERMINATE_REFERENCE", "severity": "warning", "message": why, "file": self.file, "line": line, "column": column})

    def named_types(self, open_: int) -> tuple[int, int]:
        """(names, how many of them are types) between braces."""
        names = types = 0
        i = open_ + 1
        while i < self.match[open_]:
            names += 1
            if self.text(i) == "type" and self.text(i + 1) not in (",", "}", "as") or (self.text(i) == "type" and self.text(i + 1) == "as" and self.text(i + 2) == "as"):
                types += 1
            while i < self.match[open_] and self.text(i) != ",":
                i += 1
            i += 1
        return names, types

    def clause(self, at: int, i: int, syntax: str) -> None:
        """An import or export with 'from': i is the token after the keyword."""
        type_only = self.text(i) == "type" and self.text(i + 1) not in ("from", ",") or (self.text(i) == "type" and self.text(i + 1) == "from" and self.text(i + 2) == "from")
        i += type_only
        default = syntax == "import" and self.t[i].kind == "name"
        names = types = 0
        while i < len(self.t) and self.text(i) != "from":
            if self.text(i) == "{":
                names, types = self.named_types(i)
                i = self.match[i]
            elif self.text(i) == ";":
                return
            i += 1
        if i + 1 >= len(self.t) or self.t[i + 1].kind != "string":
            return
        target = literal(self.t[i + 1])
        only = type_only or (not default and names > 0 and names == types)
        self.reference(at, target, "type-only" if only else "runtime", syntax)
        if not only and types:
            self.reference(at, target, "type-only", syntax)

    def find_references(self) -> None:
        self.ambient = self.ambient_ranges()
        shadowed = self.require_changes()
        for i, token in enumerate(self.t):
            if token.kind != "name" or token.text not in ("import", "export", "require"):
                continue
            before, after = self.text(i - 1), self.text(i + 1)
            nxt = self.t[i + 1] if i + 1 < len(self.t) else None
            if token.text == "import" and before not in (".", "?."):
                if after == "(":
                    argument = self.t[i + 2] if self.text(i + 3) in (")", ",") else None
                    if self.in_type(i):
                        self.reference(i, literal(argument), "type-only", "import-type")
                    else:
                        self.reference(i, literal(argument), "runtime", "dynamic-import")
                elif after == ".":
                    if self.text(i + 2) == "meta" and self.text(i + 3) == "." and self.text(i + 5) == "(":
                        self.reference(i, None, "runtime", "dynamic-import", "An indirect or tool-specific loader is not supported.")
                elif nxt is not None and nxt.kind == "string":
                    self.reference(i, literal(nxt), "runtime", "import")
                elif nxt is not None and after not in (":", ",", "}", "=", ""):
                    self.import_declaration(i)
                elif nxt is not None and nxt.kind == "punctuation" and after in ("{", "*"):
                    self.import_declaration(i)
            elif token.text == "export" and before not in (".", "?."):
                if after in ("*", "{") or (after == "type" and self.text(i + 2) in ("*", "{")):
                    last = i + 1 + (after == "type")
                    end = self.match[last] if self.text(last) == "{" else last
                    if self.text(end + 1) == "from" or (self.text(end + 1) == "as" and self.text(end + 3) == "from"):
                        self.clause(i, i + 1, "re-export")
                elif after == "import" and self.text(i + 3) == "=":
                    pass  # the import token itself is met next
            elif token.text == "require" and after == "(":
                if before in (".", "?."):
                    self.reference(max(i - 2, 0), None, "runtime", "dynamic-import", "An indirect or tool-specific loader is not supported.")
                elif before not in ("function", "=") or before == "=" and not self.is_import_equals(i):
                    argument = self.t[i + 2] if self.text(i + 3) in (")", ",") else None
                    if before == "function":
                        continue
                    reason = "A binding of require or a write to it leaves the target open." if shadowed else None
                    self.reference(i, None if shadowed else literal(argument), "runtime", "require", reason)

    def is_import_equals(self, i: int) -> bool:
        return self.text(i - 3) == "import" or (self.text(i - 3) == "type" and self.text(i - 4) == "import")

    def import_declaration(self, i: int) -> None:
        k = i + 1
        type_only = self.text(k) == "type" and self.text(k + 2) == "="
        if self.text(k + 1 + type_only) == "=":
            r = k + 2 + type_only
            if self.text(r) == "require" and self.text(r + 1) == "(":
                self.reference(i, literal(self.t[r + 2]), "type-only" if type_only else "runtime", "require")
            return
        self.clause(i, k, "import")

    def in_type(self, i: int) -> bool:
        before = self.text(i - 1)
        if before in ("|", "&", "<", "extends", "keyof", "as", "satisfies", "implements", "is"):
            return True
        if before == "typeof":
            return self.in_type(i - 1) or self.text(self.match[i + 1] + 1) in (".", ";", ">", ",", ")", "|", "&") and self.text(i - 2) in (":", "=", "<", "|", "&")
        if before == "=":
            return self.is_type_alias(i - 2)
        if before == ":":
            return not self.is_property(i - 1)
        if before == ",":
            holder = self.back_over_types(i - 1)
            return holder != i - 1
        return False

    def run(self) -> None:
        out = self.out
        if any(re.match(r"///\s*<reference\b", c) for c in self.comments):
            out.diagnostics.append({"code": "UNSUPPORTED_REFERENCE", "severity": "warning", "message": "Triple-slash directives are not resolved.", "file": self.file, "line": None, "column": None})
        self.find_references()
        bodies = []
        for first, last, body, end, name in sorted(self.find_functions()):
            if any(a <= first <= b for a, b in self.ambient):
                continue
            line, column = self.place(self.t[first].start)
            end_line = self.place(self.t[last].end - 1)[0]
            out.functions.append({"file": self.file, "name": name, "line": line, "column": column, "end_line": end_line, "lines": end_line - line + 1})
            bodies.append((body, end + 1))
        out.functions.sort(key=lambda f: (f["line"], f["column"], f["name"]))
        for k, token in enumerate(self.t):
            line, column = self.place(token.start)
            out.tokens.append({"file": self.file, "idx": k, "hash": hashlib.sha256(f"{token.kind}:{token.text}".encode("utf-8", "surrogatepass")).hexdigest(), "line": line, "column": column, "end_line": self.place(token.end - 1)[0]})
        out.blocks = [(0, len(self.t)), *bodies]


def count_lines(source: str) -> int:
    ends = list(LINE_END.finditer(source))
    return 0 if not source else len(ends) + 1 - (bool(ends) and ends[-1].end() == len(source))


def parse(file: str, source: str, limits: dict[str, int] | None = None) -> Parsed:
    out, limits = Parsed(), limits or {}
    if GENERATED.match(source[:600]):
        out.generated = True
        return out
    try:
        parser = Parser(file, source, out, limits)
        if len(parser.t) > limits.get("maxAstNodes", 1 << 62):
            out.valid = False
            out.diagnostics.append({"code": "AST_LIMIT", "severity": "warning", "message": "More syntax than the limit; the file is not analysed.", "file": file, "line": None, "column": None})
            return out
        parser.run()
    except SyntaxProblem as problem:
        starts = [0, *(m.end() for m in LINE_END.finditer(source))]
        line = bisect_right(starts, problem.position) - 1
        column = len(source[starts[line] : problem.position].encode("utf-16-le", "surrogatepass")) // 2 + 1
        return Parsed(valid=False, diagnostics=[{"code": "SYNTAX_ERROR", "severity": "error", "message": f"Invalid syntax ({problem}); the file's references are not used.", "file": file, "line": line + 1, "column": column}])
    if len(out.dependencies) > limits.get("maxDependencies", 1 << 62):
        return Parsed(valid=False, diagnostics=[{"code": "DEPENDENCY_LIMIT", "severity": "warning", "message": "More references than the limit; the file is not analysed.", "file": file, "line": None, "column": None}])
    if len(out.tokens) > limits.get("maxDuplicationTokens", 1 << 62):
        out.tokens, out.blocks = [], []
        out.diagnostics.append({"code": "DUPLICATION_TOKEN_LIMIT", "severity": "warning", "message": "More tokens than the limit; duplicates in the file are not assessed.", "file": file, "line": None, "column": None})
    out.lines = count_lines(source)
    return out


__all__ = ["Parsed", "Token", "count_lines", "literal", "parse"]
