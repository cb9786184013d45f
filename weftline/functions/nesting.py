"""The nesting of source text: one pass over strings, comments and brackets, then statements with their blocks.

No grammar is parsed. A statement is what stands between the ends of statements at one
depth; its blocks hold statements again. What a statement declares is told by its head,
the words before its block with brackets closed up and strings and comments left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# What each declaration is called in a breadcrumb, by language. A head's first match counts; a prefix may refer to the word matched.
_JAVA = [(r"@ interface (\w+)", "@interface "), (r"(?:^| )(class|interface|enum|record) (\w+)", "{0} ")]
_SCRIPT = [
    (r"^(?:(?:export|default|declare) )*abstract class (\w+)", "abstract class "), (r"^(?:(?:export|default|declare) )*class (\w+)", "class "), (r"^(?:(?:export|default|declare) )*interface (\w+)", "interface "),
    (r"^(?:(?:export|default|declare|async) )*function \* (\w+)", "fn* "), (r"^(?:(?:export|default|declare|async) )*function (\w+)", "fn "), (r"^(?:export )?(?:const|let|var) (\w+) (?:: .*?)?= (?:async )?(?:\(\)|\w+) (?:: .*?)?=>", ""),
]
DECLARATIONS = {
    "typescript": _SCRIPT, "javascript": _SCRIPT,
    "python": [(r"^(?:@.*? )?class (\w+)", "class "), (r"^(?:@.*? )?(?:async )?def (\w+)", "def ")],
    "go": [(r"^func (?:\(\) )?(\w+)", "func "), (r"^type (\w+)", "type ")],
    "rust": [(r"(?:^| )(fn|struct|enum|trait|mod) (\w+)", "{0} "), (r"^(?:unsafe )?impl (?:< .*? > )?(?:.* for )?(\w+)", "impl ")],
    "java": _JAVA, "c_sharp": [(r"(?:^| )(namespace|class|interface|struct|enum|record) ([\w.]+)", "{0} ")],
    "c": [(r"^(?:static )?(?:typedef )?(struct|union|enum) (\w+)(?: $|$)", "{0} ")], "cpp": [(r"(?:^| )(namespace|class|struct|union|enum) (\w+)", "{0} ")],
    "kotlin": [(r"(?:^| )(class|object) (\w+)", "{0} "), (r"(?:^| )interface (\w+)", "class "), (r"(?:^| )fun (?:< .*? > )?(?:\w+ \. )*(\w+)", "fun ")],
    "swift": [(r"(?:^| )(class|struct|enum|protocol|extension|actor|func) (\w+)", "{0} "), (r"(?:^| )(init|deinit)\b", "")],
    "php": [(r"(?:^| )(class|interface|trait|enum|namespace) (\w+)", "{0} "), (r"(?:^| )function (?:& )?(\w+)", "fn ")],
    "dart": [(r"(?:^| )(class|enum|mixin|extension) (\w+)", "{0} ")],
}
#: Languages whose functions have no word of their own: a name before closed-up brackets and a block.
BARE = {"typescript", "javascript", "java", "c_sharp", "c", "cpp", "dart"}
_BARE = re.compile(r"(?:^| )([\w~]+(?: :: [\w~]+)*) (?:< [^()]*> )?\(\)(?: : .*|[^=().]*)$")
CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "return", "function", "do", "else", "try", "with", "using", "lock", "new", "synchronized"}
#: Languages in which the end of a line ends a statement that needs nothing more.
BY_LINE = {"typescript", "javascript", "go", "kotlin", "swift"}
_GOES_ON = {"else", "catch", "finally", "while", "elif", "except"}
_SAME_LINE = {"from", "as", "satisfies"}
_OPENS, _CLOSES = "([{", ")]}"

_BLANK, _WORD = r"(?P<nl>\n)|[^\S\n]+", r"|(?P<word>\w+)|(?P<op>::|=>|->|.)"
_LONG = r'|(?P<string>"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)'
_PLAIN = r'|(?P<string>"""[\s\S]*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)'
_SLASHED = r"|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_LEXERS = {
    "python": _BLANK + r"|(?P<comment>#[^\n]*)" + _LONG + _WORD,
    "php": _BLANK + r"|(?P<comment>//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z))" + _PLAIN + _WORD,
    "go": _BLANK + _SLASHED + r"|(?P<string>`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)" + _WORD,
    "rust": _BLANK + _SLASHED + r"|(?P<string>b?r(?P<hash>#*)\"[\s\S]*?(?:\"(?P=hash)|\Z)|\"(?:\\[\s\S]|[^\"\\])*(?:\"|\Z)|'(?:\\[^']*|[^'\\\n])')" + _WORD,
    "cpp": _BLANK + _SLASHED + r"|(?P<string>R\"(?P<mark>[^(\s]*)\([\s\S]*?(?:\)(?P=mark)\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)" + _WORD,
    "c_sharp": _BLANK + _SLASHED + r"|(?P<string>\$?@\"(?:\"\"|[^\"])*(?:\"|\Z))" + _PLAIN.replace("?P<string>", "?P<string2>") + _WORD,
    "dart": _BLANK + _SLASHED + _LONG + _WORD,
}
_OTHER = _BLANK + _SLASHED + _PLAIN + _WORD
_REGEXES = {k: re.compile(v) for k, v in _LEXERS.items()}
_DEFAULT = re.compile(_OTHER)
_REGEX_LITERAL = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(?P<end>`|\$\{|\Z)")


@dataclass
class Tokens:
    """Kinds, starts and ends of a text's tokens, and the partner of each bracket."""

    text: str
    language: str
    kind: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)

    def add(self, kind: str, start: int, end: int) -> None:
        self.kind.append(kind)
        self.start.append(start)
        self.end.append(end)

    def word(self, k: int) -> str:
        return self.text[self.start[k] : self.end[k]]


def tokens(text: str, language: str) -> Tokens:
    """The tokens of a text; brackets without partner are plain characters."""
    out, regex, script = Tokens(text, language), _REGEXES.get(language, _DEFAULT), language in ("typescript", "javascript")
    open_: list[tuple[str, int]] = []
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if script and c == "`":
            m = _TEMPLATE.match(text, at + 1)
            out.add("string", at, m.end())
            at = m.end()
            if m["end"] == "${":
                open_.append(("${", len(out.kind) - 1))
            continue
        if script and c == "}" and open_ and open_[-1][0] == "${":  # the template goes on
            open_.pop()
            m = _TEMPLATE.match(text, at + 1)
            out.add("string", at, m.end())
            at = m.end()
            if m["end"] == "${":
                open_.append(("${", len(out.kind) - 1))
            continue
        if script and c == "/" and (m := _REGEX_LITERAL.match(text, at)):
            last = next((k for k in reversed(range(len(out.kind))) if out.kind[k] not in ("nl", "comment")), None)
            if last is None or out.word(last) in ("return", "typeof", "case") or (out.kind[last] == "op" and out.word(last) not in ")]}"):
                out.add("string", at, m.end())
                at = m.end()
                continue
        m = regex.match(text, at)
        kind = m.lastgroup
        if kind in ("hash", "mark", "string2"):
            kind = "string"
        if kind:
            k = len(out.kind)
            out.add(kind, at, m.end())
            if kind == "op" and c in _OPENS:
                open_.append((c, k))
            elif kind == "op" and c in _CLOSES:
                want = _OPENS[_CLOSES.index(c)]
                if any(o == want for o, _ in open_):
                    while open_[-1][0] != want:
                        open_.pop()
                    out.partner[open_.pop()[1]] = k
        at = m.end()
    return out


@dataclass
class Node:
    """A comment or a statement: its span, what it declares, and the token ranges of its blocks."""

    start: int
    end: int
    comment: bool = False
    prefix: str | None = None
    name: str | None = None
    head: str = ""
    first: int = 0
    last: int = 0
    blocks: list[tuple[int, int]] = field(default_factory=list)


def nodes(t: Tokens, low: int = 0, high: int | None = None, inside: Node | None = None) -> list[Node]:
    """Comments and statements between two tokens, in order; every other token but line ends belongs to one."""
    high = len(t.kind) if high is None else high
    return _by_indent(t, low, high) if t.language == "python" else _by_bracket(t, low, high, inside)


def children(t: Tokens, node: Node) -> list[Node]:
    return [c for a, b in node.blocks for c in nodes(t, a, b, node)]


def _by_bracket(t: Tokens, low: int, high: int, inside: Node | None) -> list[Node]:
    out, k = [], low
    while k < high:
        if t.kind[k] == "nl":
            k += 1
        elif t.kind[k] == "comment":
            out.append(Node(t.start[k], t.end[k], True))
            k += 1
        else:
            end = _statement_end(t, k, high)
            out.append(_statement(t, k, end, inside))
            k = end
    return out


def _next(t: Tokens, k: int, high: int) -> int:
    while k < high and t.kind[k] in ("nl", "comment"):
        k += 1
    return k


def _statement_end(t: Tokens, first: int, high: int) -> int:
    """The token after the statement that begins at a token."""
    if t.language in ("c", "cpp", "c_sharp") and t.word(first) == "#":  # a preprocessor's line
        k = first
        while k < high and not (t.kind[k] == "nl" and t.word(k - 1) != "\\"):
            k += 1
        return k
    k, marked = first, t.word(first) == "@"
    declared = False
    while k < high:
        word = t.word(k)
        if word == ";" and t.kind[k] == "op":
            return k + 1
        if t.kind[k] == "nl" and t.language in BY_LINE and not marked:
            n = _next(t, k, high)
            if n >= high:
                return k
            last = next((j for j in range(k - 1, first - 1, -1) if t.kind[j] != "comment"), first)
            before, after = t.word(last), t.word(n)
            hangs = (t.kind[last] == "op" and before not in ")]}") or before in ("extends", "implements")
            leads = t.kind[n] == "op" and (after in ".?:&|+*/=<>,)]" or after in ("=>", "->")) or (after == "{" and t.language != "go" and not declared)
            if not hangs and not leads:
                return k
        if k in t.partner and t.partner[k] < high:
            close = t.partner[k]
            k = close + 1
            if word != "{":
                continue
            declared, marked = True, False
            n = _next(t, k, high)
            if n >= high:
                return k
            after, same_line = t.word(n), "\n" not in t.text[t.end[close] : t.start[n]]
            if after == ";":
                return n + 1
            if after in _GOES_ON or (same_line and after in _SAME_LINE):
                k = n
            elif t.kind[n] == "op" and after in ".,)(]=?&|:" and (same_line or after in ".?)],"):
                k = n
            elif not (same_line and t.language in ("c", "cpp") and t.kind[n] in ("word", "op") and any(t.word(j) in ("struct", "union", "enum", "typedef") for j in range(first, min(first + 3, high)))):
                return k
            continue
        k += 1
    return k


def _statement(t: Tokens, first: int, end: int, inside: Node | None) -> Node:
    last = next(j for j in range(end - 1, first - 1, -1) if t.kind[j] != "nl")
    node = Node(t.start[first], t.end[last], first=first, last=last + 1)
    head, k, whole = [], first, False
    while k <= last:
        word = t.word(k)
        if word == "{" and k in t.partner and t.partner[k] <= last:
            node.blocks.append((k + 1, t.partner[k]))
            whole, k = True, t.partner[k]
        elif word in "([" and word and k in t.partner and t.partner[k] <= last:
            j = k + 1
            while j < t.partner[k]:  # blocks of functions that are arguments
                if t.word(j) == "{" and j in t.partner:
                    node.blocks.append((j + 1, t.partner[j]))
                    j = t.partner[j]
                j += 1
            if not whole:
                head.append(word + t.word(t.partner[k]))
            k = t.partner[k]
        elif not whole and t.kind[k] in ("word", "op"):
            head.append(word)
        k += 1
    node.head = " ".join(head)
    node.prefix, node.name = declared(t.language, node.head, bool(whole), inside)
    return node


def declared(language: str, head: str, block: bool, inside: Node | None) -> tuple[str | None, str | None]:
    """The prefix and name of what a head declares, if anything."""
    if language in ("c", "cpp", "rust", "swift", "kotlin", "java", "c_sharp", "php", "dart", "python") and not block:
        return None, None
    for pattern, prefix in DECLARATIONS.get(language, []):
        if m := re.search(pattern, head):
            prefix = prefix.format(m.group(1))
            return ("" if language == "php" and prefix == "fn " and inside and inside.prefix in ("class ", "trait ", "interface ") else prefix), m.group(m.lastindex)
    if block and language in BARE and (m := _BARE.search(head)) and m.group(1) not in CONTROL:
        within = language in ("c", "cpp", "dart") or (inside is not None and inside.prefix is not None and inside.prefix not in ("", "fn ", "fn* "))
        if within and not any(w in CONTROL for w in head.split(" ")[:1]):
            return "", m.group(1).split(" ")[-1]
    return None, None


def _by_indent(t: Tokens, low: int, high: int) -> list[Node]:
    """Lines that begin at the least indentation of a range, each with the deeper lines after it."""
    lines, k = [], low  # (first token, token after the line, indentation)
    while k < high:
        if t.kind[k] == "nl":
            k += 1
            continue
        first, begin = k, t.text.rfind("\n", 0, t.start[k]) + 1
        while k < high and not (t.kind[k] == "nl" and t.text[t.end[k - 1] - 1] != "\\"):
            k = t.partner[k] + 1 if k in t.partner and t.partner[k] < high else k + 1
        lines.append((first, min(k, high), t.start[first] - begin))
    if not lines:
        return []
    least = min([i for f, _, i in lines if t.kind[f] != "comment"] or [lines[0][2]])
    out: list[Node] = []
    marks, fresh = None, True  # a decorator's first token; whether a deeper line begins a block
    for first, end, indent in lines:
        word, comment = t.word(first), t.kind[first] == "comment"
        body = out and not out[-1].comment and (indent > least)
        if comment and not body:
            out.append(Node(t.start[first], t.end[end - 1], True))
        elif body or (out and word in _GOES_ON and not out[-1].comment):
            out[-1].end, out[-1].last = t.end[end - 1], end
            if indent <= least:
                fresh = True
            elif fresh:
                out[-1].blocks.append((first, end))
                fresh = False
            else:
                out[-1].blocks[-1] = (out[-1].blocks[-1][0], end)
        else:
            fresh = True
            if marks is not None:
                first, marks = marks, None
            head = " ".join(t.word(j) for j in range(first, end) if t.kind[j] in ("word", "op"))
            if word == "@":
                marks = first
                out.append(Node(t.start[first], t.end[end - 1], first=first, last=end, head=head))
                continue
            if out and out[-1].first == first and out[-1].head.startswith("@"):
                out.pop()
            node = Node(t.start[first], t.end[end - 1], first=first, last=end, head=head)
            node.prefix, node.name = declared("python", head, True, None)
            out.append(node)
    return out
