"""One pass over a source of a brace language: what is code, where brackets close, how deep each line begins.

A stack holds the open brackets and template literals, so code in `${...}` is code, however it nests. Strings, comments,
regex literals and template texts are blanked in place.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

#: Characters at which str.splitlines() ends a line; they stay when text is blanked.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_VISIBLE = re.compile(f"[^{BREAKS}]")

_LINE, _BLOCK, _QUOTED = r"(?P<line>//[^\n]*)", r"(?P<block>/\*)", r'(?P<text>"(?:\\.|[^"\\\n])*+"?)'
_BRACKETS = r"(?P<open>[{(\[])|(?P<close>[})\]])|(?P<end>;)"
_SCRIPT = rf"{_LINE}|{_BLOCK}|{_QUOTED}|(?P<text2>'(?:\\.|[^'\\\n])*+')|(?P<tick>`)|(?P<slash>/)|{_BRACKETS}"
TOKENS = {
    "javascript": re.compile(_SCRIPT),
    "typescript": re.compile(_SCRIPT),
    "go": re.compile(rf"{_LINE}|{_BLOCK}|{_QUOTED}|(?P<text2>'(?:\\.[^'\n]*|[^'\\\n])')|(?P<raw>`[^`]*+`?)|{_BRACKETS}"),
    # a lifetime is a quote without its twin after one character; raw strings end with as many # as they begin with
    "rust": re.compile(rf"{_LINE}|{_BLOCK}|(?P<raw>\bb?r(?P<hashes>#*)\"(?s:.*?)(?:\"(?P=hashes)|\Z))|(?P<text>\"(?:\\(?s:.)|[^\"\\])*+\"?)|(?P<text2>'(?:\\(?:u\{{[0-9a-fA-F_]*\}}|x..|.)|[^'\\\n])')|{_BRACKETS}"),
    "java": re.compile(rf"{_LINE}|{_BLOCK}|(?P<raw>\"\"\"(?s:(?:\\.|[^\\])*?)(?:\"\"\"|\Z))|{_QUOTED}|(?P<text2>'(?:\\.[^'\n]*|[^'\\\n])')|{_BRACKETS}"),
}
_COMMENT_EDGE = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"(?:\\(?s:.)|[^`\\$]|\$(?!\{))*+")
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\[\n])++/[a-z]*")
#: What ends with one of these words may be followed by a regex literal.
_BEFORE_REGEX = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|yield|await)\s*\Z")
_PAIRS = {"}": "{", ")": "(", "]": "["}


@dataclass
class Scan:
    plain: str
    closes: dict[int, int] = field(default_factory=dict)  # place of a brace -> of the one that closes it
    marks: list[int] = field(default_factory=list)  # places of { and ;
    depth: list[int] = field(default_factory=list)  # brackets open before each mark
    at: list[int] = field(default_factory=lambda: [0])  # places from which on so many are open
    open: list[int] = field(default_factory=lambda: [0])

    def depth_at(self, place: int) -> int:
        """Brackets open before a place."""
        return self.open[bisect_right(self.at, place) - 1]

    def shallower(self) -> None:
        """For each mark the next one that is less deep."""
        self.after, held = [len(self.marks)] * len(self.marks), []
        for k, d in enumerate(self.depth):
            while held and self.depth[held[-1]] > d:
                self.after[held.pop()] = k
            held.append(k)

    def mark_from(self, place: int, depth: int) -> int | None:
        """The first { or ; from a place on that stands no deeper than depth."""
        k = bisect_left(self.marks, place)
        while k < len(self.marks) and self.depth[k] > depth:
            k = self.after[k]
        return self.marks[k] if k < len(self.marks) else None


def _block_end(source: str, start: int, nests: bool) -> int:
    level, place = 1, start + 2
    while level:
        m = _COMMENT_EDGE.search(source, place)
        if m is None:
            return len(source)
        if m[0] == "*/":
            level -= 1
        elif nests:
            level += 1
        place = m.end()
    return place


def scan(source: str, language: str) -> Scan:
    tokens, out = TOKENS[language], Scan("")
    blanks: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    place = code = 0  # code: where the last token ended

    def note(at: int) -> None:
        out.at.append(at)
        out.open.append(len(stack))

    def template(start: int) -> int:
        """Blanks template text from start on, up to and with its end or the next ${."""
        stop = _TEMPLATE.match(source, start).end()
        if source.startswith("${", stop):
            blanks.append((start, stop + 2))
            stack.append(("$", stop))
            note(stop + 2)
            return stop + 2
        blanks.append((start, min(stop + 1, len(source))))
        return stop + 1

    while (m := tokens.search(source, place)) is not None:
        kind, start, place = m.lastgroup, m.start(), m.end()
        if kind == "hashes":
            kind = "raw"
        if kind == "block":
            place = _block_end(source, start, language == "rust")
            blanks.append((start, place))
            continue
        if kind in ("line", "text", "text2", "raw"):
            blanks.append((start, place))
        elif kind == "tick":
            blanks.append((start, place))
            place = template(place)
        elif kind == "slash":
            before = source[max(code, start - 40) : start].rstrip() or source[max(0, start - 40) : start].rstrip()
            value = before[-1:].isalnum() or before[-1:] in set("_$)]}\"'`")
            found = _REGEX.match(source, start) if not value or _BEFORE_REGEX.search(before) else None
            if found:
                place = found.end()
                blanks.append((start, place))
        elif kind == "open":
            if m[0] == "{":
                out.marks.append(start)
                out.depth.append(len(stack))
            stack.append((m[0], start))
            note(place)
        elif kind == "end":
            out.marks.append(start)
            out.depth.append(len(stack))
        elif m[0] == "}":
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in "([":  # left open inside the braces
                k -= 1
            if k >= 0:
                opener, at = stack[k]
                del stack[k:]
                if opener == "$":
                    blanks.append((start, place))
                    note(start)
                    place = template(place)
                else:
                    out.closes[at] = start
                    note(start)
        elif stack and stack[-1][0] == _PAIRS[m[0]]:
            stack.pop()
            note(start)
        code = place
    pieces, done = [], 0
    for a, b in blanks:
        pieces += [source[done:a], _VISIBLE.sub(" ", source[a:b])]
        done = b
    out.plain = "".join([*pieces, source[done:]])
    out.shallower()
    return out
