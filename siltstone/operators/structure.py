"""Source structure without an outside parser: Python outlines by the standard library, brace languages by a scan.

Both run in Arrow batches; what is listed and how it is cut is decided by native expressions over the parsed columns.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X

from . import lexer as L

OUTLINE = pa.struct([("docstring", pa.string()), ("classes", pa.list_(pa.struct([("name", pa.string()), ("methods", pa.list_(pa.string()))]))), ("functions", pa.list_(pa.string())), ("constants", pa.list_(pa.string())), ("imports", pa.list_(pa.string()))])


def outline(source: str) -> dict | None:
    """Top-level names of a module; null if it can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    named = [t.id for n in tree.body if isinstance(n, ast.Assign | ast.AnnAssign) for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Name)]
    imports = [name for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom) for name in ([a.name for a in n.names] if isinstance(n, ast.Import) else [n.module]) if name]
    classes = {n.name: [m.name for m in n.body if isinstance(m, kinds) and not m.name.startswith("_")] for n in tree.body if isinstance(n, ast.ClassDef)}
    return {"docstring": ast.get_docstring(tree) or "", "classes": [{"name": k, "methods": v} for k, v in classes.items()], "functions": [n.name for n in tree.body if isinstance(n, kinds)], "constants": [x for x in named if x.isupper()], "imports": imports}


def outlines(docs: DataFrame) -> DataFrame:
    """docs (path, content) of Python files -> path, o (null for a file that can't be parsed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([outline(t or "") for t in b.column(1).to_pylist()], OUTLINE)], ["path", "o"])

    return docs.select("path", "content").mapInArrow(run, "path string, o struct<docstring string, classes array<struct<name string, methods array<string>>>, functions array<string>, constants array<string>, imports array<string>>")


def python_cards(docs: DataFrame, listed: int = 25, imports: int = 20, members: int = 8, purpose: int = 300) -> DataFrame:
    """path, text: one card per parsed file that defines, imports or documents something."""
    rows = outlines(docs).where(F.col("o").isNotNull()).select("path", "o.*").withColumn("docstring", F.substring(X.collapse(F.col("docstring")), 1, purpose))
    rows = rows.where((F.size("classes") > 0) | (F.size("functions") > 0) | (F.size("imports") > 0) | (F.col("docstring") != ""))
    package = F.when(X.parent(F.col("path")) == ".", "(root)").otherwise(X.parent(F.col("path")))
    shown = F.transform(F.slice("classes", 1, listed), lambda c: F.when(F.size(c["methods"]) > 0, F.concat(c["name"], F.lit(" (methods: "), F.array_join(F.slice(c["methods"], 1, members), ", "), F.lit(")"))).otherwise(c["name"]))
    line = lambda head, items, mark: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, mark), F.lit(".")))
    card = F.concat_ws(
        "\n",
        F.concat("path", F.lit(" — Python module in package "), package, F.lit(".")),
        F.when(F.col("docstring") != "", F.concat(F.lit("Purpose: "), "docstring")),
        line("Defines classes: ", shown, "; "),
        line("Defines functions: ", F.slice("functions", 1, listed), ", "),
        line("Defines constants: ", F.slice(F.array_distinct("constants"), 1, listed), ", "),
        line("Depends on: ", F.slice(F.array_distinct("imports"), 1, imports), ", "),
    )
    return rows.select("path", card.alias("text"))


_ARGS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_NAMED = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_BOUND = rf"(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]{{0,400}})?=\s*(?:async\s*)?(?:function\b|(?:<[^<>]{{0,200}}>\s*)?(?:{_ARGS}|[\w$]+)\s*(?::[^=;{{}}]{{0,200}})?=>)"
_JAVA = r"(?:@[\w.]+(?:\([^()]{0,400}\))?\s+){0,20}(?:(?:public|private|protected|static|final|abstract|sealed|default|synchronized|native)\s+){0,8}"
#: How declarations of brace languages begin, by language.
STARTS = {
    "javascript": [("class_skeleton", rf"{_NAMED}class\s+([\w$]+)"), ("function", rf"{_NAMED}(?:async\s+)?function\s*\*?\s*([\w$]+)"), ("bound", _BOUND), ("method", rf"(?:static\s+|async\s+|get\s+|set\s+|\*\s*){{0,6}}([#\w$]+)\s*{_ARGS}\s*(?=\{{)")],
    "typescript": [
        ("class_skeleton", rf"{_NAMED}(?:abstract\s+)?(?:class|interface|(?:const\s+)?enum)\s+([\w$]+)"), ("function", rf"{_NAMED}(?:async\s+)?function\s*\*?\s*([\w$]+)"), ("bound", _BOUND),
        ("method", rf"(?:public\s+|private\s+|protected\s+|static\s+|async\s+|abstract\s+|override\s+|readonly\s+|get\s+|set\s+|\*\s*){{0,8}}([#\w$]+)\??\s*(?:<[^<>]{{0,200}}>\s*)?{_ARGS}\s*(?::[^;=]{{0,400}}?)?(?=\{{|;)"),
    ],
    "go": [("class_skeleton", r"type\s+(\w+)(?:\[[^\[\]]*\])?\s+(?:struct|interface)\b"), ("function", r"func\s+(?:\([^()]*\)\s*)?(\w+)\s*[\[(]")],
    "rust": [
        ("class_skeleton", r"(?:pub(?:\([^()]*\))?\s+)?(?:unsafe\s+)?(?:struct|enum|trait|mod)\s+(\w+)"), ("class_skeleton", r"(?:unsafe\s+)?impl\b(?:\s*<[^{;]{0,200}?>)?\s+(?:[^{;]{0,200}?\bfor\s+)?(?:&\s*)?(?:[\w]+::)*(\w+)"),
        ("function", r"(?:pub(?:\([^()]*\))?\s+)?(?:(?:async|const|unsafe|default|extern(?:\s+\"[^\"\n]{0,80}\")?)\s+){0,6}fn\s+(\w+)"),
    ],
    "java": [("class_skeleton", rf"{_JAVA}(?:class|@?interface|enum|record)\s+(\w+)"), ("method", rf"{_JAVA}(?:<[^;{{}}()]{{0,200}}>\s*)?(?:[\w.<>\[\],?&]{{1,200}}\s+){{0,8}}?(\w+)\s*{_ARGS}\s*(?:throws\s+[\w.,\s]{{1,300}})?(?=\{{|;)")],
}
COMPILED = {g: [(k, re.compile(r"[ \t]*" + p)) for k, p in rules] for g, rules in STARTS.items()}
KEYWORDS = frozenset("if for while switch catch return else do try new throw match loop super this assert".split())
_BRACED = re.compile(r"\s*\{")
_UNDONE = re.compile(r"(?:=>|[-+*/%&|=<>^?:,.(\[{])\Z")
_CONTINUES = re.compile(r"\s*(?:[.?:+*/&|,)=<>%^\]}-]|instanceof\b|in\b)")


def _body_end(found: L.Scan, language: str, start: int, after: int, kind: str) -> int:
    """Place of the end of a declaration that begins at start and whose rule matched up to `after`: the brace that closes
    its body, else its statement's end, else the text's."""
    last, depth = len(found.plain) - 1, found.depth_at(start)
    place = after
    while (mark := found.mark_from(place, depth)) is not None:
        if found.plain[mark] == ";":
            return mark
        close = found.closes.get(mark)
        if close is None:
            return last
        before = found.plain[max(start, mark - 200) : mark].rstrip()
        of_type = kind != "class_skeleton" and (language == "go" and re.search(r"\b(?:interface|struct)\Z", before) or language == "typescript" and re.search(r"\)\s*:\Z|[|&]\Z", before))
        if not of_type:
            return close
        place = close + 1
    return last


def brace_units(source: str, language: str) -> list[tuple]:
    """(kind, symbol, parent, first line, last line, text, header, restated lines, last line of the container or None): containers
    with their members' first lines, functions in them or at the top, and module runs. Time in proportion to the text."""
    rules, found = COMPILED[language], L.scan(source, language)
    plain, lines = found.plain, source.splitlines()
    begins = list(accumulate(map(len, plain.splitlines(keepends=True)), initial=0))
    depths = [found.depth_at(p) for p in begins[:-1]]
    bare = [plain[a:z].strip() for a, z in pairwise(begins)]
    line_of = lambda p: min(bisect_right(begins, p), len(lines))
    stack, out, members = [], [], []  # stack: (place in out, name, last line, declaration, depth of its members)
    cover = [0] * (len(lines) + 2)

    def expression_end(k: int, depth: int) -> int:
        """Last line of an expression on line k: the first that ends no deeper, unless the next one goes on."""
        while k < len(lines) - 1 and (depths[k + 1] > depth or _UNDONE.search(bare[k]) or _CONTINUES.match(bare[k + 1])):
            k += 1
        return k + 1

    k = 0
    while k < len(lines):
        while stack and k + 1 > stack[-1][2]:
            stack.pop()
        own = stack[-1] if stack else None
        if not bare[k] or depths[k] != (own[4] if own else 0):
            k += 1
            continue
        for kind, rule in rules:
            m = rule.match(plain, begins[k])
            if not m or m[1] in KEYWORDS or (kind == "method" and own is None) or (kind == "bound" and own is not None):
                continue
            if kind == "bound" and m[0].endswith("=>") and not _BRACED.match(plain, m.end()):
                last = expression_end(k, depths[k])
            else:
                last = line_of(_body_end(found, language, begins[k], m.end(), kind))
            first = lines[k].strip()
            if kind == "class_skeleton":
                stack.append((len(out), m[1], last, first, depths[k] + 1))
                members.append([first])
                out.append([kind, m[1], own[1] if own else None, k + 1, k + 1, len(members) - 1, first, 0, last])
            else:
                body = "\n".join(lines[k:last])
                if own:
                    members[out[own[0]][5]].append(f"    {first}")
                out.append(["function", m[1], own[1] if own else None, k + 1, last, f"{own[3]}\n{body}" if own else body, first, int(bool(own)), None])
            cover[k + 1] += 1
            cover[last + 1] -= 1
            k = k if kind == "class_skeleton" else last - 1
            break
        k += 1
    for u in out:
        if u[0] == "class_skeleton":
            u[5] = "\n".join(members[u[5]])
    covered, run = list(accumulate(cover)), []
    for n in range(1, len(lines) + 2):
        if n > len(lines) or covered[n]:
            if run:
                out.append(["module", None, None, run[0], run[-1], "\n".join(lines[run[0] - 1 : run[-1]]), "// module level", 0, None])
            run = []
        elif lines[n - 1].strip():
            run.append(n)
    return sorted(map(tuple, out), key=lambda u: (u[3], u[4]))
