"""Symbols and references from source code: a parser for Python, a scanner of keywords and braces for the other languages.

One pass makes tagged rows; symbols and references are filters of it. The scanner is a heuristic: it knows definitions
that begin a line, and matches braces (Ruby: end) for where they stop. Unparsable Python falls back to the scanner.
"""

from __future__ import annotations

import ast
import gc
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import shared

SYMBOLS = "doc_id long, sym_idx int, name string, kind string, line_start int, line_end int, container string, signature string"
REFS = "doc_id long, name string, kind string, line int, column int"
_ROWS = "doc_id long, tag string, sym_idx int, name string, kind string, line_start int, line_end int, column int, container string, signature string"

_MOD = r"(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|export|default|override|sealed|partial|open|unsafe|const|virtual|inline|extern|mutating|readonly|declare|func)\s+)*"
_JS = [("function", rf"{_MOD}function\s*\*?\s*(\w+)"), ("class", rf"{_MOD}class\s+(\w+)"), ("function", rf"{_MOD}(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>)"), ("function", r"[\w.]+\.(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>)"), ("interface", rf"{_MOD}interface\s+(\w+)"), ("enum", rf"{_MOD}enum\s+(\w+)"), ("type", rf"{_MOD}type\s+(\w+)\s*="), ("method", r"(?:(?:async|static|get|set|public|private|protected)\s+)*(\w+)\s*\([^;]*\)\s*(?::[^={]+)?\{")]
_CLASSY = [("class", rf"{_MOD}class\s+(\w+)"), ("interface", rf"{_MOD}interface\s+(\w+)"), ("enum", rf"{_MOD}enum\s+(?:class\s+)?(\w+)"), ("struct", rf"{_MOD}struct\s+(\w+)"), ("record", rf"{_MOD}record\s+(\w+)")]
_CALLABLE = [("method", rf"{_MOD}(?:[\w<>\[\],.?*&:]+\s+)+[*&]?(?:\w+::)*(~?\w+)\s*\([^;]*\)\s*(?:const\s*|noexcept\s*|throws\s+[\w., ]+|override\s*)*\{{?\s*$")]
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", rf"{_MOD}fn\s+(\w+)"), ("struct", rf"{_MOD}struct\s+(\w+)"), ("enum", rf"{_MOD}enum\s+(\w+)"), ("trait", rf"{_MOD}trait\s+(\w+)"), ("impl", r"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"), ("module", rf"{_MOD}mod\s+(\w+)"), ("macro", r"macro_rules!\s*(\w+)"), ("type", rf"{_MOD}type\s+(\w+)"), ("const", rf"{_MOD}(?:const|static)\s+(\w+)\s*:")],
    "go": [("method", r"func\s+\([^)]*\)\s*(\w+)"), ("function", r"func\s+(\w+)"), ("struct", r"type\s+(\w+)\s+struct"), ("interface", r"type\s+(\w+)\s+interface"), ("type", r"type\s+(\w+)\s")],
    "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "java": _CLASSY + _CALLABLE, "csharp": _CLASSY + [("module", r"namespace\s+([\w.]+)")] + _CALLABLE, "cpp": _CLASSY + [("module", r"namespace\s+(\w+)")] + _CALLABLE, "c": _CLASSY + [("function", _CALLABLE[0][1])],
    "ruby": [("class", r"class\s+(\w+)"), ("module", r"module\s+(\w+)"), ("method", r"def\s+(?:self\.)?([\w?!]+)")],
    "php": _CLASSY + [("trait", r"trait\s+(\w+)"), ("function", rf"{_MOD}function\s+&?(\w+)")],
    "swift": [("function", rf"{_MOD}func\s+(\w+)"), ("protocol", rf"{_MOD}protocol\s+(\w+)"), ("extension", rf"{_MOD}extension\s+(\w+)"), *_CLASSY],
    "dart": [*_CLASSY, ("mixin", r"mixin\s+(\w+)"), ("extension", r"extension\s+(\w+)"), ("function", r"(?:[\w<>?,]+\s+)+(\w+)\s*\([^;]*\)\s*(?:async\s*)?(?:\{|=>)")],
}
_COMPILED = {k: [(kind, re.compile(r"\s*" + p)) for kind, p in v] for k, v in PATTERNS.items()}
_HOLDERS = ("class", "struct", "interface", "trait", "impl", "enum", "module", "record", "protocol", "extension", "mixin")
_KEYWORDS = frozenset("if for while switch catch return sizeof match loop function fn func def class new await else elif except with in not and or lambda assert print_ super this self import from typeof instanceof throw do try case yield".split())
_CALL = re.compile(r"([A-Za-z_]\w*)\s*!?\s*\(")
_IMPORT = {
    "rust": r"\s*(?:pub\s+)?use\s+(.+)", "go": r'\s*import\s+(?:\w+\s+)?"(.+)"', "javascript": r"\s*import\s+(.+?)\s+from\b.*", "java": r"\s*import\s+(?:static\s+)?(.+);", "csharp": r"\s*using\s+([\w.]+);",
    "php": r"\s*use\s+(.+);", "swift": r"\s*import\s+(.+)",
}
_IMPORT |= {"typescript": _IMPORT["javascript"], "tsx": _IMPORT["javascript"]}


def _signature(line: str) -> str:
    t = line.strip().removesuffix("{").rstrip()
    return t.encode()[:200].decode(errors="ignore")


def _bytes(line: str, col: int) -> int:
    return len(line[:col].encode()) + 1


def python_rows(text: str) -> Iterator[tuple]:
    """(tag, name, kind, first line, last line, column, container, signature) of Python source; SyntaxError if it isn't."""
    tree, lines = ast.parse(text), text.split("\n")

    def visit(node: ast.AST, holder: str | None, in_class: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            inner, cls = holder, in_class
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                yield "symbol", child.name, kind, child.lineno, child.end_lineno, 0, holder, _signature(lines[child.lineno - 1])
                inner, cls = (child.name, True) if is_class else (holder, False)
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    yield "ref", f.id, "call", f.lineno, 0, f.col_offset + 1, None, None
                elif isinstance(f, ast.Attribute):
                    yield "ref", f.attr, "call", f.end_lineno, 0, f.end_col_offset - len(f.attr.encode()) + 1, None, None
            elif isinstance(child, ast.Import | ast.ImportFrom):
                for a in child.names:
                    for part in [*a.name.split("."), *([a.asname] if a.asname else [])]:
                        if part != "*":
                            yield "ref", part, "import", a.lineno, 0, a.col_offset + 1, None, None
                if isinstance(child, ast.ImportFrom) and child.module:
                    for part in child.module.split("."):
                        yield "ref", part, "import", child.lineno, 0, child.col_offset + 1, None, None
            yield from visit(child, inner, cls)

    yield from visit(tree, None, False)


def _end(lines: list[str], i: int, lang: str) -> int:
    """Index of the line that ends the definition on line i."""
    if lang == "ruby":
        indent = len(lines[i]) - len(lines[i].lstrip())
        for j in range(i + 1, len(lines)):
            if re.match(rf"\s{{0,{indent}}}end\b", lines[j]):
                return j
        return len(lines) - 1
    if lang == "python":
        indent, last = len(lines[i]) - len(lines[i].lstrip()), i
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
                last = j
        return last
    depth, seen = 0, False
    for j in range(i, len(lines)):
        for c in re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\'|//.*', "", lines[j]):
            depth += (c == "{") - (c == "}")
            seen = seen or c == "{"
        if seen and depth <= 0:
            return j
        if not seen and (lines[j].rstrip().endswith(";") or j > i + 8):
            return i if j > i + 8 else j
    return len(lines) - 1 if seen else i


def scan_rows(text: str, lang: str) -> Iterator[tuple]:
    lines = text.split("\n")
    patterns = _COMPILED.get(lang, [("class", re.compile(r"\s*class\s+(\w+)")), ("function", re.compile(r"\s*(?:async\s+)?def\s+(\w+)"))] if lang == "python" else [])
    holders: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        while holders and holders[-1][0] < i:
            holders.pop()
        own = None
        if not line.lstrip().startswith(("//", "#", "*", "/*")):
            for kind, p in patterns:
                m = p.match(line)
                if m and m[1] not in _KEYWORDS:
                    end, own = _end(lines, i, lang), m[1]
                    shown = "method" if kind == "function" and holders and lang in ("rust", "php", "swift", "dart", "python") else kind
                    yield "symbol", m[1], shown, i + 1, end + 1, 0, holders[-1][1] if holders else None, _signature(line)
                    if kind in _HOLDERS and end > i:
                        holders.append((end, m[1]))
                    break
        if (p := _IMPORT.get(lang)) and (m := re.match(p, line)):
            for w in re.finditer(r"[A-Za-z_]\w*", m[1]):
                yield "ref", w[0], "import", i + 1, 0, _bytes(line, m.start(1) + w.start()), None, None
            continue
        for m in _CALL.finditer(line):
            if m[1] not in _KEYWORDS and m[1] != own:
                yield "ref", m[1], "call", i + 1, 0, _bytes(line, m.start(1)), None, None


def rows_of(text: str, lang: str) -> list[tuple]:
    if lang == "python":
        try:
            return list(python_rows(text))
        except (SyntaxError, ValueError, RecursionError):
            pass
    return list(scan_rows(text, lang)) if lang in _COMPILED or lang == "python" else []


def _tagged(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [x.split()[0] for x in _ROWS.split(", ")]
        for pdf in batches:
            out = []
            for doc_id, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True):
                n = 0
                for tag, name, kind, a, b, col, holder, sig in rows_of(text or "", lang):
                    if not name or len(name.encode()) > 256:
                        continue
                    out.append((doc_id, tag, n if tag == "symbol" else 0, name, kind, a, b, col, holder, sig))
                    n += tag == "symbol"
            yield pd.DataFrame(out, columns=cols)

    return docs.select("doc_id", "lang", "text").mapInPandas(run, _ROWS)


def extract(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, refs) of documents."""
    t = _tagged(docs)
    names = lambda s: [x.split()[0] for x in s.split(", ")]
    return t.where("tag = 'symbol'").select(*names(SYMBOLS)), t.where("tag = 'ref'").withColumnRenamed("line_start", "line").select(*names(REFS))


# structure


def _meta(pattern: str) -> tuple[ast.AST, list[str]]:
    """Pattern source with $NAME and $$$ as a tree."""
    source = re.sub(r"\$\$\$", "__any__", pattern.strip())
    source = re.sub(r"\$(\w+)", r"__meta_\1", source)
    source = re.sub(r"\{\s*(.*?)\s*\}\s*$", r"\1", source) if source.endswith("}") and not source.startswith("{") else source
    if source.rstrip().endswith(":"):
        source = source.rstrip() + " __any__"
    tree = ast.parse(source)
    node = tree.body[0]
    return node.value if isinstance(node, ast.Expr) else node, re.findall(r"\$(\w+)", pattern)


def _is_any(x) -> bool:
    return (isinstance(x, ast.Name) and x.id == "__any__") or (isinstance(x, ast.Expr) and _is_any(x.value)) or (isinstance(x, ast.arg) and x.arg == "__any__")


def _matcher(p) -> Callable[[object, dict], bool]:
    """Whether a node fits a part of the pattern, as a function of the node and what is bound so far."""
    if isinstance(p, ast.Expr) and isinstance(p.value, ast.Name) and p.value.id.startswith("__meta_"):
        p = p.value
    if isinstance(p, ast.Name) and p.id.startswith("__meta_"):
        return partial(_bind, p.id[7:])
    if isinstance(p, str) and p.startswith("__meta_"):
        return partial(_bind, p[7:])
    if isinstance(p, list):
        return _list_matcher(p)
    if isinstance(p, ast.AST):
        kind, fields = type(p), [(f, _matcher(getattr(p, f, None))) for f in p._fields if f not in ("ctx", "type_comment", "type_params")]

        def node(n, found: dict) -> bool:
            if type(n) is not kind:
                return False
            for f, fits in fields:
                if not fits(getattr(n, f, None), found):
                    return False
            return True

        return node
    return lambda n, found: p == n


def _list_matcher(p: list) -> Callable[[object, dict], bool]:
    if not p:
        return lambda n, found: isinstance(n, list) and not n
    if _is_any(p[0]):
        if len(p) == 1:
            return lambda n, found: isinstance(n, list)
        rest = _list_matcher(p[1:])
        return lambda n, found: isinstance(n, list) and any(rest(n[k:], found) for k in range(len(n) + 1))
    first, rest = _matcher(p[0]), _list_matcher(p[1:])
    return lambda n, found: isinstance(n, list) and bool(n) and first(n[0], found) and rest(n[1:], found)


def _bind(name: str, n, found: dict) -> bool:
    text = n if isinstance(n, str) else ast.unparse(n) if isinstance(n, ast.AST) else None
    return text is not None and found.setdefault(name, (text, getattr(n, "lineno", 0)))[0] == text


@lru_cache(64)
def _compiled(pattern: str) -> tuple[type | None, Callable[[object, dict], bool]]:
    """(type of the nodes that can fit, None for any; the test)."""
    want, _ = _meta(pattern)
    return None if isinstance(want, ast.Name) and want.id.startswith("__meta_") else type(want), _matcher(want)


#: Fields of a node that hold statements, in order; nothing else does.
_BLOCKS = {t: fs for t in vars(ast).values() if isinstance(t, type) and issubclass(t, ast.Module | ast.stmt | ast.excepthandler | ast.match_case) and (fs := [f for f in t._fields if f in ("body", "handlers", "orelse", "finalbody", "cases")])}


def _statements(tree: ast.AST) -> Iterator[ast.AST]:
    """The statements of a tree in the order of ast.walk; no expression is visited."""
    todo = [tree]
    for node in todo:
        for f in _BLOCKS.get(type(node), ()):
            todo += getattr(node, f)
    return iter(todo)


def match_python(pattern: str, text: str) -> list[tuple[int, int, str, str, list[tuple[str, str, int]]]]:
    """(first line, last line, kind, text, captures) of every node of Python source that fits the pattern."""
    kind, fits = _compiled(pattern)
    raw, out = text.encode(), []
    at = [0, *accumulate(map(len, raw.splitlines(keepends=True)))]
    tree = ast.parse(text)
    for node in _statements(tree) if kind and issubclass(kind, ast.stmt) else ast.walk(tree):
        if type(node) is not kind if kind else not isinstance(node, ast.stmt | ast.expr):
            continue
        found: dict = {}
        if fits(node, found):
            out.append((node.lineno, node.end_lineno, type(node).__name__, raw[at[node.lineno - 1] + node.col_offset : at[node.end_lineno - 1] + node.end_col_offset].decode(), [(k, v[0], v[1] or node.lineno) for k, v in sorted(found.items())]))
    return sorted(out, key=lambda x: x[:3])


def match_text(pattern: str, text: str) -> list[tuple[int, int, str, str, list[tuple[str, str, int]]]]:
    """As match_python for other languages: $NAME is an identifier, $$$ anything, blanks are loose; braces bound bodies."""
    parts, names = "", []
    for tok in re.findall(r"\$\$\$|\$\w+|\w+|\s+|[^\w\s$]|\$", pattern.strip()):
        if tok == "$$$":
            parts += r"[\s\S]*?"
        elif tok[0] == "$" and len(tok) > 1:
            parts += f"(?P={tok[1:]})" if tok[1:] in names else rf"(?P<{tok[1:]}>\w+)"
            names += [tok[1:]]
        elif tok.isspace():
            parts += r"\s+"
        else:
            parts += r"\s*" * (not tok[0].isalnum() and tok[0] != "_") + re.escape(tok) + r"\s*" * (not tok[0].isalnum() and tok[0] != "_")
    out = []
    for m in re.finditer(parts.replace(r"\s*\s+", r"\s*").replace(r"\s+\s*", r"\s*").replace(r"\{\s*\s*\}", r"\{[\s\S]*?\}"), text):
        a = text.count("\n", 0, m.start()) + 1
        out.append((a, a + m[0].strip().count("\n"), "text", m[0].strip(), [(n, m[n], text.count("\n", 0, m.start(n)) + 1) for n in sorted(set(names))]))
    return out


#: Bytes of texts, and rows of matches, that are held at a time.
_PARSED, _ROWS_OUT = 1 << 20, 4096
STRUCT = "path string, line_start int, line_end int, kind string, text string, captures array<struct<name:string,text:string,line:int>>"


def structural(docs: DataFrame, pattern: str, lang: str, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Places of one language where the pattern's shape stands; all of them for limit None. The longest word of the pattern filters texts in the scan."""
    if pattern.strip().startswith("("):
        raise ValueError("raw tree queries need a tree parser that isn't installed; give a $NAME pattern")
    anchors = sorted(re.findall(r"(?<![\w$])[A-Za-z_]\w{2,}", pattern), key=len)
    d = docs.where(F.col("lang") == lang)
    if anchors:
        d = d.where(F.col("text").contains(anchors[-1]))

    if limit is None and not offset:  # texts are put in order before they are parsed: matches are many more, and sorting them would parse twice
        sc = docs.sparkSession.sparkContext
        d = d.select("path", "text").repartitionByRange(max(4 * sc.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").sortWithinPartitions("path")

    kinds = {"path": pa.string(), "line_start": pa.int32(), "line_end": pa.int32(), "kind": pa.string(), "text": pa.string(), "captures": pa.list_(pa.struct([("name", pa.string()), ("text", pa.string()), ("line", pa.int32())]))}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        *cols, captures = zip(*rows, strict=True)
        flat = list(zip(*chain.from_iterable(captures), strict=True)) or [(), (), ()]
        each = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, kinds["captures"].value_type, strict=True)], fields=list(kinds["captures"].value_type))
        held = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, captures))], pa.int32()), each)
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, list(kinds.values())[:-1], strict=True)), held], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()  # trees have no cycles, and looking for some takes longer than parsing
        try:
            rows: list[tuple] = []
            for b in shared.pieces(batches, "text", _PARSED):
                for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                    try:
                        found = match_python(pattern, text) if lang == "python" else match_text(pattern, text)
                    except (SyntaxError, ValueError, RecursionError):
                        found = []
                    for i in range(0, len(found), _ROWS_OUT):
                        rows += [(path, *x) for x in found[i : i + _ROWS_OUT]]
                        if len(rows) >= _ROWS_OUT:
                            yield batch_of(rows)
                            rows = []
            if rows:
                yield batch_of(rows)
        finally:
            if was:
                gc.enable()

    rows = shared.map_arrow(d.select("path", "text"), run, STRUCT).withColumn("lang", F.lit(lang))
    if limit is not None or offset:
        rows = rows.orderBy("path", "line_start", "line_end").offset(offset)
        rows = rows if limit is None else rows.limit(limit)
    return rows.select("path", "lang", "line_start", "line_end", "kind", "text", "captures")


def identifier_at(text: str, lang: str, line: int, column: int) -> tuple[str, bool, bool, bool, bool] | None:
    """(name, is_call, is_member, is_type, is_import) of the identifier at a line and byte column, or None."""
    lines = text.split("\n")
    if not 1 <= line <= len(lines):
        return None
    raw = lines[line - 1]
    at = len(raw.encode()[: max(column - 1, 0)].decode(errors="ignore"))
    for m in re.finditer(r"[^\W\d]\w*", raw):
        if m.start() <= at < m.end() or (at == m.end() and at == len(raw)):
            before, after = raw[: m.start()].rstrip(), raw[m.end() :].lstrip()
            is_import = bool(re.match(r"\s*(?:import|from|use|using|#include|require)\b", raw))
            is_call = after.startswith("(") or (lang == "rust" and after.startswith("!("))
            is_type = bool(re.search(r"(?::|->|\bnew|\bextends|\bimplements|\bas)$", before)) and not before.endswith("::") and not is_call or before.endswith("new")
            return m[0], is_call, before.endswith((".", "->", "?.")), is_type, is_import
    return None
