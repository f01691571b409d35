"""Chunking of files into symbols, sections and blocks, as Arrow-batched table functions."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from engrama.functions.text import MAX_CHUNK_TOKENS

CHUNK_SCHEMA = "project_uuid string, source_file string, file_hash string, category string, chunk_type string, chunk_index int, start_line int, end_line int, symbol_name string, content string, estimated_tokens int, calls array<string>, error string"
COLUMNS = [x.strip().split()[0] for x in CHUNK_SCHEMA.split(", ")]
MARKDOWN = {"md", "mdx", "rst", "adoc", "txt"}
SCRIPT = {"js", "ts", "tsx", "jsx", "mjs", "cjs"}
CONFIG = {"json", "yaml", "yml", "toml", "env", "ini", "cfg", "xml"}
BRACED = {
    "go": re.compile(r"^(?:func\s+(?:\(\s*\w+\s+\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<f>\w+)|type\s+(?P<c>\w+)\s+(?:struct|interface))", re.M),
    "rs": re.compile(r"^(?P<in>[ \t]*)(?:pub(?:\([^)]*\))?\s+)?(?:(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<f>\w+)|(?:struct|enum|trait|union)\s+(?P<c>\w+))", re.M),
    "java": re.compile(r"^(?P<in>[ \t]*)(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:(?:class|interface|enum|record)\s+(?P<c>\w+)|[\w<>\[\], ?]+\s+(?P<f>\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w, ]+)?(?=\{))", re.M),
    "c": re.compile(r"^(?:(?:struct|enum|union)\s+(?P<c>\w+)\s*(?=\{)|(?:[\w*]+[ \t*]+)+(?P<f>\w+)\s*\([^;{}]*\)\s*(?=\{))", re.M),
}
BRACED |= {"h": BRACED["c"], "cpp": BRACED["c"], "hpp": BRACED["c"], "cs": BRACED["java"], "kt": BRACED["java"]}
CALL = re.compile(r"\b([A-Za-z_][\w.]*)\s*\(")
DECLARED = re.compile(r"^(?:export\s+(?:default\s+)?)?(?:(class)\s+(\w+)|(?:async\s+)?function\s*\*?\s*(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>)", re.M)
QUOTED_OR_REMARK = re.compile(r"""//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`""", re.S)
#: Single quotes hold strings in scripts, but one character elsewhere, where they also begin names.
SCRIPT_QUOTED = re.compile(r"'(?:\\.|[^'\\\n])*'|" + QUOTED_OR_REMARK.pattern, re.S)
BRACE = re.compile(r"[{}]")
#: Words before a parenthesis that call nothing.
NO_CALLS = {"if", "for", "while", "switch", "return", "func", "function", "match", "catch", "typeof", "await", "new", "super", "constructor"}


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def split_block(text: str, base: str, first_line: int, max_tokens: int = MAX_CHUNK_TOKENS) -> list[tuple[int, int, str, str]]:
    """(start line, end line, name, content) of blocks that end once they reach the limit."""
    out: list[tuple[int, int, str, str]] = []
    lines, size, start = [], 0, first_line
    for i, line in enumerate(text.splitlines(keepends=True)):
        lines.append(line)
        size += len(line)
        if size >= 4 * max_tokens:
            out.append((start, first_line + i, f"{base}[{len(out)}]", "".join(lines).rstrip()))
            lines, size, start = [], 0, first_line + i + 1
    rest = "".join(lines).rstrip()
    if rest.strip():
        out.append((start, start + len(lines) - 1, f"{base}[{len(out)}]" if out else base, rest))
    return out


def sized(kind: str, name: str, start: int, end: int, text: str, calls: list[str], max_tokens: int) -> list[tuple]:
    if estimate(text) <= max_tokens:
        return [(kind, name, start, end, text, calls)]
    return [(kind, n, a, b, t, calls) for a, b, n, t in split_block(text, name, start, max_tokens)]


def python_chunks(text: str, max_tokens: int) -> list[tuple] | None:
    """Functions, classes and their methods, then what is left as the module; None if it can't be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = text.splitlines()
    out: list[tuple] = []
    covered: set[int] = set()

    def source(node: ast.AST) -> tuple[int, int, str]:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        return first, node.end_lineno, "\n".join(lines[first - 1 : node.end_lineno])

    def called(node: ast.AST) -> list[str]:
        names: dict[str, None] = {}
        todo = list(ast.iter_child_nodes(node))
        while todo:
            n = todo.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(n, ast.Call):
                name = ast.unparse(n.func)
                if re.fullmatch(r"[\w.]+", name):
                    names[name] = None
            todo.extend(ast.iter_child_nodes(n))
        return sorted(names)

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a, b, body = source(node)
            covered.update(range(a, b + 1))
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out += sized(kind, node.name, a, b, body, called(node), max_tokens)
            for m in node.body if kind == "class" else ():
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    x, y, part = source(m)
                    out += sized("method", f"{node.name}.{m.name}", x, y, part, called(m), max_tokens)
    rest = "\n".join(x for i, x in enumerate(lines, 1) if i not in covered).strip()
    if rest:
        out.append(("module", "<module>", 1, len(lines), rest, called(ast.Module([n for n in tree.body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], []))))
    return out


def script_chunks(text: str, max_tokens: int) -> list[tuple] | None:
    """Top-level classes, functions and arrow functions up to the closing brace; imports as the module."""
    found = list(DECLARED.finditer(text))
    if not found:
        return None
    out: list[tuple] = []
    head = text[: found[0].start()].strip()
    code = masked(text, SCRIPT_QUOTED)
    ends = brace_ends(code)
    for m in found:
        opened, stop = code.find("{", m.start()), code.find(";", m.end())
        if stop >= 0 and (opened < 0 or stop < opened):
            end = stop + 1
        else:
            end = ends.get(opened, len(text))
        start_line = text.count("\n", 0, m.start()) + 1
        body = text[m.start() : end]
        calls = [] if m[1] else called_names(code[m.end() : end])
        out += sized("class" if m[1] else "function", m[2] or m[3] or m[4], start_line, start_line + body.count("\n"), body, calls, max_tokens)
    if head:
        out.append(("module", "<module>", 1, head.count("\n") + 1, head, []))
    return out


def masked(text: str, marks: re.Pattern = QUOTED_OR_REMARK) -> str:
    """The text with strings and comments blanked, so that braces and calls in them don't count."""
    return marks.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def brace_ends(code: str) -> dict[int, int]:
    """Of every opening brace that is closed: the place behind its closing one."""
    out, held = {}, []
    for m in BRACE.finditer(code):
        if m[0] == "{":
            held.append(m.start())
        elif held:
            out[held.pop()] = m.end()
    return out


def called_names(code: str) -> list[str]:
    return sorted({c for c in CALL.findall(code) if c not in NO_CALLS})


def closing(text: str, ends: dict[int, int], after: int) -> int:
    """Where a declaration ends: behind its closing brace, or its line if it has none."""
    opened = text.find("{", after)
    line = text.find("\n", after)
    line = len(text) if line < 0 else line
    stop = text.find(";", after, line)
    if opened < 0 or (opened > line and text[after:opened].strip()) or (0 <= stop < opened):
        return line
    return ends.get(opened, len(text))


def braced_chunks(text: str, pattern: re.Pattern, max_tokens: int) -> list[tuple] | None:
    """Types and functions of a language with braces, then what is outside of them as the module."""
    found = list(pattern.finditer(text))
    if not found:
        return None
    code = masked(text)
    ends = brace_ends(code)
    out: list[tuple] = []
    outside, last, owner = [], 0, ("", 0)
    for m in found:
        end = closing(code, ends, m.end())
        g = m.groupdict()
        name, kind = (g["c"], "class") if g.get("c") else (g["f"], "function")
        if name in ("if", "for", "while", "switch", "return", "else", "catch"):
            continue
        holder = g.get("owner") or (owner[0] if m.start() < owner[1] else "")
        if kind == "class":
            owner = (name, end)
        elif holder:
            name, kind = f"{holder}.{name}", "method"
        first = text.count("\n", 0, m.start()) + 1
        body = text[m.start() : end]
        calls = called_names(code[m.end() : end]) if kind != "class" else []
        out += sized(kind, name, first, first + body.count("\n"), body, calls, max_tokens)
        if m.start() >= last:
            outside.append(text[last : m.start()])
            last = end
    rest = "".join([*outside, text[last:]]).strip()
    if rest:
        out.append(("module", "<module>", 1, text.count("\n") + 1, rest, []))
    return out


def markdown_chunks(text: str, max_tokens: int) -> list[tuple]:
    """A preamble and one section per header; the whole document without any."""
    lines = text.splitlines(keepends=True)
    heads = [(i, x.strip()) for i, x in enumerate(lines, 1) if x.strip().startswith("#") and " " in x.strip()]
    if not heads:
        return [("section", "<document>", 1, len(lines), text.strip(), [])]
    out: list[tuple] = []
    pre = "".join(lines[: heads[0][0] - 1]).strip()
    if pre:
        out.append(("section", "<preamble>", 1, heads[0][0] - 1, pre, []))
    ends = [h[0] - 1 for h in heads[1:]] + [len(lines)]
    for (at, head), end in zip(heads, ends):
        body = "".join(lines[at - 1 : end]).rstrip()
        out += sized("section", head.lstrip("#").strip(), at, end, body, [], max_tokens)
    return out


def block_chunks(kind: str, name: str, text: str, max_tokens: int) -> list[tuple]:
    if estimate(text) <= max_tokens:
        return [(kind, name, 1, text.count("\n") + 1, text.strip(), [])]
    return [(kind, n, a, b, t, []) for a, b, n, t in split_block(text, name, 1, max_tokens)]


def chunk_text(path: str, text: str, max_tokens: int = MAX_CHUNK_TOKENS) -> list[tuple]:
    """Chunks of one file by its extension; what can't be parsed is split by size; blank text has none."""
    if not text.strip():
        return []
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    got = None
    if ext == "py":
        got = python_chunks(text, max_tokens)
    elif ext in SCRIPT:
        got = script_chunks(text, max_tokens)
    elif ext in BRACED:
        got = braced_chunks(text, BRACED[ext], max_tokens)
    elif ext in MARKDOWN:
        got = markdown_chunks(text, max_tokens)
    elif ext in CONFIG:
        got = block_chunks("config", name, text, max_tokens)
    return got if got is not None else block_chunks("raw", name, text, max_tokens)


def chunk_files(files: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS) -> DataFrame:
    """``CHUNK_SCHEMA`` of files (project_uuid, relative_path, file_hash, category, content).

    A file that fails gives one row with its error and no content, and doesn't
    disturb others; null content gives nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for project, path, digest, category, text in pdf.itertuples(index=False):
                try:
                    parts = chunk_text(path, text, max_tokens)
                except Exception as e:  # one bad file must not end the job
                    rows.append((project, path, digest, category, None, None, None, None, None, None, None, [], f"{type(e).__name__}: {e}"))
                    continue
                for i, (kind, name, a, b, body, calls) in enumerate(parts):
                    rows.append((project, path, digest, category, kind, i, a, b, name, body, estimate(body), calls, None))
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("chunk_index", "start_line", "end_line", "estimated_tokens"):
                out[c] = out[c].astype("Int32")
            yield out

    cols = ["project_uuid", "relative_path", "file_hash", "category", "content"]
    return files.select(*cols).where("content is not null and relative_path is not null").mapInPandas(run, CHUNK_SCHEMA)
