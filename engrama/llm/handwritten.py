"""Generated, minified or vendored source files, and data written as code.

Vendored copies: every file's code (comments aside) becomes a stream of tokens;
hashes of ``GRAM`` consecutive tokens are thinned by winnowing (the smallest
hash of each ``WINDOW`` neighbours).  A fingerprint recurs if it occurs in at
least ``MIN_REPOS`` repositories, and a file is a copy if at least
``COPY_SHARE`` of its fingerprints, and ``MIN_SHARED`` of them, or all of them
recur; code shorter than a gram, but of ``SHORT`` tokens, is one fingerprint.  So a lightly
patched copy is still found, and boilerplate inside other code, much shorter than a gram, is not.  A place reserved for
third parties (``THIRD_PARTY``) or a distribution's notice also tells a copy.

Generated files, minified files and data are told by the file itself: a header
in which a tool claims the file, code made of a few lines that repeat with other numbers, strings or hex
values, long lines without blanks, text that is mostly numbers or encoded bytes, or code whose tokens
are nearly all literals: strings, numbers, and the keys and INSERT heads of records.

All fingerprints stay distributed.  They are counted per (fingerprint,
repository) with partial sums first, and the recurring ones are matched per
salt, so a fingerprint in a third of all files is no hot key.

Defined cases
-------------
* files crawled again: the latest ``crawled_at`` of a ``file_id`` counts (ties:
  the greatest path); a node loaded again: its greatest (loaded_at, content).
* a file without text is judged by its path alone; an empty text is
  hand-written, and so is one with fewer than ``SHORT`` tokens, unless its path
  or header says otherwise.
* a repository is a ``project_uuid`` without case and outer blanks; a blank or
  null one counts as one repository of its own.
* both path separators are the same; null extensions and sizes are no evidence.
* empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.llm.batches import bound_batches
from engrama.staging import stage

GRAM = 60
WINDOW = 8
MIN_REPOS = 3
COPY_SHARE = 0.4
MIN_SHARED = 4
#: Tokens below which equal code is boilerplate rather than a copy.
SHORT = 15
REPEATED_SHARE = 0.5
REPEATED_LINES = 8
LITERAL_SHARE = 0.8
LONG_LINE = 300
SALTS = 8
TRAIT_SCHEMA = "node_id long, is_generated boolean, is_minified boolean, is_data boolean, is_notice boolean, prints array<long>"

#: Directories for third-party code.
THIRD_PARTY = r"(?i)(?:^|/)(?:vendor|vendored|third[_-]?party|thirdparty|external|externals|deps|libs/upstream|node_modules|bower_components|jspm_packages|site-packages|pods|carthage)/"
#: File names and directories of tools, used where there is no text.
TOOL_PATH = r"(?i)(?:^|/)(?:gen|generated|autogen|build/out|dist)/|_pb2(?:_grpc)?\.|\.pb\.|\.g\.|_gen\.|\.generated\.|[.-]min\.|\.bundle\.|\.prod\."
# What tools and distributions usually write about a file.
NOTICE = re.compile(
    r"@licen[sc]e\b|\b(?:copied|taken|imported|vendored|bundled) (?:verbatim )?from\b|\bcopyright \(c\) \d{4}[^\n]*\bcontributors\b"
    r"|\bupstream\b[^\n]*\b(?:copy|patch|patches|version|release|source)\b|\b(?:copy|patch|patches|version|release|source)\b[^\n]*\bupstream\b",
    re.I,
)
TOOL = re.compile(
    r"@generated\b|<auto-generated>|(?<!not )(?<!not-)\bauto-?generated (?:file|code|by|from)|\bautomatically generated\b|\b(?:machine|auto)-?(?:made|generated) (?:on|by|from|file)"
    r"|\bcode generated by\b|\bgenerated by [^\n]*(?:do not edit|compiler|generator|\d+\.\d+)|\bproduced by [^\n]*(?:compiler|generator|tool)\b"
    r"|\bgerado automaticamente\b|\bgerado por\b[^\n]*n[aã]o (?:edite|editar)|\b(?:changes|edits|modifications)\b[^\n]*\b(?:lost|overwritten|discarded)\b",
    re.I,
)
#: What each alternative of ``TOOL`` and of ``NOTICE`` holds, for a first look.
TOOL_WORDS = ("generated", "made", "produced", "gerado", "overwritten", "lost", "discarded")
NOTICE_WORDS = ("upstream", "@licen", "copied", "taken", "imported", "vendored", "bundled", "copyright")
STRING = re.compile(r"""\"(?:[^"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'""")
#: Digits, and hex values that stand outside of strings.
DIGITS = re.compile(r"\b(?:0[xX][0-9a-fA-F]+|(?=[a-fA-F]*\d)[0-9a-fA-F]{6,})\b|\d+")
DENIED = re.compile(r"\b(?:not|never|n[aã]o foi) (?:auto|machine|automatically|generated|gerado)", re.I)
#: What tells that a comment among code speaks of the file, not of the code next to it.
WHOLE_FILE = re.compile(r"\bdo not (?:edit|modify)|n[aã]o (?:edite|editar)|@generated\b|<auto-generated>|\b(?:this|auto-?generated|machine-?generated) (?:source )?(?:file|module)\b|\beste arquivo\b|\b(?:overwritten|lost|discarded)\b", re.I)
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
COMMENT = re.compile(r'/\*.*?\*/|"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|^[ \t]*(?://|#(?!include|define|if|endif|else|pragma)|--)[^\n]*$', re.S | re.M)
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]|[^\W\d_]+")
NUMBERS = re.compile(r"0[xX][0-9a-fA-F]+|-?\d+\.?\d*(?:[eE][-+]?\d+)?[fFlLuU]?")
LITERAL = re.compile(STRING.pattern + r"""|`(?:[^`\\]|\\.)*`|(?<![\w.])[-+]?\d[\w.]*|\b(?i:true|false|null|none|nil)\b""")
#: What frames the values of a record: a bare key before a value, or the head of an INSERT with its columns.
FRAME = re.compile(r"""[A-Za-z_$][\w$-]*(?=\s*(?::|=>)\s*[\0\[{])|\binsert\s+(?:or\s+\w+\s+|ignore\s+)?into\s+[\w.\0\[\]]+\s*(?:\([^()]*\)\s*)?values\b""", re.I)
NAME = re.compile(r"[^\W\d]\w*")
ENCODED = re.compile(r"[A-Za-z0-9+/=]{40,}")
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Comments at the margin (group 1), and all that may look like one: strings, here-documents, comments of a block.
MARGIN = re.compile(
    r"""^((?:/\*.*?\*/|<!--.*?-->|[rRuU]?\"\"\".*?\"\"\"|[rRuU]?'{3}.*?'{3}|(?:(?://|\#(?!include|define|if|endif|else|pragma)|--|;|%)[^\n]*(?:\n|\Z))+))"""
    r"""|\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"""
    r"""|<<-?[ \t]*['\"]?([A-Za-z_]\w*)['\"]?[^\n]*\n.*?^[ \t]*\2[ \t]*$|/\*.*?\*/|^[ \t]+(?://|\#|--)[^\n]*|(?<=[\s;{}])(?://|\#\s)[^\n]*""",
    re.S | re.M,
)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def fingerprints(code: str) -> np.ndarray:
    """Winnowed hashes of all grams of the code; one of the whole if it is shorter than a gram, none if it is trivial."""
    import xxhash

    words = TOKEN.findall(code)
    n = len(words)
    if n < SHORT:
        return np.zeros(0, np.int64)
    if n < GRAM:
        return np.array([xxhash.xxh3_64_intdigest("\0".join(words))], np.uint64).view(np.int64)
    number = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    t = np.fromiter(map(number.__getitem__, words), np.uint64, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(t * _powers(n, BASE), out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _powers(n - GRAM + 1, pow(BASE, -1, 1 << 64))
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    if len(grams) > WINDOW:
        grams = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1)
    else:
        grams = grams.min(keepdims=True)
    return np.unique(grams).view(np.int64)


def marked(text: str, low: str, words: tuple[str, ...], mark: re.Pattern, whole_file: re.Pattern | None = None, denied: re.Pattern | None = None) -> bool:
    """Whether a comment at the margin, anywhere in the text, holds the mark.

    Below the first and above the last code, the comment must name the whole file, if there is a pattern for that.
    """
    if not any(w in low for w in words) or not mark.search(text):
        return False
    opening, at = True, 0
    for m in MARGIN.finditer(text):
        opening = opening and not text[at : m.start()].strip() and m[1] is not None
        at = m.end()
        if m[1] and mark.search(m[1]) and not (denied and denied.search(m[1])):
            if whole_file is None or opening or whole_file.search(m[1]) or not text[at:].strip():
                return True
    return False


def is_generated(text: str, lines: list[str], low: str | None = None) -> bool:
    if marked(text, text.lower() if low is None else low, TOOL_WORDS, TOOL, WHOLE_FILE, DENIED):
        return True
    if len(lines) < REPEATED_LINES:
        return False
    code = STRING.sub(lambda m: '"0"' if DIGITS.search(m[0]) else '""', "\n".join(lines))
    shapes = Counter(x for x in DIGITS.sub("0", code).split("\n") if "0" in x)
    counted = sum(n for n in shapes.values() if n >= REPEATED_LINES)
    return counted > 0 and counted >= REPEATED_SHARE * len(lines)


def is_minified(code: str, lines: list[str]) -> bool:
    size = sum(map(len, lines))
    packed = sum(len(x) for x in lines if len(x) > LONG_LINE)
    return size > LONG_LINE and packed >= 0.6 * size and len(code) - len("".join(code.split())) < 0.1 * len(code)


def is_data(code: str) -> bool:
    solid = "".join(code.split())
    if len(solid) < 400:
        return False
    if sum(map(len, ENCODED.findall(solid))) >= 0.6 * len(solid) or sum(map(len, ENCODED.findall(code))) >= 0.6 * len(code):
        return True
    rest = NUMBERS.sub("", code)
    if len(re.sub(r"[\s,;:\[\](){}]+", "", rest)) <= 0.2 * len(solid):
        return True
    n, other = literals(code)
    return n >= REPEATED_LINES and n >= LITERAL_SHARE * (n + other)


def literals(code: str) -> tuple[int, int]:
    """Tokens that are literals or frame the values of records, and names outside of them."""
    rest, values = LITERAL.subn("\0", code)
    rest, frames = FRAME.subn(" ", rest)
    return values + frames, len(NAME.findall(rest))


def traits(text: str) -> tuple[bool, bool, bool, bool, np.ndarray]:
    """(generated, minified, data, notice of a distribution, fingerprints)."""
    code = COMMENT.sub(" ", PEM.sub(" ", text) if "-----BEGIN" in text else text)
    lines = [x for x in (y.strip() for y in code.splitlines()) if x]
    low = text.lower()
    return is_generated(text, lines, low), is_minified(code, lines), is_data(code), marked(text, low, NOTICE_WORDS, NOTICE), fingerprints(code)


def _trait_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [traits(t) for t in pdf["content"]]
        out = pd.DataFrame(found, columns=["is_generated", "is_minified", "is_data", "is_notice", "prints"])
        yield out.assign(node_id=pdf["node_id"].to_numpy())


def repo_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def path_key(c: Column) -> Column:
    return F.regexp_replace(c, r"\\", "/")


def code_files(crawl: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_id, repo, path, node_id) of the current code files; node_id null without text."""
    latest = (
        crawl.where("file_id is not null")
        .groupBy("file_id")
        .agg(F.max(F.struct("crawled_at", "relative_path", "project_uuid", "existing_node_id", "category")).alias("row"))
        .select("file_id", "row.*")
        .where("category = 'code'")
        .select("file_id", repo_key(F.col("project_uuid")).alias("repo"), path_key(F.col("relative_path")).alias("path"), "existing_node_id")
    )
    labelled = (
        nodes.where("type = 'file' and id is not null and label is not null")
        .groupBy(repo_key(F.col("project_uuid")).alias("repo"), path_key(F.col("label")).alias("path"))
        .agg(F.min("id").alias("label_node_id"))
    )
    return latest.join(labelled, ["repo", "path"], "left").select(
        "file_id", "repo", "path", F.coalesce("existing_node_id", "label_node_id").alias("node_id")
    )


def not_handwritten(crawl: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every current code file: file_id, generated, minified, data, vendored, copied_share."""
    bound_batches(crawl.sparkSession)
    files = stage(code_files(crawl, nodes), "files")
    wanted = files.select("node_id").where("node_id is not null").distinct()
    texts = nodes.where("content is not null").select(F.col("id").alias("node_id"), "content", "loaded_at").join(wanted, "node_id", "left_semi")
    current = texts.groupBy("node_id").agg(F.max(F.struct("loaded_at", "content")).alias("row")).select("node_id", "row.content")
    traits_of = stage(files.join(current.mapInPandas(_trait_batches, TRAIT_SCHEMA), "node_id", "left"), "traits")

    prints = traits_of.select("file_id", F.xxhash64("repo").alias("repo"), F.explode("prints").alias("print"))
    recurring = (
        prints.select("print", "repo").distinct().groupBy("print").agg(F.count(F.lit(1)).alias("n_repos"))
        .where(F.col("n_repos") >= MIN_REPOS)
        .select("print", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = prints.select("file_id", "print", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int").alias("salt"))
    shared = salted.join(recurring, ["print", "salt"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_shared"))
    share = F.coalesce(F.col("n_shared") / F.size("prints"), F.lit(0.0))
    share = F.when(F.size("prints") > 0, share).otherwise(F.lit(0.0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    no_text = F.col("is_data").isNull()
    path = F.coalesce("path", F.lit(""))
    return traits_of.join(shared, "file_id", "left").select(
        "file_id",
        (yes("is_generated") | (no_text & path.rlike(TOOL_PATH))).alias("generated"),
        yes("is_minified").alias("minified"),
        yes("is_data").alias("data"),
        (yes("is_notice") | path.rlike(THIRD_PARTY) | ((share >= COPY_SHARE) & (F.coalesce("n_shared", F.lit(0)) >= MIN_SHARED)) | (share >= 1.0)).alias("vendored"),
        F.round(share, 4).alias("copied_share"),
    )
