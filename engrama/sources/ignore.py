"""Ignore rules for crawled paths, as regular expressions built at plan time.

A rule is a glob in which ``*`` also crosses slashes.  Negations are tried
first, then rules for directories only (on directories), then the others, each
on the whole path and on its last part.  A rule without a slash matches any
part of the path; one with ``**`` matches a prefix and the form of the name.
"""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and files that are never read.
IGNORED_DIRS = (
    ".git", "node_modules", ".next", "dist", "build", "__pycache__", ".venv", "venv", ".env", ".idea", ".vscode", ".mypy_cache", ".pytest_cache", "coverage",
    ".tox", "egg-info", ".eggs", ".cache", ".gradle", "target", "vendor", "bower_components",
)
ALLOWED_HIDDEN_DIRS = (".github", ".husky", ".circleci", ".gitlab")
IGNORED_FILES = (
    ".env", ".env.*", "*.pem", "*.key", "*.cert", "*.der", "*.pfx", "*.p12", "id_rsa", "id_dsa", "id_ed25519",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "composer.lock", "Gemfile.lock",
    "*.log", "*.txt", "*.db", "*.sqlite", "*.sqlite3",
    "*.exe", "*.dll", "*.so", "*.dylib", "*.bin", "*.o", "*.a", "*.pyc", "*.pyo", "*.class", "*.wasm",
    "*.zip", "*.tar", "*.tar.gz", "*.tgz", "*.rar", "*.7z", "*.bz2",
    "*.jpg", "*.jpeg", "*.png", "*.gif", "*.ico", "*.svg", "*.mp3", "*.mp4", "*.wav", "*.avi", "*.mov", "*.webp", "*.ttf", "*.woff", "*.woff2", "*.eot",
    ".DS_Store", "Thumbs.db", "desktop.ini",
)


def _glob(pattern: str) -> str:
    return fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")


def rule_regex(pattern: str) -> str:
    """A regular expression, for the whole path, that matches what the rule matches."""
    if pattern.count("**") == 1:
        before, after = pattern.split("**")
        before, after = re.escape(before.rstrip("/")), after.lstrip("/")
        if not after:
            return f"{before}.*"
        last = rf"(?:.*/)?(?=[^/]*$){_glob(after)}"
        return rf"(?={before}){last}" if before else last
    if "/" in pattern:
        return _glob(pattern)
    return rf"(?:.*/)?(?:(?=[^/]*(?:/|$)){_segment(pattern)})(?:/.*)?"


def _segment(pattern: str) -> str:
    """The glob within one part of a path."""
    return _glob(pattern).replace(".*", "[^/]*")


@dataclass
class IgnoreRules:
    """Rules of three kinds, from built-in patterns and the lines of ignore files."""

    general: list[str] = field(default_factory=lambda: list(IGNORED_FILES))
    directories: list[str] = field(default_factory=list)
    negations: list[str] = field(default_factory=list)

    def add(self, lines: list[str]) -> IgnoreRules:
        for line in lines:
            rule = line.strip()
            if not rule or rule.startswith("#"):
                continue
            if rule.startswith("!"):
                self.negations.append(rule[1:].strip("/"))
            elif rule.endswith("/"):
                self.directories.append(rule.strip("/"))
            else:
                self.general.append(rule.lstrip("/"))
        return self

    def _regex(self, rules: list[str]) -> str:
        return "(?s)^(?:" + "|".join(rule_regex(r) for r in rules) + ")$" if rules else r"(?!)"

    def matches(self, path: str, is_dir: bool = False) -> bool:
        """The decision for one path."""
        path = path.replace("\\", "/")
        both = (path, path.rsplit("/", 1)[-1])
        hit = lambda rules: any(re.match(self._regex(rules), p) for p in both)
        if hit(self.negations):
            return False
        return (is_dir and hit(self.directories)) or hit(self.general)

    def column(self, path: Column) -> Column:
        """Whether a file's path is ignored, by itself or by one of its directories."""
        p = F.translate(path, "\\", "/")
        parts = F.split(p, "/")
        name = F.element_at(parts, -1)
        n = F.size(parts)
        dirs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))

        def ignored_dir(d: Column) -> Column:
            last = F.element_at(F.split(d, "/"), -1)
            hidden = last.startswith(".") & ~last.isin(*ALLOWED_HIDDEN_DIRS)
            ruled = self._hit(d, last, self.directories + self.general)
            return last.isin(*IGNORED_DIRS) | hidden | (ruled & ~self._hit(d, last, self.negations))

        file_hit = (self._hit(p, name, self.general) & ~self._hit(p, name, self.negations)) | name.startswith(".")
        return F.exists(dirs, ignored_dir) | file_hit

    def _hit(self, path: Column, name: Column, rules: list[str]) -> Column:
        if not rules:
            return F.lit(False)
        return path.rlike(self._regex(rules)) | name.rlike(self._regex(rules))
