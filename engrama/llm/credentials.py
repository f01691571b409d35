"""Credentials embedded in source code, configuration, notes and logs.

Candidates are the literals in places where credentials occur: assigned or
compared literals, values of configuration keys, logins in addresses, headers,
command lines and prose, tokens with an issuer's prefix, and private keys.  A
logistic regression scores each of them from three kinds of features: how
likely its characters are under a first-order Markov model of all texts, the
identifiers and words around it, and the file's path.  It is trained on the
candidates that weak patterns label (issuer prefixes and literals under
password keys against placeholders, references, hashes and identifiers),
calibrated on held-out ones, and then applied to all candidates.  What scores
at least ``THRESHOLD`` is redacted: quotes, keys and line breaks stay.

The Markov counts and the candidates cover all texts; only the fit is bounded,
by ``MAX_TRAIN`` labelled candidates (those with the smallest hashes).

Defined cases
-------------
* null or empty content has no candidates; of a node loaded again the greatest
  (loaded_at, content) counts; null ids are one node.
* lines are separated by line feeds and count from 1; a carriage return before
  one is no part of a value.
* a secret over several lines counts by its first line; several on a line give
  one row.
* with too few labelled candidates to fit, or to learn about a kind of place, the
  weak labels decide there alone.
* empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.batches import bound_batches
from engrama.staging import stage

MAX_TRAIN = 40_000
MIN_TRAIN = 40
MIN_PLACE = 5
THRESHOLD = 0.5
MARK = "REDACTED"
ALPHABET = 97
CANDIDATE_SCHEMA = "node_id long, line_no int, spans array<struct<start:int,end:int>>, value string, features array<float>, label int"

# Words of keys and prose around credentials, and around other literals.
PASSWORD_WORDS = r"identified by|pass(?:word|wd|code|phrase|_phrase)?|pwd|pw|senha|segredo|userpass|adminpw|given|supplied|entered"
TOKEN_WORDS = r"token|secret|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|auth|bearer|cred(?:s|ential|entials)?|chave|apikey|key|sig"
OTHER_WORDS = r"hash|sha\d*|md5|checksum|digest|integrity|uuid|guid|commit|build[_-]?id|etag|icon|pub|public|cert|fingerprint|sourcemap|policy|limit|count|field|window|ttl|path|mode|depth|column|label|size|length|version|revision|name|type|expiry|hint|screen|prompt"
PREFIXED = re.compile(
    r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{16,}|(?:AKIA|ASIA)[A-Z0-9]{12,}|xox[abprse]-[A-Za-z0-9-]{10,}|sk[-_](?:live_|test_|proj-)?[A-Za-z0-9]{16,}"
    r"|AIza[\w-]{30,}|ya29\.[\w-]{20,}|npm_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|[a-z]{2,6}[-_](?:(?:live|prod|test|stage)[-_])?(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])[A-Za-z0-9]{18,})"
)
REFERENCE = re.compile(
    r"^\$|\$\{|\$\(|^%[\w.]+%$|\{\{|^<[^>]*>$|^vault[:/]|^kv/|^(?:env|ssm|arn|file|ref|secretsmanager|keyring|op)[:/]|environ|getenv|process[._]env|^:'?\w+'?$|^@[\w/]+$|^config\.|^settings\.|^self\.",
    re.I,
)
PLACEHOLDER = re.compile(
    r"change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|this)|place[-_]?holder|^(?:your|my|the|some|any)[-_ ]|your[-_](?:api|token|key|pass|secret)|example|dummy|sample|redacted|insert[-_ ]|to[-_ ]?do|fixme|not[-_ ]?set|^\[.*\]$|^<|^\.\.\.|^(.)\1*$|^[x*#.•-]{4,}$|xxxx|\*\*\*\*"
    r"|^(?:password|passwd|secret|token|none|null|nil|true|false|test|testing|strict|admin|default|required|optional|string|undefined|empty|hidden|masked|disabled|enabled|basic|bearer)$"
    r"|^[a-z]*_?(?:password|passwd|secret|token|senha|api_?key|key)_?[a-z]*$|^(?:[A-Z]+_)*(?:PASSWORD|SECRET|TOKEN|KEY|SENHA)(?:_[A-Z]+)*$",
    re.I,
)
UUID = re.compile(r"^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?$", re.I)
HEX = re.compile(r"^[0-9a-f]+$", re.I)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+?)-----(.*?)(-----END [A-Z0-9 ]+-----|\Z)", re.S)
INERT = re.compile(r"data:[a-z]+/[\w.+-]+;base64,[A-Za-z0-9+/=]+|\bsha(?:1|256|384|512)[-:][A-Za-z0-9+/=]{20,}|sourceMapp?i?n?g?(?:URL)?[:=] ?\S+|\bssh-(?:rsa|ed25519|dss) [A-Za-z0-9+/=]+|ecdsa-sha2-\S+ [A-Za-z0-9+/=]+")

# Forms of logins, headers, commands, comparisons and prose that are worth a closer look, in lower case.
FORMS = ("rotation", "basic ", "basic\t", "login", "works", "run as", "://", '== "', "== '", "-u ", "-u\t", " -p", "\t-p")


def _stems(*words: str) -> tuple[str, ...]:
    """The literal beginnings of key words, and ``key`` for all that end so, without those that hold another one."""
    found = {"key" if w.endswith("key") else re.split(r"[(\[?]", w)[0] for x in words for w in re.sub(r"\(\?:[^)]*\)", "(", x).split("|")}
    return tuple(sorted(w for w in found if not any(o != w and o in w for o in found)))


#: Parts of lines that are worth a closer look: whatever the key words can match, and the forms.
HINTS = (*_stems(PASSWORD_WORDS, TOKEN_WORDS), *FORMS)
IDLE_TOKEN = re.compile(r"token(?:s\b|_?window|_?limit|_?count)", re.I)
LONG_TOKEN = re.compile(r"[A-Za-z0-9_\-.]{18,}")
QUOTED = re.compile(r"""(["'`])((?:(?!\1)[^\n\\]|\\.){4,})\1""")
KEY_BEFORE = re.compile(r"""([\w.$\-]+)["'\])]*\s*(=>|:=|={1,3}|!==?|:|,|\|\||\?\?|\()\s*[(\[]*\s*[fbr]?$""")
DEFINED = re.compile(r"#define[ \t]+(\w+)[ \t]+$")
NAMED_BEFORE = re.compile(rf"(?i)\b({PASSWORD_WORDS})[ \t]+$")
DEFAULT = re.compile(r"\$\{(\w+):?-([^}\s\"']{4,})\}")
PLAIN = re.compile(r"""^[ \t>*\-]*(?:export[ \t]+|set[ \t]+|-[ \t]+|#define[ \t]+)?["']?([A-Za-z_/][\w.\-/:@]*?)["']?[ \t]*(?:=|:[ \t]+|:(?=[^\s/:]))[ \t]*([^\s"'`<>;,(){}]{4,})[ \t]*;?\r?$""")
REGISTRY = re.compile(r"""_(?:authToken|auth|password)=([^\s"'$]{6,})""")
XML = re.compile(r"""<([\w.\-]+)>([^<>\s]{4,})</\1>|key="([^"]*)"\s+value="([^"]{4,})\"""")
#: What follows the ``://`` of an address with a login.
LOGIN = re.compile(r"""([^\s/:@"'`]*):([^\s/"'`<>]{3,}?)@(?=[\w\[{$])""")
PARAM = re.compile(r"""[?&]([\w.\-]+)=([^&\s"'`<>]{6,})""")
HEADER = re.compile(r"\b(Bearer|Basic|Token)[ \t]+([A-Za-z0-9+/=._~\-]{8,})", re.I)
COMMAND = re.compile(r"""(?:^|\s)(?:-u[ \t]+\S+[ \t]+-p ?|--?(?:password|passwd|token|secret|pass|api-key)[= ]|-u[ \t]+\w+:[ \t]?)([^\s"'`]{4,})""")
NAMED = re.compile(rf"""\b({PASSWORD_WORDS})[ \t]+["']?([^\s"'`;,()]{{4,}})["']?""", re.I)
PROSE = re.compile(rf"\b(?:({PASSWORD_WORDS}|token|secret|key|chave|credentials?|cred|login|still works|run as|bearer|until rotation use)\b)", re.I)
WORD_AFTER = re.compile(r"""[^\s"'`]{6,}""")
LAST_KEY = re.compile(r"([\w.$\-]+)\s*[:=]+\s*[\(\[]?\s*\\?\r?$")
#: Characters between a key and its value, so that a look back for the key goes on.
BETWEEN = re.compile(r"""[\s()\[\]"'=:>!|?,\\fbr]*""")
NO_WORD = re.compile(r"[(){}\[\]<>;|]|://|=")
STATEMENT = re.compile(r"\w\([^()]*\)|\)[{;,.]|\{\w+:|[;}]\w+[.=(]")
JOIN = re.compile(r"""[ \t]*(?:\+|\\|\.|&)?[ \t]*\r?\n[ \t>]*(?:\+|\.|&)?[ \t]*[fbr]?(["'`])((?:(?!\1)[^\n\\]|\\.){1,})\1""")
SHELL_JOIN = r"""\r?\n[ \t>]*{0}\+?=["']?\$\{{?{0}\}}?([^\s"']+)["']?"""

#: Names of files that hold nothing but logins or one secret.
SECRET_FILE = re.compile(r"(?i)(?:^|[._-])(?:htpasswd|pgpass|senha|chave|passwd|shadow|credentials?|secrets?|tokens?|passwords?|api[_-]?key)(?:[._-]|$)|\.key(?:\.|$)")
RECORD = re.compile(r"^[ \t]*(?:[^\s:]+:)*([^\s:]{4,})[ \t]*\r?$", re.M)

CONTEXTS = ("quoted", "plain", "xml", "login", "param", "header", "command", "named", "prose", "prefix", "pem", "compare", "call", "bare")
CONFIG = {"env", "ini", "toml", "yaml", "yml", "json", "properties", "xml", "conf", "cfg", "npmrc", "netrc", "pypirc"}
DOCS = {"md", "rst", "txt", "adoc", "log", "chat", "asc"}


@dataclass
class Candidate:
    spans: list[tuple[int, int]]
    value: str
    key: str
    before: str
    context: str


def shannon(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def looks_plain(v: str) -> bool:
    """A word, number, path or identifier rather than a secret's shape."""
    if PREFIXED.fullmatch(v):
        return False
    if (v.isalpha() and (len(v) < 24 and (v.isupper() or v.islower() or v.istitle()))) or re.fullmatch(r"[-+]?[\d.,:%]+[a-zA-Z]{0,2}", v):
        return True
    return bool(re.fullmatch(r"[a-z]+(?:[_.][a-z]+)?\d{0,2}(?:\(\))?|[a-z]+(?:/[a-z]+)+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|\.{0,2}/[\w./-]*|[\w.-]+\.(?:py|js|ts|tsx|go|java|c|h|md|json|yaml|sql|rb|sh|txt|xml|toml|ini)", v))


def _extension(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def is_shaped(v: str) -> bool:
    """Like a chosen password or a random token: mixed kinds of characters or joined words."""
    kinds = any(map(str.isdigit, v)) + any(map(str.isupper, v)) + any(map(str.islower, v)) + any(not ch.isalnum() for ch in v)
    mixed = any(map(str.isdigit, v)) and any(map(str.isalpha, v)) and len(v) >= 8 and not looks_plain(v)
    return kinds >= 3 or mixed or bool(re.fullmatch(r"[^\W_]+(?:[-_.][^\W_]+){2,}", v)) or (bool(HEX.match(v)) and len(v) >= 16)


def candidates(text: str, path: str = "") -> list[Candidate]:
    """The literals of a text that stand where a credential could."""
    out: list[Candidate] = []
    name = path.rsplit("/", 1)[-1]
    if SECRET_FILE.search(name) and _extension(name) in DOCS | {"", "key", "pgpass", "plain"}:
        for m in RECORD.finditer(text):
            out.append(Candidate([m.span(1)], m[1], "password", "", "bare"))
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    for m in PEM.finditer(text):
        if "PRIVATE" in m[1]:
            out.append(Candidate([(m.start(), m.end())], next(iter(m[2].split()), m[0]), "", _line_before(text, m.start()), "pem"))
    if "-----BEGIN" in text:
        text = PEM.sub(blank, text)
    text = INERT.sub(blank, text)
    for m in LONG_TOKEN.finditer(text):
        if not m[0].isalpha() and any(map(str.isdigit, m[0])):
            for p in PREFIXED.finditer(text, m.start(), m.end()):
                out.append(Candidate([p.span()], p[0], "", _line_before(text, p.start()), "prefix"))
    for start, end in _hinted_lines(text):
        _line_candidates(text, start, end, out)
    return _distinct(out)


def _search_back(pattern: re.Pattern, line: str, end: int) -> re.Match | None:
    """``pattern.search(line, 0, end)`` of a pattern bound to the end, in time that the match, not the line, decides."""
    reach = 128
    while True:
        low = max(0, end - reach)
        m = pattern.search(line, low, end)
        if low == 0 or (m and m.start() > low) or (not m and not BETWEEN.fullmatch(line, low, end)):
            return m
        reach *= 4


def _lowered(text: str) -> str:
    """In lower case, but for the few letters that change their length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text)))


def _hinted_lines(text: str) -> list[tuple[int, int]]:
    low = _lowered(text)
    starts: dict[int, int] = {}
    for hint in HINTS:
        at = low.find(hint)
        while at >= 0:
            end = low.find("\n", at)
            end = len(low) if end < 0 else end
            start = low.rfind("\n", 0, at) + 1
            if start not in starts and (hint != "token" or not _idle(low[start:end])) and (hint != "://" or "@" in low[start:end]):
                starts[start] = end
            at = low.find(hint, end)
    return sorted(starts.items())


def _idle(line: str) -> bool:
    return len(IDLE_TOKEN.findall(line)) == line.count("token")


def _line_before(text: str, at: int) -> str:
    return text[max(text.rfind("\n", 0, at) + 1, at - 80) : at]


def _line_candidates(text: str, start: int, end: int, out: list[Candidate]) -> None:
    line = text[start:end]

    def add(span: tuple[int, int], key: str, context: str) -> Candidate:
        a, b = start + span[0], start + span[1]
        c = Candidate([(a, b)], text[a:b], key, line[max(0, span[0] - 60) : span[0]], context)
        out.append(c)
        return c

    at = line.find("://")
    while at >= 0:
        m = LOGIN.match(line, at + 3) if line[at - 1 : at].isalnum() else None
        if m:
            add(m.span(2), "login", "login")
        at = line.find("://", at + 3)
    for m in HEADER.finditer(line):
        add(m.span(2), m[1], "header")
    tagged = line.find("<")
    for m in QUOTED.finditer(line):
        k = next(filter(None, (_search_back(p, line, m.start()) for p in (KEY_BEFORE, DEFINED, NAMED_BEFORE))), None)
        key, how = (k[1], k[2] if k.re is KEY_BEFORE else "=") if k else ("", "(")
        if key in ("key", "name") and 0 <= tagged < m.start():
            continue  # the name of a setting, not its value
        context = "compare" if how in ("==", "===", "!=", "!==") else "call" if how in (",", "(") else "quoted"
        c = add(m.span(2), key, context)
        _follow_join(text, start + m.end(), c)
        if key and how == "=":
            n = re.compile(SHELL_JOIN.format(re.escape(key))).match(text, start + m.end())
            if n:
                c.spans.append(n.span(1))
                c.value += n[1]
    for m in DEFAULT.finditer(line):
        add(m.span(2), m[1], "quoted")
    tail = _search_back(LAST_KEY, line, len(line))
    if tail:
        n = re.compile(r"""\s*(["'`])((?:(?!\1)[^\n\\]|\\.){4,})\1""").match(text, end)
        if n:
            c = Candidate([n.span(2)], n[2], tail[1], line[-60:], "quoted")
            out.append(c)
            _follow_join(text, n.end(), c)
    m = PLAIN.match(line)
    if m:
        add(m.span(2), m[1], "plain")
    for m in REGISTRY.finditer(line):
        add(m.span(1), "authToken", "plain")
    if "<" in line:
        for m in XML.finditer(line):
            add(m.span(2) if m[2] else m.span(4), m[1] or m[3], "xml")
    for m in PARAM.finditer(line):
        if KEY_ANY.search(m[1]):
            add(m.span(2), m[1], "param")
    for m in COMMAND.finditer(line):
        add(m.span(1), "password", "command")
    for m in NAMED.finditer(line):
        add(m.span(2), m[1], "named")
    if not line.lstrip().startswith("<"):
        _prose_candidates(line, add)


def _prose_candidates(line: str, add: Callable[[tuple[int, int], str, str], Candidate]) -> None:
    """Words after a key word of prose, to the end of the line; of a word that holds one itself, also what follows it."""
    marks = [(m.end(), m[1]) for m in PROSE.finditer(line)]
    i, key = 0, ""
    for w in WORD_AFTER.finditer(line, marks[0][0]) if marks else ():
        a, end = w.span()
        while i < len(marks) and marks[i][0] <= a:
            key = marks[i][1]
            i += 1
        for a, key in ((a, key), marks[i]) if i < len(marks) and marks[i][0] < end else ((a, key),):
            b = end
            eq = line.find("=", a, b)
            if 0 < eq < b - 6 and not STATEMENT.search(line, eq, b):
                add((eq + 1, b), line[a:eq], "plain")
            while b > a and line[b - 1] in ".,;:)]}":
                b -= 1
            if b - a >= 6 and not looks_plain(line[a:b]) and not NO_WORD.search(line, a, b):
                add((a, b), key, "prose")


def _follow_join(text: str, at: int, c: Candidate) -> None:
    """Take in the literals that are joined to this one on the next lines."""
    while True:
        n = JOIN.match(text, at)
        if n is None or ("+" not in n[0] and "\\" not in n[0] and not re.search(r"\(\s*$", c.before)):
            return
        c.spans.append(n.span(2))
        c.value += n[2]
        at = n.end()


def _distinct(found: list[Candidate]) -> list[Candidate]:
    """One candidate per place: the first kind of ``CONTEXTS`` wins only if its key says more."""
    best: dict[tuple[int, int], Candidate] = {}
    for c in found:
        old = best.get(c.spans[0])
        if old is None or _rank(c) > _rank(old):
            best[c.spans[0]] = c
    return list(best.values())


def _rank(c: Candidate) -> tuple:
    return (c.context in ("pem", "login", "header", "param", "command"), len(c.spans), -len(c.value) if c.context == "prose" else 0, bool(re.search(KEY_ANY, c.key)), c.context != "prefix", c.context != "prose")


KEY_ANY = re.compile(rf"(?i)(?:{PASSWORD_WORDS}|{TOKEN_WORDS})")
KEY_PASSWORD = re.compile(rf"(?i)(?:^|[_.\-/:\s(]|(?<=[a-z]))(?:{PASSWORD_WORDS})\d*(?:$|[_.\-\s\d])|(?:Pass|Pw|Pwd|Password|Senha)\d*$|pass(?:word|wd)|senha")
KEY_TOKEN = re.compile(rf"(?i)(?:{TOKEN_WORDS})")
KEY_OTHER = re.compile(rf"(?i)(?:^|[_.\-\s]|(?<=[a-z]))(?:{OTHER_WORDS})s?\d*$|^(?:pub|icon|integrity|checksum)|sourceMap")
BEFORE_SECRET = re.compile(rf"(?i)\b(?:{PASSWORD_WORDS}|token|secret|key|chave|cred\w*|login|still works|run as|rotation use|bearer|auth\w*)\b[^\n]{{0,48}}$")
BEFORE_OTHER = re.compile(r"(?i)\b(?:commit|hash|sha\d*|checksum|revision|rev|blob|tree|uuid|id|version|release|see|build)\b[\s:=#('\"]*$")
USERINFO = re.compile(r"^[^:\s]+:\S{3,}$")


def _decoded(value: str) -> str:
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, ValueError):
        return ""


def is_reference(c: Candidate) -> bool:
    """Placeholders and references, which no score can make a secret."""
    v = c.value.strip()
    if c.context == "pem":
        return False
    if c.context == "header" and c.key.lower() == "basic":
        v = _decoded(v).rpartition(":")[2] or v
    if not v or len(set(v)) < 3 or any(ch in v for ch in "\n\r\t") or v.count(" ") > 3:
        return True
    return bool(REFERENCE.search(v) or PLACEHOLDER.search(v))


def features(c: Candidate, extension: str, path: str) -> list[float]:
    """Numbers from the surroundings, the path and the value, but for its likelihood."""
    v, n = c.value, max(1, len(c.value))
    digits, upper, lower = (sum(map(f, v)) / n for f in (str.isdigit, str.isupper, str.islower))
    hexlike = bool(HEX.match(v))
    basic = c.context == "header" and c.key.lower() == "basic" and bool(USERINFO.match(_decoded(v)))
    near_other = bool(BEFORE_OTHER.search(c.before))
    key_other = bool(KEY_OTHER.search(c.key))
    x = [
        1.0,
        float(bool(KEY_PASSWORD.search(c.key)) and not key_other),
        float(bool(KEY_TOKEN.search(c.key)) and not key_other),
        float(key_other),
        float(bool(BEFORE_SECRET.search(c.before)) and not near_other),
        float(near_other),
        float(bool(PREFIXED.fullmatch(v))),
        float(basic),
        *(float(c.context == k) for k in CONTEXTS),
        math.log(n) / 4,
        shannon(v) / 5,
        digits,
        upper,
        lower,
        1 - digits - upper - lower,
        float(0 < digits < 1 and upper + lower > 0),
        float(hexlike and n in (32, 40, 64, 96, 128)),
        float(hexlike),
        float(bool(UUID.match(v))),
        float(looks_plain(v)),
        float(" " in v),
        float(is_shaped(v)),
        float(is_reference(c)),
        float(len(c.spans) > 1),
        float(extension in CONFIG),
        float(extension in DOCS),
        float(bool(re.search(r"(?:^|/)(?:tests?|fixtures?|examples?|docs?)/", path))),
    ]
    return x


PLACES = slice(8, 8 + len(CONTEXTS))
SHAPED_AT = 8 + len(CONTEXTS) + 12
N_FEATURES = 8 + len(CONTEXTS) + 18 + 1  # the last one is the likelihood


def weak_label(c: Candidate, x: list[float]) -> int:
    """1 or 0 where a pattern is sure enough to teach, else -1."""
    v = c.value
    if c.context == "pem":
        return 1
    if is_reference(c):
        return 0
    if PREFIXED.fullmatch(v) or (c.context == "login" and len(v) >= 6) or x[7]:
        return 1
    key_secret = x[1] or x[2]
    if UUID.match(v) or (x[3] and not x[1]):
        return 0
    if HEX.match(v) and len(v) >= 32 and not key_secret and not x[4]:
        return 0
    if looks_plain(v) or " " in v:
        return 0
    shaped = x[SHAPED_AT] > 0
    if x[1] and c.context in ("quoted", "plain", "xml", "named", "command", "call", "compare", "param", "bare") and len(v) >= 6:
        return 1
    if x[2] and c.context in ("quoted", "plain", "xml", "param", "header", "call") and len(v) >= 12 and shannon(v) > 3:
        return 1
    if x[4] and shaped and len(v) >= 8 and c.context in ("prose", "call", "compare", "plain"):
        return 1
    if not key_secret and not x[4] and c.context in ("quoted", "plain", "xml", "call"):
        return 0
    return -1


def _extractor(chain):
    """Candidates of each text, with the Markov likelihood of their values as the last feature."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for node_id, label, text in zip(pdf["node_id"], pdf["label"], pdf["content"]):
                path = (label or "").replace("\\", "/").split("::")[0]
                found = candidates(text, path)
                if not found:
                    continue
                breaks = [m.start() for m in re.finditer("\n", text)]
                extension = _extension(path.rsplit("/", 1)[-1])
                for c in found:
                    x = features(c, extension, path)
                    line = bisect_right(breaks, c.spans[0][0] - 1) + 1
                    place = [{"start": a, "end": b} for a, b in c.spans]
                    rows.append((node_id, line, place, c.value, [*x, -likelihood(chain.value, c.value) / 5], weak_label(c, x)))
            yield pd.DataFrame(rows, columns=["node_id", "line_no", "spans", "value", "features", "label"])

    return extract


def _symbols(text: str) -> np.ndarray:
    """Printable ASCII as 0..95, everything else as one symbol."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int64) - 32
    return np.where((b >= 0) & (b < ALPHABET - 1), b, ALPHABET - 1)


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(ALPHABET * ALPHABET, np.int64)
    for pdf in batches:
        s = _symbols("\n".join(pdf["content"]))
        if len(s) > 1:
            total += np.bincount(s[:-1] * ALPHABET + s[1:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pd.DataFrame({"pair": at, "n": total[at]})


def markov(texts: DataFrame) -> np.ndarray:
    """Log-probabilities of each character after each other one, over all texts."""
    counts = np.full(ALPHABET * ALPHABET, 0.5)
    sums = texts.select("content").mapInPandas(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # at most ALPHABET squared rows
        counts[r["pair"]] += r["n"]
    m = counts.reshape(ALPHABET, ALPHABET)
    return np.log(m / m.sum(axis=1, keepdims=True))


def likelihood(model: np.ndarray, value: str) -> float:
    s = _symbols(value)
    return float(model[s[:-1], s[1:]].mean()) if len(s) > 1 else -4.0


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights of a penalised logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray | None
    slope: float
    shift: float
    taught: np.ndarray | None = None  # kinds of places with enough labels to learn from

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (x @ self.weights) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(found: DataFrame) -> Scorer:
    """Train on half of the labelled sample and calibrate on the other half; values stay where they are."""
    labelled = found.where("label >= 0").select("features", "label", F.xxhash64("node_id", "line_no", "value").alias("h"))
    total = labelled.count()
    low = F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, MAX_TRAIN / max(1, total)))
    rows = labelled.where(low).orderBy("h").collect()
    y = np.array([r["label"] for r in rows], float)
    if len(rows) < MIN_TRAIN or not 0 < y.sum() < len(y):
        return Scorer(None, 1.0, 0.0)
    x = np.array([r["features"] for r in rows], float)
    train = np.arange(len(rows)) % 2 == 0
    w = fit_logistic(x[train], y[train])
    z = x[~train] @ w
    slope, shift = fit_logistic(np.stack([z, np.ones_like(z)], axis=1), y[~train], 0.01)
    return Scorer(w, max(float(slope), 1e-3), float(shift), x[:, PLACES].sum(axis=0) >= MIN_PLACE)


def find_credentials(nodes: DataFrame) -> DataFrame:
    """Candidates that score as credentials: node_id, line_no, spans, value, score."""
    spark = nodes.sparkSession
    bound_batches(spark)
    texts = current_texts(nodes)
    chain = spark.sparkContext.broadcast(markov(nodes.where("content is not null")))
    found = stage(texts.select("node_id", "label", "content").mapInPandas(_extractor(chain), CANDIDATE_SCHEMA), "candidates")
    held = spark.sparkContext.broadcast(fit(found))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = held.value
        for pdf in batches:
            if s.weights is None or not len(pdf):
                p = (pdf["label"] == 1).astype(float).to_numpy()
            else:
                x = np.array(pdf["features"].tolist(), float)
                p = s.scores(x)
                p = np.where(x[:, PLACES] @ s.taught > 0, p, (pdf["label"] == 1).astype(float))
                p[x[:, REFERENCE_AT] > 0] = 0.0
            yield pdf[["node_id", "line_no", "spans", "value"]].assign(score=p)

    scored = found.mapInPandas(score, "node_id long, line_no int, spans array<struct<start:int,end:int>>, value string, score double")
    return scored.where(F.col("score") >= THRESHOLD)


REFERENCE_AT = SHAPED_AT + 1


def current_texts(nodes: DataFrame) -> DataFrame:
    """(node_id, label, content) of the current row of every node with content."""
    rows = nodes.where("content is not null").groupBy(F.col("id").alias("node_id")).agg(F.max(F.struct("loaded_at", "content", "label")).alias("row"))
    return rows.select("node_id", "row.label", "row.content")


def redact(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node_id, content, n_redacted) of the nodes that hold credentials."""
    spans = found.groupBy("node_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [redacted(t, [(s["start"], s["end"]) for s in where]) for t, where in zip(pdf["content"], pdf["spans"])]
            yield pd.DataFrame({"node_id": pdf["node_id"], "content": texts, "n_redacted": [len(w) for w in pdf["spans"]]})

    return current_texts(nodes).select("node_id", "content").join(spans, "node_id").mapInPandas(cut, "node_id long, content string, n_redacted int")


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced, overlapping ones as one; a key block keeps its frame and its lines."""
    out, at = [], 0
    for a, b in _united(spans):
        part = text[a:b]
        out.append(text[at:a])
        m = PEM.fullmatch(part)
        if m:
            body = re.sub(r"[A-Za-z0-9+/=]{16,}", MARK, m[2])
            out.append(f"-----BEGIN {m[1]}-----{body}{m[3]}")
        else:
            out.append(MARK)
        at = b
    out.append(text[at:])
    return "".join(out)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap united."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
