"""Secret scans by assignment-aware lexing.

Three base patterns find assignments, access keys and hex runs. On top, texts
are lexed as source or configuration syntax into name-literal pairs (quoted,
prefixed, triple-quoted, concatenated and bare values; names with dots, quotes, brackets,
camel case; elements and key-value attributes of XML; command-line flags; calls, whose function or
first literal is the name; lists and tuples, element by element; definitions; indented blocks);
names assigned to names carry their constant along, in joins and templates too; and each literal is scored
by how sensitive its target name is and how much it looks like a credential.
Private keys in PEM, passwords in URLs and tokens of an Authorization header say themselves what they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "named")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

# A name begins at a word's first character and is passed over as a whole where no value follows; a quoted name has no
# quotes or brackets inside. So the time is linear in the text, whatever the length of names.
_NAME = r"""(?<![\w$@])[A-Za-z_$@][\w$@]*+(?:(?:\.|->|::|-)[A-Za-z_$][\w$@]*+)*+"""
_STRING = (
    r"""(?:(?:[fF][rR]?|[rR][bBfF]?|[bB][rR]?|[uU])?(?:"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}"""
    r"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|`[^`\n]*`)"""
)
_INSIDE = re.compile(r"""[fFrRbBuU]{0,2}("{3}|'{3}|"|'|`)""")
_PAIR = re.compile(
    rf"""(?:["'\[]["']?(?P<quoted>[\w.$@ -]++)["']?["'\]]|(?P<name>{_NAME}))(?:(?P<type>\x20*:\x20*[A-Za-z][\w<>\[\]]*+(?=\x20*=[^=]))?"""
    rf"""[\x20\t]*(?P<op>:=|=>|=(?![=~])|:(?![:=/]))[\x20\t]*(?P<value>{_STRING}|[^\s"'`,;#{{}}()\[\]]+))?+(?(value)|(?(name)|(?!)))""",
    re.ASCII,
)
# A join goes on in the next line after its sign, or with its sign indented there: a diff's + is not, a sentence's stop has no space before it.
_LINE = r"\\?\r?\n[\x20\t]*"
_JOIN = rf"[\x20\t]*(?:\+|\.\.?|\|\||\?\?)[\x20\t]*|[\x20\t]*(?:\+|\.\.|(?<=[\x20\t])\.)[\x20\t]*{_LINE}|[\x20\t]*\r?\n[\x20\t]+(?:\+|\.\.?)[\x20\t]*|[\x20\t]*\\\r?\n[\x20\t]*"
_MORE = re.compile(rf"(?:{_JOIN})({_STRING}|{_NAME})", re.ASCII)
#: Names and values that no sign joins: elements, attributes by key and value, and flags.
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?+>([^<>]++)</", re.ASCII)
_KEYED = re.compile(r"""\b(?:key|name)\s*+=\s*+["']([\w.:$ -]++)["']\s++value\s*+=\s*+(?:"([^"<>\n]*+)"|'([^'<>\n]*+)')""", re.ASCII)
_FLAG = re.compile(rf"(?<![\w-])--?([A-Za-z][\w-]*+)[ \t]++(?!-)({_STRING}|[^\s\"'`;|&<>()]++)", re.ASCII)
#: Calls with literals among their first arguments; a sign and a literal may follow, as in `env("X") || "default"`.
_CALL = re.compile(rf"(?P<name>{_NAME})\((?P<args>[\x20\t]*(?:{_STRING}|{_NAME})(?:[\x20\t]*,[\x20\t]*(?:{_STRING}|{_NAME}))?+)?[\x20\t]*(?:\)[\x20\t]*(?:\|\||\?\?|\bor\b)[\x20\t]*(?P<other>{_STRING}))?", re.ASCII)
_ASSIGNED = re.compile(r"""["'\]]?[\x20\t]*(?::=|=>|=|:)[\x20\t]*(?:new\x20|await\x20)?$""")
_OR = re.compile(rf"(?P<name>{_NAME})[\x20\t]*(?::=|=>|=|:)[\x20\t]*{_NAME}[\x20\t]*(?:\|\||\?\?|\bor\b)[\x20\t]*(?P<value>{_STRING})", re.ASCII)
_READS = re.compile(r"(?i)(?:^|[._:])(?:get_?env|env|environ\.get|fetch|get|get_?property|lookup|config)$")
#: `name = ["...", "..."]`, `a, b = "...", "..."`, `#define NAME "..."`, `IDENTIFIED BY '...'`, and a key whose value is on the next lines.
_SERIES = rf"{_STRING}(?:\s*+,\s*+{_STRING})*+"
_LIST = re.compile(rf"(?:[\"'](?P<quoted>[\w.$@-]++)[\"']|(?P<name>{_NAME}))[\x20\t]*(?::=|=>|=|:)[\x20\t]*[\[({{]\s*+(?P<values>{_SERIES})", re.ASCII)
_TUPLE = re.compile(rf"(?P<names>{_NAME}(?:[\x20\t]*,[\x20\t]*{_NAME})++)[\x20\t]*=[\x20\t]*\(?(?P<values>{_SERIES})", re.ASCII)
_DEFINE = re.compile(rf"#[\x20\t]*define[\x20\t]++(\w++)[\x20\t]++\(?({_STRING}|[^\s\"'()]++)", re.ASCII)
_SQL = re.compile(rf"\b(?ai:IDENTIFIED\s++(?:WITH\s++\w++\s++)?(?:BY|AS)(?:\s++PASSWORD)?|PASSWORD)\s++({_STRING})")
_BLOCK = re.compile(r"""^([\x20\t]*+)(?:-\x20++)?["']?([A-Za-z_][\w.-]*+)["']?[\x20\t]*+(?::|=>?)[\x20\t]*+([|>][+-]?\d?)?[\x20\t]*+\r?\n""", re.ASCII | re.MULTILINE)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]++ ){0,4}?PRIVATE KEY(?: BLOCK)?-----((?:[^-]|-(?!----))*+)-----END")
_URL = re.compile(r"""(?<![\w+.-])[A-Za-z][\w+.-]{1,30}://[^\s:@/"'<>]*+:([^\s@/"'<>]++)@""", re.ASCII)
_BEARER = re.compile(r"""\b(?ai:Authorization["']?\s*+[:=,]\s*+["']?(?:Bearer|Basic|Token)|Bearer)\x20++([\w.~+/=-]{8,})""")
_STRINGS, _NAMES, _TEMPLATE = re.compile(_STRING), re.compile(_NAME, re.ASCII), re.compile(r"\$?\{([A-Za-z_]\w*+)\}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Parts of names and how sensitive they make the target.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "mnemonic": 0.8, "phrase": 0.5, "seed": 0.4, "secret": 1.0, "secrets": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "bearer": 0.8, "private": 0.5, "signing": 0.5, "encryption": 0.5, "access": 0.4, "client": 0.2, "api": 0.4, "key": 0.5, "pat": 0.4, "jwt": 0.6, "dsn": 0.4, "salt": 0.4}
#: Parts that say the value is about a secret, not one.
HARMLESS = {"id", "name", "type", "count", "length", "len", "size", "public", "max", "min", "limit", "url", "uri", "path", "file", "field", "label", "hint", "expiry", "expires", "ttl", "policy", "prefix", "header", "column", "index", "primary", "foreign", "sort", "hash", "enabled", "required", "reset"}
_DULL = re.compile(r"(?i)^(?:changeme|change_me|example.*|placeholder|dummy|sample|test(?:ing)?|none|null|nil|true|false|undefined|todo|fixme|string|str|your[-_].*|my[-_]?.*|x{3,}|\*+|\.+|-+|<.*>|\$\{.*\}?|\{\{.*|%\(.*|\$[A-Za-z_].*|env\..*|os\.environ.*|process\.env.*|getenv.*)$")
THRESHOLD = 1.0


def name_score(name: str) -> float:
    parts = [p.lower() for p in _WORDS.findall(name)]
    if not parts or parts[-1] in HARMLESS or "public" in parts:
        return 0.0
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in parts))


#: Names whose literals may be several words.
_PHRASES = {"passphrase", "mnemonic", "seed", "phrase"}


def _is_phrase(name: str, value: str) -> bool:
    """At least four words under a name that asks for such."""
    return bool(_PHRASES & {p.lower() for p in _WORDS.findall(name)}) and len(value.split()) >= 4 and not _DULL.match(value)


def literal_score(value: str, counts: dict[str, float] | None = None, length: float | None = None) -> float:
    """0 for what cannot be a credential, up to 1 by length, mixture and entropy of characters.

    ``value`` may be the first `HEAD` characters and the last one of a longer literal with these counts and this length.
    """
    counts = Counter(value) if counts is None else counts
    length = len(value) if length is None else length
    if length < 8 or _DULL.match(value) or any(c.isspace() for c in counts):
        return 0.0
    entropy = -sum(n / length * math.log2(n / length) for n in counts.values() if n / length)
    classes = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if entropy < 2.2 or (classes == 1 and not all(map(str.isdigit, counts)) and len(counts) < 6):
        return 0.0
    return min(1.0, 0.2 * classes + entropy / 8 + min(length, 40) / 100)


def _inside(v: str) -> tuple[int, int] | None:
    """Where a string literal's content begins and ends in it; None for what is no string."""
    m = _INSIDE.match(v)
    return (m.end(), len(v) - len(m[1])) if m and len(v) >= m.end() + len(m[1]) and v.endswith(m[1]) else None


def _stated(text: str) -> Iterator[tuple[str, str, int]]:
    """(name, value, start of the value) of elements, keyed attributes and flags."""
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            v = m[2].strip()
            yield m[1].rpartition(":")[2], v, m.start(2) + m[2].find(v)
    if "value" in text:
        for m in _KEYED.finditer(text):
            k = 2 if m[2] is not None else 3
            yield m[1], m[k], m.start(k)
    if "(" in text:
        yield from _called(text)
    if '"' in text or "'" in text or "`" in text or "#" in text:
        yield from _grouped(text)
    if ":" in text or "=" in text:
        yield from _blocks(text)
    if "-" in text:
        for m in _FLAG.finditer(text):
            a, b = _inside(m[2]) or (0, len(m[2]))
            yield m[1], m[2][a:b], m.start(2) + a


def _literal(v: str, start: int) -> tuple[str, int]:
    """A value without its quotes and outer blanks, and where that begins."""
    a, b = _inside(v) or (0, len(v))
    held = v[a:b].strip()
    return held, start + (v.find(held, a) if held else a)


def _literals(text: str, start: int, end: int) -> list[tuple[str, int]]:
    return [_literal(m[0], m.start()) for m in _STRINGS.finditer(text, start, end)]


def _called(text: str) -> Iterator[tuple[str, str, int]]:
    """Pairs of calls: by the name that they are assigned to, their first literal, or their function."""
    for m in _CALL.finditer(text):
        own = _literals(text, *m.span("args")) if m["args"] else []
        reads = bool(_READS.search(m["name"]))
        line = text.rfind("\n", max(0, m.start() - 200), m.start()) + 1
        before = text[max(line, m.start() - 200) : m.start()]
        target = None
        if sign := _ASSIGNED.search(before):
            target = next(reversed(_NAMES.findall(before[: sign.start()])), None)
        values = own[1:] if len(own) > 1 or reads else own
        if m["other"]:
            values = [*values, _literal(m["other"], m.start("other"))]
        for v, at in values:
            if target:
                yield target, v, at
            yield (own[0][0] if len(own) > 1 or (reads and own) else m["name"]), v, at
        if len(own) == 1 and not reads:
            yield m["name"], *own[0]


def _grouped(text: str) -> Iterator[tuple[str, str, int]]:
    """Pairs of lists, tuples, definitions, SQL and defaults after a sign."""
    for m in _LIST.finditer(text):
        yield from ((m["quoted"] or m["name"], v, at) for v, at in _literals(text, *m.span("values")))
    for m in _TUPLE.finditer(text):
        yield from ((name, v, at) for name, (v, at) in zip(_NAMES.findall(m["names"]), _literals(text, *m.span("values")), strict=False))
    for m in _DEFINE.finditer(text):
        yield m[1], *_literal(m[2], m.start(2))
    for m in _SQL.finditer(text):
        yield "password", *_literal(m[1], m.start(1))
    for m in _OR.finditer(text):
        yield m["name"], *_literal(m["value"], m.start("value"))


def _blocks(text: str) -> Iterator[tuple[str, str, int]]:
    """Pairs of keys whose value is on the next line, or, after `|` or `>`, on all lines that are indented more."""
    at = 0
    while m := _BLOCK.search(text, at):
        at = m.end()
        while name_score(m[2]) and at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line = text[at:end]
            held = line.strip()
            if held and len(line) - len(line.lstrip()) <= len(m[1]):
                break
            if held and (m[3] or not re.match(r"[\w.-]++[\"']?\s*+[:=](?:\s|$)", held)):
                value = held.strip("\"',")
                yield m[2], value, at + line.find(value)
            if not m[3]:
                break
            at = end + 1


#: Longer than any word of `_DULL`, whose other patterns look at the beginning and the end.
HEAD = 64


class Literal:
    """What a name stands for: its parts, each the span of a literal or another such value, and what the score needs of them.

    Parts are shared and not copied, so a text's values together are as large as the text even where each takes
    up the one before, or itself twice.
    """

    __slots__ = ("parts", "head", "last", "counts", "length")

    def __init__(self, parts: list[tuple[str, int, int] | Literal]):
        self.parts = [p if isinstance(p, Literal) else p[1:] for p in parts]
        self.head = self.last = ""
        self.counts, self.length = Counter(), 0
        for p in parts:
            head, last, counts, length = (p.head, p.last, p.counts, p.length) if isinstance(p, Literal) else (p[0], p[0][-1:], Counter(p[0]), len(p[0]))
            self.head += head[: HEAD - len(self.head)]
            self.last = last or self.last
            self.length += length
            self.counts.update(counts)
        if any(c.isspace() for c in self.counts):
            self.counts = Counter(" ")  # no credential, nor anything that takes it up
        if self.length > 1e100:
            # Doubled hundreds of times: only the shares of the characters matter.
            self.length *= 1e-50
            self.counts = Counter({c: n * 1e-50 for c, n in self.counts.items()})

    def score(self) -> float:
        return literal_score(self.head + (self.last if self.length > HEAD else ""), self.counts, self.length)


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants, in order."""
    constants: dict[str, Literal] = {}
    found: set[tuple[int, int]] = set()
    taken: set[int] = set()
    values: list[Literal] = []
    for m in _PAIR.finditer(text):
        if m["value"] is None:
            continue
        name = m["quoted"] or m["name"]
        parts = [(m["value"], m.start("value"))]
        at = m.end("value")
        if _inside(m["value"]) or m["value"] in constants:
            while more := _MORE.match(text, at):
                parts.append((more[1], more.start(1)))
                at = more.end()
        pieces: list[tuple[str, int, int] | Literal] = []
        for v, start in parts:
            if own := _inside(v):
                held = v[own[0] : own[1]].strip()
                begin = start + v.find(held, own[0])
                # A template takes up constants; where it is nothing else, it is no literal.
                taken_up = [constants[n] for n in _TEMPLATE.findall(held) if n in constants] if "{" in held else []
                if not taken_up or _TEMPLATE.sub("", held):
                    pieces.append((held, begin, begin + len(held)))
                pieces += taken_up
            elif v in constants:
                pieces.append(constants[v])
            elif any(n in constants for n in re.split(r"\+|\|\||\?\?", v)):
                pieces += [constants[n] for n in re.split(r"\+|\|\||\?\?", v) if n in constants]
            elif len(parts) == 1 and text[at : at + 1] != "(":  # a call's name is no value
                pieces.append((v, start, start + len(v)))
        value = constants[name] = pieces[0] if len(pieces) == 1 and isinstance(pieces[0], Literal) else Literal(pieces)
        values.append(value)  # keeps it, so that its id is its own
        s = name_score(name)
        if s and value.parts and (s + value.score() >= THRESHOLD + 0.3 or (len(parts) == 1 and _inside(m["value"]) and _is_phrase(name, m["value"][slice(*_inside(m["value"]))]))):
            stack = [value]
            while stack:
                v = stack.pop()
                if id(v) in taken:
                    continue
                taken.add(id(v))
                for p in v.parts:
                    if isinstance(p, Literal):
                        stack.append(p)
                    elif p[1] > p[0]:
                        found.add(p)
    # The name in a keyed attribute is no value, although `key` is a name.
    found -= {(m.start(1), m.end(1)) for m in _KEYED.finditer(text)} if "value" in text else set()
    # In a tuple the name before the sign isn't the first value's.
    for m in _TUPLE.finditer(text) if "," in text and "=" in text else ():
        v, start = _literals(text, *m.span("values"))[0]
        found.discard((start, start + len(v)))
    for name, v, start in _stated(text):
        s = name_score(name)
        if v and s and (s + literal_score(v) >= THRESHOLD + 0.3 or _is_phrase(name, v)):
            found.add((start, start + len(v)))
    found |= {m.span(1) for m in _PEM.finditer(text)} if "PRIVATE KEY" in text else set()
    found |= {m.span(1) for m in _URL.finditer(text) if not _DULL.match(m[1]) and m[1].lower() not in SENSITIVE and not m[1].isdigit()} if "://" in text else set()
    found |= {m.span(1) for m in _BEARER.finditer(text) if literal_score(m[1]) > 0.5} if " " in text else set()
    return sorted(found)


def spans_of(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, in code points, by start, then kind as listed."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if ":" in text or "=" in text else []
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(x in text for x in (":", "=", "</", " -", "(", "#", "'", '"')) or text.startswith("-"):
        out += [(a, 3, b) for a, b in lexed(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _scan(text: pa.Array) -> pa.Array:
    n = {k: [] for k in KINDS}
    digest, joined = [], []
    for v in text:
        spans = spans_of(v.as_py())
        kinds = Counter(k for _, k, _ in spans)
        for k in KINDS:
            n[k].append(kinds[k])
        digest.append(hashlib.sha256(_joined([s for s in spans if s[1] != "named"]).encode()).hexdigest())
        joined.append(_joined(spans))
    cols = [pa.array(n[k], pa.int64()) for k in KINDS] + [pa.array(digest, pa.string()), pa.array(joined, pa.string())]
    return pa.StructArray.from_arrays(cols, names=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


_RESULT = "struct<n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_named, base_sha256, spans.

    Null and empty texts have no spans. Rows and their order within a text
    stand alone: repeated rows come out as often, extra columns are ignored.
    """
    return docs.select("doc_id", F.arrow_udf(_scan, _RESULT)("text").alias("s")).select("doc_id", "s.*")


def _mask(text: pa.Array) -> pa.Array:
    out = []
    for v in text:
        t = v.as_py()
        spans = spans_of(t)
        if not spans:
            out.append(t)
            continue
        pieces, at = [], 0
        for a, _, b in spans:
            if a > at or not pieces:
                pieces += [t[at:a], "[secret]"]
            at = max(at, b)
        out.append("".join(pieces) + t[at:])
    return pa.array(out, pa.string())


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by ``[secret]``, and n_chars, where it exists, counted again.

    Spans that overlap or touch become one mark. Null and empty texts stay; every row,
    repeated ones too, stands alone; an empty table gives no rows.
    """
    out = docs.withColumn("text", F.arrow_udf(_mask, "string")("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
