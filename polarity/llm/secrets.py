"""Secret scan: assignment-aware lexing.

Source and configuration syntax (``name = "literal"``, ``name: value``, ``"name": "value"``,
``NAME=value``, ``name: type = "literal"``, ``name := literal``, ``name => literal``, sums of
literals) is parsed into name-literal pairs; a name on the right-hand side stands for the literal
assigned to it earlier in the text (constants are propagated).  A literal's score is the
sensitivity of the name it is assigned to plus points for its length, its mixture of letters and
digits and its entropy, less points for placeholders and blanks; at ``MIN_SCORE`` it is reported as a
span of kind ``literal``, unless a base span covers it.  Base spans are the matches of three fixed
patterns (kinds assign, access, hex).

Texts are scanned whole, one at a time.  Defined results: null or empty text has no spans; rows that
repeat are scanned each; an empty table has an empty result; other columns take no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from polarity.llm.common import ship_by_value

ship_by_value(__name__)

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")     # 18 characters or more; a shorter run has no longer tail
_HEX = re.compile(r"[0-9a-f]{16,}")

# ---- lexing of assignments
_NAME = r"[A-Za-z_$][\w$]*+(?:[.\-][\w$]++){0,8}+"
_PAIR = re.compile(rf"""(?:(?P<quote>["'`])(?P<quoted>[^"'`\n]++)(?P=quote)|(?<![\w$])(?P<plain>{_NAME}))\]?[ \t]*+
                        (?P<sign>:=|=>|=(?![=>])|:(?![:=]))[ \t]*+""", re.ASCII | re.VERBOSE)
_STRING = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`""")
_REFERENCE = re.compile(rf"{_NAME}(?![\w$(\[/+=])", re.ASCII)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#]++""")
_TYPE = re.compile(r"""[\w.| \t]++|"[^"\n]*+"|'[^'\n]*+'""", re.ASCII)       # what a type has outside brackets
_BRACKETS = re.compile(r""""[^"\n]*+"|'[^'\n]*+'|[\[\](){}\n]""")
_EQUALS = re.compile(r"=(?![=>])[ \t]*+")
_WHOLE_NAME = re.compile(_NAME, re.ASCII)
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+")

# ---- scores
STRONG = frozenset("password passwd pwd passphrase secret token credential credentials apikey".split())
WEAK = frozenset("auth salt session cookie signature bearer pass".split())
KEYS = frozenset("api access private secret encryption signing account master service".split())  # ... key
PLACEHOLDER = re.compile(r"example|changeme|change_me|your|placeholder|dummy|xxxx|\*\*\*|\$\{|\{\{|%\(|<|(.)\1{7}", re.IGNORECASE)
#: Words that begin or end with a listed one and name no secret.
ORDINARY = re.compile(r"author(?!iz)\w*|\w*authored|passag\w*|passeng\w*|passiv\w*|passion\w*|passport\w*|passing|passed|passes|"
                      r"\w*compass|\w*bypass|\w*trespass|secretar\w*|tokeni[sz]\w*|saltwater|salty|cookies?cutter|possession|obsession")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_LETTERS = re.compile(r"[A-Za-z]+")
MIN_SCORE = 4
MIN_LENGTH = 8


def _ends(word: str, listed) -> bool:
    """Whether the word begins or ends with a listed one or its plural."""
    return not ORDINARY.fullmatch(word) and any(word.startswith(x) or word.endswith((x, x + "s", x + "es")) for x in listed)


_JOINED = STRONG | {k + "key" for k in KEYS}


def name_score(name: str) -> int:
    """2 for a name of secrets, 1 for one that may be, else 0."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    # runs of letters too: PASSWORDs, passWord
    if (any(_ends(p, _JOINED) for p in {*parts, *(x.lower() for x in _LETTERS.findall(name))})
            or any(a in KEYS and b in ("key", "keys") for a, b in zip(parts, parts[1:]))):
        return 2
    return int(any(_ends(p, WEAK) for p in parts))


def literal_score(value: str) -> int:
    if len(value) < MIN_LENGTH:
        return -9
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return ((n >= 20) + (entropy >= 3.0) + (any(c.isdigit() for c in value) and any(c.isalpha() for c in value))
            - 3 * bool(PLACEHOLDER.search(value)) - 2 * any(c.isspace() for c in value))


def _closers(text: str) -> dict[int, int]:
    """Where each bracket that is closed in its line ends, in one pass."""
    out, opened = {}, []
    for m in _BRACKETS.finditer(text):
        c = m[0]
        if c == "\n":
            opened = []
        elif c in "[({":
            opened.append((c, m.start()))
        elif c in "])}" and opened and opened[-1][0] == "[({"["])}".index(c)]:
            out[opened.pop()[1]] = m.end()
    return out


def _after_type(text: str, at: int, closers: dict[int, int]) -> tuple[int, int] | None:
    """(where the type that begins here ends, where the value behind its '=' begins); brackets are
    jumped over, and a scan ends at the next colon outside them, so that scans do not overlap."""
    begin = at
    while at < len(text):
        if m := _TYPE.match(text, at):
            at = m.end()
        elif text[at] in "[(" and at in closers:
            at = closers[at]
        elif at > begin and (m := _EQUALS.match(text, at)):
            return at, m.end()
        else:
            break
    return None


def assignments(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, literal, start, end) of every assignment of a literal or of a constant known by name;
    a constant's span is where its literal stands."""
    constants: dict[str, tuple[str, int, int]] = {}
    closers = _closers(text)
    at = 0
    while m := _PAIR.search(text, at):
        name, at = m["quoted"] or m["plain"], m.end()
        last = None
        if m["sign"] == ":" and (typed := _after_type(text, at, closers)):
            # in "note: the password = ..." the last word is the name
            words = text[at:typed[0]].split()
            last = words[-1] if len(words) > 1 and words[-2][-1].isalnum() and _WHOLE_NAME.fullmatch(words[-1]) else None
            at = typed[1]
        value, start, end = "", None, None
        while True:
            if s := _STRING.match(text, at):
                part, lo, hi, at = s[s.lastindex], s.start(s.lastindex), s.end(s.lastindex), s.end()
            elif (r := _REFERENCE.match(text, at)) and r[0] in constants:
                (part, lo, hi), at = constants[r[0]], r.end()
            elif (start is None and not _PAIR.match(text, at)      # in "a: b = c" b is a name, not a value
                  and (b := _BARE.match(text, at)) and not text.startswith("(", b.end())):
                part, lo, hi, at = b[0], b.start(), b.end(), b.end()
            else:
                break
            value += part
            start, end = (lo, hi) if start is None else (min(start, lo), max(end, hi))
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if start is not None:
            constants[name] = value, start, end
            yield name, value, start, end
            if last:
                yield last, value, start, end


def find(text: str | None, min_score: int = MIN_SCORE) -> list[tuple[str, int, int, str | None, int | None]]:
    """(kind, start, end, name, score) of all spans, by start, then kind as in ``KINDS``."""
    text = text or ""
    out = [("assign", m.start(), m.end(), m[1], None) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        out += [(kind, m.start(), m.end(), None, None) for m in pattern.finditer(text)]
    base = [(s, e) for _, s, e, _, _ in out]
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for name, value, start, end in assignments(text):
        if sensitive := name_score(name):
            score = sensitive + literal_score(value)
            if score >= min_score and score > best.get((start, end), (0, ""))[0] and not any(s <= start and end <= e for s, e in base):
                best[start, end] = score, name
    out += [("literal", s, e, name, score) for (s, e), (score, name) in best.items()]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind: string, start: bigint, end: bigint, name: string, score: int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("name", pa.string()), ("score", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: int = MIN_SCORE) -> DataFrame:
    """(id, spans) per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("kind", "start", "end", "name", "score")
        for b in batches:
            found = [[dict(zip(keys, x)) for x in find(t.as_py(), min_score)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, spans {SPANS}")
