"""A search line as Spark Columns: tokens are AND-ed, `|` between tokens ORs them, `!` negates.

Atoms: plain text (in the name), `*`/`?` (glob), text with `/` or `~` (path), and ext: kind: file:
folder: size: dm: path: case: regex:. What cannot be understood is reported and left out.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
import re._parser as sre
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote_to_bytes
from zoneinfo import ZoneInfo

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import names

UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9}
MOST = 2**63 - 1


@dataclass
class Atom:
    kind: str
    value: object
    negated: bool = False
    ancestors: bool = False  # a plain negated word also excludes what lies in folders of that name


class Problem(NamedTuple):
    """What cannot be understood (regex, kind, size or date), and where it stands in the line: from start, end exclusive."""

    kind: str
    token: str
    start: int
    end: int


@dataclass
class Search:
    clauses: list[list[Atom]]
    problems: list[Problem] = field(default_factory=list)

    @property
    def timed(self) -> bool:
        """Whether the result depends on the time of the search."""
        return any(a.kind == "modified" for c in self.clauses for a in c)


def size_range(text: str) -> tuple[int, int] | None:
    """`>n`, `<n`, `a..b` or `n` with units of 1000; decimals are cut off."""

    def number(x: str) -> int | None:
        m = re.fullmatch(r"((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]{1,3})?)(b|kb|mb|gb)?", x.strip().lower())
        n = float(m[1]) * UNITS[m[2] or ""] if m else None
        return int(n) if n is not None and n < MOST else None

    if text[:1] in "<>" and text:
        n = number(text[1:])
        return None if n is None else ((n + 1, MOST) if text[0] == ">" else (0, n - 1) if n > 0 else None)
    low, dots, high = text.partition("..")
    a, b = number(low), number(high) if dots else number(low)
    return None if a is None or b is None or a > b else (a, b)


def date_range(text: str, now: int, zone: str = "UTC", first_weekday: int = 0) -> tuple[int, int] | None:
    """Whole seconds, both ends in: today, yesterday, week, month, year, Nh Nd Nw, dates, `>d`, `<d`, `a..b`.

    Days begin at midnight in the zone, weeks on first_weekday (0 is Monday).
    """
    where = ZoneInfo(zone)
    at = dt.datetime.fromtimestamp(now, where)
    day = at.replace(hour=0, minute=0, second=0, microsecond=0, fold=0)
    stamp = lambda x: max(0, int(x.timestamp()))
    starts = {"today": day, "week": day - dt.timedelta(days=(day.weekday() - first_weekday) % 7), "month": day.replace(day=1), "year": day.replace(month=1, day=1)}
    if text in starts:
        days = {"today": 1, "week": 7, "month": calendar.monthrange(day.year, day.month)[1], "year": 366 if calendar.isleap(day.year) else 365}[text]
        return stamp(starts[text]), stamp(starts[text] + dt.timedelta(days=days)) - 1
    if text == "yesterday":
        return stamp(day - dt.timedelta(days=1)), stamp(day) - 1
    if m := re.fullmatch(r"(\d+)([hdw])", text):
        back = int(m[1]) * {"h": 3600, "d": 86_400, "w": 604_800}[m[2]]
        return (now - back, now) if 0 <= back <= 100 * 365 * 86_400 else None

    def whole(x: str) -> tuple[int, int] | None:
        m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", x)
        if not m or int(m[1]) < 1970:
            return None
        try:
            first = dt.datetime(int(m[1]), int(m[2] or 1), int(m[3] or 1), tzinfo=where)
        except ValueError:
            return None
        days = 1 if m[3] else calendar.monthrange(first.year, first.month)[1] if m[2] else 366 if calendar.isleap(first.year) else 365
        return stamp(first), stamp(first + dt.timedelta(days=days)) - 1

    if text[:1] in ("<", ">"):
        d = whole(text[1:])
        return None if d is None else (d[1] + 1, MOST) if text[0] == ">" else (0, d[0] - 1) if d[0] > 0 else None
    low, dots, high = text.partition("..")
    a, b = whole(low), whole(high if dots else low)
    return (a[0], b[1]) if a and b and a[0] <= b[1] else None


def _is_pattern(value: str) -> bool:
    """Whether the engine that will run a pattern takes it: Java's where a session is open, else Python's as a guess."""
    context = SparkContext._active_spark_context
    try:
        if context is None:
            re.compile(value)
        else:
            context._jvm.java.util.regex.Pattern.compile(value)
    except (re.error, Py4JJavaError, PySparkException):
        return False
    return True


def _atom(token: str, when: Callable[[str], tuple[int, int] | None]) -> Atom | str:
    """The atom of a token, or what is wrong with it."""
    negated, body = token.startswith("!"), token[token.startswith("!") :]
    plain = negated and not re.search(r"[:/*?]", body) and not body.startswith("~")
    key, colon, value = body.partition(":")
    key = key.lower() if colon else ""
    low = body.lower()
    if key == "ext" and (exts := [e for x in value.split(";") if re.fullmatch(r"[\x00-\x7F]{1,8}", e := x.strip().lower())]):
        return Atom("ext", exts, negated)
    if key == "kind":
        return Atom("kind", names.KIND_NAMES.index(value.lower()) + 1, negated) if value.lower() in names.KIND_NAMES else "kind"
    if key in ("file", "folder"):
        return Atom(key, value.lower(), negated)
    if key in ("size", "dm"):
        bounds = size_range(value) if key == "size" else when(value.lower())
        return Atom("size" if key == "size" else "modified", bounds, negated) if bounds else "size" if key == "size" else "date"
    if key == "path":
        return Atom("path", value.lower(), negated)
    if key == "case":
        return Atom("case", value, negated)
    if key == "regex":
        return Atom("regex", value, negated) if _is_pattern(value) else "regex"
    if not colon and re.search(r"[*?]", low):
        return Atom("glob", low, negated)
    if not colon and ("/" in low or low.startswith("~")):
        return Atom("path", low, negated)
    return Atom("name", low, negated, plain)


def pasted(line: str) -> str:
    """A pasted path as it is on disk: without its quotes, `file://host`, %-codes, backslashes before blanks and signs, and
    `:line:column` behind a name with a dot. A line that does not look like a path stays as it is."""
    text = line.strip()
    if "/" not in text and not text.startswith(("~", "file:")):
        return line
    if m := re.fullmatch(r"""(['"])((?:\\.|(?!\1)[^\\])*)\1""", text, re.DOTALL):
        text = m[2]
    if (m := re.fullmatch(r"file://[^/]*(/.*)", text, re.DOTALL)) and not re.search("%(?![0-9A-Fa-f]{2})", m[1]):
        try:
            text = unquote_to_bytes(m[1]).decode()
        except UnicodeDecodeError:
            pass  # no path in UTF-8: left as it is
    text = re.sub(r"""\\([ ()'"&;\[\]])""", r"\1", text)
    m = re.fullmatch(r"(.*?)(?::[0-9]+){1,2}", text, re.DOTALL)
    return m[1] if m and "." in m[1].rpartition("/")[2] else text


_TOKENS = re.compile(r'\||(?:"[^"]*"?|[^\s|"])+')


def _placed(line: str) -> list[tuple[str, int, int]]:
    """Tokens that are no `|`, without their quotes and `!`, and where they stand in the line as it was given."""
    found = [(m[0].replace('"', ""), m.start(), m.end()) for m in _TOKENS.finditer(line) if m[0] != "|"]
    return [(pasted(token.removeprefix("!")).lower(), a, b) for token, a, b in found]


def understand(
    line: str, now: int, is_path: Callable[[str], bool] | None = None, *, zone: str = "UTC", first_weekday: int = 0, caret: int | None = None, composing: bool = False
) -> Search:
    """Quotes keep blanks and `|` in a token; no parentheses; OR binds tighter than AND. The line is taken in NFC.

    A whole line with a slash and blanks that is_path knows is one atom. Problems of a token in which the
    caret stands are not told, none are while an input method composes.
    """
    given = line
    line = unicodedata.normalize("NFC", pasted(line))
    if is_path and "/" in line and re.search(r"\s", line) and is_path(line):
        return Search([[Atom("path", line.lower())]])
    clauses, problems, joined, places = [], [], False, _placed(given)
    for m in _TOKENS.finditer(line):
        if m[0] == "|":
            joined = bool(clauses)
            continue
        token = m[0].replace('"', "")
        if token in ("", "!"):
            continue
        atom = _atom(token, lambda text: date_range(text, now, zone, first_weekday))
        if not joined:
            clauses.append([])
        joined = False
        key = token.removeprefix("!").lower().partition(":")[0] + ":"
        at = next((k for k, x in enumerate(places) if ":" in token and x[0].startswith(key)), None)
        _, start, end = ("", m.start(), m.end()) if at is None else places[at]
        if at is not None:
            places = places[at + 1 :]
        if isinstance(atom, str):
            if not composing and (caret is None or not start <= caret <= end):
                problems.append(Problem(atom, token, start, end))
        else:
            clauses[-1].append(atom)
    clauses = [c for c in clauses if c]
    if not clauses and line.strip(' |"'):
        clauses = [[Atom("name", line.strip().lower())]]
    return Search(clauses, problems)


def literals(search: Search) -> list[str]:
    """What a result's name is highlighted for: words that are asked for, and the parts of globs between their wildcards."""
    out = []
    for clause in search.clauses:
        for a in clause:
            if a.negated:
                continue
            if a.kind in ("name", "case") or (a.kind in ("file", "folder") and len(clause) == 1):
                out.append(a.value.lower())
            elif a.kind == "glob":
                out += re.split("[*?]", a.value)
    return list(dict.fromkeys(x for x in out if x))


def path_pattern(value: str, home: str, root: str = "/") -> str:
    """What rel_path must contain; an empty inner component stands for any one name."""
    if value.startswith("~"):
        value = home + value[1:]
    if root != "/" and value.startswith(root):
        value = value[len(root) :] or "/"
    return re.sub(r"(?<=/)(?=/)", "[^/]*", re.sub(r"[^/\w]", lambda m: re.escape(m[0]), value))


def _name(value: str, syllables: bool = True) -> Column:
    return F.col("folded").contains(value) | _keyed(lambda k: k.contains(value), value, syllables) if value else F.lit(True)


def _keyed(test: Callable[[Column], Column], needle: str, syllables: bool) -> Column:
    """Whether an alternate key passes: those of Han names for ASCII needles, where they are wanted; all keys for others."""
    some = F.exists("alt_keys", test)
    return some if not needle.isascii() else (F.size("alt_keys") == 2) & some if syllables else F.lit(False)  # Han names have two


#: Seconds that a pattern may take for one entry.
BUDGET = 0.02


def _repeats(items: list, inside: bool = False) -> tuple[int, bool]:
    """How many open repeats a parsed pattern has, and whether one of them stands in or around another choice."""
    n, nested = 0, False
    for op, value in items:
        name, open_ = str(op), False
        parts = [x for x in (value if isinstance(value, (list, tuple)) else [value]) if isinstance(x, sre.SubPattern)]
        if name == "BRANCH":
            parts, nested = value[1], nested or inside
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            open_ = value[1] == sre.MAXREPEAT or value[1] > 9
            nested |= inside and value[0] != value[1]
            n += open_
        for part in parts:
            more, deep = _repeats(part.data, inside or open_)
            n, nested = n + more, nested or deep
    return n, nested


def may_explode(pattern: str) -> bool:
    """Whether matching may take more than about the cube of a name's length: choices inside an open repeat, or many open repeats.

    What Python's parser does not know counts as such.
    """
    try:
        n, nested = _repeats(sre.parse(pattern).data)
    except (re.error, OverflowError, RecursionError):
        return True
    return nested or n > 3


def _budgeted(target: Column, pattern: str, seconds: float = BUDGET) -> Column | None:
    """Whether target holds a match, null where that takes longer than the budget; None if the other engine refuses the pattern."""
    import regex

    try:
        regex.compile(pattern)
    except regex.error:
        return None

    @F.arrow_udf("boolean")
    def search(texts: pa.Array) -> pa.Array:
        own, out = regex.compile(pattern), []
        for text in texts:
            try:
                out.append(text.as_py() is not None and own.search(text.as_py(), timeout=seconds) is not None)
            except TimeoutError:
                out.append(None)
        return pa.array(out, pa.bool_())

    return search(target)


def matches(a: Atom, home: str = "/", root: str = "/", syllables: bool = True) -> Column:
    """Predicate of an atom over catalog columns, before negation; null where a pattern's budget ran out."""
    v = a.value
    if a.kind == "name":
        if not a.ancestors:
            return _name(v, syllables)
        if v in root.lower().split("/"):
            return F.lit(True)
        return _name(v, syllables) | F.exists("ancestors", lambda x: (names.fold(x) == v) | (F.lower(x) == v))
    if a.kind == "case":
        return F.col("name").contains(v)
    if a.kind == "file":
        return (F.col("kind") != 1) & _name(v, syllables)
    if a.kind == "folder":
        return (F.col("kind") == 1) & _name(v, syllables)
    if a.kind == "path":
        pattern = path_pattern(v, home, root)
        whole = F.concat(names.fold(F.col("rel_path")), F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")))
        plain = home.lower() + v[1:] if v.startswith("~") else v
        plain = plain[len(root) :] or "/" if root != "/" and plain.startswith(root.lower()) else plain
        return whole.rlike(pattern) if "[^/]*" in pattern else whole.contains(plain)
    if a.kind == "glob":
        return (names.fold(F.col("rel_path")) if "/" in v else F.col("folded")).rlike(names.glob_regex(v))
    if a.kind == "regex":
        target = F.col("rel_path" if "/" in v else "name")
        literal = re.match(r"\^([\w ]+)(?![*?{|\w ])", v)
        hit = _budgeted(target, v) if may_explode(v) else None
        if hit is not None:
            return hit
        hit = target.rlike(v)
        return target.startswith(literal[1]) & hit if literal and "|" not in v else hit
    if a.kind == "ext":
        hit = F.col("ext").isin(v)
        kinds = {k for k, e in names.KIND_EXTENSIONS.items() if not {*e.split()}.isdisjoint(v)}
        known = {*" ".join(names.KIND_EXTENSIONS.values()).split()}
        return F.col("kind").isin([1, *sorted(kinds)]) & hit if known.issuperset(v) else hit  # lets partitions by kind be skipped
    if a.kind == "kind":
        return F.col("kind") == v
    low, high = v
    return F.col("size" if a.kind == "size" else "mtime").between(low, high)


def predicate(search: Search, home: str = "/", root: str = "/", syllables: bool = True) -> Column:
    """Clauses without a negation first, the one with the longest shortest word before all others.

    An entry that a pattern took too long for is left out, negated or not, unless an alternative before it has matched.
    """

    def weight(clause: list[Atom]) -> tuple:
        return any(a.negated for a in clause), -min(len(a.value) if a.kind == "name" else 0 for a in clause)

    def one(a: Atom) -> Column:
        hit = matches(a, home, root, syllables)
        return ~hit if a.negated else hit

    def whole(clause: list[Atom]) -> Column:
        if not any(a.kind == "regex" for a in clause):
            return reduce(Column.__or__, map(one, clause))
        first, *others = map(one, clause)
        out = F.when(first, True).when(first.isNull(), False)
        for x in others:
            out = out.when(x, True).when(x.isNull(), False)
        return out.otherwise(False) if others else first

    clauses = [whole(c) for c in sorted(search.clauses, key=weight)]
    return reduce(Column.__and__, clauses) if clauses else F.lit(True)


def score(search: Search, now: int, syllables: bool = True) -> Column:
    """Integer relevance of a row that matches."""
    zero = F.lit(0)
    total, hits, length = zero, zero, zero
    for a in (a for c in search.clauses for a in c if not a.negated and a.kind in ("name", "case", "file", "folder") and a.value):
        if a.kind == "case":
            quality = names.match_quality(F.col("name"), F.col("name"), a.value)
        else:
            quality = names.match_quality(F.col("name"), F.col("folded"), a.value)
        base = F.when(quality > 0, quality * 200 + 200).otherwise(zero if a.kind == "case" else _alternate(a.value, syllables))
        if a.kind in ("file", "folder"):
            base = F.when((F.col("kind") != 1) if a.kind == "file" else (F.col("kind") == 1), base).otherwise(zero)
        hit = (base > 0).cast("int")
        total, hits, length = total + base, hits + hit, length + hit * len(a.value.encode())
    rest = F.least(F.greatest(F.octet_length("name") - length, zero), F.lit(64))
    text = F.when(hits == 0, F.lit(400)).otherwise(F.floor(total / F.greatest(hits, F.lit(1))).cast("int") - 2 * rest)
    return (text + F.expr(f"{_BONUS} + {names.recency_sql('mtime', now)}")).cast("int")


#: Points that do not depend on the words searched for.
_BONUS = """if(user_area AND NOT noise AND NOT in_package AND NOT hidden, 60, 0) + CASE kind WHEN 2 THEN 150 WHEN 1 THEN 20 ELSE 0 END
  - if(noise, 350, 0) - if(in_package, 300, 0) - if(hidden, 200, 0) - 5 * least(depth, 16)"""


def _alternate(needle: str, syllables: bool) -> Column:
    """Points of a hit in an alternate key: 500 at the start of a syllable key, else 350."""
    some = _keyed(lambda k: k.contains(needle), needle, syllables)
    first = _keyed(lambda k: k.startswith(needle), needle, syllables) if needle.isascii() else F.lit(False)
    return F.when(first, 500).when(some, 350).otherwise(0)
