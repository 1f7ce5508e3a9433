"""Regular expressions and small text expressions shared by the jobs."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from grantlens.rules.relations import sql_literal

_WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_WORD_START, _WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_WORD_CLASS = r"\[[A-Za-z0-9\-]+\]"


def _alternatives(group: str) -> list[str]:
    parts, depth = [""], 0
    for ch in group:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return parts


def _inner(group: str) -> str | None:
    """Content of a plain or non-capturing group, None for look-around."""
    body = group[1:-1]
    if body.startswith("?:"):
        return body[2:]
    return None if body.startswith("?") else body


def _begins_with_word(rest: str) -> bool:
    if rest.startswith("("):
        depth = 0
        for i, ch in enumerate(rest):
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                inner = _inner(rest[:i + 1])
                return inner is not None and rest[i + 1:i + 2] not in ("?", "*", "{") and all(map(_begins_with_word, _alternatives(inner)))
        return False
    return re.match(rf"(?:[A-Za-z0-9]|\\d|{_WORD_CLASS})(?![?*]|\{{0)", rest) is not None


def _ends_with_word(head: str) -> bool:
    if head.endswith(")") and not head.endswith("\\)"):
        depth = 0
        for i in range(len(head) - 1, -1, -1):
            depth += (head[i] == ")") - (head[i] == "(")
            if depth == 0:
                inner = _inner(head[i:])
                return inner is not None and all(map(_ends_with_word, _alternatives(inner)))
        return False
    return re.search(rf"(?:(?<!\\)[A-Za-z0-9]|\\d\+?|(?:\\d|{_WORD_CLASS})\{{[1-9]\d*(?:,\d+)?\}}|(?<!\\)[A-Za-z0-9][A-Za-z0-9]\?)$", head) is not None


def _word_edges(pattern: str) -> str:
    """Spell out `\\b`: one look-around where the neighbouring rule text shows which side the word is on."""
    out, i = "", 0
    while i < len(pattern):
        token = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        if token == r"\b":
            out += _WORD_START if _begins_with_word(pattern[i + 2:]) else _WORD_END if _ends_with_word(pattern[:i]) else _WORD_EDGE
        else:
            out += token
        i += len(token)
    return out


def _item(rest: str) -> tuple[str, str | None, bool]:
    """The first item of a pattern, the content of a class of the characters it may begin with (None: any), whether it may be empty."""
    if rest.startswith("("):
        depth = i = 0
        while i < len(rest):
            if rest[i] == "\\":
                i += 1
            elif rest[i] == "[":
                i = rest.index("]", i + 2)
            else:
                depth += (rest[i] == "(") - (rest[i] == ")")
            if depth == 0:
                break
            i += 1
        item = rest[:i + 1]
        if item.startswith(("(?=", "(?!", "(?<=", "(?<!")):
            return item, "", True
        inner = _inner(item)
        return (item, None, True) if inner is None else (item, *_beginnings(inner))
    if rest.startswith("["):
        item = re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]", rest)[0]
        return item, None if item[1] in "^-]" or item[-2] == "-" or "[" in item[1:] or "&&" in item else item[1:-1], False
    if rest.startswith("\\"):
        item = rest[:2]
        return (item, "", True) if item == r"\b" else (item, None if item[1].isalnum() and item[1] not in "dsw" else item, False)
    if rest[0] in "^$":
        return rest[0], "", True
    return rest[0], None if rest[0] == "." else rf"\{rest[0]}" if rest[0] in "&-]#" else rest[0], False


def _beginnings(pattern: str) -> tuple[str | None, bool]:
    """The characters that a match may begin with, as the content of a class (None: any), and whether it may be empty."""
    found, empty = {}, False
    for part in _split(pattern):
        while part:
            item, begins, may_be_empty = _item(part)
            part = part[len(item):]
            times = re.match(r"(?:[?*+]|\{(\d+)(?:,\d*)?\})[?+]?", part)
            if times:
                part = part[times.end():]
                may_be_empty = may_be_empty or times[0][0] in "?*" or times[1] == "0"
            if begins is None:
                return None, True
            found[begins] = None
            if not may_be_empty:
                break
        else:
            empty = True
    return "".join(found), empty


def _split(pattern: str) -> list[str]:
    """Alternatives of a pattern; a bar in brackets or after a backslash separates none."""
    parts, part = [], ""
    while pattern:
        if pattern[0] == "|":
            parts, part, pattern = [*parts, part], "", pattern[1:]
        else:
            item = _item(pattern)[0]
            part, pattern = part + item, pattern[len(item):]
    return [*parts, part]


@functools.cache
def _guard(pattern: str) -> str:
    """A look-ahead for the characters that a match may begin with, so that most places of a text are passed by one test instead of all alternatives."""
    begins, empty = _beginnings(pattern)
    plain = begins is not None and len(begins) == 1 and not pattern.startswith("\\b")
    return "" if empty or not begins or plain else f"(?=[{begins}])"


#: Shorter literals are in nearly every text.
_LONG_ENOUGH = 3


@functools.cache
def _literals(pattern: str) -> tuple[str, ...]:
    """Literals of which every match holds at least one; none where an alternative has no long one."""
    found: list[str] = []
    for part in _split(pattern):
        options, run = [], ""
        while part:
            item, begins, may_be_empty = _item(part)
            part = part[len(item):]
            times = re.match(r"(?:[?*+]|\{(\d+)(?:,\d*)?\})[?+]?", part)
            part = part[times.end():] if times else part
            optional = times is not None and (times[0][0] in "?*" or times[1] == "0")
            if begins == "":
                continue
            literal = item[-1] if len(item) == 1 or (len(item) == 2 and not item[1].isalnum()) else ""
            if literal and literal != "." and not optional:
                run += literal
                if not times:
                    continue
            options, run = [*options, (run,)], ""
            if item[0] == "(" and not optional and _inner(item) is not None:
                options.append(_literals(_inner(item)))
        options = [o for o in [*options, (run,)] if o and min(map(len, o)) >= _LONG_ENOUGH]
        if not options:
            return ()
        found += max(options, key=lambda o: (min(map(len, o)), -len(o)))
    return tuple(dict.fromkeys(found)) if all(c.isascii() or c.lower() == c.upper() for c in "".join(found)) else ()


def java(pattern: str, ignore_case: bool = True, dot_all: bool = False) -> str:
    r"""A rule pattern for Spark: `\b` is an ASCII word edge whatever the JDK, as in the rule tables. What it matches is not changed by the look-ahead."""
    flags = ("i" if ignore_case else "") + ("s" if dot_all else "")
    guard, body = _guard(pattern), _word_edges(pattern)
    return (f"(?{flags})" if flags else "") + (f"{guard}(?:{body})" if guard else body)


def re2(pattern: str, ignore_case: bool = True, dot_all: bool = False) -> str:
    """The same pattern for the comparison SQL."""
    flags = ("i" if ignore_case else "") + ("s" if dot_all else "")
    return (f"(?{flags})" if flags else "") + pattern


def _may_hold(pattern: str, low: Column | str | None, ignore_case: bool) -> Column | None:
    """Whether a text, given in lower case (without `ignore_case` as it is), has a literal that a match must hold; None where nothing is known."""
    literals = [w.lower() if ignore_case else w for w in _literals(pattern)] if low is not None else []
    if isinstance(low, str):
        # One expression of a named column: each call on a Column is a message to the JVM, and rule tables have hundreds of literals.
        return F.expr(" or ".join(f"contains({low}, {sql_literal(w)})" for w in literals)) if literals else None
    return functools.reduce(lambda a, b: a | b, [low.contains(w) for w in literals]) if literals else None


def matches(text: Column, pattern: str, ignore_case: bool = True, dot_all: bool = False, low: Column | str | None = None) -> Column:
    """Whether the text holds the pattern. Where `low` is given, the text in lower case (without `ignore_case` the text itself) or the name of its column, texts
    without any of the literals that a match must hold are told apart by these, which costs far less than a search."""
    found, may = text.rlike(java(pattern, ignore_case, dot_all)), _may_hold(pattern, low, ignore_case)
    return found if may is None else may & found


def group(text: Column, pattern: str, index: int = 1, ignore_case: bool = True, low: Column | str | None = None) -> Column:
    """The capture of the first match, NULL when there is none or it is empty. `low` as for `matches`."""
    found, may = blank_to_null(F.regexp_extract(text, java(pattern, ignore_case), index)), _may_hold(pattern, low, ignore_case)
    return found if may is None else F.when(may, found)


def replace(text: Column, pattern: str, by: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, java(pattern, ignore_case), by)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly expression to a name, so that `body` can use it often and it runs once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_case(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first test that holds, else the default."""
    out = F.when(*cases[0])
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out.otherwise(default)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def present(text: Column) -> Column:
    """A string that carries a value: neither NULL nor empty."""
    return F.coalesce(text != "", F.lit(False))


#: A run of white space other than a single blank, which may stay as it is.
_RUN = r"[\t\n\x0B\f\r]\s*| \s+"


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, _RUN, " "))


def fill(template: str, *values: Column) -> Column:
    """Put values into the `{}` places of a label."""
    parts = template.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for value, tail in zip(values, parts[1:], strict=False):
        out += [value.cast("string"), F.lit(tail)]
    return F.concat(*out) if len(out) > 1 else out[0]


def words(text: Column) -> Column:
    """Non-empty words of a text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def alnum_upper(text: Column) -> Column:
    """Evaluation normal form: upper-case letters and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unfolded(rows: DataFrame, keep: list, entries: Column, name: str) -> DataFrame:
    """One row per entry of an array whose entries are never NULL, as explode() gives them.

    From explode() Spark infers a filter on the array and moves it below the projections that build the array, so that
    it computes all of them again, and what they share once per use; from explode_outer() it infers none.
    """
    return rows.select(*keep, F.explode_outer(entries).alias(name)).filter(F.col(name).isNotNull())
