"""Personal data by anchor expansion.

An Aho-Corasick automaton finds cues (at-signs, plus signs, digits, schemes, words that announce an
account). Around a cue the longest run of characters that its kind may hold is the window; a local
parser then finds the exact borders in the window and validates them. A match of a kind can't leave
its window, so parsing windows from left to right finds what a search of the whole text would. The time
grows with the text's length whatever it holds: an address has one at-sign, so its local part is the run of
characters before that, and the host is matched once from there; numbers are tried at the start of their digits only.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account")

# The base patterns, and the digits that a card or a phone number has.
_PATTERN = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Of an address, the characters before its at-sign and what follows that.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CARD_DIGITS, _PHONE_DIGITS = (16, 19), (8, 15)

# The characters a window of each kind holds, to the left and to the right of its cue.
_WINDOW = {
    "ip": (re.compile(r"[0-9.]*"), "0123456789."),
    "card": (re.compile(r"[\x200-9-]*"), "0123456789 -"),
    "phone": (re.compile(r"[\x20().0-9+-]*"), "0123456789 ().+-"),
}
#: The user part of an address with a scheme: a name, a password and an at-sign before the host.
_LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)")
_ACCOUNT = re.compile(r"(?:\s*(?:no\.?|number|nr\.?|id))?\s*[:=#]?\s*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT_CUES = ("iban", "IBAN", "Iban", "account", "Account", "ACCOUNT")
#: How far after its cue an account number may begin and end: what the pattern can hold at most.
_ACCOUNT_REACH = 80

_DIGITS = frozenset("0123456789")


def _automaton():
    cues = ahocorasick.Automaton()
    for digit in "0123456789":
        cues.add_word(digit, ("digit", 1))
    cues.add_word("@", ("at", 1))
    cues.add_word("+", ("plus", 1))
    cues.add_word("://", ("scheme", 3))
    for word in _ACCOUNT_CUES:
        cues.add_word(word, ("account", len(word)))
    cues.make_automaton()
    return cues


_CUES = None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban(code: str) -> bool:
    """The check digits of an international account number."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


_VALID = {
    "ip": lambda m: all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.split(".")),
    "card": lambda m: _CARD_DIGITS[0] <= len(d := _digits(m)) <= _CARD_DIGITS[1] and luhn(d),
    "phone": lambda m: _PHONE_DIGITS[0] <= len(_digits(m)) <= _PHONE_DIGITS[1],
}


def _window(kind: str, text: str, cue: int, start: int) -> tuple[int, int]:
    """The run of the kind's characters around a cue, from `start` at the earliest."""
    right, left = _WINDOW[kind]
    a = cue
    while a > start and text[a - 1] in left:
        a -= 1
    return a, right.match(text, cue).end()


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text, in code points, end exclusive; by kind as in KINDS, then start."""
    if not text:
        return []
    global _CUES
    if _CUES is None:
        _CUES = _automaton()
    done = dict.fromkeys(KINDS, 0)
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}

    def parse(kind: str, cue: int) -> None:
        if cue < done[kind]:
            return
        a, b = _window(kind, text, cue, done[kind])
        done[kind] = b
        for m in _PATTERN[kind].finditer(text, a, b):
            if _VALID[kind](m[0]):
                found[kind].append((kind, m.start(), m.end()))

    def address(at: int) -> None:
        """The longest local part before an at-sign, behind the last address and the last at-sign, and the host after it."""
        a = at
        while a > done["email"] and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _HOST.match(text, at + 1)):
            found["email"].append(("email", a, m.end()))
            done["email"] = m.end()

    for last, (cue, length) in _CUES.iter(text):
        if cue == "digit":
            if last >= done["ip"]:
                parse("ip", last)
            if last >= done["card"]:
                parse("card", last)
        elif cue == "at":
            address(last)
        elif cue == "plus":
            parse("phone", last)
        elif cue == "scheme":
            if m := _LOGIN.match(text, last + 1):
                found["login"].append(("login", m.start(), m.end()))
        elif last >= done["account"] and (m := _ACCOUNT.match(text, last + 1, last + 1 + _ACCOUNT_REACH)) and iban(m[1]):
            found["account"].append(("account", m.start(1), m.end(1)))
            done["account"] = m.end(1)
    return [s for k in KINDS for s in found[k]]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind; of spans that overlap, the union by the kind listed first."""
    if not spans:
        return text
    order = {k: i for i, k in enumerate(KINDS)}
    out, at = [], 0
    runs: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
            runs[-1][0] = min(runs[-1][0], k, key=order.get)
        else:
            runs.append([k, a, b])
    for k, a, b in runs:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_FOUND = "struct<n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean string>"


def with_personal_data(docs: DataFrame, text: str = "text", clean: bool = False) -> DataFrame:
    """`docs` with a struct `personal`: counts of the base kinds, digest of their spans, all spans and, if asked for, the redacted text.

    Null text counts as empty and stays null; whole texts are searched, whatever their length. Rows are
    judged one by one: repeated rows and equal texts have equal results, an empty table has no rows, and of other
    columns only one named `personal` is replaced.
    """

    @F.pandas_udf(_FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = find(t)
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), redacted(t, spans) if clean else None))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean"])

    return docs.withColumn("personal", search(F.col(f"`{text}`")))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document; edge cases as in with_personal_data()."""
    return with_personal_data(docs.select("doc_id", "text")).select("doc_id", *[f"personal.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by its kind, and n_chars as the new text has it.

    Other columns stay as they are, whatever their names; null text and null n_chars stay null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = with_personal_data(docs.select(row, "text"), clean=True).select("row", F.col("personal.clean").alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("row.n_chars").isNotNull(), F.char_length(F.coalesce("clean", F.lit(""))).cast("long"))}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
