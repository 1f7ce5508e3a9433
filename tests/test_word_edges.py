"""The spelled-out word edges agree with `\b` over ASCII for every rule pattern."""

import random
import re

from grantlens.functions import text as T
from grantlens.functions.categories import COURSE_PATTERNS, GENDER_PATTERNS, LEVEL_PATTERNS, STATE_PATTERNS
from grantlens.rules import documents as D, extraction as X, utterances as U


def strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from strings(k)
            yield from strings(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from strings(v)


def test_spelled_out_edges():
    sources = [COURSE_PATTERNS, GENDER_PATTERNS, LEVEL_PATTERNS, STATE_PATTERNS]
    sources += [v for m in (D, X, U) for k, v in vars(m).items() if k.isupper() or k.startswith("_A")]
    patterns = sorted({p for s in sources for p in strings(s) if r"\b" in p})
    assert len(patterns) > 80
    rng = random.Random(3)
    pieces = sorted({w for p in patterns for w in re.findall(r"[A-Za-z0-9]+", p)})
    joints = [" ", " ", "-", ".", "_", "", "é", "1", "%", ": ", "/", "+"]
    for p in patterns:
        own = re.findall(r"[A-Za-z0-9.+%]+", p) or ["x"]
        spelled, plain = re.compile(T.java(p), re.A), re.compile("(?i)" + p, re.A)
        for _ in range(60):
            text = "".join(rng.choice(own if rng.random() < 0.7 else pieces) + rng.choice(joints) for _ in range(rng.randint(1, 6)))
            a, b = spelled.search(text), plain.search(text)
            assert (a and a.span()) == (b and b.span()), (p, text)
