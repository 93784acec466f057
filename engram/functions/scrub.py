"""Redaction of secrets before anything is stored: known values, then a chain of replacements, one for each documented category."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"
#: Pattern and replacement, applied in this order.
RULES = (
    (r"\$argon2[a-z]*\$\S+", MARK),
    (r"\$2[abxy]?\$\d{2}\$[./A-Za-z0-9]{20,}", MARK),
    (r"\bsk-[A-Za-z0-9_-]{16,}", MARK),
    (r"\bgsk_[A-Za-z0-9]{16,}", MARK),
    (r"\bcsk-[A-Za-z0-9]{16,}", MARK),
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]{8,}", f"$1 {MARK}"),
    (r"\b([A-Z0-9_]*_TOKEN)=\S+", f"$1={MARK}"),
    (r"(?i)\b(password|passwd|secret|token)\b(\s*[:=]\s*)(\"[^\"]*\"|\S+)", f"$1$2{MARK}"),
)


#: Values that one regular expression tries at every place of a text; more are found by an automaton.
MOST_TRIED = 50


def redact(text: Column, values: Sequence[str]) -> Column:
    """Every occurrence of a value replaced by MARK: from the left, of values that start at one place the longest.

    However many values there are, a text is read once, by one node of the plan: a regular expression of a few values, and
    for more an automaton that each worker makes once, behind an Arrow batch. Empty values count as none; null stays null.
    """
    values = sorted({v for v in values if v}, key=lambda v: (-len(v), v))
    if not values:
        return text
    if len(values) <= MOST_TRIED:
        # \x{...} stands for any character, so no value is read as a pattern
        return F.regexp_replace(text, "|".join("".join(f"\\x{{{ord(c):x}}}" for c in v) for v in values), MARK)
    return F.pandas_udf(Redactor(values), "string")(text)


class Redactor:
    """Series of texts to redacted ones; the automaton is made where it is used."""

    def __init__(self, values: Sequence[str]):
        self.values, self.automaton = list(values), None
        self.__annotations__ = {"texts": pd.Series, "return": pd.Series}

    def __call__(self, texts: pd.Series) -> pd.Series:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for v in self.values:
                self.automaton.add_word(v, len(v))
            self.automaton.make_automaton()
        return texts.map(self.redacted, na_action="ignore")

    def redacted(self, text: str) -> str:
        out, at = [], 0
        # all occurrences; of those that overlap, the first, and of those that start at one place, the longest
        for start, less in sorted((end - length + 1, -length) for end, length in self.automaton.iter(text)):
            if start >= at:
                out.append(text[at:start])
                at = start - less
        return MARK.join([*out, text[at:]]) if out else text


def scrub(text: Column, blacklist: Sequence[str] = ()) -> Column:
    text = redact(text, blacklist)
    for pattern, into in RULES:
        text = F.regexp_replace(text, pattern, into)
    return text
