"""Word tokens by the conventions of the Penn Treebank, sentence by sentence, as a Python function and a column."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.pandas.functions import pandas_udf

_END = re.compile(r"([.!?][\"')\]]*)\s+(?=[^\W_a-z])")
_STEPS = [
    (re.compile(r'^"'), "`` "), (re.compile(r'([ (\[{<])"'), r"\1 `` "),
    (re.compile(r"\.\.\.+"), " ... "), (re.compile(r"([,:])(?!\d)"), r" \1 "), (re.compile(r"[;@#$%&?!*()\[\]{}<>]"), r" \g<0> "), (re.compile(r"--+"), r" \g<0> "),
    (re.compile(r"([^.])(\.)([\])}>\"']*)\s*$"), r"\1 \2 \3"), (re.compile(r'"'), " '' "), (re.compile(r"([^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE)\b"), r"\1 \2"), (re.compile(r"([^' ])(n't|N'T)\b"), r"\1 \2"),
    (re.compile(r"\b(can)(not)\b", re.IGNORECASE), r"\1 \2"), (re.compile(r"\b(gon|wan)(na)\b", re.IGNORECASE), r"\1 \2"), (re.compile(r"\b(got)(ta)\b", re.IGNORECASE), r"\1 \2"), (re.compile(r"\b(gim|lem)(me)\b", re.IGNORECASE), r"\1 \2"),
]


def treebank(text: str) -> list[str]:
    out: list[str] = []
    for sentence in _END.sub("\\1\x00", text).split("\x00"):
        s = sentence.strip()
        for pattern, to in _STEPS:
            s = pattern.sub(to, s)
        out += s.split()
    return out


def treebank_tokens(c: Column) -> Column:
    @pandas_udf("array<string>")
    def tok(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else treebank(t))

    return tok(c)
