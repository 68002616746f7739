"""Text formatters: projections of a text column."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.arrow import parts
from ..functions.text import strip

#: Typographic and full-width marks by what replaces them.
_MARKS = {
    ",": "，、", ".": "。", '"': "„”“«»１」「《》", "'": "´’", ":": "∶：", "?": "？", "!": "！", "(": "（", ")": "）", ";": "；", "-": "–━►",
    " - ": "—", ". ": "．", "~": "～", "...": "…", "<": "〈", ">": "〉", "[": "【", "]": "】", "%": "％",
}
PUNCTUATION: dict[str, str] = {c: to for to, cs in _MARKS.items() for c in cs}

#: Spaces of all kinds, zero-width characters, the object replacement character and one control character.
SPACES = " " + "".join(map(chr, range(0x2000, 0x200B))) + "\u00a0\u202f\u205f\u3000\u200b\u200c\u200d\u2060\ufffc\u0084"


def punctuation(c: Column, marks: Mapping[str, str] = PUNCTUATION) -> Column:
    """Each key by its value, in one pass: no value is itself a key."""
    one = {k: v for k, v in marks.items() if len(k) == 1 and len(v) == 1}
    out = F.translate(c, "".join(one), "".join(one.values())) if one else c
    for k, v in marks.items():
        if k not in one:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def whitespace(c: Column, spaces: str = SPACES) -> Column:
    """Stripped, then each of spaces as an ordinary one; tabs and line breaks stay."""
    return F.translate(strip(c), spaces, " " * len(spaces))


def _java(pattern: str) -> str:
    m = re.fullmatch(r"r(['\"])(.*)\1", pattern, re.DOTALL)
    return m[2] if m else pattern


_FLAGS = {re.IGNORECASE: "i", re.MULTILINE: "m", re.DOTALL: "s", re.VERBOSE: "x"}


def regex(c: Column, patterns: Sequence[str], replacements: Sequence[str], flags: Sequence[int] = (0,), broadcast_flags: bool = False) -> Column:
    """re.sub for each pattern, its replacement and flags, in turn; the shortest of the three sequences sets the number.

    With broadcast_flags, a single flag holds for all. A pattern or replacement
    written as a raw string literal, r'...', is read without the wrapping.
    """
    if broadcast_flags and len(flags) == 1:
        flags = [flags[0]] * len(patterns)
    for p, r, f in zip(patterns, replacements, flags):
        inline = "".join(x for k, x in _FLAGS.items() if f & k)
        to = re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: f"${m[2]}" if m[2] else f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", _java(r).replace("$", r"\$"))
        c = F.regexp_replace(c, (f"(?{inline})" if inline else "") + _java(p).replace("(?P<", "(?<"), to)
    return c


_CURLY = str.maketrans({"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"'})
_LIGATURES = str.maketrans({"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st", "\u0132": "IJ", "\u0133": "ij"})
_CONTROL = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f\ufeff\ufff9-\ufffb\u206a-\u206f]")
_SURE = re.compile("[\u00c2\u00c3\u00c5\u00c4\u00c6\u00d0\u00d1\u00e2\u00f0][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2026\u2030\u2039\u203a\u20ac\u2122]")
FORMS = ("NFC", "NFKC", "NFD", "NFKD")


def _bytes(text: str) -> bytes:
    """Windows-1252 where it has the character, else Latin-1, as browsers decode."""
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            out += ch.encode("latin-1")
    return bytes(out)


def unmangle(text: str) -> str:
    """Undoes UTF-8 that was read as a one-byte encoding, as often as it was; stretches by themselves if not all of it was."""
    while _SURE.search(text):
        try:
            fixed = _bytes(text).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            break
        if fixed == text:
            return text
        text = fixed

    def part(m: re.Match[str]) -> str:
        try:
            return _bytes(m[0]).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m[0]

    while _SURE.search(text):
        fixed = re.sub("[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2026\u2030\u2039\u203a\u20ac\u2122]{2,}", part, text)
        if fixed == text:
            break
        text = fixed
    return text


def repair(text: str, normalization: str = "NFC") -> str:
    """Mojibake, HTML entities where there are no tags, ligatures, curly quotes, line breaks, control characters, then normalization."""
    while True:
        was = text
        if "&" in text and "<" not in text:
            text = html.unescape(text)
        text = unmangle(text)
        if text == was:
            break
    text = text.translate(_LIGATURES).translate(_CURLY)
    text = re.sub("\r\n?|\u2028|\u2029|\u0085", "\n", text)
    return unicodedata.normalize(normalization, _CONTROL.sub("", text))


def unicode_fix(c: Column, normalization: str = "NFC") -> Column:
    """repair() of each text; Arrow batches, a part at a time. Texts that are plain ASCII without & don't need a look."""
    if normalization not in FORMS:
        raise ValueError(f"normalization must be one of {', '.join(FORMS)}")

    @arrow_udf("string")
    def fix(s: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else repair(t, normalization) for t in x.to_pylist()], pa.string()) for x in parts([s]))])

    look = c.rlike("[^\\t\\n\\x20-\\x7e]|&")
    return F.when(look, fix(F.when(look, c))).otherwise(c)
