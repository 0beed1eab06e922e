"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, scheme marks and the cue words of identifiers.
Only there deterministic parsers look at the text: they expand to the boundaries of the item and validate it
(domain labels, address parts, digit counts, Luhn and mod-97 checks). Text without an anchor costs the pass alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Kinds in the order that breaks ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "login", "secret", "iban", "account")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int>>"

# Anchors and the cues before identifiers. Cues are also found capitalised and in capitals.
_CUES = {
    "secret": ("password", "passwd", "passwort", "api_key", "api-key", "apikey", "secret", "token"),
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "compte", "cuenta"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9.]+")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_SECRET = re.compile(r"\s?[=:]\s?[\"']?([^\s\"',;]{6,})")
_CLOUD_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[:#]?\s{0,2}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\s?(?:no|nr|number|nummer|num)\b\.?)?\s?[:#]?\s?([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _addresses(text: str, at: int, end: int) -> Iterator[tuple[int, str, int]]:
    """Addresses in a stretch of digits and dots: four numbers with one dot between, taken from the left; parts over 255 spoil the four."""
    numbers = [m.span() for m in _NUMBER.finditer(text, at, end)]
    i = 0
    while i + 4 <= len(numbers):
        four = numbers[i : i + 4]
        if any(b[0] - a[1] != 1 for a, b in zip(four, four[1:])):
            i += 1
            continue
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (text[a:z].lstrip("0") for a, z in four)):
            yield four[0][0], "ip", four[3][1]
        i += 4


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    found.add_word("AKIA", ("cloud", 4))
    found.add_word("ASIA", ("cloud", 4))
    for kind, cues in _CUES.items():
        for cue in cues:
            for word in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) in order; ends are exclusive, positions code points."""
    out: list[tuple[int, str, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (what, n) in automaton.iter(text):
        at = last - n + 1
        if what == "digit":
            if at >= done["card"]:
                # Digits with single blanks or hyphens between them: one candidate, judged whole.
                m = _GROUPED.match(text, at)
                done["card"] = m.end()
                if m.end() - at >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                    out.append((at, "card", m.end()))
            if at >= done["ip"]:
                end = _DOTTED.match(text, at).end()
                done["ip"] = end
                out += _addresses(text, at, end)
        elif what == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, "email", m.end()))
                done["email"] = m.end()
        elif what == "plus":
            if (m := _DIALLED.match(text, at)) and 10 <= len(_digits(m[0])) <= 15:
                out.append((at, "phone", m.end()))
        elif what == "scheme":
            if m := _LOGIN.match(text, at):
                out.append((at + 3, "login", m.end()))
        elif what == "cloud":
            if m := _CLOUD_KEY.match(text, at):
                out.append((at, "secret", m.end()))
        elif what == "secret":
            if last >= done["secret"] and (m := _SECRET.match(text, last + 1)):
                out.append((m.start(1), "secret", m.end(1)))
                done["secret"] = m.end(1)
        elif what == "iban":
            if m := _IBAN.match(text, last + 1):
                # The longest beginning that passes the check.
                for end in range(m.end(1), m.start(1) + 14, -1):
                    if text[end - 1] != " " and _mod97(text[m.start(1) : end].replace(" ", "")):
                        out.append((m.start(1), "iban", end))
                        break
        elif m := _ACCOUNT.match(text, last + 1):
            out.append((m.start(1), "account", m.end(1)))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    automaton = anchors()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for column in texts:
        yield pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in find(x.as_py() or "", automaton)] for x in column], shape)


def _masked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    automaton = anchors()
    for column in texts:
        yield pa.array([mask(x.as_py(), automaton) for x in column], pa.string())


def mask(text: str | None, automaton: ahocorasick.Automaton) -> str | None:
    """Each stretch of overlapping spans becomes the name of its first kind in angle brackets."""
    if not text:
        return text
    out, done = [], 0
    for start, kind, end in find(text, automaton):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of a text column; null and empty texts have none, and the time taken follows a text's length."""
    return F.arrow_udf(_spans, SPANS)(text)


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, spans). Each row by itself: ids may be null or repeat, other columns are not read."""
    return docs.select("doc_id", spans(text_of()).alias("spans"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` masked. Null texts stay null, all columns stay."""
    return docs.withColumn("text", F.arrow_udf(_masked, "string")(F.col("text")))
