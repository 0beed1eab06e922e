"""Licence scan by ordered signature rules.

A text becomes its lower-case words joined by blanks. One Aho-Corasick pass finds the rules' keywords; only the
regular expressions of found keywords are run. Of overlapping detections the ones that lie inside a detection of
higher priority, or inside a longer one of the same priority, are suppressed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .hashing import ALNUM, LOWER
from .license_rules import rules

_FOLD = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))
_SHAPE = pa.struct([
    ("n_words", pa.int64()),
    ("found", pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("base", pa.bool_()),
                                  ("first", pa.int64()), ("last", pa.int64()), ("kept", pa.bool_())]))),
])
SCHEMA = "struct<n_words:bigint,found:array<struct<label:string,rule:int,priority:int,base:boolean,first:bigint,last:bigint,kept:boolean>>>"
#: Certainty of a kept detection by priority.
CERTAINTY = {9: 0.99, 8: 0.95, 7: 0.95, 6: 0.9, 5: 0.75, 4: 0.7, 2: 0.3}


class Scanner:
    def __init__(self) -> None:
        self.rules = [(label, p, re.compile(f"(?<![^ ]){pattern}(?![^ ])"), base) for label, p, _, pattern, base in rules()]
        gates: dict[str, list[int]] = defaultdict(list)
        for i, (_, _, keyword, _, _) in enumerate(rules()):
            gates[keyword].append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword, which in gates.items():
            self.automaton.add_word(keyword, tuple(which))
        self.automaton.make_automaton()

    def scan(self, text: str) -> dict:
        """Number of words, and all detections in order; first and last are word numbers."""
        spelled = text.encode().translate(_FOLD).split()
        plain = b" ".join(spelled).decode()
        open_: set[int] = set()
        for _, which in self.automaton.iter(plain):
            open_.update(which)
        found = []
        for i in open_:
            label, priority, pattern, base = self.rules[i]
            found += [(m.start(), m.end(), -priority, i, label, base) for m in pattern.finditer(plain)]
        found.sort(key=lambda x: (x[0], -x[1], x[2], x[3]))
        out, at, word = [], 0, 0
        reach: dict[int, int] = {}  # by priority, how far the detections so far extend
        for start, end, minus, i, label, base in found:
            word, at = word + plain.count(" ", at, start), start
            kept = all(e < end for p, e in reach.items() if p >= -minus)
            reach[-minus] = max(reach.get(-minus, 0), end)
            out.append({"label": label, "rule": i, "priority": -minus, "base": base, "first": word, "last": word + plain.count(" ", start, end), "kept": kept})
        # A detection inside one of higher priority that starts at the same word came first if it is longer; else judge again.
        for k, x in enumerate(out):
            for j in range(k + 1, len(out)):
                y = out[j]
                if y["first"] != x["first"]:
                    break
                if y["last"] == x["last"] and y["priority"] > x["priority"]:
                    x["kept"] = False
        return {"n_words": len(spelled), "found": out}


def _scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    scanner = Scanner()
    for column in texts:
        yield pa.array([scanner.scan(x.as_py() or "") for x in column], _SHAPE)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, found) for each row of ``docs`` (doc_id, text, any others).

    ``found`` lists all detections in text order with label, rule number, priority, whether it is a base phrase, first and last word
    and whether it is kept after suppression. Null and empty texts have none; texts of any length are scanned whole, in time that follows their length. Each row by itself: ids may be null or repeat.
    """
    return docs.select("doc_id", F.arrow_udf(_scan, SCHEMA)(text_of()).alias("s")).select("doc_id", "s.n_words", "s.found")


def summarise(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: base phrases count whether kept or not."""
    base, kept = F.filter("found", lambda x: x["base"]), F.filter("found", lambda x: x["kept"])

    def joined(found) -> object:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")

    certainty = F.create_map(*[F.lit(x) for pair in CERTAINTY.items() for x in pair])
    doubt = F.aggregate(F.transform(kept, lambda x: 1.0 - certainty[x["priority"]]), F.lit(1.0), lambda a, x: a * x)
    starts = F.transform(base, lambda x: x["first"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.filter("found", lambda x: x["base"] | x["kept"])).alias("labels"),
        (1.0 - doubt).alias("score"), F.size(kept).cast("long").alias("n_detections"))
