"""License scans: exact phrases, and a fuzzy search for short notices.

A notice that occurs with at most k edits, cut into k + 1 pieces, keeps at least
one piece unchanged. Each piece of each notice is searched as an exact byte
string; a hit fixes where the notice must begin, to within k, and the regex
library's bounded-error matching of the notice over that window verifies the
edits and gives the span. A window that lacks more of the notice's letters than
edits can account for is left without it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.llm.rows import map_rows, whole_text

# Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Short notices, lower case, their labels and the edits allowed.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license, version 2.0", "apache", 4),
    ("licensed under the gnu general public license", "gpl", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("licensed under the bsd license", "bsd", 3),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under a creative commons attribution", "cc-by", 4),
    ("all rights reserved", "reserved", 1),
)


@dataclass(frozen=True)
class _Notice:
    label: str
    edits: int
    length: int
    seeds: tuple[tuple[bytes, int], ...]
    needs: tuple[tuple[bytes, int], ...]
    match: object


@lru_cache(maxsize=4)
def _notices(notices: tuple[tuple[str, str, int], ...]) -> list[_Notice]:
    found = []
    for text, label, edits in notices:
        raw = text.encode()
        bounds = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
        seeds = tuple((raw[a:b], a) for a, b in zip(bounds, bounds[1:], strict=False))
        # BESTMATCH: the alignment with the fewest edits in a window.
        verify = regex.compile(rb"(?b)(?:" + re.escape(raw) + rb"){e<=" + str(edits).encode() + rb"}")
        needs = tuple((bytes([b]), raw.count(b)) for b in sorted(set(raw)))
        found.append(_Notice(label, edits, len(raw), seeds, needs, verify.search))
    return found


@lru_cache(maxsize=4)
def _phrases(phrases: tuple[tuple[str, str], ...]):
    gap, word = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"
    return [
        (label, re.compile(b"(?<!%b)%b(?!%b)" % (word, gap.join(p.encode().split()), word)).finditer, p.split()[-1].encode())
        for p, label in phrases
    ]


_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _may_hold(window: bytes, n: _Notice) -> bool:
    """False if the window lacks more of the notice's letters than edits can account for: each loses at most one."""
    lacking = 0
    for letter, count in n.needs:
        lacking += max(0, count - window.count(letter))
        if lacking > n.edits:
            return False
    return True


def fuzzy_spans(text: bytes, notices: list[_Notice]) -> list[tuple[int, int, str, int]]:
    """Byte spans (start, end, label, edits) of the notices in a lower-case text, sorted."""
    found = set()
    for n in notices:
        k, tried = n.edits, -n.length - 1  # before any begin
        begins = set()
        for seed, at in n.seeds:
            i = text.find(seed)
            while i >= 0:
                begins.add(i - at)
                i = text.find(seed, i + 1)
        for begin in sorted(begins):
            a = max(0, begin - k)
            if begin <= tried:  # the last window already holds this place
                continue
            z = min(len(text), begin + n.length + 2 * k)
            m = _may_hold(text[a:z], n) and n.match(text, a, z)
            if m:
                found.add((*m.span(), n.label, sum(m.fuzzy_counts)))
                tried = begin + k
    return sorted(found)


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    notices: tuple[tuple[str, str, int], ...] = NOTICES,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_spans: bool = False,
) -> DataFrame:
    """Scan every whole text, A-Z lowered, for license phrases and notices.

    Returns ``doc_id, n_words, n_base`` (places of phrases), ``first_word,
    last_word`` (smallest and largest word at which one begins, else null),
    ``base_labels, labels`` (distinct, sorted, comma-joined; ``labels`` holds
    those of fuzzy notices too), ``score`` (1 with an exact phrase or notice,
    less with each edit of the best notice, 0 with none) and, with
    ``with_spans``, ``spans``: ``label:start:end:edits`` of each notice, in code
    points, comma-joined.

    Null and empty texts: no words, no labels, score 0. A null id is kept.
    Repeated rows are scanned each. Other columns play no part.
    """
    schema = (
        "doc_id long,n_words long,n_base long,first_word long,last_word long,"
        "base_labels string,labels string,score double" + ",spans string" * with_spans
    )

    def run(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        exact, fuzzy = _phrases(tuple(phrases.items())), _notices(tuple(notices))
        for keys, texts in blocks:
            out: list[list] = [[] for _ in range(8 + with_spans)]
            for key, text in zip(keys, texts, strict=True):
                low = text.lower()  # of bytes: A-Z only
                inside = _IS_WORD[np.frombuffer(low, np.uint8)]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                places, base = [], set()
                for label, find, last in exact:
                    if last in low:
                        here = [m.start() for m in find(low)]
                        places += here
                        base |= {label} if here else set()
                words = (np.cumsum(begins)[places] - 1).tolist() if places else []
                spans = fuzzy_spans(low, fuzzy)
                score = 1.0 if places else max((1 - e / max(1, b - a) for a, b, _, e in spans), default=0.0)
                row = (
                    key,
                    int(np.count_nonzero(begins)),
                    len(places),
                    min(words, default=None),
                    max(words, default=None),
                    ",".join(sorted(base)),
                    ",".join(sorted(base | {s[2] for s in spans})),
                    score,
                )
                if with_spans:
                    # Code points before each byte, and before the end.
                    before = np.append(np.cumsum(np.frombuffer(low, np.int8) >= -64) - 1, len(low.decode(errors="replace"))) if spans else ()
                    row += (",".join(f"{x}:{before[a]}:{before[b]}:{e}" for a, b, x, e in spans),)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield out

    columns = [F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column)]
    return map_rows(docs, columns, run, schema)
