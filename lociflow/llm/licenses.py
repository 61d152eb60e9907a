"""Licence scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII character other than letters and digits into a space; all others are parts of words.
CANONICAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Phrases that always count, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    """A signature: ``pattern`` over words joined by one space, tried where a text holds one of the keywords, which ``|`` divides; higher priorities win."""

    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float


#: Licence families: label, pattern of the name, keywords of which every match holds one, and the versions that a notice may give.
FAMILIES = (
    ("apache", r"apache(?: software)?", "apache", ("1 0", "1 1", "2 0")),
    ("gpl", r"(?:gnu )?(?:general public|gpl)", "public|gpl", ("1", "2", "2 0", "3", "3 0")),
    ("lgpl", r"(?:gnu )?(?:lesser general public|library general public|lgpl)", "public|lgpl", ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", r"(?:gnu )?(?:affero general public|agpl)", "affero|agpl", ("1 0", "3", "3 0")),
    ("mpl", r"mozilla public", "mozilla", ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public", "eclipse", ("1 0", "2 0")),
    ("edl", r"eclipse distribution", "eclipse", ("1 0",)),
    ("cddl", r"common development and distribution", "common development", ("1 0", "1 1")),
    ("cpl", r"common public(?: attribution)?", "common public", ("1 0",)),
    ("eupl", r"european union public", "european union", ("1 0", "1 1", "1 2")),
    ("osl", r"open software", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", r"academic free", "academic free", ("1 2", "2 0", "2 1", "3 0")),
    ("artistic", r"(?:perl )?artistic", "artistic", ("1 0", "2 0")),
    ("boost", r"boost(?: software)?", "boost", ("1 0",)),
    ("mit", r"mit(?: x11| expat)?", "mit", ()),
    ("bsd", r"(?:(?:new|modified|simplified|revised|original|two clause|three clause|four clause|[234] clause) )?bsd(?: [0234] clause)?", "bsd", ()),
    ("isc", r"isc", "isc", ()),
    ("zlib", r"zlib(?: libpng)?", "zlib", ()),
    ("unlicense", r"unlicense", "unlicense", ()),
    ("wtfpl", r"do what the fuck you want to public", "do what", ("2",)),
    ("ms-pl", r"microsoft public", "microsoft", ()),
    ("ms-rl", r"microsoft reciprocal", "microsoft", ()),
    ("odbl", r"open (?:database|data commons open database)", "open", ("1 0",)),
    ("odc-by", r"open data commons attribution", "open data", ("1 0",)),
    ("ofl", r"(?:sil )?open font", "open font", ("1 0", "1 1")),
    ("gfdl", r"(?:gnu )?free documentation", "free documentation", ("1 1", "1 2", "1 3")),
    ("cecill", r"cecill(?: [bc])?", "cecill", ("1 0", "2 0", "2 1")),
    ("python", r"python(?: software foundation)?", "python", ("2", "2 0")),
    ("php", r"php", "php", ("3 0", "3 01")),
    ("ruby", r"ruby", "ruby", ()),
    ("openssl", r"openssl", "openssl", ()),
    ("w3c", r"w3c(?: software(?: notice)?)?", "w3c", ()),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa", ()),
    ("postgresql", r"postgresql", "postgresql", ()),
    ("upl", r"universal permissive", "universal permissive", ("1 0",)),
    ("ecl", r"educational community", "educational community", ("1 0", "2 0")),
    ("ibm-pl", r"ibm public", "ibm", ("1 0",)),
    ("lppl", r"latex project public", "latex project", ("1 0", "1 2", "1 3")),
    ("mulan", r"mulan(?: permissive software)?", "mulan", ("1", "2")),
    ("elastic", r"elastic", "elastic", ("2 0",)),
    ("sspl", r"server side public", "server side", ("1",)),
    ("bsl", r"business source", "business source", ("1 1",)),
    ("commons-clause", r"commons clause", "commons clause", ("1 0",)),
)

#: Creative Commons elements, written out and abbreviated.
COMMONS = (
    ("cc-by", r"attribution", r"by"),
    ("cc-by-sa", r"attribution share ?alike", r"by sa"),
    ("cc-by-nd", r"attribution no ?deriv(?:ative|atives|s)", r"by nd"),
    ("cc-by-nc", r"attribution non ?commercial", r"by nc"),
    ("cc-by-nc-sa", r"attribution non ?commercial share ?alike", r"by nc sa"),
    ("cc-by-nc-nd", r"attribution non ?commercial no ?deriv(?:ative|atives|s)", r"by nc nd"),
)

#: Sentences of well-known licence texts and notices: label, pattern, keyword, priority, confidence.
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted", 90, 0.99),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "this permission notice", 80, 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy", 90, 0.99),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 90, 0.99),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source", 80, 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", 80, 0.9),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "free software", 90, 0.98),
    ("gpl", r"you should have received a copy of the gnu general public license", "gnu general public", 85, 0.95),
    ("lgpl", r"you should have received a copy of the gnu lesser general public license", "gnu lesser general", 95, 0.98),
    ("agpl", r"you should have received a copy of the gnu affero general public license", "gnu affero general", 95, 0.98),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license", "unless required by applicable", 85, 0.95),
    ("apache", r"you may not use this file except in compliance with the license", "except in compliance", 85, 0.95),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", "source code form", 95, 0.99),
    ("boost", r"distributed under the boost software license version 1 0", "boost software", 95, 0.99),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", "in no event will", 80, 0.85),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 95, 0.99),
    ("public-domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain", "public domain", 60, 0.85),
    ("public-domain", r"(?:is|are) in the public domain", "public domain", 50, 0.7),
    ("cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0", 70, 0.95),
    ("cc0", r"creative commons (?:zero|public domain dedication)", "creative commons", 70, 0.9),
    ("proprietary", r"proprietary and confidential", "proprietary", 60, 0.85),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution)(?: of this (?:file|document|work))? (?:is|via any medium is)(?: strictly)? prohibited", "unauthorized", 60, 0.85),
    ("proprietary", r"may not be (?:reproduced|copied|redistributed|published)(?: in whole or in part| in any form)?(?: without)", "may not be", 55, 0.75),
    ("proprietary", r"trade secrets? of", "trade secret", 50, 0.6),
    ("copyright", r"copyright(?: c)?(?: (?:19|20)[0-9]{2})+", "copyright", 20, 0.5),
    ("copyright", r"(?:19|20)[0-9]{2} (?:the )?[a-z0-9]+ (?:and contributors|authors)", "contributors|authors", 10, 0.3),
    ("reserved", r"some rights reserved", "rights reserved", 30, 0.6),
    ("reserved", r"no part of this (?:work|book|publication|document) may be", "no part of this", 40, 0.7),
    ("no-warranty", r"(?:is )?provided as is without (?:any )?warrant(?:y|ies)", "provided as is", 15, 0.4),
    ("no-warranty", r"without warranties or conditions of any kind", "without warranties", 15, 0.4),
    ("no-training", r"(?:may|must) not be used (?:for|to) train(?:ing)?", "train", 60, 0.85),
    ("personal-use", r"for (?:personal|non ?commercial|internal|evaluation|academic) use only", "use only", 50, 0.7),
)


def rules() -> list[Rule]:
    """Several hundred rules: each family in each kind of notice and for each version, the Creative Commons elements, and the sentences."""
    out = [Rule(*r) for r in SENTENCES]
    for label, name, keyword, versions in FAMILIES:
        for kind, pattern, priority, confidence in (
            ("spdx", rf"spdx license identifier (?:{label.replace('-', ' ')})(?: [0-9]+(?: [0-9]+)*)?(?: only| or later| clause)?", 100, 1.0),
            ("granted", rf"(?:licensed|released|distributed|available|published|provided|covered) (?:under|by)(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", 75, 0.97),
            ("subject", rf"(?:subject to|under|according to|governed by)(?: the)?(?: terms(?: and conditions)?(?: of)?)(?: the)? {name}(?: licen[cs]e)?", 70, 0.92),
            ("named", rf"(?:the )?{name} licen[cs]e", 40, 0.8),
        ):
            out.append(Rule(label, pattern, "spdx" if kind == "spdx" else keyword, priority, confidence))
        for v in versions:
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", rf"(?:the )?{name}(?: licen[cs]e)?(?: version| v)? ?v?{v}(?: or (?:any )?later(?: version)?)?", keyword, 78, 0.95))
    for label, words, short in COMMONS:
        out += [
            Rule(label, rf"creative commons {words}(?: [1-4] 0)?(?: international| unported| generic)?(?: licen[cs]e)?", "creative commons", 72, 0.95),
            Rule(label, rf"cc {short}(?! (?:sa|nd|nc)\b)(?: [1-4] 0)?", "cc by", 65, 0.85),
            Rule(label, rf"creativecommons org licenses {short}(?! (?:sa|nd|nc)\b)(?: [1-4] 0)?", "creativecommons", 85, 0.98),
        ]
    return out


def uncontained(hits: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections ``(start, end, rule)`` that stand in no better one, in n log n steps: better are higher priorities, then longer, earlier ones.

    What contains a container that is better than it contains and beats all that stands in it, so that it doesn't matter whether the container itself stays. From left to right, longer ones first, a
    tree over the ends holds the best rank of those that reach at least so far.
    """
    hits = sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label))
    ends = sorted({h[1] for h in hits}, reverse=True)
    place = {e: i + 1 for i, e in enumerate(ends)}
    best = [len(hits)] * (len(ends) + 1)
    stays = []
    for rank in sorted(range(len(hits)), key=lambda r: (hits[r][0], -hits[r][1], r)):
        at, least = place[hits[rank][1]], len(hits)
        i = at
        while i:
            least = min(least, best[i])
            i &= i - 1
        if least > rank:
            stays.append(rank)
        while at < len(best):
            best[at] = min(best[at], rank)
            at += at & -at
    return [hits[r] for r in sorted(stays)]


class Scanner:
    """The compiled rules behind one automaton of their keywords."""

    def __init__(self, ruleset: list[Rule] | None = None):
        import ahocorasick

        self.ruleset = rules() if ruleset is None else ruleset
        self.compiled = [re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])") for r in self.ruleset]
        by: dict[str, list[int]] = {}
        for i, r in enumerate(self.ruleset):
            for k in r.keyword.split("|"):
                by.setdefault(k, []).append(i)
        for phrase, _ in BASE:
            by.setdefault(phrase, [])
        self.by = by
        self.automaton = ahocorasick.Automaton()
        for k in by:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> dict:
        """Word count, base places and labels, and the detections that no better one contains."""
        words = text.translate(CANONICAL).split()
        out = {"n_words": len(words), "base": [], "found": []}
        if not words:
            return out
        joined = b" ".join(words).decode("latin-1")
        held = {k for _, k in self.automaton.iter(joined)}
        if not held:
            return out
        starts = None
        for phrase, label in BASE:
            if phrase in held:
                at = -1
                while (at := joined.find(phrase, at + 1)) >= 0:
                    end = at + len(phrase)
                    if (at == 0 or joined[at - 1] == " ") and (end == len(joined) or joined[end] == " "):
                        out["base"].append((at, label))
        hits = []
        for i in sorted({i for k in held for i in self.by[k]}):
            hits += [(m.start(), m.end(), self.ruleset[i]) for m in self.compiled[i].finditer(joined)]
        kept = uncontained(hits)
        if out["base"] or kept:
            starts = [0, *(n for n in accumulate(len(w) + 1 for w in words))]
            word_at = lambda c: bisect_right(starts, c) - 1
            out["base"] = sorted((word_at(a), label) for a, label in out["base"])
            out["found"] = sorted(({"first": word_at(s), "end": word_at(e - 1) + 1, "label": r.label, "confidence": r.confidence} for s, e, r in kept), key=lambda f: (f["first"], f["end"], f["label"]))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ruleset: list[Rule] | None = None) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)`` of every row.

    Whole texts, lower-cased in A-Z, as words of digits, letters and non-ASCII characters. Base phrases count wherever their words stand consecutively; their labels always stay. Rules
    run only where the text holds their keyword; of overlapping detections one inside another of higher priority, or of the same and longer, is dropped.
    ``score`` is the probability that some detection is right if they err independently, 1 with a base place. A null or empty text has 0 words and no labels; texts of any length are scanned whole, in about linear time. Repeated rows and ids and null ids are kept, other columns are
    left out, whatever their names; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    detection = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ruleset)
        for b in batches:
            rows = [scanner.scan(t or b"") for t in b.column(1).to_pylist()]
            base = [sorted({x for _, x in r["base"]}) for r in rows]
            every = [sorted({*x, *(f["label"] for f in r["found"])}) for x, r in zip(base, rows, strict=True)]
            score = []
            for r in rows:
                miss = 0.0 if r["base"] else 1.0
                for f in r["found"]:
                    miss *= 1 - f["confidence"]
                score.append(1 - miss)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r["n_words"] for r in rows], pa.int64()),
                    pa.array([len(r["base"]) for r in rows], pa.int64()),
                    pa.array([r["base"][0][0] if r["base"] else None for r in rows], pa.int64()),
                    pa.array([r["base"][-1][0] if r["base"] else None for r in rows], pa.int64()),
                    pa.array([",".join(x) for x in base]),
                    pa.array([",".join(x) for x in every]),
                    pa.array(score, pa.float64()),
                    pa.array([r["found"] for r in rows], pa.list_(detection)),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first: long, end: long, label: string, confidence: double>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(each, schema)
