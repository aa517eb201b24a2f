"""License scans by ordered signature rules.

A text becomes its words (ASCII lower-cased, split at all other ASCII characters) joined by single
spaces, so rules are regular expressions over plain words. A rule runs only on texts that
hold its keyword. Overlapping detections are resolved by interval containment: of two detections,
one inside the other, the rule of higher priority stays, then the longer detection, then the
earlier rule. Base rules always keep theirs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.text import PLAIN, chunks, text_bytes

# Phrases whose every place is reported, with their labels (fixed values).
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Licenses: label, how its name is written, and its identifier in tags, both as patterns over
# plain words.
LICENSES = (
    ("mit", r"(?:mit|expat|x11)", r"mit(?: 0)?"),
    ("apache-1", r"apache (?:software )?license v(?:ersion )?1(?: [01])?", r"apache 1 [01]"),
    ("apache-2", r"apache (?:software )?(?:license )?(?:v|version )?2(?: 0)?", r"apache 2 0"),
    ("bsd-2", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", r"bsd 2 clause"),
    ("bsd-3", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)", r"bsd 3 clause"),
    ("bsd-4", r"(?:bsd 4 clause|4 clause bsd|original bsd)", r"bsd 4 clause"),
    ("isc", r"(?:isc|internet systems consortium)", r"isc"),
    ("gpl-2", r"(?:gnu )?(?:general public|gpl)(?: license)?(?: version | v| )2", r"gpl 2 0"),
    ("gpl-3", r"(?:gnu )?(?:general public|gpl)(?: license)?(?: version | v| )3", r"gpl 3 0"),
    ("lgpl-2", r"(?:gnu )?(?:lesser|library) general public license(?: version | v| )2", r"lgpl 2 [01]"),
    ("lgpl-3", r"(?:gnu )?lesser general public license(?: version | v| )3", r"lgpl 3 0"),
    ("agpl-3", r"(?:gnu )?affero general public license(?: version | v| )3", r"agpl 3 0"),
    ("mpl-1", r"mozilla public license(?: version | v| )1(?: [01])?", r"mpl 1 [01]"),
    ("mpl-2", r"mozilla public license(?: version | v| )2(?: 0)?", r"mpl 2 0"),
    ("epl-1", r"eclipse public license(?: version | v| )1(?: 0)?", r"epl 1 0"),
    ("epl-2", r"eclipse public license(?: version | v| )2(?: 0)?", r"epl 2 0"),
    ("cddl-1", r"common development and distribution license", r"cddl 1 [01]"),
    ("cpl-1", r"common public license", r"cpl 1 0"),
    ("eupl", r"european union public licen[cs]e", r"eupl 1 [012]"),
    ("artistic-1", r"artistic license(?: version | v| )1(?: 0)?", r"artistic 1 0"),
    ("artistic-2", r"artistic license(?: version | v| )2(?: 0)?", r"artistic 2 0"),
    ("zlib", r"zlib(?: libpng)?", r"zlib"),
    ("boost", r"boost software license", r"bsl 1 0"),
    ("unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", r"do what the f\S* you want to public license", r"wtfpl"),
    ("cc0", r"(?:cc0|creative commons zero)(?: 1 0)?", r"cc0 1 0"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?! (?:nc|sa|nd|non|share|no)\b)", r"cc by \d \d"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", r"cc by sa \d \d"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv\w*)", r"cc by nd \d \d"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", r"cc by nc \d \d"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", r"cc by nc sa \d \d"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*)", r"cc by nc nd \d \d"),
    ("odbl", r"open (?:data commons open )?database license", r"odbl 1 0"),
    ("odc-by", r"open data commons attribution license", r"odc by 1 0"),
    ("pddl", r"public domain dedication and license", r"pddl 1 0"),
    ("gfdl", r"gnu free documentation license", r"gfdl 1 [123]"),
    ("psf", r"python software foundation license", r"psf 2 0"),
    ("php", r"php license", r"php 3 0[01]?"),
    ("ruby", r"ruby license", r"ruby"),
    ("openssl", r"openssl license", r"openssl"),
    ("postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("ofl", r"(?:sil )?open font license", r"ofl 1 [01]"),
    ("afl-3", r"academic free license", r"afl 3 0"),
    ("osl-3", r"open software license", r"osl 3 0"),
    ("ms-pl", r"microsoft public license", r"ms pl"),
    ("ms-rl", r"microsoft reciprocal license", r"ms rl"),
    ("ncsa", r"university of illinois ncsa open source license", r"ncsa"),
    ("vim", r"vim license", r"vim"),
    ("curl", r"curl license", r"curl"),
    ("unicode", r"unicode license", r"unicode dfs \d+"),
    ("w3c", r"w3c software (?:notice and )?license", r"w3c"),
    ("sspl", r"server side public license", r"sspl 1 0"),
    ("busl", r"business source license", r"busl 1 1"),
    ("elastic", r"elastic license", r"elastic 2 0"),
    ("openrail", r"(?:creativeml )?open ?rail(?: m)?", r"openrail"),
    ("blueoak", r"blue oak model license", r"blueoak 1 0 0"),
    ("beerware", r"beer ?ware(?: license)?", r"beerware"),
    ("upl", r"universal permissive license", r"upl 1 0"),
)

# How a license is pointed at: form, pattern around the name or identifier, priority (lower
# wins), confidence and the word that must be in a text for the form to be tried.
FORMS = (
    ("tag", r"spdx license identifier {id}", 10, 1.0, "spdx"),
    ("granted", r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?{name}(?: license)?", 20, 0.95, "under"),
    ("subject", r"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: license)?", 30, 0.9, "subject"),
    ("see", r"(?:see|read|copy of) the {name} license", 40, 0.85, "licen"),
    ("field", r"license (?:is )?{name}", 50, 0.8, "licen"),
    ("named", r"{name} license(?! (?:agreement|key|plate)\b)", 60, 0.7, "licen"),
)

# Texts and notices that belong to one license or to none.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 5, 1.0, "hereby granted"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", 5, 1.0, "permission to use"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", 5, 0.95, "redistribution"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 5, 1.0, "unencumbered"),
    ("gpl", r"this program is free software you can redistribute it", 5, 0.95, "redistribute"),
    ("gpl", r"gnu general public license", 80, 0.6, "general public"),
    ("lgpl", r"gnu (?:lesser|library) general public license", 75, 0.6, "general public"),
    ("agpl", r"gnu affero general public license", 75, 0.6, "affero"),
    ("zlib", r"this software is provided as is without any express or implied warranty", 7, 0.9, "implied warranty"),
    ("public-domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", 70, 0.8, "public domain"),
    ("proprietary", r"all rights reserved", 90, 0.3, "all rights reserved"),
    ("proprietary", r"confidential and proprietary", 90, 0.6, "proprietary"),
    ("cc", r"creativecommons org licenses", 85, 0.5, "creativecommons"),
)

# Abbreviations with their versions, and families named without one; a version wins.
SHORT = (
    ("gpl-2", r"(?:gnu )?gpl ?v? ?2(?: 0)?", 65, 0.7, "gpl"),
    ("gpl-3", r"(?:gnu )?gpl ?v? ?3(?: 0)?", 65, 0.7, "gpl"),
    ("lgpl-2", r"(?:gnu )?lgpl ?v? ?2(?: [01])?", 65, 0.7, "lgpl"),
    ("lgpl-3", r"(?:gnu )?lgpl ?v? ?3(?: 0)?", 65, 0.7, "lgpl"),
    ("agpl-3", r"(?:gnu )?agpl ?v? ?3(?: 0)?", 65, 0.7, "agpl"),
    ("mpl-1", r"mpl ?v? ?1(?: [01])?", 65, 0.7, "mpl"),
    ("mpl-2", r"mpl ?v? ?2(?: 0)?", 65, 0.7, "mpl"),
    ("epl-1", r"epl ?v? ?1(?: 0)?", 65, 0.7, "epl"),
    ("epl-2", r"epl ?v? ?2(?: 0)?", 65, 0.7, "epl"),
    ("cddl-1", r"cddl ?v? ?1(?: [01])?", 65, 0.7, "cddl"),
    ("eupl", r"eupl ?v? ?1(?: [012])?", 65, 0.7, "eupl"),
    ("gpl", r"(?:gnu )?gpl(?: license)?", 82, 0.5, "gpl"),
    ("lgpl", r"(?:gnu )?lgpl(?: license)?", 82, 0.5, "lgpl"),
    ("agpl", r"(?:gnu )?agpl(?: license)?", 82, 0.5, "agpl"),
    ("bsd", r"bsd (?:style |type )?license", 82, 0.5, "bsd"),
    ("apache", r"apache (?:software )?license", 82, 0.5, "apache"),
    ("mpl", r"(?:mpl|mozilla public) license", 82, 0.5, "licen"),
    ("epl", r"(?:epl|eclipse public) license", 82, 0.5, "licen"),
    ("cc", r"creative commons license", 82, 0.5, "creative commons"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    priority: int
    confidence: float
    keyword: str
    base: bool = False


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, notices, every form of every license, short names.

    All but the base phrases take the British spelling too.
    """
    made = [Rule(f"base:{b}", b, p, 15, 0.95, p, True) for p, b in BASE]
    made += [
        Rule(f"notice:{n}:{b}", b, p, pr, c, k) for n, (b, p, pr, c, k) in enumerate(NOTICES)
    ]
    for label, name, tag in LICENSES:
        for form, around, priority, confidence, keyword in FORMS:
            pattern = around.replace("{id}", f"(?:{tag})").replace("{name}", f"(?:{name})")
            made.append(Rule(f"{form}:{label}", label, pattern, priority, confidence, keyword))
    made += [Rule(f"short:{n}:{b}", b, p, pr, c, k) for n, (b, p, pr, c, k) in enumerate(SHORT)]
    return tuple(
        r if r.base else replace(r, pattern=r.pattern.replace("license", "licen[cs]e")) for r in made
    )


@functools.cache
def _compiled(given: tuple[Rule, ...]) -> dict[str, list[tuple[int, re.Pattern]]]:
    """Patterns by keyword, each fixed to word borders."""
    by: dict[str, list[tuple[int, re.Pattern]]] = {}
    for i, rule in enumerate(given):
        whole = rf"(?<![^ ])(?:{rule.pattern})(?![^ ])".encode()
        by.setdefault(rule.keyword, []).append((i, re.compile(whole)))
    return by


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def raw_detections(plain: bytes, given: tuple[Rule, ...]) -> Iterator[tuple[int, int, int]]:
    """(rule, first word, end word) of every match of a rule that the keywords let through."""
    for keyword, own in _compiled(given).items():
        if keyword.encode() not in plain:
            continue
        for i, pattern in own:
            for m in pattern.finditer(plain):
                first = plain.count(b" ", 0, m.start())
                yield i, first, first + 1 + plain.count(b" ", m.start(), m.end())


def resolved(found: list[tuple[int, int, int]], given: tuple[Rule, ...]):
    """Detections left by containment, in order of their place.

    Taken in order of rule priority, length and rule order, a detection inside one taken before
    is dropped; base detections stay whatever holds them. Sweeping by start keeps this linear in
    the detections, up to sorting: only the farthest end taken so far can contain the next.
    """
    order = sorted(
        set(found), key=lambda d: (given[d[0]].priority, d[1] - d[2], d[0], d[1])
    )
    kept: list[tuple[int, int, int]] = []
    holders: dict[int, list[tuple[int, int]]] = {}
    for d in order:
        rule, first, end = d
        inside = any(a <= first and end <= b for a, b in holders.get(first // SPREAD, ()))
        if inside and not given[rule].base:
            continue
        kept.append(d)
        for cell in range(first // SPREAD, end // SPREAD + 1):
            holders.setdefault(cell, []).append((first, end))
    return sorted(kept, key=lambda d: (d[1], d[2], d[0]))


# Width, in words, of the cells in which taken detections are looked up.
SPREAD = 32


def scan(docs: DataFrame, given: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, n_words and detections (rule, label, first_word, end_word, priority, confidence,
    base) for each row of ``docs`` (doc_id, text).

    A missing or empty text has no words and no detections. Rows are scanned apart: repeated
    rows give equal rows, a missing doc_id stays missing and other columns are ignored.
    """
    given = given or rules()

    def run(batches):
        for rest, texts in chunks(batches):
            counts, lists = [], []
            for text in texts:
                words = words_of(text)
                counts.append(len(words))
                found = list(raw_detections(b" ".join(words), given))
                lists.append(
                    [
                        {
                            "rule": given[i].name,
                            "label": given[i].label,
                            "first_word": a,
                            "end_word": b,
                            "priority": given[i].priority,
                            "confidence": given[i].confidence,
                            "base": given[i].base,
                        }
                        for i, a, b in resolved(found, given)
                    ]
                )
            kind = pa.list_(
                pa.struct(
                    [
                        ("rule", pa.string()),
                        ("label", pa.string()),
                        ("first_word", pa.int64()),
                        ("end_word", pa.int64()),
                        ("priority", pa.int32()),
                        ("confidence", pa.float64()),
                        ("base", pa.bool_()),
                    ]
                )
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rest["doc_id"], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(lists, kind),
                ],
                names=["doc_id", "n_words", "detections"],
            )

    schema = (
        "doc_id long, n_words long, detections array<struct<rule: string, label: string, "
        "first_word: long, end_word: long, priority: int, confidence: double, base: boolean>>"
    )
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(run, schema)
