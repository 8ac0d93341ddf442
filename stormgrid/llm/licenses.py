"""Licence scan: ordered signature rules behind a keyword gate; priority and containment resolve overlaps. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a lower-cased text are divided by runs of these.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The base: phrases and their labels, fixed.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Families: label, gate word, title (over words), versions. Each makes a title rule, a notice rule and rules per version.
FAMILIES = [
    ("gpl", "gnu", "gnu general public licen[cs]e", "1 2 3"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public licen[cs]e", "2 2-1 3"),
    ("agpl", "gnu", "gnu affero general public licen[cs]e", "1 3"),
    ("gfdl", "gnu", "gnu free documentation licen[cs]e", "1-1 1-2 1-3"),
    ("apache", "apache", "apache (?:software )?licen[cs]e", "1 1-1 2"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "1 1-1 2"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "1 2"),
    ("edl", "eclipse", "eclipse distribution licen[cs]e", "1"),
    ("cddl", "distribution", "common development and distribution licen[cs]e", "1 1-1"),
    ("cpl", "common", "common public licen[cs]e", "1"),
    ("ipl", "ibm", "ibm public licen[cs]e", "1"),
    ("eupl", "european", "european union public licen[cs]e", "1 1-1 1-2"),
    ("artistic", "artistic", "artistic licen[cs]e", "1 2"),
    ("bsl", "boost", "boost software licen[cs]e", "1"),
    ("busl", "business", "business source licen[cs]e", "1-1"),
    ("sspl", "side", "server side public licen[cs]e", "1"),
    ("elastic", "elastic", "elastic licen[cs]e", "1 2"),
    ("osl", "open", "open software licen[cs]e", "1 2 2-1 3"),
    ("afl", "academic", "academic free licen[cs]e", "1-1 1-2 2 2-1 3"),
    ("apsl", "apple", "apple public source licen[cs]e", "1 1-1 1-2 2"),
    ("ofl", "sil", "sil open font licen[cs]e", "1 1-1"),
    ("cecill", "cecill", "cecill(?: [bc])? (?:free software )?licen[cs]e", "1 2 2-1"),
    ("odbl", "database", "open (?:data commons )?(?:open )?database licen[cs]e", "1"),
    ("odc-by", "attribution", "open data commons attribution licen[cs]e", "1"),
    ("ogl", "government", "open government licen[cs]e", "1 2 3"),
    ("zpl", "zope", "zope public licen[cs]e", "1-1 2 2-1"),
    ("psf", "python", "python (?:software foundation )?licen[cs]e", "2"),
    ("php", "php", "php licen[cs]e", "3 3-1"),
    ("qpl", "q", "q public licen[cs]e", "1"),
    ("nasa", "nasa", "nasa open source agreement", "1-3"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "1"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "1"),
    ("npl", "netscape", "netscape public licen[cs]e", "1 1-1"),
    ("lppl", "latex", "latex project public licen[cs]e", "1 1-1 1-2 1-3"),
    ("ecl", "educational", "educational community licen[cs]e", "1 2"),
    ("mulan", "mulan", "mulan (?:permissive software|public) licen[cs]e", "1 2"),
    ("unicode", "unicode", "unicode licen[cs]e(?: agreement)?", "3"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[cs]e", "1"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "1"),
    ("isc", "isc", "isc licen[cs]e", "1"),
    ("wtfpl", "wtfpl", "wtfpl", "2"),
    ("unlicense", "unlicense", "the unlicense", "1"),
    ("bsd", "bsd", "bsd licen[cs]e", "1"),
    ("mit", "license", "mit license", "1"),
    ("mit-0", "attribution", "mit no attribution", "1"),
    ("x11", "x11", "x11 licen[cs]e", "1"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", "1"),
    ("openssl", "openssl", "openssl licen[cs]e", "1"),
    ("ruby", "ruby", "ruby licen[cs]e", "1"),
    ("vim", "vim", "vim licen[cs]e", "1"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "1"),
    ("cdla", "cdla", "cdla (?:permissive|sharing)", "1 2"),
    ("openrail", "openrail", "(?:creativeml )?openrail(?: m)?", "1"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter) licen[cs]e", "1"),
    ("hippocratic", "hippocratic", "hippocratic licen[cs]e", "1 2 3"),
]

#: Creative Commons terms: what follows "cc", its label, and the spelt-out form.
COMMONS = [
    ("by", "cc-by", "attribution"),
    ("by sa", "cc-by-sa", "attribution share ?alike"),
    ("by nc", "cc-by-nc", "attribution non ?commercial"),
    ("by nd", "cc-by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by nc sa", "cc-by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
]

#: Single signatures: label, gate word, pattern, priority, weight. A group that repeats without a bound has to be possessive: the others nest a call per repeat.
SINGLE = [
    ("mit", "licence", "(?:the )?mit licence", 50, 0.8),
    ("all-rights-reserved", "reserved", "all rights reserved", 10, 0.6),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d(?= ))*+", 5, 0.4),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 60, 0.9),
    ("cc0", "zero", "creative commons zero", 60, 0.9),
    ("cc-pdm", "mark", "(?:creative commons )?public domain mark", 60, 0.9),
    ("public-domain", "domain", "(?:released into|placed in|dedicated to|is in) the public domain", 40, 0.8),
    ("proprietary", "proprietary", "proprietary and confidential", 30, 0.8),
    ("proprietary", "confidential", "confidential information of", 20, 0.5),
    ("proprietary", "eula", "end user licen[cs]e agreement eula", 30, 0.7),
    ("proprietary", "agreement", "end user licen[cs]e agreement", 30, 0.7),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 70, 1.0),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 70, 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 70, 1.0),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse", 75, 1.0),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", 65, 0.95),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?", 65, 0.95),
    ("bsd-2-clause", "freebsd", "freebsd licen[cs]e", 65, 0.95),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)?", 65, 0.95),
    ("0bsd", "0bsd", "0bsd", 60, 0.9),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?", 65, 0.9),
    ("gpl", "gplv2", "gplv2", 50, 0.8),
    ("gpl", "gplv3", "gplv3", 50, 0.8),
    ("gpl", "gnu", "gnu gpl(?: v(?:ersion)? ?[123])?", 55, 0.9),
    ("lgpl", "lgpl", r"lgpl(?: v ?[23](?: [01])?)?", 50, 0.8),
    ("agpl", "agpl", "agpl(?: v ?3)?", 50, 0.8),
    ("gpl", "terms", "under the terms of the gnu general public licen[cs]e(?: as published by the free software foundation)?", 80, 1.0),
    ("gpl-or-later", "later", r"general public licen[cs]e .{0,60}?version [123] .{0,40}?or (?:at your option )?any later version", 82, 1.0),
    ("apache", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements", 80, 1.0),
    ("apache", "compliance", "you may not use this file except in compliance with the license", 60, 0.8),
    ("apache", "apache", "apache 2 0", 45, 0.7),
    ("mpl", "mozilla", "subject to the terms of the mozilla public license v 2 0", 80, 1.0),
    ("zlib", "express", "this software is provided as is without any express or implied warranty", 30, 0.5),
    ("warranty-disclaimer", "warranty", "without warranty of any kind(?: express or implied)?", 15, 0.4),
    ("warranty-disclaimer", "merchantability", "implied warranties of merchantability", 15, 0.4),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 80, 1.0),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e", 80, 1.0),
    ("beerware", "beerware", "(?:the )?beerware licen[cs]e", 60, 0.9),
    ("commons-clause", "clause", "commons clause licen[cs]e condition", 70, 0.9),
    ("dual", "dual", "dual licen[cs]ed under", 20, 0.4),
    ("open-source", "osi", "osi approved(?: licen[cs]e)?", 20, 0.4),
    ("no-derivatives", "derivative", "no derivative works", 25, 0.4),
    ("non-commercial", "commercial", "(?:for )?non commercial use only", 25, 0.5),
    ("non-commercial", "noncommercial", "(?:for )?noncommercial use only", 25, 0.5),
    # sentences of licence texts and notices
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 85, 1.0),
    ("gpl", "hope", "this program is distributed in the hope that it will be useful but without any warranty", 62, 0.8),
    ("gpl", "along", "you should have received a copy of the gnu general public licen[cs]e along with", 84, 1.0),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it", 70, 1.0),
    ("gpl", "copyleft", "(?:strong )?copyleft licen[cs]e", 20, 0.4),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 85, 1.0),
    ("lgpl", "along", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with", 84, 1.0),
    ("agpl", "affero", "under the terms of the gnu affero general public licen[cs]e", 84, 1.0),
    ("agpl", "remotely", "all users interacting with it remotely through a computer network", 72, 0.9),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 85, 1.0),
    ("mit", "portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 72, 1.0),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement", 45, 0.7),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 72, 1.0),
    ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 72, 1.0),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 76, 1.0),
    ("apache", "apache", "licensed under the apache license version 2 0 the license", 84, 1.0),
    ("apache", "writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 70, 0.95),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license", 84, 1.0),
    ("mpl", "contents", "the contents of this file are subject to the mozilla public license", 84, 1.0),
    ("cddl", "contents", "the contents of this file are subject to the terms of the common development and distribution license", 84, 1.0),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license", 84, 1.0),
    ("isc", "fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 70, 1.0),
    ("hpnd", "documentation", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted", 70, 1.0),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 74, 1.0),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 74, 0.9),
    ("bsl", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 75, 1.0),
    ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software", 78, 1.0),
    ("cc0", "neighboring", "waived all copyright and related or neighboring rights", 70, 0.95),
    ("cc-by", "redistribute", "you are free to share copy and redistribute the material in any medium or format", 40, 0.7),
    ("cc-by", "appropriate", "you must give appropriate credit provide a link to the license and indicate if changes were made", 42, 0.8),
    ("cc-by-sa", "contributions", "you must distribute your contributions under the same license as the original", 45, 0.8),
    ("cc-by-nc", "purposes", "you may not use the material for commercial purposes", 45, 0.8),
    ("cc-by-nd", "modified", "you may not distribute the modified material", 45, 0.8),
    ("ofl", "font", "this font software is licensed under the sil open font license", 84, 1.0),
    ("ofl", "reserved", "with reserved font name", 60, 0.8),
    ("artistic", "package", "the intent of this document is to state the conditions under which a package may be copied", 75, 1.0),
    ("psf", "python", "this license agreement is between the python software foundation", 75, 1.0),
    ("lppl", "latex", "this work may be distributed and or modified under the conditions of the latex project public license", 84, 1.0),
    ("elastic", "hosted", "you may not provide the software to third parties as a hosted or managed service", 75, 1.0),
    ("busl", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 78, 1.0),
    ("sspl", "functionality", "if you make the functionality of the program or a modified version available to third parties as a service", 78, 1.0),
    ("json", "evil", "the software shall be used for good not evil", 74, 1.0),
    ("blessing", "disclaims", "the author disclaims copyright to this source code", 74, 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 74, 1.0),
    ("openssl", "cryptographic", "this product includes cryptographic software written by eric young", 74, 1.0),
    ("openrail", "derivatives", "you agree not to use the model or derivatives of the model", 70, 0.9),
    ("llama", "llama", r"llama (?:\d(?: \d)? )?community licen[cs]e(?: agreement)?", 70, 0.95),
    ("gemma", "gemma", "gemma (?:is provided under and subject to the gemma )?terms of use", 65, 0.9),
    ("research-only", "research", "for (?:non ?commercial )?research purposes only", 40, 0.6),
    ("evaluation-only", "evaluation", "for (?:internal )?evaluation purposes only", 40, 0.6),
    ("government-use", "restricted", "restricted rights legend", 30, 0.5),
    ("government-use", "disclosure", "use duplication or disclosure by the government is subject to restrictions", 30, 0.5),
    ("terms-of-use", "terms", "subject to (?:our|the|these) terms of (?:use|service)", 10, 0.3),
]


def _rules() -> list[dict]:
    """All rules in order: {rule, label, gate, pattern, priority, weight}; patterns are over words divided by one space."""
    out: list[tuple] = []
    for label, gate, title, versions in FAMILIES:
        out.append((label, gate, f"(?:the )?{title}", 50, 0.8))
        out.append((label, gate, f"(?:released|licen[cs]ed|distributed|available|published) under (?:the )?(?:terms of the )?{title}", 60, 0.95))
        out.append((label, "spdx", f"spdx licen[cs]e identifier {re.escape(label).replace(chr(92) + '-', ' ').replace('-', ' ')}", 90, 1.0))
        for v in versions.split():
            number = v.replace("-", " ")
            if versions != "1":
                out.append((f"{label}-{v.replace('-', '.')}", gate, f"(?:the )?{title} (?:v|version|v ersion)? ?{number}(?: 0)?", 70, 1.0))
    for term, label, spelt in COMMONS:
        out.append((label, "cc", f"cc {term}", 50 + len(term), 0.9))
        out.append((label, "creative", f"creative commons {spelt}(?: international| unported)?(?: public)?(?: licen[cs]e)?", 50 + len(term), 0.95))
        out.append((label, "spdx", f"spdx licen[cs]e identifier cc {term}", 92, 1.0))
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append((f"{label}-{v.replace(' ', '.')}", "cc", f"cc {term} {v}", 70 + len(term), 1.0))
            out.append((f"{label}-{v.replace(' ', '.')}", "creative", f"creative commons {spelt} {v}(?: international| unported)?(?: public)?(?: licen[cs]e)?", 70 + len(term), 1.0))
    out += SINGLE
    return [dict(zip(("rule", "label", "gate", "pattern", "priority", "weight"), (k, *x), strict=True)) for k, x in enumerate(out)]


#: Every rule, in order.
RULES = _rules()
#: Type of a text's detections; sorted, the one that decides comes first.
ONE = "struct<neg_priority:int,neg_words:int,rule:int,start:int,end:int,label:string,weight:double>"
FOUND = f"array<{ONE}>"


def _text(text: str) -> Column:
    """The words of a text, each between single spaces, with a space before and after."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, BETWEEN, " ")), F.lit(" "))


def _words_in(c: Column) -> Column:
    """How many words a text between spaces has."""
    return (F.length(c) - F.length(F.replace(c, F.lit(" ")))).cast("long")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(n: Column, item: Callable[[Column], Column], state: Column, step: Callable[[Column, Column], tuple[Column, Column]], element: str, block: int = 128) -> Column:
    """What `step(state, item(k))`, which is (next state, element), gives for k = 1 to n: (state, out), the elements in blocks. No array grows by one element for every item."""

    def one(acc: Column, k: Column) -> Column:
        after, made = step(acc["state"], item(k))
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(made)).alias("out"))

    def some(acc: Column, low: Column) -> Column:
        own = F.aggregate(F.sequence(low, F.least(low + (block - 1), n)), F.struct(acc["state"].alias("state"), F.array().cast(f"array<{element}>").alias("out")), one)
        return _bound(own, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    none = F.struct(state.alias("state"), F.array().cast(f"array<array<{element}>>").alias("out"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(block)), none, some)).otherwise(none)


def _detections() -> Column:
    """All rules' matches in `norm`, for rules whose gate word is there: array of (neg_priority, neg_words, rule, start, end, label, weight), places in words.

    Matches of one rule follow one another without overlap, so a match's place is
    that of the pieces and matches before it.
    """
    by_gate: dict[str, list[dict]] = {}
    for r in RULES:
        by_gate.setdefault(r["gate"], []).append(r)
    one = lambda r: F.struct(F.lit(f"(?<= )(?:{r['pattern']})(?= )").alias("re"), F.lit(r["rule"]).alias("rule"), F.lit(r["label"]).alias("label"), F.lit(r["priority"]).alias("priority"), F.lit(float(r["weight"])).alias("weight"))
    table = F.create_map(*[x for g, rules in sorted(by_gate.items()) for x in (F.lit(g), F.array(*map(one, rules)))])
    gates = F.array_intersect("words", F.array(*map(F.lit, sorted(by_gate))))
    chosen = F.filter(F.flatten(F.transform(gates, lambda g: F.element_at(table, g))), lambda r: F.rlike(F.col("norm"), r["re"]))

    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" ")))

    def places(r: Column) -> Column:
        """One rule's matches. The text is scanned twice for each rule, whatever the number of matches: `once` holds both results."""
        once = F.struct(F.regexp_extract_all(F.col("norm"), r["re"], F.lit(0)).alias("hits"), F.split(F.col("norm"), r["re"], -1).alias("pieces"))

        def of(both: Column) -> Column:
            # spaces before a match are the words before it, plus the one at the text's start
            def step(at: Column, k: Column) -> tuple[Column, Column]:
                start = at + spaces(F.element_at(both["pieces"], k))
                n = spaces(F.element_at(both["hits"], k)) + 1
                found = F.struct((-r["priority"]).alias("neg_priority"), (-n).cast("int").alias("neg_words"), r["rule"].alias("rule"), (start - 1).cast("int").alias("start"), (start - 1 + n).cast("int").alias("end"), r["label"].alias("label"), r["weight"].alias("weight"))
                return (start + n - 1).cast("int"), found

            return F.flatten(_folded(F.size(both["hits"]), lambda k: k, F.lit(0), step, ONE)["out"])

        return _bound(once, of)

    return F.flatten(F.transform(chosen, places))


def _kept() -> Column:
    """Detections that stand, as (labels, best, n): of the highest priority first, then the longest, then by the order of the rules, each one is dropped if it lies within or overlaps one that stands.

    Only detections that a chain of overlaps joins can drop one another, so a text's
    detections are cut into such runs by their places, and each run is settled alone.
    """
    cut = F.struct(F.lit(-1).alias("upto"), F.array().cast(FOUND).alias("run"))

    def join(acc: Column, d: Column) -> tuple[Column, Column]:
        """The open run with one more, or a new one and the run that was closed."""
        on = (d["start"] < acc["upto"]) | (F.size(acc["run"]) == 0)
        longer = F.struct(F.greatest(acc["upto"], d["end"]).alias("upto"), F.concat(acc["run"], F.array(d)).alias("run"))
        return F.when(on, longer).otherwise(F.struct(d["end"].alias("upto"), F.array(d).alias("run"))), F.when(~on, acc["run"])

    placed = F.array_sort(F.transform("found", lambda d: F.struct(d["start"].alias("start"), d.alias("d"))))
    closed = lambda x: F.concat(F.filter(F.flatten(x["out"]), lambda run: run.isNotNull()), F.array(x["state"]["run"]))
    runs = _bound(placed, lambda all_: _bound(_folded(F.size(all_), lambda k: F.element_at(all_, k)["d"], cut, join, FOUND), closed))
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))

    def step(acc: Column, d: Column) -> Column:
        taken = F.exists(acc["spans"], lambda k: (k["start"] < d["end"]) & (d["start"] < k["end"]))
        with_it = F.struct(F.concat(acc["spans"], F.array(F.struct(d["start"].alias("start"), d["end"].alias("end")))).alias("spans"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), F.greatest(acc["best"], d["weight"]).alias("best"), (acc["n"] + 1).alias("n"))
        return F.when(taken, acc).otherwise(with_it)

    stand = F.transform(runs, lambda run: F.aggregate(F.array_sort(run), start, step, lambda a: F.struct(a["labels"].alias("labels"), a["best"].alias("best"), a["n"].alias("n"))))
    total = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))
    return F.aggregate(stand, total, lambda acc, x: F.struct(F.array_union(acc["labels"], x["labels"]).alias("labels"), F.greatest(acc["best"], x["best"]).alias("best"), (acc["n"] + x["n"]).alias("n")))


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per record: the base phrases' places and labels, and the rules' labels after suppression.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the weight of the heaviest standing rule, 0.8 at least where the base
    found a phrase; 0 without any), n_detections.

    Nothing is shuffled: each text is scanned where it is read, its rules chosen
    by the gate words among its words. Detections that overlap are settled by
    priority, then length, then the order of the rules. Null and empty texts have no words, empty
    label strings, null places and score 0. Repeated rows are scanned one by one;
    other columns are ignored.
    """
    phrase = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    base = df.select(F.col(key).alias("doc_id"), _text(text).alias("norm")).withColumn("norm", F.when(F.col("norm").rlike(r"^ *$"), F.lit(" ")).otherwise(F.col("norm")))
    base = base.select("doc_id", "norm", F.filter(F.split("norm", " "), lambda w: w != "").alias("words"))
    base = base.withColumn("gated", F.arrays_overlap("words", F.array(*map(F.lit, sorted({r["gate"] for r in RULES} | {"license", "cc"})))))
    some = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.col("gated"), F.regexp_count("norm", F.lit(phrase)).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_base"),
        F.when(F.col("gated"), _words_in(F.element_at(F.split("norm", phrase, 2), 1)) - 1).alias("first_word"),
        F.when(F.col("gated"), _words_in(F.regexp_extract("norm", f"(?s)^(.*){phrase}", 1)) - 1).alias("last_word"),
        F.when(F.col("gated"), F.filter(F.array(*[F.when(F.contains(F.col("norm"), F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")).alias("base"),
        F.when(F.col("gated"), _detections()).otherwise(F.array().cast(FOUND)).alias("found"),
    ).withColumn("kept", _kept())
    has = F.col("n_base") > 0
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return some.select(
        "doc_id",
        "n_words",
        "n_base",
        F.when(has, F.col("first_word")).alias("first_word"),
        F.when(has, F.col("last_word")).alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat(F.col("base"), F.col("kept.labels"))).alias("labels"),
        F.when(has, F.greatest(F.col("kept.best"), F.lit(0.8))).otherwise(F.col("kept.best")).alias("score"),
        F.col("kept.n").alias("n_detections"),
    )
