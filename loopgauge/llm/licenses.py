"""License scans by ordered signature rules.

A text becomes its words in lower case, joined by spaces. Anchor words gate the rules: a
rule's regex runs only where one of its anchors occurs. All hits become detections (word interval, label,
priority); in order of priority, then length, then place, a detection that lies inside an accepted one
is suppressed. The rules are ordered: exact contract phrases first, then SPDX tags, full license sentences,
names with versions, bare names, and general statements last.

Defined cases: null and empty texts have no words, no labels and score 0; texts are read whole; equal
texts get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label, names as word regexes, versions that a name can carry, the anchor every name holds.
FAMILIES = [
    ("apache", r"apache(?: software)?(?: license)?|asl", ("1 0", "1 1", "2", "2 0"), "apache"),
    ("gpl", r"gnu general public licen[sc]e|general public licen[sc]e|gnu gpl|gpl", ("1", "2", "2 0", "3", "3 0"), "gpl|general public"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e|(?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl", ("2", "2 0", "2 1", "3", "3 0"), "lgpl|general public"),
    ("agpl", r"gnu affero general public licen[sc]e|affero general public licen[sc]e|gnu agpl|agpl", ("1", "3", "3 0"), "agpl|affero"),
    ("gfdl", r"gnu free documentation licen[sc]e|gfdl", ("1 1", "1 2", "1 3"), "gfdl|free documentation"),
    ("mpl", r"mozilla public licen[sc]e|mpl", ("1 0", "1 1", "2", "2 0"), "mpl|mozilla"),
    ("epl", r"eclipse public licen[sc]e|epl", ("1 0", "2 0"), "epl|eclipse"),
    ("cddl", r"common development and distribution licen[sc]e|cddl", ("1 0", "1 1"), "cddl|common development"),
    ("cpl", r"common public licen[sc]e", ("1 0",), "common public"),
    ("eupl", r"european union public licen[sc]e|eupl", ("1 0", "1 1", "1 2"), "eupl|european union public"),
    ("artistic", r"artistic licen[sc]e", ("1 0", "2 0"), "artistic"),
    ("osl", r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0"), "open software"),
    ("afl", r"academic free licen[sc]e", ("1 2", "2 0", "2 1", "3 0"), "academic free"),
    ("boost", r"boost software licen[sc]e|bsl", ("1 0",), "boost|bsl"),
    ("python", r"python software foundation licen[sc]e|psf licen[sc]e", ("2", "2 0"), "psf|python software"),
    ("zpl", r"zope public licen[sc]e", ("1 1", "2 0", "2 1"), "zope"),
    ("ofl", r"sil open font licen[sc]e|open font licen[sc]e", ("1 0", "1 1"), "open font"),
    ("lppl", r"latex project public licen[sc]e|lppl", ("1 0", "1 2", "1 3"), "latex project|lppl"),
    ("odbl", r"open database licen[sc]e|odbl", ("1 0",), "open database|odbl"),
    ("odc-by", r"open data commons attribution licen[sc]e", ("1 0",), "open data commons"),
    ("php", r"php licen[sc]e", ("3 0", "3 01"), "php"),
    ("cecill", r"cecill", ("1 0", "2 0", "2 1"), "cecill"),
    ("upl", r"universal permissive licen[sc]e", ("1 0",), "universal permissive"),
    ("mspl", r"microsoft public licen[sc]e|ms pl", (), "microsoft public|ms pl"),
    ("mit", r"mit licen[sc]e|expat licen[sc]e|mit x11 licen[sc]e", (), "mit|expat"),
    ("x11", r"x11 licen[sc]e", (), "x11"),
    ("isc", r"isc licen[sc]e", (), "isc"),
    ("zlib", r"zlib licen[sc]e|zlib libpng licen[sc]e", (), "zlib"),
    ("unlicense", r"unlicense", (), "unlicense"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[sc]e", ("1", "2"), "wtfpl|do what the"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?", (), "bsd"),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?", (), "bsd"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?", (), "bsd"),
    ("bsd", r"bsd licen[sc]e|bsd style licen[sc]e", (), "bsd"),
]
#: Creative Commons elements and versions.
CC_ELEMENTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_NAMES = ("attribution", "attribution share ?alike", "attribution non ?commercial", "attribution no ?deriv(?:ative)?s?", "attribution non ?commercial share ?alike", "attribution non ?commercial no ?deriv(?:ative)?s?")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences of license texts and general statements.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution and use"),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors", "neither the name"),
    ("zlib", r"this software is provided as is without any express or implied warranty", "without any express"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("apache-2", r"www apache org licenses license 2 0", "apache org"),
    ("gpl", r"free software you can redistribute it and or modify it under the terms", "you can redistribute"),
    ("boost", r"distributed under the boost software license", "boost"),
    ("wtfpl", r"you just do what the fuck you want to", "do what the"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", "cc0|creative commons"),
    ("proprietary", r"all rights reserved", "all rights"),
    ("proprietary", r"proprietary and confidential", "proprietary"),
    ("proprietary", r"unauthorized copying of this file", "unauthorized copying"),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", "copyright"),
    ("copyright", r"copyright (?:c|©)", "copyright"),
]

#: Hand-written signatures, a label and the words of a notice, title or clause as a regex. The words before the first sign of a
#: regex, three at most, are the rule's anchor.
NOTICES = """
mit|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|to deal in the software without restriction including without limitation the rights to use copy modify merge publish
mit|in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit|this software is (?:released|licensed|distributed|available) under (?:the )?terms of the mit
mit|mit style licen[sc]e
apache-2|you may not use this file except in compliance with the license
apache-2|you may not use this (?:project|software|work|module|package) except in compliance with the license
apache-2|unless required by applicable law or agreed to in writing software
apache-2|distributed on an as is basis without warranties or conditions of any kind
apache-2|see the notice file distributed with this work for additional information
apache-2|licensed to the apache software foundation
apache-1.1|this product includes software developed by the apache software foundation
gpl|this program is distributed in the hope that it will be useful but without any warranty
gpl|without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
gpl|you should have received a copy of the gnu general public licen[sc]e
gpl|along with this program if not (?:see|write to)
gpl|write to the free software foundation
gpl|everyone is permitted to copy and distribute verbatim copies of this license document
gpl-2+|either version 2 of the licen[sc]e or (?:at your option )?any later version
gpl-3+|either version 3 of the licen[sc]e or (?:at your option )?any later version
gpl-2|gnu general public licen[sc]e version 2 only
gpl-3|gnu general public licen[sc]e version 3 only
gpl-exception|as a special exception the copyright holders (?:of this library )?give (?:you )?permission to link
gpl-exception|linking this library statically or dynamically with other modules
gpl-exception|if other files instantiate templates or use macros or inline functions from this file
lgpl|this library is free software you can redistribute it
lgpl|you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
lgpl-2.1+|either version 2 1 of the licen[sc]e or (?:at your option )?any later version
agpl|you should have received a copy of the gnu affero general public licen[sc]e
agpl|all users interacting with it remotely through a computer network
gfdl|permission is granted to copy distribute and or modify this document
gfdl|with no invariant sections no front cover texts and no back cover texts
bsd|redistributions of source code must retain the above copyright notice
bsd|redistributions in binary form must reproduce the above copyright notice
bsd|this software is provided by the (?:regents|author|authors|copyright holders?)(?: and contributors)? as is
bsd-2-clause|the views and conclusions contained in the software and documentation are those of the authors
bsd-3-clause|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|all advertising materials mentioning features or use of this software must display
bsd-3-clause-clear|no express or implied licenses to any party s patent rights are granted
bsd|use of this source code is governed by a bsd style licen[sc]e
0bsd|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|the software is provided as is and the author disclaims all warranties
hpnd|permission to use copy modify distribute and sell this software and its documentation for any purpose
hpnd|permission to use copy modify and distribute this software and its documentation for any purpose and without fee
postgresql|permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
mpl-2|this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-2|if a copy of the mpl was not distributed with this file
mpl-1.1|the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-2|this source code form is incompatible with secondary licenses
epl|this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
cddl|the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cddl|you can obtain a copy of the license at usr src opensolaris
zlib|the origin of this software must not be misrepresented
zlib|altered source versions must be plainly marked as such
zlib|this notice may not be removed or altered from any source distribution
boost|permission is hereby granted free of charge to any person or organization obtaining a copy of the software
boost|see accompanying file license 1 0 txt
unlicense|anyone is free to copy modify publish use compile sell or distribute this software
unlicense|the author or authors of this code dedicate any and all copyright interest
cc0|the person who associated a work with this deed has dedicated the work
cc0|to the extent possible under law .{1,60}? has waived all copyright
public-domain|this (?:file|work|code|software|image) is in the public domain
public-domain|no copyright is claimed
public-domain|this is a work of the u s government
cc|this (?:work|article|document|text|image|page|site) is licensed under a creative commons
cc|except where otherwise noted content on this site is licensed under
cc|some rights reserved
cc-by|you must give appropriate credit provide a link to the licen[sc]e
cc-by|you are free to share copy and redistribute the material in any medium or format
cc-by-nc|you may not use the material for commercial purposes
cc-by-nd|if you remix transform or build upon the material you may not distribute the modified material
cc-by-sa|if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e
cc-by-sa|text is available under the creative commons attribution sharealike licen[sc]e
ofl|this font software is licensed under the sil open font licen[sc]e
ofl|the fonts including any derivative works can be bundled embedded redistributed
ofl|with reserved font name
artistic|you may make and give away verbatim copies of the source form
artistic|under the same terms as perl itself
php|this product includes php software
python|psf is making python .{0,20}?available to licensee on an as is basis
openssl|this product includes software developed by the openssl project
ssleay|this product includes cryptographic software written by eric young
beerware|as long as you retain this notice you can do whatever you want with this stuff
beerware|you can buy me a beer in return
json|the software shall be used for good not evil
lppl|this work may be distributed and or modified under the conditions of the latex project public licen[sc]e
libpng|the png reference library is supplied as is
ijg|this software is based in part on the work of the independent jpeg group
freetype|portions of this software are copyright .{0,20}?the freetype project
bzip2|julian seward jseward acm org
info-zip|info zip grants permission
curl|permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
w3c|w3c software (?:and document )?notice and licen[sc]e
w3c|by obtaining using and or copying this work you the licensee agree
unicode|unicode (?:data files and software )?licen[sc]e agreement
unicode|to deal in the data files or software without restriction
ncsa|university of illinois ncsa open source licen[sc]e
ncsa|to deal with the software without restriction
ecl|educational community licen[sc]e
efl|eiffel forum licen[sc]e
fair|usage of the works is permitted provided that this instrument is retained with the works
qpl|q public licen[sc]e
ipl|ibm public licen[sc]e
apsl|apple public source licen[sc]e
spl|sun public licen[sc]e
intel|intel open source licen[sc]e
nokia|nokia open source licen[sc]e
nasa|nasa open source agreement
ngpl|nethack general public licen[sc]e
oclc|oclc research public licen[sc]e
rpsl|real ?networks public source licen[sc]e
rpl|reciprocal public licen[sc]e
simpl|simple public licen[sc]e
sleepycat|redistributions in any form must be accompanied by information on how to obtain complete source code
vsl|vovida software licen[sc]e
watcom|sybase open watcom public licen[sc]e
xfree86|xfree86 licen[sc]e
miros|miros licen[sc]e
mulan|mulan (?:psl|permissive software licen[sc]e)
blueoak|blue oak model licen[sc]e
hippocratic|hippocratic licen[sc]e
anti-996|anti 996 licen[sc]e
parity|parity public licen[sc]e
prosperity|prosperity public licen[sc]e
cern-ohl|cern open hardware licen[sc]e
tapr-ohl|tapr open hardware licen[sc]e
solderpad|solderpad hardware licen[sc]e
free-art|free art licen[sc]e
ogl|open gam(?:e|ing) licen[sc]e
ruby|ruby s licen[sc]e
vim|vim licen[sc]e
odbl|this .{1,60}? database is made available under the open database licen[sc]e
odbl|any rights in individual contents of the database are licensed under the database contents licen[sc]e
pddl|open data commons public domain dedication
cdla-permissive|community data licen[sc]e agreement permissive
cdla-sharing|community data licen[sc]e agreement sharing
ogl-uk|contains public sector information licensed under the open government licen[sc]e
ogl-uk|open government licen[sc]e
etalab|licence ouverte
dl-de|datenlizenz deutschland
bsl-business|business source licen[sc]e
sspl|server side public licen[sc]e
elastic|elastic licen[sc]e
commons-clause|commons clause licen[sc]e condition
commons-clause|the license does not grant to you the right to sell the software
polyform|polyform (?:noncommercial|small business|shield|strict|internal use) licen[sc]e
rsal|redis source available licen[sc]e
confluent|confluent community licen[sc]e
openrail|openrail m
openrail|openrail licen[sc]e
openrail|creativeml open rail m
openrail|responsible ai licen[sc]e
llama|llama (?:2 |3 )?community licen[sc]e
gemma|gemma terms of use
noncommercial|for non ?commercial (?:use|purposes) only
noncommercial|commercial use is (?:prohibited|not permitted|not allowed|strictly prohibited)
noncommercial|for (?:educational|research|academic)(?: and research)? (?:use|purposes) only
noncommercial|free for personal use
proprietary|this software is the confidential and proprietary information
proprietary|no part of this (?:publication|book|document|work|software) may be reproduced
proprietary|reproduction in whole or in part without (?:written |prior )?permission is (?:strictly )?prohibited
proprietary|licensed materials property of
proprietary|for internal use only
proprietary|may not be (?:copied|reproduced|redistributed|published) (?:or distributed )?without (?:the )?(?:express|prior|written)
proprietary|this product is licensed not sold
proprietary|end user licen[sc]e agreement
proprietary|by (?:installing|downloading|using) this software you agree to
proprietary|trade secrets? of
proprietary|unpublished rights reserved under the copyright laws
proprietary|reverse engineering .{0,40}?is prohibited
permissive|free to use for any purpose
permissive|use at your own risk no warranty
permissive|do whatever you want with (?:it|this|this code|this software)
attribution|used with permission
attribution|reprinted with permission
attribution|courtesy of the copyright holder
copyleft|licensed under the same terms
dual|dual licensed under
dual|available under (?:either|both) of the following licenses
""".strip()

#: Labels of general statements, which go after all names of licenses.
WEAK = ("proprietary", "copyright", "noncommercial", "permissive", "attribution", "copyleft", "dual")

#: Fixed value: words before a license's name.
LEAD = r"(?:(?:licen[sc]ed|released|distributed|available|published) )?(?:under|subject to) (?:the )?(?:terms of )?(?:the )?"

#: Bytes that are no word: everything in ASCII but digits and letters. A-Z are lower-cased.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    regex: re.Pattern
    anchors: tuple[bytes, ...]
    priority: int  # lower goes first
    confidence: float


def _rule(label: str, pattern: str, anchors: str, priority: int, confidence: float) -> Rule:
    regex = re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")
    return Rule(label, regex, tuple(a.encode() for a in anchors.split("|")), priority, confidence)


def anchor_of(pattern: str) -> str:
    """The literal words that a pattern begins with, three at most; those of each branch where it begins with a choice."""
    if pattern.startswith("(?:"):
        return "|".join(anchor_of(branch) for branch in pattern[3 : pattern.index(")")].split("|"))
    literal = re.match(r"[^?(\[.]*", pattern)[0]
    whole = literal if len(literal) == len(pattern) else literal[: literal.rfind(" ") + 1]
    return " ".join(whole.split()[:3])


def build_rules() -> list[Rule]:
    """All rules in order: base, SPDX, sentences, licensed-under with version, names with version, bare names, general."""
    rules = [_rule(label, phrase, phrase, 0, 1.0) for phrase, label in BASE.items()]
    for label, names, versions, anchors in FAMILIES:
        short = label.replace("-", " ")
        rules.append(_rule(label, rf"spdx licen[sc]e identifier {short}", "spdx", 1, 1.0))
        for v in sorted(versions, key=len, reverse=True):
            named = label + "-" + v.replace(" ", ".").removesuffix(".0")
            version = rf"(?: licen[sc]e)?(?: version| v)? ?{v}"
            rules.append(_rule(named, rf"spdx licen[sc]e identifier {short} {v}(?: only| or later)?", "spdx", 1, 1.0))
            rules.append(_rule(named + "+", rf"(?:{LEAD})?(?:{names}){version} or (?:any later version|later)", anchors, 3, 0.98))
            rules.append(_rule(named, rf"{LEAD}(?:{names}){version}", anchors, 4, 0.95))
            rules.append(_rule(named, rf"(?:{names}){version}", anchors, 5, 0.9))
        rules.append(_rule(label, rf"{LEAD}(?:{names})", anchors, 6, 0.9))
        if label not in ("boost", "apache", "cecill"):
            rules.append(_rule(label, names, anchors, 8, 0.7))
    for elements, name in zip(CC_ELEMENTS, CC_NAMES, strict=True):
        label = "cc-" + elements.replace(" ", "-")
        for v in CC_VERSIONS:
            rules.append(_rule(f"{label}-{v[0]}.{v[2]}", rf"(?:spdx licen[sc]e identifier )?cc {elements} {v}", "cc by", 2, 0.98))
            rules.append(_rule(f"{label}-{v[0]}.{v[2]}", rf"creative commons {name} {v}(?: international| unported| generic)?", "creative commons", 2, 0.95))
        rules.append(_rule(label, rf"cc {elements}", "cc by", 7, 0.85))
        rules.append(_rule(label, rf"creative commons {name}", "creative commons", 7, 0.85))
    rules += [_rule(label, p, a, 2 if label not in ("proprietary", "copyright") else 9, 0.9 if label not in ("proprietary", "copyright") else 0.5) for label, p, a in SENTENCES]
    for label, pattern in (line.split("|", 1) for line in NOTICES.splitlines()):
        weak = label in WEAK
        rules.append(_rule(label, pattern, anchor_of(pattern), 9 if weak else 2, 0.5 if weak else 0.9))
    return sorted(rules, key=lambda r: r.priority)


class Scanner:
    def __init__(self):
        self.rules = build_rules()
        self.by_anchor: dict[bytes, list[int]] = {}
        for i, r in enumerate(self.rules):
            for a in r.anchors:
                self.by_anchor.setdefault(a, []).append(i)
        self.gate = ahocorasick.Automaton()
        for a in self.by_anchor:
            self.gate.add_word(" " + a.decode("latin-1"), a)
        self.gate.make_automaton()

    def scan(self, text: str | None) -> dict:
        """Word count, base places, and the detections that survive."""
        words = (text or "").encode("utf-8", "replace").translate(_WORDS).split()
        out = {"n_words": len(words), "base": [], "detections": []}
        line = b" " + b" ".join(words) + b" "
        anchors = {a for _, a in self.gate.iter(line.decode("latin-1"))}  # a character for each byte
        if not anchors:
            return out
        starts = [m.start() for m in re.finditer(rb" ", line)]  # the k-th space stands before word k
        hits = []
        for i in sorted({i for a in anchors for i in self.by_anchor[a]}):
            rule, at = self.rules[i], 0
            while m := rule.regex.search(line, at):
                first, last = bisect.bisect_left(starts, m.start() - 1), bisect.bisect_left(starts, m.end()) - 1
                hits.append((rule.priority, first - last, first, i, last))
                at = m.start() + 1 if rule.priority == 0 else m.end()
        out["base"] = sorted((h[2], self.rules[h[3]].label) for h in hits if h[0] == 0)
        reach: dict[int, int] = {}  # of the accepted intervals: where the longest one from each first word ends
        longest = max((h[4] - h[2] for h in hits), default=0)
        for _, _, first, i, last in sorted(hits):
            inside = any(reach.get(a, -1) >= last for a in range(max(0, last - longest), first + 1))
            if not inside or self.rules[i].priority == 0:
                reach[first] = max(last, reach.get(first, -1))
                out["detections"].append((first, last, self.rules[i].label, self.rules[i].confidence))
        return out


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, detections) of every row of docs (doc_id, text)."""
    hit = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])
    base = pa.struct([("first", pa.int64()), ("label", pa.string())])

    def run(batches):
        scanner = Scanner()
        for b in batches:
            found = [scanner.scan(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b["doc_id"].cast(pa.int64()),
                pa.array([f["n_words"] for f in found], pa.int64()),
                pa.array([[{"first": p, "label": x} for p, x in f["base"]] for f in found], pa.list_(base)),
                pa.array([[{"first": a, "last": z, "label": x, "confidence": c} for a, z, x, c in f["detections"]] for f in found], pa.list_(hit)),
            ], ["doc_id", "n_words", "base", "detections"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, base array<struct<first:long,label:string>>, detections array<struct<first:long,last:long,label:string,confidence:double>>"
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return scanned(common.table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words", "CAST(size(base) AS BIGINT) AS n_base",
        "array_min(base.first) AS first_word", "array_max(base.first) AS last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(base.label, detections.label))), ',') AS labels",
        "coalesce(array_max(detections.confidence), 0D) AS score",
    )
