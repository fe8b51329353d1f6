"""Operator 7: ordered signature rules for license statements (native).

A text is lower-cased and cut into words; a rule is an anchor word with a regular expression that
must end just before it and one that must begin at it, both over words joined by single spaces. A
keyword prefilter passes over texts that hold no anchor at all; in the others each rule is tried
only at its own anchor word, on a window of words around it that is as wide as the longest match of the anchor's rules, so
the cost is linear in the text. A rule with a gap ("... .* ...") is as long as the text may make it: its parts are found apart, as
rules with anchors of their own, and joined by their places, each first part with the next of the following ones.

Rules are ordered by priority (1 is most specific). A detection that lies inside another one of
higher priority, or inside a longer one of equal priority, is suppressed; the base phrases never are. There are some
hundreds of rules: sentences of license texts written out one by one (grants, conditions, disclaimers, notices), and
ways to name a license, which follow from lists of families and versions.

Defined results: a null or empty text has no words and no detections; repeated rows get equal
results; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import let

GAP = " .* "


class Signature(NamedTuple):
    anchor: str
    before: str  # words before the anchor, each followed by one space
    after: str  # words after the anchor, each preceded by one space
    label: str
    priority: int
    base: bool = False
    open: int = -1  # number of the rule with gaps that this is a part of, its place in it, and whether it is the last
    part: int = 0
    last: bool = False


#: The base phrases.
BASE = (
    Signature("license", "under the mit ", "", "mit", 1, True),
    Signature("license", "apache ", " version 2", "apache-2", 1, True),
    Signature("cc", "", " by nc", "cc-by-nc", 1, True),
)

#: Family label, its names as regular expressions over words, its versions.
FAMILIES = (
    ("gpl", ("gnu general public", "gnu gpl", "gpl"), ("1", "2", "3")),
    ("lgpl", ("gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl"), ("2", "2 1", "3")),
    ("agpl", ("gnu affero general public", "affero general public", "gnu agpl", "agpl"), ("1", "3")),
    ("gfdl", ("gnu free documentation", "gfdl", "gnu fdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache software", "apache"), ("1 0", "1 1", "2 0", "2")),
    ("mpl", ("mozilla public", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution", "cddl"), ("1 0", "1 1")),
    ("eupl", ("european union public", "eupl"), ("1 0", "1 1", "1 2")),
    ("osl", ("open software", "osl"), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free", "afl"), ("1 2", "2 0", "2 1", "3 0")),
    ("artistic", ("artistic",), ("1 0", "2 0")),
    ("lppl", ("latex project public", "lppl"), ("1 0", "1 2", "1 3")),
    ("ofl", ("sil open font", "open font"), ("1 0", "1 1")),
    ("odbl", ("open database", "odbl"), ("1 0",)),
    ("bsl", ("boost software",), ("1 0",)),
    ("cpl", ("common public",), ("1 0",)),
    ("zpl", ("zope public",), ("2 0", "2 1")),
    ("psf", ("python software foundation",), ("2",)),
    ("php", ("php",), ("3 0", "3 01")),
)
#: Label and the words before "license".
PLAIN = (
    ("mit", "mit"), ("mit", "expat"), ("isc", "isc"), ("zlib", "zlib"), ("bsd", "bsd"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-2-clause", "simplified bsd"),
    ("bsd-2-clause", "freebsd"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-3-clause", "new bsd"), ("bsd-3-clause", "modified bsd"), ("bsd-4-clause", "bsd 4 clause"),
    ("bsd-4-clause", "original bsd"), ("bsd-0-clause", "zero clause bsd"), ("x11", "x11"), ("ncsa", "ncsa"), ("postgresql", "postgresql"), ("openssl", "openssl"),
    ("ms-pl", "microsoft public"), ("ms-rl", "microsoft reciprocal"), ("wtfpl", "do what the fuck you want to public"), ("unlicense", "the un"), ("beerware", "beerware"),
    ("vim", "vim"), ("ruby", "ruby"), ("perl", "perl"), ("curl", "curl"), ("icu", "icu"), ("unicode", "unicode"), ("w3c", "w3c"), ("sleepycat", "sleepycat"),
)
#: The elements and versions of Creative Commons licenses, by code and by name.
CC_ELEMENTS = (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s?"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Other statements.
OTHER = (
    Signature("copyright", "", " (?:c )?(?:[a-z0-9]+ ){0,6}all rights reserved", "all-rights-reserved", 3),
    Signature("copyright", "", " (?:c )?(?:19|20)[0-9]{2}", "copyright-notice", 4),
    Signature("rights", "all ", " reserved", "all-rights-reserved", 4),
    Signature("rights", "no ", " reserved", "cc0", 3),
    Signature("domain", "in(?:to)? the public ", "", "public-domain", 3),
    Signature("domain", "public ", " dedication", "public-domain", 2),
    Signature("cc0", "", "(?: 1 0)?(?: universal)?", "cc0", 2),
    Signature("unlicense", "", "", "unlicense", 3),
    Signature("wtfpl", "", "", "wtfpl", 3),
    Signature("licensed", "", " under(?: [^ ]+){1,6}", "license-statement", 4),
    Signature("license", "", "", "license-mention", 5),
    Signature("licence", "", "", "license-mention", 5),
    Signature("licensed", "", "", "license-mention", 5),
)


#: Sentences of license texts, as label, priority and words with the anchor word in brackets.
SENTENCES = (
    ("mit", 2, "permission is hereby [granted] free of charge to any person obtaining a copy of this software"),
    ("mit", 2, "the above copyright notice and this [permission] notice shall be included in all copies or substantial portions"),
    ("mit-0", 2, "[permission] is hereby granted free of charge to deal in this software without restriction"),
    ("as-is", 4, "software is provided as is without [warranty] of any kind(?: express or implied)?"),
    ("as-is", 4, "software is provided as is and any express(?:ed)? or implied [warranties]"),
    ("as-is", 4, "without even the implied [warranty] of merchantability or fitness for a particular purpose"),
    ("bsd", 2, "[redistribution] and use in source and binary forms with or without modification are permitted"),
    ("bsd", 3, "[redistributions] of source code must retain the above copyright notice"),
    ("bsd", 3, "[redistributions] in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 2, "names of its [contributors] may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", 2, "(?:the )?name of the author may not be used to endorse or promote products derived from this [software]"),
    ("bsd-4-clause", 2, "all advertising materials mentioning features or use of this [software] must display"),
    ("bsd-4-clause", 2, "this product includes [software] developed by the university of california"),
    ("bsd-0-clause", 2, "[permission] to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 2, "[permission] to use copy modify and (?:or )?distribute this software for any purpose .* provided that the above copyright notice"),
    ("hpnd", 2, "[permission] to use copy modify and distribute this software and its documentation for any purpose"),
    ("x11", 2, "shall not be used in advertising or otherwise to promote the sale use or other dealings in this [software]"),
    ("ncsa", 2, "to deal with the [software] without restriction"),
    ("gpl", 2, "this program is free [software] you can redistribute it and or modify it"),
    ("gpl", 3, "this program is distributed in the hope that it will be useful but without any [warranty]"),
    ("gpl", 2, "you should have received a copy of the gnu general public [license] along with this program"),
    ("gpl", 3, "everyone is [permitted] to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", 3, "when we speak of free [software] we are referring to freedom not price"),
    ("gpl", 2, "the gnu general public [license] is a free copyleft license for software and other kinds of works"),
    ("lgpl", 2, "this library is free [software] you can redistribute it and or modify it"),
    ("lgpl", 2, "you should have received a copy of the gnu (?:lesser|library) general public [license] along with this library"),
    ("lgpl-3", 2, "this version of the gnu lesser general public [license] incorporates the terms and conditions"),
    ("agpl", 2, "the gnu affero general public [license] is a free copyleft license for software and other kinds of works"),
    ("agpl", 2, "your modified version must prominently offer all users interacting with it remotely .* the corresponding source .* [license]"),
    ("gfdl", 2, "[permission] is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gcc-exception", 2, "under section 7 of gpl version 3 you are [granted] additional permissions described in the gcc runtime library exception"),
    ("classpath-exception", 2, "as a special exception the copyright holders of this library give you [permission] to link this library with independent modules"),
    ("apache-2.0", 2, "you may not use this file except in compliance with the [license]"),
    ("apache-2.0", 2, "unless required by applicable law or agreed to in writing [software] distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 2, "see the [license] for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 2, "conditions of this license each [contributor] hereby grants to you a perpetual worldwide non exclusive"),
    ("apache-1.1", 2, "this product includes [software] developed by the apache software foundation"),
    ("mpl-2.0", 2, "this source code form is subject to the terms of the mozilla public [license] v 2 0"),
    ("mpl-2.0", 2, "each [contributor] hereby grants you a world wide royalty free non exclusive license"),
    ("mpl-1.1", 2, "the contents of this file are subject to the mozilla public [license] version 1 1"),
    ("epl", 2, "the accompanying program is provided under the terms of this eclipse public [license]"),
    ("epl", 2, "the accompanying materials are made available under the terms of the eclipse public [license]"),
    ("cddl", 2, "the contents of this file are subject to the terms of the common development and distribution [license]"),
    ("eupl", 2, "[licensed] under the eupl"),
    ("bsl-1.0", 2, "permission is hereby [granted] free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", 2, "altered source versions must be plainly marked as such and must not be misrepresented as being the original [software]"),
    ("zlib", 2, "the origin of this [software] must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 3, "[permission] is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", 2, "this is free and unencumbered [software] released into the public domain"),
    ("unlicense", 2, "anyone is free to copy modify publish use compile sell or distribute this [software]"),
    ("wtfpl", 2, "everyone is [permitted] to copy and distribute verbatim or modified copies of this license document"),
    ("beerware", 2, "as long as you retain this [notice] you can do whatever you want with this stuff"),
    ("json", 2, "the [software] shall be used for good not evil"),
    ("cc0", 2, "has dedicated the work to the public [domain] by waiving all of his or her rights to the work"),
    ("cc0", 2, "irrevocably and unconditionally waives .* all of affirmer s [copyright] and related rights"),
    ("cc-by", 3, "you must give appropriate credit provide a link to the [license] and indicate if changes were made"),
    ("cc-by-sa", 3, "build upon the material you must distribute your contributions under the same [license] as the original"),
    ("cc-by-nd", 3, "if you remix transform or build upon the material you may not distribute the modified material .* [license]"),
    ("cc", 4, "this work is [licensed] under a creative commons(?: [a-z]+){0,6}"),
    ("artistic-1.0", 2, "the intent of this document is to state the conditions under which a package may be copied such that the [copyright] holder maintains"),
    ("artistic-2.0", 2, "this [license] establishes the terms under which a given free software package may be copied modified distributed"),
    ("ofl", 2, "the goals of the open font [license] ofl are to stimulate worldwide development of collaborative font projects"),
    ("ofl", 2, "[copyright] .* with reserved font name"),
    ("odbl", 2, "any derivative database that you publicly use must be only under the terms of .* [license]"),
    ("psf-2", 2, "psf hereby grants licensee a nonexclusive royalty free world wide [license] to reproduce analyze test"),
    ("php", 2, "this product includes php [software] freely available from"),
    ("openssl", 2, "this product includes [software] developed by the openssl project"),
    ("ssleay", 2, "this product includes cryptographic [software] written by eric young"),
    ("ms-pl", 2, "if you bring a patent claim against any [contributor] over patents that you claim are infringed by the software"),
    ("lppl", 2, "this work may be distributed and or modified under the conditions of the latex project public [license]"),
    ("sspl", 2, "server side public [license]"),
    ("busl", 2, "business source [license](?: 1 1)?"),
    ("elastic", 2, "elastic [license](?: 2 0)?"),
    ("commons-clause", 2, "subject to the commons clause [license] condition"),
    ("rail", 2, "(?:creativeml |bigscience |bigcode )?open ?rail(?: ?[ms+]+)? [license]"),
    ("llama", 2, "llama(?: [0-9]+){0,4} community [license](?: agreement)?"),
    ("public-domain", 2, "work of the (?:us|u s|united states) government .* not subject to [copyright] protection"),
    ("proprietary", 2, "this [software] is the confidential and proprietary information of"),
    ("proprietary", 2, "unauthorized copying of this file via any medium is strictly prohibited .* [copyright]"),
    ("proprietary", 3, "no part of this (?:publication|document|work) may be reproduced .* without (?:the )?(?:prior )?(?:written )?[permission]"),
    ("proprietary", 3, "reproduction in whole or in part without [permission] is prohibited"),
    ("eula", 2, "by installing copying or otherwise using (?:the|this) [software] you agree to be bound by"),
    ("eula", 3, "end user [license] agreement"),
    ("academic-only", 2, "for non ?commercial research (?:and|or) educational use only .* [permission]"),
    ("academic-only", 3, "[permission] is granted for (?:personal|academic|research|educational) use(?: only)?"),
)


def _sentence(label: str, priority: int, words: str, number: int) -> list[Signature]:
    """The rule of a sentence, or those of its parts; a part without an anchor of its own gets its longest word."""
    parts = words.split(GAP)
    out = []
    for k, part in enumerate(parts):
        if "[" not in part:
            anchor = max(re.findall(r"(?<![^ ])[a-z]+(?![^ ])", part), key=len)
            part = re.sub(rf"(?<![^ ]){anchor}(?![^ ])", f"[{anchor}]", part, count=1)
        before, anchor, after = re.fullmatch(r"(.*?)\[([a-z]+)\](.*)", part).groups()
        out.append(Signature(anchor, before, after, label, priority) if len(parts) == 1 else Signature(anchor, before, after, label, priority, False, number, k, k == len(parts) - 1))
    return out


def longest(pattern: str) -> int:
    """Words that a match of a rule's pattern can have at most: alternatives count together, counted groups as often as they may repeat."""
    repeated = re.findall(r"\(\?:([^()]*)\)\{\d+,(\d+)\}", pattern)
    if ".*" in pattern or ".+" in pattern or re.search(r"\)[*+]", pattern):
        raise ValueError(f"{pattern!r} has no longest match; put {GAP!r} between its parts")
    return pattern.count(" ") + sum(x.count(" ") * (int(n) - 1) for x, n in repeated) + 1


def signatures() -> tuple[Signature, ...]:
    """All rules in order; generated, so that each family has every way to state each version."""
    out = list(BASE)
    for label, names, versions in FAMILIES:
        for name in names:
            words = name.split(" ")
            for v in versions:
                tag = f"{label}-{v.replace(' ', '.')}"
                number = f"(?: version| v)? {v}"
                for anchor in ("license", "licence"):
                    out.append(Signature(anchor, f"{name} ", f"{number} or (?:any )?later(?: version)?", f"{tag}-or-later", 1))
                    out.append(Signature(anchor, f"{name} ", f"{number}(?: only)?", tag, 2))
                if len(words) == 1:
                    out.append(Signature(name, "", f"{number} or (?:any )?later(?: version)?", f"{tag}-or-later", 1))
                    out.append(Signature(name, "", f"(?:v| v| version)? ?{v}(?: only)?", tag, 2))
                elif len(words) == 2 and words[0] == "gnu":
                    out.append(Signature(words[1], "gnu ", f"{number}(?: only)?", tag, 2))
            for anchor in ("license", "licence"):
                out.append(Signature(anchor, f"{name} ", "", label, 3))
    for label, name in PLAIN:
        for anchor in ("license", "licence"):
            out.append(Signature(anchor, f"{name} ", "", label, 3))
            out.append(Signature(anchor, f"under the (?:terms of the )?{name} ", "", label, 2))
    for code, name in CC_ELEMENTS:
        tag = f"cc-{code.replace(' ', '-')}"
        for v in CC_VERSIONS:
            out.append(Signature("cc", "", f" {code} {v}", f"{tag}-{v.replace(' ', '.')}", 1))
            out.append(Signature("commons", "creative ", f" {name} {v}", f"{tag}-{v.replace(' ', '.')}", 1))
            out.append(Signature("commons", "creative ", f" {name} license(?: version)? {v}", f"{tag}-{v.replace(' ', '.')}", 1))
        out.append(Signature("cc", "", f" {code}", tag, 3))
        out.append(Signature("commons", "creative ", f" {name}", tag, 3))
    return (*out, *(part for k, x in enumerate(SENTENCES) for part in _sentence(*x, k)), *OTHER)


#: What some word of every rule's anchor holds: the keyword prefilter.
GATES = ("licen", "copyright", "rights", "domain", "cc", "commons", "gpl", "wtfpl", "permi", "granted", "redistribution", "software", "warrant", "contributor", "notice")


def _gates(anchors: set[str]) -> list[str]:
    return [*GATES, *sorted(a for a in anchors if not any(g in a for g in GATES))]


def _words_in(x: Column) -> Column:
    """Spaces in x: each word of a match brings one."""
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _detections(words: Column, rules: tuple[Signature, ...]) -> Column:
    """Array of (start, end, priority, rule, label, base), in words, from an array of words; parts of rules with gaps are joined."""
    by_anchor: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        by_anchor.setdefault(r.anchor, []).append(i)
    text = json.dumps(
        [
            {
                "anchor": a,
                "left": max(longest(rules[i].before) for i in own),
                "right": max(longest(rules[i].after) for i in own),
                "rules": [
                    {
                        "before": f"(?:^| ){rules[i].before}$" if rules[i].before else "",
                        "after": f"^{rules[i].after}(?= |$)" if rules[i].after else "",
                        "priority": rules[i].priority,
                        "rule": i,
                        "label": rules[i].label,
                        "base": rules[i].base,
                        "open": rules[i].open,
                        "part": rules[i].part,
                        "last": rules[i].last,
                    }
                    for i in own
                ],
            }
            for a, own in by_anchor.items()
        ]
    )
    one = "struct<before:string,after:string,priority:int,rule:int,label:string,base:boolean,open:int,part:int,last:boolean>"
    packed = F.from_json(F.lit(text), f"array<struct<anchor:string,left:int,right:int,rules:array<{one}>>>")  # folded at planning
    anchors = F.array(*map(F.lit, by_anchor))

    def at(a: Column) -> Column:
        return let(F.get(F.filter(packed, lambda p: p["anchor"] == a["w"]), F.lit(0)), lambda own: around(a, own))

    def around(a: Column, own: Column) -> Column:
        i = a["i"]
        left = F.concat(F.array_join(F.slice(words, F.greatest(i - own["left"], F.lit(0)) + F.lit(1), F.least(i, own["left"])), " "), F.lit(" "))
        right = F.concat(F.lit(" "), F.array_join(F.slice(words, i + F.lit(2), own["right"]), " "))

        def tried(ctx: Column) -> Column:
            def one(r: Column) -> Column:
                hit = ((r["before"] == "") | F.rlike(ctx["left"], r["before"])) & ((r["after"] == "") | F.rlike(ctx["right"], r["after"]))
                lead = F.when(r["before"] == "", F.lit(0)).otherwise(_words_in(F.trim(F.call_function("regexp_extract", ctx["left"], r["before"], F.lit(0)))) + F.lit(1))
                tail = F.when(r["after"] == "", F.lit(0)).otherwise(_words_in(F.call_function("regexp_extract", ctx["right"], r["after"], F.lit(0))))
                return F.when(
                    hit,
                    F.struct((i - lead).alias("start"), (-(i + tail)).alias("minus_end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["base"].alias("base"), r["open"].alias("open"), r["part"].alias("part"), r["last"].alias("last")),
                )

            return F.filter(F.transform(own["rules"], one), lambda x: x.isNotNull())

        return let(F.struct(left.alias("left"), right.alias("right")), tried)

    places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(anchors, x["w"]))
    every = F.sort_array(F.flatten(F.transform(places, at)))
    return let(every, lambda found: F.when(F.exists(found, lambda d: d["open"] >= 0), F.sort_array(F.concat(F.filter(found, lambda d: d["open"] < 0), _joined(F.filter(found, lambda d: d["open"] >= 0), rules)))).otherwise(found))


def _joined(parts: Column, rules: tuple[Signature, ...]) -> Column:
    """Detections of rules with gaps from those of their parts, by start: a part continues the chain of the part before it, once, if that has ended."""
    numbers = sorted({r.open for r in rules if r.open >= 0})
    most = max(r.part for r in rules) + 1
    place = {n: k * most for k, n in enumerate(numbers)}
    at = F.create_map(*(F.lit(x) for pair in place.items() for x in pair))
    chain = "struct<start:int,end:int>"
    empty = F.struct(F.array_repeat(F.lit(None).cast(chain), len(numbers) * most).alias("open"), F.filter(parts, lambda d: F.lit(False)).alias("out"))

    def step(state: Column, d: Column) -> Column:
        mine = F.element_at(at, d["open"]) + d["part"]
        before = F.get(state["open"], mine - 1)
        begins = d["part"] == 0
        goes = begins | (before.isNotNull() & (before["end"] <= d["start"]))
        grown = F.struct(F.when(begins, d["start"]).otherwise(before["start"]).cast("int").alias("start"), (-d["minus_end"]).cast("int").alias("end"))
        opened = F.transform(state["open"], lambda x, k: F.when(~goes, x).when((k == mine) & ~d["last"], grown).when((k == mine - 1) & ~begins, F.lit(None).cast(chain)).otherwise(x))
        found = F.when(goes & d["last"], F.array_append(state["out"], d.withField("start", grown["start"]))).otherwise(state["out"])
        return F.struct(opened.alias("open"), found.alias("out"))

    return F.aggregate(parts, empty, step, lambda state: state["out"])


def scan(docs: DataFrame, rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """One row for each document: n_words, the base phrases' places, labels and a score from 0 to 1."""
    rules = rules or signatures()
    levels = max(r.priority for r in rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    gate = let(F.lower(text), lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(g)) for g in _gates({r.anchor for r in rules}))))
    # F.lower also lowers letters beyond ASCII, which no rule names; word ends stay the same.
    words = F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    none = F.array().cast("array<struct<start:int,minus_end:int,priority:int,rule:int,label:string,base:boolean,open:int,part:int,last:boolean>>")
    found = F.when(gate, let(words, lambda w: _detections(w, rules))).otherwise(none)

    def kept(dets: Column) -> Column:
        """Sorted by start, then longest, priority: what contains a detection comes before it."""
        empty = F.struct(
            F.array_repeat(F.lit(-1), levels).alias("reach"),
            F.array().cast("array<string>").alias("labels"),
            F.lit(levels + 1).alias("best"),
            F.lit(0).cast("long").alias("n"),
        )

        def step(a: Column, d: Column) -> Column:
            end = -d["minus_end"]
            inside = F.exists(F.transform(a["reach"], lambda r, k: (k < d["priority"]) & (r >= end)), lambda x: x) & ~d["base"]
            return F.when(inside, a).otherwise(
                F.struct(
                    F.transform(a["reach"], lambda r, k: F.when(k + F.lit(1) == d["priority"], F.greatest(r, end)).otherwise(r)).alias("reach"),
                    F.when(F.array_contains(a["labels"], d["label"]), a["labels"]).otherwise(F.array_append(a["labels"], d["label"])).alias("labels"),
                    F.least(a["best"], d["priority"]).alias("best"),
                    (a["n"] + F.lit(1)).alias("n"),
                )
            )

        return F.aggregate(dets, empty, step)

    def summed(dets: Column) -> Column:
        base = F.filter(dets, lambda d: d["base"])
        return F.struct(
            let(base, lambda b: F.struct(
                F.size(b).cast("long").alias("n_base"),
                F.array_min(F.transform(b, lambda d: d["start"])).cast("long").alias("first_word"),
                F.array_max(F.transform(b, lambda d: d["start"])).cast("long").alias("last_word"),
                F.array_join(F.array_sort(F.array_distinct(F.transform(b, lambda d: d["label"]))), ",").alias("base_labels"),
            )).alias("b"),
            kept(dets).alias("k"),
        )

    n_words = F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")
    all_of = docs.select("doc_id", n_words.alias("n_words"), let(found, summed).alias("s"))
    best = F.col("s.k.best")
    return all_of.select(
        "doc_id", "n_words", "s.b.*",
        F.array_join(F.array_sort("s.k.labels"), ",").alias("labels"),
        F.when(F.col("s.k.n") == 0, F.lit(0.0)).otherwise((F.lit(levels + 1) - best) / F.lit(float(levels))).alias("score"),
        F.col("s.k.n").alias("n_detections"),
    )
