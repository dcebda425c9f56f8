"""The ordered signature rules of the license scan.

Patterns read a text's words joined by single spaces: "Apache License, Version 2.0." is `apache license version 2 0`. NAMES
gives each license's names once; FRAMES says in which surroundings a name is a finding, so a rule is a frame with a name.
NOTICES are sentences that only the license's own text or header has.
"""

from __future__ import annotations

from dataclasses import dataclass

LICENSE = "licen[cs]e"
V1, V2, V3 = ("(?:version |v )?v?" + n for n in ("1(?: 0)?", "2(?: 0)?", "3(?: 0)?"))

#: (label, a word that all its names hold, names that are findings wherever they stand, further names that need a frame around them).
NAMES = (
    ("apache-1.1", "apache", f"apache (?:software )?{LICENSE} (?:version )?v?1 1", "apache 1 1"),
    ("apache-2.0", "apache", f"apache (?:software )?{LICENSE} {V2}|apache v?2(?: 0)? {LICENSE}|apache {LICENSE}", "apache v?2(?: 0)?"),
    ("mit", "mit", f"mit {LICENSE}|expat {LICENSE} mit", "mit"),
    ("x11", "x11", f"x11 {LICENSE}|mit x11 {LICENSE}", "x11"),
    ("isc", "isc", f"isc {LICENSE}", "isc"),
    ("bsd-2-clause", "bsd", f"(?:simplified|freebsd) bsd {LICENSE}|(?:bsd 2 clause|2 clause bsd|two clause bsd)(?: {LICENSE})?", ""),
    ("bsd-3-clause", "bsd", f"(?:new|modified|revised) bsd {LICENSE}|(?:bsd 3 clause|3 clause bsd|three clause bsd)(?: {LICENSE})?", ""),
    ("bsd-4-clause", "bsd", f"original bsd {LICENSE}|(?:bsd 4 clause|4 clause bsd)(?: {LICENSE})?", ""),
    ("0bsd", "0bsd", f"0bsd(?: {LICENSE})?|zero clause bsd {LICENSE}", ""),
    ("bsd", "bsd", f"bsd (?:style )?{LICENSE}", "bsd"),
    ("gpl-1.0", "general", f"gnu general public {LICENSE} {V1}", ""),
    ("gpl-2.0", "general", f"(?:gnu )?general public {LICENSE} {V2}", ""),
    ("gpl-3.0", "general", f"(?:gnu )?general public {LICENSE} {V3}", ""),
    ("gpl-2.0", "gpl", "gnu gpl (?:version |v )?2(?: 0)?", "gpl (?:version |v )?2(?: 0)?"),
    ("gpl-3.0", "gpl", "gnu gpl (?:version |v )?3(?: 0)?", "gpl (?:version |v )?3(?: 0)?"),
    ("gpl-2.0", "gplv2", "gplv2(?: 0)?", ""),
    ("gpl-3.0", "gplv3", "gplv3(?: 0)?", ""),
    ("gpl", "gpl", f"gnu gpl|gpl {LICENSE}", "gpl"),
    ("lgpl-2.0", "library", f"(?:gnu )?library general public {LICENSE}(?: {V2})?", ""),
    ("lgpl-2.1", "lesser", f"(?:gnu )?lesser general public {LICENSE} (?:version |v )?v?2 1", ""),
    ("lgpl-3.0", "lesser", f"(?:gnu )?lesser general public {LICENSE} {V3}", ""),
    ("lgpl", "lesser", f"(?:gnu )?lesser general public {LICENSE}", ""),
    ("lgpl-2.1", "lgpl", "lgpl (?:version |v )?2 1", ""),
    ("lgpl-3.0", "lgpl", "lgpl (?:version |v )?3(?: 0)?", ""),
    ("lgpl-3.0", "lgplv3", "lgplv3", ""),
    ("lgpl", "lgpl", f"gnu lgpl|lgpl {LICENSE}", "lgpl"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public {LICENSE}(?: {V3})?", ""),
    ("agpl-3.0", "agpl", f"gnu agpl|agpl (?:version |v )?3(?: 0)?|agpl {LICENSE}", "agpl"),
    ("agpl-3.0", "agplv3", "agplv3", ""),
    ("gfdl", "documentation", f"gnu free documentation {LICENSE}", ""),
    ("mpl-1.1", "mozilla", f"mozilla public {LICENSE} (?:version |v )?v?1 1", ""),
    ("mpl-2.0", "mozilla", f"mozilla public {LICENSE}(?: {V2})?", ""),
    ("mpl-2.0", "mpl", f"mpl 2 0|mpl {LICENSE}", "mpl"),
    ("epl-1.0", "eclipse", f"eclipse public {LICENSE} {V1}", ""),
    ("epl-2.0", "eclipse", f"eclipse public {LICENSE}(?: {V2})?", "epl 2 0"),
    ("cddl-1.0", "cddl", f"cddl(?: {V1})?", ""),
    ("cddl-1.0", "common", f"common development and distribution {LICENSE}(?: {V1})?", ""),
    ("cpl-1.0", "common", f"common public {LICENSE}(?: {V1})?", ""),
    ("cpal-1.0", "attribution", f"common public attribution {LICENSE}(?: {V1})?", ""),
    ("ipl-1.0", "ibm", f"ibm public {LICENSE}(?: {V1})?", ""),
    ("ms-pl", "microsoft", f"microsoft public {LICENSE}", "ms pl"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {LICENSE}", "ms rl"),
    ("artistic-2.0", "artistic", f"artistic {LICENSE} {V2}", ""),
    ("artistic-1.0", "artistic", f"(?:perl )?artistic {LICENSE}(?: {V1})?", ""),
    ("bsl-1.0", "boost", f"boost software {LICENSE}(?: {V1})?", "boost"),
    ("busl-1.1", "business", f"business source {LICENSE}(?: 1 1)?", ""),
    ("sspl-1.0", "server", f"server side public {LICENSE}(?: {V1})?", ""),
    ("elastic-2.0", "elastic", f"elastic {LICENSE}(?: {V2})?", ""),
    ("zlib", "zlib", f"zlib(?: libpng)? {LICENSE}", "zlib"),
    ("libpng", "libpng", f"libpng {LICENSE}", "libpng"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", ""),
    ("beerware", "beer", f"beer ?ware {LICENSE}", ""),
    ("python-2.0", "python", f"python (?:software foundation )?{LICENSE}(?: {V2})?", "psf"),
    ("php-3.01", "php", f"php {LICENSE}(?: (?:version )?3 01)?", ""),
    ("ruby", "ruby", f"ruby {LICENSE}|ruby s {LICENSE}", ""),
    ("postgresql", "postgresql", f"postgresql {LICENSE}", ""),
    ("openssl", "openssl", f"openssl {LICENSE}", ""),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa (?:open source )?{LICENSE}", ""),
    ("w3c", "w3c", f"w3c software (?:notice and )?(?:and document )?{LICENSE}", ""),
    ("unicode", "unicode", f"unicode {LICENSE}", ""),
    ("vim", "vim", f"vim {LICENSE}", ""),
    ("ofl-1.1", "font", f"(?:sil )?open font {LICENSE}(?: (?:version )?1 1)?", ""),
    ("osl-3.0", "open", f"open software {LICENSE}(?: {V3})?", ""),
    ("afl-3.0", "academic", f"academic free {LICENSE}(?: {V3})?", ""),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: 1 [12])?", ""),
    ("eupl-1.2", "eupl", "eupl(?: 1 [12])?", ""),
    ("cecill-2.1", "cecill", "cecill(?: (?:version )?2 [01])?", ""),
    ("mulanpsl-2.0", "mulan", f"mulan (?:psl|permissive software {LICENSE})(?: ?v?2)?", ""),
    ("upl-1.0", "universal", f"universal permissive {LICENSE}(?: {V1})?", ""),
    ("blueoak-1.0", "oak", f"blue oak model {LICENSE}(?: {V1})?", ""),
    ("zpl-2.1", "zope", f"zope public {LICENSE}(?: 2 1)?", ""),
    ("sleepycat", "sleepycat", f"sleepycat {LICENSE}", ""),
    ("qpl-1.0", "q", f"q public {LICENSE}(?: {V1})?", ""),
    ("odbl-1.0", "database", f"open (?:data commons open )?database {LICENSE}(?: {V1})?", "odbl"),
    ("pddl-1.0", "dedication", f"(?:open data commons )?public domain dedication and {LICENSE}", "pddl"),
    ("odc-by-1.0", "commons", f"open data commons attribution {LICENSE}(?: {V1})?", "odc by"),
    ("ogl-uk-3.0", "government", "open government licen[cs]e(?: v?3(?: 0)?)?", ""),
    ("llama-community", "llama", f"llama (?:\\d )?(?:\\d )?community {LICENSE}", ""),
    ("openrail", "openrail", f"(?:creativeml )?openrail(?: m)?(?: {LICENSE})?", ""),
    ("openrail", "bigscience", f"bigscience (?:bloom )?rail(?: {LICENSE})?(?: {V1})?", ""),
    ("polyform", "polyform", f"polyform (?:noncommercial|small business|shield|strict|perimeter) {LICENSE}(?: 1 0 0)?", ""),
    ("commons-clause", "clause", f"commons clause {LICENSE} condition|commons clause", ""),
)

#: Creative Commons: the terms that make up a license's name, as they are abbreviated and as they are written out.
CREATIVE_COMMONS = (
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative|ativework|ativeworks|atives|s)"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative|ativework|ativeworks|atives|s)"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by", "by", "attribution"),
)
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Words that bring a name in: a grant of the license, in the languages of the corpus.
GRANT = (
    "(?:licensed|released|distributed|published|available|provided|covered|redistributed|offered|shared|dual licensed|multi licensed) "
    "(?:to you |freely |publicly )?(?:under|subject to|according to) (?:the )?(?:terms (?:and conditions )?(?:of |in )?)?(?:the |an? )?"
)
GRANT_OTHERS = (
    "(?:lizenziert unter|ver[^ ]*ffentlicht unter|steht unter|stehen unter|lizenz|sous(?: la)? licence|publi[^ ]* sous|distribu[^ ]* sous|"
    "bajo(?: la| una)? licencia|publicado bajo|distribuido bajo|sotto(?: la)? licenza) (?:der |den |die |la |le |el |the |l )?"
)

#: (label, words that must all be there, pattern) of sentences in license texts and headers.
NOTICES = (
    ("mit", ("permission", "hereby", "person"), "permission is hereby granted free of charge to any person obtaining a copy of (?:this|the) (?:software|font|work|material)"),
    ("mit", ("substantial", "portions"), "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", ("redistribution", "binary"), "redistribution and use in source and binary forms with or without modification (?:is|are) permitted(?: provided that the following conditions are met)?"),
    ("bsd-3-clause", ("neither", "endorse"), "neither the names? of (?:[^ ]+ ){1,16}?nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", ("advertising", "mentioning"), "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", ("permission", "fee"), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", ("permission", "fee"), "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("apache-2.0", ("compliance",), "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", ("applicable", "distributed"), "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-2.0", ("apache",), "www apache org licenses license 2 0"),
    ("apache-2.0", ("apache", "contributor"), "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", ("redistribute", "general"), "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", ("redistribute", "lesser"), "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("agpl-3.0", ("redistribute", "affero"), "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", ("received", "general"), "you should have received a copy of the gnu general public licen[cs]e along with"),
    ("lgpl", ("received", "lesser"), "you should have received a copy of the gnu lesser general public licen[cs]e along with"),
    ("agpl-3.0", ("received", "affero"), "you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("gpl-2.0-or-later", ("later", "general"), "general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3.0-or-later", ("later", "general"), "general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-2.0", ("classpath",), "gnu classpath exception|classpath exception as provided by"),
    ("mpl-2.0", ("mozilla", "form"), "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2.0", ("mozilla",), "(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", ("mozilla", "contents"), "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("cddl-1.0", ("contents", "cddl"), "the contents of this file are subject to the terms of (?:the )?(?:common development and distribution licen[cs]e|cddl)"),
    ("epl-2.0", ("accompanying", "eclipse"), "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("zlib", ("altered", "plainly"), "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", ("misrepresented", "origin"), "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", ("unencumbered",), "this is free and unencumbered software released into the public domain"),
    ("unlicense", ("unlicense",), "unlicense org"),
    ("wtfpl", ("fuck", "public"), "do what the fuck you want to(?: public licen[cs]e)?"),
    ("cc0-1.0", ("cc0",), "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0-1.0", ("waived", "extent"), "to the extent possible under law (?:[^ ]+ ){1,20}?(?:has|have) waived all copyright"),
    ("cc0-1.0", ("creativecommons", "zero"), "creativecommons org publicdomain zero 1 0"),
    ("public-domain", ("domain",), "(?:released|placed|dedicated|donated) (?:in|in ?to|to) the public domain|public domain dedication"),
    ("ofl-1.1", ("font", "reserved"), "no modified version of the font software may use the reserved font name"),
    ("json", ("evil",), "the software shall be used for good not evil"),
    ("beerware", ("beer",), "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("bsl-1.0", ("boost",), "www boost org license 1 0 txt"),
    ("postgresql", ("paragraph", "fee"), "for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", ("openssl", "toolkit"), "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ijg", ("jpeg", "independent"), "this software is based in part on the work of the independent jpeg group"),
    ("info-zip", ("info", "zip"), "info zip (?:copyright and )?licen[cs]e"),
    ("curl", ("curl",), "curl licen[cs]e|copyright (?:and permission notice )?copyright c (?:[^ ]+ ){1,8}?daniel stenberg"),
    ("artistic-1.0", ("perl",), "under the same terms as perl(?: \\d)? itself"),
    ("python-2.0", ("psf",), "psf licen[cs]e agreement for python|psf (?:is making|hereby grants)"),
    ("gfdl", ("invariant", "sections"), "with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("eupl-1.2", ("eupl",), "licensed under the eupl(?: version 1 [12])?(?: or as soon they will be approved by the european commission)?"),
    ("busl-1.1", ("additional", "grant"), "additional use grant (?:[^ ]+ ){1,60}?change date"),
    ("commons-clause", ("clause", "condition"), "the software is provided to you by the licensor under the licen[cs]e as defined below subject to the following condition"),
    ("copyleft", ("copyleft",), "copyleft licen[cs]e|this (?:work|program|software) is copyleft"),
    ("proprietary", ("unauthorized",), "unauthorized (?:copying|use|reproduction|distribution)(?: or [a-z]+)* of this (?:file|software|document|program|work)(?: via any medium)? is strictly prohibited"),
    ("proprietary", ("proprietary", "confidential"), "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", ("reproduced", "permission"), "no part of this (?:publication|work|document|book|software) may be reproduced(?: [^ ]+){0,40}? without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("proprietary", ("eula",), "end user licen[cs]e agreement eula|eula"),
    ("non-commercial", ("commercial",), "for (?:personal and )?non ?commercial (?:use|purposes) only"),
)

#: (label, phrase): always found, never suppressed.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
BASE_WEIGHT = 0.5


@dataclass(frozen=True)
class Rule:
    """needs: of each group of words, one must occur before the pattern is tried. A lower priority number wins;
    weight: how sure a finding makes one that the text is under, or tells of, the license."""

    name: str
    label: str
    pattern: str
    needs: tuple[tuple[str, ...], ...]
    priority: int
    weight: float


def _names():
    """(label, words that must occur, findings by themselves, names that need a frame)."""
    yield from ((label, (word,), alone, framed) for label, word, alone, framed in NAMES)
    for terms, short, long in CREATIVE_COMMONS:
        # the abbreviation without a version is a finding of the license family; more specific terms contain the plainer ones
        yield f"cc-{terms}", ("cc",), f"cc {short}(?: {LICENSE})?" if terms != "by" else "", ""
        yield f"cc-{terms}", ("commons",), f"creative commons {long}(?: {LICENSE})?", ""
        for version in CC_VERSIONS:
            v = version.replace(".", " ")
            yield f"cc-{terms}-{version}", ("cc",), f"cc {short} (?:v|version )?{v}", ""
            yield f"cc-{terms}-{version}", ("commons",), f"creative commons {long}(?: (?:international|generic|unported))?(?: public)?(?: {LICENSE})?(?: version)? {v}", ""
            yield f"cc-{terms}-{version}", ("creativecommons",), f"creativecommons org licenses {short} {v}", ""


def rules() -> list[Rule]:
    """All rules in their order: notices, tags, grants, grants in other languages, names alone."""
    found = [Rule(f"notice {k}", label, pattern, tuple((w,) for w in words), 1, 1.0) for k, (label, words, pattern) in enumerate(NOTICES)]
    for k, (label, words, alone, framed) in enumerate(_names()):
        name = "|".join(x for x in (alone, framed) if x)
        if name:
            found.append(Rule(f"grant {k}", label, f"{GRANT}(?:{name})", (words, ("under", "to")), 3, 0.95))
            found.append(Rule(f"foreign grant {k}", label, f"{GRANT_OTHERS}(?:{name})", (words, ("unter", "lizenz", "sous", "licence", "bajo", "sotto")), 3, 0.9))
        if alone:
            found.append(Rule(f"name {k}", label, alone, (words,), 4, 0.7))
    for label in dict.fromkeys(label for label, *_ in _names()):
        tag = label.replace("-", " ").replace(".", " ")
        found.append(Rule(f"tag {label}", label, f"spdx licen[cs]e identifier {tag}", (("spdx",),), 2, 1.0))
        found.append(Rule(f"tag {label} only", f"{label}-only", f"spdx licen[cs]e identifier {tag} only", (("spdx",), ("only",)), 2, 1.0))
        found.append(Rule(f"tag {label} or later", f"{label}-or-later", f"spdx licen[cs]e identifier {tag} or later", (("spdx",), ("later",)), 2, 1.0))
    return sorted(found, key=lambda r: r.priority)
