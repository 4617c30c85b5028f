"""Signature rules of the license scan, in order.

A signature is a regular expression over a text's words: lower-cased, one space apart, whole
words only. Every rule has a keyword, one or more words that occur in all it can match, a level
(its priority among overlapping finds) and a confidence. The expressions use only what Java's
and RE2's engines share.
"""

from __future__ import annotations

from dataclasses import dataclass

# What a query's base labels are, as (phrase, label).
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Sentences of license texts and notices, as (label, keyword, signature).
TEXTS = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software"),
    ("mit-0", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
     "and to permit persons to whom the software is furnished to do so(?: the software is provided as is)"),
    ("isc", "permission", "permission to use copy modify and (?:or )?distribute this software for any purpose with or "
     "without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission", "permission to use copy modify and (?:or )?distribute this software for any purpose with or "
     "without fee is hereby granted(?: the software is provided as is)"),
    ("boost-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a "
     "copy of the software and accompanying documentation covered by this license"),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms with or without modification "
     "are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "endorse", "(?:neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors|"
     "names? of (?:[^ ]+ ){1,12}may not be used) (?:may be used )?to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display "
     "the following acknowledg(?:e)?ment"),
    ("apache-2.0", "unless required", "unless required by applicable law or agreed to in writing software distributed under the "
     "license is distributed on an as is basis"),
    ("apache-1.1", "apache", "products derived from this software may not be called apache"),
    ("gpl-2.0-or-later", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 2 of the license or at your option "
     "any later version"),
    ("gpl-3.0-or-later", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 3 of the license or at your option "
     "any later version"),
    ("lgpl-2.1-or-later", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser "
     "general public license as published by the free software foundation either version 2 1 of the license or at "
     "your option any later version"),
    ("lgpl-3.0-or-later", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser "
     "general public license as published by the free software foundation either version 3 of the license or at your "
     "option any later version"),
    ("agpl-3.0-or-later", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero "
     "general public license as published by the free software foundation either version 3 of the license or at your "
     "option any later version"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the "
     "eclipse public license 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "cc0", "the person who associated cc0 with this (?:work|deed)"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the "
     "authors be held liable for any damages arising from the use of this software"),
    ("wtfpl", "fuck", "do what the fuck you want to(?: public license)?"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for "
     "any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any "
     "purpose and without fee is hereby granted"),
    ("artistic-2.0", "artistic", "everyone is permitted to copy and distribute verbatim copies of this license document "
     "(?:[^ ]+ ){0,20}artistic license"),
    ("gfdl", "invariant", "with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("public-domain", "public domain", "(?:released|placed|dedicated|committed) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "this (?:work|file|code|text|software|document) is in the public domain"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution) (?:[^ ]+ ){0,12}prohibited"),
)

# Licenses with versions, as (label, keyword, names, versions). The label is
# followed by the version.
VERSIONED = (
    ("gpl", "gnu", "gnu general public licen[cs]e", ("1.0", "2.0", "3.0")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public licen[cs]e", ("2.0", "2.1", "3.0")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ("1.0", "3.0")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("1.0", "3.0")),
    ("gfdl", "gnu", "gnu free documentation licen[cs]e", ("1.1", "1.2", "1.3")),
    ("gfdl", "gfdl", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", "apache", "apache(?: software)?(?: licen[cs]e)?", ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", "eclipse (?:public|distribution) licen[cs]e", ("1.0", "2.0")),
    ("epl", "epl", "epl", ("1.0", "2.0")),
    ("eupl", "european", "european union public licen[cs]e", ("1.0", "1.1", "1.2")),
    ("eupl", "eupl", "eupl", ("1.0", "1.1", "1.2")),
    ("cddl", "common", "common development and distribution licen[cs]e", ("1.0", "1.1")),
    ("cddl", "cddl", "cddl", ("1.0", "1.1")),
    ("cpl", "common", "common public licen[cs]e", ("0.5", "1.0")),
    ("osl", "open software", "open software licen[cs]e", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("osl", "osl", "osl", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("afl", "academic", "academic free licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", "(?:perl )?artistic(?: licen[cs]e)?", ("1.0", "2.0")),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", ("1.0", "1.1")),
    ("ofl", "ofl", "(?:sil )?ofl", ("1.0", "1.1")),
    ("boost", "boost", "boost software licen[cs]e", ("1.0",)),
    ("boost", "bsl", "bsl", ("1.0",)),
    ("odbl", "open database", "open database licen[cs]e", ("1.0",)),
    ("odbl", "odbl", "odbl", ("1.0",)),
    ("odc-by", "odc", "odc(?: attribution licen[cs]e| by)", ("1.0",)),
    ("cecill", "cecill", "cecill(?: [bc])?", ("1.0", "1.1", "2.0", "2.1")),
    ("lppl", "latex", "latex project public licen[cs]e", ("1.0", "1.1", "1.2", "1.3")),
    ("lppl", "lppl", "lppl", ("1.0", "1.1", "1.2", "1.3")),
    ("php", "php", "php licen[cs]e", ("3.0", "3.1")),
    ("zpl", "zope", "zope public licen[cs]e", ("1.1", "2.0", "2.1")),
    ("psf", "python", "python(?: software foundation)? licen[cs]e", ("2.0",)),
    ("qpl", "q public", "q public licen[cs]e", ("1.0",)),
    ("rpl", "reciprocal", "reciprocal public licen[cs]e", ("1.1", "1.5")),
    ("apsl", "apple", "apple public source licen[cs]e", ("1.0", "1.1", "1.2", "2.0")),
    ("npl", "netscape", "netscape public licen[cs]e", ("1.0", "1.1")),
    ("cpal", "common", "common public attribution licen[cs]e", ("1.0",)),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)?", ("1.0",)),
    ("etalab", "etalab", "etalab (?:licence ouverte|open licence)", ("1.0", "2.0")),
    ("ogl-uk", "open government", "open government licen[cs]e", ("1.0", "2.0", "3.0")),
    ("busl", "business source", "business source licen[cs]e", ("1.1",)),
    ("sspl", "server side", "server side public licen[cs]e", ("1.0",)),
    ("elastic", "elastic", "elastic licen[cs]e", ("1.0", "2.0")),
)

# Licenses of which a later version may be chosen.
LATER = frozenset({"gpl", "lgpl", "agpl", "gfdl"})

# Creative Commons elements; all versions of all of them are rules.
COMMONS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
COMMONS_WORDS = {"by": "attribution", "sa": "sharealike", "nd": "noderiv(?:ative)?s?", "nc": "noncommercial"}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Licenses without versions, as (label, keyword, names).
PLAIN = (
    ("gpl", "gnu", "gnu general public licen[cs]e"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("gfdl", "gnu", "gnu free documentation licen[cs]e"),
    ("apache", "apache", "apache(?: software)? licen[cs]e"),
    ("mit", "mit licen", "(?:expat |x11 )?mit licen[cs]e"),
    ("mit", "mit style", "mit style(?: licen[cs]e)?"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("bsd", "bsd", "(?:berkeley |modified |new |simplified |revised |original )?bsd(?: style)?(?: licen[cs]e)?"),
    ("0bsd", "bsd", "(?:0bsd|(?:zero|0) clause bsd|bsd (?:zero|0) clause)(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", "(?:(?:two|2) clause bsd|bsd (?:two|2) clause|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:(?:three|3) clause bsd|bsd (?:three|3) clause|new bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:(?:four|4) clause bsd|bsd (?:four|4) clause|original bsd)(?: licen[cs]e)?"),
    ("isc", "isc licen", "isc licen[cs]e"),
    ("unlicense", "unlicen", "(?:the )?unlicen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", "libpng licen[cs]e"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("beerware", "beerware", "beerware(?: licen[cs]e)?"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("epl", "eclipse", "eclipse public licen[cs]e"),
    ("eupl", "european", "european union public licen[cs]e"),
    ("cddl", "cddl", "cddl"),
    ("artistic", "artistic", "artistic licen[cs]e"),
    ("boost", "boost", "boost software licen[cs]e"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e"),
    ("psf", "python", "python(?: software foundation)? licen[cs]e"),
    ("php", "php", "php licen[cs]e"),
    ("ruby", "ruby", "ruby licen[cs]e"),
    ("vim", "vim", "vim licen[cs]e"),
    ("curl", "curl", "curl licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("json", "json", "json licen[cs]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("ms-pl", "ms pl", "ms pl"),
    ("ms-rl", "ms rl", "ms rl"),
    ("cecill", "cecill", "cecill"),
    ("unicode", "unicode", "unicode (?:licen[cs]e(?: agreement)?|terms of use)"),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?licen[cs]e"),
    ("odbl", "odbl", "odbl"),
    ("odc-by", "odc", "odc(?: attribution licen[cs]e| by)"),
    ("pddl", "pddl", "pddl"),
    ("pddl", "dedication", "open data commons public domain dedication and licen[cs]e"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "creative", "creative commons attribution(?: \\d(?: \\d)?)?(?: international| unported| generic)?"),
    ("creative-commons", "creative", "creative commons(?: licen[cs]es?)?"),
    ("public-domain", "public domain", "public domain"),
    ("elastic", "elastic", "elastic licen[cs]e"),
    ("sspl", "sspl", "sspl"),
    ("busl", "business source", "business source licen[cs]e"),
    ("commons-clause", "commons clause", "commons clause(?: licen[cs]e(?: condition)?)?"),
    ("llama", "llama", "llama (?:[23] )?(?:[0-9] )?community licen[cs]e(?: agreement)?"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)?"),
    ("ogl-uk", "open government", "open government licen[cs]e"),
    ("dual", "licen", "dual licen[cs]ed|licen[cs]e exception|multi licen[cs]ed"),
    ("unknown", "licen", "licen[cs]ed under(?: the)?(?: terms of(?: the)?)?"),
    ("unknown", "licen", "(?:see|read) (?:the )?(?:file )?licen[cs]e(?: txt| md)?(?: file)?(?: for (?:more )?details)?"),
    ("unknown", "copyright", "copyright (?:c )?(?:\\d\\d\\d\\d )?(?:[^ ]+ ){1,4}licen[cs]e"),
)

# Forms in which a license is stated: (form, its keyword if it has one of its own, level, confidence).
TEXT, TAG, NOTICE, LINK, NAME, BARE = "text", "tag", "notice", "link", "name", "bare"
LEVELS = {TEXT: 4, TAG: 4, NOTICE: 3, LINK: 3, NAME: 2, BARE: 1}
CONFIDENCE = {TEXT: 0.99, TAG: 1.0, NOTICE: 0.95, LINK: 0.9, NAME: 0.8, BARE: 0.6}
UNDER = (
    "(?:licen[cs]ed|released|distributed|published|available|provided|covered|redistributed|shared) "
    "(?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
)
LATER_WORDS = "(?: or (?:at your option )?(?:any )?later(?: versions?)?)"
TAGGED = "spdx license identifier "


@dataclass(frozen=True)
class Rule:
    """One signature. ``place`` is its position in the order."""

    place: int
    label: str
    keyword: str
    signature: str
    form: str

    @property
    def level(self) -> int:
        return LEVELS[self.form]

    @property
    def confidence(self) -> float:
        return CONFIDENCE[self.form]


def version_words(version: str) -> str:
    """A version as words; its last part may be missing where it is 0, "v" may stand in front."""
    major, minor = version.split(".")
    number = f"{major}(?: 0)?" if minor == "0" else f"{major} {minor}"
    return f"(?:version |v )?v?{number}"


def _versioned() -> list[tuple[str, str, str, str]]:
    out = []
    for label, keyword, names, versions in VERSIONED:
        for version in versions:
            major, minor = version.split(".")
            # The version may stick to a short name (gplv3, gpl3) or follow it.
            glued = f"v?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")
            name = f"{names}(?:(?:{glued})|(?: licen[cs]e)? {version_words(version)})"
            full = f"{label}-{version}"
            out += [(full, keyword, name, NAME), (full, keyword, UNDER + name, NOTICE)]
            if label in LATER:
                later = name + LATER_WORDS
                out += [(f"{full}-or-later", keyword, later, NAME), (f"{full}-or-later", keyword, UNDER + later, NOTICE)]
                out.append((f"{full}-or-later", "spdx", f"{TAGGED}{label} {major} {minor} or later", TAG))
            tag = f"{TAGGED}{label.replace('-', ' ')} {major} {minor}(?: only)?"
            out.append((full, "spdx", tag, TAG))
    return out


def _commons() -> list[tuple[str, str, str, str]]:
    out = []
    for elements in COMMONS:
        parts = elements.split("-")
        short = " ".join(parts)
        long = " ".join(COMMONS_WORDS[p] for p in parts)
        for version in COMMONS_VERSIONS:
            label, number = f"cc-{elements}-{version}", version.replace(".", " ")
            named = f"creative commons {long}(?: licen[cs]e)? (?:version )?{number}(?: international| unported| generic)?"
            out += [
                (label, "cc by", f"cc {short} {number}", NAME),
                (label, "cc by", f"{UNDER}(?:a )?cc {short} {number}", NOTICE),
                (label, "creative", named, NAME),
                (label, "creative", f"{UNDER}(?:a )?{named}", NOTICE),
                (label, "creativecommons", f"creativecommons org licen[cs]es {short} {number}", LINK),
                (label, "spdx", f"{TAGGED}cc {short} {number}", TAG),
            ]
        bare, label = f"cc {short}", f"cc-{elements}"
        out += [(label, "cc by", bare, BARE), (label, "cc by", f"{UNDER}(?:a )?{bare}", NOTICE)]
    return out


def _plain() -> list[tuple[str, str, str, str]]:
    out = []
    for label, keyword, names in PLAIN:
        out.append((label, keyword, names, BARE))
        if label not in ("unknown", "dual"):
            out.append((label, keyword, f"{UNDER}(?:an? )?(?:{names})", NOTICE))
            out.append((label, "spdx", f"{TAGGED}{label.replace('-', ' ').replace('.', ' ')}", TAG))
    return out


def rules() -> list[Rule]:
    """All rules in order: texts, versions, Creative Commons, plain names; each signature once."""
    listed = [(label, keyword, signature, TEXT) for label, keyword, signature in TEXTS]
    seen: dict[tuple[str, str], Rule] = {}
    for label, keyword, signature, form in [*listed, *_versioned(), *_commons(), *_plain()]:
        seen.setdefault((signature, form), Rule(len(seen), label, keyword, signature, form))
    return list(seen.values())
