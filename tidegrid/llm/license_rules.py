"""Signature rules for licenses: hand-written names and phrases, and the forms in which a name is cited.

A rule reads a text as its lower-case words with one space between them, so punctuation, line breaks and case
play no part. Each rule names the words it cannot match without; they gate it. Rules come in order: a smaller
``rank`` goes before a larger one when places overlap.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    form: str
    rank: int
    weight: float  # how sure a single place is
    needs: tuple[str, ...]  # the rarest word first
    pattern: re.Pattern[bytes]


# The base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Label, name as a pattern over words, words that every match holds.
NAMES = [
    ("gpl", r"(?:gnu )?gpl", ("gpl",)),
    ("gpl-2.0", r"(?:gnu )?gplv2", ("gplv2",)),
    ("gpl-3.0", r"(?:gnu )?gplv3", ("gplv3",)),
    ("gpl", r"(?:gnu )?general public licen[sc]e", ("general", "public")),
    ("lgpl", r"(?:gnu )?lgpl", ("lgpl",)),
    ("lgpl-3.0", r"(?:gnu )?lgplv3", ("lgplv3",)),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("general", "public")),
    ("agpl", r"(?:gnu )?agpl", ("agpl",)),
    ("agpl-3.0", r"(?:gnu )?agplv3", ("agplv3",)),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", ("affero",)),
    ("gfdl", r"(?:gnu )?gfdl", ("gfdl",)),
    ("gfdl", r"gnu free documentation licen[sc]e", ("gnu", "documentation")),
    ("apache", r"apache(?: software)? licen[sc]e", ("apache",)),
    ("mit", r"mit(?: x11)? licen[sc]e", ("mit", "license")),
    ("mit", r"mit expat", ("expat", "mit")),
    ("mit", r"expat licen[sc]e", ("expat", "license")),
    ("mit-0", r"mit no attribution(?: licen[sc]e)?", ("attribution", "mit")),
    ("x11", r"x11 licen[sc]e", ("x11", "license")),
    ("x11", r"x consortium licen[sc]e", ("consortium", "license")),
    ("isc", r"isc licen[sc]e", ("isc",)),
    ("isc", r"internet systems consortium licen[sc]e", ("consortium", "internet")),
    ("bsd", r"bsd(?: style)? licen[sc]e", ("bsd",)),
    ("bsd", r"berkeley software distribution licen[sc]e", ("berkeley",)),
    ("bsd-2-clause", r"bsd 2 clause(?: simplified)?(?: licen[sc]e)?|simplified bsd licen[sc]e", ("bsd",)),
    ("bsd-2-clause", r"freebsd licen[sc]e", ("freebsd",)),
    ("bsd-3-clause", r"bsd 3 clause(?: new| revised)?(?: licen[sc]e)?|(?:new|revised|modified) bsd licen[sc]e", ("bsd",)),
    ("bsd-4-clause", r"bsd 4 clause(?: licen[sc]e)?|original bsd licen[sc]e", ("bsd",)),
    ("0bsd", r"0bsd(?: licen[sc]e)?", ("0bsd",)),
    ("0bsd", r"zero clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)?", ("bsd", "zero")),
    ("mpl", r"mozilla public licen[sc]e", ("mozilla", "public")),
    ("epl", r"eclipse public licen[sc]e", ("eclipse", "public")),
    ("edl", r"eclipse distribution licen[sc]e", ("eclipse", "distribution")),
    ("cpl", r"common public licen[sc]e", ("common", "public")),
    ("ipl", r"ibm public licen[sc]e", ("ibm", "public")),
    ("cddl", r"cddl", ("cddl",)),
    ("cddl", r"common development and distribution licen[sc]e", ("common", "distribution")),
    ("eupl", r"eupl", ("eupl",)),
    ("eupl", r"european union public licen[sc]e", ("european", "public")),
    ("osl", r"open software licen[sc]e", ("open", "license", "software")),
    ("afl", r"academic free licen[sc]e", ("academic", "free")),
    ("artistic", r"(?:perl )?artistic licen[sc]e", ("artistic",)),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", ("zlib",)),
    ("libpng", r"libpng licen[sc]e", ("libpng",)),
    ("bsl", r"boost software licen[sc]e", ("boost", "software")),
    ("busl", r"business source licen[sc]e", ("business", "source")),
    ("sspl", r"sspl", ("sspl",)),
    ("sspl", r"server side public licen[sc]e", ("server", "public")),
    ("elastic", r"elastic licen[sc]e", ("elastic",)),
    ("unlicense", r"(?:the )?unlicense", ("unlicense",)),
    ("wtfpl", r"wtfpl", ("wtfpl",)),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", ("fuck",)),
    ("psf", r"python software foundation licen[sc]e", ("python", "foundation")),
    ("psf", r"psf licen[sc]e", ("psf",)),
    ("ruby", r"ruby licen[sc]e|ruby s licen[sc]e", ("ruby",)),
    ("php", r"php licen[sc]e", ("php",)),
    ("openssl", r"openssl licen[sc]e", ("openssl",)),
    ("curl", r"curl licen[sc]e", ("curl",)),
    ("postgresql", r"postgresql licen[sc]e", ("postgresql",)),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", ("ncsa",)),
    ("ms-pl", r"microsoft public licen[sc]e", ("microsoft", "public")),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", ("microsoft", "reciprocal")),
    ("cecill", r"cecill(?: b| c)?(?: licen[sc]e)?", ("cecill",)),
    ("ofl", r"sil open font licen[sc]e|open font licen[sc]e", ("font",)),
    ("bitstream-vera", r"bitstream vera(?: fonts)? licen[sc]e", ("bitstream",)),
    ("qpl", r"q public licen[sc]e", ("public", "q")),
    ("sleepycat", r"sleepycat licen[sc]e", ("sleepycat",)),
    ("upl", r"universal permissive licen[sc]e", ("universal", "permissive")),
    ("vim", r"vim licen[sc]e", ("vim",)),
    ("beerware", r"beerware(?: licen[sc]e)?", ("beerware",)),
    ("ijg", r"independent jpeg group licen[sc]e", ("jpeg",)),
    ("ijg", r"ijg licen[sc]e", ("ijg",)),
    ("tcl", r"tcl tk licen[sc]e", ("tcl",)),
    ("w3c", r"w3c software(?: notice and)? licen[sc]e", ("w3c",)),
    ("zpl", r"zope public licen[sc]e", ("zope",)),
    ("apsl", r"apple public source licen[sc]e", ("apple", "source")),
    ("lppl", r"latex project public licen[sc]e", ("latex",)),
    ("lppl", r"lppl", ("lppl",)),
    ("nasa", r"nasa open source agreement", ("nasa",)),
    ("odbl", r"odbl", ("odbl",)),
    ("odbl", r"open(?: data commons)?(?: open)? database licen[sc]e", ("database", "license")),
    ("odc-by", r"open data commons attribution licen[sc]e", ("commons", "data")),
    ("odc-by", r"odc by", ("odc",)),
    ("pddl", r"public domain dedication and licen[sc]e", ("domain", "dedication")),
    ("pddl", r"pddl", ("pddl",)),
    ("cc0", r"cc0", ("cc0",)),
    ("cc0", r"(?:cc|creative commons) zero", ("zero",)),
    ("cc-by", r"cc by", ("cc", "by")),
    ("cc-by", r"creative commons attribution", ("creative", "attribution")),
    ("cc-by-sa", r"cc by sa", ("cc", "sa")),
    ("cc-by-sa", r"creative commons attribution share ?alike", ("creative", "attribution")),
    ("cc-by-nd", r"cc by nd", ("cc", "nd")),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?", ("creative", "attribution")),
    ("cc-by-nc", r"cc by nc", ("cc", "nc")),
    ("cc-by-nc", r"creative commons attribution non ?commercial", ("creative", "attribution")),
    ("cc-by-nc-sa", r"cc by nc sa", ("cc", "nc", "sa")),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike", ("creative", "attribution")),
    ("cc-by-nc-nd", r"cc by nc nd", ("cc", "nc", "nd")),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", ("creative", "attribution")),
    ("openrail", r"(?:creativeml )?openrail(?: m| s| d)?(?: licen[sc]e)?", ("openrail",)),
    ("llama", r"llama(?: [0-9])?(?: [0-9])? community licen[sc]e(?: agreement)?", ("llama",)),
]

# The versions that a label is published in.
VERSIONS = {
    "gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "gfdl": ("1.1", "1.2", "1.3"),
    "apache": ("1.0", "1.1", "2.0"), "mpl": ("1.0", "1.1", "2.0"), "epl": ("1.0", "2.0"), "cddl": ("1.0", "1.1"),
    "eupl": ("1.0", "1.1", "1.2"), "osl": ("1.0", "2.0", "2.1", "3.0"), "afl": ("1.1", "2.0", "2.1", "3.0"),
    "artistic": ("1.0", "2.0"), "bsl": ("1.0",), "busl": ("1.1",), "php": ("3.0", "3.01"), "ofl": ("1.0", "1.1"),
    "cecill": ("1.0", "2.0", "2.1"), "lppl": ("1.0", "1.2", "1.3"), "zpl": ("1.1", "2.0", "2.1"), "cc0": ("1.0",),
    "cc-by": ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc-by-sa": ("1.0", "2.0", "2.5", "3.0", "4.0"),
    "cc-by-nd": ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc-by-nc": ("1.0", "2.0", "2.5", "3.0", "4.0"),
    "cc-by-nc-sa": ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc-by-nc-nd": ("1.0", "2.0", "2.5", "3.0", "4.0"),
}

# Sentences that only one license (or family) holds.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", ("hereby", "granted")),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", ("permission", "notice")),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", ("permission", "fee")),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "permitted")),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", ("redistributions", "reproduce")),
    ("bsd-3-clause", r"neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their) contributors", ("neither", "contributors")),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", ("advertising", "mentioning")),
    ("gpl", r"this program is free software you can redistribute it and or modify", ("redistribute", "modify")),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e", ("received", "gnu")),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", ("received", "gnu")),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[sc]e", ("received", "affero")),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu", ("permission", "gnu")),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e", ("unless", "applicable")),
    ("apache", r"you may not use this (?:file|work) except in compliance with the licen[sc]e", ("except", "compliance")),
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[sc]e", ("mozilla", "subject")),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse", ("eclipse", "accompanying")),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", ("warranty", "authors")),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy", ("hereby", "organization")),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",)),
    ("wtfpl", r"you just do what the fuck you want to", ("fuck",)),
    ("ofl", r"this font software is licensed under the sil open font licen[sc]e", ("font", "sil")),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", ("deed", "dedicated")),
    ("cc-by", r"this work is licensed under a creative commons attribution", ("creative", "attribution")),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", ("domain", "public")),
    ("proprietary", r"all rights reserved(?: \S+){0,8} (?:confidential|proprietary)", ("reserved", "rights")),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|distribution) of this (?:file|software)(?: \S+){0,8} (?:is )?(?:strictly )?prohibited", ("prohibited",)),
    ("no-ai-training", r"may not be used (?:to train|for training)(?: \S+){0,6} (?:models?|ai|intelligence)", ("used", "may")),
]

# Places on the web, as words.
PLACES = [
    ("gpl", r"gnu org (?:licenses|copyleft) gpl", ("gnu", "org", "gpl")),
    ("lgpl", r"gnu org (?:licenses|copyleft) lgpl", ("lgpl", "gnu", "org")),
    ("agpl", r"gnu org licenses agpl", ("agpl", "gnu", "org")),
    ("gfdl", r"gnu org (?:licenses|copyleft) fdl", ("fdl", "gnu", "org")),
    ("apache-2.0", r"apache org licenses licen[sc]e 2 0", ("apache", "org", "licenses")),
    ("mit", r"opensource org licen[sc]es? mit", ("opensource", "org", "mit")),
    ("bsd", r"opensource org licen[sc]es? bsd(?: license)?", ("opensource", "org", "bsd")),
    ("mpl-2.0", r"mozilla org mpl 2 0", ("mozilla", "org", "mpl")),
    ("epl", r"eclipse org legal epl", ("eclipse", "org", "legal")),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", ("creativecommons", "publicdomain")),
    ("unlicense", r"unlicense org", ("unlicense", "org")),
    ("ofl", r"scripts sil org ofl", ("sil", "org", "ofl")),
    ("wtfpl", r"wtfpl net", ("wtfpl", "net")),
]

CREATIVE = [label for label in VERSIONS if label.startswith("cc-by")]
GRANT = (
    r"(?:licen[sc]ed|released|distributed|available|published|covered|governed|offered|redistribute it and or modify it)"
    r"(?: \S+){0,3} (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?"
)
TAG = r"spdx licen[sc]e identifier"


def _numbered(version: str) -> str:
    """How a version follows a name: ``2.0`` also as ``v2``, ``version 2`` and so on."""
    major, minor = version.split(".")
    tail = rf"(?: {minor})?" if minor == "0" else rf" {minor}"
    return rf"(?: licen[sc]e| international| unported| generic)?(?: version| ver| v)? v?{major}{tail}(?! [0-9])"


def _rule(label: str, form: str, rank: int, weight: float, needs: tuple[str, ...], pattern: str) -> Rule:
    return Rule(label, form, rank, weight, needs, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()))


def rules() -> list[Rule]:
    """All rules in order of rank: texts, tags, grants, versioned names, places on the web, bare names."""
    out = [_rule(label, "base", 0, 0.8, tuple(sorted(p.split(), key=len, reverse=True)), p) for p, label in BASE]
    out += [_rule(label, "text", 1, 0.95, needs, p) for label, p, needs in TEXTS]
    for label in sorted({n[0] for n in NAMES}):
        words = label.replace("-", " ")
        out.append(_rule(label, "tag", 2, 1.0, ("spdx", words.split()[0]), rf"{TAG} {words}"))
        for v in VERSIONS.get(label, ()):
            words = f"{label} {v}".replace("-", " ").replace(".", " ")
            out.append(_rule(f"{label}-{v}", "tag", 2, 1.0, ("spdx", words.split()[0]), rf"{TAG} {words}(?: only| or later)?"))
    for label, name, needs in NAMES:
        out.append(_rule(label, "grant", 3, 0.95, needs, rf"{GRANT} (?:{name})"))
        for v in VERSIONS.get(label, ()):
            numbered = rf"(?:{name}){_numbered(v)}"
            out.append(_rule(f"{label}-{v}", "grant", 3, 1.0, needs, rf"{GRANT} {numbered}"))
            out.append(_rule(f"{label}-{v}", "version", 4, 0.9, needs, numbered))
    out += [_rule(label, "place", 5, 0.85, needs, p) for label, p, needs in PLACES]
    for label in CREATIVE:
        for v in VERSIONS[label]:
            parts = f"{label[3:]} {v}".replace("-", " ").replace(".", " ")
            out.append(_rule(f"{label}-{v}", "place", 5, 0.85, ("creativecommons", "licenses"), rf"creativecommons org licenses {parts}"))
    out += [_rule(label, "name", 6, 0.7, needs, name) for label, name, needs in NAMES]
    return out
