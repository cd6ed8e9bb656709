"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

``RULES`` are hand-written regular expressions over lower-cased text, made from a table of licenses by the forms in which
texts state one: an SPDX tag, a full title, a "licensed under" notice, a short title, a web address; and sentences that are
found in the licenses themselves (``BODIES``). Each rule has a keyword that any match must contain. An Aho-Corasick pass over
a text finds which keywords occur at all; only their rules run, so most texts run none. Detections are ordered by priority,
then length: one that lies inside a detection that is taken is suppressed, and so is one that overlaps a detection of a
higher priority.

Rules are matched on the text with each run of white space as one blank, so lines may break anywhere, and places are turned
back by a table of the runs. With that no rule needs a bound on blanks, words or lists, and none takes more than linear time.

Base detections are counted apart, over words: phrases whose words stand consecutively.

Defined cases: a null text counts as empty: no words, no labels, score 0; repeated rows give repeated rows; an empty table
gives an empty one; a null doc_id is kept; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import Any, NamedTuple

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.common import map_rows, table

#: Fixed: the phrases of the base labels, as words.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_LOWER_AND_BLANK = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


class Rule(NamedTuple):
    label: str
    pattern: str
    keyword: str
    priority: int  # greater is stronger
    weight: float  # how sure a detection is, 0 to 1


OR_LATER = r"(?: ?(?:\+|or[ -]later|or \(at your option\) any later version))?"

#: label, SPDX ids, title as a pattern, a keyword that the title contains.
LICENSES: list[tuple[str, str, str, str]] = [
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?affero general public licen[cs]e(?:,? ?v(?:ersion|\.)? ?3(?:\.0)?)?", "affero general public"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"gnu library general public licen[cs]e(?:,? ?v(?:ersion|\.)? ?2(?:\.0)?)?", "library general public"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"(?:gnu )?lesser general public licen[cs]e,? ?v(?:ersion|\.)? ?2\.1", "lesser general public"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?lesser general public licen[cs]e,? ?v(?:ersion|\.)? ?3(?:\.0)?", "lesser general public"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu general public licen[cs]e,? ?v(?:ersion|\.)? ?1(?:\.0)?(?!\.?\d)", "gnu general public"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu general public licen[cs]e,? ?v(?:ersion|\.)? ?2(?:\.0)?(?!\.?\d)", "gnu general public"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu general public licen[cs]e,? ?v(?:ersion|\.)? ?3(?:\.0)?(?!\.?\d)", "gnu general public"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", r"gnu free documentation licen[cs]e(?:,? ?v(?:ersion|\.)? ?1\.3)?", "free documentation"),
    ("apache-1.1", r"apache-1\.1", r"apache (?:software )?licen[cs]e,? ?v(?:ersion|\.)? ?1\.1", "apache"),
    ("apache-2.0", r"apache-2\.0", r"apache (?:software )?licen[cs]e,? ?\(?v(?:ersion|\.)? ?2(?:\.0)?\)?", "apache"),
    ("mit", r"mit", r"(?:the )?(?:mit|expat) licen[cs]e", "licen"),
    ("mit-0", r"mit-0", r"mit no attribution", "no attribution"),
    ("x11", r"x11", r"x11 licen[cs]e", "x11"),
    ("bsd-1-clause", r"bsd-1-clause", r"(?:bsd 1-clause|1-clause bsd) licen[cs]e", "1-clause"),
    ("bsd-2-clause", r"bsd-2-clause(?:-patent|-views)?", r"(?:(?:bsd[ -])?2-clause(?:[ -]\"?simplified\"?)?(?: bsd)?|simplified bsd|freebsd) licen[cs]e", "licen"),
    ("bsd-3-clause", r"bsd-3-clause(?:-clear|-lbnl)?", r"(?:(?:bsd[ -])?3-clause(?:[ -]\"?(?:new|revised)\"?)?(?: bsd)?|(?:new|revised|modified) bsd) licen[cs]e", "licen"),
    ("bsd-4-clause", r"bsd-4-clause(?:-uc)?", r"(?:(?:bsd[ -])?4-clause(?: bsd)?|original bsd) licen[cs]e", "licen"),
    ("0bsd", r"0bsd", r"zero[- ]clause bsd", "clause bsd"),
    ("isc", r"isc", r"isc licen[cs]e", "isc licen"),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public licen[cs]e,? ?v(?:ersion|\.)? ?1\.1", "mozilla public"),
    ("mpl-2.0", r"mpl-2\.0(?:-no-copyleft-exception)?", r"mozilla public licen[cs]e,? ?v(?:ersion|\.)? ?2(?:\.0)?", "mozilla public"),
    ("epl-1.0", r"epl-1\.0", r"eclipse public licen[cs]e,? ?-? ?v(?:ersion|\.)? ?1(?:\.0)?", "eclipse public"),
    ("epl-2.0", r"epl-2\.0", r"eclipse public licen[cs]e,? ?-? ?v(?:ersion|\.)? ?2(?:\.0)?", "eclipse public"),
    ("edl-1.0", r"edl-1\.0", r"eclipse distribution licen[cs]e", "eclipse distribution"),
    ("cpl-1.0", r"cpl-1\.0", r"common public licen[cs]e", "common public"),
    ("ipl-1.0", r"ipl-1\.0", r"ibm public licen[cs]e", "ibm public"),
    ("cddl-1.0", r"cddl-1\.0", r"common development and distribution licen[cs]e(?:,? ?v(?:ersion|\.)? ?1(?:\.0)?)?", "common development"),
    ("cddl-1.1", r"cddl-1\.1", r"common development and distribution licen[cs]e,? ?v(?:ersion|\.)? ?1\.1", "common development"),
    ("artistic-1.0", r"artistic-1\.0(?:-perl)?", r"artistic licen[cs]e,? ?v?(?:ersion)? ?1(?:\.0)?", "artistic"),
    ("artistic-2.0", r"artistic-2\.0", r"artistic licen[cs]e,? ?v?(?:ersion)? ?2(?:\.0)?", "artistic"),
    ("bsl-1.0", r"bsl-1\.0", r"boost software licen[cs]e(?:,? ?v(?:ersion|\.)? ?1(?:\.0)?)?", "boost software"),
    ("busl-1.1", r"busl-1\.1", r"business source licen[cs]e(?: 1\.1)?", "business source"),
    ("sspl-1.0", r"sspl-1\.0", r"server side public licen[cs]e", "server side public"),
    ("elastic-2.0", r"elastic-2\.0", r"elastic licen[cs]e(?: 2\.0)?", "elastic licen"),
    ("unlicense", r"unlicense", r"(?:the )?unlicen[cs]e(?![ds])", "unlicen"),
    ("wtfpl", r"wtfpl", r"do what the f\S{3} you want to public licen[cs]e", "you want to public"),
    ("zlib", r"zlib(?:-acknowledgement)?", r"zlib(?:/libpng)? licen[cs]e", "zlib"),
    ("libpng", r"libpng(?:-2\.0)?", r"(?:png reference library|libpng) licen[cs]e", "png"),
    ("openssl", r"openssl", r"openssl licen[cs]e", "openssl"),
    ("python-2.0", r"(?:python-2\.0|psf-2\.0)", r"(?:python software foundation|psf|python) licen[cs]e", "licen"),
    ("ruby", r"ruby", r"ruby(?:'s)? licen[cs]e", "ruby"),
    ("php-3.01", r"php-3\.01?", r"php licen[cs]e,? ?(?:v(?:ersion|\.)? ?3(?:\.01?)?)?", "php licen"),
    ("postgresql", r"postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("ncsa", r"ncsa", r"(?:university of illinois|uiuc|ncsa)(?:/ncsa)? open source licen[cs]e", "open source licen"),
    ("ecl-2.0", r"ecl-2\.0", r"educational community licen[cs]e", "educational community"),
    ("eupl-1.1", r"eupl-1\.1", r"european union public licen[cs]e,? ?v?(?:ersion|\.)? ?1\.1", "european union public"),
    ("eupl-1.2", r"eupl-1\.2", r"european union public licen[cs]e(?:,? ?v?(?:ersion|\.)? ?1\.2)?", "european union public"),
    ("osl-3.0", r"osl-3\.0", r"open software licen[cs]e(?:,? ?v?(?:ersion|\.)? ?3(?:\.0)?)?", "open software"),
    ("afl-3.0", r"afl-3\.0", r"academic free licen[cs]e(?:,? ?v?(?:ersion|\.)? ?3(?:\.0)?)?", "academic free"),
    ("ms-pl", r"ms-pl", r"microsoft public licen[cs]e", "microsoft public"),
    ("ms-rl", r"ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft reciprocal"),
    ("qpl-1.0", r"qpl-1\.0", r"q public licen[cs]e", "q public"),
    ("sleepycat", r"sleepycat", r"sleepycat(?: public)? licen[cs]e", "sleepycat"),
    ("vim", r"vim", r"vim licen[cs]e", "vim licen"),
    ("w3c", r"w3c(?:-\d+)?", r"w3c software (?:notice and )?licen[cs]e", "w3c software"),
    ("zpl-2.1", r"zpl-2\.1", r"zope public licen[cs]e", "zope public"),
    ("upl-1.0", r"upl-1\.0", r"universal permissive licen[cs]e", "universal permissive"),
    ("ofl-1.1", r"ofl-1\.1(?:-rfn|-no-rfn)?", r"(?:sil )?open font licen[cs]e(?:,? ?v?(?:ersion|\.)? ?1\.1)?", "open font"),
    ("odbl-1.0", r"odbl-1\.0", r"open (?:data commons open )?database licen[cs]e", "database licen"),
    ("odc-by-1.0", r"odc-by-1\.0", r"open data commons attribution licen[cs]e", "open data commons"),
    ("pddl-1.0", r"pddl-1\.0", r"public domain dedication and licen[cs]e", "public domain dedication"),
    ("ogl-uk-3.0", r"ogl-uk-3\.0", r"open government licen[cs]e(?: v?3(?:\.0)?)?", "open government"),
    ("cc0-1.0", r"cc0-1\.0", r"(?:creative commons zero|cc0)(?: 1\.0)?(?: universal)?", "c"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-\d\.\d", r"(?:creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?(?:[- ]works)?|cc[ -]by-nc-nd)(?: \d\.\d)?", "c"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-\d\.\d", r"(?:creative commons attribution[- ]non-?commercial[- ]share-?alike|cc[ -]by-nc-sa)(?: \d\.\d)?", "c"),
    ("cc-by-nc", r"cc-by-nc-\d\.\d", r"(?:creative commons attribution[- ]non-?commercial|cc[ -]by-nc)(?![- ](?:sa|nd|share|no))(?: \d\.\d)?", "c"),
    ("cc-by-nd", r"cc-by-nd-\d\.\d", r"(?:creative commons attribution[- ]no-?deriv(?:ative)?s?|cc[ -]by-nd)(?: \d\.\d)?", "c"),
    ("cc-by-sa", r"cc-by-sa-\d\.\d", r"(?:creative commons attribution[- ]share-?alike|cc[ -]by-sa)(?: \d\.\d)?", "c"),
    ("bittorrent-1.1", r"bittorrent-1\.1", r"bittorrent open source licen[cs]e", "bittorrent"),
    ("beerware", r"beerware", r"beer-?ware licen[cs]e", "beer"),
    ("curl", r"curl", r"curl licen[cs]e", "curl licen"),
    ("json", r"json", r"the software shall be used for good, not evil", "not evil"),
    ("ijg", r"ijg", r"independent jpeg group(?:'s)? licen[cs]e", "jpeg group"),
    ("ftl", r"ftl", r"freetype(?: project)? licen[cs]e", "freetype"),
    ("imagemagick", r"imagemagick", r"imagemagick licen[cs]e", "imagemagick"),
    ("intel", r"intel", r"intel open source licen[cs]e", "intel open source"),
    ("naist-2003", r"naist-2003", r"nara institute of science and technology licen[cs]e", "nara institute"),
    ("unicode-dfs-2016", r"unicode-(?:dfs-201[56]|3\.0)", r"unicode(?:,? inc\.)? licen[cs]e agreement", "unicode"),
    ("openrail-m", r"openrail(?:-m|\+\+)?", r"(?:creativeml |bigscience )?open ?rail(?:\+\+)?[- ]?m licen[cs]e", "rail"),
    ("llama", r"llama-?\d?", r"llama \d(?:\.\d)? community licen[cs]e", "community licen"),
]

#: Families without a version: weaker than the versions above, so a versioned detection of the same text suppresses them.
FAMILIES: list[tuple[str, str, str]] = [
    ("gpl", r"gnu general public licen[cs]e", "gnu general public"),
    ("gpl", r"\bgpl ?v?\d(?:\.\d)?\+?", "gpl"),
    ("lgpl", r"(?:gnu )?lesser general public licen[cs]e", "lesser general public"),
    ("lgpl", r"\blgpl ?v?\d(?:\.\d)?\+?", "lgpl"),
    ("agpl", r"\bagpl ?v?\d(?:\.\d)?\+?", "agpl"),
    ("apache", r"apache(?: software)? licen[cs]e", "apache"),
    ("bsd", r"\bbsd(?:-style)? licen[cs]e", "bsd"),
    ("mpl", r"mozilla public licen[cs]e", "mozilla public"),
    ("epl", r"eclipse public licen[cs]e", "eclipse public"),
    ("artistic", r"artistic licen[cs]e", "artistic"),
    ("eupl", r"european union public licen[cs]e", "european union public"),
    ("cc", r"creative commons(?: licen[cs]e)?", "creative commons"),
    ("cc-by", r"\bcc[ -]by\b(?![- ](?:nc|nd|sa))(?: \d\.\d)?", "cc by"),
    ("cc-by", r"\bcc[ -]by\b(?![- ](?:nc|nd|sa))(?: \d\.\d)?", "cc-by"),
    ("cc-by", r"creative commons attribution(?! ?-?(?:non|no|share))(?: \d\.\d)?", "creative commons attribution"),
    ("public-domain", r"(?:dedicated to|released into|placed in|in) the public domain", "the public domain"),
    ("proprietary", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary"),
    ("copyright", r"(?:copyright|\(c\)|©) ?(?:\(c\)|©)? ?\d{4}(?:[-, ]+\d{4})*", "copyright"),
    ("copyright", r"(?:copyright|\(c\)|©) ?(?:\(c\)|©)? ?\d{4}(?:[-, ]+\d{4})*", "(c)"),
    ("copyright", r"(?:copyright|\(c\)|©) ?(?:\(c\)|©)? ?\d{4}(?:[-, ]+\d{4})*", "©"),
    ("no-ai", r"(?:may|must|shall) not be used (?:for|to) (?:train|the training of) (?:ai|machine learning|language) models?", "not be used"),
]

#: Web addresses: label, pattern, keyword.
ADDRESSES: list[tuple[str, str, str]] = [
    ("gpl-3.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-3\.0", "gnu.org/licenses"),
    ("gpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gnu.org/licenses"),
    ("lgpl-3.0", r"gnu\.org/licenses/lgpl-3\.0", "gnu.org/licenses"),
    ("lgpl-2.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "gnu.org/licenses"),
    ("agpl-3.0", r"gnu\.org/licenses/agpl-3\.0", "gnu.org/licenses"),
    ("gfdl-1.3", r"gnu\.org/licenses/fdl-1\.3", "gnu.org/licenses"),
    ("apache-2.0", r"apache\.org/licenses/license-2\.0", "apache.org/licenses"),
    ("mit", r"opensource\.org/licenses?/mit", "opensource.org"),
    ("bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause", "opensource.org"),
    ("bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause", "opensource.org"),
    ("isc", r"opensource\.org/licenses?/isc", "opensource.org"),
    ("mpl-2.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0", "mozilla.org"),
    ("bsl-1.0", r"boost\.org/license_1_0\.txt", "boost.org"),
    ("unlicense", r"unlicense\.org", "unlicense.org"),
    ("ofl-1.1", r"(?:scripts\.sil\.org/ofl|openfontlicense\.org)", "ofl"),
    ("ofl-1.1", r"openfontlicense\.org", "openfontlicense"),
    ("cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0", "creativecommons.org"),
    ("cc-by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd/\d\.\d", "creativecommons.org"),
    ("cc-by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa/\d\.\d", "creativecommons.org"),
    ("cc-by-nc", r"creativecommons\.org/licenses/by-nc/\d\.\d", "creativecommons.org"),
    ("cc-by-nd", r"creativecommons\.org/licenses/by-nd/\d\.\d", "creativecommons.org"),
    ("cc-by-sa", r"creativecommons\.org/licenses/by-sa/\d\.\d", "creativecommons.org"),
    ("cc-by", r"creativecommons\.org/licenses/by/\d\.\d", "creativecommons.org"),
    ("odbl-1.0", r"opendatacommons\.org/licenses/odbl", "opendatacommons"),
    ("eupl-1.2", r"joinup\.ec\.europa\.eu/(?:(?!joinup\.ec)\S)*?eupl", "eupl"),
]


_PUBLISHED = r"general public licen[cs]e,? as published by the free software foundation[;:,] ?(?:either )?version"
_GRANT = r"permission is hereby granted, free of charge, to any person obtaining a copy of"
_FEE = r"permission to use, copy, modify,? (?:and/or|and) distribute this software for any purpose with or without fee is hereby granted"

#: Sentences of licenses: label, pattern, keyword, priority. A stronger one is the more special.
BODIES: list[tuple[str, str, str, int]] = [
    ("mit", _GRANT + r" this software and associated documentation files", "hereby granted", 4),
    ("ncsa", _GRANT + r" this software and associated documentation files(?: \(the \W?software\W?\))?,? to deal with the software", "hereby granted", 5),
    ("bsl-1.0", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", "hereby granted", 5),
    ("ofl-1.1", _GRANT + r" the font software", "hereby granted", 5),
    ("isc", _FEE + r",? provided that the above copyright notice", "hereby granted", 5),
    ("0bsd", _FEE + r"(?!,? provided)", "hereby granted", 4),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "hereby granted", 5),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification, are permitted", "source and binary forms", 3),
    ("bsd-3-clause", r"neither the names? of (?:(?!neither the)[^.;])*? nor the names of (?:its|the|their) contributors may be used to endorse or promote", "nor the names of", 4),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising materials", 4),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[cs]e", "in compliance with the licen", 4),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable", "hereby grants to you", 4),
    ("gpl-2.0", r"gnu " + _PUBLISHED + r" 2(?!\.?\d)", "free software foundation", 5),
    ("gpl-3.0", r"gnu " + _PUBLISHED + r" 3(?!\.?\d)", "free software foundation", 5),
    ("lgpl-2.1", r"(?:gnu )?lesser " + _PUBLISHED + r" 2\.1", "free software foundation", 5),
    ("lgpl-3.0", r"(?:gnu )?lesser " + _PUBLISHED + r" 3(?!\.?\d)", "free software foundation", 5),
    ("lgpl-2.0", r"gnu library " + _PUBLISHED + r" 2(?!\.?\d)", "free software foundation", 5),
    ("agpl-3.0", r"(?:gnu )?affero " + _PUBLISHED + r" 3(?!\.?\d)", "free software foundation", 5),
    ("gpl", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share", "freedom to share", 4),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e,? v\. 2\.0", "source code form", 5),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1", "contents of this file", 5),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable", 4),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", 4),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 5),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document", "verbatim or modified", 4),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "a package may be copied", 4),
    ("cc0-1.0", r"the person who associated (?:a work|cc0) with (?:this deed|a work) has dedicated the work to the public domain", "dedicated the work", 5),
    ("cc", r"by exercising the licensed rights \(defined below\), you accept and agree to be bound", "licensed rights", 2),
    ("cc", r"creative commons corporation (?:\(\W?creative commons\W?\) )?is not a law firm", "not a law firm", 2),
    ("epl-1.0", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e", "accompanying program", 4),
]


def _rules() -> list[Rule]:
    """In order: notices, tags, bodies, addresses, titles, families."""
    rules = []
    for label, ids, title, keyword in LICENSES:
        for keyword in ("creative commons", "cc by", "cc-by", "cc0") if keyword == "c" else (keyword,):
            rules.append(Rule(label, rf"\b(?:licen[cs]ed|released|distributed|available|published|provided)(?: \w++){{0,4}} (?:under|by)(?: the| an?)?(?: terms(?: and conditions)? of the)? {title}{OR_LATER}", keyword, 5, 1.0))
            rules.append(Rule(label, rf"\b{title}{OR_LATER}", keyword, 2, 0.8))
        rules.append(Rule(label, rf"spdx-license-identifier: ?\(?(?:[\w.+-]++ (?:or|and|with) )*{ids}(?![\w.+-])", "spdx-license-identifier", 6, 1.0))
        rules.append(Rule(label, rf"\blicen[cs]e\"?'? ?[:=] ?[\"'\[]*{ids}(?![\w.+-])", "licen", 4, 0.9))
    rules += [Rule(label, pattern, keyword, priority, 0.95) for label, pattern, keyword, priority in BODIES]
    rules += [Rule(label, pattern, keyword, 3, 0.9) for label, pattern, keyword in ADDRESSES]
    rules += [Rule(label, pattern, keyword, 1, 0.3 if label == "copyright" else 0.6) for label, pattern, keyword in FAMILIES]
    return rules


RULES = _rules()


class Detection(NamedTuple):
    label: str
    start: int
    end: int
    rule: int
    weight: float


_RUN = re.compile(r"\s{2,}|[^\S ]")


class Plain(NamedTuple):
    """A text with a blank for each run of white space. ``at`` are the blanks' places of runs that were longer, ``more`` how
    many characters have been left out up to each of them, that one included."""

    text: str
    at: list[int]
    more: list[int]

    @classmethod
    def of(cls, text: str) -> Plain:
        at, more, lost = [], [], 0
        for run in _RUN.finditer(text):
            at.append(run.start() - lost)
            lost += run.end() - run.start() - 1
            more.append(lost)
        return cls(_RUN.sub(" ", text) if at else text, at, more)

    def place(self, i: int) -> int:
        """Where the character ``i`` of the plain text begins in the text."""
        n = bisect_left(self.at, i)
        return i + (self.more[n - 1] if n else 0)


class Scanner:
    """Runs the rules whose keywords occur."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.compiled: list[re.Pattern[str] | None] = [None] * len(rules)
        by: dict[str, list[int]] = {}
        for n, rule in enumerate(rules):
            by.setdefault(rule.keyword, []).append(n)
        self.automaton = ahocorasick.Automaton()
        for keyword, own in by.items():
            self.automaton.add_word(keyword, own)
        self.automaton.make_automaton()

    def detect(self, text: str) -> list[Detection]:
        """Detections in ``text``, lower-cased already, by place."""
        plain = Plain.of(text)
        return [d._replace(start=plain.place(d.start), end=plain.place(d.end - 1) + 1) for d in self._plain(plain.text)]

    def _plain(self, text: str) -> list[Detection]:
        wanted: set[int] = set()
        for _, own in self.automaton.iter(text):
            if own[0] not in wanted:
                wanted.update(own)
        found = []
        for n in wanted:
            if self.compiled[n] is None:
                self.compiled[n] = re.compile(self.rules[n].pattern)
            found += [(-self.rules[n].priority, m.start() - m.end(), m.start(), n, m.end()) for m in self.compiled[n].finditer(text)]
        found.sort()
        strongest: dict[int, int] = {}  # of what is taken, by character: the priority and the farthest end
        reach: dict[int, int] = {}
        kept = []
        for priority, _, start, n, end in found:
            if start == end or reach.get(start, 0) >= end or any(strongest.get(i, 0) > -priority for i in range(start, end)):
                continue
            for i in range(start, end):
                strongest[i] = max(strongest.get(i, 0), -priority)
                reach[i] = max(reach.get(i, 0), end)
            kept.append(Detection(self.rules[n].label, start, end, n, self.rules[n].weight))
        return sorted(kept, key=lambda d: (d.start, d.end))


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(RULES)


def base_places(raw: bytes) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and the word at which each base phrase starts, with its label."""
    blank = raw.translate(_LOWER_AND_BLANK)
    words = blank.split()
    places = []
    if b"license" in blank or b"cc " in blank:
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in BASE.items():
            needle = b" " + phrase.encode() + b" "
            index = before = 0
            at = joined.find(needle)
            while at >= 0:
                index += joined.count(b" ", before, at)
                before = at
                places.append((index, label))
                at = joined.find(needle, at + 1)
    return len(words), sorted(places)


def _lower(text: str) -> str:
    return text.encode("utf-8").lower().decode("utf-8")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each detection: label, span in characters, the rule and the matched text."""

    def start() -> Callable[..., Iterable[tuple[Any, ...]]]:
        own = scanner()
        return lambda k, t: ((k, d.label, d.start, d.end, own.rules[d.rule].pattern, t[d.start : d.end]) for d in own.detect(_lower(t or "")))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], start, f"{id_col} {kind}, label string, start int, end int, rule string, matched string")


def summarise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: words, base phrases, all labels and how sure the strongest detection is."""

    def start() -> Callable[..., Iterable[tuple[Any, ...]]]:
        own = scanner()

        def each(key: Any, text: str | None) -> Iterable[tuple[Any, ...]]:
            text = text or ""
            n, places = base_places(text.encode("utf-8"))
            found = own.detect(_lower(text))
            base = {label for _, label in places}
            miss = 1.0
            for d in found:
                miss *= 1 - 0.9 * d.weight
            score = 1 - miss if found else 0.6 if base else 0.0
            yield (
                key, n, len(places), places[0][0] if places else None, places[-1][0] if places else None,
                ",".join(sorted(base)), ",".join(sorted(base | {d.label for d in found})), score,
            )

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    columns = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_rows(docs, [id_col, text_col], start, f"{id_col} {kind}, {columns}")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(table(spark, sf_dir, "documents"))


QUERIES = {"op9_licenses": op9_licenses}
ORACLES: dict[str, str] = {}
