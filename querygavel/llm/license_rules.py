"""Ordered signature rules for licences over normalised words.

A rule looks at the words around one keyword. In the text it is matched with, words are separated by one space, the text
begins and ends with a space, and the keyword in question is marked by ``<``: no other place can take its part.
"""

from __future__ import annotations

from typing import NamedTuple

#: Words that a match may reach before and after its keyword.
BEFORE, AFTER = 14, 14


class Rule(NamedTuple):
    order: int  # first rules first; breaks ties
    priority: int
    label: str
    keyword: str
    regex: str
    weight: float


#: label; keyword; name before the keyword; name after the keyword (both regexes that take whole words).
FAMILIES = (
    ("mit", "mit", "", ""),
    ("apache-2", "apache", "", "(?: software)?(?: public)?(?: licen[sc]e)?(?: version)?(?: v?2(?: 0)?| v2)"),
    ("apache-1.1", "apache", "", "(?: software)?(?: licen[sc]e)?(?: version)? v?1 1"),
    ("gpl-2", "gpl", "(?: gnu)?", "(?: version)? v?2(?: 0)?"),
    ("gpl-3", "gpl", "(?: gnu)?", "(?: version)? v?3(?: 0)?"),
    ("gpl-2", "general", " gnu", " public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?"),
    ("gpl-3", "general", " gnu", " public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?"),
    ("gpl", "general", " gnu", " public licen[sc]e"),
    ("lgpl-2.1", "lgpl", "(?: gnu)?", "(?: version)? v?2 1"),
    ("lgpl-3", "lgpl", "(?: gnu)?", "(?: version)? v?3(?: 0)?"),
    ("lgpl", "lesser", "(?: gnu)?", " general public licen[sc]e"),
    ("lgpl", "library", " gnu", " general public licen[sc]e"),
    ("agpl-3", "agpl", "(?: gnu)?", "(?: version)? v?3(?: 0)?"),
    ("agpl-3", "affero", "(?: gnu)?", " general public licen[sc]e"),
    ("fdl", "documentation", "(?: gnu)? free", " licen[sc]e"),
    ("bsd-2", "bsd", "(?: simplified| freebsd| 2 clause| two clause)", ""),
    ("bsd-3", "bsd", "(?: new| modified| revised| 3 clause| three clause)", ""),
    ("bsd-2", "bsd", "", " (?:2|two) clause"),
    ("bsd-3", "bsd", "", " (?:3|three) clause"),
    ("bsd-0", "0bsd", "", ""),
    ("mpl-2", "mpl", "", "(?: version)? v?2(?: 0)?"),
    ("mpl-2", "mozilla", "", " public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "", " public licen[sc]e(?: version)? v?1 1"),
    ("epl-2", "eclipse", "", " public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("epl-1", "eclipse", "", " public licen[sc]e(?: version)? v?1(?: 0)?"),
    ("cddl", "cddl", "", "(?: version)?(?: v?1(?: [01])?)?"),
    ("cddl", "distribution", " common development and", " licen[sc]e"),
    ("isc", "isc", "", ""),
    ("zlib", "zlib", "", "(?: libpng)?"),
    ("boost", "boost", "", " software licen[sc]e(?: version)?(?: v?1(?: 0)?)?"),
    ("unlicense", "unlicense", "(?: the)?", ""),
    ("wtfpl", "wtfpl", "", ""),
    ("artistic-2", "artistic", "", " licen[sc]e(?: version)? v?2(?: 0)?"),
    ("eupl", "eupl", "", "(?: version)?(?: v?1 [12])?"),
    ("ofl", "ofl", "(?: sil)?", "(?: version)?(?: v?1 1)?"),
    ("ofl", "font", "(?: sil)? open", " licen[sc]e"),
    ("psf", "python", "", " software foundation licen[sc]e"),
    ("postgresql", "postgresql", "", ""),
    ("cc0", "cc0", "", "(?: v?1 0)?"),
    ("cc-by-nc-nd", "cc", "", " by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "", " by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", "", " by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", "", " by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", "", " by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", "", " by(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", "", " commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", "", " commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", "", " commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-by", "creative", "", " commons attribution(?: [1-4] [05])?"),
    ("cc", "creative", "", " commons"),
)

#: How a licence is spoken of: priority, weight, words before the name, words after it.
FORMS = (
    (90, 0.99, " spdx licen[sc]e identifier", ""),
    (
        80,
        0.95,
        " (?:is |are |be )?(?:licensed|licenced|released|distributed|available|published|provided|covered|made available)"
        "(?: to you)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: open source)?",
        "(?: licen[sc]e)?",
    ),
    (70, 0.9, " (?:under|subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?", "(?: licen[sc]e)?"),
    (60, 0.9, " (?:licen[sc]e|licensing|copyright)(?: is| as| type| name)?(?: the)?", ""),
    (50, 0.8, "(?: the)?", " (?:licen[sc]e|licensed|licensing)"),
)

#: Signatures that stand for themselves: priority, label, keyword, words before, words after, weight.
SINGLE = (
    (85, "mit", "permission", "", " is hereby granted free of charge to any person obtaining a copy", 0.99),
    (85, "isc", "permission", "", " to use copy modify and or distribute this software for any purpose", 0.99),
    (85, "bsd", "redistribution", "", " and use in source and binary forms with or without modification", 0.97),
    (85, "boost", "permission", "", " is hereby granted free of charge to any person or organization", 0.99),
    (85, "unlicense", "unencumbered", " this is free and", " software released into the public domain", 0.99),
    (65, "public-domain", "domain", "(?: in| into| to)?(?: the)? public", "", 0.7),
    (65, "all-rights-reserved", "reserved", " all rights", "", 0.6),
    (65, "proprietary", "proprietary", "", "(?: and confidential| licen[sc]e| software)", 0.6),
    (40, "gpl", "gpl", "(?: gnu)?", "", 0.6),
    (40, "lgpl", "lgpl", "(?: gnu)?", "", 0.6),
    (40, "bsd", "bsd", "", " licen[sc]es?", 0.6),
    (40, "apache", "apache", "", "(?: software)? licen[sc]e", 0.6),
    (40, "mpl", "mozilla", "", " public licen[sc]e", 0.6),
    (40, "epl", "eclipse", "", " public licen[sc]e", 0.6),
    (40, "artistic", "artistic", "", " licen[sc]e", 0.6),
    (30, "copyright-notice", "copyright", "(?: portions)?", "(?: c)? (?:19|20)[0-9][0-9]", 0.3),
    (30, "copyleft", "copyleft", "", "", 0.3),
    (20, "unspecified", "license", " (?:this|the|an?|open source)", "(?: agreement| terms| file)", 0.2),
    (20, "unspecified", "licence", " (?:this|the|an?|open source)", "(?: agreement| terms| file)", 0.2),
)


def rules() -> list[Rule]:
    """All rules in order: each family in each form, then the single signatures."""
    made = []
    for label, keyword, before, after in FAMILIES:
        for priority, weight, lead, tail in FORMS:
            # Of one family, the longer name goes first by its place in the list.
            made.append((priority, label, keyword, f"{lead}{before}", f"{after}{tail}", weight))
    made += [(p, label, keyword, before, after, weight) for p, label, keyword, before, after, weight in SINGLE]
    return [
        Rule(i, priority, label, keyword, f"{before} <{keyword}{after}(?= )", weight)
        for i, (priority, label, keyword, before, after, weight) in enumerate(made)
    ]
