"""Wordings of licenses and of notices that name them, as templates.

Markup: `[[...]]` is an optional region, `{{a b|c}}` a region replaceable by the wordings
given, `{{0-30}}` one replaceable by so many words of any kind. Everything else is
mandatory. Only words count; case and punctuation do not.
"""

from __future__ import annotations

# Phrases of the base rule: every place counts.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Spellings that count as one word, except in phrases.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed",
    "sublicence": "sublicense", "authorised": "authorized", "merchantibility": "merchantability",
    "organisation": "organization", "programme": "program", "http": "https",
}

_GIVEN = """{{licensed|available|distributed|released|published|shared|provided|redistributed}}
    [[to you]] under [[the]] [[{{terms|conditions|provisions}} of [[the]]]]"""
_AS_IS = """[[this software is provided by {{0-20}} as is and]] any express or implied warranties
    including but not limited to the implied warranties of merchantability and fitness for a
    particular purpose are disclaimed"""
_BSD_COPIES = """redistribution and use in source and binary forms with or without modification
    are permitted provided that the following conditions are met [[{{1|a}}]] redistributions of
    source code must retain the {{above|original}} copyright notice this list of conditions and
    the following disclaimer [[{{2|b}}]] redistributions in binary form must reproduce the
    above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution"""
_CREATIVE = _GIVEN + " [[a]] {{cc|creative commons}} "


def _gnu(kind: str, short: str, version: str) -> list[str]:
    number = f"{{{{version {version}|v {version}|v{version}}}}} [[0]]"
    return [
        f"{_GIVEN} gnu {kind} public license [[{short}]] [[as published by the free software foundation]] [[either]] {number}",
        f"{_GIVEN} [[gnu]] {short} {{{{version {version}|v {version}|v{version}|{version}}}}} [[0]]",
        f"""this {{{{program|library|software|file|package}}}} is free software [[you can redistribute it and or
        modify it]] under the terms of the gnu {kind} public license as published by the free software
        foundation either version {version} of the license or [[at your option]] any later version""",
    ]


def _commons(terms: str, words: str) -> list[str]:
    version = "{{1|2|3|4}} {{0|5}}"
    return [
        f"{_CREATIVE} {terms} [[license]] [[version]] {version}",
        f"{_CREATIVE} {words} [[{terms}]] [[license]] [[version]] {version}",
    ]


TEMPLATES = [
    ("mit", [
        f"{_GIVEN} mit [[x11]] license",
        """[[copyright {{0-30}}]] permission is hereby granted free of charge to any person obtaining a
        copy of this software and associated documentation files the software to deal in the
        software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]]
        shall be included in all copies or substantial portions of the software [[the software is
        provided as is without warranty of any kind express or implied including but not limited
        to the warranties of merchantability fitness for a particular purpose and noninfringement
        [[in no event shall {{0-20}} be liable for any claim damages or other liability whether in an
        action of contract tort or otherwise arising from out of or in connection with the
        software or the use or other dealings in the software]]]]""",
    ]),
    ("isc", [
        f"{_GIVEN} isc license",
        """[[copyright {{0-30}}]] permission to use copy modify and or distribute this software for any purpose
        with or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies""",
    ]),
    ("0bsd", [
        """permission to use copy modify and or distribute this software for any purpose with or
        without fee is hereby granted the software is provided as is""",
    ]),
    ("bsd-2", [
        f"{_GIVEN} {{{{simplified bsd|bsd 2 clause|2 clause bsd}}}} license",
        f"{_BSD_COPIES} {_AS_IS}",
    ]),
    ("bsd-3", [
        f"{_GIVEN} {{{{modified bsd|new bsd|bsd 3 clause|3 clause bsd}}}} license",
        f"""{_BSD_COPIES} [[{{{{3|c}}}}]] [[neither]] the {{{{name|names}}}} of {{{{0-20}}}} contributors may [[not]] be
        used to endorse or promote products derived from this software without specific prior
        written permission""",
    ]),
    ("apache-2", [
        f"{_GIVEN} apache [[software]] license [[version]] {{{{2|v2|2 0}}}} [[0]]",
        """licensed under the apache license version 2 0 the license you may not use this file
        except in compliance with the license [[you may obtain a copy of the license at {{0-12}}]]
        unless required by applicable law or agreed to in writing software distributed under
        the license is distributed on an as is basis without warranties or conditions of any kind""",
    ]),
    ("gpl-2", _gnu("general", "gpl", "2")),
    ("gpl-3", _gnu("general", "gpl", "3")),
    ("lgpl-2.1", _gnu("{{lesser|library}} general", "lgpl", "2 1")),
    ("lgpl-3", _gnu("lesser general", "lgpl", "3")),
    ("agpl-3", _gnu("affero general", "agpl", "3")),
    ("mpl-2", [
        f"{_GIVEN} mozilla public license [[mpl]] [[version]] {{{{2|v2|v 2}}}} [[0]]",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a
        copy of the mpl was not distributed with this file you can obtain one at""",
    ]),
    ("epl-2", [f"{_GIVEN} eclipse public license [[epl]] [[version]] {{{{2|v2|v 2}}}} [[0]]"]),
    ("boost-1", [
        f"{_GIVEN} boost software license [[version]] 1 0",
        """permission is hereby granted free of charge to any person or organization obtaining a
        copy of the software and accompanying documentation covered by this license the software
        to use reproduce display distribute execute and transmit the software""",
    ]),
    ("zlib", [
        f"{_GIVEN} {{{{zlib|zlib libpng}}}} license",
        """this software is provided as is without any express or implied warranty in no event
        {{will|shall}} the {{author|authors}} be held liable for any damages arising from the use of this
        software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely""",
    ]),
    ("unlicense", [
        """this is free and unencumbered software released into the public domain anyone is free to
        copy modify publish use compile sell or distribute this software""",
        f"{_GIVEN} unlicense",
    ]),
    ("cc0", [
        f"{_GIVEN} {{{{cc0|cc zero|creative commons zero}}}} [[license]] [[version]] [[1 0]]",
        "to the extent possible under law {{0-20}} waived all copyright and related or neighboring rights to",
    ]),
    ("cc-by", _commons("by", "attribution")),
    ("cc-by-sa", _commons("by sa", "attribution {{share alike|sharealike}}")),
    ("cc-by-nd", _commons("by nd", "attribution {{no derivatives|noderivatives|noderivs}}")),
    ("cc-by-nc", _commons("by nc", "attribution {{non commercial|noncommercial}}")),
    ("cc-by-nc-sa", _commons(
        "by nc sa", "attribution {{non commercial|noncommercial}} {{share alike|sharealike}}")),
    ("cc-by-nc-nd", _commons(
        "by nc nd",
        "attribution {{non commercial|noncommercial}} {{no derivatives|noderivatives|noderivs}}")),
]
