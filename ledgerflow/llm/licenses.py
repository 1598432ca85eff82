"""License scans by ordered signature rules.

Texts become lower-case words joined by single spaces. A rule is a label, keywords, a priority and a regular
expression; it is tried only where its keywords occur. Rules are texts of licenses, their headers and addresses, notices
around names ("licensed under", "X licensed", identifiers), and names that hold a version; a notice goes on over further
names ("A or B", "A/B"). Detections are word intervals. A notice that is denied ("not licensed under") is none. In
descending priority, then length, then order of the rules, a detection inside one already taken is suppressed. The
fixed phrases of the base rules always count, denied or not, and their labels stay.

Defined cases: a null text is empty; no detection gives empty labels, null first and last word and score 0; an interval held
by two labels of one priority goes to the longer, then to the earlier rule; repeated rows are scanned each; a very long
text is scanned whole, in time in proportion to its words and matches; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import _text as tx
from ledgerflow.llm._spark import in_arrow

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
WORD = tx.byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Label, words that a text must have (each way of writing the name holds them all), names as they are written (words joined by spaces).
NAMES = (
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)? (?:version |v ?)?1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)? (?:version |v ?)?2(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl (?:version |v ?)?2(?: 0)?"),
    ("gpl-2", "general public", r"gnu general public license (?:version |v ?)?2(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl (?:version |v ?)?3(?: 0)?"),
    ("gpl-3", "general public", r"gnu general public license (?:version |v ?)?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl (?:version |v ?)?2 1"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license (?:version |v ?)?2 1"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl (?:version |v ?)?3(?: 0)?"),
    ("lgpl-3", "lesser", r"gnu lesser general public license (?:version |v ?)?3(?: 0)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl (?:version |v ?)?3(?: 0)?"),
    ("agpl-3", "affero", r"gnu affero general public license (?:version |v ?)?3(?: 0)?"),
    ("bsd-2-clause", "freebsd", r"freebsd"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("isc", "isc", r"isc"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v ?)?1 1"),
    ("mpl-2", "mozilla", r"mozilla public license (?:version |v ?)?2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl (?:version |v ?)?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license (?:version |v ?)?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license (?:version |v ?)?2(?: 0)?"),
    ("cddl-1", "cddl", r"cddl(?: (?:version |v ?)?1(?: [01])?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1", "boost", r"boost software(?: license)? (?:version |v ?)?1(?: 0)?"),
    *((f"{k}gpl-{v}", f"{k}gplv{v}", rf"{k}gplv{v}(?: 0)?") for k, v in (("", 2), ("", 3), ("l", 3), ("a", 3))),
    ("mpl-2", "mplv2", r"mplv2(?: 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-2", "artistic", r"artistic license (?:version |v ?)?2(?: 0)?"),
    ("python-2", "python", r"python software foundation license(?: version 2)?"),
    ("python-2", "psf", r"psf license"),
    ("postgresql", "postgresql", r"postgresql"),
    ("odbl-1", "database", r"open database license(?: (?:version |v ?)?1(?: 0)?)?"),
    ("ofl-1.1", "sil", r"sil open font license(?: (?:version |v ?)?1 1)?"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: (?:version |v ?)?1 2)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    *((f"cc-{k.replace(' ', '-')}", "cc", rf"cc {k}(?: [1-4] 0)?") for k in ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")),
    *((f"cc-{k.replace(' ', '-')}", "creative", f"creative commons {w}(?: [1-4] 0)?") for k, w in (("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s"), ("by sa", "attribution share ?alike"), ("by", "attribution"))),
)
#: Families of licenses without a version: label, keyword, names.
FAMILIES = (
    ("apache", "apache", r"apache(?: software)?(?: license)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("mpl", "mpl", r"mpl"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl", "epl", r"epl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("eupl", "eupl", r"eupl"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("python", "python", r"python(?: software foundation)?"),
    ("cc", "creative", r"creative commons"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl"),
    ("gfdl", "fdl", r"(?:gnu )?fdl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e"),
)
#: Names that may go on a notice of others; "python" is a program more often than a license there.
JOINED = (*NAMES, *(x for x in FAMILIES if x[0] != "python"))
#: Of the families, those that are a whole name by themselves.
WHOLE_FAMILIES = {"general public", "lesser", "library general", "affero", "mozilla", "eclipse", "documentation"}
#: Of the names, those that say enough by themselves, with the version they must hold.
VERSIONED = {
    ("apache-2", "apache"): r"apache(?: software)?(?: license)? (?:version |v ?)?2 0",
    ("gpl-2", "gpl"): r"(?:gnu )?gpl (?:version |v ?)?2(?: 0)?", ("gpl-3", "gpl"): r"(?:gnu )?gpl (?:version |v ?)?3(?: 0)?",
    ("gpl-2", "general public"): r"gnu general public license (?:version |v ?)?2(?: 0)?", ("gpl-3", "general public"): r"gnu general public license (?:version |v ?)?3(?: 0)?",
    ("lgpl-2.1", "lgpl"): r"(?:gnu )?lgpl (?:version |v ?)?2 1", ("lgpl-3", "lgpl"): r"(?:gnu )?lgpl (?:version |v ?)?3(?: 0)?", ("agpl-3", "agpl"): r"(?:gnu )?agpl (?:version |v ?)?3(?: 0)?",
    ("lgpl-2.1", "lesser"): r"gnu lesser general public license (?:version |v ?)?2 1", ("lgpl-3", "lesser"): r"gnu lesser general public license (?:version |v ?)?3(?: 0)?", ("agpl-3", "affero"): r"gnu affero general public license (?:version |v ?)?3(?: 0)?",
    ("gpl-2", "gplv2"): r"gplv2(?: 0)?", ("gpl-3", "gplv3"): r"gplv3(?: 0)?", ("lgpl-3", "lgplv3"): r"lgplv3(?: 0)?", ("agpl-3", "agplv3"): r"agplv3(?: 0)?", ("mpl-2", "mplv2"): r"mplv2(?: 0)?",
    ("bsd-2-clause", "bsd"): r"bsd 2 clause|2 clause bsd|two clause bsd", ("bsd-3-clause", "bsd"): r"bsd 3 clause|3 clause bsd|three clause bsd", ("bsd-4-clause", "bsd"): r"bsd 4 clause|4 clause bsd|four clause bsd",
    ("mpl-2", "mpl"): r"mpl (?:version |v ?)?2 0", ("mpl-2", "mozilla"): r"mozilla public license (?:version |v ?)?2(?: 0)?", ("mpl-1.1", "mozilla"): r"mozilla public license (?:version |v ?)?1 1",
    ("epl-1", "eclipse"): r"eclipse public license (?:version |v ?)?1(?: 0)?", ("epl-2", "eclipse"): r"eclipse public license (?:version |v ?)?2(?: 0)?",
    **{(f"cc-{k.replace(' ', '-')}", "cc"): rf"cc {k} [1-4] 0" for k in ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")},
}
#: Priority, weight, words of which a text has one, and how a name stands in such a license notice.
LATER = r"(?: or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?| or greater| only| plus)?"
NOTICES = (
    (9, 1.0, ("spdx",), r"spdx license identifier (?:{name})"),
    (9, 0.95, ("dual", "dually", "multi", "triple"), r"(?:dual|dually|multi|triple) licen[cs]ed (?:(?:under|as|with) )?(?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]es?)?"),
    (8, 0.95, ("under",), r"(?:licen[cs]ed|released|distributed|published|available|redistributed|provided|made available|shared|covered|contributed) under (?:both )?(?:an? )?(?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})(?: licen[cs]es?)?"),
    (8, 0.9, ("licensed", "licenced"), r"(?:{name}) licen[cs]ed"),
    (8, 0.9, ("governed", "protected"), r"(?:governed|protected) by (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?"),
    (7, 0.9, ("under",), r"under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?"),
    (6, 0.9, ("license", "licence"), r"(?:{name}) licen[cs]e(?: agreement)?"),
    (6, 0.85, ("license", "licence"), r"licen[cs]e (?:is |type |name )?(?:the )?(?:{name})"),
    (5, 0.8, ("subject", "according", "pursuant"), r"(?:subject|according|pursuant) to (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?"),
)
#: A name that holds a version says enough by itself.
BARE = (2, 0.6)
#: Kinds of notice in which a family may stand (not a mere "under", as programs run under others); all of lower priority than any other rule.
FAMILY_NOTICES = tuple((1 + p / 100, 0.8 * w, has, text) for p, w, has, text in NOTICES if not text.startswith(("under", "(?:subject")))
FAMILY_BARE = (1, 0.5)
#: Signatures by text of the licenses themselves, their headers, addresses and general notices (priority, weight, label, keyword, words).
PHRASES = (
    (10, 1.0, "mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (10, 0.9, "mit", "portions", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions"),
    (10, 0.9, "mit", "opensource", r"opensource org licenses mit(?: license)?(?: php)?"),
    (11, 1.0, "x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    (10, 1.0, "isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    (11, 1.0, "hpnd", "documentation", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose"),
    (10, 1.0, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (10, 0.9, "bsd", "redistributions", r"redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice"),
    (11, 1.0, "bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,12}?contributors may be used to endorse or promote products"),
    (11, 1.0, "bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    (10, 0.9, "bsd-3-clause", "opensource", r"opensource org licenses bsd 3 clause"),
    (10, 0.9, "bsd-2-clause", "opensource", r"opensource org licenses bsd 2 clause"),
    (10, 1.0, "zlib", "altered", r"altered source versions must be plainly marked as such"),
    (10, 0.9, "zlib", "liable", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    (10, 1.0, "apache-2", "apache", r"www apache org licenses license 2 0"),
    (10, 1.0, "apache-2", "apache", r"apache license version 2 0 january 2004"),
    (10, 1.0, "apache-2", "compliance", r"you may not use this file except in compliance with the license"),
    (10, 1.0, "apache-2", "apache", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    (11, 1.0, "apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    (10, 0.9, "gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (11, 1.0, "gpl-2", "general public", r"gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?(?: or at your option any later version)?"),
    (11, 1.0, "gpl-3", "general public", r"gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or at your option any later version)?"),
    (11, 1.0, "lgpl-2.1", "lesser general", r"gnu lesser general public license as published by the free software foundation (?:either )?version 2(?: 1)?(?: of the license)?(?: or at your option any later version)?"),
    (11, 1.0, "lgpl-3", "lesser general", r"gnu lesser general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or at your option any later version)?"),
    (11, 1.0, "lgpl-2", "library general", r"gnu library general public license as published by the free software foundation (?:either )?version 2(?: of the license)?(?: or at your option any later version)?"),
    (11, 1.0, "agpl-3", "affero general", r"gnu affero general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or at your option any later version)?"),
    (10, 0.9, "gpl-3", "gnu", r"www gnu org licenses gpl 3 0"),
    (10, 0.9, "gpl-2", "gnu", r"www gnu org licenses (?:old licenses )?gpl 2 0"),
    (10, 0.9, "lgpl-3", "gnu", r"www gnu org licenses lgpl 3 0"),
    (10, 0.9, "agpl-3", "gnu", r"www gnu org licenses agpl 3 0"),
    (9, 0.8, "gpl", "gnu", r"you should have received a copy of the gnu general public license"),
    (9, 0.8, "lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    (9, 0.8, "agpl", "gnu", r"you should have received a copy of the gnu affero general public license"),
    (10, 1.0, "gfdl-1.3", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (10, 1.0, "mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    (10, 1.0, "mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    (10, 0.9, "mpl-2", "mozilla", r"mozilla org mpl 2 0"),
    (10, 1.0, "epl-2", "eclipse", r"made available under the terms of the eclipse public license (?:v |version )?2 0"),
    (10, 1.0, "epl-1", "eclipse", r"made available under the terms of the eclipse public license (?:v |version )?1 0"),
    (10, 1.0, "edl-1", "eclipse", r"eclipse distribution license (?:v |version )?1(?: 0)?"),
    (10, 1.0, "cddl-1", "distribution", r"subject to the terms of the common development and distribution license"),
    (10, 1.0, "cpl-1", "common public", r"common public license (?:v |version )?1 0"),
    (10, 1.0, "ms-pl", "microsoft", r"microsoft public license(?: ms pl)?"),
    (10, 1.0, "ms-rl", "reciprocal", r"microsoft reciprocal license(?: ms rl)?"),
    (10, 1.0, "osl-3", "software license", r"open software license (?:v |version )?3 0"),
    (10, 1.0, "afl-3", "academic", r"academic free license (?:v |version )?3 0"),
    (9, 0.8, "afl", "academic", r"academic free license"),
    (10, 1.0, "perl", "perl", r"(?:under )?the same terms as perl(?: 5)?(?: itself)?"),
    (10, 1.0, "artistic-1", "artistic", r"the artistic license(?: 1 0)?"),
    (10, 1.0, "ruby", "ruby", r"(?:distributed under|the same terms as) (?:the )?ruby(?: s)? license"),
    (10, 1.0, "php-3.01", "php", r"the php license version 3 01"),
    (10, 1.0, "zpl-2.1", "zope", r"zope public license(?: zpl)? version 2 1"),
    (10, 1.0, "w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?license"),
    (10, 1.0, "unicode", "unicode", r"unicode inc license agreement data files and software"),
    (10, 1.0, "openssl", "openssl", r"this product includes software developed by the openssl project"),
    (10, 1.0, "ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    (10, 1.0, "json", "evil", r"the software shall be used for good not evil"),
    (10, 1.0, "beerware", "beer", r"you can buy me a beer in return"),
    (10, 1.0, "unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    (10, 0.9, "unlicense", "unlicense", r"unlicense org"),
    (10, 1.0, "wtfpl", "public license", r"do what the fuck you want to public license"),
    (10, 1.0, "boost-1", "boost", r"boost software license version 1 0"),
    (10, 0.9, "boost-1", "boost", r"www boost org license 1 0(?: txt)?"),
    (10, 1.0, "0bsd", "bsd", r"(?:bsd zero clause|zero clause bsd)(?: license)?"),
    (10, 1.0, "0bsd", "0bsd", r"0bsd(?: license)?"),
    (10, 1.0, "mit-0", "attribution", r"mit no attribution"),
    (10, 1.0, "ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license"),
    (10, 1.0, "upl-1", "permissive", r"universal permissive license(?: upl)?(?: (?:v |version )?1 0)?"),
    (10, 1.0, "mulan-2", "mulan", r"mulan (?:psl|permissive software license) v2"),
    (10, 1.0, "blueoak-1", "oak", r"blue oak model license(?: version)?(?: 1 0 0)?"),
    (10, 1.0, "sspl-1", "server side", r"server side public license(?: version 1)?"),
    (10, 1.0, "busl-1.1", "business source", r"business source license 1 1"),
    (10, 1.0, "elastic-2", "elastic", r"elastic license(?: version)? 2 0"),
    (10, 1.0, "commons-clause", "commons", r"commons clause license condition(?: v1 0)?"),
    (10, 1.0, "polyform-nc", "polyform", r"polyform noncommercial license(?: 1 0 0)?"),
    (10, 1.0, "sleepycat", "sleepycat", r"sleepycat license"),
    (10, 1.0, "vim", "vim", r"vim license"),
    (10, 1.0, "cecill-2.1", "cecill", r"cecill(?: free software)?(?: license)?(?: agreement)? (?:version |v ?)?2 1"),
    (10, 1.0, "cecill-b", "cecill", r"cecill b(?: license)?"),
    (10, 1.0, "qpl-1", "public license", r"q public license version 1 0"),
    (10, 1.0, "lppl-1.3c", "latex", r"latex project public license(?: (?:v |version )?1 3c?)?"),
    (10, 1.0, "ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    (10, 0.9, "ofl-1.1", "sil", r"scripts sil org ofl"),
    (10, 1.0, "odc-by-1", "commons", r"open data commons attribution license(?: v1 0)?"),
    (10, 1.0, "pddl-1", "dedication", r"(?:open data commons )?public domain dedication and license(?: v1 0)?"),
    (10, 1.0, "odbl-1", "opendatacommons", r"opendatacommons org licenses odbl"),
    (10, 1.0, "cc0", "waived", r"to the extent possible under law (?:[^ ]+ ){1,12}?(?:has|have) waived all copyright"),
    (10, 1.0, "cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    (10, 1.0, "cc-pdm", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    *((10 + len(k.split()), 1.0, f"cc-{k.replace(' ', '-')}", "creativecommons", rf"creativecommons org licenses {k}(?: [1-4] [05])?") for k in ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")),
    (10, 1.0, "ogl-3", "government", r"open government licen[cs]e (?:version |v ?)?3 0"),
    (9, 0.8, "ogl", "government", r"open government licen[cs]e"),
    (10, 1.0, "aal", "attribution", r"attribution assurance license"),
    (10, 1.0, "apsl-2", "apple", r"apple public source license(?: version)?(?: 2 0)?"),
    (10, 1.0, "apl-1", "adaptive", r"adaptive public license(?: version)?(?: 1 0)?"),
    (10, 1.0, "artistic-clarified", "artistic", r"clarified artistic license"),
    (10, 1.0, "bittorrent", "bittorrent", r"bittorrent open source license(?: version 1 [01])?"),
    (10, 1.0, "bsd-protection", "protection", r"bsd protection license"),
    (10, 1.0, "bsd-patent", "patent", r"bsd(?: 2 clause)? plus patent license"),
    (10, 1.0, "bsd-3-clause-clear", "clear", r"(?:the )?clear bsd license"),
    (10, 1.0, "bsd-3-clause-lbnl", "berkeley", r"lawrence berkeley national labs bsd(?: variant)? license"),
    (10, 1.0, "bzip2", "bzip2", r"bzip2 license|the program bzip2 the associated library libbzip2"),
    (10, 1.0, "caldera", "caldera", r"caldera license"),
    (10, 1.0, "catosl-1.1", "computer associates", r"computer associates trusted open source license(?: 1 1)?"),
    (10, 1.0, "cdla-permissive", "data", r"community data license agreement permissive(?: (?:version )?[12] 0)?"),
    (10, 1.0, "cdla-sharing", "data", r"community data license agreement sharing(?: (?:version )?1 0)?"),
    (10, 1.0, "cecill-c", "cecill", r"cecill c(?: license)?"),
    (10, 1.0, "cern-ohl", "hardware", r"cern open hardware licen[cs]e(?: version)?(?: [12](?: [0-9])?)?"),
    (10, 1.0, "clartistic", "clartistic", r"clartistic"),
    (10, 1.0, "cnri-python", "cnri", r"cnri (?:open source )?(?:python )?license(?: agreement)?"),
    (10, 1.0, "condor-1.1", "condor", r"condor public license(?: (?:version |v ?)?1 1)?"),
    (10, 1.0, "cpal-1", "common public", r"common public attribution license(?: version)?(?: 1 0)?"),
    (10, 1.0, "cua-opl-1", "cua", r"cua office public license(?: version)?(?: 1 0)?"),
    (10, 1.0, "curl", "curl", r"curl license"),
    (10, 1.0, "dco", "origin", r"developer certificate of origin(?: version)?(?: 1 1)?"),
    (10, 1.0, "doc", "ace", r"licensing information for ace"),
    (10, 1.0, "ecl-2", "educational", r"educational community license(?: version)?(?: 2 0)?"),
    (10, 1.0, "efl-2", "eiffel", r"eiffel forum license(?: version)?(?: 2)?"),
    (10, 1.0, "entessa", "entessa", r"entessa public license(?: version)?(?: 1 0)?"),
    (10, 1.0, "erlpl-1.1", "erlang", r"erlang public license(?: version)?(?: 1 1)?"),
    (10, 1.0, "etalab-2", "ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?"),
    (10, 1.0, "eudatagrid", "eu", r"eu datagrid software license"),
    (10, 1.0, "fair", "instrument", r"usage of the works is permitted provided that this instrument is retained"),
    (10, 1.0, "frameworx-1", "frameworx", r"frameworx open license(?: 1 0)?"),
    (10, 1.0, "ftl", "freetype", r"(?:the )?freetype project license|portions of this software are copyright [^ ]+ the freetype project"),
    (10, 1.0, "gfdl-1.1", "documentation", r"gnu free documentation license version 1 1"),
    (10, 1.0, "gfdl-1.2", "documentation", r"gnu free documentation license version 1 2"),
    (10, 1.0, "gfdl-1.3", "documentation", r"gnu free documentation license version 1 3"),
    (10, 1.0, "glide", "glide", r"3dfx glide source code general public license"),
    (10, 1.0, "gpl-classpath", "exception", r"as a special exception the copyright holders of this (?:library|program) give you permission to link"),
    (10, 1.0, "hippocratic-2.1", "hippocratic", r"hippocratic license(?: version)?(?: (?:number )?2 1)?"),
    (10, 1.0, "ibm-pibs", "ibm", r"this source code has been made available to you by ibm on an as is basis"),
    (10, 1.0, "icu", "icu", r"icu license(?: icu 1 8 1 and later)?"),
    (10, 1.0, "ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    (10, 1.0, "imagemagick", "imagemagick", r"imagemagick license"),
    (10, 1.0, "imatix", "imatix", r"imatix standard function library"),
    (10, 1.0, "info-zip", "info zip", r"(?:the )?info zip license|info zip is defined as the following set of individuals"),
    (10, 1.0, "intel", "intel", r"intel open source license"),
    (10, 1.0, "ipa", "ipa", r"ipa font license(?: agreement)?(?: v1 0)?"),
    (10, 1.0, "ipl-1", "ibm", r"ibm public license(?: version)?(?: 1 0)?"),
    (10, 1.0, "jasper-2", "jasper", r"jasper license version 2 0"),
    (10, 1.0, "lal-1.3", "art", r"licence art libre(?: 1 3)?|free art license(?: 1 3)?"),
    (10, 1.0, "leptonica", "leptonica", r"leptonica license"),
    (10, 1.0, "lgpllr", "linguistic", r"lesser general public license for linguistic resources"),
    (10, 1.0, "libpng", "png", r"png reference library license(?: version 2)?"),
    (10, 1.0, "libpng", "libpng", r"libpng license(?: version 2)?"),
    (10, 1.0, "libtiff", "silicon", r"the names of sam leffler and silicon graphics may not be used in any advertising"),
    (10, 1.0, "liliq-p-1.1", "québec", r"licence libre du québec permissive(?: liliq p)?(?: version)?(?: 1 1)?"),
    (10, 1.0, "liliq-r-1.1", "réciprocité", r"licence libre du québec réciprocité(?: liliq r)?(?: version)?(?: 1 1)?"),
    (10, 1.0, "llama-2", "llama", r"llama 2 community license(?: agreement)?"),
    (10, 1.0, "llama-3", "llama", r"(?:meta )?llama 3(?: [1-3])? community license(?: agreement)?"),
    (10, 1.0, "lucent-1.02", "lucent", r"lucent public license(?: version)?(?: 1 02)?"),
    (10, 1.0, "miros", "miros", r"(?:the )?miros licence"),
    (10, 1.0, "mit-advertising", "enlightenment", r"enlightenment license(?: e16)?"),
    (10, 1.0, "mit-cmu", "carnegie", r"carnegie mellon university makes no representations about the suitability of this software"),
    (10, 1.0, "mit-modern", "modern", r"mit license modern variant"),
    (10, 1.0, "motosoto", "motosoto", r"motosoto open source license(?: version)?(?: 0 9 1)?"),
    (10, 1.0, "multics", "multics", r"multics license"),
    (10, 1.0, "nasa-1.3", "nasa", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    (10, 1.0, "naumen", "naumen", r"naumen public license"),
    (10, 1.0, "nbpl-1", "net boolean", r"net boolean public license(?: v1)?"),
    (10, 1.0, "ngpl", "nethack", r"nethack general public license"),
    (10, 1.0, "nokia", "nokia", r"nokia open source license(?: version)?(?: 1 0a)?"),
    (10, 1.0, "nosl-1", "netizen", r"netizen open source license(?: version)?(?: 1 0)?"),
    (10, 1.0, "npl-1.1", "netscape", r"netscape public license(?: version)?(?: 1 [01])?"),
    (10, 1.0, "nposl-3", "non profit", r"non profit open software license(?: version)?(?: 3 0)?"),
    (10, 1.0, "ntp", "ntp", r"ntp license"),
    (10, 1.0, "oclc-2", "oclc", r"oclc research public license(?: version)?(?: 2 0)?"),
    (10, 1.0, "ogtsl", "group", r"open group test suite license"),
    (10, 1.0, "oldap-2.8", "openldap", r"(?:the )?openldap public license(?: version)?(?: 2 8)?"),
    (10, 1.0, "openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open rail(?: \+\+)?(?: m)?(?: license)?"),
    (10, 1.0, "openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?"),
    (10, 1.0, "oset-2.1", "oset", r"oset (?:foundation )?public license(?: version)?(?: 2 1)?"),
    (10, 1.0, "parity-7", "parity", r"parity public license(?: 7 0 0)?"),
    (10, 1.0, "prosperity-3", "prosperity", r"prosperity public license(?: 3 0 0)?"),
    (10, 1.0, "rpl-1.5", "reciprocal", r"reciprocal public license(?: version)?(?: 1 5)?"),
    (10, 1.0, "rpsl-1", "realnetworks", r"realnetworks public source license(?: version)?(?: (?:v ?)?1 0)?"),
    (10, 1.0, "rscpl", "ricoh", r"ricoh source code public license"),
    (10, 1.0, "sgi-b-2", "sgi", r"sgi free software license b(?: version)?(?: 2 0)?"),
    (10, 1.0, "simpl-2", "simple", r"simple public license(?: 2 0)?"),
    (10, 1.0, "sissl-1.1", "sun", r"sun industry standards source license(?: version)?(?: 1 1)?"),
    (10, 1.0, "spl-1", "sun", r"sun public license(?: version)?(?: 1 0)?"),
    (10, 1.0, "tcl", "tcl", r"tcl tk license"),
    (10, 1.0, "ucl-1", "upstream", r"upstream compatibility license(?: (?:version |v ?)?1 0)?"),
    (10, 1.0, "vsl-1", "vovida", r"vovida software license(?: (?:version |v ?)?1 0)?"),
    (10, 1.0, "watcom-1", "sybase", r"sybase open watcom public license(?: version)?(?: 1 0)?"),
    (10, 1.0, "xfree86-1.1", "xfree86", r"xfree86(?: project)? license(?: 1 1)?"),
    (10, 1.0, "xnet", "x net", r"x net license"),
    (10, 1.0, "ypl-1.1", "yahoo", r"yahoo public license(?: version)?(?: (?:v ?)?1 1)?"),
    (10, 1.0, "zend-2", "zend", r"zend(?: engine)? license(?: version)?(?: 2 0)?"),
    (4, 0.7, "public-domain", "public domain", r"(?:released|placed|dedicated|is|are|put) (?:in|into|to) the public domain"),
    (4, 0.7, "public-domain", "copyright", r"(?:has|have) no known copyright restrictions"),
    (4, 0.7, "proprietary", "proprietary", r"proprietary and confidential"),
    (4, 0.8, "proprietary", "unauthorized", r"unauthorized copying of this (?:file|software)(?: via any medium)? is strictly prohibited"),
    (4, 0.7, "proprietary", "prohibited", r"(?:reproduction|redistribution|copying|use) (?:in whole or in part )?(?:without (?:prior )?(?:written )?permission )?is (?:strictly )?prohibited"),
    (4, 0.6, "proprietary", "evaluation", r"for (?:internal )?evaluation (?:use|purposes) only"),
    (4, 0.6, "non-commercial", "commercial", r"for (?:personal )?non commercial use only"),
    (4, 0.6, "non-commercial", "noncommercial", r"for (?:personal )?noncommercial use only"),
    (4, 0.6, "non-commercial", "commercial", r"(?:no|not for) commercial use(?: allowed| permitted)?"),
    (4, 0.6, "research-only", "research", r"for (?:academic and )?research (?:use|purposes) only"),
    (3, 0.5, "proprietary", "reserved", r"all rights (?:are )?reserved"),
    (3, 0.5, "proprietary", "vorbehalten", r"alle rechte vorbehalten"),
    (3, 0.5, "proprietary", "droits", r"tous droits reserves"),
    (3, 0.5, "proprietary", "derechos", r"todos los derechos reservados"),
)
#: Words that, at most NEAR words before a notice of low or middle priority, deny it; and how further names join a notice.
DENIALS, NEAR = frozenset(("not", "never", "neither", "isn", "aren", "wasn", "no")), 3
DENIED_BELOW = 10
JOINS = r"(?: (?:or|and|and or|with|plus|as well as|at your option))?(?: under)?(?: the)?"


class Rule(NamedTuple):
    priority: int
    weight: float
    label: str
    keywords: frozenset  # words that a text must all have
    notice: frozenset  # words of which it must have one, if any are named
    find: re.Pattern


@cache
def rules() -> tuple[Rule, ...]:
    """All rules by descending priority; each name gives one rule for each kind of notice, and one by itself if it holds a version."""
    whole = r"(?<![^ ])(?:{})(?![^ ])"
    made = [Rule(p, w, label, frozenset(key.split()), frozenset(), re.compile(whole.format(text))) for p, w, label, key, text in PHRASES]
    made += [Rule(p, w, label, frozenset(key.split()), frozenset(has), re.compile(whole.format(notice.format(name=name) + LATER))) for label, key, name in NAMES for p, w, has, notice in NOTICES]
    made += [Rule(*BARE, label, frozenset(key.split()), frozenset(), re.compile(whole.format(f"(?:{VERSIONED[label, key]}){LATER}"))) for label, key, _ in NAMES if (label, key) in VERSIONED]
    made += [Rule(p, w, label, frozenset(key.split()), frozenset(has), re.compile(whole.format(notice.format(name=name) + LATER))) for label, key, name in FAMILIES for p, w, has, notice in FAMILY_NOTICES]
    made += [Rule(*FAMILY_BARE, label, frozenset(key.split()), frozenset(), re.compile(whole.format(f"(?:{name}){LATER}"))) for label, key, name in FAMILIES if key in WHOLE_FAMILIES]
    return tuple(sorted(made, key=lambda r: -r.priority))


@cache
def rules_by_word() -> dict[str, tuple[tuple[int, Rule], ...]]:
    """The rules, with their order, under one of their keywords."""
    out: dict[str, list] = {}
    for k, rule in enumerate(rules()):
        out.setdefault(max(sorted(rule.keywords), key=len), []).append((k, rule))
    return {w: tuple(v) for w, v in out.items()}


@cache
def gates() -> tuple[tuple[bytes, re.Pattern], ...]:
    """Beginnings of words, each as bytes and as a pattern: a text without any of them has no detection."""
    words = sorted({*rules_by_word(), *(phrase.split()[0] for phrase, _ in BASE)}, key=len)
    short: list[str] = []
    for w in words:
        if not w.startswith(tuple(short)):
            short.append(w)
    return tuple((w.encode(), re.compile(rb"(?<![0-9a-z\x80-\xff])" + w.encode())) for w in short)


@cache
def joined_names() -> re.Pattern:
    return re.compile(JOINS + " (?:" + "|".join(f"(?P<n{k}>{name})" for k, (_, _, name) in enumerate(JOINED)) + f"){LATER}(?: licen[cs]es?)?(?![^ ])")


class Found(NamedTuple):
    start: int
    end: int
    label: str
    weight: float


class Covered:
    """Intervals taken so far, kept as those inside no other, by start; these have ascending ends too."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        j = bisect_right(self.ends, end, k)
        self.starts[k:j], self.ends[k:j] = [start], [end]


def detections(words: list[str]) -> list[Found]:
    """What the rules find, after denial and suppression, by start. Work is in proportion to words and matches."""
    line, have = " ".join(words), frozenset(words)
    at = [0, *accumulate(len(w) + 1 for w in words)]  # the places of the words in the line
    hits: list[tuple] = []

    def put(rule: Rule, k: int, label: str, s: int, e: int, order: int, denied: bool) -> None:
        hits.append((-rule.priority, s - e, k, order, Found(bisect_left(at, s), bisect_left(at, e), label, rule.weight), denied))

    by = rules_by_word()
    for word in have & by.keys():
        for k, rule in by[word]:
            if not rule.keywords <= have or (rule.notice and not rule.notice & have):
                continue
            for m in rule.find.finditer(line):
                first = bisect_left(at, m.start())
                denied = rule.priority < DENIED_BELOW and not DENIALS.isdisjoint(words[max(0, first - NEAR) : first])
                put(rule, k, rule.label, m.start(), m.end(), 0, denied)
                if rule.notice:  # further names of an expression: A or B, A/B, A with B
                    e = m.end()
                    while more := joined_names().match(line, e):
                        put(rule, k, JOINED[int(more.lastgroup[1:])][0], more.start(more.lastgroup), more.end(), 1, denied)
                        e = more.end()
    taken, covered = [], Covered()
    for *_, f, denied in sorted(hits):
        if not covered.holds(f.start, f.end):
            covered.add(f.start, f.end)
            taken += [] if denied else [f]
    return sorted(taken)


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        parts = phrase.split()
        at = -1
        for _ in range(words.count(parts[0])):
            at = words.index(parts[0], at + 1)
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, marks = [], gates()
        for c in tx.chunks(batch.column("text")):
            data = tx.LOWER[c.data]
            row, *_ = c.words(WORD[data])
            counts, text = np.bincount(row, minlength=c.n), data.tobytes()
            for k in range(c.n):
                one = text[c.off[k] : c.off[k + 1]]
                if not any(g in one and begins.search(one) for g, begins in marks):
                    rows.append((int(counts[k]), 0, None, None, "", "", 0.0))
                    continue
                words = WORDS.findall(one.decode("utf-8"))
                base, more = base_places(words), detections(words)
                at = [p for p, _ in base]
                labels = {label for _, label in base}
                score = 1.0 if base else max((f.weight for f in more), default=0.0)
                rows.append((int(counts[k]), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {f.label for f in more})), score))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
