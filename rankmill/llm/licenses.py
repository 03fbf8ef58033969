"""License scans by ordered signature rules.

A text is lower-cased and reduced to its words, joined by single spaces; rules are regular expressions over that, written
by hand: sentences of license bodies, notices and exceptions, addresses, names in a grant, and mere names; and a tag for
each of a list of identifiers. A rule is tried only if of each of its one or two keyword sets one occurs, which one Aho-Corasick
pass finds; the sets are read off the rule's parse tree, so that whatever it matches passes. Of the detections, those inside
a detection of a rule that comes earlier in priority are dropped, by a sweep over the intervals that stay. Base phrases are counted apart and never dropped. The work is
linear in the text, but for the sorting of what is found.

Defined cases: a null text is an empty one, without words, labels and with score 0; a null doc_id is kept; repeated rows
each give a row; an empty table gives none; further columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from re import _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import bpe, common

#: What a word isn't, in bytes; the same bytes end a word in UTF-8.
_TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

_L = "licen[sc]e"
_V = r"(?: version| v)? v?"
_GPL = f"general public {_L}"
_UNDER = r"(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|offered|covered|shared|contributed|made available) (?:under|by|through)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? "

#: (label, confidence, pattern) in order of priority. Words are in lower case and without signs; a rule begins and ends with a word.
WRITTEN = (
    # sentences of license bodies
    ("mit", 1.0, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"),
    ("mit", 0.9, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 0.6, r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", 1.0, r"permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}without restriction .{0,300}mit no attribution"),
    ("x11", 1.0, r"except as contained in this notice the name of .{1,80} shall not be used in advertising or otherwise to promote the sale"),
    ("isc", 1.0, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", 0.9, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd-4-clause", 1.0, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", 1.0, r"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote"),
    ("bsd-3-clause", 0.95, r"the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", 1.0, r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause", 0.9, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", 0.9, r"redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", 0.95, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause-patent", 1.0, r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide"),
    ("apache-1.1", 1.0, r"this product includes software developed by the apache software foundation"),
    ("apache-2", 1.0, rf"you may not use this file except in compliance with the {_L}"),
    ("apache-2", 0.95, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 1.0, rf"terms and conditions for use reproduction and distribution 1 definitions {_L} shall mean"),
    ("apache-2", 0.9, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("agpl-3", 1.0, rf"the gnu affero {_GPL} is a free copyleft license for software and other kinds of works"),
    ("agpl-3", 0.95, r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("lgpl-2.1", 1.0, rf"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser {_GPL} .{{0,80}}version 2 1"),
    ("lgpl-3", 1.0, rf"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser {_GPL} .{{0,80}}version 3"),
    ("lgpl-2", 1.0, rf"this library is free software you can redistribute it and or modify it under the terms of the gnu library {_GPL}"),
    ("lgpl", 0.9, rf"this version of the gnu lesser {_GPL} incorporates the terms and conditions"),
    ("gpl-3", 1.0, rf"you can redistribute it and or modify it under the terms of the gnu {_GPL} .{{0,80}}version 3"),
    ("gpl-2", 1.0, rf"you can redistribute it and or modify it under the terms of the gnu {_GPL} .{{0,80}}version 2"),
    ("gpl-1", 1.0, rf"you can redistribute it and or modify it under the terms of the gnu {_GPL} .{{0,80}}version 1"),
    ("gpl-2", 0.9, rf"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", 0.9, rf"the gnu {_GPL} is a free copyleft license for software and other kinds of works"),
    ("gpl", 0.9, rf"you should have received a copy of the gnu (?:lesser |affero |library )?{_GPL}"),
    ("gpl", 0.8, r"this (?:program|library|file) is free software"),
    ("gfdl", 0.95, rf"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {_L}"),
    ("mpl-2", 1.0, rf"this source code form is subject to the terms of the mozilla public {_L}"),
    ("mpl-2", 0.9, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 1.0, rf"the contents of this file are subject to the mozilla public {_L} version 1 1"),
    ("epl-1", 1.0, rf"this program and the accompanying materials are made available under the terms of the eclipse public {_L} v1"),
    ("epl-2", 1.0, rf"this program and the accompanying materials are made available under the terms of the eclipse public {_L} 2"),
    ("edl-1", 1.0, rf"made available under the terms of the eclipse distribution {_L}"),
    ("cddl-1", 1.0, rf"the contents of this file are subject to the terms of the common development and distribution {_L}"),
    ("cpl-1", 1.0, rf"the accompanying program is provided under the terms of this common public {_L}"),
    ("cc0", 1.0, r"waived all copyright and related or neighboring rights"),
    ("cc0", 0.95, r"to the extent possible under law .{1,120} has waived all copyright"),
    ("cc-by-4", 0.9, r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution"),
    ("unlicense", 1.0, r"free and unencumbered software released into the public domain"),
    ("unlicense", 0.9, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 1.0, r"you just do what the fuck you want to"),
    ("wtfpl", 0.9, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("zlib", 1.0, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 0.9, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", 1.0, r"the png reference library is supplied as is"),
    ("boost-1", 1.0, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.1", 1.0, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl-1", 1.0, r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", 1.0, r"you may not provide the software to third parties as a hosted or managed service"),
    ("artistic-1", 0.9, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", 0.9, r"this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("python-2", 1.0, rf"python software foundation {_L} version 2"),
    ("python-2", 0.9, r"this license agreement is between the python software foundation"),
    ("php-3", 1.0, r"this product includes php software freely available from"),
    ("php-3", 0.95, r"products derived from this software may not be called php"),
    ("ruby", 0.9, r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("openssl", 1.0, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 0.95, r"this product includes cryptographic software written by eric young"),
    ("ofl-1.1", 1.0, rf"this font software is licensed under the sil open font {_L}"),
    ("ofl-1.1", 0.9, r"the font software may be sold as part of a larger software package"),
    ("odbl-1", 1.0, rf"this .{{1,60}} is made available under the open database {_L}"),
    ("pddl-1", 1.0, rf"the open data commons public domain dedication and {_L}"),
    ("ms-pl", 0.95, rf"this license governs use of the accompanying software if you use the software you accept this {_L}"),
    ("ncsa", 1.0, r"permission is hereby granted free of charge .{0,120}to deal with the software without restriction"),
    ("upl-1", 1.0, rf"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software"),
    ("afl-3", 1.0, rf"licensed under the academic free {_L}{_V}3 0"),
    ("osl-3", 1.0, rf"licensed under the open software {_L}{_V}3 0"),
    ("vim", 1.0, r"there are no restrictions on distributing unmodified copies of vim"),
    ("beerware", 1.0, r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("postgresql", 1.0, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("tcl", 0.95, r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("json", 1.0, r"the software shall be used for good not evil"),
    ("curl", 0.9, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above"),
    ("hpnd", 0.9, r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("unicode", 1.0, r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ijg", 1.0, r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", 1.0, r"portions of this software are copyright .{1,40} the freetype project"),
    ("openrail", 1.0, r"use based restrictions .{0,60}you agree not to use the model or derivatives of the model"),
    ("llama", 1.0, rf"llama \d(?: \d)? is licensed under the llama \d(?: \d)? community {_L}"),
    ("llama", 0.9, r"greater than 700 million monthly active users in the preceding calendar month"),
    ("gemma", 1.0, r"gemma is provided under and subject to the gemma terms of use"),
    ("mulan-2", 1.0, r"you can use this software according to the terms and conditions of the mulan psl"),
    # exceptions to other licenses
    ("gpl-classpath-exception", 1.0, r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-classpath-exception", 0.95, r"with (?:the )?classpath exception"),
    ("gpl-gcc-exception", 1.0, r"gcc runtime library exception"),
    ("gpl-bison-exception", 1.0, r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-font-exception", 1.0, r"as a special exception if you create a document which uses this font"),
    ("gpl-openssl-exception", 1.0, r"as a special exception .{0,80}permission to link .{0,60}with the openssl library"),
    ("gpl-autoconf-exception", 1.0, r"as a special exception .{0,60}configuration script generated by autoconf"),
    ("apache-llvm-exception", 1.0, r"apache(?: license)?(?: version| v)? ?v?2 0 with llvm exceptions?"),
    ("lgpl-linking-exception", 1.0, r"linking .{0,60}statically or dynamically with other modules is making a combined work"),
    # addresses
    ("apache-2", 1.0, r"apache org licenses license 2 0"),
    ("apache-1.1", 1.0, r"apache org licenses license 1 1"),
    ("mit", 1.0, r"opensource org licenses mit"),
    ("isc", 1.0, r"opensource org licenses isc"),
    ("bsd-3-clause", 1.0, r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 1.0, r"opensource org licenses bsd 2 clause"),
    ("artistic-2", 1.0, r"opensource org licenses artistic license 2"),
    ("mpl-2", 1.0, r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", 1.0, r"mozilla org (?:en us )?mpl (?:1 1|mpl 1 1)"),
    ("epl-1", 1.0, r"eclipse org legal epl v10"),
    ("epl-2", 1.0, r"eclipse org legal epl 2 0"),
    ("edl-1", 1.0, r"eclipse org org documents edl v10"),
    ("agpl-3", 1.0, r"gnu org licenses agpl"),
    ("lgpl-3", 0.9, r"gnu org licenses lgpl(?: 3)?"),
    ("gpl-2", 1.0, r"gnu org licenses (?:old licenses )?gpl 2"),
    ("gpl-3", 1.0, r"gnu org licenses gpl 3"),
    ("gfdl", 1.0, r"gnu org (?:licenses|copyleft) fdl"),
    ("gpl", 0.7, r"gnu org licenses"),
    ("boost-1", 1.0, r"boost org license 1 0"),
    ("unlicense", 1.0, r"unlicense org"),
    ("wtfpl", 1.0, r"wtfpl net"),
    ("ofl-1.1", 1.0, r"scripts sil org ofl"),
    ("odbl-1", 1.0, r"opendatacommons org licenses odbl"),
    ("pddl-1", 1.0, r"opendatacommons org licenses pddl"),
    ("odc-by-1", 1.0, r"opendatacommons org licenses by"),
    ("cdla-permissive", 1.0, r"cdla (?:dev|io) permissive"),
    ("cdla-sharing", 1.0, r"cdla (?:dev|io) sharing"),
    ("eupl-1.2", 1.0, r"joinup ec europa eu .{0,60}eupl"),
    ("php-3", 1.0, r"php net license 3 0"),
    ("python-2", 1.0, r"docs python org .{0,12}license"),
    ("elastic-2", 1.0, r"elastic co licensing elastic license"),
    ("sspl-1", 1.0, r"mongodb com licensing server side public license"),
    ("mulan-2", 1.0, r"license coscl org cn mulanpsl2"),
    ("cc-by-nc-sa", 1.0, r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", 1.0, r"creativecommons org licenses by nc nd"),
    ("cc-by-nc", 0.95, r"creativecommons org licenses by nc"),
    ("cc-by-sa", 1.0, r"creativecommons org licenses by sa"),
    ("cc-by-nd", 1.0, r"creativecommons org licenses by nd"),
    ("cc-by", 0.95, r"creativecommons org licenses by"),
    ("cc0", 1.0, r"creativecommons org publicdomain zero"),
    ("public-domain", 1.0, r"creativecommons org publicdomain mark"),
    # names in a grant; the longer names first
    ("mit-0", 0.95, _UNDER + r"mit (?:0|no attribution)"),
    ("x11", 0.95, _UNDER + r"(?:mit )?x(?:11| consortium)"),
    ("apache-2", 0.95, _UNDER + r"asl 2 0"),
    ("boost-1", 0.9, _UNDER + r"bsl 1 0"),
    ("bsl-1.1", 0.9, _UNDER + r"bsl 1 1"),
    ("python-2", 0.9, _UNDER + r"psf(?: licen[sc]e)?(?: 2)?"),
    ("isc", 0.95, _UNDER + r"(?:isc|internet systems consortium)(?: licen[sc]e)?"),
    ("mit", 0.95, _UNDER + r"(?:mit|expat)(?: x11| expat)?(?: licen[sc]e)?"),
    ("bsd-2-clause", 0.95, _UNDER + r"(?:simplified|2 clause|two clause) bsd"),
    ("bsd-3-clause", 0.95, _UNDER + r"(?:new|modified|revised|3 clause|three clause) bsd"),
    ("bsd-4-clause", 0.95, _UNDER + r"(?:original|old|4 clause|four clause) bsd"),
    ("bsd", 0.9, _UNDER + r"bsd(?: style)?(?: licen[sc]e)?"),
    ("apache-2", 0.95, _UNDER + rf"apache(?: software)?(?: {_L})?{_V}2(?: 0)?"),
    ("apache", 0.9, _UNDER + rf"apache(?: software)?(?: {_L})?"),
    ("agpl-3", 0.95, _UNDER + r"(?:gnu )?agpl(?: ?v?3)?(?: 0)?"),
    ("lgpl-2.1", 0.95, _UNDER + r"(?:gnu )?lgpl(?: version)? ?v?2 1"),
    ("lgpl-3", 0.95, _UNDER + r"(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?"),
    ("lgpl", 0.9, _UNDER + r"(?:gnu )?lgpl"),
    ("gpl-2", 0.95, _UNDER + r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3", 0.95, _UNDER + r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl", 0.9, _UNDER + r"(?:gnu )?gpl"),
    ("mpl-2", 0.95, _UNDER + r"mpl(?: version)? ?v?2(?: 0)?"),
    ("epl-2", 0.95, _UNDER + r"epl(?: version)? ?v?2(?: 0)?"),
    ("proprietary", 0.9, _UNDER + r"(?:a )?proprietary(?: licen[sc]e)?"),
    ("commercial", 0.9, _UNDER + r"(?:a )?commercial(?: licen[sc]e)?"),
    # full names, with versions first
    ("agpl-3-only", 0.95, rf"gnu affero {_GPL}{_V}3(?: 0)? only"),
    ("agpl-3", 0.95, rf"gnu affero {_GPL}(?:{_V}3(?: 0)?)?"),
    ("agpl-1", 0.9, rf"(?:gnu )?affero {_GPL}{_V}1(?: 0)?"),
    ("agpl-3", 0.9, rf"(?:gnu )?affero {_GPL}"),
    ("lgpl-2.1", 0.95, rf"(?:gnu )?lesser {_GPL}{_V}2 1"),
    ("lgpl-3", 0.95, rf"(?:gnu )?lesser {_GPL}{_V}3(?: 0)?"),
    ("lgpl-2", 0.95, rf"(?:gnu )?(?:lesser|library) {_GPL}{_V}2(?: 0)?"),
    ("lgpl", 0.9, rf"(?:gnu )?(?:lesser|library) {_GPL}"),
    ("gpl-3-or-later", 0.95, rf"gnu {_GPL}{_V}3(?: 0)? or(?: \(?at your option\)?)?(?: any)? later"),
    ("gpl-2-or-later", 0.95, rf"gnu {_GPL}{_V}2(?: 0)? or(?: \(?at your option\)?)?(?: any)? later"),
    ("gpl-3", 0.95, rf"(?:gnu )?{_GPL}{_V}3(?: 0)?"),
    ("gpl-2", 0.95, rf"(?:gnu )?{_GPL}{_V}2(?: 0)?"),
    ("gpl-1", 0.95, rf"(?:gnu )?{_GPL}{_V}1(?: 0)?"),
    ("gpl", 0.8, rf"gnu {_GPL}"),
    ("gfdl-1.3", 0.95, rf"(?:gnu )?free documentation {_L}{_V}1 3"),
    ("gfdl", 0.9, rf"gnu free documentation {_L}"),
    ("apache-2", 0.9, rf"apache(?: software)? {_L}{_V}2(?: 0)?"),
    ("apache-1.1", 0.95, rf"apache(?: software)? {_L}{_V}1 1"),
    ("apache-1", 0.95, rf"apache(?: software)? {_L}{_V}1(?: 0)?"),
    ("apache", 0.7, rf"apache(?: software)? {_L}"),
    ("mpl-1.1", 0.95, rf"mozilla public {_L}{_V}1 1"),
    ("mpl-2", 0.95, rf"mozilla public {_L}{_V}2(?: 0)?"),
    ("mpl", 0.8, rf"mozilla public {_L}"),
    ("epl-1", 0.95, rf"eclipse public {_L}{_V}1(?: 0)?"),
    ("epl-2", 0.95, rf"eclipse public {_L}{_V}2(?: 0)?"),
    ("epl", 0.8, rf"eclipse public {_L}"),
    ("edl-1", 0.8, rf"eclipse distribution {_L}"),
    ("cddl-1", 0.9, rf"common development and distribution {_L}"),
    ("cpl-1", 0.9, rf"common public {_L}{_V}1(?: 0)?"),
    ("cc0", 0.95, r"creative commons (?:zero|cc0)"),
    ("public-domain", 0.8, r"creative commons public domain"),
    ("cc-by-nc-nd", 0.95, r"(?:creative commons )?attribution non ?commercial no ?deriv(?:s|ative|atives)"),
    ("cc-by-nc-sa", 0.95, r"(?:creative commons )?attribution non ?commercial share ?alike"),
    ("cc-by-nc", 0.9, r"creative commons attribution non ?commercial"),
    ("cc-by-nd", 0.9, r"creative commons attribution no ?deriv(?:s|ative|atives)"),
    ("cc-by-sa", 0.9, r"creative commons attribution share ?alike"),
    ("cc-by", 0.9, r"creative commons attribution"),
    ("cc-by-nc-nd", 0.95, r"cc by nc nd(?: \d 0)?"),
    ("cc-by-nc-sa", 0.95, r"cc by nc sa(?: \d 0)?"),
    ("cc-by-nc", 0.9, r"cc by nc(?: \d 0)?"),
    ("cc-by-sa", 0.9, r"cc by sa(?: \d 0)?"),
    ("cc-by-nd", 0.9, r"cc by nd(?: \d 0)?"),
    ("cc-by", 0.8, r"cc by \d 0"),
    ("cc", 0.6, rf"creative commons {_L}"),
    ("wtfpl", 0.9, r"do what the fuck you want to public"),
    ("zlib", 0.8, rf"zlib(?: libpng)? {_L}"),
    ("boost-1", 0.9, rf"boost software {_L}"),
    ("bsl-1.1", 0.9, rf"business source {_L}"),
    ("sspl-1", 0.9, rf"server side public {_L}"),
    ("elastic-2", 0.9, rf"elastic {_L}(?:{_V}2(?: 0)?)?"),
    ("artistic-1", 0.9, rf"artistic {_L}{_V}1(?: 0)?"),
    ("artistic-2", 0.9, rf"artistic {_L}{_V}2(?: 0)?"),
    ("artistic", 0.8, rf"artistic {_L}"),
    ("python-2", 0.9, rf"python software foundation {_L}"),
    ("php-3", 0.9, rf"php {_L}{_V}3 0"),
    ("openssl", 0.8, rf"openssl(?: ssleay)? {_L}"),
    ("ofl-1.1", 0.9, rf"open font {_L}"),
    ("odbl-1", 0.9, rf"open database {_L}"),
    ("odc-by-1", 0.9, rf"open data commons attribution {_L}"),
    ("pddl-1", 0.9, rf"public domain dedication and {_L}"),
    ("cdla-permissive", 0.9, rf"community data {_L} agreement permissive"),
    ("cdla-sharing", 0.9, rf"community data {_L} agreement sharing"),
    ("eupl-1.2", 0.9, rf"european union public {_L}"),
    ("ms-pl", 0.9, rf"microsoft public {_L}"),
    ("ms-rl", 0.9, rf"microsoft reciprocal {_L}"),
    ("ncsa", 0.9, rf"university of illinois(?: ncsa)? open source {_L}"),
    ("upl-1", 0.9, rf"universal permissive {_L}"),
    ("afl-3", 0.9, rf"academic free {_L}"),
    ("osl-3", 0.9, rf"open software {_L}"),
    ("openrail", 0.9, rf"(?:creativeml|bigscience) open ?rail"),
    ("llama", 0.9, rf"llama \d(?: \d)? community {_L}"),
    ("mulan-2", 0.9, rf"mulan (?:permissive software|psl)"),
    ("postgresql", 0.8, rf"postgresql {_L}"),
    ("isc", 0.8, rf"isc {_L}"),
    ("bsd-2-clause", 0.8, r"bsd (?:2|two) clause"),
    ("bsd-3-clause", 0.8, r"bsd (?:3|three) clause"),
    ("bsd-4-clause", 0.8, r"bsd (?:4|four) clause"),
    ("0bsd", 0.8, r"(?:zero|0) clause bsd"),
    ("bsd", 0.7, rf"bsd(?: style)? {_L}"),
    ("x11", 0.8, rf"(?:mit )?x(?:11| consortium) {_L}"),
    ("mit", 0.7, rf"mit(?: x11| expat)? {_L}"),
    # what isn't a license, or none that is free
    ("public-domain", 0.9, r"(?:released|placed|dedicated) (?:in|into|to)(?: the)? public domain"),
    ("all-rights-reserved", 0.6, r"all rights reserved"),
    ("no-license", 0.8, r"may not be (?:reproduced|copied|redistributed) .{0,60}without(?: the)?(?: prior| express| written)* permission"),
    ("no-license", 0.8, r"unauthori[sz]ed (?:copying|reproduction|distribution) of this"),
    ("confidential", 0.7, r"proprietary and confidential"),
    ("non-commercial", 0.5, r"non ?commercial (?:use|purposes|research)"),
    ("evaluation-only", 0.7, r"for evaluation purposes only"),
    ("internal-use", 0.7, r"for internal use only"),
)
#: Identifiers that a tag "spdx license identifier" names; their words, and so their labels.
IDENTIFIERS = (
    "mit 0", "mit", "x11", "isc", "0bsd", "bsd 1 clause", "bsd 2 clause patent", "bsd 2 clause", "bsd 3 clause clear", "bsd 3 clause", "bsd 4 clause",
    "apache 1 0", "apache 1 1", "apache 2 0", "agpl 3 0 only", "agpl 3 0 or later", "agpl 3 0", "lgpl 2 0 only", "lgpl 2 0 or later", "lgpl 2 1 only",
    "lgpl 2 1 or later", "lgpl 2 1", "lgpl 3 0 only", "lgpl 3 0 or later", "lgpl 3 0", "gpl 1 0 only", "gpl 1 0 or later", "gpl 2 0 only",
    "gpl 2 0 or later", "gpl 2 0", "gpl 3 0 only", "gpl 3 0 or later", "gpl 3 0", "gfdl 1 3", "mpl 1 1", "mpl 2 0", "epl 1 0", "epl 2 0", "cddl 1 0",
    "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0", "unlicense", "wtfpl", "zlib", "libpng 2 0", "bsl 1 0",
    "busl 1 1", "sspl 1 0", "elastic 2 0", "artistic 1 0", "artistic 2 0", "python 2 0", "psf 2 0", "php 3 01", "ruby", "openssl", "ofl 1 1", "odbl 1 0",
    "pddl 1 0", "cdla permissive 2 0", "eupl 1 2", "ms pl", "ms rl", "ncsa", "upl 1 0", "afl 3 0", "osl 3 0", "vim", "postgresql", "mulanpsl 2 0",
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keywords: tuple[frozenset, ...]
    pattern: re.Pattern
    score: float


def _clauses(tree) -> list[frozenset]:
    """Sets of strings, of each of which one occurs in whatever the parsed pattern matches."""
    found, run = [], ""
    for op, value in [*tree, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is _constants.SUBPATTERN:
            found += _clauses(value[3])
        elif op is _constants.MAX_REPEAT and value[0] > 0:
            found += _clauses(value[2])
        elif op is _constants.BRANCH:
            each = [_best(_clauses(b)) for b in value[1]]
            if all(each):
                found.append(frozenset().union(*each))
    return found


def _best(clauses: list[frozenset]) -> frozenset:
    """The clause whose shortest string is longest; empty if there is none."""
    return max(clauses, key=lambda c: (min(map(len, c)), -len(c)), default=frozenset())


def needed(pattern: str) -> tuple[frozenset, ...]:
    """One or two sets of strings, of each of which one occurs in every match of the pattern."""
    found = sorted(set(_clauses(_parser.parse(pattern))), key=lambda c: (-min(map(len, c)), len(c), sorted(c)))
    if not found or min(map(len, found[0])) < 4:
        raise ValueError(f"too little is needed by {pattern}")
    return tuple(c for c in found[:2] if min(map(len, c)) > 2)


#: Identifiers whose licenses go by another label in what is written out above.
_OTHER_NAMES = {
    "busl-1.1": "bsl-1.1", "bsl-1": "boost-1", "cc0-1": "cc0", "php-3.01": "php-3", "psf-2": "python-2", "cdla-permissive-2": "cdla-permissive", "mulanpsl-2": "mulan-2", "libpng-2": "libpng",
    "cc-by-sa-4": "cc-by-sa", "cc-by-nc-4": "cc-by-nc", "cc-by-nc-sa-4": "cc-by-nc-sa", "cc-by-nc-nd-4": "cc-by-nc-nd",
}


def label_of(identifier: str) -> str:
    """An identifier's label, the same as that of its name: without ``only``, with the version as it is written there."""
    label = re.sub(r" only$", "", identifier)
    label = re.sub(r" (\d+) 0(?= |$)", r" \1", label)
    label = re.sub(r" (\d+) (\d+)(?= |$)", r" \1.\2", label).replace(" ", "-")
    return _OTHER_NAMES.get(label, label)


def make_rules() -> list[Rule]:
    """All rules in order of priority: tags, with the longer identifiers first, then what is written out above."""
    tags = [(label_of(i), 1.0, f"spdx license identifier {i}") for i in sorted(IDENTIFIERS, key=lambda i: (-len(i), i))]
    return [Rule(f"{label}:{i}", label, needed(p), re.compile(f" {p}(?= )"), score) for i, (label, score, p) in enumerate((*tags, *WRITTEN))]


class Sweep:
    """Intervals of which none lies inside another; both ends ascend."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        """Whether a new interval lies in none that is held; then it is held, and those inside it aren't any more."""
        at = bisect.bisect_right(self.starts, a)
        if at and self.ends[at - 1] >= b:
            return False
        first = at - (at > 0 and self.starts[at - 1] == a)
        last = bisect.bisect_right(self.ends, b, first)
        self.starts[first:last], self.ends[first:last] = [a], [b]
        return True


class Scanner:
    def __init__(self, rules: list[Rule] | None = None, base=BASE):
        import ahocorasick

        self.rules, self.base = rules or make_rules(), [(label, f" {p} ".encode(), len(p.split())) for label, p in base]
        self.gate = ahocorasick.Automaton()
        for key in frozenset().union(*[c for r in self.rules for c in r.keywords]):
            self.gate.add_word(key, key)
        self.gate.make_automaton()

    def scan(self, text: str) -> dict:
        words = text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()
        line = b" " + b" ".join(words) + b" "
        base, detections = [], []
        places = [(label, n, m.start()) for label, phrase, n in self.base for m in re.finditer(b"(?=" + re.escape(phrase) + b")", line)]
        if places:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            base = [(label, start, start + n) for (label, n, _), start in zip(places, np.searchsorted(spaces, [p[2] for p in places]).tolist(), strict=True)]
        spaced = line.decode("utf-8", "surrogatepass")
        hit = {key for _, key in self.gate.iter(spaced)}
        spans = [(rank, m.start(), m.end()) for rank, rule in enumerate(self.rules) if not any(c.isdisjoint(hit) for c in rule.keywords) for m in rule.pattern.finditer(spaced)] if hit else []
        if spans:
            sweep = Sweep()
            kept = [s for s in sorted(spans, key=lambda s: (s[0], s[1], -s[2])) if sweep.add(s[1], s[2])]
            kept.sort(key=lambda s: s[1:])
            spaces = np.flatnonzero(np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            start, end = (np.searchsorted(spaces, [s[i] for s in kept]).tolist() for i in (1, 2))
            detections = [(self.rules[r].label, self.rules[r].name, a, b, self.rules[r].score) for (r, _, _), a, b in zip(kept, start, end, strict=True)]
        missed = 0.0 if base else 1.0
        for d in detections:
            missed *= 1 - d[4]
        return {"n_words": len(words), "base": base, "detections": detections, "score": 1 - missed}


_BASE_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])
_FOUND = pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())])
SCANNED = "doc_id bigint, n_words bigint, base array<struct<label: string, first_word: bigint, end_word: bigint>>, detections array<struct<label: string, rule: string, first_word: bigint, end_word: bigint, score: double>>, score double"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: its words, the places of base phrases, and the detections that stay, by word."""

    def run(batches):
        scanner = Scanner()
        for batch in common.slices(batches):
            found = [scanner.scan(t) for t in bpe.texts_of(batch).to_pylist()]
            base = [[dict(zip(("label", "first_word", "end_word"), b, strict=True)) for b in f["base"]] for f in found]
            more = [[dict(zip(("label", "rule", "first_word", "end_word", "score"), d, strict=True)) for d in f["detections"]] for f in found]
            arrays = [batch.column("doc_id"), pa.array([f["n_words"] for f in found], pa.int64()), pa.array(base, pa.list_(_BASE_SPAN)), pa.array(more, pa.list_(_FOUND)), pa.array([f["score"] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "base", "detections", "score"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, SCANNED)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("base", lambda b: b["first_word"])
    base = F.transform("base", lambda b: b["label"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"), "score",
    )
