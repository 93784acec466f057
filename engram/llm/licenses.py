r"""License scans: ordered signature rules behind a keyword prefilter; priority and containment settle overlaps.

Texts are compared as words: ASCII letters in lower case, digits and all characters beyond ASCII; the rest separates.
Words are joined by single blanks, so that rules don't depend on line breaks, marks or quotes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Bytes that are part of a word: digits, a-z and all bytes of characters beyond ASCII.
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
SEPARATE = bytes(b if b in _WORD else 0x20 for b in range(256))

#: Phrases and the labels they give.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: What kinds of rules there are: priority, and weight in the score. A text grants or states a licence, a notice refers to
#: one, an address points to one, an edition is a name with a version, a name stands alone.
KINDS = {"text": (90, 1.0), "notice": (80, 0.95), "tag": (70, 1.0), "address": (60, 0.9), "edition": (50, 0.8), "name": (20, 0.5)}

#: Hand-written rules by label: kind, keyword that stands at the start of a word in all that matches, pattern over words.
RULES = {
    "gpl": r"""
        text    | free software     | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        text    | free software     | is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
        text    | the gnu general   | the gnu general public license is (?:a free copyleft license for software|intended to guarantee your freedom to share and change)
        text    | the licenses for  | the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change
        notice  | general public    | under the terms of (?:the )?(?:gnu )?general public licen[cs]e(?: version [123])?
        notice  | general public    | see the gnu general public license for more details
        notice  | general public    | you should have received a copy of the gnu general public license
        notice  | general public    | (?:licensed|released|distributed|available|published) under the (?:gnu )?general public licen[cs]e
        notice  | gpl               | (?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?gpl
        notice  | gpl               | (?:dual|multi) licensed under (?:the )?(?:gnu )?gpl
        notice  | module license gpl | module license gpl(?: v2)?
        address | www gnu org       | www gnu org (?:copyleft|licenses|licences) gpl(?: \d(?: 0)?)?(?: en)?(?: html| txt)
        address | gnu org           | gnu org (?:licenses|copyleft) (?:old licenses )?gpl(?: \d(?: 0)?)?
        address | opensource org    | opensource org (?:licenses|license) gpl(?: \d 0| license)?
        edition | general public    | (?:gnu )?general public licen[cs]e (?:v|version )?[123](?: 0)?(?: or (?:any )?later(?: version)?)?
        edition | general public    | version [123] of the (?:gnu )?general public licen[cs]e
        edition | gpl               | (?:gnu )?gpl (?:v|version )?[123](?: 0)?(?: only| or later| or any later version| plus)?
        edition | gplv              | gplv[123](?: 0)?(?: only| or later| plus)?
        edition | gnu gplv          | gnu gplv[123]
        name    | gpl               | gpl licen[cs]ed?
        name    | gnu gpl           | gnu gpl
        name    | general public    | (?:gnu )?general public licen[cs]e
    """,
    "lgpl": r"""
        text    | free software     | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
        text    | lesser general    | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
        notice  | lesser general    | under the terms of (?:the )?(?:gnu )?lesser general public licen[cs]e
        notice  | library general   | under the terms of (?:the )?(?:gnu )?library general public licen[cs]e
        notice  | lesser general    | you should have received a copy of the gnu lesser general public license
        notice  | lgpl              | (?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?lgpl
        address | gnu org           | gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: \d(?: \d)?)?
        address | opensource org    | opensource org (?:licenses|license) lgpl(?: \d \d| license)?
        edition | lesser general    | (?:gnu )?lesser general public licen[cs]e (?:v|version )?(?:2 1|3 0|3)(?: or (?:any )?later(?: version)?)?
        edition | library general   | (?:gnu )?library general public licen[cs]e (?:v|version )?2(?: 0)?
        edition | lgpl              | (?:gnu )?lgpl (?:v|version )?(?:2 1|2 0|3 0|2|3)(?: or later| only| plus)?
        edition | lgplv             | lgplv(?:2 1|2 0|3 0|2|3)(?: or later| only| plus)?
        name    | lgpl              | lgpl
        name    | lesser general    | (?:gnu )?lesser general public licen[cs]e
        name    | library general   | (?:gnu )?library general public licen[cs]e
    """,
    "agpl": r"""
        text    | affero general    | the gnu affero general public license is a free copyleft license for software and other kinds of works
        text    | affero general    | it under the terms of the gnu affero general public license as published by the free software foundation
        notice  | affero general    | you should have received a copy of the gnu affero general public license
        notice  | agpl              | (?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?agpl
        address | gnu org           | gnu org licenses agpl(?: 3 0)?
        address | opensource org    | opensource org licenses agpl(?: 3 0| v3)?
        edition | affero general    | (?:gnu )?affero general public licen[cs]e (?:v|version )?(?:1|3)(?: 0)?(?: or (?:any )?later(?: version)?)?
        edition | agpl              | (?:gnu )?agpl (?:v|version )?(?:1|3)(?: 0)?(?: or later| only)?
        edition | agplv             | agplv(?:1|3)
        name    | agpl              | agpl
        name    | affero            | (?:gnu )?affero general public licen[cs]e
    """,
    "gfdl": r"""
        text    | permission is granted to copy | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
        address | gnu org           | gnu org (?:licenses|copyleft) fdl(?: 1 [123])?
        edition | free documentation | (?:gnu )?free documentation licen[cs]e (?:v|version )?1 [123](?: or (?:any )?later(?: version)?)?
        edition | gfdl              | gfdl (?:v|version )?1 [123]
        name    | free documentation | (?:gnu )?free documentation licen[cs]e
        name    | gfdl              | gfdl
    """,
    "apache": r"""
        text    | apache            | licensed under the apache license version 2 0
        text    | apache license version 2 0 january | apache license version 2 0 january 2004
        text    | unless required by | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        text    | this product includes software developed by the apache | this product includes software developed by the apache (?:software foundation|group)
        text    | subject to the terms and conditions of this license each | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide
        notice  | you may not use this file | you may not use this file except in compliance with the license
        notice  | apache            | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: license| 2 0)
        notice  | licensed to the apache | licensed to the apache software foundation asf under one or more contributor license agreements
        address | www apache org    | www apache org licenses license (?:2 0|1 1|1 0)
        address | apache org        | apache org licenses(?: license 2 0)?
        address | opensource org    | opensource org licenses apache(?: 2 0|2 0 php| license 2 0)?
        edition | apache            | apache(?: software)? licen[cs]e (?:v|version )?(?:1 0|1 1|2 0|2)
        edition | apache            | apache (?:v|version )?2 0
        edition | apache 2          | apache 2 licen[cs]e
        edition | asl 2             | asl 2(?: 0)?
        edition | al2               | al2 0
        name    | apache            | apache(?: software)? licen[cs]e
    """,
    "mit": r"""
        text    | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        text    | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
        text    | the above copyright notice and this | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        text    | the software is provided as | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        text    | except as contained | except as contained in this notice the name of the x consortium shall not be used in advertising
        notice  | mit               | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[cs]e)?
        notice  | use of this source code is governed by an mit | use of this source code is governed by an mit style license
        notice  | see license for the mit | see license for the mit licen[cs]e
        address | opensource org    | (?:www )?opensource org licenses mit(?: license)?(?: php)?
        address | mit license org   | mit license org
        address | choosealicense com | choosealicense com licenses mit
        edition | mit x11           | mit x11 licen[cs]e
        edition | mit no attribution | mit no attribution(?: licen[cs]e)?
        name    | mit               | mit licen[cs]ed?
        name    | mit style         | mit style licen[cs]e
        name    | x11 licen         | x11 licen[cs]e
        name    | expat             | expat licen[cs]e
    """,
    "bsd": r"""
        text    | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        text    | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
        text    | redistributions of source code | redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer
        text    | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
        text    | neither the name  | neither the name of .{1,80}? nor the names of (?:its|their|any|other) contributors
        text    | this software is provided by | this software is provided by (?:the )?.{1,80}? as is and any express or implied warranties
        text    | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
        notice  | use of this source code is governed by a bsd | use of this source code is governed by a bsd style license(?: that can be found in the license file)?
        notice  | bsd               | (?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the )?(?:new |modified |simplified )?bsd(?: [234] clause)?(?: licen[cs]e)?
        address | opensource org    | (?:www )?opensource org licenses bsd (?:[23] clause|license)(?: php)?
        edition | bsd               | bsd [01234] clause(?: licen[cs]e)?
        edition | 2 clause bsd      | 2 clause bsd(?: licen[cs]e)?
        edition | 3 clause bsd      | 3 clause bsd(?: licen[cs]e)?
        edition | new bsd           | new bsd(?: licen[cs]e)
        edition | modified bsd      | modified bsd(?: licen[cs]e)
        edition | simplified bsd    | simplified bsd(?: licen[cs]e)
        edition | freebsd licen     | freebsd licen[cs]e
        name    | bsd               | bsd(?: style| type)? licen[cs]ed?
        name    | berkeley software | berkeley software distribution licen[cs]e
    """,
    "isc": r"""
        text    | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        text    | permission to use copy | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
        notice  | isc               | (?:licensed|released|distributed|available) under (?:the )?isc(?: licen[cs]e)?
        address | opensource org    | opensource org licenses isc(?: license)?
        name    | isc licen         | isc licen[cs]e
        name    | internet systems consortium licen | internet systems consortium licen[cs]e
    """,
    "mpl": r"""
        text    | this source code form | this source code form is subject to the terms of the mozilla public license(?: v 2 0| version 2 0)?
        text    | the contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1
        text    | if a copy of the mpl | if a copy of the mpl was not distributed with this file you can obtain one at
        notice  | mozilla public    | (?:licensed|released|distributed|available) under (?:the )?mozilla public licen[cs]e
        address | mozilla org mpl   | mozilla org mpl(?: 2 0| mpl 1 1)?
        address | www mozilla org mpl | www mozilla org mpl
        edition | mozilla public    | mozilla public licen[cs]e (?:v |v|version )?(?:1 0|1 1|2 0)
        edition | mpl               | mpl (?:v |v|version )?(?:1 0|1 1|2 0)
        edition | mplv              | mplv(?:1 0|1 1|2 0|2)
        name    | mozilla public    | mozilla public licen[cs]e
    """,
    "epl": r"""
        text    | the accompanying program is provided | the accompanying program is provided under the terms of this eclipse public license
        text    | this program and the accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license
        address | www eclipse org   | www eclipse org (?:legal )?(?:epl v10|epl v20|epl 2 0)
        address | eclipse org legal | eclipse org legal epl (?:v10|v20|2 0)
        edition | eclipse public    | eclipse public licen[cs]e (?:v |v|version )?(?:1 0|2 0)
        edition | epl               | epl (?:v|version )?(?:1 0|2 0)
        name    | eclipse public    | eclipse public licen[cs]e
    """,
    "edl": r"""
        edition | eclipse distribution | eclipse distribution licen[cs]e (?:v|version )?1 0
        name    | eclipse distribution | eclipse distribution licen[cs]e
    """,
    "cddl": r"""
        text    | the contents of this file are subject to the terms of the common | the contents of this file are subject to the terms of the common development and distribution license
        edition | common development | common development and distribution licen[cs]e (?:v|version )?1 [01]
        edition | cddl              | cddl (?:v|version )?1 [01]
        name    | common development | common development and distribution licen[cs]e
        name    | cddl              | cddl
    """,
    "cpl": r"""
        text    | the accompanying program is provided | the accompanying program is provided under the terms of this common public license
        edition | common public     | common public licen[cs]e (?:v|version )?1 0
        name    | common public     | common public licen[cs]e
    """,
    "artistic": r"""
        text    | the intent of this document | the intent of this document is to state the conditions under which a package may be copied
        notice  | same terms as perl | same terms as perl itself
        notice  | artistic          | under the terms of (?:either )?(?:the )?artistic licen[cs]e
        edition | artistic          | artistic licen[cs]e (?:v|version )?[12] 0
        name    | artistic          | artistic licen[cs]e
    """,
    "zlib": r"""
        text    | this software is provided as | this software is provided as is without any express or implied warranty in no event will the authors be held liable
        text    | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        text    | the origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
        address | opensource org    | opensource org licenses zlib(?: license)?
        edition | zlib libpng       | zlib libpng licen[cs]e
        name    | zlib              | zlib licen[cs]e
        name    | libpng licen      | libpng licen[cs]e
    """,
    "boost": r"""
        text    | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
        notice  | boost             | distributed under the boost software licen[cs]e
        address | www boost org     | www boost org license 1 0 txt
        edition | boost software    | boost software licen[cs]e (?:v|version )?1 0
        name    | boost             | boost(?: software)? licen[cs]e
    """,
    "bsl": r"""
        text    | the licensor hereby grants you | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
        edition | business source   | business source licen[cs]e (?:v|version )?1 [01]
        name    | business source   | business source licen[cs]e
    """,
    "unlicense": r"""
        text    | this is free and unencumbered | this is free and unencumbered software released into the public domain
        text    | anyone is free to copy modify | anyone is free to copy modify publish use compile sell or distribute this software
        address | unlicense org     | unlicense org
        name    | the unlicense     | the unlicense
    """,
    "wtfpl": r"""
        text    | do what the       | do what the f..k you want to public licen[cs]e
        text    | you just do what  | you just do what the f..k you want to
        address | www wtfpl net     | www wtfpl net
        edition | wtfpl             | wtfpl (?:v|version )?[12]
        name    | wtfpl             | wtfpl
    """,
    "python": r"""
        text    | psf is making     | psf is making python available to licensee on an as is basis
        text    | subject to the terms and conditions of this license agreement psf | subject to the terms and conditions of this license agreement psf hereby grants licensee a nonexclusive royalty free
        edition | python software   | python software foundation licen[cs]e (?:v|version )?2(?: 0)?
        name    | python software   | python software foundation licen[cs]e
        name    | psf licen         | psf licen[cs]e
    """,
    "php": r"""
        text    | this source file is subject to version | this source file is subject to version 3 0(?:1|0)? of the php license
        text    | this product includes php | this product includes php software freely available from
        address | www php net license | www php net license 3 0(?:1)? txt
        edition | php licen         | php licen[cs]e (?:v|version )?3 01?
        name    | php licen         | php licen[cs]e
    """,
    "ruby": r"""
        notice  | same terms as ruby | same terms as ruby itself
        name    | ruby              | ruby(?: s)? licen[cs]e
    """,
    "postgresql": r"""
        text    | permission to use copy | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
        name    | postgresql licen  | postgresql licen[cs]e
    """,
    "openssl": r"""
        text    | this product includes software developed by the openssl | this product includes software developed by the openssl project for use in the openssl toolkit
        text    | this product includes cryptographic | this product includes cryptographic software written by eric young
        name    | openssl licen     | openssl licen[cs]e
    """,
    "w3c": r"""
        text    | by obtaining      | by obtaining (?:using and or )?(?:and or )?copying this work you the licensee agree that you have read understood and will comply
        address | www w3 org consortium | www w3 org consortium legal(?: 2002 copyright software 20021231| 2015 copyright software and document)?
        name    | w3c               | w3c(?: software)?(?: notice and)? licen[cs]e
    """,
    "eupl": r"""
        notice  | licensed under the eupl | licensed under the eupl(?: version 1 [012])?
        edition | eupl              | eupl (?:v |v|version )?1 [012]
        edition | european union public | european union public licen[cs]e (?:v |v|version )?1 [012]
        name    | european union public | european union public licen[cs]e
        name    | eupl              | eupl
    """,
    "osl": r"""
        notice  | licensed under the open software | licensed under the open software licen[cs]e version [123] [01]
        edition | open software     | open software licen[cs]e (?:v |v|version )?[123] [01]
        name    | open software     | open software licen[cs]e
    """,
    "afl": r"""
        notice  | licensed under the academic | licensed under the academic free licen[cs]e version [123] [012]
        edition | academic free     | academic free licen[cs]e (?:v |v|version )?[123] [012]
        name    | academic free     | academic free licen[cs]e
    """,
    "ms-pl": r"""
        text    | this license governs use | this license governs use of the accompanying software if you use the software you accept this license
        name    | microsoft public  | microsoft public licen[cs]e
        name    | ms pl             | ms pl
    """,
    "ms-rl": r"""
        name    | microsoft reciprocal | microsoft reciprocal licen[cs]e
        name    | ms rl             | ms rl
    """,
    "ofl": r"""
        text    | this font software is licensed | this font software is licensed under the sil open font license(?: version 1 [01])?
        text    | the goals of the open font | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
        address | scripts sil org ofl | scripts sil org ofl
        edition | sil open          | sil open font licen[cs]e (?:v|version )?1 [01]
        edition | open font         | open font licen[cs]e (?:v|version )?1 [01]
        name    | open font         | open font licen[cs]e
    """,
    "odbl": r"""
        text    | this database is made | this database is made available under the open database license
        address | opendatacommons org | opendatacommons org licenses odbl(?: 1 0)?
        edition | open database     | open database licen[cs]e (?:v|version )?1 0
        name    | open database     | open database licen[cs]e
        name    | odbl              | odbl
    """,
    "odc-by": r"""
        address | opendatacommons org | opendatacommons org licenses by(?: 1 0)?
        name    | open data commons attribution | open data commons attribution licen[cs]e
    """,
    "pddl": r"""
        address | opendatacommons org | opendatacommons org licenses pddl(?: 1 0)?
        name    | public domain dedication and | public domain dedication and licen[cs]e
    """,
    "sspl": r"""
        text    | if you make the functionality | if you make the functionality of the program or a modified version available to third parties as a service
        edition | server side public | server side public licen[cs]e (?:v|version )?1
        name    | server side public | server side public licen[cs]e
        name    | sspl              | sspl
    """,
    "upl": r"""
        text    | subject to the condition set forth | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software
        edition | universal permissive | universal permissive licen[cs]e (?:v|version )?1 0
        name    | universal permissive | universal permissive licen[cs]e
    """,
    "ncsa": r"""
        text    | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
        name    | ncsa open         | ncsa open source licen[cs]e
        name    | university of illinois | university of illinois(?: ncsa)? open source licen[cs]e
    """,
    "cecill": r"""
        notice  | this software is governed by the cecill | this software is governed by the cecill(?: b| c)? license
        edition | cecill            | cecill (?:v|version )?(?:1 0|1 1|2 0|2 1)
        name    | cecill            | cecill(?: b| c)? licen[cs]e
    """,
    "elastic": r"""
        notice  | licensed under the elastic | licensed under the elastic license 2 0
        edition | elastic licen     | elastic licen[cs]e (?:v|version )?(?:2 0|2)
        name    | elastic licen     | elastic licen[cs]e
    """,
    "commons-clause": r"""
        text    | the software is provided to you | the software is provided to you by the licensor under the license as defined below subject to the following condition
        name    | commons clause    | commons clause(?: license condition)?
    """,
    "beerware": r"""
        text    | as long as you retain | as long as you retain this notice you can do whatever you want with this stuff
        name    | beerware          | beerware licen[cs]e
        name    | the beer ware     | the beer ware licen[cs]e
    """,
    "json": r"""
        text    | the software shall be used for good | the software shall be used for good not evil
        name    | json licen        | json licen[cs]e
    """,
    "ijg": r"""
        text    | this software is based in part | this software is based in part on the work of the independent jpeg group
        name    | independent jpeg group licen | independent jpeg group licen[cs]e
    """,
    "curl": r"""
        text    | permission to use copy | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        name    | curl licen        | curl licen[cs]e
    """,
    "hpnd": r"""
        text    | permission to use copy | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
        name    | historical permission notice | historical permission notice and disclaimer
    """,
    "vim": r"""
        text    | vim is charityware | vim is charityware
        name    | vim licen         | vim licen[cs]e
    """,
    "cc0": r"""
        text    | to the extent possible | to the extent possible under law .{1,80}? has waived all copyright
        text    | the person who associated | the person who associated a work with this deed has dedicated the work to the public domain
        address | creativecommons org | creativecommons org publicdomain zero 1 0
        edition | cc0               | cc0 1 0(?: universal)?
        name    | cc0               | cc0
        name    | creative commons zero | creative commons zero(?: v1 0 universal)?
    """,
    "cc-by": r"""
        notice  | creative commons  | under (?:a |the )?creative commons attribution(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e
        address | creativecommons org | creativecommons org licenses by [1234] [05]
        edition | cc by             | cc by [1234] [05]
        edition | creative commons attribution | creative commons attribution [1234] [05](?: international| unported| generic)(?: public)?(?: licen[cs]e)?
        name    | creative commons attribution | creative commons attribution(?: international)? licen[cs]e
        name    | cc by             | cc by
    """,
    "cc-by-sa": r"""
        notice  | creative commons  | under (?:a |the )?creative commons attribution share ?alike(?: [1234] [05])?
        address | creativecommons org | creativecommons org licenses by sa [1234] [05]
        edition | cc by sa          | cc by sa [1234] [05]
        edition | creative commons attribution share | creative commons attribution share ?alike [1234] [05]
        name    | creative commons attribution share | creative commons attribution share ?alike
        name    | cc by sa          | cc by sa
    """,
    "cc-by-nc": r"""
        address | creativecommons org | creativecommons org licenses by nc [1234] [05]
        edition | cc by nc          | cc by nc [1234] [05]
        edition | creative commons attribution non | creative commons attribution non ?commercial [1234] [05]
        name    | creative commons attribution non | creative commons attribution non ?commercial
        name    | cc by nc          | cc by nc
    """,
    "cc-by-nd": r"""
        address | creativecommons org | creativecommons org licenses by nd [1234] [05]
        edition | cc by nd          | cc by nd [1234] [05]
        name    | creative commons attribution no | creative commons attribution no ?deriv(?:atives|s)
        name    | cc by nd          | cc by nd
    """,
    "cc-by-nc-sa": r"""
        address | creativecommons org | creativecommons org licenses by nc sa [1234] [05]
        edition | cc by nc sa       | cc by nc sa [1234] [05]
        name    | creative commons attribution non | creative commons attribution non ?commercial share ?alike
        name    | cc by nc sa       | cc by nc sa
    """,
    "cc-by-nc-nd": r"""
        address | creativecommons org | creativecommons org licenses by nc nd [1234] [05]
        edition | cc by nc nd       | cc by nc nd [1234] [05]
        name    | creative commons attribution non | creative commons attribution non ?commercial no ?deriv(?:atives|s)
        name    | cc by nc nd       | cc by nc nd
    """,
    "public-domain": r"""
        text    | i the copyright holder | i the copyright holder of this work (?:hereby )?release this work into the public domain
        notice  | released          | released (?:in|in to|into|to) the public domain
        notice  | dedicated         | dedicated to the public domain
        notice  | placed            | placed (?:in|in to|into) the public domain
        notice  | is in the public  | this (?:file|code|software|document) is in the public domain
        notice  | this work is in the public | this work is in the public domain
    """,
    "proprietary": r"""
        text    | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
        text    | no part of this   | no part of this (?:publication|work|document|book) may be reproduced
        notice  | proprietary and   | proprietary and confidential
        notice  | confidential and  | confidential and proprietary
        notice  | this software is the confidential | this software is the confidential and proprietary information of
        notice  | for internal use only | for internal use only (?:not for distribution|do not distribute)
    """,
}

#: Short names of the SPDX list, by label. A tag that goes on after a short name ("-only", "-or-later") has the same label.
SPDX = {
    "gpl": "GPL-1.0 GPL-2.0 GPL-3.0", "lgpl": "LGPL-2.0 LGPL-2.1 LGPL-3.0", "agpl": "AGPL-1.0 AGPL-3.0", "gfdl": "GFDL-1.1 GFDL-1.2 GFDL-1.3",
    "apache": "Apache-1.0 Apache-1.1 Apache-2.0", "mit": "MIT MIT-0 MIT-CMU MIT-Modern-Variant X11", "isc": "ISC",
    "bsd": "0BSD BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSD-Source-Code",
    "mpl": "MPL-1.0 MPL-1.1 MPL-2.0", "epl": "EPL-1.0 EPL-2.0", "cddl": "CDDL-1.0 CDDL-1.1", "cpl": "CPL-1.0",
    "artistic": "Artistic-1.0 Artistic-1.0-Perl Artistic-2.0", "zlib": "Zlib zlib-acknowledgement libpng-2.0", "boost": "BSL-1.0", "bsl": "BUSL-1.1",
    "unlicense": "Unlicense", "wtfpl": "WTFPL", "python": "PSF-2.0 Python-2.0", "php": "PHP-3.0 PHP-3.01", "ruby": "Ruby", "postgresql": "PostgreSQL",
    "openssl": "OpenSSL", "w3c": "W3C W3C-19980720 W3C-20150513", "eupl": "EUPL-1.0 EUPL-1.1 EUPL-1.2", "osl": "OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0",
    "afl": "AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0", "ms-pl": "MS-PL", "ms-rl": "MS-RL", "ofl": "OFL-1.0 OFL-1.1", "odbl": "ODbL-1.0", "sspl": "SSPL-1.0",
    "upl": "UPL-1.0", "cc0": "CC0-1.0", "cc-by": "CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0",
    "cc-by-sa": "CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0", "cc-by-nc": "CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0",
    "cc-by-nd": "CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0",
    "cc-by-nc-sa": "CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0",
    "cc-by-nc-nd": "CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0",
}

@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern[str]
    priority: int
    weight: float


def hand_written() -> list[tuple[str, str, str, str]]:
    """(label, kind, keyword, pattern) of RULES, in their order."""
    lines = [(label, line) for label, block in RULES.items() for line in block.strip().split("\n")]
    return [(label, *(x.strip() for x in line.split("|", 2))) for label, line in lines]


def make_rules() -> tuple[Rule, ...]:
    """The hand-written rules, and for each SPDX short name one on the name in an identifier tag. A rule's keyword stands
    at the start of a word in all that its pattern matches.

    Ordered by falling priority, then as written, so that an earlier rule wins over a later one of equal extent.
    """
    made = [(label, keyword, pattern, *KINDS[kind]) for label, kind, keyword, pattern in hand_written()]
    for label, names in SPDX.items():
        made += [(label, "spdx", rf"spdx licen[cs]e identifier {re.sub('[-.]', ' ', name.lower())}", *KINDS["tag"]) for name in names.split()]
    made.sort(key=lambda r: -r[3])
    return tuple(Rule(label, keyword, re.compile(rf"(?<= )(?:{p})(?= )"), priority, weight) for label, keyword, p, priority, weight in made)


def settle(matches: list[tuple[int, int, int]], rules: Sequence[Rule]) -> list[tuple[int, int, int]]:
    """Of (start, end, rule), those that stay, in the order of the text.

    Priorities are gone through from the highest. A match that overlaps one of a higher priority that stays falls, be it
    within that one or around it. Of one priority, a match that lies within another falls, of equal extents the later
    rule's, and of two that overlap in part the one that starts later. A match that has fallen suppresses nothing.
    """
    kept: list[tuple[int, int, int]] = []
    for _, level in groupby(sorted(matches, key=lambda m: -rules[m[2]].priority), key=lambda m: rules[m[2]].priority):
        starts, new, reach = [k[0] for k in kept], [], -1
        for m in sorted(level, key=lambda m: (m[0], -m[1], m[2])):
            at = bisect_left(starts, m[1])  # the last one kept that starts before the match ends
            if m[0] >= reach and not (at and kept[at - 1][1] > m[0]):
                new.append(m)
                reach = m[1]
        kept = sorted(kept + new)
    return kept


class Scanner:
    """Finds base phrases and settled rule matches in one text; made once in a worker."""

    def __init__(self):
        import ahocorasick

        self.rules = make_rules()
        self.keywords = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by_keyword.setdefault(rule.keyword, []).append(i)
        for keyword, ids in by_keyword.items():
            self.keywords.add_word(f" {keyword}", ids)
        self.keywords.make_automaton()
        self.base = [(re.compile(f"(?= {phrase} )"), label) for phrase, label in BASE_PHRASES.items()]

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        words = text.lower().translate(SEPARATE).split()
        # bytes as Latin letters: positions stay, and patterns hold ASCII only
        line = f" {b' '.join(words).decode('latin-1')} "
        gated = sorted({i for _, ids in self.keywords.iter(line) for i in ids})
        if not gated:
            return len(words), 0, None, None, [], [], 0.0
        places, base = [], set()
        for pattern, label in self.base:
            found = [m.start() for m in pattern.finditer(line)]
            places += found
            base |= {label} if found else set()
        matches = []
        for i in gated:
            rule = self.rules[i]
            matches += [(m.start(), m.end(), i) for m in rule.pattern.finditer(line)]
        kept = settle(matches, self.rules)
        score = 1.0
        for _, _, i in kept:
            score *= 1 - self.rules[i].weight
        starts = [line.count(" ", 0, p + 1) - 1 for p in (min(places), max(places))] if places else [None, None]
        labels = base | {self.rules[i].label for _, _, i in kept}
        return len(words), len(places), starts[0], starts[1], sorted(base), sorted(labels), max(1 - score, 0.5 if base else 0.0)


_SCANNER: list[Scanner] = []


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row a document.

    The text is scanned whole; a null text is empty and has no label. Base places are the words where a base phrase
    stands, overlapping ones included. Overlapping matches are settled by priority and extent, see settle. labels joins
    base labels and those of the matches that stay; score is 1 less the product of (1 - weight) over them, at least 0.5
    with a base label. Rows that repeat an identifier are scanned each; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        scan = _SCANNER[0].scan
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = [scan(t) for t in some.column(1).cast(pa.binary()).to_pylist()]
                n, base, first, last, base_labels, labels, score = zip(*found, strict=True)
                columns = [pa.array(x, pa.int64()) for x in (n, base, first, last)] + [pa.array([",".join(v) for v in x]) for x in (base_labels, labels)] + [pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
