"""The signature rules of the license scan, written by hand.

One rule a line: label, keywords (any of them must be in the text), pattern.  Patterns are
regular expressions over lower-case words joined by one blank, and begin and end at words.
The sections go from the highest priority to the lowest; each has its priority and score.
"""

# Sentences that stand only in the license texts and their notices.
GRANTS = """
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | without restriction | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | advertising or otherwise | except as contained in this notice the name of .{1,60}? shall not be used in advertising or otherwise to promote the sale
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | hereby granted | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose .{0,40}?is hereby granted
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | endorse or promote | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-3 | endorse or promote | the names? of .{1,60}? may not be used to endorse or promote products derived from this software
bsd-4 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-3-clear | patent rights | no express or implied licenses to any party s patent rights are granted by this license
bsd-patent | grants to those receiving rights | subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual
apache-2 | compliance with the license | you may not use this file except in compliance with the license
apache-2 | license is distributed on an as is | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | contributor hereby grants to you | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
gpl-2+ | any later version | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3+ | any later version | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl | free software foundation | gnu general public license as published by the free software foundation
gpl-2 | version 2 june 1991 | gnu general public license version 2 june 1991
gpl-3 | 29 june 2007 | gnu general public license version 3 29 june 2007
gpl | received a copy of the gnu general | you should have received a copy of the gnu general public license along with
lgpl-2.1+ | any later version | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3+ | any later version | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2+ | any later version | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl | lesser general public | gnu lesser general public license as published by the free software foundation
lgpl | received a copy of the gnu lesser | you should have received a copy of the gnu lesser general public license along with
agpl-3+ | any later version | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl | affero | gnu affero general public license as published by the free software foundation
agpl | received a copy of the gnu affero | you should have received a copy of the gnu affero general public license along with
gfdl | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl-exception | special exception | as a special exception .{1,120}? gives? (?:you )?(?:unlimited )?permission to
classpath-exception | making a combined work | linking this library statically or dynamically with other modules is making a combined work
mpl-2 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
mpl-1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 0
npl | netscape public license | the contents of this file are subject to the netscape public license
epl-2 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
epl-1 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?1 0
edl | eclipse distribution license | made available under the terms of the eclipse distribution license v 1 0
cddl | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
cpl | common public license | this program and the accompanying materials are made available under the terms of the common public license
ipl | ibm public license | the accompanying program is provided under the terms of this ibm public license
zlib | be held liable | in no event will the authors be held liable for any damages arising from the use of this software
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | png reference library | the png reference library is supplied as is
boost | documentation covered by this license | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost | boost software license | distributed under the boost software license version 1 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | do what the fuck | do what the fuck you want to public license
wtfpl | you just do what | you just do what the fuck you want to
cc0 | related or neighboring rights | to the extent possible under law .{1,100}? waived? all copyright and related or neighboring rights
cc0 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
artistic-2 | given free software package | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package
artistic-1 | copyright holder maintains | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
perl | perl itself | (?:you can|may) redistribute it and or modify it under the same terms as perl itself
ofl | font software | permission is hereby granted free of charge to any person obtaining a copy of the font software
ofl | font software | this font software is licensed under the sil open font license version 1 1
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic software | this product includes cryptographic software written by eric young
php | php software | this product includes php software freely available from
psf | psf is making python | psf is making python available to licensee on an as is basis
postgresql | without a written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | with the software without restriction | developed by .{1,80}? permission is hereby granted free of charge .{1,120}? to deal with the software without restriction
curl | name of a copyright holder | except as contained in this notice the name of a copyright holder shall not be used in advertising
tcl | existing copyright notices are retained | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained
vim | vim | there are no restrictions on distributing unmodified copies of vim
icu | unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c | w3c | this work .{0,40}?is being provided by the copyright holders under the following license .{0,80}?w3c
ms-pl | this license governs use | this license governs use of the accompanying software if you use the software you accept this license
eupl | eupl | licensed under the eupl version 1 [12]
sspl | server side public | server side public license version 1 as published by mongodb
busl | business source license | use of this software is governed by the business source license
elastic-2 | elastic license | licensed under the elastic license 2 0
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
json | good not evil | the software shall be used for good not evil
ecl-2 | educational community | licensed under the educational community license version 2 0
afl-3 | academic free | licensed under the academic free license version 3 0
osl-3 | open software license | licensed under the open software license version 3 0
upl | universal permissive | the universal permissive license upl version 1 0
bsl-source | additional use grant | additional use grant .{1,60}? change date
commons-clause | provided to you by the licensor | the software is provided to you by the licensor under the license as defined below subject to the following condition
odbl | open database license | this .{1,60}? is made available under the open database license
pddl | public domain dedication | made available under the public domain dedication and license
odc-by | open data commons | made available under the open data commons attribution license
fsfap | notice are preserved | copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
sleepycat | accompanying software that uses | information on how to obtain complete source code for the .{1,40}? software and any accompanying software that uses
nasa | nasa open source | this open source agreement .{1,80}? nasa open source
blueoak | blue oak | blue oak model license
bittorrent | bittorrent open source | the contents of this file are subject to the bittorrent open source license
"""

# Addresses of license texts.
ADDRESSES = """
apache-2 | apache org | apache org licenses license 2 0
apache | apache org | apache org licenses
gpl-2 | gnu org | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | gnu org | gnu org licenses gpl 3 0
gpl | gnu org | gnu org licenses gpl
lgpl-2.1 | gnu org | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3 | gnu org | gnu org licenses lgpl 3 0
lgpl | gnu org | gnu org licenses lgpl
agpl-3 | gnu org | gnu org licenses agpl 3 0
gfdl | gnu org | gnu org licenses fdl
mit | opensource org | opensource org licenses mit(?: license)?(?: php)?
bsd-2 | opensource org | opensource org licenses bsd 2 clause
bsd-3 | opensource org | opensource org licenses bsd 3 clause
isc | opensource org | opensource org licenses isc
zlib | opensource org | opensource org licenses zlib
artistic-2 | opensource org | opensource org licenses artistic(?: license)? 2 0
mpl-2 | mozilla org | mozilla org (?:en us )?mpl 2 0
mpl | mozilla org | mozilla org (?:en us )?mpl
epl-1 | eclipse org | eclipse org (?:org )?(?:documents|legal) epl v10
epl-2 | eclipse org | eclipse org (?:org )?(?:documents|legal) epl (?:2 0|v20)
boost | boost org | boost org license 1 0
ofl | scripts sil org | scripts sil org ofl
unlicense | unlicense org | unlicense org
wtfpl | wtfpl net | wtfpl net
cc0 | creativecommons org | creativecommons org publicdomain zero
public-domain-mark | creativecommons org | creativecommons org publicdomain mark
cc-by | creativecommons org | creativecommons org licenses by (?:[1-4] [05]|deed)
cc-by-sa | creativecommons org | creativecommons org licenses by sa
cc-by-nd | creativecommons org | creativecommons org licenses by nd
cc-by-nc | creativecommons org | creativecommons org licenses by nc (?:[1-4] [05]|deed)
cc-by-nc-sa | creativecommons org | creativecommons org licenses by nc sa
cc-by-nc-nd | creativecommons org | creativecommons org licenses by nc nd
odbl | opendatacommons org | opendatacommons org licenses odbl
pddl | opendatacommons org | opendatacommons org licenses pddl
odc-by | opendatacommons org | opendatacommons org licenses by
postgresql | postgresql org | postgresql org about licen[cs]e
python | docs python org | docs python org .{0,20}?license html
"""

# Identifiers in source files and package descriptions.
TAGS = """
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
apache-2 | spdx | spdx license identifier apache 2 0
apache-1.1 | spdx | spdx license identifier apache 1 1
gpl-2 | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2+ | spdx | spdx license identifier gpl 2 0 or later
gpl-3 | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3+ | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1+ | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3 | spdx | spdx license identifier lgpl 3 0(?: only)?
lgpl-3+ | spdx | spdx license identifier lgpl 3 0 or later
agpl-3 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
bsd-2 | spdx | spdx license identifier bsd 2 clause
bsd-3 | spdx | spdx license identifier bsd 3 clause
bsd-4 | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
isc | spdx | spdx license identifier isc
mpl-2 | spdx | spdx license identifier mpl 2 0
epl-1 | spdx | spdx license identifier epl 1 0
epl-2 | spdx | spdx license identifier epl 2 0
cddl | spdx | spdx license identifier cddl 1 [01]
zlib | spdx | spdx license identifier zlib
boost | spdx | spdx license identifier bsl 1 0
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
cc0 | spdx | spdx license identifier cc0 1 0
cc-by | spdx | spdx license identifier cc by [1-4] 0
cc-by-sa | spdx | spdx license identifier cc by sa [1-4] 0
cc-by-nc | spdx | spdx license identifier cc by nc [1-4] 0
ofl | spdx | spdx license identifier ofl 1 1
artistic-2 | spdx | spdx license identifier artistic 2 0
mit | classifier, osi approved | license osi approved mit license
apache-2 | osi approved | license osi approved apache software license
bsd | osi approved | license osi approved bsd license
gpl-2 | osi approved | license osi approved gnu general public license v2
gpl-3 | osi approved | license osi approved gnu general public license v3
lgpl-3 | osi approved | license osi approved gnu lesser general public license v3
mpl-2 | osi approved | license osi approved mozilla public license 2 0
isc | osi approved | license osi approved isc license
psf | osi approved | license osi approved python software foundation license
"""

# Statements that something is under a license.
STATEMENTS = """
mit | mit, expat | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: licen[cs]e)?
mit | mit | under (?:a |an |the )(?:terms of the )?mit(?: style| x11)? licen[cs]e
apache-2 | apache | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache | apache | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e
gpl-2 | gpl, general public | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?2(?: 0)?
gpl-3 | gpl, general public | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?
gpl | gpl, general public | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)
lgpl-2.1 | lgpl, lesser general | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?v?2 1
lgpl-3 | lgpl, lesser general | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?
lgpl | lgpl, lesser general, library general | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public|library general public)(?: licen[cs]e)?
agpl-3 | agpl, affero | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?
agpl | agpl, affero | (?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public)(?: licen[cs]e)?
bsd-2 | bsd | under (?:the |a )?(?:terms of )?(?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?
bsd-3 | bsd | under (?:the |a )?(?:terms of )?(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?
bsd | bsd | under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? licen[cs]e
isc | isc | under (?:the |a )?(?:terms of )?(?:the )?isc licen[cs]e
mpl-2 | mpl, mozilla public | under (?:the )?(?:terms of )?(?:the )?(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?v?2(?: 0)?
mpl-1.1 | mpl, mozilla public | under (?:the )?(?:terms of )?(?:the )?(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?v?1 1
mpl | mpl, mozilla public | under (?:the )?(?:terms of )?(?:the )?(?:mpl|mozilla public)(?: licen[cs]e)?
epl-1 | epl, eclipse public | under (?:the )?(?:terms of )?(?:the )?(?:epl|eclipse public licen[cs]e)(?: version| v)? ?v?1(?: 0)?
epl-2 | epl, eclipse public | under (?:the )?(?:terms of )?(?:the )?(?:epl|eclipse public licen[cs]e)(?: version| v)? ?v?2(?: 0)?
cddl | cddl, common development | under (?:the )?(?:terms of )?(?:the )?(?:cddl|common development and distribution)(?: licen[cs]e)?
cpl | common public | under (?:the )?(?:terms of )?(?:the )?common public licen[cs]e
zlib | zlib | under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)? licen[cs]e
boost | boost | under (?:the )?(?:terms of )?(?:the )?boost(?: software)? licen[cs]e
artistic-2 | artistic | under (?:the )?(?:terms of )?(?:the )?artistic licen[cs]e(?: version| v)? ?2(?: 0)?
artistic | artistic | under (?:the )?(?:terms of )?(?:the )?artistic licen[cs]e
wtfpl | wtfpl | under (?:the )?(?:terms of )?(?:the )?wtfpl
unlicense | unlicense | under (?:the )?(?:terms of )?(?:the )?unlicense
ofl | ofl, open font | under (?:the )?(?:terms of )?(?:the )?(?:sil )?(?:ofl|open font licen[cs]e)
psf | python software, psf | under (?:the )?(?:terms of )?(?:the )?(?:psf|python software foundation) licen[cs]e
php | php | under (?:the )?(?:terms of )?(?:the )?php licen[cs]e
postgresql | postgresql | under (?:the )?(?:terms of )?(?:the )?postgresql licen[cs]e
ms-pl | ms pl, microsoft public | under (?:the )?(?:terms of )?(?:the )?(?:ms pl|microsoft public licen[cs]e)
ms-rl | ms rl, microsoft reciprocal | under (?:the )?(?:terms of )?(?:the )?(?:ms rl|microsoft reciprocal licen[cs]e)
gfdl | gfdl, free documentation | under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gfdl|free documentation licen[cs]e)
eupl | eupl, european union public | under (?:the )?(?:terms of )?(?:the )?(?:eupl|european union public licen[cs]e)
sspl | sspl, server side public | under (?:the )?(?:terms of )?(?:the )?(?:sspl|server side public licen[cs]e)
busl | busl, business source | under (?:the )?(?:terms of )?(?:the )?(?:busl|business source licen[cs]e)
cc0 | cc0, creative commons zero, cc zero | under (?:the )?(?:terms of )?(?:a |the )?(?:cc0|cc zero|creative commons zero)
cc-by-nc-nd | cc by, creative commons | under (?:the )?(?:terms of )?(?:a |the )?(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\\w*)
cc-by-nc-sa | cc by, creative commons | under (?:the )?(?:terms of )?(?:a |the )?(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)
cc-by-nc | cc by, creative commons | under (?:the )?(?:terms of )?(?:a |the )?(?:cc by nc|creative commons attribution non ?commercial)
cc-by-nd | cc by, creative commons | under (?:the )?(?:terms of )?(?:a |the )?(?:cc by nd|creative commons attribution no ?deriv\\w*)
cc-by-sa | cc by, creative commons | under (?:the )?(?:terms of )?(?:a |the )?(?:cc by sa|creative commons attribution share ?alike)
cc-by | cc by, creative commons | under (?:the )?(?:terms of )?(?:a |the )?(?:cc by|creative commons attribution)
cc | creative commons | under (?:the )?(?:terms of )?(?:a |the )?creative commons licen[cs]e
odbl | odbl, open database | under (?:the )?(?:terms of )?(?:the )?(?:odbl|open database licen[cs]e)
"""

# Names of licenses by themselves.
NAMES = """
mit | mit license, mit licence | mit licen[cs]e
mit | expat license, expat licence | expat licen[cs]e
apache-2 | apache license, apache licence, apache software | apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2 | asl 2 | asl 2 0
apache-1.1 | apache license, apache licence, apache software | apache(?: software)? licen[cs]e(?: version| v)? ?1 1
apache | apache license, apache licence, apache software | apache(?: software)? licen[cs]e
gpl-2 | gpl, general public | (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?2(?: 0)?
gpl-3 | gpl, general public | (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?
gpl | gnu gpl, gnu general public | gnu (?:gpl|general public licen[cs]e)
lgpl-2.1 | lgpl, lesser general | (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?v?2 1
lgpl-3 | lgpl, lesser general | (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?
lgpl | lgpl, lesser general public | (?:gnu )?(?:lgpl|lesser general public licen[cs]e)
agpl-3 | agpl, affero | (?:gnu )?(?:agpl|affero general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?
agpl | agpl, affero general | (?:gnu )?(?:agpl|affero general public licen[cs]e)
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e
bsd-2 | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)
bsd-3 | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)
bsd-4 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)
0bsd | bsd | (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?
bsd | bsd license, bsd licence, bsd style | bsd(?: style)? licen[cs]e
isc | isc license, isc licence | isc licen[cs]e
mpl-2 | mozilla public, mpl | (?:mozilla public licen[cs]e|mpl)(?: version| v)? ?2 0
mpl | mozilla public | mozilla public licen[cs]e
epl-1 | eclipse public | eclipse public licen[cs]e(?: version| v)? ?1 0
epl-2 | eclipse public | eclipse public licen[cs]e(?: version| v)? ?2 0
epl | eclipse public | eclipse public licen[cs]e
edl | eclipse distribution | eclipse distribution licen[cs]e
cddl | common development | common development and distribution licen[cs]e
cpl | common public license, common public licence | common public licen[cs]e
zlib | zlib license, zlib licence, zlib libpng | zlib(?: libpng)? licen[cs]e
libpng | libpng license, libpng licence | libpng licen[cs]e
boost | boost software | boost software licen[cs]e
boost | bsl 1 0 | bsl 1 0
artistic-2 | artistic license, artistic licence | artistic licen[cs]e(?: version| v)? ?2(?: 0)?
artistic | artistic license, artistic licence | artistic licen[cs]e
wtfpl | wtfpl | wtfpl(?: licen[cs]e)?
unlicense | the unlicense | the unlicense
ofl | open font license, open font licence | (?:sil )?open font licen[cs]e
psf | python software foundation | python software foundation licen[cs]e
php | php license, php licence | php licen[cs]e
postgresql | postgresql license, postgresql licence | postgresql licen[cs]e
ms-pl | microsoft public | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e
openssl | openssl license, openssl licence | openssl licen[cs]e
w3c | w3c software | w3c software (?:notice and )?licen[cs]e
x11 | x11 license, x11 licence | x11 licen[cs]e
vim | vim license, vim licence | vim licen[cs]e
ncsa | ncsa, university of illinois | (?:university of illinois )?(?:ncsa )?open source licen[cs]e ncsa|university of illinois ncsa open source licen[cs]e
afl | academic free | academic free licen[cs]e
osl | open software licen | open software licen[cs]e
ecl | educational community | educational community licen[cs]e
upl | universal permissive | universal permissive licen[cs]e
eupl | european union public | european union public licen[cs]e
sspl | server side public | server side public licen[cs]e
busl | business source | business source licen[cs]e
elastic-2 | elastic license, elastic licence | elastic licen[cs]e(?: version| v)? ?2(?: 0)?
beerware | beerware, beer ware | beer ?ware licen[cs]e
odbl | open database | open database licen[cs]e
cc0 | cc0 1 0, creative commons zero | (?:cc0 1 0|creative commons zero)
cc-by-nc-nd | cc by nc nd, noncommercial, non commercial | (?:cc by nc nd|attribution non ?commercial no ?deriv\\w*)(?: [1-4] 0)?
cc-by-nc-sa | cc by nc sa, noncommercial, non commercial | (?:cc by nc sa|attribution non ?commercial share ?alike)(?: [1-4] 0)?
cc-by-nc | cc by nc, noncommercial, non commercial | (?:cc by nc|attribution non ?commercial)(?: [1-4] 0)
cc-by-nd | cc by nd, noderiv, no deriv | (?:cc by nd|attribution no ?deriv\\w*)(?: [1-4] 0)?
cc-by-sa | cc by sa, sharealike, share alike | (?:cc by sa|attribution share ?alike)(?: [1-4] 0)?
cc-by | cc by | cc by [1-4] 0
cc-by | creative commons attribution | creative commons attribution(?: [1-4] 0)?
openldap | openldap public | openldap public licen[cs]e
ruby | ruby license, ruby licence | ruby licen[cs]e
qpl | q public | q public licen[cs]e
apsl | apple public source | apple public source licen[cs]e
"""

# What says something of rights, without naming a license.
RESERVATIONS = """
public-domain | public domain | (?:dedicated|released|placed|is|are) (?:to|into|in) the public domain
proprietary | all rights reserved | all rights reserved
proprietary | proprietary | proprietary and confidential
proprietary | confidential | confidential and proprietary
proprietary | permission | (?:may not be|do not) (?:copied|copy|reproduced|reproduce|redistributed|redistribute) without (?:the )?(?:prior )?(?:written )?permission
proprietary | written consent | (?:reproduction|distribution|redistribution) (?:is )?(?:strictly )?prohibited without (?:the )?(?:prior )?written consent
proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution) (?:of this (?:file|document|work) )?(?:via any medium )?is (?:strictly )?prohibited
proprietary | end user licen | end user licen[cs]e agreement
non-commercial | noncommercial, non commercial | for non ?commercial use only
non-commercial | personal use | for personal use only
free-use | free to use | (?:you are )?free to use copy and modify
see-license | license file, licence file | see the (?:included |accompanying |enclosed )?licen[cs]e file
see-license | license terms, licence terms | see licen[cs]e terms
"""

SECTIONS = ((GRANTS, 80, 0.99), (ADDRESSES, 70, 0.97), (TAGS, 65, 0.99), (STATEMENTS, 60, 0.97), (NAMES, 40, 0.85), (RESERVATIONS, 20, 0.6))


def written() -> list[tuple[str, tuple[str, ...], str, int, float]]:
    """label, keywords, pattern, priority and score of every rule, in order."""
    out = []
    for text, priority, score in SECTIONS:
        for line in text.strip().split("\n"):
            label, keywords, pattern = (x.strip() for x in line.split(" | "))
            out.append((label, tuple(k.strip() for k in keywords.split(",")), pattern.replace("\\\\", "\\"), priority, score))
    return out
