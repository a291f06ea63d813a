"""Signatures of licences, written by hand: label, priority, keyword, regex.

A regex runs over words: lower-cased, without punctuation, one blank between two. A line of words holds the keyword
wherever the regex matches. Priorities: 95 SPDX identifiers, 90 whole grants and headers, 80 links, 70 sentences, 60 names with a version,
50 names, 40 short names. Rules are tried in this order; ``l`` stands for licen[sc]e.
"""

from __future__ import annotations

import re

TEXT = r"""
gpl-1.0 | 95 | spdx | spdx l identifier gpl 1 0(?: only| or later)?
gpl-2.0 | 95 | spdx | spdx l identifier gpl 2 0(?: only)?
gpl-2.0-or-later | 95 | spdx | spdx l identifier gpl 2 0 or later
gpl-3.0 | 95 | spdx | spdx l identifier gpl 3 0(?: only)?
gpl-3.0-or-later | 95 | spdx | spdx l identifier gpl 3 0 or later
lgpl-2.0 | 95 | spdx | spdx l identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 95 | spdx | spdx l identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | 95 | spdx | spdx l identifier lgpl 2 1 or later
lgpl-3.0 | 95 | spdx | spdx l identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | 95 | spdx | spdx l identifier agpl 3 0(?: only)?
agpl-3.0-or-later | 95 | spdx | spdx l identifier agpl 3 0 or later
gfdl | 95 | spdx | spdx l identifier gfdl 1 [123](?: only| or later)?
apache-1.0 | 95 | spdx | spdx l identifier apache 1 0
apache-1.1 | 95 | spdx | spdx l identifier apache 1 1
apache-2.0 | 95 | spdx | spdx l identifier apache 2 0
mit | 95 | spdx | spdx l identifier mit
mit-0 | 95 | spdx | spdx l identifier mit 0
bsd-0-clause | 95 | spdx | spdx l identifier 0bsd
bsd-1-clause | 95 | spdx | spdx l identifier bsd 1 clause
bsd-2-clause | 95 | spdx | spdx l identifier bsd 2 clause
bsd-2-clause-patent | 95 | spdx | spdx l identifier bsd 2 clause patent
bsd-3-clause | 95 | spdx | spdx l identifier bsd 3 clause
bsd-3-clause-clear | 95 | spdx | spdx l identifier bsd 3 clause clear
bsd-4-clause | 95 | spdx | spdx l identifier bsd 4 clause
isc | 95 | spdx | spdx l identifier isc
mpl-1.0 | 95 | spdx | spdx l identifier mpl 1 0
mpl-1.1 | 95 | spdx | spdx l identifier mpl 1 1
mpl-2.0 | 95 | spdx | spdx l identifier mpl 2 0
epl-1.0 | 95 | spdx | spdx l identifier epl 1 0
epl-2.0 | 95 | spdx | spdx l identifier epl 2 0
cddl-1.0 | 95 | spdx | spdx l identifier cddl 1 0
cddl-1.1 | 95 | spdx | spdx l identifier cddl 1 1
eupl-1.1 | 95 | spdx | spdx l identifier eupl 1 1
eupl-1.2 | 95 | spdx | spdx l identifier eupl 1 2
artistic-1.0 | 95 | spdx | spdx l identifier artistic 1 0(?: perl| cl8)?
artistic-2.0 | 95 | spdx | spdx l identifier artistic 2 0
boost-1.0 | 95 | spdx | spdx l identifier bsl 1 0
zlib | 95 | spdx | spdx l identifier zlib
unlicense | 95 | spdx | spdx l identifier unlicense
wtfpl | 95 | spdx | spdx l identifier wtfpl
psf-2.0 | 95 | spdx | spdx l identifier (?:psf|python) 2 0
ofl-1.1 | 95 | spdx | spdx l identifier ofl 1 1
odbl-1.0 | 95 | spdx | spdx l identifier odbl 1 0
ms-pl | 95 | spdx | spdx l identifier ms pl
ms-rl | 95 | spdx | spdx l identifier ms rl
cc0-1.0 | 95 | spdx | spdx l identifier cc0 1 0
cc-by-3.0 | 95 | spdx | spdx l identifier cc by 3 0
cc-by-4.0 | 95 | spdx | spdx l identifier cc by 4 0
cc-by-sa-3.0 | 95 | spdx | spdx l identifier cc by sa 3 0
cc-by-sa-4.0 | 95 | spdx | spdx l identifier cc by sa 4 0
cc-by-nd-4.0 | 95 | spdx | spdx l identifier cc by nd 4 0
cc-by-nc-4.0 | 95 | spdx | spdx l identifier cc by nc 4 0
cc-by-nc-sa-4.0 | 95 | spdx | spdx l identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | 95 | spdx | spdx l identifier cc by nc nd 4 0
postgresql | 95 | spdx | spdx l identifier postgresql
openssl | 95 | spdx | spdx l identifier openssl
php-3.01 | 95 | spdx | spdx l identifier php 3 01
upl-1.0 | 95 | spdx | spdx l identifier upl 1 0
ncsa | 95 | spdx | spdx l identifier ncsa
mit | 90 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | 85 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | 85 | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 90 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc | 90 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
bsd-0-clause | 88 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
postgresql | 90 | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | 85 | permission | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
x11 | 85 | permission | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
boost-1.0 | 90 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this l
ofl-1.1 | 90 | permission | permission is hereby granted free of charge to any person obtaining a copy of the font software
unicode | 85 | permission | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
zlib | 90 | permission | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
gfdl | 90 | permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation l
bsd-2-clause | 85 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | 92 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: [^ ]+){40,110} neither the name of
bsd-4-clause | 93 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: [^ ]+){40,90} all advertising materials mentioning features or use of this software
bsd-2-clause | 80 | redistribution | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 80 | redistribution | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
openssl | 90 | redistribution | redistributions of any form whatsoever must retain the following acknowledgment
apache-1.1 | 90 | redistribution | the end user documentation included with the redistribution if any must include the following acknowledge?ment
apache-2.0 | 90 | apache | licensed under the apache l version 2 0 the l you may not use this file except in compliance with the l
apache-2.0 | 85 | apache | licensed under the apache l version 2 0
apache-2.0 | 90 | apache | licensed to the apache software foundation asf under one or more contributor l agreements
apache-2.0 | 80 | apache | https? www apache org licenses license 2 0(?: html| txt)?
apache-1.1 | 80 | apache | https? www apache org licenses license 1 1
apache-2.0 | 60 | apache | apache(?: software)? l(?: v| version| ver)? 2(?: 0)?
apache-1.1 | 60 | apache | apache(?: software)? l(?: v| version| ver)? 1 1
apache-1.0 | 60 | apache | apache(?: software)? l(?: v| version| ver)? 1 0
apache | 70 | apache | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? l
apache | 50 | apache | apache(?: software)? l
gpl-3.0-or-later | 90 | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public l as published by the free software foundation either version 3 of the l or at your option any later version
gpl-2.0-or-later | 90 | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public l as published by the free software foundation either version 2 of the l or at your option any later version
gpl | 85 | gnu | free software you can redistribute it and or modify it under the terms of the gnu general public l
lgpl | 85 | gnu | free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public l
agpl | 85 | gnu | free software you can redistribute it and or modify it under the terms of the gnu affero general public l
gpl | 70 | gnu | you should have received a copy of the gnu general public l
lgpl | 70 | gnu | you should have received a copy of the gnu (?:lesser|library) general public l
agpl | 70 | gnu | you should have received a copy of the gnu affero general public l
gpl-3.0 | 80 | gnu | https? www gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
gpl-2.0 | 80 | gnu | https? www gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
lgpl-3.0 | 80 | gnu | https? www gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?
lgpl-2.1 | 80 | gnu | https? www gnu org licenses (?:old licenses )?lgpl 2 1(?: en)?(?: html| txt)?
agpl-3.0 | 80 | gnu | https? www gnu org licenses agpl 3 0(?: en)?(?: html| txt)?
gfdl | 80 | gnu | https? www gnu org licenses fdl(?: 1 [123])?(?: en)?(?: html| txt)?
gpl | 75 | gnu | https? www gnu org licenses gpl(?: html| txt)?
gpl-3.0-or-later | 65 | gnu | gnu general public l(?: v| version| ver)? 3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-2.0-or-later | 65 | gnu | gnu general public l(?: v| version| ver)? 2(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-3.0 | 60 | gnu | gnu general public l(?: v| version| ver)? 3(?: 0)?(?: only)?
gpl-2.0 | 60 | gnu | gnu general public l(?: v| version| ver)? 2(?: 0)?(?: only)?
gpl-1.0 | 60 | gnu | gnu general public l(?: v| version| ver)? 1(?: 0)?(?: only)?
lgpl-3.0 | 60 | gnu | gnu lesser general public l(?: v| version| ver)? 3(?: 0)?(?: only)?
lgpl-2.1 | 60 | gnu | gnu lesser general public l(?: v| version| ver)? 2 1(?: only)?
lgpl-2.0 | 60 | gnu | gnu library general public l(?: v| version| ver)? 2(?: 0)?(?: only)?
agpl-3.0 | 60 | affero | (?:gnu )?affero general public l(?: v| version| ver)? 3(?: 0)?(?: only)?
agpl-1.0 | 60 | affero | affero general public l(?: v| version| ver)? 1(?: 0)?
gfdl-1.3 | 60 | gnu free | gnu free documentation l(?: v| version| ver)? 1 3
gfdl-1.2 | 60 | gnu free | gnu free documentation l(?: v| version| ver)? 1 2
gfdl-1.1 | 60 | gnu free | gnu free documentation l(?: v| version| ver)? 1 1
gpl | 70 | gnu | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?gnu (?:general public l|gpl)
lgpl | 70 | gnu | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?gnu (?:(?:lesser|library) general public l|lgpl)
agpl | 70 | affero | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public l
gpl | 50 | gnu | gnu general public l
lgpl | 50 | gnu | gnu (?:lesser|library) general public l
agpl | 50 | affero | (?:gnu )?affero general public l
gfdl | 50 | gnu free | gnu free documentation l
gpl | 40 | gnu gpl | gnu gpl
lgpl | 40 | gnu lgpl | gnu lgpl
gpl-2.0 | 55 | gplv | l gplv2
gpl-3.0 | 55 | gplv | l gplv3
gpl-exception | 70 | gnu | as a special exception(?: [^ ]+){1,40} gnu general public l
classpath-exception | 70 | classpath exception | gpl(?: v| version)? 2(?: 0)? with (?:the )?classpath exception
mit | 70 | mit licen | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?mit l
mit | 70 | mit licen | this (?:work|file|program|software|library|project) is (?:licensed|distributed|available) under (?:the )?mit l
mit | 80 | mit | https? (?:www )?opensource org licenses mit(?: l(?: php)?)?
mit | 60 | mit licen | see (?:the )?mit l(?: file)?
mit | 50 | mit licen | (?:the )?mit l
mit | 50 | expat licen | (?:the )?expat l
x11 | 50 | x11 licen | (?:the )?x11 l
mit | 40 | mit style | mit style l
bsd-2-clause | 60 | bsd | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) l
bsd-3-clause | 60 | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) l
bsd-4-clause | 60 | bsd | (?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd) l
bsd-0-clause | 60 | bsd | (?:zero clause bsd|bsd zero clause|0bsd) l
bsd | 70 | bsd | (?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)? l
bsd | 75 | bsd | use of this source code is governed by a bsd style l
bsd-3-clause | 80 | bsd | https? (?:www )?opensource org licenses bsd 3 clause
bsd-2-clause | 80 | bsd | https? (?:www )?opensource org licenses bsd 2 clause
bsd | 50 | bsd | bsd(?: style)? l
isc | 70 | isc licen | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc l
isc | 50 | isc licen | (?:the )?isc l
mpl-2.0 | 90 | mozilla | this source code form is subject to the terms of the mozilla public l v 2 0
mpl-1.1 | 90 | mozilla | the contents of this file are subject to the mozilla public l version 1 1
mpl-2.0 | 80 | mozilla | https? (?:www )?mozilla org mpl 2 0
mpl-1.1 | 80 | mozilla | https? (?:www )?mozilla org mpl(?: mpl 1 1(?: html)?)?
mpl-2.0 | 60 | mozilla | mozilla public l(?: v| version| ver)? 2(?: 0)?
mpl-1.1 | 60 | mozilla | mozilla public l(?: v| version| ver)? 1 1
mpl-1.0 | 60 | mozilla | mozilla public l(?: v| version| ver)? 1 0
mpl | 50 | mozilla | mozilla public l
epl-2.0 | 90 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public l(?: v)? 2 0
epl-1.0 | 90 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public l v1 0
epl-2.0 | 60 | eclipse | eclipse public l(?: v| version| ver)? 2(?: 0)?
epl-1.0 | 60 | eclipse | eclipse public l(?: v| version| ver)? 1(?: 0)?
epl | 50 | eclipse | eclipse public l
edl-1.0 | 50 | eclipse | eclipse distribution l(?: v 1 0| version 1 0)?
cpl-1.0 | 50 | common public | common public l(?: v| version)?(?: 1 0)?
cpal-1.0 | 50 | common public | common public attribution l(?: version)?(?: 1 0)?
cddl-1.1 | 60 | common development | common development and distribution l(?: cddl)?(?: v| version)? 1 1
cddl-1.0 | 60 | common development | common development and distribution l(?: cddl)?(?: v| version)? 1 0
cddl | 50 | common development | common development and distribution l
cddl | 80 | common development | the contents of this file are subject to the terms of (?:either the gnu general public l version 2 only gpl or )?the common development and distribution l
eupl-1.2 | 60 | european union | european union public l(?: eupl)?(?: v| version)? 1 2
eupl-1.1 | 60 | european union | european union public l(?: eupl)?(?: v| version)? 1 1
eupl | 50 | european union | european union public l
artistic-2.0 | 60 | artistic | artistic l(?: v| version)? 2(?: 0)?
artistic-1.0 | 60 | artistic | artistic l(?: v| version)? 1(?: 0)?
artistic | 50 | artistic | artistic l
perl | 70 | perl | you can redistribute it and or modify it under the same terms as perl itself
boost-1.0 | 90 | boost | distributed under the boost software l version 1 0
boost-1.0 | 80 | boost | https? www boost org l 1 0 txt
boost | 50 | boost | boost software l
zlib | 50 | zlib | (?:the )?zlib(?: libpng)? l
libpng | 50 | libpng | (?:the )?libpng l
unlicense | 90 | domain | this is free and unencumbered software released into the public domain
unlicense | 80 | unlicense org | https? (?:www )?unlicense org
unlicense | 50 | unlicen | the unlicen[sc]e
wtfpl-2.0 | 60 | want to | do what the fuck you want to public l(?: version)? 2
wtfpl | 50 | want to | do what the fuck you want to public l
psf-2.0 | 60 | python | python software foundation l(?: agreement)?(?: v| version)? 2
psf-2.0 | 60 | psf licen | psf l(?: agreement)?(?: v| version)? 2
psf | 50 | python | python(?: software foundation)? l
php-3.01 | 60 | php licen | php l(?: v| version)? 3 01
php-3.0 | 60 | php licen | php l(?: v| version)? 3 0
php | 50 | php licen | php l
postgresql | 50 | postgresql licen | postgresql l
openssl | 50 | openssl licen | openssl l
ruby | 50 | ruby licen | ruby l
vim | 50 | vim licen | vim l
tcl | 50 | tcl licen | tcl(?: tk)? l
ncsa | 50 | ncsa | (?:university of illinois )?ncsa open source l
upl-1.0 | 50 | universal permissive | universal permissive l(?: v| version)?(?: 1 0)?
osl-3.0 | 60 | open software | open software l(?: v| version)? 3 0
osl | 50 | open software | open software l
afl-3.0 | 60 | academic free | academic free l(?: v| version)? 3 0
afl | 50 | academic free | academic free l
ms-pl | 50 | microsoft | microsoft public l
ms-rl | 50 | microsoft | microsoft reciprocal l
ofl-1.1 | 80 | font licen | this font software is licensed under the sil open font l(?: version)?(?: 1 1)?
ofl-1.1 | 60 | font licen | (?:sil )?open font l(?: v| version)? 1 1
ofl | 50 | font licen | (?:sil )?open font l
odbl-1.0 | 60 | database licen | open (?:data commons open )?database l(?: v| version)?(?: 1 0)
odbl | 50 | database licen | open (?:data commons open )?database l
odc-by | 50 | open data commons | open data commons attribution l
pddl | 50 | open data commons | open data commons public domain dedication(?: and)? l
beerware | 60 | beer | the beer ?ware l
json | 70 | shall be used for good | the software shall be used for good not evil
sspl-1.0 | 50 | server side | server side public l(?: v| version)?(?: 1)?
bsl-1.1 | 50 | business source | business source l(?: v| version)?(?: 1 1)?
elastic-2.0 | 50 | elastic licen | elastic l(?: v| version)?(?: 2 0)?
cc0-1.0 | 80 | creativecommons | https? (?:www )?creativecommons org publicdomain zero 1 0
cc-by-4.0 | 80 | creativecommons | https? (?:www )?creativecommons org licenses by 4 0
cc-by-3.0 | 80 | creativecommons | https? (?:www )?creativecommons org licenses by 3 0
cc-by-2.0 | 80 | creativecommons | https? (?:www )?creativecommons org licenses by 2 0
cc-by-sa-4.0 | 80 | creativecommons | https? (?:www )?creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 80 | creativecommons | https? (?:www )?creativecommons org licenses by sa 3 0
cc-by-nd-4.0 | 80 | creativecommons | https? (?:www )?creativecommons org licenses by nd 4 0
cc-by-nc-4.0 | 80 | creativecommons | https? (?:www )?creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | 80 | creativecommons | https? (?:www )?creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 80 | creativecommons | https? (?:www )?creativecommons org licenses by nc nd 4 0
cc0-1.0 | 60 | cc0 | cc0 1 0(?: universal)?
cc0 | 50 | cc0 | cc0
cc0 | 55 | commons zero | creative commons zero
cc-by-nc-nd-4.0 | 60 | cc by nc nd | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 60 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd | 50 | cc by nc nd | cc by nc nd
cc-by-nc-sa-4.0 | 60 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 60 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa | 50 | cc by nc sa | cc by nc sa
cc-by-nc-4.0 | 60 | cc by nc | cc by nc 4 0
cc-by-nc-3.0 | 60 | cc by nc | cc by nc 3 0
cc-by-nc | 50 | cc by nc | cc by nc
cc-by-sa-4.0 | 60 | cc by sa | cc by sa 4 0
cc-by-sa-3.0 | 60 | cc by sa | cc by sa 3 0
cc-by-sa | 50 | cc by sa | cc by sa
cc-by-nd-4.0 | 60 | cc by nd | cc by nd 4 0
cc-by-nd | 50 | cc by nd | cc by nd
cc-by-4.0 | 60 | cc by | cc by 4 0
cc-by-3.0 | 60 | cc by | cc by 3 0
cc-by-2.5 | 60 | cc by | cc by 2 5
cc-by-2.0 | 60 | cc by | cc by 2 0
cc-by | 40 | cc by | cc by
cc-by-nc-nd | 60 | commercial | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | 60 | commercial | creative commons attribution non ?commercial share ?alike
cc-by-nc | 55 | commercial | creative commons attribution non ?commercial
cc-by-sa-4.0 | 65 | creative commons | creative commons attribution share ?alike 4 0(?: international)?(?: l)?
cc-by-sa-3.0 | 65 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?(?: l)?
cc-by-sa | 60 | creative commons | creative commons attribution share ?alike
cc-by-nd | 60 | creative commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-4.0 | 60 | creative commons | creative commons attribution 4 0(?: international)?(?: l)?
cc-by-3.0 | 60 | creative commons | creative commons attribution 3 0(?: unported)?(?: l)?
cc-by | 50 | creative commons | creative commons attribution
cc | 70 | creative commons | this work is licensed under a creative commons l
cc | 40 | creative commons | creative commons l
public-domain | 60 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 50 | domain | in the public domain
public-domain | 60 | domain | public domain dedication
proprietary | 60 | licen | all rights reserved(?: [^ ]+){0,12} l agreement
eula | 50 | licen | end user l agreement
dual-license | 40 | licen | dual licen[sc]ed under
""".strip()


def signatures() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regex) of each rule, in order."""
    out = []
    for line in TEXT.splitlines():
        label, priority, keyword, regex = (x.strip() for x in line.split("|", 3))
        out.append((label, int(priority), keyword, re.sub(r"(?<![a-z0-9])l(?![a-z0-9])", "licen[sc]e", regex)))
    return out
