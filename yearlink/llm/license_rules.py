"""Signature rules of the licence scan, in order of priority.

A line is ``class | label | confidence | keyword | pattern``.  Class 1 rules
are notices and grants, class 2 identifiers and names with a version, class 3
names, class 4 hints.  Patterns are regular expressions over lower-cased words
separated by one space (a word is a run of ASCII letters, digits and non-ASCII
characters, so ``GPL-2.0+`` reads ``gpl 2 0``); they match whole words, ``_``
is any word.  The keyword is a word that every match holds; a rule is only
tried on texts that have it.  Every match also holds one of ``GATES`` or, as a
whole word, one of ``SHORT``: texts with none of them are not looked at.
"""

GATES = (
    "licen copyright copyleft gpl gnu apache mozilla creative cc0 domain warrant redistribut eclipse artistic boost zlib "
    "bsd wtfpl commons reserved proprietary spdx permission beerware openssl postgresql confidential cddl eupl acknowledg evil unauthorized whatever charityware"
).split()
SHORT = "cc mpl epl osl afl ofl bsl cpl sspl odbl".split()

RULES = """
1 | mit | 0.99 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 | mit | 0.97 | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 | mit | 0.95 | license | (licensed|released|distributed|published|available|provided) under (the )?(terms of )?(the )?(expat|x11|mit)( x11)? license
1 | mit | 0.9 | license | (this|the) (project|software|code|library|package|work|file|program) is (licensed )?under the mit license
1 | mit-0 | 0.95 | license | (licensed|released) under the mit (0|no attribution) license
1 | apache-2.0 | 0.99 | apache | licensed under the apache license( version)? 2 0( the license)?
1 | apache-2.0 | 0.97 | license | you may not use this (file|software|work) except in compliance with the license
1 | apache-2.0 | 0.97 | license | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
1 | apache-2.0 | 0.95 | apache | (released|distributed|published|available|provided) under (the )?(terms of )?(the )?apache( software)? license( version)? 2( 0)?
1 | apache-1.1 | 0.95 | apache | (licensed|released|distributed|published) under the apache( software)? license( version)? 1 1
1 | apache-1.0 | 0.95 | apache | (licensed|released|distributed|published) under the apache( software)? license( version)? 1 0
1 | gpl-3.0-or-later | 0.99 | gnu | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 | gpl-2.0-or-later | 0.99 | gnu | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 | gpl-2.0-only | 0.97 | gnu | under the terms of the gnu general public license version 2 (only )?as published by the free software foundation
1 | gpl-3.0-only | 0.97 | gnu | under the terms of the gnu general public license version 3 (only )?as published by the free software foundation
1 | gpl-3.0 | 0.97 | gnu | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?gnu general public license( gpl)?( version| v)? (3|v3)( 0)?
1 | gpl-2.0 | 0.97 | gnu | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?gnu general public license( gpl)?( version| v)? (2|v2)( 0)?
1 | gpl-1.0 | 0.95 | gnu | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?gnu general public license( gpl)?( version| v)? (1|v1)( 0)?
1 | gpl | 0.85 | program | this program is free software you can redistribute it and or modify it
1 | gpl | 0.9 | gnu | you should have received a copy of the gnu general public license along with this (program|software|library|file)
1 | gpl | 0.85 | gnu | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?gnu general public license
1 | lgpl-3.0-or-later | 0.98 | gnu | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 | lgpl-2.1-or-later | 0.98 | gnu | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
1 | lgpl-2.0-or-later | 0.98 | gnu | under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 | lgpl-3.0 | 0.95 | gnu | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?gnu lesser general public license( version| v)? (3|v3)( 0)?
1 | lgpl-2.1 | 0.95 | gnu | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?gnu lesser general public license( version| v)? (2|v2) 1
1 | lgpl-2.0 | 0.95 | gnu | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?gnu library general public license( version| v)? (2|v2)( 0)?
1 | agpl-3.0-or-later | 0.98 | gnu | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 | agpl-3.0 | 0.95 | gnu | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?gnu affero general public license( version| v)? (3|v3)( 0)?
1 | agpl-3.0 | 0.9 | affero | you should have received a copy of the gnu affero general public license along with this (program|software|library|file)
1 | gfdl | 0.95 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 | gfdl-1.3 | 0.97 | documentation | under the terms of the gnu free documentation license version 1 3
1 | gfdl-1.2 | 0.97 | documentation | under the terms of the gnu free documentation license version 1 2
1 | bsd | 0.95 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
1 | bsd | 0.85 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
1 | bsd | 0.85 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
1 | bsd-3-clause | 0.95 | permission | neither the name of (the )?(_ )?(_ )?(_ )?(_ )?nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
1 | bsd-4-clause | 0.95 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
1 | bsd-3-clause | 0.95 | bsd | (licensed|released|distributed|published) under (the )?(terms of )?(the )?(3 clause |new |modified |revised )bsd( license)?
1 | bsd-2-clause | 0.95 | bsd | (licensed|released|distributed|published) under (the )?(terms of )?(the )?(2 clause |simplified )bsd( license)?
1 | bsd | 0.85 | bsd | (licensed|released|distributed|published) under (the )?(terms of )?(the |a )?bsd( style)? license
1 | isc | 0.97 | copyright | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
1 | isc | 0.93 | license | (licensed|released|distributed|published) under (the )?(terms of )?(the )?isc license
1 | 0bsd | 0.95 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 | zlib | 0.95 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
1 | zlib | 0.93 | permission | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
1 | zlib | 0.9 | zlib | (licensed|released|distributed|published) under (the )?(terms of )?(the )?zlib( libpng)? license
1 | bsl-1.0 | 0.97 | boost | distributed under the boost software license version 1 0
1 | bsl-1.0 | 0.95 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
1 | mpl-2.0 | 0.98 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
1 | mpl-2.0 | 0.95 | mozilla | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?mozilla public license( version| v)? (2|v2)( 0)?
1 | mpl-1.1 | 0.97 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
1 | mpl-1.0 | 0.97 | mozilla | the contents of this file are subject to the mozilla public license version 1 0
1 | epl-2.0 | 0.97 | eclipse | (made available|licensed|released|distributed|published) under the terms of the eclipse public license( version| v)? (2|v2)( 0)?
1 | epl-1.0 | 0.97 | eclipse | (made available|licensed|released|distributed|published) under the terms of the eclipse public license( version| v)? (1|v1)( 0)?
1 | cddl-1.0 | 0.95 | license | the contents of this file are subject to the terms of the common development and distribution license
1 | artistic-2.0 | 0.93 | artistic | under the terms of the artistic license( version)? 2 0
1 | perl | 0.9 | redistribute | you can redistribute it and or modify it under the same terms as perl itself
1 | python | 0.93 | license | this (software|module) is licensed under the (python software foundation|psf) license
1 | unlicense | 0.97 | domain | this is free and unencumbered software released into the public domain
1 | public-domain | 0.9 | domain | (this (work|file|code|software|program|document) )?(is|has been|was) (hereby )?(released|placed|dedicated|put) (in|into|to) the public domain
1 | cc0-1.0 | 0.95 | copyright | to the extent possible under law (the )?(_ )?(_ )?(author|authors|person who associated cc0 with this work) (has|have) (dedicated|waived) all copyright
1 | cc0-1.0 | 0.95 | cc0 | (licensed|released|published|available|dedicated) (under|to) (the )?(creative commons )?cc0
1 | cc-by-nc-nd-4.0 | 0.97 | noncommercial | licensed under (a |the )?creative commons attribution noncommercial (no derivatives|noderivatives) 4 0( international)?( license)?
1 | cc-by-nc-sa-4.0 | 0.97 | noncommercial | licensed under (a |the )?creative commons attribution noncommercial (share alike|sharealike) 4 0( international)?( license)?
1 | cc-by-nc-4.0 | 0.97 | noncommercial | licensed under (a |the )?creative commons attribution noncommercial 4 0( international)?( license)?
1 | cc-by-nd-4.0 | 0.97 | attribution | licensed under (a |the )?creative commons attribution (no derivatives|noderivatives) 4 0( international)?( license)?
1 | cc-by-sa-4.0 | 0.97 | attribution | licensed under (a |the )?creative commons attribution (share alike|sharealike) 4 0( international)?( license)?
1 | cc-by-4.0 | 0.97 | attribution | licensed under (a |the )?creative commons attribution 4 0( international)?( license)?
1 | cc-by-nc-nd-3.0 | 0.97 | noncommercial | licensed under (a |the )?creative commons attribution noncommercial (no derivs|noderivs) 3 0( unported)?( license)?
1 | cc-by-nc-sa-3.0 | 0.97 | noncommercial | licensed under (a |the )?creative commons attribution noncommercial (share alike|sharealike) 3 0( unported)?( license)?
1 | cc-by-nc-3.0 | 0.97 | noncommercial | licensed under (a |the )?creative commons attribution noncommercial 3 0( unported)?( license)?
1 | cc-by-nd-3.0 | 0.97 | attribution | licensed under (a |the )?creative commons attribution (no derivs|noderivs) 3 0( unported)?( license)?
1 | cc-by-sa-3.0 | 0.97 | attribution | licensed under (a |the )?creative commons attribution (share alike|sharealike) 3 0( unported)?( license)?
1 | cc-by-3.0 | 0.97 | attribution | licensed under (a |the )?creative commons attribution 3 0( unported)?( license)?
1 | ofl-1.1 | 0.97 | license | this font software is licensed under the sil open font license version 1 1
1 | odbl-1.0 | 0.95 | license | (made available|licensed|released|published) under the open (data commons open )?database license
1 | odc-by-1.0 | 0.95 | commons | (made available|licensed|released|published) under the open data commons attribution license
1 | pddl-1.0 | 0.95 | domain | (made available|licensed|released|published) under the (open data commons )?public domain dedication and license
1 | sspl-1.0 | 0.95 | license | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?server side public license( version| v)?( 1)?
1 | busl-1.1 | 0.95 | license | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?business source license( 1 1)?
1 | elastic-2.0 | 0.95 | elastic | (licensed|released|distributed|published|available) under (the )?(terms of )?(the )?elastic license( version)?( 2 0)?
1 | wtfpl | 0.95 | license | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
1 | gpl-text | 0.9 | license | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
1 | beerware | 0.95 | whatever | as long as you retain this notice you can do whatever you want with this stuff
1 | openssl | 0.93 | openssl | this product includes software developed by the openssl project
1 | apache-1.1 | 0.9 | apache | this product includes software developed by the apache software foundation
1 | postgresql | 0.95 | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
1 | ntp | 0.9 | permission | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
1 | w3c | 0.95 | licensee | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions
1 | eupl-1.2 | 0.95 | licensed | licensed under the (eupl|european union public licen[cs]e)( version| v)? 1 2
1 | eupl-1.1 | 0.95 | licensed | licensed under the (eupl|european union public licen[cs]e)( version| v)? 1 1
1 | mulan-2.0 | 0.95 | mulan | licensed under (the )?mulan psl( license)? v2
1 | vim | 0.9 | charityware | vim is charityware you can use and copy it as much as you like
1 | json | 0.93 | shall | the software shall be used for good not evil
1 | llama-community | 0.93 | license | (is )?licensed under the llama [0-9]+( [0-9]+)? community license
1 | openrail | 0.93 | license | (licensed|released|published|available) under (the |a )?(_ )?(open rail|openrail)( _)? license
1 | proprietary | 0.9 | permission | no part of this (publication|document|work|book) may be reproduced (distributed |stored )?(_ )?(_ )?(_ )?without (the )?(prior )?(written )?permission
1 | proprietary | 0.9 | reserved | this (software|document|file|work) is (the )?(proprietary|confidential)( and confidential| and proprietary)?( _)?( _)? all rights reserved
1 | proprietary | 0.9 | copying | unauthorized copying of this file via any medium is strictly prohibited
2 | mit | 0.9 | license | spdx license identifier mit
2 | apache-2.0 | 0.97 | license | spdx license identifier apache 2 0
2 | bsd-2-clause | 0.97 | license | spdx license identifier bsd 2 clause
2 | bsd-3-clause | 0.97 | license | spdx license identifier bsd 3 clause
2 | isc | 0.97 | license | spdx license identifier isc
2 | gpl-2.0-or-later | 0.97 | license | spdx license identifier gpl 2 0 or later
2 | gpl-2.0-only | 0.97 | license | spdx license identifier gpl 2 0( only)?
2 | gpl-3.0-or-later | 0.97 | license | spdx license identifier gpl 3 0 or later
2 | gpl-3.0-only | 0.97 | license | spdx license identifier gpl 3 0( only)?
2 | lgpl-2.1-or-later | 0.97 | license | spdx license identifier lgpl 2 1 or later
2 | lgpl-2.1-only | 0.97 | license | spdx license identifier lgpl 2 1( only)?
2 | lgpl-3.0-or-later | 0.97 | license | spdx license identifier lgpl 3 0 or later
2 | lgpl-3.0-only | 0.97 | license | spdx license identifier lgpl 3 0( only)?
2 | agpl-3.0-or-later | 0.97 | license | spdx license identifier agpl 3 0 or later
2 | agpl-3.0-only | 0.97 | license | spdx license identifier agpl 3 0( only)?
2 | mpl-2.0 | 0.97 | license | spdx license identifier mpl 2 0
2 | epl-2.0 | 0.97 | license | spdx license identifier epl 2 0
2 | cc0-1.0 | 0.97 | license | spdx license identifier cc0 1 0
2 | unlicense | 0.97 | license | spdx license identifier unlicense
2 | zlib | 0.97 | license | spdx license identifier zlib
2 | bsl-1.0 | 0.97 | license | spdx license identifier bsl 1 0
2 | mit | 0.9 | licenses | opensource org licenses mit( license)?( php)?
2 | apache-2.0 | 0.95 | apache | (www )?apache org licenses license 2 0( txt| html)?
2 | apache-1.1 | 0.95 | apache | (www )?apache org licenses license 1 1
2 | gpl-2.0 | 0.9 | gnu | (www )?gnu org licenses (old licenses )?gpl 2 0( html| txt)?
2 | gpl-3.0 | 0.9 | gnu | (www )?gnu org licenses gpl 3 0( html| txt)?
2 | gpl | 0.8 | gnu | (www )?gnu org licenses gpl( html)?
2 | lgpl-2.1 | 0.9 | gnu | (www )?gnu org licenses (old licenses )?lgpl 2 1( html| txt)?
2 | lgpl-3.0 | 0.9 | gnu | (www )?gnu org licenses lgpl 3 0( html| txt)?
2 | agpl-3.0 | 0.9 | gnu | (www )?gnu org licenses agpl 3 0( html| txt)?
2 | gfdl | 0.85 | gnu | (www )?gnu org (licenses|copyleft) fdl( 1 [0-9])?( html| txt)?
2 | mpl-2.0 | 0.95 | mozilla | (www )?mozilla org (mpl|en us mpl|mpl mpl) 2 0
2 | mpl-1.1 | 0.95 | mozilla | (www )?mozilla org mpl( mpl)? 1 1
2 | epl-1.0 | 0.95 | eclipse | (www )?eclipse org legal epl v10( html)?
2 | epl-2.0 | 0.95 | eclipse | (www )?eclipse org legal epl (2 0|v20)( html)?
2 | bsl-1.0 | 0.95 | boost | (www )?boost org license 1 0( txt)?
2 | cc0-1.0 | 0.95 | creativecommons | creativecommons org publicdomain zero 1 0
2 | public-domain | 0.9 | creativecommons | creativecommons org publicdomain mark 1 0
2 | cc-by-4.0 | 0.95 | creativecommons | creativecommons org licenses by 4 0
2 | cc-by-sa-4.0 | 0.95 | creativecommons | creativecommons org licenses by sa 4 0
2 | cc-by-nd-4.0 | 0.95 | creativecommons | creativecommons org licenses by nd 4 0
2 | cc-by-nc-4.0 | 0.95 | creativecommons | creativecommons org licenses by nc 4 0
2 | cc-by-nc-sa-4.0 | 0.95 | creativecommons | creativecommons org licenses by nc sa 4 0
2 | cc-by-nc-nd-4.0 | 0.95 | creativecommons | creativecommons org licenses by nc nd 4 0
2 | cc-by-3.0 | 0.95 | creativecommons | creativecommons org licenses by 3 0
2 | cc-by-sa-3.0 | 0.95 | creativecommons | creativecommons org licenses by sa 3 0
2 | cc-by-nc-3.0 | 0.95 | creativecommons | creativecommons org licenses by nc 3 0
2 | cc-by-nc-sa-3.0 | 0.95 | creativecommons | creativecommons org licenses by nc sa 3 0
2 | cc-by-nc-nd-3.0 | 0.95 | creativecommons | creativecommons org licenses by nc nd 3 0
2 | cc-by-sa-2.0 | 0.95 | creativecommons | creativecommons org licenses by sa 2 [05]
2 | apache-2.0 | 0.9 | apache | apache( software)? license( version| v)? (2|v2)( 0)?
2 | apache-2.0 | 0.85 | apache | apache 2 0
2 | apache-2.0 | 0.8 | apache | apache (2|v2) license
2 | apache-1.1 | 0.9 | apache | apache( software)? license( version| v)? 1 1
2 | apache-1.0 | 0.9 | apache | apache( software)? license( version| v)? 1 0
2 | gpl-3.0 | 0.9 | general | (gnu )?general public license( gpl)?( version| v)? (3|v3)( 0)?
2 | gpl-2.0 | 0.9 | general | (gnu )?general public license( gpl)?( version| v)? (2|v2)( 0)?
2 | gpl-3.0-or-later | 0.85 | gpl | gpl 3 0 or later
2 | gpl-3.0-only | 0.85 | gpl | gpl 3 0 only
2 | gpl-2.0-or-later | 0.85 | gpl | gpl 2 0 or later
2 | gpl-2.0-only | 0.85 | gpl | gpl 2 0 only
2 | gpl-3.0 | 0.8 | gpl | (gnu )?gpl( version| v)? (3|v3)( 0)?
2 | gpl-2.0 | 0.8 | gpl | (gnu )?gpl( version| v)? (2|v2)( 0)?
2 | gpl-3.0 | 0.8 | gplv3 | (gnu )?gplv3
2 | gpl-2.0 | 0.8 | gplv2 | (gnu )?gplv2
2 | lgpl-3.0 | 0.9 | lesser | (gnu )?lesser general public license( lgpl)?( version| v)? (3|v3)( 0)?
2 | lgpl-2.1 | 0.9 | lesser | (gnu )?lesser general public license( lgpl)?( version| v)? (2|v2) 1
2 | lgpl-3.0 | 0.8 | lgpl | (gnu )?lgpl( version| v)? (3|v3)( 0)?
2 | lgpl-2.1 | 0.8 | lgpl | (gnu )?lgpl( version| v)? (2|v2) 1
2 | lgpl-3.0 | 0.8 | lgplv3 | (gnu )?lgplv3
2 | agpl-3.0 | 0.9 | affero | (gnu )?affero general public license( agpl)?( version| v)? (3|v3)( 0)?
2 | agpl-3.0 | 0.8 | agpl | (gnu )?agpl( version| v)? (3|v3)( 0)?
2 | agpl-3.0 | 0.8 | agplv3 | (gnu )?agplv3
2 | mpl-2.0 | 0.9 | mozilla | mozilla public license( mpl)?( version| v)? (2|v2)( 0)?
2 | mpl-1.1 | 0.9 | mozilla | mozilla public license( mpl)?( version| v)? 1 1
2 | mpl-2.0 | 0.8 | mpl | mpl( version| v)? 2 0
2 | mpl-1.1 | 0.8 | mpl | mpl( version| v)? 1 1
2 | epl-2.0 | 0.9 | eclipse | eclipse public license( epl)?( version| v)? (2|v2)( 0)?
2 | epl-1.0 | 0.9 | eclipse | eclipse public license( epl)?( version| v)? (1|v1)( 0)?
2 | epl-2.0 | 0.8 | epl | epl( version| v)? 2 0
2 | epl-1.0 | 0.8 | epl | epl( version| v)? 1 0
2 | cddl-1.0 | 0.85 | cddl | cddl( license)?( version| v)? 1 0
2 | cddl-1.1 | 0.85 | cddl | cddl( license)?( version| v)? 1 1
2 | artistic-2.0 | 0.85 | artistic | artistic license( version| v)? 2( 0)?
2 | artistic-1.0 | 0.85 | artistic | artistic license( version| v)? 1( 0)?
2 | bsl-1.0 | 0.85 | boost | boost software license( version| v)?( 1 0)?
2 | bsl-1.0 | 0.75 | bsl | bsl 1 0
2 | bsd-3-clause | 0.85 | bsd | bsd 3 clause( license)?
2 | bsd-3-clause | 0.85 | bsd | (3|three) clause bsd( license)?
2 | bsd-3-clause | 0.85 | bsd | (new|modified|revised) bsd license
2 | bsd-2-clause | 0.85 | bsd | bsd 2 clause( license)?
2 | bsd-2-clause | 0.85 | bsd | (2|two) clause bsd( license)?
2 | bsd-2-clause | 0.85 | bsd | (simplified|freebsd) bsd license
2 | bsd-4-clause | 0.85 | bsd | (4 clause |four clause |original |old )bsd( license)?
2 | 0bsd | 0.85 | 0bsd | 0bsd( license)?
2 | cc-by-nc-nd-4.0 | 0.9 | cc | cc by nc nd 4 0
2 | cc-by-nc-sa-4.0 | 0.9 | cc | cc by nc sa 4 0
2 | cc-by-nc-4.0 | 0.9 | cc | cc by nc 4 0
2 | cc-by-nd-4.0 | 0.9 | cc | cc by nd 4 0
2 | cc-by-sa-4.0 | 0.9 | cc | cc by sa 4 0
2 | cc-by-4.0 | 0.9 | cc | cc by 4 0
2 | cc-by-nc-nd-3.0 | 0.9 | cc | cc by nc nd 3 0
2 | cc-by-nc-sa-3.0 | 0.9 | cc | cc by nc sa 3 0
2 | cc-by-nc-3.0 | 0.9 | cc | cc by nc 3 0
2 | cc-by-nd-3.0 | 0.9 | cc | cc by nd 3 0
2 | cc-by-sa-3.0 | 0.9 | cc | cc by sa 3 0
2 | cc-by-3.0 | 0.9 | cc | cc by 3 0
2 | cc-by-sa-2.5 | 0.9 | cc | cc by sa 2 5
2 | cc-by-sa-2.0 | 0.9 | cc | cc by sa 2 0
2 | cc-by-2.5 | 0.9 | cc | cc by 2 5
2 | cc-by-2.0 | 0.9 | cc | cc by 2 0
2 | cc0-1.0 | 0.9 | cc0 | cc0( 1 0)?( universal)?
2 | ofl-1.1 | 0.85 | ofl | (sil )?ofl( version| v)? 1 1
2 | osl-3.0 | 0.85 | osl | osl( version| v)? 3 0
2 | afl-3.0 | 0.85 | afl | afl( version| v)? 3 0
2 | cpl-1.0 | 0.85 | cpl | cpl( version| v)? 1 0
2 | odbl-1.0 | 0.85 | odbl | odbl( version| v)?( 1 0)?
2 | sspl-1.0 | 0.85 | sspl | sspl( version| v)?( 1)?( 0)?
2 | eupl-1.2 | 0.85 | eupl | eupl( version| v)? 1 2
2 | eupl-1.1 | 0.85 | eupl | eupl( version| v)? 1 1
3 | mit | 0.8 | license | (expat|x11) license
3 | mit | 0.75 | licence | mit licence
3 | mit | 0.7 | licensed | mit licensed
3 | mit-0 | 0.8 | license | mit (0|no attribution) license
3 | apache | 0.75 | apache | apache software license
3 | apache | 0.7 | licence | apache licence
3 | apache | 0.7 | licensed | apache licensed
3 | gpl | 0.75 | gnu | gnu general public licen[cs]e
3 | gpl | 0.7 | gnu | gnu public licen[cs]e
3 | gpl | 0.65 | gnu | gnu gpl
3 | gpl | 0.6 | gpl | gpl( license| licensed| licence)?
3 | lgpl | 0.8 | lesser | (gnu )?lesser general public licen[cs]e
3 | lgpl | 0.8 | library | (gnu )?library general public licen[cs]e
3 | lgpl | 0.65 | lgpl | (gnu )?lgpl( license| licensed)?
3 | agpl | 0.8 | affero | (gnu )?affero general public licen[cs]e
3 | agpl | 0.65 | agpl | (gnu )?agpl( license| licensed)?
3 | gfdl | 0.8 | documentation | (gnu )?free documentation license
3 | bsd | 0.7 | bsd | bsd( style)? licen[cs]e
3 | bsd | 0.65 | bsd | bsd licensed
3 | isc | 0.75 | isc | isc license
3 | zlib | 0.75 | zlib | zlib( libpng)? license
3 | libpng | 0.75 | libpng | libpng license
3 | mpl | 0.75 | mozilla | mozilla public licen[cs]e
3 | epl | 0.75 | eclipse | eclipse public licen[cs]e
3 | cddl | 0.75 | license | common development and distribution license
3 | cpl | 0.75 | license | common public license
3 | ipl | 0.75 | license | ibm public license
3 | npl | 0.75 | license | netscape public license
3 | qpl | 0.75 | license | q public license
3 | osl | 0.75 | license | open software license
3 | afl | 0.75 | license | academic free license
3 | artistic | 0.75 | artistic | (perl )?artistic licen[cs]e
3 | clarified-artistic | 0.8 | artistic | clarified artistic license
3 | python | 0.75 | license | python software foundation license
3 | ruby | 0.7 | license | ruby( s)? license
3 | php | 0.75 | license | php license( version)?( 3 01| 3 0)?
3 | postgresql | 0.75 | postgresql | postgresql license
3 | openssl | 0.75 | openssl | openssl license
3 | curl | 0.7 | license | curl license
3 | unlicense | 0.75 | unlicense | (the )?unlicense
3 | wtfpl | 0.8 | wtfpl | wtfpl( version| v)?( 2)?
3 | beerware | 0.8 | license | (beer ware|beerware) license
3 | eupl | 0.75 | union | european union public licen[cs]e
3 | cecill | 0.75 | license | cecill( b| c| 2 0| 2 1)? license
3 | ofl | 0.75 | license | (sil )?open font license
3 | odbl | 0.75 | license | open database license
3 | odc-by | 0.75 | license | open data commons attribution license
3 | open-government | 0.75 | licence | open government licence( v[0-9])?
3 | ms-pl | 0.75 | microsoft | microsoft public license
3 | ms-rl | 0.75 | license | microsoft reciprocal license
3 | sspl | 0.75 | license | server side public license
3 | busl | 0.75 | license | business source license
3 | elastic | 0.7 | license | elastic license
3 | commons-clause | 0.75 | commons | commons clause
3 | polyform | 0.75 | license | polyform (noncommercial|small business|strict|shield) license
3 | llama-community | 0.75 | license | llama( [0-9]+)?( [0-9]+)? community license
3 | openrail | 0.7 | license | (bigscience|bigcode|creativeml)( open)?( rail| openrail)( m)? license
3 | w3c | 0.75 | license | w3c( software)?( notice and)?( document)? license
3 | upl | 0.75 | license | universal permissive license
3 | ncsa | 0.75 | license | (university of illinois )?(ncsa )?open source license
3 | mulan | 0.7 | license | mulan( permissive software)? license
3 | vim | 0.7 | license | vim license
3 | json | 0.7 | license | json license
3 | sleepycat | 0.75 | license | sleepycat license
3 | lppl | 0.75 | license | latex project public license
3 | cc | 0.7 | creative | creative commons( _)? licen[cs]e
3 | cc | 0.6 | creative | creative commons
3 | cc-by-nc-nd | 0.85 | cc | (licensed|released|published|available) under (a |the )?cc by nc nd
3 | cc-by-nc-sa | 0.85 | cc | (licensed|released|published|available) under (a |the )?cc by nc sa
3 | cc-by-nc | 0.85 | cc | (licensed|released|published|available) under (a |the )?cc by nc
3 | cc-by-nd | 0.85 | cc | (licensed|released|published|available) under (a |the )?cc by nd
3 | cc-by-sa | 0.85 | cc | (licensed|released|published|available) under (a |the )?cc by sa
3 | cc-by | 0.85 | cc | (licensed|released|published|available) under (a |the )?cc by
3 | cc-by-nc-nd | 0.75 | cc | cc by nc nd
3 | cc-by-nc-sa | 0.75 | cc | cc by nc sa
3 | cc-by-nc | 0.75 | cc | cc by nc
3 | cc-by-nd | 0.75 | cc | cc by nd
3 | cc-by-sa | 0.75 | cc | cc by sa
3 | cc-by | 0.75 | cc | cc by
3 | public-domain | 0.6 | domain | (in|into|to) the public domain
4 | proprietary | 0.3 | reserved | all rights reserved
4 | proprietary | 0.35 | proprietary | proprietary (license|software|and confidential)
4 | proprietary | 0.35 | confidential | strictly confidential
4 | copyleft | 0.3 | copyleft | copyleft
4 | warranty-disclaimer | 0.3 | warranty | without( any)? warranty( of any kind)?
4 | warranty-disclaimer | 0.3 | warranties | without warranties or conditions of any kind
4 | copyright | 0.2 | copyright | copyright (c )?[0-9]+( [0-9]+)?
4 | copyright | 0.2 | copyright | copyright notice
4 | open-source | 0.25 | license | open source license
4 | license-mention | 0.15 | license | license agreement
4 | license-mention | 0.15 | licensed | licensed (under|by|to)
4 | license-mention | 0.15 | licence | under licence
"""
