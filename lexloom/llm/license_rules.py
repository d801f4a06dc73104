"""Ordered signature rules for licences, over texts reduced to lower-case words joined by single spaces.

One rule a line: priority, label, keyword, pattern. A rule is tried only on texts that hold its
keyword, which is part of all that its pattern matches. A smaller priority is stronger; at equal priority the longer match is, then the earlier rule.
Patterns hold only bounded repetition.
"""

TEXT = r"""
10 mit permission is hereby granted
 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
10 bsd-3-clause neither the name
 redistribution and use in source and binary forms (?:\S+ ){1,120}?neither the name
10 bsd-2-clause redistribution and use
 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
10 isc permission to use copy
 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
10 0bsd permission to use copy
 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
10 unlicense free and unencumbered
 this is free and unencumbered software released into the public domain
10 zlib altered source versions
 altered source versions must be plainly marked as such
10 bsl-1.0 person or organization obtaining
 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
10 wtfpl copy and distribute verbatim
 everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
10 postgresql permission to use copy
 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
10 apache-2.0 you may not use this file
 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
10 gpl-3.0-or-later any later version
 gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
10 gpl-2.0-or-later any later version
 gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
10 lgpl-3.0-or-later any later version
 gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
10 lgpl-2.1-or-later any later version
 gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
10 agpl-3.0-or-later any later version
 gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
10 gfdl-1.3-or-later any later version
 gnu free documentation license version 1 3 or any later version
10 gfdl-1.2-or-later any later version
 gnu free documentation license version 1 2 or any later version
10 mpl-2.0 mozilla public license
 this source code form is subject to the terms of the mozilla public license v 2 0
10 epl-2.0 eclipse public license
 made available under the terms of the eclipse public license (?:v|version) ?2 0
10 epl-1.0 eclipse public license
 made available under the terms of the eclipse public license (?:v|version) ?1 0
18 spdx spdx license identifier
 spdx license identifier \S+
16 mit spdx license identifier
 spdx license identifier mit(?! 0)
16 mit-0 spdx license identifier
 spdx license identifier mit 0
16 isc spdx license identifier
 spdx license identifier isc
16 apache-2.0 spdx license identifier
 spdx license identifier apache 2 0
16 gpl-2.0-only spdx license identifier
 spdx license identifier gpl 2 0 only
16 gpl-2.0-or-later spdx license identifier
 spdx license identifier gpl 2 0 or later
16 gpl-3.0-only spdx license identifier
 spdx license identifier gpl 3 0 only
16 gpl-3.0-or-later spdx license identifier
 spdx license identifier gpl 3 0 or later
16 lgpl-2.1 spdx license identifier
 spdx license identifier lgpl 2 1(?: only| or later)?
16 lgpl-3.0 spdx license identifier
 spdx license identifier lgpl 3 0(?: only| or later)?
16 agpl-3.0 spdx license identifier
 spdx license identifier agpl 3 0(?: only| or later)?
16 bsd-2-clause spdx license identifier
 spdx license identifier bsd 2 clause
16 bsd-3-clause spdx license identifier
 spdx license identifier bsd 3 clause
16 mpl-2.0 spdx license identifier
 spdx license identifier mpl 2 0
16 epl-2.0 spdx license identifier
 spdx license identifier epl 2 0
16 unlicense spdx license identifier
 spdx license identifier unlicense
16 cc0-1.0 spdx license identifier
 spdx license identifier cc0 1 0
16 cc-by-4.0 spdx license identifier
 spdx license identifier cc by 4 0
16 cc-by-sa-4.0 spdx license identifier
 spdx license identifier cc by sa 4 0
16 zlib spdx license identifier
 spdx license identifier zlib
16 bsl-1.0 spdx license identifier
 spdx license identifier bsl 1 0
20 gpl-3.0 gnu general public license
 gnu general public license (?:v|version)? ?3(?: 0)?
20 gpl-2.0 gnu general public license
 gnu general public license (?:v|version)? ?2(?: 0)?
20 gpl-1.0 gnu general public license
 gnu general public license (?:v|version)? ?1(?: 0)?
20 lgpl-3.0 gnu lesser general public
 gnu lesser general public license (?:v|version)? ?3(?: 0)?
20 lgpl-2.1 gnu lesser general public
 gnu lesser general public license (?:v|version)? ?2 1
20 lgpl-2.0 gnu library general public
 gnu library general public license (?:v|version)? ?2(?: 0)?
20 agpl-3.0 affero general public
 (?:gnu )?affero general public license (?:v|version)? ?3(?: 0)?
20 agpl-1.0 affero general public
 (?:gnu )?affero general public license (?:v|version)? ?1(?: 0)?
20 gfdl-1.3 gnu free documentation
 gnu free documentation license (?:v|version)? ?1 3
20 gfdl-1.2 gnu free documentation
 gnu free documentation license (?:v|version)? ?1 2
20 gfdl-1.1 gnu free documentation
 gnu free documentation license (?:v|version)? ?1 1
20 apache-2.0 apache license
 apache license (?:v|version)? ?2(?: 0)?
20 apache-2.0 apache 2
 apache 2 0 license
20 apache-1.1 apache
 apache (?:software )?license (?:v|version)? ?1 1
20 apache-1.0 apache
 apache (?:software )?license (?:v|version)? ?1 0
20 apache-2.0 apache software license
 apache software license (?:v|version)? ?2(?: 0)?
20 mpl-2.0 mozilla public license
 mozilla public license (?:v|version)? ?2(?: 0)?
20 mpl-1.1 mozilla public license
 mozilla public license (?:v|version)? ?1 1
20 mpl-1.0 mozilla public license
 mozilla public license (?:v|version)? ?1 0
20 epl-2.0 eclipse public license
 eclipse public license (?:v|version)? ?2(?: 0)?
20 epl-1.0 eclipse public license
 eclipse public license (?:v|version)? ?1(?: 0)?
20 edl-1.0 eclipse distribution license
 eclipse distribution license (?:v|version)? ?1(?: 0)?
20 eupl-1.2 european union public
 european union public licen[cs]e (?:v|version)? ?1 2
20 eupl-1.1 european union public
 european union public licen[cs]e (?:v|version)? ?1 1
20 cddl-1.1 common development and distribution
 common development and distribution license (?:cddl )?(?:v|version)? ?1 1
20 cddl-1.0 common development and distribution
 common development and distribution license (?:cddl )?(?:v|version)? ?1 0
20 cpl-1.0 common public license
 common public license (?:v|version)? ?1(?: 0)?
20 artistic-2.0 artistic license
 artistic license (?:v|version)? ?2(?: 0)?
20 artistic-1.0 artistic license
 artistic license (?:v|version)? ?1(?: 0)?
20 osl-3.0 open software license
 open software license (?:v|version)? ?3(?: 0)?
20 osl-2.1 open software license
 open software license (?:v|version)? ?2 1
20 afl-3.0 academic free license
 academic free license (?:v|version)? ?3(?: 0)?
20 afl-2.1 academic free license
 academic free license (?:v|version)? ?2 1
20 ofl-1.1 open font license
 (?:sil )?open font license (?:v|version)? ?1 1
20 ofl-1.0 open font license
 (?:sil )?open font license (?:v|version)? ?1 0
20 odbl-1.0 open database license
 open (?:data commons open )?database license (?:v|version)? ?1 0
20 odc-by-1.0 open data commons attribution
 open data commons attribution license (?:v|version)? ?1 0
20 pddl-1.0 public domain dedication and license
 (?:open data commons )?public domain dedication and license (?:v|version)? ?1 0
20 ogl-3.0 open government licen
 open government licen[cs]e (?:v|version)? ?3(?: 0)?
20 ogl-2.0 open government licen
 open government licen[cs]e (?:v|version)? ?2(?: 0)?
20 ogl-1.0 open government licen
 open government licen[cs]e (?:v|version)? ?1(?: 0)?
20 bsl-1.0 boost software license
 boost software license (?:v|version)? ?1 0
20 busl-1.1 business source license
 business source license (?:v|version)? ?1 1
20 sspl-1.0 server side public license
 server side public license (?:v|version)? ?1
20 elastic-2.0 elastic license
 elastic license (?:v|version)? ?2(?: 0)?
20 polyform-noncommercial-1.0.0 polyform noncommercial
 polyform noncommercial license (?:v|version)? ?1 0 0
20 polyform-shield-1.0.0 polyform shield
 polyform shield license (?:v|version)? ?1 0 0
20 polyform-small-business-1.0.0 polyform small business
 polyform small business license (?:v|version)? ?1 0 0
20 bigscience-openrail-m openrail
 (?:bigscience )?openrail m
20 creativeml-openrail-m creativeml
 creativeml openrail m
20 bigscience-bloom-rail-1.0 bloom rail
 bigscience bloom rail (?:v|version)? ?1 0
20 llama-community community license
 llama \d(?: \d)? community license(?: agreement)?
20 gemma gemma terms of use
 gemma terms of use
20 cc0-1.0 cc0
 cc0(?: v| version)? ?1 0(?: universal)?
20 cc-by-nc-nd-4.0 cc by nc nd
 cc by nc nd (?:v|version)? ?4 0
20 cc-by-nc-nd-3.0 cc by nc nd
 cc by nc nd (?:v|version)? ?3 0
20 cc-by-nc-nd-2.5 cc by nc nd
 cc by nc nd (?:v|version)? ?2 5
20 cc-by-nc-nd-2.0 cc by nc nd
 cc by nc nd (?:v|version)? ?2 0
20 cc-by-nc-sa-4.0 cc by nc sa
 cc by nc sa (?:v|version)? ?4 0
20 cc-by-nc-sa-3.0 cc by nc sa
 cc by nc sa (?:v|version)? ?3 0
20 cc-by-nc-sa-2.5 cc by nc sa
 cc by nc sa (?:v|version)? ?2 5
20 cc-by-nc-sa-2.0 cc by nc sa
 cc by nc sa (?:v|version)? ?2 0
20 cc-by-nc-4.0 cc by nc
 cc by nc (?:v|version)? ?4 0
20 cc-by-nc-3.0 cc by nc
 cc by nc (?:v|version)? ?3 0
20 cc-by-nc-2.5 cc by nc
 cc by nc (?:v|version)? ?2 5
20 cc-by-nc-2.0 cc by nc
 cc by nc (?:v|version)? ?2 0
20 cc-by-nd-4.0 cc by nd
 cc by nd (?:v|version)? ?4 0
20 cc-by-nd-3.0 cc by nd
 cc by nd (?:v|version)? ?3 0
20 cc-by-nd-2.5 cc by nd
 cc by nd (?:v|version)? ?2 5
20 cc-by-nd-2.0 cc by nd
 cc by nd (?:v|version)? ?2 0
20 cc-by-sa-4.0 cc by sa
 cc by sa (?:v|version)? ?4 0
20 cc-by-sa-3.0 cc by sa
 cc by sa (?:v|version)? ?3 0
20 cc-by-sa-2.5 cc by sa
 cc by sa (?:v|version)? ?2 5
20 cc-by-sa-2.0 cc by sa
 cc by sa (?:v|version)? ?2 0
20 cc-by-sa-1.0 cc by sa
 cc by sa (?:v|version)? ?1 0
20 cc-by-4.0 cc by
 cc by (?:v|version)? ?4 0
20 cc-by-3.0 cc by
 cc by (?:v|version)? ?3 0
20 cc-by-2.5 cc by
 cc by (?:v|version)? ?2 5
20 cc-by-2.0 cc by
 cc by (?:v|version)? ?2 0
20 cc-by-1.0 cc by
 cc by (?:v|version)? ?1 0
22 cc-by-nc-nd-4.0 creative commons
 creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0
22 cc-by-nc-sa-4.0 creative commons
 creative commons attribution non ?commercial share ?alike 4 0
22 cc-by-nc-4.0 creative commons
 creative commons attribution non ?commercial 4 0
22 cc-by-sa-4.0 creative commons
 creative commons attribution share ?alike 4 0
22 cc-by-nd-4.0 creative commons
 creative commons attribution no ?deriv(?:ative)?s? 4 0
22 cc-by-4.0 creative commons
 creative commons attribution 4 0
22 cc-by-nc-nd-3.0 creative commons
 creative commons attribution non ?commercial no ?deriv(?:ative)?s? 3 0
22 cc-by-nc-sa-3.0 creative commons
 creative commons attribution non ?commercial share ?alike 3 0
22 cc-by-nc-3.0 creative commons
 creative commons attribution non ?commercial 3 0
22 cc-by-sa-3.0 creative commons
 creative commons attribution share ?alike 3 0
22 cc-by-nd-3.0 creative commons
 creative commons attribution no ?deriv(?:ative)?s? 3 0
22 cc-by-3.0 creative commons
 creative commons attribution 3 0
22 cc-by-4.0 creativecommons org
 creativecommons org licenses by 4 0
22 cc-by-3.0 creativecommons org
 creativecommons org licenses by 3 0
22 cc-by-2.0 creativecommons org
 creativecommons org licenses by 2 0
22 cc-by-sa-4.0 creativecommons org
 creativecommons org licenses by sa 4 0
22 cc-by-sa-3.0 creativecommons org
 creativecommons org licenses by sa 3 0
22 cc-by-nc-4.0 creativecommons org
 creativecommons org licenses by nc 4 0
22 cc-by-nc-3.0 creativecommons org
 creativecommons org licenses by nc 3 0
22 cc-by-nc-sa-4.0 creativecommons org
 creativecommons org licenses by nc sa 4 0
22 cc-by-nc-nd-4.0 creativecommons org
 creativecommons org licenses by nc nd 4 0
22 cc-by-nd-4.0 creativecommons org
 creativecommons org licenses by nd 4 0
22 cc0-1.0 creativecommons org
 creativecommons org publicdomain zero 1 0
22 public-domain-mark creativecommons org
 creativecommons org publicdomain mark 1 0
25 apache-2.0 apache org licenses
 apache org licenses license 2 0
25 gpl gnu org licenses
 gnu org licenses gpl(?: html| txt)?
25 gpl-3.0 gnu org licenses
 gnu org licenses gpl 3 0
25 gpl-2.0 gnu org licenses
 gnu org licenses (?:old licenses )?gpl 2 0
25 lgpl gnu org licenses
 gnu org licenses lgpl(?: html| txt)?
25 lgpl-3.0 gnu org licenses
 gnu org licenses lgpl 3 0
25 agpl-3.0 gnu org licenses
 gnu org licenses agpl(?: 3 0)?
25 gfdl gnu org licenses
 gnu org licenses fdl(?: 1 \d)?
25 mpl-2.0 mozilla org
 mozilla org (?:en us )?mpl 2 0
25 mit opensource org license
 opensource org licenses? mit(?: license)?
25 bsd-3-clause opensource org license
 opensource org licenses? bsd 3 clause
25 bsd-2-clause opensource org license
 opensource org licenses? bsd 2 clause
25 isc opensource org license
 opensource org licenses? isc
25 unlicense unlicense org
 unlicense org
25 ofl-1.1 scripts sil org
 scripts sil org ofl
30 mit-0 mit no attribution
 mit no attribution(?: license)?
30 mit mit license
 (?:the )?mit license
30 mit expat license
 expat license
30 mit license mit
 license mit
30 mit mit x11
 mit x11(?: license)?
30 x11 x11 license
 x11 license
30 bsd-4-clause bsd
 (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: license)?
30 bsd-3-clause bsd
 (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
30 bsd-2-clause bsd
 (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)?
30 0bsd bsd
 (?:bsd zero clause|zero clause bsd|0bsd)(?: license)?
30 isc isc license
 isc license
30 zlib zlib
 zlib(?: libpng)? license
30 libpng libpng license
 libpng license
30 curl curl license
 curl license
30 openssl openssl license
 openssl license
30 ncsa ncsa
 (?:university of illinois )?ncsa open source license
30 upl-1.0 universal permissive license
 universal permissive license(?: v| version)?(?: 1 0)?
30 ms-pl microsoft public license
 microsoft public license(?: ms pl)?
30 ms-rl microsoft reciprocal license
 microsoft reciprocal license(?: ms rl)?
30 psf-2.0 python software foundation license
 python software foundation license(?: version 2)?
30 php-3.01 php license
 php license(?: v| version)?(?: 3 01)?
30 ruby ruby license
 ruby license
30 perl same terms as perl
 under the same terms as perl(?: itself)?
30 qpl-1.0 q public license
 q public license(?: v| version)?(?: 1 0)?
30 ipl-1.0 ibm public license
 ibm public license(?: v| version)?(?: 1 0)?
30 npl netscape public license
 netscape public license
30 sleepycat sleepycat license
 sleepycat license
30 json software shall be used for good
 software shall be used for good not evil
30 beerware beer ware
 beer ware license
30 wtfpl wtfpl
 wtfpl
30 wtfpl do what the fuck
 do what the fuck you want to public license
30 cecill cecill
 cecill(?: b| c)?(?: free software)? license
30 mulanpsl-2.0 mulan
 mulan (?:permissive software license|psl) ?v?2
30 vim vim license
 vim license
30 lppl latex project public license
 latex project public license(?: v| version)?(?: 1 3c)?
30 fsf-ap copying and distribution of this file
 copying and distribution of this file with or without modification are permitted in any medium
30 unlicense the unlicense
 the unlicense
30 gpl-or-artistic artistic
 gpl or artistic
40 lgpl lesser general public
 (?:gnu )?lesser general public license
40 lgpl lgpl
 lgpl(?: v?\d(?: \d)?)?
40 lgpl library general public
 (?:gnu )?library general public license
40 agpl affero
 (?:gnu )?affero general public license
40 agpl agpl
 agpl(?: v?\d(?: \d)?)?
40 gfdl gnu free documentation
 gnu free documentation license
40 gfdl gfdl
 gfdl
40 gpl gnu general public license
 gnu general public license
40 gpl gnu gpl
 gnu gpl(?: v?\d(?: \d)?)?
40 gpl gpl
 gpl ?v?[123](?: 0)?
40 apache apache license
 apache license
40 apache apache software license
 apache software license
40 mpl mozilla public license
 mozilla public license
40 epl eclipse public license
 eclipse public license
40 eupl european union public
 european union public licen[cs]e
40 cddl common development and distribution
 common development and distribution license
40 artistic artistic license
 artistic license
40 osl open software license
 open software license
40 afl academic free license
 academic free license
40 ofl open font license
 (?:sil )?open font license
40 odbl open database license
 open database license
40 ogl open government licen
 open government licen[cs]e
40 busl business source license
 business source license
40 sspl server side public license
 server side public license
40 elastic elastic license
 elastic license
40 bsd bsd
 bsd (?:style )?license
40 bsd bsd style
 bsd style
40 cc0 cc0
 cc0
40 cc-by-nc-nd cc by nc nd
 cc by nc nd
40 cc-by-nc-sa cc by nc sa
 cc by nc sa
40 cc-by-nc cc by nc
 cc by nc
40 cc-by-nd cc by nd
 cc by nd
40 cc-by-sa cc by sa
 cc by sa
40 cc-by cc by
 cc by
40 cc-by-nc-nd creative commons
 creative commons attribution non ?commercial no ?deriv(?:ative)?s?
40 cc-by-nc-sa creative commons
 creative commons attribution non ?commercial share ?alike
40 cc-by-nc creative commons
 creative commons attribution non ?commercial
40 cc-by-sa creative commons
 creative commons attribution share ?alike
40 cc-by-nd creative commons
 creative commons attribution no ?deriv(?:ative)?s?
40 cc-by creative commons
 creative commons attribution
50 creative-commons creative commons
 creative commons(?: license)?
50 public-domain public domain
 (?:released|dedicated|placed) (?:in|into|to) the public domain
50 public-domain public domain
 (?:is|are) in the public domain
50 all-rights-reserved all rights reserved
 all rights reserved
50 proprietary proprietary
 proprietary (?:and confidential|license|software)
50 proprietary unauthorized copying
 unauthorized copying of this file(?: via any medium)? is strictly prohibited
50 proprietary confidential
 confidential and proprietary
60 other-license licen
 licensed under (?:the )?(?:terms of )?(?:the )?\S+(?: \S+){0,3}? licen[cs]e
60 other-license licen
 (?:released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?\S+(?: \S+){0,3}? licen[cs]e
60 other-license license
 see (?:the )?license(?: file| txt| md)?(?: in the project root)? for (?:details|full license information|more information)
70 copyright copyright
 copyright (?:c )?(?:19|20)\d\d
"""


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) in order."""
    lines = TEXT.strip("\n").split("\n")
    out = []
    for head, pattern in zip(lines[::2], lines[1::2], strict=True):
        priority, label, keyword = head.split(" ", 2)
        out.append((int(priority), label, keyword, pattern[1:]))
    return out
