"""Signature rules of the license scan, one a line: priority, label, keyword, regex.

Regexes run over lower-cased words with single spaces between them, in the
dialect that Java's and RE2's engines share; a match begins and ends at word
bounds.  The keyword (``_`` for a space) must stand in any match: a rule is
tried only where its keyword occurs.  Priority 9 is a full grant or tag, 5 a
name, 3 a hint.
"""

from __future__ import annotations

RULES_TEXT = r"""
8 gpl-3.0 general_public gnu general public license,? (version|v|ver) 3( 0)?
8 gpl-3.0 general_public gnu general public license v3
8 gpl-2.0 general_public gnu general public license (version|v|ver) 2( 0)?
8 gpl-2.0 general_public gnu general public license v2
8 gpl-1.0 general_public gnu general public license (version|v|ver) 1( 0)?
9 gpl-3.0-or-later general_public gnu general public license (as published by the free software foundation )?(either )?(version|v) 3( of the license)? or (at your option )?any later version
9 gpl-2.0-or-later general_public gnu general public license (as published by the free software foundation )?(either )?(version|v) 2( of the license)? or (at your option )?any later version
9 gpl-3.0-only general_public gnu general public license (version|v) 3 only
9 gpl-2.0-only general_public gnu general public license (version|v) 2 only
9 gpl-2.0-classpath classpath general public license (version 2 )?with (the )?classpath exception
9 gpl-3.0-gcc gcc general public license .{0,40}gcc runtime library exception
5 gpl general_public (gnu )?general public license
5 gpl gpl (gnu )?gpl
8 gpl-2.0 gpl (gnu )?gpl (version |v )?2( 0)?
8 gpl-2.0 gplv2 (gnu )?gplv2
8 gpl-3.0 gpl (gnu )?gpl (version |v )?3( 0)?
8 gpl-3.0 gplv3 (gnu )?gplv3
6 gpl gpl licensed under (the )?(gnu )?gpl
8 lgpl-3.0 lesser_general gnu lesser general public license (version |v )3( 0)?
8 lgpl-2.1 lesser_general gnu lesser general public license (version |v )2 1
8 lgpl-2.0 library_general gnu library general public license (version |v )2( 0)?
5 lgpl lesser_general (gnu )?lesser general public license
5 lgpl library_general (gnu )?library general public license
5 lgpl lgpl (gnu )?lgpl
8 lgpl-2.1 lgpl lgpl (version |v )?2 1
8 lgpl-3.0 lgpl lgpl (version |v )?3( 0)?
8 lgpl-3.0 lgplv3 lgplv3
8 agpl-3.0 affero gnu affero general public license (version |v )3( 0)?
5 agpl affero (gnu )?affero general public license
5 agpl agpl (gnu )?agpl
8 agpl-3.0 agpl agpl (version |v )?3( 0)?
8 agpl-3.0 agplv3 agplv3
8 gfdl-1.3 free_documentation gnu free documentation license (version |v )1 3
8 gfdl-1.2 free_documentation gnu free documentation license (version |v )1 2
5 gfdl free_documentation (gnu )?free documentation license
3 gpl free_software_foundation published by the free software foundation
9 apache-2.0 apache licensed under the apache license,? version 2 0( the license)?
8 apache-2.0 apache apache license,? (version |v |ver )?2( 0)?
8 apache-2.0 apache apache (software )?license v2( 0)?
8 apache-1.1 apache apache (software )?license (version |v )?1 1
8 apache-1.0 apache apache (software )?license (version |v )?1 0
5 apache apache apache (software )?license
6 apache apache licensed to the apache software foundation
8 apache-2.0 apache www apache org licenses license 2 0
3 apache asf the asf licenses this file to you
9 mit licensed_under licensed under (the )?(terms of the )?mit license
9 mit released_under released under (the )?(terms of the )?mit license
9 mit distributed_under distributed under (the )?(terms of the )?mit license
9 mit permission_is permission is hereby granted free of charge to any person obtaining a copy
6 mit mit_license (the )?mit license
6 mit expat (the )?expat license
6 x11 x11_license (the )?x11 license
6 mit-0 mit_no mit no attribution( license)?
3 mit without_limitation without limitation the rights to use copy modify merge publish
4 permissive-disclaimer as_is the software is provided as is without warranty of any kind
8 mit opensource www opensource org licenses mit( license)?
8 bsd-3-clause bsd (the )?(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)( license)?
8 bsd-2-clause bsd (the )?(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)( license)?
8 bsd-4-clause bsd (the )?(bsd 4 clause|4 clause bsd|original bsd)( license)?
8 0bsd bsd (the )?(zero clause bsd|bsd zero clause|bsd 0 clause|0bsd)( license)?
5 bsd bsd (the )?bsd( style)? license
6 bsd bsd (licensed|released|distributed) under (the )?(terms of the )?bsd( style)? license
9 bsd-3-clause neither_the neither the name of .{1,60}nor the names of its contributors may be used to endorse
7 bsd-2-clause redistribution redistribution and use in source and binary forms with or without modification are permitted
4 bsd redistributions redistributions of source code must retain the above copyright notice
4 bsd redistributions redistributions in binary form must reproduce the above copyright notice
7 bsd-4-clause advertising all advertising materials mentioning features or use of this software must display
8 mpl-2.0 mozilla mozilla public license (version |v )?2( 0)?
8 mpl-1.1 mozilla mozilla public license (version |v )?1 1
8 mpl-1.0 mozilla mozilla public license (version |v )?1 0
5 mpl mozilla mozilla public license
8 mpl-2.0 mpl mpl (version |v )?2 0
9 mpl-2.0 mozilla subject to the terms of the mozilla public license v 2 0
8 epl-2.0 eclipse eclipse public license (version |v )?2( 0)?
8 epl-1.0 eclipse eclipse public license (version |v )?1( 0)?
5 epl eclipse eclipse public license
8 edl-1.0 eclipse eclipse distribution license (version |v )?1( 0)?
8 cddl-1.0 common_development common development and distribution license (version |v )?1( 0)?
8 cddl-1.1 common_development common development and distribution license (version |v )?1 1
5 cddl common_development common development and distribution license
5 cpl-1.0 common_public common public license( version 1( 0)?)?
5 ipl-1.0 ibm_public ibm public license( version 1( 0)?)?
8 eupl-1.2 european_union european union public licen[cs]e (version |v )?1 2
8 eupl-1.1 european_union european union public licen[cs]e (version |v )?1 1
5 eupl european_union european union public licen[cs]e
6 cecill cecill (the )?cecill( free software)? license
8 cecill-2.1 cecill cecill (version |v )?2 1
8 artistic-2.0 artistic artistic license (version |v )?2( 0)?
8 artistic-1.0 artistic artistic license (version |v )?1( 0)?
5 artistic artistic (the )?artistic license
6 perl same_terms under the same terms as perl itself
6 isc isc_license (the )?isc license
9 isc permission_to permission to use copy modify and or distribute this software for any purpose with or without fee
6 zlib zlib (the )?zlib( libpng)? license
6 libpng libpng (the )?libpng license
8 bsl-1.0 boost boost software license( version 1( 0)?)?
6 bsl-1.0 boost distributed under the boost software license
6 unlicense unlicense (this is )?(the )?unlicense
8 unlicense unencumbered this is free and unencumbered software released into the public domain
7 public-domain public_domain (released|dedicated|placed) (in|into|to) the public domain
4 public-domain public_domain (in the )?public domain
5 wtfpl what_the do what the .{1,12} you want to public license
5 wtfpl wtfpl (the )?wtfpl
6 beerware beer_ware (the )?beer ware license
6 postgresql postgresql (the )?postgresql license
6 python-2.0 python_software python software foundation license( version 2)?
6 php-3.01 php_license (the )?php license (version )?3 01
5 php php_license (the )?php license
5 ruby ruby_license (the )?ruby license
6 openssl openssl (the )?openssl license
6 vim vim_license (the )?vim license
6 zpl-2.1 zope zope public license (version |v )?2 1
5 zpl zope zope public license
6 qpl-1.0 q_public (the )?q public license( version 1 0)?
6 ofl-1.1 open_font (sil )?open font license (version |v )?1 1
5 ofl open_font (sil )?open font license
6 afl-3.0 academic_free academic free license (version |v )?3( 0)?
5 afl academic_free academic free license
6 osl-3.0 open_software open software license (version |v )?3( 0)?
5 osl open_software open software license
6 ms-pl microsoft_public microsoft public license
6 ms-rl microsoft_reciprocal microsoft reciprocal license
6 ncsa ncsa (university of illinois )?ncsa open source license
6 upl-1.0 universal_permissive universal permissive license( (version |v )?1 0)?
6 mulan-psl-2.0 mulan mulan psl v2
6 blueoak-1.0 blue_oak blue oak model license( 1 0 0)?
6 sspl-1.0 server_side server side public license( (version |v )?1)?
6 busl-1.1 business_source business source license( (version |v )?1 1)?
6 elastic-2.0 elastic_license elastic license( (version |v )?2( 0)?)?
6 commons-clause commons_clause commons clause( license condition)?
6 polyform-nc polyform polyform noncommercial license( 1 0 0)?
6 odbl-1.0 open_database open database license( (version |v )?1 0)?
6 odc-by-1.0 open_data open data commons attribution license
6 pddl-1.0 open_data open data commons public domain dedication and license
6 ogl-3.0 open_government open government licen[cs]e (version |v )?3( 0)?
5 ogl open_government open government licen[cs]e
6 openrail responsible_ai (bigscience )?(open )?responsible ai license
6 openrail openrail openrail( m)?
6 llama-community community_license llama [0-9 ]{0,6}community license
6 w3c w3c (the )?w3c software (notice and )?license
6 unicode unicode_license (the )?unicode license
6 intel-open intel intel open source license
6 nasa-1.3 nasa nasa open source agreement( 1 3)?
6 curl curl (the )?curl license
6 json json_license (the )?json license
5 json shall_be the software shall be used for good not evil
6 jpeg-ijg jpeg_group independent jpeg group license
6 tcl tcl_tk tcl tk license
6 sleepycat sleepycat (the )?sleepycat license
6 latex-lppl latex_project latex project public license( 1 3c?)?
6 hpnd historical_permission historical permission notice and disclaimer
9 cc-by-nc-nd-4.0 cc_by cc by nc nd 4 0
9 cc-by-nc-sa-4.0 cc_by cc by nc sa 4 0
9 cc-by-nc-4.0 cc_by cc by nc 4 0
9 cc-by-nd-4.0 cc_by cc by nd 4 0
9 cc-by-sa-4.0 cc_by cc by sa 4 0
9 cc-by-4.0 cc_by cc by 4 0
9 cc-by-nc-nd-3.0 cc_by cc by nc nd 3 0
9 cc-by-nc-sa-3.0 cc_by cc by nc sa 3 0
9 cc-by-nc-3.0 cc_by cc by nc 3 0
9 cc-by-nd-3.0 cc_by cc by nd 3 0
9 cc-by-sa-3.0 cc_by cc by sa 3 0
9 cc-by-3.0 cc_by cc by 3 0
9 cc-by-sa-2.5 cc_by cc by sa 2 5
9 cc-by-2.5 cc_by cc by 2 5
9 cc-by-sa-2.0 cc_by cc by sa 2 0
9 cc-by-2.0 cc_by cc by 2 0
6 cc-by-nc-nd cc_by cc by nc nd
6 cc-by-nc-sa cc_by cc by nc sa
6 cc-by-nc cc_by cc by nc
6 cc-by-nd cc_by cc by nd
6 cc-by-sa cc_by cc by sa
5 cc-by cc_by cc by
8 cc0-1.0 cc0 cc0( 1 0)?( universal)?
8 cc0-1.0 cc_zero (creative commons )?cc zero
8 cc0-1.0 creative_commons creative commons zero( v1 0 universal)?
8 cc-by-nc-nd creative_commons creative commons attribution non ?commercial no ?deriv(ative)?s
8 cc-by-nc-sa creative_commons creative commons attribution non ?commercial share ?alike
8 cc-by-nc creative_commons creative commons attribution non ?commercial
8 cc-by-nd creative_commons creative commons attribution no ?deriv(ative)?s
8 cc-by-sa creative_commons creative commons attribution share ?alike
8 cc-by-sa-4.0 creative_commons creative commons attribution share ?alike 4 0( international)?
8 cc-by-4.0 creative_commons creative commons attribution 4 0( international)?
8 cc-by-3.0 creative_commons creative commons attribution 3 0( unported)?
5 cc-by creative_commons creative commons attribution
3 cc creative_commons creative commons( license)?
9 cc-by-4.0 creativecommons creativecommons org licenses by 4 0
9 cc-by-sa-4.0 creativecommons creativecommons org licenses by sa 4 0
9 cc-by-nc-4.0 creativecommons creativecommons org licenses by nc 4 0
9 cc-by-nd-4.0 creativecommons creativecommons org licenses by nd 4 0
9 cc-by-nc-sa-4.0 creativecommons creativecommons org licenses by nc sa 4 0
9 cc-by-nc-nd-4.0 creativecommons creativecommons org licenses by nc nd 4 0
9 cc0-1.0 creativecommons creativecommons org publicdomain zero 1 0
4 proprietary all_rights all rights reserved
6 proprietary proprietary proprietary and confidential
6 proprietary unauthorized unauthorized (copying|use|distribution) .{0,40}strictly prohibited
5 proprietary commercial_license (a )?commercial license
4 proprietary license_agreement end user license agreement
3 copyright-notice copyright copyright (c )?[12][0-9]{3}( [12][0-9]{3})?
3 copyright-notice copyright copyright holders?
3 license-reference license see (the )?(license|copying) (file )?for (details|more information)
3 license-reference license (the )?license file in the root
4 dual-license dual_licensed dual licensed under
3 open-source open_source open source license
"""

#: Identifiers that the tag ``SPDX-License-Identifier:`` may carry, as words.
TAGGED = """
gpl-1.0-only gpl-1.0-or-later gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later gpl-2.0 gpl-3.0
lgpl-2.0-only lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later agpl-3.0-only agpl-3.0-or-later
apache-1.1 apache-2.0 mit mit-0 bsd-2-clause bsd-3-clause bsd-4-clause 0bsd isc zlib x11 mpl-1.1 mpl-2.0
epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 eupl-1.1 eupl-1.2 artistic-1.0 artistic-2.0 bsl-1.0 unlicense wtfpl
cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0
ofl-1.1 afl-3.0 osl-3.0 ms-pl ms-rl ncsa upl-1.0 postgresql python-2.0 php-3.01 ruby openssl vim zpl-2.1
odbl-1.0 odc-by-1.0 pddl-1.0 busl-1.1 sspl-1.0 elastic-2.0 blueoak-1.0 gfdl-1.3 cecill-2.1 hpnd lppl-1.3c w3c
"""

#: Words of which one stands in every match: a text without any is done at once.
ROOTS = ("licen", "copyright", "copying", "gpl", "spdx", "cc  by", "cc0", "cc  zero", "creative", "public  domain", "apache", "bsd", "mpl", "mit  no", "cecill", "wtfpl", "mulan", "openrail", "permission", "redistribution", "provided  as  is", "without  limitation", "classpath", "free  software", "neither  the", "advertising", "same  terms", "used  for  good", "commons", "historical", "proprietary", "unauthorized", "all  rights", "nasa  open")

BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))


def wide(pattern: str) -> str:
    """The pattern over texts whose words each have a space on both sides."""
    return " " + pattern.replace(" ?", "(  )?").replace(" ", "  ").replace("(    )?", "(  )?") + " "


def rules() -> list[tuple[int, int, str, str, str]]:
    """(rule number, priority, label, keyword, regex) in order."""
    out = []
    for line in RULES_TEXT.strip().splitlines():
        priority, label, keyword, regex = line.split(" ", 3)
        out.append((len(out), int(priority), label, keyword.replace("_", "  "), wide(regex.replace(",?", ""))))
    for tag in TAGGED.split():
        words = tag.replace(".", " ").replace("-", " ")
        out.append((len(out), 9, tag, "spdx", wide(f"spdx license identifier {words}")))
    return out


def tried() -> list[tuple[int, int, str, str, str]]:
    """The rules as the scan tries them: one whose keyword stands in one of two alternatives only is a row for each, of the same number."""
    out = []
    for n, p, label, keyword, regex in rules():
        if "(license|copying)" in regex and keyword == "license":
            out += [(n, p, label, word, regex.replace("(license|copying)", word)) for word in ("license", "copying")]
        else:
            out.append((n, p, label, keyword, regex))
    return out
