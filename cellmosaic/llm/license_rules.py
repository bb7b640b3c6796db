"""Signature rules of the licence scan: hand-written expressions over lower-case words.

A rule is a regular expression over words that are separated by single spaces; the word in
angle brackets is its keyword.  Repeats are bounded, so a match takes at most ``REACH`` words on
either side of the keyword.  ``rules()`` puts licence names into the forms in which a name is
cited; sentences of licence texts and loose hints are rules of their own.
"""

from __future__ import annotations

from typing import NamedTuple

#: Words that a match may take before and after its keyword.
REACH = 24

# Priority classes, and how sure a detection of the class is.
TAG, NOTICE, BODY, NAME, HINT = 5, 4, 3, 2, 1
WEIGHTS = {TAG: 1.0, NOTICE: 0.9, BODY: 0.85, NAME: 0.7, HINT: 0.3}


class Rule(NamedTuple):
    rule: int
    label: str
    priority: int
    base: bool
    keyword: str
    pattern: str


# Base phrases: fixed values of the query's contract.
BASE = (("cc-by", "<cc> by"), ("gpl", "general <public> license"), ("reserved", "all rights <reserved>"))

_V = "(?:version |v )?"

# label, short identifier as words (None: no tag), names as they are cited.
NAMES = (
    ("mit", "mit", ("mit <license>", "mit <licence>", "<expat> license", "mit x11 <license>", "x11 mit <license>")),
    ("mit-0", "mit 0", ("mit no attribution <license>", "<mit> 0")),
    ("x11", "x11", ("x11 <license>", "x <consortium> license")),
    ("apache-2.0", "apache 2 0", (f"<apache> (?:software )?license {_V}2 0", f"<apache> (?:software )?licence {_V}2 0", "<asl> 2 0", f"<apache> {_V}2 0", "<apache2>")),
    ("apache-1.1", "apache 1 1", (f"<apache> (?:software )?license {_V}1 1",)),
    ("apache-1.0", "apache 1 0", (f"<apache> (?:software )?license {_V}1 0",)),
    ("apache", None, ("<apache> (?:software )?license", "<apache> (?:software )?licence", "<apache> licensed")),
    ("gpl-1.0", "gpl 1 0", (f"gnu general public <license> {_V}1", f"<gpl> {_V}1 0", "<gplv1>")),
    ("gpl-2.0", "gpl 2 0", (f"(?:gnu )?general public <license> {_V}2(?: 0)?", f"(?:gnu )?<gpl> {_V}2(?: 0)?", "<gplv2>", "<gpl2>")),
    ("gpl-3.0", "gpl 3 0", (f"(?:gnu )?general public <license> {_V}3(?: 0)?", f"(?:gnu )?<gpl> {_V}3(?: 0)?", "<gplv3>", "<gpl3>")),
    ("gpl", None, ("(?:gnu )?<gpl>", "gnu general <public> licen[sc]e", "gnu public <license>")),
    ("lgpl-2.0", "lgpl 2 0", (f"(?:gnu )?library general public <license> {_V}2(?: 0)?", f"(?:gnu )?<lgpl> {_V}2(?: 0)?")),
    ("lgpl-2.1", "lgpl 2 1", (f"(?:gnu )?lesser general public <license> {_V}2 1", f"(?:gnu )?<lgpl> {_V}2 1", "<lgplv2> 1")),
    ("lgpl-3.0", "lgpl 3 0", (f"(?:gnu )?lesser general public <license> {_V}3(?: 0)?", f"(?:gnu )?<lgpl> {_V}3(?: 0)?", "<lgplv3>")),
    ("lgpl", None, ("(?:gnu )?<lgpl>", "(?:gnu )?(?:lesser|library) general <public> licen[sc]e")),
    ("agpl-1.0", "agpl 1 0", (f"<affero> general public license {_V}1",)),
    ("agpl-3.0", "agpl 3 0", (f"(?:gnu )?<affero> general public license {_V}3(?: 0)?", f"(?:gnu )?<agpl> {_V}3(?: 0)?", "<agplv3>")),
    ("agpl", None, ("(?:gnu )?<affero> general public licen[sc]e", "(?:gnu )?<agpl>")),
    ("gfdl", "gfdl 1 3", ("(?:gnu )?free documentation <license>", "<gfdl>", "gnu <fdl>")),
    ("bsd-1-clause", "bsd 1 clause", ("(?:1|one) clause <bsd>",)),
    ("bsd-2-clause", "bsd 2 clause", ("(?:2|two) clause <bsd>", "simplified <bsd>", "<freebsd> license")),
    ("bsd-3-clause", "bsd 3 clause", ("(?:3|three) clause <bsd>", "(?:new|modified|revised) <bsd>")),
    ("bsd-4-clause", "bsd 4 clause", ("(?:4|four) clause <bsd>", "original <bsd>")),
    ("bsd-zero-clause", "0bsd", ("(?:0|zero) clause <bsd>", "<0bsd>")),
    ("bsd", None, ("<bsd> (?:style )?licen[sc]e", "<bsd> licensed", "<bsd> style")),
    ("isc", "isc", ("<isc> licen[sc]e",)),
    ("zlib", "zlib", ("<zlib> licen[sc]e", "<zlib> libpng license")),
    ("libpng", "libpng", ("<libpng> licen[sc]e", "<png> reference library license")),
    ("unlicense", "unlicense", ("<unlicense>",)),
    ("wtfpl", "wtfpl", ("<wtfpl>",)),
    ("beerware", "beerware", ("<beerware>", "beer ware <license>")),
    ("mpl-1.0", "mpl 1 0", (f"<mozilla> public license {_V}1 0", f"<mpl> {_V}1 0")),
    ("mpl-1.1", "mpl 1 1", (f"<mozilla> public license {_V}1 1", f"<mpl> {_V}1 1")),
    ("mpl-2.0", "mpl 2 0", (f"<mozilla> public license {_V}2 0", f"<mpl> {_V}2 0", "<mplv2>")),
    ("mpl", None, ("<mozilla> public licen[sc]e",)),
    ("epl-1.0", "epl 1 0", (f"<eclipse> public license {_V}1 0", f"<epl> {_V}1 0")),
    ("epl-2.0", "epl 2 0", (f"<eclipse> public license {_V}2 0", f"<epl> {_V}2 0")),
    ("epl", None, ("<eclipse> public licen[sc]e",)),
    ("edl-1.0", None, ("<eclipse> distribution license",)),
    ("eupl-1.1", "eupl 1 1", (f"european union public <license> {_V}1 1", f"<eupl> {_V}1 1")),
    ("eupl-1.2", "eupl 1 2", (f"european union public <license> {_V}1 2", f"<eupl> {_V}1 2")),
    ("eupl", None, ("european union public <licence>", "european union public <license>", "<eupl>")),
    ("cddl-1.0", "cddl 1 0", ("common development and distribution <license>", f"<cddl> {_V}1 0")),
    ("cddl-1.1", "cddl 1 1", (f"<cddl> {_V}1 1",)),
    ("cpl-1.0", "cpl 1 0", ("common public <license>", "<cpl> 1 0")),
    ("ipl-1.0", "ipl 1 0", ("ibm public <license>",)),
    ("cpal-1.0", "cpal 1 0", ("common public attribution <license>", "<cpal>")),
    ("osl-3.0", "osl 3 0", (f"open software <license> {_V}3 0", "<osl> 3 0")),
    ("afl-3.0", "afl 3 0", (f"academic free <license> {_V}3 0", "<afl> 3 0")),
    ("afl", None, ("academic free <license>",)),
    ("ecl-2.0", "ecl 2 0", ("educational community <license>", "<ecl> 2 0")),
    ("artistic-1.0", "artistic 1 0", (f"<artistic> license {_V}1 0",)),
    ("artistic-2.0", "artistic 2 0", (f"<artistic> license {_V}2 0",)),
    ("artistic", None, ("<artistic> licen[sc]e",)),
    ("perl", None, ("same terms as <perl> itself", "under the same terms as <perl>")),
    ("python-2.0", "python 2 0", ("<python> software foundation licen[sc]e", "<psf> licen[sc]e", "<psfl>")),
    ("ruby", "ruby", ("<ruby> licen[sc]e",)),
    ("php-3.01", "php 3 01", (f"<php> license(?: {_V}3 01)?",)),
    ("boost-1.0", "bsl 1 0", ("<boost> software licen[sc]e(?: version 1 0)?",)),
    ("busl-1.1", "busl 1 1", ("business source <license>", "<busl>")),
    ("sspl-1.0", "sspl 1 0", ("server side public <license>", "<sspl>")),
    ("elastic-2.0", "elastic 2 0", ("<elastic> licen[sc]e(?: 2 0)?",)),
    ("commons-clause", None, ("<commons> clause",)),
    ("polyform", None, ("<polyform> (?:noncommercial|strict|perimeter|shield|small business) license",)),
    ("ncsa", "ncsa", ("<ncsa> (?:open source )?licen[sc]e", "university of illinois <ncsa>")),
    ("upl-1.0", "upl 1 0", ("universal permissive <license>", "<upl> 1 0")),
    ("ms-pl", "ms pl", ("microsoft public <license>", "<ms> pl")),
    ("ms-rl", "ms rl", ("microsoft reciprocal <license>", "<ms> rl")),
    ("ofl-1.1", "ofl 1 1", ("(?:sil )?open font <license>", "<ofl> 1 1", "<sil> ofl")),
    ("postgresql", "postgresql", ("<postgresql> licen[sc]e",)),
    ("openssl", "openssl", ("<openssl> licen[sc]e", "<ssleay> license")),
    ("curl", "curl", ("<curl> licen[sc]e",)),
    ("w3c", "w3c", ("<w3c> software (?:notice and )?license", "<w3c> document license")),
    ("ijg", "ijg", ("independent <jpeg> group",)),
    ("freetype", "ftl", ("<freetype> (?:project )?licen[sc]e",)),
    ("vim", "vim", ("<vim> licen[sc]e",)),
    ("json", "json", ("<json> licen[sc]e",)),
    ("qpl-1.0", "qpl 1 0", ("q public <license>", "<qpl>")),
    ("sleepycat", "sleepycat", ("<sleepycat> licen[sc]e",)),
    ("intel", None, ("<intel> open source license",)),
    ("nasa-1.3", "nasa 1 3", ("<nasa> open source agreement",)),
    ("cecill", "cecill 2 1", ("<cecill>(?: [abc]| 2 1| 2 0)?",)),
    ("mulanpsl-2.0", "mulanpsl 2 0", ("<mulan> (?:permissive software|psl) (?:license )?(?:v2|2)",)),
    ("blueoak-1.0.0", "blueoak 1 0 0", ("blue <oak> model license",)),
    ("hippocratic", "hippocratic 2 1", ("<hippocratic> licen[sc]e",)),
    ("cc0-1.0", "cc0 1 0", ("<cc0>(?: 1 0)?", "creative commons <zero>")),
    ("cc-by-nc-nd", "cc by nc nd 4 0", ("<cc> by nc nd(?: [1-4] [05])?", "attribution <noncommercial> no ?derivatives", "attribution <noncommercial> noderivs")),
    ("cc-by-nc-sa", "cc by nc sa 4 0", ("<cc> by nc sa(?: [1-4] [05])?", "attribution <noncommercial> share ?alike")),
    ("cc-by-nc", "cc by nc 4 0", ("<cc> by nc(?: [1-4] [05])?", "creative commons attribution <noncommercial>", "creative <commons> attribution non commercial")),
    ("cc-by-nd", "cc by nd 4 0", ("<cc> by nd(?: [1-4] [05])?", "creative <commons> attribution no ?deriv(?:ative)?s")),
    ("cc-by-sa", "cc by sa 4 0", ("<cc> by sa(?: [1-4] [05])?", "creative <commons> attribution share ?alike")),
    ("cc-by", "cc by 4 0", ("<cc> by(?: [1-4] [05])?", "creative <commons> attribution")),
    ("cc", None, ("creative <commons>(?: public)?(?: licen[sc]e)?",)),
    ("pddl-1.0", "pddl 1 0", ("public domain dedication and <license>", "<pddl>")),
    ("odbl-1.0", "odbl 1 0", ("open database <license>", "<odbl>")),
    ("odc-by-1.0", "odc by 1 0", ("open data commons attribution <license>", "<odc> by")),
    ("cdla-permissive", "cdla permissive 2 0", ("community data license agreement <permissive>", "<cdla> permissive")),
    ("cdla-sharing", "cdla sharing 1 0", ("community data license agreement <sharing>", "<cdla> sharing")),
    ("ogl-uk", "ogl uk 3 0", ("open government <licence>", "<ogl> v?[123]")),
    ("etalab-2.0", "etalab 2 0", ("<etalab> 2 0", "licence ouverte <etalab>")),
    ("openrail", None, ("<openrail>(?: m)?", "responsible ai <license>")),
    ("llama", None, ("<llama> [23](?: [1-9])? community license",)),
    ("public-domain", None, ("released (?:in)?to the public <domain>", "dedicated to the public <domain>", "placed in the public <domain>", "is in the public <domain>")),
)

# Forms in which names are cited.
_THE = "(?:the |an? |its )?(?:terms (?:and conditions )?of )?(?:the )?"
FORMS = (
    (NOTICE, "(?:licen[sc]ed under|(?:released|distributed|published|available|provided|offered|covered) under|subject to|governed by|according to) " + _THE + "{name}"),
    (NAME, "{name}"),
)

# Sentences of licence texts and notices: label and expression.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person <obtaining> a copy"),
    ("mit", "the above <copyright> notice and this permission notice shall be included in all copies"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without <fee>"),
    ("bsd", "<redistribution> and use in source and binary forms"),
    ("bsd", "<redistributions> of source code must retain the above copyright notice"),
    ("bsd", "<redistributions> in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "may be used to <endorse> or promote products derived from this software"),
    ("bsd-4-clause", "all <advertising> materials mentioning features or use of this software"),
    ("apache-2.0", "apache org <licenses> license 2 0"),
    ("apache-2.0", "distributed on an as is basis without <warranties> or conditions of any kind"),
    ("apache", "you may not use this file except in <compliance> with the license"),
    ("gpl", "you can <redistribute> it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the <gnu> general public license"),
    ("gpl", "without even the implied warranty of <merchantability> or fitness for a particular purpose"),
    ("gpl", "the licenses for most software are designed to take away your <freedom>"),
    ("gpl-2.0", "gnu org <licenses> (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu org <licenses> gpl 3 0"),
    ("gpl-2.0-or-later", "either version 2 of the license or at your <option> any later version"),
    ("gpl-3.0-or-later", "either version 3 of the license or at your <option> any later version"),
    ("lgpl", "you should have received a copy of the <gnu> (?:lesser|library) general public license"),
    ("lgpl", "you can <redistribute> it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "you should have received a copy of the <gnu> affero general public license"),
    ("agpl", "you can <redistribute> it and or modify it under the terms of the gnu affero general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the <gnu>"),
    ("mpl-2.0", "this source code form is subject to the terms of the <mozilla> public license"),
    ("mpl-2.0", "<mozilla> org mpl 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the <mozilla> public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the <eclipse> public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common <development> and distribution license"),
    ("zlib", "this notice may not be removed or altered from any source <distribution>"),
    ("zlib", "in no event will the authors be held <liable> for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public <domain>"),
    ("unlicense", "<unlicense> org"),
    ("wtfpl", "you just do what the fuck you want to <wtfpl>"),
    ("beerware", "you can buy me a <beer> in return"),
    ("boost-1.0", "boost org <license> 1 0 txt"),
    ("boost-1.0", "obtaining a copy of the software and accompanying <documentation> covered by this license"),
    ("ofl-1.1", "scripts <sil> org ofl"),
    ("json", "the software shall be used for good not <evil>"),
    ("cc-by", "<creativecommons> org licenses by [1-4] [05]"),
    ("cc-by-sa", "<creativecommons> org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "<creativecommons> org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "<creativecommons> org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "<creativecommons> org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "<creativecommons> org licenses by nc nd [1-4] [05]"),
    ("cc0-1.0", "<creativecommons> org publicdomain zero 1 0"),
    ("public-domain", "<creativecommons> org publicdomain mark 1 0"),
    ("cc0-1.0", "has waived all <copyright> and related or neighboring rights"),
    ("odbl-1.0", "<opendatacommons> org licenses odbl"),
    ("pddl-1.0", "<opendatacommons> org licenses pddl"),
    ("odc-by-1.0", "<opendatacommons> org licenses by"),
    ("ogl-uk", "<nationalarchives> gov uk doc open government licence"),
    ("openssl", "this product includes software developed by the <openssl> project"),
    ("ssleay", "this product includes <cryptographic> software written by eric young"),
    ("proprietary", "this software is the <confidential> and proprietary information of"),
    ("proprietary", "unauthorized (?:copying|reproduction|use)(?: \\S+){0,6} is strictly <prohibited>"),
    ("proprietary", "no part of this (?:publication|book|work|document) may be <reproduced>"),
    ("proprietary", "may not be reproduced (?:\\S+ ){0,8}without(?: the)?(?: prior)?(?: express)?(?: written)? <permission>"),
    ("proprietary", "<proprietary> and confidential"),
    ("proprietary", "for <internal> use only"),
    ("no-derivatives", "no <derivative> works"),
    ("non-commercial", "for (?:non )?<commercial> (?:use|purposes?) only"),
    ("non-commercial", "not for <commercial> (?:use|resale)"),
    ("non-commercial", "for (?:personal and )?<noncommercial> (?:use|purposes?)"),
    ("no-ai-training", "may not be used (?:to train|for training)(?: \\S+){0,4} <models>"),
    ("no-ai-training", "text and data <mining> is (?:not permitted|prohibited|reserved)"),
    ("editorial-use", "for <editorial> use only"),
    ("share-alike", "under the same or a similar <license>"),
    ("attribution", "provided that the original (?:author|source)s? (?:is|are) <credited>"),
    ("reprint", "<reprinted> (?:with|by) permission"),
    ("reprint", "used with <permission>"),
)

# Weak signs: they tell that rights are spoken of, not which licence holds.
HINTS = (
    ("copyright", "<copyright>(?: c)?(?: \\d{4})?"),
    ("copyright", "<copyrighted>"),
    ("copyright", "<copyrights>"),
    ("copyright", "alle rechte <vorbehalten>"),
    ("copyright", "tous droits <réservés>"),
    ("copyright", "todos los derechos <reservados>"),
    ("copyright", "tutti i diritti <riservati>"),
    ("copyright", "todos os direitos <reservados>"),
    ("copyright", "<urheberrechtlich> geschützt"),
    ("copyright", "<copyleft>"),
    ("trademark", "<trademark> of"),
    ("trademark", "registered <trademark>"),
    ("trademark", "registered <trademarks>"),
    ("patent", "<patent> pending"),
    ("eula", "end user license <agreement>"),
    ("eula", "software license <agreement>"),
    ("terms", "<terms> of service"),
    ("terms", "<terms> and conditions"),
    ("terms", "<terms> of use"),
    ("license-mention", "<licensed> under"),
    ("license-mention", "<sublicense>"),
    ("license-mention", "see (?:the )?<license>(?: file)?"),
    ("license-mention", "open source <license>"),
    ("license-mention", "free software <foundation>"),
    ("license-mention", "<licensor>"),
    ("license-mention", "<licensee>"),
    ("permission", "with the kind <permission> of"),
    ("permission", "<royalty> free"),
    ("warranty", "without <warranty> of any kind"),
    ("warranty", "as is without <warranty>"),
    ("warranty", "<disclaims> all warranties"),
    ("public-domain", "public <domain>"),
)


def _rule(n: int, label: str, priority: int, marked: str, base: bool = False) -> Rule:
    keyword = marked[marked.index("<") + 1 : marked.index(">")]
    return Rule(n, label, priority, base, keyword, "(?:^| )" + marked.replace("<", "\x01").replace(">", "\x02") + "(?: |$)")


def rules() -> list[Rule]:
    """All rules in order: base phrases, tags, cited names, texts and hints."""
    found = [(label, NAME, marked, True) for label, marked in BASE]
    for label, tag, names in NAMES:
        if tag:
            found.append((label, TAG, f"<spdx> license identifier {tag}(?: only| or later)?", False))
        found += [(label, priority, form.replace("{name}", name), False) for name in names for priority, form in FORMS]
    found += [(label, BODY, marked, False) for label, marked in TEXTS]
    found += [(label, HINT, marked, False) for label, marked in HINTS]
    return [_rule(n, label, priority, marked, base) for n, (label, priority, marked, base) in enumerate(found)]
