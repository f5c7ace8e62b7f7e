"""License scan by ordered signature rules, in SQL functions only.

Three steps, all within a row, so that no row moves:

1. Prefilter: a text without any of the ``GATES`` is not looked at again; a
   rule runs only where words stand that its regex cannot match without. They
   are read off the regex and hold no ``\\s``, so line breaks do not matter.
2. Rules: signatures of four ranks (identifier tags and links, licence texts,
   notices, mentions) give places with a label.
3. Suppression: a place inside a longer or equal one of the same or a better
   rank is dropped; of equal places the rule that stands first wins.

The base phrases are found on words: runs of letters, digits and non-ASCII
characters, with A-Z in lower case.

Defined results: null and empty texts have no words and no labels; repeated
rows are judged each; a very long text is judged whole, within its row; of places that
tie in length and rank the rule that stands first wins; an empty table gives an empty
result; input columns named like an output column are replaced by it, others stay,
whatever their name.
"""

from __future__ import annotations

import re._parser as sre
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from readloom.llm.common import drop_names, hold, let, let_go, quoted

OUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

#: What stands between words, as a regex class body; letters of both cases are word characters.
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

#: Base phrases and their labels.
BASE = (
    (("under", "the", "mit", "license"), "mit"),
    (("apache", "license", "version", "2"), "apache-2"),
    (("cc", "by", "nc"), "cc-by-nc"),
)

#: Confidence of a place by the rank of its rule.
RANK_SCORE = (1.0, 0.95, 0.9, 0.7)
#: Sets of literal parts that are looked up before a rule runs.
KEY_SETS = 3

# label; identifier regex; name regex
_NAMED = r"""
mit; MIT(?:-0)?; (?:MIT|Expat)(?:/X11)?
x11; X11; X11(?! forwarding)
isc; ISC; ISC
bsd-2-clause; BSD-2-Clause(?:-Patent|-Views)?; (?:simplified|two[- ]clause|2[- ]clause|FreeBSD)\s+BSD
bsd-3-clause; BSD-3-Clause(?:-Clear|-LBNL)?; (?:(?:new|revised|modified|three[- ]clause|3[- ]clause)\s+BSD|BSD\s+3[- ]clause)
bsd-4-clause; BSD-4-Clause; (?:original|four[- ]clause|4[- ]clause)\s+BSD
0bsd; 0BSD; (?:zero[- ]clause|0[- ]clause)\s+BSD
apache-1.1; Apache-1\.1; Apache(?:\s+Software)?(?:\s+License)?,?\s+(?:version\s+|v)?1\.1
apache-2; Apache-2\.0; Apache(?:\s+Software)?(?:\s+License)?,?\s+(?:version\s+|v)?2(?:\.0)?
gpl-1; GPL-1\.0(?:-only|-or-later|\+)?; (?:GNU\s+(?:General\s+Public\s+Licen[sc]e|GPL)|GPL),?\s*(?:version\s+|v)1(?:\.0)?
gpl-2; GPL-2\.0(?:-only|-or-later|\+)?; (?:GNU\s+(?:General\s+Public\s+Licen[sc]e|GPL)|GPL),?\s*(?:version\s+|v)2(?:\.0)?
gpl-3; GPL-3\.0(?:-only|-or-later|\+)?; (?:GNU\s+(?:General\s+Public\s+Licen[sc]e|GPL)|GPL),?\s*(?:version\s+|v)3(?:\.0)?
lgpl-2; LGPL-2\.0(?:-only|-or-later|\+)?; (?:GNU\s+(?:Library|Lesser)\s+General\s+Public\s+Licen[sc]e|LGPL),?\s*(?:version\s+|v)2(?:\.0)?
lgpl-2.1; LGPL-2\.1(?:-only|-or-later|\+)?; (?:GNU\s+(?:Library|Lesser)\s+General\s+Public\s+Licen[sc]e|LGPL),?\s*(?:version\s+|v)2\.1
lgpl-3; LGPL-3\.0(?:-only|-or-later|\+)?; (?:GNU\s+Lesser\s+General\s+Public\s+Licen[sc]e|LGPL),?\s*(?:version\s+|v)3(?:\.0)?
agpl-3; AGPL-3\.0(?:-only|-or-later|\+)?; (?:GNU\s+Affero\s+General\s+Public\s+Licen[sc]e|AGPL),?\s*(?:version\s+|v)3(?:\.0)?
gfdl; GFDL-1\.[123](?:-only|-or-later)?; GNU\s+Free\s+Documentation\s+Licen[sc]e
mpl-1.1; MPL-1\.1; (?:Mozilla\s+Public\s+Licen[sc]e|MPL),?\s*(?:version\s+|v)?1\.1
mpl-2; MPL-2\.0; (?:Mozilla\s+Public\s+Licen[sc]e|MPL),?\s*(?:version\s+|v)?2(?:\.0)?
epl-1; EPL-1\.0; (?:Eclipse\s+Public\s+Licen[sc]e|EPL),?\s*(?:-\s*)?(?:version\s+|v)?1(?:\.0)?
epl-2; EPL-2\.0; (?:Eclipse\s+Public\s+Licen[sc]e|EPL),?\s*(?:-\s*)?(?:version\s+|v)?2(?:\.0)?
edl-1; EDL-1\.0; Eclipse\s+Distribution\s+Licen[sc]e
cddl-1; CDDL-1\.[01]; (?:Common\s+Development\s+and\s+Distribution\s+Licen[sc]e|CDDL)
cpl-1; CPL-1\.0; Common\s+Public\s+Licen[sc]e
eupl-1.2; EUPL-1\.[012]; European\s+Union\s+Public\s+Licen[sc]e
artistic-1; Artistic-1\.0(?:-Perl)?; Artistic\s+Licen[sc]e(?:\s+version)?\s+1(?:\.0)?
artistic-2; Artistic-2\.0; Artistic\s+Licen[sc]e(?:\s+version)?\s+2(?:\.0)?
bsl-1; BSL-1\.0; Boost\s+Software\s+Licen[sc]e
busl-1.1; BUSL-1\.1; Business\s+Source\s+Licen[sc]e
zlib; Zlib; zlib(?:/libpng)?
libpng; libpng-2\.0; libpng
unlicense; Unlicense; The\s+Unlicense
wtfpl; WTFPL; (?:WTFPL|Do\s+What\s+The\s+F\S+\s+You\s+Want\s+To)
cc0-1; CC0-1\.0; (?:CC0|CC\s+Zero|Creative\s+Commons\s+Zero)
cc-by-1; CC-BY-1\.0; (?:CC[ -]BY|Creative\s+Commons\s+Attribution)\s+1\.0
cc-by-2; CC-BY-2\.[05]; (?:CC[ -]BY|Creative\s+Commons\s+Attribution)\s+2\.[05]
cc-by-3; CC-BY-3\.0; (?:CC[ -]BY|Creative\s+Commons\s+Attribution)\s+3\.0
cc-by-4; CC-BY-4\.0; (?:CC[ -]BY|Creative\s+Commons\s+Attribution)\s+4\.0
cc-by-sa-2; CC-BY-SA-2\.[05]; (?:CC[ -]BY[ -]SA|Creative\s+Commons\s+Attribution[- ]Share\s?Alike)\s+2\.[05]
cc-by-sa-3; CC-BY-SA-3\.0; (?:CC[ -]BY[ -]SA|Creative\s+Commons\s+Attribution[- ]Share\s?Alike)\s+3\.0
cc-by-sa-4; CC-BY-SA-4\.0; (?:CC[ -]BY[ -]SA|Creative\s+Commons\s+Attribution[- ]Share\s?Alike)\s+4\.0
cc-by-nd-3; CC-BY-ND-3\.0; (?:CC[ -]BY[ -]ND|Creative\s+Commons\s+Attribution[- ]NoDeriv(?:ative)?s)\s+3\.0
cc-by-nd-4; CC-BY-ND-4\.0; (?:CC[ -]BY[ -]ND|Creative\s+Commons\s+Attribution[- ]NoDeriv(?:ative)?s)\s+4\.0
cc-by-nc-2; CC-BY-NC-2\.[05]; (?:CC[ -]BY[ -]NC|Creative\s+Commons\s+Attribution[- ]NonCommercial)\s+2\.[05]
cc-by-nc-3; CC-BY-NC-3\.0; (?:CC[ -]BY[ -]NC|Creative\s+Commons\s+Attribution[- ]NonCommercial)\s+3\.0
cc-by-nc-4; CC-BY-NC-4\.0; (?:CC[ -]BY[ -]NC|Creative\s+Commons\s+Attribution[- ]NonCommercial)\s+4\.0
cc-by-nc-sa-3; CC-BY-NC-SA-3\.0; CC[ -]BY[ -]NC[ -]SA\s+3\.0
cc-by-nc-sa-4; CC-BY-NC-SA-4\.0; CC[ -]BY[ -]NC[ -]SA\s+4\.0
cc-by-nc-nd-3; CC-BY-NC-ND-3\.0; CC[ -]BY[ -]NC[ -]ND\s+3\.0
cc-by-nc-nd-4; CC-BY-NC-ND-4\.0; CC[ -]BY[ -]NC[ -]ND\s+4\.0
odbl-1; ODbL-1\.0; (?:Open\s+Database\s+Licen[sc]e|ODbL)
odc-by-1; ODC-By-1\.0; Open\s+Data\s+Commons\s+Attribution
pddl-1; PDDL-1\.0; (?:Public\s+Domain\s+Dedication\s+and\s+Licen[sc]e|PDDL)
ofl-1.1; OFL-1\.[01]; (?:SIL\s+)?Open\s+Font\s+Licen[sc]e
ms-pl; MS-PL; Microsoft\s+Public\s+Licen[sc]e
ms-rl; MS-RL; Microsoft\s+Reciprocal\s+Licen[sc]e
postgresql; PostgreSQL; PostgreSQL
python-2; (?:Python-2\.0|PSF-2\.0); (?:Python\s+Software\s+Foundation|PSF)
ruby; Ruby; Ruby('s)?
php-3; PHP-3\.0[01]?; PHP\s+Licen[sc]e,?\s*(?:version\s+|v)?3(?:\.0)?1?
openssl; OpenSSL; OpenSSL
w3c; W3C(?:-\d+)?; W3C\s+Software(?:\s+Notice)?
afl-3; AFL-3\.0; Academic\s+Free\s+Licen[sc]e
osl-3; OSL-3\.0; Open\s+Software\s+Licen[sc]e
ncsa; NCSA; (?:University\s+of\s+Illinois|NCSA)
upl-1; UPL-1\.0; Universal\s+Permissive\s+Licen[sc]e
sspl-1; SSPL-1\.0; Server\s+Side\s+Public\s+Licen[sc]e
elastic-2; Elastic-2\.0; Elastic\s+Licen[sc]e(?:\s+2(?:\.0)?)?
cecill-2; CECILL-2\.[01]; CeCILL
etalab-2; etalab-2\.0; Licence\s+Ouverte
mulan-2; MulanPSL-2\.0; Mulan\s+PSL
blueoak-1; BlueOak-1\.0\.0; Blue\s+Oak\s+Model
ipl-1; IPL-1\.0; IBM\s+Public\s+Licen[sc]e
lppl-1.3; LPPL-1\.3[ac]?; LaTeX\s+Project\s+Public\s+Licen[sc]e
vim; Vim; Vim(?=\s+licen[sc]e)
"""

# rank; label; regex
_SINGLE = r"""
1; mit; opensource\.org/licenses?/mit(?:-license)?(?:\.php)?\b
1; mit; \bmit-license\.org\b
1; apache-2; (?:www\.)?apache\.org/licenses/LICENSE-2\.0
1; apache-1.1; (?:www\.)?apache\.org/licenses/LICENSE-1\.1
1; gpl-2; gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
1; gpl-3; gnu\.org/licenses/gpl-3\.0
1; gpl; gnu\.org/(?:licenses|copyleft)/gpl(?:\.html|\.txt)?\b(?!-)
1; lgpl-2.1; gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
1; lgpl-3; gnu\.org/licenses/lgpl-3\.0
1; agpl-3; gnu\.org/licenses/agpl-3\.0
1; gfdl; gnu\.org/(?:licenses|copyleft)/fdl
1; mpl-2; mozilla\.org/(?:en-US/)?MPL/2\.0
1; mpl-1.1; mozilla\.org/MPL/(?:1\.1|MPL-1\.1)
1; epl-1; eclipse\.org/legal/epl-v10
1; epl-2; eclipse\.org/legal/epl-(?:v20|2\.0)
1; bsl-1; boost\.org/LICENSE_1_0
1; unlicense; \bunlicense\.org\b
1; wtfpl; \bwtfpl\.net\b
1; cc0-1; creativecommons\.org/publicdomain/zero/1\.0
1; public-domain; creativecommons\.org/publicdomain/mark/1\.0
1; cc-by; creativecommons\.org/licenses/by/\d\.\d
1; cc-by-sa; creativecommons\.org/licenses/by-sa/\d\.\d
1; cc-by-nd; creativecommons\.org/licenses/by-nd/\d\.\d
1; cc-by-nc; creativecommons\.org/licenses/by-nc/\d\.\d
1; cc-by-nc-sa; creativecommons\.org/licenses/by-nc-sa/\d\.\d
1; cc-by-nc-nd; creativecommons\.org/licenses/by-nc-nd/\d\.\d
1; ofl-1.1; scripts\.sil\.org/OFL
1; odbl-1; opendatacommons\.org/licenses/odbl
1; bsd-3-clause; opensource\.org/licenses?/bsd-3-clause
1; bsd-2-clause; opensource\.org/licenses?/bsd-2-clause
1; isc; opensource\.org/licenses?/isc
1; zlib; opensource\.org/licenses?/zlib
1; afl-3; opensource\.org/licenses?/afl-3\.0
1; artistic-2; opensource\.org/licenses?/artistic-2\.0
1; eupl-1.2; joinup\.ec\.europa\.eu/\S*eupl
2; mit; Permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy\s+of\s+this\s+software
2; mit; The\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies
2; mit; THE\s+SOFTWARE\s+IS\s+PROVIDED\s+"?AS\s+IS"?,\s+WITHOUT\s+WARRANTY\s+OF\s+ANY\s+KIND
2; isc; Permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose
2; bsd; Redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification
2; bsd-3-clause; Neither\s+the\s+names?\s+of\s+.{1,120}?\s+may\s+be\s+used\s+to\s+endorse\s+or\s+promote
2; bsd-4-clause; All\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software
2; bsd; THIS\s+SOFTWARE\s+IS\s+PROVIDED\s+BY\s+THE\s+COPYRIGHT\s+HOLDERS\s+AND\s+CONTRIBUTORS
2; apache-2; Unless\s+required\s+by\s+applicable\s+law\s+or\s+agreed\s+to\s+in\s+writing.{0,200}?Apache
2; apache-2; you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+License
2; gpl; This\s+program\s+is\s+free\s+software[:;,]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+GNU\s+General\s+Public\s+License
2; gpl-2; GNU\s+General\s+Public\s+License.{0,120}?either\s+version\s+2
2; gpl-3; GNU\s+General\s+Public\s+License.{0,120}?either\s+version\s+3
2; lgpl; This\s+(?:library|program)\s+is\s+free\s+software.{0,120}?GNU\s+Lesser\s+General\s+Public\s+License
2; agpl-3; This\s+program\s+is\s+free\s+software.{0,120}?GNU\s+Affero\s+General\s+Public\s+License
2; gpl; without\s+even\s+the\s+implied\s+warranty\s+of\s+MERCHANTABILITY\s+or\s+FITNESS\s+FOR\s+A\s+PARTICULAR\s+PURPOSE
2; mpl-2; This\s+Source\s+Code\s+Form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+Mozilla\s+Public\s+License
2; epl; made\s+available\s+under\s+the\s+terms\s+of\s+the\s+Eclipse\s+Public\s+License
2; zlib; Altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such
2; zlib; This\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty
2; bsl-1; Distributed\s+under\s+the\s+Boost\s+Software\s+License,?\s+Version\s+1\.0
2; unlicense; This\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain
2; ofl-1.1; This\s+Font\s+Software\s+is\s+licensed\s+under\s+the\s+SIL\s+Open\s+Font\s+License
2; cc0-1; to\s+the\s+extent\s+possible\s+under\s+law.{0,120}?waived\s+all\s+copyright
2; proprietary; (?:proprietary\s+and\s+confidential|confidential\s+and\s+proprietary)
2; proprietary; Unauthorized\s+(?:copying|use|reproduction|distribution)\s+.{0,80}?(?:strictly\s+)?prohibited
3; all-rights-reserved; \bAll\s+rights\s+reserved\b
3; all-rights-reserved; \bTous\s+droits\s+r[ée]serv[ée]s\b
3; all-rights-reserved; \bAlle\s+Rechte\s+vorbehalten\b
3; all-rights-reserved; \bTodos\s+los\s+derechos\s+reservados\b
3; public-domain; \b(?:in|into|to)\s+the\s+public\s+domain\b
3; public-domain; \bdominio\s+p[úu]blico\b
3; public-domain; \bdomaine\s+public\b
3; public-domain; \bgemeinfrei\b
3; gpl; \bunder\s+the\s+(?:terms\s+of\s+the\s+)?(?:GNU\s+)?General\s+Public\s+Licen[sc]e\b
3; lgpl; \bunder\s+the\s+(?:terms\s+of\s+the\s+)?(?:GNU\s+)?Lesser\s+General\s+Public\s+Licen[sc]e\b
3; agpl; \bunder\s+the\s+(?:terms\s+of\s+the\s+)?(?:GNU\s+)?Affero\s+General\s+Public\s+Licen[sc]e\b
3; bsd; \bunder\s+(?:the\s+|a\s+)?BSD(?:[- ]style)?\s+licen[sc]e\b
3; creative-commons; \bunder\s+(?:a\s+|the\s+)?Creative\s+Commons\b
3; cc-by; \bCreative\s+Commons\s+Attribution\b(?!\s*-)
3; perl; \bsame\s+terms\s+as\s+Perl\b
3; commercial; \bcommercial\s+licen[sc]e\s+(?:required|agreement|terms)\b
3; dual; \bdual[- ]licensed\b
4; cc-by; \bCC[ -]BY\b(?![ -](?:SA|NC|ND))
4; cc-by-sa; \bCC[ -]BY[ -]SA\b
4; cc-by-nd; \bCC[ -]BY[ -]ND\b
4; cc-by-nc; \bCC[ -]BY[ -]NC\b(?![ -](?:SA|ND))
4; cc-by-nc-sa; \bCC[ -]BY[ -]NC[ -]SA\b
4; cc-by-nc-nd; \bCC[ -]BY[ -]NC[ -]ND\b
4; gpl; \b(?:GNU\s+)?GPL\b
4; lgpl; \bLGPL\b
4; agpl; \bAGPL\b
4; bsd; \bBSD\s+licen[sc]e\b
4; gpl; \bGNU\s+General\s+Public\s+Licen[sc]e\b
"""


def _needed(tree, run: tuple[str, ...] = ("",)) -> list[frozenset[str]]:
    """Sets of lower-case strings; every match of a parsed regex holds one of each set.

    ``run`` is what stands directly before, in all its spellings. Only classes
    with a space or hyphen are spelt out; whatever else is not literal ends a run.
    """
    got = []

    def end():
        nonlocal run
        if all(run):
            got.append(frozenset(run))
        run = ("",)

    for op, arg in tree:
        if op is sre.LITERAL and arg < 128:
            run = tuple(r + chr(arg).lower() for r in run)
        elif op is sre.IN and all(o is sre.LITERAL and a < 128 for o, a in arg) and {ord(" "), ord("-")} & {a for _, a in arg}:
            run = tuple(r + chr(a).lower() for r in run for _, a in arg)
        elif op is sre.BRANCH:  # a start that all branches share was cut off them by the parser
            each = [_needed(x, run) for x in arg[1]]
            if all(each):
                got.append(frozenset().union(*(max(x, key=_rarity) for x in each)))
            end()
        elif op is sre.SUBPATTERN:
            end()
            got += _needed(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            end()
            got += _needed(arg[2]) if arg[0] else []
        else:
            end()
    end()
    return got


def _rarity(words: frozenset[str]) -> tuple:
    return min(map(len, words)), -len(words), sorted(words)


def keys(regex: str) -> tuple[tuple[str, ...], ...]:
    """The sets of ``_needed`` that look rarest; a text in lower case that lacks all of one set cannot match."""
    long = {x for x in _needed(sre.parse(regex)) if min(map(len, x)) > 1}
    found = sorted(long, key=_rarity, reverse=True)[:KEY_SETS]
    if not found:
        raise ValueError(f"no literal part: {regex}")
    return tuple(tuple(sorted(x)) for x in found)


def rules() -> list[tuple[int, str, str, str]]:
    """``(rank, label, keys, regex)`` in order: four rules for each named licence, then the single ones.

    ``keys`` are those of the regex: sets joined by ``&``, members by ``|``.
    """
    out = []
    for line in _NAMED.strip().splitlines():
        label, spdx, name = (x.strip() for x in line.split("; "))
        out.append((1, label, rf"SPDX-License-Identifier:\s*(?:\(\s*)?{spdx}(?![\w.-])"))
        out.append((3, label, rf"\bunder\s+(?:the\s+|an?\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:{name})(?:\s+licen[sc]e)?(?![\w-])"))
        out.append((4, label, rf"(?<![\w-])(?:{name})\s+licen[sc]e(?![\w-])"))
        out.append((4, label, rf"\blicen[sc]ed?\s*[:=]?\s*\"?(?:{spdx})(?![\w.-])"))
    for line in _SINGLE.strip().splitlines():
        rank, label, regex = line.strip().split("; ", 2)
        out.append((int(rank), label, regex))
    return [(rank, label, "&".join("|".join(x) for x in keys(regex)), regex) for rank, label, regex in out]


#: A text without any of these is no candidate for a rule: every match of every rule holds one.
GATES = (
    "licen", "under", "copyright", "rights", "gpl", "cc-by", "cc by", "creative", "domain", "dominio", "gemeinfrei", "droits",
    "vorbehalten", "derechos", "permission", "warranty", "redistribution", "promote", "mentioning", "apache", "altered", ".org",
    "joinup", "wtfpl", "perl", "confidential", "unauthorized",
)


def _rule_array() -> Column:
    """The rules as one literal array."""

    def sets(key: str) -> Column:
        each = [x.split("|") for x in key.split("&")]
        return F.array(*(F.array(*map(F.lit, x)) for x in (each + each[-1:] * KEY_SETS)[:KEY_SETS]))

    made = [
        F.struct(F.lit(r).alias("rank"), F.lit(i).alias("rule"), F.lit(label).alias("label"), sets(key).alias("keys"), F.lit(f"(?is){regex}").alias("regex"))
        for i, (r, label, key, regex) in enumerate(rules())
    ]
    return F.array(*made)


def _places(text: Column, rule: Column) -> Column:
    """All places of a rule in a text: the pieces between matches and the matches give their offsets."""
    return let(
        F.struct(F.split(text, rule["regex"], -1).alias("gap"), F.regexp_extract_all(text, rule["regex"], F.lit(0)).alias("hit")),
        lambda m: F.aggregate(
            F.arrays_zip(F.slice(m["gap"], F.lit(1), F.size(m["hit"])).alias("g"), m["hit"].alias("h")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,neg_end:int,rank:int,rule:int,label:string>>").alias("out")),
            lambda z, x: F.struct(
                (z["at"] + F.length(x["g"]) + F.length(x["h"])).alias("at"),
                F.concat(
                    z["out"],
                    F.array(
                        F.struct(
                            (z["at"] + F.length(x["g"])).alias("start"),
                            (-(z["at"] + F.length(x["g"]) + F.length(x["h"]))).alias("neg_end"),
                            rule["rank"].alias("rank"),
                            rule["rule"].alias("rule"),
                            rule["label"].alias("label"),
                        )
                    ),
                ).alias("out"),
            ),
        )["out"],
    )


def _survivors(places: Column) -> Column:
    """Places that no place of the same or a better rank holds.

    In order of start and then longest first, a place lies inside an earlier
    one exactly if some earlier end reaches its own; the furthest end of each
    rank is all that needs to be known.
    """
    start = F.struct(
        F.array(*(F.lit(-1) for _ in RANK_SCORE)).alias("far"), F.array().cast("array<struct<rank:int,label:string>>").alias("out")
    )

    def step(z: Column, p: Column) -> Column:
        better = F.array_max(F.slice(z["far"], F.lit(1), p["rank"]))
        far = F.transform(z["far"], lambda e, i: F.when(i + 1 == p["rank"], F.greatest(e, -p["neg_end"])).otherwise(e))
        kept = F.when(better >= -p["neg_end"], z["out"]).otherwise(
            F.concat(z["out"], F.array(F.struct(p["rank"].alias("rank"), p["label"].alias("label"))))
        )
        return F.struct(far.alias("far"), kept.alias("out"))

    return F.aggregate(F.array_sort(places), start, step)["out"]


def _detections(text: Column, low: Column) -> Column:
    """``(rank, label)`` of a text's surviving places."""
    every = sorted({k for _, _, key, _ in rules() for x in key.split("&") for k in x.split("|")})
    there = F.filter(F.array(*map(F.lit, every)), lambda k: F.contains(low, k))

    def holds(r: Column, stand: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.arrays_overlap(F.get(r["keys"], F.lit(i)), stand) for i in range(KEY_SETS)))

    found = let(there, lambda stand: F.filter(_rule_array(), lambda r: holds(r, stand)))
    matched = F.filter(found, lambda r: F.rlike(text, r["regex"]))
    return let(F.flatten(F.transform(matched, lambda r: _places(text, r))), _survivors)


def _word_array(text: Column) -> Column:
    return F.filter(F.split(text, f"[{_GAP}]+"), lambda w: w != "")


def _base(text: Column) -> Column:
    """Places of the base phrases: array of ``(start, label)`` in word positions."""

    def places(w: Column, every: Column, phrase: tuple[str, ...], label: str) -> Column:
        def stands(i: Column) -> Column:
            out = F.lit(True)
            for k, p in enumerate(phrase):
                out = out & F.coalesce(F.get(w, i + k) == p, F.lit(False))
            return out

        return F.transform(F.filter(every, stands), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    def at(w: Column) -> Column:
        every = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)))
        return F.concat(*(places(w, every, phrase, label) for phrase, label in BASE))

    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return let(let(lowered, _word_array), at)


def scan_licenses(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (columns ``carry``, all by default) with ``n_words, n_base,
    first_word, last_word, base_labels, labels, score``."""
    keep = drop_names(df.select(*map(quoted, df.columns if carry is None else carry)), OUT)
    none_b = F.array().cast("array<struct<start:bigint,label:string>>")
    none_m = F.array().cast("array<struct<rank:int,label:string>>")

    def judge(t: Column) -> Column:
        def with_low(low: Column) -> Column:
            has = lambda *keys: F.lit(True) if not keys else F.contains(low, F.lit(keys[0])) & has(*keys[1:])
            base = F.lit(False)
            for phrase, _ in BASE:
                base = base | has(*sorted(set(phrase), key=len, reverse=True))
            any_key = F.lit(False)
            for k in GATES:
                any_key = any_key | has(k)
            return F.struct(
                F.size(_word_array(t)).cast("long").alias("n_words"),
                F.when(base, _base(t)).otherwise(none_b).alias("b"),
                F.when(any_key, _detections(t, low)).otherwise(none_m).alias("m"),
            )

        return let(F.lower(t), with_low)

    got = df.select(hold(df, keep), let(F.coalesce(F.col(quoted(text)), F.lit("")), judge).alias("r"))
    starts = F.transform("r.b", lambda x: x["start"])
    base_names = F.array_sort(F.array_distinct(F.transform("r.b", lambda x: x["label"])))
    names = F.array_sort(F.array_distinct(F.concat(F.transform("r.b", lambda x: x["label"]), F.transform("r.m", lambda x: x["label"]))))
    level = F.array(*(F.lit(x) for x in RANK_SCORE))
    best = F.array_max(F.transform("r.m", lambda x: F.element_at(level, x["rank"])))
    return got.select(
        *let_go(keep),
        F.col("r.n_words").alias("n_words"),
        F.size("r.b").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_names, ",").alias("base_labels"),
        F.array_join(names, ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("r.b") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
