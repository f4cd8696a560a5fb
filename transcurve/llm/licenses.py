"""Licence scans by sentence-rule recognition, in DataFrame functions only.

A text is cut into sentences, each sentence is normalised (lower case, every run of
other characters than letters and digits is one space) and mapped to the identifiers of
the known licence sentences it holds, in the order in which they stand in it. The
identifiers, in text order, are matched against the ordered licence rules: a rule takes
its sequences out, so that a later, less specific rule sees only what is left. All of it
is one projection: no shuffle.

A line with an SPDX tag is a sentence of its own; the names in its expression are looked
up in a map. A copyright line, or that all rights are reserved, is known but is no licence.
Sentences without any of the ``ANCHORS`` are not tried against the patterns; every pattern
holds one in each of its branches, so nothing is lost.

Hard-wrapped texts work: a single line feed is a space, a blank line ends a sentence.
Null and empty texts hold no sentences. Texts of any length are read whole. An identifier
that a sentence holds twice counts once; of two at one place the earlier in the table comes
first. Repeated rows give equal results; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

_GPL = r"\b(?:gnu general public licen[cs]e|gnu gpl|gpl)"
_LGPL = r"\b(?:(?:lesser|library) general public licen[cs]e|lgpl)"
_BY_FSF = r"(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?"

# Licence sentences by identifier, as patterns over the normalised sentence.
SENTENCES = (
    ("copyright", r"\bcopyright (?:c )?(?:[a-z]+ ){0,3}?(?:19|20)[0-9]{2}\b"),
    ("all_rights", r"\ball rights reserved\b"),
    ("apache2_ref", r"\bapache (?:software )?licen[cs]e(?: version| v)? ?2(?: 0)?\b|\bapache 2(?: 0)? licen[cs]e|\bapache 2 0\b"),
    ("apache2_comply", r"\bnot use this (?:file|work|software) except in compliance with the licen[cs]e\b"),
    ("apache2_copy", r"\bobtain a copy of the licen[cs]e at\b"),
    ("apache2_asis", r"\bdistributed under the licen[cs]e is distributed on an as is basis\b"),
    ("apache2_limits", r"\bsee the licen[cs]e for the specific language governing permissions and limitations\b"),
    ("mit_ref", r"\bmit licen[cs]e|\blicen[cs]ed? (?:under )?mit\b"),
    ("mit_grant", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b"),
    ("mit_notice", r"\babove copyright notice and this permission notice shall be included\b"),
    ("mit_asis", r"\bthe software is provided as is without warranty of any kind\b"),
    ("mit_liability", r"\bin no event shall the authors or copyright holders be liable\b"),
    ("bsd_redist", r"\bredistribution and use in source and binary forms with or without modification are permitted\b"),
    ("bsd_source", r"\bredistributions of source code must retain the above copyright notice\b"),
    ("bsd_binary", r"\bredistributions in binary form must reproduce the above copyright notice\b"),
    ("bsd_ads", r"\ball advertising materials mentioning features or use of this software must display\b.* acknowledge?ment\b"),
    ("bsd_endorse", r"\bused to endorse or promote products derived from this software\b"),
    ("bsd_asis", r"\bthis software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is\b.* warrant"),
    ("bsd_liability", r"\bin no event shall the (?:copyright (?:owner|holder)s?|regents|authors?)(?: or contributors)? be liable\b"),
    ("bsd3_ref", r"\b(?:bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd)\b"),
    ("bsd2_ref", r"\b(?:bsd 2 clause|2 clause bsd|simplified bsd)\b"),
    ("bsd_ref", r"\bbsd (?:style )?licen[cs]e"),
    ("agpl_ref", r"\baffero general public licen[cs]e\b|\bagpl(?:v?3)?\b"),
    ("lgpl3_ref", _LGPL + _BY_FSF + r"3\b|\blgplv?3\b"),
    ("lgpl21_ref", _LGPL + _BY_FSF + r"2 1\b|\blgplv?2 1\b"),
    ("lgpl_ref", _LGPL + r"\b|\blgplv?2\b"),
    ("gpl3_ref", _GPL + _BY_FSF + r"3\b|\bgplv?3\b"),
    ("gpl2_ref", _GPL + _BY_FSF + r"2\b|\bgplv?2\b"),
    ("gpl_later", r"\bat your option any later version\b|\bgpl[a-z0-9]*(?: [a-z0-9]+){0,7} or later\b"),
    ("gpl_hope", r"\bdistributed in the hope that it will be useful but without any warranty\b"),
    ("gpl_received", r"\byou should have received a copy of the gnu (?:(?:lesser|library|affero) )?general public licen[cs]e\b"),
    ("gpl_ref", _GPL + r"\b"),
    ("either3", r"^(?:either )?version 3 of the licen[cs]e\b"),
    ("either21", r"^(?:either )?version 2 1 of the licen[cs]e\b"),
    ("either2", r"^(?:either )?version 2 of the licen[cs]e\b"),
    ("mpl2_ref", r"\bmozilla public licen[cs]e(?: version| v)? ?2\b|\bmpl(?: version| v)? ?2\b|\bmplv2\b"),
    ("mpl_ref", r"\bmozilla public licen[cs]e\b"),
    ("epl2_ref", r"\beclipse public licen[cs]e(?: version| v)? ?2\b|\bepl(?: version| v)? ?2\b"),
    ("epl1_ref", r"\beclipse public licen[cs]e(?: version| v)? ?1\b|\bepl(?: version| v)? ?1\b"),
    ("epl_ref", r"\beclipse public licen[cs]e\b"),
    ("cddl_ref", r"\bcommon development and distribution licen[cs]e\b"),
    ("eupl_ref", r"\beuropean union public licen[cs]e\b|\beupl\b"),
    ("boost_ref", r"\bboost software licen[cs]e\b|\bbsl 1 0\b"),
    ("boost_grant", r"\bpermission is hereby granted free of charge to any person or organization obtaining a copy\b"),
    ("zlib_ref", r"\bzlib (?:libpng )?licen[cs]e\b"),
    ("zlib_grant", r"\bpermission is granted to anyone to use this software for any purpose\b"),
    ("zlib_origin", r"\borigin of this software must not be misrepresented\b"),
    ("zlib_altered", r"\baltered source versions must be plainly marked as such\b"),
    ("zlib_notice", r"\bthis notice may not be removed or altered from any source distribution\b"),
    ("zlib_asis", r"\bthis software is provided as is without any express or implied warranty\b"),
    ("artistic2_ref", r"\bartistic licen[cs]e(?: version| v)? ?2\b"),
    ("artistic_ref", r"\bartistic licen[cs]e\b"),
    ("wtfpl_ref", r"\bdo what the fuck you want to public licen[cs]e\b|\bwtfpl\b"),
    ("isc_ref", r"\bisc licen[cs]e\b"),
    ("isc_grant", r"\bpermission to use copy modify and (?:or )?distribute this software(?: and its documentation)? for any purpose\b"),
    ("isc_asis", r"\bthe software is provided as is and the author disclaims all warranties\b"),
    ("cc_by_nc_nd", r"\bcc by nc nd\b|\battribution non ?commercial no ?deriv"),
    ("cc_by_nc_sa", r"\bcc by nc sa\b|\battribution non ?commercial share ?alike\b"),
    ("cc_by_nc", r"\bcc by nc\b(?! sa| nd)|\battribution non ?commercial\b(?! share| no ?deriv)"),
    ("cc_by_nd", r"\bcc by nd\b|\battribution no ?deriv"),
    ("cc_by_sa", r"\bcc by sa\b|\battribution share ?alike\b"),
    ("cc_by", r"\bcc by(?: [1-4] [0-9]\b| licen| ?$)|\bcreative commons attribution\b(?! non ?commercial| share| no ?deriv)"),
    ("cc0", r"\bcc0\b|\bcreative commons zero\b|\bcc zero\b"),
    ("public_domain", r"\b(?:released|dedicated|placed|is) (?:in|into|to) the public domain\b"),
    ("unlicense", r"\bthe unlicen[cs]e\b|\bfree and unencumbered software released into the public domain\b"),
    ("proprietary", r"\bunauthori[sz]ed (?:copying|use|distribution|reproduction)\b.* prohibited\b|\bproprietary and confidential\b|\bconfidential and proprietary\b"),
)
#: Identifiers of a family's bare name, which count only in sentences without its more telling ones.
BARE = {
    "bsd_ref": ("bsd3_ref", "bsd2_ref"), "lgpl_ref": ("lgpl3_ref", "lgpl21_ref", "gpl_received"), "agpl_ref": ("gpl_received",), "gpl_ref": ("gpl3_ref", "gpl2_ref", "gpl_received"),
    "mpl_ref": ("mpl2_ref",), "epl_ref": ("epl2_ref", "epl1_ref"), "artistic_ref": ("artistic2_ref",), "public_domain": ("unlicense",),
}
#: Parts of words of which every branch of every pattern holds one; the short ones are looked for as words.
ANCHORS = (
    "licen copyright permission redistribut warrant domain reserved commons liable endorse gpl apache bsd attribution cc0 unencumbered misrepresented altered prohibited proprietary confidential option eupl wtfpl advertising".split()
)
SHORT = "cc mpl epl bsl mplv2".split()

# Names of licences in SPDX expressions, normalised, and what they are reported as.
SPDX = {
    "mit": "MIT", "mit 0": "MIT-0", "apache 2 0": "Apache-2.0", "apache 1 1": "Apache-1.1", "isc": "ISC", "0bsd": "0BSD", "bsd 2 clause": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "bsd 4 clause": "BSD-4-Clause",
    "gpl 2 0": "GPL-2.0", "gpl 2 0 only": "GPL-2.0", "gpl 2 0 or later": "GPL-2.0", "gpl 3 0": "GPL-3.0", "gpl 3 0 only": "GPL-3.0", "gpl 3 0 or later": "GPL-3.0",
    "lgpl 2 0": "LGPL-2.0", "lgpl 2 0 only": "LGPL-2.0", "lgpl 2 0 or later": "LGPL-2.0", "lgpl 2 1": "LGPL-2.1", "lgpl 2 1 only": "LGPL-2.1", "lgpl 2 1 or later": "LGPL-2.1", "lgpl 3 0": "LGPL-3.0", "lgpl 3 0 only": "LGPL-3.0", "lgpl 3 0 or later": "LGPL-3.0",
    "agpl 3 0": "AGPL-3.0", "agpl 3 0 only": "AGPL-3.0", "agpl 3 0 or later": "AGPL-3.0", "mpl 1 1": "MPL-1.1", "mpl 2 0": "MPL-2.0", "epl 1 0": "EPL-1.0", "epl 2 0": "EPL-2.0", "cddl 1 0": "CDDL", "cddl 1 1": "CDDL",
    "eupl 1 1": "EUPL", "eupl 1 2": "EUPL", "bsl 1 0": "BSL-1.0", "zlib": "Zlib", "artistic 1 0": "Artistic", "artistic 2 0": "Artistic-2.0", "wtfpl": "WTFPL", "unlicense": "Unlicense",
    "cc0 1 0": "CC0-1.0", "cc by 3 0": "CC-BY", "cc by 4 0": "CC-BY", "cc by sa 3 0": "CC-BY-SA", "cc by sa 4 0": "CC-BY-SA", "cc by nd 4 0": "CC-BY-ND", "cc by nc 4 0": "CC-BY-NC", "cc by nc sa 4 0": "CC-BY-NC-SA", "cc by nc nd 4 0": "CC-BY-NC-ND",
}

_GPL_REST = "gpl_later? gpl_hope? gpl_ref? lgpl_ref? agpl_ref? gpl_received?"
#: Ordered rules: licence and its sentence sequences; "?" marks a sentence that may be absent.
RULES = (
    ("Apache-2.0", ("copyright? all_rights? apache2_ref apache2_comply? apache2_ref? apache2_copy? apache2_ref? apache2_asis? apache2_limits?", "apache2_comply apache2_copy? apache2_asis? apache2_limits?")),
    ("AGPL-3.0", (f"copyright? agpl_ref gpl3_ref? either3? {_GPL_REST}",)),
    ("LGPL-3.0", (f"copyright? lgpl_ref? lgpl3_ref {_GPL_REST}", f"copyright? lgpl_ref either3 {_GPL_REST}")),
    ("LGPL-2.1", (f"copyright? lgpl_ref? lgpl21_ref {_GPL_REST}", f"copyright? lgpl_ref either21 {_GPL_REST}")),
    ("LGPL", (f"copyright? lgpl_ref lgpl_ref? {_GPL_REST}",)),
    ("GPL-3.0", (f"copyright? gpl_ref? gpl3_ref gpl3_ref? {_GPL_REST}", f"copyright? gpl_ref either3 {_GPL_REST}")),
    ("GPL-2.0", (f"copyright? gpl_ref? gpl2_ref gpl2_ref? {_GPL_REST}", f"copyright? gpl_ref either2 {_GPL_REST}")),
    ("GPL", (f"copyright? gpl_ref gpl_ref? {_GPL_REST}", "gpl_hope gpl_received?", "gpl_received")),
    ("BSD-4-Clause", ("copyright? all_rights? bsd_redist bsd_source bsd_binary bsd_ads bsd_endorse? bsd_asis? bsd_liability?",)),
    ("BSD-3-Clause", ("copyright? all_rights? bsd3_ref? bsd_redist bsd_source bsd_binary bsd_endorse bsd_asis? bsd_liability?", "copyright? bsd3_ref")),
    ("BSD-2-Clause", ("copyright? all_rights? bsd2_ref? bsd_redist bsd_source bsd_binary bsd_asis? bsd_liability?", "copyright? bsd2_ref")),
    ("BSD", ("copyright? bsd_ref", "bsd_redist")),
    ("BSL-1.0", ("copyright? boost_ref boost_ref? boost_grant?", "copyright? boost_grant")),
    ("MIT", ("copyright? mit_ref? copyright? mit_grant mit_notice? mit_asis? mit_liability?", "copyright? mit_ref")),
    ("ISC", ("copyright? isc_ref? copyright? isc_grant isc_asis?", "copyright? isc_ref")),
    ("Zlib", ("copyright? zlib_ref? zlib_asis? zlib_grant zlib_origin? zlib_altered? zlib_notice?", "zlib_origin zlib_altered? zlib_notice?", "copyright? zlib_ref")),
    ("MPL-2.0", ("copyright? mpl2_ref mpl2_ref?",)),
    ("MPL", ("copyright? mpl_ref",)),
    ("EPL-2.0", ("copyright? epl2_ref",)),
    ("EPL-1.0", ("copyright? epl1_ref",)),
    ("EPL", ("copyright? epl_ref",)),
    ("CDDL", ("copyright? cddl_ref",)),
    ("EUPL", ("copyright? eupl_ref eupl_ref?",)),
    ("Artistic-2.0", ("copyright? artistic2_ref",)),
    ("Artistic", ("copyright? artistic_ref",)),
    ("WTFPL", ("copyright? wtfpl_ref wtfpl_ref?",)),
    ("CC-BY-NC-ND", ("copyright? cc_by_nc_nd",)),
    ("CC-BY-NC-SA", ("copyright? cc_by_nc_sa",)),
    ("CC-BY-NC", ("copyright? cc_by_nc",)),
    ("CC-BY-ND", ("copyright? cc_by_nd",)),
    ("CC-BY-SA", ("copyright? cc_by_sa",)),
    ("CC-BY", ("copyright? cc_by",)),
    ("CC0-1.0", ("copyright? cc0 cc0?",)),
    ("Unlicense", ("unlicense unlicense?",)),
    ("Public-Domain", ("public_domain",)),
    ("Proprietary", ("copyright? all_rights? proprietary proprietary? all_rights?",)),
)
#: Every licence that can be reported, the rules' first.
NAMES = tuple(dict.fromkeys([name for name, _ in RULES] + list(SPDX.values())))

_SPACE = r"\x20\x09-\x0D"
_TAG = "spdx license identifier "


def rule_pattern(name: str) -> str:
    """A licence's rule, if it has one, and its SPDX tag as a pattern over the text of identifiers ``<a><b>``."""
    one = lambda s: "".join(f"(?:<{w[:-1]}>)?" if w.endswith("?") else f"<{w}>" for w in s.split())
    return "|".join([*map(one, dict(RULES).get(name, ())), f"<spdx {name}>"])


def _any(text: Column) -> Column:
    """Whether a lower-case text holds an anchor."""
    found = text.rlike(rf"(?<![a-z0-9])(?:{'|'.join(SHORT)})(?![a-z])")
    for a in ANCHORS:
        found = text.contains(a) | found
    return found


def sentences(text: Column) -> Column:
    """The sentences of a text that hold an anchor, normalised."""
    tagged = F.regexp_replace(F.regexp_replace(text, "©", " copyright "), r"(?i)(spdx-license-identifier[\x20\x09]*:[^\n]*)", "\x1e$1\x1e")
    tagged = F.regexp_replace(tagged, r"(?i)((?:lgpl|agpl|gpl)[-v\x20]{0,2}[0-9.]+)\+", "$1 or later ")
    tagged = F.regexp_replace(tagged, r"(?i)\b(v|ver|version)\.\x20+(?=[0-9])", "$1 ")  # no end of a sentence
    ended = F.regexp_replace(F.regexp_replace(tagged, rf"([.!?;])[{_SPACE}]+", "$1\x1e"), r"\x0A[\x20\x09\x0D]*\x0A", "\x1e")
    plain = F.transform(F.split(ended, "\x1e"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    # through an array of one: the lower-case text is made once for all anchors
    return F.when(F.exists(F.array(F.lower(text)), _any), F.filter(plain, _any))


def identify(sentence: Column) -> Column:
    """Identifiers of the known sentences that a normalised sentence holds, in text order."""
    pattern = dict(SENTENCES)
    places = []
    for i, (name, p) in enumerate(SENTENCES):
        at = F.regexp_instr(sentence, F.lit(p))
        if name in BARE:
            at = F.when(sentence.rlike("|".join(pattern[x] for x in BARE[name])), 0).otherwise(at)
        places.append(F.struct(at.alias("at"), F.lit(i).alias("i"), F.lit(f"<{name}>").alias("id")))
    prose = F.transform(F.array_sort(F.filter(F.array(*places), lambda x: x["at"] > 0)), lambda x: x["id"])
    names = F.create_map(*[F.lit(x) for k, v in SPDX.items() for x in (k, f"<spdx {v}>")])
    parts = F.split(F.substring(sentence, F.lit(len(_TAG) + 1), F.length(sentence)), r" (?:or(?! later)|and|with) ")
    tag = F.transform(parts, lambda x: F.coalesce(F.try_element_at(names, F.trim(x)), F.lit("<spdx>")))
    return F.when(sentence.startswith(_TAG), tag).otherwise(prose)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sequence, licenses (in rule order), n_matches and leftover of every document."""
    ids = F.flatten(F.transform(sentences(F.col("text")), identify))
    out = docs.select("doc_id", F.coalesce(ids, F.array().cast("array<string>")).alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", "").alias("sequence"))
    # what a rule matches is gone for the next; the few documents with identifiers are walked through rule by rule
    start = F.struct(F.col("sequence").alias("rest"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        hits = F.regexp_count(acc["rest"], rule["pattern"])
        return F.struct(F.when(hits > 0, F.regexp_replace(acc["rest"], rule["pattern"], F.lit("|"))).otherwise(acc["rest"]).alias("rest"), (acc["n"] + hits).alias("n"), F.when(hits > 0, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"))

    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(name)).alias("pattern")) for name in NAMES])
    out = out.withColumn("end", F.when(F.col("sequence") == "", start).otherwise(F.aggregate(rules, start, step)))
    return out.select("doc_id", "n_sentences", "sequence", F.array_join("end.names", ",").alias("licenses"), F.col("end.n").alias("n_matches"), F.regexp_replace("end.rest", r"\|", "").alias("leftover"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


#: Written apart from the tables above, over the raw text: the ways in which the tables' documents name licences.
ORACLE = """
WITH found AS (
  SELECT doc_id, list_transform(
    regexp_extract_all(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'),
      '(?i)Apache Licen[cs]e, Version 2\\.0|MIT Licen[cs]e|GNU General Public Licen[cs]e, version [23]|CC BY(?:-[A-Z]{2})* [0-9]\\.[0-9]|All rights reserved|Copyright (?:\\(c\\) |© )?(?:19|20)[0-9]{2}'),
    lambda x: CASE
      WHEN x ILIKE 'apache%' THEN {'id': '<apache2_ref>', 'name': 'Apache-2.0', 'rank': 1}
      WHEN x ILIKE 'gnu%3' THEN {'id': '<gpl3_ref>', 'name': 'GPL-3.0', 'rank': 2}
      WHEN x ILIKE 'gnu%2' THEN {'id': '<gpl2_ref>', 'name': 'GPL-2.0', 'rank': 3}
      WHEN x ILIKE 'mit%' THEN {'id': '<mit_ref>', 'name': 'MIT', 'rank': 4}
      WHEN x ILIKE 'cc by-nc-nd%' THEN {'id': '<cc_by_nc_nd>', 'name': 'CC-BY-NC-ND', 'rank': 5}
      WHEN x ILIKE 'cc by-nc-sa%' THEN {'id': '<cc_by_nc_sa>', 'name': 'CC-BY-NC-SA', 'rank': 6}
      WHEN x ILIKE 'cc by-nc%' THEN {'id': '<cc_by_nc>', 'name': 'CC-BY-NC', 'rank': 7}
      WHEN x ILIKE 'cc by-sa%' THEN {'id': '<cc_by_sa>', 'name': 'CC-BY-SA', 'rank': 8}
      WHEN x ILIKE 'cc by%' THEN {'id': '<cc_by>', 'name': 'CC-BY', 'rank': 9}
      WHEN x ILIKE 'all%' THEN {'id': '<all_rights>', 'name': NULL, 'rank': 10}
      ELSE {'id': '<copyright>', 'name': NULL, 'rank': 11} END) AS ids
  FROM documents)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(list_transform(ids, lambda x: x.id), '') AS sequence,
       array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(ids, lambda x: x.name IS NOT NULL), lambda x: {'rank': x.rank, 'name': x.name}))), lambda x: x.name), ',') AS licenses,
       CAST(len(list_filter(ids, lambda x: x.name IS NOT NULL)) AS BIGINT) AS n_matches,
       array_to_string(list_transform(list_filter(ids, lambda x: x.name IS NULL), lambda x: x.id), '') AS leftover
FROM found"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_license_scan": query}
ORACLES: dict[str, str] = {"op9_license_scan": ORACLE}
