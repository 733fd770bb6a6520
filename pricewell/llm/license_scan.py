"""Licences named in texts, by sentence rules.

A text is cut into sentences, and these are normalised to words (lower case, no articles, comment marks or punctuation). A table of
licence sentences, looked up by their first word, gives the identifiers that a sentence holds. The sequence of identifiers is then matched against ordered
rules: the first rule whose identifiers stand in that order names a licence and uses its sentences up; where a rule says so no more than some other
sentences may lie between. Each rule takes one pass over the identifiers that are left, with one open match, so recognition is linear in the text. Licence
sentences that no rule uses are told as UNKNOWN. One pass over the rows; nothing is shuffled.

"Or later" in any of its wordings, or a plus sign, makes a GNU licence ``-or-later``, else it is ``-only``; without a version it is the family's name alone.
A reference after "not", "never", "no", "nor" or "neither", with nothing between but words such as "licensed under the", is no reference.

Cases: null or empty text has no sentences and no licence. Long texts are scanned whole; texts
without any word that a known sentence needs are skipped by one search. A sentence may hold a known one several times; an SPDX tag
gives every licence of its expression, which ends with the line or the closing parenthesis. A reservation of rights right before a licence's text is its
copyright line. Each repeated row gets the same result. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import per_bytes, texts

# Identifiers and words of known licence sentences. [x] may be missing, x|y is either, * is any words, <v> a version, <later> a
# wording of "or later", <by> a combination of conditions, <none> the absence of a version, <id> a licence's short name, <short> a short name with its
# version in one word. Articles and punctuation are left out, and licence is spelt license.
_AS_PUBLISHED = "[gpl|lgpl|agpl] [as] [published] [by] [free] [software] [foundation] [either] [version|v] <v> [<later>]"
# Further licences that a sentence can name: identifier, words, SPDX name ({0} is the version).
NAMED = (
    ("ofl-ref", "sil open font license [version|v] <v>", "OFL-{0}"),
    ("ofl-any", "sil open font license <none>", "OFL-1.1"),
    ("eupl-ref", "european union public license [eupl] [version|v] <v>", "EUPL-{0}"),
    ("busl-ref", "business source license [version|v] <v>", "BUSL-{0}"),
    ("psf-ref", "python software foundation license [version|v] <v>", "PSF-{0}"),
    ("psf-any", "python software foundation license <none>", "PSF-2.0"),
    ("wtfpl-ref", "do what fuck you want to public license", "WTFPL"),
    ("ms-pl-ref", "microsoft public license", "MS-PL"),
    ("ms-rl-ref", "microsoft reciprocal license", "MS-RL"),
    ("osl-ref", "open software license [version|v] <v>", "OSL-{0}"),
    ("afl-ref", "academic free license [version|v] <v>", "AFL-{0}"),
    ("ecl-ref", "educational community license [version|v] <v>", "ECL-{0}"),
    ("cpl-ref", "common public license [version|v] <v>", "CPL-{0}"),
    ("ipl-ref", "ibm public license [version|v] <v>", "IPL-{0}"),
    ("lppl-ref", "latex project public license [version|v] <v>", "LPPL-{0}"),
    ("npl-ref", "netscape public license [version|v] <v>", "NPL-{0}"),
    ("php-ref", "php license [version|v] <v>", "PHP-{0}"),
    ("ruby-ref", "ruby license", "Ruby"),
    ("perl-ref", "under same terms as perl itself", "Artistic-1.0-Perl"),
    ("zpl-ref", "zope public license [version|v] <v>", "ZPL-{0}"),
    ("gfdl-ref", "gnu free documentation license [version|v] <v>", "GFDL-{0}"),
    ("odbl-ref", "open database license [version|v] <v>", "ODbL-{0}"),
    ("odbl-any", "open database license <none>", "ODbL-1.0"),
    ("ncsa-ref", "university of illinois ncsa open source license", "NCSA"),
    ("upl-ref", "universal permissive license [version|v] <v>", "UPL-{0}"),
    ("cecill-ref", "cecill free software license [agreement] [version|v] <v>", "CECILL-{0}"),
    ("sspl-ref", "server side public license [version|v] <v>", "SSPL-{0}"),
    ("elastic-ref", "elastic license [version|v] <v>", "Elastic-{0}"),
    ("mulan-ref", "mulan permissive software license [version|v] <v>", "MulanPSL-{0}"),
    ("vim-ref", "vim license", "Vim"),
    ("openssl-ref", "openssl license", "OpenSSL"),
    ("curl-ref", "curl license", "curl"),
    ("postgresql-ref", "postgresql license", "PostgreSQL"),
    ("zlib-ref", "zlib license", "Zlib"),
    ("isc-ref", "isc license|licensed", "ISC"),
    ("unlicense-ref", "unlicense license", "Unlicense"),
    ("apache-any", "under|by apache [software] license <none>", "Apache"),
    ("mpl-any", "under|by mozilla public license <none>", "MPL"),
    ("epl-any", "under|by eclipse public license <none>", "EPL"),
)
# Names of SPDX that are spelt otherwise than word by word in capitals, and families whose names stand before a version in one word.
SPDX_NAMES = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 "
    "CC-BY-NC-ND-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CECILL-2.1 CPL-1.0 curl ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Ruby SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
FAMILIES = {"agpl": "AGPL", "lgpl": "LGPL", "gpl": "GPL", "apache": "Apache", "mpl": "MPL", "epl": "EPL", "eupl": "EUPL", "cddl": "CDDL", "osl": "OSL", "afl": "AFL", "ofl": "OFL", "artistic": "Artistic", "busl": "BUSL", "gfdl": "GFDL", "cecill": "CECILL", "lppl": "LPPL", "zpl": "ZPL", "upl": "UPL", "sspl": "SSPL"}
SENTENCES = (
    ("apache-ref", "apache [software] license [version|v] <v>"),
    ("apache-condition", "you may not use this file except in compliance with license"),
    ("apache-copy", "you may obtain copy of license at"),
    ("mit-ref", "mit|expat|mit-style license|licensed"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining copy of this software"),
    ("mit-notice", "above copyright notice and this permission notice shall be included in all"),
    ("as-is", "software is provided as is without warranty of any kind"),
    ("isc-grant", "permission to use copy modify and [or] distribute this software for any purpose"),
    ("isc-as-is", "software is provided as is and * disclaims all warranties"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistributions of source code must retain above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce above copyright notice"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-endorse", "neither name|names of * may be used to endorse or promote products"),
    ("bsd-as-is", "this software is provided by * as is and any express or implied warranties"),
    ("bsd-ref", "bsd|bsd-style license"),
    ("bsd-n-ref", "2-clause|3-clause|4-clause bsd license"),
    ("gpl-ref", f"gnu general public license {_AS_PUBLISHED}"),
    ("gpl-ref", "gpl [license] [version|v] <v> [<later>]"),
    ("gpl-ref", "version <v> [<later>] of gnu general public license"),
    ("lgpl-ref", "version <v> [<later>] of gnu lesser|library general public license"),
    ("agpl-ref", "version <v> [<later>] of gnu affero general public license"),
    ("lgpl-ref", "lgpl [license] [version|v] <v> [<later>]"),
    ("agpl-ref", "agpl [license] [version|v] <v> [<later>]"),
    ("gpl-any", "under|by gnu general public license <none>"),
    ("gpl-any", "under|by [gnu] gpl <none>"),
    ("lgpl-any", "under|by gnu lesser|library general public license <none>"),
    ("lgpl-any", "under|by [gnu] lgpl <none>"),
    ("agpl-any", "under|by gnu affero general public license <none>"),
    ("agpl-any", "under|by [gnu] agpl <none>"),
    ("short", "<short> [<later>]"),
    ("id", "license|licensed <id>"),
    ("id", "license|licensed under <id>"),
    ("gpl-free", "this program is free software you can redistribute it and [or] modify it under terms of gnu general public license"),
    ("gpl-copy", "you should have received copy of gnu general public license"),
    ("gpl-warranty", "distributed in hope that it will be useful but without any warranty"),
    ("lgpl-ref", f"gnu lesser|library general public license {_AS_PUBLISHED}"),
    ("agpl-ref", f"gnu affero general public license {_AS_PUBLISHED}"),
    ("mpl-ref", "mozilla public license [version|v] <v>"),
    ("mpl-copy", "if copy of mpl was not distributed with this file"),
    ("epl-ref", "eclipse public license [version|v] <v>"),
    ("cddl-ref", "common development and distribution license [version|v] <v>"),
    ("bsl-ref", "boost software license [version|v] <v>"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-altered", "altered source versions must be plainly marked as such"),
    ("artistic-ref", "artistic license [version|v] <v>"),
    ("cc-ref", "cc <by> [license] <v>"),
    ("cc-ref", "creative commons <by> [license] <v>"),
    *((name, words) for name, words, _ in NAMED),
    ("cc0-ref", "cc0"),
    ("cc0-ref", "dedicated to public domain"),
    ("unlicense", "this is free and unencumbered software released into public domain"),
    ("or-later", "at your option any later version"),
    ("or-later", "or any later version"),
    ("rights-reserved", "all rights reserved"),
)
# Rules in the order in which they are tried; {n} is the n-th value caught; the last number is how many other sentences
# may lie between two of a rule's own (None: any number).
RULES = (
    (("mit-grant", "mit-notice", "as-is"), "MIT", None),
    (("mit-grant", "as-is"), "MIT", None),
    (("isc-grant", "as-is"), "ISC", None),
    (("isc-grant", "isc-as-is"), "ISC", None),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is"), "BSD-4-Clause", None),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"), "BSD-3-Clause", None),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"), "BSD-2-Clause", None),
    (("zlib-as-is", "zlib-altered"), "Zlib", None),
    (("apache-ref", "apache-condition", "apache-copy"), "Apache-{0}", None),
    (("apache-ref", "apache-condition", "apache-copy", "apache-ref"), "Apache-{0}", None),
    (("gpl-free", "gpl-ref", "or-later", "gpl-warranty", "gpl-copy"), "GPL-{0}-or-later", None),
    (("gpl-ref", "or-later", "gpl-warranty", "gpl-copy"), "GPL-{0}-or-later", None),
    (("gpl-free", "gpl-ref", "or-later"), "GPL-{0}-or-later", 1),
    (("gpl-free", "gpl-ref"), "GPL-{0}", 1),
    (("mpl-ref", "mpl-copy"), "MPL-{0}", None),
    (("gpl-ref", "or-later"), "GPL-{0}-or-later", 1),
    (("lgpl-ref", "or-later"), "LGPL-{0}-or-later", 1),
    (("agpl-ref", "or-later"), "AGPL-{0}-or-later", 1),
    (("spdx",), "{0}", None),
    (("id",), "{0}", None),
    (("short",), "{0}", None),
    (("apache-ref",), "Apache-{0}", None),
    (("bsd-n-ref",), "BSD-{0}", None),
    (("mit-ref",), "MIT", None),
    (("bsd-ref",), "BSD", None),
    (("gpl-ref",), "GPL-{0}", None),
    (("gpl-any",), "GPL", None),
    (("lgpl-ref",), "LGPL-{0}", None),
    (("lgpl-any",), "LGPL", None),
    (("agpl-ref",), "AGPL-{0}", None),
    (("agpl-any",), "AGPL", None),
    (("mpl-ref",), "MPL-{0}", None),
    (("epl-ref",), "EPL-{0}", None),
    (("cddl-ref",), "CDDL-{0}", None),
    (("bsl-ref",), "BSL-{0}", None),
    (("artistic-ref",), "Artistic-{0}", None),
    (("cc-ref",), "CC-{0}-{1}", None),
    (("cc0-ref",), "CC0-1.0", None),
    (("unlicense",), "Unlicense", None),
    *(((name,), told, None) for name, _, told in NAMED),
    (("gpl-free",), "GPL", None),
    (("rights-reserved",), "Proprietary", None),
)
#: What a reservation of rights may head without meaning more than a copyright line.
HEADED = ("mit-grant", "isc-grant", "bsd-grant", "apache-ref", "apache-condition", "gpl-free", "gpl-ref", "mpl-ref", "zlib-as-is", "mit-ref", "spdx")
_SPDX = re.compile(r"spdx-license-identifier: *([^\x02]*)")
_WORDS = re.compile(r"[a-z0-9]+(?:[.+\-][a-z0-9]+)*\+?")
_VERSION = re.compile(r"v?\.?(\d+(?:\.\d+)*)(\+?)$")
_BY = re.compile(r"by(?:-nc)?(?:-nd|-sa)?$")
_SHORT = re.compile(rf"({'|'.join(FAMILIES)})-?v?-?(\d+(?:\.\d+)*)(-only|-or-later|\+)?$")
_ARTICLES = frozenset(("the", "a", "an"))
_KNOWN = {x.lower(): x for x in SPDX_NAMES}
_CC_NAME = re.compile(r"\b(creative commons|cc)[ -](?:attribution|by)((?:[- ](?:non-?commercial|no-?derivatives|no-?derivs|share-?alike|nc|nd|sa)\b)*)(?:[ -](?:unported |international |generic )?(?=v?\d))?")
_CC_PARTS = re.compile(r"(non-?commercial|nc)|(no-?deriv\w*|nd)|(share-?alike|sa)")
# One word of every sentence above, so that no wrapping or comment mark can hide it; "rem" and "dnl" are marks that may touch a word.
_HINT = re.compile(rb"licen[sc]e|permission|redistribut|warrant|endorse|advertising|altered|domain|reserved|option\b|later\b|perl\b|gpl|commons\b|\b(?:" + "|".join(FAMILIES).encode() + rb")[-v ]*\d|(?:\b|rem|dnl)(?:cc\b|cc-|cc0|mpl\b)", re.I)
_NOT = frozenset(("not", "never", "no", "nor", "neither", "cannot"))
_BETWEEN = frozenset("under by to with as is are be being been of in it this that terms conditions licensed released distributed covered available published provided governed subject use used any longer software code work program".split())


def _steps(words: str) -> list[tuple[bool, frozenset[str] | str]]:
    """(may be missing, words or kind of hole) of each part of a table entry."""
    return [(w.startswith("["), w.strip("[]") if "<" in w or w == "*" else frozenset(w.strip("[]").split("|"))) for w in words.split()]


def _table() -> tuple[dict[str, list[tuple[str, list]]], list[tuple[str, list]]]:
    """Entries by their first word, and those that begin with a hole."""
    out, holes = {}, []
    for name, words in SENTENCES:
        steps = _steps(words)
        if isinstance(steps[0][1], str):
            holes.append((name, steps))
        else:
            for first in steps[0][1]:
                out.setdefault(first, []).append((name, steps))
    return out, holes


_BY_WORD, _BY_HOLE = _table()


def _later(words: list[str], at: int) -> int:
    """How many words from ``at`` on say "or later"; 0 if none do."""
    k = at
    if k < len(words) and words[k] in ("or", "and"):
        k += 1
    option = words[k : k + 3] == ["at", "your", "option"]
    k += 3 * option
    some = k < len(words) and words[k] == "any"
    k += some
    if k >= len(words) or words[k] not in ("later", "newer", "higher", "greater") or k == at:
        return 0
    k += 1
    if k < len(words) and words[k] in ("version", "versions", "release"):
        k += 1
    return k - at


def _word_fits(word: str, want: frozenset[str] | str) -> tuple[str, ...] | None:
    """What a hole or word catches of one word, else None."""
    if want == "<v>":
        m = _VERSION.match(word)
        return (m.group(1), "+") if m and m.group(2) else (m.group(1),) if m else None
    if want == "<by>":
        return (word,) if _BY.match(word) else None
    if want == "<id>":
        return (_KNOWN[word],) if word in _KNOWN else None
    if want == "<short>":
        m = _SHORT.match(word)
        if not m:
            return (_KNOWN[word],) if word in _KNOWN and "-" in word else None
        family, version, more = m.groups()
        gnu = {"+": "-or-later", None: "-only"}.get(more, more) if family.endswith("gpl") else more or ""
        return (f"{FAMILIES[family]}-{version if '.' in version else version + '.0'}{gnu}",)
    if word in want:
        return (word,) if len(want) > 1 and word.endswith("-clause") else ()
    return None


def _fits(words: list[str], at: int, steps: list, k: int, tails: dict) -> tuple[str, ...] | None:
    """What the holes catch if the words from ``at`` on are those of the entry, else None."""
    if k == len(steps):
        return ()
    optional, want = steps[k]
    if want == "*":
        # where the rest stands is worked out once a sentence, so that no start is followed to the end again
        key = id(steps)
        if key not in tails:
            tails[key] = [x for x in range(len(words)) if _fits(words, x, steps, k + 1, tails) is not None]
        found = bisect_left(tails[key], at)
        return _fits(words, tails[key][found], steps, k + 1, tails) if found < len(tails[key]) else None
    if want == "<none>":
        versions = (_VERSION.match(w) for w in words[at : at + 2] if w not in ("version", "v"))
        return None if words[at : at + 1] and (next(versions, None) if words[at] in ("version", "v") else _VERSION.match(words[at])) else ()
    if want == "<later>":
        n = _later(words, at)
        if n:
            rest = _fits(words, at + n, steps, k + 1, tails)
            if rest is not None:
                return ("+", *rest)
    elif at < len(words):
        caught = _word_fits(words[at], want)
        if caught is not None:
            rest = _fits(words, at + 1, steps, k + 1, tails)
            if rest is not None:
                return (*caught, *rest)
    return _fits(words, at, steps, k + 1, tails) if optional else None


def _negated(words: list[str], at: int) -> bool:
    """Whether a denial stands before ``at`` with nothing but linking words between."""
    for k in range(at - 1, max(-1, at - 9), -1):
        if words[k] in _NOT:
            return True
        if words[k] not in _BETWEEN:
            return False
    return False


_SENTENCE = re.compile(r"(?<=[.!?])(?<![\s(,][vV]\.)[\s\"')]+(?=\S)|\n\s*\n")
_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|dnl|rem)[ \t]*", re.I)
_TAG = re.compile(r"(?i)spdx-license-identifier:[ \t]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^\n]*|[^\n]*)")
_EXPRESSION = re.compile(r"[( ]*[a-z0-9][a-z0-9.:+-]*[) ]*(?:(?<=[) ])(?:and|or|with) [( ]*[a-z0-9][a-z0-9.:+-]*[) ]*)*")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, normalised) of each sentence."""
    out, at = [], 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        bare = _MARKS.sub(" ", text[at:end])
        norm = " ".join(_TAG.sub("\\g<0>\x02", bare).lower().split())
        if norm:
            out.append((at, end, norm))
        if m:
            at = m.end()
    return out


def _conditions(m: re.Match) -> str:
    parts = [next(x for x, told in zip(("nc", "nd", "sa"), g, strict=True) if told) for g in _CC_PARTS.findall(m.group(2))]
    return f"{m.group(1)} {'-'.join(['by', *parts])} "


def words_of(norm: str) -> list[tuple[int, str]]:
    """(place, word) of a normalised sentence, without articles."""
    plain = _CC_NAME.sub(_conditions, norm.replace("as-is", "as is"))
    out = []
    for m in _WORDS.finditer(plain):
        w = "license" + m.group()[7:] if m.group().startswith("licence") else m.group()
        if w.endswith("-licensed"):
            out.append((m.start(), w[:-9]))
            w = "licensed"
        if w not in _ARTICLES:
            out.append((m.start(), w))
    return out


def identify(sentence: str) -> list[tuple[str, tuple[str, ...]]]:
    """Identifiers of the known sentences that this one holds, repeats too, in the order in which they stand."""
    hits = [(m.start(), "spdx", (x,)) for m in _SPDX.finditer(sentence) for x in expression(m.group(1))]
    placed = words_of(_SPDX.sub(lambda m: " " * len(m.group()), sentence))
    words, tails = [w for _, w in placed], {}
    for k, (at, w) in enumerate(placed):
        for name, steps in (*_BY_WORD.get(w, ()), *_BY_HOLE):
            if name == "bsd-ref" and k and words[k - 1].endswith("-clause"):
                continue  # part of the longer name
            if name == "gpl-any" and w == "gpl" or name == "short" and k and words[k - 1] in ("license", "licensed") and w in _KNOWN:
                continue  # told by the longer entry
            caught = _fits(words, k, steps, 0, tails)
            if caught is not None and not _negated(words, k + (w in ("under", "by"))):
                hits.append((at, name, caught))
    return [(name, caught) for _, name, caught in sorted(hits, key=lambda h: h[:2])]


def expression(value: str) -> list[str]:
    """Licences of an SPDX expression; what follows WITH is an exception and no licence."""
    m = _EXPRESSION.match(value)
    words = m.group().replace("(", " ").replace(")", " ").split() if m else []
    return [w.rstrip(".:") for w, before in zip(words, ["", *words], strict=False) if w not in ("and", "or", "with") and before != "with"]


def _name(told: str, ids: tuple[str, ...], values: list[str]) -> str:
    """A licence's name from a rule's and what its sentences have caught."""
    later, plain = "+" in values, [_told(v) for v in values if v != "+"]
    if ids in (("spdx",), ("id",), ("short",)):
        found = _KNOWN.get(values[0].lower(), values[0])
        return found.removesuffix("-only") + "-or-later" if later and "GPL-" in found and not found.endswith("-or-later") else found
    name = told.format(*plain, *([""] * 2))
    if told in ("GPL-{0}", "LGPL-{0}", "AGPL-{0}"):
        return name + ("-or-later" if later else "-only")
    return name


def recognise(tokens: list[tuple[int, str, tuple[str, ...]]]) -> list[str]:
    """Licences of a sequence of (sentence number, identifier, values).

    A rule's open match waits for its next identifier. Its first identifier, or one with a version that it has just used, moves the match on to the
    nearer one when it comes again; a gap that grows too wide closes it. So each rule is one pass.
    """
    heads = {k for k, ((_, token, _), after) in enumerate(zip(tokens, tokens[1:], strict=False)) if token == "rights-reserved" and after[1] in HEADED}
    left, out = [k for k in range(len(tokens)) if k not in heads], []
    for ids, name, gap in RULES:
        if not {tokens[k][1] for k in left}.issuperset(ids):
            continue
        gone, used, last = set(), [], 0
        for k in left:
            n, token, caught = tokens[k]
            if used and gap is not None and n - last > gap + 1:
                used = []
            if token == ids[len(used)]:
                used.append(k)
            elif used and token == ids[len(used) - 1] and (caught or len(used) == 1):
                used[-1] = k
            else:
                continue
            last = n
            if len(used) == len(ids):
                out.append(_name(name, ids, [x for u in used for x in tokens[u][2]]))
                gone.update(used)
                used = []
        if gone:
            left = [k for k in left if k not in gone]
    if left:
        out.append("UNKNOWN")
    return sorted(set(out))


def _told(value: str) -> str:
    """A caught value as licence names have it."""
    if value.endswith("-clause"):
        return value.title()
    return value.upper() if value.startswith("by") else value if "." in value else f"{value}.0"


def scan(raw: bytes) -> tuple[int, list[str], list[str], list[tuple[int, int]]]:
    """Number of licence sentences, their identifiers, the licences, and where the sentences stand."""
    if not _HINT.search(raw):
        return 0, [], [], []
    tokens, spans = [], []
    for n, (a, e, s) in enumerate(sentences(raw.decode("utf-8", "replace"))):
        for name, numbers in identify(s):
            tokens.append((n, name, numbers))
            spans.append((a, e))
    return len({n for n, _, _ in tokens}), [t[1] for t in tokens], recognise(tokens), spans


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_license_sentences, sentence_ids, licenses (SPDX names, sorted) and spans in code points."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, ids, names, spans = zip(*map(scan, texts(batch)), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(names, pa.list_(pa.string())), pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int64())))], ["doc_id", "n_license_sentences", "sentence_ids", "licenses", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_bytes(source, run, "doc_id long, n_license_sentences long, sentence_ids array<string>, licenses array<string>, spans array<array<long>>")
