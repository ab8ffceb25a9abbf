"""License scans by ordered signature rules, in DataFrame operations only.

A text is reduced to its lower-cased words with one blank between them, and every rule is a regular
expression over that form. A rule is tried only on texts that hold its keyword. Where places overlap,
a place inside one of a rule with a higher priority, or inside a longer or earlier one of the same
priority, is dropped: "gnu general public license version 3" leaves no place for the rule of the bare
name. The base phrases are rules too, but their labels always stay.

Rules are tried inside one expression over the rule list, so a text is not copied once per rule; the
places of one rule are read off markers put around its matches, in time linear in the text.

Defined results: a null text is empty and has no words; a text without letters or digits has no words
and no labels; null and repeated ids are separate rows; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.common import table, written

# The word rule (A-Z lower-cased) and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Priorities: a version named by an identifier or notice, the words of a license text, a license's
# name, a hint. The confidence of a place follows from its priority.
EXACT, TEXT, NAME, HINT = 1, 2, 3, 4
CONFIDENCE = {EXACT: 0.95, TEXT: 0.9, NAME: 0.7, HINT: 0.4}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False


def _gnu() -> list[Rule]:
    """GNU licenses: identifiers, notices and names of each version, then the bare names."""
    licen, out = "licen[cs]e", []
    versions = {
        ("gpl", "general"): ["1", "2", "3"],
        ("lgpl", "(?:lesser|library) general"): ["2", "2 1", "3"],
        ("agpl", "affero general"): ["1", "3"],
        ("gfdl", "free documentation"): ["1 1", "1 2", "1 3"],
    }
    for (short, words), numbers in versions.items():
        name = f"{words} {licen}" if short == "gfdl" else f"{words} public {licen}"
        for number in numbers:
            dotted = number.replace(" ", ".") if " " in number else f"{number}.0"
            n = number if " " in number else f"{number}(?: 0)?"
            later = "(?: (?:or|and) (?:any )?(?:later|newer)(?: versions?)?| or at your option any later version)"
            out += [
                Rule(f"{short}-{dotted}-or-later", EXACT, "licen", rf"spdx {licen} identifier {short} {n} or later"),
                Rule(f"{short}-{dotted}", EXACT, "licen", rf"spdx {licen} identifier {short} {n}(?: only)?"),
                Rule(f"{short}-{dotted}-or-later", EXACT, "licen",
                     rf"(?:gnu )?{name}(?: as published by the free software foundation)?(?: either)? (?:version|v) ?{n}"
                     rf"(?: of the {licen})?{later}"),
                Rule(f"{short}-{dotted}", EXACT, "licen", rf"(?:gnu )?{name}(?: as published by the free software foundation)?"
                     rf"(?: either)? (?:version |v ?)?{n}"),
                Rule(f"{short}-{dotted}", EXACT, short, rf"(?:gnu )?{short} ?v? ?{n}(?: only)?"),
                Rule(f"{short}-{dotted}-or-later", EXACT, short, rf"(?:gnu )?{short} ?v? ?{n} or (?:any )?later(?: version)?"),
            ]
        out += [
            Rule(short, NAME, "licen", rf"(?:gnu )?{name}"),
            Rule(short, NAME, short, rf"(?:under|gnu) (?:the )?{short}(?: {licen})?"),
            Rule(short, HINT, short, short),
        ]
    return out


def _creative_commons() -> list[Rule]:
    """Creative Commons licenses: short names, addresses and full names, with and without versions."""
    full = {
        "by": "attribution",
        "by sa": "attribution share ?alike",
        "by nc": "attribution non ?commercial",
        "by nd": "attribution no ?deriv(?:ative)?s?(?: works?)?",
        "by nc sa": "attribution non ?commercial share ?alike",
        "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works?)?",
    }
    out = []
    for parts, words in full.items():
        label = "cc-" + parts.replace(" ", "-")
        for number in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            dotted = number.replace(" ", ".")
            out += [
                Rule(f"{label}-{dotted}", EXACT, "cc", rf"(?:creative commons )?cc {parts} (?:version |v ?)?{number}"),
                Rule(f"{label}-{dotted}", EXACT, "creativecommons", rf"creativecommons org licenses {parts} {number}"),
                Rule(f"{label}-{dotted}", EXACT, "attribution", rf"(?:creative commons )?{words} (?:licen[cs]e )?(?:version |v ?)?"
                     rf"{number}(?: (?:international|unported|generic))?(?: public)?(?: licen[cs]e)?"),
            ]
        out += [
            Rule(label, NAME, "cc", rf"cc {parts}"),
            Rule(label, NAME, "creative", rf"creative commons {words}(?: licen[cs]e)?"),
        ]
    return [
        *out,
        Rule("cc0-1.0", EXACT, "cc0", "cc0 (?:v ?)?1 0(?: universal)?"),
        Rule("cc0-1.0", EXACT, "creativecommons", "creativecommons org publicdomain zero 1 0"),
        Rule("cc0-1.0", NAME, "cc0", "cc0"),
        Rule("cc-pdm-1.0", EXACT, "creativecommons", "creativecommons org publicdomain mark 1 0"),
        Rule("cc-sampling", NAME, "creative", "creative commons sampling(?: plus)?(?: licen[cs]e)?"),
        Rule("cc", HINT, "creative", "creative commons(?: licen[cs]es?)?"),
    ]


def _named() -> list[Rule]:
    """Versioned licenses that differ by name, identifier and versions alone."""
    licen, out = "(?:public |software )?licen[cs]e", []
    named = [
        ("apache", "apache(?: software)?", "apache", ["1 0", "1 1", "2 0"]),
        ("mpl", "mozilla", "mozilla", ["1 0", "1 1", "2 0"]),
        ("epl", "eclipse", "eclipse", ["1 0", "2 0"]),
        ("cddl", "common development and distribution", "licen", ["1 0", "1 1"]),
        ("cpl", "common", "licen", ["1 0"]),
        ("artistic", "artistic", "artistic", ["1 0", "2 0"]),
        ("osl", "open software", "licen", ["1 0", "2 0", "2 1", "3 0"]),
        ("afl", "academic free", "licen", ["1 2", "2 0", "2 1", "3 0"]),
        ("eupl", "european union", "licen", ["1 0", "1 1", "1 2"]),
        ("ofl", "(?:sil )?open font", "licen", ["1 0", "1 1"]),
        ("lppl", "latex project", "licen", ["1 0", "1 1", "1 2", "1 3"]),
        ("bsl", "boost(?: software)?", "licen", ["1 0"]),
        ("qpl", "q", "licen", ["1 0"]),
        ("apsl", "apple public source", "licen", ["1 0", "1 1", "1 2", "2 0"]),
        ("cecill", "cecill", "cecill", ["1 0", "1 1", "2 0", "2 1"]),
        ("sspl", "server side", "licen", ["1 0"]),
        ("busl", "business source", "licen", ["1 0", "1 1"]),
        ("odbl", "open (?:data commons open )?database", "licen", ["1 0"]),
        ("php", "php", "licen", ["3 0", "3 01"]),
        ("zpl", "zope", "licen", ["1 1", "2 0", "2 1"]),
        ("ecl", "educational community", "licen", ["1 0", "2 0"]),
        ("spl", "sun", "licen", ["1 0"]),
        ("ipl", "ibm", "licen", ["1 0"]),
        ("npl", "netscape", "licen", ["1 0", "1 1"]),
        ("rpl", "reciprocal", "licen", ["1 1", "1 5"]),
        ("upl", "universal permissive", "licen", ["1 0"]),
        ("elastic", "elastic", "licen", ["1 0", "2 0"]),
    ]
    for short, words, keyword, numbers in named:
        for number in numbers:
            label, n = f"{short}-{number.replace(' ', '.')}", number.replace(" 0", "(?: 0)?")
            out += [
                Rule(label, EXACT, keyword, rf"{words} {licen} (?:version |v ?)?{n}"),
                Rule(label, EXACT, "licen", rf"(?:spdx )?licen[cs]e(?: identifier)? {short} {n}"),
            ]
        out.append(Rule(short, NAME, keyword, rf"{words} {licen}"))
    return out


def _texts_and_names() -> list[Rule]:
    """Licenses told by sentences of their texts or by names of their own."""
    rules = [
        ("mit", TEXT, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("mit", TEXT, "warranty", "the software is provided as is without warranty of any kind express or implied"
         "(?: including but not limited to the warranties of merchantability)?"),
        ("mit", NAME, "licen", "(?:the )?(?:mit|expat)(?: x11)? licen[cs]e"),
        ("mit", NAME, "licen", "(?:spdx )?licen[cs]e(?: identifier)? mit"),
        ("mit", NAME, "licen", "licen[cs]ed under (?:the )?mit"),
        ("mit-0", NAME, "attribution", "mit no attribution(?: licen[cs]e)?"),
        ("x11", NAME, "licen", "(?:the )?x11 licen[cs]e"),
        ("isc", TEXT, "permission", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"
         " is hereby granted"),
        ("isc", NAME, "licen", "(?:the )?isc licen[cs]e"),
        ("isc", NAME, "licen", "(?:spdx )?licen[cs]e(?: identifier)? isc"),
        ("bsd", TEXT, "redistribut", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd-3-clause", TEXT, "endorse", "neither the names? of .{1,80}? nor the names of (?:its|their|any) contributors may be used to"
         " endorse or promote products"),
        ("bsd-4-clause", TEXT, "advertising", "all advertising materials mentioning features or use of this software must display"),
        ("bsd-2-clause", EXACT, "bsd", "(?:simplified bsd|freebsd|2 clause bsd|bsd 2 clause)(?: licen[cs]e)?"),
        ("bsd-3-clause", EXACT, "bsd", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause)(?: licen[cs]e)?"),
        ("bsd-4-clause", EXACT, "bsd", "(?:original bsd|4 clause bsd|bsd 4 clause)(?: licen[cs]e)?"),
        ("0bsd", EXACT, "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?"),
        ("bsd", NAME, "bsd", "bsd(?: style)? licen[cs]e"),
        ("apache-2.0", TEXT, "licen", "you may not use this file except in compliance with the licen[cs]e"),
        ("apache-2.0", EXACT, "apache", "www apache org licenses license 2 0"),
        ("apache", HINT, "apache", "apache software foundation"),
        ("mpl-2.0", TEXT, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
        ("gpl", TEXT, "gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
        ("gpl", TEXT, "warranty", "this program is distributed in the hope that it will be useful but without any warranty"),
        ("gpl", HINT, "gnu", "www gnu org licenses"),
        ("unlicense", TEXT, "domain", "this is free and unencumbered software released into the public domain"),
        ("unlicense", NAME, "licen", "(?:the )?unlicense"),
        ("wtfpl", TEXT, "licen", "do what the fuck you want to public licen[cs]e"),
        ("wtfpl", NAME, "wtfpl", "wtfpl"),
        ("beerware", NAME, "licen", "beer ?ware licen[cs]e"),
        ("json", TEXT, "evil", "the software shall be used for good not evil"),
        ("zlib", TEXT, "warranty", "this software is provided as is without any express or implied warranty"),
        ("zlib", NAME, "licen", "zlib(?: libpng)? licen[cs]e"),
        ("libpng", NAME, "licen", "libpng licen[cs]e"),
        ("bsl-1.0", TEXT, "boost", "distributed under the boost software licen[cs]e version 1 0"),
        ("ncsa", NAME, "licen", "university of illinois(?: ncsa)? open source licen[cs]e"),
        ("psf", NAME, "licen", "(?:python software foundation|psf) licen[cs]e(?: version 2)?"),
        ("python", NAME, "licen", "python licen[cs]e"),
        ("ruby", NAME, "licen", "ruby licen[cs]e"),
        ("perl", TEXT, "perl", "under the same terms as perl itself"),
        ("vim", NAME, "licen", "vim licen[cs]e"),
        ("openssl", NAME, "openssl", "openssl licen[cs]e"),
        ("openssl", TEXT, "openssl", "this product includes software developed by the openssl project"),
        ("ssleay", NAME, "licen", "ssleay licen[cs]e"),
        ("curl", NAME, "licen", "curl licen[cs]e"),
        ("tcl", NAME, "licen", "tcl(?: tk)? licen[cs]e"),
        ("postgresql", NAME, "licen", "postgresql licen[cs]e"),
        ("ms-pl", NAME, "licen", "microsoft public licen[cs]e"),
        ("ms-rl", NAME, "licen", "microsoft reciprocal licen[cs]e"),
        ("w3c", NAME, "licen", "w3c software(?: notice and)? licen[cs]e"),
        ("unicode", NAME, "licen", "unicode (?:licen[cs]e|inc licen[cs]e agreement)"),
        ("icu", NAME, "licen", "icu licen[cs]e"),
        ("ftl", NAME, "licen", "freetype (?:project )?licen[cs]e"),
        ("ijg", TEXT, "jpeg", "this software is based in part on the work of the independent jpeg group"),
        ("sleepycat", NAME, "licen", "sleepycat licen[cs]e"),
        ("watcom", NAME, "licen", "sybase open watcom public licen[cs]e"),
        ("openldap", NAME, "licen", "openldap public licen[cs]e"),
        ("pddl-1.0", NAME, "licen", "public domain dedication and licen[cs]e"),
        ("odc-by-1.0", NAME, "licen", "open data commons attribution licen[cs]e"),
        ("commons-clause", NAME, "commons", "commons clause(?: licen[cs]e condition)?"),
        ("polyform", NAME, "licen", "polyform (?:noncommercial|perimeter|shield|strict|small business) licen[cs]e"),
        ("ogl", NAME, "licen", "open (?:gaming|government) licen[cs]e"),
        ("openrail", NAME, "rail", "(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?"),
        ("llama", NAME, "licen", "llama [23]?(?: [0-9])? ?community licen[cs]e"),
        ("public-domain", NAME, "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
        ("public-domain", HINT, "domain", "public domain"),
        ("proprietary", TEXT, "confidential", "confidential and proprietary"),
        ("proprietary", TEXT, "proprietary", "proprietary and confidential"),
        ("proprietary", TEXT, "without", "may not be (?:copied|reproduced|redistributed|distributed)(?: [^ ]+){0,6} without"
         " (?:the )?(?:prior |express |written ){0,3}(?:permission|consent)"),
        ("proprietary", NAME, "licen", "commercial licen[cs]e"),
        ("proprietary", NAME, "licen", "end user licen[cs]e agreement"),
        ("proprietary", HINT, "unauthorized", "unauthorized (?:copying|use|reproduction|distribution)"),
        ("copyright", HINT, "copyright", "copyright(?: c)?(?: (?:19|20)[0-9]{2}){1,20}"),
        ("license-file", HINT, "licen", "see (?:the )?licen[cs]e(?: txt| md)? (?:file )?for (?:more )?(?:details|information)"),
        ("license", HINT, "licen", "(?:licen[cs]ed|released|distributed) under(?: the terms of)?(?: the| a| an)?"
         " (?:[^ ]+ ){1,4}?licen[cs]e"),
    ]
    return [Rule(*rule) for rule in rules]


def rules() -> list[Rule]:
    """All rules in their order: base phrases first."""
    base = [Rule(label, NAME, {"cc-by": "cc"}.get(label, phrase.split()[-1]), phrase, True) for phrase, label in BASE]
    return [*base, *_gnu(), *_creative_commons(), *_named(), *_texts_and_names()]


def bounded(pattern: str) -> str:
    """The pattern between whole words of the reduced text."""
    return rf"(?<= )(?:{pattern})(?= )"


def _lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _places(words: Column, given: list[Rule]) -> Column:
    """Places of all rules whose keyword the reduced text holds."""
    keywords = F.array(*[F.lit(x) for x in sorted({r.keyword for r in given})])
    listed = F.array(*[
        F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(bounded(r.pattern)).alias("pattern"))
        for i, r in enumerate(given)
    ])

    def marked(text: Column, rule: Column) -> Column:
        """The text's words, the first of every match after one marker and the last before another."""
        return F.split(F.regexp_replace(text, rule["pattern"], F.lit("\u0001$0\u0002")), " ")

    def numbered(parts: Column, mark) -> Column:
        return F.filter(F.transform(parts, lambda x, i: F.when(mark(x), i)), lambda i: i.isNotNull())

    def spans(rule: Column, parts: Column) -> Column:
        starts = numbered(parts, lambda x: x.startswith("\u0001"))
        ends = numbered(parts, lambda x: x.endswith("\u0002"))
        # Before the first word stands an empty part, so the last word's number is the end.
        return F.zip_with(starts, ends, lambda a, b: F.struct(rule["rule"].alias("rule"), (a - 1).alias("start"), b.alias("end")))

    def found(x: Column) -> Column:
        tried = F.filter(listed, lambda r: F.array_contains(x["held"], r["keyword"]) & F.rlike(x["words"], r["pattern"]))
        # Each step binds its value once, in a list of one element.
        each = F.transform(tried, lambda r: F.element_at(F.transform(F.array(marked(x["words"], r)), lambda p: spans(r, p)), 1))
        return F.flatten(each)

    def gated(text: Column) -> Column:
        return F.struct(text.alias("words"), F.filter(keywords, lambda k: F.contains(text, k)).alias("held"))

    once = F.transform(F.transform(F.array(words), gated), found)
    return F.element_at(once, 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: list[Rule] | None = None) -> DataFrame:
    """``row`` (unique), ``doc_id``, ``n_words``, ``places`` of every row; written once.

    Texts without any keyword are only counted. The gate lower-cases more than A-Z, which lets a few
    more texts through; the rules see the exact form.
    """
    given = rules() if given is None else given
    body = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("low", F.lower("text"))
    gate = F.lit(False)
    for keyword in sorted({r.keyword for r in given}):
        gate = gate | F.contains(F.col("low"), F.lit(keyword))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(_lower(F.col("text")), BETWEEN, " ")), F.lit(" "))
    kind = "array<struct<rule:int,start:int,end:int>>"
    rows = body.select(
        "doc_id",
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"),
        F.when(gate, _places(words, given).cast(kind)).otherwise(F.array().cast(kind)).alias("places"),
    ).withColumn("row", F.monotonically_increasing_id())
    return written(rows, "license-scan")


def detections(scanned: DataFrame, given: list[Rule] | None = None) -> DataFrame:
    """Places left after suppression, and all base places: ``row``, ``doc_id``, ``start``, ``end`` (in
    words), ``label``, ``priority``, ``base``, ``kept``.

    In order of start, longest first, a place lies inside an earlier one of its own or a higher
    priority when the greatest end so far reaches its own.
    """
    given = rules() if given is None else given
    places = scanned.filter(F.size("places") > 0).select("row", "doc_id", F.inline("places"))

    def of_rule(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule") + 1)

    places = places.select(
        "row", "doc_id", "rule", "start", "end", of_rule([r.label for r in given]).alias("label"),
        of_rule([r.priority for r in given]).alias("priority"), of_rule([r.base for r in given]).alias("base"),
    )
    before = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "priority", "rule").rowsBetween(
        Window.unboundedPreceding, -1
    )
    covered = F.lit(False)
    for level in sorted({r.priority for r in given}):
        reach = F.max(F.when(F.col("priority") <= level, F.col("end"))).over(before)
        covered = covered | ((F.col("priority") == level) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    return places.withColumn("kept", ~covered).filter(F.col("kept") | F.col("base")).drop("rule")


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of words, base places and labels, all labels, score.

    The score is the confidence of the best place that stays, 0 without one.
    """
    scanned = scan(docs, id_col, text_col)
    places = detections(scanned)
    confidence = F.element_at(F.array(*[F.lit(CONFIDENCE[p]) for p in sorted(CONFIDENCE)]), F.col("priority"))
    base = F.col("base")

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(labels)), ",")

    by_row = places.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max(confidence).alias("score"),
    )
    return scanned.join(by_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))
