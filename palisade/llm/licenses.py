"""License scans: ordered signature rules over the words of a text.

A text is reduced to its lower-case words. A rule has a keyword, a pattern over words, a label, a priority and a confidence.
Only rules whose gate, a literal that every match of them holds, is in the text are tried. Of overlapping detections, one that lies within another of the same or a
higher priority is dropped; equal ones fall to the earlier rule. Only built-in functions run, row by row, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import text_or_empty
from palisade.llm.native import let, matches

GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the contract and their labels: fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, keyword, what the license is called (over words), the words of its SPDX identifier. Written by hand.
LICENSES = (
    ("mit", "mit", r"mit(?: x11)?", "mit"),
    ("mit-0", "mit", r"mit(?: no attribution| 0)", "mit 0"),
    ("apache-1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1(?: [01])?", "apache 1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache 2 0"),
    ("gpl", "gnu", r"gnu general public license", "gpl"),
    ("gpl-2", "gnu", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?", "gpl 2 0 only"),
    ("gpl-3", "gnu", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?", "gpl 3 0 only"),
    ("gpl-2", "gpl", r"gpl ?v?2(?: 0)?", "gpl 2 0 or later"),
    ("gpl-3", "gpl", r"gpl ?v?3(?: 0)?", "gpl 3 0 or later"),
    ("gpl", "gplv2", r"gplv2(?: or later)?", "gplv2"),
    ("gpl", "gplv3", r"gplv3(?: or later)?", "gplv3"),
    ("lgpl", "lesser", r"gnu lesser general public license", "lgpl"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license(?: version| v)? ?2 1", "lgpl 2 1 only"),
    ("lgpl-3", "lesser", r"gnu lesser general public license(?: version| v)? ?3(?: 0)?", "lgpl 3 0 only"),
    ("lgpl", "library", r"gnu library general public license", "lgpl 2 0 only"),
    ("lgpl", "lgpl", r"lgpl(?: ?v?[23](?: [01])?)?", "lgpl 3 0 or later"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public license(?:(?: version| v)? ?3(?: 0)?)?", "agpl 3 0 only"),
    ("agpl-3", "agpl", r"agpl(?: ?v?3(?: 0)?)?", "agpl 3 0 or later"),
    ("gfdl", "documentation", r"gnu free documentation license(?: version 1 [123])?", "gfdl 1 3 only"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)?", "bsd"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)", "0bsd"),
    ("isc", "isc", r"isc", "isc"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version| v)? ?2(?: 0)?", "mpl 2 0"),
    ("mpl", "mpl", r"mpl ?2(?: 0)?", "mpl 2 0 no copyleft exception"),
    ("epl-1", "eclipse", r"eclipse public license(?: version| v)? ?1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", r"eclipse public license(?: version| v)? ?2(?: 0)?", "epl 2 0"),
    ("edl-1", "eclipse", r"eclipse distribution license(?: version| v)? ?1(?: 0)?", "edl 1 0"),
    ("cddl-1", "cddl", r"cddl(?: version)?(?: 1 [01])?", "cddl 1 0"),
    ("cddl-1", "distribution", r"common development and distribution license(?: version 1 [01])?", "cddl 1 1"),
    ("cpl-1", "common", r"common public license(?: version)?(?: 1 0)?", "cpl 1 0"),
    ("eupl", "european", r"european union public licen[cs]e(?: v?(?: ?1 [12])?)?", "eupl 1 2"),
    ("artistic-1", "artistic", r"artistic license(?: version)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", r"artistic license(?: version)? 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", r"artistic license", "artistic"),
    ("perl", "perl", r"same terms as perl itself", "artistic 1 0 perl"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", r"libpng", "libpng 2 0"),
    ("boost-1", "boost", r"boost software license(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("bsl-1.1", "business", r"business source license(?: version)?(?: 1 1)?", "busl 1 1"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("beerware", "beerware", r"beerware", "beerware"),
    ("postgresql", "postgresql", r"postgresql", "postgresql"),
    ("python-2", "python", r"python software foundation(?: license)?(?: version 2)?", "python 2 0"),
    ("php-3", "php", r"php(?: license)?(?: version)? 3(?: 0[01])?", "php 3 01"),
    ("ruby", "ruby", r"ruby", "ruby"),
    ("ofl-1.1", "sil", r"sil open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("ms-pl", "microsoft", r"microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms rl"),
    ("osl-3", "open", r"open software license(?: version)?(?: 3 0)?", "osl 3 0"),
    ("afl-3", "academic", r"academic free license(?: version)?(?: 3 0)?", "afl 3 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("w3c", "w3c", r"w3c software(?: notice and)?", "w3c"),
    ("openssl", "openssl", r"openssl", "openssl"),
    ("mulan-psl-2", "mulan", r"mulan(?: permissive software)? ?(?:psl)?(?: license)?(?: ?v?2)?", "mulanpsl 2 0"),
    ("sspl-1", "server", r"server side public license(?: v?1)?", "sspl 1 0"),
    ("elastic-2", "elastic", r"elastic license(?: ?v?2(?: 0)?)?", "elastic 2 0"),
    ("odbl-1", "database", r"open (?:data commons open )?database license(?: v?1 0)?", "odbl 1 0"),
    ("odc-by", "attribution", r"open data commons attribution license(?: v?1 0)?", "odc by 1 0"),
    ("pddl", "pddl", r"pddl(?: v?1 0)?", "pddl 1 0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc0", "creative", r"creative commons (?:zero|public domain dedication)", "cc0"),
    ("cc-by", "cc", r"cc by(?: [1234] [05])?", "cc by 4 0"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?", "cc by sa 4 0"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?", "cc by nd 4 0"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?", "cc by nc 4 0"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?", "cc by nc nd 4 0"),
    ("cc-by", "creative", r"creative commons attribution(?: [1234] [05])?(?: international| unported)?", "cc by 3 0"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1234] [05])?", "cc by sa 3 0"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?", "cc by nd 3 0"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1234] [05])?", "cc by nc 3 0"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?", "cc by nc sa 3 0"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?", "cc by nc nd 3 0"),
)

#: Sentences that name a license without its name: label, keyword, pattern, priority, confidence.
SENTENCES = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 4, 1.0),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 4, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 4, 0.95),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 4, 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 4, 1.0),
    ("public-domain", "domain", r"(?:dedicated to|released into|placed in|in) the public domain", 2, 0.8),
    ("proprietary", "rights", r"all rights reserved", 1, 0.6),
    ("proprietary", "confidential", r"proprietary and confidential", 2, 0.8),
    ("gpl-3-later", "later", r"either version 3 of the license or at your option any later version", 3, 0.95),
    ("gpl-2-later", "later", r"either version 2 of the license or at your option any later version", 3, 0.95),
)

#: Ways of naming a license, {0} its name and {1} its identifier: priority, confidence. Each license gives one rule a way.
WAYS = (
    (r"spdx license identifier {1}", 4, 1.0),
    (r"(?:licensed|released|distributed|available|published|provided)(?: to you)? under (?:the )?(?:terms of )?(?:the )?{0}(?: license| licence)?", 3, 0.95),
    (r"{0} licen[cs]e(?! agreement server)", 2, 0.85),
    (r"licen[cs]e (?:is )?(?:the )?{0}", 2, 0.8),
)
#: A bare name counts as a mention only if it has two words or more.
MENTION = (1, 0.5)


def spellings(pattern: str) -> list[str]:
    """All texts that a pattern of the rules matches; it has letters, sets of letters, groups, alternatives and ? only."""

    def one_of(at: int) -> tuple[list[str], int]:
        found, now = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                found, now, at = found + now, [""], at + 1
                continue
            if pattern.startswith(("(?!", "(?=", "(?<="), at):  # looks around add no text
                at = pattern.index(")", at) + 1
                continue
            if pattern[at] == "(":
                part, at = one_of(at + (3 if pattern.startswith("(?:", at) else 1))
                at += 1
            elif pattern[at] == "[":
                part, at = list(pattern[at + 1 : pattern.index("]", at)]), pattern.index("]", at) + 1
            else:
                part, at = [pattern[at]], at + 1
            if pattern.startswith("?", at):
                part, at = [*part, ""], at + 1
            now = [a + b for a in now for b in part]
        return found + now, at

    return list(dict.fromkeys(one_of(0)[0]))


def gate(keyword: str, pattern: str) -> str:
    """The keyword as a word, the start of one, or any letters: the narrowest that stands in all that the pattern matches."""
    texts = [f" {x} " for x in spellings(pattern)]
    for literal in (f" {keyword} ", f" {keyword}", keyword):
        if all(literal in x for x in texts):
            return literal
    raise ValueError(f"{keyword} isn't in all of {pattern}")


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, gate, pattern, priority, confidence), in order: of equal detections the first rule's stays."""
    out = [(label, gate(keyword, p), rf"(?<= ){p}(?= )", priority, sure) for label, keyword, p, priority, sure in SENTENCES]
    own = [(label, gate(keyword, name), name, spdx) for label, keyword, name, spdx in LICENSES]
    # A name stands between spaces in each way.
    out += [(label, " license " if "{0}" not in way else literal, rf"(?<= ){way.format(name, spdx)}(?= )", priority, sure) for label, literal, name, spdx in own for way, priority, sure in WAYS]
    out += [(label, literal, rf"(?<= ){name}(?= )", *MENTION) for label, literal, name, _ in own if " " in name.replace("(?: ", "")]
    return out


def word_line(text: Column) -> Column:
    """The words between single spaces, with a space at either end; no words give one space."""
    words = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAPS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, " ", ""))).cast("long")


def base_places(line: Column) -> Column:
    """Per phrase of BASE: its number of places, first and last start in words."""

    def places(phrase: str, label: str) -> Column:
        def of(pieces: Column) -> Column:
            n = (F.size(pieces) - 1).cast("long")
            first = F.when(n > 0, spaces(F.get(pieces, F.lit(0))) - 1)
            last = F.when(n > 0, spaces(line) - spaces(F.element_at(pieces, -1)) - len(phrase.split(" ")))
            return F.struct(F.lit(label).alias("label"), n.alias("n"), first.alias("first"), last.alias("last"))

        none = F.struct(F.lit(label).alias("label"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
        return F.when(F.contains(line, F.lit(f" {phrase} ")), let(F.split(line, rf"(?<= ){phrase}(?= )", -1), of)).otherwise(none)

    return F.array(*[places(*x) for x in BASE.items()])


DETECTION = "struct<start:int,back:int,rank:int,rule:int,end:int,label:string,sure:double>"


def detections(line: Column, own: list[tuple[str, str, str, int, float]]) -> Column:
    """All rules' detections, sorted by start, longest first, higher priority first, earlier rule first."""
    by_gate: dict[str, list[Column]] = {}
    for k, (label, literal, pattern, priority, sure) in enumerate(own):
        by_gate.setdefault(literal, []).append(F.struct(F.lit(label).alias("label"), F.lit(pattern).alias("pattern"), F.lit(priority).alias("priority"), F.lit(sure).alias("sure"), F.lit(k).alias("k")))
    gated = [F.when(F.contains(line, F.lit(literal)), F.array(*r)).otherwise(F.array().cast("array<struct<label:string,pattern:string,priority:int,sure:double,k:int>>")) for literal, r in by_gate.items()]

    def apply(r: Column) -> Column:
        fields = lambda m, s, e: F.struct(s.cast("int").alias("start"), (-e).cast("int").alias("back"), (-r["priority"]).alias("rank"), r["k"].alias("rule"), e.cast("int").alias("end"), r["label"].alias("label"), r["sure"].alias("sure"))
        return F.when(F.regexp_like(line, r["pattern"]), matches(line, r["pattern"], fields)).otherwise(F.array().cast(f"array<{DETECTION}>"))

    return F.array_sort(F.flatten(F.transform(F.flatten(F.array(*gated)), apply)))


def surviving(found: Column) -> Column:
    """(labels, n, sure) of the detections that no other contains: one fold over the sorted detections, of bounded state."""
    ranks = (1, 2, 3, 4)
    start = F.struct(*[F.lit(-1).alias(f"e{r}") for r in ranks], F.array().cast("array<string>").alias("labels"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sure"))

    def step(a: Column, d: Column) -> Column:
        # The furthest end so far of any detection with this priority or more.
        reach = reduce(F.greatest, [F.when(-d["rank"] <= r, a[f"e{r}"]).otherwise(F.lit(-1)) for r in ranks])
        inside = reach >= d["end"]
        ends = [F.when(-d["rank"] == r, F.greatest(a[f"e{r}"], d["end"])).otherwise(a[f"e{r}"]).alias(f"e{r}") for r in ranks]
        return F.struct(*ends, F.when(inside, a["labels"]).otherwise(F.array_union(a["labels"], F.array(d["label"]))).alias("labels"), F.when(inside, a["n"]).otherwise(a["n"] + 1).alias("n"), F.when(inside, a["sure"]).otherwise(F.greatest(a["sure"], d["sure"])).alias("sure"))

    return F.aggregate(found, start, step)


#: Each text that a rule or phrase matches holds one of these: a cheap first gate. A test holds it against all spellings.
GATE = ("licen", "released under ", "distributed under ", "available under ", "published under ", "provided under ", " to you under ", "cc by", "cc0", "public domain", "gpl", "creative commons", "mozilla public", "eclipse", "apache", "bsd", "redistribution", "permission", "unencumbered", "altered source", "rights reserved", "proprietary and", "same terms as perl", "mulan", "python software", "php", "later version", "ncsa", "cddl", "w3c software", "mpl", "pddl", "mit x11", "mit no", "mit 0", "libpng")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections: a row for each of docs.

    n_base counts all places of the base phrases, first_word and last_word are their smallest and largest start in words
    (null where there is none). labels adds those of surviving detections. score is the surest detection's confidence, 0
    where there is none; a base phrase counts as 1. Null and empty texts have no words. Repeated rows each give a row; very
    long texts are read whole; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), word_line(text_or_empty(text_col)).alias("line"))
    line = F.col("line")
    touched = reduce(lambda a, b: a | b, [F.contains(line, F.lit(g)) for g in GATE])
    empty = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sure"))

    def result(s: Column) -> Column:
        found = let(surviving(detections(s["line"], rules())), lambda x: F.struct(x["labels"].alias("labels"), x["n"].alias("n"), x["sure"].alias("sure")))
        return F.struct(base_places(s["line"]).alias("base"), found.alias("found"))

    none = F.struct(F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>").alias("base"), empty.alias("found"))
    both = F.when(touched, let(F.struct(line.alias("line")), result)).otherwise(none)
    rows = rows.select("doc_id", F.greatest(spaces(line) - 1, F.lit(0).cast("long")).alias("n_words"), both.alias("r"))
    base = F.filter("r.base", lambda b: b["n"] > 0)
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("r.found.labels"))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.col("r.found.sure")).alias("score"),
        F.col("r.found.n").alias("n_detections"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
