"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftlens.llm.common import let, lower_ascii, match_spans, running_sums, table, whole
from driftlens.session import cut_lineage

# Separators after lower-casing, the base phrases and their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Rules are patterns over words in lower case with one space between them. N stands for a version number.
V = r"(?:version |v |v|ver )?"
# (label, keyword, pattern of the name, versions). A version "2 1" is written 2.1 in texts.
VERSIONED = [
    ("gpl", "gpl", r"(?:gnu )?gpl", ["1", "2", "3"]),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e", ["1", "2", "3"]),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ["2", "2 1", "3"]),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", ["2 1", "3"]),
    ("lgpl", "library", r"(?:gnu )?library general public licen[cs]e", ["2"]),
    ("agpl", "agpl", r"(?:gnu )?agpl", ["1", "3"]),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ["1", "3"]),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", ["1 1", "1 2", "1 3"]),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", ["1 1", "1 2", "1 3"]),
    ("apache", "apache", r"apache(?: software)?(?: licen[cs]e)?", ["1", "1 1", "2"]),
    ("asl", "asl", r"asl", ["1 1", "2"]),
    ("mpl", "mpl", r"mpl", ["1", "1 1", "2"]),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ["1", "1 1", "2"]),
    ("epl", "epl", r"epl", ["1", "2"]),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ["1", "2"]),
    ("eupl", "eupl", r"eupl", ["1", "1 1", "1 2"]),
    ("eupl", "european", r"european union public licen[cs]e", ["1", "1 1", "1 2"]),
    ("cddl", "cddl", r"cddl", ["1", "1 1"]),
    ("cddl", "distribution", r"common development and distribution licen[cs]e", ["1", "1 1"]),
    ("cpl", "cpl", r"cpl", ["1"]),
    ("cpl", "common", r"common public licen[cs]e", ["1"]),
    ("ofl", "ofl", r"(?:sil )?ofl", ["1", "1 1"]),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e", ["1", "1 1"]),
    ("osl", "osl", r"osl", ["1", "1 1", "2", "2 1", "3"]),
    ("osl", "open", r"open software licen[cs]e", ["1", "1 1", "2", "2 1", "3"]),
    ("afl", "academic", r"academic free licen[cs]e", ["1 1", "1 2", "2", "2 1", "3"]),
    ("bsl", "boost", r"boost software licen[cs]e", ["1"]),
    ("busl", "business", r"business source licen[cs]e", ["1", "1 1"]),
    ("artistic", "artistic", r"artistic licen[cs]e", ["1", "2"]),
    ("python", "python", r"python (?:software foundation )?licen[cs]e", ["2", "3"]),
    ("php", "php", r"php licen[cs]e", ["2", "3", "3 1"]),
    ("zpl", "zope", r"zope public licen[cs]e", ["1", "2", "2 1"]),
    ("lppl", "lppl", r"lppl", ["1", "1 1", "1 2", "1 3"]),
    ("sspl", "side", r"server side public licen[cs]e", ["1"]),
    ("wtfpl", "wtfpl", r"wtfpl", ["1", "2"]),
    ("unicode", "unicode", r"unicode licen[cs]e", ["3"]),
    ("cecill", "cecill", r"cecill", ["1", "2", "2 1"]),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)", ["1", "2"]),
    ("odbl", "odbl", r"odbl", ["1"]),
    ("odbl", "database", r"open database licen[cs]e", ["1"]),
    ("etalab", "etalab", r"licence ouverte etalab", ["1", "2"]),
]
# Creative Commons: the conditions, as letters and in words.
CREATIVE = [
    ("by-nc-nd", r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc-sa", r"by nc sa", r"attribution non ?commercial share ?alike"),
    ("by-nc", r"by nc", r"attribution non ?commercial"),
    ("by-nd", r"by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-sa", r"by sa", r"attribution share ?alike"),
    ("by", r"by", r"attribution"),
]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# (label, keyword, pattern) for names without a version.
PLAIN = [
    ("mit", "mit", r"mit licen[cs]ed?"),
    ("mit", "mit", r"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?mit"),
    ("mit", "mit", r"(?:x11 mit|mit x11|expat mit|mit expat)(?: licen[cs]e)?"),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "freebsd", r"freebsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd licen[cs]e"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("public-domain", "domain", r"this (?:work|text|file) is in the public domain"),
    ("public-domain", "dedication", r"public domain dedication"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("boost", "boost", r"boost software licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("beerware", "beer", r"beer ware licen[cs]e"),
    ("beerware", "beerware", r"beerware licen[cs]e"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[cs]e|software)"),
    ("proprietary", "confidential", r"confidential and proprietary"),
    ("proprietary", "granted", r"no licen[cs]e is granted"),
]
# What announces a license in a text; such words raise the confidence in the name that follows.
LEADS = r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed) under (?:the )?(?:terms of (?:the )?)?"
# A text without any of these, in either case, matches no rule and no base phrase. Parts of one word only, so that any
# separators may stand between the words of a rule; the short ones have to be words.
HINT = (
    r"(?i)licen[cs]|reserved|domain|proprietary|unencumbered|redistributions|confidential|attribution|freebsd"
    rf"|(?<!{RAW_WORD[:-1]})(?:[al]?gpl|gfdl|apache|asl|mpl|epl|eupl|cddl|cpl|ofl|osl|lppl|wtfpl|cecill|mulan|odbl|etalab"
    rf"|(?:{'|'.join(sorted({r[0] for r in VERSIONED if r[0] == r[1]}))})v[0-9]+|cc0?|x11|expat|bsd|evil|hereby)(?!{RAW_WORD[:-1]})"
)
SCORES = {1: 1.0, 2: 0.9, 3: 0.6}


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, priority), most specific first; built from the tables above.

    Priority 1: announced and with a version; 2: with a version; 3: the bare name or a sentence.
    """
    made = []
    for label, keyword, name, versions in VERSIONED:
        for version in versions:
            tail = f"{label}-{version.replace(' ', '.')}"
            number = rf"{V}{version}(?: 0)?(?! [0-9]\b)(?: only| or later| or newer)?"
            made.append((tail, keyword, f"{LEADS}{name} {number}", 1))
            made.append((tail, keyword, f"{name} {number}", 2))
            if " " not in keyword and keyword == label:
                made.append((tail, f"{keyword}v{version.split()[0]}", rf"{keyword}v{version}(?: 0)?(?! [0-9]\b)", 2))
        made.append((label, keyword, rf"{name}(?: licen[cs]e)?", 3))
    for conditions, letters, words in CREATIVE:
        for version in CC_VERSIONS:
            tail = f"cc-{conditions}-{version.replace(' ', '.')}"
            made.append((tail, "cc", f"cc {letters} {version}", 1))
            made.append((tail, "creative", f"creative commons {words}(?: international| unported| generic)? (?:licen[cs]e )?{V}{version}", 1))
        made.append((f"cc-{conditions}", "cc", f"cc {letters}", 2 if conditions != "by" else 3))
        made.append((f"cc-{conditions}", "creative", f"creative commons {words}(?: licen[cs]e)?", 3))
    for label, keyword, pattern in PLAIN:
        made.append((label, keyword, f"{LEADS}{pattern}", 2))
        made.append((label, keyword, pattern, 3))
    return [(label, keyword, f"(?<= )(?:{pattern})(?= )", priority) for label, keyword, pattern, priority in made]


def phrase_words(norm: Column, phrase: str) -> Column:
    """The numbers of the words that a phrase starts at, wherever it stands in the normalised text."""
    pieces = F.split(norm, f"(?<= ){phrase}(?= )", -1)
    # Every word ends before a space; a phrase holds fewer spaces than words.
    spaces = lambda parts: F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.regexp_count(p, F.lit(" ")).cast("bigint"))
    return F.transform(let(let(pieces, spaces), running_sums), lambda n, i: n + i * phrase.count(" ") - 1)


def fired(facts: DataFrame) -> DataFrame:
    """(row, label, priority, s, e): the matches of all rules in normalised texts, columns ``row`` and ``norm``.

    Words meet the rules on equal keywords, so a rule's pattern runs only where its keyword stands; every match of a pattern
    holds its keyword as a word.
    """
    made = rules()
    signatures = facts.sparkSession.createDataFrame(
        [(label, key, pattern, priority) for label, key, pattern, priority in made], "label string, keyword string, pattern string, priority int"
    )
    keywords = F.array(*[F.lit(k) for k in sorted({r[1] for r in made})])
    gated = facts.where("norm IS NOT NULL").select(
        "row", "norm", F.explode(F.array_intersect(F.split("norm", " "), keywords)).alias("keyword")
    ).join(F.broadcast(signatures), "keyword")
    spans = gated.where(F.expr("norm RLIKE pattern")).select("row", "label", "priority", F.explode(match_spans(F.col("norm"), F.col("pattern"))).alias("x"))
    return spans.select("row", "label", "priority", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def detections(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(facts, found): a row per document, and a row per detection that stands, with label, place and priority.

    Texts are lower-cased (A-Z only) and cut into words. Only texts with a hint are normalised. A detection
    inside another of the same or higher priority is suppressed; of equal places the higher priority, then the first
    label stays. Base phrases are never suppressed.
    """
    body = whole(F.col(text))
    norm = F.when(body.rlike(HINT), F.regexp_replace(F.concat(F.lit(" "), lower_ascii(body), F.lit(" ")), SEPARATORS, " "))
    facts = cut_lineage(docs.select(
        F.col(ident).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.regexp_count(body, F.lit(RAW_WORD)).cast("bigint").alias("n_words"), norm.alias("norm"),
    ))
    spans = fired(facts)
    ordered = Window.partitionBy("row").orderBy("s", F.desc("e"), "priority", "label")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.coalesce(F.max(F.when(F.col("priority") <= p, F.col("e"))).over(earlier), F.lit(-1)) for p in sorted(SCORES)]
    seen = F.element_at(F.array(*reach), F.col("priority"))
    return facts, spans.withColumn("inside", seen >= F.col("e")).where("NOT inside").drop("inside")


def license_scan(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: id, words, base phrases and their places, labels and a score.

    Null and empty texts have no words and no labels. Repeated rows are scanned row by row, an empty table gives no rows,
    and only the two named columns are read. Labels are the base labels and those of the detections that stand; the
    score is the confidence of the best of them: announced with a version 1, with a version or a base phrase 0.9, else 0.6.
    """
    facts, found = detections(docs, text, ident)
    norm = F.col("norm")
    starts, labels = [], []
    for phrase, label in BASE.items():
        places = F.when(F.contains(norm, F.lit(f" {phrase} ")), phrase_words(norm, phrase))
        starts.append(F.coalesce(places, F.array().cast("array<bigint>")))
        labels.append(F.when(F.contains(norm, F.lit(f" {phrase} ")), F.lit(label)))
    hits = found.groupBy("row").agg(
        F.collect_set("label").alias("found"),
        F.max(F.element_at(F.array(*[F.lit(SCORES[p]) for p in sorted(SCORES)]), F.col("priority"))).alias("best"),
    )
    rows = facts.withColumns({"starts": F.concat(*starts), "base": F.array_compact(F.array(*labels))}).drop("norm").join(hits, "row", "left")
    all_labels = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.9)).otherwise(0.0))
    return rows.select(
        F.col("id").alias(ident), "n_words", F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        joined("base").alias("base_labels"), joined(all_labels).alias("labels"), score.alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
