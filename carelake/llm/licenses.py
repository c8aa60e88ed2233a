"""License mentions by ordered signature rules, in DataFrame functions alone.

Each rule is a regular expression over the lowered words of a text, with the
words it cannot match without, a priority and a confidence. A rule is tried
only on texts that hold all its words. Of detections that lie inside one
another the higher priority stays, and at equal priority the longer one.
"""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import lower_ascii
from carelake.operators.layout import with_once
from carelake.session import staged

#: What lies between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# One line per license: label | words a text must hold | name as written | short tag | address of its text.
_LICENSES = """
agpl-3|affero|(gnu )?affero general public licen[sc]e|agpl 3 0|www gnu org licenses agpl
gpl-2|general public|(gnu )?general public licen[sc]e( version| v)? 2|gpl 2 0|www gnu org licenses gpl 2 0
gpl-3|general public|(gnu )?general public licen[sc]e( version| v)? 3|gpl 3 0|www gnu org licenses gpl 3 0
lgpl-2|lesser public|(gnu )?lesser general public licen[sc]e( version| v)? 2|lgpl 2 1|www gnu org licenses lgpl 2 1
lgpl-3|lesser public|(gnu )?lesser general public licen[sc]e( version| v)? 3|lgpl 3 0|www gnu org licenses lgpl 3 0
gfdl|gnu documentation|gnu free documentation licen[sc]e|gfdl 1 3|www gnu org licenses fdl
apache-1|apache|apache (software )?licen[sc]e( version| v)? 1( 1)?|apache 1 1|www apache org licenses license 1 1
apache-2|apache|apache licen[sc]e( version| v)? 2( 0)?|apache 2 0|www apache org licenses license 2 0
mit|mit|mit licen[sc]e|mit|opensource org licenses mit
x11|x11|(mit )?x11 licen[sc]e|x11|www xfree86 org legal licenses
isc|isc|isc licen[sc]e|isc|opensource org licenses isc
bsd-2|bsd|(bsd 2 clause|2 clause bsd|simplified bsd) licen[sc]e|bsd 2 clause|opensource org licenses bsd 2 clause
bsd-3|bsd|(bsd 3 clause|3 clause bsd|new bsd|modified bsd) licen[sc]e|bsd 3 clause|opensource org licenses bsd 3 clause
bsd-4|bsd|(bsd 4 clause|4 clause bsd|original bsd) licen[sc]e|bsd 4 clause|spdx org licenses bsd 4 clause
0bsd|bsd|(zero clause bsd|bsd zero clause) licen[sc]e|0bsd|opensource org licenses 0bsd
mpl-1|mozilla|mozilla public licen[sc]e( version| v)? 1( 1)?|mpl 1 1|www mozilla org mpl 1 1
mpl-2|mozilla|mozilla public licen[sc]e( version| v)? 2( 0)?|mpl 2 0|mozilla org mpl 2 0
epl-1|eclipse|eclipse public licen[sc]e( version| v)? 1( 0)?|epl 1 0|www eclipse org legal epl v10
epl-2|eclipse|eclipse public licen[sc]e( version| v)? 2( 0)?|epl 2 0|www eclipse org legal epl 2 0
edl|eclipse|eclipse distribution licen[sc]e( version| v)? 1( 0)?|edl 1 0|www eclipse org org documents edl
cddl|common development|common development and distribution licen[sc]e|cddl 1 0|opensource org licenses cddl
cpl|common public|common public licen[sc]e|cpl 1 0|opensource org licenses cpl1
eupl|european union|european union public licen[sc]e|eupl 1 2|joinup ec europa eu
artistic|artistic|artistic licen[sc]e|artistic 2 0|opensource org licenses artistic
zlib|zlib|zlib( libpng)? licen[sc]e|zlib|opensource org licenses zlib
boost|boost|boost software licen[sc]e|bsl 1 0|www boost org license 1 0
unlicense|unlicense|the unlicense|unlicense|unlicense org
wtfpl|fuck|do what the fuck you want to public licen[sc]e|wtfpl|www wtfpl net
cc0|cc0|cc0( 1 0)?( universal)?|cc0 1 0|creativecommons org publicdomain zero
cc-by|cc by|cc by( [1-4] [0-9])?|cc by 4 0|creativecommons org licenses by
cc-by-sa|cc by sa|cc by sa( [1-4] [0-9])?|cc by sa 4 0|creativecommons org licenses by sa
cc-by-nc|cc by nc|cc by nc( [1-4] [0-9])?|cc by nc 4 0|creativecommons org licenses by nc
cc-by-nd|cc by nd|cc by nd( [1-4] [0-9])?|cc by nd 4 0|creativecommons org licenses by nd
cc-by-nc-sa|cc by nc sa|cc by nc sa( [1-4] [0-9])?|cc by nc sa 4 0|creativecommons org licenses by nc sa
cc-by-nc-nd|cc by nc nd|cc by nc nd( [1-4] [0-9])?|cc by nc nd 4 0|creativecommons org licenses by nc nd
ofl|sil|sil open font licen[sc]e|ofl 1 1|scripts sil org ofl
odbl|open database|open database licen[sc]e|odbl 1 0|opendatacommons org licenses odbl
odc-by|open data|open data commons attribution licen[sc]e|odc by 1 0|opendatacommons org licenses by
pddl|public domain|public domain dedication and licen[sc]e|pddl 1 0|opendatacommons org licenses pddl
python|python|python( software foundation)? licen[sc]e|psf 2 0|docs python org license
php|php|php licen[sc]e|php 3 01|www php net license
ruby|ruby|ruby licen[sc]e|ruby|www ruby lang org license
openssl|openssl|openssl licen[sc]e|openssl|www openssl org source license
postgresql|postgresql|postgresql licen[sc]e|postgresql|www postgresql org about licence
ncsa|illinois|university of illinois( ncsa)? open source licen[sc]e|ncsa|opensource org licenses ncsa
mulan|mulan|mulan (psl|permissive software licen[sc]e)|mulanpsl 2 0|license coscl org cn mulanpsl2
ms-pl|microsoft public|microsoft public licen[sc]e|ms pl|opensource org licenses ms pl
ms-rl|microsoft reciprocal|microsoft reciprocal licen[sc]e|ms rl|opensource org licenses ms rl
bsl|business source|business source licen[sc]e|busl 1 1|mariadb com bsl11
sspl|server side|server side public licen[sc]e|sspl 1 0|www mongodb com licensing server side public license
elastic|elastic|elastic licen[sc]e( 2 0)?|elastic 2 0|www elastic co licensing elastic license
openrail|openrail|openrail licen[sc]e|openrail|www licenses ai
"""

# How a license is mentioned: expression over its name, tag or address; priority; confidence; words it needs besides.
_MENTIONS = (
    ("spdx license identifier {tag}", 4, 1.0, "spdx"),
    ("(licensed|released|distributed|published|made available|available|provided|covered) under( the)?"
     "( terms of( the)?)? {name}", 3, 0.95, "under"),
    ("(subject to|governed by|in accordance with|see) the( terms of the)? {name}", 3, 0.85, ""),
    ("(https? )?{address}", 3, 0.9, ""),
    ("{name}", 2, 0.8, ""),
)

# Rules that name no single license: label | words | expression | priority | confidence.
_NOTICES = """
gpl|general public|(gnu )?general public licen[sc]e|1|0.6
lgpl-2|library public|(gnu )?library general public licen[sc]e( version| v)? 2|2|0.8
freebsd|freebsd|freebsd licen[sc]e|2|0.8
cc-by|creative commons attribution|creative commons attribution( [1-4] [0-9])?|2|0.8
cc-by-sa|creative commons attribution|creative commons attribution (sharealike|share alike)( [1-4] [0-9])?|2|0.8
cc-by-nc|creative commons attribution|creative commons attribution (noncommercial|non commercial)( [1-4] [0-9])?|2|0.8
cc-by-nd|creative commons attribution|creative commons attribution (noderivatives|no derivatives)( [1-4] [0-9])?|2|0.8
openrail|responsible ai|responsible ai licen[sc]e|2|0.8
lgpl|lesser|lesser general public licen[sc]e|1|0.6
reserved|rights reserved|all rights reserved|2|0.7
reserved|reproduced|no part of this( [0-9a-z]+)? may be reproduced|2|0.7
copyright|copyright|copyright( c)? (19|20)[0-9][0-9]|2|0.6
copyright|copyright|copyright (c|by)|1|0.4
proprietary|proprietary|proprietary and confidential|3|0.9
proprietary|confidential|confidential and proprietary|3|0.9
proprietary|trade secrets|contains( valuable)? trade secrets|2|0.7
public-domain|public domain|(released|placed|dedicated) (in|into|to) the public domain|3|0.9
public-domain|public domain|in the public domain|2|0.7
permission|permission granted|permission is hereby granted( free of charge)?|2|0.6
permission|permission distribute|permission to use copy modify and( or)? distribute|3|0.7
warranty|warranty|without warranty of any kind|1|0.4
warranty|warranties|without warranties or conditions of any kind|1|0.4
redistribution|redistribution source|redistribution and use in source and binary forms|3|0.7
non-commercial|commercial|(for )?non commercial( use| purposes)? only|2|0.6
non-commercial|commercial|not for commercial use|2|0.6
creative-commons|creative commons|creative commons licen[sc]e|1|0.5
dual|dual|dual licensed|2|0.5
"""
PRIORITIES = (1, 2, 3, 4)


def spaced(expression: str) -> str:
    """Give each word of an expression a space of its own on both sides, as the texts have."""
    return " " + expression.replace(" ", "  ") + " "


def rules() -> list[dict]:
    """All rules in order: ``rule, label, keys, pattern, priority, confidence``."""
    found = []
    for line in _LICENSES.strip().splitlines():
        label, keys, rest = line.split("|", 2)  # the name may hold bars of its own
        name, tag, address = rest.rsplit("|", 2)
        for form, priority, confidence, more in _MENTIONS:
            own = {"{tag}": tag, "{address}": address}
            words = next((text.split() for mark, text in own.items() if mark in form), keys.split())
            expression = form
            for mark, text in {**own, "{name}": f"({name})"}.items():
                expression = expression.replace(mark, text)
            found.append((label, words + more.split(), expression, priority, confidence))
    for line in _NOTICES.strip().splitlines():
        label, keys, rest = line.split("|", 2)
        expression, priority, confidence = rest.rsplit("|", 2)
        found.append((label, keys.split(), expression, int(priority), float(confidence)))
    return [{"rule": i, "label": label, "keys": sorted(set(keys)), "pattern": spaced(expression),
             "priority": priority, "confidence": confidence}
            for i, (label, keys, expression, priority, confidence) in enumerate(found)]


def _rule_column() -> Column:
    kind = "array<struct<rule:int,label:string,keys:array<string>,pattern:string,priority:int,confidence:double>>"
    return F.from_json(F.lit(json.dumps(rules())), kind)


def _words_in(piece: Column) -> Column:
    """Words of a piece of spaced text: each has two spaces."""
    return ((F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))) / 2).cast("long")


def spaced_words(docs: DataFrame) -> DataFrame:
    """``row, doc_id, t, n_words``: the words of each text, each between two spaces of its own."""
    plain = F.trim(F.regexp_replace(lower_ascii(F.col("text")), SEPARATORS, " "))
    once = with_once(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), w=plain).drop("text")
    return once.select("row", "doc_id", F.when(F.col("w") == "", "").otherwise(
        F.concat(F.lit(" "), F.replace("w", F.lit(" "), F.lit("  ")), F.lit(" "))).alias("t"),
        F.when(F.col("w") == "", 0).otherwise(
            F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"))


def _phrase_columns(rows: DataFrame) -> DataFrame:
    """Count the places of the fixed phrases, and find the first and the last of them."""
    either = "(" + "|".join(spaced(p) for p in PHRASES) + ")"
    has = {label: F.contains("t", F.lit(spaced(p))) for p, label in PHRASES.items()}
    some = with_once(rows, **{f"has_{i}": c for i, c in enumerate(has.values())})
    any_of = F.greatest(*[F.col(f"has_{i}") for i in range(len(has))])
    cut = with_once(some, pieces=F.when(any_of, F.split("t", either, -1)),
                    last_hit=F.when(any_of, F.element_at(F.regexp_extract_all("t", F.lit(either), F.lit(0)), -1)))
    labels = F.array_compact(F.array(*[F.when(F.col(f"has_{i}"), F.lit(label)) for i, label in enumerate(has)]))
    last = F.element_at("pieces", -1)
    return cut.select(
        "row", "doc_id", "t", "n_words",
        F.when(F.col("pieces").isNotNull(), F.size("pieces") - 1).otherwise(0).cast("long").alias("n_base"),
        _words_in(F.element_at("pieces", 1)).alias("first_word"),
        (F.col("n_words") - _words_in(last) - _words_in(F.col("last_hit"))).alias("last_word"),
        F.array_sort(labels).alias("base_labels"))


def _candidates(rows: DataFrame) -> DataFrame:
    """The numbers of the rules whose needed words a text holds all; the text itself goes where there are none."""
    keys = F.array(*[F.lit(k) for k in sorted(set(chain.from_iterable(r["keys"] for r in rules())))])
    held = with_once(rows, held=F.array_intersect(F.split("t", " "), keys))
    whole = F.filter(_rule_column(), lambda r: F.size(F.array_except(r["keys"], F.col("held"))) == 0)
    none = F.array().cast("array<int>")
    tried = with_once(held, tried=F.when(F.size("held") > 0, F.transform(whole, lambda r: r["rule"])).otherwise(none))
    return tried.drop("held").withColumn("t", F.when(F.size("tried") > 0, F.col("t")))


def detections(rows: DataFrame) -> DataFrame:
    """``row, rule, label, priority, confidence, start, stop`` of all matches; places are characters of ``t``."""
    known = rows.sparkSession.range(1).select(F.inline(_rule_column())).drop("keys")  # as many rows as there are rules
    one = rows.where("size(tried) > 0").select("row", "t", F.explode("tried").alias("rule")).join(
        F.broadcast(known), "rule")
    lengths = F.arrays_zip(
        F.transform(F.split("t", F.col("pattern"), -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all("t", F.col("pattern"), F.lit(0)), F.length).alias("hit"))
    cut = one.select("row", "rule", "label", "priority", "confidence", F.posexplode(lengths).alias("i", "l"))
    cut = cut.select("row", "rule", "label", "priority", "confidence", "i",
                     F.col("l.gap").cast("long").alias("gap"), F.col("l.hit").cast("long").alias("hit"))
    upto = Window.partitionBy("row", "rule").orderBy("i")
    stop = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(upto)
    return cut.repartition("row").withColumn("stop", stop).where("hit IS NOT NULL").select(
        "row", "rule", "label", "priority", "confidence", (F.col("stop") - F.col("hit")).alias("start"), "stop")


def unsuppressed(found: DataFrame) -> DataFrame:
    """Drop detections around one of higher priority, then those inside one of the same or a higher priority.

    Of equal places with equal priority the rule that stands first stays.
    """
    inward = Window.partitionBy("row").orderBy(F.desc("start"), "stop", F.desc("priority"), "rule").rowsBetween(
        Window.unboundedPreceding, -1)
    inner = F.coalesce(*[F.when(F.col("priority") == p, F.min(F.when(F.col("priority") > p, F.col("stop"))).over(inward))
                         for p in PRIORITIES])
    outer = found.withColumn("_inner", inner).where("_inner IS NULL OR _inner > stop").drop("_inner")
    outward = Window.partitionBy("row").orderBy("start", F.desc("stop"), F.desc("priority"), "rule").rowsBetween(
        Window.unboundedPreceding, -1)
    around = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(outward))
                          for p in PRIORITIES])
    return outer.withColumn("_outer", around).where("_outer IS NULL OR _outer < stop").drop("_outer")


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts' phrase counts with a row number, and the detections that stay.

    Null and empty texts have no words, no detections and null first and last
    places. Rows may repeat: each is scanned on its own. Columns besides
    ``doc_id`` and ``text`` are not read; empty tables give no rows.
    """
    rows = staged(_candidates(_phrase_columns(spaced_words(docs))), "license-texts")
    return rows.drop("t", "tried"), unsuppressed(detections(rows))


def license_labels(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: one row per row of ``docs``.

    ``labels`` joins those of the phrases and of the detections that stay;
    ``score`` is the highest confidence among the latter, 0 without any.
    """
    rows, found = scan(docs)
    best = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("best"))
    none = F.array().cast("array<string>")
    return rows.join(best, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("more", none))).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"))
