"""Licence recognition by sentence rules.

A text is split into sentences, at line breaks too. A normalised sentence, or a run of sentences of one
paragraph, that is a known licence sentence becomes its identifier: a known sentence may be wrapped over lines
and hold closing marks. Rules are ordered sequences of identifiers; a rule matches where its
identifiers follow each other in the text with at most ``gap`` unknown sentences in between.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised (lower case, single spaces, no closing mark).
# Public licence texts and notices; an identifier may have several wordings.
SENTENCES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license", "the mit license (mit)"],
    "mit-grant": [
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"software\"), to deal in the software without restriction",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"software\"), to deal in the software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the software, and to permit persons to whom the software is furnished to do so, subject to the following "
        "conditions",
    ],
    "mit-condition": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software",
    ],
    "apache-notice": [
        "licensed under the apache license, version 2.0",
        "licensed under the apache license, version 2.0 (the \"license\")",
    ],
    "apache-condition": ["you may not use this file except in compliance with the license"],
    "gpl3-notice": [
        "this work is licensed under the gnu general public license, version 3",
        "licensed under the gnu general public license, version 3",
    ],
    "gpl-redistribute": [
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu "
        "general public license as published by the free software foundation, either version 3 of the license, "
        "or (at your option) any later version",
    ],
    "gpl-warranty": [
        "this program is distributed in the hope that it will be useful, but without any warranty",
        "this program is distributed in the hope that it will be useful, but without any warranty; without even the "
        "implied warranty of merchantability or fitness for a particular purpose",
    ],
    "cc-by-nc-notice": [
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    ],
    "bsd-redistribution": [
        "redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ],
    "as-is": [
        "the software is provided \"as is\", without warranty of any kind, express or implied",
        "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited "
        "to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    ],
}

# Licence, and the identifiers in the order in which they must stand.
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice", "apache-condition")),
    ("BSD", ("bsd-redistribution",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant", "as-is")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-notice", "mit-grant", "as-is")),
)

# Where a sentence ends: at a line break, or at a closing mark before white space. A blank line leaves an empty piece.
BOUNDARY = r"\r\n|[\r\n]|(?<=[.!?;:])\s+"

# Leading comment marks and closing marks; the latter are tried only where a run of them begins.
MARKS = r"^[\s#*/>;-]+(?:[\s.!?;:*/]+$)?|(?<![\s.!?;:*/])[\s.!?;:*/]+$"

WORDY = r"[^\s#*/>;.!?:-]"  # in a piece of more than marks


def sentence_key(sentence: Column) -> Column:
    """Lower case, runs of white space as one space, no leading comment marks, no closing marks."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), r"\s+", " ")), MARKS, "")


def unbroken(wording: str) -> str:
    """The wording as the joined keys of the pieces a text with it is split into."""
    pieces = [re.sub(MARKS, "", piece) for piece in re.split(BOUNDARY, wording)]
    return " ".join(piece for piece in pieces if piece)


def opening(wordings: list[str]) -> str:
    """A pattern of pieces that may start a wording: its first two words, or the first one alone."""
    words = [[re.escape(x) for x in w.split(" ")[:2]] for w in wordings]
    starts = sorted({w[0] + "".join(rf"(?:\s+{x}|[\s.!?;:*/]*$)" for x in w[1:]) for w in words})
    return r"(?iu)^[\s#*/>;-]*(?:" + "|".join(starts) + ")" if starts else "(?!)"


def recognise(
    docs: DataFrame,
    sentences: dict[str, list[str]] | None = None,
    rules: tuple | None = None,
    gap: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_sentences, found, licences, n_matches`` of every row.

    ``found`` lists the known sentences in order as (sentence number, identifier); ``licences`` the
    distinct licences of matched rules, sorted; a rule contained in a longer match of the same licence adds
    no further name. ``n_matches`` counts (rule, place) pairs. Null and empty texts have no
    sentences. A known sentence spread over several counts at its first one; the longest that starts at a place
    is taken, and none inside another. Blank lines and empty comment lines end it, and aren't counted in a gap. Each row is
    judged by itself, whatever its id; an empty table gives no rows.

    Narrow: a single projection, no shuffle, the catalogue is part of the plan.
    """
    known = sentences or SENTENCES
    chosen = RULES if rules is None else rules
    lookup = {unbroken(wording): name for name, wordings in known.items() for wording in wordings}
    lookup.pop("", None)
    # Every piece but an empty one brings a word, so a wording never spans more pieces than it has words.
    span = max((len(w.split(" ")) for w in lookup), default=1)
    starts_one = opening(list(lookup))
    keys = F.array(*[F.lit(w) for w in lookup]).cast("array<string>")
    names = F.array(*[F.lit(n) for n in lookup.values()]).cast("array<string>")
    raw = F.split(F.coalesce(F.col(text_col), F.lit("")), BOUNDARY)

    def numbered(s: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("i"), s.alias("s"))

    def with_number(name: str, of: str):
        return lambda x, k: F.struct(x["i"].alias("i"), x["s"].alias("s"), *([x[of].alias(of)] if of else []), (k + 1).alias(name))

    # The place of a piece in a filtered array is the number of pieces of that kind up to it.
    sentences_in = F.transform(F.filter(F.transform("raw", numbered), lambda x: F.trim(x["s"]) != ""), with_number("at", ""))
    wordy = F.transform(F.filter("sentences", lambda x: x["s"].rlike(WORDY)), with_number("first", "at"))

    def tried(x: Column) -> Column:
        key = F.when(x["s"].rlike(starts_one), sentence_key(x["s"])).alias("key")
        return F.struct(x["i"].alias("i"), x["at"].alias("at"), x["first"].alias("first"), key)

    def begins(x: Column) -> Column:
        return F.exists(keys, lambda w: (w == x.key) | w.startswith(F.concat(x.key, F.lit(" "))))

    def keyed(x: Column) -> Column:
        keyed_pieces = F.transform(F.slice("raw", x["i"], span), sentence_key)
        return F.struct(x["at"].alias("at"), x["first"].alias("first"), keyed_pieces.alias("keys"))

    def longest(x: Column) -> Column:
        """The longest known wording that the pieces from here on make up."""
        runs = F.transform(
            F.sequence(F.lit(1), F.size(x["keys"])),
            lambda m: F.struct(m.alias("m"), F.array_join(F.slice(x["keys"], 1, m), " ").alias("key")),
        )
        run = F.array_max(F.filter(runs, lambda r: F.array_contains(keys, r.key)))
        return F.struct(x["at"].alias("at"), x["first"].alias("first"), run.alias("run"))

    def placed(x: Column) -> Column:
        name = F.element_at(names, F.array_position(keys, x.run.key).cast("int"))
        return F.struct(x["at"].alias("at"), name.alias("sentence"), x["first"].alias("first"), (x["first"] + x.run.m - 1).alias("last"))

    def outside(taken: Column, x: Column) -> Column:
        free = F.coalesce(F.get(taken, F.size(taken) - 1)["last"], F.lit(0)) < x["first"]
        return F.when(free, F.concat(taken, F.array(x))).otherwise(taken)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"))
    rows = rows.select("doc_id", "raw", sentences_in.alias("sentences"))
    rows = rows.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        "raw",
        F.filter(F.filter(F.transform(wordy, tried), lambda x: x.key.isNotNull()), begins).alias("starts"),
    )
    whole = F.transform(F.filter(F.transform(F.transform("starts", keyed), longest), lambda x: x.run.isNotNull()), placed)
    none = F.array().cast("array<struct<at:int,sentence:string,first:int,last:int>>")
    found = F.when(F.size("starts") > 0, F.aggregate(whole, none, outside)).otherwise(none)
    rows = rows.select("doc_id", "n_sentences", found.alias("found"))

    def places(steps: tuple[str, ...]) -> Column:
        """How many of the found sentences start a match of the rule."""

        def starts(x: Column, i: Column) -> Column:
            ok = x.sentence == steps[0]
            for k, name in enumerate(steps[1:], 1):
                later = F.get("found", i + k)
                before = F.get("found", i + k - 1)
                ok = ok & (later.sentence == name) & (later["first"] - before["last"] <= gap + 1)
            return F.coalesce(ok, F.lit(False))

        return F.size(F.filter("found", starts)).cast("long")

    counts = [places(steps) for _, steps in chosen]
    # Most texts hold no known sentence; the rules are not tried on them.
    any_found = F.size("found") > 0
    hits = F.when(any_found, F.array(*counts)).otherwise(F.lit(None))
    rows = rows.withColumn("hits", hits)
    licences = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.array(*[F.when(F.get("hits", F.lit(k)) > 0, F.lit(name)) for k, (name, _) in enumerate(chosen)])
            )
        )
    )
    return rows.select(
        "doc_id",
        "n_sentences",
        F.transform("found", lambda x: F.struct(x["at"].alias("at"), x.sentence.alias("sentence"))).alias("found"),
        F.when(F.col("hits").isNull(), F.array().cast("array<string>")).otherwise(licences).alias("licences"),
        F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)).cast("long").alias("n_matches"),
    )
