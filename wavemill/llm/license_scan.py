"""Licence scans: Dice coefficient over word bigrams against templates. DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by which public licences are commonly named.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
MIN_DICE = 0.75


def bigrams_of(text: str) -> list[str]:
    """Bigrams of the lower-cased words ``[A-Za-z0-9]+``, in order."""
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9]+", text)]
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def _rare(bigrams: list[str], least: int) -> list[str]:
    """Long words of a template; fewer than ``least`` of its bigrams have none of them."""
    out: list[str] = []
    for w in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), w)):
        if sum(not set(b.split()) & set(out) for b in bigrams) < least:
            break
        out.append(w)
    return out


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


_WINDOW = "struct<s:int,licence:string,d:double,e:int,l:int,own:boolean>"


def _apart(found: Column) -> Column:
    """Windows that share no word, in one sweep by start: of two that do, a line's own or else the higher Dice stays.

    A window that gave way to one that itself gives way comes back if it is clear of the last.
    """
    none = F.lit(None).cast(_WINDOW)

    def step(a: Column, c: Column) -> Column:
        last, prev = a["last"], a["prev"]
        better = (c["own"] & ~last["own"]) | ((c["own"] == last["own"]) & (c["d"] < last["d"]))
        back = F.when(prev.isNotNull() & (prev["e"] + 1 < c["s"]), F.concat(a["done"], F.array(prev))).otherwise(a["done"])
        to = lambda done, prev: F.struct(done.alias("done"), c.alias("last"), prev.alias("prev"))
        return F.when(last.isNull(), to(a["done"], none)).when(c["s"] > last["e"] + 1, to(F.concat(a["done"], F.array(last)), none)).when(better, to(back, last)).otherwise(a)

    start = F.struct(F.array().cast(f"array<{_WINDOW}>").alias("done"), none.alias("last"), none.alias("prev"))
    return F.aggregate(F.array_sort(found), start, step, lambda a: F.when(a["last"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["last"]))))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_dice: float = MIN_DICE, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every input row with n_segments, hits: array of struct(segment, licence, dice) in text order.

    Segments are the lines of the text and, if it has several, the whole text as one (segment -1).
    A segment's best template counts if its Dice coefficient 2 |A and B| / (|A| + |B|) over word
    bigrams, as bags, is ``min_dice`` or more; ties go to the name that sorts first. Since it is at
    most 2 min / (|A| + |B|), only templates with |A| between m / (2 - m) |B| and (2 - m) / m |B|
    are compared; |A| is one less than the segment's words, so a segment that fits no template costs
    no more than counting them. A template may not repeat a bigram: then the common bag is the
    common set.

    Notices inside a line or across lines are found by windows over the words of the whole text, of
    any length that a template admits; the best from each start that begins and ends with a bigram of
    the template counts, of windows that share words one counts, and none that a segment of the same
    licence holds. Its segment is the line it begins in, its Dice that of the window's distinct
    bigrams. As a window needs m / (2 - m) |B| of the template's bigrams, texts without any of a few
    of its words, or without the words of so many bigrams, are not looked through.

    One projection of the scan: no shuffle, no growth with other rows. Null and empty
    texts have no hits; other columns stay as they are.
    """
    sets = {k: b for k, v in sorted(templates.items()) if (b := bigrams_of(v))}
    if any(len(set(b)) < len(b) for b in sets.values()):
        raise ValueError("a template repeats a bigram")
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    least = lambda n: math.ceil(n * low - 1e-9)
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("b"), F.array(*map(F.lit, _rare(b, least(len(b))))).alias("any"), F.array(*[F.struct(*[F.lit(w).alias(c) for w, c in zip(x.split(), "xy")]) for x in b]).alias("two"), F.lit(least(len(b))).alias("least")) for k, b in sets.items()])
    fewest, most = min(map(len, sets.values())) * low, max(map(len, sets.values())) * high

    def best(words: Column, no: Column) -> Column:
        size = F.size(words) - 1
        pairs = F.zip_with(F.slice(words, 1, size), F.slice(words, 2, size), lambda a, b: F.lower(F.concat_ws(" ", a, b)))
        near = F.filter(known, lambda t: (size >= t["n"] * low) & (size <= t["n"] * high))
        scored = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(pairs, t["b"])) / (size + t["n"])).alias("d"), t["name"].alias("name")))
        top = F.array_min(F.filter(scored, lambda s: s["d"] <= -min_dice))
        return F.when((size >= fewest) & (size <= most), F.struct(no.alias("segment"), top["name"].alias("licence"), (-top["d"]).alias("dice")))

    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    words = lambda s: F.regexp_extract_all(s, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    count = F.regexp_count(F.col(text), F.lit("[A-Za-z0-9]+"))
    whole = F.when((F.size(lines) > 1) & (count - 1 <= most), F.array(words(F.col(text)))).otherwise(F.array().cast("array<array<string>>"))
    full = F.transform(whole, lambda w: best(w, F.lit(-1)))

    def within(p: Column, t: Column, done: Column) -> Column:
        """Windows of a template from p, the places of its bigrams: struct(i, k, l, r)."""
        most_of = F.floor(t["n"] * high).cast("int")

        def ends(a: Column, at: Column) -> Column:
            some = F.filter(F.slice(p, at + 1, most_of), lambda z: z["i"] < a["i"] + most_of)
            dice = lambda z, j: -2.0 * F.size(F.array_distinct(F.slice(some["k"], F.lit(1), j + 1))) / (z["i"] - a["i"] + 1 + t["n"])
            top = lambda some: F.array_min(F.transform(some, lambda z, j: F.struct(dice(z, j).alias("d"), z["i"].alias("e"), z["r"].alias("r"))))
            own = lambda b: F.exists(done, lambda h: (h["licence"] == t["name"]) & ((h["segment"] == -1) | ((h["segment"] == a["l"]) & (h["segment"] == b["r"]))))
            return _bind(top(some), lambda b: F.when(b["d"] <= -min_dice, F.struct(a["i"].alias("s"), t["name"].alias("licence"), b["d"].alias("d"), b["e"].alias("e"), a["l"].alias("l"), own(b).alias("own"))))

        return F.filter(F.transform(p, ends), lambda x: x.isNotNull())

    def windows(w: Column, done: Column, near: Column) -> Column:
        tagged = F.flatten(F.transform(w, lambda ws, no: F.transform(ws, lambda x: F.struct(F.lower(x).alias("w"), no.alias("l")))))
        both = lambda x, y: F.struct(F.concat_ws(" ", x["w"], y["w"]).alias("g"), x["l"].alias("l"), y["l"].alias("r"))
        pairs = lambda x: F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), both)
        place = lambda g, i, t: F.struct(i.alias("i"), F.array_position(t["b"], g["g"]).alias("k"), g["l"].alias("l"), g["r"].alias("r"))
        places = lambda g, t: F.filter(F.transform(g, lambda x, i: place(x, i, t)), lambda z: z["k"] > 0)
        found = _bind(_bind(tagged, pairs), lambda g: F.flatten(F.transform(near, lambda t: _bind(places(g, t), lambda p: within(p, t, done)))))
        return F.transform(F.filter(_apart(found), lambda x: ~x["own"]), lambda x: F.struct(x["l"].alias("segment"), x["licence"], (-x["d"]).alias("dice")))

    def all_hits(w: Column) -> Column:
        done = F.filter(F.concat(full, F.transform(w, best)), lambda h: h["licence"].isNotNull())
        near = _bind(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda x: F.filter(known, lambda t: F.exists(t["any"], lambda a: F.contains(x, a)) & (F.size(F.filter(t["two"], lambda b: F.contains(x, b["x"]) & F.contains(x, b["y"]))) >= t["least"])))
        return _bind(done, lambda d: _bind(near, lambda t: F.when(F.size(t) > 0, F.array_sort(F.concat(d, windows(w, d, t)))).otherwise(d)))

    return docs.withColumns({"n_segments": F.size(lines), "hits": _bind(F.transform(lines, words), all_hits)})
