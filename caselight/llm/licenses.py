"""License notices by conditional compression.

The text around every word of licensing is compressed plainly and with each template as a
raw zstandard dictionary.  Templates are ranked by the bytes they save, and only those that
save any are compared word by word, down the ranking.  What is confirmed is cut
out and what is left is ranked again, so that notices side by side are all found.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.words import worker_state
from caselight.shipping import ship_by_value

ship_by_value(__name__)

# Wordings of public licenses and notices, to be matched as they are.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "All-Rights-Reserved": (
        "All rights reserved.",
    ),
}
CUES = r"(?i)licen[sc]e|permission is hereby granted|redistribution and use|creative commons|all rights reserved"

_CUE = re.compile(CUES)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
BLOCK_CHARS = 1500  # a block is no longer, so that a long line without an end costs no more than a short one
LEAD_CHARS = 300  # what may stand before the cue


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of the text to look at: each line with a cue and what follows up to an empty line; no two overlap.

    A notice that goes on behind a block is seen whole in its cue's window.
    """
    last = 0
    for cue in _CUE.finditer(text):
        if cue.start() < last:
            continue
        start = max(text.rfind("\n", last, cue.start()) + 1, last)
        if cue.start() - start > LEAD_CHARS:
            start = text.find(" ", cue.start() - LEAD_CHARS, cue.start()) + 1 or cue.start()
        empty = text.find("\n\n", cue.end(), start + BLOCK_CHARS)
        end = empty + 1 if empty >= 0 else min(start + BLOCK_CHARS, len(text))
        if end < len(text) and empty < 0:  # not within a word
            end = max(text.rfind(" ", cue.end(), end), text.rfind("\n", cue.end(), end)) + 1 or end
        last = max(end, cue.end())
        yield start, last


def windows(text: str, reach: int) -> Iterator[tuple[int, int]]:
    """``reach`` characters on both sides of every cue; they overlap."""
    for cue in _CUE.finditer(text):
        start = max(cue.start() - reach, 0)
        end = min(cue.end() + reach, len(text))
        if start:  # not within a word
            start = text.find(" ", start, cue.start()) + 1 or start
        if end < len(text):
            end = text.rfind(" ", cue.end(), end) + 1 or end
        yield start, end


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=6, write_content_size=False, write_checksum=False)
        self.known = []
        self.reach = max(LEAD_CHARS, 2 * max((len(w) for wordings in templates.values() for w in wordings), default=0))
        for name, wordings in templates.items():
            for wording in wordings:
                raw = zstandard.ZstdCompressionDict(wording.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                with_it = zstandard.ZstdCompressor(level=6, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
                self.known.append((name, words_of(wording), with_it))
        self.fewest = min((len(w) for _, w, _ in self.known), default=1)

    def rank(self, block: str) -> list[tuple[float, int]]:
        """Bytes saved by each template's dictionary, the most first; ties to the longer wording, then by place."""
        data = block.lower().encode()
        alone = len(self.plain.compress(data))
        saved = [(alone - len(c.compress(data)), at) for at, (_, _, c) in enumerate(self.known)]
        return sorted(saved, key=lambda x: (-x[0], -len(self.known[x[1]][1]), x[1]))

    def confirm(self, block: str, tolerance: float) -> dict:
        """The first of the ranked templates whose wording is there, with the words that differ."""
        text = words_of(block)
        best = None
        for saved, at in self.rank(block):
            name, wanted, _ = self.known[at]
            if saved <= 0:
                break
            match = difflib.SequenceMatcher(None, wanted, text, autojunk=False).get_matching_blocks()
            found = {"license": name, "saved": saved, **compared(wanted, match, tolerance)}
            if best is None or found["confirmed"]:
                best = found
            if found["confirmed"]:
                break
        return best or {"license": None, "saved": 0, "missing": [], "n_words": 0, "confirmed": False}

    def standing(self, words: list[tuple[str, int, int]], at: int, tolerance: float) -> Iterator[tuple[int, int, dict]]:
        """``(first, last, found)``: the stretches of words in which a template's wording stands in one place."""
        name, wanted, _ = self.known[at]
        plain = [w for w, _, _ in words]
        held = set(plain)
        if not agrees([w for w in wanted if w not in held], wanted, tolerance):
            return
        start = 0
        while start < len(plain):
            steps = [m for m in difflib.SequenceMatcher(None, wanted, plain[start:], autojunk=False).get_matching_blocks() if m.size]
            found = compared(wanted, steps, tolerance)
            if not found["confirmed"] or not steps:
                return
            first, last = start + steps[0].b, start + steps[-1].b + steps[-1].size
            if last - first <= len(wanted) + len(wanted) // 2:
                yield first, last, {"license": name, **found}
            start += max(steps, key=lambda m: m.size).b + 1

    def notices(self, text: str, tolerance: float) -> list[tuple[int, int, dict]]:
        """``(start, end, found)`` of every template whose wording stands in one place near a cue; of overlapping ones that with the most words.

        Each cue has a window of its own, longer than the longest wording.  Its templates are
        ranked by compression; of the stretches confirmed the best is taken and cut out, and
        what stands before and behind it is ranked again.
        """
        out = {}
        for low, high in windows(text, self.reach):
            words = [(m.group(), low + m.start(), low + m.end()) for m in _WORD.finditer(text[low:high].lower())]
            if len(text[low:high].lower()) != high - low:  # lower case that changes the length
                words = [(m.group().lower(), low + m.start(), low + m.end()) for m in _WORD.finditer(text[low:high])]
            pieces = [words]
            while pieces:
                piece = pieces.pop()
                if len(piece) < self.fewest:
                    continue
                best = None
                for saved, at in self.rank(text[piece[0][1]:piece[-1][2]]):
                    if saved <= 0:
                        break
                    for first, last, found in self.standing(piece, at, tolerance):
                        order = len(found["missing"]) - found["n_words"], len(found["missing"]), piece[first][1], piece[last - 1][2], at
                        if best is None or order < best[0]:
                            best = order, first, last, {**found, "saved": saved}
                if best:
                    (*_, start, end, at), first, last, found = best
                    out.setdefault((start, end, at), found)
                    pieces += [piece[:first], piece[last:]]
        kept: list[tuple[int, int, dict]] = []
        for (start, end, _), found in sorted(out.items(), key=lambda x: (len(x[1]["missing"]) - x[1]["n_words"], len(x[1]["missing"]), x[0])):
            near = bisect.bisect_left(kept, start, key=lambda k: k[1] - 1)  # the first kept one that ends behind the start
            if near == len(kept) or kept[near][0] >= end:
                kept.insert(near, (start, end, found))
        return kept


def agrees(missing: list[str], wanted: list[str], tolerance: float) -> bool:
    # a number or a clause code that differs makes it another license
    return len(missing) <= tolerance * len(wanted) and not any(c.isdigit() or "-" in w for w in missing for c in w)


def compared(wanted: list[str], match: list, tolerance: float) -> dict:
    there = {i for m in match for i in range(m.a, m.a + m.size)}
    missing = [w for i, w in enumerate(wanted) if i not in there]
    confirmed = agrees(missing, wanted, tolerance)
    if confirmed and len(wanted) < 4:  # so few words must stand together
        confirmed = any(m.size == len(wanted) for m in match)
    return {"missing": missing, "n_words": len(wanted), "confirmed": confirmed}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES,
                  tolerance: float = 0.15) -> DataFrame:
    """``(id, start, end, license, confirmed, saved, n_words, n_missing, missing)``: one row per notice found in each text,
    with its place, and one per candidate block in which none begins or ends.

    ``saved`` is the number of bytes that the template's dictionary took off the compressed block, or window, in which it was found;
    ``confirmed`` says that at most ``tolerance`` of its words, and no number or code, are
    missing from the block (``missing``, in order).  Blocks that no dictionary helps have a null license.  Places
    are code points.  Texts without a cue, null and empty texts have no rows; a repeated row repeats its rows, a null
    id stays null, other columns are not read.  Map-only: texts without a cue never reach Python.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = worker_state(f"licenses {hash(tuple(templates.items()))}", lambda: Matcher(templates))
        for batch in batches:
            owner, out = [], []
            for at, text in enumerate(batch.column(1)):
                text = text.as_py()
                rows = matcher.notices(text, tolerance)
                held = [(s, e) for s, e, _ in rows]
                for start, end in blocks(text):
                    near = bisect.bisect_right(held, start, key=lambda k: k[1])
                    if near == len(held) or held[near][0] >= end:
                        rows.append((start, end, matcher.confirm(text[start:end], tolerance)))
                rows.sort(key=lambda r: r[:2])
                owner += [at] * len(rows)
                out += rows
            found = [x[2] for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array([x[0] for x in out], pa.int64()),
                 pa.array([x[1] for x in out], pa.int64()), pa.array([f["license"] for f in found], pa.string()),
                 pa.array([f["confirmed"] for f in found], pa.bool_()), pa.array([f["saved"] for f in found], pa.int64()),
                 pa.array([f["n_words"] for f in found], pa.int64()), pa.array([len(f["missing"]) for f in found], pa.int64()),
                 pa.array([" ".join(f["missing"]) for f in found], pa.string())],
                [id_col, "start", "end", "license", "confirmed", "saved", "n_words", "n_missing", "missing"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).where(F.col(text_col).rlike(CUES)).mapInArrow(
        run, f"`{id_col}` {id_type}, start long, end long, license string, confirmed boolean, saved long, n_words long, "
             "n_missing long, missing string")
