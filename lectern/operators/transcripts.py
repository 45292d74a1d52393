"""Transcripts cut anew: captions to sentences, sentences to segments with bounds on characters and seconds."""
from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.split import caption_text, thoughts


@dataclass(frozen=True)
class Limits:
    """Bounds of a segment (fixed values): it may end from `least` characters on, should at `ideal`, and must at a fifth over
    `most`, or 5 s over `seconds`."""

    least: int = 60
    ideal: int = 180
    most: int = 320
    seconds: float = 20.0


#: Parts of sentences with their marks, and ends of sentences and clauses (closing quotes may follow).
PARTS = re.compile("[^.!?;:,。！？；：，]+(?:[.!?;:,。！？；：，]+[\"')\\]”’）】」』]*|$)")
SENTENCE = re.compile("[.!?。！？][\"')\\]”’）】」』]*$")
CLAUSE = re.compile("[;:,；：，][\"')\\]”’）】」』]*$")


def pieces(text: str, start: float, duration: float, limits: Limits):
    """(text, start, ends a sentence, ends a clause) of a caption's parts; starts follow the share of characters before."""
    text = caption_text(text)
    before = 0
    for part in PARTS.findall(text) or ([text] if text else []):
        cut = thoughts(part, limits.most)
        for x in cut:
            share = min(1.0, before / len(text))
            yield x, start + duration * share, bool(SENTENCE.search(x)) or len(cut) > 1, bool(CLAUSE.search(x))
            before += len(x) + 1


def regroup(captions: list[tuple[float, float, str]], limits: Limits = Limits()) -> list[tuple[float, str]]:
    """(start, text) of segments from captions (start, duration, text) in order. A segment ends at a sentence once it has its
    least size or 8 s, at a clause once it has its ideal size or all its seconds, and anywhere at its hard bounds."""
    out: list[tuple[float, str]] = []
    held, begun = "", 0.0
    for start, duration, text in captions:
        for x, at, sentence, clause in pieces(text or "", start, max(0.0, duration or 0.0), limits):
            begun = begun if held else at
            held = caption_text(f"{held} {x}")
            took, n = max(0.0, at - begun), len(held)
            natural = sentence or (clause and (n >= limits.ideal or took >= limits.seconds))
            large = n >= limits.least or took >= 8
            if (natural and large) or n >= round(limits.most * 1.2) or took >= limits.seconds + 5:
                out.append((begun, held))
                held = ""
    return out + ([(begun, held)] if held else [])


def segments(captions: DataFrame, key: str, order: str, limits: Limits = Limits()) -> DataFrame:
    """(key, pos, start, text) from captions (key, order, start, duration, text). A key's captions (one recording) are folded
    in one task; a recording has thousands of captions at most, not a share of the table."""

    def run(ks: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order)[["start", "duration", "text"]]
        made = regroup([(s, d, x if isinstance(x, str) else "") for s, d, x in rows.itertuples(index=False, name=None)], limits)
        return pd.DataFrame([(ks[0], i, s, x) for i, (s, x) in enumerate(made)], columns=[key, "pos", "start", "text"])

    kind = dict(captions.dtypes)[key]
    return captions.select(key, order, "start", "duration", "text").groupBy(key).applyInPandas(run, f"`{key}` {kind}, pos long, start double, text string")
