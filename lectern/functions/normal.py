"""Unicode normal forms and the spellings under which terms, targets, captions and page texts are compared.

Spark has no normal forms, so these go to Python in Arrow batches, and only for texts beyond ASCII: others are sent as nulls.
All functions give null for null and the empty text for the empty text."""
from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DASHES = "-–—‑"
#: Texts of a batch that are read at a time.
SLICE = 64


def _form(form: str, marks: bool, fold: bool = False):
    def one(x: str) -> str:
        x = unicodedata.normalize(form, x)
        x = x if marks else "".join(c for c in x if not unicodedata.combining(c))
        return x.casefold() if fold else x

    # Only SLICE texts at a time are strings of Python, which take up to four bytes a letter; the rest of a batch is Arrow's.
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else one(x) for x in texts.slice(i, SLICE).to_pylist()], pa.string()) for i in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(run, "string")


def _beyond_ascii(text: Column, run) -> Column:
    return F.coalesce(run(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normal_term(text: Column) -> Column:
    """A term's spelling: compatibility letters without marks, lower case, dashes as spaces, single spaces."""
    plain = F.lower(F.replace(_beyond_ascii(text, _form("NFKD", marks=False)), F.lit("’"), F.lit("'")))
    return F.trim(F.regexp_replace(F.translate(plain, DASHES, " " * len(DASHES)), r"(?U)\s+", " "))


def normal_target(text: Column) -> Column:
    """A translation's spelling: compatibility letters, case folded, without spaces, dashes, middle dots and quotes."""
    plain = F.coalesce(_form("NFKC", marks=True, fold=True)(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))
    return F.regexp_replace(plain, r"(?U)[\s\-–—·•‐‑‒'’]+", "")


#: Characters of page texts that show nothing (fixed values).
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"


def normal_source(text: Column) -> Column:
    """A page text's spelling: compatibility letters, no invisible characters, single spaces."""
    plain = _beyond_ascii(text, _form("NFKC", marks=True))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, f"[{INVISIBLE}]", ""), r"(?U)\s+", " "))


def normal_source_of(text: str) -> str:
    """The same for one text, where Python reads it anyway."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(dict.fromkeys(map(ord, INVISIBLE))).split())


def normal_caption(text: Column) -> Column:
    """A caption's spelling: single spaces, none between two Han letters, after CJK punctuation before Han, or before any
    punctuation. Pairs are read from the left, so of three Han letters apart the third stays apart."""
    # Runs that are one space already are not replaced. Behind that every space stands between two other characters, and
    # which rule it falls under depends on these alone, so one pass does for all three.
    x = F.regexp_replace(text, r"(?U)[^\S ]\s*+| \s++", " ")
    return F.trim(F.regexp_replace(x, "([㐀-鿿]) ([㐀-鿿])| (?:(?=[,.;:!?，。；：！？])|(?<=[，。；：！？] )(?=[㐀-鿿]))", "$1$2"))
