"""What a piece of a page is by its words: captions, grids, headings, furniture; each as a column and for one text.

The patterns are fixed values, written so that Java and Python read them alike."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.split import reference_start

_NUMBERED = r"\s*(?:s(?:upp(?:lementary)?)?[\s.-]*)?[0-9一二三四五六七八九十]+[a-z]?(?:[-–][0-9]+)?(?:[.:：、|\s]|$)"
CAPTION = r"(?i)^(?:(?:supplementary|supporting)\s+)?(?:fig(?:ure)?\.?|scheme|table|图|表)" + _NUMBERED
TABLE_CAPTION = r"(?i)^(?:(?:supplementary|supporting)\s+)?(?:table|表)" + _NUMBERED
BARE_LABEL = r"(?i)^(?:(?:supplementary|supporting)\s+)?(?:fig(?:ure)?\.?|scheme|图)\s*(?:s[\s.-]*)?[0-9]+[a-z]?[.:：|]?$"
PANEL = r"(?i)^\([a-z](?:\s*[-–—]\s*[a-z])?\)\s*"
ACRONYMS = r"(?i)^[A-Z0-9]{1,10}(?:[/-][A-Z0-9]{1,10})+[).,;:]?"
ENDED = r"[.!?][\"')\]]?$"
DANGLING = r"(?i)\b(?:and|or|of|the|with|to|for|in|at|on|from|using|between|into|under|emphasize)$"
CELL_NUMBERS = r"(?:^|\s)[−+]?[0-9]+(?:\.[0-9]+)?(?:\s*±\s*[0-9]+(?:\.[0-9]+)?)?(?=\s|$|%)"
CELL_HEADS = r"(?i)\b(?:Jsc|Voc|PCE|FF|CE|EE|Rct|Rs|capacity|voltage|current|sample|entry|yield|selectivity)\b"
CELL_UNITS = r"(?i)(?:mA|mAh|V|A|Ω|ohm|cm|g|kg|mol|wt|at)\s*(?:cm|g|kg|mol)?\s*[−-]?[0-9]*|%"
SMALL_WORDS = r"(?i)^(?:a|an|and|as|at|by|for|from|in|into|of|on|or|the|to|via|with)$"
SECTION_WORDS = r"(?i)^(?:abstract|introduction|experimental|methods?|results?(?: and discussion)?|discussion|conclusions?|supporting information|acknowledg(?:e)?ments?|references?)\b"
NOTICE = r"(?i)(?:downloaded\s+(?:by|on|from)|terms-and-conditions|wiley\s+online\s+library|creative\s+commons\s+license)"
OWN_LINES = (r"(?i)^How to cite\s*:", r"^©\s*(?:19|20)[0-9]{2}\b")
FOOT_LINES = (r"(?i)^[0-9]+\s+(?:of|/)\s+[0-9]+$", r"(?i)^[A-Za-z][A-Za-z &.-]+,\s*(?:19|20)[0-9]{2}$", r"(?i)(?:https?://|doi\.org/|\bdoi\s*:)")
#: Lines of nothing but digits and marks are cells of charts and tables, not text.
NO_TEXT = r"^[0-9\s.,;:()\[\]{}+\-–—=<>/%°×·|]+$"


def is_caption(text: Column) -> Column:
    """Whether a text begins like the caption of a figure, scheme or table."""
    return F.trim(text).rlike(CAPTION)


def is_table_caption(text: Column) -> Column:
    return F.trim(text).rlike(TABLE_CAPTION)


def is_narrative(text: Column) -> Column:
    """Whether a text is running prose: long, of words, with more letters than digits."""
    letters, digits = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[0-9]"))
    return (F.length(text) >= 72) & (F.regexp_count(text, F.lit("[A-Za-z]{2,}")) >= 9) & (letters >= F.greatest(F.lit(24.0), digits * 1.8))


def is_furniture(text: Column, x: Column, right: Column, y: Column, width: Column, page_width: float, page_height: float) -> Column:
    """Whether a block belongs to the page and not to what it says: notices at its edges, page numbers and addresses at its foot."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    aside = (x >= page_width * 0.94) | (right <= page_width * 0.06) | (width >= page_width * 1.08)
    own = plain.rlike(OWN_LINES[0]) | plain.rlike(OWN_LINES[1])
    foot = plain.rlike(FOOT_LINES[0]) | plain.rlike(FOOT_LINES[1]) | plain.rlike(FOOT_LINES[2])
    return (plain.rlike(NOTICE) & aside) | own | ((y >= page_height * 0.92) & foot)


_caption, _table, _section = re.compile(CAPTION), re.compile(TABLE_CAPTION), re.compile(SECTION_WORDS)
_numbers, _heads, _units, _small = re.compile(CELL_NUMBERS), re.compile(CELL_HEADS), re.compile(CELL_UNITS), re.compile(SMALL_WORDS)


def caption(text: str) -> bool:
    return bool(_caption.match(text.strip()))


def table_caption(text: str) -> bool:
    return bool(_table.match(text.strip()))


def narrative(text: str) -> bool:
    letters, digits = len(re.findall("[A-Za-z]", text)), len(re.findall("[0-9]", text))
    return len(text) >= 72 and len(re.findall("[A-Za-z]{2,}", text)) >= 9 and letters >= max(24, digits * 1.8)


def grid(text: str, most_cells: int) -> bool:
    """Whether lines of at most so many cells and this text are rows of a table."""
    text = text.strip()
    return most_cells >= 3 and any(len(p.findall(text)) >= 2 for p in (_numbers, _heads, _units))


def section_level(text: str) -> int:
    """The level of a heading by its number or its word; 0 for none, and for entries of reference lists."""
    text = text.strip()
    if reference_start(text):
        return 0
    if m := re.match(r"(?i)^(S?[0-9]+(?:\.[0-9]+)*\.?)\s+", text):
        number = m[1].removesuffix(".")
        return 3 if number[0] not in "Ss" and "." in number else 2
    return 2 if _section.match(text) else 0


def own_heading(text: str, lines: int) -> bool:
    """Whether a short block is a heading by what it says."""
    if lines > 2 or len(text) > 150 or reference_start(text.strip()):
        return False
    return bool(re.match(r"(?i)^(?:(?:S[0-9]+[a-z]?\.?)|(?:[0-9]+(?:\.[0-9]+)+\.?)|(?:[0-9]+\.))\s+\S", text.strip())) or section_level(text) > 0


def title_like(text: str, lines: int, font: float, body: float) -> bool:
    """Whether a short block in a somewhat larger font is in title case."""
    text = text.strip()
    if not text or len(text) > 120 or lines > 3 or text[-1] in ".!?;:" or font < body * 1.055:
        return False
    words = re.findall("[A-Za-z][A-Za-z'-]*", text)
    big = [w for w in words if not _small.match(w)]
    return bool(big) and len(words) <= 14 and sum(w[0].isupper() for w in big) >= 0.65 * len(big)
