"""Classes of documents and of blocks by scores and patterns, as column functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Per class where its keywords are counted (lower: lower-case text, sample: text, head: name and first 5,000
#: characters), the keywords, and what one counts.
KEYWORDS = {
    "academic-paper": ("low", r"\babstract\b|\breferences\b|\bdoi\b|\bmethodology\b|\bhypothesi[sz]\b", 3),
    "research-report": ("sample", r"(?i)investment thesis|price target|risk factors?|disclosures?|analyst certification|估值|投资建议|风险提示|免责声明", 4),
    "newspaper": ("head", r"(?i)wall street journal|financial times|newspaper|日报|早报|晚报", 6),
    "magazine": ("head", r"(?i)businessweek|magazine|economist|weekly|月刊|周刊|杂志", 6),
    "book": ("low", r"table of contents|contents|chapter\s+\d+|preface|foreword|目录|第.{0,4}章", 2),
}
#: What a file's name adds to a class.
NAMES = {
    "academic-paper": (r"论文|paper|journal|working paper|ssrn", 8),
    "research-report": (r"研报|research report|strategy|equity research", 9),
    "newspaper": (r"日报|报纸|journal\b|times\b", 7),
    "magazine": (r"杂志|businessweek|economist|magazine", 9),
    "book": (r"handbook|textbook|book|教程|手册|教材", 8),
}
#: Words, symbols and shapes of formulas and code.
WORD = r"[A-Za-z][A-Za-z'’-]*"
MATH = r"[=∫∑√∞≤≥≠≈±×÷∂∆∇∈∉⊂⊆∪∩→←↔^_]|(?:d[xyzts]\b)"
BRACKETS = r"[()\[\]{}]"
CODE = r"(?:^|\s)(?:def|class|function)\s+[A-Za-z_$][\w$]*|(?:^|\s)(?:return|import|SELECT|FROM)\s+[^.!?]+|[{};].*[={}]"
MATHEMATICS = r"calculus|algebra|geometry|topology|analysis|derivative|integral|theorem|微积分|数学|代数|几何"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def document_class(sample: Column, name: Column, pages: Column, outline: Column, two_columns: Column, three_columns: Column, images: Column) -> Column:
    """struct(kind, score, confidence): the class of highest score, the first of equals. sample is the text, name the file's
    lower-case name; the last three are shares of pages with two columns, with three, and with several images."""
    at = {"low": F.lower(sample), "sample": sample, "head": F.concat(name, F.lit("\n"), F.substring(sample, 1, 5000))}
    more = {
        "academic-paper": F.when(outline > 3, 2).otherwise(0),
        "research-report": F.lit(0),
        "newspaper": two_columns * 5,
        "magazine": three_columns * 6 + images * 2,
        "book": F.when(pages >= 180, 5).otherwise(0) + F.when(outline >= 20, 5).otherwise(0),
    }
    score = lambda k: (_count(at[KEYWORDS[k][0]], KEYWORDS[k][1]) * KEYWORDS[k][2] + F.when(name.rlike(NAMES[k][0]), NAMES[k][1]).otherwise(0) + more[k]).cast("double")
    every = [F.struct(score(k).alias("score"), F.lit(-i).alias("ord"), F.lit(k).alias("kind")) for i, k in enumerate(KEYWORDS)]
    best = F.array_max(F.array(*every, F.struct(F.lit(1.0).alias("score"), F.lit(-len(KEYWORDS)).alias("ord"), F.lit("generic").alias("kind"))))
    s = best["score"]
    return F.struct(best["kind"].alias("kind"), s.alias("score"), F.least(F.lit(0.98), F.greatest(F.lit(0.45), s / (s + 7))).alias("confidence"))


def subject(sample: Column, name: Column) -> Column:
    return F.when(F.concat_ws("\n", name, F.lower(sample)).rlike(MATHEMATICS), "mathematics").otherwise("general")


def code_like(text: Column) -> Column:
    return (_count(text, WORD) <= 24) & text.rlike(CODE)


def scientific(text: Column) -> Column:
    """A formula, by number and density of its symbols, or code: such blocks are not translated."""
    sym, words = _count(text, MATH), _count(text, WORD)
    mass = sym * 2 + _count(text, BRACKETS) + _count(text, "[0-9]")
    return ((sym >= 2) & ((words <= 12) | (mass / F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"\s+", ""))) >= 0.24))) | code_like(text)
