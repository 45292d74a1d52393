"""Addresses, languages, settings and times as column functions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), rf"[?&]{name}=([^&]*)", 1)
    return F.when(F.regexp_replace(url, "#.*$", "").rlike(rf"[?&]{name}(=|&|$)"), found)


def without_parameters(url: Column, names: tuple[str, ...]) -> Column:
    """url without the query parameters of these names, whatever their place."""
    any_ = "|".join(names)
    u = F.regexp_replace(url, rf"(?<=[?&])(?:{any_})(?:=[^&#]*)?(?:&|(?=#|$))", "")
    return F.regexp_replace(u, r"[?&](?=#|$)", "")


def track_id(url: Column) -> Column:
    """A caption track's address without what changes from request to request."""
    return without_parameters(url, ("fmt", "tlang", "pot"))


def track_kind(url: Column) -> Column:
    return F.when(F.coalesce(parameter(url, "kind"), F.lit("")) == "asr", "asr").otherwise("manual")


def track_language(url: Column) -> Column:
    return F.coalesce(parameter(url, "lang"), F.lit(""))


def track_request(url: Column, target: Column) -> Column:
    """The address that asks a track for JSON, in another language if there is a target."""
    base = without_parameters(url, ("tlang", "fmt"))
    joint = F.when(base.contains("?"), "&").otherwise("?")
    return F.concat(base, joint, F.lit("fmt=json3"), F.when(F.coalesce(target, F.lit("")) != "", F.concat(F.lit("&tlang="), target)).otherwise(""))


#: Codes of one language under several names, and those that a service uses for translations.
SCRIPTS = {"zh-cn": "zh-hans", "zh-sg": "zh-hans", "zh-my": "zh-hans", "zh-tw": "zh-hant", "zh-hk": "zh-hant", "zh-mo": "zh-hant", "in": "id", "iw": "he"}
TARGETS = {"zh-CN": "zh-Hans", "zh-TW": "zh-Hant"}
MODEL_CODES = {
    "ar": "arb_Arab", "en": "eng_Latn", "es": "spa_Latn", "fr": "fra_Latn", "de": "deu_Latn", "tr": "tur_Latn", "it": "ita_Latn", "pt": "por_Latn",
    "ru": "rus_Cyrl", "ja": "jpn_Jpan", "ko": "kor_Hang", "zh": "zho_Hans", "hi": "hin_Deva", "fa": "pes_Arab", "ur": "urd_Arab", "nl": "nld_Latn",
}
PROVIDERS = {"codex": "codex_subscription", "kimi": "kimi_subscription"}


def looked_up(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The table's entry for a value, or the default, or the value itself."""
    return F.coalesce(reduce(lambda c, kv: c.when(value == kv[0], kv[1]), table.items(), F.when(F.lit(False), "")), value if default is None else default)


def same_language(track: Column, target: Column) -> Column:
    """Whether translating a track into a language would change nothing. Chinese scripts differ; of others the base counts."""
    a, b = [looked_up(F.lower(F.coalesce(x, F.lit(""))), SCRIPTS) for x in (track, target)]
    base = lambda x: F.split_part(x, F.lit("-"), F.lit(1))
    return (a != "") & (b != "") & ((a == b) | ((base(a) == base(b)) & (base(a) != "zh")))


def caption_provider(asked: Column) -> Column:
    """The provider of translations that a setting names, under its full name."""
    return looked_up(asked, PROVIDERS)


VIDEO = r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/|/live/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])"


def video_id(value: Column) -> Column:
    """The id of a video from its address, or from the id itself; null if there is none."""
    found = F.when(value.rlike("^[A-Za-z0-9_-]{11}$"), value).otherwise(F.regexp_extract(value, VIDEO, 1))
    return F.nullif(found, F.lit(""))


def video_url(value: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(value))


#: Hosts that name this machine or its network (fixed values).
PRIVATE = r"^(?:localhost|.*\.(?:localhost|local|internal)|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|0\..*|\[.*\])$"


def safe_source(url: Column) -> Column:
    """Whether a media address may be fetched: https, no credentials, a public host."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#@]*?)(?::[0-9]+)?(?:[/?#]|$)", 1))
    return url.rlike(r"^https://[^/?#@]+(?:[/?#]|$)") & (host != "") & ~host.rlike(PRIVATE)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def clock(seconds: Column) -> Column:
    """[H:]M:SS of seconds, rounded down; below zero is zero."""
    s = F.greatest(F.floor(F.coalesce(seconds, F.lit(0.0))), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(r))).otherwise(F.concat_ws(":", m.cast("string"), _two(r)))


def stamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm of seconds, rounded half up to milliseconds; below zero is zero."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5).cast("long")
    return F.concat(_two(F.floor(ms / 3600000)), F.lit(":"), _two(F.floor(ms % 3600000 / 60000)), F.lit(":"), _two(F.floor(ms % 60000 / 1000)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def duration(ms: Column) -> Column:
    """Words for a duration: seconds below a minute, else minutes and seconds."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s")))


def affine(a: Column, b: Column) -> Column:
    """The product of two affine transforms [a, b, c, d, e, f]."""
    x, y = (lambda i: F.get(a, F.lit(i))), (lambda i: F.get(b, F.lit(i)))
    return F.array(x(0) * y(0) + x(2) * y(1), x(1) * y(0) + x(3) * y(1), x(0) * y(2) + x(2) * y(3), x(1) * y(2) + x(3) * y(3), x(0) * y(4) + x(2) * y(5) + x(4), x(1) * y(4) + x(3) * y(5) + x(5))


def inverse(a: Column) -> Column:
    """The inverse of an affine transform; null if there is none."""
    x = lambda i: F.get(a, F.lit(i))
    d = x(0) * x(3) - x(1) * x(2)
    return F.when(d != 0, F.array(x(3) / d, -x(1) / d, -x(2) / d, x(0) / d, (x(2) * x(5) - x(3) * x(4)) / d, (x(1) * x(4) - x(0) * x(5)) / d))
