"""Column functions on lyrics, titles and file names."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s  ]+"

# Censored words and what they stand for, and the rewrites of censored titles.
CENSORED = {
    "sh!t": "shit", "sh*t": "shit", "s#!t": "shit",
    "f*ck": "fuck", "f**k": "fuck", "f#ck": "fuck",
    "b!tch": "bitch", "b*tch": "bitch",
    "a$$": "ass", "d@mn": "damn", "h3ll": "hell",
}
TITLE_REWRITES = [
    (r"\bsh[!*#]+t\b", "shit"),
    (r"\bf[!*#]+ck\b", "fuck"),
    (r"\bf[!*#]+k\b", "fuck"),
    (r"\bb[!*#]+tch\b", "bitch"),
    (r"\ba\$\$\b", "ass"),
    (r"\bd[@4]mn\b", "damn"),
]
# Notes at the end of a video's title.
VIDEO_NOTES = r"(?:official\s+)?(?:music\s+)?video(?:\s+clip)?|(?:official\s+)?audio|lyrics?(?:\s+video)?|visuali[sz]er|(?:4k|hd|hq|remaster(?:ed)?(?:\s+\d{4})?)"
# ISO 639-3 codes by the codes that stand for them.
ISO3 = {
    "ru": "rus", "rus": "rus", "en": "eng", "eng": "eng", "uk": "ukr", "ukr": "ukr", "kk": "kaz", "kaz": "kaz", "de": "deu", "ger": "deu", "deu": "deu", "fr": "fra", "fre": "fra", "fra": "fra",
    "es": "spa", "spa": "spa", "it": "ita", "ita": "ita", "pl": "pol", "pol": "pol", "tr": "tur", "tur": "tur", "ar": "ara", "ara": "ara", "pt": "por", "por": "por",
    "be": "bel", "bel": "bel", "ro": "ron", "rum": "ron", "ron": "ron", "ja": "jpn", "jpn": "jpn", "ko": "kor", "kor": "kor", "zh": "zho", "chi": "zho", "zho": "zho",
}


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def norm_token(x: Column) -> Column:
    """Lower case, letters, digits and apostrophes only."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}']", "")


def artist_title(name: Column) -> tuple[Column, Column]:
    """Artist and title from a file name: cut at `(` and `_SkySound`, split at ` - ` or else `_-_`."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    clean = strip(F.substring_index(strip(F.substring_index(stem, "(", 1)), "_SkySound", 1))
    mark = F.when(F.contains(clean, F.lit(" - ")), " - ").when(F.contains(clean, F.lit("_-_")), "_-_")
    at = F.instr(clean, " - ")
    other = F.instr(clean, "_-_")
    cut = F.when(at > 0, at).otherwise(other)
    left = F.when(mark.isNull(), "").otherwise(strip(F.substring(clean, F.lit(1), cut - 1)))
    right = F.when(mark.isNull(), clean).otherwise(strip(F.substring(clean, cut + 3, F.length(clean))))
    return left, right


#: Strings of a batch that are Python objects at once.
SLICE = 256


def by_slices(f: Callable[[str], str], x: pa.Array) -> pa.Array:
    """f of each string, null of null; a batch of long texts is never whole in Python objects, which are several times larger."""
    told = [pa.array([None if s is None else f(s) for s in x.slice(i, SLICE).to_pylist()], pa.string()) for i in range(0, len(x), SLICE)]
    return pa.concat_arrays(told) if told else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def nfkc(x: pa.Array) -> pa.Array:
    return by_slices(_nfkc, x)


def _nfkc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFKC", s)


@F.arrow_udf(T.StringType())
def clean_romanized(x: pa.Array) -> pa.Array:
    """Quotes folded, accents dropped, a-z and apostrophes kept."""
    return by_slices(_letters, x)


def _letters(s: str) -> str:
    flat = unicodedata.normalize("NFKD", s.replace("’", "'").replace("`", "'").casefold())
    return "".join(c for c in flat if "a" <= c <= "z" or c == "'")


def search_text(x: Column, normal: bool = True) -> Column:
    """Apostrophes and dashes folded and white space collapsed, after NFKC unless the caller knows better."""
    base = nfkc(F.coalesce(x, F.lit(""))) if normal else F.coalesce(x, F.lit(""))
    return strip(F.regexp_replace(F.translate(base, "’–—", "'--"), SPACE, " "))


def deobfuscate_title(x: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, f"(?i){rule[0]}", rule[1]), TITLE_REWRITES, x)


def strip_notes(x: Column) -> Column:
    """Without the notes in brackets at the end, however many."""
    return strip(F.regexp_replace(strip(x), rf"(?i)(?:\s*[\[(](?:{VIDEO_NOTES})[\])]\s*)+$", ""))


def title_variants(x: Column, normal: bool = True) -> Column:
    """The title, without its notes, and uncensored: those that differ, in this order."""
    base = search_text(x, normal)
    edge = r"^[ \-–—|•]+|[ \-–—|•]+$"
    all_ = [F.regexp_replace(v, edge, "") for v in (base, strip_notes(base), deobfuscate_title(strip_notes(base)))]
    told = F.filter(F.array(*all_), lambda v: v != "")
    add = lambda seen, v: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(v)), seen).otherwise(F.concat(seen, F.array(v)))
    return F.aggregate(told, F.array().cast("array<string>"), add)


@F.arrow_udf(T.DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of matching characters; 0 if either is empty."""
    told = np.zeros(len(a))
    for i in range(0, len(a), SLICE):
        told[i : i + SLICE] = [SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.slice(i, SLICE).to_pylist(), b.slice(i, SLICE).to_pylist(), strict=True)]
    return pa.array(told)


def similarity(a: Column, b: Column) -> Column:
    flat = lambda x: strip(F.regexp_replace(F.lower(deobfuscate_title(search_text(x))), r"(?U)[^\w]+", " "))
    return ratio(flat(a), flat(b))


def sentences(x: Column) -> Column:
    """Lines, or, if there is one only, its sentences; without blank ones."""
    lines = F.filter(F.transform(F.split(x, r"\r\n|[\n\r]"), strip), lambda s: s != "")
    return F.when(F.size(lines) > 1, lines).otherwise(F.filter(F.transform(F.split(strip(x), r"(?<=[.!?…])\s+"), strip), lambda s: s != ""))


def deobfuscate_word(x: Column) -> Column:
    """Lower case; a censored word spelled out; signs that stand for letters replaced if there are letters too."""
    return _spelled_out(F.lower(nfkc(x)))


def _spelled_out(low: Column) -> Column:
    signs = F.regexp_replace(F.translate(low, "@$!", "asi"), "[#*]", "")
    known = F.create_map(*[F.lit(v) for kv in CENSORED.items() for v in kv])
    return F.coalesce(known[low], F.when(low.rlike(r"\p{L}") & low.rlike(r"[!@$#*]"), signs).otherwise(low))


def table_romanizer(table: dict[str, str]) -> Callable[[Column], Column]:
    """A romanizer for normalized_words from a table of words; others stay."""
    known = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return lambda words: F.transform(words, lambda w: F.coalesce(known[w], w))


def normalized_words(x: Column, romanizer: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<word, normalized>> of a text: words as they stand, and their letters a-z and apostrophes; "" where none is left.

    romanizer takes the array of lower-case words, spelled out, and gives one of the same length: a column expression or a pandas UDF.
    """
    words = tokens(x)
    low = F.transform(_each(lambda w: _nfkc(w).casefold())(words), _spelled_out)
    latin = _each(_letters)(romanizer(low) if romanizer else low)
    return F.zip_with(words, latin, lambda w, n: F.struct(w.alias("word"), n.alias("normalized")))


def _each(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """f of each string of arrays."""

    def run(words: pa.Array) -> pa.Array:
        ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, by_slices(f, words.flatten()), mask=words.is_null())

    return F.arrow_udf(run, T.ArrayType(T.StringType()))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def word_units(normalized: Column, word: Column | None = None) -> Column:
    """Pronunciation mass: letters, vowels a little more, at least 1; hundredths in whole numbers, so a mass is the double next to its decimals."""
    low = F.lower(F.coalesce(normalized, F.lit("")))
    if word is not None:
        low = F.when(low == "", F.regexp_replace(deobfuscate_word(word), "[^a-z0-9]+", "")).otherwise(low)
    return F.greatest(F.lit(1.0), (F.length(low) * 72 + F.regexp_count(low, F.lit("[aeiouy]")) * 28) / 100.0)


def iso3(x: Column) -> Column:
    """ISO 639-3 code of a language code; any three letters stand for themselves."""
    low = F.lower(strip(F.coalesce(x, F.lit(""))))
    known = F.create_map(*[F.lit(v) for kv in ISO3.items() for v in kv])
    return F.coalesce(known[low], F.when(F.length(low) == 3, low))


def separation_mode(x: Column, default: str = "auto") -> Column:
    """auto, on or off from what a form may send."""
    low = F.lower(strip(x))
    return F.when(low.isin("auto", "adaptive"), "auto").when(low.isin("1", "true", "yes", "on"), "on").when(low.isin("0", "false", "no", "off"), "off").otherwise(default)


def without_footer(x: Column) -> Column:
    """Lyrics before a provider's footer."""
    return strip(F.substring_index(F.substring_index(x, "\n\n*******", 1), "\n\n(Source:", 1))


def safe_name(x: Column) -> Column:
    """A file name without signs that file systems refuse."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r'[<>:"/\\|?*$`]', ""), r"[\x00-\x1f\x7f]", "")
    return strip(F.regexp_replace(clean, r"[. ]+$", ""))


def larger_cover(url: Column) -> Column:
    return F.replace(url, F.lit("100x100"), F.lit("600x600"))


def data_uri(image: Column, kind: str = "image/jpeg") -> Column:
    # Spark breaks long base64 into lines, which a URI may not hold
    return F.concat(F.lit(f"data:{kind};base64,"), F.replace(F.base64(image), F.lit("\r\n"), F.lit("")))


def allowed_upload(name: Column, text: Column, limit: int = 2 * 1024 * 1024) -> Column:
    """Whether a lyrics upload has a known extension and fits the limit."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin("lrc", "elrc", "txt") & (F.octet_length(text) <= limit)
