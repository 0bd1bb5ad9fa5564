"""Text normalisation and script tests as Column builders (all JVM-side unless said otherwise)."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Hyphen and middle-dot variants that count as a space in spellings.
HYPHENS = "-‐‑‒–—⁃・·"
# Characters dropped when names are compared.
MATCH_DROPS = " \t\n\r·・-‐‑–—_.,'\"’‘“”()[]"
# Zero-width and direction marks.
INVISIBLE = "[​-‏‪-‮⁠﻿]"
LONE_JAMO = "[ᄀ-ᇿ㄰-㆏]"
SYLLABLE = "[가-힣]"
# Endings that show a phrase rather than a name.
PARTICLE_TAILS = ["하게", "하다", "이다", "였다", "었다", "있다", "없다", "린다", "한다", "하는", "이라", "라고", "에서", "으로", "처럼", "보다", "까지", "부터", "께서", "에게", "한테", "이며", "거나", "지만", "는데", "ㅂ니다", "습니다", "해줘", "추천해줘", "알려줘", "검색해줘", "찾아줘", "보여줘", "정리해줘", "주세요", "해주세요", "하세요", "할래", "을까요", "ㄹ까요"]
# Neighbouring keys.
KEY_RUNS = ["qwer", "wert", "erty", "rtyu", "tyui", "yuio", "uiop", "asdf", "sdfg", "dfgh", "fghj", "ghjk", "hjkl", "zxcv", "xcvb", "cvbn", "vbnm", "poiu", "lkjh", "mnbv", "abcd", "1234", "2345", "3456", "4567", "5678", "6789", "7890", "0987"]
# Particles that may follow a short name.
PARTICLES = ["은", "는", "이", "가", "을", "를", "와", "과", "의", "에", "에서", "에게", "한테", "도", "로", "으로", "만", "까지", "부터", "보다", "처럼", "랑", "이랑"]

# Particles and forms of address that may follow a term in its context.
CONTEXT_PARTICLES = ["이", "가", "은", "는", "을", "를", "과", "와", "의", "도", "만", "에", "에서", "로", "으로", "에게", "한테", "께서", "처럼", "보다", "부터", "까지", "씨", "님"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def blank_to_null(c: Column) -> Column:
    """Blank and null are equal everywhere: both become null."""
    return F.nullif(F.trim(c), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s 　]+", " "))


@pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@pandas_udf(ArrayType(StringType()))
def nfc_each(values: pd.Series) -> pd.Series:
    """Composed forms of the strings of an array."""
    return values.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFC", x) for x in xs])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nfc(c: Column) -> Column:
    """Composed form. Only values with combining marks or conjoining jamo reach Python."""
    return F.when(c.rlike("[\\p{M}ᄀ-ᇿ]"), _nfc(c)).otherwise(c)


def spelling(c: Column) -> Column:
    """Spelling for consensus: composed, hyphen variants as spaces, lower case, white space squeezed."""
    return squeeze(F.lower(F.translate(nfc(c), HYPHENS, " " * len(HYPHENS))))


def key_unicode(c: Column) -> Column:
    """Identity key: lower case without white space and Unicode punctuation; symbols such as + stay."""
    return key_composed(nfc(c))


def key_composed(c: Column) -> Column:
    """``key_unicode`` of a value already composed: for use inside lambdas, where Python cannot be called."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s 　\p{P}]", "")


def key_posix(c: Column) -> Column:
    """Identity key: lower case without white space and ASCII punctuation and symbols."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\p{Space}\p{Punct}]+", "")


def key_posix_dot(c: Column) -> Column:
    """As ``key_posix``, without the middle dot too."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\p{Space}\p{Punct}·]+", "")


def key_cluster(c: Column) -> Column:
    """Cluster key: lower case without white space and quotes."""
    return F.regexp_replace(F.lower(c), "[\\s'\"`‘’“”]+", "")


def key_match(c: Column) -> Column:
    """Comparison key: lower case without a fixed list of separators."""
    return F.translate(F.lower(c), MATCH_DROPS, "")


def quote_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[\\s'\"‘’“”]+", "")


def quote_grounded(quote: Column, text: Column, least: int = 10) -> Column:
    """Whether a quote of at least ``least`` characters occurs in a text."""
    return (F.length(quote_key(quote)) >= least) & F.contains(quote_key(text), quote_key(quote))


def name_variants(c: Column) -> Column:
    """The name, and what stands outside and inside its parentheses."""
    outside = F.trim(F.regexp_replace(c, r"\([^)]*\)", ""))
    inside = F.trim(F.regexp_extract(c, r"\(([^)]*)\)", 1))
    return F.filter(F.array_distinct(F.array(F.trim(c), outside, inside)), lambda x: x != "")


def has_invisible(c: Column) -> Column:
    return c.rlike(INVISIBLE)


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def valid_for_locale(c: Column, locale: Column, trad_only: str = "", simp_only: str = "") -> Column:
    """Whether a spelling's scripts fit a locale. The variant character sets are parameters."""
    hangul, han, kana, latin = c.rlike(SYLLABLE), c.rlike(r"\p{IsHan}"), c.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), c.rlike(r"\p{IsLatin}")
    holds = lambda chars: c.rlike(f"[{chars}]") if chars else F.lit(False)
    fits = (
        F.when(locale == "ko", ~kana & (~han | hangul))
        .when(locale == "zh", ~hangul & ~kana & ~holds(trad_only) & (han | latin))
        .when(locale == "zh-hant", ~hangul & ~kana & ~holds(simp_only) & (han | latin))
        .when(locale == "ja", ~hangul & (han | kana | latin))
        .when(locale.isin("en", "vi", "es", "id", "pt-br"), ~hangul & ~han & ~kana)
        .otherwise(F.lit(True))
    )
    return (F.trim(c) != "") & ~has_invisible(c) & fits


def holds_any(c: Column, chars: str) -> Column:
    """Whether a value holds one of some characters (variant sets are parameters)."""
    return c.rlike(f"[{chars}]") if chars else F.lit(False)


def convert_variants(c: Column, only: str, table: dict[str, str], keep: str = "") -> Column:
    """struct(value, ok): characters replaced by ``table``; not ok if one of ``only`` has no entry and is not in ``keep``."""
    value = F.translate(c, "".join(table), "".join(table.values()))
    left = "".join(x for x in only if x not in table and x not in keep)
    return F.struct(value.alias("value"), (~holds_any(c, left)).alias("ok"))


def restore_names(source: Column, converted: Column, names: dict[str, str]) -> Column:
    """Put back proper nouns that the source held and a conversion changed: {kept: converted}."""
    out = converted
    for kept, changed in names.items():
        out = F.when(F.contains(source, F.lit(kept)), F.replace(out, F.lit(changed), F.lit(kept))).otherwise(out)
    return out


def lone_jamo_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(LONE_JAMO))


def strip_lone_jamo(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, LONE_JAMO, ""))


def clean_korean(c: Column) -> Column:
    """No lone jamo, control or private-use characters."""
    return ~c.rlike("[ᄀ-ᇿ㄰-㆏\\p{Cc}-]")


def paren_latin_name(c: Column) -> Column:
    """The one Latin name in parentheses, if there is exactly one."""
    found = F.regexp_extract_all(c, F.lit(r"\(([A-Za-z][A-Za-z .'&-]*)\)"), 1)
    return F.when(F.size(found) == 1, F.trim(F.element_at(found, 1)))


def prefix_latin_name(c: Column) -> Column:
    """The Latin name before a parenthesised gloss in Hangul."""
    return F.nullif(F.trim(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9 .'&-]*)\([^)]*[가-힣][^)]*\)$", 1)), F.lit(""))


def strip_annotation(c: Column, words: list[str]) -> Column:
    """Drop a trailing parenthesis whose content is one of some source words."""
    inside = F.lower(F.trim(F.regexp_extract(c, r"\(([^()]*)\)\s*$", 1)))
    return F.when(inside.isin(*words), F.trim(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", ""))).otherwise(c)


def context_spelling(term: Column, context: Column) -> Column:
    """The foreign form in parentheses right behind a term in a context."""
    pattern = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit("\\E\\s*[(（]([^()（）가-힣]{1,80})[)）]"))
    return F.nullif(F.trim(F.call_function("regexp_extract", context, pattern, F.lit(1))), F.lit(""))


@pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else html.unescape(s))


def strip_tags(c: Column) -> Column:
    """Text without tags, white space squeezed; entities stay."""
    return squeeze(F.regexp_replace(c, r"<[^>]*>", " "))


def clean_html(c: Column) -> Column:
    """Text without tags and entities. Only values with an ampersand reach Python."""
    bare = F.regexp_replace(c, r"<[^>]*>", " ")
    return squeeze(F.when(F.contains(bare, F.lit("&")), _unescape(bare)).otherwise(bare))


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters within some bytes."""
    cut = F.substring(F.encode(c, "utf-8"), 1, most)
    # Trailing bytes of a character cut in two, dropped in hexadecimal where bytes can be matched.
    whole = F.regexp_replace(F.hex(cut), "^((?:..)*?)(?:C.|D.|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", "$1")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.unhex(whole), "utf-8"))


def looks_like_mash(c: Column) -> Column:
    """Neighbouring keys, or seven consonants in a row."""
    low = F.lower(c)
    return low.rlike("|".join(KEY_RUNS)) | low.rlike("[bcdfghjklmnpqrstvwxz]{7}")


def is_abbreviation(hint: Column, full: Column) -> Column:
    """Whether a hint is a prefix of a name, its words' initials, or its prefix without spaces."""
    words = F.filter(F.split(F.trim(full), r"\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
    bare, short = F.replace(full, F.lit(" "), F.lit("")), F.replace(hint, F.lit(" "), F.lit(""))
    spaced = F.startswith(initials, hint) | (F.startswith(bare, short) & (F.length(bare) > F.length(short)))
    plain = F.startswith(full, hint) & (F.length(full) > F.length(hint))
    return F.when(F.contains(full, F.lit(" ")), (F.size(words) >= 2) & spaced).otherwise(plain)


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; of a shorter value the value itself."""
    short = F.length(c) < n
    return F.when(short, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each padded with two spaces before and one behind."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def contains_word(text: Column, word: Column) -> Column:
    """Whether a word occurs with no Hangul syllable on either side; the cheap test comes first."""
    quoted = F.concat(F.lit("(?<![가-힣])\\Q"), F.replace(word, F.lit("\\E"), F.lit("")), F.lit("\\E(?![가-힣])"))
    return (word != "") & F.contains(text, word) & F.rlike(text, quoted)


def mention_pattern(term: Column) -> Column:
    """A pattern for a term, in any case, at a word start, and before a word end or a particle."""
    behind = f"(?=$|[^\\p{{L}}\\p{{Nd}}]|{'|'.join(CONTEXT_PARTICLES)})"
    return F.concat(F.lit("(?iu)(?<![\\p{L}\\p{Nd}])\\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit(f"\\E{behind}"))


def mentions(text: Column, term: Column) -> Column:
    """Whether a term occurs in a text at a word start, followed by a word end or a particle."""
    return (term != "") & F.contains(F.lower(text), F.lower(term)) & F.rlike(text, mention_pattern(term))


def mention_window(text: Column, term: Column, radius: int = 32) -> Column:
    """The first mention of a term with the characters around it; empty without one."""
    pattern = F.concat(F.lit(f"(?s).{{0,{radius}}}?"), mention_pattern(term), F.lit(f".{{0,{radius}}}"))
    return F.when(mentions(text, term), F.call_function("regexp_extract", text, pattern, F.lit(0))).otherwise("")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def on_domain(url: Column, domain: Column) -> Column:
    """Whether a URL's host is a domain or below it."""
    host, base = url_host(url), F.regexp_replace(F.lower(F.trim(domain)), "^www\\.", "")
    return (base != "") & ((host == base) | F.endswith(host, F.concat(F.lit("."), base)))


def trusted_domain(url: Column, domains: list[str]) -> Column:
    """The first of some domains that a URL is on."""
    return F.coalesce(*[F.when(on_domain(url, F.lit(d)), F.lit(d)) for d in domains], F.lit(None).cast("string"))


def valid_source_url(c: Column) -> Column:
    """A web address with a public host and no user information."""
    host = url_host(c)
    return c.rlike("^(?i)https?://") & ~c.rlike("^[^/]*//[^/?#]*@") & F.contains(host, F.lit(".")) & ~host.rlike(r"^(localhost|.*\.localhost|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\.0\.0\.0|169\.254\..*)$")


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s\p{P}]+", "")


def sequence_markers(c: Column) -> Column:
    """The numbers in a title."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1))


def markers_covered(ours: Column, theirs: Column) -> Column:
    """Whether every number of our title occurs in theirs."""
    return F.size(F.array_except(sequence_markers(ours), sequence_markers(theirs))) == 0


def qualifier(c: Column) -> Column:
    """Disambiguator: no outer parentheses, squeezed, 100 characters at most, blank as null."""
    bare = F.regexp_replace(F.trim(c), r"^\(+|\)+$", "")
    return F.nullif(F.left(squeeze(bare), F.lit(100)), F.lit(""))


def locale_code(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))


def mask_personal(c: Column, most: int = 120) -> Column:
    """A log-safe preview: mail addresses, long numbers and line ends masked, cut short."""
    safe = F.regexp_replace(c, r"[\w.+-]+@[\w-]+\.[\w.]+", "[mail]")
    return F.left(squeeze(F.regexp_replace(safe, r"\d[\d -]{6,}\d", "[number]")), F.lit(most))


def phrase_in_segment(notes: Column, marker: str, phrases: list[str]) -> Column:
    """Whether one of some phrases stands in the part of the notes behind a marker, up to the next bracket."""
    behind = F.when(F.contains(notes, F.lit(marker)), F.substring_index(notes, marker, -1))
    segment = F.substring_index(behind, "[", 1)
    return F.coalesce(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(segment, p)), F.lit(False))


def not_tombstone(status: Column, notes: Column, marker: str, exempt: list[str], dead: str = "rejected") -> Column:
    """Whether a row may be asked for again: not rejected, or rejected for a reason that does not last."""
    return ~(status == dead) | phrase_in_segment(notes, marker, exempt)


# The sound that each initial stands for; the lax ones are voiced inside a word.
ONSETS = {
    "ㄱ": "K", "ㄲ": "K", "ㄴ": "N", "ㄷ": "T", "ㄸ": "T", "ㄹ": "R", "ㅁ": "M", "ㅂ": "P", "ㅃ": "P", "ㅅ": "S",
    "ㅆ": "S", "ㅇ": "", "ㅈ": "CH", "ㅉ": "CH", "ㅊ": "CH", "ㅋ": "K", "ㅌ": "T", "ㅍ": "P", "ㅎ": "H",
}
VOICED = {"ㄱ": "G", "ㄷ": "D", "ㅂ": "B", "ㅈ": "J"}
# Each vowel as a glide and a vowel of the five that katakana has; EU is the unrounded one.
VOWELS = {
    "ㅏ": ("", "A"), "ㅐ": ("", "E"), "ㅑ": ("Y", "A"), "ㅒ": ("Y", "E"), "ㅓ": ("", "O"), "ㅔ": ("", "E"), "ㅕ": ("Y", "O"),
    "ㅖ": ("Y", "E"), "ㅗ": ("", "O"), "ㅘ": ("W", "A"), "ㅙ": ("W", "E"), "ㅚ": ("W", "E"), "ㅛ": ("Y", "O"), "ㅜ": ("", "U"),
    "ㅝ": ("W", "O"), "ㅞ": ("W", "E"), "ㅟ": ("W", "I"), "ㅠ": ("Y", "U"), "ㅡ": ("", "EU"), "ㅢ": ("EU", "I"), "ㅣ": ("", "I"),
}
# The katakana of the sounds that finals are pronounced as, and the finals pronounced so.
CODAS = {"": ["", "ㅎ"], "ク": ["ㄱ", "ㄲ", "ㄳ", "ㄺ", "ㅋ"], "ン": ["ㄴ", "ㄵ", "ㄶ", "ㅇ"], "ッ": ["ㄷ", "ㅅ", "ㅆ", "ㅈ", "ㅊ", "ㅌ"], "ル": ["ㄹ", "ㄼ", "ㄽ", "ㄾ", "ㅀ"], "ム": ["ㄻ", "ㅁ"], "プ": ["ㄿ", "ㅂ", "ㅄ", "ㅍ"]}
# Surnames of one syllable, and of two.
SURNAMES = list("김이박최정강조윤장임한오서신권황안송전홍고문양손배백허유남심노하곽성차주우구나민진지엄채원천방공현함변염여추도소석선설마길연위표명기반라왕금옥육인맹제모탁국어은편용예경봉사부가복태목형계피감동")
LONG_SURNAMES = ["남궁", "황보", "선우", "제갈", "사공", "서문", "독고"]


def _letter(name: str) -> str:
    """A katakana letter by its sounds, as Unicode names it."""
    return unicodedata.lookup(f"KATAKANA LETTER {name}")


def _sounds(onset: str, glide: str, vowel: str, jamo: str) -> str:
    """Katakana of an onset, a glide and a vowel."""
    if not onset:
        if not glide:
            return _letter(vowel.removeprefix("E") if vowel == "EU" else vowel)
        if glide == "EU":
            return _letter("U") + _letter(vowel)
        if (glide, vowel) in {("Y", "A"), ("Y", "O"), ("Y", "U"), ("W", "A")}:
            return _letter(glide + vowel)
        return _letter("I" if glide == "Y" else "U") + _letter(f"SMALL {vowel}")
    if onset in ("CH", "J"):  # palatal: what follows is a small letter, but for i and what sounds like it
        stem = _letter("TI" if onset == "CH" else "ZI")
        if vowel in ("I", "EU"):
            return stem
        return stem + _letter("SMALL E" if vowel == "E" else f"SMALL Y{vowel}")
    if glide == "Y" and vowel != "E":
        # t and d have no palatal form; the small letter stands behind their plain one.
        return _letter(onset + ("A" if onset in ("T", "D") else "I")) + _letter(f"SMALL Y{vowel}")
    if glide == "W":
        if onset == "H" and jamo in ("ㅙ", "ㅚ"):
            vowel = "A"
        return _letter(f"{onset}U") + _letter(f"SMALL {vowel}")
    return _letter(onset + ("U" if vowel == "EU" else vowel))


@lru_cache(maxsize=1)
def syllable_kana() -> dict[str, tuple[str, str]]:
    """Every Hangul syllable in katakana: at the start of a surname, and elsewhere."""
    ending = {final: kana for kana, finals in CODAS.items() for final in finals}
    # The order in which Unicode counts finals is that of their jamo.
    finals = ["", *sorted(f for f in ending if f)]
    parts = itertools.product(ONSETS, VOWELS, finals)
    return {
        chr(0xAC00 + n): tuple(_sounds(sound, *VOWELS[vowel], vowel) + ending[final] for sound in (ONSETS[onset], VOICED.get(onset, ONSETS[onset])))
        for n, (onset, vowel, final) in enumerate(parts)
    }


_FULL_NAME = re.compile(f"(?:({'|'.join(LONG_SURNAMES)})(.+)|([{''.join(SURNAMES)}])(..+))", re.DOTALL)


def katakana_name(name: str | None) -> str | None:
    """A Hangul name in katakana: the surname apart, its first sound unvoiced."""
    if name is None:
        return None
    table = syllable_kana()
    words = name.split()
    family = len(words) > 1
    if len(words) == 1 and words[0] not in LONG_SURNAMES and (full := _FULL_NAME.fullmatch(words[0])):
        words, family = [part for part in full.groups() if part], True
    out = []
    for n, word in enumerate(words):
        named = n == 0 and (word[0] in SURNAMES or (not family and word[:2] in LONG_SURNAMES) or (len(words) > 1 and word in LONG_SURNAMES))
        out.append("".join(table.get(ch, (ch, ch))[0 if named and i == 0 else 1] for i, ch in enumerate(word)))
    return "・".join(out)


@pandas_udf(StringType())
def katakana(values: pd.Series) -> pd.Series:
    """Column form of ``katakana_name``: table-driven, so Arrow batches rather than expressions."""
    return values.map(katakana_name)
