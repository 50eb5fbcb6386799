"""Text functions, each from a Column to a Column and, but for token positions, made of built-in functions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
LATIN = r"A-Za-zÀ-ÖØ-öø-ÿĀ-ɏʰ-˿Ḁ-ỿ"
AYN, HAMZA = "ʿ", "ʾ"

# Transliteration characters and what they are matched as. Characters without an entry lose their marks.
CONVERSIONS = {
    "ʿ": "ʿ",
    "ā": "a",
    "ē": "e",
    "ī": "i",
    "ō": "o",
    "ū": "u",
    "á": "a",
    "é": "e",
    "è": "e",
    "ç": "c",
    "ǧ": "gh",
    "ḏ": "dh",
    "ḥ": "h",
    "ḫ": "kh",
    "ḳ": "q",
    "ṃ": "m",
    "ṅ": "n",
    "ṭ": "t",
    "ẓ": "z",
    "š": "sh",
    "ṛ": "r",
}

# Template texts that mark a metadata value as not filled in.
PLACEHOLDERS = (
    "Fulān",
    "permalink",
    "@id",
    "URIs from Althurayya",
    "YEAR-MON-DA",
    "YYYY-MM-DD",
    "src@keyword",
    "URI of a book from OpenITI",
    "AUTH_URI from OpenITI",
    "the name of the annotator",
    "Kitāb al-Muʾallif",
    "Risālaŧ al-Muʾallif",
    "Fars_RE_Auto",
    "comma separated",
    "abbreviation for relation",
)

# Roles written after a name.
ROLES = ("Auteur du texte", "Copiste", "Ancien possesseur", "Traducteur", "Enlumineur", "Relieur", "Annotateur", "Libraire", "Destinataire")


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def has_arabic(x: Column) -> Column:
    return x.rlike(f"[{ARABIC}]")


def has_latin(x: Column) -> Column:
    return x.rlike("[A-Za-z]")


def script(x: Column) -> Column:
    """``ara`` if any Arabic character occurs, else ``lat``."""
    return F.when(has_arabic(x), "ara").otherwise("lat")


def split_scripts(values: Column) -> tuple[Column, Column]:
    """The Latin and the Arabic values of an array; mixed ones are Arabic."""
    return F.filter(values, lambda x: ~has_arabic(x)), F.filter(values, has_arabic)


def tokens_lat(x: Column, keep_abbrev_dots: bool = False) -> Column:
    """Lower-case runs of Latin letters or of digits, of two characters at least; on request, ``L.`` abbreviations."""
    if keep_abbrev_dots:
        # The first alternative that fits at a place wins.
        found = F.regexp_extract_all(F.lower(x), F.lit(rf"[{LATIN}]{{1,4}}\.(?![{LATIN}])|[{LATIN}]+|\p{{Nd}}+"), F.lit(0))
    else:
        found = F.regexp_extract_all(F.lower(x), F.lit(rf"[{LATIN}]+|\p{{Nd}}+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def tokens_ara(x: Column) -> Column:
    """Runs of Arabic characters, or of digits of two at least."""
    found = F.regexp_extract_all(x, F.lit(rf"[{ARABIC}]+|\p{{Nd}}+"), F.lit(0))
    return F.filter(found, lambda t: ~t.rlike(r"^\p{Nd}") | (F.length(t) >= 2))


#: Spans that are turned into one Arrow array at a time.
SPANS = 100_000


def spans_in(text: str, kind: str = "lat", keep_abbrev_dots: bool = False) -> list[tuple[int, int]]:
    """Where the tokens of a text begin and end, in code points; a text of kind ``lat`` is in lower case already. In
    time that grows with the text, which a fold over its pieces in built-in functions doesn't offer: it copies the
    tokens so far at each step."""
    pattern = {"lat": (rf"[{LATIN}]{{1,4}}\.(?![{LATIN}])|" if keep_abbrev_dots else "") + rf"[{LATIN}]+|\d+", "ara": rf"[{ARABIC}]+|\d+"}[kind]
    found = (m.span() for m in re.finditer(pattern, text))
    if kind == "lat":
        return [(a, b) for a, b in found if b - a >= 2]
    return [(a, b) for a, b in found if b - a >= 2 or not text[a].isdecimal()]


def token_spans(x: Column, kind: str = "lat", keep_abbrev_dots: bool = False) -> Column:
    """Tokens with code point offsets: array<struct<token, start, end>>, by batches of texts."""

    def piece(texts: list[str | None], spans: list[list[tuple[int, int]]]) -> pa.Array:
        flat = [(t[a:b], a, b) for t, found in zip(texts, spans) for a, b in found]
        values = [pa.array([v[i] for v in flat], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32()))]
        ends = np.cumsum([0, *map(len, spans)]).tolist()
        starts = [None if t is None else at for t, at in zip(texts, ends)] + ends[-1:]
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(values, ["token", "start", "end"]))

    @F.arrow_udf("array<struct<token:string,start:int,end:int>>")
    def run(column: pa.Array) -> pa.Array:
        made, texts, spans, n = [], [], [], 0
        for text in column:
            texts.append(text.as_py())
            spans.append(spans_in(texts[-1] or "", kind, keep_abbrev_dots))
            n += len(spans[-1])
            if n >= SPANS:
                made.append(piece(texts, spans))
                texts, spans, n = [], [], 0
        return pa.concat_arrays([*made, piece(texts, spans)])

    return run(F.lower(x) if kind == "lat" else x)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined windows of n tokens; none if there are fewer."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def no_digits(tokens: Column) -> Column:
    """Tokens that aren't digits alone."""
    return F.filter(tokens, lambda t: ~t.rlike(r"^\p{Nd}+$"))


def split_camel(x: Column) -> Column:
    return F.split(x, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def one_ayn(x: Column) -> Column:
    """Four look-alikes of the letter ayn as one."""
    return F.translate(x, "ʻ‘ʼ`", AYN * 4)


def slug_tokens(x: Column) -> Column:
    """A slug's words: lower case, c for ayn."""
    return F.transform(split_camel(x), lambda t: F.replace(F.lower(t), F.lit("c"), F.lit(AYN)))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """From the Unicode database: characters that lose their marks one to one, those that vanish, and the rest."""
    one, gone, rest = [], [], []
    for cp in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)]:
        c = chr(cp)
        to = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
        if to != c:
            (one if len(to) == 1 else rest if to else gone).append((c, to))
    return "".join(c for c, _ in [*one, *gone]), "".join(to for _, to in one), tuple(rest)


def fold_accents(x: Column) -> Column:
    """Without combining marks."""
    source, target, rest = _folds()
    for c, to in rest:
        x = F.replace(x, F.lit(c), F.lit(to))
    return F.translate(x, source, target)


def _spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_transliteration(x: Column) -> Column:
    return _spaces(F.regexp_replace(F.lower(fold_accents(F.replace(x, F.lit("`"), F.lit(AYN)))), "-+", " "))


def convert(x: Column, table: dict[str, str] | None = None) -> Column:
    """Characters by the conversion table; those without an entry lose their marks, but Arabic letters stay."""
    table = CONVERSIONS if table is None else table
    for c, to in table.items():
        if len(to) != 1:
            x = F.replace(x, F.lit(c), F.lit(to))
    source, target, rest = _folds()
    pairs = [(c, to) for c, to in zip(source, target, strict=False) if c not in table and not "؀" <= c <= "ۿ"]
    gone = [c for c in source[len(target) :] if c not in table and not "؀" <= c <= "ۿ"]
    pairs += [(c, to) for c, to in table.items() if len(to) == 1 and c != to]
    for c, to in rest:
        x = F.replace(x, F.lit(c), F.lit(to))
    return _spaces(F.lower(F.translate(x, "".join([*[c for c, _ in pairs], *gone]), "".join(to for _, to in pairs))))


def normalize_for_matching(x: Column, camel: bool = False, is_corpus: bool = False, table: bool = True) -> Column:
    """The form in which names and titles are compared. is_corpus: years in slugs go, and c stands for ayn."""
    if is_corpus:
        x = F.regexp_replace(x, r"\p{Nd}{4}", "")
    if camel:
        x = F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")
    if is_corpus:
        x = F.translate(x, "Cc", AYN * 2)
    x = F.replace(x, F.lit(HAMZA), F.lit(""))
    return normalize_transliteration(convert(x) if table else x)


def legacy_normalize(x: Column, kind: str, strategy: str = "fuzzy") -> Column:
    """The older normalisation by script (``lat`` or ``ara``) and strategy (``fuzzy``, ``embedding`` or ``raw``)."""
    marks = "[ً-ٰٟـ]"
    made = {
        ("lat", "fuzzy"): lambda: fold_accents(one_ayn(F.replace(F.lower(x), F.lit("c"), F.lit("ayn")))),
        ("lat", "embedding"): lambda: F.lower(x),
        ("lat", "raw"): lambda: x,
        ("ara", "fuzzy"): lambda: F.when(x.rlike("[A-Za-z0-9]"), F.raise_error(F.lit("Latin or digits in an Arabic value"))).otherwise(F.regexp_replace(x, marks, "")),
        ("ara", "embedding"): lambda: fold_accents(x),
        ("ara", "raw"): lambda: x,
    }
    if (kind, strategy) not in made:
        raise ValueError(f"no such script or strategy: {kind}, {strategy}")
    return made[kind, strategy]()


def clean_creator(x: Column) -> Column:
    """A name without role, dates and trailing comma."""
    roles = "|".join(ROLES)
    x = F.regexp_replace(x, rf"(?i)\.\s*({roles})\s*$", "")
    x = F.regexp_replace(x, r"\s*\(\p{Nd}{3,4}\??(?:\s*[-–]\s*\p{Nd}{3,4}\??)?\)\s*", " ")
    return F.rtrim(F.trim(x), F.lit(","))


def date_range(x: Column) -> tuple[Column, Column]:
    """First and last year of ``1501`` or ``1501-1600`` at the start of a text; a single year is both."""
    first = F.nullif(F.regexp_extract(x, r"^(\d{4})", 1), F.lit("")).cast("int")
    last = F.nullif(F.regexp_extract(x, r"^\d{4}-(\d{4})", 1), F.lit("")).cast("int")
    return first, F.coalesce(last, first)


def shelfmark(x: Column) -> Column:
    return F.trim(F.element_at(F.split(x, r"\."), -1))


def metadata_parts(x: Column) -> Column:
    """Values of a field written with ``::`` or ``¶`` between them; the text itself if nothing is left."""
    parts = F.filter(F.transform(F.split(x, "::|¶"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(x))


def alias_parts(x: Column) -> Column:
    """Values written with ``||`` between them, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|\|"), lambda p: F.trim(p)), lambda p: p != ""))


def iso_year(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^\+*(\d+)", 1), F.lit("")).cast("int")


def title_parts(x: Column) -> Column:
    """Sentences of a title, without their last full stops."""
    return F.filter(F.transform(F.split(x, r"\. "), lambda p: F.rtrim(F.trim(p), F.lit("."))), lambda p: p != "")


def uri_parts(uri: Column) -> tuple[Column, Column, Column]:
    """Year of death, author slug and title slug of ``0685NasirDinBaydawi.AnwarTanzil``."""
    head = F.substring_index(uri, ".", 1)
    return F.nullif(F.regexp_extract(head, r"^(\d+)", 1), F.lit("")).cast("int"), F.nullif(F.regexp_extract(head, r"^\d+(.*)", 1), F.lit("")), F.get(F.split(uri, r"\."), F.lit(1))


def filled_in(x: Column) -> Column:
    """The trimmed value, null if it is blank or holds a template text."""
    pattern = "|".join(f"\\Q{p}\\E" for p in PLACEHOLDERS)
    return F.when(x.rlike(pattern), F.lit(None)).otherwise(blank_to_null(x))


def repair_c1(x: Column) -> Column:
    """Two letters that were read as control characters."""
    return F.translate(x, "\u008a\u009a", "Šš")
