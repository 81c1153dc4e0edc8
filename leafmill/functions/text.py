"""Column functions on text: normalising, folding, tokens, and small derived values. All but `nfc` stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of any script.
SPACES = r"[\x{0009}-\x{000D}\p{Z}]+"
#: Those of them that aren't one space already: a space by itself is not matched, and so not copied.
_UNEVEN = r"[\x{0009}-\x{000D}\p{Z}&&[^ ]][\x{0009}-\x{000D}\p{Z}]*| [\x{0009}-\x{000D}\p{Z}]+"

# Words that carry no content, for English and Spanish together.
STOPWORDS = tuple(
    "a an the and or of in on at to for from with by is are was were be been this that these those it its as what which who where when why how does do did about "
    "el la los las un una unos unas de del al y o en por para con sin es son fue era ser como que quien donde cuando cual cuales sobre se su sus me mi lo le les este esta estos estas".split()
)


def _map_of_accents(keep: str = "") -> tuple[str, str]:
    """Precomposed Latin letters and, letter by letter, what is left of them without marks; those in keep stay."""
    pairs = []
    for code in range(0xC0, 0x250):
        letter = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if len(letter) == 1 and len(base) == 1 and base != letter and letter not in keep:
            pairs.append((letter, base))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ALL, _KEEPING = _map_of_accents(), _map_of_accents("ñ")


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed characters. Only texts with marks or single jamo reach Python; the others pass it as nulls."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[\p{M}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}]"), text)), text)


def clean_text(text: Column, compose: bool = True) -> Column:
    """Without soft hyphens, with single spaces inside and none around."""
    out = F.regexp_replace(nfc(text) if compose else text, "\u00ad", "")
    return F.trim(F.regexp_replace(out, _UNEVEN, " "))


def fold_keep_enye(text: Column) -> Column:
    """Lower case without accents; ñ stays a letter of its own. Keeps the length of composed text."""
    return F.regexp_replace(F.translate(F.lower(text), *_KEEPING), r"\p{M}", "")


def fold_all(text: Column) -> Column:
    """Lower case without accents; ñ becomes n."""
    return F.regexp_replace(F.translate(F.lower(text), *_ALL), r"\p{M}", "")


def tokens(text: Column, folded: bool = False) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(text if folded else fold_keep_enye(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def content_terms(found: Column, stopwords: Iterable[str] = STOPWORDS, least: int = 1) -> Column:
    """Tokens that are no stopwords and have at least so many letters."""
    stop = tuple(stopwords)
    return F.filter(found, lambda t: ~t.isin(*stop) & (F.length(t) >= least))


def dehyphenate(text: Column) -> Column:
    """Joins words that a line break cuts between two lower-case letters."""
    return F.regexp_replace(text, r"(?<=\p{Ll})-[ \t]*\n[ \t\n]*(?=\p{Ll})", "")


def normalize_margin(line: Column) -> Column:
    """A line as a margin is compared: clean, lower case, digits as #."""
    return F.regexp_replace(F.lower(clean_text(line, compose=False)), r"[0-9]+", "#")


def word_count(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def excerpt(sentences: Column, first: int = 2, most: int = 600) -> Column:
    return F.substring(F.array_join(F.slice(sentences, 1, first), " "), 1, most)


def reading_minutes(words: Column, language: Column) -> Column:
    """An estimate: 160 words a minute in Spanish, 170 else."""
    return F.round(words / F.when(language == "es", 160).otherwise(170), 2)


def language_code(tag: Column, supported: Iterable[str] = ("en", "es", "fr", "de")) -> Column:
    """The language of a tag such as es-ES; en for none; null if it isn't supported."""
    code = F.split(F.translate(F.lower(F.trim(F.coalesce(tag, F.lit("")))), "_", "-"), "-")[0]
    return F.when(code == "", "en").when(code.isin(*supported), code)


def citation(section: Column, sentence: Column) -> Column:
    return F.format_string("%04d-%05d", section, sentence)


def anchor(explicit: Column, source: Column, sentence: Column) -> Column:
    return F.coalesce(explicit, F.concat(F.coalesce(source, F.lit("")), F.lit("#sentence="), sentence.cast("string")))


def resolve_cascade(speaker: Column, cast: Column, default: Column) -> Column:
    """What a map says of the speaker, else the default."""
    return F.coalesce(F.try_element_at(cast, F.coalesce(speaker, F.lit("Narrator"))), default)


def signature(*parts: Column) -> Column:
    """A digest of parts in order; a null part differs from an empty one."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def ordinal(numeral: Column) -> Column:
    """The value of decimal digits or of a Roman numeral in lower case; null for anything else."""
    value = F.create_map(*[F.lit(x) for pair in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair])
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("next"))

    def step(done: Column, letter: Column) -> Column:
        v = F.try_element_at(value, letter)
        return F.struct((done["sum"] + F.when(v < done["next"], -v).otherwise(v)).alias("sum"), v.alias("next"))

    roman = F.aggregate(F.split(F.reverse(numeral), ""), zero, step, lambda done: done["sum"])
    return F.when(numeral.rlike("^[0-9]{1,9}$"), numeral.try_cast("int")).when(numeral.rlike("^[ivxlcdm]+$"), roman)


# Words that a speech verb may follow and that name nobody.
NOBODY = ("The", "This", "That", "He", "She", "They", "El", "Ella", "Él", "Los", "La", "It", "I", "We", "You")


def clean_name(name: Column) -> Column:
    """A name without dashes, quotes and end marks around it; null if it is empty, a pronoun or article, or too long."""
    out = F.trim(F.regexp_replace(F.regexp_replace(name, r"^[ \t\n—–\"“«]+", ""), r"[ \t\n”».,:;!?\"]+$", ""))
    return F.when((out != "") & (F.length(out) <= 50) & ~out.isin(*NOBODY), out)


def highlight_parts(text: Column, wanted: Column) -> Column:
    """(text, match) parts of the text: where the folded text holds the folded, non-empty wanted string, and between.

    Folding keeps the length of composed text, so places in one are places in the other.
    """
    low, find = F.translate(F.lower(text), *_ALL), F.translate(F.lower(wanted), *_ALL)
    n = F.length(find)
    bits = F.split(low, F.concat(F.lit("\\Q"), find, F.lit("\\E")), -1)
    kind = "struct<at:int,parts:array<struct<text:string,match:boolean>>>"
    zero = F.struct(F.lit(1).alias("at"), F.array().alias("parts")).cast(kind)

    def step(done: Column, bit: Column) -> Column:
        at, size = done["at"], F.length(bit)
        plain = F.struct(text.substr(at, size).alias("text"), F.lit(False).alias("match"))
        hit = F.struct(text.substr(at + size, n).alias("text"), F.lit(True).alias("match"))
        return F.struct((at + size + n).alias("at"), F.concat(done["parts"], F.array(plain, hit)).alias("parts")).cast(kind)

    parts = F.filter(F.aggregate(bits, zero, step, lambda d: d["parts"]), lambda p: F.length(p["text"]) > 0)
    return F.when((n > 0) & F.contains(low, find), parts).otherwise(F.array(F.struct(text.alias("text"), F.lit(False).alias("match"))))
