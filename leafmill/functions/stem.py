"""Stems of English and Spanish words, by cutting suffixes. Applied to the distinct words of a table, then joined back."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes by language, the longest that fits goes first; what takes their place stands behind the colon.
SUFFIXES = {
    "en": "ational:ate tional:tion ization:ize fulness:ful ousness:ous iveness:ive biliti:ble entli:ent ations:ate ation:ate ness: ment: ments: ingly: edly: ings: ing: ies:y ied:y ers:er est: ly: ed: es: s:".split(),
    "es": "amientos: imientos: amiento: imiento: aciones: uciones:u adoras: adores: ancias: mente: ación: ución:u adora: ador: ancia: idades: idad: ivas: ivos: iva: ivo: ando: iendo: aron: ieron: aban: aba: ados: adas: idos: idas: ado: ada: ido: ida: ar: er: ir: os: as: es: a: o: e:".split(),
}
_VOWEL = re.compile("[aeiouyáéíóúü]")


def stem(word: str, language: str) -> str:
    """The word without its suffix, if three letters with a vowel are left."""
    for rule in SUFFIXES.get(language, SUFFIXES["en"]):
        end, _, put = rule.partition(":")
        base = word[: len(word) - len(end)]
        if word.endswith(end) and len(base) >= 3 and _VOWEL.search(base) and not (end == "s" and base.endswith(("s", "u", "i"))):
            if end in ("ing", "ed") and len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz":
                base = base[:-1]
            return base + put
    return word


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else stem(w, lang or "en") for w, lang in zip(words, languages, strict=True)])


def with_stems(words: DataFrame, word: str = "term", language: Column | str = "en") -> DataFrame:
    """words with a column stem. Each distinct pair of word and language is stemmed once."""
    lang = F.lit(language) if isinstance(language, str) else language
    tagged = words.withColumn("_language", lang)
    vocabulary = tagged.select(word, "_language").distinct().withColumn("stem", _stems(F.col(word), F.col("_language")))
    return tagged.join(vocabulary, [word, "_language"]).drop("_language")
