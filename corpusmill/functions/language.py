"""Language of a text by the function words it uses."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts shorter than this have no language, longer ones are judged by their first LOOK_AT characters. Fixed values.
LEAST_CHARS, LOOK_AT = 40, 5000

#: Frequent function words.
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the of and to in is that for with on by from it as are this every when which they its their has not".split()),
    "de": frozenset("der die das und ist nicht ein eine den dem mit von zu für auf sich wird im des als auch bei".split()),
    "fr": frozenset("le les des et une est dans pour que qui sur au du plus pas avec sont ce par aux nous cette".split()),
    "es": frozenset("el los las y una es con por para del se lo como más su pero está al son muy este".split()),
    "it": frozenset("il di che è per un una non sono con del della si alla nel gli più anche questo dei".split()),
    "pt": frozenset("o os uma não com para do da em dos que se mais por ao na no foi das seu".split()),
    "nl": frozenset("de het een van en in is dat niet op te zijn met voor aan er ook bij naar deze".split()),
    "pl": frozenset("i w na nie się że z do jest o jak po dla od przez oraz są przy tym ale".split()),
}
_WORD = re.compile(r"[^\W\d_]+")


def best_language(words: Iterable[str]) -> str | None:
    """The language with most function words among `words` (lower case); None when there is hardly any, ties in the order above."""
    words = list(words)
    counts = {k: sum(map(v.__contains__, words)) for k, v in FUNCTION_WORDS.items()}
    lang = max(counts, key=counts.get)
    return lang if counts[lang] * 25 >= len(words) > 0 else None


def detect(text: str | None) -> str | None:
    text = (text or "").strip()
    return best_language(_WORD.findall(text[:LOOK_AT].lower())) if len(text) >= LEAST_CHARS else None


def language(text: Column) -> Column:
    """Language code of a text, null where it is too short or unknown."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(detect)

    return udf(text)
