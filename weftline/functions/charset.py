"""The character set of bytes without a mark: what decodes without fault and then looks most like a language written in it."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The commonest characters of languages.
HAN = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都三小军二无同么经法当起与好看学进种将还分此心前面又定见只主没公从"
HAN_LONG = "的一是不了人我在有他這為之大來以個中上們到說國和地也子時道出而要於就下得可你年生自會那後能對著事其裡所去行過家十用發天如然作方成者多日都三小軍二無同麼經法當起與好看學進種將還分此心前面又定見只主沒公從"
HANGUL = "이다는을의에가고하지로한도사를은기나서라리어인아자시그대해있일정수보것들제만성주전으스부장상구국과여공우경원게면조"
CYRILLIC, GREEK = "оеаинтсрвлкмдпу", "αοιετσνηυρπκμλ"


def _han(common: str) -> Callable[[str, str], float]:
    known = set(common)
    return lambda c, _: 1.0 if c in known else 0.5 if "　" <= c <= "〠" or "＀" <= c <= "～" else 0.35 if "一" <= c <= "鿿" else 0.0 if "぀" <= c <= "ヿ" else -1.0


def _japanese(c: str, _: str) -> float:
    return 1.0 if "぀" <= c <= "ヿ" else 0.5 if "一" <= c <= "鿿" or "　" <= c <= "〠" or "＀" <= c <= "～" else -0.5 if "｡" <= c <= "ﾟ" else -1.0


def _korean(c: str, _: str) -> float:
    return 1.0 if c in HANGUL else 0.4 if "가" <= c <= "힣" else 0.3 if "　" <= c <= "〠" else 0.0 if "一" <= c <= "鿿" else -1.0


def _letters(common: str, first: str, last: str) -> Callable[[str, str], float]:
    def of(c: str, before: str) -> float:
        if not first <= c <= last:
            return 0.3 if c in "«»—–“”„…№’" else -1.0
        if before.isascii() and before.isalpha() or (c.isupper() and before.islower()):
            return -1.0  # one script to a word, capitals at its start
        if not first <= before <= last:
            return 0.5
        return 1.0 if c.lower() in common else 0.5

    return of


def _latin(c: str, before: str) -> float:
    if c.isalpha():
        return 0.8 if before.isascii() or not before.isalpha() else 0.4
    return 0.6 if c in "“”‘’–—…€«»°§£•„" else -0.3


# Character sets, in order of preference.
SETS: list[tuple[str, Callable[[str, str], float]]] = [
    ("shift_jis", _japanese), ("euc_jp", _japanese), ("gb18030", _han(HAN)), ("big5", _han(HAN_LONG)), ("euc_kr", _korean), ("cp1251", _letters(CYRILLIC, "Ѐ", "џ")), ("koi8_r", _letters(CYRILLIC, "Ѐ", "џ")),
    ("cp1253", _letters(GREEK, "Ͱ", "Ͽ")), ("cp1252", _latin),
]


def decoded(content: bytes) -> tuple[str, str]:
    """(character set, text); where no set fits, every byte is its own character."""
    best, found = float("-inf"), ("latin_1", None)
    for name, weight in SETS:
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        score, n, before = 0.0, 0, " "
        for m in re.finditer(r"[^\x00-\x7f]", text):
            at = m.start()
            before = text[at - 1] if at else " "
            score += weight(m.group(), before)
            n += 1
        doubt = 0 if name == "cp1252" else 1  # a character or two are more likely accents
        if n and score / (n + doubt) > best:
            best, found = score / (n + doubt), (name, text)
    return found if found[1] is not None else ("latin_1", content.decode("latin_1"))


def detected(content: Column) -> Column:
    """struct<charset, text> of bytes; null stays null, so only what needs it is given."""

    def run(data: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if d is None else decoded(bytes(d)) for d in data]
        return pd.DataFrame(rows, columns=["charset", "text"])

    return F.pandas_udf(run, "charset string, text string")(content)
