"""Letters of Hangul syllables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The initial, medial and final letters in the order of the Unicode syllable block.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
FIRST, COUNT = 0xAC00, 11172


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _index(c: Column) -> Column:
    return F.ascii(c) - FIRST


def _pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), at + 1, F.lit(1))


def decompose(text: Column) -> Column:
    """Syllables as initial, medial and final letter (compound finals stay whole); other characters as they are."""

    def one(c: Column) -> Column:
        k = _index(c)
        final = k % 28
        whole = F.concat(_pick(INITIALS, F.floor(k / 588).cast("int")), _pick(MEDIALS, F.floor(k % 588 / 28).cast("int")), F.when(final > 0, _pick(FINALS, final - 1)).otherwise(""))
        return F.when(k.between(0, COUNT - 1), whole).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def initials(text: Column) -> Column:
    """Initial letters of the syllables; single consonants stay, all else is dropped."""

    def one(c: Column) -> Column:
        k = _index(c)
        return F.when(k.between(0, COUNT - 1), _pick(INITIALS, F.floor(k / 588).cast("int"))).when(c.between("ㄱ", "ㅎ"), c).otherwise("")

    return F.array_join(F.transform(_chars(text), one), "")


def has_letters(text: Column) -> Column:
    """Whether single Hangul letters stand in the text."""
    return text.rlike("[ㄱ-ㅎㅏ-ㅣ]")


_K = f"(unicode(c) - {FIRST})"
_INITIAL = f"substring('{INITIALS}', CAST(floor({_K} / 588) AS BIGINT) + 1, 1)"


def _each(text: str, body: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: {body}), '')"


def decompose_sql(text: str) -> str:
    medial = f"substring('{MEDIALS}', CAST(floor({_K} % 588 / 28) AS BIGINT) + 1, 1)"
    final = f"CASE WHEN {_K} % 28 > 0 THEN substring('{FINALS}', {_K} % 28, 1) ELSE '' END"
    return _each(text, f"CASE WHEN {_K} BETWEEN 0 AND {COUNT - 1} THEN {_INITIAL} || {medial} || {final} ELSE c END")


def initials_sql(text: str) -> str:
    return _each(text, f"CASE WHEN {_K} BETWEEN 0 AND {COUNT - 1} THEN {_INITIAL} WHEN c BETWEEN 'ㄱ' AND 'ㅎ' THEN c ELSE '' END")


def has_letters_sql(text: str) -> str:
    return f"regexp_matches({text}, '[ㄱ-ㅎㅏ-ㅣ]')"
