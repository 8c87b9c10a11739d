"""Analyzers: words, n-grams, and titles taken from texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Words of a text in order, lower-cased; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')"


def ngrams(words: Column, least: int = 2, most: int = 3) -> Column:
    """Character n-grams of every word; words shorter than `least` have none."""

    def grams(w: Column, n: int) -> Column:
        last = F.length(w) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(words, lambda w: F.concat(*[grams(w, n) for n in range(least, most + 1)])))


def ngrams_sql(words: str, least: int = 2, most: int = 3) -> str:
    each = ", ".join(f"list_transform(generate_series(1, length(w) - {n} + 1), lambda i: substring(w, i, {n}))" for n in range(least, most + 1))
    return f"flatten(list_transform({words}, lambda w: list_concat({each})))"


def title_parts(text: Column, most: int = 120) -> Column:
    """Struct of title and body taken from a text.

    The first line if it has 1 to 80 characters and something follows; else up to the first sentence end
    after the tenth character, if that is within `most`; else up to the last blank within `most`; else
    the first `most` characters with the whole text as body.
    """
    line = F.instr(text, "\n")
    first, after_line = F.btrim(F.substring(text, F.lit(1), line - 1), F.lit(" \n\r\t")), F.btrim(F.substring(text, line + 1, F.length(text)), F.lit(" \n\r\t"))
    by_line = line.between(2, 81) & (first != "") & (after_line != "")
    head = F.regexp_extract(text, r"(?s)^(.{10}.*?[.?!。]\s)", 1)
    said, after_said = F.btrim(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(" \n\r\t")), F.btrim(F.substring(text, F.length(head) + 1, F.length(text)), F.lit(" \n\r\t"))
    by_end = F.length(head).between(1, most) & (said != "") & (after_said != "")
    start = F.substring(text, 1, most)
    blank = F.length(start) - F.instr(F.reverse(start), " ")
    by_blank = (F.length(text) > most) & (F.instr(start, " ") > 0) & (blank > 20)
    cut, rest = F.btrim(F.substring(text, F.lit(1), blank), F.lit(" \n\r\t")), F.btrim(F.substring(text, blank + 1, F.length(text)), F.lit(" \n\r\t"))
    pair = lambda a, b: F.struct(a.alias("title"), b.alias("body"))
    return F.when(by_line, pair(first, after_line)).when(by_end, pair(said, after_said)).when(by_blank, pair(cut, rest)).otherwise(pair(F.btrim(start, F.lit(" \n\r\t")), text))


def title_parts_sql(text: str, most: int = 120) -> str:
    ws = "' ' || chr(10) || chr(13) || chr(9)"
    line = f"instr({text}, chr(10))"
    first, after_line = f"trim(substring({text}, 1, {line} - 1), {ws})", f"trim(substring({text}, {line} + 1), {ws})"
    head = rf"regexp_extract({text}, '(?s)^(.{{10}}.*?[.?!。]\s)', 1)"
    said, after_said = f"trim(substring({head}, 1, length({head}) - 1), {ws})", f"trim(substring({text}, length({head}) + 1), {ws})"
    start = f"substring({text}, 1, {most})"
    blank = f"(length({start}) - instr(reverse({start}), ' '))"
    cut, rest = f"trim(substring({text}, 1, {blank}), {ws})", f"trim(substring({text}, {blank} + 1), {ws})"
    pair = lambda a, b: f"struct_pack(title := {a}, body := {b})"
    return (
        f"CASE WHEN {line} BETWEEN 2 AND 81 AND {first} <> '' AND {after_line} <> '' THEN {pair(first, after_line)} "
        f"WHEN length({head}) BETWEEN 1 AND {most} AND {said} <> '' AND {after_said} <> '' THEN {pair(said, after_said)} "
        f"WHEN length({text}) > {most} AND instr({start}, ' ') > 0 AND {blank} > 20 THEN {pair(cut, rest)} ELSE {pair(f'trim({start}, {ws})', text)} END"
    )
