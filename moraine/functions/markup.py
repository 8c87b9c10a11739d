"""Wiki markup: stripping, snippets, tags, format detection and plain HTML, each as a column and as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is taken out of wiki text, in this order, and what it leaves behind.
REWRITES = (
    (r"<ref[^>]*>[\s\S]*?</ref>|<ref[^/]*/>", ""),
    (r"\[include\([^\]]*\)\]", ""),
    (r"\{\{\{#[0-9a-fA-F]{3,6}[\s\S]*?\}\}\}", ""),
    (r"\{\{\{[^}]*\}\}\}|\{\{\{[\s\S]*?\}\}\}", ""),
    (r"\{br\}", " "),
    (r"\[목차\]|\[tableofcontents\]", ""),
    (r"\[\*[^\]]*\]", ""),
    (r"\[\[파일:[^\]]*\]\]|\[파일:[^\]]*\]", ""),
    (r"\|\|[^\n]*\|\|", ""),
    (r"\{\{[\s\S]*?(\}\}|\z)", ""),
    (r"\{\|[\s\S]*?(\|\}|\z)", ""),
    (r"(?i)\[\[(분류|Category):[^\]]*\]\]", ""),
    (r"(?i)\[\[(파일|File|Image):[^\]]*\]\]", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*?)\]\]", "$1"),
    (r"\[https?://[^\s\]]+(\s[^\]]*)?\]", ""),
    (r"<[^>]*>", ""),
    (r"&[a-zA-Z]+;|&#\d+;", " "),
    (r"(?m)^=+\s*(.+?)\s*=+$", "$1"),
    (r"'{2,5}", ""),
    (r"local\s+\w+\s*=\s*\{\}[\s\S]*?(?:end|return\s+\w+)", ""),
    (r"function\s+[\w.:]+\([^)]*\)[\s\S]*?end", ""),
    (r"require\(['\"][^'\"]*['\"]\)", ""),
    (r"\|\s*[\p{L}\p{N}\s_-]+=\s*[^|}\n]*", ""),
    (r"\|[\p{L}\p{N}_-]+=", " "),
    (r"-{3,}", " "),
    (r"[{}\[\]]+", " "),
    (r"\s+", " "),
)
SOURCE_CHARS, STORED_CHARS, SNIPPET_CHARS = 1500, 500, 150
# Signs of the two wiki dialects with their weights.
NAMU_SIGNS = (
    (r"\[목차\]", 3), (r"\[각주\]", 3), (r"\[include\(", 3), (r"\{\{\{[+\-]\d", 3), (r"\{\{\{#[0-9a-fA-F]", 3), (r"\|\|.+\|\|", 2),
    (r"\[\*\s", 2), (r"(?i)\[br\]", 2), (r"(?m)^=\s+.+\s+=\s*$", 2), (r"~~.+?~~", 1), (r"__[^_]+__", 1),
)
MEDIAWIKI_SIGNS = (
    (r"\{\|", 3), (r"\|\}", 3), (r"(?i)<ref[\s>]", 3), (r"(?i)<references", 3), (r"(?i)<nowiki>", 3), (r"(?i)<source[\s>]", 2), (r"(?i)<syntaxhighlight", 2),
    (r"\{\{[^{]", 2), (r"(?i)\[\[Category:", 2), (r"<!--", 1), (r"(?i)#(?:REDIRECT|넘겨주기)", 2), (r"(?m)^#+\s", 1),
)


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def strip_markup(text: Column) -> Column:
    """Plain text of wiki markup; '' for null and blank."""
    stripped = reduce(lambda x, r: F.regexp_replace(x, F.lit(r[0]), F.lit(r[1])), REWRITES, F.coalesce(text, F.lit("")))
    return F.trim(stripped)


def strip_markup_sql(text: str) -> str:
    out = f"coalesce({text}, '')"
    for pattern, to in REWRITES:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    return f"trim({out})"


def snippet(text: Column) -> Column:
    return F.substring(strip_markup(F.substring(text, 1, SOURCE_CHARS)), 1, SNIPPET_CHARS)


def snippet_sql(text: str) -> str:
    return f"substring({strip_markup_sql(f'substring({text}, 1, {SOURCE_CHARS})')}, 1, {SNIPPET_CHARS})"


def snippet_source(text: Column) -> Column:
    """What the index stores of a text for snippets; null if nothing is left."""
    return F.nullif(F.substring(strip_markup(F.substring(text, 1, SOURCE_CHARS)), 1, STORED_CHARS), F.lit(""))


def snippet_source_sql(text: str) -> str:
    return f"nullif(substring({strip_markup_sql(f'substring({text}, 1, {SOURCE_CHARS})')}, 1, {STORED_CHARS}), '')"


#: Links to categories.
TAG_PATTERNS = (r"\[\[분류:([^|\]]+)(?:\|[^\]]*)?\]\]", r"(?i)\[\[Category:([^|\]]+)(?:\|[^\]]*)?\]\]")


def tags(text: Column) -> Column:
    """Names of the categories a text links to, Korean links first, in order, repeats kept."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in TAG_PATTERNS])
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def tags_sql(text: str) -> str:
    lists = ", ".join(f"regexp_extract_all(coalesce({text}, ''), {quoted(p)}, 1)" for p in TAG_PATTERNS)
    return f"list_filter(list_transform(list_concat({lists}), lambda x: trim(x)), lambda x: x <> '')"


def wiki_format(text: Column) -> Column:
    """namumark, mediawiki or plain, by the weights of the signs found."""
    namu, media = (reduce(lambda x, s: x + F.when(text.rlike(s[0]), s[1]).otherwise(0), signs, F.lit(0)) for signs in (NAMU_SIGNS, MEDIAWIKI_SIGNS))
    return F.when(text.isNull() | (F.length(text) < 10) | ((namu == 0) & (media == 0)), "plain").when(namu > media, "namumark").otherwise("mediawiki")


def wiki_format_sql(text: str) -> str:
    namu, media = (" + ".join(f"CASE WHEN regexp_matches({text}, {quoted(p)}) THEN {w} ELSE 0 END" for p, w in signs) for signs in (NAMU_SIGNS, MEDIAWIKI_SIGNS))
    return f"CASE WHEN {text} IS NULL OR length({text}) < 10 OR (({namu}) = 0 AND ({media}) = 0) THEN 'plain' WHEN ({namu}) > ({media}) THEN 'namumark' ELSE 'mediawiki' END"


def plain_html(text: Column) -> Column:
    """Paragraphs and line breaks of a text without markup."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.filter(F.split(safe, "\n\n"), lambda p: F.trim(p) != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))), "\n")


def plain_html_sql(text: str) -> str:
    safe = f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    parts = f"list_filter(string_split({safe}, chr(10) || chr(10)), lambda p: trim(p) <> '')"
    return f"array_to_string(list_transform({parts}, lambda p: '<p>' || replace(p, chr(10), '<br/>') || '</p>'), chr(10))"


def anchor(heading: Column) -> Column:
    """The id of a heading: blanks as hyphens, nothing but word characters."""
    return F.regexp_replace(F.regexp_replace(heading, r"\s+", "-"), r"[^\w가-힣-]", "")


def anchor_sql(heading: str) -> str:
    return rf"regexp_replace(regexp_replace({heading}, '\s+', '-', 'g'), '[^\w가-힣-]', '', 'g')"
