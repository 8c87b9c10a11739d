"""Posts cut into sentences: code, markup, links and tags are taken out first."""

from __future__ import annotations

import re

#: What is taken out, each behind the literal without which it can't occur.
_CUTS = (
    ("<", re.compile(r"(?is)<(pre|code|nowiki|math|ref|syntaxhighlight)\b[^>]*>.*?</\1>|<ref[^>]*/>")),
    ("```", re.compile(r"(?s)```.*?```")),
    ("`", re.compile(r"`[^`\n]+`")),
    ("{{", re.compile(r"\{\{[^{}]*\}\}")),
    ("{|", re.compile(r"(?s)\{\|.*?\|\}")),
    ("[[", re.compile(r"(?i)\[\[(?:category|file|image|분류|파일|그림):[^\]]*\]\]")),
    ("://", re.compile(r"https?://\S+")),
    ("www.", re.compile(r"www\.\S+")),
    ("@", re.compile(r"(?<![^\s<(])[\w.+-]+@[\w-]+\.\w[\w.]*")),
    ("#", re.compile(r"(?<!\S)#[^\s#]+")),
    ("기자]", re.compile(r"(?m)^\s*\[[^\[\]\n]{2,40}기자\]")),
)
_LINKS = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]")
_BOLD_TITLE = re.compile(r"(?m)^\s*'''[^'\n]{1,200}'''")
_LINE_MARKS = re.compile(r"(?m)^[ \t]*(?:=+[^=\n]+=+[ \t]*$|[>*#:]+[ \t]*)")
_TAGS = re.compile(r"<[^<>\n]{1,60}>|&[a-z]+;")
_ASIDE = re.compile(r"[(（][^()（）\n]{0,80}[)）]")
_ENDS = re.compile(r"([.?!…]['\"”’)]*)\s+(?![a-zà-ÿ])|([。！？][」』”\"]?)")
_QUOTED = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|«[^»\n]{1,200}»|„[^“”\n]{1,200}[“”]|「[^」\n]{1,200}」|『[^』\n]{1,200}』|‘[^’\n]{1,200}’|(?<!\w)'[^'\n]{2,120}'(?!\w)")
_LETTER = re.compile(r"[^\W\d_ㄱ-ㅣ]")
_MARKED = re.compile(r"[\[{<`&@#*=>:]|''|www\.")


def cleaned(content: str) -> str:
    """A text without code, markup, links, tags, by-lines and titles set in bold."""
    text = content
    if _MARKED.search(text) is None:
        return text
    for literal, cut in _CUTS:
        if literal in text:
            text = cut.sub(" ", text)
    if "[[" in text:
        text = _LINKS.sub(r"\1", text)
    if "''" in text:
        text = _BOLD_TITLE.sub("", text).replace("'''", "").replace("''", "")
    text = _LINE_MARKS.sub("\n", text)
    return _TAGS.sub(" ", text) if "<" in text or "&" in text else text


def _ends(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _ENDS.sub(r"\1\2\n", text).split("\n")) if s and _LETTER.search(s)]


def sentences(content: str, quotes: bool = True, asides: bool = False) -> list[str]:
    """The sentences of a text in order, without pieces that hold no letter.

    quotes: keep what stands in quotation marks; else the marks stay, empty.
    asides: what stands in brackets comes last, as sentences of its own; else it is left out.
    """
    text, own = cleaned(content), []
    if "(" in text or "（" in text:
        if asides:
            own = [x[1:-1] for x in _ASIDE.findall(text)]
        text = _ASIDE.sub(" ", text)
    if own:
        text = "\n".join([text, *own])
    if not quotes and any(q in text for q in "\"“«„「『‘'"):
        text = _QUOTED.sub(' "" ', text)
    return _ends(text)


def quotations(content: str) -> list[str]:
    """The sentences that stand in quotation marks."""
    if not any(q in content for q in "\"“«„「『‘'"):
        return []
    return [s for x in _QUOTED.findall(cleaned(content)) for s in _ends(x[1:-1])]
