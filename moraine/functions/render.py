"""Wiki text rendered to HTML.

A page is prepared (code and notes set aside, templates dropped), its lines are sorted into kinds,
and each run of lines of one kind is written as one block. Both dialects share the blocks and
differ in a table of line kinds and one of inline rules.

Columns are rendered by an Arrow UDF, since a page is a sequence of lines whose meaning depends on
their neighbours. Null and empty texts give an empty page.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html import escape
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "html string, categories array<string>, footnotes array<string>"
CATEGORY = re.compile(r"\[\[(?:category|분류):([^\]|]+)(?:\|[^\]]*)?\]\]", re.I)
FILE = re.compile(r"\[\[(?:file|image|파일|이미지|그림):[^\]]*\]\]", re.I)
LINK = re.compile(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]")
ADDRESS = re.compile(r"\[(https?://[^\s\]]+)(?:\s+([^\]]+))?\]")
RULE = re.compile(r"-{4,}\s*")
#: Headings of sections that hold notes and links only; they are left out.
LAST_SECTIONS = re.compile(r"각주|참고 ?문헌|참조|외부 링크|같이 보기|내용주|출처|관련 문서|references|external links|see also|notes", re.I)
#: More of them in the template dialect.
MEDIA_LAST_SECTIONS = re.compile(LAST_SECTIONS.pattern + r"|참고|관련 항목|함께 보기", re.I)


@dataclass
class Page:
    categories: list[str] = field(default_factory=list)
    footnotes: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)

    def keep(self, html: str) -> str:
        """Put ready HTML aside; the mark that stands for it passes all rules."""
        self.kept.append(html)
        return f"\x00{len(self.kept) - 1}\x00"

    def note(self, text: str) -> str:
        self.footnotes.append(text.strip())
        return ""

    def category(self, m: re.Match) -> str:
        self.categories.append(m.group(1).strip())
        return ""

    def restored(self, html: str) -> str:
        while "\x00" in html:
            html = re.sub("\x00(\\d+)\x00", lambda m: self.kept[int(m.group(1))], html)
        return html


def anchor(title: str) -> str:
    return re.sub(r"[^\w가-힣-]", "", re.sub(r"\s+", "-", title), flags=re.A)


def link(m: re.Match) -> str:
    target, shown = m.group(1).strip(), (m.group(2) or m.group(1)).strip()
    return outside(target, shown) if re.match(r"https?://", target) else escape(shown)


def outside(address: str, shown: str) -> str:
    return f'<a href="{escape(address)}" rel="noopener noreferrer">{escape(shown)}</a>'


Inline = Callable[[Page, str], str]


def paired(marks: dict[str, str]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(re.escape(m) + r"(.+?)" + re.escape(m)), rf"<{tag}>\1</{tag}>") for m, tag in marks.items()]


NAMU_MARKS = paired({"'''": "strong", "''": "em", "~~": "del", "--": "del", "__": "u", "^^": "sup", ",,": "sub"})
MEDIA_MARKS = [(re.compile(r"'''''(.+?)'''''"), r"<strong><em>\1</em></strong>"), *paired({"'''": "strong", "''": "em"})]


def _links(page: Page, line: str) -> str:
    line = FILE.sub("", CATEGORY.sub(page.category, line))
    return ADDRESS.sub(lambda m: outside(m.group(1), m.group(2) or m.group(1)), LINK.sub(link, line))


def namu_inline(page: Page, line: str) -> str:
    line = re.sub(r"\[\*[A-Za-z]?\s+([^\]]+)\]", lambda m: page.note(m.group(1)), _links(page, line))
    line = re.sub(r"(?i)\[(include|age|date|dday|youtube)(\([^)]*\))?\]", "", line)
    line = re.sub(r"(?i)\[br\]", "<br/>", line)
    for pattern, to in NAMU_MARKS:
        line = pattern.sub(to, line)
    return line


def media_inline(page: Page, line: str) -> str:
    line = _links(page, line)
    for pattern, to in MEDIA_MARKS:
        line = pattern.sub(to, line)
    return line


def namu_kind(line: str) -> tuple[str, str]:
    """The kind of block that a line belongs to, and what of it is content."""
    if re.fullmatch("\x00\\d+\x00", line):
        return "ready", line
    if RULE.fullmatch(line):
        return "rule", ""
    if m := re.fullmatch(r"(={1,6})\s*(.+?)\s*={1,6}\s*", line):
        return f"h{len(m.group(1))}", m.group(2)
    if line.startswith(">"):
        return "quote", re.sub(r"^>\s?", "", line)
    if line.startswith("||") and line.endswith("||") and len(line) > 3:
        return "table", line[2:-2]
    if m := re.match(r"\s*\*\s+(.*)", line):
        return "list", "*" + m.group(1)
    if m := re.match(r"\s*(?:\d+\.|#)\s+(.*)", line):
        return "list", "#" + m.group(1)
    return ("text", line) if line.strip() else ("blank", "")


def media_kind(line: str) -> tuple[str, str]:
    if re.fullmatch("\x00\\d+\x00", line):
        return "ready", line
    if RULE.fullmatch(line):
        return "rule", ""
    if m := re.fullmatch(r"(={2,6})\s*(.+?)\s*={2,6}\s*", line):
        return f"h{len(m.group(1))}", m.group(2)
    if re.match(r"[*#]+", line):
        return "list", line
    if re.match(r";.*?:", line):
        return "terms", line[1:]
    if m := re.match(r"(:+)\s*(.*)", line):
        return f"in{len(m.group(1))}", m.group(2)
    return ("text", line) if line.strip() else ("blank", "")


def nested(items: list[tuple[str, str]]) -> str:
    """Lists from (markers, html): '#' stands for a numbered level, '*' for another."""
    out, at = [], 0
    while at < len(items):
        tag = "ol" if items[at][0][:1] == "#" else "ul"
        end = at
        while end < len(items) and (items[end][0][:1] == "#") == (tag == "ol"):
            end += 1
        entries, k = [], at
        while k < end:
            head = items[k][1] if len(items[k][0]) == 1 else ""
            k += len(items[k][0]) == 1
            deeper = []
            while k < end and len(items[k][0]) > 1:
                deeper.append((items[k][0][1:], items[k][1]))
                k += 1
            entries.append(f"<li>{head}{nested(deeper) if deeper else ''}</li>")
        out.append(f"<{tag}>{''.join(entries)}</{tag}>")
        at = end
    return "".join(out)


def block(page: Page, kind: str, lines: list[str], inline: Inline) -> str:
    """The HTML of a run of lines of one kind."""
    if kind == "ready":
        return "\n".join(lines)
    if kind == "rule":
        return "\n".join("<hr/>" for _ in lines)
    if kind == "blank":
        return ""
    if kind[0] == "h" and kind[1:].isdigit():
        return "\n".join(f'<{kind} id="{escape(anchor(x))}">{inline(page, x)}</{kind}>' for x in lines)
    if kind == "quote":
        return "<blockquote>" + "<br/>".join(inline(page, x) for x in lines) + "</blockquote>"
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{inline(page, c.strip())}</td>" for c in x.split("||")) + "</tr>" for x in lines) + "</table>"
    if kind == "list":
        parts = [re.match(r"([*#]+)\s*(.*)", x).groups() for x in lines]
        return nested([(m, inline(page, text)) for m, text in parts])
    if kind == "terms":
        pairs = [x.split(":", 1) for x in lines]
        return "<dl>" + "".join(f"<dt>{inline(page, a.strip())}</dt><dd>{inline(page, b.strip())}</dd>" for a, b in pairs) + "</dl>"
    if kind.startswith("in"):
        depth = int(kind[2:])
        return "<dl><dd>" * depth + "<br/>".join(inline(page, x) for x in lines) + "</dd></dl>" * depth
    shown = [y for y in (inline(page, x).strip() for x in lines) if y]
    return "\n".join(f"<p>{y}</p>" for y in shown)


def written(page: Page, text: str, kind: Callable[[str], tuple[str, str]], inline: Inline, last: re.Pattern = LAST_SECTIONS) -> str:
    """Blocks of all runs of lines, without the closing sections."""
    out, skipping = [], 0
    for name, run in groupby(map(kind, text.split("\n")), key=lambda x: x[0]):
        lines = [x[1] for x in run]
        if name[0] == "h" and name[1:].isdigit():
            level = int(name[1:])
            closing = last.fullmatch(lines[-1].strip()) is not None
            if closing or level <= skipping:
                skipping = level if closing else 0
        html = block(page, name, lines, inline)  # also what is left out names categories
        if html and not skipping:
            out.append(html)
    return re.sub(r"(?:<br/>\s*){3,}", "<br/><br/>", page.restored("\n".join(out)))


def namu(text: str) -> tuple[str, list[str], list[str]]:
    """HTML, categories and footnotes of a page in the bracket dialect."""
    page = Page()
    code = lambda c: page.keep(f"<pre><code>{escape(c.strip(chr(10)))}</code></pre>")
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    text = re.sub(r"\{\{\{#!syntax\s+\w+\n([\s\S]*?)\}\}\}", lambda m: code(m.group(1)), text)

    def braces(m: re.Match) -> str:
        inner = m.group(1)
        if styled := re.match(r"(#[0-9a-fA-F]{3,6}|[+-]\d)\s", inner):
            return escape(inner[styled.end() :])
        return code(inner) if "\n" in inner else page.keep(f"<code>{escape(inner)}</code>")

    text = re.sub(r"\{\{\{([\s\S]*?)\}\}\}", braces, text)
    text = re.sub(r"\{\{[\s\S]*?\}\}", "", text)
    text = re.sub(r"\[(목차|tableofcontents|각주|footnote)\]", "", text)
    return written(page, text, namu_kind, namu_inline), page.categories, page.footnotes


def template(m: re.Match) -> str:
    parts = m.group()[2:-2].split("|")
    name = parts[0].strip().lower()
    if name.startswith("lang") and len(parts) > 1:
        return parts[-1]
    return parts[1] if name in ("quote", "인용문") and len(parts) > 1 else ""


def media_table(page: Page, source: str) -> str:
    """A table between {| and |}."""
    rows: list[list[str]] = [[]]
    for line in source.strip()[2:-2].split("\n")[1:]:
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            continue
        elif line[:1] in ("|", "!"):
            tag = "th" if line[0] == "!" else "td"
            for cell in re.split(r"\|\||!!", line[1:]):
                content = cell.rsplit("|", 1)[-1] if re.match(r"[^\[\]]*=[^\[\]]*\|", cell) else cell
                rows[-1].append(f"<{tag}>{media_inline(page, content.strip())}</{tag}>")
    body = "".join(f"<tr>{''.join(r)}</tr>" for r in rows if r)
    return page.keep(f"<table>{body}</table>") if body else ""


def media(text: str) -> tuple[str, list[str], list[str]]:
    """HTML, categories and footnotes of a page in the template dialect."""
    page = Page()
    text = re.sub(r"<!--[\s\S]*?-->", "", text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", ""))
    text = re.sub(r"(?is)<(nowiki|pre|source|syntaxhighlight|code)\b[^>]*>(.*?)</\1>", lambda m: page.keep(f"<code>{escape(m.group(2))}</code>" if "\n" not in m.group(2) else f"<pre><code>{escape(m.group(2))}</code></pre>"), text)
    text = re.sub(r"(?is)<ref\b[^>/]*>(.*?)</ref>", lambda m: page.note(m.group(1)), text)
    text = re.sub(r"(?i)<ref\b[^>]*/>|<references[^>]*>", "", text)
    inner, before = re.compile(r"\{\{(?:[^{}]|\{(?!\{)|\}(?!\}))*\}\}"), None
    while before != text:
        before, text = text, inner.sub(template, text)
    text = re.sub(r"\{\|[\s\S]*?\n\|\}", lambda m: media_table(page, m.group()), text)
    text = CATEGORY.sub(page.category, text)
    return written(page, text, media_kind, media_inline, MEDIA_LAST_SECTIONS), page.categories, page.footnotes


def _column(render: Callable[[str], tuple[str, list[str], list[str]]]):
    @F.pandas_udf(RESULT)
    def rendered(texts: pd.Series) -> pd.DataFrame:
        rows = [render(t) if t else ("", [], []) for t in texts]
        return pd.DataFrame(rows, columns=["html", "categories", "footnotes"])

    return rendered


def namu_html(text: Column) -> Column:
    return _column(namu)(text)


def media_html(text: Column) -> Column:
    return _column(media)(text)
