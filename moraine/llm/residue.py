"""Template residue, filler, error pages and script notices instead of content.

Lines are counted by host after normalising case and digits; lines that recur within a host are
boilerplate (menus, footers) and are subtracted, as are the title and lines that are no
sentences. Of what remains, lines with error, filler or script-required evidence are weighed against the rest: a
record is excluded if the evidence is at least `share` of its residual characters, or if a
sentence holds an unfilled placeholder. Code and quotations are left out before looking for
placeholders. A recurrent line with evidence (a notice under every page of a host) is subtracted
like any other from a record that has something else to say; a record of nothing but evidence and
boilerplate is excluded even if all records of its host read alike.

Filler in invented Latin is known by its sentences rather than by its words: a sentence of five or
more small Latin words, none of them a function word of a living language and many with a Latin ending,
makes the other sentences of the record that are in no language filler as well.

Counting and weighing are engine expressions. The count shuffles one 64-bit key a line, combined on
the map side, so a host with a third of all lines is no hot key. The patterns run only on records
that hold one of their literal cues.

Defined results
* null, empty or blank text: not reported.
* null host: such records are one host; null title: no title line.
* a repeated id is judged by all its rows and comes out once; an empty table gives an empty result.
* whole texts are judged whatever their length; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser as parser

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

KINDS = ("placeholder", "error", "filler", "script")

ERROR = (
    r"\b[45]\d\d\b.{0,30}\b(not found|forbidden|bad gateway|unauthori[sz]ed|error|unavailable|time-?out)|^\W*error\W*(code|number)?\W*\d+|\b(error|status) \d{3}\b"
    r"|\b(page|article|document|resource|link|file|url|address|post|entry|content|text|topic|thread|site)\b.{0,60}\b(could not be|cannot be|can't be|was not found|were not found|not found|has been (removed|deleted|moved)|no longer exists?|wandered off|is (not available|unavailable|gone|missing)|does(n't| not) exist|was (moved|removed|deleted)|not available)"
    r"|(something|things) went wrong|^\W*(oops|whoops|uh-oh)|\bnothing (here|to see|was found)\b|\baccess (is |was )?denied|do(es)? not have (the )?permission|permission to (view|see|open|access)|not available to you|session (has )?(expired|timed out)|sign in again|log in again"
    r"|too many requests|^\W*slow down\W*$|fatal error|^\W*traceback|unhandled exception|(internal )?server error|bad gateway|service (is )?(temporarily )?unavailable|gateway time-?out|request timed out|(down for|under|scheduled) maintenance|back soon"
    r"|(please )?(try|reload|retry)( again)? (later|shortly|in \d+)|check the address|cannot connect to|upstream did not|^\W*reference (number|id)\W*\w*\d"
    r"|\b(database|server|network) (connection )?(has |have )?(failed|refused|error|failure|is (unreachable|offline|down))|\bconnection (failed|refused|timed out|(was|has been) (reset|lost|refused|closed))|\b(failed to|unable to|could not|couldn't|cannot|can't) (connect|load|open|reach|fetch|retrieve|establish)\b|\b(establishing|opening) a (database )?connection|unexpected error|an error (has )?occurred"
    r"|찾을 수 없(습니다|어요|음)|불러오지 못했|볼 권한이 없|접근 권한이 없|(여는|불러오는|처리하는) 중에? ?(문제|오류)가|더 이상 (제공|지원)하지 않|(삭제|이동)되었거나|삭제되었습니다|존재하지 않(습니다|는 (페이지|글|문서|주소))|열 수 없습니다|오류 (번호|코드)|오류가 (발생|생겼)|잘못된 (접근|주소|요청)입니다"
    r"|(서비스|서버|시스템) 점검|점검 중입니다|일시적인 (장애|오류)|요청이 너무 많|(잠시|분|초) (뒤|후)에? ?다시 시도|다시 시도해 주|주소를 다시 확인|아무것도 없(네요|습니다|어요)|(세션|로그인|인증)[이 ].{0,8}만료|다시 (들어와|접속해|로그인해) 주|시간이 초과|(연결|접속|요청|불러오기|로딩|처리)[에이가을를]? ?(실패했|실패하였|실패$|끊어졌|끊겼|거부되었|되지 않(습니다|았습니다))|응답(이 없|하지 않)(습니다|어요|았습니다)"
)
SCRIPT = (
    r"\b(enable|enabling|turn(ing)? on|switch(ing)? on|allow|activate|accept)\b.{0,50}\b(java ?script|scripts?|scripting|client-side code|cookies)\b|\b(java ?script|scripts?|scripting|client-side code)\b.{0,50}\b((is|are|was|were) (disabled|off|blocked|required|needed|not enabled)|turned off|switched off|must be (on|enabled))"
    r"|\b(blocks?|blocking|requires?|needs?|without) (java ?script|scripts?|scripting|client-side code)\b|plain browser|checking your browser|(unsupported|outdated) browser|browser is (not supported|too old|out of date)|which the reader needs|^\W*loading\W*$"
    r"|(자바 ?스크립트|스크립트|java ?script|클라이언트 코드).{0,40}(허용|켜(야| 주|고 다시)|사용 ?설정|활성화|꺼져|차단|필요합니다|사용할 수 있게)|지원하지 않는 브라우저|브라우저를 (확인|바꿔|업데이트)|^\W*불러오는 중"
)
FILLER = (
    r"\b(lorem|ipsum|dolor|consectetur|adipiscing)\b|\b(goes|comes) here\b|\bblah blah|\b(asdf|qwer(ty)?|zxcv|hjkl)\b|\btest test\b|\bbody copy\b|\b(sample|dummy|filler|placeholder) (text|copy|content)\b|\btext block \w+\b|\b([a-z]{2,}) \2 \2\b"
    r"|가나다라 ?마바사|ㅁㄴㅇㄹ|ㅂㅈㄷㄱ|ㅋㅌㅊㅍ|(예시|견본|임시|시험용) ?(문구|문장|글|텍스트)|본문 본문|내용 내용|테스트 테스트|(내용|본문|글|문구|텍스트)[을를]? ?(여기에 )?(입력|작성|넣어)(하세요|해 주세요| 주세요)|채움 글"
)


def _finite(item: tuple, most: int = 2000) -> set[str] | None:
    """All texts that a parsed item of a pattern can match; None if they are too many."""
    op, of = item
    if op is parser.LITERAL:
        return {chr(of)}
    if op is parser.AT:
        return {""}
    if op is parser.IN:
        return {chr(x) for kind, x in of} if all(kind is parser.LITERAL for kind, _ in of) else None
    if op is parser.SUBPATTERN:
        return _finite_run(of[-1], most)
    if op is parser.BRANCH:
        every = [_finite_run(x, most) for x in of[1]]
        return None if None in every else set().union(*every)
    if op is parser.MAX_REPEAT and of[1] == 1:
        own = _finite_run(of[2], most)
        return own if own is None or of[0] else own | {""}
    return None


def _finite_run(items: list, most: int) -> set[str] | None:
    out = {""}
    for x in items:
        own = _finite(x)
        if own is None or len(own) * len(out) > most:
            return None
        out = {a + b for a in out for b in own}
    return out


def _begins(item: tuple) -> set[str]:
    """Texts of which one stands at the begin of every match of a parsed item."""
    op, of = item
    if op is parser.SUBPATTERN:
        return _first_of(of[-1])
    if op is parser.BRANCH:
        return set().union(*map(_first_of, of[1]))
    return {""}


def _first_of(items: list) -> set[str]:
    out = {""}
    for x in items:
        own = _finite(x)
        if own is None:
            return {a + b for a in out for b in _begins(x)}
        out = {a + b for a in out for b in own}
    return out


def _literals(items: list) -> set[str]:
    """The most telling set of texts of which every match of the parsed items holds one."""
    sets, run = [], {""}
    for x in items:
        own = _finite(x)
        if own is not None and len(own) * len(run) <= 2000:
            run = {a + b for a in run for b in own}
            continue
        sets.append({a + b for a in run for b in _begins(x)})
        if x[0] is parser.BRANCH:
            sets.append(set().union(*map(_literals, x[1][1])))
        elif x[0] is parser.SUBPATTERN:
            sets.append(_literals(x[1][-1]))
        run = own if own is not None else {""}
    return max([*sets, run], key=lambda c: (min(map(len, c)), -len(c)))


def alternatives(pattern: str) -> list[list]:
    """The parsed alternatives of a pattern that can match at all; one that refers to a group of another can't."""
    parsed = parser.parse(pattern)
    every = list(parsed[0][1][1]) if len(parsed) == 1 and parsed[0][0] is parser.BRANCH else [parsed]
    own = lambda x: {of[0] for op, of in x if op is parser.SUBPATTERN}
    return [x for x in every if all(of in own(x) for op, of in x if op is parser.GROUPREF)]


def cues(*patterns: str) -> tuple[str, ...]:
    """Literals of which every text that one of the patterns matches holds one."""
    every = set().union(*(_literals(x) for p in patterns for x in alternatives(p)))
    if "" in every:
        raise ValueError("an alternative without a literal")
    return tuple(sorted(c for c in every if not any(o != c and o in c for o in every)))


#: Literals of which a record must hold one, lower-cased, before the evidence patterns are tried.
CUES = cues(ERROR, SCRIPT, FILLER)
#: Names that stand for a value in brackets.
SLOTS = "이름|날짜|제목|금액|회사|회사명|지역|지역명|상품명|주소|전화번호|내용|번호|도시|가격|담당자|고객명|연락처"
HTML = "ref|references|br|hr|nowiki|pre|code|kbd|tt|math|gallery|poem|div|span|table|tbody|thead|tr|td|th|ul|ol|li|dl|dt|dd|center|small|big|sub|sup|strong|em|del|ins|blockquote|img|font|html|head|body|title|meta|script|style|link|input|form|button|label|includeonly|noinclude|onlyinclude|h[1-6]|[abipsu]"
PLACEHOLDER = (
    r"\{\{\{[^{}|\n]{1,40}\|?\}\}\}|\{\{ [^{}|=\n:]{1,40} \}\}|\{\{[a-z]+[._][a-z_.]+\}\}|\{\{(name|title|date|city|price|company|user|email|address|phone|" + SLOTS + r")\}\}|\{%[^{}%\n]{1,40}%\}|[$#]\{[^{}\n]{1,40}\}|<%=?[^%\n]{1,60}%>|@@[^@\s]{1,30}@@|(?<![\p{L}\p{N}_])__[\p{L}][\p{L}_.]{0,28}__(?![A-Za-z0-9_])"
    r"|(?<![\p{L}\p{N}{$#%])\{(\d{1,2}|[a-z][a-z_.]{1,28}|" + SLOTS + r")\}(?!\})|(?<![\p{L}\p{N}%])%([a-z][a-z_.]{1,28}|" + SLOTS + r")%|(?<![\p{L}\p{N}%])%[sd](?![\p{L}\p{N}%](?<![가-힣]))"
    r"|<(?!/|(" + HTML + r")[\s/>])(enter|insert|your) [^<>\n]{1,30}>|<(?!/|(" + HTML + r")[\s/>])[a-z][a-z_.]{2,28}>|<(" + SLOTS + r")>|(?<!\[)\[([a-z][a-z]*[_.][a-z_.]+|name|title|date|city|price|company|" + SLOTS + r")\](?![\](])|(?<!\[)\[(insert|enter|your|add|type)\b[^\[\]\n]{1,30}\](?![\](])|(?<!\[)\[여기에 [^\[\]\n]{1,20}\]"
    r"|\((TBD|TBA|TODO|추후 (작성|입력|기재)|미정|(제목|내용|이름|날짜)[을를] 입력하세요)\)|\b(TODO|FIXME): ?\w+|\[object Object\]|[○□◇]{2,}|\bXX/XX/XXXX?\b|\bXXXX-XX-XX\b"
    r"|(?<!\b(is|are|was|were|be|been|being|as|an|of|the|left|remains?|if|or|and|becomes?|by zero) )\bundefined(?! (behaviou?r|value|variable|term|symbol|reference))(?=[\s.,가-힣]|$)|\bNaN\b"
)
CODE = r"(?is)<(pre|code|nowiki|math|syntaxhighlight)\b[^>]*>.*?</\1>|```.*?```|`[^`\n]{1,200}`"
QUOTED = r"\"[^\"\n]{1,120}\"|“[^”\n]{1,120}”|「[^」\n]{1,120}」|‘[^’\n]{1,120}’"
#: A sentence or a long line; titles and menus are neither.
SENTENCE = r"[.?!。…]\W*$|^.{60}"
#: Function words of living languages in Latin letters that are no syllables of filler.
FUNCTION_WORDS = r"\b(the|of|and|to|a|an|is|was|were|are|be|been|for|that|this|these|with|by|at|from|not|has|have|had|which|but|they|you|your|we|our|his|her|their|i|he|she|its|in|on|as|if|who|what|when|where|how|there|so|no|can|will|would|der|die|das|und|ist|nicht|ein|eine|mit|von|auf|zu|den|le|les|des|une|un|dans|pour|que|qui|pas|est|sur|el|los|las|una|con|por|para|del|como|il|di|che|per|non|della|het|een|van|niet|och|att|som|og|ikke|ja|nie|na|w|ve|bir)\b|[^\W\d_a-zà-ÿ]"
LATIN_WORD = r"\b[a-z]+\b"
LATIN_ENDING = r"\b[a-z]*(?:um|us|is|am|or|it|et|em|ur|ae|en|ad|os|a)\b"
#: Least words of a sentence that shows a text to be invented Latin, and share of them with such an ending.
LATIN_LEAST, LATIN_SHARE = 5, 0.4
BREAKS = r"\n+| - |(?<=[.?!。])\s+"


def lines_of(text: Column) -> Column:
    """Lines and sentences of a text."""
    return F.filter(F.split(text, BREAKS), lambda x: F.trim(x) != "")


def line_key(host: Column, line: Column) -> Column:
    """Host and line as one key, without case, digits and outer blanks."""
    return F.xxhash64(F.coalesce(host, F.lit("")), F.regexp_replace(F.lower(F.trim(line)), r"[0-9]+", "0"))


def recurrent_lines(docs: DataFrame, id_col: str, text: str, host: str, min_docs: int, menu_share: float, sentence_share: float) -> DataFrame:
    """Keys of the lines that recur within their host: in menu_share of its records, or sentence_share if the line reads as a sentence."""
    line = F.explode(F.array_distinct(lines_of(F.col(text)))).alias("line")
    host_size = docs.where(F.trim(text) != "").groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(F.count("*").alias("records"))
    counted = (
        docs.select(F.coalesce(host, F.lit("")).alias("host"), line)
        .select("host", line_key(F.col("host"), F.col("line")).alias("key"), F.col("line").rlike(SENTENCE).alias("sentence"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("n"), F.bool_or("sentence").alias("sentence"))
        .where(F.col("n") >= min_docs)
    )
    share = F.col("n") / F.col("records")
    return counted.join(host_size, "host").where(share >= F.when(F.col("sentence"), sentence_share).otherwise(menu_share)).select("key")


#: What every placeholder begins with, for a quick first look.
OPENERS = regex.compile(r"\{[{%0-9a-z가-힣]|[$#]\{|<%|<(?!(?:ref|br|code|pre)[\s/>])[a-z가-힣][^<>\n]{1,40}>|@@|__|(?<!\[)\[(?:[a-z]+[._\]]|[A-Z]+ |(?:[Ii]nsert|enter|your|add|type)\b|여기에|(?:" + SLOTS + r")\])|%[a-z가-힣]|[○□◇]{2}|TODO|FIXME|TB[DA]|XX[/-]XX|\[object|undefined|NaN|\((?:추후|미정|제목|내용|이름|날짜)")
MARKS = re.compile(CODE + "|" + QUOTED)
LINES = "line STRING, sentence BOOLEAN, placeholders INT, error BOOLEAN, filler BOOLEAN, script BOOLEAN"


def evidence_lines(docs: DataFrame, id_col: str, text: str, host: str, title: str) -> DataFrame:
    """All lines, with the evidence in each, of the records that hold any evidence.

    An automaton over all cues picks records and lines first; the patterns as engine expressions on
    every record took ten times the CPU.
    """
    schema = T.StructType([docs.schema[c] for c in (id_col, host, title)] + T._parse_datatype_string(LINES).fields)
    kept = [f.name for f in schema.fields[:3]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for c in CUES:
            automaton.add_word(c, c)
        automaton.make_automaton()
        code, quoted, breaks, sentence, words, word, ending, error, filler, script = (re.compile(x) for x in (CODE, QUOTED, BREAKS, SENTENCE, FUNCTION_WORDS, LATIN_WORD, LATIN_ENDING, ERROR, FILLER, SCRIPT))
        placeholder = regex.compile(PLACEHOLDER)

        def cue(low: str) -> bool:
            return next(automaton.iter(low), None) is not None

        def invented(line: str) -> bool:
            """A sentence of Latin words in no language."""
            if words.search(line.lower()) is not None or sentence.search(line) is None:
                return False
            size = len(word.findall(line))
            return size >= LATIN_LEAST and len(ending.findall(line)) >= LATIN_SHARE * size

        def judged(line: str, latin: bool, all_of: bool) -> tuple:
            low = line.lower()
            bare = quoted.sub(" ", low)
            opened, cued = OPENERS.search(line) is not None, all_of or cue(bare)
            if not (opened or cued or latin):
                return line, sentence.search(line) is not None, 0, False, False, False
            # in a text of invented Latin, a sentence of no known language is filler too
            lorem = latin and words.search(low) is None
            slots = sum(1 for _ in placeholder.finditer(quoted.sub(" ", line))) if opened else 0
            return line, sentence.search(line) is not None, slots, cued and error.search(bare) is not None, lorem or (cued and filler.search(bare) is not None), cued and script.search(bare) is not None

        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in kept]
            for i, t in enumerate(batch.column(text).to_pylist()):
                if t is None:
                    continue
                # what stands around code or a quotation may form a cue once that is left out
                coded = MARKS.search(t) is not None
                opened = OPENERS.search(t) is not None or cue(t.lower()) or coded
                parts = [x for x in breaks.split(code.sub(" ", t) if coded else t) if x.strip()]
                latin = any(map(invented, parts))
                if not (opened or latin):
                    continue
                lines = [judged(x, latin, False) for x in parts]
                if any(any(x[2:]) for x in lines):
                    # with some evidence, lines without a cue are tried as well
                    lines = [judged(x, latin, True) for x in parts]
                    head = tuple(c[i] for c in columns)
                    rows.extend(head + x for x in lines)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema.fields)], names=schema.names)

    return docs.select(*kept, text).mapInArrow(scan, schema)


def evidence(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "site", title: str = "title", min_docs: int = 10, menu_share: float = 0.005, sentence_share: float = 0.2) -> DataFrame:
    """For each record with a cue: residual characters, and those of each kind of evidence in lines; number of placeholders.

    Recurrent evidence counts only where nothing but evidence and boilerplate is left of the record.
    """
    docs = docs.select(id_col, text, host, title)
    recurrent = recurrent_lines(docs, id_col, text, host, min_docs, menu_share, sentence_share)
    line = F.col("line")
    lines = evidence_lines(docs, id_col, text, host, title).select(
        id_col,
        line_key(F.col(host), line).alias("key"),
        F.length(line).alias("chars"),
        (F.lower(F.trim(line)) == F.lower(F.trim(F.coalesce(title, F.lit(""))))).alias("is_title"),
        "sentence",
        "placeholders",
        "error",
        "filler",
        "script",
    )
    marked = lines.join(recurrent.withColumn("menu", F.lit(True)), "key", "left").withColumn("menu", F.coalesce("menu", F.lit(False)))
    found = F.col("error") | F.col("filler") | F.col("script")
    total = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("chars"))), F.lit(0))
    counted = marked.groupBy(id_col).agg(
        total(F.col("sentence") & ~(found | F.col("menu") | F.col("is_title"))).alias("other"),
        total(found).alias("whole"),
        total(found & ~F.col("menu")).alias("fresh"),
        F.sum("placeholders").alias("placeholder"),
        *[total(F.col(k)).alias(k) for k in KINDS[1:]],
    )
    weighed = F.when(F.col("other") > 0, F.col("fresh")).otherwise(F.col("whole"))
    return counted.select(id_col, (F.col("other") + weighed).alias("residual_chars"), weighed.alias("evidence_chars"), *KINDS)


def residue(docs: DataFrame, share: float = 0.5, id_col: str = "doc_id", **options) -> DataFrame:
    """Ids of the records to exclude, with the kind of evidence that weighs most."""
    found = evidence(docs, id_col=id_col, **options)
    kind = F.when(F.col("placeholder") > 0, "placeholder")
    top = F.greatest(*KINDS[1:])
    for k in KINDS[1:]:
        kind = kind.when((F.col(k) > 0) & (F.col(k) == top), k)
    whole = (F.col("evidence_chars") > 0) & (F.col("evidence_chars") >= share * F.col("residual_chars"))
    return found.where((F.col("placeholder") > 0) | whole).select(id_col, kind.alias("kind"), "residual_chars", "evidence_chars")
