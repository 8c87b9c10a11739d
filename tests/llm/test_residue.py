"""Template residue, filler, error pages and script notices."""

import pytest

from moraine.llm.residue import CUES, OPENERS, cues, evidence, residue

GOOD = "The bridge was built in 1901. It is used by the whole town. Every spring it is painted again by the same family. Nobody remembers the first keeper."
CASES = {
    1: (GOOD, None),
    2: ("Dear {{ first_name }}, your order ${order_no} has arrived.", "placeholder"),
    3: (GOOD + " The town of <enter date> is close.", "placeholder"),
    4: (GOOD + " 그 다리는 [여기에 이름 입력] 마을에 있다.", "placeholder"),
    5: ("In the example <code>Hello {{ name }}!</code> the part in braces is filled in. " + GOOD, None),
    6: ("{{Infobox|title=Bridge|no=5}} " + GOOD + " [[Category:Bridges]] <ref>Smith, 1990</ref>", None),
    7: ("Menu\nHome | Board | Help\nThe page you asked for could not be found (404).\n© Somebody", "error"),
    8: ("요청하신 페이지를 찾을 수 없습니다. 오류 번호 12", "error"),
    9: ("When a page is missing, the server answers with 404 Not Found. " + GOOD, None),
    10: ("Please enable JavaScript to view this site.", "script"),
    11: (GOOD + "\n\nPlease enable JavaScript to view this site.", None),
    12: ("본문을 읽으시려면 자바스크립트를 허용해 주세요.", "script"),
    13: ("Lorem ipsum dolor sit amet consectetur. Vel nis ador plamag tensum. Ris ador cetvol en.", "filler"),
    14: ("asdf asdf qwer asdf\nblah blah blah\ntest test test", "filler"),
    15: ("가나다라 마바사 아자차카\n여기에 내용을 입력하세요.", "filler"),
    16: ("Printers once used invented Latin as filler text to judge a page. " + GOOD, None),
    17: (None, None),
    18: ("", None),
    19: ("  \n ", None),
    20: (GOOD * 3000, None),
    21: ("undefined was founded in NaN by [object Object].", "placeholder"),
    22: ("Division by zero is undefined. " + GOOD, None),
    23: ('The phrase "access denied" became a joke. ' + GOOD, None),
}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, site string, title string, line string, key string")


def test_cases(spark):
    rows = [(i, t, "a.example" if i % 2 else None, None if i % 3 else "Menu", "x", "y") for i, (t, _) in CASES.items()]
    rows.append(rows[1])  # a repeated record comes out once
    got = residue(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["kind"] for r in got} == {i: k for i, (_, k) in CASES.items() if k} and len(got) == len({r["doc_id"] for r in got})


def test_recurrent_lines_are_no_content(spark):
    menu = "All of our many departments can be reached by telephone on weekdays between nine and five."
    rows = [(i, f"{GOOD} Number {i}.\n{menu}", "h", None, "", "") for i in range(40)] + [(100, f"{menu}\nSorry, something went wrong.", "h", None, "", ""), (101, f"{menu}\nSorry, something went wrong.", "other", None, "", "")]
    assert [r["doc_id"] for r in residue(documents(spark, rows)).collect()] == [100]


def test_empty_table(spark):
    assert residue(documents(spark, [])).collect() == []
    assert evidence(documents(spark, [])).collect() == []


@pytest.mark.parametrize("i", [i for i, (_, k) in CASES.items() if k])
def test_every_kind_has_a_cue(i):
    text = CASES[i][0]
    assert OPENERS.search(text) or any(c in text.lower() for c in CUES)


def test_a_notice_under_every_page_is_subtracted(spark):
    """One footer on all records of a host: those with a sentence of their own stay, one without has nothing else."""
    notice = "Please enable JavaScript to view this site."
    rows = [(i, f"The keeper of house {chr(97 + i % 26)}{chr(97 + i // 26)} paints.\n{notice}", "h", None, "", "") for i in range(70)] + [(100, notice, "h", None, "", ""), (101, f"Menu\n{notice}", "h", "Menu", "", "")]
    assert sorted(r["doc_id"] for r in residue(documents(spark, rows)).collect()) == [100, 101]


def test_error_pages_that_all_read_alike(spark):
    rows = [(i, "This page was not found.\nMenu", "h", None, "", "") for i in range(60)]
    assert len(residue(documents(spark, rows)).collect()) == 60


LATIN = "Felennis vol volsumam orsumsum adad dodover felsumor sum magfel. Volver nis enlornis ius plaamen am donis risplaqua. Fel volor plasu."


@pytest.mark.parametrize(
    "text, wanted",
    [
        (LATIN, "filler"), ("The bridge is old.\n\n" + LATIN, "filler"), (GOOD + " Veni vidi vici.", None), ("Add chopped onions, stir gently, serve warm. Pour cold water, boil twice, strain.", None),
        ("Die alte Bibliothek an der Ecke war geschlossen. Niemand weiß, wer das Bild gemalt hat.", None), ("Il gatto dorme sul tetto della casa. Non piove da tre settimane in questa parte del paese.", None),
        ("First-year students choose 14 courses. Paris, Roma, Vienna, Geneva, Malta.", None), (GOOD + " " + LATIN[:40], None),
    ],
)
def test_invented_latin(spark, text, wanted):
    assert [r["kind"] for r in residue(documents(spark, [(1, text, "h", None, "", "")])).collect()] == ([wanted] if wanted else [])


ALONE = {
    "error": ("This page is gone.", "The requested page can't be displayed.", "We will be back soon.", "Please sign in again.", "404 unauthorized", "서버 점검 안내입니다.", "처리하는 중에 문제가 있었습니다.", 'Access"x"denied.', "401 Unauthorized.", "The page can't be displayed here.", "Please sign in again to continue.", "The requested file is gone.", "Slow down", "Upstream did not answer the request.", "Check the address.", "Reference number: 8", "데이터베이스 연결에 실패했습니다.", "Could not connect to the database.", "An error occurred."),
    "script": ("Please enable cookies to continue.", "브라우저를 바꿔 주세요. 지원하지 않는 브라우저입니다."),
    "filler": ("Filler text filler text filler text.", "zxcv zxcv hjkl", "본문을 입력해 주세요.", "견본 문장입니다."),
    "placeholder": ("Dear [enter your name], good morning.", "This is [your name].", "FIXME: later", "◇◇시 씨는 다리를 보았다."),
}


def test_every_alternative_is_tried(spark):
    rows = [(i, t, "h", None, "", "") for i, t in enumerate(t for own in ALONE.values() for t in own)]
    wanted = {i: k for i, k in enumerate(k for k, own in ALONE.items() for _ in own)}
    assert {r["doc_id"]: r["kind"] for r in residue(documents(spark, rows)).collect()} == wanted


@pytest.mark.parametrize("pattern, wanted", [("a(b|cd)e", {"abe", "acde"}), (r"x\d+foo.*(bar|bars)", {"foo"}), ("colou?r|x{2}grey", {"color", "colour", "grey"}), (r"(ab|cd\d) ?e|(xy) (zz|y) \2", {"ab", "cd", "xy zz xy", "xy y xy"})])
def test_cues_of_a_pattern(pattern, wanted):
    got = cues(pattern)
    assert all(any(c in w for c in got) for w in wanted)
