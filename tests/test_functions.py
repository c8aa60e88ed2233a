"""Column functions on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from carelake.functions import advice, clock, geo, markup, records, replies, text


def test_defaults_and_dates(values):
    rows = [("20240131",), ("2024-01-31",), ("",), (None,), ("20241399",)]
    assert values(rows, "d string", text.normal_date(F.col("d"))) == ["20240131", "2024-01-31", "", "", "20241399"]
    assert values(rows, "d string", text.date_value(F.col("d"))) == [dt.date(2024, 1, 31), None, None, None, None]
    assert values(rows, "d string", text.default_if_empty(F.col("d"), "x"))[2:4] == ["x", "x"]
    assert values([("", "b"), ("a", "b"), (None, "")], "x string, y string",
                  text.first_non_empty(F.col("x"), F.col("y"))) == ["b", "a", None]


def test_camel_keys(spark):
    assert [text.camel_key(k) for k in ("user_name", "YADM_NM", "x_pos", "a_1", "_b")] == [
        "userName", "YADM_NM", "xPos", "a_1", "B"]
    df = spark.sql("SELECT 1 AS outer_key, array(named_struct('inner_key', 2)) AS list_of")
    assert text.camel_columns(df).schema.simpleString() == "struct<outerKey:int,listOf:array<struct<innerKey:int>>>"


def test_strip_is_unicode(values):
    assert values([("　\t x y  \n",)], "t string", text.strip(F.col("t"))) == ["x y"]


def test_attribute_map(values):
    rows = [({"sessionAttr:n": '{"a": 1}', "sessionAttr:s": '"quoted"', "sessionAttr:raw": "plain", "other": "x"},)]
    assert values(rows, "m map<string,string>", text.attribute_map(F.col("m"))) == [
        {"n": '{"a":1}', "s": "quoted", "raw": "plain"}]


def test_opening_hours(values):
    """Seoul local times, given here in UTC."""
    seoul = {"sat 12:59": (6, 12, 59), "sat 13:00": (6, 13, 0), "sat 13:01": (6, 13, 1), "sun 10:00": (7, 10, 0),
             "mon 08:59": (8, 8, 59), "mon 09:00": (8, 9, 0), "mon 17:59": (8, 17, 59), "mon 18:00": (8, 18, 0),
             "mon 19:00": (8, 19, 0)}
    rows = [(dt.datetime(2024, 1, d, h, m, tzinfo=dt.timezone(dt.timedelta(hours=9))),) for d, h, m in seoul.values()]
    pharmacy = values(rows, "t timestamp", clock.pharmacy_open(F.col("t")))
    hospital = values(rows, "t timestamp", clock.hospital_open(F.col("t")))
    assert dict(zip(seoul, pharmacy)) == {
        "sat 12:59": True, "sat 13:00": True, "sat 13:01": False, "sun 10:00": False, "mon 08:59": False,
        "mon 09:00": True, "mon 17:59": True, "mon 18:00": True, "mon 19:00": False}
    assert [h for h, k in zip(hospital, seoul) if k.startswith(("sun", "mon 18", "mon 17"))] == [True, True, False]


def test_labels(values):
    assert values([(None,), (0,), (850,), (1500,), (60000,), (150000,)], "d long", clock.duration_label(F.col("d"))) == [
        "-", "-", "850ms", "2초", "1분", "3분"]
    assert values([(None,), (0.0,), (850.0,), (999.5,), (1260.0,)], "d double", geo.distance_label(F.col("d"))) == [
        "", "", "850m", "999.5m", "1.3km"]
    assert values([(37.5, 127.0), (36.0, 128.0), (0.0, 0.0), (None, None)], "a double, b double",
                  geo.region_label(F.col("a"), F.col("b"))) == ["서울특별시", "대한민국", "위치 확인 불가", "위치 확인 불가"]


def test_redirect_targets(values):
    pages = ["#redirect [[A]]", "  # 넘겨주기 B ", "#REDIRECT [[ C d ]]", "text\n#넘겨주기 [[E]]\n", "no # redirect X",
             "#redirect", "## redirect [[A]]"]
    assert values([(p,) for p in pages], "t string", markup.redirect_target(F.col("t"))) == [
        "A", "B", "C d", "E", None, None, None]


def test_sections(values):
    page = "intro\n== A ==\na body\n=== B b ===\n\n\nb body\n==C==\n= not ==\nrest"
    found = values([(page,)], "t string", markup.sections(F.col("t")))[0]
    assert [(s.level, s.title) for s in found] == [(2, "A"), (3, "B b"), (2, "C"), (1, "not =")]
    assert [s.body.strip() for s in found] == ["a body", "b body", "", "rest"]
    titles = [f"== {k} ==\nx" for k in ("증 상", "주요증상", "여담")]
    picked = markup.pick_section(markup.sections(F.col("t")), markup.SYMPTOM_TITLES)
    assert values([(t,) for t in titles], "t string", picked) == ["\nx", "\nx", None]


def test_clean_markup(values):
    raw = ("  <ref name='a'>x\ny</ref>{{{#!wiki\nbox}}}{{t|u}}[[p|shown]] [[plain]] [https://a.b/c label] "
           "'''bold''' tab\there\r\n\n\n\nend  ")
    assert values([(raw,)], "t string", markup.clean_markup(F.col("t"))) == ["shown plain label bold tab here\n\nend"]


def test_classifier(values):
    pages = {
        "category": ("X", "[[분류:감염병/목록]]"), "excluded": ("X", "[[분류:질병]][[분류:한국 영화]]"),
        "sections": ("X", "== 증상 ==\na\n== 원인 ==\nb"), "treatment": ("X", "== 임상 소견 ==\na\n== 치료와 관리 ==\nb"),
        "title": ("가나염", "== 증상 ==\na"), "symptom only": ("X", "== 증상 ==\na"), "hint only": ("위암", "text"),
        "excluded but sections": ("X", "[[category: 영화]]\n== 증상 ==\na\n== 병인 ==\nb"),
    }
    parts, found = markup.sections(F.col("x")), markup.categories(F.col("x"))
    got = values(list(pages.values()), "t string, x string", markup.is_disease_page(F.col("t"), found, parts))
    assert [k for k, v in zip(pages, got) if v] == ["category", "sections", "treatment", "title", "excluded but sections"]


def test_snapshot_tag(values):
    names = ["/d/wiki_20220301.jsonl.gz", "/d/wiki220301.json", "/d/wiki_20220301.jsonl/part-00000-123456789.json.gz",
             "/d/wiki.json"]
    assert values([(n,) for n in names], "p string", markup.snapshot_tag(F.col("p"))) == [
        "20220301", "20220301", "20220301", None]


def test_severity_reply(values):
    good = '{"severity_score": 9, "recommendation": "HOSPITAL", "reason": "r"}'
    rows = [(good,), (f"```json\n{good}\n```",), (f" ```{good}``` ",), ("no",), ('{"severity_score": 9}',), (None,)]
    got = values(rows, "r string", replies.severity_decision(F.col("r")))
    assert [(g.severity_score, g.recommendation, g.parse_ok) for g in got] == [
        (9, "HOSPITAL", True)] * 3 + [(4, "PHARMACY", False)] * 3


def test_confidence_and_pick(values):
    reply = '{"diseases": [{"id": "a", "name": "n", "confidence": 85, "symptoms": []},' \
            ' {"id": "b", "name": "m", "confidence": 0.85, "symptoms": ["s"]}]}'
    found = values([(reply,)], "r string", replies.disease_options(F.col("r")))[0]
    assert [d.confidence for d in found] == [0.85, 0.85]
    picked = replies.pick_by_id(replies.disease_options(F.col("r")), F.lit("b"))
    assert values([(reply,)], "r string", picked["name"]) == ["m"]


def test_chosen_ranks(values):
    rows = [("[1, 3, 5, 7]", 10), ("[0, 11, 2]", 10), ("[4, 4]", 10), ("[9]", 2), ("oops", 10), (None, 2), ("[1, null]", 5),
            ("[]", 4), ("[1]", 0)]
    assert values(rows, "r string, n int", replies.chosen_ranks(F.col("r"), F.col("n"))) == [
        [1, 3, 5], [2], [4, 4], [1, 2], [1, 2, 3], [1, 2], [1, 2, 3], [1, 2, 3], []]


def test_info_answer(values):
    rows = [('{"age": 35, "is_pregnant": null, "success": true}',), ("?",)]
    got = values(rows, "r string", replies.info_answer(F.col("r")))
    assert [(g.age, g.is_pregnant, g.success) for g in got] == [(35, None, True), (None, None, False)]


def test_advice(values):
    assert values([(5,), (6,), (7,), (8,), (10,)], "s int", advice.triage_band(F.col("s"))) == [
        "PHARMACY", "PHARMACY_AND_VISIT", "PHARMACY_AND_VISIT", "HOSPITAL", "HOSPITAL"]
    assert values([(7,), (8,), (9,)], "s int", advice.message_tone(F.col("s"))) == ["MODERATE", "SEVERE", "EMERGENCY"]
    assert values([(0, None), (None, True)], "a int, p boolean", advice.age_label(F.col("a"))) == ["0세", "정보 없음"]
    mild = values([("D", 7, "r", 2)], "d string, s int, r string, n int", advice.hospital_message(
        F.col("d"), F.col("s"), F.col("r"), F.col("n")))[0]
    assert mild.startswith("**D** 증상 확인이 필요합니다.\n\n심각도: 7/10점\n사유: r\n\n💊") and "가까운 병원 2곳" in mild
    asked = values([([],), (["age"],), (["age", "pregnancy"],)], "m array<string>", advice.info_request(F.col("m")))
    assert asked[0] is None and "나이를 알려주시겠어요?" in asked[1] and asked[2].count("•") == 2


def test_drug_document(values):
    drug = {c: F.col(c) for c in advice.DOCUMENT_LABELS}
    rows = [("N", "E", None, "", None)]
    schema = ", ".join(f"{c} string" for c in advice.DOCUMENT_LABELS)
    assert values(rows, schema, advice.drug_document(drug)) == ["약품명: N\n제조사: E\n성분: \n분류: \n효능: 정보 없음"]


def test_records(values):
    messages = "m array<struct<role:string,content:string>>"
    said = [("user", "a" * 900), ("assistant", "x"), ("user", "b" * 200)]
    got = values([(None, said), ("given", said), ("", []), (None, None)], f"t string, {messages}",
                 records.symptom_text(F.col("t"), F.col("m")))
    assert got[0] == "a" * 900 + " " + "b" * 99 and got[1:] == ["given", None, None]
    assert values([([],), (["x"],), (None,)], "a array<string>", records.json_or_null(F.col("a"))) == [None, '["x"]', None]
    assert values([(1, "", "e"), (1, "n", "e")], "i int, n string, e string",
                  records.party(F.col("i"), F.col("n"), F.col("e")).isNull()) == [True, False]
    assert values([(0.0,), (None,)], "x double", records.coordinate_text(F.col("x"))) == ["0.0", None]
