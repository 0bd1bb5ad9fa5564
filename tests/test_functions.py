"""Golden vectors of the scalar functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexora.functions import rank as K
from lexora.functions import text as T
from lexora.operators import gate


def value(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


NAMES = {"안재현": "アン・ジェヒョン", "탁재훈": "タク・ジェフン", "김향기": "キム・ヒャンギ", "최진실": "チェ・ジンシル", "정지소": "チョン・ジソ", "이종원": "イ・ジョンウォン", "박준면": "パク・ジュンミョン", "홍광호": "ホン・グァンホ"}


def test_katakana(spark):
    rows = spark.createDataFrame(list(NAMES), "string").select("value", T.katakana("value").alias("kana")).collect()
    assert {r["value"]: r["kana"] for r in rows} == NAMES


@pytest.mark.parametrize("hint, full, expected", [("유퀴즈", "유 퀴즈 온 더 블럭", True), ("어거스트 디", "어거스트 디 투어", True), ("무빙", "무빙 2", True), ("굿파트너", "굿파트너2", True), ("박신혜", "김민경", False), ("BTS", "방탄소년단", False)])
def test_abbreviation(spark, hint, full, expected):
    assert value(spark, T.is_abbreviation(F.col("h"), F.col("f")), h=hint, f=full) is expected


@pytest.mark.parametrize("term, clean", [("임원희", True), ("오징어 게임", True), ("Park Shin-hye", True), ("BTS", True), ("방탄소년단 (BTS)", True), ("임ㅇ원희", False), ("ㅁ방탄", False), ("안ㅡ은진", False)])
def test_clean_korean(spark, term, clean):
    assert value(spark, T.clean_korean(F.col("t")), t=term) is clean


def test_strip_jamo(spark):
    assert value(spark, T.strip_lone_jamo(F.col("t")), t="임ㅇ원희") == "임원희"


def test_keys_differ_as_they_should(spark):
    assert value(spark, T.key_posix(F.col("t")), t="a+b·c-d e") == "ab·cde"
    assert value(spark, T.key_unicode(F.col("t")), t="a+b·c-d e") == "a+bcde"
    assert value(spark, T.key_posix_dot(F.col("t")), t="a+b·c-d e") == "abcde"
    assert value(spark, T.spelling(F.col("t")), t="  Park  Shin‑Hye ") == "park shin hye"
    assert value(spark, T.key_match(F.col("t")), t="A. (B)-c") == "abc"


@pytest.mark.parametrize("locale, spelling, ok", [("ko", "박신혜", True), ("ko", "カナ", False), ("ko", "漢字", False), ("zh", "汉字", True), ("zh", "한글", False), ("ja", "カナ", True), ("ja", "한글", False), ("en", "Park", True), ("en", "박", False), ("en", "Pa​rk", False), ("es", "日本", False)])
def test_charset(spark, locale, spelling, ok):
    assert value(spark, T.valid_for_locale(F.col("s"), F.col("l")), s=spelling, l=locale) is ok


def test_variants(spark):
    out = value(spark, T.convert_variants(F.col("s"), "眞優", {"優": "优"}, keep="眞"), s="眞優")
    assert (out["value"], out["ok"]) == ("眞优", True)
    assert value(spark, T.convert_variants(F.col("s"), "眞優", {"優": "优"}), s="眞優")["ok"] is False


def test_context_and_paren(spark):
    assert value(spark, T.context_spelling(F.col("t"), F.col("c")), t="방탄", c="오늘 방탄(BTS)이 왔다") == "BTS"
    assert value(spark, T.paren_latin_name(F.col("t")), t="방탄소년단 (BTS)") == "BTS"
    assert value(spark, T.paren_latin_name(F.col("t")), t="가 (A) 나 (B)") is None
    assert value(spark, T.strip_annotation(F.col("t"), ["namuwiki"]), t="Name (namuwiki)") == "Name"


@pytest.mark.parametrize("most", range(0, 12))
def test_truncate(spark, most):
    text = "aé한😀b"
    expected = text.encode()[:most].decode("utf-8", "ignore")
    assert value(spark, T.truncate_bytes(F.col("t"), most), t=text) == expected


def test_mentions(spark):
    assert value(spark, T.mentions(F.col("t"), F.col("n")), t="오늘 아이유가 왔다", n="아이유") is True
    assert value(spark, T.mentions(F.col("t"), F.col("n")), t="오늘 아이유나라", n="아이유") is False
    assert value(spark, T.contains_word(F.col("t"), F.col("n")), t="한아이유", n="아이유") is False


def test_html(spark):
    assert value(spark, T.clean_html(F.col("t")), t="<p>a &amp;  b</p>\n<b>c</b>") == "a & b c"
    assert value(spark, T.nfc(F.col("t")), t="é") == "é"


@pytest.mark.parametrize("url, ok", [("https://a.example.com/x", True), ("javascript:alert(1)", False), ("https://u:p@example.com", False), ("http://localhost/x", False), ("http://127.0.0.1/", False)])
def test_urls(spark, url, ok):
    assert value(spark, T.valid_source_url(F.col("u")), u=url) is ok


@pytest.mark.parametrize("label, rank", [("operator", 1), ("media-consensus", 2), ("rss-observation-x", 3), ("tmdb", 4), ("wikidata-label", 5), ("kowiki-hanja", 6), ("opencc", 7), ("kana-rule", 8), ("llm-provisional", 9), ("what", 99), ("", 99)])
def test_priority(spark, label, rank):
    assert value(spark, K.source_priority(F.col("s")), s=label) == rank


def test_replace(spark):
    decide = lambda a, x, b, y: tuple(value(spark, K.replace_decision(F.col("a"), F.col("x"), F.col("b"), F.col("y")), a=a, x=x, b=b, y=y))
    assert decide("operator", "v", "local-usage", "w") == (False, False)
    assert decide("gtranslate", "v", "tmdb", "w") == (True, False)
    assert decide("tmdb", "v", "kofic", "w") == (False, True)
    assert decide("tmdb", "v", "kofic", "v") == (False, False)
    assert K.weaker_machine_sources("opencc") == ["codex-fallback", "gtranslate", "gtranslate-raw", "kana-rule", "llm-provisional", "consumer-suggestion"]


def test_trust_of_an_operator_source_on_an_unlocked_row(spark):
    tier = K.trust_tier(F.lit(False), F.lit(0), F.array(F.lit("operator")))
    assert value(spark, tier) == "llm"
    assert value(spark, K.trust_tier(F.lit(False), F.lit(3), F.array(F.lit("x")))) == "confirmed"


@settings(max_examples=1, suppress_health_check=[HealthCheck.function_scoped_fixture], deadline=None)
@given(st.lists(st.text(max_size=30), min_size=200, max_size=200))
def test_gate_always_decides(spark, terms):
    rows = spark.createDataFrame([(t.encode("utf-8", "ignore").decode(),) for t in terms] + [(None,), ("",), ("아이유",)], "term string")
    no = F.lit(False)
    out = rows.select(gate.decide_intake(F.col("term"), F.lit("person"), F.lit("가수 아이유가"), F.lit("https://a.example.com"), F.lit(True), no, no, no, no).alias("g")).select("g.*").collect()
    assert {r["verdict"] for r in out} <= {"pass", "review", "reject"}
    assert all(r["reason"] and r["rules"] for r in out)
    assert out[-1]["verdict"] == "pass"


@pytest.mark.parametrize("term, reason", [("", "empty"), ("임ㅇ원희", "lone_jamo"), ("qwerty", "mash"), ("가" * 21, "len_gt_max"), ("한 두 세 네", "many_words"), ("노래해주세요", "josa_tail"), ("우리언니 공연", "fan_honorific"), ("방탄2", "hangul_digit"), ("아이유", "ambiguous")])
def test_pre_gate(spark, term, reason):
    assert value(spark, gate.pre_gate(F.col("t")), t=term)["reason"] == reason


PROOF = {"type": "person", "url": "https://news.example.com/1", "trusted": True, "context": "가수 아이유가 새 앨범을 공개했다."}
DECISIONS = [
    ("아이유", PROOF, "pass"), ("괴물", {"existing": True}, "pass"), ("스트레이 키즈", {"identity": True}, "review"), ("뷔", {"approved": True}, "pass"), ("괴물", {"type": "movie", "kinds": True}, "review"),
    ("박보검", {}, "review"), ("건강", {}, "review"), ("아이유", {"type": "person"}, "review"), ("아이유", PROOF | {"type": None, "context": ""}, "review"), ("아이유", PROOF | {"context": ""}, "review"),
    ("아이유", PROOF | {"context": "아이유가 말했다"}, "review"), ("건강", PROOF | {"context": "배우 건강이 출연했다"}, "review"), ("적", PROOF | {"context": "배우의 실적이 공개됐다"}, "review"),
    ("미소", PROOF | {"context": "배우가 새 작품을 공개했다. 아주 긴 별도의 설명이 이어진 뒤 전혀 다른 문장에서 미소가 언급됐다"}, "review"), ("배우", PROOF | {"context": "배우"}, "reject"),
    ("아리랑", {"type": "term", "context": "아리랑"}, "review"), ("합정역광고", {"type": "group"}, "reject"), ("생일광고", PROOF | {"context": "아이돌 생일광고가 걸렸다"}, "reject"), ("드라마 다시보기", {}, "reject"),
    ("광고천재 이태백", {"type": "drama"}, "review"), ("꽃", PROOF | {"type": "song_album", "context": "신곡 '꽃'을 발표했다"}, "review"), ("진", {"type": "person", "existing": True}, "pass"),
    ("HIGH TOP", {"type": "song_album"}, "review"), ("XYZ", {}, "reject"), ("IVE", {"type": "group"}, "review"), ("새천년 (NEW ERA)", {"type": "song_album"}, "review"), ("NCT", {"type": "group", "existing": True}, "pass"),
    ("Made My Night", {"url": "https://a.example.com/x", "correction": True}, "review"), ("임ㅇ원희", {"existing": True}, "reject"), ("우리들의 블루스", PROOF | {"type": "drama", "context": "‘우리들의 블루스’를 봤다"}, "pass"),
    ("가수 아이유", PROOF | {"context": "배우 가수 아이유가"}, "review"), ("부산국제영화제", PROOF | {"context": "가수 부산국제영화제가"}, "review"), ("방탄소년단 진", PROOF | {"context": "가수 방탄소년단 진이"}, "review"),
]


def test_intake_decisions(spark):
    keys = ["type", "url", "trusted", "context", "existing", "approved", "identity", "kinds", "correction"]
    made = [(n, term, *[facts.get(k) for k in keys]) for n, (term, facts, _) in enumerate(DECISIONS)]
    rows = spark.createDataFrame(made, "n long, term string, type string, url string, trusted boolean, context string, existing boolean, approved boolean, identity boolean, kinds boolean, correction boolean")
    c = F.col
    verdict = gate.decide_intake(c("term"), c("type"), c("context"), c("url"), c("trusted"), c("existing"), c("approved"), c("identity"), c("kinds"), c("correction"))
    got = {r["n"]: r["g"] for r in rows.select("n", verdict.alias("g")).collect()}
    assert {(DECISIONS[n][0], g["verdict"], g["reason"]) for n, g in got.items() if g["verdict"] != DECISIONS[n][2]} == set()
    assert all(g["reason"] in gate.OUTCOMES and g["flags"] for g in got.values()) and got[28]["reason"] == "fatal_lone_jamo"


def test_keys_compose(spark):
    """Decomposed names have the keys of composed ones."""
    import unicodedata

    for name in ("아이유 É-x", "한·국"):
        apart = unicodedata.normalize("NFD", name)
        assert value(spark, T.key_unicode(F.col("t")), t=apart) == value(spark, T.key_unicode(F.col("t")), t=name)
        assert value(spark, T.spelling(F.col("t")), t=apart) == value(spark, T.spelling(F.col("t")), t=name)


def test_tombstones(spark):
    alive = T.not_tombstone(F.col("s"), F.col("n"), "[rejected]", ["no source yet"])
    assert value(spark, alive, s="active", n="") is True
    assert value(spark, alive, s="rejected", n="[rejected] out of scope [seen] no source yet") is False
    assert value(spark, alive, s="rejected", n="[rejected] no source yet [seen]") is True
