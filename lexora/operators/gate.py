"""Intake decisions as ordered rules: the first that applies gives the verdict, and every input gets one."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexora.functions import text as T

RULES = "intake-1"
# Limits of a name.
MOST_CHARACTERS, MOST_WORDS = 20, 4
# Forms of address that fans append to a name.
HONORIFICS = ["언니", "오빠", "누나", "형아"]
# Terms that are common words for most types.
COMMON_TERMS = ["건강", "사랑", "행복", "인기", "도움", "친구", "세계일주", "보자기", "책", "적", "묘한", "경박해", "타이틀곡", "트로트", "수능"]
# Words that name a category and no one entity.
CATEGORY_TERMS = [
    "가수", "배우", "연예인", "아이돌", "그룹", "걸그룹", "보이그룹", "영화", "드라마", "예능", "방송", "프로그램", "앨범", "노래", "음악",
    "뉴스", "기사", "인터뷰", "검색", "추천", "공개", "출연", "컴백", "데뷔", "오늘", "어제", "내일", "지난", "최근", "이번", "사진", "영상", "현장",
]
# Endings of things for sale.
COMMODITY_ENDINGS = ["광고", "티켓팅", "예매", "배송", "할인", "쿠폰", "환불", "시세", "환율", "견적", "렌탈", "수수료", "요금제", "대출", "다시보기", "무료보기"]
# Roles before and behind a person's name.
ROLES_BEFORE = ["배우", "가수", "감독", "작가", "모델", "개그맨", "개그우먼", "방송인"]
ROLES_BEHIND = ["배우", "가수", "감독", "작가", "모델", "멤버", "대표", "회장", "기자"]
# Words in a term that show a place, an event, an outlet.
PLACE_WORDS = ["올림픽공원", "올림픽홀", "컨벤션 센터", "컨벤션센터", "공연장", "체육관", "강변북로", "삼청동", "명동", "한남동"]
EVENT_WORDS = ["국제영화제", "영화제", "패션위크", "시상식", "페스티벌", "축제"]
OUTLET_WORDS = ["출판사", "방송사"]
# Words in a context that show a type.
TYPE_CUES = {
    "person": ["배우", "가수", "감독", "작가", "모델", "개그맨", "개그우먼", "방송인", "멤버", "출연자"],
    "group": ["그룹", "걸그룹", "보이그룹", "밴드", "멤버", "팀", "듀오"],
    "show": ["예능", "프로그램", "방송", "쇼", "출연"],
    "drama": ["드라마", "시리즈", "방영", "극본", "연출"],
    "movie": ["영화", "개봉", "감독", "주연", "상영"],
    "song_album": ["앨범", "싱글", "신곡", "노래", "음원", "발매"],
    "agency": ["소속사", "기획사", "엔터테인먼트", "레이블"],
    "channel_outlet": ["방송사", "채널", "매체", "신문", "출판사"],
    "brand_place": ["브랜드", "매장", "장소", "공연장", "호텔", "센터", "공원", "홀"],
    "event_tour": ["공연", "투어", "콘서트", "영화제", "시상식", "페스티벌", "축제", "패션위크"],
    "character": ["캐릭터", "역", "배역", "등장인물"],
    "political_party": ["정당", "여당", "야당", "원내", "당대표", "창당", "비례대표"],
    "government_body": ["부처", "청", "위원회", "공단", "공사", "공공기관", "정부", "지자체", "시청", "도청", "국회", "법원", "검찰"],
    "company": ["기업", "회사", "법인", "주식회사", "㈜", "그룹사", "계열사", "상장", "코스피", "코스닥"],
    "organization": ["협회", "재단", "단체", "학회", "노조", "조합", "연맹", "사단법인", "재단법인"],
    "sports_team": ["구단", "프로팀", "국가대표팀", "선수단", "FC", "유나이티드", "이글스", "라이온즈", "베어스", "타이거즈"],
    "school": ["학교", "대학", "대학교", "고등학교", "중학교", "초등학교", "캠퍼스", "대학원"],
    "game": ["게임", "모바일게임", "온라인게임", "출시", "업데이트", "패치", "서버", "길드", "던전", "RPG", "MMORPG", "넥슨", "엔씨", "넷마블", "크래프톤", "펄어비스", "스마일게이트"],
    "musical_play": ["뮤지컬", "연극", "공연", "무대", "초연", "재연", "넘버", "배역", "극장", "예술의전당", "블루스퀘어"],
    "webtoon": ["웹툰", "웹소설", "만화", "연재", "작화", "네이버웹툰", "카카오페이지", "레진", "원작"],
    "publication": ["잡지", "월간", "주간", "화보", "표지", "도서", "출간", "단행본", "출판사"],
}
WORKS_AND_EVENTS = ["show", "drama", "movie", "song_album", "event_tour"]
# Reasons of the pre-gate that nothing overrules.
FATAL = ["empty", "lone_jamo", "mash", "unclean"]
# The quotation marks that works are set in.
QUOTES = ["''", '""', "‘’", "“”", "《》", "〈〉"]
# The verdict that each reason gives, and the flag that goes with it.
OUTCOMES = {
    "empty": ("reject", "empty"),
    "unsafe_unicode": ("reject", "unsafe_unicode"),
    "no_letter": ("reject", "no_letter"),
    **{f"fatal_{r}": ("reject", r) for r in FATAL},
    "category_not_entity": ("reject", "category_only"),
    "commodity_term": ("reject", "commodity_suffix"),
    "existing_entity": ("pass", "existing_entity"),
    "normalized_identity_conflict": ("review", "identity_conflict"),
    "operator_approved": ("pass", "operator_approved"),
    "conflicting_entity_types": ("review", "type_conflict"),
    "single_char_needs_operator": ("review", "single_char"),
    "latin_correction_with_evidence": ("review", "correction_evidence"),
    "latin_passthrough": ("reject", "latin_no_translation"),
    "missing_or_unsupported_type": ("review", "type_unproven"),
    "ambiguous_common_for_type": ("review", "common_noun_risk"),
    "type_shape_conflict": ("review", "type_shape_conflict"),
    "missing_source_evidence": ("review", "source_unproven"),
    "missing_exact_context": ("review", "context_unproven"),
    "missing_type_context_cue": ("review", "context_cue_unproven"),
    "typed_context_evidence": ("pass", "typed_context_evidence"),
}


def _any_of(words: list[str], before: str = "", behind: str = "") -> str:
    """A pattern for any of some words, in any case."""
    return f"(?iu){before}(?:{'|'.join(map(re.escape, words))}){behind}"


def pre_gate(term: Column) -> Column:
    """struct(verdict, reason, flags): reject what cannot be a name, leave the rest grey."""
    tails = "|".join(T.PARTICLE_TAILS)

    def judged(f: Column) -> Column:
        t, words = f["t"], f["words"]
        spaced = t.rlike(r"[\s 　]")
        fan = F.try_element_at(words, F.lit(1)).rlike("^..+(" + "|".join(HONORIFICS) + ")$") & (F.size(words) >= 2)
        hangul, digit, latin = t.rlike(T.SYLLABLE), t.rlike("[0-9]"), t.rlike("[A-Za-z]")
        rules = [
            ((t == "") | t.isNull(), "empty"), (T.lone_jamo_count(t) > 0, "lone_jamo"), (T.looks_like_mash(t), "mash"), (~T.clean_korean(t), "unclean"),
            (F.length(t) > MOST_CHARACTERS, "len_gt_max"), (F.size(words) >= MOST_WORDS, "many_words"), (spaced & fan, "fan_honorific"), (~spaced & t.rlike(f"^.+({tails})$"), "josa_tail"), (hangul & digit & ~latin, "hangul_digit"),
        ]
        reason = F.coalesce(*[F.when(c, r) for c, r in rules], F.lit("ambiguous"))
        flags = F.filter(F.array(F.when(t.rlike("[.!?…]"), "sentence_punct"), F.when(spaced, "has_space"), F.when(hangul & (latin | digit), "mixed_script")), lambda x: x.isNotNull())
        return T.let(reason, lambda r: F.struct(F.when(r == "ambiguous", "gray").otherwise("reject").alias("verdict"), r.alias("reason"), flags.alias("flags")))

    words = F.filter(F.split(F.trim(term), r"[\s 　]+"), lambda w: w != "")
    return T.let(F.struct(F.trim(term).alias("t"), words.alias("words")), judged)


def type_from_cues(context: Column, term: Column) -> Column:
    """The type whose cues a context holds outside the term, if only one type's do."""
    hits = lambda rest: F.filter(F.array(*[F.when(rest.rlike(_any_of(cues)), kind) for kind, cues in TYPE_CUES.items()]), lambda x: x.isNotNull())
    return T.let(T.let(F.replace(context, term, F.lit(" ")), hits), lambda found: F.when(F.size(found) == 1, F.element_at(found, 1)))


def most_cued_type(text: Column) -> Column:
    """The type most of whose cues a text holds, in any case; of equals the first by name; null without any."""
    counted = lambda low: F.array(*[F.struct((-sum((F.contains(low, F.lit(c.lower())).cast("int") for c in cues), F.lit(0))).alias("hits"), F.lit(kind).alias("kind")) for kind, cues in TYPE_CUES.items()])
    return T.let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_min(F.filter(counted(low), lambda x: x["hits"] < 0))["kind"])


# Types that are taken from a request or its notes, and the mark of such a note.
GIVEN_TYPES = [*TYPE_CUES, "term"]
NOTED_TYPE = "소비자 type힌트=([a-z_]+)"


def type_from_evidence(requested: Column, notes: Column, classes: Column, class_types: dict[str, str], text: Column) -> Column:
    """struct(type, confidence, source, evidence): the first of the type requested, one noted from a request, that of the first claimed
    class in ``class_types``, the type most of whose cues the text holds; else ``unknown`` without a source. Nothing is guessed."""
    fit = lambda c: T.let(F.lower(F.trim(c)), lambda t: F.when(t.isin(*GIVEN_TYPES), t))
    table = F.create_map(*[F.lit(x) for pair in (class_types or {"": ""}).items() for x in pair])
    claims = F.filter(F.coalesce(classes, F.array().cast("array<string>")), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("")) != "")
    held = F.struct(
        fit(requested).alias("asked"), fit(F.regexp_extract(notes, NOTED_TYPE, 1)).alias("noted"), F.get(claims, F.lit(0)).alias("claim"),
        most_cued_type(text).alias("cue"),
    )
    answer = lambda kind, sure, source, why: F.struct(kind.alias("type"), F.lit(sure).alias("confidence"), F.lit(source).alias("source"), why.alias("evidence"))
    return T.let(
        held,
        lambda h: F.when(h["asked"].isNotNull(), answer(h["asked"], 0.80, "consumer-type", F.lit("requested")))
        .when(h["noted"].isNotNull(), answer(h["noted"], 0.75, "consumer-type", F.lit("noted")))
        .when(h["claim"].isNotNull(), answer(F.try_element_at(table, h["claim"]), 0.85, "wikidata-p31", h["claim"]))
        .when(h["cue"].isNotNull(), answer(h["cue"], 0.55, "context-cue", F.lit("cue")))
        .otherwise(answer(F.lit("unknown"), 0.0, "", F.lit(""))),
    )


def shape_conflict(term: Column, kind: Column) -> Column:
    """Whether a term's own words contradict its type: a role at a person's name, a group beside it, a place, an event, an outlet."""
    words = F.split(term, " ")
    person = term.rlike(_any_of(ROLES_BEFORE, "^", " ")) | term.rlike(_any_of(ROLES_BEHIND, " ", "$")) | ((F.size(words) == 2) & (F.length(words[0]) >= 4) & (F.length(F.element_at(words, -1)) <= 4))
    event = term.rlike(_any_of(EVENT_WORDS)) | term.rlike("^제.*회 ")
    return (
        ((kind == "person") & person)
        | ((kind != "brand_place") & term.rlike(_any_of(PLACE_WORDS)))
        | ((kind != "event_tour") & event)
        | ((kind != "channel_outlet") & term.rlike(_any_of(OUTLET_WORDS, "^", " ")))
    )


def type_cue(context: Column, term: Column, kind: Column) -> Column:
    """Whether a cue of the type stands near the first mention of the term; a work's or event's title may be quoted instead."""
    cue = T.let(T.mention_window(context, term), lambda near: F.coalesce(*[F.when(kind == k, near.rlike(_any_of(words))) for k, words in TYPE_CUES.items()], F.lit(False)))
    quoted = reduce(or_, [F.contains(context, F.concat(F.lit(q[0]), term, F.lit(q[1]))) for q in QUOTES])
    return cue | (kind.isin(*WORKS_AND_EVENTS) & quoted)


def decide_intake(
    term: Column, kind: Column, context: Column, url: Column, trusted: Column, existing: Column, approved: Column, identity_conflict: Column, type_conflict: Column,
    from_correction: Column | None = None,
) -> Column:
    """struct(verdict, reason, rules, type, flags): pass, review or reject; without enough evidence never pass.

    The first rule that applies names the reason, and the reason the verdict. Of the pre-gate's reasons only those in
    ``FATAL`` decide; the others are shapes that full evidence overcomes. A type that is missing, or ``term``, is
    inferred from the context where its cues point to one type only.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    given = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    link = yes(T.valid_source_url(url))
    facts = {
        "t": T.squeeze(T.nfc(F.coalesce(term, F.lit("")))), "said": T.squeeze(T.nfc(F.coalesce(context, F.lit("")))), "given": given, "sourced": yes(trusted) & link,
        "corrected": yes(from_correction if from_correction is not None else F.lit(False)) & link,
        "existing": yes(existing), "identity": yes(identity_conflict), "approved": yes(approved), "kinds": yes(type_conflict),
    }

    def typed(f: Column) -> Column:
        """The facts with the pre-gate's result, and the type given or inferred."""
        known = f["given"].isin(*TYPE_CUES)
        inferred = F.when(~known, type_from_cues(f["said"], f["t"]))
        more = {"pre": pre_gate(f["t"]), "inferred": inferred, "own": F.when(known, f["given"]).otherwise(F.coalesce(inferred, F.when(f["given"] != "term", f["given"]), F.lit("")))}
        return F.struct(*[f[k].alias(k) for k in facts], *[c.alias(k) for k, c in more.items()])

    def reasoned(f: Column) -> Column:
        t, own = f["t"], f["own"]
        known = own.isin(*TYPE_CUES)
        latin = ~t.rlike(T.SYLLABLE) & ~known
        rules = [
            (t == "", "empty"), (t.rlike(r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]"), "unsafe_unicode"), (~t.rlike(r"\p{L}"), "no_letter"),
            *[(f["pre"]["reason"] == r, f"fatal_{r}") for r in FATAL],
            (F.lower(t).isin(*CATEGORY_TERMS), "category_not_entity"), (t.rlike(_any_of(COMMODITY_ENDINGS, "", "$")), "commodity_term"),
            (f["existing"], "existing_entity"), (f["identity"], "normalized_identity_conflict"), (f["approved"], "operator_approved"), (f["kinds"], "conflicting_entity_types"),
            ((F.length(t) == 1) & (own != "person"), "single_char_needs_operator"), (latin & f["corrected"], "latin_correction_with_evidence"), (latin, "latin_passthrough"),
            (~known, "missing_or_unsupported_type"), (F.lower(t).isin(*COMMON_TERMS) & ~own.isin(*WORKS_AND_EVENTS), "ambiguous_common_for_type"), (shape_conflict(t, own), "type_shape_conflict"),
            (~f["sourced"], "missing_source_evidence"), (~yes(T.mentions(f["said"], t)), "missing_exact_context"), (~yes(type_cue(f["said"], t, own)), "missing_type_context_cue"),
        ]
        return F.coalesce(*[F.when(c, r) for c, r in rules], F.lit("typed_context_evidence"))

    def decided(f: Column) -> Column:
        outcomes = F.create_map(*[x for r, (v, flag) in OUTCOMES.items() for x in (F.lit(r), F.struct(F.lit(v).alias("verdict"), F.lit(flag).alias("flag")))])

        def told(r: Column) -> Column:
            marks = F.array(F.when(f["given"] == "term", "type_term_as_unknown"), F.when(f["inferred"].isNotNull(), F.concat(F.lit("type_from_context_cue:"), f["inferred"])), r["out"]["flag"])
            flags = F.array_distinct(F.filter(F.concat(f["pre"]["flags"], marks), lambda x: x.isNotNull()))
            return F.struct(r["out"]["verdict"].alias("verdict"), r["reason"].alias("reason"), F.lit(RULES).alias("rules"), f["own"].alias("type"), flags.alias("flags"))

        return T.let(T.let(reasoned(f), lambda reason: F.struct(reason.alias("reason"), F.element_at(outcomes, reason).alias("out"))), told)

    return T.let(T.let(F.struct(*[c.alias(k) for k, c in facts.items()]), typed), decided)


def latin_gate(term: Column) -> Column:
    """struct(verdict, reason) of plain Latin tokens: the part of the gate that does not depend on a script's tables."""
    low = T.ascii_lower(term)
    rules = [
        (F.trim(term) == "", "empty"), (~low.rlike("[a-z]"), "no_letter"), (T.looks_like_mash(low), "mash"),
        (F.length(term) > MOST_CHARACTERS, "len_gt_max"), (term.rlike("[0-9]"), "digits"), (F.length(term) == 1, "single_char"),
    ]
    reason = F.coalesce(*[F.when(c, r) for c, r in rules], F.lit("plain"))
    verdict = F.when(reason == "plain", "pass").when(reason.isin("digits", "single_char"), "review").otherwise("reject")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))
