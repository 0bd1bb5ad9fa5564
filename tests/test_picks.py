"""Which records are picked, judged and kept."""

import json
import sys
import threading

import pytest
from pyspark.sql import functions as F

from lexora.sources import connectors, picks, sinks


def bodies(spark, rows):
    return spark.createDataFrame([(i, w, json.dumps(b) if not isinstance(b, str) else b) for i, w, b in rows], "id long, wanted string, body string")


def read(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_films(spark):
    films = [{"id": 5, "title": "Other"}, {"id": 7, "title": "", "name": "범죄도시 5", "original_title": None}, {"id": 8, "original_title": "범죄도시5"}]
    found = connectors.records(bodies(spark, [(1, "범죄도시: 5", {"results": films}), (2, "none", {"results": films}), (3, "!!", {"results": [{"id": 9, "title": "?"}]}), (4, None, {"results": films})]), "film_titles", "position", "record_")
    assert read(picks.pick_film(found), "film") == {1: (7,)}


def test_apps(spark):
    apps = {"results": [{"trackId": 1, "trackName": "P의 거짓 수학"}, {"trackId": 2, "trackName": "p의  거짓", "sellerName": "s"}, {"trackId": 3, "trackName": "P의 거짓"}]}
    assert read(picks.pick_app(connectors.records(bodies(spark, [(1, " P의 거짓 ", apps), (2, "P의-거짓", apps)]), "app_store", "position")), "trackId", "sellerName") == {1: (2, "s")}


def test_artists(spark):
    found = {"artists": [{"id": "a", "name": "Song"}, {"id": "b", "name": "Red-Velvet"}, {"id": "c", "name": "x"}, {"id": "d", "name": "late"}]}
    aliases = spark.createDataFrame([("a", "레드 벨벳"), ("c", "y.y")], "artist string, name string")
    asked = [(1, "red velvet", found), (2, "레드벨벳", found), (3, "late", found), (4, "YY", found), (5, ".", found)]
    assert read(picks.pick_artist(connectors.records(bodies(spark, asked), "artists", "position", "record_"), aliases), "artist") == {1: ("b",), 2: ("a",), 4: ("c",)}


def test_national_and_archive_films(spark):
    films = lambda *rows: {"movieListResult": {"movieList": [dict(zip(("movieCd", "movieNm", "movieNmEn"), r, strict=True)) for r in rows]}}
    asked = [(1, "아몬드", films(("1", "아몬드 나무", "x"), (" ", "아몬드", ""), ("3", " 아몬드 ", ""), ("4", "아몬드", "Almond"))), (2, "none", films(("1", "아몬드", "x")))]
    assert read(picks.pick_national_film(connectors.records(bodies(spark, asked), "films_national", "position")), "code", "english") == {1: ("3", "")}
    part = lambda *rows: {"Result": [dict(zip(("DOCID", "title", "titleEng", "titleEtc"), r, strict=True)) for r in rows]}
    asked = [
        (1, "기생 충", {"Data": [part(("a", " !HS기생!HE 충", "(Gisaeng)", "")), part(("b", "x", "Parasite", "y^기생  충"))]}),
        (2, "두 편", {"Data": [part(("a", "두 편", "One", None), ("b", "두 편", "Two", None))]}),
        (3, "빈", {"Data": [{"Result": None}, part(("c", "빈", None, None))]}),
        (4, "없음", {"Data": []}),
    ]
    assert read(picks.pick_archive_film(connectors.records(bodies(spark, asked), "films_archive", "position")), "DOCID", "english") == {1: ("b", "Parasite"), 3: ("c", "")}


def test_releases(spark):
    rows = spark.createDataFrame([(1, "A - B - C"), (2, "only"), (3, " - x"), (4, None)], "id long, t string")
    assert read(rows.select("id", picks.split_release(F.col("t")).alias("r")).select("id", "r.*"), "artist", "title") == {1: ("A", "B - C"), 2: ("", "only"), 3: ("", "- x"), 4: ("", None)}


def test_localized_titles(spark):
    said = [
        (1, 0, "es", "ES", "Squid Game", ""), (1, 1, "en", "US", "", " Squid Game "), (1, 2, "es", "MX", "El juego", ""), (1, 3, "es", "AR", "Otro", ""), (1, 4, "pt", "PT", "Jogo", ""), (1, 5, "zh", "CN", "鱿鱼", ""),
        (1, 6, "ja", "JP", "SQUID-GAME", ""), (2, 0, "en", "US", "A", ""), (2, 1, "en", "GB", "a!", ""), (3, 0, "en", "US", "A", ""), (3, 1, "en", "GB", "B", ""), (3, 2, "en", "AU", "C", ""),
    ]
    other = [(1, 0, "TW", "魷魚遊戲"), (1, 1, "HK", "later"), (1, 2, "CN", "ignored"), (1, 3, "JP", "squid game"), (1, 4, "BR", "Round 6"), (1, 5, "FR", "Jeu"), (4, 0, "JP", "題")]
    got = picks.localized_titles(spark.createDataFrame(said, "id long, position int, language string, country string, title string, name string"), spark.createDataFrame(other, "id long, position int, country string, title string"))
    assert {(r["id"], r["locale"]): r["title"] for r in got.collect()} == {
        (1, "en"): "Squid Game", (1, "es"): "El juego", (1, "zh"): "鱿鱼", (1, "zh_hant"): "魷魚遊戲", (1, "pt_br"): "Round 6", (2, "en"): "a!", (3, "en"): "B", (4, "ja"): "題",
    }


def test_role_verdicts(spark):
    asked = spark.createDataFrame([(1, "person"), (2, "person"), (3, "person"), (4, "unheard")], "id long, type string")
    entries = [(1, 0, "<b>x</b>", "a river"), (1, 3, "<b>n</b>", "a <b>singer</b>"), (2, 0, "t", "w" * 61), (2, 5, "t", "singer"), (4, 0, "t", None)]
    got = picks.role_verdict(spark.createDataFrame(entries, "id long, position int, title string, description string"), asked, {"person": ["singer"]})
    assert read(got, "verdict", "evidence") == {1: ("confirmed", "n | a singer"), 2: ("review", f"t | {'w' * 60}…"), 3: ("no_entry", ""), 4: ("review", "t | ")}


def test_second_judge(spark):
    answers = {"good": 'Sure: ```{"k_entity": true, "reason": "band"}```', "no": '{"reason": "r"}', "bad": '{"k_entity": 1, x}', "none": "maybe", "lost": None}

    def model(prompts):
        assert all("ja=" not in p for p in prompts)
        return [answers[p.split("name=")[1].split(" ")[0]] for p in prompts]

    rows = spark.createDataFrame([(n, "group", {"en": "E", "ja": " "}) for n in answers], "name string, type string, spellings map<string,string>")
    got = {r["name"]: (r["k_entity"], r["reason"], r["fault"]) for r in connectors.second_judge(rows, model).collect()}
    assert got == {"good": (True, "band", None), "no": (False, "r", None), "bad": (None, None, "bad_json"), "none": (None, None, "no_json"), "lost": (None, None, "no_answer")}


def test_command_transport():
    run = connectors.command_transport([sys.executable, "-c", "import sys; sys.exit(1) if sys.argv[1] == 'x' else print(sys.argv[1] * 2, end='')"])
    assert run(["a", "x"]) == ["aa", None]
    assert connectors.command_transport(["/no/such/command"])(["a"]) == [None]
    assert connectors.command_transport([sys.executable, "-c", "import time; time.sleep(9)"], 0.2)(["a"]) == [None]


def test_cache_shares_and_forgets():
    cache, began, go, seen = sinks.ResultCache(10, most=3), threading.Event(), threading.Event(), []

    def slow():
        began.set()
        go.wait(5)
        return 1

    first = threading.Thread(target=lambda: seen.append(cache.get(("k",), slow, 0.0)))
    first.start()
    began.wait(5)
    second = threading.Thread(target=lambda: seen.append(cache.get(("k",), lambda: 2, 0.0)))
    second.start()
    go.set()
    first.join()
    second.join()
    assert sorted(seen) == [(1, False), (1, True)]

    def fail():
        raise ValueError

    with pytest.raises(ValueError):
        cache.get(("f",), fail, 0.0)
    assert cache.get(("f",), lambda: 3, 0.0) == (3, False)
    for n in range(10):
        cache.get((n,), lambda: n, 1.0)
        assert len(cache.held) <= 3
    assert sinks.ResultCache(0).get((1,), lambda: 5, 0.0) == (5, False)
