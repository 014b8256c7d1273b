import pytest

from leafmill.llm import mojibake as m

TEXTS = {
    "fr": "Le café est très près d’une forêt — « déjà vu » et l’œuvre à 5 €.",
    "de": "Größe und Stärke der Öffnung, weiß „gemäß“ heiß.",
    "pl": "Część średnia, różniczkowy wynik: założenie ciągły.",
    "ru": "Измерение сеть пространство поле система по что в мы решение.",
    "el": "Υπόθεση της συνάρτηση είναι αποτέλεσμα με πυκνότητα.",
    "zh": "空间中的数据网络，方法和结果。",
    "en": "A 3×3 matrix costs £5 ± 2 – “smooth” 🙂.",
}
GOOD = [*TEXTS.values(), "SÃO três; “â” é vogal; Ã vem antes", "A REVISÃO DA AÇÃO NÃO É TRIVIAL.", "L’Âge moyen, pâle — Â, Ê, Î.", "l’été — «été» CAFÉ» «À»", "ÐÞ are letters; ÆØÅ æøå", "ТЕОРЕМА О СХОДИМОСТИ «СССР»", "ŁÓDŹ żółć ĄĘĆŻ", "Θεώρημα", "﻿plain", "a\x85b", "", "plain ascii"]


@pytest.mark.parametrize("text", GOOD)
def test_good_text_stays(text):
    assert m.repair(text) == text and not m.garbled(text, text)


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("encoding", ["western", "cp1250", "mac_roman", "cp437", "cp1251"])
def test_utf8_read_in_a_legacy_encoding(lang, encoding):
    back = {b: chr(c) for c, b in m._upper(encoding).items() if not 0x80 <= c < 0xA0} | {b: chr(b) for b in range(0x80, 0xA0) if b not in {v for c, v in m._upper(encoding).items() if not 0x80 <= c < 0xA0}}
    text = wrong = TEXTS[lang]
    for _ in range(2):  # one layer, then two
        wrong = "".join(chr(b) if b < 0x80 else back[b] for b in wrong.encode())
        assert m.garbled(wrong, m.repair(wrong))
        if encoding == "western" or encoding in ("mac_roman", "cp437") and lang in ("fr", "de", "pl", "ru"):
            assert m.repair(wrong) == text
        assert m.repair("Fine café line.\n" + wrong).startswith("Fine café line.\n")


@pytest.mark.parametrize("lang, real, taken", [("ru", "cp1251", "latin-1"), ("ru", "koi8_r", "cp1251"), ("el", "cp1253", "latin-1"), ("fr", "cp1252", "latin-1")])
def test_legacy_read_in_another(lang, real, taken):
    wrong = TEXTS[lang].encode(real).decode(taken)
    assert m.repair(wrong) == TEXTS[lang]


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252"])
@pytest.mark.parametrize("text", ["Le café été", "Größe", "сеть", "数据"])
def test_any_number_of_layers(text, encoding):
    wrong = text
    for _ in range(11):
        wrong = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in wrong.encode())
        assert m.repair(wrong) == text


SHORT = {"ñåòü": "сеть", "УЕФШ": "сеть", "GrцЯe": "Größe", "ÈtÈ": "été", "ïîëå ñåòü": "поле сеть", "ëýóç": "λύση", "r‚sum‚, d‚j… et prot‚g‚": "résumé, déjà et protégé"}


@pytest.mark.parametrize("wrong", SHORT)
def test_short_texts(wrong):
    assert m.repair(wrong) == SHORT[wrong]
    assert m.repair(f"A long line of plain text.\nA café, then {wrong} in it.\n") == f"A long line of plain text.\nA café, then {SHORT[wrong]} in it.\n"


def test_evidence_is_pooled_over_the_document():
    good = [TEXTS["fr"], TEXTS["de"]]
    words = "поле сеть метод и о что".split()
    wrong = [w.encode("cp1251").decode("latin-1") for w in words]
    assert m.repair("\n".join([good[0], *wrong, good[1]])) == "\n".join([good[0], *words, good[1]])


FORMULAS = ["Δx αβ μm λi xΔφy Δt αk γn βm ηθ", "a±b c±d e±f x×y m÷n", "Раураl and ехатрlе of соре", "СССР ГОСТ УЕФА ЮНЕСКО ЩИТ", "çéàè àâ éè", "Việt Nam đồng", "iPhone®x don´t wait…what"]


@pytest.mark.parametrize("text", FORMULAS)
def test_odd_but_right_text_stays(text):
    assert m.repair(text) == text


def test_a_repair_never_turns_words_to_symbols():
    for text in TEXTS.values():
        for real in ("cp1251", "cp1253", "cp1252", "koi8_r", "mac_roman", "cp866"):
            for taken in ("latin-1", "cp1251", "koi8_r", "mac_roman"):
                wrong = text.encode(real, "ignore").decode(taken, "ignore")
                letters = lambda t: sum(c.isalpha() for c in t)
                assert letters(m.repair(wrong)) >= 0.8 * letters(wrong)


def test_lost_bytes_and_cut_text():
    assert m.garbled("r�sum�", m.repair("r�sum�"))
    assert m.repair("cafÃ© â€œxâ€") .startswith("café “x")


def test_frames(spark):
    bad = TEXTS["fr"].encode().decode("cp1252", "replace")
    rows = [(1, None), (2, ""), (3, "plain"), (4, "Ã©tÃ© à"), (4, "Ã©tÃ© à"), (5, "x" * 50_000 + " é"), (6, bad)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as garbled")
    got = m.repair_texts(df).collect()
    assert sorted((r.doc_id, r.garbled) for r in got) == [(1, False), (2, False), (3, False), (4, True), (4, True), (5, False), (6, True)]
    assert {r.text for r in got if r.doc_id == 4} == {"été à"}
    assert m.repair_texts(df.limit(0)).collect() == []
