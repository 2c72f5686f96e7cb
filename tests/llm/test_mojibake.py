import pytest

from quadrille.llm import mojibake as m

LINES = {
    "de": "Für die Brücke über den Fluß zahlte man größere Beträge als früher",
    "fr": "L'élève a été reçue à l'école après la fête où le théâtre était fermé",
    "es": "La señora murió según nos dicen en la próxima función de la compañía",
    "pl": "Kościół został odnowiony dzięki staraniom głównych mieszkańców żyta",
    "ru": "Городское собрание решило починить мост до осени и пароход прибыл",
    "el": "Ο δήμαρχος της πόλης ανακοίνωσε ότι η γέφυρα θα επισκευαστεί",
    "en": "The thermometer fell to 13° and wheat at 20s. or 1½d. less, “said he,” £45 a year",
}


def docs():
    rows, n = [], 0
    for _ in range(40):
        for text in LINES.values():
            rows.append((n, text))
            n += 1
    # Misread letters, as scanners leave them everywhere.
    words = "steamer harbour council witness market theatre railway passenger evening".split()
    for k in range(120):
        w = words[k % len(words)]
        at = k % (len(w) - 1)
        rows.append((n, f"the {w[:at]}{'¢■•¬'[k % 4]}{w[at + 1:]} of {w}\xad"))
        n += 1
    return rows


def spoil(text, written, read):
    return text.encode(written).decode(read)


CASES = [
    ("de", "utf-8", "latin-1"), ("fr", "utf-8", "cp437"), ("es", "utf-8", "mac_roman"), ("en", "utf-8", "cp850"), ("ru", "utf-8", "latin-1"),
    ("el", "cp1253", "latin-1"), ("ru", "koi8_r", "latin-1"), ("ru", "cp1251", "latin-1"), ("fr", "latin-1", "mac_roman"), ("de", "latin-1", "cp437"),
    ("pl", "cp1250", "latin-1"), ("ru", "cp1251", "koi8_r"),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = docs()
    for k, (lang, a, b) in enumerate(CASES):
        rows.append((10_000 + k, "plain first line\n" + spoil(LINES[lang], a, b)))
    rows.append((20_000, LINES["de"].encode("latin-1").decode("utf-8", "replace")))
    rows.append((20_001, spoil(spoil(LINES["fr"], "utf-8", "latin-1"), "utf-8", "latin-1")))
    rows += [(30_000, None), (30_001, ""), (30_002, "wit¢ess c■uncil mar•et ¬ soft\xad"), (30_003, "NÃO HOUVE SESSÃO NA QUINTA-FEIRA"), (30_004, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in m.judge(df, m.learn(df)).collect()}


def test_spoilt_lines_are_found_and_restored(judged):
    for k, (lang, a, b) in enumerate(CASES):
        assert 10_000 + k in judged, (lang, a, b)
        assert judged[10_000 + k].restored == "plain first line\n" + LINES[lang]
    assert judged[20_001].restored == LINES["fr"]


def test_lost_characters_mark_a_document(judged):
    assert judged[20_000].lost


def test_clean_texts_stay(judged):
    assert {k for k in judged if k < 10_000 or k >= 30_000} == set()


def test_pairs_undo_what_they_name():
    for p in m.PAIRS:
        if p.written == "utf_8" and p.times == 1:
            assert p.restore("nothing here") is None
    assert m.Pair("utf_8", "western").restore("cafÃ©") == "café"
    assert m.Pair("utf_8", "western").restore("SESSÃO") is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.judge(df, m.learn(df)).count() == 0
