import pytest

from lexgrain.llm.encoding import WAYS, from_sibling, garble, garbled_fields, restored, restored_fields

SOUND = [
    "L'élève résume la leçon à l'école et complète le schéma du système nerveux près de la forêt.",
    "Où est la fenêtre ? Le maître préfère répéter la règle : « vérifier », puis énoncer la dérivée.",
    "À Žukošice comme à Kogo, l'équipe pédagogique décrit le théâtre et le rôle de la poésie.",
    "Montrer que √370 dépasse 46, où ƒ(x) = 2x² et Θ désigne le modèle ; prix : 198 ¥, Lexigom™ n° 4.",
    "El niño señala la función de la canción en el año 1996. ¿Qué revela la lección?",
]


@pytest.mark.parametrize("true,wrong", [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437")])
def test_round_trip(true, wrong):
    text = SOUND[0]
    assert restored(garble(text, true, wrong), f"{true}>{wrong}") == text


def test_twice():
    bad = WAYS["utf-8>cp1252>again"](SOUND[0])
    assert restored(bad, "utf-8>cp1252>again") == SOUND[0]


def corpus():
    rows = []
    for i in range(400):
        text = f"{i}. {SOUND[i % len(SOUND)]} {SOUND[(i * 3 + 1) % len(SOUND)]}"
        rows.append((f"c{i:03d}", f"f{i % 7}", text, "t. " + text))
    bad = {}
    for i, (true, wrong) in enumerate([("utf-8", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("utf-8", "mac_roman")] * 4):
        k = i * 15
        key, file, text, other = rows[k]
        rows[k] = (key, file, garble(text, true, wrong), other)
        bad[(key, "content")] = text
    return rows, bad


def test_found_and_restored(spark):
    rows, bad = corpus()
    df = spark.createDataFrame(rows, "chunk_id string, source_file string, content string, indexed_content string")
    got = {(r[0], r[1]): r["text"] for r in restored_fields(df, "chunk_id", "source_file", ["content", "indexed_content"]).collect()}
    assert set(got) == set(bad)
    right = sum(got[k] == v for k, v in bad.items())
    assert right >= 0.6 * len(bad)  # pages that lack a character lose it for good


def test_swap_of_one_source_in_a_large_corpus(spark):
    """A source garbled as nobody else's, 1.5e-5 of all symbols of the corpus, is found as it would be in a small corpus."""
    rows = [(f"c{i:05d}", f"f{i % 7}", f"{i}. {SOUND[i % len(SOUND)]} " * 6, None) for i in range(12_000)]
    alone = [("z0", "alone", garble(SOUND[0], "cp1252", "cp850"), None)]
    df = spark.createDataFrame(rows + alone, "chunk_id string, source_file string, content string, indexed_content string")
    got = {r[0] for r in garbled_fields(df, "chunk_id", "source_file", ["content", "indexed_content"]).collect()}
    assert got == {"z0"}


def test_page_outside_the_list(spark):
    """A source decoded by a page that no swap of the list knows: its letters are learned there and put back."""
    rows = [(f"c{i:05d}", f"f{i % 7}", f"{i}. {SOUND[i % len(SOUND)]} " * 3, None) for i in range(2_000)]
    texts = [f"{i}. {SOUND[i % 2]}" for i in range(30)]
    alone = [(f"z{i:02d}", "alone", garble(t, "cp1252", "koi8_r"), None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + alone, "chunk_id string, source_file string, content string, indexed_content string")
    got = {r["chunk_id"]: (r["swap"], r["text"]) for r in restored_fields(df, "chunk_id", "source_file", ["content", "indexed_content"]).collect()}
    assert set(got) == {f"z{i:02d}" for i in range(30)} and {s for s, _ in got.values()} == {"learned"}
    want = [c for t in texts for c in t if c in "éèêîô"]
    have = [c for i, t in enumerate(texts) for c, d in zip(got[f"z{i:02d}"][1], t) if d in "éèêîô"]
    assert sum(a == b for a, b in zip(want, have)) >= 0.8 * len(want)


def test_foreign_letters_are_no_page(spark):
    """Greek in formulas and Russian words are meant."""
    rows = [(f"c{i:05d}", f"f{i % 7}", f"{i}. {SOUND[i % len(SOUND)]} " * 3, None) for i in range(500)]
    greek = [(f"g{i:02d}", "greek", f"{i}. Soit α un angle, β = 2α et γ = π - α ; la somme Σ vaut λ.", None) for i in range(30)]
    russian = [(f"r{i:02d}", "russian", f"{i}. Le mot «книга» et le mot «школа» : я читаю, ты читаешь и он читает.", None) for i in range(30)]
    df = spark.createDataFrame(rows + greek + russian, "chunk_id string, source_file string, content string, indexed_content string")
    assert garbled_fields(df, "chunk_id", "source_file", ["content", "indexed_content"]).count() == 0


def test_sibling():
    sound = "Matière > Leçon\n\nL'élève à l'école écrit « bœuf » vite."
    bad = garble("L'élève à l'école écrit ", "utf-8", "cp1252") + "? b?uf ? vite."
    assert from_sibling(bad, bad, sound) == "L'élève à l'école écrit « bœuf » vite."
    assert from_sibling("MatiÃ¨re > LeÃ§on\n\n" + bad, "Matière > Leçon\n\n" + bad, "L'élève à l'école écrit « bœuf » vite.") == sound
    assert from_sibling(bad, "x", "tout autre chose, écrite ailleurs") == "x" and from_sibling(bad, "x", None) == "x"


def test_edges(spark):
    rows, _ = corpus()
    rows = rows[:50] + [("n1", None, None, None), (None, "f", "Ã©", "x"), ("n2", "f1", "", ""), ("n3", None, "perdu : r�péter", "plain"), ("c000", "f0", rows[0][2], rows[0][3])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, source_file string, content string, indexed_content string, chance int")
    got = garbled_fields(df, "chunk_id", "source_file", ["content", "indexed_content"]).collect()
    keys = [(r[0], r[1]) for r in got]
    assert ("n3", "content") in keys and len(keys) == len(set(keys)) and all(k[0] for k in keys)
    assert garbled_fields(df.limit(0), "chunk_id", "source_file", ["content", "indexed_content"]).count() == 0
