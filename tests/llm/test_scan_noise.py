from pyspark.sql import functions as F

from lexgrain.llm.scan_noise import divided, is_page_number, repaired, scan_noise, skeleton


def test_lines():
    assert all(map(is_page_number, ["12", "- 3 -", "· 10 ·", "Page 4/12", "Page 8 sur 32", "p. 4", "[7]", "3 | 9", "vi"]))
    assert not any(map(is_page_number, ["", "5.", "12 élèves", "mi", "?", "3)"]))
    assert divided("la conserva-", "tion du sol") and divided("le forma‐ ", "teur") and divided("la tra\xad", "nsition")
    assert not divided("Compare-", "Tel") and not divided("Décrit-t-", "on la carte") and not divided("Question 4 —", "suite") and not divided("fin.", "suite")
    assert skeleton("rnodern") == skeleton("modem") and skeleton("c1asse") == skeleton("classe") and skeleton("lcçon") == skeleton("leçon")


NAMES = [a + b for a in ("kala", "toro", "mibe", "sude", "vano") for b in ("ba", "ki", "du", "fe", "go", "ra", "ze", "po")]


def corpus():
    body = f"le modèle de {NAMES[5]} montre la cellule montre la structure du système et la question reste ouverte pour chaque groupe de la classe"
    rows = [(f"s{i:03d}", f"file{i % 20}", f"Texte {i} : {body} numero {i}.", "docling") for i in range(600)]
    for i in range(40):
        noisy = f"Lycée de Ville{i % 4}\nle modèle de {NAMES[i]} montre la cel-\n– {i} –\nlule montre la structure du systèrne et la questiori reste ouverte\npour chaque groupe de la c1asse."
        rows.append((f"n{i:03d}", f"scan{i % 4}", noisy, "ocr"))
    return rows


def test_found(spark):
    df = spark.createDataFrame(corpus(), "id string, file string, content string, method string")
    kinds, words, titles = scan_noise(df, "id", "content", "file", F.col("method") == "ocr")
    got = {}
    for k, v in kinds.collect():
        got.setdefault(k, set()).add(v)
    assert set(got) == {f"n{i:03d}" for i in range(40)}
    assert all(v == {"header", "page_number", "hyphen", "chars"} for v in got.values())
    assert ("systèrne", "système") in {(r["form"], r["better"]) for r in words.collect()}


def test_wrong_label(spark):
    """A misread form seen once, and a title, in scans whose label is wrong or null."""
    rows = [r for r in corpus() if r[0][0] == "s"]
    once = ("m0", "alone", rows[0][2].replace("structure", "structurc"), None)
    scans = [(f"w{i}", "wrong", f"Lycée de Ville\nle modèle de {NAMES[i]} montre la cel-\nlule montre la structure {i}.", "docling") for i in range(4)]
    df = spark.createDataFrame([*rows, once, *scans], "id string, file string, content string, method string")
    kinds = {tuple(r) for r in scan_noise(df, "id", "content", "file", F.col("method") == "ocr")[0].collect()}
    assert kinds == {("m0", "chars")} | {(f"w{i}", k) for i in range(4) for k in ("header", "hyphen")}


def test_repaired(spark):
    df = spark.createDataFrame(corpus(), "id string, file string, content string, method string")
    text = {r["id"]: r["content"] for r in repaired(df, "id", "content", "file", F.col("method") == "ocr").collect()}
    assert text["n005"] == f"le modèle de {NAMES[5]} montre la cellule montre la structure du système et la question reste ouverte pour chaque groupe de la classe."


def test_edges(spark):
    rows = [("a", None, None, None), (None, "f", "x-\ny", "ocr"), ("b", "f", "", "ocr"), ("c", None, "mot-\nsuite", None), ("c", None, "mot-\nsuite", None), ("d", "f", "z " * 50_000, "ocr")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, file string, content string, method string, line int")
    kinds, _, _ = scan_noise(df, "id", "content", "file", F.col("method") == "ocr")
    assert {tuple(r) for r in kinds.collect()} == {("c", "hyphen")} and kinds.count() == 1
    assert scan_noise(df.limit(0), "id", "content", "file", F.col("method") == "ocr")[0].count() == 0
    assert repaired(df.limit(0), "id", "content", "file", F.col("method") == "ocr").count() == 0


def test_misread_titles_and_halves(spark):
    """A misread title is a title; the halves of a word divided across one are no misread words; Exercice is mended though it is only written with a capital."""
    rows = [(i, f, t + " Exercice.", m) for i, f, t, m in corpus() if i[0] == "s"]
    for i in range(12):
        title = "Lycée de Vi11ec0urt" if i % 2 else "Lycée de Villecourt"
        rows.append((f"t{i:02d}", "one", f"{title}\nle modèle de {NAMES[i]} montre la struc-\n{title}\n– {i} –\nture du système {i}.", "ocr"))
    rows.append(("x1", "two", "la structurc et le systèrne : Excrcice d0it", "ocr"))
    df = spark.createDataFrame(rows, "id string, file string, content string, method string")
    kinds = {tuple(r) for r in scan_noise(df, "id", "content", "file", F.col("method") == "ocr")[0].collect()}
    assert {k for k in kinds if k[1] == "chars"} == {("x1", "chars")}
    assert {k for k in kinds if k[1] == "header"} == {(f"t{i:02d}", "header") for i in range(12)}
    text = {r["id"]: r["content"] for r in repaired(df, "id", "content", "file", F.col("method") == "ocr").collect()}
    assert text["x1"] == "la structure et le système : Exercice doit"
    assert text["t03"] == f"le modèle de {NAMES[3]} montre la structure du système 3."
