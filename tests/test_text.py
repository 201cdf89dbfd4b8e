"""Scalar rules against values worked out by hand."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.operators import conversation, dedup, facets, identity, layout, rerank, store


@pytest.fixture(scope="module")
def one(spark):
    """The value of an expression over a one-row frame with the given columns."""
    df = spark.range(1)
    return lambda expression: df.select(expression.alias("x")).first()["x"]


def test_ids(one):
    assert one(T.document_id(F.lit("a.pdf"), F.lit("main"))) == "68d2002b463c0a1d"
    assert one(T.document_id(F.lit("a.pdf"), F.lit(None).cast("string"))) == "a7949e623819aa32"
    assert one(T.chunk_id(F.lit("68d2002b463c0a1d"), F.lit(3), F.lit(0))) == "9155925015711a03782cbc55"
    assert one(T.content_hash(F.lit("  Bonjour\n LE  monde "))) == "ad3527e5cb1aa91cc02afca92626a535"


@pytest.mark.parametrize("given,key", [("Compétences exigibles", "competences_exigibles"), ("—", "column"), ("œuvre d'art", "uvre_d_art"), ("ﬁn Ⅳ", "fin_iv")])
def test_keys(one, given, key):
    assert one(T.normalize_key(F.lit(given))) == key


@pytest.mark.parametrize("given", ["Élève à l'été", "ﬁn Ⅳ ½ ™ …", "déjà", "𝒜 ℝ ₁² ſ", "Žukošice Łódź ß œ", ""])
def test_fold_is_decomposition(one, given):
    assert one(T.fold(F.lit(given))) == "".join(c for c in unicodedata.normalize("NFKD", given) if not unicodedata.combining(c))


def test_terms(one):
    assert one(T.or_query(F.lit("Quels sont les objectifs de lecture en français en terminale ? 3.3 RTI"))) == "quels | sont | les | objectifs | lecture | francais | terminale | rti"


@pytest.mark.parametrize("given,want", [("ŽlŽve", "éléve"), ("prix ¥ ”ok”", "prix • îokî"), ("”ok”", "”ok”"), (None, None)])
def test_repair(one, given, want):
    assert one(T.repair_encoding(F.lit(given).cast("string"))) == want


def test_cleaning(one):
    assert one(T.clean_text(F.lit("« a »  b—c\x07  \n\n\n\nfin  \n"))) == '" a " b-c\n\nfin'
    assert one(T.ocr_postprocess(F.lit("e|le 1O2 b0n\n.\n«x»"))) == 'elle 102 bon\n"x"'


def test_language(one):
    assert one(T.detect_language(F.lit("the and " * 9 + "x"))) == "fr"  # under 20 words
    assert one(T.detect_language(F.lit("the and " * 10))) == "en"
    assert one(T.detect_language(F.lit("the le " * 10))) == "fr"  # as many of either


@pytest.mark.parametrize("file,kind", [("Corrige_Maths_S2.pdf", "corrige"), ("Programme_Maths-LS.pdf", "programme"), ("Epreuve_Bac_2023.pdf", "sujet"), ("Calendrier.pdf", "administratif"), ("notes.pdf", "inconnu")])
def test_type(one, file, kind):
    assert one(identity.document_type(F.lit(file), F.lit(""))) == kind


def test_subject(one):
    assert one(identity.subject_of_file(F.lit("Programmes_SVT_Tles_LS.pdf"))) == "svt"
    assert one(identity.canonical_subject(F.lit("caractere_test"))) == "arabe"  # key words count inside words
    assert one(identity.canonical_subject(F.lit("xy"))) is None


@pytest.mark.parametrize("level,kind,want", [(None, "sujet", "terminale"), ("cp", "corrige", "terminale"), ("cp", "programme", "cp")])
def test_level(one, level, kind, want):
    assert one(identity.infer_level(F.lit(level).cast("string"), F.lit(kind))) == want


def test_year_first_seen(one):
    assert one(identity.year(F.lit("2019 2020 2019"))) == 2019
    assert one(identity.year(F.lit("2020 2019"))) == 2020
    assert one(identity.year(F.lit("x"))) is None


@pytest.mark.parametrize("page,want", [((59, 0, 0.5), True), ((60, 500, 1.0), False), ((0, 119, 0.49), False), ((0, 120, 0.0), True)])
def test_scanned(one, page, want):
    assert one(layout.is_scanned(*map(F.lit, page))) is want


def test_confidence(one):
    c = layout.ocr_confidence(F.array(*map(F.lit, [90, 30, -1, 80])), F.array(*map(F.lit, ["a", "b", "c", " "])))
    assert one(c["score"]) == pytest.approx(0.6) and one(c["level"]) == "medium"
    none = layout.ocr_confidence(F.array(F.lit(-1)), F.array(F.lit("a")))
    assert one(none["score"]) == 0 and one(none["level"]) == "low"


def test_profile_and_types(one, spark):
    types = lambda *some: F.array(*map(F.lit, some)) if some else F.array().cast("array<string>")
    profile = lambda *some: spark.createDataFrame([(x,) for x in some], "t string").agg(store.profile(F.col("t"))).first()[0]
    assert profile("table_block", "table_block", "x", "x", "x") == "tabular"
    assert profile("list", "heading", "x", "x", None) == "structured"
    assert profile() == "narrative"
    assert one(layout.chunk_type(types("list_item", "list_item"))) == "list"
    assert one(layout.chunk_type(types("list_item", "table"))) == "table_block"
    assert one(layout.chunk_type(types())) == "paragraph"


def test_indel():
    assert dedup.indel_ratio("a" * 19 + "b", "a" * 19 + "c") == pytest.approx(95.0)
    assert dedup.indel_ratio("kitten", "sitting") == pytest.approx(61.538, abs=1e-3)


def test_reliability(one):
    assert [one(rerank.reliability_weight(F.lit(x).cast("string"))) for x in ("high", "medium", "low", None, "odd")] == [1.0, 0.6, 0.3, 1.0, 1.0]


def test_facet_filter(spark):
    df = spark.createDataFrame([("français", "x"), ("anglais", "x"), (None, "x")], "subject string, level string")
    assert df.where(facets.facet_filter({"subject": "FRANCAIS", "foo": "x", "level": ""})).count() == 1


def test_align(spark):
    values = spark.createDataFrame([("subject", "mathematiques"), ("subject", "svt"), ("level", "terminale"), ("level", "premiere"), ("track", "s2"), ("track", "ls")], "facet string, value string")
    stated = spark.createDataFrame([("subject", "Maths"), ("level", "terminale L"), ("track", "S"), ("level", "Troisième")], "facet string, stated string")
    assert {(r[0], r[1]): r[2] for r in facets.align(stated, values).collect()} == {("subject", "Maths"): "mathematiques", ("level", "terminale L"): "terminale", ("track", "S"): "s2"}
    assert spark.range(1).select(facets.common_prefix(F.lit("abcd"), F.lit("abxd"))).first()[0] == 2


def test_rewrite(one):
    assert one(conversation.rewrite_guard(F.lit("orig"), F.lit('"une question complète"'))) == "une question complète"
    assert one(conversation.rewrite_guard(F.lit("orig"), F.lit("trop court"))) == "orig"


def test_unaccented(one):
    assert one(T.unaccented(F.lit("Œuvre à Straße — ÆØ"))) == "oeuvre a strasse — aeo"
    assert one(T.unaccented(F.lit(None).cast("string"))) is None


def test_tracks_and_cycles(one):
    assert one(identity.track(F.lit("x_S2.pdf"), F.lit('la « S1 » et la « L2 », puis "L2"'))) == "L2"
    assert one(identity.track(F.lit("x_S2.pdf"), F.lit("SERIES  s1 et s2, puis"))) == "S1 ET S2"
    assert one(identity.track(F.lit("x_S2.pdf"), F.lit("series S1 , S2 , S3 , L2"))) == "S2"  # announced at too great length
    assert one(identity.track(F.lit("x.pdf"), F.lit(""))) is None
    assert one(identity.level(F.lit("a_Tle_b.pdf"), F.lit("rien"))) == "terminale" and one(identity.level(F.lit("a.pdf"), F.lit("les SECONDES"))) == "seconde"
    assert one(identity.cycle(F.lit("premiere"), F.lit(""))) == "secondaire" and one(identity.cycle(F.lit(None).cast("string"), F.lit("le Moyen"))) == "moyen"
    s = one(identity.subject(F.lit("Programme_2020.pdf"), F.lit("PROGRAMME DE LATIN POUR LA CLASSE. programme d'enseignement du")))
    assert (s["name"], s["source"]) == ("latin", "content")
    s = one(identity.subject(F.lit("Programme_2020.pdf"), F.lit("rien")))
    assert (s["name"], s["source"]) == (None, "unknown")


def test_word_numbers():
    """Numbering stretches equals cutting the folded text into words, also where folding makes several words or none of one."""
    import numpy as np

    from lexgrain.functions.words import WordIds, runs, words

    texts = ["½ tasse … l’œuvre", "", "élève İstanbul ﬁn Ⅳ ª K ½a a½ x̂½̂y", "∑ Ω 中文 a中b", "㈱ ㎏3 été", "a" * 5000, "un\x00deux​trois"]
    a, b = WordIds(), WordIds(most=3)
    for t in [*texts, *texts]:
        assert np.array_equal(a(words(t)), b.of(t))
    assert len(a.of(None)) == 0
    r = runs(a.of("a b a b a c"), 3)
    assert len(r) == 4 and r[0] == r[2] and len(set(r.tolist())) == 3 and len(runs(a.of("a b"), 3)) == 0
    assert len(set(runs(a.of("a b a b a b"), 3).tolist())) == 2
