import re
from collections import Counter

from mosaiq.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_columns(odd, odd_texts):
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(odd).collect())
    assert found == Counter((d, *base(t)) for d, t in odd_texts)


def test_repeated_words_in_large_vocabularies():
    assert quality.repeated_words([b"a", b"b", b"c", b"a", b"b", b"c"]) == 6
    assert quality.repeated_words([b"a"] * 4) == 4
    assert quality.repeated_words([b"a", b"b"]) == 0


def test_lines():
    assert not quality.line_fails("A short line.")
    assert not quality.line_fails("a long line of plain prose that has no end of sentence")
    assert quality.line_fails("Home")
    assert quality.line_fails("News | Sport | Weather | Video")
    assert quality.line_fails("All rights reserved.")
    assert quality.line_fails("buy$$$ now*** cheap%%% pills###")


def test_clean_lines_keeps_clean_documents_and_drops_junk(spark):
    good = "\n".join(f"This{i} is{i} line{i} number{i} of{i} a{i} calm{i} and{i} quite{i} ordinary{i} text{i}." for i in range(8))
    junk = "\n".join(f"Menu{i} | Login{i} | Search{i}" for i in range(40))
    mixed = good + "\nHome\n" + good.split("\n")[0] + "\nAll rights reserved."
    rows = spark.createDataFrame([(1, good, len(good)), (2, junk, len(junk)), (3, mixed, len(mixed))], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r for r in quality.clean_lines(rows).collect()}
    assert set(kept) == {1, 3}
    assert kept[1].text == good and kept[3].text == good and kept[3].n_chars == len(good)


def test_empty_and_clashing(none, clash):
    assert quality.judge(none).count() == 0
    out = quality.judge(clash)
    assert out.count() == clash.count() and dict(out.dtypes)["kept"] == "boolean" and "source" in out.columns
    assert quality.clean_lines(clash).columns == clash.columns


def test_phrases_are_words_in_four_languages():
    for line in ["The catalog in use has a dialog in it, as a design in blue.", "They spread more light, and a thread more.", "I want to read more books about the sea this winter, he said.", "Wer weiterlesen will, braucht nur das Buch und etwas Zeit, sagte sie.",
                 "Il faut partager le pain avec ceux qui viennent de loin, disait-elle.", "Quiere leer más libros sobre el mar en las tardes de invierno.", "日本語の文章です。", "यह एक वाक्य है।"]:
        assert not quality.line_fails(line), line
    for line in ["© 2024 ACME. All rights reserved.", "Read more", "Log in | Sign up", "Alle Rechte vorbehalten.", "Unsere Datenschutzerklärung finden Sie hier.", "Weiterlesen »", "Tous droits réservés.", "Lire la suite…", "Accueil", "Todos los derechos reservados.", "LEER MÁS!", "Inicio", "Política de privacidad."]:
        assert quality.line_fails(line), line


def test_clean_prose_with_the_phrases_stays():
    for line in [
        "The village is now powered by solar panels on every roof.", "The company said it would rewrite its privacy policy after the fine.", "The court read the terms of service aloud before the jury retired.",
        "She told him to read more.", "You can sign up at the town hall until Friday evening.", "He asked them to log in before noon, and they did.",
        "Das Buch handelt von »Faust« und dem »Zauberberg« in einer langen Erzählung.", "Die Nutzungsbedingungen des Vereins wurden gestern im Rat verlesen.", "Sie wollte an diesem Abend noch weiterlesen.",
        "Il a dit «oui» puis «non» avant de quitter la salle.", "Il a dit « oui » puis « non » avant de quitter la salle", "Elle voulait partager le repas avec ses voisins.",
        "El aviso legal fue publicado ayer por el gobierno.", "Hay que compartir.", "El col·legi va il·lustrar el llibre amb dibuixos dels alumnes", "Les hores de l'excel·lent goril·la al zoo",
        "A line of prose that was wrapped by hand has the privacy policy in it and no stop",
    ]:
        assert not quality.line_fails(line), line


def test_a_document_of_quotations_is_kept(spark):
    text = "\n".join(f"Am Tag {i} las er »Faust{i}« und dann »Der Zauberberg{i}« bis in die Nacht hinein{i}." for i in range(20))
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.kept and row.lost_words == 0


def test_menus_fail():
    for line in ["Home › News › Sport › Weather today", "Start » Politik » Inland » Berlin und Umgebung", "One • two • three • four • five", "We use cookies. Read our privacy policy.", "Please accept all cookies to continue.", "Haga clic aquí", "Subscribe to our newsletter today"]:
        assert quality.line_fails(line), line
