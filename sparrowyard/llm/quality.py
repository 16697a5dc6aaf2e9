"""Quality rules, line first: judge each line, remove failing lines, then judge what a document lost.

Only built-in SQL functions run here. A text is judged whole, in one row, without a shuffle, so the
work is one narrow pass whatever the sources or copies look like.

Defined results: a null or empty text has no words and fails (too few words). Ties do not occur;
repeated rows are judged alike, each by itself. An empty table gives an empty table. ``clean`` keeps
all other columns whatever their names, because its own figures live in one struct column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowyard.llm.common import words_of

#: Symbols that count as junk when they crowd a text.
SYMBOLS = "#*$%&|<>"

#: Phrases of page furniture in English, French, German and Spanish; a short line with one of them is boilerplate.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "accept cookies", "we use cookies",
    "enable javascript", "subscribe to our newsletter", "sign up for our newsletter", "share this article", "follow us on", "click here", "powered by",
    "tous droits réservés", "conditions d'utilisation", "conditions générales", "politique de confidentialité", "politique de cookies", "accepter les cookies",
    "utilise des cookies", "activer javascript", "abonnez-vous à", "inscrivez-vous à", "partager cet article", "suivez-nous sur", "cliquez ici", "propulsé par",
    "alle rechte vorbehalten", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "cookie-richtlinie", "cookies akzeptieren",
    "verwendet cookies", "javascript aktivieren", "newsletter abonnieren", "artikel teilen", "folgen sie uns", "hier klicken", "bereitgestellt von",
    "todos los derechos reservados", "términos de servicio", "términos de uso", "condiciones de uso", "política de privacidad", "política de cookies",
    "aceptar cookies", "utiliza cookies", "activar javascript", "suscríbete a", "comparte este artículo", "síguenos en", "haz clic aquí", "desarrollado por",
)

#: Labels that make up menus, in the same languages.
NAVIGATION = (
    "home", "about", "about us", "contact", "contact us", "login", "log in", "sign in", "sign up", "register",
    "menu", "search", "next", "previous", "read more", "skip to content", "back to top", "sitemap",
    "accueil", "à propos", "nous contacter", "connexion", "se connecter", "s'inscrire", "rechercher", "suivant", "précédent", "lire la suite", "haut de page", "plan du site",
    "startseite", "über uns", "kontakt", "anmelden", "registrieren", "suche", "weiter", "zurück", "weiterlesen", "zum inhalt", "nach oben", "impressum",
    "inicio", "acerca de", "contacto", "iniciar sesión", "registrarse", "buscar", "siguiente", "anterior", "leer más", "ir al contenido", "volver arriba", "mapa del sitio",
)

#: A menu may also stand as this many label lines, one below the other, in any language.
MENU_LINES = 4
_LABEL_MARKS = ".!?;:,"


def _any_of(phrases: tuple[str, ...]) -> str:
    """A pattern for any of the phrases where a word begins, with common beginnings written once."""
    firsts = sorted({p[0] for p in phrases})
    rest = lambda a: "|".join(re.escape(p[1:]).replace(r"\ ", " ").replace(r"\-", "-") for p in phrases if p[0] == a)
    return r"(?:^|[^\p{L}])(?:" + "|".join(f"{a}(?:{rest(a)})" for a in firsts) + ")"


FURNITURE = _any_of(BOILERPLATE)


def facts(text: Column) -> Column:
    """What line rules ask of the whole text first, so that most lines are spared the dearer tests."""
    furniture = F.lower(text).rlike(FURNITURE)
    separated = text.contains("|") | text.contains("»") | text.contains(">")
    marks = F.length(text) - F.length(F.translate(text, SYMBOLS + "!", ""))
    return F.struct(furniture.alias("furniture"), separated.alias("separated"), marks.alias("marks"))


def sized(lines: Column) -> Column:
    """Lines with their count of words, and whether each may be a label: one to three words without sentence marks."""
    counted = F.transform(lines, lambda x: F.struct(x.alias("t"), F.size(words_of(x)).alias("n")))
    label = lambda x: x["n"].between(1, 3) & (F.length(F.translate(x["t"], _LABEL_MARKS, "")) == F.length(x["t"]))
    return F.transform(counted, lambda x: F.struct(x["t"].alias("t"), x["n"].alias("n"), label(x).alias("label")))


def line_fails(line: Column, n: Column, about: Column) -> Column:
    """True for a line of n words that a rule removes; blank lines never fail. ``about``: the ``facts`` of the text.

    * punctuation: ``[#*$%&|<>]`` or ``!`` come as often as one in every two words or more (ten words or
      more), a line of three characters or more has no letter or digit, or 40 words run on without any mark;
    * navigation: the line is a menu label, or three or more labels of at most three words between ``|``, ``»`` or ``>``;
    * boilerplate: at most 25 words with a phrase of page furniture where a word begins.
    """
    trimmed, low = F.trim(line), F.lower(F.trim(line))
    crowded = (n >= 10) & (about["marks"] * 2 >= n) & ((F.length(line) - F.length(F.translate(line, SYMBOLS + "!", ""))) * 2 >= n)
    bare = (F.length(trimmed) >= 3) & ~line.rlike(r"[\p{L}\p{N}]")
    run_on = (n >= 40) & ~line.rlike(r"[\p{P}]")
    label = (n <= 3) & low.isin(*NAVIGATION)
    part = r"[^|»>\s]+(?:\s[^|»>\s]+){0,2}"
    menu = about["separated"] & (n <= 40) & (line.contains("|") | line.contains("»") | line.contains(">")) & low.rlike(rf"^{part}(?:\s?[|»>]\s?{part}){{2,}}$")
    furniture = about["furniture"] & (n <= 25) & low.rlike(FURNITURE)
    return (n > 0) & (crowded | bare | run_on | label | menu | furniture)


def _in_menu(lines: Column, i: Column) -> Column:
    """Whether line i is one of ``MENU_LINES`` or more label lines in a row."""
    at = lambda k: F.coalesce(F.get(lines, i + k)["label"], F.lit(False))
    out = F.lit(False)
    for first in range(1 - MENU_LINES, 1):
        run = F.lit(True)
        for k in range(first, first + MENU_LINES):
            run = run & at(k) if k else run
        out = out | run
    return out


def _covered(starts: Column) -> Column:
    """Positions that 3-word windows at these ascending starts cover."""
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    return F.aggregate(
        starts,
        first,
        lambda a, s: F.struct((a["n"] + F.least(F.lit(3).cast("long"), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )


#: Bits of a window's place in a packed number; the 43 bits above them are of the window's hash.
_PLACE = 20


def _packed_windows(w: Column, h: Column) -> tuple:
    """For the 3-word windows of ``w`` with hashes ``h``: sorted numbers, and what tells equal hashes, equal words and places of two numbers.

    Hash and place are packed into one number and sorted, so equal hashes are neighbours. Neighbours are then
    compared by their words: where hashes agree and words do not, or a text has over 2 ** 20 words, the windows
    themselves are sorted instead. So equality is that of the words.
    """
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
    same = lambda x, y: F.coalesce(x.bitwiseXOR(y) < (1 << _PLACE), F.lit(False))
    words = lambda x, y: (F.get(w, place(x)) == F.get(w, place(y))) & (F.get(w, place(x) + 1) == F.get(w, place(y) + 1)) & (F.get(w, place(x) + 2) == F.get(w, place(y) + 2))
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(((1 << 63) - 1) ^ ((1 << _PLACE) - 1))).bitwiseOR(i.cast("long"))))
    return packed, same, words, place


def _by_words(w: Column) -> Column:
    """The same by the windows themselves."""
    windows = F.array_sort(F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("x"), i.cast("long").alias("i"))))
    at = lambda s, k: F.get(s, k)["x"]
    twice = F.filter(F.transform(windows, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(x["x"] == at(windows, k - 1), F.lit(False)) | F.coalesce(x["x"] == at(windows, k + 1), F.lit(False))).alias("d"))), lambda x: x["d"])
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def figures(docs: DataFrame, text: str = "text", max_lost: float = 0.5, min_words: int = 50) -> DataFrame:
    """``docs`` packed as struct ``row`` with struct ``q``: the figures, the verdict and the cleaned text.

    A document is rejected when it has under ``min_words`` words, when words in repeated 3-word windows
    are over half of its words, or when failing lines hold over ``max_lost`` of its characters.
    """
    t = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"))
    df = df.select("row", words_of(t).alias("w"), sized(F.split(t, "\n")).alias("lines"), facts(t).alias("about"))
    df = df.select(
        "row", "w",
        F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["t"]).alias("full"),
        F.transform("lines", lambda x, i: F.struct(x["t"].alias("t"), (line_fails(x["t"], x["n"], F.col("about")) | (x["label"] & _in_menu(F.col("lines"), i))).alias("bad"))).alias("judged"),
        F.when(
            F.size("w") >= 3,
            F.transform(F.slice("w", F.lit(1), F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    packed, same, words, place = _packed_windows(F.col("w"), F.col("h"))
    df = df.select("row", "w", "full", F.filter("judged", lambda x: x["bad"]).alias("lost"), "judged", F.when((F.size(F.array_distinct("h")) < F.size("h")) & (F.size("h") < 1 << _PLACE), packed).alias("s"), F.size("h").alias("n_windows"))
    df = df.select("row", "w", "full", "lost", "judged", "n_windows", F.filter("s", lambda x, k: same(x, F.get("s", k + 1)) | same(x, F.get("s", k - 1))).alias("twice"))
    other = F.exists(F.transform("twice", lambda x, k: same(x, F.get("twice", k - 1)) & ~words(x, F.get("twice", k - 1))), lambda x: x)
    starts = F.when((F.col("n_windows") >= 1 << _PLACE) | F.coalesce(other, F.lit(False)), _by_words(F.col("w"))).otherwise(F.sort_array(F.transform("twice", lambda x: place(x).cast("long"))))
    n = F.size("w").cast("long")
    df = df.select(
        "row",
        n.alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(starts), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.aggregate("lost", F.lit(0).cast("long"), lambda a, x: a + F.length(x["t"])).alias("lost_chars"),
        (F.length(t) - F.size("judged") + 1).cast("long").alias("line_chars"),
        F.when(F.size("lost") > 0, F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["t"]), "\n")).otherwise(t).alias("cleaned"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    lost = F.col("lost_chars") > F.col("line_chars") * max_lost
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")
    return df.select("row", F.struct(*names, failed.alias("base_failed"), (~failed & ~lost).alias("kept"), "cleaned").alias("q"))


def clean(docs: DataFrame, text: str = "text", max_lost: float = 0.5, min_words: int = 50) -> DataFrame:
    """Kept documents with failing lines removed; columns as given (``n_chars`` follows the text where it exists)."""
    # an explode, not a filter: the optimizer would push a filter down and repeat the rules in it
    found = figures(docs, text, max_lost, min_words)
    kept = found.select(F.explode(F.when(F.col("q.kept"), F.array(F.struct("row", F.col("q.cleaned").alias("cleaned")))).otherwise(F.array())).alias("x"))
    new = {text: F.col("x.cleaned"), "n_chars": F.length("x.cleaned").cast("long")}
    return kept.select(*[(new[c] if c in new else F.col("x.row")[c]).alias(c) for c in docs.columns])
