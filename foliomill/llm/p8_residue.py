"""Problem 8: template residue and error-page text.

Labelled exemplars of residue (unfilled slots, template instructions, fillers, error pages, script notices) are indexed by token.  A
text is cut into passage windows (its sentences and lines, alone and with the next); the tokens of a window retrieve exemplars through the
inverted index, and a match counts if the window holds enough of the exemplar's TF-IDF weight and the exemplar explains enough of the
window's.  A slot of whatever name and a word over and over are tokens of their own, each an exemplar; a slot's window is itself, since it stands amid
real text.  Passages that only write about such things are held against exemplars labelled as mentions.  Token weights come from all documents.

The index lists an exemplar under its weightiest tokens only, so many that a window without any of them cannot hold enough of it.  A text
without such a token is passed over as a whole.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.plans.runtime import at_least, table

#: Share of an exemplar's weight that a window must hold, and of a window's weight that the exemplar must explain.
CONTAINMENT, COVERAGE = 0.78, 0.6
#: The same if several exemplars explain a window of another wording together: each held by so much, all of them explaining so much.
PARTLY, TOGETHER = 0.45, 0.7
#: The same of exemplars labelled as mentions.
MENTION_CONTAINMENT, MENTION_COVERAGE = 0.5, 0.35
#: Shuffled filler: so many of its words, and share of the window's weight, make a match.
POOL_WORDS, POOL_COVERAGE = 5, 0.75

#: Words of which slot names are made.
FIELD_WORDS = frozenset(
    "abstract address affiliation author authors auteur autor body caption category chapter city company conclusion contact content contributor corresponding country date datum day department description doi document edition editor email fax field figure file first footer full funding header heading id image institution introduction isbn issn issue journal keyword keywords label language last license licence list logo location main message method methods month n name nombre note number organisation organization page pages paper phone placeholder position price product project publisher reference references results role section short source string subject subtitle summary supervisor surname table text title titel titre topic type university url user username value venue version volume website word words year your zip".split()
)
_IDENT = r"[A-Za-z][\w.\- ]{0,40}?"
#: Shapes of slots that no prose has.
_SLOT = re.compile(
    r"\{\{\s*[A-Za-z_][\w.]*(?:\s*\|\s*\w+)*\s*\}\}|\$\{\s*[A-Za-z_][\w.]*\s*\}|%\([A-Za-z_]\w*\)[sd]|\{%-?\s*(?:block|include|if|endif|for|endfor|endblock|extends|set)?\b[^%\n]{0,60}%\}|<%=?[^%\n<>]{1,60}%>|\[(?:INSERT|insert|Insert|TODO|YOUR|Your|ENTER|ADD)\s[^\]\n]{2,60}\]"
)
#: Shapes that are slots only around field names.
_NAMED = re.compile(r"\[\[\s*(" + _IDENT + r")\s*\]\]|<\s*(" + _IDENT + r")\s*>|«\s*(" + _IDENT + r")\s*»|@@?(" + _IDENT + r")@@?|%%(" + _IDENT + r")%%|%([A-Z_]{3,40})%|__([A-Z][A-Z_]{2,40}?)__|\$([A-Z][A-Z_]{2,40})\$|#?\{\s*(" + _IDENT + r")\s*\}")

#: Exemplars by label, in English, French, German and Spanish.
EXEMPLARS = {
    "instruction": """
Insert figure caption here|Insert your abstract here|Insert text here|Enter your text here|Click here to enter text|Click or tap here to enter text|Type your text here|Type the title of your paper here, capitalize first letter|Type the abstract of your paper here
Your text starts here|Your text goes here|Your title here|Your name here|Abstract goes here|Text goes here|Add your text here|Add a caption here|Write your introduction here|Put your abstract here|Paper title goes here|Replace this paragraph with your own section text|Replace this text with your own
Author Name, Affiliation, E-mail address|First Author, Second Author, Affiliation|Name of the author, institution|Sample heading|Sample title|Heading text|TODO: write the conclusion|TODO: add references|TODO: insert figure|TODO write the introduction|TBD – results to be added before submission|TBD to be completed|To be added before submission|To be completed by the authors|Add references here|Figure caption here|Subtitle goes here
Légende à compléter|Cliquez ici pour saisir du texte|Insérez ici le résumé|Insérer le résumé ici|Saisissez votre texte ici|Votre texte ici|Titre de l'article ici|Saisissez le titre de votre article ici|Nom de l'auteur, établissement|Remplacez ce paragraphe par votre propre texte|À compléter avant la soumission|Résumé à insérer ici|À FAIRE : rédiger la conclusion|Le résumé vient ici
Bildunterschrift ergänzen|Klicken Sie hier, um Text einzugeben|Hier Zusammenfassung einfügen|Hier Text einfügen|Ihr Text hier|Geben Sie hier Ihren Text ein|Geben Sie hier den Titel ein|Name des Verfassers, Einrichtung|Name des Autors, Institution|Ersetzen Sie diesen Absatz durch Ihren eigenen Text|Wird vor der Einreichung ergänzt|TODO: Schluss schreiben|Zusammenfassung folgt hier|Hier Titel eingeben
Completar la leyenda|Haga clic aquí para escribir texto|Inserte aquí el resumen|Escriba aquí su texto|Su texto aquí|Escriba aquí el título de su artículo|Nombre del autor, institución|Nombre del autor, centro|Sustituya este párrafo por su propio texto|Se completará antes del envío|PENDIENTE: escribir la conclusión|El resumen va aquí
""",
    "filler": """
Lorem ipsum dolor sit amet|Lorem ipsum dolor sit amet, consectetur adipiscing elit|sed do eiusmod tempor incididunt ut labore et dolore magna aliqua|Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris|Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore|Excepteur sint occaecat cupidatat non proident|sunt in culpa qui officia deserunt mollit anim id est laborum|consectetur adipiscing elit|nisi ut aliquip ex ea commodo consequat|eu fugiat nulla pariatur
Text text text text text|Blah blah blah blah|This is dummy text|This is placeholder text used to show the layout|This is sample text without content|This is filler text|Dummy text for layout purposes only|The quick brown fox jumps over the lazy dog|asdf asdf asdf asdf|test test test test|xxx xxx xxx xxx|foo bar baz foo bar baz|This paragraph is intentionally left as filler
Ceci est un faux texte de remplissage|Ceci est un texte de remplissage|Texte d'exemple sans contenu|Faux texte sans contenu|Texte de remplissage pour la mise en page|Texte texte texte texte|Bla bla bla bla
Dies ist ein Blindtext|Hier steht nur Fülltext ohne Inhalt|Dies ist ein Platzhaltertext|Beispieltext ohne Inhalt|Blindtext Blindtext Blindtext|Nur ein Fülltext für das Layout
Este es un texto de relleno|Texto de ejemplo sin contenido|Texto de relleno para la maquetación|Texto simulado sin contenido|Texto texto texto texto
""",
    "error": """
404 Not Found|Error 404 page not found|403 Forbidden|401 Unauthorized|500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout|400 Bad Request|HTTP Error 404|Page not found|The page you requested could not be found|The page you are looking for does not exist|We could not find the page you were looking for|The requested URL was not found on this server|Error establishing a database connection|Internal server error|Bad gateway
Oops! Something went wrong|Something went wrong|An error occurred|An unexpected error has occurred|Please try again later|Try again in a few minutes|Too many requests|Access denied|You do not have permission to view this document|You do not have permission to access this page|Your session has expired|Session expired, please sign in again|Please sign in again|Please log in to continue|The PDF could not be loaded|The document could not be loaded|The file could not be loaded|Failed to load PDF document|This item has been removed or is no longer available|This content is no longer available|This page is no longer available|Service temporarily unavailable|The service is temporarily unavailable|This site is down for maintenance|The server encountered an error and could not complete your request|Return to the home page or contact the administrator|Contact the administrator if the problem persists|Request timed out|The connection has timed out|Checking that you are not a robot before the document opens|Checking your browser before accessing|If the problem persists, quote incident|Reference code|Request id|Incident number|Go back|Home Search Archive About Help Contact|Please verify that you are not a robot|Are you a robot|Rate limit exceeded
Erreur 404 – page introuvable|Page introuvable|La page demandée est introuvable|La page que vous avez demandée n'existe pas|Accès refusé|Accès interdit|Vous n'avez pas l'autorisation de consulter ce document|Votre session a expiré, veuillez vous reconnecter|Votre session a expiré|Veuillez réessayer plus tard|Veuillez vous reconnecter|Le service est momentanément indisponible|Service temporairement indisponible|Une erreur est survenue|Une erreur s'est produite|Erreur interne du serveur|Retour à l'accueil|Le document n'a pas pu être chargé|Le PDF n'a pas pu être chargé|Ce contenu n'est plus disponible|Trop de requêtes
Fehler 404 – Seite nicht gefunden|Seite nicht gefunden|Die angeforderte Seite wurde nicht gefunden|Die gewünschte Seite konnte nicht gefunden werden|Zugriff verweigert|Sie haben keine Berechtigung, dieses Dokument anzusehen|Ihre Sitzung ist abgelaufen|Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an|Bitte melden Sie sich erneut an|Bitte versuchen Sie es später erneut|Der Dienst ist vorübergehend nicht erreichbar|Es ist ein Fehler aufgetreten|Etwas ist schiefgelaufen|Interner Serverfehler|Zurück zur Startseite|Das Dokument konnte nicht geladen werden|Die PDF-Datei konnte nicht geladen werden|Dieser Inhalt ist nicht mehr verfügbar|Zu viele Anfragen|Vorgangsnummer
Error 404 – página no encontrada|Página no encontrada|La página solicitada no existe|No se ha encontrado la página solicitada|Acceso denegado|No tiene permiso para ver este documento|Su sesión ha caducado|Su sesión ha caducado, vuelva a iniciar sesión|Vuelva a iniciar sesión|Inténtelo de nuevo más tarde|El servicio no está disponible temporalmente|El servicio no está disponible en este momento|Se ha producido un error|Algo salió mal|Error interno del servidor|Volver al inicio|No se pudo cargar el documento|No se pudo cargar el PDF|Este contenido ya no está disponible|Demasiadas solicitudes
""",
    "notice": """
Please enable JavaScript to view this article|Please enable JavaScript to continue|You need to enable JavaScript to run this app|You need to enable scripts to run this app|Enable JavaScript and cookies to continue|JavaScript is disabled in your browser|JavaScript is required to view this page|This site requires JavaScript and cookies to be switched on|This page requires JavaScript|Your browser does not support scripts, so the full text cannot be shown|Your browser does not support JavaScript|Enable cookies and reload the page to continue reading|Please enable cookies and reload the page|Cookies must be enabled|Loading… if nothing happens, turn on scripting in your browser|Turn on scripting in your browser|We use cookies to improve your experience|By continuing to use this site you agree to our use of cookies|Accept all cookies|This website uses cookies
Veuillez activer JavaScript pour afficher cet article|Veuillez activer JavaScript pour continuer|Activez JavaScript et les cookies|Ce site a besoin de scripts et de cookies pour fonctionner|Ce site nécessite JavaScript|Votre navigateur ne prend pas en charge les scripts|Veuillez activer les cookies et recharger la page|Ce site utilise des cookies
Bitte aktivieren Sie JavaScript, um diesen Artikel zu lesen|Bitte aktivieren Sie JavaScript, um fortzufahren|Diese Seite benötigt Skripte und Cookies|Diese Seite benötigt JavaScript|Ihr Browser unterstützt keine Skripte|Bitte aktivieren Sie Cookies und laden Sie die Seite neu|Diese Website verwendet Cookies
Active JavaScript para ver este artículo|Active JavaScript para continuar|Por favor, active JavaScript|Este sitio necesita scripts y cookies para funcionar|Este sitio requiere JavaScript|Su navegador no admite scripts|Active las cookies y vuelva a cargar la página|Este sitio utiliza cookies
""",
    "slot": """
⟨slot⟩
""",
    "repetition": """
⟨repeat⟩
""",
    "mention": """
slots such as ⟨slot⟩ are filled in by a template engine|a template engine replaces variables such as ⟨slot⟩ when it renders a page|in the template language ⟨slot⟩ marks a variable|placeholders are replaced by values at build time|a placeholder token stands for rare or unknown words of the vocabulary|functions and classes such as ⟨slot⟩ are defined and printed in the code
lorem ipsum or filler text was used as a meaningless control condition in a reading experiment|requests and links that returned 404 Not Found or 502 Bad Gateway were left out of the crawl|of the pages fetched some returned an error such as 403 Forbidden or 500 Internal Server Error|respondents had JavaScript or cookies enabled or disabled when they opened the survey|the questionnaire asked users to enable JavaScript|share of visitors who accepted the cookie banner|interviews or sessions that timed out or expired were repeated or excluded
access denied and similar errors were a common cause of failure in the systems under audit|participants saw the message something went wrong or please try again later|TODO and FIXME comments were counted in source code|an erratum says that a value in a table should read otherwise|the article was withdrawn by its editors or authors
""",
}
#: The exemplars that are one pool: shuffled filler holds any of their words.
POOL = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|⟨slot⟩|⟨repeat⟩")
_SPLIT = re.compile(r"(?<=[.!?…])\s+|(?<=[a-zà-ÿß)][.!?])(?=[A-ZÀ-Ý])|\n+|\s[|·]\s")
SLOT, REPEAT = "⟨slot⟩", "⟨repeat⟩"
#: A word that follows itself so often is a repetition.
RUN = 4
#: Marks without which no slot is.
_MARKS = re.compile(r"[<«@{]|\[\[|\[(?:INSERT|insert|Insert|TODO|YOUR|Your|ENTER|ADD)|%[(%A-Z]|__|\$[A-Z]")
#: Codes of incidents and the like say nothing.
_CODE = re.compile(r"(?=.*\d)[0-9a-f]{4,}$")


def fill_slots(text: str) -> str:
    """The text with every unfilled slot as one token."""
    if not _MARKS.search(text):
        return text
    text = _SLOT.sub(f" {SLOT} ", text)

    def named(m: re.Match) -> str:
        name = next(x for x in m.groups() if x is not None)
        parts = re.split(r"[_\s.\-]+", name.strip().lower())
        return f" {SLOT} " if parts and all(p in FIELD_WORDS for p in parts if p) else m.group()

    return _NAMED.sub(named, text)


def tokens(passage: str) -> list[str]:
    """Words in lower case; a word (no number) RUN times or more in a row is one token, whatever the word."""
    words = _TOKEN.findall(passage.lower().replace("’", "'"))
    if not any(map(str.__eq__, words, words[RUN - 1 :])):
        return words
    out: list[str] = []
    at = 0
    while at < len(words):
        end = at + 1
        while end < len(words) and words[end] == words[at]:
            end += 1
        out += [REPEAT] if end - at >= RUN and not words[at].isdigit() else words[at:end]
        at = end
    return out


class Exemplar:
    """A labelled phrase: its tokens, and the least containment and coverage of a match."""

    def __init__(self, label: str, text: str, pool: bool = False):
        self.label, self.tokens, self.pool = label, frozenset(tokens(text)), pool
        self.containment, self.coverage = (MENTION_CONTAINMENT, MENTION_COVERAGE) if label == "mention" else (1.0, POOL_COVERAGE) if pool else (CONTAINMENT, COVERAGE)


def exemplars() -> list[Exemplar]:
    given = [Exemplar(label, one) for label, text in EXEMPLARS.items() for one in text.strip().replace("\n", "|").split("|")]
    return [x for x in given if x.tokens] + [Exemplar("filler", POOL, pool=True)]


VOCABULARY = frozenset(t for x in exemplars() for t in x.tokens)


def token_counts(documents: DataFrame) -> dict[str, int]:
    """Documents that hold each token of the exemplars (a few hundred rows), and under the empty string all documents with text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: dict[str, int] = defaultdict(int)
        for pdf in batches:
            for x in pdf["text"]:
                if x:
                    df[""] += 1
                    for t in VOCABULARY.intersection(tokens(fill_slots(x))):
                        df[t] += 1
        yield pd.DataFrame({"token": list(df), "n": list(df.values())})

    rows = documents.select("text").mapInPandas(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


class Index:
    """Inverted index of the exemplars with TF-IDF weights."""

    def __init__(self, df: dict[str, int], given: list[Exemplar] | None = None):
        n = max(df.get("", 0), 1)
        top = math.log(1 + n)
        self.all = exemplars() if given is None else given
        self.idf = {t: min(top, math.log(1 + n / (1 + df.get(t, 0)))) + 0.05 for x in self.all for t in x.tokens}
        self.plain = 0.5 * top  # a word no exemplar has
        self.weight = []
        self.postings: dict[str, list[int]] = defaultdict(list)
        for k, x in enumerate(self.all):
            weight = sum(self.idf[t] for t in x.tokens)
            # Of shuffled filler any few words will do.
            self.weight.append(weight * POOL_WORDS / len(x.tokens) if x.pool else weight)
            left, least = weight, x.containment if x.pool else min(PARTLY, x.containment)
            for t in sorted(x.tokens, key=lambda t: (-self.idf[t], t)):
                if left < least * self.weight[k] - 1e-9:  # the tokens that are left cannot make a match
                    break
                self.postings[t].append(k)
                left -= self.idf[t]
        self.residue_keys = frozenset(t for t, ks in self.postings.items() if any(self.all[k].label != "mention" for k in ks))

    def match(self, window: list[str]) -> tuple[float, str]:
        """Best score of a window (the least of containment and coverage, each against its cutoff) and its label."""
        bag = {t for t in window if not _CODE.match(t)}
        if self.residue_keys.isdisjoint(bag):
            return 0.0, ""
        total = sum(self.idf.get(t, self.plain) for t in bag)
        best = (0.0, "")
        near = []
        for k in {k for t in bag if t in self.postings for k in self.postings[t]}:
            x = self.all[k]
            held = sum(self.idf[t] for t in x.tokens & bag)
            share = held / self.weight[k]
            # A slot is a window of its own.
            score = min(share / x.containment, (held / total if x.label != "slot" else 1.0) / x.coverage)
            if x.label == "mention":
                score = score + 0.5 if share >= x.containment else 0.0
            elif not x.pool and x.label != "slot" and share >= PARTLY:
                near.append((share, x))
            best = max(best, (score, x.label))
        if best[0] < 1 and best[1] != "mention" and near:
            held = sum(self.idf[t] for t in frozenset().union(*(x.tokens for _, x in near)) & bag)
            share, x = max(near, key=lambda y: (y[0], y[1].label))
            best = max(best, (min(share / PARTLY, held / total / TOGETHER), x.label))
        return best


def passages(text: str) -> list[str]:
    return [p for p in (x.strip() for x in _SPLIT.split(fill_slots(text))) if p]


def residue(text: str, index: Index) -> tuple[float, str]:
    """Score (a case from 1 on) and kind of the strongest residue of a text."""
    best = (0.0, "")
    filled = fill_slots(text)
    if index.residue_keys.isdisjoint(tokens(filled)):
        return best
    parts = [t for t in map(tokens, passages(text)) if t]
    for k, part in enumerate(parts):
        score, label = index.match(part)
        if score < 1 and k + 1 < len(parts) and label != "mention":
            score, label = max((score, label), index.match(part + parts[k + 1]))
        if label != "mention":
            best = max(best, (score, label))
    return best


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, score, kind), a row each row of documents; a case has a score of 1 or more.

    A null, empty or blank text scores 0; texts are read whole; repeated rows stay; an empty table gives an empty result; other
    columns are ignored."""
    spark = documents.sparkSession
    counts = spark.sparkContext.broadcast(token_counts(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(counts.value)
        for pdf in batches:
            done = [residue(x, index) if x and not x.isspace() else (0.0, "") for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [s for s, _ in done], "kind": [k for _, k in done]})

    # Ids travel as text: a null among long integers would turn a batch's ids into floats.
    rows = at_least(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return rows.mapInPandas(run, "doc_id string, score double, kind string").withColumn("doc_id", F.col("doc_id").cast("long"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents", ["doc_id", "text"])).filter("score >= 1 and doc_id is not null").select("doc_id").distinct()


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left, without their texts."""
    rows = table(spark, sf_dir, "documents", ["doc_id", "text", "source", "lang"])
    return rows.select("doc_id", "source", "lang").join(judged(rows).filter("score >= 1").select("doc_id").distinct(), "doc_id", "left_anti")
