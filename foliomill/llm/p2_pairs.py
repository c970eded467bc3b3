"""Problem 2: broken prompt and response pairs.

Every answer of either origin is joined with its prompt and shown to noisy labelling functions, some for each defect.  The
counts of their vote patterns (a few hundred rows whatever the corpus) train one expectation-maximisation label model a defect;
posteriors go back to the answers by their pattern.  The cutoffs are validated on labelled rows: a bounded sample of pairs, into each of
which one defect is put.  Labels whose posterior reaches the defect's cutoff are kept, also several of one answer (``p2_labels``); ``p2_found``
names the severest of them.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import closing, labelmodel, language
from foliomill.llm.p1_truncation import terminality_table
from foliomill.plans.runtime import cut, table

#: Order of severity.
DEFECTS = ("empty", "refusal", "copied_prompt", "other_language", "truncated")

_FENCE = re.compile(r"```\w*")
_NULLS = re.compile(r"\b(?:null|none|nil|undefined|n/?a|nan)\b", re.I)
_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W_]")
_WRAPPER = re.compile(r"^(?:\W*(?:note|answer|response|output|assistant|réponse|antwort|respuesta|hinweis|nota|remarque)\W*:\W*)+|^[\W_]+", re.I)
#: Openings of refusals.
_OPENING = re.compile(
    r"^(?:(?:i'?m |i am |we are |we're )?(?:so |very |terribly )?sorry\b|unfortunately|regrettably|i apologi[sz]e|apologies|my apologies|i regret|i'?m afraid|thank you for (?:the|your)|as an? (?:\w+ ){0,2}(?:assistant|model|ai)|i must (?:point out|inform|decline)|i(?:'d| would) rather not|i(?:'m| am) (?:not able|unable|not allowed)|i (?:can(?:no|')?t|cannot|can not|won't|will not|do not|don't|must|have to)|my guidelines|my instructions|request (?:declined|denied|refused)|no comment|no answer|not possible"
    r"|leider|bedaure|es tut mir (?:sehr )?leid|tut mir leid|entschuldig|ich bedaure|verzeih|als (?:\w+)?(?:assistent|sprachmodell|ki)|ich (?:kann|darf|bin nicht|möchte nicht|habe kein)|anfrage abgelehnt"
    r"|malheureusement|je suis (?:vraiment )?désolée?|désolée?|navrée?|je regrette|je m'excuse|en tant qu|je ne (?:peux|suis|puis|dispose)|il m'est impossible|demande refusée|mes consignes|pardon"
    r"|lo siento|lo lamento|lamentablemente|disculpe|desafortunadamente|por desgracia|perdón|como (?:asistente|modelo)|no (?:puedo|me es posible|tengo acceso|estoy)|me resulta imposible|debo (?:negarme|rechazar)|solicitud rechazada)",
    re.I,
)
#: Clauses that deny an answer.
_DENIAL = re.compile(
    r"\b(?:i|we|me|my)\b[^.!?]{0,60}\b(?:can(?:no|')?t|cannot|can not|unable to|not able to|won't|will not|decline to|refuse to|rather not|not allowed to|not permitted|do not have the ability|don't have (?:the ability|access)|have no access)\b|not possible for me|beyond what i am|keep me from|no image was provided|i can give no|request (?:declined|denied|refused)|no (?:comment|answer) can be given|not something i can|against my (?:guidelines|policy)"
    r"|(?:kann|darf|habe|bin|ist|möchte|muss)\b[^.!?]{0,60}\b(?:nicht|kein\w*|ablehnen)\b|nicht möglich|ablehnen"
    r"|\b(?:je|m')[^.!?]{0,20}(?:ne peux|ne puis|n'ai pas|ne suis pas|dois refuser|refuse)|m'est impossible|pas en mesure|ne m'est pas possible|pas accès"
    r"|no puedo|no me es posible|me resulta imposible|debo negarme|me niego|no tengo acceso|no estoy autorizad|no se me permite|no es posible",
    re.I,
)
#: What refusals offer or plead, in lower case.
OFFERS = (
    "qualified expert", "something else i can", "help with something else", "help with anything else", "help you with something else", "help you with anything else", "upload the document", "content policy", "my guidelines", "beyond what i am permitted", "attached figure", "no image was provided", "request declined",
    "anders helfen", "wenden sie sich", "fachperson", "keinen zugriff auf das bild", "auskunft geben", "anfrage nicht",
    "vous aider autrement", "consulter un spécialiste", "image jointe", "à cette demande", "refuser de commenter",
    "ayudarle con otra", "consulte a un", "imagen adjunta", "esta solicitud", "negarme a comentar",
)
#: Turns after which an answer follows all the same.
_YET = re.compile(r"\b(?:but (?:it|the|they|here|there)\b|; there (?:was|were|is)|however,? (?:it|the)|nevertheless|aber (?:es|die|der|das) (?!mir)|mais (?:il|elle|la|le) |pero (?:el|la|era|trataba))", re.I)


_IMPOSSIBLE = re.compile(r"not possible|impossible|nicht möglich|imposible", re.I)


def leaves(value) -> Iterator[str]:
    if isinstance(value, dict):
        for x in value.values():
            yield from leaves(x)
    elif isinstance(value, list):
        for x in value:
            yield from leaves(x)
    elif isinstance(value, str):
        yield value
    elif value is not None:
        yield str(value)


def content(text: str) -> str:
    """The answer's own words: of JSON the string values but names of categories, else the text without fences."""
    s = (_FENCE.sub("", text) if "```" in text else text).strip()
    if s[:1] in ("[", "{"):
        try:
            return "\n".join(x for x in leaves(json.loads(s)) if not re.fullmatch(r"[a-z]+(?:_[a-z]+)+|true|false|True|False", x))
        except ValueError:
            return "\n".join(x for x in re.findall(r'"([^"\\]*(?:\\.[^"\\]*)*)"?(?!\s*:)', s) if " " in x)
    return s


def vote(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


#: Words of which nulls are made.
NULL_WORDS = frozenset(("null", "none", "nil", "undefined", "n", "a", "na", "nan"))


def says(text: str) -> bool:
    """True if a letter or digit is left without nulls."""
    if any(m[0].lower() not in NULL_WORDS and m[0].strip("_") for m in _WORD.finditer(text)):
        return True
    return bool(_LETTERS.search(_NULLS.sub("", text)))


def empty_votes(text: str | None, inner: str) -> tuple[int, ...]:
    """By letters at all, by what is left without nulls, by what JSON or fences hold, by length."""
    s = text or ""
    bare = _FENCE.sub("", s) if "```" in s else s
    has, left = bool(_LETTERS.search(bare)), says(bare)
    held = says(inner)
    n = len(s.strip())
    return vote(not has, has), vote(not left, left), vote(not held, held), vote(n <= 1, n > 25)


#: Pieces of words without which nothing is denied, in lower case.
DENYING = (
    "can't", "cant ", "cannot", "can not", "unable to", "able to", "won't", "will not", "decline", "refuse", "rather not", "not allowed", "not permitted", "the ability", "have access", "no access", "not possible", "beyond what i am", "keep me from", "was provided", "give no", "denied", "be given", "something i can", "against my",
    "nicht", "kein", "ablehnen", "ne peux", "ne puis", "n'ai pas", "ne suis", "refuse", "impossible", "pas en mesure", "pas possible", "pas accès", "no puedo", "imposible", "debo negarme", "me niego", "no tengo acceso", "no estoy autorizad", "no se me permite", "es posible",
)
#: Both lists in one automaton; its values are 1 for a denial's piece and 2 for an offer.
_HINTS = ahocorasick.Automaton()
for _bit, _texts in ((1, DENYING), (2, OFFERS)):
    for _text in _texts:
        _HINTS.add_word(_text, _HINTS.get(_text, 0) | _bit)
_HINTS.make_automaton()
#: Who denies.
_SPEAKER = re.compile(r"\b(?:i|me|my|ich|mir|mich|je|mes|yo|mis|puedo|me|debo)\b|\bm'|\bj'", re.I)


def refusal_votes(inner: str) -> tuple[int, ...]:
    """By opening, by a denial in the first sentence, by one in a later sentence, by what is offered or pleaded, by length, and by an answer that
    follows all the same."""
    s = _WRAPPER.sub("", inner.strip())
    s = s.replace("’", "'").lstrip("*\"'“«> ")
    n = len(s.split())
    sentences = [x for x in _SENTENCES.split(s) if x]
    first = sentences[0] if sentences else ""
    hints = 0
    for _, hint in _HINTS.iter(s.lower()):
        hints |= hint
    may = bool(hints & 1)
    denies = may and bool(_DENIAL.search(first))
    yet = _YET.search(first) if denies else None
    # Told of others or quoted, or followed by an answer all the same, a denial is none.
    answered = bool(yet) and not _IMPOSSIBLE.search(first[yet.end() :]) and not _DENIAL.search(first[yet.start() :])
    told = bool(_QUOTED.search(first)) or bool(_OTHERS.match(s))
    later = may and any(_SPEAKER.search(x) and _DENIAL.search(x) for x in sentences[1:] if any(y in x.lower() for y in DENYING))
    return (
        vote(bool(_OPENING.match(s)), True),
        vote(denies and not answered and not told, True),
        vote(later, False),
        vote(bool(hints & 2), n > 35),
        vote(0 < n <= 35 and len(sentences) <= 3, n > 45 or len(sentences) > 4 or n == 0),
        vote(False, answered or told),
    )


_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_QUOTED = re.compile(r"[“\"«][^”\"»]*(?:sorry|cannot|can't|désolé|leider|lo siento)", re.I)
_OTHERS = re.compile(r"(?:we|the authors)\b", re.I)
_ECHO = re.compile(r"\W*(?:q|question|user|prompt|task|answer|frage|pregunta|system|instruction)\W*[:\n]", re.I)
_ECHO_END = re.compile(r"\b(?:answer|antwort|réponse|respuesta)\s*:?\s*$", re.I)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@functools.lru_cache(maxsize=4096)
def prompt_words(prompt: str) -> tuple[frozenset[str], frozenset[tuple[str, str]], str]:
    """The words of a prompt, its pairs of words, and its words as one text."""
    p = _WORD.findall(prompt.lower())
    return frozenset(p), frozenset(zip(p, p[1:])), " ".join(p)


def copied_votes(prompt: str, inner: str, words: list[str]) -> tuple[int, ...]:
    """By the share of its words that the prompt has, by its pairs of words, by being a piece of the prompt, and by its end, which an answer that goes on
    after the question has of its own.  An answer of fewer than four words is told by none of these."""
    a, begin, end = words, _ECHO.match(inner), _ECHO_END.search(inner, max(0, len(inner) - 24))
    if begin or end:
        a = _WORD.findall(inner[begin.end() if begin else 0 : end.start() if end else None].lower())
    if len(a) < 4:
        return 0, 0, -1, 0
    have, pairs, sp = prompt_words(prompt)
    share = sum(map(have.__contains__, a)) / len(a)
    run = sum(map(pairs.__contains__, zip(a, a[1:]))) / (len(a) - 1)
    middle = len(a) // 2
    # A piece of the prompt has all its words there, but for those broken at the ends of its halves.
    inside = share * len(a) >= len(a) - 4 and (" ".join(a) in sp or " ".join(a[: (len(a) + 1) // 2]) in sp and " ".join(a[middle:]) in sp)
    end = sum(map(pairs.__contains__, zip(a[-4:], a[-3:])))
    return vote(share >= 0.82, share < 0.7), vote(run >= 0.6, run < 0.5), vote(inside, share < 0.75), vote(end == 3, end < 2)


def language_votes(want: str | None, inner: str, words: list[str]) -> tuple[int, ...]:
    """By function words, by letter groups (those of the language that the words tell against those of the wanted one), and by the function words of either
    half; no opinion where the wanted language is unknown."""
    if want not in language.LANGUAGES:
        return 0, 0, 0
    known = language.weights(words)
    n, half = len(known), len(known) // 2
    left, right = language.sums(known[:half]), language.sums(known[half:])
    both = tuple(map(sum, zip(left, right))) if left and right else left or right
    lang, lead = language.best_of(both, n)
    weak = n < 5
    if lang is None:
        other, own = 0.0, float(language.by_letters(inner)[0] == want)
    elif lang == want:
        other, own = 0.0, language.letters_of(inner, (want,))[0]
    else:
        other, own = language.letters_of(inner, (lang, want))
    sides = [] if n < 16 else [x for x, e in (language.best_of(left, half), language.best_of(right, n - half)) if e > 0.03]
    return (
        vote(not weak and lang is not None and lang != want and lead > 0.04, lang == want and lead > 0.0),
        vote(not weak and other > own + 0.05, own > other),
        vote(bool(sides) and want not in sides, want in sides),
    )


_ENDS = re.compile(r"[.!?。！？:\]})\"'”’»`*_]$")


def truncated_votes(text: str | None, terminality: float, tokens, budget, usual: float | None) -> tuple[int, ...]:
    """By the terminality of the closing, by open brackets and fences or the last mark, by the token limit, and by the tokens spent on so short a text."""
    s = closing.strip_marks(text or "")[0]
    body = s.lstrip()
    bare = _FENCE.sub("", body).strip()
    if closing.kind_of(body) in ("json", "fence") and bare[:1] in ("[", "{"):
        ends = not closing.json_open(bare) and body.count("```") % 2 == 0
    else:
        ends = bool(_ENDS.search(s))
    known = tokens is not None and tokens == tokens and usual is not None and len(s) > 20
    limit = known and budget is not None and budget == budget and tokens >= budget
    much = known and tokens > usual * len(s)
    return vote(terminality < closing.CUTOFF, True), vote(bool(s) and not ends, bool(s)), vote(limit, False), vote(much, known and not limit)


def encode(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def decode(code: int, k: int) -> list[int]:
    out = []
    for _ in range(k):
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


#: Labelling functions a defect.
FUNCTIONS = {"empty": 4, "refusal": 6, "copied_prompt": 4, "other_language": 3, "truncated": 4}


def answer_pairs(results: DataFrame, interpretations: DataFrame, requests: DataFrame) -> DataFrame:
    """(origin, pair_id, prompt, text, tokens, budget) of the answers whose request exists and has a prompt."""
    answers = results.select(F.lit("result").alias("origin"), F.col("result_id").alias("pair_id"), "request_id", "text", F.col("generated_tokens").alias("tokens")).unionByName(
        interpretations.select(F.lit("interpretation").alias("origin"), F.col("interpretation_id").alias("pair_id"), F.col("metadata.request_id").alias("request_id"), "text", F.lit(None).cast("int").alias("tokens"))
    )
    prompts = requests.select("request_id", "prompt", F.col("max_tokens").alias("budget")).filter("prompt is not null and request_id is not null")
    return answers.filter("request_id is not null and pair_id is not null").join(prompts, "request_id").select("origin", "pair_id", "prompt", "text", "tokens", "budget")


def votes_of(prompt: str, text: str | None, tokens, budget, model: tuple, usual: float | None) -> dict[str, tuple[int, ...]]:
    """The votes for each defect of one answer."""
    inner = content(text) if text else ""
    whole = closing.score(text, *model)
    words = words_of(inner)
    # A piece of a word has no language.
    known = words[:-1] if whole < closing.CUTOFF else words
    return {
        "empty": empty_votes(text, inner),
        "refusal": refusal_votes(inner),
        "copied_prompt": copied_votes(prompt, inner, words),
        "other_language": language_votes(language.expected(prompt), inner, known),
        "truncated": truncated_votes(text, whole, tokens, budget, usual),
    }


def votes(pairs: DataFrame, model: Broadcast, usual: float | None) -> DataFrame:
    """A code of the votes for each defect, a row each answer."""
    schema = "origin string, pair_id long, " + ", ".join(f"{d} int" for d in DEFECTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for prompt, text, tokens, budget in zip(pdf["prompt"], pdf["text"], pdf["tokens"], pdf["budget"]):
                by = votes_of(prompt, text, tokens, budget, model.value, usual)
                rows.append([encode(by[d]) for d in DEFECTS])
            out = pdf[["origin", "pair_id"]].copy()
            out[list(DEFECTS)] = np.array(rows, dtype=np.int32).reshape(-1, len(DEFECTS))
            yield out

    return pairs.mapInPandas(run, schema)


#: Pairs of the labelled sample: a bound, whatever the corpus.
LABELLED = 1500
#: Answers that are none, for the labelled sample.
EMPTY_FORMS = ("", "  \n", "[]", "{}", "null", "```json\n[]\n```", '{"cues": []}', "-", "...", "```\n```", '[""]', "N/A", '{"textual": null}', "[ { } ]")
#: Refusals by language, for the labelled sample.
REFUSALS = {
    "en": (
        "I'm sorry, but I am unable to describe this paper.",
        "Sorry, I can't answer that.",
        "I cannot help with this request. Please ask something else.",
        "As a language model, I do not have access to the document.",
        "Unfortunately I won't be able to provide a summary of this text.",
        "I must decline to answer this question.",
        "I am afraid I cannot give an answer to this.",
        "My instructions do not permit me to comment on this figure; I cannot help.",
    ),
    "de": (
        "Leider kann ich diese Frage nicht beantworten.",
        "Es tut mir leid, dazu kann ich nichts sagen, ich darf es nicht.",
        "Als Sprachmodell habe ich keinen Zugriff auf die Abbildung.",
        "Ich kann dieser Bitte nicht nachkommen.",
    ),
    "fr": (
        "Désolé, je ne peux pas répondre à cette question.",
        "Je suis désolé, mais il m'est impossible de résumer ce texte.",
        "Malheureusement, je ne peux pas décrire cette figure.",
        "Je ne suis pas en mesure de répondre.",
    ),
    "es": (
        "Lo siento, no puedo responder a esta pregunta.",
        "Lamentablemente no puedo ayudarle con este texto.",
        "Como modelo de lenguaje, no tengo acceso a la figura.",
        "Me resulta imposible describir este artículo.",
    ),
}


def changed(text: str, rng: random.Random) -> str:
    """The text with one of its words replaced by another of them."""
    words = text.split()
    if len(words) > 1:
        words[rng.randrange(len(words))] = rng.choice(words)
    return " ".join(words)


def labelled(pairs: list[tuple[str, str]]) -> list[tuple[int, str, str, str]]:
    """(pair, prompt, answer, defect) of (prompt, answer) pairs: of each the answer as it is, without a label, and one with a defect put into it,
    defects by turns.  A cut falls inside a word; a copy is the whole prompt or its first line; another language is that of another pair."""
    rng = random.Random(len(pairs))
    wanted = [language.expected(p) for p, _ in pairs]
    out = []
    for k, (prompt, text) in enumerate(pairs):
        out.append((k, prompt, text, ""))
        defect = DEFECTS[k % len(DEFECTS)]
        if defect == "empty":
            bad = rng.choice(EMPTY_FORMS)
        elif defect == "refusal":
            bad = rng.choice(REFUSALS.get(wanted[k], REFUSALS["en"]))
        elif defect == "copied_prompt":
            bad = rng.choice([prompt, prompt.split("\n")[0], prompt.upper(), f"Question: {prompt}", changed(prompt.split("\n")[0], rng)])
        elif defect == "other_language":
            others = [j for j in rng.sample(range(len(pairs)), min(20, len(pairs))) if wanted[j] and wanted[k] and wanted[j] != wanted[k] and content(pairs[j][1]).count(" ") > 12]
            if not others:
                continue
            bad = pairs[others[0]][1]
        else:
            inside = [i for i in range(len(text) // 3, len(text)) if text[i - 1 : i + 1].isalpha()]
            if not inside:
                continue
            bad = text[: rng.choice(inside)]
        out.append((k, prompt, bad, defect))
    return out


def sample_pairs(results: DataFrame, requests: DataFrame) -> list[tuple[str, str]]:
    """(prompt, answer) of the LABELLED requests of least hash that have an answer with text; of an answer's repeats the least."""
    some = requests.filter("prompt is not null and request_id is not null").select("request_id", "prompt").orderBy(F.xxhash64("request_id"), "request_id").limit(LABELLED)
    rows = results.filter("text is not null").select("request_id", "text").join(F.broadcast(some), "request_id").groupBy("request_id").agg(F.min("prompt").alias("prompt"), F.min("text").alias("text"))
    return [(r["prompt"], r["text"]) for r in rows.orderBy("request_id").collect()]


def posteriors(voted: DataFrame, sample: list[dict[str, tuple[int, ...]]], pair: list[int], truth: list[str]) -> DataFrame:
    """(defect, code, posterior, cutoff): the label models' verdict on each vote pattern seen, at most 3^6 rows a defect, and the cutoffs validated on the
    labelled sample: its votes, and of each row the pair it comes from and the defect put into it (none for an answer as it is)."""
    spark = voted.sparkSession
    long = voted.select(F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("code")) for d in DEFECTS))).alias("x")).groupBy("x.defect", "x.code").agg(F.count("*").alias("n"))
    seen = long.toPandas()
    patterns, models, judged = {}, {}, {}
    for d in DEFECTS:
        part = seen[seen["defect"] == d]
        patterns[d] = np.array([decode(int(c), FUNCTIONS[d]) for c in part["code"]]).reshape(-1, FUNCTIONS[d])
        models[d] = labelmodel.fit(patterns[d], part["n"].to_numpy())
        judged[d] = models[d].posterior(np.array([v[d] for v in sample]).reshape(-1, FUNCTIONS[d]))
    # A pair whose answer the models take for a case as it is tells nothing about the defect put into it.
    doubtful = {k for d in DEFECTS for k, t, p in zip(pair, truth, judged[d]) if not t and p >= 0.5}
    sure = np.array([k not in doubtful for k in pair], bool)
    label = np.array(truth, dtype=object)
    rows = []
    for d in DEFECTS:
        cut_at = labelmodel.validated_cutoff(judged[d][sure], label[sure] == d, models[d].share) if sure.any() else 0.5
        rows += [(d, int(c), float(p), cut_at) for c, p in zip(seen[seen["defect"] == d]["code"], models[d].posterior(patterns[d]))]
    return spark.createDataFrame(rows, "defect string, code int, posterior double, cutoff double")


def defects(results: DataFrame, interpretations: DataFrame, requests: DataFrame) -> DataFrame:
    """(origin, pair_id, defect, posterior): every label whose posterior reaches its cutoff, several for one answer if so.

    Answers without a request, or whose prompt is null, and rows with null ids are left out; a null text is an empty answer;
    repeated rows count once; texts are judged whole; empty tables give an empty result; other columns are ignored."""
    texts = results.select("text").unionByName(interpretations.select("text"))
    table_of = terminality_table(texts)
    usual = results.filter("generated_tokens is not null and length(text) > 20").agg(F.percentile_approx(F.col("generated_tokens") / F.length("text"), USUAL, 10_000)).first()[0]
    voted = cut(votes(answer_pairs(results, interpretations, requests), table_of, usual).dropDuplicates(["origin", "pair_id"]))
    sample = labelled(sample_pairs(results, requests))
    known = [votes_of(prompt, text, None, None, table_of.value, usual) for _, prompt, text, _ in sample]
    long = voted.select("origin", "pair_id", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("code")) for d in DEFECTS))).alias("x")).select("origin", "pair_id", "x.defect", "x.code")
    # The verdicts are at most a few thousand rows, so they are sent to every executor.
    return long.join(F.broadcast(posteriors(voted, known, [x[0] for x in sample], [x[3] for x in sample])), ["defect", "code"]).filter("posterior >= cutoff").select("origin", "pair_id", "defect", "posterior")


#: Share of the answers that have at most the usual tokens a character: nearly all but those that were cut afterwards.
USUAL = 0.95


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "generation_results", ["result_id", "request_id", "text", "generated_tokens"]),
        table(spark, sf_dir, "interpretation_records", ["interpretation_id", "text", "metadata"]),
        table(spark, sf_dir, "generation_requests", ["request_id", "prompt", "max_tokens"]),
    )


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All retained labels, several an answer where posteriors allow."""
    return defects(*_tables(spark, sf_dir)).withColumn("posterior", F.round("posterior", 4))


def severest(found: DataFrame) -> DataFrame:
    """One label an answer: the first in order of severity."""
    rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return found.groupBy("origin", "pair_id").agg(F.min_by("defect", F.struct(rank)).alias("defect")).select("origin", "pair_id", "defect")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severest(defects(*_tables(spark, sf_dir)))
