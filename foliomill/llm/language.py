"""Language evidence for short scholarly texts in English, French, German, Spanish, Italian and Portuguese."""

from __future__ import annotations

import functools
import re

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was for that with by on as are were be this from at an which it its not have has or we our their these than whether when what how who about would could rather only both each after while during under between does list describe write explain show drawn paper use find a an yes no i you".split(),
    "fr": "le la les du des une un et est dans pour par sur avec au aux en qui ne pas que ce cette ces nous sont été ou où se sa son leur plus entre pendant contre lorsque dont soit très mais je vous il elle ont ces sans selon donc l d n s qu j quels quelles quel quelle montre porte concernent résumez décrivez comment après oui non enfin cependant".split(),
    "de": "der die das und den dem des ein eine einer eines einen ist von zu im mit für auf nicht wird bei sich als auch es sind wurde werden aber oder um an über nach aus durch wie so ich sie wir kaum zum zur noch ob dass keine kein mir dazu beim welche welcher welches was zeigt enthält fassen beschreiben nein ja schließlich zwischen".split(),
    "es": "el la los las de del y una un que es en para por con se al como no su fue son entre este esta estos más lo sus ha sin sobre desde cuando sigue pero cada durante tras frente nos le me ninguna por si ser a o qué cuál cuáles muestra resuma describa trata refieren cómo sí después finalmente".split(),
    "it": "il lo gli della delle dei degli del di che è sono per con non una uno nel nella nei sul sulla dal dalla tra fra più questo questa questi come anche ma se ha hanno alla alle ai al da si dove quando mentre però quale quali mostra descrivi riassumi perché".split(),
    "pt": "o os da das do dos em no na nos nas um uma uns umas não é são com para pelo pela pelos pelas mais como mas foi foram ao aos à às que e ou seu sua também entre sobre qual quais quando até isso este esta descreva resuma porque".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
#: word -> weight in each language; a word of several languages counts for each by its share.
_WEIGHTS = {w: tuple((w in v) / sum(w in other for other in FUNCTION_WORDS.values()) for v in FUNCTION_WORDS.values()) for ws in FUNCTION_WORDS.values() for w in ws}
#: Letter groups by language.
LETTERS = {
    "en": (" th", "ing ", " wh", "ould ", "ly ", "tion of ", " and "),
    "fr": ("è", "ê", "ç", " d'", " l'", "tion d", " qu'", "ées ", " et ", " les ", " des "),
    "de": ("ä", "ö", "ü", "ß", "sch", "ung", "keit", " ein", "cht ", " und ", " der "),
    "es": ("ñ", "ó", "í", "ción", "idad ", " el ", " los ", " las ", " del ", " una ", "aron ", " y "),
    "it": ("zione ", "ità ", " gli ", " della ", " che ", "tto ", "lla "),
    "pt": ("ção", "ções", "ã", "õ", " não ", " dos ", "dade "),
}
_WORD = re.compile(r"[^\W\d_]+")
#: Names of the languages as prompts spell them.
NAMES = {
    "en": "english|anglais|englisch|inglés",
    "fr": "french|français|française|französisch|francés",
    "de": "german|allemand|deutsch|alemán",
    "es": "spanish|espagnol|spanisch|español|castellano",
    "it": "italian|italien|italienisch|italiano",
    "pt": "portuguese|portugais|portugiesisch|portugués",
}
_ASK = re.compile(r"(?:\b(?:answer|reply|respond|write|response|output|antworte\w*|schreiben?|antwort|répon\w+|rédig\w+|respond\w+|conteste\w*|escrib\w+|respuesta)\b[^.!?\n]{0,40}?)\b(?:in|auf|en|into)\s+(?:the\s+)?(" + "|".join(NAMES.values()) + r")\b", re.I)
_WRAP = re.compile(r"^(?:SYSTEM|USER|SOURCE:|PAPER:|TEXT:|ANSWER:|CONTEXT:|### \w+|You extract coarse cues\.)\s*$|^(?:Task|Question|Q|Prompt|User|Instruction)\s*:\s*", re.M | re.I)


_NAMED = tuple(x for v in NAMES.values() for x in v.split("|"))


def _best(scores) -> tuple[str | None, float]:
    second, top = sorted(scores)[-2:]
    return (LANGUAGES[scores.index(top)] if top > 0 else None), top - second


def weights(words: list[str]) -> list[tuple[float, ...] | None]:
    """Of each word what it says for each language; None for a word of none.  Numbers are left out."""
    return [_WEIGHTS.get(w) for w in words if not w.isdigit()]


def sums(words: list[tuple[float, ...] | None]) -> tuple[float, ...] | None:
    """What all words together say for each language; None if none of them is of any."""
    known = [x for x in words if x]
    return tuple(map(sum, zip(*known))) if known else None


def best_of(said: tuple[float, ...] | None, n: int) -> tuple[str | None, float]:
    """Best language by the sums of ``n`` words and its lead over the next, in shares of the words."""
    if said is None:
        return None, 0.0
    lang, lead = _best(said)
    return lang, lead / n


def by_words(text: str) -> tuple[str | None, float, int]:
    """Best language by function words, its lead over the next (in shares of words), and the number of words."""
    words = weights(_WORD.findall(text.lower()))
    return *best_of(sums(words), len(words)), len(words)


#: The groups without accents: of a text without any, no others need be looked for.
_PLAIN = tuple(tuple(x for x in v if x.isascii()) for v in LETTERS.values())
_ALL = tuple(LETTERS.values())


def by_letters(text: str) -> tuple[str | None, float]:
    """Best language by letter groups and its lead, in groups a word."""
    low = f" {text.lower()} "
    n = max(1, len(low) / 6)
    return _best([sum(map(low.count, v)) / n for v in (_PLAIN if low.isascii() else _ALL)])


def letters_of(text: str, languages: tuple[str, ...]) -> list[float]:
    """Letter groups a word of each of the languages."""
    low = f" {text.lower()} "
    n = max(1, len(low) / 6)
    groups = _PLAIN if low.isascii() else _ALL
    return [sum(map(low.count, groups[LANGUAGES.index(x)])) / n for x in languages]


@functools.lru_cache(maxsize=4096)
def expected(prompt: str) -> str | None:
    """The language a prompt asks for, else its own."""
    low = prompt.lower()
    if any(x in low for x in _NAMED) and (m := _ASK.search(prompt)):
        name = m[1].lower()
        return next(k for k, v in NAMES.items() if name in v.split("|"))
    body = _WRAP.sub(" ", prompt)
    lang, lead, n = by_words(body)
    if n and lead < 0.04:
        letters, ahead = by_letters(body)
        return letters if ahead > lead else lang
    return lang
