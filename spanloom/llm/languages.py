"""Which language a short text is in, by script and function words."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import chain, repeat

#: Frequent function words of some languages written in Latin letters.
FUNCTION_WORDS = {
    "en": "the a an of to and is are was were be been being in on at by for from with as it its that this these which who what where when why how not no does do did has have had can will would one two or but before after while near under above behind beside close left right front into then there they he she her his their them you your i my me we our looks nobody",
    "de": "der die das den dem des ein eine einen einem einer und ist sind war nicht kein keine was wer wie wo warum welche im am zum zur zu mit auf von vor nach ohne sich wird man dass für bei hinter unter neben an in über es er sie ich wir ihr mir mich als auch oder aber wenn nachdem steht",
    "fr": "le la les un une des du de et est sont que qui quoi dans sur avec pour pas ne où au aux ce cette ces se en sous sans par plus il elle on nous vous je me ma mon son sa ses leur à près devant derrière après avant puis peu quand pourquoi quelle quel comment",
    "es": "el la los las un una unos unas de del y es son que qué quién quien en con por para no se al lo cómo dónde cuándo su sus sin está están hay hacia junto cerca debajo detrás delante encima después antes poco más muy pero porque cuando yo me mi nos ella él",
    "pt": "o a os as um uma de do da dos das e é são que em no na nos nas com por para não se ao à depois antes ele ela seu sua sem mais muito mas vê lado fundo uns",
    "it": "il lo la i gli le un uno una di del della dei e è sono che in con per non si al alla nel nella dal dopo prima sul sulla da se ne senza più ma poi qualcuno verso volte",
    "nl": "de het een en is zijn van in op met voor niet dat die te naar aan wordt na om bij er als ook maar dan hij zij ze uit over onder naast zonder",
    "pl": "i w z na się o do od nie to jest są jak że po przez przy obok bez za pod nad ale lub oraz który która przed gdzie co kto",
    "sv": "och i att det som en ett på är av för med den till inte om han hon de vid från efter under utan men eller",
    "da": "og i at det som en et på er af for med den til ikke om han hun de ved fra efter under uden men eller",
    "tr": "ve bir bu da de için ile ne mi gibi çok daha sonra önce var yok o şu olarak kadar ama",
    "cs": "a v na se je že s z do o k po za pro ale jako nebo když už jen bez při pod nad",
    "ro": "și în de la cu pe un o este sunt care nu se din pentru mai după lângă fără sub",
    "fi": "ja on ei se että hän oli mutta kun niin joka tai myös ovat sitten ilman",
    "hu": "a az és egy nem hogy is van volt de meg mint vagy után előtt mellett nélkül",
    "id": "yang dan di ke dari untuk dengan ini itu tidak ada pada adalah oleh akan sebuah",
    "vi": "và của là một có không được trong cho với những các này đó người",
}
#: Letters that few of these languages use.
TELLING = {"ß": "de", "ł": "pl", "ą": "pl", "ę": "pl", "ż": "pl", "ś": "pl", "ź": "pl", "ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "ě": "cs", "ř": "cs", "ů": "cs", "å": "sv", "ğ": "tr", "ı": "tr", "ő": "hu", "ű": "hu", "ț": "ro", "ș": "ro"}
#: Names under which a text asks for a language.
ASKED = re.compile(
    r"\b(?:english|german|french|spanish|chinese|mandarin|russian|japanese|korean|italian|portuguese|polish|dutch|turkish|englisch|deutsch|französisch|spanisch|chinesisch|"
    r"anglais|allemand|français|espagnol|chinois|inglés|alemán|francés|español|chino|translat\w*|übersetz\w*|tradui\w*|traduc\w*)\b|英语|英文|德语|法语|西班牙语|中文|汉语|日语|韩语|俄语|翻译",
    re.IGNORECASE,
)
_LANGUAGES_OF: dict[str, list[str]] = {}
for _k, _v in FUNCTION_WORDS.items():
    for _w in set(_v.split()):
        _LANGUAGES_OF.setdefault(_w, []).append(_k)
_LETTERS = re.compile(r"[^\W\d_]+")
_ASCII_LETTER = re.compile("[A-Za-z]")
_SCORED = re.compile(r"[^\W\d_]{2,}|(?<![^\W\d_])[aoyeiàéwz](?![^\W\d_])")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|‘[^’]*’|「[^」]*」")
_SCRIPTS = ("LATIN", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "THAI")


_QUOTES = frozenset("\"“«„‘「")


def unquoted(text: str) -> str:
    return text if _QUOTES.isdisjoint(text) else _QUOTED.sub(" ", text)


@lru_cache(maxsize=20_000)
def _script(char: str) -> str:
    """The script of a letter; empty for anything else."""
    if not char.isalpha():
        return ""
    return "LATIN" if char < "ɐ" else unicodedata.name(char, "?").split(" ")[0]


def script_of(text: str) -> tuple[str, int]:
    """(the script of most letters, their number, of plain ASCII only whether there are any); kana make a text Japanese."""
    if text.isascii():
        return "LATIN", int(_ASCII_LETTER.search(text) is not None)
    found = Counter(map(_script, text))
    del found[""]
    kana = found.pop("HIRAGANA", 0) + found.pop("KATAKANA", 0)
    if kana:
        found["KANA"] = kana + found.pop("CJK", 0)
    return found.most_common(1)[0] if found else ("", 0)


def latin_scores(text: str) -> tuple[dict[str, float], int]:
    """(share of words that are function words, by language that has any; number of words)."""
    words = _SCORED.findall(text.lower())
    if not words:
        return {}, 0
    counts = Counter(chain.from_iterable(map(_LANGUAGES_OF.get, words, repeat(()))))
    scores = {k: n / len(words) for k, n in counts.items()}
    if not text.isascii():
        for c in set(text.lower()):
            if c in TELLING:
                scores[TELLING[c]] = scores.get(TELLING[c], 0.0) + 0.25
    return scores, len(words)


def language_of(text: str) -> str:
    """The language of a text's function words, or the script of another than Latin letters, in lower case; "other" where neither tells."""
    script, letters = script_of(unicodedata.normalize("NFKC", text))
    if not letters:
        return "other"
    if script != "LATIN":
        return script.lower()
    scores, _ = latin_scores(text)
    best = max(scores, key=scores.get, default="")
    return best or "other"


def same_language(question: str, reply: str) -> bool | None:
    """Whether a reply may be in a question's language; None where there is too little text to tell.

    Both are freed of markers and quotations by the caller.
    """
    script, letters = script_of(reply)
    asked, asked_letters = script_of(question)
    if not letters or not asked_letters:
        return None
    if script != asked:
        if script == "LATIN":
            return None if len(_LETTERS.findall(reply)) < 4 else False
        return None if letters < 4 else False
    if script != "LATIN":
        return True
    theirs, n = latin_scores(reply)
    if n < 4:
        return None
    ours, m = latin_scores(question)
    if m < 2:
        return None
    if not ours:
        return None
    spoken = max(ours, key=ours.get)
    near = [k for k in ours if ours[k] >= ours[spoken] * 0.75]
    same = max(theirs.get(k, 0.0) for k in near)
    best = max(theirs, key=theirs.get, default=spoken)
    lead, own = theirs.get(best, 0.0), theirs.get(spoken, 0.0)
    if n >= 6 and ours.get(best, 0.0) < ours[spoken] and lead >= 1.5 * own and lead - own >= 0.1:
        return False  # related languages share words, but the reply's own ones lead
    if best in near or lead <= same * 1.25:
        # a text of some length has words of its own language
        return not (n >= 6 and same <= 0.05)
    return not (same < 0.2 and lead - same >= 0.15 or lead >= 2 * same)
