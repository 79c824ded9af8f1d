"""Recognise refusals by aligning a reply with templates of slots.

Words and phrases are put into slots (speaker, negated ability or will, act of
answering, rules, request, ...) by a lexicon, and the sequence of slots is
aligned by Smith-Waterman with templates such as "speaker, negation, act".
Templates are few because a slot stands for every wording in it, so a refusal
put together from other words of the same kind is found as well.
"""

from __future__ import annotations

import re
import unicodedata

import ahocorasick

#: A matched slot, a word of the reply that fits no slot of the template, a slot of the template that is missing.
MATCH, SKIP, MISSING = 2.0, -0.5, -4.0
#: Words that may stand between the slots of a match.
SKIPPED = 4

#: The lexicon, slot by slot, in lower case and without punctuation.
#: S speaker, N negated ability or will, M both in one, K speaker with a modal verb, T negation, A act of answering or looking,
#: R rules, V breaking or forbidding, Q request, D declined, Z nothing of an answer, G to be given, E another topic or person, L going there, P parting.
LEXICON = {
    "S": "i|we|this assistant|this service|this model|this system|our service|ich|wir|je|j|nous|yo|nosotros|eu|io|我|我们|本助手|本服务",
    "N": """can not|cannot|can t|could not|couldn t|won t|will not|would not|wouldn t|shall not|may not|mustn t|must not|shouldn t|should not|don t do|do not do|don t want to|do not want to|don t wish to|do not wish to|don t have|do not have|lack|am unable|m unable|are unable|is unable|am not able|m not able|are not able|am not allowed|m not allowed|am not permitted|m not permitted|am not authorised|am not authorized|am not comfortable|m not comfortable|not in a position|am not here|am not willing|m not willing|am not equipped|m not equipped|am not going|m not going|am not programmed|m not programmed|not supposed|d rather not|would rather not|rather not|d prefer not|would prefer not|prefer not|d sooner leave|would sooner leave|d sooner not|would sooner not|would rather leave|d rather leave|decline|must decline|have to decline|refuse|must refuse|have to refuse|have to pass|have to pass on|ll pass|will pass|ll have to pass|ll have to pass on|pass on|choose not|abstain|refrain|it s not possible|it is not possible|it isn t possible|it is impossible|it s impossible|not appropriate|inappropriate
bin nicht in der lage|bin nicht befugt|bin nicht berechtigt|lehne|weigere mich|verzichte|bin außerstande
ne peux pas|ne peux rien|ne puis|ne pourrai pas|ne pouvons pas|ne suis pas autorisé|ne suis pas autorisée|ne suis pas en mesure|ne suis pas capable|ne suis pas à l aise|ne souhaite pas|ne veux pas|préfère ne pas|préférerais ne pas|refuse de|dois décliner|dois refuser|décline|m abstiens
无法|不能|不便|不方便|不愿|不想|不会|不可以|看不到|看不见|没有权限|没有能力|没办法|难以|拒绝|不予|不得""",
    "M": """not comfortable|it s not possible for me|it is not possible for me|it isn t possible for me|it is impossible for me|it s impossible for me|no puedo|no podemos|no podré|me niego|prefiero no|preferiría no|debo rechazar|tengo que rechazar|debo negarme|no soy capaz|no estoy autorizado|no estoy autorizada|no estoy en condiciones|no me está permitido|no me es posible|me es imposible|no tengo permitido|no tengo permiso|no me siento cómodo|no quiero|não posso|não podemos|não consigo|prefiro não|recuso me|non posso|non possiamo|non sono in grado|preferisco non|mi rifiuto
ist mir nicht möglich|mir ist es nicht möglich|es mir nicht möglich|ist mir untersagt|ist mir nicht gestattet|ist mir nicht erlaubt|il m est impossible|il ne m est pas possible|ne m est pas permis|m est interdit""",
    "K": "ich kann|kann ich|ich darf|darf ich|ich möchte|möchte ich|ich will|will ich|ich werde|werde ich|ich muss|muss ich|ich soll|wir können|können wir|wir dürfen|dürfen wir",
    "T": "not|nicht|nichts|kein|keine|keinen|keinerlei|ablehnen|verweigern|passen",
    "A": """help|helping|assist|assisting|answer|answering|answered|reply|replying|respond|responding|describe|describing|description|descriptions|discuss|discussing|comment|commenting|say|saying|tell|telling|provide|providing|share|sharing|view|viewing|see|seeing images|see images|watch|watching|look at|looking at|identify|identifying|recognise|recognize|comply|complying|fulfil|fulfill|talk|talking|speak|speaking|disclose|reveal|get into|go into|go there|do that|do this|engage|weigh in|ability|access|offer an opinion|explain|interpret|analyse|analyze|process
helfen|behilflich sein|beantworten|antworten|beschreiben|sagen|auskunft|ansehen|anzusehen|anschauen|sehen|erkennen|äußern|kommentieren|besprechen|bearbeiten|identifizieren|beschreibe|beantworte
aider|répondre|décrire|voir|regarder|identifier|commenter|dire|discuter|traiter|fournir|aide|réponse
ayudar|ayudarle|ayudarte|responder|describir|ver|mirar|identificar|comentar|decir|contestar|hacer eso|hablar|proporcionar|descrever|ajudar|dizer|rispondere|aiutare|descrivere|vedere|dire
回答|描述|提供|查看|帮助|帮忙|帮您|帮你|处理|讨论|评论|说明|识别|观看|图片|图像|视频|完成|满足|透露|协助""",
    "R": """guidelines|guideline|policy|policies|instructions|rules|safety filter|content filter|filter|remit|scope|guardrails|terms of use|terms of service|my limits|my programming|my training|my purpose|what i may|what i am allowed|what i can
richtlinien|regeln|vorschriften|anweisungen|directives|règles|consignes|politique|directrices|reglas|políticas|normas|instrucciones|准则|规定|政策|指南|规则|安全""",
    "V": """against|go against|goes against|would go against|violate|violates|violating|breach|breaches|forbid|forbids|prohibit|prohibits|prevent|prevents|bar me|bars me|do not allow|don t allow|does not allow|doesn t allow|do not permit|don t permit|does not permit|doesn t permit|not allowed by|outside|beyond|contrary to|conflict with|conflicts with|blocked
verbieten|verbietet|verstößt gegen|verstoßen gegen|außerhalb|interdisent|interdit|contraire|contre|prohíben|prohíbe|en contra|viola|违反|违背|禁止|不允许|超出""",
    "Q": """request|requests|this question|that question|question|questions|this prompt|prompt|query|this topic|that topic|topic|subject|this one|that one|this matter|anfrage|frage|thema|demande|cette question|sujet|solicitud|pregunta|esta pregunta|tema|pedido|richiesta|请求|要求|问题|话题""",
    "D": """declined|denied|rejected|refused|blocked|turned down|cannot be fulfilled|can t be fulfilled|cannot be answered|cannot be processed|will not be answered|won t be answered|will not be processed|abgelehnt|verweigert|zurückgewiesen|refusée|rejetée|rechazada|denegada|recusado|rifiutata|被拒绝|已被拒绝|被拦截""",
    "Z": "no answer|no reply|no response|no description|no comment|keine antwort|keine auskunft|keine beschreibung|aucune réponse|aucune description|ninguna respuesta|ninguna descripción",
    "G": "given|provided|be given|be provided|will be given|will be provided|from me|on this|gegeben|erteilt|donnée|fournie|dará|se dará",
    "E": """another topic|another subject|a different topic|different topic|a different subject|something else|somebody else|someone else|anyone else|another source|the subject|anderes thema|ein anderes thema|etwas anderes|jemand anderen|jemand anderes|autre chose|un autre sujet|quelqu un d autre|otra cosa|otro tema|a otra persona|otra persona|其他话题|别的话题|换个话题|其他人|别人""",
    "L": "let us|let s|have to find|need to find|need to ask|have to ask|will have to|should ask|better ask|move to|change|talk about|lassen sie uns|sprechen wir|reden wir|fragen sie|wenden sie sich|parlons|demandez à|adressez vous|hablemos|pregunte a|pregúntele|我们|请",
    "P": "my apologies|apologies|sorry|i apologise|i apologize|tut mir leid|désolé|désolée|lo siento|抱歉|对不起",
}
#: The templates.
TEMPLATES = ("SNA", "SNQ", "NAQ", "MA", "KTA", "KTT", "KQT", "AVR", "RVA", "VRA", "VSA", "QVR", "QD", "QDR", "ZG", "LE", "LEQ", "TQSA", "PVR", "PNA", "PM", "QSNA", "QKT")
#: Words that may stand within templates of two slots; within others of that length none.
SHORT_SKIPPED = {"MA": 3, "LE": 1, "PM": 1, "ZG": 1, "QD": 2}

_WIDE = "぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_WIDE}]|[^\W_{_WIDE}]+|[.!?。！？;；]+")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+|[.!?;]+")
_APOSTROPHE = re.compile(r"['’ʼ]")


def _tokens(text: str) -> list[str]:
    plain = (text.replace("'", " ") if text.isascii() else _APOSTROPHE.sub(" ", unicodedata.normalize("NFKC", text))).lower()
    return (_ASCII_TOKEN if plain.isascii() else _TOKEN).findall(plain)


_SLOTS = ahocorasick.Automaton()
for _slot, _phrases in LEXICON.items():
    for _phrase in _phrases.replace("\n", "|").split("|"):
        _words = _tokens(_phrase)
        _key = " " + " ".join(_words) + " "
        _SLOTS.add_word(_key, _SLOTS.get(_key, ()) + ((_slot, len(_words)),))
_SLOTS.make_automaton()
#: Words without which no template can match: every template has one of these slots.
_TELLING = frozenset("NMTDVZE")


def slots(words: list[str]) -> list[frozenset[str]]:
    """Words as slots: of phrases that overlap the longest from the left; a word in no phrase, or a sentence end, has none."""
    line = " " + " ".join(words) + " "
    at: dict[int, dict[int, set[str]]] = {}
    starts = {}
    place = 0
    for i, w in enumerate(words):
        starts[place] = i
        place += len(w) + 1
    telling = False
    for end, found in _SLOTS.iter(line):
        for slot, n in found:
            telling = telling or slot in _TELLING
            # the match ends with the blank at `end`; its first blank lies before its first word
            size = sum(map(len, _phrase_words(line, end, n))) + n
            start = starts[end - size]
            at.setdefault(start, {}).setdefault(n, set()).add(slot)
    if not telling:
        return []
    out: list[frozenset[str]] = []
    i = 0
    while i < len(words):
        here = at.get(i)
        if here:
            n = max(here)
            out.append(frozenset(here[n]))
            i += n
        else:
            out.append(frozenset("." if words[i][0] in ".!?。！？;；" else ""))
            i += 1
    return out


def _phrase_words(line: str, end: int, n: int) -> list[str]:
    """The n words of a line before the blank at end."""
    return line[:end].rsplit(" ", n)[1:]


def slot_score(template: str, given: list[frozenset[str]]) -> float:
    """Smith-Waterman score of a template with a reply's slots; an alignment doesn't run over a sentence's end."""
    best = 0.0
    row = [0.0] * (len(template) + 1)
    for s in given:
        if "." in s:
            row = [0.0] * (len(template) + 1)
            continue
        new = [0.0] * (len(template) + 1)
        for k, slot in enumerate(template, 1):
            hit = row[k - 1] + MATCH if slot in s else 0.0
            new[k] = max(0.0, hit, row[k] + SKIP, new[k - 1] + MISSING)
        row = new
        best = max(best, row[-1])
    return best


def is_refusal_text(text: str) -> bool:
    """Whether a text, freed of quotations, holds a refusal anywhere."""
    given = slots(_tokens(text))
    if not given:
        return False
    present = frozenset().union(*given)
    for t in TEMPLATES:
        if not present.issuperset(t):
            continue
        skipped = SKIPPED if len(t) > 2 else SHORT_SKIPPED.get(t, 0)
        if slot_score(t, given) >= MATCH * len(t) + SKIP * skipped:
            return True
    return False
