"""Defects of question and answer pairs: empty, truncated, refusal, copy and wrong language.

An answer runs through a pushdown parser that keeps open fences, brackets, quotations and tags on a stack and knows
lists and tables; what is still open at the end, or a last sentence, item or row that isn't finished, is a
truncation. Copies are found by greedy string tiling of the answer with the question's words, languages by function
words and scripts, refusals by a grammar of sentences: some sentence declines and none of the others says anything.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in on at for with from by is are was were be been this that these those it its as if when while how what who where why which can could do does did not no you your my me we our they them there than then will would should may must have has had i am any all each please because after before about once unless",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren sein ich wir sie er es ihr nicht kein keine mit von zu zum zur im in am an auf aus für bei nach vor über unter durch wie was wer wo warum welche kann können darf dürfen muss müssen soll sollen werden wird wurde hat haben dass weil wenn als auch nur noch bitte ihre ihren jede jeder jedes alle danach innerhalb während ohne",
    "fr": "le la les l un une des du de d et ou mais est sont était être je tu il elle nous vous ils elles ne pas plus que qui quoi où comment pourquoi quel quelle dans sur sous avec sans pour par en au aux ce cet cette ces mon ma mes votre vos notre nos leur leurs son sa ses peut peuvent puis pouvez doit faut si car donc quand après avant pendant lorsque chaque depuis toutes tous",
    "es": "el la los las un una unos unas y o u pero es son era ser yo tú él ella nosotros usted ustedes ellos no más que qué quién cómo dónde cuándo cuánto por para con sin en a al del de se su sus mi mis nuestro nuestra puede pueden puedo debe hay si porque como cuando después antes durante mientras cada todas todos según desde sobre esta este estas estos lo",
}
FUNCTION = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
# How a language is named in each language, as it is asked for.
ASKED_FOR = {
    "en": r"english|englisch|anglais|inglés|ingles",
    "de": r"german|deutsch|allemand|alemán|aleman",
    "fr": r"french|französisch|franzoesisch|français|francais|francés|frances",
    "es": r"spanish|spanisch|espagnol|español|espanol|castellano",
}
ASKED = {lang: re.compile(rf"\b(?:in|into|auf|ins|en|al|nach|a)\s+(?:{names})\b|\b(?:{names})\s+(?:please|bitte|answer)\b", re.I) for lang, names in ASKED_FOR.items()}
# Marks and words that stand for nothing.
PLACEHOLDERS = frozenset("none null nil nan n/a na undefined void tbd todo empty (empty) <empty> <none> <null> [] {} () [empty] [none] [null] [no answer] <no answer> (none) (no answer) #n/a k.a. s.o. s/o".split() + ["no answer", "not available"])

# The grammar of refusals. Words are classes of one letter or more, and the rules below are read over a sentence's classes.
# The words of each class, of English, German, French and Spanish; forms that hold a subject or a negation have several.
CLASSES = {
    "S": "i we ich wir je j nous yo nosotros",
    "T": "me us my myself mir mich uns m moi me",
    "N": "not no none nothing never nor nicht nichts kein keine keinen keiner keinem keinerlei nie pas rien aucun aucune jamais ni sin nada ninguna ninguno ningún ne n",
    "M": "can ca could wo may might will would shall able allowed permitted position kann können könnte darf dürfen dürfte möchte möchten werde werden will wollen lage befugt peux puis pouvons pourrai pourrais saurais veux voulons souhaite souhaitons mesure capable autorisé autorisée dirai",
    "J": "must should have-to has-to need-to ought-to told-to asked-to instructed-to required-to supposed-to obliged-to muss müssen soll sollte dois devons faut hay-que",
    "V": "answer respond reply help assist comment say tell discuss advise guess speculate elaborate determine confirm explain go-into talk speak beantworten antworten helfen weiterhelfen raten sagen äußern äußere sprechen mitteilen auskunft kommentieren kommentar beurteilen répondre aider parler dire commenter commentaire commentaires deviner indiquer traiter fournir donner responder contestar ayudar ayudarle ayudarte decir comentar comentarios comentario hablar adivinar indicar opinar facilitar",
    "G": "give provide share disclose offer find reveal supply release see found geben nennen teilen herausgeben finden finde fand findet trouve trouvé partager divulguer encuentro encontré compartir revelar proporcionar dar",
    "I": "answer answers reply response information info details detail context data knowledge idea access antwort antworten auskunft information informationen angaben kontext daten hinweis hinweise réponse réponses information informations contexte éléments données accès idée respuesta respuestas información contexto datos acceso idea this that it das dies ça cela esto eso",
    "K": "know weiß wissen sais savons connais connaissons",
    "H": "have possess habe haben ai avons dispose disposons possède",
    "D": "decline refuse refrain abstain avoid pass stay-away steer-clear ablehnen verweigern verzichten unterlassen décliner refuser abstenir éviter rechazar declinar abstenerme evitar rehusar",
    "P": "rather prefer lieber préfère préférons",
    "U": "source sources passage passages document documents excerpt excerpts text texts material quelle quellen abschnitt abschnitte abschnitten dokument dokumente dokumenten textstellen unterlagen extrait extraits fuente fuentes pasaje pasajes documento documentos fragmento fragmentos contexto contexte context kontext",
    "C": "cover covers mention mentions say says tell tells address addresses state contain contains show shows behandelt behandeln erwähnt erwähnen sagt sagen nennt enthält enthalten steht traite traitent mentionne mentionnent dit disent indique indiquent parlent parle trata tratan menciona mencionan dice dicen indica indican contiene contienen",
    "E": "let lets allow allows permit permits enable lässt lassen erlaubt erlauben ermöglichen permet permettent permettant permite permiten deja dejan",
    "Z": "inappropriate improper impossible unangebracht unangemessen unmöglich inapproprié impossible inapropiado imposible",
    "L": "possible möglich posible",
    "F": "lack lacks fehlt fehlen manque manquent falta faltan",
    "B": "outside beyond außerhalb jenseits dépasse dépassent hors excede fuera",
    "Q": "question frage pregunta",
    "O": "open unanswered offen unbeantwortet ouverte abierta",
    "R": "best better besten besser mieux préférable mejor preferible",
    "W": "with mit avec con",
    "Y": "your ihrem ihrer ihren deinem votre vos ton su sus tu",
    "MN": "unable",
    "SM": "i'd i'll i'm puedo podemos podré podría quiero queremos voy soy estoy",
    "SK": "sé sabemos conozco",
    "NSK": "desconozco desconocemos ignoro",
    "SH": "tengo tenemos dispongo disponemos cuento",
    "SJ": "debo debemos tengo-que he-de",
    "SP": "prefiero preferimos",
    "SV": "diré diremos comentaré responderé contestaré opinaré",
}
NOT = re.compile(r"n't\b|(?<=\bcan)not\b")
TOKEN = re.compile(r"[a-z]+-(?:to|into|away|clear|que|de)\b|i'(?:m|d|ll|ve)\b|[^\W\d_]+|\d+")
_CODES: dict[str, str] = {}
for _code, _words in CLASSES.items():
    for _word in _words.split():
        _CODES[_word] = _CODES.get(_word, "") + _code
TWO_WORDS = re.compile(r"\b(have|has|need|ought|told|asked|instructed|required|supposed|obliged|go|stay|steer|hay|tengo|he) (to|into|away|clear|que|de)\b")


def _rule(parts: str) -> str:
    """A rule's parts as a pattern of class strings: classes that a token may have, ``A&B`` for both, a number for the most tokens between."""
    out = ""
    for part in parts.split():
        out += rf"(?:\S+ ){{0,{part}}}" if part.isdigit() else r"\S*" + r"\S*".join(f"[{c}]" for c in part.split("&")) + r"\S* "
    return out


#: What declines: the parts that a sentence has one after the other.
RULES = {
    "is unable to speak": ("S 2 M 1 N 4 V", "S 1 N 6 V", "S 2 M 6 N 3 V", "M S 5 N 4 V", "V S 2 N", "N S&M 4 V", "N S&V"),
    "is unable to give": ("S 2 M 1 N 4 G 3 I", "M S 3 N I", "S 2 M 4 N 1 I", "N S&M 2 GV 2 I"),
    "doesn't know": ("S 1 N 2 K", "S K 2 N", "K S 2 N", "N S&K", "N 1 S&K", "N&S&K"),
    "has nothing": ("S 2 N 1 H 4 I", "S H 3 N 3 I", "N S&H 4 I", "S 1 G 1 N", "T 1 F 4 I"),
    "has to decline": ("S 3 J 3 D", "J S 5 D", "S 3 J 6 D", "S&J 2 D", "S 1 P 3 N", "S&P 2 N", "S 2 P D", "S&P D"),
    "finds the sources silent": ("N 3 U 8 C", "U 8 N 1 C", "N 6 C 1 T", "N 4 T 1 C", "U 3 N 1 E 1 T", "U 2 N 1 T 1 E", "U 2 T 1 E 2 N", "U 3 E 3 N", "U 6 G 2 N"),
    "finds it impossible": ("Z 2 T", "T 2 Z", "N T 2 L", "N I 2 MSL"),
    "is out of scope": ("B 5 S 2 MV", "B 3 S&M", "B 3 T"),
    "leaves it open": ("Q 3 O",),
    "sends elsewhere": ("R 4 W Y",),
}
DECLINE = re.compile("|".join([*(_rule(parts) for rules in RULES.values() for parts in rules), "^" + _rule("N 1 V") + r"(?:\S+ ){0,4}$"]))
#: Words without which nothing is declined: negations and what declines by itself.
TELLING = frozenset(p for w, c in _CODES.items() if set(c) & set("NDZBFR") for p in w.split("-")) | {"cannot"}


def classes(sentence: str) -> str:
    """The classes of a lower-case sentence's words, each followed by a blank; a dot stands for a word of none."""
    joined = TWO_WORDS.sub(r"\1-\2", NOT.sub(" not", sentence))
    return "".join(_CODES.get(w, ".") + " " for w in TOKEN.findall(joined))
# Sentences around a refusal that add nothing to it.
AROUND = re.compile(
    r"^(?:i'?m |i am |we are )?(?:very |so |terribly )?(?:sorry|apologies|my apologies|unfortunately|regrettably|sadly)\b.{0,40}$|^thank(?:s| you)\b|^that'?s a (?:great|good) question|^(?:please )?(?:contact|ask|reach out|try|rephrase|consult|check with|get in touch)\b|^is there anything else|^(?:let me know|feel free|how else)\b|^as an? (?:ai|assistant|language)\b.{0,40}$|^let me be"
    r"|^(?:es tut mir leid|leider|entschuldigung|verzeihung|mit bedauern|bedaure)\b.{0,40}$|^(?:vielen )?dank\b|^(?:bitte )?(?:wenden|stellen|fragen|kontaktieren|versuchen|formulieren) sie|^bitte\b|^kann ich (?:sonst|noch)|^gute frage|^haben sie"
    r"|^(?:je suis )?(?:désolée?|navrée?|malheureusement|avec regret|pardon|toutes mes excuses)\b.{0,40}$|^merci\b|^(?:veuillez|contactez|reformulez|adressez|essayez|consultez)|^(?:puis-je|avez-vous|y a-t-il)\b|^bonne question"
    r"|^(?:lo siento|lamentablemente|por desgracia|disculpe|perdón|lamento)\b.{0,40}$|^gracias\b|^(?:contacte|consulte|intente|reformule|póngase|pregunte|diríjase|pruebe|hable)|^¿?(?:puedo|hay|desea|necesita|quiere)\b|^buena pregunta"
)

MARKS = re.compile(r"```|[()\[\]{}\"„“”«»]|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?(/?)>")
CLOSES = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
# Articles, prepositions and conjunctions, which no phrase ends with.
LEADS_ON = frozenset("the a an and or but of to with from for by at your our their its because if when which der die das den dem des ein eine einen einem einer und oder mit von zum zur für bei ihre ihren weil wenn dass le la les un une des du et ou avec sans pour par dans votre vos notre el los las una unos y o con sin para por del su sus porque".split())
VOID_TAGS = frozenset("br hr img input meta link".split())
ITEM = re.compile(r"^\s*(?:[-*•+–]|\d{1,3}[.)]|[a-zA-Z][.)])(?:\s+|$)")
CITATION = re.compile(r"(?:\s*(?:\[\d+(?:\s*,\s*\d+)*\]|\(\d+\)))+\s*$")
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”“’»)\]*_]*$")
SENTENCES = re.compile(r"(?<=[.!?…])\s+|\n+")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff]")
SHORT = 5


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def is_empty(answer: str | None) -> bool:
    """Whether nothing is said: null, blanks and invisible characters, punctuation alone, or a placeholder, whatever blanks are around it."""
    if answer is None:
        return True
    seen = (answer if answer.isascii() else INVISIBLE.sub("", answer)).split(None, 3)
    if any(c.isalnum() for part in seen for c in part):
        # A placeholder has three words at most.
        return len(seen) < 4 and " ".join(seen).strip("\"'`*_").lower() in PLACEHOLDERS
    return True


def left_open(answer: str) -> bool:
    """The pushdown parser: whether a fence, bracket, quotation or tag is open at the end."""
    stack: list[str] = []
    fenced: list[str] | None = None
    for mark in MARKS.finditer(answer):
        token, tag = mark.group(), mark.group(2)
        if token == "```":
            fenced = [] if fenced is None else None
            continue
        on = stack if fenced is None else fenced
        if tag:
            name = tag.lower()
            if mark.group(1):
                if f"<{name}" in on:
                    while on.pop() != f"<{name}":
                        pass
            elif not mark.group(3) and name not in VOID_TAGS:
                on.append(f"<{name}")
        elif token in '"':
            if '"' in on:
                while on.pop() != '"':
                    pass
            else:
                on.append('"')
        elif token == "“" and "„" in on:
            while on.pop() != "„":
                pass
        elif token in "([{„“«":
            on.append(token)
        else:
            opener = CLOSES[token] if token != "”" or "“" in on else "„"
            if opener in on:
                while on.pop() != opener:
                    pass
    return fenced is not None or bool(stack)


def is_truncated(answer: str) -> bool:
    """Whether something is left open, or the last sentence, item or row is unfinished.

    Complete are lists whose last item has text, tables whose last row has as many cells as the first, and what ends with
    a mark that ends sentences, citations and closing quotation marks aside. Of the rest, which ends without a mark, a
    phrase of up to five words is complete unless its last word leads on, as articles and prepositions do, or a mark does.
    """
    text = CITATION.sub("", answer.rstrip())
    if left_open(text):
        return True
    lines = text.rstrip().split("\n")
    last = lines[-1].rstrip()
    if last.lstrip().startswith("|"):
        rows = [line for line in lines if line.lstrip().startswith("|")]
        return not last.endswith("|") or last.count("|") < rows[0].count("|")
    item = ITEM.match(last)
    if item and len(lines) > 1:
        return not last[item.end() :].strip() or last[-1] in ",:;-–("
    if last.endswith("```"):
        return False
    if SENTENCE_END.search(last.rstrip("*_ ")):
        return False
    final = words(last)[-1:]
    return len(answer.split(None, SHORT)) > SHORT or last[-1:] in ",:;(-–" or len(words(last)) > 1 and final[0] in LEADS_ON


def is_refusal(answer: str, said: list[str] | None = None) -> bool:
    """Whether some sentence declines and no other says anything. ``said``: the answer's words, if at hand."""
    text = answer.strip().lower().replace("’", "'")
    # Words of an elision or a contraction are looked up by their parts too.
    if not any(w in TELLING or "'" in w and (w.endswith("n't") or not TELLING.isdisjoint(w.split("'"))) for w in (words(text) if said is None else [w.replace("’", "'") for w in said])):
        return False
    declined = False
    for sentence in SENTENCES.split(CITATION.sub("", text)):
        sentence = sentence.strip(" -–*_>#\"")
        if not sentence:
            continue
        if DECLINE.search(classes(sentence)):
            declined = True
        elif not AROUND.search(sentence) and WORD.search(sentence):
            return False
    return declined


def _automaton(tokens: list[str]) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """The suffix automaton of a list of words: steps, suffix links and lengths of its states."""
    steps, link, length, last = [{}], [-1], [0], 0
    for token in tokens:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and token not in steps[at]:
            steps[at][token] = new
            at = link[at]
        if at >= 0:
            reached = steps[at][token]
            if length[reached] == length[at] + 1:
                link[new] = reached
            else:
                copy = len(steps)
                steps.append(dict(steps[reached]))
                length.append(length[at] + 1)
                link.append(link[reached])
                while at >= 0 and steps[at].get(token) == reached:
                    steps[at][token] = copy
                    at = link[at]
                link[reached] = link[new] = copy
        last = new
    return steps, link, length


def runs_of(question: list[str], answer: list[str], least: int) -> list[tuple[int, int]]:
    """(length, start) of the answer's maximal runs of ``least`` words or more that the question has too, in linear time."""
    steps, link, length = _automaton(question)
    out, state, n = [], 0, 0
    for end, token in enumerate([*answer, None]):
        before = n
        while state and token not in steps[state]:
            state = link[state]
            n = length[state]
        if token in steps[state]:
            state, n = steps[state][token], n + 1
        else:
            n = 0
        # The run that ended at the word before can't be drawn out by this one.
        if before >= least and n <= before:
            out.append((before, end - before))
    return out


def tiles(question: list[str], answer: list[str], least: int) -> list[bool]:
    """Which words of the answer greedy string tiling covers with runs of ``least`` or more of the question's words.

    The longest tiles are laid first and do not overlap in the answer. A tile that a longer one has cut is looked at
    again when its rest's turn comes, as every match in what is left lies in the rest of a maximal one. Words of the
    question aren't marked, since a copy may repeat it. Takes n log n of the number of words, however often they repeat.
    """
    covered = [False] * len(answer)
    heap = [(-n, i) for n, i in runs_of(question, answer, least)]
    heapq.heapify(heap)
    while heap:
        n, i = heapq.heappop(heap)
        start, end = i, i - n
        while start < end and covered[start]:
            start += 1
        while start < end and covered[end - 1]:
            end -= 1
        if end - start == -n:
            covered[start:end] = [True] * (end - start)
        elif end - start >= least:
            heapq.heappush(heap, (start - end, start))
    return covered


def is_copy(question: str, answer: str, said: list[str] | None = None, asked: list[str] | None = None) -> bool:
    """Whether the answer is the question, repeated, restyled or introduced, and nothing else.

    Tiles must cover most of the question's main sentence and, but for an introduction of up to eight words and
    labels between repetitions, all of the answer.
    """
    said, asked = words(answer) if said is None else said, words(question) if asked is None else asked
    if not said or not asked:
        return False
    if said == asked:
        return True
    have = set(asked)
    if 2 * sum(w in have for w in said) < len(said):
        return False
    covered = tiles(asked, said, min(3, len(asked)))
    if not any(covered):
        return False
    first, last = covered.index(True), len(covered) - covered[::-1].index(True)
    between = covered[first:last].count(False)
    main = max((words(s) for s in re.split(r"(?<=[.!?])\s+|\n+", question) if "?" in s), key=len, default=asked)
    matched = len(set(said[i] for i in range(len(said)) if covered[i]) & set(main)) / max(1, len(set(main)))
    return first <= 8 and len(covered) - last <= 1 and between <= 4 and matched >= 0.8 and sum(covered) >= 0.5 * len(covered)


def language(tokens: list[str]) -> tuple[str | None, Counter]:
    """The language whose function words are clearly the most frequent, or None; and their counts."""
    seen = Counter({lang: sum(map(frequent.__contains__, tokens)) for lang, frequent in FUNCTION.items()})
    second, n = sorted(seen.values())[-2:]
    best = next(lang for lang in FUNCTION if seen[lang] == n)
    return (best if n >= 2 and n >= 1.4 * second else None), seen


def _parts(tokens: list[str]) -> list[str]:
    return [p for t in tokens for p in (t.replace("’", "'").split("'") if "'" in t or "’" in t else (t,))]


def script(text: str) -> str:
    """The script of most letters: latin, or the first word of the letters' names in Unicode."""
    odd = [c for c in text if c > "ɏ" and c.isalpha()]
    if not odd:
        return "latin"
    if 2 * len(odd) <= sum(c.isalpha() for c in text):
        return "latin"
    return Counter(unicodedata.name(c, "unknown").split()[0].lower() for c in odd).most_common(1)[0][0]


def is_wrong_language(question: str, answer: str, said: list[str] | None = None, asked_words: list[str] | None = None) -> bool:
    """Whether the answer's script or language differs from the question's, which didn't ask for that language."""
    if not question or not any(c.isalpha() for c in answer):
        return False
    if not (question.isascii() and answer.isascii()) and script(question) != script(answer) and any(c.isalpha() for c in question):
        return True
    given, seen = language(_parts(words(answer) if said is None else said))
    if not given:
        return False
    asked, _ = language(_parts(words(question) if asked_words is None else asked_words))
    if not asked or not given or asked == given or seen[given] < 3 or seen[given] < 2 * seen[asked]:
        return False
    return not ASKED[given].search(question)


def defect_of(question: str | None, answer: str | None) -> str | None:
    """The defect of an answer to its question, or None; a null question counts as empty."""
    question = question or ""
    if is_empty(answer):
        return "empty"
    said, asked = words(answer), words(question)
    if is_copy(question, answer, said, asked):
        return "copy"
    if is_refusal(answer, said):
        return "refusal"
    if is_truncated(answer):
        return "truncated"
    return "wrong_language" if is_wrong_language(question, answer, said, asked) else None


@F.pandas_udf(StringType())
def _defects(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for questions, answers in batches:
        yield pd.Series([defect_of(q if isinstance(q, str) else None, a if isinstance(a, str) else None) for q, a in zip(questions, answers)], dtype=object)


# Else a filter on the result would have every answer judged twice.
_defects = _defects.asNondeterministic()


def answer_defect(question: Column, answer: Column) -> Column:
    """The type of the answer's defect as a string, null where there is none."""
    return _defects(question.cast("string"), answer.cast("string"))


def broken_pairs(logs: DataFrame) -> DataFrame:
    """(id, defect): one row for each entry of ``query_logs`` with a defect.

    Rows of one id agree in question and answer; those that don't give the first of their defects in the alphabet.
    Rows with a null id are left out. Texts are judged where they are read; only ids and defects are shuffled.
    """
    judged = logs.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), answer_defect(F.col("question"), F.col("answer")).alias("defect"))
    return judged.where(F.col("defect").isNotNull()).groupBy("id").agg(F.min("defect").alias("defect"))
