"""Personal information in free text: found by labelers whose votes are weighed, replaced by typed placeholders.

Each text is read once for candidate spans of five kinds. Three labelers vote on each - its form (patterns), a
gazetteer (street words, top-level domains, dialling prefixes, and names that the corpus itself introduces by
phrases such as "my name is"), and its context (phrases before and after). Expectation-maximisation over the counts
of vote patterns, which are made of all rows, estimates how reliable each labeler is and how likely each pattern
is a mention; a logistic span classifier is then fitted to those probabilities on votes, form and neighbouring words,
and decides. Only patterns, counts and weights reach the driver, and their number doesn't grow with the data.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.pairs import FUNCTION
from corpusflow.session import broadcast_if_small, checkpointed

KINDS = ("email", "phone", "identity_number", "street_address", "name")
BUCKETS = 128
#: Most different feature rows that the classifier is fitted on, chosen by hash.
FIT_ROWS = 20_000

# ---- patterns --------------------------------------------------------------------------------------------------
UPPER, LOWER = "A-ZÄÖÜÀ-ÖØ-Þ", "a-zäöüßà-öø-ÿ"
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_POINT = r"(?:dot|punkt|point|punto)"
_DOT = rf"(?:\.|\s*[(\[{{]\s*{_POINT}\s*[)\]}}]\s*|\s+{_POINT}\s+)"
_AT = r"(?:at|ät|arroba|arobase)"
SPELLED = re.compile(
    rf"(?<![\w.+-])[\w+-]++(?:{_DOT}[\w+-]+)*\s*(?:[(\[{{]\s*{_AT}\s*[)\]}}]|\s@\s)\s*[\w-]++(?:{_DOT}[\w-]++)+"
    rf"|(?<![\w.+-])[\w+.-]++(?:\s+{_POINT}\s+[\w+-]++)*\s+{_AT}\s+[\w-]++(?:(?:\.|\s+{_POINT}\s+)[\w-]++)*+(?<=\w)(?!\s+{_AT}\s)", re.I,
)
_SEP = r"(?:[ .\-/]|[ ]?\(|\)[ .]?)?"
NUMBER = re.compile(rf"(?<![\w@.,/#=&-])(?:\+\s?\d|\(\+?\d|\d)(?:{_SEP}\d){{6,17}}(?:-?[A-Z](?!\w))?(?:\s*,?\s*(?:ext\.?|x|extension|durchwahl|poste|extensión)\s*\d{{1,5}})?(?![\w@]|[-/]\w)", re.I)
LETTERED = re.compile(r"(?<![\w@.,/#=&-])(?:[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Z]|[A-Z]\d{8}|[A-Z]\d{3}[A-Z0-9]\d{2}[A-Z0-9]\d|\d{2}[A-Z]{2}\d{5}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-?[A-Z])(?![\w@])", re.I)
PHONE_FORMS = re.compile(
    r"(?:\+|00)\s?(?:1|3[0-9]|4[0-9]|351|353|420)[\d ().\-/]{6,}|\+?1?[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}|\(0\d{2,4}\)\s?\d[\d -]{4,}|0\d{2,4}[ /-]\d[\d -]{4,}|0[1-9](?:[ .-]?\d{2}){4}|[6-9]\d{2}[ .-]\d{3}[ .-]\d{3}|[6-9]\d{2}(?:[ .-]\d{2}){3}"
)
ID_FORMS = re.compile(
    r"(?i:[a-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[a-z]|[a-z]\d{8}|[a-z]\d{3}[a-z0-9]\d{2}[a-z0-9]\d|\d{2}[a-z]{2}\d{5}|[xyz]-?\d{7}-?[a-z]|\d{8}-?[a-z]|\d{2}\.\d{3}\.\d{3}-?[a-z])|\d{3}([ -])\d{2}\1\d{4}|\d{9}|\d{11}|\d{2}([ /])\d{3}\2\d{3}\2\d{3}|[1-8] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}"
)
# Dialling prefixes of a number's digits; numbers that start so may be phones.
DIALLED = ("+", "00", "0", "(", "1", "5", "6", "7", "9")

STREET_EN = "street|st|road|rd|lane|avenue|ave|court|close|drive|way|place|square|terrace|crescent|boulevard|blvd|row|gardens|grove|walk|mews|hill|parade|quay"
STREET_DE = "straße|strasse|str\\.|allee|weg|gasse|platz|ring|damm|ufer|graben|steig|chaussee|kamp|stieg|hof"
STREET_FR = "rue|avenue|boulevard|bd|chemin|impasse|place|allée|allees|allées|quai|route|cours|square|passage|sentier"
STREET_ES = "calle|c/|avenida|avda\\.?|av\\.|plaza|paseo|camino|carretera|ronda|travesía|vía"
_TOWN = rf"(?:,?\s*(?i:apt|flat|unit|suite)\.?\s*\w{{1,4}}\b)?(?:[,\n]\s*(?:\d{{4,5}}\s+)?[{UPPER}][{LOWER}]+(?:[ -][{UPPER}][{LOWER}]+){{0,2}}(?:,?\s+\d{{4,5}}\b)?)?"
# Addresses are looked for around house numbers: those that a street follows, and those that follow a street.
HOUSE = re.compile(r"(?<![\w.,/-])\d{1,4}(?:\s?[a-zA-Z](?!\w)|\s(?:bis|ter)\b)?(?![\w.]*\d)")
AHEAD_EN = re.compile(rf"\s+((?:[^\W\d][\w'’-]*\s+){{1,2}}(?i:{STREET_EN}))\b{_TOWN}")
AHEAD_FR = re.compile(rf",?\s+((?i:{STREET_FR})\s+(?:(?i:de la|de l['’]|du|des|de|d['’])\s*)?[^\W\d][\w'’-]*(?:[ -][{UPPER}][\w'’-]+)*){_TOWN}")
BEFORE_DE = re.compile(rf"(?:\b[\w-]*(?i:{STREET_DE})|\b(?i:am|an der|im|zum|zur|auf dem)\s+[{UPPER}][\w-]+)\s+$")
BEFORE_ES = re.compile(rf"(?<!\w)((?i:{STREET_ES})\s*(?:[^\W\d][\w'’-]*\s+){{0,4}}?[^\W\d][\w'’-]*),?\s+(?:n[.º°]\s*)?$")
TAIL = re.compile(_TOWN)
FLAT = re.compile(r"\b(?i:flat|apt|unit|suite|apartment)\.?\s+\w{1,4},\s+$")
STREET_END = re.compile(rf"(?i:{STREET_DE})\s*$")

TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Hr|Fr|Mme|Mlle|Sr|Sra|Srta|Don|Doña|Señora?|Monsieur|Madame)\.?"
_W = rf"[{UPPER}][\w'’]+(?:-[{UPPER}][\w'’]+)*"
_I = rf"[{UPPER}]\."
NAME = re.compile(rf"(?<![\w@.&/-])(?:{TITLE}\s+(?:{_I}\s*)*(?:{_W}[ ]){{0,2}}{_W}|(?:(?:{_W}|{_I})[ ]){{1,4}}{_W})(?![\w@])")
PLAIN = re.compile(rf"(?:(?P<title>(?i:mr|mrs|ms|dr|herr|frau|mme|sr|sra)\.?)\s+(?:[\w'’]+\s+)?|[\w'’]\.\s*|[\w'’]+\s+(?:\w\.\s+)?)[\w'’]+(?:-[\w'’]+)?(?!\w)")
TITLED = re.compile(rf"{TITLE}\s", re.I)
TWO_CAPITALS = re.compile(rf"[{UPPER}][\W\d_]*[{UPPER}]")
LINE_OR_SENTENCE = re.compile(r"\n|(?<=\w\w[.!?])\s+")
LETTER = re.compile(r"[^\W\d_]")
#: Words from which on capitals are taken as the way that a part is written; names have four at most.
SHOUTED = 5

# Phrases that stand right before and after names.
BEFORE_NAME = re.compile(
    r"(?:my name is|this is|its|it's|i am|i'm|contact ?:|contacto ?:|ansprechpartner(?:in)? ?:|regards,|wishes,|thanks,|sincerely,|grüßen,?|gruß,?|cordialement,|saludos,|signed ?:|gezeichnet ?:|signé ?:|firmado ?:|belongs to|ausgestellt für|appartient à|a nombre de|ask for|\bask|is for|est pour|es para|geht an|m'appelle|name ist|me llamo|hier ist|soy|según|laut|selon|according to|llamar a|rappeler|rückruf an|attn:?|dear|hello|hallo|bonjour|hola|fragen sie|demandez à|pregunte a|gehört|de parte de|met|thanked|invited|informed|reimbursed|hired|emailed|phoned|visited|told|traf|informierte|dankte|erstattete|rencontré|remercié|invité|informé|remboursé|conoció|invitó|informó|agradeció a|reembolsó a|interlocuteur ?:|interlocutrice ?:|responsable ?:|persona de contacto ?:|für)\s*$",
    re.I,
)
AFTER_NAME = re.compile(r"^\s*(?:wrote|schrieb|a écrit|escribió|wohnt|lives|habite|vive|unter\b|au \+?[\d(]|will call|called|[,:]? ?tel\b|\(?id\b|erreichbar)", re.I)
JOINED = re.compile(r"(?:\band|\bund|\bet|\by)\s+$")
NOT_NAME_AFTER = re.compile(r"^[\s,]*(?:ltd|inc|llc|plc|gmbh|ag\b|kg\b|s\.?a\.?\b|s\.?l\.?\b|sarl|holdings?|group|hermanos|& co|team\b|release|portal|ledger|module|suite|platform|street|road|avenue|branded)", re.I)
# Words that are no part of a name, wherever they stand in a run of capitals.
NO_NAME = frozenset(
    "ask contact contacto ansprechpartner regards signed according escalated forwarded passport tax invoice order version room lane asset sku ports check see national please call my hey cc ring ship-to bill-to flat apt team für siehe auftrag rechnung raum gebäude building laut rückruf mein meine rappeler selon appeler llamar según mi me véase teams admins ledger portal holdings ltd gmbh sa s.a hermanos group inc release module suite from tax taxpayer id question answer re thanks thank dear hello hallo bonjour hola bitte ich für can could would should may number social security insurance record file mit freundlichen grüßen cordialement saludos colis paquet paket package sendung envío mon ma numéro carte dni el la le les los der die das den ein eine unser unsere jede each our new old by on at to send write wrote priority storage revenue payment never remember nobody teams about only since room use".split()
).union(*FUNCTION.values())

# Phrases near a number that tell what it is.
PHONE_CUES = re.compile(r"(?:call|phone|tel|cell|ring|mobile|(?<!security )(?<!insurance )number is|reach me on|dial|fax|rufen|rückruf|telefon|handy|\bnummer ist|unter|joindre|rappeler|appelez|téléphone|numéro est|portable|llamar|llamarme|teléfono|móvil|back on)\b\.?[^.\n]{0,45}$", re.I)
NEAR_NAME = re.compile(r"(?:,|\n|:| or | oder | ou | o | und | y | et )\s*$", re.I)
ID_CUES = re.compile(r"(?:social security|insurance record|insurance number|national insurance|tax file|taxpayer|tax id|passport(?: no\.?| number)?|identity card|id card|\bid\b(?! ends)|steuer-?id|steuernummer|ausweis(?:nummer)?|personalausweis|reisepass(?:nummer)?|sozialversicherung\w*|sécurité sociale|carte d['’]identité|numéro fiscal|passeport(?: n[o°º]\.?)?|\bnir\b|\bdni\b|\bnie\b|\bnif\b|documento|pasaporte|seguridad social|número fiscal)[^.\n]{0,25}$", re.I)
OTHER_CUES = re.compile(r"(?:order|ticket|invoice|sku|asset|check ?sum|trace|build|version|port|room|serial|case|auftrag|bestellung|vorgang|rechnung|prüfsumme|commande|facture|dossier|série|pedido|factura|caso|referencia|reference|ref|isbn|iban|suma de control|somme de contrôle|inventar\w*|inventaire|inventario|spur|trace|traza|id ends with|kennung|endet auf|se termine par|termina en)\b[^.\n]{0,22}$", re.I)
AFTER_ID = re.compile(r"^[\s,)]*(?:belongs|ausgestellt|appartient|está a nombre|a été|ist falsch|gehört)", re.I)
AFTER_PHONE = re.compile(r"^\s*(?:an\b|or \+?[\d(]|oder [+(\d]|ou (?:au )?[+(\d]|o \+?[\d(]|ext|, mail|, \S+@)", re.I)
ADDRESS_CUES = re.compile(r"(?:moved to|ship-to:|bill-to:|lives at|office at|delivery:|go to|sent? to|address is|wohnt|wohnung:|lage:|geht an|adresse ist|büro|anschrift|liefer\w*|adresse est|bureau du|habite|livrer|domicilié\w*|oficina de|dirección|envío|entregar|vive en|domicilio|sita en)[^\n.]{0,60}$", re.I)
EMAIL_CUES = re.compile(r"(?:reach me at|mail|send|copy to|from|contact|cc|an |to |à |a |erreichbar|schicken|écrivez|escriban|correo|copia|copie|depuis|von|desde|,\s*|<|\n)\s*$", re.I)
# Top-level domains beside those of two letters.
DOMAINS = frozenset("com net org edu gov mil int info biz name io test example invalid localhost app dev cloud online".split())


def _mask(span: str) -> str:
    out = re.sub(r"\d", "9", span)
    out = re.sub(rf"[{UPPER}]", "A", out)
    return re.sub(r"[^\W\d_A]+", "a", out)[:28]


CUE_WORD = re.compile(r"[^\W\d_]+|[^\w\s]")


def _bucket(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode("utf-8", "replace")) % BUCKETS


class _Found:
    """The candidates of one text."""

    def __init__(self, text: str) -> None:
        self.text, self.rows, self.taken = text, [], []
        self.lower = text.lower()
        if len(self.lower) != len(text):
            self.lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def add(self, kind: str, start: int, end: int, form: int, gazetteer: int, context: int, given: str = "", family: str = "") -> None:
        span = self.text[start:end]
        before = re.findall(r"\w+", self.text[max(0, start - 24) : start].lower())[-1:]
        after = re.findall(r"\w+", self.text[end : end + 24].lower())[:1]
        left = " ".join(CUE_WORD.findall(self.lower[max(0, start - 40) : start])[-2:])
        right = " ".join(CUE_WORD.findall(self.lower[end : end + 40])[:2])
        self.rows.append((kind, start, end, form, gazetteer, context, _bucket("mask", _mask(span)), _bucket("before", *before), _bucket("after", *after), given, family, left, right))

    def free(self, start: int, end: int) -> bool:
        return all(end <= a or start >= b for a, b in self.taken)


def _emails(f: _Found) -> None:
    text, low = f.text, f.lower
    spans = [(m.start(), m.end(), True) for m in EMAIL.finditer(text)] if "@" in text else []
    bracketed = any(x in low for x in ("(at", "[at", "{at", "(arro", "[arro", "(ät", "( at", "[ at", " @ "))
    if bracketed or any(x in low for x in (" at ", " ät ", " arroba ", " arobase ")) and any(x in low for x in (" dot ", " punkt ", " point ", " punto ")):
        spans += [(m.start(), m.end(), False) for m in SPELLED.finditer(text) if bracketed or re.search(rf"\s{_POINT}\s", m.group(), re.I)]
    for start, end, plain in spans:
        if not f.free(start, end):
            continue
        span = text[start:end].rstrip(".")
        top = re.split(r"\W+|\s", span.lower())[-1]
        known = 1 if top in DOMAINS or plain and len(top) == 2 and top.isalpha() else -1 if not top.isalpha() else 0
        form = -1 if not top.isalpha() or len(top) < 2 else 1
        f.taken.append((start, start + len(span)))
        f.add("email", start, start + len(span), form, known, 1 if EMAIL_CUES.search(text[max(0, start - 40) : start]) else 0)


def _addresses(f: _Found, digits: list[int]) -> None:
    text = f.text
    for at in digits:
        m = HOUSE.match(text, at)
        if not m:
            continue
        start, end, kind, street = m.start(), m.end(), "", ""
        left = text[max(0, start - 70) : start]
        if ahead := AHEAD_EN.match(text, end):
            kind, street, end = "en", ahead.group(1), ahead.end()
            if flat := FLAT.search(left):
                start -= len(flat.group())
        elif ahead := AHEAD_FR.match(text, end):
            kind, street, end = "fr", ahead.group(1), ahead.end()
        elif behind := BEFORE_DE.search(left):
            kind, street, start, end = "de", behind.group(), start - len(behind.group()), TAIL.match(text, end).end()
        elif behind := BEFORE_ES.search(left):
            kind, street, start, end = "es", behind.group(1), start - len(behind.group()), TAIL.match(text, end).end()
        if not kind:
            continue
        tokens = list(re.finditer(r"[\w'’-]+", text[m.end() : end])) if ahead else []
        while tokens and len(tokens) > 2 and tokens[-1].group().lower() in NO_NAME:
            end = m.end() + tokens.pop().start()
        end = start + len(text[start:end].rstrip(" ,\n"))
        if not f.free(start, end):
            continue
        capital = any(w[:1].isupper() for w in re.findall(r"[^\W\d_]{3,}", street))
        words = {w for w in re.findall(r"[^\W\d_]+", street.lower())}
        loose = kind == "de" and not STREET_END.search(street)
        gazetteer = 0 if loose else 1
        if kind == "en" and words & _STOP_IN_STREET or kind == "es" and len(words & FUNCTION["es"]) > 2:
            gazetteer = -1
        context = 1 if ADDRESS_CUES.search(text[max(0, start - 80) : start]) else 0
        form = 1 if capital and not loose else 0
        if form + gazetteer + context > 0:
            f.taken.append((start, end))
        f.add("street_address", start, end, form, gazetteer, context)


_STOP_IN_STREET = (FUNCTION["en"] - {"upper", "st", "old", "the"}) | {"percent", "working", "days", "weeks", "tickets", "requests", "thousand"}


def _numbers(f: _Found, digits: list[int]) -> None:
    text, seen, reached = f.text, [], 0
    spans = []
    for at in digits:
        if at < reached:
            continue
        m = next((m for back in (3, 2, 1, 0) if at >= back and (m := LETTERED.match(text, at - back)) and m.end() > at), None)
        m = m or next((m for back in (2, 1, 0) if at >= back and (m := NUMBER.match(text, at - back)) and m.end() > at), None)
        if m:
            spans.append((m.start(), m.end()))
            reached = m.end()
    for start, end in spans:
        if not f.free(start, end) or any(start < b and a < end for a, b in seen):
            continue
        span = text[start:end].strip()
        digits = re.sub(r"\D", "", re.sub(r"(?i)\s*,?\s*(?:ext\.?|x|extension|durchwahl|poste|extensión)\s*\d{1,5}$", "", span))
        if re.fullmatch(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d?|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d", span) or len(set(digits)) < 2:
            continue
        seen.append((start, end))
        left, right = text[max(0, start - 70) : start], text[end : end + 30]
        phone_cue, id_cue, other = PHONE_CUES.search(left), ID_CUES.search(left), OTHER_CUES.search(left)
        nearest = max((m.start(), k) for k, m in (("phone", phone_cue), ("id", id_cue), ("other", other)) if m)[1] if phone_cue or id_cue or other else ""
        if not nearest and AFTER_ID.search(right):
            nearest = "id"
        elif not nearest and AFTER_PHONE.search(right):
            nearest = "phone"
        core = re.sub(r"(?i)\s*,?\s*(?:ext\.?|x|extension|durchwahl|poste|extensión)\s*\d{1,5}$", "", span)
        letters = any(c.isalpha() for c in core)
        phone_form = 1 if PHONE_FORMS.fullmatch(core) else -1 if letters or len(digits) < 8 or len(digits) > 15 else 0
        id_form = 1 if ID_FORMS.fullmatch(core) else -1
        counted = nearest == "other"
        dialled = 1 if span.startswith(("+", "00", "(0", "0")) and not letters and (len(digits) != 11 or PHONE_FORMS.fullmatch(core) and span.startswith(("+", "(", "00 1", "001", "0 ", "02", "03"))) else 0 if span.startswith(DIALLED) and not letters else -1
        listed = NEAR_NAME.search(left) and not nearest
        if not letters:
            f.add("phone", start, end, phone_form, -1 if counted else dialled, 1 if nearest == "phone" else -1 if nearest in ("id", "other") else 1 if listed and phone_form > 0 else 0)
        f.add("identity_number", start, end, id_form, -1 if counted else 1 if letters and id_form > 0 else 0 if phone_form < 1 else -1, 1 if nearest == "id" else -1 if nearest in ("phone", "other") else 0)


def _context_of_name(text: str, start: int, end: int) -> int:
    left, right = text[max(0, start - 48) : start], text[end : end + 40]
    if NOT_NAME_AFTER.search(right):
        return -1
    if BEFORE_NAME.search(left) or AFTER_NAME.search(right):
        return 1
    return 0


def _not_capitals(text: str) -> list[tuple[int, int]]:
    """The parts of a text that don't stand in capitals.

    A line or sentence stands in capitals if most of its words do; a run of them counts from ``SHOUTED`` words on, as
    less may be a name by itself, or if it is the whole text.
    """
    if not TWO_CAPITALS.search(text):
        return [(0, len(text))]
    runs: list[list[int]] = []  # start, whether in capitals, words
    at = 0
    for end, following in [*((m.start(), m.end()) for m in LINE_OR_SENTENCE.finditer(text)), (len(text), len(text))]:
        part = text[at:end]
        if LETTER.search(part):
            words = [w for w in part.split() if LETTER.search(w)] if TWO_CAPITALS.search(part) else []
            shouted = sum(map(str.isupper, words)) > 0.6 * len(words)
            if runs and runs[-1][1] == shouted:
                runs[-1][2] += len(words)
            else:
                runs.append([at, shouted, len(words)])
        at = following
    parts: list[tuple[int, int]] = []
    for (start, shouted, n_words), end in zip(runs, [*(r[0] for r in runs[1:]), len(text)]):
        if shouted and (n_words >= SHOUTED or len(runs) == 1):
            continue
        if parts and parts[-1][1] == start:
            start = parts.pop()[0]
        parts.append((start, end))
    return parts


def _names(f: _Found, lines: str) -> None:
    """``lines`` is the text with its line breaks."""
    text = f.text
    last_end = -1
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, plain: bool) -> None:
        nonlocal last_end
        span = text[start:end]
        titled = TITLED.match(span)
        parts = re.findall(r"[\w'’]+(?:-[\w'’]+)*\.?", span[titled.end() :] if titled else span)
        parts = [p for p in parts if p]
        family = parts[-1].lower().split("-")[0].rstrip(".") if parts else ""
        given = parts[0].lower().rstrip(".") if len(parts) > 1 else ""
        context = _context_of_name(text, start, end)
        if not context and JOINED.search(text[max(0, start - 6) : start]) and 0 <= start - last_end <= 6:
            context = 1
        if context > 0:
            last_end = end
        form = 1 if titled or len(given) == 1 else 0 if plain else 1 if len(parts) in (2, 3) else 0
        taken.append((start, end))
        f.add("name", start, end, form, 0, context, "." if titled and not given else given, family)

    for part in _not_capitals(lines):
        for m in NAME.finditer(text, *part):
            start, end = m.start(), m.end()
            if not TITLED.match(m.group()):
                tokens = list(re.finditer(r"\S+", m.group()))
                while len(tokens) > 1 and tokens[0].group().lower().rstrip(".,:") in NO_NAME and not re.fullmatch(_I, tokens[0].group()):
                    tokens.pop(0)
                while len(tokens) > 1 and tokens[-1].group().lower() in NO_NAME:
                    tokens.pop()
                if len(tokens) < 2 or any(t.group().lower() in NO_NAME for t in tokens[1:]):
                    continue
                start, end = m.start() + tokens[0].start(), m.start() + tokens[-1].end()
            if f.free(start, end):
                add(start, end, False)
    for at in _ends_of(f.lower, CUE_STARTS):
        m = PLAIN.match(text, at)
        if not m or any(m.start() < b and a < m.end() for a, b in taken) or not f.free(m.start(), m.end()):
            continue
        words = [w.lower().rstrip(".") for w in re.findall(r"[\w'’-]+", m.group())]
        words = words[1:] if m.group("title") else words
        if any(w in NO_NAME and len(w) > 1 for w in words) or any(c.isdigit() for c in m.group()) or not words:
            continue
        if text[m.end() : m.end() + 5].lower().startswith((" dot ", " at ", "@", " (at")):
            continue
        add(m.start(), m.end(), True)
    for m in CUE_ENDS.finditer(text) if any(c in f.lower for c in WROTE) else ():
        start, end = m.start(1), m.end(1)
        words = [w.lower() for w in re.findall(r"[\w'’-]+", m.group(1))]
        if not any(start < b and a < end for a, b in taken) and f.free(start, end) and not any(w in NO_NAME and len(w) > 1 for w in words):
            add(start, end, True)


# What a name in small or capital letters only may follow or go before.
CUE_STARTS = tuple(
    "my name is|hey it's|hey its|contact:|contact :|contacto:|contacto :|ansprechpartner:|regards,|grüßen|cordialement,|saludos,|signed:|belongs to|appartient à|a nombre de|ask for|ask|m'appelle|name ist|me llamo|soy|según|laut|selon|according to|llamar a|rappeler|rückruf an|interlocuteur :".split("|")
)
WROTE = (" wrote", " writes", " schrieb", " schreibt", " a écrit", " écrit", " escribió", " escribe", " called", " lives", " wohnt", " habite", " vive")


def _ends_of(lower: str, cues: tuple[str, ...]) -> Iterator[int]:
    """Where the word after each of the cues starts."""
    for cue in cues:
        at = lower.find(cue)
        while at >= 0:
            end = at + len(cue)
            if not (at and lower[at - 1].isalnum()) and (cue[-1] == "(" or lower[end : end + 1].isspace()):
                while lower[end : end + 1].isspace():
                    end += 1
                yield end
            at = lower.find(cue, at + 1)


CUE_ENDS = re.compile(r"(?<![\w.@])([^\W\d_]+(?: \w\.)? [^\W\d_]+(?:-[^\W\d_]+)?)(?= (?:wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|escribe|called|lives|wohnt|habite|vive)\b)", re.I)
DIGITS = re.compile(r"\d+")
# Blanks and hyphens that don't break lines, and what they are read as; lengths stay.
PLAIN_MARKS = {0xA0: " ", 0x2007: " ", 0x2009: " ", 0x202F: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-"}
WRAPPED = re.compile(r"(?<=[^\n]{40})\n(?=[^\n])")


def candidates(text: str | None) -> list[tuple]:
    """(kind, start, end, votes of form, gazetteer and context, three feature buckets, given and family name)."""
    if not text:
        return []
    text = text if text.isascii() else text.translate(PLAIN_MARKS)
    f = _Found(WRAPPED.sub(" ", text) if "\n" in text else text)
    digits = [m.start() for m in DIGITS.finditer(f.text)]
    _emails(f)
    if digits:
        _addresses(f, digits)
        _numbers(f, digits)
    _names(f, text)
    return f.rows


COLUMNS = "kind string, start int, end int, form int, gazetteer int, context int, mask int, before int, after int, given string, family string, left string, right string"


def candidate_spans(texts: DataFrame) -> DataFrame:
    """The candidates of (table_name, row_id, text), each once; texts are read where they are and never shuffled."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["table_name", "row_id", *(c.split()[0] for c in COLUMNS.split(", "))]
        for batch in batches:
            rows = [(t, r, *c) for t, r, x in zip(batch["table_name"], batch["row_id"], batch["text"]) for c in candidates(x if isinstance(x, str) else None)]
            yield pd.DataFrame(rows, columns=names)

    return texts.mapInPandas(scan, f"table_name string, row_id string, {COLUMNS}").distinct()


def with_name_lexicon(spans: DataFrame, least: int = 3) -> DataFrame:
    """The gazetteer's votes on names: both parts are introduced as names elsewhere ``least`` times, or neither is."""
    named = spans.where("kind = 'name' and context > 0 and form > 0")
    counted = lambda c: broadcast_if_small(named.where(F.length(c) > 1).groupBy(F.col(c)).agg(F.count("*").alias(f"n_{c}")).where(F.col(f"n_{c}") >= least))
    names = spans.where("kind = 'name'")
    joined = names.join(counted("family"), "family", "left").join(counted("given"), "given", "left")
    family = F.col("n_family").isNotNull()
    given = F.col("n_given").isNotNull() | (F.length("given") == 1)
    vote = F.when(family & given, 1).when(family | F.col("n_given").isNotNull(), 0).otherwise(-1)
    voted = joined.withColumn("gazetteer", vote.cast("int"))
    # Only names have parts to look up.
    return voted.select(*spans.columns).unionByName(spans.where("kind <> 'name'")).drop("given", "family")


def with_learnt_context(spans: DataFrame, least: int = 5, sure_share: float = 0.6) -> DataFrame:
    """The context's votes where no known phrase stands near: the two words before and after a span, as the corpus uses them.

    Words speak for a kind if, at ``least`` times, what they stand next to is sure to be of it by form and gazetteer
    alone, and so is ``sure_share`` of all of the kind's candidates there. Phrases are counted over all spans.
    """
    sure = (F.col("form") > 0) & (F.col("gazetteer") > 0)
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("cue")) for side in ("left", "right")]))
    counted = spans.select("kind", sure.alias("sure"), sides.alias("s")).select("kind", "sure", "s.*").where("cue <> ''").groupBy("kind", "side", "cue").agg(F.count("*").alias("n"), F.count_if("sure").alias("n_sure"))
    cues = checkpointed(counted.where((F.col("n_sure") >= least) & (F.col("n_sure") >= sure_share * F.col("n"))))
    for side in ("left", "right"):
        learnt = broadcast_if_small(cues.where(F.col("side") == side).select("kind", F.col("cue").alias(side), F.lit(1).alias(f"_{side}")))
        spans = spans.join(learnt, ["kind", side], "left")
    near = F.coalesce("_left", "_right", F.lit(0))
    return spans.withColumn("context", F.when(F.col("context") == 0, near).otherwise(F.col("context")).cast("int")).drop("_left", "_right", "left", "right")


def estimate_reliabilities(patterns: Iterable[tuple[tuple[int, ...], float]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation of vote patterns and their counts: the probability of a mention for each pattern.

    Labelers vote -1, 0 (no opinion) or 1 and are taken as independent within mentions and within others. The start is the
    vote's sum; counts are smoothed by one.
    """
    rows = list(patterns)
    if not rows:
        return {}
    votes, counts = np.array([p for p, _ in rows]) + 1, np.array([n for _, n in rows], dtype=float)
    p = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1) + 0.5))
    for _ in range(rounds):
        prior = ((p * counts).sum() + 1) / (counts.sum() + 2)
        yes, no = np.log(prior) * np.ones(len(rows)), np.log(1 - prior) * np.ones(len(rows))
        for labeler in range(votes.shape[1]):
            vote = votes[:, labeler]
            yes_share, no_share, share = (np.bincount(vote, w, 3) + 1 for w in (p * counts, (1 - p) * counts, counts))
            yes_share, no_share, share = (x / x.sum() for x in (yes_share, no_share, share))
            # A vote never speaks against its own sign; one that would says nothing.
            for v, sign in ((2, 1), (0, -1)):
                if sign * (yes_share[v] - no_share[v]) < 0:
                    yes_share[v] = no_share[v] = share[v]
            yes, no = yes + np.log(yes_share)[vote], no + np.log(no_share)[vote]
        p = 1 / (1 + np.exp(np.clip(no - yes, -30, 30)))
    return {tuple(int(v) - 1 for v in row): float(x) for row, x in zip(votes, p)}


def _features(votes: np.ndarray, mask: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    n = len(mask)
    x = np.zeros((n, 1 + 9 + 3 * BUCKETS), np.float32)
    rows = np.arange(n)
    x[:, 0] = 1
    for i in range(3):
        x[rows, 1 + 3 * i + votes[:, i] + 1] = 1
    for i, buckets in enumerate((mask, before, after)):
        x[rows, 10 + i * BUCKETS + buckets] = 1
    return x


def fit_classifier(votes: np.ndarray, mask: np.ndarray, before: np.ndarray, after: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by full-batch gradient steps with a little shrinkage."""
    x, w = _features(votes, mask, before, after), np.zeros(10 + 3 * BUCKETS, np.float32)
    weight = np.sqrt(counts)
    weight = weight / weight.sum()
    momentum = np.zeros_like(w)
    shrink = np.full_like(w, 2e-4)
    shrink[:10] = 1e-5
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = x.T @ ((p - labels) * weight) + shrink * w
        momentum = 0.9 * momentum + step
        w = w - 1.5 * momentum
    return w


def fit(spans: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """The weights for each kind. Vote patterns are counted over all spans; ``fit_rows`` bounds the different feature rows fitted on.

    Where there are more, a fifth of them is kept for each kind, as far as it has so many; the rest goes by hash to any.
    """
    votes = ["form", "gazetteer", "context"]
    features = ["kind", *votes, "mask", "before", "after"]
    counted = checkpointed(spans.groupBy(*features).agg(F.count("*").alias("n")))
    patterns = counted.groupBy("kind", *votes).agg(F.sum("n").alias("n")).toPandas()
    rows = counted.orderBy(F.xxhash64(*features)).limit(fit_rows).toPandas()
    if len(rows) >= fit_rows:
        # Read kind by kind, so no sort holds more than the rows kept.
        share = max(1, fit_rows // len(KINDS))
        kept = pd.concat([counted.where(F.col("kind") == kind).orderBy(F.xxhash64(*features)).limit(share).toPandas() for kind in KINDS])
        rows = pd.concat([kept, rows]).drop_duplicates(features).head(max(fit_rows, len(kept)))
    weights = {}
    for kind in KINDS:
        own = patterns[patterns["kind"] == kind]
        believed = estimate_reliabilities([(tuple(r), n) for r, n in zip(own[votes].to_numpy(), own["n"])])
        of = rows[rows["kind"] == kind]
        if len(of):
            v = of[votes].to_numpy()
            labels = np.array([believed[tuple(r)] for r in v.tolist()])
            weights[kind] = fit_classifier(v, of["mask"].to_numpy(), of["before"].to_numpy(), of["after"].to_numpy(), labels, of["n"].to_numpy(dtype=float))
    return weights


def mentions(texts: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(table_name, row_id, kind, start, end, occurrence) of every mention in (table_name, row_id, text).

    ``start`` and ``end`` count characters from 0; ``occurrence`` numbers the mentions of one kind in one row. A null or empty
    text has none. Rows of one id are one case, and a mention at the same place counts once; of a number that may be
    two things the likelier stands.
    """
    spans = checkpointed(with_learnt_context(checkpointed(with_name_lexicon(checkpointed(candidate_spans(texts))))))
    weights = fit(spans, fit_rows)

    @F.pandas_udf("double")
    def likelihood(kind: pd.Series, form: pd.Series, gazetteer: pd.Series, context: pd.Series, mask: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = np.zeros(len(kind))
        votes = np.stack([form.to_numpy(), gazetteer.to_numpy(), context.to_numpy()], axis=1)
        for k, w in weights.items():
            at = (kind == k).to_numpy()
            out[at] = 1 / (1 + np.exp(-_features(votes[at], mask.to_numpy()[at], before.to_numpy()[at], after.to_numpy()[at]) @ w))
        return pd.Series(out)

    # Else the filter would have every span judged twice.
    judged = spans.withColumn("likely", likelihood.asNondeterministic()("kind", "form", "gazetteer", "context", "mask", "before", "after")).where("likely > 0.5")
    place = Window.partitionBy("table_name", "row_id", "start").orderBy(F.col("likely").desc(), "kind")
    judged = judged.withColumn("_n", F.row_number().over(place)).where("_n = 1")
    order = Window.partitionBy("table_name", "row_id", "kind").orderBy("start")
    return judged.select("table_name", "row_id", "kind", "start", "end", F.row_number().over(order).alias("occurrence"))


def redacted(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(table_name, row_id, text) with each mention replaced by its kind in brackets and the rest unchanged."""
    spans = found.groupBy("table_name", "row_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    joined = texts.distinct().join(spans, ["table_name", "row_id"], "left")
    gap = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.col("text").alias("text")),
        lambda a, s: F.struct(
            F.concat(a["out"], F.substring(a["text"], a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
            s["end"].alias("at"), a["text"].alias("text"),
        ),
        lambda a: F.concat(a["out"], F.substring(a["text"], a["at"] + 1, F.length(a["text"]))),
    )
    return joined.select("table_name", "row_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(gap).alias("text"))


def free_texts(logs: DataFrame, feedback: DataFrame, documents: DataFrame) -> DataFrame:
    """(table_name, row_id, text) of questions, comments and documents; null ids and texts are left out."""
    parts = (("query_logs", logs, "id", "question"), ("feedback_records", feedback, "id", "comment"), ("documents", documents, "doc_id", "text"))
    selected = [t.where(F.col(i).isNotNull() & F.col(c).isNotNull()).select(F.lit(n).alias("table_name"), F.col(i).cast("string").alias("row_id"), F.col(c).alias("text")) for n, t, i, c in parts]
    return reduce(DataFrame.unionByName, selected)
