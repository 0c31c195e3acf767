"""Labelled spans for training: cue phrases followed by a value of the right shape.

Only the training script uses this; it labels a bounded sample of texts from which the tagger is fitted. Positions are code points.
"""

from __future__ import annotations

import re

from .pii_net import fold_text

UP = "A-ZÀ-ÖØ-ÞŁŞŠŽŻŚĐČĆ"
LOW = "a-zà-öø-ÿłşšžżśđčćńęąřť"
WORD = f"[{UP}][{LOW}]+(?:[{UP}][{LOW}]+)?"
FAMILY = f"(?:{WORD}(?:-{WORD})?|[{UP}]{{2,}}(?:-[{UP}]{{2,}})?)"
INITIAL = f"[{UP}]\\.(?:-?[{UP}]\\.)?"
GIVEN = f"{WORD}(?:-{WORD})?"
NAME = f"(?:{FAMILY}, (?:{GIVEN}(?: {INITIAL})*|{INITIAL})|(?:{GIVEN}|{INITIAL})(?: (?:{GIVEN}|{INITIAL}))? {FAMILY})"
HAN_NAME = "[一-鿿]{2,4}"
TITLE = r"(?:(?:Dr|Prof|Mr|Ms|Mrs|Frau|Herr|M|Mme|Sr|Sra)\.?\s)*"
NAME_CUES = [
    r"prepared by ", r"regards,\s*\n", r"Grüßen,?\s*\n", r"ordialement,\s*\n", r"saludo,\s*\n", r"Please contact ", r"sent to ", r"When asked, ", r"run by ", r"During the visit ",
    r"grateful to ", r"signed for by ", r"Participant ", r"Dear ", r"bitte an ", r"Wir danken ", r"Teilnehmer ", r"remercions ", r"écrire à ", r"Le participant ", r"consultas: ", r"Agradecemos a ",
    r"participante ", r"联系人：", r"，由", r"感谢", r"受试者",
]
PHONE = r"(?:\(\+|\+\s?|\()?\d[\d ()./-]{6,20}\d(?: ext\. \d+)?"
PHONE_CUES = [r"Tel\.: ?", r"Call ", r"Call back: ", r"line is ", r"phone ", r"Joignable au ", r"erreichbar unter ", r"contacto: ", r"电话", r"[\w\]] / ", r"\n"]
VALUE = r"(?<![A-Za-z0-9])(?:(?!ID)[A-Z]{1,2}[ -]?)?\d[0-9A-Z]*(?:[ ./-][0-9A-Z]+(?![a-z]))*"
ID_CUES = [r"File copy holds ", r"A copy of the ", r"Hinterlegt ist nur ", r"Le dossier contient ", r"En la ficha consta ", r"登记信息：", rf"受试者(?:{NAME}|{HAN_NAME})[(（]", rf"(?:Teilnehmer|Participant|participant|participante) {NAME}, ", rf"run by {NAME} \("]
EN_ADDRESS = rf"(?:(?:Flat|Suite|Unit|Apt\.?|Room) \d+, )?\d+[a-z]? (?:{WORD} ){{1,3}}(?:Road|Street|Lane|Way|Court|Avenue|Blvd|St\.|Rd\.?|Ave\.?|Drive|Close|Terrace|Square|Row)(?:, (?:Apt|Flat) \d+)?(?:(?:,|\s*\n)\s*{WORD}(?:,? \d{{5}})?)?"
DE_ADDRESS = rf"(?:(?:{WORD}(?:straße|gasse|weg|str\.|platz|allee|ufer)|Am Alten {WORD}|[{UP}][{LOW}]*(?:straße|gasse|weg|str\.|platz|allee|ufer)) \d+[a-z]?)(?:(?:,|\s*\n)\s*(?:D-)?\d{{5}} {WORD})?"
FR_ADDRESS = rf"\d+(?: bis| ter)?,? (?:rue|avenue|quai|impasse|place|boulevard|allée|chemin|route) (?:d[eu]s?|aux?|de la|de l')? ?(?:{WORD}|Vieux)(?: {WORD})?(?:(?:,|\s*\n)\s*\d{{5}} [{UP}{LOW}]+)?"
ES_ADDRESS = rf"(?:Calle|Avda\.|Plaza|Camino|Paseo) (?:del?|de la|de las|de los)? ?{WORD} \d+(?:, (?:n\.º \d+|\d+º [A-Z]))?(?:(?:,|\s*\n)\s*(?:\d{{5}} )?{WORD})?"
HAN_ADDRESS = r"(?<=寄至)[一-鿿]{2,18}\d+号[一-鿿\d]{0,12}(?=，由|。|$)|(?<=\n)[一-鿿]{2,4}市[一-鿿]{2,14}\d+号[一-鿿\d]{0,12}"
AT = r"(?:@| @ |\s?\(at\)\s?|\s?\[at\]\s?| at )"
DOT = r"(?:\.|\[dot\]|\(dot\)|\s\[dot\]\s|\s\(dot\)\s| dot )"
EMAIL = rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*{AT}[A-Za-z0-9][\w-]*(?:{DOT}[A-Za-z][\w-]*)+"
_EMAIL, _VALUE = re.compile(EMAIL, re.ASCII), re.compile(VALUE)
_PHONES = [re.compile(f"({c})({PHONE})") for c in PHONE_CUES]
_NAMES = [re.compile(f"({c}{TITLE})({NAME}|{HAN_NAME}(?=，|[(（]|签收|协助|\\s|$))") for c in NAME_CUES]
_SECOND = re.compile(rf" and ({NAME})")
_IDS = [re.compile(c) for c in ID_CUES]
_ADDRESSES = [re.compile(x) for x in (EN_ADDRESS, DE_ADDRESS, FR_ADDRESS, ES_ADDRESS, HAN_ADDRESS)]


def spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and type of the labelled spans, without overlaps."""
    t = fold_text(text)
    found: list[tuple[int, int, str]] = []
    found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(t) if " at " not in m.group() or " dot " in m.group()]
    for rx in _ADDRESSES:
        found += [(m.start(), m.end(), "address") for m in rx.finditer(t)]
    for rx in _IDS:
        for c in rx.finditer(t):
            m = _VALUE.search(t, c.end(), min(len(t), c.end() + 60))
            if m and sum(x.isdigit() for x in m.group()) >= 4 and "." not in re.sub(r"n\.º|[Nn]r\.|no\.|nr\.", "", t[c.end() : m.start()]):
                found.append((m.start(), m.end(), "id_number"))
    for rx in _PHONES:
        for m in rx.finditer(t):
            value = m.group(2)
            digits = sum(c.isdigit() for c in value.split(" ext")[0])
            if 8 <= digits <= 14 and not re.fullmatch(r"\d{4}[ -]\d{3,4}|\d+\.\d+", value):
                found.append((m.start(2), m.end(2), "phone"))
    for rx in _NAMES:
        for m in rx.finditer(t):
            found.append((m.start(2), m.end(2), "name"))
            if m.group(1).startswith("grateful") and (n := _SECOND.match(t, m.end())):
                found.append((n.start(1), n.end(1), "name"))
    out: list[tuple[int, int, str]] = []
    for s in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out
