"""Made sentences for training: invented values in contexts of many kinds, and sentences with numbers and capitals that are no personal information.

Only the training script uses this. Contexts are split by their position in the lists, so whole phrases are held out.
"""

from __future__ import annotations

import numpy as np

GIVEN = "Jane John Peter Maria Ahmed Wei Olga Carlos Fatima Ivan Sofia Liam Noah Emma Mia Lukas Hannah Pierre Camille Diego Lucia Marek Zofia Anders Ingrid Priya Arjun Yuki Kenji Chloe Oscar Nadia Tomas Elena Bruno Greta Felix Ines Hugo Astrid Samir Leila Victor Irene Paul Laura Martin Julia Robert Susan Kevin Linda George Alice Frank Helen Jens Karin Luis Rosa".split()
FAMILY = "Doe Smith Hansen Lopez Miller Nguyen Kowalski Petrov Rossi Garcia Martin Bernard Dubois Moreau Schmidt Weber Fischer Becker Novak Svensson Larsen Nielsen Johnson Brown Taylor Wilson Khan Patel Singh Tanaka Suzuki Kim Park Fernandez Ortega Ruiz Silva Costa O'Brien MacLeod Baker Carter Turner Phillips Evans Cooper Reed Morgan Bailey Hughes Long Foster Sanders Price Wood Barnes Ross Hill Green Field".split()
CITY = "Dayton Leeds Porto Lyon Graz Utrecht Bergen Malaga Gdansk Tampere Boulder Halifax Cork Bremen Nantes Toledo Verona Brno Ghent Aarhus Springfield Riverton Oakdale Fairview".split()
STREET = "Elm Oak Maple Station Church Mill High Park Lake River Victoria Garden Hill Cedar Bridge Market King Queen Walnut Chestnut".split()
SYLLABLES = "ka lo mi ver den tor bra sel vin gar mon tel ros han dal ber kin mar fen ul wes ter quin os lan dre".split()
HAN_FAMILY, HAN_GIVEN = "王李张刘陈杨赵黄周吴徐孙马朱胡林郭何高罗", "伟芳娜敏静强磊洋艳勇军杰娟涛明超秀霞平刚桂英建华文玲红丽辉鹏"
TLD = "com org net edu de fr es io co.uk example".split()

CONTEXTS = [
    "My colleague {name} can be reached at {email} or {phone}.", "Ask {name} in accounting; the badge is {id}, phone {phone}.", "Our new address is {address}, as of last Tuesday.", "{name} lives at {address}, near the old bridge.", "Reply to {email} before Friday.",
    "The patient, {name}, gave the insurance number {id}.", "Employee number {id} belongs to {name}.", "You may ring {phone} at any hour.", "We met {name} and {name} in {city}.", "Passport no. {id} was shown by {name}.", "Yesterday {name} called from {phone}.", "{name} wrote: see {email}.",
    "For questions write to {name}, {address}.", "Deliver the parcel to {address}.", "Signed, {name}", "cc: {name} <{email}>", "{name} ({email}) agreed.", "Mobile {phone}, office {phone}", "his social security number is {id}", "Student ID {id}, {name}, enrolled in {city}.", "{name}'s number is {phone}.",
    "Thanks to {name} for the sketches.", "The nurse on duty was {name}.", "Samples were handed over by {name} of {city}.", "According to {name}, the pump failed.", "the visitor ({name}, badge {id}) left at noon", "Invoice to: {name}, {address}", "Contact: {name}; e-mail: {email}; phone: {phone}", "I spoke to {name} about it.",
    "tax number {id} of {name}", "{address} is where the interviews took place.", "Call {name} on {phone} or drop by at {address}.", "driver's licence {id}", "health record {id} was opened for {name}", "Author: {name}", "Supervisor {name} approved the plan, {email}", "fax {phone}", "Home: {address}", "staff card {id}",
    "The letter of {name} arrived from {address}.", "Dr {name} and Prof. {name} disagreed.", "Emergency contact {name}, {phone}", "Please ask for {name} at the desk.", "{name}, {address}, last Tuesday", "Ms {name} of room 12 has the key.", "the account of {name} uses {email}",
    "Kollegin {name} ist unter {phone} zu sprechen.", "Anschrift: {address}", "Herr {name} wohnt in der {address}.", "Schreiben Sie an {email}.", "Personalnummer {id}, {name}", "Rückfragen an {name}, Telefon {phone}", "Die Versicherungsnummer von {name} lautet {id}.", "Frau {name} hat das Gerät geprüft.", "Ausweis {id}",
    "Mon collègue {name} répond au {phone}.", "Adresse : {address}", "Mme {name} habite {address}.", "Écrivez à {email}.", "Numéro de sécurité sociale {id}", "{name} a signé le registre.", "Appelez {name} au {phone}.",
    "Mi colega {name} responde en {email}.", "Dirección: {address}", "El señor {name} vive en {address}.", "Llame al {phone} y pregunte por {name}.", "Pasaporte {id} de {name}", "{name} firmó el acta.",
    "请联系{han}，电话{phone}。", "{han}的身份证号是{id}。", "邮箱：{email}", "样品由{han}送来。", "护照号{id}，姓名{han}。", "{han}老师负责此项目。",
]
PLAIN = [
    "as {family} ({year}) has shown", "{family} and {family} ({year}) measured it", "the {family}–{family} model", "University of {city}", "the {city} Institute of Technology", "see Figure 3 and Table 12", "version 3.2.{n} of the script", "sample AB-{n}{n} was dried", "Lot {n}{n} of the resin", "on 12 March {year}", "Monday Morning Seminar", "the {street} River basin",
    "grant no. {n}/{year}", "between {n} and {n} mg", "pp. {n}–{n}", "{family} et al., {year}", "doi 10.{n}/{n}", "at {n} °C and {n} rpm", "the {family} effect", "in New {city} and Old {city}", "accession {n}{n}", "ISBN 978-3-{n}-{n}-1", "Order {n}{n} was cancelled", "Room {n}, Building {n}", "the North {street} Lake Project", "{n} June {year}, {city}", "Last Tuesday", "Ask again later", "Please Note",
    "Version {n}", "Grants {n} and {n}", "Band {n} was cut", "im Jahr {year}", "nach {family} ({year})", "die Probe {n}", "selon {family} ({year})", "según {family} ({year})", "编号{n}的样品", "第{n}页", "The Annual Report", "Total {n} {n} {n}", "item 12-{n}-{n}", "Kelvin Probe Microscopy", "Python 3.{n}",
]


def values(r: np.random.Generator) -> dict:
    """A maker of values for each slot."""
    pick = lambda a: a[int(r.integers(len(a)))]
    digits = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    made = lambda: "".join(pick(SYLLABLES) for _ in range(int(r.integers(2, 4)))).capitalize()
    given = lambda: pick(GIVEN) if r.random() < 0.6 else made()
    family = lambda: pick(FAMILY) if r.random() < 0.6 else made() + ("-" + made() if r.random() < 0.1 else "")
    cap = lambda n: "".join(chr(65 + int(x)) for x in r.integers(0, 26, n))

    def name():
        g, f = given(), family()
        k = r.random()
        if k < 0.55:
            return f"{g} {f}"
        if k < 0.7:
            return f"{g} {cap(1)}. {f}"
        if k < 0.8:
            return f"{cap(1)}. {f}"
        if k < 0.88:
            return f"{f}, {g}" if r.random() < 0.5 else f"{f}, {cap(1)}."
        return f"{g} {given()} {f}" if k < 0.95 else f"{g.upper()} {f.upper()}"

    def email():
        a, b = given().lower().replace("'", ""), family().lower().replace("'", "")
        user = pick([f"{a}.{b}", f"{a[0]}{b}", f"{a}_{b}{digits(2)}", f"{b}{digits(1)}", f"{a}+lab", a])
        return f"{user}@{pick([made().lower(), made().lower() + '-lab', 'mail.' + made().lower(), 'example'])}.{pick(TLD)}"

    def phone():
        return pick([f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+1 {digits(3)} {digits(3)} {digits(4)}", f"0{digits(3)} {digits(7)}", f"+49 {digits(3)} {digits(6)}", f"+44 20 {digits(4)} {digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+34 {digits(3)} {digits(3)} {digits(3)}", f"1{digits(10)}", f"+86 1{digits(2)} {digits(4)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])

    def number():
        return pick([f"{cap(2)}-{digits(6)}", digits(int(r.integers(5, 10))), f"{digits(3)}-{digits(2)}-{digits(4)}", f"{cap(1)}{digits(7)}", f"{digits(8)}{cap(1)}", f"{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"{cap(2)} {digits(2)} {digits(2)} {digits(2)} {cap(1)}", digits(17) + "X", f"{digits(2)}{cap(1)}{digits(5)}"])

    def address():
        n = int(r.integers(1, 300))
        kind = pick("Street Road Avenue Lane Drive St. Ave. Rd. Court Way".split())
        town = pick([f", {pick(CITY)}", f", {pick(CITY)} {digits(5)}", "", f", {pick(CITY)}"])
        return pick([f"{n} {pick(STREET)} {kind}{town}", f"Apt {n % 30 + 1}, {n} {pick(STREET)} {kind}{town}", f"{n} {made()} {kind}{town}", f"{made()}straße {n}, {digits(5)} {pick(CITY)}", f"{pick(STREET)}weg {n}a, {digits(5)} {pick(CITY)}", f"{n}, rue de {made()}, {digits(5)} {pick(CITY)}", f"{n} avenue {made()}, {digits(5)} {pick(CITY)}", f"Calle {made()} {n}, {digits(5)} {pick(CITY)}", f"Plaza de {made()} {n}, {pick(CITY)}"])

    return {
        "name": name, "email": email, "phone": phone, "id": number, "address": address, "city": lambda: pick(CITY), "street": lambda: pick(STREET), "family": family, "year": lambda: str(int(r.integers(1960, 2026))), "n": lambda: digits(int(r.integers(1, 4))),
        "han": lambda: pick(HAN_FAMILY) + "".join(pick(HAN_GIVEN) for _ in range(int(r.integers(1, 3)))),
    }


TYPE_OF = {"name": "name", "han": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address"}


def sentence(template: str, makers: dict) -> tuple[str, list[tuple[int, int, str]]]:
    """A filled template and its labelled spans."""
    out, found, at = "", [], 0
    while (a := template.find("{", at)) >= 0:
        b = template.index("}", a)
        slot = template[a + 1 : b]
        out += template[at:a]
        value = makers[slot]()
        if slot in TYPE_OF:
            found.append((len(out), len(out) + len(value), TYPE_OF[slot]))
        out += value
        at = b + 1
    return out + template[at:], found


def held_out(k: int) -> bool:
    """Every fifth context is kept for scoring."""
    return k % 5 == 2


def made(r: np.random.Generator, count: int, fillers: list[str], held: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of one or two made sentences between pieces of other text, with their spans."""
    makers = values(r)
    contexts = [c for k, c in enumerate(CONTEXTS) if held_out(k) is held]
    out = []
    for _ in range(count):
        text, found = "", []
        for kind in r.permutation(["filler", "made", "made" if r.random() < 0.5 else "plain", "plain", "filler"][: int(r.integers(2, 6))]):
            if text:
                text += ["\n", " ", " ", " "][int(r.integers(4))]
            if kind == "filler":
                text += fillers[int(r.integers(len(fillers)))]
                continue
            s, f = sentence(contexts[int(r.integers(len(contexts)))] if kind == "made" else PLAIN[int(r.integers(len(PLAIN)))], makers)
            found += [(a + len(text), b + len(text), k) for a, b, k in f]
            text += s
            if kind == "plain" and r.random() < 0.5:
                text += "."
        out.append((text, found))
    return out
