"""The small labelled table that the personal-data model is trained on, written from broad grammars.

A template is a line of words, slots and choices. Slots are filled with invented values: {P} a person's name, {S} a family
name after a title, {E} an e-mail address, {T} a phone number, {A} a postal address, {I} what announces an identity number
and the number, {N} such a number alone. <NAME> is one of the alternatives of that name, drawn anew each time. Names are
drawn from short lists or made of syllables, so that the model learns from shape and surroundings rather than from names.
"""

from __future__ import annotations

import random
import re

# Common given names of several languages.
GIVEN = (
    "Elena Ruth Renata Chiara Priya Svenja Mehmet Haruto Tobias Anna Amara Joaquín Núria Björn Zoë Élodie Felix Lukas Nadia Marta Greta Clara Sofia Simon "
    "David Martin Maria Peter Paul Yusuf Kenji Wanjiru Lin Hugo Oscar Emil Viktor Jonas Laura Carmen Irene Anneliese Oliver Jürgen Heike Sabine Karl Ingrid "
    "Pierre Marie Camille Luc Benoît Chloé Jean Claire Pablo Lucía Diego Inés Javier Rosa Miguel Pilar Ahmed Fatima Omar Leila Ivan Olga Dmitri Katya Chen Wei "
    "Mei Yuki Akira Sanjay Anjali Ravi Kofi Ama Chidi Ngozi James Mary John Linda Robert Susan Michael Karen William Sarah Thomas Emma Daniel Alice Mark Julia "
    "Kevin Laurent Sven Astrid Lars Freya Matteo Giulia Marco Rafael Beatriz Tomás Aisha Hassan Noor Tariq Minh Linh Arjun Deepa Eva Max Nina Otto Ida "
    "George Helen Edward Grace Henry Louise Andrew Rachel Stefan Monika Klaus Ursula Dieter Birgit Antoine Nicole François Juliette Carlos Ana Luis Elisa "
    "Jorge Raquel Paolo Sergei Irina Piotr Agnieszka Jan Eva"
).split()
# Common family names of several languages.
FAMILY = (
    "Smith Johnson Brown Taylor Wilson Clark Lewis Walker Young Hill Green Baker Carter Mitchell Roberts Turner Phillips Parker Evans Edwards Morris Cook Bell "
    "Murphy Kelly Reid Fraser Müller Schmidt Weber Wagner Becker Hoffmann Koch Richter Klein Wolf Neumann Schwarz Krüger Hartmann Lange Werner Martin Bernard "
    "Dubois Moreau Simon Michel Leroy Roux Bertrand Morel Girard Mercier Lambert Chevalier Faure García Fernández López Martínez Sánchez Pérez Gómez Ruiz Díaz "
    "Torres Vargas Romero Castro Molina Rossi Ferrari Russo Conti Greco Marino Ivanov Smirnov Popov Kowalski Nowak Novák Horvat Jensen Nielsen Larsen Berg "
    "Virtanen Lindqvist Andersson Yamamoto Suzuki Sato Kim Park Nguyen Tran Wang Li Chen Liu Singh Patel Kumar Sharma Khan Rahman Hussain Ali Yilmaz Demir "
    "Cohen Levi Silva Santos Costa Oliveira Okonkwo Mensah Mwangi Diallo Papadopoulos"
).split()
# Titles, and the words that open or close a street's name.
TITLES = "mr mrs ms miss dr prof professor herr frau mme mlle monsieur madame señor señora sr sra sir doctor".split()
STREET_AFTER = "lane road rd row street st drive dr blvd boulevard avenue ave way ct court close mews terrace crescent place square hill walk grove parkway gardens".split()
STREET_BEFORE = "rue chemin place impasse quai allée route calle avda avenida plaza paseo camino ronda travesía via viale c carrer cours".split()
STREET_ENDINGS = ("straße", "str", "strasse", "weg", "gasse", "allee", "platz", "ufer", "ring", "graben", "hof", "damm", "steig", "markt", "park")

_ONSETS = "Ab Ald Bar Bel Ben Bor Bry Cal Car Cor Dal Dar Del Dor Dun Ed Eg Fal Far Fen Gar Gil Gor Had Hal Har Hel Hol Ing Jar Jor Kal Kar Kel Kor Lam Lan Lar Lew Lor Mal Mar Mel Mor Nar Nor Old Or Pal Par Pel Pol Ram Red Ros Sal Sam Sel Sor Tal Tar Tor Ul Val Var Ver Wal War Wel Wil Yar Zal Zor Grün Løv Müll Şah Čer Ngu Oyel Adeb Tak Naka Mura Kow Petr Szab Jov".split()
_ENDINGS = "son sen ton ham ley man mann berg stein feld haus er in ov ova ev eva ski ska ić ez es os as ini etti ano ari ard eau ier ot et oux and holm ström dal vik ic escu idis akis opoulos yan dze shvili wala oglu sen moto mura saki awa chuk enko uk well worth by ford ness low wick shaw croft ridge gate ster der mer".split()
_TOWNS = "Abbeydale Birchwood Carrick Dalebury Eastmoor Fairhaven Greenock Hollins Kingsmere Langdon Millport Northam Oakridge Riverton Sandwell Thornhill Westbrook Altdorf Neukirch Steinbach Rosenau Beaulieu Clairmont Montrouge Villefort Fuentes Miraflores Torrenueva Valverde".split()
_TOWNS2 = ["Cedar Falls", "Lower Heath", "Bad Steinau", "Saint-Marc-le-Vieux", "Torre del Mar", "Villa Real", "Upper Norton", "Saint-Paul", "Port Harriet", "Santa Elvira", "East Linton", "Los Olivos", "Pont-de-Bois", "Neu-Altdorf"]
# Known towns, as they stand in addresses and in other text.
CITIES = (
    "London Paris Berlin Madrid Vienna Wien Munich München Hamburg Köln Lyon Marseille Bordeaux Sevilla Valencia Barcelona Boston Chicago Denver Austin Seattle Dublin Leeds Bristol Oxford York Geneva Basel Zürich Bern Graz Oslo "
    "Stockholm Rome Milan Turin Lisbon Porto Prague Warsaw Budapest Athens Tokyo Kyoto Delhi Mumbai Sydney Perth Toronto Montreal Dallas Houston Phoenix Miami Atlanta Leipzig Dresden Bonn Mainz Toulouse Nantes Lille Zaragoza Bilbao Granada"
).split()
_CITIES2 = ["New York", "Los Angeles", "San Diego", "San Jose", "Santa Fe", "Saint Louis", "New Delhi", "Cape Town", "Hong Kong", "Las Vegas", "Salt Lake City", "El Paso", "Buenos Aires", "Le Havre", "La Rochelle", "Bad Homburg", "Palma de Mallorca", "Santiago de Compostela", "Mexico City"]
_STREETS = "Acorn Ash Bishop Canal Chapel Cherry Cliff Crown Dover Elm Ferry Forge Grange Hazel Ivy Kings Linden Manor Market North Oak Maple Church High Park Victoria Queen Mill Bridge School Spring Lake Washington Garden Meadow Fourth Second River Sunset Pine Walnut".split()
_DE_STREETS = "Hauptstr. Mühlstr. Tannenstraße Lindenallee Birkenweg Mühlenstraße Marktplatz Rosengasse Schulstraße Gartenweg Kirchplatz Ringstr. Schillerstraße Waldweg Neumarkt Stadtpark Bergstraße Dorfstr. Bahnhofstraße Kirchgasse Seeufer Wiesenring Burggraben Eichenhof".split()
_FR_STREETS = ["rue du Marché", "avenue de la Gare", "chemin des Vignes", "place du Théâtre", "boulevard Saint-Michel", "quai de la Loire", "impasse du Moulin", "rue Pasteur", "avenue Jean Moulin", "rue de l'Église", "cours Gambetta", "allée des Tilleuls", "route de Genas", "rue du Vieux Pont"]
_ES_STREETS = ["Calle del Sol", "Avda. de la Paz", "Plaza de España", "Paseo del Prado", "Calle Mayor", "C/ Nueva", "C/ de la Fuente", "C. Real", "Avenida del Mar", "Camino de la Ermita", "Plaza Mayor", "Avenida América", "Calle Goya", "Carrer del Pi", "Ronda Norte", "Paseo de Gracia"]
_TLD = "example test invalid com org net edu io de fr es co.uk ac.uk eu info ch at it".split()


class Fill:
    """Invented values, by a seeded generator."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, pattern: str) -> str:
        return "".join(str(self.r.randrange(10)) if c == "9" else str(self.r.randrange(1, 10)) if c == "8" else self.r.choice("ABCEGHJKLMNPRSTXZ") if c == "X" else c for c in pattern)

    def given(self) -> str:
        if self.r.random() < 0.4:
            return self.r.choice(_ONSETS)[:4].title() + self.r.choice(["a", "in", "o", "elle", "uva", "abet", "eo", "ira", "ko", "drin", "ie", "e", "us", "an", "ette", "ya", "iel", "ine"])
        return self.r.choice(GIVEN)

    def family(self) -> str:
        name = self.r.choice(FAMILY) if self.r.random() < 0.35 else self.r.choice(_ONSETS) + self.r.choice(_ENDINGS)
        lead = self.r.random()
        if lead < 0.06:
            return f"{self.r.choice(['De la', 'van der', 'van', 'von', 'de', 'Di', 'del', 'al', 'Von der', 'Le', 'dos', 'de', 'ten', 'zu', 'da'])} {name}"
        if lead < 0.11:
            return f"{self.r.choice(['O’', 'D’', 'Mc', 'Mac', 'El-', 'Al-', 'O' + chr(39), 'D' + chr(39)])}{name}"
        return f"{name}-{self.r.choice(_ONSETS)}{self.r.choice(_ENDINGS)}" if self.r.random() < 0.05 else name

    def initial(self) -> str:
        return self.r.choice("ABCDEFGHIJKLMNOPRSTVWYZ")

    def person(self) -> str:
        kind, g, f = self.r.random(), self.given(), self.family()
        if kind < 0.5:
            name = f"{g} {f}"
        elif kind < 0.62:
            name = f"{g[0]}. {f}"
        elif kind < 0.7:
            name = f"{g} {self.initial()}. {f}"
        elif kind < 0.79:
            name = f"{g[0]}.{self.r.choice([' ', ' ', ''])}{self.initial()}. {f}"
        elif kind < 0.91:
            name = f"{f}, {g}"
        elif kind < 0.93:
            name = f"{f}, {g[0]}."
        elif kind < 0.96:
            name = f"{g} {self.given()} {f}"
        else:
            name = f"{g}-{self.given()} {f}"
        return name.upper() if self.r.random() < 0.1 else name

    def host(self) -> str:
        parts = [self.r.choice(_ONSETS + _TOWNS + ["Mail", "Uni", "Labs", "Post", "Bio", "Net", "Home", "Chem", "Sub", "Work", "Web", "Open-lab", "Inst", "Cloud"]).lower().replace("ü", "u").replace("ø", "o").replace("é", "e") for _ in range(self.r.choice([1, 1, 1, 2, 3]))]
        return ".".join([*parts, self.r.choice(_TLD)])

    def email(self) -> str:
        plain = str.maketrans("üøöéúëíáñçóèêäßāőõ", "uooeueiancoeeasaoo")
        g, f = (re.sub(r"[ ’']", "", x.lower()).translate(plain) for x in (self.given(), self.family()))
        user = self.r.choice([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{f}{self.r.randrange(10, 99)}", f"{g[0]}{f}", f"{f}.{g[0]}", f"{g}.{f}+{self.r.choice(['md', 'lists', 'x'])}", g, f, f"{g[0]}.{f}", self.r.choice(["info", "support", "help-desk", "office", "no.reply", "admin", "team", "contact"])])
        host, kind = self.host(), self.r.random()
        dotted = lambda dot: host.replace(".", dot)
        out = (
            f"{user}@{host}" if kind < 0.66 else f"{user} [at] {dotted(' [dot] ')}" if kind < 0.74 else f"{user} at {dotted(' dot ')}" if kind < 0.84 else f"{user}(at){host}" if kind < 0.91 else f"{user} (at) {dotted(' (dot) ')}"
        )
        return out.upper() if self.r.random() < 0.08 else out

    def phone(self) -> str:
        pick = self.r.random()
        if pick < 0.25:  # a code, area, exchange and line, however they are set apart
            sep = self.r.choice(["-", ".", " ", "", ""])
            head = self.r.choice(["", "", "", "1", "+1", "+1 "])
            parts = ["899", self.r.choice(["555", "999"]), self.r.choice(["0999", "9999"])]
            base = (head + (sep if head in ("1", "+1") and self.r.random() < 0.7 else "")) + sep.join(parts)
        elif pick < 0.32:  # one blank anywhere
            code, n = self.r.choice(["+44", "+49", "+33", "+34", "+39", "+1"]), self.r.choice([9, 10])
            cut = self.r.randrange(2, n - 2)
            base = f"{code}8{'9' * (cut - 1)} {'9' * (n - cut)}"
        elif pick < 0.6:  # any country: a code, then groups
            r, sep = self.r, self.r.choice([" ", " ", "-", ".", " ", ""])
            code = r.choice(["+1", "+7", "+44", "+49", "+33", "+34", "+91", "+81", "+86", "+61", "+47", "+353", "+41", "+43", "+351", "+972", "00 49", "0044", "+55", "+27", "+82", "+90"])
            left, groups = r.choice([8, 9, 9, 10, 10, 11]), []
            while left > 0:
                n = left if left <= 4 and r.random() < 0.7 else min(left, r.choice([2, 2, 3, 3, 4, 5]))
                groups.append("8" + "9" * (n - 1) if not groups else "9" * n)
                left -= n
            first = r.choice([groups[0], groups[0], groups[0], f"({groups[0]})", f"(0){groups[0]}", f"(0) {groups[0]}"])
            base = f"{code}{r.choice([' ', ' ', sep])}{sep.join([first, *groups[1:]])}"
        else:
            base = self.r.choice(
                "+1-899-555-0999|+1 899 555 0999|+1 (899) 555-0999|(899) 555-0999|(899) 555 0999|899.555.0999|899-555-0999|899 555 0999|1-800-999-9999|1-899-555-0999|0800-999-9999|0800 999 9999|0800 9999999|020 7946 0999|0899 999 9999|08999 999999|"
                "+44 20 7946 0999|+49 30 23125 999|(030) 23125999|(089) 999999|030 / 23125-999|030/23125-999|0899 9999999|0899/99999999|0899-9999999|089 999999-99|+4930 23125999|+493023125999|+43 1 99999-9|01 99 00 99 99|01.99.00.99.99|06 99 99 99 99|"
                "01-99-99-99-99|0699999999|+33 1 99 00 99 99|+33 (0)1 99 99 99 99|+33199009999|+34 555 000 999|699 999 999|699-999-999|91 999 99 99|899 99 99 99|900 999 999|555 000 999|+34555000999|0999 999999|+41 44 999 99 99|+44 (0)20 7946 0999|8999550999".split("|")
            )
        tail = self.r.choice(["", "", "", "", "", "", "", " x999", " ext. 99", " ext 999", ", ext. 9", " extension 9999", " Durchwahl 99", " poste 99"])
        return self.digits(base + tail)

    def town(self) -> str:
        pick = self.r.random()
        made = self.r.choice(_ONSETS) + self.r.choice(["field", "ton", "bury", "burg", "heim", "dorf", "ville", "mont", "stadt", "hausen", "ford", "stead", "illa", "uelo", "ona"])
        return self.r.choice(_TOWNS if pick < 0.25 else _TOWNS2 if pick < 0.45 else CITIES if pick < 0.65 else _CITIES2) if pick < 0.78 else made

    def postcode(self) -> str:
        return self.digits(self.r.choice([" 89999", " 89999", " XX 89999", ", XX 89999", ", XX 89999", " XX9 9XX", " X9 9XX", " XX99 9XX", " X9X 9X9", " 8999", ", 89999", " 89999-9999"]))

    def address(self) -> str:
        r, n = self.r, self.r.choice([self.r.randrange(1, 260), self.r.randrange(1, 60), self.r.randrange(100, 5000)])
        sep = "\n" if r.random() < 0.25 else ", "
        kind = r.random()
        if kind < 0.36:
            name = r.choice(_STREETS) if r.random() < 0.7 else r.choice(_ONSETS) + r.choice(["wood", "field", "well", "ton", "brook", "green", ""])
            street = f"{n}{r.choice(['', '', '', 'A', 'B'])} {r.choice(['', '', '', 'North ', 'West ', 'Upper ', 'Old ', 'Saint ', 'E. '])}{name} {r.choice([t for t in STREET_AFTER if t not in ('ct', 'rd')] + ['St.', 'Ave.', 'Rd', 'Dr.']).title()}{r.choice(['', '', '', '', ' West', ' North', ' SE'])}"
            apt = r.choice(["", "", "", self.digits(", Apt. 9X"), self.digits(", Apt. 99X"), self.digits(", Suite 999"), self.digits(", Unit 9"), self.digits(" #99")])
            return f"{street}{apt}{sep}{self.town()}{r.choice(['', self.postcode(), self.postcode(), self.postcode()])}"
        if kind < 0.42:
            return f"{r.choice(['Flat', 'Unit', 'Apartment'])} {r.randrange(1, 12)}, {n} {r.choice(_STREETS)} {r.choice(STREET_AFTER).title()}{sep}{self.town()}{self.postcode()}"
        if kind < 0.52:
            return f"{r.choice(['P.O. Box', 'PO Box', 'P.O. Box', 'Box'])} {r.randrange(10, 9999)}{sep}{self.town()}{r.choice(['', self.postcode(), self.postcode()])}"
        if kind < 0.7:
            street = r.choice(_DE_STREETS) if r.random() < 0.6 else r.choice(_ONSETS) + r.choice(STREET_ENDINGS[:12]) + ""
            street = street + "." if street.endswith("str") else street
            return f"{r.choice(['', '', '', '', 'Obere ', 'Alte ', 'Am ', 'An der ', 'Zur '])}{street} {n}{r.choice(['', 'a', 'b', '', '-' + str(n + 2)])}{sep}{self.digits(r.choice(['89999', '89999', '09999', '8999', 'D-89999', 'A-8999', 'CH-8999']))} {self.town()}"
        if kind < 0.84:
            return f"{n}{r.choice(['', '', ' bis', ' ter', ',', ' bis,', ' ter,', ' B,'])} {r.choice(_FR_STREETS)}{sep}{self.digits('89999')} {self.town()}"
        if kind < 0.88:
            return f"{r.choice(['Postfach', 'BP', 'Apartado', 'Apartado de correos'])} {self.digits(r.choice(['89', '899', '8999', '89 99 99', '89 99']))}{sep}{self.digits('89999')} {self.town()}"
        return f"{r.choice(_ES_STREETS)}{r.choice([' ', ' ', ', ', ' n.º '])}{n}{r.choice(['', '', ', bajo', ', 2.º B', ', 3.º A', ', 4.º izq.'])}{sep}{self.digits('89999')} {self.town()}"

    def number(self) -> str:
        """A number as state offices of several countries issue them."""
        known = (
            "899-99-9999|999-99-9999|899 99 9999|899999999|XX999999X|XX 99 99 99 X|899999-9999|8999999999|X09999999|899999999|X99999999|XX9999999|XXX999999|99XX99999|89 999 999 999|89999999999|L99X99X99|X9X9X99X9|X99X9999X|89/999/99999|8 99 99 99 999 999 99|8 99 99 99 99 999 999 99|"
            "899999999999|89999999X|89999999-X|89.999.999-X|X-8999999-X|X8999999X|89-9999999|89 99999999 99|89/99999999/99|89 999999 X 999|X999-9999-9999|X9999999|XXXXX999999X99|X99X99X9X|899999999X|899.999.999-99|X 9999 9999"
        ).split("|")
        return self.digits(self.r.choice(known))

    def compound(self) -> str:
        """A German noun."""
        return self.r.choice(_W1) + self.r.choice(_W2) if self.r.random() < 0.7 else self.r.choice(_W2).title()

    def mix(self) -> str:
        return self.digits("".join(self.r.choice("99X") for _ in range(self.r.randrange(7, 11)))) + self.digits("999")


# Alternatives of the grammar, by name. Each is drawn where <NAME> stands.
CHOICES = {
    "IDCUE": "SSN|SSN|social security number|Social Security No.|social security|passport|passport number|passport no.|US passport|tax ID|tax id|tax number|tax no.|taxpayer number|TIN|national insurance number|NI number|NINO|national ID|national ID number|identity number|identity card|identity card no.|ID card|ID card number|ID number|ID no.|driver's license|driving license|driving licence number|driver licence|residence permit|ID on file|Steuer-ID|Steuernummer|Steueridentifikationsnummer|Personalausweis|Personalausweis Nr.|Ausweisnummer|Ausweis-Nr.|Ausweisnr.|Reisepass|Reisepass Nr.|Passnummer|Führerschein|Sozialversicherungsnummer|n° de sécurité sociale|numéro de sécurité sociale|sécurité sociale|passeport|passeport n°|numéro de passeport|carte d'identité|carte d’identité n°|pièce d'identité n°|numéro fiscal|permis de conduire|DNI|DNI|NIE|NIF|pasaporte|pasaporte n.º|número de pasaporte|número de la seguridad social|carné de conducir|cédula",
    "LINK": "|||: |: |: | | | | is | was | number | number is | no. | reads | = |=| # | #| (no.) | - | ends up as | would be | should be | stays at | lautet | ist | Nummer | hat die Nummer | est | est le | porte le numéro | numéro | es | es el | número | con número ",
    "ADV": "Yesterday|Today|Last week|This morning|Apparently|Meanwhile|Afterwards|Then|Still|Sadly|Luckily|In May|On Monday|Later|Once|Since Friday|Finally|However|Perhaps|Even|Also|Only|Recently|Back then|Before lunch|Nobody but|Maybe|Again|Both|When|While|Because|If|After|Although|Whether|Without|With|Like|Unlike|For|From|By|Between",
    "VERB": "called|wrote|agreed|left early|asked for a copy|signed the form|paid the bill|lost the key|found the mistake|is on leave|has resigned|will be back|took notes|prepared the talk|moved the boxes|sent a card|broke the lamp|knows the answer|does not reply|was elected|chaired the panel|cannot come|keeps the list|retired|gave a lecture|bought the tickets|fixed the printer|rents a room|refused|reported it first|stayed home|owns the shop|arrived late|never got the letter|won the race|wants a refund|reviewed the draft|is our dentist|runs the bakery|drives the van|noticed it|joined in June|reran the job|checked the plot|cleaned the table|deleted the folder",
    "ROLE": "lawyer|landlord|neighbour|supervisor|doctor|contact|plumber|mentor|teacher|manager|driver|author|editor|reviewer|secretary|successor|client|tenant|owner|speaker|visitor|patient|witness|colleague|assistant|nurse|guest|candidate|student|chair|technician|friend|boss",
    "LABEL": "Name|Contact|Author|Speaker|Owner|Attn|Patient|Tenant|Applicant|Driver|Holder|Client|Guest|Witness|Host|Signed|Reviewer|Emergency contact|Next of kin|Present|Recipient|Prepared by|Approved by|Edited by|c/o|Kontakt|Ansprechpartner|Verfasser|Mieter|Bearbeiter|Responsable|Auteur|Titulaire|Destinataire|Rédigé par|Autor|Titular|Cliente|Firmado por",
    "THING": "the lamp|the red car|the invoice|a printer|the garden|the second file|an old laptop|the spare key|the contract|the report|the meeting|the ticket|the sample|the parcel|the licence|the pump|the archive|the badge|the draft|the lease|the menu|the boxes|the schedule|the figures|a cup of tea|the reservation",
    "NOUN": "method|theorem|distribution|thermostat|barostat|integrator|equation|algorithm|potential|test|transform|coupling|scheme|ensemble|constant|matrix|index|coefficient|procedure|model|correction|constraint|plot|radius|limit|rule|filter|sum|effect|criterion|approximation|kernel|network|chain|force field|statistic|expansion|series|function|window|sampler|bound|bridge|number|scattering|parameters",
    "ORG": "University|Institute|College|Hospital|Museum|Library|Bank|Airport|Foundation|Society|Press|Group|Company|Agency|Committee|Laboratory|School|Ministry|Station|Stadium|Theatre|Council|Church|Hotel|Academy|Centre",
    "ADJ": "National|International|Royal|Central|General|Medical|Technical|European|American|Northern|Public|Federal|Grand|Modern|Advanced|Digital|Global|Applied|Deep|Hidden|Random|Annual|Open|Golden|Black|Red|Blue|Green|Great|United|Free|Fast|Smart|Big|Little|Upper|First",
    "CAPN": "Review|Letters|Journal|Guide|Network|System|Server|Process|Service|Project|Model|Learning|Computing|Report|Gate|Forest|Hat|Bridge|Sea|Street|Party|Office|Table|Day|Award|Prize|Conference|Workshop|Summit|Union|Nations|States|Park|River|Lake|Valley|Mountain|Coast|Island|Palace|Square|Tower|Hill|Dynamics|Physics|Chemistry|Biology|Science|Engine|Studio|Cloud|Linux|Toolbox|Design|Search|Field|Tree|Code|Analysis|Energy|Control|Structure",
    "UNIT": "ns|ms|s|min|hours|days|weeks|years|GB|MB|TB|km|m|cm|nm|kg|g|K|C|percent|steps|copies|people|pages|frames|files|boxes|points|lines|nodes|cores|members|cells|atoms|states|euros|dollars|miles|units|percent of the cases|kcal/mol|bar|V|Hz|amu|degrees|rounds|items|words|votes",
    "DUNIT": "ns|Stunden|Tage|Wochen|Jahre|GB|km|Meter|kg|Prozent|Schritte|Seiten|Bilder|Leute|Punkte|Zeilen|Euro|Grad|K|Stück|Kisten|Minuten|Sekunden|Prozent der Fälle",
    "FUNIT": "ns|heures|jours|semaines|ans|Go|km|mètres|kg|pour cent|pas|pages|images|personnes|points|lignes|euros|degrés|K|caisses|minutes|secondes",
    "SUNIT": "ns|horas|días|semanas|años|GB|km|metros|kg|por ciento|pasos|páginas|imágenes|personas|puntos|líneas|euros|grados|K|cajas|minutos|segundos",
    "IT": "The pump|The curve|The box|The second loop|A lamp|The upper floor|This page|The water|The line|Each copy|Half of them|The lower part|The total|The queue|The error|The load|One sample|The wall|Nothing|Everything|The river|The rate|The gap",
    "STATE": "stopped|rose|fell|stays put|drifts|was cut|was lost|is flat|opened|closed|looks fine|grew|failed|shrank|came back|was rebuilt|is late|was copied|is wrong|moved|jumps|broke",
    "DIR": "North|South|East|West|A|B|One|Two|Left|Right|Main|Alpha|Beta",
    "YEAR": "2018|2020|1999|2007|2021|next year|now",
    "DAY": "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December",
    "HEY": "Hi|Hello|Dear|Hey|Thanks|Thank you|Hallo|Liebe|Lieber|Bonjour|Cher|Chère|Hola|Querida|Estimado",
    "BYE": "Best|Best regards|Kind regards|Regards|Sincerely|Yours|Cheers|Thanks|Many thanks|Mit freundlichen Grüßen|Viele Grüße|Gruß|Cordialement|Bien à vous|Amicalement|Saludos|Atentamente|Un saludo",
    "TITLE": "Mr.|Mr|Mrs.|Mrs|Ms|Ms.|Miss|Dr.|Dr|Prof.|Professor|Sir|Doctor",
    "DTITLE": "Herr|Frau|Herrn|Dr.|Prof.|Frau Dr.|Herr Prof.",
    "FTITLE": "M.|Mme|Mlle|Monsieur|Madame|Dr|Professeur|Pr.",
    "STITLE": "Sr.|Sra.|Señor|Señora|El señor|La señora|La Dra.|El Dr.|Don|Doña",
    "TEL": "Tel.|Tel|tel:|Phone|phone:|Phone number|Mobile|Cell|mobile:|Fax|Fax:|call|Call|ring|Dial|text|Text|WhatsApp|Telefon|Handy|Mobil|Tél.|Tél :|tél.|Portable|Téléphone|Teléfono|Tfno.|Móvil|tel.|Ph:|Office phone|Pager|Hotline",
    "DADV": "Gestern|Heute|Leider|Danach|Zum Glück|Seit Montag|Vielleicht|Laut|Dann|Inzwischen|Am Freitag|Wahrscheinlich|Auch|Nur|Nach Ostern|Für|Mit|Von|Ohne",
    "DVERB": "hat angerufen|ist krank|kommt später|hat unterschrieben|zieht um|braucht Hilfe|liest die Probe aus|hat gekündigt|fährt nach Hause|war dabei|hat das Auto verkauft|leitet die Gruppe|antwortet nicht|hat den Vortrag gehalten|sucht den Schlüssel",
    "FADV": "Hier|Demain|Ensuite|Selon|Heureusement|Depuis lundi|Pour|Avec|Sans|Peut-être que|Malheureusement|Chez|Puis|Enfin|Aussi",
    "FVERB": "a appelé|est absent|viendra plus tard|a signé|a déménagé|a perdu la clé|a préparé le dossier|ne répond pas|dirige le groupe|a vendu la voiture|a éteint la lumière|part en vacances|a corrigé le texte",
    "SADV": "Ayer|Hoy|Luego|Según|Por suerte|Desde el lunes|Para|Con|Sin|Quizás|También|Mañana|Después",
    "SVERB": "llamó|no vino|firmó el papel|se mudó|perdió la llave|preparó el informe|no contesta|dirige el grupo|vendió el coche|apagó la luz|está de viaje|corrigió el texto|cambió la fecha",
    "KEYWORD": "run|job|range|interval|section|window|part|key|span|block|point|Bereich|intervalo|plage|order|ticket|invoice|batch|seed|series|case|serial|log|sample|trajectory|version|build|record|reference|entry|Lauf|Auftrag|Rechnung|Startwert|série|commande|pedido|serie|lote",
}

TEMPLATES = r"""
<ADV> {P} <VERB>.
<ADV> {P} and {P} <VERB>.
{P} <VERB>.
{P} <VERB> and <VERB>, <ADV> {P} did too.
<ADV>, {P} <VERB>.
I met {P}, who <VERB>.
I asked {P} about <THING>.
Could someone ask {P} about <THING>?
Please talk to {P} before you touch <THING>.
My <ROLE> is {P}, and the other one is {P}.
Our <ROLE> {P} <VERB>.
our <ROLE> {P} <VERB>
The <ROLE> is {P}.
The <ROLE>, {P}, <VERB>.
<THING> belongs to {P}.
<THING> was left by {P} on <DAY>.
Bring <THING> to {P}, please.
We thank {P} for <THING>.
We are grateful to {P}, {P} and {P} for help with <THING>.
Thanks to {P}!
Thanks go to {P}.
Congratulations to {P}!
<LABEL>: {P}
<LABEL>: {P}, {P}, {P}
<LABEL> {P}
<LABEL>: {P}; {P}
<LABEL>={P}; <THING>
According to {P}, <THING> is gone.
As {P} said, <THING> is late.
said {P}.
written by {P}.
Taken by {P}.
Photo: {P}
Talk by {P} on <DAY>, room 4.
Meeting with {P} at noon.
Lunch with {P} on <DAY>.
- {P}
1. {P}
* {P} (<ROLE>)
{P}, <ROLE>
{P} ({E})
{P} <{E}>
{P}; {P}; {P}
<HEY> {P},
<HEY> {P}, <THING> is ready.
<HEY> {P}!
<BYE>,\n{P}
<BYE>\n{P}\n{E}
<BYE>,\n{P}\n{T}
<BYE>,\n{P}\n{A}
<BYE>, {P}
--\n{P}\n<TEL> {T}
--\n{P}\n{E}
@{P}: can you bring <THING>?
From: {P} <{E}>\nTo: {P} <{E}>\nSubject: <THING>
"owner": "{P}", "mail": "{E}", "tel": "{T}"
name;phone;mail\n{P};{T};{E}
{P};{T};{E}
{P}\t{E}\t{T}
author = "{P}"
Nobody told {P} or {P}.
This one is for {P}.
See what {P} did with <THING>?
The account of {P} was closed.
The car of {P} is blue.
{P}'s desk is empty.
It was {P} who <VERB>.
Neither {P} nor {P} <VERB>.
Ask {P}; {P} knows.
Between {P} and {P} there was no doubt.
Supervised by {P} until <DAY>.
Interview: {P}, {P}.
a letter from {P} to {P}
<TITLE> {S} <VERB>.
<ADV> <TITLE> {S} <VERB>.
<TITLE> {P} <VERB>.
I told <TITLE> {S} and <TITLE> {S}.
Please remind <TITLE> {S} of <THING>.
<THING> of <TITLE> {S} <STATE>.
The letter of <TITLE> {S} went out.
with <TITLE> {S} and without
Dear <TITLE> {S},
the office of <TITLE> {S}
<TITLE> {S} (<TEL> {T})
<TITLE> {S} lives at {A}.
<DADV> {P} <DVERB>.
{P} <DVERB>.
<DADV> <DVERB> {P}.
Ich habe mit {P} gesprochen.
Bitte fragen Sie {P}.
Das Buch gehört {P}.
Unser Nachbar {P} <DVERB>.
Vielen Dank an {P} für die Hilfe.
<DTITLE> {S} <DVERB>.
Sehr geehrte Frau {S}, sehr geehrter Herr {S},
Das sagte <DTITLE> {S} am Telefon.
Zuständig ist {P}, Zimmer 12.
Für {P} liegt ein Paket bereit.
<DTITLE> {S} wohnt in der {A}.
Wohnhaft: {A}
Ich wohne {A}.
Bitte an {A} schicken.
Die Rechnung geht an {P}, {A}.
Lieferung nach {A} am <DAY>.
Die Werkstatt ist jetzt {A}.
Ruf mich unter {T} an.
Seine Nummer ist {T}.
Erreichbar unter {T} oder {E}.
Schreib an {E}, bitte.
Meine Adresse: {E}
<FADV> {P} <FVERB>.
{P} <FVERB>.
Je remercie {P} pour le gâteau.
J'ai parlé avec {P}.
Merci de prévenir {P}.
Le livre est à {P}.
Notre voisin {P} <FVERB>.
<FTITLE> {S} <FVERB>.
Demandez à <FTITLE> {S}.
M. {S} <FVERB>.
M. {S} habite {A}.
<FADV> M. {S} et Mme {S} <FVERB>.
<FTITLE> {S} habite {A}.
J'habite au {A}.
Elle vit {A}, je crois.
Le colis part pour {A}.
Facture pour {P}, {A}
Appelez-moi au {T}.
Mon numéro est le {T}.
Joignable au {T} ou par {E}.
Écrire à {E}, merci.
<SADV> {P} <SVERB>.
{P} <SVERB>.
Hablé con {P}.
Gracias a {P} por el libro.
Pregunte a {P}.
El libro es de {P}.
Nuestro vecino {P} <SVERB>.
<STITLE> {S} <SVERB>.
Dígaselo a <STITLE> {S}.
<STITLE> {S} vive en {A}.
Vivo en {A}.
El paquete va a {A}.
Factura para {P}, {A}
Llámame al {T}.
Mi número es el {T}.
Escriba a {E}, por favor.
Contacto: {E} o {T}
<TEL> {T}
<TEL>: {T}
<TEL> {T}, thanks
<TEL> is {T}
<TEL> {T} or {T}
My number is {T}.
Her new number: {T}
Her <TEL> number is {T}.
My other number is {T}.
If nobody opens, try {T}.
If it rains, <TEL> {T}.
You can reach us at {T}.
Reach {P} at {T} or {E}.
The desk answers on {T}.
Drop a line at {T}, please.
bring <THING>; {T} if it rains
<THING> is with {P} ({T})
<TEL> {T} and say the word.
If it stops, <TEL> {T} and wait.
"phone": "{T}", "mail": "{E}"
{E}\n{T}
{E}; {T}
{E} {T}
{T}; {E}
<TEL> me on {T} after six.
{P} {T}
{P}, {T}
{P} ({T})
{T} ({P})
{T}
For <THING>, <TEL> {T}.
Leave a message at {T}, line is open until ten.
Emergency: {T}
contact <ROLE> at {T}
the line {T} is dead
{E}
Mail {E}
mail: {E}
e-mail: {E}
E-mail {E} or <TEL> {T}.
Write to {E} about <THING>.
Send <THING> to {E}.
Send it to {E} tonight.
Address questions to {E}.
He answers faster at {E}!
Username is {E}, without spaces.
Bounced: {E}
cc {E}, {E}
mailto:{E}?subject=hello
<{E}>
({E})
Reply-To: <{E}>
contact="{E}"
not {E} any more but {E}
{E} is read on <DAY>.
via {E} or {T}
I moved to {A}.
I moved to {A} last month.
{A}
Address: {A}
Home address: {A}
address {A}
New address\n{A}
Mailing address:\n{A}
Ship to:\n{P}\n{A}
Send <THING> to {A}.
Send <THING> to {A} by <DAY>.
Return <THING> to {P}, {A}.
Her flat is at {A}.
She grew up at {A}, near the river.
We live at {A}; <TEL> {T}.
The shop ({A}) is closed.
The courier left it at {A} with the <ROLE>.
Bills go to {A}.
Post it to {A} please.
Please change my address to {A}.
The party is at {A} on <DAY>.
The machine at {A} still runs.
The house at {A} <STATE>.
New address {A}, tell the <ROLE>.
Spare set at {A}; {T}
Zu Händen {P}, {A}
{A}, zu Händen {P}
registered at {A} until <DAY>
lived at {A} until <YEAR>, then moved
at {A} since <YEAR>
The <ROLE> at {A} <VERB>.
Visit us at {A}.
Adresse : {A}
Anschrift: {A}
Adresse: {A}
Dirección: {A}
Domicilio: {A}
{I}
{I}.
My {I}.
Her {I} was scanned.
His {I} has expired.
the {I} of the <ROLE>
The applicant's {I}.
{P}, {I}
{P} has {I}.
{I} ({P})
{I} on record.
<IDCUE> {N} was shown.
<IDCUE> {N}
<ROLE> {P}, {I}, was let in.
We need the number again; {I}?
The form asks for it, {I}.
Please black out the {I} in <THING>.
Payment to {P}, {I}, on <DAY>.
On the card: {P}, {A}, {T}, {I}.
The <IDCUE> of {P} is {N}.
The <IDCUE> for my <ROLE> is {N}.
<IDCUE> of the <ROLE>: {N}
<IDCUE> ({N}) must not be kept.
<IDCUE> (no. {N}) was copied.
The <ROLE> wrote the <IDCUE> on the wall, {N} I think.
<IDCUE>, as printed: {N}
The <ROLE> showed the <IDCUE> {N} at the gate.
{N} is the <IDCUE> of {P}.
Mein {I}.
Sein {I} ist abgelaufen.
Der <IDCUE> von {P} lautet {N}.
Für {P} liegt {I} vor.
Zum Antrag von {P} gehört {I}.
Der {W} von {P} <DVERB>.
Mon {I}.
Son {I} a été copié.
Le <IDCUE> de {P} est {N}.
Dossier de {P}, {I}.
Mi {I}.
Su {I} ha caducado.
El <IDCUE> de {P} es {N}.
Expediente de {P}, {I}.
""".strip().split("\n")

# Without personal data. {F} a family name, {G} a town, {K} a key of digits or letters, {D} digits.
NEGATIVES = r"""
After {D} <UNIT> <IT> <STATE>.
After {D}.{D} <UNIT>, {D} <UNIT> were left; {D} <UNIT> remain.
<IT> <STATE> at {D} <UNIT>, hence <IT> at {D} <UNIT>.
<IT> took {D} <UNIT> on {D} <UNIT>.
at {D} K. <CAPN> is next. At {D} C. <IT> <STATE>.
<IT> is shut at {D}.{D} K. <ADJ> <CAPN> <STATE>
It lasted {D} <UNIT>. The last one took {D} <UNIT>. Wait {D} <UNIT>.
<IT> <STATE>, {D} of {D} <UNIT> are done.
<IT> of <IT> <STATE> by {D}.{D} <UNIT>.
<IT> <STATE> in {D} percent of the <UNIT>.
{D} <UNIT> and {D} <UNIT> are not the same.
<DAY> {D}, {D} <UNIT>, page {D}
Nach {D} <DUNIT> ist die {W} fertig.
Die {W} hält {D} <DUNIT>, der {W} nur {D} <DUNIT>.
In {D} Prozent der {W} fehlt der {W}.
Die {W} für {D} <DUNIT> brauchte {D} <DUNIT>.
Die {W} ist da. Der {W} fehlt. Das {W} auch.
{W} und {W} wurden geprüft, siehe {W} {D}.
Der {W} wandert um {D}.{D} <DUNIT>.
Hinweis: Die {W} liegt bei {D} <DUNIT>.
Stand {D}: Die {W} wiederholt den {W} von {K}.
Alle {W} kamen in den {W}. Kein {W} ohne {W}.
Eine {W} mit {W} aus {G} kostet {D} Euro.
Sein {W} und ihre {W} sind neu; mein {W} ist alt.
Le {V} tient {D} <FUNIT>, la {V} dure {D} <FUNIT>.
Après {D} <FUNIT>, la {V} de {D} <FUNIT> reste vide.
La {V} occupe {D} <FUNIT> dans {D} pour cent des cas.
Note : À {D} <FUNIT> la {V} devient rare.
Tras {D} <SUNIT>, la {V} se mueve {D} <SUNIT>.
El {V} dura {D} <SUNIT> en el {D} por ciento de los casos.
La {V} de {D} <SUNIT> ocupa {D} <SUNIT>.
Nota: A {D} <SUNIT> casi no hay {V}.
<CAPN> <DIR> is open, <CAPN> <DIR> is closed.
see sheet <CAPN> <DIR>
Wing <DIR>, Gate <DIR>, <ADJ> <DIR>
The {F} <NOUN> was used.
The {F} <NOUN> with a factor of {D} works best.
the {F} and {F} <NOUN>s
{F} <NOUN>s are slow.
We tried the {F}-{F} <NOUN> next.
{F} {F} <NOUN>s were taken from a book.
A {F} <NOUN> and the {F} <NOUN> agree, the {F} <NOUN> does not.
in the {F} <NOUN>, as shown by {F} et al.
Das {F}-Verfahren und der {F}-Test sind bekannt.
Der Thermostat nach {F} hält die Temperatur.
La méthode de {F} et le test de {F} sont connus.
El método de {F} y la prueba de {F} son lentos.
She studied at <ADJ> <ORG> in {G}.
{G} <ORG> and <ADJ> <ORG> agreed.
The <ORG> of {G} opened on <DAY>.
{F} <ORG> of <CAPN>
the {F} <ORG> in {G}
{F} <ADJ> <ORG> and {F} <ORG>
the {M} {F} <ORG> is a partner
{M} {F} <ORG>
San {F} and Santa {F} are towns; San {F} is larger.
A {F} <NOUN> was fitted. A {F} and a {F}.
{F} GmbH, {F} & Sons and {F} Ltd. are suppliers.
<ADJ> <CAPN> and <ADJ> <CAPN> are projects.
The <ADJ> <CAPN> is near {G}.
<ADJ> <CAPN> <CAPN> {D}
A <ADJ> <CAPN> was built with <CAPN> <CAPN>.
The paper appeared in <CAPN> <CAPN> in <DAY>.
<CAPN> <CAPN>
<ADJ> <CAPN>
# <ADJ> <CAPN>
Chapter {D}: <ADJ> <CAPN> and <CAPN>
{G} and {G} are both on the list.
We flew from {G} to {G} on <DAY>.
The train to {G} leaves at {D}:30.
<DAY> in {G} was cold.
In {G}, <DAY> was a holiday.
Das Treffen findet am <DAY> in {G} statt.
Die Universität {G} hat zugesagt.
Die Technische Hochschule {G} und das Rathaus sind zu.
Der Zug nach {G} hat Verspätung.
L'université de {G} a répondu.
Le train pour {G} part lundi.
La Universidad de {G} envió los datos.
El tren a {G} sale el lunes.
Das Auto steht vor dem Haus, die Tasche liegt im Keller.
Die Rechnung wurde bezahlt, der Vertrag liegt bei.
Der Server ist neu gestartet worden, die Daten sind da.
Bitte die Tür schließen und das Licht ausschalten.
Die Sitzung beginnt um neun Uhr im großen Saal.
Mein Hund mag den Garten, meine Katze nicht.
Der Drucker im Flur ist kaputt; Ersatz kommt Freitag.
Heute Abend gibt es Suppe, danach Kuchen.
Die Energie des Systems sinkt nach dem Neustart.
Am Ende der Woche wird der Speicher geleert.
Herr der Ringe ist ein Buch.
Frau und Mann kamen zu spät.
Neue Version: Fehler behoben, Menü erweitert.
Die Messung wurde in der Nacht wiederholt.
Im Sommer fährt der Bus seltener.
Das Institut bleibt über Weihnachten geschlossen.
Fragen zum Ablauf beantwortet das Sekretariat.
Das Ergebnis der Prüfung steht noch aus.
Le serveur a redémarré, les données sont là.
Merci de fermer la porte et d'éteindre la lumière.
La réunion commence à neuf heures dans la grande salle.
L'imprimante du couloir est en panne.
Ce soir il y a de la soupe, puis du gâteau.
L'énergie du système baisse après le redémarrage.
Monsieur et madame sont sortis.
Nouvelle version : erreurs corrigées, menu élargi.
En été le bus passe moins souvent.
Le rapport sera prêt vendredi prochain.
El servidor se reinició, los datos están ahí.
Por favor cierre la puerta y apague la luz.
La reunión empieza a las nueve en la sala grande.
La impresora del pasillo está rota.
Esta noche hay sopa y luego pastel.
La energía del sistema baja tras el reinicio.
Nueva versión: errores corregidos, menú ampliado.
En verano el autobús pasa menos.
El informe estará listo el viernes.
Señor y señora salieron.
The server was restarted and the data are there.
Please close the door and turn off the light.
The printer in the hall is broken; a new one comes on <DAY>.
Tonight there is soup, then cake.
Energy drops after the restart.
Memory use peaked at {D} GB in step {D}.
Nothing was lost, but <THING> has to be copied again.
How long does it take? Nobody knows.
Some say that one half sinks while the others rise.
What happens if the rate is doubled? (A) it rises (B) it falls (C) nothing (D) all of them
Help, there is smoke in the kitchen!
New version: bugs fixed, menu extended. Read the notes.
FYI <CAPN> <STATE>. NB <IT> <STATE>. PS <CAPN> and <CAPN> differ.
FYI {W} <STATE>. ETA <DAY>. TBD <CAPN>. FAQ <CAPN>.
Note: <THING> is gone. Summary: no change. FYI second look. TODO check it.
[13:{D}] Warning: disk almost full.
Day {D}: rain. Day {D}: sun.
Update {D}: done. Observation {D}: none.
READ THE WHOLE TEXT BEFORE YOU ANSWER ANY OF THE QUESTIONS.
MOST OF THE BOXES WERE MOVED EVEN THOUGH THE ROOM WAS SMALL.
TODO FIXME WARNING ERROR
Best of three. Regards aside, it holds. Thanks for nothing!
Best fit of {D} points, see Table {D} and Figure {D}.
Contact map and contact list were merged. Name of the file: out_{D}.txt
Author list is open. From: the queue. Owner: nobody.
Mr and Mrs are titles. Dr means doctor, Prof. is short.
Call it a day. Phone it in. Fax machines are old. Text is plain.
The number {D} is prime; number {D} is not.
The phone is broken since <DAY> {D}.
Passport control opens at {D}. The ID field is empty. Tax rises by {D} percent.
The <IDCUE> was not checked. No <IDCUE> is stored here.
Address the issue in chapter {D}, street by street.
The street is wet. The box is full. Rue the day.
<KEYWORD> {K} failed.
<KEYWORD> {K} and <KEYWORD> {K} were merged.
The <KEYWORD> {K} belongs to <KEYWORD> {K}; do not mix it with {K}.
see <KEYWORD> {K}
about {K}, near {K} in all
values {K}, {K} and {K}
between {K} and {K} for <THING>
<IT> <STATE> at {K}.
(<KEYWORD> {K})
<KEYWORD> number {K}
<KEYWORD> no. {K} was shipped on <DAY>.
index {D} of the <KEYWORD> {K}
Total: {D},{D},{D}.{D} EUR, <KEYWORD> {K}
{D} EUR, {D} USD and {D} kg
Frames {D} to {D} were dropped.
Frames {D}-{D} and {D}+{D} were dropped.
frames {D}:{D}, window [{D}, {D}], range {D}/{D}
window {D}-{D}-{D}, part {D} to {D}
window {D} {D}, {D}.{D}
from step {D} to step {D} in {D} rounds
rsync u{D}@node{D}:/srv/out/{D} stopped.
scp root@gpu{D}:/home/data done, see admin@login{D} for logs
copy md{D}@host{D}:/work/run_{D}/x.tsv here
logged in as user{D} on node{D}
git@server:team/repo was cloned into /opt/{D}
Opening /srv/abc/run{D}/file{D} takes long.
Set `n={D}` and rerun; def f(x): return x + {D}
import os; path = "/data/{D}/out.txt"
At {D}.{D} K, {D} percent of {D} copies agree, n = {D}.
It costs {D},{D}.{D} EUR, {D} % off.
On 2021-0{D}-1{D} at 12:{D}:{D} the IP 10.{D}.{D}.{D} was blocked.
Version {D}.{D}.{D} of 3.{D}.2022 is out.
Published in <DAY> {D}, pages {D}-{D}.
doi 10.{D}/abc.{D}.{D} and arXiv 20{D}.{D}
Details in 10.{D}/abc.{D} (<KEYWORD> {K}).
ISBN 978-{D}-{D}-{D}-0
energy near -{D}.{D} kcal/mol, {D}.{D} angstrom
A:ALA:{D} touches B:TRP:{D} but not R:VAL:{D}.
Residue ASP {D}, position {D}.{D}, chain A.
<CAPN> {D}, <CAPN> {D} and <CAPN> {D}
Random <CAPN> and Markov chain runs were merged.
Van der Waals terms, Nosé Hoover chains, Markov chains.
Linux, Python, Fortran and Excel are installed; Windows is not.
English, French, German and Spanish are spoken.
""".strip().split("\n")

KINDS = {"P": "person", "S": "person", "E": "email", "T": "phone", "A": "address", "N": "id_number"}


_W1 = "Abstand Wasser Haus Garten Daten Speicher Zeit Strom Druck Licht Stadt Werk Schul Papier Kraft Flug Wetter Buch Fenster Salz Doppel Kern Rand Netz Start Grund Feld Rechen Mess Fehler Laufzeit Haupt Spiel Wand Tür Dach Berg Tal See Wald".split()
_W2 = "brücke matrix plan raum karte liste zeit wert kette schicht stelle tasche kurve reihe tafel platte prüfung anlage leitung feder stunde decke grenze maschine gabe struktur energie gruppe frage antwort ordnung schiene werk buch blatt punkt bild sprung absturz kasten".split()
_V = "maison table voiture nube casa mesa noche lampe porte fenêtre ligne courbe matrice série boîte pompe source route página línea curva matriz caja bomba fuente carta sopa mano piedra puerta ventana énergie énergia tension couche capa puente pont membrane muestra échange espera prueba ligand ligando bicapa".split()


def expanded(template: str, r: random.Random) -> str:
    while "<" in template:
        new = re.sub(r"<([A-Z]+)>", lambda m: r.choice(CHOICES[m[1]].split("|")), template)
        if new == template:
            return new
        template = new
    return template


def _cased(text: str, r: random.Random) -> str:
    return text[:1].upper() + text[1:] if r.random() < 0.8 else text


def filled(template: str, fill: Fill) -> str:
    """The template with marked values: \\x01 kind \\x02 value \\x03."""
    out = _cased(expanded(template, fill.r), fill.r).replace("\\n", "\n").replace("\\t", "\t")
    if "{I}" in out:
        out = out.replace("{I}", expanded("<IDCUE><LINK>", fill.r).rstrip(" ") + " {N}")
        out = out.replace("= {N}", fill.r.choice(["={N}", "= {N}"]))
    make = {"W": fill.compound, "P": fill.person, "S": fill.family, "E": fill.email, "T": fill.phone, "A": fill.address, "N": lambda: fill.mix() if fill.r.random() < 0.08 else fill.number()}
    for slot, f in make.items():
        while f"{{{slot}}}" in out:
            out = out.replace(f"{{{slot}}}", f"\x01{KINDS[slot]}\x02{f()}\x03" if slot in KINDS else f(), 1)
    return out


def key(fill: Fill) -> str:
    """A run's key: groups of digits, or letters and digits."""
    r = fill.r
    if r.random() < 0.08:
        return fill.digits(r.choice(["999-99-9999", "99-9999999", "999999-9999"]))
    if r.random() < 0.7:
        return fill.digits(r.choice("---_/").join("9" * r.randrange(2, 6) for _ in range(r.choice([2, 3, 3, 3, 4]))))
    return r.choice([fill.digits("9" * r.randrange(6, 11)), fill.digits("XX99_R9"), fill.digits("X9_R99"), fill.digits("XXX9_R9"), "%08x" % r.randrange(1 << 32), fill.digits("XX-99999")])


def negative(template: str, fill: Fill) -> str:
    r = fill.r
    out = _cased(expanded(template, r), r).replace("\\n", "\n")
    town = lambda: fill.town() if r.random() < 0.9 else f"{r.choice(['San', 'Santa', 'Saint', 'New', 'Los', 'Port', 'El', 'Bad', 'North'])} {fill.family()}"
    make = {"W": fill.compound, "V": lambda: r.choice(_V), "F": fill.family, "M": fill.given, "G": town, "K": lambda: key(fill), "D": lambda: str(r.choice([r.randrange(10), r.randrange(100), r.randrange(1000), r.randrange(100_000)]))}
    for slot, f in make.items():
        while f"{{{slot}}}" in out:
            out = out.replace(f"{{{slot}}}", f(), 1)
    return out.upper() if r.random() < 0.06 else out


def labelled(copies: int = 22, seed: int = 11, templates: list[str] | None = None, negatives: list[str] | None = None, quiet: int = 16) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): each template ``copies`` times, between sentences without personal data, which also
    stand alone ``quiet`` times each."""
    templates, negatives = templates or TEMPLATES, negatives or NEGATIVES
    fill, rows = Fill(seed), []
    for t in templates * copies:
        before, after = (negative(fill.r.choice(negatives), fill) if fill.r.random() < 0.45 else "" for _ in range(2))
        joint = fill.r.choice([" ", " ", "\n", "\n\n", "\n- "])
        rows.append(filled(t, fill).join([before[-60:] + joint if before else "", (fill.r.choice([" ", "\n", " "]) + after[:60]) if after else ""]))
    rows += [negative(t, fill) for t in negatives * quiet]
    return [unmarked(r) for r in rows]


def table_words() -> set[str]:
    """Every plain word that the grammar itself holds."""
    text = " ".join([*TEMPLATES, *NEGATIVES, *CHOICES.values()])
    return {w for w in re.findall(r"[^\W\d_]+", re.sub(r"\{[A-Z]\}|\\[nt]|<[A-Z]+>", " ", text).lower()) if len(w) > 1}


def unmarked(marked: str) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, i = "", [], 0
    while (a := marked.find("\x01", i)) >= 0:
        b, c = marked.index("\x02", a), marked.index("\x03", a)
        text += marked[i:a]
        spans.append((len(text), len(text) + c - b - 1, marked[a + 1 : b]))
        text += marked[b + 1 : c]
        i = c + 1
    return text + marked[i:], spans
