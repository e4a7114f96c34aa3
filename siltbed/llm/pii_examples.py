"""Labelled texts for the tagger of personal information, drawn from a grammar.

Every example is a short text with spans ``(start, end, type)``. Names, towns, brands and numbers
are made from syllables and parameters, forms follow public conventions, and sentences come from
:mod:`siltbed.llm.seed_texts`; nothing is taken from any table. Numbers are drawn with and without a
right checksum alike: the rules of a kind are checked after decoding.
"""

from __future__ import annotations

import random

from siltbed.llm.seed_texts import DECLARATION, PARTS, sentence

FIRST = """Alice Robert Emily Thomas Sarah Charles Laura George Helen Michael Jennifer William Patricia Richard Barbara Joseph Susan Daniel Karen
Andrew Nancy Kevin Sandra Brian Ashley Edward Kimberly Ronald Donna Anthony Carol Matthias Sabine Wolfgang Heike Dieter Petra Klaus Monika Jochen Birgit
Philippe Nathalie Julien Isabelle Thierry Sylvie Antoine Céline Javier Pilar Alejandro Rocío Miguel Beatriz Antonio Lucía Giuseppe Francesca Alessandro Valentina
Luca Elisa Ricardo Fernanda Rui Inês Gonçalo Beatriz Willem Anneke Joost Marieke Sander Krzysztof Agnieszka Grzegorz Małgorzata Piotr Ewa Sergei Natalia Andrei Tatiana
Hiroshi Yuki Ming Li Wei Raj Anjali Mohammed Aisha Hassan Leila Kofi Amina Søren Ingrid Håkan Maja Eero Aino Zoltán Ágnes Václav Jana Bogdan Ioana Nikos Eleni Deniz Ayşe Ciarán Niamh""".split()
LAST = """Smith Jones Brown Taylor Walker Hughes Edwards Turner Murphy Schneider Fischer Weber Becker Hoffmann Schäfer Krüger Bernard Petit Moreau Lefèvre Girard Fernández Rodríguez López
Martínez Romero Navarro Ferrari Bianchi Romano Ricci Marino Silva Santos Pereira Oliveira Costa Bakker Visser Smit Mulder Nowak Wiśniewski Wójcik Kamiński Petrov Sokolov Morozov Volkov Tanaka Suzuki
Nguyen Patel Singh Khan Chen Wang Okafor Mensah Hansen Johansson Virtanen Nagy Horváth Novák Popescu Papadopoulos Yılmaz O’Connor MacLeod""".split()
ONSET = "b br c ch d dr f fl fr g gl gr h j k kl kr l m n p pl pr qu r s sch sh sk sl st str sw t th tr v w y z".split() + [""]
VOWEL = "a a e e i i o o u u ae ai au ea ee ei ie oo ou y ä ö ü á é".split()
CODA = "n n l l r r m s t k d g nd nt rt rk ck ng lt ld rn sk st x ll ss".split() + [""] * 14
NAME_END = "son sen ov ova ev eva in ina ski ska sky ak ek ik ic ich ez es is mann berg stein feld bach ini ino elli etti escu oglu ley ton ham wick worth field well er ard aux ot ens ström lund quist o a y i".split()
TOWN_END = "ton ham bury ford field wick mouth port dale burg berg heim dorf hausen stadt brück ville court mont val luz mar dam dijk kerk wijk ów ice grad by vik stad sund ano ento ona aro".split()
TOWN_START = ["", "", "", "", "St. ", "Bad ", "Saint-", "San ", "Santa ", "New ", "Upper ", "Nowy ", "Villa "]
NOUN = """Alpha Array Arrow Base Bay Beam Bolt Book Bridge Canyon Card Case Cloud Core Cube Deck Delta Disk Dock Drive Dune Edge Ember Field Flash Flow Forge Frame Gate Glacier Guard Harbor Hub Kit Lake
Link Mesa Micro Mini Mirror Nano Node Nova Orbit Panel Peak Pico Pixel Plus Pod Pulse Rack Reef Ridge Rock Server Shell Shuttle Slate Spark Station Stick Stone Storage Storm Stream Studio Summit Swift Tablet Terra Tide Titan
Tower Track Trail Vault Vector View Wave Wing Works Zone""".split()
NATURE = """Granite Marble Quartz Flint Onyx Opal Jade Amber Coral Pearl Topaz Garnet Shale Chalk Clay Gravel Heron Falcon Eagle Hawk Robin Raven Swan Crane Finch Wren Owl Otter Badger Lynx Bison Moose Salmon Trout Maple Cedar
Birch Willow Aspen Fern Moss Clover Thistle Heather Lotus Cliff Brook Marsh Moor Heath Valley Island Lagoon Meadow Prairie Tundra Desert Oasis Cloud Thunder Breeze Frost Snow Rain Mist Comet Meteor Saturn Mercury Neptune
Copper Silver Iron Cobalt Nickel Carbon Helium Photon Proton Quasar Anchor Compass Lantern Candle Hammer Anvil Needle Saddle Wagon Barrel Basket Kettle Ladder Mirror Pillar Tunnel Corner Circle Square Spiral""".split()
THINGS = NOUN + NATURE
PLAIN = "old new broken empty small large red blue green first second third last whole quick slow wrong right open closed full missing early late hidden local common known lost bad good wooden heavy light strange simple double single spare recent public damaged deleted important missing previous whole cold warm dry".split()
DOING = "turn walk end start help paint need clean count fill repair open load check clear follow watch move miss add stay visit record restore copy scan delete return show test reach collect deliver answer request report".split()
SMALL = "nothing something anything everything here there now then later soon never always again only just very too also not yes no ok done empty none some any more less well so but and or if when where why how what who all both each".split()
WITH = "with of for near after before without under behind inside from to about during in at on by against between".split()
NUMBERED = "SN S/N serial Serial# LBA sector offset inode block size id uid pid port crc sha1 build rev ticket case order item batch row line page key seq job node".split()
STREET_WORD = {
    "eng": "Main High Church Park Mill Station Victoria London Green King Queen Manor Chestnut Elm Cedar Pine Walnut Washington Lincoln Sunset Lake Hill Bridge School North South Broad Water Spring Meadow Orchard Rose Ivy Harbour Castle Abbey Baker Cooper Fisher Hunter Lark Robin Fox".split(),
    "deu": "Haupt Bahnhof Garten Schul Dorf Berg Linden Goethe Schiller Mozart Kirch Wald Wiesen Mühlen Ring Rosen Feld Brunnen Markt Eichen Buchen Tannen Sonnen Amsel Hafen Burg Kloster".split(),
    "fra": "Paix|Victor Hugo|Lilas|République|Moulin|Gare|Pasteur|Église|Liberté|Jean Jaurès|Écoles|Fontaine|Roses|Gambetta|Voltaire|Pont|Marché|Château|Peupliers".split("|"),
    "spa": "Mayor|Real|Sol|Cervantes|Goya|Colón|Nueva|San José|Alcalá|del Carmen|Constitución|de la Paz|Velázquez|Olmo|del Río|Jardines|Princesa|Toledo".split("|"),
    "ita": "Roma|Garibaldi|Mazzini|Dante|Verdi|Cavour|Marconi|Manzoni|dei Mille|della Libertà|Matteotti|Torino|San Marco|delle Rose|Galilei|Vittoria|Milano".split("|"),
    "por": "Augusta|Flores|da Liberdade|do Comércio|Santo António|Camões|da Praia|Direita|das Oliveiras|Sete de Setembro|do Sol|Nova|da Igreja".split("|"),
    "nld": "Kerk Dorps Molen School Juliana Beatrix Wilhelmina Station Nieuw Prinsen Keizers Haven Linden Eiken Beuken Markt".split(),
    "pol": "Długa|Ogrodowa|Polna|Leśna|Szkolna|Lipowa|Słoneczna|Krótka|Kościelna|Mickiewicza|Sienkiewicza|Kwiatowa|Zielona|Parkowa".split("|"),
    "rus": "Ленина|Мира|Садовая|Лесная|Школьная|Пушкина|Гагарина|Новая|Советская|Центральная|Заречная|Чехова".split("|"),
}
TLD = "com org net info eu de fr es it nl pl ru pt co.uk ac.uk io dev test example invalid local example.com example.org example.net com.br co.jp gov edu biz at ch be se".split()
HOST = "mail post inbox web home office data city shop cloud uni net firm box core north lab print desk studio team school hotel bank clinic museum radio".split()
ROLE = "support office info sales admin help contact service billing noreply no-reply hr team jobs press abuse postmaster webmaster privacy security kundenservice vertrieb accueil facturation ventas soporte ufficio kontakt biuro privacidade reply".split()
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words that stand before numbers, by kind, and calling codes.
PASSPORT = ["passport", "passport no.", "Passport number", "passeport", "passeport n°", "Reisepass", "Pass-Nr.", "pasaporte", "passaporto", "paspoort", "paszport", "паспорт"]
LICENCE = ["driver licence", "driver license", "driving licence", "licence no.", "DL", "Führerschein", "Führerscheinnr.", "permis de conduire", "permis", "carnet de conducir", "patente", "rijbewijs", "prawo jazdy"]
NATIONAL = ["national id", "ID card", "identity card", "ID", "id no.", "Ausweis", "Ausweisnummer", "Personalausweis", "carte d’identité", "CNI", "NIR", "carta d’identità", "codice fiscale", "PESEL", "BSN", "cartão de cidadão", "NIF", "dowód"]
ACCOUNT = ["account", "account no.", "acct", "Konto", "Kontonummer", "compte", "cuenta", "conto", "rekening", "konto"]
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 81 86 90 91 351 352 353 358 370 380 420 421 972".split()
LANGS = sorted(PARTS)


class Examples:
    """A stream of labelled texts for one seed."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def hexa(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice(LETTERS) for _ in range(n))

    def n(self, k: int = 5) -> str:
        return str(self.r.randint(0, 10 ** self.r.randint(1, k)))

    def stem(self, parts: int) -> str:
        r = self.r
        return "".join(r.choice(ONSET) + r.choice(VOWEL) + r.choice(CODA) for _ in range(parts))

    def surname(self) -> str:
        r = self.r
        if r.random() < 0.22:
            return r.choice(LAST)
        s = self.stem(r.choice([1, 1, 1, 2])) + (r.choice(NAME_END) if r.random() < 0.7 else "")
        return (s if len(s) > 2 else s + r.choice(NAME_END) + "s").capitalize()

    def first(self) -> str:
        r = self.r
        if r.random() < 0.5:
            return r.choice(FIRST)
        s = self.stem(1) + r.choice(["a", "o", "ina", "en", "is", "ek", "ia", "us", "e", "y", "in", "an", "ara", "el", "ette", "win"])
        return s.capitalize()

    def name(self) -> str:
        r, f, s = self.r, self.first(), self.surname()
        if r.random() < 0.06:
            s = s + "-" + self.surname()
        elif r.random() < 0.06:
            s = r.choice(["van ", "van der ", "de ", "von ", "di ", "da ", "dos ", "al-", "El "]) + s
        form = r.random()
        if form < 0.5:
            return f"{f} {s}"
        if form < 0.6:
            return f"{f} {r.choice(LETTERS)}. {s}"
        if form < 0.71:
            return f"{f[0]}. {s}" if r.random() < 0.8 else f"{f[0]}. {r.choice(LETTERS)}. {s}"
        if form < 0.79:
            return f"{s.upper()}, {f}" if r.random() < 0.7 else f"{s.upper()} {f}"
        if form < 0.84:
            return f"{s}, {f}" + (f" {r.choice(LETTERS)}." if r.random() < 0.2 else "")
        if form < 0.87:
            return f"{f} {self.first()} {s}"
        if form < 0.94:
            return f"{f} {s}".upper()
        return f"{f} {s}".lower()

    def email(self) -> str:
        r, f, s = self.r, self.first().lower(), self.surname().lower()
        ascii_ = lambda x: "".join(c for c in x if c.isascii() and c.isalpha()) or "kim"
        f, s = ascii_(f), ascii_(s)
        local = r.choice([f"{f}.{s}", f"{f}_{s}", f"{f[0]}{s}", f"{s}{self.digits(2)}", f"{s}.{f[0]}", f"{f}+{r.choice(NOUN).lower()}", f"{f}+{r.choice(ROLE)}", f"{f[0]}.{s}", f"{f}-{s}", f"{f}{s}", r.choice(ROLE), r.choice(ROLE), f"{f}{self.digits(r.randint(1, 4))}", f, s, f"{r.choice(ROLE)}.{r.choice(NOUN).lower()}"])
        host = r.choice([r.choice(HOST), r.choice(HOST), ascii_(self.stem(2)), f"{r.choice(HOST)}-{r.choice(HOST)}", f"{r.choice(HOST)}.{ascii_(self.stem(1))}x"])
        domain = host + "." + r.choice(TLD)
        form = r.random()
        if form < 0.5:
            return f"{local}@{domain}"
        if form < 0.58:
            return f"{local}@{domain}".upper()
        if form < 0.66:
            return f"<{local}@{domain}>"
        if form < 0.74:
            return f"mailto:{local}{r.choice(['@', '%40', '%40'])}{domain}"
        if form < 0.8:
            return f"{local}＠{domain}"
        if form < 0.83:
            return local + r.choice([" @ ", "&#64;", "@ ", " @"]) + domain
        at = r.choice([" at ", " [at] ", " (at) ", "[at]", "(at)", " AT ", " {at} ", "{at}", "_at_", " at "])
        dot = r.choice([" dot ", " (dot) ", " [dot] ", "[dot]", "(dot)", ".", " DOT ", "{dot}"])
        if at.strip() in ("at", "AT") and dot == ".":
            dot = " dot "
        return local + at + domain.replace(".", dot)

    def grouped(self, number: str) -> str:
        """A number in groups of two to four digits under one separator."""
        r, parts = self.r, []
        sep = r.choice(["", " ", " ", "-", ".", "/"])
        while len(number) > 4:
            k = r.choice([2, 3, 3, 4])
            parts.append(number[:k])
            number = number[k:]
        return sep.join([*parts, number])

    def phone(self) -> str:
        r, d = self.r, self.digits
        code = r.choice(CALLING)
        return r.choice([
            lambda: f"+{code} {self.grouped(d(r.choice([8, 9, 9, 10])))}", lambda: f"+{code}{r.choice(['-', '.', ' '])}{self.grouped(d(9))}", lambda: f"+{code}{d(r.choice([8, 9, 10]))}", lambda: f"00{code}{r.choice(['', ' '])}{d(r.choice([8, 9, 10]))}", lambda: f"00{code}{d(10)}", lambda: f"+{code} (0) {d(2)} {d(3)} {d(4)}", lambda: f"+{code} ({d(2)}) {d(4)}-{d(4)}",
            lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) 555-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"555-{d(4)}", lambda: f"{d(3)}-{d(4)}", lambda: f"1-800-{d(3)}-{d(4)}", lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: f"+1-{d(3)}-{d(3)}-{d(4)}",
            lambda: f"0{d(2)}/{d(r.choice([6, 7, 8]))}", lambda: f"0{d(3)}/{d(r.choice([5, 6, 7]))}", lambda: f"0{d(3)} {d(6)}", lambda: f"0{d(4)} {d(6)}", lambda: f"0{d(4)}-{d(6)}", lambda: f"0{d(3)}-{d(3)} {d(3)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"07{d(3)} {d(6)}", lambda: f"07{d(3)}-{d(6)}", lambda: f"+44 7{d(3)} {d(6)}", lambda: f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}", lambda: f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", lambda: f"0{d(9)}",
            lambda: " ".join(r.choice(DIGIT_WORDS) for _ in range(r.choice([7, 7, 10]))), lambda: " ".join(["five"] * 3 + [r.choice(DIGIT_WORDS) for _ in range(4)]), lambda: "-".join(r.choice(DIGIT_WORDS) for _ in range(7)), lambda: f"{d(3)}-{d(3)}-{d(4)} ext. {d(3)}",
        ])()

    def id_number(self) -> tuple[str, str]:
        """Leading words that are no part of the number, and the number."""
        r, d, a = self.r, self.digits, self.letters
        colon = lambda words: r.choice(words) + r.choice([" ", " ", ": ", " # "])
        kind = r.random()
        if kind < 0.22:
            sep = r.choice("-- ") if r.random() < 0.9 else "."
            lead = r.choice(["", "", "SSN ", "SSN: ", "social security ", "ssn "]) if sep == "-" else r.choice(["SSN ", "SSN: ", "ssn "])
            return lead, f"{r.choice(['9' + d(2), d(3)])}{sep}{d(2)}{sep}{d(4)}"
        if kind < 0.34:
            return colon(PASSPORT), r.choice([a(1) + d(r.choice([7, 7, 8])), d(9), a(2) + d(7), d(2) + a(2) + d(5), "C" + a(1) + d(7)])
        if kind < 0.45:
            return r.choice(["DNI ", "DNI: ", "NIE ", "dni ", "NIF ", ""]), r.choice([d(8) + a(1), d(8) + "-" + a(1), r.choice("XYZ") + d(7) + a(1)])
        if kind < 0.57:
            return colon(NATIONAL), r.choice([r.choice("LMTCFGHJ") + d(2) + r.choice("XYZPRK") + d(5), a(2) + d(7), a(3) + d(6), d(11), d(9), d(10), f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{a(6)}{d(2)}{a(1)}{d(2)}{a(1)}{d(3)}{a(1)}", f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}", d(8)])
        if kind < 0.67:
            return colon(LICENCE), r.choice([a(3) + d(6), a(1) + d(7), a(1) + d(8), d(8), a(2) + d(6), a(5) + d(6) + a(2), a(1) + d(3) + "-" + d(4) + "-" + d(4)])
        if kind < 0.8:
            first = r.choice(["4" + d(3), "4" + d(3), "5" + r.choice("12345") + d(2), "3" + r.choice("47") + d(2), "6011", d(4)])
            sep = r.choice(["", " ", "-"])
            number = sep.join([first, d(4), d(4), d(4)]) if r.random() < 0.9 else f"{first}{sep}{d(6)}{sep}{d(5)}"
            return r.choice(["", "", "", "card ", "card no. ", "Visa ", "Karte "]), number
        if kind < 0.85:
            return colon(ACCOUNT), r.choice([d(8), d(10), d(12), f"{d(2)}-{d(2)}-{d(2)} {d(8)}", d(7)])
        country = r.choice(["GB", "GB", "DE", "FR", "NL", "ES", "IT", "PT", "PL", "AT", "CH", "BE"])
        iban = country + d(2) + r.choice([a(4) + d(14), a(4) + d(10), d(18), d(20), d(22), a(1) + d(22), d(4) + d(14)])
        return r.choice(["", "", "", "IBAN ", "IBAN: "]), iban if r.random() < 0.5 else " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))

    def town(self) -> str:
        r = self.r
        return r.choice(TOWN_START) + (self.stem(r.choice([1, 1, 2])) + (r.choice(TOWN_END) if r.random() < 0.8 else "")).capitalize()

    def street(self, lang: str) -> str:
        # half of the streets have made-up words
        return self.r.choice(STREET_WORD[lang]) if self.r.random() < 0.5 or lang == "rus" else (self.stem(self.r.choice([1, 2])) + self.r.choice(["", "", "er", "en", "ow", "ick"])).capitalize()

    def address(self) -> str:
        r, t = self.r, self.town()
        d = str(r.randint(1, 250)) + (r.choice("abcAB") if r.random() < 0.08 else "")
        town = f", {t}" if r.random() < 0.6 else ""
        code = self.digits(5)
        box = f"{r.choice(['P.O. Box', 'P.O. Box', 'PO Box', 'P. O. Box', 'Postfach', 'BP', 'B.P.', 'Boîte postale', 'Apartado', 'Apartado de correos', 'Casella postale', 'Caixa postal', 'Postbus', 'skr. poczt.', 'а/я'])} {self.digits(r.randint(2, 6))}"
        s = self.street
        out = r.choice([
            lambda: f"{d} {s('eng')} {r.choice(['Road', 'Street', 'Lane', 'Avenue', 'Drive', 'Close', 'Court', 'Way', 'Place', 'Terrace', 'Boulevard', 'Crescent'])}{town}", lambda: f"{d} {s('eng')} {r.choice(['St', 'Rd', 'Ave', 'Ln', 'Dr', 'Blvd', 'St.', 'Ave.'])}{town}",
            lambda: f"{d} {s('eng')} {r.choice(['St', 'Street', 'Ave', 'Road'])}{r.choice([' Apt ', ', Apt ', ' Unit ', ' Flat ', ', Suite ', ' #'])}{r.randint(1, 60)}", lambda: f"{d}, {s('eng')} {r.choice(['Road', 'Street'])}, {t} {r.choice([code, self.digits(4), f'{self.letters(2)}{self.digits(1)} {self.digits(1)}{self.letters(2)}'])}",
            lambda: f"{d}{r.choice([' ', ', ', ' bis '])}{r.choice(['rue', 'avenue', 'boulevard', 'place', 'impasse', 'quai', 'chemin'])} {r.choice(['', 'de la ', 'du ', 'des ', 'de '])}{s('fra')}{r.choice([town, f', {code} {t}'])}",
            lambda: f"{s('deu')}{r.choice(['straße', 'str.', 'weg', 'gasse', 'allee', 'platz', 'strasse', 'ring'])} {d}{r.choice(['', town, f', {code} {t}'])}", lambda: f"{r.choice(['Am', 'An der', 'Im', 'Zum'])} {s('deu')} {d}{r.choice([town, f', {code} {t}'])}",
            lambda: f"{r.choice(['calle', 'Calle', 'avenida', 'plaza', 'paseo', 'C/', 'Avda.'])} {s('spa')}{r.choice([' ', ', '])}{d}{town}", lambda: f"{r.choice(['via', 'Via', 'viale', 'piazza', 'corso', 'vicolo'])} {s('ita')}{r.choice([' ', ', '])}{d}{town}",
            lambda: f"{r.choice(['rua', 'Rua', 'avenida', 'travessa', 'largo'])} {s('por')}{r.choice([' ', ', '])}{d}{town}", lambda: f"{s('nld')}{r.choice(['straat', 'laan', 'weg', 'gracht', 'plein', 'kade'])} {d}{r.choice([town, f', {self.digits(4)} {self.letters(2)} {t}'])}",
            lambda: f"{r.choice(['ul.', 'al.', 'pl.', 'ulica'])} {s('pol')} {d}{r.choice(['', '/' + str(r.randint(1, 40)), town])}", lambda: f"{r.choice(['ул.', 'улица', 'проспект', 'пер.'])} {s('rus')}{r.choice([', д. ', ', ', ' '])}{d}", lambda: f"{box}{r.choice([town, f', {code} {t}', ''])}", lambda: f"{box}{town}",
        ])()
        x = r.random()
        return out.upper() if x < 0.04 else out.lower() if x < 0.18 else out

    def figure(self) -> str:
        """A number of a machine: serial, offset, version, checksum."""
        r, d = self.r, self.digits
        return r.choice([
            lambda: str(r.randint(10**4, 10**11)), lambda: str(r.randint(10**4, 10**9)), lambda: d(r.randint(4, 8)) + self.letters(1) + d(r.randint(2, 4)), lambda: self.letters(2) + self.hexa(r.randint(6, 9)), lambda: self.hexa(r.choice([6, 8, 8, 12, 16])),
            lambda: f"{d(r.randint(1, 2))}.{d(1)}.{d(r.randint(3, 6))}", lambda: f"{d(r.randint(2, 4))}-{d(r.randint(4, 6))}-{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(2)}", lambda: f"{d(2)}-{d(1)}", lambda: f"{d(4)}:{d(4)}", lambda: f"0x{self.hexa(8)}", lambda: self.letters(1) + d(r.randint(3, 6)),
        ])()

    def lang(self) -> str:
        return "eng" if self.r.random() < 0.4 else self.r.choice(LANGS)

    def product(self) -> str:
        """Something with capitals that is no person."""
        r = self.r
        brand = self.stem(r.choice([1, 2, 2])).capitalize() + r.choice(["", "", "", "ix", "ex", "on", "us", "tek", "co", "um", "or", "io", "ware"])
        code = r.choice([self.digits(3), f"{r.randint(1, 16)}T", f"{self.letters(1)}{self.digits(1)}", f"{self.letters(2)}{self.digits(3)}", f"{self.letters(1)}-{self.digits(2)}", f"{r.choice([16, 32, 64, 128])}G", f"{r.randint(1, 9)}.{r.randint(0, 9)}"])
        x = r.random()
        if x < 0.4:
            return f"{brand} {r.choice(THINGS)}"
        if x < 0.6:
            return f"{brand} {r.choice(THINGS)} {code}"
        if x < 0.75:
            return f"{brand} {code}"
        if x < 0.85:
            return f"{r.choice(THINGS)} {r.choice(THINGS)}"
        return f"the {brand} {r.choice(THINGS).lower()}" if x < 0.93 else f"{r.choice(['Port', 'Lake', 'Mount', 'Hotel', 'Café', 'Windows', 'Project', 'Team', 'Version', 'Room', 'Hall'])} {brand}"

    def prose(self) -> str:
        """A stretch of the declaration, or everyday words in a row."""
        r = self.r
        if r.random() < 0.12:  # a word or three
            words = [r.choice([r.choice(SMALL), r.choice(SMALL), r.choice(PLAIN), r.choice(THINGS).lower(), r.choice(DOING), r.choice(DECLARATION[self.lang()].split())]) for _ in range(r.randint(1, 3))]
            text = " ".join(words)
            return text.capitalize() if r.random() < 0.4 else text
        if r.random() < 0.5:
            words = DECLARATION[self.lang()].split()
            at = r.randrange(len(words) - 6)
            return self.mumbled(" ".join(words[at : at + r.randint(4, 12)]))
        if r.random() < 0.4:
            # words of a language in no order
            words = [w for part in PARTS[self.lang()] for x in r.sample(part, 3) for w in x.split()]
            return self.mumbled(" ".join(r.sample(words, min(len(words), r.randint(4, 10)))))
        thing = lambda: r.choice(THINGS).lower() + r.choice(["", "", "s"])
        phrase = lambda: f"{r.choice(['the', 'a', 'every', 'no', 'two', 'all the', 'this', 'its', 'some', 'both', 'most of the'])} {r.choice(PLAIN) + ' ' if r.random() < 0.6 else ''}{thing()}"
        text = f"{phrase()} {r.choice(DOING)}{r.choice(['s', 'ed', 's', ''])} {phrase()}{r.choice(['', '', f' {r.choice(WITH)} {phrase()}', f' {r.choice(WITH)} {r.choice(PLAIN)} {thing()}'])}"
        return self.mumbled(text[0].upper() + text[1:] if r.random() < 0.8 else text)

    def mumbled(self, text: str) -> str:
        """Some words replaced by made-up ones in the same case, for no list of words is complete."""
        r = self.r
        if r.random() < 0.4:
            return text
        made = lambda w: self.stem(r.choice([1, 1, 2])) + r.choice(["", "", "en", "s", "o", "ar", "ung", "ión", "ato", "ie", "em"])
        words = [w if r.random() < 0.7 or len(w) < 4 else (made(w).capitalize() if w[0].isupper() else made(w)) for w in text.split()]
        return " ".join(w or "x" for w in words)

    def sentence(self, subject: str | None = None) -> str:
        text = self.prose() if subject is None and self.r.random() < 0.4 else self.mumbled(sentence(self.r, self.lang(), "\0" if subject else None)).replace("\0", subject or "")
        if self.r.random() < 0.25:
            text += self.r.choice([f" {self.n()}", f" at {self.n()}", f" in {self.n(2)} minutes", f" ({self.n()} bytes)", f" #{self.n()}", f" 0x{self.hexa(6)}", f" {self.n()} {self.product()}"])
        return text

    def noise(self) -> str:
        """Texts without any personal information that look like some."""
        r, d, hexa, n = self.r, self.digits, self.hexa, self.n
        if r.random() < 0.2:
            # numbers of forbidden or unknown kinds among other figures
            tail = " ".join(r.choice([n(), hexa(8), d(10), f"{r.choice(['000', '666'])}-{d(2)}-{d(4)}", d(16), f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"0x{hexa(4)}"]) for _ in range(r.randint(2, 5)))
            return r.choice([tail, f"{self.sentence()}: {tail}", f"{r.choice(['INFO', 'WARN', 'ERR', 'DEBUG'])} {tail}"])
        if r.random() < 0.35:
            marked = lambda: f"{r.choice(NUMBERED)}{r.choice([' ', ' ', ': ', '=', '#'])}{self.figure()}"
            word = lambda: r.choice(NOUN).lower()
            quote = r.choice("'\"")
            return r.choice([
                lambda: f"{self.sentence()}{r.choice([', ', ': ', ' ', ' – '])}{marked()}", lambda: f"{self.sentence()}, {marked()}, {marked()}", lambda: f"{marked()} {self.sentence()}", lambda: f"{self.sentence()}, {', '.join(f'{word()} {self.figure()}' for _ in range(r.randint(1, 3)))}", lambda: "↵".join(marked() for _ in range(r.randint(2, 3))), lambda: f"---↵{word()}: {self.figure()}↵{word()}: {self.figure()}",
                lambda: '{"' + word() + '":"' + self.figure() + '","' + word() + '":"' + r.choice([self.figure(), word()]) + '"}', lambda: f'{{"{word()}":"{word()}@{r.choice("1234")}x.png","{word()}":"{self.figure()}"}}', lambda: f"CREATE TABLE {r.choice([word(), 't', 'x'])}{d(r.randint(1, 6))} ({word()} INT, {word()} CHAR({n(2)}));", lambda: f"<?php echo {word()}({quote}{r.choice('YmdHis')}{quote}) . {quote}{self.figure()}{quote};", lambda: f"{word()}: {self.figure()}↵{word()}: {r.choice([d(2) + 's', 'true', self.figure()])}↵{word()}: {word()}-{self.figure()}.{r.choice(['img', 'bin', 'log'])}", lambda: f"├── {self.figure()}↵│   └── {self.figure()}.{r.choice(['bin', 'dat'])}",
                lambda: f"{self.product()} {marked()}", lambda: f"{quote}{self.figure()}{quote}, {quote}{self.figure()}{quote}", lambda: f"{word()}({self.figure()}, {self.figure()});", lambda: f"<{word()} {word()}=\"{self.figure()}\">{self.figure()}</{word()}>", lambda: f"{self.sentence().upper()}, {word().upper()} {n(2)}, {word().upper()} {n(2)}, {word().upper()} {d(2)}-{d(1)}",
            ])()
        if r.random() < 0.3:
            v = ".".join(str(r.randint(0, 99)) for _ in range(r.choice([3, 3, 4])))
            tail = r.choice([f"(v{v})", f"@{v}", f"v{v}-rc{d(1)}", f"[{d(2)}:{d(2)}:{d(2)}.{d(3)}]", f"build {v}", f"rack {d(2)}, slot {d(1)}", f"rev. {v}", f"({n(2)}/{n(3)})", f"SN {self.letters(2)}{d(6)}", f"part no. {d(3)}-{d(4)}", f"block {d(8)}", f"({self.product()} {v})", f"order {d(7)}", f"{d(3)},{d(3)},{d(3)}", f"page {n(2)} of {n(3)}", f"temp {d(2)} C"])
            return f"{self.sentence()}{r.choice([' ', ' ', ': ', ', '])}{tail}"
        word = lambda: r.choice(NOUN).lower()
        return r.choice([
            lambda: f"0x{hexa(8)} 0x{hexa(8)} +{n()}", lambda: " ".join(hexa(2) for _ in range(r.randint(8, 20))), lambda: ";".join(r.choice([n(), f"{r.random():.2f}", "-" + n(2), word()]) for _ in range(r.randint(4, 9))), lambda: ",".join([word(), n(), word(), n(8)]),
            lambda: f"/{word()}/{word()}/{hexa(8)}/{n()}.{r.choice(['tmp', 'log', 'bin', 'txt'])}", lambda: f"C:\\{word()}\\{word()}\\{hexa(6)}.{r.choice(['dat', 'dll', 'docx'])}", lambda: f"├── {word()}_{hexa(4)}↵│   ├── {n()}.bin↵└── {word()}.txt", lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}",
            lambda: '{"' + word() + '":' + n() + ',"' + word() + '":"' + r.choice([hexa(8), word(), self.product()]) + '"}', lambda: '{"src":"' + word() + r.choice(["@2x.png", "@3x.jpg", "@latest", ".css?v=" + d(3)]) + '","w":' + n(3) + "}", lambda: f'[{{"{word()}":{n()},"{word()}":[{n()},{n()}]}}]', lambda: f"---↵{word()}: {n()}↵{word()}: {r.choice(['true', 'yes', word(), d(2) + 's'])}↵{word()}: {self.product()}", lambda: f"{word()} = {n()}↵{word()} = '{word()}'",
            lambda: f"#!/bin/{r.choice(['sh', 'bash'])}↵{r.choice(['cp', 'mv', 'tar xf', 'rsync -a', 'mount'])} /{word()}/{word()} {hexa(4)}", lambda: f"#!/usr/bin/env python3↵import {word()}↵print({n()})", lambda: f'<?xml version="1.0" encoding="utf-8"?><{word()} id="{n()}"/>', lambda: f'<html><head><title>{self.product()}</title></head><body class="{word()}">', lambda: f"<div id=\"{word()}\"><span>{self.sentence()}</span></div>",
            lambda: f"SELECT {word()}, {word()} FROM {word()}s WHERE {word()} > {n()};", lambda: f"INSERT INTO {word()}s VALUES ({n()}, '{hexa(8)}');", lambda: f"CREATE TABLE {word()}_{n(2)} (id INT, {word()} VARCHAR({n(2)}));", lambda: f"DELETE FROM {word()}s WHERE id = {n()};", lambda: f"struct {word()} {{ int {word()}[{n(3)}]; char *{word()}; }};", lambda: f"#include <{word()}.h>↵static long {word()} = {n()};", lambda: f"int main(void) {{ return {word()}({n()}); }}", lambda: f"<?php ${word()} = {n()}; echo date('d.m.Y');", lambda: f"<?php require_once '{word()}_{hexa(4)}.php'; ${word()}->{word()}();",
            lambda: f"{self.product()}, {self.product()} {r.choice(['and', 'or', '/', '-'])} {self.product()}", lambda: f"{r.choice(['see', 'Install', 'Replaced by', 'Model:', 'Vendor:', '#', 'new', 'siehe', 'voir'])} {self.product()} {r.choice(['', 'serial ' + self.letters(2) + hexa(6).upper(), 'v' + d(1) + '.' + d(2)])}", lambda: f"git@{r.choice(HOST)}.{r.choice(TLD)}:{word()}/{word()}.git", lambda: f"https://{r.choice(HOST)}.{r.choice(TLD)}/{word()}?id={n()}", lambda: f"http://{d(2)}.{d(1)}.{d(1)}.{d(2)}:{d(4)}/{word()}", lambda: f"{d(3)}.{d(2)}.{d(1)}.{d(2)} - - [{d(2)}/May/20{d(2)}:{d(2)}:{d(2)}] {n()}",
            lambda: f"{r.choice(['Chapter', 'Section', 'Figure', 'Table', 'Kapitel', 'Abschnitt'])} {n(2)}: {self.sentence()}", lambda: f"{r.choice(['Monday', 'Tuesday', 'Friday', 'March', 'April', 'Montag', 'Dienstag', 'juin', 'lunes'])} {n(2)}, {d(2)}:{d(2)}: {self.sentence()}", lambda: f"@{word()} {self.sentence()}", lambda: f"{self.sentence()} @ {d(2)}.{d(1)}", lambda: f"{word()}@{r.choice(['1x', '2x', '3x'])}.{r.choice(['png', 'svg', 'webp'])} {n()}",
        ])()

    def garbled(self, text: str) -> str:
        """The text read in another encoding, as far as that goes."""
        wrong, right = self.r.choice([("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("cp1252", "cp1251"), ("cp850", "cp1252"), ("cp1251", "koi8-r"), ("utf-8", "cp1252")])
        return text.replace("↵", "\n").encode(right, "replace").decode(wrong, "replace").replace("\n", "↵")

    def item(self, kind: str | None = None) -> tuple[str, str, str]:
        """Text before, the span, its type."""
        kind = kind or self.r.choice(["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME", "NAME"])
        if kind == "ID_NUMBER":
            lead, number = self.id_number()
            return lead, number, kind
        return "", {"EMAIL": self.email, "PHONE": self.phone, "ADDRESS": self.address, "NAME": self.name}[kind](), kind

    def frame(self, kind: str) -> str:
        """A text with ``{}`` for an item of the type, in a context that suits it."""
        r, n, s = self.r, self.n, self.sentence
        word = lambda: r.choice(NOUN).lower()
        x = r.random()
        if x < 0.28:  # an item beside sentences
            return r.choice([
                "{} - " + s(), s() + " ({}).", s() + ": {}", s() + ", {}", "{}↵" + s(), s() + " – {}", "{}: " + s(), s() + "↵{}", s() + ". {}", "{}, " + s(), s() + " {}", "{} " + s(), "{}; " + s(), "{}. " + s() + ".", s() + "↵↵{}", s() + "; {}", s() + " / {}", "({}) " + s(), "“{}” " + s(), "* {}↵* " + s(), s() + " | {}",
            ])
        if x < 0.44:  # inside one
            words = s().split()
            at = r.randrange(len(words) + 1)
            return " ".join([*words[max(0, at - r.randint(0, 6)) : at], "{}", *words[at : at + r.randint(0, 6)]])
        if x < 0.54:  # items with each other
            return r.choice(["{}", "{}", "{}; {}", "{} / {}", "{}, {}", "{} and {}", "{} or {}", "{}↵{}", "{} | {}", "1. {}↵2. {}", "- {}↵- {}", "{} ({})", "{} – {}", "{}: {}"])
        if x < 0.68:  # code and data
            quote = r.choice("'\"")
            return r.choice([
                '{{"' + word() + '":"{}","' + word() + '":' + n() + "}}", '[{{"' + word() + '":' + n() + ',"' + word() + '":"{}"}}]', "{{'" + word() + "': '{}'}}", '<p class="' + word() + '">{}</p>', "<td>{}</td><td>" + n() + "</td>", "<li>{}</li>", '<a href="#">{}</a>', "<" + word() + ">{}</" + word() + ">", "---↵" + word() + ": {}↵" + word() + ": " + n(), word() + ": " + n() + "↵" + word() + ": " + quote + "{}" + quote, "- " + word() + ": {}↵  " + word() + ": " + n(),
                "#!/bin/sh↵# {}↵" + word() + " " + n(), "#!/bin/bash↵echo " + quote + "{}" + quote, word() + "=" + quote + "{}" + quote + "; " + word(), "<?php $" + word() + " = '{}'; $" + word() + " = " + n() + ";", "<?php // {}↵echo " + n() + ";", "INSERT INTO " + word() + "s VALUES (" + n() + ",'{}');", "INSERT INTO " + word() + " (" + word() + ") VALUES ('{}');", "UPDATE " + word() + " SET " + word() + "='{}' WHERE id=" + n() + ";", "SELECT * FROM " + word() + " WHERE " + word() + " = '{}';", "-- {}↵SELECT " + n() + ";",
                "/* {} */↵int " + word() + " = " + n() + ";", "// {}", "// " + word() + ": {}", "char *" + word() + " = \"{}\";", "#define " + word().upper() + " \"{}\"", word() + "={}&" + word() + "=" + n(), "# {}", "## {}↵" + s(), "> {}↵> " + s(), "| {} | " + n() + " |", "**{}** " + s(), "<!-- {} -->", "@author {}" if kind in ("NAME", "EMAIL") else "# {}", word() + "," + "{}," + n(), n() + ";{};" + word(),
            ])
        own = {
            "EMAIL": ["mail {} today", "send it to {} please", "reach us at {}", "my address is {} if needed", "Schreiben Sie an {} für Fragen", "per E-Mail: {}", "envoyez un message à {}", "escríbanos a {} si hay dudas", "scrivere a {} per informazioni", "fale connosco em {}", "stuur een bericht aan {}", "napisz do {} w tej sprawie", "пишите нам на {}", "To: {}", "From: {}↵Subject: " + s(), "Cc: {}", "e-mail {}", "the account {} was locked", "{} wrote:", "login {}", "user={}", "Antworten an {}↵" + s()],
            "PHONE": ["phone {} before noon", "you can ring {} any time", "mobile: {}", "fax: {}", "Tel.: {}", "tel {}", "Telefon {} (abends)", "unter {} erreichbar", "téléphone : {}", "joindre le {} le matin", "teléfono {}", "llame al {} mañana", "chiamate il {} dopo pranzo", "ligue para {} hoje", "bel {} voor hulp", "zadzwoń pod {} jutro", "звоните по номеру {}", "our hotline is {} day and night", "cell {}", "dial {} now", "text me on {}"],
            "ID_NUMBER": ["the form shows {} in the second box", "kept under {} in the register", "holder of {} since 2009", "auf dem Formular steht {} oben", "numéro {} dans le registre", "el número {} figura en la ficha", "il documento {} risulta smarrito", "documento {} entregue ontem", "nummer {} staat op het formulier", "numer {} w aktach", "номер {} в анкете", "photocopy of {} in the folder", "please confirm {} by return", "charged to {} twice", "transfer to {} until Friday", "{} expired"],
            "ADDRESS": ["send the parcel to {}", "we moved to {} in spring", "office: {}", "Anschrift: {}", "wohnhaft {} seit Mai", "bitte nach {} liefern", "adresse : {}", "habite au {} depuis mai", "dirección: {}", "vive en {} con su familia", "abita in {} da anni", "mora na {} desde maio", "woont op {} sinds mei", "mieszka przy {} od maja", "живёт по адресу {}", "meet me at {} on Sunday", "invoice address {}", "pick up at {} please", "the house at {} is empty"],
            "NAME": ["Dear {},", "Dear {}, " + s(), "Hi {}, " + s(), "Hello {}!", "Best regards, {}", "Kind regards↵{}", "Mr {} agreed", "Mrs {} will call back", "Dr. {} signed it", "owner {}", "author: {}", "written by {} in May", "sent by {} yesterday", "a letter from {} arrived", "ask for {} at the desk", "I met {} at the station", "{} said so", "{} called twice", "Sehr geehrter Herr {},", "Frau {} hat angerufen", "gezeichnet {}", "Grüße, {}", "Madame {} a téléphoné", "Cher {}, " + s(), "signé {}", "monsieur {} est absent", "Estimado {}, " + s(), "la señora {} llamó ayer", "atentamente, {}", "Gentile {}, " + s(), "il signor {} ha chiamato", "Prezado {}, " + s(), "a senhora {} ligou", "Beste {}, " + s(), "mevrouw {} belde gisteren", "pan {} zadzwonił", "Уважаемый {}, " + s(), "звонила {} вчера", "customer: {}", "approved: {}", "the keys of {} are here", "for {} only", "contact person {}", "teacher {} and the class", "received from {}", "assigned to {} on Friday"],
        }[kind]
        if kind == "NAME" and r.random() < 0.4:
            return sentence(r, self.lang(), "\0").replace("\0", "{}")
        return r.choice(own)

    def example(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        x = r.random()
        spans: list[tuple[int, int, str]] = []
        if x < 0.26:
            text = self.noise()
        elif x < 0.4:
            text = r.choice([". ", "! ", "; ", ".↵↵", ",↵", ".↵", ", ", " – ", " "]).join(self.sentence() for _ in range(r.randint(1, 3)))
            y = r.random()
            text = text.upper() if y < 0.2 else text.lower() if y < 0.25 else self.garbled(text) if y < 0.5 else text
        elif x < 0.54:
            text = r.choice([self.sentence(self.product()), self.sentence(self.product()), f"{self.sentence()}, {self.product()}", f"{self.sentence()} ({self.product()})", f"{self.sentence()}: {self.product()}"]) + r.choice([".", "", "!"])
            y = r.random()
            text = text.upper() if y < 0.12 else self.garbled(text) if y < 0.22 else text
        else:
            items = [self.item()]
            frame = self.frame(items[0][2])
            parts = frame.replace("{{", "\x01").replace("}}", "\x02").split("{}")
            while len(items) < len(parts) - 1:
                items.append(self.item())
            text = parts[0]
            for (lead, span, kind), rest in zip(items, parts[1:]):
                text += lead
                spans.append((len(text), len(text) + len(span), kind))
                text += span + rest
            text = text.replace("\x01", "{").replace("\x02", "}")
        if r.random() < 0.15:
            lead = r.choice(["# ", "## ", "- ", "**", "> ", "* ", "1. ", "\t"])
            text = lead + text
            spans = [(a + len(lead), b + len(lead), k) for a, b, k in spans]
        text += r.choice(["", "", "", "", "↵", ".", "↵↵", ";"])
        if len(text) > 80 and r.random() < 0.9:
            text = text[:80]
        spans = [(a, min(b, len(text)), k) for a, b, k in spans if a < len(text) and min(b, len(text)) - a >= 0.6 * (b - a)]
        return text, spans
