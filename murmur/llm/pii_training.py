"""Composed sentences for the finder of personal information, and the fit of its weights.

Numbers and addresses follow published national formats, names join frequent names of many languages with made-up ones,
and plain words are drawn from a public vocabulary; nothing is taken from the data that is searched.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np

from murmur.llm import pii_words as W
from murmur.llm.pii import BITS, ENDING, KINDS, Batch, Lists, Model, _Rows, frequent_words
from murmur.llm.tokens import VOCABULARY

_SLOT = re.compile(r"\{(\w+)\}")
#: Sentences with personal information.
POSITIVE = {
    "email": "Mail: {email}|Reach our office under {email} on weekdays.|{email}|Questions go to {email}, we answer all|drop a line at {email}|Does anybody still read {email}?|My address for invitations ({email}) has changed.|Forward it to {email}!|cc {email} as well|contact = {email}|if you want the recipe: {email}|Job offers please to {email}. Thanks|booking {email}|He signs as {email} everywhere|{email} bounced twice|E-Mail an {email}|Write me: {email} (no spam)|her inbox is {email}|{email} or {email}|send the invoice to {email}, attn {name}|{name}, {email}",
    "phone": "Phone {phone} before noon|{phone}|{phone}|{phone}|my landline is {phone}|Selling my {word}, {phone}|Anyone near the {word}? {phone}|{phone} rings all day|You can ring {phone} any evening|our number has changed to {phone}, sorry|my number: {phone}|Text me, {phone}, about the flat|Telefon {phone}|llama al {phone}|Rufen Sie {phone} an|whatsapp {phone} for a price|Selling two bikes ({phone}).|The van says {phone} on its side|{phone} is the landline, the cell is off|{phone}, call any time|{phone} is my number now|Need a plumber? {phone}.|dial {phone} if the door is shut|mobile {phone}|Tel. {phone}|tél : {phone}|ask for {name} at {phone}|Call {phone} or {phone}|for rent, {phone}|my digits are {phone} if you want to jam|reach me at {phone} after six|text {phone} to join|{name} {phone}|fax {phone}",
    "id_number": "My {id_number} leaked last year|I lost my {id_number}.|the clerk wrote down {id_number} twice|Should I give them my {id_number}?|his {id_number} is on the photo|The form asks for {id_number}, why?|{id_number}|They printed {id_number} on the cover|she read her {id_number} out loud|Why does the shop need {id_number}?|you can see {id_number} in the frame, blur it|Applicant: {name}, {id_number}|Is {id_number} enough to register?|my {id_number} expires soon|your {id_number} is visible!",
    "address": "Our office is at {address}|{address}|{address}|{address} is next to the {word}|{address} is for sale|{address} was where we {word}|She moved to {address} in spring.|Deliver to {address}, please.|address: {address}|The bakery is at {address}!|Meet me at {address} on Friday.|Fire at {address} again|The letter went to {address}|{address} has been empty for years.|we live at {address}, come in|I grew up on {address}.|the party is {address}, bring cake|Ich wohne {address}.|J'habite {address}.|Vivo en {address}.|{name}, {address}|find us here: {address}|the house ({address}) was sold|mail it to {address}|pick up from {address} only|That is {address}, I know it!",
    "name": "{name}|{name}|{name}|{name}|I spoke to {name} yesterday|{name}|Yours, {name}|With love from {name}|The novel by {name} sold out|My neighbour {name} sings|{name} was elected.|{name} and I went fishing|Is {name} still the coach?|I am {name}, nice to meet you|my name is {name}|Signed, {name}|Regards, {name}|Nobody told {name} about dinner|Thanks {name}, that helped|Dear {name}, the river froze.|@{name} no idea|A letter for {name} arrived|We all miss {name}!|Dr {name} called back|That photo of {name} made me cry|Hi, {name} speaking|Gruß an {name} aus Wien|{name}: what a goal|it was {name} on drums|{name} asked for more salt|I voted for {name}.|{name} broke the window|{name}, please come back|Mr. {name} taught us chess|thanks to {name} and {name}|{name} & {name}|says {name}|{name} here.|I married {name} in June|we met {name} in a bar|interview with {name}|Who is {name}?|{name} lives next door|RIP {name}|Merci à {name}|Gracias a {name} por todo|{name} has the {word}|{name} should {word} it|she swears {name} {word} the {word}|my teacher {name} {word}|the {word} of {name}|{word} by {name} for the {word}|you know {name}, right?|{name} would love this {word}|copied from {name} during {word}|with {name} as {word}|between {name} and the {word}",
}
#: Sentences without, most of which look as if.
NEGATIVE = (
    "Invoice {d4}-{d3}-{d3} was paid|Order {code} came broken|Update {d1}.{d2}.{d3} is out|Patients {d3} {d3} {d3} on three days.|Ticket {d10} is closed.|Born 19{d2}-0{d1}-1{d1}.|Release {d3}-{d2}-{d4} of the app|the number {d10} won nothing|Serial {code} of the mower|model {code} is out of stock|Part no. {code}|Error {code} again|firmware {code} bricked it|The product code is {code}|Isbn {d3}-{d1}-{d3}-{d5}-{d1}|reference {code}|build {code} fails|order number {d9}|batch {d3}-{d3}-{d4} was recalled|version {code}|version {d3}-{d2}-{d4}|We lost {d1}-{d2} in {d3} minutes|Film at ISO {d3}, 1/{d3} s, {d2}mm.|A screen of {d4}x{d4} dots, {d2} fps.|Take {d1}, {d2} or {d3} of them|Room {d3}, floor {d1}, {d2} degrees.|At {d2}:{d2} the train had {d2} seats.|Page {d2} has a misprint|The code has {d2} digits.|Tracking {d10} says lost|Item {d8} was returned|Population {d3} {d3} {d3} by now|{d1}:{d2}|from {d1}:{d2} to {d2}:{d2} it drags|${d3},{d3} or {d2}%|{d2}/{d2}/20{d2}|on 20{d2}-{d2}-{d2} at {d2}:{d2}|the year 19{d2}, then 20{d2}|{d4} people, {d3} chairs, {d2} tables|{d1},{d3},{d3} views|scored {d2} {d2} {d2} {d2} in a row|pi is 3.{d9}|IP {d3}.{d3}.{d2}.{d1} is down|one two three four five six seven|count one two three four and turn|{d2} {d2} {d2} {d2} {d2} {d2} repeat|temperature {d2}.{d1} to {d2}.{d1}|Chapter {d1} {Word} {Word} bored me.|part {d3} is about the {word}|level {d2} {word}, level {d2} {word}|{d3} {word} and {d2} {word}|Call it {d1}, {d2} or {d3}|iso {d4} at f{d1}.{d1}|"
    "{word} on 20{d2}-{d2}-{d2}, room {d3}.|20{d2}-{d2}-{d2}, room {d3}|{d2}/{d2}/{d4}, floor {d1}|room {d3} at {d2}:{d2}|{Word} on {d2}.{d2}.{d4}, building {d1}|May {Given} be {word} with us|May {Given} {word}, the {word} {word} {d3}|{Made} {d2} {Made} {made}, {made} die {Made} {made}|nach {d2} {Made} {made}, aber das {Made} {made}|{d2} {Made} {made} und {made} der {Made}|am {Made} {d1} {Made} {made}, {made} der {Made} {made}|{Word} to the {Made} {word}!|{Word} from the {Made} {word}|My {word} on {Made}: {word}|{Word} of a {Made}|such an {leet}|you {leet} {word}|only an {leet} would {word}|{leet} {leet}|an {leet} like {word}|am {leet} {d2}|{made} {made} {made}, that {word}|Lesson {d1} {Road} {Word} is {word}|{Word} {d2} {Road} {Word}|{d3} {d3} {d3} {word} on the {word}|{d3} {d3} {d3} {word} {word}|{url}|see {url}|{word} {word} {url}|more at {url} for {word}|Ich habe am {Word} {d2} mal {word}, weil {word}|Am {Word} {d2} {word}|im {Word} {d3} {word} {word}|{d1}:{d2}, the {word} {road} is {word}|{d2} {word} of {word} {word} and nothing|the {word} {road} at {d1}:{d2} is {word}|{word} it in {d2} {word}, wow|the {road} {word} for {d2} {word}|{d2} {road} {word} by the {word}|stopped at {d1}:{d2}, the {word} {word} was {word}|{Made}er {Word}, aber der {Word} {word} {made}.|Über den {Made} {word} wir|{d3} {word} {word} and {word} how to {word} the {word}|{d3} {d3} {d3} {word} at {d1}:{d2}|"
    "Find me as @{handle} there.|Dinner at {d2}:{d2}@home today.|look at {word}.example now|{handle}|{handle}{d4}|guest {d1}|MC {d4}|meet at the {word}. dot your letters|at {d1}:{d2}. then {word}|the dot at {d2}:{d2} com|@ {d2}:{d2} the {word}|it is @{word} again|user@home|{word}@{d2}|"
    "{d2} minutes down the road he stopped.|They carried {d2} chairs down the street.|{d1} lane of the {word}|walk {d2} {word} a day|{d2} way {word}|{d1} {word} drive|The {Word} Street {Word} is a band|{Word} Street {Word} at {d2}:{d2} was full.|Row {d1} {Word} Food|drive it down lane {d1}|Court {d1} is wet|a {d2} mile road {word}|Square {d1} on the board|park {d2} {word}|hill {d1} of {d2}|{d3} {Word} {Word} presets|{d2} {Word} {word}|the road in {d4}|step {d1}: close the {word}|place {d2} of {d3}|{Word} {d2}, {Word} {d2}|"
    "{given} {word} it again.|{Given} {word} the whole {word}|I hope {given} {word} soon|May {Given} {word} well.|Will {Given} {word} tomorrow?|may {given} {word} you|{Given} {word}|{given} {word} {word}|Then {Given} {word} and left|{Given} {word}, I {word}|ask {given} {word}|the {word} {word} of {given} {word}|{Given}, {Given} and {Given} came|thanks {given}, the {word} works|{Given}'s {word}|{Given} and {Given}|{given} or {given}|hi {given}|{Given} is my {word}|with {Given} in the {word}|{Given} always {word}|{given} the {word}|{Given} P.|Dear {Given}, I {word}|Uncle {Given}|{Given} {d2}|{Given} {Word} TV|{Given} {Word} Channel|{Given} {Word}s|{Given}s {Word}|{Given} Official|Team {Given}|{Given} Music|{Given} the {Word}|Little {Given}|"
    "{word} {word} {word} {word}|{Word} {word} the {word}, {word} {word}|Some {word} {word} {word} it|{word} {word} by {word} {word}|{Word} {Word}|{Word} {Word} {d2}|{Word} {Word} {Word}|The {Word} Club|The {Word} {Word} Show|{Word} {Word} Weekly|{Made} {Word}|{Word} {Made}|{Made} {Made} is a new app|I use {Made} {Word} now|my {made} {word} broke|the {made} {word} {word}|we moved to {Made} {Word} in May|this {word} {word}|nothing here {word}|many thanks to everybody {word} tonight|It is {word} {word}, {word} {word}|{Made} {made} {made}, {made} {word}.|{made} {made} {made} {made} {made}.|{word} {made} {made} {word}|{Made} {made}|{Made} {Made}|{word} {word} than {made}|{Word} {made}|by {word} {word}|He went from {Made} {Word} to {Made}|Does {Made} {Word} run on it?|She sells {Made} {Word}|The {Word} {Word} opens in {Made} {Word}|Part {d1} {Word} {Made} is long|with {made} {word}|{Made} Pro|{Made} Studio {d1}|{Made} {Word} Edition|without {Made} it {word}|more {made}, less {word} {word}|{Made} again at {d1}:{d2}|the {Made} crew|Is {made} safe for a {word}?|Mr. {Word} and Captain {Word}|Professor {Word}|DJ {Word}|Lady {Word}|the {Word} of {Word}|{Word} University|I watch {Word} {Word} daily|new {word} from {Word} {Word}|{Word} vs {Word}|{Word} & {Word}|visit {Word} {Made}|in {Made} and {Made}|from {Made} to {Word}|compared {Made} with {Made}|{Title} {Title}|{Title} {Word}|in {Title}|near {Title} {Title}|{Word} {Title}|I {word} the {word} and {word} was {word}|Can you {word} the {word} next time?|Which {word} do you use for the {word}?|So {word}, truly {word}|best {word} of the {word} for me|"
    "Der Zug nach Hamburg fährt heute leider nicht mehr, sagen Sie das bitte den Kindern.|Können wir das Bild morgen früh noch einmal ansehen?|Über den Wolken lacht meine alte Nachbarin, danke schön.|Je ne sais pas si la maison de ma tante est encore ouverte ce soir.|Merci beaucoup, quelle belle journée pour aller au marché.|No creo que mañana podamos ir después de comer, la tienda está cerrada.|Qué bonito día, muchas gracias por todo amigos.|Non so se domani il treno arriva prima di mezzogiorno, grazie mille.|Obrigado pela ajuda, amanhã vamos todos para a praia comer peixe.|Dziękuję bardzo, jutro rano pójdziemy razem nad rzekę.|Спасибо большое, завтра утром мы пойдём вместе на реку.|Tack så mycket, i morgon går vi tillsammans till sjön.|Dank je wel, morgen gaan we samen naar het strand.|Çok teşekkürler, yarın sabah birlikte denize gideriz."
)
_CONTEXT = ["", "", "", "So it goes.", "It rained all day.", "I never saw that before.", "Who would have known?", "Our dog slept through it.", "Can we have another?", "The {word} {word} {word}.", "{Word} the {word} at {d2}:{d2}.", "My {word} is {word}, {word} too!", "{d2} {word} later", "We {word} {word} {d2} times."]
#: Family names of many languages; half of the names in training sentences are instead put together from syllables.
FAMILIES = (
    "smith jones taylor brown evans roberts walker wright hughes green hall clarke turner hill moore cooper ward morris king baker allen scott parker bennett murphy kelly o'brien o'connor mcdonald campbell reid fraser "
    "müller schmidt weber wagner becker hoffmann koch richter klein wolf schröder neumann braun zimmermann krüger hartmann lange huber de-vries jansen bakker visser smit vos peters dekker "
    "martin bernard dubois robert petit durand leroy moreau laurent lefebvre faure blanc garcía lopez martinez sanchez perez gomez fernandez ruiz diaz moreno muñoz romero torres vega silva santos oliveira pereira costa almeida "
    "rossi russo ferrari bianchi romano conti greco marino rizzo nowak kowalczyk wójcik kamiński mazur novak svoboda dvořák horvat babić nagy kovács szabó popescu ionescu petrov ivanov smirnov kuznetsov sokolov shevchenko bondarenko "
    "andersson johansson karlsson lindberg hansen olsen berg jensen nielsen korhonen virtanen papadakis georgiou yılmaz kaya demir çelik haddad khoury saleh hussain ahmed malik karimi levy "
    "singh sharma gupta verma reddy iyer nair das banerjee perera thapa wang li liu huang zhao wu lin tan kim park choi sato suzuki tanaka ito nakamura tran pham mensah owusu adeyemi okoye balogun mwangi otieno dlamini diallo traoré bekele"
).split()
_ONSETS = "b c d f g h j k l m n p r s t v w z br ch cr dr fl gr kr pl sh sk st th tr zh".split()
_NUCLEI = "a a e e i o u ai ea ie ou y".split()
_CODAS = ["", "", "", "", "l", "m", "n", "r", "s", "t", "k", "d", "z", "nd", "rt", "ck", "x"]
#: Endings of family names of several languages.
_FAMILY_ENDINGS = ["son", "sen", "ez", "ov", "ova", "ski", "ini", "etti", "ard", "mann", "berg", "ström", "feld", "ley", "ton", "wood", "worth", "ham", "by", "man", "well", "er", "ford", "field", "yev", "enko", "idis", "oğlu", "wala", "moto", "yama"]
_STREETS = ["Street", "Street", "St", "St.", "Road", "Rd", "Lane", "Ln", "Avenue", "Ave", "Ave.", "Drive", "Dr", "Crescent", "Court", "Close", "Square", "Terrace", "Boulevard", "Blvd", "Way", "Place", "Grove", "Gardens", "Parkway", "Hill", "Row", "Mews", "Circle", "Trail", "Walk"]
_STREET_NAMES = "Oak Maple High Church Station Victoria Park Mill King's Queen's Washington Lincoln Elm Cedar Pine Lake River Spring Main North Market Bridge Garden Sunset Franklin Chestnut Abbey Baker Cherry Forest Harbour Meadow Rose School Willow".split()
_CITIES = "London Leeds York Bath Boston Denver Austin Dallas Chicago Seattle Portland Springfield Madison Dover Sydney Perth Dublin Cork Berlin Hamburg Köln München Bonn Wien Paris Lyon Lille Nantes Madrid Sevilla Roma Milano Torino Lisboa Porto Utrecht Leiden Oslo Bergen Lund Kraków Gdańsk".split()
_STATES = "CA NY TX FL WA OH IL MA CO OR".split()
_HOSTS = "gmail yahoo outlook mail post inbox example web company school office shop studio media home".split()
_TOPS = "com org net de fr es co.uk io me example test example.com example.org edu info".split()


def _digits(rng: random.Random, n: int, first: str = "0123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _leading(number: str, rng: random.Random) -> str:
    """Now and then with noughts in front, as in specimens."""
    return "00" + number[2:] if number[:2].isdigit() and rng.random() < 0.15 else number


def _made_up(rng: random.Random) -> str:
    """A word of one to four syllables in no list."""
    return "".join(rng.choice(_ONSETS) + rng.choice(_NUCLEI) + rng.choice(_CODAS) for _ in range(rng.choice([1, 2, 2, 2, 3, 3, 4])))


class Composer:
    def __init__(self, seed: int, vocabulary: str = VOCABULARY):
        self.rng = random.Random(seed)
        lower, capital = frequent_words(vocabulary)
        self.words = sorted(w for w in lower if 4 <= len(w) <= 9 and w.isascii())
        self.capital = sorted(w for w in capital if w not in W.GIVEN and w not in FAMILIES)
        self.given = sorted(W.GIVEN) + "may will mark rose jack joy dawn hope grace bill frank sunny ivy".split()

    def family(self) -> str:
        """A made-up word with a common ending of family names."""
        return _made_up(self.rng) + self.rng.choice(_FAMILY_ENDINGS)

    def name(self) -> str:
        rng = self.rng
        first = rng.choice(self.given) if rng.random() < 0.85 else _made_up(rng)
        draw = rng.random()
        family = lambda: (rng.choice(FAMILIES) if draw < 0.5 else _made_up(rng) if draw < 0.8 else rng.choice(self.words) if draw < 0.83 else rng.choice(self.given) if draw < 0.88 else self.family()).title()
        middle = rng.choice(["", "", "", "", "", "", f" {rng.choice('ABCDEFGHJKLMNPRST')}.", f" {rng.choice('ABCDEKRST')}", " " + rng.choice(["van", "de", "von", "van der", "de la", "bin", "al", "da", "di"]), f" {rng.choice(self.given).title()}"])
        return f"{first.title()}{middle} {family()}" + (f"-{family()}" if rng.random() < 0.06 else "")

    def email(self) -> str:
        rng = self.rng
        part = lambda: rng.choice([rng.choice(self.given), rng.choice(self.words), _made_up(rng)])
        user = part() + (rng.choice([".", "_", "-", "", ""]) + part() if rng.random() < 0.7 else "") + rng.choice(["", "", _digits(rng, 2), "+" + part(), _digits(rng, 4)])
        host = (rng.choice(_HOSTS) if rng.random() < 0.5 else _made_up(rng)) + (f"-{rng.choice(_HOSTS)}" if rng.random() < 0.1 else "")
        whole = f"{host}.{rng.choice(_TOPS)}"
        at = rng.choice(["@", "@", "@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", " at ", " {at} ", "AT" if rng.random() < 0.1 else "@"])
        if at == " at " or rng.random() < 0.15:
            whole = whole.replace(".", rng.choice([" dot ", " dot ", "(dot)", " [dot] ", " (dot) "]))
        return user + at + whole

    def phone(self) -> str:
        rng, d = self.rng, functools.partial(_digits, self.rng)
        a, b, c = d(3, "23456789"), d(3, "23456789"), d(4)
        s = rng.choice([" ", "-", ".", " ", "-", "", "/"])
        draw = rng.random()
        if draw < 0.4:
            plain = rng.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}{s}{b}{s}{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"{a}{b}{c}", f"{a} {b}-{c}", f"{a}-{b}{c}"])
            return rng.choice(["", "", "", "+1 ", "+1-", "1-", "1 ", "+1", "001 "]) + plain + rng.choice(["", "", "", "", f" ext. {d(2)}", f" x{d(3)}", f", extension {d(3)}"])
        if draw < 0.55:  # country code and groups
            groups = rng.choice([(3, 3, 3), (1, 2, 2, 2, 2), (2, 4, 4), (3, 6), (4, 6), (2, 3, 4), (5, 5), (3, 3, 4), (2, 8), (2, 3, 2, 2), (10,), (9,), (2, 7), (2, 5, 3), (1, 4, 4), (3, 4, 4)])
            return rng.choice(["+", "+", "+", "00"]) + rng.choice("44 49 33 34 39 31 46 47 48 41 43 351 353 55 91 81 86 61 82 7 90 1".split()) + rng.choice([" ", " ", "-", "", " (0)"]) + rng.choice([" ", " ", "-", "."]).join(d(n, "123456789") for n in groups)
        if draw < 0.8:  # national prefix
            groups = rng.choice([(2, 3, 4), (3, 3, 4), (4, 6), (4, 3, 3), (3, 4, 4), (2, 2, 2, 2, 2), (2, 8), (4, 7), (5, 6), (3, 7), (3, 8), (2, 3, 3, 2), (1, 4, 4), (2, 4, 4), (11,), (10,), (4, 4, 3), (3, 3, 2, 2)])
            body = [d(n) for n in groups]
            body[0] = "0" + body[0][1:] if len(body[0]) > 1 else "0" + body[0]
            join = rng.choice([" ", " ", "-", ".", "/"])
            return f"({body[0]}) {join.join(body[1:])}" if len(body) > 1 and rng.random() < 0.25 else join.join(body) if rng.random() < 0.8 else f"{body[0]}/{' '.join(body[1:])}" if len(body) > 1 else body[0]
        if draw < 0.88:
            return rng.choice([f"6{d(2)} {d(3)} {d(3)}", f"7{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(2, '123456789')} {d(2)} {d(2)} {d(2)}", f"8 (9{d(2)}) {d(3)}-{d(2)}-{d(2)}", f"9{d(4)} {d(5)}", f"({d(2, '123456789')}) 9{d(4)}-{d(4)}", f"{d(3, '123456789')} {d(3)} {d(3)}", f"{d(4, '123456789')} {d(4)}"])
        numbers = "zero one two three four five six seven eight nine".split()
        spoken = [rng.choice([*numbers, "oh"]) for _ in range(rng.randint(8, 11))]
        if rng.random() < 0.3:
            spoken[rng.randrange(len(spoken) - 1)] = rng.choice(["double", "triple"])
        return rng.choice([" ", " ", ", ", "-"]).join(spoken)

    def shape(self) -> str:
        """A code of no particular format."""
        rng = self.rng
        letters = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(rng.choice([0, 0, 1, 1, 2, 2, 3])))
        groups = [_digits(rng, rng.choice([2, 3, 3, 4, 4, 5, 6])) for _ in range(rng.choice([1, 2, 2, 3, 3, 4]))]
        if len(groups) == 1:
            groups = [_digits(rng, rng.randint(6, 11))]
        code = letters + rng.choice(["", "", "-", " "] if letters else [""]) + rng.choice(["-", "-", " ", ".", "/"]).join(groups)
        return code + ("".join(rng.choice("ABCKLMTX") for _ in range(rng.choice([1, 1, 2]))) if rng.random() < 0.15 else "")

    def identity(self) -> tuple[str, str]:
        """A phrase with an identity number, and the number."""
        rng, d = self.rng, functools.partial(_digits, self.rng)
        up = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPRSTXYZ") for _ in range(n))
        social = rng.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", d(9), f"{d(3)}.{d(2)}.{d(4)}"])
        formats = [
            (("SSN", "social security number", "social", "social security no.", "soc"), social), (("SSN", "my social"), social), (("insurance number", "national insurance", "NI number", "nino"), rng.choice([f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", f"{up(2)}{d(6)}{up(1)}"])), (("NHS", "NHS number"), f"{d(3)} {d(3)} {d(4)}"),
            (("DNI", "NIF", "dni número"), rng.choice([f"{d(8)}{up(1)}", f"{d(8)}-{up(1)}"])), (("NIE",), f"X{d(7)}{up(1)}"), (("PESEL",), d(11)), (("numéro de sécu", "sécurité sociale", "INSEE"), f"{rng.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}"), (("Ausweisnummer", "Personalausweis", "identity card", "ID card"), rng.choice([f"L{d(2)}{up(2)}{d(4)}", f"{up(1)}{d(8)}", f"{up(3)}{d(6)}", f"{up(2)} {d(4)} {d(3)}"])),
            (("tax id", "Steuer-ID", "tax number", "TIN", "Steuernummer"), rng.choice([f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(7)}", d(11), f"{d(3)}/{d(4)}/{d(4)}"])), (("CPF",), f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"), (("personnummer",), rng.choice([f"{d(6)}-{d(4)}", f"19{d(6)}-{d(4)}"])), (("BSN",), d(9)), (("SIN", "medicare"), f"{d(3)} {d(3)} {d(3)}"), (("Aadhaar",), f"{d(4)} {d(4)} {d(4)}"),
            (("passport", "passport no.", "passport number", "Reisepass", "pasaporte", "passport is"), rng.choice([d(9), f"{up(1)}{d(8)}", f"{up(2)}{d(7)}", f"{d(2)}{up(2)}{d(5)}", f"{up(1)} {d(7)}", f"{d(2)}{up(1)}{d(6)}"])), (("driver licence", "driving licence", "driver's license", "license number", "licence no."), rng.choice([f"{up(1)}{d(7)}", f"{up(1)}{d(3)}-{d(4)}-{d(4)}", f"{up(2)}{d(6)}", self.shape(), f"{d(8)}", f"{up(2)}{d(3)}-{d(4)}-{d(3)}"])),
            (("national ID", "identity number", "ID number", "citizen id", "ID no", "national id card"), rng.choice([self.shape(), d(10), f"{d(8)}-{d(4)}", f"{d(6)}-{d(7)}", d(12)])), (("identity card", "resident permit", "citizen card"), self.shape()),
        ]
        cues, number = rng.choice(formats)
        cue, number = rng.choice(cues), _leading(number, rng)
        if rng.random() < 0.08 and re.fullmatch(r"\d{3}-\d\d-\d{4}", social):
            return social, social
        return rng.choice([f"{cue} {number}", f"{cue} {number}", f"{cue}: {number}", f"{cue} ({number})", f"{cue} is {number}", f"{cue}, which is {number},", f"{number} ({cue})", f"{cue} = {number}", f"{cue} #{number}"]), number

    def address(self) -> str:
        rng, d = self.rng, functools.partial(_digits, self.rng)
        n = str(rng.randint(1, 300) if rng.random() < 0.8 else rng.randint(300, 9999)) + (rng.choice("abc") if rng.random() < 0.15 else "")
        name = rng.choice([rng.choice(_STREET_NAMES), rng.choice(_STREET_NAMES), _made_up(rng).title(), rng.choice(self.words).title(), rng.choice(self.given).title(), rng.choice(FAMILIES).title(), rng.choice(["5th", "42nd", "3rd", "21st", "West", "East"])])
        if rng.random() < 0.12:
            name += " " + rng.choice([_made_up(rng).title(), *_STREET_NAMES])
        city = rng.choice([rng.choice(_CITIES), rng.choice(_CITIES), _made_up(rng).title(), f"{rng.choice(['New', 'Port', 'Saint', 'Upper', 'Fort', 'West'])} {_made_up(rng).title()}", f"{_made_up(rng).title()} {rng.choice(['Bay', 'Falls', 'Springs', 'Heights', 'Hill', 'Park'])}"])
        post = d(5)
        draw = rng.random()
        if draw < 0.5:
            street = f"{n}{rng.choice([' ', ' ', ' ', ', '])}{rng.choice(['', '', '', '', 'North ', 'W ', 'Old '])}{name} {rng.choice(_STREETS)}" if rng.random() < 0.94 else f"{n} {rng.choice(['Broadway', 'The Mall', 'Strand'])}"
            street += rng.choice(["", "", "", f", apt {d(1)}", f", Apt. {d(2)}", f" Apt {d(2)}b", f", Flat {d(1)}", f" #{d(2)}", f", Suite {d(3)}"])
            code = f"{rng.choice('ABCDEGHLMNSW')}{rng.choice('ABEWNS')}{d(1)} {d(1)}{rng.choice('ABDEH')}{rng.choice('ABDEH')}"
            return street + rng.choice(["", "", f", {city}", f", {city}", f" {city}", f", {city} {post}", f", {city}, {rng.choice(_STATES)} {post}", f", {city} {code}", f", {post} {city}", f" in {city}" if rng.random() < 0.0 else f", {city}, {rng.choice(_STATES)}"])
        if draw < 0.6:
            unit = rng.choice(["Flat", "Apartment", "Building", "Unit", "Apt", "Suite", "House", "Block", "Villa"])
            return f"{unit} {rng.randint(1, 40)}{rng.choice(['', '', 'a', 'B'])}, {rng.choice(['', n + ' '])}{name} {rng.choice(_STREETS)}" + rng.choice(["", f", {city}", f", {city}", f", {city} {post}"])
        if draw < 0.78:
            ending = rng.choice(["straße", "strasse", "weg", "gasse", "platz", "allee", "damm", "ufer", "str.", "ring", "hang"])
            stem = rng.choice([_made_up(rng).title(), rng.choice(FAMILIES).title(), rng.choice("Haupt Bahnhof Garten Schul Berg Wald Linden Kirch Rosen Mühlen Markt".split())])
            street = rng.choice([f"{stem}{ending} {n}", f"{stem}{ending} {n}", f"{stem}er Straße {n}", f"Am {stem}{rng.choice(['berg', 'hang', 'bach', 'tor', 'feld'])} {n}", f"An der {stem} {n}", f"{stem}straat {n}", f"{stem}gatan {n}"])
            return street + rng.choice(["", f", {post} {city}", f", {post} {city}", f", {city}", f" in {post} {city}", f" {post} {city}"])
        if draw < 0.88:
            return f"{n}{rng.choice(['', ',', ' bis,'])} {rng.choice(['rue', 'avenue', 'boulevard', 'place', 'chemin', 'quai', 'impasse', 'Rue'])} {rng.choice(['', 'de ', 'du ', 'des ', 'de la ', 'la '])}{rng.choice([name, name + 's'])}" + rng.choice(["", f", {post} {city}", f", {city}", f" à {city}"])
        kind = rng.choice(["Calle", "Calle", "Avenida", "Plaza", "Paseo", "Via", "Viale", "Piazza", "Rua", "ul.", "C/", "Camino"])
        return f"{kind} {rng.choice(['', '', 'de ', 'del ', 'de la '])}{name}{rng.choice([' ', ', ', ' nº '])}{n}" + rng.choice(["", f", {rng.randint(1, 9)}º {rng.choice('ABCD')}", f", {rng.randint(1, 9)}o {rng.choice('ABCD')}", f", {rng.randint(1, 9)} {rng.choice('ABCD')}"]) + rng.choice(["", f", {post} {city}", f", {city}", f", {post} {city}"])

    def plain(self, slot: str) -> str:
        rng = self.rng
        if slot[0] == "d" and slot[1:].isdigit():
            return _digits(rng, int(slot[1:]))
        if slot == "code":
            return self.shape()
        kind = slot.lower()
        word = {"given": lambda: rng.choice(self.given), "handle": lambda: rng.choice(["", "the_", "its", "x"]) + rng.choice([rng.choice(self.given), _made_up(rng)]) + rng.choice(["_", "", ".", "-"]) + rng.choice([*self.words[:: 50], str(rng.randint(1, 9999))]), "word": lambda: rng.choice(self.words) if rng.random() < 0.9 else rng.choice(sorted(W.COMMON)), "made": lambda: self.family() if rng.random() < 0.2 else _made_up(rng), "title": lambda: rng.choice(self.capital), "road": lambda: rng.choice("street road lane view way drive court park hill place square close row".split()), "leet": lambda: rng.choice(self.words).translate(str.maketrans("eioas", "3105" + rng.choice("5s"))), "url": lambda: rng.choice(["https://", "http://", "www.", "https://www."]) + rng.choice(self.words) + "." + rng.choice(_TOPS) + "/" + rng.choice(["", "v/", "watch/", "p/1/"]) + "".join(rng.choice("abcdefhkmnw0123456789") for _ in range(rng.choice([4, 7, 8, 11])))}[kind]()
        return word.title() if slot[0].isupper() else word

    def sentences(self, count: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
        """Composed sentences with the spans in them."""
        rng = self.rng
        positive = {k: v.split("|") for k, v in POSITIVE.items()}
        negative = [t for t in NEGATIVE.split("|") if t]
        for k in range(count):
            template = rng.choice(positive[rng.choice([*KINDS, "name", "address"])]) if k % 2 else rng.choice(negative)
            lead, end = (rng.choice(_CONTEXT), rng.choice(_CONTEXT) if rng.random() < 0.5 else "") if len(template) > 12 else ("", "")
            template = (lead + " " if lead else "") + template
            if end:
                template += rng.choice([" ", ". ", "\n", "! "] if template[-1] not in ".!?" else [" "]) + end
            text, gold, at = "", [], 0
            for m in _SLOT.finditer(template):
                text += template[at : m.start()]
                slot, at = m[1], m.end()
                if slot == "id_number":
                    phrase, number = self.identity()
                    where = len(text) + phrase.index(number)
                    gold.append((where, where + len(number), slot))
                    text += phrase
                elif slot in KINDS:
                    value = getattr(self, slot)()
                    gold.append((len(text), len(text) + len(value), slot))
                    text += value
                else:
                    text += self.plain(slot)
            text += template[at:]
            change = rng.random()
            changed = text.lower() if change < 0.18 else text.upper() if change < 0.27 and "ß" not in text else text
            yield (changed if len(changed) == len(text) else text), [(a, b - (text[b - 1] == "."), k) for a, b, k in gold]


def _golden(batch: Batch, golds: list[list[tuple[int, int, str]]]) -> set[tuple[int, int, int]]:
    """(first token, last token, kind from 1) of the spans that are given by characters."""
    starts = {int(s): k for k, s in enumerate(batch.start)}
    stops = {int(s): k for k, s in enumerate(batch.start + batch.length)}
    out = set()
    for origin, gold in zip(batch.origin.tolist(), golds, strict=True):
        for a, b, kind in gold:
            if a + origin in starts and b + origin in stops:
                out.add((starts[a + origin], stops[b + origin], KINDS.index(kind) + 1))
    return out


class Examples:
    """Sentences as arrays: all spans with the places of their features, and which of them are right."""

    def __init__(self, sentences: list[tuple[str, list[tuple[int, int, str]]]], lists: Lists, seed: int):
        rng = np.random.default_rng(seed)
        def change(batch: Batch) -> None:
            # some given names and ordinary words are off the lists, as they will be in the data
            from murmur.llm.pii import _FLAGS

            bit = lambda name: 1 << _FLAGS.index(name)
            col = batch.col
            given = (batch.bits & bit("given")) > 0
            off = given & (rng.random(len(given)) < 0.2)
            batch.bits = np.where(off, batch.bits & ~bit("given"), batch.bits)
            known = np.where(off, col["known"] % 4, col["known"])
            fade = (known % 4 > 0) & (rng.random(len(given)) < 0.12)
            col["known"] = np.where(fade, known - known % 4, known)
            col["word_shape"] = np.where(off & (col["word_shape"] >= 32), col["word_shape"] - 4, col["word_shape"])
            # which endings are usual is known from other texts: for most family names, and for few other words
            self.gold = _golden(batch, [g for _, g in sentences])
            last = np.zeros(len(given), bool)
            for _, j, k in self.gold:
                if KINDS[k - 1] == "name":
                    last[j] = True
            chance = rng.random(len(given))
            familiar = (col["type"] == 0) & (rng.random(len(given)) < np.where(last, 0.01, np.where(known % 4 > 1, 0.6, 0.45)))
            batch.bits = np.where(familiar, batch.bits | bit("familiar"), batch.bits)
            usual = (col["type"] == 0) & (col["length"] > ENDING) & np.where(last, chance < 0.6, chance < 0.01)
            batch.bits = np.where(usual, batch.bits | bit("usual"), batch.bits)

        batch = Batch([t for t, _ in sentences], _Rows(lists), change)
        firsts, lasts, kinds, places = [], [], [], []
        for k, kind in enumerate(KINDS, 1):
            i, j, shape = batch.spans(kind, 0, batch.n)
            codes = np.stack(batch.placed(kind, batch.features(kind, i, j, shape)), axis=1)
            firsts.append(i)
            lasts.append(j)
            kinds.append(np.full(len(i), k))
            places.append(np.pad(codes, ((0, 0), (0, 32 - codes.shape[1])), constant_values=1 << BITS))
        self.first, self.last, self.kind, self.places = (np.concatenate(x) for x in (firsts, lasts, kinds, places))
        self.sentence = batch.text_of[self.first]
        edge = batch.col["type"] == 4
        inner = np.flatnonzero(~edge)
        self.sizes = np.bincount(batch.text_of[inner], minlength=len(sentences))
        begin = np.full(len(sentences), batch.n)
        np.minimum.at(begin, batch.text_of[inner], inner)
        self.begin = self.first - begin[self.sentence]
        self.end = self.last + 1 - begin[self.sentence]
        self.right = np.array([t in self.gold for t in zip(self.first.tolist(), self.last.tolist(), self.kind.tolist(), strict=True)])
        self.missed = sum(len(g) for _, g in sentences) - int(self.right.sum())


def _sum_by(values: np.ndarray, cell: np.ndarray, size: int) -> np.ndarray:
    """log of the sums of exp(values) by cell."""
    top = np.full(size, -np.inf)
    np.maximum.at(top, cell, values)
    base = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return base + np.log(np.bincount(cell, np.exp(values - base[cell]), size))


def expectations(ex: Examples, chosen: np.ndarray, weights: np.ndarray, follow: np.ndarray):
    """For the chosen sentences: their spans, how probable each is, and how often each kind is expected after each other."""
    number = np.full(len(ex.sizes), -1)
    number[chosen] = np.arange(len(chosen))
    spans = np.flatnonzero(number[ex.sentence] >= 0)
    s, a, b, k = number[ex.sentence[spans]], ex.begin[spans], ex.end[spans], ex.kind[spans]
    score = weights[ex.places[spans]].sum(axis=1)
    sizes = ex.sizes[chosen]
    m, most, K = len(chosen), int(sizes.max(initial=0)), len(KINDS) + 1
    by_end = np.argsort(b, kind="stable")
    end_at = np.searchsorted(b[by_end], np.arange(most + 2))
    by_begin = np.argsort(a, kind="stable")
    begin_at = np.searchsorted(a[by_begin], np.arange(most + 2))
    lse = lambda x: (t := x.max(axis=-1)) + np.log(np.exp(x - np.where(np.isfinite(t), t, 0.0)[..., None]).sum(axis=-1)) if x.size else x[..., 0]
    ahead = np.full((m, most + 1, K), -np.inf)
    ahead[:, 0, 0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        into = np.zeros(len(spans))
        for p in range(1, most + 1):
            top = ahead[:, p - 1, :] + follow[:, 0]
            ahead[:, p, 0] = np.logaddexp.reduce(top, axis=1)
            here = by_end[end_at[p] : end_at[p + 1]]
            if len(here):
                into[here] = np.logaddexp.reduce(ahead[s[here], a[here], :] + follow[:, k[here]].T, axis=1)
                ahead[:, p, 1:] = _sum_by(into[here] + score[here], s[here] * K + k[here], m * K).reshape(m, K)[:, 1:]
        whole = np.logaddexp.reduce(ahead[np.arange(m), sizes, :], axis=1)
        behind = np.full((m, most + 2, K), -np.inf)
        behind[np.arange(m), sizes, :] = 0.0
        moved = np.zeros((K, K))
        for p in range(most - 1, -1, -1):
            begun = np.full((m, K), -np.inf)
            begun[:, 0] = np.where(p < sizes, behind[:, p + 1, 0], -np.inf)
            here = by_begin[begin_at[p] : begin_at[p + 1]]
            if len(here):
                begun[:, 1:] = _sum_by(score[here] + behind[s[here], b[here], k[here]], s[here] * K + k[here], m * K).reshape(m, K)[:, 1:]
            step = follow[None, :, :] + begun[:, None, :]
            value = np.logaddexp.reduce(step, axis=2)
            inside = p < sizes
            behind[inside, p, :] = value[inside]
            moved += np.exp(ahead[inside, p, :, None] + step[inside] - whole[inside, None, None]).sum(axis=0)
        chance = np.exp(np.minimum(0.0, into + score + behind[s, b, k] - whole[s]))
    return spans, chance, moved


def _moves(ex: Examples, chosen: np.ndarray) -> np.ndarray:
    """How often each kind follows each other in the right readings."""
    K = len(KINDS) + 1
    out = np.zeros((K, K))
    by: dict[int, list[tuple[int, int, int]]] = {}
    for n in np.flatnonzero(ex.right):
        by.setdefault(int(ex.sentence[n]), []).append((int(ex.begin[n]), int(ex.end[n]), int(ex.kind[n])))
    for c in chosen.tolist():
        at, last = 0, 0
        for a, b, k in sorted(by.get(c, ())):
            if a > at:
                out[last, 0] += 1
                out[0, 0] += a - at - 1
                last = 0
            out[last, k] += 1
            at, last = b, k
        left = int(ex.sizes[c]) - at
        if left > 0:
            out[last, 0] += 1
            out[0, 0] += left - 1
    return out


@functools.lru_cache(maxsize=4)
def fit(count: int = 12_000, epochs: int = 6, rate: float = 0.25, l2: float = 2e-3, seed: int = 11, batch: int = 500, vocabulary: str = VOCABULARY) -> Model:
    """Weights by stochastic gradient steps of the conditional likelihood, with a rate for each coordinate."""
    sentences = list(Composer(seed, vocabulary).sentences(count))
    ex = Examples(sentences, Lists(W.GIVEN | frozenset("may will mark rose jack joy dawn hope grace bill frank sunny ivy".split()), W.COMMON, frozenset(), frozenset(), *frequent_words(vocabulary)), seed)
    rng = np.random.default_rng(seed)
    size, K = 1 << BITS, len(KINDS) + 1
    weights, squares = np.zeros(size + 1), np.full(size + 1, 1e-2)
    follow, follow_squares = np.zeros((K, K)), np.full((K, K), 1e-2)
    for epoch in range(epochs):
        order = rng.permutation(len(sentences))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            spans, chance, moved = expectations(ex, chosen, weights, follow)
            off = ex.right[spans] - chance
            live = np.abs(off) > 1e-5
            gradient = np.bincount(ex.places[spans[live]].ravel(), np.repeat(off[live], ex.places.shape[1]), size + 1)
            touched = np.flatnonzero(gradient)
            touched = touched[touched < size]
            g = gradient[touched] - l2 * weights[touched]
            squares[touched] += g * g
            weights[touched] += rate * g / np.sqrt(squares[touched])
            g = _moves(ex, chosen) - moved - l2 * follow
            g[0, 0] = 0.0
            follow_squares += g * g
            follow += rate * g / np.sqrt(follow_squares)
            follow[0, 0] = 0.0
    weights[size] = 0.0
    return Model(weights[:size].astype(np.float32), follow)
