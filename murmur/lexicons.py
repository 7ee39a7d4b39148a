"""Word lists. Each is a parameter of the operators that use it; the lists here are small defaults of our own."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Largest word list that operators hold as literals or broadcast.
MOST_WORDS = 500_000


def words(table: DataFrame, column: str = "word", most: int = MOST_WORDS) -> list[str]:
    """The distinct words of a table, sorted. A table of more than ``most`` words raises an error, as it would be broadcast."""
    rows = table.select(column).where(f"{column} is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column}: more than {most} words")
    return sorted(r[0] for r in rows)


def pairs(table: DataFrame, key: str, value: str, most: int = MOST_WORDS) -> dict[str, float]:
    """A small table as a dictionary, bounded like ``words``."""
    rows = table.select(key, value).where(f"{key} is not null and {value} is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{key}: more than {most} rows")
    return dict(sorted((r[0], r[1]) for r in rows))


def frame(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(list(rows), columns)


# Our own lexicon: words of video talk with their class (noun, verb, adjective, adverb).
NOUNS = "audio background battery beginner breakdown budget cable camera canvas caption chapter class clip club colour comment cook detail draft drone edge editor ending file film filter forum friend garden guide guitar hand hat idea intro joint kettle keyboard kit label lamp laptop layer length lens level light list logo loom meal mic microphone minute music neighbour notebook option outline oven paint part pedal phone player problem project question recipe recording router row sample scene screen script section sense setting shot slide sound speaker step story string student studio table tablet teacher thread thumbnail time timeline title tool track trick tripod tutorial upload user version video view viewer voice watch week window word work workbench year".split()
VERBS = "animate ask balance build change clean cover crash cut draw edit explain export feel fix follow group help learn light look love make mask mix mount move pack paint pause plan play prune record render replay ruin run say season sew shade show skip solder sort start stop stretch study subscribe sync talk teach tell test thank think trim try tune upload use wait waste watch wire work write".split()
ADJECTIVES = "amaze balance bright brilliant calm clear clumsy crisp dull flat fresh friendly generous good great happy harsh helpful honest kind loud lovely muddy new nice noise old perfect poor practical quick quiet relax sharp short slow small smart smooth super tidy tinny useful warm weak".split()
ADVERBS = "absolutely fairly finally honestly pretty quite rather really somehow surprisingly too truly very".split()
LEXICON: tuple[tuple[str, str], ...] = tuple(sorted({(w, p) for p, ws in (("n", NOUNS), ("v", VERBS), ("a", ADJECTIVES), ("r", ADVERBS)) for w in ws}))
# Forms that no rule reaches: form, lemma, class.
IRREGULAR: tuple[tuple[str, str, str], ...] = (
    ("best", "good", "a"), ("better", "good", "a"), ("built", "build", "v"), ("children", "child", "n"), ("drew", "draw", "v"), ("felt", "feel", "v"), ("lit", "light", "v"), ("made", "make", "v"), ("ran", "run", "v"),
    ("said", "say", "v"), ("taught", "teach", "v"), ("thought", "think", "v"), ("told", "tell", "v"), ("worse", "bad", "a"), ("worst", "bad", "a"), ("wrote", "write", "v"),
)

# Closed-class words and their tags, and ordered patterns of the rule tagger.
FUNCTION_TAGS: dict[str, str] = {
    **dict.fromkeys("the a an this that these those some any each".split(), "DT"),
    **dict.fromkeys("and or but yet".split(), "CC"),
    **{"is": "VBZ", "am": "VBP", "are": "VBP", "was": "VBD", "were": "VBD", "be": "VB", "been": "VBN", "being": "VBG"},
    **{"have": "VBP", "has": "VBZ", "had": "VBD", "having": "VBG", "do": "VBP", "does": "VBZ", "did": "VBD", "doing": "VBG"},
    **dict.fromkeys("will would can could should".split(), "MD"),
    **dict.fromkeys("in on at of for with from by about into".split(), "IN"), "to": "TO",
    **dict.fromkeys("i you he she it we they".split(), "PRP"), **dict.fromkeys("my your our".split(), "PRP$"),
    **dict.fromkeys("very really so too also not".split(), "RB"),
    **{"more": "JJR", "most": "JJS", "best": "JJS", "good": "JJ", "great": "JJ", "bad": "JJ", "love": "VB", "hate": "VB"},
}
TAG_PATTERNS: tuple[tuple[str, str], ...] = (
    (r"^-?[0-9]+([.,][0-9]+)*$", "CD"), (r"^#[\w-]+$", "HT"), (r"^@[\w-]+$", "NN"), (r"^https?$", "URL"), (r"n't$", "RB"), (r"('ll|'re|'ve|'d|'m|'s)$", "MD"), (r"ing$", "VBG"), (r"(edly|ed)$", "VBN"), (r"ies$", "NNS"),
    (r"(sses|shes|ches|xes|zes)$", "NNS"), (r"s$", "NNS"), (r"(ation|ition|ment|ness|ity|ance|ence|ship|hood|ism|ist)$", "NN"), (r"(ful|ous|ive|able|ible|al|ic|ish|less|ary)$", "JJ"), (r"ly$", "RB"), (r"(er|est)$", "JJR"), (r"^i$", "PRP"),
)
COARSE: dict[str, str] = {
    **dict.fromkeys("NN NNS NNP NNPS".split(), "Noun"), **dict.fromkeys("VB VBG VBD VBN VBP VBZ MD".split(), "Verb"), **dict.fromkeys("JJ JJR JJS".split(), "Adjective"), **dict.fromkeys("RB RBR RBS WRB FW".split(), "Adverb"),
    **dict.fromkeys("PRP PRP$ WP WP$ EX".split(), "Pronoun"), **dict.fromkeys("DT WDT PDT".split(), "Determiner"), "IN": "Preposition", "CC": "Conjunction", "CD": "Number", "UH": "Interjection", "TO": "Particle", "RP": "Particle", "SYM": "Symbol",
}

# Words folded into one for similarity.
SYNONYMS: dict[str, str] = {
    **dict.fromkeys("poor bad terrible awful horrible dreadful atrocious worst useless broken wrong hate disappointed waste".split(), "bad"),
    **dict.fromkeys("good great excellent nice helpful useful amazing best love fantastic solid clear".split(), "good"),
    **dict.fromkeys("audio sound sounds sounding hear heard hearing listening audible noise noisy volume".split(), "audio"),
}
OPINION = ("bad", "good")

# Gazetteer of our own: well-known names by type; a user passes a larger table. A word or phrase stands once.
_SINGLE = {
    "Organization": "microsoft google apple amazon meta facebook openai netflix youtube tiktok instagram linkedin spotify adobe nvidia intel samsung sony tesla ibm oracle reddit twitter shopify autodesk siemens nokia huawei bmw volvo toyota honda nasa bbc cnn panasonic philips airbnb uber paypal visa dropbox",
    "Technology": "python javascript java typescript rust golang ruby php swift kotlin perl haskell html css sql bash react angular django flask pandas numpy pytorch tensorflow linux ubuntu windows macos android ios chrome firefox docker kubernetes git github jupyter excel api json xml llm ai gpu cpu ram ssd usb hdmi wifi bluetooth mic microphone headset headphones webcam monitor speaker amplifier equalizer",
    "Product": "chatgpt gemini claude midjourney siri alexa photoshop illustrator premiere lightroom audacity vlc obs iphone ipad macbook airpods kindle playstation xbox whatsapp telegram discord zoom slack trello notion evernote",
    "Location": "london paris berlin madrid rome lisbon amsterdam dublin vienna moscow tokyo seoul shanghai beijing delhi mumbai sydney melbourne toronto boston seattle denver chicago miami dallas houston america europe asia africa australia canada china india japan brazil mexico france germany italy spain russia egypt kenya nigeria california texas florida scotland wales ireland england",
}
_PHRASES = {
    "Product": ["davinci resolve", "obs studio", "after effects", "premiere pro", "final cut pro", "visual studio code", "google maps", "microsoft word"],
    "Organization": ["amazon web services", "google cloud", "stanford university", "harvard university", "european space agency"],
    "Technology": ["machine learning", "deep learning", "neural network", "large language model", "computer vision", "artificial intelligence"],
    "Location": ["new york", "los angeles", "san francisco", "united states", "united kingdom", "south korea", "new zealand"],
}
GAZETTEER: tuple[tuple[str, str], ...] = tuple((phrase, kind) for kind in _SINGLE for phrase in [*_SINGLE[kind].split(), *_PHRASES[kind]])
# Titles, endings of organisations, words after and before a name, words that are never one, and brands that
# are written with capitals inside.
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof", "professor", "sir", "madam")
ORG_SUFFIXES = ("inc", "ltd", "llc", "corp", "corporation", "company", "university", "labs", "studio", "group", "foundation")
SPEECH_VERBS = ("said", "says", "explained", "wrote", "thinks", "posted", "made")
PERSON_CUES = ("by", "with", "follow", "asked", "interviewed")
LOCATION_CUES = ("near", "around", "outside", "across", "visited")
NAME_STOPS = tuple(
    "the this that these those a an i we they he she it you your my our their his her its but and or so if when what why how there here also just very really would could should will can do does did is are was were be been being have has had not no yes please thanks thank hi hello hey anyone everyone nobody something nothing everything one two three first second next last new old good great bad love best better sure ok okay yeah oh well now then from for to with of into onto about over under again between during against within without upon per via while until unless whether".split()
)
MIXED_CASE_BRANDS = ("iPhone", "iPad", "iPod", "macOS", "eBay", "iTunes", "GitHub", "GitLab", "YouTube", "JavaScript", "TypeScript", "ChatGPT", "iMessage", "MacBook")
CALENDAR = tuple("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split())
#: A public vocabulary whose whole small-letter words count as everyday words, where the file is there.
VOCABULARY = os.environ.get("MURMUR_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def everyday_words(path: str = VOCABULARY) -> tuple[str, ...]:
    """Words that are hardly ever names: the lexicon's, days and months, and those that a public vocabulary holds in small letters."""
    own = {w for w, _ in LEXICON} | {form for form, _, _ in IRREGULAR} | set(CALENDAR)
    if os.path.exists(path):
        with open(path, "rb") as lines:
            tokens = (base64.b64decode(line.split()[0]) for line in lines)
            own |= {t[1:].decode() for t in tokens if t[:1] == b" " and len(t) > 2 and t[1:].isalpha() and t[1:].islower()}
    return tuple(sorted(own))


# An inventory of senses: word, rank, sense, gloss, cue words.
SENSES: tuple[tuple[str, int, str, str, str], ...] = tuple(
    (word, rank, f"{word}.{name}", gloss, cues)
    for word, senses in {
        "bank": [("depository", "a financial institution that accepts deposits and lends money", "money account loan app mobile card deposit"), ("slope", "sloping land beside a body of water", "river water shore sitting fishing stream"), ("reserve", "a supply held in reserve for later use", "blood data supply power")],
        "block": [("piece", "a solid piece of something with flat sides", "wood stone concrete build"), ("street", "a part of a town between streets", "walk city corner house"), ("stop", "to stop something from passing or happening", "user account road spam ads")],
        "book": [("volume", "a written work printed on pages bound together", "read author page chapter library"), ("reserve", "to arrange something in advance", "ticket hotel flight table room"), ("record", "a record of accounts of a business", "accounts tax money keep")],
        "boot": [("shoe", "a shoe that covers the whole foot and lower leg", "leather wear foot hiking pair"), ("start", "to start a computer and load its system", "computer system windows disk usb"), ("trunk", "the space of a car for luggage", "car luggage back open")],
        "bug": [("insect", "a small insect", "garden bite insect leaf summer"), ("fault", "a fault in a computer program", "code software fix crash report"), ("listen", "a hidden microphone for listening in", "spy room phone secret")],
        "cache": [("memory", "fast memory that keeps data for reuse", "browser memory data clear server"), ("store", "a hidden store of things", "hidden weapons food found treasure")],
        "cell": [("biology", "the smallest unit of a living thing", "blood biology body dna tissue"), ("phone", "a telephone that is carried about", "phone call number text"), ("room", "a small room for a prisoner", "prison jail locked guard")],
        "charge": [("price", "the price asked for goods or a service", "price money pay fee cost card"), ("load", "to fill a battery with electric energy", "battery phone cable power overnight"), ("accuse", "to accuse somebody of a crime", "court crime police murder")],
        "chip": [("circuit", "a small piece of silicon with an electronic circuit", "silicon processor computer gpu circuit"), ("food", "a thin slice of fried potato", "potato eat salt bag fish"), ("damage", "a small piece broken off a surface", "glass paint tooth broken")],
        "clip": [("film", "a short piece of film", "render video watch label bonus"), ("fastener", "a small device that holds things", "paper hold hair"), ("cut", "to cut off with scissors or shears", "nails hedge coupon scissors")],
        "crack": [("split", "a narrow split in a surface", "wall screen glass floor"), ("break", "to break a code or protection", "password code software game"), ("drug", "a strong form of cocaine", "cocaine drug smoke")],
        "date": [("day", "a day of the month or year", "calendar day month release deadline"), ("meeting", "a romantic meeting of two people", "dinner girlfriend romantic night"), ("fruit", "the sweet fruit of a palm", "fruit palm sweet eat")],
        "deck": [("ship", "a floor of a ship or an outdoor platform", "ship boat wood patio"), ("cards", "a pack of playing cards", "cards shuffle magic draw play"), ("slides", "a set of slides for a talk", "slides presentation pitch stream")],
        "dock": [("harbour", "a place where ships load and unload", "ship boat harbour port"), ("bar", "a bar of icons on a computer screen", "icon mac screen app"), ("station", "a stand that connects a portable device", "laptop usb station monitor")],
        "drop": [("liquid", "a small amount of liquid", "water rain oil blood"), ("fall", "to fall or let fall", "phone floor ball height"), ("release", "the first release of new goods or music", "album beat bass merch")],
        "fire": [("flame", "burning with flames and heat", "burn smoke wood camp forest"), ("dismiss", "to dismiss somebody from work", "job boss employee worker"), ("shoot", "to shoot with a weapon", "gun shot bullet weapon")],
        "fold": [("bend", "to bend something over on itself", "paper dough cloth origami shirt"), ("quit", "to give up a hand or a business", "poker cards company hand"), ("pen", "a pen for sheep", "sheep farm flock")],
        "ground": [("earth", "the surface of the earth", "soil dirt plant fell lay"), ("electric", "a connection of a circuit with the earth", "wire circuit voltage electric"), ("reason", "a reason for an action or belief", "reason legal basis appeal")],
        "jam": [("food", "fruit boiled with sugar", "fruit sugar bread toast strawberry"), ("traffic", "a crowd of vehicles that can't move", "traffic road cars stuck"), ("music", "to play music together without preparation", "band guitar session play music")],
        "key": [("keyboard", "a button of a keyboard or an instrument", "keyboard shortcut press piano"), ("licence", "a code that unlocks software or data", "license digits code crashed api"), ("lock", "a metal piece that opens a lock", "door lock car house")],
        "light": [("brightness", "the brightness that falls on a scene or a room", "lighting lamp room bright scene exposure"), ("weight", "of little weight and easy to carry", "carry heavy weight camera tripod"), ("ignite", "to set something on fire", "candle fire match cigarette")],
        "match": [("game", "a contest between players or teams", "game team football win score play"), ("fit", "to be equal or go well with", "colour pair compare same font"), ("stick", "a small stick that makes a flame", "fire light candle stick")],
        "matter": [("affair", "a subject or situation to deal with", "subject important discuss problem"), ("substance", "that which has mass and takes up space", "physics mass energy dark atom"), ("count", "to be of importance", "really does care much")],
        "note": [("writing", "a short piece of writing", "write paper take read notebook"), ("music", "a single sound of music", "piano sing play scale music"), ("notice", "to notice or mention", "please important mention")],
        "orange": [("fruit", "a round juicy citrus fruit", "juice fruit eat peel"), ("colour", "the colour between red and yellow", "colour red yellow paint shade")],
        "pale": [("light", "light in colour", "skin colour blue face"), ("stake", "a stake of a fence or a limit", "fence beyond wood stake")],
        "park": [("garden", "a public garden in a town", "trees walk bench kids green"), ("car", "to leave a vehicle for a time", "car garage street lot")],
        "plant": [("living", "a living thing that grows in the earth", "grow garden water leaf seed soil"), ("factory", "a factory or a station for power", "factory power nuclear workers"), ("put", "to put firmly in a place", "feet seed bomb evidence")],
        "pool": [("water", "a basin of water for swimming", "swim water summer dive"), ("game", "a game with balls on a table with pockets", "balls table cue pockets"), ("share", "a shared supply of money or things", "money share resources thread")],
        "port": [("harbour", "a place where ships come to land", "ship harbour sea city"), ("socket", "a socket or number for a connection", "usb network server cable open"), ("wine", "a strong sweet wine", "wine drink bottle glass")],
        "press": [("push", "to push steadily against", "button key hold click shortcut"), ("news", "newspapers and those who write them", "news journalist free media release"), ("machine", "a machine that prints or squeezes", "print machine paper coffee")],
        "record": [("capture", "to capture sound or pictures on a medium", "voice track screen audio camera"), ("best", "the best result ever reached", "fastest beat world"), ("disc", "a disc with music on it", "vinyl album player music")],
        "reserve": [("keep", "to keep for a later use", "table seat ticket hotel"), ("land", "land that is set aside for animals", "nature wildlife animals forest"), ("calm", "a quiet manner that shows little feeling", "quiet shy manner feelings")],
        "rock": [("stone", "a mass of hard stone", "stone mountain climb hard"), ("music", "a kind of loud popular music", "band guitar music song concert"), ("sway", "to move gently to and fro", "chair baby cradle boat")],
        "run": [("move", "to move fast on foot", "fast race marathon legs morning"), ("work", "to work or be carried out as a program", "code program server app script"), ("manage", "to be in charge of", "company business channel shop")],
        "scale": [("size", "the relative size or extent", "large size map model grow"), ("music", "a row of notes in order", "notes piano guitar major minor"), ("weigh", "a device that weighs things", "weight kitchen grams weigh")],
        "score": [("points", "the number of points gained", "points game team goal win test"), ("music", "the written or composed music of a film", "film composer orchestra music"), ("cut", "to cut a line into a surface", "knife dough cut line surface")],
        "spot": [("place", "a particular place", "place favourite sit parking location"), ("mark", "a small round mark", "skin stain dirt colour"), ("see", "to notice or catch sight of", "mistake see difference notice")],
        "spring": [("season", "the season after winter", "winter summer flowers april garden"), ("coil", "a coil that returns to its shape", "metal coil mattress tension"), ("water", "a place where water comes from the ground", "water hot source mountain")],
        "stack": [("pile", "a pile of things", "pile books wood boxes"), ("computing", "a list where the last in is the first out, or the layers of software", "memory overflow code function web software")],
        "state": [("condition", "the way something is", "mind condition current solid"), ("region", "a part of a country with its own government", "government law california texas country"), ("say", "to say clearly", "clearly opinion fact facts")],
        "table": [("furniture", "a piece of furniture with a flat top", "chair sit dinner wood kitchen"), ("data", "figures set out in rows and columns", "rows columns data sql excel comparison")],
        "train": [("railway", "a line of railway cars", "station railway ticket ride travel"), ("teach", "to teach or practise a skill", "model dog gym skill practice")],
        "track": [("recording", "a recorded line of sound or voice in a mix", "voice record music audio mixing subtitle"), ("path", "a path or lane for racing or walking", "lane drive race road")],
        "wave": [("water", "a moving ridge of water", "sea ocean surf beach"), ("signal", "a regular movement of sound, light or radio", "sound light radio frequency"), ("hand", "to move the hand as a greeting", "hand hello goodbye crowd")],
        "well": [("good", "in a good way", "very done works explained made"), ("water", "a deep hole from which water is taken", "water deep dig bucket oil"), ("health", "in good health", "feel sick get soon")],
        "window": [("opening", "an opening in a wall with glass", "glass house room open curtain"), ("screen", "a part of a computer screen with a program, or the system named so", "keyboard shortcut screen desktop tab close program"), ("time", "a short time in which something can be done", "time opportunity hours launch")],
        "word": [("language", "the smallest unit of language with a meaning", "language meaning write spell sentence"), ("promise", "a promise", "keep give promise trust"), ("program", "a program to write texts", "microsoft document excel file")],
        "work": [("task", "effort to do or make something, or a job", "job hard office boss hours"), ("function", "to function as it should", "does fine code button fix"), ("art", "a thing that an artist made", "art artist painting music")],
        "level": [("volume", "the loudness or strength of a signal", "balance audio sound loud mic"), ("rank", "a rank of skill or difficulty", "beginner advanced skill section")],
        "shot": [("film", "a continuous piece of film by one camera", "camera close plan list film"), ("attempt", "an attempt to do something", "give try best")],
        "paint": [("material", "colour that is spread over a surface", "canvas brush set colour"), ("act", "to make a picture with colours", "draw portrait hands")],
        "wire": [("connect", "to connect with electric cable", "pedal board cable solder"), ("metal", "a thin thread of metal", "fence metal bend")],
    }.items()
    for rank, (name, gloss, cues) in enumerate(senses, 1)
)
