"""Words that speak for or against personal information. All are general; a user passes more given names as a table."""

from __future__ import annotations

# Roles of words, in small letters.
ROLES: dict[str, frozenset[str]] = {
    "at": frozenset("at arroba ät chez".split()),
    "dot": frozenset("dot punkt punto point ponto".split()),
    "phone_cue": frozenset("call phone text whatsapp ring tel telephone telefon telefono teléfono téléphone landline mobile cell cellphone handy sms dial reach hotline fax contact anrufen ruf rufen an appelez appeler llama llamar llámame chiama bel belt signal telegram viber".split()),
    "id_cue": frozenset("ssn social passport reisepass passeport pasaporte licence license permit identity identification id dni nif nie pesel ausweis ausweisnummer personalausweis insurance nino nhs sécu secu insee tax steuer steuernummer cpf bsn cnp sin tin aadhaar pan personnummer national security citizen carte cédula cedula curp codice fiscale medicare social-security versicherungsnummer".split()),
    "code_cue": frozenset("model invoice order code firmware version serial ticket score iso room part chapter build sku item tracking page level article product case receipt article reference ref batch episode season release patch error isbn issue edition volume booking confirmation transaction".split()),
    "place_cue": frozenset("at to in live lives living near address house office meet visit deliver ship shipping parcel send sent moved street come mail package nach an wohne adresse dirección domicile habite".split()),
    "name_cue": frozenset("thanks thank to regards signed is from with by ask dear greetings danke merci gracias name named mr mrs ms dr met i am hi hello yours sincerely love cheers gruß grüße an für von de bei avec und and".split()),
    "number": frozenset("zero oh one two three four five six seven eight nine double triple null eins zwei drei vier fünf sechs sieben acht neun cero uno dos tres cuatro cinco seis siete ocho nueve deux trois quatre cinq sept huit neuf".split()),
    "street": frozenset("street st avenue ave road rd lane ln crescent mews court ct drive dr close square sq terrace boulevard blvd gardens row walk way place pl grove parkway pkwy hill rise view highway hwy circle cir trail alley quay wharf park green broadway straße strasse str platz allee weg gasse ring damm ufer".split()),
    "prefix": frozenset("rue avenue boulevard place chemin quai impasse allée route calle plaza avenida paseo carrera via viale piazza corso camino rua travessa praça ulica ul am im auf an".split()),
    "unit": frozenset("flat apartment apt suite unit building bldg floor room block villa house tower piso appartement wohnung".split()),
    "particle": frozenset("van von de del der den la le di da du dos das bin ibn al el ter ten zu y e af mac st".split()),
    "title": frozenset("mr mrs ms miss dr prof professor sir madam dame herr frau monsieur madame señor señora don doña captain uncle aunt".split()),
    "extension": frozenset("x ext extension durchwahl poste".split()),
    "abbreviation": frozenset("st ave rd ln dr blvd apt bldg str no nr ul pl sq ct hwy pkwy mt ste ext tel mr mrs ms prof".split()),
    "region": frozenset("al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc uk usa nsw vic qld london paris berlin madrid rome vienna dublin sydney toronto boston chicago".split()),
}
#: Endings of street names that are one word.
STREET_ENDINGS = ("straße", "strasse", "weg", "gasse", "platz", "allee", "damm", "ufer", "straat", "laan", "gatan", "vägen", "veien", "gade")
# Function words of some languages, which are hardly ever part of a name.
COMMON = frozenset(
    "the a an and or but not no yes of in on at to from by for with about after before over under this that these those it its is are was were be been being has have had do does did can could will would should may might must shall "
    "i you he she we they me him us them my your his our their who what which when where why how more most much many some any all both each every other another same such only own too very just now then here there also again still never always please thanks thank new old first last next great every good bad best "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "der die das ein eine und oder aber nicht auch mit von den dem ist sind war für auf aus nach zum zur im am vom dass wenn wie was wer nur sehr mehr ich er sie es wir ihr mein kann soll hat haben le les un une des et est pas pour que qui dans avec sur plus mais je tu il elle nous vous los las el es por para con del mi muy no se lo su che non di sono della".split()
)
#: Frequent given names of many languages, beside the list that is given.
GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony steven andrew kevin brian george edward ronald jason ryan jacob nicholas eric jonathan justin brandon benjamin samuel alexander patrick "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy sandra ashley emily michelle amanda melissa stephanie rebecca laura helen rachel janet maria heather diane olivia julie victoria anna emma christine "
    "hans peter wolfgang klaus jürgen dieter stefan andreas jonas felix ursula monika petra sabine katrin lena hannah pierre jean michel philippe nicolas julien camille chloé juan carlos josé luis javier miguel antonio alejandro carmen lucía marta elena isabel giuseppe giovanni marco luca francesca giulia "
    "joão pedro tiago rafael beatriz piotr tomasz marek agnieszka katarzyna jan tomáš eva ivan dmitri sergei olga tatiana natalia lars erik anders johan karl astrid mikko mehmet mustafa ayşe fatma ali omar hassan mohammed ibrahim layla aisha fatima "
    "raj rahul amit sanjay priya anita deepa wei ming hiroshi takashi yuki akiko minho kwame kofi ama chidi ngozi thabo".split()
)
