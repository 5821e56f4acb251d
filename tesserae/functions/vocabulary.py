"""Realistic values, module by module, as column expressions.

An entry is a short rule, whose first word says how it is drawn:
  a|b|c               one of these words; `enum a|b|c` declares them as an enum
  = text              a template: {module.method} is another entry, # a digit, ? a capital, * a small letter,
                      ~ a small letter or digit, & a hex digit, ^ a capital or digit of vehicle numbers
  chars c n           n characters of one such class        many n entry sep   n values of an entry, joined
  int a b             a whole number                        float a b d        a number with d decimals
  base r a b          a whole number written in base r      roman a b          and in roman numerals
  money a b           text with two decimals                big a b            a bigint
  date a b            days from the clock                   dates n a b        n of them, in order
  list n a b          an array of numbers                   pair a b c d       a tuple of two numbers
  pick a|b            one of these numbers                  flag               a coin
  object k=a|b ..     aligned lists, of which one place is picked; `k:long=` are numbers
  check rule text     a template completed by the check digits of the rule

Builders take options: min, max, digits (numbers), count, length, characters, from_, to, years, days, ref_date (epoch
milliseconds or a datetime), and the name of any entry that a template refers to, snake-cased (first_name="Ada").
Kinds are those of the values, so schemas convert with their hints. A locale overlays rules by name.
All word lists are this project's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EmptyRangeError, NoActiveScopeError, UnknownKindError
from ..plans.bounds import epoch_ms
from ..plans.compiler import ProduceContext, WordProducer
from ..plans.kinds import Schema
from ..plans.kinds import registry as T
from .distributions import constant_array, one_of
from .draws import Stream

RULES: dict[str, dict[str, str]] = {
    "airline": {
        "aircraftType": "enum narrowbody|regional|widebody", "airline": "object name=Northwind Air|Blue Coast|Sunline|Polar Wing iataCode=NW|BC|SL|PW", "airplane": "object name=Falcon 200|Heron 9|Swift Jet iataTypeCode=F20|H09|SWJ",
        "airport": "object name=Harbour Field|Lakeside|Mesa Verde|Stonebridge iataCode=HBF|LKS|MSV|STB", "flightNumber": "= ####", "recordLocator": "chars ? 6", "seat": "= {_.row}{_.seatLetter}",
    },
    "animal": {
        "bear": "brown bear|polar bear|sun bear|sloth bear", "bird": "robin|heron|kestrel|wren|magpie", "cat": "tabby|manx|siamese|bobtail", "cetacean": "orca|beluga|narwhal|fin whale", "cow": "angus|jersey|highland|hereford", "crocodilia": "caiman|gharial|alligator",
        "dog": "beagle|collie|boxer|whippet", "fish": "trout|carp|perch|herring", "horse": "arabian|shire|fjord|mustang", "insect": "ant|bee|cicada|mantis", "lion": "barbary lion|cape lion|masai lion", "petName": "Biscuit|Moss|Pepper|Scout|Juno",
        "rabbit": "lop|rex|dutch|angora", "rodent": "mouse|vole|beaver|marmot", "snake": "adder|boa|cobra|python", "type": "bear|bird|cat|cetacean|cow|crocodilia|dog|fish|horse|insect|lion|rabbit|rodent|snake",
    },
    "book": {
        "author": "= {person.fullName}", "format": "paperback|hardcover|ebook|audiobook", "genre": "mystery|history|poetry|science|travel", "publisher": "Lantern Press|Oak House|Tideway|Quarry Lane", "series": "The Long Road|Harbour Lights|Iron Season",
        "title": "= The {word.adjective} {word.noun}",
    },
    "color": {
        "cssSupportedFunction": "enum rgb|rgba|hsl|hsla|hwb|cmyk|lab|lch|color", "cssSupportedSpace": "enum sRGB|display-p3|rec2020|a98-rgb|prophoto-rgb", "human": "red|green|blue|amber|violet|teal|ivory", "space": "sRGB|CIELAB|HSL|CMYK",
        "rgb.text": "= rgb({_.byte}, {_.byte}, {_.byte})", "rgb.channels": "list 3 0 255", "cmyk.text": "= cmyk({_.percent}%, {_.percent}%, {_.percent}%, {_.percent}%)", "cmyk.channels": "list 4 0 1", "hsl.text": "= hsl({_.degree}deg {_.percent}% {_.percent}%)", "hsl.channels": "list 3 0 1",
        "hwb.text": "= hwb({_.degree} {_.percent}% {_.percent}%)", "hwb.channels": "list 3 0 1", "lab.text": "= lab({_.percent}% {_.percent} {_.percent})", "lab.channels": "list 3 0 1", "lch.text": "= lch({_.percent}% {_.percent} {_.degree})", "lch.channels": "list 3 0 1",
        "colorByCSSColorSpace.text": "= color({color.cssSupportedSpace} 0.# 0.# 0.#)", "colorByCSSColorSpace.channels": "list 3 0 1",
    },
    "commerce": {
        "department": "Books|Garden|Music|Toys|Tools|Sports", "isbn": "check isbn 978#########", "price": "money 1 1000", "product": "Chair|Lamp|Mug|Shirt|Table|Kettle", "productAdjective": "Compact|Elegant|Rustic|Sleek|Sturdy", "productDescription": "= {commerce.productAdjective} {commerce.product} made of {commerce.productMaterial}",
        "productMaterial": "bamboo|cotton|granite|steel|wool", "productName": "= {commerce.productAdjective} {commerce.productMaterial} {commerce.product}", "upc": "check upc ###########",
    },
    "company": {
        "buzzAdjective": "scalable|seamless|robust|agile", "buzzNoun": "platforms|networks|models|markets", "buzzPhrase": "= {company.buzzVerb} {company.buzzAdjective} {company.buzzNoun}", "buzzVerb": "deliver|enable|streamline|grow", "catchPhrase": "= {company.catchPhraseAdjective} {company.catchPhraseDescriptor} {company.catchPhraseNoun}",
        "catchPhraseAdjective": "Adaptive|Open|Shared|Balanced", "catchPhraseDescriptor": "modular|local|global|neutral", "catchPhraseNoun": "archive|forecast|interface|toolset", "name": "= {person.lastName} {_.legal}",
    },
    "database": {"collation": "utf8_bin|utf8_general_ci|ascii_bin|latin1_bin", "column": "id|name|status|created_at|updated_at", "engine": "InnoDB|MyISAM|MEMORY|ARCHIVE", "mongodbObjectId": "chars & 24", "type": "int|varchar|date|blob|double"},
    "datatype": {"boolean": "flag"},
    "date": {
        "anytime": "date -3650 3650", "between": "date -365 365", "birthdate": "date -29200 -6570", "future": "date 1 365", "past": "date -365 -1", "recent": "date -1 0", "soon": "date 0 1", "betweens": "dates 3 -365 365",
        "month": "January|February|March|April|May|June|July|August|September|October|November|December", "timeZone": "Europe/Lisbon|Asia/Tokyo|America/Lima|Africa/Cairo|Australia/Perth", "weekday": "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday",
    },
    "finance": {
        "accountName": "Checking|Savings|Investment|Credit", "accountNumber": "chars # 8", "amount": "money 0 1000", "bic": "= ??????##", "bitcoinAddress": "= 1~~~~~~~~~~~~~~~~~~~~~~~~~~~", "creditCardCVV": "chars # 3", "creditCardIssuer": "visa|mastercard|discover|jcb", "creditCardNumber": "check luhn 4##############",
        "currency": "object code=EUR|JPY|MXN|CHF name=Euro|Yen|Mexican Peso|Swiss Franc symbol=€|¥|$|CHF numericCode=978|392|484|756", "currencyCode": "EUR|JPY|MXN|CHF", "currencyName": "Euro|Yen|Mexican Peso|Swiss Franc", "currencyNumericCode": "978|392|484|756", "currencySymbol": "€|¥|$|CHF", "ethereumAddress": "= 0x&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&",
        "iban": "check iban ##################", "litecoinAddress": "= L~~~~~~~~~~~~~~~~~~~~~~~~~~", "pin": "chars # 4", "routingNumber": "check aba ########", "transactionDescription": "= {finance.transactionType} of {finance.amount} {finance.currencyCode}", "transactionType": "deposit|payment|withdrawal|invoice",
    },
    "food": {
        "adjective": "crispy|fresh|smoky|tender", "description": "= {food.adjective} {food.meat} with {food.vegetable}", "dish": "Paella|Ramen|Stew|Risotto|Tagine", "ethnicCategory": "Basque|Korean|Peruvian|Thai", "fruit": "apple|fig|mango|plum|quince", "ingredient": "flour|butter|basil|rice|oil", "meat": "beef|lamb|duck|pork",
        "spice": "cumin|saffron|thyme|sumac", "vegetable": "beet|leek|spinach|turnip",
    },
    "git": {"branch": "= {hacker.verb}-{hacker.noun}", "commitDate": "= {date.weekday} {_.hour}:{_.minute}:{_.minute}", "commitEntry": "= commit {git.commitSha}", "commitMessage": "= {hacker.verb} {hacker.adjective} {hacker.noun}", "commitSha": "chars & 40"},
    "hacker": {"abbreviation": "TCP|SQL|RAM|CSS|API", "adjective": "virtual|wireless|optical|open-source", "ingverb": "parsing|indexing|hashing|copying", "noun": "driver|port|matrix|sensor", "phrase": "= Try {hacker.ingverb} the {hacker.abbreviation} {hacker.noun}", "verb": "parse|index|hash|copy"},
    "image": {
        "avatar": "= https://avatars.example/{string.uuid}.png", "avatarGitHub": "= https://avatars.example/u/########", "dataUri": "= data:image/svg+xml;charset=UTF-8,{color.human}", "personPortrait": "= https://portraits.example/{person.sexType}/##.jpg", "url": "= https://images.example/{_.pixels}/{_.pixels}",
        "urlPicsumPhotos": "= https://photos.example/seed/~~~~~~/{_.pixels}/{_.pixels}", "urlLoremFlickr": "= https://flickr.example/{_.pixels}/{_.pixels}\\?lock=####",
    },
    "internet": {
        "displayName": "= {person.firstName}{_.byte}", "domainName": "= {internet.domainWord}.{internet.domainSuffix}", "domainSuffix": "com|org|net|io", "domainWord": "= {word.adjective}-{word.noun}", "email": "= {internet.username}@{internet.domainName}", "emoji": "😀|🚀|🌿|🎲|🐳", "exampleEmail": "= {internet.username}@example.com",
        "httpMethod": "enum GET|POST|PUT|DELETE|PATCH", "httpStatusCode": "pick 200|201|204|301|400|404|500|503", "ip": "= {internet.ipv4}", "ipv4": "= {_.byte}.{_.byte}.{_.byte}.{_.byte}", "ipv6": "= &&&&:&&&&:&&&&:&&&&:&&&&:&&&&:&&&&:&&&&", "jwt": "= ~~~~~~~~~~.~~~~~~~~~~~~~~~~~~~~.~~~~~~~~~~", "jwtAlgorithm": "HS256|RS256|ES256|PS256",
        "mac": "= &&:&&:&&:&&:&&:&&", "password": "chars ~ 15", "port": "int 0 65535", "protocol": "enum http|https", "url": "= {internet.protocol}://{internet.domainName}", "userAgent": "= Mozilla/5.0 (X11; Linux x86_64) Build/###.#", "username": "= {person.firstName}_{person.lastName}##",
    },
    "location": {
        "buildingNumber": "chars # 3", "cardinalDirection": "North|East|South|West", "city": "Aldermere|Brightport|Casco|Dunmore|Eastvale", "continent": "Africa|Antarctica|Asia|Europe|North America|Oceania|South America", "country": "Chile|Finland|Ghana|Nepal|Samoa", "countryCode": "CL|FI|GH|NP|WS", "county": "Essex|Kerry|Marin|Fife", "direction": "North|Northeast|East|Southeast|South|Southwest|West|Northwest",
        "language": "object name=Finnish|Quechua|Twi alpha2=fi|qu|tw alpha3=fin|que|twi", "latitude": "float -90 90 4", "longitude": "float -180 180 4", "nearbyGPSCoordinate": "pair -90 90 -180 180", "ordinalDirection": "Northeast|Northwest|Southeast|Southwest", "postalAddress": "= {location.streetAddress}, {location.city}", "secondaryAddress": "= Apt. ###",
        "state": "Bavaria|Ohio|Punjab|Jalisco", "street": "= {person.lastName} Street", "streetAddress": "= {location.buildingNumber} {location.street}", "timeZone": "Europe/Oslo|Africa/Accra|Asia/Manila|America/Bogota", "zipCode": "chars # 5",
    },
    "lorem": {
        "lines": "many 2 lorem.sentence \n", "paragraph": "many 3 lorem.sentence  ", "paragraphs": "many 2 lorem.paragraph \n", "sentence": "= {lorem.words}.", "sentences": "many 2 lorem.sentence  ", "slug": "many 3 lorem.word -", "text": "= {lorem.sentences}", "word": "lorem|ipsum|dolor|sit|amet|elit|sed|magna", "words": "many 3 lorem.word  ",
    },
    "music": {"album": "= {word.adjective} {word.noun}s", "artist": "= The {word.noun}s", "genre": "folk|jazz|techno|blues|opera", "songName": "= {word.verb} the {word.noun}"},
    "number": {"bigInt": "big 0 999999999999999", "binary": "base 2 0 1", "float": "float 0 1 2", "hex": "base 16 0 15", "int": "int 0 9007199254740991", "octal": "base 8 0 7", "romanNumeral": "roman 1 3999"},
    "person": {
        "bio": "= {person.jobTitle}, {word.noun} enthusiast", "firstName": "Ada|Bruno|Chidi|Dalia|Emre|Freya|Goran|Hana", "fullName": "= {person.firstName} {person.lastName}", "gender": "Woman|Man|Agender|Nonbinary", "jobArea": "Data|Finance|Research|Security", "jobDescriptor": "Lead|Senior|Junior|Chief", "jobTitle": "= {person.jobDescriptor} {person.jobArea} {person.jobType}",
        "jobType": "Analyst|Engineer|Planner|Architect", "lastName": "Abara|Bianchi|Castro|Dimitrov|Eriksen|Fofana", "middleName": "Jo|Lee|Ray|Sky", "prefix": "Dr.|Mr.|Ms.|Mx.", "sex": "female|male", "sexType": "enum female|male", "suffix": "Jr.|Sr.|PhD|MD",
        "zodiacSign": "Aries|Taurus|Gemini|Cancer|Leo|Virgo|Libra|Scorpio|Sagittarius|Capricorn|Aquarius|Pisces",
    },
    "phone": {"imei": "check luhn ##############", "number": "= ###-###-####"},
    "science": {"chemicalElement": "object symbol=H|C|Fe|Au name=Hydrogen|Carbon|Iron|Gold atomicNumber:long=1|6|26|79", "unit": "object name=metre|second|kelvin|mole symbol=m|s|K|mol"},
    "string": {
        "alpha": "chars * 1", "alphanumeric": "chars ~ 1", "binary": "= 0b{_.bit}", "fromCharacters": "chars * 1", "hexadecimal": "= 0x&", "nanoid": "chars ~ 21", "numeric": "chars # 1", "octal": "= 0o{_.octet}", "sample": "chars ~ 10", "symbol": "!|?|%|&|*|+|@", "ulid": "= 01##^^^^^^^^^^^^^^^^^^^^^^",
        "uuid": "= &&&&&&&&-&&&&-4&&&-a&&&-&&&&&&&&&&&&",
    },
    "system": {
        "commonFileExt": "pdf|png|txt|csv", "commonFileName": "= {word.noun}.{system.commonFileExt}", "commonFileType": "text|image|audio|video", "cron": r"= # # \* \* #", "directoryPath": "/usr/bin|/var/log|/opt/lib|/etc/ssl", "fileExt": "json|xml|zip|wav", "fileName": "= {word.noun}_{word.noun}.{system.fileExt}",
        "filePath": "= {system.directoryPath}/{system.fileName}", "fileType": "text|image|font|model", "mimeType": "text/plain|image/png|application/json|audio/ogg", "networkInterface": "= eth#", "semver": "= #.#.#",
    },
    "vehicle": {"bicycle": "Cruiser|Gravel|Tandem|Folding", "color": "= {color.human}", "fuel": "diesel|electric|hybrid|gasoline", "manufacturer": "Aster|Corvane|Meridian|Tarn", "model": "Arrow|Dune|Tempo|Vale", "type": "coupe|estate|van|minivan", "vehicle": "= {vehicle.manufacturer} {vehicle.model}", "vin": "check vin ^^^^^^^^0^^^^####", "vrm": "= ??##???"},
    "word": {
        "adjective": "amber|brisk|calm|dusty|eager|faint", "adverb": "boldly|gently|quickly|rarely", "conjunction": "and|but|while|unless", "interjection": "ah|hey|oops|wow", "noun": "anchor|bridge|candle|delta|ember|forest", "preposition": "above|beneath|toward|within", "sample": "= {word.noun}", "verb": "carry|drift|follow|gather",
        "words": "many 2 word.sample  ",
    },
}

_PRIVATE = {
    "byte": "int 0 255", "percent": "int 0 100", "degree": "int 0 360", "bit": "0|1", "octet": "0|1|2|3|4|5|6|7", "legal": "Ltd|Group|and Sons|Inc", "row": "int 1 35", "seatLetter": "A|B|C|D|E|F", "pixels": "int 100 3000",
    "hour": "00|01|02|03|04|05|06|07|08|09|10|11|12|13|14|15|16|17|18|19|20|21|22|23", "minute": "00|05|10|15|20|25|30|35|40|45|50|55",
}
LOCALES: dict[str, dict[str, str]] = {
    "en": {},
    "de": {
        "date.month": "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember", "date.weekday": "Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag", "person.firstName": "Anke|Bernd|Clara|Dieter|Elif", "person.lastName": "Albrecht|Becker|Krause|Vogel|Yilmaz",
        "location.city": "Altfurt|Grünwalde|Neustein", "location.cardinalDirection": "Nord|Ost|Süd|West", "color.human": "rot|grün|blau|gelb", "internet.domainSuffix": "de|com|org",
    },
    "fr": {
        "date.month": "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre", "date.weekday": "lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche", "person.firstName": "Amina|Bastien|Chloé|Driss|Élodie", "person.lastName": "Aubert|Benali|Carpentier|Moreau|Nguyen",
        "location.city": "Belmont-sur-Mer|Clairval|Vieuxpont", "location.cardinalDirection": "nord|est|sud|ouest", "color.human": "rouge|vert|bleu|jaune", "internet.domainSuffix": "fr|com|org",
    },
}
_URI, _EMAIL = {"format": "uri"}, {"format": "email"}
HINTS: dict[str, dict[str, str]] = {
    **{f"image.{m}": _URI for m in ("avatar", "avatarGitHub", "dataUri", "personPortrait", "url", "urlPicsumPhotos")}, "internet.url": _URI, "internet.email": _EMAIL, "internet.exampleEmail": _EMAIL, "internet.domainName": {"format": "hostname"},
    "internet.ipv4": {"format": "ipv4"}, "internet.ipv6": {"format": "ipv6"}, "string.uuid": {"format": "uuid"}, "system.filePath": {"format": "uri-reference"}, "database.mongodbObjectId": {"pattern": "^[0-9a-fA-F]{24}$"},
    "finance.bic": {"pattern": "^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"}, "finance.creditCardCVV": {"pattern": "^[0-9]{3,4}$"},
}
_CLASSES = {"#": "0123456789", "?": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "*": "abcdefghijklmnopqrstuvwxyz", "~": "abcdefghijklmnopqrstuvwxyz0123456789", "&": "0123456789abcdef", "^": "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"}
_PIECE = r"\{[^}]+\}|\\.|([#?*~&^])\1*|[^{\\#?*~&^]+"  # of a template
_DAY = 86_400_000
# fixed values: the letters of vehicle numbers as digits, and the weights of their places
_VIN_FROM, _VIN_TO, _VIN_WEIGHTS = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789", (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
_HEADS = {"=", "object", "int", "float", "base", "roman", "money", "big", "flag", "date", "dates", "list", "pair", "pick", "chars", "many", "check", "enum"}


def names() -> list[str]:
    return [f"{m}.{k}" for m, entries in RULES.items() for k in entries]


def rule_of(name: str, locale: dict[str, str] | None = None) -> str:
    module, _, method = name.partition(".")
    return _PRIVATE[method] if module == "_" else (locale or {}).get(name) or RULES[module][method]


def head_of(name: str, locale: dict[str, str] | None = None) -> str:
    head = rule_of(name, locale).split(" ")[0]
    return head if head in _HEADS else "word"


def words_of(name: str, locale: dict[str, str] | None = None) -> list[str]:
    """The list of an entry that is one of some words."""
    return rule_of(name, locale).removeprefix("enum ").split("|")


def _place(letters: str, u: Column) -> Column:
    return F.floor(u * F.lit(float(len(letters)))).cast("int")


def _letter(letters: str, place: Column) -> Column:
    return F.substring(F.lit(letters), place + 1, F.lit(1))


def _characters(letters: str, count: int, stream: Stream) -> list[Column]:
    return [_letter(letters, _place(letters, stream.u(i))) for i in range(count)]


def _whole(a: int, b: int, u: Column) -> Column:
    if a > b:
        raise EmptyRangeError(f"no whole number from {a} to {b}", minimum=a, maximum=b)
    return F.least(F.lit(b).cast("long"), (F.lit(float(a)) + F.floor(u * F.lit(float(b - a + 1)))).cast("long"))


def _real(a: float, b: float, digits: int, u: Column) -> Column:
    if a > b:
        raise EmptyRangeError(f"no number from {a} to {b}", minimum=a, maximum=b)
    return F.round(F.lit(float(a)) + u * F.lit(float(b) - float(a)), digits)


def _checked(rule: str, text: str, stream: Stream) -> Column:
    """A template of characters alone, with its check digits: a sum over what each place adds, by the number drawn for it."""
    drawn = []  # the letters of a place, and which of them it is; or a letter that is given
    for i, piece in enumerate(re.finditer(_PIECE, text)):
        letters, below = _CLASSES.get(piece[0][0]), stream.under(str(i))
        drawn += [(letters, _place(letters, below.u(j))) for j in range(len(piece[0]))] if letters else [(c, None) for c in piece[0]]
    chars = [F.lit(letters) if place is None else _letter(letters, place) for letters, place in drawn]
    n = len(drawn)

    def total(adds: Callable[[int, str], int]) -> Column:
        out, given = [], 0
        for k, (letters, place) in enumerate(drawn):
            table = [adds(k, c) for c in letters]
            if place is None:
                given += table[0]
            elif table == [table[1] * d for d in range(len(table))]:
                out.append(place * F.lit(table[1]))
            else:
                out.append(F.get(constant_array(table), place))
        return sum(out, F.lit(given))

    last = lambda total: F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")
    if rule == "luhn":
        doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
        return F.concat(*chars, last(total(lambda k, c: doubled[int(c)] if (n - k) % 2 else int(c))))
    if rule in ("isbn", "upc", "aba"):
        cycle = {"isbn": (1, 3), "upc": (3, 1), "aba": (3, 7, 1)}[rule]
        return F.concat(*chars, last(total(lambda k, c: int(c) * cycle[k % len(cycle)])))
    if rule == "iban":  # the number, the country's letters as digits and two zeros, modulo 97
        rest = F.lit(98) - F.pmod(total(lambda k, c: int(c) * pow(10, n - k + 5, 97)) + F.lit(131400), F.lit(97))
        return F.concat(F.lit("DE"), F.lpad(rest.cast("string"), 2, "0"), *chars)
    if rule == "vin":
        digit = F.pmod(total(lambda k, c: int(c.translate(str.maketrans(_VIN_FROM, _VIN_TO))) * _VIN_WEIGHTS[k]), F.lit(11)).cast("int")
        return F.concat(*chars[:8], _letter("0123456789X", digit), *chars[9:])
    raise UnknownKindError(f"no check digits {rule}", kind=rule)


def _roman(n: Column) -> Column:
    places = [("", "M", "MM", "MMM")] + [tuple(p.translate(str.maketrans("ivx", s)) for p in ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")) for s in ("CDM", "XLC", "IVX")]
    return F.concat(*[F.get(F.lit(list(p)), (F.floor(n / F.lit(10 ** (3 - k))) % F.lit(10)).cast("int")) for k, p in enumerate(places)])


class Draw:
    """Values of entries for one stream, clock, locale and set of options."""

    def __init__(self, clock: int, locale: dict[str, str] | None = None, options: dict | None = None):
        self.clock, self.locale, self.options, self.used = clock, locale or {}, options or {}, set()

    def option(self, name: str, default):
        self.used.add(name)
        return self.options.get(name, default)

    def given(self, entry: str) -> Column | None:
        """What an option named after an entry fixes it to."""
        key = re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), entry.split(".", 1)[1])
        if entry.startswith("_.") or key not in self.options:
            return None
        self.used.add(key)
        value = self.options[key]
        return value if isinstance(value, Column) else F.lit(value)

    def template(self, text: str, stream: Stream) -> Column:
        parts = []
        for i, piece in enumerate(re.finditer(_PIECE, text)):
            token, below = piece[0], stream.under(str(i))
            if token[0] == "{":
                fixed = self.given(token[1:-1])
                parts.append((fixed if fixed is not None else self.value(token[1:-1], below)).cast("string"))
            elif token[0] == "\\":
                parts.append(F.lit(token[1]))
            elif token[0] in _CLASSES:
                parts += _characters(_CLASSES[token[0]], len(token), below)
            else:
                parts.append(F.lit(token))
        return F.concat(*parts)

    def moments(self, a: int, b: int) -> tuple[int, int]:
        """The range in epoch milliseconds, by the options that dates take."""
        now = epoch_ms(self.option("ref_date", self.clock))
        days = self.option("days", None)
        if days is None and "years" in self.options:
            days = 365 * self.option("years", 1)
        if days is not None:
            a, b = (a if a >= 0 else -days, b if b <= 0 else days)
        low, high = self.option("from_", None), self.option("to", None)
        return (now + a * _DAY if low is None else epoch_ms(low)), (now + b * _DAY if high is None else epoch_ms(high))

    def value(self, name: str, stream: Stream) -> Column:
        rule = rule_of(name, self.locale)
        head, _, rest = rule.partition(" ")
        args = rest.split(" ")
        number = lambda k: float(self.option(("min", "max")[k], args[k + (head == "base")]))
        match head:
            case "=":
                return self.template(rest, stream)
            case "enum":
                return one_of(rest.split("|"), stream.u())
            case "pick":
                return one_of([int(x) for x in rest.split("|")], stream.u()).cast("long")
            case "object":
                u = stream.u()
                return F.struct(*[one_of(words.split("|"), u).cast(t).alias(k) for k, t, words in _fields(rest)])
            case "int":
                return _whole(int(number(0)), int(number(1)), stream.u())
            case "big":
                return _whole(int(number(0)), int(number(1)), stream.u()).cast("decimal(38,0)")
            case "base":
                return F.lower(F.conv(_whole(int(number(0)), int(number(1)), stream.u()).cast("string"), 10, int(args[0])))
            case "roman":
                low, high = int(number(0)), int(number(1))
                if low < 1 or high > 3999:
                    raise EmptyRangeError("roman numerals go from 1 to 3999", minimum=low, maximum=high)
                return _roman(_whole(low, high, stream.u()))
            case "float":
                return _real(number(0), number(1), int(self.option("digits", args[2])), stream.u())
            case "money":
                digits = int(self.option("digits", 2))
                return F.concat(F.lit(self.option("symbol", "")), F.format_string(f"%.{digits}f", _real(number(0), number(1), digits, stream.u())))
            case "flag":
                return stream.u() < F.lit(float(self.option("probability", 0.5)))
            case "date":
                return F.timestamp_millis(_whole(*self.moments(int(args[0]), int(args[1])), stream.u()))
            case "dates":
                low, high = self.moments(int(args[1]), int(args[2]))
                return F.array_sort(F.array(*[F.timestamp_millis(_whole(low, high, stream.u(i))) for i in range(int(self.option("count", args[0])))]))
            case "list":
                return F.array(*[_real(float(args[1]), float(args[2]), 2, stream.u(i)) for i in range(int(args[0]))])
            case "pair":
                a, b, c, d = map(float, args)
                return F.struct(_real(a, b, 4, stream.u(0)).alias("_0"), _real(c, d, 4, stream.u(1)).alias("_1"))
            case "chars":
                letters = str(self.option("characters", _CLASSES[args[0]]))
                return F.concat(*(_characters(letters, int(self.option("length", args[1])), stream) or [F.lit("")]))
            case "many":
                n, entry, sep = re.match(r"(\d+) (\S+) (.*)", rest, re.S).groups()
                count = int(self.option("count", n))
                below = Draw(self.clock, self.locale)  # the count is this entry's alone
                return F.concat_ws(sep, *[below.value(entry, stream.under(str(i))) for i in range(count)])
            case "check":
                return _checked(args[0], args[1], stream)
        return one_of(rule.split("|"), stream.u())


def _fields(rest: str) -> list[tuple[str, str, str]]:
    """(name, type, words) of an object's rule."""
    return [(k.partition(":")[0], k.partition(":")[2] or "string", words) for k, words in (p.split("=") for p in re.split(r" (?=\w+(?::\w+)?=)", rest))]


def _schema_of(name: str, locale: dict[str, str]) -> tuple[Schema, str]:
    """The schema whose kind the entry's values have, and their type."""
    rule = rule_of(name, locale)
    head, _, rest = rule.partition(" ")
    match head:
        case "enum":
            return T.enum.uniform(rest.split("|")), "string"
        case "object":
            fields = _fields(rest)
            return T.object({k: T.number.integer() if t == "long" else T.string.as_(lambda c: F.lit("")) for k, t, _ in fields}), "struct<" + ",".join(f"{k}:{t}" for k, t, _ in fields) + ">"
        case "int" | "pick":
            return T.number(), "long"
        case "float":
            return T.number(), "double"
        case "big":
            return T.bigint.whereby(0, min=0), "decimal(38,0)"
        case "flag":
            return T.boolean(), "boolean"
        case "date":
            return T.date(), "timestamp"
        case "dates":
            return T.array(T.date()).whereby((0, 2**31 - 1)), "array<timestamp>"
        case "list":
            return T.array(T.number()).whereby(int(rest.split(" ")[0])), "array<double>"
        case "pair":
            return T.tuple([T.number(), T.number()]), "struct<_0:double,_1:double>"
    return T.string.whereby(0), "string"


def builder(name: str, locale: dict[str, str] | None = None) -> Callable[..., Schema]:
    def build(**options) -> Schema:
        schema, dtype = _schema_of(name, locale or {})
        if options:  # checked when the schema is built
            tried = Draw(0, locale, options)
            tried.value(name, Stream("", F.lit("0")))
            if unknown := sorted(set(options) - tried.used):
                raise TypeError(f"{name} has no option {', '.join(unknown)}")
        if head_of(name, locale) in ("word", "enum"):
            return schema.as_(WordProducer(tuple(words_of(name, locale))), dtype, **HINTS.get(name, {}))
        return schema.as_(lambda c: Draw(c.clock, locale, options).value(name, c.random), dtype, **HINTS.get(name, {}))

    return build


def draw(name: str, context: ProduceContext | None, **options) -> Column:
    """An entry's value within a producer, by its context."""
    if not isinstance(context, ProduceContext):
        raise NoActiveScopeError(f"{name} has a value only within a producer, which passes its context on")
    return Draw(context.clock, None, options).value(name, context.random)


_USE = {
    "string": lambda p, r: T.string.as_(p, r or "string"), "number": lambda p, r: T.number().as_(p, r or "double"), "date": lambda p, r: T.date().as_(p, r or "timestamp"), "boolean": lambda p, r: T.boolean().as_(p, r or "boolean"),
    "bigint": lambda p, r: T.bigint.as_(p, r or "decimal(38,0)"), "opaque": lambda p, r: T.opaque(p, r),
}


def vocabulary_extension(locale: str | dict[str, str] = "en") -> Callable:
    """For Registry.extend: T.vocab.<module>.<method>(**options), and T.vocab.use.<kind>(produce). A locale is a name or rules by entry, which overlay the others."""
    if isinstance(locale, str) and locale not in LOCALES:
        raise UnknownKindError(f"no locale {locale}", kind=locale)
    rules = LOCALES[locale] if isinstance(locale, str) else locale
    if unknown := sorted(set(rules) - set(names())):
        raise UnknownKindError(f"no entry {', '.join(unknown)}", kind=unknown[0])

    def extend(_registry=None) -> dict:
        tree: dict = {}
        for name in names():
            at = tree
            *above, last = name.split(".")
            for a in above:
                at = at.setdefault(a, {})
            at[last] = builder(name, rules)
        tree["use"] = {k: (lambda make: lambda produce, returns=None: make(produce, returns))(make) for k, make in _USE.items()}
        return {"vocab": tree}

    return extend


vocabulary = vocabulary_extension()

__all__ = ["HINTS", "LOCALES", "RULES", "ProduceContext", "builder", "draw", "head_of", "names", "rule_of", "vocabulary", "vocabulary_extension", "words_of"]
