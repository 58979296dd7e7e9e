"""Word lists and spelling tables. All of these are fixed values: results depend on them."""

from __future__ import annotations

# fixed values: legal forms and honorifics that a core name leaves out
LEGAL_FORMS = (
    "inc incorporated corp corporation co company companies "
    "llc llp lp ltd limited plc pvt private pte pllc pc "
    "the opc l c p pa "
    "sarl sas sasu sa eurl sci snc scop scm selarl earl "
    "gie cie ste societe ets etablissements "
    "gmbh ag kg bv nv srl spa sl oy ab "
    "mr mrs ms messrs shri_"
).split()

# fixed values: long legal words of which misspellings count too
LONG_LEGAL_WORDS = "private limited company corporation incorporated enterprises_ societe etablissements".split()

# fixed values: states of the US
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca",
    "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
    "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh",
    "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
    "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}

# fixed values: address words
ADDRESS_WORDS = {
    "street": "st", "str": "st", "road": "rd", "avenue": "av", "ave": "av", "avn": "av",
    "boulevard": "bd", "blvd": "bd", "bld": "bd", "boul": "bd", "drive": "dr", "lane": "ln",
    "court": "ct", "place": "pl", "pce": "pl", "parkway": "pkwy", "highway": "hwy",
    "square": "sq", "terrace": "ter", "circle": "cir", "trail": "trl", "freeway": "fwy",
    "expressway": "expy", "route": "rte", "rt": "rte", "suite": "ste", "apartment": "apt",
    "floor": "fl", "flr": "fl", "building": "bldg", "north": "n", "south": "s", "east": "e",
    "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
    "mount": "mt", "fort": "ft", "junction": "jct", "jn": "jct", "opposite": "opp",
    "near": "nr", "market": "mkt", "nagar": "ngr", "colony": "clny", "sector": "sec",
    "sect": "sec", "phase": "ph", "chowk": "chk", "number": "no", "num": "no",
    "saint": "st", "sainte": "ste", "post": "po",
    "rue": "r", "chemin": "ch", "che": "ch", "impasse": "imp", "allee": "all",
    "faubourg": "fbg", "fg": "fbg", "cours": "crs", "quai": "qu", "qua": "qu",
}

# fixed values: address words that carry nothing
ADDRESS_FILLER = "cdp city of the de du des la le les d l and cedex unit urban".split()

# fixed values: ordinal words
ORDINALS = {
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5",
    "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10",
}

# fixed values: abbreviations in names
NAME_WORDS = {
    "intl": "international", "mfg": "manufacturing", "svcs": "services", "svc": "service",
    "srvs": "services", "techs": "technologies", "sys": "systems", "mgmt": "management",
    "assoc": "associates", "assocs": "associates", "bros": "brothers", "dept": "department",
    "natl": "national", "univ": "university", "hosp": "hospital", "ctr": "center",
    "centre": "center", "cntr": "center", "ind": "industries", "inds": "industries",
    "st": "saint", "ste": "sainte", "shri": "shree", "sri": "shree",
}

# fixed values: Brahmic consonants and vowels by the last part of their Unicode names
CONSONANTS = {
    "KA": "k", "KHA": "kh", "GA": "g", "GHA": "gh", "NGA": "ng", "CA": "ch", "CHA": "chh",
    "JA": "j", "JHA": "jh", "NYA": "ny", "TTA": "t", "TTHA": "th", "DDA": "d", "DDHA": "dh",
    "NNA": "n", "TA": "t", "THA": "th", "DA": "d", "DHA": "dh", "NA": "n", "NNNA": "n",
    "PA": "p", "PHA": "f", "BA": "b", "BHA": "bh", "MA": "m", "YA": "y", "YYA": "y",
    "RA": "r", "RRA": "r", "RRRA": "r", "LA": "l", "LLA": "l", "LLLA": "l", "VA": "v",
    "WA": "v", "SHA": "sh", "SSA": "sh", "SA": "s", "HA": "h", "QA": "q", "KHHA": "kh",
    "GHHA": "gh", "ZA": "z", "DDDHA": "r", "RHA": "r", "FA": "f", "YYYA": "y",
}
VOWELS = {
    "A": "a", "AA": "a", "I": "i", "II": "i", "U": "u", "UU": "u", "E": "e", "EE": "e",
    "AI": "ai", "O": "o", "OO": "o", "AU": "au", "VOCALIC R": "ri", "VOCALIC RR": "ri",
    "VOCALIC L": "li", "CANDRA E": "e", "CANDRA O": "o", "SHORT E": "e", "SHORT O": "o",
    "CANDRA A": "a", "OE": "o", "AAY": "ai",
}
SCRIPTS = "DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA".split()

# fixed values: loan words as romanised, and their English spelling
LOAN_WORDS = {
    "praivet": "private", "privet": "private", "praivat": "private", "prayvet": "private",
    "limited": "limited", "limitad": "limited", "limitd": "limited", "limitid": "limited",
    "elaelapi": "llp", "elelpi": "llp", "elalpi": "llp", "elelapi": "llp",
    "kampani": "company", "kanpani": "company", "kampni": "company",
    "prodakts": "products", "sarvises": "services", "sarvisej": "services", "sarvisij": "services",
    "tekanolaji": "technology", "teknolaji": "technology", "tek": "tech",
    "indastris": "industries", "indastriz": "industries", "intarneshanal": "international",
    "entarprisej": "enterprises", "entarprises": "enterprises", "enterprises": "enterprises",
    "marketing": "marketing", "maarketing": "marketing", "marketinga": "marketing",
    "menejment": "management", "menejament": "management", "solyushans": "solutions",
    "trading": "trading", "treding": "trading", "tredars": "traders",
    "shri": "shree", "sri": "shree", "shree": "shree",
    "pra": "private", "li": "limited", "limitet": "limited", "limirrad": "limited",
    "praibhet": "private", "piraivet": "private", "praivarr": "private", "pvt": "private",
    "estet": "estate", "faundeshan": "foundation", "enarji": "energy", "pavar": "power",
    "aiti": "it", "kansalting": "consulting", "infotek": "infotech", "venchars": "ventures",
    "fud": "food", "fuds": "foods", "impeks": "impex", "kansaltents": "consultants",
    "sistams": "systems", "devalapars": "developers", "kanstrakshan": "construction",
    "kanstrakshans": "constructions", "bildars": "builders", "indastrij": "industries",
    "investament": "investment", "investaments": "investments", "lojistiks": "logistics",
    "lajistiks": "logistics", "prodyusar": "producer", "hospitailiti": "hospitality",
    "projekts": "projects", "helthakeyar": "healthcare", "siti": "city", "mainejament": "management",
    "midiya": "media", "yunivarsal": "universal", "nyu": "new", "kansaltensi": "consultancy",
    "infrastrakchar": "infrastructure", "bijanes": "business", "propartij": "properties",
    "teknolojij": "technologies", "teknoloji": "technology", "ist": "east", "egro": "agro",
    "eksaports": "exports", "praim": "prime", "entarapraijej": "enterprises", "riyal": "real",
    "grin": "green", "keyar": "care", "dijital": "digital", "istarn": "eastern",
}
