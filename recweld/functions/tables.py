"""Word lists of name and address normalisation. All values here are fixed values: results depend on them.

Tables map a canonical form to its variants (lower-case ASCII). Regions of further countries are given as a parameter of
the same form, see addresses.PlaceTables. Patterns are Java's.
"""

LEGAL_FORMS = {
    "inc": ["inc", "incorporated", "incorporation"],
    "corp": ["corp", "corporation", "corpn"],
    "co": ["co", "company", "cos", "compnay"],
    "ltd": ["ltd", "limited", "limted", "limitd", "ltda", "limirrd", "limitedd"],
    "pvt": ["pvt", "private", "pvte", "prvt", "praivet", "praibhet", "prayvet", "praivrr", "praivett"],
    "llc": ["llc"],
    "llp": ["llp"],
    "lp": ["lp"],
    "plc": ["plc"],
    "pc": ["pc"],
    "pllc": ["pllc"],
    "pa": ["pa"],
    "public": ["public", "pub"],
    "sarl": ["sarl"],
    "sas": ["sas", "sasu"],
    "sa": ["sa"],
    "eurl": ["eurl"],
    "snc": ["snc"],
    "sci": ["sci"],
    "scop": ["scop"],
    "gmbh": ["gmbh"],
    "ag": ["ag"],
    "bv": ["bv"],
    "nv": ["nv"],
    "srl": ["srl"],
    "spa": [],
    "kk": ["kk"],
    "oy": ["oy"],
    "ab": ["ab"],
}
LEGAL_FUZZY = {"private": "pvt", "limited": "ltd", "corporation": "corp", "incorporated": "inc", "company": "co"}
ALIAS_MARKERS = ["d/b/a", "d.b.a.", "dba:", "dba", "doing business as", "t/a", "trading as", "a/k/a", "aka", "also known as", "f/k/a", "formerly known as"]
HONORIFICS = ["m/s", "ms", "messrs", "shri", "sri", "shree", "smt", "dr", "mr", "mrs", "the", "ets", "etablissements", "le", "la", "les"]
TLDS = ["com", "net", "org", "in", "co", "co.in", "org.in", "net.in", "fr", "us", "biz", "info", "io", "uk", "co.uk", "de", "eu"]
HOMOGLYPHS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a"}
NULL_TOKENS = ["null", "n/a", "na", "none", "nil", "nan", "-", "--", "not available", "unknown", "n.a."]
ADDRESS_WORDS = {
    "st": ["street", "str", "saint", "ste", "sainte"],
    "rd": ["road"],
    "ave": ["avenue", "av", "avn", "aven"],
    "dr": ["drive", "drv"],
    "blvd": ["boulevard", "bd", "boul", "bld"],
    "ln": ["lane"],
    "pl": ["place", "plc"],
    "ct": ["court", "crt"],
    "cir": ["circle"],
    "hwy": ["highway"],
    "pkwy": ["parkway"],
    "ter": ["terrace"],
    "trl": ["trail"],
    "sq": ["square"],
    "cres": ["crescent"],
    "expy": ["expressway"],
    "mkt": ["market"],
    "n": ["north", "nord"],
    "s": ["south", "sud"],
    "e": ["east", "est"],
    "w": ["west", "ouest"],
    "apt": ["apartment", "appartement", "appt"],
    "fl": ["floor", "flr"],
    "bldg": ["building", "batiment", "bat"],
    "r": ["rue"],
    "imp": ["impasse"],
    "all": ["allee", "allees"],
    "ch": ["chemin"],
    "rte": ["route"],
    "crs": ["cours"],
    "chs": ["chaussee"],
    "qu": ["quai"],
    "sect": ["sector"],
    "ngr": ["nagar"],
    "clny": ["colony"],
    "mrg": ["marg"],
    "ph": ["phase"],
    "indl": ["industrial"],
    "estt": ["estate"],
    "opp": ["opposite", "opp."],
    "main": ["mn"],
}
NUMBER_MARKERS = ["no", "nos", "number", "num", "h.no", "hno", "h no", "house no", "door no", "d.no", "dno", "plot no", "plot", "flat no", "flat", "shop no", "shop", "unit", "suite", "khasra no", "kh no", "kh", "survey no", "sy no", "n°", "no.", "#", "bis"]
LANDMARK_MARKERS = ["near", "nr", "opp", "opposite", "behind", "beside", "next to", "adjacent to", "adj", "in front of", "pres de", "face a", "en face de"]
LOCALITY_STOPWORDS = ["city", "cdp", "town", "village", "district", "dist", "urban", "rural", "municipality", "cedex"]
#: States of the US by postal code, and of India.
REGIONS = {
    "al": ["alabama"], "ak": ["alaska"], "az": ["arizona"], "ar": ["arkansas"], "ca": ["california"], "co": ["colorado"], "ct": ["connecticut"], "de": ["delaware"], "dc": ["district of columbia", "washington dc"], "fl": ["florida"],
    "ga": ["georgia"], "hi": ["hawaii"], "id": ["idaho"], "il": ["illinois"], "in": ["indiana"], "ia": ["iowa"], "ks": ["kansas"], "ky": ["kentucky"], "la": ["louisiana"], "me": ["maine"], "md": ["maryland"], "ma": ["massachusetts"],
    "mi": ["michigan"], "mn": ["minnesota"], "ms": ["mississippi"], "mo": ["missouri"], "mt": ["montana"], "ne": ["nebraska"], "nv": ["nevada"], "nh": ["new hampshire"], "nj": ["new jersey"], "nm": ["new mexico"], "ny": ["new york"],
    "nc": ["north carolina"], "nd": ["north dakota"], "oh": ["ohio"], "ok": ["oklahoma"], "or": ["oregon"], "pa": ["pennsylvania"], "ri": ["rhode island"], "sc": ["south carolina"], "sd": ["south dakota"], "tn": ["tennessee"],
    "tx": ["texas"], "ut": ["utah"], "vt": ["vermont"], "va": ["virginia"], "wa": ["washington"], "wv": ["west virginia"], "wi": ["wisconsin"], "wy": ["wyoming"], "pr": ["puerto rico"],
    "in_mh": ["maharashtra", "mh"], "in_dl": ["delhi", "dl", "nct of delhi", "new delhi"], "in_up": ["uttar pradesh", "up"], "in_ka": ["karnataka", "ka"], "in_tn": ["tamil nadu", "tamilnadu", "tn"], "in_gj": ["gujarat", "gj"],
    "in_wb": ["west bengal", "wb"], "in_tg": ["telangana", "tg", "ts"], "in_ap": ["andhra pradesh", "ap"], "in_hr": ["haryana", "hr"], "in_kl": ["kerala", "keralam", "kl"], "in_rj": ["rajasthan", "rj"], "in_br": ["bihar", "br"],
    "in_mp": ["madhya pradesh", "mp"], "in_pb": ["punjab", "pb"], "in_od": ["odisha", "orissa", "od", "or"], "in_as": ["assam", "as"], "in_jh": ["jharkhand", "jh"], "in_cg": ["chhattisgarh", "cg", "ct"], "in_ga": ["goa", "ga"],
    "in_uk": ["uttarakhand", "uttaranchal", "uk"], "in_hp": ["himachal pradesh", "hp"], "in_jk": ["jammu and kashmir", "jammu & kashmir", "jk"], "in_ch": ["chandigarh", "ch"], "in_py": ["puducherry", "pondicherry", "py"],
}
#: Regions of France with their departments.
FRENCH_REGIONS = {
    "fr_hdf": ["hauts-de-france", "nord", "pas-de-calais", "somme", "aisne", "oise"],
    "fr_naq": ["nouvelle-aquitaine", "gironde", "landes", "dordogne", "lot-et-garonne", "pyrenees-atlantiques", "charente", "charente-maritime", "vienne", "haute-vienne", "deux-sevres", "creuse", "correze"],
    "fr_pdl": ["pays de la loire", "loire-atlantique", "vendee", "maine-et-loire", "sarthe", "mayenne"],
    "fr_idf": ["ile-de-france", "paris", "hauts-de-seine", "seine-saint-denis", "val-de-marne", "yvelines", "essonne", "val-d'oise", "seine-et-marne"],
    "fr_ara": ["auvergne-rhone-alpes", "rhone", "isere", "loire", "ain", "savoie", "haute-savoie", "puy-de-dome", "allier", "cantal", "haute-loire", "drome", "ardeche"],
    "fr_occ": ["occitanie", "haute-garonne", "herault", "gard", "aude", "pyrenees-orientales", "tarn", "aveyron", "lot", "gers", "tarn-et-garonne", "ariege", "hautes-pyrenees", "lozere"],
    "fr_pac": ["provence-alpes-cote d'azur", "paca", "bouches-du-rhone", "var", "alpes-maritimes", "vaucluse", "alpes-de-haute-provence", "hautes-alpes"],
    "fr_ges": ["grand est", "bas-rhin", "haut-rhin", "moselle", "meurthe-et-moselle", "marne", "aube", "ardennes", "vosges", "meuse", "haute-marne"],
    "fr_bre": ["bretagne", "ille-et-vilaine", "finistere", "morbihan", "cotes-d'armor"],
    "fr_nor": ["normandie", "seine-maritime", "calvados", "manche", "eure", "orne"],
    "fr_bfc": ["bourgogne-franche-comte", "cote-d'or", "doubs", "saone-et-loire", "yonne", "nievre", "jura", "haute-saone", "territoire de belfort"],
    "fr_cvl": ["centre-val de loire", "loiret", "indre-et-loire", "loir-et-cher", "cher", "indre", "eure-et-loir"],
    "fr_cor": ["corse", "corse-du-sud", "haute-corse"],
}
#: Patterns of names and addresses: an l that stands for a capital I; what follows a bar; numbers that are no part of a name;
#: dots of abbreviations; ordinal numbers.
CAPITAL_L = r"(?<=[A-Z])l(?=[A-Z])|\bl(?=[A-Z]{2,}\b)"
BAR_TAIL = r"\s\|\s.*$"
LOOSE_NUMBERS = r"\(\s*id\s*[:#]?\s*\d+\s*\)|#\s*\d+|\s-\s*\+?\d[\d\s\-]{6,}\s*$|\b\d{8,}\b"
ACRONYM_DOTS = r"(?<=\b[a-z])\.(?=[a-z]\.)|(?<=\b[a-z]\.[a-z])\."
ORDINAL = r"^(\d+)(?:st|nd|rd|th|er|e|eme|ieme)$"
SYMBOLS = {"n°": " no ", "nº": " no ", "N°": " no ", "Nº": " no ", "°": " ", "º": " ", "№": " no ", "’": "'", "‘": "'", "`": "'"}
#: Scripts whose characters are words of their own.
UNSPACED_SCRIPTS = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")
#: Replacements of the phonetic skeleton, in order.
SKELETON = [("tion", "sn"), ("sion", "sn"), ("ph", "f"), ("bh", "v"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("sh", "s"), ("ch", "c"), ("jh", "j"), ("ck", "k"), ("q", "k"), ("c", "k"), ("x", "ks"), ("z", "s"), ("w", "v"), ("y", "i")]
