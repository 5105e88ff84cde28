"""Word lists, lookup tables and patterns that results depend on. No logic here.

Patterns are Java regular expressions; FLAGS makes them ignore case and use Unicode classes.
"""

FLAGS = "(?iuU)"

# ---- fixed values: units -------------------------------------------------------------------------------------------
UNIT_CANON = {
    "mg": "mg", "g": "g", "gm": "g", "gms": "g", "grm": "g", "gram": "g", "grams": "g",
    "kg": "kg", "kgs": "kg", "kilo": "kg", "kilos": "kg", "kilogram": "kg", "kilograms": "kg",
    "l": "L", "lt": "L", "ltr": "L", "litre": "L", "litres": "L", "liter": "L", "liters": "L",
    "ml": "ml", "cl": "cl", "millilitre": "ml", "millilitres": "ml", "milliliter": "ml", "milliliters": "ml",
    "mm": "mm", "cm": "cm", "m": "m", "cm2": "cm2", "m2": "m2",
    "n": "N", "nos": "N", "u": "U", "unit": "U", "units": "U",
    "pcs": "piece", "pc": "piece", "piece": "piece", "pieces": "piece", "pair": "pair", "set": "set",
}
PERMITTED_UNITS = ("mg", "g", "kg", "ml", "l", "mm", "cm", "m", "cm2", "m2", "n", "u", "piece", "pair", "set")
TOLERATED_UNITS = {"nos": "N", "pcs": "piece", "pc": "piece", "units": "U", "pairs": "pair", "sets": "set"}
UNIT_SUGGESTION = {"gms": "g", "grm": "g", "kilo": "kg", "kgs": "kg", "ltr": "L", "cc": "mL", "cucm": "mL", "pkts": "piece", "doz": "piece"}
#: Thousandths of the main unit (kg, L, m) in one unit; mg is a thousandth of that and has a row of its own.
MAIN_UNIT = {"mg": "kg", "g": "kg", "kg": "kg", "ml": "L", "cl": "L", "L": "L", "mm": "m", "cm": "m", "m": "m"}
SUB_UNIT = {"kg": "g", "L": "ml", "m": "cm"}
COUNT_UNITS = ("n", "u", "piece", "pair", "set", "number")

# ---- fixed values: patterns ----------------------------------------------------------------------------------------
NUMBER = r"([0-9]+(?:[.,][0-9]+)*)"
QUANTITY = NUMBER + r"\s*(millilitres?|milliliters?|litres?|liters?|ltr?|l|kilograms?|kilos?|kgs?|gms?|grm|grams?|gm|g|mg|cl|ml|cm2|cm|mm|m2|m|nos|n|units?|u|pcs|pieces?|pc|pair|set)\b"
MONEY = r"(?<![a-z0-9])(?:₹|rs\.?|inr)\s*" + NUMBER
PRICE_WORD = r"\b(?:m\.?\s*r\.?\s*p\.?|max(?:imum)?\.?\s*retail\s*price)\b"
PRICE_TAIL_STOP = r"\b(?:usp|unit\s+sale\s+price|rsp|retail\s+sale\s+price)\b"
BARE_AMOUNT = r"(?<![0-9.])[0-9]{1,6}(?:\.[0-9]{1,2})?(?![0-9])"
MRP_WORDING = r"\b(?:m\.?r\.?p\.?|max(?:imum)?\.?\s*retail\s*price)\b"
TAX_WORDING = r"incl(?:usive)?\.?\s*(?:of\s+)?all\s+taxes?"
UNIT_PRICE = NUMBER + r"\s*(?:/|per\s*)\s*([a-z]+[0-9]?)\b"
DAY_MONTH_YEAR = r"(?<![0-9])([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{4})(?![0-9])"
MONTH_YEAR = r"(?<![0-9])([0-9]{1,2})\s*[/\-.]\s*([0-9]{4})(?![0-9])"
NAMED_MONTH_YEAR = r"([a-z]{3,9})\s*[\-,. ]{0,3}\s*([0-9]{4})(?![0-9])"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
YEARS = (1970, 2100)
PROHIBITED_UNIT = r"(?<![a-z0-9])(gms|grm|kilo|kgs|ltr|cc|cu\.?\s*cm|pkts|doz)(?![a-z0-9])"
LONG_NUMBER = r"(?<![0-9])(?:[0-9][\-\s]?){6,}[0-9](?![0-9])"
PIN_MARKED = r"\b(?:pin\s*code|pincode|pin|p\.?\s*o\.?)\s*[:\-]?\s*([1-9][0-9]{2})[\s\-]?([0-9]{3})\b"
PIN_BARE = r"(?<![0-9])[1-9][0-9]{5}(?![0-9])"
PIN_SPACED = r"(?<![0-9])[1-9][0-9]{2}[\s\-][0-9]{3}(?![0-9])"
MAKER = r"\b(?:mfg\.?|mfd\.?|manufactur(?:er|ed|ing)|made\s+by)\b"
PACKER = r"\bpack(?:er|ed|ing)\s+by\b|\bpackers?\b"
MARKETER = r"\bmarket(?:er|ed|ing)\s+by\b"
PHONE = (
    r"(?<![0-9])(?:1800[\-\s\.]?[0-9]{2,4}[\-\s\.]?[0-9]{3,4}(?:[\-\s\.]?[0-9]{3,4})?"
    r"|1860[\-\s\.]?[0-9]{2,4}[\-\s\.]?[0-9]{3,4}(?:[\-\s\.]?[0-9]{3,4})?"
    r"|\+?91[\-\s\.]?\(?0?[1-9][0-9]{1,4}\)?[\-\s\.]?[0-9]{6,8}"
    r"|\+?91[\-\s\.]?[6-9][0-9]{4}[\-\s\.]?[0-9]{5}"
    r"|\+?91[\-\s\.]?[6-9][0-9]{9}"
    r"|[6-9][0-9]{9}"
    r"|[6-9][0-9]{4}[\-\s\.]?[0-9]{5}"
    r"|\(?0[1-9][0-9]{1,4}\)?[\-\s\.]?[0-9]{6,8}"
    r"|[1-9][0-9]{1,4}[\-\s\.]+[0-9]{6,8})(?![0-9])"
)
EMAIL = r"[a-z0-9._%+\-]+\s*(?:@|\(at\))\s*[a-z0-9.\-]+\.[a-z]{2,}"
AS_ABOVE = (
    r"\b(?:address\s+as\s+above|same\s+as\s+above|as\s+above|above\s+address|address\s+mentioned\s+above|"
    r"registered\s+office\s+address\s+as\s+above|registered\s+office\s+address|office\s+address\s+as\s+above|"
    r"at\s+(?:the\s+)?(?:registered\s+office\s+)?address(?:\s+as\s+above)?|contact\s+at\s+address)\b"
)
ORIGIN_PHRASE = r"\b(?:country\s+of\s+origin|origin|made\s+in|product\s+of|manufactured\s+in|packed\s+in|assembled\s+in)\b\s*[:\-]?\s*([a-z][a-z .&]{0,40})"
IMPORT_HINT = r"\bimport(?:er|ed|ers|ing)?\b"
ADDRESS_LABEL = r"^\s*(?:mfd\.?|mfg\.?|mktd\.?|manufactur(?:ed|er|ers|ing)?|import(?:er|ed|ers)?|pack(?:er|ed|ing)?|market(?:ed|er|ing)?)[^:]{0,24}:\s*"

# ---- fixed values: countries ---------------------------------------------------------------------------------------
COUNTRIES = (
    "india", "china", "people's republic of china", "taiwan", "hong kong", "macau", "macao", "japan", "korea",
    "south korea", "republic of korea", "thailand", "vietnam", "viet nam", "malaysia", "singapore", "indonesia",
    "philippines", "sri lanka", "nepal", "bhutan", "bangladesh", "pakistan", "maldives", "myanmar", "united states",
    "united states of america", "usa", "us", "united kingdom", "uk", "great britain", "england", "germany", "france",
    "italy", "spain", "portugal", "netherlands", "belgium", "switzerland", "austria", "denmark", "sweden", "norway",
    "finland", "poland", "greece", "ireland", "czech republic", "czechia", "hungary", "romania", "turkey", "turkiye",
    "russia", "ukraine", "israel", "saudi arabia", "uae", "united arab emirates", "qatar", "kuwait", "oman", "bahrain",
    "iran", "iraq", "egypt", "south africa", "nigeria", "kenya", "ghana", "ethiopia", "tanzania", "morocco",
    "australia", "new zealand", "canada", "mexico", "brazil", "argentina", "chile", "colombia", "peru",
)
AMBIGUOUS_ORIGINS = ("prc", "roc", "eu", "europe", "asia", "middle east", "foreign", "imported")

# ---- fixed values: exemptions, fonts, thresholds -------------------------------------------------------------------
TOBACCO_WORDS = ("tobacco", "bidi", "pan masala", "panmasala")
BULK_WORDS = ("cement", "fertiliser", "fertilizer")
#: Largest area of each band in square centimetres (none: unbounded), least height in mm, the same for blown print.
FONT_BANDS = ((50.0, 1.0, 1.5), (100.0, 1.5, 3.0), (500.0, 2.5, 4.0), (2500.0, 4.0, 6.0), (None, 6.0, 6.0))
FONT_TOLERANCE_MM = 0.1
ROUND_SHAPES, FLAT_SHAPES = ("cylindrical", "bottle"), ("rectangular", "pouch")
PDA_SANITY = (1.0, 25000.0)
NARROW_GLYPHS = ("1", "i", "I", "l")
BLUR_MIN, GLARE_MAX_PCT = 100.0, 1.0

# ---- fixed values: texts -------------------------------------------------------------------------------------------
FIELDS = ("product_name", "net_qty", "mrp", "usp", "mfg_date", "mfg_address", "origin", "consumer_care")
FIELD_LABELS = {"net_qty": "net quantity", "mrp": "MRP", "usp": "unit sale price"}
PIN_ZONES = {
    "1": "Delhi / Haryana / Punjab / Himachal Pradesh / J&K / Chandigarh",
    "2": "Uttar Pradesh / Uttarakhand",
    "3": "Rajasthan / Gujarat / Daman & Diu",
    "4": "Maharashtra / Madhya Pradesh / Goa / Chhattisgarh",
    "5": "Telangana / Andhra Pradesh / Karnataka",
    "6": "Tamil Nadu / Kerala / Puducherry / Lakshadweep",
    "7": "West Bengal / Odisha / Assam / North-East / Andaman",
    "8": "Bihar / Jharkhand",
    "9": "Army Postal Service",
}

# ---- fixed values: anchors of label fields, in the order in which fields are looked for --------------------------
ANCHORS = {
    "net_qty": (r"\bnet\s*(?:quantity|qty|qnty|wt|weight|vol(?:ume)?|contents?)\b", r"^(?:quantity|qty)\b"),
    "mrp": (r"\bm\.?\s*r\.?\s*p\.?\b", r"\bmax(?:imum)?\.?\s*retail\s*price\b"),
    "usp": (r"\bunit\s*sale\s*price\b", r"\bu\.?\s*s\.?\s*p\.?\b"),
    "mfg_date": (r"\bmfg\b", r"\bmfd\b", r"\bpkd\.?\b", r"\bdate\s+of\s+(?:mfg|manufactur|pack)", r"\bmanufactur(?:ed|ing)\s+on\b", r"\bpack(?:ed|ing)\s+(?:on|date)\b"),
    "mfg_address": (
        r"\bmfd\.?\s*by\b", r"\bmfg\.?\s*by\b", r"\bmkt?d\.?\s*by\b",
        r"\bmanufactur(?:ed|er|ers|ing)?(?:\s+[a-z]+){0,3}\s*by\b", r"\bmanufactur(?:ed|er|ers|ing)\s+in\b",
        r"\bmanufacturers?\b", r"\bimport(?:er|ed|ers|ing)?(?:\s+[a-z]+){0,3}\s*by\b", r"\bimport(?:er|ed|ers|ing)\b",
        r"\bpack(?:ed|er|ing)?(?:\s+[a-z]+){0,3}\s*by\b", r"\bmarket(?:ed|er|ing)?(?:\s+[a-z]+){0,3}\s*by\b",
    ),
    "origin": (r"country\s+of\s+origin", r"\borigin\b", r"\bmade\s+in\b", r"\bproduct\s+of\b", r"\bassembled\s+in\b"),
    "consumer_care": (r"consumer\s*(?:care|complaint|service|relation|grievance)", r"customer\s*(?:care|complaint|service)", r"grievance\s+officer", r"\bhelpline\b", r"toll\s*free"),
}
#: The letters that the anchors of a field begin with; nowhere else in a text are they looked for.
ANCHOR_LETTERS = {"net_qty": "nq", "mrp": "m", "usp": "u", "mfg_date": "mpd", "mfg_address": "mip", "origin": "compa", "consumer_care": "cght"}
#: Distances in heights of the anchor, overlaps as shares, counts.
SAME_LINE_GAP, LINE_OVERLAP, RIGHT_SLACK, BELOW_GAP, BELOW_OVERLAP = 2.0, 0.4, 0.3, 1.5, 0.2
PARAGRAPH_GAP, PARAGRAPH_OVERLAP, PARAGRAPH_LINES = 2.2, 0.15, 12
LEAST_LETTERS, LEAST_TEXT, TOP_SHARE = 3, 8, 0.65
OCR_TIERS = ("mlkit", "tesseract", "indic", "bhashini")

#: What each rule of the law asks for, as findings cite it.
CITATIONS = {
    "6(1)(a)": "Rule 6(1)(a), LMPC Rules 2011 — name & complete postal address of manufacturer / packer / importer, incl. 6-digit PIN.",
    "6(1)(aa)": "Rule 6(1)(aa), LMPC Rules 2011 — country of origin, explicit (no ambiguous abbreviations).",
    "6(1)(b)": "Rule 6(1)(b), LMPC Rules 2011 — common / generic name of the commodity.",
    "6(1)(c)": "Rule 6(1)(c), LMPC Rules 2011 — net quantity in standard metric units.",
    "6(1)(d)": "Rule 6(1)(d), LMPC Rules 2011 — month & year of manufacture / packing / import (MM/YYYY or Month YYYY).",
    "6(1)(e)": "Rule 6(1)(e), LMPC Rules 2011 — MRP with 'inclusive of all taxes' phrasing.",
    "6(1)(n)": "Rule 6(1)(n), LMPC Rules 2011 — consumer care details (name, address, helpline, email).",
    "6(10)": "Rule 6(10), LMPC Rules 2011 — e-commerce listing declarations.",
    "6(11)": "Rule 6(11), LMPC Rules 2011 — Unit Sale Price declaration and reference units.",
    "7": "Rule 7 & Table-I (G.S.R. 629(E)), LMPC Rules 2011 — minimum numeral/letter height by PDA band.",
    "7(3)": "Rule 7(3), LMPC Rules 2011 — character width >= height/3 (except 1, i, I, l).",
    "7(4)": "Rule 7(4), LMPC Rules 2011 — Principal Display Area computation.",
    "13": "Rule 13, LMPC Rules 2011 — standard metric unit symbols; prohibited syntax (gms, ltr, cc, ...).",
    "26": "Rule 26, LMPC Rules 2011 — statutory exemptions (small / bulk / institutional / fast food).",
}
#: Fixed values of the request and response contracts.
SCHEMA_VERSION = 1
SHAPES = ("rectangular", "cylindrical", "pouch", "bottle", "blister", "other")
SIGNATURE_ERRORS = ("BAD_REQUEST", "NOT_FOUND", "NO_DOSSIER", "ALREADY_SIGNED", "VERIFY_FAILED")

#: Plain wording: fixed values by rule and status.
PLAIN = {
    "13|PASS": "Unit spellings are correct.",
    "6(1)(c)|FAIL": "The net quantity is printed in a non-standard unit.",
    "6(1)(c)|PASS": "Net quantity is declared correctly.",
    "6(1)(e)|PASS": "MRP is declared with the required tax wording.",
    "6(11)|FAIL": "The unit price printed on the pack doesn't match the MRP.",
    "6(11)|PASS": "The unit price matches the MRP.",
    "6(11)|NA": "Unit price couldn't be checked — MRP or quantity missing.",
    "6(1)(d)|FAIL": "The manufacturing date is missing or not in a valid Month-Year format.",
    "6(1)(d)|PASS": "Manufacturing date is valid.",
    "6(1)(a)|FAIL": "Maker's name and full postal address (with PIN code) is incomplete.",
    "6(1)(a)|PASS": "Maker's details with PIN code are complete.",
    "6(1)(aa)|FAIL": "Country of origin is missing or unclear.",
    "6(1)(aa)|PASS": "Country of origin is clearly stated.",
    "6(1)(aa)|NA": "Country of origin not found — required only for imported items.",
    "6(1)(n)|FAIL": "Consumer care details are incomplete (helpline / email / address).",
    "6(1)(n)|PASS": "Consumer care details are complete.",
    "6(1)(b)|FAIL": "The product's common/generic name is missing.",
    "6(1)(b)|PASS": "Product name is present.",
    "7|FAIL": "The printed letters are smaller than the legal minimum for this pack size.",
    "7|PASS": "Letter heights meet the legal minimum.",
    "7|NA": "Letter height couldn't be measured — hold the calibration card in frame (or confirm pack dimensions).",
    "7(3)|FAIL": "Some letters are too narrow (width must be at least 1/3 of height).",
    "7(3)|PASS": "Letter widths are compliant.",
}
