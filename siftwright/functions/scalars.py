"""Scalar rules as Column expressions: placeholders, measures, units, word forms, folds and comparisons."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for an empty cell.
VOID = r"(?i)^\s*(--\s*)?(no\s+)?(unbranded|un-?branded|none|n/?a|null|nil|tbd|unknown|no\s+[\w& ]+\s+brand|commodity\s*-\s*unbranded|not\s+applicable|-{1,3}|\.)\s*(--)?\s*$"

# Inches in a unit, by its spellings.
INCHES = {"in": 1.0, "inch": 1.0, '"': 1.0, "ft": 12.0, "'": 12.0, "mm": 1 / 25.4, "cm": 1 / 2.54, "yd": 36.0}

# Acronyms that keep capitals in titles.
ACRONYMS = ("LED", "USB", "GFCI", "HVAC", "PVC", "AC", "DC", "TV", "CFL", "HID")

# Trade shorthand and what it is short for.
ABBREVIATIONS = {
    "lt": "Light", "lts": "Lights", "lgt": "Light", "elect": "Electric", "elec": "Electric", "electr": "Electric", "ext": "Exterior", "int": "Interior", "milw": "Milwaukee", "dewalt": "DEWALT",
    "fridge": "Refrigerator", "refrig": "Refrigerator", "dishw": "Dishwasher", "wshr": "Washer", "dryr": "Dryer", "sst": "Stainless Steel", "ss": "Stainless Steel", "bss": "Black Stainless Steel", "bo": "Black", "wh": "White",
    "wht": "White", "bk": "Black", "blk": "Black", "clr": "Clear", "brz": "Bronze", "nkl": "Nickel", "chr": "Chrome", "brs": "Brass", "alum": "Aluminum", "galv": "Galvanized",
    "cplg": "Coupling", "nip": "Nipple", "elb": "Elbow", "tee": "Tee", "bltln": "Built-in", "bltin": "Built-in", "sq": "Square", "grvd": "Grooved", "ud": "Underground", "thhn": "THHN",
    "romex": "NM-B", "pk": "Pack", "pc": "Piece", "ea": "Each", "bx": "Box", "cd": "Cord", "hd": "Head", "adj": "Adjustable", "med": "Medium Base", "cand": "Candelabra Base",
    "ph": "Phase", "hp": "Horsepower", "mtr": "Motor", "gal": "Gallon", "qt": "Quart", "cmpt": "Compact", "std": "Standard", "hvy": "Heavy Duty", "skylt": "Skylight", "dr": "Door",
    "bsmt": "Basement", "wdw": "Window", "fxd": "Fixed", "gld": "Gliding", "csmt": "Casement", "dbl": "Double", "bal": "Baluster", "rlg": "Railing", "gry": "Gray", "shthg": "Sheathing",
    "insul": "Insulation", "flshg": "Flashing", "assy": "Assembly", "brkt": "Bracket", "conn": "Connector", "recept": "Receptacle", "swt": "Switch", "gfci": "GFCI", "pnl": "Panel", "encl": "Enclosure",
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def is_void(c: Column) -> Column:
    """True for null, blank, a placeholder word, or anything between double dashes."""
    t = F.trim(c)
    return c.isNull() | (t == "") | t.rlike(VOID) | (t.startswith("--") & t.endswith("--"))


def clean(c: Column) -> Column:
    """White space collapsed; null if void."""
    return F.when(~is_void(c), F.trim(F.regexp_replace(c, r"\s+", " ")))


def fold(c: Column) -> Column:
    """Lower case, single spaces: for comparing values."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def root(c: Column) -> Column:
    """Lower-case letters and digits only: for comparing names."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def fraction(c: Column) -> Column:
    """A decimal number as a trade fraction in 64ths, "50.25" as "50-1/4"; null unless it is one exactly."""
    value = c.try_cast("double")
    size = F.abs(value)
    whole = F.floor(size)
    parts = (size - whole) * 64
    n = F.round(parts).cast("int")
    exact = F.abs(F.round(size - whole, 6) - F.round(n / 64, 6)) < 5e-7
    power = reduce(lambda e, d: F.when(n % (64 // d) == 0, F.lit(d)).otherwise(e), (32, 16, 8, 4, 2), F.lit(64))
    name = F.concat((n / (64 / power)).cast("int").cast("string"), F.lit("/"), power.cast("string"))
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(F.round(size - whole, 6) == 0, value.cast("bigint").cast("string")).when(exact & (n > 0) & (n < 64), F.concat(sign, F.when(whole > 0, F.concat(whole.cast("string"), F.lit("-"))).otherwise(""), name))


def measure(c: Column) -> Column:
    """One measurement without its tick marks, as a fraction where it is one."""
    t = F.trim(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", ""))
    t = F.when(t.rlike(r"^\.\d+$"), F.concat(F.lit("0"), t)).otherwise(t)
    return F.when(t.rlike(r"^\d*\.\d+$"), F.coalesce(fraction(t), t)).otherwise(t)


def unit_of_mark(c: Column) -> Column:
    """The unit a tick mark stands for; empty without one."""
    m = F.rtrim(F.lower(F.trim(c)), F.lit("."))
    return F.when(F.coalesce(m, F.lit("")) == "", "").when(m.isin("'", "ft"), "ft").when(m.isin("mm", "cm"), m).otherwise("in")


def number(c: Column) -> Column:
    """Integers, decimals, fractions, mixed fractions, the larger of a pair such as 12/20 (both 5 or more, the lower no power of two), else a leading number."""
    t = F.trim(F.regexp_replace(c.cast("string"), ",", ""))
    d = lambda p, i: F.regexp_extract(t, p, i).try_cast("double")
    mixed, pair, lead = r"^(\d+)\s*[- ]\s*(\d+)\s*/\s*(\d+)$", r"^(\d+)\s*/\s*(\d+)$", r"^(-?\d+(?:\.\d+)?)"
    a, b = d(pair, 1), d(pair, 2)
    return (
        F.when(t.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), t.try_cast("double"))
        .when(t.rlike(mixed) & (d(mixed, 3) > 0), d(mixed, 1) + d(mixed, 2) / d(mixed, 3))
        .when(t.rlike(pair) & (b > 0), F.when((a >= 5) & (b >= 5) & (b.cast("long").bitwiseAND(b.cast("long") - 1) != 0), F.greatest(a, b)).otherwise(a / b))
        .when(t.rlike(lead), d(lead, 1))
    )


def inches(value: Column, unit: Column) -> Column:
    """A length in inches; null for units that are none. No unit counts as inches."""
    return value * F.element_at(literal_map(INCHES), F.lower(F.trim(F.coalesce(unit, F.lit("")))))


def expand(c: Column) -> Column:
    """Trade shorthand written out, word by word; other words and everything between them stay.

    A text is cut at word boundaries into words and what lies between, so joining the parts again loses nothing."""
    parts = F.split(c, r"(?<![A-Za-z0-9_])(?=[A-Za-z])|(?<=[A-Za-z-])(?![A-Za-z-])")
    book = literal_map(ABBREVIATIONS)
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.element_at(book, F.lower(w)), w)), "")


def title(c: Column) -> Column:
    """Each word with a capital, acronyms in capitals."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(F.upper(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))), " ")


def clip(c: Column, most: int) -> Column:
    """At most so many characters; cut at a space if one lies beyond 60 % of them."""
    head = F.substring(c, 1, most)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    at = F.when((F.instr(head, " ") > 0) & (space > 0.6 * most), F.rtrim(F.substring(head, F.lit(1), space))).otherwise(F.rtrim(head))
    return F.when(F.length(c) <= most, c).otherwise(at)


def distinct_words(c: Column) -> Column:
    """Repeats of words of more than two letters or digits left out, whatever signs are at them; the first stays."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    bare = F.transform(words, root)
    keep = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (F.length(root(x["w"])) <= 2) | (F.array_position(bare, root(x["w"])) == x["i"] + 1))
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(keep, lambda x: x["w"]), " "), r"\s+,", ","), r"^[ ,]+|[ ,]+$", "")


def value_key(c: Column) -> Column:
    """For telling whether two claims are one: lower case, no white space, no signs but . / and -."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s_]+", ""), r"[^\p{L}\p{N}./-]", "")


def bare(c: Column) -> Column:
    """A name without registration signs."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[®™]", ""))


def shares_root(a: Column, b: Column) -> Column:
    """Whether one name begins with the other, signs aside, as a maker's does that is the brand with a legal suffix."""
    x, y = root(bare(a)), root(bare(b))
    return (x != "") & (y != "") & (x.startswith(y) | y.startswith(x))


def tokens(c: Column) -> Column:
    """Words of letters and digits, with . / or - inside, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:[./-][a-z0-9]+)*"), F.lit(0))


def token_f1(a: Column, b: Column) -> Column:
    """Overlap of two bags of words; 1 if both are empty."""
    x, y = tokens(F.coalesce(a, F.lit(""))), tokens(F.coalesce(b, F.lit("")))
    times = lambda s, w: F.size(F.filter(s, lambda v: v == w))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, w: n + F.least(times(x, w), times(y, w)))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * common / (F.size(x) + F.size(y)))


def display(value: Column, unit: Column) -> Column:
    """Value and unit with a space; empty for null."""
    return F.coalesce(F.concat_ws(" ", F.when(value != "", value), F.when(unit != "", unit)), F.lit(""))


def without_echo(text: Column, code: Column) -> Column:
    """text without a code that it repeats: at its start with a dash or colon after it, else its first mention as a word."""
    quoted = F.concat(F.lit(r"\Q"), code, F.lit(r"\E"))
    head = F.concat(F.lit(r"(?i)^\s*"), quoted, F.lit(r"\s*[-:]?\s*"))
    word = F.concat(F.lit(r"(?i)^(.*?)\b"), quoted, F.lit(r"\b"))
    loose = F.regexp_replace(text, word, F.lit("$1 "))
    return F.when(F.coalesce(code, F.lit("")) == "", text).when(F.regexp_like(text, head), F.trim(F.regexp_replace(text, head, F.lit("")))).when(F.regexp_like(text, word), F.trim(loose)).otherwise(text)


def seconds(c: Column) -> Column:
    """A duration such as 6h51m50.4s or 577ms in seconds."""
    part = lambda unit, factor: F.coalesce(F.regexp_extract(c, rf"(\d+(?:\.\d+)?){unit}(?![a-z])", 1).try_cast("double"), F.lit(0.0)) * factor
    return part("h", 3600) + part("m", 60) + part("s", 1) + part("ms", 0.001)


def without_terms(c: Column, terms: list[str]) -> Column:
    """Whole-word removal of terms, longest first, whatever their case."""
    if not terms:
        return c
    one = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"(?i)(?<!\w)(?:{one})(?!\w)", " "), r"\s+", " "))


def json_object(c: Column) -> Column:
    """The JSON object in an answer that may be fenced or wrapped in prose; null if there is none that parses."""
    body = F.regexp_substr(c, F.lit(r"(?s)\{.*\}"))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def json_list(c: Column, *names: str) -> Column:
    """The JSON list in such an answer: itself a list, or under the first of the names that the object has; null if there is none that parses."""
    whole = F.regexp_substr(c, F.lit(r"(?s)\[.*\]"))
    inside = F.coalesce(*[F.get_json_object(json_object(c), f"$.{n}") for n in names]) if names else F.lit(None).cast("string")
    return F.coalesce(inside, F.when(F.try_parse_json(whole).isNotNull() & json_object(c).isNull(), whole))


def family_signature(supplier: Column, brand: Column, text: Column) -> Column:
    """A short digest of who sells it and its words of three letters or more, sorted: sizes and quantities don't count."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", " "), r"[#\"'xX-]", " ")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z]{3,}"), F.lit(0))))
    key = F.concat_ws("|", F.lower(F.trim(F.coalesce(supplier, F.lit("")))), root(F.coalesce(brand, F.lit(""))), F.array_join(words, " "))
    return F.concat(F.lit("F-"), F.substring(F.sha1(key.cast("binary")), 1, 8))
