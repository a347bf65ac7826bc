"""Names, ids and keys as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Cyrillic letters become in an id.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def slug(text: Column) -> Column:
    """An id of a name: letters mapped, separators to one hyphen, all else dropped, no hyphen at the ends."""
    low = F.lower(F.trim(text))
    single = {k: v for k, v in LETTERS.items() if len(v) == 1}
    gone = "".join(k for k, v in LETTERS.items() if not v)
    out = F.translate(low, "".join(single) + gone, "".join(single.values()))
    for letter, latin in LETTERS.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    out = F.regexp_replace(out, r"[^a-z0-9\s\-_.,/]", "")
    return F.regexp_replace(F.regexp_replace(out, r"[\s\-_.,/]+", "-"), r"^-+|-+$", "")


def id_hash(text: Column) -> Column:
    """h = 31 h + code over the characters, as an unsigned 32-bit number."""
    codes = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(4294967296)))


def color_slot(text: Column, slots: int = 8) -> Column:
    return (id_hash(text) % slots).cast("int")


def id_number(text: Column, prefix: str = "country-") -> Column:
    """The digits behind the first prefix in an id, 0 without any."""
    return F.coalesce(F.regexp_extract(text, rf"{prefix}(\d+)", 1).try_cast("int"), F.lit(0))


def padded(number: Column, width: int) -> Column:
    """The number with leading zeros; longer ones are kept whole."""
    return F.format_string(f"%0{width}d", number.cast("long"))


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def path_safe(text: Column) -> Column:
    return F.replace(text, F.lit("/"), F.lit("-"))


def grouped_number(number: Column) -> Column:
    """Thousands parted by a no-break space, as Russian locales do."""
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit(" "))


def list_items(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")


def taken(ids: Column, wanted: Column) -> Column:
    return F.array_contains(ids, F.trim(wanted))


def prefixed_slug(owner: Column, name: Column) -> Column:
    return F.concat(owner, F.lit("-"), slug(name))


def style_index(number: Column, slots: int) -> Column:
    return F.pmod(number, F.lit(slots)).cast("int")


def capital_label(name: Column, capital: Column) -> Column:
    return F.when(F.coalesce(capital, F.lit(False)), F.concat(F.lit("● "), name)).otherwise(name)


def numbered_label(number: Column, name: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), name)


def matches_search(name: Column, query: str) -> Column:
    return F.lit(True) if not query else F.contains(F.lower(name), F.lit(query.lower()))
