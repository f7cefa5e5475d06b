"""Column builders over names and texts.  Each takes columns and returns a column; none runs Python on executors."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schema import DOMAINS, UNKNOWN

# Words that only tell apart variants of one menu, removed in this order.
VARIANT_TOKENS = ("리치골드크러스트", "치즈크러스트", "골드크러스트", "크러스트", "씬도우", "밀도우", "오리지널", "라지", "레귤러", "미디움", "반마리", "1인")
# Sizes that a name may give in parentheses.
SIZES = ("S", "M", "L", "XL", "R", "F", "P", "J", "V", "G", "H", "EX", "ML", "Max", "Short", "Tall", "Grande", "Venti", "Mini Venti", "더벤티", "Solo", "소", "중", "대", "초대용량")
# Words for a dish that stand for a category.
CATEGORY_ALIASES = {"밥": "밥류", "면": "면 및 만두류", "죽": "죽 및 스프류", "전": "전·적 및 부침류", "부침개": "전·적 및 부침류"}


def any_of(words) -> str:
    """A pattern that finds any of ``words`` literally (Java regular expressions)."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def clean(c: Column) -> Column:
    """Trimmed text; null for blank and for the text "nan"."""
    text = F.trim(c.cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def company(c: Column) -> Column:
    """A company's name; empty for none, which is null, empty or "-"."""
    return F.coalesce(F.when(c != "-", c), F.lit(""))


def is_franchise(c: Column) -> Column:
    """Whether a record names a company."""
    return ~F.trim(F.coalesce(c, F.lit(""))).isin("", "-")


def words(c: Column) -> Column:
    """White-space separated words, without empty ones (null: none)."""
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def menu_key(c: Column) -> Column:
    """A name without parentheses, separators and variant words, in lower case (null: empty)."""
    key = F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\([^)]*\)|[\s\-_·,./&+]+", ""))
    for token in VARIANT_TOKENS:
        key = F.replace(key, F.lit(token), F.lit(""))
    return key


def key_tokens(c: Column) -> Column:
    return F.transform(words(c), menu_key)


def family(value: Column, company_: Column) -> Column:
    """Group for the diversity cap: the whole value for a company's record, else its last word."""
    value = F.coalesce(value, F.lit(""))
    own = words(value)
    return F.when((company(company_) != "") | (F.size(own) == 0), value).otherwise(F.element_at(own, -1))


def same_menu(a: Column, b: Column) -> Column:
    """Whether two structs (key, company, parts) name variants of one menu.  Not transitive.

    Equal keys always are; within one company a key that begins the other; without a company word by word.
    """
    short = F.least(F.size(a["parts"]), F.size(b["parts"]))
    by_word = (short == 0) | (F.slice(a["parts"], F.lit(1), F.greatest(short, F.lit(1))) == F.slice(b["parts"], F.lit(1), F.greatest(short, F.lit(1))))
    by_key = a["key"].startswith(b["key"]) | b["key"].startswith(a["key"])
    named = (a["key"] != "") & (b["key"] != "")
    return named & ((a["key"] == b["key"]) | ((a["company"] == b["company"]) & F.when(a["company"] != "", by_key).otherwise(by_word)))


def term_key(term: Column) -> Column:
    """What a menu term stands for: a category's name for its everyday word, else itself."""
    table = F.create_map(*(F.lit(x) for pair in CATEGORY_ALIASES.items() for x in pair))
    return F.coalesce(table[term], term)


def mentions(term: str | Column, name: Column, representative: Column, category: Column) -> Column:
    """Whether a menu term points at a record: its representative, category, a word of its name or of its category.  Never a part of a word."""
    if isinstance(term, str):
        term = F.lit(CATEGORY_ALIASES.get(term, term))
    else:
        term = term_key(term)
    empty = F.lit("")
    return (
        (term == F.coalesce(representative, empty))
        | (term == F.coalesce(category, empty))
        | F.array_contains(words(name), term)
        | F.array_contains(words(category), term)
    )


def parse_name(name: Column, franchise: Column) -> Column:
    """Struct (menu, prefix, temperature, size) of a raw product name.

    A company's name has its prefix before the first "_".  (HOT) and (ICED) go, the first one tells the temperature;
    the first size in parentheses goes and is the size; what is left is the menu, or the whole name if nothing is.
    """
    cut = franchise & F.contains(name, F.lit("_"))
    prefix = F.when(cut, F.trim(F.substring_index(name, "_", 1)))
    rest = F.when(cut, F.substring(name, F.instr(name, "_") + 1, F.length(name))).otherwise(name)
    mark = r"(?U)(?:핫|아이스)?\s*\((HOT|ICED)\)"
    temperature = F.nullif(F.regexp_extract(rest, mark, 1), F.lit(""))
    rest = F.regexp_replace(rest, mark, " ")
    found = F.filter(F.regexp_extract_all(rest, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda t: F.trim(t).isin(*SIZES))
    token = F.try_element_at(found, F.lit(1))
    at = F.instr(rest, F.concat(F.lit("("), token, F.lit(")")))
    rest = F.when(token.isNull(), rest).otherwise(
        F.concat(F.substring(rest, F.lit(1), at - 1), F.lit(" "), F.substring(rest, at + F.length(token) + 2, F.length(rest)))
    )
    menu = F.trim(F.regexp_replace(F.replace(rest, F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))
    return F.struct(F.when(menu == "", F.trim(name)).otherwise(menu).alias("menu"), prefix.alias("prefix"), temperature.alias("temperature"), F.trim(token).alias("size"))


def parse_quantity(c: Column) -> Column:
    """Struct (value, unit) of "100g" or "291.90 ml"; both null for another form."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(g|ml)\s*$"
    value = F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    unit = F.lower(F.nullif(F.regexp_extract(c, pattern, 2), F.lit("")))
    return F.struct(value.try_cast("double").alias("value"), unit.alias("unit"))


def codes(c: Column) -> Column:
    """Parts of a list joined by ";", trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), F.trim), lambda x: x != "")


def joined(parts: list[Column]) -> Column:
    """Distinct non-blank parts in their order, separated by a space."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), " ")


def attribute_tokens(labels: Column, order=tuple(DOMAINS)) -> Column:
    """Known labels in ``order``; the attribute's name stands before a value that does not hold it."""
    one = []
    for attribute in order:
        value = clean(labels[attribute])
        one.append(F.when(value != UNKNOWN, F.when(F.contains(value, F.lit(attribute)), value).otherwise(F.concat(F.lit(attribute + " "), value))))
    return F.array_compact(F.array(*one))


def _names_text(name: Column, representative: Column, category: Column, labels: Column | None) -> Column:
    return joined([clean(name), clean(representative), clean(category)])


def _labelled_text(name: Column, representative: Column, category: Column, labels: Column | None) -> Column:
    base = _names_text(name, representative, category, labels)
    return F.array_join(F.filter(F.concat(F.array(base), attribute_tokens(labels)), lambda p: p != ""), " ")


#: Texts that records can be embedded as: A has name, representative and category, B also the known labels.
TEXT_VARIANTS: dict[str, Callable[[Column, Column, Column, Column | None], Column]] = {"A": _names_text, "B": _labelled_text}


def embedding_text(variant: str, name: Column, representative: Column, category: Column, labels: Column | None = None) -> Column:
    """A record's text of a registered variant; others can be added to :data:`TEXT_VARIANTS`."""
    if variant not in TEXT_VARIANTS:
        raise ValueError(f"no text variant {variant!r}; there are {', '.join(sorted(TEXT_VARIANTS))}")
    return TEXT_VARIANTS[variant](name, representative, category, labels)


def utc_stamp(c: Column) -> Column:
    """A time as ISO text in UTC, in seconds; the session's time zone must be UTC for times without a zone."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def compact_stamp(c: Column) -> Column:
    """A time as digits for the names of runs and backups."""
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def unit_id(parts: list[Column], length: int = 12) -> Column:
    """The first hex digits of the SHA-1 of the parts joined by "|" (null: empty)."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary")), 1, length)


def md5_mod3(c: Column) -> Column:
    """The MD5 of a text as a number, mod 3: as 16 mod 3 is 1, the sum of its hex digits mod 3."""
    digits = F.transform(F.filter(F.split(F.md5(c.cast("binary")), ""), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 3


def is_test_query(c: Column) -> Column:
    """The held-out third of the queries."""
    return md5_mod3(c) == 0
