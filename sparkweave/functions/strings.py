"""String functions on columns; null strings give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that ECMAScript's trim() removes.
TRIMMED = r"[\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def pad_start(text: Column, width: int, fill: str = "0") -> Column:
    """Pads on the left; longer strings stay whole, unlike with lpad."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def number_label(number: Column, width: int = 2) -> Column:
    return pad_start(number.cast("string"), width)


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^" + TRIMMED, ""), TRIMMED + r"\z", "")


def is_blank(text: Column) -> Column:
    """True for null too."""
    return F.coalesce(trim_unicode(text) == "", F.lit(True))


def json_object(**fields: Column) -> Column:
    """A JSON object; null fields are written as null."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


#: The characters of an address before the at sign, and of a domain's label, in the HTML grammar of e-mail addresses.
LOCAL, LABEL = r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+", r"[a-zA-Z0-9-]+"
#: The longest label.
LONGEST = 63


def is_email(text: Column) -> Column:
    """Whether the whole string is an e-mail address by the HTML grammar, which is of ASCII only; null gives null.

    Labels are looked at one by one, so that no pattern nests repeats and long strings take time in proportion to
    their length.
    """
    at = F.instr(text, "@")
    domain = F.split(F.substring(text, at + 1, F.length(text)), r"\.")
    good = F.forall(domain, lambda x: (F.length(x) <= LONGEST) & x.rlike(rf"\A{LABEL}\z") & ~x.startswith("-") & ~x.endswith("-"))
    return F.when(text.isNull(), None).otherwise((at > 1) & F.substring(text, F.lit(1), at - 1).rlike(rf"\A{LOCAL}\z") & good)
