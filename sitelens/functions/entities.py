"""Character references in text, decoded as the HTML standard's table and rules have it."""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that count without a semicolon, and so at the beginning of longer ones: the longest first.
OPEN_NAMES = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers below are those of an old code page where they mean nothing else; what the standard library gives for each.
LOW = [html.unescape(f"&#{n};") for n in range(160)]


def _number(n: Column) -> Column:
    """Text of a code point; null stands for one too large to be read."""
    wrong = n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    silent = n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    low = F.get(F.array(*map(F.lit, LOW)), n.cast("int"))
    return F.when(wrong, "�").when(silent, "").when(n < len(LOW), low).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _decoded(ref: Column) -> Column:
    names = F.str_to_map(F.lit("\x02".join(f"{n}\x01{t}" for n, t in html.entities.html5.items())), F.lit("\x02"), F.lit("\x01"))
    digits = lambda at: F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]{1,9})", 1) if at else None
    number = F.when(ref.rlike("^&#[xX]"), F.conv(digits(1), 16, 10).try_cast("long")).otherwise(F.coalesce(digits(1).try_cast("long"), F.lit(1 << 40)))
    number = F.when(ref.rlike("^&#[xX]?0+;?$"), F.lit(0)).otherwise(number)
    name = F.substring(ref, 2, 40)
    front = F.regexp_extract(name, "^(" + "|".join(OPEN_NAMES) + ")", 1)
    named = F.coalesce(F.try_element_at(names, name), let(front, lambda f: F.when(f != "", F.concat(F.try_element_at(names, f), F.substring(name, F.length(f) + 1, F.length(name))))), ref)
    return F.when(ref.startswith("&#"), let(number, _number)).otherwise(named)


def unescape_text(c: Column) -> Column:
    """Every character reference decoded, named (the longest name that fits, the old ones also without a semicolon) or numeric."""
    pieces = F.zip_with(F.split(c, REFERENCE, -1), F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)), _decoded),
                        lambda gap, text: F.concat(gap, F.coalesce(text, F.lit(""))))
    return F.when(~c.contains("&"), c).otherwise(F.array_join(pieces, ""))
