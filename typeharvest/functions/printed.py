"""The string printer's escapes as column expressions, both ways.

A printed field stands in double quotes. Backslash, quote and dollar carry a
backslash; characters that cannot be shown are written by name (``\\n``) or
number (``\\x1f``, ``\\u200b``, ``\\U10ffff``). So a printed line holds no line
end and no other control character, which is what the parser leans on: it puts
control characters in the place of escaped backslashes and quotes, and then
every quote left is the edge of a field. No pattern here repeats a group, so
the length of a field does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The printer's names of control characters
NAMES = {"\a": "a", "\b": "b", "\t": "t", "\n": "n", "\v": "v", "\f": "f", "\r": "r", "\x1b": "e"}
#: characters without a name that cannot be shown: controls, and what Unicode does not class as visible
_HIDDEN = r"[\x01-\x06\x0e-\x1a\x1c-\x1f\x7f]|[\p{Cc}\p{Cf}\p{Cn}\p{Co}\p{Cs}\p{Zl}\p{Zp}&&[^\x00-\x7f]]"
_BACKSLASH, _QUOTE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """The text between the quotes of a printed field."""
    out = F.regexp_replace(text, r'([\\"$])', r"\\$1")
    for char, name in NAMES.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + name))
    # an octal digit behind it would make the short form another number
    out = F.replace(F.regexp_replace(out, "\x00(?=[0-7])", r"\\x00"), F.lit("\x00"), F.lit("\\0"))
    chars = F.regexp_extract_all(out, F.lit("(?s)."), F.lit(0))

    def shown(c: Column, i: Column) -> Column:
        number = F.lower(F.hex(F.ascii(c)))
        full = F.coalesce(F.get(chars, i + 1).rlike("^[0-9A-Fa-f]"), F.lit(False))
        pad = lambda short, long: F.lpad(number, F.greatest(F.length(number), F.when(full, long).otherwise(short)), "0")
        numbered = (F.when(F.ascii(c) <= 0x7F, F.concat(F.lit("\\x"), F.lpad(number, 2, "0")))
                    .when(F.ascii(c) <= 0xFFFF, F.concat(F.lit("\\u"), pad(2, 4))).otherwise(F.concat(F.lit("\\U"), pad(4, 8))))
        return F.when(c.rlike(_HIDDEN), numbered).otherwise(c)

    return F.when(out.rlike(_HIDDEN), F.array_join(F.transform(chars, shown), "")).otherwise(out)


def line(columns: list[Column]) -> Column:
    """A printed line of fields; a null is an empty field."""
    fields = [F.concat(F.lit('"'), escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit('"')) for c in columns]
    return F.concat_ws(",", *fields)


def _unescaped(field: Column) -> Column:
    """The text of a field; null where an escape is unknown."""
    parts = F.split(field, r"\\")

    def restored(text: Column) -> Column:
        """Before numbers become characters: those may be the stand-ins themselves."""
        return F.replace(F.replace(text, F.lit(_BACKSLASH), F.lit("\\")), F.lit(_QUOTE), F.lit('"'))

    def plain(p: Column, i: Column) -> Column:
        hexed = F.regexp_extract(p, "^(?:x([0-9A-Fa-f]{1,2})|u([0-9A-Fa-f]{1,4})|U([0-9A-Fa-f]{1,8}))", 0)
        octal = F.regexp_extract(p, "^[0-7]{1,3}", 0)
        code = F.coalesce(F.when(hexed != "", F.substring(hexed, 2, 8)), F.conv(octal, 8, 16))
        # beyond ASCII, \x is a byte and no character; numbers beyond Unicode or for half a pair are none either
        value = F.conv(code, 16, 10).cast("long")
        known = (value <= F.when(hexed.startswith("x") | (octal != ""), 0x7F).otherwise(0x10FFFF)) & ~value.between(0xD800, 0xDFFF)
        # the byte order mark in front is dropped, one that is the text stays
        char = F.when(known, F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(code, 8, "0"))), "utf-32"))
        rest = lambda n: restored(F.substr(p, n + 1))
        out = F.when(i == 0, restored(p))
        for c, name in NAMES.items():
            out = out.when(p.startswith(name), F.concat(F.lit(c), rest(F.lit(1))))
        out = out.when(p.startswith("$") | p.startswith("'"), restored(p))
        return out.when((hexed != "") | (octal != ""), F.concat(char, rest(F.greatest(F.length(hexed), F.length(octal)))))

    shown = F.transform(parts, plain)
    whole = F.when(~F.exists(shown, lambda s: s.isNull()), F.array_join(shown, ""))
    return F.when(field.contains("\\"), whole).otherwise(restored(field))


def parsed(text: Column, n: int) -> tuple[Column, Column]:
    """(array of the n fields, what is wrong) of a printed line; one of them is null.

    Wrong: ``control`` (a raw control character), ``quotes`` (not fields in
    quotes with commas between), ``fields`` (another number of them) or
    ``escape`` (an unknown one).
    """
    edges = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    cut = F.split(edges, '"')
    last = F.size(cut) - 1
    between = F.filter(cut, lambda _, i: i % 2 == 0)
    framed = (F.size(cut) % 2 == 1) & (last > 0) & ~F.exists(
        F.transform(between, lambda b, i: b != F.when((i == 0) | (i * 2 == last), "").otherwise(",")), lambda b: b)
    fields = F.transform(F.filter(cut, lambda _, i: i % 2 == 1), _unescaped)
    wrong = (F.when(text.rlike(r"[\x00-\x1f\x7f]"), "control").when(~framed, "quotes")
             .when(F.size(cut) != 2 * n + 1, "fields").when(F.exists(fields, lambda f: f.isNull()), "escape"))
    return F.when(wrong.isNull(), fields), wrong
