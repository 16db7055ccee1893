"""String functions with PostgreSQL's semantics as Spark columns. NULL arguments give NULL unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

lower, upper, reverse, length, repeat, translate, md5, ascii_ = F.lower, F.upper, F.reverse, F.char_length, F.repeat, F.translate, F.md5, F.ascii
char_length = F.char_length


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def trim(s: Column, chars: str | None = None) -> Column:
    """Strip spaces, or any of ``chars``, from both ends."""
    return F.trim(s) if chars is None else F.btrim(s, F.lit(chars))


def ltrim(s: Column) -> Column:
    return F.ltrim(s)


def rtrim(s: Column) -> Column:
    return F.rtrim(s)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def substring(s: Column, start, size=None) -> Column:
    """1-based; places below 1 use up the size, and a negative size raises."""
    start = _col(start)
    first = F.greatest(start, F.lit(1))
    if size is None:
        return F.substring(s, first, F.length(s))
    size = _col(size)
    left = F.when(size < 0, F.raise_error("negative substring length not allowed").cast("int")).otherwise(F.greatest(start + size - first, F.lit(0)))
    return F.when(start.isNotNull() & size.isNotNull(), F.substring(s, first, left))


def left(s: Column, n) -> Column:
    """First ``n`` characters; a negative ``n`` drops the last ones."""
    n = _col(n)
    return F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0))))


def right(s: Column, n) -> Column:
    """Last ``n`` characters; a negative ``n`` drops the first ones."""
    n = _col(n)
    size = F.least(F.length(s), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0))))
    return F.substring(s, F.length(s) - size + 1, size)


def regexp_replace(s: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only; ``\\1`` to ``\\9`` name groups of the pattern."""
    text = replacement.replace("$", "\\$")
    text = re.sub(r"\\([1-9])", lambda m: f"${{g{m[1]}}}", text)
    shifted = re.sub(r"\$\{g(\d)\}", lambda m: f"${int(m[1]) + 1}", text)
    return F.regexp_replace(s, F.lit(f"(?s)^(.*?)(?:{pattern})(?-s)((?s:.*))$"), F.lit(f"$1{shifted}${_groups(pattern) + 2}"))


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def split_part(s: Column, delimiter: str, n: int) -> Column:
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def concat(*args: Column) -> Column:
    """Concatenation that skips NULLs."""
    return F.concat_ws("", *[a.cast("string") for a in args])


def octet_length(s: Column) -> Column:
    return F.octet_length(s)


def position(sub: str, s: Column) -> Column:
    return F.position(F.lit(sub), s)


def initcap(s: Column) -> Column:
    """Capital after every character that is neither letter nor digit."""
    runs = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def lpad(s: Column, n: int, fill: str = " ") -> Column:
    return F.lpad(s, n, fill)


def rpad(s: Column, n: int, fill: str = " ") -> Column:
    return F.rpad(s, n, fill)


def chr_(n: Column) -> Column:
    """The character of a Unicode code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


#: Template patterns of to_char and to_date and the letters Spark's formatter uses.
DATE_PATTERNS = {"YYYY": "yyyy", "HH24": "HH", "HH12": "hh", "Month": "MMMM", "MI": "mm", "SS": "ss", "MM": "MM", "DD": "dd", "Mon": "MMM", "YY": "yy", "HH": "hh", "DDD": "DDD", "AM": "a", "PM": "a", "US": "SSSSSS", "MS": "SSS", "Day": "EEEE", "Dy": "EEE"}
_DATE_PATTERN = re.compile("|".join(sorted(DATE_PATTERNS, key=len, reverse=True)))


def date_format(picture: str) -> str:
    """Spark's pattern of a date picture; other letters are quoted."""
    out, at = [], 0
    for m in _DATE_PATTERN.finditer(picture):
        out += [_quoted(picture[at : m.start()]), DATE_PATTERNS[m[0]]]
        at = m.end()
    return "".join([*out, _quoted(picture[at:])])


def _quoted(text: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", text).replace('"', "")


def to_char(e: Column, picture: str) -> Column:
    """Number or timestamp by a picture: date letters mean a timestamp; ``FM`` drops the padding."""
    if _DATE_PATTERN.search(picture.replace("FM", "")):
        return F.date_format(e, date_format(picture.replace("FM", "")))
    bare = picture.replace("FM", "")
    digits, _, decimals = bare.partition(".")
    places = sum(c in "09" for c in decimals)
    whole = sum(c in "09" for c in digits)
    number = F.to_char(F.round(e.cast(f"decimal({whole + places + 10},{places})"), places).cast(f"decimal({whole + places},{places})"), F.lit(bare))
    return F.trim(number) if picture.startswith("FM") else F.concat(F.lit(" "), F.lpad(F.trim(number), len(bare)))


def to_number(s: Column, picture: str) -> Column:
    """Number read by a picture; ``MI`` is a sign at its end."""
    bare = picture.replace("FM", "")
    if bare.endswith("MI"):
        value = F.to_number(F.rtrim(F.replace(s, F.lit("-"), F.lit(""))), F.lit(bare[:-2]))
        return F.when(F.endswith(s, F.lit("-")), -value).otherwise(value)
    return F.to_number(F.trim(s), F.lit(bare))


def format_(picture: str, *args: Column) -> Column:
    """``%s`` text (NULL is empty), ``%I`` identifier, ``%L`` literal, ``%%``; ``%2$s`` names an argument."""
    out, at, turn = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?([sIL%])", picture):
        out.append(F.lit(picture[at : m.start()]))
        at = m.end()
        if m[2] == "%":
            out.append(F.lit("%"))
            continue
        turn = int(m[1]) if m[1] else turn + 1
        text = args[turn - 1].cast("string")
        if m[2] == "s":
            out.append(F.coalesce(text, F.lit("")))
        elif m[2] == "I":
            out.append(F.when(text.rlike("^[a-z_][a-z0-9_]*$"), text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))))
        else:
            out.append(F.coalesce(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")))
    return F.concat(*out, F.lit(picture[at:]))
