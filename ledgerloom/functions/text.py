"""Text and number normalisers as columns."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
NUMERIC = r"(?<!\w)\d[\d,]*(?:\.\d+)?%?(?!\w)"
PERIOD = r"\b(?:Q[1-4]\s*FY\d{4}|FY\d{4}|20\d{2})\b"
VALUE = r"(\$?\d[\d,]*(?:\.\d+)?)\s*(billion|million|%)?"
HIDDEN = ("[HIDDEN_TOOL_PROMPT_START]", "[HIDDEN_TOOL_PROMPT_END]")


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def or_default(c: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _titles(names: pd.Series) -> pd.Series:
    return names.str.strip().str.title()


def title_name(c: Column) -> Column:
    """Stripped, every letter that follows no letter in upper case, all others in lower case."""
    return F.pandas_udf(_titles, "string")(c)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, inside a lambda too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _powers(base: int, n: int) -> Column:
    return F.array(*(F.lit(str(base**k)).cast("decimal(38,0)") for k in range(n)))


def _scaled(v: Column, e: Column) -> Column:
    """v / 10^(e - 5) as the nearest whole number, halves to even, from v's exact binary value.

    v is m / 2^k with a whole m under 2^55, so that the quotient of two whole numbers of 38 digits
    at most decides.
    """

    def of(k: Column, p: Column) -> Column:
        at = lambda base, n, x: F.element_at(_powers(base, n), F.greatest(x, F.lit(0)) + 1)
        two = F.power(F.lit(2.0), F.least(k, F.lit(1000)).cast("double"))
        m = _whole((v * two).cast("long"))
        # 2^(p - k) * 5^p, each power above or below the line by its sign
        up = _whole(_whole(m * at(5, 32, p)) * at(2, 120, p - k))
        down = _whole(at(2, 120, k - p) * at(5, 32, -p))
        return _let(F.struct(up.alias("up"), down.alias("down")), lambda f: _let(_whole(f["up"] % f["down"]), lambda rest: _rounded(f["up"], f["down"], rest)))

    return _let(F.lit(53) - F.floor(F.log2(v)).cast("int"), lambda k: of(k, F.lit(5) - e))


def _rounded(up: Column, down: Column, rest: Column) -> Column:
    low = _whole((up - rest) / down).cast("long")
    return low + F.when(rest * 2 > down, 1).when((rest * 2 == down) & (low % 2 == 1), 1).otherwise(0)


def _digits(r: Column, e: Column) -> Column:
    """Six digits r and the exponent of the first as a plain or, from 10^6 up and under 10^-4, a scientific number."""
    d = F.lpad(r.cast("string"), 6, "0")
    bare = lambda x: F.regexp_replace(x, r"\.?0*$", "")  # noqa: E731  of a text with a point
    plain = F.when(e >= 0, F.concat(F.left(d, e + 1), F.lit("."), F.substr(d, e + 2))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
    power = F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    return F.when((e < -4) | (e >= 6), F.concat(bare(F.concat(F.left(d, F.lit(1)), F.lit("."), F.substr(d, F.lit(2)))), power)).otherwise(bare(plain))


def six_digits(v: Column) -> Column:
    """A double that isn't negative with six significant digits, as C's %g has it.

    Exact from 10^-25 to 10^36; beyond, the shortest form that reads as the same double is
    rounded, which differs at most where it ends in a 5 or has under six digits.
    """

    def near(x: Column) -> Column:
        e = F.floor(F.log10(x)).cast("int")
        done = lambda r, e: F.when(r >= 1_000_000, _digits(F.lit(100_000).cast("long"), e + 1)).otherwise(_digits(r, e))
        return _let(e, lambda e: _let(_scaled(x, e), lambda r: done(r, e)))

    def far(x: Column) -> Column:
        shown = F.format_string("%.5e", x)
        return F.concat(F.regexp_replace(F.substring_index(shown, "e", 1), r"\.?0*$", ""), F.lit("e"), F.substring_index(shown, "e", -1))

    inf = F.lit(float("inf"))
    return F.when(v == 0, F.lit("0")).when(v == inf, F.lit("inf")).when((v >= 1e-25) & (v < 1e36), near(F.when((v >= 1e-25) & (v < 1e36), v).otherwise(F.lit(1.0)))).otherwise(far(v))


# Decimal digits of all scripts, and their values.
_NUMERALS = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_VALUES = "".join(str(unicodedata.digit(c)) for c in _NUMERALS)


def canonical_number(token: Column) -> Column:
    """A number's text with six significant digits and its percent sign; null if it is no number."""
    plain = F.replace(token, F.lit(","), F.lit(""))
    plain = F.when(plain.rlike("[^\\x00-\\x7F]"), F.translate(plain, _NUMERALS, _VALUES)).otherwise(plain)

    def of(t: Column) -> Column:
        percent = F.when(t.endswith("%"), F.lit("%")).otherwise(F.lit(""))
        bare = F.regexp_replace(t, "%+$", "")
        short = F.regexp_replace(bare, "^0+(?=.)", "")
        value = _let(bare.try_cast("double"), lambda v: F.when(v.isNotNull(), six_digits(v)))
        return F.concat(F.when(bare.rlike("^[0-9]{1,6}$"), short).otherwise(value), percent)

    return _let(plain, of)


def canonical_numbers(c: Column) -> Column:
    """Each distinct number with six significant digits and its percent sign, in order."""
    return F.array_distinct(F.filter(F.transform(c, canonical_number), lambda x: x.isNotNull()))


def numeric_claims(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?U){NUMERIC}"), F.lit(0))
    return canonical_numbers(F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>")))


def parse_value(c: Column) -> Column:
    return F.nullif(F.regexp_replace(strip(c), "[$,]", ""), F.lit("")).try_cast("double")


def bounded_int(c: Column, default: int, least: int = 0) -> Column:
    value = c.cast("string").try_cast("int")
    return F.when(value >= least, value).otherwise(F.lit(default))


def bounded_float(c: Column, default: float, least: float, most: float) -> Column:
    value = c.cast("string").try_cast("double")
    return F.when((value >= least) & (value <= most), value).otherwise(F.lit(default))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def bar(score: Column, width: int = 20) -> Column:
    filled = F.floor(clamp(score) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def truncate(c: Column, size: int = 100) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def snippet(c: Column, size: int) -> Column:
    """The first ``size`` characters and dots, whatever the length."""
    return F.concat(F.left(F.coalesce(c, F.lit("None")), F.lit(size)), F.lit("..."))


def folded(c: Column, size: int = 500, lines: int = 4) -> Column:
    """Long contents cut to ``size`` characters, else to ``lines`` lines."""
    split = F.split(c, "\n", -1)
    cut = F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("...")))
    return cut.when(F.size(split) > lines, F.concat(F.array_join(F.slice(split, 1, lines), "\n"), F.lit("\n..."))).otherwise(c)


def first_items(items: Column, most: int, size: int = 100) -> Column:
    """At most ``most`` strings, each truncated."""
    return F.transform(F.slice(items, F.lit(1), F.lit(most)), lambda x: truncate(x, size))


def display_name(c: Column) -> Column:
    return title_name(F.replace(c, F.lit("_"), F.lit(" ")))


def with_directive(question: Column, directive: Column) -> Column:
    """A directive between markers after the question; null or empty ones add nothing."""
    return F.when(F.coalesce(directive, F.lit("")) == "", question).otherwise(F.concat(question, F.lit(f"\n\n{HIDDEN[0]}\n"), directive, F.lit(f"\n{HIDDEN[1]}")))


def without_directive(c: Column) -> Column:
    """What stands before the marker."""
    return F.substring_index(c, f"\n\n{HIDDEN[0]}", 1)


def utc_iso(c: Column | None = None) -> Column:
    """A timestamp, by default the query's own, as ISO text in UTC with microseconds."""
    at = F.current_timestamp() if c is None else c
    return F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_iso(c: Column) -> Column:
    """ISO text as a timestamp, with or without fraction or offset; null if it is none."""
    return F.try_to_timestamp(F.nullif(strip(c), F.lit("")))


def json_payload(c: Column, schema: str) -> Column:
    """The outermost braces of a model's answer as ``schema``; null if there are none or they don't parse."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(c), r"(?s)\{.*\}", 0)
    return F.from_json(F.nullif(body, F.lit("")), schema, {"mode": "PERMISSIVE"})


def content_text(blocks: Column) -> Column:
    """Texts of an array<struct<type,text>> joined by one space."""
    texts = F.filter(F.transform(blocks, lambda b: strip(F.coalesce(b["text"], F.lit("")))), lambda t: t != "")
    return F.array_join(texts, " ")


MESSAGES = "array<struct<type string, role string, content string>>"


def messages_of(payload: Column) -> Column:
    """Messages of a JSON payload that is a list of them or an object with such a list; else none."""
    text = strip(payload)
    inner = F.get_json_object(text, "$.messages")
    body = F.when(text.startswith("["), text).when(text.startswith("{") & strip(inner).startswith("["), inner)
    return F.coalesce(F.from_json(body, MESSAGES), F.array().cast(MESSAGES))


def latest_human(messages: Column) -> Column:
    """The last message of a person that isn't blank, without surplus blanks; empty without one."""
    human = lambda m: F.lower(F.coalesce(m["type"], F.lit(""))).isin("human", "user") | F.lower(F.coalesce(m["role"], F.lit(""))).isin("human", "user")
    texts = F.filter(F.transform(F.filter(messages, human), lambda m: collapse(m["content"])), lambda t: t != "")
    return F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))


def page_snippet(c: Column, size: int = 200) -> Column:
    return F.replace(F.left(c, F.lit(size)), F.lit("\n"), F.lit(" "))


SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", " ", ""]


def split_text(text: str, size: int = 2048, overlap: int = 256, separators: list[str] = SEPARATORS) -> list[str]:
    """Recursive character splitting: order kept, no piece over ``size`` characters.

    Text is cut before the first separator that it has; small pieces are joined up to
    ``size`` with at most ``overlap`` characters of the piece before; a larger one is cut
    by the separators that remain. Pieces are stripped and blank ones dropped.
    """
    chosen = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, rest = separators[chosen], separators[chosen + 1 :]
    parts = re.split(f"(?={re.escape(separator)})", text) if separator else list(text)
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        nonlocal held, length
        if piece := "".join(held).strip():
            out.append(piece)
        while held and (length > overlap or length + pending > size):
            length -= len(held.pop(0))

    pending = 0
    for part in (p for p in parts if p):
        pending = len(part)
        if pending > size:
            if held:
                pending = size
                flush()
                held, length = [], 0
            out.extend(split_text(part, size, overlap, rest) if rest else [part[i : i + size] for i in range(0, len(part), size)])
            continue
        if held and length + pending > size:
            flush()
        held.append(part)
        length += pending
    if piece := "".join(held).strip():
        out.append(piece)
    return out


# White space as str.strip has it.
_SPACE = r"[\s\x1c-\x1f]"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def _cut(pieces: Column, separator: str, level: int, size: int) -> Column:
    """Pieces over ``size`` characters that have ``separator`` cut before it. What is cut is a group of its own."""

    def one(p: Column, i: Column) -> Column:
        regex = f"(?={re.escape(separator)})" if separator else ""
        mine = F.concat(p["g"], F.lit(f":{level}."), i.cast("string"))
        parts = F.transform(F.filter(F.split(p["t"], regex, -1), lambda x: x != ""), lambda x: F.struct(x.alias("t"), mine.alias("g")))
        has = F.contains(p["t"], F.lit(separator)) if separator else F.lit(True)
        return F.when((F.length(p["t"]) > size) & has, parts).otherwise(F.array(p))

    return F.flatten(F.transform(pieces, one))


def _joined(pieces: Column, size: int, overlap: int) -> Column:
    """Neighbours of a group joined up to ``size`` characters; what is left over of one text begins the next."""
    state = lambda out, text, sizes, g: F.struct(out.alias("out"), text.alias("text"), sizes.alias("sizes"), g.alias("g"))
    none, empty = F.array().cast("array<string>"), F.array().cast("array<int>")

    def told(s: Column) -> Column:
        return _let(_stripped(s["text"]), lambda t: F.when(t != "", F.array_append(s["out"], t)).otherwise(s["out"]))

    def left(s: Column, n: Column) -> Column:
        """What is held when at most ``overlap`` characters, and with n more at most ``size``, may stay."""
        most = F.least(F.lit(overlap), F.lit(size) - n)
        drop = F.aggregate(s["sizes"], F.struct(F.length(s["text"]).alias("left"), F.lit(0).alias("k")), lambda a, x: F.when(a["left"] > most, F.struct((a["left"] - x).alias("left"), (a["k"] + 1).alias("k"))).otherwise(a))
        return _let(drop, lambda d: state(told(s), F.right(s["text"], d["left"]), F.slice(s["sizes"], d["k"] + 1, F.size(s["sizes"])), s["g"]))

    def add(s: Column, p: Column) -> Column:
        def more(s: Column, n: Column) -> Column:
            return state(s["out"], F.concat(s["text"], p["t"]), F.array_append(s["sizes"], n), p["g"])

        def step(n: Column) -> Column:
            fresh = F.when(s["g"] != p["g"], state(told(s), F.lit(""), empty, p["g"]))
            return _let(fresh.when(F.length(s["text"]) + n > size, left(s, n)).otherwise(s), lambda x: more(x, n))

        return _let(F.length(p["t"]), step)

    return F.aggregate(pieces, state(none, F.lit(""), empty, F.lit("")), add, told)


def split_column(c: Column, size: int = 2048, overlap: int = 256, separators: list[str] = SEPARATORS) -> Column:
    """``split_text`` by built-in functions: the array of a text's chunks; null and blank give none."""
    pieces = F.array(F.struct(F.coalesce(c, F.lit("")).alias("t"), F.lit("").alias("g")))
    for level, separator in enumerate(separators):
        pieces = _cut(pieces, separator, level, size)
    return _joined(pieces, size, overlap)


def splitter(size: int = 2048, overlap: int = 256):
    """A column function: text to the array of its chunks; null and blank give none."""
    return lambda c: split_column(F.col(c) if isinstance(c, str) else c, size, overlap)
