"""JSON values with // and /* */ comments, and values as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column, schema: str) -> Column:
    """The value as a struct of `schema`; comments count as white space. Null where the text isn't JSON."""
    return F.from_json(text, schema, {"allowComments": "true", "mode": "PERMISSIVE"})


#: A valid escape of a string. Halves of surrogate pairs aren't, so neither are pairs.
ESCAPE = r'\\(?:["\\/bfnrt]|u(?![dD][89abcdefABCDEF])[0-9A-Fa-f]{4})'
NUMBER = r"-?(?:0|[1-9][0-9]*+)?(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
EDGE = r"[0-9A-Za-z.+\-]"


def strict(text: Column) -> Column:
    """Whether the text is one JSON value by these rules: // and /* */ comments count as white space, and so do \\v and \\f; strings may
    hold any raw characters, but only the known escapes and no surrogates; no leading zeros and no + before numbers, though -.5 is
    one; whole numbers fit 64 bits, others a double and not below its normal range unless 0; no trailing commas; a NUL ends the
    text. Null for null. Nesting of more than 1,000 levels isn't read.

    Escapes, comments, strings and numbers become plain tokens, one kind after the other, and what is left is parsed: alone in an array,
    where it must be one element, and as a field of an object."""
    text = F.regexp_replace(text, r"(?s)\x00.*", "")
    plain = F.regexp_replace(text, ESCAPE, "e")
    plain = F.regexp_replace(plain, r'(?s)("[^"\\]*+")|/\*.*?\*/|//[^\n]*+', "$1 ")
    plain = F.regexp_replace(plain, r'"[^"\\]*+"', '"s"')
    plain = F.regexp_replace(plain, r"[\x0B\f]", " ")
    numbers = F.filter(F.regexp_extract_all(plain, F.lit(f"(?<!{EDGE})(?=[0-9\\-]){NUMBER}(?!{EDGE})"), F.lit(0)), lambda x: x != "")
    whole = lambda x: x.rlike(r"^-?[0-9]+$")
    value = lambda x: F.abs(x.try_cast("double"))
    zero = lambda x: ~F.regexp_replace(x, "[eE].*", "").rlike("[1-9]")
    normal = lambda x: (value(x) < float("inf")) & (zero(x) | (value(x) >= 2.2250738585072014e-308))
    fit = F.forall(numbers, lambda x: F.coalesce(F.when(whole(x), x.try_cast("bigint").isNotNull()).otherwise(x.rlike("[0-9]") & ~x.rlike("^-?[eE]") & normal(x)), F.lit(False)))
    plain = F.regexp_replace(plain, f"(?<!{EDGE})(?=[0-9\\-]){NUMBER}(?!{EDGE})", "0")
    one = F.size(F.from_json(F.concat(F.lit("["), plain, F.lit("]")), "array<string>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})) == 1
    field = F.get_json_object(F.concat(F.lit('{"a":['), plain, F.lit("]}")), "$.a").isNotNull()
    return F.when(text.isNotNull(), F.coalesce(one & field & fit & ~F.contains(plain, F.lit("\\")), F.lit(False)))


#: What JSON writes for these characters; other control characters are written by their numbers.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escaped(text: Column) -> Column:
    """The text as it stands between the quotes of a JSON string."""
    marks = SHORT | {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in SHORT}
    return reduce(lambda out, m: F.replace(out, F.lit(m[0]), F.lit(m[1])), marks.items(), text)


def dumped(*columns: str) -> Column:
    """The columns as one JSON object, keys in order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
